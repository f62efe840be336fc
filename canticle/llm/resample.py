"""Target-distribution importance resampling with hashed n-gram features.

1. Every word's CRC-32 is computed once. The CRC of an n-gram comes from those of its words: appending
   k bytes is a linear map over GF(2), the product of the matrices for the powers of two in k, so ``crc(a + b) = shift(crc(a), len(b)) ^ crc(b)``.
   It is applied to all n-grams of a batch of documents at once, by byte tables; no n-gram is ever a string.
2. A feature's bucket is its CRC modulo ``buckets``. Every task counts its rows into one array of buckets; Spark adds the arrays of corpus
   and target up. The sums (``buckets`` rows each, whatever the input) go to the driver, which makes the table of gains.
3. A document's weight is the floored mean of its features' gains. A Gumbel draw from the hash of its id is added, and the
   highest sums are drawn: that is sampling without replacement in proportion to the exponential of the weight.
4. Ranks come from a range partitioning by the whole order: the place in the range and the rows of the ranges before. No task sees all rows.

Words are runs of ASCII letters, digits and bytes over 127, after A-Z are lower-cased. Long texts are read in blocks.

Defined results: a null text has no words, no features and weight 0. A null id draws as an empty one and comes after all ids in ties. Repeated
rows each keep their row and are drawn each for itself; rows alike in everything have any order among them. Empty corpus or target: counts are
0 and gains follow the formula. Extra columns pass unchanged, whatever their names; only the struct ``_drawn`` is replaced.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canticle.plans.cut import written
from canticle.plans.names import unused

BUCKETS, NGRAM, SEED, LEAST_WORDS, PERCENT = 10_000, 1, 2024, 20, 10
#: Bytes of text that are split at a time.
BLOCK = 1 << 20
_SPACE = b" "
#: A-Z to a-z; every other byte that no word has to a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


@cache
def shift_tables() -> np.ndarray:
    """[j, k, v]: what byte k of a CRC with value v becomes when 2**j zero bytes are appended."""
    tables = np.zeros((32, 4, 256), np.uint32)
    zero = np.uint32(zlib.crc32(b"\0"))  # crc(a + zero byte) is linear in crc(a) but for this constant
    for byte in range(4):
        for bit in range(8):
            value = np.uint32(1 << 8 * byte + bit)
            # One zero byte: the CRC register (its complement) moves on by a byte of its table.
            tables[0, byte, 1 << bit] = np.uint32(zlib.crc32(b"\0", int(value))) ^ zero
    for j in range(32):
        if j:
            for byte in range(4):
                for bit in range(8):
                    tables[j, byte, 1 << bit] = _mapped(tables[j - 1], tables[j - 1, byte, 1 << bit : (1 << bit) + 1])[0]
        for byte in range(4):
            for v in range(1, 256):  # linear: the sum of its bits
                low = v & -v
                tables[j, byte, v] = tables[j, byte, v ^ low] ^ tables[j, byte, low]
    return tables


def _mapped(table: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    return table[0][crcs & 255] ^ table[1][crcs >> 8 & 255] ^ table[2][crcs >> 16 & 255] ^ table[3][crcs >> 24]


def shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The part of ``crc(a + b)`` that comes from a: its CRCs after ``lengths`` more bytes."""
    out, tables = crcs.astype(np.uint32), shift_tables()
    for j in range(int(lengths.max(initial=0)).bit_length()):
        on = np.flatnonzero(lengths >> j & 1)
        out[on] = _mapped(tables[j], out[on])
    return out


def ngram_checksums(crcs: np.ndarray, lengths: np.ndarray, ngram: int) -> Iterator[np.ndarray]:
    """For n = 1 to ``ngram``: the CRC of the n words from each place on, joined by a space."""
    led = shifted(np.full(len(crcs), zlib.crc32(_SPACE), np.uint32), lengths) ^ crcs if ngram > 1 else crcs  # of a space and the word
    grown = crcs
    for n in range(1, ngram + 1):
        if n > 1:
            grown = shifted(grown[: len(grown) - 1], lengths[n - 1 :] + 1) ^ led[n - 1 :]
        yield grown
        if len(grown) < 2:
            return


def blocks(text: str) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    data = text.encode().translate(_TABLE)
    at = 0
    while at < len(data):
        end = len(data) if len(data) - at <= BLOCK else data.find(_SPACE, at + BLOCK)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def features(texts: list[str | None], ngram: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts: words each, the text of every feature, its bucket."""
    words, owners, found = np.zeros(len(texts), np.int64), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    crcs, lengths = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
    for k, text in enumerate(texts):
        for some in blocks(text) if text else ():
            words[k] += len(some)
            crcs.append(np.fromiter(map(zlib.crc32, some), np.uint32, len(some)))
            if ngram > 1:
                lengths.append(np.fromiter(map(len, some), np.int64, len(some)))
    owner = np.repeat(np.arange(len(texts)), words)
    for n, each in enumerate(ngram_checksums(np.concatenate(crcs), np.concatenate(lengths), ngram), 1):
        inside = owner[: len(each)] == owner[n - 1 :] if n > 1 else slice(None)  # no run crosses from text to text
        owners.append(owner[: len(each)][inside])
        found.append((each[inside] % np.uint32(buckets)).astype(np.int64))
    return words, np.concatenate(owners), np.concatenate(found)


def short_lists(column: pa.Array, most: int = 8 << 20) -> Iterator[list[str | None]]:
    """The texts of a batch, some millions of characters at a time."""
    some, size = [], 0
    for x in column:
        some.append(x.as_py())
        size += len(some[-1] or "")
        if size >= most:
            yield some
            some, size = [], 0
    if some:
        yield some


def bucket_counts(texts: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of a one-column table of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for some in short_lists(batch.column(0)):
                total += np.bincount(features(some, ngram, buckets)[2], minlength=buckets)
        (at,) = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket from the (bucket, n) of corpus and target."""
    counted = []
    for side in (corpus, target):
        counts = [0] * buckets
        for bucket, n in side.collect():  # as many rows as buckets at most
            counts[bucket] = n
        counted.append((counts, sum(counts)))
    (s, all_s), (t, all_t) = counted
    return np.array([math.floor(1000 * math.log((t[k] + 1) * (all_s + buckets) / ((s[k] + 1) * (all_t + buckets)))) for k in range(buckets)], np.int64)


def noise(id_: object, seed: int) -> int:
    """A Gumbel draw in thousandths from the hash of an id."""
    h = int(hashlib.sha256(f"{seed}:{'' if id_ is None else id_}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, gain: np.ndarray, ngram: int, seed: int) -> DataFrame:
    """(id, n_words, n_features, weight, score) of each row of (id, text)."""
    names = ["id", "n_words", "n_features", "weight", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column(0), 0
            for some in short_lists(batch.column(1)):
                words, owner, bucket = features(some, ngram, len(gain))
                n = np.bincount(owner, minlength=len(some))
                total = np.zeros(len(some), np.int64)
                np.add.at(total, owner, gain[bucket])  # whole numbers
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                own = ids.slice(at, len(some))
                score = weight + np.array([noise(x, seed) for x in own.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([own, *map(pa.array, (words, n, weight, score))], names=names)
                at += len(some)

    return docs.mapInArrow(run, "id long, n_words long, n_features long, weight long, score long")


def ranked(rows: DataFrame, percent: int, least_words: int) -> DataFrame:
    """``rows`` of (row, id, n_words, score and more) with ``rank`` from 1 for the drawn share of those that are long enough."""
    order = [F.desc("score"), F.asc_nulls_last("id")]
    able = rows.where(F.col("n_words") >= least_words)
    dealt = written(able.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "drawn-ranges")
    range_, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dealt.groupBy(range_.alias("range")).count()
    starts = sizes.select("range", F.coalesce(F.sum("count").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("count").over(Window.partitionBy()).alias("of"))
    placed = dealt.join(F.broadcast(starts), range_ == F.col("range"))  # one row for each partition
    rank = place + F.col("before") + 1
    return placed.select(*rows.columns, F.when(rank <= F.floor(percent * F.col("of") / 100), rank).alias("rank")).unionByName(rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def resampled(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", ngram: int = NGRAM, buckets: int = BUCKETS,
    seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS,
) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every row of ``docs``; ``rank`` is null where a row isn't drawn."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    gain = gains(bucket_counts(slim.select("text"), ngram, buckets), bucket_counts(target.select(F.col(target_col).cast("string")), ngram, buckets), buckets)
    return ranked(written(weighed(slim, gain, ngram, seed), "weights"), percent, least_words)


def keep_drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id is drawn. Rows without an id can't be named and go."""
    (drawn,) = unused(docs, "drawn")
    ids = resampled(docs, target, id_col, text_col, **options).where("rank is not null").select(F.col("id").alias(drawn)).distinct()
    return docs.join(written(ids, "drawn"), F.col(id_col).cast("long") == F.col(drawn), "left_semi")


def op11_importance_resampling(spark, sf_dir):
    """Contract query 11: features, weight, score and rank of every document; the target is ``benchmark``."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    return resampled(docs, target).select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


OP11_SQL = r"""
WITH crc_table AS (
  SELECT list(c ORDER BY k) AS tab FROM (
    SELECT k, list_reduce(list_prepend(k, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
    FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS k))),
w AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM documents),
x AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM benchmark),
v AS (SELECT DISTINCT w FROM (SELECT w FROM w UNION ALL SELECT w FROM x)),
b AS (
  SELECT w, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(1, len(hex(encode(w))) // 2 + 1), lambda i: CAST('0x' || substr(hex(encode(w)), CAST(2 * i - 1 AS INT), 2) AS BIGINT))),
    lambda c, y: xor(tab[(xor(c, y) & 255) + 1], c >> 8))) % 10000 AS bucket
  FROM v, crc_table),
s AS (SELECT bucket, count(*) AS n FROM w JOIN b USING (w) GROUP BY 1),
t AS (SELECT bucket, count(*) AS n FROM x JOIN b USING (w) GROUP BY 1),
g AS (
  SELECT k AS bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1) * CAST((SELECT coalesce(sum(n), 0) FROM s) + 10000 AS DOUBLE)
    / ((coalesce(s.n, 0) + 1) * CAST((SELECT coalesce(sum(n), 0) FROM t) + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM (SELECT unnest(range(10000)) AS k) LEFT JOIN s ON s.bucket = k LEFT JOIN t ON t.bucket = k),
f AS (SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM w JOIN b USING (w) JOIN g USING (bucket) GROUP BY 1),
d AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0) AS weight, CAST('0x' || sha256('2024:' || doc_id)[1:8] AS BIGINT) AS h
  FROM documents LEFT JOIN f USING (doc_id)),
e AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS of FROM e WHERE n_features >= 20)
SELECT e.doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
       CASE WHEN rank <= of * 10 // 100 THEN CAST(rank AS BIGINT) END AS rank
FROM e LEFT JOIN r ON e.doc_id = r.doc_id
"""
