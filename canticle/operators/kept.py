"""A kept search index: postings written once and read by token.

Four tables lie under a path, each with a partition ``segment``:

* ``postings``: blocks of at most ``BLOCK`` documents for a token and field (lead, token, field, ids, lens, ends, gaps). ``gaps`` are the token's positions in
  the block's documents one after another, each less the one before in its document; ``ends`` is where each document's end. Blocks are partitioned by
  ranges of tokens and sorted by token, so a query lists the folders of its tokens' first letters (``lead``) alone and reads there the row groups and pages of
  the tokens. A token that fills several ranges is spread over them by document. ``lens`` are the documents' lengths: ranking joins no table of all documents.
* ``documents``: (id, len).
* ``replaced``: ids that an earlier segment holds too. The latest segment's text counts.
* ``totals``: documents and tokens that the segment adds, the type of ids. It is written last, and a segment without it doesn't count.

Tasks group the words of about ``WORDS`` words of text into blocks before anything is shuffled, so a word that many texts share costs a few bytes a text. Where ranges
begin is read off at most ``SAMPLE`` words; that decides how even the ranges are, never what they hold. Whole numbers as ids take the least room.

A segment written again overwrites itself, so a failed run may be repeated. Rows without an id are left out; a null text has no tokens; an id that
occurs twice in one segment is an error.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from canticle.operators import search

TOTALS = "documents long, tokens long, replaced long, id_type string, segment int"
#: Bytes of a row group of postings: small ones, so that a token's rows are few of a file.
ROW_GROUP = 16 << 20
#: How postings are packed: lists of numbers as differences, without a try at a dictionary, which takes most of the time of writing and saves little room.
PACKED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1", "parquet.writer.version": "PARQUET_2_0"} | {f"parquet.enable.dictionary#{c}.list.element": "false" for c in ("ids", "lens", "ends", "gaps")}
#: Documents of a block at most.
BLOCK = 4096
#: Words that a task groups at once: more only where one text has more.
WORDS = 1 << 21
#: Words of a range of tokens, and ranges at most; beyond that ranges grow.
RANGE, RANGES = 2_000_000, 20_000
#: Documents (about) and words (at most) that the beginnings of ranges are read off.
SAMPLED_DOCUMENTS, SAMPLE = 2048, 1 << 16


def add(docs: DataFrame, id_col: str, fields: list[str], path: str, segment: int, ranges: int | None = None) -> None:
    """Writes ``docs`` as a segment; segments are numbered in the order of their age. ``ranges``: parts of the postings (by default by the number of words)."""
    spark = docs.sparkSession
    _path(spark, f"{path}/totals/segment={segment}", lambda files, at: files.delete(at, True))  # until it is whole again
    words = {f: _words(F.col(f)) for f in fields}
    size = sum((F.octet_length(w) - F.octet_length(F.replace(w, F.lit(" "), F.lit(""))) for w in words.values()), F.lit(0)).cast("int")
    texts = F.array(*[F.struct(F.lit(f).alias("field"), w.alias("words")) for f, w in words.items()])
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), size.alias("len"), texts.alias("texts"))

    _documents(rows.groupBy("id").agg(F.sum("len").alias("len"), F.count("*").alias("rows")), path, segment)
    each = rows.select("id", "len", F.explode("texts").alias("x")).select("id", F.xxhash64("id").alias("h"), "len", "x.field", "x.words")
    starts = _range_starts(each, *_sizes(spark, path, segment), ranges)
    blocks = each.mapInArrow(_grouped(starts), f"range int, {_blocks_of(rows)}")
    _postings(_unmarked(blocks.repartitionById(len(starts) + 1, "range").drop("range")), path, segment)
    _totals(spark, path, segment)


def _words(text: Column) -> Column:
    """The words of a text in one string, a space behind each: far less to make and to move to Python than an array."""
    return F.ltrim(F.regexp_replace(F.concat(F.lower(F.coalesce(text, F.lit(""))), F.lit(" ")), search.TOKEN, " "))


def _blocks_of(rows: DataFrame) -> str:
    return f"token string, field string, ids array<{dict(rows.dtypes)['id']}>, lens array<int>, gaps array<int>"


def _unmarked(blocks: DataFrame) -> DataFrame:
    """Blocks as they are stored. On the way a document's first gap is marked by its complement, which is less than 0, so that ``ends`` needn't be moved."""
    first = F.filter(F.transform("gaps", lambda x, k: F.when(x < 0, k)), lambda k: k.isNotNull())
    ends = F.concat(F.slice(first, 2, F.size("ids")), F.array(F.size("gaps")))
    gaps = F.transform("gaps", lambda x: F.when(x < 0, F.bitwise_not(x)).otherwise(x))
    return blocks.select("token", "field", "ids", "lens", ends.alias("ends"), gaps.alias("gaps"))


def _sizes(spark: SparkSession, path: str, segment: int) -> tuple[int, int]:
    """Documents and words of a segment's ``documents``."""
    r = spark.read.parquet(f"{path}/documents/segment={segment}").agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("words")).first()
    return r["n"], r["words"]


def _range_starts(each: DataFrame, n: int, words: int, ranges: int | None) -> list[str]:
    """The first tokens of all ranges but the first, in order; a token that fills several ranges comes several times."""
    ranges = ranges or min(RANGES, -(-words // RANGE))
    if ranges <= 1:
        return []
    one_in = max(1, n // SAMPLED_DOCUMENTS)
    some = each.where(F.pmod("h", F.lit(one_in)) == 0).select("h", "field", F.posexplode(F.split("words", " ")).alias("pos", "token")).where("token <> ''")
    thin = some.withColumn("by", F.xxhash64("h", "field", "pos")).where(F.pmod("by", F.lit(max(1, words // one_in // SAMPLE))) == 0)
    found = sorted(r.token for r in thin.orderBy("by").limit(SAMPLE).select("token").collect())
    return [found[k * len(found) // ranges] for k in range(1, ranges)] if found else []


def _grouped(starts: list[str]):
    """Batches of (id, h, len, field, words) to blocks (range, token, field, ids, lens, gaps), marked. The range follows from a posting's token and document alone,
    whatever batches they come in. ``words`` are lists or, as :func:`_words` has them, strings. Blocks leave in the order of their tokens, which makes sorting them later cheap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            length = _lengths(whole.column(4))
            upto = np.cumsum(length)
            at = 0
            while at < whole.num_rows:
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + WORDS, "right")))
                yield grouped(whole.slice(at, end - at), length[at:end])
                at = end

    def grouped(batch: pa.RecordBatch, length: np.ndarray) -> pa.RecordBatch:
        known = _flat(batch.column(4)).dictionary_encode()
        by = pc.array_sort_indices(known.dictionary)
        token = known.dictionary.take(by)
        first, over = _ranges_of(token, starts)
        rank = np.empty(len(by), np.int32)
        rank[by.to_numpy()] = np.arange(len(by), dtype=np.int32)
        code = rank[known.indices.to_numpy()]
        del known
        fields = batch.column(3).dictionary_encode()
        of_field = fields.indices.to_numpy()
        row = np.repeat(np.arange(batch.num_rows, dtype=np.int32), length)
        slot = np.cumsum(over) - over  # a token's ranges, counted over all tokens
        key = slot[code]
        wide = np.flatnonzero((over > 1)[code])
        key[wide] += batch.column(1).to_numpy()[row[wide]] % over[code[wide]]
        key *= len(fields.dictionary)
        key += of_field[row]
        bits = len(key).bit_length()
        key <<= bits
        key |= np.arange(len(key), dtype=np.int32)
        key.sort()  # a token's texts and places stay in their order
        order = np.empty(len(key), np.int32)
        np.bitwise_and(key, (1 << bits) - 1, out=order, casting="unsafe")
        key >>= bits
        row = row[order]
        new_key = np.ones(len(key), bool)
        new_key[1:] = key[1:] != key[:-1]
        fresh = new_key.copy()
        fresh[1:] |= row[1:] != row[:-1]
        posting = np.flatnonzero(fresh).astype(np.int32)
        lead = posting[_heads(new_key[posting])]
        head, place = code[order[lead]], key[lead] // max(1, len(fields.dictionary))
        del code, key
        gap = order - (np.cumsum(length) - length).astype(np.int32)[row]  # places, and then what is between them
        del order
        gap[1:] -= np.where(fresh[1:], 0, gap[:-1])
        of = pa.array(row[posting])
        _, columns = _packed(new_key[posting], batch.column(0).take(of), batch.column(2).take(of), posting, gap)
        part = first[head] + place - slot[head]
        field = fields.dictionary.take(pa.array(of_field[row[lead]]))
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), token.take(pa.array(head)), field, *columns], names=["range", "token", "field", "ids", "lens", "gaps"])

    return run


def _lengths(words: pa.Array) -> np.ndarray:
    """Words of each row."""
    n = pc.count_substring(words, " ") if pa.types.is_string(words.type) else words.value_lengths()
    return n.to_numpy(zero_copy_only=False).astype(np.int64)


def _flat(words: pa.Array) -> pa.Array:
    """The words of all rows, one after another."""
    if not pa.types.is_string(words.type):
        return words.flatten()
    _, offsets, content = words.buffers()
    begin, end = np.frombuffer(offsets, np.int32)[[words.offset, words.offset + len(words)]] if len(words) else (0, 0)
    text = np.frombuffer(content, np.uint8)[begin:end] if end > begin else np.empty(0, np.uint8)
    at = np.flatnonzero(text == ord(" "))
    ends = np.zeros(len(at) + 1, np.int32)
    np.subtract(at, np.arange(len(at), dtype=np.int32), out=ends[1:], casting="unsafe")
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(text[text != ord(" ")]))


def _ranges_of(tokens: pa.Array, starts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of distinct ``tokens`` in order, the first range of each and the number of ranges that may hold it."""
    behind = [bisect_right(tokens, s, key=str) for s in starts]  # tokens from there on come after the start
    over = np.ones(len(tokens), np.int64)
    np.add.at(over, np.array([k - 1 for k, s in zip(behind, starts, strict=True) if k and str(tokens[k - 1]) == s], np.int64), 1)
    return np.searchsorted(np.array(behind, np.int64), np.arange(len(tokens)), "right"), over


def _packed(new_key: np.ndarray, ids: pa.Array, lens: pa.Array, at: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Postings (whose gaps begin ``at``) as marked blocks that begin at a new key and after ``BLOCK`` postings: the first posting of each, and its columns."""
    heads = _heads(new_key)
    offsets = np.append(heads, len(new_key))
    marked = gaps.astype(np.int32)
    marked[at] = ~marked[at]
    lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
    return heads, [lists(offsets, ids), lists(offsets, lens.cast(pa.int32())), lists(np.append(at[heads], len(gaps)), pa.array(marked))]


def _heads(new_key: np.ndarray) -> np.ndarray:
    """Where blocks begin."""
    n = np.arange(len(new_key), dtype=np.int32)
    since = n - np.maximum.accumulate(np.where(new_key, n, 0)) if len(n) else n
    return np.flatnonzero(since % BLOCK == 0)


def segments(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished segments."""
    return [r.segment for r in _done(spark, path)]


def opened(spark: SparkSession, path: str, tokens: list[str] | None = None, parts: tuple[str, ...] = ("tf", "len", "gaps")) -> DataFrame:
    """(token, field, id, and of tf, len, gaps those in ``parts``, segment): the postings that count; with ``tokens`` those of tokens that begin with the same letters."""
    done = _done(spark, path)
    schema = f"token string, field string, ids array<{_id_type(done)}>, lens array<int>, ends array<int>, gaps array<int>, segment int, lead string"
    at = [f"{path}/postings/segment={r.segment}" for r in done]
    if tokens is not None:
        at = [f"{x}/lead={lead}" for x in at for lead in sorted({t[0] for t in tokens})]
    there = [x for x in at if _path(spark, x, lambda files, found: files.exists(found))]
    blocks = spark.read.schema(schema).option("basePath", f"{path}/postings").parquet(*there) if there else spark.createDataFrame([], schema)
    each = F.explode(F.transform("ids", lambda x, k: F.struct(x.alias("id"), *_parts(k, parts)))).alias("x")
    return _live(blocks.select("token", "field", "segment", each).select("token", "field", "x.*", "segment"), path, done)


def _parts(k: Column, parts: tuple[str, ...]) -> list[Column]:
    """Of a block's document ``k``: how often it has the token, its length, the token's gaps."""
    begin = F.coalesce(F.get("ends", k - 1), F.lit(0))
    tf = F.get("ends", k) - begin
    known = {"tf": tf, "len": F.get("lens", k).cast("long"), "gaps": F.slice("gaps", begin + 1, tf)}
    return [known[x].alias(x) for x in parts]


def indexed_documents(spark: SparkSession, path: str) -> DataFrame:
    """(id, len, segment): the documents that count."""
    done = _done(spark, path)
    rows = _part(spark, path, "documents", f"id {_id_type(done)}, len long, segment int")
    return _live(rows.where(F.col("segment").isin([r.segment for r in done])), path, done)


def compacted(spark: SparkSession, path: str, into: str, ranges: int | None = None) -> None:
    """All segments as the one segment of another index, without what was replaced."""
    _documents(indexed_documents(spark, path).select("id", "len", F.lit(1).alias("rows")), into, 0)
    parts = [ranges] if ranges else []
    rows = opened(spark, path)
    ranged = rows.select("token", "field", "id", "len", "gaps").repartitionByRange(*parts, "token", "id").sortWithinPartitions("token", "field", "id")
    _postings(_unmarked(ranged.mapInArrow(_blocks, _blocks_of(rows))), into, 0)
    _totals(spark, into, 0)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (token, field, id, len, gaps), sorted, to marked blocks."""
    for batch in batches:
        code = [batch.column(k).dictionary_encode().indices.to_numpy() for k in (0, 1)]
        new_key = np.ones(batch.num_rows, bool)
        new_key[1:] = (code[0][1:] != code[0][:-1]) | (code[1][1:] != code[1][:-1])
        length = batch.column(4).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        heads, columns = _packed(new_key, batch.column(2), batch.column(3), np.cumsum(length) - length, batch.column(4).flatten().to_numpy())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(heads)), batch.column(1).take(pa.array(heads)), *columns], names=["token", "field", "ids", "lens", "gaps"])


def holding(spark: SparkSession, path: str, text: str) -> DataFrame:
    """Ids of documents that hold every token of ``text``, the last one also as a prefix."""
    return search.prefix_search(opened(spark, path, search.query_tokens(text), ()), text)


def placed(rows: DataFrame) -> DataFrame:
    """(id, field, token, pos) of postings. A document's rows meet in one task, where a phrase search needs them too."""
    each = rows.repartition("id").select("id", "field", "token", F.posexplode("gaps").alias("k", "gap"))
    until = Window.partitionBy("id", "field", "token").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return each.select("id", "field", "token", F.sum("gap").over(until).alias("pos"))


def phrase(spark: SparkSession, path: str, phrases: dict[str, str]) -> DataFrame:
    """Ids of documents that hold, for every field, its phrase as adjacent tokens in order."""
    tokens = [t for text in phrases.values() for t in search.query_tokens(text)]
    return search.phrase_search(placed(opened(spark, path, tokens, ("gaps",)).where(F.col("token").isin(tokens))), phrases)


def ranked(spark: SparkSession, path: str, text: str, k1: float = 1.2, b: float = 0.75, weights: dict[str, float] | None = None) -> DataFrame:
    """(id, score) as :func:`canticle.operators.search.bm25` gives it, from the postings of the text's tokens and the totals alone."""
    tokens = search.query_tokens(text)
    done = _done(spark, path)
    n, size = sum(r.documents for r in done), sum(r.tokens for r in done)
    rows = opened(spark, path, tokens, ("tf", "len")).where(F.col("token").isin(tokens))
    tf = rows.groupBy("id", "token").agg(F.sum(search.field_times(weights) * F.col("tf")).alias("tf"), F.first("len").alias("len"))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))  # one row a query token
    return tf.join(F.broadcast(df), "token").groupBy("id").agg(F.sum(search.bm25_points(n, size / n if n else 1.0, k1, b)).alias("score"))


def _documents(rows: DataFrame, path: str, segment: int) -> None:
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{path}/documents/segment={segment}")
    fresh = spark.read.parquet(f"{path}/documents/segment={segment}")
    twice = fresh.where("rows > 1").limit(1).collect()
    if twice:
        raise ValueError(f"an id occurs twice: {twice[0].id}")
    fresh.select("id").join(_older(fresh, path, segment).select("id"), "id", "left_semi").write.mode("overwrite").parquet(f"{path}/replaced/segment={segment}")


def _older(fresh: DataFrame, path: str, segment: int) -> DataFrame:
    """(id, len, segment) of finished segments before this one."""
    older = [s for s in segments(fresh.sparkSession, path) if s < segment]
    return _part(fresh.sparkSession, path, "documents", f"id {dict(fresh.dtypes)['id']}, len long, segment int").where(F.col("segment").isin(older))


def _postings(rows: DataFrame, path: str, segment: int) -> None:
    rows = rows.withColumn("lead", F.substring("token", 1, 1)).sortWithinPartitions("lead", "token", "field")
    rows.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).options(**PACKED).partitionBy("lead").parquet(f"{path}/postings/segment={segment}")


def _totals(spark: SparkSession, path: str, segment: int) -> None:
    """What the segment adds: its documents with a token, less the last texts of those that it replaces."""
    fresh = spark.read.parquet(f"{path}/documents/segment={segment}")
    replaced = spark.read.schema(fresh.select("id").schema).parquet(f"{path}/replaced/segment={segment}")
    last = _older(fresh, path, segment).join(replaced, "id", "left_semi").groupBy("id").agg(F.max_by("len", "segment").alias("len"))
    signed = fresh.select("len", F.lit(1).alias("sign")).union(last.select("len", F.lit(-1)))
    sums = signed.agg(
        F.coalesce(F.sum(F.when(F.col("len") > 0, F.col("sign"))), F.lit(0)).cast("long").alias("documents"),
        F.coalesce(F.sum(F.col("len") * F.col("sign")), F.lit(0)).cast("long").alias("tokens"),
        F.count_if(F.col("sign") < 0).alias("replaced"),
    )
    sums.withColumn("id_type", F.lit(dict(fresh.dtypes)["id"])).write.mode("overwrite").parquet(f"{path}/totals/segment={segment}")


def _done(spark: SparkSession, path: str) -> list[Row]:
    """The totals of finished segments, a row each, oldest first."""
    if not _path(spark, f"{path}/totals", lambda files, at: files.exists(at)):
        return []
    return sorted(_part(spark, path, "totals", TOTALS).collect(), key=lambda r: r.segment)


def _live(rows: DataFrame, path: str, done: list[Row]) -> DataFrame:
    """Rows whose document no later finished segment holds."""
    newer = [r.segment for r in done if r.replaced]
    if not newer:
        return rows
    later = _part(rows.sparkSession, path, "replaced", f"id {_id_type(done)}, segment int").where(F.col("segment").isin(newer))
    later = later.select(F.col("id").alias("_id"), F.col("segment").alias("_segment"))
    return rows.join(later, (F.col("id") == F.col("_id")) & (F.col("_segment") > F.col("segment")), "left_anti")


def _part(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/{name}")


def _id_type(done: list[Row]) -> str:
    return done[-1].id_type if done else "string"


def _path(spark: SparkSession, path: str, do):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return do(at.getFileSystem(spark._jsc.hadoopConfiguration()), at)
