"""Substring dedup: repeated word windows are found by Rabin-Karp hashes and removed as maximal intervals.

Hashes of word spans are Rabin-Karp hashes, rolled over the text. Windows of ``window`` words of every document are counted in
three exact steps, each of which settles most of what it sees; only windows that reach the third are hashed one by one, so few window rows are shuffled:

1. A window's *anchor* is the least hash of the shorter word runs inside it. Equal windows have equal anchors,
   so windows under an anchor that one document alone has can't repeat. Consecutive windows with one anchor
   form a *run*, one row with the hash of the words it spans.
2. Equal runs are counted. In all documents but the smallest id of a run, all its windows repeat.
3. Where one anchor has different runs, the windows of each run's first document are counted one by one.

Joins go through written tables, so adaptive execution can split hot anchors, runs and windows. Span hashes have
128 bits (two bases). Windows are judged on the input, never on what earlier removals left.

Defined results: a null text has no words. A row without ``doc_id`` loses nothing and counts as no earlier
document. Rows that repeat a ``doc_id`` are judged alike: only smaller ids count. Texts shorter than the window
stay whole. Empty tables give empty results. Extra columns pass through :func:`replaced_text` unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canticle.plans.cut import scope, written
from canticle.plans.names import restored, whole_row

WINDOW = 50
ANCHOR = 8
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
KEYS = ["_id", "_row"]


class WordHashes(dict):
    """Word to 64-bit hash, filled as words come; started anew at ``most`` entries."""

    most = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of a base modulo 2^64 and of its inverse, as long as the longest text so far."""

    def __init__(self, base: int):
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 1 << 64), np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> None:
        if len(self.up) <= n:
            n = 1 << int(n).bit_length()
            self.up, self.down = (np.cumprod(np.append(np.uint64(1), np.full(n, b, np.uint64))) for b in (self.base, self.inverse))


class Rolling:
    """Rabin-Karp hashes of the word spans of texts."""

    def __init__(self):
        self.words, self.powers = WordHashes(), [Powers(b) for b in BASES]

    def prefix(self, words: list[bytes], k: int = 0) -> np.ndarray:
        hashes = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        return self.prefix_of(hashes, k)

    def prefix_of(self, hashes: np.ndarray, k: int) -> np.ndarray:
        p = self.powers[k]
        p.to(len(hashes))
        out = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum((mixed(hashes) if k else hashes) * p.up[: len(hashes)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, stop: np.ndarray, k: int) -> np.ndarray:
        return mixed((prefix[stop] - prefix[start]) * self.powers[k].down[start] + (stop - start).astype(np.uint64))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values, by doubling."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :])


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _row, _text): a row's key is its id and the hash of its text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_row"), text.alias("_text"))


def runs(slim: DataFrame, window: int, anchor: int) -> DataFrame:
    """(_id, _row, anchor, run1, run2, start, n): the runs of consecutive windows with one anchor."""
    names = [*KEYS, "anchor", "run1", "run2", "start", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Rolling()
        for batch in batches:
            found: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in names]
            for key, row, text in zip(batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2), strict=True):
                words = text.as_py().encode().split()
                if (n := len(words)) < window:
                    continue
                hashes = np.fromiter(map(roll.words.__getitem__, words), np.uint64, n)
                one, two = roll.prefix_of(hashes, 0), roll.prefix_of(hashes, 1)
                at = np.arange(n - anchor + 1)
                least = sliding_min(roll.spans(one, at, at + anchor, 0), window - anchor + 1)
                start = np.append(0, np.flatnonzero(least[1:] != least[:-1]) + 1)
                count = np.diff(np.append(start, len(least)))
                stop = start + count - 1 + window
                same = np.full(len(start), key), np.full(len(start), row)
                for out, x in zip(found, (*same, least[start].view(np.int64), roll.spans(one, start, stop, 0).view(np.int64), roll.spans(two, start, stop, 1).view(np.int64), start, count), strict=True):
                    out.append(x)
            cols = [np.concatenate(x) for x in found]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols[:5]), *(pa.array(x.astype(np.int32)) for x in cols[5:])], names=names)

    return slim.where("_id is not null").mapInArrow(run, "_id long, _row long, anchor long, run1 long, run2 long, start int, n int")


def windows_of(chosen: DataFrame, window: int) -> DataFrame:
    """(_id, _row, w1, w2, start): the windows whose starts the column ``spans`` of (_id, _row, _text) packs."""
    names = [*KEYS, "w1", "w2", "start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Rolling()
        for batch in batches:
            for key, row, text, spans in zip(batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2), batch.column(3), strict=True):
                words = text.as_py().encode().split()
                packed = spans.values.to_numpy()
                begin, count = packed >> 32, packed & 0xFFFFFFFF
                start = np.repeat(begin - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
                one, two = roll.prefix(words), roll.prefix(words, 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(start), key)),
                        pa.array(np.full(len(start), row)),
                        pa.array(roll.spans(one, start, start + window, 0).view(np.int64)),
                        pa.array(roll.spans(two, start, start + window, 1).view(np.int64)),
                        pa.array(start.astype(np.int32)),
                    ],
                    names=names,
                )

    return chosen.mapInArrow(run, "_id long, _row long, w1 long, w2 long, start int")


def packed(start, length):
    """Two ints in one long."""
    return F.shiftleft(start.cast("long"), 32).bitwiseOR(length.cast("long"))


def repeated_spans(slim: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(_id, _row, spans): per row with repeats, its repeated windows as packed (start, words covered)."""
    every = written(runs(slim, window, min(anchor, window)), "all-runs")
    shared = written(every.groupBy("anchor").agg(F.min("_id").alias("lo"), F.max("_id").alias("hi")).where("lo < hi").select("anchor"), "anchors")
    near = written(every.join(shared, "anchor", "left_semi"), "runs")
    kinds = written(near.groupBy("anchor", "run1", "run2").agg(F.min("_id").alias("lo")), "kinds")
    several = written(kinds.groupBy("anchor").agg(F.min("run1").alias("a"), F.max("run1").alias("b")).select("anchor", (F.col("a") < F.col("b")).alias("several")), "anchor-kinds")
    firsts = written(kinds.join(several, "anchor"), "first-runs")
    judged = written(near.join(firsts, ["anchor", "run1", "run2"]).where("_id > lo or several").select(*KEYS, "start", "n", (F.col("_id") > F.col("lo")).alias("gone")), "judged-runs")
    open_runs = judged.where("not gone").groupBy(*KEYS).agg(F.collect_list(packed(F.col("start"), F.col("n"))).alias("spans"))
    single = written(windows_of(slim.join(open_runs, KEYS).select(*KEYS, "_text", "spans"), window), "windows")
    seen = written(single.groupBy("w1", "w2").agg(F.min("_id").alias("lo"), F.max("_id").alias("hi")).where("lo < hi").select("w1", "w2", "lo"), "repeated-windows")
    late = single.join(seen, ["w1", "w2"]).where("_id > lo").select(*KEYS, packed(F.col("start"), F.lit(window)).alias("span"))
    whole = judged.where("gone").select(*KEYS, packed(F.col("start"), F.col("n") + window - 1).alias("span"))
    return whole.union(late).groupBy(*KEYS).agg(F.collect_list("span").alias("spans"))


def maximal(spans: np.ndarray, n: int) -> np.ndarray:
    """Mask of the words of a text of ``n`` words that the packed spans cover."""
    turn = np.zeros(n + 1, np.int32)
    begin = spans >> 32
    np.add.at(turn, begin, 1)
    np.add.at(turn, begin + (spans & 0xFFFFFFFF), -1)
    return np.cumsum(turn[:-1]) > 0


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each row's words outside repeated windows, joined by one space."""
    slim = keyed(docs, id_col, text_col)
    with scope(docs.sparkSession):
        spans = written(repeated_spans(slim, window, anchor), "spans", keep=True)
    cut = slim.join(spans, KEYS, "left").select("_id", "_text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, kept = [], [], []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                words = text.as_py().encode().split()
                sizes.append(len(words))
                if spans.is_valid:
                    words = [w for w, out in zip(words, maximal(spans.values.to_numpy(), len(words)).tolist(), strict=True) if not out]
                gone.append(sizes[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return cut.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def replaced_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``docs`` with repeated windows cut out of the texts; a text that loses nothing stays as it is."""
    with scope(docs.sparkSession):
        spans = written(repeated_spans(keyed(docs, id_col, text_col), window, anchor), "spans", keep=True).withColumnRenamed("spans", "_spans")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, some in zip(texts, spans, strict=True):
            words = (text or "").encode().split()
            gone = maximal(np.asarray([] if some is None else some, np.int64), len(words)).tolist()
            out.append(b" ".join([w for w, x in zip(words, gone, strict=True) if not x]).decode())
        return pd.Series(out, dtype=object)

    text = F.col(text_col).cast("string")
    hit = F.col("_spans").isNotNull()
    marked = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_row"), text.alias("_text"), whole_row(docs).alias("_doc"))
    left = F.when(hit, cut(F.when(hit, F.col("_text")), F.when(hit, F.col("_spans")))).otherwise(F.col("_text"))
    return marked.join(spans, KEYS, "left").select(*restored(docs, "_doc", {text_col: left}))


def op1_substring_dedup(spark, sf_dir):
    """Contract query 1: words, removed words and the digest of what is kept, for every document."""
    found = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
