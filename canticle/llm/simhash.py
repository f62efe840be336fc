"""SimHash near-duplicate detection with bit-sliced comparison.

1. Every document gets a 64-bit SimHash over its word shingles (numpy inside Arrow batches).
2. Distinct fingerprints are dealt into buckets: the 64 bits are cut into ``radius + 2`` blocks, and two
   fingerprints within ``radius`` bits agree on at least two whole blocks, so every pair of blocks is a table
   and its bits a bucket key. No link can be missed.
3. Inside a bucket, bit planes are stored vertically (bit k of 64 fingerprints in one word). All lanes are
   compared at once with the lanes ``d`` places further; carry-save counters add the differing bits of 64 pairs
   per word, and words whose pairs all exceed the radius are abandoned. A bucket returns a spanning forest
   of its links, never all pairs.
4. Buckets over ``bucket_limit`` members are cut into blocks, and each pair of blocks is a task of its own.
5. Components of the links come from alternating star contraction on written tables.

Defined results: a null or wordless text has fingerprint zero, linked like any other. A null ``doc_id`` keeps
its row and never names a component unless no member has an id (then null). Repeated rows each get their row.
An empty table gives an empty result. Other columns are ignored by :func:`near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canticle.llm.components import smallest_reachable
from canticle.plans.cut import scope, written
from canticle.plans.names import unused

BITS = 64


def simhash(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of one text as a signed 64-bit integer."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, seed) for g in grams), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([simhash(t.as_py(), shingle) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], names=["doc_id", "fp"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, fp long")


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """Vertical store: row k holds bit k of every fingerprint, 64 fingerprints to a word, one spare word."""
    n = len(fps)
    words = -(-n // BITS) + 1
    bits = np.zeros((BITS, words * BITS), np.uint8)
    bits[:, :n] = np.unpackbits(fps.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def pack_lanes(flags: np.ndarray, words: int) -> np.ndarray:
    """One bit per lane, in ``words`` words."""
    bits = np.zeros(words * BITS, np.uint8)
    bits[: len(flags)] = flags
    return np.packbits(bits, bitorder="little").view(np.uint64)


def lanes_within(planes: np.ndarray, wanted: np.ndarray, shift: int, radius: int, step: int = 8) -> np.ndarray:
    """Lanes i whose fingerprint differs from lane i + shift in at most ``radius`` bits; ``wanted`` is a lane mask."""
    words = planes.shape[1]
    jump, off = divmod(shift, BITS)
    at = np.flatnonzero(wanted)
    at = at[at + jump < words]
    counters = [np.zeros(len(at), np.uint64) for _ in range(radius.bit_length())]
    over = ~wanted[at]
    low, high = np.uint64(off), np.uint64(BITS - off)
    for k in range(0, BITS, step):
        near = planes[k : k + step]
        ahead = near[:, at + jump]
        if off:
            ahead = (ahead >> low) | (near[:, np.minimum(at + jump + 1, words - 1)] << high)
        for carry in near[:, at] ^ ahead:
            for c in counters:
                carry, c[:] = c & carry, c ^ carry
            over |= carry
        alive = np.flatnonzero(over != np.uint64(0xFFFFFFFFFFFFFFFF))
        if len(alive) < len(at):
            at, over, counters = at[alive], over[alive], [c[alive] for c in counters]
            if not len(at):
                return np.empty(0, np.int64)
    more, equal = np.zeros(len(at), np.uint64), ~np.zeros(len(at), np.uint64)
    for k in reversed(range(len(counters))):  # counter > radius, from the high bit down
        if radius >> k & 1:
            equal &= counters[k]
        else:
            more |= equal & counters[k]
            equal &= ~counters[k]
    good = ~(over | more)
    row, bit = np.nonzero(np.unpackbits(good.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return at[row] * BITS + bit


def forest(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, root) that span every group of linked fingerprints under one key; keys are sorted."""
    again = np.zeros(len(keys), bool)
    again[1:] = keys[1:] == keys[:-1]
    again[:-1] |= again[1:]
    keys, fps = keys[again], fps[again]
    root = np.arange(len(keys))
    lanes, shift = root.copy(), 1
    planes = bit_planes(fps) if len(fps) else None
    group = keys
    while len(lanes) > shift:
        same = group[shift:] == group[:-shift]
        if not same.any():
            break
        hits = lanes_within(planes, pack_lanes(same, planes.shape[1]), shift, radius)
        if len(hits):
            hook(root, lanes[hits], lanes[hits + shift])
        shift += 1
        if shift % 16 == 0 or shift < 4:  # keep the lanes of groups that are larger than the shift
            _, first, size = np.unique(group, return_index=True, return_counts=True)
            keep = np.repeat(size > shift, size)
            if keep.sum() < 0.7 * len(keep):
                lanes, group = lanes[keep], group[keep]
                planes = bit_planes(fps[lanes]) if len(lanes) else planes
    linked = root != np.arange(len(root))
    return fps[linked], fps[root[linked]]


def hook(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite a[k] with b[k] for all k, in place; every root is the smallest lane of its set."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not (root[root] == root).all():
            root[:] = root[root]


def block_masks(radius: int, spare: int = 2) -> list[int]:
    """Masks of the tables: bits within ``radius`` leave ``spare`` of ``radius + spare`` blocks untouched."""
    blocks = radius + spare
    cut = [BITS * k // blocks for k in range(blocks + 1)]
    masks = [(1 << cut[k + 1]) - (1 << cut[k]) for k in range(blocks)]
    whole = [sum(masks[k] for k in some) for some in combinations(range(blocks), spare)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in whole]


def links(distinct: DataFrame, radius: int = 3, bucket_limit: int = 50_000) -> DataFrame:
    """(a, b): links that span every group of fingerprints within ``radius`` bits. ``distinct`` has one column, fp."""
    tables = [F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for k, m in enumerate(block_masks(radius))]
    dealt = distinct.select("fp", F.explode(F.array(*tables)).alias("key"))
    large = written(
        dealt.groupBy("key").count().where(F.col("count") > bucket_limit).select("key", F.ceil(F.col("count") * 2 / bucket_limit).alias("blocks")),
        "large-buckets",
    )
    block = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks"))
    spread = (
        dealt.join(large, "key", "left")
        .withColumn("other", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))))
        .select(F.when(F.col("blocks").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least(block, "other"), F.greatest(block, "other"))).alias("key"), "fp")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy()])
            whole = np.searchsorted(keys, keys[-1])  # the last key may go on in the next batch
            if whole >= 1 << 15:
                yield found(keys[:whole], fps[:whole])
                keys, fps = keys[whole:], fps[whole:]
        yield found(keys, fps)

    def found(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        a, b = forest(keys, fps, radius)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return spread.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, bucket_limit: int = 50_000) -> DataFrame:
    """(doc_id, fp, component_id): the SimHash of each row and the smallest id reachable over links."""
    prints = written(fingerprints(docs, id_col, text_col, shingle), "simhash")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("lo"))
    found = smallest_reachable(links(distinct.select("fp"), radius, bucket_limit), distinct)
    return prints.join(found, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each group is kept: that with the smallest id.

    Rows without an id can't be named as copies and stay.
    """
    (gone_,) = unused(docs, "gone")
    with scope(docs.sparkSession):
        marked = near_duplicates(docs, id_col, text_col, shingle, radius)
        gone = written(marked.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(gone_)).distinct(), "copies", keep=True)
    return docs.join(gone, F.col(id_col).cast("long") == F.col(gone_), "left_anti")


def op10_simhash_near_dedup(spark, sf_dir):
    """Contract query 10: fingerprint and component of every document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
