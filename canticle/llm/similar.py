"""SimHash near-dedup of texts whose word shingles have a Jaccard similarity of ``least`` or more.

The 64 bits of two texts at similarity 0.8 differ in 9.7 +- 2.9 places, so no few blocks of bits are equal in all such pairs, and bits
alone don't tell 0.8 from 0.7. Therefore:

1. Every row gets its set of shingle hashes, a SimHash of the set, ``BANDS`` bucket keys of ``ROWS`` minima each, and a byte of each
   minimum. Equal sets are one node. A pair at 0.8 shares no key with a chance of 3 in a million, and less above.
2. Inside a bucket, SimHashes are compared bit-sliced (:func:`canticle.llm.simhash.lanes_within`): many distances at once by carry-save
   counters, abandoned once all exceed ``RADIUS``. Of pairs within it, the bytes of the minima estimate the similarity.
   In larger buckets first come pivots, members in the middle of others (nearest to the majority of the bits around them), against all; then members
   that are still apart, those most alike first. Only pairs of members that no pairs before connected leave the task: some per member, not all pairs of a bucket.
   Buckets over ``bucket_limit`` are cut into blocks, a task for each pair of blocks.
3. The exact similarity decides every pair that leaves a bucket.
4. A pair that is rejected may have stood for one that isn't. So pairs, rejected ones too, are joined to crowds, and every crowd with a rejected pair is
   gone through again with its sets: its members are compared until all that are alike are united, and the links that did it are exact. (Where no pair
   is rejected, the verified pairs connect all that the estimates did.) Crowds over ``crowd_limit`` are cut into pairs of blocks.
5. Components of the verified links come from star contraction. Nothing is united by an estimate.

A null or wordless text has the empty set, and all such rows are copies of each other. Null and repeated ids are treated as
in :mod:`canticle.llm.simhash`. Repeated rows are one node; of several alike the smallest id stays. Texts are hashed whole, in pieces of ``256`` rows
at a time: a text's set of hashes is in memory, so one of 20 million words takes about 1 GB on the way. Extra columns pass through :func:`keep_one_similar` unchanged, whatever their names.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canticle.llm.components import smallest_reachable, stars
from canticle.llm.simhash import bit_planes, hook, lanes_within, pack_lanes
from canticle.plans.cut import scope, written
from canticle.plans.names import unused

BANDS, ROWS = 32, 5
#: Differing bits of SimHashes at most (four standard errors over the mean at 0.8), pivots of a bucket, and the members that make them worth while.
RADIUS, PIVOTS, PIVOTED = 22, 4, 32
#: Estimates within so many standard errors under the least similarity are verified.
ERRORS = 4.0
_RNG = np.random.default_rng(42)
_FLIP = _RNG.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64)
_ODD = _RNG.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)
_MIX = _RNG.integers(0, 2**64, (BANDS, ROWS), np.uint64) | np.uint64(1)


def shingles(text: str | None, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """The hashes of a text's distinct word shingles in order; a shorter text is one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    size = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(g, seed) for g in map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))), np.uint64))


def set_id(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least mixed hash under each of ``BANDS * ROWS`` mixings."""
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 4096):
        mixed = (hashes[at : at + 4096] ^ _FLIP) * _ODD
        mixed ^= mixed >> np.uint64(32)
        mixed *= _ODD
        np.minimum(low, mixed.min(axis=1), out=low)
    return low ^ (low >> np.uint64(29))


def bands(low: np.ndarray) -> np.ndarray:
    """The bucket keys of a set from its minima."""
    return (low.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64).view(np.int64)


def set_simhash(hashes: np.ndarray) -> int:
    """Bits that over half of a set's hashes have, as a signed 64-bit integer."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *[a.view(np.int64) for a in arrays]])))


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in short pieces: the sets of one piece are in memory at a time."""
    for batch in batches:
        yield from (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def marks(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, fp, n, bits, low, keys): the set's id, size, SimHash, bytes of its minima and bucket keys of each row of (doc_id, text)."""
    names = ["doc_id", "fp", "n", "bits", "low", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = [shingles(t.as_py(), shingle) for t in batch.column(1)]
            lows = [minima(s) for s in sets]
            longs = [pa.array(x, pa.int64()) for x in ([set_id(s) for s in sets], [len(s) for s in sets], [set_simhash(s) for s in sets])]
            keys = lists([bands(m) if len(s) else np.empty(0, np.int64) for s, m in zip(sets, lows, strict=True)])
            low = pa.array([m.astype(np.uint8).tobytes() for m in lows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *longs, low, keys], names=names)

    return docs.mapInArrow(run, "doc_id long, fp long, n long, bits long, low binary, keys array<long>")


def margin(least: float) -> float:
    """How far under the least similarity an estimate may be."""
    return ERRORS * (least * (1 - least) / (BANDS * ROWS)) ** 0.5


def alike(low: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of members a[k] and b[k]: the share of equal minima, less what bytes agree by chance."""
    found = np.empty(len(a))
    for at in range(0, len(a), 1 << 14):
        found[at : at + (1 << 14)] = (low[a[at : at + (1 << 14)]] == low[b[at : at + (1 << 14)]]).mean(axis=1)
    return (found - 1 / 256) / (1 - 1 / 256)


def bucket_pairs(keys: np.ndarray, n: np.ndarray, bits: np.ndarray, low: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members (rows; keys are sorted) that may be similar and that no other pairs join in their bucket."""
    error = margin(least)
    size = np.diff(np.append(np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)), len(keys))) if len(keys) else np.empty(0, np.int64)
    group, root = np.repeat(np.arange(len(size)), size), np.arange(len(keys))
    pivoted = (size > PIVOTED)[group]
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

    def kept(a: np.ndarray, b: np.ndarray, over: float) -> None:
        """Note the pairs that connect members and are alike enough."""
        fit = np.minimum(n[a], n[b]) >= np.maximum(n[a], n[b]) * least
        a, b = a[fit], b[fit]
        fit = alike(low, a, b) >= over
        left.append(a[fit])
        right.append(b[fit])
        hook(root, a[fit], b[fit])

    def apart() -> np.ndarray:
        """Members of the buckets whose members aren't all joined."""
        first, last = (np.full(len(size), fill, np.int64) for fill in (len(keys), -1))
        np.minimum.at(first, group, root)
        np.maximum.at(last, group, root)
        return np.flatnonzero((first < last)[group])

    used = np.zeros(len(keys), bool)
    for _ in range(PIVOTS):
        rows = apart()
        rows = rows[pivoted[rows]]
        # Around a member that nothing joins yet lie those within the radius; the one nearest to their majority is the pivot.
        free = rows[(np.bincount(root, minlength=len(keys))[root[rows]] == 1) & ~used[rows]]
        if not len(free):
            break
        seed = np.full(len(size), -1, np.int64)
        seed[group[free[::-1]]] = free[::-1]
        rows = rows[seed[group[rows]] >= 0]
        near = rows[np.bitwise_count(bits[rows] ^ bits[seed[group[rows]]]) <= RADIUS]
        start = np.flatnonzero(np.diff(group[near], prepend=-1))
        each = np.unpackbits(bits[near].view(np.uint8).reshape(-1, 8), axis=1)
        count = np.diff(np.append(start, len(near)))
        most = np.repeat(2 * np.add.reduceat(each, start, axis=0, dtype=np.int64) > count[:, None], count, axis=0)
        order = np.lexsort(((each != most).sum(axis=1), group[near]))
        pivot = np.full(len(size), -1, np.int64)
        pivot[group[near[start]]] = near[order[start]]
        used[seed[seed >= 0]] = used[pivot[pivot >= 0]] = True
        to = pivot[group[rows]]
        kept(rows[root[rows] != root[to]], to[root[rows] != root[to]], least - error)
    for over in (least + error / 2, least - error):
        rows, shift = apart(), 1
        planes = bit_planes(bits[rows])
        while len(rows) > shift:
            same = group[rows[shift:]] == group[rows[:-shift]]
            if not same.any():
                break
            same &= root[rows[shift:]] != root[rows[:-shift]]
            hits = lanes_within(planes, pack_lanes(same, planes.shape[1]), shift, RADIUS) if same.any() else np.empty(0, np.int64)
            if len(hits):
                kept(rows[hits], rows[hits + shift], over)
            shift += 1
            if shift % 16 == 0 or shift < 4:  # keep the members of buckets that are larger than the shift and not joined yet
                keep = size[group[rows]] > shift
                keep &= np.isin(rows, apart())
                if keep.sum() < 0.7 * len(keep):
                    rows = rows[keep]
                    planes = bit_planes(bits[rows]) if len(rows) else planes
    return np.concatenate(left), np.concatenate(right)


def candidates(shared: DataFrame, least: float, bucket_limit: int) -> DataFrame:
    """(a, b) from (key, fp, n, bits, low): pairs of a bucket whose exact similarity is to be found."""
    sizes = shared.groupBy("key").count().where(F.col("count") > bucket_limit)
    large = written(sizes.select("key", F.ceil(F.col("count") * 2 / bucket_limit).alias("blocks")), "large-buckets")
    block = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks"))
    others = F.when(F.col("blocks").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    spread = shared.join(large, "key", "left").withColumn("other", F.explode(others))
    key = F.when(F.col("blocks").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least(block, "other"), F.greatest(block, "other"))).alias("key")
    spread = spread.select(key, "fp", "n", "bits", "low")

    def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
        low = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
        return [*(batch.column(k).to_numpy() for k in range(4)), low]

    def found(keys: np.ndarray, fps: np.ndarray, *rest: np.ndarray) -> pa.RecordBatch:
        a, b = bucket_pairs(keys, *rest, least)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(fps[a], fps[b])), pa.array(np.maximum(fps[a], fps[b]))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in (x.slice(at, 4096) for x in batches for at in range(0, x.num_rows, 4096)):
            now = columns(batch)
            held = now if held is None else [np.concatenate(pair) for pair in zip(held, now, strict=True)]
            whole = int(np.searchsorted(held[0], held[0][-1]))  # the last key may go on in the next batch
            if whole >= 1 << 12:
                yield found(*(x[:whole] for x in held))
                held = [x[whole:] for x in held]
        if held is not None:
            yield found(*held)

    return spread.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "a long, b long").where("a <> b").distinct()


def sets_of(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(fp, s): the set of each wanted node."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([set_id(shingles(t.as_py(), shingle)) for t in batch.column(0)], pa.int64())
            yield pa.RecordBatch.from_arrays([fps, batch.column(0)], names=["fp", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), lists([shingles(t.as_py(), shingle) for t in batch.column(1)])], names=["fp", "s"])

    rows = docs.select("text").mapInArrow(named, "fp long, text string").join(wanted, "fp", "left_semi")
    return rows.groupBy("fp").agg(F.first("text").alias("text")).mapInArrow(run, "fp long, s array<long>")


def similarity(s: np.ndarray, t: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    if not len(s) or not len(t):
        return float(len(s) == len(t))
    at = np.minimum(np.searchsorted(s, t), len(s) - 1)
    same = int((s[at] == t).sum())
    return same / (len(s) + len(t) - same)


def judged(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) with ``ok``: whether their sets have a similarity of ``least`` or more."""
    left, right = sets.select(F.col("fp").alias("a"), F.col("s").alias("_s")), sets.select(F.col("fp").alias("b"), F.col("s").alias("_t"))
    same = F.size(F.array_intersect("_s", "_t"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", (same / (F.size("_s") + F.size("_t") - same) >= least).alias("ok"))


def crowd_links(root: np.ndarray, block: np.ndarray, n: np.ndarray, bits: np.ndarray, low: np.ndarray, sets: list[np.ndarray], least: float) -> tuple[list[int], list[int]]:
    """Exact links between members of one crowd that aren't united yet (``root``: the smallest member of each one's class). If members are of two
    blocks, those of one block are left to the task that has this block alone."""
    links: tuple[list[int], list[int]] = ([], [])
    order = np.argsort(bits, kind="stable")
    n, bits, low, block = n[order], bits[order], low[order], block[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    root = place[root[order]]
    low_root = np.arange(len(root))
    hook(low_root, np.arange(len(root)), root)
    root, planes, across = low_root, bit_planes(bits), len(np.unique(block)) > 1
    for shift in range(1, len(order)):
        want = root[shift:] != root[:-shift]
        if across:
            want &= block[shift:] != block[:-shift]
        if not want.any():
            continue
        hits = lanes_within(planes, pack_lanes(want, planes.shape[1]), shift, RADIUS)
        a, b = hits, hits + shift
        fit = (np.minimum(n[a], n[b]) >= np.maximum(n[a], n[b]) * least) & (alike(low, a, b) >= least - margin(least))
        for x, y in zip(a[fit].tolist(), b[fit].tolist(), strict=True):
            if root[x] != root[y] and similarity(sets[order[x]], sets[order[y]]) >= least:
                links[0].append(int(order[x]))
                links[1].append(int(order[y]))
                hook(root, np.array([x]), np.array([y]))
    return links


def crowds(tried: DataFrame, nodes: DataFrame, sets: DataFrame, least: float, crowd_limit: int) -> DataFrame:
    """(a, b): the exact links of every crowd with a rejected pair, beyond those in ``tried`` (a, b, ok)."""
    star = stars(tried.select("a", "b"))
    members = written(star.select(F.col("a").alias("fp"), F.col("b").alias("crowd")).union(star.select(F.col("b").alias("fp"), F.col("b").alias("crowd")).distinct()), "crowds")
    bad = tried.where("not ok").select(F.col("a").alias("fp")).distinct()
    again = written(members.join(bad, "fp").select("crowd").distinct(), "crowds-again")
    inside = written(members.join(again, "crowd", "left_semi"), "crowd-members")
    sure = stars(tried.where("ok").join(inside.select(F.col("fp").alias("a")), "a", "left_semi").select("a", "b"))
    sizes = inside.groupBy("crowd").agg(F.ceil(F.count("*") * 2 / crowd_limit).alias("blocks"))
    block = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks"))
    rows = inside.join(sure.select(F.col("a").alias("fp"), F.col("b").alias("class")), "fp", "left").withColumn("class", F.coalesce("class", "fp")).join(sizes, "crowd").withColumn("block", block)
    spread = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    key = F.xxhash64("crowd", F.least("block", "other"), F.greatest("block", "other")).alias("key")
    dealt = spread.select(key, "fp", "class", "block").join(nodes.select("fp", "n", "bits", "low"), "fp").join(sets, "fp").select("key", "fp", "class", "block", "n", "bits", "low", "s")

    def found(rows: list[dict]) -> pa.RecordBatch:
        fps, classes, block, n, bits = (np.array([r[c] for r in rows], np.int64) for c in ("fp", "class", "block", "n", "bits"))
        low = np.frombuffer(b"".join(r["low"] for r in rows), np.uint8).reshape(-1, BANDS * ROWS)
        _, first, of = np.unique(classes, return_index=True, return_inverse=True)
        a, b = crowd_links(first[of], block, n, bits, low, [r["s"].view(np.uint64) for r in rows], least)
        return pa.RecordBatch.from_arrays([pa.array(fps[a], pa.int64()), pa.array(fps[b], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            cols = {name: batch.column(name).to_pylist() for name in ("key", "fp", "class", "block", "n", "bits", "low")}
            for k in range(batch.num_rows):
                row = {c: x[k] for c, x in cols.items()} | {"s": batch.column("s")[k].values.to_numpy()}
                if held and held[0]["key"] != row["key"]:
                    yield found(held)
                    held = []
                held.append(row)
        if held:
            yield found(held)

    return dealt.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "a long, b long")


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, bucket_limit: int = 50_000, crowd_limit: int = 2_048) -> DataFrame:
    """(doc_id, fp, component_id): the shingle set of each row and the smallest id reachable over links."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = written(marks(slim, shingle), "shingle-marks")
    first = [F.first(c).alias(c) for c in ("n", "bits", "low", "keys")]
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("lo"), *first), "shingle-sets")
    with scope(docs.sparkSession):
        dealt = nodes.select("fp", F.explode("keys").alias("key"))
        several = written(dealt.groupBy("key").count().where("count > 1").select("key"), "shared-keys")
        shared = written(dealt.join(several, "key", "left_semi").join(nodes.select("fp", "n", "bits", "low"), "fp").select("key", "fp", "n", "bits", "low"), "buckets")
        pairs = written(candidates(shared, least, bucket_limit), "candidate-pairs", keep=True)
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "candidates")
    sets = written(sets_of(slim, wanted, shingle), "candidate-sets")
    tried = written(judged(pairs, sets, least), "judged-pairs")
    links = tried.where("ok").select("a", "b")
    if not tried.where("not ok").isEmpty():
        links = links.union(written(crowds(tried, nodes, sets, least, crowd_limit), "crowd-links"))
    return marked.select("doc_id", "fp").join(smallest_reachable(links, nodes.select("fp", "lo")), "fp").select("doc_id", "fp", "component_id")


def keep_one_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each group is kept: that with the smallest id.

    Rows without an id can't be named as copies and stay.
    """
    (gone_,) = unused(docs, "gone")
    with scope(docs.sparkSession):
        marked = similar(docs, id_col, text_col, shingle, least)
        gone = written(marked.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(gone_)).distinct(), "copies", keep=True)
    return docs.join(gone, F.col(id_col).cast("long") == F.col(gone_), "left_anti")
