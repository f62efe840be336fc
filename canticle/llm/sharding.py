"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``vnodes`` places on a ring; a key belongs to the arc that ends at the next place clockwise. Rows are
counted by arc (a table bounded by the ring), and the driver walks the arcs once: an arc's rows fill its own
shard up to capacity, and what overflows continues clockwise to the next shards with room. Each arc thus gets a few
ranges of ranks, each with a shard and a first slot. Rows take their rank within their arc by their place on the ring. Ranks
are counted in cells of the ring of about ``CELL_ROWS`` rows, plus the rows of the arc's cells before; so tasks don't
grow with the table.

Capacity is (1 + epsilon) times the mean, and at epsilon 0 the exact share, so counts differ by one at most. With room
to spare, growth by a shard moves about its share of rows; at epsilon 0 some rows more move along the ring.

Defined results: rows without a key are placed by the hash of their text and of their whole row. Repeated keys lie on one arc and
get slots of their own. A null text has size 1. Empty tables give empty results. Extra columns pass unchanged, whatever their
names; only ``shard`` and ``slot`` are replaced.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canticle.plans.cut import written
from canticle.plans.names import restored, whole_row

SHARDS, VNODES = 16, 128
#: Rows of a cell in the mean, and the most cells of the ring.
CELL_ROWS, CELLS = 20_000, 1 << 18
#: Hex digits of an MD5 that make a place on the ring.
DIGITS = 15


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(place, shard) in clockwise order."""
    place = lambda s, v: int(hashlib.md5(f"{s}/{v}".encode()).hexdigest()[:DIGITS], 16)
    return sorted((place(s, v), s) for s in range(shards) for v in range(vnodes))


def capacities(rows: int, shards: int, epsilon: float) -> list[int]:
    if epsilon > 0:
        return [int(np.ceil((1 + epsilon) * rows / shards))] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def walk(owners: list[int], loads: dict[int, int], capacity: list[int]) -> list[tuple[int, int, int, int]]:
    """(arc, first rank, shard, first slot): each arc's rows go to its shard and, past capacity, on clockwise."""
    filled = [0] * len(capacity)
    out = []
    for arc in sorted(loads):
        rank, left, at = 0, loads[arc], arc
        while left:
            shard = owners[at % len(owners)]
            some = min(left, capacity[shard] - filled[shard])
            if some:
                out.append((arc, rank, shard, filled[shard]))
                filled[shard] += some
                rank += some
                left -= some
            at += 1
    return out


def sharded(rows: DataFrame, key: str, shards: int = SHARDS, vnodes: int = VNODES, epsilon: float = 0.0) -> DataFrame:
    """``rows`` with ``shard`` and ``slot`` (gapless from 0 in each shard). ``key`` names a string column without nulls."""
    nodes = ring(shards, vnodes)
    places = np.array([p for p, _ in nodes], np.int64)

    @F.pandas_udf("int")
    def arc_of(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(places, place.to_numpy()) % len(places))

    place = F.conv(F.substring(F.md5(F.col(key)), 1, DIGITS), 16, 10).cast("long")
    dealt = rows.select(whole_row(rows).alias("_row"), place.alias("_place"), F.col(key).alias("_key"))
    dealt = written(dealt.withColumn("_arc", arc_of("_place")), "arcs")
    cells = min(CELLS, max(1, dealt.count() // CELL_ROWS))
    width = (1 << 4 * DIGITS) // cells + 1
    celled = dealt.withColumn("_cell", F.floor(F.col("_place") / F.lit(width)).cast("int"))
    # At most shards * vnodes + CELLS rows. The first arc also holds the places after the last node: they count as its last cells.
    sizes = sorted((r["_arc"], r["_cell"], r["count"]) for r in celled.groupBy("_arc", "_cell").count().collect())
    loads, first = Counter(), []
    for arc, cell, n in sizes:
        first.append((arc, cell, loads[arc]))
        loads[arc] += n
    plan = walk([s for _, s in nodes], loads, capacities(sum(loads.values()), shards, epsilon))
    ranges = np.array(plan, np.int64).reshape(-1, 4)
    starts = (ranges[:, 0] << 40) + ranges[:, 1]
    bases = np.array(first, np.int64).reshape(-1, 3)
    cell_keys = (bases[:, 0] << 32) + bases[:, 1]

    @F.pandas_udf("shard int, slot long")
    def placed(arc: pd.Series, cell: pd.Series, within: pd.Series) -> pd.DataFrame:
        arcs = arc.to_numpy().astype(np.int64)
        rank = bases[np.searchsorted(cell_keys, (arcs << 32) + cell.to_numpy()), 2] + within.to_numpy()
        at = np.searchsorted(starts, (arcs << 40) + rank, "right") - 1
        return pd.DataFrame({"shard": ranges[at, 2], "slot": ranges[at, 3] + rank - ranges[at, 1]})

    rank = F.row_number().over(Window.partitionBy("_arc", "_cell").orderBy("_place", "_key", F.xxhash64("_row"))).cast("long") - 1
    out = celled.withColumn("_rank", rank).withColumn("_at", placed("_arc", "_cell", "_rank"))
    return out.select(*restored(rows.drop("shard", "slot"), "_row"), F.col("_at.shard").alias("shard"), F.col("_at.slot").alias("slot"))


def op2_bounded_ring(spark, sf_dir):
    """Contract query 2: shard and slot of every document, by the law ``rows``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text/"), F.md5(text), F.lit("/"), F.xxhash64(F.struct(*docs.columns)).cast("string"))).alias("_key"),
    )
    found = sharded(slim, "_key")
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
