"""The cache with expiry: rules written a second time as a loop, batch and stream against it."""

import random
from datetime import datetime, timezone

import pytest

from canticle.streaming import cache as C

SCHEMA = "key string, at_ms long, kind string, value string, version int"


def second_loop(events, ttl):
    """A dictionary would do: one entry, one event after the other."""
    out, entry = [], None
    order = {"save": 0, "remove": 1, "load": 2}
    for at, kind, value, version in sorted(events, key=lambda e: (e[0], order[e[1]], (e[2] is not None, e[2] or ""), (e[3] is not None, e[3] or 0))):
        if entry and at > entry["at"] + ttl:
            out.append((entry["at"] + ttl, "expired", None))
            entry = None
        if kind == "save":
            entry = {"at": at, "value": value, "version": version}
        elif kind == "remove":
            entry = None
        elif entry is None:
            out.append((at, "miss", None))
        elif entry["version"] != 1 or not entry["value"]:
            out.append((at, "stale", None))
            entry = None
        else:
            out.append((at, "hit", entry["value"]))
    return out + ([(entry["at"] + ttl, "expired", None)] if entry else [])


def made(seed, n):
    rng = random.Random(seed)
    at = 1  # a stream's first watermark is 0
    out = []
    for _ in range(n):
        at += rng.choice([0, 0, 10, 40, 100, 101, 250])
        kind = rng.choices(C.KINDS, (3, 1, 6))[0]
        out.append((at, kind, rng.choice(["a", "b", "", None]) if kind == "save" else None, rng.choice([1, 1, 1, 0, None]) if kind == "save" else None))
    return out


def told(df):
    return sorted(((r.key, r.at_ms, r.outcome, r.value) for r in df.collect()), key=repr)


def wanted(events, ttl):
    return sorted(((k, *x) for k, own in events.items() for x in second_loop(own, ttl)), key=repr)


def test_batch_equals_the_loop(spark):
    events = {f"k{s}": made(s, 200) for s in range(10)} | {"end": [(0, "save", "v", 1), (100, "load", None, None), (101, "load", None, None)], "twice": [(5, "save", "", 1)] * 2 + [(5, "load", None, None)] * 2}
    rows = spark.createDataFrame([(k, *e) for k, own in events.items() for e in own] + [("k1", None, "load", None, None), ("k1", 7, "other", None, None)], SCHEMA)
    got = told(C.cache_replayed(rows, ttl=100))
    assert got == wanted(events, 100)
    assert {x[2] for x in got} == {"hit", "miss", "stale", "expired"}
    assert [x[1:3] for x in got if x[0] == "end"] == [(100, "expired"), (100, "hit"), (101, "miss")]
    assert told(C.cache_replayed(rows.limit(0), ttl=100)) == []


@pytest.mark.parametrize("batches", [1, 4])
def test_stream_equals_batch_over_any_batching(spark, tmp_path, batches):
    zone = timezone.utc
    events = {k: made(30 + n, 80) for n, k in enumerate("ab")}
    rng = random.Random(batches)
    rows = sorted(((k, *e) for k, own in events.items() for e in own), key=lambda r: r[1] + rng.uniform(0, 900))
    step = -(-len(rows) // batches)
    end = max(r[1] for r in rows)
    parts = [rows[n : n + step] for n in range(0, len(rows), step)] + [[("far", end + n * 60_000, "load", None, None)] for n in (1, 2)]
    for n, part in enumerate(parts):
        stamped = [(k, datetime.fromtimestamp(at / 1000, zone), *rest) for k, at, *rest in part]
        spark.createDataFrame(stamped, SCHEMA.replace("at_ms long", "ts timestamp")).coalesce(1).write.parquet(f"{tmp_path}/in/{n:03d}.parquet")
    stream = spark.readStream.schema(SCHEMA.replace("at_ms long", "ts timestamp")).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = C.cache_streamed(stream, ttl=100, late="1 second").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(240)
        assert query.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert told(spark.read.parquet(f"{tmp_path}/out").where("key <> 'far'")) == wanted(events, 100)
