"""The confirmed gate: hand cases, the rules written a second time as a loop, and the stream against the batch over any batching."""

import random
from datetime import datetime, timezone

import pytest

from canticle.streaming import gate as G

RANK = {k: n for n, k in enumerate(G.KINDS)}


def second_loop(events, wait=1000):
    """The rules once more: plain variables, one event after the other."""
    out, smooth, pending, counted, high, spoiled = [], 0.0, None, None, 0, False
    on, changed, peak, peak_at, burst = False, 0.0, 0.0, 0.0, 0.0
    for at, kind, level in sorted(events, key=lambda e: (e[0], RANK[e[1]], e[2])):
        if pending is not None and at - pending > wait:
            out.append((pending + wait, "dropped"))
            pending, spoiled = None, True
        if kind == "energy":
            if at - peak_at > 500 or level > peak * 0.9:
                peak, peak_at = level, at
            elif at - peak_at >= 120 and peak > 0.35 and peak - level > 0.18:
                burst, peak, peak_at = at + 500, 0.0, at
            if at - changed > 150:
                if not on and level > 0.16 and not at < burst:
                    on, changed = True, at
                elif on and level < 0.09:
                    on, changed = False, at
        elif kind == "start" and not at < burst:
            if smooth >= 0.5 and on:
                out.append((at, "start"))
            elif pending is None:
                pending = at
        elif kind == "end":
            pending = None
            out.append((at, "stop"))
        elif kind == "frame":
            smooth = smooth * 0.5 + level * 0.5
            if counted is None or at - counted >= 50:
                counted = at
                high = 0 if smooth < 0.5 or spoiled else high + 1
                spoiled = False
                if pending is not None and on and not at < burst and high >= 2:
                    out.append((at, "start"))
                    pending, high = None, 0
    return out + ([(pending + wait, "dropped")] if pending is not None else [])


def frames(*times, p=0.9):
    return [(t, "frame", p) for t in times]


def run(spark, events):
    rows = spark.createDataFrame([("a", *e) for e in events], "key string, at_ms long, kind string, level double")
    return [(r.at_ms, r.what) for r in G.gate_replayed(rows).collect()]


def test_hand_cases(spark):
    loud = [(200, "energy", 0.3)]
    high = frames(*range(0, 500, 50))
    cases = {
        "at once": (loud + high + [(460, "start", 0.0)], [(460, "start")]),
        "no energy": (high + [(460, "start", 0.0)], [(1460, "dropped")]),
        "energy later": (high + [(460, "start", 0.0), (700, "energy", 0.3)] + frames(750), [(750, "start")]),
        "end cancels": (high + [(460, "start", 0.0), (500, "end", 0.0), (700, "energy", 0.3)] + frames(750, 800), [(500, "stop")]),
        "too late": (high + [(460, "start", 0.0), (1461, "energy", 0.3)] + frames(1500, 1550), [(1460, "dropped")]),
        "just in time": (high + [(460, "start", 0.0), (1400, "energy", 0.3)] + frames(1460), [(1460, "start")]),
        "not renewed": (high + [(460, "start", 0.0), (900, "start", 0.0), (1461, "energy", 0.3)] + frames(1470), [(1460, "dropped")]),
        "after an end a new one": (high + [(460, "start", 0.0), (500, "end", 0.0), (900, "start", 0.0), (1461, "energy", 0.3)] + frames(1470), [(500, "stop"), (1470, "start")]),
        "burst": ([(0, "energy", 0.2), (200, "energy", 0.9), (330, "energy", 0.5)] + high + [(460, "start", 0.0)], []),
        "burst holds a pending one": ([(160, "energy", 0.9)] + [(170, "start", 0.0), (300, "energy", 0.3)] + frames(310, 400, 500, 810), [(810, "start")]),
    }
    for name, (events, want) in cases.items():
        assert run(spark, events) == want, name
        assert second_loop(events) == want, name


def made(seed, n):
    rng = random.Random(seed)
    out, at = [], 0
    for _ in range(n):
        at += rng.choice([0, 10, 30, 50, 60, 200, 700])
        kind = rng.choices(G.KINDS, (4, 8, 2, 1))[0]
        out.append((at, kind, rng.choice([0.05, 0.2, 0.4, 0.8, 0.95])))
    return out


def test_batch_equals_the_second_loop(spark):
    events = {f"k{s}": made(s, 300) for s in range(12)}
    rows = spark.createDataFrame([(k, *e) for k, own in events.items() for e in own], "key string, at_ms long, kind string, level double")
    got = sorted((r.key, r.at_ms, r.what) for r in G.gate_replayed(rows).collect())
    assert got == sorted((k, *x) for k, own in events.items() for x in second_loop(own))
    assert {x[2] for x in got} == {"start", "stop", "dropped"}


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


@pytest.mark.parametrize("batches", [1, 5])
def test_stream_equals_batch_over_any_batching(spark, rocks, tmp_path, batches):
    """Rows are shuffled within what the watermark allows; one row of each key comes far too late."""
    zone = timezone.utc
    events = {k: made(40 + n, 120) for n, k in enumerate("ab")}
    rng = random.Random(batches)
    rows = sorted(((k, *e) for k, own in events.items() for e in own), key=lambda r: r[1] + rng.uniform(0, 900))
    step = -(-len(rows) // batches)
    parts = [rows[n : n + step] for n in range(0, len(rows), step)]
    end = max(r[1] for r in rows)
    if batches > 1:
        parts.append([("a", 0, "end", 0.0), ("b", 1, "start", 0.0)])  # behind the watermark by now
    parts.append([("far", end + 60_000, "end", 0.0)])
    parts.append([("far", end + 120_000, "end", 0.0)])
    for n, part in enumerate(parts):
        stamped = [(k, datetime.fromtimestamp(at / 1000, zone), kind, level) for k, at, kind, level in part]
        spark.createDataFrame(stamped, "key string, ts timestamp, kind string, level double").coalesce(1).write.parquet(f"{tmp_path}/in/{n:03d}.parquet")
    stream = spark.readStream.schema("key string, ts timestamp, kind string, level double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = G.gate_streamed(stream, late="1 second").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    got = sorted((r.key, r.at_ms, r.what) for r in spark.read.parquet(f"{tmp_path}/out").where("key <> 'far'").collect())
    assert got == sorted((k, *x) for k, own in events.items() for x in second_loop(own))
