"""Playback against its rules written a second time with a list of lines."""

import random

from pyspark.sql import functions as F

from canticle.streaming import player as P

LINES = {"1": [1.0, 1.5, 1.5, 3.0], "2": [0.0], "3": [0.2, 0.4, 0.9, 1.1, 2.0, 2.05]}
LENGTH = {"1": 4.0, "2": 1.0, "3": 2.2}


def second_loop(events, lines, length):
    order = {k: n for n, k in enumerate(("reset", "seek", "play", "tick", "pause"))}
    out, mode, time, told, last = [], "ready", 0.0, -1, 0

    def line():
        index = 0
        for i, start in enumerate(lines):
            if time < start:
                break
            index = i
        return index

    for at, kind, value in sorted(events, key=lambda e: (e[0], order[e[1]], e[2] is not None, e[2] or 0)):
        if kind == "reset":
            mode = "ready"
        if kind == "seek" and mode in ("ready", "paused", "playing"):
            mode, time = "playing" if mode == "playing" else "paused", value or 0.0
            told = line()
        if kind == "pause" and mode == "playing":
            mode = "paused"
        if kind == "play" and mode in ("ready", "completed"):
            mode, time, told, last = "playing", lines[0], 0, at
        elif kind == "play" and mode == "paused":
            mode, told, last = "playing", line(), at
        if kind == "tick" and mode == "playing":
            gap, last = at - last, at
            if 0 < gap < 500:
                time += gap / 1000 * (1.0 if value is None else value)
                if time >= length:
                    mode = "completed"
                elif line() != told:
                    told = line()
                    out.append((at, told, round(time, 6)))
    return out


def made(seed, n):
    rng = random.Random(seed)
    out, at = [], 0
    for _ in range(n):
        at += rng.choice([0, 30, 100, 200, 499, 500])
        kind = rng.choices(P.KINDS, (1, 2, 5, 30, 2))[0]
        out.append((at, kind, rng.choice([0.1, 1.2, 1.6, 2.1, 9.0, None]) if kind == "seek" else rng.choice([None, 1.0, 2.0]) if kind == "tick" else None))
    return out


def changes(spark, events):
    rows = spark.createDataFrame([(k, s, *e) for (k, s), own in events.items() for e in own], "key string, song_id string, at_ms long, kind string, value double")
    lines = spark.createDataFrame([(s, x) for s, own in LINES.items() for x in own] + [("1", None)], "song_id string, start_s double")
    lengths = spark.createDataFrame(list(LENGTH.items()), "song_id string, duration_s double")
    return sorted((r.key, r.song_id, r.at_ms, r.line_idx, r.time_s) for r in P.line_changes(rows, lines, lengths).collect())


def test_line_changes_equal_the_loop(spark):
    events = {(f"k{n}", song): made(10 * n + int(song), 300) for n in range(6) for song in LINES}
    want = sorted((k, s, *x) for (k, s), own in events.items() for x in second_loop(own, LINES[s], LENGTH[s]))
    assert changes(spark, {**events, ("k0", "none"): made(1, 5)}) == want and len(want) > 50
    # by hand: starts at 1.0, the line at 1.5 (the later of two) after two ticks, none told again after a pause, a restart after the end
    hand = [(0, "play", None), (300, "tick", None), (600, "tick", None), (700, "pause", None), (800, "play", None), (900, "tick", None), (1300, "tick", 9.0), (1400, "play", None), (1800, "tick", 1.5)]
    assert changes(spark, {("h", "1"): hand}) == [("h", "1", 600, 2, 1.6), ("h", "1", 1800, 2, 1.6)]
    assert changes(spark, {("h", "1"): [(0, "play", None), (600, "tick", None), (None, "tick", None), (650, "other", None)]}) == []


def test_positions_hold_no_lines(spark):
    songs = spark.createDataFrame([("1", 1.0, 4.0)], "song_id string, first_s double, duration_s double")
    rows = spark.createDataFrame([("a", "1", 0, "play", None), ("a", "1", 400, "tick", None)], "key string, song_id string, at_ms long, kind string, value double")
    assert [(r.n, r.state, round(r.time_s, 6), r.told) for r in P.positions(rows, songs).orderBy("n").collect()] == [(0, "playing", 1.0, "first"), (1, "playing", 1.4, "tick")]
    assert P.positions(rows.where(F.lit(False)), songs).count() == 0


def test_events_meet_few_of_many_lines(spark):
    starts = [0.5 * k for k in range(2000)] + [7.25, 7.25, 7.25, 5000.0]
    lines = spark.createDataFrame([("1", x) for x in starts], "song_id string, start_s double")
    spans, places = P.line_places(lines)
    assert [(r.n, r.first_s, r.last_s) for r in spans.collect()] == [(2002, 0.0, 5000.0)]
    found = places.select("bucket", "before", F.coalesce(F.size("inside"), F.lit(0)).alias("size")).orderBy("bucket").collect()
    assert [r.bucket for r in found] == list(range(2003)) and found[-1].before == 2003 and max(r["size"] for r in found) < 10
    rows = spark.createDataFrame([("a", "1", at, kind, value) for at, kind, value in ((0, "seek", 7.0), (1, "play", None), (300, "tick", 1.0), (700, "tick", 9000.0), (800, "pause", None), (801, "seek", 1200.0), (802, "play", None), (900, "tick", 50000.0))], "key string, song_id string, at_ms long, kind string, value double")
    lengths = spark.createDataFrame([("1", 9000.0)], "song_id string, duration_s double")
    got = [(r.at_ms, r.line_idx) for r in P.line_changes(rows, lines, lengths).orderBy("at_ms").collect()]
    time, want = 7.0, []
    for at, gap, speed in ((300, 299, 1.0), (700, 400, 9000.0)):
        time += gap / 1000 * speed
        want.append((at, sum(s <= time for s in starts) - 1))
    assert got == [*want, (900, sum(s <= 1200.0 + 0.098 * 50000 for s in starts) - 1)]
