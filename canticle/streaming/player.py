"""Playback of lines from a log of player events: positions as a fold, lines and their changes by a join and windows.

Events of a player (key, song_id) are ``play``, ``pause``, ``seek`` (value: seconds), ``reset`` and ``tick`` (value: speed, null is 1).

* ``play`` starts a song that is ready or completed at its first line, and goes on with a paused one.
* A tick moves a playing song by the time since the tick (or the start) before, times its speed; no time at all, or ``longest`` ms and more, are ignored. At the song's
  duration it is completed.
* ``seek`` on a ready song pauses it there; on a completed one it does nothing. ``reset`` makes it ready.

A line is the last one that has started (before all: the first). A tick tells of a line that isn't the one told of before; a start counts as told of the first
line, a continuation and a seek of the line they are at. Events of one time count in the order reset, seek, play, tick, pause, then by value (nulls first). Rows of other
kinds, without a time, or of songs without lines are left out. A player's events are folded in one task, which holds its state alone; lines never pass through Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canticle.plans.cut import written

KINDS = ("reset", "seek", "play", "tick", "pause")
FOLDED = "key string, song_id string, n long, at_ms long, state string, time_s double, told string"


@dataclass
class Player:
    """``told`` of a step: the line that it counts as having told of (``first``, or ``here``: the one at its time), or ``tick`` where a line may be told."""

    state: str = "ready"
    time: float = 0.0
    ticked_at: int = 0
    longest: int = 500

    def step(self, at: int, kind: str, value: float | None, first: float, duration: float) -> str | None:
        if kind == "reset":
            self.state = "ready"
        elif kind == "seek" and self.state != "completed":
            self.state = "paused" if self.state == "ready" else self.state
            self.time = value or 0.0
            return "here"
        elif kind == "pause" and self.state == "playing":
            self.state = "paused"
        elif kind == "play" and self.state != "playing":
            told = "here" if self.state == "paused" else "first"
            self.time = self.time if self.state == "paused" else first
            self.state, self.ticked_at = "playing", at
            return told
        elif kind == "tick" and self.state == "playing":
            gap, self.ticked_at = at - self.ticked_at, at
            if not 0 < gap < self.longest:
                return None
            self.time += gap / 1000 * (1.0 if value is None else value)
            if self.time < duration:
                return "tick"
            self.state = "completed"
        return None


def positions(events: DataFrame, songs: DataFrame, key: str = "key", longest: int = 500) -> DataFrame:
    """(key, song_id, n, at_ms, state, time_s, told): the player after each event, the ``n``-th of it. ``songs`` has (song_id, first_s, duration_s)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, player, n = None, Player(longest=longest), 0
        for batch in batches:
            out: list[tuple] = []
            for of, song, at, rank, value, first, duration in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if (of, song) != now:
                    now, player, n = (of, song), Player(longest=longest), 0
                told = player.step(at, KINDS[rank], value, first, duration)
                out.append((of, song, n, at, player.state, player.time, told))
                n += 1
            names = [field.split()[0] for field in FOLDED.split(", ")]
            types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string())
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    rows = events.select(F.col(key).cast("string").alias("key"), F.col("song_id").cast("string").alias("song_id"), F.col("at_ms").cast("long").alias("at_ms"), rank.alias("rank"), F.col("value").cast("double").alias("value"))
    rows = rows.where("rank >= 0 and at_ms is not null").join(songs.select(F.col("song_id").cast("string").alias("song_id"), "first_s", "duration_s"), "song_id")
    rows = rows.select("key", "song_id", "at_ms", "rank", "value", F.col("first_s").cast("double"), F.col("duration_s").cast("double"))
    return rows.repartition("key", "song_id").sortWithinPartitions("key", "song_id", "at_ms", "rank", "value").mapInArrow(run, FOLDED)


def _bucket(at: Column) -> Column:
    """The bucket of a time in a song with columns first_s, last_s, scale and n: null before the first line, ``n`` from the last one on. A later time has no smaller one."""
    inside = F.least(F.col("n") - 1, F.floor((at - F.col("first_s")) * F.col("scale")))
    return F.when(at >= F.col("last_s"), F.col("n")).when(at >= F.col("first_s"), inside)


def line_places(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where to look for a line: songs (song_id, first_s, last_s, n, scale), cut into as many buckets of time as they have different starts, and
    (song_id, bucket, before, inside) of all buckets: the lines before it, and its starts, each with the lines up to it."""
    each = lines.where("start_s is not null").groupBy(F.col("song_id").cast("string").alias("song_id"), F.col("start_s").cast("double").alias("start_s")).agg(F.count("*").alias("lines"))
    spans = each.groupBy("song_id").agg(F.min("start_s").alias("first_s"), F.max("start_s").alias("last_s"), F.count("*").alias("n"))
    spans = spans.withColumn("scale", F.when(F.col("n") > 1, F.try_divide(F.col("n").cast("double"), F.col("last_s") - F.col("first_s"))))
    upto = F.sum("lines").over(Window.partitionBy("song_id").orderBy("start_s").rowsBetween(Window.unboundedPreceding, 0))
    placed = each.withColumn("upto", upto).join(spans, "song_id").withColumn("bucket", _bucket(F.col("start_s")))
    full = placed.groupBy("song_id", "bucket").agg(F.collect_list(F.struct("start_s", "upto")).alias("inside"), F.max("upto").alias("upto"))
    order = Window.partitionBy("song_id").orderBy("bucket")
    until = F.coalesce(F.lead("bucket").over(order) - 1, F.col("bucket"))
    full = full.withColumns({"before": F.coalesce(F.lag("upto").over(order), F.lit(0)), "until": until})
    all_ = full.select("song_id", F.col("bucket").alias("from"), F.explode(F.sequence("bucket", "until")).alias("bucket"), "before", "upto", "inside")
    own = F.col("bucket") == F.col("from")
    return spans, all_.select("song_id", "bucket", F.when(own, F.col("before")).otherwise(F.col("upto")).alias("before"), F.when(own, F.col("inside")).alias("inside"))


def line_changes(events: DataFrame, lines: DataFrame, durations: DataFrame, key: str = "key", longest: int = 500) -> DataFrame:
    """(key, song_id, at_ms, line_idx, time_s) of the lines told. ``lines`` has (song_id, start_s) of every line, ``durations`` (song_id, duration_s).
    An event meets the starts of its bucket of its song (:func:`line_places`), not all of the song's."""
    spans, places = line_places(lines)
    spans, places = written(spans, "spans"), written(places, "places")
    songs = spans.join(durations.select(F.col("song_id").cast("string").alias("song_id"), "duration_s"), "song_id").select("song_id", "first_s", "duration_s")
    at = positions(events, songs, key, longest).where("told is not null").withColumnRenamed("n", "nth").join(spans, "song_id").withColumn("bucket", _bucket(F.col("time_s")))
    at = at.join(places, ["song_id", "bucket"], "left")
    started = F.array_max(F.transform(F.filter("inside", lambda s: s["start_s"] <= F.col("time_s")), lambda s: s["upto"]))
    here = F.greatest(F.lit(0), F.coalesce(started, F.col("before"), F.lit(0)) - 1).cast("int")
    lined = at.select("key", "song_id", "nth", "at_ms", "time_s", "told", F.when(F.col("told") == "first", 0).otherwise(here).alias("line_idx"))
    before = F.lag("line_idx").over(Window.partitionBy("key", "song_id").orderBy("nth"))
    changed = lined.withColumn("before", before).where("told = 'tick' and line_idx <> before")
    return changed.select("key", "song_id", "at_ms", "line_idx", F.round("time_s", 6).alias("time_s"))
