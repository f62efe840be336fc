"""A cache of keyed entries with expiry, as keyed state with event-time timers.

Three kinds of events of a key: ``save`` keeps a value with the version of its format, ``remove`` drops it, ``load`` asks for it. What is told:

* ``hit`` with the value, for a load not later than ``ttl`` ms after the save;
* ``stale`` for a load of an entry whose version isn't the current one or whose value is null or empty; the entry is dropped;
* ``miss`` for a load where nothing is kept;
* ``expired`` at the last moment of an entry that nothing replaced, removed or dropped until then.

Events of one time count in the order save, remove, load, then by value and version (nulls first). Rows of other kinds or without a time are left out. The
events of a key are ordered in one task. On a stream they wait in state until the watermark has passed them, so the result doesn't depend on how they are split
into batches, and a timer frees entries at their end; rows not after the watermark (0 at first) are left out, as Spark does.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

KINDS = ("save", "remove", "load")
TTL = 7 * 24 * 3600 * 1000
OUT = "key string, at_ms long, outcome string, value string"


def _events(rows: DataFrame, key: str, at: Column, kind: str, value: str, version: str) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col(kind)).cast("int") - 1
    told = rows.select(*([c for c in ("ts",) if c in rows.columns]), F.col(key).cast("string").alias("key"), at.cast("long").alias("at_ms"), rank.alias("rank"), F.col(value).cast("string").alias("value"), F.col(version).cast("int").alias("version"))
    return told.where("rank >= 0 and at_ms is not null")


def cache_replayed(rows: DataFrame, key: str = "key", at: str = "at_ms", kind: str = "kind", value: str = "value", version: str = "version", ttl: int = TTL, current: int = 1) -> DataFrame:
    """(key, at_ms, outcome, value) of a batch, by windows alone. Time goes on after the last event, so every entry ends."""
    events = _events(rows, key, F.col(at), kind, value, version)
    before = Window.partitionBy("key").orderBy("at_ms", "rank", "value", "version").rowsBetween(Window.unboundedPreceding, 0)
    numbered = events.withColumn("n", F.count_if(F.col("rank") < 2).over(before))  # the write that a row follows
    own = Window.partitionBy("key", "n")
    of_save = {c: F.max(F.when(F.col("rank") == 0, F.col(c))) for c in ("at_ms", "value", "version")}
    good = F.col("_version").eqNullSafe(F.lit(current)) & (F.coalesce("_value", F.lit("")) != "")

    loads = numbered.withColumns({f"_{c}": x.over(own) for c, x in of_save.items()}).where("rank = 2")
    loads = loads.withColumn("nth", F.row_number().over(own.orderBy("at_ms")))
    alive = F.coalesce(F.col("at_ms") - F.col("_at_ms") <= ttl, F.lit(False))
    outcome = F.when(alive & good, "hit").when(alive & (F.col("nth") == 1), "stale").otherwise("miss")
    told = loads.select("key", "at_ms", outcome.alias("outcome"), F.when(alive & good, F.col("_value")).alias("value"))

    first_load = F.min(F.when(F.col("rank") == 2, F.col("at_ms"))).alias("load")
    entries = numbered.groupBy("key", "n").agg(F.min("at_ms").alias("start"), first_load, *[x.alias(f"_{c}") for c, x in of_save.items()])
    entries = entries.withColumns({"next": F.lead("start").over(Window.partitionBy("key").orderBy("n")), "end": F.col("_at_ms") + ttl})
    dropped = F.coalesce(F.col("load") <= F.col("end"), F.lit(False)) & ~good
    ended = entries.where(F.col("end").isNotNull() & (F.col("next").isNull() | (F.col("next") > F.col("end"))) & ~dropped)
    return told.unionByName(ended.select("key", F.col("end").alias("at_ms"), F.lit("expired").alias("outcome"), F.lit(None).cast("string").alias("value")))


class CacheProcessor(StatefulProcessor):
    """The entry of one key, events that wait for the watermark, and a timer for the next event or the entry's end."""

    def __init__(self, ttl: int, current: int):
        self.ttl, self.current = ttl, current

    def init(self, handle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "saved_at long, value string, version int")
        self.waiting = handle.getListState("waiting", "at_ms long, rank int, value string, version int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        fresh = [(r.at_ms, r.rank, r.value, r.version) for r in rows if r.at_ms > passed]
        if fresh:
            self.waiting.appendList(fresh)
            self.handle.registerTimer(min(x[0] for x in fresh))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = sorted((tuple(x) for x in self.waiting.get()), key=lambda x: (x[0], x[1], x[2] is not None, x[2] or "", x[3] is not None, x[3] or 0)) if self.waiting.exists() else []
        ready, rest = [x for x in waiting if x[0] <= passed], [x for x in waiting if x[0] > passed]
        entry = tuple(self.entry.get()) if self.entry.exists() else None
        for at, rank, value, version in [*ready, (passed + 1, None, None, None)]:
            if entry and at > entry[0] + self.ttl:
                yield Row(key=key[0], at_ms=entry[0] + self.ttl, outcome="expired", value=None)
                entry = None
            if rank == 2:
                good = entry is not None and entry[2] == self.current and bool(entry[1])
                yield Row(key=key[0], at_ms=at, outcome="hit" if good else "stale" if entry else "miss", value=entry[1] if good else None)
                entry = entry if good else None
            elif rank is not None:
                entry = (at, value, version) if rank == 0 else None
        self.entry.update(entry) if entry else self.entry.clear()
        if ready:
            self.waiting.put(rest) if rest else self.waiting.clear()
        for at in ([rest[0][0]] if rest else []) + ([entry[0] + self.ttl + 1] if entry else []):
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def cache_streamed(rows: DataFrame, key: str = "key", at: str = "ts", kind: str = "kind", value: str = "value", version: str = "version", ttl: int = TTL, current: int = 1, late: str = "10 seconds") -> DataFrame:
    """The same over a stream. Rows come once the watermark, ``late`` behind the latest time, has passed them. Needs the RocksDB state store."""
    events = _events(rows.withColumn("ts", F.col(at)).withWatermark("ts", late), key, F.unix_millis("ts"), kind, value, version)
    return events.groupBy("key").transformWithState(CacheProcessor(ttl, current), OUT, "append", "eventTime")
