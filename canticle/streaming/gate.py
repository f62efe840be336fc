"""Voice starts of a model that an energy detector must confirm, as keyed state with event-time timers.

Four kinds of events of a key are folded in the order of their time: ``energy`` levels, ``frame`` probabilities of the model, and
the ``start`` and ``end`` of speech that the model tells.

* Energy levels drive :class:`canticle.streaming.detectors.Voice`: whether energy is on, and for how long a burst refuses starts.
* A frame moves the smoothed probability. Frames are counted every ``every`` ms: in a row over the threshold, or none.
* A start in a burst window is refused. It passes at once if the smoothed probability is over the threshold and energy is on; else it is pending.
  Further starts don't renew a pending one.
* A pending start is released by a counted frame, not later than ``wait`` ms after it, when energy is on, no burst is on, the smoothed probability
  is over the threshold and ``frames`` frames in a row were.
* The end of speech cancels a pending start. After ``wait`` ms it is dropped, also where no further event comes: a timer does it.

Events of one time count in the order energy, frame, start, end. On a stream, events wait in state until the watermark has passed them, so the result doesn't
depend on how they are split into batches; events behind the watermark are left out, as Spark does.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from canticle.streaming.detectors import Voice

KINDS = ("energy", "frame", "start", "end")
OUT = "key string, at_ms long, what string"
_STATE = "smooth double, pending long, counted_at long, run int, dropped boolean, on boolean, changed_at double, peak double, peak_at double, muted_until double"


@dataclass
class Gate:
    """What is known of a key. ``pending`` is the time of a waiting start, -1 if there is none; ``dropped``: one was since the last counted frame."""

    smooth: float = 0.0
    pending: int = -1
    counted_at: int = -(1 << 60)
    run: int = 0
    dropped: bool = False
    energy: Voice = field(default_factory=Voice)
    threshold: float = 0.5
    alpha: float = 0.5
    wait: int = 1000
    frames: int = 2
    every: int = 50

    def due(self) -> int | None:
        """When a pending start is dropped."""
        return None if self.pending < 0 else self.pending + self.wait

    def expire(self, now: float) -> list[tuple[int, str]]:
        """Drops a start that is pending for too long at ``now``."""
        if self.pending < 0 or now <= self.due():
            return []
        out = [(self.due(), "dropped")]
        self.pending, self.dropped = -1, True
        return out

    def step(self, at: int, kind: str, level: float) -> list[tuple[int, str]]:
        return self.expire(at) + [(at, what) for what in getattr(self, f"_{kind}")(at, level)]

    def _energy(self, at: int, level: float) -> list[str]:
        self.energy.step(float(at), level)
        return []

    def _start(self, at: int, level: float) -> list[str]:
        if at < self.energy.muted_until:
            return []
        if self.smooth >= self.threshold and self.energy.on:
            return ["start"]
        self.pending = at if self.pending < 0 else self.pending
        return []

    def _end(self, at: int, level: float) -> list[str]:
        self.pending = -1
        return ["stop"]

    def _frame(self, at: int, level: float) -> list[str]:
        self.smooth += self.alpha * (level - self.smooth)
        if at - self.counted_at < self.every:
            return []
        self.counted_at = at
        self.run = self.run + 1 if self.smooth >= self.threshold else 0
        if self.dropped:
            self.run, self.dropped = 0, False
        if self.pending < 0 or not self.energy.on or at < self.energy.muted_until or self.run < self.frames:
            return []
        self.pending, self.run = -1, 0
        return ["start"]

    def state(self) -> tuple:
        v = self.energy
        return self.smooth, self.pending, self.counted_at, self.run, self.dropped, v.on, v.changed_at, v.peak, v.peak_at, v.muted_until

    @classmethod
    def of(cls, state: tuple, **config) -> Gate:
        return cls(*state[:5], Voice(*state[5:]), **config)


def _events(rows: DataFrame, key: str, at: Column, kind: str, level: str) -> DataFrame:
    """(key, at_ms, rank, level); rows of other kinds and without a time are left out."""
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col(kind)).cast("int") - 1
    told = rows.select(*([c for c in ("ts",) if c in rows.columns]), F.col(key).cast("string").alias("key"), at.cast("long").alias("at_ms"), rank.alias("rank"), F.coalesce(F.col(level).cast("double"), F.lit(0.0)).alias("level"))
    return told.where("rank >= 0 and at_ms is not null")


def gate_replayed(rows: DataFrame, key: str = "key", at: str = "at_ms", kind: str = "kind", level: str = "level", **config) -> DataFrame:
    """(key, at_ms, what) of a batch: starts, stops and dropped starts. A key's rows stream by in order; only its state is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, gate = object(), None
        end = float("inf")
        for batch in batches:
            out: list[tuple] = []
            for of, *sample in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if of != now:
                    out += [(now, *x) for x in (gate.expire(end) if gate else [])]
                    now, gate = of, Gate(**config)
                out += [(now, *x) for x in gate.step(sample[0], KINDS[sample[1]], sample[2])]
            yield told(out)
        yield told([(now, *x) for x in (gate.expire(end) if gate else [])])

    def told(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()), strict=True)], names=["key", "at_ms", "what"])

    events = _events(rows, key, F.col(at), kind, level).select("key", "at_ms", "rank", "level")
    return events.repartition("key").sortWithinPartitions("key", "at_ms", "rank", "level").mapInArrow(run, OUT)


class GateProcessor(StatefulProcessor):
    """The gate of one key on a stream: state, events that wait for the watermark, and a timer for whichever comes first."""

    def __init__(self, config: dict):
        self.config = config

    def init(self, handle) -> None:
        self.handle = handle
        self.gate = handle.getValueState("gate", _STATE)
        self.waiting = handle.getListState("waiting", "at_ms long, rank int, level double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        fresh = [(r.at_ms, r.rank, r.level) for r in rows if r.at_ms > passed]
        if fresh:
            self.waiting.appendList(fresh)
            self.handle.registerTimer(min(x[0] for x in fresh))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        gate = Gate.of(tuple(self.gate.get()), **self.config) if self.gate.exists() else Gate(**self.config)
        waiting = sorted(tuple(x) for x in self.waiting.get()) if self.waiting.exists() else []
        ready, rest = [x for x in waiting if x[0] <= passed], [x for x in waiting if x[0] > passed]
        out = [x for at, rank, level in ready for x in gate.step(at, KINDS[rank], level)] + gate.expire(passed)
        self.gate.update(gate.state())
        if ready:
            self.waiting.put(rest) if rest else self.waiting.clear()
        for at in ([rest[0][0]] if rest else []) + ([gate.due() + 1] if gate.due() is not None else []):
            self.handle.registerTimer(at)
        for at, what in out:
            yield Row(key=key[0], at_ms=at, what=what)

    def close(self) -> None:
        pass


def gate_streamed(rows: DataFrame, key: str = "key", at: str = "ts", kind: str = "kind", level: str = "level", late: str = "10 seconds", **config) -> DataFrame:
    """The same over a stream of (key, ts, kind, level). Rows come once the watermark, ``late`` behind the latest time, has passed them. Needs the
    RocksDB state store."""
    events = _events(rows.withColumn("ts", F.col(at)).withWatermark("ts", late), key, F.unix_millis("ts"), kind, level)
    return events.groupBy("key").transformWithState(GateProcessor(config), OUT, "append", "eventTime")
