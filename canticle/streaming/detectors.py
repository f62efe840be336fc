"""Per-key detectors over ordered samples: the same folds run on streams (state kept by Spark) and on batches.

Structured Streaming gives no order inside a batch, so each handler sorts its rows by time before folding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, astuple, dataclass, fields

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass
class Trigger:
    """Smoothed probability with hold time, hysteresis and cooldown; speech blocks the hold."""

    phase: str = "idle"
    smooth: float = 0.0
    since: float = -1.0
    fired_at: float = -1.0

    def step(self, at: float, p: float, speech: float = 0.0, *, alpha=0.2, start=0.9, stop=0.6, hold=400.0, cooldown=1500.0, speech_max=1.0) -> bool:
        self.smooth += alpha * (p - self.smooth)
        if self.phase == "cooldown":
            if at - self.fired_at < cooldown:
                return False
            self.phase = "triggered" if self.smooth >= stop else "idle"
        if self.phase == "triggered":
            if self.smooth < stop:
                self.phase = "idle"
            return False
        if self.smooth < start or speech > speech_max:
            self.phase = "idle"
            return False
        if self.phase == "idle":
            self.phase, self.since = "holding", at
        if at - self.since < hold:
            return False
        self.phase, self.fired_at = "cooldown", at
        return True


@dataclass
class Voice:
    """Two thresholds with a least time between changes; a fast decay from a high peak mutes starts for a while."""

    on: bool = False
    changed_at: float = 0.0
    peak: float = 0.0
    peak_at: float = 0.0
    muted_until: float = 0.0

    def step(self, at: float, level: float, speech: float = 0.0, *, high=0.16, low=0.09, hold=150.0, burst_peak=0.35, burst_decay=0.18, burst_mute=500.0) -> bool:
        age = at - self.peak_at
        if age > 500 or level > 0.9 * self.peak:
            self.peak, self.peak_at = level, at
        elif age >= 120 and self.peak > burst_peak and self.peak - level > burst_decay:
            self.peak, self.peak_at, self.muted_until = 0.0, at, at + burst_mute
        was = self.on
        if at - self.changed_at > hold:
            if not self.on and level > high and at >= self.muted_until:
                self.on, self.changed_at = True, at
            elif self.on and level < low:
                self.on, self.changed_at = False, at
        return self.on and not was


@dataclass
class Noise:
    """Energy that stays over a level for a while."""

    since: float = -1.0
    told: bool = False

    def step(self, at: float, level: float, speech: float = 0.0, *, over=0.15, lasting=3000.0) -> bool:
        if level <= over:
            self.since, self.told = -1.0, False
            return False
        self.since = at if self.since < 0 else self.since
        fire = not self.told and at - self.since >= lasting
        self.told |= fire
        return fire


@dataclass
class Throttle:
    """Lets a sample through if none was let through in the last ``every`` ms."""

    passed_at: float = -1e300

    def step(self, at: float, level: float, speech: float = 0.0, *, every=500.0) -> bool:
        fire = at - self.passed_at >= every
        if fire:
            self.passed_at = at
        return fire


@dataclass
class Clock:
    """A playback clock: steps of half a second or more are ignored; it stops at the duration."""

    position: float = 0.0
    last_at: float = -1.0

    def step(self, at: float, speed: float, speech: float = 0.0, *, duration=600.0) -> bool:
        gap = (at - self.last_at) / 1000 if self.last_at >= 0 else 0.0
        self.last_at = at
        before = self.position
        if 0 <= gap < 0.5:
            self.position = min(duration, before + gap * speed)
        return before < duration <= self.position


OUT = "key string, at_ms double, fired boolean, state string"
KINDS = {str: "string", bool: "boolean", float: "double", "str": "string", "bool": "boolean", "float": "double"}


def state_schema(machine: type) -> str:
    return ", ".join(f"{f.name} {KINDS[f.type]}" for f in fields(machine))


def folded(key: str, rows: pd.DataFrame, machine, **config) -> pd.DataFrame:
    out = []
    for at, level, speech in rows.sort_values(["at_ms", "level"])[["at_ms", "level", "speech"]].itertuples(index=False):
        fired = machine.step(at, level, speech, **config)
        out.append((key, at, bool(fired), str(asdict(machine))))
    return pd.DataFrame(out, columns=["key", "at_ms", "fired", "state"])


def _samples(rows: DataFrame, key: str, at: str, level: str, speech: str | None) -> DataFrame:
    spoken = F.col(speech).cast("double") if speech else F.lit(0.0)
    return rows.select(F.col(key).cast("string").alias("key"), F.col(at).cast("double").alias("at_ms"), F.coalesce(F.col(level).cast("double"), F.lit(0.0)).alias("level"), F.coalesce(spoken, F.lit(0.0)).alias("speech"))


def replayed(rows: DataFrame, machine: type, key: str = "key", at: str = "at_ms", level: str = "level", speech: str | None = None, **config) -> DataFrame:
    """A detector over a batch: a row a sample. A key's rows stream by in order; only the detector's state is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = object(), None
        for batch in batches:
            fired, states = [], []
            samples = [batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in (1, 2, 3)]
            for of, *sample in zip(batch.column(0).to_pylist(), *samples, strict=True):
                if of != now:
                    now, kept = of, machine()
                fired.append(bool(kept.step(*sample, **config)))
                states.append(str(asdict(kept)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fired, pa.bool_()), pa.array(states, pa.string())], names=["key", "at_ms", "fired", "state"])

    samples = _samples(rows, key, at, level, speech)
    return samples.repartition("key").sortWithinPartitions("key", F.asc_nulls_last("at_ms"), "level", "speech").mapInArrow(run, OUT)


def streamed(rows: DataFrame, machine: type, key: str = "key", at: str = "at_ms", level: str = "level", speech: str | None = None, **config) -> DataFrame:
    """The same over a stream; a key's state lives on between batches."""

    def one(k: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = machine(*state.get) if state.exists else machine()
        yield folded(k[0], pd.concat(list(groups)), kept, **config)
        state.update(astuple(kept))

    samples = _samples(rows, key, at, level, speech)
    return samples.groupBy("key").applyInPandasWithState(one, OUT, state_schema(machine), "append", GroupStateTimeout.NoTimeout)


def gated(model: DataFrame, energy: DataFrame, wait_ms: int = 1000) -> DataFrame:
    """Model starts (key, at_ms) that an energy start of their key confirms within ``wait_ms`` before or after, and the time when both have
    come. Rows meet in cells of time, not by key alone. Event by event, with smoothing and frame counts,
    :mod:`canticle.streaming.gate` decides."""
    cell = lambda x: F.floor(x / (2 * wait_ms))
    e = energy.select(F.col("key").alias("_k"), F.col("at_ms").alias("_at"), cell(F.col("at_ms")).alias("_of"))
    dealt = model.select("key", "at_ms").distinct().withColumn("_cell", F.explode(F.array_distinct(F.array(cell(F.col("at_ms") - wait_ms), cell(F.col("at_ms") + wait_ms)))))
    near = dealt.join(e, (F.col("key") == F.col("_k")) & (F.col("_cell") == F.col("_of"))).where(F.abs(F.col("_at") - F.col("at_ms")) <= wait_ms)
    return near.groupBy("key", "at_ms").agg(F.greatest(F.col("at_ms"), F.min("_at")).alias("released_ms"))


def windowed_attempts(stream: DataFrame, at: str = "ts", late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Attempts and failures by event-time window and provider, with a watermark for late rows."""
    return (
        stream.withWatermark(at, late)
        .groupBy(F.window(at, width).alias("w"), "provider")
        .agg(F.count("*").alias("attempts"), F.count_if("success").alias("successes"))
        .select(F.col("w.start").alias("start"), "provider", "attempts", "successes")
    )


def per_batch(write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that applies a batch once: rows carry their batch id, so a replay can be left out."""

    def run(batch: DataFrame, batch_id: int) -> None:
        write(batch.withColumn("batch_id", F.lit(batch_id)), batch_id)

    return run
