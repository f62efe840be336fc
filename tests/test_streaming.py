"""Detectors: hand-made sequences, and the stream against the batch."""

import pytest
from pyspark.sql import functions as F

from canticle.streaming import detectors as D


def test_trigger_holds_then_cools_down():
    machine = D.Trigger()
    fired = [machine.step(t * 50.0, 1.0) for t in range(60)]
    assert fired.count(True) == 1
    first = fired.index(True)
    smooth, k = 0.0, 0
    while smooth < 0.9:
        smooth += 0.2 * (1 - smooth)
        k += 1
    assert first == k - 1 + 8  # 400 ms of hold
    assert machine.phase == "triggered"
    assert not any(machine.step(3000.0 + t * 50, 0.0) for t in range(10)) and machine.phase == "idle"
    assert not any(D.Trigger().step(t * 50.0, 1.0, 2.0) for t in range(60))


def test_voice_hysteresis_and_burst():
    voice = D.Voice()
    assert [voice.step(t, p) for t, p in ((0.0, 0.5), (200.0, 0.5), (250.0, 0.05), (400.0, 0.1), (600.0, 0.05))] == [False, True, False, False, False]
    assert not voice.on
    burst = D.Voice()
    burst.step(100.0, 0.5)
    burst.step(140.0, 0.5)
    burst.step(270.0, 0.2)
    assert burst.muted_until == 770.0


def test_noise_and_clock():
    noise = D.Noise()
    assert [noise.step(t * 1000.0, 0.2) for t in range(6)] == [False, False, False, True, False, False]
    clock = D.Clock()
    for t in range(11):
        clock.step(t * 100.0, 2.0)
    clock.step(5000.0, 2.0)
    assert clock.position == pytest.approx(2.0)


@pytest.mark.parametrize("machine", [D.Trigger, D.Voice])
def test_a_stream_is_its_batch(spark, tmp_path, machine):
    rows = spark.createDataFrame([(k, float(t * 100), 0.95 if t % 40 < 30 else 0.0) for k in ("a", "b") for t in range(120)], "key string, at_ms double, level double")
    for part in range(3):
        rows.where((F.col("at_ms") >= part * 4000) & (F.col("at_ms") < (part + 1) * 4000)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    want = {(r.key, r.at_ms) for r in D.replayed(rows, machine).where("fired").collect()}
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    run = D.streamed(stream, machine).writeStream.format("memory").queryName(f"out_{machine.__name__}").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {(r.key, r.at_ms) for r in spark.table(f"out_{machine.__name__}").where("fired").collect()}
    assert got == want and want


def test_windows_with_a_watermark(spark, tmp_path):
    log = spark.createDataFrame([("2024-01-01 10:00:00", "p", True), ("2024-01-01 23:00:00", "p", False), ("2024-01-02 01:00:00", "q", True)], "ts string, provider string, success boolean")
    log.select(F.to_timestamp("ts").alias("ts"), "provider", "success").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, provider string, success boolean").parquet(f"{tmp_path}/in")
    run = D.windowed_attempts(stream).writeStream.format("memory").outputMode("complete").queryName("windows").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted((r.provider, r.attempts, r.successes) for r in spark.table("windows").collect()) == [("p", 2, 1), ("q", 1, 1)]
