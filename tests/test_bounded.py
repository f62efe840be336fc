"""Folds and medians whose memory doesn't grow with a group: against plain loops, over many small batches."""

import random
import statistics

import pytest

from canticle.operators import ranking
from canticle.streaming import detectors as D


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("machine", [D.Trigger, D.Voice])
def test_replay_streams_each_key(spark, small_batches, machine):
    rng = random.Random(5)
    rows = [(k, float(t * 90), rng.random() if t % 30 < 20 else 0.0) for k in ("a", "b", None) for t in range(100)]
    shuffled = rng.sample(rows, len(rows))
    found = D.replayed(spark.createDataFrame(shuffled, "key string, at_ms double, level double"), machine, **({"start": 0.4, "stop": 0.2} if machine is D.Trigger else {}))
    want = []
    for key in ("a", "b", None):
        kept = machine()
        config = {"start": 0.4, "stop": 0.2} if machine is D.Trigger else {}
        want += [(key, at, bool(kept.step(at, level, 0.0, **config)), str(D.asdict(kept))) for k, at, level in rows if k == key]
    assert any(w[2] for w in want)
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(map(repr, want))
    assert "FlatMapGroupsInPandas" not in plan_of(found)


def test_medians_count(spark):
    rng = random.Random(8)
    rows = [(g, rng.randint(0, 9)) for g, n in (("a", 1), ("b", 2), ("c", 41), ("d", 40)) for _ in range(n)] + [("a", None), ("e", None)]
    found = ranking.medians(spark.createDataFrame(rows, "g string, v int"), "g", "v")
    of = {g: sorted(v for h, v in rows if h == g and v is not None) for g in "abcde"}
    want = {g: (v[len(v) // 2], statistics.median(v)) if v else (None, None) for g, v in of.items()}
    assert {r.g: (r.upper_median, r.true_median) for r in found.collect()} == want
    assert "collect_list" not in plan_of(found)


def test_greedy_fold_holds_only_what_it_took(spark, small_batches):
    rng = random.Random(9)
    some = lambda: rng.choice([None, *range(12)])
    rows = [(g, rng.randint(0, 50), n, some(), some()) for g in ("a", "b", None) for n in range(120)]
    found = ranking.greedy_distinct(spark.createDataFrame(rows, "g string, r int, id int, x int, y int"), "g", ["r", "id"], ("x", "y"), most=6)
    want = []
    for g in ("a", "b", None):
        taken = []
        for row in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])):
            if len(taken) < 6 and not any((row[c] is not None and row[c] == t[c]) for t in taken for c in (3, 4)):
                want.append((g, len(taken), *row[1:]))
                taken.append(row)
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(map(repr, want))
    assert "collect_list" not in plan_of(found)


def test_the_throttle():
    t = D.Throttle()
    assert [x for x in range(0, 2000, 200) if t.step(float(x), 1.0)] == [0, 600, 1200, 1800]
