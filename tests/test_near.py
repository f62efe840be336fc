"""The similarity join on segments against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from canticle.operators import near


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, text, n):
    for _ in range(n):
        at = rng.randrange(len(text) + 1)
        text = rng.choice([text[:at] + rng.choice("abcé") + text[at:], text[:at] + text[at + 1 :], text[:at] + rng.choice("abcé") + text[at + 1 :]])
    return text


@pytest.mark.parametrize("percent", [10, 15, 30])
def test_no_pair_is_missed(spark, percent):
    rng = random.Random(percent)
    base = ["".join(rng.choice("abcé ") for _ in range(rng.choice([0, 1, 3, 5, 7, 9, 10, 11, 18, 20, 24, 31, 40]))) for _ in range(60)]
    left = [(rng.choice("xy"), edited(rng, t, rng.randint(0, 6))) for t in base for _ in range(2)]
    right = [(rng.choice("xy"), t) for t in base] + [("x", None), (None, "abc")]
    a = spark.createDataFrame([(k, n, t) for n, (k, t) in enumerate(left)] + [("x", -1, None), (None, -2, "abc")], "k string, n int, t string")
    b = spark.createDataFrame([(k, n, t) for n, (k, t) in enumerate(right)], "rk string, rn int, rt string")
    longer = F.greatest(F.char_length("t"), F.char_length("rt"))
    met = near.candidates(a, b, [("k", "rk")], "t", "rt", percent)
    got = {(r.n, r.rn) for r in met.where(F.levenshtein("t", "rt") * 100 <= longer * percent).collect()}
    want = {(n, m) for n, (k, t) in enumerate(left) for m, (h, u) in enumerate(right) if k == h and u is not None and distance(t, u) * 100 <= percent * max(len(t), len(u))}
    assert got == want and len(want) > 30


def test_an_artist_of_many_titles_costs_no_product(spark):
    rng = random.Random(1)
    titles = [" ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(4)) for _ in range(3000)]
    a = spark.createDataFrame([("one", edited(rng, t, 1)) for t in titles], "k string, t string")
    b = spark.createDataFrame([("one", t) for t in titles], "rk string, rt string")
    met = near.candidates(a, b, [("k", "rk")], "t", "rt", 10)
    assert met.where("t <> rt").count() < 20 * len(titles)
    assert met.where(F.levenshtein("t", "rt") <= 2).select("t").distinct().count() == a.select("t").distinct().count()


def test_a_key_of_few_texts_meets_them_once(spark):
    a = spark.createDataFrame([("one", "a title of some thirty letters")], "k string, t string")
    b = spark.createDataFrame([("one", "a title of some thirty letters"), ("one", "a title of some thirty lettres"), ("two", "x")], "rk string, rt string")
    met = near.candidates(a, b, [("k", "rk")], "t", "rt", 10)
    assert sorted(r.rt for r in met.collect()) == ["a title of some thirty letters", "a title of some thirty lettres"]
