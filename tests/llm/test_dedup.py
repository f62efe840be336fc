"""Substring dedup, line dedup and SimHash against brute force."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from canticle.llm import components, lines, simhash, substring


def collected(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def brute_substring(docs, window):
    words = {d: (t or "").encode().split() for d, t in docs}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), d)
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out[d] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    return out


@pytest.mark.parametrize("window", [50, 12])
def test_substring(documents, window):
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    want = brute_substring(docs, window)
    got = collected(substring.without_repeats(documents, window=window))
    assert {d: (r["n_words"], r["n_removed"], r["kept"]) for d, r in got.items()} == want
    assert sum(w[1] for w in want.values()) > 0
    again = {r.doc_id: r.text for r in substring.replaced_text(documents, window=window).collect()}
    assert again == {d: (want[d][2] if want[d][1] else t) for d, t in docs}


def test_rolling_hash_is_of_the_words_alone():
    roll = substring.Rolling()
    one = roll.prefix(b"a b c d e f".split())
    two = roll.prefix(b"z z b c d q".split())
    at = np.array([1])
    assert roll.spans(one, at, at + 3, 0) == roll.spans(two, at + 1, at + 4, 0)
    assert roll.spans(one, at, at + 3, 0) != roll.spans(one, at + 1, at + 4, 0)


def test_lines(documents):
    docs = [(r.doc_id, r.text, r.source) for r in documents.orderBy("doc_id").collect()]
    sites, first = {}, {}
    for d, t, s in docs:
        for i, x in enumerate((t or "").split("\n")):
            if x.strip():
                sites.setdefault(x, set()).add(s)
                first.setdefault(x, (d, i))
    boiler = {x for x, s in sites.items() if len(s) >= 10}
    assert boiler == {"All rights reserved by nobody"}
    want = {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if x not in boiler or first[x] == (d, i)) for d, t, _ in docs}
    got = {r.doc_id: r.text for r in lines.without_boilerplate(documents).collect()}
    assert got == want


def test_lines_near_the_threshold_are_counted_exactly(spark):
    rows = [(100 * n + k, f"line {n}", f"s{k}") for n in range(1, 30) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = lines.without_boilerplate(docs, min_sites=12).where("_n_lines_removed > 0").select((F.col("doc_id") / 100).cast("int")).distinct()
    assert sorted(r[0] for r in got.collect()) == list(range(12, 30))


def brute_fingerprint(text):
    words = bytes((text or "").encode()).lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    ids = sorted(prints)
    low = {d: d for d in ids}
    while True:
        new = {a: min(low[b] for b in ids if (prints[a] ^ prints[b]).bit_count() <= radius) for a in ids}
        if new == low:
            return low
        low = new


@pytest.mark.parametrize("limit", [50_000, 2])
def test_simhash(documents, limit):
    prints = {r.doc_id: brute_fingerprint(r.text) for r in documents.collect()}
    want = brute_components(prints, 3)
    got = collected(simhash.near_duplicates(documents, bucket_limit=limit))
    assert {d: r["fp"] & (2**64 - 1) for d, r in got.items()} == prints
    assert {d: r["component_id"] for d, r in got.items()} == want
    kept = {r.doc_id for r in simhash.keep_one(documents).collect()}
    assert kept == set(want.values())


@pytest.mark.parametrize("radius", [1, 3, 4, 6])
def test_bit_sliced_comparison(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(-(2**62), 2**62, 20)
    fps = np.unique(np.concatenate([base, *[base ^ (1 << rng.integers(0, 62, 20)) ^ (1 << rng.integers(0, 62, 20)) for _ in range(9)]]))
    planes = simhash.bit_planes(fps)
    for shift in (1, 7, 64, 100):
        want = [i for i in range(len(fps) - shift) if (int(fps[i] ^ fps[i + shift]) & (2**64 - 1)).bit_count() <= radius]
        flags = np.ones(len(fps) - shift, bool)
        assert simhash.lanes_within(planes, simhash.pack_lanes(flags, planes.shape[1]), shift, radius).tolist() == want


def test_every_close_pair_shares_a_table():
    masks = [m & (2**64 - 1) for m in simhash.block_masks(3)]
    rng = np.random.default_rng(0)
    for _ in range(300):
        flip = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(flip & m == 0 for m in masks)


def test_components_of_a_long_chain(spark):
    n = 60
    links = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(200, 201)], "a long, b long")
    got = {r.a: r.b for r in components.stars(links).collect()}
    assert got == {k: 0 for k in range(1, n + 1)} | {201: 200}


def test_odd_rows(odd, spark):
    sub = substring.without_repeats(odd, window=5).collect()
    assert len(sub) == 7 and all(r.n_removed == 0 for r in sub)
    assert len(lines.without_boilerplate(odd).collect()) == 7
    marked = simhash.near_duplicates(odd).collect()
    assert len(marked) == 7 and {r.component_id for r in marked} == {1, 2}  # wordless texts are one group, copies another
    assert simhash.keep_one(odd).columns == odd.columns and len(simhash.keep_one(odd).collect()) == 6
    empty = odd.limit(0)
    for f in (substring.without_repeats, substring.replaced_text, lines.without_boilerplate, simhash.near_duplicates, simhash.keep_one):
        assert f(empty).collect() == []
