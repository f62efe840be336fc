"""Large groups of near copies in one bucket: few pairs leave it, and the group holds together."""

import numpy as np

from canticle.llm import similar


def sketch(sets):
    lows = [similar.minima(s) for s in sets]
    low = np.array([m.astype(np.uint8) for m in lows])
    return np.array([len(s) for s in sets]), np.array([similar.set_simhash(s) for s in sets], np.int64), low


def jaccard(a, b):
    same = len(np.intersect1d(a, b))
    return same / (len(a) + len(b) - same)


def joined(n, edges):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(top(a), top(b))] = min(top(a), top(b))
    return [top(k) for k in range(n)]


def test_copies_of_a_base_join_through_it():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(2):  # two bases; copies are 0.85 like their base and 0.74 like each other
        base = rng.integers(0, 2**64, 400, np.uint64)
        sets += [base, *[np.unique(np.concatenate([rng.permutation(base)[:368], rng.integers(0, 2**64, 33, np.uint64)])) for _ in range(300)]]
    order = rng.permutation(len(sets))
    mixed = [sets[k] for k in order]
    a, b = similar.bucket_pairs(np.zeros(len(sets), np.int64), *sketch(mixed), 0.8)
    assert len(a) < 4 * len(sets)
    true = [(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True) if jaccard(mixed[x], mixed[y]) >= 0.8]
    roots = joined(len(sets), true)
    for part in (range(301), range(301, 602)):
        found = [roots[int(np.flatnonzero(order == k)[0])] for k in part]
        assert max(found.count(r) for r in set(found)) >= 0.98 * 301


def test_a_crowd_just_under_the_limit_sends_few_pairs():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**64, 400, np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[:360], rng.integers(0, 2**64, 40, np.uint64)])) for _ in range(500)]
    a, b = similar.bucket_pairs(np.zeros(500, np.int64), *sketch(sets), 0.8)
    assert len(a) < 2000


def test_small_buckets_send_every_near_pair():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**64, 300, np.uint64)
    sets = [np.unique(np.concatenate([base[k : k + 260], rng.integers(0, 2**64, 5, np.uint64)])) for k in range(0, 40, 2)]
    keys = np.repeat([1, 2], [10, 10])
    a, b = similar.bucket_pairs(keys, *sketch(sets), 0.8)
    true = {(i, j) for i in range(20) for j in range(i + 1, 20) if keys[i] == keys[j] and jaccard(sets[i], sets[j]) >= 0.8}
    roots = joined(20, [(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True) if jaccard(sets[x], sets[y]) >= 0.8])
    assert roots == joined(20, true) and len(true) > 20


def test_no_rows():
    a, b = similar.bucket_pairs(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, 160), np.uint8), 0.8)
    assert len(a) == len(b) == 0
