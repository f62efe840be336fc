"""The pipeline's near-dedup stage against exact Jaccard similarity of all pairs."""

import random

import corpus_pipeline
from canticle.llm import similar


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_kept(docs):
    sets = {d: grams(t) for d, t in docs}
    low = {d: d for d in sets}
    while True:
        new = {a: min(low[b] for b in sets if jaccard(sets[a], sets[b]) >= 0.8) for a in sets}
        if new == low:
            return {d for d in low if low[d] == d}
        low = new


def planted(rng):
    """Texts with copies that have one to ten words changed (similarities from under 0.8 to 1), and chains of them."""
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(150, 400))]
        texts.append(" ".join(words))
        for changes in range(1, 11):
            copy = list(words)
            for at in rng.sample(range(len(copy)), changes):
                copy[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
            if changes == 4:
                words = copy
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_near_dedup_stage_reaches_similarity_of_four_fifths(spark):
    docs = planted(random.Random(3))
    sets = [grams(t) for _, t in docs]
    near = [j for i, a in enumerate(sets) for b in sets[:i] if (j := jaccard(a, b)) > 0.7]
    assert min(near) < 0.8 and any(0.8 <= j < 0.85 for j in near)
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert {r.doc_id for r in kept.collect()} == brute_kept(docs)


def test_near_dedup_stage_on_the_fixture_and_odd_rows(spark, documents, odd):
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, documents, "").collect()} == brute_kept(docs)
    kept = similar.keep_one_similar(odd)
    assert kept.columns == odd.columns and len(kept.collect()) == 6
    assert similar.keep_one_similar(odd.limit(0)).collect() == []


def crowd(rng, versions, changed, size=240):
    """Versions of one text, each with words of its own in ``changed`` places: most pairs lie about 0.8."""
    base = [f"w{rng.randrange(3000)}" for _ in range(size)]
    texts = []
    for _ in range(versions):
        words = list(base)
        for at in rng.sample(range(size), rng.choice(changed)):
            words[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    return texts


def test_crowds_about_the_threshold_equal_brute_force(spark):
    rng = random.Random(11)
    texts = crowd(rng, 80, (2, 3, 4)) + crowd(rng, 40, (2, 5)) + crowd(rng, 3, (3,)) + crowd(rng, 50, (3, 4))
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    sets = [grams(t) for t in texts]
    near = [jaccard(a, b) for i, a in enumerate(sets) for b in sets[:i]]
    assert sum(0.7 < j < 0.8 for j in near) > 500 and sum(0.8 <= j < 0.86 for j in near) > 100
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_kept(docs)
    assert {r.doc_id for r in similar.keep_one_similar(df).collect()} == want
    for limits in ({"crowd_limit": 24}, {"bucket_limit": 16, "crowd_limit": 50}):
        found = similar.similar(df, **limits).collect()
        assert {r.component_id for r in found} == want == {r.doc_id for r in found if r.doc_id == r.component_id}


def test_stages_may_be_chained_without_writing(spark, documents, tmp_path):
    path = f"file://{tmp_path}"
    documents.write.parquet(f"{path}/documents.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, docs.collect())) == sorted(map(key, corpus_pipeline.run(spark, path).collect()))
