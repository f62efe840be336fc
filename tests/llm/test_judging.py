"""Quality rules, fingerprints, toxicity and the pipeline."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from canticle.llm import fingerprint, quality, simhash, toxicity


def brute_counts(text):
    text = text or ""
    words = text.encode().split()
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    kept = [x for x in text.split("\n") if x.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(kept) - len(set(kept)), len(covered)


def test_quality_counts(documents):
    got = quality.verdicts(documents).collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got} == {d: brute_counts(t) for d, t in texts.items()}
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in got)


def test_bad_hosts_are_rejected_and_small_ones_spared(spark):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choices([f"w{k}" for k in range(900)], k=40))
    rows = [(k, good() if k % 10 else "bad", f"fine{k % 8}") for k in range(400)]
    rows += [(1000 + k, "bad" if k % 10 else good(), "spam") for k in range(100)] + [(2000, "bad", "tiny"), (2001, good(), "tiny"), (2002, good(), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in quality.verdicts(docs).where("kept").collect()}
    assert kept == {k for k in range(400) if k % 10} | {2001, 2002}
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == kept


def test_hosts_of_one_document_don_t_judge_others(spark):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choices([f"w{k}" for k in range(900)], k=40))
    rows = [(k, good() if k % 10 else "bad", f"single{k}") for k in range(100)]
    rows += [(200, "bad", "small"), (201, "bad", "small"), (202, good(), "small")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in quality.verdicts(docs).where("kept").collect()}
    assert kept == {k for k in range(100) if k % 10} | {202}
    more = [(1000 + k, "bad" if k % 12 else good(), "spam") for k in range(120)] + [(3000 + k, good(), f"big{k % 5}") for k in range(200)]
    docs = docs.union(spark.createDataFrame(more, docs.schema))
    kept = {r.doc_id for r in quality.verdicts(docs).where("kept").collect()}
    assert not {1000 + k for k in range(0, 120, 12)} & kept and {3000 + k for k in range(200)} <= kept


def test_documents_are_measured_once(spark, documents, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "written", lambda df, label, f=quality.written: (seen.append((label, df._jdf.queryExecution().analyzed().toString())), f(df, label))[1])
    out = quality.keep_good(documents)
    plans = [p for _, p in seen] + [out._jdf.queryExecution().analyzed().toString()]
    assert sum("n_repeat_words" in p and "regexp_replace" in p for p in plans) == 1


def shingles(text):
    w = (text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_fingerprints_estimate_jaccard(spark, documents):
    docs = documents.withColumn("text", F.coalesce("text", F.lit(""))).select("doc_id", "text")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    paired = fingerprint.with_next(docs.withColumn("print", fingerprint.fingerprint(F.col("text"))), "doc_id", "text", ["text", "print"], bucket_rows=7)
    got = {r.doc_id: r for r in paired.withColumn("edited", fingerprint.edited_text(F.col("text"), F.col("next_text"))).withColumn("near", fingerprint.likeness(F.col("print"), fingerprint.fingerprint(F.col("edited")))).collect()}
    errors = []
    for k, (d, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert (got[d].next_text, got[d].edited) == (after, edited)
        a, b = shingles(t), shingles(edited)
        errors.append(got[d].near - (len(a & b) / len(a | b) if a | b else 1.0))
    assert max(map(abs, errors)) < 0.2 and abs(sum(errors) / len(errors)) < 0.02
    texts = {}
    for d, t in rows:
        assert texts.setdefault(t, got[d]["print"]) == got[d]["print"]


def test_successors_over_ranges_and_buckets(spark):
    rng = random.Random(9)
    rows = [(rng.choice([None, rng.randint(0, 5000)]), f"t{k}", "own", k % 3) for k in range(900)] + [(7, "same", "own", 0)] * 3
    df = spark.createDataFrame(rows, "doc_id long, t string, _row string, _bucket int")
    want = sorted((d is None, d or 0, t) for d, t, _, _ in rows)
    for bucket_rows, cuts in ((5, 8), (5, 1024), (1, 40), (10_000, 4)):
        got = fingerprint.with_next(df, "doc_id", "t", ["doc_id"], bucket_rows, cuts).collect()
        assert all(r["_row"] == "own" for r in got) and len(got) == len(rows)
        after = [want[(k + 1) % len(want)][:2] for k in range(len(want))]
        assert sorted((r.doc_id is None, r.doc_id or 0, r.next_doc_id is None, r.next_doc_id or 0) for r in got) == sorted((*w[:2], *a) for w, a in zip(want, after, strict=True))


def brute_bins(text):
    import xxhash

    def chained(words):
        h = 42
        for w in words:
            h = xxhash.xxh64_intdigest(w, h)
        return h - (1 << 64) if h >> 63 else h

    bins = {}
    for s in shingles(text):
        h = chained(s)
        bins[h >> 57] = min(h, bins.get(h >> 57, h))
    return bins


def test_filled_bins_hold_the_least_hash(spark):
    text = " ".join(f"t{k}" for k in range(60))
    got = spark.createDataFrame([(text,)], "text string").select(fingerprint.fingerprint(F.col("text"))).first()[0]
    bins = brute_bins(text)
    assert len(got) == 128 and all(got[b + 64] == h & 255 for b, h in bins.items())
    assert {v for v in got} <= {h & 255 for h in bins.values()}


def test_empty_bins_take_the_filled_bin_first_in_their_order(spark):
    text = " ".join(f"t{k}" for k in range(40))
    bins = {b + 64: h & 255 for b, h in brute_bins(text).items()}
    pairs = spark.createDataFrame([(j, f - 64, low) for j in range(128) if j not in bins for f, low in bins.items()], "j int, f long, low long")
    place = F.xxhash64("j", "f")
    first = pairs.groupBy("j").agg(F.min_by("low", F.struct(F.shiftright(place, 8), "low")).alias("low"))
    want = bins | {r.j: r.low for r in first.collect()}
    got = spark.createDataFrame([(text,)], "text string").select(fingerprint.fingerprint(F.col("text"))).first()[0]
    assert 0 < len(bins) < 128 and got == [want[k] for k in range(128)]


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(5)
    plain, bad = [f"w{k}" for k in range(500)], ["fool", "zork", "zorkel", "grumble"]

    def text(toxic):
        words = rng.choices(plain, k=rng.randint(30, 90))
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "!", "."]))
        return " ".join(words)

    rows = [(k, text(k % 6 == 0), int(k % 6 == 0)) for k in range(900)]
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows] + [(5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.scored(docs, labels).collect()}
    assert len(got) == 902 and all(0 <= s <= 1 for s in got.values())
    held = [(got[d] >= 0.5, y) for d, _, y in rows if zlib.crc32(str(d).encode()) % 5 == 0]
    right = sum(p == bool(y) for p, y in held) / len(held)
    assert right > 0.95 and any(y for _, y in held)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (2, "fine"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.doc_id: r.score for r in toxicity.scored(docs, labels).collect()} == {1: 0.9, 2: 0.1, None: 0.1}


def test_odd_rows(odd):
    empty = odd.limit(0)
    assert len(quality.verdicts(odd).collect()) == 7 and quality.verdicts(empty).collect() == []
    assert quality.keep_good(odd).columns == odd.columns and quality.keep_good(empty).collect() == []
    named = odd.withColumn("t", F.coalesce("text", F.lit("")))
    assert len(fingerprint.with_next(named, "doc_id", "t", ["t"]).collect()) == 7
    assert fingerprint.with_next(named.limit(0), "doc_id", "t", ["t"]).collect() == []


def test_pipeline_stages(spark, documents, tmp_path):
    docs = {r.doc_id: r.text for r in documents.collect()}
    path = f"file://{tmp_path}/in"
    documents.write.parquet(f"{path}/documents.parquet")
    at, kept = documents, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, path)
        assert out.columns == documents.columns, name
        rows = {r.doc_id: r.text for r in out.collect()}
        if name == "quality rules":
            assert rows == {r.doc_id: docs[r.doc_id] for r in quality.verdicts(documents).where("kept").collect()}
        if name == "line dedup":
            assert set(rows) == set(kept) and sum(t.count("All rights") for t in rows.values()) == 1
        if name == "simhash near-dedup":
            assert set(rows) == {r.component_id for r in simhash.near_duplicates(at).collect()}
        if name == "substring dedup":
            from tests.llm.test_dedup import brute_substring

            want = brute_substring(list(kept.items()), 50)
            assert rows == {d: (want[d][2] if want[d][1] else kept[d]) for d in kept}
        kept, at = rows, spark.createDataFrame(out.collect(), documents.schema)
    placed = corpus_pipeline.STAGES[-1][1](spark, at, path).collect()
    assert {r.doc_id for r in placed} == set(kept)
    assert sum(1 for _ in corpus_pipeline.run(spark, path).collect()) == len(placed)


@pytest.mark.parametrize("name", ["op4_line_dedup", "op8_quality_rules"])
def test_queries_against_sql(spark, documents, tmp_path, name):
    import duckdb

    from canticle.llm import registry

    path = f"file://{tmp_path}/in"
    documents.write.parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/in/documents.parquet/*.parquet')")
    got = registry.QUERIES[name](spark, path)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({registry.ORACLES[name]})").fetchall()
    assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == sorted(want)
