"""Importance resampling, the language model and fill-in-middle against their definitions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from canticle.llm import infill, kneser_ney, registry, resample
from tests.llm.conftest import text_of


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=80), min_size=1, max_size=30), st.integers(1, 5))
def test_checksums_of_word_runs_equal_those_of_joined_words(words, ngram):
    crcs = np.array([zlib.crc32(w) for w in words], np.uint32)
    found = list(resample.ngram_checksums(crcs, np.array([len(w) for w in words]), ngram))
    for n, each in enumerate(found, 1):
        assert each.tolist() == [zlib.crc32(b" ".join(words[k : k + n])) for k in range(len(words) - n + 1)]


def words11(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute_resampled(docs, target, ngram, least, percent, buckets=10_000):
    of = lambda text: [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for w in [words11(text)] for n in range(1, ngram + 1) for k in range(len(w) - n + 1)]
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(of(text))
    for text in target:
        t.update(of(text))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (big_s + buckets) / ((s[k] + 1) * (big_t + buckets)))) for k in range(buckets)]
    out = {}
    for d, text in docs:
        f = of(text)
        weight = sum(gain[k] for k in f) // len(f) if f else 0
        h = int(sha(f"2024:{d}")[:8], 16)
        out[d] = [len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    able = sorted((d for d, text in docs if len(words11(text)) >= least), key=lambda d: (-out[d][2], d))
    for k, d in enumerate(able[: percent * len(able) // 100], 1):
        out[d][3] = k
    return {d: tuple(x) for d, x in out.items()}


def test_resampling_equals_its_definition(spark, documents):
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    target = [docs[3][1], "One two, THREE w7 w9-w11 é_ü", None]
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    for ngram, least, percent in ((1, 20, 10), (2, 5, 33), (3, 0, 100)):
        got = resample.resampled(documents, aim, ngram=ngram, least_words=least, percent=percent).collect()
        assert {r.id: (r.n_features, r.weight, r.score, r["rank"]) for r in got} == brute_resampled(docs, target, ngram, least, percent)


def test_resampling_keeps_drawn_rows_and_their_columns(spark, documents, odd):
    aim = documents.limit(5)
    named = documents.withColumn("drawn", F.lit("own")).withColumn("id", F.lit(7))
    kept = resample.keep_drawn(named, aim, percent=20)
    assert kept.columns == named.columns and {r.drawn for r in kept.collect()} == {"own"}
    assert resample.resampled(odd, aim, least_words=0, percent=50).count() == odd.count()
    assert sorted(r["rank"] for r in resample.resampled(odd, aim, least_words=0, percent=50).collect() if r["rank"]) == [1, 2, 3]
    assert resample.resampled(odd.limit(0), aim).collect() == [] and resample.resampled(documents, aim.limit(0)).count() == documents.count()


def test_resampling_reads_long_texts_in_blocks(monkeypatch):
    monkeypatch.setattr(resample, "BLOCK", 50)
    text = "Ab cde-F " * 400 + "x" * 500 + "  é"
    assert [w.decode() for some in resample.blocks(text) for w in some] == words11(text)


def tokens12(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + [None]


class BruteModel:
    """The model by its formulas, from plain counts."""

    def __init__(self, texts):
        self.pairs = Counter()
        for t in texts:
            before = "start"
            for w in tokens12(t):
                self.pairs[before, ("w", w)] += 1
                before = ("w", w)
        self.behind = defaultdict(list)
        for (b, _), n in self.pairs.items():
            self.behind[b].append(n)
        self.cc = Counter(c for _, c in self.pairs)
        self.d2, self.d1 = self.discounts(self.pairs.values()), self.discounts(self.cc.values())
        self.tokens = Counter(("w", w) for t in texts for w in tokens12(t))
        self.n, self.v = sum(self.tokens.values()), len(self.tokens)

    @staticmethod
    def discounts(counts):
        n = Counter(counts)
        if not (n[1] and n[2] and n[3]):
            return [0, 0.5, 1.0, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        return [0.0, *(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0), k) for k in (1, 2, 3))]

    def lower(self, c):
        kinds = len(self.pairs)
        if not kinds:
            return 1.0
        left = sum(self.d1[min(n, 3)] for n in self.cc.values())
        return (self.cc[c] - self.d1[min(self.cc[c], 3)]) / kinds + left / kinds / (self.v + 1)

    def p(self, b, c):
        if b not in self.behind:
            return self.lower(c)
        total, n = sum(self.behind[b]), self.pairs[b, c]
        return (n - self.d2[min(n, 3)]) / total + sum(self.d2[min(n, 3)] for n in self.behind[b]) / total * self.lower(c)

    def score(self, text):
        before, base, score, known = "start", 0.0, 0.0, 0
        for w in tokens12(text):
            c = ("w", w)
            base += math.log10((self.tokens[c] + 0.5) / (self.n + 0.5 * (self.v + 1)))
            score += math.log10(self.p(before, c))
            known += self.tokens[c] > 0
            before = c
        return base, score, known


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_language_model_equals_its_formulas(spark, documents, shards, monkeypatch):
    monkeypatch.setattr(kneser_ney, "HOT", 1)
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in docs}
    brute = BruteModel([t for d, t in docs if not held[d]])
    for r in kneser_ney.with_scores(documents, shards=shards).collect():
        base, score, known = brute.score(dict(docs)[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(tokens12(dict(docs)[r.doc_id])), known, brute.n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)


def test_language_model_splits_hot_words_and_sums_to_one(spark):
    rng = random.Random(5)
    texts = [" ".join(x for _ in range(40) for x in ("the", f"w{rng.randrange(60)}")) for _ in range(30)]
    model = kneser_ney.trained(spark.createDataFrame([(t,) for t in texts], "text string"), 8)
    the = kneser_ney.word_ids([b"the"])
    assert the[0] in model.hot
    words = np.concatenate([kneser_ney.word_ids([f"w{k}".encode() for k in range(60)]), the, [kneser_ney.END], kneser_ney.word_ids([b"never seen"])])
    for b in (the[0], words[0], words[-1], kneser_ney.START):
        _, _, score = model.scores(np.full(len(words), b), words)
        assert (10.0**score).sum() == pytest.approx(1, abs=1e-9)


def test_language_model_without_training_rows_and_in_blocks(spark, odd, monkeypatch):
    slim = odd.select(F.col("doc_id").alias("id"), "text")
    model = kneser_ney.trained(slim.select("text").limit(0), 4)
    assert {r.score for r in kneser_ney.scored(slim, model).collect()} == {0.0}
    text = text_of(random.Random(1), 3000)
    whole = np.concatenate([r[1:] for r in kneser_ney.token_runs(text)])
    monkeypatch.setattr(kneser_ney, "BLOCK_BYTES", 100)
    runs = list(kneser_ney.token_runs(text))
    assert len(runs) > 10 and np.concatenate([r[1:] for r in runs]).tolist() == whole.tolist()
    assert all(a[-1] == b[0] for a, b in zip(runs[:-1], runs[1:], strict=True)) and runs[0][0] == kneser_ney.START and runs[-1][-1] == kneser_ney.END


def test_language_model_is_better_than_the_base_on_held_out_texts(spark):
    rng = random.Random(2)
    follows = {k: [rng.randrange(300) for _ in range(4)] for k in range(300)}
    texts = []
    for _ in range(200):
        at, said = rng.randrange(300), []
        for _ in range(60):
            said.append(f"w{at}")
            at = rng.choice(follows[at])
        texts.append(" ".join(said))
    rows = kneser_ney.with_scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("held_out").collect()
    assert sum(r.score for r in rows) > 0.6 * sum(r.base_score for r in rows)


def brute_infilled(id_, text):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    x = sha(f"7:{id_}")
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h[3] % 100 < 50 else "psm"
    return len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_infill_equals_its_definition(spark, documents):
    rng = random.Random(4)
    odd = ["", "\n", "\n\n\n", "a", "a\n", "x<P>y\nz", "<S", "<\nS>\n<M\n>", "e\x01\n\x02e\x02d\n\x01\x02", "<P\n>é😀\nß", "\r\n \n"]
    odd += ["".join(rng.choice(["\n", "a", "<", "P", ">", "\x01", "\x02", "d", "e", "😀"]) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    docs = [(r.doc_id, r.text) for r in documents.collect()] + list(enumerate(odd, 1000))
    rows = infill.infilled(spark.createDataFrame(docs, "doc_id long, text string"))
    x = F.col("_fim")
    got = {r[0]: r[1:] for r in rows.select("doc_id", x["n"], x["form"], F.char_length(x["prefix"]), F.char_length(x["middle"]), x["output"], infill.restored(x["output"], x["form"])).collect()}
    assert got == {d: (*brute_infilled(d, t or ""), t or "") for d, t in docs}
    assert {g[1] for g in got.values()} == {"plain", "psm", "spm"}


def test_infill_rate_units_and_columns(spark, odd):
    words = infill.infilled(odd.withColumn("_fim", F.lit(1)), unit=r"[^ ]* |[^ ]+", percent=50)
    assert words.columns == [*odd.columns, "_fim"] and words.count() == odd.count()
    assert {r.n for r in words.where("text like 'one%'").select("_fim.n").collect()} == {6}
    assert {r.form for r in infill.infilled(odd, percent=0).select("_fim.form").collect()} == {"plain"}


def test_contracts(spark, documents, tmp_path):
    path = f"file://{tmp_path}"
    documents.write.parquet(f"{path}/documents.parquet")
    documents.limit(9).select(F.col("doc_id").alias("item_id"), "text").write.parquet(f"{path}/benchmark.parquet")
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    found = {k: {r.doc_id: r for r in registry.QUERIES[k](spark, path).collect()} for k in ("op11_importance_resampling", "op13_fill_in_middle")}
    target = [r.text for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    assert {d: tuple(r)[1:] for d, r in found["op11_importance_resampling"].items()} == brute_resampled(docs, target, 1, 20, 10)
    for d, t in docs:
        n, form, p, m, output = brute_infilled(d, t or "")
        assert tuple(found["op13_fill_in_middle"][d]) == (d, n, form, p, m, sha(output), sha(t or ""))
