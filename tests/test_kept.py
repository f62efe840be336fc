"""The kept index against searches over postings made anew, with segments added, replaced and written again."""

import random

import pytest
from pyspark.sql import functions as F

from canticle.operators import kept, search

WORDS = "the then there an ant of off on one öl über 7 70 wind window".split()
SCHEMA = "id string, title string, body string"


def made(seed, ids):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(WORDS).title() for _ in range(n))
    return [(i, text(rng.randint(0, 4)), rng.choice([None, "", "--", text(rng.randint(1, 60))])) for i in ids]


def ids(df):
    return sorted(r.id for r in df.collect())


def scores(df):
    return {r.id: round(r.score, 9) for r in df.collect()}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    """Three segments: the second replaces some of the first, the third some of both, one by an empty text."""
    path = str(tmp_path_factory.mktemp("index"))
    parts = [made(1, [f"d{n}" for n in range(60)]), made(2, [f"d{n}" for n in range(50, 80)]), [*made(3, [f"d{n}" for n in range(55, 65)]), ("d1", None, " "), (None, "the", "the")]]
    for n, part in enumerate(parts):
        kept.add(spark.createDataFrame(part, SCHEMA), "id", ["title", "body"], path, n, ranges=3)
    last = {row[0]: row for part in parts for row in part if row[0]}
    return path, spark.createDataFrame(list(last.values()), SCHEMA)


def test_equals_postings_made_anew(spark, index, tmp_path):
    path, docs = index
    anew = search.postings(docs, "id", ["title", "body"])
    kept.compacted(spark, path, f"{tmp_path}/one", ranges=2)
    for at in (path, f"{tmp_path}/one"):
        found = kept.opened(spark, at)
        assert sorted(map(tuple, kept.placed(found).select("id", "field", "pos", "token").collect())) == sorted(map(tuple, anew.collect()))
        for text in ("the", "of the", "an wind", "ÜBER öl", "7", "nothing", ""):
            assert ids(kept.holding(spark, at, text)) == ids(search.prefix_search(anew, text)), text
            if text:
                assert ids(kept.phrase(spark, at, {"body": text})) == ids(search.phrase_search(anew, {"body": text})), text
        assert ids(kept.phrase(spark, at, {"title": "the", "body": "of"})) == ids(search.phrase_search(anew, {"title": "the", "body": "of"}))
        for weights in (None, {"title": 10.0, "body": 1.0}):
            assert scores(kept.ranked(spark, at, "one window öl", weights=weights)) == scores(search.bm25(anew, "one window öl", weights=weights))
    assert kept.segments(spark, f"{tmp_path}/one") == [0]
    assert ids(kept.indexed_documents(spark, path)) == ids(docs)


def test_unfinished_and_repeated_segments(spark, tmp_path):
    path = str(tmp_path / "i")
    first, second = made(5, range(20)), made(6, range(15, 30))
    df = lambda rows: spark.createDataFrame(rows, "id int, title string, body string")
    assert kept.segments(spark, path) == []
    kept.add(df(first), "id", ["title", "body"], path, 0)
    before = ids(kept.holding(spark, path, "the"))
    kept.add(df(second), "id", ["title", "body"], path, 1)
    after = scores(kept.ranked(spark, path, "the one"))
    totals = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/totals/segment=1")
    totals.getFileSystem(spark._jsc.hadoopConfiguration()).delete(totals, True)  # as if the run had stopped before its end
    assert ids(kept.holding(spark, path, "the")) == before
    for _ in range(2):
        kept.add(df(second), "id", ["title", "body"], path, 1)
    assert scores(kept.ranked(spark, path, "the one")) == after
    kept.add(df([]), "id", ["title", "body"], path, 2)
    assert scores(kept.ranked(spark, path, "the one")) == after
    with pytest.raises(ValueError, match="twice"):
        kept.add(df([(1, "a", "b"), (1, "c", "d")]), "id", ["title", "body"], path, 3)
    assert kept.segments(spark, path) == [0, 1, 2]


def test_reads_only_its_tokens(spark, index):
    path, _ = index
    plan = kept.holding(spark, path, "of the")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    scan = plan[plan.index("Location: InMemoryFileIndex", plan.index("/postings") - 200) :].split("\n\n")[0]
    assert "lead=o" in scan and "lead=a" not in scan and "Or(EqualTo(token,of),StringStartsWith(token,the))" in scan
    assert "gaps" not in scan.split("ReadSchema")[1]
    files = spark.read.parquet(f"{path}/postings/segment=0").where("lead = 't'").select("token", F.input_file_name().alias("file"))
    spans = sorted((r.low, r.high) for r in files.groupBy("file").agg(F.min("token").alias("low"), F.max("token").alias("high")).collect())
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_blocks_of_a_batch(monkeypatch):
    """Slices, short blocks, a token over several ranges: every posting once, in its range, in order."""
    import random

    import pyarrow as pa

    monkeypatch.setattr(kept, "BLOCK", 3)
    monkeypatch.setattr(kept, "WORDS", 40)
    rng = random.Random(4)
    rows = [(n, rng.getrandbits(63) - 2**62, rng.choice("tb"), [rng.choice("aabbbbbbccdé") for _ in range(rng.choice([0, 1, 5, 30, 90]))]) for n in range(80)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([len(r[3]) for r in rows], pa.int32()), pa.array([r[2] for r in rows]), pa.array([r[3] for r in rows], pa.list_(pa.string()))],
        names=["id", "h", "len", "field", "words"],
    )
    starts = ["b", "b", "c"]
    found, ranges = {}, {}
    for block in (x for out in kept._grouped(starts)([batch, batch.slice(0, 0)]) for x in out.to_pylist()):
        assert 1 <= len(block["ids"]) <= 3 and len(block["ids"]) == len(block["lens"]) == sum(x < 0 for x in block["gaps"])
        begin = 0
        ends = [k for k, x in enumerate(block["gaps"]) if x < 0][1:] + [len(block["gaps"])]
        for id_, size, end in zip(block["ids"], block["lens"], ends, strict=True):
            key = (block["token"], block["field"], id_)
            assert key not in found and size == len(rows[id_][3])
            at, places = 0, []
            for gap in block["gaps"][begin:end]:
                at += ~gap if gap < 0 else gap
                places.append(at)
            found[key], ranges[key], begin = places, block["range"], end
        assert begin == len(block["gaps"])
    assert found == {(t, f, n): [k for k, w in enumerate(words) if w == t] for n, _, f, words in rows for t in set(words)}
    assert {t: {r for key, r in ranges.items() if key[0] == t} for t in "abcdé"} == {"a": {0}, "b": {0, 1, 2}, "c": {2, 3}, "d": {3}, "é": {3}}


def strung(words):
    return "".join(f"{w} " for w in words)


def test_words_as_one_string(spark):
    """Words come as strings as well as lists, with the same blocks, which leave in the order of their tokens."""
    import pyarrow as pa

    odd = ["", None, "  -- ", "A b", "--A  b--", "İx 7½ǅ́y\U0001d54f \U0001f600z", "the\nThe\tTHE", "ß ẞ œ٣"]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(odd)], "id int, t string")
    split = {r.id: r.w for r in df.select("id", F.filter(F.split(F.lower(F.coalesce("t", F.lit(""))), search.TOKEN), lambda x: x != "").alias("w")).collect()}
    assert {r.id: r.w for r in df.select("id", kept._words(F.col("t")).alias("w")).collect()} == {n: strung(w) for n, w in split.items()}

    rng = random.Random(8)
    texts = [[rng.choice(WORDS) for _ in range(rng.choice([0, 0, 1, 7, 40]))] for _ in range(90)]
    heads = [pa.array(range(90)), pa.array([rng.getrandbits(62) for _ in texts]), pa.array([len(w) for w in texts], pa.int32()), pa.array([rng.choice("tb") for _ in texts])]
    names = ["id", "h", "len", "field", "words"]
    starts = ["an", "one", "one", "öl"]
    whole = [pa.RecordBatch.from_arrays([*heads, words], names=names).slice(3, 80) for words in (pa.array(texts, pa.list_(pa.string())), pa.array([strung(w) for w in texts]))]
    listed, as_text = ([x for out in kept._grouped(starts)([batch, batch.slice(0, 0)]) for x in out.to_pylist()] for batch in whole)
    assert listed == as_text and len(listed) > 20
    tokens = [x["token"] for x in as_text]
    assert tokens == sorted(tokens)


def test_memory_of_a_batch(monkeypatch):
    """Python's memory follows the words that are grouped at once, not the batch: under 36 bytes a word."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(kept, "WORDS", 1 << 17)
    rng = np.random.default_rng(3)
    words = np.array([f"w{n}" for n in range(5000)])
    texts = [words[(rng.pareto(1.0, 500) * 3).astype(int) % 5000].tolist() for _ in range(1000)]
    columns = [pa.array(range(1000)), pa.array(rng.integers(0, 2**62, 1000)), pa.array([500] * 1000, pa.int32()), pa.array(["t"] * 1000), pa.array(texts)]
    batch = pa.RecordBatch.from_arrays(columns, names=["id", "h", "len", "field", "words"])
    grouped = kept._grouped(["w1", "w1", "w2", "w7"])
    assert sum(sum(map(len, out.column("gaps").to_pylist())) for out in grouped([batch])) == 500_000
    tracemalloc.start()
    for _ in grouped([batch]):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 36 * kept.WORDS
