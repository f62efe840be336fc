"""The contract queries as registered: their columns against brute force, and odd, empty and clashing tables."""

import hashlib
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from canticle.llm import bytebpe, lines, packing, quality, registry, sharding, simhash, similar, substring
from tests.llm.test_dedup import brute_components, brute_fingerprint, brute_substring
from tests.llm.test_judging import brute_counts

CLASHING = ("id", "a", "b", "crowd", "class", "_id", "_row", "_host", "_w", "_m", "_h", "_g", "_doc", "_site", "_text", "_gone", "_spans", "_arc", "_cell", "_place", "_key", "_rank", "_at", "_bucket", "_to", "_len", "_part", "_fold", "_toxic", "row", "host", "m", "fp", "key", "shard", "slot", "_n_lines_removed")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def folder(spark, documents, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('in')}"
    documents.write.parquet(f"{path}/documents.parquet")
    said = spark.createDataFrame([(1, 1, "assistant", "well [INST]"), (1, 0, "user", "so"), (2, 0, "assistant", None)], "conv_id long, turn long, role string, text string")
    said.write.parquet(f"{path}/conversations.parquet")
    labels = documents.select("doc_id", F.lit(1).alias("quality"), F.contains(F.coalesce("text", F.lit("")), F.lit("w7")).cast("int").alias("toxic"))
    labels.write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.collect()}


def rows(spark, folder, name):
    return {r[0]: r for r in registry.QUERIES[name](spark, folder).collect()}


def test_op1(spark, folder, texts):
    want = {d: (n, gone, sha(kept)) for d, (n, gone, kept) in brute_substring(texts.items(), 50).items()}
    assert {d: (r.n_words, r.n_removed, r.kept_sha256) for d, r in rows(spark, folder, "op1_substring_dedup").items()} == want


def test_op2(spark, folder, texts):
    got = rows(spark, folder, "op2_bounded_ring")
    assert {d: (r["size"], r.text_crc32, r.law, r.grown_shard) for d, r in got.items()} == {d: (len(t.encode()) + 1, zlib.crc32(t.encode()), "rows", None) for d, t in texts.items()}
    slots = defaultdict(list)
    for r in got.values():
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_op3(spark, folder, texts):
    got = rows(spark, folder, "op3_document_fingerprints")
    ids = sorted(texts)
    for k, d in enumerate(ids):
        t, after = texts[d], texts[ids[(k + 1) % len(ids)]]
        half = len(t) // 2
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), sha(t[: len(t) - half] + after[:half]))
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
        assert len(got[d].fingerprint) == (256 if t.split() else 0)
        if t == after:
            assert got[d].near_next == 1 and got[d].fingerprint == got[ids[k + 1]].fingerprint


def test_op5(spark, folder):
    got = rows(spark, folder, "op5_chat_formatting")
    said = "</s>[INST] ok [/INST]"
    of = {-1: [("user", said), ("assistant", said)], 1: [("user", "so"), ("assistant", "well [INST]")], 2: [("assistant", "")]}
    want = {}
    for c, turns in of.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        want[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss))
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == want


def test_op6(spark, folder, texts):
    got = registry.QUERIES["op6_best_fit_packing"](spark, folder).collect()
    ids = packing.WordIds.of(public_tokenizers.path("word_bpe_49k.json"))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == {
        (d, k): (at // 4, len(some) // 4, zlib.crc32(some)) for d, t in texts.items() for whole in [ids.encoded(t) + b"\1\0\0\0"] for k, at in enumerate(range(0, len(whole), 16384)) for some in [whole[at : at + 16384]]
    }


def test_op7(spark, folder, texts):
    got = rows(spark, folder, "op7_toxicity")
    assert {d: r.held_out for d, r in got.items()} == {d: zlib.crc32(str(d).encode()) % 5 == 0 for d in texts}
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())


def test_op8(spark, folder, texts):
    got = rows(spark, folder, "op8_quality_rules")
    assert {d: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for d, r in got.items()} == {d: brute_counts(t) for d, t in texts.items()}


def test_op9(spark, folder, texts):
    codec = bytebpe.Codec.of(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = rows(spark, folder, "op9_byte_bpe")
    for d, t in texts.items():
        ids = codec.encode(t)
        assert (got[d].n_tokens, got[d].ids_sha256, got[d].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(t))


def test_op10(spark, folder, texts):
    prints = {d: brute_fingerprint(t) for d, t in texts.items()}
    low = brute_components(prints, 3)
    got = rows(spark, folder, "op10_simhash_near_dedup")
    assert {d: (r.fingerprint, r.component_id) for d, r in got.items()} == {d: (f"{p:016x}", low[d]) for d, p in prints.items()}


@pytest.fixture(scope="module")
def clashing(spark, documents):
    """The fixture and odd rows, with columns named as operators name theirs on the way."""
    odd = spark.createDataFrame([(None, "one two three four five six", None, None, None), (None, None, None, None, None), (3, "repeated id", "en", "src1", 3), (3, "repeated id", "en", "src1", 3)], documents.schema)
    return documents.union(odd).select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])


@pytest.mark.parametrize("keep", [lines.without_boilerplate, substring.replaced_text, quality.keep_good, simhash.keep_one, similar.keep_one_similar, lambda d: sharding.sharded(d.withColumn("k", F.coalesce(F.col("doc_id"), F.lit(-1)).cast("string")), "k", 4, 8)])
def test_columns_of_the_input_come_through(clashing, keep):
    out = keep(clashing)
    replaced = {"shard", "slot", "_n_lines_removed"}
    for r in out.collect():
        assert all(r[c] == f"own {c}" for c in CLASHING if c not in replaced)
    assert len(set(out.columns)) == len(out.columns) and set(clashing.columns) <= set(out.columns)


@pytest.mark.parametrize("name", [*registry.QUERIES, "pipeline"])
def test_odd_and_empty_tables(spark, clashing, tmp_path, name):
    query = registry.QUERIES.get(name) or corpus_pipeline.run
    for kind, docs in (("odd", clashing), ("empty", clashing.limit(0))):
        path = f"file://{tmp_path}/{kind}"
        docs.write.parquet(f"{path}/documents.parquet")
        docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"), "_id", "_toxic").write.parquet(f"{path}/labels.parquet")
        docs.select(F.col("doc_id").alias("item_id"), "text", "_id").write.parquet(f"{path}/benchmark.parquet")
        docs.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), "text", "_id").write.parquet(f"{path}/conversations.parquet")
        found = query(spark, path).count()
        if kind == "empty":
            assert found == (1 if name.startswith("op5") else 0)
        elif name.startswith("op5"):
            assert found == docs.select("doc_id").distinct().count() + 1
        elif not name.startswith(("op6", "pipeline")):
            assert found == docs.count()
        else:
            assert found > 0
