"""Packing, byte-level BPE, chat formatting and sharding against libraries, round trips and plain loops."""

import bisect
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from canticle.llm import bytebpe, chat, packing, sharding


@pytest.fixture(scope="module")
def codec():
    return bytebpe.Codec.of(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def digest(codec, text):
    ids = codec.encode(text)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


ODD_TEXTS = ["a" * 3000 + " \n\n\nx'" + "'re" * 300, " \n" * 900 + "b", "don't 12 " * 400, "x" * 200 + "  \n" * 77 + "é1" * 500, "", None, "   '́ll 日本語 " * 40]


def test_byte_bpe(spark, codec, documents):
    rows = [(k, t) for k, t in enumerate(ODD_TEXTS)] + [(100 + r.doc_id, r.text) for r in documents.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {k: digest(codec, t or "") for k, t in rows}
    for chunk, overlap in ((100, 40), (32_768, 512)):
        got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bytebpe.round_trips(df, chunk=chunk, overlap=overlap).collect()}
        assert got == want
    assert bytebpe.encoded(df).count() == len(rows)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab1' \n\té.,日", max_size=120), st.integers(5, 40))
def test_places_of_resynchronisation_don_t_change_ids(text, chunk):
    import regex

    scan = regex.compile(public_tokenizers.PATTERN)
    cut = bytebpe.resync(scan, text, chunk) if len(text) > chunk else None
    if cut is not None:
        codec = bytebpe.Codec.of(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
        assert codec.encode(text[:cut]) + codec.encode(text[cut:]) == codec.encode(text)


def test_pieces_are_the_library_s_ids(documents):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    whole.encode_special_tokens = True
    want = {}
    for r in documents.collect():
        ids = [*whole.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[r.doc_id, k] = (at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    got = packing.packed_documents(documents).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    check_packing(got, 4096)


@pytest.mark.parametrize("text", ["Don't STOP é É ß œ Ÿ ſ İ I'LL x<|endoftext|>y 12345 ½ á ﬁ …", "日本 Привет ÀÉÎ ŒUVRE ĸ ŉ ¿qué? ¡olé!", "a b c\x1cd"])
def test_word_ids(text):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    whole.encode_special_tokens = True
    ids = packing.WordIds.of(public_tokenizers.path("word_bpe_49k.json"))
    got = np.frombuffer(b"".join(ids[w] for w in text.encode().split()), "<u4").tolist()
    assert got == whole.encode(text, add_special_tokens=False).ids


def library_ids(texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    whole.encode_special_tokens = True
    return [np.array(whole.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_each_character_alone_and_in_words():
    texts = [f"a{c}b {c}{c} {c}'s x{c}'S 1{c}2 {c}" for c in map(chr, [*range(0x250), *range(0x2000, 0x2070), 0x3000, 0x65E5, 0xFEFF, 0xFB01, 0x1F600])]
    assert packing.WordIds.of(public_tokenizers.path("word_bpe_49k.json")).of_texts(pa.array(texts)).to_pylist() == library_ids(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.text(alphabet="abSTREvmD'19.,!éßİı日\u0301 \t\n\x0b\x1c\x85\xa0…", max_size=40), max_size=6), st.integers(0, 3))
def test_ids_of_slices_of_texts(texts, begin):
    ids = packing.WordIds.of(public_tokenizers.path("word_bpe_49k.json"))
    assert ids.of_texts(pa.array(texts, pa.string()).slice(begin)).to_pylist() == library_ids(texts[begin:])


def test_a_part_is_tokenized_once_and_common_ones_stay(monkeypatch):
    monkeypatch.setattr(packing, "HELD", 3_000)  # about 60 words
    ids, asked = packing.WordIds(public_tokenizers.path("word_bpe_49k.json")), Counter()
    tokenize = ids.tokenize
    monkeypatch.setattr(ids, "tokenize", lambda piece: (asked.update([piece]), tokenize(piece))[1])
    for k in range(40):
        rare = "".join(chr(97 + int(d)) for d in f"{k:03}")
        texts = [f"The the, THE. q{rare}x{chr(97 + j)} Q{rare}x{chr(97 + j)}!" for j in range(20)]
        assert ids.of_texts(pa.array(texts)).to_pylist() == library_ids(texts)
        assert len(ids.parts.strings) <= 100 and len(ids.words.strings) <= 100
    assert len(asked) > 800 and set(asked.values()) == {1}


def test_slices_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(packing, "SLICE", 10)
    texts = ["a" * n if n >= 0 else None for n in (3, 30, -1, 4, 6, 1, 0, 12, 2)]
    batch = pa.record_batch([pa.array(range(9)), pa.array(texts)], ["doc_id", "text"])
    parts = list(packing.slices(batch))
    assert [r for p in parts for r in p.column(0).to_pylist()] == list(range(9)) and [t for p in parts for t in p.column(1).to_pylist()] == texts
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 10 for p in parts)
    assert list(packing.slices(batch.slice(0, 0))) == []


def check_packing(rows, capacity):
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for places in seqs.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seqs)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), min_size=1, max_size=20))
def test_plans_hold_every_piece_once(counts):
    plan = packing.packing_plan(counts, 64)
    held = Counter()
    for lengths, n in plan:
        assert sum(lengths) <= 64 and n > 0
        for length in lengths:
            held[length] += n
    assert held == Counter(counts)
    assert sum(n for _, n in plan) <= 1.3 * -(-sum(a * b for a, b in counts.items()) // 64) + sum(n for k, n in counts.items() if 2 * k > 64) + 1


def test_plan_is_near_its_bound():
    rng = np.random.default_rng(0)
    counts = Counter(np.minimum(4096, rng.lognormal(6.3, 1, 60_000).astype(int) + 1).tolist())
    plan = packing.packing_plan(counts)
    bound = -(-sum(a * b for a, b in counts.items()) // 4096)
    assert sum(n for _, n in plan) <= 1.002 * bound + 1


def planted_packings():
    """Histograms of pieces cut from full sequences: by fixed triples, at random in three or four, and from few patterns."""
    rng = np.random.default_rng(1)
    yield Counter({2000: 30_000, 1000: 30_000, 1096: 30_000}), 30_000
    for patterns, times in ((20_000, 1), (20, 1_000), (200, 100)):
        found = Counter()
        for _ in range(patterns):
            cuts = np.sort(rng.choice(np.arange(1, 4096), rng.integers(2, 4), replace=False))
            for piece in np.diff([0, *cuts, 4096]).tolist():
                found[piece] += times
        yield found, patterns * times


def test_plans_of_perfect_packings_are_within_one_percent():
    for counts, perfect in planted_packings():
        plan = packing.packing_plan(counts)
        held = Counter()
        for lengths, n in plan:
            assert sum(lengths) <= 4096
            for length in lengths:
                held[length] += n
        assert held == counts
        assert perfect <= sum(n for _, n in plan) <= 1.01 * perfect


def test_the_dual_bound_and_plans_of_any_size():
    rng = np.random.default_rng(0)
    some = Counter(np.minimum(4096, rng.lognormal(6.3, 1, 20_000).astype(int) + 1).tolist())
    for times in (1, 100_000):
        counts = {length: n * times for length, n in some.items()}
        _, _, bound = packing.configurations(counts)
        assert bound <= sum(n for _, n in packing.packing_plan(counts)) <= 1.01 * bound
    _, _, bound = packing.configurations({2100: 500})  # more than tokens over capacity
    assert bound == 500


def test_a_vocabulary_of_another_kind_is_tokenized_whole(tmp_path):
    import json

    from tokenizers import Tokenizer

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        other = json.load(file)
    other["normalizer"]["normalizers"].pop()  # keeps capitals
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as file:
        json.dump(other, file)
    text = "Don't STOP É x<|endoftext|>y 12"
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    ids = packing.WordIds.of(path)
    assert not ids.by_words and packing.WordIds.of(public_tokenizers.path("word_bpe_49k.json")).by_words
    assert np.frombuffer(ids.of_text(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_packing_keeps_columns_with_clashing_names(spark):
    rows = [(k, 0, 1 + 37 * k % 4096, "a", "b", k % 3) for k in range(200)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length long, _len string, _part string, _rank int")
    got = packing.packed(pieces).collect()
    assert sorted((r.doc_id, r._len, r._part, r._rank) for r in got) == [(k, "a", "b", k % 3) for k in range(200)]
    check_packing(got, 4096)


def test_chats_round_trip(spark):
    rng = random.Random(3)
    bits = ["\\", "[", "<", "</s>", "[INST]", " [/INST]", "é", "\n", "a ", "<<SYS>>", "[/TURN]", "😀", ""]
    rows = [(rng.choice([1, 2, None, 7]), rng.choice([None, *range(40)]), rng.choice(["user", "assistant", "system", None, "too[l", ""]), rng.choice([None, "".join(rng.choices(bits, k=rng.randint(0, 12)))])) for _ in range(5000)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("formatted", F.lit(1))
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is None, t or 0, r or "", x or ""))
    want = {}
    for c, turns in by.items():
        turns.sort()
        said = [x for _, _, r, x in turns if r == "assistant"]
        want[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest(), sum(map(len, said)), hashlib.sha256("".join(said).encode()).hexdigest())
    fields = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    got = chat.formatted_chats(df).mapInArrow(chat.read_back, fields).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want
    assert chat.formatted_chats(df.limit(0)).mapInArrow(chat.read_back, fields).collect() == []


def test_ring_is_the_sequential_walk(spark):
    keys = [f"key {k}" for k in range(700)]
    df = spark.createDataFrame([(k, 0) for k in keys], "k string, shard int").withColumnRenamed("shard", "extra")
    nodes = sharding.ring(16, 32)
    places = [p for p, _ in nodes]
    for epsilon in (0.0, 0.1):
        capacity, filled, want = sharding.capacities(len(keys), 16, epsilon), [0] * 16, {}
        at = {k: int(hashlib.md5(k.encode()).hexdigest()[:15], 16) for k in keys}
        arc = {k: bisect.bisect_left(places, at[k]) % len(places) for k in keys}
        for k in sorted(keys, key=lambda k: (arc[k], at[k])):
            a = arc[k]
            while filled[nodes[a % len(nodes)][1]] >= capacity[nodes[a % len(nodes)][1]]:
                a += 1
            s = nodes[a % len(nodes)][1]
            want[k] = (s, filled[s])
            filled[s] += 1
        got = {r.k: (r.shard, r.slot) for r in sharding.sharded(df, "k", 16, 32, epsilon).collect()}
        assert got == want
        assert max(filled) <= max(capacity) and (epsilon or max(filled) - min(filled) <= 1)


def test_growth_moves_few_rows():
    keys = [f"key {k}" for k in range(20_000)]
    homes = []
    for shards in (16, 17):
        nodes = sharding.ring(shards, 128)
        places = [p for p, _ in nodes]
        loads, where = Counter(), {}
        for k in keys:
            where[k] = bisect.bisect_left(places, int(hashlib.md5(k.encode()).hexdigest()[:15], 16)) % len(places)
            loads[where[k]] += 1
        plan = sharding.walk([s for _, s in nodes], loads, sharding.capacities(len(keys), shards, 0.25))
        home = defaultdict(list)
        for arc, rank, shard, _ in plan:
            home[arc].append((rank, shard))
        seen, out = Counter(), {}
        for k in keys:
            out[k] = [s for r, s in home[where[k]] if r <= seen[where[k]]][-1]
            seen[where[k]] += 1
        homes.append(out)
    moved = sum(homes[0][k] != homes[1][k] for k in keys) / len(keys)
    assert moved < 0.12  # a fair share is 1/17


def test_odd_rows(odd):
    empty = odd.limit(0)
    assert len(packing.packed_documents(odd).collect()) == 7 and packing.packed_documents(empty).collect() == []
    assert len(bytebpe.round_trips(odd).collect()) == 7 and bytebpe.round_trips(empty).collect() == []
    keyed = odd.withColumn("_k", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
    got = sharding.sharded(keyed, "_k", 4, 8).collect()
    assert sorted(Counter(r.shard for r in got).values()) == [1, 2, 2, 2]
    assert sharding.sharded(keyed.limit(0), "_k").collect() == []


def moved_by_growth(spark, epsilon):
    rows = spark.range(20_000).select(F.concat(F.lit("key "), F.col("id")).alias("k"))
    a, b = ({r.k: r.shard for r in sharding.sharded(rows, "k", n, 128, epsilon).collect()} for n in (16, 17))
    moved = [k for k in a if a[k] != b[k]]
    return len(moved) / len(a), sum(b[k] != 16 for k in moved) / len(a)


def test_growth_as_shipped_moves_few_rows(spark):
    all_, between_old = moved_by_growth(spark, 0.0)
    assert 1 / 17 <= all_ < 0.09 and between_old < 0.03
    all_, between_old = moved_by_growth(spark, 0.25)
    assert all_ < 0.08 and between_old < 0.005


def test_ranks_are_counted_in_cells(spark, monkeypatch):
    df = spark.range(3_000).select(F.concat(F.lit("key "), F.col("id") % 2_900).alias("k"), F.lit("x").alias("_row"), F.lit(1).alias("_arc"))
    want = {(r.k, r.shard, r.slot) for r in sharding.sharded(df, "k", 16, 8).collect()}
    monkeypatch.setattr(sharding, "CELL_ROWS", 10)
    assert {(r.k, r.shard, r.slot) for r in sharding.sharded(df, "k", 16, 8).collect()} == want and len(want) == 3_000


def test_a_very_long_turn_takes_a_small_multiple_of_its_size():
    import subprocess
    import sys

    code = """
import resource, pyarrow as pa
from canticle.llm import chat
text = pa.array(["short", "[a" + "long text, " * 9_500_000, "last"])
batch = pa.RecordBatch.from_arrays([pa.array([1, 1, 1]), pa.array(["user", "assistant", "user"]), text], names=["conv_id", "role", "text"])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
pieces = list(chat.format_batches(iter([batch])))
row, = [r for b in chat.read_back(iter(pieces)) for r in b.to_pylist()]
assert row["n_turns"] == 3 and row["loss_chars"] == len(text[1].as_py()), row
print(len(pieces), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) == 3 and int(out[1]) < 1000


def test_batches_are_bounded_by_bytes(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(chat, "BYTES", 100)
    texts = ["a" * 30, "b" * 500, "", "c" * 60, "d" * 39, "e" * 2]
    batch = pa.RecordBatch.from_arrays([pa.array([1] * 6), pa.array([""] * 6), pa.array(texts)], names=["conv_id", "role", "text"])
    assert [b.num_rows for b in chat.bounded(batch)] == [1, 1, 3, 1]
    assert [t for b in chat.bounded(batch) for t in b.column(2).to_pylist()] == texts
