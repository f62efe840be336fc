"""Interpolated modified Kneser-Ney language model of word pairs, counted in Spark and kept as sorted hash arrays.

1. Words are hashed to 48 bits. Tasks count their words; words with so many occurrences that one task couldn't hold their
   successors are told from the sums (few, by definition: ``HOT`` for each shard at most).
2. Tasks count the pairs of blocks of ``BLOCK_TOKENS`` tokens of training texts and send them, packed, to shards: by the hash of the first word, or, if that
   is hot, by the hash of the pair. A shard adds its counts up, writes its pairs as sorted arrays (hash, count) in the shared folder, and
   gives each word's share of what the discounts and the lower order need: how many successors it has once, twice and so on, and
   how many words it follows.
3. Spark adds these shares up by word. Counts of counts give the discounts (closed form of the modified method). The words are
   written as sorted arrays too: hash, count, weight of the lower order behind it, lower-order probability.
4. Workers map those arrays into memory and score texts block by block. A block's distinct words and pairs are looked up in the order of their
   hashes, so a page is read once a block; nothing of the model is copied into a worker, broadcast, or sent to the driver.

A model's order is two: arrays of triples and their shuffles would take over twice the disk that the corpus takes for pairs. The model
grows with the corpus. Where the shared folder is one that only Spark's file systems reach, workers fetch an array to an unlinked temporary
file before they map it.

Probabilities of all words of the training tokens and of one unknown word sum to 1 behind every word. The first token follows a
start, which is no token itself.

Defined results: a null text is empty and has one token, its end. A null id counts as an empty one when rows are held out. Repeated rows each count and each get
their row. With no training row every token is the unknown word, of probability 1. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canticle.plans.cut import fresh_path, scope, written

START, END = 0, 1
#: Tokens that a task holds at a time, bytes of text that it splits at a time, hot words for each shard.
BLOCK_TOKENS, BLOCK_BYTES, HOT = 1 << 21, 1 << 20, 4
FOLDS, HELD_OUT = 5, 1
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_LEVELS = ("n1", "n2", "n3", "n4", "n5")


def word_ids(words: list[bytes]) -> np.ndarray:
    """48-bit hashes; the two least values are the start and the end of a text."""
    return np.maximum(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) >> np.uint64(16), np.uint64(2)).view(np.int64)


def token_runs(text: str | None) -> Iterator[np.ndarray]:
    """The tokens of a text in parts, each from the last token of the part before on."""
    data, at, last = (text or "").encode().lower(), 0, START
    while at < len(data):
        found = _SPACE.search(data, at + BLOCK_BYTES) if len(data) - at > BLOCK_BYTES else None
        end = found.start() if found else len(data)
        ids = word_ids(data[at:end].split())
        final = [END] if end == len(data) else []
        yield np.concatenate([[last], ids, final])
        last, at = ids[-1] if len(ids) else last, end
    if not data:
        yield np.array([START, END])


def spread(x: np.ndarray) -> np.ndarray:
    """Well mixed 64 bits of each value."""
    x = x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def pair_ids(b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return spread(spread(b).view(np.int64) ^ c)


def shard_of(mixed: np.ndarray, shards: int) -> np.ndarray:
    return ((mixed >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def pair_shards(b: np.ndarray, pair: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    found = shard_of(spread(b), shards)
    if len(hot):
        at = np.isin(b, hot)
        found[at] = shard_of(pair[at], shards)
    return found


def six_bytes(x: np.ndarray) -> bytes:
    return x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<i8").ravel()


def token_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The token runs of a one-column table, so many at a time."""
    some, size = [], 0
    for batch in batches:
        for text in batch.column(0):
            for run in token_runs(text.as_py()):
                some.append(run)
                size += len(run)
                if size >= BLOCK_TOKENS:
                    yield some
                    some, size = [], 0
    if some:
        yield some


def sides(runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([r[:-1] for r in runs]), np.concatenate([r[1:] for r in runs])


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of a one-column table of texts, ends of texts among the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs in token_blocks(batches):
            word, n = np.unique(sides(runs)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(n)], names=["word", "n"])

    return texts.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def hot_words(counts: DataFrame, shards: int) -> np.ndarray:
    """Words with over 1 / (``HOT`` * ``shards``) of all tokens."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    return np.array([r[0] for r in counts.where(F.col("n") * (HOT * shards) > total).collect()], np.int64)


def packed_pairs(texts: DataFrame, hot: np.ndarray, shards: int) -> DataFrame:
    """(shard, b, run, c, n): for each block of tokens and each shard, its first words, how many pairs each has, second words, counts."""
    names = ["shard", "b", "run", "c", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs in token_blocks(batches):
            b, c = sides(runs)
            pair, at, n = np.unique(pair_ids(b, c), return_index=True, return_counts=True)
            b, c = b[at], c[at]
            shard = pair_shards(b, pair, hot, shards)
            order = np.lexsort((b, shard))
            b, c, n, shard = b[order], c[order], n[order].astype(np.uint32), shard[order]
            edge = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(shard))
            cols: list[list] = [[], [], [], [], []]
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                first = np.flatnonzero(np.diff(b[lo:hi], prepend=-1))
                each = np.diff(np.append(first, hi - lo)).astype(np.uint32)
                for col, x in zip(cols, (int(shard[lo]), six_bytes(b[lo:hi][first]), each.tobytes(), six_bytes(c[lo:hi]), n[lo:hi].tobytes()), strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(x, pa.binary()) for x in cols[1:])], names=names)

    return texts.mapInArrow(run, "shard int, b binary, run binary, c binary, n binary")


def put(root: str, name: str, array: np.ndarray) -> None:
    """An array as a file of the shared folder; whole or not at all, and the same from every attempt of a task."""
    at = urlparse(root)
    if at.scheme in ("", "file"):
        path = os.path.join(unquote(at.path), name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}"
        array.tofile(part)
        os.replace(part, path)
    else:
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(root)
        files.create_dir(path, recursive=True)
        with files.open_output_stream(f"{path}/{name}") as out:
            out.write(np.ascontiguousarray(array).data)


def mapped(root: str, name: str, kind: str, n: int) -> np.ndarray:
    """An array of the shared folder, mapped into memory."""
    if not n:
        return np.empty(0, kind)
    at = urlparse(root)
    if at.scheme in ("", "file"):
        return np.memmap(os.path.join(unquote(at.path), name), kind, "r", shape=(n,))
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(root)
    with files.open_input_stream(f"{path}/{name}") as data, tempfile.TemporaryFile() as own:
        while block := data.read(1 << 24):
            own.write(block)
        own.flush()
        return np.memmap(own, kind, "r", shape=(n,))


def shard_tables(packed: DataFrame, root: str, shards: int) -> DataFrame:
    """(word, t, n1 to n5, cc): of each shard, for its words the count as a first word, successors seen once to four times and more often,
    and predecessors. Rows with a negative word tell of a shard: its number, number of pairs and bytes of a count. Writes the pairs' arrays."""
    names = ["word", "t", *_LEVELS, "cc"]

    def told(shard: int, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        b, c, n = (np.concatenate([p[k] for p in parts]) for k in range(3))
        pair, at, which = np.unique(pair_ids(b, c), return_index=True, return_inverse=True)
        count = np.bincount(which, n, len(pair)).astype(np.int64)
        b, c = b[at], c[at]
        kind = np.min_scalar_type(int(count.max()))
        put(root, f"pairs-{shard:06d}.hash", pair)
        put(root, f"pairs-{shard:06d}.count", count.astype(kind))
        word, of = np.unique(b, return_inverse=True)
        t = np.bincount(of, count, len(word)).astype(np.int64)
        levels = [np.bincount(of, (count == k) if k < 5 else count >= 5, len(word)).astype(np.int64) for k in range(1, 6)]
        none = np.zeros(len(word), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (word, t, *levels, none)], names=names)
        word, cc = np.unique(c, return_counts=True)
        none = np.zeros(len(word), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (word, *[none] * 6, cc)], names=names)
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (-1 - shard, len(pair), kind.itemsize, 0, 0, 0, 0, 0)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for batch in batches:
            for shard, b, each, c, n in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                parts.setdefault(shard, []).append((np.repeat(from_six(b), np.frombuffer(each, np.uint32)), from_six(c), np.frombuffer(n, np.uint32)))
        for shard in sorted(parts):  # one, as rows are dealt by the shard's number
            yield from told(shard, parts.pop(shard))

    fields = ", ".join(f"{c} long" for c in names)
    return packed.repartitionById(shards, "shard").mapInArrow(run, fields)


def discounts(counts: list[int]) -> tuple[float, float, float]:
    """Of once, twice and more often seen, from the numbers of those seen once to four times. Where a number is 0, half the count."""
    n1, n2, n3, n4 = counts
    if not n1 or not n2 or not n3:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * up / of, 0.0), float(k)) for k, (of, up) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1))


def discounted(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    """Counts less their discounts."""
    return n - np.array([0.0, *d])[np.minimum(n, 3)]


@dataclass
class Model:
    """Where the arrays are and how long; bounded by the number of shards. ``tokens`` and ``words``: of the training texts, ends among them;
    ``unknown``: what the lower order gives a word never seen."""

    root: str
    shards: int
    tokens: int
    words: int
    pair_discounts: tuple[float, float, float]
    unknown: float
    hot: np.ndarray
    pairs: dict[int, tuple[int, int]] = field(default_factory=dict)
    vocabulary: dict[int, int] = field(default_factory=dict)

    def of_words(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of sorted words: the count as a first word, the weight of the lower order, the lower-order probability."""
        t, g, p = np.zeros(len(ids), np.int64), np.ones(len(ids)), np.full(len(ids), self.unknown)
        for shard, lo, hi in ranges(ids * self.shards >> 48):
            n = self.vocabulary.get(shard, 0)
            have = mapped(self.root, f"words-{shard:06d}.hash", "i8", n)
            at, hit = places(have, ids[lo:hi])
            for out, name, kind in ((t, "count", "i8"), (g, "weight", "f8"), (p, "lower", "f8")):
                out[lo:hi][hit] = mapped(self.root, f"words-{shard:06d}.{name}", kind, n)[at[hit]]
        return t, g, p

    def of_pairs(self, b: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """The counts of pairs, sorted by their hash."""
        shard = pair_shards(b, pair, self.hot, self.shards)
        order, out = np.argsort(shard, kind="stable"), np.zeros(len(pair), np.int64)
        for k, lo, hi in ranges(shard[order]):
            n, size = self.pairs.get(k, (0, 1))
            own = order[lo:hi]
            at, hit = places(mapped(self.root, f"pairs-{k:06d}.hash", "u8", n), pair[own])
            out[own[hit]] = mapped(self.root, f"pairs-{k:06d}.count", f"u{size}", n)[at[hit]]
        return out

    def scores(self, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of tokens c behind b: whether they are known, base and model log10 probability."""
        ids, at = np.unique(np.concatenate([b, c]), return_inverse=True)
        t, g, p = self.of_words(ids)
        first, second = at[: len(b)], at[len(b) :]
        pair, one, which = np.unique(pair_ids(b, c), return_index=True, return_inverse=True)
        n = discounted(self.of_pairs(b[one], pair), self.pair_discounts)[which]
        before = t[first]
        model = np.divide(n, before, out=np.zeros(len(n)), where=before > 0) + g[first] * p[second]
        seen = np.where(ids == END, t[np.searchsorted(ids, START)] if (ids == START).any() else self.texts(), t)[second]
        return seen > 0, np.log10((seen + 0.5) / (self.tokens + 0.5 * (self.words + 1))), np.log10(model)

    def texts(self) -> int:
        """Training texts: how often a start was seen."""
        return int(self.of_words(np.array([START]))[0][0])


def ranges(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, from, to) of equal neighbours."""
    edge = np.append(np.flatnonzero(np.diff(keys, prepend=-1)), len(keys))
    yield from ((int(keys[lo]), int(lo), int(hi)) for lo, hi in zip(edge[:-1], edge[1:], strict=True))


def places(have: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the wanted values are in a sorted array, and whether."""
    at = np.searchsorted(have, wanted)
    hit = at < len(have)
    hit[hit] = have[at[hit]] == wanted[hit]
    return at, hit


def word_arrays(vocabulary: DataFrame, model: Model, kinds: int, lower: tuple[float, float, float]) -> list:
    """Writes the words' arrays; (shard, words) of each. ``kinds``: distinct pairs."""
    names = ["shard", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for batch in batches:
            shard = batch.column(0).to_numpy()
            rest = [batch.column(k).to_numpy() for k in range(1, 9)]
            for k, lo, hi in ranges(shard):
                parts.setdefault(k, []).append([x[lo:hi] for x in rest])
        for shard, some in sorted(parts.items()):
            word, t, n1, n2, n3, n4, n5, cc = (np.concatenate(x) for x in zip(*some, strict=True))
            d1, d2, d3 = model.pair_discounts
            weight = np.divide(d1 * n1 + d2 * n2 + d3 * (n3 + n4 + n5), t, out=np.ones(len(t)), where=t > 0)
            for name, x in (("hash", word), ("count", t), ("weight", weight), ("lower", discounted(cc, lower) / max(kinds, 1) + model.unknown)):
                put(model.root, f"words-{shard:06d}.{name}", x)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(word)], pa.int64())], names=names)

    shard = F.shiftright(F.col("word") * model.shards, 48).cast("int").alias("shard")
    dealt = vocabulary.select(shard, "word", "t", *_LEVELS, "cc").repartitionById(model.shards, "shard").sortWithinPartitions("shard", "word")
    return dealt.mapInArrow(run, "shard int, n long").collect()


def trained(texts: DataFrame, shards: int | None = None) -> Model:
    """The model of a one-column table of texts; as many shards as shuffle partitions unless given."""
    spark = texts.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    root = fresh_path(spark, "language-model")
    with scope(spark):
        hot = hot_words(written(word_counts(texts), "word-counts"), shards)
        parts = shard_tables(packed_pairs(texts, hot, shards), root, shards)
        rows = written(parts.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("t", *_LEVELS, "cc")]), "vocabulary")
        words = rows.where("word >= 0")
        sums = words.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("t", *_LEVELS, "cc")], F.count_if(F.col("t") > 0).alias("v"), *[F.count_if(F.col("cc") == k).alias(f"c{k}") for k in (1, 2, 3, 4)], F.count_if(F.col("cc") > 2).alias("cm")).first()
        lower = discounts([sums[f"c{k}"] for k in (1, 2, 3, 4)])
        left = sum(d * k for d, k in zip(lower, (sums["c1"], sums["c2"], sums["cm"]), strict=True))
        unknown = left / sums["cc"] / (sums["v"] + 1) if sums["cc"] else 1.0
        model = Model(root, shards, sums["t"], sums["v"], discounts([sums[c] for c in _LEVELS[:4]]), unknown, hot)
        model.pairs = {-1 - r["word"]: (r["t"], r["n1"]) for r in rows.where("word < 0").collect()}  # a row for each shard
        model.vocabulary = dict(word_arrays(words, model, sums["cc"], lower))
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(id, n_tokens, n_known, base, score) of each row of (id, text)."""
    names = ["id", "n_tokens", "n_known", "base", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, known = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            base, score = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            rows: list[int] = []
            runs: list[np.ndarray] = []

            def settle() -> None:
                b, c = sides(runs)
                of = np.repeat(rows, [len(r) - 1 for r in runs])
                for out, x in zip((n, known, base, score), (np.ones(len(c)), *model.scores(b, c)), strict=True):
                    out += np.bincount(of, x, batch.num_rows).astype(out.dtype)
                rows.clear()
                runs.clear()

            size = 0
            for k, text in enumerate(batch.column(1)):
                for r in token_runs(text.as_py()):
                    rows.append(k)
                    runs.append(r)
                    size += len(r)
                    if size >= BLOCK_TOKENS:
                        settle()
                        size = 0
            if runs:
                settle()
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n, known, base, score))], names=names)

    return docs.mapInArrow(run, "id long, n_tokens long, n_known long, base double, score double")


def fold(id_: str, folds: int = FOLDS):
    """Which part of the rows an id belongs to."""
    return F.crc32(F.coalesce(F.col(id_).cast("string"), F.lit("")).cast("binary")) % folds


def with_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, held_out: int = HELD_OUT, shards: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; rows of part ``held_out`` are not learned from."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    model = trained(slim.where(fold("id", folds) != held_out).select("text"), shards)
    return scored(slim, model).select(
        F.col("id").alias("doc_id"), (fold("id", folds) == held_out).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score"
    )


def perplexity(scores: DataFrame) -> DataFrame:
    """``scores`` with each text's perplexity by token."""
    return scores.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op12_language_model(spark, sf_dir):
    """Contract query 12: base and model log10 probability of every document."""
    return with_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
