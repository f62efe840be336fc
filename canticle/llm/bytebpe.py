"""Byte-level BPE by overlapping chunks.

Texts up to ``chunk`` characters are encoded whole. Longer ones are cut into overlapping chunks. Only the seam of two
chunks is scanned for cuts: once from ``OVERLAP`` characters before the successor's start, once from that start, both to
near the end of the overlap. The first scan may begin inside a pre-token, so agreement of the two is a good sign only; what makes a cut
exact is :func:`fixed`: the first boundary on which both agree is taken only where no text before it can move it. The text between such places is a piece; pieces are encoded in parallel and their ids joined in order.
A chunk without such a place (one pre-token longer than the overlap) hands its text on to the next one.
Decoding concatenates the raw bytes of the ids.

Defined results: a null text is empty and has no ids. Null and repeated ids keep their rows. Empty tables give empty
results.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK, OVERLAP = 32_768, 512
#: Characters at the end of a chunk whose boundaries what follows could still move.
EDGE = 4


class Codec:
    """Ranks of a vocabulary file, made once in a Python worker."""

    made: dict[str, Codec] = {}

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.bytes_of = {rank: token for token, rank in ranks.items()}

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        if path not in cls.made:
            cls.made[path] = cls(path, pattern)
        return cls.made[path]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def boundaries(scan: regex.Pattern, text: str, start: int, stop: int) -> set[int]:
    """Ends of the pre-tokens of ``text`` from ``start`` on, up to ``stop``."""
    found = set()
    for match in scan.finditer(text, start):
        if match.end() > stop:
            break
        found.add(match.end())
    return found


KINDS = regex.compile(r"(\s)|(\p{L})|(\p{N})|(.)", regex.DOTALL)


def fixed(text: str, at: int) -> bool:
    """Whether a pre-token ends at ``at`` whatever comes before: the kind of character changes there, and neither
    white space (which looks ahead) nor an apostrophe (contractions) comes just before."""
    before = text[at - 1]
    kind = KINDS.match(before).lastindex
    return kind != 1 and before != "'" and kind != KINDS.match(text[at]).lastindex


def resync(scan: regex.Pattern, text: str, ahead: int) -> int | None:
    """First place after ``ahead`` where a scan from ``OVERLAP`` before it and one from ``ahead`` agree and no text before can move it."""
    stop = len(text) - EDGE
    own = boundaries(scan, text, max(0, ahead - OVERLAP), stop)
    for at in sorted(own & boundaries(scan, text, ahead, stop)):
        if at > ahead and fixed(text, at):
            return at
    return None


def chunk_pieces(long_docs: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(_row, doc_id, piece, text) of texts over ``chunk`` characters: what lies between places of resynchronisation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = regex.compile(pattern)
        for batch in batches:
            cuts = []
            for text, last in zip(batch.column("part"), batch.column("last"), strict=True):
                text = text.as_py()
                cuts.append(len(text) if last.as_py() else resync(scan, text, chunk))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cuts, pa.int32()), batch.column("part")], names=["_row", "doc_id", "k", "cut", "part"])

    n = F.ceil(F.char_length("text") / chunk).cast("int")
    parts = long_docs.select("_row", "doc_id", "text", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("k")).select(
        "_row", "doc_id", "k", F.expr(f"substring(text, k * {chunk} + 1, {chunk + overlap})").alias("part"), (F.col("k") == F.col("n") - 1).alias("last")
    )
    cut = parts.repartition("_row", "k").mapInArrow(run, "_row long, doc_id long, k int, cut int, part string")
    order = Window.partitionBy("_row", "doc_id").orderBy("k")
    # A piece starts where the chunk before was cut; a chunk that wasn't cut ends where its successor begins.
    before = F.lag(F.coalesce("cut", F.lit(-1)), 1, chunk).over(order)
    start = F.when(before < 0, F.lit(0)).otherwise(before - chunk)
    group = F.sum(F.when(before < 0, F.lit(0)).otherwise(F.lit(1))).over(order)
    text = F.expr("substring(part, begin + 1, coalesce(cut, %d) - begin)" % chunk)
    placed = cut.withColumn("begin", start).withColumn("piece", group)
    merged = placed.groupBy("_row", "doc_id", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", text.alias("t")))), lambda x: x["t"]), "").alias("text"))
    return merged.select("_row", "doc_id", "piece", "text")


def split_by_length(docs: DataFrame, id_col: str, text_col: str, pattern: str, chunk: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """(_row, doc_id, piece, text) of the texts encoded whole, and of the pieces of longer ones."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    long_docs = slim.where(F.char_length("text") > chunk).select(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()).alias("_row"), "doc_id", "text")
    short = slim.where(F.char_length("text") <= chunk).select(F.lit(None).cast("long").alias("_row"), "doc_id", F.lit(0).cast("long").alias("piece"), "text")
    return short, chunk_pieces(long_docs, pattern, chunk, overlap)


def encoder(path: str, pattern: str):
    """Batches of (_row, doc_id, piece, text) to batches of (_row, doc_id, piece, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # ids take several times the room of texts
                part = batch.slice(at, 256)
                ids = pa.array([codec.encode(t.as_py()) for t in part.column(3)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], ids], names=["_row", "doc_id", "piece", "ids"])

    return run


def digester(path: str, pattern: str):
    """Batches of (_row, doc_id, piece, ids), pieces of a row in order, to one digest row a text. Streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        words = {rank: str(rank) for rank in codec.bytes_of}
        key, n, joined, raw = None, 0, None, None
        for batch in batches:
            out = []
            for row, doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
                if key is None or row is None or key != (row, doc):
                    if key is not None:
                        out.append((key[1], n, joined.hexdigest(), raw.hexdigest()))
                    key, n, joined, raw = (row, doc), 0, hashlib.sha256(), hashlib.sha256()
                ids = ids.values.to_numpy().tolist()
                joined.update((" " * (n > 0 and len(ids) > 0) + " ".join(map(words.__getitem__, ids))).encode())
                raw.update(codec.decode(ids))
                n += len(ids)
            yield digest_rows(out)
        if key is not None:
            yield digest_rows([(key[1], n, joined.hexdigest(), raw.hexdigest())])

    return run


def digest_rows(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) if out else [()] * 4
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(_row, doc_id, piece, ids): token ids of every text, in one row (null _row) or, for long texts, in ordered pieces."""
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    short, long_ = split_by_length(docs, id_col, text_col, pattern, chunk, overlap)
    return short.unionByName(long_).mapInArrow(encoder(path, pattern), "_row long, doc_id long, piece long, ids array<int>")


def round_trips(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text encoded, and its ids decoded."""
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    encode, digest = encoder(path, pattern), digester(path, pattern)
    fields = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    short, long_ = split_by_length(docs, id_col, text_col, pattern, chunk, overlap)
    whole = short.mapInArrow(lambda batches: digest(encode(batches)), fields)
    pieces = long_.mapInArrow(encode, "_row long, doc_id long, piece long, ids array<int>")
    return whole.union(pieces.repartition("_row").sortWithinPartitions("_row", "doc_id", "piece").mapInArrow(digest, fields))


def op9_byte_bpe(spark, sf_dir):
    """Contract query 9: ids and decoded bytes of every document."""
    return round_trips(spark.read.parquet(f"{sf_dir}/documents.parquet"))
