"""Best-fit packing of token sequences by a configuration linear program.

Documents become token ids in Arrow batches; longer ones than ``capacity`` are cut. The only thing the plan needs
is how many pieces have each length: a histogram of at most ``capacity`` rows. On it the driver solves the
configuration program (how often to use each multiset of lengths that fits a sequence) and rounds it:

1. Every length has a weight; a configuration is used in proportion to the product of its lengths' weights, less for
   the room that it leaves. A knapsack dynamic program over the free room prices *all* configurations at once
   (:func:`expected_uses`): it gives the mean number of pieces of each length in a sequence. Weights are multiplied by demand
   over coverage until these averaged configurations cover every length to ``COVER``.
2. The logarithms of the weights are dual prices; a knapsack with them bounds the optimum from below
   (:func:`least_sequences`). Multiplying ends once the averaged program is within ``GAP`` of the bound, or after ``STEPS``.
3. Rounding: configurations are drawn from the program (``DRAWN`` at most, each used equally often) and taken as far as
   pieces are left; the program is solved again for the rest, until drawing places few. Best fit places what
   remains, many equal pieces at a time. Work and memory of the driver depend on ``capacity``, not on the number of pieces.

Pieces then find their place by their rank within their length. Ranks are counted in parts of about ``PART_ROWS`` rows, so a
length that a third of all pieces share is not one task.

Tokens follow the vocabulary file's notes: strings of special tokens in a text are ordinary text (``encode_special_tokens``).

Defined results: a null or empty text is the single end id. Null and repeated ids keep their rows. Empty tables
give empty results. Of extra columns, :func:`packed` keeps all, whatever their names.
"""

from __future__ import annotations

import json
from array import array
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canticle.plans.cut import written
from canticle.plans.names import unused

CAPACITY = 4096
END_ID = 1
#: Rows of one part of a length, and the most parts beyond one for each length.
PART_ROWS, PARTS_MOST = 1_000, 200_000
#: The program: coverage in which weights settle, gap to the dual bound, steps of weights, and configurations drawn at a time.
COVER, GAP, STEPS, DRAWN = 0.02, 0.005, 60, 20_000
#: Bytes of text (one text at least) whose ids are in memory at a time; bytes of words, and of their parts, that a worker holds with their ids.
SLICE, HELD = 4 << 20, 16 << 20

#: What a vocabulary must say of itself for words to be tokenized one by one; by any other, texts are tokenized whole.
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Characters that this normalizer only lowers, and its pre-tokenizer over them in lower case.
PLAIN = "[!-~À-ÖØ-öø-įıĴ-ňŊ-ž]+"
PARTS = "'s|'t|'re|'ve|'m|'ll|'d|[a-zÀ-ž]+|[0-9]|[^a-z0-9À-ž]+"


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next free one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b if b in own else next(free)) for b in range(256)]


def joined(ids: pa.LargeBinaryArray, lists: pa.ListArray) -> pa.LargeBinaryArray:
    """The ids of each list's members (``ids``, all in a row), one after the other."""
    ends = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset :][lists.offsets.to_numpy()]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends), ids.buffers()[2]])


class Known:
    """Distinct strings to the bytes of their ids; only those not held are made.

    Once ``HELD`` bytes are held, those of the last call alone stay: common strings are among them, however many rare ones passed.
    """

    def __init__(self, make: Callable[[pa.StringArray], pa.LargeBinaryArray]):
        self.make, self.strings, self.ids = make, pa.array([], pa.string()), pa.array([], pa.large_binary())

    def of(self, strings: pa.StringArray) -> pa.LargeBinaryArray:
        at = pc.index_in(strings, self.strings)
        new = strings.filter(at.is_null())
        place = at.fill_null(-1).to_numpy().astype(np.int64)
        place[place < 0] = len(self.ids) + np.arange(len(new))
        ids = pa.concat_arrays([self.ids, self.make(new)])
        found = ids.take(pa.array(place))
        if self.strings.nbytes + new.nbytes + ids.nbytes <= HELD:
            self.strings, self.ids = pa.concat_arrays([self.strings, new]), ids
        else:
            self.strings, self.ids = strings, found
        return found

    def of_lists(self, lists: pa.ListArray) -> pa.LargeBinaryArray:
        """The ids of each list's strings, one after the other."""
        coded = lists.flatten().dictionary_encode()
        return joined(self.of(coded.dictionary).take(coded.indices), lists)


class WordIds:
    """Texts to the bytes of their ids (little-endian, 32 bits), by the tokenizers library.

    No token of a vocabulary that says ``BY_WORDS`` spans white space, so a text's ids are those of its words, and those of plain
    words are their parts'. Each distinct one of a slice of texts is looked up once. A worker keeps one for all its tasks.
    """

    made: dict[str, WordIds] = {}

    @classmethod
    def of(cls, path: str) -> WordIds:
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        self.by_words = all(told[k] == v for k, v in BY_WORDS.items())
        self.letters, self.tokenize = byte_letters(), self.whole.model.tokenize
        self.words, self.parts = Known(self.of_words), Known(self.of_parts)

    def __getitem__(self, word: bytes) -> bytes:
        return self.of_text(word.decode())

    def of_text(self, text: str) -> bytes:
        return self.of_texts(pa.array([text], pa.string()))[0].as_py()

    def of_texts(self, texts: pa.StringArray) -> pa.LargeBinaryArray:
        """The ids of each text; null ones have none."""
        texts = texts.fill_null("")
        return self.words.of_lists(pc.ascii_split_whitespace(texts)) if self.by_words else self.encoded_each(texts)

    def encoded(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def encoded_each(self, texts: pa.StringArray) -> pa.LargeBinaryArray:
        return pa.array([self.encoded(t.as_py()) for t in texts], pa.large_binary())

    def of_words(self, words: pa.StringArray) -> pa.LargeBinaryArray:
        plain = pc.match_substring_regex(words, f"^{PLAIN}$")
        marked = pc.replace_substring_regex(pc.utf8_lower(words.filter(plain)), PARTS, r"\0 ")
        by_parts = self.parts.of_lists(pc.ascii_split_whitespace(marked))
        odd = pc.invert(plain)
        ids = pa.concat_arrays([by_parts, self.encoded_each(words.filter(odd))])
        return ids.take(pa.array(np.argsort(np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable"))))

    def of_parts(self, parts: pa.StringArray) -> pa.LargeBinaryArray:
        return pa.array([self.of_part(piece) for piece in parts.to_pylist()], pa.large_binary())

    def of_part(self, piece: str) -> bytes:
        text = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
        return array("I", [t.id for t in self.tokenize(text)]).tobytes()


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of (key, text) in slices of ``SLICE`` bytes of text, or of one row."""
    upto = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy().astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE, "right")))
        yield batch.slice(at, end - at)
        at = end


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids): each text's ids and the end id, cut at ``capacity``; ids are little-endian."""
    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    names = ["doc_id", "piece", "start", "length", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = WordIds.of(path)
        end = array("I", [END_ID]).tobytes()
        for batch in (part for whole in batches for part in slices(whole)):
            out: list[tuple] = []
            for key, of_text in zip(batch.column(0).to_pylist(), ids_of.of_texts(batch.column(1)), strict=True):
                ids = of_text.as_py() + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((key, piece, at // 4, len(part) // 4, part))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=names)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def most_worth(price: np.ndarray, capacity: int) -> float:
    """Knapsack: the most that a sequence can hold. ``price`` has one entry per length from 0 on; absent lengths have 0."""
    lengths = np.flatnonzero(price)
    worth, best = price[lengths], np.zeros(capacity + 1)
    ends = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for size in range(1, capacity + 1):
        best[size] = best[size - 1]
        if ends[size]:
            best[size] = max(best[size], (best[size - lengths[: ends[size]]] + worth[: ends[size]]).max())
    return float(best[capacity])


def least_sequences(lengths: np.ndarray, need: np.ndarray, price: np.ndarray, capacity: int) -> float:
    """Dual bound: no packing has fewer sequences than what all pieces are worth over the most that one can hold."""
    value = np.zeros(capacity + 1)
    value[lengths] = price
    return float(need @ price) / most_worth(value, capacity)


def level(weight: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``weight * g ** lengths`` with the ``g`` that makes their sum 1, so that sums over configurations stay in range."""
    low, high = -50.0, 50.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (low, mid) if (weight * np.exp(np.clip(mid * lengths, -700, 700))).sum() > 1 else (mid, high)
    return weight * np.exp(np.clip(low * lengths, -700, 700))


def expected_uses(weight: np.ndarray, lengths: np.ndarray, room: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean pieces of each length in a sequence, and the weight of all ways to fill each free room.

    ``filled[s]`` sums, over all orders of lengths that take ``s`` tokens, the product of their weights; ``room[s]`` is the factor
    for leaving ``s`` tokens free.
    """
    back, filled = np.zeros(capacity + 1), np.zeros(capacity + 1)
    back[capacity - lengths] = weight
    filled[0] = 1.0
    for size in range(1, capacity + 1):
        filled[size] = back[capacity - size : capacity] @ filled[:size]
    ways = np.convolve(filled, room)[: capacity + 1]
    return weight * np.convolve(filled, ways)[capacity - lengths] / ways[capacity], ways


def solved(lengths: np.ndarray, need: np.ndarray, weight: np.ndarray, room: np.ndarray, capacity: int, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Weights under which averaged configurations cover ``need``; the ways to fill each room; sequences; the dual bound."""
    tokens = float(lengths @ need)
    bound = max(tokens / capacity, least_sequences(lengths, need, lengths.astype(float), capacity))
    for step in range(steps):
        weight = level(weight, lengths)
        each, ways = expected_uses(weight, lengths, room, capacity)
        times = tokens / float(lengths @ each)
        if float(lengths @ np.abs(times * each - need)) <= COVER * tokens:
            price = np.maximum(0.0, lengths - np.log(np.maximum(weight, 1e-300)) / np.log(room[1]))
            bound = max(bound, least_sequences(lengths, need, price, capacity)) if step % 8 == 0 else bound
            if times <= (1 + GAP) * bound:
                break
        weight = weight * np.clip(np.divide(need, times * each, out=np.full(len(need), 100.0), where=each > 0), 0.01, 100.0) ** 0.5
    return weight, ways, times, bound


def drawn(weight: np.ndarray, lengths: np.ndarray, ways: np.ndarray, room: np.ndarray, capacity: int, n: int, rng: np.random.Generator) -> list[np.ndarray]:
    """``n`` configurations, each drawn in proportion to its use: free room after free room, all sequences with one room together."""
    dense = np.zeros(capacity + 1)
    dense[lengths] = weight
    at: dict[int, list[np.ndarray]] = {capacity: [np.arange(n)]}
    owners, taken = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for size in range(capacity, 0, -1):
        if size not in at:
            continue
        own = np.concatenate(at.pop(size))
        upto = np.cumsum(dense[1 : size + 1] * ways[size - 1 :: -1])
        length = np.searchsorted(upto, rng.random(len(own)) * (upto[-1] + room[size]), "right") + 1
        own, length = own[length <= size], length[length <= size]  # beyond: the room stays free
        owners.append(own)
        taken.append(length)
        order = np.argsort(length, kind="stable")
        own, length = own[order], length[order]
        first = np.flatnonzero(np.diff(length, prepend=-1))
        for some, one in zip(np.split(own, first[1:]), length[first].tolist(), strict=False):
            at.setdefault(size - one, []).append(some)
    owner, length = np.concatenate(owners), np.concatenate(taken)
    order = np.lexsort((-length, owner))
    return np.split(length[order], np.flatnonzero(np.diff(owner[order])) + 1)


def configurations(counts: dict[int, int], capacity: int = CAPACITY, seed: int = 0) -> tuple[list[tuple[tuple, int]], Counter, float]:
    """[(lengths of one sequence, sequences)] rounded from the program, the pieces that it leaves, and the dual bound."""
    rng = np.random.default_rng(seed)
    left, plan, bound = Counter({length: n for length, n in counts.items() if n}), Counter(), 0.0
    tokens = sum(length * n for length, n in left.items())
    room = np.exp(-np.arange(capacity + 1) * 512 / capacity)
    lengths = np.array(sorted(left), np.int64)
    weight = np.array([left[length] / left.total() for length in lengths.tolist()], float)
    while len(lengths):
        need = np.array([left[length] for length in lengths.tolist()], float)
        weight, ways, times, least = solved(lengths, need, weight, room, capacity, STEPS if not bound else 8)
        bound = bound or least
        n = int(min(DRAWN, np.ceil(times)))
        uses, placed = max(1, int(times) // n), 0
        for lengths_of in drawn(weight, lengths, ways, room, capacity, n, rng):
            config = Counter(lengths_of.tolist())
            some = min([uses, *(left[length] // k for length, k in config.items())])
            if config and some:
                for length, k in config.items():
                    left[length] -= some * k
                plan[tuple(config.elements())] += some
                placed += some
        if placed < 0.1 * n * uses or sum(length * k for length, k in left.items()) < 0.001 * tokens:
            break
        keep = np.array([left[length] > 0 for length in lengths.tolist()])
        lengths, weight = lengths[keep], weight[keep]
    return list(plan.items()), +left, bound


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple, int]]:
    """[(lengths of one sequence, sequences)]: together they hold every piece of the histogram once."""
    plan, left, _ = configurations(counts, capacity)
    groups: dict[int, list[list]] = defaultdict(list)  # by free space: [lengths, sequences]
    for config, times in plan:
        groups[capacity - sum(config)].append([config, times])
    spaces = sorted(groups)

    def put(space: int, lengths: tuple, n: int) -> None:
        if space not in groups or not groups[space]:
            if bisect_left(spaces, space) == len(spaces) or spaces[bisect_left(spaces, space)] != space:
                insort(spaces, space)
        groups[space].append([lengths, n])

    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            at = bisect_left(spaces, length)
            if at == len(spaces):  # no open sequence has room
                each = capacity // length
                if n >= each:
                    put(capacity - each * length, (length,) * each, n // each)
                if n % each:
                    put(capacity - (n % each) * length, (length,) * (n % each), 1)
                break
            space = spaces[at]
            lengths, have = groups[space].pop()
            some = min(n, have)
            if have > some:
                groups[space].append([lengths, have - some])
            if not groups[space]:
                spaces.pop(at)
            put(space - length, (*lengths, length), some)
            n -= some
    return [(lengths, n) for space in sorted(groups) for lengths, n in groups[space]]


def plan_segments(plan: list[tuple[tuple, int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces of that length a sequence, offset), sorted."""
    rank: Counter = Counter()
    rows, sequence = [], 0
    for lengths, n in plan:
        offset = 0
        for length, times in sorted(Counter(lengths).items(), reverse=True):
            rows.append((length, rank[length], sequence, times, offset))
            rank[length] += n * times
            offset += times * length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def packed(pieces: DataFrame, capacity: int = CAPACITY, length_col: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``. ``pieces`` is read several times: pass a written table."""
    names = [f.name for f in pieces.schema.fields]
    len_, part_, parts_, rank_ = unused(pieces, "len", "part", "parts", "rank")
    sized = pieces.withColumn(len_, F.col(length_col).cast("long"))
    totals = {r[0]: r[1] for r in sized.groupBy(len_).count().collect()}  # at most capacity rows
    each = max(PART_ROWS, -(-sum(totals.values()) // PARTS_MOST))
    share = pieces.sparkSession.createDataFrame([(length, -(-n // each)) for length, n in totals.items()], f"`{len_}` long, `{parts_}` long")
    dealt = sized.join(F.broadcast(share), len_).withColumn(part_, F.pmod(F.xxhash64(*order), F.col(parts_)))
    sizes = written(dealt.groupBy(len_, part_).count(), "lengths")  # at most capacity + PARTS_MOST rows
    counts: Counter = Counter()
    first: dict[tuple[int, int], int] = {}
    for length, part, n in sorted(sizes.collect()):
        first[length, part] = counts[length]
        counts[length] += n
    segments = plan_segments(packing_plan(dict(counts), capacity))
    width = max(40, max(counts.values(), default=0).bit_length())
    starts = (segments[:, 0] << width) + segments[:, 1]
    bases = np.array([[length, part, n] for (length, part), n in first.items()], np.int64).reshape(-1, 3)
    base_keys = (bases[:, 0] << 32) + bases[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, part, within = (batch.column(len(names) + k).to_numpy() for k in range(3))
            rank = bases[np.searchsorted(base_keys, (length << 32) + part), 2] + within - 1
            seg = segments[np.searchsorted(starts, (length << width) + rank, "right") - 1] if len(segments) else np.zeros((0, 5), np.int64)
            nth = rank - seg[:, 1]
            places = [pa.array(seg[:, 2] + nth // seg[:, 3]), pa.array(seg[:, 4] + nth % seg[:, 3] * length)] if len(segments) else [pa.array([], pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *places], names=[*names, "sequence_id", "offset"])

    rank = F.row_number().over(Window.partitionBy(len_, part_).orderBy(*order)).cast("long").alias(rank_)
    ranked = dealt.select(*names, len_, part_, rank)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def packed_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    pieces = token_pieces(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packed(written(pieces, "pieces"))


def op6_best_fit_packing(spark, sf_dir):
    """Contract query 6: the place of every piece."""
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
