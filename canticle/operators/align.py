"""Word alignment as Python table functions over a song's pieces and words, and folds over ordered events.

Spark partitions pieces and words by song and sorts them, pieces first; a table function holds the pieces of its song, looks through 25 of them for a
word, and gives rows as words go by. What built-in operators can express is in :mod:`canticle.operators.timeline` and
:mod:`canticle.operators.words`.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from math import floor

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canticle.functions import text as T
from canticle.plans.cut import written

LOOK_AHEAD, JOINED = 20, 5
#: Milliseconds: a word's length at least and at most, that of a song's last piece, and of a piece that two words share.
SHORTEST, LONGEST, LAST, SHARED = 50, 2000, 500, 300
SLACK, LEAST_HITS, LEAST_SHARE = 10, 2, 0.7
MATCHED = "song_id long, line_idx int, word_idx int, start_ms long, duration_ms long, piece string"


def _rounded(x: float) -> int:
    return floor(x + 0.5)


def _letters(text: str, n: int) -> int | None:
    """Where the first ``n`` letters and digits of a text end."""
    for k, c in enumerate(text):
        n -= ord(c) < 65536 and unicodedata.category(c)[0] in "LN"
        if not n:
            return k + 1
    return None


class Pieces:
    """The sung pieces of a song in order: start, text, token."""

    def __init__(self):
        self.start: list[float] = []
        self.text: list[str] = []
        self.token: list[str] = []

    def add(self, start: float, text: str, token: str) -> None:
        self.start.append(start)
        self.text.append(text)
        self.token.append(token)

    def window(self, at: int) -> range:
        return range(at, min(at + LOOK_AHEAD, len(self.token)))

    def found(self, token: str, at: int) -> tuple[int, int] | None:
        """(first, number) of the pieces that are a token: one, or up to five joined; the first in the window."""
        for j in self.window(at):
            if self.token[j] == token:
                return j, 1
            joined, k = self.token[j], j + 1
            while len(joined) <= len(token) and k < min(j + JOINED, len(self.token)) and len(self.token[j]) < len(token):
                joined += self.token[k]
                k += 1
                if joined == token:
                    return j, k - j
        return None

    def shared(self, first: str, second: str, at: int) -> tuple[int, int] | None:
        """(piece, place of the cut in its text) of the first piece in the window that is two tokens in one."""
        for j in self.window(at):
            if self.token[j] == first + second and (cut := _letters(self.text[j], len(first))):
                return j, cut
        return None


class Aligner:
    """Goes through the words of a song; a line is settled when the next one begins, which bounds its last word."""

    def __init__(self):
        self.pieces, self.at = Pieces(), 0
        self.song: int | None = None
        self.line: list[tuple] = []

    def eval(self, row) -> Iterator[tuple]:
        self.song = row["song_id"]
        if row["kind"] == 0:
            self.pieces.add(row["at"], row["said"], row["token"])
            return
        if self.line and self.line[0][0] != row["line_idx"]:
            yield from self.settled(row["at"])
        self.line.append((row["line_idx"], row["word_idx"], row["token"]))

    def terminate(self) -> Iterator[tuple]:
        yield from self.settled(None)

    def settled(self, next_line: float | None) -> Iterator[tuple]:
        words, self.line = self.line, []
        skip = False
        for k, (line, word, token) in enumerate(words):
            if skip or not token:
                skip = False
                continue
            p = self.pieces
            if hit := p.found(token, self.at):
                j, n = hit
                self.at = j + n
                start, end = p.start[j], p.start[j + n - 1] + LAST
                if self.at < len(p.start):
                    end = min(p.start[self.at], start + LONGEST)
                elif next_line is not None:
                    end = min(next_line, start + LONGEST)
                yield self.song, line, word, _rounded(start), max(SHORTEST, _rounded(end - start)), "".join(p.text[j : j + n])
            elif k + 1 < len(words) and words[k + 1][2] and (both := p.shared(token, words[k + 1][2], self.at)):
                j, cut = both
                self.at, skip = j + 1, True
                share = len(token) / len(p.token[j])
                yield self.song, line, word, _rounded(p.start[j]), SHARED, p.text[j][:cut]
                yield self.song, line, words[k + 1][1], _rounded(p.start[j] + SHARED * share), SHARED, p.text[j][cut:]


class Recoverer:
    """Seeks each block of words in all pieces of its song by the places of its tokens."""

    def __init__(self):
        self.pieces = Pieces()
        self.places: dict[str, list[int]] = defaultdict(list)
        self.song: int | None = None
        self.block: list[tuple] = []

    def eval(self, row) -> Iterator[tuple]:
        self.song = row["song_id"]
        if row["kind"] == 0:
            self.places[row["token"]].append(len(self.pieces.token))
            self.pieces.add(row["at"], row["said"], row["token"])
            return
        if self.block and self.block[0][0] != row["block"]:
            yield from self.settled()
        if row["token"]:
            self.block.append((row["block"], row["line_idx"], row["word_idx"], row["token"], row["at"]))

    def terminate(self) -> Iterator[tuple]:
        yield from self.settled()

    def best(self, tokens: list[str]) -> list[int]:
        """The pieces of the stretch that has most of the tokens in order, the first of equals. A stretch begins where the first token is sung."""
        best: list[int] = []
        for start in self.places.get(tokens[0], ()):
            hits = [start]
            for token in tokens[1:]:
                own = self.places.get(token, [])
                k = bisect_left(own, hits[-1] + 1)
                if k == len(own) or own[k] >= start + len(tokens) + SLACK:
                    break
                hits.append(own[k])
            if len(hits) > len(best):
                best = hits
        return best

    def settled(self) -> Iterator[tuple]:
        words, self.block = self.block, []
        if len(words) < LEAST_HITS:
            return
        hits = self.best([w[3] for w in words])
        if len(hits) < LEAST_HITS or len(hits) < LEAST_SHARE * len(words):
            return
        start, first = self.pieces.start, {}
        for (_, line, *_), j in zip(words, hits, strict=False):
            first[line] = min(first.get(line, start[j]), start[j])
        for (_, line, word, _, line_at), j in zip(words, hits, strict=False):
            length = start[j + 1] - start[j] if j + 1 < len(start) else LAST
            yield self.song, line, word, _rounded(start[j] + line_at - first[line]), _rounded(max(SHORTEST, min(length, LONGEST))), self.pieces.text[j]


def with_tokens(words: DataFrame, column: str) -> DataFrame:
    """Words with their levelled token, computed in the JVM."""
    return words.withColumn("token", T.lyric_token(words[column]))


def _merged(words: DataFrame, sung: DataFrame, block: str = "line_idx"):
    """Pieces, then words, of each song in order, as an argument of a table function."""
    none = F.lit(None)
    place = F.col("idx").cast("long") if "idx" in sung.columns else F.lit(0).cast("long")
    pieces = with_tokens(sung, "piece").select(
        F.col("song_id").cast("long").alias("song_id"), F.lit(0).alias("kind"), F.lit(0).alias("block"), none.cast("int").alias("line_idx"), none.cast("int").alias("word_idx"), F.col("start_ms").cast("double").alias("at"), place.alias("place"), F.col("piece").alias("said"), F.coalesce("token", F.lit("")).alias("token")
    )
    told = with_tokens(words, "word").select(
        F.col("song_id").cast("long").alias("song_id"), F.lit(1).alias("kind"), F.col(block).cast("int").alias("block"), F.col("line_idx").cast("int").alias("line_idx"), F.col("word_idx").cast("int").alias("word_idx"), F.col("line_ms").cast("double").alias("at"), F.lit(0).cast("long").alias("place"), F.col("word").alias("said"), F.coalesce("token", F.lit("")).alias("token")
    )
    order = ["kind", "line_idx", "word_idx", "at", "place", "said"]
    return pieces.union(told).asTable().partitionBy("song_id").orderBy(*order)


def aligned(words: DataFrame, sung: DataFrame) -> DataFrame:
    """Words (song_id, line_idx, word_idx, word, line_ms) with the start and length of the sung pieces (song_id, start_ms, piece; ``idx`` orders
    equal starts) that they match.

    Forward only: a word is sought in the next 20 pieces, whole or as up to five pieces joined; failing that, it and the next
    word of its line as one piece, whose second part starts later by its share. A length goes to the next piece or line, 50 to 2,000 ms.
    """
    return F.udtf(Aligner, returnType=MATCHED)(_merged(words, sung))


def coverage(words: DataFrame, found: DataFrame) -> DataFrame:
    """(song_id, words, matched, percent) of songs with words."""
    n = words.groupBy("song_id").agg(F.count("*").alias("words"))
    hits = found.groupBy("song_id").agg(F.count("*").alias("matched"))
    matched = F.coalesce("matched", F.lit(0)).cast("long")
    return n.join(hits, "song_id", "left").select("song_id", "words", matched.alias("matched"), (matched / F.col("words") * 100).alias("percent"))


def recovered(words: DataFrame, sung: DataFrame, found: DataFrame) -> DataFrame:
    """Matches for runs of lines without any in ``found``: each run is sought in all sung pieces of its song, in order, with ten pieces to spare; two
    words at least and 70 percent must be there. ``found`` is read once; pass a written table if it is used elsewhere. Times are shifted so that a line's first word found stands at the line's start."""
    lines = words.select("song_id", "line_idx").distinct()
    rank = F.dense_rank().over(Window.partitionBy("song_id").orderBy("line_idx"))
    matched = found.select("song_id", "line_idx").distinct().withColumn("hit", F.lit(True))
    numbered = lines.withColumn("nth", rank).join(matched, ["song_id", "line_idx"], "left").where("hit is null")
    run = F.col("nth") - F.row_number().over(Window.partitionBy("song_id").orderBy("line_idx"))
    blocks = numbered.withColumn("run", run).select("song_id", "line_idx", F.min("line_idx").over(Window.partitionBy("song_id", "run")).alias("block"))
    blocks = written(blocks, "blocks")
    sought = sung.join(blocks.select("song_id").distinct(), "song_id", "left_semi")  # other songs have nothing to seek
    return F.udtf(Recoverer, returnType=MATCHED)(_merged(words.join(blocks, ["song_id", "line_idx"]), sought, "block"))


def smoothed_chords(candidates: DataFrame, ratio: float = 1.15, least: float = 2.0) -> DataFrame:
    """Chords (song_id, tick, name, score) that take over: changed, at least ``least``, and better than the last accepted one
    by ``ratio``."""

    def one(c: pd.DataFrame) -> pd.DataFrame:
        keep, name, score = [], None, 0.0
        for k, row in enumerate(c.sort_values("tick")[["name", "score"]].itertuples(index=False)):
            if row.name != name and row.score >= least and row.score > score * ratio:
                keep.append(k)
                name, score = row.name, row.score
        return c.sort_values("tick").iloc[keep]

    return candidates.groupBy("song_id").applyInPandas(one, candidates.schema)
