"""Alignment of lyric words with sung pieces: cases, and plain loops over all starts and windows."""

import random

from pyspark.sql import functions as F

from canticle import queries
from canticle.operators import align


def tables(spark, lines, pieces, song=1):
    """Lines of (start, text) and pieces of (start, text)."""
    words = [(song, k, n, w, at) for k, (at, text) in enumerate(lines) for n, w in enumerate(text.split())]
    return spark.createDataFrame(words, "song_id long, line_idx int, word_idx int, word string, line_ms long"), spark.createDataFrame([(song, k, at, p) for k, (at, p) in enumerate(pieces)], "song_id long, idx int, start_ms long, piece string")


def rows(df):
    return sorted((r.line_idx, r.word_idx, r.start_ms, r.duration_ms, r.piece) for r in df.collect())


def pieces_of(text, start=1000, step=400):
    return [(start + k * step, w) for k, w in enumerate(text.split())]


def test_cases(spark):
    cases = {
        "whole words": ([(0, "Hello, World!")], "hello world", [(0, 0, 1000, 400, "hello"), (0, 1, 1400, 500, "world")]),
        "joined": ([(0, "control it")], "con trol it", [(0, 0, 1000, 800, "control"), (0, 1, 1800, 500, "it")]),
        "five joined, six not": ([(0, "abcde uvwxyz")], "a b c d e u v w x y z", [(0, 0, 1000, 2000, "abcde")]),
        "shared": ([(0, "my pulse Before")], "my pulseBefore", [(0, 0, 1000, 400, "my"), (0, 1, 1400, 300, "pulse"), (0, 2, 1536, 300, "Before")]),
        "not shared over lines": ([(0, "pulse"), (900, "before")], "pulsebefore", []),
        "a whole match further on comes before a shared piece": ([(0, "a b")], "ab a b", [(0, 0, 1400, 400, "a"), (0, 1, 1800, 500, "b")]),
        "forward only": ([(0, "two one")], "one two", [(0, 0, 1400, 500, "two")]),
        "look ahead of twenty": ([(0, "z")], "x " * 19 + "z", [(0, 0, 1000 + 19 * 400, 500, "z")]),
        "not of twenty-one": ([(0, "z")], "x " * 20 + "z", []),
        "the next line bounds the last piece": ([(0, "one"), (1200, "else")], "one", [(0, 0, 1000, 200, "one")]),
        "fifty at least": ([(0, "one"), (1010, "else")], "one", [(0, 0, 1000, 50, "one")]),
        "empty tokens": ([(0, "... one -")], "one", [(0, 1, 1000, 500, "one")]),
    }
    for name, (lines, sung, want) in cases.items():
        assert rows(align.aligned(*tables(spark, lines, pieces_of(sung)))) == want, name
    words, sung = tables(spark, [(0, "a b c d")], [(0, "a"), (5000, "b")])
    assert rows(align.aligned(words, sung)) == [(0, 0, 0, 2000, "a"), (0, 1, 5000, 500, "b")]
    assert align.coverage(words, align.aligned(words, sung)).collect()[0][1:] == (4, 2, 50.0)


def loop_aligned(lines, pieces):
    """Plain indices, no class: tokens of one letter class, so levelling is the identity."""
    out, at = [], 0
    for k, (_, text) in enumerate(lines):
        words, n = text.split(), 0
        while n < len(words):
            hit = None
            for j in range(at, min(at + 20, len(pieces))):
                for many in range(1, 6):
                    if hit is None and j + many <= len(pieces) and "".join(p for _, p in pieces[j : j + many]) == words[n]:
                        hit = j, many
            if hit:
                j, many = hit
                at = j + many
                bound = pieces[at][0] if at < len(pieces) else lines[k + 1][0] if k + 1 < len(lines) else None
                length = pieces[at - 1][0] + 500 - pieces[j][0] if bound is None else min(bound - pieces[j][0], 2000)
                out.append((k, n, pieces[j][0], max(50, length), words[n]))
            elif n + 1 < len(words):
                pair = words[n] + words[n + 1]
                for j in range(at, min(at + 20, len(pieces))):
                    if pieces[j][1] == pair:
                        out.append((k, n, pieces[j][0], 300, words[n]))
                        out.append((k, n + 1, int(pieces[j][0] + 300 * len(words[n]) / len(pair) + 0.5), 300, words[n + 1]))
                        at, n = j + 1, n + 1
                        break
            n += 1
    return sorted(out)


def loop_recovered(lines, pieces, found):
    """Every start and every piece of its window, one by one."""
    hit = {x[0] for x in found}
    out, block = [], []
    for k in range(len(lines) + 1):
        if k < len(lines) and k not in hit:
            block += [(k, n, w) for n, w in enumerate(lines[k][1].split())]
            continue
        best = []
        for start in range(len(pieces)):
            got = []
            for j in range(start, min(len(pieces), start + len(block) + 10)):
                if len(got) < len(block) and pieces[j][1] == block[len(got)][2]:
                    got.append(j)
            if len(got) >= 2 and len(got) / len(block) >= 0.7 and len(got) > len(best):
                best = got
        for (line, n, _), j in zip(block, best, strict=False):
            low = min(pieces[x][0] for (own, _, _), x in zip(block, best, strict=False) if own == line)
            length = pieces[j + 1][0] - pieces[j][0] if j + 1 < len(pieces) else 500
            out.append((line, n, pieces[j][0] + lines[line][0] - low, max(50, min(2000, length)), pieces[j][1]))
        block = []
    return sorted(out)


def test_random_songs_equal_the_loops(spark):
    rng = random.Random(3)
    songs = {}
    for song in range(60):
        words = [rng.choice(["b", "bd", "d", "dg", "g", "k", "kb"]) for _ in range(rng.randint(0, 40))]
        lines = [(k * 3000, " ".join(words[k * 5 : k * 5 + 5])) for k in range(-(-len(words) // 5))]
        sung, at = [], 0
        for w in words if song % 3 else words[len(words) // 2 :] + words[: len(words) // 2]:
            at += rng.choice([30, 200, 900, 2500])
            sung += [(at, w)] if rng.random() < 0.7 or len(w) < 2 else [(at, w[0]), (at + 20, w[1:])] if rng.random() < 0.5 else [(at, w + "d")]
        songs[song] = lines, sung
    both = [tables(spark, lines, sung, song) for song, (lines, sung) in songs.items()]
    words, sung = both[0]
    for w, s in both[1:]:
        words, sung = words.union(w), sung.union(s)
    words, sung = spark.createDataFrame(words.collect(), words.schema), spark.createDataFrame(sung.collect(), sung.schema)
    found = spark.createDataFrame(align.aligned(words, sung).collect(), align.MATCHED)
    again = align.recovered(words, sung, found).collect()
    n = 0
    for song, (lines, pieces) in songs.items():
        want = loop_aligned(lines, pieces)
        assert rows(found.where(F.col("song_id") == song)) == want, song
        more = loop_recovered(lines, pieces, want)
        assert sorted((r.line_idx, r.word_idx, r.start_ms, r.duration_ms, r.piece) for r in again if r.song_id == song) == more, song
        n += len(more)
    assert n


def test_recovery_leaves_out_empty_tokens_and_shifts_times(spark):
    words, sung = tables(spark, [(5000, "x ... y"), (9000, "z")], pieces_of("q x y z", 20_000))
    none = spark.createDataFrame([], align.MATCHED)
    assert rows(align.recovered(words, sung, none)) == [(0, 0, 5000, 400, "x"), (0, 2, 5400, 400, "y"), (1, 0, 9000, 500, "z")]
    words, sung = tables(spark, [(0, "x")], pieces_of("x"))
    assert rows(align.recovered(words, sung, none)) == []


def test_the_query(spark):
    got = queries.QUERIES["aligned_lyrics"](spark, "/root/testdata/sf0.001").where("not recovered")
    n = queries.turn_words(spark, "/root/testdata/sf0.001").count()
    assert n * 0.4 < got.count() <= n and got.select("song_id", "line_idx", "word_idx").distinct().count() == got.count()


def test_recovery_reads_pieces_of_songs_with_unmatched_lines_alone(spark):
    words = spark.createDataFrame([(s, line, k, w, line * 1000) for s in (1, 2) for line in (0, 1) for k, w in enumerate(("some", "words"))], "song_id long, line_idx int, word_idx int, word string, line_ms long")
    sung = spark.createDataFrame([(s, 10 * k, w) for s in (1, 2) for k, w in enumerate(("some", "words"))], "song_id long, start_ms long, piece string")
    found = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "song_id long, line_idx int")
    got = align.recovered(words, sung, found)
    assert [(r.song_id, r.line_idx, r.word_idx, r.start_ms, r.piece) for r in got.orderBy("word_idx").collect()] == [(2, 1, 0, 1000, "some"), (2, 1, 1, 1010, "words")]
    assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()
