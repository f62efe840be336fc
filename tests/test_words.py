"""Words from syllables and scores merged into lyric texts, against loops that go through them one by one."""

import random
from fractions import Fraction

import pytest

from canticle.operators import words as W


def loop_words(syllables):
    """(tick, word) by the rules, syllable after syllable."""
    out, word, tick, hyphen = [], "", None, False
    texts = [t.strip() for _, t in syllables]
    for k, (at, _) in enumerate(syllables):
        t = texts[k]
        if not t:
            continue
        if t == "-":
            hyphen = True
            continue
        lead, trail = t[0] == "-", t[-1] == "-"
        goes_on = lead or (hyphen and (trail or "a" <= t[0] <= "z"))
        if not goes_on and word and tick is not None:
            out.append((tick, word))
            word, tick = "", None
        tick = at if tick is None else tick
        hyphen = trail
        word += t[1 if lead else 0 :][: -1 if trail else None] if t != "-" else ""
        if not trail and (texts[k + 1] if k + 1 < len(texts) else "") != "-":
            out.append((tick, word))
            word, tick = "", None
    return out + ([(tick, word)] if word else [])


CASES = {
    "one": (["hel-", "lo"], ["hello"]),
    "bare": (["hel", "-", "lo", "you"], ["hello", "you"]),
    "leading": (["hel", "-lo"], ["hel", "lo"]),
    "both": (["e-", "-lse-", "-where"], ["elsewhere"]),
    "capital closes": (["lse-", "Be", "now"], ["lse", "Be", "now"]),
    "capital with a hyphen goes on": (["lse-", "Be-", "low"], ["lseBelow"]),
    "capital with a hyphen in front goes on": (["lse-", "-Be"], ["lseBe"]),
    "capital after a bare hyphen": (["hel", "-", "Lo"], ["hel", "Lo"]),
    "open at the end": (["hel-"], ["hel"]),
    "bare at the end": (["hel", "-"], ["hel"]),
    "blank parts": (["hel", "", "-", "lo"], ["hel", "lo"]),
    "blank inside": (["hel-", " ", "lo"], ["hello"]),
    "empty": (["--", "Be", "so-", "--", "Be"], ["Be", "so", "Be"]),
}


@pytest.fixture(scope="module")
def songs():
    rng = random.Random(6)
    made = [[rng.choice(["la-", "lo", "-", "-ta-", "-na", "", " ", "Be", "be", "X-", "--", "é", "-É"]) for _ in range(rng.randint(0, 14))] for _ in range(400)]
    return [list(enumerate(texts, 100)) for texts, _ in CASES.values()] + [[(k * 10, t) for k, t in enumerate(x)] for x in made]


def rows(songs):
    return [(s, k, tick, t) for s, own in enumerate(songs) for k, (tick, t) in enumerate(own)]


def by_song(df, n):
    out = [[] for _ in range(n)]
    for r in sorted(df.collect(), key=lambda r: (r.song_id, r.word_idx)):
        assert r.word_idx == len(out[r.song_id])
        out[r.song_id].append((r.tick, r.word))
    return out


def test_syllables_to_words(spark, songs):
    got = by_song(W.built_words(spark.createDataFrame(rows(songs), "song_id int, idx int, tick int, text string")), len(songs))
    for name, (texts, want), own in zip(CASES, CASES.values(), got, strict=False):
        assert [w for _, w in own] == want, (name, texts)
    assert got == [loop_words(own) for own in songs]


def test_score_syllables_to_words(spark, songs):
    def loop(own):
        out, text, at = [], "", None
        for tick, t in own:
            at = tick if at is None else at
            t = t.strip()
            text += t.removesuffix("-")
            if not t.endswith("-"):
                out.append((at, text))
                text, at = "", None
        return out + ([(at, text)] if text else [])

    got = by_song(W.score_words(spark.createDataFrame(rows(songs), "song_id int, idx int, tick int, text string")), len(songs))
    assert got == [loop(own) for own in songs]


def loop_seconds(tick, tempos, ppq=960):
    """Exact seconds of a tick; tempos in order."""
    own = sorted(tempos, key=lambda t: t[0]) or [(0, 120)]
    if own[0][0] > 0:
        own.insert(0, (0, own[0][1]))
    at, pos, bpm, k = Fraction(0), 0, own[0][1], 0
    while k + 1 < len(own) and own[k + 1][0] <= tick:
        at += Fraction((own[k + 1][0] - pos) * 60, bpm * ppq)
        pos, bpm, k = own[k + 1][0], own[k + 1][1], k + 1
    return at + Fraction((tick - pos) * 60, bpm * ppq)


def test_ticks_through_tempo_changes(spark):
    rng = random.Random(8)
    tempos = {s: [(k, rng.choice([0, 480, 960, 960, 4000, 9000]) + (s % 2) * 100, rng.choice([60, 97, 120])) for k in range(s % 4)] for s in range(12)}
    at = [(s, t) for s in tempos for t in (0, 50, 100, 960, 5000, 20_000)]
    df = spark.createDataFrame([(s, *t) for s, own in tempos.items() for t in own], "song_id int, idx int, tick int, bpm int")
    got = {(r.song_id, r.tick): r.seconds for r in W.score_seconds(spark.createDataFrame(at, "song_id int, tick int"), df).collect()}
    for (s, t), seconds in got.items():
        assert seconds == pytest.approx(float(loop_seconds(t, [x[1:] for x in tempos[s]])), abs=1e-9), (s, t)
    assert len(got) == len(at)


def merged(spark, lrc, words, tempos=((0, 0, 60),), **options):
    df = W.merged_score(
        spark.createDataFrame([(1, lrc)], "song_id int, lrc string"), spark.createDataFrame([(1, k, t, "x") for k, t in enumerate(words)], "song_id int, word_idx int, tick int, word string"),
        spark.createDataFrame([(1, *t) for t in tempos], "song_id int, idx int, tick int, bpm int"), **options,
    )
    r = df.first()
    return r.too_long, r.lrc


def test_words_are_dealt_out_over_the_lines(spark):
    lrc = "[ti:A song]\n[00:01.00]one  two\n\n[00:02.00]\nplain text\n[00:03.00] three \t four\n"
    want = "[ti:A] <00:00.00>song"
    assert merged(spark, "[ti:A] song", [0]) == (False, want)
    seconds = [k * 960 for k in range(9)]
    assert merged(spark, lrc, seconds)[1].split("\n") == ["[ti:A song]", "[00:01.00] <00:00.00>one <00:01.00>two", "", "[00:02.00]", " <00:02.00>plain <00:03.00>text", "[00:03.00] <00:04.00>three \t <00:05.00>four"]
    assert merged(spark, lrc, seconds[:3])[1].split("\n")[1:6] == ["[00:01.00] <00:00.00>one <00:01.00>two", "", "[00:02.00]", " <00:02.00>plain text", "[00:03.00] three \t four"]
    assert merged(spark, lrc, [])[1].split("\n")[5] == "[00:03.00] three \t four"


def test_length_guard(spark):
    lrc = "[00:01.00]a b\n[00:10.00]\n[length:9]"
    assert merged(spark, lrc, [0, 12 * 960], tolerance=2.0)[0] is False
    assert merged(spark, lrc, [0, 12 * 960 + 96], tolerance=2.0) == (True, None)
    assert merged(spark, lrc, [0, 12 * 960 + 96], tolerance=2.0, force=True)[1].startswith("[00:01.00] <00:00.00>a <00:12.10>b")
    assert merged(spark, "[ar:x]\na b", [0, 10**7], tolerance=2.0)[0] is False  # no line has a time
    assert merged(spark, lrc, [0, 960], tempos=[(0, 0, 60), (1, 960, 120)])[1].split("\n")[0] == "[00:01.00] <00:00.00>a <00:01.00>b"
    assert merged(spark, lrc, [0, 1920], tempos=[(0, 0, 60), (1, 960, 120)])[1].split("\n")[0] == "[00:01.00] <00:00.00>a <00:01.50>b"
