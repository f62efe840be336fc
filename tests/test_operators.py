"""Operators on small hand-made tables."""

import random

import pytest
from pyspark.sql import functions as F

from canticle.operators import align, merge, ranking, reports, resolve, search, signals, timeline, words as words_


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


SONG = "id long, title string, artist string, album string, duration_sec long"
CATALOG = "track_id long, title_norm string, artist_norm string, title string, artists array<string>, duration_ms long, popularity int, album_type string"


def track(id_, title, artist, ms=200_000, pop=50, kind="Album", artists=None):
    return (id_, title, artist, title.title(), artists or [artist], ms, pop, kind)


def test_phases(spark):
    songs = spark.createDataFrame(
        [
            (1, "First Song", "Alpha", "Album", 200), (2, "First Song (Live)", "Alpha", "Live", 201), (3, "Second Song", "Beta & Gamma", "Album", 200),
            (4, "Third Song", "Delta Blues Clubs", "Album", 200), (40, "Other Third", "Deltas", "Album", 200), (5, "Fourth Somg Of Mine", "Echo", "Album", 200), (6, "Fifth Song", "Foxtrot", "Album", 200),
            (7, "Sixth Song", "Golf", "Album", 200), (8, "Nothing Here", "Nobody", "Album", 200), (9, "Intro", "Unknowns", "Album", 200),
        ],
        SONG,
    )
    catalog = spark.createDataFrame(
        [
            track(10, "first song", "alpha"), track(11, "first song", "alpha", pop=90, kind="Single"), track(12, "second song", "beta and gamma"),
            track(13, "third song", "delta blues club"), track(19, "other third", "delta"), track(14, "fourth song of mine", "echo"), track(15, "fifth song", "foxtrot", kind="Single"),
            track(16, "fifth song", "foxtrot", ms=229_000, kind="Album", pop=1), track(17, "sixth song", "golf", ms=201_000, pop=0), track(18, "intro", "unknown"),
        ],
        CATALOG,
    )
    groups = resolve.variants(songs)
    found = {r.title_norm: (r.id, r.c_track_id, r.phase) for r in resolve.resolve(groups, catalog).collect()}
    assert found["first song"] == (1, 10, "upgrade")  # the single is the bucket's most popular, then the album takes over
    assert found["second song"] == (3, 12, "exact")
    assert found["third song"][1:] == (13, "rescue") and found["fourth somg of mine"][1:] == (14, "fuzzy")
    assert found["fifth song"][1] == 16
    assert found["sixth song"][1:] == (17, "unpopular")
    assert "nothing here" not in found and "intro" not in found
    assert "other third" not in found  # artists of like spelling without a common word
    matches = resolve.resolve(groups, catalog)
    enriched = resolve.one_per_catalog_id(resolve.enriched(groups, matches, catalog))
    by_title = {r.title_norm: r for r in enriched.collect()}
    assert by_title["nothing here"].popularity is None and by_title["first song"].display_title == "First Song"
    lost = resolve.failures(groups, matches, resolve.scored_pairs(resolve.exact_pairs(groups, catalog), "exact"))
    assert {(r.title_norm, r.failure_reason) for r in lost.collect()} == {("nothing here", "no_candidates"), ("intro", "no_candidates"), ("other third", "no_candidates")}


def test_phases_that_reject(spark):
    songs = spark.createDataFrame(
        [
            (1, "Long Song", "Alpha Beta Gammas", "Album", 200), (2, "Twice Song", "Echo", "Album", 200), (3, "Twice Song", "Echo", "Karaoke", 290),
            (4, "Lost Song", "Golf", "Album", 200), (5, "Near Song Of Mine", "Kilo", "Album", 200), (6, "Wide Song", "Lima", "Live", 230),
        ],
        SONG,
    )
    catalog = spark.createDataFrame(
        [
            track(10, "long song", "alpha beta gamma", ms=231_000), track(11, "twice song", "echoes"), track(12, "lost song", "golf", ms=400_000), track(13, "lost song", "golf", pop=0),
            track(14, "near somg of mine", "kilo", ms=240_000, pop=90), track(15, "near somg of mine", "kilo", pop=20), track(16, "near somg of mine", "kilo", pop=10),
            track(17, "wide song", "lima", ms=230_000, kind="Single", pop=60), track(18, "wide song", "lima", ms=234_000, pop=50), track(19, "wide song", "lima", ms=262_000, pop=40),
        ],
        CATALOG,
    )
    groups = resolve.variants(songs)
    found = {r.title_norm: (r.c_track_id, r.phase) for r in resolve.resolve(groups, catalog).collect()}
    # 31 seconds off the best variant; no common word of artists; rejected before; the first by popularity that is near enough; the album of one bucket.
    assert found == {"near song of mine": (15, "fuzzy"), "wide song": (18, "upgrade")}
    retried = {r.title_norm: (r.c_track_id, r.phase) for r in resolve.resolve(groups, catalog, retry_rejected=True).collect()}
    assert retried == found | {"lost song": (13, "unpopular")}
    statistics = {r.phase: r.groups for r in resolve.phase_statistics(groups, resolve.resolve(groups, catalog)).collect()}
    assert statistics == {"fuzzy": 1, "upgrade": 1, "none": 3}


def test_unpopular_rows_of_a_title_are_all_candidates(spark):
    songs = spark.createDataFrame([(1, "Much Sung", "Alpha", "Album", 200), (2, "Much Sung", "Beta", "Album", 210), (3, "Much Sung", "Gamma", "Album", 200)], SONG)
    others = [track(1000 + k, "much sung", f"other {k}", ms=100_000 + 500 * k, pop=0) for k in range(600)]
    edges = [track(10, "much sung", "alpha", ms=203_000, pop=0), track(11, "much sung", "beta", ms=213_001, pop=0), track(12, "much sung", "gamma", ms=196_999, pop=0)]
    catalog = spark.createDataFrame(others + edges, CATALOG)
    assert [(r.title_norm, r["count"]) for r in resolve.common_title_counts(catalog).collect()] == [("much sung", 603)]
    groups = resolve.variants(songs)
    assert rows_of(resolve.resolve(groups, catalog), "id", "c_track_id", "phase") == [(1, 10, "unpopular")]
    assert rows_of(resolve.unpopular_pairs(groups, catalog), "id", "c_track_id") == [(1, 10)]


def test_a_misspelt_title_meets_all_its_candidates(spark):
    songs = spark.createDataFrame([(1, "Fourth Somg Of Mine", "Echo", "Album", 200), (2, "Fifth Somg Of Mine", "Echo", "Album", 200)], SONG)
    far = [track(1000 + k, t, "echo", ms=231_000 + 1000 * k, pop=90) for t in ("fourth song of mine", "fifth song of mine") for k in range(25)]
    near = [track(10, "fourth song of mine", "echo", ms=230_999, pop=5), track(11, "fourth song of mine", "echo", ms=170_000, pop=5), track(12, "fourth song of mine", "echo", pop=4), track(13, "fifth song of mine", "echo", ms=169_999)]
    got = resolve.fuzzy_pairs(resolve.variants(songs), spark.createDataFrame(far + near, CATALOG))
    assert rows_of(got, "id", "c_track_id") == [(1, 10)]  # the lowest id of the most popular within 30 seconds


def test_a_title_meets_all_its_candidates_of_like_artists(spark):
    songs = spark.createDataFrame([(1, "Third Song", "Delta Blues Clubs", "Album", 200), (2, "Third Song", "Golf Hotel Inn", "Album", 200)], SONG)
    others = [track(1000 + k, "third song", f"someone else {k}", pop=90) for k in range(150)]
    like = [track(10, "third song", "delta blues club", ms=230_999, pop=1), track(11, "third song", "delta blues club", ms=170_000, pop=2), track(12, "third song", "delta blues club", ms=169_999), track(13, "third song", "delta blues club", ms=231_000), track(14, "third song", "delta", pop=1)]
    got = resolve.rescue_pairs(resolve.variants(songs), spark.createDataFrame(others + like, CATALOG))
    assert rows_of(got, "id", "c_track_id") == [(1, 10), (1, 11)]  # within 30 seconds of whole ones, each once


def test_artists_of_like_spelling_are_all_found(spark, monkeypatch):
    monkeypatch.setattr(resolve, "TOGETHER", 4)
    rng = random.Random(4)
    name = lambda: "".join(rng.choice("ab c") for _ in range(rng.randint(3, 9))).strip() or "a"
    songs = spark.createDataFrame([(k, "much sung", name(), 200, 5, "Much Sung", "Album") for k in range(60)], "id long, title_norm string, artist_norm string, duration_sec long, quality int, title string, album string")
    rows = [track(k, "much sung", "x", artists=[name(), name()], ms=rng.choice([200_000, 240_000])) for k in range(150)]
    got = {(r.artist_norm, r.c_track_id): r._near for r in resolve.rescue_pairs(songs, spark.createDataFrame(rows, CATALOG)).collect()}

    def like(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, before = [i], last
            for j, y in enumerate(b, 1):
                last.append(min(before[j] + 1, last[-1] + 1, before[j - 1] + (x != y)))
        return 1 - last[-1] / max(len(a), len(b))

    artists = {r.artist_norm for r in songs.collect()}
    best = {(a, r[0]): max(like(a, b) for b in r[4]) for a in artists for r in rows if r[5] == 200_000}
    assert got == {k: v for k, v in best.items() if v >= 0.70} and got


def test_streamed_pairs(spark):
    songs = spark.createDataFrame([(1, "First Song", "Alpha", "Album", 200), (2, "Second Song", "Beta Gamma", "Album", 200)], SONG)
    catalog = spark.createDataFrame([track(10, "first song", "alpha"), track(11, "first song", "alpha beta"), track(12, "second song", "beta gamma delta"), track(13, "second song", "delta")], CATALOG)
    got = resolve.streamed_pairs(resolve.variants(songs), catalog)
    assert rows_of(got, "id", "c_track_id", "phase") == [(1, 10, "exact"), (2, 12, "title")]
    exact, loose = (r.score for r in got.orderBy("id").collect())
    assert exact - loose == 50 - int(2 / 3 * 30) + int((1 - 2 / 3) * 50)


def test_choice_is_a_sequential_fold(spark):
    rng = random.Random(2)
    cands = [(g, "x", 1, k, rng.choice(["Album", "Single", "Other"]), 1, 1, rng.choice([40, 79, 80, 90, 120]), "p") for g in map(str, range(60)) for k in range(6)]
    got = {r.title_norm: r.c_track_id for r in resolve.best_match(spark.createDataFrame(cands, "title_norm string, artist_norm string, id long, c_track_id long, c_album_type string, c_popularity int, c_duration_ms long, score int, phase string")).collect()}
    rank = {"Album": 0, "Single": 1, "Other": 3}
    want = {}
    for g, _, _, k, kind, _, _, score, _ in cands:
        if score >= 80 and (g not in want or (rank[kind], -score) < want[g][:2]):
            want[g] = (rank[kind], -score, k)
    assert got == {g: w[2] for g, w in want.items()}


def test_bucketed_candidates(spark):
    rows = [track(k, "t", "a", ms=200_000 + 1000 * k, pop=k % 7) for k in range(200)]
    got = resolve.bucketed_candidates(spark.createDataFrame(rows, CATALOG)).collect()
    assert len(got) == 20 and len({r.duration_ms // 5000 for r in got}) == 20


def test_search(spark):
    docs = spark.createDataFrame([(1, "Hello World", "Ann"), (2, "World of Hello", "Bob"), (3, "Helloween", "Ann"), (4, None, "Ann")], "id long, title string, artist string")
    index = search.postings(docs, "id", ["title", "artist"])
    assert rows_of(search.prefix_search(index, "hello"), "id") == [(1,), (2,), (3,)]
    assert rows_of(search.prefix_search(index, "hello wor"), "id") == [(1,), (2,)]
    assert rows_of(search.prefix_search(index, "  "), "id") == []
    assert rows_of(search.stemmed_search(search.stemmed_postings(index), "worlds"), "id") == [(1,), (2,)]
    assert rows_of(search.phrase_search(index, {"title": "hello world"}), "id") == [(1,)]
    assert rows_of(search.phrase_search(index, {"title": "hello", "artist": "bob"}), "id") == [(2,)]
    assert [r.id for r in search.bm25(index, "helloween ann").orderBy(F.desc("score")).collect()][0] == 3


def test_merges(spark):
    old = spark.createDataFrame([(1, "", 5, True), (2, "b", None, False)], "k long, album string, n int, f boolean")
    new = spark.createDataFrame([(1, "x", 3, False), (3, "y", 1, None)], "k long, album string, n int, f boolean")
    rules = {"album": "keep_text", "n": "greatest", "f": "or"}
    assert rows_of(merge.upserted(old, new, ["k"], rules), "k", "album", "n", "f") == [(1, "x", 5, True), (2, "b", None, False), (3, "y", 1, False)]
    links = spark.createDataFrame([("a", 1, 5, True, 1), ("a", 2, 9, False, 2), ("b", 3, 1, False, 3), ("b", 4, 7, False, 4)], "g string, id int, score int, is_primary boolean, created_at int")
    assert rows_of(merge.elected(links, "g", "score", "id").where("is_primary"), "id") == [(1,), (4,)]
    assert rows_of(merge.promoted(links, links.where("id = 1"), "g", "id").where("is_primary and g = 'a'"), "id") == [(2,)]
    fresh = spark.createDataFrame([("a", 9, 1, False, 9)], links.schema)
    assert rows_of(merge.made_primary(links, fresh, "g", "id").where("is_primary"), "id") == [(9,)]
    assert merge.inserted_if_absent(links, links.union(fresh), ["id"]).count() == 5
    with pytest.raises(ValueError):
        merge.assert_unique(links.union(links), ["id"])


def test_ranking(spark):
    one = spark.range(1)
    assert one.select(ranking.best_album(F.array(F.lit("Live X"), F.lit("X Deluxe"), F.lit("X"), F.lit("Y")))).first()[0] == "X"
    images = F.array(*[F.struct(F.lit(w).alias("width"), F.lit(f"u{w}").alias("url")) for w in (64, 640, 300)])
    assert [one.select(ranking.image_by_size(images, s)).first()[0] for s in ("large", "medium", "small")] == ["u640", "u300", "u64"]
    assert one.select(ranking.text_direction(F.array(F.lit("שלום"), F.lit(""), F.lit("hi"), F.lit("שלום")))).first()[0] == "rtl"
    known = spark.createDataFrame([(1, "k1", 10), (2, "k2", 20)], "id long, key string, bpm int")
    rows = spark.createDataFrame([(1, "zz"), (9, "k2"), (8, "q")], "id long, key string")
    got = {r.id: r.bpm for r in ranking.enriched_by_two_keys(rows, known, "id", "key", ["bpm"]).collect()}
    assert got == {1: 10, 9: 20, 8: None}


def test_cascade(spark):
    tries = spark.createDataFrame([("s", "a", 1, False, "not_found"), ("s", "b", 2, False, "timeout"), ("s", "c", 3, True, None), ("t", "a", 1, False, "not_found")], "song string, provider string, priority int, success boolean, reason string")
    assert rows_of(reports.cascade(tries, "song"), "song", "provider") == [("s", "b")]


def test_lines(spark):
    lrc = "[ar:Ann]\n[00:02.00]two\n[00:01.00][00:03.00]one\n[00:04.00]\n[00:05.00]\n[00:06.00]end"
    songs = spark.createDataFrame([(1, lrc)], "song_id long, lrc string")
    got = [(r.text, r.start_s, r.end_s) for r in timeline.parsed_lines(songs).orderBy("line_idx").collect()]
    assert got == [("one", 1.0, 2.0), ("two", 2.0, 3.0), ("one", 3.0, 4.0), ("", 4.0, 6.0), ("end", 6.0, 11.0)]
    assert rows_of(timeline.lrc_tags(songs), "tag", "value") == [("ar", "Ann")]
    odd = spark.createDataFrame([(1, "[00:01.00]foo[00:02.00]\t bar \r\nx [00:03.00] y")], "song_id long, lrc string")
    assert rows_of(timeline.parsed_lines(odd), "start_s", "text") == [(1.0, "bar"), (2.0, "bar"), (3.0, "y")]


def test_song_durations(spark):
    line = "\n[00:10.00]a"
    cases = [("[length: 3:05.7]" + line, 185.0), ("[length:0:00]" + line, 15.0), ("[length:1:00]\n[LENGTH:02:30]" + line, 150.0), ("[length:1:02:03]" + line, 15.0), (line, 15.0), ("no lines", 0.0), ("[00:01.00][length:9:00]", 6.0), ("[ti:x][length:9:00]" + line, 15.0)]
    songs = spark.createDataFrame([(k, lrc) for k, (lrc, _) in enumerate(cases)], "song_id long, lrc string")
    assert rows_of(timeline.song_durations(songs), "song_id", "seconds") == [(k, s) for k, (_, s) in enumerate(cases)]


def test_chords_of_all_kinds_and_ties(spark):
    steps = {"": (0, 4, 7), "m": (0, 3, 7), "dim": (0, 3, 6), "7": (0, 4, 7, 10), "m7": (0, 3, 7, 10)}
    rows = [(f"{r}{q}", 48 + (r + i) % 12 + (0 if i == 0 else 12), 960) for r in range(12) for q, own in steps.items() for i in own]
    rows += [("tie", p, 960) for p in range(60, 72)]  # every class alike: triads score alike, but for the bass
    names = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
    found = timeline.pitch_histogram(spark.createDataFrame(rows, "bar string, pitch int, ticks int"), ["bar"]).select("bar", timeline.best_chord(F.col("bins"), F.col("bass"))["name"].alias("name")).collect()
    assert {r.bar: r.name for r in found} == {f"{r}{q}": names[r] + q for r in range(12) for q in steps} | {"tie": "C7"}


def test_asof_against_a_loop(spark):
    rng = random.Random(4)
    events = [(rng.randint(0, 3), rng.randint(0, 50), k) for k in range(40)]
    probes = [(rng.randint(0, 4), rng.randint(-5, 60), 1000 + k) for k in range(40)]
    e, p = spark.createDataFrame(events, "k int, t int, v int"), spark.createDataFrame(probes, "k int, t int, p int")
    got = {r.p: r.v for r in timeline.asof(p, e, "k", "t", ["v"], "v", else_first=True).collect()}
    for k, t, name in probes:
        own = sorted((b, str(v), v) for a, b, v in events if a == k)
        past = [x for x in own if x[0] <= t]
        assert got[name] == ((past[-1] if past else own[0])[2] if own else None)


def test_tempo_and_anchors(spark):
    tempos = spark.createDataFrame([(1, 0, 120.0), (1, 1920, 60.0)], "s int, tick int, bpm double")
    notes = spark.createDataFrame([(1, 960), (1, 2880)], "s int, tick int")
    assert rows_of(timeline.ticks_to_ms(notes, tempos, "s"), "tick", "ms") == [(960, 500.0), (2880, 2000.0)]
    anchors = spark.createDataFrame([(1, 0, 100), (1, 1000, 2100)], "s int, from_ms int, to_ms int")
    points = spark.createDataFrame([(1, -10), (1, 500), (1, 1500)], "s int, t int")
    assert rows_of(timeline.piecewise(points, anchors, "s", "t"), "t", "mapped_ms") == [(-10, 90.0), (500, 1100.0), (1500, 2600.0)]


def test_chords(spark):
    lines = spark.createDataFrame([(1, 0, 1000), (1, 1, 2000)], "song_id long, line_idx int, start_ms int")
    chords = spark.createDataFrame([(1, 600, "X"), (1, 750, "C"), (1, 1200, "C"), (1, 1800, "G"), (1, 12_299, "D"), (1, 12_300, "E")], "song_id long, at_ms int, chord string")
    got = rows_of(timeline.chords_on_lines(chords, lines, "song_id"), "line_idx", "at_ms", "chord")
    assert got == [(0, 750, "C"), (0, 1800, "G"), (1, 1800, "G"), (1, 12_299, "D")]
    notes = spark.createDataFrame([(1, p, 960) for p in (60, 64, 67)], "bar int, pitch int, ticks int")
    best = timeline.pitch_histogram(notes, ["bar"]).select(timeline.best_chord(F.col("bins"), F.col("bass")).alias("c")).first().c
    assert best["name"] == "C"
    cands = spark.createDataFrame([(1, t, n, s) for t, (n, s) in enumerate([("C", 3.0), ("C", 9.0), ("G", 3.2), ("F", 4.0), ("A", 1.0)])], "song_id long, tick int, name string, score double")
    assert rows_of(align.smoothed_chords(cands), "tick", "name") == [(0, "C"), (3, "F")]


def test_edits(spark):
    lines = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c")], "song_id long, line_idx int, text string")
    edits = spark.createDataFrame([(1, 0, True, None), (1, 2, False, "C")], "song_id long, line_idx int, skip boolean, text string")
    assert rows_of(timeline.edited(lines, edits, ["song_id", "line_idx"]), "line_idx", "text") == [(1, "b"), (2, "C")]
    found = timeline.nearest_line(spark.createDataFrame([(1, "b c d")], "song_id long, q string"), spark.createDataFrame([(1, 0, "x"), (1, 1, "b c")], lines.schema), "song_id", "q", "text")
    assert rows_of(found, "line_idx") == [(1,)]


def test_recovered_lines(spark):
    words = spark.createDataFrame([(1, line, k, w, line * 10_000) for line, text in enumerate(["first line here", "lost words again now", "last one"]) for k, w in enumerate(text.split())], "song_id long, line_idx int, word_idx int, word string, line_ms long")
    sung = spark.createDataFrame([(1, 100 * k, w) for k, w in enumerate("lost words noise again now first line here last one".split())], "song_id long, start_ms long, piece string")
    found = align.aligned(words, sung)
    assert {r.line_idx for r in found.collect()} == {0, 2}
    assert rows_of(align.recovered(words, sung, found), "line_idx", "word_idx", "start_ms") == [(1, 0, 10_000), (1, 1, 10_100), (1, 2, 10_300), (1, 3, 10_400)]


def test_greedy_distinct_is_a_loop(spark):
    rng = random.Random(6)
    rows = [(g, k, rng.randint(0, 5), rng.randint(0, 5)) for g in "ab" for k in range(20)]
    got = rows_of(ranking.greedy_distinct(spark.createDataFrame(rows, "g string, k int, x int, y int"), "g", ["k"], ("x", "y")), "g", "k")
    want = []
    for g in "ab":
        xs, ys = set(), set()
        for _, k, x, y in (r for r in rows if r[0] == g):
            if x not in xs and y not in ys:
                xs.add(x)
                ys.add(y)
                want.append((g, k))
    assert got == want


def test_search_kinds():
    assert [ranking.search_kind(t)[0] for t in (" 12 ", "spotify:track:abc", "https://open.spotify.com/track/abc?x", "abc 12")] == ["id", "service_id", "service_id", "words"]


def test_fan_out(spark):
    canon = spark.createDataFrame([("q", 0), ("q", 1), ("r", 0)], "query string, position int")
    found = spark.createDataFrame([("q", 1, "t", 5), ("q", 0, "t", 4), ("q", 1, "u", 6)], "query string, position int, title string, id int")
    direct = spark.createDataFrame([("q", 0, "z", 9), ("r", 0, "w", 8)], found.schema)
    assert rows_of(ranking.fanned_out(canon, found, direct, "query", ["title"]), "query", "id") == [("q", 4), ("q", 6), ("r", 8)]


def test_track_choice(spark):
    notes = spark.createDataFrame([(1, t, 480 * k, p) for t, n in ((0, 1), (1, 3)) for k in range(8) for p in range(n)], "song_id long, track int, tick int, pitch int")
    beats = spark.createDataFrame([(1, 960 * k) for k in range(4)], "song_id long, beat int")
    got = {r.track: (r.points, r.chords) for r in signals.track_scores(notes, beats, ["song_id", "track"], "song_id").collect()}
    assert got == {0: (-2, 0), 1: (2, 8)}
    tracks = spark.createDataFrame([(1, 0, "Drums", True, 9), (1, 1, "Piano", False, 9), (1, 2, "Lead Guitar", False, 2), (2, 0, "Piano", False, 0)], "song_id long, track int, track_name string, percussion boolean, chords int")
    assert rows_of(signals.best_track(tracks, "song_id"), "song_id", "track") == [(1, 2)]
    bars = spark.createDataFrame([(1, 0, 1920, 4)], "song_id long, start int, ticks int, beats int")
    assert rows_of(signals.bar_windows(bars, per_beat=True), "start_tick") == [(0.0,), (480.0,), (960.0,), (1440.0,)]


def test_sources_and_sinks(spark, tmp_path):
    from canticle.sources import readers, sinks

    docs = spark.createDataFrame([(1, '{"title": "t", "lines": [{"text": "a b", "chords": [{"name": "C", "at": 2}]}, {"text": "c", "chords": []}]}'), (2, "not json")], "id long, doc string")
    assert sorted((r.song_id, r.line_idx, r.chord) for r in readers.chord_documents(docs, "id", "doc").where("chord is not null").collect()) == [(1, 0, "C")]
    line = readers.bracket_chords(spark.createDataFrame([("[Am]one [F]two",)], "raw string")).first()
    assert line.text == "one two" and [(c.chord, c.char_offset) for c in line.chords] == [("Am", 0), ("F", 4)]
    with pytest.raises(ValueError):
        sinks.guard("/data/source", "out", [])
    with pytest.raises(ValueError):
        sinks.guard("file:///data/out", "out", ["/data/out"])
    rows = spark.createDataFrame([(1, "x" * 600), (1, "y"), (2, "z")], "k long, detail string")
    sinks.by_key(rows, f"file://{tmp_path}/out", ["k"])
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 2
    sinks.appended(rows, f"file://{tmp_path}/log")
    assert spark.read.parquet(f"file://{tmp_path}/log").selectExpr("max(length(detail))").first()[0] == 500
    assert sinks.statistics(rows.selectExpr("count(*) n"), f"{tmp_path}/stats.json") == {"n": 3}
    assert readers.sampled(rows, 2, "detail").count() == 2
    score = f"{tmp_path}/score.xml"
    with open(score, "w") as out:
        out.write('<score><part id="P1"><measure number="1"><note><pitch><step>C</step></pitch><duration>2</duration><lyric><text>la</text></lyric></note><note><pitch><step>D</step></pitch><duration>3</duration></note></measure><measure number="2"><note><pitch><step>E</step></pitch><duration>1</duration></note><note><pitch><step>F</step></pitch><duration>1</duration></note></measure></part></score>')
    notes = readers.musicxml_notes(spark, score).orderBy("position").collect()
    assert [(n.measure, n.position, n.step) for n in notes] == [(1, 0, "C"), (1, 2, "D"), (2, 5, "E"), (2, 6, "F")]


def test_musicxml_cursor(spark, tmp_path):
    from canticle.sources import readers

    note = lambda step, ticks, more="": f"<note>{more}<pitch><step>{step}</step></pitch><duration>{ticks}</duration></note>"
    parts = "".join(f'<part id="{p}"><measure number="1">{body}</measure><measure number="2">{note("G", 1)}</measure></part>' for p, body in (
        ("P1", note("C", 4) + note("E", 4, "<chord/>") + "<backup><duration>2</duration></backup>" + note("D", 1) + "<forward><duration>3</duration></forward>" + note("F", 2)), ("P2", note("A", 2))))
    with open(f"{tmp_path}/a.xml", "w") as out:
        out.write(f"<score>{parts}</score>")
    got = [(n.part, n.measure, n.position, n.step) for n in readers.musicxml_notes(spark, str(tmp_path)).collect()]
    assert got == [("P1", 1, 0, "C"), ("P1", 1, 0, "E"), ("P1", 1, 2, "D"), ("P1", 1, 6, "F"), ("P1", 2, 8, "G"), ("P2", 1, 0, "A"), ("P2", 2, 2, "G")]


def test_settings_and_first_inserts(spark):
    both = spark.createDataFrame([('{"size":12,"on":true,"nested":{"a":[1,null]}}', '{"nested":{"b":1.5},"c":"2","on":null}'), (None, '{"k": "v"}'), ('{"a": "1"}', "not json"), ("[1]", "3")], "old string, new string")
    assert [r[0] for r in both.select(merge.merged_settings(F.col("old"), F.col("new"))).collect()] == ['{"c":"2","nested":{"b":1.5},"on":null,"size":12}', '{"k":"v"}', '{"a":"1"}', "{}"]
    assert [r[0] for r in both.select(merge.without_settings(F.col("old"), "on")).collect()] == ['{"nested":{"a":[1,null]},"size":12}', "{}", '{"a":"1"}', "{}"]
    old = spark.createDataFrame([(1, "p", None)], "k int, payload string, by string")
    new = spark.createDataFrame([(1, None, "me"), (2, "q", "me")], "k int, payload string, by string")
    assert rows_of(merge.upserted(old, new, ["k"], {"payload": "new", "by": "first"}), "k", "payload", "by") == [(1, None, None), (2, "q", "me")]


def test_enhanced_lrc_text(spark):
    songs = spark.createDataFrame([(1, "[ar:X]\n[00:01.00] one two\n[00:02.00]\n[00:03.500] three  four\n[00:04.00] five")], "song_id long, lrc string")
    starts = spark.createDataFrame([(1, 0, 1200), (1, 1, 1210)], "song_id long, line_idx int, start_ms long")
    words = spark.createDataFrame([(1, 0, 0, 0), (1, 0, 1, 400), (1, 1, 0, 30)], "song_id long, line_idx int, word_idx int, offset_ms int")
    got = timeline.enhanced_lrc(songs, starts, words).first().lrc.split("\n")
    assert got == ["[ar:X]", "[00:01.20] one <00:01.60>two", "[00:02.00]", "[00:01.25] <00:01.28>three four", "[00:04.00] five"]


def test_popularity_rank_keeps_nulls_and_equals(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([None, 1, 2]), rng.choice([None, 5, 5, 7])) for k in range(300)]
    got = {r.id: r.search_id for r in resolve.popularity_rank(spark.createDataFrame(rows, "id int, popularity int, quality int")).collect()}
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2] is None, -(r[2] or 0), r[0]))
    assert got == {r[0]: n for n, r in enumerate(order, 1)}


def test_intervals_are_all_pairs_of_a_loop(spark):
    rng = random.Random(12)
    lines = [(rng.randint(0, 2), k, rng.choice([rng.randint(0, 4000), rng.randint(0, 60_000)])) for k in range(60)]
    points = [(rng.randint(0, 3), p, rng.choice([rng.randint(-400, 4500), rng.randint(0, 75_000)])) for p in range(300)]
    want = []
    for key in range(3):
        own = sorted((s, k) for g, k, s in lines if g == key)
        for n, (s, k) in enumerate(own):
            end = (own[n + 1][0] if n + 1 < len(own) else s + 10_000) + 300
            want += [(p, k) for g, p, t in points if g == key and s - 300 <= t < end]
    got = timeline.in_intervals(spark.createDataFrame(points, "song int, p int, t int"), spark.createDataFrame(lines, "song int, line_idx int, start_ms int"), "song", "t", "start_ms")
    assert rows_of(got, "p", "line_idx") == sorted(want)


def test_gate_of_two_tables(spark):
    from canticle.streaming import detectors

    model = spark.createDataFrame([("a", 1000), ("a", 5000), ("b", 1000), ("a", 9000)], "key string, at_ms long")
    energy = spark.createDataFrame([("a", 1900), ("a", 2001), ("a", 4100), ("a", 5500), ("b", 2001), ("a", 8000)], "key string, at_ms long")
    assert rows_of(detectors.gated(model, energy), "key", "at_ms", "released_ms") == [("a", 1000, 1900), ("a", 5000, 5000), ("a", 9000, 9000)]


def test_copies_of_a_variant_add_no_pairs(spark):
    titles = ["Song", "Song - Live", "03 - Song"]
    songs = spark.range(600).selectExpr("id", f"array({', '.join(map(repr, titles))})[CAST(id % 3 AS INT)] AS title", "'Ann' AS artist", "'Disc' AS album", "200 + id % 2 AS duration_sec")
    rows = resolve.variants(songs)
    cat = [(n, "song", "ann", "Song", ["ann"], 200_000 + n * 6000, n, "Album") for n in range(3)]
    catalog = spark.createDataFrame(cat, "track_id long, title_norm string, artist_norm string, title string, artists array<string>, duration_ms long, popularity int, album_type string")
    few = resolve.distinct_variants(rows)
    assert few.count() <= 6
    best = [[tuple(r) for r in resolve.best_match(resolve.scored_pairs(resolve.exact_pairs(x, catalog), "exact")).collect()] for x in (few, rows)]
    assert best[0] == best[1] and len(best[0]) == 1
