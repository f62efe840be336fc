"""Reading of source tracks, and edits that had no test: merged chords, payloads, valid patches."""

from canticle.operators import resolve, timeline


def test_tracks_are_read_by_lyrics_length_album_title_and_artist(spark):
    rows = [
        (1, "A", "Ann", "Good", 45.0, 11), (2, "A", "Ann", "Good", 45.1, 11), (3, "A", "Ann", "Good", 599.9, 11), (4, "A", "Ann", "Good", 600.0, 11),
        (5, "A", "Ann", None, 200.5, 11), (6, "A", "Ann", "Karaoke Hits", 200.0, 11), (7, "A (pAuSed)", "Ann", "Good", 200.0, 11), (8, "A", "Bob & ANN", "Good", 201.5, 11),
        (9, "A", "Bob", "Good", 200.0, 11), (10, "A", "Ann", "Good", 200.0, 12), (11, "A", "Ann", "Good", 200.0, 99), (12, "A", "Ann", "Vol. 2", 200.0, 11), (13, "A", "Ann", "Good", None, 11),
    ]
    tracks = spark.createDataFrame(rows, "id int, title string, artist string, album string, duration double, last_lyrics_id int")
    lyrics = spark.createDataFrame([(11, 1), (12, 0)], "id int, has_synced_lyrics int")
    assert sorted((r.id, r.duration_sec) for r in resolve.read_tracks(tracks, lyrics).collect()) == [(2, 45), (3, 600), (5, 201), (8, 202), (9, 200)]
    assert sorted(r.id for r in resolve.read_tracks(tracks, lyrics, ["ann", "zoe"]).collect()) == [2, 3, 5, 8]


def test_a_lines_chords_come_from_its_patch_or_the_baseline(spark):
    lines = spark.createDataFrame([(1, k) for k in range(4)], "song_id int, line_idx int")
    of = "song_id int, line_idx int, chords array<string>"
    baseline = spark.createDataFrame([(1, 0, ["C"]), (1, 1, ["D"])], of)
    patches = spark.createDataFrame([(1, 1, ["E", "F"]), (1, 0, []), (1, 2, ["G"])], of)
    found = timeline.merged_chords(lines, baseline, patches, ["song_id", "line_idx"]).collect()
    assert sorted((r.line_idx, r.chord_source, r.chords) for r in found) == [(0, "baseline", ["C"]), (1, "patch", ["E", "F"]), (2, "patch", ["G"]), (3, "none", None)]


def test_payloads_and_valid_patches(spark):
    patches = spark.createDataFrame([(1, 0, 1, 1500, 300), (1, 0, 0, 1200, 250), (1, 2, 3, 9000, 100), (2, 0, 0, 50, 60)], "song_id int, line_idx int, word_idx int, start_ms int, duration_ms int")
    found = {r.song_id: [(x.line_idx, x.start_ms, [tuple(w) for w in x.words]) for x in r.lines] for r in timeline.payload(patches).collect()}
    assert found == {1: [(0, 1200, [(0, 0, 250), (1, 300, 300)]), (2, 9000, [(3, 0, 100)])], 2: [(0, 50, [(0, 0, 60)])]}
    lines = spark.createDataFrame([(1, 0, "two words"), (2, 0, "one")], "song_id int, line_idx int, text string")
    told = spark.createDataFrame([(1, 0, 0, "h"), (1, 0, 1, "h"), (1, 0, 2, "h"), (1, 0, -1, "h"), (1, 1, 0, "h"), (2, 0, 0, "old")], "song_id int, line_idx int, word_idx int, lrc_hash string")
    hashes = spark.createDataFrame([(1, "h"), (2, "new")], "song_id int, lrc_hash string")
    assert sorted((r.song_id, r.line_idx, r.word_idx) for r in timeline.valid_patches(told, lines, hashes).collect()) == [(1, 0, 0), (1, 0, 1)]
