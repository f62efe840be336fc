"""Time-aligned text: parsing, as-of and interval joins, tempo maps, sections, edits and chords.

As-of lookups are one sort: events and probes are united under their key and the last event value is carried forward,
so nothing is compared pair by pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canticle.functions import fixed
from canticle.functions import text as T

STAMP = r"\[\d+:\d+(?:\.\d+)?\]"


def parsed_lines(songs: DataFrame, id_col: str = "song_id", text_col: str = "lrc") -> DataFrame:
    """(song_id, line_idx, text, start_s, end_s): a line a time stamp, by time; its text is what follows the last stamp. Blank repeats
    go; a line ends at the next one, the last after five seconds."""
    raw = songs.select(F.col(id_col).alias("song_id"), F.posexplode(F.split(F.regexp_replace(text_col, "\r\n", "\n"), "\n")).alias("raw_idx", "raw"))
    stamps = F.posexplode(F.regexp_extract_all("raw", F.lit(f"({STAMP})"), F.lit(1))).alias("stamp_idx", "stamp")
    text = F.regexp_replace(F.regexp_replace("raw", f"(?s)^.*{STAMP}", ""), r"(?U)^[\s\uFEFF]+|[\s\uFEFF]+$", "")
    lines = raw.select("song_id", "raw_idx", text.alias("text"), stamps).withColumn("start_s", T.stamp_seconds(F.col("stamp")))
    order = Window.partitionBy("song_id").orderBy("start_s", "raw_idx", "stamp_idx")
    blank = F.col("text") == ""
    kept = lines.withColumn("_prev", F.lag(blank).over(order)).where(~blank | ~F.coalesce("_prev", F.lit(False)))
    nxt = F.lead("start_s").over(order)
    return kept.select("song_id", (F.row_number().over(order) - 1).alias("line_idx"), "text", "start_s", F.coalesce(nxt, F.col("start_s") + 5).alias("end_s"))


def strict_lines(songs: DataFrame, id_col: str = "song_id", text_col: str = "lrc") -> DataFrame:
    """(song_id, line_idx, text, start_ms) of lines with one whole stamp in front and a text; other lines aren't counted."""
    raw = songs.select(F.col(id_col).alias("song_id"), F.posexplode(F.split(text_col, "\n")).alias("raw_idx", "raw"))
    pattern = r"^(\[\d{2}:\d{2}\.\d{2,3}\])\s*(.*)$"
    parsed = raw.select("song_id", "raw_idx", T.stamp_millis(F.regexp_extract("raw", pattern, 1)).alias("start_ms"), F.btrim(F.regexp_extract("raw", pattern, 2)).alias("text"))
    order = Window.partitionBy("song_id").orderBy("raw_idx")
    return parsed.where("start_ms is not null and text <> ''").select("song_id", (F.row_number().over(order) - 1).alias("line_idx"), "text", "start_ms")


def song_durations(songs: DataFrame, id_col: str = "song_id", text_col: str = "lrc") -> DataFrame:
    """(song_id, seconds) of every song: whole minutes and seconds of its last ``length`` tag; where that is none or 0, the end of the last
    line, else 0. A tag of two parts that begin with no number gives NaN."""
    whole = lambda k: F.regexp_extract(F.split(F.col("tag"), ":")[k], r"(?U)^\s*([+-]?[0-9]+)", 1).try_cast("double")
    raw = songs.select(F.col(id_col).alias("song_id"), F.posexplode(F.split(text_col, "\n")).alias("raw_idx", "raw"))
    part = lambda k: F.regexp_extract("raw", r"\[(\w+):(.+)\]", k)
    tagged = raw.where((F.lower(part(1)) == "length") & ~F.col("raw").rlike(r"\[\d+:\d+")).groupBy("song_id").agg(F.max_by(part(2), "raw_idx").alias("tag"))
    told = F.when(F.size(F.split(F.col("tag"), ":")) == 2, F.coalesce(whole(0) * 60 + whole(1), F.lit(float("nan"))))
    lengths = tagged.select("song_id", told.alias("_told"))
    last = parsed_lines(songs, id_col, text_col).groupBy("song_id").agg(F.max_by("end_s", "line_idx").alias("_last"))
    rows = songs.select(F.col(id_col).alias("song_id")).join(lengths, "song_id", "left").join(last, "song_id", "left")
    return rows.select("song_id", F.coalesce(F.when(F.col("_told") != 0, F.col("_told")), F.col("_last"), F.lit(0.0)).alias("seconds"))


def lrc_tags(songs: DataFrame, id_col: str = "song_id", text_col: str = "lrc") -> DataFrame:
    """(song_id, tag, value) of header tags such as ``[ar:...]``."""
    raw = songs.select(F.col(id_col).alias("song_id"), F.explode(F.split(text_col, "\n")).alias("raw"))
    tag = lambda k: F.regexp_extract("raw", r"^\[([a-zA-Z]+):(.*)\]\s*$", k)
    return raw.select("song_id", F.lower(tag(1)).alias("tag"), F.btrim(tag(2)).alias("value")).where("tag <> ''")


def trimmed(lines: DataFrame) -> DataFrame:
    """Lines between the first and the last that aren't blank."""
    w = Window.partitionBy("song_id")
    at = F.when(F.btrim("text") != "", F.col("line_idx"))
    return lines.withColumns({"_a": F.min(at).over(w), "_b": F.max(at).over(w)}).where("line_idx between _a and _b").drop("_a", "_b")


def sections(lines: DataFrame) -> DataFrame:
    """Non-blank lines with the number of their section; a blank line ends one. ``section_end`` is its last line."""
    w = Window.partitionBy("song_id").orderBy("line_idx")
    starts = (F.btrim("text") != "") & F.coalesce(F.lag(F.btrim("text") == "").over(w), F.lit(True))
    numbered = lines.withColumn("_start", starts.cast("int")).withColumn("section", F.sum("_start").over(w)).where(F.btrim("text") != "")
    return numbered.withColumn("section_end", F.max("line_idx").over(Window.partitionBy("song_id", "section"))).drop("_start")


def islands(rows: DataFrame, key: str, order: str, flag: str) -> DataFrame:
    """Runs of consecutive rows with ``flag``: (key, first, last, n)."""
    w = Window.partitionBy(key).orderBy(order)
    marked = rows.withColumn("_all", F.row_number().over(w)).where(flag).withColumn("_run", F.col("_all") - F.row_number().over(w))
    return marked.groupBy(key, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("_run")


def changes(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_before", before).where(~F.col(value).eqNullSafe(F.col("_before")) | F.col("_before").isNull()).drop("_before")


def asof(probes: DataFrame, events: DataFrame, key: str, at: str, values: list[str], tie: str, else_first: bool = False) -> DataFrame:
    """``probes`` with the values of the latest event at or before each probe's time; with ``else_first``, of the first
    event where none is earlier. ``tie`` orders events of one time."""
    found = F.struct(F.col(at).alias("_at"), *values)
    e = events.select(key, at, F.lit(0).alias("_kind"), F.col(tie).cast("string").alias("_tie"), found.alias("_event"), F.lit(None).cast(_struct(probes)).alias("_probe"))
    p = probes.select(key, at, F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("_tie"), F.lit(None).cast(e.schema["_event"].dataType).alias("_event"), F.struct(*probes.columns).alias("_probe"))
    order = Window.partitionBy(key).orderBy(at, "_kind", "_tie")
    last = F.last("_event", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    if else_first:
        whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        last = F.coalesce(last, F.first("_event", ignorenulls=True).over(whole))
    out = e.union(p).withColumn("_found", last).where("_kind = 1")
    return out.select("_probe.*", *[F.col(f"_found.{v}").alias(v) for v in values])


def _struct(df: DataFrame):
    return df.schema


def in_intervals(points: DataFrame, lines: DataFrame, key: str, at: str, start: str, before: int = 300, last_for: int = 10_000) -> DataFrame:
    """Points with every line whose interval holds them: from ``before`` ms ahead of its start to as much ahead of the
    next one's start; a last line counts as if one came ``last_for`` ms after it.

    No pairs of a key are tried: the lines of a point are the last one that starts ``before`` ms ahead of it or earlier (an as-of
    lookup), and those that start within ``before`` ms of it, which share one of its two cells of time.
    """
    order = Window.partitionBy(key).orderBy(start, "line_idx")
    values = [c for c in lines.columns if c != key]
    ends = lines.withColumns({"_end": F.coalesce(F.lead(start).over(order), F.col(start) + last_for) + before, "_tie": F.lpad(F.col("line_idx").cast("string"), 20, "0")})
    earlier = asof(points, ends.withColumn(at, F.col(start) + before), key, at, [*values, "_end"], "_tie").where(F.col(at) < F.col("_end"))
    cell = lambda x: F.floor(x / (2 * before))
    dealt = points.withColumn("_cell", F.explode(F.array_distinct(F.array(cell(F.col(at) - before), cell(F.col(at) + before)))))
    near = dealt.join(lines.select(F.col(key).alias("_key"), *values, cell(F.col(start)).alias("_of")), (F.col(key) == F.col("_key")) & (F.col("_cell") == F.col("_of")))
    near = near.where((F.col(start) > F.col(at) - before) & (F.col(start) <= F.col(at) + before))
    return earlier.select(*points.columns, *values).unionByName(near.select(*points.columns, *values))


def nearest_line(queries: DataFrame, lines: DataFrame, key: str, query: str, text: str, over: float = 0.5) -> DataFrame:
    """Each query line with the line of its song that shares most words, over ``over``; the first of equals."""
    pairs = queries.join(lines.select(key, "line_idx", F.col(text).alias("_text")), key)
    scored = pairs.withColumn("_s", T.jaccard(T.bare_words(F.col(query)), T.bare_words(F.col("_text")))).where(F.col("_s") > over)
    best = scored.groupBy(*queries.columns).agg(F.min_by(F.struct("line_idx", "_s"), F.struct(-F.col("_s"), "line_idx")).alias("b"))
    return best.select(*queries.columns, F.col("b.line_idx").alias("line_idx"), F.col("b._s").alias("similarity"))


def tempo_map(tempos: DataFrame, key: str, ppq: int = 960) -> DataFrame:
    """(key, tick, next_tick, bpm, at_ms): segments of constant tempo with their time, a running sum."""
    order = Window.partitionBy(key).orderBy("tick")
    seg = tempos.withColumn("next_tick", F.lead("tick").over(order))
    length = (F.coalesce("next_tick", "tick") - F.col("tick")) * 60_000 / (F.col("bpm") * ppq)
    before = F.sum("_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return seg.withColumn("_ms", length).withColumn("at_ms", F.coalesce(before, F.lit(0.0))).drop("_ms")


def ticks_to_ms(notes: DataFrame, tempos: DataFrame, key: str, ppq: int = 960) -> DataFrame:
    """Notes with the time of their tick."""
    segs = tempo_map(tempos, key, ppq).withColumn("seg_tick", F.col("tick"))
    found = asof(notes, segs, key, "tick", ["seg_tick", "bpm", "at_ms"], "seg_tick", else_first=True)
    return found.withColumn("ms", F.col("at_ms") + (F.col("tick") - F.col("seg_tick")) * 60_000 / (F.col("bpm") * ppq)).drop("seg_tick", "bpm", "at_ms")


def piecewise(points: DataFrame, anchors: DataFrame, key: str, at: str) -> DataFrame:
    """Points mapped through anchors (from_ms, to_ms): linear between them, a constant offset outside."""
    order = Window.partitionBy(key).orderBy("from_ms")
    segs = anchors.withColumns({"n_from": F.lead("from_ms").over(order), "n_to": F.lead("to_ms").over(order), at: F.col("from_ms")})
    found = asof(points, segs, key, at, ["from_ms", "to_ms", "n_from", "n_to"], "from_ms", else_first=True)
    inside = (F.col(at) >= F.col("from_ms")) & F.col("n_from").isNotNull()
    line = F.col("to_ms") + (F.col(at) - F.col("from_ms")) * (F.col("n_to") - F.col("to_ms")) / (F.col("n_from") - F.col("from_ms"))
    return found.withColumn("mapped_ms", F.when(inside, line).otherwise(F.col(at) + F.col("to_ms") - F.col("from_ms"))).drop("from_ms", "to_ms", "n_from", "n_to")


def chords_on_lines(chords: DataFrame, lines: DataFrame, key: str, most: int = 4) -> DataFrame:
    """Chords by line, equal neighbours once, the first four of a line (the number is the feature)."""
    placed = in_intervals(chords, lines, key, "at_ms", "start_ms")
    once = changes(placed.withColumn("_line", F.struct(key, "line_idx")), "_line", ["at_ms", "chord"], "chord").drop("_line")
    return once.withColumn("nth", F.row_number().over(Window.partitionBy(key, "line_idx").orderBy("at_ms", "chord"))).where(F.col("nth") <= most)


def merged_chords(lines: DataFrame, baseline: DataFrame, patches: DataFrame, keys: list[str]) -> DataFrame:
    """A line's chords from its patch if that has any, else from the baseline."""
    p = patches.where(F.size("chords") > 0).select(*keys, F.col("chords").alias("_p"))
    b = baseline.select(*keys, F.col("chords").alias("_b"))
    source = F.when(F.col("_p").isNotNull(), "patch").when(F.col("_b").isNotNull(), "baseline").otherwise("none")
    return lines.join(p, keys, "left").join(b, keys, "left").select(*lines.columns, F.coalesce("_p", "_b").alias("chords"), source.alias("chord_source"))


def edited(lines: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Lines without skipped ones, with overridden texts. ``edits`` has (keys, skip, text)."""
    e = edits.select(*keys, F.col("skip").alias("_skip"), F.col("text").alias("_new"))
    out = lines.join(e, keys, "left").where(~F.coalesce("_skip", F.lit(False)))
    return out.withColumn("text", F.coalesce("_new", "text")).select(*lines.columns)


def edit_stats(edits: DataFrame, key: str) -> DataFrame:
    return edits.groupBy(key).agg(F.count_if("skip").alias("skipped"), F.count_if(F.col("text").isNotNull()).alias("modified"), F.bool_or(F.coalesce(F.col("skip"), F.lit(False))).alias("any_skip"))


def edit_flags(patches: DataFrame, key: str) -> DataFrame:
    """Whether any patch of a song skips a line, changes its text, or marks a section. ``patches`` has (key, action, skipped, custom_text); a skip counts
    where ``skipped`` is set, a change where there is a text, even an empty one."""
    of = lambda action, more: F.coalesce(F.bool_or(F.coalesce((F.col("action") == action) & more, F.lit(False))), F.lit(False))
    return patches.groupBy(key).agg(
        of("skip", F.col("skipped")).alias("has_skipped_lines"),
        of("modify", F.col("custom_text").isNotNull()).alias("has_modified_text"),
        of("section", F.lit(True)).alias("has_section_markers"),
    )


def word_timings(words: DataFrame) -> DataFrame:
    """Words with their duration to the next one of their line, null at its end."""
    order = Window.partitionBy("song_id", "line_idx").orderBy("start_ms", "word_idx")
    return words.withColumn("duration_ms", F.lead("start_ms").over(order) - F.col("start_ms"))


def global_offset(matches: DataFrame, key: str, first: int = 8) -> DataFrame:
    """Rounded true median of each song's first offsets (their number is the feature)."""
    order = Window.partitionBy(key).orderBy("line_idx", "word_idx")
    return matches.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= first).groupBy(key).agg(T.js_round(F.median("offset_ms")).alias("offset_ms"))


def monotonic_starts(lines: DataFrame, step: int = 50) -> DataFrame:
    """Line starts of a song that grow by at least ``step`` ms: a running maximum in closed form."""
    order = Window.partitionBy("song_id").orderBy("line_idx")
    i = F.row_number().over(order)
    lead = F.max(F.col("start_ms") - step * F.col("_i")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("_i", i).withColumn("start_ms", F.col("_i") * step + F.greatest(F.lit(0), lead)).drop("_i")


def millis_stamp(ms: Column) -> Column:
    """Milliseconds as ``mm:ss.xx``."""
    return F.format_string("%02d:%05.2f", F.floor(ms / 60_000), (ms % 60_000) / 1000)


def enhanced_lrc(songs: DataFrame, starts: DataFrame, words: DataFrame) -> DataFrame:
    """(song_id, lrc): lyric texts with word stamps.

    ``songs`` (song_id, lrc); ``starts`` (song_id, line_idx, start_ms) of lines with a start of their own; ``words`` (song_id, line_idx,
    word_idx, offset_ms from the line). Lines are counted without blank and other lines, which stay as they are. Own starts grow by 50 ms
    at least; other lines keep their stamp. A first word at offset 0 has no stamp.
    """
    order = Window.partitionBy("song_id").orderBy("raw_idx")
    raw = songs.select("song_id", F.posexplode(F.split("lrc", "\n")).alias("raw_idx", "raw"))
    pattern = r"^\[(\d{2}:\d{2}\.\d{2,3})\]\s*(.*)$"
    parsed = raw.withColumns({"stamp": F.regexp_extract("raw", pattern, 1), "text": F.btrim(F.regexp_extract("raw", pattern, 2))})
    counted = parsed.withColumn("sung", (F.col("stamp") != "") & (F.col("text") != ""))
    numbered = counted.withColumn("line_idx", F.when(F.col("sung"), F.sum(F.col("sung").cast("int")).over(order) - 1).cast("long"))
    own = monotonic_starts(starts.select("song_id", F.col("line_idx").cast("long").alias("line_idx"), "start_ms"))
    by_line = words.groupBy("song_id", F.col("line_idx").cast("long").alias("line_idx")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("word_idx").cast("int"), F.col("offset_ms").cast("long")))).alias("offsets"))
    lines = numbered.join(own, ["song_id", "line_idx"], "left").join(by_line, ["song_id", "line_idx"], "left")
    at = F.coalesce(F.col("start_ms"), T.stamp_millis(F.concat(F.lit("["), "stamp", F.lit("]")))).cast("long")

    def spoken(word: Column, k: Column) -> Column:
        offset = F.element_at(F.col("offsets"), k)
        return F.when(offset.isNull() | ((k == 0) & (offset == 0)), word).otherwise(F.concat(F.lit("<"), millis_stamp(F.col("at") + offset), F.lit(">"), word))

    text = F.when(F.col("offsets").isNull(), F.col("text")).otherwise(F.array_join(F.transform(F.split("text", r"\s+"), spoken), " "))
    out = F.when(F.col("stamp") == "", F.col("raw")).when(F.col("text") == "", F.concat(F.lit("["), "stamp", F.lit("]"))).otherwise(F.concat(F.lit("["), millis_stamp(F.col("at")), F.lit("] "), text))
    done = lines.withColumn("at", at).select("song_id", "raw_idx", out.alias("line"))
    return done.groupBy("song_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("raw_idx", "line"))), lambda x: x["line"]), "\n").alias("lrc"))


def enhanced_words(lines: DataFrame, words: DataFrame) -> DataFrame:
    """(song_id, line_idx, word_idx, text, start_s, end_s) of all words of lines (song_id, line_idx, text, start_s) that have any timed word
    (song_id, line_idx, word_idx, offset_ms, duration_ms). Words without one stand at the line's start; negative offsets count as 0."""
    line = ["song_id", "line_idx"]
    split = lines.join(words.select(*line).distinct(), line, "left_semi")
    each = split.select(*line, "start_s", F.posexplode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("word_idx", "text"))
    timed = each.join(words.select(*line, "word_idx", "offset_ms", "duration_ms"), [*line, "word_idx"], "left")
    start = F.col("start_s") + F.coalesce(F.greatest(F.lit(0), F.col("offset_ms")) / 1000, F.lit(0.0))
    return timed.select(*line, "word_idx", "text", start.alias("start_s"), (start + F.coalesce(F.col("duration_ms") / 1000, F.lit(0.0))).alias("end_s"))


def payload(patches: DataFrame) -> DataFrame:
    """(song_id, lines): word patches by line, offsets from the line's first word."""
    line = patches.groupBy("song_id", "line_idx").agg(F.min("start_ms").alias("start_ms"), F.array_sort(F.collect_list(F.struct("word_idx", "start_ms", "duration_ms"))).alias("w"))
    words = F.transform("w", lambda x: F.struct(x["word_idx"].alias("idx"), (x["start_ms"] - F.col("start_ms")).alias("offset_ms"), x["duration_ms"].alias("duration_ms")))
    return line.withColumn("words", words).groupBy("song_id").agg(F.array_sort(F.collect_list(F.struct("line_idx", "start_ms", "words"))).alias("lines"))


def valid_patches(patches: DataFrame, lines: DataFrame, hashes: DataFrame) -> DataFrame:
    """Patches within the bounds of their line, made for the song's present text."""
    bounds = lines.select("song_id", "line_idx", F.size(F.split("text", r"\s+")).alias("_n"))
    fresh = patches.join(hashes, ["song_id", "lrc_hash"], "left_semi")
    return fresh.join(bounds, ["song_id", "line_idx"]).where((F.col("word_idx") >= 0) & (F.col("word_idx") < F.col("_n"))).drop("_n")


# Chords from notes


def explicit_chords(beats: DataFrame) -> DataFrame:
    """Chord changes with their length to the next change; the last is 0."""
    once = changes(beats.where("chord is not null"), "song_id", ["tick"], "chord")
    length = F.lead("tick").over(Window.partitionBy("song_id").orderBy("tick")) - F.col("tick")
    return once.withColumn("ticks", F.coalesce(length, F.lit(0)))


def pitch_histogram(notes: DataFrame, keys: list[str]) -> DataFrame:
    """Weight of each pitch class: the square root of a note's length in quarters; and the lowest pitch's class."""
    weight = F.sqrt(F.col("ticks") / 960)
    bins = [F.sum(F.when(F.col("pitch") % 12 == k, weight).otherwise(0.0)).alias(f"p{k}") for k in range(12)]
    return notes.groupBy(*keys).agg(F.array(*[b for b in bins]).alias("bins"), (F.min("pitch") % 12).alias("bass"))


def chord_templates() -> list[tuple[str, int, list[int], bool]]:
    """(name, root, pitch classes, seventh) of the five chord kinds on twelve roots, in order of roots."""
    kinds = fixed.CHORD_STEPS.items()
    return [(fixed.SHARPS[r] + fixed.CHORD_QUALITIES[k], r, [(r + i) % 12 for i in steps], k in fixed.CHORD_SEVENTHS) for r in range(12) for k, steps in kinds]


def best_chord(bins: Column, bass: Column) -> Column:
    """The template that fits best: weight inside, less 0.4 of that outside, points for the bass, half off sevenths."""
    total = F.aggregate(bins, F.lit(0.0), lambda a, x: a + x)
    scored, of = [], fixed.CHORD_WEIGHTS
    for k, (name, root, classes, seventh) in enumerate(chord_templates()):
        inside = sum((F.get(bins, F.lit(c)) for c in classes[1:]), F.get(bins, F.lit(classes[0])))
        bonus = F.when(bass == root, of["root_bass"]).when(bass.isin(classes), of["other_bass"]).otherwise(0.0)
        scored.append(F.struct((inside - of["outside"] * (total - inside) + bonus - (of["seventh"] if seventh else 0.0)).alias("score"), F.lit(-k).alias("order"), F.lit(name).alias("name")))
    return F.array_max(F.array(*scored))
