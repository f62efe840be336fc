"""Words from sung syllables, and their times put on the words of a lyric text; window functions only.

Rules that a loop would carry from syllable to syllable are flags of a row and its neighbours, and running sums of flags number the words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canticle.functions import fixed
from canticle.operators import timeline


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s﻿]+|[\s﻿]+$", "")


def built_words(syllables: DataFrame) -> DataFrame:
    """(song_id, word_idx, tick, word) of syllables (song_id, idx, tick, text).

    A hyphen at a syllable's end, or a bare hyphen right after it, leaves the word open; a syllable with a hyphen in front goes on with it, and
    so does one behind a hyphen if it begins in lower case or ends with a hyphen too. Any other closes an open word and begins its own, which
    mends texts such as ``lse-`` before ``Be``. Blank syllables say nothing, but one between a syllable and a bare hyphen parts them. A
    word has the tick of its first syllable; a word without letters is none.
    """
    order = Window.partitionBy("song_id").orderBy("idx")
    said = syllables.select("song_id", "idx", "tick", stripped(F.coalesce("text", F.lit(""))).alias("t")).withColumn("bare_next", F.coalesce(F.lead("t").over(order) == "-", F.lit(False)))
    spoken = said.where("t <> ''").withColumn("after_hyphen", F.coalesce(F.endswith(F.lag("t").over(order), F.lit("-")), F.lit(False))).where("t <> '-'")
    leads, trails = F.startswith("t", F.lit("-")), F.endswith("t", F.lit("-"))
    goes_on = leads | (F.col("after_hyphen") & (trails | F.col("t").rlike("^[a-z]")))
    flagged = spoken.select("song_id", "idx", "tick", F.regexp_replace("t", "^-|-$", "").alias("part"), goes_on.alias("goes_on"), (~trails & ~F.col("bare_next")).alias("closes"))
    after_end = F.coalesce(F.lag("closes").over(order), F.lit(True))
    # A syllable that doesn't go on begins a word, unless all since the last such syllable was empty.
    stretch = flagged.withColumn("after_end", after_end).withColumn("may", F.col("after_end") | ~F.col("goes_on")).withColumn("stretch", F.sum(F.col("may").cast("int")).over(order))
    filled = stretch.withColumn("filled", F.max(F.col("part") != "").over(Window.partitionBy("song_id", "stretch")))
    begins = F.col("may") & (F.col("after_end") | F.coalesce(F.lag("filled").over(order), F.lit(True)))
    numbered = filled.withColumn("begins", begins).withColumn("word_no", F.sum(F.col("begins").cast("int")).over(order))
    return _joined(numbered)


def _joined(numbered: DataFrame) -> DataFrame:
    """(song_id, word_idx, tick, word) of parts (song_id, idx, tick, part, word_no)."""
    parts = F.array_sort(F.collect_list(F.struct("idx", "tick", "part")))
    words = numbered.groupBy("song_id", "word_no").agg(parts.alias("p")).select("song_id", "word_no", F.col("p")[0]["tick"].alias("tick"), F.array_join(F.transform("p", lambda x: x["part"]), "").alias("word"))
    place = F.row_number().over(Window.partitionBy("song_id").orderBy("word_no")) - 1
    return words.where("word <> ''").select("song_id", place.alias("word_idx"), "tick", "word")


def score_words(syllables: DataFrame) -> DataFrame:
    """(song_id, word_idx, tick, word) of a score's syllables (song_id, idx, tick, text): only a hyphen at the end leaves a word open. Empty
    words count, but for an open one at the end."""
    order = Window.partitionBy("song_id").orderBy("idx")
    t = stripped(F.coalesce("text", F.lit("")))
    said = syllables.select("song_id", "idx", "tick", F.regexp_replace(t, "-$", "").alias("part"), F.endswith(t, F.lit("-")).alias("open"))
    begins = ~F.coalesce(F.lag("open").over(order), F.lit(False))
    numbered = said.withColumn("begins", begins.cast("int")).withColumn("word_no", F.sum("begins").over(order))
    parts = F.array_sort(F.collect_list(F.struct("idx", "tick", "part", "open")))
    words = numbered.groupBy("song_id", "word_no").agg(parts.alias("p"))
    told = words.select("song_id", (F.col("word_no") - 1).cast("int").alias("word_idx"), F.col("p")[0]["tick"].alias("tick"), F.array_join(F.transform("p", lambda x: x["part"]), "").alias("word"), F.element_at("p", -1)["open"].alias("open"))
    return told.where("word <> '' or not open").drop("open")


def score_seconds(positions: DataFrame, tempos: DataFrame, ppq: int = 960) -> DataFrame:
    """``positions`` (song_id, tick, ...) with ``seconds``: whole ticks through the tempos (song_id, idx, tick, bpm) of their score. Before the first
    tempo that one holds; without any, 120. Of several at one tick the last by ``idx`` counts."""
    bpm = F.col("bpm").cast("double")
    firsts = tempos.groupBy("song_id").agg(F.min_by(bpm, F.struct("tick", "idx")).alias("bpm"), F.min("tick").alias("first"))
    start = positions.select("song_id").distinct().join(firsts, "song_id", "left").where("first is null or first > 0").select("song_id", F.lit(0).cast("long").alias("tick"), F.coalesce("bpm", F.lit(120.0)).alias("bpm"))
    every = tempos.groupBy("song_id", F.col("tick").cast("long").alias("tick")).agg(F.max_by(bpm, "idx").alias("bpm")).unionByName(start)
    return timeline.ticks_to_ms(positions.withColumn("tick", F.col("tick").cast("long")), every, "song_id", ppq).withColumn("seconds", F.col("ms") / 1000).drop("ms")


def timecode(centis: Column) -> Column:
    return F.format_string("%02d:%02d.%02d", F.floor(centis / 6000), F.floor(centis / 100) % 60, centis % 100)


def tag_seconds(tag: Column) -> Column:
    """Seconds of a whole ``[mm:ss.cc]``, else null."""
    part = lambda k: F.regexp_extract(tag, r"^\[(\d{2}):(\d{2})\.(\d{2})\]$", k).try_cast("int")
    return part(1) * 60 + part(2) + part(3) / 100.0


def lyric_lines(songs: DataFrame) -> DataFrame:
    """(song_id, raw_idx, tag, text) of all lines of (song_id, lrc): the first bracket is the tag."""
    raw = songs.select("song_id", F.posexplode(F.split(F.regexp_replace("lrc", r"\r\n?", "\n"), "\n")).alias("raw_idx", "raw"), F.endswith("lrc", F.lit("\n")).alias("ended"))
    last = F.col("raw_idx") == F.max("raw_idx").over(Window.partitionBy("song_id"))
    kept = raw.withColumn("last", last).where(~(F.col("last") & F.col("ended") & (F.col("raw") == "")))
    tag = F.regexp_extract("raw", r"^(\[[^\]]*\])", 1)
    text = F.when(tag == "", F.col("raw")).otherwise(F.regexp_replace("raw", r"(?U)^\[[^\]]*\]\s*", ""))
    return kept.select("song_id", "raw_idx", tag.alias("tag"), text.alias("text"))


def merged_score(songs: DataFrame, words: DataFrame, tempos: DataFrame, tolerance: float = 15.0, force: bool = False, ppq: int = 960) -> DataFrame:
    """(song_id, too_long, lrc): lyric texts (song_id, lrc) with the times of a score's words (song_id, word_idx, tick, word).

    Words are dealt out in order over the tokens of all lines, one each; the token's own text stays. Tokens that are no word, and those beyond the
    score's last word, get none. Where the score ends over ``tolerance`` seconds after the last line's time, ``too_long`` is true
    and the text null, unless ``force``.
    """
    order = Window.partitionBy("song_id").orderBy("raw_idx", "place")
    lines = lyric_lines(songs)
    centis = F.rint(F.col("seconds") * 100).cast("long")
    timed = score_seconds(words, tempos, ppq).select("song_id", "word_idx", centis.alias("centis"))
    tokens = lines.where("text <> ''").select("song_id", "raw_idx", F.posexplode(F.split("text", " ")).alias("place", "token")).where("token <> ''")
    usable = stripped(F.regexp_replace(F.regexp_replace("token", fixed.SCORE_TOKEN_LEAD, ""), fixed.SCORE_TOKEN_TRAIL, "")) != ""
    numbered = tokens.withColumn("usable", usable).withColumn("word_idx", F.when(F.col("usable"), F.sum(F.col("usable").cast("int")).over(order) - 1).cast("int"))
    spoken = numbered.join(timed, ["song_id", "word_idx"], "left")
    said = F.when(F.col("centis").isNull(), F.col("token")).otherwise(F.concat(F.lit("<"), timecode(F.col("centis")), F.lit(">"), F.col("token")))
    by_line = spoken.groupBy("song_id", "raw_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", said.alias("s")))), lambda x: x["s"]), " ").alias("said"))
    told = F.when(F.col("text") == "", F.col("tag")).otherwise(F.regexp_replace(F.concat("tag", F.lit(" "), F.coalesce("said", F.lit(""))), r"(?U)\s+$", ""))
    at = tag_seconds(F.col("tag"))
    texts = lines.join(by_line, ["song_id", "raw_idx"], "left").groupBy("song_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("raw_idx", told.alias("t")))), lambda x: x["t"]), "\n").alias("lrc"), F.max_by(at, F.when(at.isNotNull(), F.col("raw_idx"))).alias("ends")
    )
    last = timed.groupBy("song_id").agg(F.max_by("centis", "word_idx").alias("last"))
    long_ = F.coalesce((F.col("last") < 600_000) & (F.col("last") / 100.0 - F.col("ends") > tolerance), F.lit(False))
    return texts.join(last, "song_id", "left").select("song_id", long_.alias("too_long"), F.when(~long_ | F.lit(force), F.col("lrc")).alias("lrc"))
