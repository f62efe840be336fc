"""Measures over samples and notes: levels, colours, class decisions, track choice, bar windows, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canticle.functions import fixed


def rms_levels(samples: DataFrame, keys: list[str], value: str, full: float = 255.0) -> DataFrame:
    """Root mean square of samples scaled by ``full``."""
    return samples.groupBy(*keys).agg(F.sqrt(F.avg(F.pow(F.col(value) / full, 2))).alias("rms"))


def mean_colour(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Mean red, green and blue of pixels that are opaque enough and neither dark nor white; null where none is left."""
    light = (F.col("r") + F.col("g") + F.col("b")) / 3
    fit = (F.col("a") >= 128) & (light >= 20) & (light <= 235)
    return pixels.groupBy(*keys).agg(*[F.floor(F.avg(F.when(fit, F.col(c))) + 0.5).alias(c) for c in ("r", "g", "b")])


def class_decision(scores: DataFrame, key: str, sets: dict[str, list[str]], singing: float = 0.5, speech: float = 0.5, instrument: float = 0.5) -> DataFrame:
    """(key, decision): allow, reject or defer from the best score of each category set; the first rule that holds decides.

    ``sets`` has singing, speech, music, instrument and priority.
    """
    best = lambda name: F.coalesce(F.max(F.when(F.col("category").isin(sets[name]), F.col("score"))), F.lit(0.0)).alias(f"_{name}")
    found = scores.groupBy(key).agg(*[best(n) for n in ("singing", "speech", "music", "instrument", "priority")])
    voice, limit = F.greatest("_singing", "_speech"), fixed.CLASS_LIMITS
    decision = (
        F.when(F.col("_singing") >= singing, "allow")
        .when((F.col("_music") > limit["music"]) & (voice > limit["voice_with_music"]), "allow")
        .when(F.col("_speech") >= speech, "allow")
        .when((F.col("_priority") > limit["priority"]) & (voice < limit["voice_with_priority"]), "reject")
        .when((F.col("_instrument") >= instrument) & (voice < limit["voice_with_instrument"]), "reject")
        .when((F.col("_music") >= limit["loud_music"]) & (voice < limit["voice_with_loud_music"]), "reject")
        .otherwise("defer")
    )
    return found.select(key, decision.alias("decision"))


def coverage(words: DataFrame, key: str, matched: Column) -> DataFrame:
    """Percent of words that are matched, 0 of none."""
    return words.groupBy(key).agg(F.count("*").alias("n_total"), F.count_if(matched).alias("n_matched")).withColumn("coverage", F.when(F.col("n_total") > 0, F.col("n_matched") / F.col("n_total") * 100).otherwise(0.0))


def track_scores(notes: DataFrame, beats: DataFrame, keys: list[str], song: str) -> DataFrame:
    """Points of a track for chords: ticks with three notes or more, onsets near beats, and runs of single notes against it."""
    ticks = notes.groupBy(*keys, "tick").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*keys).orderBy("tick")
    cells = F.explode(F.sequence(F.floor((F.col("beat") - 59) / 60), F.floor((F.col("beat") + 59) / 60)))
    near = beats.select(F.col(song).alias("_song"), "beat", cells.alias("_near"))
    hit = (F.col(song) == F.col("_song")) & (F.floor(F.col("tick") / 60) == F.col("_near")) & (F.abs(F.col("tick") - F.col("beat")) < 60)
    on = ticks.join(near, hit, "left_semi").select(*keys, "tick").withColumn("_on", F.lit(1))
    marked = ticks.withColumn("_run", ((F.col("n") == 1) & (F.lag("n").over(order) == 1)).cast("int")).join(on, [*keys, "tick"], "left")
    shares = marked.groupBy(*keys).agg(F.avg((F.col("n") >= 3).cast("int")).alias("_c"), F.avg(F.coalesce("_run", F.lit(0))).alias("_m"), F.avg(F.coalesce("_on", F.lit(0))).alias("_b"), F.count_if(F.col("n") >= 3).alias("chords"))
    points = F.when(F.col("_c") > 0.3, 2).otherwise(0) + F.when(F.col("_b") > 0.5, 1).otherwise(0) - F.when(F.col("_m") > 0.5, 2).otherwise(0)
    return shares.select(*keys, points.alias("points"), "chords")


def best_track(tracks: DataFrame, song: str) -> DataFrame:
    """Each song's track for chords: no percussion, some chords; guitars first, then most chords, then the first track."""
    guitar = F.lower("track_name").rlike("guitar|gtr|rhythm").cast("int")
    usable = tracks.where(~F.col("percussion") & (F.col("chords") > 0))
    return usable.groupBy(song).agg(F.min_by("track", F.struct(-guitar, -F.col("chords"), "track")).alias("track"))


def bar_windows(bars: DataFrame, per_beat: bool = False) -> DataFrame:
    """(song_id, start_tick, end_tick) of bars (start, ticks, beats), or of each of their beats; half open."""
    if not per_beat:
        return bars.select("song_id", F.col("start").alias("start_tick"), (F.col("start") + F.col("ticks")).alias("end_tick"))
    width = F.col("ticks") / F.col("beats")
    each = bars.select("song_id", "start", width.alias("w"), F.explode(F.sequence(F.lit(0), F.col("beats") - 1)).alias("k"))
    return each.select("song_id", (F.col("start") + F.col("k") * F.col("w")).alias("start_tick"), (F.col("start") + (F.col("k") + 1) * F.col("w")).alias("end_tick"))


def notes_in_windows(notes: DataFrame, windows: DataFrame) -> DataFrame:
    """Notes with the window that holds their tick."""
    w = windows.withColumnRenamed("song_id", "_song")
    return notes.join(w, (F.col("song_id") == F.col("_song")) & (F.col("tick") >= F.col("start_tick")) & (F.col("tick") < F.col("end_tick"))).drop("_song")
