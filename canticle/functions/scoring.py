"""Quality and match scores as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from canticle.functions import fixed, text as T

REJECTED, NO_ARTIST = -1000, -500
ACCEPTED = 80


def steps(value: Column, edges: Sequence[tuple[float, float]], beyond: float) -> Column:
    """The points of the first edge that ``value`` doesn't exceed."""
    out = F.lit(beyond)
    for edge, points in reversed(list(edges)):
        out = F.when(value <= edge, points).otherwise(out)
    return out


def duration_score(seconds: Column, millis: Column) -> Column:
    """Points for how close two durations are; far ones are rejected."""
    gap = F.abs(seconds - F.floor(millis / 1000))
    return steps(gap, fixed.DURATION_POINTS, REJECTED)


def duration_tolerance(confidence: Column, seconds: Column) -> Column:
    """Largest gap in seconds by confidence (high, medium, low), a tenth of the duration, 90 at most."""
    base = F.when(confidence == "high", 60).when(confidence == "medium", 45).otherwise(30)
    return F.least(F.lit(90), F.greatest(base, (seconds * 0.10).cast("int")))


def quality_score(title: Column, artist: Column, album: Column, median_seconds: Column | None = None, seconds: Column | None = None) -> Column:
    """Points for a variant: album class, marks of live or garbage titles, album name, closeness to the median."""
    points = F.create_map(*[F.lit(x) for pair in fixed.ALBUM_POINTS.items() for x in pair])
    out = F.element_at(points, T.album_class(album)) - F.when(T.is_live_or_remix(title) | T.is_live_or_remix(album), 30).otherwise(0)
    out = out - F.when(T.is_garbage_title(title), 50).otherwise(0) - F.when(T.title_contains_artist(title, artist), 40).otherwise(0)
    if median_seconds is not None:
        out = out + F.coalesce(steps(F.abs(seconds - median_seconds), [(2, 30), (5, 20), (10, 10)], 0), F.lit(0))
    return (out + F.when(~T.is_garbage_album(album), 10).otherwise(0)).cast("int")


def artist_similarity(group_artist: Column, artists: Column) -> Column:
    """Best similarity of the group's artist to any credited one (already normalized)."""
    return F.coalesce(F.array_max(F.transform(artists, lambda a: T.jaccard(group_artist, a))), F.lit(0.0))


def combined_score(similarity: Column, seconds: Column, millis: Column, quality: Column, title: Column | None, popularity: Column, garbage: Column | None = None) -> Column:
    """Score of a candidate: artist, duration, quality, clean title and popularity; -500 and -1000 are rejections. ``garbage``: whether the title is, where that is known."""
    candidate_s = F.floor(millis / 1000)
    gap = F.abs(seconds - candidate_s)
    exact = similarity >= 1.0
    confidence = F.when(exact, "high").when(similarity >= 0.7, "medium").otherwise("low")
    points = steps(gap, fixed.DURATION_POINTS, 1)
    total = points + F.when(exact, 50).otherwise((similarity * 30).cast("int")) + quality + F.when(T.is_garbage_title(title) if garbage is None else garbage, 0).otherwise(30)
    total = total + F.when((gap > 30) & exact, -20).otherwise(0) + F.floor(popularity / 10)
    return (
        F.when(similarity < 0.3, NO_ARTIST)
        .when(gap > duration_tolerance(confidence, candidate_s), REJECTED)
        .when((gap > 30) & ~exact, REJECTED)
        .otherwise(total)
        .cast("int")
    )


def choice_order(album_rank: Column, score: Column, *ties: Column) -> Column:
    """What the best candidate of a group has least: accepted ones by album class, then score, then ``ties``."""
    viable = score >= ACCEPTED
    return F.struct((~viable).cast("int").alias("a"), F.when(viable, album_rank).otherwise(0).alias("b"), (-score).alias("c"), *ties)


def candidate_score(valid: Column, gap: Column, album: Column, canonical_album: Column, track: Column, artist: Column, want_track: Column, want_artist: Column, want_studio: bool = True) -> Column:
    """Points of a lyrics candidate against what is known of the song; 0 without valid lyrics."""
    low = F.btrim(F.lower(F.coalesce(album, F.lit(""))))
    canon = F.btrim(F.lower(canonical_album))
    same_album = (canon != "") & (low != "") & (F.contains(low, canon) | F.contains(canon, low))
    studio = T.is_studio_version(track, album)
    plain = lambda t: F.btrim(F.regexp_replace(F.lower(t), r"[^\w\s]", ""))

    def fit(have: Column, want: Column, miss: int) -> Column:
        a, b = plain(have), plain(want)
        return F.when(want.isNull() | (want == ""), 0).when(a == b, 40).when(F.contains(a, b) | F.contains(b, a), 20).otherwise(miss)

    total = (
        F.lit(100)
        + F.coalesce(steps(gap, [(2, 50), (5, 30), (10, 10)], 0), F.lit(0))
        + F.when((low != "") & ~low.isin(*fixed.LOW_QUALITY_ALBUMS), 20).otherwise(0)
        + F.when(F.coalesce(same_album, F.lit(False)), 30).otherwise(0)
        + F.when(studio if want_studio else ~studio, 25).otherwise(0)
        + fit(artist, want_artist, -60)
        + fit(track, want_track, 0)
    )
    return F.when(valid, total).otherwise(0)


def lyrics_score(lyrics: Column, gap: Column, album: Column) -> Column:
    low = F.btrim(F.lower(F.coalesce(album, F.lit(""))))
    good = F.when((low != "") & ~low.isin(*fixed.LOW_QUALITY_ALBUMS), 20).otherwise(0)
    return F.when(T.has_timestamps(lyrics), 100 + F.coalesce(steps(gap, [(2, 50), (5, 30), (10, 10)], 0), F.lit(0)) + good).otherwise(0)


def success_rate(successes: Column, total: Column) -> Column:
    """Percent to one decimal, 0 of nothing."""
    return F.when(total > 0, F.floor(successes / total * 1000 + 0.5) / 10).otherwise(0.0)
