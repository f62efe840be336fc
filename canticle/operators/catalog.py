"""The catalog of the resolution from its source tables, and what else is known of matched rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canticle.functions import text as T


def built_catalog(tracks: DataFrame, credits: DataFrame, artists: DataFrame, albums: DataFrame, least_popularity: int = 0) -> DataFrame:
    """A row for each track and credited artist: (track_id, title, title_norm, artist_norm, artist_names, artists, duration_ms,
    popularity, album_name, album_type).

    ``tracks`` (track_id, name, album_id, duration_ms, popularity), ``credits`` (track_id, artist_id, ord), ``artists`` (artist_id,
    name), ``albums`` (album_id, album_name, album_type). Names are normalized once an artist and once a track; artists are in credited
    order; tracks without artists are left out, those without an album stay.
    """
    named = artists.select("artist_id", F.col("name").alias("artist"))
    named = named.withColumn("_norm", T.normalize_artist(F.col("artist"))).select("artist_id", "artist", "_norm")
    credited = credits.join(named, "artist_id").groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("ord", "artist", "_norm"))).alias("_c"))
    rows = tracks.where(F.col("popularity") >= least_popularity).withColumn("title_norm", T.normalize_title(F.col("name")))
    out = rows.join(credited, "track_id").join(albums.select("album_id", "album_name", "album_type"), "album_id", "left")
    lists = out.withColumns({"artist_names": F.transform("_c", lambda c: c["artist"]), "artists": F.transform("_c", lambda c: c["_norm"])})
    each = lists.withColumn("artist_norm", F.explode(F.array_distinct("artists")))
    return each.select("track_id", F.col("name").alias("title"), "title_norm", "artist_norm", "artist_names", "artists", "duration_ms", "popularity", "album_name", "album_type")


def with_features(rows: DataFrame, features: DataFrame, images: DataFrame) -> DataFrame:
    """``rows`` (track_id) with tempo, musical_key and image_url; null where nothing is known. ``features`` (track_id, tempo, key,
    mode), ``images`` (track_id, url): one row a track at most."""
    known = features.select("track_id", "tempo", T.musical_key(F.col("key"), F.col("mode")).alias("musical_key"))
    return rows.join(known, "track_id", "left").join(images.select("track_id", F.col("url").alias("image_url")), "track_id", "left")
