"""Analysis of rows that found no match: what would have helped, and what a newer normalization changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canticle.functions import fixed
from canticle.functions import text as T
from canticle.operators import near

KEY = ["title_norm", "artist_norm"]


def recovery(failures: DataFrame, catalog: DataFrame) -> DataFrame:
    """``failures`` (title_norm, artist_norm) with the first ``strategy`` that finds them in the catalog, or ``not_found``.

    Each strategy is a key to look up; keys of all strategies are looked up in one join. What is left is compared with its artist's
    titles by edit distance over the longer length in bytes: ASCII titles that share a segment (:mod:`canticle.operators.near`), and, where a
    title has other letters, those of like length.
    """
    title, artist = F.col("title_norm"), F.col("artist_norm")
    stripped = F.regexp_replace(F.regexp_replace(title, fixed.VERSION_SUFFIX, ""), fixed.VERSION_DASH, "")
    primary = F.btrim(F.split(F.split(F.split(artist, ",")[0], " and ")[0], " & ")[0])
    number = F.regexp_replace(title, fixed.TRACK_NUMBER, "")
    tries = [
        ("suffix", stripped, artist, stripped != title),
        ("primary_artist", title, primary, primary != artist),
        ("the_prefix", F.concat(F.lit("the "), title), artist, ~title.startswith("the ")),
        ("track_number", number, artist, number != title),
    ]
    options = F.array(*[F.when(test, F.struct(F.lit(k).alias("rank"), F.lit(name).alias("name"), t.alias("t"), a.alias("a"))) for k, (name, t, a, test) in enumerate(tries)])
    rows = failures.select(*KEY).distinct()
    asked = rows.withColumn("o", F.explode(F.filter(options, lambda o: o.isNotNull())))
    keys = catalog.select(F.col("title_norm").alias("_t"), F.col("artist_norm").alias("_a")).distinct()
    hits = asked.join(keys, (F.col("o.t") == F.col("_t")) & (F.col("o.a") == F.col("_a"))).groupBy(*KEY).agg(F.min_by("o.name", "o.rank").alias("strategy"))
    open_ = rows.join(hits, KEY, "left_anti")
    longer, shorter = F.greatest(F.octet_length("title_norm"), F.octet_length("_t")), F.least(F.octet_length("title_norm"), F.octet_length("_t"))
    plain = lambda t: F.octet_length(t) == F.char_length(t)
    close = near.candidates(open_.where(plain("title_norm")), keys.where(plain("_t")), [("artist_norm", "_a")], "title_norm", "_t", 15)
    close = close.union(open_.join(keys, (artist == F.col("_a")) & (shorter * 100 >= longer * 85) & ~(plain("title_norm") & plain("_t"))))
    best = close.groupBy(*KEY).agg(F.max(T.byte_similarity(title, F.col("_t"))).alias("s"))
    step = F.when(F.col("s") >= 0.95, "fuzzy_95").when(F.col("s") >= 0.90, "fuzzy_90").when(F.col("s") >= 0.85, "fuzzy_85")
    found = hits.unionByName(best.select(*KEY, step.alias("strategy")).where("strategy is not null"))
    return failures.join(found, KEY, "left").withColumn("strategy", F.coalesce("strategy", F.lit("not_found")))


def strategy_counts(failures: DataFrame, catalog: DataFrame) -> DataFrame:
    """(strategy, rows)."""
    return recovery(failures, catalog).groupBy("strategy").agg(F.count("*").alias("rows"))


def change_kind(title: Column, old_norm: Column, new_norm: Column) -> Column:
    """What about a title made a newer normalization differ from the old one; null where it doesn't. The first kind counts."""
    digit = lambda x: F.coalesce(x.rlike("^[0-9]"), F.lit(False))
    first = fixed.TITLE_PREFIXES[2][0]
    numbered = title.rlike(T.java(first)) | (digit(title) & digit(old_norm) & ~digit(new_norm) & (new_norm != ""))
    kinds = (
        ("track_number", numbered),
        ("bracket", title.rlike(T.java(fixed.TITLE_SUFFIXES[0]))),
        ("extension", title.rlike(T.java(fixed.TITLE_PREFIXES[0][0]))),
        ("year", title.rlike(T.java(fixed.TITLE_SUFFIXES[1]))),
        ("encoding", F.contains(title, F.lit("?")) | F.contains(title, F.lit(" s ")) | F.contains(title, F.lit(" t "))),
    )
    out = F.lit("other")
    for name, test in reversed(kinds):
        out = F.when(test, name).otherwise(out)
    return F.when(new_norm != old_norm, out)
