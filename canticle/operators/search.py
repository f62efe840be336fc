"""Text search over a token-postings table: all tokens, the last as a prefix; phrases by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canticle.functions import stem
from canticle.functions import text as T

TOKEN = r"[^\p{L}\p{N}]+"


def postings(docs: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, field, pos, token), lower-case tokens of letters and digits."""
    each = [
        docs.select(F.col(id_col).alias("id"), F.lit(f).alias("field"), F.posexplode(F.filter(F.split(F.lower(F.col(f)), TOKEN), lambda x: x != "")).alias("pos", "token"))
        for f in fields
    ]
    out = each[0]
    for more in each[1:]:
        out = out.union(more)
    return out


def stemmed_postings(index: DataFrame) -> DataFrame:
    """Postings by word stems; query words must be stemmed too (:func:`canticle.functions.stem.stem`), all but a last prefix."""
    return index.withColumn("token", stem.stemmed(F.col("token")))


def stemmed_search(index: DataFrame, text: str) -> DataFrame:
    """Ids whose stemmed postings hold the stem of every word of ``text``, the last one also as a prefix."""
    words = query_tokens(text)
    stems = [stem.stem(w) for w in words]
    return prefix_search(index, " ".join(stems)) if stems else index.select("id").limit(0)


def query_tokens(text: str) -> list[str]:
    import re

    return [t for t in re.split(r"[\W_]+", text.strip().lower()) if t]


def prefix_search(index: DataFrame, text: str, tokens_are_prefixes: bool = False) -> DataFrame:
    """Ids whose postings hold every token of ``text``; the last one as a prefix. Filters reach the scan."""
    tokens = query_tokens(text)
    if not tokens:
        return index.select("id").limit(0)
    tests = [F.col("token").startswith(t) if k == len(tokens) - 1 or tokens_are_prefixes else F.col("token") == t for k, t in enumerate(tokens)]
    any_test = tests[0]
    for t in tests[1:]:
        any_test = any_test | t
    hits = index.where(any_test).groupBy("id").agg(*[F.max(t).alias(f"_{k}") for k, t in enumerate(tests)])
    for k in range(len(tests)):
        hits = hits.where(F.col(f"_{k}"))
    return hits.select("id")


def phrase_search(index: DataFrame, phrases: dict[str, str]) -> DataFrame:
    """Ids that hold, for every field, its phrase as adjacent tokens in order."""
    out = None
    for field, text in phrases.items():
        tokens = query_tokens(text)
        starts = index.where((F.col("field") == field) & F.col("token").isin(tokens))
        at = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col("token") == t).alias("hit")) for k, t in enumerate(tokens)])).alias("x")
        aligned = starts.select("id", "pos", at).where("x.hit").select("id", (F.col("pos") - F.col("x.k")).alias("start"), "x.k")
        found = aligned.groupBy("id", "start").agg(F.count_distinct("k").alias("n")).where(F.col("n") == len(tokens)).select("id").distinct()
        out = found if out is None else out.join(found, "id", "left_semi")
    return out


def bm25(index: DataFrame, text: str, k1: float = 1.2, b: float = 0.75, weights: dict[str, float] | None = None) -> DataFrame:
    """(id, score) of documents with any token of ``text``. Corpus statistics cover all postings; ``weights`` by field count a token
    in a field so many times."""
    tokens = query_tokens(text)
    lengths = index.groupBy("id").agg(F.count("*").alias("len"))
    n, mean = lengths.agg(F.count("*"), F.avg("len")).first()
    tf = index.where(F.col("token").isin(tokens)).groupBy("id", "token").agg(F.sum(field_times(weights)).alias("tf"))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))  # one row a query token
    return tf.join(F.broadcast(df), "token").join(lengths, "id").groupBy("id").agg(F.sum(bm25_points(n or 0, mean or 1.0, k1, b)).alias("score"))


def field_times(weights: dict[str, float] | None) -> Column:
    """How often a token counts, by its ``field``."""
    times = F.lit(1.0)
    for field, weight in (weights or {}).items():
        times = F.when(F.col("field") == field, weight).otherwise(times)
    return times


def bm25_points(n: int, mean: float, k1: float, b: float) -> Column:
    """A token's part of a document's score, from ``tf``, ``df`` and ``len``, in ``n`` documents of ``mean`` length."""
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(mean)))


def fuzzy_songs(songs: DataFrame, query: str, least: float = 0.3) -> DataFrame:
    score = T.fuzzy_song_score(F.lit(query.strip()), F.col("title"), F.col("artist"))
    return songs.withColumn("score", score).where(F.col("score") >= least)


def page(rows: DataFrame, order: list, limit: int, offset: int, most: int = 50) -> DataFrame:
    """One page under a total order; limits are clamped."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(1, min(most, limit)))


def counted_page(rows: DataFrame, order: list, limit: int, offset: int, most: int = 50) -> DataFrame:
    """One page with ``total`` rows in all and whether it ``has_more``."""
    total = rows.count()
    shown = max(1, min(most, limit)) + max(0, offset)
    return page(rows, order, limit, offset, most).withColumns({"total": F.lit(total).cast("long"), "has_more": F.lit(total > shown)})


def reranked_by_duration(rows: DataFrame, seconds: int, first: int = 10) -> DataFrame:
    """The best ``first`` by quality, reordered by quality plus closeness of duration."""
    gap = F.abs(F.col("duration_sec") - seconds)
    points = F.when(gap <= 2, 50).when(gap <= 5, 30).when(gap <= 10, 10).otherwise(0)
    return rows.orderBy(F.desc("quality"), "id").limit(first).withColumn("rank_score", F.col("quality") + points).orderBy(F.desc("rank_score"), "id")
