"""Entity resolution: lyric tracks are grouped and matched to a catalog in phases.

Each phase is a DataFrame of candidate pairs; a later phase takes groups that earlier ones left (anti joins and
flag columns), so eligibility is data. Where an unordered cut would decide, orders are total: popularity descending,
then the lowest id.

Input columns: lyric tracks (id, title, artist, album, duration_sec); catalog (track_id, title_norm, artist_norm, title,
artists array of normalized names, duration_ms, popularity, album_type in Album, Single, Compilation, Other).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canticle.functions import scoring as S
from canticle.functions import text as T
from canticle.operators import near
from canticle.plans.cut import written
from canticle.plans.names import unused

ALBUM_RANK = {"album": 0, "single": 1, "compilation": 2}
GROUP = ["title_norm", "artist_norm"]


def album_rank(kind: Column) -> Column:
    out = F.lit(3)
    for name, rank in ALBUM_RANK.items():
        out = F.when(F.lower(kind) == name, rank).otherwise(out)
    return out


def read_tracks(tracks: DataFrame, lyrics: DataFrame, artists: list[str] | None = None) -> DataFrame:
    """Tracks whose last lyrics are synced, 45 to 600 seconds long (exclusive), with usable album and title."""
    synced = lyrics.where("has_synced_lyrics = 1").select(F.col("id").alias("last_lyrics_id"))
    out = tracks.join(synced, "last_lyrics_id").where((F.col("duration") > 45) & (F.col("duration") < 600))
    if artists:
        hit = F.lit(False)
        for name in artists:
            hit = hit | F.contains(F.lower("artist"), F.lit(name.lower()))
        out = out.where(hit)
    out = out.where(~T.is_garbage_album(F.col("album")) & ~T.is_skipped_title(F.col("title")))
    return out.withColumn("duration_sec", F.round("duration").cast("long"))


def variants(tracks: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Tracks with their group key and quality."""
    return T.with_norms(tracks, aliases).withColumn("quality", S.quality_score(F.col("title"), F.col("artist"), F.col("album")))


def canonical(rows: DataFrame) -> DataFrame:
    """One row a group: its best variant by quality, then lowest id."""
    return rows.groupBy(*GROUP).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in GROUP]), F.struct("quality", -F.col("id"))).alias("v")).select(*GROUP, "v.*")


def top_candidates(catalog: DataFrame, key: list[str], n: int) -> DataFrame:
    order = Window.partitionBy(*key).orderBy(F.desc("popularity"), "track_id")
    return catalog.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= n).drop("_nth")


def bucketed_candidates(catalog: DataFrame, bucket_ms: int = 5_000, most: int = 20) -> DataFrame:
    """Best candidate of each key and duration bucket, then the first ``most`` of a key by popularity."""
    bucket = Window.partitionBy(*GROUP, F.floor(F.col("duration_ms") / bucket_ms)).orderBy(F.desc("popularity"), "track_id")
    return top_candidates(catalog.withColumn("_b", F.row_number().over(bucket)).where("_b = 1").drop("_b"), GROUP, most)


def _renamed(catalog: DataFrame) -> DataFrame:
    return catalog.select(*[F.col(c).alias(f"c_{c}") for c in catalog.columns])


def scored_pairs(pairs: DataFrame, phase: str, bonus: Column | int = 0, similarity: Column | None = None) -> DataFrame:
    """Pairs (a variant with columns of a catalog row ``c_*``) with score, accepted at 80 points."""
    sim = S.artist_similarity(F.col("artist_norm"), F.col("c_artists")) if similarity is None else similarity
    garbage = F.col("garbage_title") if "garbage_title" in pairs.columns else None
    score = S.combined_score(sim, F.col("duration_sec"), F.col("c_duration_ms"), F.col("quality"), None if garbage is not None else F.col("title"), F.col("c_popularity"), garbage)
    total = F.when(score > S.NO_ARTIST, score + bonus).otherwise(score)
    return pairs.withColumns({"score": total.cast("int"), "phase": F.lit(phase)})


def distinct_variants(rows: DataFrame) -> DataFrame:
    """Of a group's variants that any candidate scores alike, the one with the lowest id, which :func:`best_match` takes of them. A group's pairs then
    don't grow with its copies."""
    alike = [*GROUP, "duration_sec", "quality", T.is_garbage_title(F.col("title")).alias("garbage_title")]
    return rows.groupBy(*alike).agg(F.min("id").alias("id"))


def best_match(pairs: DataFrame) -> DataFrame:
    """One accepted pair a group: albums first, then score, then lowest candidate and variant id."""
    order = S.choice_order(album_rank(F.col("c_album_type")), F.col("score"), F.col("c_track_id"), F.col("id"))
    keep = ["id", "c_track_id", "c_album_type", "c_popularity", "c_duration_ms", "score", "phase"]
    return pairs.where(F.col("score") >= S.ACCEPTED).groupBy(*GROUP).agg(F.min_by(F.struct(*keep), order).alias("m")).select(*GROUP, "m.*")


def exact_pairs(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    return rows.join(_renamed(bucketed_candidates(catalog)), (F.col("title_norm") == F.col("c_title_norm")) & (F.col("artist_norm") == F.col("c_artist_norm")))


def primary_artist_pairs(rows: DataFrame, catalog: DataFrame, seen: DataFrame) -> DataFrame:
    """Groups without any candidate by their whole artist, by the first artist named."""
    left = rows.join(seen, GROUP, "left_anti").withColumn("_primary", T.primary_artist(F.col("artist_norm"))).where("_primary is not null")
    cands = _renamed(bucketed_candidates(catalog))
    return left.join(cands, (F.col("title_norm") == F.col("c_title_norm")) & (F.col("_primary") == F.col("c_artist_norm"))).drop("_primary")


def near_best_variant(seconds: Column, millis: Column) -> Column:
    """Whether a candidate is within 30 seconds of a group's best variant; rescues test that one alone."""
    return F.abs(seconds - F.floor(millis / 1000)) <= 30


def _within_30_seconds(groups: DataFrame, cands: DataFrame, on: Column) -> DataFrame:
    """Groups (their best variant's length in ``_seconds``) and all candidates ``on`` their key that :func:`near_best_variant` admits. They meet in cells of
    time, so not all rows of a key are tried with all."""
    cell = lambda s: F.floor(s / 60)
    dealt = groups.withColumn("_cell", F.explode(F.array_distinct(F.array(cell(F.col("_seconds") - 30), cell(F.col("_seconds") + 30)))))
    same = on & (F.col("_cell") == cell(F.floor(F.col("c_duration_ms") / 1000)))
    return dealt.join(cands, same & near_best_variant(F.col("_seconds"), F.col("c_duration_ms"))).drop("_cell")


#: Artists of a title that a task compares with the title's groups at once.
TOGETHER = 256


def _like_artists(groups: DataFrame, named: DataFrame, least: float) -> DataFrame:
    """``groups`` with each artist (``_name``) of their title that is spelled alike, and how alike (``_near``). Artists of a title, each taken once, are dealt into
    parts of about ``TOGETHER``, which all groups of the title visit, so that a title of many artists isn't one task's. Visits are few bytes and much work: the
    number of their partitions is given, so that adaptive execution doesn't merge them."""
    spark = groups.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    titles = groups.select("title_norm").distinct()
    names = named.select(F.col("c_title_norm").alias("title_norm"), "_name").distinct().join(titles, "title_norm", "left_semi")
    parts = names.groupBy("title_norm").agg(F.ceil(F.count("*") / TOGETHER).alias("_parts"))
    dealt = names.join(parts, "title_norm").withColumn("_part", F.pmod(F.xxhash64("_name"), F.col("_parts"))).drop("_parts")
    visits = groups.join(parts, "title_norm").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")
    near = T.edit_similarity(F.col("artist_norm"), F.col("_name"))
    return visits.repartition(tasks, "title_norm", "_part").join(dealt, ["title_norm", "_part"]).drop("_part").withColumn("_near", near).where(F.col("_near") >= least)


def rescue_pairs(rows: DataFrame, catalog: DataFrame, least: float = 0.70) -> DataFrame:
    """By title alone, then artists of like spelling and duration. All candidates of a title are tested, whatever their popularity.

    Likeness of spelling (``_near``) only admits a candidate and pays a bonus; its score has the artists' word similarity.
    """
    groups = canonical(rows).select(*GROUP, F.col("duration_sec").alias("_seconds")).where(~T.is_common_title(F.col("title_norm")))
    cands = _renamed(catalog)
    named = cands.withColumn("_name", F.explode(F.array_distinct("c_artists")))
    like = _like_artists(groups, named, least).withColumnRenamed("_name", "_like")
    close = _within_30_seconds(like, named, (F.col("title_norm") == F.col("c_title_norm")) & (F.col("_like") == F.col("_name")))
    return rows.join(close.groupBy(*GROUP, *cands.columns).agg(F.max("_near").alias("_near")), GROUP)


def fuzzy_pairs(rows: DataFrame, catalog: DataFrame, least: float = 0.90) -> DataFrame:
    """Same artist, most similar title of at least ``least``, then the first of all its candidates by popularity that is near enough.
    Titles of an artist meet on equal segments (:mod:`canticle.operators.near`), not all with all."""
    groups = canonical(rows).select(*GROUP, F.col("duration_sec").alias("_seconds")).where(~T.is_common_title(F.col("title_norm")))
    titles = catalog.select(*GROUP).distinct().select(F.col("title_norm").alias("_catalog_title"), F.col("artist_norm").alias("_artist"))
    a, b = F.char_length("title_norm"), F.char_length("_catalog_title")
    longer = F.greatest(a, b)
    close = near.candidates(groups, titles, [("artist_norm", "_artist")], "title_norm", "_catalog_title", round(100 * (1 - least)))
    distance = F.levenshtein(F.col("title_norm"), F.col("_catalog_title"))
    measured = close.withColumn("_sim", F.when(longer == 0, 1.0).otherwise(1 - distance / longer)).where(F.col("_sim") >= least)
    best = measured.groupBy(*GROUP, "_seconds").agg(F.min_by(F.struct("_catalog_title", "_sim"), F.struct(-F.col("_sim"), "_catalog_title")).alias("b")).select(*GROUP, "_seconds", "b.*")
    found = _within_30_seconds(best, _renamed(catalog), (F.col("_catalog_title") == F.col("c_title_norm")) & (F.col("artist_norm") == F.col("c_artist_norm")))
    first = found.withColumn("_n", F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("c_popularity"), "c_track_id"))).where("_n = 1")
    return rows.join(first.drop("_n", "_seconds"), GROUP)


def unpopular_pairs(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog rows of popularity 0: same title, any credited artist, however many rows a title has. A candidate must be within three seconds
    of some open variant under its title (they meet in cells of time); then all variants of its group are scored. Of an artist's candidates that any
    variant scores alike, by album and whole second, the one with the lowest id stands for all, as :func:`best_match` takes it of them."""
    cell = lambda ms: F.floor(ms / 6000)
    millis = F.col("duration_sec") * 1000
    cells = F.explode(F.array_distinct(F.array(cell(millis - 3000), cell(millis + 3000))))
    lengths = rows.select(F.col("title_norm").alias("_t"), millis.alias("_ms"), cells.alias("_cell")).distinct()
    near = (F.col("c_title_norm") == F.col("_t")) & (cell(F.col("c_duration_ms")) == F.col("_cell")) & F.col("_ms").between(F.col("c_duration_ms") - 3000, F.col("c_duration_ms") + 3000)
    named = _renamed(catalog.where("popularity = 0")).join(lengths, near, "left_semi").withColumn("_artist", F.explode(F.array_distinct("c_artists")))
    alike = ["c_title_norm", "_artist", "c_album_type", F.floor(F.col("c_duration_ms") / 1000)]
    first = named.groupBy(*alike).agg(F.min_by(F.struct(*[c for c in named.columns if c != "_artist"]), "c_track_id").alias("c")).select("_artist", "c.*")
    return rows.join(first, (F.col("title_norm") == F.col("c_title_norm")) & (F.col("artist_norm") == F.col("_artist"))).drop("_artist")


def common_title_counts(catalog: DataFrame, over: int = 500) -> DataFrame:
    """Titles of more than ``over`` catalog rows of popularity 0, counted. A report: no phase leaves them out."""
    return catalog.where("popularity = 0").groupBy("title_norm").count().where(F.col("count") > over)


def album_upgrades(matches: DataFrame, rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Matched groups without an album: their matched variant with album rows within 30 seconds of that variant."""
    albums = _renamed(catalog.where(F.lower("album_type") == "album"))
    wanted = matches.where(album_rank(F.col("c_album_type")) > 0).select(*GROUP, "id")
    millis = F.col("duration_sec") * 1000
    near = F.col("c_duration_ms").between(millis - 30_000, millis + 30_000)
    return rows.join(wanted, [*GROUP, "id"], "left_semi").join(albums, (F.col("title_norm") == F.col("c_title_norm")) & (F.col("artist_norm") == F.col("c_artist_norm")) & near)


def jaccard_pairs(rows: DataFrame, catalog: DataFrame, least: float = 0.5) -> DataFrame:
    """By title alone with artists half alike, for groups without an exact match; the score pays for unlike artists."""
    pairs = rows.join(_renamed(catalog), F.col("title_norm") == F.col("c_title_norm"))
    sim = F.array_max(F.transform("c_artists", lambda a: T.jaccard(F.col("artist_norm"), a)))
    return pairs.withColumn("_sim", sim).where(F.col("_sim") >= least).withColumn("_penalty", ((1 - F.col("_sim")) * 50).cast("int"))


def streamed_pairs(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """The match without an index: whole keys where the catalog has them, titles with artists half alike for the other groups."""
    exact = rows.join(_renamed(catalog), (F.col("title_norm") == F.col("c_title_norm")) & (F.col("artist_norm") == F.col("c_artist_norm")))
    keys = catalog.select(*GROUP).distinct()
    loose = jaccard_pairs(rows.join(keys, GROUP, "left_anti"), catalog)
    scored = scored_pairs(loose, "title", -F.col("_penalty"), F.col("_sim")).drop("_sim", "_penalty")
    return scored_pairs(exact, "exact").unionByName(scored)


def resolve(rows: DataFrame, catalog: DataFrame, retry_rejected: bool = False) -> DataFrame:
    """All phases: one accepted match a group with the phase that found it, albums preferred.

    The last phase passes over groups whose candidates were all rejected before, as it has always done, though they are counted
    as eligible; ``retry_rejected`` takes them too.

    ``rows`` are variants; pass written tables, as phases read them again. What a phase finds is written, so that later ones
    don't compute it again.
    """
    popular = catalog.where("popularity >= 1")
    exact = exact_pairs(rows, popular)
    seen = written(exact.select(*GROUP).distinct(), "seen")
    primary = primary_artist_pairs(rows, popular, seen)
    seen = written(seen.union(primary.select(*GROUP)).distinct(), "seen")
    main = written(best_match(scored_pairs(exact, "exact").unionByName(scored_pairs(primary, "primary"))), "main")

    open_ = rows.join(main, GROUP, "left_anti")
    rescued = rescue_pairs(open_.join(seen, GROUP, "left_anti"), popular)
    rescue = written(best_match(scored_pairs(rescued, "rescue", (F.col("_near") * 50).cast("int"))), "rescue")
    open_ = open_.join(rescue, GROUP, "left_anti")
    fuzzy = best_match(scored_pairs(fuzzy_pairs(open_, popular), "fuzzy", (F.col("_sim") * 30).cast("int")))
    found = written(main.unionByName(rescue).unionByName(fuzzy), "found")

    better = written(best_match(scored_pairs(album_upgrades(found, rows, popular), "upgrade")), "upgrades")
    found = found.join(better, GROUP, "left_anti").unionByName(better)
    rest = rows.join(found, GROUP, "left_anti")
    rest = rest if retry_rejected else rest.join(seen, GROUP, "left_anti")
    zero = best_match(scored_pairs(unpopular_pairs(distinct_variants(rest), catalog), "unpopular", similarity=F.lit(1.0)))
    return found.unionByName(zero)


def phase_statistics(rows: DataFrame, matches: DataFrame) -> DataFrame:
    """(phase, groups, percent) of all groups; those without a match are in phase ``none``."""
    groups = rows.select(*GROUP).distinct().join(matches.select(*GROUP, "phase"), GROUP, "left")
    counted = groups.groupBy(F.coalesce("phase", F.lit("none")).alias("phase")).agg(F.count("*").alias("groups"))
    return counted.withColumn("percent", F.col("groups") * 100 / F.sum("groups").over(Window.partitionBy(F.lit(1))))  # a row a phase


def last_phase_eligibility(rows: DataFrame, catalog: DataFrame, matches: DataFrame) -> DataFrame:
    """(eligible, no_candidates, rejected): groups that the last phase could still match, as no phase before it did; how many of them had no
    candidate among whole keys and primary artists, and how many had some that were all rejected. One row, of zeros without groups."""
    popular = catalog.where("popularity >= 1")
    exact = exact_pairs(rows, popular).select(*GROUP).distinct()
    seen = exact.union(primary_artist_pairs(rows, popular, exact).select(*GROUP)).distinct().withColumn("_seen", F.lit(True))
    earlier = matches.where("phase <> 'unpopular'")
    left = rows.select(*GROUP).distinct().join(earlier, GROUP, "left_anti").join(seen, GROUP, "left")
    return left.agg(F.count("*").alias("eligible"), F.count_if(F.col("_seen").isNull()).alias("no_candidates"), F.count_if("_seen").alias("rejected"))


def enriched(rows: DataFrame, matches: DataFrame, catalog: DataFrame) -> DataFrame:
    """The canonical variant of each group with what the catalog knows; popularity is null where nothing matched."""
    best = canonical(rows)
    match = matches.select(*GROUP, F.col("c_track_id").alias("track_id"), F.col("score").alias("match_score"), "phase")
    known = catalog.select("track_id", F.col("title").alias("catalog_title"), "popularity", "duration_ms", "album_type", "artists")
    return best.join(match, GROUP, "left").join(known, "track_id", "left").withColumn("display_title", F.coalesce("catalog_title", "title"))


def one_per_catalog_id(rows: DataFrame) -> DataFrame:
    """Of rows matched to one catalog id, that with the highest quality (then lowest id); unmatched rows pass."""
    order = Window.partitionBy("track_id").orderBy(F.desc("quality"), "id")
    matched = rows.where("track_id is not null").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return matched.unionByName(rows.where("track_id is null"))


def failures(rows: DataFrame, matches: DataFrame, pairs: DataFrame, least_quality: int = 30) -> DataFrame:
    """Why groups of good variants didn't match, with their five best candidates as JSON."""
    best = canonical(rows).where((F.col("quality") >= least_quality) & ~T.is_garbage_title(F.col("title")))
    lost = best.join(matches, GROUP, "left_anti")
    order = Window.partitionBy(*GROUP).orderBy(F.desc("score"), "c_track_id")
    top = pairs.withColumn("_n", F.row_number().over(order)).where("_n <= 5").groupBy(*GROUP)
    gap = F.abs(F.col("duration_sec") - F.floor(F.col("c_duration_ms") / 1000)).cast("long")
    why = F.when(F.col("score") < S.ACCEPTED, "score_below_threshold")
    named = {"id": "c_track_id", "name": "c_title", "artist": "c_artist_norm", "duration_ms": "c_duration_ms", "popularity": "c_popularity"}
    one = F.struct("_n", *[F.col(c).alias(n) for n, c in named.items()], gap.alias("duration_diff_sec"), "score", why.alias("reject_reason"))
    listed = F.transform(F.array_sort(F.collect_list(one)), lambda x: x.dropFields("_n"))
    told = top.agg(F.max("score").alias("best_score"), F.to_json(listed).alias("candidates"))
    reason = F.when(F.col("best_score").isNull(), "no_candidates").otherwise("all_rejected")
    return lost.join(told, GROUP, "left").withColumn("failure_reason", reason)


def popularity_rank(rows: DataFrame) -> DataFrame:
    """``search_id`` from 1 by popularity (nulls last), quality (nulls last) and id.

    Rows are dealt into ranges of that whole order, so neither unmatched rows nor equal qualities meet in one task. A row's rank is
    its place in its range plus the rows of the ranges before it; ranges are as many as partitions.
    """
    (at_,) = unused(rows, "at")
    order = [F.desc_nulls_last("popularity"), F.desc_nulls_last("quality"), F.asc("id")]
    dealt = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at_, F.monotonically_increasing_id()), "ranges")
    range_, place = F.shiftright(at_, 33), F.col(at_).bitwiseAND(F.lit((1 << 33) - 1))  # as the function defines them
    sizes = dealt.groupBy(range_.alias("_range")).count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_range", before.alias("_before"))
    return dealt.join(F.broadcast(starts), range_ == F.col("_range")).select(*rows.columns, (place + F.col("_before") + 1).alias("search_id"))
