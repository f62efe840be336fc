"""Small relational steps around ranked lists: first-wins distincts, priority unions, picks, enrichment by two keys."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from canticle.functions import fixed
from canticle.functions import text as T


def first_of(rows: DataFrame, key: list, order: list) -> DataFrame:
    """The first row of each key under a total order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def priority_union(sources: list[DataFrame], key: str, usable: Column) -> DataFrame:
    """Rows of several sources, the first source wins a key; a winner that isn't usable goes, and no later one replaces it."""
    ranked = [s.withColumn("_source", F.lit(k)) for k, s in enumerate(sources)]
    out = ranked[0]
    for s in ranked[1:]:
        out = out.unionByName(s)
    return first_of(out, [key], ["_source"]).where(usable).withColumnRenamed("_source", "source_rank")


def appended(local: DataFrame, remote: DataFrame, keys: list[str]) -> DataFrame:
    """Local rows, and remote rows that match none of them on any of the keys."""
    for k in keys:
        remote = remote.join(local.select(k).where(F.col(k).isNotNull()), k, "left_anti")
    return local.unionByName(remote.select(*local.columns))


def enriched_by_two_keys(rows: DataFrame, known: DataFrame, id_col: str, key_col: str, values: list[str]) -> DataFrame:
    """Values by id, else by the second key."""
    by_id = first_of(known, [id_col], [key_col]).select(F.col(id_col), *[F.col(v).alias(f"_i_{v}") for v in values])
    by_key = first_of(known, [key_col], [id_col]).select(F.col(key_col), *[F.col(v).alias(f"_k_{v}") for v in values])
    out = rows.join(by_id, id_col, "left").join(by_key, key_col, "left")
    return out.select(*rows.columns, *[F.coalesce(f"_i_{v}", f"_k_{v}").alias(v) for v in values])


def best_album(names: Column) -> Column:
    """The first name of the most preferred class."""
    order = F.array(*map(F.lit, fixed.ALBUM_ORDER))
    ranked = F.transform(names, lambda n, i: F.struct(F.array_position(order, T.album_class_by_words(n)).alias("r"), i.alias("i"), n.alias("n")))
    return F.coalesce(F.array_min(ranked)["n"], F.lit(""))


def image_for(images: DataFrame, key: str, wanted: int = 300) -> DataFrame:
    """An image a key: nearest to ``wanted`` within 50, else the smallest larger one."""
    tier = F.when(F.abs(F.col("width") - wanted) <= 50, 0).when(F.col("width") > wanted, 1)
    ranked = images.withColumn("_tier", tier).where("_tier is not null")
    return ranked.groupBy(key).agg(F.min_by("url", F.struct("_tier", F.abs(F.col("width") - wanted), "url")).alias("url"))


def image_by_size(images: Column, which: str) -> Column:
    """Large, medium (middle) or small of an array of (width, url)."""
    ranked = F.reverse(F.array_sort(images))
    at = {"large": F.lit(0), "medium": F.floor(F.size(images) / 2).cast("int"), "small": F.size(images) - 1}[which]
    return F.get(ranked, at)["url"]


def recent(rows: DataFrame, user: str, item: str, at: str, most: int = 20) -> DataFrame:
    """Each user's items by last use, without repeats, ``most`` at most (the length of the list is the feature)."""
    last = rows.groupBy(user, item).agg(F.max(at).alias(at))
    return last.withColumn("nth", F.row_number().over(Window.partitionBy(user).orderBy(F.desc(at), item))).where(F.col("nth") <= most)


def medians(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, upper_median, true_median): element n div 2 of the sorted values, and the mean of the middle ones.

    Counts of each value and their running sum; no group's values come together in one row.
    """
    counted = rows.groupBy(group, value).agg(F.count(value).alias("n"))
    every = Window.partitionBy(group)
    placed = counted.withColumn("_upto", F.sum("n").over(every.orderBy(value))).withColumn("_all", F.sum("n").over(every))
    at = lambda k: F.min(F.when(F.col("_upto") > F.floor(k), F.col(value)))
    found = placed.groupBy(group).agg(at(F.col("_all") / 2).alias("upper_median"), at((F.col("_all") - 1) / 2).alias("_lower"))
    return found.select(group, "upper_median", ((F.col("upper_median") + F.col("_lower")) / 2).alias("true_median"))


def text_direction(lines: Column, samples: int = 10) -> Column:
    """``rtl`` if over half of the first non-blank lines hold right-to-left letters."""
    seen = F.slice(F.filter(lines, lambda x: F.btrim(x) != ""), 1, samples)
    rtl = F.filter(seen, lambda x: x.rlike(fixed.RIGHT_TO_LEFT))
    return F.when(F.size(rtl) * 2 > F.size(seen), "rtl").otherwise("ltr")


def nested(parents: DataFrame, children: DataFrame, key: str, fields: list[str], order: str, name: str) -> DataFrame:
    """Parents with an ordered array of their children; empty where there are none."""
    grouped = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias(name))
    return parents.join(grouped, key, "left").withColumn(name, F.coalesce(name, F.array().cast(grouped.schema[name].dataType)))


def greedy_distinct(rows: DataFrame, group: str, order: list[str], keys: tuple[str, str], most: int = 10) -> DataFrame:
    """Rows of each ranked list whose first and second key are both new, ``most`` at most (the list's length is the feature).

    Of rows with the same two keys only the first can be taken. The rest is folded in order, batch by batch, and the fold
    holds the keys of the rows taken so far. A null key equals none.
    """
    cols = [*order, *[c for c in rows.columns if c != group and c not in order]]
    blank = F.col(keys[0]).isNull() & F.col(keys[1]).isNull()
    first = rows.where(~blank).groupBy(group, *[F.col(k).alias(f"_{n}") for n, k in enumerate(keys)]).agg(F.min(F.struct(*cols)).alias("_x")).select(group, "_x.*")
    listed = first.union(rows.where(blank).select(group, *cols))
    plain = lambda v: "NaN" if v != v else v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, n = object(), (set(), set()), 0
        for batch in batches:
            kept, places = [], []
            for k, (of, *pair) in enumerate(zip(*[batch.column(c).to_pylist() for c in (group, *keys)], strict=True)):
                if of != now:
                    now, seen, n = of, (set(), set()), 0
                pair = [plain(v) for v in pair]
                if n == most or any(v in s for v, s in zip(pair, seen, strict=True)):
                    continue
                for v, s in zip(pair, seen, strict=True):
                    if v is not None:
                        s.add(v)
                kept.append(k)
                places.append(n)
                n += 1
            out = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([out.column(0), pa.array(places, pa.int32()), *out.columns[1:]], names=[group, "position", *cols])

    fields = list(listed.schema.fields)
    schema = StructType([fields[0], StructField("position", IntegerType()), *fields[1:]])
    return listed.repartition(group).sortWithinPartitions(group, *cols).mapInArrow(run, schema)


def fanned_out(canon: DataFrame, found: DataFrame, direct: DataFrame, query: str, keys: list[str]) -> DataFrame:
    """Results found for canonical rows, the first of each key by position; queries without any get their direct results."""
    some = first_of(found.join(canon.select(query, "position"), [query, "position"], "left_semi"), [query, *keys], ["position"])
    return some.unionByName(direct.join(some.select(query).distinct(), query, "left_anti").select(*some.columns))


def search_kind(text: str) -> tuple[str, str]:
    """What a search text asks for: a numeric id, a service id, or words."""
    text = text.strip()
    if text.isdigit():
        return "id", text
    if text.startswith("spotify:track:"):
        return "service_id", text.removeprefix("spotify:track:")
    if "open.spotify.com/track/" in text:
        return "service_id", text.split("open.spotify.com/track/")[1].split("?")[0]
    return "words", text


def not_cached(wanted: DataFrame, cache: DataFrame, key: str, at: str, now: str, ttl: str) -> DataFrame:
    """Keys without a fresh cache row."""
    fresh = cache.where(F.col(at) > F.expr(f"timestamp'{now}' - interval '{ttl}'"))
    return wanted.join(fresh.select(key), key, "left_anti")


def missing_text(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.coalesce(F.btrim(F.col(column)), F.lit("")) == "")


def best_alternative(rows: DataFrame, exclude: Column, score: str, position: str) -> DataFrame:
    """The best other row with a score over 0, the first of equals."""
    return rows.where(~exclude & (F.col(score) > 0)).orderBy(F.desc(score), position).limit(1)
