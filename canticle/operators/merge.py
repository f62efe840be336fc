"""Upserts, soft deletes and syncs as pure transforms of old and new tables into the next one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, key: list[str], rules: dict[str, str]) -> DataFrame:
    """Full outer merge. Rules by column: ``keep`` (old unless null), ``keep_text`` (old unless null or empty), ``take`` (new
    unless null), ``take_text`` (new unless null or empty), ``take_set`` (new unless null, empty, 0 or false), ``with:<column>`` (new where
    that column's new value is set, so that a block of columns changes together), ``first`` (old where the row exists, even null), ``new``
    (new where there is one, even null), ``or``, ``greatest``, ``add``."""
    a, b = old.withColumn("_old", F.lit(True)).alias("a"), new.withColumn("_new", F.lit(True)).alias("b")
    kinds = dict(new.dtypes)
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    joined = a.join(b, _all(same), "full_outer")

    def merged(c: str, rule: str) -> Column:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        match rule:
            case "keep":
                return F.coalesce(x, y)
            case "keep_text":
                return F.coalesce(F.nullif(x, F.lit("")), y, x)
            case "take":
                return F.coalesce(y, x)
            case "take_text":
                return F.coalesce(F.nullif(y, F.lit("")), x, y)
            case "take_set":
                return F.when(_set(y, kinds[c]), y).otherwise(x)
            case "first":
                return F.when(F.col("a._old"), x).otherwise(y)
            case "new":
                return F.when(F.col("b._new"), y).otherwise(x)
            case "or":
                return F.coalesce(x, F.lit(False)) | F.coalesce(y, F.lit(False))
            case "greatest":
                return F.greatest(x, y)
            case "add":
                return F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))
        if rule.startswith("with:"):
            lead = rule.removeprefix("with:")
            return F.when(_set(F.col(f"b.{lead}"), kinds[lead]), y).otherwise(x)
        raise ValueError(rule)

    return joined.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in key], *[merged(c, r).alias(c) for c, r in rules.items()])


def _set(value: Column, kind: str) -> Column:
    """Whether a value is neither null nor empty, 0 or false."""
    if kind == "boolean":
        return F.coalesce(value, F.lit(False))
    return F.coalesce(value != ("" if kind == "string" else 0), F.lit(False)) if kind in ("string", "tinyint", "smallint", "int", "bigint", "float", "double") else value.isNotNull()


def _settings(text: Column) -> Column:
    """A JSON object as a map of variants: numbers, booleans and nested values keep their kind. What isn't an object is an empty map."""
    kind = "map<string,variant>"
    return F.coalesce(F.from_json(F.when(F.try_parse_json(text).isNotNull() & F.ltrim(text).startswith("{"), text), kind), F.create_map().cast(kind))


def _told(settings: Column, keep: Callable[[Column], Column]) -> Column:
    """The kept entries as JSON, in order of their keys."""
    names = F.array_sort(F.filter(F.map_keys(settings), keep))
    return F.to_json(F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(settings, k))))


def merged_settings(old: Column, new: Column) -> Column:
    """A JSON object of settings with those of another one written over it; what isn't an object counts as empty."""
    a, b = _settings(old), _settings(new)
    return _told(F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b), lambda k: F.lit(True))


def without_settings(old: Column, *names: str) -> Column:
    """A JSON object of settings without the named ones."""
    return _told(_settings(old), lambda k: ~k.isin(*names))


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def inserted_if_absent(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows, and new ones whose key is absent; the first of new rows with one key counts."""
    fresh = new.dropDuplicates(key).join(old.select(*key), key, "left_anti")
    return old.unionByName(fresh)


def synced_history(old: DataFrame, delta: DataFrame, batch: str | None = None, applied: DataFrame | None = None) -> DataFrame:
    """History per (user_id, song_id): latest play, summed plays. Deltas of batches in ``applied`` are left out, so a
    replay adds nothing."""
    if batch is not None and applied is not None:
        delta = delta.join(applied.select(batch), batch, "left_anti")
    added = delta.groupBy("user_id", "song_id").agg(F.max("last_played_at").alias("last_played_at"), F.sum("play_count").alias("play_count"))
    return upserted(old, added, ["user_id", "song_id"], {"last_played_at": "greatest", "play_count": "add"})


def elected(links: DataFrame, group: str, score: str, id_: str) -> DataFrame:
    """Each group without a primary link gets its best one (score, then lowest id)."""
    w = Window.partitionBy(group)
    order = w.orderBy(F.desc(score), id_)
    has = F.max(F.col("is_primary").cast("int")).over(w) == 1
    return links.withColumn("is_primary", F.col("is_primary") | (~has & (F.row_number().over(order) == 1)))


def promoted(links: DataFrame, removed: DataFrame, group: str, id_: str) -> DataFrame:
    """Links without the removed ones; where the primary went, the newest remaining one takes its place."""
    left = links.join(removed.select(id_), id_, "left_anti")
    order = Window.partitionBy(group).orderBy(F.desc("created_at"), id_)
    has = F.max(F.col("is_primary").cast("int")).over(Window.partitionBy(group)) == 1
    return left.withColumn("is_primary", F.col("is_primary") | (~has & (F.row_number().over(order) == 1)))


def made_primary(links: DataFrame, new: DataFrame, group: str, id_: str) -> DataFrame:
    """New links become primary and demote others of their group; an id already linked is not inserted."""
    demoted = links.join(new.select(group).distinct().withColumn("_d", F.lit(True)), group, "left").withColumn("is_primary", F.col("is_primary") & F.col("_d").isNull()).drop("_d")
    return demoted.unionByName(new.join(links.select(id_), id_, "left_anti").withColumn("is_primary", F.lit(True)).select(*links.columns))


def soft_deleted(rows: DataFrame, gone: DataFrame, key: list[str], flag: str = "deleted") -> DataFrame:
    marked = rows.join(gone.select(*key).distinct().withColumn("_gone", F.lit(True)), key, "left")
    return marked.withColumn(flag, F.coalesce(F.col("_gone"), F.col(flag))).drop("_gone").select(*rows.columns)


def cascaded(parents: DataFrame, children: DataFrame, key: str, doomed: Column) -> tuple[DataFrame, DataFrame]:
    """Parents without those under a predicate, and only children of what is left."""
    left = parents.where(~F.coalesce(doomed, F.lit(False)))
    return left, children.join(left.select(key), key, "left_semi")


def next_order(items: DataFrame, group: str, order: str = "sort_order") -> DataFrame:
    return items.groupBy(group).agg((F.coalesce(F.max(order), F.lit(-1)) + 1).alias("next_order"))


def reordered(groups: DataFrame, ids: str, key: str) -> DataFrame:
    """(key, id, sort_order) from an array of ids in their new order."""
    return groups.select(key, F.posexplode(ids).alias("sort_order", "id"))


def assert_unique(rows: DataFrame, key: list[str]) -> None:
    """Raise if a key occurs twice."""
    twice = rows.groupBy(*key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"not unique: {key} {twice[0]}")
