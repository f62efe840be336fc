"""Sinks: guarded overwrite, key-sorted and bucketed tables, upserts and retention by partition, batches of a stream written once, nested JSON export and run statistics."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from canticle.operators.merge import upserted


def guard(path: str, must_contain: str, sources: list[str]) -> None:
    """Raise unless a path may be overwritten: its name holds a pattern and it is none of the sources."""
    name = os.path.basename(path.rstrip("/"))
    if must_contain not in name:
        raise ValueError(f"{name} doesn't contain {must_contain}")
    plain = lambda p: os.path.normpath(p.removeprefix("file://"))
    if plain(path) in map(plain, sources):
        raise ValueError(f"{path} is a source")


def overwrite(rows: DataFrame, path: str, must_contain: str, sources: list[str]) -> None:
    guard(path, must_contain, sources)
    rows.write.mode("overwrite").parquet(path)


def by_key(rows: DataFrame, path: str, key: list[str]) -> None:
    """One row a key, sorted by key inside files, so that readers skip row groups."""
    rows.dropDuplicates(key).repartition(*key).sortWithinPartitions(*key).write.mode("overwrite").parquet(path)


def indexed(rows: DataFrame, table: str, key: list[str], identity: list[str], buckets: int, path: str | None = None) -> DataFrame:
    """``rows`` as a catalog table in ``buckets`` by ``key``, sorted by it, one row for each ``key`` and ``identity``; a file a bucket.

    Joins and windows on the whole key read the buckets as they lie: only the other side is exchanged. A lookup of a key
    skips row groups by their least and greatest keys (and buckets, where the key is one column). ``path`` makes it an external table.
    """
    once = rows.dropDuplicates([*key, *identity]).repartition(buckets, *key)
    writer = once.write.mode("overwrite").format("parquet").bucketBy(buckets, *key).sortBy(*key)
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return rows.sparkSession.table(table)


def upserted_in_place(new: DataFrame, path: str, key: list[str], rules: dict[str, str], partition: str) -> list:
    """Merges ``new`` into the Parquet table at ``path`` (a folder for each value of ``partition``) by the rules of :func:`canticle.operators.merge.upserted`;
    returns the partitions that were written.

    Only the partitions of new rows are read and written; files of all others stay as they are. A key's partition must not change (it is part of the identity:
    a function of the key, or a day that never moves), and ``new`` has a row for each key, once. The merged rows are staged and take the place of the old ones after
    all tasks have succeeded, so a lost executor costs a retry. A run that died is repeated safely with rules that give the same again, all but ``add``.
    """
    spark = new.sparkSession
    values = sorted((r[0] for r in new.select(partition).distinct().collect()), key=lambda v: (v is not None, v))  # no more than the table has folders
    if not values:
        return []
    columns = [*rules, *key, partition]
    if not _exists(spark, path):
        new.select(columns).write.partitionBy(partition).parquet(path)
        return values
    old = _typed(spark, path, new.select(columns)).where(_among(partition, values))
    merged = upserted(old, new.select(columns), [*key, partition], rules)
    merged.select(columns).repartition(partition, *key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    return values


def kept_since(spark: SparkSession, path: str, at: str, day: str, cutoff: str) -> tuple[int, int]:
    """Retention on a Parquet table with a folder for each ``day`` (a date): rows with ``at`` before ``cutoff`` go, rows without a time stay.

    Folders of days before the cutoff's are dropped as they are, unless they hold rows without a time; its own day is written again, if it loses rows; later ones aren't
    touched. Returns the rows deleted and the folders dropped. A run that died is repeated.
    """
    rows = spark.read.parquet(path).where(F.col(day) <= F.to_date(F.lit(cutoff)))
    gone = F.coalesce(F.col(at) < F.lit(cutoff).cast("timestamp"), F.lit(False))
    counts = rows.groupBy(day).agg(F.count_if(gone).alias("gone"), F.count_if(~gone).alias("left")).where("gone > 0").collect()  # a row a day
    part = [r[day] for r in counts if r.left]
    if part:
        left = rows.where(_among(day, part) & ~gone)
        left.repartition(day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
    whole = [r[day] for r in counts if not r.left]
    for value in whole:
        at_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{day}={value}")
        at_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at_path, True)
    return sum(r.gone for r in counts), len(whole)


def _among(column: str, values: list):
    """Membership that prunes partitions; null is a value."""
    some = F.col(column).isin([v for v in values if v is not None])
    return some | F.col(column).isNull() if None in values else some


def _typed(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def written_once(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes each batch as the partition ``batch_id`` of ``path``. A batch that is run again after a failure
    overwrites what its first run left, so no row is written twice."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return run


def told_once(path: str, key: list[str], send: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that sends alerts whose ``key`` no earlier batch has sent. ``path`` is the ledger of keys, a partition for each batch.

    A batch's keys are in the ledger before they are sent, so a batch run again takes them from there: it sends the same alerts as its first run,
    which may have stopped halfway, and none of other batches. A receiver that knows ``batch_id`` can tell a repeat.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        names = batch.select(*key).distinct()
        if _exists(spark, path):
            told = spark.read.option("basePath", path).schema(StructType([*names.schema.fields, StructField("batch_id", IntegerType())])).parquet(path).where(F.col("batch_id") != batch_id)
            names = names.join(told, key, "left_anti")
        names.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        fresh = spark.read.schema(names.schema).parquet(f"{path}/batch_id={batch_id}")
        send(batch.join(fresh, key, "left_semi").withColumn("batch_id", F.lit(batch_id)))

    return run


def appended(rows: DataFrame, path: str, detail: str = "detail", most: int = 500) -> None:
    """Append log rows; the detail text is cut to its column's width."""
    rows.withColumn(detail, F.substring(detail, 1, most)).write.mode("append").parquet(path)


def as_json(rows: DataFrame, key: str) -> DataFrame:
    """(key, json): each row as a JSON document."""
    return rows.select(key, F.to_json(F.struct(*rows.columns)).alias("json"))


def statistics(row: DataFrame, path: str) -> dict:
    """A one-row table of counters as a JSON file."""
    found = row.first().asDict()
    with open(path, "w") as out:
        json.dump(found, out, default=str, indent=1, sort_keys=True)
    return found
