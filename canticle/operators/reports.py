"""Reports over an attempt log and a catalog. ``now`` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canticle.functions.scoring import success_rate

# The reasons of the error table's columns.
REASONS = ("not_found", "rate_limit", "timeout", "api_error", "unknown")


def since(log: DataFrame, now: str, interval: str, at: str = "created_at") -> DataFrame:
    """Rows strictly later than ``now`` minus an interval such as ``24 hours``."""
    return log.where(F.col(at) > F.expr(f"timestamp'{now}' - interval '{interval}'"))


def summary(log: DataFrame) -> DataFrame:
    """Attempts, successes, success rate and mean latency of all rows."""
    counted = log.agg(F.count("*").alias("attempts"), F.count_if("success").alias("successes"), F.round(F.avg("latency")).cast("long").alias("avg_latency"))
    return counted.withColumn("success_rate", success_rate(F.col("successes"), F.col("attempts")))


def by_provider(log: DataFrame) -> DataFrame:
    counted = log.groupBy("provider").agg(F.count("*").alias("attempts"), F.count_if("success").alias("successes"), F.round(F.avg("latency")).cast("long").alias("avg_latency"))
    return counted.withColumn("success_rate", success_rate(F.col("successes"), F.col("attempts"))).orderBy(F.desc("attempts"), "provider")


def daily(log: DataFrame, at: str = "created_at") -> DataFrame:
    return log.groupBy(F.to_date(at).alias("day"), "provider").agg(F.count("*").alias("attempts"), F.count_if("success").alias("successes"))


def errors(log: DataFrame) -> DataFrame:
    """Failures by provider and reason; a null reason is named only after grouping."""
    counted = log.where(~F.col("success")).groupBy("provider", "reason").agg(F.count("*").alias("failures"))
    return counted.withColumn("reason", F.coalesce("reason", F.lit("unknown")))


def provider_pivot(series: DataFrame, providers: list[str], value: str = "attempts") -> DataFrame:
    """A day a row, a provider a column, 0 where missing."""
    return series.groupBy("day").pivot("provider", sorted(providers)).agg(F.first(value)).na.fill(0)


def error_pivot(failed: DataFrame) -> DataFrame:
    """A provider a row, the fixed reasons as columns and their total."""
    cells = [F.coalesce(F.sum(F.when(F.col("reason") == r, F.col("failures"))), F.lit(0)).alias(r) for r in REASONS]
    total = sum((F.col(r) for r in REASONS[1:]), F.col(REASONS[0]))
    return failed.groupBy("provider").agg(*cells).withColumn("total", total).orderBy(F.desc("total"), "provider")


def never_succeeded(log: DataFrame, key: str) -> DataFrame:
    """Failures per key of keys without any success, ordered by count."""
    good = log.where("success").select(key).distinct()
    counted = log.where(~F.col("success")).join(good, key, "left_anti").groupBy(key).agg(F.count("*").alias("failures"), F.max("created_at").alias("last_at"))
    return counted.orderBy(F.desc("failures"), key)


def most_failed(log: DataFrame, key: str, limit: int) -> DataFrame:
    return log.where(~F.col("success")).groupBy(key).agg(F.count("*").alias("failures")).orderBy(F.desc("failures"), key).limit(limit)


def retained(log: DataFrame, now: str, days: int = 90, at: str = "created_at") -> DataFrame:
    """Rows that a retention run keeps; those it deletes are ``created_at < now - days``."""
    return log.where(~(F.col(at) < F.expr(f"timestamp'{now}' - interval '{days}' day")) | F.col(at).isNull())


def histogram(value: Column, edges: list[float], labels: list[str]) -> Column:
    out = F.lit(labels[-1])
    for edge, label in reversed(list(zip(edges, labels, strict=False))):
        out = F.when(value < edge, label).otherwise(out)
    return out


def catalog_metrics(songs: DataFrame, plays: DataFrame, key: str, user: str, at: str) -> DataFrame:
    """Distinct users and last play of every song: aggregated first, then joined."""
    used = plays.groupBy(key).agg(F.count_distinct(user).alias("users"), F.max(at).alias("last_at"))
    return songs.join(used, key, "left").na.fill(0, ["users"])


def monthly_usage(events: DataFrame, amount: str, thresholds: list[int], at: str = "ts") -> DataFrame:
    """(month, used, threshold, reached_at): thresholds that a month's running sum reached, each once, at its first event.

    Amounts aren't negative. Sums run over the minutes of a month, and then over the events of the minutes in which a threshold
    was reached, so that no task sorts the events of a month.
    """
    marked = events.select(F.date_format(at, "yyyy-MM").alias("month"), F.date_trunc("minute", at).alias("_minute"), F.col(at).alias("_at"), "event_id", F.col(amount).alias("_amount"))
    minutes = marked.groupBy("month", "_minute").agg(F.sum("_amount").alias("_sum"))
    upto = F.sum("_sum").over(Window.partitionBy("month").orderBy("_minute"))
    limits = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    hit = minutes.withColumn("_upto", upto).select("*", limits).where("_upto >= threshold").groupBy("month", "threshold").agg(F.min(F.struct("_minute", (F.col("_upto") - F.col("_sum")).alias("before"))).alias("m"))
    rows = marked.join(hit.select("month", "threshold", "m.*"), ["month", "_minute"])
    running = F.col("before") + F.sum("_amount").over(Window.partitionBy("month", "threshold").orderBy("_at", "event_id"))
    return rows.withColumn("used", running).where("used >= threshold").groupBy("month", "threshold").agg(F.min("used").alias("used"), F.min("_at").alias("reached_at"))


def cascade(results: DataFrame, key: str) -> DataFrame:
    """First answer of providers tried in order: only not-found falls through to the next one; any other error ends it."""
    ends = results.where(F.col("success") | (F.coalesce("reason", F.lit("")) != "not_found"))
    first = ends.groupBy(key).agg(F.min_by(F.struct("provider", "success", "reason"), "priority").alias("r"))
    return first.select(key, "r.*")
