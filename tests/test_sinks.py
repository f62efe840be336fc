"""Bucketed tables that joins read as they lie, and batches of a stream that are written and told once."""

import os

from pyspark.sql import functions as F

from canticle.operators import merge, reports, resolve
from canticle.sources import sinks


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_bucketed_catalog_is_not_exchanged(spark):
    catalog = spark.range(400).select(
        F.col("id").alias("track_id"), F.concat(F.lit("title "), F.col("id") % 50).alias("title_norm"), F.concat(F.lit("artist "), F.col("id") % 7).alias("artist_norm"),
        F.array(F.concat(F.lit("artist "), F.col("id") % 7)).alias("artists"), (F.col("id") * 1000).alias("duration_ms"), (F.col("id") % 90).cast("int").alias("popularity"), F.lit("album").alias("album_type"),
    )
    rows = catalog.select("title_norm", "artist_norm", F.col("track_id").alias("id")).where("id % 3 = 0")
    index = sinks.indexed(catalog.union(catalog), "catalog_index", ["title_norm", "artist_norm"], ["track_id"], 8)
    try:
        assert index.count() == 400
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        pairs = resolve.exact_pairs(rows, index)
        plan = plan_of(pairs)
        assert plan.count("Exchange hashpartitioning") == 1  # the lyric side
        assert plan.index("Exchange") < plan.index("catalog_index") or "Exchange" not in plan[plan.index("catalog_index") :]
        key = lambda df: sorted((r.id, r.c_track_id) for r in df.collect())
        assert key(pairs) == key(resolve.exact_pairs(rows, catalog))
        one = index.where("title_norm = 'title 3' and artist_norm = 'artist 3'")
        assert "PushedFilters: [IsNotNull(title_norm), IsNotNull(artist_norm), EqualTo(title_norm,title 3)" in one._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")) and one.count() == catalog.where("title_norm = 'title 3' and artist_norm = 'artist 3'").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.sql("DROP TABLE catalog_index")


def fed(spark, path, parts):
    for n, part in enumerate(parts):
        spark.createDataFrame(part, "k string, v int").coalesce(1).write.parquet(f"{path}/in/{n:02d}.parquet")
    return spark.readStream.schema("k string, v int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/in")


def run(stream, path, each):
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/at").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None


def test_a_restarted_stream_writes_nothing_twice(spark, tmp_path):
    stream = fed(spark, tmp_path, [[("a", 1), ("b", 2)], [("c", 3)], [("d", 4)]])
    each = sinks.written_once(f"{tmp_path}/out")
    run(stream, tmp_path, each)
    last = max(int(x) for x in os.listdir(f"{tmp_path}/at/commits") if x.isdigit())
    for name in (f"{last}", f".{last}.crc"):  # as if it had stopped before the commit
        os.remove(f"{tmp_path}/at/commits/{name}")
    run(stream, tmp_path, each)
    assert sorted((r.k, r.v) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("a", 1), ("b", 2), ("c", 3), ("d", 4)]


def test_alerts_are_told_once(spark, tmp_path):
    sent = []
    each = sinks.told_once(f"{tmp_path}/ledger", ["k"], lambda df: sent.append(sorted((r.batch_id, r.k) for r in df.collect())))
    batches = [[("a", 80)], [("a", 90), ("b", 80)], [], [("c", None), ("b", 95)]]
    for n, part in enumerate(batches):
        df = spark.createDataFrame(part, "k string, v int")
        each(df, n)
        if n == 1:
            each(df, n)  # run again
    assert sent == [[(0, "a")], [(1, "b")], [(1, "b")], [], [(3, "c")]]


def files_of(path):
    return {(d.removeprefix(str(path)), f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_an_upsert_writes_only_its_partitions(spark, tmp_path):
    schema = "id int, album string, plays int, part int"
    rules = {"album": "keep_text", "plays": "greatest"}
    make = lambda rows: spark.createDataFrame([(i, a, n, i % 4) for i, a, n in rows], schema)
    first = make([(i, "" if i % 3 else f"a{i}", i) for i in range(40)])
    path = f"{tmp_path}/songs"
    assert sinks.upserted_in_place(first, path, ["id"], rules, "part") == [0, 1, 2, 3]
    before = files_of(path)
    new = make([(i, "new", 20) for i in (1, 5, 41, 6)])
    assert sinks.upserted_in_place(new, path, ["id"], rules, "part") == [1, 2]
    after = files_of(path)
    untouched = {x for x in before if x[0] in ("/part=0", "/part=3")}
    assert untouched and {x for x in after if x[0] in ("/part=0", "/part=3")} == untouched
    assert not {x for x in before & after if x[0] in ("/part=1", "/part=2")}
    want = sorted(map(tuple, merge.upserted(first, new, ["id", "part"], rules).select("id", "album", "plays", "part").collect()))
    rows = lambda: sorted(map(tuple, spark.read.parquet(path).select("id", "album", "plays", "part").collect()))
    assert rows() == want and (41, "new", 20, 1) in want
    assert sinks.upserted_in_place(make([]), path, ["id"], rules, "part") == [] and files_of(path) == after
    sinks.upserted_in_place(new, path, ["id"], rules, "part")  # run again
    assert rows() == want
    nowhere = spark.createDataFrame([(90, "x", 1, None)], schema)
    assert sinks.upserted_in_place(nowhere, path, ["id"], rules, "part") == [None]
    assert sinks.upserted_in_place(spark.createDataFrame([(90, "y", 7, None)], schema), path, ["id"], rules, "part") == [None]
    assert [r for r in map(tuple, spark.read.parquet(path).select("id", "album", "plays", "part").collect()) if r[0] == 90] == [(90, "x", 7, None)]


def test_retention_drops_folders_and_writes_one(spark, tmp_path):
    path = f"{tmp_path}/log"
    at = F.timestamp_seconds(F.col("id") * 3600 * 6)
    log = spark.range(40).select("id", at.alias("created_at"), F.to_date(at).alias("day"))
    unknown = spark.createDataFrame([(99,)], "id long").select("id", F.lit(None).cast("timestamp").alias("created_at"), F.lit("1970-01-02").cast("date").alias("day"))
    log.union(unknown).write.partitionBy("day").parquet(path)
    before = files_of(path)
    cutoff = "1970-01-05 12:00:00"
    want = sorted(r.id for r in reports.retained(log.union(unknown), cutoff, 0).collect())
    assert sinks.kept_since(spark, path, "created_at", "day", cutoff) == (18, 3)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == want
    days = {d for d, _ in files_of(path)}
    assert "/day=1970-01-01" not in days and "/day=1970-01-02" in days
    assert {x for x in before if x[0] > "/day=1970-01-05"} == {x for x in files_of(path) if x[0] > "/day=1970-01-05"}
    assert sinks.kept_since(spark, path, "created_at", "day", cutoff) == (0, 0)
