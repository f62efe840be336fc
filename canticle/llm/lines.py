"""Line dedup across sites, all in DataFrame functions.

A line that many distinct sites carry is boilerplate. Per line hash a HyperLogLog sketch of its sites is built and
merged by aggregation. Estimates well over the threshold decide at once; lines near it get an exact distinct count.
Every copy of a boilerplate line goes except the first one (smallest id, then position), so no line vanishes
from the corpus and whole copied documents lose nothing in their first copy.

Only hashes and positions are shuffled until the removals, one array a row, meet the texts.

Defined results: a null text stays null. Blank lines are never judged. A null ``source`` is a site of its
own. Rows without ``doc_id`` come after all ids. Rows that repeat id and text are judged alike. Empty tables
give empty results. Extra columns pass unchanged, whatever their names; only ``_n_lines_removed`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canticle.plans.cut import scope, written
from canticle.plans.expr import let
from canticle.plans.names import restored, whole_row

MIN_SITES = 10
LG_K = 12
LINE = ["_h", "_g"]
LAST = (1 << 63) - 1


def keyed(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(_id, _row, _site, _text, _doc): the key of a row (id and hash of the text), what is judged, and all its columns."""
    text, site = F.col(text_col).cast("string"), F.col(site_col).cast("string")
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("_id"), F.xxhash64(text).alias("_row"), F.coalesce(F.concat(F.lit("="), site), F.lit("")).alias("_site"), text.alias("_text"), whole_row(docs).alias("_doc")
    )


def line_places(marked: DataFrame) -> DataFrame:
    """(_id, _row, _site, _pos, _h, _g): every line that isn't blank, by two hashes."""
    lines = marked.select("_id", "_row", "_site", F.posexplode(F.split("_text", "\n")).alias("_pos", "_line"))
    return lines.where(F.col("_line").rlike(r"[^\x20\x09-\x0D]")).select("_id", "_row", "_site", "_pos", F.xxhash64("_line").alias("_h"), F.xxhash64("_line", F.lit(1)).alias("_g"))


def boilerplate(places: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(_h, _g, _first): lines on at least ``min_sites`` sites and their first place."""
    spread = places.groupBy(*LINE).agg(F.hll_sketch_agg("_site", F.lit(lg_k)).alias("sketch"), F.min(F.struct("_id", "_row", "_pos")).alias("_first"))
    band = max(1.0, min_sites * 3 * 1.04 / (1 << lg_k) ** 0.5)  # three standard errors
    sized = spread.select(*LINE, "_first", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites - band)
    sized = written(sized, "line-spread")
    near = sized.where(F.col("sites") <= min_sites + band)
    exact = places.select(*LINE, "_site").join(near.select(*LINE), LINE, "left_semi").groupBy(*LINE).agg(F.count_distinct("_site").alias("exact"))
    sure = sized.where(F.col("sites") > min_sites + band).select(*LINE, "_first")
    return written(sure.union(near.join(exact.where(F.col("exact") >= min_sites), LINE).select(*LINE, "_first")), "boilerplate")


def without(text: Column, gone: Column) -> Column:
    """The lines of ``text`` but those at the sorted positions ``gone``: a merge by sorting, not a search per line."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), F.lit(1).alias("kind"), x.alias("x")))
    marks = F.transform(gone, lambda i: F.struct(i.alias("i"), F.lit(0).alias("kind"), F.lit("").alias("x")))
    marked = lambda all_, e, k: F.coalesce((F.get(all_, k - 1)["kind"] == 0) & (F.get(all_, k - 1)["i"] == e["i"]), F.lit(False))
    kept = let(F.array_sort(F.concat(lines, marks)), lambda a: F.filter(a, lambda e, k: (e["kind"] == 1) & ~marked(a, e, k)))
    return F.array_join(F.transform(kept, lambda e: e["x"]), "\n")


def without_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text, and ``_n_lines_removed``."""
    marked = keyed(docs, id_col, text_col, site_col)
    places = line_places(marked)
    with scope(docs.sparkSession):
        found = boilerplate(places, min_sites)
        hits = places.join(found, LINE).where(F.struct("_id", "_row", "_pos") != F.col("_first"))
        gone = written(hits.groupBy("_id", "_row").agg(F.collect_set("_pos").alias("_gone")), "gone-lines", keep=True)
    text = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(without(F.col("_text"), F.col("_gone")))
    out = marked.join(gone, ["_id", "_row"], "left")
    n = F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("_n_lines_removed")
    return out.select(*restored(docs.drop("_n_lines_removed"), "_doc", {text_col: text}), n)


def op4_line_dedup(spark, sf_dir):
    """Query 4: removed lines and what is left of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    found = without_boilerplate(docs)
    text = F.coalesce("text", F.lit(""))
    return found.select("doc_id", F.col("_n_lines_removed").alias("n_removed"), F.char_length(text).cast("long").alias("kept_chars"), F.sha2(text, 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, coalesce('=' || source, '') AS site, i, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM (SELECT doc_id, source, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)),
b AS (
  SELECT line, min(struct_pack(d := doc_id, i := i)) AS first FROM l
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1 HAVING count(DISTINCT site) >= 10),
k AS (SELECT l.*, b.line IS NOT NULL AND struct_pack(d := doc_id, i := l.i) <> b.first AS gone FROM l LEFT JOIN b ON l.line = b.line),
t AS (
  SELECT doc_id, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept
  FROM k GROUP BY 1)
SELECT doc_id, n_removed, CAST(length(kept) AS BIGINT) AS kept_chars, sha256(kept) AS kept_sha256 FROM t
"""
