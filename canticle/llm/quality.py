"""Quality rules with host verdicts, all in DataFrame functions.

Documents are measured once, inside their row, with array functions. Rule failures are counted by host; a host's rate is
shrunk towards a beta prior. The prior is that of a beta-binomial model, fitted to all hosts by moments that weigh
a host by its documents and subtract what chance alone would spread: many one-document hosts, whose rates are 0 or 1, say
nothing of how hosts differ, and the prior never counts less than ``LEAST_STRENGTH`` documents (a uniform one's weight).
Hosts over ``host_limit`` are written as a table (Spark broadcasts it only under its threshold) and joined back to the
documents.

Defined results: a null text has no words and fails the base rule. A null ``source`` is a host of its own.
Null ids and repeated rows each keep their row. Empty tables give empty results. Extra columns pass through
:func:`keep_good` unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canticle.plans.cut import written
from canticle.plans.expr import let

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT, SYMBOL_PERCENT, DUP_LINE_PERCENT = 10, 20, 10, 30
HOST_LIMIT, LEAST_STRENGTH = 0.5, 2.0


def words_of(text: Column) -> Column:
    """The words of a text: runs of characters that aren't ASCII white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def shingle_hashes(words: Column, width: int, whole: bool = False) -> Column:
    """Hash of every ``width`` consecutive words; with ``whole``, fewer words make one shingle."""
    each = F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    short = F.when(F.size(words) > 0, F.array(F.xxhash64(words))) if whole else F.lit(None)
    return F.when(F.size(words) >= width, each).otherwise(F.coalesce(short, F.array().cast("array<bigint>")))


def _covered(hashes: Column, width: int) -> Column:
    """Words covered by windows whose hash comes twice: sort (hash, position), keep equal neighbours, sum the gaps."""
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    beside = lambda p, x, k: F.coalesce(F.get(p, k)["h"] == x["h"], F.lit(False))
    twice = let(pairs, lambda p: F.filter(p, lambda x, k: beside(p, x, k - 1) | beside(p, x, k + 1)))
    places = F.array_sort(F.transform(twice, lambda x: x["i"]))
    gaps = let(places, lambda p: F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - x, F.lit(width)))))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words inside windows of ``width`` words that the text has twice or more. Most texts end at a sort of longs."""
    any_twice = lambda s: F.exists(F.sequence(F.lit(1), F.size(s) - 1), lambda k: F.get(s, k) == F.get(s, k - 1))
    found = lambda h: F.when(let(F.sort_array(h), any_twice), _covered(h, width)).otherwise(F.lit(0).cast("long"))
    return F.when(F.size(words) > width, let(shingle_hashes(words, width), found)).otherwise(F.lit(0).cast("long"))


def measures(text: Column) -> Column:
    """The counts that the rules use, and whether the base rule fails, as a struct."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    line_counts = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))

    def counts(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))

    def told(x: Column) -> Column:
        w, of = x["w"], x["l"]
        return F.struct(
            w["n_words"].alias("n_words"),
            F.char_length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
            (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            of["dup"].cast("long").alias("n_dup_lines"),
            of["n"].cast("long").alias("n_lines"),
            w["n_repeat_words"].alias("n_repeat_words"),
            ((w["n_words"] < MIN_WORDS) | (100 * w["n_repeat_words"] > REPEAT_PERCENT * w["n_words"])).alias("base_failed"),
        )

    return let(F.struct(let(words_of(text), counts).alias("w"), line_counts.alias("l")), told)


def any_rule_failed(m: Column) -> Column:
    """A document counts against its host if the base rule, the symbol rule or the line rule fails."""
    return m["base_failed"] | (100 * m["n_symbols"] > SYMBOL_PERCENT * m["n_words"]) | (100 * m["n_dup_lines"] > DUP_LINE_PERCENT * m["n_lines"])


def host_of(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def rejected_hosts(stats: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """(host) of the hosts whose shrunk failure rate is over ``host_limit``. ``stats`` has host and m."""
    hosts = written(stats.groupBy("host").agg(F.count("*").alias("n"), F.count_if(any_rule_failed(F.col("m"))).alias("bad")), "hosts")
    n, bad = F.col("n"), F.col("bad")
    k, docs, failed, squares, spread = hosts.agg(F.count("*"), F.sum(n), F.sum(bad), F.sum(n.cast("double") * n), F.sum(bad.cast("double") * bad / n)).first()
    mean = failed / docs if docs else 0.0
    chance = mean * (1 - mean)
    free = docs - squares / docs - (k - 1) if docs else 0.0  # what hosts of several documents add
    alike = ((spread - failed * mean) / chance - (k - 1)) / free if chance and free > 0 else 0.0
    strength = max(LEAST_STRENGTH, 1 / alike - 1) if alike > 0 else None  # no more spread than by chance: no host is worse than others
    worse = (bad + mean * strength) / (n + strength) > host_limit if strength else F.lit(False)
    return written(hosts.where(worse).select("host"), "rejected-hosts")


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """(doc_id, the counts, base_failed, kept) for every row."""
    stats = written(docs.select(F.col(id_col).alias("doc_id"), host_of(F.col(host_col)).alias("host"), measures(F.col(text_col)).alias("m")), "quality")
    bad = rejected_hosts(stats, host_limit).withColumn("out", F.lit(True))
    kept = ~F.col("m.base_failed") & F.col("out").isNull()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return stats.join(bad, "host", "left").select("doc_id", *[F.col(f"m.{c}").alias(c) for c in names], kept.alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of ``docs`` that pass the base rule and whose host isn't rejected. Rows are measured and written once; the
    texts of those that fail the base rule aren't kept on the way."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    told = docs.select(row.alias("row"), host_of(F.col(host_col)).alias("host"), measures(F.col(text_col)).alias("m"))
    marked = written(told.select("host", "m", F.when(~F.col("m.base_failed"), F.col("row")).alias("row")), "quality")
    bad = rejected_hosts(marked.select("host", "m"), host_limit)
    return marked.where("not m.base_failed").join(bad, "host", "left_anti").select("row.*")


def op8_quality_rules(spark, sf_dir):
    """Contract query 8: counts and verdict of every document."""
    return verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w,
         [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l
  FROM documents),
o AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM d),
g AS (
  SELECT doc_id, i, x || ' ' || lead(x, 1) OVER o5 || ' ' || lead(x, 2) OVER o5 || ' ' || lead(x, 3) OVER o5 || ' ' || lead(x, 4) OVER o5 AS s
  FROM o WINDOW o5 AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, s FROM g WHERE s IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(range(0, 5)) AS k FROM g JOIN r USING (doc_id, s)) GROUP BY 1),
m AS (
  SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines,
         CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN p ON d.doc_id = p.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (
  SELECT source, count(*) AS n,
         count(*) FILTER (base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines) AS bad
  FROM b GROUP BY 1),
q AS (
  SELECT count(*) AS k, CAST(sum(n) AS DOUBLE) AS docs, CAST(sum(bad) AS DOUBLE) AS failed, sum(CAST(n AS DOUBLE) * n) AS squares,
         sum(CAST(bad AS DOUBLE) * bad / n) AS spread, failed / docs AS mean
  FROM h),
a AS (
  SELECT mean, CASE WHEN mean * (1 - mean) > 0 AND docs - squares / docs - (k - 1) > 0
    THEN ((spread - failed * mean) / (mean * (1 - mean)) - (k - 1)) / (docs - squares / docs - (k - 1)) ELSE 0 END AS alike
  FROM q),
v AS (
  SELECT source, CASE WHEN alike > 0 THEN (bad + mean * greatest(2, 1 / alike - 1)) / (n + greatest(2, 1 / alike - 1)) > 0.5 ELSE false END AS rejected
  FROM h, a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT rejected AS kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""
