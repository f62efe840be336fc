"""One-permutation MinHash fingerprints, all in DataFrame functions.

Every shingle is hashed once. The high bits of the hash name one of 128 bins, and each bin keeps its least hash.
Sorting the hashes together with one sentinel a bin leaves the bins' minima at the changes of bin, in order. An
empty bin takes the value of the filled bin that comes first in the empty bin's own pseudo-random order (optimal
densification: the choice depends on the two bins alone, so texts agree on it). A bin stores its low 8 bits.
Agreement of two fingerprints is corrected for values that agree by chance, one in 256.

Defined results: a text without words (null, empty, white space) has the empty fingerprint, whose likeness is 1 to
another empty one and 0 to any other. Fewer words than a shingle make one shingle. In :func:`with_next`, rows without id
come after all others, ties are ordered by text, and a single row is its own successor; extra columns pass unchanged, whatever
their names. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canticle.llm.quality import shingle_hashes, words_of
from canticle.plans.cut import written
from canticle.plans.expr import let
from canticle.plans.names import restored, whole_row

BIN_BITS, LOW_BITS, WIDTH = 7, 8, 5
BINS = 1 << BIN_BITS
SHIFT = 64 - BIN_BITS
LAST = (1 << 63) - 1
#: Rows of one bucket of :func:`with_next`; ids are cut in up to ``CUTS`` ranges, each of them in up to ``CUTS`` buckets.
BUCKET_ROWS, CUTS, STRETCH = 512, 1024, 32


def minima(hashes: Column) -> Column:
    """Least hash of each bin, in bin order; an empty bin shows its sentinel, the bin's greatest hash."""
    sentinels = F.array(*[F.lit(((k + 1) << SHIFT) - 1) for k in range(-(BINS >> 1), BINS >> 1)])
    bin_of = lambda h: F.shiftright(h, SHIFT)
    first = lambda s: F.filter(s, lambda h, i: F.coalesce(bin_of(h) != bin_of(F.get(s, i - 1)), F.lit(True)))
    return let(F.sort_array(F.concat(hashes, sentinels)), first)


def densified(mins: Column) -> Column:
    """The low bits of every bin, empty bins filled from others."""
    low = (1 << LOW_BITS) - 1
    empty = lambda h: h.bitwiseAND(F.lit((1 << SHIFT) - 1)) == F.lit((1 << SHIFT) - 1)

    def fill(m: Column, filled: Column) -> Column:
        order = lambda h, j: F.xxhash64(j, F.shiftright(h, SHIFT)).bitwiseAND(F.lit(~low)).bitwiseOR(h.bitwiseAND(F.lit(low)))
        value = lambda h, j: F.when(empty(h), F.array_min(F.transform(filled, lambda f: order(f, j)))).otherwise(h)
        return F.transform(m, lambda h, j: value(h, j).bitwiseAND(F.lit(low)).cast("short"))

    return let(mins, lambda m: let(F.filter(m, lambda h: ~empty(h)), lambda f: F.when(F.size(f) > 0, fill(m, f)).otherwise(F.array().cast("array<smallint>"))))


def fingerprint(text: Column, width: int = WIDTH) -> Column:
    """Array of the 128 bin values of a text; empty for a text without words."""
    return let(words_of(text), lambda w: densified(minima(shingle_hashes(w, width, whole=True))))


def hex_of(print_: Column) -> Column:
    return F.array_join(F.transform(print_, lambda v: F.lpad(F.lower(F.hex(v)), LOW_BITS // 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bins, corrected for chance, from 0 to 1."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    chance = 1.0 / (1 << LOW_BITS)
    found = F.greatest(F.lit(0.0), (equal / F.lit(float(BINS)) - chance) / (1 - chance))
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(empty, F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0)).otherwise(found)


def cuts_of(id_: Column, buckets: int) -> Column:
    """An aggregate: ids that cut a group of rows into ``buckets`` buckets of like size, in stretches of ``STRETCH``."""
    if buckets < 2:
        return F.array().cast("array<array<bigint>>")
    shares = F.array(*[F.lit(k / buckets) for k in range(1, buckets)])
    cuts = F.array_sort(F.array_distinct(F.percentile_approx(id_, shares, F.lit(10 * buckets))))
    return let(cuts, lambda c: F.transform(F.sequence(F.lit(0), F.floor((F.size(c) - 1) / STRETCH).cast("int")), lambda k: F.slice(c, k * STRETCH + 1, F.lit(STRETCH))))


def bucket_of(id_: Column, cuts: Column) -> Column:
    """How many cut points are at most ``id_``: first among the stretches' beginnings, then inside one stretch."""
    begun = F.size(F.filter(cuts, lambda s: s[0] <= id_))
    return let(begun, lambda k: F.when(k == 0, 0).otherwise((k - 1) * STRETCH + F.size(F.filter(F.get(cuts, k - 1), lambda c: c <= id_))))


def with_next(rows: DataFrame, id_col: str, text_col: str, carry: list[str], bucket_rows: int = BUCKET_ROWS, cuts: int = CUTS) -> DataFrame:
    """``rows`` with ``next_<c>`` for each column of ``carry``: its value in the next row by ascending id, the last
    row's next being the first.

    Rows are dealt into id ranges (a table of at most ``cuts`` rows) and these into buckets of about ``bucket_rows`` rows, so buckets
    grow with the table up to ``cuts`` squared; the first row of each is also sent to the bucket before it, so no window spans the
    table.
    """
    spark = rows.sparkSession
    marked = rows.select(whole_row(rows).alias("_row"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("_id"), F.xxhash64(text_col).alias("_h"))
    ids = marked.select("_id")
    buckets = -(-ids.count() // bucket_rows)
    wide = max(1, min(cuts, -(-buckets // cuts)))
    coarse = ids.agg(cuts_of(F.col("_id"), wide).alias("c")).first()["c"]  # cuts numbers at most
    literal = F.array(*[F.array(*[F.lit(x).cast("long") for x in some]) for some in coarse])
    range_ = bucket_of(F.col("_id"), literal) if coarse else F.lit(0)
    ranged = marked.withColumn("_range", range_.cast("int"))
    fine = written(ranged.groupBy("_range").agg(cuts_of(F.col("_id"), max(1, min(cuts, -(-buckets // wide)))).alias("_cuts")), "cuts")
    inner = F.when(F.size("_cuts") > 0, bucket_of(F.col("_id"), F.col("_cuts"))).otherwise(0)
    dealt = ranged.join(F.broadcast(fine), "_range").withColumn("_bucket", (F.col("_range") * cuts + inner).cast("int")).drop("_range", "_cuts")
    firsts = sorted(dealt.groupBy("_bucket").agg(F.min(F.struct("_id", "_h")).alias("f")).collect())  # a row a bucket
    known = [(b, f["_id"], f["_h"], firsts[k - 1]["_bucket"]) for k, (b, f) in enumerate(firsts)]
    starts = F.broadcast(spark.createDataFrame(known, "_bucket int, _id long, _h long, _before int"))
    twice = F.array(F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("copy")), F.struct(F.col("_before").alias("b"), F.lit(1).alias("copy")))
    sent = dealt.join(starts, ["_bucket", "_id", "_h"], "left").withColumn("_to", F.explode(F.filter(twice, lambda x: x["b"].isNotNull())))
    order = Window.partitionBy("_to.b").orderBy("_to.copy", "_id", "_h")
    after = [F.lead(F.col(f"_row.`{c}`")).over(order).alias(f"next_{c}") for c in carry]
    out = sent.select("_row", "_to", *after).where("_to.copy = 0")
    return out.select(*restored(rows.drop(*[f"next_{c}" for c in carry]), "_row"), *[f"next_{c}" for c in carry])


def edited_text(text: Column, after: Column) -> Column:
    """``text`` whose last half (rounded down) is replaced by as much of the beginning of ``after``."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(after, F.lit(1), half))


def op3_document_fingerprints(spark, sf_dir):
    """Contract query 3: fingerprints of every document and of its edited text, and their likeness."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    printed = docs.withColumn("print", fingerprint(F.col("text")))
    paired = with_next(printed, "doc_id", "text", ["text", "print"])
    edited = paired.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "print", "next_print", edited_text(F.col("text"), F.col("next_text")).alias("edited"))
    both = edited.withColumn("edited_print", fingerprint(F.col("edited")))
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        hex_of(F.col("print")).alias("fingerprint"),
        hex_of(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
