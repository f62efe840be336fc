"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

Features are counted by DataFrame functions in one pass over the words of a text: densities of lexicon words and
stems, of those next to second-person words, of obfuscated words that spell a lexicon word, of capitals and of
exclamation marks. The lexicon is a short fixed list plus words and stems whose log-odds among labelled training
texts stand out. Trees (Spark ML) are fitted on four fifths of the training rows, an isotonic map from margin
to probability on the rest.

``TRAIN_LIMIT`` bounds the labelled rows that are used: those with the least hash of their id. Ids, languages and sources
are never features. Scoring reads whole texts of all rows.

Defined results: a null or empty text has zero features and gets a score like any other. Labels whose ``toxic``
or ``doc_id`` is null are left out; a document labelled twice counts as toxic if one label says so. If the training rows
don't hold both classes, the score is 0.9 for a text with a fixed lexicon word and 0.1 for others. Repeated rows each get
their row; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canticle.plans.cut import written
from canticle.plans.expr import let

#: Labelled rows used for fitting, at most.
TRAIN_LIMIT = 20_000
#: Mined words and stems, at most; and the least standardised log-odds of one.
MINED, LEAST_Z = 300, 3.5
STEM_LENGTHS = (4, 5, 6)
# Common insults, and second-person words of four languages.
INSULTS = ("clown", "disgusting", "dumb", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "ugly", "worthless")
SECOND_PERSON = ("you", "your", "yours", "yourself", "du", "dich", "dir", "dein", "deine", "tu", "te", "toi", "vous", "votre", "usted", "ti", "tú")
#: Stand-ins in obfuscated words, and what they stand for.
OBFUSCATION = ("@4310$5!7|+", "aaeiossitit")
NEAR = 3
FEATURES = ["lexicon", "stems", "lexicon_kinds", "near_second_person", "second_person", "obfuscated", "capitals", "exclamations", "punctuation", "short"]


def tokens(text: Column) -> Column:
    """Lower-case words: runs of letters, digits and the stand-ins of obfuscation."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}@$!|+]+"), lambda w: w != "")


def bare(word: Column) -> Column:
    """A word without the marks at its end that are also stand-ins."""
    return F.regexp_replace(word, r"[!|+]+$", "")


def plain(word: Column) -> Column:
    """An obfuscated word with its stand-ins read as letters."""
    return F.translate(word, *OBFUSCATION)


def features(text: Column, lexicon: list[str], stems: list[str]) -> Column:
    """Array of the values of ``FEATURES``."""
    known = [*lexicon, *INSULTS]
    by_length = {n: [s for s in stems if len(s) == n] for n in STEM_LENGTHS}

    def in_stems(w: Column) -> Column:
        found = F.lit(False)
        for n, some in by_length.items():
            if some:
                found = found | F.substring(w, 1, n).isin(some)
        return found

    def of_words(w: Column) -> Column:
        bad = F.transform(w, lambda x: x.isin(known) | in_stems(x))
        you = F.transform(w, lambda x: x.isin(list(SECOND_PERSON)))
        count = lambda flags: F.size(F.filter(flags, lambda x: x)).cast("double")

        def with_flags(b: Column, y: Column) -> Column:
            near = F.filter(b, lambda x, i: x & F.exists(F.slice(y, F.greatest(i - NEAR, F.lit(0)) + 1, 2 * NEAR + 1), lambda z: z))
            disguised = F.filter(w, lambda x: x.rlike("[@4310$5!7|+]") & x.rlike(r"\p{L}") & (plain(x).isin(known) | in_stems(plain(x))) & ~x.isin(known))
            n = F.greatest(F.size(w), F.lit(1)).cast("double")
            kinds = F.size(F.array_distinct(F.filter(w, lambda x: x.isin(known) | in_stems(x)))).cast("double")
            return F.array(
                F.size(F.filter(w, lambda x: x.isin(known))) * 100 / n,
                count(b) * 100 / n,
                kinds,
                F.size(near) * 100 / n,
                count(y) * 100 / n,
                F.size(disguised) * 100 / n,
                share(text, r"\p{Lu}"),
                share(text, "!"),
                share(text, r"\p{P}"),
                F.when(F.size(w) < 20, 1.0).otherwise(0.0),
            )

        return let(bad, lambda b: let(you, lambda y: with_flags(b, y)))

    return let(F.transform(tokens(text), bare), of_words)


def share(text: Column, pattern: str) -> Column:
    """Share of the characters of a text that match a pattern, in hundredths."""
    return F.regexp_count(text, F.lit(pattern)) * 100 / F.greatest(F.char_length(text), F.lit(1)).cast("double")


def _terms(length: int) -> Column:
    """Distinct ``length:term`` of the words ``w``: their first ``length`` letters, or at 0 the words themselves.

    Terms are strings, of which Spark finds the distinct ones by hashing (structs would be compared pair by pair).
    """
    long_enough = F.filter("w", lambda x: F.char_length(x) >= length)
    return F.array_distinct(F.transform(long_enough, lambda x: F.concat(F.lit(f"{length}:"), F.substring(x, 1, length) if length else x)))


def mined(train: DataFrame) -> tuple[list[str], list[str]]:
    """Words and stems whose share among toxic training texts stands out; each term counts once a text."""
    words = train.select("_toxic", F.array_distinct(F.transform(tokens(F.col("_text")), bare)).alias("w"))
    terms = words.select("_toxic", F.explode(F.concat(_terms(0), *map(_terms, STEM_LENGTHS))).alias("term"))
    sizes = {r["_toxic"]: r["count"] for r in train.groupBy("_toxic").count().collect()}
    a, b = F.count_if(F.col("_toxic") == 1) + 0.5, F.count_if(F.col("_toxic") == 0) + 0.5
    odds = F.log(a / (sizes.get(1, 0) + 1) / (b / (sizes.get(0, 0) + 1)))
    scored = terms.groupBy("term").agg((odds / F.sqrt(1 / a + 1 / b)).alias("z"), odds.alias("odds"))
    best = scored.where((F.col("z") >= LEAST_Z) & (F.col("odds") > 1.5)).orderBy(F.desc("z"), "term").limit(MINED).collect()
    terms = [r["term"].split(":", 1) for r in best]
    return [t for n, t in terms if n == "0"], [t for n, t in terms if n != "0"]


def labelled(docs: DataFrame, labels: DataFrame, train_limit: int) -> DataFrame:
    """(_toxic, _text, _fold) of the training rows: labels outside the held-out fifth, bounded by least hash."""
    rest = labels.select(F.col("doc_id").cast("long").alias("_label_id"), F.col("toxic").cast("int").alias("_toxic")).where(~held_out(F.col("_label_id")))
    rest = rest.dropna().groupBy("_label_id").agg(F.max("_toxic").alias("_toxic"))
    chosen = rest.orderBy(F.xxhash64("_label_id", F.lit(1)), "_label_id").limit(train_limit)  # a bounded table
    texts = docs.join(F.broadcast(chosen), docs["_id"] == F.col("_label_id"))
    return texts.select("_toxic", "_text", F.pmod(F.xxhash64("_label_id", F.lit(2)), F.lit(5)).alias("_fold"))


def held_out(id_: Column) -> Column:
    return F.crc32(id_.cast("string")) % 5 == 0


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_limit: int = TRAIN_LIMIT) -> DataFrame:
    """(doc_id, score): probability that a text is toxic."""
    slim = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    train = written(labelled(slim, labels, train_limit), "labelled")
    lexicon, stems = mined(train)
    assembler = VectorAssembler(inputCols=[f"_f{k}" for k in range(len(FEATURES))], outputCol="_features")

    def measured(rows: DataFrame) -> DataFrame:
        found = rows.withColumn("_f", features(F.col("_text"), lexicon, stems)).drop("_text")
        return assembler.transform(found.select("*", *[F.get("_f", F.lit(k)).alias(f"_f{k}") for k in range(len(FEATURES))])).select(*[c for c in found.columns if c != "_f"], "_features")

    fitted = written(measured(train), "features")
    sizes = {(r["_toxic"], r["cal"]): r["count"] for r in fitted.groupBy("_toxic", (F.col("_fold") == 0).alias("cal")).count().collect()}
    if not all(sizes.get((c, False)) for c in (0, 1)):
        hit = F.exists(F.transform(tokens(F.col("_text")), bare), lambda w: w.isin(list(INSULTS)))
        return slim.select(F.col("_id").alias("doc_id"), F.when(hit, 0.9).otherwise(0.1).alias("score"))
    trees = GBTClassifier(featuresCol="_features", labelCol="_toxic", maxIter=15, maxDepth=3, stepSize=0.3, seed=7).fit(fitted.where("_fold > 0"))
    margin = vector_to_array("rawPrediction")[1]
    calibration = trees.transform(fitted.where("_fold = 0") if all(sizes.get((c, True)) for c in (0, 1)) else fitted)
    curve = IsotonicRegression(featuresCol="_margin", labelCol="_label", predictionCol="_iso").fit(calibration.select(margin.alias("_margin"), F.col("_toxic").cast("double").alias("_label")))
    out = trees.transform(measured(slim)).select(F.col("_id").alias("doc_id"), margin.alias("_margin"), vector_to_array("probability")[1].alias("_chance"))
    # The calibrated curve is flat in places; a hundredth of the trees' own probability keeps their order there.
    return curve.transform(out).select("doc_id", F.least(F.greatest(0.99 * F.col("_iso") + 0.01 * F.col("_chance"), F.lit(0.0)), F.lit(1.0)).alias("score"))


def op7_toxicity(spark, sf_dir):
    """Contract query 7: score and prediction of every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = scored(docs, labels)
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
