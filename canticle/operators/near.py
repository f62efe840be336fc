"""Similarity join of short texts by edit distance, on equal segments.

A text of the indexed side with L letters is cut into k + 1 segments, k being the most edits that any partner may have. At most k edits leave one
segment whole, so a partner has it, near its place: the i-th segment (from 0) is moved by i letters at most from the left, and by k - i from the
right. Rows meet on the key, the length L, the number of the segment and its text, instead of all texts of a key; the distance then decides. No pair within the
allowed share of edits is missed.

Where a key has at most ``FEW`` indexed texts, a text meets them all: fewer rows than its probes would be.

Pairs may come several times, once for each segment they share. Texts of a key that have a segment in common, at one place, do meet: rare where titles differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Indexed texts of a key that are compared without segments.
FEW = 16


def _longest(length: Column, percent: int) -> Column:
    """The most letters that a partner of a text with ``length`` letters has."""
    return F.floor(length * 100 / (100 - percent)).cast("int")


def _edits(length: Column, percent: int) -> Column:
    """The most edits between a text of ``length`` letters and any partner."""
    return F.floor(_longest(length, percent) * percent / 100).cast("int")


def _segment(length: Column, k: Column, i: Column) -> tuple[Column, Column]:
    """(start, letters) of the i-th of k + 1 segments; the last ones take the letters left over."""
    base, more = F.floor(length / (k + 1)).cast("int"), (length % (k + 1)).cast("int")
    long_ = i - (k + 1 - more)
    return (i * base + F.greatest(F.lit(0), long_)).cast("int"), (base + (long_ >= 0).cast("int")).cast("int")


def _part(length: Column, i: Column, text: Column, start: Column, letters: Column) -> Column:
    return F.struct(length.alias("length"), i.alias("i"), F.substring(text, start + 1, letters).alias("part"))


def segments(text: Column, percent: int) -> Column:
    """The segments of an indexed text."""
    length = F.char_length(text)
    k = _edits(length, percent)
    return F.transform(F.sequence(F.lit(0), k), lambda i: _part(length, i, text, *_segment(length, k, i)))


def probes(text: Column, percent: int) -> Column:
    """What segments of partners of any fitting length a text can share with them."""
    own = F.char_length(text)

    def of_segment(length: Column, k: Column, i: Column) -> Column:
        start, letters = _segment(length, k, i)
        low = F.greatest(F.lit(0), start - i, start + own - length - (k - i))
        high = F.least(own - letters, start + i, start + own - length + (k - i))
        return F.when(low <= high, F.transform(F.sequence(low, high), lambda at: _part(length, i, text, at, letters)))

    def of_length(length: Column) -> Column:
        k = _edits(length, percent)
        return F.flatten(F.filter(F.transform(F.sequence(F.lit(0), k), lambda i: of_segment(length, k, i)), lambda x: x.isNotNull()))

    shortest = F.ceil(own * (100 - percent) / 100).cast("int")
    return F.array_distinct(F.flatten(F.transform(F.sequence(shortest, _longest(own, percent)), of_length)))


def candidates(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], left_text: str, right_text: str, percent: int) -> DataFrame:
    """Rows of ``left`` and ``right`` with equal keys ``on`` whose texts may differ in up to ``percent`` of the longer one's letters:
    all that do, and others. Column names of the two sides differ."""
    keys = [y for _, y in on]
    sizes = right.groupBy(*keys).agg(F.count("*").alias("_texts"))
    few, many = sizes.where(F.col("_texts") <= FEW).select(*keys), sizes.where(F.col("_texts") > FEW).select(*keys)
    equal = F.lit(True)
    for x, y in on:
        equal &= F.col(x) == F.col(y)
    direct = left.join(right.join(few, keys, "left_semi"), equal)
    a = left.join(many, equal, "left_semi").withColumn("_probe", F.explode(probes(F.col(left_text), percent)))
    b = right.join(many, keys, "left_semi").withColumn("_segment", F.explode(segments(F.col(right_text), percent)))
    shared = a.join(b, equal & (F.col("_probe") == F.col("_segment"))).drop("_probe", "_segment")
    return direct.unionByName(shared)
