"""Fill-in-middle transformation by escaped marker injection, all in DataFrame functions.

1. A delimiter (U+0001) and the escape itself (U+0002) are escaped inside the text, so a bare delimiter can't occur.
2. ``regexp_replace`` puts a delimiter after every unit of the text (lines, as shipped); their number is the number of units.
3. Two cuts drawn from a hash of the row's id rank the units: ``substring_index`` takes the units up to a rank, and from it on.
4. The parts lose their delimiters, are unescaped, and are put together behind the markers, suffix first or prefix first.

Everything happens inside the row: no shuffle, no Python, one row's text in memory at a time.

Defined results: a null text is empty. An empty text, one that contains a marker, and rows that the rate leaves out stay plain: the output
is the text, and lengths are null. A null id draws as an empty one. Rows that repeat id and text get the same cuts. Texts without a line end
are one unit. Empty tables give empty results. Extra columns pass unchanged, whatever their names; only the struct
``_fim`` is replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canticle.plans.expr import let

LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, PERCENT, SPM_PERCENT = 7, 100, 50
_END, _ESCAPE = "\x01", "\x02"


def _replaced(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def marked_units(text: Column, unit: str = LINES) -> Column:
    """The text, escaped, with a delimiter after each match of ``unit``, which must match every character in turn."""
    escaped = _replaced(_replaced(text, _ESCAPE, _ESCAPE + "e"), _END, _ESCAPE + "d")
    return F.regexp_replace(escaped, unit, "$0" + _END)


def plain_text(part: Column) -> Column:
    """A part of a marked text without delimiters and escapes."""
    return _replaced(_replaced(_replaced(part, _END, ""), _ESCAPE + "d", _END), _ESCAPE + "e", _ESCAPE)


def drawn(id_: Column, seed: int = SEED, count: int = 4) -> list[Column]:
    """The first 8-digit groups of the hex SHA-256 of ``seed:id`` as unsigned integers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(count)]


def _ranked(marked: Column, first: Column, last: Column) -> Column:
    """Units ``first`` (exclusive, counted from 0) to ``last`` of a marked text."""
    upto = F.call_function("substring_index", marked, F.lit(_END), last.cast("int"))
    return plain_text(F.call_function("substring_index", upto, F.lit(_END), (first - last).cast("int")))


def infilled(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, percent: int = PERCENT, spm_percent: int = SPM_PERCENT,
    unit: str = LINES, markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), out: str = "_fim",
) -> DataFrame:
    """``docs`` with the struct ``out``: units, form (plain, psm or spm), prefix, middle, suffix (null if plain) and output."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    h1, h2, h3, h4 = drawn(F.col(id_col), seed)
    has_marker = reduce(lambda a, b: a | b, (F.contains(text, F.lit(m)) for m in markers))
    form = F.when((text == "") | has_marker | (h3 % 100 >= percent), "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")

    def cut(x: Column) -> Column:
        marked = x["marked"]
        n = (F.octet_length(marked) - F.octet_length(_replaced(marked, _END, ""))).cast("long")
        a, b = x["h1"] % (n + 1), x["h2"] % (n + 1)
        return F.struct(x["text"].alias("text"), x["form"].alias("form"), marked.alias("marked"), n.alias("n"), F.least(a, b).alias("first"), F.greatest(a, b).alias("last"))

    def parted(x: Column) -> Column:
        cutting = lambda first, last: F.when(x["form"] != "plain", _ranked(x["marked"], first, last))
        # All from the last cut on: the marked text ends with a delimiter, so one more empty part comes at its end.
        rest = F.call_function("substring_index", x["marked"], F.lit(_END), (x["last"] - x["n"] - 1).cast("int"))
        suffix = F.when(x["form"] != "plain", plain_text(rest))
        return F.struct(x["text"].alias("text"), x["form"].alias("form"), x["n"].alias("n"), cutting(F.lit(0), x["first"]).alias("prefix"), cutting(x["first"], x["last"]).alias("middle"), suffix.alias("suffix"))

    def assembled(x: Column) -> Column:
        p, s, m = (F.lit(k) for k in markers)
        output = F.when(x["form"] == "psm", F.concat(p, x["prefix"], s, x["suffix"], m, x["middle"])).when(x["form"] == "spm", F.concat(s, x["suffix"], p, x["prefix"], m, x["middle"])).otherwise(x["text"])
        return F.struct(x["n"].alias("n"), x["form"].alias("form"), x["prefix"].alias("prefix"), x["middle"].alias("middle"), x["suffix"].alias("suffix"), output.alias("output"))

    start = F.struct(text.alias("text"), form.alias("form"), h1.alias("h1"), h2.alias("h2"), marked_units(text, unit).alias("marked"))
    told = let(start, lambda x: let(cut(x), lambda y: let(parted(y), assembled)))
    return docs.drop(out).select("*", told.alias(out))


def restored(output: Column, form: Column, markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that gave ``output``, from it and its form alone. A text with a part behind a marker holds no marker itself."""
    p, s, m = markers
    upto = lambda text, mark: F.substring_index(text, mark, 1)
    after = lambda text, mark: F.substring_index(text, mark, -1)
    psm = F.concat(upto(after(output, p), s), after(output, m), upto(after(output, s), m))
    spm = F.concat(upto(after(output, p), m), after(output, m), upto(after(output, s), p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fill_in_middle(spark, sf_dir):
    """Contract query 13: form, lengths and digests of every document's transformation."""
    found = infilled(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    x = F.col("_fim")
    return found.select(
        "doc_id", x["n"].alias("n"), x["form"].alias("form"), F.char_length(x["prefix"]).cast("long").alias("prefix_chars"), F.char_length(x["middle"]).cast("long").alias("middle_chars"),
        F.sha2(x["output"], 256).alias("output_sha256"), F.sha2(restored(x["output"], x["form"]), 256).alias("restored_sha256"),
    )


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x,
         regexp_extract_all(coalesce(text, ''), '[^' || chr(10) || ']*' || chr(10) || '|[^' || chr(10) || ']+') AS u
  FROM documents),
h AS (
  SELECT doc_id, t, u, len(u) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[25:32] AS BIGINT) AS h4
  FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
