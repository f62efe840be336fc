"""Sources: driver tables, lyric texts, chord documents and MusicXML parts."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lyric_files(spark: SparkSession, path: str) -> DataFrame:
    """(song_id, lrc): a file a song; the id is the file's path."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("song_id"), F.col("value").alias("lrc"))


def sampled(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """A reproducible sample of ``n`` rows (the sample is the feature): those with the least hash of their key."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


CHORD_DOC = "title string, lines array<struct<text: string, chords: array<struct<name: string, at: int>>>>"


def chord_documents(docs: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(song_id, line_idx, text, chord, char_offset) from chord documents in JSON; bad JSON has no lines."""
    parsed = docs.select(F.col(id_col).alias("song_id"), F.from_json(json_col, CHORD_DOC).alias("d"))
    lines = parsed.select("song_id", F.posexplode(F.coalesce("d.lines", F.array().cast("array<struct<text:string,chords:array<struct<name:string,at:int>>>>"))).alias("line_idx", "line"))
    return lines.select("song_id", "line_idx", F.col("line.text").alias("text"), F.explode_outer("line.chords").alias("c")).select("song_id", "line_idx", "text", F.col("c.name").alias("chord"), F.col("c.at").alias("char_offset"))


def bracket_chords(lines: DataFrame) -> DataFrame:
    """Lines such as ``[Am]word [F]word`` to their plain text and chords with character offsets."""
    pieces = F.regexp_extract_all("raw", F.lit(r"(\[[^\]]+\]|[^\[]+)"), F.lit(1))
    text = F.array_join(F.filter(pieces, lambda p: ~p.startswith("[")), "")
    marks = F.transform(pieces, lambda p, i: F.struct(p.startswith("[").alias("is_chord"), p.alias("p"), i.alias("i")))
    before = lambda i: F.char_length(F.array_join(F.filter(F.slice(pieces, 1, F.greatest(i, F.lit(0))), lambda q: ~q.startswith("[")), ""))
    chords = F.transform(F.filter(marks, lambda m: m["is_chord"]), lambda m: F.struct(F.btrim(m["p"], F.lit("[]")).alias("chord"), before(m["i"]).alias("char_offset")))
    return lines.withColumns({"text": text, "chords": chords})


NOTES = "file string, part string, measure int, position long, ticks long, step string, lyric string, syllabic string"


def notes_of(file: str, score: bytes) -> list[tuple]:
    """The notes of a score by a cursor for each part: ``backup`` and ``forward`` move it, notes of a chord share their start."""
    found = []
    for part in ElementTree.fromstring(score).iter("part"):
        at = start = 0
        for bar in part.iter("measure"):
            for x in bar:
                ticks = int(x.findtext("duration") or 0)
                if x.tag == "backup":
                    at -= ticks
                elif x.tag == "forward":
                    at += ticks
                elif x.tag == "note":
                    if x.find("chord") is None:
                        start, at = at, at + ticks
                    lyric = x.find("lyric")
                    sung = (None, None) if lyric is None else (lyric.findtext("text"), lyric.findtext("syllabic"))
                    number = "".join(c for c in bar.get("number") or "" if c.isdigit())
                    found.append((file, part.get("id"), int(number) if number else None, start, ticks, x.findtext("pitch/step"), *sung))
    return found


def musicxml_notes(spark: SparkSession, path: str) -> DataFrame:
    """(file, part, measure, position, ticks, step, lyric, syllabic) of scores, positions in ticks from the part's beginning. Order of
    elements decides, so a file is read whole; files are spread over tasks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [row for path, content in zip(frame["path"], frame["content"], strict=True) for row in notes_of(path, content)]
            yield pd.DataFrame(rows, columns=[field.split()[0] for field in NOTES.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, NOTES)
