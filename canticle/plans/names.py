"""Names for columns on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unused(df: DataFrame, *names: str) -> list[str]:
    """A name for each of ``names`` that no column of ``df`` has: it with underscores before it, as many as are needed."""
    have = {c.lower() for c in df.columns}
    found = []
    for name in names:
        name = f"_{name}"
        while name.lower() in have:
            name = f"_{name}"
        found.append(name)
        have.add(name.lower())
    return found


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` in one struct: whatever their names, they meet no others on the way."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def restored(df: DataFrame, row: str, new: dict[str, Column] | None = None) -> list[Column]:
    """The columns of ``df`` out of the struct column ``row``; those in ``new`` take its values."""
    new = new or {}
    return [(new[c] if c in new else F.col(f"{row}.`{c}`")).alias(c) for c in df.columns]
