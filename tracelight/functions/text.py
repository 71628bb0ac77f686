"""Small text helpers: masking, name clean-up, path normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mask(value: Column, keep_last: int = 0, mask_char: str = "*") -> Column:
    """Replace all but the last characters; values no longer than that are hidden completely."""
    size = F.length(value)
    hidden = F.repeat(F.lit(mask_char), F.when(size <= keep_last, size).otherwise(size - keep_last))
    shown = F.when(size > keep_last, F.right(value, F.lit(keep_last))).otherwise("")
    return F.coalesce(F.concat(hidden, shown), F.lit(""))


def sanitize_field_name(name: Column) -> Column:
    """Letters, digits, ``_ - .`` stay, anything else becomes ``_``; outer ``_`` are dropped."""
    return F.btrim(F.regexp_replace(name, r"[^\p{L}\p{N}_.-]", "_"), F.lit("_"))


def normalize_path(path: Column) -> Column:
    """Field path without array positions, so all items of an array share one path."""
    return F.regexp_replace(path, r"\[\d+\]", "")


def one_of(column: Column, values: list[str]) -> Column:
    """``isin`` that also accepts an empty list."""
    return column.isin(*values) if values else F.lit(False)
