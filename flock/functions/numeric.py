"""Numeric and text column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pct_decimal(flag) -> Column:
    """``CAST(SUM(f) / CAST(COUNT(*) AS DECIMAL(19,2)) * 100 AS DECIMAL(19,2))`` (aggregate)."""
    share = F.sum(_c(flag)) / F.count(F.lit(1)).cast("decimal(19,2)") * 100
    return share.cast("decimal(19,2)")


def hist_bin(x, width) -> Column:
    """Centre of the right-closed bin of width ``width`` centred on multiples
    of the width: (c - w/2, c + w/2]."""
    w = F.lit(float(width)) if not isinstance(width, Column) else width
    return F.ceil((_c(x) - w / 2) / w) * w


def recode_first_match(c, pattern: str, replacement: str) -> Column:
    """``str_replace``: replace the first match of ``pattern`` inside the text."""
    return F.regexp_replace(_c(c), "^(.*?)" + pattern, "$1" + replacement)


def recode_exact(c, mapping: dict) -> Column:
    """Whole-value lookup; values not in the mapping are kept."""
    col = _c(c).cast("string")
    expr = None
    for k, v in mapping.items():
        expr = (F.when(col == str(k), F.lit(v)) if expr is None
                else expr.when(col == str(k), F.lit(v)))
    return expr.otherwise(col) if expr is not None else col


#: Texts that are numbers: a decimal with an optional exponent, blanks around it.  Spark's own cast also
#: takes a type letter at the end (``12f``), which is no number here.
NUMBER_TEXT = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"


def r_numeric(c) -> Column:
    """R ``as.numeric`` of text or numbers: text that is no decimal number becomes null."""
    text = _c(c).cast("string")
    return F.when(text.rlike(NUMBER_TEXT), text.try_cast("double"))


def r_integer(c) -> Column:
    """R ``as.integer`` of text or numbers: truncated towards zero; bad text and what 32 bits
    cannot hold become null."""
    return r_numeric(c).try_cast("int")
