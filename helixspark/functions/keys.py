"""Key normalisation and the notion of a missing value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters counted as blanks around a key or a word.
BLANKS = " \t\n\r\x0b\x0c   　﻿"

#: Words that merely stand for a missing value, in lower case.
STAND_INS = [
    "-", "--", "---", ".", "?", "??", "n/a", "n.a.", "n.a", "na", "nan", "nil", "nd", "n.d.", "none", "null", "missing", "tbd", "tba",
    "to be determined", "unknown", "undefined", "unspecified", "not applicable", "not available", "not known", "not provided",
    "not recorded", "not specified", "no value", "no data", "empty",
]


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def norm_key(c: Column) -> Column:
    """Trimmed upper-case key; null for null, empty and blank keys."""
    return F.nullif(F.upper(strip(c)), F.lit(""))


def gene_key(gene_id: Column, symbol: Column) -> Column:
    """``gene_id``, or ``symbol`` where it is null or empty, normalised."""
    return F.coalesce(norm_key(gene_id), norm_key(symbol))


def has_value(text: Column) -> Column:
    """False for null, blanks, empty arrays or objects and stand-in words."""
    bare = F.lower(strip(text))
    empty = bare.rlike(r"^(\[\s*\]|\{\s*\})?$")
    return F.coalesce(~empty & ~bare.isin(STAND_INS), F.lit(False))
