"""Functions of two aligned sequences of equal length, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PURINES, PYRIMIDINES = ("A", "G"), ("T", "C")


def columns(a: Column, b: Column) -> Column:
    """Array of ``struct(a, b)``, one per alignment column."""
    return F.arrays_zip(F.split(a, "").alias("a"), F.split(b, "").alias("b"))


def statistics(a: Column, b: Column) -> Column:
    """``struct(matches, mismatches, gaps, aligned_length)``."""
    cols = F.when(F.length(a) > 0, columns(a, b)).otherwise(F.array().cast("array<struct<a:string,b:string>>"))
    gap = lambda c: (c["a"] == "-") | (c["b"] == "-")
    size = lambda x: F.size(x).cast("bigint")
    return F.struct(
        size(F.filter(cols, lambda c: ~gap(c) & (c["a"] == c["b"]))).alias("matches"),
        size(F.filter(cols, lambda c: ~gap(c) & (c["a"] != c["b"]))).alias("mismatches"),
        size(F.filter(cols, gap)).alias("gaps"),
        size(cols).alias("aligned_length"))


def identity(stats: Column) -> Column:
    """Matches of all columns in percent, gaps included; 0 without columns."""
    return F.when(stats["aligned_length"] == 0, 0.0).otherwise(100 * stats["matches"] / stats["aligned_length"])


def non_gap_identity(stats: Column) -> Column:
    n = stats["matches"] + stats["mismatches"]
    return F.when(n == 0, 0.0).otherwise(100 * stats["matches"] / n)


def match_line(a: Column, b: Column) -> Column:
    """``|`` where letters agree, ``X`` where they differ, a blank at gaps."""
    return F.array_join(F.transform(columns(a, b), lambda c: F.when((c["a"] == "-") | (c["b"] == "-"), " ").when(c["a"] == c["b"], "|").otherwise("X")), "")


def is_transition(a: Column, b: Column) -> Column:
    return (a.isin(*PURINES) & b.isin(*PURINES)) | (a.isin(*PYRIMIDINES) & b.isin(*PYRIMIDINES))


def substitution_class(a: Column, b: Column) -> Column:
    return F.when(a == b, F.lit(None)).when(is_transition(a, b), "transition").otherwise("transversion")


def differences(a: Column, b: Column) -> Column:
    """``struct(n, transitions, transversions)`` over the columns without gap."""
    cols = F.filter(columns(a, b), lambda c: (c["a"] != "-") & (c["b"] != "-"))
    size = lambda x: F.size(x).cast("bigint")
    return F.struct(
        size(cols).alias("n"),
        size(F.filter(cols, lambda c: (c["a"] != c["b"]) & is_transition(c["a"], c["b"]))).alias("transitions"),
        size(F.filter(cols, lambda c: (c["a"] != c["b"]) & ~is_transition(c["a"], c["b"]))).alias("transversions"))


def hamming(d: Column) -> Column:
    """Share of differing columns; 0 without columns."""
    return F.when(d["n"] == 0, 0.0).otherwise((d["transitions"] + d["transversions"]) / d["n"])


def jukes_cantor(d: Column) -> Column:
    """Null where the distance is saturated."""
    p = hamming(d)
    return F.when(p < 0.75, -0.75 * F.log(1 - 4 * p / 3))


def kimura(d: Column) -> Column:
    """Two-parameter distance; null where it is saturated."""
    n = F.when(d["n"] > 0, d["n"])
    p, q = d["transitions"] / n, d["transversions"] / n
    x, y = 1 - 2 * p - q, 1 - 2 * q
    return F.when(d["n"] == 0, 0.0).when((x > 0) & (y > 0), -0.5 * F.log(x * F.sqrt(y)))


def pam(d: Column) -> Column:
    """PAM-like distance of proteins: 200 where it is saturated."""
    p = hamming(d)
    return F.when(p == 0, 0.0).when(p < 0.99, -100 * F.log(F.greatest(1 - 1.01 * p, F.lit(1e-12)))).otherwise(200.0)


def coverage(stats: Column, query_length: Column) -> Column:
    return F.when(query_length > 0, 100 * (stats["aligned_length"] - stats["gaps"]) / query_length).otherwise(0.0)


def confidence(cover: Column, gap_percent: Column, ident: Column) -> Column:
    """0 to 100 from coverage (40 %), gaps (35 %) and identity (25 %); null if any of them is."""
    score = F.least(F.lit(100.0), cover * 1.1) * 0.4 + F.greatest(F.lit(0.0), 100 - gap_percent * 5) * 0.35 + ident * 0.25
    known = cover.isNotNull() & gap_percent.isNotNull() & ident.isNotNull()  # least and greatest would pass over nulls
    return F.when(known, F.least(F.lit(100.0), F.greatest(F.lit(0.0), score)))
