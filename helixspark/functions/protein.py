"""Protein functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from helixspark import schema
from helixspark.functions.seq import count_of

ROUNDS = 25


def distribution(s: Column) -> Column:
    """``map<letter, count>`` over the whole amino-acid alphabet."""
    return F.create_map(*[x for a in schema.AMINO_VALID for x in (F.lit(a), count_of(s, a))])


def mass_centi(s: Column) -> Column:
    """Mass of the chain in hundredths of a dalton: free amino acids less the water lost in each bond; 0 for an empty text."""
    known = sum((count_of(s, a) * F.lit(m) for a, m in schema.MASS.items()), F.lit(0).cast("bigint"))
    other = F.length(s) - count_of(s, schema.AMINO_VALID)
    return F.when(F.length(s) == 0, 0).otherwise(known + other * schema.OTHER_MASS - (F.length(s) - 1) * schema.WATER).cast("bigint")


def hydropathy(s: Column) -> Column:
    """Mean Kyte-Doolittle value; 0 for an empty text."""
    total = sum((count_of(s, a) * F.lit(h) for a, h in schema.HYDROPATHY.items()), F.lit(0).cast("bigint"))
    return F.when(F.length(s) == 0, 0.0).otherwise(total / (F.length(s) * 10))


def unique_residues(s: Column) -> Column:
    return sum((s.contains(a).cast("bigint") for a in schema.AMINO_VALID), F.lit(0).cast("bigint"))


def isoelectric_point(s: Column) -> Column:
    """pH at which the chain carries no charge, by ``ROUNDS`` bisections of 0 to 14; 0 for an empty text."""
    counts = F.struct(*[count_of(s, a).cast("double").alias(a) for a in "KRHDECY"])

    def charge(n: Column, ph: Column) -> Column:
        plus = sum((n[a] / (1 + F.pow(F.lit(10.0), ph - pka)) for a, pka in schema.PKA_POSITIVE.items() if a != "N_TERM"), 1 / (1 + F.pow(F.lit(10.0), ph - schema.PKA_POSITIVE["N_TERM"])))
        minus = sum((n[a] / (1 + F.pow(F.lit(10.0), F.lit(pka) - ph)) for a, pka in schema.PKA_NEGATIVE.items() if a != "C_TERM"), 1 / (1 + F.pow(F.lit(10.0), F.lit(schema.PKA_NEGATIVE["C_TERM"]) - ph)))
        return plus - minus

    start = F.struct(F.lit(0.0).alias("low"), F.lit(14.0).alias("high"), counts.alias("n"))

    def halve(a: Column, _: Column) -> Column:
        mid = (a["low"] + a["high"]) / 2
        up = charge(a["n"], mid) > 0
        return F.struct(F.when(up, mid).otherwise(a["low"]).alias("low"), F.when(up, a["high"]).otherwise(mid).alias("high"), a["n"].alias("n"))

    point = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, halve, lambda a: (a["low"] + a["high"]) / 2)
    return F.when(F.length(s) == 0, 0.0).otherwise(point)


def group(residue: Column) -> Column:
    """Property group of one residue; null for unusual ones."""
    out = None
    for name, letters in schema.GROUPS.items():
        hit = residue.isin(list(letters))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out
