"""Inputs shared by the query modules, and the same inputs in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.functions import seq
from helixspark.functions.keys import gene_key
from helixspark.session import spread
from helixspark.tables import table


def letters(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """``(id, s)`` and further columns: every sequence that isn't empty, upper case, without white space."""
    rows = table(spark, d, "genes").select("id", "sequence", *more)
    return rows.select("id", seq.bare(F.col("sequence")).alias("s"), *more).where(F.col("s") != "")


def spread_dna(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """As ``dna``, for work that costs much more than reading."""
    return spread(dna(spark, d, *more))


def dna(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return letters(spark, d, *more).where(F.col("s").rlike("^[ACGTN]+$"))


def proteins(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Sequences of amino acids that are no DNA or RNA."""
    s = F.col("s")
    return letters(spark, d, *more).where(s.rlike("^[ACDEFGHIKLMNPQRSTVWYBXZ*]+$") & ~s.rlike("^[ACGTUN]+$"))


def key():
    return gene_key(F.col("gene_id"), F.col("symbol"))


SQL_KEY = "coalesce(nullif(upper(trim(gene_id)), ''), nullif(upper(trim(symbol)), ''))"
SQL_LETTERS = r"(SELECT *, upper(regexp_replace(sequence, '\s+', '', 'g')) AS s FROM genes WHERE regexp_replace(sequence, '\s+', '', 'g') <> '')"
SQL_DNA = f"(SELECT * FROM {SQL_LETTERS} WHERE regexp_full_match(s, '[ACGTN]+'))"
SQL_PROTEIN = f"(SELECT * FROM {SQL_LETTERS} WHERE regexp_full_match(s, '[ACDEFGHIKLMNPQRSTVWYBXZ*]+') AND NOT regexp_full_match(s, '[ACGTUN]+'))"


def sql_count(letter_set: str, s: str = "s") -> str:
    return f"(length({s}) - length(translate({s}, '{letter_set}', '')))"


def sql_map(values: dict, name: str, key_name: str = "k", value_name: str = "v") -> str:
    rows = ", ".join(f"('{k}', {v!r})" for k, v in values.items())
    return f"{name}({key_name}, {value_name}) AS (VALUES {rows})"


def sql_reverse_complement(s: str = "s") -> str:
    return f"reverse(translate({s}, 'ATGCN', 'TACGN'))"
