"""References to keys that do not exist, per table and month.

Changes are signed deltas: a reference counts 1 at its table, key and time,
its removal -1; a catalogue row counts 1 at its key and date, its deletion or
retirement -1.  Deltas fold into one signed state on the map side, and a
later batch folds into the state of the batches before it.  Keys with
positive references and without existence are orphans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REFERENCE = ["ref_table", "gene_key", "at"]
EXISTENCE = ["gene_key", "since"]
#: Parts over which the references of one key are dealt by their time.
SALT = 8


def reference_deltas(df: DataFrame, name: str, key: Column, at: Column, sign: int = 1) -> DataFrame:
    """``(ref_table, gene_key, at, n)``: the references of one table, or with ``sign`` -1 their removal."""
    rows = df.select(F.lit(name).alias("ref_table"), key.alias("gene_key"), at.cast("timestamp").alias("at"))
    return rows.where(F.col("gene_key").isNotNull()).groupBy(*REFERENCE).agg((F.count("*") * sign).alias("n"))


def existence_deltas(df: DataFrame, key: Column, since: Column | None = None, sign: int = 1) -> DataFrame:
    """``(gene_key, since, n, retired)`` of a table whose rows let a key exist, or with ``sign`` -1 let it exist no longer."""
    at = since if since is not None else F.lit(None)
    rows = df.select(key.alias("gene_key"), at.cast("timestamp").alias("since")).where(F.col("gene_key").isNotNull())
    return rows.groupBy(*EXISTENCE).agg((F.count("*") * sign).alias("n"), F.lit(0).cast("bigint").alias("retired"))


def retirement_deltas(df: DataFrame, key: Column) -> DataFrame:
    """Keys that were retired: each once existed, at no known date, and ceased to, so the sum is 0 and what remains is the mark."""
    birth, death = existence_deltas(df, key), existence_deltas(df, key, sign=-1)
    return birth.unionByName(death.withColumn("retired", -F.col("n")))


def fold(deltas: list[DataFrame], state: DataFrame | None = None) -> DataFrame:
    """The signed state after ``deltas``, of references or of existence, starting from ``state``; entries that cancel out are gone."""
    every = reduce(DataFrame.unionByName, [*([state] if state is not None else []), *deltas])
    counts = [c for c in ("n", "retired") if c in every.columns]
    folded = every.groupBy(*[c for c in every.columns if c not in counts]).agg(*[F.sum(c).alias(c) for c in counts])
    return folded.where(" OR ".join(f"{c} <> 0" for c in counts))


def orphans(references: DataFrame, existence: DataFrame) -> DataFrame:
    """Orphan references ``(ref_table, ref_month, gene_key, reason, n_refs)`` of two states.

    ``deleted``: nothing lets the key exist, but it was retired.  ``missing``:
    it is known nowhere.  ``early``: it exists, but the reference precedes
    all its known dates; ``n_refs`` counts such references only.  Null and
    blank keys are no references; a reference without time has a null month
    and is never early; a key whose dates are all null is never early; empty
    tables give no rows.
    """
    known = existence.groupBy("gene_key").agg(
        F.sum("n").alias("existing"), F.min(F.when(F.col("n") > 0, F.col("since"))).alias("known_since"), F.max("retired").alias("retired"))
    reason = (
        F.when(F.coalesce("existing", F.lit(0)) > 0, F.when(F.col("at") < F.col("known_since"), F.lit("early")))
        .when(F.coalesce("retired", F.lit(0)) > 0, F.lit("deleted"))
        .otherwise(F.lit("missing"))
    )
    # one key may hold a third of all references, each at a time of its own
    dealt = references.where("n > 0").withColumn("_salt", F.pmod(F.hash("at"), F.lit(SALT)))
    known = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    judged = dealt.join(known, ["gene_key", "_salt"], "left").withColumn("reason", reason).where(F.col("reason").isNotNull())
    return judged.groupBy("ref_table", F.date_format("at", "yyyy-MM").alias("ref_month"), "gene_key", "reason").agg(F.sum("n").alias("n_refs"))


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphan keys and references per table, month and reason."""
    return found.groupBy("ref_table", "ref_month", "reason").agg(F.count("*").alias("n_keys"), F.sum("n_refs").cast("bigint").alias("n_refs"))
