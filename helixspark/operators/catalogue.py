"""The gene catalogue as a table: normalising, merging, deduplicating, auditing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixspark.functions import seq


def truthy(*columns: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def normalise(df: DataFrame) -> DataFrame:
    """Records with a sequence in one form: key fields filled from each other, type in one spelling, links completed.

    Needs ``gene_id, symbol, organism, sequence, sequence_type, description,
    source, source_url, external_links`` and keeps ``id``.  Rows without
    letters are dropped; links already present win over ``source_url``.
    """
    rows = df.withColumn("_s", F.upper(F.regexp_replace("sequence", r"\s+", ""))).where(F.col("_s") != "")
    link = F.when(truthy(F.col("source_url")).isNotNull(), F.map_from_arrays(F.array(F.lit("source_api")), F.array("source_url")))
    links = F.coalesce("external_links", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    merged = F.when(link.isNotNull() & ~F.map_contains_key(links, F.lit("source_api")), F.map_concat(links, link)).otherwise(links)
    return rows.select(
        "id", truthy(F.col("gene_id"), F.col("symbol")).alias("gene_id"), truthy(F.col("symbol"), F.col("gene_id")).alias("symbol"),
        F.coalesce(truthy(F.col("organism")), F.lit("Unknown")).alias("organism"), F.col("_s").alias("sequence"),
        seq.normal_type(F.col("sequence_type"), F.col("sequence")).alias("sequence_type"), F.coalesce("description", F.lit("")).alias("description"),
        merged.alias("external_links"), F.length("_s").cast("bigint").alias("length"), F.coalesce(truthy(F.col("source")), F.lit("collected")).alias("source"))


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first in ``order``; null keys are a key of their own.

    The pick is a rank cut to one before the shuffle (the planner's window
    group limit), so a key that holds a third of all rows sends one row per
    task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def priority_union(parts: list[DataFrame], keys: list[str], order: list) -> DataFrame:
    """Rows of all parts, one per key, earlier parts first; columns missing in a part are null."""
    tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return first_of(union, keys, ["_part", *order]).drop("_part")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The catalogue after ``new`` arrives: both have one row per ``key`` and the same columns.

    Texts that describe the record overwrite; ``sequence``, ``sequence_type``,
    ``description`` and ``source_url`` stay where the new one is null or
    empty; maps merge, the new entry winning; arrays stay where the new one
    is null or empty; ``length`` stays where the new one is null or 0.  A row
    found on one side only is kept as it is.
    """
    types = dict(new.dtypes)
    a, b = old.alias("a"), new.alias("b")
    joined = a.join(b, F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")), "full_outer")
    is_new = F.col(f"b.{key}").isNotNull()
    out = []
    for c in new.columns:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        if c == key:
            v = F.coalesce(y, x)
        elif c in ("sequence", "sequence_type", "description", "source_url"):
            v = F.coalesce(F.nullif(y, F.lit("")), x)
        elif types[c].startswith("map<string,string>"):
            v = F.when(y.isNull(), x).when(x.isNull(), y).otherwise(F.map_concat(F.map_filter(x, _absent(y)), y))
        elif types[c].startswith("array"):
            v = F.when(F.size(y) > 0, y).otherwise(F.coalesce(x, y))
        elif c == "length":
            v = F.coalesce(F.nullif(y, F.lit(0)), x)
        else:
            v = F.when(is_new, y).otherwise(x)
        out.append(v.alias(c))
    return joined.select(*out)


def _absent(entries: Column):
    return lambda k, _: ~F.map_contains_key(entries, k)


def attach(df: DataFrame, keys: list[Column], details: DataFrame, detail_keys: list[Column], columns: list[str]) -> DataFrame:
    """``details`` joined where any of its keys equals any of the row's: one join on exploded keys, not a join per pair of keys.

    ``df`` has a unique ``id``.  A row meets each detail once; null and empty
    keys match nothing.
    """
    left = df.withColumn("_row", F.col("id"))
    one = left.select("_row", F.explode(F.array_distinct(F.array_compact(F.array(*[F.nullif(k, F.lit("")) for k in keys])))).alias("_key"))
    two = details.select(*columns, F.explode(F.array_distinct(F.array_compact(F.array(*[F.nullif(k, F.lit("")) for k in detail_keys])))).alias("_key"))
    return left.join(one.join(two, "_key").drop("_key").distinct(), "_row", "left").drop("_row")


def audit(planned: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """``(key, status)`` of every planned key and every key done: ``done``, ``missing`` or ``unplanned``."""
    a, b = planned.select(key).distinct().withColumn("_p", F.lit(True)), done.select(key).distinct().withColumn("_d", F.lit(True))
    status = F.when(F.col("_p").isNull(), "unplanned").when(F.col("_d").isNull(), "missing").otherwise("done")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def completeness(columns: list[Column]) -> Column:
    """Share of the columns that are neither null nor empty."""
    return sum((F.when(F.coalesce(F.length(c), F.lit(0)) > 0, 1).otherwise(0) for c in columns), F.lit(0)) / len(columns)


def faults(df: DataFrame) -> Column:
    """The first fault of a record against the catalogue's schema; null if there is none."""
    kinds = F.lower(F.trim("sequence_type"))
    return F.coalesce(
        *[F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(f"missing {c}")) for c in ("gene_id", "symbol", "sequence", "sequence_type")],
        F.when(~kinds.isin("dna", "protein", "rna"), F.lit("unknown sequence_type")))


#: Rules by which records of several files count as one.
RULES = ("key_organism", "key_or_record", "none")


def deduplicated(df: DataFrame, rule: str) -> DataFrame:
    """SET-03: One row of each set of equal records, the first by all its columns in order.

    ``key_organism``: records of one gene id and organism are one, an empty or
    missing id being an id like any other (a missing organism is Unknown).
    ``key_or_record``: those of one gene id, else symbol, and organism; a
    record with neither equals only the same record.  ``none``: all stay.
    """
    if rule not in RULES:
        raise ValueError(f"no such rule: {rule}")
    if rule == "none":
        return df
    whole = F.to_json(F.struct(*sorted(df.columns)))
    if rule == "key_organism":
        key = F.concat(F.coalesce("gene_id", F.lit("")), F.lit("::"), F.coalesce("organism", F.lit("Unknown")))
    else:
        name = truthy(F.col("gene_id"), F.col("symbol"))
        key = F.coalesce(F.concat(name, F.lit("::"), F.coalesce("organism", F.lit(""))), whole)
    plain = [F.asc_nulls_last(c) for c, t in df.dtypes if t in ("timestamp", "bigint", "int", "string", "double")]
    return first_of(df.withColumn("_key", key), ["_key"], plain).drop("_key")


def master_totals(df: DataFrame) -> DataFrame:
    """``(total_genes, total_species)`` of one set of records."""
    return df.agg(F.count("*").alias("total_genes"), F.countDistinct(F.coalesce("organism", F.lit("Unknown"))).alias("total_species"))


def by_length_cap(df: DataFrame, caps: dict[str, int]) -> DataFrame:
    """SRC-12: Rows ``(sequence_type, length)`` no longer than the cap of their type; types without cap give no rows."""
    cap = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])
    return df.where(F.col("length") <= F.element_at(cap, F.col("sequence_type")))
