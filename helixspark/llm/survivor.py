"""One surviving record for each group of records with the same key.

Records are taken apart into claims, one per field that has a value.  Two
operators share them: ``survivors`` picks, field by field, the row whose
value survives by declared trust; ``latent_truth`` infers each source's
sensitivity and specificity by expectation-maximisation, and
``golden_records`` is built from the values it judges true: one of a field
that holds a single value, each true one of a field that holds several.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixspark.functions import jsonx
from helixspark.functions.keys import gene_key, has_value, strip
from helixspark.session import checkpoint

#: Listed sources at most: a claim pattern is a bitmap of them, with one more bit for all that aren't listed.
MOST_SOURCES = 16
EM_ROUNDS = 60
#: Beta priors of sensitivity, specificity and truth; they keep the labels from switching.
SENSITIVITY, SPECIFICITY, TRUTH = (8, 2), (9, 1), (1, 1)


def trust(sources: DataFrame) -> DataFrame:
    """``(spelling, source, trust_rank)``: each source under its name and its label."""
    spelling = F.explode(F.array_distinct(F.array(F.lower(strip(F.col("source"))), F.lower(strip(F.col("label"))))))
    rows = sources.select(spelling.alias("spelling"), F.col("source").alias("source_name"), "trust_rank").where(F.col("spelling").isNotNull())
    return rows.groupBy("spelling").agg(F.min(F.struct("trust_rank", "source_name")).alias("t")).select("spelling", "t.source_name", "t.trust_rank")


def claims(genes: DataFrame, sources: DataFrame) -> DataFrame:
    """``(gene_key, field_name, value, source_name, trust_rank, date_added, id)``, one row per field with a value.

    A row without any value still gives one claim with a null field, so that
    rows can be counted per key.  Nested values are JSON text.  Rows without
    key are no records of a gene and give no claim; sources that are not
    listed are trusted least.
    """
    prefixed = lambda m, p: F.transform(F.map_entries(m), lambda e: F.struct(F.concat(F.lit(p), e["key"]).alias("field_name"), e["value"].alias("value")))
    none = F.array().cast("array<struct<field_name:string,value:string>>")
    every = F.concat(
        F.array(F.struct(F.lit("description").alias("field_name"), F.col("description").alias("value"))),
        F.coalesce(prefixed(jsonx.text_members(F.col("annotations")), "annotations."), none),
        F.coalesce(prefixed(F.col("external_links"), "external_links."), none),
    )
    fields = F.filter(every, lambda e: e["field_name"].isNotNull() & has_value(e["value"]))
    rows = genes.select(
        gene_key(F.col("gene_id"), F.col("symbol")).alias("gene_key"), F.lower(strip(F.col("source"))).alias("spelling"), "date_added", "id",
        F.explode_outer(fields).alias("f"))
    rows = rows.where(F.col("gene_key").isNotNull()).join(trust(sources), "spelling", "left")
    return rows.select("gene_key", "f.field_name", "f.value", "source_name", "trust_rank", "date_added", "id")


def _rows_per_key(genes: DataFrame) -> DataFrame:
    keyed = genes.select(gene_key(F.col("gene_id"), F.col("symbol")).alias("gene_key")).where(F.col("gene_key").isNotNull())
    return keyed.groupBy("gene_key").agg(F.count("*").alias("_rows")).where("_rows >= 2").drop("_rows")


def survivors(genes: DataFrame, sources: DataFrame) -> DataFrame:
    """``(gene_key, field_name, id)``: for keys with two or more rows, the row whose value survives.

    Most trusted source first (unlisted sources last), then the latest date
    (null last), then the highest id.  The choice is one maximum per key and
    field, folded on the map side, so a key that holds a third of all rows
    moves one candidate per task.  Fields without any value give no row.
    """
    rank = F.struct((-F.coalesce(F.col("trust_rank"), F.lit(2**31 - 1))).alias("r"), F.col("date_added").alias("d"), F.col("id").alias("id"))
    best = claims(genes, sources).where(F.col("field_name").isNotNull()).groupBy("gene_key", "field_name").agg(F.max(rank).alias("_b"))
    return best.join(_rows_per_key(genes), "gene_key").select("gene_key", "field_name", F.col("_b.id").alias("id"))


def _atoms(value: Column) -> Column:
    """The values of a possibly multi-valued field."""
    parsed = F.when(F.ltrim(value).startswith("["), F.from_json(value, "array<string>"))
    return F.coalesce(F.filter(parsed, has_value), F.array(value))


def field_kind(name: Column) -> Column:
    """``description``, ``annotations`` or ``external_links``: sources differ in quality from one to the next."""
    return F.substring_index(name, ".", 1)


def source_names(sources: DataFrame) -> list[tuple[str, int]]:
    """``(source, trust_rank)`` in order of rank and name; the place is the source's bit."""
    rows = sources.where("source IS NOT NULL").select("source", "trust_rank").distinct().limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    return sorted(((r["source"], r["trust_rank"]) for r in rows), key=lambda x: (x[1] is None, x[1], x[0]))


def _values(genes: DataFrame, sources: DataFrame, names: list[tuple[str, int]]) -> DataFrame:
    """``(gene_key, field_name, kind, atom, claimed, covered, multi, best)``: each value with bitmaps of the sources that claim it, and the field.

    ``multi`` tells whether a field of that name holds arrays anywhere,
    ``best`` is the most trusted claim.  A key's hot field is folded on the
    map side to one row per value.
    """
    bits = F.create_map(*[F.lit(x) for i, (n, _) in enumerate(names) for x in (n, 1 << i)]) if names else F.create_map(F.lit(""), F.lit(1))
    rank = F.struct((-F.coalesce(F.col("trust_rank"), F.lit(2**31 - 1))).alias("r"), F.col("date_added").alias("d"), F.col("id").alias("id"))
    each = claims(genes, sources).where(F.col("field_name").isNotNull())
    bit = F.coalesce(F.element_at(bits, F.col("source_name")), F.lit(1 << len(names)))
    each = each.select("gene_key", "field_name", bit.alias("_bit"), rank.alias("_rank"), F.ltrim("value").startswith("[").alias("_array"), F.explode(_atoms(F.col("value"))).alias("atom"))
    values = each.groupBy("gene_key", "field_name", "atom").agg(F.bit_or("_bit").alias("claimed"), F.max("_rank").alias("best"), F.max("_array").alias("_array"))
    fields = values.groupBy("gene_key", "field_name").agg(F.bit_or("claimed").alias("covered"))
    arrays = values.groupBy("field_name").agg(F.max("_array").alias("multi"))
    return values.drop("_array").join(fields, ["gene_key", "field_name"]).join(arrays, "field_name").withColumn("kind", field_kind(F.col("field_name")))


def _families(values: DataFrame) -> DataFrame:
    """``(kind, multi, covered, masks, counts, n)``: the distinct sets of claims that a field with two sources or more gets, and how many fields get it.

    Of a multi-valued field each value is a set of its own.  A set lists its
    distinct bitmaps, of which there are fewer than 2 to the number of
    sources however many values a field has; that of a single-valued field
    also holds the bitmap 0, of the value that nobody claims.
    """
    shared = values.where(F.bit_count("covered") >= 2)
    several = shared.where("multi").groupBy("kind", "multi", "covered", F.array("claimed").alias("masks"), F.array(F.lit(1).cast("bigint")).alias("counts")).agg(F.count("*").alias("n"))
    per = shared.where("NOT multi").groupBy("gene_key", "field_name", "kind", "multi", "covered", "claimed").agg(F.count("*").alias("_c"))
    per = per.groupBy("gene_key", "field_name", "kind", "multi", "covered").agg(F.array_sort(F.collect_list(F.struct("claimed", "_c"))).alias("_s"))
    single = per.groupBy("kind", "multi", "covered", F.concat(F.transform("_s", lambda x: x["claimed"]), F.array(F.lit(0))).alias("masks"), F.concat(F.transform("_s", lambda x: x["_c"]), F.array(F.lit(1).cast("bigint"))).alias("counts")).agg(F.count("*").alias("n"))
    return several.unionByName(single)


def claim_weights(masks: np.ndarray, covered: np.ndarray, sens: np.ndarray, spec: np.ndarray) -> np.ndarray:
    """Log-likelihood of the claims if the value is true, less that if it is false."""
    bits = 1 << np.arange(len(sens))
    says, covers = (masks[:, None] & bits) > 0, (covered[:, None] & bits) > 0
    return np.where(covers, np.where(says, np.log(sens) - np.log1p(-spec), np.log1p(-sens) - np.log(spec)), 0.0).sum(1)


def posteriors(multi: np.ndarray, covered: np.ndarray, masks: list, counts: list, quality: tuple[np.ndarray, np.ndarray, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(family, mask, posterior)`` of each bitmap of each family: one value of a single-valued field is true, maybe one that nobody claims; values of others are judged each by itself."""
    sens, spec, prior = quality
    size = np.array([len(m) for m in masks])
    at = np.repeat(np.arange(len(size)), size)
    mask, count = np.concatenate(masks).astype(np.int64), np.concatenate(counts)
    w = claim_weights(mask, covered[at], sens, spec)
    alone = 1 / (1 + np.exp(np.clip(-w - np.log(prior) + np.log1p(-prior), -500, 500)))
    top = np.full(len(size), -np.inf)
    np.maximum.at(top, at, w)
    e = np.exp(w - top[at])
    total = np.bincount(at, e * count, len(size))
    return at, mask, np.where(multi[at], alone, e / total[at])


def fit_sources(families: DataFrame, n_sources: int, rounds: int = EM_ROUNDS, tolerance: float = 1e-4) -> dict[str, tuple[np.ndarray, np.ndarray, float]]:
    """Sensitivity and specificity of each source, and the prior of truth, for each kind of field.

    A round is one pass over the distinct families where they lie; only sums
    per kind and source come to the driver.
    """
    bits = 1 << np.arange(n_sources)
    start = lambda: (np.full(n_sources, 0.8), np.full(n_sources, 0.9), 0.5)
    quality: dict[str, tuple[np.ndarray, np.ndarray, float]] = {}

    def step(batches):
        for g in batches:
            for kind, part in g.groupby("kind"):
                multi, covered, n = part["multi"].to_numpy(bool), part["covered"].to_numpy(np.int64), part["n"].to_numpy(float)
                counts = part["counts"].tolist()
                at, mask, post = posteriors(multi, covered, part["masks"].tolist(), counts, quality.get(kind, start()))
                weight = n[at] * np.concatenate(counts)
                says, covers = (mask[:, None] & bits) > 0, (covered[at][:, None] & bits) > 0
                wt, wf, own = weight * post, weight * (1 - post), multi[at]
                yield pd.DataFrame({
                    "kind": kind, "source": np.arange(n_sources), "said": (wt[:, None] * (says & covers)).sum(0), "true": (wt[:, None] * covers).sum(0),
                    "silent": (wf[:, None] * (~says & covers)).sum(0), "false": (wf[:, None] * covers).sum(0), "own": (wt * own).sum(), "all": (weight * own).sum()})

    sums = ["said", "true", "silent", "false", "own", "all"]
    for _ in range(rounds):
        found = families.mapInPandas(step, "kind string, source int, " + ", ".join(f"`{c}` double" for c in sums))
        table = found.groupBy("kind", "source").agg(*[F.sum(c).alias(c) for c in sums]).toPandas().sort_values(["kind", "source"])  # kinds times sources
        moved, fresh = 0.0, {}
        for kind, part in table.groupby("kind"):
            said, true, silent, false, own, every = (part[c].to_numpy() for c in sums)
            sens = (SENSITIVITY[0] + said) / (sum(SENSITIVITY) + true)
            spec = (SPECIFICITY[0] + silent) / (sum(SPECIFICITY) + false)
            fresh[kind] = (sens, spec, float((TRUTH[0] + own[0]) / (sum(TRUTH) + every[0])))
            before = quality.get(kind, start())
            moved = max(moved, np.abs(sens - before[0]).max(), np.abs(spec - before[1]).max())
        quality = fresh
        if moved < tolerance:
            break
    return quality


def _judged(values: DataFrame, quality: dict[str, tuple[np.ndarray, np.ndarray, float]], n_sources: int) -> DataFrame:
    """``values`` with the posterior of each, by built-in expressions."""
    prior = {k: float(np.log(q[2]) - np.log1p(-q[2])) for k, q in quality.items()}
    bit = lambda c, i: F.col(c).bitwiseAND(F.lit(1 << i)) != 0
    weight, nobody, odds = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for kind, (sens, spec, _) in sorted(quality.items()):
        w = w0 = F.lit(0.0)
        for i in range(n_sources):
            yes, no = float(np.log(sens[i]) - np.log1p(-spec[i])), float(np.log1p(-sens[i]) - np.log(spec[i]))
            w = w + F.when(bit("claimed", i), F.lit(yes)).when(bit("covered", i), F.lit(no)).otherwise(0.0)
            w0 = w0 + F.when(bit("covered", i), F.lit(no)).otherwise(0.0)
        nobody = F.when(F.col("kind") == kind, w0).otherwise(nobody)
        weight, odds = F.when(F.col("kind") == kind, w).otherwise(weight), F.when(F.col("kind") == kind, F.lit(prior[kind])).otherwise(odds)
    weighed = values.withColumn("_w", weight).withColumn("_w0", nobody)
    total = weighed.where("NOT multi").groupBy("gene_key", "field_name").agg((F.sum(F.exp("_w")) + F.exp(F.max("_w0"))).alias("_z"))
    joined = weighed.join(total, ["gene_key", "field_name"], "left")
    return joined.withColumn("posterior", F.when(F.col("multi"), 1 / (1 + F.exp(-F.col("_w") - odds))).otherwise(F.exp("_w") / F.col("_z"))).drop("_w", "_w0", "_z")


def _fit(genes: DataFrame, sources: DataFrame) -> tuple[DataFrame, dict, list]:
    names = source_names(sources)
    values = checkpoint(_values(genes, sources, names))  # read by the fit and by the judgement
    return values, fit_sources(checkpoint(_families(values)), len(names) + 1), names


def latent_truth(genes: DataFrame, sources: DataFrame, least: float = 0.5) -> DataFrame:
    """``(gene_key, field_name, value, posterior, multi, accepted)``: every value of every field with the probability that it is true.

    Of a field that holds arrays anywhere every value with ``least`` or more
    is accepted, of another the likeliest one; ties go to the most trusted
    claim, then the latest, then the highest id.  Sources that aren't listed
    count as one source.  Qualities are fitted on fields with two sources or
    more; without such a field the priors stand.
    """
    values, quality, names = _fit(genes, sources)
    judged = _judged(values, quality, len(names) + 1)
    order = F.struct(F.round("posterior", 9).alias("p"), F.col("best"), F.col("atom"))
    first = judged.where("NOT multi").groupBy("gene_key", "field_name").agg(F.max(order)["atom"].alias("_first"))
    joined = judged.join(first, ["gene_key", "field_name"], "left")
    accepted = F.when(F.col("multi"), F.col("posterior") >= least).otherwise(F.col("atom") == F.col("_first"))
    return joined.select("gene_key", "field_name", F.col("atom").alias("value"), "posterior", "multi", accepted.alias("accepted"))


def golden_records(genes: DataFrame, sources: DataFrame) -> DataFrame:
    """The record built for each key with two or more rows from the values judged true: ``description``, ``annotations`` and ``external_links`` maps.

    A multi-valued field is the JSON array of its true values in order; a
    field without a value judged true is absent, a key without any is not.
    """
    kept = latent_truth(genes, sources).where("accepted").groupBy("gene_key", "field_name", "multi").agg(F.array_sort(F.collect_set("value")).alias("_v"))
    fields = kept.select("gene_key", "field_name", F.when(F.col("multi"), F.to_json("_v")).otherwise(F.col("_v")[0]).alias("v"))

    def pick(prefix: str) -> Column:
        # a key has as many entries here as there are field names
        entry = F.when(F.col("field_name").startswith(prefix), F.struct(F.substring("field_name", len(prefix) + 1, 1 << 30).alias("k"), "v"))
        return F.map_from_entries(F.array_sort(F.collect_list(entry)))

    found = fields.groupBy("gene_key").agg(
        F.max(F.when(F.col("field_name") == "description", F.col("v"))).alias("description"), pick("annotations.").alias("annotations"), pick("external_links.").alias("external_links"))
    return _rows_per_key(genes).join(found, "gene_key", "left")


def source_quality(genes: DataFrame, sources: DataFrame) -> DataFrame:
    """``(kind, source, trust_rank, sensitivity, specificity)`` as inferred, to hold against the declared trust."""
    values, quality, names = _fit(genes, sources)
    every = [*names, ("(not listed)", None)]
    rows = [(kind, n, r, float(sens[i]), float(spec[i])) for kind, (sens, spec, _) in sorted(quality.items()) for i, (n, r) in enumerate(every)]
    return values.sparkSession.createDataFrame(rows, "kind string, source string, trust_rank int, sensitivity double, specificity double")


def agreement(genes: DataFrame, sources: DataFrame) -> DataFrame:
    """``(kind, n_fields, n_contested, n_same, n_same_contested)``: how often the values judged true are those of the row that survives by declared trust.

    A field is contested when its claims hold more than one value.
    """
    truth = latent_truth(genes, sources).groupBy("gene_key", "field_name").agg(
        F.array_sort(F.collect_set(F.when(F.col("accepted"), F.col("value")))).alias("_true"), F.count("*").alias("_n"))
    won = survivors(genes, sources).join(claims(genes, sources).select("gene_key", "field_name", "id", F.array_sort(F.array_distinct(_atoms(F.col("value")))).alias("_won")), ["gene_key", "field_name", "id"])
    both = won.join(truth, ["gene_key", "field_name"])
    same, contested = F.col("_won") == F.col("_true"), F.col("_n") > 1
    return both.groupBy(field_kind(F.col("field_name")).alias("kind")).agg(
        F.count("*").alias("n_fields"), F.count_if(contested).alias("n_contested"), F.count_if(same).alias("n_same"), F.count_if(same & contested).alias("n_same_contested"))
