"""Further queries of the catalogue: caps, lookups, unions, tables for people, signs of mutation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixspark.functions import jsonx, seq
from helixspark.functions.keys import norm_key
from helixspark.operators import search
from helixspark.plans import similarity
from helixspark.plans.base import SQL_DNA, SQL_KEY, SQL_LETTERS, dna, key, letters, spread_dna, sql_count
from helixspark.tables import table


def first_long(spark: SparkSession, d: str) -> DataFrame:
    """FLT-06: the first twenty sequences of twenty letters at least; the limit is the feature."""
    return letters(spark, d).where(F.length("s") >= 20).orderBy("id").limit(20).select("id", F.length("s").cast("bigint").alias("n"))


def category_rows(spark: SparkSession, d: str) -> DataFrame:
    """FLT-19, JON-13: rows of the canonical organisms of one category."""
    species = table(spark, d, "species").where("category = 'cereal'").select(F.col("name").alias("organism"), "taxonomy_id")
    return table(spark, d, "genes").select("id", "organism").join(species, "organism").select("id", "taxonomy_id")


def capped(spark: SparkSession, d: str) -> DataFrame:
    """FLT-15: what may be done with a sequence of its length; a status, never an error."""
    n = F.length("s")
    return letters(spark, d).select("id", F.when(n > 1_000_000, "too long").when(n > 5000, "no alignment").otherwise("ok").alias("status"))


def start_stop(spark: SparkSession, d: str) -> DataFrame:
    """SEQ-03, SEQ-05."""
    s = F.col("s")
    return dna(spark, d).select("id", seq.has_start(s).alias("has_start"), seq.has_stop(s).alias("has_stop"), seq.gc3(s).alias("gc3"))


def mutated(spark: SparkSession, d: str) -> DataFrame:
    """SEQ-18: each base replaced with a chance of 5 percent, by a hash of id and place, so repeatable anywhere."""
    bases = F.posexplode(F.split("s", ""))
    each = spread_dna(spark, d).select("id", bases.alias("at", "base"))
    h = F.pmod(F.xxhash64("id", "at", F.lit(42)), F.lit(2000))
    # one of the three other bases: one to three places further on
    other = F.substring(F.lit("ACGT"), (F.pmod(F.position("base", F.lit("ACGT")) + h % 3, F.lit(4)) + 1).cast("int"), F.lit(1))
    new = F.when((h < 100) & F.col("base").isin("A", "C", "G", "T"), other).otherwise(F.col("base"))
    changed = each.withColumn("new", new)
    return changed.groupBy("id").agg(F.count("*").alias("n"), F.count_if(F.col("new") != F.col("base")).alias("n_changed"))


def name_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Likeness of the names of canonical organisms of one category, both ways round; the list is fixed and small."""
    s = table(spark, d, "species").select("species_id", "name", "category")
    a, b = s.alias("a"), s.alias("b")
    half = a.join(b, (F.col("a.category") == F.col("b.category")) & (F.col("a.species_id") < F.col("b.species_id")))
    edits = F.levenshtein("a.name", "b.name")
    pairs = half.select(F.col("a.species_id").alias("i"), F.col("b.species_id").alias("j"), (1 - edits / F.greatest(F.length("a.name"), F.length("b.name"))).alias("likeness"))
    return pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "likeness"))


def with_loads(spark: SparkSession, d: str) -> DataFrame:
    """JON-10: rows with the feed that delivered them; rows of unknown loads stay."""
    loads = table(spark, d, "loads").select("load_id", "feed", "load_seq")
    return table(spark, d, "genes").select("id", "load_id").join(loads, "load_id", "left").select("id", "feed", "load_seq")


def merged_traits(spark: SparkSession, d: str) -> DataFrame:
    """SET-06: the distinct traits of each gene; traits are made distinct before they are gathered, so a hot key gathers only its vocabulary."""
    each = table(spark, d, "genes").select(key().alias("gene_key"), F.explode("traits").alias("trait")).where(F.col("gene_key").isNotNull() & F.col("trait").isNotNull()).distinct()
    return each.groupBy("gene_key").agg(F.array_join(F.array_sort(F.collect_list("trait")), "|").alias("traits"))


def new_keys(spark: SparkSession, d: str) -> DataFrame:
    """SET-07: assemblies whose key is neither gene id nor symbol of any gene, so may be added."""
    genes = table(spark, d, "genes")
    known = genes.select(norm_key(F.col("gene_id")).alias("gene_key")).unionByName(genes.select(norm_key(F.col("symbol")).alias("gene_key")))
    return table(spark, d, "assemblies").select(norm_key(F.col("gene_key")).alias("gene_key")).where(F.col("gene_key").isNotNull()).join(known, "gene_key", "left_anti")


def first_variants(spark: SparkSession, d: str) -> DataFrame:
    """SRT-09: the first fifty substitutions of each pair, for display."""
    rows = similarity.variant_report(spark, d)
    rank = F.row_number().over(Window.partitionBy("pair").orderBy("r_pos", "q_pos"))
    return rows.withColumn("rank", rank.cast("bigint")).where("rank <= 50")


def hit_table(spark: SparkSession, d: str) -> DataFrame:
    """SIM-10, INT-05: three best hits of each query sequence as short texts with their level."""
    rows = table(spark, d, "search_hits").select("hit_id", "query_seq", "gene_name", "organism", "identity_percent")
    rank = F.row_number().over(Window.partitionBy("query_seq").orderBy(F.desc_nulls_last("identity_percent"), "hit_id"))
    top = rows.withColumn("rank", rank.cast("bigint")).where("rank <= 3")
    short = lambda c, n: F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(F.col(c))
    return top.select("hit_id", "rank", short("gene_name", 20).alias("gene"), short("organism", 18).alias("organism"), seq.similarity_class(F.col("identity_percent")).alias("level"))


def nearest_lengths(spark: SparkSession, d: str) -> DataFrame:
    """SIM-04: for each query the ten genes nearest in length, where nothing but metadata is at hand."""
    genes = dna(spark, d).select("id", F.length("s").cast("bigint").alias("n"))
    return search.nearest_lengths(genes.where(F.col("id") % similarity.EVERY == 0), genes, 10)


def bundle_fix(spark: SparkSession, d: str) -> DataFrame:
    """SNK-18: literature and dataset bundles that were stored as DNA lose that type and their letters."""
    kind = F.get_json_object(jsonx.unquoted(F.col("annotations")), "$.record_type")
    bundle = F.coalesce(kind.isin("publication_bundle", "dataset_aggregate"), F.lit(False))
    rows = table(spark, d, "genes").select("id", "sequence_type", "sequence", bundle.alias("bundle"))
    return rows.select("id", F.when(F.col("bundle"), "").otherwise(F.col("sequence_type")).alias("sequence_type"), F.when(F.col("bundle"), 0).otherwise(F.coalesce(F.length("sequence"), F.lit(0))).cast("bigint").alias("n"))


def mutation_profile(spark: SparkSession, d: str) -> DataFrame:
    """INT-06: rate and kind of the substitutions of each aligned pair: high from 10 percent, low below 2, transitions prevailing from 65."""
    rows = similarity.variant_report(spark, d).groupBy("pair").agg(F.count("*").alias("n"), F.count_if(F.col("class") == "transition").alias("transitions"))
    genes = dna(spark, d).select(F.col("id").alias("pair"), F.length("s").alias("_n"))
    rate = 100 * F.col("n") / F.col("_n")
    level = F.when(rate >= 10, "high").when(rate >= 2, "moderate").otherwise("low")
    return rows.join(genes, "pair").select("pair", "n", "transitions", level.alias("level"), (F.col("transitions") >= 0.65 * F.col("n")).alias("transition_bias"))


QUERIES = {f.__name__: f for f in (
    first_long, category_rows, capped, start_stop, mutated, name_matrix, with_loads, merged_traits, new_keys, first_variants, hit_table, nearest_lengths, bundle_fix, mutation_profile)}

_ANNOTATIONS = "CASE WHEN ltrim(annotations) LIKE '\"%' THEN json_extract_string(annotations, '$') ELSE annotations END"

ORACLE = {
    "first_long": f"SELECT id, length(s) AS n FROM {SQL_LETTERS} WHERE length(s) >= 20 ORDER BY id LIMIT 20",
    "category_rows": "SELECT g.id, s.taxonomy_id FROM genes g JOIN species s ON s.name = g.organism WHERE s.category = 'cereal'",
    "capped": f"SELECT id, CASE WHEN length(s) > 1000000 THEN 'too long' WHEN length(s) > 5000 THEN 'no alignment' ELSE 'ok' END AS status FROM {SQL_LETTERS}",
    "start_stop": f"""
SELECT id, contains(s, 'ATG') OR contains(s, 'CAT') AS has_start, regexp_matches(s, 'TAA|TAG|TGA|TTA|CTA|TCA') AS has_stop,
 CASE WHEN length(s) >= 3 THEN {sql_count('GC', "regexp_replace(s, '..(.)|..?$', '\\1', 'g')")} / (length(s) // 3) END AS gc3 FROM {SQL_DNA}""",
    "name_matrix": """
WITH p AS (SELECT a.species_id AS i, b.species_id AS j, 1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)) AS likeness
 FROM species a JOIN species b ON a.category = b.category AND a.species_id < b.species_id) SELECT i, j, likeness FROM p UNION ALL SELECT j, i, likeness FROM p""",
    "with_loads": "SELECT g.id, l.feed, l.load_seq FROM genes g LEFT JOIN loads l USING (load_id)",
    "merged_traits": f"SELECT gene_key, string_agg(trait, '|' ORDER BY trait) AS traits FROM (SELECT DISTINCT {SQL_KEY} AS gene_key, unnest(traits) AS trait FROM genes) WHERE gene_key IS NOT NULL AND trait IS NOT NULL GROUP BY gene_key",
    "new_keys": "SELECT upper(trim(gene_key)) AS gene_key FROM assemblies WHERE upper(trim(gene_key)) NOT IN (SELECT upper(trim(gene_id)) FROM genes WHERE gene_id IS NOT NULL UNION SELECT upper(trim(symbol)) FROM genes WHERE symbol IS NOT NULL)",
    "hit_table": """
SELECT hit_id, rank, CASE WHEN length(gene_name) > 20 THEN substring(gene_name, 1, 20) || '...' ELSE gene_name END AS gene, CASE WHEN length(organism) > 18 THEN substring(organism, 1, 18) || '...' ELSE organism END AS organism,
 CASE WHEN identity_percent >= 90 THEN 'very_high' WHEN identity_percent >= 75 THEN 'high' WHEN identity_percent >= 55 THEN 'moderate' WHEN identity_percent >= 35 THEN 'low' WHEN identity_percent IS NOT NULL THEN 'very_low' END AS level
FROM (SELECT *, row_number() OVER (PARTITION BY query_seq ORDER BY identity_percent DESC NULLS LAST, hit_id) AS rank FROM search_hits) WHERE rank <= 3""",
    "nearest_lengths": f"""
WITH g AS (SELECT id, length(s) AS n FROM {SQL_DNA}), p AS (SELECT q.id AS query, g.id AS id, abs(g.n - q.n) AS gap FROM g q JOIN g ON g.id <> q.id AND greatest(g.n, q.n) <= 3 * least(g.n, q.n) WHERE q.id % {similarity.EVERY} = 0)
SELECT query, rank, id, gap FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY gap, id) AS rank FROM p) WHERE rank <= 10""",
    "bundle_fix": f"""
SELECT id, CASE WHEN b THEN '' ELSE sequence_type END AS sequence_type, CASE WHEN b THEN 0 ELSE coalesce(length(sequence), 0) END AS n
FROM (SELECT *, coalesce(json_extract_string({_ANNOTATIONS}, '$.record_type') IN ('publication_bundle', 'dataset_aggregate'), false) AS b FROM genes)""",
}
