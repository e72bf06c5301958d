"""Queries on the catalogue: lookups, merges, deduplication, counts, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixspark.functions import seq
from helixspark.functions.keys import norm_key
from helixspark.operators import catalogue as ops
from helixspark.plans.base import SQL_KEY, key
from helixspark.tables import table


def genes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "genes")


def metadata_scan(spark: SparkSession, d: str) -> DataFrame:
    """SRC-05, SRC-06: a scan that reads no sequence."""
    return genes(spark, d).select("id", "gene_id", "symbol", "organism", "sequence_type", "length", "source")


def key_lookup(spark: SparkSession, d: str) -> DataFrame:
    """SRC-07, JON-04: the rows of the genes that were retired; a semi-join on normalised keys."""
    wanted = table(spark, d, "retired_genes").select(norm_key(F.col("gene_key")).alias("gene_key")).distinct()
    return genes(spark, d).select("id", key().alias("gene_key")).join(wanted, "gene_key", "left_semi")


def resume(spark: SparkSession, d: str) -> DataFrame:
    """SRC-23, JON-08: keys of the catalogue that no search has hit yet; an anti-join."""
    done = table(spark, d, "search_hits").select(norm_key(F.col("gene_key")).alias("gene_key"))
    return genes(spark, d).select(key().alias("gene_key")).where(F.col("gene_key").isNotNull()).distinct().join(done, "gene_key", "left_anti")


def random_sample(spark: SparkSession, d: str) -> DataFrame:
    """SRC-25: a repeatable sample of 50 keys, by a hash of the key."""
    keys = genes(spark, d).select(key().alias("gene_key")).where(F.col("gene_key").isNotNull()).distinct()
    return keys.orderBy(F.md5("gene_key"), "gene_key").limit(50)


def length_between(spark: SparkSession, d: str) -> DataFrame:
    """FLT-07, FLT-08: pushed down to the scan."""
    return genes(spark, d).where(F.col("length").between(200, 600)).select("id", "length")


def metadata_search(spark: SparkSession, d: str) -> DataFrame:
    """FLT-09, SRT-06: words in any of the describing columns, second page of 50 by id."""
    hit = F.col("gene_id").ilike("%kinase%") | F.col("symbol").ilike("%kinase%") | F.col("description").ilike("%kinase%") | F.col("source").ilike("%kinase%") | F.array_join("traits", ",").ilike("%kinase%")
    return genes(spark, d).where(hit).select("id", "symbol", "description").orderBy("id").offset(50).limit(50)


def pseudo_records(spark: SparkSession, d: str) -> DataFrame:
    """FLT-13: literature and dataset bundles."""
    from helixspark.functions import jsonx

    kind = F.get_json_object(jsonx.unquoted(F.col("annotations")), "$.record_type")
    return genes(spark, d).select("id", kind.alias("record_type")).where(F.col("record_type").isNotNull())


def organism_filter(spark: SparkSession, d: str) -> DataFrame:
    """FLT-11: rows of canonical organisms, whatever their case; a broadcast-sized dimension joined by equality."""
    names = table(spark, d, "species").select(F.lower("name").alias("name"), "category")
    return genes(spark, d).select("id", F.lower(F.trim("organism")).alias("name")).join(names, "name").select("id", "category")


def header_checks(spark: SparkSession, d: str) -> DataFrame:
    """FLT-14 (length): rows whose stated length isn't that of their sequence."""
    n = F.length(F.regexp_replace("sequence", r"\s+", "")).cast("bigint")
    return genes(spark, d).select("id", F.col("length").alias("stated"), n.alias("counted")).where(F.coalesce("counted", F.lit(0)) != F.coalesce("stated", F.lit(0)))


def schema_faults(spark: SparkSession, d: str) -> DataFrame:
    """FLT-17."""
    rows = genes(spark, d)
    return rows.select("id", ops.faults(rows).alias("fault")).where(F.col("fault").isNotNull())


def report_rows(spark: SparkSession, d: str) -> DataFrame:
    """FLT-16, FLT-18: one line per record with a preview of the sequence."""
    preview = F.when(F.length("sequence") > 30, F.concat(F.substring("sequence", 1, 30), F.lit("..."))).otherwise(F.col("sequence"))
    return genes(spark, d).select("id", seq.display_name(F.col("symbol")).alias("name"), preview.alias("preview"), F.length("sequence").cast("bigint").alias("n"))


def normalised(spark: SparkSession, d: str) -> DataFrame:
    """FLT-05."""
    rows = ops.normalise(genes(spark, d))
    return rows.select("id", "gene_id", "symbol", "organism", "sequence_type", "length", "source", F.col("external_links")["source_api"].alias("source_api"), F.size("external_links").cast("bigint").alias("n_links"))


def dedup_first_wins(spark: SparkSession, d: str) -> DataFrame:
    """WIN-08: the first row delivered of each key."""
    rows = genes(spark, d).select("id", key().alias("gene_key"), "date_added").where(F.col("gene_key").isNotNull())
    return ops.first_of(rows, ["gene_key"], [F.asc_nulls_last("date_added"), "id"]).select("gene_key", "id")


def priority_union(spark: SparkSession, d: str) -> DataFrame:
    """SET-01, SET-02: keys of the catalogue, of the assemblies and of the retired, the first table that knows a key naming its organism."""
    a = genes(spark, d).select(key().alias("gene_key"), "organism", F.lit("genes").alias("origin"), "id")
    b = table(spark, d, "assemblies").select(norm_key(F.col("gene_key")).alias("gene_key"), "organism", F.lit("assemblies").alias("origin"))
    c = table(spark, d, "retired_genes").select(norm_key(F.col("gene_key")).alias("gene_key"), F.lit("retired_genes").alias("origin"))
    return ops.priority_union([a, b, c], ["gene_key"], [F.asc_nulls_last("id")]).select("gene_key", "organism", "origin")


def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    """SNK-08, MRG-01: of each key the latest delivery merged over the earliest."""
    columns = ["gene_id", "symbol", "organism", "sequence", "sequence_type", "description", "source", "source_url", "external_links", "traits", "length"]
    rows = genes(spark, d).select("id", key().alias("gene_key"), *columns).where(F.col("gene_key").isNotNull())
    old = ops.first_of(rows, ["gene_key"], ["id"]).drop("id")
    new = ops.first_of(rows, ["gene_key"], [F.desc("id")]).drop("id")
    merged = ops.upsert(old, new, "gene_key")
    return merged.select("gene_key", "organism", F.md5(F.coalesce("sequence", F.lit(""))).alias("sequence_md5"), "sequence_type", "description", "source", "source_url", "length", F.size("traits").cast("bigint").alias("n_traits"), F.size("external_links").cast("bigint").alias("n_links"))


def fill_missing(spark: SparkSession, d: str) -> DataFrame:
    """SET-04: sequence type of each key from any delivery that states one, the earliest first."""
    rows = genes(spark, d).select("id", key().alias("gene_key"), F.nullif(F.lower(F.trim("sequence_type")), F.lit("")).alias("t")).where(F.col("gene_key").isNotNull())
    return rows.groupBy("gene_key").agg(F.min_by("t", F.when(F.col("t").isNotNull(), F.col("id"))).alias("sequence_type"))


def attach_hits(spark: SparkSession, d: str) -> DataFrame:
    """JON-11: searches attached to genes where gene id or symbol is the key of the hit."""
    hits = table(spark, d, "search_hits").groupBy(norm_key(F.col("gene_key")).alias("k")).agg(F.count("*").alias("n_hits"))
    rows = genes(spark, d).select("id", norm_key(F.col("gene_id")).alias("g"), norm_key(F.col("symbol")).alias("s"))
    return ops.attach(rows, [F.col("g"), F.col("s")], hits, [F.col("k")], ["n_hits"]).groupBy("id").agg(F.sum("n_hits").cast("bigint").alias("n_hits"))


def plan_audit(spark: SparkSession, d: str) -> DataFrame:
    """JON-09, SET-05, SNK-15: canonical organisms against those delivered."""
    planned = table(spark, d, "species").select(F.lower("name").alias("organism"))
    done = genes(spark, d).select(F.lower(F.trim("organism")).alias("organism")).where(F.col("organism") != "")
    return ops.audit(planned, done, "organism")


def catalogue_stats(spark: SparkSession, d: str) -> DataFrame:
    """AGG-01, AGG-02, AGG-03: counts per type, per source and in all."""
    rows = genes(spark, d).select(F.lower(F.trim("sequence_type")).alias("kind"), F.lower(F.trim("source")).alias("source"), "organism")
    sets = [[], [F.col("kind")], [F.col("source")]]
    each = rows.groupingSets(sets, F.col("kind"), F.col("source")).agg(F.grouping_id().cast("bigint").alias("level"), F.count("*").alias("n"), F.countDistinct("organism").alias("n_organisms"))
    return each.select("kind", "source", "level", "n", "n_organisms")


def type_counts(spark: SparkSession, d: str) -> DataFrame:
    """AGG-02."""
    rows = genes(spark, d).select(seq.detect_type(F.col("sequence")).alias("kind"), F.length("sequence").alias("n"))
    return rows.groupBy("kind").agg(F.count("*").alias("n_records"), F.sum("n").cast("bigint").alias("n_letters"), F.max("n").cast("bigint").alias("longest"))


def file_metadata(spark: SparkSession, d: str) -> DataFrame:
    """AGG-13, AGG-15: records, organisms and mean completeness."""
    score = ops.completeness([F.col("gene_id"), F.col("symbol"), F.col("organism"), F.col("sequence"), F.col("description")])
    rows = genes(spark, d).select(score.alias("score"), "organism")
    return rows.agg(F.count("*").alias("n"), F.countDistinct("organism").alias("n_organisms"), F.sum(F.round(F.col("score") * 5).cast("bigint")).alias("fields_filled"), F.count_if(F.col("score") == 1).alias("n_complete"))


def load_status(spark: SparkSession, d: str) -> DataFrame:
    """AGG-12: loads by what arrived of what was announced."""
    arrived = genes(spark, d).groupBy("load_id").agg(F.count("*").alias("n"))
    rows = table(spark, d, "loads").join(arrived, "load_id", "left")
    n = F.coalesce("n", F.lit(0))
    status = F.when(n == 0, "failed").when(n < F.col("n_records"), "partial").otherwise("ok")
    return rows.groupBy("source", status.alias("status")).agg(F.count("*").alias("n_loads"), F.sum(n).cast("bigint").alias("n_records"))


def best_hit(spark: SparkSession, d: str) -> DataFrame:
    """SRT-07, WIN-07: the three best hits of each query sequence."""
    rows = table(spark, d, "search_hits").select("hit_id", "query_seq", "gene_key", "identity_percent")
    rank = F.row_number().over(Window.partitionBy("query_seq").orderBy(F.desc_nulls_last("identity_percent"), "hit_id"))
    return rows.withColumn("rank", rank.cast("bigint")).where("rank <= 3").select("hit_id", "rank", "identity_percent")


def hit_scores(spark: SparkSession, d: str) -> DataFrame:
    """SIM-05, SIM-08, SIM-09, INT-11: class and confidence of every recorded hit."""
    from helixspark.functions import pairs

    rows = table(spark, d, "search_hits").select("hit_id", "identity_percent", "aligned_length", "gaps", "coverage_percent")
    gap = F.when(F.col("aligned_length") > 0, 100 * F.col("gaps") / F.col("aligned_length")).otherwise(0.0)
    score = pairs.confidence(F.col("coverage_percent"), gap, F.col("identity_percent"))
    return rows.select("hit_id", seq.similarity_class(F.col("identity_percent")).alias("class"), seq.confidence_label(F.col("identity_percent")).alias("label"), F.round(score, 6).alias("confidence"))


QUERIES = {f.__name__: f for f in (
    metadata_scan, key_lookup, resume, random_sample, length_between, metadata_search, pseudo_records, organism_filter, header_checks, schema_faults, report_rows,
    normalised, dedup_first_wins, priority_union, upsert_merge, fill_missing, attach_hits, plan_audit, catalogue_stats, type_counts, file_metadata, load_status,
    best_hit, hit_scores)}

_NORM = "nullif(upper(trim(gene_key)), '')"
_BARE = r"regexp_replace(sequence, '\s+', '', 'g')"
_DETECT = r"""(CASE WHEN c = '' THEN 'unknown' WHEN regexp_full_match(c, '[ATGCN]+') THEN 'dna' WHEN regexp_full_match(c, '[ACDEFGHIKLMNPQRSTVWYBXZ*]+') THEN 'protein'
 WHEN regexp_matches(c, '[BJOUXZ*]') THEN 'protein' WHEN c IS NOT NULL THEN 'dna' END)"""
_ANNOTATIONS = "CASE WHEN ltrim(annotations) LIKE '\"%' THEN json_extract_string(annotations, '$') ELSE annotations END"
_TYPES = "CASE lower(trim(sequence_type)) WHEN 'mrna' THEN 'rna' WHEN 'trna' THEN 'rna' WHEN 'rrna' THEN 'rna' WHEN 'transcript' THEN 'rna' WHEN 'genomic' THEN 'dna' WHEN 'aa' THEN 'protein' ELSE lower(trim(sequence_type)) END"

ORACLE = {
    "metadata_scan": "SELECT id, gene_id, symbol, organism, sequence_type, length, source FROM genes",
    "key_lookup": f"SELECT id, {SQL_KEY} AS gene_key FROM genes WHERE {SQL_KEY} IN (SELECT {_NORM} FROM retired_genes WHERE gene_key IS NOT NULL)",
    "resume": f"SELECT DISTINCT {SQL_KEY} AS gene_key FROM genes g WHERE {SQL_KEY} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM search_hits h WHERE nullif(upper(trim(h.gene_key)), '') = coalesce(nullif(upper(trim(g.gene_id)), ''), nullif(upper(trim(g.symbol)), '')))",
    "random_sample": f"SELECT gene_key FROM (SELECT DISTINCT {SQL_KEY} AS gene_key FROM genes) WHERE gene_key IS NOT NULL ORDER BY md5(gene_key), gene_key LIMIT 50",
    "length_between": "SELECT id, length FROM genes WHERE length BETWEEN 200 AND 600",
    "metadata_search": """
SELECT id, symbol, description FROM genes WHERE gene_id ILIKE '%kinase%' OR symbol ILIKE '%kinase%' OR description ILIKE '%kinase%' OR source ILIKE '%kinase%'
 OR array_to_string(traits, ',') ILIKE '%kinase%' ORDER BY id LIMIT 50 OFFSET 50""",
    "pseudo_records": f"SELECT id, record_type FROM (SELECT id, json_extract_string({_ANNOTATIONS}, '$.record_type') AS record_type FROM genes) WHERE record_type IS NOT NULL",
    "organism_filter": "SELECT g.id, s.category FROM genes g JOIN species s ON lower(trim(g.organism)) = lower(s.name)",
    "header_checks": f"SELECT id, length AS stated, length({_BARE}) AS counted FROM genes WHERE coalesce(length({_BARE}), 0) <> coalesce(length, 0)",
    "schema_faults": """
SELECT * FROM (SELECT id, CASE WHEN coalesce(trim(gene_id), '') = '' THEN 'missing gene_id' WHEN coalesce(trim(symbol), '') = '' THEN 'missing symbol' WHEN coalesce(trim(sequence), '') = '' THEN 'missing sequence'
 WHEN coalesce(trim(sequence_type), '') = '' THEN 'missing sequence_type' WHEN lower(trim(sequence_type)) NOT IN ('dna', 'protein', 'rna') THEN 'unknown sequence_type' END AS fault FROM genes) WHERE fault IS NOT NULL""",
    "report_rows": "SELECT id, regexp_replace(symbol, '^_[a-z]{2,20}[_-]', '', 'i') AS name, CASE WHEN length(sequence) > 30 THEN substring(sequence, 1, 30) || '...' ELSE sequence END AS preview, length(sequence) AS n FROM genes",
    "normalised": f"""
SELECT id, coalesce(nullif(gene_id, ''), nullif(symbol, '')) AS gene_id, coalesce(nullif(symbol, ''), nullif(gene_id, '')) AS symbol, coalesce(nullif(organism, ''), 'Unknown') AS organism,
 CASE WHEN coalesce(dt, '') = '' THEN CASE WHEN regexp_full_match(w, '[ACGTUN]+') THEN CASE WHEN contains(w, 'U') THEN 'rna' ELSE 'dna' END ELSE 'protein' END WHEN dt IN ('dna', 'rna', 'protein') THEN dt ELSE 'dna' END AS sequence_type,
 length(w) AS length, coalesce(nullif(source, ''), 'collected') AS source,
 CASE WHEN list_contains(map_keys(external_links), 'source_api') THEN external_links['source_api'] ELSE nullif(source_url, '') END AS source_api,
 coalesce(cardinality(external_links), 0) + CASE WHEN nullif(source_url, '') IS NOT NULL AND NOT coalesce(list_contains(map_keys(external_links), 'source_api'), false) THEN 1 ELSE 0 END AS n_links
FROM (SELECT *, upper({_BARE}) AS w, {_TYPES} AS dt FROM genes) WHERE w <> ''""",
    "dedup_first_wins": f"SELECT gene_key, id FROM (SELECT {SQL_KEY} AS gene_key, id, row_number() OVER (PARTITION BY {SQL_KEY} ORDER BY date_added NULLS LAST, id) AS r FROM genes) WHERE r = 1 AND gene_key IS NOT NULL",
    "priority_union": f"""
SELECT gene_key, organism, origin FROM (SELECT *, row_number() OVER (PARTITION BY gene_key ORDER BY part, id NULLS LAST) AS r FROM (
 SELECT {SQL_KEY} AS gene_key, organism, 'genes' AS origin, id, 0 AS part FROM genes
 UNION ALL SELECT {_NORM}, organism, 'assemblies', NULL, 1 FROM assemblies UNION ALL SELECT {_NORM}, NULL, 'retired_genes', NULL, 2 FROM retired_genes)) WHERE r = 1""",
    "upsert_merge": f"""
WITH k AS (SELECT *, {SQL_KEY} AS gene_key FROM genes WHERE {SQL_KEY} IS NOT NULL),
o AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY gene_key ORDER BY id) = 1),
n AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY gene_key ORDER BY id DESC) = 1)
SELECT n.gene_key, n.organism, md5(coalesce(nullif(n.sequence, ''), o.sequence, '')) AS sequence_md5, coalesce(nullif(n.sequence_type, ''), o.sequence_type) AS sequence_type,
 coalesce(nullif(n.description, ''), o.description) AS description, n.source, coalesce(nullif(n.source_url, ''), o.source_url) AS source_url, coalesce(nullif(n.length, 0), o.length) AS length,
 CASE WHEN len(n.traits) > 0 THEN len(n.traits) ELSE coalesce(len(o.traits), len(n.traits)) END AS n_traits,
 CASE WHEN n.external_links IS NULL THEN cardinality(o.external_links) WHEN o.external_links IS NULL THEN cardinality(n.external_links)
  ELSE len(list_distinct(list_concat(map_keys(o.external_links), map_keys(n.external_links)))) END AS n_links
FROM n JOIN o ON o.gene_key = n.gene_key""",
    "fill_missing": f"SELECT gene_key, arg_min(t, id) AS sequence_type FROM (SELECT {SQL_KEY} AS gene_key, id, nullif(lower(trim(sequence_type)), '') AS t FROM genes) WHERE gene_key IS NOT NULL GROUP BY gene_key",
    "attach_hits": f"""
WITH h AS (SELECT {_NORM} AS k, count(*) AS n FROM search_hits WHERE {_NORM} IS NOT NULL GROUP BY 1)
SELECT g.id, CAST(coalesce(a.n, CASE WHEN b.n IS NOT NULL THEN 0 END) + coalesce(b.n, 0) AS BIGINT) AS n_hits FROM genes g LEFT JOIN h a ON a.k = nullif(upper(trim(g.gene_id)), '')
 LEFT JOIN h b ON b.k = nullif(upper(trim(g.symbol)), '') AND b.k IS DISTINCT FROM a.k""",
    "plan_audit": """
SELECT coalesce(p.organism, q.organism) AS organism, CASE WHEN p.organism IS NULL THEN 'unplanned' WHEN q.organism IS NULL THEN 'missing' ELSE 'done' END AS status
FROM (SELECT DISTINCT lower(name) AS organism FROM species) p FULL OUTER JOIN (SELECT DISTINCT lower(trim(organism)) AS organism FROM genes WHERE lower(trim(organism)) <> '') q ON p.organism = q.organism""",
    "catalogue_stats": """
SELECT kind, source, grouping(kind, source) AS level, count(*) AS n, count(DISTINCT organism) AS n_organisms
FROM (SELECT lower(trim(sequence_type)) AS kind, lower(trim(source)) AS source, organism FROM genes) GROUP BY GROUPING SETS ((), (kind), (source))""",
    "type_counts": f"""
SELECT {_DETECT} AS kind, count(*) AS n_records, CAST(sum(length(sequence)) AS BIGINT) AS n_letters, max(length(sequence)) AS longest
FROM (SELECT sequence, upper(regexp_replace(sequence, '[^A-Za-z*]', '', 'g')) AS c FROM genes) GROUP BY 1""",
    "file_metadata": """
SELECT count(*) AS n, count(DISTINCT organism) AS n_organisms, CAST(sum(f) AS BIGINT) AS fields_filled, count(*) FILTER (WHERE f = 5) AS n_complete FROM (SELECT organism,
 (length(coalesce(gene_id, '')) > 0)::INT + (length(coalesce(symbol, '')) > 0)::INT + (length(coalesce(organism, '')) > 0)::INT + (length(coalesce(sequence, '')) > 0)::INT + (length(coalesce(description, '')) > 0)::INT AS f FROM genes)""",
    "load_status": """
SELECT source, CASE WHEN coalesce(n, 0) = 0 THEN 'failed' WHEN n < n_records THEN 'partial' ELSE 'ok' END AS status, count(*) AS n_loads, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_records
FROM loads LEFT JOIN (SELECT load_id, count(*) AS n FROM genes GROUP BY 1) USING (load_id) GROUP BY 1, 2""",
    "best_hit": """
SELECT hit_id, rank, identity_percent FROM (SELECT hit_id, identity_percent, row_number() OVER (PARTITION BY query_seq ORDER BY identity_percent DESC NULLS LAST, hit_id) AS rank FROM search_hits) WHERE rank <= 3""",
    "hit_scores": """
SELECT hit_id, CASE WHEN identity_percent >= 90 THEN 'very_high' WHEN identity_percent >= 75 THEN 'high' WHEN identity_percent >= 55 THEN 'moderate' WHEN identity_percent >= 35 THEN 'low' WHEN identity_percent IS NOT NULL THEN 'very_low' END AS class,
 CASE WHEN identity_percent >= 75 THEN 'High' WHEN identity_percent >= 55 THEN 'Medium' WHEN identity_percent IS NOT NULL THEN 'Low' END AS label,
 round(CASE WHEN identity_percent IS NULL OR coverage_percent IS NULL OR aligned_length > 0 AND gaps IS NULL THEN NULL ELSE least(100.0::DOUBLE, greatest(0.0::DOUBLE, least(100.0::DOUBLE, coverage_percent * 1.1::DOUBLE) * 0.4::DOUBLE
  + greatest(0.0::DOUBLE, 100 - (CASE WHEN aligned_length > 0 THEN 100 * gaps / aligned_length ELSE 0 END) * 5) * 0.35::DOUBLE + identity_percent * 0.25::DOUBLE)) END, 6) AS confidence FROM search_hits""",
}
