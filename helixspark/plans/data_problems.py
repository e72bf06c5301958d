"""Queries p1, p2, p4 and p6: drift, nesting, heavy keys, orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.functions.keys import gene_key, norm_key
from helixspark.operators import drift, heavy, nested, orphans
from helixspark.tables import table

NESTED = ["record", "annotations", "publications", "expression_profiles"]


def _key():
    return gene_key(F.col("gene_id"), F.col("symbol"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(table(spark, d, "genes"), table(spark, d, "loads"), _key())


def p1_lifespans(spark: SparkSession, d: str) -> DataFrame:
    return drift.lifespans(table(spark, d, "genes"), table(spark, d, "loads"))


def p1_unified(spark: SparkSession, d: str) -> DataFrame:
    return drift.unified(table(spark, d, "genes"), table(spark, d, "loads"), _key())


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.elements(table(spark, d, "genes"), NESTED)  # distinct as ids are


def p2_linked(spark: SparkSession, d: str) -> DataFrame:
    return nested.with_parents(nested.elements(table(spark, d, "genes"), NESTED))


def p2_exons(spark: SparkSession, d: str) -> DataFrame:
    return nested.flat_table(table(spark, d, "genes"), "record", "record.transcripts.exons", {"start": "bigint", "end": "bigint", "phase": "int"})


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    keys = {"kmer": F.col("kmer"), "gene_key": norm_key(F.col("gene_key"))}
    return heavy.heavy_keys(table(spark, d, "gene_kmers"), keys, 0.02).drop("n_rows")


def p4_kmer_profile(spark: SparkSession, d: str) -> DataFrame:
    return heavy.key_profile(table(spark, d, "gene_kmers"), F.col("kmer"), norm_key(F.col("gene_key")), F.col("pos"), "kmer")


def p4_gene_profile(spark: SparkSession, d: str) -> DataFrame:
    return heavy.key_profile(table(spark, d, "gene_kmers"), norm_key(F.col("gene_key")), F.col("kmer"), F.col("pos"), "gene_key")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    kmers, hits = table(spark, d, "gene_kmers"), table(spark, d, "search_hits")
    genes, assemblies, retired = (table(spark, d, n) for n in ("genes", "assemblies", "retired_genes"))
    key = norm_key(F.col("gene_key"))
    references = [orphans.reference_deltas(kmers, "gene_kmers", key, F.col("indexed_at")), orphans.reference_deltas(hits, "search_hits", key, F.col("run_at"))]
    existence = [orphans.existence_deltas(genes, _key(), F.col("date_added")), orphans.existence_deltas(assemblies, key, F.col("date_added")), orphans.retirement_deltas(retired, key)]
    # the tables name disjoint references, and a reference state is folded already
    return orphans.orphans(references[0].unionByName(references[1]), orphans.fold(existence))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).drop("n_refs")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, d))


QUERIES = {f.__name__: f for f in (
    p1_found, p1_lifespans, p1_unified, p2_found, p2_linked, p2_exons, p4_found, p4_kmer_profile, p4_gene_profile, p6_found, p6_report)}

_KEY = "coalesce(nullif(upper(trim(gene_id)),''), nullif(upper(trim(symbol)),''))"
_NORM = "nullif(upper(trim(gene_key)),'')"

_ORPHANS = f"""
WITH known AS (
  SELECT k, min(seen) AS since FROM (
    SELECT {_KEY} AS k, date_added AS seen FROM genes UNION ALL SELECT {_NORM}, date_added FROM assemblies) GROUP BY k),
refs AS (
  SELECT 'gene_kmers' AS ref_table, strftime(indexed_at, '%Y-%m') AS ref_month, {_NORM} AS gene_key, indexed_at AS seen FROM gene_kmers
  UNION ALL SELECT 'search_hits', strftime(run_at, '%Y-%m'), {_NORM}, run_at FROM search_hits),
judged AS (
  SELECT ref_table, ref_month, refs.gene_key, seen,
    CASE WHEN k IS NOT NULL THEN CASE WHEN seen < since THEN 'early' END
         WHEN refs.gene_key IN (SELECT {_NORM} FROM retired_genes WHERE gene_key IS NOT NULL) THEN 'deleted' ELSE 'missing' END AS reason
  FROM refs LEFT JOIN known ON k = refs.gene_key WHERE refs.gene_key IS NOT NULL)
"""

ORACLE = {
    "p1_lifespans": """
WITH n AS (SELECT load_id, count(*) AS load_rows FROM genes WHERE load_id IS NOT NULL GROUP BY 1),
e AS (SELECT load_id, unnest(json_keys(record)) AS field_name, record FROM genes WHERE load_id IS NOT NULL AND json_valid(record)),
k AS (SELECT load_id, field_name, CASE json_type(json_extract(record, '$."' || field_name || '"'))
      WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL ELSE 'number' END AS kind FROM e),
f AS (SELECT load_id, field_name, count(*) AS n_rows FROM k GROUP BY 1, 2),
t AS (SELECT load_id, field_name, kind FROM (SELECT load_id, field_name, kind, row_number() OVER (PARTITION BY load_id, field_name
      ORDER BY count(*) DESC, list_position(['string','number','boolean','array','object'], kind)) AS r FROM k WHERE kind IS NOT NULL GROUP BY 1, 2, 3) WHERE r = 1),
p AS (SELECT l.load_id, l.feed, l.load_seq, row_number() OVER (PARTITION BY l.feed ORDER BY l.load_seq, l.load_id) AS pos FROM loads l JOIN n USING (load_id)),
s AS (SELECT p.feed, f.field_name, t.kind, p.load_seq, p.pos - row_number() OVER (PARTITION BY p.feed, f.field_name, t.kind ORDER BY p.pos) AS island
      FROM f JOIN n USING (load_id) JOIN p USING (load_id) LEFT JOIN t ON t.load_id = f.load_id AND t.field_name = f.field_name WHERE f.n_rows * 5 >= n.load_rows)
SELECT feed, field_name, kind, min(load_seq) AS first_seq, max(load_seq) AS last_seq, count(*) AS n_loads FROM s GROUP BY feed, field_name, kind, island""",
    "p4_found": f"""
SELECT 'kmer' AS key_column, CAST(kmer AS VARCHAR) AS key_value FROM gene_kmers WHERE kmer IS NOT NULL GROUP BY kmer
HAVING count(*) >= 0.02 * (SELECT count(*) FROM gene_kmers)
UNION ALL SELECT 'gene_key', {_NORM} AS k FROM gene_kmers WHERE {_NORM} IS NOT NULL GROUP BY k
HAVING count(*) >= 0.02 * (SELECT count(*) FROM gene_kmers)""",
    "p4_kmer_profile": f"""
SELECT kmer, count(*) AS n_rows, count(DISTINCT {_NORM}) AS n_members, min(pos) AS min_pos, max(pos) AS max_pos
FROM gene_kmers WHERE kmer IS NOT NULL GROUP BY kmer""",
    "p4_gene_profile": f"""
SELECT {_NORM} AS gene_key, count(*) AS n_rows, count(DISTINCT kmer) AS n_members, min(pos) AS min_pos, max(pos) AS max_pos
FROM gene_kmers WHERE {_NORM} IS NOT NULL GROUP BY 1""",
    "p6_report": _ORPHANS + """
SELECT ref_table, ref_month, reason, count(DISTINCT gene_key) AS n_keys, count(*) AS n_refs FROM judged WHERE reason IS NOT NULL GROUP BY 1, 2, 3""",
    "p6_found": _ORPHANS + "SELECT DISTINCT ref_table, ref_month, gene_key, reason FROM judged WHERE reason IS NOT NULL",
}
