"""Queries of the operators on training text and records, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.functions.keys import STAND_INS, gene_key
from helixspark.llm import contamination, organisms, packing, spans, survivor, truncation
from helixspark.plans.base import SQL_KEY
from helixspark.tables import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor.survivors(table(spark, d, "genes"), table(spark, d, "sources"))


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    return survivor.golden_records(table(spark, d, "genes"), table(spark, d, "sources"))


def p3_truth(spark: SparkSession, d: str) -> DataFrame:
    return survivor.latent_truth(table(spark, d, "genes"), table(spark, d, "sources"))


def p3_source_quality(spark: SparkSession, d: str) -> DataFrame:
    return survivor.source_quality(table(spark, d, "genes"), table(spark, d, "sources"))


def p3_agreement(spark: SparkSession, d: str) -> DataFrame:
    return survivor.agreement(table(spark, d, "genes"), table(spark, d, "sources"))


def _organisms(spark: SparkSession, d: str) -> DataFrame:
    species = table(spark, d, "species")
    exact = species.select(F.col("name").alias("organism")).where(F.col("organism").isNotNull()).distinct()
    typed = table(spark, d, "genes").join(exact, "organism", "left_anti")
    return organisms.map_values(typed, "organism", species, "species_id", ("name", "common"), ["id"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _organisms(spark, d).select("id", "species_id")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return organisms.report(_organisms(spark, d), "organism", "species_id")


def _spans(spark: SparkSession, d: str) -> spans.SharedSpans:
    letters = F.upper(F.regexp_replace("sequence", r"\s+", ""))
    return spans.SharedSpans(table(spark, d, "genes").select("id", gene_key(F.col("gene_id"), F.col("symbol")).alias("key"), letters.alias("text")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).pairs()


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).shares()


def p7_links(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).links()


def p7_members(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).members().select("cid", "id", "key")


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return packing.pack(packing.sized(documents), per_source=packing.PER_SOURCE, n_items=documents.count())


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p8_packed(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return contamination.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    return contamination.leaked_items(p9_found(spark, d), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "documents")).where("cut").select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.rates(truncation.truncated(table(spark, d, "documents")))


QUERIES = {f.__name__: f for f in (p3_found, p3_records, p3_truth, p3_source_quality, p3_agreement, p5_found, p5_report, p7_found, p7_shares, p7_links, p7_members, p8_packed, p8_fill, p9_found, p9_items, p10_found, p10_rates)}

_STAND_INS = ", ".join(f"'{w}'" for w in STAND_INS)
_BARE = r"regexp_replace(sequence, '\s+', '', 'g')"

ORACLE = {
    "p3_found": rf"""
WITH src AS (SELECT lower(trim(source)) AS sp, trust_rank FROM sources UNION SELECT lower(trim(label)), trust_rank FROM sources),
g AS (SELECT id, {SQL_KEY} AS k, lower(trim(source)) AS sp, date_added, description, external_links,
 CASE WHEN ltrim(annotations) LIKE '"%' THEN json_extract_string(annotations, '$') ELSE annotations END AS a FROM genes),
c AS (SELECT id, k, sp, date_added, 'description' AS f, description AS v FROM g
 UNION ALL SELECT id, k, sp, date_added, 'annotations.' || n, json_extract_string(a, '$."' || n || '"') FROM (SELECT *, unnest(json_keys(a)) AS n FROM g WHERE a LIKE '{{%')
 UNION ALL SELECT id, k, sp, date_added, 'external_links.' || e.key, e.value FROM (SELECT *, unnest(map_entries(external_links)) AS e FROM g)),
v AS (SELECT c.*, trust_rank FROM c LEFT JOIN src USING (sp) WHERE v IS NOT NULL AND lower(trim(v)) NOT IN ('', {_STAND_INS}) AND NOT regexp_full_match(trim(v), '\[\s*\]|\{{\s*\}}')),
n AS (SELECT k FROM g WHERE k IS NOT NULL GROUP BY k HAVING count(*) >= 2)
SELECT k AS gene_key, f AS field_name, id FROM v WHERE k IN (SELECT k FROM n)
QUALIFY row_number() OVER (PARTITION BY k, f ORDER BY coalesce(trust_rank, 2147483647), date_added DESC NULLS LAST, id DESC) = 1""",
    "p7_members": f"""
WITH g AS (SELECT id, {SQL_KEY} AS key, upper({_BARE}) AS s FROM genes WHERE length({_BARE}) >= 64 AND {SQL_KEY} IS NOT NULL)
SELECT min(id) OVER (PARTITION BY s) AS cid, id, key FROM g""",
    "p7_shares": f"""
WITH g AS (SELECT id, {SQL_KEY} AS k, upper({_BARE}) AS s FROM genes WHERE length({_BARE}) >= 64 AND {SQL_KEY} IS NOT NULL),
w AS (SELECT id, k, i, hash(substring(s, i, 64)) AS x FROM (SELECT *, unnest(generate_series(1, length(s) - 63)) AS i FROM g)),
m AS (SELECT x FROM w GROUP BY x HAVING min(k) <> max(k)), f AS (SELECT id, i FROM w SEMI JOIN m USING (x)),
c AS (SELECT id, least(64, coalesce(i - lag(i) OVER (PARTITION BY id ORDER BY i), 64)) AS fresh FROM f)
SELECT id, length(s) AS n_letters, CAST(coalesce(n, 0) AS BIGINT) AS n_shared FROM g LEFT JOIN (SELECT id, sum(fresh) AS n FROM c GROUP BY id) USING (id)""",
    "p7_links": f"""
WITH g AS (SELECT id, {SQL_KEY} AS k, upper({_BARE}) AS s FROM genes WHERE length({_BARE}) >= 64 AND {SQL_KEY} IS NOT NULL),
c AS (SELECT s, min(id) AS cid, min(k) AS lo, max(k) AS hi FROM g GROUP BY s),
w AS (SELECT cid, lo, hi, i, substring(s, i, 64) AS t FROM (SELECT *, unnest(generate_series(1, length(s) - 63)) AS i FROM c)),
m AS (SELECT hash(t) AS x FROM w GROUP BY 1 HAVING min(lo) <> max(hi)), f AS (SELECT w.*, hash(t) AS x FROM w SEMI JOIN m ON hash(w.t) = m.x),
p AS (SELECT a.cid AS cid_a, b.cid AS cid_b, a.i - b.i AS d, a.i AS i FROM f a JOIN f b ON a.x = b.x AND a.t = b.t AND a.cid < b.cid AND NOT (a.lo = b.lo AND a.hi = b.hi AND a.lo = a.hi)),
r AS (SELECT cid_a, cid_b, count(*) + 63 AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY cid_a, cid_b, d ORDER BY i) AS island FROM p) GROUP BY cid_a, cid_b, d, island)
SELECT cid_a, cid_b, count(*) AS n_repeats, max(n) AS longest FROM r GROUP BY 1, 2""",
    "p7_found": f"""
WITH g AS (SELECT id, {SQL_KEY} AS k, upper({_BARE}) AS s FROM genes WHERE length({_BARE}) >= 64 AND {SQL_KEY} IS NOT NULL),
w AS (SELECT DISTINCT id, k, hash(substring(s, i, 64)) AS x, substring(s, i, 64) AS t FROM (SELECT *, unnest(generate_series(1, length(s) - 63)) AS i FROM g)),
m AS (SELECT x FROM w GROUP BY x HAVING min(k) <> max(k)), f AS (SELECT w.* FROM w JOIN m USING (x))
SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM f a JOIN f b ON a.x = b.x AND a.t = b.t AND a.id < b.id AND a.k <> b.k""",
}
