"""Queries on reading frames, motifs, repeats and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixspark import schema
from helixspark.operators import patterns
from helixspark.plans.base import SQL_DNA, spread_dna, sql_count, sql_reverse_complement


def orf_scan(spark: SparkSession, d: str) -> DataFrame:
    """SEQ-09, WIN-03."""
    return patterns.reading_frames(spread_dna(spark, d))


def motif_hits(spark: SparkSession, d: str) -> DataFrame:
    """SEQ-10."""
    return patterns.motif_hits(spread_dna(spark, d))


def homopolymers(spark: SparkSession, d: str) -> DataFrame:
    """SEQ-11, WIN-04."""
    return patterns.homopolymers(spread_dna(spark, d))


def tandem_repeats(spark: SparkSession, d: str) -> DataFrame:
    """SEQ-11; greedy from left to right, which SQL has no plain way to say (tests hold it against brute force)."""
    return patterns.tandem_repeats(spread_dna(spark, d))


def gc_sliding_window(spark: SparkSession, d: str) -> DataFrame:
    """WIN-01."""
    return patterns.gc_windows(spread_dna(spark, d))


def naive_annotation(spark: SparkSession, d: str) -> DataFrame:
    """SEQ-19: the simple frames of the annotation."""
    return patterns.naive_frames(spread_dna(spark, d))


QUERIES = {f.__name__: f for f in (orf_scan, motif_hits, homopolymers, tandem_repeats, gc_sliding_window, naive_annotation)}

_BY_MOTIF: dict[str, list[str]] = {}
for _name, _motif in schema.MOTIFS.items():
    _BY_MOTIF.setdefault(_motif, []).append(_name)
_MOTIF_ROWS = ", ".join(f"('{' / '.join(v)}', '{k}', '{k.replace('N', '[ATGC]')}', {len(k)})" for k, v in _BY_MOTIF.items())

ORACLE = {
    "orf_scan": f"""
WITH b AS (SELECT id, '+' AS strand, s AS t FROM {SQL_DNA} UNION ALL SELECT id, '-', {sql_reverse_complement()} FROM {SQL_DNA}),
p AS (SELECT id, strand, length(t) AS len, i, substring(t, i, 3) AS c FROM (SELECT *, unnest(generate_series(1, length(t) - 2)) AS i FROM b)),
m AS (SELECT *, (i - 1) % 3 + 1 AS f, min(CASE WHEN c <> 'ATG' THEN i END) OVER (PARTITION BY id, strand, (i - 1) % 3 ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop
 FROM p WHERE c IN ('ATG', 'TAA', 'TAG', 'TGA')),
o AS (SELECT id, strand, strand || f AS frame, len, i AS a, coalesce(stop + 2, len) AS z, stop IS NOT NULL AS complete FROM m WHERE c = 'ATG')
SELECT id, frame, CASE WHEN strand = '-' THEN len - z + 1 ELSE a END AS start, CASE WHEN strand = '-' THEN len - a + 1 ELSE z END AS "end", z - a + 1 AS n, complete FROM o WHERE z - a + 1 >= 30""",
    "motif_hits": f"""
WITH m(name, motif, pattern, n) AS (VALUES {_MOTIF_ROWS}),
p AS (SELECT id, s, name, motif, pattern, n, unnest(generate_series(1, length(s) - n + 1)) AS i FROM {SQL_DNA}, m)
SELECT id, name, motif, i AS start, i + n - 1 AS "end", substring(s, i, n) AS match FROM p WHERE substring(s, i, 1) = substring(motif, 1, 1) AND regexp_full_match(substring(s, i, n), pattern)""",
    "homopolymers": f"""
WITH p AS (SELECT id, i, substring(s, i, 1) AS base FROM (SELECT id, s, unnest(generate_series(1, length(s))) AS i FROM {SQL_DNA})),
g AS (SELECT id, i, base, i - row_number() OVER (PARTITION BY id, base ORDER BY i) AS island FROM p)
SELECT id, base, min(i) AS start, max(i) AS "end", count(*) AS n FROM g GROUP BY id, base, island HAVING count(*) >= 6""",
    "gc_sliding_window": f"""
SELECT id, i - 1 + 10 AS position, {sql_count('GC', 'substring(s, i, 20)')} AS gc FROM (SELECT id, s, unnest(generate_series(1, length(s) - 19, 5)) AS i FROM {SQL_DNA})""",
    "naive_annotation": f"""
WITH p AS (SELECT id, s, f, i, row_number() OVER (PARTITION BY id, f ORDER BY i) AS r FROM (SELECT id, s, f, unnest(generate_series(f + 1, length(s) - 2, 3)) AS i FROM {SQL_DNA}, (SELECT unnest([0, 1, 2]) AS f)) WHERE substring(s, i, 3) = 'ATG'),
e AS (SELECT id, f, i, CASE WHEN position('TAA' IN substring(s, i)) > 0 THEN position('TAA' IN substring(s, i)) WHEN position('TAG' IN substring(s, i)) > 0 THEN position('TAG' IN substring(s, i)) ELSE nullif(position('TGA' IN substring(s, i)), 0) END AS stop FROM p WHERE r <= 3)
SELECT id, CAST(f AS BIGINT) AS frame, i - 1 AS start, i + stop + 1 AS "end", stop + 2 AS n FROM e WHERE stop IS NOT NULL""",
}
