"""Queries on the make-up of sequences: base and codon counts, translation, types and validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark import schema
from helixspark.functions import protein, seq
from helixspark.plans.base import SQL_DNA, SQL_LETTERS, SQL_PROTEIN, dna, letters, proteins, spread_dna, sql_count, sql_map, sql_reverse_complement
from helixspark.sinks import writers
from helixspark.tables import table

def S() -> Column:
    return F.col("s")


def gc_profile(spark: SparkSession, d: str) -> DataFrame:
    """SEQ-01, SEQ-17: length, G + C and their share."""
    return dna(spark, d).select("id", F.length("s").cast("bigint").alias("n"), seq.count_of(S(), "GC").alias("gc"), seq.gc_fraction(S()).alias("gc_fraction"))


def nucleotide_distribution(spark: SparkSession, d: str) -> DataFrame:
    """SEQ-02, SEQ-21."""
    return dna(spark, d).select("id", *[seq.count_of(S(), b).alias(f"n_{b.lower()}") for b in schema.DNA])


def sequence_statistics(spark: SparkSession, d: str) -> DataFrame:
    """SEQ-04: the statistics of a DNA sequence in one row."""
    at, gc = seq.count_of(S(), "AT"), seq.count_of(S(), "GC")
    return dna(spark, d).select(
        "id", F.length("s").cast("bigint").alias("n"), at.alias("n_at"), gc.alias("n_gc"), F.when(at > 0, gc / at).alias("gc_ratio"),
        (F.length("s") - at - gc).cast("bigint").alias("n_ambiguous"), seq.has_start(S()).alias("has_start"), seq.has_stop(S()).alias("has_stop"),
        F.floor(F.length("s") / 3).cast("bigint").alias("n_codons"), seq.gc3(S()).alias("gc3"),
        seq.gc_category(100 * seq.gc_fraction(S())).alias("gc_category"), seq.length_class(F.length("s")).alias("length_class"))


def codon_usage(spark: SparkSession, d: str) -> DataFrame:
    """AGG-08: codons of frame 0, ambiguous ones included."""
    each = dna(spark, d).select(F.explode(seq.codons(S())).alias("codon"))
    amino = F.coalesce(F.element_at(seq._map(schema.CODONS), F.col("codon")), F.lit("?"))
    return each.groupBy("codon").agg(F.count("*").alias("n")).withColumn("amino_acid", amino)


def translate_frame0(spark: SparkSession, d: str) -> DataFrame:
    """SEQ-07."""
    whole = spread_dna(spark, d).select("id", seq.amino_acids(S()).alias("w"))
    return whole.select("id", seq.up_to_stop(F.col("w")).alias("t")).select("id", "t.*")


def six_frames(spark: SparkSession, d: str) -> DataFrame:
    """SEQ-08."""
    frames = spread_dna(spark, d).select("id", F.explode(seq.six_frames(S())).alias("t"))
    return frames.select("id", "t.frame", F.substring_index(seq.amino_acids(F.col("t.bases")), "*", 1).alias("protein"))


def reverse_complement(spark: SparkSession, d: str) -> DataFrame:
    """SEQ-06."""
    return dna(spark, d).select("id", seq.complement(S()).alias("complement"), seq.reverse_complement(S()).alias("reverse_complement"))


def melting_temperature(spark: SparkSession, d: str) -> DataFrame:
    """SEQ-12."""
    return dna(spark, d).select("id", seq.melting_temperature(S()).alias("tm"))


def sha_prefix(spark: SparkSession, d: str) -> DataFrame:
    """SEQ-16."""
    return letters(spark, d).select("id", seq.sha_prefix(S()).alias("sequence_hash"))


def signature5(spark: SparkSession, d: str) -> DataFrame:
    """SEQ-14: number and joined text of the sorted distinct words of five bases."""
    return dna(spark, d).select("id", F.array_join(seq.signature(S()), ",").alias("signature"))


def detect_type(spark: SparkSession, d: str) -> DataFrame:
    """FLT-03: the type by alphabet, strictly, and declared in one spelling."""
    genes = table(spark, d, "genes").select("id", "sequence", "sequence_type")
    return genes.select(
        "id", seq.detect_type(F.col("sequence")).alias("detected"), seq.detect_type_strict(F.col("sequence")).alias("strict"),
        seq.normal_type(F.col("sequence_type"), F.col("sequence")).alias("normal"))


def validate(spark: SparkSession, d: str) -> DataFrame:
    """FLT-02: the first fault of each sequence under its detected type."""
    rows = table(spark, d, "genes").select("id", seq.bare(F.col("sequence")).alias("s"))
    return rows.select("id", seq.validate(S(), F.coalesce(seq.detect_type(S()), F.lit("dna"))).alias("fault"))


def clean(spark: SparkSession, d: str) -> DataFrame:
    """FLT-01."""
    genes = table(spark, d, "genes").select("id", "sequence")
    return genes.select("id", seq.clean_dna(F.col("sequence")).alias("as_dna"), seq.clean_protein(F.col("sequence")).alias("as_protein"))


def taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """SEQ-20: genus and species of the canonical organisms."""
    return table(spark, d, "species").select("species_id", seq.taxonomy(F.col("name")).alias("t")).select("species_id", "t.*")


def amino_acid_distribution(spark: SparkSession, d: str) -> DataFrame:
    """PRO-01: residues over all proteins."""
    each = proteins(spark, d).select("id", F.explode(protein.distribution(S())).alias("residue", "n"))
    return each.groupBy("residue").agg(F.sum("n").cast("bigint").alias("n"))


def protein_stats(spark: SparkSession, d: str) -> DataFrame:
    """PRO-02, PRO-03, PRO-04."""
    return proteins(spark, d).select(
        "id", F.length("s").cast("bigint").alias("n"), protein.mass_centi(S()).alias("mass_centi"), protein.hydropathy(S()).alias("hydropathy"),
        protein.unique_residues(S()).alias("n_unique"))


def isoelectric_point(spark: SparkSession, d: str) -> DataFrame:
    """PRO-05."""
    return proteins(spark, d).select("id", F.round(protein.isoelectric_point(S()), 6).alias("pi"))


def residue_groups(spark: SparkSession, d: str) -> DataFrame:
    """PRO-06: residues by property group over all proteins."""
    each = proteins(spark, d).select("id", F.explode(protein.distribution(S())).alias("residue", "n"))
    return each.groupBy(F.coalesce(protein.group(F.col("residue")), F.lit("other")).alias("residue_group")).agg(F.sum("n").cast("bigint").alias("n"))


def interpretation(spark: SparkSession, d: str) -> DataFrame:
    """INT-03, INT-04, INT-11: classes of a DNA sequence by length, GC content and signs of coding."""
    gc = 100 * seq.gc_fraction(S())
    coding = F.when(seq.has_start(S()) & seq.has_stop(S()), "high").when(seq.has_start(S()), "medium").otherwise("low")
    return dna(spark, d).select("id", seq.length_class(F.length("s")).alias("length_class"), seq.gc_category(gc).alias("gc_category"), coding.alias("coding_potential"))


def metrics(spark: SparkSession, d: str) -> DataFrame:
    """SNK-02, and the series behind the charts: base counts as ``(id, Metric, Value)``."""
    return writers.metrics(nucleotide_distribution(spark, d), "id")


def mean_gc(spark: SparkSession, d: str) -> DataFrame:
    """AGG-09: sequences and mean G + C content per source, as exact sums."""
    rows = dna(spark, d, "source").select(F.lower(F.trim("source")).alias("source"), seq.count_of(S(), "GC").alias("gc"), F.length("s").alias("n"))
    return rows.groupBy("source").agg(F.count("*").alias("n_sequences"), F.sum("gc").cast("bigint").alias("gc"), F.sum("n").cast("bigint").alias("n"))


QUERIES = {f.__name__: f for f in (
    gc_profile, nucleotide_distribution, sequence_statistics, codon_usage, translate_frame0, six_frames, reverse_complement, melting_temperature,
    sha_prefix, signature5, detect_type, validate, clean, taxonomy, amino_acid_distribution, protein_stats, isoelectric_point, residue_groups, interpretation, metrics, mean_gc)}

_CODON_SQL = sql_map(schema.CODONS, "code")
_AA = "ACDEFGHIKLMNPQRSTVWYBXZ*"
_MASS = " + ".join(f"{m} * {sql_count(a)}" for a, m in schema.MASS.items())
_HYDRO = " + ".join(f"({h}) * {sql_count(a)}" for a, h in schema.HYDROPATHY.items())
_GROUP = "CASE " + " ".join(f"WHEN contains('{v}', residue) THEN '{k}'" for k, v in schema.GROUPS.items()) + " ELSE 'other' END"


def _frames_sql() -> str:
    parts = []
    for sign, x in (("+", "s"), ("-", sql_reverse_complement())):
        parts += [f"SELECT id, '{sign}{f + 1}' AS frame, substring({x}, {f + 1}) AS t FROM {SQL_DNA}" for f in range(3)]
    return " UNION ALL ".join(parts)


def _translated(source: str) -> str:
    """SQL of ``keys, whole``: the translation of every ``t`` of ``source(id, frame, t)``."""
    return f"""
WITH {_CODON_SQL}, src AS ({source}),
c AS (SELECT id, frame, unnest(generate_series(1, length(t) - 2, 3)) AS i, t FROM src),
a AS (SELECT c.id, c.frame, c.i, coalesce(code.v, '?') AS aa FROM c LEFT JOIN code ON code.k = substring(c.t, c.i, 3)),
w AS (SELECT src.id, src.frame, coalesce(string_agg(a.aa, '' ORDER BY a.i), '') AS whole FROM src LEFT JOIN a ON a.id = src.id AND a.frame = src.frame GROUP BY src.id, src.frame)
"""


_TYPE = """CASE WHEN c = '' THEN 'unknown' WHEN regexp_full_match(c, '[ATGCN]+') THEN 'dna'
 WHEN regexp_full_match(c, '[ACDEFGHIKLMNPQRSTVWYBXZ*]+') THEN 'protein' WHEN regexp_matches(c, '[BJOUXZ*]') THEN 'protein' WHEN c IS NOT NULL THEN 'dna' END"""
_STRICT = f"""CASE WHEN c = '' THEN 'unknown' WHEN regexp_full_match(c, '[{schema.DNA_VALID}]+') THEN 'dna' WHEN regexp_full_match(c, '[ACGUN]+') THEN 'rna'
 WHEN regexp_full_match(c, '[ACDEFGHIKLMNPQRSTVWYBXZ*]+') THEN 'protein' WHEN c IS NOT NULL THEN 'unknown' END"""
_C = r"upper(regexp_replace(sequence, '[^A-Za-z*]', '', 'g'))"

ORACLE = {
    "interpretation": f"""
SELECT id, CASE WHEN length(s) < 100 THEN 'short_fragment' WHEN length(s) < 500 THEN 'medium_fragment' WHEN length(s) < 2000 THEN 'gene_length' ELSE 'large_sequence' END AS length_class,
 CASE WHEN 100 * ({sql_count('GC')} / length(s)) >= 60 THEN 'GC-rich' WHEN 100 * ({sql_count('GC')} / length(s)) <= 35 THEN 'AT-rich' ELSE 'balanced' END AS gc_category,
 CASE WHEN contains(s, 'ATG') OR contains(s, 'CAT') THEN CASE WHEN regexp_matches(s, 'TAA|TAG|TGA|TTA|CTA|TCA') THEN 'high' ELSE 'medium' END ELSE 'low' END AS coding_potential FROM {SQL_DNA}""",
    "metrics": " UNION ALL ".join(f"SELECT id, 'n_{b.lower()}' AS \"Metric\", CAST({sql_count(b)} AS VARCHAR) AS \"Value\" FROM {SQL_DNA}" for b in schema.DNA),
    "mean_gc": f"SELECT lower(trim(source)) AS source, count(*) AS n_sequences, CAST(sum({sql_count('GC')}) AS BIGINT) AS gc, CAST(sum(length(s)) AS BIGINT) AS n FROM {SQL_DNA} GROUP BY 1",
    "gc_profile": f"SELECT id, length(s) AS n, {sql_count('GC')} AS gc, {sql_count('GC')} / length(s) AS gc_fraction FROM {SQL_DNA}",
    "nucleotide_distribution": f"SELECT id, {', '.join(f'{sql_count(b)} AS n_{b.lower()}' for b in schema.DNA)} FROM {SQL_DNA}",
    "sequence_statistics": f"""
SELECT id, length(s) AS n, {sql_count('AT')} AS n_at, {sql_count('GC')} AS n_gc, CASE WHEN {sql_count('AT')} > 0 THEN {sql_count('GC')} / {sql_count('AT')} END AS gc_ratio,
 length(s) - {sql_count('ATGC')} AS n_ambiguous, contains(s, 'ATG') OR contains(s, 'CAT') AS has_start, regexp_matches(s, 'TAA|TAG|TGA|TTA|CTA|TCA') AS has_stop,
 length(s) // 3 AS n_codons,
 CASE WHEN length(s) >= 3 THEN len(list_filter(generate_series(3, length(s), 3), lambda i: substring(s, i, 1) IN ('G', 'C'))) / (length(s) // 3) END AS gc3,
 CASE WHEN 100 * ({sql_count('GC')} / length(s)) >= 60 THEN 'GC-rich' WHEN 100 * ({sql_count('GC')} / length(s)) <= 35 THEN 'AT-rich' ELSE 'balanced' END AS gc_category,
 CASE WHEN length(s) < 100 THEN 'short_fragment' WHEN length(s) < 500 THEN 'medium_fragment' WHEN length(s) < 2000 THEN 'gene_length' ELSE 'large_sequence' END AS length_class
FROM {SQL_DNA}""",
    "codon_usage": f"""
WITH {_CODON_SQL}, c AS (SELECT substring(s, i, 3) AS codon FROM (SELECT s, unnest(generate_series(1, length(s) - 2, 3)) AS i FROM {SQL_DNA}))
SELECT codon, count(*) AS n, coalesce(any_value(v), '?') AS amino_acid FROM c LEFT JOIN code ON k = codon GROUP BY codon""",
    "translate_frame0": _translated(f"SELECT id, '' AS frame, s AS t FROM {SQL_DNA}")
    + "SELECT id, split_part(whole, '*', 1) AS protein, CASE WHEN contains(whole, '*') THEN position('*' IN whole) - 1 END AS stop_position, CASE WHEN contains(whole, '*') THEN 'complete' ELSE 'no_stop_codon' END AS status FROM w",
    "six_frames": _translated(_frames_sql()) + "SELECT id, frame, split_part(whole, '*', 1) AS protein FROM w",
    "reverse_complement": f"SELECT id, translate(s, 'ATGCN', 'TACGN') AS complement, {sql_reverse_complement()} AS reverse_complement FROM {SQL_DNA}",
    "melting_temperature": f"""
SELECT id, CASE WHEN length(s) <= 13 THEN CAST(2 * {sql_count('AT')} + 4 * {sql_count('GC')} AS DOUBLE)
 ELSE CAST(64.9 AS DOUBLE) + 41 * ({sql_count('GC')} - CAST(16.4 AS DOUBLE)) / length(s) END AS tm FROM {SQL_DNA}""",
    "sha_prefix": f"SELECT id, substring(sha256(s), 1, 16) AS sequence_hash FROM {SQL_LETTERS}",
    "signature5": f"""
SELECT id, coalesce(array_to_string(list_sort(list_distinct(list_transform(generate_series(1, length(s) - 4), lambda i: substring(s, i, 5)))), ','), '') AS signature FROM {SQL_DNA}""",
    "detect_type": f"""
SELECT id, {_TYPE} AS detected, {_STRICT} AS strict,
 CASE WHEN coalesce(dt, '') = '' THEN CASE WHEN regexp_full_match(upper(w), '[ACGTUN]+') THEN CASE WHEN contains(upper(w), 'U') THEN 'rna' ELSE 'dna' END ELSE 'protein' END
  WHEN dt IN ('dna', 'rna', 'protein') THEN dt ELSE 'dna' END AS normal
FROM (SELECT id, {_C} AS c, regexp_replace(sequence, '\\s+', '', 'g') AS w,
 CASE lower(trim(sequence_type)) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in schema.TYPE_SYNONYMS.items())} ELSE lower(trim(sequence_type)) END AS dt FROM genes)""",
    "validate": f"""
SELECT id, CASE WHEN coalesce(s, '') = '' THEN 'empty' WHEN k = 'protein' AND length(s) < 5 OR k <> 'protein' AND length(s) < 10 THEN 'too short'
 WHEN bad <> '' THEN 'invalid characters: ' || array_to_string(list_sort(list_distinct(string_split(bad, ''))), ', ') ELSE 'ok' END AS fault
FROM (SELECT id, s, k, CASE WHEN k = 'protein' THEN regexp_replace(s, '[ACDEFGHIKLMNPQRSTVWYBXZ*]', '', 'g') ELSE regexp_replace(s, '[{schema.DNA_VALID}]', '', 'g') END AS bad
 FROM (SELECT id, s, coalesce({_TYPE}, 'dna') AS k FROM (SELECT id, upper(regexp_replace(sequence, '\\s+', '', 'g')) AS s, {_C} AS c FROM genes)))""",
    "clean": rf"""
SELECT id, regexp_replace(u, '[^{schema.DNA_VALID}]', '', 'g') AS as_dna, regexp_replace(u, '[^{_AA}]', '', 'g') AS as_protein
FROM (SELECT id, upper(regexp_replace(sequence, '(?m)^>.*$', '', 'g')) AS u FROM genes)""",
    "taxonomy": "SELECT species_id, string_split(trim(name), ' ')[1] AS genus, string_split(trim(name), ' ')[2] AS species FROM species",
    "amino_acid_distribution": f"SELECT residue, CAST(sum(length(s) - length(replace(s, residue, ''))) AS BIGINT) AS n FROM {SQL_PROTEIN}, (SELECT unnest(string_split('{_AA}', '')) AS residue) GROUP BY residue",
    "protein_stats": f"""
SELECT id, length(s) AS n, CAST({_MASS} - (length(s) - 1) * {schema.WATER} AS BIGINT) AS mass_centi, ({_HYDRO}) / (length(s) * 10) AS hydropathy,
 len(list_distinct(string_split(s, ''))) AS n_unique FROM {SQL_PROTEIN}""",
    "isoelectric_point": f"""
WITH RECURSIVE p AS (SELECT id, {', '.join(f'CAST({sql_count(a)} AS DOUBLE) AS {a.lower()}' for a in 'KRHDECY')} FROM {SQL_PROTEIN}),
step(id, n, low, high) AS (
 SELECT id, 0, CAST(0 AS DOUBLE), CAST(14 AS DOUBLE) FROM p
 UNION ALL
 SELECT id, n + 1, CASE WHEN charge > 0 THEN mid ELSE low END, CASE WHEN charge > 0 THEN high ELSE mid END FROM (
  SELECT step.*, (low + high) / 2 AS mid,
   1 / (1 + power(10, (low + high) / 2 - 9.69::DOUBLE)) + k / (1 + power(10, (low + high) / 2 - 10.54::DOUBLE)) + r / (1 + power(10, (low + high) / 2 - 12.48::DOUBLE)) + h / (1 + power(10, (low + high) / 2 - 6.04::DOUBLE))
   - (1 / (1 + power(10, 2.34::DOUBLE - (low + high) / 2)) + d / (1 + power(10, 3.86::DOUBLE - (low + high) / 2)) + e / (1 + power(10, 4.25::DOUBLE - (low + high) / 2)) + c / (1 + power(10, 8.33::DOUBLE - (low + high) / 2)) + y / (1 + power(10, 10.07::DOUBLE - (low + high) / 2))) AS charge
  FROM step JOIN p USING (id) WHERE n < 25))
SELECT id, round((low + high) / 2, 6) AS pi FROM step WHERE n = 25""",
    "residue_groups": f"""
SELECT {_GROUP} AS residue_group, CAST(sum(length(s) - length(replace(s, residue, ''))) AS BIGINT) AS n
FROM {SQL_PROTEIN}, (SELECT unnest(string_split('{_AA}', '')) AS residue) GROUP BY 1""",
}
