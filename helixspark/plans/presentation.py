"""Queries that prepare what people look at: result documents, the series behind charts; and the functions SQL can call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.functions import pairs, protein, seq, sql
from helixspark.kernels import trees
from helixspark.operators import search
from helixspark.plans import similarity
from helixspark.plans.base import SQL_DNA, SQL_KEY, SQL_PROTEIN, dna, key, proteins, spread_dna, sql_count
from helixspark.plans.patterns import ORACLE as _PATTERNS
from helixspark.sinks import writers
from helixspark.tables import table

#: Columns of an alignment, or letters of a row, that a strip shows.
STRIP = 60


def result_documents(spark: SparkSession, d: str) -> DataFrame:
    """SNK-01: the result document of every DNA record as JSON with its eleven keys; the time is that of the caller, here left null."""
    s = F.col("s")
    hits = table(spark, d, "search_hits").where(F.col("gene_key").isNotNull()).groupBy(F.upper(F.trim("gene_key")).alias("k")).agg(F.count("*").alias("n_hits"), F.max(F.struct("identity_percent", (-F.col("hit_id")).alias("i"))).alias("_b"))
    rows = dna(spark, d, "gene_id", "symbol").select("id", "s", key().alias("k")).join(hits, "k", "left")
    count = lambda x: seq.count_of(s, x)
    document = F.struct(
        F.lit(None).cast("string").alias("timestamp"), s.alias("sequence"), F.length(s).alias("sequence_length"),
        F.struct(F.length(s).alias("length"), count("GC").alias("gc"), count("AT").alias("at")).alias("statistics"),
        F.struct(*[count(x).alias(x) for x in "ATGCN"]).alias("distribution"), F.substring_index(seq.amino_acids(s), "*", 1).alias("translation"),
        F.struct(F.contains(s, F.lit("TATAAA")).alias("tata_box")).alias("motifs"), F.coalesce("n_hits", F.lit(0)).alias("similarity_results"), (-F.col("_b.i")).alias("best_match"),
        F.lit(None).cast("string").alias("mutation_report"), F.struct(seq.length_class(F.length(s)).alias("length_class")).alias("interpretation"))
    return rows.select("id", F.to_json(document, {"ignoreNullFields": "false"}).alias("document"))


def fasta_files(spark: SparkSession, d: str) -> DataFrame:
    """SNK-06: the lines of the FASTA download."""
    return writers.fasta_lines(dna(spark, d).select(F.concat(F.lit("G"), "id").alias("symbol"), F.col("s").alias("sequence")))


def text_reports(spark: SparkSession, d: str) -> DataFrame:
    """SNK-06: the plain report on each sequence."""
    return writers.text_report(dna(spark, d).select("id", "s", F.lit("dna").alias("sequence_type")))


def _series(df: DataFrame, name: str, x, y, color) -> DataFrame:
    return df.select("id", F.lit(name).alias("series"), x.cast("string").alias("x"), y.cast("double").alias("y"), color.alias("color_class"))


def composition_series(spark: SparkSession, d: str) -> DataFrame:
    """§2.14: ``(id, series, x, y, color_class)`` of the pie of bases, the bars of residues and the gauge of G + C content."""
    s = F.col("s")
    bases = dna(spark, d).select("id", F.explode(F.create_map(*[x for b in "ATGCN" for x in (F.lit(b), seq.count_of(s, b))])).alias("base", "n"))
    residues = proteins(spark, d).select("id", F.explode(protein.distribution(s)).alias("residue", "n")).where("n > 0")
    gauge = dna(spark, d).select("id", (100 * seq.gc_fraction(s)).alias("gc"))
    out = _series(bases, "bases", F.col("base"), F.col("n"), F.col("base"))
    out = out.unionByName(_series(residues, "residues", F.col("residue"), F.col("n"), F.coalesce(protein.group(F.col("residue")), F.lit("other"))))
    return out.unionByName(_series(gauge, "gauge", F.lit("gc"), F.col("gc"), seq.gc_category(F.col("gc"))))


def score_series(spark: SparkSession, d: str) -> DataFrame:
    """§2.14: the bars of the scores of recorded hits, by their class."""
    hits = table(spark, d, "search_hits").select(F.col("hit_id").alias("id"), "gene_name", "identity_percent")
    return _series(hits, "scores", seq.display_name(F.col("gene_name")), F.col("identity_percent"), seq.similarity_class(F.col("identity_percent")))


def alignment_series(spark: SparkSession, d: str) -> DataFrame:
    """§2.14: the strip of the first sixty columns of each alignment, and the map of its differing columns."""
    both, of = search.nearest(spread_dna(spark, d))
    done = similarity._of_each(similarity._solved(both).select("pair", "query_aligned", "gene_aligned"), of.select("pair", "query"))
    each = done.select(F.col("pair").alias("id"), F.posexplode(pairs.columns(F.col("query_aligned"), F.col("gene_aligned"))).alias("at", "c"))
    gap = (F.col("c.a") == "-") | (F.col("c.b") == "-")
    kind = F.when(gap, "gap").when(F.col("c.a") == F.col("c.b"), "match").otherwise(F.when(pairs.is_transition(F.col("c.a"), F.col("c.b")), "transition").otherwise("transversion"))
    strip = _series(each.where(F.col("at") < STRIP), "strip", F.concat("c.a", F.lit("/"), "c.b"), F.col("at"), kind)
    return strip.unionByName(_series(each.where(kind != "match"), "mutations", F.concat("c.b", F.lit(">"), "c.a"), F.col("at") + 1, kind))


def msa_series(spark: SparkSession, d: str) -> DataFrame:
    """§2.14: the table of the multiple alignment of each gene: name, and the first sixty columns of its row."""
    rows = similarity.gene_alignments(spark, d)
    return rows.select("group", "name", F.left("aligned", F.lit(STRIP)).alias("columns"), F.length("aligned").cast("bigint").alias("n"))


def dendrogram_series(spark: SparkSession, d: str) -> DataFrame:
    """§2.14: the lines of each gene's dendrogram: every node with its parent and its height below the root."""
    import pandas as pd

    def lines(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for name, text in zip(group["group"], group["upgma"], strict=True):
            edges = trees.parse_newick(text)
            up = {c: (p, b) for p, c, b in edges}
            for node in up:
                depth, at = 0.0, node
                while at in up:
                    at, b = up[at]
                    depth += b
                out.append((name, node, up[node][0], depth))
        return pd.DataFrame(out, columns=["group", "node", "parent", "depth"])

    shape = "group string, node string, parent string, depth double"
    return similarity.gene_trees(spark, d).mapInPandas(lambda batches: map(lines, batches), shape)


def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """§2.15: the scalar functions called from SQL."""
    sql.register(spark)
    dna(spark, d).createOrReplaceTempView("helix_dna")
    return spark.sql("""SELECT id, seq_count(s, 'GC') AS n_gc, seq_gc(s) AS gc, md5(seq_reverse_complement(s)) AS reverse_md5, seq_has_start(s) AS has_start, seq_hash(s) AS hash, seq_translate(s) AS protein,
 CAST(size(seq_codons(s)) AS BIGINT) AS n_codons, round(seq_melting(left(s, 40)), 6) AS melting FROM helix_dna""")


def sql_frames(spark: SparkSession, d: str) -> DataFrame:
    """§2.15: reading frames by the table function, called laterally from SQL."""
    sql.register(spark)
    spread_dna(spark, d).createOrReplaceTempView("helix_dna_spread")
    return spark.sql("SELECT g.id, f.* FROM helix_dna_spread g, LATERAL seq_frames(g.s, 30) f")


def sql_alignments(spark: SparkSession, d: str) -> DataFrame:
    """§2.15: forms of one gene aligned from SQL, and their tandem repeats by the table function."""
    sql.register(spark)
    similarity._firsts(spark, d).createOrReplaceTempView("helix_pairs")
    return spark.sql("SELECT pair, x.score, x.a AS query_aligned, x.b AS gene_aligned, r.* FROM (SELECT pair, query_s, seq_align(query_s, s) AS x FROM helix_pairs) p LEFT JOIN LATERAL seq_repeats(p.query_s, 3) r")


QUERIES = {f.__name__: f for f in (
    result_documents, fasta_files, text_reports, composition_series, score_series, alignment_series, msa_series, dendrogram_series, sql_functions, sql_frames, sql_alignments)}

_CODONS = "regexp_extract_all(s, '...')"


def _oracles() -> dict[str, str]:
    from helixspark import schema

    codons = ", ".join(f"'{k}': '{v}'" for k, v in schema.CODONS.items())
    protein_of = f"array_to_string(list_transform({_CODONS}, lambda c: coalesce(MAP {{{codons}}}[c], '?')), '')"
    groups = {a: g for letters, g in (("AVLIMFWPG", "nonpolar"), ("STCYNQ", "polar"), ("DE", "acidic"), ("KRH", "basic")) for a in letters}
    residues = "ACDEFGHIKLMNPQRSTVWYBXZ*"
    return {
        "result_documents": f"""
WITH h AS (SELECT upper(trim(gene_key)) AS k, count(*) AS n, arg_max(hit_id, {{'a': coalesce(identity_percent, -1), 'b': -hit_id}}) AS best FROM search_hits WHERE gene_key IS NOT NULL GROUP BY 1)
SELECT id, '{{"timestamp":null,"sequence":"' || s || '","sequence_length":' || length(s) || ',"statistics":{{"length":' || length(s) || ',"gc":' || {sql_count('GC')} || ',"at":' || {sql_count('AT')} || '}},"distribution":{{"A":' || {sql_count('A')}
 || ',"T":' || {sql_count('T')} || ',"G":' || {sql_count('G')} || ',"C":' || {sql_count('C')} || ',"N":' || {sql_count('N')} || '}},"translation":"' || split_part({protein_of}, '*', 1) || '","motifs":{{"tata_box":' || contains(s, 'TATAAA')
 || '}},"similarity_results":' || coalesce(n, 0) || ',"best_match":' || coalesce(CAST(best AS VARCHAR), 'null') || ',"mutation_report":null,"interpretation":{{"length_class":"'
 || CASE WHEN length(s) < 100 THEN 'short_fragment' WHEN length(s) < 500 THEN 'medium_fragment' WHEN length(s) < 2000 THEN 'gene_length' ELSE 'large_sequence' END || '"}}}}' AS document
FROM (SELECT *, {SQL_KEY} AS key FROM {SQL_DNA}) LEFT JOIN h ON h.k = key""",
        "composition_series": f"""
SELECT id, 'bases' AS series, b AS x, CAST(length(s) - length(replace(s, b, '')) AS DOUBLE) AS y, b AS color_class FROM {SQL_DNA}, (SELECT unnest(['A', 'T', 'G', 'C', 'N']) AS b)
UNION ALL SELECT id, 'residues', b, CAST(length(s) - length(replace(s, b, '')) AS DOUBLE) AS y, coalesce(MAP {{{', '.join(f"'{k}': '{v}'" for k, v in groups.items())}}}[b], 'other') FROM {SQL_PROTEIN}, (SELECT unnest(string_split('{",".join(residues)}', ',')) AS b) WHERE contains(s, b)
UNION ALL SELECT id, 'gauge', 'gc', g, CASE WHEN g >= {schema.GC_HIGH} THEN 'GC-rich' WHEN g <= {schema.GC_LOW} THEN 'AT-rich' ELSE 'balanced' END FROM (SELECT id, 100 * ({sql_count('GC')} / length(s)) AS g FROM {SQL_DNA})""",
        "score_series": """
SELECT hit_id AS id, 'scores' AS series, regexp_replace(gene_name, '^_[a-z]{2,20}[_-]', '', 'i') AS x, identity_percent AS y,
 CASE WHEN identity_percent >= 90 THEN 'very_high' WHEN identity_percent >= 75 THEN 'high' WHEN identity_percent >= 55 THEN 'moderate' WHEN identity_percent >= 35 THEN 'low' WHEN identity_percent IS NOT NULL THEN 'very_low' END AS color_class FROM search_hits""",
        "fasta_files": f"""
SELECT '>G' || id || ' | length=' || length(s) || CASE WHEN regexp_full_match(s, '[ACGTUN]+') THEN 'bp | GC=' || printf('%.2f', 100 * ({sql_count('GC')} / length(s))) || '%' ELSE 'aa' END || chr(10) || rtrim(regexp_replace(s, '(.{{60}})', '\\1' || chr(10), 'g'), chr(10)) AS value FROM {SQL_DNA}""",
        "text_reports": f"""
SELECT id, concat_ws(chr(10), 'Analysis Report', repeat('=', 50), 'Sequence Length: ' || length(s) || ' bp', 'GC Content: ' || printf('%.2f', 100 * {sql_count('GC')} / length(s)) || '%',
 'AT Content: ' || printf('%.2f', 100 * {sql_count('AT')} / length(s)) || '%') AS value FROM {SQL_DNA}""",
        "sql_frames": _PATTERNS["orf_scan"],
        "sql_functions": f"""
SELECT id, {sql_count('GC')} AS n_gc, 100 * {sql_count('GC')} / length(s) AS gc, md5(reverse(translate(s, 'ATGCN', 'TACGN'))) AS reverse_md5, contains(s, 'ATG') OR contains(s, 'CAT') AS has_start, substring(sha256(s), 1, 16) AS hash,
 split_part({protein_of}, '*', 1) AS protein, length(s) // 3 AS n_codons, round(CASE WHEN length(t) <= 13 THEN 2 * {sql_count('AT', 't')} + 4 * {sql_count('GC', 't')} ELSE 64.9::DOUBLE + 41 * ({sql_count('GC', 't')} - 16.4::DOUBLE) / length(t) END, 6) AS melting
FROM (SELECT *, substring(s, 1, 40) AS t FROM {SQL_DNA})""",
    }


ORACLE = _oracles()
