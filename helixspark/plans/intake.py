"""Queries on sources: files and answers of services, built as texts from the catalogue and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixspark import schema
from helixspark.functions import seq
from helixspark.operators import catalogue as ops
from helixspark.plans.base import SQL_KEY, SQL_LETTERS, key, letters, sql_count
from helixspark.plans.catalogue import ORACLE as _CATALOGUE
from helixspark.sources import files, services
from helixspark.tables import table

FAMILIES = [("MYB", "MYB factor"), ("WRKY", "WRKY factor")]


def _fasta(spark: SparkSession, d: str) -> DataFrame:
    """One FASTA text a row, its header annotated with the stated length and the G + C content of the first hundred letters."""
    first = F.left("s", F.lit(100))
    gc = F.floor(100 * seq.count_of(first, "GC") / F.length(first)).cast("string")
    header = F.concat(F.lit(">G"), "id", F.lit(" | length="), F.coalesce(F.col("length").cast("string"), F.lit("?")), F.lit(" bp | GC="), gc, F.lit("% | Checked By Hand"))
    return letters(spark, d, "length").select(F.concat(header, F.lit("\n"), F.regexp_replace("s", "(.{60})", "$1\n")).alias("text"))


def fasta_records(spark: SparkSession, d: str) -> DataFrame:
    """SRC-01, SRC-02: FASTA texts taken apart into header fields and letters."""
    m = F.col("metadata")
    return files.parse_text(_fasta(spark, d)).select(m["name"].alias("name"), m["length"].alias("stated"), m["gc"].alias("gc"), m["checked_by_hand"].alias("flag"), F.md5("sequence").alias("sequence_md5"))


def header_warnings(spark: SparkSession, d: str) -> DataFrame:
    """FLT-14: records whose header doesn't agree with their letters, in G + C content of DNA by more than 0.2 percent or in length."""
    m, s = F.col("metadata"), F.col("sequence")
    stated, gc = F.regexp_replace(m["length"], "[^0-9]", "").try_cast("int"), F.rtrim(m["gc"], F.lit("%")).try_cast("double")
    off = F.when(seq.detect_type(s) == "dna", F.abs(gc - 100 * seq.gc_fraction(s)) > 0.2)
    rows = files.parse_text(_fasta(spark, d)).select(m["name"].alias("name"), F.coalesce(off, F.lit(False)).alias("gc_differs"), F.coalesce(stated != F.length(s), F.lit(False)).alias("length_differs"))
    return rows.where("gc_differs OR length_differs")


def fasta_database(spark: SparkSession, d: str) -> DataFrame:
    """SRC-03: FASTA records as genes under their name, the last of equal names."""
    rows = letters(spark, d, "gene_id", "symbol").select("id", "s", key().alias("k")).where(F.col("k").isNotNull())
    header = F.concat(F.lit(">"), F.md5("k"), F.when(F.col("id") % 3 == 0, F.lit(" | organism=Zea mays")).otherwise(""), F.lit(" | accession=A"), "id")
    records = files.parse_text(rows.select(F.concat(header, F.lit("\n"), "s").alias("text")))
    return files.as_database(records).select("symbol", "accession", "organism", "trait", "sequence_type", F.length("sequence").cast("bigint").alias("n"))


def json_databases(spark: SparkSession, d: str) -> DataFrame:
    """SRC-04, SRC-10: records of JSON databases in their four shapes: a list under ``genes``, a bare list, a mapping, one record."""
    record = F.to_json(F.struct("gene_id", "symbol", "organism", "sequence", "sequence_type", "source"))
    shape = F.col("id") % 4
    text = F.when(shape == 0, F.concat(F.lit('{"genes":['), record, F.lit("]}"))).when(shape == 1, F.concat(F.lit("["), record, F.lit(",null,5]")))
    text = text.when(shape == 2, F.concat(F.lit('{"X'), "id", F.lit('":'), record, F.lit("}"))).otherwise(record)
    rows = services.canonical(services.gene_records(table(spark, d, "genes").select(text.alias("value"))))
    return rows.select("gene_id", "symbol", "organism", "sequence_type", F.col("length").cast("bigint").alias("length"), "source")


def v2_records(spark: SparkSession, d: str) -> DataFrame:
    """SRC-08: catalogue rows as nested records of version 2."""
    two = services.to_v2(table(spark, d, "genes"))
    first = F.get("sequences", F.lit(0))
    return two.select("_id", F.col("core.symbol").alias("symbol"), F.size("sequences").cast("bigint").alias("n_sequences"), first["type"].alias("type"), first["sequence_hash"].alias("sequence_hash"), first["gc_content"].alias("gc_content"))


def v2_flat(spark: SparkSession, d: str) -> DataFrame:
    """SRC-09, FLT-12: records of version 2 that have a DNA sequence, in flat form."""
    return services.from_v2(services.sequence_type_filter(services.to_v2(table(spark, d, "genes")), "dna")).select("gene_id", "symbol", "organism", F.col("length").cast("bigint").alias("length"), "source")


def database_versions(spark: SparkSession, d: str) -> DataFrame:
    """SRC-09: how many database texts are of each version."""
    text = F.when(F.col("id") % 3 == 0, '{"schema":{"version":"2.1"},"genes":[]}').when(F.col("id") % 3 == 1, '{"metadata":{"schema_version":"2"}}').otherwise(F.col("record"))
    return table(spark, d, "genes").select(services.version(text).alias("version")).groupBy("version").agg(F.count("*").alias("n"))


def uploads(spark: SparkSession, d: str) -> DataFrame:
    """SRC-22: uploaded bytes as text, UTF-8 or else Latin-1, those beyond the cap refused."""
    text = F.concat(F.lit("é "), F.coalesce("gene_id", F.lit("none")))
    content = F.when(F.col("id") % 2 == 0, F.encode(text, "UTF-8")).otherwise(F.encode(text, "ISO-8859-1"))
    rows = table(spark, d, "genes").where(F.coalesce(F.col("gene_id").rlike("^[!-~ ]*$"), F.lit(True))).select(F.col("id").cast("string").alias("path"), content.alias("content"))
    return files.decode_uploads(rows.withColumn("length", F.length("content")), 16)


def species_list(spark: SparkSession, d: str) -> DataFrame:
    """SRC-20: names of a list with comments and blank lines."""
    line = F.explode(F.array(F.concat(F.lit("# "), "category"), F.lit("   "), F.concat(F.lit("  "), "name", F.lit(" "))))
    return files.species_names(table(spark, d, "species").select(line.alias("value")))


def search_terms(spark: SparkSession, d: str) -> DataFrame:
    """SRC-11: the searches by which each retired key would be resolved."""
    rows = table(spark, d, "retired_genes").select(F.trim("gene_key").alias("accession")).where(F.col("accession") != "").distinct()
    terms = files.search_terms(F.col("accession"), F.lit("Zea mays"))
    return rows.select("accession", F.size(terms).cast("bigint").alias("n_terms"), F.array_join(terms, " OR ").alias("terms"))


def ncbi_types(spark: SparkSession, d: str) -> DataFrame:
    """SRC-11, SRC-12: FASTA of a sequence service as genes, each type collected by its own cap; here a tenth of the real caps, so that some are left out."""
    out = None
    for kind in schema.CAPS:
        rows = letters(spark, d, "sequence_type").where(seq.normal_type(F.col("sequence_type"), F.col("s")) == kind)
        records = files.parse_text(rows.select(F.concat(F.lit(">XM_"), "id", F.lit(".1 PREDICTED: Zea mays protein [Zea mays]\n"), "s").alias("text")))
        one = files.ncbi_records(records, kind, {k: v // 200 for k, v in schema.CAPS.items()}).select("gene_id", "organism", "sequence_type", F.col("length").cast("bigint").alias("length"))
        out = one if out is None else out.unionByName(one)
    return out


def factor_answers(spark: SparkSession, d: str) -> DataFrame:
    """SRC-15, JON-13: answers of a transcription-factor service in their three shapes, with the description of the family."""
    family = F.element_at(F.array(F.lit("MYB"), F.lit("WRKY"), F.lit("ABC")), (F.col("id") % 3 + 1).cast("int"))
    entry = F.to_json(F.struct(F.concat(F.lit("T"), "id").alias("tf_id"), F.col("gene_id").alias("locus"), family.alias("family")))
    shape = F.col("id") % 4
    text = F.when(shape == 0, F.concat(F.lit('{"data":['), entry, F.lit("]}"))).when(shape == 1, F.concat(F.lit('{"results":['), entry, F.lit("]}"))).otherwise(F.concat(F.lit("["), entry, F.lit(',{"family":"no id"}]')))
    known = spark.createDataFrame(FAMILIES, "family string, text string")
    return services.tf_answers(table(spark, d, "genes").select(text.alias("value")), known, "Zea mays").select("gene_id", "symbol", "description")


def record_classes(spark: SparkSession, d: str) -> DataFrame:
    """FLT-04: the class of every record, by its declared type, its alphabet or the kind of its metadata."""
    return table(spark, d, "genes").select("id", seq.record_class(F.col("sequence"), F.col("sequence_type"), F.col("source"), F.col("gene_id")).alias("class"))


def distinct_organisms(spark: SparkSession, d: str) -> DataFrame:
    """AGG-10: the organisms, and sequence types, that occur, each once."""
    rows = table(spark, d, "genes")
    one = lambda c: rows.select(F.lit(c).alias("field"), F.col(c).alias("value")).where(F.col(c) != "").distinct()
    return one("organism").unionByName(one("sequence_type"))


def suite_groups(spark: SparkSession, d: str) -> DataFrame:
    """AGG-04, FLT-06: ids of the suite's records by type: the first twenty sequences of twenty letters at least; the limit is the feature."""
    rows = letters(spark, d).where(F.length("s") >= 20).orderBy("id").limit(20)
    return rows.groupBy(seq.detect_type(F.col("s")).alias("kind")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("ids"))


def master_records(spark: SparkSession, d: str) -> DataFrame:
    """SET-03, SNK-11: records left by each rule of the master merge, and their organisms."""
    rows = table(spark, d, "genes").select("gene_id", "symbol", "organism", "sequence_type", "source")
    out = None
    for rule in ops.RULES:
        one = ops.master_totals(ops.deduplicated(rows, rule)).select(F.lit(rule).alias("rule"), "total_genes", "total_species")
        out = one if out is None else out.unionByName(one)
    return out


def longest_frames(spark: SparkSession, d: str) -> DataFrame:
    """SRT-03: each gene's reading frames by length, the longest first; ties by strand, frame and start."""
    from helixspark.plans.patterns import orf_scan

    order = Window.partitionBy("id").orderBy(F.desc("n"), F.left("frame", F.lit(1)), "frame", "start")
    return orf_scan(spark, d).select("id", F.row_number().over(order).cast("bigint").alias("rank"), "frame", "start", "n")


def motifs_in_order(spark: SparkSession, d: str) -> DataFrame:
    """SRT-04: each gene's motifs by start; ties by motif."""
    from helixspark.plans.patterns import motif_hits

    order = Window.partitionBy("id").orderBy("start", "motif")
    return motif_hits(spark, d).select("id", F.row_number().over(order).cast("bigint").alias("place"), "start", "motif")


def clamped_hits(spark: SparkSession, d: str) -> DataFrame:
    """SRT-01: the best hits of each query sequence, as many as its last hit's run asks for, clamped to 1 to 8."""
    rows = table(spark, d, "search_hits").select("hit_id", "query_seq", "identity_percent", "run_id")
    rank = F.row_number().over(Window.partitionBy("query_seq").orderBy(F.desc_nulls_last("identity_percent"), "hit_id"))
    asked = rows.groupBy("query_seq").agg(F.max(F.struct("hit_id", "run_id"))["run_id"].alias("run"))
    wanted = asked.select("query_seq", F.greatest(F.lit(1), F.least(F.lit(8), F.coalesce(F.col("run") % 12, F.lit(1)))).alias("n"))
    top = rows.withColumn("rank", rank.cast("bigint")).where("rank <= 8")
    return top.join(wanted, F.col("n").isNotNull() & wanted["query_seq"].eqNullSafe(top["query_seq"])).where("rank <= n").select("hit_id", "rank")


QUERIES = {f.__name__: f for f in (
    fasta_records, header_warnings, fasta_database, json_databases, v2_records, v2_flat, database_versions, uploads, species_list, search_terms, ncbi_types, factor_answers, record_classes,
    distinct_organisms, suite_groups, master_records, longest_frames, motifs_in_order, clamped_hits)}

_GC = sql_count("GC", "substring(s, 1, 100)")
_HEADER = f"CAST(floor(100 * {_GC} / length(substring(s, 1, 100))) AS BIGINT)"
_TYPES = _CATALOGUE["normalised"].split(" AS dt FROM genes")[0].rsplit("AS w, ", 1)[1]
_NORMAL = """CASE WHEN coalesce(dt, '') = '' THEN CASE WHEN regexp_full_match(s, '[ACGTUN]+') THEN CASE WHEN contains(s, 'U') THEN 'rna' ELSE 'dna' END ELSE 'protein' END
 WHEN dt IN ('dna', 'rna', 'protein') THEN dt ELSE 'dna' END"""
_DETECT = """CASE WHEN regexp_full_match(s, '[ATGCN]+') THEN 'dna' WHEN regexp_full_match(s, '[ACDEFGHIKLMNPQRSTVWYBXZ*]+') THEN 'protein' WHEN regexp_matches(s, '[BJOUXZ*]') THEN 'protein' ELSE 'dna' END"""
_ORGANISM = "coalesce(organism, 'Unknown')"


def _oracles() -> dict[str, str]:
    from helixspark.plans.patterns import ORACLE as patterns

    caps = ", ".join(f"('{k}', {v // 200})" for k, v in schema.CAPS.items())
    declared = " ".join(f"WHEN lower(coalesce(sequence_type, '')) IN ({', '.join(repr(w) for w in ws)}) THEN '{t}'" for t, ws in schema.DECLARED.items())
    return {
        "fasta_records": f"SELECT 'G' || id AS name, coalesce(CAST(length AS VARCHAR), '?') || ' bp' AS stated, {_HEADER} || '%' AS gc, 'true' AS flag, md5(s) AS sequence_md5 FROM {SQL_LETTERS}",
        "header_warnings": f"""
SELECT * FROM (SELECT 'G' || id AS name, CASE WHEN {_DETECT} = 'dna' THEN abs({_HEADER} - 100 * ({sql_count('GC')} / length(s))) > 0.2 ELSE false END AS gc_differs, coalesce(length <> length(s), false) AS length_differs FROM {SQL_LETTERS})
WHERE gc_differs OR length_differs""",
        "fasta_database": f"""
WITH r AS (SELECT s, md5({SQL_KEY}) AS symbol, CASE WHEN id % 3 = 0 THEN 'Zea mays' ELSE 'Unknown' END AS organism, 'A' || id AS accession,
 md5({SQL_KEY}) || CASE WHEN id % 3 = 0 THEN ' | organism=Zea mays' ELSE '' END || ' | accession=A' || id AS h FROM {SQL_LETTERS} WHERE {SQL_KEY} IS NOT NULL)
SELECT symbol, accession, organism, 'Unknown' AS trait, {_DETECT} AS sequence_type, length(s) AS n FROM r QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY h DESC, s DESC) = 1""",
        "json_databases": f"""
SELECT coalesce(nullif(gene_id, ''), nullif(symbol, '')) AS gene_id, coalesce(nullif(symbol, ''), nullif(gene_id, '')) AS symbol, coalesce(nullif(organism, ''), 'Unknown') AS organism,
 {_NORMAL} AS sequence_type, length(s) AS length, coalesce(nullif(source, ''), 'collected') AS source FROM (SELECT *, {_TYPES} AS dt FROM {SQL_LETTERS}) WHERE id % 4 <> 3 OR gene_id IS NOT NULL OR symbol IS NOT NULL""",
        "v2_records": """
SELECT gene_id AS _id, symbol, CASE WHEN has THEN 1 ELSE 0 END AS n_sequences, CASE WHEN has THEN lower(sequence_type) END AS type, CASE WHEN has THEN 'sha256:' || substring(sha256(upper(sequence)), 1, 16) END AS sequence_hash,
 CASE WHEN has THEN (length(sequence) - length(translate(upper(sequence), 'GC', ''))) / length(sequence) END AS gc_content FROM (SELECT *, coalesce(length(sequence), 0) > 0 AS has FROM genes)""",
        "v2_flat": "SELECT gene_id, symbol, organism, length(sequence) AS length, source FROM genes WHERE lower(sequence_type) = 'dna' AND coalesce(length(sequence), 0) > 0",
        "species_list": "SELECT name FROM species WHERE name NOT LIKE '#%'",
        "search_terms": """
WITH r AS (SELECT DISTINCT trim(gene_key) AS a FROM retired_genes WHERE trim(gene_key) <> ''), t AS (SELECT a, regexp_full_match(a, '[A-Z]{1,2}\\d+[A-Z]\\d+', 'i') AS locus, ' AND plants[filter] AND "Zea mays"[Organism]' AS tail FROM r)
SELECT a AS accession, CASE WHEN locus THEN 2 ELSE 1 END AS n_terms, '(' || a || '[Accession])' || tail || CASE WHEN locus THEN ' OR (' || a || '[Gene])' || tail ELSE '' END AS terms FROM t""",
        "ncbi_types": f"""
WITH c(kind, cap) AS (VALUES {caps}), r AS (SELECT id, s, {_NORMAL} AS kind FROM (SELECT *, {_TYPES} AS dt FROM {SQL_LETTERS}))
SELECT 'XM_' || id || '.1' AS gene_id, 'Zea mays' AS organism, kind AS sequence_type, length(s) AS length FROM r JOIN c USING (kind) WHERE length(s) <= cap""",
        "factor_answers": """
SELECT coalesce(nullif(gene_id, ''), 'T' || id) AS gene_id, 'T' || id AS symbol, ['MYB factor', 'WRKY factor', 'ABC transcription factor'][id % 3 + 1] AS description FROM genes""",
        "record_classes": f"""
SELECT id, CASE WHEN s <> '' THEN CASE {declared} WHEN regexp_matches(s, '[BFJLOUZX]') THEN 'protein' WHEN regexp_full_match(s, '[ACGTUN]+') THEN 'dna' WHEN regexp_full_match(s, '[ACGTURYSWKMBDHVN]+') THEN 'rna' ELSE 'unknown' END
 WHEN contains(lower(coalesce(source, '')), 'geo') OR coalesce(starts_with(gene_id, 'GSE'), false) THEN 'metadata_geo' WHEN contains(lower(coalesce(source, '')), 'atlas') THEN 'metadata_atlas' ELSE 'metadata' END AS class
FROM (SELECT *, upper(trim(coalesce(sequence, ''))) AS s FROM genes)""",
        "distinct_organisms": "SELECT DISTINCT 'organism' AS field, organism AS value FROM genes WHERE organism <> '' UNION ALL SELECT DISTINCT 'sequence_type', sequence_type FROM genes WHERE sequence_type <> ''",
        "suite_groups": f"SELECT {_DETECT} AS kind, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM (SELECT id, s FROM {SQL_LETTERS} WHERE length(s) >= 20 ORDER BY id LIMIT 20) GROUP BY 1",
        "master_records": f"""
SELECT 'key_organism' AS rule, count(DISTINCT coalesce(gene_id, '') || '::' || {_ORGANISM}) AS total_genes, count(DISTINCT {_ORGANISM}) AS total_species FROM genes
UNION ALL SELECT 'key_or_record', count(DISTINCT coalesce('k' || coalesce(nullif(gene_id, ''), nullif(symbol, '')) || '::' || coalesce(organism, ''), 'r' || CAST({{'a': gene_id, 'b': symbol, 'c': organism, 'd': sequence_type, 'e': source}} AS VARCHAR))),
 count(DISTINCT {_ORGANISM}) FROM genes UNION ALL SELECT 'none', count(*), count(DISTINCT {_ORGANISM}) FROM genes""",
        "longest_frames": f"SELECT id, row_number() OVER (PARTITION BY id ORDER BY n DESC, left(frame, 1), frame, start) AS rank, frame, start, n FROM ({patterns['orf_scan']})",
        "motifs_in_order": f"SELECT id, row_number() OVER (PARTITION BY id ORDER BY start, motif) AS place, start, motif FROM ({patterns['motif_hits']})",
        "clamped_hits": """
WITH n AS (SELECT query_seq, greatest(1, least(8, coalesce(arg_max(run_id, hit_id) % 12, 1))) AS n FROM search_hits GROUP BY query_seq),
r AS (SELECT hit_id, query_seq, row_number() OVER (PARTITION BY query_seq ORDER BY identity_percent DESC NULLS LAST, hit_id) AS rank FROM search_hits)
SELECT hit_id, rank FROM r JOIN n ON n.query_seq IS NOT DISTINCT FROM r.query_seq WHERE rank <= n""",
        "uploads": r"""
SELECT path, CASE WHEN NOT big THEN t END AS text, CASE WHEN big THEN 'too large' END AS fault FROM (SELECT CAST(id AS VARCHAR) AS path, 'é ' || coalesce(gene_id, 'none') AS t,
 length('é ' || coalesce(gene_id, 'none')) + CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END > 16 AS big FROM genes WHERE coalesce(regexp_full_match(gene_id, '[!-~ ]*'), true))""",
        "database_versions": """
WITH v AS (SELECT CASE WHEN id % 3 < 2 THEN '2' WHEN json_valid(record) AND coalesce(json_extract_string(record, '$.schema.version'), json_extract_string(record, '$.metadata.schema_version'), json_extract_string(record, '$.version')) LIKE '2%' THEN '2' ELSE '1' END AS version FROM genes)
SELECT version, count(*) AS n FROM v GROUP BY version""",
    }


ORACLE = _oracles()
