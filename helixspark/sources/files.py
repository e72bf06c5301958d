"""Sequence files: FASTA, uploads, species lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark import schema
from helixspark.functions import seq


def header_metadata(header: Column) -> Column:
    """SRC-02: ``map<string,string>`` of a header ``name | key=value | flag``; the last of equal keys wins."""
    parts = F.filter(F.transform(F.split(header, r"\|"), lambda p: F.trim(p)), lambda p: p != "")

    def entry(p: Column) -> Column:
        key, at = F.lower(F.trim(F.split_part(p, F.lit("="), F.lit(1)))), F.instr(p, "=")
        return F.when(at > 0, F.struct(key.alias("key"), F.trim(F.substr(p, at + 1)).alias("value"))).otherwise(
            F.struct(F.replace(F.lower(p), F.lit(" "), F.lit("_")).alias("key"), F.lit("true").alias("value")))

    first = F.when(F.size(parts) > 0, F.array(F.struct(F.lit("name").alias("key"), F.get(parts, F.lit(0)).alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    entries = F.concat(first, F.transform(F.slice(parts, 2, 1_000_000), entry))
    # of equal keys only the last stays, whatever the session's policy on duplicate keys
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, 1_000_000), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def parse_text(df: DataFrame, text: str = "text", one_per_line: bool = False) -> DataFrame:
    """SRC-01: ``(header, metadata, sequence)`` of every record in texts that fit a row (pasted or uploaded).

    Lines are stripped, empty ones skipped, headers without a sequence
    dropped; an empty header is called ``Sequence``, text before any header,
    or without one, ``Sequence 1``.  ``one_per_line`` takes each line of a
    text without headers as a sequence of its own.
    """
    lines = F.filter(F.transform(F.split(F.trim(text), r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")
    joined = F.array_join(lines, "\n")
    none = ~F.concat(F.lit("\n"), joined).contains("\n>")
    blocks = F.split(F.concat(F.lit("\n"), joined), r"\n>")
    head = F.transform(F.slice(blocks, 2, 100_000_000), lambda b: F.struct(F.split_part(b, F.lit("\n"), F.lit(1)).alias("h"), F.when(F.instr(b, "\n") > 0, F.substr(b, F.instr(b, "\n"))).otherwise("").alias("s"), F.lit(True).alias("given")))
    lead = F.struct(F.lit("Sequence 1").alias("h"), F.get(blocks, F.lit(0)).alias("s"), F.lit(False).alias("given"))
    records = F.concat(F.array(lead), head)
    if one_per_line:
        single = F.transform(lines, lambda x, i: F.struct(F.concat(F.lit("Sequence "), i + 1).alias("h"), x.alias("s"), F.lit(False).alias("given")))
        records = F.when(none, single).otherwise(records)
    each = df.select(F.explode(records).alias("r")).select(F.trim("r.h").alias("h"), F.replace("r.s", F.lit("\n"), F.lit("")).alias("sequence"), "r.given").where(F.col("sequence") != "")
    header = F.when(F.col("h") == "", "Sequence").otherwise(F.col("h"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return each.select(header.alias("header"), F.when(F.col("given"), header_metadata(header)).otherwise(empty).alias("metadata"), "sequence")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """SRC-01: Records of FASTA files of any size: files split at headers, so one file is read by many tasks."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("v"))
    header = F.trim(F.regexp_extract("v", r"^[^\r\n]*", 0))
    body = F.regexp_replace(F.regexp_replace("v", r"^[^\r\n]*", ""), r"\s+", "")
    named = rows.select(F.when(header == "", "Sequence").otherwise(header).alias("header"), body.alias("sequence")).where(F.col("sequence") != "")
    return named.select("header", header_metadata(F.col("header")).alias("metadata"), "sequence")


def as_database(records: DataFrame) -> DataFrame:
    """SRC-03: Records as genes under their name; of equal names the one with the greatest header stays."""
    meta = lambda k, d: F.coalesce(F.element_at("metadata", k), F.lit(d))
    rows = records.select(
        meta("name", "Sequence").alias("symbol"), meta("accession", "N/A").alias("accession"), meta("organism", "Unknown").alias("organism"), meta("trait", "Unknown").alias("trait"),
        F.upper("sequence").alias("sequence"), seq.detect_type(F.col("sequence")).alias("sequence_type"), F.col("header").alias("description"))
    return rows.groupBy("symbol").agg(F.max_by(F.struct("accession", "organism", "trait", "sequence", "sequence_type", "description"), F.struct("description", "sequence")).alias("r")).select("symbol", "r.*")


def read_uploads(spark: SparkSession, path: str, most_bytes: int = 5_000_000) -> DataFrame:
    """SRC-22: ``(path, text, fault)``: files as text, UTF-8 or else Latin-1; larger ones give the fault ``too large`` and no text."""
    return decode_uploads(spark.read.format("binaryFile").load(path), most_bytes)


def decode_uploads(rows: DataFrame, most_bytes: int = 5_000_000) -> DataFrame:
    """``read_uploads`` of rows ``(path, length, content)``."""
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    small = F.col("length") <= most_bytes
    return rows.select("path", F.when(small, text).alias("text"), F.when(~small, "too large").alias("fault"))


def read_species(spark: SparkSession, path: str) -> DataFrame:
    """SRC-20: Names in a list, one a line; blank lines and those that start with ``#`` are skipped."""
    return species_names(spark.read.text(path))


def species_names(lines: DataFrame) -> DataFrame:
    """``read_species`` of lines ``(value)``."""
    name = F.trim("value")
    return lines.where((name != "") & ~name.startswith("#")).select(name.alias("name"))


#: Fixed value: the filter that keeps a search to plants.
PLANTS = "plants[filter]"


def search_terms(accession: Column, organism: Column | None = None, plants_only: bool = True) -> Column:
    """SRC-11: The searches that resolve an accession, in the order they are tried: as an accession, then, where it reads like a locus, as a gene."""
    locus = accession.rlike(r"(?i)^[A-Z]{1,2}\d+[A-Z]\d+$")
    tail = F.lit(f" AND {PLANTS}" if plants_only else "")
    if organism is not None:
        tail = F.concat(tail, F.coalesce(F.concat(F.lit(' AND "'), F.nullif(organism, F.lit("")), F.lit('"[Organism]')), F.lit("")))
    term = lambda field: F.concat(F.lit("("), accession, F.lit(f"[{field}])"), tail)
    return F.array_compact(F.array(term("Accession"), F.when(locus, term("Gene"))))


def ncbi_records(records: DataFrame, kind: str = "dna", longest: dict[str, int] | None = None) -> DataFrame:
    """SRC-11, SRC-12: FASTA records of a nucleotide or protein service as genes; sequences beyond the type's cap are left out.

    The caps keep whole chromosomes out of the catalogue.
    """
    caps = schema.CAPS | (longest or {})
    header = F.col("header")
    gene = F.split_part(header, F.lit(" "), F.lit(1))
    organism = F.coalesce(F.nullif(F.regexp_extract(header, r"\[([^\]]+)\]", 1), F.lit("")), F.nullif(F.regexp_extract(header, r"^\S+\s+(?:PREDICTED:\s+)?([A-Z][a-z]+ [a-z]+)", 1), F.lit("")), F.lit("Unknown"))
    s = F.upper(F.regexp_replace("sequence", r"\s+", ""))
    rows = records.select(gene.alias("gene_id"), gene.alias("symbol"), organism.alias("organism"), s.alias("sequence"), F.lit(kind).alias("sequence_type"), header.alias("description"), F.lit("NCBI").alias("source"), F.length(s).alias("length"))
    return rows.where(F.col("length") <= caps[kind])
