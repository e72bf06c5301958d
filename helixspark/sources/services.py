"""Answers of public services, saved as files, as rows of the gene catalogue.

Each function takes the raw answers as a text column, or reads them with a
built-in reader; nothing here opens a connection.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixspark import schema
from helixspark.functions import seq


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """SRC-05: catalogue records, one JSON object a line, under the declared schema; broken lines keep their text in ``_corrupt_record``."""
    declared = T.StructType([*schema.GENE.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(declared).option("mode", "PERMISSIVE").json(path)


def gene_records(df: DataFrame, text: str = "value") -> DataFrame:
    """SRC-04, SRC-10: ``record`` variants of JSON databases: an object with ``genes`` or other lists of records, an array, a mapping of records, or one record.

    Texts that are no JSON, and entries that are no objects, give no rows.
    """
    v = F.try_parse_json(F.col(text))
    rows = df.select(v.alias("v")).where(F.col("v").isNotNull())
    lists = [F.try_variant_get("v", f"$.{k}", "array<variant>") for k in ("genes", "geo", "ensembl", "expression_atlas", "ncbi", "records")]
    none = F.array().cast("array<variant>")
    listed = F.concat(*[F.coalesce(x, none) for x in lists])
    mapping = F.try_variant_get("v", "$", "map<string,variant>")
    is_record = F.coalesce(*[F.try_variant_get("v", f"$.{k}", "string") for k in ("gene_id", "symbol", "accession")]).isNotNull()
    entries = (
        F.when(F.try_variant_get("v", "$", "array<variant>").isNotNull(), F.try_variant_get("v", "$", "array<variant>"))
        .when(F.size(listed) > 0, listed)
        .when(is_record, F.array("v"))
        .otherwise(F.coalesce(F.map_values(mapping), none))
    )
    each = rows.select(F.explode(entries).alias("record"))
    return each.where(F.schema_of_variant("record").startswith("OBJECT"))


def canonical(records: DataFrame) -> DataFrame:
    """SRC-10, FLT-05: Loose records in the catalogue's columns: the first field that is neither null nor empty gives the value; without letters no row."""
    get = lambda k: F.nullif(F.try_variant_get("record", f"$.{k}", "string"), F.lit(""))
    first = lambda *ks: F.coalesce(*[get(k) for k in ks])
    s = F.upper(F.regexp_replace(F.coalesce(get("sequence"), get("seq")), r"\s+", ""))
    return records.select(
        first("gene_id", "accession", "symbol").alias("gene_id"), first("symbol", "gene_id", "accession").alias("symbol"), F.coalesce(first("organism", "species"), F.lit("Unknown")).alias("organism"),
        s.alias("sequence"), seq.normal_type(first("sequence_type", "type"), s).alias("sequence_type"), F.coalesce(first("description", "title"), F.lit("")).alias("description"),
        F.coalesce(get("source"), F.lit("collected")).alias("source"), get("accession").alias("accession"), F.length(s).alias("length"), F.to_json("record").alias("record")).where(F.col("sequence") != "")


def version(text: Column) -> Column:
    """SRC-09: Schema version of a database text: ``2`` where it says so, else ``1``."""
    v = F.coalesce(F.get_json_object(text, "$.schema.version"), F.get_json_object(text, "$.metadata.schema_version"), F.get_json_object(text, "$.version"))
    return F.when(v.startswith("2"), "2").otherwise("1")


def to_v2(df: DataFrame) -> DataFrame:
    """SRC-08: Catalogue rows as nested records of version 2: core, sequences, metadata."""
    taxon = seq.taxonomy(F.col("organism"))
    organism = F.struct(F.col("organism").alias("scientific_name"), taxon["genus"].alias("genus"), taxon["species"].alias("species"))
    one = F.struct(F.lower("sequence_type").alias("type"), F.length("sequence").alias("length"), F.concat(F.lit("sha256:"), seq.sha_prefix(F.col("sequence"))).alias("sequence_hash"), seq.gc_fraction(F.upper("sequence")).alias("gc_content"))
    return df.select(
        F.col("gene_id").alias("_id"), F.struct("gene_id", "symbol", F.col("description").alias("name"), organism.alias("organism")).alias("core"),
        F.when(F.coalesce(F.length("sequence"), F.lit(0)) > 0, F.array(one)).otherwise(F.array().cast("array<struct<type:string,length:int,sequence_hash:string,gc_content:double>>")).alias("sequences"),
        F.struct("source").alias("metadata"))


def from_v2(df: DataFrame) -> DataFrame:
    """SRC-09: Version 2 records in flat form; they carry no letters."""
    first = F.get("sequences", F.lit(0))
    return df.select(F.col("core.gene_id").alias("gene_id"), F.col("core.symbol").alias("symbol"), F.col("core.organism.scientific_name").alias("organism"), first["type"].alias("sequence_type"), first["length"].alias("length"), F.col("metadata.source").alias("source"))


def sequence_type_filter(df: DataFrame, kind: str) -> DataFrame:
    """FLT-12: Version 2 records with a sequence of one type."""
    return df.where(F.exists("sequences", lambda s: s["type"] == kind))


_UNIPROT = (
    "primaryAccession string, entryType string, annotationScore double, organism struct<scientificName string>, sequence struct<value string>, "
    "genes array<struct<geneName struct<value string>, synonyms array<struct<value string>>>>, keywords array<struct<name string>>, "
    "proteinDescription struct<recommendedName struct<fullName struct<value string>>, submissionNames array<struct<fullName struct<value string>>>>, "
    "uniProtKBCrossReferences array<struct<database string, id string, properties array<struct<key string, value string>>>>, "
    "comments array<struct<commentType string, texts array<struct<value string>>, subcellularLocations array<struct<location struct<value string>>>>>"
)


def uniprot(df: DataFrame, text: str = "value") -> DataFrame:
    """SRC-13: Pages of protein entries (``{"results": [...]}``) as genes; entries without accession or letters give no row."""
    e = df.select(F.explode(F.from_json(text, f"struct<results array<struct<{_UNIPROT.replace(' string', ': string').replace(' double', ': double').replace(' struct<', ': struct<').replace(' array<', ': array<')}>>>".replace("results array", "results: array"))["results"]).alias("e")).select("e.*")
    refs = lambda db: F.transform(F.filter("uniProtKBCrossReferences", lambda r: r["database"] == db), lambda r: r["id"])
    prop = lambda r, k: F.get(F.transform(F.filter(r["properties"], lambda p: p["key"] == k), lambda p: p["value"]), F.lit(0))
    go = F.transform(F.filter("uniProtKBCrossReferences", lambda r: r["database"] == "GO"), lambda r: F.struct(r["id"].alias("id"), prop(r, "GoTerm").alias("term"), prop(r, "GoEvidenceType").alias("aspect")))
    where = F.flatten(F.transform(F.filter("comments", lambda c: c["commentType"] == "SUBCELLULAR LOCATION"), lambda c: F.transform(c["subcellularLocations"], lambda x: x["location"]["value"])))
    what = F.get(F.transform(F.filter("comments", lambda c: c["commentType"] == "FUNCTION"), lambda c: F.get(c["texts"], F.lit(0))["value"]), F.lit(0))
    gene = F.get("genes", F.lit(0))
    name = F.coalesce(gene["geneName"]["value"], F.get(gene["synonyms"], F.lit(0))["value"], F.col("primaryAccession"))
    full = F.coalesce(F.col("proteinDescription.recommendedName.fullName.value"), F.get("proteinDescription.submissionNames", F.lit(0))["fullName"]["value"], what)
    words = F.transform("keywords", lambda k: k["name"])
    rows = e.where((F.coalesce("primaryAccession", F.lit("")) != "") & (F.coalesce("sequence.value", F.lit("")) != ""))
    return rows.select(
        F.col("primaryAccession").alias("gene_id"), name.alias("symbol"), F.col("organism.scientificName").alias("organism"), F.upper("sequence.value").alias("sequence"), F.lit("protein").alias("sequence_type"),
        full.alias("description"), F.length("sequence.value").alias("length"), F.lit("uniprot").alias("source"),
        F.to_json(F.struct(go.alias("go_terms"), words.alias("keywords"), where.alias("subcellular_location"), what.alias("function"), F.col("entryType").contains("reviewed (").alias("reviewed"))).alias("annotations"),
        F.transform(refs("KEGG"), lambda k: F.struct(k.alias("id"), F.lit("kegg").alias("source"))).alias("pathways"), F.get(refs("Ensembl"), F.lit(0)).alias("ensembl"), F.slice(words, 1, 10).alias("traits"))


def kegg(spark: SparkSession, path: str, organism: str, code: str) -> DataFrame:
    """SRC-14: Flat files of entries that end with ``///``: keys in the first twelve columns, continued lines below.

    An entry without letters is kept if it has pathways or orthologues.
    """
    columns = "gene_id string, symbol string, organism string, sequence string, sequence_type string, description string, length int, source string, pathways array<struct<id string, name string, source string>>, ko_ids array<string>, traits array<string>".replace(" string", ": string").replace(" int", ": int").replace(" array<", ": array<")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for entry in batch["value"]:
                fields: dict[str, list[str]] = {}
                key = ""
                for line in (entry or "").split("\n"):
                    key = line[:12].strip() or key
                    if key:
                        fields.setdefault(key, []).append(line[12:].strip())
                name = (fields.get("ENTRY") or [""])[0].split()
                if not name:
                    continue
                pairs = [p.split(None, 1) for p in fields.get("PATHWAY", [])]
                paths = [{"id": p[0], "name": p[1], "source": "kegg"} for p in pairs if len(p) == 2]
                ko = [p.split()[0] for p in fields.get("ORTHOLOGY", []) if p]
                kind = "dna" if "NTSEQ" in fields else "protein"
                letters = "".join(fields.get("NTSEQ", fields.get("AASEQ", []))[1:]).replace(" ", "").upper()
                if letters or paths or ko:
                    symbol = (fields.get("NAME") or fields.get("SYMBOL") or name)[0].split(",")[0].strip()
                    out.append((f"{code}:{name[0]}", symbol, organism, letters, kind if letters else "", " ".join(fields.get("DEFINITION", [])), len(letters), "kegg", paths, ko, [p["name"] for p in paths[:5]]))
            yield pd.DataFrame(out, columns=["gene_id", "symbol", "organism", "sequence", "sequence_type", "description", "length", "source", "pathways", "ko_ids", "traits"])

    return spark.read.option("lineSep", "\n///\n").text(path).mapInPandas(parse, columns)


def tf_families(spark: SparkSession, path: str, families: DataFrame, organism: str) -> DataFrame:
    """SRC-15, JON-13: Tab-separated transcription factors (``TF_ID, Gene_ID, Family``; gzip is fine) with their family's description.

    ``families(family, text)`` is a dimension; the planner broadcasts it if it is small.
    """
    rows = spark.read.csv(path, sep="\t", header=True)
    rows = rows.select(F.col("TF_ID").alias("tf_id"), F.coalesce("Gene_ID", "TF_ID").alias("gene_id"), F.coalesce("Family", F.lit("Unknown")).alias("family")).where(F.col("tf_id").isNotNull())
    text = F.coalesce("text", F.concat("family", F.lit(" transcription factor")))
    return rows.join(families, "family", "left").select("gene_id", F.col("tf_id").alias("symbol"), F.lit(organism).alias("organism"), F.lit("protein").alias("sequence_type"), text.alias("description"), F.array(F.concat(F.lit("TF:"), "family"), F.lit("transcription_factor")).alias("traits"), F.lit("planttfdb").alias("source"))


def tf_answers(df: DataFrame, families: DataFrame, organism: str, text: str = "value") -> DataFrame:
    """SRC-15: Answers of the transcription-factor service as genes: pages (``{"data": [...]}`` or a list) and searches (``{"results": [...]}``).

    An entry's id is its ``tf_id``, ``id`` or ``gene_id``; without one it gives no row.
    """
    v = F.try_parse_json(F.col(text))
    lists = [F.try_variant_get(v, path, "array<variant>") for path in ("$.data", "$.results", "$")]
    e = df.select(F.explode(F.coalesce(*lists)).alias("v"))
    first = lambda *ks: F.coalesce(*[F.nullif(F.try_variant_get("v", f"$.{k}", "string"), F.lit("")) for k in ks])
    tf = first("tf_id", "id", "gene_id")
    letters = F.upper(F.trim(F.replace(F.coalesce(first("sequence", "protein_seq"), F.lit("")), F.lit("\n"), F.lit(""))))
    rows = e.select(tf.alias("symbol"), F.coalesce(first("gene_id", "locus"), tf).alias("gene_id"), F.coalesce(first("family", "tf_family"), F.lit("Unknown")).alias("family"), first("description").alias("_d"), letters.alias("sequence"))
    rows = rows.where(F.col("symbol").isNotNull()).join(families, "family", "left")
    known = F.coalesce("_d", "text", F.concat("family", F.lit(" transcription factor")))
    return rows.select(
        "gene_id", "symbol", F.lit(organism).alias("organism"), "sequence", F.lit("protein").alias("sequence_type"), known.alias("description"), F.length("sequence").alias("length"),
        F.array(F.concat(F.lit("TF:"), "family"), F.lit("transcription_factor")).alias("traits"), F.lit("planttfdb").alias("source"))


_ARTICLE = (
    "MedlineCitation struct<PMID: string, Article: struct<ArticleTitle: string, Abstract: struct<AbstractText: array<struct<_Label: string, _VALUE: string>>>, "
    "AuthorList: struct<Author: array<struct<LastName: string, ForeName: string>>>, Journal: struct<Title: string, ISOAbbreviation: string, JournalIssue: struct<PubDate: struct<Year: string, MedlineDate: string>>>>, "
    "MeshHeadingList: struct<MeshHeading: array<struct<DescriptorName: string>>>, KeywordList: struct<Keyword: array<string>>>, "
    "PubmedData struct<ArticleIdList: struct<ArticleId: array<struct<_IdType: string, _VALUE: string>>>>"
)


def pubmed(spark: SparkSession, path: str, species: str) -> DataFrame:
    """SRC-16: Articles of XML files, read by the built-in reader; abstracts up to 1000 letters, 10 authors, 20 headings, 15 keywords."""
    rows = spark.read.schema(_ARTICLE).option("rowTag", "PubmedArticle").option("valueTag", "_VALUE").option("attributePrefix", "_").format("xml").load(path)
    a = "MedlineCitation.Article"
    parts = F.transform(F.col(f"{a}.Abstract.AbstractText"), lambda x: F.concat_ws(": ", x["_Label"], F.coalesce(x["_VALUE"], F.lit(""))))
    authors = F.transform(F.filter(F.col(f"{a}.AuthorList.Author"), lambda x: x["LastName"].isNotNull()), lambda x: F.concat_ws(" ", x["LastName"], x["ForeName"]))
    doi = F.get(F.transform(F.filter("PubmedData.ArticleIdList.ArticleId", lambda x: x["_IdType"] == "doi"), lambda x: x["_VALUE"]), F.lit(0))
    date = f"{a}.Journal.JournalIssue.PubDate"
    return rows.where(F.col("MedlineCitation.PMID").isNotNull()).select(
        F.col("MedlineCitation.PMID").alias("pmid"), F.coalesce(f"{a}.ArticleTitle", F.lit("")).alias("title"), F.left(F.array_join(parts, " "), F.lit(1000)).alias("abstract"), F.slice(authors, 1, 10).alias("authors"),
        F.coalesce(f"{a}.Journal.Title", f"{a}.Journal.ISOAbbreviation").alias("journal"), F.coalesce(f"{date}.Year", F.left(f"{date}.MedlineDate", F.lit(4))).try_cast("int").alias("year"), doi.alias("doi"),
        F.slice(F.transform("MedlineCitation.MeshHeadingList.MeshHeading", lambda x: x["DescriptorName"]), 1, 20).alias("mesh_terms"), F.slice("MedlineCitation.KeywordList.Keyword", 1, 15).alias("keywords"), F.lit(species).alias("species"), F.lit("pubmed").alias("source"))


def ensembl(df: DataFrame, text: str = "value") -> DataFrame:
    """SRC-17: Gene lookups: the record's place on its assembly and its canonical transcript, else the first."""
    shape = "struct<id: string, display_name: string, name: string, description: string, biotype: string, assembly_name: string, start: bigint, end: bigint, strand: int, species: string, Transcript: array<struct<id: string, is_canonical: int>>>"
    e = df.select(F.from_json(text, shape).alias("e")).select("e.*").where(F.col("id").isNotNull())
    best = F.coalesce(F.get(F.filter("Transcript", lambda t: t["is_canonical"] == 1), F.lit(0))["id"], F.get("Transcript", F.lit(0))["id"])
    return e.select(F.col("id").alias("gene_id"), F.coalesce("display_name", "name", "id").alias("symbol"), F.initcap(F.replace("species", F.lit("_"), F.lit(" "))).alias("organism"), F.coalesce("description", "biotype", F.lit("")).alias("description"), best.alias("transcript"), F.to_json(F.struct("biotype", F.col("assembly_name").alias("assembly"), "start", "end", "strand")).alias("annotations"), F.lit("Ensembl").alias("source"))


def geo(df: DataFrame, text: str = "value") -> DataFrame:
    """SRC-18: Dataset summaries keyed by their number (``{"result": {...}}``); those with an error, and the list of numbers, are passed over."""
    each = df.select(F.explode(F.try_variant_get(F.try_parse_json(F.col(text)), "$.result", "map<string,variant>")).alias("uid", "v")).where((F.col("uid") != "uids") & F.try_variant_get("v", "$.error", "string").isNull())
    get = lambda *ks: F.coalesce(*[F.try_variant_get("v", f"$.{k}", "string") for k in ks])
    return each.select(F.lit("GEO").alias("source"), F.coalesce(get("accession", "Accession"), F.concat(F.lit("GDS"), "uid")).alias("accession"), F.coalesce(get("title", "Title"), F.lit("")).alias("title"), F.coalesce(get("taxon", "Organism", "entrytype"), F.lit("")).alias("organism"), F.coalesce(get("platform", "Platform"), F.lit("")).alias("platform"), get("n_samples", "samples").alias("samples"))


def atlas(df: DataFrame, text: str = "value") -> DataFrame:
    """SRC-19: Experiments found by a search (``{"entries": [...]}``): the first species stays."""
    each = df.select(F.explode(F.from_json(text, "struct<entries: array<struct<id: string, acc: string, description: string, name: string, fields: struct<species: array<string>>>>>")["entries"]).alias("e")).select("e.*")
    rows = each.select(F.lit("Expression Atlas").alias("source"), F.coalesce("id", "acc").alias("experiment_id"), F.coalesce("description", "name", F.lit("")).alias("title"), F.coalesce(F.get("fields.species", F.lit(0)), F.lit("")).alias("species"))
    return rows.where(F.col("experiment_id").isNotNull())
