import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from helixspark.operators import catalogue, phylogeny, search, variants
from helixspark.sinks import writers
from helixspark.sources import files, services
from helixspark.streaming import ingest


def put(folder, name, text):
    path = os.path.join(folder, name)
    with (gzip.open(path, "wt") if name.endswith(".gz") else open(path, "w")) as f:
        f.write(text)
    return path


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_parse_text(spark):
    got = lambda t, **k: [(r["header"], r["metadata"], r["sequence"]) for r in files.parse_text(texts(spark, t), "value", **k).collect()]
    assert got(">g1 | GC=62% | trait=x=y | long flag\nATG\n\n CC \n>\nTT\n>empty\n") == [("g1 | GC=62% | trait=x=y | long flag", {"name": "g1", "gc": "62%", "trait": "x=y", "long_flag": "true"}, "ATGCC"), ("Sequence", {"name": "Sequence"}, "TT")]
    assert got("ATGC\nGATA") == [("Sequence 1", {}, "ATGCGATA")]
    assert [x[2] for x in got("ATGC\nGATA", one_per_line=True)] == ["ATGC", "GATA"]
    assert got("AA\r\n>b | k=1 | k=2\r\nCC") == [("Sequence 1", {}, "AA"), ("b | k=1 | k=2", {"name": "b", "k": "2"}, "CC")]
    assert got("") == [] and got(None) == []


def test_read_fasta(spark, tmp_path):
    path = put(tmp_path, "a.fasta", ">s1 | organism=X y\nATG\nCCC\n>s2\nMKWV\n>s1 | organism=Z\nTTT\n")
    rows = {r["header"]: r["sequence"] for r in files.read_fasta(spark, path).collect()}
    assert rows == {"s1 | organism=X y": "ATGCCC", "s2": "MKWV", "s1 | organism=Z": "TTT"}
    db = {r["symbol"]: (r["organism"], r["sequence_type"], r["accession"]) for r in files.as_database(files.read_fasta(spark, path)).collect()}
    assert db == {"s1": ("Z", "dna", "N/A"), "s2": ("Unknown", "protein", "N/A")}
    ncbi = files.ncbi_records(files.read_fasta(spark, path), longest={"dna": 4}).collect()
    assert [r["gene_id"] for r in ncbi if r["length"] <= 4] and all(r["length"] <= 4 for r in ncbi)


def test_uploads_and_species(spark, tmp_path):
    (tmp_path / "u").mkdir()
    (tmp_path / "u" / "a").write_bytes("é".encode())
    (tmp_path / "u" / "b").write_bytes(b"\xe9")
    (tmp_path / "u" / "c").write_bytes(b"x" * 50)
    got = {os.path.basename(r["path"]): (r["text"], r["fault"]) for r in files.read_uploads(spark, str(tmp_path / "u"), 40).collect()}
    assert got == {"a": ("é", None), "b": ("é", None), "c": (None, "too large")}
    path = put(tmp_path, "s.txt", "# list\n\n Oryza sativa \nZea mays\n")
    assert [r["name"] for r in files.read_species(spark, path).collect()] == ["Oryza sativa", "Zea mays"]


@pytest.mark.parametrize("text, n", [('{"genes":[{"gene_id":"a","sequence":"AC"},5,{"symbol":"b","seq":"mk"}]}', 2), ('[{"gene_id":"a","sequence":"A"}]', 1), ('{"X":{"sequence":"A"},"Y":{"sequence":"C"}}', 2), ('{"gene_id":"a","sequence":"A"}', 1), ('{"ncbi":[{"gene_id":"a"}],"geo":[{"accession":"b"}]}', 2), ("nope", 0), (None, 0), ("[]", 0)])
def test_json_shapes(spark, text, n):
    assert services.gene_records(texts(spark, text)).count() == n


def test_canonical_and_versions(spark):
    rows = services.canonical(services.gene_records(texts(spark, '[{"accession":"A1","seq":"au gc","title":"t","species":"S"},{"gene_id":"x"},{"symbol":"P","sequence":"MK","sequence_type":"Protein"}]'))).collect()
    assert [(r["gene_id"], r["symbol"], r["sequence"], r["sequence_type"], r["organism"]) for r in rows] == [("A1", "A1", "AUGC", "rna", "S"), ("P", "P", "MK", "protein", "Unknown")]
    assert [r[0] for r in texts(spark, '{"schema":{"version":"2.0"}}', '{"genes":[]}', None).select(services.version(F.col("value"))).collect()] == ["2", "1", "1"]
    flat = spark.createDataFrame([("g", "s", "Oryza sativa", "ATGC", "DNA", "d", "src"), ("h", "t", None, None, None, None, None)], "gene_id string, symbol string, organism string, sequence string, sequence_type string, description string, source string")
    two = services.to_v2(flat)
    assert two.where("_id = 'g'").first()["sequences"][0]["gc_content"] == 0.5
    assert [r["gene_id"] for r in services.sequence_type_filter(two, "dna").collect()] == [] if "gene_id" in two.columns else services.sequence_type_filter(two, "dna").count() == 1
    assert {r["gene_id"]: r["length"] for r in services.from_v2(two).collect()} == {"g": 4, "h": None}


def test_services(spark, tmp_path):
    entry = {"primaryAccession": "P1", "entryType": "UniProtKB reviewed (Swiss-Prot)", "organism": {"scientificName": "Zea"}, "sequence": {"value": "mkv"}, "genes": [{"synonyms": [{"value": "syn"}]}], "keywords": [{"name": "k"}],
             "uniProtKBCrossReferences": [{"database": "GO", "id": "GO:1", "properties": [{"key": "GoTerm", "value": "t"}]}, {"database": "KEGG", "id": "z:1"}], "comments": [{"commentType": "FUNCTION", "texts": [{"value": "does"}]}]}
    row, = services.uniprot(texts(spark, json.dumps({"results": [entry, {"primaryAccession": "P2"}]}))).collect()
    assert (row["gene_id"], row["symbol"], row["sequence"], row["description"], row["pathways"][0]["id"]) == ("P1", "syn", "MKV", "does", "z:1")
    assert json.loads(row["annotations"])["go_terms"] == [{"id": "GO:1", "term": "t"}] and json.loads(row["annotations"])["reviewed"]
    kegg = "ENTRY       100  CDS\nNAME        abc, x\nPATHWAY     map1  Path one\n            map2  Path two\nNTSEQ       6\n            atg\n            ccc\n///\nENTRY       101\nNAME        none\n///\n"
    got = services.kegg(spark, put(tmp_path, "k.txt", kegg), "Zea", "zma").collect()
    assert [(r["gene_id"], r["symbol"], r["sequence"], len(r["pathways"])) for r in got] == [("zma:100", "abc", "ATGCCC", 2)]
    tsv = put(tmp_path, "t.tsv.gz", "TF_ID\tGene_ID\tFamily\nT1\tG1\tMYB\nT2\t\tABC\n")
    fam = spark.createDataFrame([("MYB", "a MYB factor")], "family string, text string")
    assert {(r["symbol"], r["description"]) for r in services.tf_families(spark, tsv, fam, "Zea").collect()} == {("T1", "a MYB factor"), ("T2", "ABC transcription factor")}
    xml = """<Set><PubmedArticle><MedlineCitation><PMID>1</PMID><Article><ArticleTitle>T</ArticleTitle><Abstract><AbstractText Label="AIM">a</AbstractText><AbstractText Label="END">b</AbstractText></Abstract>
<AuthorList><Author><LastName>L</LastName><ForeName>F</ForeName></Author></AuthorList><Journal><Title>J</Title><JournalIssue><PubDate><MedlineDate>2001 Jan</MedlineDate></PubDate></JournalIssue></Journal></Article></MedlineCitation>
<PubmedData><ArticleIdList><ArticleId IdType="doi">d/1</ArticleId></ArticleIdList></PubmedData></PubmedArticle></Set>"""
    art, = services.pubmed(spark, put(tmp_path, "p.xml", xml), "Zea").collect()
    assert (art["pmid"], art["abstract"], art["authors"], art["year"], art["doi"]) == ("1", "AIM: a END: b", ["L F"], 2001, "d/1")
    gene, = services.ensembl(texts(spark, '{"id":"G","species":"zea_mays","biotype":"b","start":5,"Transcript":[{"id":"t1","is_canonical":0},{"id":"t2","is_canonical":1}]}')).collect()
    assert (gene["symbol"], gene["organism"], gene["transcript"]) == ("G", "Zea Mays", "t2")
    sets = services.geo(texts(spark, '{"result":{"uids":["1"],"1":{"accession":"GSE1","n_samples":3},"2":{"error":"x"}}}')).collect()
    assert [(r["accession"], r["samples"]) for r in sets] == [("GSE1", "3")]
    found = services.atlas(texts(spark, '{"entries":[{"id":"E1","description":"d","fields":{"species":["A","B"]}},{"name":"none"}]}')).collect()
    assert [(r["experiment_id"], r["species"]) for r in found] == [("E1", "A")]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", "ATGC" * 20, 1), ("b", "", 2), ("c", None, None)], "symbol string, sequence string, n int")
    writers.write_fasta(df, str(tmp_path / "f"))
    assert [(r["header"], len(r["sequence"])) for r in files.read_fasta(spark, str(tmp_path / "f")).collect()] == [("a | length=80bp | GC=50.00%", 80)]
    writers.write_metrics(df.select("symbol", "n"), "symbol", str(tmp_path / "m"))
    assert {tuple(r) for r in spark.read.csv(str(tmp_path / "m"), header=True).collect()} == {("a", "n", "1"), ("b", "n", "2"), ("c", "n", "N/A")}
    writers.write_json(df, str(tmp_path / "j"), ["symbol"])
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    assert "<td>a&lt;</td>" in writers.html_report(spark.createDataFrame([("a<",)], "x string"), "t")
    with pytest.raises(ValueError):
        writers.html_report(df, "t", most=2)
    assert set(writers.write_package(df, str(tmp_path), "all", "symbol")) == {"json", "csv", "parquet"}
    d = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "i string, j string, d double")
    writers.write_matrix(d, str(tmp_path / "x"), "i", "j", "d")
    assert spark.read.csv(str(tmp_path / "x"), header=True).columns == ["i", "a", "b"]
    writers.store(spark.createDataFrame([("a", "dna", 3)], "gene_id string, sequence_type string, length int"), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).where("sequence_type = 'dna'").count() == 1


SCHEMA = "gene_id string, description string, traits array<string>, links map<string,string>, length int"


def test_upsert(spark):
    old = spark.createDataFrame([("a", "old", ["t"], {"x": "1", "y": "2"}, 5), ("b", "keep", None, None, 1)], SCHEMA)
    new = spark.createDataFrame([("a", "", [], {"y": "3"}, 0), ("c", None, None, {}, None)], SCHEMA)
    got = {r["gene_id"]: r for r in catalogue.upsert(old, new, "gene_id").collect()}
    assert tuple(got["a"])[1:] == ("old", ["t"], {"x": "1", "y": "3"}, 5)
    assert tuple(got["b"])[1:] == ("keep", None, None, 1) and got["c"]["description"] is None
    assert catalogue.upsert(old.limit(0), new, "gene_id").count() == 2 and catalogue.upsert(old, new.limit(0), "gene_id").count() == 2


def test_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([("a", "one", ["t"], {"x": "1"}, 5), ("a", "one", ["t"], {"x": "1"}, 5)], SCHEMA)
    rows.coalesce(1).write.mode("append").parquet(src)
    run = lambda: ingest.ingest(spark, src, rows.schema, out, "gene_id", str(tmp_path / "cp")).awaitTermination()
    run()
    assert ingest.current(spark, out).count() == 1
    spark.createDataFrame([("a", "", None, {"y": "2"}, 0), ("b", "two", None, None, 1)], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    run()
    run()
    got = {r["gene_id"]: r for r in ingest.current(spark, out).collect()}
    assert set(got) == {"a", "b"} and got["a"]["description"] == "one" and got["a"]["links"] == {"x": "1", "y": "2"}


def test_catalogue(spark):
    a = spark.createDataFrame([("k", 1), (None, 2)], "key string, v int")
    b = spark.createDataFrame([("k", 9), ("m", 3)], "key string, v int")
    assert {tuple(r) for r in catalogue.priority_union([a, b], ["key"], ["v"]).collect()} == {("k", 1), (None, 2), ("m", 3)}
    assert {tuple(r) for r in catalogue.audit(a, b, "key").where("key IS NOT NULL").collect()} == {("k", "done"), ("m", "unplanned")}
    hits = spark.createDataFrame([("x", 5), ("", 6), (None, 7)], "k string, n int")
    df = spark.createDataFrame([(1, "x", "x"), (2, None, "x"), (3, "", None)], "id int, g string, s string")
    assert {(r["id"], r["n"]) for r in catalogue.attach(df, [F.col("g"), F.col("s")], hits, [F.col("k")], ["n"]).collect()} == {(1, 5), (2, 5), (3, None)}


def test_search_and_variants(spark):
    base = "ATGGCTAAACGTACCGATTTGGCACTGCATCCGATAGGCTTAACG"
    rows = [(1, base), (2, base[:10] + "C" + base[11:]), (3, base[:12] + base[15:]), (4, "T" * 60), (5, None), (6, ""), (7, base)]
    df = spark.createDataFrame(rows, "id bigint, s string")
    found = search.search(df.where("id = 1"), df, results=3).collect()
    assert [(r["id"], r["rank"]) for r in sorted(found, key=lambda r: r["rank"])][:2] == [(7, 1), (2, 2)]
    assert {r["id"] for r in search.containment(df.where("id = 1"), df).collect()} == {7}
    n = df.select("id", F.length("s").alias("n"))
    sizes = [len(s) for _, s in rows if s]
    assert {tuple(r) for r in search.lengths_within(n, n, 3).collect()} == {(m, sum(max(x, m) <= 3 * min(x, m) for x in sizes)) for m in sizes}
    near = {(a, b) for a, x in rows for b, y in rows if x and y and a != b and max(len(x), len(y)) <= 3 * min(len(x), len(y))}
    assert {(r["query"], r["id"]) for r in search.nearest_lengths(n, n, 10).collect()} == near
    pair = spark.createDataFrame([(1, base[:12] + base[15:], base, base[:12] + "---" + base[15:], base), (2, base[:12] + "G" + base[12:20] + "A" + base[21:], base, base[:12] + "G" + base[12:20] + "A" + base[21:], base[:12] + "-" + base[12:]), (3, "ATGTCT", "ATGGCT", "ATGTCT", "ATGGCT")], "pair int, query_s string, s string, query_aligned string, gene_aligned string")
    blocks = {(r["pair"], r["kind"], r["n"], r["bases"], r["frameshift"]) for r in variants.indel_blocks(pair).collect()}
    assert blocks == {(1, "deletion", 3, base[12:15], False), (2, "insertion", 1, "G", True)}
    subs = {(r["pair"], r["r_pos"], r["consequence"], r["class"]) for r in variants.substitutions(pair).collect()}
    assert (3, 4, "missense", "transversion") in subs and all(c == "downstream_of_frameshift" for p, _, c, _ in subs if p == 2)


def test_trees_of_groups(spark):
    df = spark.createDataFrame([("g", "a", "ATGCATGCAT"), ("g", "b", "ATGCATGCAA"), ("g", "c", "ATGGATGCAA"), ("g", "d", "ATGGATGCAA"), ("h", "x", "AT")], "group string, name string, s string")
    row, = phylogeny.group_trees(df).collect()
    assert (row["group"], row["n"], row["n_placed"]) == ("g", 3, 0) and row["upgma"].endswith(";")
    assert {(r["group"], len(r["aligned"])) for r in phylogeny.group_alignment(df).collect()} == {("g", 10), ("h", 2)}


def test_pages(spark, tmp_path):
    from helixspark.sources.pages import Pages, fetch

    spark.dataSource.register(Pages)
    urls = [f"file://{put(tmp_path, f'{i}.json', str(i))}" for i in range(3)] + ["file:///nowhere/x"]
    assert fetch("file:///nowhere/x", backoff=0)[1] == "URLError"
    got = {(r["value"], r["fault"]) for r in spark.read.format("pages").option("urls", "\n".join(urls)).option("batch", 2).load().collect()}
    assert got == {("0", None), ("1", None), ("2", None), (None, "URLError")}


def test_other_writers(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1.0), (None, 3.0), ("c", None)], "x string, y double")
    assert writers.markdown(df, "T").split("\n")[4] == "| a\\|b | 1.0 |"
    assert writers.snapshot(df, str(tmp_path / "p")).count() == 3
    writers.write_sheets({"one": df, "two": df}, str(tmp_path / "s"))
    writers.write_sorted(df, str(tmp_path / "o"), "y")
    assert spark.read.csv(str(tmp_path / "s" / "two"), header=True).count() == 3 and spark.read.csv(str(tmp_path / "o"), header=True).first()["y"] == "3.0"


def test_master_and_rules(spark, tmp_path):
    columns = "gene_id string, symbol string, organism string, n int"
    a = spark.createDataFrame([("g", "s", "X", 1), ("g", "t", "X", 2), ("", "u", "X", 3), ("", "v", "X", 4)], columns)
    b = spark.createDataFrame([("g", "s", "Y", 5), (None, None, "X", 6), (None, None, "X", 6), (None, None, "X", 7)], columns)
    kept = lambda rule: sorted(r["n"] for r in catalogue.deduplicated(a.unionByName(b), rule).collect())
    assert kept("key_organism") == [1, 3, 5] and kept("key_or_record") == [1, 3, 4, 5, 6, 7] and kept("none") == [1, 2, 3, 4, 5, 6, 6, 7]
    with pytest.raises(ValueError):
        catalogue.deduplicated(a, "other")
    assert tuple(writers.write_master([a, b], str(tmp_path / "m")).first()) == (6, 2)
    assert spark.read.json(str(tmp_path / "m" / "genes")).count() == 6 and spark.read.json(str(tmp_path / "m" / "metadata")).first()["total_genes"] == 6
    assert tuple(writers.write_master([a.limit(0)], str(tmp_path / "e")).first()) == (0, 0)
    writers.store_trigrams(a.withColumn("id", F.col("n")), str(tmp_path / "t"))
    assert {(r["id"], r["trigram"]) for r in spark.read.parquet(str(tmp_path / "t")).where("id = 1").collect()} == {(1, "  s"), (1, " s ")}
    report = {r["id"]: r["value"] for r in writers.text_report(spark.createDataFrame([(1, "ACGG", "dna"), (2, "MK", "protein"), (3, "", None)], "id int, s string, sequence_type string")).collect()}
    assert "GC Content: 75.00%" in report[1] and "4 bp" in report[1] and report[2].endswith("2 aa") and "0 bp" in report[3]


def test_services_of_factors_and_searches(spark):
    fam = spark.createDataFrame([("MYB", "a MYB factor")], "family string, text string")
    pages = texts(spark, '{"data":[{"tf_id":"T1","family":"MYB","protein_seq":"mk\\nv"},{"family":"X"}]}', '[{"id":"T2","locus":"L","description":"d"}]', '{"results":[{"gene_id":"G3","tf_family":"ABC"}]}', "nope", None)
    got = {(r["symbol"], r["gene_id"], r["sequence"], r["description"], r["length"]) for r in services.tf_answers(pages, fam, "Zea").collect()}
    assert got == {("T1", "T1", "MKV", "a MYB factor", 3), ("T2", "L", "", "d", 0), ("G3", "G3", "", "ABC transcription factor", 0)}
    df = spark.createDataFrame([("AT1G01010", "Zea mays"), ("NM_1.2", None)], "a string, o string")
    terms = [r[0] for r in df.select(files.search_terms(F.col("a"), F.col("o"))).collect()]
    assert terms == [['(AT1G01010[Accession]) AND plants[filter] AND "Zea mays"[Organism]', '(AT1G01010[Gene]) AND plants[filter] AND "Zea mays"[Organism]'], ["(NM_1.2[Accession]) AND plants[filter]"]]


def test_checkpoint_folder():
    from helixspark.session import checkpoint_folder

    assert checkpoint_folder("hdfs:/x", "yarn") == "hdfs:/x" and checkpoint_folder(None, "local[4]") and checkpoint_folder(None, "local")
    for master in ("yarn", "local-cluster[3,2,1024]", "spark://h:7077"):
        with pytest.raises(ValueError):
            checkpoint_folder(None, master)


def test_versions_by_uri(spark, tmp_path):
    spark.range(1).write.parquet(f"{tmp_path}/c/v3")
    spark.range(1).write.parquet(f"{tmp_path}/c/v12")
    (tmp_path / "c" / "v20").mkdir()
    assert ingest.versions(spark, f"file://{tmp_path}/c") == [3, 12] and ingest.versions(spark, f"file://{tmp_path}/none") == []


def test_read_catalogue(spark, tmp_path):
    path = put(tmp_path, "c.json", '{"gene_id":"g","external_links":{"a":"b"},"publications":[{"pmid":"1","year":2001}],"extra":1}\n{broken\n')
    rows = services.read_catalogue(spark, path).cache().collect()
    assert {(r["gene_id"], r["_corrupt_record"]) for r in rows} == {("g", None), (None, "{broken")}
    assert next(r for r in rows if r["gene_id"])["publications"][0]["year"] == 2001


def test_sql_functions(spark):
    from helixspark.functions import sql

    sql.register(spark)
    row = spark.sql("""SELECT seq_clean(' ac\\tgt\\n') AS c, seq_gc('') AS g, seq_gc(NULL) AS n, seq_melting('ACGT') AS m, seq_translate('ATGTAAATG') AS p, seq_translate(NULL) AS q, seq_codons('ATGTA') AS k,
 seq_align('ACGT', 'AGT') AS a, seq_align(NULL, 'A') AS b, seq_align_local('TTACGT', 'GGACG') AS l, seq_align_protein('MK', 'MK').score AS s""").first()
    assert (row["c"], row["g"], row["n"], row["m"], row["p"], row["q"], row["k"]) == ("ACGT", 0.0, None, 12.0, "M", None, ["ATG"])
    assert row["a"]["a"] == "ACGT" and row["a"]["b"].replace("-", "") == "AGT" and row["b"]["a"] is None and (row["l"]["a"], row["l"]["b"], row["s"]) == ("ACG", "ACG", 10)
    found = spark.sql("SELECT r.* FROM (VALUES ('ACACACGGGGGGT'), (''), (NULL)) t(s), LATERAL seq_repeats(t.s, 3) r").collect()
    assert {tuple(r) for r in found} == {("AC", 1, 3), ("GG", 7, 3)}
    assert spark.sql("SELECT * FROM (VALUES (''), (NULL), ('AT')) t(s), LATERAL seq_frames(t.s, 3) r").count() == 0


def test_series(spark, small):
    from helixspark.plans import presentation

    for name in ("alignment_series", "msa_series", "dendrogram_series", "sql_alignments", "text_reports"):
        df = presentation.QUERIES[name](spark, small)
        assert df.count() >= 0 and df.columns
    strip = presentation.alignment_series(spark, small).where("series = 'strip'")
    assert strip.agg(F.max("y")).first()[0] <= 59
