"""Queries on retrieval, alignment, variants, distances and trees.

Search queries are the rows whose id is divisible by 50, against all rows;
variants of DNA and translated searches are those of every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixspark import schema
from helixspark.functions import pairs, seq
from helixspark.operators import phylogeny, search, variants
from helixspark.plans.base import SQL_DNA, SQL_KEY, SQL_PROTEIN, dna, key, proteins, spread_dna
from helixspark.session import checkpoint, spread
from helixspark.tables import table

EVERY = 50
AMINO = "ACDEFGHIKLMNPQRSTVWY"
#: Percent identity from which on genes count as similar when recall is measured.
SIMILAR = float(schema.SIMILARITY["high"])


def _queries(df: DataFrame) -> DataFrame:
    return df.where(F.col("id") % EVERY == 0)


def kmer_index(spark: SparkSession, d: str) -> DataFrame:
    """SEQ-13, SNK-17: genes per word of twelve bases."""
    return search.kmer_index(spread_dna(spark, d)).groupBy("kmer").agg(F.count("*").alias("n_genes"))


def kmer_codes(spark: SparkSession, d: str) -> DataFrame:
    """SEQ-13: rows of the k-mer table per code, with the words of twelve letters that have it; DNA and protein codes share the column."""
    rows = table(spark, d, "gene_kmers").where(F.col("kmer").isNotNull()).groupBy("kmer").agg(F.count("*").alias("n"))
    return rows.select("kmer", seq.kmer_word(F.col("kmer"), "ACGT", 12).alias("dna_word"), seq.kmer_word(F.col("kmer"), AMINO, 12).alias("protein_word"), "n")


def kmer_shared_top(spark: SparkSession, d: str) -> DataFrame:
    """JON-03, AGG-05, SRT-02: the ten genes that share most words with each query."""
    genes = spread_dna(spark, d)
    return search.shared_top(_queries(genes), genes, 10).select("query", F.col("rank").cast("bigint").alias("rank"), "id", "shared")


def length_candidates(spark: SparkSession, d: str) -> DataFrame:
    """FLT-10, OPT-03: how many genes each query's length admits: of its own kind within a factor of 3, of the other (dna or protein) within 6."""
    rows = {"dna": dna(spark, d), "protein": proteins(spark, d)}
    rows = {k: df.select("id", F.length("s").cast("bigint").alias("n")) for k, df in rows.items()}
    out = None
    for kind, other in (("dna", "protein"), ("protein", "dna")):
        asked = _queries(rows[kind])
        own = search.lengths_within(asked, rows[kind], 3).select(F.col("m").alias("n"), (F.col("n_within") - 1).alias("n_same"))
        cross = search.lengths_within(asked, rows[other], 6).select(F.col("m").alias("n"), F.col("n_within").alias("n_cross"))
        one = asked.join(own, "n").join(cross, "n").select(F.col("id").alias("query"), F.lit(kind).alias("kind"), "n_same", "n_cross")
        out = one if out is None else out.unionByName(one)
    return out


def trigram_top(spark: SparkSession, d: str) -> DataFrame:
    """SEQ-15: the five most similar symbols of each query's symbol; equal symbols are compared once."""
    rows = table(spark, d, "genes").select("id", F.coalesce("symbol", F.lit("")).alias("name"))
    order = F.row_number().over(Window.partitionBy("name").orderBy("id"))
    held = rows.withColumn("_r", order).where("_r <= 6").groupBy("name").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("id", F.col("ids")[0])
    asked = _queries(rows).join(held.select("name", F.col("id").alias("text")), "name")
    scored = search.trigram_candidates(asked.select(F.col("text").alias("id"), "name").distinct(), held.select("id", "name"))
    each = scored.join(held.select("id", "ids"), "id").select(F.col("query").alias("text"), "score", F.explode("ids").alias("id"))
    found = asked.select(F.col("id").alias("query"), "text").join(each, "text").where("query <> id")
    return search.top(found, "score", 5).select("query", "rank", "id", "score")


def sequence_trigram_top(spark: SparkSession, d: str) -> DataFrame:
    """JON-02, SIM-01, SRT-02: balanced retrieval: the 45 most similar trigram sets within a factor of 3 in length; ``source`` names the way, by length where no set is similar."""
    genes = spread_dna(spark, d)
    found = checkpoint(search.sequence_trigram_top(_queries(genes), genes, 45))
    lost = _queries(genes).join(found.select(F.col("query").alias("id")), "id", "left_anti")
    sizes = lambda df: df.select("id", F.length("s").cast("bigint").alias("n"))
    by_length = search.nearest_lengths(sizes(lost), sizes(genes), 45)
    return found.withColumn("source", F.lit("trigram")).unionByName(by_length.select("query", "rank", "id", F.lit(None).cast("double").alias("score"), F.lit("length").alias("source")))


def sequence_trigram_deep(spark: SparkSession, d: str) -> DataFrame:
    """SIM-02, SRT-02: deep retrieval: the 500 most similar trigram sets, whatever the length."""
    genes = spread_dna(spark, d)
    return search.sequence_trigram_top(_queries(genes), genes, 500, ratio=None)


def containment(spark: SparkSession, d: str) -> DataFrame:
    """JON-07, SEQ-19: genes that stand whole within a query."""
    genes = dna(spark, d)
    return search.containment(_queries(genes), genes)


def search_align(spark: SparkSession, d: str) -> DataFrame:
    """SIM-03, ALN-01, ALN-04, SRT-01, OPT-04, OPT-05: retrieve, align globally, rank by identity."""
    genes = spread_dna(spark, d)
    found = search.search(_queries(genes), genes, results=3)
    return found.select("query", "rank", "id", "shared", "score", "identity", "coverage")


def database_matches(spark: SparkSession, d: str) -> DataFrame:
    """JON-01, SIM-06: exhaustive verification: of all genes the eight most similar to each query, of at least ``SIMILAR`` percent identity."""
    genes = spread_dna(spark, d)
    return search.brute_force(_queries(genes), genes, results=8, least=SIMILAR)


def search_recall(spark: SparkSession, d: str) -> DataFrame:
    """SIM-07, JON-12, AGG-11: of the three genes most similar to each query among all genes, of at least ``SIMILAR`` percent identity, how many ``search_align`` finds."""
    genes = spread_dna(spark, d)
    return search.recall(search.search(_queries(genes), genes, results=3), search.brute_force(_queries(genes), genes, results=3, least=SIMILAR))


def search_protein(spark: SparkSession, d: str) -> DataFrame:
    """SIM-03 over proteins: words of six residues, BLOSUM62."""
    rows = spread(proteins(spark, d))
    found = search.search(_queries(rows), rows, results=3, kind="protein", alphabet=AMINO, k=6)
    return found.select("query", "rank", "id", "shared", "score", "identity")


def translated_search(spark: SparkSession, d: str) -> DataFrame:
    """ALN-08, SRT-08: each protein aligned with the six translated frames of the genes whose frames share most words with it; the best frame of the most identical gene."""
    return search.translated(spread(proteins(spark, d)), spread_dna(spark, d))


def _firsts(spark: SparkSession, d: str) -> DataFrame:
    """Each row beside the first row of its key and length: ``(pair, query_s, s)``; linear in the rows whatever the size of a key."""
    rows = dna(spark, d, "gene_id", "symbol").select("id", key().alias("k"), "s", F.length("s").alias("n")).where(F.col("k").isNotNull())
    first = rows.groupBy("k", "n").agg(F.min(F.struct("id", "s")).alias("f"))
    return rows.join(first, ["k", "n"]).where("id <> f.id").select(F.col("id").alias("pair"), F.col("s").alias("query_s"), F.col("f.s").alias("s"))


def distances(spark: SparkSession, d: str) -> DataFrame:
    """DST-01, DST-02, DST-03, AGG-07: distances of equally long deliveries of one gene."""
    x = pairs.differences(F.col("query_s"), F.col("s"))
    rows = spread(_firsts(spark, d)).select("pair", x.alias("d"))
    return rows.select("pair", "d.n", "d.transitions", "d.transversions", pairs.hamming(F.col("d")).alias("hamming"), F.round(pairs.jukes_cantor(F.col("d")), 6).alias("jukes_cantor"), F.round(pairs.kimura(F.col("d")), 6).alias("kimura"))


def protein_distances(spark: SparkSession, d: str) -> DataFrame:
    """DST-04: PAM-like distances of equally long proteins of one gene."""
    rows = proteins(spark, d, "gene_id", "symbol").select("id", key().alias("k"), "s", F.length("s").alias("n")).where(F.col("k").isNotNull())
    first = rows.groupBy("k", "n").agg(F.min(F.struct("id", "s")).alias("f"))
    both = spread(rows.join(first, ["k", "n"]).where("id <> f.id").select("id", "s", F.col("f.s").alias("t")))
    x = pairs.differences(F.col("s"), F.col("t"))
    return both.select("id", F.round(pairs.pam(x), 6).alias("pam"))


def edit_distances(spark: SparkSession, d: str) -> DataFrame:
    """Edits between the symbols of one gene's deliveries and its first symbol."""
    rows = table(spark, d, "genes").select("id", key().alias("k"), "symbol").where(F.col("k").isNotNull() & F.col("symbol").isNotNull())
    first = rows.groupBy("k").agg(F.min(F.struct("id", "symbol")).alias("f"))
    return rows.join(first, "k").select("id", F.levenshtein("symbol", "f.symbol").cast("bigint").alias("edits"))


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct sequence of a gene aligned with the gene's longest."""
    rows = dna(spark, d, "gene_id", "symbol").select("id", key().alias("k"), "s").where(F.col("k").isNotNull())
    one = rows.groupBy("k", "s").agg(F.min("id").alias("id"))
    best = one.groupBy("k").agg(F.max(F.struct(F.length("s").alias("n"), (-F.col("id")).alias("i"), "s")).alias("b"))
    both = one.join(best, "k").where("s <> b.s").select(F.col("id").alias("pair"), F.col("s").alias("query_s"), F.col("b.s").alias("s"))
    return _solved(both)


def _solved(both: DataFrame, kind: str = "dna", local: bool = False) -> DataFrame:
    """Pairs ``(pair, query_s, s)`` aligned once, however often they are read; dealt pair by pair."""
    dealt = both.repartition(both.sparkSession.sparkContext.defaultParallelism * 4, "pair")
    done = dealt.withColumn("x", search.align_udf(kind, local)("query_s", "s"))
    return checkpoint(done.select("pair", *[c for c in both.columns if c != "pair"], F.col("x.a").alias("query_aligned"), F.col("x.b").alias("gene_aligned"), F.col("x.score").alias("score")))


def _nearest(genes: DataFrame, word: int = search.K, alphabet: str = "ACGT") -> DataFrame:
    """``(pair, id, query_s, s)``: each query and the gene that shares most words with it."""
    best = search.shared_top(_queries(genes), genes, 1, word, alphabet)
    return search.with_sequences(best, genes, _queries(genes)).select(F.col("query").alias("pair"), "id", "query_s", "s")


def _varied(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Each gene and the one that shares most words with it, aligned where their texts differ; and ``(pair, query)``, the genes that each such pair stands for."""
    both, of = search.nearest(spread_dna(spark, d))
    return _solved(both.where("query_s <> s")), of.select("pair", "query")


def _of_each(rows: DataFrame, of: DataFrame) -> DataFrame:
    """What was found of a pair, for each gene that it stands for."""
    return rows.join(of.withColumnRenamed("query", "_of"), "pair").select(F.col("_of").alias("pair"), *[c for c in rows.columns if c != "pair"])


def alignment_maps(spark: SparkSession, d: str) -> DataFrame:
    """ALN-05, WIN-09: aligned pairs with their match line."""
    rows = _aligned(spark, d)
    st = pairs.statistics(F.col("query_aligned"), F.col("gene_aligned"))
    return rows.select("pair", "query_aligned", "gene_aligned", pairs.match_line(F.col("query_aligned"), F.col("gene_aligned")).alias("match_line"), "score", pairs.identity(st).alias("identity"), pairs.non_gap_identity(st).alias("non_gap_identity"))


def local_alignments(spark: SparkSession, d: str) -> DataFrame:
    """ALN-02, ALN-07: the best local alignment of each query gene with its best candidate."""
    done = _solved(_nearest(spread_dna(spark, d)), local=True)
    return done.select(F.col("pair").alias("query"), "id", F.col("query_aligned").alias("query_part"), F.col("gene_aligned").alias("gene_part"), "score")


def variant_report(spark: SparkSession, d: str) -> DataFrame:
    """VAR-01, VAR-02, VAR-03, VAR-05, WIN-06, on DNA: of each gene and the one that shares most words with it."""
    done, of = _varied(spark, d)
    return _of_each(variants.substitutions(done), of)


def protein_variants(spark: SparkSession, d: str) -> DataFrame:
    """VAR-02, VAR-04: substitutions between each query protein and the protein that shares most words with it."""
    return variants.protein_substitutions(_solved(_nearest(spread(proteins(spark, d)), 6, AMINO), "protein"))


def variant_summary(spark: SparkSession, d: str) -> DataFrame:
    """AGG-06: substitutions per class and consequence, indel blocks per kind, those that break the frame, and letters."""
    done, of = _varied(spark, d)
    return variants.summary(_of_each(variants.substitutions(done), of), _of_each(variants.indel_blocks(done), of))


def indel_blocks(spark: SparkSession, d: str) -> DataFrame:
    """WIN-05."""
    return variants.indel_blocks(_aligned(spark, d)).drop("_col", "_end")


def identity_windows(spark: SparkSession, d: str) -> DataFrame:
    """WIN-02: identity in windows of 50 alignment columns, half a window apart."""
    cols = variants.columns(_aligned(spark, d)).select("pair", F.floor(F.col("col") / 25).alias("_b"), ((F.col("q") == F.col("r")) & (F.col("q") != "-")).cast("int").alias("same"))
    blocks = cols.groupBy("pair", "_b").agg(F.sum("same").alias("same"), F.count("*").alias("n"))
    ahead = Window.partitionBy("pair").orderBy("_b").rowsBetween(0, 1)
    both = blocks.select("pair", "_b", F.sum("same").over(ahead).alias("same"), F.sum("n").over(ahead).alias("n"))
    return both.where("n = 50").select("pair", (F.col("_b") * 25 + 25).cast("bigint").alias("position"), F.col("same").cast("bigint").alias("same"))


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return dna(spark, d, "gene_id", "symbol").select(key().alias("group"), F.col("id").cast("string").alias("name"), "s").where(F.col("group").isNotNull())


def gene_distances(spark: SparkSession, d: str) -> DataFrame:
    """DST-01, DST-02, DST-03, DST-05, ALN-06: distances of the forms of each gene after star alignment."""
    rows = checkpoint(phylogeny.star_alignment(_groups(spark, d)))
    return phylogeny.group_distances(rows).select("group", "a", "b", "n", "matches", "transitions", "transversions", "hamming", "jukes_cantor", "kimura")


def protein_gene_distances(spark: SparkSession, d: str) -> DataFrame:
    """DST-04: PAM-like distances of the protein forms of each gene after star alignment."""
    rows = proteins(spark, d, "gene_id", "symbol").select(key().alias("group"), F.col("id").cast("string").alias("name"), "s").where(F.col("group").isNotNull())
    return phylogeny.group_distances(checkpoint(phylogeny.star_alignment(rows, "protein"))).select("group", "a", "b", "n", "pam")


def _suite(spark: SparkSession, d: str) -> DataFrame:
    """FLT-06: the first twenty genes of twenty bases at least, the suite's stated set; the limit is the feature."""
    return dna(spark, d).where(F.length("s") >= 20).orderBy("id").limit(20)


def suite_matrix(spark: SparkSession, d: str) -> DataFrame:
    """JON-05, JON-06, SRT-05, ALN-09, DST-06: every pair of the suite's records aligned directly, most similar first."""
    return phylogeny.all_pairs(_suite(spark, d), "dna")


def suite_tree(spark: SparkSession, d: str) -> DataFrame:
    """PHY-05: the trees of the suite's records."""
    return phylogeny.set_tree(suite_matrix(spark, d))


def gene_trees(spark: SparkSession, d: str) -> DataFrame:
    """PHY-01, PHY-02, PHY-03: a tree for each gene delivered in three forms or more."""
    return phylogeny.group_trees(_groups(spark, d))


def gene_alignments(spark: SparkSession, d: str) -> DataFrame:
    """ALN-06, AGG-14."""
    return phylogeny.group_alignment(_groups(spark, d))


def recall(spark: SparkSession, d: str) -> DataFrame:
    """Of the hits recorded for each query sequence, how many the recorded best agrees with; ``search_recall`` runs the search itself."""
    hits = table(spark, d, "search_hits").where(F.col("gene_key").isNotNull()).select("query_seq", F.upper(F.trim("gene_key")).alias("k"), "identity_percent", "hit_id")
    best = hits.groupBy("query_seq").agg(F.max(F.struct("identity_percent", (-F.col("hit_id")).alias("i"), "k")).alias("b"))
    joined = hits.join(best, "query_seq")
    return joined.groupBy("query_seq").agg(F.count("*").alias("n_hits"), F.count_if(F.col("k") == F.col("b.k")).alias("n_agree"))


QUERIES = {f.__name__: f for f in (
    kmer_index, kmer_codes, kmer_shared_top, length_candidates, trigram_top, sequence_trigram_top, sequence_trigram_deep, containment, search_align, database_matches, search_recall,
    search_protein, translated_search, distances, protein_distances, gene_distances, protein_gene_distances, suite_matrix, suite_tree, edit_distances, alignment_maps, local_alignments,
    variant_report, protein_variants, variant_summary, indel_blocks, identity_windows, gene_trees, gene_alignments, recall)}

_WORDS = f"SELECT DISTINCT id, substring(s, i, 12) AS kmer FROM (SELECT id, s, unnest(generate_series(1, length(s) - 11)) AS i FROM {SQL_DNA}) WHERE regexp_full_match(substring(s, i, 12), '[ACGT]+')"
_FIRSTS = f"""
r AS (SELECT id, {SQL_KEY} AS k, s, length(s) AS n FROM {{source}} WHERE {SQL_KEY} IS NOT NULL),
f AS (SELECT k, n, min(id) AS id, arg_min(s, id) AS s FROM r GROUP BY k, n),
b AS (SELECT r.id AS pair, r.s AS a, f.s AS b FROM r JOIN f ON f.k = r.k AND f.n = r.n AND f.id <> r.id),
c AS (SELECT pair, length(a) AS len, substring(a, i, 1) AS x, substring(b, i, 1) AS y FROM (SELECT *, unnest(generate_series(1, length(a))) AS i FROM b)),
d AS (SELECT pair, any_value(len) AS n, count(*) FILTER (WHERE x <> y AND (x || y) IN ('AG', 'GA', 'CT', 'TC')) AS ts, count(*) FILTER (WHERE x <> y AND (x || y) NOT IN ('AG', 'GA', 'CT', 'TC')) AS tv FROM c GROUP BY pair)
"""
_TRIGRAMS = """
(SELECT id, list_distinct(flatten(list_transform(list_transform(list_filter(string_split_regex(lower(coalesce(symbol, '')), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: '  ' || w || ' '),
 lambda p: list_transform(generate_series(1, length(p) - 2), lambda i: substring(p, i, 3))))) AS t FROM genes)"""



def _sql_word(alphabet: str, k: int = 12) -> str:
    n = len(alphabet)
    digits = ", ".join(str(n**i) for i in range(k - 1, -1, -1))
    return f"CASE WHEN kmer >= 0 AND kmer < {n**k} THEN array_to_string(list_transform([{digits}], lambda p: substring('{alphabet}', CAST((kmer // p) % {n} + 1 AS INT), 1)), '') END"


_SEQUENCE_TRIGRAMS = f"""
g AS (SELECT id, length(s) AS n, '  ' || lower(s) || ' ' AS p FROM {SQL_DNA}),
t AS (SELECT id, n, list_distinct(list_transform(generate_series(1, length(p) - 2), lambda i: substring(p, i, 3))) AS t FROM g),
p AS (SELECT q.id AS query, b.id AS id, q.n AS m, b.n AS n, len(list_intersect(q.t, b.t)) AS s, len(q.t) + len(b.t) AS u FROM t q JOIN t b ON b.id <> q.id WHERE q.id % {EVERY} = 0)
"""

ORACLE = {
    "kmer_index": f"SELECT kmer, count(*) AS n_genes FROM ({_WORDS}) GROUP BY kmer",
    "kmer_codes": f"""
WITH g AS (SELECT kmer, count(*) AS n FROM gene_kmers WHERE kmer IS NOT NULL GROUP BY kmer)
SELECT kmer, {_sql_word('ACGT')} AS dna_word, {_sql_word(AMINO)} AS protein_word, n FROM g""",
    "kmer_shared_top": f"""
WITH w AS ({_WORDS}), p AS (SELECT q.id AS query, g.id AS id, count(*) AS shared FROM w q JOIN w g ON g.kmer = q.kmer AND g.id <> q.id WHERE q.id % {EVERY} = 0 GROUP BY 1, 2)
SELECT query, rank, id, shared FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY shared DESC, id) AS rank FROM p) WHERE rank <= 10""",
    "length_candidates": f"""
WITH g AS (SELECT id, length(s) AS n, 'dna' AS kind FROM {SQL_DNA} UNION ALL SELECT id, length(s), 'protein' FROM {SQL_PROTEIN})
SELECT q.id AS query, any_value(q.kind) AS kind, count(*) FILTER (WHERE g.kind = q.kind AND g.id <> q.id AND greatest(g.n, q.n) <= 3 * least(g.n, q.n)) AS n_same,
 count(*) FILTER (WHERE g.kind <> q.kind AND greatest(g.n, q.n) <= 6 * least(g.n, q.n)) AS n_cross FROM g q, g WHERE q.id % {EVERY} = 0 GROUP BY q.id""",
    "trigram_top": f"""
WITH t AS {_TRIGRAMS}, e AS (SELECT id, len(t) AS n, unnest(t) AS g FROM t),
s AS (SELECT q.id AS query, b.id AS id, count(*) / (any_value(q.n) + any_value(b.n) - count(*)) AS score FROM e q JOIN e b ON b.g = q.g AND b.id <> q.id WHERE q.id % {EVERY} = 0 GROUP BY 1, 2)
SELECT query, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s WHERE score >= 0.3) WHERE rank <= 5""",
    "sequence_trigram_top": "WITH " + _SEQUENCE_TRIGRAMS + """
SELECT query, rank, id, score, 'trigram' AS source FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM (
 SELECT query, id, s / (u - s) AS score FROM p WHERE greatest(m, n) <= 3 * least(m, n)) WHERE score >= 0.3) WHERE rank <= 45""",
    "sequence_trigram_deep": "WITH " + _SEQUENCE_TRIGRAMS + """
SELECT query, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM (SELECT query, id, s / (u - s) AS score FROM p) WHERE score >= 0.3) WHERE rank <= 500""",
    "containment": f"WITH g AS (SELECT id, s FROM {SQL_DNA}) SELECT q.id AS query, g.id AS id FROM g q JOIN g ON contains(q.s, g.s) AND g.id <> q.id WHERE q.id % {EVERY} = 0",
    "distances": "WITH " + _FIRSTS.format(source=SQL_DNA) + """
SELECT pair, n, ts AS transitions, tv AS transversions, (ts + tv) / n AS hamming, round(CASE WHEN (ts + tv) / n < 0.75 THEN -0.75 * ln(1 - 4 * ((ts + tv) / n) / 3) END, 6) + 0 AS jukes_cantor,
 round(CASE WHEN 1 - 2 * (ts / n) - tv / n > 0 AND 1 - 2 * (tv / n) > 0 THEN -0.5 * ln((1 - 2 * (ts / n) - tv / n) * sqrt(1 - 2 * (tv / n))) END, 6) + 0 AS kimura FROM d""",
    "protein_distances": "WITH " + _FIRSTS.format(source=SQL_PROTEIN) + """
SELECT pair AS id, round(CASE WHEN ts + tv = 0 THEN 0 WHEN (ts + tv) / n < 0.99 THEN -100 * ln(greatest(1 - 1.01::DOUBLE * ((ts + tv) / n), 1e-12)) ELSE 200 END, 6) AS pam FROM d""",
    "edit_distances": f"""
WITH r AS (SELECT id, {SQL_KEY} AS k, symbol FROM genes WHERE {SQL_KEY} IS NOT NULL AND symbol IS NOT NULL), f AS (SELECT k, arg_min(symbol, id) AS first FROM r GROUP BY k)
SELECT id, levenshtein(symbol, first) AS edits FROM r JOIN f USING (k)""",
    "recall": """
WITH h AS (SELECT query_seq, upper(trim(gene_key)) AS k, identity_percent, hit_id FROM search_hits WHERE gene_key IS NOT NULL),
b AS (SELECT query_seq, k AS best FROM h QUALIFY row_number() OVER (PARTITION BY query_seq ORDER BY identity_percent DESC NULLS LAST, hit_id) = 1)
SELECT h.query_seq, count(*) AS n_hits, count(*) FILTER (WHERE k = best) AS n_agree FROM h JOIN b ON b.query_seq = h.query_seq GROUP BY h.query_seq""",
}
