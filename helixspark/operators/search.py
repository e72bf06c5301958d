"""Retrieve, align, rank: similarity search of query sequences against the catalogue.

Candidates come from an inverted index of k-mers joined by equality, so no
query ever meets a gene it shares nothing with.  Words that few genes hold
are joined and counted; a word that very many hold is looked up only for
pairs that the rare words leave in question, and read as a whole, salted,
only for queries that could be answered by such words alone.  Exact ranking
follows on the candidates, and sequences are fetched only for them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixspark.functions import seq
from helixspark.kernels import align as kernel
from helixspark.kernels import words
from helixspark.kernels.align import common_letters, letter_places
from helixspark.session import checkpoint

K = 12
SALT = 8
#: Candidates aligned first, per result wanted; of the others all that could still be among the results.
PER_RESULT = 15
#: Genes that hold a word beyond which its list isn't read for every query.
HOT = 1000
#: Percent identity from which on no gene is missed: more differing columns than this allows might break every word of ``K`` letters.
SURE = 93.0


def kmer_index(df: DataFrame, k: int = K, id_column: str = "id", text: str = "s", alphabet: str = "ACGT") -> DataFrame:
    """``(id, kmer)``: the distinct words of each sequence made of ``alphabet`` only, ambiguous words left out."""
    words = F.filter(seq.kmers(F.col(text), k), lambda w: w.rlike(f"^[{alphabet}]+$"))
    return df.select(F.col(id_column).alias("id"), F.explode(words).alias("kmer"))


def code_index(df: DataFrame, k: int = K, alphabet: str = "ACGT") -> DataFrame:
    """``(id, kmer)`` with each distinct word as its positional code, by an Arrow kernel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 2000):
                batch = big.slice(at, 2000)
                text, code = words.word_codes(batch.column(1).to_pylist(), k, alphabet)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), pa.array(code)], names=["id", "kmer"])

    return df.where("s IS NOT NULL").select(F.col("id").cast("bigint").alias("id"), "s").mapInArrow(run, "id bigint, kmer bigint")


class SharedWords:
    """How many distinct words queries share with genes: ``queries`` and ``index`` have ``id`` and ``kmer``.

    Pairs that share nothing never arise.  A word that more than ``hot``
    genes hold is counted only where it matters, see ``at_least``.

    Most pairs share a word or two by chance.  With ``keep`` only those are
    written that later questions may need: ``top`` of at most ``keep``, and
    ``at_least`` of a query's number of words less ``spared(query, spared)``,
    or more.
    """

    def __init__(self, queries: DataFrame, index: DataFrame, hot: int = HOT, keep: int | None = None, spared: DataFrame | None = None):
        asked = checkpoint(queries.select(F.col("id").alias("query"), "kmer"))
        # the part of the index that any query asks for: found in one pass, read several times below
        index = checkpoint(index.join(asked.select("kmer").distinct(), "kmer", "left_semi").select("id", "kmer"))
        held = index.groupBy("kmer").agg(F.count("*").alias("_df"))
        self.words = asked.join(held, "kmer").select("query", "kmer", (F.col("_df") > hot).alias("_hot"))
        self.hot = self.words.where("_hot").select("query", "kmer")
        self.hot_index = index.join(held.where(F.col("_df") > hot).select("kmer"), "kmer", "left_semi")
        rare = self.words.where("NOT _hot").join(index, "kmer")
        #: ``(query, n_words, n_hot)``.
        self.sizes = self.words.groupBy("query").agg(F.count("*").alias("n_words"), F.count_if("_hot").alias("n_hot"))
        counts = rare.groupBy("query", "id").agg(F.count("*").alias("rare"))
        if keep is not None:
            best = top(counts, "rare", keep).drop("rank")
            last = best.groupBy("query").agg(F.when(F.count("*") >= keep, F.min("rare")).otherwise(0).alias("_last"))
            bound = self.sizes.join(last, "query", "left").withColumn("_least", F.when(F.col("n_hot") > 0, F.coalesce("_last", F.lit(0)) - F.col("n_hot")))
            if spared is not None:
                bound = bound.join(spared, "query", "left").withColumn("_least", F.least("_least", F.col("n_words") - F.col("spared") - F.col("n_hot")))
            asked_for = counts.join(bound.where("_least IS NOT NULL").select("query", "_least"), "query").where(F.col("rare") >= F.col("_least")).drop("_least")
            counts = best.unionByName(asked_for).distinct()
        #: ``(query, id, rare)``: pairs by their rare words alone.
        self.rare = checkpoint(counts)
        #: Without hot words all that concerns them is left out of the plans; the rows are the same.
        self.any_hot = not self.hot.isEmpty()

    def at_least(self, need: DataFrame) -> DataFrame:
        """``(query, id, shared)``: all pairs that share as many words as ``need(query, need)`` asks for, at least one.

        Where a query has fewer hot words than needed, a gene must share rare
        words with it, and hot words are looked up gene by gene among the
        pairs that could reach the need.  Only else are the lists of the hot
        words read, dealt over ``SALT`` parts.
        """
        if not self.any_hot:
            return self.rare.join(need, "query").where(F.col("rare") >= F.col("need")).select("query", "id", F.col("rare").alias("shared"))
        asked = checkpoint(self.sizes.join(need, "query").select("query", "n_hot", F.greatest("need", F.lit(1)).alias("need")))
        bound = self.rare.join(asked, "query").where(F.col("rare") + F.col("n_hot") >= F.col("need"))
        plain = bound.where("n_hot = 0").select("query", "id", F.col("rare").alias("shared"), "need")
        doubtful = bound.where("n_hot > 0 AND n_hot < need").select("query", "id", "rare", "need")
        more = doubtful.select("query", "id").join(self.hot_index, "id").join(self.hot, ["query", "kmer"]).groupBy("query", "id").agg(F.count("*").alias("_more"))
        looked_up = doubtful.join(more, ["query", "id"], "left").select("query", "id", (F.col("rare") + F.coalesce("_more", F.lit(0))).alias("shared"), "need")
        open_ = asked.where("n_hot >= need").select("query", "need")
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_salt")
        lists = self.hot.join(open_, "query").select("query", "kmer", salts).join(self.hot_index.withColumn("_salt", F.pmod(F.hash("id"), F.lit(SALT))), ["kmer", "_salt"])
        read = lists.groupBy("query", "id").agg(F.count("*").alias("n")).unionByName(self.rare.join(open_.select("query"), "query", "left_semi").select("query", "id", F.col("rare").alias("n")))
        read = read.groupBy("query", "id").agg(F.sum("n").alias("shared")).join(open_, "query")
        return plain.unionByName(looked_up).unionByName(read.select("query", "id", "shared", "need")).where("shared >= need").drop("need")

    def top(self, k: int, itself: bool = False) -> DataFrame:
        """``(query, id, shared, rank)``: the ``k`` genes that share most words with each query, ties by id; other than the query unless ``itself``.

        The ``k``-th best by rare words alone is a lower bound of the ``k``-th best by all.
        """
        others = (lambda df: df) if itself else (lambda df: df.where("query <> id"))
        if not self.any_hot:
            return top(others(self.rare.select("query", "id", F.col("rare").alias("shared"))), "shared", k)
        first = top(others(self.rare), "rare", k).groupBy("query").agg(F.count("*").alias("_n"), F.min("rare").alias("_least"))
        need = self.sizes.select("query").join(first, "query", "left").select("query", F.when(F.col("_n") >= k, F.col("_least")).otherwise(1).alias("need"))
        return top(others(self.at_least(need)), "shared", k)


#: Letters of queries, and of genes, that one task holds at once.
ASKED, GENES = 4_000_000, 16_000_000


def _in_blocks(q: DataFrame, genes: DataFrame, asked: int, held: int):
    """Cogroups of a block of at most about ``asked`` letters of the queries ``q(query, s)`` and a part of ``held`` letters of the genes, as ``(id, t)``; every query meets every gene once."""
    g = genes.where("s IS NOT NULL").select(F.col("id").cast("bigint").alias("id"), F.col("s").alias("t"))
    letters = lambda df, s: df.agg(F.coalesce(F.sum(F.length(s) + 1), F.lit(0))).first()[0]
    blocks = max(1, -(-letters(q, "s") // asked))
    parts = max(q.sparkSession.sparkContext.defaultParallelism * 2 // blocks, 1, -(-letters(g, "t") // held))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = q.withColumn("_block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")).select("*", every(parts, "_part"))
    right = g.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).select("*", every(blocks, "_block"))
    # a stated number of partitions: small texts that cost much aren't put together into a task or two
    dealt = lambda df: df.repartition(blocks * parts, "_block", "_part").groupBy("_block", "_part")
    return dealt(left).cogroup(dealt(right))


def _packed(df: DataFrame, key: str, n: int, name: str) -> DataFrame:
    """The rows of ``df`` in ``n`` blocks by a hash of ``key``: a row per block, in a partition of its own as far as that can be."""
    rows = df.select(F.pmod(F.xxhash64(key), F.lit(n)).alias("_block"), F.struct(*df.columns).alias("_row")).repartitionByRange(n, "_block")
    return checkpoint(rows.groupBy("_block").agg(F.collect_list("_row").alias(name)).select(name))


def _meet(q: DataFrame, genes: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], shape: str, asked: int, held: int) -> DataFrame:
    """What ``run`` gives of a block of queries and a part of the genes, as ``_in_blocks`` deals them; blocks and parts are written once, however many there are of the other."""
    g = genes.where("s IS NOT NULL").select(F.col("id").cast("bigint").alias("id"), F.col("s").alias("t"))
    letters = lambda df, s: df.agg(F.coalesce(F.sum(F.length(s) + 1), F.lit(0))).first()[0]
    blocks = max(1, -(-letters(q, "s") // asked))
    parts = max(q.sparkSession.sparkContext.defaultParallelism * 2 // blocks, 1, -(-letters(g, "t") // held))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1), strict=True):
                yield from run(*(pa.Table.from_batches([pa.RecordBatch.from_struct_array(x.values)]) for x in (a, b))).to_batches()

    return _packed(q, "query", blocks, "q").crossJoin(_packed(g, "id", parts, "g").hint("shuffle_replicate_nl")).mapInArrow(each, shape)


def most_shared(
    queries: DataFrame, genes: DataFrame, keep: int, word: int = K, alphabet: str = "ACGT", spared: DataFrame | None = None,
    prepare: Callable[[list[str]], list[str]] | None = None, asked: int = ASKED, held: int = GENES,
) -> DataFrame:
    """``(query, id, shared, n_words)``: the ``keep`` genes that share most distinct words with each query, itself among them, ties by id.

    Both have ``id`` and ``s``.  With ``spared(query, spared)`` also every
    gene that shares a word, and all of the query's ``n_words`` but
    ``spared`` or more.  Queries in blocks of ``asked`` letters meet genes in
    parts of ``held``: words and the pairs that share them live in a task only,
    so what is written are the texts, and of each part the best per query.
    ``prepare`` gives the texts whose words count for those of genes.
    """
    beyond = F.lit(-(2**40))  # no gene shares more words than a query has
    q = queries.where("s IS NOT NULL").select(F.col("id").cast("bigint").alias("query"), "s")
    q = q.withColumn("spared", beyond) if spared is None else q.join(spared, "query", "left").withColumn("spared", F.coalesce(F.col("spared").cast("bigint"), beyond))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        index = words.Asked(a["s"].to_pylist(), word, alphabet)
        need = index.n_words - a["spared"].to_numpy()
        at, gene, shared = index.best(b["id"].to_numpy(), b["t"].to_pylist(), keep, need)
        return pa.table({"query": a["query"].to_numpy()[at], "id": gene, "shared": shared, "n_words": index.n_words[at]})

    shape = "query bigint, id bigint, shared bigint, n_words bigint"
    if prepare:
        genes = genes.select("id", F.pandas_udf(lambda t: pd.Series(prepare(t.tolist()), dtype=object), "string")("s").alias("s"), F.col("s").alias("_s")).where("_s IS NOT NULL")
    found = _meet(q, genes, run, shape, asked, held)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("shared"), "id"))
    best = F.col("_rank") <= keep
    if spared is not None:
        found = found.join(spared, "query", "left")
        best = best | (F.col("shared") >= F.col("n_words") - F.col("spared"))
    return found.withColumn("_rank", rank).where(best).select("query", "id", "shared", "n_words")


def shared_top(queries: DataFrame, genes: DataFrame, k: int, word: int = K, alphabet: str = "ACGT") -> DataFrame:
    """``(query, id, shared, rank)``: the ``k`` genes other than itself that share most words with each query, ties by id; both have ``id`` and ``s``.

    Equal texts are looked at once: the ``k + 1`` best of them hold the ``k`` best genes and the query.
    """
    each = checkpoint(classes(genes, k))
    found = most_shared(queries, each, k + 1, word, alphabet).join(each.select("id", "ids"), "id")
    return top(found.select("query", F.explode("ids").alias("id"), "shared").where("query <> id"), "shared", k)


def nearest(genes: DataFrame, word: int = K, alphabet: str = "ACGT") -> tuple[DataFrame, DataFrame]:
    """Each gene beside the other gene that shares most words with it, ties by id: ``(pair, id, query_s, s)`` and ``(pair, query, id)``.

    ``genes`` has ``id`` and ``s``.  Equal texts are looked up once, and two
    texts stand together once: ``pair`` is the first gene of those that have
    the one text and the other gene beside them, the second frame has them all.
    """
    each = checkpoint(classes(genes, 1))
    found = most_shared(each, each, 2, word, alphabet).join(each.select("id", "ids"), "id")
    # the best gene of a text, and the one for the best itself
    two = top(found.select("query", F.explode("ids").alias("id"), "shared"), "shared", 2)
    two = two.groupBy("query").agg(F.max(F.when(F.col("rank") == 1, F.col("id"))).alias("_one"), F.max(F.when(F.col("rank") == 2, F.col("id"))).alias("_two"))
    mine = genes.where("s IS NOT NULL").select("id", F.min("id").over(Window.partitionBy("s")).alias("_class"))
    other = F.when(F.col("id") == F.col("_one"), F.col("_two")).otherwise(F.col("_one"))
    beside = mine.join(two.withColumnRenamed("query", "_class"), "_class").select(F.col("id").alias("query"), "_class", other.alias("id")).where("id IS NOT NULL")
    beside = checkpoint(beside.withColumn("pair", F.min("query").over(Window.partitionBy("_class", "id"))))
    texts = each.select(F.explode("ids").alias("id"), "s")
    asked = each.select(F.col("id").alias("_class"), F.col("s").alias("query_s"))
    one = beside.where("query = pair").join(asked, "_class").join(texts, "id").select("pair", "id", "query_s", "s")
    return one, beside.select("pair", "query", "id")


def top(scored: DataFrame, score: str, k: int, query: str = "query", tie: str = "id") -> DataFrame:
    """The ``k`` best per query with their ``rank``; ties by ``tie``."""
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), tie))
    return scored.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k)


def lengths_within(asked: DataFrame, held: DataFrame, ratio: int) -> DataFrame:
    """``(m, n_within)``: of each distinct length ``m`` of ``asked``, how many rows of ``held`` differ from it by at most a factor ``ratio``.

    Both have ``n``.  Rows fold to distinct lengths first, of which there are
    fewer than the square root of twice the letters in all; running counts
    over these answer both ends of each window.
    """
    m = asked.where("n > 0").select(F.col("n").cast("bigint").alias("m")).distinct()
    counts = held.where("n > 0").groupBy(F.col("n").cast("bigint").alias("x")).agg(F.count("*").alias("c"))
    none, zero = F.lit(None).cast("bigint"), F.lit(0).cast("bigint")
    ends = m.select((F.col("m") * ratio).alias("x"), zero.alias("c"), "m", F.lit(1).alias("sign"))
    starts = m.select((F.ceil(F.col("m") / ratio) - 1).alias("x"), zero.alias("c"), "m", F.lit(-1).alias("sign"))
    rows = counts.select("x", "c", none.alias("m"), F.lit(0).alias("sign")).unionByName(ends).unionByName(starts)
    upto = F.sum("c").over(Window.orderBy("x").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_upto", upto).where("m IS NOT NULL").groupBy("m").agg(F.sum(F.col("_upto") * F.col("sign")).alias("n_within"))


def nearest_lengths(queries: DataFrame, genes: DataFrame, k: int, ratio: int = 3) -> DataFrame:
    """``(query, rank, id, gap)``: the ``k`` genes nearest in length to each query, within a factor ``ratio``, ties by id; both have ``id`` and ``n``.

    A distinct length keeps its first ids only, and a query's length looks at
    the ``k`` distinct lengths on either side; no pair else arises.
    """
    order = F.row_number().over(Window.partitionBy("n").orderBy("id"))
    first = genes.where("n > 0").select("id", "n").withColumn("_r", order).where(F.col("_r") <= k + 1).drop("_r")
    asked = queries.where("n > 0").select(F.col("id").alias("query"), F.col("n").alias("m"))
    lengths = first.select("n").unionByName(asked.select(F.col("m").alias("n"))).distinct()
    around = F.collect_list("n").over(Window.orderBy("n").rowsBetween(-k, k))
    near = lengths.withColumn("_around", around).select(F.col("n").alias("m"), F.explode("_around").alias("n")).where(F.greatest("n", "m") <= ratio * F.least("n", "m"))
    gap = F.abs(F.col("n") - F.col("m"))
    found = asked.join(near, "m").join(first, "n").where("query <> id").withColumn("gap", gap)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("gap", "id")).cast("bigint")).where(F.col("rank") <= k).select("query", "rank", "id", "gap")


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams of all trigrams of two arrays; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every > 0, both / every).otherwise(0.0)


def trigram_candidates(queries: DataFrame, names: DataFrame, least: float = 0.3) -> DataFrame:
    """``(query, id, score)``: texts whose trigram sets are at least ``least`` alike; both have ``id`` and ``name``, ids name distinct texts.

    Two sets of ``m`` and ``n`` trigrams that are so alike share at least
    ``least`` times the larger, so they meet already among all but that many
    of each one's trigrams in order of rarity: those alone are joined, and
    pairs that meet are scored whole.
    """
    g = names.select("id", seq.trigrams(F.col("name")).alias("_t")).where(F.size("_t") > 0)
    q = queries.select("id", seq.trigrams(F.col("name")).alias("_t")).where(F.size("_t") > 0)
    df = g.select(F.explode("_t").alias("trigram")).groupBy("trigram").agg(F.count("*").alias("_df"))

    def prefix(sets: DataFrame, name: str) -> DataFrame:
        each = sets.select(F.col("id").alias(name), F.size("_t").alias("_n"), F.explode("_t").alias("trigram")).join(df, "trigram", "left")
        rank = F.row_number().over(Window.partitionBy(name).orderBy(F.coalesce("_df", F.lit(0)), "trigram"))
        return each.withColumn("_r", rank).where(F.col("_r") <= F.col("_n") - F.ceil(F.lit(least) * F.col("_n") - 1e-9) + 1).select(name, "trigram")

    dealt = prefix(g, "id").withColumn("_salt", F.pmod(F.hash("id"), F.lit(SALT)))
    asked = prefix(q, "query").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    met = asked.join(dealt, ["trigram", "_salt"]).select("query", "id").distinct()
    both = met.join(q.select(F.col("id").alias("query"), F.col("_t").alias("_a")), "query").join(g.select("id", F.col("_t").alias("_b")), "id")
    return both.select("query", "id", trigram_similarity(F.col("_a"), F.col("_b")).alias("score")).where(F.col("score") >= least)


#: The letters of a sequence whose trigrams have a bit each.
TRIGRAM_LETTERS = "acgtn"


def trigram_bits(s: Column) -> Column:
    """``struct(b0, b1, first, last, n)``: the trigram set of a sequence of ``ACGTN`` as two bitmaps, the padded ones by their letters, and the size of the set."""

    @F.pandas_udf("b0 bigint, b1 bigint")
    def bitmaps(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("b0", "b1"), words.trigram_bitmaps(texts.tolist(), TRIGRAM_LETTERS), strict=True)))

    low = F.lower(s)
    bits = bitmaps(low)
    return F.struct(bits["b0"].alias("b0"), bits["b1"].alias("b1"), F.substring(low, 1, 2).alias("first"), F.right(low, F.lit(2)).alias("last"),
                    (F.bit_count(bits["b0"]) + F.bit_count(bits["b1"]) + F.when(F.length(s) == 1, 2).otherwise(3)).alias("n"))


def sequence_trigram_top(queries: DataFrame, genes: DataFrame, k: int, ratio: int | None = 3, least: float = 0.3, blocks: int | None = None) -> DataFrame:
    """``(query, rank, id, score)``: the ``k`` genes whose sequences have the most similar trigram sets, of at least ``least``, ties by id.

    Both have ``id`` and ``s``, of ``ACGTN``.  With ``ratio`` only genes whose
    length differs by at most that factor count; without it (the deep mode)
    all do.  Nearly all long sequences hold nearly all trigrams, so an index
    would return everything: genes fold to distinct (set, length) with their
    first ids, and the stated queries meet these in blocks, two bitmaps
    against two.
    """
    blocks = blocks or queries.sparkSession.sparkContext.defaultParallelism * 2
    parts = lambda df, name: df.where(F.length("s") > 0).select(F.col("id").alias(name), F.length("s").alias("m"), trigram_bits(F.col("s")).alias("t"))
    kind = ["m", "t.b0", "t.b1", "t.first", "t.last", "t.n"] if ratio else ["t.b0", "t.b1", "t.first", "t.last", "t.n"]
    flat = parts(genes, "id").select("id", *kind)
    keys = flat.columns[1:]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
    folded = flat.withColumn("_r", rank).where(F.col("_r") <= k + 1).groupBy(*keys).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    g = folded.withColumn("_block", F.pmod(F.xxhash64(*keys), F.lit(blocks))).alias("g")
    q = parts(queries, "query").select("query", *kind, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("_block")).alias("q")
    col = F.col
    shared = F.bit_count(col("q.b0").bitwiseAND(col("g.b0"))) + F.bit_count(col("q.b1").bitwiseAND(col("g.b1")))
    # the padded trigrams: one letter after two blanks, two letters after one, two letters before one
    one, both, end = F.left(col("q.first"), F.lit(1)) == F.left(col("g.first"), F.lit(1)), col("q.first") == col("g.first"), col("q.last") == col("g.last")
    single = F.length(col("q.first")) == 1
    shared = shared + one.cast("int") + F.when(single, both).otherwise(both & (F.length(col("g.first")) == 2)).cast("int") + F.when(single, False).otherwise(end & (F.length(col("g.last")) == 2)).cast("int")
    near = q.join(g, "_block")
    if ratio:
        near = near.where(F.greatest(col("q.m"), col("g.m")) <= ratio * F.least(col("q.m"), col("g.m")))
    scored = near.select("query", "ids", (shared / (col("q.n") + col("g.n") - shared)).alias("score")).where(F.col("score") >= least)
    # the best classes hold the best genes: each class has one at least besides the query
    best = F.rank().over(Window.partitionBy("query").orderBy(F.desc("score")))
    kept = scored.withColumn("_c", best).where(F.col("_c") <= k + 1)
    return top(kept.select("query", F.explode("ids").alias("id"), "score").where("query <> id"), "score", k).select("query", "rank", "id", "score")


def _columns(a: str, b: str) -> tuple[int, int, int]:
    """Equal columns, columns with a gap, and all columns of two aligned texts."""
    x, y = (np.frombuffer(t.encode("ascii", "replace"), dtype=np.uint8) for t in (a, b))
    gap = (x == ord("-")) | (y == ord("-"))
    return int(((x == y) & ~gap).sum()), int(gap.sum()), len(x)


def align_udf(kind: str = "dna", local: bool = False):
    """Arrow kernel over batches of pairs: ``struct(a, b, score, matches, gaps, n)``, with counts of columns; a pair with a null gives nulls."""

    @F.pandas_udf("a string, b string, score int, matches bigint, gaps bigint, n bigint")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for x, y in batches:
            ok = x.notna() & y.notna()
            # a text beside itself needs no gap, as no letter of DNA counts against itself
            same = ok & (x == y) if kind == "dna" and not local else ok & False
            ok &= ~same
            solve = kernel.align_local if local else kernel.align_global
            done = iter(solve(x[ok].tolist(), y[ok].tolist(), kind))
            rows = [(*(z := next(done)[:3]), *_columns(z[0], z[1])) if good else (t, t, 2 * sum(map(t.count, "ACGT")), len(t), 0, len(t)) if equal else (None,) * 6 for good, equal, t in zip(ok, same, x, strict=True)]
            yield pd.DataFrame(rows, columns=["a", "b", "score", "matches", "gaps", "n"])

    return run


def aligned_identity(x: Column) -> Column:
    """Percent of equal columns, gaps included, of what ``align_udf`` gives; 0 without columns."""
    return F.when(x["n"] == 0, 0.0).otherwise(100 * x["matches"] / x["n"])


def with_sequences(pairs: DataFrame, texts: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Sequences fetched for the pairs only: ``texts`` has ``id`` and ``s``; so has ``asked``, the queries if they are known."""
    t = texts.select("id", "s")
    return pairs.join((t if asked is None else asked.select("id", "s")).toDF("query", "query_s"), "query").join(t.toDF("id", "s"), "id")


def most_identity(a: str, b: str) -> Column:
    """Upper bound on the percentage of equal columns in any alignment of two texts."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            places = {t: letter_places(t) for t in x.unique()}
            yield pd.Series([100 * common_letters(t, u, places[t]) / max(len(t), len(u), 1) for t, u in zip(x, y, strict=True)], dtype="float64")

    return run.asNondeterministic()(a, b)  # else the filter moves ahead of the shuffle that deals the pairs


def classes(genes: DataFrame, results: int) -> DataFrame:
    """``(id, s, ids)``: each distinct text with the first ids that hold it, one more than ``results``."""
    rank = F.row_number().over(Window.partitionBy("s").orderBy("id"))
    first = genes.select("id", "s").withColumn("_r", rank).where(F.col("_r") <= results + 1)
    return first.groupBy("s").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("id"), "s", "ids")


def _aligned(both: DataFrame, kind: str, parallel: int) -> DataFrame:
    """Pairs of a query with a class, aligned, one row for each of the class's ids other than the query."""
    # a pair costs the product of its lengths, so pairs are dealt one by one, not query by query
    dealt = both.repartition(parallel, "query", "id").select("query", "shared", F.length("query_s").alias("_n"), "ids", align_udf(kind)("query_s", "s").alias("x"))
    x = F.col("x")
    cover = F.when(F.col("_n") > 0, 100 * (x["n"] - x["gaps"]) / F.col("_n")).otherwise(0.0)
    found = dealt.select("query", "ids", "shared", x["score"].alias("score"), x["a"].alias("query_aligned"), x["b"].alias("gene_aligned"), aligned_identity(x).alias("identity"), cover.alias("coverage"))
    return found.withColumn("id", F.explode("ids")).where("query <> id").select("query", "id", "shared", "score", "query_aligned", "gene_aligned", "identity", "coverage")


def _last(found: DataFrame, results: int) -> DataFrame:
    """``(query, _least)``: the identity that a further gene must reach to be among the ``results`` best of a query."""
    best = top(found.select("query", "id", "identity"), "identity", results)
    return best.groupBy("query").agg(F.when(F.count("*") >= results, F.min("identity")).otherwise(0.0).alias("_least"))


def search(
    queries: DataFrame, genes: DataFrame, results: int = 5, kind: str = "dna", alphabet: str = "ACGT", k: int = K,
    sure: float = SURE, candidates: int | None = None, parallel: int | None = None,
) -> DataFrame:
    """The ``results`` most similar genes of each query: ``(query, rank, id, shared, score, query_aligned, gene_aligned, identity, coverage)``.

    Both have ``id`` and ``s``; a query doesn't find itself.  Equal texts are
    one candidate.  The ``candidates`` that share most words with a query
    (``PER_RESULT`` times ``results`` if not given) are aligned globally, but
    for those that by their longest common subsequence can't be among the
    results, and ranked by identity over the whole alignment, ties by id.  Beyond them
    every gene is aligned that could have ``sure`` percent identity or more
    and be among the results.  What can't: an alignment of identity ``t`` has
    at most ``n (1 - t) / t`` differing columns, ``n`` letters of the query,
    and each breaks at most ``k`` of its words, so the others are shared;
    nor can a gene whose length or longest common subsequence is too short.
    With ``sure`` 0 each gene with a word in common counts.
    """
    parallel = parallel or queries.sparkSession.sparkContext.defaultParallelism * 8
    candidates = candidates or PER_RESULT * results
    each = checkpoint(classes(genes, results))
    texts = queries.select(F.col("id").alias("query"), F.col("s").alias("query_s"))

    def broken(t: Column) -> Column:
        """Words that the differing columns of an alignment of identity ``t`` may break; a hair more than the division gives, so that rounding rules nothing out."""
        return F.floor(F.length("query_s") * (1 - t) / t + 1e-9) * k

    spared = texts.select("query", broken(F.lit(max(sure, 1e-6) / 100)).alias("spared"))
    shared = checkpoint(most_shared(queries, each, candidates + 1, k, alphabet, spared))
    several = each.select("id", F.size("ids").alias("_ids"))
    others = lambda df: df.join(several, "id").where("query <> id OR _ids > 1").drop("_ids")
    best = checkpoint(others(top(shared, "shared", candidates + 1)).select("query", "id", "shared"))
    # the likeliest are aligned first; of the others those that could still be among the results
    sooner = checkpoint(_aligned(top(best, "shared", results + 1).drop("rank").join(texts, "query").join(each, "id"), kind, parallel))
    later = best.join(top(best, "shared", results + 1).select("query", "id"), ["query", "id"], "left_anti").join(texts, "query").join(_last(sooner, results), "query", "left").join(each, "id")
    later = later.withColumn("_least", F.coalesce("_least", F.lit(0.0))).where(100 * F.least(F.length("query_s"), F.length("s")) / F.greatest(F.length("query_s"), F.length("s")) >= F.col("_least"))
    later = later.repartition(parallel, "query", "id").where((F.col("_least") == 0) | (most_identity("query_s", "s") >= F.col("_least")))
    first = checkpoint(sooner.unionByName(_aligned(later, kind, parallel)))
    least = texts.join(_last(first, results), "query", "left").select("query", "query_s", F.greatest(F.coalesce("_least", F.lit(0.0)), F.lit(float(sure))).alias("_least"))
    need = F.col("n_words") - broken(F.greatest(F.col("_least"), F.lit(1e-6)) / 100)
    enough = shared.join(least, "query").where(F.col("shared") >= need).select("query", "id", "shared")
    more = others(enough).join(best.select("query", "id"), ["query", "id"], "left_anti")
    rest = more.join(least, "query").join(each, "id")
    n, m = F.length("query_s"), F.length("s")
    rest = rest.where(100 * F.least(n, m) / F.greatest(n, m) >= F.col("_least")).repartition(parallel, "query", "id")
    return top(first.unionByName(_aligned(rest.where(most_identity("query_s", "s") >= F.col("_least")), kind, parallel)), "identity", results)


def brute_force(queries: DataFrame, genes: DataFrame, results: int = 5, kind: str = "dna", least: float = 0.0, parallel: int | None = None, asked: int = ASKED, held: int = GENES // 4) -> DataFrame:
    """``(query, rank, id, identity)``: the ``results`` most similar of all genes, with or without a word in common, of at least ``least`` percent identity.

    Queries in blocks meet genes in parts, every one each; a pair leaves its
    task, as two ids, and is aligned, unless its lengths or its longest common
    subsequence show that it can't reach ``least``.
    """
    parallel = parallel or queries.sparkSession.sparkContext.defaultParallelism * 8
    each = checkpoint(classes(genes, results))
    q = queries.where("s IS NOT NULL").select(F.col("id").cast("bigint").alias("query"), "s")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        gene, near = b["id"].to_numpy(), kernel.Near(b["t"].to_pylist())
        found = [near.of(s, least) for s in a["s"].to_pylist()]
        query = np.repeat(a["query"].to_numpy(), [len(x) for x in found])
        return pa.table({"query": query, "id": gene[np.concatenate([np.empty(0, dtype=np.int64), *found])]})

    pairs = checkpoint(_in_blocks(q, each, asked, held).applyInArrow(run, "query bigint, id bigint"))
    both = pairs.join(q.withColumnRenamed("s", "query_s"), "query").join(each, "id").where((F.col("query") != F.col("id")) | (F.size("ids") > 1))
    return top(_aligned(both.withColumn("shared", F.lit(None).cast("bigint")), kind, parallel).where(F.col("identity") >= least), "identity", results).select("query", "rank", "id", "identity")


def recall(found: DataFrame, best: DataFrame) -> DataFrame:
    """``(query, n_best, n_found)``: how many of a query's best genes a search has found."""
    hits = found.select("query", "id", F.lit(1).alias("_hit"))
    return best.join(hits, ["query", "id"], "left").groupBy("query").agg(F.count("*").alias("n_best"), F.count("_hit").alias("n_found"))


def translated(proteins: DataFrame, genes: DataFrame, word: int = 4, candidates: int = PER_RESULT) -> DataFrame:
    """``(query, gene, frame, shared, score, identity)``: for each protein the gene, and its frame, that it matches best.

    Both have ``id`` and ``s``.  A gene's words are those of its six frames,
    each read to its first stop; of the ``candidates`` genes that share most
    words with a protein all six frames are aligned with it (BLOSUM62).  Of a
    gene the first frame with the highest score counts, of the genes the one
    with the highest identity, ties by id.
    """
    amino = "ACDEFGHIKLMNPQRSTVWY"
    each = checkpoint(classes(genes, candidates))
    every = proteins.where("s IS NOT NULL").select("id", F.min("id").over(Window.partitionBy("s")).alias("query"))
    proteins = checkpoint(classes(proteins, 0)).select("id", "s")  # equal proteins are looked up once
    shared = most_shared(proteins, each, candidates, word, amino, prepare=words.joined_frames)
    # of equal texts the first id stands for all: the others share as much, align alike and lose the tie
    ids = shared.join(each.select(F.col("id").alias("_first"), "ids"), F.col("id") == F.col("_first")).select("query", "_first", F.explode("ids").alias("id"), "shared")
    best = checkpoint(top(ids, "shared", candidates).where("id = _first").select("query", "id", "shared"))
    both = with_sequences(best, each, proteins).repartition(genes.sparkSession.sparkContext.defaultParallelism * 8, "query")
    done = both.select("query", F.col("id").alias("gene"), "shared", best_frame("query", "query_s", "s").alias("x")).select("query", "gene", "x.frame", "shared", "x.score", "x.identity")
    found = top(done.where("frame IS NOT NULL"), "identity", 1, tie="gene").drop("rank")
    return found.join(every, "query").select(F.col("id").alias("query"), "gene", "frame", "shared", "score", "identity")


def best_frame(query: str, protein: str, gene: str) -> Column:
    """``struct(frame, score, identity)``: of the gene's frames, read to their first stop, the first with the highest score.

    Null if no frame reads anything, and for a gene that by the longest common
    subsequence can't be as identical as another of the query's.
    """

    @F.pandas_udf("frame string, score int, identity double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, x, y in batches:
            asked, of, read = x.tolist(), ids.tolist(), [words.frames_to_stop(t) for t in y]
            pairs = [(i, f) for i, frames in enumerate(read) for f, t in enumerate(frames) if t]
            scores = kernel.score_global([asked[i] for i, _ in pairs], [read[i][f] for i, f in pairs], "protein").tolist()
            best: dict[int, tuple[int, int]] = {}
            for (i, f), score in zip(pairs, scores, strict=True):
                if i not in best or score > best[i][0]:
                    best[i] = score, f
            places = {t: letter_places(t) for t in set(asked)}
            most = {i: 100 * common_letters(asked[i], t := read[i][f], places[asked[i]]) / max(len(asked[i]), len(t)) for i, (_, f) in best.items()}
            rows: list[tuple] = [(None, None, None)] * len(asked)
            reached: dict[int, float] = {}

            def solve(some: list[int]) -> None:
                done = kernel.align_global([asked[i] for i in some], [read[i][best[i][1]] for i in some], "protein")  # noqa: B023
                for i, (a, b, _) in zip(some, done, strict=True):
                    same, _, n = _columns(a, b)
                    rows[i] = words.FRAMES[best[i][1]], best[i][0], 100 * same / n if n else 0.0  # noqa: B023
                    reached[of[i]] = max(reached.get(of[i], 0.0), rows[i][2])  # noqa: B023

            first: dict[int, int] = {}
            for i in sorted(most, key=lambda i: -most[i]):  # noqa: B023
                first.setdefault(of[i], i)
            solve(list(first.values()))
            solve([i for i in most if first[of[i]] != i and most[i] >= reached[of[i]] - 1e-9])
            yield pd.DataFrame(rows, columns=["frame", "score", "identity"]).astype({"score": "Int32"})

    return run(query, protein, gene)


def containment(queries: DataFrame, genes: DataFrame, least: int = K, asked: int = ASKED, held: int = GENES) -> DataFrame:
    """``(query, id)``: the gene stands word for word within the query.

    Both have ``id`` and ``s``; empty texts stand nowhere, a sequence doesn't
    contain itself.  Queries in blocks meet genes in parts: a gene is looked
    for in the queries that have that of its words of ``least`` letters of
    ``ACGT`` which fewest queries have; a gene without such a word in each.
    """

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        index = words.Asked(a["s"].to_pylist(), least, "ACGT")
        query, text, rows = a["query"].to_pylist(), a["s"].to_pylist(), []
        ids, seeds = b["id"].to_pylist(), b["t"].to_pylist()
        for i, s, near in zip(ids, seeds, index.holders(seeds), strict=True):
            rows += [(query[j], i) for j in (range(len(text)) if near is None else near) if s in text[j] and query[j] != i]
        return pa.table({"query": pa.array([q for q, _ in rows], pa.int64()), "id": pa.array([i for _, i in rows], pa.int64())})

    q = queries.where("s IS NOT NULL").select(F.col("id").cast("bigint").alias("query"), "s")
    return _in_blocks(q, genes.where("s <> ''"), asked, held).applyInArrow(run, "query bigint, id bigint")
