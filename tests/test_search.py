import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from helixspark.functions import seq
from helixspark.kernels import align
from helixspark.operators import search


def identity(a, b):
    (x, y, _), = align.align_global([a], [b])
    return 100 * sum(p == q for p, q in zip(x, y, strict=True)) / len(x)


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.text("ACGT", max_size=30), st.text("ACGT", max_size=30))
def test_common_letters(a, b):
    assert search.common_letters(a, b) == plain_common(a, b)


@pytest.fixture(scope="module")
def family():
    """One hot family: near copies by the hundred with gaps between equal words, equal texts, and unrelated genes."""
    rng = random.Random(2)
    draw = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    base = draw(150)
    rows = [(0, base)]
    # share all of the query's words, but are twice as long: many slots by words, low identity
    rows += [(i, base + draw(140)) for i in range(1, 60)]
    # equal texts
    rows += [(i, rows[1][1]) for i in range(60, 120)]
    # few words in common, but nearest by identity
    near = [b if i % 16 else "ACGT"["CGTA".index(b)] for i, b in enumerate(base)]
    rows += [(200 + i, "".join(near[: 140 - i] + list(base[140 - i :]))) for i in range(4)]
    return rows + [(300 + i, draw(rng.randint(40, 400))) for i in range(40)]


def test_search_finds_what_brute_force_finds(spark, family):
    genes = spark.createDataFrame(family, "id bigint, s string")
    queries = genes.where("id IN (0, 1, 200)")
    found = search.search(queries, genes, results=3, parallel=4)
    text = dict(family)
    for q in (0, 1, 200):
        best = sorted((-identity(text[q], s), i) for i, s in family if i != q)[:3]
        got = [r["id"] for r in found.where(f"query = {q}").orderBy("rank").collect()]
        assert got == [i for _, i in best]
    best = search.brute_force(queries, genes, results=3, parallel=4).checkpoint()
    assert {tuple(r) for r in search.recall(found, best).collect()} == {(0, 3, 3), (1, 3, 3), (200, 3, 3)}
    # a search that returns nothing has a recall of 0
    assert {tuple(r) for r in search.recall(found.limit(0), best.where("query = 0")).collect()} == {(0, 3, 0)}
    # a bound on identity leaves out what lies below it, and nothing else
    text = dict(family)
    high = search.brute_force(queries.where("id = 0"), genes, results=8, least=94.0, parallel=4)
    assert {r["id"] for r in high.collect()} == {i for i, s in family if i and identity(text[0], s) >= 94}


@pytest.mark.parametrize("hot", [0, 3, 1000])
def test_shared_words(spark, family, hot):
    """Whatever counts as a hot word, the counts and the best are those of the sets."""
    rows = [*family, (900, ""), (901, "ACGT"), (902, "N" * 40)]
    genes = spark.createDataFrame(rows, "id bigint, s string")
    queries = genes.where("id IN (0, 3, 200, 301, 900)")
    sets = {i: {s[j : j + 12] for j in range(len(s) - 11)} - {"N" * 12} for i, s in rows}
    counts = {q: {i: len(sets[q] & w) for i, w in sets.items() if sets[q] & w} for q in (0, 3, 200, 301)}
    words = search.SharedWords(search.code_index(queries), search.code_index(genes), hot)
    for need in (0, 20, 139):
        got = words.at_least(queries.selectExpr("id AS query", f"{need} AS need"))
        assert {(r["query"], r["id"], r["shared"]) for r in got.collect()} == {(q, i, n) for q, c in counts.items() for i, n in c.items() if n >= max(need, 1)}
    pruned = search.SharedWords(search.code_index(queries), search.code_index(genes), hot, 6, queries.selectExpr("id AS query", "120 AS spared"))
    assert pruned.rare.count() <= words.rare.count()
    enough = {(r["query"], r["id"], r["shared"]) for r in pruned.at_least(pruned.sizes.selectExpr("query", "n_words - 120 AS need")).collect()}
    assert enough == {(q, i, n) for q, c in counts.items() for i, n in c.items() if n >= max(len(sets[q]) - 120, 1)}
    best, fewer = ({(r["query"], r["rank"], r["id"], r["shared"]) for r in w.top(5).collect()} for w in (words, pruned))
    assert best == fewer == {(q, r, i, n) for q, c in counts.items() for r, (n, i) in enumerate(sorted((-n, i) for i, n in c.items() if i != q)[:5], 1) for n in [-n]}


def test_codes_and_words(spark):
    amino = "ACDEFGHIKLMNPQRSTVWY"
    df = spark.createDataFrame([("ACGTACGTACGT", "YYYYYYYYYYYY"), ("TTTTTTTTTTTT", "ACDEFGHIKLMN"), ("ACGN", "x")], "a string, b string")
    got = df.select(seq.kmer_code(F.col("a"), "ACGT").alias("a"), seq.kmer_code(F.col("b"), amino).alias("b"))
    assert [tuple(r) for r in got.collect()] == [(int("012301230123", 4), 20**12 - 1), (4**12 - 1, sum(i * 20 ** (11 - i) for i in range(12))), (None, None)]
    back = got.select(seq.kmer_word(F.col("a"), "ACGT", 12), seq.kmer_word(F.col("b"), amino, 12))
    assert [tuple(r) for r in back.collect()] == [("ACGTACGTACGT", "YYYYYYYYYYYY"), ("TTTTTTTTTTTT", "ACDEFGHIKLMN"), (None, None)]
    odd = spark.createDataFrame([(-1,), (4**12,), (20**12,)], "k bigint").select(seq.kmer_word(F.col("k"), "ACGT", 12), seq.kmer_word(F.col("k"), amino, 12))
    word = "".join(amino[(4**12 // 20**i) % 20] for i in range(11, -1, -1))
    assert [tuple(r) for r in odd.collect()] == [(None, None), (None, word), (None, None)]


def test_trigram_sets_of_sequences(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("ACGTN" if i % 3 else "AC") for _ in range(rng.randint(1, 60)))) for i in range(120)] + [(500, ""), (501, "A"), (502, "AC"), (503, "A")]
    rows += [(600 + i, rows[5][1]) for i in range(9)]
    grams = {i: {f"  {s.lower()} "[j : j + 3] for j in range(len(s) + 1)} for i, s in rows if s}
    size = {i: len(s) for i, s in rows}
    df = spark.createDataFrame(rows, "id bigint, s string")
    asked = [0, 5, 500, 501, 502, 601]
    for ratio in (3, None):
        got = search.sequence_trigram_top(df.where(F.col("id").isin(asked)), df, 6, ratio, blocks=3).collect()
        want = set()
        for q in asked:
            if q in grams:
                near = [(-len(grams[q] & g) / len(grams[q] | g), i) for i, g in grams.items() if i != q and (ratio is None or max(size[i], size[q]) <= 3 * min(size[i], size[q]))]
                want |= {(q, r, i, -n) for r, (n, i) in enumerate(sorted(x for x in near if x[0] <= -0.3)[:6], 1)}
        assert {tuple(r) for r in got} == want


def test_containment_of_short_genes(spark):
    df = spark.createDataFrame([(1, "ACGTACGTACGTACGT"), (2, "CGT"), (3, "A"), (4, "TTT"), (5, ""), (6, "GTACGTACGTACG"), (7, "CGT")], "id bigint, s string")
    assert {tuple(r) for r in search.containment(df.where("id IN (1, 2, 5)"), df).collect()} == {(1, 2), (1, 3), (1, 6), (1, 7), (2, 7)}


def test_translated(spark):
    """A protein is found in a gene on the other strand and in another frame, by alignment."""
    rng = random.Random(9)
    draw = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    coding = "".join(rng.choice(["GCT", "TGT", "GAT", "GAA", "TTT", "GGT", "CAT", "ATT", "AAA", "CTT"]) for _ in range(60))
    back = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    genes = spark.createDataFrame([(1, draw(180)), (2, back("C" + coding + "TA")), (3, draw(180)), (4, "")], "id bigint, s string")
    table = {"GCT": "A", "TGT": "C", "GAT": "D", "GAA": "E", "TTT": "F", "GGT": "G", "CAT": "H", "ATT": "I", "AAA": "K", "CTT": "L"}
    protein = "".join(table[coding[i : i + 3]] for i in range(0, 180, 3))
    proteins = spark.createDataFrame([(50, protein[:30] + "W" + protein[31:]), (51, "WWWW")], "id bigint, s string")
    (r,) = search.translated(proteins, genes).collect()
    assert (r["query"], r["gene"], r["frame"]) == (50, 2, "-2") and 95 < r["identity"] < 100
