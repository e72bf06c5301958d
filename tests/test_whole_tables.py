"""Reports on genes and their nearest are those of every gene, not of a share of them."""

import random

import pytest

from helixspark.kernels import align
from helixspark.operators import search, variants
from helixspark.plans import extras, presentation, similarity
from helixspark.plans.base import dna, proteins


def words(s, k=12):
    return {s[i : i + k] for i in range(len(s) - k + 1) if set(s[i : i + k]) <= set("ACGT")}


def nearest(rows):
    """Of each row the other one that shares most words with it, ties by id."""
    sets = {i: words(s) for i, s in rows}
    out = {}
    for q in sets:
        found = [(-len(sets[q] & w), i) for i, w in sets.items() if i != q and sets[q] & w]
        if found:
            out[q] = min(found)[1]
    return out


@pytest.fixture(scope="module")
def pairs(spark, small):
    rows = dict(map(tuple, dna(spark, small).select("id", "s").collect()))
    best = nearest(rows.items())
    done = align.align_global([rows[q] for q in best], [rows[i] for i in best.values()])
    return {q: (a, b, len(rows[q])) for q, (a, b, _) in zip(best, done, strict=True)}


def differing(a, b):
    return sum(x != y and "-" not in (x, y) for x, y in zip(a, b, strict=True))


def test_nearest_of_every_gene(spark):
    rng = random.Random(3)
    draw = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    base = draw(80)
    texts = [base, base, base + "A", base, base[:60], base[:60], base + "A", draw(50), base[20:] + draw(30), "ACGT", draw(50)]
    rows = list(enumerate(texts, 1))
    both, of = search.nearest(spark.createDataFrame(rows, "id bigint, s string"))
    assert {r["query"]: r["id"] for r in of.collect()} == nearest(rows)
    one, text = {r["pair"]: r for r in both.collect()}, dict(rows)
    assert all((text[r["query"]], text[r["id"]]) == (one[r["pair"]]["query_s"], one[r["pair"]]["s"]) for r in of.collect())
    assert len(one) < of.count()


def test_first_variants_of_every_gene(spark, small, pairs):
    got = {r["pair"]: r["n"] for r in extras.first_variants(spark, small).groupBy("pair").agg({"rank": "max"}).toDF("pair", "n").collect()}
    assert any(p % similarity.EVERY for p in got)
    assert got == {q: min(n, 50) for q, (a, b, _) in pairs.items() if (n := differing(a, b))}


def test_mutation_profile_of_every_gene(spark, small, pairs):
    got = {r["pair"]: r["n"] for r in extras.mutation_profile(spark, small).collect()}
    assert got == {q: n for q, (a, b, _) in pairs.items() if (n := differing(a, b))}


def test_variant_summary_of_every_gene(spark, small, pairs):
    rows = similarity.variant_summary(spark, small).collect()
    assert sum(r["n"] for r in rows if r["kind"] == "substitution") == sum(differing(a, b) for a, b, _ in pairs.values())
    assert sum(r["n_letters"] for r in rows if r["kind"] == "indel") == sum((a + b).count("-") for a, b, _ in pairs.values())


def test_alignment_series_of_every_gene(spark, small, pairs):
    got = {r["id"]: r["count"] for r in presentation.alignment_series(spark, small).where("series = 'strip'").groupBy("id").count().collect()}
    assert got == {q: min(len(a), presentation.STRIP) for q, (a, b, _) in pairs.items()}


def test_translated_search_of_every_protein(spark, small):
    rows, genes = proteins(spark, small), dna(spark, small)
    got = {tuple(r) for r in similarity.translated_search(spark, small).collect()}
    assert any(r[0] % similarity.EVERY for r in got)
    some = rows.orderBy("id").limit(12)
    assert {tuple(r) for r in search.translated(some, genes).collect()} == {r for r in got if r[0] in {x["id"] for x in some.collect()}}


def test_equal_proteins_are_found_alike(spark):
    df = lambda rows: spark.createDataFrame(rows, "id bigint, s string")
    got = search.translated(df([(1, "MKVLAT"), (2, "MKVLAT")]), df([(10, "ATGAAAGTTCTGGCTACT"), (11, "ATGAAAGTTCTG")])).collect()
    assert sorted((r["query"], r["gene"], r["frame"]) for r in got) == [(1, 10, "+1"), (2, 10, "+1")]


def test_substitutions_behind_a_gap(spark):
    row = (1, "ATG-CATTTAAC", "ATGGCA---ATC", "ATGCATTTAAC", "ATGGCAATC")
    df = spark.createDataFrame([row, (2, None, None, "A", "A")], "pair bigint, query_aligned string, gene_aligned string, query_s string, s string")
    assert [tuple(r) for r in variants.substitutions(df).collect()] == [(1, 8, 10, "T", "A", "transversion", "downstream_of_frameshift")]
    assert [tuple(r) for r in variants.indel_blocks(df).orderBy("_col").collect()] == [(1, "deletion", 4, 3, 3, 3, 1, "G", True), (1, "insertion", 6, 6, 6, 8, 3, "TTT", False)]


@pytest.mark.parametrize("few", [0, 100])
def test_near_texts_are_all_found(monkeypatch, few):
    monkeypatch.setattr(align.Near, "FEW", few)
    rng = random.Random(8)
    draw = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    for n in (1, 63, 64, 65, 200):
        text = draw(n)
        change = lambda p: "".join(c if rng.random() > p else rng.choice(("", "A", "GTA", "N", c + "C")) for c in text)  # noqa: B023, E731
        texts = ["", text, text[n // 4 :], text + draw(n // 3), *(change(rng.choice((0.05, 0.2, 0.35))) for _ in range(30)), *(draw(rng.randint(1, 2 * n)) for _ in range(10))]
        done = align.align_global([text] * len(texts), texts)
        for least in (60.0, 75.0):
            got = set(align.Near(texts).of(text, least).tolist())
            alike = {i for i, (a, b, _) in enumerate(done) if 100 * sum(x == y for x, y in zip(a, b, strict=True)) >= least * len(a)}
            assert alike <= got <= {i for i, t in enumerate(texts) if 100 * align.common_letters(text, t) / max(n, len(t)) >= least}
        assert sorted(align.Near(texts).of(text, 0.0).tolist()) == list(range(len(texts)))


def test_search_aligns_only_what_could_be_found(spark, monkeypatch):
    rng = random.Random(9)
    draw = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    base = draw(60)
    rows = [(i, base[:i] + "T" + base[i + 1 :]) for i in range(1, 6)] + [(i, base[:14] + draw(46)) for i in range(10, 30)]
    done, solve = spark.sparkContext.accumulator(0), search.align_udf

    def counted(kind="dna", local=False):
        mark = search.F.udf(lambda x: done.add(1) or x, "string").asNondeterministic()
        return lambda a, b: solve(kind, local)(mark(a) if isinstance(a, search.Column) else mark(search.F.col(a)), search.F.col(b))

    monkeypatch.setattr(search, "align_udf", counted)
    genes = spark.createDataFrame([(0, base), *rows], "id bigint, s string")
    got = search.search(genes.where("id = 0"), genes, results=3, parallel=2).orderBy("rank").collect()
    best = sorted((-100 * sum(x == y for x, y in zip(a, b, strict=True)) / len(a), i) for (i, _), (a, b, _) in zip(rows, align.align_global([base] * len(rows), [s for _, s in rows]), strict=True))
    assert [r["id"] for r in got] == [i for _, i in best[:3]]
    assert done.value < 15
