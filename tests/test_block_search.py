"""Searches at size: words, pairs by chance and seeds stay within tasks, and results are those of brute force."""

import random

import pytest

from pyspark.sql import functions as F

from helixspark.functions import seq
from helixspark.kernels import align
from helixspark.kernels import words as kernel
from helixspark.operators import search


def words(s, k=12):
    return {s[i : i + k] for i in range(len(s) - k + 1)} - {"N" * k}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    draw = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    base = draw(90)
    near = ["".join(c if rng.random() > 0.03 else rng.choice("ACGT") for c in base) for _ in range(20)]
    out = [base, *near, *near[:6], *near[:3], "", "ACGT", "N" * 40, *(draw(rng.randint(12, 120)) for _ in range(20))]
    return list(enumerate(out))


@pytest.mark.parametrize(("asked", "held"), [(10**6, 10**6), (200, 500)])
def test_most_shared_words(spark, rows, asked, held):
    genes = spark.createDataFrame(rows, "id bigint, s string")
    queries = genes.where("id % 3 = 0")
    sets = {i: words(s) for i, s in rows}
    counts = {q: sorted((-len(sets[q] & w), i) for i, w in sets.items() if sets[q] & w) for q in sets if q % 3 == 0}
    got = search.most_shared(queries, genes, 4, asked=asked, held=held)
    assert "kmer" not in got._jdf.queryExecution().toString()  # no word is shuffled
    assert {tuple(r) for r in got.collect()} == {(q, i, -n, len(sets[q])) for q, c in counts.items() for n, i in c[:4]}
    more = search.most_shared(queries, genes, 2, spared=queries.selectExpr("id AS query", "30 AS spared"), asked=asked, held=held)
    assert {tuple(r) for r in more.collect()} == {(q, i, -n, len(sets[q])) for q, c in counts.items() for r, (n, i) in enumerate(c) if r < 2 or -n >= len(sets[q]) - 30}


def test_shared_top_of_equal_texts(spark, rows):
    genes = spark.createDataFrame(rows, "id bigint, s string")
    sets = {i: words(s) for i, s in rows}
    for k in (1, 5):
        got = {(r["query"], r["rank"], r["id"], r["shared"]) for r in search.shared_top(genes.where("id % 2 = 0"), genes, k).collect()}
        assert got == {(q, r, i, -n) for q in sets if q % 2 == 0 for r, (n, i) in enumerate(sorted((-len(sets[q] & w), i) for i, w in sets.items() if i != q and sets[q] & w)[:k], 1)}


@pytest.mark.parametrize(("asked", "held"), [(10**6, 10**6), (150, 300)])
def test_containment_in_blocks(spark, rows, asked, held):
    inner = [(1000 + i, s[i : i + 5 + 3 * i]) for i, (_, s) in enumerate(rows[:20])] + [(2000, "N" * 14), (2001, "NN" + rows[0][1][3:9]), (2002, "N" * 3 + rows[1][1][:12])]
    inner += [(3000, inner[-1][1] + "ACGT"), (3001, "A" + "N" * 30)]
    every = [*rows, *inner]
    genes = spark.createDataFrame(every, "id bigint, s string")
    got = search.containment(genes.where("id % 3 = 0"), genes, asked=asked, held=held)
    assert "_seed" not in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.collect())) == sorted((q, i) for q, t in every if q % 3 == 0 for i, s in every if s and i != q and s in t)


def test_translated_in_blocks(spark):
    """Against all frames of all genes: words of six frames, the best frame of each candidate, the most identical gene; no word is shuffled."""
    rng = random.Random(8)
    draw = lambda n, s="ACGT": "".join(rng.choice(s) for _ in range(n))
    genes = [(i, draw(rng.randint(1, 200), "ACGTGCN" if i % 5 == 0 else "ACGCGGT")) for i in range(60)]
    genes += [(100 + i, genes[i][1]) for i in range(20)] + [(200, "TAA"), (201, "")]
    frames = {i: kernel.frames_to_stop(s) for i, s in genes}
    df = spark.createDataFrame(genes, "id bigint, s string")
    read = df.select("id", F.transform(seq.six_frames(F.col("s")), lambda f: F.substring_index(seq.amino_acids(f["bases"]), "*", 1)).alias("t"))
    assert {r["id"]: r["t"] for r in read.collect()} == frames
    proteins = [(1000 + i, max(frames[i], key=len)[:40] + draw(5, "ACDEFWY")) for i in range(0, 60, 3)] + [(2000, "WWWWWW"), (2001, "")]
    cut = lambda t: {t[j : j + 4] for j in range(len(t) - 3) if "?" not in t[j : j + 4]}
    want = set()
    for q, p in proteins:
        near = sorted((-n, g) for g, ts in frames.items() if (n := len(cut(p) & set().union(*map(cut, ts)))))[:5]
        scored = []
        for n, g in near:
            done = [(align.align_global([p], [t], "protein")[0], f) for f, t in enumerate(frames[g]) if t]
            (a, b, score), f = max(done, key=lambda x: (x[0][2], -x[1]))
            scored.append((-100 * sum(x == y != "-" for x, y in zip(a, b, strict=True)) / len(a), g, kernel.FRAMES[f], -n, score))
        if scored:
            i, g, f, n, score = min(scored)
            want.add((q, g, f, n, score, -i))
    got = search.translated(spark.createDataFrame(proteins, "id bigint, s string"), df, candidates=5)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 10
    assert "kmer" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize(("asked", "held"), [(10**6, 10**6), (150, 400)])
def test_brute_force_in_blocks(spark, rows, asked, held):
    """No pair is written before the bound on identity is applied."""
    rows = [r for r in rows if r[1]]
    genes = spark.createDataFrame(rows, "id bigint, s string")
    got = search.brute_force(genes.where("id % 3 = 0"), genes, results=4, least=75.0, parallel=4, asked=asked, held=held)
    want = set()
    for q, s in rows[::1]:
        if q % 3 == 0:
            done = align.align_global([s] * len(rows), [t for _, t in rows])
            near = sorted((-100 * sum(x == y != "-" for x, y in zip(a, b, strict=True)) / len(a), i) for (i, _), (a, b, _) in zip(rows, done, strict=True) if i != q)
            want |= {(q, r, i, -x) for r, (x, i) in enumerate([n for n in near if n[0] <= -75][:4], 1)}
    assert {tuple(r) for r in got.collect()} == want and want
    plan = got._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Join Cross" not in plan
