import math
import random

from helixspark.kernels import align, trees
from helixspark.operators import phylogeny


def plain_distances(a, b):
    pairs = [(x, y) for x, y in zip(a, b, strict=True) if "-" not in (x, y)]
    n = len(pairs)
    ts = sum(x + y in ("AG", "GA", "CT", "TC") for x, y in pairs)
    d = sum(x != y for x, y in pairs)
    p, q = (ts / n, (d - ts) / n) if n else (0, 0)
    jc = -0.75 * math.log(1 - 4 * (p + q) / 3) if p + q < 0.75 else None
    x, y = 1 - 2 * p - q, 1 - 2 * q
    return n, n - d, ts, d - ts, p + q, jc, -0.5 * math.log(x * math.sqrt(y)) if x > 0 and y > 0 else None


def test_every_form_of_a_hot_group(spark):
    """More forms than a tree has representatives, and one far longer than the others: all aligned as by ``star``, all leaves."""
    rng = random.Random(6)
    base = [rng.choice("ACGT") for _ in range(60)]
    forms = set()
    while len(forms) < 80:
        s = list(base)
        for _ in range(3):
            s[rng.randrange(60)] = rng.choice(["A", "C", "G", "T", "", "AC"])
        forms.add("".join(s))
    texts = {f"{i:03}": s for i, s in enumerate(sorted(forms))} | {"999": "ACGT" * 1300}
    rows = [("hot", n, s) for n, s in texts.items()] + [("hot", "500", texts["000"]), ("few", "a", "ACGT"), ("few", "b", "ACT")]
    df = spark.createDataFrame(rows, "group string, name string, s string")
    aligned = phylogeny.star_alignment(df).checkpoint()
    got = {(r["group"], r["name"]): r for r in phylogeny.group_alignment(df).collect()}
    want = align.star([texts[n] for n in sorted(texts)])
    assert [got["hot", n]["aligned"] for n in sorted(texts)] == want and ("hot", "500") not in got
    share = 100 * sum(len({x for x in c if x != "-"}) == 1 for c in zip(*want, strict=True)) / len(want[0])
    assert abs(got["hot", "000"]["conservation"] - share) < 1e-9 and got["few", "a"]["conservation"] == 100.0
    row = dict(zip(sorted(texts), want, strict=True))
    found = {(r["a"], r["b"]): r for r in phylogeny.group_distances(aligned).where("group = 'hot'").collect()}
    heads = sorted(texts)[:64]
    assert set(found) == {(a, b) for a in texts for b in heads if a > b}
    for (a, b), r in found.items():
        plain = plain_distances(row[a], row[b])
        assert (r["n"], r["matches"], r["transitions"], r["transversions"]) == plain[:4] and r["both_heads"] == (a in heads)
        for x, y in zip((r["hamming"], r["jukes_cantor"], r["kimura"]), plain[4:], strict=True):
            assert (x is None) == (y is None) and (x is None or abs(x - y) < 1e-9)
    tree, = phylogeny.group_trees(df).collect()
    assert (tree["group"], tree["n"], tree["n_placed"]) == ("hot", 81, 17)
    for text in (tree["upgma"], tree["neighbour_joining"]):
        edges = trees.parse_newick(text)
        assert {c for _, c, _ in edges} - {p for p, _, _ in edges} == set(texts)
    assert phylogeny.group_trees(df.limit(0)).count() == 0 and phylogeny.group_alignment(df.limit(0)).count() == 0


def test_all_pairs_of_a_set(spark):
    texts = {1: "ACGTACGTAC", 2: "ACGTACGTAC", 3: "ACGTTTGTAC", 4: "GG"}
    df = spark.createDataFrame(list(texts.items()), "id bigint, s string")
    pairs = phylogeny.all_pairs(df, "dna")
    for r in pairs.collect():
        (x, y, _), = align.align_global([texts[r["i"]]], [texts[r["j"]]])
        same = sum(p == q for p, q in zip(x, y, strict=True))
        assert r["matches"] == same and abs(r["similarity"] - same / max(len(texts[r["i"]]), len(texts[r["j"]]))) < 1e-12
    ranked = pairs.orderBy("rank").collect()
    assert (ranked[0]["i"], ranked[0]["j"], ranked[0]["distance"]) == (1, 2, 0.0) and len(ranked) == 6
    tree, = phylogeny.set_tree(pairs).collect()
    assert tree["n"] == 4 and "(1:0,2:0)" in tree["upgma"]
    assert phylogeny.set_tree(phylogeny.all_pairs(df.where("id < 3"), "dna")).count() == 0
