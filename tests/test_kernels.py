import random

from hypothesis import given, settings
from hypothesis import strategies as st

from helixspark.kernels import align, trees


def plain_global(s, t, kind="dna", go=-10, ge=-1):
    """The recurrence cell by cell."""
    m, n, neg = len(s), len(t), align.NEG
    grid = lambda: [[neg] * (n + 1) for _ in range(m + 1)]
    a, x, y, ta, tx, ty = grid(), grid(), grid(), grid(), grid(), grid()
    a[0][0] = 0
    pick = lambda o, e: (o, 0) if o >= e else (e, 1)
    for i in range(m + 1):
        for j in range(n + 1):
            if i and j:
                before = (a[i - 1][j - 1], x[i - 1][j - 1], y[i - 1][j - 1])
                a[i][j], ta[i][j] = align.score(s[i - 1], t[j - 1], kind) + max(before), before.index(max(before))
            if i:
                x[i][j], tx[i][j] = pick(a[i - 1][j] + go, x[i - 1][j] + ge)
            if j:
                y[i][j], ty[i][j] = pick(a[i][j - 1] + go, y[i][j - 1] + ge)
    last = (a[m][n], x[m][n], y[m][n])
    state, p, q, i, j = last.index(max(last)), "", "", m, n
    while i or j:
        if state == 0:
            p, q, state, i, j = s[i - 1] + p, t[j - 1] + q, ta[i][j], i - 1, j - 1
        elif state == 1:
            p, q, state, i = s[i - 1] + p, "-" + q, tx[i][j], i - 1
        else:
            p, q, state, j = "-" + p, t[j - 1] + q, 2 if ty[i][j] else 0, j - 1
    return p, q, max(last)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.text("ACGTN", max_size=14), st.text("ACGTN", max_size=14)), min_size=1, max_size=8))
def test_global_equals_the_recurrence(pairs):
    assert align.align_global([p[0] for p in pairs], [p[1] for p in pairs]) == [plain_global(*p) for p in pairs]


def test_global_protein_and_batches():
    rng = random.Random(5)
    pairs = [tuple("".join(rng.choice("ACDEFGHIKLMNPQRSTVWYX") for _ in range(rng.randint(0, 20))) for _ in "ab") for _ in range(60)]
    assert align.align_global([p[0] for p in pairs], [p[1] for p in pairs], "protein") == [plain_global(*p, "protein") for p in pairs]


def test_rows_filled_again_give_the_same_way_back(monkeypatch):
    """With few cells at once only some rows are stored and the others filled twice."""
    rng = random.Random(7)
    pairs = [tuple("".join(rng.choice("ACGTN") for _ in range(rng.randint(0, 40))) for _ in "ab") for _ in range(80)]
    a, b = [p[0] for p in pairs], [p[1] for p in pairs]
    want = align.align_global(a, b), align.align_local(a, b)
    for cells in (1000, 100, 1):
        monkeypatch.setattr(align, "CELLS", cells)
        assert (align.align_global(a, b), align.align_local(a, b)) == want


def test_no_length_is_refused():
    rng = random.Random(8)
    a = "".join(rng.choice("ACGT") for _ in range(9000))
    b = a[:3000] + "TT" + a[3000:7000] + a[7010:]
    (x, y, _), = align.align_global([a], [b])
    assert x.replace("-", "") == a and y.replace("-", "") == b and x.count("-") == 2 and y.count("-") == 10
    (x, y, s, *_), = align.align_local([a], [b])
    assert x.replace("-", "") in a and len(x) > 8900 and s > 17000


def test_known_alignments():
    (a, b, _), = align.align_global(["GGTCAATCCA"], ["GGTCAATCCA"])
    assert a == b == "GGTCAATCCA"
    (a, b, _), = align.align_global(["GTCA"], ["GTTCA"])
    assert "-" in a and len(a) == len(b) == 5
    (a, b, s, i, j), = align.align_local(["TTTACGTACGTTT"], ["GGACGTACGGG"])
    assert (a, b, s) == ("ACGTACG", "ACGTACG", 14)
    assert align.align_local([""], ["ACGT"])[0][:3] == ("", "", 0)


def test_star_keeps_every_letter():
    rows = ["ATGC", "ATGGC", "ATGC", "ATC", ""]
    out = align.star(rows)
    assert len({len(r) for r in out}) == 1 and [r.replace("-", "") for r in out] == rows
    assert align.star([]) == [] and align.star(["A"]) == ["A"]


def test_trees():
    m, names = [[0, 0.1, 0.2], [0.1, 0, 0.15], [0.2, 0.15, 0]], ["A", "B", "C"]
    assert trees.newick(trees.upgma_edges(trees.upgma(m, names))) == "((A:0.05,B:0.05)U1:0.0375,C:0.0875)U2;"
    edges = trees.neighbour_joining(m, names)
    assert {c for _, c, _ in edges} == {"A", "B", "C"}
    assert trees.parse_newick("((A:1,B:2)X:0.5,C:3)R;") == [("X", "A", 1.0), ("X", "B", 2.0), ("R", "X", 0.5), ("R", "C", 3.0)]
    four = trees.neighbour_joining([[0, 5, 9, 9], [5, 0, 10, 10], [9, 10, 0, 8], [9, 10, 8, 0]], list("abcd"))
    length = {frozenset(e[:2]): e[2] for e in four}
    assert length[frozenset(("N1", "a"))] == 2.0 and length[frozenset(("N1", "b"))] == 3.0
    assert trees.newick([]) == ";"
    assert trees.upgma([[0, float("nan")], [float("nan"), 0]], ["a", "b"])
