import random

import pytest

from helixspark.operators import patterns


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("ACGT") for _ in range(rng.choice([0, 1, 2, 3, 20, 60, 200])))) for i in range(40)]
    rows += [(100, "GGGCGGGCGG"), (101, "A" * 30), (102, "CACACACACAGCAGCAGC"), (103, "ATGAAATAATTAG"), (104, None), (105, "NNNNNN"), (106, "ATG" * 3000)]
    return rows, spark.createDataFrame([(i, s, i, "x") for i, s in rows], "id bigint, s string, start bigint, frame string")


def back(s):
    return s.translate(str.maketrans("ATGCN", "TACGN"))[::-1]


def test_reading_frames(texts):
    rows, df = texts
    want = set()
    for i, s in rows:
        for sign, t in (("+", s or ""), ("-", back(s or ""))):
            for f in range(3):
                stops = [k for k in range(f, len(t) - 2, 3) if t[k : k + 3] in ("TAA", "TAG", "TGA")]
                for k in range(f, len(t) - 2, 3):
                    if t[k : k + 3] == "ATG":
                        stop = next((x for x in stops if x >= k), None)
                        end = len(t) if stop is None else stop + 3
                        if end - k >= 30:
                            a, z = (k + 1, end) if sign == "+" else (len(t) - end + 1, len(t) - k)
                            want.add((i, f"{sign}{f + 1}", a, z, end - k, stop is not None))
    assert {tuple(r) for r in patterns.reading_frames(df).collect()} == want


def test_motifs(texts):
    rows, df = texts
    found = {(r["id"], r["name"], r["start"]) for r in patterns.motif_hits(df).collect()}
    assert {(100, "GC-box", 1), (100, "GC-box", 5)} <= found
    motifs = {"E-box / MYC recognition": lambda x: x[:2] == "CA" and x[4:] == "TG" and set(x[2:4]) <= set("ACGT"), "TATA-box": lambda x: x == "TATAAA"}
    for name, ok in motifs.items():
        want = {(i, name, k + 1) for i, s in rows if s for k in range(len(s) - 5) if ok(s[k : k + 6])}
        assert {x for x in found if x[1] == name} == want


def test_repeats(texts):
    rows, df = texts
    want, runs = set(), set()
    for i, s in rows:
        for u in (2, 3, 4):
            k = 0
            while s and k + u <= len(s):
                n = 1
                while s[k + n * u : k + (n + 1) * u] == s[k : k + u]:
                    n += 1
                if n >= 3:
                    want.add((i, s[k : k + u], k + 1, k + n * u, n))
                k += n * u if n >= 3 else 1
        k = 0
        while s and k < len(s):
            z = k
            while z < len(s) and s[z] == s[k]:
                z += 1
            if z - k >= 6:
                runs.add((i, s[k], k + 1, z, z - k))
            k = z
    assert {tuple(r) for r in patterns.tandem_repeats(df).collect()} == want
    assert {tuple(r) for r in patterns.homopolymers(df).collect()} == runs


@pytest.mark.parametrize("width", [20, 7, 3])
def test_windows(texts, width):
    rows, df = texts
    step = max(1, width // 4)
    want = {(i, k + width // 2, sum(c in "GC" for c in s[k : k + width])) for i, s in rows if s for k in range(0, len(s) - width + 1, step)}
    assert {tuple(r) for r in patterns.gc_windows(df, width).collect()} == want


def test_empty(spark):
    none = spark.createDataFrame([], "id bigint, s string")
    for f in (patterns.reading_frames, patterns.motif_hits, patterns.homopolymers, patterns.tandem_repeats, patterns.gc_windows, patterns.naive_frames):
        assert f(none).count() == 0
