import math

import pytest
from pyspark.sql import functions as F

from helixspark.functions import keys, pairs, protein, seq


@pytest.fixture(scope="module")
def one(spark):
    return lambda text, f: spark.createDataFrame([(text,)], "s string").select(f(F.col("s")).alias("x")).first()["x"]


def test_gc(one):
    assert one("ATGC", seq.gc_fraction) == 0.5
    assert one("", seq.gc_fraction) == 0.0
    assert one(None, seq.gc_fraction) is None
    assert one("ATGCN", seq.gc_fraction) == 0.4


def test_complement(one):
    assert one("ATGC", seq.complement) == "TACG"
    assert one("ATGC", seq.reverse_complement) == "GCAT"
    assert one("AUGC", seq.as_dna) == "ATGC"


@pytest.mark.parametrize("text, protein_text, stop", [("ATGTTAAAA", "MLK", None), ("ATGAAATAATTAG", "MK", 2), ("ATGAAACCC", "MKP", None), ("ATGNNN", "M?", None), ("", "", None), ("AT", "", None)])
def test_translation(spark, text, protein_text, stop):
    row = spark.createDataFrame([(text,)], "s string").select(seq.up_to_stop(seq.amino_acids(F.col("s"))).alias("t")).first()["t"]
    assert (row["protein"], row["stop_position"]) == (protein_text, stop)


def test_types(one):
    assert [one(x, seq.detect_type) for x in ("ATGCN", "MKWV", "ATGCR", "GATTACA", "", "123", None)] == ["dna", "protein", "protein", "dna", "unknown", "unknown", None]
    assert [one(x, seq.detect_type_strict) for x in ("ATGCR", "AUGC", "MKWVL")] == ["dna", "rna", "protein"]
    assert one("AUGC", lambda s: seq.normal_type(F.lit("mRNA"), s)) == "rna"
    assert one("AUGC", lambda s: seq.normal_type(F.lit(""), s)) == "rna"
    assert one("MKV", lambda s: seq.normal_type(F.lit(None).cast("string"), s)) == "protein"


def test_cleaning_and_validity(one):
    assert one(">chr1\nATG@C#GA$TA", seq.clean_dna) == "ATGCGATA"
    assert one("", lambda s: seq.validate(s, F.lit("dna"))) == "empty"
    assert one("ATG", lambda s: seq.validate(s, F.lit("dna"))) == "too short"
    assert one("ATGATGATGJZ", lambda s: seq.validate(s, F.lit("dna"))) == "invalid characters: J, Z"
    assert one("ATGATGATGA", lambda s: seq.validate(s, F.lit("dna"))) == "ok"


def test_small_functions(one):
    assert one("ATGC", seq.melting_temperature) == 12.0
    assert one("", seq.melting_temperature) is None
    assert one("AAATTTT", seq.gc3) == 0.0
    assert one("AA", seq.gc3) is None
    assert one("ACGTACGT", lambda s: seq.signature(s, 5)) == ["ACGTA", "CGTAC", "GTACG", "TACGT"]
    assert one("ACGT", lambda s: seq.kmer_code(s, "ACGT")) == 27
    assert one("ACGN", lambda s: seq.kmer_code(s, "ACGT")) is None
    assert one("_abc-WRKY1", seq.display_name) == "WRKY1"
    assert one("AAAAAAACCC", seq.runs) == ["AAAAAAA"]
    assert one("Oryza sativa x", lambda s: seq.taxonomy(s)["species"]) == "sativa"
    assert sorted(one("cat", seq.trigrams)) == ["  c", " ca", "at ", "cat"]


def test_protein(one):
    assert one("AG", protein.mass_centi) == 8909 + 7507 - 1802
    assert one("", protein.mass_centi) == 0
    assert one("AR", protein.hydropathy) == pytest.approx((1.8 - 4.5) / 2)
    assert one("AAC", protein.unique_residues) == 2
    assert one("", protein.isoelectric_point) == 0.0
    assert 9 < one("KKKK", protein.isoelectric_point) < 14
    assert [one(x, protein.group) for x in "ASDKX"] == ["nonpolar", "polar", "acidic", "basic", None]


def test_pairs(spark):
    df = spark.createDataFrame([("AC-GT", "ACCGA"), ("", ""), ("A-", "-A")], "a string, b string")
    st = pairs.statistics(F.col("a"), F.col("b"))
    rows = df.select(st.alias("st"), pairs.match_line(F.col("a"), F.col("b")).alias("m"), pairs.identity(st).alias("i")).collect()
    assert tuple(rows[0]["st"]) == (3, 1, 1, 5) and rows[0]["m"] == "|| |X" and rows[0]["i"] == 60.0
    assert tuple(rows[1]["st"]) == (0, 0, 0, 0) and rows[1]["i"] == 0.0
    assert tuple(rows[2]["st"]) == (0, 0, 2, 2)
    d = pairs.differences(F.col("a"), F.col("b"))
    row = spark.createDataFrame([("AAAAAAAAAA", "GAAAAAAAAT")], "a string, b string").select(pairs.kimura(d).alias("k"), pairs.jukes_cantor(d).alias("j"), pairs.hamming(d).alias("h"), pairs.pam(d).alias("p")).first()
    assert row["h"] == 0.2
    assert row["k"] == pytest.approx(-0.5 * math.log((1 - 0.2 - 0.1) * math.sqrt(0.8)))
    assert row["j"] == pytest.approx(-0.75 * math.log(1 - 0.8 / 3))
    far = spark.createDataFrame([("AAAA", "TTTT")], "a string, b string").select(pairs.kimura(d).alias("k"), pairs.jukes_cantor(d).alias("j"), pairs.pam(d).alias("p")).first()
    assert (far["k"], far["j"], far["p"]) == (None, None, 200.0)


def test_keys(spark):
    df = spark.createDataFrame([(" ab ", None), ("", " s1"), (None, None), ("  ", "")], "g string, s string")
    assert [r[0] for r in df.select(keys.gene_key(F.col("g"), F.col("s"))).collect()] == ["AB", "S1", None, None]
    values = spark.createDataFrame([(x,) for x in (None, "", " ", "N/A", "[]", "{ }", "0", "false", "x", "TBD", "[null]")], "v string")
    assert [r[0] for r in values.select(keys.has_value(F.col("v"))).collect()] == [False, False, False, False, False, False, True, True, True, False, True]
