from helixspark.operators import variants


def test_protein_classes(spark):
    df = spark.createDataFrame([(1, "MI-DKX", "MLAKKA")], "pair bigint, query_aligned string, gene_aligned string")
    got = {(r["r_pos"], r["q_pos"], r["reference"], r["query"], r["class"], r["reference_group"], r["query_group"], r["blosum62"]) for r in variants.protein_substitutions(df).collect()}
    assert got == {(2, 2, "L", "I", "conservative", "nonpolar", "nonpolar", 2), (4, 3, "K", "D", "radical", "basic", "acidic", -1), (6, 5, "A", "X", "substitution", "nonpolar", None, -4)}
