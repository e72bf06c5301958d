"""Distances and trees of groups of sequences.

A group's distinct texts are all aligned with its first, pair by pair over the
cluster, and each is held against at most ``MOST`` representatives, the first
by name: every pair of a group of that size, and work linear in the texts of a
larger one.  A tree needs all distances of its leaves at once; it is built
from those of the representatives in one task, and every further text becomes
the neighbour of its nearest representative.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixspark.functions import pairs as p
from helixspark.kernels import align, trees
from helixspark.session import checkpoint

#: Representatives that a tree is built from; a distance matrix grows with their square.
MOST = 64
#: Parts over which the texts of one group are dealt.
SALT = 8


def differing(a: str, b: str) -> tuple[int, int, int, int]:
    """Columns without gap of two aligned texts, and how many are equal, transitions, and transversions."""
    x, y = (np.frombuffer(t.encode("ascii", "replace"), dtype=np.uint8) for t in (a, b))
    gap = ord("-")
    x, y = x[(keep := (x != gap) & (y != gap))], y[keep]
    other = x != y
    pure = [np.isin(x, u) & np.isin(y, u) for u in (list(b"AG"), list(b"TC"))]
    ts = int((other & (pure[0] | pure[1])).sum())
    n, d = len(x), int(other.sum())
    return n, n - d, ts, d - ts


def differing_columns(a: str, b: str) -> Column:
    """``differing`` of two columns, as a struct."""

    @F.pandas_udf("n bigint, matches bigint, transitions bigint, transversions bigint")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([differing(t, u) for t, u in zip(x, y, strict=True)], columns=["n", "matches", "transitions", "transversions"])

    return run(a, b)


def star_alignment(df: DataFrame, kind: str = "dna") -> DataFrame:
    """``(group, name, aligned)`` of each distinct text of a group under its first name.

    The centre is the first by name; the work is linear in the texts and a
    group's texts are never in one task.
    """
    one = df.groupBy("group", "s").agg(F.min("name").alias("name"))
    centre = one.groupBy("group").agg(F.min(F.struct("name", "s")).alias("_c")).select("group", F.col("_c.s").alias("_centre"))
    parallel = df.sparkSession.sparkContext.defaultParallelism * 4

    @F.pandas_udf("x string, y string, places array<int>, sizes array<int>")
    def pair(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in batches:
            rows, other = [], a != b
            done = iter(align.align_global(a[other].tolist(), b[other].tolist(), kind))
            for x, y, _ in (next(done) if o else (c, c, 0) for c, o in zip(a, other, strict=True)):
                wide = [(i, len(r)) for i, r in enumerate(align.insertions(x, y)[0]) if r]
                rows.append((x, y, [i for i, _ in wide], [n for _, n in wide]))
            yield pd.DataFrame(rows, columns=["x", "y", "places", "sizes"])

    @F.pandas_udf("string")
    def row(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for xs, ys, gaps in batches:
            out = []
            for x, y, gap in zip(xs, ys, gaps, strict=True):
                inserted, letters = align.insertions(x, y)
                widths = [0] * len(inserted)
                for g in gap if gap is not None else ():
                    widths[g["place"]] = g["size"]
                out.append(align.star_row(inserted, letters, widths))
            yield pd.Series(out, dtype="object")

    pairs = checkpoint(one.join(centre, "group").repartition(parallel, "group", "name").select("group", "name", pair("_centre", "s").alias("p")).select("group", "name", "p.*"))
    gaps = pairs.select("group", F.explode(F.arrays_zip("places", "sizes")).alias("g")).groupBy("group", F.col("g.places").alias("place")).agg(F.max("g.sizes").alias("size"))
    gaps = gaps.groupBy("group").agg(F.collect_list(F.struct("place", "size")).alias("_gaps"))
    return pairs.join(gaps, "group", "left").repartition(parallel, "group", "name").select("group", "name", row("x", "y", "_gaps").alias("aligned"))


def group_distances(rows: DataFrame, most: int = MOST) -> DataFrame:
    """``(group, a, b, both_heads, n, matches, transitions, transversions, hamming, jukes_cantor, kimura, pam)`` of aligned rows ``(group, name, aligned)``.

    ``b`` is one of the group's first ``most`` names, ``a`` any later one, so
    each pair comes once.  Distances are those of the columns without gap, and
    null where they are saturated.
    """
    order = F.row_number().over(Window.partitionBy("group").orderBy("name"))
    heads = rows.withColumn("_r", order).where(F.col("_r") <= most)
    last = heads.groupBy("group").agg(F.max("name").alias("_last"))
    heads = heads.select("group", F.col("name").alias("b"), F.col("aligned").alias("_y")).join(last, "group")
    heads = heads.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    dealt = rows.select("group", F.col("name").alias("a"), F.col("aligned").alias("_x"), F.pmod(F.hash("name"), F.lit(SALT)).alias("_salt"))
    both = dealt.join(heads, ["group", "_salt"]).where("a > b")
    d = F.col("_d")
    found = both.select("group", "a", "b", (F.col("a") <= F.col("_last")).alias("both_heads"), differing_columns("_x", "_y").alias("_d"))
    return found.select("group", "a", "b", "both_heads", "_d.*", p.hamming(d).alias("hamming"), p.jukes_cantor(d).alias("jukes_cantor"), p.kimura(d).alias("kimura"), p.pam(d).alias("pam"))


def _attached(edges: list, further: list[tuple[str, str, float]]) -> list:
    """``edges`` with further leaves: a leaf that gains neighbours becomes an inner node at its place, with itself at length 0."""
    by: dict[str, list[tuple[str, float]]] = {}
    for name, near, d in further:
        by.setdefault(near, []).append((name, d))
    out = [(p, f"{c}+" if c in by else c, n) for p, c, n in edges]
    for near, more in by.items():
        out += [(f"{near}+", near, 0.0), *((f"{near}+", name, d) for name, d in more)]
    return out


def group_trees(df: DataFrame, method: str = "kimura", kind: str = "dna", most: int = MOST) -> DataFrame:
    """``(group, n, n_placed, upgma, neighbour_joining)``: trees in Newick of groups with three distinct texts at least.

    ``n`` leaves are in the tree, ``n_placed`` of them beside their nearest
    representative; a saturated distance is the greatest of all.
    """
    columns = ["group", "n", "n_placed", "upgma", "neighbour_joining"]
    found = group_distances(checkpoint(star_alignment(df, kind)), most).select("group", "a", "b", "both_heads", F.col(method).alias("d"))
    heads = found.where("both_heads").select("group", "a", "b", "d", F.lit(True).alias("head"))
    # of a text beyond the representatives only its nearest counts; nulls, saturated, come last
    near = F.min(F.struct(F.col("d").isNull().alias("_no"), "d", "b"))
    placed = found.where("NOT both_heads").groupBy("group", "a").agg(near.alias("_m")).select("group", "a", F.col("_m.b").alias("b"), F.col("_m.d").alias("d"), F.lit(False).alias("head"))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        inner, further = group[group["head"]], group[~group["head"]].sort_values("a")
        names = sorted({*inner["a"], *inner["b"]})
        if len(names) < 3:
            return pd.DataFrame([], columns=columns)
        at = {name: i for i, name in enumerate(names)}
        m = np.zeros((len(names), len(names)))
        i, j = inner["a"].map(at).to_numpy(), inner["b"].map(at).to_numpy()
        m[i, j] = m[j, i] = inner["d"].to_numpy(dtype=float)
        more = list(zip(further["a"], further["b"], further["d"].astype(float), strict=True))
        up = trees.newick(_attached(trees.upgma_edges(trees.upgma(m, names)), more))
        joined = trees.newick(_attached(trees.neighbour_joining(m, names), more))
        return pd.DataFrame([(group["group"].iloc[0], len(names) + len(more), len(more), up, joined)], columns=columns)

    # a row per leaf beyond the representatives, and one per pair of these
    return heads.unionByName(placed).groupBy("group").applyInPandas(build, "group string, n bigint, n_placed bigint, upgma string, neighbour_joining string")


def group_alignment(df: DataFrame, kind: str = "dna") -> DataFrame:
    """``(group, name, aligned, conservation)``: star alignment of each group and the percentage of columns with one letter."""
    rows = checkpoint(star_alignment(df, kind))
    letters = rows.select("group", F.posexplode(F.split("aligned", "")).alias("col", "c")).where("c NOT IN ('', '-')")
    columns = letters.groupBy("group", "col").agg((F.min("c") == F.max("c")).cast("int").alias("one"))
    kept = columns.groupBy("group").agg(F.sum("one").alias("_kept"))
    sizes = rows.groupBy("group").agg(F.max(F.length("aligned")).alias("_n"))
    share = F.when(F.col("_n") > 0, 100 * F.coalesce("_kept", F.lit(0)) / F.col("_n")).otherwise(0.0)
    return rows.join(sizes, "group").join(kept, "group", "left").select("group", "name", "aligned", share.alias("conservation"))


def all_pairs(records: DataFrame, kind: str) -> DataFrame:
    """``(i, j, matches, similarity, distance, rank)`` of a small stated set ``records(id, s)``, each pair aligned directly, best first.

    Similarity is the share of matches of the longer text, distance what it
    lacks to 1; ties by the ids.
    """
    from helixspark.operators.search import align_udf

    a, b = records.alias("a"), records.alias("b")
    both = a.join(b, F.col("a.id") < F.col("b.id")).select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), F.col("a.s").alias("s"), F.col("b.s").alias("t"))
    both = both.repartition(records.sparkSession.sparkContext.defaultParallelism * 4, "i", "j")
    done = both.select("i", "j", F.greatest(F.length("s"), F.length("t")).alias("_n"), align_udf(kind)("s", "t").alias("x"))
    found = done.select("i", "j", F.col("x.matches").alias("matches"), "_n")
    found = found.withColumn("similarity", F.when(F.col("_n") > 0, F.col("matches") / F.col("_n")).otherwise(0.0)).withColumn("distance", 1 - F.col("similarity"))
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), "i", "j")).cast("bigint")).drop("_n")


def set_tree(distances: DataFrame) -> DataFrame:
    """``(n, upgma, neighbour_joining)`` of the pairs ``(i, j, distance)`` of a small stated set; no row for fewer than three records."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*group["i"], *group["j"]})
        if len(names) < 3:
            return pd.DataFrame([], columns=["n", "upgma", "neighbour_joining"])
        m = group.pivot(index="i", columns="j", values="distance").reindex(index=names, columns=names).fillna(0.0).to_numpy()
        leaves = [str(x) for x in names]
        return pd.DataFrame([(len(names), trees.newick(trees.upgma_edges(trees.upgma(m + m.T, leaves))), trees.newick(trees.neighbour_joining(m + m.T, leaves)))], columns=["n", "upgma", "neighbour_joining"])

    return distances.groupBy(F.lit(1).alias("_all")).applyInPandas(build, "n bigint, upgma string, neighbour_joining string")
