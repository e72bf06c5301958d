"""Variants of aligned pairs: substitutions with their consequence, indel blocks, frame shifts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixspark import schema
from helixspark.functions import pairs, seq
from helixspark.kernels import align


def columns(df: DataFrame) -> DataFrame:
    """One row per alignment column of ``(pair, query_aligned, gene_aligned)`` with running positions in both sequences.

    Windows are partitioned by pair, so one holds at most one alignment.
    """
    each = df.select("pair", F.posexplode(pairs.columns(F.col("query_aligned"), F.col("gene_aligned"))).alias("col", "c")).select("pair", "col", F.col("c.a").alias("q"), F.col("c.b").alias("r"))
    order = Window.partitionBy("pair").orderBy("col")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return each.select(
        "pair", "col", "q", "r", F.sum((F.col("q") != "-").cast("int")).over(upto).alias("q_pos"), F.sum((F.col("r") != "-").cast("int")).over(upto).alias("r_pos"))


def _by_pair(df: DataFrame, solve, shape: str) -> DataFrame:
    """The columns ``shape`` that ``solve`` gives of each row of ``df``, after its first column ``pair``; a row with a null gives none."""
    names = [field.strip().split(" ")[0] for field in shape.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at, found = zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True), [], []
            for i, row in enumerate(texts):
                if None not in row:
                    rows = solve(*row)
                    at += [i] * len(rows)
                    found += rows
            columns = list(zip(*found, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *map(pa.array, columns, types)], names=["pair", *names])

    kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "int": pa.int32()}
    types = [kinds[field.strip().split(" ")[1]] for field in shape.split(",")]
    return df.mapInArrow(run, f"pair {df.schema['pair'].dataType.simpleString()}, {shape}")


def _places(a: str, b: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters of both aligned texts, and the running positions in each."""
    q, r = (np.frombuffer(t.encode("ascii", "replace"), dtype=np.uint8) for t in (a, b))
    return q, r, np.cumsum(q != ord("-")), np.cumsum(r != ord("-"))


def _blocks(q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last column of each run of gap columns of one kind, and whether it is an insertion."""
    kind = np.where((q == ord("-")) & (r != ord("-")), 1, np.where((r == ord("-")) & (q != ord("-")), 2, 0))
    change = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts = np.concatenate([[0], change]) if len(kind) else change
    ends = np.concatenate([change, [len(kind)]])[: len(starts)] - 1
    some = kind[starts] > 0
    return starts[some], ends[some], kind[starts[some]] == 2


def _indels(a: str, b: str) -> list[tuple]:
    q, r, q_pos, r_pos = _places(a, b)
    out = []
    for lo, hi, inserted in zip(*(x.tolist() for x in _blocks(q, r)), strict=True):
        out.append(("insertion" if inserted else "deletion", int(r_pos[lo]), int(q_pos[lo]), lo, hi, hi - lo + 1, (a if inserted else b)[lo : hi + 1]))
    return out


def indel_blocks(df: DataFrame) -> DataFrame:
    """``(pair, kind, r_pos, q_pos, n, bases, frameshift)``: neighbouring gap columns of one kind as one block."""
    out = _by_pair(df.select("pair", "query_aligned", "gene_aligned"), _indels, "kind string, r_pos bigint, q_pos bigint, _col int, _end int, n bigint, bases string")
    return out.withColumn("frameshift", F.col("n") % 3 != 0)


def substitutions(df: DataFrame, frame: int = 0) -> DataFrame:
    """``(pair, r_pos, q_pos, reference, query, class, consequence)`` of each differing column of DNA pairs.

    ``df`` also has ``query_s`` and ``s``.  A codon consequence is given while
    the reading frame of both holds; the shift is judged where an indel block
    ends, so an in-frame block breaks nothing.
    """

    def solve(a: str, b: str, query: str, gene: str) -> list[tuple]:
        q, r, q_pos, r_pos = _places(a, b)
        differ = np.flatnonzero((q != r) & (q != ord("-")) & (r != ord("-")))
        if not len(differ):
            return []
        lo, hi, inserted = _blocks(q, r)
        net = np.concatenate([[0], np.cumsum(np.where(inserted, hi - lo + 1, lo - hi - 1))])
        broken = np.concatenate([[False], np.logical_or.accumulate(net[1:] % 3 != 0)])
        before = np.searchsorted(hi, differ)  # blocks that end ahead of the column
        i, j = r_pos[differ], q_pos[differ]
        start = (i - 1 - frame) // 3 * 3 + frame
        at = zip(differ.tolist(), i.tolist(), j.tolist(), np.maximum(start, 0).tolist(), np.maximum(start + net[before], 0).tolist(), broken[before].tolist(), strict=True)
        return [(m, n, b[col], a[col], gene[x : x + 3], query[y : y + 3], shifted) for col, m, n, x, y, shifted in at]

    subs = _by_pair(df.select("pair", "query_aligned", "gene_aligned", "query_s", "s"), solve, "r_pos bigint, q_pos bigint, r string, q string, r_codon string, q_codon string, _broken boolean")
    r_codon, q_codon = F.col("r_codon"), F.col("q_codon")
    table = seq._map(schema.CODONS)
    amino = lambda c: F.coalesce(F.element_at(table, c), F.lit("X"))
    consequence = (
        F.when(F.col("_broken"), "downstream_of_frameshift")
        .when((F.col("r_pos") <= frame) | (F.col("q_pos") <= frame), "upstream_of_reading_frame")
        .when((F.length(r_codon) < 3) | (F.length(q_codon) < 3), "incomplete_codon")
        .otherwise(codon_consequence(amino(r_codon), amino(q_codon)))
    )
    return subs.select(
        "pair", "r_pos", "q_pos", F.col("r").alias("reference"), F.col("q").alias("query"),
        pairs.substitution_class(F.col("r"), F.col("q")).alias("class"), consequence.alias("consequence"))


def codon_consequence(reference: Column, query: Column) -> Column:
    return F.when(reference == query, "silent").when(query == "*", "nonsense").when(reference == "*", "readthrough").otherwise("missense")


#: Residues by physicochemical group.
GROUPS = {a: g for letters, g in (("AVLIMFWPG", "nonpolar"), ("STCYNQ", "polar"), ("DE", "acidic"), ("KRH", "basic")) for a in letters}


def protein_substitutions(df: DataFrame) -> DataFrame:
    """VAR-02, VAR-04: ``(pair, r_pos, q_pos, reference, query, class, reference_group, query_group, blosum62)`` of each differing column of protein pairs.

    A substitution within a group is conservative, one between groups
    radical; residues without a group (X, B, Z, *) leave it at substitution.
    """
    subs = columns(df).where((F.col("q") != "-") & (F.col("r") != "-") & (F.col("q") != F.col("r")))
    group = lambda c: F.element_at(seq._map(GROUPS), c)
    letters = sorted({*schema.BLOSUM_ORDER, *"BXZ*"})
    scores = seq._map({a + b: align.score(a, b, "protein") for a in letters for b in letters})
    kind = F.when(group(F.col("r")).isNull() | group(F.col("q")).isNull(), "substitution").when(group(F.col("r")) == group(F.col("q")), "conservative").otherwise("radical")
    return subs.select(
        "pair", F.col("r_pos").cast("bigint").alias("r_pos"), F.col("q_pos").cast("bigint").alias("q_pos"), F.col("r").alias("reference"), F.col("q").alias("query"),
        kind.alias("class"), group(F.col("r")).alias("reference_group"), group(F.col("q")).alias("query_group"), F.element_at(scores, F.concat("r", "q")).cast("int").alias("blosum62"))


def summary(substituted: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(kind, class, consequence, n, n_letters)``: substitutions per class and consequence, indel blocks per kind and whether they break the frame."""
    subs = substituted.groupBy("class", "consequence").agg(F.count("*").alias("n")).select(F.lit("substitution").alias("kind"), "class", "consequence", "n", F.col("n").alias("n_letters"))
    consequence = F.when(F.col("frameshift"), "frameshift").otherwise("in_frame")
    indels = blocks.groupBy(F.col("kind").alias("class"), consequence.alias("consequence")).agg(F.count("*").alias("n"), F.sum("n").cast("bigint").alias("n_letters"))
    return subs.unionByName(indels.select(F.lit("indel").alias("kind"), "class", "consequence", "n", "n_letters"))
