"""Reading frames, motifs, repeats and sliding windows over many sequences.

Positions are found by built-in expressions on the sequence's own row; what
moves between tasks is one small row per hit.  Windows are partitioned by
sequence, strand and frame, so a window never holds more than the hits of one
frame of one sequence.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixspark import schema
from helixspark.functions import seq


def reading_frames(df: DataFrame, least: int = 30, id_column: str = "id", text: str = "s") -> DataFrame:
    """``(id, frame, start, end, n, complete)`` of every open reading frame of both strands.

    Each in-frame ATG opens a frame (nested ones too) that ends with the next
    stop codon, or with the sequence if there is none.  Positions count from
    1 on the given strand, ``n`` includes the stop.  Null and short texts
    give no rows; repeated rows with one id are one sequence only if their
    texts are equal.
    """
    strands = F.array(F.struct(F.lit("+").alias("strand"), F.col(text).alias("t")), F.struct(F.lit("-").alias("strand"), seq.reverse_complement(F.col(text)).alias("t")))
    both = df.select(F.col(id_column).alias("id"), F.length(text).alias("_len"), F.explode(strands).alias("x")).select("id", "_len", "x.*")
    # cut before every mark; running lengths give the places, so the work is linear in the sequence
    pieces = both.select("id", "_len", "strand", F.posexplode(F.split("t", f"(?=ATG|{'|'.join(schema.STOPS)})")).alias("_k", "_piece"))
    order = Window.partitionBy("id", "strand").orderBy("_k")
    before = F.coalesce(F.sum(F.length("_piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    codon = F.left(F.concat("_piece", F.lead("_piece", 1, "").over(order), F.lead("_piece", 2, "").over(order)), F.lit(3))
    each = pieces.select("id", "_len", "strand", (before + 1).alias("at"), codon.alias("_codon")).where(F.col("_codon").isin("ATG", *schema.STOPS))
    each = each.withColumn("open", F.col("_codon") == "ATG").withColumn("_frame", (F.col("at") - 1) % 3 + 1)
    ahead = Window.partitionBy("id", "strand", "_frame").orderBy("at").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    each = each.withColumn("_stop", F.min(F.when(~F.col("open"), F.col("at"))).over(ahead)).where("open")
    end = F.coalesce(F.col("_stop") + 2, F.col("_len"))
    found = each.select("id", "strand", F.concat("strand", "_frame").alias("frame"), "_len", F.col("at").alias("_from"), end.alias("_to"), F.col("_stop").isNotNull().alias("complete"))
    found = found.withColumn("n", F.col("_to") - F.col("_from") + 1).where(F.col("n") >= least)
    back = F.col("strand") == "-"
    start = F.when(back, F.col("_len") - F.col("_to") + 1).otherwise(F.col("_from"))
    stop = F.when(back, F.col("_len") - F.col("_from") + 1).otherwise(F.col("_to"))
    return found.select("id", "frame", start.cast("bigint").alias("start"), stop.cast("bigint").alias("end"), F.col("n").cast("bigint").alias("n"), "complete")


def motif_hits(df: DataFrame, motifs: dict[str, str] | None = None, id_column: str = "id", text: str = "s") -> DataFrame:
    """``(id, name, motif, start, end, match)`` of every occurrence, overlapping ones included.

    ``N`` stands for any base.  Names of equal motifs are joined by `` / ``.
    """
    names: dict[str, list[str]] = {}
    for name, motif in (motifs or schema.MOTIFS).items():
        names.setdefault(motif, []).append(name)
    s = F.col(text)

    def hits(motif: str, label: str) -> Column:
        # cut before every occurrence; the running length of the pieces gives the places
        n, pattern = len(motif), motif.replace("N", "[ATGC]")
        begin = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("out"))
        ends = F.aggregate(F.split(s, f"(?={pattern})"), begin, lambda a, p: F.struct((a["at"] + F.length(p)).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])
        at = F.filter(ends, lambda i: F.substring(s, i, F.lit(n)).rlike("^" + pattern))
        return F.transform(at, lambda i: F.struct(
            F.lit(label).alias("name"), F.lit(motif).alias("motif"), i.cast("bigint").alias("start"), (i + n - 1).cast("bigint").alias("end"),
            F.substring(s, i, F.lit(n)).alias("match")))

    every = F.concat(*[hits(m, " / ".join(labels)) for m, labels in names.items()])
    return df.select(F.col(id_column).alias("id"), F.explode(every).alias("h")).select("id", "h.*")


def homopolymers(df: DataFrame, least: int = 6, id_column: str = "id", text: str = "s") -> DataFrame:
    """``(id, base, start, end, n)`` of runs of one letter: runs are split off by their own pattern, starts are running sums of lengths."""
    pieces = F.regexp_extract_all(text, F.lit(r"((.)\2*)"), F.lit(1))
    begin = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<base:string,start:int,n:int>>").alias("out"))
    found = F.aggregate(
        pieces, begin,
        lambda a, p: F.struct((a["at"] + F.length(p)).alias("at"), F.when(F.length(p) >= least, F.concat(a["out"], F.array(F.struct(
            F.left(p, F.lit(1)).alias("base"), a["at"].alias("start"), F.length(p).alias("n"))))).otherwise(a["out"]).alias("out")),
        lambda a: a["out"])
    each = df.select(F.col(id_column).alias("id"), F.explode(found).alias("r"))
    return each.select("id", "r.base", F.col("r.start").cast("bigint").alias("start"), (F.col("r.start") + F.col("r.n") - 1).cast("bigint").alias("end"), F.col("r.n").cast("bigint").alias("n"))


def tandem_repeats(df: DataFrame, units: tuple[int, ...] = (2, 3, 4), least: int = 3, id_column: str = "id", text: str = "s") -> DataFrame:
    """``(id, unit, start, end, repeats)``: units repeated at least ``least`` times, per unit length from left to right without overlap.

    The greedy leftmost match of a regular expression is exactly that scan;
    the text is cut into hits and the stretches between them, whose running
    lengths give the positions.
    """
    none = F.array().cast("array<struct<unit:string,start:int,n:int,u:int>>")
    begin = F.struct(F.lit(1).alias("at"), none.alias("out"))

    def hits(u: int) -> Column:
        def add(a: Column, p: Column) -> Column:
            hit = F.struct(F.left(p, F.lit(u)).alias("unit"), a["at"].alias("start"), F.length(p).alias("n"), F.lit(u).alias("u"))
            return F.struct((a["at"] + F.length(p)).alias("at"), F.when(F.length(p) > 1, F.concat(a["out"], F.array(hit))).otherwise(a["out"]).alias("out"))

        pieces = F.regexp_extract_all(text, F.lit(rf"(?s)((.{{{u}}})\2{{{least - 1},}}|.)"), F.lit(1))
        return F.aggregate(pieces, begin, add, lambda a: a["out"])

    found = [hits(u) for u in units]
    each = df.select(F.col(id_column).alias("id"), F.explode(F.concat(*found)).alias("r"))
    return each.select("id", "r.unit", F.col("r.start").cast("bigint").alias("start"), (F.col("r.start") + F.col("r.n") - 1).cast("bigint").alias("end"), F.floor(F.col("r.n") / F.col("r.u")).cast("bigint").alias("repeats"))


def gc_windows(df: DataFrame, width: int = 20, id_column: str = "id", text: str = "s") -> DataFrame:
    """``(id, position, gc)``: G + C in windows of ``width`` a quarter apart; positions are centres counted from 0; none where no window fits.

    Blocks that divide both the width and the step are counted once and
    summed over each window.
    """
    step = max(1, width // 4)
    block = math.gcd(width, step)
    blocks = df.select(F.col(id_column).alias("id"), F.posexplode(seq.words(F.col(text), block)).alias("_k", "_b")).select("id", "_k", seq.count_of(F.col("_b"), "GC").alias("_gc"))
    n = width // block
    ahead = Window.partitionBy("id").orderBy("_k").rowsBetween(0, n - 1)
    each = blocks.select("id", "_k", F.sum("_gc").over(ahead).alias("gc"), F.count("*").over(ahead).alias("_n"))
    each = each.where((F.col("_n") == n) & (F.col("_k") * block % step == 0))
    return each.select("id", (F.col("_k") * block + width // 2).cast("bigint").alias("position"), "gc")


def naive_frames(df: DataFrame, most: int = 3, id_column: str = "id", text: str = "s") -> DataFrame:
    """``(id, frame, start, end, n)``: the first ``most`` ATGs of each forward frame with the first TAA behind, else TAG, else TGA, in whatever frame; positions from 0, ends exclusive."""
    s = F.col(text)

    def end(i: Column) -> Column:
        after = [F.locate(c, F.substr(s, i)) for c in ("TAA", "TAG", "TGA")]
        return F.coalesce(*[F.when(x > 0, x + i + 1) for x in after])

    def frames(f: int) -> Column:
        starts = F.slice(F.filter(seq.starts_of(s, 3, 3, f + 1), lambda i: F.substring(s, i, F.lit(3)) == "ATG"), 1, most)
        return F.transform(starts, lambda i: F.struct(F.lit(f).cast("bigint").alias("frame"), (i - 1).cast("bigint").alias("start"), end(i).cast("bigint").alias("end")))

    out = [frames(f) for f in range(3)]
    each = df.select(F.col(id_column).alias("id"), F.explode(F.concat(*out)).alias("o")).select("id", "o.*").where(F.col("end").isNotNull())
    return each.withColumn("n", F.col("end") - F.col("start"))
