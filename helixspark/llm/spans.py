"""Long exact spans shared between records: seed and extend.

Equal texts are folded into classes first.  Every class is winnowed into
anchors (hashes of ``k`` letters) so dense that each span of ``least``
letters holds one; anchors seen under one key only are dropped by an
algebraic minimum and maximum; the others are joined and extended.  An
anchor shared by very many classes is first replaced by the windows of
``least`` letters around it, so that only true matches pair up.

A span of ``least`` letters holds an anchor near each of its ends, so an
extension need not go further than the slack on either side: what is extended
along one diagonal joins up to the maximal repeat.  How much of a row is
shared asks for no pairs at all, only for windows that occur under two keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixspark.session import checkpoint

LEAST = 64
K = 48
#: Classes per anchor beyond which the windows around it are matched instead of the anchor.
HOT = 64
#: Parts over which the rows of one class are dealt when they pair up among themselves.
SALT = 8
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _sliding(op: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """``op`` over each window of ``width`` neighbours, by doubling."""
    size = 1
    while size * 2 <= width:
        x = op(x[:-size], x[size:])
        size *= 2
    return op(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def letter_values(codes: np.ndarray) -> np.ndarray:
    """A random 64-bit value for each letter, the same everywhere."""
    return np.random.default_rng(7).integers(1, 2**63, 1 << 16, dtype=np.uint64)[codes]


def winnow(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of many texts laid end to end: ``(text number, position, hash)``.

    ``values`` holds a 64-bit value for each letter, or word.  Of each ``w`` neighbouring
    hashes of ``k`` letters the least are kept, so texts that share ``k + w - 1``
    letters share an anchor.
    """
    n = len(values)
    if n < k + w - 1:
        none = np.empty(0, dtype=np.int64)
        return none, none, none
    with np.errstate(over="ignore"):
        prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * _powers(_BASE, n), out=prefix[1:])
        h = (prefix[k:] - prefix[:-k]) * _powers(_INVERSE, n - k + 1)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    text = np.repeat(np.arange(len(starts)), lengths)
    valid = text[: len(h)] == text[k - 1 :]
    top = np.uint64(_MASK)
    h[~valid] = top
    low = _sliding(np.minimum, h, w)
    edge = np.zeros(w - 1, dtype=np.uint64)
    high = _sliding(np.maximum, np.concatenate([edge, low, edge]), w)
    at = np.flatnonzero((h == high) & valid & (h != top))
    return text[at], at - starts[text[at]], h[at].view(np.int64)


def anchors(texts: DataFrame, k: int, w: int) -> DataFrame:
    """``(h, cid, pos, klo, khi)``: the anchors of ``texts(cid, text, klo, khi)``; positions count from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 2000):
                batch = big.slice(at, 2000)
                raw = [t.encode("utf-32-le", "surrogatepass") for t in batch.column("text").to_pylist()]
                lengths = np.array([len(r) // 4 for r in raw], dtype=np.int64)
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                n, pos, h = winnow(letter_values(np.frombuffer(b"".join(raw), dtype="<u4") & 0xFFFF), starts, lengths, k, w)
                take = pa.array(n)
                cols = [pa.array(h), batch.column("cid").take(take), pa.array(pos.astype(np.int32)), batch.column("klo").take(take), batch.column("khi").take(take)]
                yield pa.RecordBatch.from_arrays(cols, names=["h", "cid", "pos", "klo", "khi"])

    return texts.mapInArrow(run, "h bigint, cid bigint, pos int, klo bigint, khi bigint")


def _agree(a: Column, b: Column, most: int, from_end: bool) -> Column:
    """How many letters two texts have in common at their start, or end, ``most`` at most."""
    cut = F.right if from_end else F.left
    return F.size(F.filter(F.sequence(F.lit(1), F.lit(most)), lambda i: (i <= F.length(a)) & (i <= F.length(b)) & (cut(a, i) == cut(b, i))))


def _differ(a: str, b: str) -> Column:
    """Some rows of the two classes have different keys."""
    col = F.col
    return (col(f"{a}.klo") != col(f"{b}.klo")) | (col(f"{a}.khi") != col(f"{b}.khi")) | (col(f"{a}.klo") != col(f"{a}.khi"))


class SharedSpans:
    """Shared spans of ``rows(id, key, text)``; rows with a null key or fewer than ``least`` letters take no part."""

    def __init__(self, rows: DataFrame, least: int = LEAST, k: int = K, hot: int = HOT):
        self.least, self.k, self.hot = least, k, hot
        self.rows = rows.where(F.col("key").isNotNull() & (F.length("text") >= least)).select("id", "key", "text", F.md5("text").alias("_sum"))
        khash = F.xxhash64("key")
        first = self.rows.groupBy("_sum").agg(F.min(F.struct("id", "text")).alias("_f"), F.min(khash).alias("klo"), F.max(khash).alias("khi"))
        #: ``(_sum, cid, text, klo, khi)``: each distinct text once, named by its least id, with the range of its keys' hashes.
        self.texts = checkpoint(first.select("_sum", F.col("_f.id").alias("cid"), F.col("_f.text").alias("text"), "klo", "khi"))
        self._seeds: DataFrame | None = None

    def members(self) -> DataFrame:
        """``(cid, id, key, n_letters, klo, khi)``: the class of every row that takes part."""
        rows = self.rows.select("id", "key", "_sum", F.length("text").alias("n_letters")).distinct()
        return rows.join(self.texts.drop("text"), "_sum").drop("_sum")

    def seeds(self) -> DataFrame:
        """Anchors that occur under more than one key, with the letters around them; found once, read by all that follows."""
        if self._seeds is None:
            slack = self.least - self.k
            every = anchors(self.texts, self.k, slack + 1)
            spread = every.groupBy("h").agg(F.min("klo").alias("_lo"), F.max("khi").alias("_hi"), F.count("*").alias("df")).where("_lo <> _hi")
            kept = every.join(spread.select("h", "df"), "h").join(self.texts.select("cid", "text"), "cid")
            pos = F.col("pos")
            self._seeds = checkpoint(kept.select(
                "h", "cid", "pos", "klo", "khi", "df",
                F.substring("text", pos + 1 - F.least(pos, F.lit(slack)), F.least(pos, F.lit(slack))).alias("before"),
                F.substring("text", pos + 1, F.lit(self.k)).alias("seed"),
                F.substring("text", pos + 1 + self.k, F.lit(slack)).alias("after")))
        return self._seeds

    def _windows(self, seeds: DataFrame) -> DataFrame:
        """``(cid, klo, khi, pos, letters)``: the windows of ``least`` letters that hold one of the seeds."""
        slack = self.least - self.k
        around = F.concat("before", "seed", "after")
        each = seeds.select("cid", "klo", "khi", (F.col("pos") - F.length("before")).alias("_from"), around.alias("_around"), F.explode(F.sequence(F.lit(0), F.lit(slack))).alias("_i"))
        each = each.select("cid", "klo", "khi", (F.col("_from") + F.col("_i")).alias("pos"), F.substring("_around", F.col("_i") + 1, F.lit(self.least)).alias("letters"))
        return each.where(F.length("letters") == self.least)

    def hits(self) -> DataFrame:
        """``(cid_a, start_a, cid_b, start_b, n)``: seeds of two classes, ``cid_a < cid_b``, extended by up to the slack both ways to at least ``least`` letters."""
        slack = self.least - self.k
        seeds = self.seeds()
        cold = seeds.where(F.col("df") <= self.hot)
        a, b = cold.alias("a"), cold.alias("b")
        left, right = _agree(F.col("a.before"), F.col("b.before"), slack, True), _agree(F.col("a.after"), F.col("b.after"), slack, False)
        same = (F.col("a.h") == F.col("b.h")) & (F.col("a.cid") < F.col("b.cid")) & _differ("a", "b") & (F.col("a.seed") == F.col("b.seed"))
        found = a.join(b, same).withColumn("_l", left).withColumn("n", F.col("_l") + right + self.k).where(F.col("n") >= self.least)
        found = found.select(F.col("a.cid").alias("cid_a"), (F.col("a.pos") - F.col("_l")).alias("start_a"), F.col("b.cid").alias("cid_b"), (F.col("b.pos") - F.col("_l")).alias("start_b"), "n")
        # beyond the bound on cold anchors: the same spans by their own letters
        windows = self._windows(seeds.where(F.col("df") > self.hot)).distinct()
        spread = windows.groupBy("letters").agg(F.min("klo").alias("_lo"), F.max("khi").alias("_hi")).where("_lo <> _hi")
        windows = windows.join(spread.select("letters"), "letters", "left_semi")
        a, b = windows.alias("a"), windows.alias("b")
        same = (F.col("a.letters") == F.col("b.letters")) & (F.col("a.cid") < F.col("b.cid")) & _differ("a", "b")
        return found.unionByName(a.join(b, same).select(
            F.col("a.cid").alias("cid_a"), F.col("a.pos").alias("start_a"), F.col("b.cid").alias("cid_b"), F.col("b.pos").alias("start_b"), F.lit(self.least).alias("n")))

    def repeats(self) -> DataFrame:
        """``(cid_a, start_a, cid_b, start_b, n)``: the maximal repeats of at least ``least`` letters between classes that have different keys.

        Extended seeds of one diagonal that touch are one repeat; a window
        here holds the seeds of one diagonal of two texts.
        """
        diagonal = ["cid_a", "cid_b", "_d"]
        order = Window.partitionBy(*diagonal).orderBy("start_a", "n")
        hits = self.hits().withColumn("_d", F.col("start_a") - F.col("start_b"))
        reach = F.max(F.col("start_a") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
        fresh = (F.col("start_a") > F.coalesce(reach, F.lit(-1))).cast("int")
        marked = hits.withColumn("_fresh", fresh).withColumn("_island", F.sum("_fresh").over(order))
        whole = marked.groupBy(*diagonal, "_island").agg(F.min("start_a").alias("start_a"), F.min("start_b").alias("start_b"), F.max(F.col("start_a") + F.col("n")).alias("_end"))
        return whole.select("cid_a", "start_a", "cid_b", "start_b", (F.col("_end") - F.col("start_a")).alias("n"))

    def links(self) -> DataFrame:
        """``(cid_a, cid_b, n_repeats, longest)``: classes that share a span; with ``members`` this names every pair of rows without listing it."""
        return self.repeats().groupBy("cid_a", "cid_b").agg(F.count("*").alias("n_repeats"), F.max("n").alias("longest"))

    def pairs(self) -> DataFrame:
        """``(id_a, id_b)``, ``id_a < id_b``: rows of different keys that share a span; a row given twice counts once."""
        m = checkpoint(self.members().drop("n_letters"))
        classes = self.hits().select("cid_a", "cid_b").distinct()
        left = m.select(F.col("cid").alias("cid_a"), F.col("id").alias("_a"), F.col("key").alias("_ka"))
        right = m.select(F.col("cid").alias("cid_b"), F.col("id").alias("_b"), F.col("key").alias("_kb"))
        across = classes.join(left, "cid_a").join(right, "cid_b").where("_ka <> _kb")
        mixed = m.where("klo <> khi").select("cid", "id", "key")
        # one text may stand under a third of all keys
        one = mixed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))).alias("a")
        two = mixed.withColumn("_salt", F.pmod(F.hash("id"), F.lit(SALT))).alias("b")
        same = (F.col("a.cid") == F.col("b.cid")) & (F.col("a._salt") == F.col("b._salt")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.key") != F.col("b.key"))
        within = one.join(two, same).select(F.col("a.id").alias("_a"), F.col("b.id").alias("_b"))
        # each row has one class, so no pair comes twice
        return across.select("_a", "_b").unionByName(within).select(F.least("_a", "_b").alias("id_a"), F.greatest("_a", "_b").alias("id_b"))

    def stretches(self) -> DataFrame:
        """``(cid, start, end)``: the stretches of each class covered by spans that occur in another class under another key.

        Linear in the letters: a window of ``least`` letters is shared if the
        least and the greatest of its keys differ, however many classes hold
        it.  Windows are compared by 128 bits of hash.
        """
        pair = [F.xxhash64("letters").alias("_x"), F.xxhash64("letters", F.lit(1)).alias("_y")]
        windows = self._windows(self.seeds()).select("cid", "pos", "klo", "khi", *pair)
        shared = windows.groupBy("_x", "_y").agg(F.min("klo").alias("_lo"), F.max("khi").alias("_hi")).where("_lo <> _hi")
        held = windows.select("cid", "pos", "_x", "_y").join(shared.select("_x", "_y"), ["_x", "_y"], "left_semi").select("cid", "pos").distinct()
        order = Window.partitionBy("cid").orderBy("pos")
        fresh = (F.col("pos") > F.coalesce(F.lag("pos").over(order), F.lit(-self.least - 1)) + self.least).cast("int")
        marked = held.withColumn("_fresh", fresh).withColumn("_island", F.sum("_fresh").over(order))
        return marked.groupBy("cid", "_island").agg(F.min("pos").alias("start"), (F.max("pos") + self.least).alias("end")).drop("_island")

    def shares(self) -> DataFrame:
        """``(id, n_letters, n_shared)``: how much of each row that takes part stands in rows of other keys.

        A row whose whole text occurs under another key is shared entirely.
        """
        covered = self.stretches().groupBy("cid").agg(F.sum(F.col("end") - F.col("start")).alias("_n"))
        joined = self.members().join(covered, "cid", "left")
        n = F.when(F.col("klo") != F.col("khi"), F.col("n_letters")).otherwise(F.coalesce("_n", F.lit(0)))
        return joined.select("id", F.col("n_letters").cast("bigint").alias("n_letters"), n.cast("bigint").alias("n_shared"))
