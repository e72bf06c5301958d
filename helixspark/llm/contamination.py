"""Evaluation passages inside training texts, by winnowed fingerprints.

A text's fingerprints are the least hashes of ``GRAM`` words in every window
of ``WINDOW`` neighbours, so that any ``SPAN`` consecutive words shared by two
texts give both a common fingerprint.  Common fingerprints are extended word
by word both ways.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixspark.llm import mail, spans

SPAN = 12
GRAM = 8
WINDOW = SPAN - GRAM + 1
#: Bytes of all items together up to which they travel with the tasks, whatever their script; more are joined by fingerprint.
MOST_BYTES = 16 << 20
#: Parts over which the texts that share one fingerprint are dealt.
SALT = 16
#: A word that no text holds, between the parts of a message.
_BREAK = 0


class _Hashes:
    """64-bit hash of each word, remembered for the words seen most."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    def of(self, words: list[str]) -> list[int]:
        seen = self.seen
        if len(seen) > 500_000:
            seen.clear()
        out = []
        for w in words:
            h = seen.get(w)
            if h is None:
                h = seen[w] = xxhash.xxh64_intdigest(w) | 1
            out.append(h)
        return out


def word_hashes(texts: list[str], hashes: _Hashes) -> np.ndarray:
    out: list[int] = []
    for i, t in enumerate(texts):
        if i:
            out.append(_BREAK)
        out += hashes.of(mail.words(t))
    return np.array(out, dtype=np.uint64)


def _reader(as_mail: bool) -> Callable[[str], list[str]]:
    return mail.seen if as_mail else lambda t: [t]


def _fingerprints(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(x) for x in docs], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if docs else lengths
    return spans.winnow(np.concatenate(docs) if docs else np.empty(0, dtype=np.uint64), starts, lengths, GRAM, WINDOW)


def _reach(a: np.ndarray, i: int, b: np.ndarray, j: int) -> int:
    """Words that agree around two places, the gram itself included; 0 if the gram differs."""
    lo, hi = 0, 0
    while lo < min(i, j) and a[i - lo - 1] == b[j - lo - 1] != _BREAK:
        lo += 1
    most = min(len(a) - i, len(b) - j)
    while hi < most and a[i + hi] == b[j + hi] != _BREAK:
        hi += 1
    return lo + hi if hi >= GRAM else 0


def _prints(rows: DataFrame, id_name: str, as_mail: bool) -> DataFrame:
    """``(h, id, before, gram, after)``: fingerprints with the hashes of the words around them."""
    side = SPAN - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, hashes = _reader(as_mail), _Hashes()
        for big in batches:
            for at in range(0, big.num_rows, 500):
                batch = big.slice(at, 500)
                docs = [word_hashes(read(t), hashes) for t in batch.column(1).to_pylist()]
                n, pos, h = _fingerprints(docs)
                cut = lambda lo, hi: pa.array([docs[d][max(p + lo, 0) : max(p + hi, 0)].view(np.int64).tolist() for d, p in zip(n, pos, strict=True)], pa.list_(pa.int64()))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(h), batch.column(0).take(pa.array(n)), cut(-side, 0), cut(0, GRAM), cut(GRAM, GRAM + side)], names=["h", id_name, "before", "gram", "after"])

    array = "array<bigint>"
    return rows.mapInArrow(run, f"h bigint, {id_name} bigint, before {array}, gram {array}, after {array}")


def _agree(a: Column, b: Column, most: int, from_end: bool) -> Column:
    """Length of the common start, or end, of two arrays; a break agrees with nothing."""
    part = (lambda x, i: F.slice(x, -i, i)) if from_end else (lambda x, i: F.slice(x, 1, i))
    ok = lambda i: (i <= F.size(a)) & (i <= F.size(b)) & (part(a, i) == part(b, i)) & ~F.array_contains(part(a, i), F.lit(_BREAK).cast("bigint"))
    return F.size(F.filter(F.sequence(F.lit(1), F.lit(most)), lambda i: F.when((i <= F.size(a)) & (i <= F.size(b)), ok(i)).otherwise(False)))


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", as_mail: bool = True, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Distinct ``(doc_id, item_id)``: the document holds at least ``SPAN`` consecutive words of the item.

    Words are runs of letters and digits, case ignored.  Documents are read as
    mail (encodings and markup undone) unless ``as_mail`` is false; a passage
    doesn't run across the parts of a message.  Null and empty texts and
    items shorter than ``SPAN`` words match nothing; repeated items are found
    each.  Items of at most ``most_bytes`` bytes together are matched where
    the documents are read; more are joined by fingerprint, the texts of a
    fingerprint that very many share (a disclaimer, say) dealt to ``SALT``
    tasks.
    """
    docs = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    tests = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    size = tests.agg(F.sum(F.octet_length("text") + 16).alias("n")).first()["n"] or 0
    if size > most_bytes:
        side = SPAN - GRAM
        dealt = _prints(docs, "doc_id", as_mail).withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)))
        every = _prints(tests, "item_id", False).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALT - 1).cast("bigint"))))
        a, b = dealt.alias("a"), every.alias("b")
        reach = _agree(F.col("a.before"), F.col("b.before"), side, True) + _agree(F.col("a.after"), F.col("b.after"), side, False)
        joined = a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a._salt") == F.col("b._salt")) & (F.col("a.gram") == F.col("b.gram"))).where(reach >= side)
        return joined.select("doc_id", "item_id").distinct()
    listed = [(r["item_id"], r["text"]) for r in tests.collect()]
    shared = documents.sparkSession.sparkContext.broadcast(listed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, hashes = _reader(as_mail), _Hashes()
        known = [(i, word_hashes([t], hashes)) for i, t in shared.value]
        n, pos, h = _fingerprints([w for _, w in known])
        index: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for d, p, x in zip(n.tolist(), pos.tolist(), h.tolist(), strict=True):
            index[x].append((d, p))
        marks = np.unique(h)
        for big in batches:
            for at in range(0, big.num_rows, 500):
                batch = big.slice(at, 500)
                ids = batch.column(0).to_pylist()
                texts = [word_hashes(read(t), hashes) for t in batch.column(1).to_pylist()]
                n, pos, h = _fingerprints(texts)
                hit = np.flatnonzero(np.isin(h, marks))
                found = set()
                for d, p, x in zip(n[hit].tolist(), pos[hit].tolist(), h[hit].tolist(), strict=True):
                    for k, q in index[x]:
                        if (d, k) not in found and _reach(texts[d], p, known[k][1], q) >= SPAN:
                            found.add((d, k))
                rows = [(ids[d], known[k][0]) for d, k in found]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["doc_id", "item_id"])

    return docs.mapInArrow(run, "doc_id bigint, item_id bigint").distinct()


def leaked_items(found: DataFrame, items: DataFrame) -> DataFrame:
    """``(item_id, suite, split_name, n_docs)`` of every item, with 0 where it leaked nowhere."""
    counts = found.groupBy("item_id").agg(F.count("*").alias("n_docs"))
    return items.select("item_id", "suite", "split_name").join(counts, "item_id", "left").fillna(0, ["n_docs"])
