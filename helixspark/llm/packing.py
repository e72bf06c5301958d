"""Messages of uneven length packed into containers of a fixed number of tokens.

Conflict-constrained best fit.  Items come in descending size; open
containers are kept in order of residual capacity and carry bitmaps of the
duplicate clusters they hold and of the sources that have used up their places
there; an item goes to the
container with the least sufficient residual, and where that one conflicts
the search goes on to the next larger residual until a compatible one is
found.  Items larger than a container are split into full containers and a
rest, no other item is split.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 4096
#: Items per shard: each shard is packed by one task, and may leave one container poorly filled.
SHARD = 8000
#: Messages of one source that may share a container: as many as a container holds of average size.
PER_SOURCE = 6
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the byte-level tokenizer splits text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Bytes of the vocabulary at most, which travels to the executors.
MOST_VOCABULARY = 64 << 20


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    """The vocabulary file, which only the driver needs to see."""
    if os.path.getsize(path) > MOST_VOCABULARY:
        raise ValueError(f"a vocabulary holds at most {MOST_VOCABULARY} bytes")
    with open(path, "rb") as f:
        return f.read()


def token_counter(vocabulary: bytes | None = None):
    """A function from text to its number of tokens; text is never truncated, special tokens are ordinary text."""
    import tiktoken

    lines = (read_vocabulary() if vocabulary is None else vocabulary).splitlines()
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def count(text: str) -> int:
        try:
            return len(encoding.encode_ordinary(text))
        except UnicodeEncodeError:  # half a surrogate pair
            return len(encoding.encode_ordinary(text.encode("utf-8", "replace").decode("utf-8")))

    return count


def best_fit(sizes: list[int], clusters: list[int], sources: list[int], capacity: int, per_source: int = 0) -> list[int]:
    """Container number of each item; ``sizes`` at most ``capacity``, in the order they are to be placed.

    Two items of one cluster never share a container (negative clusters
    conflict with nothing), nor do more than ``per_source`` of one source,
    unless that is 0.
    """
    opened: list[tuple[int, int]] = []  # (residual, container), in order
    held: list[int] = []  # bitmap of clusters of each container
    fed: list[int] = []  # bitmap of the sources that have no more places in it
    taken: dict[tuple[int, int], int] = {}  # places by container and source
    out = []
    for size, cluster, source in zip(sizes, clusters, sources, strict=True):
        bit = 1 << cluster if cluster >= 0 else 0
        feed = 1 << source if per_source and source >= 0 else 0
        i = bisect_left(opened, (size, -1))
        while i < len(opened) and (held[opened[i][1]] & bit or fed[opened[i][1]] & feed):
            i += 1
        if i < len(opened):
            residual, at = opened.pop(i)
        else:
            residual, at = capacity, len(held)
            held.append(0)
            fed.append(0)
        held[at] |= bit
        if feed:
            taken[at, source] = taken.get((at, source), 0) + 1
            if taken[at, source] == per_source:
                fed[at] |= feed
        if residual > size:
            insort(opened, (residual - size, at))
        out.append(at)
    return out


def sized(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, source, cluster, n_tokens)`` of every message with a text; ``cluster`` is the hash of its text without white space."""

    shared = documents.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    @F.pandas_udf("int")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = token_counter(shared.value)
        for texts in batches:
            yield pd.Series([count(t) for t in texts], dtype="int32")

    rows = documents.where(F.col("text").isNotNull())
    return rows.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.xxhash64(F.regexp_replace("text", r"\s+", "")).alias("cluster"), tokens("text").alias("n_tokens"))


def pack(items: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, per_source: int = 0, n_items: int | None = None) -> DataFrame:
    """``(container, doc_id, piece, n_tokens)``: every item of ``items(doc_id, source, cluster, n_tokens)`` in a container.

    Items are dealt to shards by a hash of their id, so shards are alike
    whatever the source, cluster or order of the input, and a cluster that
    holds a third of all items is spread over all of them.  Pieces of an item
    larger than ``capacity`` are numbered from 0; an empty text takes no
    space but has its place.  A container holds at most ``per_source`` items
    of one source (0: any number).  Containers are named by shard and number.
    """
    shards = max(1, -(-(items.count() if n_items is None else n_items) // shard))

    def place(group: pd.DataFrame) -> pd.DataFrame:
        full = (group["n_tokens"] - 1).clip(lower=0) // capacity
        rest = group.assign(piece=full, size=group["n_tokens"] - full * capacity).sort_values(["size", "doc_id"], ascending=[False, True], ignore_index=True)
        codes, _ = pd.factorize(rest["cluster"])
        many = pd.Series(codes).map(pd.Series(codes).value_counts()) > 1
        clusters, _ = pd.factorize(pd.Series(codes).where(many.to_numpy()))  # single items conflict with nothing
        sources, _ = pd.factorize(rest["source"])
        at = best_fit(rest["size"].tolist(), clusters.tolist(), sources.tolist(), capacity, per_source)
        used = max(at, default=-1) + 1
        split = group[full > 0]
        whole = pd.DataFrame([(d, p) for d, n in zip(split["doc_id"], full[full > 0], strict=True) for p in range(n)], columns=["doc_id", "piece"])
        whole = whole.assign(number=range(used, used + len(whole)), n_tokens=capacity)
        parts = rest.assign(number=at)[["doc_id", "piece", "number", "size"]].rename(columns={"size": "n_tokens"})
        out = pd.concat([parts, whole], ignore_index=True)
        out["container"] = [f"{group['shard'].iloc[0]}-{n}" for n in out["number"]]
        return out[["container", "doc_id", "piece", "n_tokens"]]

    dealt = items.select("doc_id", "source", "cluster", "n_tokens", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"))
    return dealt.groupBy("shard").applyInPandas(place, "container string, doc_id bigint, piece int, n_tokens int")


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: ``n_containers, n_tokens, least_containers, filled``, the share of all space that is used."""
    each = packed.groupBy("container").agg(F.sum("n_tokens").alias("n"))
    total = each.agg(F.count("*").alias("n_containers"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_tokens"))
    least = F.ceil(F.col("n_tokens") / capacity)
    return total.select("n_containers", "n_tokens", least.alias("least_containers"), (F.col("n_tokens") / (F.col("n_containers") * capacity)).alias("filled"))
