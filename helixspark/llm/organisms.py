"""Freely typed organism names mapped to a reference list.

A multi-pattern automaton over canonical names and their aliases finds the
names embedded in a value; the longest match that overlaps no earlier one
wins.  Values in which no name is found go to a token-set similarity that
allows for misspelt tokens.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most entries of the reference list that may travel with the tasks.
MOST_ENTRIES = 200_000
#: Least similarity of a misspelt token with a token of the list, and of both tokens of a name together.
LEAST_TOKEN, LEAST_NAME = 0.7, 0.8
UNMATCHED = -1


def tokens(text: str) -> list[str]:
    """Lower-case runs of letters and digits, after Unicode compatibility folding."""
    return re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", text).lower())


def similarity(a: str, b: str, least: float) -> float:
    """1 - edits / longest, counting swapped neighbours as one edit; 0 below ``least``."""
    n, m = len(a), len(b)
    longest = max(n, m)
    most = int((1 - least) * longest)
    if abs(n - m) > most:
        return 0.0
    before, last = [], list(range(m + 1))
    for i in range(1, n + 1):
        row = [i] + [0] * m
        x, y = a[i - 1], a[i - 2] if i > 1 else ""
        for j in range(1, m + 1):
            c = b[j - 1]
            d = last[j - 1] + (x != c)
            if last[j] + 1 < d:
                d = last[j] + 1
            if row[j - 1] + 1 < d:
                d = row[j - 1] + 1
            if y and j > 1 and x == b[j - 2] and y == c and before[j - 2] + 1 < d:
                d = before[j - 2] + 1
            row[j] = d
        if min(row) > most:
            return 0.0
        before, last = last, row
    return 1 - last[m] / longest if last[m] <= most else 0.0


def _grams(word: str) -> set[str]:
    padded = f"^{word}$"
    return {padded[i : i + 2] for i in range(len(padded) - 1)}


class Matcher:
    """Maps one value to the id of the single entry it means, or ``UNMATCHED``."""

    def __init__(self, entries: list[tuple[int, str, str | None]]):
        import ahocorasick

        aliases: dict[str, set[int]] = defaultdict(set)
        self.names: dict[int, list[tuple[str, ...]]] = defaultdict(list)
        for i, name, common in entries:
            words = tokens(name or "")
            if words:
                aliases[" ".join(words)].add(i)
                self.names[i].append(tuple(words))
            if len(words) == 2:
                aliases[f"{words[1]} {words[0]}"].add(i)
                aliases[f"{words[0][0]} {words[1]}"].add(i)
            other = tokens(common or "")
            if other:
                aliases[" ".join(other)].add(i)
                self.names[i].append(tuple(other))
        self.automaton = ahocorasick.Automaton()
        for alias, ids in aliases.items():
            self.automaton.add_word(f" {alias} ", (len(alias) + 2, frozenset(ids)))
        if aliases:
            self.automaton.make_automaton()
        self.words: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, forms in self.names.items():
            for f, form in enumerate(forms):
                for w in form:
                    self.words[w].append((i, f))
        self.by_gram: dict[str, list[str]] = defaultdict(list)
        for w in self.words:
            for g in _grams(w):
                self.by_gram[g].append(w)
        self.near: dict[str, list[tuple[str, float]]] = {}

    def mentions(self, words: list[str]) -> list[frozenset[int]]:
        """The entries of the longest matches, left to right, none overlapping another."""
        if not len(self.automaton):
            return []
        text = " " + " ".join(words) + " "
        found = sorted(((end - size + 1, -size, ids) for end, (size, ids) in self.automaton.iter(text)), key=lambda x: (x[1], x[0]))
        used, taken = bytearray(len(text)), []
        for start, size, ids in found:  # longest first; neighbours may share the blank between them
            inside = slice(start + 1, start - size - 1)
            if not any(used[inside]):
                used[inside] = b"\x01" * (-size - 2)
                taken.append((start, ids))
        return [ids for _, ids in sorted(taken, key=lambda x: x[0])]

    def alike(self, token: str) -> list[tuple[str, float]]:
        """Words of the list like ``token``, with their similarity."""
        if token not in self.near:
            shared: dict[str, int] = defaultdict(int)
            grams = _grams(token)
            for g in grams:
                for w in self.by_gram.get(g, ()):
                    shared[w] += 1
            out = []
            for w, n in shared.items():
                # an edit destroys at most three bigrams
                if n >= max(2, len(grams) - 3 * int((1 - LEAST_TOKEN) * max(len(token), len(w)))):
                    s = similarity(token, w, LEAST_TOKEN)
                    if s:
                        out.append((w, s))
            if len(self.near) > 100_000:
                self.near.clear()
            self.near[token] = out
        return self.near[token]

    def fuzzy(self, words: list[str]) -> int:
        """The entry whose tokens are all found, misspelt perhaps, among ``words``; best mean similarity, ties unmatched."""
        scores: dict[tuple[int, int], dict[str, float]] = defaultdict(dict)
        for t in words:
            for w, s in self.alike(t):
                for at in self.words[w]:
                    scores[at][w] = max(scores[at].get(w, 0.0), s)
        best: dict[int, float] = {}
        for (i, f), by in scores.items():
            form = self.names[i][f]
            if len(by) == len(set(form)):
                mean = sum(by[w] * len(w) for w in by) / sum(map(len, by))
                if mean >= LEAST_NAME:
                    best[i] = max(best.get(i, 0.0), mean)
        top = sorted(best.items(), key=lambda x: -x[1])
        return top[0][0] if top and (len(top) == 1 or top[0][1] > top[1][1]) else UNMATCHED

    def __call__(self, value: str) -> int:
        words = tokens(value)
        found = self.mentions(words)
        if not found:
            return self.fuzzy(words)
        sure = {next(iter(x)) for x in found if len(x) == 1}
        if len(sure) == 1:
            one = next(iter(sure))
            return one if all(one in x for x in found) else UNMATCHED
        return UNMATCHED


def map_values(df: DataFrame, column: str, reference: DataFrame, id_column: str, names: tuple[str, str], keep: list[str]) -> DataFrame:
    """``keep`` and ``id_column``: the entry meant by ``column``, -1 where none, or more than one, is meant.

    ``reference`` holds the canonical name and one alias per entry, and must
    have at most ``MOST_ENTRIES`` rows (checked), as it travels with the tasks.
    Rows whose value is null or blank give no row.  Each batch maps its
    distinct values once, so repeated values cost nothing and no shuffle is
    needed.  An empty list leaves every value unmatched.
    """
    entries = [tuple(r) for r in reference.select(id_column, *names).limit(MOST_ENTRIES + 1).collect()]
    if len(entries) > MOST_ENTRIES:
        raise ValueError(f"the reference list has more than {MOST_ENTRIES} entries")
    shared = df.sparkSession.sparkContext.broadcast(entries)

    @F.pandas_udf("int")
    def species_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        match = Matcher(shared.value)
        for values in batches:
            codes, distinct = pd.factorize(values)
            ids = pd.Series([match(v) for v in distinct], dtype="int32")
            yield ids.take(codes).reset_index(drop=True) if len(ids) else pd.Series([UNMATCHED] * len(values), dtype="int32")

    value = F.col(column)
    rows = df.select(*keep, value).where(value.rlike(r"[^\s 　]"))
    return rows.withColumn(id_column, species_of(value))


def report(mapped: DataFrame, column: str, id_column: str) -> DataFrame:
    """Rows per typed value and entry, unmatched values included."""
    return mapped.groupBy(column, id_column).agg(F.count("*").alias("n_rows"))
