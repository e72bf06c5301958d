"""Words of many texts at once: texts are laid end to end and every step is an array operation over letters."""

from __future__ import annotations

import numpy as np

from helixspark import schema

FRAMES = ("+1", "+2", "+3", "-1", "-2", "-3")
_COMPLEMENT = str.maketrans("ATGCN", "TACGN")

def _digits(texts: list[str], alphabet: str) -> tuple[np.ndarray, np.ndarray]:
    """The digit of each letter, -1 for letters that have none, and each letter's text; texts are followed by one place that has none."""
    table = np.full(256, -1, dtype=np.int64)
    table[np.frombuffer(alphabet.encode(), dtype=np.uint8)] = np.arange(len(alphabet))
    raw = [t.encode("ascii", "replace") for t in texts]
    letters = np.frombuffer(b"".join(r + b"\0" for r in raw), dtype=np.uint8)
    return table[letters], np.repeat(np.arange(len(raw)), [len(r) + 1 for r in raw])


def word_codes(texts: list[str], k: int, alphabet: str) -> tuple[np.ndarray, np.ndarray]:
    """``(text, code)``: the distinct words of ``k`` letters of each text as codes in the base of the alphabet; words with another letter have none."""
    digits, text = _digits(texts, alphabet)
    n = len(digits) - k + 1
    if n < 1:
        none = np.empty(0, dtype=np.int64)
        return none, none
    code, good = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    for i in range(k):
        part = digits[i : i + n]
        code = code * len(alphabet) + part
        good &= part >= 0
    code, text = code[good], text[:n][good]
    order = np.lexsort((code, text))
    code, text = code[order], text[order]
    fresh = np.ones(len(code), dtype=bool)
    fresh[1:] = (code[1:] != code[:-1]) | (text[1:] != text[:-1])
    return text[fresh], code[fresh]


def trigram_bitmaps(texts: list[str], alphabet: str) -> tuple[np.ndarray, np.ndarray]:
    """Each text's set of inner trigrams as two bitmaps, of the codes below 63 and of those from 63 on."""
    text, code = word_codes(texts, 3, alphabet)
    out = []
    for lo, hi in ((0, 63), (63, 126)):
        mine = (code >= lo) & (code < hi)
        bits = np.zeros(len(texts), dtype=np.int64)
        np.bitwise_or.at(bits, text[mine], np.left_shift(np.int64(1), code[mine] - lo))
        out.append(bits)
    return out[0], out[1]


def frames_to_stop(text: str) -> list[str]:
    """What each of ``FRAMES`` reads before its first stop; unknown codons are ``?``."""
    out = []
    for s in (text, text.translate(_COMPLEMENT)[::-1]):
        for f in range(3):
            read = []
            for i in range(f, len(s) - 2, 3):
                amino = schema.CODONS.get(s[i : i + 3], "?")
                if amino == "*":
                    break
                read.append(amino)
            out.append("".join(read))
    return out


def joined_frames(texts: list[str]) -> list[str]:
    """Of each text what its frames read, as one text; no word crosses a frame."""
    return ["*".join(frames_to_stop(t)) for t in texts]


def _all_codes(texts: list[str], k: int, alphabet: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, code, good)`` of every place: the code of the word that starts there, built from halves, and whether all of its letters have a digit."""
    digits, text = _digits(texts, alphabet)
    n = len(digits) - k + 1
    if n < 1:
        none = np.empty(0, dtype=np.int64)
        return none, none, none.astype(bool)
    bad = np.concatenate([[0], np.cumsum(digits < 0, dtype=np.int32)])
    good = bad[k:] == bad[:-k]
    piece, size, code, done = np.maximum(digits, 0), 1, None, 0
    while done < k:
        if (k - done) & size:
            code = piece[:n] if code is None else code * len(alphabet) ** size + piece[done : done + n]
            done += size
        if done < k:
            piece, size = piece[: len(piece) - size] * len(alphabet) ** size + piece[size:], size * 2
    return text[:n], code, good


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


class Asked:
    """The words of a block of queries, to count how many distinct ones each gene shares with each query."""

    #: Pairs of a gene and a query's word that are looked at together.
    HITS = 4_000_000
    #: Pairs held between two cuts to the best.
    HELD = 2_000_000

    def __init__(self, texts: list[str], k: int, alphabet: str):
        self.k, self.alphabet, self.size = k, alphabet, len(texts)
        text, code, good = _all_codes(texts, k, alphabet)
        both = _distinct(code[good] * self.size + text[good])
        code, self.who = both // max(self.size, 1), (both % max(self.size, 1)).astype(np.int32)
        #: Distinct words of each query.
        self.n_words = np.bincount(self.who, minlength=self.size)
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.empty(0, dtype=np.int64)
        self.codes, self.start = code[first], np.append(first, len(code))
        self.space = len(alphabet) ** k
        if self.space <= 1 << 24:
            self.place = np.full(self.space, -1, dtype=np.int32)
            self.place[self.codes] = np.arange(len(self.codes), dtype=np.int32)
        else:  # most words that no query has are passed over by their last bits
            self.seen = np.zeros(1 << 24, dtype=bool)
            self.seen[self.codes & ((1 << 24) - 1)] = True

    def _words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``(text, place)``: the distinct words of each text that any query has, by their place among ``codes``."""
        text, code, good = _all_codes(texts, self.k, self.alphabet)
        if not len(self.codes):
            return text[:0], code[:0]
        if self.space <= 1 << 24:
            at = self.place[code]
            good &= at >= 0
            text, at = text[good], at[good].astype(np.int64)
        else:
            good &= self.seen[code & ((1 << 24) - 1)]
            text, code = text[good], code[good]
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            same = self.codes[at] == code
            text, at = text[same], at[same]
        both = _distinct(text * len(self.codes) + at)
        return both // len(self.codes), both % len(self.codes)

    def _hits(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The queries that have each word of ``at``, one after the other, and how many they are."""
        n = self.start[at + 1] - self.start[at]
        before = np.cumsum(n) - n
        return self.who[np.repeat(self.start[at] - before, n) + np.arange(int(n.sum()))], n

    def _counts(self, text: np.ndarray, at: np.ndarray):
        """``(text, query, shared)`` of all pairs that share a word, in runs that fit into memory; texts ascend."""
        n = self.start[at + 1] - self.start[at]
        ends = np.append(np.flatnonzero(text[1:] != text[:-1]) + 1, len(text)) if len(text) else []
        upto = np.cumsum(n)
        lo = 0
        while lo < len(text):
            base = upto[lo - 1] if lo else 0
            best = np.searchsorted(upto[ends - 1], base + self.HITS, "right")
            hi = int(max(ends[np.searchsorted(ends, lo, "right")], ends[best - 1] if best else 0))
            if upto[hi - 1] - base > self.HITS:  # one text with very many: counted word by word
                shared, step = np.zeros(self.size, dtype=np.int64), lo
                while step < hi:
                    to = int(max(step + 1, min(hi, np.searchsorted(upto, (upto[step - 1] if step else 0) + self.HITS, "right"))))
                    shared += np.bincount(self._hits(at[step:to])[0], minlength=self.size)
                    step = to
                query = np.flatnonzero(shared)
                yield np.full(len(query), text[lo]), query, shared[query]
            else:
                who, each = self._hits(at[lo:hi])
                first, n_texts = int(text[lo]), int(text[hi - 1] - text[lo]) + 1
                cell = np.repeat(text[lo:hi] - first, each) * self.size + who
                if n_texts * self.size <= 4 * len(cell):
                    dense = np.bincount(cell, minlength=1)
                    cell = np.flatnonzero(dense)
                    shared = dense[cell]
                else:
                    cell, shared = np.unique(cell, return_counts=True)
                yield cell // self.size + first, cell % self.size, shared
            lo = hi

    def holders(self, texts: list[str], step: int = 2000):
        """Of each text the queries that have that of its words which fewest have; null for a text without words of the alphabet."""
        for lo in range(0, len(texts), step):
            some = texts[lo : lo + step]
            text, code, good = _all_codes(some, self.k, self.alphabet)
            text, code = text[good], code[good]
            found: list = [None] * len(some)
            if len(text):
                at = np.searchsorted(self.codes, code) if self.space > 1 << 24 else self.place[code]
                at = np.minimum(at, len(self.codes) - 1)
                held = (at >= 0) & (self.codes[at] == code) if len(self.codes) else np.zeros(len(at), dtype=bool)
                n = np.where(held, self.start[at + 1] - self.start[at], 0)
                first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
                fewest = np.minimum.reduceat(n, first)
                rarest = np.flatnonzero(n == np.repeat(fewest, np.diff(np.append(first, len(text)))))
                rarest = rarest[np.concatenate([[True], text[rarest][1:] != text[rarest][:-1]])]
                for i, x, m in zip(text[first].tolist(), at[rarest].tolist(), fewest.tolist(), strict=True):
                    found[i] = self.who[self.start[x] : self.start[x + 1]].tolist() if m else []
            yield from found

    def best(self, ids: np.ndarray, texts: list[str], top: int, need: np.ndarray | None = None, step: int = 2000, prepare=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(query, id, shared)``: of the genes ``ids`` with ``texts`` the ``top`` that share most words with each query, ties by id, and all that share ``need`` of the query or more.

        Genes are taken in order of their ids, so a later one must share more
        words than the last of the best so far.
        """
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        none = np.iinfo(np.int64).max
        need = np.full(self.size, none) if need is None else np.maximum(need, 1)
        least = np.full(self.size, 1 if top else none)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def cut() -> None:
            gene, query, shared = (np.concatenate(x) for x in zip(*held, strict=True))
            by = np.lexsort((gene, -shared, query))
            gene, query, shared = gene[by], query[by], shared[by]
            fresh = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.empty(0, dtype=np.int64)
            rank = np.arange(len(query)) - np.repeat(fresh, np.diff(np.append(fresh, len(query))))
            last = rank == top - 1
            least[query[last]] = shared[last] + 1
            keep = (rank < top) | (shared >= need[query])
            held[:] = [(gene[keep], query[keep], shared[keep])]

        n, limit = 0, self.HELD
        for lo in range(0, len(ids), step):
            part = order[lo : lo + step]
            some = [texts[i] for i in part]
            for gene, query, shared in self._counts(*self._words(prepare(some) if prepare else some)):
                good = (shared >= least[query]) | (shared >= need[query])
                held.append((gene[good] + lo, query[good], shared[good]))
                n += int(good.sum())
                if n > limit:
                    cut()
                    n = len(held[0][0])
                    limit = n + self.HELD
        if not held:
            return (np.empty(0, dtype=np.int64),) * 3
        cut()
        gene, query, shared = held[0]
        return query, ids[gene], shared
