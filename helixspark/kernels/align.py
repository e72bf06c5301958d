"""Alignment by dynamic programming, many pairs at a time.

A batch of pairs is padded to one shape and filled row by row: every step is
an array operation over pairs and columns.  Cells only look up and left, so
padding never reaches the cells of a shorter pair.  Of a pair whose cells
don't fit, the rows between stored ones are filled again on the way back, so
memory grows with the length times its square root and no length is refused.
"""

from __future__ import annotations

import numpy as np

from helixspark import schema

NEG = -(10**7)
GAP_OPEN, GAP_EXTEND, LOCAL_GAP = -10, -1, -2
#: Cells whose way back is kept at once.
CELLS = 16_000_000


def _table(letters: str, rows: np.ndarray, unknown: int) -> np.ndarray:
    """Scores by letter code; all letters that have none share the score ``unknown``."""
    out = np.full((128, 128), unknown, dtype=np.int32)
    at = np.frombuffer(letters.encode(), dtype=np.uint8)
    out[np.ix_(at, at)] = rows
    return out


def _dna() -> np.ndarray:
    rows = np.full((5, 5), -1)
    np.fill_diagonal(rows, 2)
    rows[4, :] = rows[:, 4] = 0
    return _table("ATGCN", rows, 0)


def _protein() -> np.ndarray:
    lower = [list(map(int, line.split())) for line in schema.BLOSUM_ROWS.split("\n") if line]
    rows = np.zeros((20, 20), dtype=np.int32)
    for i, line in enumerate(lower):
        rows[i, : i + 1] = rows[: i + 1, i] = line
    return _table(schema.BLOSUM_ORDER, rows, -4)


SCORES = {"dna": _dna(), "protein": _protein()}


def score(a: str, b: str, kind: str = "dna") -> int:
    """ALN-03: score of two letters; unknown ones have 0 in DNA, -4 in proteins."""
    return int(SCORES[kind][min(ord(a.upper()), 127), min(ord(b.upper()), 127)])


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.upper().encode("ascii", "replace") for t in texts]
    sizes = np.array([len(r) for r in raw])
    out = np.zeros((len(raw), max(int(sizes.max(initial=0)), 1)), dtype=np.uint8)
    for i, r in enumerate(raw):
        out[i, : len(r)] = np.frombuffer(r, dtype=np.uint8)
    return out, sizes


def _batches(a: list[str], b: list[str]):
    """Pairs of similar size together, as many as fit into ``CELLS``."""
    order = sorted(range(len(a)), key=lambda i: (len(a[i]), len(b[i])))
    batch: list[int] = []
    n = m = 0
    for i in order:
        n2, m2 = max(n, len(a[i]) + 1), max(m, len(b[i]) + 1)
        if batch and n2 * m2 * (len(batch) + 1) > CELLS:
            yield batch
            batch, n2, m2 = [], len(a[i]) + 1, len(b[i]) + 1
        batch.append(i)
        n, m = n2, m2
    if batch:
        yield batch


def _block(rows: int, cols: int, size: int) -> int:
    """Rows whose way back is kept at once: all if they fit, else about as many bytes as the stored rows between them take."""
    return rows if (rows + 1) * (cols + 1) * size <= CELLS else min(rows, max(CELLS // (cols + 1), int((12 * rows) ** 0.5) + 1))


class _Global:
    """One batch of global alignments, filled from any stored row."""

    def __init__(self, s: np.ndarray, t: np.ndarray, kind: str, gap_open: int, gap_extend: int):
        self.rows, self.cols, self.size = s.shape[1], t.shape[1], len(s)
        self.gap_open, self.gap_extend = gap_open, gap_extend
        self.profile, self.letter = _profile(s, t, kind)
        self.steps = np.arange(self.cols + 1, dtype=np.int32) * gap_extend

    def first(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        match = np.full((self.size, self.cols + 1), NEG, dtype=np.int32)
        match[:, 0] = 0
        left = np.full_like(match, NEG)
        left[:, 1:] = self.gap_open - self.gap_extend + self.steps[1:]
        return match, np.full_like(match, NEG), left

    def fill(self, state: tuple, at: int, to: int, back: np.ndarray | None, seen) -> tuple:
        """The state of row ``to`` from that of row ``at``; ``back[:, i - at]`` gets the way back of row ``i``, ``seen`` each state."""
        match, up, left = state
        steps, each, gap_open, gap_extend = self.steps, np.arange(self.size), self.gap_open, self.gap_extend
        if back is not None:
            back[:, 0, 2:] |= 8 if at == 0 else 0
        for i in range(at + 1, to + 1):
            best = np.maximum(np.maximum(match, up), left)
            new = np.full_like(match, NEG)
            np.add(self.profile[each, self.letter[:, i - 1]], best[:, :-1], out=new[:, 1:])
            opened, extended = match + gap_open, up + gap_extend
            down = np.maximum(opened, extended)
            # gaps in a run along the row: a running maximum of where they open
            opens = new[:, :-1] + gap_open
            right = np.full_like(left, NEG)
            np.maximum.accumulate(np.maximum(opens - steps[1:], NEG), axis=1, out=right[:, 1:])
            right[:, 1:] += steps[1:]
            if back is not None:
                source = (match < best).view(np.uint8)
                source += source & (up < best).view(np.uint8)
                code = (opened < extended).view(np.uint8) << 2
                code[:, 1:] |= source[:, :-1]
                code[:, 1:] |= (opens < right[:, :-1] + gap_extend).view(np.uint8) << 3
                back[:, i - at] = code
            match, up, left = new, down, right
            seen(i, (match, up, left))
        return match, up, left


def align_global(a: list[str], b: list[str], kind: str = "dna", gap_open: int = GAP_OPEN, gap_extend: int = GAP_EXTEND) -> list[tuple[str, str, int]]:
    """ALN-01: Needleman-Wunsch with affine gaps: ``(a aligned, b aligned, score)`` of each pair.

    ``gap_open`` is the cost of a gap's first letter; gaps open from a matched
    column only; on ties a match comes before a gap in ``b``, that before a
    gap in ``a``, and opening before extending.
    """
    out: list = [None] * len(a)
    for batch in _batches(a, b):
        s, n = _codes([a[i] for i in batch])
        t, m = _codes([b[i] for i in batch])
        solver = _Global(s, t, kind, gap_open, gap_extend)
        height = _block(solver.rows, solver.cols, len(batch))
        ends = np.zeros((3, len(batch)), dtype=np.int32)
        keep = lambda i, state: _keep(ends, i, n, m, *state)  # noqa: B023, E731
        stored = [solver.first()]
        keep(0, stored[0])
        whole = height == solver.rows
        back = np.zeros((len(batch), height + 1, solver.cols + 1), dtype=np.uint8)
        for at in range(0, solver.rows, height):
            stored.append(solver.fill(stored[-1], at, min(at + height, solver.rows), back if whole else None, keep))
        states = [int(x) for x in np.argmax(ends, axis=0)]
        places = [(len(a[i]), len(b[i]), states[k]) for k, i in enumerate(batch)]
        done: list[tuple[list, list]] = [([], []) for _ in batch]
        for at in reversed(range(0, solver.rows, height)):
            if not whole:
                back[:] = 0
                solver.fill(stored[at // height], at, min(at + height, solver.rows), back, lambda i, state: None)
            for k, i in enumerate(batch):
                places[k] = _walk_global(a[i], b[i], back[k], at, *places[k], *done[k])
        for k, i in enumerate(batch):
            x, y = done[k]
            out[i] = ("".join(reversed(x)), "".join(reversed(y)), int(ends[states[k], k]))
    return out


def score_global(a: list[str], b: list[str], kind: str = "dna", gap_open: int = GAP_OPEN, gap_extend: int = GAP_EXTEND) -> np.ndarray:
    """The scores that ``align_global`` gives, without the way back: rows and columns play the same part, so there is a row per letter of the shorter text."""
    out = np.zeros(len(a), dtype=np.int64)
    a, b = [min(x, y, key=len) for x, y in zip(a, b, strict=True)], [max(y, x, key=len) for x, y in zip(a, b, strict=True)]
    order = sorted(range(len(a)), key=lambda i: (len(a[i]) // 8, len(b[i])))
    batches: list[list[int]] = []
    for i in order:
        if not batches or (len(b[i]) + 1) * len(batches[-1]) > 100_000 or len(a[i]) // 8 != len(a[batches[-1][0]]) // 8 or len(b[i]) > 1.3 * len(b[batches[-1][0]]) + 8:
            batches.append([])
        batches[-1].append(i)
    for batch in batches:
        s, n = _codes([a[i] for i in batch])
        t, m = _codes([b[i] for i in batch])
        solver = _Global(s, t, kind, gap_open, gap_extend)
        ends = np.zeros((3, len(batch)), dtype=np.int32)
        keep = lambda i, state: _keep(ends, i, n, m, *state)  # noqa: B023, E731
        first = solver.first()
        keep(0, first)
        solver.fill(first, 0, solver.rows, None, keep)
        out[batch] = ends.max(axis=0)
    return out


def _walk_global(s: str, t: str, back: np.ndarray, at: int, i: int, j: int, state: int, x: list, y: list) -> tuple[int, int, int]:
    """The way back from cell ``(i, j)`` to row ``at``, or to the origin; ``back`` starts with row ``at``."""
    while i > at or (at == 0 and j > 0):
        code = back[i - at, j]
        if state == 0:
            i, j = i - 1, j - 1
            x.append(s[i]), y.append(t[j])
            state = code & 3
        elif state == 1:
            i -= 1
            x.append(s[i]), y.append("-")
            state = 1 if code & 4 else 0
        else:
            j -= 1
            x.append("-"), y.append(t[j])
            state = 2 if code & 8 else 0
    return i, j, int(state)


def _profile(s: np.ndarray, t: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Score rows of every letter of ``s`` against each text of ``t``, and which of them each place of ``s`` takes."""
    letters, place = np.unique(s, return_inverse=True)
    return SCORES[kind][letters[None, :, None] & 127, t[:, None, :] & 127], place.reshape(s.shape)


def _keep(ends: np.ndarray, i: int, n: np.ndarray, m: np.ndarray, match: np.ndarray, up: np.ndarray, left: np.ndarray) -> None:
    done = np.flatnonzero(n == i)
    for row, x in zip(ends, (match, up, left), strict=True):
        row[done] = x[done, m[done]]


def _fill_local(last: np.ndarray, at: int, to: int, profile: np.ndarray, letter: np.ndarray, gap: int, back: np.ndarray | None, seen) -> np.ndarray:
    steps, each = np.arange(last.shape[1], dtype=np.int32) * gap, np.arange(len(last))
    for i in range(at + 1, to + 1):
        diagonal = last[:, :-1] + profile[each, letter[:, i - 1]]
        above = last[:, 1:] + gap
        now = np.zeros_like(last)
        now[:, 1:] = np.maximum(0, np.maximum(diagonal, above))
        now = np.maximum.accumulate(now - steps, axis=1) + steps
        cell = now[:, 1:]
        if back is not None:
            back[:, i - at, 1:] = np.where(cell == 0, 3, np.where(cell == diagonal, 0, np.where(cell == above, 1, 2)))
        seen(i, cell)
        last = now
    return last


def align_local(a: list[str], b: list[str], kind: str = "dna", gap: int = LOCAL_GAP) -> list[tuple[str, str, int, int, int]]:
    """ALN-02: Smith-Waterman with linear gaps: ``(a part, b part, score, a end, b end)``; the first best cell row by row, diagonal before up before left."""
    out: list = [None] * len(a)
    for batch in _batches(a, b):
        s, n = _codes([a[i] for i in batch])
        t, m = _codes([b[i] for i in batch])
        rows, cols, size = s.shape[1], t.shape[1], len(batch)
        inside = np.arange(1, cols + 1) <= m[:, None]
        profile, letter = _profile(s, t, kind)
        top, at_i, at_j = np.zeros(size, dtype=np.int32), np.zeros(size, dtype=int), np.zeros(size, dtype=int)

        def best_cell(i: int, cell: np.ndarray) -> None:
            live = np.where(inside & (n >= i)[:, None], cell, 0)  # noqa: B023
            best = live.max(axis=1, initial=0)
            better = best > top  # noqa: B023
            top[better], at_i[better], at_j[better] = best[better], i, live.argmax(axis=1)[better] + 1  # noqa: B023

        height = _block(rows, cols, size)
        whole = height == rows
        back = np.full((size, height + 1, cols + 1), 3, dtype=np.uint8)
        stored = [np.zeros((size, cols + 1), dtype=np.int32)]
        for at in range(0, rows, height):
            stored.append(_fill_local(stored[-1], at, min(at + height, rows), profile, letter, gap, back if whole else None, best_cell))
        places = [(int(at_i[k]), int(at_j[k]), False) for k in range(size)]
        done: list[tuple[list, list]] = [([], []) for _ in batch]
        for at in reversed(range(0, rows, height)):
            if all(ended or p <= at for p, _, ended in places) and at > 0:
                continue
            if not whole:
                back[:] = 3
                _fill_local(stored[at // height], at, min(at + height, rows), profile, letter, gap, back, lambda i, cell: None)
            for k, i in enumerate(batch):
                places[k] = _walk_local(a[i], b[i], back[k], at, *places[k], *done[k])
        for k, i in enumerate(batch):
            x, y = done[k]
            out[i] = ("".join(reversed(x)), "".join(reversed(y)), int(top[k]), int(at_i[k]), int(at_j[k]))
    return out


def _walk_local(s: str, t: str, back: np.ndarray, at: int, p: int, q: int, ended: bool, x: list, y: list) -> tuple[int, int, bool]:
    while not ended and p > at:
        code = back[p - at, q]
        if code == 3:
            return p, q, True
        if code != 2:
            p -= 1
        if code != 1:
            q -= 1
        x.append(s[p] if code != 2 else "-"), y.append(t[q] if code != 1 else "-")
    return p, q, ended or at == 0


def insertions(x: str, y: str) -> tuple[list[str], list[str]]:
    """Of a text ``y`` aligned with a centre ``x``: what it inserts before each letter of the centre and behind the last, and its letter at each."""
    inserted, letters, run = [], [], ""
    for c, d in zip(x, y, strict=True):
        if c == "-":
            run += d
        else:
            inserted.append(run)
            letters.append(d)
            run = ""
    return [*inserted, run], letters


def star_row(inserted: list[str], letters: list[str], widths) -> str:
    """A row of the star alignment, its insertions padded to the widest of all rows."""
    return "".join(r.ljust(w, "-") + (letters[i] if i < len(letters) else "") for i, (r, w) in enumerate(zip(inserted, widths, strict=True)))


def star(texts: list[str], kind: str = "dna") -> list[str]:
    """ALN-06: Multiple alignment around the first text: once a gap, always a gap; rows of equal length."""
    if len(texts) < 2:
        return list(texts)
    centre = texts[0]
    pairs = align_global([centre] * (len(texts) - 1), texts[1:], kind)
    # widest insertion before each letter of the centre, and behind the last
    widths = np.zeros(len(centre) + 1, dtype=int)
    split = [insertions(x, y) for x, y, _ in pairs]
    for inserted, _ in split:
        widths = np.maximum(widths, [len(r) for r in inserted])
    return [star_row(ins, ls, widths) for ins, ls in [([""] * (len(centre) + 1), list(centre)), *split]]


def common_letters(a: str, b: str, places: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence, one bit of an integer per letter of ``a``; no alignment has more equal columns."""
    places = letter_places(a) if places is None else places
    every = (1 << len(a)) - 1
    free = every
    for x in b:
        met = free & places.get(x, 0)
        free = ((free + met) | (free - met)) & every
    return len(a) - free.bit_count()


def letter_places(a: str) -> dict[str, int]:
    """The places of each letter as a bitmap."""
    return {x: int("".join("1" if y == x else "0" for y in reversed(a)), 2) for x in set(a)}


class Near:
    """Texts among which those are looked up that could have a percentage of equal columns with another text.

    An alignment of so many equal columns has few gaps, so it stays within a
    band around the diagonal, and has at most as many equal columns as the
    longest common subsequence within that band: a bit per letter of the one
    text, many of the others at a time.  One is given up once even all of its
    remaining letters wouldn't be enough.
    """

    #: Letters of a batch, and its texts.
    LETTERS, TEXTS = 2_000_000, 2_000
    #: Texts up to which each is looked at by itself.
    FEW = 100
    #: Letters between two looks at what is still possible.
    STEP = 32

    def __init__(self, texts: list[str]):
        self.texts = texts
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        self.batches: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        some: list[int] = []
        for i in [*order, None]:
            if some and (i is None or len(some) == self.TEXTS or len(texts[i]) * (len(some) + 1) > self.LETTERS or len(texts[i]) > 1.3 * len(texts[some[0]]) + 64):
                codes, sizes = _codes([texts[k] for k in some])
                self.batches.append((np.array(some), sizes, np.ascontiguousarray(codes.T)))
                some = []
            some.append(i)

    def of(self, text: str, least: float) -> np.ndarray:
        """The places of all texts that have ``least`` percent of equal columns with ``text`` in any alignment, and of some that don't."""
        found, places = [np.empty(0, dtype=np.int64)], letter_places(text)
        for place, sizes, codes in self.batches:
            most = np.maximum(np.maximum(sizes, len(text)), 1)
            good = np.flatnonzero(100 * np.minimum(sizes, len(text)) / most >= least)
            if least > 0 and len(good) <= self.FEW:
                good = good[[100 * common_letters(text, self.texts[place[i]], places) / most[i] >= least for i in good]] if len(good) else good
            elif least > 0:
                lo, hi = good[0], good[-1] + 1
                good = lo + self._reach(text, sizes[lo:hi], codes[: sizes[hi - 1], lo:hi], least)
            found.append(place[good])
        return np.concatenate(found)

    def _reach(self, text: str, sizes: np.ndarray, codes: np.ndarray, least: float) -> np.ndarray:
        n, live = len(text), np.arange(len(sizes))
        own = np.frombuffer(text.upper().encode("ascii", "replace"), dtype=np.uint8)
        words = -(-n // 64)
        bits = np.zeros((256, words * 64), dtype=np.uint8)
        bits[own, np.arange(n)] = 1
        has = np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little").view(np.uint64).T)
        most = np.maximum(sizes, n)
        gaps = np.minimum(sizes, n) * (100 / least - 1) + 1e-6
        down = int(np.floor((n - sizes - gaps).min() / 2)) - 1
        up = int(np.ceil((n - sizes + gaps).max() / 2)) + 1
        free = np.full((words, len(sizes)), ~np.uint64(0))
        for j in range(len(codes)):
            if j % self.STEP == 0 and j:
                equal = 64 * words - np.bitwise_count(free).sum(axis=0, dtype=np.int64)
                keep = 100 * (equal + np.maximum(sizes - j, 0)) / most >= least
                if not keep.all():
                    live, sizes, most, free, codes = live[keep], sizes[keep], most[keep], np.ascontiguousarray(free[:, keep]), np.ascontiguousarray(codes[:, keep])
                    if not len(live):
                        return live
            if j % self.STEP == 0:
                met, new, over, carry, more = (np.empty(len(live), dtype=t) for t in (np.uint64, np.uint64, bool, np.uint64, bool))
            letter = codes[j].astype(np.intp)
            first, last = max(j + down, 0) // 64, min((j + 1 + up) // 64, words - 1)
            for w in range(first, last + 1):
                now = free[w]
                np.take(has[w], letter, out=met, mode="clip")
                np.bitwise_and(met, now, out=met)
                np.add(now, met, out=new)
                if w < last:
                    np.less(new, met, out=over)
                if w > first:
                    np.add(new, carry, out=new)
                    if w < last:
                        np.less(new, carry, out=more)
                        np.logical_or(over, more, out=over)
                if w < last:
                    np.copyto(carry, over)
                np.bitwise_xor(now, met, out=now)
                np.bitwise_or(now, new, out=now)
        equal = 64 * words - np.bitwise_count(free).sum(axis=0, dtype=np.int64)
        return live[100 * equal / most >= least]
