"""The functions of the engine under names that SQL can call.

Scalar functions are SQL functions over built-in expressions, so a query that
calls them is planned like one that spells them out.  Alignment is an Arrow
function; reading frames and tandem repeats are table functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from helixspark import schema
from helixspark.kernels import align

#: Name and parameters, type of the result, expression.
SCALAR = {
    "seq_clean(s STRING)": ("STRING", r"upper(regexp_replace(s, '\\s+', ''))"),
    "seq_count(s STRING, letters STRING)": ("BIGINT", "CAST(length(s) - length(translate(s, letters, '')) AS BIGINT)"),
    "seq_gc(s STRING)": ("DOUBLE", "CASE WHEN length(s) = 0 THEN 0D ELSE 100 * (length(s) - length(translate(s, 'GC', ''))) / length(s) END"),
    "seq_reverse_complement(s STRING)": ("STRING", "reverse(translate(s, 'ATGCN', 'TACGN'))"),
    "seq_has_start(s STRING)": ("BOOLEAN", "contains(s, 'ATG') OR contains(s, 'CAT')"),
    "seq_melting(s STRING)": ("DOUBLE", """CASE WHEN length(s) = 0 THEN NULL WHEN length(s) <= 13 THEN CAST(2 * length(regexp_replace(s, '[^AT]', '')) + 4 * length(regexp_replace(s, '[^GC]', '')) AS DOUBLE)
        ELSE 64.9D + 41 * (length(regexp_replace(s, '[^GC]', '')) - 16.4D) / length(s) END"""),
    "seq_codons(s STRING)": ("ARRAY<STRING>", "regexp_extract_all(s, '(.{3})', 1)"),
    "seq_hash(s STRING)": ("STRING", "substring(sha2(upper(s), 256), 1, 16)"),
}


class Frames:
    """``seq_frames(id, s, least)``: the reading frames of a DNA text: every start codon to the next stop in its frame, or the end."""

    def eval(self, s: str, least: int) -> Iterator[tuple]:
        for strand, t in (("+", s or ""), ("-", (s or "").translate(str.maketrans("ATGCN", "TACGN"))[::-1])):
            n = len(t)
            for frame in range(3):
                stop = None
                found = []
                for i in range(n - 3 - (n - 3 - frame) % 3 if n >= frame + 3 else -1, -1, -3):
                    codon = t[i : i + 3]
                    if codon in ("TAA", "TAG", "TGA"):
                        stop = i
                    elif codon == "ATG":
                        end = n if stop is None else stop + 3
                        if end - i >= least:
                            start = (i + 1, end) if strand == "+" else (n - end + 1, n - i)
                            found.append((f"{strand}{frame + 1}", *start, end - i, stop is not None))
                yield from reversed(found)


class Repeats:
    """``seq_repeats(s, least)``: tandem repeats of units of two to four letters, greedy from left to right for each size of unit."""

    def eval(self, s: str, least: int) -> Iterator[tuple]:
        t = s or ""
        for size in (2, 3, 4):
            at = 0
            while at + size * least <= len(t):
                n = 1
                while t[at + n * size : at + (n + 1) * size] == t[at : at + size]:
                    n += 1
                if n >= least:
                    yield t[at : at + size], at + 1, n
                at += n * size if n >= least else 1


def register(spark: SparkSession) -> None:
    """§2.15: Registers all functions with the session, replacing what they are called."""
    for head, (kind, body) in SCALAR.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    shape = "a string, b string, score int"

    def solved(solve, kind: str):
        @F.pandas_udf(shape)
        def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
            ok = a.notna() & b.notna()
            done = iter(solve(a[ok].tolist(), b[ok].tolist(), kind))
            return pd.DataFrame([next(done)[:3] if good else (None, None, None) for good in ok], columns=["a", "b", "score"])

        return run

    for name, solve in (("seq_align", align.align_global), ("seq_align_local", align.align_local)):
        for kind in ("dna", "protein"):
            spark.udf.register(name if kind == "dna" else f"{name}_protein", solved(solve, kind))
    codons = {k: v for k, v in schema.CODONS.items()}

    @F.pandas_udf("string")
    def translate(s: pd.Series) -> pd.Series:
        """The protein of frame 0 up to its first stop; unknown codons as ``?``."""
        return s.map(lambda t: None if t is None else "".join(codons.get(t[i : i + 3], "?") for i in range(0, len(t) - 2, 3)).partition("*")[0])

    spark.udf.register("seq_translate", translate)
    spark.udtf.register("seq_frames", F.udtf(Frames, returnType="frame string, start bigint, `end` bigint, n bigint, complete boolean"))
    spark.udtf.register("seq_repeats", F.udtf(Repeats, returnType="unit string, start bigint, n bigint"))
