"""Texts that end because they were cut.

Two kinds of evidence are combined.  Lengths: per source the natural lengths
follow a log-normal law, right-censored at the source's limits; limits show
as lengths far more frequent than their neighbours and than the law, whose
excess breaks off, and the law's odds there are the prior of each text.
Endings: a message whose structure is left open was cut for certain;
otherwise a linear model of the last line tells how much likelier the ending
is in a text cut anywhere than in a whole one.  The model is fitted without
labels: whole texts are the parts of messages whose last boundary arrived,
cut texts are the same parts cut at random.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixspark.llm import mail
from helixspark.session import checkpoint

#: Bound on the messages that the model of endings is fitted on.
MOST_SAMPLED = 4000
#: Longest message that may be among them; all texts are judged, whatever their length.
MOST_SAMPLED_CHARS = 20_000
CUTS_EACH = 4
SIZE = 1 << 15
#: Share of texts that a broken transfer cuts, before any evidence.
PRIOR = 0.03
#: Log-odds given to a structure left open.
CERTAIN = 50.0
_QUOTE = re.compile(r"^(?:[ \t]*[>|])+[ \t]?")
_MAIL_NAMES = {"from", "to", "subject", "date", "message-id", "received", "content-type", "mime-version", "references", "in-reply-to", "ticket", "list-id"}


def _token(word: str) -> str:
    if "@" in word:
        return "@" if re.fullmatch(r"<?[\w.+-]+@[\w-]+(\.[\w-]+)*\.[a-z]{3,}>?[.,;]?", word) else "@?"
    return re.sub(r"\d", "0", word)


def features(text: str, known: set[str] | None) -> list[str]:
    """Descriptions of how a text ends: its last line's form, words and letters, and the line before."""
    lines = text.rstrip().split("\n")
    last = _QUOTE.sub("", lines[-1]).strip()
    before = _QUOTE.sub("", lines[-2]).strip() if len(lines) > 1 else "^"
    quoted = bool(_QUOTE.match(lines[-1]))
    tokens = [_token(w) for w in last.split()]
    end = tokens[-1] if tokens else ""
    masked = " ".join(tokens)
    bare = re.sub(r"[^\w]+$", "", end).lower()
    form = "".join("A" if w[0].isupper() else "0" if w[0].isdigit() or w[0] in "0#+(" else "a" if w[0].isalpha() else "." for w in tokens[-6:] if w)
    kind = "w" if end[-1:].isalpha() else "0" if end[-1:].isdigit() else end[-1:]
    whole = "-" if known is None else "k" if bare in known else "n"
    few = min(len(tokens), 7)
    out = ["b", f"k{kind}", f"n{few}", f"w{whole}", f"wk{whole}{kind}", f"wn{whole}{few}", f"kn{kind}{few}", f"F{form}", f"FK{form}{kind}{whole}", f"M{masked}", f"E{end}", f"q{quoted}{kind}"]
    size = min(len(text.strip()) // 5, 8)
    out += [f"T{size}", f"T{size}{len(lines) > 1}", f"TM{size}{masked}"]
    out += [f"s{n}{end[-n:]}" for n in range(1, 5)]
    out += [f"p{before[-1:]}", f"pk{before[-1:]}{kind}{few}{whole}", f"P{_token(before[-12:])}"]
    out += [f"Z{' '.join(tokens[-2:])}", f"L{len(last) // 8}{kind}", f"1{tokens[0] if tokens else ''}{few}"]
    return out


def _codes(names: list[str]) -> list[int]:
    return [zlib.crc32(n.encode("utf-8", "replace")) % SIZE for n in names]


def structure(message: mail.Message) -> bool | None:
    """True: left open, so cut.  False: closed, so whole.  None: the structure doesn't tell."""
    if not message.headers_end and _MAIL_NAMES & set(message.headers):
        return True
    if not message.closed:
        return True
    if len(message.parts) != 1 or message.headers.get("content-type", "").lower().startswith("multipart"):
        return False
    part = message.parts[0]
    if part.body.rstrip().endswith("\ufffd"):
        return True  # half a character
    if part.encoding == "base64" and len(re.sub(r"\s", "", part.body)) % 4:
        return True
    if part.encoding == "quoted-printable" and re.search(r"=[0-9A-F]?\s*\Z", part.body):
        return True
    if part.kind == "text/html":
        return not re.search(r"</html\s*>\s*\Z", mail.decode(part), re.I)
    return None


def last_text(message: mail.Message) -> str:
    texts = [p for p in message.parts if p.kind.startswith("text/") or not p.kind]
    if not texts:
        return ""
    body = mail.decode(texts[-1])
    return mail.unmarked(body) if texts[-1].kind == "text/html" else body


class EndingModel:
    """Log-likelihood ratio of an ending: cut anywhere against whole."""

    def __init__(self, weights: np.ndarray, known: set[str]):
        self.weights, self.known = weights, known

    def ratio(self, text: str) -> float:
        return float(self.weights[_codes(features(text, self.known))].sum())


def fit_endings(texts: list[str], seed: int = 11, rounds: int = 12) -> EndingModel:
    """Logistic regression over hashed features, by averaged mini-batch steps.  Without texts every ratio is 0."""
    rng = np.random.default_rng(seed)
    texts = [t for t in texts if t.strip()]
    counts: dict[str, int] = {}
    for t in texts:
        for line in t.split("\n"):
            for w in _QUOTE.sub("", line).split()[:-1]:
                w = re.sub(r"[^\w]+$", "", _token(w)).lower()
                counts[w] = counts.get(w, 0) + 1
    known = {w for w, n in counts.items() if n >= 3}
    rows, labels = [], []
    for t in texts:
        rows.append(_codes(features(t, known)))
        labels.append(0.0)
        for at in rng.integers(1, len(t) + 1, CUTS_EACH):
            if t[:at].strip() and t[at:].strip():
                rows.append(_codes(features(t[:at], known)))
                labels.append(1.0)
    weights = np.zeros(SIZE)
    if not rows:
        return EndingModel(weights, known)
    x, y = np.array(rows), np.array(labels)
    share = y.mean()
    bias = np.log(share / (1 - share))
    total, speed = np.zeros(SIZE), np.full(SIZE, 1e-3)
    for r in range(rounds):
        order = rng.permutation(len(y))
        for i in range(0, len(y), 256):
            b = order[i : i + 256]
            p = 1 / (1 + np.exp(-(weights[x[b]].sum(1) + bias)))
            g = np.zeros(SIZE)
            np.add.at(g, x[b].ravel(), np.repeat(p - y[b], x.shape[1]))
            g = g / len(b) + 2e-5 * weights
            speed += g * g
            weights = weights - 0.1 * g / np.sqrt(speed)
        if r >= rounds // 2:
            total += weights
    return EndingModel(total / (rounds - rounds // 2), known)


def _sample(documents: DataFrame, most: int) -> list[str]:
    """Whole texts: the text parts of at most ``most`` closed multipart messages, chosen by a hash of their id."""
    multi = documents.where((F.length("text") <= MOST_SAMPLED_CHARS) & F.col("text").rlike(r"(?i)content-type:\s*multipart/")).select("doc_id", "text")
    # a share of the hashes is cut off where the rows are read, so tasks send about as many rows as are wanted, however many there are
    share = min(1.0, 1.2 * most / max(multi.count(), 1))
    h = F.xxhash64("doc_id")
    rows = multi.where(F.pmod(h, F.lit(1 << 40)) < int(share * (1 << 40))).orderBy(h, "doc_id").limit(most).collect()
    out = []
    for r in rows:
        message = mail.parse(r["text"])
        if message.closed and message.headers_end:
            for part in message.parts:
                if part.kind in ("text/plain", "text/html"):
                    body = mail.decode(part)
                    out.append(mail.unmarked(body) if part.kind == "text/html" else body)
    return out


def endings(documents: DataFrame, most: int = MOST_SAMPLED) -> DataFrame:
    """``(doc_id, source, n_chars, n_bytes, ratio)`` of each text that isn't empty; ``ratio`` is plus or minus ``CERTAIN`` where the structure tells."""
    model = fit_endings(_sample(documents, most))
    shared = documents.sparkSession.sparkContext.broadcast((model.weights, model.known))

    @F.pandas_udf("double")
    def ratio(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = EndingModel(*shared.value)
        for texts in batches:
            out = []
            for t in texts:
                message = mail.parse(t)
                told = structure(message)
                out.append(model.ratio(last_text(message)) if told is None else CERTAIN if told else -CERTAIN)
            yield pd.Series(out)

    text = documents.where(F.col("text").isNotNull() & (F.trim("text") != ""))
    return text.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.length("text").alias("n_chars"), F.octet_length("text").alias("n_bytes"), ratio("text").alias("ratio"))


def _censored_law(free: pd.DataFrame, spikes: pd.DataFrame) -> tuple[float, float]:
    """Mean and deviation of the log lengths by maximum likelihood; a text at a spike is at least that long."""
    from math import erf, exp, pi, sqrt

    n = float(free["n"].sum())
    mean = float((free["n"] * free["log"]).sum() / n) if n else 0.0
    var = float((free["n"] * (free["log"] - mean) ** 2).sum() / n) if n else 1.0
    s1, s2 = mean * n, (var + mean * mean) * n
    for _ in range(50):  # expectation-maximisation: a censored text counts with its expected length
        sd, a1, a2, m = sqrt(max(var, 1e-4)), s1, s2, n
        for log_len, count in zip(spikes["log"], spikes["n"], strict=True):
            z = (log_len - mean) / sd
            tail = max(0.5 * (1 - erf(z / sqrt(2))), 1e-12)
            hazard = exp(-z * z / 2) / sqrt(2 * pi) / tail
            first = mean + sd * hazard
            a1, a2, m = a1 + count * first, a2 + count * (mean * mean + sd * sd + sd * hazard * (log_len + mean)), m + count
        mean, var = a1 / m, max(a2 / m - (a1 / m) ** 2, 1e-4)
    return mean, sqrt(var)


def _fit_law(group: pd.DataFrame) -> pd.DataFrame:
    """Limits of one source and unit with the log-odds of a cut there: texts beyond the law's expectation against those it expects.

    The law is right-censored at its limits.  A spike that the law explains,
    or whose excess over it doesn't break off, is no limit; its texts then
    count with the length they have, and the law is fitted again.
    """
    held = group["spike"].to_numpy()
    while True:
        spikes = group[held]
        mean, sd = _censored_law(group[~held], spikes)
        n, size = spikes["n"].to_numpy(float), np.maximum(spikes["size"].to_numpy(float), 1)
        density = np.exp(-(((spikes["log"].to_numpy(float) - mean) / sd) ** 2) / 2) / (sd * np.sqrt(2 * np.pi) * size)
        expected = np.maximum(float(group["n"].sum()) * density, 0.5)
        excess = n - expected
        kept = (excess > 6 * np.sqrt(expected) + 3) & (spikes["broken"].to_numpy(float) > 0.5 * excess)
        if kept.all():
            break
        held = held.copy()
        held[held] = kept
    return spikes.assign(log_odds=np.log(excess / expected))[["source", "unit", "size", "log_odds"]]


def limits(found: DataFrame, least_rows: int = 5) -> DataFrame:
    """``(source, unit, size, log_odds)``: the length limits of each source with the odds that a text of that length was cut.

    Candidates are lengths, in characters or bytes, that exceed their
    neighbours' frequency by six standard deviations.  A limit exceeds the
    source's fitted law by as much, and most texts of that excess end as if
    cut.  Work is per distinct length, not per text.
    """
    sized = found.select("source", "ratio", F.explode(F.create_map(F.lit("chars"), "n_chars", F.lit("bytes"), "n_bytes")).alias("unit", "size"))
    counts = sized.groupBy("source", "unit", "size").agg(F.count("*").alias("n"), F.count_if(F.col("ratio") > 0).alias("broken"))
    near = Window.partitionBy("source", "unit").orderBy("size").rangeBetween(-60, 60)
    around = (F.sum("n").over(near) - F.col("n")) / 120
    spike = (F.col("n") >= least_rows) & (F.col("n") > around + 6 * F.sqrt(around) + 3) & (F.col("broken") > 0)
    marked = counts.withColumn("spike", spike).withColumn("log", F.log(F.greatest("size", F.lit(1))))
    # the law needs lengths only up to a log-bin, so a group stays a few thousand rows however long texts are
    binned = marked.groupBy("source", "unit", "spike", F.when(F.col("spike"), F.col("size")).otherwise(-F.floor(F.col("log") * 200)).alias("bin"))
    binned = binned.agg(F.sum("n").alias("n"), F.sum("broken").alias("broken"), (F.sum(F.col("n") * F.col("log")) / F.sum("n")).alias("log"), F.max("size").alias("size")).drop("bin")
    with_spike = binned.join(marked.where("spike").select("source", "unit").distinct(), ["source", "unit"], "left_semi")
    return with_spike.groupBy("source", "unit").applyInPandas(_fit_law, "source string, unit string, size bigint, log_odds double")


def truncated(documents: DataFrame, most: int = MOST_SAMPLED) -> DataFrame:
    """``(doc_id, source, log_odds, cut)`` of every text that isn't null or blank.

    A text is cut when its posterior log-odds are positive.  Null, empty and
    blank texts are whole and give no row; a null source is the source ''.
    """
    found = checkpoint(endings(documents, most))  # a few numbers per text, read twice
    known = limits(found)
    by = {u: known.where(F.col("unit") == u).select("source", F.col("size").alias(c), F.col("log_odds").alias(f"_{u}")) for u, c in (("chars", "n_chars"), ("bytes", "n_bytes"))}
    joined = found.join(by["chars"], ["source", "n_chars"], "left").join(by["bytes"], ["source", "n_bytes"], "left")
    prior = F.greatest(F.coalesce("_chars", F.lit(-99.0)), F.coalesce("_bytes", F.lit(-99.0)), F.lit(float(np.log(PRIOR / (1 - PRIOR)))))
    odds = prior + F.col("ratio")
    return joined.select("doc_id", "source", odds.alias("log_odds"), (odds > 0).alias("cut"))


def rates(judged: DataFrame) -> DataFrame:
    """``(source, n_texts, n_cut, rate)``."""
    n, cut = F.count("*"), F.count_if("cut")
    return judged.groupBy("source").agg(n.alias("n_texts"), cut.alias("n_cut"), (cut / n).alias("rate"))
