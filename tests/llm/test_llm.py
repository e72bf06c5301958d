import random
from collections import Counter, defaultdict
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixspark.llm import contamination, mail, organisms, packing, queries, spans, survivor, truncation

# ---- survivorship

SOURCES = [("uniprot", 1, "UniProt"), ("ncbi", 3, "NCBI"), ("geo", 7, "GEO")]
GENE = "id bigint, gene_id string, symbol string, source string, date_added timestamp, description string, annotations string, external_links map<string,string>, value string, field_name string"


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame(SOURCES, "source string, trust_rank int, label string")


def gene(i, key, source, day, description=None, annotations=None, links=None):
    return (i, key, None, source, None if day is None else datetime(2020, 1, day), description, annotations, links, "clash", "clash")


def test_survivors(spark, sources):
    rows = [
        gene(1, "a", "ncbi", 9, "ncbi text", '{"x": [], "y": false, "z": "n/a"}', {"doi": "1", "k": None}),
        gene(2, " A ", " UniProt ", 1, "Unknown", '{"x": {"q": 1}, "z": null}', {"doi": " "}),
        gene(3, "a", "UNIPROT", None, "-", '"{\\"y\\": 0}"', None),
        gene(4, "a", "nobody", 20, "other", "no json", {"k": "v"}),
        gene(5, "b", "ncbi", 1, "alone"), gene(6, None, "ncbi", 1, "no key"),
        gene(7, "c", "geo", 5, "tie"), gene(8, "c", "GEO", 5, "tie"),
    ]
    df = spark.createDataFrame(rows, GENE)
    got = {tuple(r) for r in survivor.survivors(df, sources).collect()}
    assert got == {("A", "description", 1), ("A", "annotations.x", 2), ("A", "annotations.y", 3), ("A", "external_links.doi", 1), ("A", "external_links.k", 4), ("C", "description", 8)}
    assert survivor.survivors(df.limit(0), sources).count() == 0
    records = {r["gene_key"]: r for r in survivor.golden_records(df, sources).collect()}
    assert set(records) == {"A", "C"} and records["C"]["description"] == "tie" and records["A"]["external_links"] == {"doi": "1", "k": "v"}
    assert records["A"]["description"] in ("ncbi text", "other") and set(records["A"]["annotations"]) == {"x", "y"}
    assert survivor.golden_records(df.limit(0), sources).count() == 0 and survivor.source_quality(df.limit(0), sources).count() == 0


def test_dots_in_names_and_sources_of_one_rank(spark):
    sources = spark.createDataFrame([("one", 1, "One"), ("two", 1, "Two")], "source string, trust_rank int, label string")
    df = spark.createDataFrame([gene(1, "a", "one", 1, None, '{"a.x": 1, "b.x": 2}'), gene(2, "a", "two", 1, None, '{"a.x": 3}')], GENE)
    record = survivor.golden_records(df, sources).first()
    assert record["annotations"] == {"a.x": "3", "b.x": "2"}
    assert {r["source"] for r in survivor.source_quality(df, sources).collect()} == {"one", "two", "(not listed)"}


def test_em_finds_the_good_sources(spark):
    """Planted truth: a single-valued field and a multi-valued one, two good sources, a middling and a bad one, and one that isn't listed."""
    rng = random.Random(1)
    quality = {"uniprot": 0.95, "ncbi": 0.55, "geo": 0.9, "nobody": 0.3}
    rows, truth, i = [], {}, 0
    for k in range(1500):
        true = rng.randrange(6)
        terms = {f"t{n}" for n in rng.sample(range(30), 3)}
        truth[f"K{k}"] = (f"text {true}", terms)
        for source, q in quality.items():
            if source == "uniprot" and k % 10:
                continue  # the best source is rare, and most fields of a source are its own
            text = f"text {true if rng.random() < q else rng.randrange(6)}"
            said = {t for t in terms if rng.random() < q} | {f"t{n}" for n in range(30) if rng.random() < (1 - q) / 12}
            rows.append((i, f"k{k}", None, source, datetime(2020, 1, 1), text, '{"terms": [' + ", ".join(f'"{t}"' for t in sorted(said)) + "]}", None, "", ""))
            i += 1
    rows += [(10**6 + n, f"lone{n}", None, "ncbi", datetime(2020, 1, 1), "alone", None, None, "", "") for n in range(6000)]
    df = spark.createDataFrame(rows, GENE)
    listed = spark.createDataFrame(SOURCES, "source string, trust_rank int, label string")
    found = {(r["kind"], r["source"]): (r["sensitivity"], r["specificity"]) for r in survivor.source_quality(df, listed).collect()}
    for kind in ("description", "annotations"):
        sens = {s: found[kind, s][0] for s in ("uniprot", "ncbi", "geo", "(not listed)")}
        assert sens["uniprot"] > sens["ncbi"] > sens["(not listed)"] and sens["geo"] > sens["ncbi"]
        spec = {s: found[kind, s][1] for s in sens}
        assert min(spec["uniprot"], spec["geo"]) > 0.5
    records = {r["gene_key"]: r for r in survivor.golden_records(df, listed).collect()}
    right = sum(records[k]["description"] == t for k, (t, _) in truth.items())
    by_rank = Counter()
    for r in rows:
        if r[1].startswith("k") and r[3] == ("uniprot" if int(r[1][1:]) % 10 == 0 else "ncbi"):
            by_rank[truth[r[1].upper()][0] == r[5]] += 1
    assert right > 0.85 * len(truth) and right > by_rank[True] * 1.2, (right, by_rank)
    import json

    hit = sum(len(set(json.loads(records[k]["annotations"]["terms"])) & t) for k, (_, t) in truth.items() if "terms" in records[k]["annotations"])
    kept = sum(len(json.loads(records[k]["annotations"]["terms"])) for k in truth if "terms" in records[k]["annotations"])
    assert hit > 0.75 * 3 * len(truth) and hit > 0.6 * kept, (hit, kept)


def test_latent_truth(spark, sources):
    rows = [gene(i, f"k{i // 2}", "ncbi" if i % 2 else "uniprot", 1, None, '{"words": ["same", "same", "n/a"]}' if i % 2 else '{"words": ["same"]}') for i in range(200)]
    got = survivor.latent_truth(spark.createDataFrame(rows, GENE), sources)
    assert {(r["value"], r["accepted"]) for r in got.collect()} == {("same", True)} and got.count() == 100


# ---- organisms

SPECIES = [(1, "Alpa bravos", "Red bean"), (2, "Alpa cetris", "Blue bean"), (3, "Dorna bravos", "Green leek"), (4, "Delta cetris", None)]


@pytest.mark.parametrize("text, want", [
    ("ALPA BRAVOS", 1), ("A. bravos", 1), ("a.cetris", 2), ("bravos, Alpa", 1), ("Red bean (Alpa bravos)", 1), ("alpa_cetris", 2), ("Alpa bravos cv. Rot", 1), ("Alpa bravso", 1), ("Alpa brvos", 1),
    ("Alpa", -1), ("Alpa sp. 3", -1), ("Alpa zendris", -1), ("Zetta bravos", -1), ("Alpa bravos x Dorna bravos", -1), ("D. bravos", 3), ("blue bean", 2), ("Alpa bravos / Red bean", 1), ("see notes", -1), ("", -1), ("Alpa bravos " * 20000, 1), ("x" * 100_000, -1),
])
def test_matcher(text, want):
    assert organisms.Matcher(SPECIES)(text) == want


def test_matcher_ambiguous_abbreviation():
    assert organisms.Matcher([*SPECIES, (5, "Arta bravos", None)])("A. bravos") == -1
    assert organisms.Matcher([])("x") == -1


def test_map_values(spark):
    df = spark.createDataFrame([(1, "alpa bravos", 9), (2, None, 9), (3, "  ", 9), (4, "zzz", 9), (4, "zzz", 9)], "id bigint, organism string, species_id int")
    species = spark.createDataFrame(SPECIES, "species_id int, name string, common string")
    got = organisms.map_values(df, "organism", species, "species_id", ("name", "common"), ["id"])
    assert Counter((r["id"], r["species_id"]) for r in got.collect()) == {(1, 1): 1, (4, -1): 2}
    assert {r["n_rows"] for r in organisms.report(got, "organism", "species_id").collect()} == {1, 2}
    assert organisms.map_values(df.limit(0), "organism", species, "species_id", ("name", "common"), ["id"]).count() == 0


# ---- shared spans


def brute_pairs(rows, least):
    where = defaultdict(set)
    for i, k, s in rows:
        if k is not None and s is not None:
            for j in range(len(s) - least + 1):
                where[s[j : j + least]].add((i, k))
    return {(min(a, b), max(a, b)) for v in where.values() for a, x in v for b, y in v if a != b and x != y}


@pytest.mark.parametrize("hot", [64, 1])
def test_spans(spark, hot):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    shared, tail = word(64), "A" * 90
    rows = [(1, "a", word(30) + shared + word(50)), (2, "b", shared), (3, "b", word(5) + shared[:63]), (4, "c", word(80) + shared), (5, None, shared), (6, "d", None), (7, "d", ""), (8, "e", shared[:40] + word(10) + shared[40:])]
    rows += [(20 + i, f"t{i}", word(70) + tail[: 40 + 10 * i]) for i in range(6)] + [(40, "x", shared), (41, "y", shared), (42, "a", shared), (43, "z", (word(3) + shared) * 3), (44, "AB", "AB" * 60), (45, "BA", "BA" * 50)]
    df = spark.createDataFrame([(i, k, s, 0, 0) for i, k, s in rows], "id bigint, key string, text string, cid int, pos int")
    found = spans.SharedSpans(df, hot=hot)
    got = [tuple(r) for r in found.pairs().collect()]
    assert set(got) == brute_pairs(rows, 64) and len(got) == len(set(got))
    keys = defaultdict(set)
    for _, k, s in rows:
        for j in range(len(s or "") - 63):
            keys[s[j : j + 64]] |= {k} - {None}
    want = {}
    for i, k, s in rows:
        if k is not None and len(s or "") >= 64:
            covered = {p for j in range(len(s) - 63) if len(keys[s[j : j + 64]]) > 1 for p in range(j, j + 64)}
            want[i] = (len(s), len(covered))
    assert {r["id"]: (r["n_letters"], r["n_shared"]) for r in found.shares().collect()} == want
    # maximal repeats, by brute force along every diagonal
    text = {r["cid"]: r["text"] for r in found.texts.collect()}
    under = defaultdict(set)
    for _, k, s in rows:
        if k is not None and s in text.values():
            under[s].add(k)
    repeats = set()
    for a, x in text.items():
        for b, y in text.items():
            if a < b and len(under[x] | under[y]) > 1:
                for d in range(-len(y) + 1, len(x)):
                    n = 0
                    for i in range(max(0, d), min(len(x), len(y) + d) + 1):
                        if i < len(x) and i - d < len(y) and x[i] == y[i - d]:
                            n += 1
                        else:
                            if n >= 64:
                                repeats.add((a, i - n, b, i - n - d, n))
                            n = 0
    got = [tuple(r) for r in found.repeats().collect()]
    assert set(got) == repeats and len(got) == len(repeats)
    assert {(r["cid_a"], r["cid_b"]): (r["n_repeats"], r["longest"]) for r in found.links().collect()} == {
        p: (len(ns), max(ns)) for p, ns in {(a, b): [n for c, _, e, _, n in repeats if (c, e) == (a, b)] for a, _, b, _, _ in repeats}.items()}


def test_spans_empty(spark):
    none = spark.createDataFrame([], "id bigint, key string, text string")
    assert spans.SharedSpans(none).pairs().count() == 0 and spans.SharedSpans(none).shares().count() == 0


# ---- packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(-1, 3), st.integers(0, 2)), max_size=60), st.integers(0, 1))
def test_best_fit(items, per_source):
    items = sorted(items, reverse=True)
    sizes, clusters, sources = ([x[i] for x in items] for i in range(3))
    at = packing.best_fit(sizes, clusters, sources, 50, per_source)
    bins = defaultdict(list)
    for item, b in zip(items, at, strict=True):
        bins[b].append(item)
    for held in bins.values():
        assert sum(x[0] for x in held) <= 50
        known = [x[1] for x in held if x[1] >= 0]
        assert len(known) == len(set(known))
        if per_source:
            assert len({x[2] for x in held}) == len(held)
    # tightest compatible: an item opens a container only if no earlier one could take it
    seen: dict[int, list] = {}
    for item, b in zip(items, at, strict=True):
        if b not in seen:
            for held in seen.values():
                assert sum(x[0] for x in held) + item[0] > 50 or (item[1] >= 0 and item[1] in [x[1] for x in held]) or (per_source and item[2] in [x[2] for x in held]) or sum(x[0] for x in held) == 50
        seen.setdefault(b, []).append(item)


def test_pack(spark):
    rng = random.Random(4)
    rows = [(i, "s" if i % 3 else None, 7 if i % 3 == 0 else 1000 + i, rng.randint(0, 90)) for i in range(400)] + [(1000, "s", 5, 250), (1001, "s", 6, 100), (1002, "s", 8, 300)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, source string, cluster bigint, n_tokens int, container string")
    out = packing.pack(df, capacity=100, shard=150).collect()
    total, bins = defaultdict(int), defaultdict(list)
    size, cluster = {r[0]: r[3] for r in rows}, {r[0]: r[2] for r in rows}
    for r in out:
        total[r["doc_id"]] += r["n_tokens"]
        bins[r["container"]].append(r)
    assert total == {k: v for k, v in size.items()}
    assert all(sum(r["n_tokens"] for r in b) <= 100 for b in bins.values())
    assert all(len({cluster[r["doc_id"]] for r in b}) == len(b) for b in bins.values())
    pieces = Counter(r["doc_id"] for r in out)
    assert {k: n for k, n in pieces.items() if n > 1} == {1000: 3, 1002: 3}
    assert packing.pack(df.limit(0), capacity=100).count() == 0


def test_places_per_source():
    sizes, sources = [9] * 5 + [1] * 12, [0, 0, 0, 1, 1] + [0] * 9 + [1] * 3
    at = packing.best_fit(sizes, [-1] * 17, sources, 50, 3)
    held = Counter(zip(at, sources, strict=True))
    assert max(held.values()) == 3 and len(set(at)) == 4


def test_packed_query_bounds_sources(spark, tmp_path):
    rows = [(i, "one" if i % 4 else "two", f"message {i}") for i in range(80)]
    spark.createDataFrame(rows, "doc_id bigint, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    source = {i: s for i, s, _ in rows}
    held = Counter((r["container"], source[r["doc_id"]]) for r in queries.p8_packed(spark, str(tmp_path)).collect())
    assert sum(held.values()) == 80 and max(held.values()) == packing.PER_SOURCE


def test_tokens(spark):
    count = packing.token_counter()
    assert count("") == 0 and count("hello world") == 2 and count("<|endoftext|>") > 1 and count("a" * 100_000) > 1000
    import public_tokenizers

    text = "It's 12 o'clock — déjà vu\n\n  x\t we'll "
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert count(text) == len(other.encode(text, add_special_tokens=False).ids)
    df = spark.createDataFrame([(1, "hello world", None), (2, "", "s"), (3, None, "s"), (4, " hello\nworld ", "s")], "doc_id bigint, text string, source string")
    got = {r["doc_id"]: (r["n_tokens"], r["cluster"]) for r in packing.sized(df).collect()}
    assert set(got) == {1, 2, 4} and got[1][0] == 2 and got[2][0] == 0 and got[1][1] == got[4][1]


# ---- mail and contamination

ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen"
W = ITEM.split()


def mime(encoding, body, kind="text/plain"):
    return f"From: a@b.test\nContent-Type: multipart/mixed; boundary=\"=_x\"\n\npreamble\n--=_x\nContent-Type: {kind}; charset=utf-8\nContent-Transfer-Encoding: {encoding}\n\n{body}\n--=_x\nContent-Type: application/octet-stream\nContent-Transfer-Encoding: base64\n\nAAAA\n--=_x--\n"


def test_mail():
    import base64

    assert mail.seen("plain text") == ["plain text"] and mail.seen("") == [""]
    assert mail.seen("Subject: x\n\nbody") == ["body"]
    assert mail.seen(mime("quoted-printable", "caf=C3=A9 so=\nft")) == ["café soft"]
    assert mail.seen(mime("base64", base64.b64encode("Grüße".encode()).decode())) == ["Grüße"]
    assert mail.seen(mime("base64", base64.b64encode(b"whole text").decode()[:-3]))[0].startswith("whole te")
    assert mail.words(mail.seen(mime("7bit", "<html><style>p{x}</style><p>A<b>B</b>&nbsp;c</p><br/>d&gt;</html>", "text/html"))[0]) == ["ab", "c", "d"]
    message = mail.parse(mime("7bit", "x")[:-6])
    assert not message.closed and mail.parse(mime("7bit", "x")).closed
    nested_part = mime("7bit", "--=_y\n\ninner\n--=_y--", "multipart/alternative; boundary==_y")
    assert [t.strip() for t in mail.seen(nested_part)] == ["inner"]
    deep = "innermost"
    for i in range(60):
        deep = f"Content-Type: multipart/mixed; boundary=b{i}\n\n--b{i}\n{deep if i else 'Content-Type: text/plain' + chr(10) * 2 + deep}\n--b{i}--\n"
    assert [t.strip() for t in mail.seen(deep)] == ["innermost"] and mail.parse(deep).closed
    sent = base64.b64encode(b"forwarded words").decode()
    inner = f"Subject: fw\nContent-Type: text/plain\nContent-Transfer-Encoding: base64\n\n{sent}"
    for encoding, body in (("7bit", inner), ("base64", base64.b64encode(inner.encode()).decode())):
        assert [t.strip() for t in mail.seen(mime(encoding, body, "message/rfc822"))] == ["forwarded words"]
        assert [t.strip() for t in mail.seen(mime(encoding, mime("7bit", body, "message/rfc822") if encoding == "7bit" else body, "message/rfc822"))] == ["forwarded words"]
    assert mail.seen(mime("7bit", "no headers here", "message/rfc822")) == ["no headers here"]


def test_items_in_scripts_without_blanks_count_by_bytes(spark, monkeypatch):
    """Few words by white space, many bytes: joined, not sent to the tasks."""
    items = spark.createDataFrame([(1, "語" * 4000 + " " + ITEM)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "x " + ITEM)], "doc_id bigint, text string")
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", None)
    assert [tuple(r) for r in contamination.leaks(docs, items, most_bytes=10_000).collect()] == [(1, 1)]


@pytest.mark.parametrize("most", [contamination.MOST_BYTES, 0])
def test_leaks(spark, most):
    texts = [
        ITEM, " ".join(W[:12]), " ".join(W[:11]), "> " + "\n> | ".join(W).upper(), ", ".join(W[1:13]) + "!", " ".join(W[:6]) + " and " + " ".join(W[6:]), None, "", "x " * 3000 + ITEM + " y" * 3000,
        mime("quoted-printable", "=\n".join(" ".join(W)[i : i + 9] for i in range(0, 80, 9))), mime("7bit", "<p>" + "<br>".join(W) + "</p>", "text/html"), ITEM,
    ]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(1, ITEM, "s", "t"), (2, " ".join(W[:11]), "s", "t"), (3, None, "s", "t"), (4, ITEM, "s", "t"), (5, "", "s", "t")], "item_id bigint, text string, suite string, split_name string")
    got = [tuple(r) for r in contamination.leaks(docs, items, most_bytes=most).collect()]
    assert set(got) == {(d, i) for d in (0, 1, 3, 4, 8, 9, 10, 11) for i in (1, 4)} and len(got) == len(set(got))
    assert contamination.leaks(docs.limit(0), items, most_bytes=most).count() == 0 and contamination.leaks(docs, items.limit(0), most_bytes=most).count() == 0
    counts = {r["item_id"]: r["n_docs"] for r in contamination.leaked_items(contamination.leaks(docs, items, most_bytes=most), items).collect()}
    assert counts == {1: 8, 2: 0, 3: 0, 4: 8, 5: 0}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=12, max_size=40), st.integers(0, 20))
def test_winnowing_keeps_every_long_span(words, shift):
    """Any twelve consecutive words in common leave a fingerprint in common."""
    hashes = contamination._Hashes()
    a = contamination.word_hashes([" ".join(words)], hashes)
    b = contamination.word_hashes([" ".join(["q"] * shift + words[:12] + ["r"] * 9)], hashes)
    n, _, h = contamination._fingerprints([a, b])
    assert set(h[n == 0]) & set(h[n == 1])


# ---- truncation

SENTENCES = ["The old pump needs a new seal before winter", "Our second team counted every tray in the north bay", "Nobody has signed the list for the cold room yet", "A courier brought the missing labels on Thursday morning"]
NAMES = ["Ada Brook", "Ben Carter", "Cleo Dunn", "Dan Ellis"]


def letters(rng, n):
    return [f"Dear {rng.choice(NAMES)},\n\n" + "\n".join(f"{rng.choice(SENTENCES)} {rng.randint(1, 99)} times." for _ in range(rng.randint(2, 25))) + f"\n\nRegards,\n{rng.choice(NAMES)}\n" for _ in range(n)]


def test_truncation(spark):
    rng = random.Random(8)
    whole, rows, cut = letters(rng, 900), [], set()
    for i, t in enumerate(letters(rng, 300)):
        rows.append((i, mime("7bit", t), "mime"))
    for i, t in enumerate(whole):
        source = ("limited", "open")[i % 2]
        if source == "limited" and len(t) > 800:
            t, _ = t[:800], cut.add(1000 + i)
        elif i % 20 == 1:
            at = t.rfind(" times.") - 3 if rng.random() < 0.5 else rng.randint(60, len(t) - 40)
            t = t[:at].rstrip() if t[:at].rstrip()[-1] not in ".," else t[: at - 4]
            if t.rstrip()[-1] not in ".,":
                cut.add(1000 + i)
        rows.append((1000 + i, t, source))
    rows += [(5000, None, "open"), (5001, "", "open"), (5002, "  ", None), (5003, mime("7bit", whole[0])[:-40], "mime"), (5004, "Subject: half a head", "open")]
    cut |= {5003, 5004}
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, source string, cut int")
    judged = truncation.truncated(df)
    found = {r["doc_id"] for r in judged.where("cut").collect()}
    assert len(found & cut) >= 0.95 * len(cut) and len(found & cut) >= 0.95 * len(found)
    assert {5003, 5004} <= found and not found & {5000, 5001, 5002}
    rates = {r["source"]: r["rate"] for r in truncation.rates(judged).collect()}
    assert rates["limited"] > 0.4 and rates["open"] < 0.3 and rates["mime"] < 0.05
    assert truncation.truncated(df.limit(0)).count() == 0


def test_length_law_decides_at_the_limits(spark):
    """Equal endings, unequal odds: a limit in the middle of the natural lengths holds more texts that end there anyway."""
    import numpy as np

    rng, rows, want = np.random.default_rng(3), [], {}
    for source, limit, mean in (("middle", 400, 6.0), ("far", 900, 6.0)):
        natural = np.exp(rng.normal(mean, 0.5, 60_000)).round().astype(int)
        limited = rng.random(len(natural)) < 0.02 if source == "middle" else np.ones(len(natural), bool)
        sizes = np.where(limited, np.minimum(natural, limit), natural)
        cut = (limited & (natural > limit)).sum()
        want[source] = float(np.log(cut / (sizes == limit).sum() / (1 - cut / (sizes == limit).sum())))
        rows += [(source, 1.0 if n == limit else -1.0, int(n), int(n) + 5000 * i) for i, n in enumerate(sizes)]
    # a form letter: one length, but whole
    rows += [("form", -5.0 if n == 500 else -1.0, int(n), int(n) + 5000 * i) for i, n in enumerate([*np.exp(rng.normal(6.0, 0.5, 3000)).astype(int), *[500] * 300])]
    found = spark.createDataFrame(rows, "source string, ratio double, n_chars bigint, n_bytes bigint")
    got = {(r["source"], r["size"]): r["log_odds"] for r in truncation.limits(found).where("unit = 'chars'").collect()}
    assert set(got) == {("middle", 400), ("far", 900)}
    assert abs(got["middle", 400] - want["middle"]) < 0.3 and abs(got["far", 900] - want["far"]) < 0.3
    assert got["far", 900] - got["middle", 400] > 2


# ---- contract


@pytest.mark.parametrize("name, want", [
    ("p3_found", "gene_key string, field_name string, id bigint"), ("p5_found", "id bigint, species_id int"), ("p7_found", "id_a bigint, id_b bigint"), ("p9_found", "doc_id bigint, item_id bigint"),
    ("p10_found", "doc_id bigint"), ("p8_packed", "container string, doc_id bigint, piece int, n_tokens int"),
])
def test_schemas(spark, small, name, want):
    df = queries.QUERIES[name](spark, small)
    assert ", ".join(" ".join(c) for c in df.dtypes) == want and df.count() == df.distinct().count()


def test_other_queries_run(spark, small):
    for name in ("p3_records", "p3_truth", "p3_source_quality", "p3_agreement", "p5_report", "p7_shares", "p7_links", "p7_members", "p8_fill", "p9_items", "p10_rates"):
        assert queries.QUERIES[name](spark, small).select(F.count("*")).first()[0] >= 0
