import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from helixspark.functions.keys import gene_key, norm_key
from helixspark.operators import drift, heavy, nested, orphans

KEY = lambda: gene_key(F.col("gene_id"), F.col("symbol"))


def loads_of(spark, n, feed="f"):
    return spark.createDataFrame([(i, feed, i, "s") for i in range(1, n + 1)], "load_id bigint, feed string, load_seq int, kind string")


def genes_of(spark, records):
    """``records``: lists of records per load; gene keys by position; the extra column clashes with a name used inside."""
    rows = [(100 * l + i, f"g{i}", None, r if isinstance(r, str) or r is None else json.dumps(r), l, "clash") for l, rs in enumerate(records, 1) for i, r in enumerate(rs)]
    return spark.createDataFrame(rows, "id bigint, gene_id string, symbol string, record string, load_id bigint, kind string")


def test_drift_changes(spark):
    first = [{"a": 1, "name": f"n{i}", "x": i} for i in range(10)]
    second = [{"a": "1", "title": f"n{i}", "x": i} | ({"rare": 1} if i == 0 else {}) | ({"new": None} if i < 2 else {}) for i in range(10)]
    third = [{"a": "1", "title": json.dumps([f"n{i}"]), "y": -i - 5} for i in range(10)]
    got = {tuple(r) for r in drift.changes(genes_of(spark, [first, second, third]), loads_of(spark, 3), KEY()).collect()}
    assert got == {(2, "a", "type_changed"), (2, "title", "renamed"), (2, "new", "added"), (3, "x", "removed"), (3, "y", "added"), (3, "new", "removed")}


def test_drift_odd_records(spark):
    rows = genes_of(spark, [[None, "no json", "[1]", {"a": 1}], [{"b": 1}], [{"b": 2}, {"b": 2}]])
    got = {tuple(r) for r in drift.changes(rows, loads_of(spark, 4), KEY()).collect()}
    assert got == {(2, "a", "removed"), (2, "b", "added")} or got == {(2, "b", "renamed")}
    assert drift.changes(rows.limit(0), loads_of(spark, 3), KEY()).count() == 0
    assert drift.changes(rows, loads_of(spark, 3).limit(0), KEY()).count() == 0


def test_drift_rename_needs_most_genes(spark):
    first = [{"old": i} for i in range(10)]
    second = [{"new": i if i < 5 else 99} for i in range(10)]
    got = {tuple(r) for r in drift.changes(genes_of(spark, [first, second]), loads_of(spark, 2), KEY()).collect()}
    assert got == {(2, "old", "removed"), (2, "new", "added")}


@pytest.mark.parametrize("most", [0, 10**6])
def test_drift_values_of_no_change_are_not_shuffled(spark, monkeypatch, most):
    monkeypatch.setattr(drift, "WANTED", most, raising=False)
    same = {f"s{i}": [i, None, {"x": "y"}] for i in range(20)}
    rows = genes_of(spark, [[{"old": i, "gone": None} | same for i in range(10)], [{"new": str(i), "null": None} | same for i in range(10)]])
    raw = spark.createDataFrame([(2, 1, "new", "added"), (2, 1, "null", "added"), (2, 1, "old", "removed"), (2, 1, "gone", "removed")], "load_id bigint, prev_load bigint, field_name string, change_kind string")
    got = drift.renames(rows, raw, KEY())
    assert [tuple(r) for r in got.collect()] == [(2, "old", "new", 10, 10)]
    assert ("LeftSemi" in got._jdf.queryExecution().executedPlan().toString()) == (most > 0)


def test_places_and_islands_across_blocks(spark, monkeypatch):
    seqs = [1, 2, 999, 1000, 1001, 5000]
    loads = spark.createDataFrame([(i, "f", s) for i, s in enumerate(seqs, 1)] + [(10, None, None), (11, None, 3)], "load_id bigint, feed string, load_seq int")
    place = drift.placed_loads(loads, loads)
    assert {r["load_id"]: r["pos"] for r in place.collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 10: 1, 11: 2}
    monkeypatch.setattr(drift, "BLOCK", 2)
    fields = spark.createDataFrame([(i, "a", "string") for i in (1, 2, 3, 5, 6)] + [(i, "b", "number") for i in (1, 2)] + [(3, "b", "string"), (4, "b", None), (10, "c", None)], "load_id bigint, field_name string, kind string")
    spans = drift.lifespan_catalogue(fields, place)
    assert {tuple(r) for r in spans.select("field_name", "kind", "first_pos", "last_pos", "n_loads").collect()} == {
        ("a", "string", 1, 3, 3), ("a", "string", 5, 6, 2), ("b", "number", 1, 2, 2), ("b", "string", 3, 3, 1), ("b", None, 4, 4, 1), ("c", None, 1, 1, 1)}
    log = drift.change_log(spans, place)
    assert {(r["load_id"], r["prev_load"], r["field_name"], r["change_kind"]) for r in log.collect()} == {
        (4, 3, "a", "removed"), (5, 4, "a", "added"), (3, 2, "b", "type_changed"), (5, 4, "b", "removed"), (11, 10, "c", "removed")}


def test_unified_keeps_the_feeds_apart(spark):
    """One feed renames ``a`` to ``b``; another holds both as two things."""
    one = [[{"a": f"v{i}"} for i in range(6)], [{"b": f"v{i}"} for i in range(6)]]
    two = [[{"a": "x", "b": "y"}], [{"a": "x", "b": "y"}]]
    rows = genes_of(spark, one).unionByName(genes_of(spark, two).selectExpr("id + 10000 AS id", "gene_id", "symbol", "record", "load_id + 10 AS load_id", "kind"))
    loads = loads_of(spark, 2, "one").unionByName(loads_of(spark, 2, "two").selectExpr("load_id + 10 AS load_id", "feed", "load_seq", "kind"))
    got = [r.asDict() for r in drift.unified(rows, loads, KEY()).collect()]
    assert len(got) == 14 and {(r["a"], r["b"]) for r in got if r["load_id"] > 10} == {("x", "y")}
    first = [r for r in got if r["load_id"] < 10]
    assert {(r["a"], r["b"]) for r in first} == {(f"v{i}", None) for i in range(6)}


def test_lifespans_and_unified(spark):
    rows = genes_of(spark, [[{"a": 1}], [{"b": 1}], [{"a": 2, "id": 7}]])
    spans = {tuple(r) for r in drift.lifespans(rows, loads_of(spark, 3)).select("field_name", "first_seq", "last_seq").collect()}
    assert {("a", 1, 1), ("b", 2, 2), ("a", 3, 3)} <= spans
    table = drift.unified(rows, loads_of(spark, 3), KEY())
    assert table.count() == 3 and "record_id" in table.columns


def brute_elements(rows, columns):
    def dec(v):
        while isinstance(v, str) and v.lstrip()[:1] in ("{", "[", '"') and v:
            try:
                v = json.loads(v)
            except ValueError:
                return v
        return v

    arrays, out = set(), set()

    def scan(v, path, placed):
        v = dec(v)
        if isinstance(v, dict):
            if placed:
                arrays.add(path)
            for k, x in v.items():
                scan(x, f"{path}.{k}", False)
        elif isinstance(v, list):
            for x in v:
                scan(x, path, True)

    def emit(i, v, path, placed, label):
        v = dec(v)
        if isinstance(v, dict):
            if not placed and path in arrays:
                label, placed = (*label, "0"), True
            if placed:
                out.add((i, path, ".".join(label)))
            for k, x in v.items():
                emit(i, x, f"{path}.{k}", False, label)
        elif isinstance(v, list):
            for n, x in enumerate(v):
                emit(i, x, path, True, (*label, str(n)))

    for f in (lambda r, c: scan(r[c], c, False), lambda r, c: emit(r["id"], r[c], c, False, ())):
        for r in rows:
            for c in columns:
                if r[c] is not None:
                    f(r, c)
    return out


def test_nested(spark):
    texts = [
        '{"a": [{"b": [{"c": 1}, null, 5, {"c": 2}]}, "x", {"b": {"c": 3}}], "m": {"n": {"o": 1}}}', '{"a": {"b": {"c": 1}}, "m": {"n": [{"o": 2}]}}',
        json.dumps({"a": json.dumps([{"b": [[{"c": 1}], []]}])}), json.dumps(json.dumps({"a": [{}]})), "[]", "{", None, "", '[{"top": 1}]', "[" * 50 + '{"deep":1}' + "]" * 50,
    ]
    rows = [{"id": i, "record": t} for i, t in enumerate(texts)]
    df = spark.createDataFrame([(r["id"], r["record"], "clash", 1) for r in rows], "id bigint, record string, path string, item int")
    got = [tuple(r) for r in nested.elements(df, ["record"]).collect()]
    assert set(got) == brute_elements(rows, ["record"]) and len(got) == len(set(got))
    assert nested.elements(df.limit(0), ["record"]).count() == 0
    linked = {(r["item"], r["parent_item"], r["depth"]) for r in nested.with_parents(nested.elements(df.where("id = 0"), ["record"])).collect()}
    assert ("0.3", "0", 2) in linked and ("0", None, 1) in linked
    flat = nested.flat_table(df.where("id = 0"), "record", "record.a.b", {"c": "int"}).collect()
    assert {(r["item"], r["c"]) for r in flat} == {("0.0", 1), ("0.3", 2), ("2.0", 3)}


@pytest.mark.parametrize("text", ['{"a": [1, {"b": "x,\\"]"}], "c": {}}', "[]", " [ [ ] , { } ] ", '"x"', "5", '{"a": -1.5e3, "a": null}', '[true,false,null,"\\u00e9"]', "", "{", "[1,]", '{"a"}', '{"a":1,}', "[1 2]", "[}", "]", "{1:2}", '{"a":1} x', "[1]]", "nul", '["a'])
def test_deep_parser_agrees(text):
    def outcome(f):
        try:
            return f(text)
        except ValueError:
            return "error"

    assert outcome(nested.loads_deep) == outcome(json.loads)


def test_nested_keeps_the_shallow_elements_of_a_deep_text(spark):
    deep = '{"deep": ' + "[" * 30_000 + "]" * 30_000 + ', "a": [{"x": 1}, {"y": ' + '{"z":' * 1500 + "[{}]" + "}" * 1500 + "}]}"
    df = spark.createDataFrame([(1, deep), (2, "[" * 30_000)], "id bigint, record string")
    got = nested.elements(df, ["record"]).select("path", "item").collect()
    assert {(r["path"], r["item"]) for r in got if len(r["path"]) < 20} == {("record.a", "0"), ("record.a", "1")}
    assert [r["item"] for r in got if len(r["path"]) > 3000] == ["1.0"]


def test_nested_structs(spark):
    df = spark.createDataFrame([(1, [{"s": [{"x": 1}, None]}, None, {"s": []}])], "id bigint, p array<struct<s:array<struct<x:int>>>>")
    assert {tuple(r) for r in nested.elements(df, ["p"]).collect()} == {(1, "p", "0"), (1, "p", "2"), (1, "p.s", "0.0")}


def test_heavy(spark):
    rows = [("A", 1)] * 40 + [(" a ", 2)] * 10 + [("B", 3)] * 2 + [(None, 4)] * 8 + [(f"k{i}", 5) for i in range(40)]
    df = spark.createDataFrame([(k, p, 1) for k, p in rows], "k string, p int, n_rows int")
    got = {(r["key_value"], r["n_rows"]) for r in heavy.heavy_keys(df, {"k": norm_key(F.col("k"))}, 0.02).collect()}
    assert got == {("A", 50), ("B", 2)}
    assert heavy.heavy_keys(df.limit(0), {"k": F.col("k")}, 0.02).count() == 0
    profile = {r["key"]: r for r in heavy.key_profile(df, norm_key(F.col("k")), F.col("p"), F.col("p"), "key").collect()}
    assert (profile["A"]["n_rows"], profile["A"]["n_members"], profile["A"]["min_pos"], profile["A"]["max_pos"]) == (50, 2, 1, 2) and None not in profile


def test_orphans(spark):
    day = lambda m, d=1: datetime(2020, m, d)
    refs = spark.createDataFrame([("a", day(1)), (" A", day(1, 9)), ("a", day(5)), ("gone", day(2)), ("never", day(2)), (None, day(2)), ("", day(2)), ("back", day(3)), ("undated", day(3)), ("a", None)], "gene_key string, at timestamp")
    known = spark.createDataFrame([("A", day(3)), ("a", None), ("a", day(4)), ("BACK", day(1)), ("undated", None)], "gene_key string, at timestamp")
    retired = spark.createDataFrame([("gone",), ("back",), ("unused",)], "gene_key string")
    key = norm_key(F.col("gene_key"))
    exist = orphans.fold([orphans.existence_deltas(known, key, F.col("at")), orphans.retirement_deltas(retired, key)])
    found = orphans.orphans(orphans.reference_deltas(refs, "t", key, F.col("at")), exist)
    assert {tuple(r) for r in found.collect()} == {("t", "2020-01", "A", "early", 2), ("t", "2020-02", "GONE", "deleted", 1), ("t", "2020-02", "NEVER", "missing", 1)}
    assert orphans.orphans(orphans.reference_deltas(refs.limit(0), "t", key, F.col("at")), exist).count() == 0
    assert {(r["reason"], r["n_keys"], r["n_refs"]) for r in orphans.orphan_report(found).collect()} == {("early", 1, 2), ("deleted", 1, 1), ("missing", 1, 1)}


def test_orphans_by_batches(spark):
    """A key orphaned, restored, orphaned again, and at last no longer referred to; only early references count as early."""
    day = lambda m: datetime(2020, m, 1)
    keyed = lambda *rows: spark.createDataFrame(list(rows), "gene_key string, at timestamp")
    key, at = norm_key(F.col("gene_key")), F.col("at")
    refs = orphans.fold([orphans.reference_deltas(keyed(("x", day(1)), ("x", day(1)), ("x", day(6))), "t", key, at)])
    exist = orphans.fold([orphans.existence_deltas(keyed(("other", day(1))), key, at)])
    report = lambda: {tuple(r)[1:] for r in orphans.orphans(refs, exist).collect()}
    assert report() == {("2020-01", "X", "missing", 2), ("2020-06", "X", "missing", 1)}
    exist = orphans.fold([orphans.existence_deltas(keyed(("X ", day(3)), ("x", day(2))), key, at)], exist)
    assert report() == {("2020-01", "X", "early", 2)}
    exist = orphans.fold([orphans.existence_deltas(keyed(("x", day(2)),), key, at, sign=-1)], exist)
    assert report() == {("2020-01", "X", "early", 2)}
    exist = orphans.fold([orphans.existence_deltas(keyed(("x", day(3)),), key, at, sign=-1), orphans.retirement_deltas(keyed(("x", day(4))), key)], exist)
    assert report() == {("2020-01", "X", "deleted", 2), ("2020-06", "X", "deleted", 1)}
    refs = orphans.fold([orphans.reference_deltas(keyed(("x", day(1)), ("x", day(1))), "t", key, at, sign=-1)], refs)
    assert report() == {("2020-06", "X", "deleted", 1)}
    assert refs.count() == 1 and exist.where("gene_key = 'X'").agg(F.sum("n")).first()[0] == 0


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p4_found", "p6_found"])
def test_schemas(spark, small, name):
    import __spark_entry__

    want = {
        "p1_found": [("load_id", "bigint"), ("field_name", "string"), ("change_kind", "string")], "p2_found": [("id", "bigint"), ("path", "string"), ("item", "string")],
        "p4_found": [("key_column", "string"), ("key_value", "string")], "p6_found": [("ref_table", "string"), ("ref_month", "string"), ("gene_key", "string"), ("reason", "string")]}
    df = __spark_entry__.queries()[name](spark, small)
    assert df.dtypes == want[name] and df.count() == df.distinct().count()
