"""Deeply nested records as related flat tables.

Every element of an array of objects gets a Dewey label: the positions of
its enclosing elements and its own, outermost first.  Cutting the last
position off gives the parent, and the schema path names the table an
element belongs to.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixspark.session import checkpoint

#: Schema shapes up to which their table is broadcast; more are joined by shuffle.
MOST_SHAPES = 20_000
#: Stands in a label for an object that is alone where other rows may have an array.
ALONE = "@"


def _decoded(v):
    """Text that itself holds JSON counts as what it holds."""
    while isinstance(v, str):
        s = v.lstrip()
        if s[:1] not in ("{", "[", '"'):
            return v
        try:
            v = json.loads(s)
        except ValueError:
            return v
        except RecursionError:
            try:
                v = loads_deep(s)
            except ValueError:
                return v
    return v


_TOKEN = re.compile(r'[ \t\n\r]*([{}\[\],:]|"(?:[^"\\\x00-\x1f]|\\.)*"|[^{}\[\],:"\s]+)', re.S)


def loads_deep(text: str):
    """JSON of any depth, with an explicit stack; an error is a ``ValueError`` as in ``json.loads``."""
    at, end, root, done = 0, len(text), [], False
    # (container, key that waits for its value, what may come next)
    stack: list[list] = [[root, None, "value"]]
    while at < end and (m := _TOKEN.match(text, at)):
        at, token = m.end(), m[1]
        holder, key, state = stack[-1]
        if token in "{[" and state in ("value", "value or end"):
            new = {} if token == "{" else []
            _put(stack[-1], new)
            stack.append([new, None, "key or end" if token == "{" else "value or end"])
        elif token in "}]" and len(stack) > 1 and (token == "}") == isinstance(holder, dict) and state in ("key or end", "value or end", "more"):
            stack.pop()
        elif token == "," and state == "more" and len(stack) > 1:
            stack[-1][2] = "key" if isinstance(holder, dict) else "value"
        elif token == ":" and state == "colon":
            stack[-1][2] = "value"
        elif token[0] == '"' and state in ("key", "key or end"):
            stack[-1][1:] = [json.loads(token), "colon"]
        elif token not in "{}[],:" and state in ("value", "value or end"):
            _put(stack[-1], json.loads(token))
        else:
            raise ValueError(f"unexpected {token!r}")
    done = len(stack) == 1 and len(root) == 1 and not text[at:].strip(" \t\n\r")
    if not done:
        raise ValueError("unfinished text")
    return root[0]


def _put(frame: list, value) -> None:
    holder, key, _ = frame
    if isinstance(holder, dict):
        holder[key] = value
    else:
        holder.append(value)
    frame[1:] = [None, "more"]


def walk(value, column: str) -> Iterator[tuple[str, str, tuple[int, ...], bool, dict]]:
    """Object nodes of one value as ``(path, label, lone paths, below a lone root, node)``, parents first.

    A lone object's position is ``ALONE`` and its path, which starts those of
    all below it, is among the lone paths by its length; whether it counts as an array of one is settled once all rows are
    known.  A lone root has the empty label.  The stack is explicit, here as
    in the parser of very deep texts, so no depth is refused.
    """
    root = _decoded(value)
    lone_root = isinstance(root, dict)
    stack = [(root, column, "", (), lone_root)]
    while stack:
        v, path, label, alone, placed = stack.pop()
        if isinstance(v, dict):
            if not placed:
                label, alone = f"{label}.{ALONE}" if label else ALONE, (*alone, len(path))
            yield path, label, alone, lone_root, v
            for k in reversed(v):
                x = _decoded(v[k])
                if isinstance(x, (dict, list)):
                    stack.append((x, f"{path}.{k}", label, alone, False))
        elif isinstance(v, list):
            for i in range(len(v) - 1, -1, -1):
                x = _decoded(v[i])
                if isinstance(x, (dict, list)):
                    stack.append((x, path, f"{label}.{i}" if label else str(i), alone, True))


_NODE = "id bigint, path string, item string, alone array<int>, rooted boolean"
_ARROW = pa.schema([("id", pa.int64()), ("path", pa.string()), ("item", pa.string()), ("alone", pa.list_(pa.int32())), ("rooted", pa.bool_())])


def _record_batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, schema, strict=True)], schema=schema)


def _nodes(columns: list[str], with_node: bool):
    schema = _ARROW.append(pa.field("node", pa.string())) if with_node else _ARROW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            ids = batch.column(0).to_pylist()
            for name in columns:
                for i, text in zip(ids, batch.column(batch.schema.get_field_index(name)).to_pylist(), strict=True):
                    if not text or "{" not in text:
                        continue
                    for path, label, alone, rooted, node in walk(text, name):
                        for x, y in zip(out, (i, path, label, alone, rooted), strict=False):
                            x.append(y)
                        if with_node:
                            out[5].append(json.dumps({k: v for k, v in node.items() if not isinstance(v, (dict, list))}, ensure_ascii=False))
                    if len(out[0]) >= 50_000:
                        yield _record_batch(out, schema)
                        out = [[] for _ in schema]
            if out[0]:
                yield _record_batch(out, schema)

    return run


def _shapes(columns: list[str]):
    """The distinct ``(path, lone paths)`` of each batch: what the second pass needs to know of all rows."""
    schema = pa.schema([("path", pa.string()), ("alone", pa.list_(pa.int32())), ("root", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple] = set()
            for name in columns:
                for text in batch.column(batch.schema.get_field_index(name)).to_pylist():
                    if text and "{" in text:
                        found.update((path, alone, not label) for path, label, alone, _, _ in walk(text, name))
            yield _record_batch([list(x) for x in zip(*found, strict=True)] or [[], [], []], schema)

    return run


def elements(df: DataFrame, columns: list[str], id_column: str = "id", with_node: bool = False) -> DataFrame:
    """Every object that is an element of an array, at any depth: ``(id, path, item[, node])``.

    ``item`` is the Dewey label.  Elements that are no objects give no row but
    keep their position; text that holds JSON counts as what it holds; an
    object alone at a path where any row has an array of objects counts as an
    array of one, other lone objects give no row and no position.  Nulls,
    text that is no JSON and empty arrays give no rows.  ``with_node`` adds
    the element's own scalar members as JSON.  Columns other than those named
    are not read.
    """
    dtypes = dict(df.dtypes)
    texts = [(F.col(c) if dtypes[c] == "string" else F.to_json(F.col(c))).alias(c) for c in columns]
    source = df.select(F.col(id_column).cast("bigint").alias("id"), *texts)
    nodes = source.mapInArrow(_nodes(columns, with_node), _NODE + ", node string" * with_node)
    # one row per schema path and lone paths above it: as large as the schema, read several times below
    shapes = checkpoint(source.select(*columns).mapInArrow(_shapes(columns), "path string, alone array<int>, root boolean").distinct())
    arrays = shapes.where(~F.col("root") & ~F.array_contains("alone", F.length("path"))).select(F.col("path").alias("lone")).distinct()
    # columns whose top level is an array in some row: at most as many rows as there are columns
    roots = arrays.where(F.col("lone").isin(columns)).select(F.col("lone").alias("_root"))
    # the lone paths of a shape that are arrays elsewhere
    known = shapes.where(F.size("alone") > 0).select("path", "alone", F.explode("alone").alias("_at")).withColumn("lone", F.substring("path", F.lit(1), F.col("_at")))
    known = known.join(arrays, "lone", "left_semi").groupBy("path", "alone").agg(F.collect_set("_at").alias("_arrays"))
    if shapes.limit(MOST_SHAPES + 1).count() <= MOST_SHAPES:
        known = F.broadcast(known)
    lone = nodes.join(known, ["path", "alone"], "left").withColumn("_arrays", F.coalesce("_arrays", F.array().cast("array<int>")))
    # an object alone at its own path is an element only if that path holds arrays
    own = F.col("item").endswith(ALONE) & (F.try_element_at("alone", F.lit(-1)) == F.length("path"))
    lone = lone.where(~F.coalesce(own, F.lit(False)) | F.array_contains("_arrays", F.length("path")))
    # the n-th lone step of a label belongs to the n-th lone path
    label = F.aggregate(
        F.split("item", r"\."),
        F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.when(s != ALONE, F.struct(acc["n"].alias("n"), F.concat(acc["out"], F.array(s)).alias("out"))).otherwise(
            F.struct((acc["n"] + 1).alias("n"), F.concat(acc["out"], F.when(
                F.array_contains("_arrays", F.get("alone", acc["n"])), F.array(F.lit("0"))).otherwise(F.array().cast("array<string>"))).alias("out"))),
        lambda acc: acc["out"],
    )
    item = F.when(F.size("alone") > 0, F.array_join(label, ".")).otherwise(F.col("item"))
    every = lone.withColumn("item", item).drop("_arrays").join(F.broadcast(roots), F.substring_index("path", ".", 1) == F.col("_root"), "left")
    under = F.col("rooted") & F.col("_root").isNotNull()
    every = every.where((F.col("item") != "") | under).withColumn("item", F.when(under, F.concat_ws(".", F.lit("0"), F.nullif("item", F.lit("")))).otherwise(F.col("item")))
    return every.select("id", "path", "item", *(["node"] if with_node else []))


def with_parents(found: DataFrame) -> DataFrame:
    """Adds ``parent_item``, the label cut by its last position, and ``depth``."""
    parent = F.when(F.col("item").contains("."), F.regexp_replace("item", r"\.[^.]*$", ""))
    return found.withColumn("parent_item", parent).withColumn("depth", F.size(F.split("item", r"\.")))


def flat_table(df: DataFrame, column: str, path: str, fields: dict[str, str], id_column: str = "id") -> DataFrame:
    """The flat table of one schema path: ``id, item, parent_item`` and the named scalar fields with their types."""
    rows = with_parents(elements(df, [column], id_column, with_node=True).where(F.col("path") == path))
    return rows.select("id", "item", "parent_item", *[F.get_json_object("node", f"$['{n}']").try_cast(t).alias(n) for n, t in fields.items()])
