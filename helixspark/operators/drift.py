"""Schemas that drift between the files of a feed.

The footer of a load is the set of fields its records carry with their
types.  Footers are folded on the map side into one catalogue row per load
and field.  Per feed, field and type the rows of neighbouring loads form
islands, the lifespans of a column; where they start and end is the log of
changes, and renames are endings and starts that agree in value gene by
gene.  From the renames of each feed comes its alias table, and from that
the casts of the one consistent table.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixspark.functions import jsonx
from helixspark.session import checkpoint

KINDS = ["string", "number", "boolean", "array", "object"]
#: Loads per block when a feed is put in order; only block edges cross blocks, so no task holds a whole feed.
BLOCK = 1000
#: Parts into which the rows of one load are spread when values are compared.
SALT = 16
#: Pairs of load and field that every task may hold (some 40 MB) to drop other values before they are compared; of more, values meet them in the shuffle only.
WANTED = 1_000_000


def load_fields(rows: DataFrame, record: str = "record", least: float = 0.2) -> DataFrame:
    """Footers: ``(load_id, field_name, n_rows, load_rows, kind)`` of the fields that belong to each load.

    A field belongs to a load when at least ``least`` of the load's rows carry
    it, null values included; its kind is the most frequent among non-null
    values (null if there are none, ties go to the order of ``KINDS``).
    Records that hold no JSON object count as rows without fields; rows
    without load are ignored.
    """
    rows = rows.where(F.col("load_id").isNotNull())
    sizes = rows.groupBy("load_id").agg(F.count("*").alias("load_rows"))
    each = rows.select("load_id", F.explode(jsonx.members(F.col(record))).alias("field_name", "_value"))
    each = each.select("load_id", "field_name", jsonx.kind(F.col("_value")).alias("_kind"))
    counts = [F.count_if(F.col("_kind") == k).alias(f"_n_{k}") for k in KINDS]
    fields = each.groupBy("load_id", "field_name").agg(F.count("*").alias("n_rows"), *counts)
    top = F.array_max(F.array(*[F.struct(F.col(f"_n_{k}").alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, k in enumerate(KINDS)]))
    fields = fields.withColumn("kind", F.when(top["n"] > 0, top["k"])).select("load_id", "field_name", "n_rows", "kind")
    return fields.join(sizes, "load_id").where(F.col("n_rows") >= F.lit(least) * F.col("load_rows"))


def placed_loads(loads: DataFrame, present: DataFrame) -> DataFrame:
    """``(load_id, feed, load_seq, pos)``: the loads that delivered rows, numbered from 1 within their feed.

    Loads are numbered within blocks of ``BLOCK`` sequence numbers; of each
    block only its size goes to the feed's running sum.
    """
    real = loads.select("load_id", "feed", "load_seq").join(present.select("load_id").distinct(), "load_id", "left_semi")
    real = real.withColumn("_block", F.floor(F.col("load_seq") / BLOCK))
    inside = F.row_number().over(Window.partitionBy("feed", "_block").orderBy("load_seq", "load_id"))
    before = Window.partitionBy("feed").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = real.groupBy("feed", "_block").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    # a null feed or sequence number is a value like any other
    same = F.col("a.feed").eqNullSafe(F.col("b.feed")) & F.col("a._block").eqNullSafe(F.col("b._block"))
    joined = real.withColumn("_in", inside).alias("a").join(sizes.alias("b"), same)
    return joined.select("load_id", "a.feed", "load_seq", (F.col("_in") + F.col("_before")).cast("bigint").alias("pos"))


def lifespan_catalogue(fields: DataFrame, place: DataFrame) -> DataFrame:
    """``(feed, field_name, kind, first_pos, last_pos, first_seq, last_seq, n_loads)``: every column lifespan.

    A lifespan is an island of neighbouring loads of a feed in which the field
    belongs to the load with one kind.  Islands are found by ``lag`` within
    blocks of positions; those that touch at a block's edge are joined, for
    which a field has one row per block and change.
    """
    seen = fields.select("load_id", "field_name", "kind").join(place, "load_id").withColumn("_block", F.floor(F.col("pos") / BLOCK))
    column = ["feed", "field_name", "kind"]
    w = Window.partitionBy(*column, "_block").orderBy("pos")
    fresh = (F.col("pos") - F.coalesce(F.lag("pos").over(w), F.lit(-1)) > 1).cast("int")
    marked = seen.withColumn("_fresh", fresh).withColumn("_island", F.sum("_fresh").over(w))
    span = [F.min("first_pos").alias("first_pos"), F.max("last_pos").alias("last_pos"), F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq")]
    local = marked.groupBy(*column, "_block", "_island").agg(
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.min("load_seq").alias("first_seq"), F.max("load_seq").alias("last_seq"), F.count("*").alias("_n"))
    w = Window.partitionBy(*column).orderBy("first_pos")
    fresh = (F.col("first_pos") - F.coalesce(F.lag("last_pos").over(w), F.lit(-1)) > 1).cast("int")
    whole = local.withColumn("_fresh", fresh).withColumn("_island", F.sum("_fresh").over(w))
    return whole.groupBy(*column, "_island").agg(*span, F.sum("_n").cast("bigint").alias("n_loads")).drop("_island")


def change_log(spans: DataFrame, place: DataFrame) -> DataFrame:
    """``(feed, load_id, prev_load, field_name, old_kind, new_kind, change_kind)``: the starts and endings of lifespans, before renames are known.

    A lifespan that starts where another of the field ends is a change of
    type; one without a neighbour is the field's coming or going.  What a
    feed's first load starts is no change.
    """
    old, new = F.lit(None).cast("string"), F.col("kind")
    starts = spans.where("first_pos > 1").select("feed", "field_name", F.col("first_pos").alias("pos"), new.alias("new_kind"), old.alias("old_kind"), F.lit(True).alias("starts"))
    ends = spans.select("feed", "field_name", (F.col("last_pos") + 1).alias("pos"), old.alias("new_kind"), new.alias("old_kind"), F.lit(False).alias("starts"))
    log = starts.unionByName(ends).groupBy("feed", "field_name", "pos").agg(
        F.max("new_kind").alias("new_kind"), F.max("old_kind").alias("old_kind"), F.max("starts").alias("_starts"), F.max(~F.col("starts")).alias("_ends"))
    change = (
        F.when(~F.col("_ends"), F.lit("added"))
        .when(~F.col("_starts"), F.lit("removed"))
        .when(F.col("old_kind") != F.col("new_kind"), F.lit("type_changed"))
    )
    log = log.withColumn("change_kind", change).where(F.col("change_kind").isNotNull()).alias("c")
    # what ends with the feed's last load meets no load here
    steps = place.alias("p").join(place.select("feed", F.col("pos") + 1, F.col("load_id").alias("prev_load")).toDF("feed", "pos", "prev_load").alias("q"),
                                  F.col("p.feed").eqNullSafe(F.col("q.feed")) & (F.col("p.pos") == F.col("q.pos")))
    steps = steps.select("p.feed", "p.pos", "p.load_id", "q.prev_load").alias("s")
    joined = log.join(steps, F.col("c.feed").eqNullSafe(F.col("s.feed")) & (F.col("c.pos") == F.col("s.pos")))
    return joined.select("c.feed", "load_id", "prev_load", "field_name", "old_kind", "new_kind", "change_kind")


def renames(rows: DataFrame, changes: DataFrame, key: Column, record: str = "record") -> DataFrame:
    """``(load_id, old_name, new_name, n_genes, n_equal)``: fields that left while another came with their values.

    Values are compared gene by gene where both loads hold one; a gene
    delivered several times agrees when any of its values does.  A pair is a
    rename when more than half of these genes agree; a field is part of one
    rename at most, the one with most agreeing genes, ties by name.
    """
    came = changes.where("change_kind = 'added'").select("load_id", "prev_load", F.col("field_name").alias("new_name"))
    left = changes.where("change_kind = 'removed'").select("load_id", F.col("field_name").alias("old_name"))
    pairs = came.join(left, "load_id")
    sides = pairs.select(
        "load_id", "old_name", "new_name",
        F.explode(F.array(F.struct(F.col("prev_load").alias("at"), F.col("old_name").alias("name"), F.lit(True).alias("old")),
                          F.struct(F.col("load_id").alias("at"), F.col("new_name").alias("name"), F.lit(False).alias("old")))).alias("w"),
    ).select("load_id", "old_name", "new_name", "w.*")
    wanted = sides.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    values = rows.select(F.col("load_id").alias("at"), key.alias("_key"), F.explode(jsonx.members(F.col(record))).alias("name", "_value"))
    values = values.where(F.col("_key").isNotNull() & F.col("_value").isNotNull() & ~F.is_variant_null("_value"))
    # most values belong to no change: told by a hash, they are neither encoded nor shuffled; the join below is exact
    place = F.xxhash64("at", "name")
    few = checkpoint(sides.select(place.alias("_place")).distinct())
    if few.count() <= WANTED:
        values = values.join(F.broadcast(few), place == F.col("_place"), "left_semi")
    values = values.select("at", "_key", "name", F.xxhash64(jsonx.canonical(F.col("_value"))).alias("_hash"), F.pmod(F.hash("_key"), F.lit(SALT)).alias("_salt"))
    hits = values.join(wanted, ["at", "name", "_salt"])
    pair = ["load_id", "old_name", "new_name"]
    one = hits.groupBy(*pair, "_key", "_hash").agg(F.max("old").alias("_o"), F.max(~F.col("old")).alias("_n"))
    gene = one.groupBy(*pair, "_key").agg(F.max("_o").alias("_o"), F.max("_n").alias("_n"), F.max(F.col("_o") & F.col("_n")).alias("_both"))
    gene = gene.where("_o and _n").groupBy(*pair).agg(F.count("*").alias("n_genes"), F.count_if("_both").alias("n_equal"))
    good = gene.where(F.col("n_equal") * 2 > F.col("n_genes"))
    best = F.desc("n_equal")
    good = good.withColumn("_r", F.row_number().over(Window.partitionBy("load_id", "old_name").orderBy(best, "new_name"))).where("_r = 1")
    good = good.withColumn("_r", F.row_number().over(Window.partitionBy("load_id", "new_name").orderBy(best, "old_name"))).where("_r = 1")
    return good.drop("_r")


def changes(rows: DataFrame, loads: DataFrame, key: Column, record: str = "record") -> DataFrame:
    """Every change of every load against the load before it: ``(load_id, field_name, change_kind)``.

    A feed's first load has no changes, empty tables give no rows, loads of
    which no row arrived are passed over.
    """
    fields, place = load_fields(rows, record), placed_loads(loads, rows)
    raw = checkpoint(change_log(lifespan_catalogue(fields, place), place))  # a few rows per load, used four times below
    moved = renames(rows, raw, key, record)
    gone = moved.select("load_id", F.explode(F.array(
        F.struct(F.col("new_name").alias("field_name"), F.lit("added").alias("change_kind")),
        F.struct(F.col("old_name").alias("field_name"), F.lit("removed").alias("change_kind")))).alias("g")).select("load_id", "g.*")
    kept = raw.select("load_id", "field_name", "change_kind").join(gone, ["load_id", "field_name", "change_kind"], "left_anti")
    return kept.unionByName(moved.select("load_id", F.col("new_name").alias("field_name"), F.lit("renamed").alias("change_kind")))


def lifespans(rows: DataFrame, loads: DataFrame, record: str = "record") -> DataFrame:
    """Column lifespan catalogue: ``(feed, field_name, kind, first_seq, last_seq, n_loads)``; positions count the loads that delivered rows."""
    spans = lifespan_catalogue(load_fields(rows, record), placed_loads(loads, rows))
    return spans.select("feed", "field_name", "kind", "first_seq", "last_seq", "n_loads")


def alias_table(moved: DataFrame, fields: DataFrame, place: DataFrame) -> DataFrame:
    """``(feed, field_name, canonical)`` of the fields that a feed has renamed.

    Names linked by renames of one feed form one field, called by the name
    that most loads of all feeds use; two feeds may use one name for two
    things.  A feed's renames, schema and not data, are linked in one task.
    """
    pairs = moved.join(place.select("load_id", "feed"), "load_id").select(F.coalesce("feed", F.lit("")).alias("feed"), "old_name", "new_name").distinct()
    used = fields.groupBy("field_name").agg(F.count("*").alias("_n"))
    weigh = lambda df, name: df.join(used.select(F.col("field_name").alias(name), F.col("_n").alias(f"{name}_n")), name, "left")

    def link(group: pd.DataFrame) -> pd.DataFrame:
        parent: dict[str, str] = {}
        weight = dict(zip(group["old_name"], group["old_name_n"], strict=True)) | dict(zip(group["new_name"], group["new_name_n"], strict=True))

        def root(x: str) -> str:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        for old, new in sorted(zip(group["old_name"], group["new_name"], strict=True)):
            a, b = sorted((root(old), root(new)), key=lambda x: (-weight[x], x))
            parent[b] = a
        names = sorted(weight)
        return pd.DataFrame({"feed": group["feed"].iloc[0], "field_name": names, "canonical": [root(n) for n in names]})

    weighed = weigh(weigh(pairs, "old_name"), "new_name").fillna(0, ["old_name_n", "new_name_n"])
    return weighed.groupBy("feed").applyInPandas(link, "feed string, field_name string, canonical string")


def unified(rows: DataFrame, loads: DataFrame, key: Column, record: str = "record", id_column: str = "id", most: int = 10_000) -> DataFrame:
    """All records in one consistent table: one row per record, one typed column per canonical field.

    Names follow the alias table of the record's feed, casts each canonical
    field's most frequent kind: numbers become double, booleans boolean,
    strings string (arrays of one unwrapped, objects by their ``value`` or
    ``scientific_name``), arrays and objects JSON text.  Values that can't be
    cast, and records that hold no object, give null; a record that holds
    several names of one field gives the canonical name's value, else the
    first by name; columns that would clash with ``id`` and ``load_id`` get
    the prefix ``record_``.  Columns are schema, not data: more than ``most``
    mean that keys hold data, which is an error.
    """
    fields, place = checkpoint(load_fields(rows, record)), checkpoint(placed_loads(loads, rows))
    moved = renames(rows, checkpoint(change_log(lifespan_catalogue(fields, place), place)), key, record)
    alias = checkpoint(alias_table(moved, fields, place))
    known = fields.join(place.select("load_id", F.coalesce("feed", F.lit("")).alias("feed")), "load_id").join(alias, ["feed", "field_name"], "left")
    counted = known.groupBy(F.coalesce("canonical", "field_name").alias("name"), "kind").agg(F.sum("n_rows").alias("n")).where("kind IS NOT NULL")
    kinds: dict[str, dict[str, int]] = {}
    for r in counted.limit(most * len(KINDS) + 1).collect():
        kinds.setdefault(r["name"], {})[r["kind"]] = r["n"]
    if len(kinds) > most:
        raise ValueError(f"more than {most} field names")
    # of each feed: the names that stand for a canonical field, itself first, and the names that stand for another
    ordered = F.array_sort(F.collect_list(F.struct((F.col("field_name") != F.col("canonical")).alias("o"), F.col("field_name").alias("n"))))
    stands = alias.groupBy("feed", "canonical").agg(F.transform(ordered, lambda x: x["n"]).alias("names"))
    stands = stands.groupBy("feed").agg(F.map_from_entries(F.collect_list(F.struct("canonical", "names"))).alias("_names"))
    other = alias.where("field_name <> canonical").groupBy("feed").agg(F.collect_set("field_name").alias("_other"))
    by_load = place.select("load_id", F.coalesce("feed", F.lit("")).alias("feed")).join(stands, "feed").join(other, "feed").select("load_id", "_names", "_other")
    members = rows.select(id_column, "load_id", jsonx.members(F.col(record)).alias("_m")).join(by_load, "load_id", "left")
    m, out = F.col("_m"), []
    for name in sorted(kinds):
        kind = max(KINDS, key=lambda k: kinds[name].get(k, 0))
        names = F.element_at("_names", F.lit(name))
        first = F.get(F.filter(F.transform(names, lambda n: F.element_at(m, n)), lambda v: v.isNotNull()), F.lit(0))
        value = F.when(names.isNotNull(), first).when(~F.coalesce(F.array_contains("_other", name), F.lit(False)), F.element_at(m, F.lit(name)))
        plain = F.coalesce(*[F.try_variant_get(value, p, "string") for p in ("$.value", "$.scientific_name", "$[0]", "$")])
        cast = {"number": plain.try_cast("double"), "boolean": plain.try_cast("boolean"), "string": plain}.get(kind, F.to_json(value))
        out.append(cast.alias(f"record_{name}" if name in (id_column, "load_id") else name))
    return members.select(id_column, "load_id", *out)
