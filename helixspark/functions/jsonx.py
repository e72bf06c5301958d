"""JSON held in text columns, seen through variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unquoted(text: Column) -> Column:
    """JSON text, with one level of double encoding (a JSON string that holds JSON) undone."""
    return F.when(F.ltrim(text).startswith('"'), F.get_json_object(text, "$")).otherwise(text)


def members(text: Column) -> Column:
    """Top-level members of a JSON object as ``map<string,variant>``; null where the text holds no object."""
    body = unquoted(text)
    return F.when(F.ltrim(body).startswith("{"), F.from_json(body, "map<string,variant>"))


def text_members(text: Column) -> Column:
    """Top-level members of a JSON object as ``map<string,string>``; nested values stay JSON text."""
    body = unquoted(text)
    return F.when(F.ltrim(body).startswith("{"), F.from_json(body, "map<string,string>"))


def kind(value: Column) -> Column:
    """``string``, ``number``, ``boolean``, ``array`` or ``object``; null for a JSON null."""
    name = F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)
    return (
        F.when(value.isNull() | (name == "VOID"), F.lit(None))
        .when(name == "STRING", F.lit("string"))
        .when(name == "BOOLEAN", F.lit("boolean"))
        .when(name == "ARRAY", F.lit("array"))
        .when(name == "OBJECT", F.lit("object"))
        .otherwise(F.lit("number"))
    )


def canonical(value: Column) -> Column:
    """One text for a value however it is encoded.

    Text that itself holds JSON counts as what it holds, and an array of one
    element counts as its element.
    """
    text = F.try_variant_get(value, "$", "string")
    holds_json = (kind(value) == "string") & (text.rlike(r'^\s*[\[{"\-0-9]') | text.isin("true", "false", "null"))
    inner = F.when(holds_json, F.coalesce(F.try_parse_json(text), value)).otherwise(value)
    first = F.try_variant_get(inner, "$[0]", "variant")
    single = F.when(F.try_variant_get(inner, "$[1]", "variant").isNull() & first.isNotNull(), first).otherwise(inner)
    return F.to_json(single)
