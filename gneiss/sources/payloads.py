"""Payloads: trees as JSON texts, objects with lists of nodes, edges and references, read as typed rows and written back.

A text is parsed once, as a VARIANT. Each element of a list becomes a row of typed columns; what does not fit them (fields that the schema
doesn't name, values of another kind) stays a VARIANT in ``rescued``, so nothing is lost on the way back. Texts that are no payload, and
elements that are no objects, are rows with an error. Any number of payloads is read at once; only one text has to fit into a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss import schemas

LISTS = {"nodes": schemas.NODES, "edges": schemas.EDGES, "refs": schemas.REFS}
#: Kinds of JSON values that a column of a type takes as they are; objects are looked at value by value.
KINDS = {"string": "STRING", "boolean": "BOOLEAN", "int": "BIGINT", "long": "BIGINT", "double": "BIGINT|DOUBLE|DECIMAL.*", "array<string>": "ARRAY<(STRING|VOID)>"}


def _fields(schema: str) -> list[tuple[str, str]]:
    return [tuple(x.split(" ")) for x in schemas.split(schema)]


def _members(value: Column) -> Column:
    """The fields of an object, null if it is none."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def parsed(payloads: DataFrame) -> DataFrame:
    """tree_id, body, error of each row of ``payloads`` (tree_id, payload; other columns are left out).

    Errors, null where there is none: "no payload" (null), "not JSON" (an empty text, a broken one, one with a repeated field), "not an
    object", and "nodes is not a list" (or edges, or refs; a list that is absent or null is empty). The body of an error row is null.
    """
    read = payloads.select("tree_id", "payload", F.try_parse_json("payload").alias("body"))
    body = F.col("body")
    error = F.when(F.col("payload").isNull(), "no payload").when(body.isNull(), "not JSON").when(_members(body).isNull(), "not an object")
    for part in LISTS:
        kind = F.schema_of_variant(F.try_variant_get(body, f"$.{part}", "variant"))
        error = error.when(~F.startswith(kind, F.lit("ARRAY")) & (kind != "VOID"), f"{part} is not a list")
    return read.select("tree_id", "body", error.alias("error")).withColumn("body", F.when(F.col("error").isNull(), body))


def rows(trees: DataFrame, part: str) -> DataFrame:
    """The elements of a list (nodes, edges or refs) of parsed trees, see ``typed``; trees with an error have none."""
    found = F.try_variant_get("body", f"$.{part}", "array<variant>")
    return typed(trees.filter("error IS NULL").select("tree_id", F.posexplode(found).alias("place", "element")), part)


def typed(elements: DataFrame, part: str) -> DataFrame:
    """tree_id, place, the columns of the list's schema, rescued and error of elements (tree_id, place, element as VARIANT).

    A field that is absent or null takes its default, ``ord`` the place. One whose value doesn't fit is null, and its value is rescued. An
    element that is no object is "not an object": its columns are null and it is rescued whole.
    """
    element, defaults = F.col("element"), schemas.defaults() | {"ord": F.col("place").cast("long")}
    fields = _members(element)
    columns, taken = [], []
    for name, kind in _fields(LISTS[part]):
        raw = F.try_variant_get(element, f"$.{name}", "variant")
        absent = raw.isNull() | (F.schema_of_variant(raw) == "VOID")
        if kind in KINDS:
            fits = F.rlike(F.schema_of_variant(raw), F.lit(f"^({KINDS[kind]})$"))
        else:
            fits = F.forall(F.map_values(_members(raw)), lambda x: F.schema_of_variant(x) == "STRING")
        value = F.when(fits, F.try_variant_get(element, f"$.{name}", kind))
        taken.append(F.when(absent | value.isNotNull(), name))
        columns.append(F.when(absent & fields.isNotNull(), defaults[name]).otherwise(value).alias(name) if name in defaults else value.alias(name))
    known = F.array_compact(F.array(*taken))
    rest = F.map_filter(fields, lambda k, _: ~F.array_contains(known, k))
    rescued = F.when(fields.isNull(), element).when(F.size(rest) > 0, F.parse_json(F.to_json(rest)))
    return elements.select("tree_id", "place", *columns, rescued.alias("rescued"), F.when(fields.isNull(), "not an object").alias("error"))


def elements(rows: DataFrame, part: str) -> DataFrame:
    """tree_id, place, element (JSON text) of typed rows: rescued fields stand beside typed ones, which win where both are there.

    Null columns are left out. Lists are written an element a row, never as one text of a tree.
    """
    names = [n for n, _ in _fields(LISTS[part])]
    own, rest = _members(F.parse_json(F.to_json(F.struct(*names)))), _members(F.col("rescued"))
    both = F.when(rest.isNull(), own).otherwise(F.map_concat(own, F.map_filter(rest, lambda k, _: ~F.array_contains(F.map_keys(own), k))))
    return rows.select("tree_id", "place", F.when(F.col("error").isNotNull(), F.to_json("rescued")).otherwise(F.to_json(both)).alias("element"))
