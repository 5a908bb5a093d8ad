"""Schemas of the graph tables; ord is the row's place, which every limit and window ends in."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODES = (
    "ord long, id string, type string, name string, file string, line_start int, line_end int, language string, params array<string>, "
    "docstring string, return_type string, community int, is_god boolean, is_orphan boolean"
)
EDGES = "ord long, source string, target string, type string, confidence string, weight double, metadata map<string,string>"
REFS = "ord long, source string, raw string, kind string, file string, line int, metadata map<string,string>"
CHANGES = "status string, path string, old_path string"
STATS = "files_parsed int, files_skipped int, languages map<string,int>, errors array<string>"


def split(schema: str) -> list[str]:
    """The columns of a schema, each with its type; commas within types don't count."""
    return re.split(r", (?![^<]*>)", schema)


def defaults() -> dict[str, Column]:
    """The values of columns of nodes and edges that are null: no parameters, no metadata, extracted, weight one, no flags."""
    return {"params": F.array().cast("array<string>"), "metadata": F.create_map().cast("map<string,string>"), "confidence": F.lit("EXTRACTED"), "weight": F.lit(1.0), "is_god": F.lit(False), "is_orphan": F.lit(False)}


def filled(rows: DataFrame) -> DataFrame:
    """Nodes or edges with the defaults of columns that are null."""
    return rows.withColumns({c: F.coalesce(c, v) for c, v in defaults().items() if c in rows.columns})
