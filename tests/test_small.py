"""Small column functions on their usual values, nulls and edges."""

from pyspark.sql import functions as F

from gneiss.functions import text as X
from gneiss.operators import render


def test_small_functions_on_edges(spark):
    null = F.lit(None).cast("string")
    wanted = {
        "glob": (X.glob_of(F.lit("no such language")), "**/*"), "no_language": (X.glob_of(null), "**/*"),
        "line": (X.first_line(F.lit("  One line. \n two")), "One line."), "no_doc": (X.first_line(null), ""), "long": (X.first_line(F.lit("x" * 200)), "x" * 120),
        "sha": (X.short_sha(F.lit("0123456789abcdef")), "01234567"), "short": (X.short_sha(F.lit("ab")), "ab"), "no_sha": (X.short_sha(null), None),
        "colour": (X.colour_index(F.lit(13), 5), 3), "below": (X.colour_index(F.lit(-1), 5), 4), "none": (X.colour_index(F.lit(None).cast("int"), 5), None),
        "priority": (X.edge_priority(F.lit("no such kind")), 99), "no_kind": (X.edge_of_kind(null), None),
        "generic": (X.strip_generics(F.lit("Map<K, V[]> ")), "Map"), "array": (X.strip_generics(F.lit("int[]")), "int"), "kept": (X.strip_generics(F.lit("int[]"), False), "int[]"),
    }
    got = spark.range(1).select(*[c.alias(k) for k, (c, _) in wanted.items()]).first().asDict()
    assert got == {k: v for k, (_, v) in wanted.items()}


def test_totals_take_null_as_nothing(spark):
    rows = spark.createDataFrame([(1.5, 3), (None, None), (2.0, 4)], "cost double, tokens long")
    assert tuple(render.totals(rows, ["cost", "tokens"]).first()) == (3.5, 7) and tuple(render.totals(rows.limit(0), ["cost", "tokens"]).first()) == (0.0, 0)
