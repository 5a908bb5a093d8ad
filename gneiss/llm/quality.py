"""Quality rules: per-text counts, and lines that many documents of one host repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.columns import SPACE, let, words
from gneiss.session import broadcast_if_small, materialise

SYMBOL = r"[#*$%&|<>]"
WINDOW = 8
#: A line of more than this many documents of its host is removed; a text that keeps less than this share of its words goes.
MAX_LINE_DOCS, MIN_KEPT_SHARE = 50, 0.3


def repeated_words(w: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows of ``window`` words that the text has twice or more."""

    def covered(grams: Column) -> Column:
        pairs = F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

        def twice(x: Column) -> Column:
            same = lambda j: F.coalesce(F.get(x, j)["h"], F.get(x, F.lit(0))["h"] + 1)
            keep = F.filter(x, lambda y, j: (F.when(j > 0, same(j - 1) == y["h"]).otherwise(False)) | (F.when(j < F.size(x) - 1, same(j + 1) == y["h"]).otherwise(False)))
            return let(F.sort_array(F.transform(keep, lambda y: y["i"])), lambda at: F.aggregate(F.transform(at, lambda a, j: F.least(F.lit(window), F.coalesce(F.get(at, j + 1) - a, F.lit(window)))), F.lit(0), lambda s, v: s + v))

        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(F.sort_array(pairs), twice))

    grams = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(window)])))
    return F.when(F.size(w) > window, let(grams, covered)).otherwise(F.lit(0))


def normalised(line: Column) -> Column:
    """Lines differ only if their words do; case and digits don't count."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(line, SPACE + "+", " "))), "[0-9]", "0")


def judge(docs: DataFrame, max_line_docs: int = MAX_LINE_DOCS, min_kept_share: float = MIN_KEPT_SHARE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): the base counts, base_failed, n_line_words (words in removed lines) and kept.

    A host is a source, null being one too. Lines are compared as ``normalised``; a line counts once for each document (row)
    that has it, copies of a whole text included. A null text counts as empty and fails; repeated rows each give a row; an empty
    table gives an empty result; other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("l"), F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).alias("n"))), lambda x: x["n"] > 0)
    counted = F.transform(lines, lambda x: F.struct(F.xxhash64(F.col("source"), normalised(x["l"])).alias("key"), x["n"].alias("n")))
    w = words(text)
    rows = docs.select(
        F.col("doc_id").alias("_id"),
        (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        let(F.transform(lines, lambda x: x["l"]), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(w, lambda x: F.struct(F.size(x).cast("long").alias("n_words"), repeated_words(x).cast("long").alias("n_repeat_words"))).alias("w"),
        counted.alias("lines"),
    )
    rows = materialise(rows.withColumn("_row", F.monotonically_increasing_id()), "line-counts")
    holders = rows.select(F.explode(F.array_distinct(F.transform("lines", lambda x: x["key"]))).alias("key")).groupBy("key").agg(F.count("*").alias("documents"))
    common = materialise(holders.filter(F.col("documents") > max_line_docs).select("key"), "common-lines")
    every = rows.select("_row", F.explode("lines").alias("x")).select("_row", "x.key", "x.n")
    removed = every.join(broadcast_if_small(common), "key").groupBy("_row").agg(F.sum("n").alias("gone"))
    failed = (F.col("w.n_words") < 20) | (100 * F.col("w.n_repeat_words") > 30 * F.col("w.n_words"))
    out = rows.select(*[c for c in rows.columns if c != "lines"]).join(removed, "_row", "left")
    out = out.withColumn("gone", F.coalesce("gone", F.lit(0)).cast("long"))
    rest = F.col("w.n_words") - F.col("gone") >= F.lit(min_kept_share) * F.col("w.n_words")
    return out.select(
        F.col("_id").alias("doc_id"), "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words", failed.alias("base_failed"),
        (~failed & rest).alias("kept"), F.col("gone").alias("n_line_words"),
    )


def clean(docs: DataFrame, max_line_docs: int = MAX_LINE_DOCS, min_kept_share: float = MIN_KEPT_SHARE) -> DataFrame:
    """The documents that ``judge`` keeps, with all their columns; repeated rows are judged alike."""
    kept = judge(docs, max_line_docs, min_kept_share).filter("kept").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_id"]), "left_semi")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, source, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
g AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS gram FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) > 7)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM dup) GROUP BY 1),
li AS (SELECT r, source, regexp_replace(lower(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'))), '[0-9]', '0', 'g') AS k,
  len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n FROM (SELECT r, source, unnest(ls) AS l FROM d)),
com AS (SELECT coalesce(source, chr(0)) AS s, k FROM (SELECT DISTINCT r, source, k FROM li) GROUP BY 1, 2 HAVING count(*) > 50),
gone AS (SELECT r, sum(n) AS n FROM li JOIN com ON coalesce(li.source, chr(0)) = com.s AND li.k = com.k GROUP BY 1),
o AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_line_words FROM d LEFT JOIN rep USING (r) LEFT JOIN gone USING (r))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - n_line_words >= CAST(0.3 AS DOUBLE) * n_words AS kept FROM o
"""
