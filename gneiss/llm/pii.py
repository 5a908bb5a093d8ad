"""Personal data: patterns for the entities themselves, and information-theoretic sanitisation for terms that reveal them.

How much a term t tells about an entity e is estimated from the corpus: with n(e) the distinct contexts of e, n(e, t)
those that hold t, n(t) the distinct texts that hold t and N all distinct texts,

    pmi(e, t) = log2(n(e, t) * N / (n(e) * max(n(t), n(e, t)))),    ic(e) = log2(N / n(e)).

A term discloses e when it gives at least ``share`` of ic(e), at least ``bits`` bits (by default half of log2(N), so that the
threshold follows the corpus), and the estimate rests on at least ``support`` distinct contexts: a single one is no co-occurrence.
Copies of a text or context count once, so that copying is not taken for evidence.
Disclosing terms are generalised to a placeholder wherever they stand, unless they lie in an entity found by pattern.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.columns import find_spans, let, replace_spans, span_text
from gneiss.session import broadcast_if_small, materialise

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
#: Shorter runs than 16 digits are dropped anyway, so texts without a longer one are not walked.
CARD_SEEN = r"[0-9](?:[\x20-]?[0-9]){15}"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"(?<![\p{L}\p{N}])\p{L}[\p{L}\p{N}]{2,}+"
KINDS = ("email", "ip", "card", "phone")
PLACEHOLDER = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "term": "<TERM>"}
CONTEXT, SUPPORT, SHARE = 120, 2, 0.9
_LIST = "array<struct<o:int,s:int,k:string,e:int,m:string>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    """Whether 16 to 19 digits pass the Luhn check; from the right every second digit is doubled."""

    def check(d: Column) -> Column:
        n = F.length(d)

        def add(acc: Column, i: Column) -> Column:
            x = F.substring(d, n - i, F.lit(1)).cast("int")
            twice = x * 2
            return acc + F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(x)

        return F.when(n.between(16, 19), F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0).otherwise(False)

    return let(_digits(m), check)


def _octets(m: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+(?=[0-9])", "")
        return F.when(F.length(bare) <= 3, bare.cast("int") <= 255).otherwise(False)

    return F.forall(F.split(m, r"\."), small)


def entity_spans(text: Column) -> dict[str, Column]:
    """The spans of each kind; text must not be null."""
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    return {
        "email": F.when(F.contains(text, F.lit("@")), find_spans(text, EMAIL)).otherwise(none),
        "ip": F.filter(find_spans(text, IP), lambda x: _octets(x["m"])),
        "card": F.when(F.regexp_like(text, F.lit(CARD_SEEN)), F.filter(find_spans(text, CARD), lambda x: _luhn(x["m"]))).otherwise(none),
        "phone": F.when(F.contains(text, F.lit("+")), F.filter(find_spans(text, PHONE), lambda x: F.length(_digits(x["m"])).between(8, 15))).otherwise(none),
    }


def _tagged(text: Column) -> Column:
    spans = entity_spans(text)

    def one(k: str) -> Column:
        return F.transform(spans[k], lambda x: F.struct(F.lit(KINDS.index(k)).alias("o"), x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), x["m"].alias("m")))

    return F.concat(*map(one, KINDS))


def _context(text: Column, x: Column, width: int) -> Column:
    """The terms within ``width`` code points of a span, without words that the cut halves, sorted and once each."""
    left = F.substring(text, F.greatest(F.lit(1), x["s"] - width + 1), F.least(x["s"], F.lit(width)))
    left = F.when(x["s"] > width, F.regexp_replace(left, r"^[^\x20\x09-\x0D]*", "")).otherwise(left)
    right = F.substring(text, x["e"] + 1, F.lit(width))
    right = F.when(F.length(right) == width, F.regexp_replace(right, r"[^\x20\x09-\x0D]*$", "")).otherwise(right)
    return F.array_sort(F.array_distinct(terms(F.concat_ws(" ", left, right))))


def terms(text: Column) -> Column:
    """Lower-cased terms of a text outside e-mail addresses."""
    bare = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, EMAIL, " ")).otherwise(text)
    return F.regexp_extract_all(F.lower(bare), F.lit(TERM), F.lit(0))


def scan(docs: DataFrame, context: int = CONTEXT, support: int = SUPPORT, share: float = SHARE, bits: float | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, _h (hash of the text), base and added (arrays of struct(o, s, k, e, m)).

    A null text counts as empty. Repeated rows each give a row, with the same spans. An empty table gives an empty
    result. Other columns are not read, whatever their names. Terms of entities that stand in fewer than ``support``
    distinct contexts are never removed.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = docs.select(F.col("doc_id").alias("_id"), text.alias("_t"), F.xxhash64(text).alias("_h"))
    told = let(_tagged(F.col("_t")), lambda base: F.transform(base, lambda x: F.struct(x.alias("x"), _context(F.col("_t"), x, context).alias("c"))))
    rows = materialise(whole.select("_id", "_h", told.alias("told")), "entities")

    n = rows.agg(F.countDistinct("_h").alias("n")).first()["n"]
    bits = math.log2(max(n, 1)) / 2 if bits is None else bits
    told = rows.select("_h", F.explode("told").alias("y")).select("_h", F.concat_ws(":", "y.x.k", F.lower("y.x.m")).alias("entity"), F.col("y.c").alias("c"), F.xxhash64("y.c").alias("ctx"))
    seen = told.dropDuplicates(["entity", "ctx"])

    def telling(n_t: Column) -> Column:
        pmi = F.log2(F.col("n_et") * F.lit(float(n)) / (F.col("n_e") * F.greatest(n_t, F.col("n_et"))))
        return (pmi >= bits) & (pmi >= share * F.log2(F.lit(float(n)) / F.col("n_e")))

    # the texts that hold a term near any entity are some of those that hold it at all, so a term that fails with them alone is out
    near = told.select("_h", F.explode("c").alias("term")).groupBy("term").agg(F.countDistinct("_h").alias("n_near"))
    entities = seen.groupBy("entity").agg(F.count("*").alias("n_e")).filter(F.col("n_e") >= support)
    pairs = seen.select("entity", F.explode("c").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("n_et")).filter(F.col("n_et") >= support)
    pairs = materialise(pairs.join(entities, "entity").join(near, "term").filter(telling(F.col("n_near"))), "disclosure")
    candidates = materialise(pairs.select("term").distinct(), "terms")
    none = F.array().cast(_LIST)
    if candidates.isEmpty():
        return rows.select("_id", "_h", F.col("told.x").alias("base"), none.alias("added"))

    tokens = whole.select("_id", "_h", F.explode(F.array_distinct(terms(F.col("_t")))).alias("term"))
    held = materialise(tokens.join(broadcast_if_small(candidates), "term").distinct(), "held-terms")
    n_t = held.groupBy("term").agg(F.countDistinct("_h").alias("n_t"))
    certain = pairs.join(n_t, "term").filter(telling(F.col("n_t"))).select("term").distinct()
    marked = materialise(held.join(certain, "term").groupBy("_id", "_h").agg(F.collect_set("term").alias("terms")), "marked")
    if marked.isEmpty():
        return rows.select("_id", "_h", F.col("told.x").alias("base"), none.alias("added"))
    hit = whole.withColumnsRenamed({"_id": "_i", "_h": "_g"}).join(broadcast_if_small(marked), F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_g") == F.col("_h")))
    found = F.filter(find_spans(F.col("_t"), TERM), lambda x: F.array_contains(F.col("terms"), F.lower(x["m"])))
    found = F.transform(found, lambda x: F.struct(F.lit(len(KINDS)).alias("o"), x["s"].alias("s"), F.lit("term").alias("k"), x["e"].alias("e"), x["m"].alias("m")))
    hit = hit.select("_i", "_g", found.alias("found")).dropDuplicates(["_i", "_g"])
    out = rows.join(hit, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_g")), "left")
    apart = F.filter(F.col("found"), lambda x: ~F.exists(F.col("told.x"), lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])))
    return out.select("_id", "_h", F.col("told.x").alias("base"), F.coalesce(apart, none).alias("added"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from those of ``scan``; a text without findings has zeros, the digest of nothing and ''."""
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        F.col("_id").alias("doc_id"), *[count(k) for k in KINDS],
        F.sha2(F.concat_ws(",", span_text(F.col("base"))), 256).alias("base_sha256"),
        F.concat_ws(",", span_text(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_terms"),
    )


def sanitise(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with the same columns, entities and disclosing terms in ``text`` replaced by placeholders; null texts stay null.

    Repeated rows are treated alike; an empty table gives an empty result; other columns are kept, whatever their names.
    """
    found = scan(docs.select("doc_id", "text"), **settings)
    to = F.create_map(*[F.lit(x) for kv in PLACEHOLDER.items() for x in kv])
    spans = F.sort_array(F.transform(F.concat("base", "added"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), to[x["k"]].alias("to"))))
    key = lambda i, h: F.struct(i.alias("i"), h.alias("h"))
    spans = found.filter(F.size("base") + F.size("added") > 0).select(key(F.col("_id"), F.col("_h")).alias("key"), spans.alias("spans")).dropDuplicates(["key"])
    spans = materialise(spans, "spans")
    rows = docs.select(F.struct(*docs.columns).alias("d"), key(F.col("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit("")))).alias("own"))
    joined = rows.join(broadcast_if_small(spans), F.col("own").eqNullSafe(F.col("key")), "left")
    text = F.col("d.text")
    new = F.when(F.col("spans").isNull(), text).otherwise(replace_spans(text, F.col("spans")))
    return joined.select(*[new.alias(c) if c == "text" else F.col("d").getField(c).alias(c) for c in docs.columns])
