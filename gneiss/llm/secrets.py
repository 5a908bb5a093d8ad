"""Secret scan by multipart credential linking.

Strong secrets are found by pattern. Weak candidates (account names and mail addresses, unlabelled high-variety strings, URLs and
network addresses) say little alone; they are reported only when complementary parts stand within one scope of the text.
The interval join of parts with the scopes around others is an equality join on scope-wide buckets: each bucket keeps its first
and last part of each role, which decide whether any lies in reach, so that no pair of parts is ever listed and a text full
of parts costs as much as it is long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.columns import find_spans, span_text
from gneiss.session import materialise

ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
#: Weak parts: an account's name, a key-like string without a label (with a digit, a capital and a small letter), and endpoints.
ACCOUNT = r"""(?i:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@_.-]{3,}+"""
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
OPAQUE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]*[0-9])(?=[A-Za-z0-9+/_=-]*[A-Z])(?=[A-Za-z0-9+/_=-]*[a-z])[A-Za-z0-9+/_=-]{20,}+"
ENDPOINT = r"(?:https?|s3|ssh|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9._:/@%?=&-]{4,}+"
ADDRESS = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?(?![0-9.])"
WEAK = {"account": ACCOUNT, "mail": MAIL, "opaque": OPAQUE, "endpoint": ENDPOINT, "address": ADDRESS}
#: Which part each kind is; a weak part needs a complementary one within the scope.
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "account": "identifier", "mail": "identifier", "opaque": "secret", "endpoint": "endpoint", "address": "endpoint"}
SCOPE = 200


def base_spans(text: Column) -> dict[str, Column]:
    assign = F.filter(
        find_spans(text, ASSIGN),
        lambda x: F.length(F.regexp_extract(x["m"], "^" + ASSIGN, 1)) >= 8,
    )
    return {"assign": assign, "access": find_spans(text, ACCESS), "hex": find_spans(text, HEX)}


def weak_spans(text: Column) -> dict[str, Column]:
    return {k: find_spans(text, p) for k, p in WEAK.items()}


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), scope: int = SCOPE) -> DataFrame:
    """One row per row of ``docs``: the kept columns, base (array of struct(k, s, e) by start, then kind) and linked (the same of
    weak parts whose start is no more than ``scope`` code points from that of a complementary part: an identifier needs a secret, a
    secret an identifier or endpoint, an endpoint an identifier or secret).

    A null text counts as empty. Repeated rows each give a row. An empty table gives an empty result. Other columns of
    ``docs`` are not read, whatever their names.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    base, weak = base_spans(t), weak_spans(t)
    kinds = list(ROLE)

    def tagged(spans: dict[str, Column]) -> Column:
        def one(k: str) -> Column:
            return F.transform(spans[k], lambda x: F.struct(x["s"].alias("s"), F.lit(kinds.index(k)).alias("o"), F.lit(k).alias("k"), x["e"].alias("e")))

        return F.sort_array(F.concat(*map(one, spans)))

    rows = materialise(docs.select(*[F.col(c).alias(f"_{c}") for c in keep], tagged(base).alias("base"), tagged(weak).alias("weak")).withColumn("_row", F.monotonically_increasing_id()), "secret-parts")
    role = F.create_map(*[F.lit(x) for kv in ROLE.items() for x in kv])
    some = rows.filter((F.size("weak") > 0) & (F.size("base") + F.size("weak") > 1))
    parts = some.select("_row", F.explode(F.concat("base", "weak")).alias("p")).select("_row", "p.*", role[F.col("p.k")].alias("role"))
    bucket = (F.col("s") / scope).cast("long")
    ends = parts.withColumn("b", bucket).groupBy("_row", "b").pivot("role", ["identifier", "secret", "endpoint"]).agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    near = ends.select("_row", F.explode(F.array(*[F.col("b") + F.lit(d) for d in (-1, 0, 1)])).alias("to"), *[c for c in ends.columns if c != "_row"])
    sides = near.groupBy("_row", F.col("to").alias("b")).agg(
        *[F.max(F.when(F.col("b") < F.col("to"), F.col(f"{r}_hi"))).alias(f"{r}_left") for r in ("identifier", "secret", "endpoint")],
        *[F.max(F.when(F.col("b") == F.col("to"), F.col(f"{r}_lo"))).alias(f"{r}_here") for r in ("identifier", "secret", "endpoint")],
        *[F.min(F.when(F.col("b") > F.col("to"), F.col(f"{r}_lo"))).alias(f"{r}_right") for r in ("identifier", "secret", "endpoint")],
    )

    def close(r: str) -> Column:
        return F.coalesce(F.col(f"{r}_here").isNotNull() | (F.col("s") - F.col(f"{r}_left") <= scope) | (F.col(f"{r}_right") - F.col("s") <= scope), F.lit(False))

    asks = {"identifier": close("secret"), "secret": close("identifier") | close("endpoint"), "endpoint": close("identifier") | close("secret")}
    told = parts.filter(F.col("k").isin(*WEAK)).withColumn("b", bucket).join(sides, ["_row", "b"])
    hit = F.lit(False)
    for r, ok in asks.items():
        hit = hit | ((F.col("role") == r) & ok)
    linked = told.filter(hit).groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("s", "o", "k", "e"))).alias("linked"))
    none = F.array().cast("array<struct<s:int,o:int,k:string,e:int>>")
    out = rows.join(linked, "_row", "left").withColumn("linked", F.coalesce("linked", none))
    # a weak part that lies on a strong one says nothing new
    apart = F.filter("linked", lambda x: ~F.exists(F.col("base"), lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])))
    return out.select(*[F.col(f"_{c}").alias(c) for c in keep], "base", apart.alias("linked"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from those of ``scan``; a text without findings has zeros, the digest of nothing and ''."""
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(F.concat_ws(",", span_text(F.col("base"))), 256).alias("base_sha256"),
        F.concat_ws(",", span_text(F.sort_array(F.concat("base", "linked")))).alias("spans"),
        F.size("linked").cast("long").alias("n_linked"),
    )
