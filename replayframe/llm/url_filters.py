"""URL filters: hashed host-suffix and path-prefix expressions.

Each distinct URL is expanded into the expressions that a rule could have: the
suffixes of its host at dots, each with the prefixes of its path of the lengths
that rules have.  Expressions and rules meet in an equi-join on a short prefix
of their digests; the full digest then confirms, and the longest rule wins (of
equally long ones the longer host, then block before allow).  Only DataFrame
functions are used.

Defined results: a null URL and one without ``://`` have an empty host and path
and fit no rule; a URL that no rule fits has a null rule and the verdict
``allow``; without rules all are allowed; of rules for the same host and path,
block wins; repeated rows are judged each for itself; an empty table gives an
empty one; other columns pass through, whatever their names, and columns named
like results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fields, struct_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of a digest that the join compares.
SHORT = 8
#: So many rules, of some 200 bytes, are sent to all executors; of more, each stands in so many places.
FEW_RULES, SALTS = 100_000, 32
RESULTS = ("host", "path", "rule", "verdict")


def rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(rest(url), r"^[^/?#]*([^?#]*)", 1)


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("\n", host, path), 256)


def _known(rules: DataFrame) -> DataFrame:
    """The best of the rules of each digest, with the start of the digest."""
    each = rules.select(
        F.struct(
            (F.length("host") + F.length("path")).alias("long"),
            F.length("host").alias("host_long"),
            (F.col("verdict") == "block").cast("int").alias("block"),
            F.concat("host", "path").alias("rule"),
            F.col("verdict").alias("verdict"),
        ).alias("rule"),
        digest(F.col("host"), F.col("path")).alias("full"),
    )
    return each.groupBy("full").agg(F.max("rule").alias("rule")).withColumn("short", F.left("full", F.lit(SHORT)))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", few: int = FEW_RULES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has the columns verdict (allow or block), host and path.  The
    numbers of labels and the lengths of paths in it, a few integers, set how
    far URLs are expanded.  Up to ``few`` rules go to all executors.  More are
    joined by their digests; as all URLs of a domain share some, each rule then
    stands in ``SALTS`` places, and a URL looks in one of them.
    """
    shape = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("labels"), F.sort_array(F.collect_set(F.length("path"))).alias("lengths"), F.count("*").alias("n")).first()
    at = F.size("labels")
    suffixes = F.transform(
        F.sequence(F.greatest(F.lit(1), at - F.lit(shape["labels"] or 1) + 1), at),
        lambda i: F.array_join(F.slice("labels", i, at), "."),
    )
    lengths = F.array(*[F.lit(n) for n in shape["lengths"]]).cast("array<int>")
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    asked = pages.select(F.col(f"`{url}`").alias("url")).where(host(F.col("url")) != "").distinct()
    expressions = (
        asked.withColumns({"labels": F.split(host(F.col("url")), r"\."), "path": path(F.col("url"))})
        .select("url", "path", F.explode(suffixes).alias("host"))
        .select("url", "host", F.explode(prefixes).alias("path"))
        .withColumn("digest", digest(F.col("host"), F.col("path")))
        .select("url", "digest", F.left("digest", F.lit(SHORT)).alias("short"))
    )
    known, keys = _known(rules), ["short"]
    if shape["n"] <= few:
        known = F.broadcast(known)
    else:
        known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        expressions, keys = expressions.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int")), ["short", "salt"]
    judged = (
        expressions.join(known, keys)
        .where(F.col("digest") == F.col("full"))
        .groupBy("url")
        .agg(F.max("rule").alias("__rule"))
        .withColumnRenamed("url", "__url")
    )
    found = F.col("__asked")
    # rows that no rule can fit are spread by the task that reads them, and meet none
    nowhere = F.concat(F.lit("\0"), F.spark_partition_id().cast("string"))
    rows = pages.select(struct_of(pages, *RESULTS).alias("__row"), F.col(f"`{url}`").alias("__asked"))
    rows = rows.withColumn("__url", F.when(F.coalesce(host(found), F.lit("")) != "", found).otherwise(nowhere))
    return rows.join(judged, "__url", "left").select(
        *fields(pages, "__row", *RESULTS),
        F.coalesce(host(found), F.lit("")).alias("host"),
        F.coalesce(path(found), F.lit("")).alias("path"),
        F.col("__rule.rule").alias("rule"),
        F.coalesce("__rule.verdict", F.lit("allow")).alias("verdict"),
    )
