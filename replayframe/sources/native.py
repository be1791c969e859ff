"""Hands out of documents by regular expressions alone, where their fields are plain one-line values.

The census needs a few fields of every hand and a whole document of a few; this
path reads them without a Python worker.  What it can't read is an error row,
and ``hands.hands`` parses those documents in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blocks, header_field, unquoted

CHIPS = "decimal(20,4)"


def _listed(text: Column, name: str) -> Column:
    """The elements of a one-line list as texts, quotes and all; null if there is none."""
    inner = F.regexp_extract(header_field(text, name), r"^\[([^\[\]]*)\]", 1)
    found = header_field(text, name).startswith("[")
    return F.when(found, F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(x)), lambda x: x != ""))


def _chips(values: Column) -> Column:
    """Numbers of a list, null for those that aren't finite or are negative."""
    number = lambda x: F.when(x.try_cast("double") < float("inf"), x.try_cast(CHIPS))
    return F.transform(values, lambda x: F.when(number(x) >= 0, number(x)))


def _actions(text: Column) -> Column:
    """The quoted texts of the list of actions, which may go over several lines: up to the bracket that no quotes hold."""
    at = F.regexp_instr(text, F.lit(r"(?m)^[ \t]*actions[ \t]*="))

    def scan(given: Column) -> Column:
        parts = F.regexp_extract_all(given, F.lit(r"""\]|"[^"]*"|'[^']*'"""), 0)
        items = lambda found: F.slice(found, F.lit(1), F.when(F.array_position(found, "]") > 0, F.array_position(found, "]").cast("int") - 1).otherwise(F.size(found)))
        inner = F.transform(F.array(parts), items)[0]
        return F.when(F.startswith(given, F.lit("[")), F.transform(inner, lambda x: F.substring(x, F.lit(2), F.length(x) - 2)))

    field = F.when(at > 0, F.substring(text, at, F.length(text)))
    value = F.ltrim(F.translate(F.substring(field, F.instr(field, "=") + 1, F.length(field)), "\t", " "))
    return F.transform(F.array(value), scan)[0]


def native_hands(members: DataFrame) -> DataFrame:
    """One row per hand of ``members`` (member, content, error), as ``hands.hands`` gives them, with ``seats``, the number of stacks."""
    many = F.lower("member").endswith(".phhs")
    one = F.array(F.struct(F.lit("1").alias("key"), F.col("content").alias("block")))
    found = F.when(F.col("content").isNotNull(), F.when(many, blocks(F.col("content"))).otherwise(one))
    none = F.coalesce(F.size(found) <= 0, F.lit(True))
    broken = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("content").isNull(), "no text").when(none, "no hand")
    each = members.select("member", broken.alias("__broken"), F.explode_outer(found).alias("__hand"))
    block = F.col("__hand.block")
    stacks = _listed(block, "starting_stacks")
    fields = {"antes": "antes", "blinds": "blinds_or_straddles"}
    rows = each.select(
        "member",
        F.col("__hand.key").alias("hand_key"),
        F.upper(unquoted(header_field(block, "variant"))).alias("variant"),
        *[_chips(_listed(block, field)).alias(name) for name, field in fields.items()],
        header_field(block, "min_bet").try_cast(CHIPS).alias("min_bet"),
        _chips(stacks).alias("stacks"),
        _actions(block).alias("actions"),
        F.when(block.isNotNull(), F.coalesce(F.nullif(F.trim(unquoted(header_field(block, "venue"))), F.lit("")), F.lit("unknown"))).alias("venue"),
        F.coalesce(F.size(stacks), F.lit(0)).alias("seats"),
        "__broken",
    )
    whole = F.lit(True)
    for name in (*fields, "stacks"):
        whole = whole & F.coalesce(~F.exists(name, lambda x: x.isNull()), F.lit(False))
    missing = F.lit(None).cast("string")
    for name in ("actions", "stacks", "blinds", "antes", "variant"):
        missing = F.when(F.col(name).isNull(), f"missing {name}").otherwise(missing)
    return rows.withColumn("finite", whole).withColumn("error", F.coalesce("__broken", missing)).drop("__broken")
