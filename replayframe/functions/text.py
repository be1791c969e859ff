"""Regular-expression projections of raw text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def header_field(text: Column, name: str) -> Column:
    """The value of the first line ``name = value``; null if there is none."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?m)^[ \t]*{name}[ \t]*=[ \t]*([^\r\n]*)$", 1)), F.lit(""))


def unquoted(value: Column) -> Column:
    """What a field holds in quotes; null if it isn't in quotes or in unlike ones."""
    return F.nullif(F.regexp_extract(value, r"""^(?:'([^']*)'|"([^"]*)")""", 0), F.lit("")).substr(F.lit(2), F.length(F.regexp_extract(value, r"""^(?:'[^']*'|"[^"]*")""", 0)) - 2)


def _lines(text: Column) -> Column:
    return F.split(text, "\r\n|\r|\n")


def _bare(line: Column) -> Column:
    return F.trim(F.translate(line, "\t", " "))


def _titled(line: Column) -> Column:
    """Whether a line begins a table: a name in brackets and nothing else."""
    bare = _bare(line)
    inner = F.substring(bare, F.lit(2), F.length(bare) - 2)
    plain = (F.length(inner) > 0) & (F.instr(inner, "[") == 0) & (F.instr(inner, "]") == 0)
    return F.startswith(bare, F.lit("[")) & F.endswith(bare, F.lit("]")) & plain


def tables(text: Column) -> Column:
    """How many tables a document has."""
    return F.size(F.filter(_lines(text), _titled))


def blocks(text: Column) -> Column:
    """(key, block) of each table of a document, in order: the lines after its title, up to the next title."""

    def cut(given: Column) -> Column:
        places = F.filter(F.transform(given, lambda line, i: F.when(_titled(line), i + 1)), lambda i: i.isNotNull())

        def between(ends: Column) -> Column:
            def block(start: Column, k: Column) -> Column:
                title = _bare(F.get(given, start - 1))
                body = F.slice(given, start + 1, F.get(ends, k + 1) - start - 1)
                return F.struct(F.trim(F.substring(title, F.lit(2), F.length(title) - 2)).alias("key"), F.array_join(body, "\n").alias("block"))

            return F.transform(F.slice(ends, F.lit(1), F.size(ends) - 1), block)

        return F.transform(F.array(F.concat(places, F.array(F.size(given) + 1))), between)[0]

    return F.transform(F.array(_lines(text)), cut)[0]


def list_literal(text: Column, kind: str) -> Column:
    """``[a, b]`` as an array; null if it is no list or any element can't be cast."""
    inner = F.regexp_extract(text, r"^\s*\[([^\[\]]*)\]\s*$", 1)
    parts = F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(F.regexp_replace(x, r"['\"]", ""))), lambda x: x != "")
    values = F.transform(parts, lambda x: x.try_cast(kind))
    return F.when(text.rlike(r"^\s*\[[^\[\]]*\]\s*$") & ~F.exists(values, lambda v: v.isNull()), values)


def first_match(value: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """The name of the first rule whose text occurs in ``value``."""
    out = F.lit(other)
    for needle, name in reversed(rules):
        out = F.when(F.contains(value, F.lit(needle)), name).otherwise(out)
    return out


def cascade(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check that fails; a check of unknown result fails; null if all hold."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(checks):
        out = F.when(F.coalesce(holds, F.lit(False)), out).otherwise(name)
    return out


def cards(text: Column) -> Column:
    """``AsKd`` as an array of cards, an even run of ``?`` as unknown ones; null if anything is left over."""
    found = F.array(F.regexp_extract_all(text, F.lit(r"([2-9TJQKA][cdhs]|\?\?)"), 1))
    return F.transform(found, lambda x: F.when(F.array_join(x, "") == text, x))[0]
