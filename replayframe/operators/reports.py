"""Small result tables as reports: JSON lines and a Markdown table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a report, which a person reads.
MOST_ROWS = 10_000


def markdown(found: DataFrame, title: str, order: list[str]) -> DataFrame:
    """(line): a Markdown table of ``found``, sorted; shares with four places, nulls as n/a."""
    if found.limit(MOST_ROWS + 1).count() > MOST_ROWS:
        raise ValueError(f"a report of more than {MOST_ROWS} rows")
    text = [F.coalesce(F.format_number(c, 4) if t == "double" else F.col(c).cast("string"), F.lit("n/a")) for c, t in found.dtypes]
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *text), F.lit(" |"))
    names = found.columns
    head = [f"# {title}", "", f"| {' | '.join(names)} |", f"|{'-|' * len(names)}"]
    lines = found.agg(F.sort_array(F.collect_list(F.struct(*order, row.alias("__line")))).alias("rows"))
    return lines.select(F.explode(F.concat(F.array(*map(F.lit, head)), F.transform("rows", lambda r: r["__line"]))).alias("line"))


def write_report(found: DataFrame, path: str, title: str, order: list[str], replace: bool = False) -> None:
    """Write ``found`` as ``path/json`` and ``path/markdown``; a report that is there stays unless ``replace``."""
    mode = "overwrite" if replace else "errorifexists"
    found.orderBy(*order).coalesce(1).write.mode(mode).json(f"{path}/json")
    markdown(found, title, order).coalesce(1).write.mode(mode).text(f"{path}/markdown")


def sorted_counts(found: DataFrame, key: str) -> DataFrame:
    """Counts in the order of their keys as text."""
    return found.orderBy(F.col(key).cast("string"))
