"""Hand documents (TOML) as rows: one for ``.phh`` members, one for each table of ``.phhs`` members."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal, InvalidOperation

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SCHEMA = (
    "member string, hand_key string, variant string, antes array<decimal(20,4)>, blinds array<decimal(20,4)>, min_bet decimal(20,4), "
    "stacks array<decimal(20,4)>, actions array<string>, venue string, finite boolean, error string"
)
#: Chips have no more places than this; a finer number is an error, never rounded.
PLACES = Decimal("0.0001")


def _chips(value) -> Decimal | None:
    """A finite number that isn't negative, or null."""
    if isinstance(value, bool) or not isinstance(value, int | Decimal):
        raise TypeError("no number")
    number = Decimal(value)
    if not number.is_finite() or number < 0:
        return None
    exact = number.quantize(PLACES)
    if exact != number or exact >= 10**16:
        raise InvalidOperation
    return exact


def _hand(member: str, key: str, hand: dict) -> dict:
    row = {"member": member, "hand_key": key, "finite": True}
    try:
        row["variant"] = str(hand["variant"]).upper()
        row["venue"] = str(hand.get("venue", "")).strip() or "unknown"
        row["actions"] = [str(x) for x in hand["actions"]]
        row["min_bet"] = _chips(hand["min_bet"]) if "min_bet" in hand else None
        for name, field in (("antes", "antes"), ("blinds", "blinds_or_straddles"), ("stacks", "starting_stacks")):
            row[name] = [_chips(x) for x in hand[field]]
            row["finite"] &= None not in row[name]
    except KeyError as e:
        row["error"] = f"missing {e.args[0]}"
    except TypeError:
        row["error"] = "not the type of its field"
    except InvalidOperation:
        row["error"] = "number out of range or of more than four places"
    return row


def _parse(member: str, text: str | None, error: str | None) -> Iterator[dict]:
    import tomllib

    if text is None:
        yield {"member": member, "error": error or "no text"}
        return
    try:
        found = tomllib.loads(text, parse_float=Decimal)
    except (tomllib.TOMLDecodeError, InvalidOperation):
        yield {"member": member, "error": "invalid TOML"}
        return
    tables = {k: v for k, v in found.items() if isinstance(v, dict)} if member.lower().endswith(".phhs") else {"1": found}
    if not tables:
        yield {"member": member, "error": "no hand"}
    for key, hand in tables.items():
        yield _hand(member, key, hand)


def hands(members: DataFrame) -> DataFrame:
    """One row per hand of ``members`` (member, content, error); what can't be read is a row with ``error``."""

    def parse(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [row for values in zip(*(batch.column(i).to_pylist() for i in range(3))) for row in _parse(*values)]
            yield pa.RecordBatch.from_pylist([{k: row.get(k) for k in schema.names} for row in rows], schema=schema)

    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))
    return members.select("member", "content", "error").mapInArrow(parse, SCHEMA)


def whole_members(hands: DataFrame) -> DataFrame:
    """Hands of the members none of whose hands failed."""
    failed = hands.where(F.col("error").isNotNull()).select("member").distinct()
    return hands.join(failed, "member", "left_anti")
