"""The closed vocabulary of encoded hands: a token's id is its place."""

from __future__ import annotations

import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from .buckets import OUTPUTS, labels

# Names and order of the tokens.
STRUCTURE = [
    "<PAD>", "<BOS>", "<EOS>", "<PLAYER_1_DECISION>", "PLAYER_1_HOLE_CARDS", "CURRENT_BOARD", "BOARD_REVEAL",
    "POT_SIZE_BB", "TO_CALL_BB", "STACK_POT", "AMOUNT_BB", "AMOUNT_POT", "STATUS_ACTIVE", "STATUS_ALL_IN",
]
POSITIONS = ["POSITION_SMALL_BLIND", "POSITION_BIG_BLIND", "POSITION_UTG", "POSITION_HIJACK", "POSITION_CUTOFF", "POSITION_BUTTON"]
COUNTS = ["COUNT_1", "COUNT_3", "COUNT_4", "COUNT_5"]
PLAYERS = ["PLAYER_1", "PLAYER_2", "PLAYER_3", "PLAYER_4", "PLAYER_5", "PLAYER_6"]
RANKS, SUITS = "23456789TJQKA", "cdhs"
ACTIONS = ["ACTION_FOLD", "ACTION_CHECK", "ACTION_CALL", "ACTION_BET", "ACTION_RAISE", "ACTION_PASSIVE", "ACTION_ALL_IN"]


def vocabulary() -> list[str]:
    cards = [f"CARD_{rank}{suit}" for rank in RANKS for suit in SUITS]
    return [*STRUCTURE, *POSITIONS, *COUNTS, *PLAYERS, *cards, *ACTIONS, *[f"RANGE_{x}" for x in labels()]]


def decision_tokens() -> list[str]:
    """What a decision can be: fold, passive, the buckets a bet can name, all in."""
    return ["ACTION_FOLD", "ACTION_PASSIVE", *[f"RANGE_{x}" for x in labels()[1 : OUTPUTS + 1]], "ACTION_ALL_IN"]


def ids(tokens: Column) -> Column:
    """Ids of an array of tokens; null for a token that isn't in the vocabulary."""
    return F.transform(tokens, _id)


def _id(token: Column) -> Column:
    """A map is searched from its start, so each token's stands in one of many small ones, named by its checksum."""
    small: list[list[Column]] = [[F.lit(""), F.lit(None).cast("smallint")] for _ in range(256)]
    for i, name in enumerate(vocabulary()):
        small[zlib.crc32(name.encode()) % 256] += [F.lit(name), F.lit(i).cast("smallint")]
    return F.try_element_at(F.get(F.array(*[F.create_map(*x) for x in small]), F.pmod(F.crc32(token), F.lit(256)).cast("int")), token)


def tokens(numbers: Column) -> Column:
    """The tokens of an array of ids; null for an id outside the vocabulary."""
    known = F.array(*[F.lit(x) for x in vocabulary()])
    return F.transform(numbers, lambda i: F.get(known, i.cast("int")))
