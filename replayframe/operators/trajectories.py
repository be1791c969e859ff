"""Each player's view of a replayed hand, as tokens, ids and a mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import range_bucket
from ..functions.vocabulary import PLAYERS, POSITIONS, decision_tokens, ids
from .once import let, once

#: Every seat starts with so many big blinds.
DEPTH = 100
SEATS = 6


def _range(value: Column, base: Column) -> Column:
    return F.concat(F.lit("RANGE_"), range_bucket(value, base, exact=True))


def _player(seat: Column, hero: Column) -> Column:
    """The seat's number as seen from the hero's, who is 1."""
    return F.get(F.array(*map(F.lit, PLAYERS)), F.pmod(seat - hero, F.lit(SEATS)).cast("int"))


def _dealt(cards: Column) -> Column:
    return F.transform(cards, lambda c: F.concat(F.lit("CARD_"), c))


def _count(cards: Column) -> Column:
    return F.concat(F.lit("COUNT_"), F.size(cards).cast("string"))


def target(it: Column) -> Column:
    """The token of a decision: fold, passive, all in, or the bucket of its share of the pot."""
    stack = F.get(it.stacks, it.player)
    return (
        F.when(it.action == "FOLD", "ACTION_FOLD")
        .when(it.action.isin("CHECK", "CALL"), "ACTION_PASSIVE")
        .when(it.amount == stack, "ACTION_ALL_IN")
        .otherwise(_range(it.amount, F.greatest(it.pot, F.col("big_blind"))))
    )


def _seen(it: Column) -> Column:
    """A decision's tokens for its own player: cards, board, pot, what is owed, the other seats, and the choice last."""
    none = F.array().cast("array<string>")

    def seat(stack, i):
        who = _player(i, it.player)
        playing = F.when(stack == 0, F.array(who, F.lit("STATUS_ALL_IN"))).otherwise(F.array(who, F.lit("STATUS_ACTIVE"), F.lit("STACK_POT"), _range(stack, it.pot)))
        return F.when(~F.get(it.active, i), none).otherwise(playing)

    return F.concat(
        F.array(F.lit("<PLAYER_1_DECISION>"), F.lit("PLAYER_1_HOLE_CARDS")),
        _dealt(F.get(F.col("holes"), it.player)),
        F.when(F.size(it.board) > 0, F.concat(F.array(F.lit("CURRENT_BOARD"), _count(it.board)), _dealt(it.board))).otherwise(none),
        F.array(F.lit("POT_SIZE_BB"), _range(it.pot, F.col("big_blind")), F.lit("TO_CALL_BB"), _range(it.to_call, F.col("big_blind"))),
        F.flatten(F.transform(it.stacks, seat)),
        F.array(target(it)),
    )


def _public(it: Column) -> Column:
    """What the others see of an event, after the name of its player."""
    none = F.array().cast("array<string>")
    amount = lambda: F.array(F.lit("AMOUNT_BB"), _range(it.amount, F.col("big_blind")), F.lit("AMOUNT_POT"), _range(it.amount, F.greatest(it.pot, F.col("big_blind"))))
    return (
        F.when(it.kind == "board", F.concat(F.array(F.lit("BOARD_REVEAL"), _count(it.cards)), _dealt(it.cards)))
        .when(it.kind == "action", F.concat(F.array(F.concat(F.lit("ACTION_"), it.action)), F.when(it.amount > 0, amount()).otherwise(none)))
        .otherwise(none)
    )


def _known(seat: Column) -> Column:
    """Whether a seat's two cards are known."""
    held = F.get(F.col("holes"), seat)
    return (F.size(held) == 2) & ~F.array_contains(held, "??")


def _acting(replayed: DataFrame) -> DataFrame:
    """A row per hand and player who acted, and whether their two cards are known."""
    acted = F.array_distinct(F.transform(F.filter("items", lambda x: x.kind == "action"), lambda x: x.player))
    each = replayed.where(F.col("error").isNull()).withColumn("hero", F.explode(acted))
    return each.withColumn("__known", _known(F.col("hero")))


def heroes(replayed: DataFrame) -> DataFrame:
    """A row per hand and player who acted and whose two cards are known; ``items`` end with their last action."""
    last = F.array_max(F.transform("items", lambda x, i: F.when((x.kind == "action") & (x.player == F.col("hero")), i)))
    return _acting(replayed).where("__known").drop("__known").withColumn("items", F.slice("items", 1, last + 1))


def unknown_heroes(replayed: DataFrame) -> DataFrame:
    """One row (players, hands): players who acted but whose cards aren't known, so that no trajectory is made for them."""
    return _acting(replayed).where("not coalesce(__known, false)").agg(F.count("*").alias("players"), F.count_distinct("member", "hand_key").alias("hands"))


def _told(replayed: DataFrame) -> DataFrame:
    """``replayed`` with ``items`` as tokens, once for a hand and not for each of its heroes; ``__sb``, the small blind's seat, and ``__wrong``, why no view of the hand can be encoded."""
    blinds = F.filter("items", lambda x: x.kind.isin("blind", "straddle", "ante"))
    bb = F.col("big_blind")

    def posted(two: Column) -> Column:
        """The small blind's seat, if two have posted, and whether their blinds fit."""
        first = two[0].amount < two[1].amount
        small, big = (F.when(first, a).otherwise(b) for a, b in ((two[0], two[1]), (two[1], two[0])))
        even = (small.amount * 2 == bb) & (big.amount == bb) & (F.pmod(big.player - small.player, F.lit(SEATS)) == 1)
        return F.when(F.size(two) == 2, F.struct(small.player.alias("sb"), even.alias("even")))

    acts = lambda x: x.kind == "action"
    none = F.lit(None).cast("array<string>")
    event = lambda x, seen, public, aim: F.struct(x.kind.alias("kind"), x.player.alias("player"), seen.alias("seen"), public.alias("public"), aim.alias("target"))
    whole = lambda x: event(x, F.when(acts(x) & _known(x.player), _seen(x)), _public(x), F.when(acts(x), target(x)))
    bare = lambda x: event(x, none, none, F.lit(None).cast("string"))

    def told(post: Column) -> Column:
        wrong = F.when(F.size("stacks") != SEATS, "seats").when(~F.coalesce(post.even, F.lit(False)), "blinds").when(~F.forall("stacks", lambda s: s == DEPTH * bb), "depth")
        items = lambda w: F.when(w.isNull(), F.transform("items", whole)).otherwise(F.transform("items", bare))
        return let(wrong, lambda w: F.struct(post.sb.alias("sb"), w.alias("wrong"), items(w).alias("items")))

    each = once(replayed, {"__told": let(let(blinds, posted), told)})
    return each.select(*[c for c in replayed.columns if c != "items"], *[F.col("__told")[c].alias(n) for c, n in (("sb", "__sb"), ("wrong", "__wrong"), ("items", "items"))])


def trajectories(replayed: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """member, hand_key, hero, tokens, ids, loss_mask, decision_count, token_len, error, and the columns of the hand to ``keep``.

    Only six seats, all with 100 big blinds, one small and one big blind side
    by side, can be encoded; other hands, and targets that no decision can
    name, have an error and no tokens.
    """
    each = heroes(_told(replayed))
    own = lambda x: (x.kind == "action") & (x.player == F.col("hero"))
    targets = F.filter("items", own)
    error = F.coalesce("__wrong", F.when(F.exists(targets, lambda x: ~x.target.isin(decision_tokens())), "target"))
    place = F.get(F.array(*map(F.lit, POSITIONS)), F.pmod(F.col("hero") - F.col("__sb"), F.lit(SEATS)).cast("int"))
    seen = lambda x: F.when(own(x), x.seen).when(x.kind == "action", F.concat(F.array(_player(x.player, F.col("hero"))), x.public)).otherwise(x.public)
    tokens = F.concat(F.array(F.lit("<BOS>"), place), F.flatten(F.transform("items", seen)), F.array(F.lit("<EOS>")))
    zero, one = (F.lit(n).cast("tinyint") for n in (0, 1))
    others = lambda x: F.size(x.public) + F.when(x.kind == "action", 1).otherwise(0)
    marks = F.transform("items", lambda x: F.when(own(x), F.concat(F.array_repeat(zero, F.size(x.seen) - 1), F.array(one))).otherwise(F.array_repeat(zero, others(x))))
    good = F.col("error").isNull()
    return each.withColumn("error", error).select(
        "member",
        "hand_key",
        "hero",
        *keep,
        F.when(good, tokens).alias("tokens"),
        F.when(good, F.concat(F.array(zero, zero), F.flatten(marks), F.array(zero))).alias("loss_mask"),
        F.when(good, F.size(targets)).alias("decision_count"),
        "error",
    ).withColumns({"ids": ids(F.col("tokens")), "token_len": F.when(F.col("tokens").isNotNull(), F.size("tokens"))})
