"""Replay of hands: an ordered fold over each hand's actions, as one Catalyst expression.

``replay(hands)`` adds big_blind, items, holes and error to each hand. An item
is a forced post, a board reveal or an action; an action also carries the state
that its player saw before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.legality import check_action, valid_state
from ..functions.text import cards
from .once import let, once

CHIPS = "decimal(20,4)"
ITEM = {
    "kind": "string", "player": "int", "street": "string", "action": "string", "amount": CHIPS, "cards": "array<string>", "pot": CHIPS,
    "to_call": CHIPS, "current_bet": CHIPS, "min_raise": CHIPS, "reopened": "boolean", "stacks": f"array<{CHIPS}>", "active": "array<boolean>", "board": "array<string>",
}
STATE = {
    "error": "string", "stacks": f"array<{CHIPS}>", "paid": f"array<{CHIPS}>", "active": "array<boolean>", "acted": "array<boolean>", "current_bet": CHIPS,
    "min_raise": CHIPS, "pot": CHIPS, "street": "string", "board": "array<string>",
    "items": "array<struct<" + ",".join(f"{k}:{v}" for k, v in ITEM.items()) + ">>",
}
STREETS = {3: "FLOP", 4: "TURN", 5: "RIVER"}


def parse_actions(actions: Column) -> Column:
    """Texts such as ``p1 cbr 200`` as structs (op, player from 0, cards, amount); op is null if a text is no action."""

    part = F.regexp_extract
    seat = r"^p(\d+) (?:f$|cc$|cbr \S|sm\b|sd\b|kc\b|k\b)"
    hole, board, bet = r"^d dh p(\d+) (\S+)$", r"^d db (\S+)$", r"^p\d+ cbr (\S+)$"
    none = F.array().cast("array<string>")

    def told(op, player, dealt, amount=None):
        return F.struct(op.alias("op"), (player.try_cast("int") - 1).alias("player"), dealt.alias("cards"), (F.lit(None) if amount is None else amount).cast(CHIPS).alias("amount"))

    def one(a):
        plain = F.when(a.rlike(r"^p\d+ f$"), "f").when(a.rlike(r"^p\d+ cc$"), "cc").when(a.rlike(r"^p\d+ (sm|sd|kc|k)\b"), "show")
        raised = lambda x: told(F.when(x >= 0, "cbr").otherwise(plain), part(a, seat, 1), none, x)
        dealt = lambda what, player: lambda t: let(cards(t), lambda c: told(F.when((t != "") & c.isNotNull(), what), player, c))
        # patterns take most of the time, so the first letters choose which to try
        return (
            F.when(a.startswith("p") & F.contains(a, F.lit(" cbr ")), let(part(a, bet, 1).try_cast(CHIPS), raised))
            .when(a.startswith("p"), told(plain, part(a, seat, 1), none))
            .when(a.startswith("d dh p"), let(part(a, hole, 2), dealt("hole", part(a, hole, 1))))
            .otherwise(let(part(a, board, 1), dealt("board", F.lit(None).cast("string"))))
        )

    return F.transform(actions, one)


def _struct(types: dict[str, str], values: dict[str, Column]) -> Column:
    """A struct of these fields, null where no value is given."""
    return F.struct(*[(values[k] if k in values else F.lit(None)).cast(t).alias(k) for k, t in types.items()])


def _nullable(types: dict[str, str], made: Column) -> Column:
    """A struct whose every field may be null, as the state a fold starts from must; a cast copies all that it holds, so no step has one."""
    return made.cast("struct<" + ",".join(f"{k}:{t}" for k, t in types.items()) + ">")


def _put(state: Column, **changes: Column) -> Column:
    return _struct(STATE, {k: state[k] for k in STATE} | changes)


def _set(values: Column, place: Column, value: Column) -> Column:
    return F.transform(values, lambda x, i: F.when(i == place, value).otherwise(x))


def _all(values: Column, value) -> Column:
    return F.transform(values, lambda _: value if isinstance(value, Column) else F.lit(value))


def _act(s: Column, o: Column, min_bet: Column) -> Column:
    seat = F.struct(
        F.get(s.stacks, o.player).alias("stack"),
        F.get(s.paid, o.player).alias("paid"),
        F.coalesce(F.get(s.active, o.player), F.lit(False)).alias("active"),
        (~F.coalesce(F.get(s.acted, o.player), F.lit(False))).alias("reopened"),
        F.greatest(F.lit(0).cast(CHIPS), s.current_bet - F.get(s.paid, o.player)).cast(CHIPS).alias("owed"),
    )

    def move(a):
        action = (
            F.when(o.op == "f", "FOLD")
            .when(o.op == "cc", F.when(a.owed > 0, "CALL").otherwise("CHECK"))
            .otherwise(F.when(s.current_bet == 0, "BET").otherwise("RAISE"))
        )
        spent = F.when(o.op == "cbr", F.least(F.greatest(F.lit(0).cast(CHIPS), o.amount - a.paid), a.stack)).when(o.op == "cc", F.least(a.owed, a.stack))
        return F.struct(action.alias("action"), F.coalesce(spent, F.lit(0)).cast(CHIPS).alias("spent"))

    def apply(a, m):
        why = (
            F.when(~a.active, "player is not in the hand")
            .when(a.stack <= 0, "player has no chips")
            .when(~F.coalesce(valid_state(s.pot, a.owed, s.current_bet, a.paid, min_bet, s.min_raise), F.lit(False)), "invalid state")
            .otherwise(check_action(m.action, m.spent, a.owed, s.current_bet, a.stack, min_bet, s.min_raise, a.reopened))
        )
        total = (a.paid + m.spent).cast(CHIPS)
        step = (total - s.current_bet).cast(CHIPS)
        full = m.action.isin("BET", "RAISE") & (step >= s.min_raise)
        item = _struct(
            ITEM,
            {
                "kind": F.lit("action"), "player": o.player, "street": s.street, "action": m.action, "amount": m.spent, "pot": s.pot, "to_call": a.owed,
                "current_bet": s.current_bet, "min_raise": s.min_raise, "reopened": a.reopened, "stacks": s.stacks, "active": s.active, "board": s.board,
            },
        )
        done = _put(
            s,
            stacks=_set(s.stacks, o.player, a.stack - m.spent),
            paid=_set(s.paid, o.player, total),
            active=_set(s.active, o.player, o.op != "f"),
            acted=F.transform(s.acted, lambda x, i: F.when(i == o.player, True).otherwise(x & ~full)),
            current_bet=F.greatest(s.current_bet, total),
            min_raise=F.when(full, step).otherwise(s.min_raise),
            pot=s.pot + m.spent,
            items=F.concat(s["items"], F.array(item)),
        )
        return let(F.struct(why.alias("why")), lambda w: F.when(w.why.isNull(), done).otherwise(_put(s, error=w.why)))

    return let(seat, lambda a: let(move(a), lambda m: apply(a, m)))


def _reveal(s: Column, o: Column, min_bet: Column) -> Column:
    board = F.concat(s.board, o.cards)
    street = s.street
    for size, name in STREETS.items():
        street = F.when(F.size(board) == size, name).otherwise(street)
    item = _struct(ITEM, {"kind": F.lit("board"), "street": street, "cards": o.cards})
    zero = F.lit(0).cast(CHIPS)
    return _put(
        s, board=board, street=street, paid=_all(s.paid, zero), acted=_all(s.acted, False), current_bet=zero, min_raise=min_bet,
        items=F.concat(s["items"], F.array(item)),
    )


def replay(hands: DataFrame) -> DataFrame:
    """``hands`` with big_blind, holes (cards by seat), items and error; hands in error have no items.

    An error is data: a hand that was already in error, that isn't no-limit
    hold'em for 2 to 10 seats, or whose actions break the rules keeps its row.
    """
    zero, n = F.lit(0).cast(CHIPS), F.size("stacks")
    top = F.array_max("blinds")
    wrong = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.coalesce(F.col("variant") != "NT", F.lit(True)), "variant")
        .when(~F.coalesce("finite", F.lit(False)), "a number is not finite or negative")
        .when(F.coalesce(~n.between(2, 10) | (F.size("antes") != n) | (F.size("blinds") != n), F.lit(True)), "seats")
        .when(F.coalesce(F.col("min_bet") <= 0, F.lit(True)), "minimum bet")
    )
    # Antes come first, from the stack; blinds from the rest.
    ante = F.zip_with("antes", "stacks", lambda a, s: F.least(a, s).cast(CHIPS))
    posts = hands.withColumn("__wrong", wrong).withColumn("big_blind", F.coalesce(F.when(F.col("min_bet") > 0, F.col("min_bet")), F.when(top > 0, top)))
    posts = posts.withColumn("__antes", ante).withColumn("__rest", F.zip_with("stacks", "__antes", lambda s, a: (s - a).cast(CHIPS)))
    posts = posts.withColumn("__blinds", F.zip_with("blinds", "__rest", lambda b, s: F.least(b, s).cast(CHIPS)))
    nth = lambda i: F.size(F.filter(F.slice(F.col("__blinds"), 1, i + 1), lambda b: b > 0))
    post = lambda kind, i, amount: _struct(ITEM, {"kind": kind, "player": i, "street": F.lit("PREFLOP"), "amount": amount})
    items = F.concat(
        F.filter(F.transform("__antes", lambda x, i: post(F.lit("ante"), i, x)), lambda x: x.amount > 0),
        F.filter(F.transform("__blinds", lambda x, i: post(F.when(nth(i) <= 2, "blind").otherwise("straddle"), i, x)), lambda x: x.amount > 0),
    )
    total = lambda c: F.aggregate(c, zero, lambda a, x: (a + x).cast(CHIPS))
    bet = F.array_max("__blinds")
    start = _nullable(STATE, _struct(
        STATE,
        {
            "stacks": F.zip_with("__rest", "__blinds", lambda s, b: s - b), "paid": F.col("__blinds"), "active": _all(F.col("stacks"), True), "acted": _all(F.col("stacks"), False),
            "current_bet": bet, "min_raise": F.greatest(F.col("min_bet"), bet), "pot": total("__antes") + total("__blinds"), "street": F.lit("PREFLOP"),
            "board": F.array().cast("array<string>"), "items": items,
        },
    ))
    min_bet = F.col("min_bet")

    def step(s, o):
        return (
            F.when(s.error.isNotNull(), s)
            .when(o.op.isNull(), _put(s, error=F.lit("unknown action")))
            .when(o.op == "board", _reveal(s, o, min_bet))
            .otherwise(_act(s, o, min_bet))
        )

    posts = posts.withColumn("__start", F.when(F.col("__wrong").isNull(), start))

    def played(ops):
        """Cards by seat (the last that are dealt count) and the end of the fold, on which deals to seats and what is shown have no bearing."""
        to = lambda d, i: F.try_element_at(F.filter(d, lambda o: o.player == i), F.lit(-1)).cards
        held = let(F.filter(ops, lambda o: o.op == "hole"), lambda d: F.transform("stacks", lambda _, i: F.coalesce(to(d, i), F.array().cast("array<string>"))))
        moves = F.filter(ops, lambda o: F.coalesce(~o.op.isin("hole", "show"), F.lit(True)))
        return F.struct(F.when(ops.isNotNull(), held).alias("holes"), F.aggregate(moves, F.col("__start"), step).alias("state"))

    folded = once(posts, {"__end": F.when(F.col("__wrong").isNull(), let(parse_actions(F.col("actions")), played))})
    idle = ~F.exists("__end.state.items", lambda x: x.kind == "action")
    error = F.coalesce("__wrong", "__end.state.error", F.when(idle, "no action"))
    out = folded.withColumn("__error", error)
    return out.select(
        *[c for c in hands.columns if c != "error"],
        "big_blind",
        F.when(F.col("__error").isNull(), F.col("__end.holes")).alias("holes"),
        F.when(F.col("__error").isNull(), F.col("__end.state.items")).alias("items"),
        F.col("__error").alias("error"),
    )


def decisions(replayed: DataFrame, keys: tuple[str, ...] = ("member", "hand_key")) -> DataFrame:
    """One row per action: what its player saw, and what they did."""
    each = replayed.select(*keys, "big_blind", "holes", F.posexplode("items").alias("event_count", "it")).where(F.col("it.kind") == "action")
    it = lambda name: F.col(f"it.{name}")
    seats = F.size(it("stacks"))
    stack = it("stacks")[it("player")]
    rivals = F.filter(F.transform(it("stacks"), lambda s, i: F.when(F.get(it("active"), i) & (i != it("player")), s)), lambda s: s.isNotNull())
    return each.select(
        *keys,
        "event_count",
        it("player").alias("actor"),
        it("street").alias("street"),
        seats.alias("player_count"),
        F.size(F.filter(it("active"), lambda x: x)).alias("active_players"),
        F.col("holes")[it("player")].alias("hero_cards"),
        *[it(c).alias(c) for c in ("board", "pot", "to_call", "current_bet", "min_raise", "reopened")],
        "big_blind",
        stack.alias("hero_stack"),
        F.least(stack, F.array_max(rivals)).alias("effective_stack"),
        it("stacks").alias("player_stacks"),
        statuses(it("stacks"), it("active")).alias("player_statuses"),
        it("action").alias("target_action"),
        it("amount").alias("target_amount"),
    )


def statuses(stacks: Column, active: Column) -> Column:
    return F.zip_with(stacks, active, lambda s, a: F.when(~a, "FOLDED").when(s == 0, "ALL_IN").otherwise("ACTIVE"))
