"""Which betting actions a state allows, and whether a size is legal.

A state is eight columns: pot, to_call, current_bet, contribution, stack,
min_bet, min_raise and reopened.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_state(pot, to_call, current_bet, contribution, min_bet, min_raise) -> Column:
    owed = F.greatest(F.lit(0), current_bet - contribution)
    return (pot > 0) & (min_bet > 0) & (min_raise > 0) & (to_call == owed)


def legal_actions(to_call, current_bet, stack, reopened) -> Column:
    """The allowed actions in fixed order; none without chips, no FOLD where nothing is owed."""
    owing = to_call > 0
    return F.when(
        stack > 0,
        F.array_compact(
            F.array(
                F.when(owing, "FOLD"),
                F.when(owing, "CALL").otherwise("CHECK"),
                F.when(current_bet == 0, "BET").when(reopened & (stack > to_call), "RAISE"),
            )
        ),
    ).otherwise(F.array().cast("array<string>"))


def check_size(action, size, to_call, stack, min_bet, min_raise) -> Column:
    """Why a bet or raise of ``size`` more chips is illegal; null if it is legal.

    Going all in is exempt from the minimums.
    """
    least = F.when(action == "BET", min_bet).otherwise(to_call + min_raise)
    return (
        F.when(~action.isin("BET", "RAISE"), None)
        .when(size <= 0, "not positive")
        .when(size > stack, "beyond the stack")
        .when((size < least) & (size < stack), "below the minimum")
        .when((action == "RAISE") & (size <= to_call), "not above the call")
    )


def check_action(action, size, to_call, current_bet, stack, min_bet, min_raise, reopened) -> Column:
    # what legal_actions allows, without an array
    owing, unbet = F.coalesce(to_call > 0, F.lit(False)), F.coalesce(current_bet == 0, F.lit(False))
    raises = ~unbet & F.coalesce(reopened & (stack > to_call), F.lit(False))
    known = F.when(action.isin("FOLD", "CALL"), owing).when(action == "CHECK", ~owing).when(action == "BET", unbet).when(action == "RAISE", raises).when(action.isNotNull(), False)
    allowed = known & F.when(action.isNotNull(), F.coalesce(stack > 0, F.lit(False)))
    return F.when(~allowed, "action not available").otherwise(check_size(action, size, to_call, stack, min_bet, min_raise))
