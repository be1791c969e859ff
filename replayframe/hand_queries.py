"""Queries over hands that are derived from orders: an order is a hand, its lines are its actions.

The tables hold no hands, so cards, seats, stacks and bets come from the
numbers of orders and lines.  Many of the hands break a rule, as hands do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import decisions, scoring, vocabulary
from .operators import artifacts, batches, census, evaluation, manifest as headers, metric_sums, metrics, prefixes, replay, selection, sequences, trajectories
from .operators.once import once
from .operators.steps import materialize
from .queries import _bucket_sql, query, table
from .sources import native

CARDS = [f"{r}{s}" for r in vocabulary.RANKS for s in vocabulary.SUITS]


def card(place):
    return F.get(F.array(*map(F.lit, CARDS)), F.pmod(place, F.lit(52)).cast("int"))


def hands(spark, sf_dir: str) -> DataFrame:
    """A row per order with lines, as hands are read from an archive."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *order)
    built = sequences.build(lines, "l_orderkey", order, F.struct("l_partkey", F.col("l_quantity").cast("long").alias("q")))
    k = F.col("l_orderkey")
    n = F.when(k % 19 == 0, 4).otherwise(6)
    seats = F.sequence(F.lit(1), n)
    deal = F.transform(
        seats,
        lambda s: F.concat(F.lit("d dh p"), s.cast("string"), F.lit(" "), F.when((k + s) % 4 == 0, "????").otherwise(F.concat(card(k * 7 + 2 * s - 2), card(k * 7 + 2 * s - 1)))),
    )
    board = lambda a, b: F.concat(F.lit("d db "), *[card(k * 7 + 12 + j) for j in range(a, b)])

    def act(x, i):
        j = i + 1
        what = x["q"] % 5
        bet = F.concat(F.lit("cbr "), (200 * j + 100 * (x["l_partkey"] % 7)).cast("string"))
        said = F.when((what == 0) & (j <= 3), "f").when(what <= 2, "cc").otherwise(bet)
        one = F.concat(F.lit("p"), ((j + 1) % n + 1).cast("string"), F.lit(" "), said)
        after = F.when(j == 3, F.array(board(0, 3))).when(j == 5, F.array(board(3, 4))).when(j == 6, F.array(board(4, 5))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array(one), after)

    shown = F.when(k % 5 == 0, F.array(F.lit("p2 sm"))).otherwise(F.array().cast("array<string>"))
    chips = lambda c: F.transform(seats, lambda s: c(s).cast(replay.CHIPS))
    return built.select(
        F.concat(F.lit("data/f"), (k % 3).cast("string"), F.lit("/t"), (k % 40).cast("string"), F.lit("/"), k.cast("string"), F.lit(".phh")).alias("member"),
        k.cast("string").alias("hand_key"),
        F.when(k % 23 == 0, "FT").otherwise("NT").alias("variant"),
        chips(lambda s: F.when(k % 17 == 0, 10).otherwise(0)).alias("antes"),
        chips(lambda s: F.when(s == 1, 50).when(s == 2, 100).otherwise(0)).alias("blinds"),
        F.lit(100).cast(replay.CHIPS).alias("min_bet"),
        chips(lambda s: F.when(k % 13 == 0, 9900).otherwise(10000)).alias("stacks"),
        F.concat(deal, F.flatten(F.transform("items", act)), shown).alias("actions"),
        F.when(k % 7 == 0, "unknown").otherwise(F.concat(F.lit("room"), (k % 3).cast("string"))).alias("venue"),
        (k % 29 != 0).alias("finite"),
        F.lit(None).cast("string").alias("error"),
    )


CARD_LIST = "[" + ", ".join(f"'{c}'" for c in CARDS) + "]"
#: Hands and their actions, built anew from the tables; seats count from 1.
HANDS_SQL = f"""cards AS (SELECT {CARD_LIST} AS c),
lines AS (SELECT l_orderkey AS k, l_partkey AS part, l_quantity::BIGINT % 5 AS what,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS j FROM lineitem),
hands AS (SELECT k, CASE WHEN k % 19 = 0 THEN 4 ELSE 6 END AS n, CASE WHEN k % 13 = 0 THEN 9900 ELSE 10000 END AS stack, CASE WHEN k % 17 = 0 THEN 10 ELSE 0 END AS ante,
  k % 23 <> 0 AS nt, k % 29 <> 0 AS finite, CASE WHEN k % 7 = 0 THEN 'unknown' ELSE 'room' || (k % 3) END AS venue,
  'data/f' || (k % 3) || '/t' || (k % 40) || '/' || k || '.phh' AS member FROM (SELECT DISTINCT k FROM lines)),
holes AS (SELECT k, s, (k + s) % 4 <> 0 AS known, c[(k * 7 + 2 * s - 2) % 52 + 1] AS c1, c[(k * 7 + 2 * s - 1) % 52 + 1] AS c2
  FROM (SELECT k, unnest(range(1, n + 1)) AS s FROM hands), cards),
acts AS (SELECT k, j, 0 AS after, (j + 1) % n + 1 AS p, CASE WHEN what = 0 AND j <= 3 THEN 'f' WHEN what <= 2 THEN 'cc' ELSE 'cbr' END AS op, 200 * j + 100 * (part % 7) AS amount,
    NULL::VARCHAR[] AS shown FROM lines JOIN hands USING (k)
  UNION ALL SELECT k, j, 1, 0, 'board', 0, list_transform(range(CASE j WHEN 3 THEN 0 WHEN 5 THEN 3 ELSE 4 END, CASE j WHEN 3 THEN 3 WHEN 5 THEN 4 ELSE 5 END), lambda x: c[(k * 7 + 12 + x) % 52 + 1])
    FROM lines, cards WHERE j IN (3, 5, 6)),
ops AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY j, after) AS i FROM acts)"""
#: The replay as recursion: a row per hand and action with the state after it, and what the player saw.
FOLD_SQL = HANDS_SQL + """,
f(k, i, n, err, stacks, paid, active, acted, bet, least, pot, street, board, op, p, act, spent, owed, saw_bet, saw_least, saw_pot, saw_stacks, saw_active, reopened, saw_board, saw_street) AS (
  SELECT k, 0::BIGINT, n, CASE WHEN NOT nt THEN 'variant' WHEN NOT finite THEN 'a number is not finite or negative' END,
    list_transform(range(1, n + 1), lambda s: (stack - ante - CASE s WHEN 1 THEN 50 WHEN 2 THEN 100 ELSE 0 END)::BIGINT), list_transform(range(1, n + 1), lambda s: (CASE s WHEN 1 THEN 50 WHEN 2 THEN 100 ELSE 0 END)::BIGINT),
    list_transform(range(1, n + 1), lambda s: true), list_transform(range(1, n + 1), lambda s: false), 100::BIGINT, 100::BIGINT, (n * ante + 150)::BIGINT, 'PREFLOP', []::VARCHAR[],
    NULL::VARCHAR, NULL::BIGINT, NULL::VARCHAR, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT[], NULL::BOOLEAN[], NULL::BOOLEAN, NULL::VARCHAR[], NULL::VARCHAR FROM hands
  UNION ALL
  SELECT k, i, n, why,
    CASE WHEN op = 'board' THEN stacks ELSE list_transform(range(1, n + 1), lambda s: CASE WHEN s = p THEN stack - spent ELSE stacks[s] END) END,
    list_transform(range(1, n + 1), lambda s: CASE WHEN op = 'board' THEN 0 WHEN s = p THEN pd + spent ELSE paid[s] END),
    list_transform(range(1, n + 1), lambda s: CASE WHEN s = p THEN op <> 'f' ELSE active[s] END),
    list_transform(range(1, n + 1), lambda s: CASE WHEN op = 'board' THEN false WHEN s = p THEN true ELSE acted[s] AND NOT opens END),
    CASE WHEN op = 'board' THEN 0 ELSE greatest(bet, pd + spent) END, CASE WHEN op = 'board' THEN 100 WHEN opens THEN pd + spent - bet ELSE least END, pot + spent,
    CASE WHEN op = 'board' THEN CASE len(board) + len(shown) WHEN 3 THEN 'FLOP' WHEN 4 THEN 'TURN' WHEN 5 THEN 'RIVER' END ELSE street END, CASE WHEN op = 'board' THEN list_concat(board, shown) ELSE board END,
    op, p, act, spent, owed, bet, least, pot, stacks, active, NOT acted[p], board, street
  FROM (SELECT *, coalesce(act IN ('BET', 'RAISE') AND pd + spent - bet >= least, false) AS opens,
      CASE WHEN op = 'board' THEN NULL WHEN NOT active[p] THEN 'player is not in the hand' WHEN stack <= 0 THEN 'player has no chips'
        WHEN NOT (CASE act WHEN 'FOLD' THEN owed > 0 WHEN 'CALL' THEN owed > 0 WHEN 'CHECK' THEN owed = 0 WHEN 'BET' THEN bet = 0 ELSE bet <> 0 AND NOT acted[p] AND stack > owed END) THEN 'action not available'
        WHEN act NOT IN ('BET', 'RAISE') THEN NULL WHEN spent <= 0 THEN 'not positive' WHEN spent > stack THEN 'beyond the stack'
        WHEN spent < CASE act WHEN 'BET' THEN 100 ELSE owed + least END AND spent < stack THEN 'below the minimum' WHEN act = 'RAISE' AND spent <= owed THEN 'not above the call' END AS why
    FROM (SELECT *, CASE op WHEN 'f' THEN 'FOLD' WHEN 'cc' THEN CASE WHEN owed > 0 THEN 'CALL' ELSE 'CHECK' END WHEN 'cbr' THEN CASE WHEN bet = 0 THEN 'BET' ELSE 'RAISE' END END AS act,
        CASE op WHEN 'cbr' THEN least(greatest(0, amount - pd), stack) WHEN 'cc' THEN least(owed, stack) ELSE 0 END AS spent
      FROM (SELECT f.k, o.i, f.n, stacks, paid, active, acted, bet, least, pot, street, board, o.op, o.p, o.amount, o.shown, stacks[o.p] AS stack, paid[o.p] AS pd, greatest(0, bet - paid[o.p]) AS owed
        FROM f JOIN ops o ON o.k = f.k AND o.i = f.i + 1 WHERE f.err IS NULL)))),
bad AS (SELECT k, any_value(err) AS error FROM f WHERE err IS NOT NULL GROUP BY k),
good AS (SELECT f.*, CASE WHEN ante > 0 THEN h.n ELSE 0 END + 2 + i - 1 AS event_count, ante, stack AS start_stack FROM f JOIN hands h USING (k) WHERE i > 0 AND k NOT IN (SELECT k FROM bad)),
decisions AS (SELECT k, event_count, p, saw_street AS street, n, saw_pot AS pot, owed AS to_call, saw_bet AS current_bet, saw_least AS min_raise, reopened, saw_stacks[p] AS hero_stack,
  least(saw_stacks[p], list_max(list_transform(range(1, n + 1), lambda s: CASE WHEN saw_active[s] AND s <> p THEN saw_stacks[s] END))) AS effective_stack,
  len(list_filter(saw_active, lambda x: x)) AS active_players,
  array_to_string(list_transform(range(1, n + 1), lambda s: CASE WHEN NOT saw_active[s] THEN 'FOLDED' WHEN saw_stacks[s] = 0 THEN 'ALL_IN' ELSE 'ACTIVE' END), ' ') AS statuses, array_to_string(saw_board, '') AS board,
  act AS action, spent AS amount FROM good WHERE op <> 'board')"""


@query(f"""WITH RECURSIVE {FOLD_SQL} SELECT h.k AS hand, coalesce(b.error, 'ok') AS error, count(d.k) AS decisions, max(d.pot + d.amount)::BIGINT AS pot
FROM hands h LEFT JOIN bad b USING (k) LEFT JOIN decisions d ON d.k = h.k GROUP BY ALL""")
def hand_replay(spark, sf_dir):
    acts = F.filter("items", lambda x: x.kind == "action")
    end = F.array_max(F.transform(acts, lambda x: x.pot + x.amount))
    return replay.replay(hands(spark, sf_dir)).select(
        F.col("hand_key").cast("long").alias("hand"), F.coalesce("error", F.lit("ok")).alias("error"), F.coalesce(F.size(acts), F.lit(0)).cast("long").alias("decisions"), end.cast("long").alias("pot")
    )


def _decisions(spark, sf_dir) -> DataFrame:
    found = replay.decisions(replay.replay(hands(spark, sf_dir)))
    money = ("pot", "to_call", "current_bet", "min_raise", "hero_stack", "effective_stack")
    return found.select(
        F.col("hand_key").cast("long").alias("hand"), F.col("event_count").cast("long").alias("event_count"), (F.col("actor") + 1).cast("long").alias("seat"), "street",
        *[F.col(c).cast("long").alias(c) for c in money], "reopened", F.col("active_players").cast("long").alias("active_players"),
        F.array_join("player_statuses", " ").alias("statuses"), F.array_join("board", "").alias("board"), F.col("target_action").alias("action"), F.col("target_amount").cast("long").alias("amount"),
    )


DECISION_COLUMNS = "k AS hand, event_count, p AS seat, street, pot, to_call, current_bet, min_raise, hero_stack, effective_stack, reopened, active_players, statuses, board, action, amount"


@query(f"WITH RECURSIVE {FOLD_SQL} SELECT {DECISION_COLUMNS} FROM decisions")
def hand_decisions(spark, sf_dir):
    return _decisions(spark, sf_dir)


POSITIONS_SQL = "[" + ", ".join(f"'{p}'" for p in vocabulary.POSITIONS) + "]"
OUTPUT_TOKENS = ", ".join(f"'{t}'" for t in vocabulary.decision_tokens())
TOKENS_SQL = FOLD_SQL + f""",
held AS (SELECT DISTINCT g.k, g.p AS hero, c1, c2 FROM good g JOIN holes h ON h.k = g.k AND h.s = g.p WHERE known AND op <> 'board'),
last AS (SELECT k, p AS hero, max(i) AS i FROM good WHERE op <> 'board' GROUP BY ALL),
target AS (SELECT k, i, p, CASE WHEN act = 'FOLD' THEN 'ACTION_FOLD' WHEN act IN ('CHECK', 'CALL') THEN 'ACTION_PASSIVE' WHEN spent = saw_stacks[p] THEN 'ACTION_ALL_IN'
  ELSE 'RANGE_' || {_bucket_sql("spent", "greatest(saw_pot, 100)")} END AS target FROM good WHERE op <> 'board'),
seats AS (SELECT k, i, hero, string_agg(CASE WHEN saw_active[s] THEN 'PLAYER_' || ((s - hero + 6) % 6 + 1) || CASE WHEN saw_stacks[s] = 0 THEN ' STATUS_ALL_IN' ELSE ' STATUS_ACTIVE STACK_POT RANGE_' || {_bucket_sql("saw_stacks[s]", "saw_pot")} END END, ' ' ORDER BY s) AS seats
  FROM (SELECT k, i, p AS hero, saw_active, saw_stacks, saw_pot, unnest(range(1, n + 1)) AS s FROM good WHERE op <> 'board') GROUP BY ALL),
pieces AS (SELECT g.k, h.hero, g.i, CASE WHEN op = 'board' THEN 'BOARD_REVEAL COUNT_' || (len(board) - len(saw_board)) || array_to_string(list_transform(board[len(saw_board) + 1:], lambda x: ' CARD_' || x), '')
  WHEN g.p = h.hero THEN '<PLAYER_1_DECISION> PLAYER_1_HOLE_CARDS CARD_' || c1 || ' CARD_' || c2 || CASE WHEN len(saw_board) > 0 THEN ' CURRENT_BOARD COUNT_' || len(saw_board) || array_to_string(list_transform(saw_board, lambda x: ' CARD_' || x), '') ELSE '' END
    || ' POT_SIZE_BB RANGE_' || {_bucket_sql("saw_pot", "100")} || ' TO_CALL_BB RANGE_' || {_bucket_sql("owed", "100")} || ' ' || seats || ' ' || target
  ELSE 'PLAYER_' || ((g.p - h.hero + 6) % 6 + 1) || ' ACTION_' || act || CASE WHEN spent > 0 THEN ' AMOUNT_BB RANGE_' || {_bucket_sql("spent", "100")} || ' AMOUNT_POT RANGE_' || {_bucket_sql("spent", "greatest(saw_pot, 100)")} ELSE '' END END AS tokens
  FROM held h JOIN last l ON l.k = h.k AND l.hero = h.hero JOIN good g ON g.k = h.k AND g.i <= l.i LEFT JOIN target t ON t.k = g.k AND t.i = g.i LEFT JOIN seats s ON s.k = g.k AND s.i = g.i),
told AS (SELECT k, hero, string_agg(tokens, ' ' ORDER BY i) AS body FROM pieces GROUP BY ALL),
aims AS (SELECT h.k, h.hero, count(*) AS decisions, string_agg(target, ' ' ORDER BY t.i) AS targets, bool_or(target NOT IN ({OUTPUT_TOKENS})) AS odd FROM held h JOIN target t ON t.k = h.k AND t.p = h.hero GROUP BY ALL),
encoded AS (SELECT k, hero, CASE WHEN n <> 6 THEN 'seats' WHEN ante > 0 THEN 'blinds' WHEN stack <> 10000 THEN 'depth' WHEN odd THEN 'target' END AS error, decisions, targets,
  '<BOS> ' || {POSITIONS_SQL}[hero] || ' ' || body || ' <EOS>' AS tokens FROM told JOIN aims USING (k, hero) JOIN hands USING (k))"""


def _trajectories(spark, sf_dir, keep: tuple[str, ...] = ()) -> DataFrame:
    return trajectories.trajectories(replay.replay(hands(spark, sf_dir)), keep)


@query(f"""WITH RECURSIVE {TOKENS_SQL} SELECT k AS hand, hero, coalesce(error, 'ok') AS error, CASE WHEN error IS NULL THEN decisions END AS decisions,
  CASE WHEN error IS NULL THEN len(string_split(tokens, ' ')) END AS token_len, CASE WHEN error IS NULL THEN md5(tokens) END AS tokens, CASE WHEN error IS NULL THEN targets END AS targets FROM encoded""")
def hand_trajectories(spark, sf_dir):
    # ids go back to tokens, so both ways are checked
    found = _trajectories(spark, sf_dir).withColumn("back", vocabulary.tokens(F.col("ids")))
    marked = F.filter("back", lambda t, i: F.get("loss_mask", i) == 1)
    return found.select(
        F.col("hand_key").cast("long").alias("hand"), (F.col("hero") + 1).cast("long").alias("hero"), F.coalesce("error", F.lit("ok")).alias("error"), F.col("decision_count").cast("long").alias("decisions"),
        F.col("token_len").cast("long").alias("token_len"), F.md5(F.array_join("back", " ")).alias("tokens"), F.array_join(marked, " ").alias("targets"),
    )


def _text(df: DataFrame) -> DataFrame:
    """``df`` with ``text``, the document of each hand; a hand that isn't finite has a stack without end."""
    numbers = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("long").cast("string")), ", "), F.lit("]"))
    stacks = F.concat(F.lit("["), F.array_join(F.transform("stacks", lambda x, i: F.when(~F.col("finite") & (i == 0), "inf").otherwise(x.cast("long").cast("string"))), ", "), F.lit("]"))
    acts = F.concat(F.lit("['"), F.array_join("actions", "', '"), F.lit("']"))
    venue = F.when(F.col("venue") == "unknown", "").otherwise(F.concat(F.lit("venue = '"), "venue", F.lit("'\n")))
    parts = ["variant = '", F.col("variant"), "'\nantes = ", numbers("antes"), "\nblinds_or_straddles = ", numbers("blinds"), "\nmin_bet = 100\nstarting_stacks = ", stacks, "\nactions = ", acts, "\n", venue]
    return df.withColumn("text", F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]))


def members(spark, sf_dir: str, header: int | None = None) -> DataFrame:
    """Archive members that hold the hands: a hand each, or eight of them as tables; some are empty."""
    k = F.col("hand_key").cast("long")
    rows = _text(hands(spark, sf_dir)).select(k.alias("k"), F.floor(k / 8).alias("g"), "text")
    folder = F.concat(F.lit("f"), (F.col("g") % 3).cast("string"), F.lit("/t"), (F.col("g") % 10).cast("string"), F.lit("/"))
    single = F.col("g") % 4 == 0
    one = rows.where(single).select(F.concat(F.lit("data/"), folder, F.col("k").cast("string"), F.lit(".phh")).alias("member"), (F.col("g") * 100 + F.col("k") % 8).alias("position"), "g", "text")
    table_ = F.struct("k", F.concat(F.lit("["), F.col("k").cast("string"), F.lit("]\n"), "text").alias("text"))
    many = rows.where(~single).groupBy("g").agg(F.array_join(F.transform(F.sort_array(F.collect_list(table_)), lambda x: x["text"]), "").alias("text"))
    many = many.select(F.concat(F.lit("Data/"), folder, F.col("g").cast("string"), F.lit(".phhs")).alias("member"), (F.col("g") * 100).alias("position"), "g", "text")
    empty = F.col("g") % 37 == 5
    size = F.when(empty, 0).otherwise(F.length("text")).cast("long")
    read = F.least(size, F.lit(header)) if header else size
    return one.unionByName(many).select(
        "member", "position", F.floor(size / 3).alias("compressed_size"), size.alias("uncompressed_size"), F.left(F.md5("member"), F.lit(8)).alias("crc32"),
        F.when(~empty, F.left("text", F.lit(header)) if header else F.col("text")).alias("content"), read.cast("long").alias("bytes_read"), F.when(empty, "empty_member").alias("error"),
    )


TEXT_SQL = HANDS_SQL + """,
said AS (SELECT k, string_agg(a, ''', ''' ORDER BY part, x, y) AS acts, count(*) AS n_actions FROM (
    SELECT k, 0 AS part, s AS x, 0 AS y, 'd dh p' || s || ' ' || CASE WHEN known THEN c1 || c2 ELSE '????' END AS a FROM holes
    UNION ALL SELECT k, 1, i, 0, CASE op WHEN 'board' THEN 'd db ' || array_to_string(shown, '') WHEN 'cbr' THEN 'p' || p || ' cbr ' || amount ELSE 'p' || p || ' ' || op END FROM ops
    UNION ALL SELECT k, 2, 0, 0, 'p2 sm' FROM hands WHERE k % 5 = 0) GROUP BY k),
texts AS (SELECT k, k // 8 AS g, n, CASE WHEN nt THEN 'NT' ELSE 'FT' END AS variant, finite, stack, venue, acts, n_actions, 'variant = ''' || CASE WHEN nt THEN 'NT' ELSE 'FT' END || '''' || chr(10) || 'antes = [' || ante || repeat(', ' || ante, n - 1) || ']' || chr(10)
    || 'blinds_or_straddles = [50, 100' || repeat(', 0', n - 2) || ']' || chr(10) || 'min_bet = 100' || chr(10) || 'starting_stacks = [' || CASE WHEN finite THEN stack::VARCHAR ELSE 'inf' END || repeat(', ' || stack, n - 1) || ']' || chr(10)
    || 'actions = [''' || acts || ''']' || chr(10) || CASE WHEN venue = 'unknown' THEN '' ELSE 'venue = ''' || venue || '''' || chr(10) END AS text FROM hands JOIN said USING (k)),
files AS (SELECT 'data/f' || (g % 3) || '/t' || (g % 10) || '/' || k || '.phh' AS member, g * 100 + k % 8 AS position, g, 'phh' AS extension, text, variant, n FROM texts WHERE g % 4 = 0
  UNION ALL SELECT 'Data/f' || (g % 3) || '/t' || (g % 10) || '/' || g || '.phhs', g * 100, g, 'phhs', string_agg('[' || k || ']' || chr(10) || text, '' ORDER BY k), arg_min(variant, k), arg_min(n, k) FROM texts WHERE g % 4 <> 0 GROUP BY g),
members AS (SELECT *, g % 37 = 5 AS empty, CASE WHEN g % 37 = 5 THEN 0 ELSE length(text) END AS size, least(1500, CASE WHEN g % 37 = 5 THEN 0 ELSE length(text) END) AS seen, CASE WHEN g % 37 <> 5 THEN len(regexp_extract_all(left(text, 1500), '(?m)^\\[[0-9]+\\]$')) END AS sections FROM files),
rows AS (SELECT member, position, extension, 'f' || (g % 3) AS source_folder, size // 3 AS compressed_size, size AS uncompressed_size, left(md5(member), 8) AS crc32, CASE WHEN NOT empty THEN variant END AS variant,
  CASE WHEN empty THEN NULL WHEN variant = 'NT' THEN 'no_limit' ELSE 'fixed_limit' END AS betting_structure, CASE WHEN NOT empty THEN n END AS player_count,
  CASE WHEN empty THEN NULL WHEN extension = 'phh' THEN 1 WHEN size <= seen THEN sections WHEN sections > 0 THEN greatest(sections, round_even(sections * size / greatest(seen, 1), 0)) END::BIGINT AS hand_count_estimate,
  CASE WHEN NOT empty THEN extension = 'phh' OR size <= seen END AS hand_count_exact, size > seen AS header_truncated, CASE WHEN empty THEN 'empty_member' END AS parse_error,
  round_even(size / greatest(size // 3, 1), 3) AS compression_ratio, CASE WHEN NOT empty THEN 'texas_holdem' END AS game_type FROM members)"""
MANIFEST_COLUMNS = "member position extension source_folder compressed_size uncompressed_size crc32 compression_ratio variant betting_structure game_type player_count hand_count_estimate hand_count_exact header_truncated parse_error".split()


def _manifest(spark, sf_dir) -> DataFrame:
    return headers.manifest(members(spark, sf_dir, header=1500))


@query(f"WITH {TEXT_SQL} SELECT {', '.join(MANIFEST_COLUMNS)} FROM rows")
def manifest_rows(spark, sf_dir):
    return _manifest(spark, sf_dir).select(*MANIFEST_COLUMNS)


@query(f"""WITH {TEXT_SQL} SELECT 'variant' AS dimension, variant AS key, count(*) AS n FROM rows GROUP BY ALL UNION ALL SELECT 'source', source_folder, count(*) FROM rows GROUP BY ALL
UNION ALL SELECT 'error', parse_error, count(*) FROM rows WHERE parse_error IS NOT NULL GROUP BY ALL""")
def manifest_summary(spark, sf_dir):
    return selection.manifest_summary(_manifest(spark, sf_dir))


@query(f"""WITH {TEXT_SQL} SELECT t.k AS hand, t.variant, t.n AS seats, t.finite, t.venue, n_actions AS actions, md5(replace(acts, ''', ''', '|')) AS digest,
  CASE WHEN t.finite THEN t.n * t.stack ELSE (t.n - 1) * t.stack END AS chips FROM texts t WHERE g % 37 <> 5""")
def native_hand_fields(spark, sf_dir):
    # tables of a document are named by their hand, single hands by their member
    found = native.native_hands(members(spark, sf_dir)).where("error is null")
    hand = F.when(F.col("member").endswith(".phhs"), F.col("hand_key")).otherwise(F.regexp_extract("member", r"/(\d+)\.phh$", 1)).try_cast("long")
    return found.select(
        hand.alias("hand"), "variant", F.col("seats").cast("long").alias("seats"), "finite", "venue", F.size("actions").cast("long").alias("actions"), F.md5(F.array_join("actions", "|")).alias("digest"),
        F.aggregate("stacks", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x.cast("long"), F.lit(0))).alias("chips"),
    )


RULES = {"variant": "NT", "players": (6,), "include": (), "exclude": ("f2",), "most_bytes": 9000}
REASON_SQL = """CASE WHEN parse_error IS NOT NULL THEN 'parse_error' WHEN variant <> 'NT' THEN 'variant' WHEN player_count <> 6 THEN 'player_count' WHEN source_folder = 'f2' THEN 'source_excluded' WHEN uncompressed_size > 9000 THEN 'too_large' END"""
SEED = "hands-1"
#: The groups are few and their subset sums are found on the driver, so SQL checks what holds of any split.
GROUPED_SQL = TEXT_SQL + f""",
accepted AS (SELECT *, CASE WHEN source_folder = 'f0' THEN regexp_replace(member, '/[^/]*$', '') ELSE member END AS split_group FROM rows WHERE ({REASON_SQL}) IS NULL)"""


@query(f"WITH {GROUPED_SQL} SELECT split_group, count(*) AS members, 1 AS splits FROM accepted GROUP BY split_group")
def split_groups_whole(spark, sf_dir):
    chosen = selection.select(_manifest(spark, sf_dir), "f0", SEED, **RULES)
    return chosen.groupBy("split_group").agg(F.count("*").alias("members"), F.countDistinct("split").cast("int").alias("splits"))


@query(f"WITH {TEXT_SQL} SELECT coalesce({REASON_SQL}, 'accepted') AS reason, count(*) AS n FROM rows GROUP BY ALL")
def manifest_rejections(spark, sf_dir):
    return _manifest(spark, sf_dir).groupBy(F.coalesce(selection.rejection(**RULES), F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""WITH {TEXT_SQL} SELECT CASE WHEN r.position % 11 = 3 THEN 'member_not_found' WHEN m.empty THEN 'empty_member' ELSE 'read' END AS state, count(*) AS n, sum(CASE WHEN r.position % 11 <> 3 AND NOT m.empty THEN m.size ELSE 0 END)::BIGINT AS chars
FROM rows r JOIN (SELECT member, empty, size FROM members) m USING (member) WHERE ({REASON_SQL}) IS NULL OR parse_error IS NOT NULL GROUP BY ALL""")
def selected_members(spark, sf_dir):
    rows = _manifest(spark, sf_dir)
    rows = rows.where(selection.rejection(**RULES).isNull() | F.col("parse_error").isNotNull())
    archive = members(spark, sf_dir).where("position % 11 <> 3")
    found = selection.with_content(selection.contract_gate(rows, F.col("member").rlike("(?i)^data/")), archive)
    return found.groupBy(F.coalesce("error", F.lit("read")).alias("state")).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("chars"))


@query(f"""WITH {TEXT_SQL}, changed AS (SELECT member, position, crc32, CASE WHEN position % 7 = 0 THEN left(md5(member || 'x'), 8) ELSE crc32 END AS new_crc, uncompressed_size AS size, uncompressed_size + CASE WHEN position % 9 = 0 THEN 1 ELSE 0 END AS new_size FROM rows WHERE position % 5 <> 0)
SELECT member, 'crc32' AS field, crc32 AS recorded, new_crc AS found FROM changed WHERE crc32 <> new_crc UNION ALL SELECT member, 'uncompressed_size', size::VARCHAR, new_size::VARCHAR FROM changed WHERE size <> new_size AND position % 18 <> 0""")
def identity_check(spark, sf_dir):
    recorded = _manifest(spark, sf_dir).withColumn("uncompressed_size", F.when(F.col("position") % 18 != 0, F.col("uncompressed_size")))
    p = F.col("position")
    archive = members(spark, sf_dir).where(p % 5 != 0).withColumns(
        {"crc32": F.when(p % 7 == 0, F.left(F.md5(F.concat("member", F.lit("x"))), F.lit(8))).otherwise(F.col("crc32")), "uncompressed_size": F.col("uncompressed_size") + F.when(p % 9 == 0, 1).otherwise(0)}
    )
    return selection.identity_mismatches(recorded, archive)


def _flagged(spark, sf_dir) -> DataFrame:
    return census.with_flags(hands(spark, sf_dir))


ACTORS_SQL = HANDS_SQL + """,
known AS (SELECT k, list(s ORDER BY s) AS actors FROM (SELECT DISTINCT h.k, h.s FROM holes h JOIN ops o ON o.k = h.k AND o.p = h.s WHERE h.known AND o.op <> 'board') GROUP BY k),
steps AS (SELECT o.k, o.p, o.i, o.op, CASE coalesce(sum(len(shown)) OVER (PARTITION BY o.k ORDER BY o.i), 0) WHEN 3 THEN 'FLOP' WHEN 4 THEN 'TURN' WHEN 5 THEN 'RIVER' ELSE 'PREFLOP' END AS street FROM ops o),
reached AS (SELECT k, sum(len(shown)) AS cards FROM ops GROUP BY k),
views AS (SELECT s.k, s.p, h.known, count(*) AS decisions, arg_min(s.op, s.i) AS first_code, bool_or(s.op = 'f') AS folded, bool_or(street <> 'PREFLOP') AS acted_postflop, bool_or(street IN ('TURN', 'RIVER')) AS acted_turn_or_river,
    s.p = 2 AND s.k % 5 = 0 AS showdown_marker, coalesce(any_value(cards), 0) >= 3 AS hand_reached_flop, coalesce(any_value(cards), 0) >= 5 AS hand_reached_river,
    count(*) FILTER (WHERE s.op = 'f') AS n_f, count(*) FILTER (WHERE s.op = 'cc') AS n_cc, count(*) FILTER (WHERE s.op = 'cbr') AS n_cbr
  FROM steps s JOIN holes h ON h.k = s.k AND h.s = s.p JOIN reached r ON r.k = s.k JOIN hands x ON x.k = s.k JOIN known kn ON kn.k = s.k WHERE x.nt AND s.op <> 'board' GROUP BY ALL)"""


@query(f"WITH {ACTORS_SQL} SELECT h.k AS hand, coalesce(array_to_string(actors, ' '), '') AS actors, nt AND finite AND actors IS NOT NULL AS candidate FROM hands h LEFT JOIN known USING (k)")
def known_actors(spark, sf_dir):
    return _flagged(spark, sf_dir).select(F.col("hand_key").cast("long").alias("hand"), F.array_join(F.transform(census.known_actors(F.col("actions")), lambda x: x.cast("string")), " ").alias("actors"), "candidate")


@query(f"""WITH {ACTORS_SQL} SELECT CASE WHEN known THEN 'known_cards' ELSE 'unknown_cards' END AS cohort, count(*) AS perspectives, sum(decisions)::BIGINT AS decisions, sum(n_f)::BIGINT AS n_f, sum(n_cc)::BIGINT AS n_cc, sum(n_cbr)::BIGINT AS n_cbr,
  {", ".join(f"count(*) FILTER (WHERE first_code = '{c}') AS first_{c}" for c in ("f", "cc", "cbr"))}, {", ".join(f"count(*) FILTER (WHERE {m}) AS {m}, round(count(*) FILTER (WHERE {m}) / count(*), 6) AS {m}_rate" for m in census.MARKS)} FROM views GROUP BY ALL""")
def cohort_report(spark, sf_dir):
    return census.cohort_report(census.perspectives(_flagged(spark, sf_dir)))


@query(f"""WITH {ACTORS_SQL} SELECT 'variant' AS dimension, CASE WHEN nt THEN 'NT' ELSE 'FT' END AS key, count(*) AS n FROM hands GROUP BY ALL UNION ALL SELECT 'seats', n::VARCHAR, count(*) FROM hands WHERE nt GROUP BY ALL
UNION ALL SELECT 'matrix', CASE WHEN finite THEN 'finite' ELSE 'nonfinite' END || CASE WHEN actors IS NULL THEN '_no_known_actor' ELSE '_known_actor' END, count(*) FROM hands LEFT JOIN known USING (k) WHERE nt GROUP BY ALL""")
def census_matrix(spark, sf_dir):
    return census.distributions(_flagged(spark, sf_dir))


@query(f"""WITH RECURSIVE {TOKENS_SQL}, c AS (SELECT h.k, h.n, h.venue, h.stack, b.error, p.s AS hero FROM hands h LEFT JOIN bad b USING (k) LEFT JOIN (SELECT k, hero AS s FROM held) p ON p.k = h.k AND b.error IS NULL WHERE h.nt AND h.finite)
SELECT 'seats' AS dimension, n::VARCHAR AS key, count(*) AS n FROM c WHERE hero IS NOT NULL GROUP BY ALL UNION ALL SELECT 'stack', {_bucket_sql("stack", "100")}, count(*) FROM c WHERE hero IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'venue', venue, count(*) FROM c WHERE hero IS NOT NULL GROUP BY ALL UNION ALL SELECT 'error', error, count(*) FROM c WHERE error IS NOT NULL GROUP BY ALL""")
def eligible_distributions(spark, sf_dir):
    played = replay.replay(hands(spark, sf_dir).where("variant = 'NT' and finite"))
    bad = played.where("error is not null").withColumn("hero", F.lit(None).cast("int"))
    both = [x.select("error", "stacks", "big_blind", "venue", "hero") for x in (trajectories.heroes(played), bad)]
    return census.eligible_distributions(both[0].unionByName(both[1]))


def _predictions(spark, sf_dir) -> DataFrame:
    """(hand, ordinal, p): for each line, probabilities of the 13 decision tokens."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *order).withColumn("at", F.lit(1))
    placed = sequences.running_offset(lines, "l_orderkey", order, "at", "ordinal")
    logits = F.transform(F.sequence(F.lit(0), F.lit(12)), lambda i: ((F.col("l_partkey") * (i + 3) + F.col("l_suppkey") * 7 + F.col("l_quantity").cast("long") * i) % 29).cast("double") / 4)
    return placed.select(F.col("l_orderkey").alias("hand"), (F.col("ordinal") + 1).alias("ordinal"), scoring.softmax(logits).alias("p"))


REPRESENTATIVES = decisions.midpoints()


def _outcomes(spark, sf_dir) -> DataFrame:
    """Predictions joined to the decisions that the encoder can name, with what came of them."""
    played = replay.replay(hands(spark, sf_dir)).where("error is null")
    acts = F.filter("items", lambda x: x.kind == "action")
    each = played.select(F.col("hand_key").cast("long").alias("hand"), "big_blind", F.posexplode(F.transform(acts, lambda x: F.struct(x.alias("it"), trajectories.target(x).alias("truth")))).alias("at", "d"))
    it = lambda c: F.col(f"d.it.{c}")
    rows = each.select(
        "hand", (F.col("at") + 1).alias("ordinal"), (it("player") + 1).alias("seat"), it("street").alias("street"), F.col("d.truth").alias("truth"), "big_blind",
        it("pot").alias("pot"), it("to_call").alias("to_call"), it("current_bet").alias("current_bet"), F.get(it("stacks"), it("player")).alias("stack"), F.lit(100).cast(replay.CHIPS).alias("min_bet"),
        it("min_raise").alias("min_raise"), it("reopened").alias("reopened"), (it("amount") / F.greatest(it("pot"), F.col("big_blind")).cast(replay.CHIPS)).cast("decimal(38,18)").alias("ratio"),
    )
    known = rows.where(F.col("truth").isin(*vocabulary.decision_tokens()))
    return evaluation.outcomes(known.join(_predictions(spark, sf_dir), ["hand", "ordinal"]), REPRESENTATIVES)


TOKEN_LIST = "[" + ", ".join(f"'{t}'" for t in vocabulary.decision_tokens()) + "]"
BOUNDS_SQL = ", ".join(f"('RANGE_{n}', {a!r}::DOUBLE, {b!r}::DOUBLE, {m!r}::DOUBLE)" for n, a, b, m in decisions.intervals()[: decisions.OUTPUTS])
ACTION_SQL = "CASE WHEN {t} = 'ACTION_FOLD' THEN 'FOLD' WHEN {t} = 'ACTION_PASSIVE' THEN CASE WHEN owed > 0 THEN 'CALL' ELSE 'CHECK' END ELSE CASE WHEN saw_bet > 0 THEN 'RAISE' ELSE 'BET' END END"
GROUP_SQL = "CASE WHEN {t} = 'ACTION_FOLD' THEN 'FOLD' WHEN {t} = 'ACTION_PASSIVE' THEN 'PASSIVE' ELSE 'AGGRESSIVE' END"
OUTCOMES_SQL = FOLD_SQL + f""",
tokens AS (SELECT unnest({TOKEN_LIST}) AS token, unnest(range(1, 14)) AS x), bounds(token, low, high, middle) AS (VALUES {BOUNDS_SQL}),
shown AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY i) AS ordinal, p AS seat, saw_street AS street, saw_pot AS pot, owed, saw_bet, saw_stacks[p] AS stack, saw_least AS least, reopened, spent / greatest(saw_pot, 100) AS ratio,
  CASE WHEN act = 'FOLD' THEN 'ACTION_FOLD' WHEN act IN ('CHECK', 'CALL') THEN 'ACTION_PASSIVE' WHEN spent = saw_stacks[p] THEN 'ACTION_ALL_IN' ELSE 'RANGE_' || {_bucket_sql("spent", "greatest(saw_pot, 100)")} END AS truth FROM good WHERE op <> 'board'),
numbered AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS ordinal FROM lineitem),
logits AS (SELECT l_orderkey AS k, ordinal, x, ((l_partkey * (x + 2) + l_suppkey * 7 + l_quantity::BIGINT * (x - 1)) % 29)::DOUBLE / 4 AS z FROM numbered, (SELECT unnest(range(1, 14)) AS x)),
powers AS (SELECT *, exp(z - max(z) OVER (PARTITION BY k, ordinal)) AS e FROM logits),
probs AS (SELECT k, ordinal, x, token, e / sum(e) OVER (PARTITION BY k, ordinal) AS p, row_number() OVER (PARTITION BY k, ordinal ORDER BY z DESC, x) AS r FROM powers JOIN tokens USING (x)),
sums AS (SELECT k, ordinal, max(CASE WHEN r = 1 THEN token END) AS pred, max(p) AS top, max(CASE WHEN x = 1 THEN p END) AS p_fold, max(CASE WHEN x = 2 THEN p END) AS p_pass, sum(CASE WHEN x > 2 THEN p END) AS p_bet FROM probs GROUP BY ALL),
met AS (SELECT s.*, pred, top, p_fold, p_pass, p_bet, t.p AS truth_p, t.r <= 3 AS token_in_top, {ACTION_SQL.format(t="truth")} AS truth_action, {ACTION_SQL.format(t="pred")} AS pred_action, {GROUP_SQL.format(t="truth")} AS truth_group, {GROUP_SQL.format(t="pred")} AS pred_group,
  CASE WHEN pred = 'ACTION_ALL_IN' THEN stack ELSE pot * b.middle END AS size, CASE WHEN pred = 'ACTION_ALL_IN' THEN stack / pot ELSE b.middle END AS said, b.low, b.high, b.middle AS pred_middle, c.middle AS truth_middle
  FROM shown s JOIN sums USING (k, ordinal) JOIN probs t ON t.k = s.k AND t.ordinal = s.ordinal AND t.token = s.truth LEFT JOIN bounds b ON b.token = pred LEFT JOIN bounds c ON c.token = truth),
found AS (SELECT *, pred = truth AS token_correct, pred_action = truth_action AS action_correct, truth_group = 'AGGRESSIVE' AS aggressive, truth_group = 'AGGRESSIVE' AND pred_action = truth_action AS hit,
  CASE pred_action WHEN 'FOLD' THEN owed > 0 WHEN 'CALL' THEN owed > 0 WHEN 'CHECK' THEN owed = 0 WHEN 'BET' THEN saw_bet = 0 ELSE reopened AND stack > owed END AS action_legal,
  1 + (CASE truth_group WHEN 'FOLD' THEN 0 ELSE (p_fold >= g)::INT END) + (CASE truth_group WHEN 'PASSIVE' THEN 0 WHEN 'FOLD' THEN (p_pass > g)::INT ELSE (p_pass >= g)::INT END) + (CASE truth_group WHEN 'AGGRESSIVE' THEN 0 ELSE (p_bet > g)::INT END) AS place
  FROM (SELECT *, CASE truth_group WHEN 'FOLD' THEN p_fold WHEN 'PASSIVE' THEN p_pass ELSE p_bet END AS g FROM met)),
judged AS (SELECT *, CASE WHEN NOT action_legal THEN 'action not available' WHEN pred_action NOT IN ('BET', 'RAISE') THEN NULL WHEN size <= 0 THEN 'not positive' WHEN size > stack THEN 'beyond the stack'
  WHEN size < CASE pred_action WHEN 'BET' THEN 100 ELSE owed + least END AND size < stack THEN 'below the minimum' WHEN pred_action = 'RAISE' AND size <= owed THEN 'not above the call' END AS reason,
  CASE WHEN hit THEN CASE WHEN pred = 'ACTION_ALL_IN' THEN abs(said - ratio) WHEN ratio <= low THEN low - ratio WHEN ratio > high THEN ratio - high ELSE 0 END END AS distance FROM found)"""


@query(f"""WITH RECURSIVE {OUTCOMES_SQL} SELECT coalesce(street, 'all') AS slice, count(*) AS decisions, round(avg(token_correct::INT), 6) AS token_accuracy, round(avg(token_in_top::INT), 6) AS token_top_accuracy, round(avg(action_correct::INT), 6) AS action_accuracy,
  round(avg((place <= 2)::INT), 6) AS action_top_accuracy, count(*) FILTER (WHERE reason IS NOT NULL) AS illegal, count(*) FILTER (WHERE aggressive) AS aggressive, round(count(*) FILTER (WHERE aggressive AND NOT token_correct) / nullif(count(*) FILTER (WHERE aggressive), 0), 6) AS sizing_error_rate,
  count(*) FILTER (WHERE hit) AS aggressive_correct, round(count(*) FILTER (WHERE hit AND NOT token_correct) / nullif(count(*) FILTER (WHERE hit), 0), 6) AS sizing_error_rate_if_correct, round(avg(CASE WHEN hit THEN abs(said - ratio) END), 6) AS ratio_error,
  round(avg(distance), 6) AS interval_distance, CASE WHEN grouping(street) = 1 THEN round(avg(-ln(greatest(truth_p, 1e-45))), 6) END AS loss FROM judged GROUP BY GROUPING SETS ((street), ())""")
def frozen_metrics(spark, sf_dir):
    found = evaluation.frozen_metrics(_outcomes(spark, sf_dir)).drop("whole").withColumn("street", F.coalesce("street", F.lit("all"))).withColumnRenamed("street", "slice")
    return found.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes])


@query(f"""WITH RECURSIVE {OUTCOMES_SQL} SELECT street, count(*) AS decisions, round(avg(token_correct::INT), 6) AS token_accuracy, round(avg(token_in_top::INT), 6) AS token_top_accuracy, round(avg(action_correct::INT), 6) AS action_accuracy,
  count(*) FILTER (WHERE reason IS NOT NULL) AS illegal, count(*) FILTER (WHERE aggressive) AS aggressive, count(*) FILTER (WHERE hit) AS aggressive_correct, round(avg(CASE WHEN hit THEN abs(said - ratio) END), 6) AS ratio_error,
  round(avg(-ln(greatest(truth_p, 1e-45))), 6) AS loss FROM judged GROUP BY street""")
def merged_metrics(spark, sf_dir):
    """The sums of seven batches of hands, merged."""
    parts = metric_sums.metric_sums(_outcomes(spark, sf_dir).withColumn("batch", F.col("hand") % 7), ["batch", "street"])
    found = metric_sums.rates(metric_sums.merge(parts, ["street"]), ["street"])
    wanted = ("token_accuracy", "token_top_accuracy", "action_accuracy", "illegal", "aggressive", "aggressive_correct", "ratio_error", "loss")
    return found.select("street", "decisions", *[F.round(c, 6).alias(c) if dict(found.dtypes)[c] == "double" else F.col(c) for c in wanted])


@query(f"""WITH RECURSIVE {OUTCOMES_SQL} SELECT count(*) AS decisions, round(avg((truth_group = pred_group)::INT), 6) AS group_accuracy, round(avg((place <= 2)::INT), 6) AS group_top_accuracy,
  round(avg(CASE pred_group WHEN 'FOLD' THEN p_fold WHEN 'PASSIVE' THEN p_pass ELSE p_bet END), 6) AS confidence, round(avg(g), 6) AS truth_probability, round(count(*) FILTER (WHERE aggressive AND token_correct) / count(*) FILTER (WHERE aggressive), 6) AS sizing_accuracy,
  round(avg(abs(truth_middle - pred_middle)), 6) AS ratio_error, round(avg((NOT action_legal)::INT), 6) AS illegal_action_rate, round(avg((reason IS NOT NULL)::INT), 6) AS illegal_rate,
  round(avg(CASE WHEN action_legal AND pred_action IN ('BET', 'RAISE') THEN (reason IS NOT NULL)::INT END), 6) AS illegal_size_rate FROM judged""")
def decision_metrics(spark, sf_dir):
    found = evaluation.decision_metrics(_outcomes(spark, sf_dir), REPRESENTATIVES)
    return found.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes])


@query(f"""WITH RECURSIVE {OUTCOMES_SQL} SELECT count(*) AS decisions, round(avg(-ln(truth_p)), 6) AS loss, round(avg(token_correct::INT), 6) AS token_accuracy, round(avg((truth_group = CASE WHEN p_fold >= p_pass AND p_fold >= p_bet THEN 'FOLD' WHEN p_pass >= p_bet THEN 'PASSIVE' ELSE 'AGGRESSIVE' END)::INT), 6) AS group_accuracy,
  round(avg((place <= 2)::INT), 6) AS group_top_accuracy, round(count(*) FILTER (WHERE truth LIKE 'RANGE_%' AND token_correct) / count(*) FILTER (WHERE truth LIKE 'RANGE_%'), 6) AS sizing_accuracy, round(avg(CASE WHEN truth LIKE 'RANGE_%' THEN abs(truth_middle - pred_middle) END), 6) AS ratio_error FROM judged""")
def trainer_metrics(spark, sf_dir):
    found = evaluation.trainer_metrics(_outcomes(spark, sf_dir), REPRESENTATIVES)
    return found.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes])


@query(f"""WITH RECURSIVE {OUTCOMES_SQL} SELECT k AS hand, ordinal, pred_action || CASE WHEN pred = 'ACTION_ALL_IN' THEN '_ALL_IN' ELSE '' END AS action, round(size::DOUBLE, 4) AS amount, round(CASE WHEN pred_group = 'AGGRESSIVE' THEN size / 100 END, 4) AS amount_bb, pred_group AS grp,
  action_legal, CASE WHEN action_legal AND pred_action IN ('BET', 'RAISE') THEN reason IS NULL END AS size_legal, coalesce(reason, 'legal') AS reason FROM judged""")
def token_legality(spark, sf_dir):
    token, pot, to_call, bet, stack = (F.col(c) for c in ("predicted", "pot", "to_call", "current_bet", "stack"))
    said = decisions.interpret(token, pot, to_call, bet, stack, REPRESENTATIVES)
    return _outcomes(spark, sf_dir).select(
        "hand", F.col("ordinal").cast("long").alias("ordinal"), said["action"].alias("action"), F.round(said["amount"].cast("double"), 4).alias("amount"),
        F.round(decisions.amount_in(F.col("big_blind"), token, pot, stack, REPRESENTATIVES), 4).alias("amount_bb"), F.col("predicted_group").alias("grp"),
        F.col("legality.action_legal").alias("action_legal"), F.col("legality.size_legal").alias("size_legal"), F.coalesce("legality.reason", F.lit("legal")).alias("reason"),
    )


@query(f"WITH RECURSIVE {OUTCOMES_SQL}, bad_ones AS (SELECT * FROM judged WHERE reason IS NOT NULL) SELECT 'reason' AS kind, reason AS what, count(*) AS n FROM bad_ones GROUP BY ALL UNION ALL SELECT 'token', pred, count(*) FROM bad_ones GROUP BY ALL")
def illegal_breakdown(spark, sf_dir):
    return evaluation.illegal_breakdown(_outcomes(spark, sf_dir))


FIVE = ", ".join(f"('{a}')" for a in decisions.ACTIONS)


@query(f"WITH RECURSIVE {OUTCOMES_SQL}, l(a) AS (VALUES {FIVE}) SELECT x.a AS truth_action, y.a AS predicted_action, count(j.k) AS n FROM l x CROSS JOIN l y LEFT JOIN judged j ON j.truth_action = x.a AND j.pred_action = y.a GROUP BY ALL")
def action_confusion(spark, sf_dir):
    labels = spark.createDataFrame([(a,) for a in decisions.ACTIONS], "label string")
    return metrics.confusion(_outcomes(spark, sf_dir), "truth_action", "predicted_action", labels)


PERFECT_SQL = """seqs AS (SELECT k, seat, count(*) AS decisions, count(*) FILTER (WHERE token_correct) AS tokens, count(*) FILTER (WHERE action_correct) AS actions, count(*) FILTER (WHERE reason IS NOT NULL) AS illegal, bool_and(token_correct) AS perfect, bool_and(action_correct) AS perfect_actions FROM judged GROUP BY ALL)"""
SUMMARY_SQL = "count(*) AS sequences, sum(decisions)::BIGINT AS decisions, round(sum(tokens) / sum(decisions), 6) AS token_accuracy, round(sum(actions) / sum(decisions), 6) AS action_accuracy, sum(illegal)::BIGINT AS illegal, count(*) FILTER (WHERE perfect) AS perfect, count(*) FILTER (WHERE perfect_actions) AS perfect_actions"


@query(f"WITH RECURSIVE {OUTCOMES_SQL}, {PERFECT_SQL} SELECT decisions AS \"by\", {SUMMARY_SQL} FROM seqs GROUP BY seqs.decisions")
def by_decision_count(spark, sf_dir):
    found = evaluation.sequence_summary(_outcomes(spark, sf_dir), ["hand", "seat"], F.col("decisions"))
    return found.withColumns({c: F.round(c, 6) for c in ("token_accuracy", "action_accuracy")})


@query(f"WITH RECURSIVE {OUTCOMES_SQL}, {PERFECT_SQL}, banded AS (SELECT *, CASE WHEN (k * 7 + seat * 13) % 350 <= 40 THEN '28-40' WHEN (k * 7 + seat * 13) % 350 <= 80 THEN '41-80' WHEN (k * 7 + seat * 13) % 350 <= 160 THEN '81-160' WHEN (k * 7 + seat * 13) % 350 <= 320 THEN '161-320' END AS band FROM seqs) SELECT band, {SUMMARY_SQL} FROM banded WHERE band IS NOT NULL GROUP BY band")
def length_bands(spark, sf_dir):
    band = evaluation.length_band((F.col("hand") * 7 + F.col("seat") * 13) % 350)
    found = evaluation.sequence_summary(_outcomes(spark, sf_dir), ["hand", "seat"], band, "band")
    return found.withColumns({c: F.round(c, 6) for c in ("token_accuracy", "action_accuracy")})


@query(f"WITH RECURSIVE {OUTCOMES_SQL} SELECT count(*) FILTER (WHERE top >= 0.3) AS confident, count(*) FILTER (WHERE top >= 0.3 AND NOT token_correct) AS wrong FROM judged")
def confident_errors(spark, sf_dir):
    return evaluation.confident_errors(_outcomes(spark, sf_dir), 0.3)


@query(f"WITH RECURSIVE {OUTCOMES_SQL} SELECT s AS street FROM (SELECT unnest(['PREFLOP', 'FLOP', 'TURN', 'RIVER', 'SHOWDOWN']) AS s) WHERE s NOT IN (SELECT street FROM judged)")
def street_gaps(spark, sf_dir):
    return evaluation.street_gaps(_outcomes(spark, sf_dir), ["PREFLOP", "FLOP", "TURN", "RIVER", "SHOWDOWN"])


MARKER = "<PLAYER_1_DECISION>"


@query(f"""WITH RECURSIVE {TOKENS_SQL}, told_ids AS (SELECT k, hero, string_split(tokens, ' ') AS t FROM encoded WHERE error IS NULL),
ends AS (SELECT k, hero, t, unnest(list_filter(range(1, len(t) + 1), lambda i: t[i] = '{MARKER}')) AS e FROM told_ids),
prefixes AS (SELECT k, hero, e, md5(array_to_string(t[1:e], ' ')) AS p FROM ends),
seen AS (SELECT p, count(*) AS n FROM prefixes WHERE k % 5 <> 0 GROUP BY p)
SELECT k AS hand, hero, e::INTEGER AS length, coalesce(n, 0) AS seen FROM prefixes LEFT JOIN seen USING (p) WHERE k % 5 = 0""")
def novelty_decision_prefixes(spark, sf_dir):
    """How many trajectories of train hands begin as each decision of the other hands does."""
    found = _trajectories(spark, sf_dir).where("error is null").select(F.col("hand_key").cast("long").alias("hand"), (F.col("hero") + 1).cast("long").alias("hero"), "tokens")
    # train hands and others are read several times below, but replayed here alone
    found = materialize(found, "novelty-trajectories")
    ends = F.filter(F.transform("tokens", lambda t, i: F.when(t == MARKER, i + 1)), lambda x: x.isNotNull())
    train, others = found.where("hand % 5 <> 0"), found.where("hand % 5 = 0")
    return prefixes.prefix_counts(others, train, ["hand", "hero"], "tokens", ends).select("hand", "hero", F.col("k").alias("length"), F.col("n").alias("seen"))


def _stored(spark, sf_dir) -> DataFrame:
    """Encoded trajectories, some of them damaged, each in another way."""
    k = F.col("hand_key").cast("long")
    rows = _trajectories(spark, sf_dir).where("error is null").withColumns({"hand": k, "split": F.when(k % 4 == 0, "val").otherwise("train")})
    cut = lambda c: F.when(k % 10 == 0, F.slice(c, F.lit(1), F.size(c) - 1)).otherwise(F.col(c))
    rows = rows.withColumns({c: cut(c) for c in ("tokens", "ids", "loss_mask")})
    return rows.withColumns(
        {
            "loss_mask": F.when(k % 10 == 1, F.transform("loss_mask", lambda x: x * 0)).otherwise(F.col("loss_mask")),
            "tokens": F.when(k % 10 == 2, F.transform("tokens", lambda t, i: F.when(i == 1, "PLAYER_1").otherwise(t)))
            .when(k % 10 == 3, F.transform("tokens", lambda t: F.when(t == "POT_SIZE_BB", "STACK_POT").otherwise(t)))
            .otherwise(F.col("tokens")),
        }
    )


@query(f"""WITH RECURSIVE {TOKENS_SQL}, e AS (SELECT k, k * 10 + hero - 1 AS key, CASE WHEN k % 4 = 0 THEN 'val' ELSE 'train' END AS split FROM encoded WHERE error IS NULL),
v AS (SELECT *, unnest(CASE k % 10 WHEN 0 THEN ['framing'] WHEN 1 THEN ['no_target', 'targets_of_a_decision', 'decision_and_target_counts'] WHEN 2 THEN ['no_position'] WHEN 3 THEN ['observation'] ELSE [] END) AS violated FROM e)
SELECT violated, split, count(*) AS n, min(key) AS example FROM v GROUP BY ALL""")
def sequence_violations(spark, sf_dir):
    return artifacts.violations(_stored(spark, sf_dir), F.col("hand") * 10 + F.col("hero"))


@query(f"""WITH RECURSIVE {TOKENS_SQL} SELECT k AS hand, hero, CASE WHEN k % 7 = 0 THEN 'unexpected' WHEN k % 11 = 0 THEN 'missing' ELSE 'different' END AS state FROM encoded
WHERE error IS NULL AND NOT (k % 7 = 0 AND k % 11 = 0) AND (k % 7 = 0 OR k % 11 = 0 OR k % 10 IN (2, 3))""")
def stored_and_replayed(spark, sf_dir):
    made = _trajectories(spark, sf_dir).where("error is null").withColumn("hand", F.col("hand_key").cast("long"))
    kept = _stored(spark, sf_dir).where("hand % 10 not in (0, 1)").unionByName(made.where("hand % 10 in (0, 1)"), allowMissingColumns=True)
    found = artifacts.compare_stored(kept.where("hand % 7 <> 0"), made.where("hand % 11 <> 0"), ["hand", "hero"], ["tokens"])
    return found.withColumn("hero", (F.col("hero") + 1).cast("long"))


@query(f"""WITH RECURSIVE {TOKENS_SQL}, ends AS (SELECT g.k, l.hero, saw_board FROM last l JOIN good g ON g.k = l.k AND g.i = l.i)
SELECT e.k AS hand, e.hero, c1 || ' ' || c2 AS hole, array_to_string(saw_board, ' ') AS board, (['Small Blind', 'Big Blind', 'Utg', 'Hijack', 'Cutoff', 'Button'])[e.hero] AS position FROM encoded e JOIN held h ON h.k = e.k AND h.hero = e.hero JOIN ends x ON x.k = e.k AND x.hero = e.hero WHERE error IS NULL""")
def cards_seen(spark, sf_dir):
    seen = _trajectories(spark, sf_dir).where("error is null").select(F.col("hand_key").cast("long").alias("hand"), (F.col("hero") + 1).cast("long").alias("hero"), artifacts.cards_seen(F.col("tokens")).alias("s"))
    return seen.select("hand", "hero", F.array_join("s.hole", " ").alias("hole"), F.array_join("s.board", " ").alias("board"), F.col("s.position").alias("position"))


@query(f"""WITH RECURSIVE {TOKENS_SQL} SELECT e.k AS hand, e.hero, array_to_string(list_sort([c1, c2]), ' ') AS leaked FROM encoded e JOIN held h ON h.k = e.k AND h.hero = e.hero WHERE error IS NULL AND e.k % 2 = 1""")
def leaked_cards(spark, sf_dir):
    # of odd hands the cards are looked at from the next seat, whose player must not see them
    made = _trajectories(spark, sf_dir, ("holes",)).where("error is null")
    k, hero = F.col("hand_key").cast("long"), F.col("hero")
    seat = F.when(k % 2 == 1, (hero + 1) % 6).otherwise(hero)
    found = once(made, {"leaked": artifacts.leaked_cards(F.col("tokens"), F.col("holes"), seat)}).where(F.size("leaked") > 0)
    return found.select(k.alias("hand"), (hero + 1).cast("long").alias("hero"), F.array_join("leaked", " ").alias("leaked"))


@query(f"""WITH RECURSIVE {TOKENS_SQL}, e AS (SELECT *, len(string_split(tokens, ' ')) - CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END AS n FROM encoded WHERE error IS NULL)
SELECT CASE WHEN k % 4 = 0 THEN 'val' ELSE 'train' END AS split, count(*) AS sequences, sum(n)::BIGINT AS tokens, sum(CASE WHEN k % 10 = 1 THEN 0 ELSE decisions END)::BIGINT AS supervised, min(n)::BIGINT AS least, max(n)::BIGINT AS most FROM e GROUP BY ALL""")
def split_report(spark, sf_dir):
    found = artifacts.split_report(_stored(spark, sf_dir))
    return found.withColumns({c: F.col(c).cast("long") for c in ("least", "most")})


@query(f"""WITH {TEXT_SQL} SELECT 'rejected' AS dimension, ({REASON_SQL}) AS key, count(*) AS n FROM rows WHERE ({REASON_SQL}) IS NOT NULL GROUP BY ALL UNION ALL SELECT 'source', source_folder, count(*) FROM rows WHERE ({REASON_SQL}) IS NULL GROUP BY ALL""")
def selection_counts(spark, sf_dir):
    rows = _manifest(spark, sf_dir)
    accepted = rows.where(selection.rejection(**RULES).isNull()).withColumn("split", F.lit("all"))
    return selection.selection_summary(rows, accepted, **RULES).where("dimension <> 'split'")


@query(f"""WITH {HANDS_SQL} SELECT n AS seats, count(*) AS n FROM hands WHERE k % 3 = 0 OR n IN (4) OR k % 3 = 2 GROUP BY ALL""")
def allowed_seats(spark, sf_dir):
    # no list allows all, as does an empty one; the others allow four seats
    k = F.col("hand_key").cast("long")
    allowed = F.when(k % 3 == 1, F.array(F.lit(4))).when(k % 3 == 2, F.array().cast("array<int>"))
    found = selection.allowed_players(hands(spark, sf_dir).withColumn("selected_player_counts", allowed))
    return found.groupBy(F.size("stacks").alias("seats")).agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {FOLD_SQL} SELECT count(*) AS players, count(DISTINCT k) AS hands FROM (SELECT DISTINCT k, p FROM good WHERE op <> 'board') g JOIN holes h ON h.k = g.k AND h.s = g.p WHERE NOT known""".replace("count(DISTINCT k)", "count(DISTINCT g.k)"))
def unknown_heroes(spark, sf_dir):
    return trajectories.unknown_heroes(replay.replay(hands(spark, sf_dir)))


STREETS = ["PREFLOP", "FLOP", "TURN", "RIVER"]


@query(f"""WITH RECURSIVE {OUTCOMES_SQL}, l(a) AS (VALUES {FIVE}), s AS (SELECT unnest({STREETS}) AS street), c AS (SELECT s.street, a AS predicted_action, count(j.k) AS n FROM s CROSS JOIN l LEFT JOIN judged j ON j.street = s.street AND j.pred_action = a GROUP BY ALL)
SELECT street, predicted_action, n, round(n / nullif(sum(n) OVER (PARTITION BY street), 0), 6) AS share FROM c""")
def street_behaviour(spark, sf_dir):
    found = metrics.dense_shares(_outcomes(spark, sf_dir), "street", STREETS, "predicted_action", list(decisions.ACTIONS))
    return found.withColumn("share", F.round("share", 6))
