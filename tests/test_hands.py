import zipfile

import pytest
from pyspark.sql import functions as F

from replayframe import hand_queries
from replayframe.functions import vocabulary
from replayframe.operators import replay, trajectories
from replayframe.sources.archive import ArchiveSource
from replayframe.sources.hands import hands, whole_members
from replayframe.sources.native import native_hands


def toml(actions, seats=6, blinds=(50, 100), min_bet=100, stacks=None, antes=0, variant="NT"):
    stacks = stacks or [10_000] * seats
    posted = [*blinds, *[0] * (seats - 2)]
    return (
        f"variant = '{variant}'\nantes = {[antes] * seats}\nblinds_or_straddles = {posted}\nmin_bet = {min_bet}\n"
        f"starting_stacks = [{', '.join(map(str, stacks))}]\nactions = {actions}\n"
    )


def deal(*held):
    return [f"d dh p{i + 1} {c}" for i, c in enumerate(held)]


SIX = deal("2c9d", "JhTh", "AcAd", "7s8s", "Kc4d", "QdQh")
#: A hand over four streets, as what is dealt and done; the flag says whether chips went in.
PLAY = [
    ("p3 cbr 250", 1), ("p4 f", 0), ("p5 f", 0), ("p6 cc", 1), ("p1 f", 0), ("p2 cc", 1), ("d db 4hTc2s", 3), ("p2 cc", 0), ("p3 cbr 400", 1), ("p6 f", 0), ("p2 cc", 1),
    ("d db Ks", 1), ("p2 cc", 0), ("p3 cc", 0), ("d db 5d", 1), ("p2 cbr 900", 1), ("p3 f", 0),
]
STREETS = [*SIX, *[x for x, _ in PLAY]]
SHOVE = [*SIX, "p3 cbr 300", "p4 cbr 10000", "p5 f", "p6 f", "p1 f", "p2 f", "p3 f"]
FOUR = deal("9c9h", "KsQs", "3d3s", "AhJd")
SMALL_RAISE = [*FOUR, "p3 cbr 30", "p4 cbr 45"]
SHORT_ALL_IN = [*FOUR, "p3 cbr 50", "p4 cbr 65", "p1 cc", "p2 cc", "p3 cc"]


def token_lengths():
    """How many tokens each player's view of PLAY takes, by adding up what each event costs."""
    out = []
    for hero in range(1, 7):
        own = [i for i, (x, _) in enumerate(PLAY) if x.startswith(f"p{hero} ")]
        total, active, board = 3, 6, 0
        for x, n in PLAY[: own[-1] + 1]:
            if x.startswith("d db"):
                total, board = total + 2 + n, board + n
                continue
            total += 9 + (2 + board if board else 0) + 4 * active if x.startswith(f"p{hero} ") else 2 + 4 * n
            active -= x.endswith(" f")
        out.append(total)
    return out


@pytest.fixture(scope="module")
def replayed(spark):
    texts = {
        "streets.phh": toml(STREETS), "shove.phh": toml(SHOVE), "small.phh": toml(SMALL_RAISE, 4, (5, 10), 10, [100] * 4), "short_all_in.phh": toml(SHORT_ALL_IN, 4, (10, 20), 20, [500, 500, 500, 65]),
        "ante.phh": toml(STREETS, antes=10), "short.phh": toml(STREETS, stacks=[9_900] * 6), "inf.phh": toml(STREETS, stacks=["inf", *[10_000] * 5]), "ft.phh": toml(STREETS, variant="FT"),
        "none.phh": toml(SIX), "odd.phh": toml(["p1 dances"]), "bad.phh": "= 1", "two.phhs": f"title = 'x'\n[a]\n{toml(STREETS)}\n[b]\n{toml(SHOVE)}",
    }
    rows = [(k, v, None) for k, v in texts.items()] + [("gone.phh", None, "member_not_found")]
    return replay.replay(hands(spark.createDataFrame(rows, "member string, content string, error string"))).cache()


def test_actions_and_amounts(replayed):
    d = replay.decisions(replayed.where("member = 'streets.phh'")).orderBy("event_count").collect()
    assert [r.target_action for r in d] == ["RAISE", "FOLD", "FOLD", "CALL", "FOLD", "CALL", "CHECK", "BET", "FOLD", "CALL", "CHECK", "CHECK", "BET", "FOLD"]
    assert [int(r.target_amount) for r in d] == [250, 0, 0, 250, 0, 150, 0, 400, 0, 400, 0, 0, 900, 0]
    assert (int(d[7].pot), d[7].hero_cards, d[7].street, d[7].board) == (800, ["Ac", "Ad"], "FLOP", ["4h", "Tc", "2s"])
    assert d[7].player_statuses == ["FOLDED", "ACTIVE", "ACTIVE", "FOLDED", "FOLDED", "ACTIVE"] and int(d[7].effective_stack) == 9_750
    assert [r.street for r in d[10:]] == ["TURN", "TURN", "RIVER", "RIVER"]


def test_errors_are_rows(replayed):
    found = {(r.member, r.hand_key): r.error for r in replayed.collect()}
    assert found["small.phh", "1"] == "below the minimum" and found["none.phh", "1"] == "no action" and found["odd.phh", "1"] == "unknown action"
    assert found["inf.phh", "1"] == "a number is not finite or negative" and found["ft.phh", "1"] == "variant"
    assert found["bad.phh", None] == "invalid TOML" and found["gone.phh", None] == "member_not_found"
    assert found["two.phhs", "a"] is None and found["two.phhs", "b"] is None and len(found) == 14


def test_short_all_in_does_not_reopen(replayed):
    d = replay.decisions(replayed.where("member = 'short_all_in.phh'")).orderBy("event_count").collect()
    assert [(r.actor, r.reopened) for r in d] == [(2, True), (3, True), (0, True), (1, True), (2, False)]


def test_trajectories(replayed):
    t = {(r.member, r.hero): r for r in trajectories.trajectories(replayed).collect()}
    assert [t["streets.phh", i].token_len for i in range(6)] == token_lengths()
    targets = lambda r: [x for x, m in zip(r.tokens, r.loss_mask) if m]
    assert targets(t["streets.phh", 2]) == ["RANGE_1.5_TO_2", "RANGE_0.25_TO_0.5", "ACTION_PASSIVE", "ACTION_FOLD"]
    assert targets(t["streets.phh", 1]) == ["ACTION_PASSIVE"] * 4 + ["RANGE_0.5_TO_0.75"]
    assert targets(t["shove.phh", 3]) == ["ACTION_ALL_IN"]
    assert t["ante.phh", 0].error == "blinds" and t["short.phh", 0].error == "depth" and t["ante.phh", 0].tokens is None
    assert all(len(r.ids) == len(r.loss_mask) == r.token_len and None not in r.ids for r in t.values() if r.error is None)


def test_native_path_reads_what_the_parser_reads(spark):
    texts = {"a.phh": toml(STREETS), "b.phhs": f"title = 'x'\n[one]\n{toml(SHOVE)}\n[two]\n{toml(SMALL_RAISE, 4, (5, 10), 10, [100] * 4)}venue = \"Here\"\n", "c.phh": toml(STREETS, stacks=["inf", *[10_000] * 5]), "d.phhs": "nothing"}
    rows = [(k, v, None) for k, v in texts.items()] + [("e.phh", None, "member_not_found"), ("f.phh", "variant = 'NT'\n", None)]
    members = spark.createDataFrame(rows, "member string, content string, error string")
    fields = ["member", "hand_key", "variant", "antes", "blinds", "min_bet", "stacks", "actions", "venue", "finite"]
    good = lambda df: sorted(map(repr, df.where("error is null").select(fields).collect()))
    fast = native_hands(members)
    assert good(fast) == good(hands(members)) and len(good(fast)) == 4
    assert {(r.member, r.error) for r in fast.where("error is not null").collect()} == {("d.phhs", "no hand"), ("e.phh", "member_not_found"), ("f.phh", "missing actions")} or {
        r.member for r in fast.where("error is not null").collect()
    } == {"d.phhs", "e.phh", "f.phh"}


def test_vocabulary(spark):
    names = vocabulary.vocabulary()
    assert len(names) == len(set(names)) == 105 and len(vocabulary.decision_tokens()) == 13
    back = spark.createDataFrame([(names,)], "t array<string>").select(vocabulary.tokens(vocabulary.ids(F.col("t")))).first()[0]
    assert back == names


def test_archive(spark, tmp_path):
    path = tmp_path / "hands.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.mkdir("data")
        for name, text in {"data/a/x/1.phh": toml(STREETS), "data/b/2.PHHS": f"[a]\n{toml(STREETS)}\n[b]\n= 1", "data/c/3.phh": "", "data/d.txt": "no"}.items():
            z.writestr(name, text)
    spark.dataSource.register(ArchiveSource)
    load = lambda **k: spark.read.format("archive_members").options(path=str(path), partition_bytes="5000", **k).load()
    rows = {r.member: r for r in load().collect()}
    assert set(rows) == {"data/a/x/1.phh", "data/b/2.PHHS", "data/c/3.phh"} and rows["data/c/3.phh"].error == "empty_member"
    assert load(segment="b").count() == 1 and load(limit="2").count() == 2
    assert load(prefix="data/a/").count() == 1 and load(header_bytes="10").where("bytes_read > 10").count() == 0
    assert load(max_member_bytes="20").where("error = 'member_too_large'").count() == 2
    assert [r.member for r in whole_members(hands(load())).collect()] == ["data/a/x/1.phh"]


def test_hands_are_folded_once(spark):
    """What reads the replayed hands doesn't repeat the fold in its plan."""
    before = spark.conf.get("spark.sql.maxPlanStringLength")
    spark.conf.set("spark.sql.maxPlanStringLength", str(1 << 30))
    try:
        for made in (hand_queries.hand_replay, hand_queries.hand_decisions, hand_queries.hand_trajectories, hand_queries.frozen_metrics):
            plan = made(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
            assert plan.count("player is not in the hand") == 1, made.__name__
    finally:
        spark.conf.set("spark.sql.maxPlanStringLength", before)


def _folds(spark, made):
    """How often the plan of a query replays the hands."""
    before = spark.conf.get("spark.sql.maxPlanStringLength")
    spark.conf.set("spark.sql.maxPlanStringLength", str(1 << 30))
    try:
        return made(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().count("player is not in the hand")
    finally:
        spark.conf.set("spark.sql.maxPlanStringLength", before)


def test_leaked_cards_replay_once(spark):
    """The cards of the hand come along with its trajectories, so nothing is replayed again and joined."""
    assert _folds(spark, hand_queries.leaked_cards) == 1


def test_steps_of_the_fold_copy_nothing(spark):
    """Only the state that the fold starts from is cast as a whole: a cast in a step copies all events before it."""
    end = replay.replay(hand_queries.hands(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().analyzed().toString()
    assert end.count("as struct<error:string,stacks") <= 1


def test_odd_actions(spark):
    """What is no action stays none, whatever letters it begins with."""
    said = ["p1 f", "p1 f x", "p2 cc", "p12 cbr 20.5", "p1 cbr -3", "p1 cbr", "p1 cbr 1 2", "p1 xcbr 5", "p3 sm AsKd", "p3 k-x", "p3 km", "d dh p1 AsKd", "d dh p1 AsK", "d dh p1 As Kd", "d dh px AsKd", "d db AsKdQc", "d db ", "x", "", None]
    found = spark.createDataFrame([(said,)], "a array<string>").select(replay.parse_actions(F.col("a")).alias("p")).first().p
    assert [x.op for x in found] == ["f", None, "cc", "cbr", None, None, None, None, "show", "show", None, "hole", None, None, None, "board", None, None, None, None]
    assert [found[i].player for i in (0, 2, 3, 8, 11, 15)] == [0, 1, 11, 2, 0, None] and str(found[3].amount) == "20.5000" and found[15].cards == ["As", "Kd", "Qc"]


def test_novelty_replays_once(spark):
    """Hands are replayed where their trajectories are written; the plan reads these."""
    assert _folds(spark, hand_queries.novelty_decision_prefixes) == 0


def test_places_of_a_sequence_are_found_once(spark):
    """Checks of a sequence share one pass for its decisions, reveals and targets, and judge odd masks as before."""
    from replayframe.operators import artifacts

    good = "<BOS> POSITION_UTG <PLAYER_1_DECISION> PLAYER_1_HOLE_CARDS CARD_As CARD_Kd POT_SIZE_BB RANGE_ZERO TO_CALL_BB RANGE_ZERO PLAYER_2 ACTION_FOLD <EOS>".split()
    mask = [0] * 11 + [1, 0]
    rows = [(0, good, mask), (1, good, [*mask[:11], 2, 0]), (2, good, [*mask[:11], None, 0]), (3, [], []), (4, good, [*mask[:10], 1, 1, 0]), (5, [*good[:2], *good[3:]], [*mask[:2], *mask[3:]]), (6, None, None)]
    df = spark.createDataFrame(rows, "k int, tokens array<string>, loss_mask array<tinyint>").withColumns({"ids": vocabulary.ids(F.col("tokens")), "split": F.col("k").cast("string")})
    found = artifacts.violations(df, F.col("k"))
    assert found._jdf.queryExecution().analyzed().toString().count("sequence(0, ") <= 1
    by = {k: sorted(r.violated for r in found.collect() if r.example == k) for k in range(7)}
    count = "decision_and_target_counts"
    assert by[0] == [] and by[1] == [count, "mask_value", "no_target", "targets_of_a_decision"] and by[2] == [count, "no_target"] and by[3] == ["no_decision", "no_position", "no_target"]
    assert by[4] == [count, "odd_target", "targets_of_a_decision"] and by[5] == [count, "no_decision"] and by[6] == ["no_position"]
