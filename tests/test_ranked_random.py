"""Elimination rounds against a plain count by hand, over many random elections at once."""

from __future__ import annotations

import random

import pytest

from tallyspark.operators import ranked


def count_by_hand(ballots, declare_tie):
    """History as {round: {candidate: votes}} and the outcome of one contest."""
    out, history = set(), []
    while True:
        tops = [next((c for c in b if c not in out), None) for b in ballots]
        votes = {c: tops.count(c) for c in set(tops) if c is not None}
        if not votes:
            return history, ("no_majority", None)
        history.append(votes)
        best = max(votes.values())
        leader = min(c for c, v in votes.items() if v == best)
        if 2 * best > sum(votes.values()) or len(votes) == 1:
            return history, ("winner", leader)
        level = len(set(votes.values())) == 1
        if len(votes) == 2 or (level and declare_tie):
            return history, ("tie", None)
        out |= {max(votes)} if level else {c for c, v in votes.items() if v == min(votes.values())}


@pytest.mark.parametrize("tie_rule", ranked.TIE_RULES)
def test_random_elections(spark, tie_rule):
    rng = random.Random(7)
    elections = {}
    for contest in range(1, 121):
        names = [f"C{i}" for i in range(rng.randint(2, 6))]
        elections[contest] = [rng.sample(names, rng.randint(1, len(names))) for _ in range(rng.randint(1, 14))]
    rows = [(c, b) for c, ballots in elections.items() for b in ballots]
    ballots = spark.createDataFrame(rows, "contest_id bigint, prefs array<string>")
    rounds = ranked.irv_rounds(ballots, tie_rule)
    history = {}
    for r in rounds.collect():
        history.setdefault(r["contest_id"], {}).setdefault(r["round"], {})[r["candidate"]] = r["votes"]
    results = {r["contest_id"]: r for r in ranked.irv_results(ballots, rounds).collect()}
    outcomes = set()
    for contest, cast in elections.items():
        expected, (outcome, winner) = count_by_hand(cast, tie_rule == "declare_tie")
        assert [history[contest][i + 1] for i in range(len(expected))] == expected
        assert len(history[contest]) == len(expected)
        assert (results[contest]["outcome"], results[contest]["winner"]) == (outcome, winner)
        assert results[contest]["total_ballots"] == len(cast)
        outcomes.add(outcome)
    assert {"winner", "tie"} <= outcomes
