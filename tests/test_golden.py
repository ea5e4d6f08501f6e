"""Known results: elections small enough to count by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import audit, ingest, ranked, reports, summary, winners
from tests.builders import dicts, mark, marks_df, scan, scans_df, star_of


def prefs_df(spark, ballots, contest=1):
    return spark.createDataFrame([(contest, list(b)) for b in ballots], "contest_id bigint, prefs array<string>")


def by_round(rounds):
    out = {}
    for r in rounds.collect():
        out.setdefault(r["round"], {})[r["candidate"]] = (r["votes"], r["fate"])
    return out


def test_five_candidates_bulk_elimination(spark):
    pairs = [("1", "2")] * 3 + [("2", "1")] * 2 + [("3", "1")] * 2 + [("4", "1")] * 2 + [("5", "1")]
    ballots = prefs_df(spark, [[f"Candidate {a}", f"Candidate {b}"] for a, b in pairs])
    rounds = ranked.irv_rounds(ballots)
    seen = by_round(rounds)
    assert {c: v for c, (v, _) in seen[1].items()} == {f"Candidate {i}": n for i, n in zip(range(1, 6), (3, 2, 2, 2, 1))}
    assert [c for c, (_, f) in seen[1].items() if f == "eliminated"] == ["Candidate 5"]
    assert sorted(c for c, (_, f) in seen[2].items() if f == "eliminated") == ["Candidate 2", "Candidate 3", "Candidate 4"]
    assert seen[2]["Candidate 1"][0] == 4
    assert seen[3] == {"Candidate 1": (10, "winner")}
    result = ranked.irv_results(ballots, rounds).first()
    assert (result["rounds"], result["winner"], result["outcome"], result["total_ballots"]) == (3, "Candidate 1", "winner", 10)


def test_eighteen_ballots_three_rounds(spark):
    ballots = prefs_df(spark, [["A"]] * 7 + [["B", "A"]] * 5 + [["C", "A"]] * 4 + [["D", "A"]] * 2)
    rounds = ranked.irv_rounds(ballots)
    seen = by_round(rounds)
    assert rounds.filter("round = 1").first()["majority"] == 10
    assert (seen[1]["D"], seen[2]["A"][0], seen[2]["C"], seen[3]["A"]) == ((2, "eliminated"), 9, (4, "eliminated"), (13, "winner"))


def test_round_report_of_redistribution(spark):
    ballots = prefs_df(spark, [["A"]] * 7 + [["B", "A"]] * 5 + [["C", "A"]] * 4 + [["D", "A"]] * 2)
    report = {(r["round"], r["candidate"]): r for r in ranked.irv_round_report(ranked.irv_rounds(ballots)).collect()}
    assert report[1, "A"]["change_vs_first"] is None and report[1, "A"]["redistributed_from"] is None
    assert (report[2, "A"]["change_vs_first"], report[2, "A"]["redistributed_from"], report[2, "A"]["redistributed_votes"]) == (2, "D", 2)
    assert report[3, "A"]["pct_of_active"] == 100.0 * 13 / 18


def test_all_equal_drops_last_name_or_declares_tie(spark):
    ballots = prefs_df(spark, [["A", "B"], ["B", "A"], ["C", "A"]])
    seen = by_round(ranked.irv_rounds(ballots))
    assert seen[1]["C"] == (1, "eliminated") and seen[1]["A"] == (1, "continuing")
    assert seen[2]["A"] == (2, "winner")
    tied = ranked.irv_rounds(ballots, tie_rule="declare_tie")
    assert {r["fate"] for r in tied.collect()} == {"tied"}
    assert ranked.irv_results(ballots, tied).first()["outcome"] == "tie"


def test_two_equal_is_a_tie_and_exhausted_contest_has_no_majority(spark):
    ballots = prefs_df(spark, [["A"], ["B"]]).union(prefs_df(spark, [["A"], ["B"], ["B"]], contest=2))
    results = {r["contest_id"]: r for r in ranked.irv_results(ballots, ranked.irv_rounds(ballots)).collect()}
    assert (results[1]["outcome"], results[1]["winner"]) == ("tie", None)
    assert (results[2]["outcome"], results[2]["winner"]) == ("winner", "B")


def _votes(spark, rows):
    return spark.createDataFrame(rows, "contest string, candidate string, votes bigint")


def _config(spark, rows):
    return spark.createDataFrame(rows, "contest string, max_votes int, percent_to_win double, contest_type string")


def test_vote_for_two_has_no_threshold(spark):
    votes = _votes(spark, [("Council", f"Candidate {i}", n) for i, n in zip(range(1, 6), (7, 5, 4, 3, 1))])
    ranked_rows = winners.rank_winners(votes, _config(spark, [("Council", 2, 50.0, "PLURALITY")]))
    assert sorted(r["candidate"] for r in ranked_rows.collect() if r["winner"]) == ["Candidate 1", "Candidate 2"]


def test_sixty_percent_measure(spark):
    votes = _votes(spark, [("Measure", "Yes", 7), ("Measure", "No", 3)])
    rows = winners.rank_winners(votes, _config(spark, [("Measure", 1, 60.0, "MEASURE")])).collect()
    assert [r["candidate"] for r in rows if r["winner"]] == ["Yes"]


def test_threshold_must_be_exceeded(spark):
    votes = _votes(spark, [("half", "A", 5), ("half", "B", 5), ("sixty", "Yes", 6), ("sixty", "No", 4), ("none", "A", 0)])
    config = _config(spark, [("half", 1, 50.0, "PLURALITY"), ("sixty", 1, 60.0, "MEASURE"), ("none", 1, 50.0, "PLURALITY")])
    rows = winners.rank_winners(votes, config)
    assert not [r for r in rows.collect() if r["winner"]]
    lost = winners.no_winner_contests(rows.withColumnRenamed("votes", "counted"))
    assert {r["contest"] for r in lost.collect()} == {"half", "sixty", "none"}


def test_ranked_and_approval_contests_have_no_plain_winner(spark):
    votes = _votes(spark, [("R", "A", 9), ("P", "A", 9)])
    rows = winners.rank_winners(votes, _config(spark, [("R", 1, 50.0, "RANKED_CHOICE"), ("P", 9, 50.0, "APPROVAL")]))
    assert not [r for r in rows.collect() if r["winner"]]


def test_no_votes_no_rows(spark):
    assert winners.rank_winners(_votes(spark, []), _config(spark, [])).count() == 0
    assert ranked.irv_rounds(prefs_df(spark, [])).count() == 0


def test_measure_end_to_end(spark):
    """Ten marked sheets, from measured boxes to the report."""
    marks = []
    for i in range(1, 11):
        for seq, name in enumerate(("Yes", "No"), start=1):
            marks.append(mark(i, seq, name, marked=(name == "Yes") == (i <= 7), title="Measure", kind="MEASURE", percent=60.0))
    star = star_of(spark, [scan(i) for i in range(1, 11)], marks)
    report = {r["candidate"]: r for r in winners.results_report(star).collect()}
    assert (report["Yes"]["counted"], report["Yes"]["winner"], report["No"]["counted"], report["No"]["winner"]) == (7, True, 3, False)
    assert dicts(winners.nondefault_thresholds(star)) == [{"contest": "Measure", "percent_to_win": 60.0}]
    assert reports.headline_totals(star).first().asDict() == {
        "votes_cast": 10, "ballot_images": 10, "overvoted_images": 0, "flagged_images": 0}


def test_undecided_contest_is_listed(spark):
    marks = [mark(i, 1, "A" if i % 2 else "B") for i in range(1, 5)]
    star = star_of(spark, [scan(i) for i in range(1, 5)], marks)
    assert [r["contest"] for r in winners.no_winner_contests(winners.results_report(star)).collect()] == ["Mayor"]
    assert reports.votes_by_contest(star).agg(F.sum("voted")).first()[0] == 4


def test_marks_keep_their_order(spark):
    """A, B, A stays A, B, A in the choices, the detail line and the cell."""
    kinds = {"title": "Pick", "kind": "APPROVAL", "max_votes": 9}
    marks = [mark(1, 1, "A", candidate_id=1, **kinds), mark(1, 2, "B", candidate_id=2, **kinds), mark(1, 3, "A", candidate_id=1, **kinds)]
    scans = [scan(1)]
    chosen = summary.valid_choices(ingest.classify_marks(marks_df(spark, marks)), scans_df(spark, scans))
    row = chosen.first()
    assert row["names"] == ["A", "B", "A"]
    assert [(c["name"], c["times"]) for c in row["choices"]] == [("A", 2), ("B", 1)]
    assert summary.image_detail(chosen).first()["line"].endswith("): A, B, A")
    star = star_of(spark, scans, marks)
    assert audit.contest_cells(star).first()["cell"] == "A|B|A"
    assert audit.cvr_export(star).first()["Pick"] == "A|B|A"
