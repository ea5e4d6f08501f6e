"""Ingest rules on hand-made sheets."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import measure, text
from tallyspark.operators import audit, ingest, reports, review, summary
from tallyspark.plans import election
from tests.builders import dicts, mark, marks_df, scan, scans_df, star_of


def statuses(spark, marks):
    rows = ingest.assign_vote_status(ingest.classify_marks(marks_df(spark, marks))).collect()
    return {(r["image_id"], r["seq"]): r["vote_status"] for r in rows}


def test_overvote_marks_only_what_is_marked(spark):
    got = statuses(spark, [mark(1, 1, "A"), mark(1, 2, "B"), mark(1, 3, "C", marked=False), mark(2, 1, "A")])
    assert got == {(1, 1): "OVERVOTED", (1, 2): "OVERVOTED", (1, 3): "UNMARKED", (2, 1): "VOTED"}


def test_missing_candidate_ids_count_as_one(spark):
    one = [dict(mark(1, s, f"N{s}"), candidate_id=None) for s in (1, 2)]
    two = [dict(mark(2, 1, "A"), candidate_id=None), mark(2, 2, "B", candidate_id=5)]
    got = statuses(spark, one + two)
    assert got[1, 1] == "VOTED" and got[2, 1] == "OVERVOTED"


def test_approval_is_never_overvoted_and_zero_seats_mean_one(spark):
    approval = [mark(1, s, f"N{s}", kind="APPROVAL", max_votes=1) for s in (1, 2, 3)]
    zero = [mark(2, s, f"N{s}", max_votes=0) for s in (1, 2)]
    got = statuses(spark, approval + zero)
    assert {got[1, s] for s in (1, 2, 3)} == {"VOTED"} and {got[2, s] for s in (1, 2)} == {"OVERVOTED"}


def test_ranked_overvote_spoils_only_its_rank(spark):
    ranks = [mark(1, 1, "A (Rank 1)", kind="RANKED_CHOICE"), mark(1, 2, "B (Rank 1)", kind="RANKED_CHOICE"),
             mark(1, 3, "C (Rank 2)", kind="RANKED_CHOICE"), mark(1, 4, "D", kind="RANKED_CHOICE")]
    got = statuses(spark, ranks)
    assert got == {(1, 1): "OVERVOTED", (1, 2): "OVERVOTED", (1, 3): "VOTED", (1, 4): "VOTED"}


def test_settings_come_from_the_first_mark(spark):
    mixed = [mark(1, 1, "A", max_votes=2, marked=False), mark(1, 2, "B", max_votes=1), mark(1, 3, "C", max_votes=1)]
    assert set(statuses(spark, mixed).values()) == {"UNMARKED", "VOTED"}
    missing_ids = [mark(2, 1, "A", contest_id=None, kind="APPROVAL"), mark(2, 2, "B", contest_id=None), mark(2, 3, "C", contest_id=None)]
    assert set(statuses(spark, missing_ids).values()) == {"VOTED"}


@pytest.mark.parametrize(
    "more, marked, pct",
    [
        (dict(dark_pct=8.0), True, 8.0),
        (dict(dark_pct=7.9, trimmed_pct=7.99), False, 7.9),
        (dict(dark_pct=5.0, trimmed_pct=8.0), True, 8.0),
        (dict(dark_pct=4.9, trimmed_pct=50.0), False, 4.9),
        (dict(dark_pct=50.0, total_pixels=0), False, 0.0),
        (dict(dark_pct=0.0, indicator_style="arrow", zone_dark=1), True, 100.0),
        (dict(dark_pct=90.0, indicator_style="CONNECT_DOTS", zone_dark=0), False, 0.0),
    ],
)
def test_classify(spark, more, marked, pct):
    row = ingest.classify_marks(marks_df(spark, [mark(1, 1, "A", **more)])).first()
    assert (row["marked"], row["dark_pct"]) == (marked, pct)


def test_higher_minimum_widens_the_band_to_ten(spark):
    row = ingest.classify_marks(marks_df(spark, [mark(1, 1, "A", dark_pct=9.0, trimmed_pct=12.0)]), 12.0).first()
    assert row["marked"]
    row = ingest.classify_marks(marks_df(spark, [mark(1, 1, "A", dark_pct=10.0, trimmed_pct=12.0)]), 12.0).first()
    assert not row["marked"]


def test_star_of_duplicates_review_and_blanks(spark):
    scans = [scan(1, "/in/x.png"), scan(2, "/in/x.png"), scan(3, error="blurred"), scan(4, barcode=None)]
    star = star_of(spark, scans, [mark(1, 1, "A"), mark(2, 1, "A"), mark(3, 1, "Z")])
    assert sorted(r["id"] for r in star.ballot_image.collect()) == [1, 4]
    assert star.vote_opportunity.count() == 1
    assert [r["candidate_name"] for r in star.candidate.collect()] == ["A"]
    assert [r["raw_data"] for r in star.barcode.orderBy("id").collect()] == ["", "1|10|2|1|1|1"]
    good, waiting = ingest.split_review(scans_df(spark, scans))
    assert dicts(ingest.duplicate_scans(good)) == [{"image_id": 2, "image_path": "/in/x.png"}]
    assert waiting.first()["reason"] == "blurred"
    assert ingest.review_limit_reached(waiting, 1) and not ingest.review_limit_reached(waiting, 2)
    assert not ingest.review_limit_reached(waiting, 0)


def test_a_hot_path_keeps_its_first_arrival(spark):
    rows = [scan(i, "/in/hot.png") for i in range(2, 60)] + [scan(1, "/in/hot.png"), scan(99, "/in/cold.png")]
    frame = scans_df(spark, rows)
    assert sorted(r["image_id"] for r in ingest.dedupe_images(frame).collect()) == [1, 99]
    assert ingest.duplicate_scans(frame).count() == 58


def test_disputed_settings_follow_the_first_mark(spark):
    marks = [mark(2, 1, "A", max_votes=9), mark(1, 2, "A", max_votes=3, candidate_id=7), mark(1, 1, "A", max_votes=2, candidate_id=8),
             mark(1, 3, "B", max_votes=5, title=None), mark(3, 1, "C", max_votes=None, title=None, kind=None)]
    star = star_of(spark, [scan(i) for i in (1, 2, 3)], marks)
    contests = {(r["contest_title"], r["contest_type"]): r["max_votes"] for r in star.contest.collect()}
    assert contests == {("Mayor", "PLURALITY"): 2, ("(unknown)", "PLURALITY"): 5}
    ids = {r["candidate_name"]: r["ballot_candidate_id"] for r in star.candidate.collect()}
    assert ids["A"] == 8


def test_precinct_null_and_literal_stay_apart(spark):
    scans = [scan(1, barcode="(not decoded)"), scan(2, barcode="1|(unknown)|0|1|1|1")]
    star = star_of(spark, scans, [mark(1, 1, "A"), mark(2, 1, "A")])
    rows = reports.votes_by_contest_precinct(star).collect()
    assert [(r["precinct"], r["voted"]) for r in rows] == [("(unknown)", 1), ("(unknown)", 1)]


def test_same_title_of_two_types_merges_in_reports_only(spark):
    marks = [mark(1, 1, "A"), mark(2, 1, "A", kind="APPROVAL", max_votes=4)]
    star = star_of(spark, [scan(1), scan(2)], marks)
    assert star.contest.count() == 2
    assert [(r["contest"], r["voted"]) for r in reports.votes_by_contest(star).collect()] == [("Mayor", 2)]
    assert reports.contest_config(star).count() == 1


def test_barcode_fields(spark):
    raw = ["1|2||4|5|6", "1|2|", "", "(not decoded)", "1|2|3|4|5| 6", "1|2|3|4|5|x|7"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    rows = df.select("i", text.parse_barcode("raw").alias("p"), text.barcode_page("raw").alias("page")).orderBy("i").collect()
    assert [tuple(r["p"]) for r in rows][:4] == [
        ("1", "2", "", "4", "5", "6"), ("1", "2", "", None, None, None), ("",) + (None,) * 5, ("(not decoded)",) + (None,) * 5]
    assert [r["page"] for r in rows] == [6, 1, 1, 1, 1, 1]


def test_rounding_goes_up_at_halves(spark):
    df = spark.createDataFrame([(-2.5,), (-0.5,), (0.5,), (2.5,), (2.4,)], "v double")
    assert [r[0] for r in df.select(measure.round_half_up(F.col("v"))).collect()] == [-2, 0, 1, 3, 2]


def test_resolution_guess(spark):
    df = spark.createDataFrame([(2550, 0), (1470, 0), (5000, 0), (800, 240)], "width_px int, metadata_dpi int")
    got = [r["resolved_dpi"] for r in ingest.resolve_dpi(df, session_dpi=150.0).collect()]
    assert got == [150.0, 150.0, 150.0, 240.0]
    assert [r["resolved_dpi"] for r in ingest.resolve_dpi(df, session_dpi=0).collect()] == [300.0, 173.0, 600.0, 240.0]


def test_write_in_crops_are_numbered_only_when_needed(spark):
    marks = [mark(1, 1, "W1", write_in=True), mark(1, 2, "W2", marked=False, write_in=True, dark_pct=2.5),
             mark(1, 3, "W3", marked=False, write_in=True, dark_pct=2.0), mark(2, 1, "W1", write_in=True, contest_id=None)]
    frame = ingest.classify_marks(marks_df(spark, marks))
    names = summary.write_in_crops(frame, scans_df(spark, [scan(1, name="a.b.PNG"), scan(2, name="plain")])).collect()
    assert sorted(r["crop_name"] for r in names) == ["writein_a.b_1_1.png", "writein_a.b_1_2_unvoted.png", "writein_plain_-1.png"]


def test_image_lines(spark):
    marks = [mark(1, 1, "B"), mark(1, 2, "A", title="T", contest_id=2, max_votes=2), mark(1, 3, "C", title="T", contest_id=2, max_votes=2),
             mark(2, 1, "A"), mark(2, 2, "B"), mark(3, 1, "A", marked=False)]
    scans = scans_df(spark, [scan(1), scan(2, barcode="(not decoded)"), scan(3)])
    choices = summary.valid_choices(ingest.classify_marks(marks_df(spark, marks)), scans)
    assert sorted(r["line"] for r in summary.image_detail(choices).collect()) == [
        "b1_c1.png (party=2 region=10): A, C", "b1_c1.png (party=2 region=10): B", "b2_c1.png [OVERVOTE]"]


def test_ranked_overvote_shows_in_the_vote_record(spark):
    ranks = [mark(1, 1, "A (Rank 1)", kind="RANKED_CHOICE"), mark(1, 2, "B (Rank 1)", kind="RANKED_CHOICE"),
             mark(2, 2, "C (Rank 2)", kind="RANKED_CHOICE"), mark(2, 3, "A (Rank 1)", kind="RANKED_CHOICE"),
             mark(3, 1, "W", title="Town", contest_id=2, write_in=True)]
    star = star_of(spark, [scan(i) for i in (1, 2, 3)], ranks)
    cells = {(r["anchor_id"], r["contest_id"]): r["cell"] for r in audit.contest_cells(star).collect()}
    assert cells == {(1, 1): "OVERVOTE", (2, 1): "A (1)|C (2)", (3, 2): "WRITE-IN"}
    wide = {r["cvr_number"]: (r["Mayor"], r["Town"]) for r in audit.cvr_export(star).collect()}
    assert wide == {1: ("OVERVOTE", ""), 2: ("A (1)|C (2)", ""), 3: ("", "WRITE-IN")}


def test_pages_of_one_sheet_share_a_record(spark):
    scans = [scan(5, "/in/b9_c2.png", "1|10|2|1|1|2", page=2), scan(6, "/in/b9_c1.png", page=1), scan(7, "/in/other.png")]
    rows = dicts(audit.physical_ballots(star_of(spark, scans, [mark(6, 1, "A")])), "first_id")
    assert [(r["anchor_id"], r["first_id"], r["pages"]) for r in rows] == [(6, 5, 2), (7, 7, 1)]


def test_glob_finds_anywhere_and_words_are_refused(spark):
    star = star_of(spark, [scan(1, "/in/Alpha_c1.png"), scan(2, "/in/beta_c2.png")], [mark(1, 1, "A"), mark(2, 1, "A", marked=False)])
    assert [r["id"] for r in review.ballots_by_glob(star, "LPHA?c*.png").collect()] == [1]
    assert [r["id"] for r in review.ballots_where(star, "vo.vote_status = 'VOTED' OR b.id < 0").collect()] == [1]
    for clause in ("1=1; drop table x", "cdr.candidate_name = 'created'"):
        with pytest.raises(ValueError):
            review.ballots_where(star, clause)
    assert [r["id"] for r in review.ballots_by_ids(star, [2, 77, 1]).collect()] == [2, 1]


def test_regression_counts(spark, sf_dir):
    """Counts of the election view, known from an independent run."""
    known = {
        "sf0.001": ((1485, 5949), {"VOTED": 2598, "OVERVOTED": 585, "UNMARKED": 2766}, 252),
        "sf0.01": ((14851, 59412), {"VOTED": 25675, "OVERVOTED": 5914, "UNMARKED": 27823}, 2336),
    }
    key = sf_dir.rsplit("/", 1)[1]
    if key not in known:
        pytest.skip("no known counts for these tables")
    star = election.results(spark, sf_dir)
    sizes, by_status, leader = known[key]
    assert (star.ballot_image.count(), star.vote_opportunity.count()) == sizes
    assert {r["vote_status"]: r["count"] for r in star.vote_opportunity.groupBy("vote_status").count().collect()} == by_status
    mayor = reports.votes_by_contest(star).filter("contest = 'Mayor' AND candidate = 'Candidate 4'").first()
    assert mayor["voted"] == leader


def test_measurements_are_read_once_and_moved_once(spark, tmp_path):
    """Up to the settled marks there is one scan of the measurements and one exchange of their rows."""
    path = str(tmp_path / ("a-long-folder-name-" * 8) / "marks")
    marks_df(spark, [mark(1, 1, "A"), mark(1, 2, "B"), mark(2, 1, "A (Rank 1)", kind="RANKED_CHOICE")]).write.parquet(path)
    scans = scans_df(spark, [scan(1), scan(2)])
    images = ingest.build_image_table(scans, ingest.build_barcode_dim(scans))
    # Plans cut a folder's path off at the second length, however long the path is.
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.maxMetadataStringLength": "10000"}
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        settled = ingest.settled_marks(ingest.classify_marks(spark.read.parquet(path)), images)
        plan = settled._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert plan.count(f"[file:{path}]") == 1
    above = plan[: plan.index(f"[file:{path}]")]
    # The scan's branch is the last one opened; exchanges on the way to it are indented less.
    lines = above.splitlines()
    depth = len(lines[-1]) - len(lines[-1].lstrip(" :+-"))
    moved = 0
    for line in reversed(lines[:-1]):
        here = len(line) - len(line.lstrip(" :+-"))
        if here < depth:
            depth = here
            moved += "Exchange hashpartitioning" in line
    assert moved == 1
    assert settled.count() == 3
