"""Files in and out."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import text
from tallyspark.operators import audit, design, ingest, merge, reports, verify
from tallyspark.operators.ingest import Star
from tallyspark.sources import audit_log, layouts, results, scans, truth
from tests.builders import dicts, mark, scan, star_of

YAML = """
combinationId: 1
unit: {unit}
sides:
- side_number: 2
  ballotContentArea: {{offsetFromLeft: '25.4', offsetFromTop: '50.8 mm', width: 254, height: 'wide'}}
  cornerMarks:
  - {{corner: BL, x: '25.4', y: '0'}}
  - {{corner: TL, x: '50.8', y: '101.6'}}
  barcodeCentre: {{x: '127.0', y: '254.0'}}
  contests:
  - id: 7
    title: Mayor
    boundingBox: {{offsetFromLeft: '25.4', offsetFromTop: '0', width: '25.4', height: '25.4'}}
    candidates:
    - id: 71
      name: Ann
      writeIn: true
      indicator: {{offsetFromLeft: '2.54', offsetFromTop: '5.08', width: '2.54', height: '2.54', indicatorStyle: ARROW}}
    - {{id: x, name: Bob}}
  - {{id: 8, title: Empty, contestType: APPROVAL, maxVotes: 3, percentToWin: 60.5}}
"""

XML = """<?xml version="1.0"?>
<ballotBoundingBoxReport combinationId="1" unit="inches">
  <side number="1">
    <ballotContentArea><offsetFromLeft>0.5</offsetFromLeft><offsetFromTop>0.25</offsetFromTop><width>7</width><height>9</height></ballotContentArea>
    <cornerMarks><mark corner="TL"><x>1.0</x><y>2.0</y></mark></cornerMarks>
    <contests><contest id="3" title="Board" contestType="APPROVAL" maxVotes="4"><boundingBox><offsetFromLeft>1</offsetFromLeft></boundingBox>
      <candidates><candidate id="31" name="Cat" writeIn="TRUE"><indicator><offsetFromLeft>1.5</offsetFromLeft><width>0.2</width></indicator></candidate></candidates>
    </contest></contests>
  </side>
</ballotBoundingBoxReport>
"""


def test_yaml_layouts(spark, tmp_path):
    (tmp_path / "ballot_1_2_3_4_5_2.YAML").write_text(YAML.format(unit="mm"))
    (tmp_path / "broken.yml").write_text("sides: [}")
    (tmp_path / "ignored.xml").write_text(XML)
    rows = dicts(layouts.read_layouts(spark, str(tmp_path)), "contest_pos", "candidate_pos")
    assert [(r["contest_title"], r["candidate_name"], r["candidate_id"]) for r in rows] == [
        ("Mayor", "Ann", 71), ("Mayor", "Bob", None), ("Empty", None, None)]
    ann, bob, empty = rows
    assert (ann["page_number"], ann["content_left"], ann["content_top"], ann["content_width"], ann["content_height"]) == (2, 1.0, 2.0, 10.0, 0.0)
    assert ann["corner_marks"] == [[2.0, 4.0], [0.0, 0.0], [0.0, 0.0], [1.0, 0.0]] and ann["page_marks"] is None
    assert (ann["barcode_x"], ann["barcode_y"]) == (5.0, 10.0)
    assert (ann["contest_type"], ann["max_votes"], ann["percent_to_win"]) == ("PLURALITY", 1, 50.0)
    assert (ann["write_in"], ann["indicator_style"], ann["indicator_left"]) == (True, "ARROW", pytest.approx(0.1))
    assert (bob["write_in"], bob["indicator_style"], bob["indicator_left"]) == (False, "OVAL", 0.0)
    assert (empty["contest_type"], empty["max_votes"], empty["percent_to_win"]) == ("APPROVAL", 3, 60.5)


def test_xml_layouts_and_fallback(spark, tmp_path):
    (tmp_path / "ballot_1_1_0_1_1_1.xml").write_text(XML)
    row = layouts.read_layouts(spark, str(tmp_path), fmt="yaml").first()
    assert (row["contest_id"], row["contest_type"], row["max_votes"], row["percent_to_win"]) == (3, "APPROVAL", 4, 50.0)
    assert (row["candidate_name"], row["write_in"], row["indicator_left"], row["indicator_top"]) == ("Cat", True, 1.5, 0.0)
    assert row["corner_marks"][0] == [1.0, 2.0] and row["content_top"] == 0.25
    boxes = ingest.indicator_boxes(layouts.read_layouts(spark, str(tmp_path), fmt="xml"), 200, 300).first()
    assert (boxes["abs_left"], boxes["abs_top"], boxes["width"], boxes["height"], boxes["image_x"]) == (200, -50, 40, 1, 450)
    assert (boxes["contest_image_left"], boxes["contest_image_right"]) == (-1, -1)


def test_layout_report_written_as_json_is_a_yaml_layout(spark, tmp_path):
    columns = ("combination_id bigint, page_number int, content_left double, content_top double, content_width double, content_height double, "
               "contest_pos int, contest_id bigint, contest_title string, contest_type string, max_votes int, percent_to_win double, "
               "contest_left double, contest_top double, contest_width double, contest_height double, candidate_pos int, candidate_id bigint, "
               "candidate_name string, write_in boolean, indicator_left double, indicator_top double, indicator_width double, "
               "indicator_height double, indicator_style string")
    row = (1, 1, .5, .5, 7., 9., 0, 3, "Board", "APPROVAL", 4, 50., 1., 1., 2., 2.)
    positions = spark.createDataFrame(
        [row + (1, 32, "Dan", True, 1.25, 2., .1, .1, "OVAL"), row + (0, 31, "Cat", False, 1.2, 2., .1, .1, "OVAL")], columns)
    page = design.layout_report(positions, "mm").first()
    assert [c["name"] for c in page["contests"][0]["candidates"]] == ["Cat", "Dan"]
    assert page["contests"][0]["candidates"][1]["indicator"]["offsetFromLeft"] == "31.7500"
    assert design.layout_report(positions, page=2).count() == 0
    document = {"unit": "mm", "sides": [json.loads(design.layout_report(positions, "mm").toJSON().first())]}
    (tmp_path / "ballot_1_1_1_1_1_1.yaml").write_text(json.dumps(document))
    back = dicts(layouts.read_layouts(spark, str(tmp_path)), "candidate_pos")
    assert [(r["candidate_name"], round(r["indicator_left"], 4)) for r in back] == [("Cat", 1.2), ("Dan", 1.25)]


def test_a_json_document_is_read_once(spark, tmp_path):
    """Bare numbers that are wanted as text come from the bytes in hand, as they are written."""
    candidates = [{"id": k, "name": 5, "indicator": {"width": 0.25, "height": 1}} for k in range(500)]
    sides = [{"side_number": n, "contests": [{"id": n, "title": 12, "candidates": candidates}]} for n in range(1, 5)]
    text = json.dumps({"unit": "inches", "sides": sides}, indent=1)
    (tmp_path / "one.json").write_text(text.replace('"title": 12', '"title": 1.50e1'))

    def read() -> int:
        return sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())

    before = read()
    rows = layouts.read_layouts(spark, str(tmp_path), "json").select("page_number", "contest_title", "candidate_id", "indicator_width").collect()
    assert read() - before < 3 * len(text)
    assert len(rows) == 2000 and {(r["contest_title"], r["indicator_width"]) for r in rows} == {("1.50e1", 0.25)}


def test_pages_are_found_once_for_all_preferences(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(name):
        seen.add(1)
        return name

    names = spark.createDataFrame([("ballot_1_2_3_4_5_1.yaml", 0, 1), ("other.yaml", 0, 2)], "file_name string, side_pos int, page_number int")
    pages = names.withColumn("layout_key", F.nullif(F.regexp_extract("file_name", "^ballot_(.*)_1", 1), F.lit("")))
    images = spark.createDataFrame([(1, "1|2|3|4|5|1", 1), (2, "x", 2)], "image_id bigint, barcode_data string, page_number int")
    got = layouts.resolve_layout(images, pages.withColumn("file_name", told("file_name"))).collect()
    assert sorted(map(tuple, got)) == [(1, "ballot_1_2_3_4_5_1.yaml", 1), (2, "other.yaml", 2)]
    assert seen.value == 2


def test_layout_choice(spark):
    pages = layouts.layout_pages(spark.createDataFrame(
        [("ballot_1_2_0_1_1_1.yaml", 0, 1), ("ballot_1_2_0_1_1_2.yaml", 0, 2), ("a_general.yaml", 0, 2)],
        "file_name string, side_pos int, page_number int"))
    images = spark.createDataFrame(
        [(1, "1|2|0|1|1|2", 2), (2, "1|2|0|1|1|3", 3), (3, "9|9|0|1|1|2", 2), (4, "(not decoded)", 5), (5, None, 1)],
        "image_id bigint, barcode_data string, page_number int")
    got = {r["image_id"]: r["layout_file"] for r in layouts.resolve_layout(images, pages).collect()}
    assert got == {1: "ballot_1_2_0_1_1_2.yaml", 2: "ballot_1_2_0_1_1_1.yaml", 3: "a_general.yaml", 4: "a_general.yaml",
                   5: "ballot_1_2_0_1_1_1.yaml"}


def test_scan_listing(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("b.PNG", "sub/a.jpeg", "c.png.counted", "writein_x.png", "d.txt", "e.bmp", "noext"):
        (tmp_path / name).write_bytes(b"x")
    assert [r["path"].rsplit("/", 1)[1] for r in scans.list_scans(spark, str(tmp_path)).collect()] == ["b.PNG", "e.bmp", "a.jpeg"]
    assert scans.any_already_counted(spark, str(tmp_path))
    assert not scans.any_already_counted(spark, str(tmp_path / "sub"))


def test_ground_truth_wrapped_and_bare(spark, tmp_path):
    image = {"combo_id": "4", "precinct": "P", "party": None, "indicators": [
        {"contest": "Mayor", "candidate": "A", "counted_as": "VOTED"}, {"contest": "Mayor", "candidate": "B"},
        {"contest": "Mayor", "candidate": "A", "counted_as": "OVERVOTED"}]}
    (tmp_path / "wrapped.json").write_text(json.dumps({"per_image": {"/x": image}, "total_images": 1}, indent=1))
    (tmp_path / "bare.json").write_text(json.dumps({"/y": image}))
    for name in ("wrapped.json", "bare.json"):
        rows = truth.read_ground_truth(spark, str(tmp_path / name))
        assert sorted(r["counted_as"] for r in rows.collect()) == ["OVERVOTED", "UNMARKED", "VOTED"]
        totals = {r["candidate"]: (r["voted"], r["overvoted"], r["unmarked"]) for r in verify.expected_totals(rows).collect()}
        assert totals == {"A": (1, 1, 0), "B": (0, 0, 1)}
        assert verify.expected_by_combination(rows).first()["votes"] == 1


def test_verify_compares_marks(spark):
    schema = "contest string, candidate string, voted bigint, overvoted bigint, unmarked bigint"
    actual = spark.createDataFrame([("M", "A", 3, 1, 0), ("M", "B", 5, 0, 0), ("M", "C", 1, 0, 0)], schema)
    expected = spark.createDataFrame([("M", "A", 4, 0, 0), ("M", "B", 2, 0, 0), ("M", "D", 1, 0, 0)], schema)
    checked = verify.verify_counts(actual, expected)
    assert {r["candidate"]: (r["class"], r["delta_voted"]) for r in checked.collect()} == {
        "A": ("match", None), "B": ("mismatch", 3), "C": ("missing_in_gt", None), "D": ("missing_in_db", None)}
    assert verify.accuracy(checked).first()["accuracy_pct"] == 50.0


def test_audit_log_round_trip(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [("2026-01-01 00:00:00", "LOGIN", "o,brien", ""), ("2026-01-01 00:00:01", "SCAN", 'a "b"', "x\ny")]
    for row in rows:
        audit_log.append_events(spark.createDataFrame([row], "event_time string, event string, username string, detail string"), path)
    assert sorted(tuple(r) for r in audit_log.read_events(spark, path).collect()) == sorted(rows)


def test_results_round_trip_and_old_contests(spark, tmp_path):
    star = star_of(spark, [scan(1), scan(2)], [mark(1, 1, "A"), mark(2, 1, "B")])
    results.save_results(star, str(tmp_path / "r"))
    back = results.load_results(spark, str(tmp_path / "r"))
    for name, table in star.tables().items():
        assert dicts(table, *table.columns) == dicts(back.tables()[name], *table.columns)
    old = Star(star.barcode, star.ballot_image, star.contest.drop("percent_to_win"), star.candidate, star.vote_opportunity)
    results.save_results(old, str(tmp_path / "old"))
    assert results.load_results(spark, str(tmp_path / "old")).contest.first()["percent_to_win"] == 50.0


def test_bucketed_results_join_without_a_shuffle(spark):
    star = star_of(spark, [scan(1), scan(2)], [mark(1, 1, "A"), mark(1, 2, "B"), mark(2, 1, "B")])
    results.save_bucketed(star, "bucketed_", 4, mode="overwrite")
    stored = results.load_bucketed(spark, "bucketed_")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = stored.vote_opportunity.join(reports.image_names(stored, "image_path"), "ballot_image_id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert dicts(reports.overvoted_ballots(stored))[0]["overvoted_indicators"] == 2


def test_csv_exports(spark, tmp_path):
    star = star_of(spark, [scan(1, barcode='1|P "x", y|0|1|1|1'), scan(2)], [mark(1, 1, "A, Jr"), mark(2, 1, "B", marked=False)])
    audit.write_manifest(audit.ballot_manifest(star), str(tmp_path / "manifest"))
    lines = sorted(l for f in (tmp_path / "manifest").glob("*.csv") for l in f.read_text().splitlines())
    assert lines[0] == '1,"P ""x"", y-1",1' and "Container,Batch Name,Number of Ballots" in lines
    audit.write_cvr(audit.cvr_export(star), str(tmp_path / "cvr"))
    text_lines = [l for f in sorted((tmp_path / "cvr").glob("*.csv")) for l in f.read_text().splitlines()]
    assert text_lines[0] == "CvrNumber,TabulatorNum,BatchId,RecordId,BallotType,PrecinctPortion,Mayor"
    assert text_lines[-1] == "2,1,10-1,2,J1-P2-T1,Region-10,"


def test_merge_modes_and_null_barcodes(spark):
    first = star_of(spark, [scan(1, "/in/a.png"), scan(2, "/in/b.png")], [mark(1, 1, "A"), mark(2, 1, "B")])
    second = star_of(spark, [scan(1, "/in/b.png"), scan(2, "/in/c.png", barcode="7|7|7|7|7|1")],
                     [mark(1, 1, "B"), mark(2, 1, "C", percent=60.0), mark(2, 2, "X", title="New", percent=70.0, contest_id=9)])
    bare = Star(second.barcode, second.ballot_image.withColumn("barcode_id", second.ballot_image.barcode_id * None), second.contest,
                second.candidate, second.vote_opportunity)
    for other, mode, votes in ((second, "skip", {"A": 1, "B": 1, "C": 1, "X": 1}), (second, "append", {"A": 1, "B": 2, "C": 1, "X": 1}),
                               (bare, "skip", {"A": 1, "B": 1, "C": 1, "X": 1})):
        merged = merge.merge_stations([("one", first), ("two", other)], mode)
        assert {r["candidate"]: r["voted"] for r in reports.votes_by_contest(merged.star).collect()} == votes
        assert merged.star.ballot_image.count() == 3
        assert {r["contest_title"]: r["percent_to_win"] for r in merged.star.contest.collect()} == {"Mayor": 50.0, "New": 70.0}
        assert dicts(merge.merge_log([("one", first), ("two", other)], merged)) == [
            {"station": "two", "duplicate_images": 1, "unmapped_facts": 0}]
    ids = [r["id"] for r in merge.merge_stations([("one", first), ("two", second)]).star.ballot_image.collect()]
    assert len(set(ids)) == 3
    with pytest.raises(ValueError):
        merge.merge_stations([("one", first)], "both")


def test_contests_of_a_precinct(spark):
    regions = spark.createDataFrame([(1, "P1", "SINGLE_PRECINCT"), (2, "P2", "SINGLE_PRECINCT"), (8, "G", "PRECINCT_GROUP"), (9, "H", "PRECINCT_GROUP")],
                                    "region_id bigint, name string, region_type string")
    members = spark.createDataFrame([(8, 1), (9, 1), (9, 2)], "group_id bigint, member_id bigint")
    contests = spark.createDataFrame([(1, 1, "c30", 30), (2, 1, "c10", 10), (3, 1, "c20", 20), (4, 2, "other", 1)],
                                     "contest_id bigint, election_id bigint, title string, display_order int")
    assigned = spark.createDataFrame([(1, 1), (2, 8), (3, 9), (3, 1), (4, 1)], "contest_id bigint, region_id bigint")
    args = (regions, members, contests, assigned)
    assert [r["title"] for r in design.contests_of_precinct(*args, 1, 1).collect()] == ["c10", "c20", "c30"]
    assert [r["title"] for r in design.contests_of_precinct(*args, 2, 1).collect()] == ["c20"]
    assert sorted((r["source_name"], r["contest_id"]) for r in design.explain_contests(*args).filter("precinct_id = 1 AND election_id = 1").collect()) == [
        ("G", 2), ("H", 3), ("P1", 1), ("P1", 3)]
    for wrong in (8, 77):
        with pytest.raises(ValueError):
            design.contests_of_precinct(*args, wrong, 1)


def test_glob_text():
    assert text.glob_to_regex("A*b?.PNG") == "a.*b.[.]png"


def test_lookups_and_party_collapse(spark):
    elections = spark.createDataFrame([(1, "2024-11-05"), (2, "2026-11-03"), (3, "2025-05-01")], "election_id bigint, held string")
    assert [r["election_id"] for r in design.lookup(elections, [F.desc("held")]).collect()] == [2, 3, 1]
    combos = spark.createDataFrame([(1, 5, 1, 1, 1), (2, 5, 2, 1, 1), (3, 5, None, 1, 1), (4, 5, None, 1, 1)],
                                   "combination_id bigint, region_id bigint, party_id bigint, ballot_type_id bigint, election_id bigint")
    old = spark.createDataFrame([(1,), (2,)], "party_id bigint")
    moved, collisions = design.collapse_parties(old, 9, combos)
    assert sorted((r["combination_id"], r["party_id"]) for r in moved.collect()) == [(1, 9), (2, 9), (3, None), (4, None)]
    assert sorted((r["party_id"] or 0, r["copies"]) for r in collisions.collect()) == [(0, 2), (9, 2)]
