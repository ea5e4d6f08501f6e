"""Plans and batches whose cost must not grow with what came before."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import cells, ingest, merge, reports, summary, winners
from tallyspark.operators.ingest import Star
from tallyspark.operators.merge import Stations
from tallyspark.plans import election, report_queries, stream_queries
from tallyspark.sources import results
from tallyspark.streaming import feed as feeds
from tallyspark.streaming import ingest as streams
from tallyspark.streaming import path_index
from tallyspark.streaming.store import read_table
from tests.builders import dicts, mark, marks_df, scan, scans_df, star_of


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def scans_in(frame) -> int:
    return len(re.findall(r"FileScan|LocalTableScan|Scan ExistingRDD", plan_of(frame)))


# --- ingest ------------------------------------------------------------------


def test_marks_are_sorted_once_to_settle_them(spark):
    """One order serves both windows and the join with the images."""
    marks = ingest.classify_marks(marks_df(spark, [mark(1, 1, "A (Rank 1)", kind="RANKED_CHOICE")]))
    images = spark.createDataFrame([(1, 7)], "id bigint, barcode_id bigint")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(ingest.settled_marks(marks, images))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("SortMergeJoin") == 1 and len(re.findall(r"\bSort \[", plan)) == 2


def test_marks_of_a_scan_that_is_there_twice_count_twice(spark):
    """A rank marked once on a scan row that occurs twice stands twice in the store, and is doubled."""
    marks = [mark(1, 1, "A (Rank 1)", kind="RANKED_CHOICE"), mark(1, 2, "B (Rank 2)", False, kind="RANKED_CHOICE"),
             mark(2, 1, "A (Rank 1)", kind="RANKED_CHOICE"), mark(3, 1, "A (Rank 1)\n", kind="RANKED_CHOICE"),
             mark(3, 2, "B (Rank 1)", kind="RANKED_CHOICE"), mark(4, 1, "A"), mark(5, 1, "A")]
    star = star_of(spark, [scan(1), scan(1), scan(2), scan(3), scan(4, error="torn")], marks)
    got = sorted((r["ballot_image_id"], r["seq"], r["vote_status"]) for r in star.vote_opportunity.collect())
    assert got == [(1, 1, "OVERVOTED")] * 2 + [(1, 2, "UNMARKED")] * 2 + [(2, 1, "VOTED"), (3, 1, "OVERVOTED"), (3, 2, "OVERVOTED")]


def test_truth_reads_the_marks_once(spark, sf_dir):
    assert len(re.findall(r"FileScan parquet \[l_", plan_of(election.ground_truth(spark, sf_dir)))) == 1


def test_facts_meet_their_images_once_for_all_stations(spark, sf_dir):
    (_, first), (_, second) = election.stations(spark, sf_dir)
    assert "Join" not in plan_of(first.vote_opportunity) + plan_of(second.vote_opportunity)
    # Two thirds of the ballots are at each, a third at both.
    at = [{r[0] for r in s.vote_opportunity.select("ballot_image_id").distinct().collect()} for s in (first, second)]
    both = {3 * (i - 1) + 5 for i in at[0]} & at[1]
    assert 2 * len(both) == pytest.approx(len(at[0]), rel=0.1)


def test_batches_of_a_pass_do_not_depend_on_its_files(spark, sf_dir, monkeypatch):
    batches, append, step = [], feeds.append_rows, streams.ingest_batch
    monkeypatch.setattr(feeds, "append_rows", lambda rows, path: append(rows.repartition(6), path))
    monkeypatch.setattr(streams, "ingest_batch", lambda b, n, *more: (batches.append(n), step(b, n, *more)))
    rows = stream_queries.ingested(spark, sf_dir)
    assert sorted(batches) == list(range(stream_queries.PASSES * stream_queries.BATCHES))
    assert rows.count() == election.results(spark, sf_dir).vote_opportunity.count()


# --- path index --------------------------------------------------------------


def test_files_read_per_batch_do_not_grow(spark, tmp_path, monkeypatch, request):
    """Fifty batches: the index stays right, and what a batch reads stays bounded."""
    root = str(tmp_path / "index")
    read, kept = [], []
    # Small folders are listed by the driver, without a job.
    monkeypatch.setattr(path_index, "BATCHES_APART", 4)
    settings = {"spark.sql.sources.parallelPartitionDiscovery.threshold": "1000", "spark.sql.shuffle.partitions": "1"}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    request.addfinalizer(lambda: [spark.conf.set(key, value) for key, value in before.items()])
    for batch in range(50):
        # Four new paths, one of the batch before, one of long ago.
        names = [f"/in/{batch}-{k}.png" for k in range(4)] + [f"/in/{batch - 1}-0.png", f"/in/{batch // 2}-3.png"]
        rows = spark.createDataFrame([(i, p) for i, p in enumerate(names)], "image_id int, image_path string").coalesce(1)
        if batch % 4 == 1:
            known = path_index.known_paths(rows, root, batch)
            touched = {r["prefix"] for r in path_index._hashed(rows).collect()}
            # The scan itself is pruned to these folders.
            assert "prefix" in plan_of(known).split("PartitionFilters: [")[1].split("]")[0]
            read.append(len([f for f in known.inputFiles() if int(re.search(r"prefix=(\d+)", f)[1]) in touched]))
        fresh = path_index.new_paths(rows, root, batch)
        kept.append(sorted(r["image_path"] for r in fresh.collect()))
        path_index.add_paths(fresh, root, batch)
    assert len(kept[0]) == 6 and all(paths == sorted(f"/in/{b}-{k}.png" for k in range(4)) for b, paths in enumerate(kept) if b > 0)
    most = 6 * (path_index.BATCHES_APART + 1)
    assert max(read) <= most and max(read[8:]) <= max(read[2:8]) + path_index.BATCHES_APART


def test_index_survives_replays_and_half_done_merging(spark, tmp_path):
    root = str(tmp_path / "index")

    def rows(*paths):
        return spark.createDataFrame([(p,) for p in paths], "image_path string")

    path_index.add_paths(rows("/a", "/b"), root, 0)
    for _ in range(2):
        assert [r[0] for r in path_index.new_paths(rows("/a", "/c"), root, 1).collect()] == ["/c"]
        path_index.add_paths(rows("/c"), root, 1)
    # A batch does not see its own paths, nor those after it.
    assert path_index.new_paths(rows("/c"), root, 1).count() == 1 and path_index.new_paths(rows("/c"), root, 2).count() == 0
    # As after a crash before the old files went: every row is there twice.
    path_index._append(path_index._read(spark, root), root)
    path_index.put_together(spark, root)
    path_index.put_together(spark, root)
    stored = path_index._read(spark, root)
    assert stored.count() == stored.select("image_path").distinct().count() == 3
    assert path_index.new_paths(rows("/a", "/b", "/c", "/d"), root, 9).count() == 1


# --- snapshots ---------------------------------------------------------------


def test_snapshots_add_up_batch_counts(spark, tmp_path):
    """A report reads counts of batches and names; facts and images are not among its files."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for first in (1, 4, 7):
        scans = [scan(i) for i in range(first, first + 3)] + [scan(90 + first, "/in/b1_c1.png")]
        marks = [mark(s["image_id"], k, name) for s in scans for k, name in ((1, "A"), (2, "B"))][:-1]
        feeds.append_rows(feeds.flatten(scans_df(spark, scans), marks_df(spark, marks)), source)
        streams.snapshot_every(feeds.read_feed(spark, source), out, f"{out}/_cp", every=4)
        assert dicts(streams.shares_report(spark, out)) == dicts(winners.results_report(streams.stored_star(spark, out)))
    read = " ".join(streams.shares_report(spark, out).inputFiles())
    assert "/share/" in read and "/contest/" in read
    assert "/vote_opportunity/" not in read and "/ballot_image/" not in read
    sizes = read_table(spark, out, "size", streams._SIZE)
    assert sum(r["images"] for r in sizes.collect()) == read_table(spark, out, "ballot_image", streams.S.BALLOT_IMAGE).count() == 9


# --- stray ink ---------------------------------------------------------------


def test_only_new_ink_is_dilated(spark, tmp_path):
    """A batch that prints what is known already adds no position, however much is remembered."""
    out = str(tmp_path / "ink")
    page = [(x, y) for x in range(30) for y in range(30) if (x * 7 + y) % 5 == 0]
    boxes = spark.createDataFrame([("p", False, 0, 0, 1, 1)], "barcode string, write_in boolean, left int, top int, width int, height int")

    def batch(number, *more):
        rows = [(number, "p", number, x, y, 0) for x, y in [*page, *more]]
        frame = spark.createDataFrame(rows, "image_id bigint, barcode string, seq bigint, x int, y int, lum int")
        streams.ink_batch(frame, number, out, boxes, 16, 0.0625, 0.0)
        added = [read_table(spark, out, t, s).count() for t, s in (("first_dark", streams._STORED_FIRST), ("near", streams._NEAR))]
        return added, sorted((r["image_id"], r["x"], r["y"]) for r in streams.stored_novel_ink(spark, out).collect())

    first, novel = batch(0)
    assert first[0] == len(page) and novel == []
    again, novel = batch(1)
    assert again == first and novel == []
    # One far spot adds itself and its neighbours, nothing else.
    third, novel = batch(2, (100, 100))
    assert third == [first[0] + 1, first[1] + 9] and novel == [(2, 100, 100)]
    fourth, novel = batch(3, (101, 101))
    assert fourth == [third[0] + 1, third[1] + 5] and novel == [(2, 100, 100)]


# --- stations ----------------------------------------------------------------


def many_stations(spark, root: str, count: int) -> Stations:
    """Copies of one station under paths of their own, written by station as partitions."""
    star = star_of(spark, [scan(1), scan(2)], [mark(1, 1, "A"), mark(2, 1, "B"), mark(2, 2, "C", marked=False)])
    numbers = spark.range(count).select(F.col("id").cast("int").alias("station_no"))
    for name, rows in star.tables().items():
        copies = rows.join(numbers)
        if name == "ballot_image":
            # The second image of every station is the same one everywhere.
            own = F.concat("image_path", F.lit("-"), F.col("station_no").cast("string"))
            copies = copies.withColumn("image_path", F.when(F.col("id") == 1, own).otherwise(F.col("image_path")))
        copies.coalesce(1).write.partitionBy("station_no").parquet(f"{root}/{name}")
    labels = numbers.select(F.concat(F.lit("s"), F.col("station_no").cast("string")).alias("label"), "station_no")
    labels.coalesce(1).write.partitionBy("station_no").parquet(f"{root}/station")
    return results.load_stations(spark, root)


def test_a_hundred_stations_have_the_plan_of_two(spark, tmp_path):
    shapes = []
    for count in (2, 100):
        stations = many_stations(spark, str(tmp_path / str(count)), count)
        assert stations.labels == tuple(f"s{i}" for i in range(count))
        merged = merge.merge_stations(stations)
        assert merged.star.ballot_image.count() == count + 1
        log = dicts(merge.merge_log(stations, merged), "station")
        assert len(log) == count - 1 and all(r["duplicate_images"] == 1 and r["unmapped_facts"] == 0 for r in log)
        totals = merge.station_totals(stations)
        assert totals.count() == 3 * count and {r["ballot_images"] for r in totals.collect()} == {2}
        shapes.append([scans_in(f) for f in (merged.star.vote_opportunity, merged.star.ballot_image, merged.star.candidate, totals)])
    assert shapes[0] == shapes[1]


def test_stations_one_by_one_and_as_a_set(spark, tmp_path):
    first = star_of(spark, [scan(1, "/in/a.png"), scan(2, "/in/b.png")], [mark(1, 1, "A"), mark(2, 1, "B")])
    second = star_of(spark, [scan(1, "/in/b.png"), scan(2, "/in/c.png")], [mark(1, 1, "B"), mark(2, 1, "C")])
    listed = [("one", first), ("two", second)]
    for number, (label, star) in enumerate(listed):
        results.save_station(star, str(tmp_path), number, label)
        results.save_station(star, str(tmp_path), number, label)
    stored = results.load_stations(spark, str(tmp_path))
    for report in (merge.station_totals, merge.compare_stations, merge.export_rows):
        assert sorted(map(tuple, report(listed).collect()), key=repr) == sorted(map(tuple, report(stored).collect()), key=repr)
    paths = [sorted(r["image_path"] for r in merge.merge_stations(s).star.ballot_image.collect()) for s in (listed, stored)]
    assert paths == [["/in/a.png", "/in/b.png", "/in/c.png"]] * 2


# --- summary -----------------------------------------------------------------


def test_summary_reads_each_input_once(spark, sf_dir):
    assert scans_in(report_queries.vote_summary(spark, sf_dir)) <= 3


def test_summary_sets_aside_by_title(spark):
    """A second contest of an overvoted title on the same sheet loses its marks to the same section."""
    scans = scans_df(spark, [scan(1, barcode="1|10|2|1|1|1"), scan(2, barcode="1|11|2|1|1|1"), scan(3, barcode=None), scan(4)])
    marks = ingest.classify_marks(marks_df(spark, [
        mark(1, 1, "A"), mark(1, 2, "B"), mark(1, 3, "Z", contest_id=2), mark(2, 1, "A"), mark(2, 2, None, marked=False),
        mark(3, 1, None), mark(3, 2, "C", title="Other", contest_id=None, kind="APPROVAL"), mark(4, 1, "A", marked=False), mark(77, 1, "lost")]))
    kept = marks.filter("image_id < 50")
    choices = summary.valid_choices(kept, scans)
    pieces = {
        "totalVotes": [(r["contest_title"], "", r["candidate"], r["votes"]) for r in summary.summary_totals(choices).collect()],
        "byParty": [(r["contest_title"], r["party_id"], r["candidate"], r["votes"]) for r in summary.summary_by_party(choices).collect()],
        "byRegion": [(r["contest_title"], r["region_id"], r["candidate"], r["votes"]) for r in summary.summary_by_region(choices).collect()],
        "overvotedChoices": [(r["contest_title"], "", r["candidate"], r["overvotes"]) for r in summary.overvoted_choices(kept).collect()],
        "overvotedBallots": [(r["contest_title"], "", "", r["overvoted_ballots"]) for r in summary.overvoted_ballot_counts(choices).collect()],
    }
    wanted = sorted(((s, *row) for s, rows in pieces.items() for row in rows), key=repr)
    columns = ("section", "contest_title", "section_key", "candidate", "votes")
    assert sorted((tuple(r[c] for c in columns) for r in summary.vote_summary(marks, scans).collect()), key=repr) == wanted
    assert ("overvotedChoices", "Mayor", "", "Z", 1) in wanted


# --- bitmaps -----------------------------------------------------------------


def test_bitmaps_count_distinct_images_and_add_up(spark):
    rows = [(i, c, s) for i in (0, 1, 32768, 32769, 98304, -5, 10 ** 12) for c in (1, 2) for s in ("VOTED", "OVERVOTED", "UNMARKED") if (i + c) % 3]
    facts = spark.createDataFrame(rows + rows[:7], "ballot_image_id bigint, contest_id bigint, vote_status string")
    star = star_of(spark, [scan(1)], [mark(1, 1, "A"), mark(1, 2, "B", title="Other", contest_id=2)])
    star = Star(star.barcode, star.ballot_image, star.contest, star.candidate, facts)
    wanted = {c: (len({i for i, k, _ in rows if k == c}), sum(k == c and s == "VOTED" for _, k, s in rows + rows[:7])) for c in (1, 2)}
    names = {r["contest_title"]: r["id"] for r in star.contest.collect()}
    parts = [reports.contest_parts(facts.filter(f"ballot_image_id % 2 = {k}")) for k in (0, 1, -1)]
    # A batch that is there twice adds its counts again, and no image.
    twice = reports.add_parts(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[1]))
    for report in (reports.contest_dashboard(star), reports.contest_dashboard(star, reports.contest_parts(facts))):
        assert {names[r["contest"]]: (r["ballots"], r["voted"]) for r in report.collect()} == wanted
    assert {names[r["contest"]]: r["ballots"] for r in reports.contest_dashboard(star, twice).collect()} == {c: n for c, (n, _) in wanted.items()}
    assert reports.headline_totals(star).first()["overvoted_images"] == len({i for i, _, s in rows if s == "OVERVOTED"})
    empty = Star(star.barcode, star.ballot_image, star.contest, star.candidate, facts.filter("false"))
    assert reports.headline_totals(empty).first().asDict() == {"votes_cast": 0, "ballot_images": 1, "overvoted_images": 0, "flagged_images": 0}
    assert reports.contest_dashboard(empty).count() == 0


# --- box samples -------------------------------------------------------------


def test_samples_of_images_are_those_of_their_pixels(spark):
    """Boxes of all styles, over the edge, without width, and pages of several sizes and channels."""
    rng = np.random.default_rng(8)
    images, pixels = [], []
    for number, (height, width, channels) in enumerate(((20, 30, 3), (16, 16, 1), (25, 12, 4)), start=1):
        data = rng.integers(0, 256, (height, width, channels), dtype=np.uint8)
        images.append((number, "p", ("", height, width, channels, 16, bytearray(data.tobytes()))))
        for y in range(height):
            for x in range(width):
                blue, green, red = (int(data[y, x, min(i, channels - 1)]) for i in range(3))
                pixels.append((number, "p", x, y, (299 * red + 587 * green + 114 * blue) // 1000))
    boxes = [("p", i, style, *box, i % 2 == 0) for i, (style, box) in enumerate([
        ("OVAL", (2, 3, 8, 6)), ("arrow", (5, 5, 17, 9)), ("CONNECT_DOTS", (3, 2, 25, 5)), ("OVAL", (-3, -2, 6, 5)), ("ARROW", (10, 12, 1, 1)),
        ("OVAL", (4, 4, 1, 7)), ("CONNECT_DOTS", (0, 0, 4, 40)), ("OVAL", (28, 18, 9, 9)), ("ARROW", (0, 0, 3, 3)), ("OVAL", (90, 90, 4, 4))])]
    image_frame = spark.createDataFrame(images, "image_id bigint, barcode string, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")
    pixel_frame = spark.createDataFrame(pixels, "image_id bigint, barcode string, x int, y int, lum int")
    box_frame = spark.createDataFrame(boxes, "barcode string, box_id bigint, style string, left int, top int, width int, height int, write_in boolean")
    by_image = cells.sample_images(image_frame, box_frame)
    by_pixel = cells.sample_regions(pixel_frame, image_frame.select("image_id", "barcode"), box_frame)
    assert by_image.columns == by_pixel.columns
    assert dicts(by_image, "image_id", "box_id") == dicts(by_pixel, "image_id", "box_id")
    assert by_image.count() == 30
    assert cells.sample_images(image_frame.filter("image_id > 5"), box_frame).count() == 0


def test_star_tables_keep_their_columns(spark):
    star = star_of(spark, [scan(1)], [mark(1, 1, "A")])
    merged = merge.merge_stations([("one", star)]).star
    assert isinstance(merged, Star)
    assert {n: t.columns for n, t in merged.tables().items()} == {n: t.columns for n, t in star.tables().items()}
