"""Streams: counted once across restarts, stopped by review, snapshots on the way."""

from __future__ import annotations

import glob

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark import session
from tallyspark.operators import cells, ingest, ranked, reports, summary, winners
from tallyspark.plans import election, stream_queries
from tallyspark.sources import audit_log
from tallyspark.streaming import feed as feeds
from tallyspark.streaming import ingest as streams
from tallyspark.streaming.store import read_table
from tests.builders import dicts, mark, marks_df, scan, scans_df, star_of


def arrive(spark, path, scans, marks):
    feeds.append_rows(feeds.flatten(scans_df(spark, scans), marks_df(spark, marks)).coalesce(1), path)


def test_restarts_count_once_and_equal_batch(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    passes = [
        ([scan(1), scan(2, error="torn")], [mark(1, 1, "A"), mark(1, 2, "B")]),
        ([scan(3, "/in/b1_c1.png"), scan(4), scan(5)], [mark(3, 1, "Z"), mark(4, 1, "B"), mark(4, 2, "C", marked=False)]),
        ([scan(6, barcode="(not decoded)")], [mark(6, 1, "D", title="Other", contest_id=2)]),
    ]
    for scans, marks in passes:
        arrive(spark, source, scans, marks)
        for _ in range(2):
            streams.ingest_stream(feeds.read_feed(spark, source), out, f"{out}/_cp").awaitTermination()
    star = streams.stored_star(spark, out)
    batch = star_of(spark, [s for p in passes for s in p[0]], [m for p in passes for m in p[1]])
    assert sorted(r["id"] for r in star.ballot_image.collect()) == [1, 4, 5, 6]
    columns = ("contest", "candidate", "voted", "overvoted", "unmarked")
    assert dicts(reports.votes_by_contest(star).select(*columns), *columns) == dicts(reports.votes_by_contest(batch).select(*columns), *columns)
    for table in ("barcode", "contest", "candidate"):
        ids = [r["id"] for r in getattr(star, table).collect()]
        assert sorted(ids) == list(range(1, len(ids) + 1))
    assert [r["reason"] for r in read_table(spark, out, "review", streams.REVIEW).collect()] == ["torn"]


def test_one_file_per_batch_equals_batch(spark, tmp_path):
    """Scans with many marks, overvotes and repeated paths, each scan in a file and a batch of its own."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    scans = [scan(1), scan(2), scan(3, "/in/b1_c1.png"), scan(4, error="torn")]
    marks = [mark(1, 1, "A"), mark(1, 2, "B"), mark(2, 1, "A"), mark(2, 2, "B", marked=False), mark(3, 1, "B"), mark(4, 1, "A"),
             *[mark(2, k, f"X (Rank {k % 3})", kind="RANKED_CHOICE", title="R", contest_id=2) for k in range(3, 9)]]
    for one in scans:
        arrive(spark, source, [one], [m for m in marks if m["image_id"] == one["image_id"]])
    streams.ingest_stream(feeds.read_feed(spark, source, files_per_trigger=1), out, f"{out}/_cp").awaitTermination()
    streams.run(feeds.read_feed(spark, source, files_per_trigger=1), lambda b, i: streams.tally_batch(b, i, out), f"{out}/_cp2").awaitTermination()
    star, batch = streams.stored_star(spark, out), star_of(spark, scans, marks)
    columns = ("contest", "candidate", "voted", "overvoted", "unmarked")
    assert dicts(reports.votes_by_contest(star).select(*columns), *columns) == dicts(reports.votes_by_contest(batch).select(*columns), *columns)
    counted = ingest.counted_marks(ingest.classify_marks(marks_df(spark, marks)), scans_df(spark, scans))
    tally = ("contest_title", "candidate", "votes", "ballots_checked", "overvotes")
    assert dicts(streams.running_tallies(spark, out).select(*tally), *tally) == dicts(summary.session_tallies(counted).select(*tally), *tally)


def test_batches_and_rounds_leave_nothing_staged(spark, tmp_path):
    root = session.shared_root(spark).removeprefix("file:")
    def staged():
        return set(glob.glob(f"{root}/tallyspark/{spark.sparkContext.applicationId}/*"))

    before = staged()
    streams.ingest_batch(feeds.flatten(scans_df(spark, [scan(1)]), marks_df(spark, [mark(1, 1, "A"), mark(1, 2, "B")])), 0, str(tmp_path / "out"))
    assert staged() == before
    ballots = spark.createDataFrame([(1, ["A", "B"]), (1, ["B"]), (1, ["C", "A"]), (1, ["A"])], "contest_id bigint, prefs array<string>")
    rounds = ranked.irv_rounds(ballots)
    (left,) = staged() - before
    assert "history" in left and rounds.count() > 0


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    first = feeds.flatten(scans_df(spark, [scan(1)]), marks_df(spark, [mark(1, 1, "A")]))
    second = feeds.flatten(scans_df(spark, [scan(2)]), marks_df(spark, [mark(2, 1, "B")]))
    for batch, number in ((first, 0), (second, 1), (second, 1)):
        streams.ingest_batch(batch, number, out)
    star = streams.stored_star(spark, out)
    assert star.ballot_image.count() == 2 and star.vote_opportunity.count() == 2 and star.candidate.count() == 2


def test_review_limit_stops_the_query(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    arrive(spark, source, [scan(1, error="x"), scan(2)], [mark(2, 1, "A")])
    streams.review_stream(feeds.read_feed(spark, source), out, f"{out}/_cp", limit=2).awaitTermination()
    arrive(spark, source, [scan(3, error="y")], [])
    with pytest.raises(StreamingQueryException, match="manual review"):
        streams.review_stream(feeds.read_feed(spark, source), out, f"{out}/_cp", limit=2).awaitTermination()
    assert sorted(r["image_id"] for r in read_table(spark, out, "review", streams.REVIEW).collect()) == [1, 3]
    streams.review_stream(feeds.read_feed(spark, source), out, f"{out}/_cp", limit=2, first_batch=1).awaitTermination()


def test_snapshots_at_multiples_per_pass_and_at_the_end(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for number, ids in enumerate(((1, 2), (3,), (4, 5, 6, 7)), start=1):
        arrive(spark, source, [scan(i) for i in ids], [mark(i, 1, "A") for i in ids])
        streams.snapshot_every(feeds.read_feed(spark, source), out, f"{out}/_cp", every=3, pass_number=number)
    counted = {r["snapshot"]: r["counted"] for r in streams.read_snapshots(spark, out).collect()}
    assert counted == {"n3": 3, "n6": 7, "pass1": 2, "pass2": 3, "pass3": 7, "final": 7}
    final = streams.read_snapshots(spark, out).filter("snapshot = 'final'").drop("snapshot")
    assert dicts(final) == dicts(winners.results_report(streams.stored_star(spark, out)))


def test_tally_moves_overvotes(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    arrive(spark, source, [scan(1), scan(2)], [mark(1, 1, "A"), mark(1, 2, "B"), mark(2, 1, "A")])
    streams.run(feeds.read_feed(spark, source), lambda b, i: streams.tally_batch(b, i, out), f"{out}/_cp").awaitTermination()
    arrive(spark, source, [scan(3)], [mark(3, 1, "A", marked=False)])
    streams.run(feeds.read_feed(spark, source), lambda b, i: streams.tally_batch(b, i, out), f"{out}/_cp").awaitTermination()
    rows = {r["candidate"]: (r["votes"], r["ballots_checked"], r["overvotes"]) for r in streams.running_tallies(spark, out).collect()}
    assert rows == {"A": (1, 3, 1), "B": (0, 1, 1)}


def test_audit_stream_appends_once(spark, tmp_path):
    source = str(tmp_path / "in")
    for i in (1, 2):
        arrive(spark, source, [scan(i)], [])
        streams.scan_audit_stream(feeds.read_feed(spark, source), "o,b", str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    assert [(r["username"], r["detail"]) for r in audit_log.read_events(spark, str(tmp_path / "log")).orderBy("detail").collect()] == [
        ("o,b", "b1_c1.png"), ("o,b", "b2_c1.png")]


def ink_by_hand(pixels, boxes, radius, pad):
    """Arrival by arrival, with a set of positions seen dark per barcode."""
    seen, out = {}, []
    pages = sorted({(s, i, b) for i, b, s, *_ in pixels})
    for seq, image, code in pages:
        dark = {(x, y) for i, _, _, x, y, lum in pixels if i == image and lum < 128}
        if code in seen:
            for x, y in dark:
                near = any((x + dx, y + dy) in seen[code] for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1))
                boxed = any(c == code and l - pad <= x < l + w + pad and t - pad <= y < t + h + (0 if wi else pad)
                            for c, wi, l, t, w, h in boxes)
                if not near and not boxed:
                    out.append((image, x, y))
        seen.setdefault(code, set()).update(dark)
    return sorted(out)


def clusters_by_hand(points, least):
    left, found = set(points), []
    while left:
        todo, members = [left.pop()], []
        while todo:
            i, x, y = todo.pop()
            members.append((i, x, y))
            for n in ((i, x + 1, y), (i, x - 1, y), (i, x, y + 1), (i, x, y - 1)):
                if n in left:
                    left.remove(n)
                    todo.append(n)
        xs, ys = [m[1] for m in members], [m[2] for m in members]
        if len(members) >= least:
            found.append((members[0][0], min(xs), min(ys), max(xs) + 1, max(ys) + 1, len(members)))
    return sorted(found)


def test_stray_ink_by_batch_by_stream_and_by_hand(spark, tmp_path):
    import random

    rng = random.Random(11)
    pixels = [(i, str(i % 2), i, x, y, 0 if rng.random() < 0.12 else 200) for i in range(1, 13) for x in range(14) for y in range(14)]
    boxes = [("0", True, 3, 3, 4, 3), ("1", False, 8, 2, 3, 3)]
    frame = spark.createDataFrame(pixels, "image_id bigint, barcode string, seq bigint, x int, y int, lum int")
    box_frame = spark.createDataFrame(boxes, "barcode string, write_in boolean, left int, top int, width int, height int")
    pages = frame.select("image_id", "barcode", "seq").distinct()
    for radius_in, radius in ((0.0, 0), (0.0625, 1), (0.125, 2)):
        novel = cells.novel_ink(cells.dark_mask(frame), pages, box_frame, 16, radius_in, 0.0625)
        wanted = ink_by_hand(pixels, boxes, radius, 1)
        assert sorted((r["image_id"], r["x"], r["y"]) for r in novel.collect()) == wanted
        out = str(tmp_path / f"ink{radius}")
        for low, high in ((0, 4), (4, 5), (5, 12)):
            frame.filter(f"seq > {low} AND seq <= {high}").coalesce(1).write.mode("append").parquet(f"{out}/in")
            stream = spark.readStream.schema(frame.schema).parquet(f"{out}/in")
            streams.novel_ink_stream(stream, out, f"{out}/cp", box_frame, 16, radius_in, 0.0625).awaitTermination()
        assert sorted((r["image_id"], r["x"], r["y"]) for r in streams.stored_novel_ink(spark, out).collect()) == wanted
    report = {r["image_id"]: r["scribble_flagged"] for r in cells.ink_report(novel, pages, flag_pixels=1).collect()}
    assert len(report) == 12 and not report[1] and not report[2]


def test_clusters_by_hand(spark):
    import random

    rng = random.Random(2)
    points = [(i, x, y) for i in (1, 2) for x in range(40) for y in range(40) if rng.random() < 0.55]
    points += [(3, x, 0) for x in range(200)] + [(3, x, 4) for x in range(200)] + [(3, 199, y) for y in (1, 2, 3)]
    frame = spark.createDataFrame(points, "image_id bigint, x int, y int")
    got = sorted(tuple(r) for r in cells.ink_clusters(frame).select("image_id", "x0", "y0", "x1", "y1", "pixels").collect())
    assert got == clusters_by_hand(points, 8)


def test_pixels_of_an_image_file(spark, tmp_path):
    import struct
    import zlib

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = [[(255, 0, 0), (0, 255, 0)], [(0, 0, 255), (10, 20, 30)]]
    raw = b"".join(b"\0" + bytes(v for p in row for v in p) for row in rows)
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    (tmp_path / "p.png").write_bytes(png)
    images = spark.read.format("image").load(str(tmp_path)).selectExpr("1L AS image_id", "'0' AS barcode", "1L AS seq", "image")
    got = {(r["x"], r["y"]): r["lum"] for r in cells.pixels_of_images(images).collect()}
    assert got == {(x, y): (299 * r + 587 * g + 114 * b) // 1000 for y, row in enumerate(rows) for x, (r, g, b) in enumerate(row)}


def test_duplicates_within_a_watermark(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for number in (1, 2):
        spark.sql(f"SELECT timestamp'2026-01-01 10:0{number}:00' AS at, '/a.png' AS image_path UNION ALL "
                  f"SELECT timestamp'2026-01-01 10:0{number}:00', '/b{number}.png'").write.mode("append").parquet(source)
        stream = spark.readStream.schema("at timestamp, image_path string").parquet(source)
        query = streams.dedupe_stream(stream, ("at", "1 hour")).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", f"{out}_cp").trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted(r["image_path"] for r in spark.read.parquet(out).collect()) == ["/a.png", "/b1.png", "/b2.png"]


def test_gathered_boxes_make_the_same_feed_as_whole_marks(spark, sf_dir):
    scans = election.scans(spark, sf_dir)
    whole = feeds.flatten(scans, election.measurements(spark, sf_dir))
    narrow = feeds.flatten(scans, election.boxes(spark, sf_dir), election.measured)
    assert narrow.schema.simpleString() == whole.schema.simpleString()
    assert narrow.exceptAll(whole).isEmpty() and whole.exceptAll(narrow).isEmpty()


def test_a_pass_of_the_feed_writes_its_rows_once(spark, sf_dir, monkeypatch):
    """Nothing but the feed itself holds the rows that arrive, and each arrives once."""
    labels, stage, seen = [], stream_queries.stage, {}
    monkeypatch.setattr(stream_queries, "stage", lambda rows, label: (labels.append(label), stage(rows, label))[1])
    for way in (stream_queries._feed_in_passes,
                lambda s, d, path, run: stream_queries._in_shares(stream_queries._feed_rows(s, d), path, lambda n: run(None, n) is None)):
        folder = session.new_folder(spark, "feed")
        way(spark, sf_dir, folder, lambda _, number: seen.setdefault(folder, []).append(spark.read.parquet(folder).count()))
        ids = [r[0] for r in spark.read.parquet(folder).select("image_id").collect()]
        assert sorted(ids) == sorted(r[0] for r in election.scans(spark, sf_dir).select("image_id").collect())
        assert 0 < seen[folder][0] < seen[folder][1] < seen[folder][2] == len(ids)
    assert labels == []


def test_batches_are_not_held_in_memory(spark, tmp_path, monkeypatch):
    def held(*_):
        raise AssertionError("a batch is persisted")

    monkeypatch.setattr(DataFrame, "persist", held)
    batch = feeds.flatten(scans_df(spark, [scan(1), scan(2, "/in/b1_c1.png")]), marks_df(spark, [mark(1, 1, "A"), mark(2, 1, "B")]))
    streams.ingest_batch(batch, 0, str(tmp_path / "out"))
    streams.tally_batch(batch, 0, str(tmp_path / "out"))
    assert [r["ballot_image_id"] for r in streams.stored_star(spark, str(tmp_path / "out")).vote_opportunity.collect()] == [1]
    assert [r["candidate"] for r in streams.running_tallies(spark, str(tmp_path / "out")).collect()] == ["A"]


def test_marks_of_a_feed_are_inlined(spark):
    marks = feeds.marks_of(feeds.flatten(scans_df(spark, [scan(1)]), marks_df(spark, [mark(1, 1, "A")])))
    assert "inline(" in marks._jdf.queryExecution().optimizedPlan().toString()
    assert dicts(marks) == dicts(marks_df(spark, [mark(1, 1, "A")]))


def test_tallies_and_live_counts_read_a_narrow_feed(spark, tmp_path):
    """Columns that neither counts are not read; what both say stays the same."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    scans = [scan(1), scan(2, error="torn"), scan(3), scan(3), scan(4)]
    marks = [mark(1, 1, "A"), mark(1, 2, "B"), mark(2, 1, "A"), mark(3, 1, "A", indicator_style="ARROW", zone_dark=1),
             mark(3, 2, None, dark_pct=7.0, trimmed_pct=20.0), mark(4, 1, "B", dark_pct=None, total_pixels=None)]
    arrive(spark, source, scans, marks)
    assert "abs_left" not in streams.TALLY_FEED.simpleString() and "image_name" not in streams.TALLY_FEED.fieldNames()
    tally = ("contest_title", "candidate", "votes", "ballots_checked", "overvotes")
    found = []
    for number, schema in enumerate((feeds.FEED, streams.TALLY_FEED)):
        streams.tally_stream(feeds.read_feed(spark, source, schema=schema), f"{out}{number}", f"{out}{number}/_cp").awaitTermination()
        found.append(dicts(streams.running_tallies(spark, f"{out}{number}").select(*tally), *tally))
    # Scan 3 is there twice under one id and path, and so are its marks.
    assert found[0] == found[1] and [r["overvotes"] for r in found[0] if r["candidate"] == "A"] == [3]
    wide, narrow = (streams.live_counts(spark.read.schema(schema).parquet(source)) for schema in (feeds.FEED, streams.LIVE_FEED))
    assert dicts(wide, "contest_title", "candidate") == dicts(narrow, "contest_title", "candidate")
    classified = {(r["candidate_name"], r["image_id"]): r["marked"] for r in ingest.classify_marks(marks_df(spark, marks)).collect()}
    assert [(r["candidate"], r["marked"]) for r in dicts(narrow, "candidate")] == [
        (name, sum(classified[name, i] for i in images)) for name, images in (("A", (1, 3)), ("B", (1, 4)), (None, (3,)))]


def test_only_images_that_may_be_overvoted_are_looked_at(spark):
    marks = [mark(1, 1, "A"), mark(1, 2, "B"), mark(1, 3, "C", False), mark(2, 1, "A"), mark(2, 2, "B", False), mark(3, 1, "A", candidate_id=7),
             mark(3, 2, "A2", candidate_id=7), mark(4, 1, "A", kind="APPROVAL"), mark(4, 2, "B", kind="APPROVAL"), mark(5, 1, "A", max_votes=2),
             mark(5, 2, "B", max_votes=2), mark(9, 1, "A"), mark(9, 2, "B", kind=None)]
    classified = ingest.classify_marks(marks_df(spark, marks)).withColumn("image_id", F.expr("nullif(image_id, 9)"))
    assert {r["image_id"] for r in summary._suspected(classified).collect()} == {1, 5, None}
    assert sorted((r["candidate"], r["overvotes"]) for r in summary.overvoted_choices(classified).collect()) == [("A", 2), ("B", 2)]
