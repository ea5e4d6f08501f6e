"""Streams over the election view, run to the end; the end state must equal batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyspark.operators import reports
from tallyspark.plans import election
from tallyspark.plans.cell_queries import _INK, _PAD_IN, _PIXELS, _WARP_DPI
from tallyspark.plans.oracle_base import plain, with_marks, with_scans, with_star
from tallyspark.plans.report_queries import _CONFIG, _ICR, _RANKED
from tallyspark.session import new_folder, stage
from tallyspark.sources import audit_log
from tallyspark.streaming import feed as feeds
from tallyspark.streaming import ingest as streams
from tallyspark.streaming.store import read_table

PASSES = 3


def _in_passes(rows: DataFrame, key: str, path: str, run: Callable[[DataFrame, int], StreamingQuery | None],
               files: int = 1, keys: DataFrame | None = None) -> None:
    """Let a table arrive in key order over several passes.

    Each pass adds ``files`` files or more to the folder and runs the query to the end, so a
    later pass is a restart from the checkpoint.  Where the keys can be read on their own
    (``keys``), a pass builds its own rows, and they are written once, into the folder.
    """
    spark = rows.sparkSession
    if keys is None:
        rows = keys = stage(rows, "arrivals")
    cuts = keys.approxQuantile(key, [i / PASSES for i in range(1, PASSES)], 0.01)
    bounds = [None, *cuts, None]
    # Tables of some size are read, and so written, in more pieces.
    pieces = keys.rdd.getNumPartitions() if files > 1 else files
    for number, (low, high) in enumerate(zip(bounds, bounds[1:]), start=1):
        part = rows
        if low is not None:
            part = part.filter(F.col(key) > int(low))
        if high is not None:
            part = part.filter(F.col(key) <= int(high))
        feeds.append_rows(part if pieces >= files else part.repartition(files, key), path)
        query = run(spark.readStream.schema(rows.schema).parquet(path), number)
        if query is not None:
            query.awaitTermination()


def _in_shares(rows: DataFrame, path: str, run: Callable[[int], bool]) -> None:
    """Let a table arrive in fixed shares, by image id, until ``run`` says that it is over."""
    for number in range(1, PASSES + 1):
        feeds.append_rows(rows.filter(F.col("image_id") % PASSES == number - 1), path)
        if not run(number):
            return


def _feed_rows(spark: SparkSession, d: str) -> DataFrame:
    return feeds.flatten(election.scans(spark, d), election.boxes(spark, d), election.measured)


def _feed_in_passes(spark: SparkSession, d: str, path: str, run: Callable[[DataFrame, int], StreamingQuery | None],
                    files: int = 1) -> None:
    """The feed over several passes, by image id, which the scans tell without their marks."""
    _in_passes(_feed_rows(spark, d), "image_id", path, run, files, election.scans(spark, d).select("image_id"))


#: Batches into which a pass of the ingested feed is cut.
BATCHES = 2


def ingested(spark: SparkSession, d: str) -> DataFrame:
    """Two batches per pass, whatever way the files were cut.

    The files of a pass are as many as its tasks, so a batch takes its share of them: the
    number of batches, each with a cost of its own, does not grow with the table.
    """
    out, folder = new_folder(spark, "stream"), new_folder(spark, "feed")
    seen = 0

    def run(_: DataFrame, __: int) -> StreamingQuery:
        nonlocal seen
        new, seen = feeds.count_files(spark, folder) - seen, feeds.count_files(spark, folder)
        return streams.ingest_stream(
            feeds.read_feed(spark, folder, files_per_trigger=max(1, -(-new // BATCHES))), out, f"{out}/_checkpoint")

    _feed_in_passes(spark, d, folder, run, files=BATCHES)
    star = streams.stored_star(spark, out)
    return (
        star.vote_opportunity.join(reports.image_names(star, "image_path"), "ballot_image_id")
        .join(reports.contest_names(star), "contest_id")
        .join(reports.candidate_names(star), "candidate_id_fk")
        .join(reports.barcode_keys(star, "raw_data"), "barcode_id")
        .select("image_path", "raw_data", "contest", "candidate", "dark_pct", "vote_status")
    )


def deduped(spark: SparkSession, d: str) -> DataFrame:
    rows = election.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("image_id"), F.format_string("/scans/c%d.png", "o_custkey").alias("image_path"))
    out = new_folder(spark, "stream")
    _in_passes(rows, "image_id", new_folder(spark, "feed"), lambda feed, _: (
        streams.dedupe_stream(feed).writeStream.format("parquet").option("path", f"{out}/data")
        .option("checkpointLocation", f"{out}/_checkpoint").trigger(availableNow=True).start()))
    return spark.read.schema(rows.schema).parquet(f"{out}/data").select("image_path")


def tallies(spark: SparkSession, d: str) -> DataFrame:
    out, folder = new_folder(spark, "stream"), new_folder(spark, "feed")
    _feed_in_passes(spark, d, folder, lambda *_: streams.tally_stream(
        feeds.read_feed(spark, folder, schema=streams.TALLY_FEED), out, f"{out}/_checkpoint"))
    return streams.running_tallies(spark, out)


def live(spark: SparkSession, d: str) -> DataFrame:
    """The native streaming aggregate; the table after the last batch."""
    out, folder = new_folder(spark, "stream"), new_folder(spark, "feed")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data")

    _feed_in_passes(spark, d, folder, lambda *_: (
        streams.live_counts(feeds.read_feed(spark, folder, schema=streams.LIVE_FEED)).writeStream.outputMode("complete").foreachBatch(keep)
        .option("checkpointLocation", f"{out}/_checkpoint").trigger(availableNow=True).start()))
    return spark.read.parquet(f"{out}/data")


def final_snapshot(spark: SparkSession, d: str) -> DataFrame:
    out = new_folder(spark, "stream")
    _feed_in_passes(spark, d, new_folder(spark, "feed"), lambda feed, number: streams.snapshot_every(
        feed, out, f"{out}/_checkpoint", pass_number=number))
    return streams.read_snapshots(spark, out).filter("snapshot = 'final'").drop("snapshot")


SNAPSHOT_EVERY = 500


def every_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """All snapshots: at multiples of 500 images, after each pass, and the final one."""
    out, folder = new_folder(spark, "stream"), new_folder(spark, "feed")

    def run(number: int) -> bool:
        streams.snapshot_every(feeds.read_feed(spark, folder), out, f"{out}/_checkpoint", SNAPSHOT_EVERY, number)
        return True

    _in_shares(_feed_rows(spark, d), folder, run)
    return streams.read_snapshots(spark, out)


REVIEW_LIMIT = 8


def stopped_review(spark: SparkSession, d: str) -> DataFrame:
    """Scans that wait for review when the limit stops the count; nothing is read after that."""
    out, folder = new_folder(spark, "stream"), new_folder(spark, "feed")

    def run(_: int) -> bool:
        query = streams.review_stream(feeds.read_feed(spark, folder), out, f"{out}/_checkpoint", REVIEW_LIMIT)
        try:
            query.awaitTermination()
        except StreamingQueryException as stop:
            if streams.ReviewLimitReached.__name__ not in str(stop):
                raise
            return False
        return True

    _in_shares(_feed_rows(spark, d), folder, run)
    return read_table(spark, out, "review", streams.REVIEW)


def quarantine(spark: SparkSession, d: str) -> DataFrame:
    out = new_folder(spark, "stream")
    _feed_in_passes(spark, d, new_folder(spark, "feed"), lambda feed, _: streams.review_stream(feed, out, f"{out}/_checkpoint", limit=0))
    return read_table(spark, out, "review", streams.REVIEW)


def streamed_ink(spark: SparkSession, d: str) -> DataFrame:
    out = new_folder(spark, "stream")
    pages = election.pages(spark, d).join(
        election.pixels(spark, d).select("image_id", "x", "y", "lum"), "image_id", "left").select(
        "image_id", "barcode", "seq", "x", "y", "lum")
    boxes = election.page_boxes(spark, d)
    _in_passes(pages, "seq", new_folder(spark, "feed"), lambda feed, _: streams.novel_ink_stream(
        feed, out, f"{out}/_checkpoint", boxes, _WARP_DPI, pad_in=_PAD_IN))
    return streams.stored_novel_ink(spark, out)


def audited(spark: SparkSession, d: str) -> DataFrame:
    out = new_folder(spark, "stream")
    scans = election.scans(spark, d).select("image_id", "image_name", "counted_at")
    _in_passes(scans, "image_id", new_folder(spark, "feed"),
               lambda feed, _: streams.scan_audit_stream(feed, "clerk", f"{out}/log", f"{out}/_checkpoint"))
    return audit_log.read_events(spark, f"{out}/log")


QUERIES = {
    "str1_ingest_stream": (ingested, with_marks("""
        SELECT image_path, barcode_data AS raw_data, contest_title AS contest, candidate_name AS candidate, dark_pct, vote_status
        FROM settled JOIN kept USING (image_id)""")),
    "str2_dedupe_stream": (deduped, "SELECT DISTINCT '/scans/c' || o_custkey || '.png' AS image_path FROM orders"),
    "str3_running_tallies": (tallies, with_marks("""
        SELECT contest_title, candidate, marked - coalesce(overvotes, 0) AS votes, ballots_checked, coalesce(overvotes, 0) AS overvotes
        FROM (SELECT contest_title, candidate_name AS candidate, count(*) FILTER (WHERE marked) AS marked,
                     count(*) AS ballots_checked FROM marks GROUP BY 1, 2)
        LEFT JOIN set_aside USING (contest_title, candidate)""", _ICR)),
    "str3_live_counts": (live, with_marks("""
        SELECT contest_title, candidate_name AS candidate, count(*) FILTER (WHERE marked) AS marked, count(*) AS ballots_checked
        FROM marks GROUP BY 1, 2""")),
    "str4_snapshot_every": (final_snapshot, with_star("""
        SELECT contest, candidate, contest_type, max_votes, percent_to_win, voted + overvoted AS marked, overvoted,
               voted AS counted, place, winner FROM won""", _CONFIG, _RANKED)),
    "str4_snapshots": (every_snapshot, with_star("""
        SELECT snapshot, contest, candidate, contest_type, max_votes, percent_to_win, voted + overvoted AS marked, overvoted,
               voted AS counted, place, contest_type IN ('PLURALITY', 'MEASURE') AND
               CASE WHEN max_votes <= 1 THEN place = 1 AND total > 0 AND voted > percent_to_win / 100.0 * total ELSE place <= max_votes END AS winner
        FROM names JOIN (
          SELECT *, CAST(row_number() OVER (PARTITION BY pass, contest ORDER BY voted DESC, candidate) AS INTEGER) AS place,
                 CAST(sum(voted) OVER (PARTITION BY pass, contest) AS DOUBLE) AS total FROM upto JOIN cfg USING (contest)) USING (pass)""",
        _CONFIG, f"""
passes AS (SELECT CAST(p AS INTEGER) AS pass, count(*) FILTER (WHERE id % {PASSES} < p) AS n_now, count(*) FILTER (WHERE id % {PASSES} < p - 1) AS n_before
           FROM bi, range(1, {PASSES + 1}) r(p) GROUP BY p),
names AS (SELECT pass, 'pass' || pass AS snapshot FROM passes UNION ALL SELECT {PASSES}, 'final'
          UNION ALL SELECT pass, 'n' || (n_now // {SNAPSHOT_EVERY} * {SNAPSHOT_EVERY}) FROM passes WHERE n_now // {SNAPSHOT_EVERY} > n_before // {SNAPSHOT_EVERY}),
upto AS (SELECT pass, co.contest_title AS contest, ca.candidate_name AS candidate, count(*) FILTER (WHERE vote_status = 'VOTED') AS voted,
                count(*) FILTER (WHERE vote_status = 'OVERVOTED') AS overvoted
         FROM vo JOIN passes ON vo.ballot_image_id % {PASSES} < pass JOIN co ON co.id = vo.contest_id JOIN ca ON ca.id = vo.candidate_id_fk GROUP BY 1, 2, 3)""")),
    "str5_review_limit": (stopped_review, with_scans(f"""
        SELECT image_id, image_path, error_message AS reason FROM scans WHERE error_message IS NOT NULL AND image_id % {PASSES} <= (
          SELECT coalesce(min(pass), {PASSES}) FROM (
            SELECT r.p AS pass FROM range({PASSES}) r(p), scans WHERE error_message IS NOT NULL AND image_id % {PASSES} <= r.p
            GROUP BY r.p HAVING count(*) >= {REVIEW_LIMIT}))""")),
    "str5_review_stream": (quarantine, with_scans(
        "SELECT image_id, image_path, error_message AS reason FROM scans WHERE error_message IS NOT NULL")),
    "str6_novel_ink_stream": (streamed_ink, plain("SELECT * FROM novel", _PIXELS, _INK)),
    "str7_scan_audit_stream": (audited, with_scans("""
        SELECT strftime(counted_at, '%Y-%m-%d %H:%M:%S') AS event_time, 'SCAN' AS event, 'clerk' AS username,
               image_name AS detail FROM scans""")),
}
