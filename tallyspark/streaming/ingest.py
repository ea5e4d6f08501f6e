"""Continuous ingest: scans arrive as files, results grow batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallyspark import schema as S
from tallyspark.operators import cells, ingest, reports, summary, winners
from tallyspark.operators.ingest import Star
from tallyspark.session import discarding, number_rows, stage
from tallyspark.sources import audit_log
from tallyspark.streaming import path_index
from tallyspark.streaming.feed import marks_of, narrowed, scans_of
from tallyspark.streaming.store import read_table, write_batch

REVIEW = T.StructType(
    [T.StructField("image_id", T.LongType()), T.StructField("image_path", T.StringType()), T.StructField("reason", T.StringType())]
)
SHARE = T.StructType(
    [
        T.StructField("contest_id", T.LongType()), T.StructField("candidate_id_fk", T.LongType()),
        T.StructField("voted", T.LongType()), T.StructField("overvoted", T.LongType()), T.StructField("unmarked", T.LongType()),
    ]
)
_SIZE = T.StructType([T.StructField("images", T.LongType())])
TALLY = T.StructType(
    [
        T.StructField("contest_title", T.StringType()),
        T.StructField("candidate", T.StringType()),
        T.StructField("votes", T.LongType()),
        T.StructField("ballots_checked", T.LongType()),
        T.StructField("overvotes", T.LongType()),
    ]
)

# What the tallies read of a mark, and what they read of the feed.
_TALLIED = ("seq", "contest_id", "contest_title", "contest_type", "max_votes", "percent_to_win", "candidate_id", "candidate_name")
TALLY_FEED = narrowed(("image_id", "image_path", "error_message"), (*_TALLIED, *ingest.JUDGED_BY))
LIVE_FEED = narrowed(("image_path", "error_message"), ("contest_title", "candidate_name", *ingest.JUDGED_BY))

BatchStep = Callable[[DataFrame, int], None]


class ReviewLimitReached(RuntimeError):
    """Too many scans need a person; counting stops."""


def run(stream: DataFrame, step: BatchStep, checkpoint: str) -> StreamingQuery:
    """Process what has arrived and stop; start again later to go on from there."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# --- ingest ------------------------------------------------------------------


def _new_rows(found: DataFrame, known: DataFrame, keys: list[str], schema: T.StructType) -> DataFrame:
    """New keys of a dimension, numbered after the ids already given."""
    fresh = stage(found.join(known.select(*keys), keys, "left_anti"), "fresh")
    if fresh.isEmpty():
        return fresh.sparkSession.createDataFrame([], schema)
    highest = known.agg(F.max("id").alias("top")).first()["top"] or 0
    return number_rows(fresh, keys, "id", start=highest + 1).select(*schema.fieldNames())


def _grow(spark: SparkSession, out: str, table: str, schema: T.StructType, found: DataFrame, keys: list[str],
          batch_id: int) -> DataFrame:
    """Adds a batch's new dimension rows and returns the dimension so far."""
    known = read_table(spark, out, table, schema, before=batch_id)
    write_batch(_new_rows(found, known, keys, schema), out, table, batch_id)
    return read_table(spark, out, table, schema, before=batch_id + 1)


def _kept(batch: DataFrame, batch_id: int, paths: str) -> tuple[DataFrame, DataFrame]:
    """The scans of a batch that count, and those for review.

    A path counts once: later copies in the batch go, and so do paths that the index
    ``paths`` has from an earlier batch.  The scans are written without their marks, so that
    the marks are read for their own sake only, and nothing of a batch is held in memory.
    """
    good, review = ingest.split_review(stage(scans_of(batch), "scans"))
    return stage(path_index.new_paths(ingest.dedupe_images(good), paths, batch_id), "kept"), review


def ingest_batch(batch: DataFrame, batch_id: int, out: str,
                 dark_pct_min: float = S.DEFAULT_DARK_PCT_MIN) -> None:
    """One batch of the feed into the stored star and the review table.

    What is staged on the way is deleted at the end of the batch.
    """
    spark = batch.sparkSession
    with discarding(spark):
        kept, review = _kept(batch, batch_id, f"{out}/image_path")
        # Marks of other scans leave where the marks meet their image.
        marks = ingest.classify_marks(marks_of(batch), dark_pct_min)

        barcodes = _grow(spark, out, "barcode", S.BARCODE, ingest.distinct_barcodes(kept), ["raw_data"], batch_id)
        images = ingest.build_image_table(kept, barcodes)
        settled = stage(ingest.settled_marks(marks, images), "settled")
        variants = ingest.dimension_variants(settled)
        contests = _grow(spark, out, "contest", S.CONTEST, ingest.described_contests(variants, settled),
                         ["contest_title", "contest_type"], batch_id)
        candidates = _grow(spark, out, "candidate", S.CANDIDATE, ingest.described_candidates(variants, settled, contests),
                           ["contest_id", "candidate_name"], batch_id)
        write_batch(ingest.key_facts(settled, contests, candidates), out, "vote_opportunity", batch_id)
        write_batch(review, out, "review", batch_id)
        write_batch(images, out, "ballot_image", batch_id)
        path_index.add_paths(kept, f"{out}/image_path", batch_id)


def stored_star(spark: SparkSession, out: str, before: int | None = None) -> Star:
    return Star(
        read_table(spark, out, "barcode", S.BARCODE, before),
        read_table(spark, out, "ballot_image", S.BALLOT_IMAGE, before),
        read_table(spark, out, "contest", S.CONTEST, before),
        read_table(spark, out, "candidate", S.CANDIDATE, before),
        read_table(spark, out, "vote_opportunity", S.VOTE_OPPORTUNITY, before),
    )


def ingest_stream(feed: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return run(feed, lambda batch, batch_id: ingest_batch(batch, batch_id, out), checkpoint)


# --- duplicates --------------------------------------------------------------


def dedupe_stream(scans: DataFrame, watermark: tuple[str, str] | None = None) -> DataFrame:
    """Each path once over the life of the stream.

    The state holds one key per path; a watermark (column, delay) bounds it when
    copies only turn up within that delay.
    """
    if watermark is None:
        return scans.dropDuplicates(["image_path"])
    return scans.withWatermark(*watermark).dropDuplicatesWithinWatermark(["image_path"])


# --- tallies -----------------------------------------------------------------


def live_counts(feed: DataFrame, dark_pct_min: float = S.DEFAULT_DARK_PCT_MIN) -> DataFrame:
    """Boxes looked at and marked per title and candidate, as a streaming aggregate.

    Scans for review do not count, nor do copies of a path that has been seen before.  Boxes
    are judged where they lie, so a scan moves to its path with what is counted and no more;
    a feed of ``LIVE_FEED`` will do.
    """
    judged = F.transform("marks", lambda m: F.struct(
        m["contest_title"].alias("contest_title"), m["candidate_name"].alias("candidate"),
        ingest.is_marked(lambda c: m[c], dark_pct_min).alias("marked")))
    good = feed.filter(F.col("error_message").isNull()).select("image_path", judged.alias("marks")).dropDuplicates(["image_path"])
    return good.select(F.inline("marks")).groupBy("contest_title", "candidate").agg(
        F.count_if("marked").alias("marked"), F.count("*").alias("ballots_checked")
    )


def tally_batch(batch: DataFrame, batch_id: int, out: str) -> None:
    """The batch's share of the session tally, under the same rule for repeats as the store.

    A scan is one row of the feed, so overvotes are settled inside a batch and shares
    simply add up.  Scans leave before their marks are unrolled; a feed of ``TALLY_FEED`` will do.
    """
    spark = batch.sparkSession
    with discarding(spark):
        kept, _ = _kept(batch.select(*TALLY_FEED.fieldNames()), batch_id, f"{out}/tally_path")
        counted = batch.select("image_id", "marks").join(kept.select("image_id"), "image_id", "left_semi")
        marks = stage(marks_of(counted).select("image_id", *_TALLIED, ingest.is_marked().alias("marked")), "marks")
        write_batch(summary.session_tallies(marks), out, "tally", batch_id)
        path_index.add_paths(kept, f"{out}/tally_path", batch_id)


def tally_stream(feed: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return run(feed, lambda batch, batch_id: tally_batch(batch, batch_id, out), checkpoint)


def running_tallies(spark: SparkSession, out: str) -> DataFrame:
    shares = read_table(spark, out, "tally", TALLY)
    return shares.groupBy("contest_title", "candidate").agg(
        *[F.sum(c).alias(c) for c in ("votes", "ballots_checked", "overvotes")]
    )


# --- snapshots ---------------------------------------------------------------


def snapshot_batch(batch: DataFrame, batch_id: int, out: str, every: int = S.DEFAULT_SNAPSHOT_INTERVAL) -> None:
    """Ingest, then write the results report when the image count passed a multiple of
    ``every``.  The snapshot is named after that multiple, so a replay replaces it.

    Every batch leaves its own counts per contest and candidate, and its number of images.
    A report adds those up; neither facts nor images of earlier batches are read again.
    """
    spark = batch.sparkSession
    ingest_batch(batch, batch_id, out)
    facts = _of_batch(spark, out, "vote_opportunity", S.VOTE_OPPORTUNITY, batch_id)
    write_batch(reports.count_by_keys(facts, "contest_id", "candidate_id_fk"), out, "share", batch_id)
    images = _of_batch(spark, out, "ballot_image", S.BALLOT_IMAGE, batch_id)
    write_batch(images.agg(F.count("*").alias("images")), out, "size", batch_id)
    seen, now = (
        read_table(spark, out, "size", _SIZE, before=upto).agg(F.coalesce(F.sum("images"), F.lit(0)).alias("n")).first()["n"]
        for upto in (batch_id, batch_id + 1)
    )
    if every > 0 and now // every > seen // every:
        write_snapshot(spark, out, f"n{now // every * every}", before=batch_id + 1)


def _of_batch(spark: SparkSession, out: str, table: str, schema: T.StructType, batch_id: int) -> DataFrame:
    """The rows that one batch wrote."""
    return spark.read.schema(schema).parquet(f"{out}/{table}/batch_id={batch_id}")


def shares_report(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """The results report from the batches' counts."""
    shares = read_table(spark, out, "share", SHARE, before)
    counts = shares.groupBy("contest_id", "candidate_id_fk").agg(*[F.sum(c).alias(c) for c in ("voted", "overvoted", "unmarked")])
    return winners.report_of_counts(stored_star(spark, out, before), counts)


def write_snapshot(spark: SparkSession, out: str, name: str, before: int | None = None) -> None:
    shares_report(spark, out, before).write.mode("overwrite").parquet(f"{out}/snapshots/snapshot={name}")


def snapshot_every(feed: DataFrame, out: str, checkpoint: str, every: int = S.DEFAULT_SNAPSHOT_INTERVAL, pass_number: int = 1) -> None:
    """One pass over what has arrived, with snapshots on the way, one for the pass, and the final one."""
    spark = feed.sparkSession
    run(feed, lambda batch, batch_id: snapshot_batch(batch, batch_id, out, every), checkpoint).awaitTermination()
    write_snapshot(spark, out, f"pass{pass_number}")
    write_snapshot(spark, out, "final")


def read_snapshots(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/snapshots")


# --- review ------------------------------------------------------------------


def review_batch(batch: DataFrame, batch_id: int, out: str, limit: int, first_batch: int = 0) -> None:
    """Quarantines unreadable scans; stops the query once ``limit`` of them wait.

    Rows are written before the query stops, and only those since ``first_batch``
    count, so a run after a fix starts from zero.
    """
    spark = batch.sparkSession
    _, review = ingest.split_review(scans_of(batch))
    write_batch(review, out, "review", batch_id)
    with_batch = T.StructType([*REVIEW.fields, T.StructField("batch_id", T.LongType())])
    waiting = spark.read.schema(with_batch).parquet(f"{out}/review").filter(
        (F.col("batch_id") >= first_batch) & (F.col("batch_id") <= batch_id)
    )
    if ingest.review_limit_reached(waiting, limit):
        raise ReviewLimitReached(f"{limit} or more scans need manual review; fix the cause and count the rest again")


def review_stream(feed: DataFrame, out: str, checkpoint: str, limit: int = S.DEFAULT_REVIEW_LIMIT,
                  first_batch: int = 0) -> StreamingQuery:
    return run(feed, lambda batch, batch_id: review_batch(batch, batch_id, out, limit, first_batch), checkpoint)


# --- stray ink ---------------------------------------------------------------

_FIRST = T.StructType(
    [
        T.StructField("barcode", T.StringType()), T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType()),
        T.StructField("seq", T.LongType()), T.StructField("image_id", T.LongType()),
    ]
)
#: Folders of the ink tables, by barcode; a batch reads those of its own barcodes.
INK_BUCKETS = 64
_BUCKET = T.StructField("bucket", T.IntegerType())
_STORED_FIRST = T.StructType([*_FIRST.fields, _BUCKET])
_NEAR = T.StructType([*_FIRST.fields[:3], _BUCKET])
_SEED = T.StructType([T.StructField("barcode", T.StringType()), T.StructField("seed_seq", T.LongType())])


def ink_batch(batch: DataFrame, batch_id: int, out: str, boxes: DataFrame, warp_dpi: int,
              dilation_in: float = cells.DILATION_IN, pad_in: float = cells.INDICATOR_PAD_IN) -> None:
    """Stray ink of a batch of pixels against all earlier ones.

    What is remembered is the first ballot per position, and the positions near any ink so
    far, both kept as tables of additions: their size is that of the printed pages.  Only
    positions that this batch is the first to darken are dilated.  The tables are joined,
    not held per barcode in one task, so a barcode may have any share of the ballots.
    Scans arrive in scan order, and every page has at least one pixel row.
    """
    spark = batch.sparkSession
    pixels = batch.persist()
    with discarding(spark):
        _ink_batch(spark, pixels, batch_id, out, boxes, warp_dpi, dilation_in, pad_in)
    pixels.unpersist()


def _ink_batch(spark: SparkSession, pixels: DataFrame, batch_id: int, out: str, boxes: DataFrame, warp_dpi: int,
               dilation_in: float, pad_in: float) -> None:
    place = ["barcode", "x", "y"]
    bucket = F.pmod(F.xxhash64("barcode"), F.lit(INK_BUCKETS)).cast("int").alias("bucket")
    touched = [r["bucket"] for r in pixels.select(bucket).distinct().collect()]

    def stored(table: str, schema: T.StructType) -> DataFrame:
        return read_table(spark, out, table, schema, before=batch_id).filter(F.col("bucket").isin(touched)).select(*place)

    seeds = read_table(spark, out, "seed", _SEED, before=batch_id)
    new_seeds = pixels.groupBy("barcode").agg(F.min("seq").alias("seed_seq")).join(seeds, "barcode", "left_anti")
    write_batch(new_seeds, out, "seed", batch_id)

    first = cells.first_dark(cells.dark_mask(pixels))
    frontier = stage(first.join(stored("first_dark", _STORED_FIRST), place, "left_anti"), "frontier")
    write_batch(frontier.select(*_FIRST.fieldNames(), bucket), out, "first_dark", batch_id, ("bucket",))

    radius = int(dilation_in * warp_dpi + 0.5)
    near = stored("near", _NEAR)
    mask = stage(cells.masked_positions(boxes, warp_dpi, pad_in), "mask")
    # Ink of earlier batches lies in ``near``; of this batch, on the frontier itself.
    novel = (
        cells.novel_positions(frontier, radius)
        .join(near, place, "left_anti")
        .join(mask, place, "left_anti")
        .join(read_table(spark, out, "seed", _SEED, before=batch_id + 1), "barcode")
        .filter(F.col("seq") > F.col("seed_seq"))
        .select(*_FIRST.fieldNames())
    )
    write_batch(novel, out, "novel", batch_id)
    grown = cells.dilated(frontier, radius).join(near, place, "left_anti")
    write_batch(grown.select(*place, bucket), out, "near", batch_id, ("bucket",))


def novel_ink_stream(pixels: DataFrame, out: str, checkpoint: str, boxes: DataFrame, warp_dpi: int,
                     dilation_in: float = cells.DILATION_IN, pad_in: float = cells.INDICATOR_PAD_IN) -> StreamingQuery:
    return run(
        pixels, lambda batch, batch_id: ink_batch(batch, batch_id, out, boxes, warp_dpi, dilation_in, pad_in), checkpoint
    )


def stored_novel_ink(spark: SparkSession, out: str) -> DataFrame:
    return read_table(spark, out, "novel", _FIRST)


# --- audit -------------------------------------------------------------------


def scan_audit_stream(scans: DataFrame, username: str, path: str, checkpoint: str) -> StreamingQuery:
    """One SCAN line per image, appended exactly once by the file sink."""
    events = audit_log.scan_events(scans, username, F.col("counted_at"))
    return (
        audit_log.event_lines(events).writeStream.format("text").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
