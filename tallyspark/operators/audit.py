"""Exports for risk-limiting audits: batch manifest and cast-vote records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import text
from tallyspark.operators import reports
from tallyspark.operators.ingest import Star
from tallyspark.session import number_rows, stage

# Fixed values of the export format.
TABULATOR = 1
OVERVOTE_CELL = "OVERVOTE"
WRITE_IN_CELL = "WRITE-IN"
CVR_COLUMNS = ("CvrNumber", "TabulatorNum", "BatchId", "RecordId", "BallotType", "PrecinctPortion")
MANIFEST_COLUMNS = ("Container", "Batch Name", "Number of Ballots")


def _batch() -> F.Column:
    return F.concat(text.blank_to("region_id", "?"), F.lit("-"), text.blank_to("ballot_type_id", "1"))


def ballot_manifest(star: Star) -> DataFrame:
    """Page-1 images per jurisdiction and batch; images without a barcode are left out."""
    pages = star.ballot_image.filter("page_number = 1").groupBy("barcode_id").agg(F.count("*").alias("n"))
    codes = reports.barcode_keys(star, "jurisdiction_id", "region_id", "ballot_type_id")
    return (
        pages.join(codes, "barcode_id")
        .groupBy(text.blank_to("jurisdiction_id", "1").alias("container"), _batch().alias("batch_name"))
        .agg(F.sum("n").alias("ballots"))
    )


def _keyed_images(star: Star) -> DataFrame:
    fields = ("jurisdiction_id", "region_id", "party_id", "ballot_type_id", "election_id")
    codes = reports.barcode_keys(star, *fields)
    stem = F.regexp_replace("image_name", text.PAGE_SUFFIX, "")
    key = F.concat_ws("|", *[text.blank_to(f, "0") for f in fields], stem)
    return star.ballot_image.select("id", "image_name", "page_number", "barcode_id").join(codes, "barcode_id").select(
        F.col("id").alias("image_id"), "page_number", "barcode_id", key.alias("ballot_key")
    )


def physical_ballots(star: Star) -> DataFrame:
    """Images that belong to one sheet of paper, with the image that stands for it."""
    return _keyed_images(star).groupBy("ballot_key").agg(
        F.coalesce(F.min(F.when(F.col("page_number") == 1, F.col("image_id"))), F.min("image_id")).alias("anchor_id"),
        F.min("image_id").alias("first_id"),
        F.count("*").alias("pages"),
    )


def ballot_of_image(star: Star, ballots: DataFrame | None = None) -> DataFrame:
    """Maps every image to the anchor of its physical ballot."""
    ballots = physical_ballots(star) if ballots is None else ballots
    images = _keyed_images(star).select("ballot_key", "image_id", "page_number")
    return images.join(ballots.select("ballot_key", "anchor_id"), "ballot_key").drop("ballot_key")


def contest_cells(star: Star, pages: DataFrame | None = None) -> DataFrame:
    """Text of one contest on one physical ballot.

    Facts are first gathered per image and entry, on plain numbers; the list behind a cell
    is as long as the contest's marks on the sheet.  Marks come in image order and then in
    the order they stand in; ranked ones by rank first.
    """
    pages = ballot_of_image(star) if pages is None else pages
    types = star.contest.select(F.col("id").alias("contest_id"), "contest_type")
    names = star.candidate.select(F.col("id").alias("candidate_id_fk"), "candidate_name", "write_in")
    voted, spoiled = F.col("vote_status") == "VOTED", F.col("vote_status") == "OVERVOTED"
    entries = (
        star.vote_opportunity.groupBy(F.col("ballot_image_id").alias("image_id"), "contest_id", "candidate_id_fk")
        .agg(F.count_if(spoiled).alias("spoiled"), F.collect_list(F.when(voted, F.col("seq"))).alias("places"))
        .join(pages.select("image_id", "anchor_id"), "image_id")
        .join(types, "contest_id")
        .join(names, "candidate_id_fk")
    )
    ranked = F.col("contest_type") == "RANKED_CHOICE"
    shown = F.when(ranked, F.regexp_replace("candidate_name", text.RANK_FIND, "($1)")).otherwise(
        F.when(F.col("write_in"), WRITE_IN_CELL).otherwise(F.col("candidate_name"))
    )
    sort_rank = F.when(ranked, text.rank_or_last("candidate_name")).otherwise(0)
    named = entries.withColumns({"rank": sort_rank, "shown": shown})
    each = F.transform("places", lambda at: F.struct("rank", "image_id", at.alias("at"), "shown"))
    cells = named.withColumn("each", each).groupBy("anchor_id", "contest_id").agg(
        F.bool_or(F.col("spoiled") > 0).alias("spoiled"), F.flatten(F.collect_list("each")).alias("entries")
    )
    words = F.transform(F.array_sort("entries"), lambda e: e["shown"])
    cell = F.when(F.col("spoiled"), OVERVOTE_CELL).otherwise(F.array_join(words, "|"))
    return cells.select("anchor_id", "contest_id", cell.alias("cell"))


def cvr_records(star: Star, ballots: DataFrame | None = None) -> DataFrame:
    """The fixed columns of every physical ballot, numbered by its first image."""
    ballots = physical_ballots(star) if ballots is None else ballots
    numbered = number_rows(ballots.select("anchor_id", "first_id"), ["first_id"], "cvr_number")
    images = star.ballot_image.select(F.col("id").alias("anchor_id"), "barcode_id")
    codes = reports.barcode_keys(star, "jurisdiction_id", "region_id", "party_id", "ballot_type_id")
    kind = F.concat(
        F.lit("J"), text.blank_to("jurisdiction_id", "?"), F.lit("-P"), text.blank_to("party_id", "0"),
        F.lit("-T"), text.blank_to("ballot_type_id", "1"),
    )
    return numbered.join(images, "anchor_id").join(codes, "barcode_id").select(
        "anchor_id",
        "cvr_number",
        F.lit(TABULATOR).alias("tabulator_num"),
        _batch().alias("batch_id"),
        F.col("anchor_id").alias("record_id"),
        kind.alias("ballot_type"),
        F.concat(F.lit("Region-"), text.blank_to("region_id", "?")).alias("precinct_portion"),
    )


def cvr_export(star: Star) -> DataFrame:
    """One row per physical ballot with a column per contest in id order.

    The column list comes from the contest dimension, so the pivot needs no extra
    pass over the facts to find it.  Same-titled contests get their id appended.
    """
    contests = [(c["id"], c["contest_title"]) for c in star.contest.select("id", "contest_title").orderBy("id").collect()]
    titles = [t for _, t in contests]
    names = {i: (t if titles.count(t) == 1 else f"{t} ({i})") for i, t in contests}
    ballots = stage(physical_ballots(star), "ballots")
    cells = contest_cells(star, ballot_of_image(star, ballots)).groupBy("anchor_id").pivot("contest_id", [i for i, _ in contests]).agg(F.first("cell"))
    wide = cells.select("anchor_id", *[F.col(str(i)).alias(names[i]) for i, _ in contests])
    joined = cvr_records(star, ballots).join(wide, "anchor_id", "left").drop("anchor_id")
    return joined.na.fill("", [names[i] for i, _ in contests])


def write_manifest(manifest: DataFrame, path: str, mode: str = "overwrite") -> None:
    renamed = manifest.select(*[F.col(c).alias(n) for c, n in zip(manifest.columns, MANIFEST_COLUMNS)])
    renamed.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_cvr(export: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV parts in running-number order."""
    fixed = dict(zip(("cvr_number", "tabulator_num", "batch_id", "record_id", "ballot_type", "precinct_portion"), CVR_COLUMNS))
    renamed = export.orderBy("cvr_number").select(*[F.col(f"`{c}`").alias(fixed.get(c, c)) for c in export.columns])
    renamed.write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
