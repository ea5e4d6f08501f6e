"""Report queries over the stored star.

Facts are counted by their keys before any join, so the scan feeds a map-side
aggregate and the dimensions only ever meet a few rows.  Names and report keys
are applied afterwards, with a second small aggregate where several keys share a
name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark import schema as S
from tallyspark.functions import text
from tallyspark.operators.ingest import Star

_COUNTS = {"voted": "VOTED", "overvoted": "OVERVOTED", "unmarked": "UNMARKED"}


def _has(status: str) -> Column:
    return F.col("vote_status") == status


def count_by_keys(facts: DataFrame, *keys: str) -> DataFrame:
    """Voted, overvoted and unmarked boxes per key, straight from the fact scan."""
    return facts.groupBy(*keys).agg(*[F.count_if(_has(s)).alias(n) for n, s in _COUNTS.items()])


def _sums(*names: str) -> list[Column]:
    return [F.sum(n).alias(n) for n in names]


def contest_names(star: Star, *more: str) -> DataFrame:
    return star.contest.select(F.col("id").alias("contest_id"), F.col("contest_title").alias("contest"), *more)


def candidate_names(star: Star, *more: str) -> DataFrame:
    return star.candidate.select(
        F.col("id").alias("candidate_id_fk"), F.col("candidate_name").alias("candidate"), *more
    )


def barcode_keys(star: Star, *columns: str) -> DataFrame:
    return star.barcode.select(F.col("id").alias("barcode_id"), *columns)


def image_names(star: Star, *columns: str) -> DataFrame:
    return star.ballot_image.select(F.col("id").alias("ballot_image_id"), *columns)


def _named(star: Star, counted: DataFrame) -> DataFrame:
    return counted.join(contest_names(star), "contest_id").join(candidate_names(star), "candidate_id_fk")


def _named_counts(star: Star, *keys: str) -> DataFrame:
    return _named(star, count_by_keys(star.vote_opportunity, "contest_id", "candidate_id_fk", *keys))


def named_totals(star: Star, counted: DataFrame) -> DataFrame:
    """Counts per contest and candidate key, as counts per title and name."""
    return _named(star, counted).groupBy("contest", "candidate").agg(*_sums(*_COUNTS))


def votes_by_contest(star: Star) -> DataFrame:
    """Counts per title and candidate name, with the rank split off the name."""
    totals = named_totals(star, count_by_keys(star.vote_opportunity, "contest_id", "candidate_id_fk"))
    name = text.parse_rank("candidate")
    return totals.select(
        "contest", "candidate", *_COUNTS,
        name["base_name"].alias("base_name"),
        name["rank_label"].alias("rank_label"),
        name["ranked_choice"].alias("ranked_choice"),
    )


def _by_barcode_field(star: Star, field: str, missing: str, name: str) -> DataFrame:
    """Groups by the raw field and names missing values afterwards, so a null and the
    literal stand-in stay two rows."""
    joined = _named_counts(star, "barcode_id").join(barcode_keys(star, field), "barcode_id")
    totals = joined.groupBy("contest", "candidate", field).agg(*_sums(*_COUNTS))
    return totals.select("contest", "candidate", F.coalesce(field, F.lit(missing)).alias(name), *_COUNTS)


def votes_by_contest_precinct(star: Star) -> DataFrame:
    return _by_barcode_field(star, "region_id", S.UNKNOWN, "precinct")


def votes_by_contest_party(star: Star) -> DataFrame:
    return _by_barcode_field(star, "party_id", "0", "party")


def votes_by_contest_precinct_party(star: Star) -> DataFrame:
    joined = _named_counts(star, "barcode_id").join(barcode_keys(star, "region_id", "party_id"), "barcode_id")
    totals = joined.groupBy("contest", "region_id", "party_id", "candidate").agg(*_sums("voted", "overvoted"))
    return totals.select(
        "contest", F.col("region_id").alias("precinct"), F.col("party_id").alias("party"),
        "candidate", "voted", "overvoted",
    )


def ballots_per_precinct(star: Star) -> DataFrame:
    """Images per precinct.  The image id is the table's key, so counting rows counts images."""
    per_code = star.ballot_image.groupBy("barcode_id").agg(F.count("id").alias("ballots_scanned"))
    joined = per_code.join(barcode_keys(star, "region_id"), "barcode_id")
    return joined.groupBy(F.col("region_id").alias("precinct")).agg(*_sums("ballots_scanned"))


def overvoted_ballots(star: Star) -> DataFrame:
    bad = star.vote_opportunity.filter(_has("OVERVOTED"))
    counted = bad.groupBy("ballot_image_id", "contest_id").agg(F.count("*").alias("overvoted_indicators"))
    named = counted.join(contest_names(star), "contest_id").join(
        image_names(star, "image_name", "image_path"), "ballot_image_id"
    )
    return named.groupBy("image_name", "image_path", "contest").agg(*_sums("overvoted_indicators"))


def overvoted_pairs(star: Star) -> DataFrame:
    bad = star.vote_opportunity.filter(_has("OVERVOTED")).select("ballot_image_id", "contest_id").distinct()
    return (
        bad.join(contest_names(star, "contest_type", "max_votes"), "contest_id")
        .join(image_names(star, "image_name"), "ballot_image_id")
        .select("image_name", "contest", "contest_id", "contest_type", "max_votes")
        .distinct()
    )


def write_ins_by_contest_precinct(star: Star) -> DataFrame:
    write_ins = star.candidate.filter("write_in").select(F.col("id").alias("candidate_id_fk"))
    counted = (
        star.vote_opportunity.filter(_has("VOTED"))
        .join(write_ins, "candidate_id_fk", "left_semi")
        .groupBy("contest_id", "barcode_id").agg(F.count("*").alias("write_in_votes"))
    )
    named = counted.join(contest_names(star), "contest_id").join(barcode_keys(star, "region_id"), "barcode_id")
    return named.groupBy("contest", F.col("region_id").alias("precinct")).agg(*_sums("write_in_votes"))


def marked_write_ins(star: Star) -> DataFrame:
    """Every write-in box that was marked, counted or not."""
    write_ins = candidate_names(star, "write_in").filter("write_in")
    return (
        star.vote_opportunity.filter(~_has("UNMARKED"))
        .join(write_ins, "candidate_id_fk")
        .join(contest_names(star), "contest_id")
        .join(image_names(star, "image_name"), "ballot_image_id")
        .join(barcode_keys(star, "raw_data"), "barcode_id", "left")
        .select(
            F.col("ballot_image_id").alias("image_id"), "image_name", "contest", "candidate",
            F.coalesce("raw_data", F.lit("")).alias("barcode_data"),
        )
    )


def contest_parts(facts: DataFrame) -> DataFrame:
    """Counts per contest, and which images it is on, as bitmaps of 32768 image ids each.

    Parts of several batches add up (``add_parts``), also where batches share images.
    """
    image = "ballot_image_id"
    return facts.groupBy("contest_id", F.bitmap_bucket_number(image).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(image)).alias("images"),
        *[F.count_if(_has(s)).alias(n) for n, s in _COUNTS.items()])


def add_parts(parts: DataFrame) -> DataFrame:
    """Parts of any number of batches as those of one."""
    return parts.groupBy("contest_id", "bucket").agg(F.bitmap_or_agg("images").alias("images"), *_sums(*_COUNTS))


def contest_dashboard(star: Star, parts: DataFrame | None = None) -> DataFrame:
    """Counts and distinct ballots per contest.

    Title and type are the contest's key, so the distinct count can run on the id.  Images
    are marked in bitmaps before anything moves, so no row per contest and image does.
    """
    parts = contest_parts(star.vote_opportunity) if parts is None else parts
    totals = parts.groupBy("contest_id").agg(F.sum(F.bitmap_count("images")).alias("ballots"), *_sums(*_COUNTS))
    return totals.join(contest_names(star, "contest_type"), "contest_id").select(
        "contest", "contest_type", "ballots", *_COUNTS
    )


def contest_config(star: Star) -> DataFrame:
    """Winner settings per title; the last row of a repeated title wins."""
    settings = F.struct(
        F.coalesce("max_votes", F.lit(S.DEFAULT_MAX_VOTES)).alias("max_votes"),
        F.coalesce("percent_to_win", F.lit(S.DEFAULT_PERCENT_TO_WIN)).alias("percent_to_win"),
        F.coalesce("contest_type", F.lit(S.DEFAULT_CONTEST_TYPE)).alias("contest_type"),
    )
    last = star.contest.groupBy(F.col("contest_title").alias("contest")).agg(F.max_by(settings, "id").alias("last"))
    return last.select("contest", "last.*")


def flagged_ballots(star: Star) -> DataFrame:
    """Images with stray ink, worst first."""
    return (
        star.ballot_image.filter("scribble_flagged")
        .join(barcode_keys(star, "raw_data"), "barcode_id", "left")
        .select(
            F.col("id").alias("image_id"), "image_name", "image_path",
            F.coalesce("scribble_pixels", F.lit(0)).alias("scribble_pixels"),
            F.coalesce("raw_data", F.lit("")).alias("barcode_data"),
            "scribble_outline_path",
        )
        .orderBy(F.desc("scribble_pixels"), "image_id")
    )


def headline_totals(star: Star) -> DataFrame:
    """One row: votes cast, images, overvoted images, flagged images."""
    from_images = star.ballot_image.agg(
        F.count("*").alias("ballot_images"), F.count_if(F.col("scribble_flagged")).alias("flagged_images")
    )
    image = "ballot_image_id"
    per_bucket = star.vote_opportunity.groupBy(F.bitmap_bucket_number(image).alias("bucket")).agg(
        F.count_if(_has("VOTED")).alias("votes_cast"),
        F.bitmap_count(F.bitmap_construct_agg(F.when(_has("OVERVOTED"), F.bitmap_bit_position(image)))).alias("overvoted_images"),
    )
    from_facts = per_bucket.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("votes_cast", "overvoted_images")])
    pieces = from_facts.unionByName(from_images, allowMissingColumns=True)
    return pieces.agg(*_sums("votes_cast", "ballot_images", "overvoted_images", "flagged_images"))


def candidate_by_precinct(star: Star, name: str) -> DataFrame:
    """Votes of one candidate name per contest and precinct."""
    chosen = candidate_names(star).filter(F.col("candidate") == name)
    counted = (
        star.vote_opportunity.filter(_has("VOTED"))
        .join(chosen.select("candidate_id_fk"), "candidate_id_fk", "left_semi")
        .groupBy("contest_id", "barcode_id").agg(F.count("*").alias("votes"))
    )
    named = counted.join(contest_names(star), "contest_id").join(barcode_keys(star, "region_id"), "barcode_id")
    return named.groupBy("contest", F.col("region_id").alias("precinct")).agg(*_sums("votes"))


def contest_by_candidate(star: Star, title: str) -> DataFrame:
    """Votes of one contest title per candidate."""
    chosen = contest_names(star).filter(F.col("contest") == title)
    counted = (
        star.vote_opportunity.filter(_has("VOTED"))
        .join(chosen.select("contest_id"), "contest_id", "left_semi")
        .groupBy("candidate_id_fk").agg(F.count("*").alias("votes"))
    )
    return counted.join(candidate_names(star), "candidate_id_fk").groupBy("candidate").agg(*_sums("votes"))
