"""Measured marks and scans turned into the results star.

Row order carries meaning here ("first seen wins"), and Spark rows have none, so
scans are ordered by ``image_id`` and the marks of one image by ``seq``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark import schema as S
from tallyspark.functions import measure, text
from tallyspark.session import number_rows, stage

# The borderline band in which the trimmed sample is consulted.
TRIM_BAND = (5.0, 10.0)
PRESENCE_STYLES = ("ARROW", "CONNECT_DOTS")
SINGLE_MARK_TYPES = ("PLURALITY", "MEASURE")
NO_CONTEST_ID = -1


@dataclass(frozen=True)
class Star:
    """The five results tables."""

    barcode: DataFrame
    ballot_image: DataFrame
    contest: DataFrame
    candidate: DataFrame
    vote_opportunity: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in S.RESULT_TABLES}


# --- scans -------------------------------------------------------------------


def split_review(scans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scans that can be counted, and the (path, reason) rows that need a person."""
    good = scans.filter(F.col("error_message").isNull())
    review = scans.filter(F.col("error_message").isNotNull()).select(
        "image_id", "image_path", F.col("error_message").alias("reason")
    )
    return good, review


def review_limit_reached(review: DataFrame, limit: int = S.DEFAULT_REVIEW_LIMIT) -> bool:
    """True once ``limit`` rows wait for review; a limit of 0 never stops."""
    return limit > 0 and review.limit(limit).count() >= limit


def repeated_paths(scans: DataFrame) -> DataFrame:
    """Paths that arrived more than once, with the first arrival.

    Copies collapse on the map side, so a path that makes up a large share of the
    scans does not gather in one task.  The result is written: as a rule it is
    small, and then the scans themselves are not shuffled to drop their copies.
    """
    arrivals = scans.groupBy("image_path").agg(F.min("image_id").alias("first_id"), F.count("*").alias("n"))
    return stage(arrivals.filter("n > 1").select("image_path", "first_id"), "repeated")


def dedupe_images(scans: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """First arrival of each path."""
    repeated = repeated_paths(scans) if repeated is None else repeated
    first = F.col("first_id").isNull() | (F.col("image_id") == F.col("first_id"))
    return scans.join(repeated, "image_path", "left").filter(first).select(*scans.columns)


def duplicate_scans(scans: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """Every later copy of a path that was already taken."""
    repeated = repeated_paths(scans) if repeated is None else repeated
    later = scans.join(repeated, "image_path").filter(F.col("image_id") != F.col("first_id"))
    return later.select("image_id", "image_path")


def distinct_barcodes(scans: DataFrame) -> DataFrame:
    """Raw texts with their fields; an absent text is empty."""
    raw = scans.select(F.coalesce("barcode_data", F.lit("")).alias("raw_data")).distinct()
    return raw.withColumn("parts", text.parse_barcode("raw_data")).select("raw_data", "parts.*")


def build_barcode_dim(scans: DataFrame) -> DataFrame:
    """One row per distinct raw barcode text, numbered in text order."""
    return number_rows(distinct_barcodes(scans), ["raw_data"], "id").select(*S.BARCODE.fieldNames())


def build_image_table(scans: DataFrame, barcodes: DataFrame) -> DataFrame:
    """Image rows with their barcode key.  ``barcodes`` is the written dimension."""
    dpi = F.when(F.col("dpi") > 0, F.col("dpi")).otherwise(300)
    keyed = scans.withColumn("raw_data", F.coalesce("barcode_data", F.lit("")))
    codes = barcodes.select("raw_data", F.col("id").alias("barcode_id"))
    return keyed.join(codes, "raw_data", "left").select(
        F.col("image_id").alias("id"),
        "image_path",
        "image_name",
        "counted_at",
        dpi.cast("int").alias("dpi"),
        "page_number",
        "was_rotated",
        "corners_found",
        "warp_dpi",
        measure.round_half_up(F.col("content_width_in") * F.col("warp_dpi")).alias("canonical_width"),
        measure.round_half_up(F.col("content_height_in") * F.col("warp_dpi")).alias("canonical_height"),
        "corner_marks",
        "scribble_flagged",
        "scribble_pixels",
        "scribble_outline_path",
        "barcode_id",
    )


def resolve_dpi(
    scans: DataFrame,
    session_dpi: float,
    paper_width_in: float = 8.5,
    width: str = "width_px",
    metadata: str = "metadata_dpi",
    name: str = "resolved_dpi",
) -> DataFrame:
    """Resolution from metadata, else from the width, kept near the session's value."""
    paper = paper_width_in if paper_width_in > 0 else 8.5
    snapped = measure.snap_dpi(F.col(width) / F.lit(float(paper)))
    guess = snapped
    if session_dpi > 0:
        far = F.abs(snapped - F.lit(float(session_dpi))) / F.lit(float(session_dpi)) > 0.15
        guess = F.when(far, F.lit(float(session_dpi))).otherwise(snapped)
    known = F.col(metadata) > 0
    return scans.withColumn(name, F.when(known, F.col(metadata).cast("double")).otherwise(guess))


# --- layout geometry ---------------------------------------------------------


def indicator_boxes(layouts: DataFrame, warp_dpi: int, image_dpi: int) -> DataFrame:
    """Pixel boxes of every indicator, in the rectified page and in the scan."""

    def canonical(inches: Column) -> Column:
        return measure.round_half_up(inches * F.lit(warp_dpi))

    def on_image(inches: Column) -> Column:
        return measure.round_half_up(inches * F.lit(image_dpi))

    has_box = (F.col("contest_left") > 0) & (F.col("contest_width") > 0)
    right = F.col("contest_left") + F.col("contest_width")
    return layouts.withColumns(
        {
            "abs_left": canonical(F.col("indicator_left") - F.col("content_left")),
            "abs_top": canonical(F.col("indicator_top") - F.col("content_top")),
            "width": F.greatest(F.lit(1), canonical(F.col("indicator_width"))),
            "height": F.greatest(F.lit(1), canonical(F.col("indicator_height"))),
            "image_x": on_image(F.col("indicator_left")),
            "image_y": on_image(F.col("indicator_top")),
            "contest_image_left": F.when(has_box, on_image(F.col("contest_left"))).otherwise(-1),
            "contest_image_right": F.when(has_box, on_image(right)).otherwise(-1),
        }
    )


# --- marks -------------------------------------------------------------------


# The measures that decide whether a box is marked.
JUDGED_BY = ("indicator_style", "dark_pct", "total_pixels", "trimmed_pct", "trimmed_total", "zone_dark")


def _style(box: Callable[[str], Column]) -> Column:
    return F.upper(F.coalesce(box("indicator_style"), F.lit(S.DEFAULT_INDICATOR_STYLE)))


def _judged(box: Callable[[str], Column], dark_pct_min: float) -> tuple[Column, ...]:
    """Whether a box is a presence box, touched, empty, its share, whether trimming rescues it, and ``marked``."""
    presence = _style(box).isin(*PRESENCE_STYLES)
    touched = F.coalesce(box("zone_dark"), F.lit(0)) > 0
    empty = F.coalesce(box("total_pixels"), F.lit(0)) == 0
    pct = F.when(empty, 0.0).otherwise(box("dark_pct"))
    plain = (~empty) & (pct >= dark_pct_min)
    low, high = TRIM_BAND
    rescued = (
        (~presence) & (~plain) & (pct >= low) & (pct < high)
        & (F.coalesce(box("trimmed_total"), F.lit(0)) > 0)
        & (box("trimmed_pct") >= dark_pct_min)
    )
    return presence, touched, empty, pct, rescued, F.coalesce(F.when(presence, touched).otherwise(plain | rescued), F.lit(False))


def is_marked(box: Callable[[str], Column] = F.col, dark_pct_min: float = S.DEFAULT_DARK_PCT_MIN) -> Column:
    """``marked`` of ``classify_marks`` alone, also for a box that is an element of an array."""
    return _judged(box, dark_pct_min)[-1]


def classify_marks(measurements: DataFrame, dark_pct_min: float = S.DEFAULT_DARK_PCT_MIN) -> DataFrame:
    """Adds ``marked`` and settles the statistics that go with it.

    Arrow and connect-dots boxes only ask whether any dark pixel lies in their
    zone.  Other boxes compare their dark share; a borderline box may be decided,
    and then described, by the sample trimmed by one pixel on each side.
    """
    style = _style(F.col)
    arrow, dots = style == "ARROW", style == "CONNECT_DOTS"
    presence, touched, empty, pct, rescued, marked = _judged(F.col, dark_pct_min)
    whole = F.when(touched, F.lit(100.0)).otherwise(F.lit(0.0))
    return measurements.withColumns(
        {
            "marked": marked,
            "dark_pct": F.when(presence, whole).when(rescued, F.col("trimmed_pct")).otherwise(pct),
            "dark_pixels": F.when(arrow, 0)
            .when(dots, touched.cast("int"))
            .when(rescued, F.col("trimmed_dark"))
            .when(empty, 0)
            .otherwise(F.col("dark_pixels")),
            "total_pixels": F.when(arrow, 0)
            .when(rescued, F.col("trimmed_total"))
            .otherwise(F.coalesce("total_pixels", F.lit(0))),
            "mean_intensity": F.when(arrow, 128.0)
            .when(dots, F.when(touched, 0.0).otherwise(255.0))
            .when(rescued, F.col("trimmed_mean"))
            .when(empty, 255.0)
            .otherwise(F.col("mean_intensity")),
        }
    )


def contest_key() -> Column:
    return F.coalesce("contest_id", F.lit(NO_CONTEST_ID).cast("bigint"))


# What a contest's first mark settles, and the part of it that overvotes depend on.
_SETTINGS = ("contest_type", "contest_title", "max_votes", "percent_to_win")
_RULES = ("contest_type", "max_votes")


def contest_ballots(marks: DataFrame, settings: tuple[str, ...] = _SETTINGS, places: bool = False) -> DataFrame:
    """One row per image and contest with what its marks say.

    ``first`` holds the contest's settings as its first mark states them;
    ``choices`` the marked entries with how often each was marked, ``marks`` their sum.  Marks are
    counted per entry before they are gathered, so ``choices`` is bounded by the
    entries printed on the ballot, not by the number of rows.  The settings are
    part of the counting key, which keeps that first and larger aggregate on plain
    numbers.  With ``places``, a choice also lists the ``seq`` of each of its marks.
    """
    marked = F.col("marked")
    entries = (
        marks.withColumns(
            {
                "contest_id": contest_key(),
                "candidate_key": F.coalesce("candidate_id", F.lit(-1)),
                "contest_type": F.coalesce("contest_type", F.lit(S.DEFAULT_CONTEST_TYPE)),
            }
        )
        .groupBy("image_id", "contest_id", "candidate_key", "candidate_name", *settings)
        .agg(
            F.min("seq").alias("first_seq"),
            F.count_if(marked).alias("times"),
            F.min(F.when(marked, F.col("seq"))).alias("seq"),
            *([F.collect_list(F.when(marked, F.col("seq"))).alias("places")] if places else []),
        )
    )
    title = [F.col("contest_title")] if "contest_title" in settings else []
    listed = [F.col("places")] if places else []
    choice = F.struct("seq", "candidate_key", "candidate_name", *title, "times", *listed)
    return entries.groupBy("image_id", "contest_id").agg(
        F.min(F.struct("first_seq", *settings)).alias("first"),
        F.sum("times").alias("marks"),
        F.collect_list(F.when(F.col("times") > 0, choice)).alias("choices"),
    )


def too_many_marked() -> Column:
    """Whether a row of ``contest_ballots`` has more candidates marked than its contest allows."""
    limit = F.when(F.col("first.max_votes") > 0, F.col("first.max_votes")).otherwise(S.DEFAULT_MAX_VOTES)
    distinct = F.size(F.array_distinct(F.transform("choices", lambda c: c.candidate_key)))
    # A contest with a single mark, by far the most, is settled without looking at its list.
    return (F.col("marks") > 1) & F.col("first.contest_type").isin(*SINGLE_MARK_TYPES) & (distinct > limit)


def _doubled_ranks() -> Column:
    """Ranks that more than one mark of the contest names."""
    ranked = F.filter(
        F.transform(
            "choices",
            lambda c: F.struct(text.rank_of(F.coalesce(c.candidate_name, F.lit(""))).alias("rank"), c.times.alias("times")),
        ),
        lambda c: c.rank.isNotNull(),
    )
    totals = F.transform(
        F.array_distinct(F.transform(ranked, lambda c: c.rank)),
        lambda r: F.struct(
            r.alias("rank"),
            F.aggregate(
                F.filter(ranked, lambda c: c.rank == r),
                F.lit(0).cast("bigint"),
                lambda n, c: n + c.times,
            ).alias("times"),
        ),
    )
    doubled = F.transform(F.filter(totals, lambda t: t.times > 1), lambda t: t.rank)
    ranked_contest = (F.col("marks") > 1) & (F.col("first.contest_type") == "RANKED_CHOICE")
    return F.when(ranked_contest, doubled).otherwise(F.lit([]).cast("array<int>"))


def overvotes_fptp(marks: DataFrame) -> DataFrame:
    """Single-mark contests of an image with more candidates marked than allowed."""
    bad = contest_ballots(marks).filter(too_many_marked())
    return bad.select(
        "image_id",
        "contest_id",
        F.col("first.contest_title").alias("contest_title"),
        F.size(F.array_distinct(F.transform("choices", lambda c: c.candidate_key))).cast("bigint").alias("marked_candidates"),
    )


def overvotes_ranked(marks: DataFrame) -> DataFrame:
    """Ranks marked more than once in a ranked contest of an image."""
    ballots = contest_ballots(marks, _RULES).withColumn("bad_ranks", _doubled_ranks())
    return ballots.select("image_id", "contest_id", F.explode("bad_ranks").alias("bad_rank"))


def _counted_per_image(marks: DataFrame) -> DataFrame:
    """Marks with what overvotes depend on, from windows over image, contest and rank.

    The marks move once, on the image id, and are sorted once: the order serves both windows
    and a join on the image id after them.
    """
    marked = F.col("marked")
    # The plain search spares most names the pattern.
    rank = F.when(F.col("candidate_name").contains("(Rank "), text.rank_of("candidate_name"))
    rows = marks.repartition("image_id").withColumns({"_contest": contest_key(), "_rank": rank})
    rows = rows.sortWithinPartitions("image_id", "_contest", "_rank")
    contest = Window.partitionBy("image_id", "_contest")
    kind = F.coalesce("contest_type", F.lit(S.DEFAULT_CONTEST_TYPE)).alias("contest_type")
    return rows.select(
        "*",
        F.min(F.struct("seq", kind, "max_votes")).over(contest).alias("_first"),
        F.size(F.collect_set(F.when(marked, F.coalesce("candidate_id", F.lit(-1)))).over(contest)).alias("_chosen"),
        F.count_if(marked).over(Window.partitionBy("image_id", "_contest", "_rank")).alias("_same_rank"),
    )


def _with_status(rows: DataFrame, copies: Column) -> DataFrame:
    """Adds ``vote_status`` to counted marks; ``copies``: how often the scan of a mark is there."""
    marked = F.col("marked")
    limit = F.when(F.col("_first.max_votes") > 0, F.col("_first.max_votes")).otherwise(S.DEFAULT_MAX_VOTES)
    whole = F.col("_first.contest_type").isin(*SINGLE_MARK_TYPES) & (F.col("_chosen") > limit)
    doubled = (F.col("_first.contest_type") == "RANKED_CHOICE") & (F.col("_rank") > 0) & (F.col("_same_rank") * copies > 1)
    over = whole | F.coalesce(doubled, F.lit(False))
    status = F.when(marked & over, "OVERVOTED").when(marked, "VOTED").otherwise("UNMARKED")
    return rows.withColumn("vote_status", status).drop("_contest", "_rank", "_first", "_chosen", "_same_rank")


def assign_vote_status(marks: DataFrame) -> DataFrame:
    """Adds ``vote_status``; an unmarked box stays UNMARKED whatever the contest."""
    return _with_status(_counted_per_image(marks), F.lit(1))


# --- dimensions and facts ----------------------------------------------------


def _named(marks: DataFrame) -> DataFrame:
    return marks.withColumns(
        {
            "contest_title": F.coalesce("contest_title", F.lit(S.UNKNOWN)),
            "contest_type": F.coalesce("contest_type", F.lit(S.DEFAULT_CONTEST_TYPE)),
            "candidate_name": F.coalesce("candidate_name", F.lit(S.UNKNOWN)),
        }
    )


def dimension_variants(marks: DataFrame) -> DataFrame:
    """Every distinct way a candidate's marks describe it and its contest.

    One pass over the marks serves both dimensions.  The result is as small as the
    ballot design and is written.
    """
    seen = (
        _named(marks)
        .groupBy("contest_title", "contest_type", "candidate_name", "max_votes", "percent_to_win",
                 F.col("candidate_id").alias("ballot_candidate_id"), F.coalesce("write_in", F.lit(False)).alias("write_in"))
        .agg(F.min("image_id").alias("first_image"))
    )
    return stage(seen, "variants")


def _first_described(variants: DataFrame, marks: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """``values`` of the first mark with each key.

    Where all marks of a key agree, any of them will do.  Where they differ, the
    first mark lies on the earliest image of that key, and only the marks of those
    images are looked at.
    """
    said = F.struct(*values)
    described = variants.groupBy(*keys).agg(
        F.min("first_image").alias("image_id"), F.min(said).alias("first"), F.max(said).alias("other")
    )
    agree = F.col("first").eqNullSafe(F.col("other"))
    agreed = described.filter(agree).select(*keys, "first")
    disputed = stage(described.filter(~agree).select(*keys, "image_id"), "disputed")
    if not disputed.isEmpty():
        rows = _named(marks).withColumn("ballot_candidate_id", F.col("candidate_id")).withColumn(
            "write_in", F.coalesce("write_in", F.lit(False))
        )
        settled = rows.join(disputed, [*keys, "image_id"]).groupBy(*keys).agg(
            F.min_by(F.struct(*values), "seq").alias("first")
        )
        agreed = agreed.unionByName(settled)
    return agreed.select(*keys, *[F.col(f"first.{v}").alias(v) for v in values])


def described_contests(variants: DataFrame, marks: DataFrame) -> DataFrame:
    """Contests by title and type, with the settings of the first mark seen."""
    return _first_described(variants, marks, ["contest_title", "contest_type"], ["max_votes", "percent_to_win"])


def described_candidates(variants: DataFrame, marks: DataFrame, contests: DataFrame) -> DataFrame:
    """Candidates by contest and name, with the ballot id and flag first seen."""
    keys = ["contest_title", "contest_type"]
    values = ["ballot_candidate_id", "write_in"]
    names = _first_described(variants, marks, [*keys, "candidate_name"], values)
    known = contests.select(F.col("id").alias("contest_id"), *keys)
    return names.join(known, keys).select("contest_id", "candidate_name", *values)


def build_contest_dim(marks: DataFrame, variants: DataFrame | None = None) -> DataFrame:
    """The contests, numbered by title and type."""
    variants = dimension_variants(marks) if variants is None else variants
    contests = described_contests(variants, marks)
    return number_rows(contests, ["contest_title", "contest_type"], "id").select(*S.CONTEST.fieldNames())


def build_candidate_dim(marks: DataFrame, contests: DataFrame, variants: DataFrame | None = None) -> DataFrame:
    """The candidates, numbered by contest and name."""
    variants = dimension_variants(marks) if variants is None else variants
    candidates = described_candidates(variants, marks, contests)
    return number_rows(candidates, ["contest_id", "candidate_name"], "id").select(*S.CANDIDATE.fieldNames())


def settled_marks(marks: DataFrame, images: DataFrame) -> DataFrame:
    """Marks of kept images with barcode key and vote status, still under their own names.

    Overvotes are settled where the marks lie by image, and the marks meet their image there:
    the wide marks are read once, moved once and sorted once.
    """
    image = Window.partitionBy("image_id")
    keys = images.select(F.col("id").alias("image_id"), "barcode_id").withColumn("_copies", F.count("*").over(image))
    settled = _with_status(_counted_per_image(_named(marks)).join(keys, "image_id"), F.col("_copies"))
    return settled.select(
        "image_id", "seq", "contest_title", "contest_type", "candidate_name", "max_votes", "percent_to_win", "candidate_id",
        "write_in", "barcode_id", *_MEASURED, "vote_status")


_MEASURED = ("abs_left", "abs_top", "width", "height", "warp_dpi", "image_x", "image_y", "threshold", "dark_pct",
             "dark_pixels", "total_pixels", "mean_intensity")


def key_facts(settled: DataFrame, contests: DataFrame, candidates: DataFrame) -> DataFrame:
    """Settled marks under the keys of the written dimensions."""
    co = contests.select(F.col("id").alias("contest_id"), "contest_title", "contest_type")
    ca = candidates.select(F.col("id").alias("candidate_id_fk"), "contest_id", "candidate_name")
    renamed = {"image_id": "ballot_image_id", "width": "indicator_width", "height": "indicator_height"}
    return (
        settled.join(co, ["contest_title", "contest_type"])
        .join(ca, ["contest_id", "candidate_name"])
        .withColumnsRenamed(renamed)
        .select("ballot_image_id", "seq", "contest_id", "candidate_id_fk", "barcode_id",
                *[renamed.get(c, c) for c in _MEASURED], "vote_status")
    )


def build_vote_fact(marks: DataFrame, images: DataFrame, contests: DataFrame, candidates: DataFrame) -> DataFrame:
    """One fact per indicator of a kept image."""
    return key_facts(settled_marks(marks, images), contests, candidates)


def rejected_scans(scans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids of the scans that do not count (review and later copies), and the repeated paths.

    Both are written: they are few as a rule, and then Spark drops their rows without
    a shuffle.
    """
    good, review = split_review(scans)
    repeated = repeated_paths(good)
    rejected = review.select("image_id").unionByName(duplicate_scans(good, repeated).select("image_id"))
    return stage(rejected, "rejected"), repeated


def counted_marks(marks: DataFrame, scans: DataFrame) -> DataFrame:
    """Marks of the scans that count."""
    rejected, _ = rejected_scans(scans)
    return marks.join(rejected, "image_id", "left_anti")


def build_star(scans: DataFrame, measurements: DataFrame,
               dark_pct_min: float = S.DEFAULT_DARK_PCT_MIN) -> Star:
    """All five results tables.

    The measurements are read once: settled marks are written under their own names, and
    both dimensions and the facts come from those.  Images and facts stay lazy.
    """
    rejected, repeated = rejected_scans(scans)
    marks = classify_marks(measurements, dark_pct_min)
    good, _ = split_review(scans)
    kept = dedupe_images(good, repeated)
    barcodes = build_barcode_dim(kept)
    images = build_image_table(kept, barcodes)
    # Rejected ids leave on the side of the images, so that the marks need no join of their own for it.
    counted = images.join(rejected, images["id"] == rejected["image_id"], "left_anti")
    settled = stage(settled_marks(marks, counted), "settled")
    variants = dimension_variants(settled)
    contests = build_contest_dim(settled, variants)
    candidates = build_candidate_dim(settled, contests, variants)
    return Star(barcodes, images, contests, candidates, key_facts(settled, contests, candidates))
