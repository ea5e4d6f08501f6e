"""Summaries taken straight from classified marks, before anything is stored.

Only single-mark contests are checked for overvotes here; the choices of an
overvoted contest are emptied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark import schema as S
from tallyspark.functions import text
from tallyspark.operators import ingest
from tallyspark.session import number_within

# Write-in boxes darker than this are kept for a look even when unmarked.
WRITE_IN_DARK_PCT = 2.0


def valid_choices(marks: DataFrame, scans: DataFrame) -> DataFrame:
    """One row per image and contest: settings, overvote flag, and the valid choices.

    ``choices`` lists every marked name once, in the order of its first mark, with
    the number of marks; ``names`` has a name for every mark, in the order of the marks.
    """
    per_contest = ingest.contest_ballots(marks, places=True).withColumn("overvoted", ingest.too_many_marked())
    named = F.transform(
        F.array_sort("choices"),
        lambda c: F.struct(F.coalesce(c.candidate_name, F.lit(S.UNKNOWN)).alias("name"), c.times.alias("times"), c.places.alias("places")),
    )
    none = F.lit([]).cast("array<struct<name:string,times:bigint,places:array<bigint>>>")
    first = F.col("first")
    settled = per_contest.select(
        "image_id",
        "contest_id",
        first["contest_title"].alias("contest_title"),
        first["contest_type"].alias("contest_type"),
        F.when(first["max_votes"] > 0, first["max_votes"]).otherwise(S.DEFAULT_MAX_VOTES).alias("max_votes"),
        F.when(first["percent_to_win"] > 0, first["percent_to_win"])
        .otherwise(S.DEFAULT_PERCENT_TO_WIN).alias("percent_to_win"),
        "overvoted",
        F.when(F.col("overvoted"), none).otherwise(named).alias("choices"),
    )
    placed = F.flatten(F.transform(
        "choices", lambda c: F.transform(c["places"], lambda at: F.struct(at.alias("at"), c["name"].alias("name")))))
    names = F.transform(F.array_sort(placed), lambda x: x["name"])
    plain = F.transform("choices", lambda c: F.struct(c["name"].alias("name"), c["times"].alias("times")))
    return settled.join(voters(scans, "image_name"), "image_id").withColumns({"names": names, "choices": plain})


def voters(scans: DataFrame, *columns: str) -> DataFrame:
    """Party and region of each image, from its barcode."""
    parts = F.split(F.coalesce("barcode_data", F.lit("")), r"\|", -1)
    return scans.select(
        "image_id", *columns,
        F.coalesce(F.get(parts, 2), F.lit("0")).alias("party_id"),
        F.coalesce(F.get(parts, 1), F.lit("0")).alias("region_id"),
    )


def _tally(choices: DataFrame, *keys: str) -> DataFrame:
    """Valid votes per key and candidate; repeats are added up, not unrolled."""
    return (
        choices.select(*keys, F.explode("choices").alias("choice"))
        .groupBy(*keys, F.col("choice.name").alias("candidate"))
        .agg(F.sum("choice.times").alias("votes"))
    )


def summary_totals(choices: DataFrame) -> DataFrame:
    return _tally(choices, "contest_id", "contest_title")


def overvoted_ballot_counts(choices: DataFrame) -> DataFrame:
    return choices.groupBy("contest_id", "contest_title").agg(
        F.count_if("overvoted").alias("overvoted_ballots")
    )


def summary_by_party(choices: DataFrame) -> DataFrame:
    return _tally(choices, "contest_id", "contest_title", "party_id")


def summary_by_region(choices: DataFrame) -> DataFrame:
    return _tally(choices, "contest_id", "contest_title", "region_id")


def _suspected(marks: DataFrame) -> DataFrame:
    """Marks of the images on which a single-mark contest may be overvoted.

    A contest allows one candidate at least, so two different ones must be marked in it.  That
    is told from numbers per image and contest; what needs the marks' texts sees those images only.
    """
    key = F.when(F.col("marked"), F.coalesce("candidate_id", F.lit(-1)))
    single = F.coalesce("contest_type", F.lit(S.DEFAULT_CONTEST_TYPE)).isin(*ingest.SINGLE_MARK_TYPES)
    several = marks.groupBy("image_id", ingest.contest_key().alias("contest_id")).agg(
        F.min(key).alias("low"), F.max(key).alias("high"), F.max(single.cast("int")).alias("single")
    ).filter("low < high AND single = 1")
    images = several.select(F.col("image_id").alias("_image")).distinct()
    return marks.join(images, F.col("image_id").eqNullSafe(F.col("_image")), "left_semi")


def overvoted_choices(marks: DataFrame) -> DataFrame:
    """Marks that were set aside because their contest was overvoted on that ballot.

    Contests are told apart by title here, so the choices of an image are looked at
    together; they are bounded by what is printed on the sheet.
    """
    per_image = ingest.contest_ballots(_suspected(marks)).filter("marks > 0").groupBy("image_id").agg(
        F.collect_set(F.when(ingest.too_many_marked(), F.col("first.contest_title"))).alias("titles"),
        F.flatten(F.collect_list("choices")).alias("choices"),
    )
    return (
        per_image.filter(F.size("titles") > 0)
        .select("titles", F.explode("choices").alias("choice"))
        .filter(F.array_contains("titles", F.col("choice.contest_title")))
        .groupBy(F.col("choice.contest_title").alias("contest_title"), F.col("choice.candidate_name").alias("candidate"))
        .agg(F.sum("choice.times").alias("overvotes"))
    )


def session_tallies(marks: DataFrame) -> DataFrame:
    """Running tally per title and candidate: valid votes, boxes looked at, overvotes.

    Two narrow aggregates of the marks meet at candidate grain, so the wide marks
    are never joined.
    """
    seen = marks.groupBy("contest_title", F.col("candidate_name").alias("candidate")).agg(
        F.count_if("marked").alias("marked"), F.count("*").alias("ballots_checked")
    )
    moved = F.coalesce("overvotes", F.lit(0))
    return seen.join(overvoted_choices(marks), ["contest_title", "candidate"], "left").select(
        "contest_title", "candidate",
        F.greatest(F.col("marked") - moved, F.lit(0)).alias("votes"),
        "ballots_checked",
        moved.alias("overvotes"),
    )


def image_detail(choices: DataFrame) -> DataFrame:
    """One line of text per image and contest; nothing where nothing was chosen."""
    voted = F.concat(
        "image_name", F.lit(" (party="), "party_id", F.lit(" region="), "region_id", F.lit("): "),
        F.array_join("names", ", "),
    )
    line = F.when(F.col("overvoted"), F.concat("image_name", F.lit(" [OVERVOTE]"))).when(F.size("names") > 0, voted)
    return choices.select("contest_id", "image_id", line.alias("line")).filter(F.col("line").isNotNull())


# The sections of the summary, by what was counted and what it was grouped by.
_SECTIONS = {
    ("valid", ""): "totalVotes", ("valid", "party"): "byParty", ("valid", "region"): "byRegion",
    ("aside", ""): "overvotedChoices", ("ballots", ""): "overvotedBallots",
}


def vote_summary(marks: DataFrame, scans: DataFrame) -> DataFrame:
    """The whole summary in long form, one row per section, key and candidate.

    ``marks`` are classified marks; those of images that ``scans`` does not have are left
    out.  Marks and scans are each read once: marks move to their image, everything about an
    image is settled there, and counts at the finest grain are then added up by grouping sets.

    A document per contest would gather a contest's ballots in one row; in long
    form it stays a table that can be written partitioned by contest.  The
    per-image lines are ``image_detail``.
    """
    # Every later grouping has the image in its key, so this is the only move of the marks.
    moved = marks.select(
        "image_id", "contest_id", "contest_title", "contest_type", "max_votes", "percent_to_win", "candidate_id", "candidate_name",
        "seq", "marked",
    ).repartition("image_id")
    ballots = ingest.contest_ballots(moved).join(voters(scans), "image_id").withColumn("overvoted", ingest.too_many_marked())
    title = F.col("first.contest_title")
    # Marks are set aside by title: what a second contest of the same title on the sheet has goes as well.
    bad = F.collect_set(F.when(F.col("overvoted") & (F.col("marks") > 0), title)).over(Window.partitionBy("image_id"))
    settled = ballots.withColumn("bad_titles", bad)

    def counted(kind: str, contest: Column, title: Column, candidate: Column, votes: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), contest.cast("bigint").alias("contest_id"), title.alias("contest_title"),
                        candidate.alias("candidate"), votes.cast("bigint").alias("votes"))

    none = F.lit(None)
    valid = F.transform("choices", lambda c: counted(
        "valid", F.col("contest_id"), title, F.coalesce(c.candidate_name, F.lit(S.UNKNOWN)), c.times))
    aside = F.transform(F.filter("choices", lambda c: F.array_contains("bad_titles", c.contest_title)), lambda c: counted(
        "aside", none, c.contest_title, c.candidate_name, c.times))
    ballot = F.array(counted("ballots", F.col("contest_id"), title, F.lit(""), F.col("overvoted").cast("int")))
    rows = settled.select(
        F.col("party_id").alias("party"), F.col("region_id").alias("region"),
        F.explode(F.concat(F.when(F.col("overvoted"), F.slice(valid, 1, 0)).otherwise(valid), aside, ballot)).alias("row"),
    ).select("row.*", "party", "region")
    key = ["kind", "contest_id", "contest_title", "candidate"]
    finest = rows.groupBy(*key, "party", "region").agg(F.sum("votes").alias("votes"))
    sets = [[F.col(c) for c in (*key, *more)] for more in ((), ("party",), ("region",))]
    whole = finest.groupingSets(sets, *key, "party", "region").agg(
        F.sum("votes").alias("votes"), F.grouping("party").alias("over_parties"), F.grouping("region").alias("over_regions"))
    by = F.when(F.col("over_parties") == 0, "party").when(F.col("over_regions") == 0, "region").otherwise("")
    section = F.lit(None).cast("string")
    for (kind, grouped), name in _SECTIONS.items():
        section = F.when((F.col("kind") == kind) & (by == grouped), name).otherwise(section)
    key_of = F.when(by == "party", F.col("party")).when(by == "region", F.col("region")).otherwise("")
    return whole.select("contest_title", section.alias("section"), key_of.alias("section_key"), "candidate", "votes").filter(
        F.col("section").isNotNull())


def write_vote_summary(summary: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, one folder per contest."""
    summary.write.mode(mode).partitionBy("contest_title").json(path)


def write_in_crops(marks: DataFrame, scans: DataFrame) -> DataFrame:
    """Write-in boxes worth a look, with the name of the crop to be cut.

    A number is added only where the contest has several on the ballot, and
    ``_unvoted`` where the box itself was not marked.
    """
    active = marks.filter(F.col("write_in") & (F.col("marked") | (F.col("dark_pct") > WRITE_IN_DARK_PCT))).select(
        "image_id", ingest.contest_key().alias("contest_id"), "seq", "candidate_name", "marked", "dark_pct",
        "image_x", "image_y",
    )
    numbered = number_within(active, ["image_id", "contest_id"], ["seq", "dark_pct"], "k")
    several = numbered.groupBy("image_id", "contest_id").agg(F.count("*").alias("n"))
    dotted = F.col("image_name").contains(".")
    stem = F.when(dotted, F.regexp_replace("image_name", r"\.[^.]*$", "")).otherwise(F.col("image_name"))
    extension = F.when(dotted, F.lower(F.regexp_extract("image_name", r"\.([^.]*)$", 1))).otherwise("png")
    crop = F.concat(
        F.lit("writein_"), stem, F.lit("_"), F.col("contest_id").cast("string"),
        F.when(F.col("n") > 1, F.concat(F.lit("_"), F.col("k").cast("string"))).otherwise(""),
        F.when(F.col("marked"), "").otherwise("_unvoted"),
        F.lit("."), extension,
    )
    return (
        numbered.join(several, ["image_id", "contest_id"])
        .join(scans.select("image_id", "image_name", "image_path"), "image_id")
        .select("image_id", "contest_id", "candidate_name", "image_path", "marked", "dark_pct",
                "image_x", "image_y", crop.alias("crop_name"))
    )
