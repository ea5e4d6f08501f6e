"""Relational questions of ballot design: which contests go on which ballot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import measure, text

# Fixed values.
MAX_RANK_BOXES = 5
MEASURE_OPTIONS = (("Yes", 1), ("No", 2))


# --- contests per precinct ---------------------------------------------------


def contest_sources(regions: DataFrame, members: DataFrame, contest_regions: DataFrame) -> DataFrame:
    """(precinct, source region, contest): assigned directly or through a group."""
    precincts = regions.filter("region_type = 'SINGLE_PRECINCT'").select(F.col("region_id").alias("precinct_id"))
    direct = contest_regions.select(
        F.col("region_id").alias("precinct_id"), F.col("region_id").alias("source_id"), "contest_id"
    ).join(precincts, "precinct_id", "left_semi")
    groups = members.select(F.col("group_id").alias("source_id"), F.col("member_id").alias("precinct_id"))
    inherited = (
        contest_regions.withColumnRenamed("region_id", "source_id")
        .join(groups.join(precincts, "precinct_id", "left_semi"), "source_id")
        .select("precinct_id", "source_id", "contest_id")
    )
    return direct.unionByName(inherited)


def resolve_contests(regions: DataFrame, members: DataFrame, contests: DataFrame, contest_regions: DataFrame) -> DataFrame:
    """Contests of every precinct and election, once each, in display order."""
    pairs = contest_sources(regions, members, contest_regions).select("precinct_id", "contest_id").distinct()
    return (
        pairs.join(contests.select("contest_id", "election_id", "title", "display_order"), "contest_id")
        .select("precinct_id", "election_id", "display_order", "contest_id", "title")
        .orderBy("precinct_id", "election_id", "display_order", "contest_id")
    )


def contests_of_precinct(regions: DataFrame, members: DataFrame, contests: DataFrame, contest_regions: DataFrame,
                         precinct_id: int, election_id: int) -> DataFrame:
    """The same for one ballot; a group of precincts is not a place to vote."""
    kinds = [r["region_type"] for r in regions.filter(F.col("region_id") == precinct_id).select("region_type").take(1)]
    if not kinds:
        raise ValueError(f"region not found: {precinct_id}")
    if kinds[0] != "SINGLE_PRECINCT":
        raise ValueError(f"region {precinct_id} is a group; a ballot needs a single precinct")
    wanted = (F.col("precinct_id") == precinct_id) & (F.col("election_id") == election_id)
    return resolve_contests(regions, members, contests, contest_regions).filter(wanted)


def explain_contests(regions: DataFrame, members: DataFrame, contests: DataFrame, contest_regions: DataFrame) -> DataFrame:
    """Which region brings which contest to a precinct, one row per contribution."""
    sources = contest_sources(regions, members, contest_regions).distinct()
    names = regions.select(F.col("region_id").alias("source_id"), F.col("name").alias("source_name"))
    return (
        sources.join(names, "source_id")
        .join(contests.select("contest_id", "election_id", "display_order"), "contest_id")
        .select("precinct_id", "election_id", "source_id", "source_name", "contest_id", "display_order")
    )


# --- combinations ------------------------------------------------------------

_COMBINATION_KEY = ("region_id", "party_id", "ballot_type_id", "election_id")


def repeated_combinations(combinations: DataFrame) -> DataFrame:
    """Keys used more than once; an absent party equals an absent party."""
    return (
        combinations.groupBy(*_COMBINATION_KEY)
        .agg(F.count("*").alias("copies"), F.min("combination_id").alias("first_id"))
        .filter("copies > 1")
    )


def check_combinations(combinations: DataFrame, regions: DataFrame) -> DataFrame:
    """Problems found: a region that is no single precinct, or a repeated key."""
    single = regions.filter("region_type = 'SINGLE_PRECINCT'").select("region_id")
    misplaced = combinations.join(single, "region_id", "left_anti").select(
        F.lit("not_single_precinct").alias("problem"), F.col("combination_id"), *_COMBINATION_KEY,
        F.lit(1).cast("bigint").alias("copies"),
    )
    repeated = repeated_combinations(combinations).select(
        F.lit("repeated").alias("problem"), F.col("first_id").alias("combination_id"), *_COMBINATION_KEY, "copies"
    )
    return misplaced.unionByName(repeated)


def encode_barcode(combinations: DataFrame, regions: DataFrame, page: int | Column = 1) -> DataFrame:
    """Barcode text of each combination's page."""
    places = regions.select("region_id", "jurisdiction_id")
    number = page if isinstance(page, Column) else F.lit(page)
    code = text.encode_barcode(
        F.col("jurisdiction_id"), F.col("region_id"), F.coalesce("party_id", F.lit(0).cast("bigint")),
        F.col("ballot_type_id"), F.col("election_id"), number,
    )
    return combinations.join(places, "region_id").select("combination_id", code.alias("barcode"))


# --- text --------------------------------------------------------------------


def _localized(base: DataFrame, translations: DataFrame, key: str, lang: str,
               texts: Sequence[str], optional: Sequence[str]) -> DataFrame:
    wanted = translations.filter(F.col("lang") == lang).select(
        key, *[F.col(c).alias(f"tr_{c}") for c in (*texts, *optional)]
    )
    joined = base.join(wanted, key, "left")
    given = {c: F.when(~text.is_blank(f"tr_{c}"), F.col(f"tr_{c}")) for c in (*texts, *optional)}
    return joined.select(
        *[c for c in base.columns if c not in (*texts, *optional)],
        *[F.coalesce(given[c], F.col(c)).alias(c) for c in texts],
        *[given[c].alias(c) for c in optional],
    )


def localize_contests(contests: DataFrame, translations: DataFrame, lang: str) -> DataFrame:
    """Contest texts in ``lang``; missing or blank ones fall back to the base text,
    instructions to null."""
    return _localized(contests, translations, "contest_id", lang,
                      ("title", "preamble", "postamble", "grouping_label"), ("instructions",))


def localize_candidates(candidates: DataFrame, translations: DataFrame, lang: str) -> DataFrame:
    return _localized(candidates, translations, "candidate_id", lang, ("name", "explanatory_text"), ())


def name_list(contests: DataFrame, candidates: DataFrame, election_id: int | None = None) -> DataFrame:
    """Contest and candidate names of an election (or all); contests without candidates stay."""
    chosen = contests if election_id is None else contests.filter(F.col("election_id") == election_id)
    return (
        chosen.select("election_id", "contest_id", F.col("title").alias("contest"))
        .join(candidates.select("contest_id", "candidate_id", F.col("name").alias("candidate")), "contest_id", "left")
        .select("election_id", "contest_id", "contest", "candidate_id", "candidate")
        .orderBy("election_id", "contest_id", "candidate_id")
    )


# --- candidates --------------------------------------------------------------


def fill_measure_options(contests: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates, plus Yes and No for measures that have none."""
    bare = contests.filter("voting_method = 'MEASURE'").select("contest_id").join(
        candidates.select("contest_id"), "contest_id", "left_anti"
    )
    options = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(o).alias("display_order")) for n, o in MEASURE_OPTIONS])
    added = bare.select("contest_id", F.inline(options))
    return candidates.select("contest_id", "name", "display_order").unionByName(added)


def expand_rank_options(contests: DataFrame, candidates: DataFrame, most_boxes: int = MAX_RANK_BOXES) -> DataFrame:
    """One row per candidate and rank box of a ranked contest.

    A contest has as many boxes as it states, else one per candidate, and never more
    than ``most_boxes``, the width of the printed column.
    """
    ranked = contests.filter("voting_method = 'RANKED_CHOICE'").select("contest_id", "max_rank_choices")
    sizes = candidates.groupBy("contest_id").agg(F.count("*").alias("n"))
    boxes = F.when(F.col("max_rank_choices") > 0, F.least(F.col("max_rank_choices"), F.lit(most_boxes))).otherwise(
        F.least(F.col("n"), F.lit(most_boxes))
    )
    limits = ranked.join(sizes, "contest_id").select("contest_id", boxes.cast("int").alias("boxes"))
    return (
        candidates.select("contest_id", "candidate_id", F.col("name").alias("base_name"))
        .join(limits, "contest_id")
        .select("contest_id", "candidate_id", "base_name", F.explode(F.sequence(F.lit(1), "boxes")).alias("rank"))
        .withColumn("name", F.concat("base_name", F.lit(" (Rank "), F.col("rank").cast("string"), F.lit(")")))
        .drop("base_name")
    )


# --- logs and lists ----------------------------------------------------------


def valid_print_logs(logs: DataFrame, combinations: DataFrame) -> DataFrame:
    """Log rows whose combination still exists."""
    return logs.join(combinations.select("combination_id"), "combination_id", "left_semi")


def print_logs_by_user(logs: DataFrame, user_id: int) -> DataFrame:
    return logs.filter(F.col("user_id") == user_id).orderBy(F.desc("printed_at"))


def print_logs_by_combination(logs: DataFrame, combination_id: int) -> DataFrame:
    return logs.filter(F.col("combination_id") == combination_id).orderBy(F.desc("printed_at"))


def lookup(table: DataFrame, order_by: Sequence[str | Column], **equals: object) -> DataFrame:
    """Ordered list of the rows with the given values."""
    rows = table
    for column, value in equals.items():
        rows = rows.filter(F.col(column) == F.lit(value))
    return rows.orderBy(*order_by)


def parties_by_name(parties: DataFrame) -> DataFrame:
    return parties.orderBy("name")


def ballot_types_by_name(types: DataFrame) -> DataFrame:
    return types.orderBy("name")


def elections_newest_first(elections: DataFrame) -> DataFrame:
    return elections.orderBy(F.desc("election_date"))


def regions_of_jurisdiction(regions: DataFrame, jurisdiction_id: int) -> DataFrame:
    return lookup(regions, ["name"], jurisdiction_id=jurisdiction_id)


def groups_containing(regions: DataFrame, members: DataFrame, precinct_id: int) -> DataFrame:
    """The groups that have a precinct among their members."""
    holding = members.filter(F.col("member_id") == precinct_id).select(F.col("group_id").alias("region_id")).distinct()
    return regions.join(holding, "region_id", "left_semi").orderBy("name")


# --- simplification ----------------------------------------------------------


def collapse_regions(old_ids: DataFrame, new_id: int, combinations: DataFrame, contest_regions: DataFrame,
                     members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Replace the regions in ``old_ids`` (column ``region_id``) by one.

    Returns the combinations, contest assignments and group memberships afterwards,
    and the combination keys that now collide.  A contest that had any old region
    keeps only the new one.
    """
    old = old_ids.select("region_id").distinct()
    flagged = old.withColumn("is_old", F.lit(True))
    moved = combinations.join(flagged, "region_id", "left").withColumn(
        "region_id", F.when(F.col("is_old"), F.lit(new_id)).otherwise(F.col("region_id"))
    ).select(*combinations.columns)
    touched = contest_regions.join(old, "region_id", "left_semi").select("contest_id").distinct()
    assigned = (
        contest_regions.join(touched, "contest_id", "left_anti").select("contest_id", "region_id")
        .unionByName(touched.withColumn("region_id", F.lit(new_id)))
    )
    remaining = (
        members.join(old.withColumnRenamed("region_id", "group_id"), "group_id", "left_anti")
        .join(old.withColumnRenamed("region_id", "member_id"), "member_id", "left_anti")
        .select(*members.columns)
    )
    return moved, assigned, remaining, repeated_combinations(moved)


def collapse_parties(old_ids: DataFrame, new_id: int, combinations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace the parties in ``old_ids`` (column ``party_id``) by one; combinations
    without a party stay so.  Returns them and the keys that now collide."""
    flagged = old_ids.select("party_id").distinct().withColumn("is_old", F.lit(True))
    moved = combinations.join(flagged, "party_id", "left").withColumn(
        "party_id", F.when(F.col("is_old"), F.lit(new_id)).otherwise(F.col("party_id"))
    ).select(*combinations.columns)
    return moved, repeated_combinations(moved)


# --- layout report -----------------------------------------------------------

_BOX = ("offsetFromLeft", "offsetFromTop", "width", "height")


def _box(prefix: str, unit: str) -> Column:
    parts = ("left", "top", "width", "height")
    return F.struct(*[measure.in_unit(F.col(f"{prefix}_{p}"), unit).alias(n) for p, n in zip(parts, _BOX)])


def layout_report(positions: DataFrame, unit: str = "inches", page: int | None = None) -> DataFrame:
    """Box report, one row per combination and page, contests and candidates nested.

    A row is one printed page, which bounds what is gathered: the boxes on a sheet.
    Lengths are text with four decimals in the chosen unit.
    """
    rows = positions if page is None else positions.filter(F.col("page_number") == page)
    candidate = F.struct(
        "candidate_pos",
        F.col("candidate_id").alias("id"),
        F.col("candidate_name").alias("name"),
        F.col("write_in").alias("writeIn"),
        F.struct(*[measure.in_unit(F.col(f"indicator_{p}"), unit).alias(n)
                   for p, n in zip(("left", "top", "width", "height"), _BOX)],
                 F.col("indicator_style").alias("indicatorStyle")).alias("indicator"),
    )
    contest_columns = ("contest_pos", "contest_id", "contest_title", "contest_type", "max_votes", "percent_to_win",
                       "contest_left", "contest_top", "contest_width", "contest_height")
    page_columns = ("combination_id", "page_number", "content_left", "content_top", "content_width", "content_height")
    by_contest = rows.groupBy(*page_columns, *contest_columns).agg(
        F.transform(F.array_sort(F.collect_list(candidate)), lambda c: c.dropFields("candidate_pos")).alias("candidates")
    )
    contest = F.struct(
        "contest_pos",
        F.col("contest_id").alias("id"),
        F.col("contest_title").alias("title"),
        F.col("contest_type").alias("contestType"),
        F.col("max_votes").alias("maxVotes"),
        F.col("percent_to_win").alias("percentToWin"),
        _box("contest", unit).alias("boundingBox"),
        "candidates",
    )
    by_page = by_contest.groupBy(*page_columns).agg(
        F.transform(F.array_sort(F.collect_list(contest)), lambda c: c.dropFields("contest_pos")).alias("contests")
    )
    return by_page.select(
        F.col("combination_id").alias("combinationId"),
        F.lit(unit.lower()).alias("unit"),
        F.col("page_number").alias("side_number"),
        _box("content", unit).alias("ballotContentArea"),
        "contests",
    )


def layout_documents(report: DataFrame) -> DataFrame:
    """One document per combination with its pages as sides, bounded by a ballot's sheets."""
    side = F.struct("side_number", "ballotContentArea", "contests")
    return report.groupBy("combinationId", "unit").agg(F.array_sort(F.collect_list(side)).alias("sides"))


def write_layout_json(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A page per line, or a document per file where ``report`` has ``layout_documents``."""
    report.write.mode(mode).partitionBy("combinationId").json(path)


def write_layout_xml(report: DataFrame, path: str, unit: str = "inches", mode: str = "overwrite") -> None:
    """The XML form: ids and settings as attributes, boxes as elements."""
    contests = F.transform(
        "contests",
        lambda c: F.struct(
            c["id"].alias("_id"), c["title"].alias("_title"), c["contestType"].alias("_contestType"),
            c["maxVotes"].alias("_maxVotes"), c["percentToWin"].alias("_percentToWin"), c["boundingBox"].alias("boundingBox"),
            F.struct(
                F.transform(
                    c["candidates"],
                    lambda k: F.struct(
                        k["id"].alias("_id"), k["name"].alias("_name"), k["writeIn"].alias("_writeIn"),
                        k["indicator"].dropFields("indicatorStyle").alias("indicator"),
                    ),
                ).alias("candidate")
            ).alias("candidates"),
        ),
    )
    sides = report.select(
        "combinationId", F.col("side_number").alias("_number"), "ballotContentArea",
        F.struct(contests.alias("contest")).alias("contests"),
    )
    (sides.write.mode(mode).partitionBy("combinationId").format("xml")
     .option("rootTag", f'ballotBoundingBoxReport unit="{unit.lower()}"').option("rowTag", "side").save(path))
