"""An election seen through the supplied tables.

Every column is a deterministic function of the input Parquet, so the same rows
can be stated in SQL.  See FIXTURES.md, section C.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark import schema as S
from tallyspark.functions import text
from tallyspark.operators import ingest
from tallyspark.operators.ingest import Star
from tallyspark.operators.merge import Stations
from tallyspark.session import discarding, new_folder, stage
from tallyspark.sources.results import load_results, load_stations, save_results, save_station

# The six contests of the view, by index.
CONTESTS = (
    ("Mayor", "PLURALITY", 1, 50.0),
    ("Council", "PLURALITY", 2, 50.0),
    ("Measure", "MEASURE", 1, 60.0),
    ("Assessor", "RANKED_CHOICE", 1, 50.0),
    ("Clerk", "RANKED_CHOICE", 1, 50.0),
    ("Board", "APPROVAL", 99, 50.0),
)
LINE_SHIFT, PART_SHIFT = 60, 27


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _per_contest(index: Column, position: int) -> Column:
    return F.get(F.array(*[F.lit(c[position]) for c in CONTESTS]), index)


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan per order; two pages make a physical ballot."""
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate").withColumns(
        {
            "ballot_no": F.expr("o_orderkey div 2"),
            "page_number": (key % 2 + 1).cast("int"),
            "n_nationkey": F.expr("(o_orderkey div 2) % 25").cast("int"),
        }
    )
    precincts = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    name = F.concat(F.lit("b"), F.col("ballot_no").cast("string"), F.lit("_c"), F.col("page_number").cast("string"), F.lit(".png"))
    barcode = text.encode_barcode(
        F.col("n_regionkey"), F.col("n_nationkey"), F.col("ballot_no") % 3, F.col("ballot_no") % 2 + 1,
        F.lit(1), F.col("page_number"),
    )
    ink = (F.round("o_totalprice").cast("bigint") % 100).cast("int")
    return orders.join(precincts, "n_nationkey").select(
        key.alias("image_id"),
        "ballot_no",
        F.concat(F.lit("/scans/"), name).alias("image_path"),
        name.alias("image_name"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("counted_at"),
        F.lit(300).alias("dpi"),
        F.lit(200).alias("warp_dpi"),
        "page_number",
        F.lit(False).alias("was_rotated"),
        F.lit(True).alias("corners_found"),
        F.lit(7.5).alias("content_width_in"),
        F.lit(10.0).alias("content_height_in"),
        F.lit(None).cast("string").alias("corner_marks"),
        F.when(key % 97 == 0, S.UNREAD_BARCODE).otherwise(barcode).alias("barcode_data"),
        F.when(key % 101 == 0, "Corner detection failed").alias("error_message"),
        (ink >= 90).alias("scribble_flagged"),
        ink.alias("scribble_pixels"),
        F.lit(None).cast("string").alias("scribble_outline_path"),
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One box per line item: its image, its place there, and what its measures follow from."""
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_returnflag", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"
    )
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    index = (flag + F.lit(3) * (F.col("l_orderkey") % 2)).cast("int")
    items = items.withColumn("c", index)
    c, supplier = F.col("c"), F.col("l_suppkey")
    choice = (
        F.when(c == 0, F.least(supplier % 10, F.lit(4)))
        .when(c == 2, F.when(supplier % 10 < 7, 0).otherwise(1))
        .otherwise(supplier % 5)
    )
    # The place of a box on its image: line number, then part, then supplier, in one number.
    seq = (
        F.shiftleft(F.col("l_linenumber").cast("bigint"), LINE_SHIFT)
        + F.shiftleft("l_partkey", PART_SHIFT)
        + F.col("l_suppkey")
    )
    return items.select(
        F.col("l_orderkey").alias("image_id"), seq.alias("seq"), "c", choice.cast("bigint").alias("k"),
        F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"))


def measured(box: Callable[[str], Column]) -> dict[str, Column]:
    """The columns of a measurement, from those of its box."""
    c, k, line = box("c"), box("k"), box("line")
    rank = (line - 1) % 3 + 1
    name = (
        F.when(c == 2, F.when(k == 0, "Yes").otherwise("No"))
        .when(c.isin(3, 4), F.concat(F.lit("Candidate "), k.cast("string"), F.lit(" (Rank "), rank.cast("string"), F.lit(")")))
        .otherwise(F.concat(F.lit("Candidate "), k.cast("string")))
    )
    pct = F.greatest(box("quantity") - 18.0, F.lit(0.0))
    trimmed = pct + line % 4
    left = (line * 10).cast("int")
    top = (k * 10).cast("int")
    return {
        "seq": box("seq"),
        "contest_id": (c + 1).cast("bigint"),
        "contest_title": _per_contest(c, 0),
        "contest_type": _per_contest(c, 1),
        "max_votes": _per_contest(c, 2),
        "percent_to_win": _per_contest(c, 3),
        "candidate_id": k,
        "candidate_name": name,
        "write_in": (c.isin(0, 1) & (k == 3)),
        "indicator_style": F.lit(S.DEFAULT_INDICATOR_STYLE),
        "dark_pct": pct,
        "dark_pixels": pct.cast("int"),
        "total_pixels": F.lit(100),
        "mean_intensity": (255.0 - 2.0 * pct),
        "trimmed_pct": trimmed,
        "trimmed_dark": trimmed.cast("int"),
        "trimmed_total": F.lit(100),
        "trimmed_mean": (255.0 - 2.0 * trimmed),
        "zone_dark": F.lit(None).cast("int"),
        "abs_left": left,
        "abs_top": top,
        "width": F.lit(8),
        "height": F.lit(6),
        "warp_dpi": F.lit(200),
        "image_x": left,
        "image_y": top,
        "threshold": F.lit(S.DEFAULT_DARK_THRESHOLD),
    }


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One measured box per line item."""
    return boxes(spark, sf_dir).select("image_id", *[c.alias(name) for name, c in measured(F.col).items()])


def kept_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.split_review(scans(spark, sf_dir))[0]


_MARKS: dict[tuple[str, str], DataFrame] = {}
_STORED: dict[tuple[str, str], Star] = {}


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified marks of the scans that count.  Only the list of rejected scans is kept."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MARKS:
        classified = ingest.classify_marks(measurements(spark, sf_dir))
        _MARKS[key] = ingest.counted_marks(classified, scans(spark, sf_dir))
    return _MARKS[key]


def results(spark: SparkSession, sf_dir: str) -> Star:
    """The stored star: ingested once per session and folder, then read by every report."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        path = new_folder(spark, "results")
        save_results(ingest.build_star(scans(spark, sf_dir), measurements(spark, sf_dir)), path)
        _STORED[key] = load_results(spark, path)
    return _STORED[key]


# --- the same ballots, badly scanned -----------------------------------------


def rough_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scans with three paths of ten taken by one file, and some barcodes missing."""
    key = F.col("image_id")
    home = F.when((key % 10).isin(3, 4), key - key % 10).otherwise(key)
    return scans(spark, sf_dir).withColumns({
        "image_path": F.concat(F.lit("/scans/r"), home.cast("string"), F.lit(".png")),
        "barcode_data": F.when(key % 89 != 0, F.col("barcode_data")),
    })


def rough_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes with missing contest and candidate ids, and settings that images disagree on."""
    image = F.col("image_id")
    line = F.shiftright("seq", LINE_SHIFT)
    return measurements(spark, sf_dir).withColumns({
        "contest_id": F.when(image % 13 != 0, F.col("contest_id")),
        "max_votes": (F.col("max_votes") + F.when(image % 3 == 0, 1).otherwise(0)).cast("int"),
        "percent_to_win": F.col("percent_to_win") + F.when(image % 5 == 0, 10.0).otherwise(0.0),
        "candidate_id": F.when(line != 6, F.col("candidate_id")),
        "write_in": F.col("write_in") != (image % 19 == 0),
    })


def rough_results(spark: SparkSession, sf_dir: str) -> Star:
    key = (spark.sparkContext.applicationId, f"{sf_dir}#rough")
    if key not in _STORED:
        path = new_folder(spark, "results")
        save_results(ingest.build_star(rough_scans(spark, sf_dir), rough_measurements(spark, sf_dir)), path)
        _STORED[key] = load_results(spark, path)
    return _STORED[key]


def box_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One indicator per part, with inch offsets that are exact binary fractions."""
    size, key = F.col("p_size"), F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("candidate_id"),
        F.lit(0.5).alias("content_left"),
        F.lit(0.25).alias("content_top"),
        (size / 8.0).alias("indicator_left"),
        (F.col("p_retailprice") / 128.0).alias("indicator_top"),
        (key % 9 / 64.0).alias("indicator_width"),
        (size % 5 / 512.0).alias("indicator_height"),
        (key % 4 / 4.0).alias("contest_left"),
        (size % 3 / 2.0).alias("contest_width"),
    )


# --- stations ----------------------------------------------------------------


# The ballots of each station, by their number's remainder.
_BALLOTS_OF = ((0, 1), (1, 2))


def _station(star: Star, facts: DataFrame, number: int) -> Star:
    """The ballots of one station under its own ids.

    Ids are moved by simple arithmetic, so that remapping them is real work.  The
    second station lost one candidate row, whose facts cannot be mapped.
    """
    scale, shift = (1, 1) if number == 0 else (3, 5)

    def local(column: str) -> Column:
        return F.col(column) * scale + shift

    images = star.ballot_image.filter(_counted_at(number))
    candidates = star.candidate
    if number == 1:
        board = star.contest.filter("contest_title = 'Board'").select(F.col("id").alias("contest_id"))
        lost = candidates.join(board, "contest_id", "left_semi").filter("candidate_name = 'Candidate 4'")
        candidates = candidates.join(lost.select("id"), "id", "left_anti")
    return Star(
        star.barcode.withColumn("id", local("id")),
        images.withColumns({"id": local("id"), "barcode_id": local("barcode_id")}),
        star.contest.withColumn("id", local("id")),
        candidates.withColumns({"id": local("id"), "contest_id": local("contest_id")}).select(*star.candidate.columns),
        facts.filter(f"at_{number}").withColumns(
            {c: local(c) for c in ("ballot_image_id", "contest_id", "candidate_id_fk", "barcode_id")}
        ).select(*star.vote_opportunity.columns),
    )


def _counted_at(number: int) -> Column:
    """Whether an image lies at a station."""
    return (F.regexp_extract("image_name", r"^b(\d+)_", 1).cast("bigint") % 3).isin(*_BALLOTS_OF[number])


def stations(spark: SparkSession, sf_dir: str) -> list[tuple[str, Star]]:
    """Two stations whose ballots overlap by a third.

    The facts meet their images once for all stations, and are written with what they found.
    """
    star = results(spark, sf_dir)
    numbers = range(len(_BALLOTS_OF))
    places = star.ballot_image.groupBy(F.col("id").alias("ballot_image_id")).agg(
        *[F.bool_or(_counted_at(n)).alias(f"at_{n}") for n in numbers])
    facts = stage(star.vote_opportunity.join(places, "ballot_image_id"), "station-facts")
    return [(label, _station(star, facts, n)) for n, label in zip(numbers, ("A", "B"))]


_STATIONS: dict[tuple[str, str], Stations] = {}


def station_set(spark: SparkSession, sf_dir: str) -> Stations:
    """The two stations as each stored its results, read as one set."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STATIONS:
        path = new_folder(spark, "stations")
        results(spark, sf_dir)   # kept, so outside of the block
        with discarding(spark):
            for number, (label, star) in enumerate(stations(spark, sf_dir)):
                save_station(star, path, number, label)
        _STATIONS[key] = load_stations(spark, path)
    return _STATIONS[key]


# --- ground truth ------------------------------------------------------------


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the marks are said to be: line 7 is blank, one candidate is unknown, and
    every mark on line 5 also names a candidate the ballots do not have."""
    code = text.parse_barcode("barcode_data")
    known = kept_scans(spark, sf_dir).select(
        "image_id", "image_path",
        F.concat_ws("|", *[code[f] for f in text.BARCODE_FIELDS[:5]]).alias("combo_id"),
        code["region_id"].alias("precinct"), code["party_id"].alias("party"),
    )
    rows = marks(spark, sf_dir).select(
        "image_id", "contest_title", "candidate_name", "marked", F.shiftright("seq", LINE_SHIFT).alias("line")
    ).join(known, "image_id")
    said = F.when(F.col("marked") & (F.col("line") != 7), "VOTED").otherwise("UNMARKED")
    listed = ~((F.col("contest_title") == "Board") & (F.col("candidate_name") == "Candidate 4"))
    # The marks are read and moved once; a mark names its entry, another one, both or none.
    named = F.filter(F.array(
        F.struct(listed.alias("used"), F.col("candidate_name").alias("candidate")),
        F.struct((F.col("line") == 5).alias("used"), F.lit("Candidate 9").alias("candidate"))), lambda n: n["used"])
    return rows.select("*", said.alias("counted_as"), F.inline(named)).select(
        "image_id", F.col("contest_title").alias("contest"), "candidate", "counted_as", "image_path", "combo_id", "precinct", "party")


# --- ballot design -----------------------------------------------------------

# Fixed value: the order of voting methods in the view.
METHODS = ("PLURALITY", "RANKED_CHOICE", "APPROVAL", "MEASURE")
GROUP_BASE = 100


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("region_id"), F.col("n_name").alias("name"),
        F.lit("SINGLE_PRECINCT").alias("region_type"), F.col("n_regionkey").cast("bigint").alias("jurisdiction_id"),
    )
    groups = table(spark, sf_dir, "region").select(
        (F.col("r_regionkey") + GROUP_BASE).cast("bigint").alias("region_id"), F.col("r_name").alias("name"),
        F.lit("PRECINCT_GROUP").alias("region_type"), F.col("r_regionkey").cast("bigint").alias("jurisdiction_id"),
    )
    return nations.unionByName(groups)


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        (F.col("n_regionkey") + GROUP_BASE).cast("bigint").alias("group_id"),
        F.col("n_nationkey").cast("bigint").alias("member_id"),
    )


def design_contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    method = F.get(F.array(*[F.lit(m) for m in METHODS]), (key % 4).cast("int"))
    return table(spark, sf_dir, "part").select(
        key.alias("contest_id"), F.col("p_name").alias("title"), F.col("p_size").alias("display_order"),
        (key % 2 + 1).alias("election_id"), method.alias("voting_method"),
        (F.col("p_size") % 7).alias("max_rank_choices"),
        F.col("p_type").alias("preamble"), F.lit(None).cast("string").alias("postamble"),
        F.col("p_brand").alias("grouping_label"), F.lit("base").alias("instructions"),
    )


def contest_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    direct, group = F.col("p_partkey") % 25, F.col("p_partkey") % 5 + GROUP_BASE
    both = F.col("p_partkey") % 7 == 0
    assigned = F.when(both, F.array(direct, group)).when(F.col("p_size") <= 25, F.array(direct)).otherwise(F.array(group))
    return parts.select(F.col("p_partkey").alias("contest_id"), F.explode(assigned).alias("region_id"))


def design_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size").filter("p_partkey % 11 <> 0")
    numbered = parts.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("p_size") % 4 + 1)))
    return numbered.select(
        (F.col("p_partkey") * 10 + F.col("n")).alias("candidate_id"), F.col("p_partkey").alias("contest_id"),
        F.format_string("%s %d", "p_name", "n").alias("name"), F.col("n").alias("display_order"),
        F.lit(None).cast("string").alias("explanatory_text"),
    )


def contest_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    title = F.when(key % 9 == 0, F.lit("  ")).otherwise(F.concat("p_name", F.lit(" (es)")))
    return table(spark, sf_dir, "part").filter(key % 3 == 0).select(
        key.alias("contest_id"), F.lit("es").alias("lang"), title.alias("title"),
        F.when(key % 2 == 0, F.concat("p_type", F.lit(" (es)"))).alias("preamble"),
        F.lit("fin").alias("postamble"), F.lit(None).cast("string").alias("grouping_label"),
        F.when(key % 2 == 1, F.lit("vote")).alias("instructions"),
    )


def candidate_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("candidate_id")
    return design_candidates(spark, sf_dir).filter(key % 3 == 0).select(
        "candidate_id", F.lit("es").alias("lang"),
        F.when(key % 2 == 0, F.concat("name", F.lit(" (es)"))).alias("name"),
        F.lit("nota").alias("explanatory_text"),
    )


def combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    party = F.when(segment == "BUILDING", F.lit(None)).otherwise(F.length(segment) % 4 + 1).cast("bigint")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("combination_id"), F.col("c_nationkey").cast("bigint").alias("region_id"),
        party.alias("party_id"), (F.col("c_custkey") % 2 + 1).alias("ballot_type_id"),
        (F.col("c_custkey") % 3 + 1).alias("election_id"),
    )


def grouped_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The combinations with every 11th wrongly placed on a group of precincts."""
    wrong = F.when(F.col("combination_id") % 11 == 0, F.col("region_id") % 5 + GROUP_BASE).otherwise(F.col("region_id"))
    return combinations(spark, sf_dir).withColumn("region_id", wrong)


def print_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("log_id"), "user_id", (F.col("event_id") % 2000).alias("combination_id"),
        F.col("ts").alias("printed_at"),
    )


def layout_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed pages of eight contests each, one combination per precinct."""
    key = F.col("contest_id")
    page = F.expr("contest_id div 200")
    return design_candidates(spark, sf_dir).select(
        (key % 25).alias("combination_id"), (page + 1).cast("int").alias("page_number"),
        F.lit(0.5).alias("content_left"), F.lit(0.5).alias("content_top"),
        F.lit(7.5).alias("content_width"), F.lit(10.0).alias("content_height"),
        F.expr("(contest_id div 25) % 8").cast("int").alias("contest_pos"),
        "contest_id", F.concat(F.lit("Contest "), key.cast("string")).alias("contest_title"),
        F.lit("PLURALITY").alias("contest_type"), F.lit(1).alias("max_votes"), F.lit(50.0).alias("percent_to_win"),
        F.lit(0.5).alias("contest_left"), (F.expr("(contest_id div 25) % 8") * 1.25).alias("contest_top"),
        F.lit(2.5).alias("contest_width"), F.lit(1.0).alias("contest_height"),
        F.col("display_order").cast("int").alias("candidate_pos"), "candidate_id", F.col("name").alias("candidate_name"),
        F.lit(False).alias("write_in"), F.lit(0.75).alias("indicator_left"),
        (F.expr("(contest_id div 25) % 8") * 1.25 + F.col("display_order") * 0.1875).alias("indicator_top"),
        F.lit(0.25).alias("indicator_width"), F.lit(0.125).alias("indicator_height"),
        F.lit(S.DEFAULT_INDICATOR_STYLE).alias("indicator_style"),
    )


# --- pixels ------------------------------------------------------------------

PAGE_SIDE = 32
BARCODES = 8


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small rectified pages drawn by the line items of 64 orders each."""
    spots = table(spark, sf_dir, "lineitem").select(
        F.expr("l_orderkey div 64").alias("image_id"),
        (F.col("l_partkey") % PAGE_SIDE).cast("int").alias("x"), (F.col("l_suppkey") % PAGE_SIDE).cast("int").alias("y"),
        (100 + 3 * F.col("l_quantity")).cast("int").alias("lum"),
    )
    darkest = spots.groupBy("image_id", "x", "y").agg(F.min("lum").alias("lum"))
    return darkest.select(
        "image_id", (F.col("image_id") % BARCODES).cast("string").alias("barcode"), F.col("image_id").alias("seq"), "x", "y", "lum"
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages themselves, blank ones included."""
    ids = table(spark, sf_dir, "orders").select(F.expr("o_orderkey div 64").alias("image_id")).distinct()
    return ids.select("image_id", (F.col("image_id") % BARCODES).cast("string").alias("barcode"), F.col("image_id").alias("seq"))


def page_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen boxes per barcode on a 4 x 4 grid, in all three styles."""
    n = F.col("n")
    grid = table(spark, sf_dir, "part").select(
        (F.col("p_partkey") % BARCODES).cast("string").alias("barcode"),
        (F.expr("p_partkey div 8") % 16).cast("int").alias("n"),
    ).distinct()
    style = F.when(n % 3 == 0, "OVAL").when(n % 3 == 1, "ARROW").otherwise("CONNECT_DOTS")
    return grid.select(
        "barcode", n.cast("bigint").alias("box_id"), style.alias("style"), (n % 4 == 0).alias("write_in"),
        (n % 4 * 8 + 1).cast("int").alias("left"), (F.expr("n div 4") * 8 + 1).cast("int").alias("top"),
        F.lit(5).alias("width"), F.lit(4).alias("height"),
    )
