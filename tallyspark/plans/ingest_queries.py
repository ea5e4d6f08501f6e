"""Ingest operators over the election view, each with its reference SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import text
from tallyspark.operators import ingest, reports
from tallyspark.plans import election
from tallyspark.plans.oracle_base import plain, with_marks, with_rough, with_scans, with_star


def barcode_fields(spark: SparkSession, d: str) -> DataFrame:
    return election.scans(spark, d).select(
        "image_id",
        text.parse_barcode("barcode_data").alias("parts"),
        text.barcode_page("barcode_data").alias("page"),
    ).select("image_id", "parts.*", "page")


def barcode_dim(spark: SparkSession, d: str) -> DataFrame:
    return ingest.build_barcode_dim(election.kept_scans(spark, d))


def _rescanned(spark: SparkSession, d: str) -> DataFrame:
    """Orders as arrivals of one scan file per customer: most paths arrive repeatedly."""
    return election.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("image_id"),
        F.format_string("/scans/c%d.png", "o_custkey").alias("image_path"),
        F.col("o_orderpriority").alias("image_name"),
    )


def first_images(spark: SparkSession, d: str) -> DataFrame:
    return ingest.dedupe_images(_rescanned(spark, d))


def duplicate_images(spark: SparkSession, d: str) -> DataFrame:
    return ingest.duplicate_scans(_rescanned(spark, d))


def classified(spark: SparkSession, d: str) -> DataFrame:
    return election.marks(spark, d).select(
        "image_id", "contest_id", "candidate_name", "marked", "dark_pct", "dark_pixels", "total_pixels", "mean_intensity"
    )


def overvotes_fptp(spark: SparkSession, d: str) -> DataFrame:
    return ingest.overvotes_fptp(election.marks(spark, d))


def overvotes_ranked(spark: SparkSession, d: str) -> DataFrame:
    return ingest.overvotes_ranked(election.marks(spark, d))


def vote_status(spark: SparkSession, d: str) -> DataFrame:
    settled = ingest.assign_vote_status(election.marks(spark, d))
    return settled.select("image_id", "contest_id", "candidate_name", "dark_pct", "vote_status")


def contest_dim(spark: SparkSession, d: str) -> DataFrame:
    return ingest.build_contest_dim(election.marks(spark, d))


def candidate_dim(spark: SparkSession, d: str) -> DataFrame:
    return election.results(spark, d).candidate


def vote_fact(spark: SparkSession, d: str) -> DataFrame:
    return election.results(spark, d).vote_opportunity.select(
        "ballot_image_id", "contest_id", "candidate_id_fk", "barcode_id", "abs_left", "abs_top", "dark_pct", "vote_status"
    )


def image_table(spark: SparkSession, d: str) -> DataFrame:
    return election.results(spark, d).ballot_image.select(
        "id", "image_path", "image_name", "counted_at", "dpi", "page_number", "warp_dpi",
        "canonical_width", "canonical_height", "scribble_flagged", "scribble_pixels", "barcode_id",
    )


def rough_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of badly scanned ballots under their names: repeated paths, missing ids, disputed settings."""
    star = election.rough_results(spark, d)
    return (
        star.vote_opportunity.join(reports.image_names(star, "image_path"), "ballot_image_id")
        .join(reports.contest_names(star, "contest_type"), "contest_id").join(reports.candidate_names(star), "candidate_id_fk")
        .join(reports.barcode_keys(star, "raw_data"), "barcode_id")
        .select("ballot_image_id", "image_path", "raw_data", "contest", "contest_type", "candidate", "dark_pct", "vote_status")
    )


def rough_contests(spark: SparkSession, d: str) -> DataFrame:
    return election.rough_results(spark, d).contest


def rough_candidates(spark: SparkSession, d: str) -> DataFrame:
    star = election.rough_results(spark, d)
    return star.candidate.join(reports.contest_names(star), "contest_id").select(
        "contest", "candidate_name", "ballot_candidate_id", "write_in")


def rough_images(spark: SparkSession, d: str) -> DataFrame:
    star = election.rough_results(spark, d)
    return star.ballot_image.join(reports.barcode_keys(star, "raw_data"), "barcode_id").select("id", "image_path", "raw_data")


def review(spark: SparkSession, d: str) -> DataFrame:
    return ingest.split_review(election.scans(spark, d))[1]


def boxes(spark: SparkSession, d: str) -> DataFrame:
    return ingest.indicator_boxes(election.box_layout(spark, d), warp_dpi=200, image_dpi=300).select(
        "candidate_id", "abs_left", "abs_top", "width", "height", "image_x", "image_y",
        "contest_image_left", "contest_image_right",
    )


def dpi(spark: SparkSession, d: str) -> DataFrame:
    widths = election.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("image_id"),
        (F.round("o_totalprice").cast("bigint") % 5100 + 400).cast("int").alias("width_px"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 240).otherwise(0).alias("metadata_dpi"),
    )
    return ingest.resolve_dpi(widths, session_dpi=300.0).select("image_id", "resolved_dpi")


def stored_results(spark: SparkSession, d: str) -> DataFrame:
    """Row count of each stored table, read back from disk."""
    counts = None
    for name, table in election.results(spark, d).tables().items():
        one = table.agg(F.lit(name).alias("table_name"), F.count("*").alias("n"))
        counts = one if counts is None else counts.unionByName(one)
    return counts


_BOXES_SQL = """
SELECT p_partkey AS candidate_id,
  CAST(floor((l_in - 0.5) * 200 + 0.5) AS INTEGER) AS abs_left, CAST(floor((t_in - 0.25) * 200 + 0.5) AS INTEGER) AS abs_top,
  CAST(greatest(1, floor(w_in * 200 + 0.5)) AS INTEGER) AS width, CAST(greatest(1, floor(h_in * 200 + 0.5)) AS INTEGER) AS height,
  CAST(floor(l_in * 300 + 0.5) AS INTEGER) AS image_x, CAST(floor(t_in * 300 + 0.5) AS INTEGER) AS image_y,
  CAST(CASE WHEN c_in > 0 AND cw_in > 0 THEN floor(c_in * 300 + 0.5) ELSE -1 END AS INTEGER) AS contest_image_left,
  CAST(CASE WHEN c_in > 0 AND cw_in > 0 THEN floor((c_in + cw_in) * 300 + 0.5) ELSE -1 END AS INTEGER) AS contest_image_right
FROM (SELECT p_partkey, p_size / 8.0 AS l_in, p_retailprice / 128.0 AS t_in, (p_partkey % 9) / 64.0 AS w_in, (p_size % 5) / 512.0 AS h_in,
             (p_partkey % 4) / 4.0 AS c_in, (p_size % 3) / 2.0 AS cw_in FROM part)
"""

_DPI_SQL = """
WITH w AS (
  SELECT o_orderkey AS image_id, CAST(round(o_totalprice) AS BIGINT) % 5100 + 400 AS width_px,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 240 ELSE 0 END AS metadata_dpi FROM orders
), g AS (SELECT *, width_px / 8.5::DOUBLE AS h FROM w),
s AS (
  SELECT *, CASE WHEN abs(h - 72) / 72 < 0.10::DOUBLE THEN 72 WHEN abs(h - 96) / 96 < 0.10::DOUBLE THEN 96
                 WHEN abs(h - 150) / 150 < 0.10::DOUBLE THEN 150 WHEN abs(h - 200) / 200 < 0.10::DOUBLE THEN 200
                 WHEN abs(h - 300) / 300 < 0.10::DOUBLE THEN 300 WHEN abs(h - 400) / 400 < 0.10::DOUBLE THEN 400
                 WHEN abs(h - 600) / 600 < 0.10::DOUBLE THEN 600 ELSE floor(h + 0.5) END AS snapped FROM g
)
SELECT image_id, CAST(CASE WHEN metadata_dpi > 0 THEN metadata_dpi
                      WHEN abs(snapped - 300) / 300 > 0.15::DOUBLE THEN 300 ELSE snapped END AS DOUBLE) AS resolved_dpi
FROM s
"""

QUERIES = {
    "ing1_parse_barcode": (barcode_fields, with_scans("""
        SELECT image_id, p[1] AS jurisdiction_id, p[2] AS region_id, p[3] AS party_id, p[4] AS ballot_type_id,
               p[5] AS election_id, p[6] AS page_number,
               CAST(CASE WHEN regexp_full_match(p[6], '[+-]?[0-9]+') THEN p[6] ELSE '1' END AS INTEGER) AS page
        FROM (SELECT image_id, string_split(barcode_data, '|') AS p FROM scans)""")),
    "ing2_barcode_dim": (barcode_dim, with_star("SELECT * FROM bc")),
    "ing3_dedupe_images": (first_images, """
        SELECT image_id, image_path, image_name FROM (
          SELECT o_orderkey AS image_id, '/scans/c' || o_custkey || '.png' AS image_path, o_orderpriority AS image_name,
                 row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1"""),
    "ing3_duplicate_images": (duplicate_images, """
        SELECT image_id, image_path FROM (
          SELECT o_orderkey AS image_id, '/scans/c' || o_custkey || '.png' AS image_path,
                 row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn > 1"""),
    "ing4_classify_marks": (classified, with_marks("""
        SELECT image_id, contest_no AS contest_id, candidate_name, marked, dark_pct,
               CAST(dark_pct AS INTEGER) AS dark_pixels, CAST(100 AS INTEGER) AS total_pixels,
               CAST(255 - 2 * dark_pct AS DOUBLE) AS mean_intensity
        FROM marks""")),
    "ing5_overvotes_fptp": (overvotes_fptp, with_marks("""
        SELECT b.image_id, b.contest_no AS contest_id, any_value(m.contest_title) AS contest_title,
               any_value(b.marked_candidates) AS marked_candidates
        FROM fptp_bad b JOIN marks m USING (image_id, contest_no) GROUP BY b.image_id, b.contest_no""")),
    "ing6_overvotes_ranked": (overvotes_ranked, with_marks(
        "SELECT image_id, contest_no AS contest_id, rank_no AS bad_rank FROM rank_bad")),
    "ing7_vote_status": (vote_status, with_marks(
        "SELECT image_id, contest_no AS contest_id, candidate_name, dark_pct, vote_status FROM settled")),
    "ing8_contest_dim": (contest_dim, with_star(
        "SELECT id, contest_title, contest_type, max_votes, percent_to_win FROM co")),
    "ing9_candidate_dim": (candidate_dim, with_star(
        "SELECT id, contest_id, candidate_name, ballot_candidate_id, write_in FROM ca")),
    "ing10_vote_fact": (vote_fact, with_star("""
        SELECT ballot_image_id, contest_id, candidate_id_fk, barcode_id, abs_left, abs_top, dark_pct, vote_status
        FROM vo""")),
    "ing10_image_table": (image_table, with_star("""
        SELECT id, image_path, image_name, counted_at, dpi, page_number, warp_dpi,
               CAST(1500 AS INTEGER) AS canonical_width, CAST(2000 AS INTEGER) AS canonical_height,
               scribble_flagged, scribble_pixels, barcode_id FROM bi""")),
    "ing10_rough_facts": (rough_facts, with_rough("""
        SELECT image_id AS ballot_image_id, image_path, raw_data, contest_title AS contest, contest_type, candidate_name AS candidate, dark_pct, vote_status
        FROM r_settled JOIN r_kept USING (image_id)""")),
    "ing10_rough_images": (rough_images, with_rough("SELECT image_id AS id, image_path, raw_data FROM r_kept")),
    "ing8_rough_contests": (rough_contests, with_rough("""
        SELECT row_number() OVER (ORDER BY contest_title, contest_type) AS id, * FROM (
          SELECT contest_title, contest_type, arg_min(max_votes, (image_id, seq)) AS max_votes, arg_min(percent_to_win, (image_id, seq)) AS percent_to_win
          FROM r_marks GROUP BY 1, 2)""")),
    "ing9_rough_candidates": (rough_candidates, with_rough("""
        SELECT contest, candidate_name, said.candidate_no AS ballot_candidate_id, said.write_in AS write_in FROM (
          SELECT contest_title AS contest, candidate_name, arg_min({'candidate_no': candidate_no, 'write_in': write_in}, (image_id, seq)) AS said
          FROM r_marks GROUP BY 1, 2)""")),
    "ing11_split_review": (review, with_scans(
        "SELECT image_id, image_path, error_message AS reason FROM scans WHERE error_message IS NOT NULL")),
    "ing12_indicator_boxes": (boxes, plain(_BOXES_SQL)),
    "ing13_resolve_dpi": (dpi, plain(_DPI_SQL)),
    "src4_stored_results": (stored_results, with_star("""
        SELECT 'barcode' AS table_name, count(*) AS n FROM bc UNION ALL SELECT 'ballot_image', count(*) FROM bi
        UNION ALL SELECT 'contest', count(*) FROM co UNION ALL SELECT 'candidate', count(*) FROM ca
        UNION ALL SELECT 'vote_opportunity', count(*) FROM vo""")),
}
