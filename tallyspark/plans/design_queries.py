"""Merge, verification, design and review over the election view, with reference SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import design, merge, reports, review, verify
from tallyspark.plans import election
from tallyspark.plans.oracle_base import plain, with_marks, with_star
from tallyspark.plans.report_queries import on_star

# --- stations ----------------------------------------------------------------


def station_totals(spark: SparkSession, d: str) -> DataFrame:
    return merge.station_totals(election.station_set(spark, d))


def merged_facts(spark: SparkSession, d: str) -> DataFrame:
    """The merged star joined back to names, so that both engines agree without ids."""
    star = merge.merge_stations(election.station_set(spark, d)).star
    return (
        star.vote_opportunity.join(reports.image_names(star, "image_path"), "ballot_image_id")
        .join(reports.contest_names(star), "contest_id")
        .join(reports.candidate_names(star), "candidate_id_fk")
        .join(reports.barcode_keys(star, "raw_data"), "barcode_id")
        .select("image_path", "raw_data", "contest", "candidate", "dark_pct", "vote_status")
    )


def merged_appended(spark: SparkSession, d: str) -> DataFrame:
    star = merge.merge_stations(election.station_set(spark, d), "append").star
    return reports.votes_by_contest(star).select("contest", "candidate", "voted", "overvoted", "unmarked")


def merged_images(spark: SparkSession, d: str) -> DataFrame:
    star = merge.merge_stations(election.station_set(spark, d)).star
    joined = star.ballot_image.join(reports.barcode_keys(star, "raw_data"), "barcode_id", "left")
    return joined.select("id", "image_path", "scribble_flagged", "raw_data")


def compare_stations(spark: SparkSession, d: str) -> DataFrame:
    return merge.compare_stations(election.station_set(spark, d))


def export_rows(spark: SparkSession, d: str) -> DataFrame:
    return merge.export_rows(election.station_set(spark, d)).drop("place")


def merge_log(spark: SparkSession, d: str) -> DataFrame:
    stations = election.station_set(spark, d)
    return merge.merge_log(stations, merge.merge_stations(stations))


_STATIONS = """
lost AS (SELECT ca.id FROM ca JOIN co ON co.id = ca.contest_id WHERE contest_title = 'Board' AND candidate_name = 'Candidate 4'),
at_station AS MATERIALIZED (
  SELECT 'A' AS station, 0 AS station_no, bi.* FROM bi WHERE ballot_no % 3 IN (0, 1)
  UNION ALL SELECT 'B', 1, bi.* FROM bi WHERE ballot_no % 3 IN (1, 2)
),
station_votes AS MATERIALIZED (
  SELECT s.station, s.station_no, s.ballot_no, s.image_path, bc.raw_data, co.contest_title AS contest, ca.candidate_name AS candidate,
         vo.dark_pct, vo.vote_status, s.station = 'B' AND vo.candidate_id_fk IN (SELECT id FROM lost) AS unmapped,
         s.station = 'B' AND s.ballot_no % 3 = 1 AS repeated
  FROM at_station s JOIN vo ON vo.ballot_image_id = s.id JOIN bc ON bc.id = s.barcode_id
  JOIN co ON co.id = vo.contest_id JOIN ca ON ca.id = vo.candidate_id_fk
),
totals AS (
  SELECT station, contest, candidate, count(*) FILTER (WHERE vote_status = 'VOTED') AS voted,
         count(*) FILTER (WHERE vote_status = 'OVERVOTED') AS overvoted
  FROM station_votes WHERE NOT unmapped GROUP BY 1, 2, 3
),
wide AS (
  SELECT contest, candidate,
    CAST(coalesce(max(voted) FILTER (WHERE station = 'A'), 0) AS BIGINT) AS "A_voted",
    CAST(coalesce(max(overvoted) FILTER (WHERE station = 'A'), 0) AS BIGINT) AS "A_overvoted",
    CAST(coalesce(max(voted) FILTER (WHERE station = 'B'), 0) AS BIGINT) AS "B_voted",
    CAST(coalesce(max(overvoted) FILTER (WHERE station = 'B'), 0) AS BIGINT) AS "B_overvoted",
    CAST(sum(voted) AS BIGINT) AS merged_voted, CAST(sum(overvoted) AS BIGINT) AS merged_overvoted
  FROM totals GROUP BY 1, 2
)"""
_BASE_RANK = """CASE WHEN regexp_matches(candidate, '\\(Rank\\s*\\d+\\)$') THEN regexp_extract(candidate, '^(.+?)\\s*\\(Rank\\s*(\\d+)\\)$', 1)
                     ELSE candidate END AS candidate,
                regexp_extract(candidate, '^(.+?)\\s*\\(Rank\\s*(\\d+)\\)$', 2) AS rank, candidate AS full_name"""

# --- verification ------------------------------------------------------------


def expected_totals(spark: SparkSession, d: str) -> DataFrame:
    return verify.expected_totals(election.ground_truth(spark, d))


def verified(spark: SparkSession, d: str) -> DataFrame:
    actual = reports.votes_by_contest(election.results(spark, d))
    return verify.verify_counts(actual, expected_totals(spark, d))


def accuracy(spark: SparkSession, d: str) -> DataFrame:
    return verify.accuracy(verified(spark, d))


def expected_by_combination(spark: SparkSession, d: str) -> DataFrame:
    return verify.expected_by_combination(election.ground_truth(spark, d))


_TRUTH = """
said AS MATERIALIZED (
  SELECT m.image_id, contest_title AS contest, candidate_name AS candidate, l_linenumber,
         CASE WHEN marked AND l_linenumber <> 7 THEN 'VOTED' ELSE 'UNMARKED' END AS counted_as,
         array_to_string(string_split(k.barcode_data, '|')[1:5], '|') AS combo_id,
         string_split(k.barcode_data, '|')[2] AS precinct, string_split(k.barcode_data, '|')[3] AS party
  FROM marks m JOIN kept k USING (image_id)
),
truth AS MATERIALIZED (
  SELECT contest, candidate, counted_as, combo_id, precinct, party FROM said
  WHERE NOT (contest = 'Board' AND candidate = 'Candidate 4')
  UNION ALL SELECT contest, 'Candidate 9', counted_as, combo_id, precinct, party FROM said WHERE l_linenumber = 5
),
wanted AS (
  SELECT contest, candidate, count(*) FILTER (WHERE counted_as = 'VOTED') AS voted, CAST(0 AS BIGINT) AS overvoted,
         count(*) FILTER (WHERE counted_as = 'UNMARKED') AS unmarked FROM truth GROUP BY 1, 2
),
got AS (
  SELECT contest_title AS contest, candidate_name AS candidate, count(*) FILTER (WHERE vote_status = 'VOTED') AS voted,
         count(*) FILTER (WHERE vote_status = 'OVERVOTED') AS overvoted, count(*) FILTER (WHERE vote_status = 'UNMARKED') AS unmarked
  FROM settled GROUP BY 1, 2
),
diff AS (
  SELECT coalesce(g.contest, w.contest) AS contest, coalesce(g.candidate, w.candidate) AS candidate,
    CASE WHEN g.contest IS NULL THEN 'missing_in_db' WHEN w.contest IS NULL THEN 'missing_in_gt'
         WHEN g.voted + g.overvoted = w.voted + w.overvoted THEN 'match' ELSE 'mismatch' END AS class,
    coalesce(g.voted, 0) AS actual_voted, coalesce(g.overvoted, 0) AS actual_overvoted, coalesce(g.unmarked, 0) AS actual_unmarked,
    coalesce(w.voted, 0) AS expected_voted, coalesce(w.overvoted, 0) AS expected_overvoted, coalesce(w.unmarked, 0) AS expected_unmarked
  FROM got g FULL OUTER JOIN wanted w ON w.contest = g.contest AND w.candidate = g.candidate
)"""

# --- design ------------------------------------------------------------------


def _design(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return (election.regions(spark, d), election.members(spark, d),
            election.design_contests(spark, d), election.contest_regions(spark, d))


def resolved(spark: SparkSession, d: str) -> DataFrame:
    return design.resolve_contests(*_design(spark, d))


def explained(spark: SparkSession, d: str) -> DataFrame:
    return design.explain_contests(*_design(spark, d))


def checked(spark: SparkSession, d: str) -> DataFrame:
    return design.check_combinations(election.grouped_combinations(spark, d), election.regions(spark, d))


def barcodes(spark: SparkSession, d: str) -> DataFrame:
    return design.encode_barcode(election.combinations(spark, d), election.regions(spark, d), page=2)


def localized_contests(spark: SparkSession, d: str) -> DataFrame:
    base = election.design_contests(spark, d).select(
        "contest_id", "title", "preamble", "postamble", "grouping_label", "instructions")
    return design.localize_contests(base, election.contest_translations(spark, d), "es")


def localized_candidates(spark: SparkSession, d: str) -> DataFrame:
    base = election.design_candidates(spark, d).select("candidate_id", "name", "explanatory_text")
    return design.localize_candidates(base, election.candidate_translations(spark, d), "es")


def names(spark: SparkSession, d: str) -> DataFrame:
    return design.name_list(election.design_contests(spark, d), election.design_candidates(spark, d))


def measure_options(spark: SparkSession, d: str) -> DataFrame:
    return design.fill_measure_options(election.design_contests(spark, d), election.design_candidates(spark, d))


def rank_options(spark: SparkSession, d: str) -> DataFrame:
    return design.expand_rank_options(election.design_contests(spark, d), election.design_candidates(spark, d))


def valid_logs(spark: SparkSession, d: str) -> DataFrame:
    return design.valid_print_logs(election.print_logs(spark, d), election.combinations(spark, d))


def user_logs(spark: SparkSession, d: str) -> DataFrame:
    return design.print_logs_by_user(election.print_logs(spark, d), 7)


def combination_logs(spark: SparkSession, d: str) -> DataFrame:
    return design.print_logs_by_combination(election.print_logs(spark, d), 12)


def contest_lookup(spark: SparkSession, d: str) -> DataFrame:
    contests = election.design_contests(spark, d)
    return design.lookup(contests, ["display_order", "contest_id"], election_id=2).select("contest_id", "title", "display_order")


def combination_lookup(spark: SparkSession, d: str) -> DataFrame:
    return design.lookup(election.combinations(spark, d), ["election_id", "combination_id"], region_id=4)


def region_lookup(spark: SparkSession, d: str) -> DataFrame:
    return design.lookup(election.regions(spark, d), ["name"], region_type="SINGLE_PRECINCT")


def region_list(spark: SparkSession, d: str) -> DataFrame:
    return design.regions_of_jurisdiction(election.regions(spark, d), 2)


def precinct_groups(spark: SparkSession, d: str) -> DataFrame:
    return design.groups_containing(election.regions(spark, d), election.members(spark, d), 7)


def party_list(spark: SparkSession, d: str) -> DataFrame:
    """Market segments stand in for parties."""
    names = election.table(spark, d, "customer").select(F.col("c_mktsegment").alias("name")).distinct()
    return design.parties_by_name(names)


def ballot_type_list(spark: SparkSession, d: str) -> DataFrame:
    """Brands stand in for ballot types."""
    return design.ballot_types_by_name(election.table(spark, d, "part").select(F.col("p_brand").alias("name")).distinct())


def election_list(spark: SparkSession, d: str) -> DataFrame:
    """Order dates stand in for elections."""
    dates = election.table(spark, d, "orders").groupBy(F.col("o_orderdate").alias("election_date")).agg(F.min("o_orderkey").alias("election_id"))
    return design.elections_newest_first(dates)


def _collapsed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """All precincts of the first jurisdiction become one."""
    old = election.regions(spark, d).filter("jurisdiction_id = 0 AND region_type = 'SINGLE_PRECINCT'").select("region_id")
    return design.collapse_regions(old, 900, election.combinations(spark, d), election.contest_regions(spark, d),
                                   election.members(spark, d))


def collapsed_combinations(spark: SparkSession, d: str) -> DataFrame:
    return _collapsed(spark, d)[0]


def collapsed_assignments(spark: SparkSession, d: str) -> DataFrame:
    return _collapsed(spark, d)[1]


def collapsed_members(spark: SparkSession, d: str) -> DataFrame:
    return _collapsed(spark, d)[2]


def collapsed_collisions(spark: SparkSession, d: str) -> DataFrame:
    return _collapsed(spark, d)[3]


def collapsed_parties(spark: SparkSession, d: str) -> DataFrame:
    combos = election.combinations(spark, d)
    old = combos.filter("party_id IS NOT NULL").select("party_id").distinct()
    return design.collapse_parties(old, 9, combos)[0]


def layout_report(spark: SparkSession, d: str) -> DataFrame:
    """Box report in mm, unnested again to one row per candidate for comparison."""
    pages = design.layout_report(election.layout_positions(spark, d), "mm")
    contests = pages.select("combinationId", "side_number", F.posexplode("contests").alias("contest_at", "c"))
    return contests.select(
        "combinationId", "side_number", "contest_at", F.col("c.id").alias("contest_id"),
        F.col("c.boundingBox.offsetFromTop").alias("contest_top"), F.posexplode("c.candidates").alias("candidate_at", "k"),
    ).select("combinationId", "side_number", "contest_at", "contest_id", "contest_top", "candidate_at",
             F.col("k.id").alias("candidate_id"), F.col("k.indicator.offsetFromTop").alias("top"),
             F.col("k.indicator.width").alias("width"))


_REGIONS = """
regions AS (
  SELECT CAST(n_nationkey AS BIGINT) AS region_id, n_name AS name, 'SINGLE_PRECINCT' AS region_type, CAST(n_regionkey AS BIGINT) AS jurisdiction_id FROM nation
  UNION ALL SELECT r_regionkey + 100, r_name, 'PRECINCT_GROUP', r_regionkey FROM region
),
members AS (SELECT CAST(n_regionkey + 100 AS BIGINT) AS group_id, CAST(n_nationkey AS BIGINT) AS member_id FROM nation),
assigned AS (
  SELECT p_partkey AS contest_id, p_partkey % 25 AS region_id FROM part WHERE p_size <= 25 OR p_partkey % 7 = 0
  UNION ALL SELECT p_partkey, p_partkey % 5 + 100 FROM part WHERE p_size > 25 OR p_partkey % 7 = 0
),
combos AS (
  SELECT c_custkey AS combination_id, CAST(c_nationkey AS BIGINT) AS region_id,
         CASE WHEN c_mktsegment <> 'BUILDING' THEN CAST(length(c_mktsegment) % 4 + 1 AS BIGINT) END AS party_id,
         c_custkey % 2 + 1 AS ballot_type_id, c_custkey % 3 + 1 AS election_id FROM customer
),
sources AS (
  SELECT region_id AS precinct_id, region_id AS source_id, contest_id FROM assigned WHERE region_id < 100
  UNION ALL SELECT member_id, region_id, contest_id FROM assigned JOIN members ON group_id = region_id
)"""
_CANDIDATES = """
cand AS (
  SELECT p_partkey * 10 + n AS candidate_id, p_partkey AS contest_id, p_name || ' ' || n AS name, CAST(n AS INTEGER) AS n, p_size
  FROM part, unnest(range(1, p_size % 4 + 2)) AS u(n) WHERE p_partkey % 11 <> 0
)"""


# --- review ------------------------------------------------------------------

_CLAUSE = "vo.vote_status = 'OVERVOTED' AND c.contest_title = 'Mayor' AND b.party_id = '1' AND cdr.candidate_name LIKE '%3'"


def ballots_by_ids(spark: SparkSession, d: str) -> DataFrame:
    """The images named by the event log, in its order; most numbers are unknown."""
    ids = election.table(spark, d, "events").select(F.col("event_id").alias("position"), (F.col("event_id") * 3).alias("id"))
    return review.ballots_by_ids(election.results(spark, d), ids)


def ballot_boxes(spark: SparkSession, d: str) -> DataFrame:
    return review.ballot_view(election.results(spark, d)).drop("seq")


_SUMMARY = "id, image_name, image_path, dpi, false AS was_rotated"

QUERIES = {
    "mrg1_station_totals": (station_totals, with_star("""
        SELECT t.*, n AS ballot_images FROM totals t
        JOIN (SELECT station, count(*) AS n FROM at_station GROUP BY 1) USING (station)""", _STATIONS)),
    "mrg2_merge_stations": (merged_facts, with_star("""
        SELECT image_path, raw_data, contest, candidate, dark_pct, vote_status FROM station_votes
        WHERE NOT repeated AND NOT unmapped""", _STATIONS)),
    "mrg2_merge_append": (merged_appended, with_star("""
        SELECT contest, candidate, count(*) FILTER (WHERE vote_status = 'VOTED') AS voted,
               count(*) FILTER (WHERE vote_status = 'OVERVOTED') AS overvoted, count(*) FILTER (WHERE vote_status = 'UNMARKED') AS unmarked
        FROM station_votes WHERE NOT unmapped GROUP BY 1, 2""", _STATIONS)),
    "mrg2_merge_images": (merged_images, with_star("""
        SELECT CASE WHEN station_no = 0 THEN s.id + 1
                    ELSE s.id * 3 + 5 + (SELECT max(id) + 1 FROM at_station WHERE station_no = 0) END AS id,
               image_path, scribble_flagged, raw_data
        FROM at_station s JOIN bc ON bc.id = s.barcode_id WHERE station_no = 0 OR ballot_no % 3 = 2""", _STATIONS)),
    "mrg3_compare_stations": (compare_stations, with_star("SELECT * FROM wide", _STATIONS)),
    "mrg4_export_rows": (export_rows, with_star(f"""
        SELECT 'Detail' AS row_type, contest, {_BASE_RANK}, 'DB 1' AS source, "A_voted" AS votes, "A_overvoted" AS overvotes FROM wide
        UNION ALL SELECT 'Detail', contest, {_BASE_RANK}, 'DB 2', "B_voted", "B_overvoted" FROM wide
        UNION ALL SELECT 'SUM', contest, {_BASE_RANK}, 'SUM (DB 1–2)', merged_voted, merged_overvoted FROM wide""", _STATIONS)),
    "mrg5_merge_log": (merge_log, with_star("""
        SELECT station, count(DISTINCT image_path) FILTER (WHERE kind = 'image') AS duplicate_images,
               count(*) FILTER (WHERE kind = 'fact') AS unmapped_facts
        FROM (SELECT station, image_path, 'image' AS kind FROM at_station WHERE station = 'B' AND ballot_no % 3 = 1
              UNION ALL SELECT station, image_path, 'fact' FROM station_votes WHERE unmapped) GROUP BY 1""", _STATIONS)),
    "ver1_expected_totals": (expected_totals, with_marks("SELECT * FROM wanted", _TRUTH)),
    "ver2_verify_counts": (verified, with_marks("""
        SELECT *, CASE WHEN class = 'mismatch' THEN actual_voted + actual_overvoted - expected_voted - expected_overvoted END AS delta_voted
        FROM diff""", _TRUTH)),
    "ver3_accuracy": (accuracy, with_marks("""
        SELECT *, 100.0::DOUBLE * matches / (matches + mismatches) AS accuracy_pct
        FROM (SELECT count(*) FILTER (WHERE class = 'match') AS matches, count(*) FILTER (WHERE class = 'mismatch') AS mismatches,
                     count(*) FILTER (WHERE class = 'missing_in_db') AS missing_in_db,
                     count(*) FILTER (WHERE class = 'missing_in_gt') AS missing_in_gt FROM diff)""", _TRUTH)),
    "ver4_expected_by_combination": (expected_by_combination, with_marks("""
        SELECT combo_id, precinct, party, contest, candidate, count(*) AS votes FROM truth
        WHERE counted_as = 'VOTED' GROUP BY ALL""", _TRUTH)),
    "dsn1_resolve_contests": (resolved, plain("""
        SELECT DISTINCT precinct_id, p_partkey % 2 + 1 AS election_id, p_size AS display_order, contest_id, p_name AS title
        FROM sources JOIN part ON p_partkey = contest_id""", _REGIONS)),
    "dsn2_explain_contests": (explained, plain("""
        SELECT DISTINCT precinct_id, p_partkey % 2 + 1 AS election_id, source_id, name AS source_name, contest_id, p_size AS display_order
        FROM sources JOIN part ON p_partkey = contest_id JOIN regions ON region_id = source_id""", _REGIONS)),
    "dsn3_check_combinations": (checked, plain("""
        SELECT * FROM (
          SELECT 'not_single_precinct' AS problem, combination_id, region_id, party_id, ballot_type_id, election_id, CAST(1 AS BIGINT) AS copies
          FROM misplaced WHERE region_id >= 100
          UNION ALL SELECT 'repeated', min(combination_id), region_id, party_id, ballot_type_id, election_id, count(*)
          FROM misplaced GROUP BY region_id, party_id, ballot_type_id, election_id HAVING count(*) > 1)""", _REGIONS, """
        misplaced AS (SELECT * EXCLUDE (region_id), CASE WHEN combination_id % 11 = 0 THEN region_id % 5 + 100 ELSE region_id END AS region_id FROM combos)""")),
    "dsn4_encode_barcode": (barcodes, plain("""
        SELECT combination_id, jurisdiction_id || '|' || region_id || '|' || coalesce(party_id, 0) || '|' || ballot_type_id || '|'
               || election_id || '|2' AS barcode FROM combos JOIN regions USING (region_id)""", _REGIONS)),
    "dsn5_localize_contests": (localized_contests, """
        SELECT p_partkey AS contest_id,
               CASE WHEN p_partkey % 3 = 0 AND p_partkey % 9 <> 0 THEN p_name || ' (es)' ELSE p_name END AS title,
               CASE WHEN p_partkey % 6 = 0 THEN p_type || ' (es)' ELSE p_type END AS preamble,
               CASE WHEN p_partkey % 3 = 0 THEN 'fin' END AS postamble, p_brand AS grouping_label,
               CASE WHEN p_partkey % 6 = 3 THEN 'vote' END AS instructions FROM part"""),
    "dsn5_localize_candidates": (localized_candidates, plain("""
        SELECT candidate_id, CASE WHEN candidate_id % 6 = 0 THEN name || ' (es)' ELSE name END AS name,
               CASE WHEN candidate_id % 3 = 0 THEN 'nota' END AS explanatory_text FROM cand""", _CANDIDATES)),
    "dsn6_name_list": (names, plain("""
        SELECT p_partkey % 2 + 1 AS election_id, p_partkey AS contest_id, p_name AS contest, candidate_id, name AS candidate
        FROM part LEFT JOIN cand ON contest_id = p_partkey""", _CANDIDATES)),
    "dsn7_layout_report": (layout_report, plain("""
        SELECT contest_id % 25 AS "combinationId", CAST(contest_id // 200 + 1 AS INTEGER) AS side_number,
          CAST(dense_rank() OVER (PARTITION BY contest_id % 25, contest_id // 200 ORDER BY contest_id // 25 % 8) - 1 AS INTEGER) AS contest_at,
          contest_id, printf('%.4f', (contest_id // 25 % 8) * 1.25::DOUBLE * 25.4::DOUBLE) AS contest_top,
          CAST(n - 1 AS INTEGER) AS candidate_at, candidate_id,
          printf('%.4f', ((contest_id // 25 % 8) * 1.25::DOUBLE + n * 0.1875::DOUBLE) * 25.4::DOUBLE) AS top,
          printf('%.4f', 0.25::DOUBLE * 25.4::DOUBLE) AS width FROM cand""", _CANDIDATES)),
    "dsn8_fill_measure_options": (measure_options, plain("""
        SELECT contest_id, name, n AS display_order FROM cand
        UNION ALL SELECT p_partkey, o.name, CAST(o.n AS INTEGER) FROM part, (VALUES ('Yes', 1), ('No', 2)) AS o(name, n)
        WHERE p_partkey % 4 = 3 AND p_partkey % 11 = 0""", _CANDIDATES)),
    "dsn9_expand_rank_options": (rank_options, plain("""
        SELECT contest_id, candidate_id, CAST(r AS INTEGER) AS rank, name || ' (Rank ' || r || ')' AS name
        FROM (SELECT *, count(*) OVER (PARTITION BY contest_id) AS total FROM cand) c,
             unnest(range(1, CASE WHEN p_size % 7 > 0 THEN least(p_size % 7, 5) ELSE least(total, 5) END + 1)) AS u(r)
        WHERE contest_id % 4 = 1""", _CANDIDATES)),
    "dsn10_valid_print_logs": (valid_logs, """
        SELECT event_id AS log_id, user_id, event_id % 2000 AS combination_id, ts AS printed_at FROM events
        WHERE event_id % 2000 IN (SELECT c_custkey FROM customer)"""),
    "dsn10_print_logs_by_user": (user_logs, """
        SELECT event_id AS log_id, user_id, event_id % 2000 AS combination_id, ts AS printed_at FROM events WHERE user_id = 7"""),
    "dsn10_print_logs_by_combination": (combination_logs, """
        SELECT event_id AS log_id, user_id, event_id % 2000 AS combination_id, ts AS printed_at FROM events WHERE event_id % 2000 = 12"""),
    "dsn11_contest_lookup": (contest_lookup,
        "SELECT p_partkey AS contest_id, p_name AS title, p_size AS display_order FROM part WHERE p_partkey % 2 = 1"),
    "dsn11_combination_lookup": (combination_lookup, plain("SELECT * FROM combos WHERE region_id = 4", _REGIONS)),
    "dsn11_region_lookup": (region_lookup, plain("SELECT * FROM regions WHERE region_type = 'SINGLE_PRECINCT'", _REGIONS)),
    "dsn11_regions_of_jurisdiction": (region_list, plain("SELECT * FROM regions WHERE jurisdiction_id = 2", _REGIONS)),
    "dsn11_groups_containing": (precinct_groups, plain("""
        SELECT * FROM regions WHERE region_id IN (SELECT group_id FROM members WHERE member_id = 7)""", _REGIONS)),
    "dsn11_parties_by_name": (party_list, "SELECT DISTINCT c_mktsegment AS name FROM customer"),
    "dsn11_ballot_types_by_name": (ballot_type_list, "SELECT DISTINCT p_brand AS name FROM part"),
    "dsn11_elections_newest_first": (election_list, """
        SELECT o_orderdate AS election_date, min(o_orderkey) AS election_id FROM orders GROUP BY 1"""),
    "dsn12_collapse_regions": (collapsed_combinations, plain("""
        SELECT * REPLACE (CASE WHEN region_id % 5 = 0 THEN 900 ELSE region_id END AS region_id) FROM combos""", _REGIONS)),
    "dsn12_collapse_assignments": (collapsed_assignments, plain("""
        SELECT contest_id, region_id FROM assigned
        WHERE contest_id NOT IN (SELECT contest_id FROM assigned WHERE region_id < 100 AND region_id % 5 = 0)
        UNION ALL SELECT DISTINCT contest_id, 900 FROM assigned WHERE region_id < 100 AND region_id % 5 = 0""", _REGIONS)),
    "dsn12_collapse_members": (collapsed_members, plain("SELECT * FROM members WHERE member_id % 5 <> 0", _REGIONS)),
    "dsn12_collapse_collisions": (collapsed_collisions, plain("""
        SELECT region_id, party_id, ballot_type_id, election_id, count(*) AS copies, min(combination_id) AS first_id
        FROM (SELECT * REPLACE (CASE WHEN region_id % 5 = 0 THEN 900 ELSE region_id END AS region_id) FROM combos)
        GROUP BY 1, 2, 3, 4 HAVING count(*) > 1""", _REGIONS)),
    "dsn12_collapse_parties": (collapsed_parties, plain(
        "SELECT * REPLACE (CASE WHEN party_id IS NOT NULL THEN CAST(9 AS BIGINT) END AS party_id) FROM combos", _REGIONS)),
    "rvw1_list_ballots": (on_star(review.list_ballots), with_star(f"SELECT {_SUMMARY} FROM bi")),
    "rvw2_ballots_by_ids": (ballots_by_ids, with_star(f"SELECT event_id AS position, {_SUMMARY} FROM bi JOIN events ON event_id * 3 = id")),
    "rvw3_ballots_by_glob": (on_star(review.ballots_by_glob, "B?1*_C2.P"), with_star(f"""
        SELECT {_SUMMARY} FROM bi WHERE regexp_matches(lower(image_path), 'b.1.*_c2[.]p')""")),
    "rvw4_ballots_where": (on_star(review.ballots_where, _CLAUSE), with_star(f"""
        SELECT {_SUMMARY} FROM bi WHERE id IN (
          SELECT bi.id FROM bi LEFT JOIN bc b ON b.id = bi.barcode_id LEFT JOIN vo ON vo.ballot_image_id = bi.id
          LEFT JOIN co c ON c.id = vo.contest_id LEFT JOIN ca cdr ON cdr.id = vo.candidate_id_fk WHERE {_CLAUSE})""")),
    "rvw5_ballot_view": (ballot_boxes, with_star("""
        SELECT image_id, abs_left AS x, abs_top AS y, CAST(8 AS INTEGER) AS w, CAST(6 AS INTEGER) AS h, contest_title AS contest, contest_type,
          candidate_name AS candidate, vote_status AS status,
          CASE vote_status WHEN 'VOTED' THEN '#22c55e' WHEN 'OVERVOTED' THEN '#eab308' ELSE '#3b82f6' END AS color,
          CASE WHEN rank_no IS NULL THEN candidate_name
               ELSE regexp_replace(candidate_name, ' \\(Rank \\d+\\)$', '') || ' [R' || rank_no || ']' END AS label,
          rank_no IS NOT NULL AS ranked_choice,
          CASE WHEN rank_no IS NOT NULL AND vote_status = 'VOTED' THEN 'MARKED at Rank ' || rank_no ELSE vote_status END AS status_label
        FROM settled""")),
}
