"""Reports, summaries and winners over the election view, with reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import ingest, reports, summary, winners
from tallyspark.operators.ingest import Star
from tallyspark.plans import election
from tallyspark.plans.oracle_base import with_marks, with_star

Query = Callable[[SparkSession, str], DataFrame]


def on_star(report: Callable[..., DataFrame], *args: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return report(election.results(spark, d), *args)

    return run


def on_marks(report: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return report(election.marks(spark, d))

    return run


def on_choices(report: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return report(summary.valid_choices(election.marks(spark, d), election.kept_scans(spark, d)))

    return run


def vote_summary(spark: SparkSession, d: str) -> DataFrame:
    """All marks; those of scans for review fall out with their scans."""
    return summary.vote_summary(ingest.classify_marks(election.measurements(spark, d)), election.kept_scans(spark, d))


def write_in_crops(spark: SparkSession, d: str) -> DataFrame:
    return summary.write_in_crops(election.marks(spark, d), election.kept_scans(spark, d))


def valid_choices(spark: SparkSession, d: str) -> DataFrame:
    """The choices as text, so that both engines compare plain columns."""
    rows = summary.valid_choices(election.marks(spark, d), election.kept_scans(spark, d))
    return rows.withColumn("names", F.array_join("names", "|")).drop("choices")


def totals_with_overvotes(choices: DataFrame) -> DataFrame:
    totals = summary.summary_totals(choices)
    bad = summary.overvoted_ballot_counts(choices)
    return totals.join(bad, ["contest_id", "contest_title"])


def tally(star: Star) -> DataFrame:
    """Input of the winner rule: counted votes per contest and candidate."""
    votes = reports.votes_by_contest(star).select("contest", "candidate", F.col("voted").alias("votes"))
    return winners.rank_winners(votes, reports.contest_config(star)).select("contest", "candidate", "votes", "place", "winner")


def no_winner(star: Star) -> DataFrame:
    """No-winner test with every threshold raised to 80 %, which some contests miss."""
    raised = reports.contest_config(star).withColumn("percent_to_win", F.lit(80.0))
    votes = reports.votes_by_contest(star).select("contest", "candidate", F.col("voted").alias("votes"))
    ranked = winners.rank_winners(votes, raised).withColumnRenamed("votes", "counted")
    return winners.no_winner_contests(ranked)


_COUNTS = """count(*) FILTER (WHERE vote_status = 'VOTED') AS voted,
  count(*) FILTER (WHERE vote_status = 'OVERVOTED') AS overvoted,
  count(*) FILTER (WHERE vote_status = 'UNMARKED') AS unmarked"""
_JOINED = """FROM vo JOIN co ON co.id = vo.contest_id JOIN ca ON ca.id = vo.candidate_id_fk
  JOIN bi ON bi.id = vo.ballot_image_id JOIN bc ON bc.id = bi.barcode_id"""

_CONFIG = """
cfg AS (SELECT contest_title AS contest, arg_max(max_votes, id) AS max_votes, arg_max(percent_to_win, id) AS percent_to_win,
               arg_max(contest_type, id) AS contest_type FROM co GROUP BY contest_title),
tot AS (SELECT co.contest_title AS contest, ca.candidate_name AS candidate, """ + _COUNTS + """
        FROM vo JOIN co ON co.id = vo.contest_id JOIN ca ON ca.id = vo.candidate_id_fk GROUP BY 1, 2)"""
_RANKED = """
ranked AS (
  SELECT t.*, cfg.contest_type, cfg.max_votes, cfg.percent_to_win,
    CAST(row_number() OVER (PARTITION BY contest ORDER BY voted DESC, candidate) AS INTEGER) AS place,
    CAST(sum(voted) OVER (PARTITION BY contest) AS DOUBLE) AS total
  FROM tot t JOIN cfg USING (contest)
),
won AS (
  SELECT *, contest_type IN ('PLURALITY', 'MEASURE') AND
    CASE WHEN max_votes <= 1 THEN place = 1 AND total > 0 AND voted > percent_to_win / 100.0 * total
         ELSE place <= max_votes END AS winner
  FROM ranked
)"""

_ICR = """
per_contest AS (
  SELECT image_id, contest_no AS contest_id, arg_min(contest_title, seq) AS contest_title,
    arg_min(contest_type, seq) AS contest_type, arg_min(max_votes, seq) AS max_votes,
    arg_min(percent_to_win, seq) AS percent_to_win
  FROM marks GROUP BY 1, 2
),
icr AS MATERIALIZED (
  SELECT p.*, f.image_id IS NOT NULL AS overvoted, k.image_name,
    coalesce(string_split(k.barcode_data, '|')[3], '0') AS party_id,
    coalesce(string_split(k.barcode_data, '|')[2], '0') AS region_id
  FROM per_contest p JOIN kept k USING (image_id)
  LEFT JOIN fptp_bad f ON f.image_id = p.image_id AND f.contest_no = p.contest_id
),
picked AS MATERIALIZED (
  SELECT i.*, m.candidate_name AS candidate, m.seq
  FROM icr i JOIN marks m ON m.image_id = i.image_id AND m.contest_no = i.contest_id
  WHERE m.marked AND NOT i.overvoted
),
set_aside AS (
  SELECT m.contest_title, m.candidate_name AS candidate, count(*) AS overvotes
  FROM marks m JOIN icr i ON i.image_id = m.image_id AND i.contest_id = m.contest_no
  WHERE m.marked AND i.overvoted GROUP BY 1, 2
)"""

# What an image says in a contest, from one aggregate of its marks.
_GATHERED = """
said AS (
  SELECT image_id, contest_no AS contest_id, arg_min(contest_title, seq) AS contest_title,
    arg_min(contest_type, seq) AS contest_type, arg_min(max_votes, seq) AS max_votes, arg_min(percent_to_win, seq) AS percent_to_win,
    list(candidate_name ORDER BY seq) FILTER (WHERE marked) AS marked
  FROM marks GROUP BY image_id, contest_no
),
gathered AS (
  SELECT s.*, f.image_id IS NOT NULL AS overvoted, k.image_name,
    coalesce(string_split(k.barcode_data, '|')[3], '0') AS party_id, coalesce(string_split(k.barcode_data, '|')[2], '0') AS region_id
  FROM said s JOIN kept k ON k.image_id = s.image_id
  LEFT JOIN fptp_bad f ON f.image_id = s.image_id AND f.contest_no = s.contest_id
)"""

QUERIES = {
    "agg1_votes_by_contest": (on_star(reports.votes_by_contest), with_star(f"""
        SELECT contest, candidate, voted, overvoted, unmarked,
               CASE WHEN r THEN regexp_replace(candidate, '\\s*\\(Rank \\d+\\)$', '') ELSE candidate END AS base_name,
               CASE WHEN r THEN 'Rank ' || regexp_extract(candidate, '\\(Rank (\\d+)\\)$', 1) END AS rank_label,
               r AS ranked_choice
        FROM (SELECT *, regexp_matches(candidate, '\\(Rank \\d+\\)$') AS r
              FROM (SELECT contest_title AS contest, candidate_name AS candidate, {_COUNTS} {_JOINED} GROUP BY 1, 2))""")),
    "agg2_votes_by_contest_precinct": (on_star(reports.votes_by_contest_precinct), with_star(f"""
        SELECT contest, candidate, coalesce(region_id, '(unknown)') AS precinct, voted, overvoted, unmarked
        FROM (SELECT contest_title AS contest, candidate_name AS candidate, region_id, {_COUNTS} {_JOINED} GROUP BY 1, 2, 3)""")),
    "agg3_votes_by_contest_party": (on_star(reports.votes_by_contest_party), with_star(f"""
        SELECT contest, candidate, coalesce(party_id, '0') AS party, voted, overvoted, unmarked
        FROM (SELECT contest_title AS contest, candidate_name AS candidate, party_id, {_COUNTS} {_JOINED} GROUP BY 1, 2, 3)""")),
    "agg4_votes_by_contest_precinct_party": (on_star(reports.votes_by_contest_precinct_party), with_star(f"""
        SELECT contest, precinct, party, candidate, voted, overvoted
        FROM (SELECT contest_title AS contest, region_id AS precinct, party_id AS party, candidate_name AS candidate,
                     {_COUNTS} {_JOINED} GROUP BY 1, 2, 3, 4)""")),
    "agg5_ballots_per_precinct": (on_star(reports.ballots_per_precinct), with_star("""
        SELECT region_id AS precinct, count(DISTINCT bi.id) AS ballots_scanned
        FROM bi JOIN bc ON bc.id = bi.barcode_id GROUP BY 1""")),
    "agg6_overvoted_ballots": (on_star(reports.overvoted_ballots), with_star("""
        SELECT image_name, image_path, contest_title AS contest, count(*) AS overvoted_indicators
        FROM vo JOIN bi ON bi.id = vo.ballot_image_id JOIN co ON co.id = vo.contest_id
        WHERE vote_status = 'OVERVOTED' GROUP BY 1, 2, 3""")),
    "agg7_overvoted_pairs": (on_star(reports.overvoted_pairs), with_star("""
        SELECT DISTINCT image_name, contest_title AS contest, co.id AS contest_id, contest_type, max_votes
        FROM vo JOIN bi ON bi.id = vo.ballot_image_id JOIN co ON co.id = vo.contest_id
        WHERE vote_status = 'OVERVOTED'""")),
    "agg8_write_ins_by_contest_precinct": (on_star(reports.write_ins_by_contest_precinct), with_star(f"""
        SELECT contest_title AS contest, region_id AS precinct, count(*) AS write_in_votes {_JOINED}
        WHERE write_in AND vote_status = 'VOTED' GROUP BY 1, 2""")),
    "agg9_marked_write_ins": (on_star(reports.marked_write_ins), with_star(f"""
        SELECT bi.id AS image_id, image_name, contest_title AS contest, candidate_name AS candidate,
               coalesce(raw_data, '') AS barcode_data {_JOINED}
        WHERE write_in AND vote_status <> 'UNMARKED'""")),
    "agg10_contest_dashboard": (on_star(reports.contest_dashboard), with_star(f"""
        SELECT contest_title AS contest, contest_type, count(DISTINCT bi.id) AS ballots, {_COUNTS} {_JOINED} GROUP BY 1, 2""")),
    "agg11_contest_config": (on_star(reports.contest_config), with_star("SELECT * FROM cfg", _CONFIG)),
    "agg12_flagged_ballots": (on_star(reports.flagged_ballots), with_star("""
        SELECT bi.id AS image_id, image_name, image_path, scribble_pixels, coalesce(raw_data, '') AS barcode_data,
               CAST(NULL AS VARCHAR) AS scribble_outline_path
        FROM bi LEFT JOIN bc ON bc.id = bi.barcode_id WHERE scribble_flagged""")),
    "agg13_headline_totals": (on_star(reports.headline_totals), with_star("""
        SELECT (SELECT count(*) FROM vo WHERE vote_status = 'VOTED') AS votes_cast, (SELECT count(*) FROM bi) AS ballot_images,
               (SELECT count(DISTINCT ballot_image_id) FROM vo WHERE vote_status = 'OVERVOTED') AS overvoted_images,
               (SELECT count(*) FROM bi WHERE scribble_flagged) AS flagged_images""")),
    "agg14_candidate_by_precinct": (on_star(reports.candidate_by_precinct, "Candidate 3"), with_star(f"""
        SELECT contest_title AS contest, region_id AS precinct, count(*) AS votes {_JOINED}
        WHERE candidate_name = 'Candidate 3' AND vote_status = 'VOTED' GROUP BY 1, 2""")),
    "agg14_contest_by_candidate": (on_star(reports.contest_by_candidate, "Council"), with_star(f"""
        SELECT candidate_name AS candidate, count(*) AS votes {_JOINED}
        WHERE contest_title = 'Council' AND vote_status = 'VOTED' GROUP BY 1""")),
    "agg15_session_tallies": (on_marks(summary.session_tallies), with_marks("""
        SELECT contest_title, candidate, marked - coalesce(overvotes, 0) AS votes, ballots_checked,
               coalesce(overvotes, 0) AS overvotes
        FROM (SELECT contest_title, candidate_name AS candidate, count(*) FILTER (WHERE marked) AS marked,
                     count(*) AS ballots_checked FROM marks GROUP BY 1, 2)
        LEFT JOIN set_aside USING (contest_title, candidate)""", _ICR)),
    "agg16_valid_choices": (valid_choices, with_marks("""
        SELECT image_id, contest_id, contest_title, contest_type, max_votes, percent_to_win, overvoted, image_name, party_id, region_id,
               CASE WHEN overvoted THEN '' ELSE coalesce(array_to_string(marked, '|'), '') END AS names FROM gathered""", _GATHERED)),
    "agg17_summary_totals": (on_choices(totals_with_overvotes), with_marks("""
        SELECT contest_id, contest_title, candidate, votes, overvoted_ballots
        FROM (SELECT contest_id, contest_title, candidate, count(*) AS votes FROM picked GROUP BY 1, 2, 3)
        JOIN (SELECT contest_id, count(*) FILTER (WHERE overvoted) AS overvoted_ballots FROM icr GROUP BY 1) USING (contest_id)""", _ICR)),
    "agg18_summary_by_party": (on_choices(summary.summary_by_party), with_marks(
        "SELECT contest_id, contest_title, party_id, candidate, count(*) AS votes FROM picked GROUP BY 1, 2, 3, 4", _ICR)),
    "agg19_summary_by_region": (on_choices(summary.summary_by_region), with_marks(
        "SELECT contest_id, contest_title, region_id, candidate, count(*) AS votes FROM picked GROUP BY 1, 2, 3, 4", _ICR)),
    "agg20_overvoted_choices": (on_marks(summary.overvoted_choices), with_marks("SELECT * FROM set_aside", _ICR)),
    "agg21_image_detail": (on_choices(summary.image_detail), with_marks("""
        SELECT contest_id, image_id, CASE WHEN overvoted THEN image_name || ' [OVERVOTE]'
          ELSE image_name || ' (party=' || party_id || ' region=' || region_id || '): ' || array_to_string(marked, ', ') END AS line
        FROM gathered WHERE overvoted OR len(marked) > 0""", _GATHERED)),
    "agg22_vote_summary": (vote_summary, with_marks("""
        SELECT contest_title, 'totalVotes' AS section, '' AS section_key, candidate, count(*) AS votes FROM picked GROUP BY 1, 4
        UNION ALL SELECT contest_title, 'overvotedChoices', '', candidate, overvotes FROM set_aside
        UNION ALL SELECT contest_title, 'byParty', party_id, candidate, count(*) FROM picked GROUP BY 1, 3, 4
        UNION ALL SELECT contest_title, 'byRegion', region_id, candidate, count(*) FROM picked GROUP BY 1, 3, 4
        UNION ALL SELECT contest_title, 'overvotedBallots', '', '', count(*) FILTER (WHERE overvoted) FROM icr GROUP BY 1""", _ICR)),
    "agg23_write_in_crops": (write_in_crops, with_marks("""
        SELECT image_id, contest_no AS contest_id, candidate_name, image_path, marked, dark_pct,
               abs_left AS image_x, abs_top AS image_y,
               'writein_b' || ballot_no || '_c' || page_number || '_' || contest_no
               || CASE WHEN n > 1 THEN '_' || k ELSE '' END || CASE WHEN marked THEN '' ELSE '_unvoted' END || '.png' AS crop_name
        FROM (SELECT *, row_number() OVER (PARTITION BY image_id, contest_no ORDER BY seq) AS k,
                     count(*) OVER (PARTITION BY image_id, contest_no) AS n
              FROM marks WHERE write_in AND (marked OR dark_pct > 2.0)) JOIN kept USING (image_id)""")),
    "win1_rank_winners": (on_star(tally), with_star(
        "SELECT contest, candidate, voted AS votes, place, winner FROM won", _CONFIG, _RANKED)),
    "win2_results_report": (on_star(winners.results_report), with_star("""
        SELECT contest, candidate, contest_type, max_votes, percent_to_win, voted + overvoted AS marked, overvoted,
               voted AS counted, place, winner FROM won""", _CONFIG, _RANKED)),
    "win3_nondefault_thresholds": (on_star(winners.nondefault_thresholds), with_star(
        "SELECT contest, percent_to_win FROM cfg WHERE percent_to_win <> 50 AND contest IN (SELECT contest FROM tot)", _CONFIG)),
    "win4_no_winner_contests": (on_star(no_winner), with_star("""
        SELECT contest, CAST(80 AS DOUBLE) AS percent_to_win, max(voted) AS leading_votes, CAST(sum(voted) AS BIGINT) AS valid_votes
        FROM ranked WHERE contest_type IN ('PLURALITY', 'MEASURE') AND max_votes <= 1
        GROUP BY contest HAVING NOT (max(voted) > 0.8 * max(total))""", _CONFIG, _RANKED)),
}
