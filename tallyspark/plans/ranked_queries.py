"""Ranked choice and audit exports over the election view, with reference SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import text
from tallyspark.operators import audit, ranked
from tallyspark.plans import election
from tallyspark.plans.oracle_base import with_star
from tallyspark.plans.report_queries import on_star


def parsed_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Every measured name, split the way the tabulation reads it."""
    names = election.measurements(spark, d).groupBy("candidate_name").agg(F.count("*").alias("boxes"))
    parts = text.parse_rank("candidate_name")
    return names.select(
        "candidate_name", "boxes",
        F.coalesce(text.ranked_base("candidate_name"), "candidate_name").alias("base"),
        text.rank_of("candidate_name", text.RANK_FULL, 2).alias("rank"),
        parts["rank_label"].alias("label"),
        parts["ranked_choice"].alias("ranked"),
    )


def ballots(spark: SparkSession, d: str, rule: str = "cut") -> DataFrame:
    return ranked.ranked_ballots(election.results(spark, d), rule)


def ballot_lists(spark: SparkSession, d: str) -> DataFrame:
    return ballots(spark, d).withColumn("prefs", F.array_join("prefs", ">"))


def exhausted_lists(spark: SparkSession, d: str) -> DataFrame:
    return ballots(spark, d, "exhaust").withColumn("prefs", F.array_join("prefs", ">"))


_ROUND_COLUMNS = ("contest_id", "round", "candidate", "votes", "active", "majority", "fate", "tiebreak")


def rounds(spark: SparkSession, d: str) -> DataFrame:
    return ranked.irv_rounds(ballots(spark, d)).select(*_ROUND_COLUMNS)


def results(spark: SparkSession, d: str) -> DataFrame:
    counted = ballots(spark, d)
    return ranked.irv_results(counted, ranked.irv_rounds(counted))


def round_report(spark: SparkSession, d: str) -> DataFrame:
    return ranked.irv_round_report(ranked.irv_rounds(ballots(spark, d))).drop("fate", "after_tiebreak")


def second_rule(spark: SparkSession, d: str) -> DataFrame:
    return ranked.irv_rounds(ballots(spark, d, "last_wins"), "declare_tie").select(*_ROUND_COLUMNS)


def physical(spark: SparkSession, d: str) -> DataFrame:
    return audit.physical_ballots(election.results(spark, d))


_BALLOTS = """
rank_marks AS (
  SELECT vo.contest_id, vo.ballot_image_id, ca.candidate_name,
    regexp_extract(ca.candidate_name, '^(.+?)\\s+\\(Rank\\s+(\\d+)\\)$', 1) AS base,
    CAST(regexp_extract(ca.candidate_name, '^(.+?)\\s+\\(Rank\\s+(\\d+)\\)$', 2) AS INTEGER) AS rk, vo.vote_status
  FROM vo JOIN ca ON ca.id = vo.candidate_id_fk JOIN co ON co.id = vo.contest_id
  WHERE co.contest_type = 'RANKED_CHOICE' AND vo.vote_status <> 'UNMARKED'
),
per_rank AS (
  SELECT contest_id, ballot_image_id, rk, arg_max(base, candidate_name) AS base, count(*) AS n
  FROM rank_marks WHERE vote_status = 'VOTED' GROUP BY 1, 2, 3
),
cuts AS (
  SELECT contest_id, ballot_image_id, min(rk) AS cut FROM {cuts} GROUP BY 1, 2
),
lists AS MATERIALIZED (
  SELECT p.contest_id, p.ballot_image_id, list(base ORDER BY rk) AS prefs
  FROM per_rank p LEFT JOIN cuts c USING (contest_id, ballot_image_id)
  WHERE rk >= 1 AND (cut IS NULL OR rk < cut) GROUP BY 1, 2
)"""
_CUT = _BALLOTS.format(cuts="per_rank WHERE n > 1")
_EXHAUST = _BALLOTS.format(cuts="""(SELECT contest_id, ballot_image_id, rk FROM per_rank WHERE n > 1 UNION ALL
    SELECT contest_id, ballot_image_id, rk FROM rank_marks WHERE vote_status = 'OVERVOTED')""")
_LAST = _BALLOTS.format(cuts="per_rank WHERE n < 0")


def _unrolled(rounds_wanted: int, declare_tie: bool) -> str:
    """Elimination rounds written out one after the other; five names need at most five."""
    ctes = ["w AS MATERIALIZED (SELECT contest_id, prefs, count(*) AS weight FROM lists GROUP BY 1, 2)",
            "e0 AS (SELECT DISTINCT contest_id, CAST([] AS VARCHAR[]) AS gone, true AS is_open FROM w)"]
    for i in range(1, rounds_wanted + 1):
        ctes.append(f"""
c{i} AS (
  SELECT contest_id, candidate, CAST(sum(weight) AS BIGINT) AS votes FROM (
    SELECT w.contest_id, list_filter(w.prefs, lambda x: NOT list_contains(e.gone, x))[1] AS candidate, w.weight
    FROM w JOIN e{i - 1} e USING (contest_id) WHERE e.is_open) WHERE candidate IS NOT NULL GROUP BY 1, 2
),
s{i} AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY contest_id ORDER BY votes DESC, candidate) AS INTEGER) AS place,
    CAST(sum(votes) OVER (PARTITION BY contest_id) AS BIGINT) AS active, count(*) OVER (PARTITION BY contest_id) AS standing,
    max(votes) OVER (PARTITION BY contest_id) AS hi, min(votes) OVER (PARTITION BY contest_id) AS lo,
    max(candidate) OVER (PARTITION BY contest_id) AS last_name FROM c{i}
),
d{i} AS (
  SELECT *, active // 2 + 1 AS majority, (hi >= active // 2 + 1 OR standing = 1) AS decided,
    {'(standing = 2 OR hi = lo)' if declare_tie else '(standing = 2 AND hi = lo)'} AS tied FROM s{i}
),
r{i} AS MATERIALIZED (
  SELECT contest_id, CAST({i} AS INTEGER) AS round, candidate, votes, place, active, majority,
    CASE WHEN decided THEN CASE WHEN place = 1 THEN 'winner' ELSE 'continuing' END
         WHEN tied THEN 'tied'
         WHEN {'false' if declare_tie else 'hi = lo'} THEN CASE WHEN candidate = last_name THEN 'eliminated' ELSE 'continuing' END
         WHEN votes = lo THEN 'eliminated' ELSE 'continuing' END AS fate,
    {'false' if declare_tie else '(NOT decided AND NOT tied AND hi = lo)'} AS tiebreak,
    CASE WHEN decided THEN 'winner' WHEN tied THEN 'tie' END AS outcome
  FROM d{i}
),
e{i} AS (
  SELECT e.contest_id, list_concat(e.gone, coalesce(x.names, CAST([] AS VARCHAR[]))) AS gone,
         e.is_open AND x.is_open AS is_open
  FROM e{i - 1} e JOIN (SELECT contest_id, list(candidate) FILTER (WHERE fate = 'eliminated') AS names,
                               bool_and(outcome IS NULL) AS is_open FROM r{i} GROUP BY 1) x USING (contest_id)
)""".strip())
    union = " UNION ALL ".join(f"SELECT * FROM r{i}" for i in range(1, rounds_wanted + 1))
    ctes.append(f"hist AS ({union})")
    return ",\n".join(ctes)


_IRV = _unrolled(5, declare_tie=False)
_IRV_TIE = _unrolled(5, declare_tie=True)
_HIST = "SELECT contest_id, round, candidate, votes, active, majority, fate, tiebreak FROM hist"

_PHYSICAL = """
keyed AS (
  SELECT bi.id AS image_id, bi.page_number, bc.*,
    coalesce(nullif(trim(jurisdiction_id), ''), '0') || '|' || coalesce(nullif(trim(region_id), ''), '0') || '|'
    || coalesce(nullif(trim(party_id), ''), '0') || '|' || coalesce(nullif(trim(ballot_type_id), ''), '0') || '|'
    || coalesce(nullif(trim(election_id), ''), '0') || '|' || regexp_replace(image_name, '_c\\d+\\.png.*$', '') AS ballot_key
  FROM bi JOIN bc ON bc.id = bi.barcode_id
),
paper AS MATERIALIZED (
  SELECT ballot_key, coalesce(min(image_id) FILTER (WHERE page_number = 1), min(image_id)) AS anchor_id,
         min(image_id) AS first_id, count(*) AS pages FROM keyed GROUP BY 1
),
entry AS (
  SELECT p.anchor_id, vo.contest_id, co.contest_type, ca.candidate_name, ca.write_in, vo.vote_status,
    vo.ballot_image_id AS page_image, vo.seq
  FROM vo JOIN keyed k ON k.image_id = vo.ballot_image_id JOIN paper p USING (ballot_key)
  JOIN co ON co.id = vo.contest_id JOIN ca ON ca.id = vo.candidate_id_fk
),
cells AS MATERIALIZED (
  SELECT anchor_id, contest_id,
    CASE WHEN count(*) FILTER (WHERE vote_status = 'OVERVOTED') > 0 THEN 'OVERVOTE'
         ELSE coalesce(string_agg(
           CASE WHEN contest_type = 'RANKED_CHOICE' THEN regexp_replace(candidate_name, '\\(Rank (\\d+)\\)$', '(\\1)')
                WHEN write_in THEN 'WRITE-IN' ELSE candidate_name END, '|'
           ORDER BY CASE WHEN contest_type = 'RANKED_CHOICE'
                         THEN CAST(regexp_extract(candidate_name, '\\(Rank (\\d+)\\)$', 1) AS INTEGER) ELSE 0 END, page_image, seq)
           FILTER (WHERE vote_status = 'VOTED'), '') END AS cell
  FROM entry GROUP BY 1, 2
)"""

QUERIES = {
    "rcv1_parse_rank": (parsed_ranks, with_star("""
        SELECT candidate_name, count(*) AS boxes,
               CASE WHEN any_value(rank_no) IS NULL THEN candidate_name
                    ELSE regexp_replace(candidate_name, ' \\(Rank \\d+\\)$', '') END AS base,
               any_value(rank_no) AS rank,
               CASE WHEN any_value(rank_no) IS NOT NULL THEN 'Rank ' || any_value(rank_no) END AS label,
               any_value(rank_no) IS NOT NULL AS ranked
        FROM meas GROUP BY candidate_name""")),
    "rcv2_ranked_ballots": (ballot_lists, with_star("""
        SELECT contest_id, contest_title, ballot_image_id, array_to_string(prefs, '>') AS prefs
        FROM lists JOIN co ON co.id = contest_id""", _CUT)),
    "rcv2_ranked_ballots_exhaust": (exhausted_lists, with_star("""
        SELECT contest_id, contest_title, ballot_image_id, array_to_string(prefs, '>') AS prefs
        FROM lists JOIN co ON co.id = contest_id""", _EXHAUST)),
    "rcv3_irv_rounds": (rounds, with_star(_HIST, _CUT, _IRV)),
    "rcv4_irv_results": (results, with_star("""
        SELECT contest_id, total_ballots, rounds, winner, coalesce(outcome, 'no_majority') AS outcome
        FROM (SELECT contest_id, count(*) AS total_ballots FROM lists GROUP BY 1)
        JOIN (SELECT contest_id, max(round) AS rounds, max(candidate) FILTER (WHERE fate = 'winner') AS winner,
                     max(outcome) AS outcome FROM hist GROUP BY 1) USING (contest_id)""", _CUT, _IRV)),
    "rcv5_irv_round_report": (round_report, with_star("""
        SELECT h.contest_id, h.round, h.candidate, h.votes, h.active, h.majority,
               100.0::DOUBLE * h.votes / h.active AS pct_of_active,
               CASE WHEN h.round > 1 THEN h.votes - coalesce(f.votes, 0) END AS change_vs_first,
               p.names AS redistributed_from, p.moved AS redistributed_votes
        FROM hist h LEFT JOIN hist f ON f.contest_id = h.contest_id AND f.candidate = h.candidate AND f.round = 1
        LEFT JOIN (SELECT contest_id, round, string_agg(candidate, ', ' ORDER BY place) FILTER (WHERE fate = 'eliminated') AS names,
                          CAST(sum(votes) FILTER (WHERE fate = 'eliminated') AS BIGINT) AS moved FROM hist GROUP BY 1, 2) p
          ON p.contest_id = h.contest_id AND p.round = h.round - 1""", _CUT, _IRV)),
    "rcv6_irv_rounds_second_rule": (second_rule, with_star(_HIST, _LAST, _IRV_TIE)),
    "rla1_ballot_manifest": (on_star(audit.ballot_manifest), with_star("""
        SELECT coalesce(nullif(trim(jurisdiction_id), ''), '1') AS container,
               coalesce(nullif(trim(region_id), ''), '?') || '-' || coalesce(nullif(trim(ballot_type_id), ''), '1') AS batch_name,
               count(*) AS ballots
        FROM bi JOIN bc ON bc.id = bi.barcode_id WHERE bi.page_number = 1 GROUP BY 1, 2""")),
    "rla2_physical_ballots": (physical, with_star("SELECT * FROM paper", _PHYSICAL)),
    "rla3_contest_cells": (on_star(audit.contest_cells), with_star("SELECT * FROM cells", _PHYSICAL)),
    "rla4_cvr_export": (on_star(audit.cvr_export), with_star("""
        SELECT row_number() OVER (ORDER BY first_id) AS cvr_number, CAST(1 AS INTEGER) AS tabulator_num,
               coalesce(region_id, '?') || '-' || coalesce(ballot_type_id, '1') AS batch_id, p.anchor_id AS record_id,
               'J' || coalesce(jurisdiction_id, '?') || '-P' || coalesce(party_id, '0') || '-T' || coalesce(ballot_type_id, '1') AS ballot_type,
               'Region-' || coalesce(region_id, '?') AS precinct_portion,
               coalesce("Assessor", '') AS "Assessor", coalesce("Board", '') AS "Board", coalesce("Clerk", '') AS "Clerk",
               coalesce("Council", '') AS "Council", coalesce("Mayor", '') AS "Mayor", coalesce("Measure", '') AS "Measure"
        FROM paper p JOIN keyed k ON k.image_id = p.anchor_id
        LEFT JOIN (SELECT anchor_id, max(cell) FILTER (WHERE contest_title = 'Assessor') AS "Assessor",
                          max(cell) FILTER (WHERE contest_title = 'Board') AS "Board", max(cell) FILTER (WHERE contest_title = 'Clerk') AS "Clerk",
                          max(cell) FILTER (WHERE contest_title = 'Council') AS "Council", max(cell) FILTER (WHERE contest_title = 'Mayor') AS "Mayor",
                          max(cell) FILTER (WHERE contest_title = 'Measure') AS "Measure"
                   FROM cells JOIN co ON co.id = contest_id GROUP BY 1) x ON x.anchor_id = p.anchor_id""", _PHYSICAL)),
}
