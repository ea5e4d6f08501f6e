"""Shared pieces of the reference SQL: the election view and the star, as CTEs.

The SQL is written for DuckDB and independently of the Spark operators.
"""

from __future__ import annotations

SCANS = """
scans AS MATERIALIZED (
  SELECT o_orderkey AS image_id, o_orderkey // 2 AS ballot_no,
         '/scans/b' || (o_orderkey // 2) || '_c' || (o_orderkey % 2 + 1) || '.png' AS image_path,
         'b' || (o_orderkey // 2) || '_c' || (o_orderkey % 2 + 1) || '.png' AS image_name,
         o_orderdate AS counted_at, CAST(300 AS INTEGER) AS dpi, CAST(200 AS INTEGER) AS warp_dpi,
         CAST(o_orderkey % 2 + 1 AS INTEGER) AS page_number,
         CASE WHEN o_orderkey % 97 = 0 THEN '(not decoded)'
              ELSE n_regionkey || '|' || n_nationkey || '|' || ((o_orderkey // 2) % 3) || '|'
                   || ((o_orderkey // 2) % 2 + 1) || '|1|' || (o_orderkey % 2 + 1) END AS barcode_data,
         CASE WHEN o_orderkey % 101 = 0 THEN 'Corner detection failed' END AS error_message,
         CAST(CAST(round(o_totalprice) AS BIGINT) % 100 AS INTEGER) AS scribble_pixels,
         CAST(round(o_totalprice) AS BIGINT) % 100 >= 90 AS scribble_flagged
  FROM orders JOIN nation ON n_nationkey = (o_orderkey // 2) % 25
),
kept AS MATERIALIZED (SELECT * FROM scans WHERE error_message IS NULL)"""

MEASURES = """
numbered AS (
  SELECT *,
    row_number() OVER (PARTITION BY l_orderkey
                       ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seq,
    CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END + 3 * (l_orderkey % 2) AS c
  FROM lineitem
),
chosen AS (
  SELECT *, CASE WHEN c = 0 THEN least(l_suppkey % 10, 4)
                 WHEN c = 2 THEN CASE WHEN l_suppkey % 10 < 7 THEN 0 ELSE 1 END
                 ELSE l_suppkey % 5 END AS k
  FROM numbered
),
meas AS MATERIALIZED (
  SELECT l_orderkey AS image_id, seq, l_linenumber, CAST(c + 1 AS BIGINT) AS contest_no, CAST(k AS BIGINT) AS candidate_no,
    ['Mayor','Council','Measure','Assessor','Clerk','Board'][c + 1] AS contest_title,
    ['PLURALITY','PLURALITY','MEASURE','RANKED_CHOICE','RANKED_CHOICE','APPROVAL'][c + 1] AS contest_type,
    CAST([1, 2, 1, 1, 1, 99][c + 1] AS INTEGER) AS max_votes,
    CAST([50, 50, 60, 50, 50, 50][c + 1] AS DOUBLE) AS percent_to_win,
    CASE WHEN c = 2 THEN CASE WHEN k = 0 THEN 'Yes' ELSE 'No' END
         WHEN c IN (3, 4) THEN 'Candidate ' || k || ' (Rank ' || ((l_linenumber - 1) % 3 + 1) || ')'
         ELSE 'Candidate ' || k END AS candidate_name,
    CASE WHEN c IN (3, 4) THEN CAST((l_linenumber - 1) % 3 + 1 AS INTEGER) END AS rank_no,
    (c IN (0, 1) AND k = 3) AS write_in,
    greatest(l_quantity - 18, 0) AS raw_pct,
    greatest(l_quantity - 18, 0) + l_linenumber % 4 AS trimmed_pct,
    CAST(10 * l_linenumber AS INTEGER) AS abs_left, CAST(10 * k AS INTEGER) AS abs_top
  FROM chosen
)"""

MARKS = """
judged AS (
  SELECT m.*, raw_pct >= 8 AS plain, raw_pct >= 5 AND raw_pct < 8 AND trimmed_pct >= 8 AS rescued
  FROM meas m JOIN kept USING (image_id)
),
marks AS MATERIALIZED (
  SELECT * EXCLUDE (plain, rescued), plain OR rescued AS marked,
    CASE WHEN rescued THEN trimmed_pct ELSE raw_pct END AS dark_pct
  FROM judged
),
fptp_bad AS MATERIALIZED (
  SELECT image_id, contest_no, count(DISTINCT candidate_no) FILTER (WHERE marked) AS marked_candidates
  FROM marks WHERE contest_type IN ('PLURALITY', 'MEASURE')
  GROUP BY image_id, contest_no
  HAVING count(DISTINCT candidate_no) FILTER (WHERE marked) > max(max_votes)
),
rank_bad AS MATERIALIZED (
  SELECT image_id, contest_no, rank_no FROM marks
  WHERE contest_type = 'RANKED_CHOICE' AND marked
  GROUP BY image_id, contest_no, rank_no HAVING count(*) > 1
),
settled AS MATERIALIZED (
  SELECT m.*, CASE WHEN NOT m.marked THEN 'UNMARKED'
                   WHEN f.image_id IS NOT NULL OR r.image_id IS NOT NULL THEN 'OVERVOTED'
                   ELSE 'VOTED' END AS vote_status
  FROM marks m
  LEFT JOIN fptp_bad f ON f.image_id = m.image_id AND f.contest_no = m.contest_no
  LEFT JOIN rank_bad r ON r.image_id = m.image_id AND r.contest_no = m.contest_no AND r.rank_no = m.rank_no
)"""

STAR = """
bc AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY raw_data) AS id, raw_data,
    string_split(raw_data, '|')[1] AS jurisdiction_id, string_split(raw_data, '|')[2] AS region_id,
    string_split(raw_data, '|')[3] AS party_id, string_split(raw_data, '|')[4] AS ballot_type_id,
    string_split(raw_data, '|')[5] AS election_id, string_split(raw_data, '|')[6] AS page_number
  FROM (SELECT DISTINCT coalesce(barcode_data, '') AS raw_data FROM kept)
),
bi AS MATERIALIZED (
  SELECT k.image_id AS id, image_path, image_name, counted_at, dpi, k.page_number, warp_dpi,
    scribble_flagged, scribble_pixels, bc.id AS barcode_id, ballot_no
  FROM kept k JOIN bc ON bc.raw_data = coalesce(k.barcode_data, '')
),
co AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY contest_title, contest_type) AS id, *
  FROM (SELECT contest_title, contest_type, arg_min(max_votes, (image_id, seq)) AS max_votes,
               arg_min(percent_to_win, (image_id, seq)) AS percent_to_win
        FROM marks GROUP BY contest_title, contest_type)
),
ca AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY contest_id, candidate_name) AS id, *
  FROM (SELECT co.id AS contest_id, candidate_name,
               arg_min(candidate_no, (image_id, seq)) AS ballot_candidate_id,
               arg_min(write_in, (image_id, seq)) AS write_in
        FROM marks JOIN co USING (contest_title, contest_type) GROUP BY co.id, candidate_name)
),
vo AS MATERIALIZED (
  SELECT s.image_id AS ballot_image_id, s.seq, co.id AS contest_id, ca.id AS candidate_id_fk, bi.barcode_id,
    abs_left, abs_top, dark_pct, vote_status
  FROM settled s
  JOIN co USING (contest_title, contest_type)
  JOIN ca ON ca.contest_id = co.id AND ca.candidate_name = s.candidate_name
  JOIN bi ON bi.id = s.image_id
)"""


ROUGH = """
r_scans AS (
  SELECT * REPLACE ('/scans/r' || CASE WHEN image_id % 10 IN (3, 4) THEN image_id - image_id % 10 ELSE image_id END || '.png' AS image_path,
                    CASE WHEN image_id % 89 <> 0 THEN barcode_data END AS barcode_data)
  FROM scans WHERE error_message IS NULL
),
r_kept AS MATERIALIZED (
  SELECT *, coalesce(barcode_data, '') AS raw_data
  FROM (SELECT *, row_number() OVER (PARTITION BY image_path ORDER BY image_id) AS arrival FROM r_scans) WHERE arrival = 1
),
r_marks AS MATERIALIZED (
  SELECT m.image_id, m.seq, m.contest_title, m.contest_type, m.candidate_name, m.rank_no,
    CASE WHEN m.image_id % 13 <> 0 THEN contest_no ELSE -1 END AS contest_no,
    CAST(max_votes + CASE WHEN m.image_id % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS max_votes,
    percent_to_win + CASE WHEN m.image_id % 5 = 0 THEN 10 ELSE 0 END AS percent_to_win,
    CASE WHEN l_linenumber <> 6 THEN candidate_no END AS candidate_no, write_in <> (m.image_id % 19 = 0) AS write_in,
    raw_pct >= 8 OR (raw_pct >= 5 AND trimmed_pct >= 8) AS marked,
    CASE WHEN raw_pct >= 5 AND raw_pct < 8 AND trimmed_pct >= 8 THEN trimmed_pct ELSE raw_pct END AS dark_pct
  FROM meas m JOIN r_kept USING (image_id)
),
r_first AS (
  SELECT image_id, contest_no, arg_min(contest_type, seq) AS first_type, arg_min(max_votes, seq) AS first_max,
    count(DISTINCT coalesce(candidate_no, -1)) FILTER (WHERE marked) AS chosen
  FROM r_marks GROUP BY image_id, contest_no
),
r_ranks AS (
  SELECT image_id, contest_no, rank_no, count(*) AS times FROM r_marks WHERE marked AND rank_no > 0 GROUP BY 1, 2, 3
),
r_settled AS MATERIALIZED (
  SELECT m.*, CASE WHEN NOT marked THEN 'UNMARKED'
    WHEN (first_type IN ('PLURALITY', 'MEASURE') AND chosen > first_max) OR (first_type = 'RANKED_CHOICE' AND coalesce(times, 0) > 1) THEN 'OVERVOTED'
    ELSE 'VOTED' END AS vote_status
  FROM r_marks m JOIN r_first f USING (image_id, contest_no)
  LEFT JOIN r_ranks r ON r.image_id = m.image_id AND r.contest_no = m.contest_no AND r.rank_no = m.rank_no
)"""


def with_rough(body: str, *more: str) -> str:
    return _with([SCANS, MEASURES, ROUGH, *more], body)


def with_scans(body: str, *more: str) -> str:
    return _with([SCANS, *more], body)


def with_marks(body: str, *more: str) -> str:
    return _with([SCANS, MEASURES, MARKS, *more], body)


def with_star(body: str, *more: str) -> str:
    return _with([SCANS, MEASURES, MARKS, STAR, *more], body)


def plain(body: str, *more: str) -> str:
    return _with(list(more), body) if more else body.strip()


def _with(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body.strip()
