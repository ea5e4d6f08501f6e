"""Pixel statistics, scalar functions and file sources, with reference SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import measure, text
from tallyspark.operators import cells, design, ingest
from tallyspark.plans import election
from tallyspark.plans.oracle_base import plain, with_marks, with_scans
from tallyspark.session import new_folder, stage
from tallyspark.sources import audit_log, layouts, scans, truth

_WARP_DPI = 16
_PAD_IN = 0.0625


def samples(spark: SparkSession, d: str) -> DataFrame:
    return cells.sample_regions(election.pixels(spark, d), election.pages(spark, d), election.page_boxes(spark, d))


def page_images(spark: SparkSession, d: str) -> DataFrame:
    """The pages as rows of the image source: B, G, R bytes, white where nothing is drawn."""
    side = election.PAGE_SIDE
    drawn = election.pixels(spark, d).groupBy("image_id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("y") * side + F.col("x"), "lum"))).alias("lums"))
    rows = election.pages(spark, d).join(drawn, "image_id", "left")
    one = F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: F.repeat(
        F.lpad(F.hex(F.coalesce(F.try_element_at("lums", i), F.lit(255))), 2, "0"), F.lit(3)))
    return rows.select("image_id", "barcode", "seq", F.struct(
        F.lit("").alias("origin"), F.lit(side).alias("height"), F.lit(side).alias("width"), F.lit(3).alias("nChannels"),
        F.lit(16).alias("mode"), F.unhex(F.array_join(one, "")).alias("data")).alias("image"))


def sampled_images(spark: SparkSession, d: str) -> DataFrame:
    """Box samples of whole images, which are written and read back."""
    return cells.sample_images(stage(page_images(spark, d), "pages"), election.page_boxes(spark, d))


def sampled_marks(spark: SparkSession, d: str) -> DataFrame:
    """Samples judged by the ingest rule, all box styles."""
    return ingest.classify_marks(samples(spark, d)).select("image_id", "box_id", "marked", "dark_pct", "dark_pixels", "mean_intensity")


def dark_pixels(spark: SparkSession, d: str) -> DataFrame:
    return cells.dark_mask(election.pixels(spark, d))


def _novel(spark: SparkSession, d: str) -> DataFrame:
    return cells.novel_ink(cells.dark_mask(election.pixels(spark, d)), election.pages(spark, d),
                           election.page_boxes(spark, d), _WARP_DPI, pad_in=_PAD_IN)


def novel_ink(spark: SparkSession, d: str) -> DataFrame:
    return _novel(spark, d)


def ink_report(spark: SparkSession, d: str) -> DataFrame:
    return cells.ink_report(_novel(spark, d), election.pages(spark, d), flag_pixels=5)


def ink_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of all dark pixels, which are dense enough to form large shapes."""
    return cells.ink_clusters(cells.dark_mask(election.pixels(spark, d), 150))


_PIXELS = """
px AS MATERIALIZED (
  SELECT l_orderkey // 64 AS image_id, CAST((l_orderkey // 64) % 8 AS VARCHAR) AS barcode, l_orderkey // 64 AS seq,
         CAST(l_partkey % 32 AS INTEGER) AS x, CAST(l_suppkey % 32 AS INTEGER) AS y, CAST(min(100 + 3 * l_quantity) AS INTEGER) AS lum
  FROM lineitem GROUP BY ALL
),
pages_seen AS (SELECT DISTINCT o_orderkey // 64 AS image_id, CAST((o_orderkey // 64) % 8 AS VARCHAR) AS barcode FROM orders),
boxes AS MATERIALIZED (
  SELECT DISTINCT CAST(p_partkey % 8 AS VARCHAR) AS barcode, (p_partkey // 8) % 16 AS box_id,
    ['OVAL', 'ARROW', 'CONNECT_DOTS'][(p_partkey // 8) % 16 % 3 + 1] AS style, (p_partkey // 8) % 16 % 4 = 0 AS write_in,
    (p_partkey // 8) % 16 % 4 * 8 + 1 AS l, (p_partkey // 8) % 16 // 4 * 8 + 1 AS t, 5 AS w, 4 AS h FROM part
),
hits AS (
  SELECT p.image_id, b.box_id, p.lum,
    p.x >= l AND p.x < l + w AND p.y >= t AND p.y < t + h AS in_box,
    p.x >= l + 1 AND p.x < l + w - 1 AND p.y >= t + 1 AND p.y < t + h - 1 AS in_trim,
    CASE style WHEN 'ARROW' THEN p.x >= l + 2 - 1 AND p.x < l + 2 + 1 AND p.y >= t + 2 - 1 AND p.y < t + 2 + 1
               WHEN 'CONNECT_DOTS' THEN p.x = l + 2 AND p.y >= t AND p.y < t + h ELSE false END AS in_zone
  FROM px p JOIN boxes b USING (barcode)
),
sums AS (
  SELECT image_id, box_id, count(*) FILTER (WHERE in_box) AS total, count(*) FILTER (WHERE in_box AND lum < 128) AS dark,
    sum(lum) FILTER (WHERE in_box) AS lums, count(*) FILTER (WHERE in_trim) AS t_total,
    count(*) FILTER (WHERE in_trim AND lum < 128) AS t_dark, sum(lum) FILTER (WHERE in_trim) AS t_lums,
    count(*) FILTER (WHERE in_zone AND lum < 128) AS z
  FROM hits GROUP BY 1, 2
),
sampled AS MATERIALIZED (
  SELECT g.image_id, b.box_id, b.style AS indicator_style, CAST(coalesce(dark, 0) AS INTEGER) AS dark_pixels,
    CAST(CASE WHEN b.style = 'CONNECT_DOTS' THEN 4 ELSE coalesce(total, 0) END AS INTEGER) AS total_pixels,
    CASE WHEN total > 0 THEN 100.0::DOUBLE * dark / total ELSE 0 END AS dark_pct,
    CASE WHEN total > 0 THEN CAST(lums AS DOUBLE) / total ELSE 255 END AS mean_intensity,
    CAST(coalesce(t_dark, 0) AS INTEGER) AS trimmed_dark, CAST(coalesce(t_total, 0) AS INTEGER) AS trimmed_total,
    CASE WHEN t_total > 0 THEN 100.0::DOUBLE * t_dark / t_total ELSE 0 END AS trimmed_pct,
    CASE WHEN t_total > 0 THEN CAST(t_lums AS DOUBLE) / t_total ELSE 255 END AS trimmed_mean,
    CAST(coalesce(z, 0) AS INTEGER) AS zone_dark
  FROM pages_seen g JOIN boxes b USING (barcode) LEFT JOIN sums s ON s.image_id = g.image_id AND s.box_id = b.box_id
)"""
# Whole pages: every position has a pixel, white where nothing is drawn.
_WHOLE_PAGES = _PIXELS.replace("px AS MATERIALIZED", "drawn AS MATERIALIZED", 1).replace("boxes AS MATERIALIZED", """px AS MATERIALIZED (
  SELECT g.image_id, g.barcode, x, y, coalesce(lum, 255) AS lum
  FROM pages_seen g CROSS JOIN (SELECT CAST(a AS INTEGER) AS x, CAST(b AS INTEGER) AS y FROM range(32) u(a), range(32) v(b)) LEFT JOIN drawn USING (image_id, x, y)
),
boxes AS MATERIALIZED""", 1)
_INK = """
firsts AS MATERIALIZED (SELECT barcode, x, y, min(seq) AS seq FROM px WHERE lum < 128 GROUP BY 1, 2, 3),
seeds AS (SELECT barcode, min(image_id) AS seed FROM pages_seen GROUP BY 1),
novel AS MATERIALIZED (
  SELECT f.barcode, f.x, f.y, f.seq, f.seq AS image_id FROM firsts f JOIN seeds s USING (barcode)
  WHERE f.seq > s.seed
    AND NOT EXISTS (SELECT 1 FROM firsts e WHERE e.barcode = f.barcode AND e.seq < f.seq AND abs(e.x - f.x) <= 1 AND abs(e.y - f.y) <= 1)
    AND NOT EXISTS (SELECT 1 FROM boxes b WHERE b.barcode = f.barcode AND f.x >= l - 1 AND f.x < l + w + 1 AND f.y >= t - 1
                    AND f.y < t + h + CASE WHEN write_in THEN 0 ELSE 1 END)
)"""

_CLUSTERS = "WITH RECURSIVE " + _PIXELS.strip() + """,
dk AS MATERIALIZED (SELECT image_id, x, y FROM px WHERE lum < 150),
reach AS (
  SELECT image_id, x, y, x AS rx, y AS ry FROM dk
  UNION SELECT r.image_id, r.x, r.y, p.x, p.y FROM reach r JOIN dk p
    ON p.image_id = r.image_id AND ((p.x = r.rx AND abs(p.y - r.ry) = 1) OR (p.y = r.ry AND abs(p.x - r.rx) = 1))
),
labelled AS (SELECT image_id, x, y, min(ry * 1000 + rx) AS label FROM reach GROUP BY 1, 2, 3)
SELECT image_id, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1, count(*) AS pixels
FROM labelled GROUP BY image_id, label HAVING count(*) >= 8"""

# --- scalar functions --------------------------------------------------------


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """Whole document texts, with characters that need escaping."""
    return election.table(spark, d, "documents").select("doc_id", F.concat(F.lit('a,"b" <c> & \\ '), "text").alias("text"))


def _digest(column: F.Column) -> F.Column:
    """Texts are compared by length and MD5."""
    return F.md5(column.cast("binary"))


def escaped_csv(spark: SparkSession, d: str) -> DataFrame:
    rows = election.table(spark, d, "documents")
    return rows.select("doc_id", _digest(text.csv_escape("text")).alias("escaped"), text.csv_escape("source").alias("source"))


def escaped_html(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("doc_id", _digest(text.html_escape("text")).alias("escaped"))


def escaped_yaml(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("doc_id", _digest(text.yaml_escape("text")).alias("escaped"))


def blanks(spark: SparkSession, d: str) -> DataFrame:
    names = election.table(spark, d, "part").select("p_partkey", F.expr(
        "CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  ' ELSE concat(' ', p_name) END").alias("name"))
    return names.select("p_partkey", text.blank_to("name", "?").alias("name"))


def luminances(spark: SparkSession, d: str) -> DataFrame:
    items = election.table(spark, d, "lineitem").select(
        (F.col("l_partkey") % 256).alias("r"), (F.col("l_suppkey") % 256).alias("g"), (F.col("l_orderkey") % 256).alias("b"))
    lum = measure.luminance(F.col("r"), F.col("g"), F.col("b"))
    return items.groupBy("r", "g", "b", lum.alias("lum")).agg(F.count("*").alias("n"))


def lengths(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_retailprice")
    return election.table(spark, d, "part").select(
        "p_partkey", measure.points_to_inches(size).alias("inches"), measure.points_to_mm(size).alias("mm"),
        measure.inches_to_mm(size).alias("inch_mm"), measure.inches_to_points(size).alias("points"),
        measure.mm_to_points(size).alias("mm_points"))


def globbed(spark: SparkSession, d: str) -> DataFrame:
    """Page addresses matched by a glob, over the whole address."""
    regex = text.glob_to_regex("*://*.?*/*1*")
    return election.table(spark, d, "pages").select("page_id", F.lower("url").rlike(regex).alias("hit"))


def rank_patterns(spark: SparkSession, d: str) -> DataFrame:
    """The four spellings of the rank suffix over all measured names, spaced differently."""
    names = election.measurements(spark, d).select(
        F.when(F.col("image_id") % 3 == 0, F.regexp_replace("candidate_name", r" \(", "(")).when(
            F.col("image_id") % 3 == 1, F.regexp_replace("candidate_name", "Rank ", "Rank  ")).otherwise(F.col("candidate_name")).alias("name"))
    counted = names.groupBy("name").agg(F.count("*").alias("n"))
    return counted.select(
        "name", "n", text.rank_of("name", text.RANK_FULL, 2).alias("tabulated"), text.rank_of("name").alias("found"),
        F.regexp_replace("name", text.RANK_STRIP, "").alias("stripped"), text.rank_of("name", text.RANK_LOOSE, 2).alias("loose"),
        text.rank_or_last("name").alias("sort_rank"))


# --- files -------------------------------------------------------------------


def layouts_from_xml(spark: SparkSession, d: str) -> DataFrame:
    """Box reports in mm written as XML and read back in inches."""
    path = new_folder(spark, "layouts")
    design.write_layout_xml(design.layout_report(election.layout_positions(spark, d), "mm"), path, "mm")
    return _layout_rows(layouts.read_layouts(spark, path + "/*/", fmt="xml"))


def layouts_from_json(spark: SparkSession, d: str) -> DataFrame:
    """The same as JSON, a page per line."""
    path = new_folder(spark, "layouts")
    design.write_layout_json(design.layout_report(election.layout_positions(spark, d), "mm"), path)
    return _layout_rows(layouts.read_layouts(spark, path + "/*/", fmt="jsonl"))


def layouts_from_documents(spark: SparkSession, d: str) -> DataFrame:
    """The same as JSON documents, a file for each combination."""
    path = new_folder(spark, "layouts")
    report = design.layout_report(election.layout_positions(spark, d), "mm")
    design.write_layout_json(design.layout_documents(report).repartition("combinationId"), path)
    return _layout_rows(layouts.read_layouts(spark, path + "/*/", fmt="json"))


def _layout_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        "page_number", "contest_id", "contest_title", "contest_type", "max_votes", "percent_to_win", "candidate_id",
        "candidate_name", "write_in", "indicator_style",
        F.round("content_width", 3).alias("content_width"), F.round("contest_top", 3).alias("contest_top"),
        F.round("indicator_top", 3).alias("indicator_top"))


def resolved_layouts(spark: SparkSession, d: str) -> DataFrame:
    """Every scan's layout, from page files named by a part of the barcodes."""
    names = election.kept_scans(spark, d).filter("ballot_no % 25 % 4 <> 0").select(
        F.concat(F.lit("ballot_"), F.regexp_replace("barcode_data", r"\|", "_"), F.lit(".yaml")).alias("file_name"),
        F.lit(0).alias("side_pos"), "page_number").distinct()
    # Written first: a pattern of many wildcards is slow on what it does not fit, and would meet every scan.
    known = stage(names, "layout-names").filter("file_name LIKE 'ballot_%_%_%_%_%_1.yaml'")
    pages = layouts.layout_pages(known)
    return layouts.resolve_layout(election.scans(spark, d), pages)


def scan_names(spark: SparkSession, d: str) -> DataFrame:
    """A folder listing made of the scans, with other files mixed in."""
    key = F.col("image_id")
    suffix = F.get(F.array(*[F.lit(s) for s in (".png", ".PNG", ".jpeg", ".tif.counted", ".bmp", ".txt", ".png.review")]), (key % 7).cast("int"))
    prefix = F.when(key % 5 == 0, "writein_").otherwise("")
    files = election.scans(spark, d).select(F.format_string("/scans/%s%d%s", prefix, key, suffix).alias("path"))
    return scans.keep_scans(files)


#: Suffixes of the written folder, by order; Spark's text writers name their files.
_SUFFIXES = ("png", "PNG", "jpg", "tif", "bmp", "csv", "counted")


def listed_folder(spark: SparkSession, d: str) -> DataFrame:
    """A tree of folders that Spark writes, with a file per folder and suffix, listed again.

    Files of the folders that end in 7 count as counted, as if the results had them.
    """
    root = new_folder(spark, "scans")
    key = F.col("o_orderkey")
    rows = election.table(spark, d, "orders").select(
        key.cast("string").alias("line"), (key % 20).alias("box"), (key % 2).alias("tray"), (key % 7).alias("kind"))
    for kind, suffix in enumerate(_SUFFIXES):
        of_kind = rows.filter(F.col("kind") == kind).drop("kind").repartition("box", "tray")
        of_kind.write.mode("append").partitionBy("box", "tray").option("extension", suffix).csv(root)
    done = scans.list_scans(spark, root).filter("path LIKE '%/box=%7/%'").select(F.col("path").alias("image_path"))
    left = scans.waiting_scans(spark, root, stage(done, "counted"))
    place = F.regexp_extract("path", r"/(box=\d+/tray=\d+)/[^/]*$", 1)
    return left.select(place.alias("folder"), F.regexp_extract("path", r"\.([A-Za-z]+)$", 1).alias("suffix"),
                       F.lit(scans.any_already_counted(spark, root)).alias("some_counted"))


def truth_files(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "truth")
    truth.write_ground_truth(election.ground_truth(spark, d), path)
    rows = truth.read_ground_truth(spark, path, form="lines")
    return rows.select(*_TRUTH)


def truth_documents(spark: SparkSession, d: str) -> DataFrame:
    """A document per precinct, as the test harness writes it, cut into entries on reading."""
    path = new_folder(spark, "truth")
    truth.write_truth_documents(election.ground_truth(spark, d), path)
    return truth.read_ground_truth(spark, path).select(*_TRUTH)


_TRUTH = ("image_path", "combo_id", "precinct", "party", "contest", "candidate", "counted_as")


def audit_events(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "audit")
    images = election.scans(spark, d).withColumn("image_name", F.concat("image_name", F.lit(', "'), "barcode_data", F.lit('"')))
    audit_log.append_events(audit_log.scan_events(images, "clerk", F.col("counted_at")), path)
    return audit_log.read_events(spark, path)


_LAYOUT_FILES = """
files AS MATERIALIZED (
  SELECT DISTINCT 'ballot_' || replace(barcode_data, '|', '_') || '.yaml' AS file_name, page_number,
         list_reduce(string_split(barcode_data, '|')[1:5], lambda a, b: a || '_' || b) AS layout_key
  FROM kept WHERE ballot_no % 25 % 4 <> 0 AND barcode_data LIKE '%|%|%|%|%|1'
),
asked AS (
  SELECT image_id, page_number, CASE WHEN len(string_split(barcode_data, '|')) >= 5
         THEN list_reduce(string_split(barcode_data, '|')[1:5], lambda a, b: a || '_' || b) END AS layout_key FROM scans
)"""

_LAYOUT_SQL = """
        SELECT CAST(contest_id // 200 + 1 AS INTEGER) AS page_number, contest_id, 'Contest ' || contest_id AS contest_title,
          'PLURALITY' AS contest_type, CAST(1 AS INTEGER) AS max_votes, CAST(50 AS DOUBLE) AS percent_to_win,
          contest_id * 10 + n AS candidate_id, p_name || ' ' || n AS candidate_name, false AS write_in, 'OVAL' AS indicator_style,
          7.5::DOUBLE AS content_width, round((contest_id // 25 % 8) * 1.25::DOUBLE, 3) AS contest_top,
          round((contest_id // 25 % 8) * 1.25::DOUBLE + n * 0.1875::DOUBLE, 3) AS indicator_top
        FROM (SELECT p_partkey AS contest_id, p_name, n FROM part, unnest(range(1, p_size % 4 + 2)) AS u(n) WHERE p_partkey % 11 <> 0)"""

_TRUTH_SQL = with_marks("""
        SELECT image_path, array_to_string(string_split(barcode_data, '|')[1:5], '|') AS combo_id, string_split(barcode_data, '|')[2] AS precinct,
               string_split(barcode_data, '|')[3] AS party, contest, candidate, counted_as
        FROM (SELECT image_id, contest_title AS contest, candidate_name AS candidate,
                     CASE WHEN marked AND l_linenumber <> 7 THEN 'VOTED' ELSE 'UNMARKED' END AS counted_as
              FROM marks WHERE NOT (contest_title = 'Board' AND candidate_name = 'Candidate 4')
              UNION ALL SELECT image_id, contest_title, 'Candidate 9', CASE WHEN marked THEN 'VOTED' ELSE 'UNMARKED' END
              FROM marks WHERE l_linenumber = 5) JOIN kept USING (image_id)""")

QUERIES = {
    "img1_sample_regions": (samples, plain("SELECT * FROM sampled", _PIXELS)),
    "img1_sample_images": (sampled_images, plain("SELECT * FROM sampled", _WHOLE_PAGES)),
    "img1_sampled_marks": (sampled_marks, plain("""
        SELECT image_id, box_id,
          CASE WHEN indicator_style <> 'OVAL' THEN zone_dark > 0 ELSE dark_pct >= 8 OR rescued END AS marked,
          CASE WHEN indicator_style <> 'OVAL' THEN CASE WHEN zone_dark > 0 THEN 100 ELSE 0 END
               WHEN rescued THEN trimmed_pct ELSE dark_pct END AS dark_pct,
          CAST(CASE indicator_style WHEN 'ARROW' THEN 0 WHEN 'CONNECT_DOTS' THEN CASE WHEN zone_dark > 0 THEN 1 ELSE 0 END
               ELSE CASE WHEN rescued THEN trimmed_dark ELSE dark_pixels END END AS INTEGER) AS dark_pixels,
          CASE indicator_style WHEN 'ARROW' THEN 128 WHEN 'CONNECT_DOTS' THEN CASE WHEN zone_dark > 0 THEN 0 ELSE 255 END
               ELSE CASE WHEN rescued THEN trimmed_mean ELSE mean_intensity END END AS mean_intensity
        FROM (SELECT *, dark_pct >= 5 AND dark_pct < 8 AND trimmed_total > 0 AND trimmed_pct >= 8 AS rescued FROM sampled)""", _PIXELS)),
    "img2_dark_mask": (dark_pixels, plain("SELECT * FROM px WHERE lum < 128", _PIXELS)),
    "img3_novel_ink": (novel_ink, plain("SELECT * FROM novel", _PIXELS, _INK)),
    "img3_ink_report": (ink_report, plain("""
        SELECT g.image_id, barcode, g.image_id AS seq, coalesce(n, 0) AS scribble_pixels, coalesce(n, 0) >= 5 AS scribble_flagged
        FROM pages_seen g LEFT JOIN (SELECT image_id, count(*) AS n FROM novel GROUP BY 1) USING (image_id)""", _PIXELS, _INK)),
    "img4_ink_clusters": (ink_clusters, _CLUSTERS),
    "fn1_csv_escape": (escaped_csv, """
        SELECT doc_id, md5(CASE WHEN regexp_matches(text, '[,"\\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END) AS escaped,
               source FROM documents"""),
    "fn2_blank_to": (blanks, """
        SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN ' ' || p_name ELSE '?' END AS name FROM part"""),
    "fn3_html_escape": (escaped_html, """
        SELECT doc_id, md5(replace(replace(replace(replace('a,"b" <c> & \\ ' || text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS escaped
        FROM documents"""),
    "fn4_yaml_escape": (escaped_yaml, """
        SELECT doc_id, md5(replace(replace('a,"b" <c> & \\ ' || text, '\\', '\\\\'), '"', '\\"')) AS escaped FROM documents"""),
    "fn5_luminance": (luminances, """
        SELECT l_partkey % 256 AS r, l_suppkey % 256 AS g, l_orderkey % 256 AS b,
               CAST(((l_partkey % 256) * 299 + (l_suppkey % 256) * 587 + (l_orderkey % 256) * 114) // 1000 AS INTEGER) AS lum, count(*) AS n
        FROM lineitem GROUP BY ALL"""),
    "fn6_lengths": (lengths, """
        SELECT p_partkey, p_retailprice / 72 AS inches, p_retailprice / 72 * 25.4::DOUBLE AS mm, p_retailprice * 25.4::DOUBLE AS inch_mm,
               p_retailprice * 72 AS points, p_retailprice / 25.4::DOUBLE * 72 AS mm_points FROM part"""),
    "fn7_glob_to_regex": (globbed, "SELECT page_id, regexp_matches(lower(url), '.*://.*[.]..*/.*1.*') AS hit FROM pages"),
    "fn8_rank_patterns": (rank_patterns, with_marks("""
        SELECT name, n, CAST(nullif(regexp_extract(name, '^(.+?)\\s+\\(Rank\\s+(\\d+)\\)$', 2), '') AS INTEGER) AS tabulated,
               CAST(nullif(regexp_extract(name, '\\(Rank (\\d+)\\)$', 1), '') AS INTEGER) AS found,
               regexp_replace(name, '\\s*\\(Rank \\d+\\)$', '') AS stripped,
               CAST(nullif(regexp_extract(name, '^(.+?)\\s*\\(Rank\\s*(\\d+)\\)$', 2), '') AS INTEGER) AS loose,
               CAST(coalesce(nullif(regexp_extract(name, '\\(Rank (\\d+)\\)$', 1), ''), '99') AS INTEGER) AS sort_rank
        FROM (SELECT CASE image_id % 3 WHEN 0 THEN replace(candidate_name, ' (', '(') WHEN 1 THEN replace(candidate_name, 'Rank ', 'Rank  ')
                     ELSE candidate_name END AS name, count(*) AS n FROM meas GROUP BY 1)""")),
    "src1_read_layouts": (layouts_from_xml, _LAYOUT_SQL),
    "src1_layout_pages": (layouts_from_json, _LAYOUT_SQL),
    "src1_layout_documents": (layouts_from_documents, _LAYOUT_SQL),
    "src2_resolve_layout": (resolved_layouts, with_scans("""
        SELECT a.image_id,
          CASE WHEN k.layout_key IS NOT NULL THEN coalesce(e.file_name, k.file_name) ELSE coalesce(p.file_name, o.file_name) END AS layout_file,
          CAST(1 AS INTEGER) AS layout_page
        FROM asked a
        LEFT JOIN (SELECT layout_key, page_number, min(file_name) AS file_name FROM files GROUP BY 1, 2) e
          ON e.layout_key = a.layout_key AND e.page_number = a.page_number
        LEFT JOIN (SELECT layout_key, min(file_name) AS file_name FROM files GROUP BY 1) k ON k.layout_key = a.layout_key
        LEFT JOIN (SELECT page_number, min(file_name) AS file_name FROM files GROUP BY 1) p ON p.page_number = a.page_number
        CROSS JOIN (SELECT min(file_name) AS file_name FROM files) o""", _LAYOUT_FILES)),
    "src3_list_scans": (scan_names, """
        SELECT '/scans/' || CASE WHEN o_orderkey % 5 = 0 THEN 'writein_' ELSE '' END || o_orderkey
               || ['.png', '.PNG', '.jpeg', '.tif.counted', '.bmp', '.txt', '.png.review'][o_orderkey % 7 + 1] AS path
        FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 IN (0, 1, 2, 4)"""),
    "src3_listed_folder": (listed_folder, """
        SELECT DISTINCT 'box=' || o_orderkey % 20 || '/tray=' || o_orderkey % 2 AS folder,
               ['png', 'PNG', 'jpg', 'tif', 'bmp'][o_orderkey % 7 + 1] AS suffix, true AS some_counted
        FROM orders WHERE o_orderkey % 7 < 5 AND o_orderkey % 10 <> 7"""),
    "src5_read_ground_truth": (truth_files, _TRUTH_SQL),
    "src5_truth_documents": (truth_documents, _TRUTH_SQL),
    "src6_audit_events": (audit_events, with_scans("""
        SELECT strftime(counted_at, '%Y-%m-%d %H:%M:%S') AS event_time, 'SCAN' AS event, 'clerk' AS username,
               image_name || ', "' || barcode_data || '"' AS detail FROM scans""")),
}
