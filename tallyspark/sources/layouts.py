"""Ballot layouts: reading the box reports and finding the one for a scan.

A layout file describes one printed page, so a file is a small unit of work; the
set of files is what Spark distributes.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark import schema as S
from tallyspark.functions import measure
from tallyspark.session import stage

_LOG = logging.getLogger(__name__)

# Fixed values.
FORMATS = {"yaml": r"\.ya?ml$", "xml": r"\.xml$", "json": r"\.json$", "jsonl": r"\.json$"}
CORNER_ORDER = ("TL", "TR", "BR", "BL")
PAGE_MARK_ORDER = ("PTL", "PTR")
_NO_LINE_END = "\u0001\u0002\u0001\u0003\u0001"   # raw control characters cannot stand in JSON
NUMERIC = ("maxVotes", "percentToWin")   # in YAML these count only when they are numbers

_BOX = "struct<offsetFromLeft:string,offsetFromTop:string,width:string,height:string>"
_MARKS = "array<struct<corner:string,x:string,y:string>>"
_SIDE_FIELDS = {
    "side_number": "string", "ballotContentArea": _BOX, "cornerMarks": _MARKS, "pageMarks": _MARKS,
    "barcodeCentre": "struct<x:string,y:string>",
    "contests": f"""array<struct<
    id:string,title:string,contestType:string,maxVotes:string,percentToWin:string,boundingBox:{_BOX},
    candidates:array<struct<
      id:string,name:string,writeIn:string,
      indicator:struct<offsetFromLeft:string,offsetFromTop:string,width:string,height:string,indicatorStyle:string>>>>>""",
}
_SIDE = "struct<" + ",".join(f"{name}:{kind}" for name, kind in _SIDE_FIELDS.items()) + ">"
# In the JSON form a setting keeps its type, as only numbers count.
_VARIANTS = ("maxVotes:string,percentToWin:string", "maxVotes:variant,percentToWin:variant")
_JSON_REPORT = f"unit string, sides array<{_SIDE.replace(*_VARIANTS)}>, " + ", ".join(
    f"{name} {kind.replace(*_VARIANTS)}" for name, kind in _SIDE_FIELDS.items())
_XML_MARKS = "struct<mark:array<struct<_corner:string,x:string,y:string>>>"
_XML_REPORT = f"""_unit string, side array<struct<
  _number:string, ballotContentArea:{_BOX}, cornerMarks:{_XML_MARKS},
  contests:struct<contest:array<struct<
    _id:string,_title:string,_contestType:string,_maxVotes:string,_percentToWin:string,boundingBox:{_BOX},
    candidates:struct<candidate:array<struct<
      _id:string,_name:string,_writeIn:string,
      indicator:struct<offsetFromLeft:string,offsetFromTop:string,width:string,height:string,_indicatorStyle:string>>>>>>>>>"""


def _text(value: object) -> object:
    """Scalars as text, so that quoted and bare numbers read alike."""
    if isinstance(value, dict):
        return {str(k): _text(None if k in NUMERIC and isinstance(v, (str, bool)) else v) for k, v in value.items()}
    if isinstance(value, list):
        return [_text(v) for v in value]
    if isinstance(value, bool):
        return str(value).lower()
    return None if value is None else str(value)


def _parse_yaml(batches: Iterator) -> Iterator:
    """One JSON document per readable file; a bad file is skipped with a warning."""
    import json

    import pandas as pd

    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError("reading YAML layouts needs the yaml module on the executors") from missing
    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    for batch in batches:
        paths, documents = [], []
        for path, content in zip(batch["path"], batch["content"]):
            try:
                report = yaml.load(bytes(content), Loader=loader)
                document = json.dumps(_text({"unit": report.get("unit"), "sides": report.get("sides") or []}))
            except Exception as error:  # noqa: BLE001 - any unreadable file is skipped
                _LOG.warning("could not load %s: %s", path, error)
                continue
            paths.append(path)
            documents.append(document)
        if paths:
            yield pd.DataFrame({"path": paths, "document": documents})


def _files(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return files.filter(F.lower("path").rlike(FORMATS[fmt]))


def _yaml_sides(spark: SparkSession, path: str) -> DataFrame:
    documents = _files(spark, path, "yaml").select("path", "content").mapInPandas(_parse_yaml, "path string, document string")
    report = F.from_json("document", f"struct<unit:string,sides:array<{_SIDE}>>")
    return documents.select("path", report.alias("r")).select(
        "path", F.coalesce("r.unit", F.lit("inches")).alias("unit"), F.posexplode("r.sides").alias("side_pos", "side")
    )


def _xml_sides(spark: SparkSession, path: str) -> DataFrame:
    reports = (
        spark.read.format("xml").option("rowTag", "ballotBoundingBoxReport").option("pathGlobFilter", "*.[xX][mM][lL]")
        .schema(_XML_REPORT).load(path)
        .select(F.col("_metadata.file_path").alias("path"), F.coalesce("_unit", F.lit("inches")).alias("unit"), "side")
    )
    rows = reports.select("path", "unit", F.posexplode("side").alias("side_pos", "x"))

    def contest(c: Column) -> Column:
        return F.struct(
            c["_id"].alias("id"), F.coalesce(c["_title"], F.lit("")).alias("title"),
            c["_contestType"].alias("contestType"), c["_maxVotes"].alias("maxVotes"),
            c["_percentToWin"].alias("percentToWin"), c["boundingBox"].alias("boundingBox"),
            F.transform(c["candidates"]["candidate"], candidate).alias("candidates"),
        )

    def candidate(k: Column) -> Column:
        box = k["indicator"]
        return F.struct(
            k["_id"].alias("id"), k["_name"].alias("name"), k["_writeIn"].alias("writeIn"),
            F.struct(*[box[n].alias(n) for n in ("offsetFromLeft", "offsetFromTop", "width", "height")],
                     box["_indicatorStyle"].alias("indicatorStyle")).alias("indicator"),
        )

    side = F.struct(
        F.col("x._number").alias("side_number"),
        F.col("x.ballotContentArea").alias("ballotContentArea"),
        F.transform("x.cornerMarks.mark", lambda m: F.struct(m["_corner"].alias("corner"), m["x"].alias("x"), m["y"].alias("y"))).alias("cornerMarks"),
        F.lit(None).cast(_MARKS).alias("pageMarks"),
        F.lit(None).cast("struct<x:string,y:string>").alias("barcodeCentre"),
        F.transform("x.contests.contest", contest).alias("contests"),
    )
    return rows.select("path", "unit", "side_pos", side.alias("side"))


def _json_sides(spark: SparkSession, path: str, whole_files: bool) -> DataFrame:
    """Sides of JSON reports, read by the schema: a document per file, or a page per line.

    A document has ``sides``, a page is a side itself.  What is not JSON has neither and
    gives no rows.  A document is read as one long line: with ``multiLine`` Spark goes back to
    the file for every bare number that is wanted as text, which multiplies the bytes read.
    """
    reader = spark.read.schema(_JSON_REPORT).option("pathGlobFilter", "*.[jJ][sS][oO][nN]")
    if whole_files:
        reader = reader.option("lineSep", _NO_LINE_END)
    reports = reader.json(path).withColumn("path", F.col("_metadata.file_path"))
    names = tuple(_SIDE_FIELDS)
    is_page = F.col("contests").isNotNull() | F.col("ballotContentArea").isNotNull()
    page = F.when(is_page, F.array(F.struct(*names)))
    rows = reports.select("path", F.coalesce("unit", F.lit("inches")).alias("unit"),
                          F.posexplode(F.coalesce("sides", page)).alias("side_pos", "x"))

    def number(value: Column) -> Column:
        kind = F.schema_of_variant(value)
        return F.when(~kind.isin("STRING", "BOOLEAN"), F.try_variant_get(value, "$", "string"))

    def contest(c: Column) -> Column:
        return c.withField("maxVotes", number(c["maxVotes"])).withField("percentToWin", number(c["percentToWin"]))

    return rows.select("path", "unit", "side_pos", F.struct(
        *[F.col(f"x.{n}").alias(n) for n in names if n != "contests"],
        F.transform("x.contests", contest).alias("contests")).alias("side"))


def _number(c: Column, unit: Column) -> Column:
    """First token of a text as inches; 0 when it is no number."""
    value = F.coalesce(F.get(F.split(F.trim(c), r"\s+"), 0).try_cast("double"), F.lit(0.0))
    return F.when(F.lower(unit) == "mm", value / measure.MM_PER_INCH).otherwise(value)


def _marks(marks: Column, order: tuple[str, ...], unit: Column) -> Column:
    """[x, y] per corner in a fixed order; a corner that is not given stays at 0, 0."""
    def corner(name: str) -> Column:
        found = F.get(F.reverse(F.filter(marks, lambda m: m["corner"] == name)), 0)
        return F.array(_number(found["x"], unit), _number(found["y"], unit))

    return F.when(F.size(marks) > 0, F.array(*[corner(n) for n in order]))


def read_layouts(spark: SparkSession, path: str, fmt: str = "yaml") -> DataFrame:
    """One row per indicator of every layout file in a folder.

    Files of the preferred format are read; of ``yaml`` and ``xml`` the other one only when
    there is none.  ``json`` reads a document per file and ``jsonl`` a page per line, both
    without Python on the executors.  Offsets come out in inches whatever unit the file states.
    """
    if fmt in ("json", "jsonl"):
        sides = _json_sides(spark, path, whole_files=fmt == "json")
    else:
        other = "xml" if fmt == "yaml" else "yaml"
        used = other if _files(spark, path, fmt).select("path").isEmpty() else fmt
        sides = _xml_sides(spark, path) if used == "xml" else _yaml_sides(spark, path)
    unit = F.col("unit")
    contests = sides.select("*", F.posexplode_outer("side.contests").alias("contest_pos", "c"))
    boxes = contests.select("*", F.posexplode_outer("c.candidates").alias("candidate_pos", "k"))
    has_contest, has_candidate = F.col("c").isNotNull(), F.col("k").isNotNull()

    def box(parent: str, prefix: str) -> list[Column]:
        names = {"offsetFromLeft": "left", "offsetFromTop": "top", "width": "width", "height": "height"}
        return [_number(F.col(f"{parent}.{n}"), unit).alias(f"{prefix}_{short}") for n, short in names.items()]

    return boxes.select(
        F.col("path").alias("source_file"),
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        "side_pos",
        F.coalesce(F.col("side.side_number").try_cast("int"), F.lit(1)).alias("page_number"),
        *box("side.ballotContentArea", "content"),
        F.when(F.col("side.barcodeCentre").isNotNull(), _number(F.col("side.barcodeCentre.x"), unit)).alias("barcode_x"),
        F.when(F.col("side.barcodeCentre").isNotNull(), _number(F.col("side.barcodeCentre.y"), unit)).alias("barcode_y"),
        _marks(F.col("side.cornerMarks"), CORNER_ORDER, unit).alias("corner_marks"),
        _marks(F.col("side.pageMarks"), PAGE_MARK_ORDER, unit).alias("page_marks"),
        "contest_pos",
        F.col("c.id").try_cast("bigint").alias("contest_id"),
        F.when(has_contest, F.coalesce("c.title", F.lit(""))).alias("contest_title"),
        F.when(has_contest, F.coalesce("c.contestType", F.lit(S.DEFAULT_CONTEST_TYPE))).alias("contest_type"),
        F.when(has_contest, F.coalesce(F.col("c.maxVotes").try_cast("int"), F.lit(S.DEFAULT_MAX_VOTES))).alias("max_votes"),
        F.when(has_contest, F.coalesce(F.col("c.percentToWin").try_cast("double"), F.lit(S.DEFAULT_PERCENT_TO_WIN)))
        .alias("percent_to_win"),
        *box("c.boundingBox", "contest"),
        "candidate_pos",
        F.col("k.id").try_cast("bigint").alias("candidate_id"),
        F.when(has_candidate, F.coalesce("k.name", F.lit(""))).alias("candidate_name"),
        F.when(has_candidate, F.coalesce(F.lower("k.writeIn") == "true", F.lit(False))).alias("write_in"),
        *box("k.indicator", "indicator"),
        F.when(has_candidate, F.coalesce("k.indicator.indicatorStyle", F.lit(S.DEFAULT_INDICATOR_STYLE))).alias("indicator_style"),
    )


def layout_pages(layouts: DataFrame) -> DataFrame:
    """The distinct pages of a set of layouts with the barcode key in their file name."""
    name = F.lower("file_name")
    key = F.regexp_extract(name, r"^ballot_([^_]*_[^_]*_[^_]*_[^_]*_[^_]*)_", 1)
    return layouts.select("file_name", "side_pos", "page_number", F.nullif(key, F.lit("")).alias("layout_key")).distinct()


def resolve_layout(images: DataFrame, pages: DataFrame) -> DataFrame:
    """The layout page for each image (``image_id``, ``barcode_data``, ``page_number``).

    Layouts named after the first five barcode fields come first; without such a
    layout all of them are candidates.  Among the candidates the page with the
    image's number is taken, else the first by file name.  Each preference is
    reduced to one row per key before it is joined.
    """
    order = F.struct("file_name", "side_pos", "page_number")
    # Written once: four small tables come from it, and what finds the pages runs once.
    pages = stage(pages.select("layout_key", "file_name", "side_pos", "page_number"), "layout-pages")
    keyed = pages.filter(F.col("layout_key").isNotNull())
    exact = stage(keyed.groupBy("layout_key", "page_number").agg(F.min(order).alias("exact")), "layout-exact")
    by_key = stage(keyed.groupBy("layout_key").agg(F.min(order).alias("any_page")), "layout-key")
    by_page = stage(pages.groupBy("page_number").agg(F.min(order).alias("any_key")), "layout-page")
    first = pages.agg(F.min(order).alias("first")).first()["first"]
    if first is None:
        fallback = F.lit(None).cast("struct<file_name:string,side_pos:int,page_number:int>")
    else:
        fallback = F.struct(F.lit(first["file_name"]).alias("file_name"), F.lit(first["side_pos"]).alias("side_pos"),
                            F.lit(first["page_number"]).alias("page_number"))
    parts = F.split("barcode_data", r"\|")
    key = F.when(F.size(parts) >= 5, F.lower(F.array_join(F.slice(parts, 1, 5), "_")))
    return (
        images.withColumn("layout_key", key)
        .join(exact, ["layout_key", "page_number"], "left")
        .join(by_key, "layout_key", "left")
        .join(by_page, "page_number", "left")
        .withColumn(
            "layout",
            F.when(F.col("any_page").isNotNull(), F.coalesce("exact", "any_page")).otherwise(F.coalesce(F.col("any_key"), fallback)),
        )
        .select("image_id", F.col("layout.file_name").alias("layout_file"), F.col("layout.page_number").alias("layout_page"))
    )
