"""Ground truth files: JSON documents that map image paths to what was marked on them.

A document is the image map itself, or wraps it as ``per_image`` beside other entries.
Every document is read as VARIANT, so an entry may have fields, or types of fields, that
nobody asked for.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PORTION = 1000   # equal marks of one image per written line
FORMS = ("auto", "indented", "lines", "whole")
_FIRST_KEY = re.compile(r' +"')

_MARK = {
    "contest": "$.contest", "candidate": "$.candidate", "contest_type": "$.contestType", "max_votes": "$.maxVotes",
    "write_in": "$.writeIn", "action": "$.action", "counted_as": "$.counted_as",
}
_MARK_TYPES = {"max_votes": "int", "write_in": "boolean"}
_ENTRY = ("combo_id", "precinct", "party", "scenario", "distortion")


def read_ground_truth(spark: SparkSession, path: str, form: str = "auto") -> DataFrame:
    """One row per image and indicator.

    ``form`` says how documents lie in the files:

    * ``indented``: one document per file with a line per value, as the test harness writes
      it, wrapped in all files or in none.  Files are cut where an image's entry ends, so one large document is read once,
      by many tasks, and no task holds more than an entry.
    * ``lines``: a document per line, as ``write_ground_truth`` writes it.
    * ``whole``: any one document per file; each is parsed in one piece.
    * ``auto``: ``indented`` if the first file starts like that, else ``lines`` if its first
      line is a document, else ``whole``.

    An entry without indicators has no rows, a missing ``counted_as`` is UNMARKED.  Text that
    is no JSON gives no rows in ``lines`` and ``whole``, and an error in ``indented``.
    """
    if form not in FORMS:
        raise ValueError(f"form {form!r} is none of {FORMS}")
    if form == "auto":
        form = _form_of(spark, path)
    images = _cut_entries(spark, path) if form == "indented" else _parsed_entries(spark, path, form == "whole")
    marks = images.lateralJoin(_each("$.indicators", "entry")).select("image_path", "entry", F.col("value").alias("mark"))

    def read(name: str) -> Column:
        return F.try_variant_get("mark", _MARK[name], _MARK_TYPES.get(name, "string")).alias(name)

    return marks.select(
        "image_path", *[F.try_variant_get("entry", f"$.{name}", "string").alias(name) for name in _ENTRY],
        *[read(name) for name in _MARK if name != "counted_as"],
        F.coalesce(read("counted_as"), F.lit("UNMARKED")).alias("counted_as"),
    )


def _each(path: str, column: str) -> DataFrame:
    """Lateral rows (pos, key, value) of what lies at ``path`` in a variant of the outer row."""
    spark = SparkSession.active()
    return spark.tvf.variant_explode(F.try_variant_get(F.col(column).outer(), path, "variant"))


def _head(spark: SparkSession, path: str) -> list[str]:
    return [r["value"] for r in spark.read.text(path).select("value").limit(2).collect()]


def _form_of(spark: SparkSession, path: str) -> str:
    head = _head(spark, path)
    if len(head) == 2 and head[0].strip() == "{" and _FIRST_KEY.match(head[1]):
        return "indented"
    # One row: whether the first line is a document in itself.
    first = spark.range(1).select(F.try_parse_json(F.lit(head[0] if head else "")).isNotNull().alias("whole")).first()
    return "lines" if first["whole"] else "whole"


def _parsed_entries(spark: SparkSession, path: str, whole_files: bool) -> DataFrame:
    """image_path and entry of documents that are parsed in one piece."""
    texts = spark.read.text(path, wholetext=whole_files).select("value").filter(F.length(F.trim("value")) > 0)
    parsed = texts.select(F.try_parse_json("value").alias("document"))
    wrapped = F.try_variant_get("document", "$.per_image", "variant")
    documents = parsed.select(F.coalesce(wrapped, F.col("document")).alias("images"))
    return documents.lateralJoin(_each("$", "images")).select(F.col("key").alias("image_path"), F.col("value").alias("entry"))


def _cut_entries(spark: SparkSession, path: str) -> DataFrame:
    """image_path and entry of indented documents, cut at the line that closes an entry.

    A raw line end cannot stand inside a JSON string, so a closing brace at the depth of
    the entries is always the end of one.  What else lies beside ``per_image`` has the same
    depth but no indicators, and falls out with the entries that have none.
    """
    head = _head(spark, path)
    step = len(head[1]) - len(head[1].lstrip(" "))
    top = rf'^ {{{step}}}"per_image"\s*:'
    # Where another key comes first, the files are looked through for the one that wraps.
    wrapped = re.match(top, head[1]) or not spark.read.text(path).filter(F.col("value").rlike(top)).isEmpty()
    indent = " " * (2 * step if wrapped else step)
    pieces = spark.read.option("lineSep", f"\n{indent}}}").text(path).select("value")
    # The last line at this depth that opens an object; an entry without content is one line.
    entry = rf'(?s)^(?:.*\n)?{indent}("(?:[^"\\\n]|\\.)*")\s*:\s*(\{{\r?\n.*)$'
    cut = pieces.select(F.regexp_extract("value", entry, 1).alias("key"), F.regexp_extract("value", entry, 2).alias("body"))
    return cut.filter(F.col("key") != "").select(
        F.variant_get(F.parse_json("key"), "$", "string").alias("image_path"),
        F.parse_json(F.concat("body", F.lit("\n}"))).alias("entry"),
    )


def write_ground_truth(truth: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One document per line; an image with very many marks spreads over several lines.

    Equal marks are counted first and written out in portions, so no line holds more
    than a portion of each.
    """
    owner = ("image_path", "combo_id", "precinct", "party")
    counted = truth.groupBy(*owner, "contest", "candidate", "counted_as").agg(F.count("*").alias("n"))
    portions = counted.withColumn("portion", F.explode(F.sequence(F.lit(0), F.expr(f"cast((n - 1) div {PORTION} as int)"))))
    times = F.least(F.lit(PORTION), F.col("n") - F.col("portion") * PORTION).cast("int")
    mark = F.struct("contest", "candidate", "counted_as")
    lines = portions.groupBy(*owner, "portion").agg(F.flatten(F.collect_list(F.array_repeat(mark, times))).alias("indicators"))
    entry = F.create_map("image_path", F.struct("combo_id", "precinct", "party", "indicators"))
    lines.select(F.to_json(F.struct(entry.alias("per_image"))).alias("value")).write.mode(mode).text(path)


def _quoted(name: str) -> Column:
    """The column as a JSON string, or null."""
    listed = F.to_json(F.array(name))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _object(indent: int, *lines: Column) -> Column:
    """An object with a line per field, closed at ``indent``."""
    inner = F.concat_ws(",\n", *[F.concat(F.lit(" " * (indent + 2)), line) for line in lines])
    return F.concat(F.lit("{\n"), inner, F.lit("\n" + " " * indent + "}"))


def _field(name: str) -> Column:
    return F.concat(F.lit(f'"{name}": '), _quoted(name))


def _block(name: str, opened: str, lines: Column, closed: str) -> Column:
    """A named list or object whose lines are already indented."""
    return F.concat(F.lit(f'"{name}": {opened}\n'), lines, F.lit(f"\n      {closed}"))


def write_truth_documents(truth: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One indented document per precinct, laid out as the test harness does.

    ``per_image`` has an entry per image, ``aggregate`` the voted marks per combination,
    ``total_images`` the number of images.  A document is written entry by entry in path
    order; only one entry is held at a time.
    """
    named = truth.withColumn("document", F.coalesce("precinct", F.lit("")))
    owner = ("document", "combo_id", "precinct", "party")

    def joined(text: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_list(text)), ",\n").alias("lines")

    mark = F.concat(F.lit(" " * 8), _object(8, _field("contest"), _field("candidate"), _field("counted_as")))
    images = named.groupBy(*owner, "image_path").agg(joined(mark))
    entry = F.concat(_quoted("image_path"), F.lit(": "), _object(
        4, _field("combo_id"), _field("precinct"), _field("party"), _block("indicators", "[", F.col("lines"), "]")))
    votes = named.filter("counted_as = 'VOTED'").groupBy(*owner, "contest", "candidate").agg(F.count("*").cast("string").alias("n"))
    contests = votes.groupBy(*owner, "contest").agg(joined(F.concat(F.lit(" " * 10), _quoted("candidate"), F.lit(": "), "n")))
    blocks = contests.groupBy(*owner).agg(
        joined(F.concat(F.lit(" " * 8), _quoted("contest"), F.lit(": {\n"), "lines", F.lit("\n        }"))))
    total = F.concat(_quoted("combo_id"), F.lit(": "), _object(
        4, _field("precinct"), _field("party"), _block("contests", "{", F.col("lines"), "}")))

    def part(rows: DataFrame, number: int, order: Column, text: Column) -> DataFrame:
        return rows.select("document", F.lit(number).alias("part"), order.alias("place"), text.alias("value"))

    none = F.lit("")
    sizes = images.groupBy("document").agg(F.count("*").cast("string").alias("n"))
    rows = part(images, 1, F.col("image_path"), F.concat(F.lit("    "), entry))
    for more in (
        part(blocks, 3, F.col("combo_id"), F.concat(F.lit("    "), total)),
        part(sizes, 0, none, F.lit('{\n  "per_image": {')),
        part(sizes, 2, none, F.lit('  },\n  "aggregate": {')),
        part(sizes, 4, none, F.concat(F.lit('  },\n  "total_images": '), "n", F.lit("\n}"))),
    ):
        rows = rows.unionByName(more)
    following = F.lead("part").over(Window.partitionBy("document").orderBy("part", "place"))
    comma = F.when(following == F.col("part"), ",").otherwise("")
    rows.select("document", F.concat("value", comma).alias("value"), "part", "place").repartition("document").sortWithinPartitions(
        "document", "part", "place").select("document", "value").write.mode(mode).partitionBy("document").text(path)
