"""The stream's input: one row per scan, with all its measured boxes in an array.

A scan is one row, so no way of cutting the input into batches can part a ballot from its
marks.  The array is as long as the boxes printed on the sheet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark import schema as S

SCAN_COLUMNS = tuple(f.name for f in S.SCAN.fields)
MARK_COLUMNS = tuple(f.name for f in S.MEASUREMENT.fields if f.name != "image_id")
_MARK = T.StructType([f for f in S.MEASUREMENT.fields if f.name != "image_id"])

FEED = T.StructType([*S.SCAN.fields, T.StructField("marks", T.ArrayType(_MARK))])


def flatten(scans: DataFrame, measurements: DataFrame,
            measured: Callable[[Callable[[str], Column]], dict[str, Column]] | None = None) -> DataFrame:
    """Scans and marks as feed rows; a blank ballot has no marks.

    With ``measured``, the rows gathered are narrower than the marks, whose columns it states
    from those of a row; then only the narrow rows move.
    """
    given = [c for c in (measurements.columns if measured else MARK_COLUMNS) if c not in ("image_id", "seq")]
    gathered = measurements.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("seq", *given))).alias("marks"))

    def described(row: Column) -> Column:
        columns = measured(lambda name: row[name]) if measured else {c: row[c] for c in MARK_COLUMNS}
        return F.struct(*[columns[c].alias(c) for c in MARK_COLUMNS])

    marks = gathered.select("image_id", F.transform("marks", described).alias("marks"))
    return scans.select(*SCAN_COLUMNS).join(marks, "image_id", "left")


def narrowed(scan: tuple[str, ...], mark: tuple[str, ...]) -> T.StructType:
    """The feed's schema with some columns of scans and marks; a file gives up no others."""
    marks = T.StructType([f for f in _MARK.fields if f.name in mark])
    return T.StructType([*[f for f in S.SCAN.fields if f.name in scan], T.StructField("marks", T.ArrayType(marks))])


def append_rows(rows: DataFrame, path: str) -> None:
    """Add files to a stream's folder."""
    rows.write.mode("append").parquet(path)


def count_files(spark: SparkSession, path: str) -> int:
    """Files of a stream's folder so far."""
    return len(spark.read.schema(FEED).parquet(path).inputFiles())


def read_feed(spark: SparkSession, path: str, files_per_trigger: int | None = None, schema: T.StructType = FEED) -> DataFrame:
    """The folder as a stream; ``files_per_trigger`` bounds a batch when much is waiting."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def scans_of(batch: DataFrame) -> DataFrame:
    """The scans of a batch."""
    return batch.select(*[c for c in SCAN_COLUMNS if c in batch.columns])


def marks_of(batch: DataFrame) -> DataFrame:
    """The marks of a batch, a row each.

    ``inline`` yields a mark's columns at once; taken out of an exploded struct one by one they
    make code that is too long to be compiled well.
    """
    return batch.select("image_id", F.inline("marks"))
