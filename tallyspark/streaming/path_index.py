"""Which image paths earlier batches have taken, without reading all of them.

Paths lie in folders by a prefix of their hash.  A batch looks into the folders of its own
prefixes only, adds one file to each, and every few batches the files of a folder are put
together.  So the files a batch reads depend on the batch and not on how many came before.

Files are only ever added before others are deleted, and a row may be there twice: the
index answers whether a path is known, so a repeated or replayed write changes nothing.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folders; a batch brings at most so many numbers to the driver.
PREFIXES = 32
#: Files of a folder are put together every so many batches.
BATCHES_APART = 8

_STORED = T.StructType([
    T.StructField("image_path", T.StringType()), T.StructField("path_hash", T.LongType()),
    T.StructField("batch_id", T.LongType()), T.StructField("prefix", T.IntegerType()),
])
_KEYS = ["prefix", "path_hash", "image_path"]


def _hashed(rows: DataFrame) -> DataFrame:
    key = F.xxhash64("image_path")
    return rows.withColumns({"path_hash": key, "prefix": F.pmod(key, F.lit(PREFIXES)).cast("int")})


def _read(spark: SparkSession, root: str, *files: str) -> DataFrame | None:
    try:
        return spark.read.schema(_STORED).option("basePath", root).parquet(*(files or [root]))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def known_paths(rows: DataFrame, root: str, batch_id: int) -> DataFrame:
    """Stored rows that can match ``rows``: those below its prefixes, from batches before ``batch_id``."""
    spark = rows.sparkSession
    stored = _read(spark, root)
    if stored is None:
        return spark.createDataFrame([], _STORED)
    touched = [r["prefix"] for r in _hashed(rows).select("prefix").distinct().collect()]
    return stored.filter(F.col("prefix").isin(touched) & (F.col("batch_id") < batch_id))


def new_paths(rows: DataFrame, root: str, batch_id: int) -> DataFrame:
    """Rows whose path no earlier batch has taken."""
    known = known_paths(rows, root, batch_id).select(*_KEYS)
    return _hashed(rows).join(known, _KEYS, "left_anti").select(*rows.columns)


def add_paths(rows: DataFrame, root: str, batch_id: int) -> None:
    """Remembers the paths of a batch."""
    stored = _hashed(rows.select("image_path")).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
    _append(stored, root)
    if batch_id % BATCHES_APART == BATCHES_APART - 1:
        put_together(rows.sparkSession, root)


def _append(stored: DataFrame, root: str) -> None:
    """One file per prefix, in the order of the hashes."""
    placed = stored.repartition("prefix").sortWithinPartitions("prefix", "path_hash")
    placed.select(*_STORED.fieldNames()).write.mode("append").partitionBy("prefix").parquet(root)


def put_together(spark: SparkSession, root: str) -> None:
    """One file in place of several, per prefix.  The new ones are whole before the old ones go."""
    stored = _read(spark, root)
    by_prefix: dict[str, list[str]] = {}
    for file in stored.inputFiles() if stored is not None else []:
        by_prefix.setdefault(re.search(r"/prefix=(\d+)/", file)[1], []).append(file)
    old = [file for files in by_prefix.values() if len(files) > 1 for file in files]
    if not old:
        return
    _append(_read(spark, root, *old).groupBy(*_KEYS).agg(F.min("batch_id").alias("batch_id")), root)
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    uri_of = spark.sparkContext._jvm.java.net.URI
    for file in old:
        where = path_of(uri_of(file))
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, False)
