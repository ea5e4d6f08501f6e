"""Folders of scanned images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
IMAGE_SUFFIX = r"\.(png|jpg|jpeg|tif|tiff|bmp)$"
COUNTED_SUFFIX = ".counted"
CROP_PREFIX = "writein_"


def keep_scans(files: DataFrame) -> DataFrame:
    """Rows of ``files`` (column ``path``) that are uncounted scans, in path order."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    wanted = name.rlike(IMAGE_SUFFIX) & ~name.startswith(CROP_PREFIX)
    return files.filter(wanted).orderBy("path")


def counted_files(files: DataFrame) -> DataFrame:
    return files.filter(F.lower("path").endswith(COUNTED_SUFFIX))


def _listing(spark: SparkSession, root: str) -> DataFrame:
    """All files below a folder.  The image bytes are never read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.select("path", "modificationTime", "length")


def list_scans(spark: SparkSession, root: str) -> DataFrame:
    return keep_scans(_listing(spark, root))


def waiting_scans(spark: SparkSession, root: str, counted: DataFrame) -> DataFrame:
    """Scans of a folder that nobody has counted yet, in path order.

    Left out are those whose path is among ``counted`` (column ``image_path``, as the results
    store it), and those beside a marker: a file of the same name with the counted suffix.
    Only names are compared; no image is opened.
    """
    files = _listing(spark, root)
    marked = counted_files(files).select(F.expr(f"left(path, length(path) - {len(COUNTED_SUFFIX)})").alias("path"))
    known = marked.unionByName(counted.select(F.col("image_path").alias("path")))
    return keep_scans(files.join(known, "path", "left_anti"))


def any_already_counted(spark: SparkSession, root: str) -> bool:
    """Tells a finished folder from one that never held scans."""
    return not counted_files(_listing(spark, root)).isEmpty()
