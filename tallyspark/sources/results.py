"""The results star on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark import schema as S
from tallyspark.operators.ingest import Star
from tallyspark.operators.merge import Stations


def save_results(star: Star, path: str, mode: str = "errorifexists") -> None:
    """One Parquet folder per table."""
    for name, table in star.tables().items():
        table.write.mode(mode).parquet(f"{path}/{name}")


def load_results(spark: SparkSession, path: str) -> Star:
    """Read the star with its fixed schemas.

    A contest table written before thresholds existed has no ``percent_to_win``;
    such rows read as the default.
    """

    def table(name: str, schema: T.StructType) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{path}/{name}")

    contest = table("contest", S.CONTEST).withColumn(
        "percent_to_win", F.coalesce("percent_to_win", F.lit(S.DEFAULT_PERCENT_TO_WIN))
    )
    return Star(
        table("barcode", S.BARCODE),
        table("ballot_image", S.BALLOT_IMAGE),
        contest,
        table("candidate", S.CANDIDATE),
        table("vote_opportunity", S.VOTE_OPPORTUNITY),
    )


def save_bucketed(star: Star, prefix: str, buckets: int, mode: str = "errorifexists") -> None:
    """Catalog tables with facts and images bucketed on the image key.

    Reports that need image columns (paths, names) then join without a shuffle.
    """
    keys = {"vote_opportunity": "ballot_image_id", "ballot_image": "id"}
    for name, table in star.tables().items():
        writer = table.write.mode(mode).format("parquet")
        if name in keys:
            writer = writer.bucketBy(buckets, keys[name]).sortBy(keys[name])
        writer.saveAsTable(f"{prefix}{name}")


def load_bucketed(spark: SparkSession, prefix: str) -> Star:
    return Star(*[spark.table(f"{prefix}{name}") for name in S.RESULT_TABLES])


_STATION_NO = T.StructField("station_no", T.IntegerType())
_LABEL = T.StructType([T.StructField("label", T.StringType())])


def save_station(star: Star, root: str, number: int, label: str) -> None:
    """One station's tables beside those of the others; written again, they are replaced."""
    rows = star.tables() | {"station": star.contest.sparkSession.createDataFrame([(label,)], _LABEL)}
    for name, table in rows.items():
        table.write.mode("overwrite").parquet(f"{root}/{name}/{_STATION_NO.name}={number}")


def load_stations(spark: SparkSession, root: str) -> Stations:
    """All stations below ``root`` as one set; the station is a partition column of every table."""
    def table(name: str, schema: T.StructType) -> DataFrame:
        return spark.read.schema(T.StructType([*schema.fields, _STATION_NO])).parquet(f"{root}/{name}")

    # One short row per station; the places of stations that are missing stay empty.
    found = {r["station_no"]: r["label"] for r in table("station", _LABEL).collect()}
    labels = tuple(found.get(n, "") for n in range(max(found, default=-1) + 1))
    tables = {name: table(name, getattr(S, name.upper())) for name in S.RESULT_TABLES}
    return Stations(Star(**tables), labels)
