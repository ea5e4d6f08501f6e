"""Output of a stream as folders of batches.

A batch writes ``<table>/batch_id=<n>`` and overwrites it when it is replayed, and
only ever reads batches before its own.  Together with the query's checkpoint this
counts every scan exactly once.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_batch(df: DataFrame, root: str, table: str, batch_id: int, by: tuple[str, ...] = ()) -> None:
    """A batch's rows, in folders of the columns ``by`` where a reader can leave some out."""
    df.write.mode("overwrite").partitionBy(*by).parquet(f"{root}/{table}/batch_id={batch_id}")


def read_table(spark: SparkSession, root: str, table: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """All batches of a table, or those before a batch; empty when there are none."""
    with_batch = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    try:
        rows = spark.read.schema(with_batch).parquet(f"{root}/{table}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    if before is not None:
        rows = rows.filter(F.col("batch_id") < before)
    return rows.select(*schema.fieldNames())
