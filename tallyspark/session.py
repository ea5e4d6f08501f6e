"""Session-level helpers: where intermediate tables live and how rows are numbered.

Intermediate results that are read more than once are written to the shared
folder the cluster names in ``spark.checkpoint.dir``.  A written table survives
the loss of executors, cuts the lineage, and gives Catalyst a real size, so the
choice between a broadcast and a shuffle join is made by Spark from measured
bytes (``spark.sql.autoBroadcastJoinThreshold``) and never by a forced hint.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app_name: str = "tallyspark", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators are tuned for; ``conf`` overrides."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """Folder for written intermediates: ``spark.checkpoint.dir``, else the session's warehouse.

    Both are shared by all executors of a cluster.
    """
    root = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(_CHECKPOINT_KEY)
    return (root or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """Fresh path below the shared root, unique per call."""
    app = spark.sparkContext.applicationId
    return f"{shared_root(spark)}/tallyspark/{app}/{label}-{uuid.uuid4().hex}"


_SCOPES = threading.local()


@contextmanager
def discarding(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving what was staged inside, apart from tables staged with ``keep``.

    For work whose results are written elsewhere; nothing lazy may outlive the block.
    """
    scopes = _SCOPES.__dict__.setdefault("paths", [])
    scopes.append([])
    try:
        yield
    finally:
        for path in scopes.pop():
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stage(df: DataFrame, label: str = "stage", keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet below the shared root and return the written table.

    Inside ``discarding`` the table lives as long as the block; with ``keep``, as long as
    the block around that.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    scopes = _SCOPES.__dict__.get("paths", [])
    depth = 2 if keep else 1
    if len(scopes) >= depth:
        scopes[-depth].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def number_rows(df: DataFrame, order_by: list[str | Column], name: str, start: int = 1) -> DataFrame:
    """Dense running number in ``order_by`` order, for tables of any size.

    The rows are range-partitioned on the order key and written once.  Only one
    count per partition reaches the driver; the number of a row is its position
    in its partition plus the rows of the partitions before it.  No task sees
    more than its own range, whatever the distribution of the keys.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order_by]
    row = F.monotonically_increasing_id()
    placed = stage(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_row", row),
        "numbered",
    )
    # A generated id holds the partition in its upper bits and the position in the lower 33.
    part = F.shiftright("_row", 33)
    sizes = placed.groupBy(part.cast("int").alias("part")).count().collect()
    offsets, seen = {}, start
    for size in sorted(sizes, key=lambda r: r["part"]):
        offsets[size["part"]] = seen
        seen += size["count"]
    if not offsets:
        return placed.withColumn(name, F.lit(None).cast("bigint")).drop("_row")
    table = [offsets.get(i, 0) for i in range(max(offsets) + 1)]
    base = F.get(F.lit(table).cast("array<bigint>"), part.cast("int"))
    position = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn(name, base + position).drop("_row")


def number_within(df: DataFrame, group_by: list[str], order_by: list[str], name: str) -> DataFrame:
    """1-based position inside each group, with groups split over many tasks.

    Rows are range-partitioned on group and order, so a group of any size spreads
    over as many slices as it needs.  Each slice ranks its own piece; pieces that
    belong to one group are then offset by the sizes of the earlier pieces.
    """
    keys = [*group_by, *order_by]
    placed = stage(
        df.repartitionByRange(*keys).withColumn("_slice", F.spark_partition_id()),
        "sliced",
    )
    piece = Window.partitionBy(*group_by, "_slice").orderBy(*order_by)
    before = Window.partitionBy(*group_by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*group_by, "_slice").count()
        .withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
        .select(*[F.col(g).alias(f"_of_{g}") for g in group_by], F.col("_slice").alias("_of_slice"), "_before")
    )
    same = F.col("_slice") == F.col("_of_slice")
    for g in group_by:
        same = same & F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    number = (F.row_number().over(piece) + F.lit(0)).cast("bigint")
    return (
        placed.withColumn("_in_slice", number)
        .join(offsets, same)
        .select(*df.columns, (F.col("_in_slice") + F.col("_before")).alias(name))
    )
