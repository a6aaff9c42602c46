"""Session helpers: configuration, reliable checkpoints, sequential ids."""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def get_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "tablewise") -> SparkSession:
    """Session for tests and the bench; on a cluster use the cluster's own session."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; a local one only where unset on a local master (tests)."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = os.path.join("/tmp", "tablewise-checkpoints")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (cuts lineage)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location for written tables."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/tablewise-{name}-{uuid.uuid4().hex[:12]}"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def row_order(df: DataFrame, name: str) -> DataFrame:
    """Add ``name``, a struct that orders rows as their files hold them.

    Rows that still come from files are known by file path and row index, so
    the order does not depend on how splits are packed into tasks.  Other rows
    (after a shuffle, or made by the driver) are ordered by partition and place.
    """
    try:
        file = df.metadataColumn("_metadata")
        return df.select("*", F.struct(file["file_path"].alias("file"), file["row_index"].alias("row")).alias(name))
    except AnalysisException:
        return df.select("*", F.struct(F.lit("").alias("file"), F.monotonically_increasing_id().alias("row")).alias(name))


def ranged(df: DataFrame, order_cols: list[str]) -> DataFrame:
    """Rows sorted over all partitions; rows that share a key keep file order and are dealt to several partitions."""
    keys = [*order_cols, "__row"]
    return row_order(df, "__row").repartitionByRange(*keys).sortWithinPartitions(*keys)


def sequential_id(df: DataFrame, order_cols: list[str], name: str = "id", start: int = 1) -> DataFrame:
    """Dense 1..n id in ``order_cols`` order (ties, and no columns at all: file order) without a single-task window.

    With ``order_cols`` the rows are range-partitioned on them and the row's
    place, so that a key which a third of the rows share is split like any
    other.  Without, nothing is shuffled: the rows of a file in a partition are
    a segment.  Either way the rows are checkpointed with their partition and
    place, and every segment gets the number of rows before it as its offset:
    one row per partition and file.
    """
    rows = ranged(df, order_cols) if order_cols else row_order(df, "__row")
    file = F.lit("") if order_cols else F.col("__row.file")
    rows = rows.withColumns({"__file": file, "__at": F.col("__row.row"), "__pid": F.spark_partition_id(), "__mid": F.monotonically_increasing_id()}).drop("__row")
    rows = checkpoint(rows)
    segments = rows.groupBy("__pid", "__file").agg(F.count(F.lit(1)).alias("__n"), F.min("__mid").alias("__first"), F.min("__at").alias("__low"))
    order = ["__pid"] if order_cols else ["__file", "__low", "__pid"]
    before = F.sum("__n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    offsets = segments.select("__pid", "__file", "__first", F.coalesce(before, F.lit(0)).alias("__offset"))
    out = rows.join(offsets, ["__pid", "__file"]).withColumn(name, (F.col("__offset") + F.col("__mid") - F.col("__first") + F.lit(start)).cast("long"))
    return out.select(*df.columns, name)
