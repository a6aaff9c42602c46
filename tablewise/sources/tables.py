"""Tables in and out (S6–S14): guards, preview, JSON records, typed reload, sinks, export."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions import fixed_values as FV
from tablewise.functions import parse as P


def check_row_limit(df: DataFrame, max_rows: int | None) -> None:
    """S6 (optional): refuse a table above ``max_rows`` rows; reads at most ``max_rows + 1``."""
    if max_rows is not None and df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"table exceeds the limit of {max_rows} rows")
    if not df.columns:
        raise ValueError("table has no usable column")


def guard_report(tables: dict[str, DataFrame], max_rows: int | None = None, min_columns: int = 1) -> DataFrame:
    """S6 as rows: (table, n_columns, too_many_rows, too_few_columns, accepted) for every table offered.

    Of each table at most ``max_rows + 1`` rows are looked at.
    """
    parts = []
    for name, df in tables.items():
        seen = df.select(F.lit(1).alias("x")).limit(max_rows + 1) if max_rows is not None else df.select(F.lit(1).alias("x")).limit(0)
        many = F.count("x") > F.lit(max_rows if max_rows is not None else 0)
        parts.append(seen.agg(many.alias("too_many_rows")).select(F.lit(name).alias("table"), F.lit(len(df.columns)).alias("n_columns"), "too_many_rows"))
    rows = reduce(DataFrame.unionByName, parts).withColumn("too_few_columns", F.col("n_columns") < min_columns)
    return rows.withColumn("accepted", ~(F.col("too_many_rows") | F.col("too_few_columns")))


def preview(df: DataFrame, order_by: Sequence[str], limit: int = FV.PREVIEW_ROWS) -> DataFrame:
    """First ``limit`` rows in a declared order, NaN → null."""
    cols = [P.nan_to_null(c).alias(c) if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)) else F.col(c) for c in df.columns]
    return df.orderBy(*order_by).limit(limit).select(*cols)


def to_json_lines(df: DataFrame) -> DataFrame:
    """One JSON record per row (``value``); dates ISO, NaN → null, nulls kept."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = P.nan_to_null(c)
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
            c = F.when(F.date_trunc("second", c) == c, whole).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        cols.append(c.alias(f.name))
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S8 sink: partitioned JSON-lines files."""
    to_json_lines(df).write.mode(mode).text(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON records with a declared schema; malformed fields become null."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def from_json_column(df: DataFrame, column: str, schema: T.StructType | str) -> DataFrame:
    """S9 on a text column: parse and flatten."""
    return df.select(F.from_json(column, schema).alias("__r")).select("__r.*")


def typed_reload(df: DataFrame, schema: Sequence[tuple[str, str]]) -> DataFrame:
    """Reorder to ``schema`` [(name, Number|Date|Text)], add missing columns as null, cast."""
    out = []
    for name, kind in schema:
        src = F.col(name) if name in df.columns else F.lit(None).cast("string")
        if kind == "Number":
            c = P.parse_number(src.cast("string")) if name in df.columns and isinstance(df.schema[name].dataType, T.StringType) else src.cast("double")
        elif kind == "Date":
            c = P.parse_date(src.cast("string")) if name in df.columns and isinstance(df.schema[name].dataType, T.StringType) else F.to_date(src)
        else:
            c = src.cast("string")
        out.append(c.alias(name))
    return df.select(*out)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """Idempotent table write (overwrite replaces a previous import)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def table_exists(spark: SparkSession, path: str) -> bool:
    """A written table exists at ``path``."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove a written table folder (all of a dataset's tables live under one prefix)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(hpath):
        fs.delete(hpath, True)


def with_labels(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Columns renamed to their display labels."""
    return df.select(*[F.col(c).alias(labels.get(c, c)) for c in df.columns])


def export_csv(df: DataFrame, path: str, labels: dict[str, str] | None = None) -> None:
    """Partitioned CSV with labels as headers (instead of one spreadsheet)."""
    with_labels(df, labels or {}).write.mode("overwrite").option("header", True).csv(path)
