"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.session import shared_path


#: Rows of a task and its file where the number of rows is known.
FILE_ROWS = 20_000


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to a fresh folder under ``spark.checkpoint.dir`` and read it back.

    The files outlive any executor, so what is built on the result never runs
    what stands before it again.  ``rows``: about how many rows there are; a
    small table then goes to few files however many shuffle partitions there
    are, a large one to as many files as without it.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, ceil(rows / FILE_ROWS)))
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(df: DataFrame) -> Column:
    """128 bits (binary) of all columns of a row: equal rows share it, rows that share a doc_id or have none do not."""
    columns = [df[f"`{c}`"] for c in df.columns]
    # nulls do not change xxhash64, so that they count by their places too
    parts = [*columns, *[c.isNull() for c in columns]]
    halves = [F.xxhash64(*parts), F.xxhash64(F.lit("second half"), *parts)]
    return F.unhex(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in halves]))


def fresh_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Only the named columns; a missing one is an error, others (clashing names too) are left out."""
    return df.select(*[df[f"`{n}`"] for n in names])
