"""Quality score.

Rows, duplicate rows and missing cells come from one ``groupBy`` over all
columns: a group's missing cells are (null columns in its key) × (its count),
and its duplicates are count − 1.  Partial aggregation combines repeated rows
map-side, so a row repeated a billion times costs one record per task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _null_flag(df: DataFrame, c: str):
    v = F.col(c)
    if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)):
        return (v.isNull() | F.isnan(v)).cast("long")
    return v.isNull().cast("long")


def cell_counts(df: DataFrame) -> DataFrame:
    """A17 + A18: one row ``rows, columns, missing_cells, duplicate_rows``."""
    cols = list(df.columns)
    if not cols:
        return df.sparkSession.createDataFrame([(0, 0, 0, 0)], "rows long, columns int, missing_cells long, duplicate_rows long")
    groups = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n"))
    # the key is the whole row, so null-ness is re-derived from the group key
    g_nulls = sum((_null_flag(groups, c) for c in cols[1:]), _null_flag(groups, cols[0]))
    return groups.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).cast("long").alias("rows"),
        F.lit(len(cols)).alias("columns"),
        F.coalesce(F.sum(g_nulls * F.col("__n")), F.lit(0)).cast("long").alias("missing_cells"),
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"),
    )


def score_columns(counts: DataFrame, conversion_errors: int, unusable_columns: int, extra_penalty: float = 0.0) -> DataFrame:
    """Q1 arithmetic over the one-row ``cell_counts`` result."""
    rows, ncols = F.col("rows"), F.col("columns")
    total = F.greatest(rows * ncols, F.lit(1)).cast("double")
    missing_rate = F.col("missing_cells") / total
    duplicate_rate = F.when(rows > 0, F.col("duplicate_rows") / rows).otherwise(F.lit(0.0))
    conversion_rate = F.lit(float(conversion_errors)) / total
    unusable_rate = F.lit(float(unusable_columns)) / F.greatest(ncols, F.lit(1))
    raw = 100 - missing_rate * 35 - duplicate_rate * 25 - conversion_rate * 30 - unusable_rate * 20
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(raw, 2)))
    if extra_penalty:
        score = F.greatest(F.lit(0.0), F.round(score - F.lit(float(extra_penalty)), 2))
    return counts.select(
        score.alias("score"),
        F.round(missing_rate, 4).alias("missing_rate"),
        F.round(duplicate_rate, 4).alias("duplicate_rate"),
        F.round(conversion_rate, 4).alias("conversion_error_rate"),
        F.lit(int(conversion_errors)).alias("conversion_errors"),
        F.lit(int(unusable_columns)).alias("unusable_columns"),
    )


def quality_score(df: DataFrame, conversion_errors: Mapping[str, int] | int | None = None, unusable_columns: int = 0) -> DataFrame:
    """Q1: 100 − 35·missing − 25·duplicate − 30·conversion-error − 20·unusable rate, clamped, 2 dp."""
    if isinstance(conversion_errors, Mapping):
        conversion_errors = sum(int(v or 0) for v in conversion_errors.values())
    return score_columns(cell_counts(df), int(conversion_errors or 0), unusable_columns)


def dataset_quality(df: DataFrame, prof: DataFrame, conversion_errors: Mapping[str, int] | int | None = None) -> dict:
    """Q2: unusable = constant + empty columns; minus min(10, 2.5 × partial-date columns).

    The profile has one row per column, so its flags are brought to the driver;
    the table itself is scanned once by ``cell_counts``.
    """
    flags = prof.select(
        "name",
        F.array_contains("warnings", "constant_column").alias("constant"),
        F.array_contains("warnings", "empty_column").alias("empty"),
        F.array_contains("warnings", "partial_date_conversion").alias("partial_date"),
    ).collect()
    constant = [r["name"] for r in flags if r["constant"]]
    empty = [r["name"] for r in flags if r["empty"]]
    partial = [r["name"] for r in flags if r["partial_date"]]
    penalty = min(10.0, len(partial) * 2.5)
    if isinstance(conversion_errors, Mapping):
        conversion_errors = sum(int(v or 0) for v in conversion_errors.values())
    row = score_columns(cell_counts(df), int(conversion_errors or 0), len(constant) + len(empty), penalty).collect()[0]
    out = row.asDict()
    out.update(
        constant_columns=constant, empty_columns=empty, invalid_date_columns=partial, invalid_date_penalty=penalty,
    )
    return out
