"""Cleaning (C1–C7, D1, S5).

``clean_dataset`` is two-phase, because which columns become numbers or dates
depends on the data:

1. **De-duplication job** — the only pass over the raw rows: trim, normalise
   missing markers, and group equal rows with their number (map-side combined:
   a row repeated a million times shuffles once per task).  Each group keeps,
   as bits, which raw cells were not blank: a column without any is empty
   (before missing markers are normalised, so an all-"N/A" column stays and is
   later flagged ``empty_column`` by the profile).  Rows without any value keep
   the places of their blank cells, because whether such a row counts depends
   on which columns are empty.  The grouped rows are checkpointed.
2. **Stats job** — one ``agg`` over the checkpoint: row counts, constant
   test (``min = max``), looks-numeric share, locale-number parse share,
   date parse share for date-named columns (both day orders).
3. Lazy final ``select`` that drops the empty columns and converts the chosen ones.

With ``materialize=False`` nothing is kept and every job reads the rows again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions import fixed_values as FV
from tablewise.functions import parse as P
from tablewise.session import checkpoint


@dataclass
class CleanReport:
    conversion_errors: dict[str, int] = field(default_factory=dict)
    removed_empty_columns: list[str] = field(default_factory=list)
    constant_columns: list[str] = field(default_factory=list)
    duplicate_rows_removed: int = 0
    numeric_columns: list[str] = field(default_factory=list)
    date_columns: list[str] = field(default_factory=list)
    rows_in: int = 0
    rows_out: int = 0
    log: list[str] = field(default_factory=list)


def _is_text(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.StringType)


def _present(df: DataFrame, c: str) -> Column:
    """A cell that is neither null nor blank."""
    v = F.col(c)
    if _is_text(df, c):
        return v.isNotNull() & (P.utrim(v) != "")
    if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)):
        return v.isNotNull() & ~F.isnan(v)
    return v.isNotNull()


def empty_columns(df: DataFrame) -> list[str]:
    """Columns where every cell is null or blank (one aggregate job)."""
    if not df.columns:
        return []
    found = df.agg(*[F.max(_present(df, c).cast("int")) for c in df.columns]).first()
    return [c for c, present in zip(df.columns, found) if not present]


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Drop rows where every cell is null."""
    return df.na.drop(how="all")


def _normalised(df: DataFrame) -> list[tuple[str, Column]]:
    out = []
    for c in df.columns:
        dt = df.schema[c].dataType
        if isinstance(dt, T.StringType):
            out.append((c, P.normalise_missing(c)))
        elif isinstance(dt, (T.FloatType, T.DoubleType)):
            out.append((c, P.nan_to_null(c)))
        else:
            out.append((c, F.col(c)))
    return out


def normalise(df: DataFrame) -> DataFrame:
    """F1/F2 on every text column, NaN → null on floating columns."""
    return df.select(*[c.alias(n) for n, c in _normalised(df)])


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Exact whole-row duplicates removed."""
    return df.dropDuplicates()


def _date_named(name: str) -> bool:
    low = name.lower()
    return any(k in low for k in FV.CLEAN_DATE_KEYWORDS)


#: Columns whose presence one number keeps.
_MASK_BITS = 60


def _grouped(df: DataFrame) -> DataFrame:
    """Distinct normalised rows with their number ``__n``, and what their raw cells held.

    ``__m0``, ``__m1`` …: a bit for each column where any of the raw rows has a
    cell that is not blank.  ``__cells``, only of rows without any value: the
    raw cells, 1 where neither null nor NaN.
    """
    floating = [c for c in df.columns if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType))]
    filled = [F.col(c).isNotNull() & ~F.isnan(c) if c in floating else F.col(c).isNotNull() for c in df.columns]
    bits = [F.when(_present(df, c), F.lit(1 << i % _MASK_BITS)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(df.columns)]
    masks = {f"__m{k}": reduce(lambda a, b: a + b, bits[k * _MASK_BITS : (k + 1) * _MASK_BITS]) for k in range((len(bits) + _MASK_BITS - 1) // _MASK_BITS)}
    raw = df.withColumns({"__cells": F.concat(*[F.when(f, F.lit("1")).otherwise(F.lit("0")) for f in filled]), **masks})
    bare = reduce(lambda a, b: a & b, [F.col(c).isNull() for c in df.columns])
    rows = raw.select(*[c.alias(n) for n, c in _normalised(df)], "__cells", *masks).withColumn("__cells", F.when(bare, F.col("__cells")))
    return rows.groupBy(*df.columns, "__cells").agg(F.count(F.lit(1)).alias("__n"), *[F.bit_or(m).alias(m) for m in masks])


def clean_dataset(df: DataFrame, materialize: bool = True) -> tuple[DataFrame, CleanReport]:
    """Drop empty axes → trim → nulls → de-duplicate → flag constants → numbers → dates."""
    report = CleanReport()
    if not df.columns:
        return df, report
    grouped = checkpoint(_grouped(df)) if materialize else _grouped(df)
    masks = grouped.agg(*[F.bit_or(c) for c in grouped.columns if c.startswith("__m")]).first()
    empties = [c for i, c in enumerate(df.columns) if not (masks[i // _MASK_BITS] or 0) >> i % _MASK_BITS & 1]
    report.removed_empty_columns = empties
    cols = [c for c in df.columns if c not in empties]
    # a row without a value counts where it has a blank cell in a column that is not empty; all such rows are one row
    held = [F.substring("__cells", i + 1, 1) == "1" for i, c in enumerate(df.columns) if c in cols]
    counts = F.col("__cells").isNull() | reduce(lambda a, b: a | b, held, F.lit(False))
    dedup = grouped.select(*cols, "__cells", "__n").where(counts)
    text_cols = [c for c in cols if _is_text(dedup, c)]

    # stage the stripped number text once per text column (read many times below)
    staged = dedup.select("*", *[P.locale_number_text(F.col(c), clean=False).alias(f"__n{i}")
                                                         for i, c in enumerate(cols) if c in text_cols])
    exprs: list[Column] = [
        F.count_if(F.col("__cells").isNull()).alias("__rows"), F.coalesce(F.sum("__n"), F.lit(0)).alias("__rows_in"), F.max("__cells").alias("__bare"),
    ]
    for i, c in enumerate(cols):
        v = F.col(c)
        exprs += [F.count(v).alias(f"nn{i}")]
        if isinstance(dedup.schema[c].dataType, (T.MapType, T.ArrayType, T.StructType)):
            exprs += [F.lit(False).alias(f"const{i}")]
        else:
            exprs += [(F.min(v) == F.max(v)).alias(f"const{i}")]
        if c in text_cols:
            exprs += [
                F.count_if(P.looks_numeric(v)).alias(f"look{i}"),
                F.count(P.locale_number_finish(F.col(f"__n{i}"))).alias(f"num{i}"),
            ]
            if _date_named(c):
                exprs += [
                    F.count(P.parse_timestamp(v, True, clean=False, strict=True)).alias(f"dmy{i}"),
                    F.count(P.parse_timestamp(v, False, clean=False, strict=True)).alias(f"mdy{i}"),
                ]
    stats = staged.agg(*exprs).collect()[0]
    bare = stats["__bare"]
    report.rows_in = int(stats["__rows_in"])
    report.rows_out = int(stats["__rows"]) + (bare is not None)
    report.duplicate_rows_removed = report.rows_in - report.rows_out

    projection = []
    for i, c in enumerate(cols):
        nn = int(stats[f"nn{i}"])
        if nn > 0 and stats[f"const{i}"]:
            report.constant_columns.append(c)
        expr = F.col(c)
        if c in text_cols and nn > 0:
            if stats[f"look{i}"] / nn >= 0.6 and stats[f"num{i}"] / nn >= 0.6:
                failures = nn - int(stats[f"num{i}"])
                report.numeric_columns.append(c)
                if failures:
                    report.conversion_errors[c] = failures
                expr = P.parse_number_locale(F.col(c), clean=False)
            elif _date_named(c):
                dmy, mdy = int(stats[f"dmy{i}"]), int(stats[f"mdy{i}"])
                day_first = dmy >= mdy
                ok = max(dmy, mdy)
                if ok / nn >= 0.5:
                    report.date_columns.append(c)
                    if nn - ok:
                        report.conversion_errors[c] = report.conversion_errors.get(c, 0) + nn - ok
                    expr = P.parse_timestamp(F.col(c), day_first, clean=False, strict=True)
        projection.append(expr.alias(c))

    if empties:
        report.log.append("empty columns removed: " + ", ".join(empties))
    if report.duplicate_rows_removed:
        report.log.append(f"exact duplicates removed: {report.duplicate_rows_removed}")
    if report.constant_columns:
        report.log.append("constant columns: " + ", ".join(report.constant_columns))
    for c, n in report.conversion_errors.items():
        report.log.append(f"{n} values not converted in '{c}'")
    kept = dedup.where(F.col("__cells").isNull() | (F.col("__cells") == bare)) if bare is not None else dedup
    return kept.select(*projection), report


def clean_plan(df: DataFrame, numeric: Sequence[str], dates: dict[str, bool] | Sequence[str], empties: Sequence[str] = ()) -> DataFrame:
    """The lazy part of C1 for known decisions (e.g. replaying a saved report)."""
    dates = dict.fromkeys(dates, True) if not isinstance(dates, dict) else dates
    d = drop_duplicates(normalise(drop_empty_rows(df.drop(*empties))))
    out = []
    for c in d.columns:
        if c in numeric:
            out.append(P.parse_number_locale(F.col(c), clean=False).alias(c))
        elif c in dates:
            out.append(P.parse_timestamp(F.col(c), dates[c], clean=False, strict=True).alias(c))
        else:
            out.append(F.col(c))
    return d.select(*out)


# ------------------------------------------------------------------------ C5
RULE_TYPES = [
    "Trim Text", "Normalize Category", "Convert Date", "Convert Number", "Fill Missing",
    "Drop Column", "Rename Column", "Remove Duplicates", "Custom Formula",
]


def apply_rules(df: DataFrame, rules: Sequence[dict]) -> tuple[DataFrame, list[str]]:
    """Ordered transform rules folded into one plan.

    A rule on a missing column is skipped with a warning; "Custom Formula" is
    refused (arbitrary formulas are disabled).
    """
    warnings: list[str] = []
    for rule in rules:
        kind, column, config = rule.get("rule_type"), rule.get("column_name"), rule.get("config") or {}
        if kind != "Remove Duplicates" and column not in df.columns:
            warnings.append(f"Rule skipped, missing column: {column}")
            continue
        if kind == "Trim Text":
            df = df.withColumn(column, P.normalise_missing(column))
        elif kind == "Normalize Category":
            df = df.withColumn(column, P.normalize_category(column))
        elif kind == "Convert Date":
            first = P.date_orders(df, [column])[column] if _is_text(df, column) else True
            df = df.withColumn(column, P.parse_date(column, first, strict=True))
        elif kind == "Convert Number":
            df = df.withColumn(column, P.parse_number(column))
        elif kind == "Fill Missing":
            df = df.withColumn(column, P.fill_missing(column, config.get("value")))
        elif kind == "Drop Column":
            df = df.drop(column)
        elif kind == "Rename Column":
            if config.get("new_name"):
                df = df.withColumnRenamed(column, config["new_name"])
        elif kind == "Remove Duplicates":
            df = df.dropDuplicates()
        elif kind == "Custom Formula":
            warnings.append("Custom Formula ignored: arbitrary formulas are disabled for security.")
    return df, warnings


# ---------------------------------------------------------------- C6, P4
def convert_by_mapping(df: DataFrame, mapping: Sequence[dict]) -> tuple[DataFrame, DataFrame, int]:
    """Keep included columns, convert each by role; count conversion errors.

    Returns (clean DataFrame, one-row error counts DataFrame, unusable column
    count).  Measure → number, Date Dimension → date, Boolean → "Yes"/"No",
    Dimension → normalised category, anything else trimmed text.  A mapped
    column missing from the table counts ``row_count`` errors.
    """
    unusable = 0
    projection = []
    error_exprs = []
    missing = []
    normalised = df.select(*[P.normalise_missing(c).alias(c) if _is_text(df, c) else F.col(c) for c in df.columns])
    dated = [c.get("normalized_name") for c in mapping if c.get("semantic_role") == "Date Dimension" and c.get("include", True)]
    orders = P.date_orders(normalised, [c for c in dict.fromkeys(dated) if c in df.columns and _is_text(df, c)], clean=False)
    for col in mapping:
        name = col.get("normalized_name")
        role, dtype = col.get("semantic_role"), col.get("detected_type")
        if not col.get("include", True) or role == "Ignored":
            unusable += 1
            continue
        if name not in df.columns:
            unusable += 1
            missing.append(name)
            continue
        raw = F.col(name)
        if role == "Measure":
            conv = P.parse_number(raw.cast("string"), clean=False) if _is_text(df, name) else raw.cast("double")
        elif role == "Date Dimension":
            conv = P.parse_date(raw, orders[name], clean=False, strict=True) if _is_text(df, name) else F.to_date(raw)
        elif dtype == "Boolean":
            conv = P.yes_no(P.parse_boolean(raw.cast("string"), clean=False))
        elif role == "Dimension":
            conv = P.normalize_category(raw.cast("string"), clean=False)
        else:
            conv = raw.cast("string")
        projection.append(conv.alias(name))
        error_exprs.append(F.count_if(raw.isNotNull() & conv.isNull()).alias(name))
    if not projection:
        raise ValueError("no usable column after mapping")
    errors = normalised.agg(*error_exprs, *[F.count(F.lit(1)).alias(m) for m in missing])
    return normalised.select(*projection), errors, unusable


# ------------------------------------------------------------------------ C7
def legacy_clean(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Number if ≥70 % parse, else date if ≥60 %, else text; category by cardinality.

    Returns (clean DataFrame, one row per column with data_type, is_category,
    distinct_count, null_count).  One stats job decides the types; distinct
    counts come from a single ``unpivot``/``groupBy`` job.
    """
    from tablewise.operators.profile import cell_counts  # local: avoid an import cycle

    d = drop_duplicates(normalise(df))
    cols = list(d.columns)
    exprs = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(cols):
        v = F.col(c).cast("string")
        exprs += [
            F.count(F.col(c)).alias(f"nn{i}"),
            F.count(F.when(v.rlike(P.NUMERIC_LITERAL), 1)).alias(f"num{i}"),
            F.count(P.parse_timestamp(v, True, clean=False, strict=True)).alias(f"dmy{i}"),
            F.count(P.parse_timestamp(v, False, clean=False, strict=True)).alias(f"mdy{i}"),
        ]
    stats = d.agg(*exprs).collect()[0]
    rows = int(stats["__rows"])
    projection, kinds = [], {}
    for i, c in enumerate(cols):
        nn = int(stats[f"nn{i}"])
        v = F.col(c).cast("string")
        if nn and stats[f"num{i}"] / nn >= 0.7:
            projection.append(F.when(v.rlike(P.NUMERIC_LITERAL), v.cast("double")).alias(c))
            kinds[c] = "Number"
        elif nn and max(stats[f"dmy{i}"], stats[f"mdy{i}"]) / nn >= 0.6:
            projection.append(P.parse_date(v, stats[f"dmy{i}"] >= stats[f"mdy{i}"], clean=False, strict=True).alias(c))
            kinds[c] = "Date"
        else:
            projection.append(v.alias(c))
            kinds[c] = "Text"
    clean = d.select(*projection)
    limit = min(100, max(20, rows // 2))
    distinct = cell_counts(clean).where("head is not null").groupBy("name").agg(F.count(F.lit(1)).alias("distinct_count"))
    nulls = clean.agg(*[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)])
    spark = df.sparkSession
    kinds_df = spark.createDataFrame([(i, c, kinds[c]) for i, c in enumerate(cols)], "position int, name string, data_type string")
    null_long = nulls.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"n{i}").alias("null_count")) for i, c in enumerate(cols)])))
    prof = (
        kinds_df.join(F.broadcast(distinct), "name", "left")
        .join(F.broadcast(null_long), "name", "left")
        .withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0)))
        .withColumn("is_numeric", F.col("data_type") == "Number")
        .withColumn("is_date", F.col("data_type") == "Date")
        .withColumn(
            "is_category",
            ((F.col("data_type") == "Text") & (F.col("distinct_count") <= limit)) | (F.col("data_type") == "Date"),
        )
        .orderBy("position")
    )
    return clean, prof
