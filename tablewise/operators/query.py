"""Dashboard queries over a table.

Each function returns a lazy ``DataFrame``; nothing is collected except the
one-row statistics the histogram needs to place its bin edges.  Group-bys get
map-side partial aggregation, top-N becomes ``TakeOrderedAndProject``, and
filters/projections reach the Parquet scan.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions import fixed_values as FV
from tablewise.functions import parse as P

NULL_LABEL = "(vide)"
_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, _NUMERIC)


def is_temporal_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType))


def as_number(df: DataFrame, name: str) -> Column:
    """Numeric view of a column: numbers as double (NaN → null), text parsed strictly."""
    dt = dtype_of(df, name)
    c = F.col(name)
    if is_numeric_type(dt):
        return P.nan_to_null(c.cast("double"))
    if isinstance(dt, T.BooleanType):
        return c.cast("double")
    if isinstance(dt, T.StringType):
        t = P.utrim(c)
        return F.when(t.rlike(P.NUMERIC_LITERAL), t.cast("double"))
    return F.lit(None).cast("double")


def as_label(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("string")


def _agg(kind: str, num: Column, raw: Column | None = None) -> Column:
    kind = (kind or "sum").lower()
    if kind == "sum":
        return F.sum(num)
    if kind in ("avg", "average", "mean"):
        return F.avg(num)
    if kind == "min":
        return F.min(num)
    if kind == "max":
        return F.max(num)
    if kind == "count":
        return F.count(raw if raw is not None else F.lit(1))
    if kind == "count_distinct":
        return F.count_distinct(raw if raw is not None else num)
    raise ValueError(f"unknown aggregation: {kind}")


# ------------------------------------------------------------------ A1, A2
def kpi_expr(df: DataFrame, metric: str | None, aggregation: str, digits: int = 4) -> Column:
    """A1 value expression (one scalar per table).

    count → non-null cells of ``metric`` (all rows when the column is absent);
    sum → 0 when nothing is numeric; avg/min/max → 0 on an all-null column and
    null when cells exist but none is numeric.
    """
    aggregation = (aggregation or "").lower()
    if aggregation not in FV.WIDGET_AGGREGATIONS:
        raise ValueError(f"aggregation invalide: {aggregation}")
    if aggregation == "count":
        if metric and metric in df.columns:
            return F.count(F.col(metric)).cast("double")
        return F.count(F.lit(1)).cast("double")
    if not metric or metric not in df.columns:
        raise ValueError(f"colonne inexistante: {metric}")
    num = as_number(df, metric)
    present = F.count(F.col(metric))
    if aggregation == "sum":
        value = F.coalesce(F.sum(num), F.lit(0.0))
    else:
        value = F.when(present == 0, F.lit(0.0)).otherwise(_agg(aggregation, num))
    return F.round(value, digits)


def kpis(df: DataFrame, specs: Sequence[tuple[str, str | None, str]], digits: int = 4) -> DataFrame:
    """A1/W6 scan sharing: many KPIs ``(name, metric, aggregation)`` in one ``agg``."""
    return df.agg(*[kpi_expr(df, m, a, digits).alias(n) for n, m, a in specs])


def kpi_sql(df: DataFrame, field: str | None, calculation: str, digits: int = 4) -> Column:
    """A2: SUM/AVG/MIN/MAX/COUNT/COUNT DISTINCT with null → 0."""
    kind = FV.CALCULATIONS.get(calculation, calculation).lower()
    if kind == "count":
        value = F.count(F.col(field)) if field else F.count(F.lit(1))
    elif kind == "count_distinct":
        value = F.count_distinct(F.col(field))
    else:
        value = _agg(kind, as_number(df, field))
    return F.round(F.coalesce(value.cast("double"), F.lit(0.0)), digits)


# ------------------------------------------------------------------ A3, T1
def grouped_chart(
    df: DataFrame,
    x: str,
    y: str | None,
    aggregation: str = "sum",
    limit: int = FV.DEFAULT_TOP_N,
    null_label: str = NULL_LABEL,
    digits: int = 4,
) -> DataFrame:
    """A3 bar/pie: group on ``x`` (null group kept), drop null values, top ``limit``.

    ``count`` counts rows of the group (including null ``y``).  Ties are broken
    by label so the result is deterministic.
    """
    aggregation = (aggregation or "sum").lower()
    if aggregation not in FV.WIDGET_AGGREGATIONS:
        aggregation = "sum"
    if x not in df.columns:
        raise ValueError("groupement invalide")
    if aggregation == "count":
        value = F.count(F.lit(1)).cast("double")
    else:
        if not y or y not in df.columns:
            raise ValueError("mesure invalide")
        value = _agg(aggregation, as_number(df, y))
    out = (
        df.groupBy(F.col(x).alias("__key"))
        .agg(value.alias("value"))
        .where(F.col("value").isNotNull())
        .select(F.coalesce(as_label("__key"), F.lit(null_label)).alias("label"), F.round("value", digits).alias("value"))
    )
    return out.orderBy(F.desc("value"), F.asc("label")).limit(int(limit))


# ------------------------------------------------------------------------ A4
def sql_chart(
    df: DataFrame,
    category: str,
    value_field: str | None,
    calculation: str = "Total",
    limit: int = FV.DEFAULT_SQL_TOP_N,
    is_date: bool | None = None,
    latest: bool = False,
    digits: int = 4,
    secondary_value_field: str | None = None,
) -> DataFrame:
    """A4: null keys dropped, value null → 0; top by value, or by key for dates.

    Date keys return the earliest ``limit`` keys (``latest=True`` for the most
    recent, still listed ascending).  ``secondary_value_field`` adds a second
    measure computed by the same ``groupBy`` (Combined charts).
    """
    if is_date is None:
        is_date = is_temporal_type(dtype_of(df, category))
    aggs = [kpi_sql(df, value_field, calculation, digits).alias("value")]
    if secondary_value_field:
        aggs.append(kpi_sql(df, secondary_value_field, calculation, digits).alias("value2"))
    grouped = not_null(df, category).groupBy(F.col(category).alias("__key")).agg(*aggs)
    if is_date:
        ordered = grouped.orderBy(F.desc("__key") if latest else F.asc("__key")).limit(int(limit))
        if latest:
            ordered = ordered.orderBy("__key")
    else:
        ordered = grouped.orderBy(F.desc("value"), F.asc(as_label("__key"))).limit(int(limit))
    cols = [as_label("__key").alias("label"), "value"] + (["value2"] if secondary_value_field else [])
    return ordered.select(*cols)


# ------------------------------------------------------------------------ A5
def monthly_series(
    df: DataFrame, x: str, y: str | None, aggregation: str = "sum", digits: int = 4, day_first: bool | None = None
) -> DataFrame:
    """A5 line chart: group by calendar month of ``x``; rows whose date does not parse are dropped.

    ``day_first`` left open takes, for text, the order that reads more values of the whole column.

    When ``x`` is text and no value parses at all, the raw value is the key
    (a one-row probe decides).
    """
    aggregation = (aggregation or "sum").lower()
    dt = dtype_of(df, x)
    if isinstance(dt, T.StringType):
        df = df.withColumn(x, P.normalise_missing(x))
        ts = P.parse_timestamp(x, P.date_orders(df, [x], clean=False)[x] if day_first is None else day_first, clean=False, strict=True)
    else:
        ts = P.to_timestamp_any(x, dt.simpleString())
    use_dates = True
    if not is_temporal_type(dt):
        use_dates = len(df.where(ts.isNotNull()).select(F.lit(1)).limit(1).collect()) > 0
    if use_dates:
        staged = df.withColumn("__ts", ts)
        base = staged.where(F.col("__ts").isNotNull()).withColumn("__key", P.month_label("__ts"))
    else:
        base = df.withColumn("__key", as_label(x))
    if aggregation == "count":
        value = F.count(F.lit(1)).cast("double")
    else:
        value = _agg(aggregation, as_number(df, y))
    return (
        base.groupBy("__key")
        .agg(value.alias("value"))
        .where(F.col("value").isNotNull())
        .select(F.col("__key").alias("label"), F.round("value", digits).alias("value"))
        .orderBy("label")
    )


# ------------------------------------------------------------------------ A6
def between_dates(df: DataFrame, col: str, date_from, date_to) -> DataFrame:
    """``date_from <= col < date_to + 1 day`` (the upper day is included whole)."""
    c = F.col(col)
    return df.where((c >= F.to_date(F.lit(str(date_from)))) & (c < F.date_add(F.to_date(F.lit(str(date_to))), 1)))


def activity_series(df: DataFrame, ts_col: str, group_by: str = "day", date_from=None, date_to=None, today=None) -> DataFrame:
    """Counts per day / ISO week / month between two dates (default: last 30 days to ``today``)."""
    if date_to is None:
        date_to = today
    if date_from is None:
        date_from = F.date_sub(F.to_date(F.lit(str(today))), 30)
        df = df.where((F.col(ts_col) >= date_from) & (F.col(ts_col) < F.date_add(F.to_date(F.lit(str(date_to))), 1)))
    else:
        df = between_dates(df, ts_col, date_from, date_to)
    return (
        df.groupBy(P.period_label(ts_col, group_by).alias("period"))
        .agg(F.count(F.lit(1)).alias("imports"))
        .orderBy("period")
    )


# ------------------------------------------------------------------------ A7
def histogram_bin_count(n: int) -> int:
    return min(10, max(4, int(math.sqrt(n))))


def histogram(df: DataFrame, col: str, digits: int = 2) -> DataFrame:
    """Equal-width bins between min and max; last bin closed; empty bins kept.

    Pass 1 is a one-row ``agg`` (min, max, count) brought to the driver; pass 2
    is a partial-aggregated ``groupBy(bin)`` left-joined to the ≤10 bin ids.
    """
    spark = df.sparkSession
    num = as_number(df, col)
    values = df.select(num.alias("v")).where(F.col("v").isNotNull())
    row = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n")).collect()[0]
    schema = "bin int, bin_lo double, bin_hi double, label string, count long"
    if not row["n"]:
        return spark.createDataFrame([], schema)
    lo, hi, n = float(row["lo"]), float(row["hi"]), int(row["n"])
    if lo == hi:
        return values.agg(
            F.lit(0).alias("bin"), F.lit(lo).alias("bin_lo"), F.lit(hi).alias("bin_hi"),
            F.lit(str(lo)).alias("label"), F.count(F.lit(1)).alias("count"),
        )
    k = histogram_bin_count(n)
    width = (hi - lo) / k
    idx = F.least(F.lit(k - 1), F.floor((F.col("v") - F.lit(lo)) / F.lit(width)).cast("int"))
    counts = values.groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    bins = spark.range(k).select(F.col("id").cast("int").alias("bin"))
    lo_c = F.lit(lo) + F.col("bin") * F.lit(width)
    hi_c = F.lit(lo) + (F.col("bin") + 1) * F.lit(width)
    return (
        bins.join(counts, "bin", "left")
        .select(
            "bin",
            F.round(lo_c, digits).alias("bin_lo"),
            F.round(hi_c, digits).alias("bin_hi"),
            F.concat(F.format_string("%.2f", lo_c), F.lit(" - "), F.format_string("%.2f", hi_c)).alias("label"),
            F.coalesce("count", F.lit(0)).cast("long").alias("count"),
        )
        .orderBy("bin")
    )


# ------------------------------------------------------------------------ A8
def filter_values(df: DataFrame, col: str, limit: int = FV.FILTER_VALUES_LIMIT) -> DataFrame:
    """The ``limit`` most frequent non-null values, as text."""
    return (
        df.where(F.col(col).isNotNull())
        .groupBy(as_label(col).alias("value"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), F.asc("value"))
        .limit(int(limit))
    )


# ----------------------------------------------------------------------- A19
def percent_of_total(chart: DataFrame, value: str = "value", digits: int = 1) -> DataFrame:
    """Share of each slice.  ``chart`` is already a top-N result (bounded rows)."""
    return chart.withColumn("percent", F.round(F.col(value) * 100 / F.sum(value).over(Window.partitionBy()), digits))


# ----------------------------------------------------------------- P8, P11, T3
def search(df: DataFrame, text: str | None, columns: Iterable[str] | None = None) -> DataFrame:
    """Rows where any column, as text, contains ``text`` (case-insensitive)."""
    if not text:
        return df
    needle = str(text).lower()
    cols = list(columns or df.columns)
    cond = None
    for c in cols:
        term = F.coalesce(F.lower(F.col(c).cast("string")).contains(needle), F.lit(False))
        cond = term if cond is None else (cond | term)
    return df.where(cond)


def page(
    df: DataFrame,
    start: int = 0,
    length: int = 50,
    search_text: str | None = None,
    order_by: str | None = None,
    order_dir: str = "asc",
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """Search, order by the chosen column (+ tie-break), offset and limit."""
    rows = search(df, search_text)
    keys: list[Column] = []
    if order_by in df.columns:
        keys.append(F.desc_nulls_last(order_by) if str(order_dir).lower() == "desc" else F.asc_nulls_first(order_by))
    keys += [F.asc(c) for c in tiebreak if c != order_by]
    if keys:
        rows = rows.orderBy(*keys)
    return rows.offset(int(start)).limit(int(length))


def page_counts(df: DataFrame, search_text: str | None = None) -> DataFrame:
    """T3 totals in one scan: ``total`` ignores the search, ``matched`` applies it."""
    matched = search(df.select(F.lit(True).alias("__all"), "*"), search_text) if search_text else None
    if matched is None:
        return df.agg(F.count(F.lit(1)).alias("total"), F.count(F.lit(1)).alias("matched"))
    cond = None
    for c in df.columns:
        term = F.coalesce(F.lower(F.col(c).cast("string")).contains(str(search_text).lower()), F.lit(False))
        cond = term if cond is None else (cond | term)
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(cond).alias("matched"))


# ------------------------------------------------------------------ T4, P14
def scatter(df: DataFrame, x: str, y: str, order_by: Sequence[str], limit: int = FV.SCATTER_POINTS_LIMIT) -> DataFrame:
    """T4: first ``limit`` points where both measures are present, in ``order_by`` order."""
    return (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .orderBy(*order_by)
        .limit(int(limit))
        .select(as_number(df, x).alias("x"), as_number(df, y).alias("y"))
    )


def table_widget(
    df: DataFrame, columns: Sequence[str] | None = None, limit: int = FV.TABLE_ROWS_LIMIT, order_by: Sequence[str] = ()
) -> DataFrame:
    """Requested columns that exist (else all), first ``limit`` rows."""
    keep = [c for c in (columns or []) if c in df.columns] or list(df.columns)
    out = df.select(*keep)
    if order_by:
        out = out.orderBy(*order_by)
    return out.limit(int(limit))


# ----------------------------------------------------------------------- P12
def apply_filters(df: DataFrame, filters: Sequence[dict]) -> DataFrame:
    """Dashboard filters AND-ed before aggregation.

    ``{"type": "select", "field", "value"}`` (=), ``multi_select`` (in),
    ``date_range`` (``from``/``to``, whole upper day), ``number_range``
    (``min``/``max`` inclusive), ``search`` (contains, case-insensitive).
    Empty values are ignored, as an unset control is; an unknown field is an
    error.  Literals take the column's type, so the filters reach the scan.
    """
    for f in filters or []:
        kind, field, value = f.get("type", "select"), f.get("field"), f.get("value")
        if field not in df.columns:
            raise ValueError(f"filter on unknown field {field!r}")
        c, dt = F.col(field), dtype_of(df, field)
        typed = lambda v: F.lit(str(v)).try_cast(dt)  # noqa: E731, B023
        if kind == "select" and value not in (None, ""):
            df = df.where(c == typed(value))
        elif kind == "multi_select" and value:
            df = df.where(c.isin([typed(v) for v in value]))
        elif kind == "date_range":
            if f.get("from"):
                df = df.where(c >= F.to_date(F.lit(str(f["from"]))))
            if f.get("to"):
                df = df.where(c < F.date_add(F.to_date(F.lit(str(f["to"]))), 1))
        elif kind == "number_range":
            num = c if is_numeric_type(dt) else as_number(df, field)
            if isinstance(dt, (T.FloatType, T.DoubleType)) and f.get("min") is not None and f.get("max") is None:
                df = df.where(~F.isnan(c))  # NaN sorts above every bound
            if f.get("min") is not None:
                df = df.where(num >= F.lit(float(f["min"])))
            if f.get("max") is not None:
                df = df.where(num <= F.lit(float(f["max"])))
        elif kind == "search" and value:
            df = df.where(F.lower(c.cast("string")).contains(str(value).lower()))
    return df


def not_null(df: DataFrame, *cols: str) -> DataFrame:
    """P7."""
    cond = None
    for c in cols:
        cond = F.col(c).isNotNull() if cond is None else (cond & F.col(c).isNotNull())
    return df.where(cond) if cond is not None else df
