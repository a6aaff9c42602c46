"""Catalog and usage analytics.

These run on any table of jobs/events/documents: an *owner* column, a *start*
timestamp, a *status*, keys that reference another table.  Every summary is
one aggregate: "top owner" and "peak day" use ``min_by`` over a
(−count, key) struct instead of a sort, so no step gathers all owners or days
into one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _day(c: str | Column) -> Column:
    return F.to_date(F.col(c) if isinstance(c, str) else c)


# ----------------------------------------------------------------------- A14
def top_owner(df: DataFrame, owner: str) -> DataFrame:
    """Most frequent owner, its count and share (1 dp); ties → smallest owner."""
    per = df.groupBy(F.col(owner).alias("user")).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.min_by("user", F.struct(-F.col("n"), F.col("user"))).alias("user"),
        F.max("n").alias("total"),
        F.round(F.max("n") * 100.0 / F.sum("n"), 1).alias("percentage"),
    )


# ----------------------------------------------------------------------- A15
def period_counts(df: DataFrame, ts: str, today) -> DataFrame:
    """Counts today / since today−6 / since the 1st of the month, and the peak day."""
    t = F.to_date(F.lit(str(today)))
    per_day = df.groupBy(_day(ts).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return per_day.agg(
        F.coalesce(F.sum(F.when(F.col("d") == t, F.col("n"))), F.lit(0)).alias("imports_today"),
        F.coalesce(F.sum(F.when(F.col("d") >= F.date_sub(t, 6), F.col("n"))), F.lit(0)).alias("imports_this_week"),
        F.coalesce(F.sum(F.when(F.col("d") >= F.trunc(t, "month"), F.col("n"))), F.lit(0)).alias("imports_this_month"),
        F.date_format(F.min_by("d", F.struct(-F.col("n"), F.col("d"))), "yyyy-MM-dd").alias("peak_period"),
    )


# ----------------------------------------------------------------------- A16
def usage_rate(catalog: DataFrame, key: str, usage: DataFrame, ref: str) -> DataFrame:
    """Distinct referenced keys vs catalog size → used, unused, percentage (1 dp).

    Both sides are stacked (``unionByName``) and read by one aggregate, so
    there is no join at all.
    """
    stacked = catalog.select(F.col(key).cast("string").alias("__c"), F.lit(None).cast("string").alias("__u")).unionByName(
        usage.select(F.lit(None).cast("string").alias("__c"), F.col(ref).cast("string").alias("__u"))
    )
    counts = stacked.agg(F.count("__c").alias("total"), F.count_distinct("__u").alias("used"))
    return counts.select(
        "total",
        "used",
        F.greatest(F.col("total") - F.col("used"), F.lit(0)).alias("unused"),
        F.when(F.col("total") > 0, F.round(F.col("used") * 100.0 / F.col("total"), 1)).otherwise(F.lit(0.0)).alias("percentage"),
    )


# ------------------------------------------------------------------------ U1
def usage_summary(df: DataFrame, owner: str, ts: str, today) -> DataFrame:
    """U1 on one job/event table: totals, top owner with share, period counts, peak day.

    One ``GROUPING SETS ((owner), (day))`` shuffle feeds a single global
    aggregate; the grouping id tells owner rows from day rows.
    """
    t = F.to_date(F.lit(str(today)))
    g = (
        df.select(F.col(owner).alias("owner"), _day(ts).alias("d"))
        .groupingSets([["owner"], ["d"]], "owner", "d")
        .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))
    )
    by_owner = F.col("gid") == 1  # d aggregated away
    by_day = F.col("gid") == 2
    n = F.col("n")
    return g.agg(
        F.sum(F.when(by_owner, n)).alias("total"),
        F.count_if(by_owner).alias("owners"),
        F.min_by(F.when(by_owner, F.col("owner")), F.when(by_owner, F.struct(-n, F.col("owner")))).alias("top_owner"),
        F.max(F.when(by_owner, n)).alias("top_owner_total"),
        F.round(F.max(F.when(by_owner, n)) * 100.0 / F.sum(F.when(by_owner, n)), 1).alias("top_owner_percentage"),
        F.coalesce(F.sum(F.when(by_day & (F.col("d") == t), n)), F.lit(0)).alias("today"),
        F.coalesce(F.sum(F.when(by_day & (F.col("d") >= F.date_sub(t, 6)), n)), F.lit(0)).alias("this_week"),
        F.coalesce(F.sum(F.when(by_day & (F.col("d") >= F.trunc(t, "month")), n)), F.lit(0)).alias("this_month"),
        F.date_format(F.min_by(F.when(by_day, F.col("d")), F.when(by_day, F.struct(-n, F.col("d")))), "yyyy-MM-dd").alias("peak_day"),
    )


@dataclass
class Catalog:
    """A table of an admin summary: who owns a row, when it began, its key, and the table that refers to it."""

    rows: DataFrame
    owner: str | None = None
    started: str | None = None
    key: str | None = None
    used_by: DataFrame | None = None
    reference: str | None = None


def admin_summary(catalogs: dict[str, Catalog], today) -> DataFrame:
    """U1 over several tables: per table totals, top owner with share, period counts, peak day and usage rate.

    All tables, and the references to them, are one tagged union; one
    ``GROUPING SETS ((table, owner), (table, day), (table, reference))`` counts
    them and one aggregate per table reads the counts.  An owner, day or
    reference that holds a third of all rows is added up before the shuffle.
    A table without owner, start or references has nulls there; usage counts
    distinct non-null references against the table's rows.
    """
    null = lambda kind: F.lit(None).cast(kind)
    parts = []
    for name, c in catalogs.items():
        owner = F.col(c.owner).cast("string") if c.owner else null("string")
        day = _day(c.started) if c.started else null("date")
        parts.append(c.rows.select(F.lit(name).alias("table"), owner.alias("owner"), day.alias("day"), null("string").alias("ref"), F.lit(True).alias("own")))
        if c.used_by is not None:
            refs = c.used_by.where(F.col(c.reference).isNotNull())
            parts.append(refs.select(F.lit(name).alias("table"), null("string").alias("owner"), null("date").alias("day"), F.col(c.reference).cast("string").alias("ref"), F.lit(False).alias("own")))
    g = (
        reduce(DataFrame.unionByName, parts)
        .groupingSets([["table", "owner"], ["table", "day"], ["table", "ref"]], "table", "owner", "day", "ref")
        .agg(F.count_if("own").alias("n"), F.grouping("owner").alias("g_owner"), F.grouping("day").alias("g_day"), F.grouping("ref").alias("g_ref"))
    )
    t, n = F.to_date(F.lit(str(today))), F.col("n")
    by_owner, by_day, by_ref = ((F.col(f"g_{k}") == 0) & F.col(k).isNotNull() for k in ("owner", "day", "ref"))
    first = lambda cond, c: F.min_by(F.when(cond, F.col(c)), F.when(cond & (n > 0), F.struct(-n, F.col(c))))
    since = lambda cond: F.coalesce(F.sum(F.when(by_day & cond, n)), F.lit(0))
    total = F.sum(F.when(F.col("g_owner") == 0, n))
    used = F.count_if(by_ref)
    owned, referred = ([k for k, c in catalogs.items() if c.owner], [k for k, c in catalogs.items() if c.used_by is not None])
    out = g.groupBy("table").agg(
        total.alias("total"),
        first(by_owner, "owner").alias("top_owner"),
        F.max(F.when(by_owner & (n > 0), n)).alias("top_owner_total"),
        since(F.col("day") == t).alias("today"),
        since(F.col("day") >= F.date_sub(t, 6)).alias("this_week"),
        since(F.col("day") >= F.trunc(t, "month")).alias("this_month"),
        F.date_format(first(by_day, "day"), "yyyy-MM-dd").alias("peak_day"),
        used.alias("used"),
    )
    share = lambda part: F.when(F.col("total") > 0, F.round(part * 100.0 / F.col("total"), 1)).otherwise(F.lit(0.0))
    has_owner, has_refs = F.col("table").isin(owned), F.col("table").isin(referred)
    return out.select(
        "table", "total", "top_owner", "top_owner_total", F.when(has_owner, share(F.coalesce("top_owner_total", F.lit(0)))).alias("top_owner_percentage"),
        "today", "this_week", "this_month", "peak_day", F.when(has_refs, F.col("used")).alias("used"),
        F.when(has_refs, F.greatest(F.col("total") - F.col("used"), F.lit(0))).alias("unused"), F.when(has_refs, share(F.col("used"))).alias("usage_percentage"),
    )


# ---------------------------------------------------------------- J2, J3, J4, J6
def without_reference(left: DataFrame, key: str, right: DataFrame, ref: str) -> DataFrame:
    """Rows of ``left`` whose key is not referenced by ``right`` (anti join)."""
    return left.join(right.select(F.col(ref).alias(key)).where(F.col(key).isNotNull()), key, "left_anti")


def with_reference(left: DataFrame, key: str, right: DataFrame, ref: str) -> DataFrame:
    """J6 filter form: rows of ``left`` that ``right`` references (semi join)."""
    return left.join(right.select(F.col(ref).alias(key)), key, "left_semi")


def flag_referenced(left: DataFrame, key: str, right: DataFrame, ref: str, flag: str = "is_favorite") -> DataFrame:
    """J3 mark join: ``flag`` true when ``right`` references the row's key.

    The right side is reduced to its distinct keys first (partial aggregation),
    so a key referenced a billion times adds one row to the join.
    """
    marks = right.select(F.col(ref).alias(key)).where(F.col(key).isNotNull()).distinct().withColumn(flag, F.lit(True))
    return left.join(marks, key, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def enrich_counts(left: DataFrame, key: str, right: DataFrame, ref: str, name: str = "n_refs") -> DataFrame:
    """Per-row count of referencing rows (pre-aggregated before the join)."""
    counts = right.groupBy(F.col(ref).alias(key)).agg(F.count(F.lit(1)).alias(name))
    return left.join(counts, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def enrich_lookup(left: DataFrame, key: str, right: DataFrame, right_key: str, columns: Sequence[str]) -> DataFrame:
    """Id → name/owner lookup (left join); Spark picks the join by the lookup side's measured bytes."""
    return left.join(right.select(F.col(right_key).alias(key), *columns), key, "left")


# ------------------------------------------------------------------------ D3
def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """D3: key combinations that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > 1)


# ---------------------------------------------------------------- P9, P10, T5
def filter_list(df: DataFrame, search: str | None = None, search_columns: Sequence[str] = (), equals: dict | None = None) -> DataFrame:
    """Equality filters AND-ed, then a case-insensitive contains OR-ed over columns."""
    for c, v in (equals or {}).items():
        if v not in (None, ""):
            df = df.where(F.col(c) == F.lit(v))
    if search:
        cond = None
        for c in search_columns:
            term = F.coalesce(F.lower(F.col(c).cast("string")).contains(search.lower()), F.lit(False))
            cond = term if cond is None else (cond | term)
        if cond is not None:
            df = df.where(cond)
    return df


def period_filter(df: DataFrame, ts: str, period: str | None, today) -> DataFrame:
    """P10 period: ``today``, ``7d`` (today−6 …), ``30d`` (today−29 …), ``year`` (1 January …)."""
    t = F.to_date(F.lit(str(today)))
    d = _day(ts)
    if period == "today":
        return df.where(d == t)
    if period == "7d":
        return df.where(d >= F.date_sub(t, 6))
    if period == "30d":
        return df.where(d >= F.date_sub(t, 29))
    if period == "year":
        return df.where(d >= F.trunc(t, "year"))
    return df


def text_filter(df: DataFrame, text: str | None, columns: Sequence[str]) -> DataFrame:
    """P10 text: contains over the fields joined by spaces (case-insensitive)."""
    if not text:
        return df
    blob = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]))
    return df.where(blob.contains(text.lower()))


def natural_key(c: str | Column) -> Column:
    """T5: case-insensitive, numeric-aware sort key ("item 2" < "item 10").

    A digit run becomes its length without leading zeros and the run, so text
    order equals number order at any length.
    """
    col = F.lower(F.col(c) if isinstance(c, str) else c)
    runs = F.regexp_extract_all(col, F.lit(r"(\d+|\D+)"), 1)
    def keyed(r: Column) -> Column:
        number = F.regexp_replace(r, r"^0+(?=\d)", "")
        return F.when(r.rlike(r"^\d"), F.concat(F.lpad(F.length(number).cast("string"), 10, "0"), number)).otherwise(r)

    return F.array_join(F.transform(runs, keyed), "")


def sorted_list(df: DataFrame, by: str, kind: str = "alpha", descending: bool = False, tiebreak: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """T5: alpha (natural, case-insensitive), size or date order; optional limit."""
    key = natural_key(by) if kind == "alpha" else F.col(by)
    order = [key.desc() if descending else key.asc()] + [F.asc(c) for c in tiebreak]
    out = df.orderBy(*order)
    return out.limit(limit) if limit else out


# ------------------------------------------------------------------------ U5
def home_summary(df: DataFrame, condition: Column, name: str = "ready") -> DataFrame:
    """U5 counts: total rows and rows meeting ``condition``."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(condition).alias(name))


def latest(df: DataFrame, ts: str, key: str, n: int = 6) -> DataFrame:
    """U5 list: the ``n`` most recent rows (ties by key)."""
    return df.orderBy(F.desc(ts), F.asc(key)).limit(n)


# ------------------------------------------------------------------------ U4
RUN_LOG_SCHEMA = "run_id string, step string, status string, started_at timestamp, finished_at timestamp, message string"


def log_step(spark, path: str, run_id: str, step: str, status: str, started, finished, message: str = "") -> None:
    """U4: append one step record to the run log table (Parquet, append-only)."""
    spark.createDataFrame([(run_id, step, status, started, finished, message)], RUN_LOG_SCHEMA).write.mode("append").parquet(path)


def run_durations(log: DataFrame) -> DataFrame:
    """U4: per run and step, last status and duration in seconds."""
    return log.select(
        "run_id", "step", "status", "started_at", "finished_at", "message",
        (F.unix_timestamp("finished_at") - F.unix_timestamp("started_at")).alias("duration_s"),
    )


def latest_per_group(df: DataFrame, group: Sequence[str], order: str, payload: Sequence[str]) -> DataFrame:
    """V4: latest row per parent via ``max_by`` (an aggregate: partial per task, no sort)."""
    return df.groupBy(*group).agg(
        F.max_by(F.struct(*[F.col(c) for c in [order, *payload]]), F.struct(F.col(order), *[F.col(c) for c in payload])).alias("__r")
    ).select(*group, *[F.col(f"__r.{c}").alias(c) for c in [order, *payload]])
