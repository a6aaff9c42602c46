"""Star schema.

Dimensions are the distinct values of category and date columns with a
surrogate id in sorted value order; the fact table keeps measures and swaps
each dimension column for its id.  Joins to dimensions carry no hint: Spark
picks them by measured size.  Ids come from ``sequential_id`` (per-segment
offsets), never from a window without a partition over rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.functions import fixed_values as FV
from tablewise.functions import names as N
from tablewise.functions import parse as P
from tablewise.session import checkpoint, sequential_id
from tablewise.sources.tables import drop_table, table_exists


@dataclass
class Star:
    fact: DataFrame
    dimensions: dict[str, DataFrame] = field(default_factory=dict)
    dimension_kinds: dict[str, str] = field(default_factory=dict)
    dimension_rows: dict[str, int] = field(default_factory=dict)
    measures: list[str] = field(default_factory=list)


def _ids(members: DataFrame, order: str) -> DataFrame:
    return sequential_id(members, [order], "id")


def all_members(df: DataFrame, categories: Sequence[str], dates: Sequence[str]) -> DataFrame | None:
    """Distinct members of every dimension column from one scan (``GROUPING SETS``).

    Rows are (``__dim``, ``__text``, ``__date``); the result has one row per
    member, so it is checkpointed once and each dimension reads its slice.
    """
    cols = list(categories) + list(dates)
    if not cols:
        return None
    keyed = df.select(
        *[F.col(c).cast("string").alias(f"__c{i}") for i, c in enumerate(categories)],
        *[F.to_date(c).alias(f"__d{i}") for i, c in enumerate(dates)],
    )
    keys = [f"__c{i}" for i in range(len(categories))] + [f"__d{i}" for i in range(len(dates))]
    g = keyed.groupingSets([[k] for k in keys], *keys).agg(*[F.grouping(k).alias(f"g{k}") for k in keys])
    text = F.coalesce(*[F.when(F.col(f"g__c{i}") == 0, F.col(f"__c{i}")) for i in range(len(categories))], F.lit(None).cast("string"))
    date = F.coalesce(*[F.when(F.col(f"g__d{i}") == 0, F.col(f"__d{i}")) for i in range(len(dates))], F.lit(None).cast("date"))
    dim = F.coalesce(
        *[F.when(F.col(f"g__c{i}") == 0, F.lit(c)) for i, c in enumerate(categories)],
        *[F.when(F.col(f"g__d{i}") == 0, F.lit(c)) for i, c in enumerate(dates)],
    )
    return checkpoint(g.select(dim.alias("__dim"), text.alias("__text"), date.alias("__date")))


def member_counts(members: DataFrame | None) -> dict[str, int]:
    """Rows of every dimension from one aggregate over :func:`all_members`."""
    if members is None:
        return {}
    counted = members.where("__text is not null or __date is not null").groupBy("__dim").agg(F.count(F.lit(1)).alias("n"))
    return {r["__dim"]: int(r["n"]) for r in counted.collect()}  # one row per dimension column


def category_dimension(df: DataFrame, column: str, members_all: DataFrame | None = None) -> DataFrame:
    """M1: (id, value, source_value) — distinct non-null values as text, id in value order.

    ``value`` is cut to 255 characters for display; ``source_value`` keeps the
    whole text so the fact lookup never misses a long value.
    """
    if members_all is not None:
        members = members_all.where((F.col("__dim") == column) & F.col("__text").isNotNull()).select(
            F.col("__text").alias("source_value"))
    else:
        members = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("source_value")).distinct()
    return _ids(members, "source_value").select("id", P.truncate_text("source_value").alias("value"), "source_value")


def date_dimension(df: DataFrame, column: str, members_all: DataFrame | None = None) -> DataFrame:
    """M2: (id, value, year, month, day) — distinct dates, id in date order."""
    if members_all is not None:
        members = members_all.where((F.col("__dim") == column) & F.col("__date").isNotNull()).select(F.col("__date").alias("value"))
    else:
        members = df.where(F.col(column).isNotNull()).select(F.to_date(column).alias("value")).distinct()
    return _ids(members, "value").select("id", "value", *P.date_parts("value"))


def dimension_columns(prof: DataFrame, modern: bool = True) -> tuple[list[str], list[str], list[str]]:
    """M5: (category columns, date columns, measure columns) from a profile.

    Category = Dimension or Attribute with ≤100 distinct values (``modern``) or
    role Dimension (legacy); date = Date Dimension; measure = numeric Measure.
    """
    rows = prof.select("name", "semantic_role", "detected_type", "unique_count").collect()
    cats, dates, measures = [], [], []
    for r in rows:
        role = r["semantic_role"]
        if role == "Date Dimension":
            dates.append(r["name"])
        elif role == "Measure" and r["detected_type"] in ("Number", "Currency"):
            measures.append(r["name"])
        elif modern and role in ("Dimension", "Attribute") and r["unique_count"] <= FV.CATEGORY_DIMENSION_MAX_DISTINCT:
            cats.append(r["name"])
        elif not modern and role == "Dimension":
            cats.append(r["name"])
    return cats, dates, measures


def lookup(fact: DataFrame, dim: DataFrame, column: str, dim_key: str, id_name: str) -> DataFrame:
    """Left equi-join fact → dimension id; unmatched and null keys get a null id."""
    side = dim.select(F.col(dim_key).alias("__k"), F.col("id").alias(id_name))
    key = F.col(column).cast("string") if dim_key == "source_value" else F.to_date(column)
    return fact.join(side, key == F.col("__k"), "left").drop("__k")


def build_star(
    clean: DataFrame,
    categories: Sequence[str],
    dates: Sequence[str],
    measures: Sequence[str],
    order_by: Sequence[str],
) -> Star:
    """M3: fact (source_row_id, measures, ``<col>_id`` keys) plus its dimensions.

    ``source_row_id`` is 1..n in ``order_by`` order (V2).  Foreign keys are
    tracked by name, not guessed from an ``_id`` suffix.
    """
    star = Star(fact=clean, measures=list(measures))
    members = all_members(clean, categories, dates)
    found = member_counts(members)
    base = sequential_id(clean.select(*dict.fromkeys([*order_by, *measures, *categories, *dates])), list(order_by), "source_row_id")
    fact = base
    for kind, columns, make, key in (("Category", categories, category_dimension, "source_value"), ("Date", dates, date_dimension, "value")):
        for c in columns:
            star.dimensions[c], star.dimension_kinds[c], star.dimension_rows[c] = make(clean, c, members), kind, found.get(c, 0)
            fact = lookup(fact, star.dimensions[c], c, key, f"{c}_id")
    keys = [f"{c}_id" for c in star.dimensions]
    star.fact = fact.select("source_row_id", *[F.col(m).cast("double").alias(m) for m in measures], *keys)
    return star


MANIFEST = "dataset string, table string, kind string, source_column string, row_count long, columns array<string>, numeric_columns array<string>, date_columns array<string>, category_columns array<string>"


def model_tables(star: Star, dataset: str, raw: DataFrame | None = None, clean: DataFrame | None = None) -> dict[str, tuple[str, str | None, DataFrame]]:
    """The tables of a model: name → (kind, source column, rows)."""
    out: dict[str, tuple[str, str | None, DataFrame]] = {}
    for kind, rows in (("Raw", raw), ("Clean", clean), ("Fact", star.fact)):
        if rows is not None:
            out[N.table_name(kind.lower(), dataset)] = (kind, None, rows)
    for c, dim in star.dimensions.items():
        out[N.dimension_table_name(c, dataset)] = (star.dimension_kinds[c], c, dim)
    return out


def write_star(star: Star, base_path: str, dataset: str, raw: DataFrame | None = None, clean: DataFrame | None = None, mode: str = "overwrite") -> DataFrame:
    """Every table of the model as Parquet under ``base_path``; returns the manifest, written last.

    The manifest has a row for each table — raw, clean, fact, dimensions — with
    its row count and columns; the fact's row also names the measures, dates
    and categories.  Counts are read from the footers of the written files, so
    they hold for what is there, whatever a retried task wrote before.
    """
    spark = star.fact.sparkSession
    kinds = {k: [c for c, kind in star.dimension_kinds.items() if kind == k] for k in ("Date", "Category")}
    rows = []
    for name, (kind, source, table) in model_tables(star, dataset, raw, clean).items():
        path = f"{base_path}/{name}"
        table.write.mode(mode).parquet(path)
        typed = (star.measures, kinds["Date"], kinds["Category"]) if kind == "Fact" else (None, None, None)
        rows.append((dataset, name, kind, source, spark.read.schema(table.schema).parquet(path).count(), table.columns, *typed))
    found = spark.createDataFrame(rows, MANIFEST)
    found.write.mode(mode).parquet(manifest_path(base_path, dataset))
    return found


def manifest_path(base_path: str, dataset: str) -> str:
    return f"{base_path}/{N.table_name('model', dataset)}"


def dataset_tables(spark: SparkSession, base_path: str, dataset: str) -> DataFrame:
    """The tables that a dataset's manifest names, and whether each is there."""
    path = manifest_path(base_path, dataset)
    if not table_exists(spark, path):
        return spark.createDataFrame([], "table string, kind string, present boolean")
    named = spark.read.schema(MANIFEST).parquet(path).select("table", "kind").collect()  # one row per table of a dataset
    rows = [(r["table"], r["kind"], table_exists(spark, f"{base_path}/{r['table']}")) for r in named]
    return spark.createDataFrame(rows, "table string, kind string, present boolean")


def drop_dataset(spark: SparkSession, base_path: str, dataset: str) -> DataFrame:
    """Remove every table that a dataset's manifest names, then the manifest; returns what was there.

    Only named tables go: others under the same path, or of datasets whose
    names begin alike, stay.  A dataset without a manifest has no tables.
    """
    found = dataset_tables(spark, base_path, dataset)
    for r in found.where("present").collect():
        drop_table(spark, f"{base_path}/{r['table']}")
    drop_table(spark, manifest_path(base_path, dataset))
    return found
