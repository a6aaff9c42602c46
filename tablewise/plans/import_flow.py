"""Entry 1 of the source system as one call: table → clean → rename → profile → score → star.

Each step appends a status record (started, finished, message) to a run-log
table (U4) in the shared folder; a failing step is logged and stops the run.
All heavy work is the operators' DataFrame plans; the driver only sequences
steps and keeps the small reports.
"""

from __future__ import annotations

import datetime
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tablewise.functions import names as N
from tablewise.operators import catalog as C
from tablewise.operators import clean as CL
from tablewise.operators import profile as PR
from tablewise.operators import quality as QL
from tablewise.operators import warehouse as W
from tablewise.session import checkpoint, shared_path


@dataclass
class ImportResult:
    run_id: str
    log_path: str
    clean: DataFrame | None = None
    profile: DataFrame | None = None
    quality: dict = field(default_factory=dict)
    manifest: DataFrame | None = None
    report: CL.CleanReport | None = None


def run_import(df: DataFrame, dataset: str, order_by: list[str], out_path: str | None = None) -> ImportResult:
    """Run the import flow on ``df``; tables are written under ``out_path`` (default: shared folder)."""
    spark = df.sparkSession
    run_id = uuid.uuid4().hex[:12]
    base = out_path or shared_path(spark, f"import-{N.scrub_label(dataset)}")
    log_path = f"{base}/{N.table_name('run_log', dataset)}"
    result = ImportResult(run_id=run_id, log_path=log_path)

    def step(name, fn):
        started = datetime.datetime.now()
        try:
            message = fn() or ""
            C.log_step(spark, log_path, run_id, name, "Success", started, datetime.datetime.now(), message)
        except Exception as exc:  # the failure is recorded, then the run stops
            C.log_step(spark, log_path, run_id, name, "Failed", started, datetime.datetime.now(), str(exc))
            raise

    state: dict = {}

    def do_clean():
        clean, report = CL.clean_dataset(df, materialize=True)
        state["clean"], result.report = clean, report
        return "; ".join(report.log)

    def do_rename():
        renamed, mapping, labels = N.rename_readable(state["clean"])
        state.update(renamed=renamed, originals={v: k for k, v in mapping.items()}, labels=labels)
        return f"{len(mapping)} columns"

    def do_profile():
        renamed_of = {old: new for new, old in state["originals"].items()}
        state["order"] = [renamed_of.get(k, k) for k in order_by]
        prof = PR.profile(state["renamed"], state["originals"], state["labels"], order_by=state["order"])
        # one row per column, read by three later steps: computed once
        result.profile = prof = checkpoint(prof)
        state["prof_rows"] = prof.count()
        return f"{state['prof_rows']} columns profiled"

    def do_quality():
        errors = result.report.conversion_errors if result.report else {}
        result.quality = QL.dataset_quality(state["renamed"], result.profile, errors)
        return f"score {result.quality['score']}"

    def do_tables():
        clean = result.clean = state["renamed"]
        cats, dates, measures = W.dimension_columns(result.profile)
        star = W.build_star(clean, cats, dates, measures, state["order"])
        result.manifest = W.write_star(star, base, dataset, raw=raw_names(df, state["originals"]), clean=clean)
        return f"{len(cats)} category and {len(dates)} date dimensions"

    for name, fn in [("clean", do_clean), ("rename", do_rename), ("profile", do_profile),
                     ("quality", do_quality), ("tables", do_tables)]:
        step(name, fn)
    return result


def raw_names(df: DataFrame, originals: dict[str, str]) -> DataFrame:
    """The raw rows under the names of the cleaned columns; columns that cleaning removed get readable names too."""
    known = {old: new for new, old in originals.items()}
    return df.toDF(*N.unique_names(known.get(c) or N.readable_names([c])[0] for c in df.columns))


def run_log(spark, result: ImportResult) -> DataFrame:
    """The run's step records with durations (U4)."""
    return C.run_durations(spark.read.parquet(result.log_path))
