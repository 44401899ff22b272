"""Job-run records."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickfold.functions.clock import ntz
from clickfold.schemas import JOB_RUNS

SUCCESS = "success"
FAILED = "failed"


def run_record(
    spark: SparkSession,
    run_id: str,
    dag_id: str,
    status: str,
    started_at: dt.datetime,
    finished_at: dt.datetime | None = None,
    records_processed: int | None = None,
    error_message: str | None = None,
    batch_id: int | None = None,
) -> DataFrame:
    values = {
        "run_id": run_id,
        "dag_id": dag_id,
        "status": status,
        "started_at": started_at,
        "finished_at": finished_at,
        "records_processed": records_processed,
        "error_message": error_message,
        "batch_id": batch_id,
    }
    columns = []
    for field in JOB_RUNS:
        value = values[field.name]
        literal = ntz(value) if isinstance(value, dt.datetime) else F.lit(value)
        columns.append(literal.cast(field.dataType).alias(field.name))
    return spark.range(1).select(*columns)


def run_summary(runs: DataFrame) -> DataFrame:
    """Runs, records and run time per job and status."""
    seconds = F.timestamp_diff("SECOND", F.col("started_at"), F.col("finished_at"))
    return runs.groupBy("dag_id", "status").agg(
        F.count(F.lit(1)).alias("runs"),
        F.coalesce(F.sum("records_processed"), F.lit(0)).alias("records_processed"),
        F.sum(seconds).alias("total_seconds"),
        F.max(seconds).alias("max_seconds"),
        F.count("error_message").alias("errors"),
    )
