"""The whole job, from landed files to output tables."""

from __future__ import annotations

from collections.abc import Collection
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.series import SeriesKey
from tidemark.plans.forecast import Forecast, forecast
from tidemark.plans.panel import Rules
from tidemark.plans.staging import stage
from tidemark.settings import ANOMALY_RULES, ENTITIES, START_DATE
from tidemark.sinks.tables import append_history, write_snapshot
from tidemark.sources.history import read_history
from tidemark.sources.sheet import read_sheet


def load(
    spark: SparkSession, history_path: str, sheet_path: str, entities: Collection[str], first_day: str
) -> tuple[DataFrame, DataFrame]:
    """The two source panels of the tracked entities, whose other folders are not read.

    That a day occurs once for an entity in each of them is checked where they are merged.
    """
    history = read_history(spark, history_path, first_day, entities=entities)
    return history, read_sheet(spark, sheet_path, list(entities))


def run(
    spark: SparkSession,
    history_path: str,
    sheet_path: str,
    snapshot_path: str,
    runs_path: str,
    as_of: date | str | None = None,
    entities: Collection[str] = ENTITIES,
    rules: Rules = ANOMALY_RULES,
    first_day: str = START_DATE,
    run_at: datetime | None = None,
    key: SeriesKey = SeriesKey(),
) -> Forecast:
    """Load, forecast, replace the snapshot table and append to the run history."""
    run_at = run_at or datetime.now(timezone.utc).replace(tzinfo=None)
    history, sheet = load(spark, history_path, sheet_path, entities, first_day)
    result = forecast(history, sheet, as_of, rules, key)
    scored = stage(result.scored, "scored")
    write_snapshot(scored, snapshot_path, run_at)
    append_history(scored, runs_path, run_at)
    return result
