"""The forecasting job: panel, features, one model per horizon, scored latest rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import horizon_days, local_today, month_end
from tidemark.operators.frames import complete_cases
from tidemark.operators.latest import coverage_summary, latest_rows
from tidemark.operators.regression import cross_products, predict, solve_models
from tidemark.operators.series import BLOCK, SeriesKey, number_rows, part_offsets
from tidemark.operators.windows import (
    TRAIN_RANK,
    feature_blocks,
    growth_of_numbered,
    rank_complete,
)
from tidemark.plans.panel import Rules, build_panel
from tidemark.plans.staging import stage
from tidemark.settings import ANOMALY_RULES, FEATURES


@dataclass(frozen=True)
class Forecast:
    """Result of a run. `scored` is the forecast, `rejected` the entities without one."""

    scored: DataFrame
    rejected: DataFrame
    sums: DataFrame
    models: DataFrame
    train: DataFrame
    latest: DataFrame

    def coverage(self) -> DataFrame:
        return coverage_summary(self.train, self.latest)


def as_of_day(as_of: date | str | None) -> Column:
    return local_today() if as_of is None else F.lit(str(as_of)).cast("date")


def ranked_features(panel: DataFrame, key: SeriesKey = SeriesKey()) -> DataFrame:
    """Panel with features, and the rank of its complete rows within their block."""
    return rank_complete(feature_blocks(panel, key), [key.order, key.entity, "level", "reach", *FEATURES], key)


def numbered_training(ranked: DataFrame, key: SeriesKey) -> DataFrame:
    """The complete rows of a staged feature table with their positions among themselves.

    Ranks within a block are offset by the rows of earlier blocks. The offsets
    are staged: only long series have any, so they are mostly small enough to be
    broadcast, and as a table they have a size by which the planner can tell.
    """
    rows = ranked.where(f"{TRAIN_RANK} IS NOT NULL").select(key.entity, BLOCK, TRAIN_RANK, "level", *FEATURES)
    offsets = stage(part_offsets(rows, key, BLOCK, TRAIN_RANK), "offsets")
    return number_rows(rows, offsets, key, BLOCK, TRAIN_RANK).drop(BLOCK, TRAIN_RANK)


def features_and_sums(
    panel: DataFrame, horizons: Sequence[int], key: SeriesKey = SeriesKey()
) -> tuple[DataFrame, DataFrame]:
    """The staged feature table, and per horizon the cross-products of its complete rows.

    Features are made once, and so are the growth targets of the numbered complete rows,
    for all horizons together.
    """
    table = stage(ranked_features(panel, key), "features")
    grown = growth_of_numbered(numbered_training(table, key), horizons, key)
    return table, cross_products(grown, horizons, FEATURES)


def forecast_panel(
    panel: DataFrame, as_of: date | str | None = None, key: SeriesKey = SeriesKey()
) -> Forecast:
    """Forecast the level of each entity at the end of the month that holds `as_of`.

    Rows without an entity or a day are in no series and left out. `panel` should be
    a table or cheap to compute: it is read twice. The feature table, the training sums
    and the latest rows are staged, because several jobs read them. Only the distinct
    horizons and a model for each come to the driver, at most one per day of the
    calendar range.
    """
    panel = complete_cases(panel, [key.entity, key.order])
    day = as_of_day(as_of)
    horizon = horizon_days(F.col(key.order), day)
    ends = panel.groupBy(key.entity).agg(F.max(key.order).alias(key.order))
    horizons = [row.horizon for row in ends.select(horizon.alias("horizon")).distinct().collect()]
    if not horizons:
        raise ValueError("the panel has no rows")
    table, sums = features_and_sums(panel, horizons, key)
    sums = stage(sums, "sums")
    models = solve_models(sums, FEATURES)
    latest = latest_rows(table, ["level", "reach", *FEATURES], key.entity, key.order)
    latest = stage(latest.withColumns({"forecast_date": month_end(day), "horizon": horizon}), "latest")
    scores = predict(latest, models, FEATURES, key.entity, key.order)
    scored = complete_cases(scores, ["forecast"]).drop("horizon", "has_model")
    reason = F.when(~F.col("has_model"), "no training rows for the horizon").otherwise("null feature or level")
    rejected = scores.where(F.col("forecast").isNull()).select(
        key.entity, "latest_date", "horizon", reason.alias("reason")
    )
    train = table.where(f"{TRAIN_RANK} IS NOT NULL").select(key.order, key.entity, "level", "reach", *FEATURES)
    return Forecast(scored, rejected, sums, models, train, latest)


def forecast(
    history: DataFrame,
    sheet: DataFrame,
    as_of: date | str | None = None,
    rules: Rules = ANOMALY_RULES,
    key: SeriesKey = SeriesKey(),
) -> Forecast:
    """Forecast from a history panel and a sheet panel.

    The merged panel is staged, as it is read more than once.
    """
    return forecast_panel(stage(build_panel(history, sheet, rules, key), "panel"), as_of, key)


