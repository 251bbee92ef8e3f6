"""Latest row per entity and summaries of a panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import horizon_days


def latest_rows(
    panel: DataFrame, columns: Sequence[str] | None = None, entity: str = "entity", order: str = "date"
) -> DataFrame:
    """Last day per entity with the last known value of every column.

    This is forward fill followed by the last row, and like that it may put
    values of different days into one row. Written as an aggregate it needs
    neither a window nor a sort, and a long series is reduced before the shuffle.
    """
    columns = columns or [c for c in panel.columns if c not in (entity, order)]
    known = [F.expr(f"max_by(`{c}`, `{order}`) FILTER (WHERE `{c}` IS NOT NULL) AS `{c}`") for c in columns]
    return panel.groupBy(entity).agg(F.max(order).alias(order), *known)


def coverage_summary(
    train: DataFrame, latest: DataFrame, entity: str = "entity", order: str = "date"
) -> DataFrame:
    """First day, last day and number of entities of the training and the latest rows."""

    def one_row(df: DataFrame, name: str, entities: Column) -> DataFrame:
        days = (F.min(order).alias("first_day"), F.max(order).alias("last_day"))
        return df.agg(*days, entities.alias("entities")).select(F.lit(name).alias("rows"), "*")

    return one_row(train, "training", F.count_distinct(entity)).unionByName(
        one_row(latest, "latest", F.count(F.lit(1)))
    )


def distinct_horizons(latest: DataFrame, as_of: Column, order: str = "date") -> DataFrame:
    return latest.select(horizon_days(F.col(order), as_of).alias("horizon")).distinct()
