"""Merging two sources of one panel by precedence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.frames import union_relaxed
from tidemark.operators.series import CHUNK, SeriesKey, chunked

_SOURCE, _FIRST, _SECOND = "__source", "__first", "__second"


def _unique(count: str, key: SeriesKey):
    message = F.concat_ws(
        " ", F.lit("duplicate row in one source for"), F.col(key.entity), F.col(key.order).cast("string")
    )
    return F.when(F.col(count) > 1, F.raise_error(message).cast("boolean")).otherwise(True)


def merged_chunks(history: DataFrame, sheet: DataFrame, key: SeriesKey = SeriesKey()) -> DataFrame:
    """`precedence_merge`, left shuffled by (entity, chunk) for the operators that follow.

    Both sources are laid out by (entity, chunk) before they are stacked. The
    stack keeps that layout, so neither the grouping here nor `scan` afterwards
    shuffles again; history that comes from `interpolated` is already laid out.
    """
    columns = [key.entity, key.order, CHUNK]
    stacked = union_relaxed(
        [
            chunked(history, key).select(*columns, "level", "reach", F.lit(0).alias(_SOURCE)),
            chunked(sheet, key).select(*columns, "level", F.lit(1).alias(_SOURCE)),
        ]
    )
    merged = stacked.groupBy(key.entity, CHUNK, key.order).agg(
        F.max_by("level", _SOURCE).cast("double").alias("level"),
        F.min_by("reach", _SOURCE).cast("double").alias("reach"),
        F.count_if(F.col(_SOURCE) == 0).alias(_FIRST),
        F.count_if(F.col(_SOURCE) == 1).alias(_SECOND),
    )
    checked = merged.where(_unique(_FIRST, key) & _unique(_SECOND, key))
    return checked.select(key.order, key.entity, "level", "reach", CHUNK)


def precedence_merge(history: DataFrame, sheet: DataFrame, key: SeriesKey = SeriesKey()) -> DataFrame:
    """One row per (day, entity): level from the sheet where it has the row, else from history.

    Reach always comes from history. A null counts as the source's value. A day
    that occurs twice for an entity in one source is an error.
    """
    return merged_chunks(history, sheet, key).drop(CHUNK)


def precedence_merge_join(history: DataFrame, sheet: DataFrame, key: SeriesKey = SeriesKey()) -> DataFrame:
    """The same rows by full outer join, as a cross-check."""
    days = [key.order, key.entity]
    old = history.select(*days, F.col("level").alias("__old"), F.col("reach"))
    new = sheet.select(*days, F.col("level").alias("__new"), F.lit(True).alias("__in_sheet"))
    level = F.when(F.col("__in_sheet"), F.col("__new")).otherwise(F.col("__old"))
    joined = old.join(new, days, "full")
    return joined.select(*days, level.cast("double").alias("level"), F.col("reach").cast("double"))
