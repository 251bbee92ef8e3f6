"""From the two sources to the merged daily panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tidemark.operators.frames import drop_all_null, mask_anomalies, numeric_columns, positive_rows, public_columns
from tidemark.operators.merge import merged_chunks
from tidemark.operators.series import SeriesKey
from tidemark.operators.windows import interpolated
from tidemark.settings import ANOMALY_RULES

Rules = DataFrame | Sequence[tuple[str, str, str]]


def _clean(history: DataFrame, rules: Rules, key: SeriesKey) -> DataFrame:
    masked = mask_anomalies(positive_rows(history), rules, ("playlists", "reach"), key.entity, key.order)
    return interpolated(masked, numeric_columns(masked), key, lead=["level"])


def clean_history(history: DataFrame, rules: Rules = ANOMALY_RULES, key: SeriesKey = SeriesKey()) -> DataFrame:
    """Positive days with anomalies repaired by interpolation, level moved up by one row.

    The order matters: rows dropped by the first filter shorten the distances
    that interpolation and the move count in.
    """
    return _clean(history, rules, key).select(history.columns)


def panel_chunks(
    history: DataFrame, sheet: DataFrame, rules: Rules = ANOMALY_RULES, key: SeriesKey = SeriesKey()
) -> DataFrame:
    """`build_panel`, left laid out for the operators that follow."""
    return merged_chunks(drop_all_null(_clean(history, rules, key)), sheet, key)


def build_panel(
    history: DataFrame, sheet: DataFrame, rules: Rules = ANOMALY_RULES, key: SeriesKey = SeriesKey()
) -> DataFrame:
    """Merged panel `date, entity, level, reach` of a cleaned history and a sheet."""
    return public_columns(panel_chunks(history, sheet, rules, key))
