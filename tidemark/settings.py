"""Defaults of the forecasting job. Every one of them is also an argument."""

from __future__ import annotations

# These must be equal to the published job's for equal results.
LAGS = (7, 14, 21, 28, 56, 168)
MEAN_PAIRS = ((1, 7), (7, 28), (28, 84), (28, 168))
START_DATE = "2020-06-01"
ZONE = "America/Chicago"
ENTITIES = ("Bad Bunny", "Bruno Mars", "The Weeknd")
ANOMALY_RULES = (
    ("Bruno Mars", "2026-02-15", "2026-02-16"),
    ("Bad Bunny", "2021-02-16", "2021-02-16"),
)
HISTORY_FIELDS = {
    "monthly_listeners_current": "level",
    "playlists_current": "playlists",
    "playlist_reach_current": "reach",
}
# UTC offset in minutes -> abbreviation printed behind run timestamps in ZONE.
ZONE_LABELS = {-360: "CST", -300: "CDT"}
# End of fixed values.


def lag_feature(rows: int, column: str = "reach") -> str:
    return f"{column}_pct_change_{rows}"


def ratio_feature(short: int, long: int, column: str = "level") -> str:
    return f"{column}_ma_{short}_over_{long}"


FEATURES = tuple(ratio_feature(s, l) for s, l in MEAN_PAIRS) + tuple(lag_feature(n) for n in LAGS)
# Where features lie: ratios around one, changes around zero.
CENTRES = {ratio_feature(s, l): 1.0 for s, l in MEAN_PAIRS}
