"""Small frames and brute-force versions of the operators for one series."""

from __future__ import annotations

import math
from datetime import date, timedelta

PANEL = "date date, entity string, level double, reach double"
DAY0 = date(2020, 1, 1)


def day(n: int) -> date:
    return DAY0 + timedelta(days=n)


def series(spark, values, column="level", entity="A", days=None):
    """One entity's values on consecutive (or the given) days, the other column null."""
    days = days if days is not None else range(len(values))
    rows = []
    for n, value in zip(days, values, strict=True):
        level, reach = (value, None) if column == "level" else (None, value)
        rows.append((day(n), entity, _number(level), _number(reach)))
    return spark.createDataFrame(rows, PANEL)


def _number(value):
    return None if value is None else float(value)


def column_of(df, column):
    """Values in order of date."""
    return [row[column] for row in df.orderBy("entity", "date").collect()]


def same(got, expected, tolerance=1e-9):
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        if a is None or b is None:
            assert a is None and b is None, (got, expected)
        else:
            assert math.isclose(a, b, rel_tol=tolerance, abs_tol=tolerance), (got, expected)


# Brute force, one list of values in order of date at a time.


def filled(values):
    out, last = [], None
    for v in values:
        last = v if v is not None else last
        out.append(last)
    return out


def between(values):
    known = [i for i, v in enumerate(values) if v is not None]
    out = []
    for i, v in enumerate(values):
        before, after = [k for k in known if k <= i], [k for k in known if k >= i]
        if v is None and before and after:
            a, b = before[-1], after[0]
            v = values[a] + (values[b] - values[a]) * (i - a) / (b - a)
        out.append(v)
    return out


def lead(values, n):
    return [values[i + n] if 0 <= i + n < len(values) else None for i in range(len(values))]


def mean(values, n):
    out = []
    for i in range(len(values)):
        window = values[i - n + 1 : i + 1] if i >= n - 1 else [None]
        out.append(None if None in window else sum(window) / n)
    return out


def change(values, n):
    ff = filled(values)
    return [ratio(b, a, -1.0) for a, b in zip(lead(ff, -n), ff, strict=True)]


def ratio(a, b, plus=0.0):
    return None if a is None or not b else a / b + plus


def growth(values, h):
    return [ratio(b, a, -1.0) for a, b in zip(values, lead(values, h), strict=True)]
