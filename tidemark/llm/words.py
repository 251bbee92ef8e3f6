"""What several corpus operators share: words between ASCII white space, whole rows, let."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def whole_row(df: DataFrame) -> Column:
    """All columns of a row as one, `row`, out of the way of an operator's own names."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
