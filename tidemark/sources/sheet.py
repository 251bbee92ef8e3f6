"""Hand-kept wide sheets: one text column per entity, one row per day."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import clean_number, parse_us_date
from tidemark.operators.frames import complete_cases, rename_columns

DATE_COLUMN = "Date"


def resolve_header(header: Sequence[str], wanted: Collection[str]) -> dict[str, int]:
    """Position of the first column bearing each wanted name; other columns are ignored."""
    places: dict[str, int] = {}
    for place, name in enumerate(header):
        if name in wanted:
            places.setdefault(name, place)
    missing = [name for name in wanted if name not in places]
    if missing:
        raise ValueError(f"sheet has no column {missing}")
    return places


def pick_columns(grid: DataFrame, header: Sequence[str], entities: Collection[str]) -> DataFrame:
    """The date and entity columns of a grid with positional columns, under their names."""
    places = resolve_header(header, [DATE_COLUMN, *entities])
    return grid.select([F.col(f"`{grid.columns[place]}`").alias(name) for name, place in places.items()])


def melt_sheet(
    wide: DataFrame, entities: Collection[str], strict: bool = True
) -> DataFrame:
    """Long panel `date, entity, level` from a wide grid of text, without empty cells."""
    dated = rename_columns(wide.select(DATE_COLUMN, *[F.col(f"`{e}`") for e in entities]), {DATE_COLUMN: "date"})
    long = dated.unpivot(["date"], [F.col(f"`{e}`") for e in entities], "entity", "level")
    return complete_cases(
        long.select(
            parse_us_date(F.col("date"), strict).alias("date"),
            "entity",
            clean_number(F.col("level"), strict).alias("level"),
        )
    )


def read_sheet(
    spark: SparkSession, path: str, entities: Collection[str], strict: bool = True
) -> DataFrame:
    """Panel from a CSV sheet. Header names may repeat or be unknown; cells are text.

    A sheet may be a folder of files. Each has a header, in which a cell says DATE_COLUMN,
    and headers have to agree on where the date and the entities are, strict or not: a file
    without a header, or with another one, is an error. A row with more or fewer cells than
    the header is an error too, as its cells may stand in the wrong columns.
    """
    first = spark.read.option("header", False).csv(path).first()
    if first is None:
        raise ValueError(f"sheet is empty: {path}")
    positions = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(first))])
    # All cells are parsed, so that rows of another length are found.
    grid = spark.read.schema(positions).options(header=False, mode="FAILFAST", columnPruning=False).csv(path)
    # A header is known by its name for the date, wherever that stands.
    is_header = reduce(or_, [F.col(c).eqNullSafe(DATE_COLUMN) for c in grid.columns])
    headed = grid.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.max(is_header).alias("headed"))
    without = headed.where("NOT headed").first()
    if without is not None:
        raise ValueError(f"sheet file has no header: {without['file']}")
    places = resolve_header(list(first), [DATE_COLUMN, *entities])
    agrees = reduce(and_, [F.col(f"c{place}").eqNullSafe(name) for name, place in places.items()])
    differs = F.raise_error(F.lit("sheet files have different headers")).cast("boolean")
    is_row = F.when(is_header, F.when(agrees, False).otherwise(differs)).otherwise(True)
    return melt_sheet(pick_columns(grid.where(is_row), list(first), entities), entities, strict)
