"""Column selection, row filters and set operations on panels."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import null_out

def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename columns; a name that is not there is an error."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"no such columns to rename: {missing}")
    return df.select([F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def start_from(df: DataFrame, first_day: str, order: str = "date") -> DataFrame:
    return df.where(F.col(order) >= F.lit(first_day).cast("date"))


def positive_rows(df: DataFrame, column: str = "level") -> DataFrame:
    return df.where(F.col(column) > 0)


def all_present(columns: Iterable[str]) -> Column:
    return reduce(and_, [F.col(c).isNotNull() for c in columns])


def drop_all_null(df: DataFrame, columns: Sequence[str] = ("level", "reach")) -> DataFrame:
    """Drop rows where every one of `columns` is null. NaN counts as a value."""
    return df.where(reduce(or_, [F.col(c).isNotNull() for c in columns]))


def complete_cases(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Keep rows without a null in `columns` (default: in any). NaN counts as a value."""
    return df.where(all_present(columns or df.columns))


def tracked_entities(df: DataFrame, entities: DataFrame, entity: str = "entity") -> DataFrame:
    """Rows of the entities listed in `entities`. Spark broadcasts the list if it is small."""
    return df.join(entities.select(entity), entity, "left_semi")


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(entity, first day, last day) rules as a table `entity, date_from, date_to`."""
    texts = spark.createDataFrame(list(rules), "entity string, a string, b string")
    return texts.select("entity", F.col("a").cast("date").alias("date_from"), F.col("b").cast("date").alias("date_to"))


def mask_anomalies(
    df: DataFrame,
    rules: DataFrame | Sequence[tuple[str, str, str]],
    columns: Sequence[str] = ("playlists", "reach"),
    entity: str = "entity",
    order: str = "date",
) -> DataFrame:
    """Null out `columns` on the days named by `rules`, ends included.

    Rules are a table `entity, date_from, date_to` or a list of such rows. They become the
    distinct (entity, day) pairs that they name, so rules that overlap cannot multiply
    rows, and rows find their pair by an equality: no entity's days meet all of its rules.
    """
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns to mask: {missing}")
    if not isinstance(rules, DataFrame):
        if not rules:
            return df
        rules = rule_table(df.sparkSession, rules)
    days = F.explode(F.sequence("date_from", "date_to")).alias(order)
    hits = rules.where("date_from <= date_to").select(F.col("entity").alias(entity), days).distinct()
    marked = df.join(hits.withColumn("__hit", F.lit(True)), [entity, order], "left")
    return marked.select(
        [null_out(F.col("__hit"), F.col(f"`{c}`")).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns]
    )


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames with the same columns."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def union_relaxed(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames by column name: absent columns are null, types widen."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def panel_sort(df: DataFrame, order: str = "date", entity: str = "entity") -> DataFrame:
    return df.orderBy(order, entity)


def public_columns(df: DataFrame) -> DataFrame:
    """Drop the working columns (`__…`) that operators hand to one another."""
    return df.drop(*[c for c in df.columns if c.startswith("__")])
