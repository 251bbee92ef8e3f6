"""The star-schema tables cast into the two source panels.

Money is summed in whole cents, so that sums do not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import thousands

AS_OF = "2001-11-05"
SHEET_END = "2001-11-04"
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
# Days on which reach is taken to be wrong: leading, interior, overlapping, trailing.
RULES = (
    ("4-NOT SPECIFIED", "1995-01-01", "1995-01-05"),
    ("5-LOW", "1998-02-16", "1998-02-16"),
    ("1-URGENT", "1999-02-15", "1999-03-16"),
    ("2-HIGH", "2000-03-01", "2000-03-20"),
    ("2-HIGH", "2000-03-10", "2000-03-25"),
    ("3-MEDIUM", "2001-07-28", "2001-08-01"),
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("bigint")


def orders_history(spark: SparkSession, folder: str) -> DataFrame:
    """Daily history per order priority: turnover, number of orders, distinct customers."""
    return (
        table(spark, folder, "orders")
        .groupBy(F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderpriority").alias("entity"))
        .agg(
            (F.sum(cents("o_totalprice")) / F.lit(100.0)).alias("level"),
            F.count(F.lit(1)).cast("double").alias("playlists"),
            F.count_distinct("o_custkey").cast("double").alias("reach"),
        )
    )


def lineitem_sheet(spark: SparkSession, folder: str, staggered: bool = False) -> DataFrame:
    """Daily shipped value per order priority.

    With `staggered` the series end on different days (three days apart), so that
    there are several horizons.
    """
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderpriority").alias("entity"))
    shipped = table(spark, folder, "lineitem").select(
        "l_orderkey", F.col("l_shipdate").cast("date").alias("date"), cents("l_extendedprice").alias("cents")
    )
    rows = shipped.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if staggered:
        early = (F.substring("entity", 1, 1).cast("int") - 1) * 3
        rows = rows.where(F.col("date") <= F.date_sub(F.lit(SHEET_END).cast("date"), early))
    daily = rows.groupBy("date", "entity").agg(F.sum("cents").alias("cents"))
    return daily.select("date", "entity", F.floor(F.col("cents") / 100).alias("level"))


def wide_sheet(spark: SparkSession, folder: str, staggered: bool = False) -> DataFrame:
    """The sheet as people keep it: US dates, one text column per priority, grouped digits.

    A priority that PRIORITIES does not name is an error, as it would have no column.
    """
    known = F.when(F.col("entity").isin(list(PRIORITIES)), F.col("entity"))
    unknown = F.raise_error(F.concat_ws(" ", F.lit("no column for"), F.col("entity")))
    long = lineitem_sheet(spark, folder, staggered).withColumn("entity", F.coalesce(known, unknown))
    wide = long.groupBy("date").pivot("entity", list(PRIORITIES)).agg(F.max("level"))
    cells = [F.coalesce(thousands(F.col(f"`{p}`"), whole=True), F.lit("")).alias(p) for p in PRIORITIES]
    return wide.select(F.date_format("date", "M/d/yyyy").alias("Date"), *cells)


def supplier_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Daily panel per supplier: many series, their number growing with the tables."""
    return (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_shipdate").cast("date").alias("date"), F.col("l_suppkey").alias("entity"))
        .agg(
            (F.sum(cents("l_extendedprice")) / F.lit(100.0)).alias("level"),
            F.sum("l_quantity").alias("reach"),
        )
    )
