"""Every operator bound to the test tables, one query each."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import (
    clean_number,
    format_day,
    format_local,
    horizon_days,
    month_end,
    month_length,
    parse_us_date,
    thousands,
)
from tidemark.operators.frames import (
    complete_cases,
    drop_all_null,
    mask_anomalies,
    panel_sort,
    positive_rows,
    rename_columns,
    rule_table,
    start_from,
    tracked_entities,
    union_all,
    union_relaxed,
)
from tidemark.operators.latest import coverage_summary, distinct_horizons, latest_rows
from tidemark.operators.merge import precedence_merge, precedence_merge_join
from tidemark.operators.regression import cross_product_cells
from tidemark.operators.windows import (
    add_features,
    forward_fill,
    growth_targets,
    interpolate,
    lead_rows,
    rolling_mean,
    target_of,
)
from tidemark.plans.forecast import Forecast, as_of_day, forecast
from tidemark.plans.panel import build_panel, clean_history
from tidemark.plans.run import run
from tidemark.plans.staging import new_table_path, stage
from tidemark.settings import FEATURES, LAGS, MEAN_PAIRS, lag_feature, ratio_feature
from tidemark.sinks.tables import (
    append_history,
    presented,
    read_run_history,
    read_snapshot,
    write_snapshot,
)
from tidemark.sources.history import parse_history, read_history
from tidemark.sources.sheet import melt_sheet, pick_columns, read_sheet
from tidemark.sources.tables import (
    AS_OF,
    PRIORITIES,
    RULES,
    lineitem_sheet,
    orders_history,
    supplier_panel,
    table,
    wide_sheet,
)

Query = Callable[[SparkSession, str], DataFrame]

FIRST_DAY = "2000-06-01"
NO_BOUND = "0001-01-01"
RUN_AT = "2001-11-05 14:30:00"
SECOND_RUN_AT = "2001-11-06 05:45:10"
SECOND_AS_OF = "2001-12-06"
TRACKED = ("1-URGENT", "3-MEDIUM", "not an order priority")
TARGETS = (0, 7, 26)


def rounded(df: DataFrame, columns: Sequence[str], digits: int = 8) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def masked_history(spark: SparkSession, sf: str) -> DataFrame:
    return mask_anomalies(orders_history(spark, sf), RULES)


def merged_panel(spark: SparkSession, sf: str, staggered: bool = False) -> DataFrame:
    return build_panel(orders_history(spark, sf), lineitem_sheet(spark, sf, staggered), RULES)


def features_of(spark: SparkSession, sf: str, staggered: bool = False) -> DataFrame:
    return add_features(stage(merged_panel(spark, sf, staggered), "panel"))


def run_forecast(spark: SparkSession, sf: str, as_of: str = AS_OF) -> Forecast:
    return forecast(orders_history(spark, sf), lineitem_sheet(spark, sf, staggered=True), as_of, RULES)


def rounded_forecast(scored: DataFrame) -> DataFrame:
    return rounded(scored, ["forecast"], 2)


# Sources and sinks


def json_field_extract(spark: SparkSession, sf: str) -> DataFrame:
    fields = F.from_json("props", "k bigint")
    return table(spark, sf, "events").select("event_id", fields["k"].alias("k"))


def history_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Histories packed into one JSON document per entity and year."""
    day = F.struct(
        format_day(F.col("date")).alias("date"),
        F.col("level").alias("monthly_listeners_current"),
        F.col("playlists").alias("playlists_current"),
        F.col("reach").alias("playlist_reach_current"),
        F.lit(1).alias("unnamed_aggregate"),
    )
    packed = orders_history(spark, sf).groupBy("entity", F.year("date").alias("year")).agg(
        F.collect_list(day).alias("history")
    )
    data = F.struct(F.col("history")).alias("data")
    document = F.to_json(F.struct(F.array(F.struct(data)).alias("stats")))
    return packed.select("entity", "year", document.alias("document"))


def json_history_explode(spark: SparkSession, sf: str) -> DataFrame:
    """Histories from documents held as text."""
    return parse_history(history_documents(spark, sf), "document")


def land_history(spark: SparkSession, sf: str) -> str:
    """Write the documents as files, one each, under a folder per entity."""
    path = new_table_path(spark, "landed-history")
    files = history_documents(spark, sf).repartition("entity", "year")
    files.write.partitionBy("entity", "year").text(path)
    return path


def land_sheet(spark: SparkSession, sf: str, staggered: bool = False) -> str:
    """Write the wide sheet as CSV files, each with a header."""
    path = new_table_path(spark, "landed-sheet")
    wide_sheet(spark, sf, staggered).write.option("header", True).csv(path)
    return path


def json_history_files(spark: SparkSession, sf: str) -> DataFrame:
    """Histories from landed JSON files."""
    return read_history(spark, land_history(spark, sf), NO_BOUND)


def sheet_csv_files(spark: SparkSession, sf: str) -> DataFrame:
    """The panel from landed CSV files."""
    return read_sheet(spark, land_sheet(spark, sf), PRIORITIES)


def run_month_end(spark: SparkSession, sf: str) -> DataFrame:
    """The whole job, from landed files to the snapshot table."""
    snapshot = new_table_path(spark, "snapshot")
    run(
        spark,
        history_path=land_history(spark, sf),
        sheet_path=land_sheet(spark, sf, staggered=True),
        snapshot_path=snapshot,
        runs_path=new_table_path(spark, "runs"),
        as_of=AS_OF,
        entities=PRIORITIES,
        rules=RULES,
        first_day=NO_BOUND,
        run_at=RUN_AT,
    )
    return rounded_forecast(read_snapshot(spark, snapshot))


def sheet_melt(spark: SparkSession, sf: str) -> DataFrame:
    return melt_sheet(wide_sheet(spark, sf), PRIORITIES)


def sheet_header_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """A grid with an unknown and a repeated column; the first of each wanted name is kept."""
    wide = wide_sheet(spark, sf)
    header = ["Date", "unknown", *PRIORITIES, PRIORITIES[0]]
    cells = [F.col("Date"), F.lit("x"), *(F.col(f"`{p}`") for p in PRIORITIES), F.lit("0")]
    grid = wide.select([cell.alias(f"_c{i}") for i, cell in enumerate(cells)])
    picked = pick_columns(grid, header, PRIORITIES)
    named = [F.col(f"`{p}`").alias(f"sheet_{i}") for i, p in enumerate(PRIORITIES, 1)]
    return picked.select(F.col("Date").alias("day"), *named)


def entity_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    wanted = spark.createDataFrame([(name,) for name in TRACKED], "entity string")
    return tracked_entities(orders_history(spark, sf), wanted)


def start_date_filter(spark: SparkSession, sf: str) -> DataFrame:
    return start_from(orders_history(spark, sf), FIRST_DAY)


def forecast_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    path = new_table_path(spark, "snapshot")
    write_snapshot(rounded_forecast(run_forecast(spark, sf).scored), path, RUN_AT)
    return presented(read_snapshot(spark, path))


def forecast_history(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs appended, the second with the next month as target."""
    path = new_table_path(spark, "runs")
    for as_of, run_at in ((AS_OF, RUN_AT), (SECOND_AS_OF, SECOND_RUN_AT)):
        append_history(rounded_forecast(run_forecast(spark, sf, as_of).scored), path, run_at)
    return read_run_history(spark, path)


# Projections and scalar functions


def panel_select(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = clean_history(orders_history(spark, sf), RULES)
    return rounded(cleaned.select("date", "entity", "level", "reach"), ["level", "reach"], 6)


def rename(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return rename_columns(orders, {"o_orderpriority": "entity", "o_totalprice": "level"})


def parse_us(spark: SparkSession, sf: str) -> DataFrame:
    """Days written with and without leading zeros."""
    day = F.col("l_shipdate")
    texts = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.date_format(day, "M/d/yyyy").alias("short"),
        F.date_format(day, "MM/dd/yyyy").alias("long"),
    )
    return texts.select(
        "l_orderkey",
        "l_linenumber",
        parse_us_date(F.col("short")).alias("short"),
        parse_us_date(F.col("long")).alias("long"),
    )


def clean_thousands(spark: SparkSession, sf: str) -> DataFrame:
    """Whole amounts with thousands commas; every returned item has an empty cell."""
    amount = thousands(F.floor("l_extendedprice"), whole=True)
    text = F.when(F.col("l_returnflag") == "R", "").otherwise(amount)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", clean_number(text).alias("amount")
    )


def anomaly_mask(spark: SparkSession, sf: str) -> DataFrame:
    return masked_history(spark, sf)


def anomaly_mask_table(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the rules as a table."""
    return mask_anomalies(orders_history(spark, sf), rule_table(spark, RULES))


def month_ends(spark: SparkSession, sf: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").select(
        "o_orderkey", month_end(day).alias("month_end"), month_length(day).alias("month_length")
    )


def horizons(spark: SparkSession, sf: str) -> DataFrame:
    day = F.col("l_shipdate").cast("date")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", horizon_days(day, as_of_day(AS_OF)).alias("horizon")
    )


def format_date(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        "o_orderkey",
        format_day(F.col("o_orderdate")).alias("day"),
        format_local(F.col("o_orderdate")).alias("local_time"),
    )


def format_thousands(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        thousands(price).alias("price"),
        thousands(F.floor(price), whole=True).alias("whole_price"),
    )


# Filters and set operations


def positive_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' balances may be negative or zero."""
    return positive_rows(table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("level")))


def sparse_history(spark: SparkSession, sf: str) -> DataFrame:
    """History with nulls in level (days of 1996) and in reach (second half of every year).

    Levels are whole numbers, so that their means do not depend on the order of addition.
    """
    days = orders_history(spark, sf)
    return days.select(
        "date",
        "entity",
        F.when(F.year("date") != 1996, F.floor("level").cast("double")).alias("level"),
        F.when(F.month("date") <= 6, F.col("reach")).alias("reach"),
    )


def drop_null_rows(spark: SparkSession, sf: str) -> DataFrame:
    return drop_all_null(sparse_history(spark, sf))


def complete_rows(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(complete_cases(features_of(spark, sf)), [*FEATURES, "reach"])


def union_same(spark: SparkSession, sf: str) -> DataFrame:
    days = orders_history(spark, sf)
    return union_all([days.where(F.col("entity") == name) for name in PRIORITIES])


def union_by_name(spark: SparkSession, sf: str) -> DataFrame:
    days = orders_history(spark, sf).select("date", "entity", "level", "reach")
    return union_relaxed([days, lineitem_sheet(spark, sf)])


# Merge and aggregates


def merge(spark: SparkSession, sf: str) -> DataFrame:
    return precedence_merge(orders_history(spark, sf), lineitem_sheet(spark, sf))


def merge_join(spark: SparkSession, sf: str) -> DataFrame:
    return precedence_merge_join(orders_history(spark, sf), lineitem_sheet(spark, sf))


def latest_row(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(latest_rows(features_of(spark, sf, staggered=True)), [*FEATURES, "reach"])


def coverage(spark: SparkSession, sf: str) -> DataFrame:
    return run_forecast(spark, sf).coverage()


def horizon_set(spark: SparkSession, sf: str) -> DataFrame:
    panel = merged_panel(spark, sf, staggered=True)
    return distinct_horizons(latest_rows(panel, ["level"]), as_of_day(AS_OF))


# Windows


def lead_level(spark: SparkSession, sf: str) -> DataFrame:
    return lead_rows(orders_history(spark, sf), "level")


def interpolate_linear(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(interpolate(masked_history(spark, sf), ["playlists", "reach"]), ["playlists", "reach"])


def pct_change_lags(spark: SparkSession, sf: str) -> DataFrame:
    names = [lag_feature(n) for n in LAGS]
    return rounded(features_of(spark, sf).select("date", "entity", *names), names)


def rolling_means(spark: SparkSession, sf: str) -> DataFrame:
    lengths = (7, 28, 84, 168)
    means = rolling_mean(sparse_history(spark, sf).drop("reach"), "level", lengths)
    return rounded(means, [f"level_mean_{n}" for n in lengths], 4)


def ma_ratio(spark: SparkSession, sf: str) -> DataFrame:
    names = [ratio_feature(s, l) for s, l in MEAN_PAIRS]
    return rounded(features_of(spark, sf).select("date", "entity", *names), names)


def fill_forward(spark: SparkSession, sf: str) -> DataFrame:
    return forward_fill(sparse_history(spark, sf), ["level", "reach"])


def growth_target(spark: SparkSession, sf: str) -> DataFrame:
    train = complete_cases(features_of(spark, sf)).select("date", "entity", "level")
    return rounded(growth_targets(train, TARGETS), [target_of(h) for h in TARGETS])


def supplier_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(add_features(supplier_panel(spark, sf)), FEATURES)


def sorted_panel(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(panel_sort(merged_panel(spark, sf)), ["level", "reach"], 6)


# Regression


def ols_gram(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cross_product_cells(run_forecast(spark, sf).sums, FEATURES), ["value"], 5)


def ols_coefficients(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(run_forecast(spark, sf).models, ["intercept", *FEATURES], 6)


def forecast_month_end(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_forecast(run_forecast(spark, sf).scored)


QUERIES: dict[str, Query] = {
    "json_field_extract": json_field_extract,
    "json_history_explode": json_history_explode,
    "json_history_files": json_history_files,
    "sheet_melt": sheet_melt,
    "sheet_csv_files": sheet_csv_files,
    "sheet_header_dedup": sheet_header_dedup,
    "entity_semi_join": entity_semi_join,
    "start_date_filter": start_date_filter,
    "forecast_snapshot": forecast_snapshot,
    "forecast_history": forecast_history,
    "panel_select": panel_select,
    "rename_columns": rename,
    "parse_us_date": parse_us,
    "clean_thousands": clean_thousands,
    "anomaly_mask": anomaly_mask,
    "anomaly_mask_table": anomaly_mask_table,
    "month_end": month_ends,
    "horizon_days": horizons,
    "format_date": format_date,
    "format_thousands": format_thousands,
    "positive_filter": positive_filter,
    "drop_all_null": drop_null_rows,
    "complete_cases": complete_rows,
    "union_all": union_same,
    "union_relaxed": union_by_name,
    "precedence_merge": merge,
    "precedence_merge_join": merge_join,
    "latest_row": latest_row,
    "coverage_summary": coverage,
    "distinct_horizons": horizon_set,
    "lead_level": lead_level,
    "interpolate_linear": interpolate_linear,
    "pct_change_lags": pct_change_lags,
    "rolling_mean": rolling_means,
    "ma_ratio": ma_ratio,
    "forward_fill": fill_forward,
    "growth_target": growth_target,
    "supplier_features": supplier_features,
    "panel_sort": sorted_panel,
    "ols_gram": ols_gram,
    "ols_coefficients": ols_coefficients,
    "forecast_month_end": forecast_month_end,
    "run_month_end": run_month_end,
}
