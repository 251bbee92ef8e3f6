"""Shapes of physical plans: what is shuffled, by which keys, and how often."""

import re

import pytest

from helpers import PANEL
from tidemark.operators.latest import latest_rows
from tidemark.operators.series import BLOCK, CHUNK, SeriesKey
from tidemark.operators.windows import add_features
from tidemark.plans.panel import build_panel

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def panel(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("panel"))
    rows = [("2020-01-01", "A", 1.0, 2.0)]
    spark.createDataFrame(rows, "d string, entity string, level double, reach double").selectExpr(
        "date(d) AS date", "entity", "level", "reach"
    ).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def nodes(plan, name):
    return [line for line in plan.splitlines() if re.match(rf"[\s:|+-]*(\*\(\d+\) )?{name}\b", line)]


def shuffles(plan):
    keys = [re.search(r"hashpartitioning\((.*?), \d+\)", line) for line in nodes(plan, "Exchange")]
    return [tuple(re.sub(r"#\d+L?", "", k) for k in m.group(1).split(", ")) for m in keys if m]


def window_partitions(plan):
    out = []
    for line in nodes(plan, "Window"):
        spec = re.search(r"\], \[([^\[\]]*)\], \[[^\[\]]*\]$", line)
        out.append(tuple(re.sub(r"#\d+L?", "", k) for k in spec.group(1).split(", ") if k))
    return out


def test_features_shuffle_rows_twice(spark, panel):
    plan = plan_of(add_features(panel))
    rows = [s for s in shuffles(plan) if s != ("entity",)]
    # By block, and by chunk: once each, as the two uses of the latter are the same.
    assert sorted(rows) == [("entity", BLOCK), ("entity", CHUNK), ("entity", CHUNK)]
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "Python" not in plan


def executed(df):
    """The plan as it was run, with what was found again."""
    df.collect()
    plan = plan_of(df)
    return plan[plan.index("== Final Plan ==") : plan.index("== Initial Plan ==")]


def scans_of(plan):
    """Files that are scanned, leaving out what a shuffle that is used again was made from."""
    return sorted(re.findall(r"/(\w+)\.parquet", " ".join(line for line in nodes(plan, "FileScan"))))


@pytest.mark.parametrize(
    "name, tables",
    [
        ("supplier_features", ["lineitem"]),
        ("rolling_mean", ["orders"]),
        ("lead_level", ["orders"]),
        ("interpolate_linear", ["orders"]),
        ("forward_fill", ["orders"]),
        ("anomaly_mask_table", ["orders"]),
    ],
)
def test_tables_are_read_once(spark, name, tables):
    from tidemark.queries import QUERIES

    plan = executed(QUERIES[name](spark, SF))
    assert scans_of(plan) == tables
    assert name == "anomaly_mask_table" or nodes(plan, "ReusedExchange")


def test_no_window_over_a_whole_series_of_rows(spark, panel):
    """Windows over an entity alone see one row per chunk, behind an aggregation."""
    plan = plan_of(add_features(panel))
    parts = window_partitions(plan)
    assert parts and all(p for p in parts)
    for line, part in zip(nodes(plan, "Window"), parts, strict=True):
        if part == ("entity",):
            assert "__rows" in line or "__prev" in line or "_prev" in line
        else:
            assert part in {("entity", CHUNK), ("entity", BLOCK)}


def test_merged_panel_keeps_the_layout_of_its_sources(spark, panel):
    """Neither the union nor the grouping of the two sources adds a shuffle by day."""
    history = panel.selectExpr("date", "entity", "level", "reach AS playlists", "reach")
    plan = plan_of(build_panel(history, panel.selectExpr("date", "entity", "bigint(level) AS level"), []))
    assert {s for s in shuffles(plan)} == {("entity",), ("entity", CHUNK)}
    assert len(nodes(plan, "Union")) == 1


def test_latest_rows_need_no_window_and_no_sort(spark, panel):
    plan = plan_of(latest_rows(panel))
    assert shuffles(plan) == [("entity",)]
    assert not nodes(plan, "Window") and not nodes(plan, "Sort")
    assert "partial_max_by" in plan


def test_scans_read_only_the_columns_and_rows_they_need(spark):
    from tidemark.sources.tables import lineitem_sheet, orders_history

    plan = plan_of(lineitem_sheet(spark, SF))
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_shipdate:timestamp_ntz>" in plan
    assert "struct<o_custkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz,o_orderpriority:string>" in plan_of(
        orders_history(spark, SF)
    )


def test_block_and_halo_fit_the_window_buffer(spark):
    limit = int(spark.conf.get("spark.sql.windowExec.buffer.in.memory.threshold"))
    assert SeriesKey().block_rows + 168 <= limit


def test_panel_schema_is_fixed(spark, panel):
    sheet = panel.selectExpr("date", "entity", "bigint(level) AS level")
    history = panel.selectExpr("date", "entity", "level", "reach AS playlists", "reach")
    merged = build_panel(history, sheet, [])
    assert ", ".join(f"{n} {t}" for n, t in merged.dtypes) == PANEL


SETTINGS = [
    {"spark.sql.shuffle.partitions": "1"},
    {"spark.sql.shuffle.partitions": "3"},
    {
        "spark.sql.shuffle.partitions": "64",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    },
    {"spark.sql.shuffle.partitions": "5", "spark.sql.adaptive.enabled": "false"},
]


def test_panel_does_not_depend_on_partitions(spark):
    """The union's layout is relied upon, however adaptive execution joins partitions."""
    from tidemark.sources.tables import RULES, lineitem_sheet, orders_history

    results = []
    for settings in SETTINGS:
        before = {name: spark.conf.get(name) for name in settings}
        for name, value in settings.items():
            spark.conf.set(name, value)
        try:
            panel = build_panel(orders_history(spark, SF), lineitem_sheet(spark, SF), RULES)
            results.append(sorted(map(repr, panel.collect())))
        finally:
            for name, value in before.items():
                spark.conf.set(name, value)
    assert len(results[0]) > 1000
    assert all(rows == results[0] for rows in results)
