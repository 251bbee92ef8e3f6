"""Fits against numpy, MLlib and known answers."""

import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

import tidemark.plans.forecast as plan
from helpers import PANEL, day
from tidemark.operators.regression import cross_products, least_squares, predict, solve_models
from tidemark.operators.windows import TARGETS, growth_targets, target_of
from tidemark.plans.forecast import features_and_sums, forecast_panel
from tidemark.operators.series import SeriesKey
from tidemark.settings import FEATURES


def moments(x, y):
    ones = np.column_stack([np.ones(len(x)), x])
    return ones.T @ ones, ones.T @ y


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(11)
    rows = []
    for entity, size in (("A", 500), ("B", 420), ("C", 260)):
        level, reach = 1e6, 1e4
        for d in range(size):
            level *= 1 + rng.uniform(-0.02, 0.021)
            reach *= 1 + rng.uniform(-0.03, 0.031)
            rows.append((day(d), entity, level, None if d % 29 == 7 else reach))
    return spark.createDataFrame(rows, PANEL).cache()


def fitted_by_numpy(rows, features, target):
    x = np.array([[r[f] for f in features] for r in rows])
    y = np.array([r[target] for r in rows])
    return np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]


@pytest.mark.parametrize("key", [SeriesKey(), SeriesKey(chunk_days=50, block_rows=37)])
def test_models_match_numpy(spark, panel, key):
    horizons = [0, 5, 30]
    table, sums = features_and_sums(panel, horizons, key)
    models = {r.horizon: r for r in solve_models(sums, FEATURES).collect()}
    train = table.where("__train_rank IS NOT NULL").select("date", "entity", "level", *FEATURES)
    rows = growth_targets(train, horizons).collect()
    for h in horizons:
        used = [r for r in rows if r[target_of(h)] is not None]
        expected = fitted_by_numpy(used, FEATURES, target_of(h))
        got = [models[h].intercept, *[models[h][f] for f in FEATURES]]
        assert models[h].n_rows == len(used)
        np.testing.assert_allclose(got, expected, rtol=1e-6, atol=1e-9)


def test_models_match_mllib(spark, panel):
    key, h = SeriesKey(), 14
    table, sums = features_and_sums(panel, [h], key)
    model = solve_models(sums, FEATURES).first()
    train = table.where("__train_rank IS NOT NULL").select("date", "entity", "level", *FEATURES)
    labelled = growth_targets(train, [h]).where(f"{target_of(h)} IS NOT NULL")
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(labelled)
    other = LinearRegression(featuresCol="x", labelCol=target_of(h), solver="normal", regParam=0.0).fit(vectors)
    np.testing.assert_allclose([model[f] for f in FEATURES], other.coefficients.toArray(), rtol=1e-6, atol=1e-9)
    assert abs(model.intercept - other.intercept) < 1e-8


def test_whole_and_cut_series_give_the_same_sums(spark, panel):
    whole, key, horizons = SeriesKey(), SeriesKey(chunk_days=60, block_rows=45), [0, 12, -3, 31]
    results = []
    for k in (whole, key):
        table, sums = features_and_sums(panel, horizons, k)
        rows = table.select("date", "entity", "level", "reach", *FEATURES).collect()
        results.append((sorted(map(repr, rows)), sorted(sums.collect(), key=lambda r: r.horizon)))
    assert results[0][0] == results[1][0]
    np.testing.assert_allclose(results[0][1], results[1][1], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("key", [SeriesKey(), SeriesKey(chunk_days=60, block_rows=45)])
def test_horizons_together_give_the_same_sums_as_alone(spark, panel, key):
    horizons = list(range(-2, 6))
    at_once = {r.horizon: tuple(r) for r in features_and_sums(panel, horizons, key)[1].collect()}
    assert at_once.keys() == set(horizons)
    for h in horizons:
        alone = features_and_sums(panel, [h], key)[1].first()
        np.testing.assert_allclose(at_once[h], tuple(alone), rtol=1e-9, atol=1e-9)


def test_residuals_are_orthogonal_to_the_features():
    rng = np.random.default_rng(0)
    x, y = rng.normal(1.0, 0.1, (500, 10)), rng.normal(0, 1, 500)
    w = least_squares(*moments(x, y))
    ones = np.column_stack([np.ones(500), x])
    assert np.abs(ones.T @ (y - ones @ w)).max() < 1e-8


def test_features_of_very_different_size():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (400, 3)) * [1e-4, 1.0, 1e5]
    y = x @ [3e3, 2.0, 1e-5] + 0.5
    np.testing.assert_allclose(least_squares(*moments(x, y)), [0.5, 3e3, 2.0, 1e-5], rtol=1e-8)


def test_deficient_rank_gives_the_solution_of_minimum_norm():
    rng = np.random.default_rng(2)
    a = rng.normal(0, 1, (100, 2))
    x = np.column_stack([a, a[:, 0], np.full(100, 7.0)])  # a copy and a constant
    y = a @ [2.0, -1.0] + 3.0
    np.testing.assert_allclose(least_squares(*moments(x, y)), [3.0, 1.0, -1.0, 1.0, 0.0], atol=1e-8)
    few = rng.normal(0, 1, (4, 10))
    target = rng.normal(0, 1, 4)
    centred = few - few.mean(axis=0)
    expected = np.linalg.pinv(centred) @ (target - target.mean())
    got = least_squares(*moments(few, target))
    np.testing.assert_allclose(got[1:], expected, atol=1e-7)


def test_cross_products_leave_out_rows_without_a_target(spark):
    rows = [(1.0, 2.0, [None]), (2.0, 3.0, [0.5]), (4.0, 5.0, [1.0])]
    df = spark.createDataFrame(rows, f"a double, b double, {TARGETS} array<double>")
    centred = cross_products(df, [3], ["a", "b"], {"b": 3.0}).first().asDict()
    assert {k: centred[k] for k in ("g_0_2", "g_1_2", "g_2_2", "g_2_y")} == {
        "g_0_2": 2.0, "g_1_2": 8.0, "g_2_2": 4.0, "g_2_y": 2.0,
    }
    got = cross_products(df, [3], ["a", "b"]).first().asDict()
    assert got == {
        "horizon": 3,
        "g_0_0": 2.0, "g_0_1": 6.0, "g_0_2": 8.0, "g_1_1": 20.0, "g_1_2": 26.0, "g_2_2": 34.0,
        "g_0_y": 1.5, "g_1_y": 5.0, "g_2_y": 6.5,
    }


def test_score(spark):
    latest = spark.createDataFrame(
        [("A", day(1), 200.0, 1.0, 2.0, day(30), 9), ("B", day(1), 50.0, 1.0, None, day(30), 9), ("C", day(1), 50.0, 1.0, 2.0, day(30), 8)],
        "entity string, date date, level double, p double, q double, forecast_date date, horizon int",
    )
    models = spark.createDataFrame([(9, 10, 0.5, -0.6, 0.1)], "horizon int, n_rows bigint, intercept double, p double, q double")
    got = {r.entity: (r.forecast, r.has_model) for r in predict(latest, models, ["p", "q"]).collect()}
    assert abs(got["A"][0] - 220.0) < 1e-9 and got["A"][1]
    assert got["B"] == (None, True) and got["C"] == (None, False)


def test_cutting_long_series_leaves_the_forecast_as_it_is(spark, panel):
    whole = {r.entity: r for r in forecast_panel(panel, as_of=str(day(505))).scored.collect()}
    cut = forecast_panel(panel, as_of=str(day(505)), key=SeriesKey(chunk_days=60, block_rows=45)).scored.collect()
    assert whole.keys() == {r.entity for r in cut}
    for row in cut:
        assert abs(row.forecast / whole[row.entity].forecast - 1) < 1e-9


def test_forecast_of_a_panel(spark, panel):
    """Different last days give different horizons; short series are reported, not scored."""
    extra = spark.createDataFrame([(day(d), "short", 10.0, 5.0) for d in range(480, 500)], PANEL)
    result = forecast_panel(panel.unionByName(extra), as_of=str(day(505)))
    end = spark.range(1).select(F.last_day(F.lit(str(day(505))).cast("date")).alias("d")).first().d
    scored = {r.entity: r for r in result.scored.collect()}
    assert scored.keys() == {"A", "B", "C"}
    assert result.scored.columns == ["entity", "latest_date", "level", "forecast_date", "forecast"]
    models = {r.horizon: r for r in result.models.collect()}
    latest = {r.entity: r for r in result.latest.collect()}
    for entity, last in (("A", 499), ("B", 419), ("C", 259)):
        row = scored[entity]
        assert row.latest_date == day(last) and row.forecast_date == end
        model = models[(end - day(last)).days]
        growth = model.intercept + sum(model[f] * latest[entity][f] for f in FEATURES)
        assert abs(row.forecast - row.level * (1 + growth)) < 1e-6 * row.level
    rejected = {r.entity: r.reason for r in result.rejected.collect()}
    assert rejected == {"short": "null feature or level"}
    coverage = {r.rows: r for r in result.coverage().collect()}
    assert coverage["training"].entities == 3 and coverage["latest"].entities == 4


def test_horizon_beyond_the_training_rows_is_rejected(spark, panel):
    result = forecast_panel(panel.where("entity = 'C'"), as_of=str(day(1500)))
    assert result.scored.isEmpty()
    assert result.rejected.first().reason == "no training rows for the horizon"


def test_horizon_zero_and_below(spark, panel):
    a = panel.where("entity = 'A'")
    last_of_month = day(485)  # 2021-04-30
    at_end = forecast_panel(a.where(F.col("date") <= F.lit(str(last_of_month)).cast("date")), as_of=str(last_of_month))
    row = at_end.scored.first()
    assert abs(row.forecast - row.level) < 1e-6 * row.level
    before = forecast_panel(a, as_of=str(day(480)))  # the last day is 14 days after the month's end
    assert [r.horizon for r in before.models.collect()] == [-14]
    assert before.scored.count() == 1


def test_rows_without_entity_or_day_are_left_out(spark, panel):
    """Whatever the size of blocks: the same forecast as without such rows."""
    odd = [(None, "A", 5e6, 7.0), (None, "B", 1.0, 1.0), (day(3), None, 2e6, 5.0), (day(4), None, 3e6, 6.0), (None, None, 1.0, 1.0)]
    more = panel.unionByName(spark.createDataFrame(odd, PANEL))
    expected = sorted(forecast_panel(panel, as_of=str(day(505))).scored.collect())
    for key in (SeriesKey(), SeriesKey(chunk_days=60, block_rows=45)):
        got = sorted(forecast_panel(more, as_of=str(day(505)), key=key).scored.collect())
        assert [r[:4] for r in got] == [r[:4] for r in expected]
        np.testing.assert_allclose([r.forecast for r in got], [r.forecast for r in expected], rtol=1e-9)


def test_features_close_to_their_centre(spark):
    """Ratios that spread by a millionth keep their digits in the sums."""
    rng = np.random.default_rng(5)
    x = np.column_stack([1 + 1e-6 * rng.normal(size=800), rng.normal(size=800)])
    y = 2e4 * (x[:, 0] - 1) + 0.3 * x[:, 1] + 0.01 * rng.normal(size=800)
    rows = [(*a, [b]) for a, b in zip(x.tolist(), y.tolist())]
    df = spark.createDataFrame(rows, f"a double, b double, {TARGETS} array<double>")
    centres = {"a": 1.0}
    model = solve_models(cross_products(df, [3], ["a", "b"], centres), ["a", "b"], centres).first()
    centred = x - x.mean(axis=0)
    expected = np.linalg.lstsq(centred, y - y.mean(), rcond=None)[0]
    np.testing.assert_allclose([model.a, model.b], expected, rtol=1e-8)
    np.testing.assert_allclose(model.intercept, y.mean() - x.mean(axis=0) @ expected, rtol=1e-8)


def test_features_that_hardly_differ():
    rng = np.random.default_rng(6)
    a = rng.normal(size=500)
    x = np.column_stack([a, a + 1e-6 * rng.normal(size=500)])
    np.testing.assert_allclose(least_squares(*moments(x, x @ [5.0, -4.0])), [0.0, 5.0, -4.0], atol=0.05)


def test_many_horizons_take_one_pass(spark, panel, monkeypatch):
    staged = []
    write = plan.stage
    monkeypatch.setattr(plan, "stage", lambda df, name: staged.append(name) or write(df, name))
    plans = []
    for horizons in ([30], list(range(1, 501))):
        staged.clear()
        _, sums = features_and_sums(panel.where("entity <> 'B'"), horizons)
        assert staged == ["features", "offsets"]
        rows = sums.select("horizon").collect()
        # Of 332 days with features, 11 have no reach: the first has targets up to 320 rows ahead.
        assert sorted(r.horizon for r in rows) == [h for h in horizons if h <= 320]
        plans.append(sums._jdf.queryExecution().optimizedPlan().toString())
    assert len({p.count("Repartition") for p in plans}) == len({p.count("Relation ") for p in plans}) == 1


def test_models_need_no_python_in_tasks(spark, panel):
    result = forecast_panel(panel, as_of=str(day(505)))
    for df in (result.scored, result.sums, result.models, result.rejected):
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
