"""Pooled least squares, one model per horizon, and scoring.

One aggregation makes the cross-product sums of all horizons; a model is then
the solution of an 11 x 11 system, whatever the number of training rows. The
systems, one small row per horizon, are solved on the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import compound
from tidemark.operators.series import quoted
from tidemark.operators.windows import TARGETS
from tidemark.settings import CENTRES

# Terms: 0 is the intercept, 1..k the features, "y" the growth target.
Pair = tuple[int, int | str]

#: Eigenvalues of the correlations up to this one count as none: what is left of zero
#: after sums of products in double precision.
SINGULAR = 1e-13


def _feature_pairs(size: int) -> list[Pair]:
    return list(combinations_with_replacement(range(size + 1), 2))


def _pairs(size: int) -> list[Pair]:
    return [*_feature_pairs(size), *((i, "y") for i in range(size + 1))]


def _cell(pair: Pair) -> str:
    return f"g_{pair[0]}_{pair[1]}"


def cross_products(
    train: DataFrame,
    horizons: Sequence[int],
    features: Sequence[str],
    centres: Mapping[str, float] = CENTRES,
) -> DataFrame:
    """Per horizon, the sums of all products of two terms over rows with a growth target.

    `train` has the targets in the list TARGETS, in ascending order of horizons.

    A feature's centre is subtracted from it, so that sums of features that lie close to
    a constant keep their digits; a centre is fixed, and takes no pass of its own.

    The horizons for which a row has a target are adjoining ones in ascending order. So
    products of features are summed once per row, by first and last of its horizons, and
    those few sums are then added up for each horizon. Only products with the target
    are made for every horizon, inside the map tasks.
    """
    ordered = sorted(horizons)
    size = len(features)
    terms = {0: "1.0D"}
    for i, name in enumerate(features, 1):
        centre = centres.get(name, 0.0)
        terms[i] = f"({quoted(name)} - {centre}D)" if centre else quoted(name)
    rows = train.selectExpr(*map(quoted, features), f"{TARGETS} AS targets")

    known = "transform(targets, (y, i) -> if(y IS NOT NULL, i, NULL))"
    reach = rows.selectExpr("*", f"array_min({known}) AS first", f"array_max({known}) AS last")
    products = [F.expr(f"sum({terms[i]} * {terms[j]}) AS {_cell((i, j))}") for i, j in _feature_pairs(size)]
    by_reach = reach.where("first IS NOT NULL").groupBy("first", "last").agg(*products)
    each = by_reach.selectExpr("*", "explode(sequence(first, last)) AS place").groupBy("place")
    of_features = each.agg(*[F.sum(_cell(p)).alias(_cell(p)) for p in _feature_pairs(size)])

    moved = rows.selectExpr(*map(quoted, features), "posexplode(targets) AS (place, y)").where("y IS NOT NULL")
    with_target = [F.expr(f"sum({terms[i]} * y) AS {_cell((i, 'y'))}") for i in range(size + 1)]
    of_target = moved.groupBy("place").agg(*with_target)

    horizon = f"element_at(array({', '.join(map(str, ordered))}), place + 1) AS horizon"
    cells = [_cell(p) for p in _pairs(size)]
    return of_features.join(of_target, "place").selectExpr(horizon, *cells)


def cross_product_cells(sums: DataFrame, features: Sequence[str]) -> DataFrame:
    """The sums in long form: horizon, names of the two terms, value."""
    names = {0: "intercept", "y": "growth", **dict(enumerate(features, 1))}
    cells = ", ".join(
        f"struct('{names[i]}' AS term, '{names[j]}' AS other, {_cell((i, j))} AS value)"
        for i, j in _pairs(len(features))
    )
    return sums.selectExpr("horizon", f"inline(array({cells}))")


def least_squares(gram: np.ndarray, moments: np.ndarray) -> np.ndarray:
    """Intercept and coefficients from cross-products; of minimum norm if they are not unique.

    Rank is judged on correlations, which do not depend on the size of a feature.
    """
    rows = gram[0, 0]
    means, y_mean = gram[0, 1:] / rows, moments[0] / rows
    spread = gram[1:, 1:] - rows * np.outer(means, means)
    shared = moments[1:] - rows * means * y_mean
    # What subtraction leaves of a constant is noise and no spread.
    noise = SINGULAR * np.diag(gram)[1:]
    scale = np.sqrt(np.where(np.diag(spread) > noise, np.diag(spread), 0.0))
    inverse = np.divide(1.0, scale, out=np.zeros_like(scale), where=scale > 0)
    values, vectors = np.linalg.eigh(spread * np.outer(inverse, inverse))
    used = values > SINGULAR
    steps = vectors[:, used] / values[used]
    weights = inverse * (steps @ (vectors[:, used].T @ (inverse * shared)))
    if not used.all():
        # Directions in which the features do not differ: leave nothing of the weights in them.
        idle = np.column_stack([inverse[:, None] * vectors[:, ~used], np.eye(len(scale))[:, scale == 0]])
        idle = idle[:, np.abs(idle).max(axis=0) > 0]
        basis, _ = np.linalg.qr(idle)
        weights = weights - basis @ (basis.T @ weights)
    return np.concatenate([[y_mean - means @ weights], weights])


def solve_models(
    sums: DataFrame, features: Sequence[str], centres: Mapping[str, float] = CENTRES
) -> DataFrame:
    """Least-squares model per horizon: horizon, n_rows, intercept, one column per feature.

    `centres` are those that the sums were made with. The sums of a horizon are one row
    of numbers, and there are no more horizons than days in the calendar range.
    """
    size = len(features)
    shift = np.array([centres.get(name, 0.0) for name in features])
    models = []
    for row in sums.collect():
        gram, moments = np.zeros((size + 1, size + 1)), np.zeros(size + 1)
        for i, j in _pairs(size):
            if j == "y":
                moments[i] = row[_cell((i, j))]
            else:
                gram[i, j] = gram[j, i] = row[_cell((i, j))]
        intercept, *weights = least_squares(gram, moments)
        models.append((row["horizon"], int(gram[0, 0]), float(intercept - shift @ weights), *map(float, weights)))
    columns = ", ".join(f"`{name}` double" for name in ("intercept", *features))
    return sums.sparkSession.createDataFrame(models, f"horizon int, n_rows bigint, {columns}")


def predict(
    latest: DataFrame,
    models: DataFrame,
    features: Sequence[str],
    entity: str = "entity",
    order: str = "date",
) -> DataFrame:
    """Score rows that carry `horizon` and `forecast_date`. Rows without a forecast have it null.

    `models` has one row per horizon. From `solve_models` it is a local table, whose size
    the planner knows and by which it broadcasts it.
    """
    weights = models.selectExpr("horizon", "intercept", *[f"`{f}` AS `__w_{f}`" for f in features])
    growth = " + ".join(["intercept", *[f"`__w_{f}` * `{f}`" for f in features]])
    scored = latest.join(weights, "horizon", "left")
    return scored.select(
        entity,
        F.col(order).alias("latest_date"),
        "level",
        "forecast_date",
        compound(F.col("level"), F.expr(growth)).alias("forecast"),
        "horizon",
        F.col("intercept").isNotNull().alias("has_model"),
    )
