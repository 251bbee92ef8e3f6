"""The same queries as plain SQL over the tables, to check results against.

Written from the definitions (windows over whole series, joins, elimination),
not from the Spark code.
"""

from __future__ import annotations

from tidemark.queries import (
    FIRST_DAY,
    RUN_AT,
    SECOND_AS_OF,
    SECOND_RUN_AT,
    TARGETS,
    TRACKED,
)
from tidemark.settings import CENTRES, FEATURES, LAGS, MEAN_PAIRS, ZONE, lag_feature, ratio_feature
from tidemark.sources.tables import AS_OF, PRIORITIES, RULES, SHEET_END

W = "(PARTITION BY entity ORDER BY date)"
SO_FAR = "(PARTITION BY entity ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
TO_COME = "(PARTITION BY entity ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"

HISTORY = """history AS (
  SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS entity,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS level,
         CAST(count(*) AS DOUBLE) AS playlists,
         CAST(count(DISTINCT o_custkey) AS DOUBLE) AS reach
  FROM orders GROUP BY 1, 2)"""

HIT = " OR ".join(f"(entity = '{e}' AND date BETWEEN DATE '{a}' AND DATE '{b}')" for e, a, b in RULES)
MASKED = f"""masked AS (
  SELECT date, entity, level,
         CASE WHEN {HIT} THEN NULL ELSE playlists END AS playlists,
         CASE WHEN {HIT} THEN NULL ELSE reach END AS reach
  FROM history WHERE level > 0)"""


def _interpolated(name: str, source: str, columns: tuple[str, ...]) -> str:
    near = ", ".join(
        f"last_value({c} IGNORE NULLS) OVER {SO_FAR} AS {c}0, "
        f"max(CASE WHEN {c} IS NOT NULL THEN rn END) OVER {SO_FAR} AS {c}x0, "
        f"first_value({c} IGNORE NULLS) OVER {TO_COME} AS {c}1, "
        f"min(CASE WHEN {c} IS NOT NULL THEN rn END) OVER {TO_COME} AS {c}x1"
        for c in columns
    )
    lines = ", ".join(
        f"coalesce({c}, {c}0 + ({c}1 - {c}0) * (rn - {c}x0) / ({c}x1 - {c}x0)) AS {c}" for c in columns
    )
    return f"""{name}_rn AS (SELECT *, row_number() OVER {W} AS rn FROM {source}),
{name}_near AS (SELECT *, {near} FROM {name}_rn),
{name} AS (SELECT date, entity, level, {lines} FROM {name}_near)"""


CLEAN = ",\n".join(
    [
        HISTORY,
        MASKED,
        _interpolated("repaired", "masked", ("playlists", "reach")),
        f"clean AS (SELECT date, entity, lead(level) OVER {W} AS level, playlists, reach FROM repaired)",
    ]
)


def _sheet(staggered: bool) -> str:
    last = "CAST(l_shipdate AS DATE) <= DATE '{}' - 3 * (CAST(left(o_orderpriority, 1) AS INTEGER) - 1)"
    return f"""sheet AS (
  SELECT CAST(l_shipdate AS DATE) AS date, o_orderpriority AS entity,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) // 100 AS BIGINT) AS level
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE {last.format(SHEET_END) if staggered else "true"}
  GROUP BY 1, 2)"""


def _merged(source: str) -> str:
    """Full outer join of the two sources."""
    return f"""merged AS (
  SELECT coalesce(a.date, s.date) AS date, coalesce(a.entity, s.entity) AS entity,
         CAST(CASE WHEN s.date IS NOT NULL THEN s.level ELSE a.level END AS DOUBLE) AS level,
         a.reach AS reach
  FROM (SELECT * FROM {source} WHERE level IS NOT NULL OR reach IS NOT NULL) a
  FULL JOIN sheet s ON a.date = s.date AND a.entity = s.entity)"""


def _means(lengths: tuple[int, ...]) -> str:
    frame = "(PARTITION BY entity ORDER BY date ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
    return ", ".join(
        f"CASE WHEN count(level) OVER {frame.format(n - 1)} = {n} "
        f"THEN avg(level) OVER {frame.format(n - 1)} END AS m{n}"
        for n in lengths
    )


def _features(source: str) -> str:
    lengths = tuple(sorted({n for pair in MEAN_PAIRS for n in pair}))
    ratios = ", ".join(f"m{s} / nullif(m{l}, 0) AS {ratio_feature(s, l)}" for s, l in MEAN_PAIRS)
    changes = ", ".join(f"ff / nullif(lag(ff, {n}) OVER {W}, 0) - 1 AS {lag_feature(n)}" for n in LAGS)
    return f"""filled AS (
  SELECT *, last_value(reach IGNORE NULLS) OVER {SO_FAR} AS ff, {_means(lengths)} FROM {source}),
features AS (SELECT date, entity, level, reach, {ratios}, {changes} FROM filled)"""


NOT_NULL = " AND ".join(f"{c} IS NOT NULL" for c in ("level", "reach", *FEATURES))
TRAIN = f"train AS (SELECT * FROM features WHERE {NOT_NULL})"
LATEST_COLUMNS = ("level", "reach", *FEATURES)
LATEST = f"""carried AS (
  SELECT date, entity, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS back,
         {", ".join(f"last_value({c} IGNORE NULLS) OVER {SO_FAR} AS {c}" for c in LATEST_COLUMNS)}
  FROM features),
latest AS (SELECT * EXCLUDE (back) FROM carried WHERE back = 1)"""


def _panel(staggered: bool = False) -> str:
    return ",\n".join([CLEAN, _sheet(staggered), _merged("clean")])


def _all_features(staggered: bool = False) -> str:
    return ",\n".join([_panel(staggered), _features("merged")])


def _rounded(columns: tuple[str, ...], digits: int) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


# Regression: cross-products per horizon, then Gauss-Jordan elimination on the
# long table of cells (h, i, j, v); row i = 1..k+1, the last column is the target.

TERMS = ("1.0", *(f"({name} - {CENTRES[name]})" if name in CENTRES else name for name in FEATURES))
SIZE = len(TERMS)


def _gram(as_of: str) -> str:
    horizons = f"""horizons AS (
  SELECT DISTINCT CAST(last_day(DATE '{as_of}') - date AS INTEGER) AS h FROM latest)"""
    ranked = f"ranked AS (SELECT *, row_number() OVER {W} AS rn FROM train)"
    pairs = f"""pairs AS (
  SELECT h, b.level / nullif(a.level, 0) - 1 AS y, a.*
  FROM horizons JOIN ranked a ON true JOIN ranked b ON b.entity = a.entity AND b.rn = a.rn + h
  WHERE a.level <> 0)"""
    sums = [
        f"SELECT h, {i} AS i, {j} AS j, sum({a} * {b}) AS v FROM pairs GROUP BY h"
        for i, a in enumerate(TERMS)
        for j, b in enumerate((*TERMS, "y"))
        if i <= j
    ]
    upper = "upper_cells AS MATERIALIZED (" + " UNION ALL ".join(sums) + ")"
    return ",\n".join([horizons, ranked, pairs.replace("AS (", "AS MATERIALIZED (", 1), upper])


def _solution() -> str:
    steps = [
        f"""step0 AS MATERIALIZED (
  SELECT h, i, j, v FROM upper_cells
  UNION ALL SELECT h, j, i, v FROM upper_cells WHERE i < j AND j < {SIZE})"""
    ]
    for k in range(SIZE):
        steps.append(
            f"""step{k + 1} AS MATERIALIZED (
  SELECT c.h, c.i, c.j,
         CASE WHEN c.i = {k} THEN c.v / p.v ELSE c.v - f.v * r.v / p.v END AS v
  FROM step{k} c
  JOIN step{k} p ON p.h = c.h AND p.i = {k} AND p.j = {k}
  JOIN step{k} r ON r.h = c.h AND r.i = {k} AND r.j = c.j
  JOIN step{k} f ON f.h = c.h AND f.i = c.i AND f.j = {k})"""
        )
    weights = ", ".join(
        f"max(CASE WHEN i = {i} THEN v END) AS w{i}" for i in range(SIZE)
    )
    steps.append(f"centred AS (SELECT h, {weights} FROM step{SIZE} WHERE j = {SIZE} GROUP BY h)")
    moved = " - ".join(["w0", *(f"{CENTRES[name]} * w{i}" for i, name in enumerate(FEATURES, 1) if name in CENTRES)])
    steps.append(f"models AS (SELECT * REPLACE ({moved} AS w0) FROM centred)")
    return ",\n".join(steps)


def _forecast(as_of: str = AS_OF) -> str:
    growth = " + ".join(["w0", *(f"w{i} * {name}" for i, name in enumerate(FEATURES, 1))])
    score = f"""scored AS (
  SELECT entity, date AS latest_date, level, last_day(DATE '{as_of}') AS forecast_date,
         round(level * (1 + {growth}), 2) AS forecast
  FROM latest JOIN models ON h = CAST(last_day(DATE '{as_of}') - date AS INTEGER))"""
    return ",\n".join([_all_features(True), TRAIN, LATEST, _gram(as_of), _solution(), score])


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


def _run(ctes: str, run_at: str) -> str:
    return _with(ctes, f"SELECT TIMESTAMP '{run_at}' AS run_at, * FROM scored")


def _local(utc: str) -> str:
    """Wall clock and abbreviation in the zone, from its offset to UTC."""
    local = f"timezone('{ZONE}', timezone('UTC', {utc}))"
    label = f"CASE WHEN date_diff('minute', {utc}, {local}) = -300 THEN 'CDT' ELSE 'CST' END"
    return f"strftime({local}, '%Y-%m-%d %H:%M:%S') || ' ' || {label}"


def _grouped(value: str) -> str:
    """Digits grouped by comma, with at least one decimal."""
    sign = f"CASE WHEN {value} < 0 THEN '-' ELSE '' END"
    whole = f"format('{{:,}}', CAST(floor(abs({value})) AS BIGINT))"
    return f"{sign} || {whole} || '.' || split_part(CAST({value} AS VARCHAR), '.', 2)"


SPARSE = f"""{HISTORY},
sparse AS (
  SELECT date, entity, CASE WHEN year(date) <> 1996 THEN floor(level) END AS level,
         CASE WHEN month(date) <= 6 THEN reach END AS reach
  FROM history)"""

WIDE_DAYS = f"{HISTORY}, {_sheet(False)}"

_TRAINING = ",\n".join([_all_features(True), TRAIN, LATEST, _gram(AS_OF)])
_NAMES = ("intercept", *FEATURES, "growth")
_TERM = " ".join(f"WHEN {{c}} = {i} THEN '{name}'" for i, name in enumerate(_NAMES))

ORACLE: dict[str, str] = {
    "json_field_extract": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "json_history_explode": _with(HISTORY, "SELECT date, entity, level, playlists, reach FROM history"),
    "json_history_files": _with(HISTORY, "SELECT date, entity, level, playlists, reach FROM history"),
    "sheet_melt": _with(WIDE_DAYS, "SELECT date, entity, level FROM sheet"),
    "sheet_csv_files": _with(WIDE_DAYS, "SELECT date, entity, level FROM sheet"),
    "sheet_header_dedup": _with(
        WIDE_DAYS,
        "SELECT strftime(date, '%-m/%-d/%Y') AS day, "
        + ", ".join(
            f"coalesce(max(CASE WHEN entity = '{p}' THEN format('{{:,}}', level) END), '') AS sheet_{i}"
            for i, p in enumerate(PRIORITIES, 1)
        )
        + " FROM sheet GROUP BY date",
    ),
    "entity_semi_join": _with(HISTORY, f"SELECT * FROM history WHERE entity IN {TRACKED}"),
    "start_date_filter": _with(HISTORY, f"SELECT * FROM history WHERE date >= DATE '{FIRST_DAY}'"),
    "forecast_snapshot": _with(
        _forecast(),
        f"""SELECT {_local(f"TIMESTAMP '{RUN_AT}'")} AS run_at, entity,
  strftime(latest_date, '%Y-%m-%d') AS latest_date, {_grouped("level")} AS level,
  strftime(forecast_date, '%Y-%m-%d') AS forecast_date, {_grouped("forecast")} AS forecast
FROM scored ORDER BY entity""",
    ),
    "forecast_history": f"""SELECT * FROM ({_run(_forecast(AS_OF), RUN_AT)})
UNION ALL SELECT * FROM ({_run(_forecast(SECOND_AS_OF), SECOND_RUN_AT)})
ORDER BY run_at DESC, entity""",
    "panel_select": _with(
        CLEAN, "SELECT date, entity, round(level, 6) AS level, round(reach, 6) AS reach FROM clean"
    ),
    "rename_columns": "SELECT o_orderkey, o_orderpriority AS entity, o_totalprice AS level FROM orders",
    "parse_us_date": """SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS short,
  CAST(l_shipdate AS DATE) AS long FROM lineitem""",
    "clean_thousands": """SELECT l_orderkey, l_linenumber,
  CASE WHEN l_returnflag = 'R' THEN NULL ELSE CAST(floor(l_extendedprice) AS BIGINT) END AS amount
FROM lineitem""",
    "anomaly_mask": _with(f"{HISTORY}, {MASKED}", "SELECT * FROM masked"),
    "anomaly_mask_table": _with(f"{HISTORY}, {MASKED}", "SELECT * FROM masked"),
    "month_end": """SELECT o_orderkey, last_day(o_orderdate) AS month_end,
  CAST(day(last_day(o_orderdate)) AS INTEGER) AS month_length FROM orders""",
    "horizon_days": f"""SELECT l_orderkey, l_linenumber,
  CAST(last_day(DATE '{AS_OF}') - CAST(l_shipdate AS DATE) AS INTEGER) AS horizon FROM lineitem""",
    "format_date": f"""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day,
  {_local("o_orderdate")} AS local_time FROM orders""",
    "format_thousands": f"""SELECT o_orderkey, {_grouped("o_totalprice")} AS price,
  format('{{:,}}', CAST(floor(o_totalprice) AS BIGINT)) AS whole_price FROM orders""",
    "positive_filter": "SELECT c_custkey, c_acctbal AS level FROM customer WHERE c_acctbal > 0",
    "drop_all_null": _with(SPARSE, "SELECT * FROM sparse WHERE level IS NOT NULL OR reach IS NOT NULL"),
    "complete_cases": _with(
        f"{_all_features()}, {TRAIN}",
        f"SELECT date, entity, level, round(reach, 8) AS reach, {_rounded(FEATURES, 8)} FROM train",
    ),
    "union_all": _with(
        HISTORY,
        " UNION ALL ".join(f"SELECT * FROM history WHERE entity = '{p}'" for p in PRIORITIES),
    ),
    "union_relaxed": _with(
        WIDE_DAYS,
        """SELECT date, entity, level, reach FROM history
UNION ALL SELECT date, entity, CAST(level AS DOUBLE), NULL FROM sheet""",
    ),
    "precedence_merge": _with(f"{WIDE_DAYS}, {_merged('history')}", "SELECT * FROM merged"),
    "precedence_merge_join": _with(f"{WIDE_DAYS}, {_merged('history')}", "SELECT * FROM merged"),
    "latest_row": _with(
        f"{_all_features(True)}, {LATEST}",
        f"SELECT entity, date, level, round(reach, 8) AS reach, {_rounded(FEATURES, 8)} FROM latest",
    ),
    "coverage_summary": _with(
        f"{_all_features(True)}, {TRAIN}, {LATEST}",
        """SELECT 'training' AS rows, min(date) AS first_day, max(date) AS last_day,
  count(DISTINCT entity) AS entities FROM train
UNION ALL SELECT 'latest', min(date), max(date), count(*) FROM latest""",
    ),
    "distinct_horizons": _with(
        _panel(True),
        f"""SELECT DISTINCT CAST(last_day(DATE '{AS_OF}') - last AS INTEGER) AS horizon
FROM (SELECT entity, max(date) AS last FROM merged GROUP BY entity)""",
    ),
    "lead_level": _with(
        HISTORY, f"SELECT date, entity, lead(level) OVER {W} AS level, playlists, reach FROM history"
    ),
    "interpolate_linear": _with(
        ",\n".join([HISTORY, MASKED, _interpolated("repaired", "masked", ("playlists", "reach"))]),
        "SELECT date, entity, level, round(playlists, 8) AS playlists, round(reach, 8) AS reach FROM repaired",
    ),
    "pct_change_lags": _with(
        _all_features(),
        f"SELECT date, entity, {_rounded(tuple(lag_feature(n) for n in LAGS), 8)} FROM features",
    ),
    "rolling_mean": _with(
        f"{SPARSE}, means AS (SELECT *, {_means((7, 28, 84, 168))} FROM sparse)",
        "SELECT date, entity, level, "
        + ", ".join(f"round(m{n}, 4) AS level_mean_{n}" for n in (7, 28, 84, 168))
        + " FROM means",
    ),
    "ma_ratio": _with(
        _all_features(),
        f"SELECT date, entity, {_rounded(tuple(ratio_feature(s, l) for s, l in MEAN_PAIRS), 8)} FROM features",
    ),
    "forward_fill": _with(
        SPARSE,
        f"""SELECT date, entity, last_value(level IGNORE NULLS) OVER {SO_FAR} AS level,
  last_value(reach IGNORE NULLS) OVER {SO_FAR} AS reach FROM sparse""",
    ),
    "growth_target": _with(
        f"{_all_features()}, {TRAIN}",
        "SELECT date, entity, level, "
        + ", ".join(
            f"round(lead(level, {h}) OVER {W} / nullif(level, 0) - 1, 8) AS growth_target_{h}" for h in TARGETS
        )
        + " FROM train",
    ),
    "supplier_features": _with(
        f"""panel AS (
  SELECT CAST(l_shipdate AS DATE) AS date, l_suppkey AS entity,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS level,
         sum(l_quantity) AS reach
  FROM lineitem GROUP BY 1, 2), {_features("panel")}""",
        f"SELECT date, entity, level, reach, {_rounded(FEATURES, 8)} FROM features",
    ),
    "panel_sort": _with(
        _panel(),
        "SELECT date, entity, round(level, 6) AS level, round(reach, 6) AS reach FROM merged ORDER BY date, entity",
    ),
    "ols_gram": _with(
        _TRAINING,
        f"""SELECT h AS horizon, CASE {_TERM.format(c="i")} END AS term,
  CASE {_TERM.format(c="j")} END AS other, round(v, 5) AS value FROM upper_cells""",
    ),
    "ols_coefficients": _with(
        f"{_TRAINING}, {_solution()}",
        "SELECT h AS horizon, (SELECT CAST(v AS BIGINT) FROM upper_cells u "
        "WHERE u.h = models.h AND i = 0 AND j = 0) AS n_rows, round(w0, 6) AS intercept, "
        + ", ".join(f"round(w{i}, 6) AS {name}" for i, name in enumerate(FEATURES, 1))
        + " FROM models",
    ),
    "forecast_month_end": _with(_forecast(), "SELECT * FROM scored"),
    "run_month_end": _run(_forecast(), RUN_AT),
}
