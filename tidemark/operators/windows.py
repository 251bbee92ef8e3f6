"""Row-based window operators over the series of a panel.

All count rows of the series, not calendar days. None needs an entity to fit in
one task (see `series`).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.frames import public_columns
from tidemark.operators.series import (
    BLOCK,
    CORE,
    POS,
    SeriesKey,
    next_of,
    next_pos_of,
    prev_of,
    prev_pos_of,
    quoted,
    scan,
    with_halo,
)
from tidemark.settings import LAGS, MEAN_PAIRS, lag_feature, ratio_feature

TRAIN_RANK = "__train_rank"
TARGETS = "__targets"


def _replaced(df: DataFrame, columns: Sequence[str], values: dict[str, str]) -> DataFrame:
    """`columns` of `df`, some with a new value."""
    return df.selectExpr(*[f"{values[c]} AS {quoted(c)}" if c in values else quoted(c) for c in columns])


def forward_fill(df: DataFrame, columns: Sequence[str], key: SeriesKey = SeriesKey()) -> DataFrame:
    """Fill nulls with the last known value, each column on its own."""
    known = scan(df, key, back=columns)
    return _replaced(known, df.columns, {c: quoted(prev_of(c)) for c in columns})


def interpolated(
    df: DataFrame, columns: Sequence[str], key: SeriesKey = SeriesKey(), lead: Sequence[str] = ()
) -> DataFrame:
    """`interpolate` with the working columns left in, for operators that follow."""
    known = scan(df, key, back=columns, ahead=columns, places=True)

    def line(c: str, pos: str) -> str:
        y0, x0, y1, x1 = (quoted(f(c)) for f in (prev_of, prev_pos_of, next_of, next_pos_of))
        return f"{y0} + ({y1} - {y0}) * ({pos} - {x0}) / ({x1} - {x0})"

    def value(c: str) -> str:
        if c in lead:
            following = f"({POS} + 1)"
            is_known = f"{quoted(next_pos_of(c))} = {following}"
            out = f"CASE WHEN {is_known} THEN {quoted(next_of(c))} ELSE {line(c, following)} END"
        else:
            out = f"coalesce({quoted(c)}, {line(c, POS)})"
        return f"CAST({out} AS DOUBLE)"

    return _replaced(known, known.columns, {c: value(c) for c in columns})


def interpolate(
    df: DataFrame, columns: Sequence[str], key: SeriesKey = SeriesKey(), lead: Sequence[str] = ()
) -> DataFrame:
    """Fill interior nulls linearly by row position; leading and trailing nulls stay.

    Columns in `lead` are then moved up by one row, in the same pass.
    """
    return interpolated(df, columns, key, lead).select(df.columns)


def lead_rows(df: DataFrame, column: str, rows: int = 1, key: SeriesKey = SeriesKey()) -> DataFrame:
    """Replace `column` by its value `rows` rows later."""
    blocks = with_halo(scan(df, key), key, before=max(-rows, 0), after=max(rows, 0))
    moved = {column: f"lead({quoted(column)}, {rows}) OVER ({key.block_window})"}
    return _replaced(blocks, [*df.columns, CORE], moved).where(CORE).drop(CORE)


def _trailing_sums(
    df: DataFrame, column: str, lengths: Iterable[int], key: SeriesKey
) -> tuple[DataFrame, dict[int, str]]:
    """Add the sum of the last n rows for each n, null unless all n values are known.

    A long frame is put together from adjoining shorter ones where their lengths
    divide (168 = 2 x 84, 84 = 3 x 28, ...). A handful of offsets per row then do
    the work of a sliding frame, and only sums are added up, never subtracted.
    """
    names = {1: quoted(column)}
    for n in sorted(set(lengths) - {1}):
        part = max(m for m in names if n % m == 0)
        if n // part <= 12:
            pieces = [f"lag({names[part]}, {i * part}) OVER ({key.block_window})" for i in range(1, n // part)]
            total = " + ".join([names[part], *pieces])
        else:
            frame = f"({key.block_window} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
            total = f"if(count({names[1]}) OVER {frame} = {n}, sum({names[1]}) OVER {frame}, NULL)"
        names[n] = f"__sum_{n}"
        df = df.selectExpr("*", f"{total} AS {names[n]}")
    return df, names


def _mean(names: dict[int, str], rows: int) -> str:
    return f"({names[rows]} / {rows}.0D)"


def rolling_mean(
    df: DataFrame, column: str, lengths: Sequence[int], key: SeriesKey = SeriesKey()
) -> DataFrame:
    """Add `<column>_mean_<n>`: the mean of the last n rows, null unless all n are known."""
    blocks = with_halo(scan(df, key), key, before=max(lengths) - 1)
    summed, names = _trailing_sums(blocks, column, lengths, key)
    means = [f"{_mean(names, n)} AS {quoted(f'{column}_mean_{n}')}" for n in lengths]
    return summed.where(CORE).selectExpr(*map(quoted, df.columns), *means)


def feature_blocks(
    panel: DataFrame,
    key: SeriesKey = SeriesKey(),
    lags: Sequence[int] = LAGS,
    mean_pairs: Sequence[tuple[int, int]] = MEAN_PAIRS,
    level: str = "level",
    reach: str = "reach",
) -> DataFrame:
    """`add_features`, with block and position of each row left in."""
    lengths = {n for pair in mean_pairs for n in pair}
    filled = quoted(prev_of(reach))
    known = scan(panel, key, back=[reach])
    blocks = with_halo(known, key, before=max([0, *lags, *(n - 1 for n in lengths)]))
    summed, names = _trailing_sums(blocks, level, lengths, key)

    ratios = [
        f"{_mean(names, s)} / nullif({_mean(names, l)}, 0.0D) AS {quoted(ratio_feature(s, l, level))}"
        for s, l in mean_pairs
    ]
    changes = [
        f"{filled} / nullif(lag({filled}, {n}) OVER ({key.block_window}), 0) - 1"
        f" AS {quoted(lag_feature(n, reach))}"
        for n in lags
    ]
    kept = map(quoted, panel.columns)
    return summed.selectExpr(*kept, BLOCK, POS, CORE, *ratios, *changes).where(CORE).drop(CORE)


def add_features(
    panel: DataFrame,
    key: SeriesKey = SeriesKey(),
    lags: Sequence[int] = LAGS,
    mean_pairs: Sequence[tuple[int, int]] = MEAN_PAIRS,
    level: str = "level",
    reach: str = "reach",
) -> DataFrame:
    """Add lagged percent changes of `reach` and rolling-mean ratios of `level`.

    Percent change compares forward-filled values n rows apart. A ratio is null
    unless both means are over full windows. A zero denominator gives null.
    """
    return public_columns(feature_blocks(panel, key, lags, mean_pairs, level, reach))


def rank_complete(features: DataFrame, columns: Sequence[str], key: SeriesKey) -> DataFrame:
    """Add the running number, within each block, of the rows that are complete in `columns`."""
    whole = " AND ".join(f"{quoted(c)} IS NOT NULL" for c in columns)
    so_far = f"({key.block_window} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    rank = f"if({whole}, count_if({whole}) OVER {so_far}, NULL)"
    return features.selectExpr("*", f"{rank} AS {TRAIN_RANK}")


def target_of(horizon: int) -> str:
    return f"growth_target_{horizon}"


def growth_of_numbered(
    train: DataFrame, horizons: Sequence[int], key: SeriesKey, level: str = "level"
) -> DataFrame:
    """Rows that are numbered already, with their growth for each horizon in the list TARGETS.

    The list is in ascending order of horizons. A block is brought together with its halo,
    its levels in order of position, and each of its rows looks up the levels it needs by
    position: one shuffle and one pass, however many horizons there are.
    """
    ordered = sorted(horizons)
    blocks = with_halo(train, key, before=max(0, -ordered[0]), after=max(0, ordered[-1]))
    kept = [c for c in train.columns if c not in (key.entity, POS)]
    row, place, value = ", ".join([POS, *map(quoted, kept)]), f"CAST(r.{POS} - __line[0].{POS} + h AS INT)", quoted(level)
    laid = blocks.repartition(key.entity, BLOCK).groupBy(key.entity, BLOCK)
    lists = laid.agg(
        F.expr(f"collect_list(struct({row})) FILTER (WHERE {CORE}) AS __rows"),
        F.expr(f"sort_array(collect_list(struct({POS}, {value}))) AS __line"),
    )
    growth = f"get(__line, {place}).{value} / nullif(r.{value}, 0) - 1"
    targets = f"transform(array({', '.join(map(str, ordered))}), h -> {growth}) AS {TARGETS}"
    fields = ", ".join([*(f"r.{quoted(c)} AS {quoted(c)}" for c in kept), targets])
    rows = lists.selectExpr(quoted(key.entity), f"inline(transform(__rows, r -> struct({fields})))")
    return rows.select(*(F.col(quoted(c)) for c in train.columns if c != POS), TARGETS)


def growth_targets(
    train: DataFrame, horizons: Sequence[int], key: SeriesKey = SeriesKey(), level: str = "level"
) -> DataFrame:
    """Add `growth_target_<h>`: relative growth of `level` over the h rows that follow.

    For h = 0 growth is 0; for h < 0 it is the growth towards |h| rows earlier.
    """
    numbered = scan(train, key).select(*map(quoted, train.columns), POS)
    grown = growth_of_numbered(numbered, horizons, key, level)
    place = {h: i for i, h in enumerate(sorted(horizons))}
    targets = [F.col(TARGETS)[place[h]].alias(target_of(h)) for h in horizons]
    return grown.select(*map(quoted, train.columns), *targets)
