"""Ordered operations on one entity's rows, without one task per entity.

A window over a whole entity puts that entity into one task, however many rows
it has. Two steps avoid it; both keep the row-based meaning of lags and frames.

`scan` cuts each series into calendar chunks. Rows are shuffled by (entity,
chunk), one small summary row per chunk is made (row count, first and last known
values), the summaries are summed up along the entity, and the result is joined
back. That gives every row its position in the whole series and the nearest
known values on either side of it, wherever those lie.

`with_halo` cuts the series by position into blocks of equal row count and
copies the rows next to a cut into the neighbouring block, so that a window over
(entity, block) sees all it needs for frames and offsets up to the given reach.

A day occurs once per entity (`precedence_merge` enforces it), so a chunk holds
at most `chunk_days` rows and a block `block_rows` plus its halo, also where one
entity holds a third of all rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = "__chunk"
BLOCK = "__block"
CORE = "__core"
POS = "__pos"
_RANK, _ROWS, _OFFSET, _OTHERS = "__rank", "__rows", "__offset", "__others"


def quoted(name: str) -> str:
    return f"`{name}`"


@dataclass(frozen=True)
class SeriesKey:
    """What identifies and orders a series, and how finely long ones are cut.

    Blocks of 3,840 rows and their 168-row halo fit in a window's in-memory
    buffer of 4,096 rows; the halo copies 4 % of the rows of long series.
    """

    entity: str = "entity"
    order: str = "date"
    chunk_days: int = 1024
    block_rows: int = 3840

    @property
    def chunk(self) -> str:
        return f"CAST(floor(unix_date({quoted(self.order)}) / {self.chunk_days}) AS INT)"

    @property
    def block_window(self) -> str:
        """Inner part of an OVER clause: one block in order of position."""
        return f"PARTITION BY {quoted(self.entity)}, {BLOCK} ORDER BY {POS}"


def with_chunk(df: DataFrame, key: SeriesKey) -> DataFrame:
    """Add the chunk of each row. Rows without an entity or a day are in no series and left out."""
    if CHUNK in df.columns:
        return df
    placed = df.selectExpr("*", f"{key.chunk} AS {CHUNK}")
    return placed.where(f"{quoted(key.entity)} IS NOT NULL AND {CHUNK} IS NOT NULL")


def chunked(df: DataFrame, key: SeriesKey) -> DataFrame:
    """`df` shuffled by (entity, chunk), unless it already is."""
    return df if CHUNK in df.columns else with_chunk(df, key).repartition(key.entity, CHUNK)


def prev_of(column: str) -> str:
    return f"__{column}_prev"


def prev_pos_of(column: str) -> str:
    return f"__{column}_prev_pos"


def next_of(column: str) -> str:
    return f"__{column}_next"


def next_pos_of(column: str) -> str:
    return f"__{column}_next_pos"


def scan(
    df: DataFrame,
    key: SeriesKey,
    back: Sequence[str] = (),
    ahead: Sequence[str] = (),
    places: bool = False,
) -> DataFrame:
    """Add each row's position (from 1), and the nearest known values around it.

    For a column in `back`: its last non-null value at or before the row. In
    `ahead`: its first non-null value after the row. With `places`, also the
    positions of these values; the summaries then need the rows in order.

    `df` is read and shuffled once: rows and summaries come from the same shuffle, which
    Spark finds again where both use the same columns. So summaries use all of them.
    """
    entity, order = quoted(key.entity), quoted(key.order)
    rising = f"PARTITION BY {entity}, {CHUNK} ORDER BY {order}"
    falling = f"PARTITION BY {entity}, {CHUNK} ORDER BY {order} DESC"
    earlier = f"PARTITION BY {entity} ORDER BY {CHUNK} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    later = f"PARTITION BY {entity} ORDER BY {CHUNK} DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

    # These lists grow together: what a chunk's summary holds, what is carried
    # along the series, and what each row makes of that and its own chunk.
    in_chunk = [f"count(*) AS {_ROWS}"]
    carried = [entity, CHUNK, _OFFSET]
    around = []

    def look(c: str, value: str, place: str, pick: str, end: str, chunks: str, rows: str) -> None:
        column, known = quoted(c), f"{quoted(c)} IS NOT NULL"
        in_chunk.append(f"{pick}({column}, {order}) FILTER (WHERE {known}) AS {quoted(value)}")
        carried.append(f"last({quoted(value)}, true) OVER ({chunks}) AS {quoted(value + '_in')}")
        around.append(f"coalesce(last({column}, true) OVER ({rows}), {quoted(value + '_in')}) AS {quoted(value)}")
        if places:
            in_chunk.append(f"{end}({_RANK}) FILTER (WHERE {known}) AS {quoted(place)}")
            carried.append(f"{end}({_OFFSET} + {quoted(place)}) OVER ({chunks}) AS {quoted(place + '_in')}")
            here = f"{end}(if({known}, {POS}, NULL)) OVER ({rows})"
            around.append(f"coalesce({here}, {quoted(place + '_in')}) AS {quoted(place)}")

    for c in back:
        so_far = f"{rising} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
        look(c, prev_of(c), prev_pos_of(c), "max_by", "max", earlier, so_far)
    for c in ahead:
        # A descending frame: one that grows towards the end would be quadratic.
        to_come = f"{falling} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
        look(c, next_of(c), next_pos_of(c), "min_by", "min", later, to_come)

    others = [quoted(c) for c in df.columns if c not in (key.entity, CHUNK, *back, *ahead)]
    in_chunk.append(f"bit_xor(hash({', '.join(others)})) AS {_OTHERS}")
    # Nothing, as a chunk has rows, but the optimizer cannot tell and keeps the columns.
    nothing = f"if({_OTHERS} IS NULL, 1, 0)"

    laid = chunked(df, key)
    ranked = laid.selectExpr("*", f"row_number() OVER ({rising}) AS {_RANK}")
    # One row per chunk: a few rows for each entity.
    chunks = (
        (ranked if places else laid)
        .groupBy(key.entity, CHUNK)
        .agg(*map(F.expr, in_chunk))
        .selectExpr("*", f"coalesce(sum({_ROWS}) OVER ({earlier}), 0) + {nothing} AS {_OFFSET}")
        .selectExpr(*carried)
    )
    # A left join: the rows stay where they are, only summaries may be moved.
    rows = ranked.join(chunks, [key.entity, CHUNK], "left").selectExpr("*", f"{_OFFSET} + {_RANK} AS {POS}")
    kept = [quoted(c) for c in df.columns if c != CHUNK]
    return rows.selectExpr(*kept, CHUNK, POS, *around)


def part_offsets(df: DataFrame, key: SeriesKey, part: str, rank: str) -> DataFrame:
    """Rows ahead of each part but the first of a series, from ranks that count from 1 in a part.

    `part` ascends along the series. A series of one part adds no row.
    """
    earlier = f"PARTITION BY {quoted(key.entity)} ORDER BY {part} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    sizes = df.groupBy(key.entity, part).agg(F.max(rank).alias(_ROWS))
    return sizes.selectExpr(
        quoted(key.entity), part, f"sum({_ROWS}) OVER ({earlier}) AS {_OFFSET}"
    ).where(f"{_OFFSET} IS NOT NULL")


def number_rows(df: DataFrame, offsets: DataFrame, key: SeriesKey, part: str, rank: str) -> DataFrame:
    """Add positions from ranks within parts and the `part_offsets`."""
    placed = df.join(offsets, [key.entity, part], "left")
    return placed.selectExpr("*", f"coalesce({_OFFSET}, 0) + {rank} AS {POS}").drop(_OFFSET)


def with_halo(df: DataFrame, key: SeriesKey, before: int = 0, after: int = 0) -> DataFrame:
    """Assign rows (numbered by `scan`) to blocks, with copies for the neighbours.

    Each block then also holds the `before` rows ahead of it and the `after` rows
    behind it; `__core` is false on such copies. Filter on it after the windows.
    """

    def block_of(position: str) -> str:
        return f"CAST(floor(({position} - 1) / {key.block_rows}) AS INT)"

    first = f"greatest({block_of(f'{POS} - {after}')}, 0)"
    copies = f"explode(sequence({first}, {block_of(f'{POS} + {before}')})) AS {BLOCK}"
    return df.selectExpr("*", copies).selectExpr("*", f"{BLOCK} = {block_of(POS)} AS {CORE}")
