"""Ordered computations that stay parallel when one group holds a large share of the rows.

A window ``PARTITION BY g ORDER BY o`` puts each group in one task, so a group holding a
third of the data becomes a third of the job in a single task. ``running_sum`` instead
range-partitions the rows on the group and the *whole* order key, at boundaries that Spark
takes from the data, into pieces of about ``rows_per_piece`` rows:

1. the sorted pieces are written to a checkpoint, which fixes the partitioning: a retried
   task can't move a row to another piece;
2. running sums inside each (piece, group), a window over a bounded partition;
3. sums per (piece, group), and per group their running offsets over the pieces (one row
   per piece);
4. result = offset of the piece + local running sum.

Only rows that agree in the whole order key can't be separated, and the order must be total
(ties broken by a key). Inputs of at most one piece are bounded, so they use a plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutique.functions.ids import format_id, id_number
from boutique.session import materialize

_PLACE, _PIECE = "_place", "_piece"
ROWS_PER_PIECE_CONF = "boutique.rowsPerPiece"
DEFAULT_ROWS_PER_PIECE = 1_000_000


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rows_per_piece(df: DataFrame, given: int | None = None) -> int:
    if given:
        return int(given)
    return int(df.sparkSession.conf.get(ROWS_PER_PIECE_CONF, str(DEFAULT_ROWS_PER_PIECE)))


def with_pieces(df: DataFrame, keys: Sequence[str | Column], rows: int, per_piece: int) -> DataFrame:
    """Rows with ``_piece`` and ``_place``, both ascending along ``keys``; materialized."""
    cols = [_col(k) for k in keys]
    pieces = max(1, -(-rows // per_piece))
    placed = df.repartitionByRange(pieces, *cols).sortWithinPartitions(*cols).withColumn(
        _PLACE, F.monotonically_increasing_id())
    # The upper bits of the id are the number of the partition.
    return materialize(placed).withColumn(_PIECE, F.shiftright(_PLACE, 33))


def running_sum(
    df: DataFrame,
    values: dict[str, str | Column],
    order_by: Sequence[str | Column],
    partition_by: Sequence[str] = (),
    inclusive: bool = True,
    per_piece: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Add one running-sum column per ``values`` entry (name -> value expression).

    ``order_by`` must be a total order inside each group. Group keys must not be null (groups
    are matched to their piece offsets by equality). ``inclusive=False`` gives the sum of the
    rows strictly before each row. ``rows``: the number of rows, where the caller knows it and
    has materialized ``df``; otherwise both are done here.
    """
    order = [_col(c) for c in order_by]
    vals = {f"_v_{k}": _col(v) for k, v in values.items()}
    per_piece = rows_per_piece(df, per_piece)
    d = df.withColumns(vals)
    if rows is None:
        d = materialize(d)
        rows = d.count()
    frame = (Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    if rows <= per_piece:
        w = Window.partitionBy(*partition_by).orderBy(*order).rowsBetween(*frame)
        return d.withColumns({k: F.coalesce(F.sum(f"_v_{k}").over(w), F.lit(0)) for k in values}).drop(*vals)
    d = with_pieces(d, [*partition_by, *order], rows, per_piece)
    w_local = Window.partitionBy(*partition_by, _PIECE).orderBy(_PLACE).rowsBetween(*frame)
    local = d.withColumns(
        {f"_l_{k}": F.coalesce(F.sum(f"_v_{k}").over(w_local), F.lit(0)) for k in values}
    )
    totals = d.groupBy(*partition_by, _PIECE).agg(
        *[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in values]
    )
    w_off = Window.partitionBy(*partition_by).orderBy(_PIECE).rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = totals.select(
        *partition_by, _PIECE,
        *[F.coalesce(F.sum(f"_t_{k}").over(w_off), F.lit(0)).alias(f"_o_{k}") for k in values],
    )
    out = local.join(offsets, [*partition_by, _PIECE], "inner")
    out = out.withColumns({k: F.col(f"_o_{k}") + F.col(f"_l_{k}") for k in values})
    drop = [_PIECE, _PLACE] + [f"_{p}_{k}" for k in values for p in ("v", "l", "o")]
    return out.drop(*drop)


def row_numbers(
    df: DataFrame, out: str, order_by: Sequence[str | Column], partition_by: Sequence[str] = (),
    per_piece: int | None = None, rows: int | None = None,
) -> DataFrame:
    """1-based row number per group in a total order, without a one-task-per-group window."""
    r = running_sum(df, {out: F.lit(1)}, order_by, partition_by, True, per_piece, rows)
    return r.withColumn(out, F.col(out).cast("bigint"))


def max_id_number(existing: DataFrame, column: str, prefix: str) -> Column:
    """Largest numeric suffix of the existing ids (0 when none), as a scalar subquery."""
    return F.coalesce(
        existing.select(F.max(id_number(column, prefix))).scalar(), F.lit(0).cast("bigint")
    )


def assign_ids(
    new_rows: DataFrame,
    existing: DataFrame,
    column: str,
    prefix: str,
    width: int,
    order_by: Sequence[str | Column],
    per_piece: int | None = None,
) -> DataFrame:
    """Give ``new_rows`` ids ``prefix + (max existing + 1 ..)`` in ``order_by`` order.

    The numbered rows are materialized (reliable checkpoint): later steps read them more
    than once, and ids must not be recomputed after they have been handed out.
    """
    base = max_id_number(existing, column, prefix)
    numbered = row_numbers(new_rows, "_seq", order_by, (), per_piece)
    return materialize(
        numbered.withColumn(column, format_id(prefix, width, base + F.col("_seq"))).drop("_seq"))
