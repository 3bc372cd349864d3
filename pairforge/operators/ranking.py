"""Positions inside groups without letting one group land in one task.

``group_rank`` numbers the rows of each group 0, 1, 2, ... in a total
order. A plain ``row_number().over(partitionBy(group))`` sends a whole
group to one task. Here the caller also names *blocks*: leading columns of
the order, or monotone steps of them, so that one block of one group stays
small (for example ``steps("pos", 65536)``). Rows are numbered per (group,
block), and the blocks' row counts, partially aggregated, give each block's
offset. A block goes by one struct, which holds nulls and equals its like, led
by its 64-bit hash: rows are then shuffled and sorted once, for the numbering
and for the join with the offsets, and mostly compared by the hash. The same
plan holds at every size, nothing is written or sampled, and positions depend
on the rows alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 65_536


def steps(column: str, width: int = BLOCK_ROWS) -> Column:
    """Blocks of ``width`` consecutive integers; with distinct values a block has at most that many rows."""
    return F.floor(F.col(column) / F.lit(width)).cast("long")


def _order(columns) -> list[Column]:
    """Sort expressions from names or (name, ascending) pairs."""
    pairs = [(c, True) if isinstance(c, str) else c for c in columns]
    return [F.col(n).asc_nulls_first() if up else F.col(n).desc_nulls_last() for n, up in pairs]


def group_rank(df: DataFrame, group_cols: list[str], order_cols: list, name: str = "rank", blocks: list | None = None) -> DataFrame:
    """Add ``name`` = 0-based position of each row inside its group.

    ``order_cols`` are names or (name, ascending) pairs and make the order
    total inside a group. ``blocks`` are columns or (column, ascending)
    pairs that never decrease along that order; without them a group is one
    block, which is right for groups of a small proven size only.
    """
    if not blocks:
        w = Window.partitionBy(*group_cols).orderBy(*_order(order_cols))
        return df.withColumn(name, (F.row_number().over(w) - 1).cast("long"))
    pairs = [b if isinstance(b, tuple) else (b, True) for b in blocks]
    names = [f"_pf_b{i}" for i in range(len(pairs))]
    keys = [*group_cols, *names]
    block = {"_pf_h": F.xxhash64(*keys), "_pf_block": F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])}
    cut = df.withColumns(dict(zip(names, [c for c, _ in pairs])))
    sizes = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("_pf_n"))
    before = (Window.partitionBy(*group_cols).orderBy(*_order([(n, up) for n, (_, up) in zip(names, pairs)]))
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*[c.alias(n) for n, c in block.items()], F.coalesce(F.sum("_pf_n").over(before), F.lit(0)).alias("_pf_off"))
    w = Window.partitionBy(*block).orderBy(*_order(order_cols))
    return (cut.withColumns(block).drop(*names).withColumn("_pf_r", F.row_number().over(w) - 1).join(offsets, [*block])
               .withColumn(name, (F.col("_pf_r") + F.col("_pf_off")).cast("long"))
               .drop("_pf_r", "_pf_off", *block))
