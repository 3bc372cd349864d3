"""Counter-based random draws.

A draw is a pure function of (seed, keys): the first 32 bits of
``md5('seed|key1|key2|...')`` scaled to [0, 1). It gives the same value
under any partitioning, on any retry, and in any engine with md5.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def unit_draw(seed, *keys) -> Column:
    """Uniform double in [0, 1) keyed by seed and key columns/literals."""
    parts = [F.lit(str(seed))] + [k if isinstance(k, Column) else F.lit(str(k)) for k in keys]
    h = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(TWO_POW_32)


def index_draw(n, seed, *keys) -> Column:
    """Uniform integer in [0, n) (NULL when n is 0 or NULL)."""
    n = F.col(n) if isinstance(n, str) else n
    return F.when(n > 0, F.floor(unit_draw(seed, *keys) * n).cast("long"))


def sql_unit_draw(seed, *key_sql: str) -> str:
    """DuckDB twin of :func:`unit_draw` (keys given as SQL expressions)."""
    parts = [f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in key_sql]
    return (f"(CAST(CAST(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8)) AS BIGINT) AS DOUBLE)"
            f" / CAST({TWO_POW_32} AS DOUBLE))")
