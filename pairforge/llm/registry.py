"""Registry of the training-data queries and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``, with oracle SQL where SQL can express it."""
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark, sf_dir: str, name: str):
    """A test-data table by Spark's reader (the path may be in any store Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_names(df):
    """``df`` with columns ``c0``, ``c1``, ... and a map from its own names to those, so that no name of its can
    clash with a column an operator adds on the way."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def own_names(df, names: dict, *added: str):
    """The columns of ``names`` under their own names again, and the ``added`` ones."""
    return df.select(*[F.col(p).alias(c) for c, p in names.items()], *added)
