"""Connected components of a table of edges (large-star and small-star rounds)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.session import materialize

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round on (a, b) rows with a > b: each node hangs its larger (or smaller) neighbours under the smallest."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        joined = edges.join(low, "a")
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the (long a, long b) rows: root is the smallest node it is connected with.

    Rounds are written to the shared scratch folder; only their counts reach the driver.
    """
    state = materialize(edges.where("a is not null and b is not null and a != b")
                        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    sign = None
    for _ in range(MAX_ROUNDS):
        state = materialize(_star(state, True), "cc")
        state = materialize(_star(state, False), "cc")  # each star reads its input twice: in one plan the first would stand there twice
        now = state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == sign:
            break
        sign = now
    else:
        raise RuntimeError("components did not settle")
    roots = state.select("b").distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))
