"""Repeated checks merged one by one.

Every check of the answers leaves two mergeable partial states, stored per
check: per answer the sums and counts of its times, and per task the counts of
its error types. A new check is folded into the states without reading the
verdict rows of earlier ones, and writing a check again replaces that check
alone. Texts are in a :class:`~pairforge.operators.texts.TextStore`; states hold
digests.

Layout below the state folder: ``answers/check_id=...``, ``types/check_id=...``
and ``texts``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairforge.operators.merge import CHECK_KEYS, TASK
from pairforge.operators.texts import TextStore
from pairforge.session import replace_partitions

TIMES = ("avg_time", "std_time")


def answer_state(runs: DataFrame) -> DataFrame:
    """Partial state per answer and check: sums and counts of its times. Rows lacking a key are left out, as in ``average_checks``."""
    sums = [x for t in TIMES for x in (F.sum(t).alias(f"{t}_sum"), F.count(t).alias(f"{t}_n"))]
    keep = [F.max("answer_chars").alias("answer_chars")] if "answer_chars" in runs.columns else []
    return runs.dropna(subset=CHECK_KEYS).groupBy("check_id", *CHECK_KEYS).agg(*keep, *sums)


def type_state(runs: DataFrame) -> DataFrame:
    """Partial state per task, error type and check: its rows."""
    return runs.where("error_type is not null").groupBy("check_id", *TASK, "error_type").agg(F.count(F.lit(1)).alias("n"))


def add_check(runs: DataFrame, path: str) -> None:
    """Stores the states of the check (or checks) in ``runs``, replacing what they had stored before."""
    path = path.rstrip("/")
    slim = TextStore(runs.sparkSession, f"{path}/texts").add(runs)
    replace_partitions(answer_state(slim), "check_id").parquet(f"{path}/answers")
    replace_partitions(type_state(slim), "check_id").parquet(f"{path}/types")


def averaged_checks(spark: SparkSession, path: str, with_texts: bool = True) -> DataFrame:
    """``average_checks`` over all stored checks, from the states (mean = sum of sums / sum of counts; null without a time)."""
    state = spark.read.parquet(f"{path.rstrip('/')}/answers")
    keep = [F.max("answer_chars").alias("answer_chars")] if "answer_chars" in state.columns else []
    out = state.groupBy(*CHECK_KEYS).agg(*keep, *[
        (F.sum(f"{t}_sum") / F.nullif(F.sum(f"{t}_n"), F.lit(0))).alias(t) for t in TIMES])
    return TextStore(spark, f"{path.rstrip('/')}/texts").resolve(out) if with_texts else out


def checked_frequency(spark: SparkSession, path: str) -> DataFrame:
    """``error_frequency`` over all stored checks, from the states."""
    per_type = spark.read.parquet(f"{path.rstrip('/')}/types").groupBy(*TASK, "error_type").agg(F.sum("n").alias("_n"))
    # Rows per task here = distinct error types of the task (small).
    return per_type.withColumn("frequency", F.col("_n") / F.sum("_n").over(Window.partitionBy(*TASK))).drop("_n")
