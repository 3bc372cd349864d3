"""Run metrics: attempts, pass@k, pass-only averages, error counts.

All are partial-aggregated ``groupBy`` jobs: a hot task is combined
map-side before the shuffle, so no task ever holds a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_pass(output="output") -> Column:
    return F.col(output) == F.lit("passed")


def attempts_and_correct(runs: DataFrame, keys=("split", "task_id")) -> DataFrame:
    """Per task: n attempts and c passing attempts."""
    return (runs.groupBy(*keys)
                .agg(F.count(F.lit(1)).alias("n"), F.count_if(is_pass()).alias("c")))


def pass_at_k_expr(n="n", c="c", k="k") -> Column:
    """Unbiased pass@k of one task: 1 - C(n-c, k) / C(n, k).

    1 when n - c < k; 0 when c = 0 (Spark's ``sequence`` would count
    downwards there). Otherwise the ratio is a product of min(c, k) terms:
    prod_{i=n-c+1..n} (1 - k/i) (the reference's form) when c <= k, else the
    equal prod_{j=0..k-1} (n-c-j)/(n-j). Work per task is bounded by k, not
    by the number of attempts.
    """
    n, c, k = (F.col(x) if isinstance(x, str) else x for x in (n, c, k))
    one = F.lit(1.0)
    by_correct = F.aggregate(F.sequence(n - c + 1, n), one, lambda acc, i: acc * (one - k / i))
    by_k = F.aggregate(F.sequence(F.lit(0).cast("long"), (k - 1).cast("long")), one,
                       lambda acc, j: acc * ((n - c - j) / (n - j)))
    return (F.when(n - c < k, one)
             .when(c == 0, F.lit(0.0))
             .when(c <= k, one - by_correct)
             .otherwise(one - by_k))


def pass_at_k(attempts: DataFrame, ks=(1, 5, 10), by=("split",), guarded: bool = True) -> DataFrame:
    """Mean pass@k over tasks for each k.

    ``guarded`` keeps only the k for which every task of the group has
    n >= k (the evaluation rule); unguarded reports every k (training rule).
    """
    ks_col = F.array(*[F.lit(int(k)) for k in ks])
    per_task = attempts.select(*by, "n", "c", F.explode(ks_col).alias("k"))
    out = (per_task.withColumn("p", pass_at_k_expr())
                   .groupBy(*by, "k")
                   .agg(F.avg("p").alias("pass_at_k"), F.min("n").alias("min_n")))
    if guarded:
        out = out.filter(F.col("min_n") >= F.col("k"))
    return out.drop("min_n")


def pass_time_and_length(runs: DataFrame, by=("split",)) -> DataFrame:
    """Average answer length and average time over passing runs only."""
    p = is_pass()
    return (runs.groupBy(*by)
                .agg(F.avg(F.when(p, F.col("answer_length"))).alias("avg_answer_length"),
                     F.avg(F.when(p, F.col("avg_time"))).alias("avg_time")))


def error_counts(runs: DataFrame, by=("split",)) -> DataFrame:
    """Count per error type ('' = pass included), long form, most frequent first."""
    return (runs.groupBy(*by, "error_type").agg(F.count(F.lit(1)).alias("n"))
                .orderBy(*by, F.desc("n"), "error_type"))


def ordered_error_counts(runs: DataFrame, by=("split",)) -> DataFrame:
    """Error counts with their ``position`` in descending order of the count
    (ties by name); one row per error type, so a group's window is small."""
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "error_type")
    return error_counts(runs).withColumn("position", (F.row_number().over(w) - 1).cast("long"))


def metrics_long(runs: DataFrame, ks=(1, 5, 10), by=("split",)) -> DataFrame:
    """The per-split metrics record in long form (metric, value):
    guarded ``pass@k`` for each k, ``avg_answer_length``, ``avg_time`` and
    ``error_count:<type>`` (a long table instead of a map keyed by data)."""
    pk = (pass_at_k(attempts_and_correct(runs, (*by, "task_id")), ks, by=by, guarded=True)
          .select(*by, F.concat(F.lit("pass@"), F.col("k").cast("string")).alias("metric"),
                  F.col("pass_at_k").alias("value")))
    avgs = pass_time_and_length(runs, by).select(
        *by, F.explode(F.array(F.struct(F.lit("avg_answer_length").alias("metric"),
                                        F.col("avg_answer_length").alias("value")),
                               F.struct(F.lit("avg_time").alias("metric"), F.col("avg_time").alias("value"))
                               )).alias("m")).select(*by, "m.metric", "m.value")
    errs = (runs.groupBy(*by, "error_type").agg(F.count(F.lit(1)).cast("double").alias("value"))
                .select(*by, F.concat(F.lit("error_count:"), F.col("error_type")).alias("metric"), "value"))
    return pk.unionByName(avgs).unionByName(errs)
