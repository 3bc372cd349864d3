"""Samples -> verdict rows: ids, problem join, sampling plan, verdict rules,
stable timing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.functions.text import SYSTEM_PROMPT, add_system_prompt, strip_text
from pairforge.operators.ranking import group_rank, steps

ROUND_KEY_OFFSET = 1 << 40


def answer_ids(samples: DataFrame, task: str = "task_id", pos: str = "pos",
               extra_group=()) -> DataFrame:
    """answer_id = 0-based running counter per task in sample order (``pos``)."""
    return group_rank(samples, [*extra_group, task], [pos], name="answer_id", blocks=[steps(pos)])


def align_key_type(df: DataFrame, like: DataFrame, key: str = "task_id") -> DataFrame:
    """``df`` with ``key`` in the type it has in ``like``, so that ids read as
    numbers on one side and as text on the other join."""
    return df.withColumn(key, F.col(key).cast(like.schema[key].dataType))


def join_problems(samples: DataFrame, problems: DataFrame, key: str = "task_id") -> DataFrame:
    """Samples with their problem (inner equi-join; unknown ids are reported
    by ``orphan_samples``). The join strategy is left to AQE, which
    broadcasts the problems side only when its measured size is small."""
    return samples.join(problems, key, "inner")


def orphan_samples(samples: DataFrame, problems: DataFrame, key: str = "task_id") -> DataFrame:
    """Samples whose task id is missing from the problems table, counted per id."""
    return (samples.join(problems.select(key), key, "left_anti")
                   .groupBy(key).agg(F.count(F.lit(1)).alias("n_samples")))


def sampling_plan(problems: DataFrame, n_iter: int = 1, n_seq: int | None = 10,
                  template: str = SYSTEM_PROMPT, eval_ks=None) -> DataFrame:
    """One request row per problem x iteration x sequence with the formatted prompt.

    With ``eval_ks`` (evaluation mode) the number of sequences per problem
    is the last k of the list, so lists ascend for every pass@k to be estimated.
    """
    if eval_ks:
        n_seq = int(list(eval_ks)[-1])
    it = F.sequence(F.lit(0).cast("long"), F.lit(n_iter - 1).cast("long"))
    sq = F.sequence(F.lit(0).cast("long"), F.lit(n_seq - 1).cast("long"))
    return (problems.select("task_id", add_system_prompt(strip_text("prompt"), template).alias("request"))
                    .withColumn("iter", F.explode(it))
                    .withColumn("seq", F.explode(sq)))


def fill_unknown(candidates: DataFrame, verdicts: DataFrame, keys=("task_id", "answer_id")) -> DataFrame:
    """Every candidate gets a verdict; one without a result is
    ('failed', no times, 'UnknownError')."""
    v = verdicts.select(*keys, "output", "avg_time", "std_time", "error_type", "error_trace")
    j = candidates.join(v, list(keys), "left")
    missing = F.col("output").isNull()
    return (j.withColumn("error_type", F.when(missing, F.lit("UnknownError")).otherwise(F.col("error_type")))
             .withColumn("output", F.when(missing, F.lit("failed")).otherwise(F.col("output"))))


def timeout_verdict(runs: DataFrame, limit: float, time_col: str = "avg_time") -> DataFrame:
    """A passing run slower than ``limit`` becomes ('failed', 'TimeoutError')
    with its times cleared."""
    slow_now = (F.col("output") == "passed") & (F.col(time_col) > F.lit(float(limit)))
    slow = F.coalesce(F.col("_pf_slow"), F.lit(False))
    return (runs.withColumn("_pf_slow", slow_now)
                .withColumn("error_type", F.when(slow, F.lit("TimeoutError")).otherwise(F.col("error_type")))
                .withColumn("std_time", F.when(slow, F.lit(None).cast("double")).otherwise(F.col("std_time")))
                .withColumn(time_col, F.when(slow, F.lit(None).cast("double")).otherwise(F.col(time_col)))
                .withColumn("output", F.when(slow, F.lit("failed")).otherwise(F.col("output")))
                .drop("_pf_slow"))


def stdio_verdict(cases: DataFrame, keys=("task_id", "answer_id"), pos: str = "case",
                  got: str = "got", want: str = "want") -> DataFrame:
    """Per candidate: passed iff every captured output equals the expected
    one (exact compare); otherwise AssertionError at the first mismatching case.

    Cases are rows (one per stdin/stdout pair), so a candidate with many
    cases is aggregated map-side rather than held as one array."""
    mismatch = ~F.col(got).eqNullSafe(F.col(want))
    agg = cases.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cases"),
                                   F.min(F.when(mismatch, F.col(pos))).alias("first_failed_case"))
    ok = F.col("first_failed_case").isNull()
    return (agg.withColumn("output", F.when(ok, "passed").otherwise("failed"))
               .withColumn("error_type", F.when(ok, F.lit("")).otherwise(F.lit("AssertionError"))))


def stdio_verdict_arrays(df: DataFrame, got: str = "got", want: str = "want") -> DataFrame:
    """Array form (problem carries ``stdio`` cases inline): all pairs equal."""
    same = F.forall(F.arrays_zip(F.col(got).alias("g"), F.col(want).alias("w")),
                    lambda x: x["g"].eqNullSafe(x["w"]))
    ok = same & (F.size(got) == F.size(want))
    return (df.withColumn("output", F.when(ok, "passed").otherwise("failed"))
              .withColumn("error_type", F.when(ok, F.lit("")).otherwise(F.lit("AssertionError"))))


def stable_timing(timings: DataFrame, candidate: str = "candidate", round_col: str = "round",
                  value: str = "ns", limit: float = 0.1) -> DataFrame:
    """Per candidate: mean and population std of each timing round; keep the
    first round whose std/mean <= ``limit``, else the last round."""
    per_round = (timings.groupBy(candidate, round_col)
                        .agg(F.avg(value).alias("avg_time"), F.stddev_pop(value).alias("std_time")))
    per_round = per_round.withColumn("cov", F.try_divide(F.col("std_time"), F.col("avg_time")))
    stable = F.coalesce(F.col("cov") <= F.lit(float(limit)), F.lit(False))
    # First stable round sorts before every unstable one; among unstable
    # rounds the last one sorts first.
    key = F.when(stable, F.col(round_col)).otherwise(F.lit(ROUND_KEY_OFFSET) - F.col(round_col))
    pick = F.struct(F.col(round_col).alias("round"), "avg_time", "std_time", "cov", stable.alias("stable"))
    return (per_round.groupBy(candidate)
                     .agg(F.min_by(pick, key).alias("p"), F.count(F.lit(1)).alias("n_rounds"))
                     .select(candidate, "p.round", "p.avg_time", "p.std_time", "p.cov", "p.stable", "n_rounds"))
