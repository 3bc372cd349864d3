"""Verdicts from a user verifier, run inside Spark tasks.

The verifier is a plain Python callable taking one candidate row (a dict)
and raising on failure. It runs in Arrow batches through ``mapInPandas``;
an exception becomes the verdict (class name -> error_type, traceback ->
error_trace) and never fails the job. Execution sandboxing of untrusted
programs is out of scope: the verifier decides what "run" means.
"""

from __future__ import annotations

import math
import time
import traceback

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERDICT_FIELDS = [
    T.StructField("output", T.StringType()),
    T.StructField("error_type", T.StringType()),
    T.StructField("error_trace", T.StringType()),
    T.StructField("avg_time", T.DoubleType()),
    T.StructField("std_time", T.DoubleType()),
    T.StructField("n_rounds", T.LongType()),
]
# Seconds a passing candidate may take in evaluation and in
# training, rounds and repetitions of timing, and the share of the mean its
# deviation may have.
EVAL_TIME_LIMIT = 1.0
TRAIN_TIME_LIMIT = 3.0
MAX_ROUNDS = 100
REPETITIONS = 10
STABLE_COV = 0.1
# Rounds a candidate may take before the unstable ones are dealt out anew.
ROUNDS_PER_PASS = 10


def timed_rounds(call, rounds: int, reps: int, cov: float) -> tuple[float, float, int]:
    """Mean and population deviation (ns) of the first round of ``reps`` calls whose
    deviation is at most ``cov`` of the mean, else of the last round; rounds taken."""
    mean = std = 0.0
    for n in range(1, rounds + 1):
        spent = []
        for _ in range(reps):
            t0 = time.process_time_ns()
            got = call()
            # A verifier that measures itself returns nanoseconds.
            spent.append(float(got) if isinstance(got, (int, float)) and not isinstance(got, bool)
                         else float(time.process_time_ns() - t0))
        mean = math.fsum(spent) / reps
        std = math.sqrt(math.fsum([(x - mean) ** 2 for x in spent]) / reps)
        if mean > 0 and std <= cov * mean:
            break
    return mean, std, n


def annotate(candidates: DataFrame, verifier, time_limit: float | None = EVAL_TIME_LIMIT,
             spread_keys=("task_id", "answer_id"), num_partitions: int | None = None,
             hard_limit: float | None = None, rounds: int = 1, reps: int = 1, cov: float = STABLE_COV) -> DataFrame:
    """Add output, error_type, error_trace, avg_time, std_time (ns) and n_rounds to every candidate.

    The verifier is called in up to ``rounds`` rounds of ``reps`` calls until
    the timing of a round is stable (``timed_rounds``), or until it raises. Times
    are NULL for failures, and ``std_time`` too where one call was timed. A
    pass whose mean exceeds ``time_limit`` seconds is a TimeoutError. With
    ``hard_limit`` (wall-clock seconds for a candidate) a verifier still
    running is interrupted and the candidate, which has no result, is an
    UnknownError; where the worker cannot be interrupted the job fails.

    Rows are hash-spread on ``spread_keys`` first so verification work is
    balanced even when one task has most candidates.
    """
    from pairforge.session import ship_package
    ship_package(candidates.sparkSession)
    schema = T.StructType(list(candidates.schema.fields) + VERDICT_FIELDS)
    cols = candidates.columns

    def verdict(rec, signal):
        class Interrupted(BaseException):
            pass

        def alarm(signum, frame):
            raise Interrupted

        if hard_limit:
            signal.signal(signal.SIGALRM, alarm)
            signal.setitimer(signal.ITIMER_REAL, hard_limit)
        try:
            mean, std, n = timed_rounds(lambda: verifier(rec), rounds, reps, cov)
            if time_limit is not None and mean > time_limit * 1e9:
                return "failed", "TimeoutError", None, None, None, n
            return "passed", "", None, mean, std if reps > 1 else None, n
        except Interrupted:
            return "failed", "UnknownError", None, None, None, 0
        except BaseException as e:  # noqa: BLE001 - every failure is a verdict
            return "failed", type(e).__name__, traceback.format_exc(), None, None, 0
        finally:
            if hard_limit:
                signal.setitimer(signal.ITIMER_REAL, 0)

    def run(batches):
        import signal
        import threading
        if hard_limit and threading.current_thread() is not threading.main_thread():
            raise RuntimeError("hard_limit needs the worker's main thread")
        for pdf in batches:
            got = [verdict(rec, signal) for rec in pdf[cols].to_dict("records")]
            yield pdf.assign(**{f.name: [g[i] for g in got] for i, f in enumerate(VERDICT_FIELDS)})

    df = candidates
    if spread_keys:
        n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartition(n, *[F.col(k) for k in spread_keys])
    return df.mapInPandas(run, schema)


def annotate_frontier(candidates: DataFrame, verifier, time_limit: float | None = EVAL_TIME_LIMIT,
                      spread_keys=("task_id", "answer_id"), num_partitions: int | None = None,
                      hard_limit: float | None = None, rounds: int = MAX_ROUNDS, reps: int = REPETITIONS,
                      cov: float = STABLE_COV, rounds_per_pass: int = ROUNDS_PER_PASS) -> DataFrame:
    """``annotate`` in passes: each times up to ``rounds_per_pass`` rounds, and only candidates whose timing is still
    unstable go on to the next.

    A pass deals its candidates out anew, so the few that need all rounds are spread over the tasks instead of
    holding the one they came in, and is written to the shared scratch folder: a lost executor repeats its part of
    one pass. The driver sees whether candidates are left, no more. ``hard_limit`` holds for a candidate's pass. The
    verifier's record also has ``rounds_before``, the rounds already taken. Columns are those of ``annotate``.
    """
    from pairforge.session import materialize
    cols, before = candidates.columns, "rounds_before"
    live, out, used = candidates.drop(before).withColumn(before, F.lit(0).cast("long")), None, 0
    # Steadiness is judged here, and a slow candidate's mean only once it is final.
    steady = (F.col("output") != "passed") | F.col("std_time").isNull() | ((F.col("avg_time") > 0) & (F.col("std_time") <= F.lit(cov) * F.col("avg_time")))
    while used < rounds:
        now = min(rounds_per_pass, rounds - used)
        done = materialize(annotate(live, verifier, None, spread_keys, num_partitions, hard_limit, now, reps, cov), "timing-pass")
        used += now
        final = done.where(steady) if used < rounds else done
        final = final.withColumn("n_rounds", F.when(F.col("n_rounds") > 0, F.col(before) + F.col("n_rounds")).otherwise(F.col("n_rounds")))
        out = final if out is None else out.unionByName(final)
        live = done.where(~steady).select(*[c for c in done.columns if c in live.columns and c != before], F.lit(used).cast("long").alias(before))
        if used >= rounds or live.isEmpty():
            break
    if time_limit is not None:
        slow = F.coalesce(F.col("avg_time") > time_limit * 1e9, F.lit(False))
        out = out.withColumns({"output": F.when(slow, "failed").otherwise(F.col("output")),
                               "error_type": F.when(slow, "TimeoutError").otherwise(F.col("error_type")),
                               "std_time": F.when(~slow, F.col("std_time")), "avg_time": F.when(~slow, F.col("avg_time"))})
    return out.select(*[c for c in cols if c != before], *[f.name for f in VERDICT_FIELDS])
