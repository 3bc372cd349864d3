"""Stage functions: table in, table out, as the reference runs its stages.

* ``annotate_stage``: samples + problems + verifier -> verdict rows and metrics
* ``merge_stage``: verdict rows -> flat ranked table (+ nested file, report)
* ``pairs_stage``: ranked table -> SFT rows, static pairs or per-epoch pairs

Each stage reads and writes through ``pairforge.sources.io`` and is built
only from the library's operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions.text import add_system_prompt, check_program, strip_text
from pairforge.operators import merge as G
from pairforge.operators import metrics as M
from pairforge.operators import pairs as P
from pairforge.operators import schedule as K
from pairforge.operators.annotate import EVAL_TIME_LIMIT, MAX_ROUNDS, REPETITIONS, annotate_frontier
from pairforge.operators.runs import answer_ids, join_problems
from pairforge.session import replace_partitions
from pairforge.sources import io as IO

STATIC = {"sft", "passk", "curri", "one"}


def annotate_stage(spark: SparkSession, samples: DataFrame, problems: DataFrame, verifier, split: str,
                   check_id: int = 0, runs_path: str | None = None, metrics_path: str | None = None,
                   time_limit: float | None = EVAL_TIME_LIMIT, hard_limit: float | None = None,
                   rounds: int = MAX_ROUNDS, reps: int = REPETITIONS, ks=(1, 5, 10)) -> DataFrame:
    """Give every sample a verdict. The verifier receives the candidate row
    (task_id, answer_id, prompt, answer, test, entry_point, program). A passing
    candidate is timed in rounds of ``reps`` calls until they are steady
    (``annotate_frontier``); ``std_time`` is NULL where one call was timed."""
    s = answer_ids(samples)
    j = join_problems(s, problems.select("task_id", "prompt", "test", "entry_point"))
    cand = j.select("task_id", "answer_id", strip_text("prompt").alias("prompt"), "answer", "test", "entry_point",
                    check_program("answer", "test", "entry_point").alias("program"))
    v = annotate_frontier(cand, verifier, time_limit=time_limit, hard_limit=hard_limit, rounds=rounds, reps=reps)
    ok = F.col("output") == "passed"
    runs = v.select("task_id", "answer_id", "prompt", "answer", "output", "avg_time", "std_time", "error_type",
                    F.when(ok, F.length("answer").cast("long")).alias("answer_length"), "error_trace",
                    F.lit(split).alias("split"), F.lit(check_id).cast("long").alias("check_id"))
    if runs_path:
        IO.write_runs(runs, runs_path)
        runs = IO.read_runs(spark, runs_path, [split]).filter(F.col("check_id") == check_id)
    if metrics_path:
        m = M.metrics_long(runs, ks).withColumn("check_id", F.lit(check_id).cast("long"))
        IO.write_metrics(m, metrics_path)
    return runs


def merge_stage(spark: SparkSession, runs: DataFrame, ranked_path: str | None = None,
                merged_path: str | None = None, report_path: str | None = None,
                dedupe_scope: str = "split", require_non_empty: bool = True) -> DataFrame:
    """Score, deduplicate, filter and rank. Returns the flat ranked table.
    Fails when no answer survives the filter (``require_non_empty``)."""
    m = G.merge_runs(runs, dedupe_scope=dedupe_scope, materialize=True)
    if require_non_empty:
        G.assert_non_empty(m.kept)
    ranked = m.ranked
    if ranked_path:
        replace_partitions(ranked, "split").parquet(ranked_path)
        ranked = spark.read.parquet(ranked_path)
    if merged_path:
        IO.write_merged(G.nest_answers(ranked, m.times), merged_path)
    if report_path:
        IO.write_report(m.report, report_path)
    return ranked


def pairs_stage(ranked: DataFrame, method: str, epochs: int = 1, seed: int = 0,
                val_counts: DataFrame | None = None, with_system_prompt: bool = True) -> DataFrame:
    """Training rows for one method: 'sft', 'passk' (all pairs), 'curri'
    (curriculum pairs), 'one' (one pair per task) or a schedule name."""
    if with_system_prompt:
        ranked = ranked.withColumn("problem", add_system_prompt("prompt"))
        ranked = ranked.withColumn("prompt", F.col("problem")).drop("problem")
    if method == "sft":
        return P.sft_texts(P.select_pass(ranked))
    if method == "passk":
        return P.all_pairs(ranked)
    if method == "curri":
        return P.curriculum_pairs(ranked)
    if method == "one":
        return P.one_pair(ranked, seed=seed)
    if method in K.SCHEDULES:
        return K.progressive_pairs(ranked, method, epochs, seed=seed, val_counts=val_counts)
    raise ValueError(f"unknown method {method}")


PAIR_COLUMNS = ["split", "id", "problem", "prompt", "chosen", "rejected", "chosen_id", "rejected_id"]


def training_rows(ranked: DataFrame, method: str, epochs: int = 1, seed: int = 0, val_counts: DataFrame | None = None,
                  with_system_prompt: bool = True) -> DataFrame:
    """Training and validation rows of one method, each split by its own rule.

    Training gets the method's rows. Validation is fixed over a run: one pair
    per task for the static methods, the one-epoch ``pvf`` pair for the
    schedules, and the same texts as training for 'sft'. ``epoch`` and
    ``pair_pos`` are NULL where the method has none.
    """
    train, held = ranked.filter(F.col("split") == "train"), ranked.filter(F.col("split") == "validation")
    rows = pairs_stage(train, method, epochs, seed, val_counts, with_system_prompt)
    if method == "sft":
        return rows.unionByName(pairs_stage(held, "sft", with_system_prompt=with_system_prompt))
    fixed = pairs_stage(held, "one" if method in STATIC else "pvf", 1, seed, None, with_system_prompt)
    extra = {"epoch": "long", "pair_pos": "long"}
    full = lambda df: df.select(*PAIR_COLUMNS, *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c)
                                                 for c, t in extra.items()])
    return full(rows).unionByName(full(fixed))
