"""End to end: samples -> verdicts -> ranked table -> training rows."""

from pyspark.sql import functions as F

from conftest import SMALL
from pairforge.plans import fixtures as X
from pairforge.plans import stages as S
from pairforge.session import scratch_path


def test_stages_end_to_end(spark):
    problems = X.p1_problems(spark, SMALL)
    # Several samples per problem from the benchmark text, so tasks get passes and failures.
    b = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    samples = (b.select(F.col("item_id").cast("string").alias("task_id"), "text",
                        F.explode(F.sequence(F.lit(1), F.lit(8))).alias("j"))
                .select("task_id", F.concat(F.substring("text", 1, 30), F.lit("#"), F.col("j").cast("string"))
                        .alias("answer"), (F.col("j") + F.col("task_id").cast("long") * 100).alias("pos")))

    def verifier(row):  # passes when the sample number is even
        if int(row["answer"].rsplit("#", 1)[1]) % 2:
            raise AssertionError("odd")

    runs = S.annotate_stage(spark, samples, problems, verifier, "train", runs_path=scratch_path(spark, "st-runs"),
                            metrics_path=scratch_path(spark, "st-metrics"))
    assert runs.count() == samples.count()
    ranked = S.merge_stage(spark, runs, ranked_path=scratch_path(spark, "st-ranked"),
                           merged_path=scratch_path(spark, "st-merged"), report_path=scratch_path(spark, "st-rep"))
    n_tasks = ranked.select("task_id").distinct().count()
    assert n_tasks > 0
    assert S.pairs_stage(ranked, "passk").count() == n_tasks * 4 * 4
    assert S.pairs_stage(ranked, "one").count() == n_tasks
    assert S.pairs_stage(ranked, "sft").count() == n_tasks * 4
    assert S.pairs_stage(ranked, "pvf_iter", epochs=3).count() == n_tasks * 3
    assert runs.filter("output = 'passed' AND (avg_time IS NULL OR std_time IS NULL)").count() == 0  # timed in rounds
    both = ranked.unionByName(ranked.withColumn("split", F.lit("validation")))
    rows = {(m, r.split): r["count"] for m in ("passk", "pvf_iter", "sft")
            for r in S.training_rows(both, m, epochs=3).groupBy("split").count().collect()}
    assert rows == {("passk", "train"): n_tasks * 16, ("passk", "validation"): n_tasks, ("pvf_iter", "train"): n_tasks * 3,
                    ("pvf_iter", "validation"): n_tasks, ("sft", "train"): n_tasks * 4, ("sft", "validation"): n_tasks * 4}


def test_merge_stage_fails_when_nothing_survives(spark):
    import pytest
    r1 = X.r1_runs(spark, SMALL).filter(F.col("output") == "passed")  # no failures -> no contrastive task
    with pytest.raises(ValueError, match="No available"):
        S.merge_stage(spark, r1)
