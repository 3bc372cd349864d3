"""Properties of the merge, ranking, pairs and schedules on the fixtures."""

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from pairforge.operators import merge as G
from pairforge.operators import pairs as P
from pairforge.operators import schedule as K
from pairforge.operators.ranking import group_rank, steps
from pairforge.plans import fixtures as X


@pytest.fixture(scope="module")
def r1_merge(spark):
    return G.merge_runs(X.r1_runs(spark, SMALL))


def test_one_row_per_answer_after_dedupe(r1_merge):
    d = r1_merge.deduped
    assert d.count() == d.select("split", "answer").distinct().count()


def test_kept_tasks_are_contrastive(r1_merge):
    c = r1_merge.kept.groupBy("split", "task_id").agg(
        F.count_if(F.col("error_frequency") == 0).alias("p"), F.count_if(F.col("error_frequency") != 0).alias("f"))
    assert c.filter((F.col("p") < 2) | (F.col("f") < 2)).count() == 0
    assert c.count() > 0


def test_ranks_are_dense_and_passes_first(r1_merge):
    r = r1_merge.ranked
    per = r.groupBy("split", "task_id").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("mx"),
                                            F.countDistinct("rank").alias("d"))
    assert per.filter((F.col("mx") != F.col("n") - 1) | (F.col("d") != F.col("n"))).count() == 0
    bad = r.filter((F.col("is_pass") & (F.col("rank") >= F.col("n_pass")))
                   | (~F.col("is_pass") & (F.col("rank") < F.col("n_pass"))))
    assert bad.count() == 0


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_group_rank_independent_of_partitioning_and_blocks(spark, parts):
    ev = spark.read.parquet(f"{SMALL}/events.parquet").select("event_id", "ts", (F.col("user_id") % 3).alias("g"))
    plain = group_rank(ev, ["g"], ["ts", "event_id"], "r")
    cut = group_rank(ev.repartition(parts), ["g"], ["ts", "event_id"], "r", blocks=[F.to_date("ts"), F.hour("ts")])
    a = {(r.event_id, r.r) for r in plain.collect()}
    assert a == {(r.event_id, r.r) for r in cut.collect()} and len(a) == ev.count()


def test_group_rank_descending_blocks_and_nulls(spark):
    rows = [("g" if i % 2 else None, None if i % 7 == 0 else i % 5, i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, a int, i long")
    order = [("a", False), ("i", True)]
    plain = group_rank(df, ["g"], order, "r")
    cut = group_rank(df, ["g"], order, "r", blocks=[(F.col("a"), False), steps("i", 16)])
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, cut.collect()), key=str)


def test_group_rank_hot_group_spans_tasks(spark):
    """One group holding every row: its rows are numbered by several tasks, none with more than a block or two."""
    df = spark.range(20_000).select(F.lit(1).alias("g"), "id")
    r = group_rank(df, ["g"], ["id"], "r", blocks=[steps("id", 500)])
    per_task = [x.n for x in r.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert r.filter("r != id").count() == 0 and len(per_task) >= 4 and max(per_task) < 12_000


def test_replay_plan_is_one_pass(spark, r1_merge):
    """Over the ranked table, a replay schedule needs few exchanges."""
    val = K.validation_counts_by_epoch(X.v1_metrics(spark, SMALL), 5)
    df = K.progressive_pairs(r1_merge.ranked, "pvf_iter_priority", 5, val_counts=val)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 30


def test_all_pairs_count_and_block_join(spark, r1_merge):
    ranked = r1_merge.ranked
    want = ranked.select("split", "task_id", "n_pass", "n_fail").distinct() \
                 .agg(F.sum(F.col("n_pass") * F.col("n_fail"))).first()[0]
    for block in (1, 2, 256):
        p = P.all_pairs(ranked, block=block)
        assert p.count() == want
        assert p.select("split", "id", "pair_pos").distinct().count() == want


def test_replay_weights_sum_to_one(spark, r1_merge):
    ranked = r1_merge.ranked.filter(F.col("split") == "train")
    val = K.validation_counts_by_epoch(X.v1_metrics(spark, SMALL), 5)
    w = K.replay_weights(ranked, 5, val)
    sums = w.groupBy("split", "task_id", "epoch").agg(F.sum("weight").alias("s"))
    assert sums.filter(F.abs(F.col("s") - 1.0) > 1e-9).count() == 0


def test_every_schedule_gives_one_pair_per_task_epoch(spark, r1_merge):
    ranked = r1_merge.ranked.filter(F.col("split") == "train")
    val = K.validation_counts_by_epoch(X.v1_metrics(spark, SMALL), 5)
    n_tasks = ranked.select("task_id").distinct().count()
    for s in K.SCHEDULES:
        out = K.progressive_pairs(ranked, s, 5, seed=3, val_counts=val)
        assert out.count() == 5 * n_tasks, s
        assert out.filter(F.col("chosen").isNull() | F.col("rejected").isNull()).count() == 0


def test_replay_draws_match_weights(spark):
    """Empirical frequency of the two-stage replay draw follows the exact weights."""
    from pyspark.sql import Row
    rows = []
    types = ["A"] * 3 + ["B"] * 2 + ["C"] * 5
    for i, t in enumerate(types):
        rows.append(Row(split="s", task_id="t", prompt="p", answer=f"f{i}", answer_id=i, error_type=t,
                        error_frequency=0.1, answer_length=9, rank=2 + i, side_rank=i, is_pass=False,
                        n_pass=2, n_fail=len(types)))
    for i in range(2):
        rows.append(Row(split="s", task_id="t", prompt="p", answer=f"p{i}", answer_id=100 + i, error_type="",
                        error_frequency=0.0, answer_length=1, rank=i, side_rank=i, is_pass=True,
                        n_pass=2, n_fail=len(types)))
    ranked = spark.createDataFrame(rows)
    E = 400
    metrics = spark.createDataFrame([(s, "A", 6) for s in range(E)] + [(s, "B", 2) for s in range(E)],
                                    "step long, error_type string, n long")
    val = K.validation_counts_by_epoch(metrics, E)
    picks = K.progressive_pairs(ranked, "pvf_iter_priority", E, seed=5, val_counts=val)
    freq = {r.rejected_id: r.c for r in picks.groupBy("rejected_id").agg(F.count(F.lit(1)).alias("c")).collect()}
    w = K.replay_weights(ranked, E, val)
    exp = {r.answer_id: r.s for r in w.groupBy("answer_id").agg(F.sum("weight").alias("s")).collect()}
    for k, v in exp.items():
        assert abs(freq.get(k, 0) - v) < 4 * (v ** 0.5) + 3, (k, freq.get(k, 0), v)


def test_exact_schedule_covers_every_failure(spark, r1_merge):
    """With exact bounds and E <= n_fail, pvf_iter's windows partition the failures."""
    ranked = r1_merge.ranked.filter(F.col("split") == "train")
    E = 2
    te = K.task_epochs(ranked, E)
    lo, hi = K.epoch_bounds("epoch", "n_fail", E, "iter", exact=True)
    w = te.select("task_id", "n_fail", "epoch", lo.alias("lo"), hi.alias("hi"))
    per_task = w.groupBy("task_id", "n_fail").agg(F.sum(F.col("hi") - F.col("lo")).alias("covered"),
                                                  F.min("lo").alias("first"), F.max("hi").alias("last"))
    assert per_task.filter((F.col("covered") != F.col("n_fail")) | (F.col("first") != 0)
                           | (F.col("last") != F.col("n_fail"))).count() == 0
    out = K.progressive_pairs(ranked, "pvf_iter", E, seed=1, exact=True)
    assert out.count() == E * ranked.select("task_id").distinct().count()
