"""The ranked store: look-ups without shuffling the tables, schedules and replay runs on task rows, addressed pairs."""

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from pairforge.operators import merge as G
from pairforge.operators import ranked_store as R
from pairforge.operators import schedule as K
from pairforge.plans import fixtures as X
from pairforge.session import scratch_path

E = 5


@pytest.fixture(scope="module")
def ranked(spark):
    return G.merge_runs(X.r1_runs(spark, SMALL)).ranked


@pytest.fixture(scope="module")
def store(ranked):
    return R.save_store(ranked)


@pytest.fixture(scope="module")
def val(spark):
    return K.validation_counts_by_epoch(X.v1_metrics(spark, SMALL), E)


@pytest.fixture
def no_broadcast(spark):
    """Joins as on tables too large to broadcast."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = [spark.conf.get(n, None) for n in names]
    for n in names:
        spark.conf.set(n, "-1")
    yield
    for n, v in zip(names, old, strict=True):
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def plan_of(df):
    """The plan without its scalar subqueries (one-row tables read before it)."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted").split("===== Subqueries =====")[0]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("schedule", K.SCHEDULES)
def test_stored_tables_give_the_same_pairs(ranked, store, val, schedule):
    assert rows(K.progressive_pairs(store, schedule, E, seed=3, val_counts=val)) == rows(K.progressive_pairs(ranked, schedule, E, seed=3, val_counts=val))


@pytest.mark.parametrize("schedule,most", [("pvf", 2), ("pvf_iter", 2), ("pvf_iter_type", 3), ("pvf_iter_priority", 3), ("pvf_iter_reverse_priority", 3)])
def test_look_ups_shuffle_only_the_drawn_rows(store, val, no_broadcast, schedule, most):
    """One exchange for each look-up, of the asking rows; the stored tables feed their joins as they lie in their buckets."""
    plan = plan_of(K.progressive_pairs(store, schedule, E, val_counts=val))
    assert plan.count("Arguments: hashpartitioning(") == most
    assert plan.count("Bucketed: true") == most and plan.count("ReadSchema:") == most + 1


def test_positions_and_runs_need_no_shuffle(store, val):
    for df in (K.drawn_positions(store, "pvf_iter_priority", E, val_counts=val), K.drawn_positions(store, "pvf_iter_type", E), K.replay_runs(store, E, val)):
        plan = plan_of(df)
        assert "Exchange" not in plan and "Join" not in plan


def test_building_a_query_starts_no_job(spark, store, val):
    spark.sparkContext.setJobGroup("building", "")
    K.progressive_pairs(store, "pvf_iter_priority", E, val_counts=val)
    K.replay_weights(store, E, val)
    started = spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not started


def test_store_opens_in_another_session(spark, ranked):
    path = scratch_path(spark, "store-test")
    R.save_store(ranked, path, buckets=8)
    other = R.open_store(spark.newSession(), path)
    assert rows(K.progressive_pairs(other, "pvf_iter", E)) == rows(K.progressive_pairs(ranked, "pvf_iter", E))
    assert other.answers.count() == ranked.count()


HOT = "split string, task_id string, prompt string, answer string, answer_id long, output string, error_type string, error_frequency double, answer_length long"


def hot_ranked(spark, n_fail):
    """One task with ``n_fail`` failures of three types, and a small one."""
    data = [("train", "hot", "p", f"ok{i}", i, "passed", "", 0.0, i) for i in range(4)]
    data += [("train", "hot", "p", f"bad{i}", 10 + i, "failed", "ABC"[i % 3], 0.1 * (1 + i % 3), 99) for i in range(n_fail)]
    data += [("train", "cold", "q", f"c{i}", i, "passed" if i < 2 else "failed", "" if i < 2 else "A", 0.0 if i < 2 else 1.0, 5) for i in range(5)]
    return G.rank_answers(spark.createDataFrame(data, HOT))


def test_hot_task_is_spread_over_buckets(spark):
    store = R.save_store(hot_ranked(spark, 2000), buckets=8)
    sizes = [r["count"] for r in store.answers.where("task_id = 'hot'").groupBy(F.input_file_name().alias("f")).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 2004 / 8


def test_runs_do_not_grow_with_failures_and_expand_to_all_weights(spark):
    val = spark.createDataFrame([(e, t, n, 9, -(-n // 2)) for e in range(1, E) for t, n in (("A", 2), ("B", 7))],
                                "epoch long, error_type string, cnt long, total long, least_cnt long")
    sizes = []
    for n_fail in (30, 3000):
        ranked = hot_ranked(spark, n_fail)
        runs = K.replay_runs(ranked, E, val)
        sizes.append(runs.count())
    assert sizes[0] == sizes[1] == 2 * E + 3 * (E - 1)
    ranked = hot_ranked(spark, 31)
    fails = {(r.task_id, r.side_rank): r.error_type for r in ranked.where("not is_pass").collect()}
    n = {t: sum(k[0] == t for k in fails) for t in ("hot", "cold")}
    got = {(r.task_id, r.epoch, r.side_rank): r.weight for r in K.replay_weights(ranked, E, val).collect()}
    assert len(got) == E * len(fails)
    for (t, pos), kind in fails.items():
        for e in range(E):
            lo, hi = int(e * (n[t] / E)), int((e + 1) * (n[t] / E))
            hi = min(lo + 1, n[t]) if hi == lo else hi
            add = {k: max(-(-c // 2), int((hi - lo) * (c / 9))) for k, c in (("A", 2), ("B", 7)) if e and any(x[0] == t and v == k for x, v in fails.items())}
            size = {k: sum(x[0] == t and v == k for x, v in fails.items()) for k in "ABC"}
            want = ((lo <= pos < hi) + add.get(kind, 0) / max(1, size[kind])) / (hi - lo + sum(add.values()))
            assert got[t, e, pos] == pytest.approx(want)
