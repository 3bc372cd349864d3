"""Digests in the merge, the text store, checks added one by one, addressed pairs, quarantined lines."""

import json
import os
import random
import tempfile

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import SMALL
from pairforge.operators import checks as C
from pairforge.operators import merge as G
from pairforge.operators import pairs as P
from pairforge.operators import ranked_store as R
from pairforge.operators import texts as T
from pairforge.plans import fixtures as X
from pairforge.session import scratch_path
from pairforge.sources import io as IO


STOPPED = (PySparkException, Py4JJavaError)


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect() if cols else df.collect()), key=str)


def explained(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


# Texts and digests

def test_no_text_in_any_exchange_of_the_merge(spark):
    m = G.merge_runs(X.r2_runs(spark, SMALL), materialize=False)
    for name in ("averaged", "scored", "deduped", "kept", "ranked"):
        df = m.slim[name]
        assert dict(df.dtypes)["answer"] == dict(df.dtypes)["prompt"] == "binary"
        plan = explained(df)
        assert "hashpartitioning(" in plan and "unhex(md5(" in plan


def test_texts_come_back(spark):
    data = [(1, "a", "x"), (2, None, "x"), (3, "", None), (4, "é\n", "a")]
    df = spark.createDataFrame(data, "i int, prompt string, answer string")
    slim = T.with_digests(df)
    assert rows(T.resolve(slim.drop("answer_chars"), T.dictionary(df))) == rows(df)
    assert [r.answer_chars for r in slim.orderBy("i").collect()] == [1, 1, None, 1]
    store = T.TextStore(spark)
    first = store.add(df.where("i < 3"))
    second = store.add(df)
    store.add(df)
    assert rows(store.resolve(second.drop("answer_chars"))) == rows(df) and first.count() == 2
    assert sorted(r.text for r in store.table.collect()) == ["", "a", "x", "é\n"]
    again = T.TextStore(spark.newSession(), store.path)
    assert again.table.count() == 4


def test_a_second_text_under_a_digest_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(T, "digest", lambda c: F.unhex(F.md5(F.substring(c if not isinstance(c, str) else F.col(c), 1, 1))))
    df = spark.createDataFrame([("p", "ab"), ("p", "ac")], "prompt string, answer string")
    with pytest.raises(STOPPED, match="share a digest"):
        T.dictionary(df).collect()
    store = T.TextStore(spark)
    store.add(df.where("answer = 'ab'"))
    with pytest.raises(STOPPED, match="share a digest"):
        store.add(df.where("answer = 'ac'"))


# Checks

def test_checks_added_one_by_one_equal_all_at_once(spark):
    rng = random.Random(4)
    schema = ("split string, task_id string, answer_id long, prompt string, answer string, output string, error_type string, "
              "avg_time double, std_time double, check_id long")
    data = [("train", str(a % 3), a, "p", f"ans{a % 7}" if a != 5 else None, "passed" if kind == "" else "failed", kind,
             None if kind else rng.random(), None if rng.random() < 0.5 else rng.random(), c)
            for c in range(3) for a in range(20) for kind in [rng.choice(["", "A", "B", None])]]
    runs = spark.createDataFrame(data, schema)
    path = scratch_path(spark, "t-checks")
    C.add_check(runs.where("check_id = 1").withColumn("avg_time", F.lit(99.0)), path)  # replaced below
    for c in (0, 1, 2):
        C.add_check(runs.where(F.col("check_id") == c), path)
    cols = [*G.CHECK_KEYS, F.round("avg_time", 9).alias("a"), F.round("std_time", 9).alias("s")]
    assert rows(C.averaged_checks(spark, path), *cols) == rows(G.average_checks(runs), *cols)
    cols = ["split", "task_id", "error_type", F.round("frequency", 9).alias("f")]
    assert rows(C.checked_frequency(spark, path), *cols) == rows(G.error_frequency(runs), *cols)
    # Scores and ranks go on from the states.
    slim = C.averaged_checks(spark, path, with_texts=False)
    assert rows(G.score(slim, C.checked_frequency(spark, path)), "answer_id", "answer_length", "error_type") == \
        rows(G.score(G.average_checks(runs), G.error_frequency(runs)), "answer_id", "answer_length", "error_type")


def test_adding_a_check_reads_no_earlier_verdicts(spark):
    runs = X.r1x2_runs(spark, SMALL)
    path = scratch_path(spark, "t-checks")
    C.add_check(runs.where("check_id = 0"), path)
    before = {f for f in spark.read.parquet(f"{path}/answers").inputFiles()}
    C.add_check(runs.where("check_id = 1"), path)
    assert before < {f for f in spark.read.parquet(f"{path}/answers").inputFiles()}


# Pairs by number

def test_pair_numbers_round_trip(spark):
    df = spark.createDataFrame([(c, r, 7) for c in range(5) for r in range(7)], "c long, r long, n_fail long")
    back = df.withColumn("p", P.pair_rank("c", "r"))
    c, r = P.pair_unrank("p")
    assert [x.p for x in back.orderBy("c", "r").collect()] == list(range(35))
    assert all((x.c, x.r) == (x.c2, x.r2) for x in back.withColumns({"c2": c, "r2": r}).collect())


def test_ranges_cut_the_pair_space(spark):
    ranked = G.merge_runs(X.r1_runs(spark, SMALL)).ranked
    store = R.save_store(ranked)
    every = P.all_pairs(ranked.filter("split = 'train'"))
    total = every.count()
    cols = ["id", "pair_pos", "chosen", "rejected", "chosen_id", "rejected_id", "prompt"]
    for s in (store, ranked):
        whole = P.pair_range(s, "train", 0, total + 10)
        assert rows(whole, *cols) == rows(every, *cols)
        assert sorted(r.pair_no for r in whole.collect()) == list(range(total))
    for a, b in ((0, 1), (total // 3, total // 2), (total - 1, total), (5, 5), (total, total + 5)):
        part = P.pair_range(store, "train", a, b)
        assert sorted(r.pair_no for r in part.collect()) == list(range(a, min(b, total)))
        assert rows(part, *cols) == rows(whole.where((F.col("pair_no") >= a) & (F.col("pair_no") < b)), *cols)


def test_long_ranges_unfold_in_steps(spark):
    df = spark.createDataFrame([(0, 0, 0), (1, 5, 6), (2, 3, 1000), (3, 60, 64), (4, 63, 65)], "k long, a long, b long")
    got = P._numbers(df, "a", "b", "x", width=8)
    assert sorted((r.k, r.x) for r in got.collect()) == sorted((k, x) for k, a, b in ((1, 5, 6), (2, 3, 1000), (3, 60, 64), (4, 63, 65)) for x in range(a, b))


# Broken lines

GOOD = {"task_id": "1", "answer_id": 3, "prompt": "p", "answer": "a", "output": "passed", "avg_time": 1.5, "error_type": ""}
BROKEN = ['{"task_id": "2", "answer_id"', "not json", "[1, 2]", '"text"', '{"task_id": "3", "avg_time": "soon"}', "7", "null", '[{"task_id": "4"}]']


def write_lines(lines):
    d = tempfile.mkdtemp(prefix="pf-broken-")
    folder = os.path.join(d, "split=train", "check_id=2")
    os.makedirs(folder)
    with open(os.path.join(folder, "part.json"), "w") as f:
        f.write("\n".join(lines) + "\n")
    return d


def test_broken_lines_are_put_aside(spark):
    d = write_lines([json.dumps(GOOD), *BROKEN, "", "   ", json.dumps({**GOOD, "task_id": "5", "other": 1})])
    aside = scratch_path(spark, "t-quarantine")
    for _ in range(2):  # a second read replaces what the first put aside
        got = IO.read_runs(spark, d, quarantine_path=aside)
        assert sorted((r.task_id, r.avg_time, r.split, r.check_id) for r in got.collect()) == [("1", 1.5, "train", 2), ("5", 1.5, "train", 2)]
        # Whatever columns a query uses, the same rows are counted.
        assert got.count() == got.select("task_id").count() == got.where("split = 'train'").count() == 2
    stored = spark.read.parquet(aside)
    assert sorted(r.line for r in stored.collect()) == sorted(BROKEN)
    assert [(r.n_lines, r.file.endswith("/part.json")) for r in IO.quarantined(spark, aside).collect()] == [(len(BROKEN), True)]
    with open(os.path.join(d, "split=train", "check_id=2", "part.json"), "w") as f:
        f.write(json.dumps(GOOD) + "\n")
    assert IO.read_runs(spark, d, quarantine_path=aside).count() == 1 and IO.quarantined(spark, aside).count() == 0


@pytest.mark.parametrize("line", BROKEN[:2] + BROKEN[4:5])
def test_broken_lines_stop_a_plain_read(spark, line):
    d = write_lines([json.dumps(GOOD), line])
    with pytest.raises(STOPPED):
        IO.read_runs(spark, d).collect()


def test_samples_problems_and_files_without_broken_lines(spark):
    d = tempfile.mkdtemp(prefix="pf-broken-")
    with open(os.path.join(d, "s.jsonl"), "w") as f:
        f.write('{"task_id": "1", "answer": "a", "pos": 0}\n{"task_id": "2", "ans\n')
    aside = scratch_path(spark, "t-quarantine")
    assert [r.task_id for r in IO.read_samples_jsonl(spark, os.path.join(d, "s.jsonl"), aside).collect()] == ["1"]
    IO.ingest_jsonl(spark, os.path.join(d, "s.jsonl"), "train", os.path.join(d, "out"), aside)
    assert spark.read.parquet(os.path.join(d, "out")).count() == 1
    assert IO.quarantined(spark, aside).agg(F.sum("n_lines")).first()[0] == 1
    with open(os.path.join(d, "array.json"), "w") as f:
        f.write('[{"task_id": "1", "answer": "a"}, {"task_id"')
    with pytest.raises(STOPPED):
        IO.read_samples(spark, os.path.join(d, "array.json")).collect()
    run = os.path.join(d, "train", "runs")
    os.makedirs(run)
    with open(os.path.join(run, "check-4.json"), "w") as f:
        f.write(json.dumps(GOOD) + "\n{\n")
    got = IO.read_runs_per_file(spark, os.path.join(d, "*", "runs", "*.json"), aside).collect()
    assert [(r.split, r.check_id, r.task_id) for r in got] == [("train", 4, "1")]


def test_pairs_take_an_answers_digest_from_its_row(spark):
    rows = [("train", f"t{t}", "p", i, i, f"answer {t} {i}", i < 3, i if i < 3 else i - 3, 3, 4, 0.0 if i < 3 else 0.5 - i / 100)
            for t in range(3) for i in range(7)]
    ranked = spark.createDataFrame(rows, "split string, task_id string, prompt string, answer_id long, rank long, answer string, "
                                         "is_pass boolean, side_rank long, n_pass long, n_fail long, error_frequency double")
    md5 = {"md5": F.md5("answer")}
    for pairs in (P.all_pairs(ranked, per_answer=md5, block=2), P.curriculum_pairs(ranked, per_answer=md5),
                  P.curriculum_pairs(ranked, increase=False, per_answer=md5)):
        assert pairs.count() == 36
        assert pairs.where((F.md5("chosen") != F.col("chosen_md5")) | (F.md5("rejected") != F.col("rejected_md5"))).count() == 0
        plan = pairs.select("id", "chosen_md5", "rejected_md5", "pair_pos")._jdf.queryExecution().optimizedPlan().toString()
        above, join, below = plan.partition("Join")
        assert join and "md5(" not in above and below.count("md5(") == 2


def test_lines_of_a_split_are_written_by_the_tasks_that_have_them(spark):
    path, aside = scratch_path(spark, "t-lines"), scratch_path(spark, "t-aside")
    lines = spark.range(0, 400, 1, 4).select(F.when(F.col("id") % 100 == 7, '{"task_id": "1').otherwise('{"task_id": "1"}').alias("value"),
                                             F.when(F.col("id") % 2 == 0, "train").otherwise("test").alias("split"), F.lit(0).alias("check_id"))
    IO.write_run_lines(lines, path)
    assert len([f for f in os.listdir(f"{path.removeprefix('file:')}/split=test/check_id=0") if f.startswith("part-")]) == 4
    assert IO.read_runs(spark, path, quarantine_path=aside).groupBy("split").count().orderBy("split").collect() == [("test", 196), ("train", 200)]
    got = IO.quarantined_runs(spark, aside).collect()
    assert [(r.run.endswith("/split=test/check_id=0"), r.n_lines, r.n_parts) for r in got] == [(True, 4, 4)]


def test_a_verifier_of_rounds_reads_its_answer_once_a_call(monkeypatch):
    from pairforge.operators.annotate import timed_rounds
    from pairforge.plans import q_more
    read, loads = [], json.loads
    monkeypatch.setattr(json, "loads", lambda s: read.append(s) or loads(s))
    row = {"task_id": "1", "answer_id": 2, "rounds_before": 0, "answer": '{"k": 50}'}
    for verifier, reps in ((q_more.timed_verifier(), q_more.REPS), (q_more.resumed_verifier(), 10)):
        read.clear()
        mean, std, n = timed_rounds(lambda v=verifier: v(row), 3, reps, 0.1)
        assert len(read) == n * reps and n == 3
        assert (mean, std) == ((51000, 0) if reps == q_more.REPS else (2000, 1000))


def _ranked_md5_rows(n):
    return [("train", "t", i, "p", f"answer {i}" + "x" * i, "passed" if i % 3 else "failed", "" if i % 3 else "E" * (1 + i % 2), 1.0, 0.1) for i in range(n)]


RUNS = "split string, task_id string, answer_id long, prompt string, answer string, output string, error_type string, avg_time double, std_time double"


def _hashed(runs):
    return T.with_digests(runs, ["answer"], ["answer"], ["answer"])


@pytest.mark.parametrize("digested", [True, False])
def test_ranked_md5_is_ranked_with_digests_and_stores_no_answer(spark, digested):
    runs = spark.createDataFrame([*_ranked_md5_rows(30), ("train", "t", 99, None, "no prompt", "passed", "", 1.0, 0.1)], RUNS)
    m = G.merge_runs(runs, digested=_hashed(runs) if digested else None)
    named = rows(m.ranked_md5)
    assert "texts" not in m._cache and "ranked" not in m._cache
    assert "answer 2" not in str(named) + str(rows(m.rows))
    assert m.ranked_md5.columns == [c for c in m.ranked.columns if c != "answer_chars"]
    assert named == rows(m.ranked.withColumn("answer", F.md5("answer"))) and len(named) == 30


def test_names_of_digests_tell_texts_apart_by_hash(spark):
    same = spark.createDataFrame([(b"\x01\xab", 1), (b"\x01\xab", 1), (None, 2)], "answer binary, answer_hash long")
    assert rows(T.digest_names(same), F.hex("digest"), "text") == [("01AB", "01ab")]
    with pytest.raises(STOPPED, match="two texts share a digest"):
        T.digest_names(same.union(spark.createDataFrame([(b"\x01\xab", 3)], same.schema))).collect()


def test_curriculum_pairs_desc_moves_and_stores_no_answer(spark, monkeypatch):
    from pairforge.plans import q_pairs
    runs = spark.createDataFrame(_ranked_md5_rows(30), RUNS)
    m = G.merge_runs(runs, digested=_hashed(runs))
    monkeypatch.setattr(q_pairs, "stage_merge", lambda *a: m)
    got = q_pairs.curriculum_pairs_desc(spark, "")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "texts" not in m._cache and "ranked" not in m._cache and "texts-" not in plan
    want = P.curriculum_pairs(m.ranked, increase=False, per_answer={"md5": F.md5("answer")})
    assert rows(got) == rows(q_pairs._pair_cols(want)) and got.count() == 200


def test_copies_of_pairs_grow_slower_than_pairs(spark):
    def side(n, pos):
        return spark.range(n).select(F.lit("s").alias("split"), F.lit("t").alias("task_id"), F.lit(n).cast("long").alias("n_pass"),
                                     F.lit(n).cast("long").alias("n_fail"), F.col("id").alias(pos))

    blocks = [side(n, "c_pos").agg(F.max(F.ceil(F.col("n_fail") / P._width("n_fail", 4)))).collect()[0][0] for n in (4, 16, 256, 1024)]
    assert blocks == [1, 4, 16, 32]  # copies of a row; 64 and 256 of them if all blocks have one width
    for n in (1, 5, 16, 17, 300):
        got = P._cross_in_blocks(side(n, "c_pos"), side(n, "r_pos"), "c_pos", "r_pos", "n_pass", "n_fail", 4)
        assert got.select("c_pos", "r_pos").distinct().count() == got.count() == n * n
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_no_text_goes_through_the_join_of_r2(spark):
    from pairforge.plans import q_merge
    m = q_merge.merged(spark, SMALL, "r2")
    above, join, below = m.runs.select(*G.CHECK_KEYS, "answer_chars", "answer_hash")._jdf.queryExecution().optimizedPlan().toString().partition("Join")
    assert join and "md5(cast(text#" in below and "md5(cast(text#" not in above
    plain = T.with_digests(X.r2_runs(spark, SMALL), hashes=["answer"])
    assert rows(m.runs, *plain.columns) == rows(plain)
