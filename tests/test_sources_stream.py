"""Sources and sinks round trips, Arrow IPC, and streaming vs batch."""

import json
import os
import tempfile


from conftest import SMALL
from pairforge.operators import metrics as M
from pairforge.plans import fixtures as X
from pairforge.session import scratch_path
from pairforge.sources import io as IO
from pairforge.streaming import stream as ST


def test_read_samples_json_array_keeps_order(spark):
    d = tempfile.mkdtemp(prefix="pf-samples-")
    samples = [{"task_id": "7", "answer": "a"}, {"task_id": "3", "answer": "b"}, {"task_id": "7", "answer": "c"}]
    with open(os.path.join(d, "outputs.json"), "w") as f:
        json.dump(samples, f)
    got = IO.read_samples(spark, os.path.join(d, "outputs.json")).orderBy("pos").collect()
    assert [(r.task_id, r.answer, r.pos) for r in got] == [("7", "a", 0), ("3", "b", 1), ("7", "c", 2)]


def test_ingest_and_select_splits(spark):
    d = tempfile.mkdtemp(prefix="pf-problems-")
    src = os.path.join(d, "p.jsonl")
    with open(src, "w") as f:
        for i in range(5):
            f.write(json.dumps({"task_id": str(i), "prompt": f"p{i}", "test": "assert True",
                                "entry_point": "f"}) + "\n")
    out = os.path.join(d, "table")
    IO.ingest_jsonl(spark, src, "train", out)
    IO.ingest_jsonl(spark, src, "test", out)
    df = IO.read_problems(spark, out)
    assert df.count() == 10
    assert IO.select_splits(df, eval_mode=True).count() == 5
    assert IO.select_splits(df, eval_mode=False).count() == 5


def test_writers_keep_other_partitions_in_a_default_session(spark):
    """With Spark's own overwrite mode a second write replaces its own partitions only."""
    other, mode = spark, spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    rows = lambda split, check: other.createDataFrame(
        [("1", 0, "p", "a", "passed", 1.0, 0.1, "", 1, None, split, check)],
        "task_id string, answer_id long, prompt string, answer string, output string, avg_time double, std_time double, "
        "error_type string, answer_length long, error_trace string, split string, check_id long")
    try:
        path = scratch_path(spark, "t-modes")
        for split, check in (("train", 0), ("test", 0), ("train", 1), ("train", 0)):
            IO.write_runs(rows(split, check), f"{path}/runs")
            one = other.createDataFrame([("m", 1.0, split, check)], "metric string, value double, split string, check_id long")
            IO.write_metrics(one, f"{path}/metrics")
            IO.write_report(one.select("split", "value"), f"{path}/report")
            IO.write_run_table(IO.run_layout(one, method=f"{split}{check}"), f"{path}/table")
        assert IO.read_runs(other, f"{path}/runs").count() == 3
        assert other.read.json(f"{path}/metrics").count() == 3 and other.read.json(f"{path}/report").count() == 2
        assert IO.read_run_table(other, f"{path}/table").count() == 3
        assert IO.read_run_table(other, f"{path}/table", method="train1").count() == 1
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)


def test_runs_per_file_layout(spark):
    d = tempfile.mkdtemp(prefix="pf-runs-")
    for split in ("train", "validation"):
        os.makedirs(os.path.join(d, split, "runs"))
        for chk in (0, 1):
            with open(os.path.join(d, split, "runs", f"check_{chk}.json"), "w") as f:
                f.write(json.dumps({"task_id": "1", "answer_id": 0, "prompt": "p", "answer": "a",
                                    "output": "passed", "avg_time": 1.0, "std_time": 0.1, "error_type": "",
                                    "answer_length": 1, "error_trace": None}) + "\n")
            with open(os.path.join(d, split, "runs", "notes.txt"), "w") as f:
                f.write("ignored")
    df = IO.read_runs_per_file(spark, os.path.join(d, "*", "runs", "*.json"))
    got = sorted((r.split, r.check_id) for r in df.collect())
    assert got == [("train", 0), ("train", 1), ("validation", 0), ("validation", 1)]


def test_run_layout(spark):
    df = spark.range(3).toDF("x")
    out = IO.run_layout(df, dataset="mbpp", model="m", method="pvf_iter", epochs=200)
    assert set(out.columns) >= {"dataset", "model", "method", "epochs"}


def test_stream_counts_equal_batch(spark):
    runs = X.r1_runs(spark, SMALL)
    runs_dir, out_dir, ck = (scratch_path(spark, n) for n in ("t-in", "t-out", "t-ck"))
    runs.select(*[f.name for f in ST.STREAM_RUNS.fields]).repartition(3).write.json(runs_dir)
    q = ST.stream_error_counts(spark, runs_dir, out_dir, ck, max_files_per_trigger=1)
    q.awaitTermination()
    streamed = {(r.split, r.error_type): r.n for r in ST.latest_counts(spark, out_dir).collect()}
    batch = {(r.split, r.error_type): r.n for r in M.error_counts(runs).collect()}
    assert streamed == batch


def test_arrow_roundtrip(spark):
    from pairforge.sources import arrow_ipc
    arrow_ipc.register(spark)
    path = scratch_path(spark, "t-arrow")
    p = X.p1_problems(spark, SMALL)
    p.write.format(arrow_ipc.FORMAT).mode("append").save(path)
    back = IO.read_problems(spark, path, fmt="arrowipc")
    assert sorted(r.task_id for r in back.collect()) == sorted(r.task_id for r in p.collect())
    assert "stdio" in back.columns


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0


def test_annotate_hard_limit(spark):
    from pairforge.operators.annotate import annotate

    def _slow_verifier(row):  # defined inline: shipped to workers by value
        import time as _t
        if int(row["answer_id"]) % 3 == 0:
            _t.sleep(5)
        if int(row["answer_id"]) % 3 == 1:
            raise ValueError("bad")

    c = spark.createDataFrame([("t", i, f"a{i}") for i in range(6)], "task_id string, answer_id long, answer string")
    out = {r.answer_id: r.error_type for r in annotate(c, _slow_verifier, hard_limit=0.5).collect()}
    assert out == {0: "UnknownError", 1: "ValueError", 2: "", 3: "UnknownError", 4: "ValueError", 5: ""}


def metric_file(path, name, rows):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as f:
        for step, kind, n in rows:
            f.write(json.dumps({"step": step, "error_type": kind, "n": n}) + "\n")


def test_feedback_state_survives_restarts_and_reads_one_folder(spark):
    d = tempfile.mkdtemp(prefix="pf-feedback-")
    src, state, ck = (os.path.join(d, n) for n in ("in", "state", "ck"))
    run = lambda: ST.stream_latest_metrics(spark, src, state, ck).awaitTermination()
    now = lambda: sorted(map(tuple, ST.current_state(spark, state).collect()))
    metric_file(src, "a.json", [(1, "A", 3), (1, "", 9), (2, "A", 2), (2, "B", 5)])
    run()
    assert now() == [(2, "A", 2), (2, "B", 5)]
    metric_file(src, "b.json", [(1, "C", 7)])  # an older step that comes late changes nothing
    run()
    assert now() == [(2, "A", 2), (2, "B", 5)]
    metric_file(src, "c.json", [(2, "B", 5), (2, "D", 1)])  # delivered again, with one more type
    run()
    assert now() == [(2, "A", 2), (2, "B", 5), (2, "D", 1)]
    metric_file(src, "d.json", [(5, "", 30)])  # a step without failures clears the rest
    run()
    assert now() == [(5, "", 30)]
    assert len([f for f in os.listdir(state) if f.startswith("batch_id=")]) >= 4
    files = ST.current_state(spark, state).inputFiles()
    assert len({os.path.dirname(f) for f in files}) == 1


def test_redelivered_verdicts_count_once_across_restarts(spark):
    d = tempfile.mkdtemp(prefix="pf-again-")
    src, out, ck = (os.path.join(d, n) for n in ("in", "out", "ck"))
    os.makedirs(src)
    row = lambda a, kind, check=0: {"split": "train", "task_id": "1", "answer_id": a, "check_id": check, "error_type": kind, "ts": "2024-01-01T00:00:00"}
    for name, rows in (("a", [row(1, "A"), row(2, ""), row(1, "A")]), ("b", [row(2, ""), row(1, "A", 1)]), ("c", [row(3, "A"), row(1, "A")])):
        with open(os.path.join(src, f"{name}.json"), "w") as f:
            f.write("".join(json.dumps(r) + "\n" for r in rows))
        ST.stream_error_counts(spark, src, out, ck, redelivery="1 day").awaitTermination()
    assert {(r.error_type, r.n) for r in ST.latest_counts(spark, out).collect()} == {("A", 3), ("", 1)}


def test_timing_frontier(spark):
    from pairforge.operators.annotate import annotate_frontier

    def verifier(row):  # steady from round answer_id on; answer 9 raises, 8 is slow
        if row["answer_id"] == 9:
            raise ValueError("bad")
        if row["answer_id"] == 8:
            return 5_000_000_000
        seen[row["answer_id"], row["rounds_before"]] = n = seen.get((row["answer_id"], row["rounds_before"]), -1) + 1
        return 100 if row["rounds_before"] + n // 2 >= row["answer_id"] else (100, 300)[n % 2]
    seen: dict = {}
    c = spark.createDataFrame([("t", i, f"a{i}") for i in range(10)], "task_id string, answer_id long, answer string")
    got = {r.answer_id: r for r in annotate_frontier(c, verifier, rounds=6, reps=2, rounds_per_pass=2).collect()}
    assert [got[i].n_rounds for i in range(8)] == [1, 2, 3, 4, 5, 6, 6, 6]
    assert [(got[i].avg_time, got[i].std_time) for i in (0, 5, 6, 7)] == [(100, 0), (100, 0), (200, 100), (200, 100)]
    assert (got[8].error_type, got[8].avg_time, got[9].error_type, got[9].n_rounds) == ("TimeoutError", None, "ValueError", 0)
    assert "rounds_before" not in got[0].asDict()
    assert annotate_frontier(c.limit(0), verifier, rounds=2, reps=2).count() == 0
