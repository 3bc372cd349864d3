"""Registered queries: source/sink round trips and the streaming jobs.

Each writes data derived from the given tables to a fresh folder under
the session's ``spark.checkpoint.dir`` and reads it back.
"""

from pyspark.sql import functions as F

from pairforge.operators import merge as G
from pairforge.plans import fixtures as X
from pairforge.plans import oracle_fixtures as O
from pairforge.plans.q_merge import R2_MERGE, merged
from pairforge.plans.registry import r6, register
from pairforge.session import scratch_path
from pairforge.sources import arrow_ipc
from pairforge.sources import io as IO
from pairforge.streaming import stream as ST

RUN_COLS = ["split", "task_id", "answer_id", "prompt", "answer", "output", "error_type", "answer_length",
            "error_trace"]


@register("roundtrip_runs", O.with_ctes(("r1", O.R1)) + """
SELECT split, task_id, answer_id, prompt, answer, output, error_type, answer_length, error_trace,
       CAST(0 AS BIGINT) AS check_id, round(avg_time, 6) AS avg_time FROM r1
""")
def roundtrip_runs(spark, sf_dir):
    path = scratch_path(spark, "runs")
    IO.write_runs(X.r1_runs(spark, sf_dir).withColumn("check_id", F.lit(0).cast("long")), path)
    back = IO.read_runs(spark, path)
    return back.select(*RUN_COLS, "check_id", r6("avg_time").alias("avg_time"))


@register("quarantined_runs", O.with_ctes(("r1", O.R1)) + """
SELECT split, count_if(event_id % 97 <> 0)::BIGINT AS n_rows, count_if(event_id % 97 <> 0 AND output = 'passed')::BIGINT AS n_pass,
       count(DISTINCT CASE WHEN event_id % 97 <> 0 THEN task_id END) AS n_tasks,
       count_if(event_id % 97 = 0)::BIGINT AS n_broken, count(DISTINCT CASE WHEN event_id % 97 = 0 THEN split END) AS n_files
FROM r1 GROUP BY split
""")
def quarantined_runs(spark, sf_dir):
    """Verdict files of which some lines were cut off while writing: counts of the rows read, and the lines put aside."""
    path, aside = scratch_path(spark, "runs-broken"), scratch_path(spark, "quarantine")
    runs = X.r1_runs(spark, sf_dir)
    line = F.to_json(F.struct(*[c for c in RUN_COLS if c != "split"], "avg_time", "std_time"))
    cut = F.when(F.col("event_id") % 97 == 0, F.substr(line, F.lit(1), F.floor(F.length(line) / 2).cast("int"))).otherwise(line)
    IO.write_run_lines(runs.select(cut.alias("value"), "split", F.lit(0).alias("check_id")), path)
    good = IO.read_runs(spark, path, quarantine_path=aside)
    counts = good.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("output") == "passed").alias("n_pass"),
                                       F.countDistinct("task_id").alias("n_tasks"))
    # A verdict file is a folder of part files, one per (split, check).
    broken = (IO.quarantined_runs(spark, aside).groupBy(F.regexp_extract("run", "split=([^/]+)/", 1).alias("split"))
              .agg(F.sum("n_lines").alias("n_broken"), F.count(F.lit(1)).alias("n_files")))
    return counts.join(broken, "split")


@register("roundtrip_merged", R2_MERGE + """
SELECT split, task_id AS id, rank, md5(answer) AS text_md5,
       error_type, answer_length, round(error_frequency, 6) AS error_frequency
FROM ranked
""")
def roundtrip_merged(spark, sf_dir):
    m = merged(spark, sf_dir, "r2")
    path = scratch_path(spark, "merged")
    IO.write_merged(G.nest_answers(m["ranked"], m["times"]), path)
    back = IO.read_merged(spark, path)
    return back.select("split", "id", "rank", F.md5("answer.text").alias("text_md5"),
                       F.col("answer.error_type").alias("error_type"), F.col("answer.answer_length").alias("answer_length"),
                       r6("answer.error_frequency").alias("error_frequency"))


@register("roundtrip_arrow", O.with_ctes(("p1", O.P1_PROBLEMS)) + """
SELECT task_id, prompt, test FROM p1
""")
def roundtrip_arrow(spark, sf_dir):
    arrow_ipc.register(spark)
    path = scratch_path(spark, "arrow")
    X.p1_problems(spark, sf_dir).write.format(arrow_ipc.FORMAT).mode("append").save(path)
    back = IO.read_problems(spark, path, fmt="arrowipc")
    return back.select("task_id", "prompt", "test")


@register("roundtrip_samples", O.with_ctes(("s1", O.P1_SAMPLES)) + """
SELECT task_id, answer, pos FROM s1
""")
def roundtrip_samples(spark, sf_dir):
    path = scratch_path(spark, "samples")
    IO.write_samples(X.p1_samples(spark, sf_dir), path)
    return IO.read_samples_jsonl(spark, path).select("task_id", "answer", "pos")


@register("stream_error_counts", O.with_ctes(("r1", O.R1)) + """
SELECT split, error_type, count(*) AS n FROM r1 GROUP BY ALL
""")
def stream_error_counts(spark, sf_dir):
    runs_dir, out_dir, ck = (scratch_path(spark, n) for n in ("stream-in", "stream-out", "stream-ck"))
    cols = [f.name for f in ST.STREAM_RUNS.fields]
    # Verdict files arrive as several files (one per task of this write).
    X.r1_rows(spark, sf_dir).withColumn("answer_id", F.col("event_id")).select(*cols).write.json(runs_dir)
    q = ST.stream_error_counts(spark, runs_dir, out_dir, ck, max_files_per_trigger=2)
    q.awaitTermination()
    return ST.latest_counts(spark, out_dir)


@register("stream_redelivered", O.with_ctes(("r1", O.R1)) + """
SELECT split, error_type, count(*) AS n FROM r1 GROUP BY ALL
""")
def stream_redelivered(spark, sf_dir):
    """Verdict files of which every third is delivered twice; a verdict counts once."""
    runs_dir, out_dir, ck = (scratch_path(spark, n) for n in ("stream-in", "stream-out", "stream-ck"))
    cols = [f.name for f in ST.STREAM_VERDICTS.fields]
    rows = (X.r1_rows(spark, sf_dir).withColumn("answer_id", F.col("event_id")).withColumn("check_id", F.lit(0).cast("long"))
            .select(*cols, F.pmod(F.xxhash64("event_id"), F.lit(6)).alias("file")))
    for again in (rows, rows.where("file % 3 = 0")):
        again.repartition(6, "file").drop("file").write.mode("append").json(runs_dir)
    # The verdicts span 30 days, and any file may come first.
    ST.stream_error_counts(spark, runs_dir, out_dir, ck, max_files_per_trigger=4, redelivery="60 days").awaitTermination()
    return ST.latest_counts(spark, out_dir)


@register("replay_latest", O.with_ctes(("r1", O.R1), ("v1", O.V1)) + """
SELECT step, error_type, n FROM v1 WHERE step = (SELECT max(step) FROM v1)
""")
def replay_latest(spark, sf_dir):
    metrics_dir, state_dir, ck = (scratch_path(spark, n) for n in ("metrics-in", "metrics-state", "metrics-ck"))
    # Metric rows arrive as several files, a few steps each.
    X.v1_metrics(spark, sf_dir).repartition(4, "step").write.json(metrics_dir)
    q = ST.stream_latest_metrics(spark, metrics_dir, state_dir, ck, max_files_per_trigger=1)
    q.awaitTermination()
    return ST.current_state(spark, state_dir)


@register("latest_metrics", O.with_ctes(("r1", O.R1), ("v1", O.V1)) + """
SELECT step, error_type, n FROM v1 WHERE step = (SELECT max(step) FROM v1)
""")
def latest_metrics(spark, sf_dir):
    return ST.latest_metrics(X.v1_metrics(spark, sf_dir)).select("step", "error_type", "n")


@register("metrics_report", O.with_ctes(("r1", O.R1)) + """
, att AS (SELECT split, task_id, CAST(count(*) AS BIGINT) AS n, CAST(count_if(output = 'passed') AS BIGINT) AS c
          FROM r1 GROUP BY ALL),
ks AS (SELECT unnest([1, 5, 10]) AS k),
pt AS (SELECT split, n, c, k,
              CASE WHEN n - c < k THEN CAST(1.0 AS DOUBLE) WHEN c = 0 THEN CAST(0.0 AS DOUBLE)
                   ELSE 1.0 - list_reduce(list_transform(range(n - c + 1, n + 1), lambda i: 1.0 - k / i),
                                          lambda a, b: a * b) END AS p
       FROM att, ks),
pk AS (SELECT split, 'pass@' || CAST(k AS VARCHAR) AS metric, avg(p) AS value FROM pt
       GROUP BY split, k HAVING min(n) >= k),
av AS (SELECT split, 'avg_answer_length' AS metric,
              avg(CASE WHEN output = 'passed' THEN answer_length END) AS value FROM r1 GROUP BY split
       UNION ALL
       SELECT split, 'avg_time' AS metric, avg(CASE WHEN output = 'passed' THEN avg_time END) FROM r1 GROUP BY split),
er AS (SELECT split, 'error_count:' || error_type AS metric, CAST(count(*) AS DOUBLE) AS value FROM r1 GROUP BY ALL)
SELECT split, CAST(0 AS BIGINT) AS check_id, metric, round(value, 6) AS value
FROM (SELECT * FROM pk UNION ALL SELECT * FROM av UNION ALL SELECT * FROM er)
""")
def metrics_report(spark, sf_dir):
    from pairforge.operators import metrics as M
    path = scratch_path(spark, "metrics")
    m = M.metrics_long(X.r1_runs(spark, sf_dir)).withColumn("check_id", F.lit(0).cast("long"))
    IO.write_metrics(m, path)
    back = spark.read.schema("metric string, value double, split string, check_id long") \
                .option("basePath", path).json(path)
    return back.select("split", "check_id", "metric", r6("value").alias("value"))


@register("roundtrip_problems", O.with_ctes(("p1", O.P1_PROBLEMS)) + """
SELECT task_id, prompt, test, 'test' AS split FROM p1
""")
def roundtrip_problems(spark, sf_dir):
    src, table = scratch_path(spark, "problems-jsonl"), scratch_path(spark, "problems")
    X.p1_problems(spark, sf_dir).write.json(src)
    IO.ingest_jsonl(spark, src, "test", table)
    back = IO.read_problems(spark, table, splits=["test"])
    return back.select("task_id", "prompt", "test", "split")


@register("roundtrip_report", R2_MERGE + """
, before AS (SELECT split, count(DISTINCT task_id) AS total_prob, count(*) AS total_ans
             FROM averaged GROUP BY split),
after AS (SELECT split, count(DISTINCT task_id) AS filtered_prob, count(*) AS filtered_ans
          FROM kept GROUP BY split)
SELECT b.split, b.total_prob, b.total_ans,
       coalesce(a.filtered_prob, 0) AS filtered_prob, coalesce(a.filtered_ans, 0) AS filtered_ans,
       round(CAST(coalesce(a.filtered_prob, 0) AS DOUBLE) / b.total_prob * 100.0, 2) AS ratio_prob,
       round(CAST(coalesce(a.filtered_ans, 0) AS DOUBLE) / b.total_ans * 100.0, 2) AS ratio_ans
FROM before b LEFT JOIN after a ON a.split = b.split
""")
def roundtrip_report(spark, sf_dir):
    path = scratch_path(spark, "report")
    IO.write_report(merged(spark, sf_dir, "r2")["report"], path)
    schema = ("total_prob long, total_ans long, filtered_prob long, filtered_ans long, ratio_prob double, "
              "ratio_ans double, split string")
    back = spark.read.schema(schema).option("basePath", path).json(path)
    return back.select("split", "total_prob", "total_ans", "filtered_prob", "filtered_ans", "ratio_prob",
                       "ratio_ans")
