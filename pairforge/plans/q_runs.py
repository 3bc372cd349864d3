"""Registered queries: annotation, verdict rules, ids, sampling plan, joins."""

import json

from pyspark.sql import functions as F

from pairforge.functions.text import strip_text
from pairforge.operators import annotate as A
from pairforge.operators import runs as R
from pairforge.plans import fixtures as X
from pairforge.plans import oracle_fixtures as O
from pairforge.plans.q_text import SYS_HEAD, SYS_TAIL, sql_strip
from pairforge.plans.registry import r6, register

TIMING_LIMIT = 0.5
TIMEOUT_LIMIT = 20.0


def props_number(row):
    """The number k of an answer, which is JSON; k < 10 and k >= 90 fail."""
    k = json.loads(row["answer"])["k"]
    if k < 10:
        raise ValueError(f"k={k} too small")
    if k >= 90:
        raise KeyError(f"k={k}")
    return k


def props_verifier(row):
    """R4 verifier (see ``props_number``)."""
    props_number(row)


@register("annotate", O.with_ctes(("r4", O.R4)) + """
, k AS (SELECT *, CAST(json_extract(answer, '$.k') AS BIGINT) AS k FROM r4)
SELECT task_id, answer_id,
       CASE WHEN k < 10 OR k >= 90 THEN 'failed' ELSE 'passed' END AS output,
       CASE WHEN k < 10 THEN 'ValueError' WHEN k >= 90 THEN 'KeyError' ELSE '' END AS error_type
FROM k
""")
def annotate(spark, sf_dir):
    v = A.annotate(X.r4_candidates(spark, sf_dir), props_verifier)
    return v.select("task_id", "answer_id", "output", "error_type")


def _stdio_cases(spark, sf_dir):
    ch = X.ch_chat(spark, sf_dir)
    got = F.when((F.col("conv_id") + F.col("turn")) % 7 == 0,
                 F.concat(F.col("answer"), F.lit("\n"))).otherwise(F.col("answer"))
    return ch.select(F.col("conv_id").alias("task_id"), F.lit(0).cast("long").alias("answer_id"),
                     F.col("turn").alias("case"), F.col("prompt").alias("input"),
                     F.col("answer").alias("want"), got.alias("got"))


@register("stdio_verdict_arrays", O.with_ctes(("ch", O.CH)) + """
, a AS (SELECT conv_id AS task_id, turn AS answer_id, string_split(answer, chr(10)) AS want, CAST((conv_id + turn) % 5 AS BIGINT) AS kind FROM ch),
g AS (SELECT *, CASE WHEN kind = 1 THEN list_append(want, '') WHEN kind = 2 AND len(want) > 1 THEN want[1:len(want) - 1]
                     WHEN kind = 3 THEN list_prepend(want[1] || ' ', want[2:]) ELSE want END AS got FROM a)
SELECT task_id, answer_id, len(want) AS n_cases, CASE WHEN got = want THEN 'passed' ELSE 'failed' END AS output,
       CASE WHEN got = want THEN '' ELSE 'AssertionError' END AS error_type
FROM g
""")
def stdio_verdict_arrays(spark, sf_dir):
    """Verdicts where a problem carries its cases inline: expected lines of a reply against captured ones, some with a
    line too many, one too few, or another first line."""
    rows = X.ch_chat(spark, sf_dir).select(F.col("conv_id").alias("task_id"), F.col("turn").alias("answer_id"),
                                           F.split("answer", "\n", -1).alias("want"), ((F.col("conv_id") + F.col("turn")) % 5).alias("kind"))
    n, want = F.size("want"), F.col("want")
    first = F.array(F.concat(F.get("want", F.lit(0)), F.lit(" ")))
    got = (F.when(F.col("kind") == 1, F.array_append("want", F.lit("")))
            .when((F.col("kind") == 2) & (n > 1), F.slice("want", F.lit(1), n - 1))
            .when(F.col("kind") == 3, F.concat(first, F.slice("want", F.lit(2), n))).otherwise(want))
    v = R.stdio_verdict_arrays(rows.withColumn("got", got))
    return v.select("task_id", "answer_id", n.cast("long").alias("n_cases"), "output", "error_type")


@register("stdio_verdict", O.with_ctes(("ch", O.CH)) + """
, cases AS (SELECT conv_id AS task_id, CAST(0 AS BIGINT) AS answer_id, turn AS "case", answer AS want,
                   CASE WHEN (conv_id + turn) % 7 = 0 THEN answer || chr(10) ELSE answer END AS got FROM ch)
SELECT task_id, answer_id, count(*) AS n_cases,
       min(CASE WHEN got IS DISTINCT FROM want THEN "case" END) AS first_failed_case,
       CASE WHEN min(CASE WHEN got IS DISTINCT FROM want THEN "case" END) IS NULL THEN 'passed' ELSE 'failed' END
         AS output,
       CASE WHEN min(CASE WHEN got IS DISTINCT FROM want THEN "case" END) IS NULL THEN '' ELSE 'AssertionError' END
         AS error_type
FROM cases GROUP BY ALL
""")
def stdio_verdict(spark, sf_dir):
    return R.stdio_verdict(_stdio_cases(spark, sf_dir)).select(
        "task_id", "answer_id", "n_cases", "first_failed_case", "output", "error_type")


@register("stable_timing", O.with_ctes(("tm", O.TM)) + f"""
, per_round AS (
  SELECT candidate, round, avg(ns) AS avg_time, stddev_pop(ns) AS std_time,
         stddev_pop(ns) / avg(ns) AS cov
  FROM tm GROUP BY ALL),
keyed AS (
  SELECT *, coalesce(cov <= {TIMING_LIMIT}, false) AS stable,
         count(*) OVER (PARTITION BY candidate) AS n_rounds,
         CASE WHEN coalesce(cov <= {TIMING_LIMIT}, false) THEN round ELSE {R.ROUND_KEY_OFFSET} - round END AS k
  FROM per_round)
SELECT candidate, round, round(avg_time, 6) AS avg_time, round(std_time, 6) AS std_time,
       round(cov, 6) AS cov, stable, n_rounds
FROM keyed QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY k) = 1
""")
def stable_timing(spark, sf_dir):
    t = R.stable_timing(X.tm_timings(spark, sf_dir), limit=TIMING_LIMIT)
    return t.select("candidate", "round", r6("avg_time").alias("avg_time"), r6("std_time").alias("std_time"),
                    r6("cov").alias("cov"), "stable", "n_rounds")


@register("timeout_verdict", O.with_ctes(("r1", O.R1)) + f"""
, v AS (SELECT * FROM r1 WHERE error_type <> 'error'),
j AS (SELECT c.split, c.task_id, c.answer_id, v.output, v.avg_time, v.error_type FROM r1 c
      LEFT JOIN v ON v.task_id = c.task_id AND v.answer_id = c.answer_id)
SELECT split, task_id, answer_id,
       CASE WHEN output IS NULL OR (output = 'passed' AND avg_time > {TIMEOUT_LIMIT}) THEN 'failed'
            ELSE output END AS output,
       CASE WHEN output IS NULL THEN 'UnknownError'
            WHEN output = 'passed' AND avg_time > {TIMEOUT_LIMIT} THEN 'TimeoutError'
            ELSE error_type END AS error_type,
       CASE WHEN output = 'passed' AND avg_time > {TIMEOUT_LIMIT} THEN NULL ELSE round(avg_time, 6) END
         AS avg_time
FROM j
""")
def timeout_verdict(spark, sf_dir):
    r1 = X.r1_runs(spark, sf_dir)
    cand = r1.select("split", "task_id", "answer_id")
    verdicts = r1.filter(F.col("error_type") != "error")
    v = R.timeout_verdict(R.fill_unknown(cand, verdicts), TIMEOUT_LIMIT)
    return v.select("split", "task_id", "answer_id", "output", "error_type", r6("avg_time").alias("avg_time"))


@register("answer_id", O.with_ctes(("r1", O.R1)) + """
SELECT split, task_id, event_id, answer_id FROM r1
""")
def answer_id(spark, sf_dir):
    return X.r1_runs(spark, sf_dir).select("split", "task_id", "event_id", "answer_id")


N_ITER, N_SEQ = 1, 10


@register("sampling_plan", O.with_ctes(("p1", O.P1_PROBLEMS)) + f"""
SELECT task_id, {SYS_HEAD} || {sql_strip('prompt')} || {SYS_TAIL} AS request,
       CAST(i.iter AS BIGINT) AS iter, CAST(s.seq AS BIGINT) AS seq
FROM p1, (SELECT unnest(range(0, {N_ITER})) AS iter) i, (SELECT unnest(range(0, {N_SEQ})) AS seq) s
""")
def sampling_plan(spark, sf_dir):
    return R.sampling_plan(X.p1_problems(spark, sf_dir), N_ITER, N_SEQ).select("task_id", "request", "iter", "seq")


@register("orphan_samples", O.with_ctes(("p1", O.P1_PROBLEMS), ("s1", O.P1_SAMPLES)) + """
SELECT task_id, count(*) AS n_samples FROM s1 WHERE task_id NOT IN (SELECT task_id FROM p1) GROUP BY ALL
""")
def orphan_samples(spark, sf_dir):
    return R.orphan_samples(X.p1_samples(spark, sf_dir), X.p1_problems(spark, sf_dir))


@register("join_problems", O.with_ctes(("p1", O.P1_PROBLEMS), ("s1", O.P1_SAMPLES)) + f"""
, ids AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY pos) - 1 AS answer_id FROM s1)
SELECT i.task_id, i.answer_id, {sql_strip('p.prompt')} AS prompt, i.answer
FROM ids i JOIN p1 p ON p.task_id = i.task_id
""")
def join_problems(spark, sf_dir):
    s = R.answer_ids(X.p1_samples(spark, sf_dir))
    j = R.join_problems(s, X.p1_problems(spark, sf_dir))
    return j.select("task_id", "answer_id", strip_text("prompt").alias("prompt"), "answer")
