"""Registered queries: run metrics (attempts, pass@k, averages, error counts)."""


from pairforge.operators import metrics as M
from pairforge.plans import fixtures as X
from pairforge.plans import oracle_fixtures as O
from pairforge.plans.registry import r6, register

KS = (1, 5, 10, 20)

_PASSK_SQL = O.with_ctes(("r3", O.R3)) + """,
att AS (SELECT split, task_id, CAST(count(*) AS BIGINT) AS n, CAST(count_if(output = 'passed') AS BIGINT) AS c FROM r3 GROUP BY ALL),
ks AS (SELECT unnest([1, 5, 10, 20]) AS k),
pt AS (
  SELECT split, n, c, k,
         CASE WHEN n - c < k THEN CAST(1.0 AS DOUBLE)
              WHEN c = 0 THEN CAST(0.0 AS DOUBLE)
              ELSE 1.0 - list_reduce(list_transform(range(n - c + 1, n + 1), lambda i: 1.0 - k / i),
                                     lambda a, b: a * b) END AS p
  FROM att, ks)
SELECT split, k, round(avg(p), 6) AS pass_at_k FROM pt GROUP BY ALL
"""


@register("attempts_correct", O.with_ctes(("r1", O.R1)) + """
SELECT split, task_id, count(*) AS n, CAST(count_if(output = 'passed') AS BIGINT) AS c FROM r1 GROUP BY ALL
""")
def attempts_correct(spark, sf_dir):
    return M.attempts_and_correct(X.r1_rows(spark, sf_dir))


@register("pass_at_k", _PASSK_SQL)
def pass_at_k(spark, sf_dir):
    att = M.attempts_and_correct(X.r3_runs(spark, sf_dir))
    out = M.pass_at_k(att, KS, guarded=False)
    return out.select("split", "k", r6("pass_at_k").alias("pass_at_k"))


@register("pass_at_k_guarded", _PASSK_SQL + " HAVING min(n) >= k")
def pass_at_k_guarded(spark, sf_dir):
    att = M.attempts_and_correct(X.r3_runs(spark, sf_dir))
    out = M.pass_at_k(att, KS, guarded=True)
    return out.select("split", "k", r6("pass_at_k").alias("pass_at_k"))


@register("pass_time_length", O.with_ctes(("r1", O.R1)) + """
SELECT split,
       round(avg(CASE WHEN output = 'passed' THEN answer_length END), 6) AS avg_answer_length,
       round(avg(CASE WHEN output = 'passed' THEN avg_time END), 6) AS avg_time
FROM r1 GROUP BY ALL
""")
def pass_time_length(spark, sf_dir):
    out = M.pass_time_and_length(X.r1_rows(spark, sf_dir))
    return out.select("split", r6("avg_answer_length").alias("avg_answer_length"),
                      r6("avg_time").alias("avg_time"))


@register("error_counts", O.with_ctes(("r1", O.R1)) + """
SELECT split, error_type, count(*) AS n FROM r1 GROUP BY ALL
""")
def error_counts(spark, sf_dir):
    return M.error_counts(X.r1_rows(spark, sf_dir))
