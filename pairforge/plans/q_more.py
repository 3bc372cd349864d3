"""Registered queries for the operators whose effect shows in a result of their
own: split choice, run tables, key types, constant columns, the emptiness
check, ordered counts, timing rounds and the rows of each split."""

from pyspark.sql import functions as F

from pairforge.functions.draws import sql_unit_draw
from pairforge.operators import annotate as A
from pairforge.operators import merge as G
from pairforge.operators import metrics as M
from pairforge.operators import pairs as P
from pairforge.operators import runs as R
from pairforge.plans import fixtures as X
from pairforge.plans import oracle_fixtures as O
from pairforge.plans import stages as S
from pairforge.plans.q_merge import R2_MERGE, merged, stage_merge
from pairforge.plans.q_runs import props_number
from pairforge.plans.registry import r6, register
from pairforge.session import scratch_path
from pairforge.sources import io as IO

SEED = 7


@register("select_splits", O.with_ctes(("p1", O.P1_PROBLEMS)) + """
SELECT s.split, task_id, prompt FROM p1, (SELECT unnest(['train', 'validation']) AS split) s
""")
def select_splits(spark, sf_dir):
    """Three ingested splits; the stage keeps the two it trains on."""
    src, table = scratch_path(spark, "splits-jsonl"), scratch_path(spark, "splits")
    X.p1_problems(spark, sf_dir).write.json(src)
    for split in ("train", "test", "validation"):
        IO.ingest_jsonl(spark, src, split, table)
    return IO.select_splits(IO.read_problems(spark, table), eval_mode=False).select("split", "task_id", "prompt")


@register("run_table", O.with_ctes(("r1", O.R1)) + """
, c AS (SELECT split, error_type, count(*) AS n FROM r1 GROUP BY ALL)
SELECT split, error_type, n, m.method, '5' AS epochs FROM c, (SELECT unnest(['pvf', 'pvf_iter']) AS method) m
""")
def run_table(spark, sf_dir):
    """Outputs of two configurations in one table, the first written twice."""
    path = scratch_path(spark, "run-table")
    counts = M.error_counts(X.r1_rows(spark, sf_dir))
    for method in ("pvf", "pvf_iter", "pvf"):
        IO.write_run_table(IO.run_layout(counts, method=method, epochs=5), path)
    return IO.read_run_table(spark, path).select("split", "error_type", "n", "method", "epochs")


@register("align_key_type", O.with_ctes(("p1", O.P1_PROBLEMS), ("s1", O.P1_SAMPLES)) + """
SELECT s1.task_id, s1.pos, p1.prompt FROM s1 JOIN p1 ON p1.task_id = s1.task_id
""")
def align_key_type(spark, sf_dir):
    samples = X.p1_samples(spark, sf_dir)
    problems = X.p1_problems(spark, sf_dir).withColumn("task_id", F.col("task_id").cast("long"))
    return R.join_problems(samples, R.align_key_type(problems, samples)).select("task_id", "pos", "prompt")


@register("constant_columns", R2_MERGE + """
SELECT split, task_id AS id, answer_id, '' AS prompt, '' AS chosen, '' AS rejected FROM ranked
""")
def constant_columns(spark, sf_dir):
    rows = merged(spark, sf_dir, "r2").slim["ranked"].select("split", F.col("task_id").alias("id"), "answer_id", "prompt")
    return P.constant_columns(rows)


@register("assert_non_empty", R2_MERGE + """
SELECT 'kept' AS which, count(*) AS n, CAST(NULL AS VARCHAR) AS message FROM kept
UNION ALL SELECT 'passing only', count(*), 'No available samples.' FROM kept WHERE error_frequency = 0 AND output <> 'passed'
""")
def assert_non_empty(spark, sf_dir):
    """The check on a table with rows and on one without."""
    kept = merged(spark, sf_dir, "r2").slim["kept"]
    out = None
    for which, df in (("kept", kept), ("passing only", kept.filter("error_frequency = 0 AND output <> 'passed'"))):
        try:
            G.assert_non_empty(df)
            message = None
        except ValueError as e:
            message = str(e)
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(which).alias("which"), "n", F.lit(message).cast("string").alias("message"))
        out = row if out is None else out.unionByName(row)
    return out


@register("error_counts_ordered", O.with_ctes(("r1", O.R1)) + """
, c AS (SELECT split, error_type, count(*) AS n FROM r1 GROUP BY ALL)
SELECT split, error_type, n, row_number() OVER (PARTITION BY split ORDER BY n DESC, error_type) - 1 AS position FROM c
""")
def error_counts_ordered(spark, sf_dir):
    return M.ordered_error_counts(X.r1_rows(spark, sf_dir))


ROUNDS, REPS = 3, 2


def timed_verifier():
    """A verifier with known timings: the first k % 4 rounds of an answer swing, later ones are steady."""
    calls: dict = {}

    def verify(row):
        k = props_number(row)
        if k == 89:
            return 2_000_000_000
        key = (row["task_id"], row["answer_id"])
        n = calls[key] = calls.get(key, -1) + 1
        return (1000, 3000)[n % REPS] if n // REPS < k % 4 else 1000 * (k + 1)
    return verify


@register("annotate_rounds", O.with_ctes(("r4", O.R4)) + f"""
, k AS (SELECT *, CAST(json_extract(answer, '$.k') AS BIGINT) AS k FROM r4),
v AS (SELECT *, k < 10 OR k >= 90 AS raised, k = 89 AS slow, k % 4 >= {ROUNDS} AS swings FROM k)
SELECT task_id, answer_id, CASE WHEN raised OR slow THEN 'failed' ELSE 'passed' END AS output,
       CASE WHEN k < 10 THEN 'ValueError' WHEN k >= 90 THEN 'KeyError' WHEN slow THEN 'TimeoutError' ELSE '' END AS error_type,
       CASE WHEN raised OR slow THEN NULL WHEN swings THEN 2000.0 ELSE 1000.0 * (k + 1) END::DOUBLE AS avg_time,
       CASE WHEN raised OR slow THEN NULL WHEN swings THEN 1000.0 ELSE 0.0 END::DOUBLE AS std_time,
       CASE WHEN raised THEN 0 WHEN slow THEN 1 ELSE least(k % 4 + 1, {ROUNDS}) END::BIGINT AS n_rounds
FROM v
""")
def annotate_rounds(spark, sf_dir):
    v = A.annotate(X.r4_candidates(spark, sf_dir), timed_verifier(), rounds=ROUNDS, reps=REPS)
    return v.select("task_id", "answer_id", "output", "error_type", r6("avg_time").alias("avg_time"),
                    r6("std_time").alias("std_time"), "n_rounds")


def resumed_verifier():
    """As ``timed_verifier``, over passes: an answer with k = 50 is never steady."""
    calls: dict = {}

    def verify(row):
        k = props_number(row)
        if k == 89:
            return 2_000_000_000
        key = (row["task_id"], row["answer_id"], row["rounds_before"])
        n = calls[key] = calls.get(key, -1) + 1
        turn = row["rounds_before"] + n // A.REPETITIONS
        return (1000, 3000)[n % 2] if k == 50 or turn < k % 12 else 1000 * (k + 1)
    return verify


@register("annotate_frontier", O.with_ctes(("r4", O.R4)) + f"""
, k AS (SELECT *, CAST(json_extract(answer, '$.k') AS BIGINT) AS k FROM r4),
v AS (SELECT *, k < 10 OR k >= 90 AS raised, k = 89 AS slow, k = 50 AS swings FROM k)
SELECT task_id, answer_id, CASE WHEN raised OR slow THEN 'failed' ELSE 'passed' END AS output,
       CASE WHEN k < 10 THEN 'ValueError' WHEN k >= 90 THEN 'KeyError' WHEN slow THEN 'TimeoutError' ELSE '' END AS error_type,
       CASE WHEN raised OR slow THEN NULL WHEN swings THEN 2000.0 ELSE 1000.0 * (k + 1) END::DOUBLE AS avg_time,
       CASE WHEN raised OR slow THEN NULL WHEN swings THEN 1000.0 ELSE 0.0 END::DOUBLE AS std_time,
       CASE WHEN raised THEN 0 WHEN slow THEN 1 WHEN swings THEN {A.MAX_ROUNDS} ELSE k % 12 + 1 END::BIGINT AS n_rounds
FROM v
""")
def annotate_frontier(spark, sf_dir):
    """The reference's timing (100 rounds of 10 calls at most); unsteady candidates go on in the next pass."""
    v = A.annotate_frontier(X.r4_candidates(spark, sf_dir), resumed_verifier(), rounds_per_pass=25)
    return v.select("task_id", "answer_id", "output", "error_type", r6("avg_time").alias("avg_time"),
                    r6("std_time").alias("std_time"), "n_rounds")


def _u(tag):
    return sql_unit_draw(SEED, "split", "task_id", f"'{tag}'")


@register("training_rows", O.merge_over("SELECT * FROM r1", ("r1", O.R1)) + f"""
, t AS (SELECT *, CAST(floor({_u('chosen')} * n_pass) AS BIGINT) AS c_pos, CAST(floor({_u('rejected')} * n_fail) AS BIGINT) AS r_pos
        FROM (SELECT DISTINCT split, task_id, n_pass, n_fail FROM ranked WHERE split = 'validation'))
SELECT c.split, c.task_id AS id, c.answer_id AS chosen_id, r.answer_id AS rejected_id, md5(c.answer) AS chosen_md5,
       md5(r.answer) AS rejected_md5, c.side_rank * c.n_fail + r.side_rank AS pair_pos
FROM ranked c JOIN ranked r ON c.split = r.split AND c.task_id = r.task_id
WHERE c.is_pass AND NOT r.is_pass AND c.split = 'train'
UNION ALL
SELECT t.split, t.task_id, c.answer_id, r.answer_id, md5(c.answer), md5(r.answer), CAST(NULL AS BIGINT)
FROM t JOIN ranked c ON c.split = t.split AND c.task_id = t.task_id AND c.is_pass AND c.side_rank = t.c_pos
       JOIN ranked r ON r.split = t.split AND r.task_id = t.task_id AND NOT r.is_pass AND r.side_rank = t.r_pos
""")
def training_rows(spark, sf_dir):
    """All pairs of the training tasks, one fixed pair of each validation task."""
    rows = S.training_rows(stage_merge(spark, sf_dir, "r1")["ranked"], "passk", seed=SEED)
    return rows.select("split", "id", "chosen_id", "rejected_id", F.md5("chosen").alias("chosen_md5"),
                       F.md5("rejected").alias("rejected_md5"), "pair_pos")
