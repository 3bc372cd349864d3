"""Registered queries: the merge stage (frequency, averaging, scoring,
dedupe, contrastive filter, ranking, type order, time stats, nesting)."""

from pyspark.sql import functions as F

from pairforge.functions.text import sql_literal
from pairforge.operators import checks as C
from pairforge.operators import merge as G
from pairforge.operators.ranked_store import save_store
from pairforge.operators.texts import with_digests
from pairforge.plans import fixtures as X
from pairforge.plans import oracle_fixtures as O
from pairforge.plans.registry import r6, register
from pairforge.session import scratch_path

R1_MERGE = O.merge_over("SELECT * FROM r1", ("r1", O.R1))
R2_MERGE = O.merge_over(O.R2)


def merged(spark, sf_dir, which="r1"):
    if which == "r1":
        return G.merge_runs(X.r1_runs(spark, sf_dir), raw=X.r1_rows(spark, sf_dir))
    documents = with_digests(X.table(spark, sf_dir, "documents"), ["text"], ["text"], ["text"])
    return G.merge_runs(X.r2_runs(spark, sf_dir), digested=X.r2_runs(spark, sf_dir, documents))


_STAGES: dict = {}


def _stage(spark, sf_dir, name, build):
    """A stage's tables, written once per session and input folder and read by every query downstream of the stage."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    if key not in _STAGES:
        _STAGES[key] = build()
    return _STAGES[key]


def stage_merge(spark, sf_dir, which="r1"):
    """The merge stage of a fixture, for the pair builders after it."""
    return _stage(spark, sf_dir, f"merge {which}", lambda: merged(spark, sf_dir, which))


def stage_store(spark, sf_dir, which="r1"):
    """The ranked store of a fixture, for the schedules after the merge stage."""
    def build():
        m = stage_merge(spark, sf_dir, which)
        return save_store(m.slim.ranked, texts=m.texts)
    return _stage(spark, sf_dir, f"store {which}", build)


@register("error_frequency", R1_MERGE + """
SELECT split, task_id, error_type, round(frequency, 6) AS frequency FROM freq
""")
def error_frequency(spark, sf_dir):
    f = G.error_frequency(X.r1_rows(spark, sf_dir))
    return f.select("split", "task_id", "error_type", r6("frequency").alias("frequency"))


@register("average_checks", O.merge_over("SELECT * FROM r1x2", ("r1", O.R1), ("r1x2", O.R1X2)) + """
SELECT split, task_id, answer_id, answer, output, error_type,
       round(avg_time, 6) AS avg_time, round(std_time, 6) AS std_time
FROM averaged
""")
def average_checks(spark, sf_dir):
    a = G.merge_runs(X.r1x2_runs(spark, sf_dir)).averaged
    return a.select("split", "task_id", "answer_id", "answer", "output", "error_type",
                    r6("avg_time").alias("avg_time"), r6("std_time").alias("std_time"))


@register("length_sentinel", R1_MERGE + """
SELECT split, task_id, answer_id, answer_length, round(error_frequency, 6) AS error_frequency FROM scored
""")
def length_sentinel(spark, sf_dir):
    s = merged(spark, sf_dir).slim["scored"]
    return s.select("split", "task_id", "answer_id", "answer_length",
                    r6("error_frequency").alias("error_frequency"))


@register("dedupe_keep_best", R1_MERGE + """
SELECT split, task_id, answer_id, answer, round(error_frequency, 6) AS error_frequency, answer_length
FROM deduped
""")
def dedupe_keep_best(spark, sf_dir):
    d = merged(spark, sf_dir)["deduped"]
    return d.select("split", "task_id", "answer_id", "answer",
                    r6("error_frequency").alias("error_frequency"), "answer_length")


@register("dedupe_keep_best_docs", R2_MERGE + """
SELECT split, task_id, answer_id, round(error_frequency, 6) AS error_frequency, answer_length
FROM deduped
""")
def dedupe_keep_best_docs(spark, sf_dir):
    d = merged(spark, sf_dir, "r2").slim["deduped"]
    return d.select("split", "task_id", "answer_id", r6("error_frequency").alias("error_frequency"),
                    "answer_length")


@register("keep_contrastive", R2_MERGE + """
SELECT split, task_id, answer_id, error_type FROM kept
""")
def keep_contrastive(spark, sf_dir):
    return merged(spark, sf_dir, "r2").slim["kept"].select("split", "task_id", "answer_id", "error_type")


_REPORT_SQL = """
, before AS (SELECT split, count(DISTINCT task_id) AS total_prob, count(*) AS total_ans
             FROM averaged GROUP BY split),
after AS (SELECT split, count(DISTINCT task_id) AS filtered_prob, count(*) AS filtered_ans
          FROM kept GROUP BY split)
SELECT b.split, b.total_prob, b.total_ans,
       coalesce(a.filtered_prob, 0) AS filtered_prob, coalesce(a.filtered_ans, 0) AS filtered_ans,
       round(CAST(coalesce(a.filtered_prob, 0) AS DOUBLE) / b.total_prob * 100.0, 2) AS ratio_prob,
       round(CAST(coalesce(a.filtered_ans, 0) AS DOUBLE) / b.total_ans * 100.0, 2) AS ratio_ans
FROM before b LEFT JOIN after a ON a.split = b.split
"""


@register("filter_report", R2_MERGE + _REPORT_SQL)
def filter_report(spark, sf_dir):
    return merged(spark, sf_dir, "r2")["report"]


@register("filter_report_runs", R1_MERGE + _REPORT_SQL)
def filter_report_runs(spark, sf_dir):
    return merged(spark, sf_dir, "r1")["report"]


@register("rank_answers", R2_MERGE + """
SELECT split, task_id, answer_id, rank, side_rank, is_pass FROM ranked
""")
def rank_answers(spark, sf_dir):
    return merged(spark, sf_dir, "r2").slim["ranked"].select(
        "split", "task_id", "answer_id", "rank", "side_rank", "is_pass")


@register("rank_answers_runs", R1_MERGE + """
SELECT split, task_id, answer_id, rank, side_rank, is_pass FROM ranked
""")
def rank_answers_runs(spark, sf_dir):
    return merged(spark, sf_dir, "r1").slim["ranked"].select(
        "split", "task_id", "answer_id", "rank", "side_rank", "is_pass")


@register("error_type_order", R1_MERGE + """
, per_type AS (
  SELECT split, task_id, error_type, min(rank) AS first_rank, count(*) AS type_count
  FROM ranked WHERE NOT is_pass GROUP BY ALL)
SELECT split, task_id, error_type, type_count,
       row_number() OVER (PARTITION BY split, task_id ORDER BY first_rank) - 1 AS type_order,
       CAST(coalesce(sum(type_count) OVER (PARTITION BY split, task_id ORDER BY first_rank
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS type_start
FROM per_type
""")
def error_type_order(spark, sf_dir):
    r = merged(spark, sf_dir, "r1").slim["ranked"]
    return G.error_type_order(r).select("split", "task_id", "error_type", "type_count",
                                        "type_order", "type_start")


@register("time_stats", R1_MERGE + """
SELECT split, task_id, CAST(count_if(error_frequency = 0) AS BIGINT) AS count,
       round(avg(avg_time), 6) AS avg, round(stddev_samp(avg_time), 6) AS std,
       round(stddev_samp(avg_time) / avg(avg_time), 6) AS cov
FROM kept GROUP BY ALL
""")
def time_stats(spark, sf_dir):
    t = merged(spark, sf_dir, "r1")["times"]
    return t.select("split", "task_id", "count", r6("avg").alias("avg"), r6("std").alias("std"),
                    r6("cov").alias("cov"))


@register("nest_answers", R2_MERGE + """
, times AS (
  SELECT split, task_id, CAST(count_if(error_frequency = 0) AS BIGINT) AS count, round(avg(avg_time), 6) AS avg,
         round(stddev_samp(avg_time), 6) AS std, round(stddev_samp(avg_time) / avg(avg_time), 6) AS cov
  FROM kept GROUP BY ALL)
SELECT n.split, n.task_id AS id, n.prompt AS problem, n.rank, md5(n.answer) AS text_md5, n.error_type,
       n.answer_length, round(n.error_frequency, 6) AS error_frequency,
       t.count AS time_count, t.avg AS time_avg, t.std AS time_std, t.cov AS time_cov
FROM ranked n LEFT JOIN times t ON n.split = t.split AND n.task_id = t.task_id
""")
def nest_answers(spark, sf_dir):
    m = merged(spark, sf_dir, "r2")
    nest = G.nest_answers(m["ranked"], m["times"])
    return nest.select(
        "split", "id", "problem", "rank", F.md5("answer.text").alias("text_md5"),
        F.col("answer.error_type").alias("error_type"), F.col("answer.answer_length").alias("answer_length"),
        r6("answer.error_frequency").alias("error_frequency"),
        F.col("time.count").alias("time_count"), r6("time.avg").alias("time_avg"),
        r6("time.std").alias("time_std"), r6("time.cov").alias("time_cov"))


def _report_lines_sql() -> str:
    """The report's lines from its labels (``merge.REPORT_LINES``)."""
    rows = []
    for i, (label, col, dec) in enumerate(G.REPORT_LINES):
        value = "''" if col is None else f"CAST({col} AS VARCHAR)" if dec is None else f"printf('%.{dec}f', {col})"
        rows.append(f"SELECT split, CAST({i} AS BIGINT) AS line_no, {sql_literal(label)} || {value} AS line FROM rep")
    return "\nUNION ALL ".join(rows)


@register("report_text", R1_MERGE + _REPORT_SQL.replace("SELECT b.split,", ", rep AS (SELECT b.split,", 1) + ")\n" + _report_lines_sql())
def report_text(spark, sf_dir):
    path = scratch_path(spark, "report-text")
    G.write_report_text(merged(spark, sf_dir, "r1")["report"], path)
    # One small file per split: its line numbers come from the file itself.
    whole = spark.read.option("basePath", path).text(path, wholetext=True)
    lines = whole.select("split", F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("line_no", "line"))
    return lines.select("split", F.col("line_no").cast("long").alias("line_no"), "line")


def _check_by_check(spark, sf_dir):
    """States of R1's two checks, added one after the other; check 0 is added twice, as after a retry."""
    path, runs = scratch_path(spark, "checks"), X.r1x2_runs(spark, sf_dir)
    for check in (0, 0, 1):
        C.add_check(runs.filter(F.col("check_id") == check), path)
    return path


_X2 = O.merge_over("SELECT * FROM r1x2", ("r1", O.R1), ("r1x2", O.R1X2))


@register("checks_added_average", _X2 + """
SELECT split, task_id, answer_id, answer, output, error_type,
       round(avg_time, 6) AS avg_time, round(std_time, 6) AS std_time
FROM averaged
""")
def checks_added_average(spark, sf_dir):
    a = C.averaged_checks(spark, _check_by_check(spark, sf_dir))
    return a.select("split", "task_id", "answer_id", "answer", "output", "error_type",
                    r6("avg_time").alias("avg_time"), r6("std_time").alias("std_time"))


@register("checks_added_frequency", _X2 + """
SELECT split, task_id, error_type, round(frequency, 6) AS frequency FROM freq
""")
def checks_added_frequency(spark, sf_dir):
    f = C.checked_frequency(spark, _check_by_check(spark, sf_dir))
    return f.select("split", "task_id", "error_type", r6("frequency").alias("frequency"))
