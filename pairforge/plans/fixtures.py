"""Fixture views over the given test tables (see FIXTURES.md section 2).

Each builder reads whole tables and derives a table with the shape the
operators expect; ``pairforge.plans.oracle`` holds the DuckDB twin of
each one. Nothing here is sampled or capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.operators.ranking import group_rank


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def r1_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict rows from ``events`` without answer ids: one task per user, a purchase passes."""
    ev = table(spark, sf_dir, "events")
    passed = F.col("event_type") == "purchase"
    task = F.col("user_id").cast("string")
    answer = F.concat_ws("|", "event_type", "props", (F.col("user_id") % 25).cast("string"))
    return ev.select(
        task.alias("task_id"),
        F.when(F.col("user_id") % 5 == 0, "validation").otherwise("train").alias("split"),
        "event_id", "ts",
        F.concat(F.lit("task "), task).alias("prompt"),
        answer.alias("answer"),
        F.when(passed, "passed").otherwise("failed").alias("output"),
        F.when(passed, F.lit("")).otherwise(F.col("event_type")).alias("error_type"),
        F.when(passed, F.col("value")).alias("avg_time"),
        F.when(passed, F.col("value") * 0.05).alias("std_time"),
        F.when(passed, F.length(answer).cast("long")).alias("answer_length"),
        F.when(~passed, F.concat(F.lit("Traceback: "), F.col("event_type"), F.lit(" at event "),
                                 F.col("event_id").cast("string"))).alias("error_trace"),
    )


def r1_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 with answer ids: the order of a task's events, cut into days."""
    return group_rank(r1_rows(spark, sf_dir), ["split", "task_id"], ["ts", "event_id"], name="answer_id",
                      blocks=[F.to_date("ts")])


def r1x2_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 checked twice: check 1 has all times scaled by 1.1."""
    r1 = r1_runs(spark, sf_dir)
    c0 = r1.withColumn("check_id", F.lit(0).cast("long"))
    c1 = (r1.withColumn("check_id", F.lit(1).cast("long"))
            .withColumn("avg_time", F.col("avg_time") * 1.1)
            .withColumn("std_time", F.col("std_time") * 1.1))
    return c0.unionByName(c1)


def r2_runs(spark: SparkSession, sf_dir: str, documents: DataFrame | None = None) -> DataFrame:
    """Verdict rows from labelled documents: task = source/lang, pass = good and clean.

    ``documents`` may be that table with digests for its texts (``texts.with_digests``): the rows are the same, with
    digests for answers and the columns beside them, and no text goes through the join."""
    docs = documents if documents is not None else table(spark, sf_dir, "documents")
    beside = [c for c in ("text_chars", "text_hash") if c in docs.columns]
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars", *beside)
    labels = table(spark, sf_dir, "labels")
    j = docs.join(labels, "doc_id")
    passed = (F.col("quality") == 1) & (F.col("toxic") == 0)
    task = F.concat(F.col("source"), F.lit("/"), F.col("lang"))
    return j.select(
        F.lit("train").alias("split"),
        task.alias("task_id"),
        F.col("doc_id").alias("answer_id"),
        F.concat(F.lit("write "), task).alias("prompt"),
        F.col("text").alias("answer"),
        F.when(passed, "passed").otherwise("failed").alias("output"),
        F.when(passed, F.lit(""))
         .when((F.col("quality") == 0) & (F.col("toxic") == 1), "Both")
         .when(F.col("toxic") == 1, "Toxic")
         .otherwise("LowQuality").alias("error_type"),
        F.when(passed, F.col("n_chars") / 1000.0).alias("avg_time"),
        F.when(passed, F.col("n_chars") / 1000.0 * 0.1).alias("std_time"),
        F.when(passed, F.col("text_chars") if beside else F.length("text").cast("long")).alias("answer_length"),
        F.lit(None).cast("string").alias("error_trace"),
        *[F.col(c).alias(c.replace("text", "answer")) for c in beside],
    )


def r3_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts from ``lineitem``: one task per part, a fixed predicate passes."""
    li = table(spark, sf_dir, "lineitem")
    ok = ((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O")
          & (F.col("l_linenumber") <= 2))
    return li.select(F.lit("all").alias("split"),
                     F.col("l_partkey").cast("string").alias("task_id"),
                     F.when(ok, "passed").otherwise("failed").alias("output"))


def r4_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for the verifier: the JSON ``props`` of each event is the answer."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("user_id").cast("string").alias("task_id"),
                     F.col("event_id").alias("answer_id"),
                     F.concat(F.lit("task "), F.col("user_id").cast("string")).alias("prompt"),
                     F.col("props").alias("answer"))


def v1_metrics(spark: SparkSession, sf_dir: str, r1: DataFrame | None = None) -> DataFrame:
    """Validation error counts per step (= day of the event), long form."""
    r1 = (r1 if r1 is not None else r1_rows(spark, sf_dir)).filter(F.col("split") == "validation")
    step = F.unix_date(F.to_date("ts")).cast("long")
    return (r1.groupBy(step.alias("step"), "error_type")
              .agg(F.count(F.lit(1)).alias("n")))


def tm_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated timings: candidate = supplier, round = line number, ns = price."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("candidate"),
                     F.col("l_linenumber").cast("long").alias("round"),
                     F.col("l_extendedprice").alias("ns"))


def x1_raw_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw generations: whole documents with stop strings put in their middle."""
    d = table(spark, sf_dir, "documents")
    tail = (F.when(F.col("doc_id") % 4 == 0, F.lit("\n```rest"))
             .when(F.col("doc_id") % 4 == 1, F.lit("\nprint(1)\n#x"))
             .when(F.col("doc_id") % 4 == 2, F.lit(""))
             .otherwise(F.lit("</s>z")))
    head = F.when(F.col("doc_id") % 10 == 0, F.lit("</s>")).otherwise(F.lit(""))
    half = F.floor(F.length("text") / 2).cast("int")
    return d.select("doc_id", F.concat(head, F.substr("text", F.lit(1), half), tail,
                                       F.substr("text", half + 1, F.length("text"))).alias("raw"))


def x2_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small programs from ``part``: an optional indented helper, then one top-level def."""
    p = table(spark, sf_dir, "part")
    name = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    helper = F.when(F.col("p_partkey") % 2 == 0,
                    F.concat(F.lit("  def inner_"), F.col("p_partkey").cast("string"),
                             F.lit("(y):\n    return y\n"))).otherwise(F.lit(""))
    body = F.concat(helper, F.lit("def "), name, F.lit("(x):\n  return "), F.col("p_size").cast("string"))
    code = F.when(F.col("p_partkey") % 7 == 0,
                  F.concat(F.lit("x = "), F.col("p_size").cast("string"))).otherwise(body)
    return p.select(F.col("p_partkey").alias("task_id"), code.alias("code"),
                    F.lit("assert True").alias("test"),
                    F.when(F.col("p_partkey") % 3 != 0, name).alias("entry_point"))


def ch_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(prompt, answer) from a user turn and the assistant turn right after it."""
    c = table(spark, sf_dir, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    a = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return u.join(a, ["conv_id", "turn"])


def p1_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").cast("string").alias("task_id"), F.col("text").alias("prompt"),
                    F.lit("assert True").alias("test"), F.lit(None).cast("string").alias("entry_point"))


def p1_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two samples per benchmark item; the second names item_id + 20, which
    points past the table for the last 20 items (orphans)."""
    b = table(spark, sf_dir, "benchmark")
    first = b.select(F.col("item_id").cast("string").alias("task_id"),
                     F.col("text").alias("answer"),
                     (F.col("item_id") * 2).alias("pos"))
    second = b.select((F.col("item_id") + 20).cast("string").alias("task_id"),
                      F.concat(F.lit("second "), F.col("text")).alias("answer"),
                      (F.col("item_id") * 2 + 1).alias("pos"))
    return first.unionByName(second)
