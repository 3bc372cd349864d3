"""The shared step of the queries after the merge: rows are shuffled once to be numbered, copies of texts go by hash."""

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from pairforge.operators.ranking import group_rank
from pairforge.operators.texts import dictionary, digest


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbered_rows_are_shuffled_once(spark, tmp_path):
    """One exchange of the rows and three of the block sizes; the join with the offsets had one more of the rows."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {n: spark.conf.get(n, None) for n in names}
    cols = "g string, d long, x double, pos long"
    data = [(g, None if i % 7 == 0 else i // 5, [0.0, -0.0, 1.5, None][i % 4], i) for g in ("a", "b", None) for i in range(40)]
    spark.createDataFrame(data, cols).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    order = [F.col(c).asc_nulls_first() for c in ("d", "x", "pos")]
    try:
        for n in names:
            spark.conf.set(n, "-1")
        got = group_rank(rows, ["g"], ["d", "x", "pos"], name="at", blocks=[F.col("d"), F.col("x")])
        whole = group_rank(rows, ["g"], ["d", "pos"], name="at", blocks=[F.col("d")])
        assert len(re.findall("Exchange hashpartitioning", plan_of(whole))) == 4
        want = rows.withColumn("at", (F.row_number().over(Window.partitionBy("g").orderBy(*order)) - 1).cast("long"))
        key = lambda df: sorted(((r.g, r.pos, r.at) for r in df.collect()), key=str)
        assert len(key(want)) == 120 and key(got) == key(want)
    finally:
        for n, v in old.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_copies_of_texts_are_combined_by_hash(spark):
    df = spark.createDataFrame([("p", "a"), ("p", "a"), (None, "p"), ("q", None)], "prompt string, answer string")
    texts = dictionary(df)
    assert re.findall(r"(\w+)Aggregate\(", plan_of(texts))[-1] == "Hash"
    want = sorted((r.t, bytes(r.d)) for r in spark.createDataFrame([("p",), ("a",), ("q",)], "t string").select("t", digest("t").alias("d")).collect())
    assert sorted((r.text, bytes(r.digest)) for r in texts.collect()) == want
