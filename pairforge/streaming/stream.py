"""Structured Streaming jobs over arriving verdicts and validation metrics.

Both jobs keep their state in Spark's state store and write through
``foreachBatch`` into batch-id-keyed folders, so a retried micro-batch
overwrites its own output (idempotent) and a restarted query resumes from its
checkpoint. No batch reads what earlier batches wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairforge import schemas as S

STREAM_RUNS = T.StructType(list(S.RUNS.fields) + [T.StructField("split", T.StringType())])
METRIC_ROWS = T.StructType([T.StructField("step", T.LongType()), T.StructField("error_type", T.StringType()),
                            T.StructField("n", T.LongType())])
# Verdicts that may be delivered more than once: what names a verdict, and when it was made.
VERDICT_KEY = ["split", "task_id", "answer_id", "check_id"]
STREAM_VERDICTS = T.StructType([*STREAM_RUNS.fields, T.StructField("check_id", T.LongType()), T.StructField("ts", T.TimestampType())])


def stream_error_counts(spark: SparkSession, runs_dir: str, out_dir: str, checkpoint: str,
                        available_now: bool = True, max_files_per_trigger: int | None = None,
                        redelivery: str | None = None):
    """Count verdicts per (split, error_type) as JSONL verdict files arrive.

    Stateful aggregation in update mode; every micro-batch writes the
    updated counts to ``out_dir/batch_id=<id>``. ``latest_counts`` reads
    the newest count per key. Returns the started query.

    With ``redelivery`` (an interval such as '2 days') rows also carry
    ``check_id`` and the time ``ts`` of the verdict, and a verdict (split, task,
    answer, check) that arrives again counts once: its key is kept in the state
    store until event time has passed it by that interval, so the state holds
    the keys of one interval, not of all time. Rows older than that are late
    and dropped, as Spark does with a watermark.
    """
    reader = spark.readStream.schema(STREAM_VERDICTS if redelivery else STREAM_RUNS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    runs = reader.json(runs_dir)
    if redelivery:
        runs = runs.withWatermark("ts", redelivery).dropDuplicatesWithinWatermark(VERDICT_KEY)
    counts = runs.groupBy("split", "error_type").agg(F.count(F.lit(1)).alias("n"))

    def sink(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

    w = (counts.writeStream.outputMode("update").foreachBatch(sink)
               .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def latest_counts(spark: SparkSession, out_dir: str) -> DataFrame:
    """Newest count per key across the micro-batch outputs."""
    df = spark.read.parquet(out_dir)
    return (df.groupBy("split", "error_type")
              .agg(F.max_by("n", "batch_id").alias("n")))


def latest_metrics(metrics: DataFrame) -> DataFrame:
    """The whole error-count set of the newest step (it replaces earlier ones)."""
    newest = metrics.select(F.max("step")).scalar()
    return metrics.filter(F.col("step") == newest)


def stream_latest_metrics(spark: SparkSession, metrics_dir: str, state_dir: str, checkpoint: str,
                          available_now: bool = True, max_files_per_trigger: int | None = None):
    """Keep the newest validation metrics as metric files arrive.

    The state store holds, per error type, the newest step that counted it
    (one row per error class, whatever the number of steps). Every micro-batch
    writes the rows of the newest step of all to ``state_dir/batch_id=<id>``;
    the newest folder is the current feedback table, and the only one read. A
    step's row that is delivered again counts once; of differing counts for
    one step and type the largest holds.
    """
    reader = spark.readStream.schema(METRIC_ROWS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    newest = reader.json(metrics_dir).groupBy("error_type").agg(F.max(F.struct("step", "n")).alias("m"))

    def sink(batch: DataFrame, batch_id: int):
        rows = batch.select("m.step", "error_type", "m.n").persist()  # one row per error class
        latest_metrics(rows).write.mode("overwrite").parquet(f"{state_dir}/batch_id={batch_id}")
        rows.unpersist()

    # The whole state each time: a type that the newest step no longer has must go from the table.
    w = (newest.writeStream.outputMode("complete").foreachBatch(sink).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def _newest_folder(spark: SparkSession, state_dir: str) -> str | None:
    """The folder of the last batch that finished writing, by a listing of names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(state_dir)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    ids = sorted((int(f.getPath().getName()[len("batch_id="):]) for f in fs.listStatus(path) if f.getPath().getName().startswith("batch_id=")), reverse=True)
    done = (f"{state_dir}/batch_id={i}" for i in ids)
    return next((d for d in done if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{d}/_SUCCESS"))), None)


def current_state(spark: SparkSession, state_dir: str) -> DataFrame:
    """The feedback table after the last finished batch: (step, error_type, n)."""
    folder = _newest_folder(spark, state_dir.rstrip("/"))
    if folder is None:
        raise ValueError(f"no metrics have arrived in {state_dir}")
    return spark.read.schema(METRIC_ROWS).parquet(folder)
