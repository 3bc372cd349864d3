"""Readers and writers for the pipeline tables.

Every read passes an explicit schema. Tables are partitioned by ``split``
(and ``check_id`` for verdicts) so a stage reads only the splits it needs
(partition pruning) and a re-run overwrites only its own partitions
(dynamic partition overwrite).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairforge import schemas as S
from pairforge.session import replace_partitions
from pairforge.sources import arrow_ipc

CORRUPT = "_corrupt_record"
PARTITIONS = {"split": "string", "check_id": "long"}
RUN_CONFIG = ("dataset", "model", "temperature", "method", "epochs", "prefix")


def _with_split_schema(schema: T.StructType) -> T.StructType:
    return T.StructType(list(schema.fields) + [T.StructField("split", T.StringType())])


def read_lines_checked(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """JSON lines as (rows, broken lines).

    Every line is parsed against the whole ``schema``, whatever columns are used later, so a line is either a row in
    every query or in none. A line is broken if it is no JSON object or a value doesn't fit its column; blank lines
    are neither. Broken lines keep their text, file and partition (``split``, ``check_id``, where the schema has them).
    """
    own = [f for f in schema.fields if f.name not in PARTITIONS]
    parts = [f for f in schema.fields if f.name in PARTITIONS]
    # A folder layout names the partitions; where the files lie flat these columns are fields of the line.
    lines = spark.read.option("basePath", path).text(path) if parts and not _is_pattern(path) else spark.read.text(path)
    in_path = [f for f in parts if f.name in lines.columns]
    body = T.StructType([*own, *[f for f in parts if f not in in_path], T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json("value", body, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rows = lines.where(F.trim(F.col("value")) != "").select(
        "value", *[F.col(f.name).cast(f.dataType).alias(f.name) for f in in_path],
        F.col("_metadata.file_path").alias("_file"), parsed.alias("_row"))
    broken = F.col(f"_row.{CORRUPT}").isNotNull() | F.col("_row").isNull() | ~F.ltrim(F.col("value")).startswith("{")
    at = {f.name: F.col(f.name) if f in in_path else F.col(f"_row.{f.name}") for f in schema.fields}
    good = rows.where(~broken).select(*[c.alias(n) for n, c in at.items()], F.col("_file"))
    bad = rows.where(broken).select(F.col("_file").alias("file"), F.col("value").alias("line"), *[f.name for f in in_path])
    return good, bad


def _is_pattern(path: str) -> bool:
    return any(c in path for c in "*?[{")


def quarantine(bad: DataFrame, path: str, source: str) -> None:
    """Stores the broken lines of one source (``source``, ``file``, ``line``) in a folder of its own, in place of its
    earlier ones, also where there are none any more."""
    part = hashlib.md5(source.encode()).hexdigest()
    bad.select(F.lit(source).alias("source"), "file", "line").write.mode("overwrite").parquet(f"{path.rstrip('/')}/part={part}")


def quarantined(spark: SparkSession, path: str) -> DataFrame:
    """Broken lines per source and file."""
    rows = spark.read.schema("source string, file string, line string").parquet(path)
    return rows.groupBy("source", "file").agg(F.count(F.lit(1)).alias("n_lines"))


def quarantined_runs(spark: SparkSession, path: str) -> DataFrame:
    """Broken lines per source and ``run``, the folder of a run's part files, with the part files that have any."""
    return (quarantined(spark, path).groupBy("source", F.regexp_extract("file", "^(.*)/[^/]*$", 1).alias("run"))
            .agg(F.sum("n_lines").alias("n_lines"), F.count(F.lit(1)).alias("n_parts")))


def _read_json(spark: SparkSession, path: str, schema: T.StructType, quarantine_path: str | None) -> DataFrame:
    """JSON lines of ``schema`` (with ``_file``). A broken line stops the read, or is put aside where a quarantine is named."""
    if quarantine_path is None:
        reader = spark.read.schema(schema).option("mode", "FAILFAST")
        if any(f.name in PARTITIONS for f in schema.fields) and not _is_pattern(path):
            reader = reader.option("basePath", path)
        return reader.json(path).select("*", F.col("_metadata.file_path").alias("_file"))
    good, bad = read_lines_checked(spark, path, schema)
    quarantine(bad, quarantine_path, path)
    return good


def read_problems(spark: SparkSession, path: str, splits=None, fmt: str = "parquet") -> DataFrame:
    """Problems table; ``split`` is a partition column for parquet/json layouts.
    ``fmt='arrowipc'`` reads saved Arrow IPC files (one split per path)."""
    if fmt == "arrowipc":
        arrow_ipc.register(spark)
        df = spark.read.format(arrow_ipc.FORMAT).load(path)
        for f in S.PROBLEMS.fields:
            if f.name not in df.columns:
                df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
        return df
    reader = spark.read.schema(_with_split_schema(S.PROBLEMS))
    df = reader.parquet(path) if fmt == "parquet" else reader.json(path)
    return select_splits(df, splits) if splits else df


def select_splits(df: DataFrame, splits=None, eval_mode: bool | None = None) -> DataFrame:
    """Keep the splits a stage works on: test when evaluating, else train and validation."""
    if splits is None:
        splits = ["test"] if eval_mode else ["train", "validation"]
    return df.filter(F.col("split").isin(list(splits)))


def ingest_jsonl(spark: SparkSession, path: str, split: str, out: str, quarantine_path: str | None = None) -> None:
    """JSONL problems -> parquet table with one named split (overwrites only that split)."""
    df = _read_json(spark, path, S.PROBLEMS, quarantine_path).drop("_file").withColumn("split", F.lit(split))
    replace_partitions(df, "split").parquet(out)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Samples as one JSON array document; order defines ``pos``.

    A single JSON document cannot be split, so this reads it in one task;
    it is the compatibility path. Large sample sets use ``read_samples_jsonl``.
    """
    arr = T.ArrayType(T.StructType([T.StructField("task_id", T.StringType()),
                                    T.StructField("answer", T.StringType())]))
    doc = spark.read.text(path, wholetext=True)
    return (doc.select(F.posexplode(F.from_json("value", arr, {"mode": "FAILFAST"})).alias("pos", "s"))
               .select(F.col("s.task_id").alias("task_id"), F.col("s.answer").alias("answer"),
                       F.col("pos").cast("long").alias("pos")))


def read_samples_jsonl(spark: SparkSession, path: str, quarantine_path: str | None = None) -> DataFrame:
    return _read_json(spark, path, S.SAMPLES, quarantine_path).drop("_file")


def write_samples(df: DataFrame, path: str) -> None:
    """JSONL samples with their explicit ``pos`` (splittable, order kept)."""
    df.select("task_id", "answer", "pos").write.mode("overwrite").json(path)


RUNS_STORED = T.StructType(list(S.RUNS.fields) + [T.StructField("split", T.StringType()),
                                                  T.StructField("check_id", T.LongType())])


def write_runs(df: DataFrame, path: str) -> None:
    """Verdict rows as JSONL, one directory per (split, check)."""
    cols = [f.name for f in S.RUNS.fields]
    replace_partitions(df.select(*cols, "split", "check_id"), "split", "check_id").json(path)


def write_run_lines(lines: DataFrame, path: str) -> None:
    """Verdict lines as they are (``value``), one folder per (split, check) with a part file for each task that has
    rows of it: no split is brought into one task."""
    replace_partitions(lines.select("value", "split", "check_id"), "split", "check_id").text(path)


def read_runs(spark: SparkSession, path: str, splits=None, quarantine_path: str | None = None) -> DataFrame:
    """All checks of all (or the given) splits in one scan; the union of checks.

    A broken line stops the read; with ``quarantine_path`` broken lines are stored there and the rest is read.
    """
    df = _read_json(spark, path, RUNS_STORED, quarantine_path).drop("_file")
    return select_splits(df, splits) if splits else df


def read_runs_per_file(spark: SparkSession, pattern: str, quarantine_path: str | None = None) -> DataFrame:
    """Runs laid out as ``<split>/runs/<name>.json``; split and check come from the path."""
    df = _read_json(spark, pattern, S.RUNS, quarantine_path)
    p = F.col("_file")
    return (df.withColumn("split", F.regexp_extract(p, r"([^/]+)/runs/[^/]+\.json$", 1))
              .withColumn("check_id", F.regexp_extract(p, r"(\d+)\.json$", 1).cast("long")).drop("_file"))


def write_merged(nested: DataFrame, path: str) -> None:
    replace_partitions(nested, "split").json(path)


def read_merged(spark: SparkSession, path: str, splits=None) -> DataFrame:
    df = spark.read.schema(_with_split_schema(S.MERGED)).option("basePath", path).json(path)
    return select_splits(df, splits) if splits else df


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Metrics keyed by split and check (dynamic overwrite replaces only those)."""
    replace_partitions(metrics, "split", "check_id").json(path)


def write_report(report: DataFrame, path: str) -> None:
    replace_partitions(report, "split").json(path)


def run_layout(df: DataFrame, **config) -> DataFrame:
    """Attach the run configuration as columns, so outputs of many runs live
    in one table partitioned by configuration and compare in one scan."""
    unknown = set(config) - set(RUN_CONFIG)
    if unknown:
        raise ValueError(f"unknown run settings {sorted(unknown)}")
    return df.withColumns({k: F.lit(str(v)) for k, v in config.items()})


def read_run_table(spark: SparkSession, path: str, **config) -> DataFrame:
    """The outputs of all runs, or of those with the given settings (partition
    pruning); settings are read as text, as they were written."""
    df = spark.read.option("basePath", path).parquet(path)
    df = df.withColumns({k: F.col(k).cast("string") for k in RUN_CONFIG if k in df.columns})
    for k, v in config.items():
        df = df.filter(F.col(k) == F.lit(str(v)))
    return df


def write_run_table(df: DataFrame, path: str, keys=RUN_CONFIG) -> None:
    present = [k for k in keys if k in df.columns]
    replace_partitions(df, *present).parquet(path)
