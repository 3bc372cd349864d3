"""Bucketed Parquet tables in a folder of their own: written, opened and appended to without a lasting catalog entry."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _ddl(spark: SparkSession, columns: str, path: str, keys: list[str], buckets: int) -> str:
    name, by = f"pairforge_{uuid.uuid4().hex}", ", ".join(keys)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}/rows'")
    return name


def default_buckets(spark: SparkSession) -> int:
    """The session's shuffle partitions: with fewer buckets Spark would rather shuffle the table again."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def write_bucketed(df: DataFrame, path: str, keys: list[str], buckets: int | None = None) -> DataFrame:
    """Writes ``df`` as a table bucketed and sorted by ``keys`` below ``path`` and opens it."""
    spark, path = df.sparkSession, path.rstrip("/")
    buckets = buckets or default_buckets(spark)
    name = f"pairforge_{uuid.uuid4().hex}"
    # Dealt out as the buckets are: one sorted file a bucket (which spark.sql.legacy.bucketedTableScan.outputOrdering
    # lets Spark read without another sort).
    (df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
       .option("path", f"{path}/rows").mode("overwrite").format("parquet").saveAsTable(name))
    spark.sql(f"DROP TABLE {name}")  # external: the files stay, open_bucketed names them again
    spark.createDataFrame([(buckets, ",".join(keys))], "buckets int, keys string").write.mode("overwrite").parquet(f"{path}/meta")
    return open_bucketed(spark, path)


def open_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """A table written by :func:`write_bucketed`, in this or another session."""
    path = path.rstrip("/")
    meta = spark.read.parquet(f"{path}/meta").first()
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/rows").schema.fields)
    return spark.table(_ddl(spark, columns, path, meta["keys"].split(","), meta["buckets"]))


def append_bucketed(df: DataFrame, path: str) -> DataFrame:
    """Adds rows to the buckets of the table below ``path`` and opens it again. Old files are not read."""
    table = open_bucketed(df.sparkSession, path)
    meta = df.sparkSession.read.parquet(f"{path.rstrip('/')}/meta").first()
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)
    name = _ddl(df.sparkSession, columns, path.rstrip("/"), meta["keys"].split(","), meta["buckets"])
    df.select(*table.columns).repartition(meta["buckets"], *[F.col(k) for k in meta["keys"].split(",")]).write.insertInto(name)
    return open_bucketed(df.sparkSession, path)
