"""Texts kept once under their digest, so that joins, groups and sorts carry 16 bytes instead of texts.

``with_digests`` replaces text columns of a table by their 128-bit digests (a
map-side expression); the merge stage then groups, deduplicates and ranks on
digests. ``dictionary`` gives each digest its text (copies are combined before
the shuffle), and ``resolve`` puts texts back where they are wanted, at the
end. Two texts under one digest are detected when the dictionary is built and
are an error, so equality of digests is equality of texts.

``TextStore`` is the stored form: a table bucketed by digest, to which only
texts it does not have yet are added.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.session import scratch_path
from pairforge.sources.bucketed import append_bucketed, open_bucketed, write_bucketed


def digest(text) -> Column:
    """16 bytes for a text; null for null."""
    return F.unhex(F.md5(F.col(text) if isinstance(text, str) else text))


def with_digests(df: DataFrame, columns=("prompt", "answer"), lengths=("answer",), hashes=()) -> DataFrame:
    """``df`` with digests in place of the text columns, the length of those in ``lengths`` as ``<column>_chars`` and a
    64-bit hash of those in ``hashes`` as ``<column>_hash``."""
    out = {f"{c}_chars": F.length(c).cast("long") for c in lengths if c in df.columns}
    out |= {f"{c}_hash": F.xxhash64(c) for c in hashes if c in df.columns}
    return df.withColumns({**out, **{c: digest(c) for c in columns if c in df.columns}})


def dictionary(df: DataFrame, columns=("prompt", "answer")) -> DataFrame:
    """(digest, text), one row per distinct text of the columns; an error where two texts share a digest.

    Copies go first, by hash and before the shuffle; digests are worked out and compared for different texts alone.
    """
    rows = reduce(DataFrame.union, [df.select(F.col(c).alias("text")).where("text is not null").distinct() for c in columns])
    both = rows.select(digest("text").alias("digest"), "text").groupBy("digest").agg(F.min("text").alias("_a"), F.max("text").alias("_b"))
    return both.select("digest", F.when(F.col("_a") == F.col("_b"), F.col("_a"))
                       .otherwise(F.raise_error(F.lit("two texts share a digest"))).alias("text"))


def digest_names(df: DataFrame, column: str = "answer") -> DataFrame:
    """(digest, text) as in ``dictionary``, but with md5 of the text, in hex, for the text itself.

    Built from the digests and ``<column>_hash`` alone, so no text is shuffled or stored; two texts that share a digest
    are told apart by that hash and are an error here, too.
    """
    h = F.col(f"{column}_hash")
    both = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("digest")).agg(F.min(h).alias("_a"), F.max(h).alias("_b"))
    return both.select("digest", F.when(F.col("_a") == F.col("_b"), F.lower(F.hex("digest")))
                       .otherwise(F.raise_error(F.lit("two texts share a digest"))).alias("text"))


def resolve(df: DataFrame, texts: DataFrame, columns=("prompt", "answer")) -> DataFrame:
    """``df`` with the texts of a dictionary in place of the digests of ``columns`` (null stays null)."""
    order = df.columns
    for c in columns:
        side = texts.select(F.col("digest").alias("_digest"), F.col("text").alias("_text"))
        df = df.join(side, F.col(c) == F.col("_digest"), "left").drop(c, "_digest").withColumnRenamed("_text", c)
    return df.select(*order)


class TextStore:
    """A dictionary stored below a folder, bucketed by digest."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, (path or scratch_path(spark, "texts")).rstrip("/")

    def _exists(self) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/meta")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    @property
    def table(self) -> DataFrame:
        return open_bucketed(self.spark, self.path)

    def add(self, df: DataFrame, columns=("prompt", "answer")) -> DataFrame:
        """Stores the texts of ``df`` that the store lacks; ``df`` with digests comes back.

        Known digests are compared by hash with what the store holds, so a second text under one of them is an error, too.
        """
        new = dictionary(df, columns)
        if not self._exists():
            write_bucketed(new, self.path, ["digest"])
        else:
            old = self.table.select("digest", F.xxhash64("text").alias("_h"), F.lit(True).alias("_known"))
            both = new.join(old, "digest", "left")
            clash = F.col("_known") & (F.col("_h") != F.xxhash64("text"))
            both = both.withColumn("text", F.when(clash, F.raise_error(F.lit("two texts share a digest"))).otherwise(F.col("text")))
            append_bucketed(both.where(F.col("_known").isNull() | F.col("text").isNull()).select("digest", "text"), self.path)
        return with_digests(df, columns)

    def resolve(self, df: DataFrame, columns=("prompt", "answer")) -> DataFrame:
        """Texts in place of digests; the stored table is read as it lies in its buckets."""
        return resolve(df, self.table, columns)
