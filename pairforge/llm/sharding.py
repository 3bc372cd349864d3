"""Sharding by sampled splitters (DataFrame and SQL functions only).

Records are ordered by the key (64-bit hash of the text, id), so equal texts
are neighbours. A size-weighted sample of keys gives quantile boundaries that
cut the key space into ranges of similar bytes; ranges that still hold too
much get a sample and boundaries of their own, so a text that a third of all
rows share is cut by id. Inside a range a window gives running bytes and
positions; the ranges' totals, one small row each, turn these into positions
over all rows. The shard is the part of the total bytes in which the middle
of the record lies, so a shard's bytes differ from an equal share by at most
one record at either end.

Only range totals (about one row per ``rows_per_range`` records) and samples
of a fixed number of keys per range reach the driver. Draws are hashes of the
key: reruns and retries choose the same splitters.

Defined results: null text has no bytes and CRC 0 and sorts with its own
hash; null ids come first among equal texts; repeated rows are kept and
ordered arbitrarily among themselves (they are equal); an empty table gives
an empty result; other columns are not read. The law is ``bytes``.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairforge.llm.registry import own_names, plain_names, register, table
from pairforge.session import materialize

SHARDS = 24
RANGES_PER_SHARD = 8
ROWS_PER_RANGE = 1_000_000
SAMPLE_PER_RANGE = 32
OVERFULL = 2.0
ROUNDS = 6
ROW_BYTES = 8
LOWEST = -(2**63)


def key_columns(id_col: str, text_col: str) -> tuple[Column, Column]:
    """(text hash, id as long): the sort key. Ids that are no whole numbers are hashed; a null id comes first."""
    own = F.col(id_col)
    return F.xxhash64(F.col(text_col)), F.coalesce(own.cast("string").try_cast("long"), F.when(own.isNotNull(), F.xxhash64(own)), F.lit(LOWEST))


def constant(value: list, kind: str) -> Column:
    """A list as one constant of the plan: the optimizer reads it once, and the plan stays short at any length."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def range_of(splitters: list[tuple[int, int]], h: str = "_h", k: str = "_k") -> Column:
    """Number of splitters at or below the row's key, by a search in two levels of about sqrt(n) each."""
    if not splitters:
        return F.lit(0)
    keys = [{"h": a, "k": b} for a, b in splitters]
    step = max(1, math.isqrt(len(keys)))
    pair = "array<struct<h:bigint,k:bigint>>"

    def low(x: Column) -> Column:
        return (x["h"] < F.col(h)) | ((x["h"] == F.col(h)) & (x["k"] <= F.col(k)))

    block = F.greatest(F.size(F.filter(constant(keys[::step], pair), low)), F.lit(1))
    blocks = constant([keys[i:i + step] for i in range(0, len(keys), step)], f"array<{pair}>")
    return ((block - 1) * step + F.size(F.filter(F.element_at(blocks, block), low))).cast("int")


def _draw(rows: DataFrame, rate: Column, salt: int) -> list[tuple[int, int]]:
    u = F.pmod(F.xxhash64("_h", "_k", F.lit(salt)), F.lit(2**53)) / F.lit(float(2**53))
    return sorted((r[0], r[1]) for r in rows.where(u < rate * F.col("size")).select("_h", "_k").distinct().collect())


def find_splitters(rows: DataFrame, shards: int, rows_per_range: int = ROWS_PER_RANGE) -> tuple[list, list]:
    """Splitters of ranges none of which is overfull, and per range (rows, bytes).

    A range counts as overfull above ``OVERFULL`` times the mean bytes or
    ``rows_per_range`` rows, unless it holds one key only.
    """
    n, total = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    if not n:
        return [], [(0, 0)]
    want = max(shards * RANGES_PER_SHARD, math.ceil(n / rows_per_range))
    got = _draw(rows, F.lit(float(want * SAMPLE_PER_RANGE) / total), 0)
    splitters = sorted(set(got[SAMPLE_PER_RANGE // 2::SAMPLE_PER_RANGE]))
    mean = total / want
    stuck: set = set()
    for salt in range(1, ROUNDS + 1):
        put = rows.withColumn("_r", range_of(splitters))
        stats = [(0, 0)] * (len(splitters) + 1)
        for r, c, b in put.groupBy("_r").agg(F.count(F.lit(1)), F.sum("size")).collect():
            stats[r] = (c, b)
        lower = [None, *splitters]
        over = {i: math.ceil(max(b / mean, c / rows_per_range)) for i, (c, b) in enumerate(stats)
                if c > 1 and (b > OVERFULL * mean or c > rows_per_range) and lower[i] not in stuck}
        if not over or salt == ROUNDS:
            break
        rates = [float(over[i] * SAMPLE_PER_RANGE) / b if i in over else None for i, (_, b) in enumerate(stats)]
        more = _draw(put, F.element_at(constant(rates, "array<double>"), F.col("_r") + 1), salt)
        added = []
        for i in over:
            hi = splitters[i] if i < len(splitters) else (math.inf, math.inf)
            own = [x for x in more if (lower[i] is None or x > lower[i]) and x < hi]
            step = max(1, len(own) // over[i])
            cut = own[step // 2::step]
            if not cut:
                stuck.add(lower[i])
            added += cut
        splitters = sorted(set(splitters) | set(added))
    return splitters, stats


def shard_rows(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
               rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """One narrow row per record: id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``, ``_h``, ``_k``."""
    h, k = key_columns(id_col, text_col)
    rows = materialize(docs.select(
        F.col(id_col), (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text_col)), F.lit(0)).cast("long").alias("text_crc32"),
        h.alias("_h"), k.alias("_k")), "shard-keys")
    splitters, stats = find_splitters(rows, shards, rows_per_range)
    total = sum(b for _, b in stats)
    before, at = [], (0, 0)
    for c, b in stats:
        before.append({"n": at[0], "b": at[1]})
        at = (at[0] + c, at[1] + b)
    offset = F.element_at(constant(before, "array<struct<n:bigint,b:bigint>>"), F.col("_r") + 1)
    w = Window.partitionBy("_r").orderBy("_h", "_k")
    placed = (rows.withColumn("_r", range_of(splitters))
              .withColumn("_n", F.row_number().over(w) - 1)
              .withColumn("_b", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
              .withColumn("_n", (F.col("_n") + offset["n"]).cast("long"))
              .withColumn("_b", F.col("_b") - F.col("size") + offset["b"])
              .withColumn("shard", F.least(F.lit(shards - 1), F.expr(
                  f"((2 * _b + size) * {shards}) div {max(1, 2 * total)}")).cast("int")))
    placed = materialize(placed.drop("_r", "_b"), "shard-places")
    first = placed.groupBy("shard").agg(F.min("_n").alias("_first"))  # one row per shard
    return (placed.join(first, "shard")
            .select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("_n") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
                    "_h", "_k"))


def assign_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
                  name: str = "shard") -> DataFrame:
    """All columns of ``docs`` plus ``name``: the shard, found from the first key of each shard without moving the texts.

    An existing column of that name is replaced. Rows that repeat both id and text stay together.
    """
    docs = docs.drop(name)
    docs, names = plain_names(docs)
    id_col, text_col = names[id_col], names[text_col]
    first = (shard_rows(docs, shards, id_col, text_col).groupBy("shard")
             .agg(F.min(F.struct("_h", "_k")).alias("f")).orderBy("shard").collect())
    h, k = key_columns(id_col, text_col)
    keys = [(r.f["_h"], r.f["_k"]) for r in first]
    shard_ids = [r.shard for r in first]
    if not keys:
        return own_names(docs, names, F.lit(0).alias(name))
    nth = F.greatest(range_of(keys), F.lit(1))
    out = docs.withColumn("_h", h).withColumn("_k", k).withColumn("_shard", F.element_at(F.lit(shard_ids), nth).cast("int"))
    return own_names(out, names, F.col("_shard").alias(name))


def shard_of(key: tuple[int, int], first_keys: list[tuple[int, int]]) -> int:
    """The driver-side twin of :func:`range_of`, for tests."""
    return bisect_right(first_keys, key)


@register("op2_sampled_splitters")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard_rows(docs).drop("_h", "_k")
