"""The ranked answers as tables that schedules and pair builders look up by position.

Three tables, written once after the merge stage and read by every epoch:

* ``tasks``: one row per task with its counts and its failing types (an array
  ordered by first appearance: at most one entry per error class). All choices
  of an epoch are worked out on these rows, without a join.
* ``answers``: one row per answer under its ``slot``: passes have their
  position among passes (0, 1, ...), failures -1 minus their position among
  failures. Bucketed and sorted by (split, task_id, slot).
* ``places``: failures by ``tpos``, their position in the type-grouped list.
  Bucketed and sorted by (split, task_id, tpos).

A look-up joins on exactly the bucketing columns, so the tables are never
shuffled; only the narrow rows that ask are. The position is part of the
bucketing key: a task that holds a third of all answers is spread over all
buckets.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.operators.merge import error_type_order
from pairforge.operators.ranking import group_rank, steps
from pairforge.operators.texts import resolve
from pairforge.session import materialize, scratch_path
from pairforge.sources.bucketed import open_bucketed, write_bucketed

TASK = ["split", "task_id"]
ANSWER_KEY, PLACE_KEY = [*TASK, "slot"], [*TASK, "tpos"]
TYPES = "array<struct<type_order: bigint, error_type: string, type_count: bigint, type_start: bigint>>"


def slot_of(chosen: bool, position) -> Column:
    """Slot of the answer at ``position`` among passes (``chosen``) or failures."""
    p = F.col(position) if isinstance(position, str) else position
    return p if chosen else -1 - p


def type_positions(ranked: DataFrame, types: DataFrame) -> DataFrame:
    """Failures with the order of their type, their position inside it (``type_rank``) and in the type-grouped list (``tpos``)."""
    fails = ranked.filter(~F.col("is_pass"))
    f = group_rank(fails, TASK + ["error_type"], ["side_rank"], name="type_rank", blocks=[steps("side_rank")])
    return f.join(types, TASK + ["error_type"]).withColumn("tpos", F.col("type_start") + F.col("type_rank"))


@dataclass
class RankedStore:
    """Stored tables, or (``from_ranked``) the same tables as plans over a ranked table."""

    tasks: DataFrame
    answers: DataFrame
    places: DataFrame

    def of_split(self, split: str) -> RankedStore:
        keep = F.col("split") == split
        return RankedStore(self.tasks.filter(keep), self.answers.filter(keep), self.places.filter(keep))

    def look_up(self, df: DataFrame, position: str, chosen: bool, columns: dict[str, str]) -> DataFrame:
        """Joins answer columns (stored name -> new name) to rows of (split, task_id, ``position``)."""
        side = self.answers.filter(F.col("slot") >= 0 if chosen else F.col("slot") < 0)
        side = side.select(*ANSWER_KEY, *[F.col(c).alias(n) for c, n in columns.items()])
        return df.withColumn("slot", slot_of(chosen, position)).join(side.hint("merge"), ANSWER_KEY).drop("slot")

    def place(self, df: DataFrame) -> DataFrame:
        """Adds ``placed`` = position among failures of the failure at ``tpos`` (null where ``tpos`` is)."""
        return df.join(self.places.select(*PLACE_KEY, F.col("r_pos").alias("placed")).hint("merge"), PLACE_KEY, "left")


class _Planned(RankedStore):
    def __init__(self, ranked: DataFrame):
        self._ranked = ranked

    @cached_property
    def _types(self) -> DataFrame:
        return error_type_order(self._ranked)

    @cached_property
    def tasks(self) -> DataFrame:
        counts = self._ranked.groupBy(*TASK).agg(F.max("n_pass").alias("n_pass"), F.max("n_fail").alias("n_fail"))
        entry = F.struct("type_order", "error_type", "type_count", "type_start")
        types = self._types.groupBy(*TASK).agg(F.array_sort(F.collect_list(entry)).alias("types"))
        return counts.join(types, TASK, "left").withColumn("types", F.coalesce("types", F.expr(f"cast(array() as {TYPES})")))

    @cached_property
    def answers(self) -> DataFrame:
        side = F.when(F.col("is_pass"), slot_of(True, "side_rank")).otherwise(slot_of(False, "side_rank")).cast("long")
        return self._ranked.select(*TASK, side.alias("slot"), "error_type", "answer_id", "answer",
                                   # Read with the chosen answer, so failures need no copy.
                                   F.when(F.col("is_pass"), F.col("prompt")).alias("prompt"))

    @cached_property
    def places(self) -> DataFrame:
        return type_positions(self._ranked, self._types).select(*PLACE_KEY, F.col("side_rank").alias("r_pos"))

    def of_split(self, split: str) -> RankedStore:
        return _Planned(self._ranked.filter(F.col("split") == split))


def from_ranked(ranked: DataFrame | RankedStore) -> RankedStore:
    """The store over a ranked table without writing anything (a store is returned as it is)."""
    return ranked if isinstance(ranked, RankedStore) else _Planned(ranked)


def save_store(ranked: DataFrame, path: str | None = None, buckets: int | None = None, texts: DataFrame | None = None) -> RankedStore:
    """Writes the three tables below ``path`` (default: a new folder in the shared scratch folder) and opens them.

    ``buckets`` is one file and one join task each; the default is the session's
    number of shuffle partitions, below which Spark would shuffle the tables again.
    With a dictionary ``texts``, ``ranked`` holds digests and the texts are put in here.
    """
    spark = ranked.sparkSession
    path = (path or scratch_path(spark, "ranked-store")).rstrip("/")
    if texts is not None:
        ranked = materialize(ranked.drop("answer_chars"), "ranked-digests")  # narrow, and read by each of the three writes
    plan = from_ranked(ranked)
    if texts is not None:
        plan = RankedStore(plan.tasks, resolve(plan.answers, texts), plan.places)
    write_bucketed(plan.answers, f"{path}/answers", ANSWER_KEY, buckets)
    write_bucketed(plan.places, f"{path}/places", PLACE_KEY, buckets)
    plan.tasks.write.mode("overwrite").parquet(f"{path}/tasks")
    return open_store(spark, path)


def open_store(spark: SparkSession, path: str) -> RankedStore:
    """A store written by :func:`save_store`, in this or another session."""
    path = path.rstrip("/")
    return RankedStore(spark.read.parquet(f"{path}/tasks"), open_bucketed(spark, f"{path}/answers"), open_bucketed(spark, f"{path}/places"))
