"""Per-epoch progressive pairs: slice schedules, adaptive replay, draws.

For every task and epoch one chosen (passing) and one rejected (failing)
answer are drawn. The rejected answer comes from a slice of the task's
ranked failures that moves with the epoch (``epoch_bounds``); two
schedules add *replay*: extra draws of the error types that the latest
validation run still produced, weighted by their counts.

Everything is computed on (task, epoch) rows without a join: epochs are
exploded on tasks (not answers), draws are counter-based
(``functions.draws``), a task's failing types are an array of its row, and the
validation counts in force (epochs x error types) are read as one map by a
scalar subquery. Only the drawn positions are looked up, in tables bucketed by
position (``ranked_store``). The replay pool is never materialised: a uniform
pick from "window + added draws" is a pick of the window with probability W/L,
else of error type t with probability added_t/L followed by a uniform pick
inside type t, which is exactly the pool's distribution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairforge.functions.draws import index_draw, unit_draw
from pairforge.operators.merge import error_type_order
from pairforge.operators.ranked_store import RankedStore, from_ranked, type_positions

TASK = ["split", "task_id"]
SCHEDULES = ("pvf", "pvf_iter", "pvf_iter_type", "pvf_iter_expand", "pvf_iter_priority",
             "pvf_iter_reverse", "pvf_iter_reverse_priority", "pvf_iter_type_reverse",
             "pvf_iter_reverse_expand")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _floor_share(k, n, epochs, exact: bool = False) -> Column:
    """floor(k * (n / E)): in doubles as the reference computes it (which can
    miss the last item for some (E, n)), or exactly in integers."""
    if exact:
        return F.floor((_c(k).cast("long") * _c(n).cast("long")) / F.lit(int(epochs))).cast("long")
    return F.floor(_c(k).cast("double") * (_c(n).cast("double") / F.lit(float(epochs)))).cast("long")


def epoch_bounds(epoch, n, epochs: int, mode: str, exact: bool = False) -> tuple[Column, Column]:
    """[start, end) of the slice for ``epoch`` of ``epochs`` over ``n`` items.

    modes: iter, expand, reverse, reverse_expand (over failures) and
    type, type_reverse (over distinct failing types). ``exact`` uses
    integer arithmetic, so the ``iter`` slices partition the list when n >= E.
    """
    e, n = _c(epoch), _c(n)

    def fs(k, n_, E):
        return _floor_share(k, n_, E, exact)
    if mode in ("iter", "expand", "reverse", "type"):
        s = fs(e, n, epochs)
        t0 = fs(e + 1, n, epochs)
        t = F.when(t0 == s, F.least(s + 1, n)).otherwise(t0)
        if mode in ("iter", "type"):
            return s, t
        if mode == "expand":
            return F.lit(0).cast("long"), t
        return n - t, n - s
    if mode == "reverse_expand":
        s = fs(F.lit(epochs) - e - 1, n, epochs)
        return s, n
    if mode == "type_reverse":
        s = F.least(fs(F.lit(epochs) - e - 1, n, epochs), n - 1)
        t = F.least(fs(F.lit(epochs) - e, n, epochs), n)
        return s, F.greatest(s + 1, t)
    raise ValueError(mode)


def task_epochs(ranked: DataFrame | RankedStore, epochs: int) -> DataFrame:
    """One row per (task, epoch) with the task's counts and failing types (epochs exploded on tasks)."""
    every = F.sequence(F.lit(0).cast("long"), F.lit(epochs - 1).cast("long"))
    return from_ranked(ranked).tasks.withColumn("epoch", F.explode(every))


def failure_index(ranked: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """Failures with their position among failures (``side_rank``), the
    first-appearance order of their type, and their position inside the
    type (``type_rank``) and inside the type-grouped list (``tpos``)."""
    return type_positions(ranked, types if types is not None else error_type_order(ranked))


def task_type_counts(ranked: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """Per task: number of distinct failing types."""
    types = types if types is not None else error_type_order(ranked)
    return types.groupBy(*TASK).agg(F.count(F.lit(1)).alias("n_types"))


def steps_in_force(metrics: DataFrame, epochs: int) -> DataFrame:
    """(epoch, step): the validation step whose counts hold in each epoch.

    Steps are numbered from the first one; step number p ran after epoch p
    and holds from epoch p + 1 until a newer one replaces it, so steps may be
    missing or spread out. Epoch 0 has none. The list of steps (one per
    validation) is read as one array by a scalar subquery.
    """
    steps_array = metrics.agg(F.array_sort(F.collect_set("step"))).scalar()
    table = metrics.sparkSession.range(1, max(1, epochs)).select(F.col("id").alias("epoch")).withColumn("_s", steps_array)
    done = F.filter("_s", lambda x: x - F.get("_s", F.lit(0)) < F.col("epoch"))
    return table.select("epoch", F.try_element_at(done, F.lit(-1)).alias("step")).filter(F.col("step").isNotNull())


def validation_counts_by_epoch(metrics: DataFrame, epochs: int) -> DataFrame:
    """Validation error counts in force at each epoch.

    ``metrics`` is long form (step, error_type, n) and has at least one row
    for every validation that ran (passing rows have the '' type), so a
    validation without failures clears the replay. The result has at most
    epochs x types rows.
    """
    m = (metrics.filter((F.col("error_type") != "") & (F.col("n") > 0))
                .join(steps_in_force(metrics, epochs), "step"))
    w = Window.partitionBy("epoch")
    return (m.select("epoch", "error_type", F.col("n").cast("long").alias("cnt"))
             .withColumn("least", F.min("cnt").over(w))
             .withColumn("total", F.sum("cnt").over(w))
             .withColumn("least_cnt", F.ceil(F.col("cnt") / F.col("least")).cast("long")))


def counts_in_force(val_counts: DataFrame) -> Column:
    """Map of epoch -> (error_type, cnt, total, least_cnt) structs by count desc, then name.

    At most one entry per error class and epoch; read by a scalar subquery.
    """
    entry = F.struct((-F.col("cnt")).alias("_o"), "error_type", "cnt", "total", "least_cnt")
    per_epoch = val_counts.groupBy("epoch").agg(F.array_sort(F.collect_list(entry)).alias("held"))
    return per_epoch.agg(F.map_from_entries(F.collect_list(F.struct("epoch", "held")))).scalar()


def _added(types: Column, held: Column, width: Column) -> Column:
    """The replayed types of a (task, epoch) row: types of the task that the validation counts in force hold.

    added_t = max(ceil(cnt_t / min cnt), floor(W * cnt_t / sum cnt)), with min
    and sum over all validation failing types of that epoch, is the number of
    replay draws of a type; ``cum_before`` starts its block (types ordered by
    count desc, then name).
    """
    known = F.map_from_entries(F.transform(types, lambda t: F.struct(t["error_type"], t)))
    kind = "array<struct<error_type: string, type_count: bigint, type_start: bigint, cnt: bigint, added: bigint, cum_before: bigint>>"
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.expr(f"cast(array() as {kind})").alias("out"))

    def step(acc, h):
        t = F.element_at(known, h["error_type"])
        added = F.greatest(h["least_cnt"], F.floor(width.cast("double") * (h["cnt"] / h["total"])).cast("long"))
        one = F.struct(h["error_type"].alias("error_type"), t["type_count"].alias("type_count"), t["type_start"].alias("type_start"),
                       h["cnt"].alias("cnt"), added.alias("added"), acc["sum"].alias("cum_before"))
        return F.struct((acc["sum"] + added).alias("sum"), F.concat(acc["out"], F.array(one)).alias("out"))
    own = F.filter(held, lambda h: F.map_contains_key(known, h["error_type"]))
    return F.coalesce(F.aggregate(own, start, step, lambda acc: acc["out"]), F.expr(f"cast(array() as {kind})"))


def _with_replay(te: DataFrame, val_counts: DataFrame | None) -> DataFrame:
    """Adds ``replayed`` (see ``_added``) and ``A``, its draws in all, to (task, epoch) rows with ``types`` and ``W``."""
    held = F.lit(None) if val_counts is None else F.try_element_at(counts_in_force(val_counts), F.col("epoch"))
    kind = "array<struct<_o: bigint, error_type: string, cnt: bigint, total: bigint, least_cnt: bigint>>"
    te = te.withColumn("_held", held.cast(kind)).withColumn("replayed", _added(F.col("types"), F.col("_held"), F.col("W"))).drop("_held")
    zero = F.lit(0).cast("long")
    return te.withColumn("A", F.aggregate("replayed", zero, lambda acc, t: acc + t["added"]))


MODES = {"pvf_iter": "iter", "pvf_iter_priority": "iter", "pvf_iter_expand": "expand", "pvf_iter_reverse": "reverse",
         "pvf_iter_reverse_priority": "reverse", "pvf_iter_reverse_expand": "reverse_expand"}


def drawn_positions(store: RankedStore | DataFrame, schedule: str, epochs: int, seed: int = 0,
                    val_counts: DataFrame | None = None, exact: bool = False) -> DataFrame:
    """(task, epoch) rows with the drawn positions: ``c_pos`` among passes, and either ``r_pos`` among failures or
    ``tpos`` in the type-grouped list. No join and no shuffle."""
    if schedule not in SCHEDULES:
        raise ValueError(f"unknown schedule {schedule}")
    keys = [F.col("split"), F.col("task_id"), F.col("epoch")]
    u = unit_draw(seed, *keys, "rejected")
    te = task_epochs(store, epochs).withColumn("c_pos", index_draw("n_pass", seed, *keys, "chosen")).filter("c_pos is not null")
    none = F.lit(None).cast("long")
    if schedule in ("pvf_iter_type", "pvf_iter_type_reverse"):
        te = te.withColumn("n_types", F.size("types").cast("long")).filter("n_types > 0")
        first, past = epoch_bounds("epoch", "n_types", epochs, "type" if schedule == "pvf_iter_type" else "type_reverse", exact)
        te = te.withColumn("_first", F.get("types", first.cast("int"))).withColumn("_last", F.get("types", (past - 1).cast("int")))
        lo, hi = F.col("_first.type_start"), F.col("_last.type_start") + F.col("_last.type_count")
        te = te.withColumn("tpos", (lo + F.floor(u * (hi - lo))).cast("long")).withColumn("r_pos", none)
        return te.select(*TASK, "epoch", "c_pos", "r_pos", "tpos")
    lo, hi = (F.lit(0).cast("long"), F.col("n_fail")) if schedule == "pvf" else epoch_bounds("epoch", "n_fail", epochs, MODES[schedule], exact)
    te = te.withColumn("lo", lo).withColumn("hi", hi).withColumn("W", F.col("hi") - F.col("lo"))
    if not schedule.endswith("_priority") or val_counts is None:
        te = te.withColumn("r_pos", F.col("lo") + F.floor(u * F.col("W")).cast("long"))
        return te.select(*TASK, "epoch", "c_pos", "r_pos", none.alias("tpos"))
    te = _with_replay(te, val_counts).withColumn("_p", F.floor(u * (F.col("W") + F.col("A"))).cast("long"))
    q = F.col("_p") - F.col("W")
    te = te.withColumn("_type", F.get(F.filter("replayed", lambda t: (q >= t["cum_before"]) & (q < t["cum_before"] + t["added"])), F.lit(0)))
    inside = F.floor(unit_draw(seed, *keys, "replay") * F.col("_type.type_count"))
    return te.select(*TASK, "epoch", "c_pos", F.when(q < 0, F.col("lo") + F.col("_p")).alias("r_pos"),
                     F.when(q >= 0, F.col("_type.type_start") + inside).cast("long").alias("tpos"))


def progressive_pairs(ranked: DataFrame | RankedStore, schedule: str, epochs: int, seed: int = 0,
                      val_counts: DataFrame | None = None, exact: bool = False) -> DataFrame:
    """(task, epoch) -> chosen, rejected for one of the nine schedules.

    ``ranked`` is a ranked table, or better a store written once
    (``ranked_store.save_store``): each look-up then shuffles the (task, epoch)
    rows alone. ``val_counts`` (from ``validation_counts_by_epoch``) is used by
    the two ``*_priority`` schedules; epochs without counts draw from the window
    only. ``exact`` computes slice bounds in integers (see ``epoch_bounds``).
    """
    store = from_ranked(ranked)
    te = drawn_positions(store, schedule, epochs, seed, val_counts, exact)
    if schedule in ("pvf_iter_type", "pvf_iter_type_reverse") or schedule.endswith("_priority") and val_counts is not None:
        te = store.place(te).withColumn("r_pos", F.coalesce("r_pos", "placed")).drop("placed")
    te = store.look_up(te.drop("tpos"), "r_pos", False, {"answer": "rejected", "answer_id": "rejected_id"})
    te = store.look_up(te, "c_pos", True, {"answer": "chosen", "answer_id": "chosen_id", "prompt": "prompt"})
    return te.select("split", F.col("task_id").alias("id"), "epoch", F.lit(schedule).alias("schedule"),
                     F.col("prompt").alias("problem"), "prompt", "chosen", "rejected",
                     "chosen_id", "rejected_id", "c_pos", "r_pos")


def replay_added(te: DataFrame, ranked: DataFrame | RankedStore, val_counts: DataFrame) -> DataFrame:
    """The replayed types of each (task, epoch, ``W``) row with their draws and blocks."""
    frame = _with_replay(te.select(*TASK, "epoch", "W").join(from_ranked(ranked).tasks, TASK), val_counts)
    return frame.select(*TASK, "epoch", F.explode("replayed").alias("t")).select(
        *TASK, "epoch", "t.error_type", "t.type_count", "t.cnt", "t.added", "t.cum_before")


def _weighted(store: RankedStore, epochs: int, val_counts: DataFrame, reverse: bool, exact: bool) -> DataFrame:
    lo, hi = epoch_bounds("epoch", "n_fail", epochs, "reverse" if reverse else "iter", exact)
    te = task_epochs(store, epochs).withColumn("lo", lo).withColumn("hi", hi).withColumn("W", F.col("hi") - F.col("lo"))
    return _with_replay(te, val_counts)


def replay_runs(ranked: DataFrame | RankedStore, epochs: int, val_counts: DataFrame,
                reverse: bool = False, exact: bool = False) -> DataFrame:
    """The probabilities of the replay schedules as intervals: one run per (task, epoch) for the window, over positions
    among failures (``by`` = 'rank'), and one per replayed type, over the type-grouped list (``by`` = 'type').

    A failure's probability is the sum of the ``weight`` of the runs [start, end) that hold its positions. The number
    of rows depends on tasks, epochs and error classes, not on the number of failures. No join and no shuffle.
    """
    te = _weighted(from_ranked(ranked), epochs, val_counts, reverse, exact)
    pool = (F.col("W") + F.col("A")).cast("double")
    window = F.struct(F.lit("rank").alias("by"), F.lit(None).cast("string").alias("error_type"), F.col("lo").alias("start"),
                      F.col("hi").alias("end"), (F.lit(1.0) / pool).alias("weight"))
    runs = F.transform("replayed", lambda t: F.struct(
        F.lit("type").alias("by"), t["error_type"].alias("error_type"), t["type_start"].alias("start"),
        (t["type_start"] + t["type_count"]).alias("end"), (t["added"] / t["type_count"] / pool).alias("weight")))
    return te.select(*TASK, "epoch", F.explode(F.concat(F.array(window), runs)).alias("r")).select(*TASK, "epoch", "r.*")


def expand_runs(runs: DataFrame, ranked: DataFrame | RankedStore) -> DataFrame:
    """Runs -> one row per (task, epoch, failure) with its ``weight`` (0 where no run holds it).

    The rows are epochs x failures of the tasks in ``runs`` by definition: ask for the tasks and epochs needed.
    """
    store = from_ranked(ranked)
    # A (task, epoch) has one run for the window and at most one per error class.
    per = runs.groupBy(*TASK, "epoch").agg(F.collect_list(F.struct("by", "start", "end", "weight")).alias("runs"))
    fails = store.answers.filter("slot < 0").select(*TASK, (-1 - F.col("slot")).alias("side_rank"), "answer_id")
    fails = fails.join(store.places.withColumnRenamed("r_pos", "side_rank"), [*TASK, "side_rank"])
    at = lambda r: F.when(r["by"] == "rank", F.col("side_rank")).otherwise(F.col("tpos"))
    weight = F.aggregate(F.filter("runs", lambda r: (at(r) >= r["start"]) & (at(r) < r["end"])), F.lit(0.0), lambda acc, r: acc + r["weight"])
    return fails.join(per, TASK).select(*TASK, "epoch", "side_rank", "answer_id", weight.alias("weight"))


def replay_weights(ranked: DataFrame | RankedStore, epochs: int, val_counts: DataFrame,
                   reverse: bool = False, exact: bool = False) -> DataFrame:
    """Exact probability that each failure is the rejected answer of its
    (task, epoch) under the replay schedules:
    P(i) = (1[i in window] + added_t(i) / n_t(i)) / (W + sum added),
    the expansion of ``replay_runs``."""
    store = from_ranked(ranked)
    return expand_runs(replay_runs(store, epochs, val_counts, reverse, exact), store)
