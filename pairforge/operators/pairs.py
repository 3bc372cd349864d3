"""Static preference pairs and SFT rows from the flat ranked table.

Input: the ``ranked`` table of ``merge.merge_runs`` (one row per answer
with ``rank``, ``side_rank``, ``is_pass``, ``n_pass``, ``n_fail``).
Output rows carry the reference's pair columns
(id, problem, prompt, chosen, rejected) plus ``split`` and a position
column where order is part of the meaning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairforge.functions.draws import index_draw
from pairforge.functions.text import sft_text
from pairforge.operators.ranked_store import RankedStore, from_ranked
from pairforge.operators.ranking import group_rank, steps

TASK = ["split", "task_id"]
PAIR_BLOCK = 256
FEW_BLOCKS, WIDEST = 4, 16


def passes(ranked: DataFrame) -> DataFrame:
    return ranked.filter(F.col("is_pass"))


def failures(ranked: DataFrame) -> DataFrame:
    return ranked.filter(~F.col("is_pass"))


def select_pass(ranked: DataFrame) -> DataFrame:
    """Only the passing answers of each task, in rank order (``side_rank``)."""
    return passes(ranked)


def tasks(ranked: DataFrame, extra=()) -> DataFrame:
    """One row per task with its prompt and pass/fail counts."""
    return ranked.select(*TASK, "prompt", *[c for c in extra if c != "prompt"], "n_pass", "n_fail").distinct()


def _width(count: str, block: int) -> Column:
    """Rows in a block of a side of ``count`` rows: ``block`` up to FEW_BLOCKS blocks, then wider with the square root
    of ``count``, up to WIDEST times."""
    times = F.ceil(F.sqrt(F.col(count) / (FEW_BLOCKS * block)))
    return F.lit(block) * F.greatest(F.lit(1), F.least(F.lit(WIDEST), times))


def _cross_in_blocks(left: DataFrame, right: DataFrame, l_rank: str, r_rank: str,
                     l_count: str, r_count: str, block: int) -> DataFrame:
    """Every (left, right) row pair of the same task via an equi-join on blocks.

    Left rows are cut into blocks by their rank and copied to every block of
    the right side (and vice versa), so each join key holds one block x block
    of pairs however large a task is; a small task is a single block and costs
    what a plain equi-join costs. A row is copied once for each block of the
    other side, and blocks widen with their side (``_width``), so a task's
    copies grow with the power 1.5 of its rows and not with its pairs, up to
    262,144 rows a side for a ``block`` of 256; beyond, with its pairs, at a
    sixteenth of the number that blocks of ``block`` rows would take. Both
    sides have ``l_count`` and ``r_count``. Copies are few beside the pairs made
    of them, so they are dealt out to all shuffle partitions by number, which
    are not merged for having few bytes; and they are more than the tables'
    sizes tell, so neither side is broadcast.
    """
    zero, key = F.lit(0).cast("long"), [*TASK, "_lb", "_rb"]
    l_width, r_width = _width(l_count, block), _width(r_count, block)
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lb = (left.withColumn("_lb", F.floor(F.col(l_rank) / l_width))
              .withColumn("_rb", F.explode(F.sequence(zero, F.floor((F.col(r_count) - 1) / r_width)))))
    rb = (right.withColumn("_rb", F.floor(F.col(r_rank) / r_width))
               .withColumn("_lb", F.explode(F.sequence(zero, F.floor((F.col(l_count) - 1) / l_width))))
               .drop(l_count, r_count))
    return lb.repartition(parts, *key).hint("merge").join(rb.repartition(parts, *key), key).drop("_lb", "_rb")


def _of_answer(per_answer: dict[str, Column] | None, side: str) -> list[Column]:
    return [c.alias(f"{side}_{name}") for name, c in (per_answer or {}).items()]


def _names(per_answer: dict[str, Column] | None) -> list[str]:
    return [f"{side}_{name}" for side in ("chosen", "rejected") for name in per_answer or {}]


def all_pairs(ranked: DataFrame, with_problem: bool = True, block: int = PAIR_BLOCK,
              per_answer: dict[str, Column] | None = None) -> DataFrame:
    """Every passing answer x every failing answer of a task.

    The output has n_pass * n_fail rows per task by definition;
    ``pair_pos`` = chosen position * n_fail + rejected position is the
    reference emission order (chosen outer, rejected inner). ``per_answer``
    (name -> expression of ``ranked``) adds ``chosen_<name>`` and
    ``rejected_<name>``, worked out once for an answer and not for each of its
    pairs; where only these are used, no text is copied to a pair.
    """
    c = passes(ranked).select(*TASK, "prompt", "n_pass", "n_fail",
                              F.col("side_rank").alias("c_pos"), F.col("answer").alias("chosen"),
                              F.col("answer_id").alias("chosen_id"), *_of_answer(per_answer, "chosen"))
    r = failures(ranked).select(*TASK, "n_pass", "n_fail", F.col("side_rank").alias("r_pos"),
                                F.col("answer").alias("rejected"), F.col("answer_id").alias("rejected_id"),
                                *_of_answer(per_answer, "rejected"))
    j = _cross_in_blocks(c, r, "c_pos", "r_pos", "n_pass", "n_fail", block)
    cols = ["split", F.col("task_id").alias("id")]
    if with_problem:
        cols.append(F.col("prompt").alias("problem"))
    cols += [F.col("prompt"), "chosen", "rejected", "chosen_id", "rejected_id",
             (F.col("c_pos") * F.col("n_fail") + F.col("r_pos")).alias("pair_pos"), *_names(per_answer)]
    return j.select(*cols)


def pair_rank(c_pos, r_pos, n_fail="n_fail") -> Column:
    """Position of a pair in its task's list (chosen outer, rejected inner)."""
    c, r, n = (F.col(x) if isinstance(x, str) else x for x in (c_pos, r_pos, n_fail))
    return c * n + r


def pair_unrank(pair_pos, n_fail="n_fail") -> tuple[Column, Column]:
    """(position among passes, position among failures) of the pair at ``pair_pos``: the inverse of ``pair_rank``."""
    p, n = (F.col(x) if isinstance(x, str) else x for x in (pair_pos, n_fail))
    return _div(p, n), F.pmod(p, n).cast("long")


def _div(a, b) -> Column:
    """Whole quotient of non-negative numbers."""
    return F.call_function("div", F.col(a) if isinstance(a, str) else a, b if isinstance(b, Column) else F.lit(b)).cast("long")


def pair_space(ranked: DataFrame | RankedStore) -> DataFrame:
    """Tasks with ``n_pairs`` and ``first``, the number of the task's first pair among all pairs of its split.

    Tasks lie in the order of (first four digits of md5(task_id), task_id); offsets are sums over these
    65 536 blocks and within them, so no task numbers all tasks.
    """
    t = from_ranked(ranked).tasks.select(*TASK, "n_pass", "n_fail", (F.col("n_pass") * F.col("n_fail")).alias("n_pairs"),
                                         F.substring(F.md5("task_id"), 1, 4).alias("block"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("n_pairs").over(before(Window.partitionBy("split", "block").orderBy("task_id"))), F.lit(0))
    blocks = t.groupBy("split", "block").agg(F.sum("n_pairs").alias("_n"))
    offset = F.coalesce(F.sum("_n").over(before(Window.partitionBy("split").orderBy("block"))), F.lit(0))
    return (t.withColumn("_in", inside).join(blocks.select("split", "block", offset.alias("_off")), ["split", "block"])
             .select(*TASK, "n_pass", "n_fail", "n_pairs", (F.col("_off") + F.col("_in")).cast("long").alias("first")))


def _numbers(df: DataFrame, low: str, past: str, name: str, width: int = 4096) -> DataFrame:
    """One row per whole number of [low, past), unfolded in steps so that no array exceeds ``width`` entries (up to width**3)."""
    at, end, size = F.col(low), F.col(past), width * width
    df = df.filter(at < end).withColumns({"_a": at, "_e": end})
    while size >= 1:
        df = df.withColumn("_k", F.explode(F.sequence(_div("_a", size), _div(F.col("_e") - 1, size))))
        lo, hi = F.greatest("_a", F.col("_k") * size), F.least("_e", (F.col("_k") + 1) * size)
        df = df.withColumns({"_a": lo.cast("long"), "_e": hi.cast("long")}).drop("_k")
        size //= width
    return df.withColumn(name, F.col("_a")).drop("_a", "_e")


def pair_range(ranked: DataFrame | RankedStore, split: str, start, end) -> DataFrame:
    """The pairs numbered [start, end) among all pairs of a split (see ``pair_space``), built without the others.

    ``start`` and ``end`` are integers or one-row columns. A pair's number gives its task, and inside it both
    positions by division (``pair_unrank``); texts are looked up last. Rows: those asked for, with ``pair_no`` and
    ``pair_pos``. All pairs of a range of tasks or of the whole split are ranges like any other.
    """
    store = from_ranked(ranked).of_split(split)
    start, end = (F.lit(x).cast("long") if isinstance(x, int) else x for x in (start, end))
    t = pair_space(store).withColumn("_lo", F.greatest(start - F.col("first"), F.lit(0).cast("long")))
    t = t.withColumn("_hi", F.least(end - F.col("first"), F.col("n_pairs")))
    rows = _numbers(t, "_lo", "_hi", "pair_pos")
    c, r = pair_unrank("pair_pos")
    rows = rows.select(*TASK, (F.col("first") + F.col("pair_pos")).alias("pair_no"), "pair_pos", c.alias("c_pos"), r.alias("r_pos"))
    rows = store.look_up(rows, "r_pos", False, {"answer": "rejected", "answer_id": "rejected_id"})
    rows = store.look_up(rows, "c_pos", True, {"answer": "chosen", "answer_id": "chosen_id", "prompt": "prompt"})
    return rows.select("split", F.col("task_id").alias("id"), F.col("prompt").alias("problem"), "prompt", "chosen", "rejected",
                       "chosen_id", "rejected_id", "pair_pos", "pair_no")


def curriculum_pairs(ranked: DataFrame, increase: bool = True, block: int = PAIR_BLOCK,
                     per_answer: dict[str, Column] | None = None) -> DataFrame:
    """All pairs in curriculum order: passes and failures sorted by error
    frequency (ascending or descending, ties in rank order); ``pair_pos``
    gives the order. ``per_answer`` as in :func:`all_pairs`."""
    c = passes(ranked).select(*TASK, "prompt", "n_pass", "n_fail",
                              F.col("side_rank").alias("c_pos"), F.col("answer").alias("chosen"),
                              F.col("answer_id").alias("chosen_id"), *_of_answer(per_answer, "chosen"))
    f = failures(ranked).withColumns({f"_{n}": e for n, e in (per_answer or {}).items()})
    if increase:
        f = f.withColumn("r_pos", F.col("side_rank"))
    else:
        f = group_rank(f, TASK, [("error_frequency", False), ("side_rank", True)], name="r_pos",
                       blocks=[(F.col("error_frequency"), False), steps("side_rank")])
    r = f.select(*TASK, "n_pass", "n_fail", "r_pos", F.col("answer").alias("rejected"),
                 F.col("answer_id").alias("rejected_id"), *[F.col(f"_{n}").alias(f"rejected_{n}") for n in per_answer or {}])
    j = _cross_in_blocks(c, r, "c_pos", "r_pos", "n_pass", "n_fail", block)
    return j.select("split", F.col("task_id").alias("id"), F.col("prompt").alias("problem"), "prompt",
                    "chosen", "rejected", "chosen_id", "rejected_id",
                    (F.col("c_pos") * F.col("n_fail") + F.col("r_pos")).alias("pair_pos"), *_names(per_answer))


def one_pair(ranked: DataFrame, seed: int = 0) -> DataFrame:
    """One uniformly drawn pass and one uniformly drawn failure per task."""
    t = (tasks(ranked)
         .withColumn("c_pos", index_draw("n_pass", seed, F.col("split"), F.col("task_id"), "chosen"))
         .withColumn("r_pos", index_draw("n_fail", seed, F.col("split"), F.col("task_id"), "rejected")))
    c = passes(ranked).select(*TASK, F.col("side_rank").alias("c_pos"), F.col("answer").alias("chosen"),
                              F.col("answer_id").alias("chosen_id"))
    r = failures(ranked).select(*TASK, F.col("side_rank").alias("r_pos"), F.col("answer").alias("rejected"),
                                F.col("answer_id").alias("rejected_id"))
    return (t.join(c, [*TASK, "c_pos"]).join(r, [*TASK, "r_pos"])
             .select("split", F.col("task_id").alias("id"), F.col("prompt").alias("problem"), "prompt",
                     "chosen", "rejected", "chosen_id", "rejected_id"))


def sft_texts(ranked: DataFrame, problem_col: str = "prompt") -> DataFrame:
    """SFT rows: one ``### Question ... ### Answer ...`` text per passing answer."""
    return passes(ranked).select("split", F.col("task_id").alias("id"), "side_rank", "answer_id",
                                 sft_text(F.col(problem_col), F.col("answer")).alias("text"))


def sft_one_answer(ranked: DataFrame, seed: int = 0, problem_col: str = "prompt") -> DataFrame:
    """One uniformly drawn passing answer per task, as an SFT text."""
    t = tasks(ranked, [problem_col]).withColumn(
        "c_pos", index_draw("n_pass", seed, F.col("split"), F.col("task_id"), "sft"))
    c = passes(ranked).select(*TASK, F.col("side_rank").alias("c_pos"), "answer", "answer_id")
    return (t.join(c, [*TASK, "c_pos"])
             .select("split", F.col("task_id").alias("id"), "answer_id",
                     sft_text(F.col(problem_col), F.col("answer")).alias("text")))


def constant_columns(df: DataFrame, names=("prompt", "chosen", "rejected"), value: str = "") -> DataFrame:
    """Add (or overwrite) string columns holding one constant, e.g. the empty
    pair columns a dynamic pair builder fills per epoch."""
    return df.withColumns({n: F.lit(value) for n in names})
