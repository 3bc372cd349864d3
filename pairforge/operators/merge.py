"""Merge stage: verdict rows -> scored, deduplicated, filtered, ranked answers.

Order matters and follows the reference semantics:
error frequencies and the length sentinel are computed before
deduplication and filtering; time statistics after.

The durable result is the *flat ranked table* (one row per answer with a
``rank`` column); the nested per-task form is only a sink format.
Every per-task statistic is a partial-aggregated ``groupBy`` joined back,
never a window over a whole task, so a task holding a large share of the
rows does not end up in a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairforge.functions.text import PASS_SCALAR, cov, round_ratio
from pairforge.operators.ranking import group_rank, steps
from pairforge.operators.texts import dictionary, digest_names, resolve, with_digests
from pairforge.session import replace_partitions

TASK = ["split", "task_id"]
CHECK_KEYS = ["split", "task_id", "answer_id", "prompt", "answer", "output", "error_type"]
OVER_LARGE_PAD = 10000


def task_order_key(task_id="task_id"):
    """Numeric ids sort numerically, then everything else as text."""
    t = F.col(task_id)
    num = F.expr(f"try_cast({task_id} AS BIGINT)")
    return [num.isNull(), num, t]


def error_frequency(runs: DataFrame, keys=TASK) -> DataFrame:
    """Per (task, error type): share of the task's rows with that type.

    Computed on raw rows, all checks and passes included; rows with a NULL
    type count in neither numerator nor denominator.
    """
    per_type = (runs.filter(F.col("error_type").isNotNull())
                    .groupBy(*keys, "error_type").agg(F.count(F.lit(1)).alias("_n")))
    # Rows per task here = distinct error types of the task (small).
    w = Window.partitionBy(*keys)
    return per_type.withColumn("frequency", F.col("_n") / F.sum("_n").over(w)).drop("_n")


def average_checks(runs: DataFrame, keys=CHECK_KEYS) -> DataFrame:
    """Collapse repeated checks of one answer: mean of avg_time and std_time.

    Where ``runs`` holds digests instead of texts (``texts.with_digests``), those are the keys and the answer's
    length rides along.
    """
    extra = [F.max("answer_chars").alias("answer_chars")] if "answer_chars" in runs.columns else []
    return (runs.dropna(subset=list(keys))
                .groupBy(*keys)
                .agg(*extra, F.avg("avg_time").alias("avg_time"), F.avg("std_time").alias("std_time")))


def answer_chars(df: DataFrame):
    """Length of the answer: a column of its own beside a digest, else that of the text."""
    return F.col("answer_chars") if "answer_chars" in df.columns else F.length("answer").cast("long")


def max_length(df: DataFrame, by=("split",)) -> DataFrame:
    """Longest answer per split (one row per split)."""
    return df.groupBy(*by).agg(F.max(answer_chars(df)).cast("long").alias("max_length"))


def score(averaged: DataFrame, freq: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """Attach error_frequency (0.0 for passes) and the length score.

    ``lengths`` (split, max_length) is taken from the verdict rows where the
    caller has them, so the averaging isn't run again for it; it has one row
    per split and is read as one map by a scalar subquery, not joined.

    Passing answers score their length; failing ones score
    max(length in split) + 10000, so every failure sorts after every pass.
    """
    lens = lengths if lengths is not None else max_length(averaged)
    per_split = lens.agg(F.map_from_entries(F.collect_list(F.struct("split", "max_length")))).scalar()
    # Led by its hash, the key is mostly compared by that where the join sorts.
    key = ["split", "task_id", "error_type"]
    hashed = lambda df: df.withColumn("_pf_h", F.xxhash64(*key))
    scored = (hashed(averaged).join(hashed(freq), ["_pf_h", *key], "left").select(*averaged.columns, "frequency")
                      .withColumn("max_length", F.element_at(per_split, F.col("split"))))
    ef = (F.when(F.col("error_type") == "", F.lit(PASS_SCALAR))
           .otherwise(F.coalesce(F.col("frequency"), F.lit(float("inf")))))
    al = (F.when(F.col("output") == "passed", answer_chars(averaged))
           .otherwise(F.col("max_length") + OVER_LARGE_PAD))
    return (scored.withColumn("error_frequency", ef)
                  .withColumn("answer_length", al)
                  .drop("frequency", "max_length"))


def dedupe_keep_best(scored: DataFrame, scope: str = "split") -> DataFrame:
    """Keep one row per answer text: the first in (task, frequency, length) order.

    ``scope='split'`` dedupes across the whole split (reference behaviour);
    ``scope='task'`` only inside each task. Implemented as an aggregate of
    the minimum struct, so copies of a very common answer are combined
    map-side before the shuffle instead of meeting in one window.
    """
    by = ["split", "answer"] if scope == "split" else ["split", "task_id", "answer"]
    # A 64-bit hash of the text leads the key: the sort-based aggregate then
    # compares long texts only on hash ties; the text itself keeps it exact.
    keyed = scored.withColumn("_pf_h", F.xxhash64("answer"))
    # The order's own columns are read back from it, so a row's values go once.
    numeric, number, _ = task_order_key()
    order = ["task_id", "error_frequency", "answer_length", "answer_id", "output"]
    payload = [c for c in scored.columns if c not in by]
    rest = [c for c in payload if c not in order]
    best = F.min(F.struct(numeric.alias("_k0"), number.alias("_k1"), *order, *rest)).alias("_best")
    return (keyed.groupBy("_pf_h", *by).agg(best)
                 .select(*by, *[F.col(f"_best.{c}").alias(c) for c in payload])
                 .select(*scored.columns))


def task_counts(df: DataFrame) -> DataFrame:
    ok = F.col("error_frequency") == F.lit(PASS_SCALAR)
    return (df.groupBy(*TASK)
              .agg(F.count_if(ok).alias("n_pass"), F.count_if(~ok).alias("n_fail")))


def keep_contrastive(df: DataFrame, min_pass: int = 2, min_fail: int = 2) -> DataFrame:
    """Keep tasks with at least ``min_pass`` passing and ``min_fail`` failing answers.

    The reference applies two masks (>=1 pass & >=2 fail, then >=2 pass &
    >=1 fail); both keep or drop whole tasks, so together they are this one.
    """
    counts = task_counts(df).filter((F.col("n_pass") >= min_pass) & (F.col("n_fail") >= min_fail))
    # The per-task counts ride along (n_pass, n_fail): later stages need them.
    return df.join(counts, TASK, "inner")


def rank_answers(df: DataFrame) -> DataFrame:
    """0-based position in the per-task ranked list (``rank``), plus the
    position among the task's passes or among its failures (``side_rank``)."""
    order = ["error_frequency", "answer_length", "answer_id", "output"]
    # Failures of one type all have the same frequency and length: the answer id cuts them.
    df = group_rank(df, TASK, order, name="rank",
                    blocks=[F.col("error_frequency"), F.col("answer_length"), steps("answer_id")])
    # Passes score 0.0 and every failure scores above it, so all passes
    # come first: the position among failures is rank - n_pass.
    if "n_pass" not in df.columns:
        df = df.join(task_counts(df), TASK, "inner")
    ok = F.col("error_frequency") == F.lit(PASS_SCALAR)
    return (df.withColumn("is_pass", ok)
              .withColumn("side_rank", F.when(ok, F.col("rank")).otherwise(F.col("rank") - F.col("n_pass"))))


def error_type_order(ranked: DataFrame) -> DataFrame:
    """First-appearance order of the failing types of each task (0-based),
    with each type's answer count and start offset in the type-grouped list."""
    fails = ranked.filter(~F.col("is_pass"))
    per_type = fails.groupBy(*TASK, "error_type").agg(F.min("rank").alias("_first"),
                                                      F.count(F.lit(1)).alias("type_count"))
    # Rows per task = distinct failing types of the task (small).
    w = Window.partitionBy(*TASK).orderBy("_first")
    return (per_type.withColumn("type_order", (F.row_number().over(w) - 1).cast("long"))
                    .withColumn("type_start", F.coalesce(
                        F.sum("type_count").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                        F.lit(0)).cast("long"))
                    .drop("_first"))


def time_stats(kept: DataFrame) -> DataFrame:
    """Per task: passing count, mean and sample std of avg_time, and their ratio."""
    agg = (kept.groupBy(*TASK)
               .agg(F.count_if(F.col("error_frequency") == F.lit(PASS_SCALAR)).alias("count"),
                    F.avg("avg_time").alias("avg"),
                    F.stddev_samp("avg_time").alias("std")))
    return agg.withColumn("cov", cov("std", "avg"))


def filter_report(averaged: DataFrame, kept: DataFrame) -> DataFrame:
    """Totals before and after filtering, per split, as one row each.

    One union and two partial-aggregated levels (per task, then per
    split): no join, and a hot task is combined map-side.
    """
    tagged = (averaged.select("split", "task_id", F.lit(1).alias("_b"), F.lit(0).alias("_a"))
                      .unionByName(kept.select("split", "task_id", F.lit(0).alias("_b"), F.lit(1).alias("_a"))))
    per_task = tagged.groupBy("split", "task_id").agg(F.sum("_b").alias("_nb"), F.sum("_a").alias("_na"))
    r = per_task.groupBy("split").agg(
        F.count_if(F.col("_nb") > 0).alias("total_prob"), F.sum("_nb").cast("long").alias("total_ans"),
        F.count_if(F.col("_na") > 0).alias("filtered_prob"), F.sum("_na").cast("long").alias("filtered_ans"))
    return (r.withColumn("ratio_prob", round_ratio("filtered_prob", "total_prob"))
             .withColumn("ratio_ans", round_ratio("filtered_ans", "total_ans")))


# The report's text lines (label, column, decimals or None).
REPORT_LINES = [
    ("Problems (total): ", "total_prob", None),
    ("Problems (filtered): ", "filtered_prob", None),
    ("Problems (ratio): ", "ratio_prob", 2),
    ("", None, None),
    ("Answers (total): ", "total_ans", None),
    ("Answers (filtered): ", "filtered_ans", None),
    ("Answers (ratio): ", "ratio_ans", 2),
]


def report_lines(report: DataFrame) -> DataFrame:
    """The filter report as text lines per split (line_no, line)."""
    items = []
    for i, (label, col, dec) in enumerate(REPORT_LINES):
        if col is None:
            text = F.lit(label)
        elif dec is None:
            text = F.concat(F.lit(label), F.col(col).cast("string"))
        else:
            text = F.concat(F.lit(label), F.format_string(f"%.{dec}f", F.col(col)))
        items.append(F.struct(F.lit(i).cast("long").alias("line_no"), text.alias("line")))
    return report.select("split", F.explode(F.array(*items)).alias("l")).select("split", "l.line_no", "l.line")


def write_report_text(report: DataFrame, path: str) -> None:
    """One text file per split, lines in order (a handful of rows per split)."""
    lines = report_lines(report).repartition("split").sortWithinPartitions("split", "line_no")
    replace_partitions(lines.select("split", "line"), "split").text(path)


def assert_non_empty(df: DataFrame, what: str = "samples") -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"No available {what}.")
    return df


class MergeResult:
    """The merge stage's tables, built on first access.

    All work is done on digests (``texts.with_digests``): no shuffle of the
    merge carries a prompt or an answer. ``slim`` holds the tables with digests
    (``averaged``, ``scored``, ``deduped``, ``kept``, ``ranked``); the same names
    on the result itself have the texts put back. Use ``slim`` where texts are
    not wanted.

    ``deduped`` and ``kept`` (with digests) and ``ranked`` (with texts) are the
    stage's durable tables, read several times each: they are written once as Parquet
    under ``spark.checkpoint.dir`` when first asked for and read back, so a lost
    executor does not force recomputing the stage. Where ``digested`` names the
    verdict rows with their answers' digests, so that no text went through the plan
    that made them, the rows are written, too: averages, frequencies and lengths
    read them, and each text is digested once.

    ``ranked_md5`` is ``ranked`` with md5 of each answer, in hex, for its text: no
    answer is shuffled or stored for it.
    """

    TEXTS = ("prompt", "answer")

    def __init__(self, runs: DataFrame, dedupe_scope: str = "split", min_pass: int = 2,
                 min_fail: int = 2, materialize: bool = True, raw: DataFrame | None = None,
                 digested: DataFrame | None = None):
        self._source = runs if raw is None else raw
        self._digested = digested
        self.runs = with_digests(runs, self.TEXTS) if digested is None else with_digests(digested, ["prompt"], ())
        self.raw = self.runs if raw is None else with_digests(raw, self.TEXTS)
        self.dedupe_scope, self.min_pass, self.min_fail = dedupe_scope, min_pass, min_fail
        self.materialize = materialize
        self.slim = _Slim(self)
        self._cache: dict[str, DataFrame] = {}

    def _get(self, name, build):
        if name not in self._cache:
            self._cache[name] = build()
        return self._cache[name]

    def _store(self, df, name):
        if not self.materialize:
            return df
        from pairforge.session import materialize
        return materialize(df, name)

    @property
    def texts(self):
        """The dictionary, a table: joins with it then have a plain shuffle on either side, which AQE can split where
        one prompt is on very many rows."""
        return self._get("texts", lambda: self._store(dictionary(self._source, [c for c in self.TEXTS if c in self._source.columns]), "texts"))

    @property
    def rows(self):
        """The verdict rows with digests; a table where they came with them."""
        if self._digested is None:
            return self.runs
        return self._get("rows", lambda: self._store(self.runs.select(*CHECK_KEYS, "avg_time", "std_time", "answer_chars", "answer_hash"), "rows"))

    def _texts(self, df):
        return resolve(df.drop("answer_chars"), self.texts, self.TEXTS)

    @property
    def frequency(self):
        return self._get("frequency", lambda: error_frequency(self.raw if self._digested is None else self.rows))

    @property
    def averaged(self):
        return self._get("averaged", lambda: self._texts(self.slim.averaged))

    @property
    def scored(self):
        return self._get("scored", lambda: self._texts(self.slim.scored))

    @property
    def deduped(self):
        return self._get("deduped", lambda: self._texts(self.slim.deduped))

    @property
    def kept(self):
        return self._get("kept", lambda: self._texts(self.slim.kept))

    @property
    def ranked(self):
        return self._get("ranked", lambda: self._store(self._texts(self.slim.ranked), "ranked"))

    @property
    def ranked_md5(self):
        def build():
            prompts = self._store(dictionary(self._source, ["prompt"]), "prompts")
            hashed = with_digests(self._source, ["answer"], (), ["answer"]) if self._digested is None else self.rows
            names = self._store(digest_names(hashed), "names")
            ranked = self.slim.ranked.drop("answer_chars")
            return self._store(resolve(resolve(ranked, prompts, ["prompt"]), names, ["answer"]), "ranked-md5")
        return self._get("ranked md5", build)

    @property
    def times(self):
        return self._get("times", lambda: time_stats(self.slim.kept))

    @property
    def report(self):
        return self._get("report", lambda: filter_report(self.slim.averaged, self.slim.kept))

    def __getitem__(self, name):
        return getattr(self, name)


class _Slim:
    """The merge stage's tables with digests in place of texts."""

    def __init__(self, result: MergeResult):
        self._m = result

    def _get(self, name, build):
        return self._m._get("slim " + name, build)

    def __getitem__(self, name):
        return getattr(self, name)

    @property
    def averaged(self):
        return self._get("averaged", lambda: average_checks(self._m.rows))

    @property
    def scored(self):
        texts = self._m._source if self._m._digested is None else self._m.rows  # a length needs no digest
        return self._get("scored", lambda: score(
            self.averaged, self._m.frequency, max_length(texts.dropna(subset=[k for k in CHECK_KEYS if k in texts.columns]))))

    @property
    def deduped(self):
        return self._get("deduped", lambda: dedupe_keep_best(self.scored, self._m.dedupe_scope))

    @property
    def _stored(self):
        """The deduplicated answers as a table: they are read for the task counts and again for the rows, and their
        plan reads all verdicts with their texts."""
        return self._get("stored", lambda: self._m._store(self.deduped, "deduped"))

    @property
    def kept(self):
        return self._get("kept", lambda: self._m._store(keep_contrastive(self._stored, self._m.min_pass, self._m.min_fail), "kept"))

    @property
    def ranked(self):
        return self._get("ranked", lambda: rank_answers(self.kept))


def merge_runs(runs: DataFrame, dedupe_scope: str = "split", min_pass: int = 2,
               min_fail: int = 2, materialize: bool = True, raw: DataFrame | None = None,
               digested: DataFrame | None = None) -> MergeResult:
    """The whole merge stage. Tables by name: frequency, averaged, scored,
    deduped, kept, ranked (the durable flat result), ranked_md5, times, report.

    ``raw`` may name the same rows without computed answer ids: frequencies,
    lengths and texts, which need none, are then read from it. ``digested``
    may name the same rows with ``answer``, ``answer_chars`` and ``answer_hash``
    from ``texts.with_digests``: only the dictionary of texts is then read from
    ``runs``."""
    return MergeResult(runs, dedupe_scope, min_pass, min_fail, materialize, raw, digested)


def nest_answers(ranked: DataFrame, times: DataFrame) -> DataFrame:
    """Sink form: one row per answer with its place in the task's list and the
    task's time statistics, so a task of any size is never one array."""
    answer = F.struct(F.col("answer").alias("text"), "error_frequency", "error_type", "answer_length")
    t = F.struct(F.col("count").cast("long").alias("count"), "avg", "std", "cov")
    return (ranked.join(times, TASK, "left")
                  .select("split", F.col("task_id").alias("id"), F.col("prompt").alias("problem"),
                          "rank", answer.alias("answer"), t.alias("time")))
