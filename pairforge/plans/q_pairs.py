"""Registered queries: static pairs and SFT rows (over the R2 merge)."""

from pyspark.sql import functions as F

from pairforge.functions.draws import sql_unit_draw
from pairforge.functions.text import SFT_TEMPLATE, SYSTEM_PROMPT, add_system_prompt, sql_literal
from pairforge.operators import pairs as P
from pairforge.plans import oracle_fixtures as O
from pairforge.plans.q_merge import R1_MERGE, R2_MERGE, stage_merge, stage_store
from pairforge.plans.registry import register

SEED = 7
SYS_HEAD, SYS_TAIL = (sql_literal(part) for part in SYSTEM_PROMPT.split("{}"))
SFT_QUESTION, SFT_ANSWER = (sql_literal(part) for part in SFT_TEMPLATE)


def _md5():
    """The digest of an answer, worked out once for all its pairs."""
    return {"md5": F.md5("answer")}


def _pair_cols(df):
    return df.select("split", "id", "problem", "prompt", "chosen_md5", "rejected_md5", "chosen_id", "rejected_id", "pair_pos")


_ALL_PAIRS_SQL = R2_MERGE + """
SELECT c.split, c.task_id AS id, c.prompt AS problem, c.prompt, md5(c.answer) AS chosen_md5,
       md5(r.answer) AS rejected_md5, c.answer_id AS chosen_id, r.answer_id AS rejected_id,
       c.side_rank * c.n_fail + r.side_rank AS pair_pos
FROM ranked c JOIN ranked r ON c.split = r.split AND c.task_id = r.task_id
WHERE c.is_pass AND NOT r.is_pass
"""


@register("all_pairs", _ALL_PAIRS_SQL)
def all_pairs(spark, sf_dir):
    return _pair_cols(P.all_pairs(stage_merge(spark, sf_dir, "r2")["ranked"], per_answer=_md5()))


@register("all_pairs_compact", R2_MERGE + """
SELECT c.split, c.task_id AS id, c.prompt, md5(c.answer) AS chosen_md5, md5(r.answer) AS rejected_md5,
       c.side_rank * c.n_fail + r.side_rank AS pair_pos
FROM ranked c JOIN ranked r ON c.split = r.split AND c.task_id = r.task_id
WHERE c.is_pass AND NOT r.is_pass
""")
def all_pairs_compact(spark, sf_dir):
    p = P.all_pairs(stage_merge(spark, sf_dir, "r2")["ranked"], with_problem=False, per_answer=_md5())
    return p.select("split", "id", "prompt", "chosen_md5", "rejected_md5", "pair_pos")


@register("all_pairs_runs", O.merge_over("SELECT * FROM r1", ("r1", O.R1)) + """
SELECT c.split, c.task_id AS id, c.prompt AS problem, c.prompt, md5(c.answer) AS chosen_md5,
       md5(r.answer) AS rejected_md5, c.answer_id AS chosen_id, r.answer_id AS rejected_id,
       c.side_rank * c.n_fail + r.side_rank AS pair_pos
FROM ranked c JOIN ranked r ON c.split = r.split AND c.task_id = r.task_id
WHERE c.is_pass AND NOT r.is_pass
""")
def all_pairs_runs(spark, sf_dir):
    return _pair_cols(P.all_pairs(stage_merge(spark, sf_dir, "r1")["ranked"], per_answer=_md5()))


@register("curriculum_pairs", _ALL_PAIRS_SQL)
def curriculum_pairs(spark, sf_dir):
    return _pair_cols(P.curriculum_pairs(stage_merge(spark, sf_dir, "r2")["ranked"], increase=True, per_answer=_md5()))


@register("curriculum_pairs_desc", R2_MERGE + """
, rf AS (SELECT *, row_number() OVER (PARTITION BY split, task_id ORDER BY error_frequency DESC, side_rank) - 1
                   AS r_pos FROM ranked WHERE NOT is_pass)
SELECT c.split, c.task_id AS id, c.prompt AS problem, c.prompt, md5(c.answer) AS chosen_md5,
       md5(r.answer) AS rejected_md5, c.answer_id AS chosen_id, r.answer_id AS rejected_id,
       c.side_rank * c.n_fail + r.r_pos AS pair_pos
FROM ranked c JOIN rf r ON c.split = r.split AND c.task_id = r.task_id
WHERE c.is_pass
""")
def curriculum_pairs_desc(spark, sf_dir):
    ranked = stage_merge(spark, sf_dir, "r2")["ranked_md5"]  # of an answer, pairs have its digest alone
    return _pair_cols(P.curriculum_pairs(ranked, increase=False, per_answer={"md5": F.col("answer")}))


_TASKS_SQL = ", tasks AS (SELECT DISTINCT split, task_id, prompt, n_pass, n_fail FROM ranked)"


@register("one_pair", R2_MERGE + _TASKS_SQL + f"""
, t AS (SELECT *, CAST(floor({sql_unit_draw(SEED, 'split', 'task_id', "'chosen'")} * n_pass) AS BIGINT) AS c_pos,
               CAST(floor({sql_unit_draw(SEED, 'split', 'task_id', "'rejected'")} * n_fail) AS BIGINT) AS r_pos
        FROM tasks)
SELECT t.split, t.task_id AS id, t.prompt AS problem, t.prompt, md5(c.answer) AS chosen_md5,
       md5(r.answer) AS rejected_md5, c.answer_id AS chosen_id, r.answer_id AS rejected_id
FROM t JOIN ranked c ON c.split = t.split AND c.task_id = t.task_id AND c.is_pass AND c.side_rank = t.c_pos
       JOIN ranked r ON r.split = t.split AND r.task_id = t.task_id AND NOT r.is_pass AND r.side_rank = t.r_pos
""")
def one_pair(spark, sf_dir):
    p = P.one_pair(stage_merge(spark, sf_dir, "r2")["ranked"], seed=SEED)
    return p.select("split", "id", "problem", "prompt", F.md5("chosen").alias("chosen_md5"),
                    F.md5("rejected").alias("rejected_md5"), "chosen_id", "rejected_id")


@register("select_pass", R2_MERGE + """
SELECT split, task_id AS id, answer_id, side_rank, md5(answer) AS text_md5 FROM ranked WHERE is_pass
""")
def select_pass(spark, sf_dir):
    p = P.select_pass(stage_merge(spark, sf_dir, "r2")["ranked"])
    return p.select("split", F.col("task_id").alias("id"), "answer_id", "side_rank",
                    F.md5("answer").alias("text_md5"))


@register("sft_texts", R2_MERGE + f"""
SELECT split, task_id AS id, answer_id, side_rank,
       md5({SFT_QUESTION} || {SYS_HEAD} || prompt || {SYS_TAIL} || {SFT_ANSWER} || answer)
       AS text_md5
FROM ranked WHERE is_pass
""")
def sft_texts(spark, sf_dir):
    r = stage_merge(spark, sf_dir, "r2")["ranked"].withColumn("problem", add_system_prompt("prompt"))
    s = P.sft_texts(r, problem_col="problem")
    return s.select("split", "id", "answer_id", "side_rank", F.md5("text").alias("text_md5"))


@register("sft_one_answer", R2_MERGE + _TASKS_SQL + f"""
, t AS (SELECT *, CAST(floor({sql_unit_draw(SEED, 'split', 'task_id', "'sft'")} * n_pass) AS BIGINT) AS c_pos
        FROM tasks)
SELECT t.split, t.task_id AS id, c.answer_id,
       md5({SFT_QUESTION} || {SYS_HEAD} || t.prompt || {SYS_TAIL} || {SFT_ANSWER} || c.answer)
       AS text_md5
FROM t JOIN ranked c ON c.split = t.split AND c.task_id = t.task_id AND c.is_pass AND c.side_rank = t.c_pos
""")
def sft_one_answer(spark, sf_dir):
    r = stage_merge(spark, sf_dir, "r2")["ranked"].withColumn("problem", add_system_prompt("prompt"))
    s = P.sft_one_answer(r, seed=SEED, problem_col="problem")
    return s.select("split", "id", "answer_id", F.md5("text").alias("text_md5"))


def _sft_format(row):
    """A user formatting function: one SFT text for the row's answer."""
    return [SFT_TEMPLATE[0] + row["problem"] + SFT_TEMPLATE[1] + row["answer"]]


@register("sft_format_hook", R2_MERGE + f"""
SELECT split, task_id AS id, answer_id,
       md5({SFT_QUESTION} || {SYS_HEAD} || prompt || {SYS_TAIL} || {SFT_ANSWER} || answer)
       AS text_md5
FROM ranked WHERE is_pass
""")
def sft_format_hook(spark, sf_dir):
    from pairforge.operators.hooks import formatting_hook
    r = P.select_pass(stage_merge(spark, sf_dir, "r2")["ranked"]).withColumn("problem", add_system_prompt("prompt"))
    h = formatting_hook(r, _sft_format, ["problem", "answer"])
    return h.select("split", F.col("task_id").alias("id"), "answer_id",
                    F.explode("texts").alias("text")).select("split", "id", "answer_id",
                                                             F.md5("text").alias("text_md5"))


RANGES = 4


@register("pair_range", R1_MERGE + f"""
, tasks AS (SELECT DISTINCT split, task_id, n_pass, n_fail FROM ranked WHERE split = 'train'),
space AS (SELECT *, CAST(coalesce(sum(n_pass * n_fail) OVER (PARTITION BY split ORDER BY substr(md5(task_id), 1, 4), task_id
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM tasks),
total AS (SELECT CAST(sum(n_pass * n_fail) AS BIGINT) AS t FROM tasks),
pairs AS (SELECT c.split, c.task_id AS id, md5(c.prompt) AS prompt_md5, md5(c.answer) AS chosen_md5, md5(r.answer) AS rejected_md5,
                 c.answer_id AS chosen_id, r.answer_id AS rejected_id, c.side_rank * c.n_fail + r.side_rank AS pair_pos,
                 s.first + c.side_rank * c.n_fail + r.side_rank AS pair_no
          FROM ranked c JOIN ranked r ON c.split = r.split AND c.task_id = r.task_id JOIN space s ON s.split = c.split AND s.task_id = c.task_id
          WHERE c.is_pass AND NOT r.is_pass)
SELECT pairs.*, k.part FROM pairs, total, (SELECT CAST(unnest(range({RANGES})) AS BIGINT) AS part) k
WHERE pair_no >= t * k.part // {RANGES} AND pair_no < t * (k.part + 1) // {RANGES}
""")
def pair_range(spark, sf_dir):
    """All pairs of the train split as consecutive ranges of equal size, each built from its pair numbers alone."""
    store = stage_store(spark, sf_dir).of_split("train")
    total = store.tasks.select(F.sum(F.col("n_pass") * F.col("n_fail"))).scalar()
    at = lambda k: F.call_function("div", total * F.lit(k), F.lit(RANGES))
    out = None
    for k in range(RANGES):
        part = P.pair_range(store, "train", at(k), at(k + 1)).withColumn("part", F.lit(k).cast("long"))
        out = part if out is None else out.unionByName(part)
    return out.select("split", "id", F.md5("prompt").alias("prompt_md5"), F.md5("chosen").alias("chosen_md5"), F.md5("rejected").alias("rejected_md5"),
                      "chosen_id", "rejected_id", "pair_pos", "pair_no", "part")
