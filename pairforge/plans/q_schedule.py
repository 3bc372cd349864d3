"""Registered queries: per-epoch progressive pairs over the R1 train merge,
with validation feedback from V1 (error counts per day). Validations are
spread over the epochs with gaps, and every seventh one has no failure, so
that feedback stays in force, is replaced and is cleared."""

from pyspark.sql import functions as F

from pairforge.functions.draws import sql_unit_draw
from pairforge.operators import schedule as K
from pairforge.plans import fixtures as X
from pairforge.plans import oracle_fixtures as O
from pairforge.plans.q_merge import stage_store
from pairforge.plans.registry import r6, register
from pairforge.session import scratch_path
from pairforge.streaming import stream as ST

EPOCHS = 5
# The 30 days of validation end at step 29 + 29 // 3 = 38.
REPLAY_EPOCHS = 40
SEED = 11


def _u(tag, t=""):
    q = f"{t}." if t else ""
    return sql_unit_draw(SEED, f"{q}split", f"{q}task_id", f"{q}epoch", f"'{tag}'")


def _fs(k, n, epochs):
    return f"CAST(floor(CAST({k} AS DOUBLE) * (CAST({n} AS DOUBLE) / CAST({epochs} AS DOUBLE))) AS BIGINT)"


def sql_bounds(mode, n, epochs=EPOCHS):
    e = "epoch"
    if mode in ("iter", "expand", "reverse", "type"):
        s, t0 = _fs(e, n, epochs), _fs(f"{e} + 1", n, epochs)
        t = f"(CASE WHEN {t0} = {s} THEN least({s} + 1, {n}) ELSE {t0} END)"
        if mode in ("iter", "type"):
            return s, t
        if mode == "expand":
            return "CAST(0 AS BIGINT)", t
        return f"({n} - {t})", f"({n} - {s})"
    if mode == "reverse_expand":
        return _fs(f"{epochs} - {e} - 1", n, epochs), n
    if mode == "type_reverse":
        s = f"least({_fs(f'{epochs} - {e} - 1', n, epochs)}, {n} - 1)"
        t = f"least({_fs(f'{epochs} - {e}', n, epochs)}, {n})"
        return s, f"greatest({s} + 1, {t})"
    raise ValueError(mode)


_SPREAD_SQL = """first AS (SELECT min(step) AS f FROM v1),
v2 AS (SELECT (step - f) + (step - f) // 3 AS p,
              CASE WHEN (step - f) % 7 = 6 THEN '' ELSE error_type END AS error_type, n FROM v1, first),
v3 AS (SELECT p, error_type, CAST(sum(n) AS BIGINT) AS cnt FROM v2 GROUP BY ALL),
"""
_LATEST_SQL = """v3 AS (SELECT CAST(0 AS BIGINT) AS p, error_type, CAST(n AS BIGINT) AS cnt FROM v1
       WHERE step = (SELECT max(step) FROM v1)),
"""


def base_sql(epochs, latest=False):
    held = _LATEST_SQL if latest else _SPREAD_SQL
    return O.merge_over("SELECT * FROM r1", ("r1", O.R1)) + f"""
, rk AS (SELECT * FROM ranked WHERE split = 'train'),
tasks AS (SELECT DISTINCT split, task_id, prompt, n_pass, n_fail FROM rk),
types AS (
  SELECT split, task_id, error_type, type_count,
         row_number() OVER (PARTITION BY split, task_id ORDER BY first_rank) - 1 AS type_order,
         CAST(coalesce(sum(type_count) OVER (PARTITION BY split, task_id ORDER BY first_rank
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS type_start
  FROM (SELECT split, task_id, error_type, min(rank) AS first_rank, count(*) AS type_count
        FROM rk WHERE NOT is_pass GROUP BY ALL)),
ntypes AS (SELECT split, task_id, count(*) AS n_types FROM types GROUP BY ALL),
fi AS (
  SELECT f.split, f.task_id, f.error_type, f.side_rank, f.answer_id, md5(f.answer) AS rejected_md5, t.type_order, t.type_start, t.type_count,
         row_number() OVER (PARTITION BY f.split, f.task_id, f.error_type ORDER BY f.side_rank) - 1 AS type_rank
  FROM rk f JOIN types t ON f.split = t.split AND f.task_id = t.task_id AND f.error_type = t.error_type
  WHERE NOT f.is_pass),
te0 AS (SELECT t.*, CAST(e.epoch AS BIGINT) AS epoch
        FROM tasks t, (SELECT unnest(range(0, {epochs})) AS epoch) e),
te AS (
  SELECT te0.*, c.answer_id AS chosen_id, c.side_rank AS c_pos, md5(c.answer) AS chosen_md5
  FROM te0 JOIN rk c ON c.split = te0.split AND c.task_id = te0.task_id AND c.is_pass
   AND c.side_rank = CAST(floor({_u('chosen', 'te0')} * te0.n_pass) AS BIGINT)),
v1 AS ({O.V1}),
{held}force AS (SELECT e.epoch, max(v3.p) AS p FROM (SELECT unnest(range(1, {epochs})) AS epoch) e JOIN v3 ON v3.p <= e.epoch - 1
          GROUP BY e.epoch),
vc AS (SELECT epoch, error_type, cnt,
              CAST(sum(cnt) OVER (PARTITION BY epoch) AS BIGINT) AS total,
              CAST(ceil(cnt / min(cnt) OVER (PARTITION BY epoch)) AS BIGINT) AS least_cnt
       FROM force JOIN v3 USING (p) WHERE error_type <> '')
"""


BASE, REPLAY_BASE = base_sql(EPOCHS), base_sql(REPLAY_EPOCHS)

OUT = """SELECT split, task_id AS id, epoch, '{name}' AS schedule, c_pos, r_pos, chosen_id, rejected_id,
       chosen_md5, rejected_md5 FROM picked"""


def window_sql(name, mode):
    if mode is None:
        lo, hi = "CAST(0 AS BIGINT)", "n_fail"
    else:
        lo, hi = sql_bounds(mode, "n_fail")
    return BASE + f"""
, w AS (SELECT te.*, {lo} AS lo, {hi} AS hi FROM te),
picked AS (
  SELECT w.*, f.side_rank AS r_pos, f.answer_id AS rejected_id, f.rejected_md5
  FROM w JOIN fi f ON f.split = w.split AND f.task_id = w.task_id
   AND f.side_rank = w.lo + CAST(floor({_u('rejected', 'w')} * (w.hi - w.lo)) AS BIGINT))
""" + OUT.format(name=name)


def type_sql(name, mode):
    ts, tt = sql_bounds(mode, "n_types")
    return BASE + f"""
, w0 AS (SELECT te.*, nt.n_types FROM te JOIN ntypes nt ON nt.split = te.split AND nt.task_id = te.task_id),
w1 AS (SELECT w0.*, {ts} AS t_lo, {tt} - 1 AS t_last FROM w0),
w AS (SELECT w1.*, a.type_start AS lo, b.type_start + b.type_count AS hi
      FROM w1 JOIN types a ON a.split = w1.split AND a.task_id = w1.task_id AND a.type_order = w1.t_lo
              JOIN types b ON b.split = w1.split AND b.task_id = w1.task_id AND b.type_order = w1.t_last),
picked AS (
  SELECT w.*, f.side_rank AS r_pos, f.answer_id AS rejected_id, f.rejected_md5
  FROM w JOIN fi f ON f.split = w.split AND f.task_id = w.task_id
   AND f.type_start + f.type_rank = w.lo + CAST(floor({_u('rejected', 'w')} * (w.hi - w.lo)) AS BIGINT))
""" + OUT.format(name=name)


def replay_ctes(mode, epochs=REPLAY_EPOCHS):
    lo, hi = sql_bounds(mode, "n_fail", epochs)
    return f"""
, w AS (SELECT te.*, {lo} AS lo, {hi} AS hi, {hi} - {lo} AS W FROM te),
added0 AS (
  SELECT w.split, w.task_id, w.epoch, vc.error_type, ty.type_count, vc.cnt,
         greatest(vc.least_cnt, CAST(floor(CAST(w.W AS DOUBLE) * (vc.cnt / vc.total)) AS BIGINT)) AS added
  FROM w JOIN vc ON vc.epoch = w.epoch
         JOIN types ty ON ty.split = w.split AND ty.task_id = w.task_id AND ty.error_type = vc.error_type),
added AS (
  SELECT *, coalesce(sum(added) OVER (PARTITION BY split, task_id, epoch ORDER BY cnt DESC, error_type
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum_before
  FROM added0),
tot AS (SELECT split, task_id, epoch, CAST(sum(added) AS BIGINT) AS A FROM added GROUP BY ALL),
wa AS (SELECT w.*, coalesce(tot.A, 0) AS A FROM w LEFT JOIN tot
       ON tot.split = w.split AND tot.task_id = w.task_id AND tot.epoch = w.epoch)
"""


def priority_sql(name, mode, base=None, epochs=REPLAY_EPOCHS):
    return (base or REPLAY_BASE) + replay_ctes(mode, epochs) + f"""
, wp AS (SELECT wa.*, CAST(floor({_u('rejected')} * (W + A)) AS BIGINT) AS p FROM wa),
pick_w AS (
  SELECT wp.*, f.side_rank AS r_pos, f.answer_id AS rejected_id, f.rejected_md5
  FROM wp JOIN fi f ON f.split = wp.split AND f.task_id = wp.task_id AND f.side_rank = wp.lo + wp.p
  WHERE wp.p < wp.W),
pick_t AS (
  SELECT wp.*, a.error_type AS rtype,
         CAST(floor({_u('replay', 'wp')}
                    * a.type_count) AS BIGINT) AS rt
  FROM wp JOIN added a ON a.split = wp.split AND a.task_id = wp.task_id AND a.epoch = wp.epoch
  WHERE wp.p >= wp.W AND wp.p - wp.W >= a.cum_before AND wp.p - wp.W < a.cum_before + a.added),
pick_r AS (
  SELECT pick_t.*, f.side_rank AS r_pos, f.answer_id AS rejected_id, f.rejected_md5
  FROM pick_t JOIN fi f ON f.split = pick_t.split AND f.task_id = pick_t.task_id
   AND f.error_type = pick_t.rtype AND f.type_rank = pick_t.rt),
picked AS (
  SELECT split, task_id, epoch, c_pos, r_pos, chosen_id, rejected_id, chosen_md5, rejected_md5 FROM pick_w
  UNION ALL
  SELECT split, task_id, epoch, c_pos, r_pos, chosen_id, rejected_id, chosen_md5, rejected_md5 FROM pick_r)
""" + OUT.format(name=name)


def _store(spark, sf_dir):
    """The stage tables of the train split (see ``stage_store``)."""
    return stage_store(spark, sf_dir).of_split("train")


def _feedback(spark, sf_dir):
    """Validation counts by epoch from V1, spread with gaps; every seventh validation has no failure."""
    m = X.v1_metrics(spark, sf_dir)
    first = m.select(F.min("step")).scalar()
    day = F.col("step") - first
    m = (m.select(day.alias("day"), "error_type", "n")
          .select((F.col("day") + F.floor(F.col("day") / 3)).cast("long").alias("step"),
                  F.when(F.col("day") % 7 == 6, "").otherwise(F.col("error_type")).alias("error_type"), "n")
          .groupBy("step", "error_type").agg(F.sum("n").alias("n")))
    return K.validation_counts_by_epoch(m, REPLAY_EPOCHS)


def _pick_cols(df):
    return df.select("split", "id", "epoch", "schedule", "c_pos", "r_pos", "chosen_id", "rejected_id",
                     F.md5("chosen").alias("chosen_md5"), F.md5("rejected").alias("rejected_md5"))


def _register_schedule(name, sql):
    @register(name, sql)
    def q(spark, sf_dir):
        replay = name.endswith("_priority")
        val = _feedback(spark, sf_dir) if replay else None
        return _pick_cols(K.progressive_pairs(_store(spark, sf_dir), name, REPLAY_EPOCHS if replay else EPOCHS,
                                              seed=SEED, val_counts=val))
    q.__name__ = name
    return q


_register_schedule("pvf", window_sql("pvf", None))
_register_schedule("pvf_iter", window_sql("pvf_iter", "iter"))
_register_schedule("pvf_iter_expand", window_sql("pvf_iter_expand", "expand"))
_register_schedule("pvf_iter_reverse", window_sql("pvf_iter_reverse", "reverse"))
_register_schedule("pvf_iter_reverse_expand", window_sql("pvf_iter_reverse_expand", "reverse_expand"))
_register_schedule("pvf_iter_type", type_sql("pvf_iter_type", "type"))
_register_schedule("pvf_iter_type_reverse", type_sql("pvf_iter_type_reverse", "type_reverse"))
_register_schedule("pvf_iter_priority", priority_sql("pvf_iter_priority", "iter"))
_register_schedule("pvf_iter_reverse_priority", priority_sql("pvf_iter_reverse_priority", "reverse"))


@register("pvf_iter_streamed", priority_sql("pvf_iter_priority", "iter", base_sql(EPOCHS, latest=True), EPOCHS))
def pvf_iter_streamed(spark, sf_dir):
    """Replay from the metrics a stream has kept: the newest validation holds from epoch 1 on."""
    metrics_dir, state_dir, ck = (scratch_path(spark, n) for n in ("feedback-in", "feedback-state", "feedback-ck"))
    X.v1_metrics(spark, sf_dir).repartition(4, "step").write.json(metrics_dir)
    ST.stream_latest_metrics(spark, metrics_dir, state_dir, ck, max_files_per_trigger=1).awaitTermination()
    val = K.validation_counts_by_epoch(ST.current_state(spark, state_dir), EPOCHS)
    return _pick_cols(K.progressive_pairs(_store(spark, sf_dir), "pvf_iter_priority", EPOCHS, seed=SEED, val_counts=val))


_B = {m: sql_bounds(m, "n_fail") for m in ("iter", "expand", "reverse", "reverse_expand")}
_T = {m: sql_bounds(m, "n_types") for m in ("type", "type_reverse")}


@register("epoch_bounds", BASE + f"""
SELECT te0.split, te0.task_id, te0.epoch, te0.n_fail, nt.n_types,
       {_B['iter'][0]} AS iter_lo, {_B['iter'][1]} AS iter_hi, {_B['expand'][1]} AS expand_hi,
       {_B['reverse'][0]} AS rev_lo, {_B['reverse'][1]} AS rev_hi, {_B['reverse_expand'][0]} AS rexp_lo,
       {_T['type'][0]} AS type_lo, {_T['type'][1]} AS type_hi,
       {_T['type_reverse'][0]} AS trev_lo, {_T['type_reverse'][1]} AS trev_hi
FROM te0 JOIN ntypes nt ON nt.split = te0.split AND nt.task_id = te0.task_id
""")
def epoch_bounds(spark, sf_dir):
    te = K.task_epochs(_store(spark, sf_dir), EPOCHS).withColumn("n_types", F.size("types").cast("long"))
    b = {m: K.epoch_bounds("epoch", "n_fail", EPOCHS, m) for m in ("iter", "expand", "reverse", "reverse_expand")}
    t = {m: K.epoch_bounds("epoch", "n_types", EPOCHS, m) for m in ("type", "type_reverse")}
    return te.select("split", "task_id", "epoch", "n_fail", "n_types",
                     b["iter"][0].alias("iter_lo"), b["iter"][1].alias("iter_hi"),
                     b["expand"][1].alias("expand_hi"), b["reverse"][0].alias("rev_lo"),
                     b["reverse"][1].alias("rev_hi"), b["reverse_expand"][0].alias("rexp_lo"),
                     t["type"][0].alias("type_lo"), t["type"][1].alias("type_hi"),
                     t["type_reverse"][0].alias("trev_lo"), t["type_reverse"][1].alias("trev_hi"))


@register("replay_weights", REPLAY_BASE + replay_ctes("iter") + """
SELECT wa.split, wa.task_id, wa.epoch, f.side_rank, f.answer_id,
       round((CASE WHEN f.side_rank >= wa.lo AND f.side_rank < wa.hi THEN 1.0 ELSE 0.0 END
              + coalesce(CAST(a.added AS DOUBLE) / a.type_count, 0.0)) / (wa.W + wa.A), 6) AS weight
FROM wa JOIN fi f ON f.split = wa.split AND f.task_id = wa.task_id
LEFT JOIN added a ON a.split = wa.split AND a.task_id = wa.task_id AND a.epoch = wa.epoch
 AND a.error_type = f.error_type
""")
def replay_weights(spark, sf_dir):
    w = K.replay_weights(_store(spark, sf_dir), REPLAY_EPOCHS, _feedback(spark, sf_dir))
    return w.select("split", "task_id", "epoch", "side_rank", "answer_id", r6("weight").alias("weight"))


@register("replay_runs", REPLAY_BASE + replay_ctes("iter") + """
SELECT split, task_id, epoch, 'rank' AS by, CAST(NULL AS VARCHAR) AS error_type, lo AS start, hi AS "end",
       round(1.0 / (W + A), 6) AS weight FROM wa
UNION ALL
SELECT a.split, a.task_id, a.epoch, 'type', a.error_type, t.type_start, t.type_start + t.type_count,
       round(CAST(a.added AS DOUBLE) / a.type_count / (wa.W + wa.A), 6)
FROM added a JOIN wa USING (split, task_id, epoch) JOIN types t USING (split, task_id, error_type)
""")
def replay_runs(spark, sf_dir):
    runs = K.replay_runs(_store(spark, sf_dir), REPLAY_EPOCHS, _feedback(spark, sf_dir))
    return runs.select("split", "task_id", "epoch", "by", "error_type", "start", "end", r6("weight").alias("weight"))
