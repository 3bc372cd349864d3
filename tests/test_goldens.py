"""Hand goldens on tiny literal tables."""

import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from pairforge.functions import text as T
from pairforge.operators import metrics as M
from pairforge.operators import schedule as K


@pytest.mark.parametrize("n,c,k,want", [(5, 0, 1, 0.0), (5, 5, 1, 1.0), (3, 0, 5, 1.0),
                                        (10, 5, 5, 0.9960317460317460), (10, 0, 5, 0.0),
                                        (10, 7, 2, 1 - 3 / 45),
                                        (1000, 900, 3, 1 - math.comb(100, 3) / math.comb(1000, 3)),
                                        (53, 20, 1, 20 / 53)])
def test_pass_at_k_expr(spark, n, c, k, want):
    df = spark.createDataFrame([(n, c, k)], "n long, c long, k int")
    got = df.select(M.pass_at_k_expr().alias("p")).first().p
    assert math.isclose(got, want, rel_tol=0, abs_tol=1e-12)


def test_pass_at_k_guard(spark):
    att = spark.createDataFrame([("s", "a", 3, 1), ("s", "b", 10, 5)], "split string, task_id string, n long, c long")
    guarded = {r.k for r in M.pass_at_k(att, (1, 5), guarded=True).collect()}
    unguarded = {r.k for r in M.pass_at_k(att, (1, 5), guarded=False).collect()}
    assert guarded == {1} and unguarded == {1, 5}


def test_stop_strings(spark):
    df = spark.createDataFrame([("</s>abc",), ("a</s>b",), ("x\n#y\n```z",), ("plain",)], "t string")
    got = [r.o for r in df.select(T.truncate_at_stops("t").alias("o")).collect()]
    assert got == ["</s>abc", "a", "x", "plain"]


def test_entry_point_and_def_line(spark):
    df = spark.createDataFrame([("def a(x):\n  def b\ndef cc (y)",), ("x=1",), ("  def inner():\ndef top(x):",)],
                               "t string")
    rows = df.select(T.entry_point("t").alias("e"), T.first_def_line("t").alias("d"),
                     T.rename_entry_point("t").alias("r")).collect()
    assert [r.e for r in rows] == ["cc", None, "top"]
    assert [r.d for r in rows] == ["def a(x):", None, "def inner():"]
    assert rows[2].r == "  def inner():\ndef solver(x):"
    assert rows[1].r == "x=1"


def test_strip_matches_python(spark):
    samples = [" \t a b \n", "　x ", "\x1cy\x1f", "none"]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    got = [r.o for r in df.select(T.strip_text("t").alias("o")).collect()]
    assert got == [s.strip() for s in samples]


def test_epoch_bounds_small_n(spark):
    df = spark.createDataFrame([(e, 3) for e in range(5)], "epoch long, n long")
    s, t = K.epoch_bounds("epoch", "n", 5, "iter")
    got = [(r.s, r.t) for r in df.select(s.alias("s"), t.alias("t")).orderBy("epoch").collect()]
    assert got == [(0, 1), (0, 1), (1, 2), (1, 2), (2, 3)]


# Four epochs over lists of 1, 3, 7 and 10 items: [start, end) of each epoch.
BOUNDS = {
    "iter": {1: [(0, 1), (0, 1), (0, 1), (0, 1)], 3: [(0, 1), (0, 1), (1, 2), (2, 3)],
             7: [(0, 1), (1, 3), (3, 5), (5, 7)], 10: [(0, 2), (2, 5), (5, 7), (7, 10)]},
    "expand": {1: [(0, 1), (0, 1), (0, 1), (0, 1)], 3: [(0, 1), (0, 1), (0, 2), (0, 3)],
               7: [(0, 1), (0, 3), (0, 5), (0, 7)], 10: [(0, 2), (0, 5), (0, 7), (0, 10)]},
    "reverse": {1: [(0, 1), (0, 1), (0, 1), (0, 1)], 3: [(2, 3), (2, 3), (1, 2), (0, 1)],
                7: [(6, 7), (4, 6), (2, 4), (0, 2)], 10: [(8, 10), (5, 8), (3, 5), (0, 3)]},
    "reverse_expand": {1: [(0, 1), (0, 1), (0, 1), (0, 1)], 3: [(2, 3), (1, 3), (0, 3), (0, 3)],
                       7: [(5, 7), (3, 7), (1, 7), (0, 7)], 10: [(7, 10), (5, 10), (2, 10), (0, 10)]},
    "type_reverse": {1: [(0, 1), (0, 1), (0, 1), (0, 1)], 3: [(2, 3), (1, 2), (0, 1), (0, 1)],
                     7: [(5, 7), (3, 5), (1, 3), (0, 1)], 10: [(7, 10), (5, 7), (2, 5), (0, 2)]},
}


@pytest.mark.parametrize("mode", sorted(BOUNDS))
def test_epoch_bounds_table(spark, mode):
    df = spark.createDataFrame([(e, n) for n in BOUNDS[mode] for e in range(4)], "epoch long, n long")
    s, t = K.epoch_bounds("epoch", "n", 4, mode)
    got = {(r.n, r.epoch): (r.s, r.t) for r in df.select("epoch", "n", s.alias("s"), t.alias("t")).collect()}
    assert got == {(n, e): b for n, bounds in BOUNDS[mode].items() for e, b in enumerate(bounds)}


def test_feedback_stays_in_force_and_is_cleared(spark):
    # Validations after epochs 0, 3 and 5; the one after epoch 3 has no failure.
    rows = [(10, "A", 4), (10, "", 9), (13, "", 8), (15, "B", 2), (15, "A", 6)]
    m = spark.createDataFrame(rows, "step long, error_type string, n long")
    got = {}
    for r in K.validation_counts_by_epoch(m, 9).collect():
        got.setdefault(r.epoch, set()).add((r.error_type, r.cnt, r.total, r.least_cnt))
    held, late = {("A", 4, 4, 1)}, {("A", 6, 8, 3), ("B", 2, 8, 1)}
    assert got == {1: held, 2: held, 3: held, 6: late, 7: late, 8: late}
    assert K.validation_counts_by_epoch(m.limit(0), 9).count() == 0


def test_token_truncation(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5], [7, 8, 9], [6]), ([1, 2], [7, 8, 9, 10, 11], [])],
                               "p array<long>, c array<long>, r array<long>")
    p, c, r = T.truncate_pair_tokens("p", "c", "r", max_len=4, eos_id=0)
    rows = df.select(p.alias("p"), c.alias("c"), r.alias("r")).collect()
    assert rows[0].p == [2, 3, 4, 5] and rows[0].c == [7, 8] and rows[0].r == [6, 0]
    assert rows[1].p == [1, 2] and rows[1].c == [7, 8] and rows[1].r == [0]


def test_replay_added_golden(spark):
    # Validation counts {A: 4, B: 1}; a task whose failures are all of type B;
    # window of 10 -> added_B = max(ceil(1/1), floor(10 * 1/5)) = 2; A is absent.
    fails = [Row(split="train", task_id="t", prompt="p", answer=f"b{i}", answer_id=i, error_type="B",
                 error_frequency=0.5, answer_length=100, rank=2 + i, side_rank=i, is_pass=False,
                 n_pass=2, n_fail=12) for i in range(12)]
    passes = [Row(split="train", task_id="t", prompt="p", answer=f"p{i}", answer_id=100 + i, error_type="",
                  error_frequency=0.0, answer_length=5, rank=i, side_rank=i, is_pass=True,
                  n_pass=2, n_fail=12) for i in range(2)]
    ranked = spark.createDataFrame(passes + fails)
    te = spark.createDataFrame([("train", "t", 0, 10)], "split string, task_id string, epoch long, W long")
    val = spark.createDataFrame([(0, "A", 4), (0, "B", 1)], "epoch long, error_type string, cnt long")
    val = (val.withColumn("total", F.lit(5).cast("long")).withColumn("least", F.lit(1).cast("long"))
              .withColumn("least_cnt", F.ceil(F.col("cnt") / F.col("least")).cast("long")))
    got = K.replay_added(te, ranked, val).collect()
    assert [(r.error_type, r.added) for r in got] == [("B", 2)]


def test_exact_bounds_partition_when_n_ge_epochs(spark):
    # The double formula can miss the last item (e.g. E=49, n=54); exact cannot.
    E, n = 49, 54
    df = spark.createDataFrame([(e, n) for e in range(E)], "epoch long, n long")
    s, t = K.epoch_bounds("epoch", "n", E, "iter", exact=True)
    covered = set()
    for r in df.select(s.alias("s"), t.alias("t")).collect():
        covered |= set(range(r.s, r.t))
    assert covered == set(range(n))


def test_stdio_verdict_arrays(spark):
    from pairforge.operators.runs import stdio_verdict_arrays
    rows = [(["a", "b"], ["a", "b"]), (["a"], ["a", "b"]), (["a", "x"], ["a", "b"]), ([], []), ([None], [None])]
    got = stdio_verdict_arrays(spark.createDataFrame(rows, "got array<string>, want array<string>")).collect()
    assert [(r.output, r.error_type) for r in got] == [
        ("passed", ""), ("failed", "AssertionError"), ("failed", "AssertionError"), ("passed", ""), ("passed", "")]


def test_constant_columns(spark):
    from pairforge.operators.pairs import constant_columns
    df = constant_columns(spark.createDataFrame([(1,)], "x int"))
    assert df.first().asDict() == {"x": 1, "prompt": "", "chosen": "", "rejected": ""}


def test_tokenize_udf_feeds_truncation(spark):
    from pairforge.operators.tokens import tokenize_udf
    codepoints = tokenize_udf(lambda s: [ord(ch) for ch in s])
    df = spark.createDataFrame([("abcdef", "xy", "z")], "p string, c string, r string")
    p, c, r = T.truncate_pair_tokens(codepoints("p"), codepoints("c"), codepoints("r"), max_len=4, eos_id=0)
    row = df.select(p.alias("p"), c.alias("c"), r.alias("r")).first()
    assert row.p == [ord(x) for x in "cdef"] and row.c == [ord("x"), ord("y")] and row.r == [ord("z"), 0]


def test_sampling_plan_eval_ks(spark):
    from pairforge.operators.runs import sampling_plan
    p = spark.createDataFrame([("1", "  solve it \n")], "task_id string, prompt string")
    plan = sampling_plan(p, n_iter=2, eval_ks=(1, 5, 10))
    assert plan.count() == 20
    assert plan.first().request == T.SYSTEM_PROMPT.format("solve it")
