"""Table schemas of the preference-data model.

Read paths always pass an explicit schema: inferred JSON types are
unstable (numeric-looking ids turn into numbers, ``*_time`` columns into
timestamps), so ids stay strings and times stay doubles.
"""

from pyspark.sql import types as T

S, L, D, I = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType()


def _f(name, dtype, nullable=True):
    return T.StructField(name, dtype, nullable)


# Problems: MBPP-shaped (task_id, prompt, test, entry_point) plus the
# optional HumanEval-only columns and the stdio test form.
STDIO_CASE = T.StructType([_f("input", S), _f("output", S)])
PROBLEMS = T.StructType([
    _f("task_id", S), _f("prompt", S), _f("test", S), _f("entry_point", S),
    _f("canonical_solution", S), _f("text", S), _f("declaration", S),
    _f("example_test", S), _f("stop_tokens", T.ArrayType(S)),
    _f("stdio", T.ArrayType(STDIO_CASE)),
])

# Samples: order is meaningful, so the position is an explicit column.
SAMPLES = T.StructType([_f("task_id", S), _f("answer", S), _f("pos", L)])

# Verdict rows, one per (check, sample).
RUNS = T.StructType([
    _f("task_id", S), _f("answer_id", L), _f("prompt", S), _f("answer", S),
    _f("output", S), _f("avg_time", D), _f("std_time", D), _f("error_type", S),
    _f("answer_length", L), _f("error_trace", S),
])

ANSWER = T.StructType([
    _f("text", S), _f("error_frequency", D), _f("error_type", S), _f("answer_length", L),
])
TIME_STATS = T.StructType([_f("count", L), _f("avg", D), _f("std", D), _f("cov", D)])
# Sink form of the ranked table: one row per answer, in the order of ``rank``.
MERGED = T.StructType([
    _f("id", S), _f("problem", S), _f("rank", L), _f("answer", ANSWER), _f("time", TIME_STATS),
])

PAIRS = T.StructType([
    _f("id", S), _f("problem", S), _f("prompt", S), _f("chosen", S), _f("rejected", S),
])

METRICS_LONG = T.StructType([_f("split", S), _f("metric", S), _f("value", D)])
