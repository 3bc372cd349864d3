"""Pluggable tokenizer as an Arrow-batched pandas UDF.

``tokenize_udf(fn)`` wraps any Python tokenizer ``str -> list[int]``
(a BPE library, a vocabulary lookup, ...) into a column function whose
output feeds ``functions.text.truncate_pair_tokens``. The JVM-side
default is the learnt vocabulary of ``operators.vocabulary``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tokenize_udf(fn):
    """Column function: text -> array<long> via ``fn`` (NULL text -> NULL)."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def tok(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else [int(i) for i in fn(x)])

    def apply(col):
        from pyspark.sql import SparkSession
        from pairforge.session import ship_package
        spark = SparkSession.getActiveSession()
        if spark is not None:
            ship_package(spark)
        return tok(F.col(col) if isinstance(col, str) else col)

    return apply

