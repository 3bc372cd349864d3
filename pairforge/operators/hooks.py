"""User formatting hook: a Python function row -> list[str], type-checked.

Runs as an Arrow-batched pandas UDF (one call per row inside the batch);
the returned lists are exploded into rows by the caller if wanted.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def formatting_hook(df: DataFrame, fn, input_cols: list[str], output_col: str = "texts") -> DataFrame:
    """Add ``output_col`` = fn(row as dict) for every row; fn must return a list of str."""
    from pairforge.session import ship_package
    ship_package(df.sparkSession)
    names = list(input_cols)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def apply(*cols: pd.Series) -> pd.Series:
        out = []
        for vals in zip(*cols):
            res = fn(dict(zip(names, vals)))
            if not isinstance(res, list) or not all(isinstance(x, str) for x in res):
                raise TypeError("formatting function must return a list of str")
            out.append(res)
        return pd.Series(out)

    return df.withColumn(output_col, apply(*[F.col(c) for c in names]))
