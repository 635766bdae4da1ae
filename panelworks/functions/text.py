"""Functions on text that SQL does not have."""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two strings; null if either is. Use it on blocked candidates only."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def similarity_bound(a: Column, b: Column) -> Column:
    """What ``similarity`` can be at most: twice the letters that both have, over all letters. Needs no Python."""
    count = lambda s, c: F.length(s) - F.length(F.replace(s, c, F.lit("")))
    common = F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.least(count(a, c), count(b, c))))
    total = F.length(a) + F.length(b)
    return F.when(total > 0, 2 * common / total).otherwise(1.0)
