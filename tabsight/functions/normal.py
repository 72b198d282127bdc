"""The one Python function in the engine: the inverse normal CDF for Q-Q
points.  Spark has no built-in; this is an Arrow-batched pandas UDF."""
from __future__ import annotations

from statistics import NormalDist

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STD = NormalDist()


@F.pandas_udf(T.DoubleType())
def inv_norm(p: pd.Series) -> pd.Series:
    return p.map(lambda v: None if v is None or not (0.0 < v < 1.0) else _STD.inv_cdf(float(v)))
