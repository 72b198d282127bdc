"""H5: the fitted feature stage shared by every supervised model: numeric
columns scaled, label-encoded columns passed through, one vector."""
from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.schema import is_numeric


def epoch_dates(df: DataFrame) -> DataFrame:
    """Dates and timestamps as epoch seconds, so that models can use them."""
    out = []
    for f in df.schema.fields:
        date = isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
        out.append(F.unix_seconds(F.col(f.name).cast("timestamp")).alias(f.name) if date else F.col(f.name))
    return df.select(out)


def usable(df: DataFrame, target: str | None = None) -> tuple[list[str], list[str]]:
    """Columns that a model can take (numbers, booleans, texts) and the others."""
    kinds = (T.BooleanType, T.StringType)
    ok = [f.name for f in df.schema.fields if f.name == target or is_numeric(f.dataType) or isinstance(f.dataType, kinds)]
    return ok, [c for c in df.columns if c not in ok]


def population_scaler(source: str, out: str, n_rows: int, width: int) -> list:
    """Centre and divide by the population standard deviation (Spark's scaler
    uses the sample one; the factor is sqrt(n / (n - 1)))."""
    factor = (n_rows / (n_rows - 1)) ** 0.5 if n_rows > 1 else 1.0
    return [StandardScaler(inputCol=source, outputCol=f"{out}__s", withMean=True, withStd=True),
            ElementwiseProduct(inputCol=f"{out}__s", outputCol=out, scalingVec=Vectors.dense([factor] * width))]


def feature_stage(df: DataFrame, features: list[str], scale: bool = True) -> Pipeline:
    """Numeric (non-boolean) columns -> StandardScaler; booleans and other
    numeric codes pass through unscaled; strings get alphabetical codes
    (unseen values -> an extra code)."""
    num = [c for c in features if is_numeric(df.schema[c].dataType)]
    bools = [c for c in features if isinstance(df.schema[c].dataType, T.BooleanType)]
    strs = [c for c in features if isinstance(df.schema[c].dataType, T.StringType)]
    stages = []
    idx = []
    for c in strs:
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}__idx", stringOrderType="alphabetAsc",
                                    handleInvalid="keep"))
        idx.append(f"{c}__idx")
    passthrough = idx + [f"{c}__int" for c in bools]
    if num:
        stages.append(VectorAssembler(inputCols=num, outputCol="__num", handleInvalid="keep"))
        if scale:
            stages += population_scaler("__num", "__num_s", df.count(), len(num))
    parts = (["__num_s" if scale else "__num"] if num else []) + passthrough
    stages.append(VectorAssembler(inputCols=parts, outputCol="features", handleInvalid="keep"))
    return Pipeline(stages=stages)


def with_bool_ints(df: DataFrame, features: list[str]) -> DataFrame:
    bools = [c for c in features if isinstance(df.schema[c].dataType, T.BooleanType)]
    for c in bools:
        df = df.withColumn(f"{c}__int", F.col(c).cast("int"))
    return df


def fit_features(train: DataFrame, features: list[str], scale: bool = True) -> PipelineModel:
    return feature_stage(train, features, scale).fit(with_bool_ints(train, features))
