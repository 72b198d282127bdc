"""Result and model sinks."""
from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None,
                fmt: str = "parquet") -> None:
    """A5: write a result table (metrics, report, chart data)."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_json_documents(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A5: one JSON document per row (the response payload form)."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode(mode).text(path)


def save_model(model: PipelineModel, path: str) -> None:
    """Persist a fitted model (the reference kept it in process memory)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
