"""L4: stream scoring.  The fitted transforms are applied to a streaming
DataFrame; the code tables join as stream-static joins, nothing is stateful,
so no watermark is needed."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.analyze import Analysis, score


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files: int | None = None,
                glob: str | None = None) -> DataFrame:
    """A file stream over a folder (optionally only files matching ``glob``)."""
    r = spark.readStream.format(fmt).schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    if fmt == "csv":
        r = r.option("header", True)
    return r.load(path)


def score_stream(analysis: Analysis, stream: DataFrame) -> DataFrame:
    return score(analysis, stream)


def run_to_table(scored: DataFrame, sink_path: str, checkpoint: str, available_now: bool = True):
    """Write scored rows as parquet with a checkpoint (exactly-once file sink);
    ``availableNow`` processes what is there and stops."""
    w = scored.writeStream.format("parquet").option("path", sink_path).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
