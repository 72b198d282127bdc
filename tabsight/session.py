"""Session helpers: one place that builds a local session for tests and
resolves the shared checkpoint folder a cluster names in its config."""
from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

TASK_ROWS = 500_000      # rows of one task of a large table

_LOCAL_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "16g",
}


def local_session(cores: int | str = "*", app: str = "tabsight", **conf) -> SparkSession:
    """A local session with settings sized for a single machine (tests, bench)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in {**_LOCAL_DEFAULTS, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder the session names.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is used
    as is. Only when nothing is configured on a single-process local master
    (tests) a private folder is created; any other master without a shared
    folder is an error, not a silent write to one machine's disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="tabsight-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives the
    loss of an executor, unlike a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` (about ``rows`` rows) over as many tasks as hold ``TASK_ROWS`` rows
    each, by ``keys`` where given.  Up to the session's number of shuffle
    partitions nothing is done: Spark's own numbers are enough."""
    tasks = -(-rows // TASK_ROWS)
    return df if tasks <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(tasks, *keys)


@contextmanager
def sized(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is planned inside runs in tasks of about ``TASK_ROWS`` rows: more
    shuffle partitions (adaptive execution merges those that come out small) and
    smaller file splits, where the session's own numbers give larger tasks."""
    tasks = -(-rows // TASK_ROWS)
    if tasks <= int(spark.conf.get("spark.sql.shuffle.partitions")):      # Spark's default where the session names none
        yield
        return
    held = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.files.minPartitionNum")}
    try:
        for k in held:
            spark.conf.set(k, str(tasks))
        yield
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location (never a
    machine-local temp folder on a cluster)."""
    import uuid
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tabsight-scratch/{uuid.uuid4().hex}/{name}"
