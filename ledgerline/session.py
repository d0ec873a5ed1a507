"""Session set-up, the shared scratch folder, and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DIR_SETTING = "spark.checkpoint.dir"


def local_session(cpus: str = "8", app: str = "ledgerline") -> SparkSession:
    """Session for tests and the local bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def _configured_dir(spark: SparkSession) -> str | None:
    found = spark.conf.get(_DIR_SETTING, None)
    return found or spark.sparkContext.getConf().get(_DIR_SETTING, None)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    Comes from ``spark.checkpoint.dir``. Only a local master may fall back to a
    temporary folder, because there driver and executors share the disk.
    """
    found = _configured_dir(spark)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_DIR_SETTING} to a folder all executors share")
    made = tempfile.mkdtemp(prefix="ledgerline-")
    spark.conf.set(_DIR_SETTING, made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a written intermediate."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Replace a long plan by its rows, written below the shared folder, so that readers take only the columns they need."""
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
