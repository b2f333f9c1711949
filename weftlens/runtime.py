"""Session set-up, table reading and the cluster plumbing that operators share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Sequence
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent


def build_session(app: str = "weftlens", cpus: int | str = 8, partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own session and settings."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("WEFTLENS_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory, all columns; Catalyst prunes what a plan doesn't use."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_weftlens_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="weftlens-ship-")  # only the driver reads it; executors fetch the file from the driver
    archive = os.path.join(folder, "weftlens_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(_PACKAGE.rglob("*.py")):
            out.write(path, f"weftlens/{path.relative_to(_PACKAGE)}")
    context.addPyFile(archive)
    context._weftlens_shipped = True


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join in which null keys meet null keys; the result has the left's keys once."""
    renamed = right.withColumnsRenamed({k: f"{k}__r" for k in keys})
    condition = reduce(lambda a, b: a & b, (left[k].eqNullSafe(renamed[f"{k}__r"]) for k in keys))
    return left.join(renamed, condition, how).drop(*(f"{k}__r" for k in keys))


def spread(df: DataFrame) -> DataFrame:
    """Rows for per-row Python work on all cores: an input of fewer partitions than there are cores (a small file, say) is
    dealt out; a large input, which has more of them, is left where it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``. Where none is set, a local session (tests) takes a folder of its
    machine; on a cluster that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="weftlens-checkpoint-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the shared checkpoint folder; later reads survive the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
