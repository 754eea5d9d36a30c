"""Session settings, code shipping and shared scratch space."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pricetide")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that functions run there by name."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    path = os.path.join(tempfile.mkdtemp(prefix="pricetide-"), "pricetide.zip")
    Path(path).write_bytes(data.getvalue())
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only where none is named (local runs)."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="pricetide-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are written to the shared checkpoint folder and read from there."""
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=True)


def wide(spark: SparkSession) -> int:
    """Partitions that keep all cores busy."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(df: DataFrame) -> DataFrame:
    """The rows over all cores, for work that a small file's one task would do alone."""
    return df.repartition(wide(df.sparkSession))


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back."""
    path = stash_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def stash_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{scratch_root(spark).rstrip('/')}/pricetide-{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table that ``stash_path`` named; nothing may read it any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
