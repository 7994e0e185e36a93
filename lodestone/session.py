"""Sessions for local use, and how lineage is cut."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session: UTC, adaptive execution, few shuffle partitions."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_top(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a local session gets a temporary folder, removed when Python ends; a cluster gets an error,
    since a folder of the driver's machine would give its executors missing files.
    """
    context = spark.sparkContext
    if named := context.getConf().get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if (own := getattr(shared_top, "own", None)) is None:
        own = shared_top.own = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the folder that the cluster names."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_top(df.sparkSession))
    return df.checkpoint()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_top(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def passing_path(spark: SparkSession, name: str) -> str:
    """A new shared path whose files go when Python ends."""
    path = shared_path(spark, name)
    atexit.register(_removed, spark, path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder on whatever file system the path names; none is no error."""
    jvm, context = spark.sparkContext._jvm, spark.sparkContext._jsc
    where = jvm.org.apache.hadoop.fs.Path(path)
    # A stopped session has no settings any more, but its JVM can still delete.
    conf = jvm.org.apache.hadoop.conf.Configuration() if context is None else context.hadoopConfiguration()
    where.getFileSystem(conf).delete(where, True)


def _removed(spark: SparkSession, path: str) -> None:
    # What fails here, such as a JVM that has ended, must not turn a finished program into a failed one.
    with contextlib.suppress(Exception):
        remove_path(spark, path)


def importable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package from where the driver has it, whatever their folder.

    On a cluster the package is shipped with --py-files; then this changes nothing.
    """
    import os
    from pathlib import Path

    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parent.parent)
    had = env.get("PYTHONPATH") or os.environ.get("PYTHONPATH") or ""
    if root not in had.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, had) if x)
