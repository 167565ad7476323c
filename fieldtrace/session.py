"""Session helpers: a local session for tests and benchmarks, and checkpoint handling."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """Local session used by tests and ``bench.py``; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("fieldtrace")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("FIELDTRACE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers once per session, wherever the driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_fieldtrace_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="spark-")  # on the driver; Spark's file server hands it to the executors
    path = os.path.join(folder, "fieldtrace.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    z.write(full, os.path.join("fieldtrace", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._fieldtrace_shipped = True


def shipped(f):
    """The query ``f``, with the package on the workers before it runs."""

    @functools.wraps(f)
    def run(spark, sf_dir):
        ship(spark)
        return f(spark, sf_dir)

    return run


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; only an unset local session gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in reliable storage so that iteration does not grow the plan."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def plan_bytes(df: DataFrame) -> int | None:
    """Bytes of all inputs of ``df`` by Catalyst's statistics, or None where the session hides them.

    The inputs, not the estimated output: an equi join's estimate is the product of its sides.
    """
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    except AttributeError:
        return None


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash partitioning on ``keys`` that adaptive coalescing leaves alone: grouped Python work is bound by
    CPU, not by bytes, so it should keep all its tasks."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)
