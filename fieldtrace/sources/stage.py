"""Stages: parquet folders that count only when complete; resume, caches and registries."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldtrace.session import ensure_checkpoint_dir

ROWS_PER_PART = 50_000


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def scratch(spark: SparkSession) -> str:
    """A new folder next to the checkpoints, which every executor can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stage-{uuid.uuid4().hex}"


def stage_complete(spark: SparkSession, path: str) -> bool:
    """SRC-01 / SRC-03: Spark writes ``_SUCCESS`` last."""
    return _exists(spark, f"{path}/_SUCCESS")


def write_stage(df: DataFrame, path: str, schema: StructType | None = None, by: list[str] | None = None) -> None:
    """SRC-02: typed, zstd, bounded rows per file; replaces only the partitions it writes."""
    if schema is not None:
        df = df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
    w = df.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", ROWS_PER_PART)
    if by:
        w = w.partitionBy(*by).option("partitionOverwriteMode", "dynamic")
    w.parquet(path)


def read_stage(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """SRC-01: refuses an incomplete stage; an empty one is a valid table without rows."""
    if not stage_complete(spark, path):
        raise FileNotFoundError(f"stage is not complete: {path}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def ensure_stage(spark: SparkSession, path: str, build, schema: StructType | None = None) -> DataFrame:
    """SRC-03: compute the stage only if it is not there yet."""
    if not stage_complete(spark, path):
        write_stage(build(), path, schema)
    return read_stage(spark, path)


def pending(inputs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """SRC-05: inputs without an output."""
    return inputs.join(done.select(*keys).distinct(), keys, "left_anti")


def discover_games(spark: SparkSession, root: str) -> DataFrame:
    """SRC-04: game keys of a partitioned token stage, by partition discovery."""
    return spark.read.parquet(root).select("game_key").distinct()


def content_key(*parts: Column) -> Column:
    """SRC-20: sha256 of the parts with a NUL between them."""
    return F.sha2(F.concat_ws("\0", *[p.cast("string") for p in parts]), 256)


def cache_latest(cache: DataFrame, key: str, seq: str) -> DataFrame:
    """SRC-20: last write per key of an append-only cache."""
    cols = [c for c in cache.columns if c != key]
    return cache.groupBy(key).agg(F.max_by(F.struct(*cols), seq).alias("_v")).select(key, *[F.col(f"_v.{c}").alias(c) for c in cols])


def cache_misses(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """SRC-20: rows whose key the cache has never seen."""
    return wanted.join(cache.select(key).distinct(), key, "left_anti")


def verify_registry(files: DataFrame, registry: DataFrame) -> DataFrame:
    """SRC-21: registered (path, sha256) against (path, content): ok, changed, missing, or unregistered."""
    have = files.select("path", F.sha2("content", 256).alias("_actual"))
    d = registry.select("path", F.col("sha256").alias("_wanted")).join(have, "path", "full_outer")
    status = (F.when(F.col("_wanted").isNull(), "unregistered").when(F.col("_actual").isNull(), "missing")
              .when(F.col("_wanted") == F.col("_actual"), "ok").otherwise("changed"))
    return d.select("path", status.alias("status"))


def local_scratch() -> str:
    """A scratch folder for tests on one machine."""
    return tempfile.mkdtemp(prefix="spark-")
