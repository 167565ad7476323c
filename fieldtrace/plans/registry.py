"""Registry of the queries shown on the driver tables, each next to its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy access to the parquet tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        # NTZ columns become instants below; UTC keeps their wall-clock value
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        raise AttributeError(name)

    @cached_property
    def ev(self) -> DataFrame:
        """Events with a microsecond clock, exact cents and the JSON number as columns."""
        return self.events.select(
            "event_id", "user_id", "event_type",
            micros("ts").alias("us"),
            F.round(F.col("value") * 100).cast("long").alias("cents"),
            F.get_json_object("props", "$.k").cast("long").alias("k"),
        )


def micros(col: str):
    return F.unix_micros(F.col(col).cast("timestamp"))


# The same projection for the oracle side.
EV = """ev AS (
  SELECT event_id, user_id, event_type, epoch_us(ts) AS us,
         CAST(round(value * 100) AS BIGINT) AS cents,
         CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k
  FROM events)"""

HOUR = 3_600_000_000
DAY = 24 * HOUR


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with an optional oracle."""

    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco
