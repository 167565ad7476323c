"""AGG-25: likelihood and coverage of position forecasts, conformal radii from a calibration split.

The factor and the radii are order statistics of the calibration rows, one small table that is joined to the test rows; the
test rows never decide them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrace.operators.metrics import quantiles


def miss(tx: str = "tx", ty: str = "ty", mx: str = "mx", my: str = "my") -> Column:
    """Distance between a target and its forecast."""
    dx, dy = F.col(tx) - F.col(mx), F.col(ty) - F.col(my)
    return F.sqrt(dx * dx + dy * dy)


def conformal_factor(calibration: DataFrame, keys: list[str], share: float = 0.9, hot_rows: int | None = None) -> DataFrame:
    """(keys, factor): the ``share`` quantile, taken upwards, of the miss in units of the forecast's own scale."""
    d = calibration.withColumn("_z", miss() / F.col("scale"))
    return quantiles(d, keys, "_z", {"factor": (share, "higher")}, hot_rows).drop("n")


def gaussian_report(calibration: DataFrame, test: DataFrame, keys: list[str], window: list[str], step: str, share: float = 0.9, hot_rows: int | None = None) -> DataFrame:
    """AGG-25: mean negative log-likelihood of a round Gaussian per point, share of points inside its own and inside the
    calibrated radius, and the latter at the last step of each window.

    Both tables: keys, window, step, tx, ty, mx, my, scale. Without calibration rows for a key the calibrated values are null.
    """
    e = miss()
    var = F.col("scale") * F.col("scale")
    point = (e * e) / (2 * var) + 2 * F.log("scale") + math.log(2 * math.pi)
    d = test.join(conformal_factor(calibration, keys, share, hot_rows), keys, "left")
    own = e <= F.col("scale") * math.sqrt(-2 * math.log(1 - share))
    radius = F.col("factor") * F.col("scale")
    d = d.select(*keys, *window, step, "factor", point.alias("_l"), own.cast("int").alias("_own"), (e <= radius).cast("int").alias("_in"), radius.alias("_r"))
    per = d.groupBy(*keys, *window).agg(F.count("*").alias("_n"), F.sum("_l").alias("_l"), F.sum("_own").alias("_own"), F.sum("_in").alias("_in"), F.max_by(F.struct("_in", "_r"), step).alias("_end"), F.max("factor").alias("factor"))
    n = F.sum("_n")
    return per.groupBy(*keys).agg(F.count("*").alias("windows"), n.alias("points"), F.max("factor").alias("factor"), F.round(F.sum("_l") / n, 9).alias("mean_nll"), (F.sum("_own") / n).alias("own_coverage"),
                                  (F.sum("_in") / n).alias("coverage"), F.avg("_end._in").alias("end_coverage"), F.round(F.avg("_end._r"), 9).alias("mean_end_radius"))


def age_bucket(age: Column, most: int) -> Column:
    """Whole seconds since the last sighting, upwards, from 1 to ``most``; a hair beyond a second belongs to it."""
    return F.least(F.greatest(F.ceil(age - 1e-6), F.lit(1)), F.lit(most)).cast("int")


def age_radii(calibration: DataFrame, keys: list[str], age: str, error: str, most: int = 3, share: float = 0.9, hot_rows: int | None = None) -> DataFrame:
    """AGG-25: (keys, bucket, radius): the ``share`` quantile, taken upwards, of the errors in each bucket of age.

    A row at the upper end of a bucket counts there, one at the lower end does not, so a hair above a whole second is in
    two buckets."""
    cell = F.explode(F.array(*[F.when((F.col(age) > b - 1) & (F.col(age) <= b + 1e-6), b) for b in range(1, most + 1)])).alias("bucket")
    d = calibration.select(*keys, error, cell).filter("bucket IS NOT NULL")
    return quantiles(d, [*keys, "bucket"], error, {"radius": (share, "higher")}, hot_rows).drop("n")


def with_radii(rows: DataFrame, radii: DataFrame, keys: list[str], age: str, most: int = 3, estimated: Column | None = None) -> DataFrame:
    """AGG-25: rows with the radius of their age; null where ``estimated`` does not hold."""
    d = rows.withColumn("bucket", age_bucket(F.col(age), most)).join(radii, [*keys, "bucket"], "left").drop("bucket")
    return d if estimated is None else d.withColumn("radius", F.when(estimated, F.col("radius")))
