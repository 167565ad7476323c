"""Detection and projection error reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrace.operators.metrics import quantiles


def error_report(df: DataFrame, by: str, error: str, near: float, hot_rows: int | None = None) -> DataFrame:
    """AGG-27: targets, accepted, median error and the share of *all* targets within ``near``, overall
    ("all") and by sequence. Missing errors stay in the denominator."""
    both = df.select(F.explode(F.array(F.lit("all"), F.col(by))).alias(by), error)
    base = both.groupBy(by).agg(F.count(F.lit(1)).alias("targets"), F.count(error).alias("accepted"),
                                (F.count_if(F.col(error) <= near) / F.count(F.lit(1))).alias("within"))
    med = quantiles(both, [by], error, {"median": (0.5, "linear")}, hot_rows).drop("n")
    return base.join(med, by, "left")


def tolerance_report(pred: DataFrame, truth: DataFrame, keys: list[str], pred_id: str, truth_id: str, t: str, truth_t: str,
                     tolerances: dict[int, int]) -> DataFrame:
    """AGG-49: matched events, precision and recall for each named tolerance (nearest first, one to one)."""
    from fieldtrace.operators.interval import span_pairs
    from fieldtrace.operators.matching import greedy_match

    widest = max(tolerances.values())
    spans = pred.withColumn("_lo", F.col(t) - widest).withColumn("_hi", F.col(t) + widest)
    width = 2 * widest + 1
    pairs = span_pairs(truth, spans, keys, truth_t, "_lo", "_hi", width, max_length=width)
    pairs = pairs.select(*keys, pred_id, truth_id, F.abs(F.col(t) - F.col(truth_t)).alias("_gap"))
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("tolerance"), F.lit(v).alias("_tol")) for n, v in tolerances.items()]))
    pairs = pairs.select("*", named.alias("_t")).select(*keys, pred_id, truth_id, "_gap", "_t.*").filter(F.col("_gap") <= F.col("_tol"))
    matched = greedy_match(pairs, [*keys, "tolerance"], pred_id, truth_id, ["_gap"])
    m = matched.groupBy("tolerance").agg(F.count(F.lit(1)).alias("matched"))
    totals = pred.agg(F.count(F.lit(1)).alias("n_pred")).join(truth.agg(F.count(F.lit(1)).alias("n_truth")), F.lit(True))  # one row each
    names = totals.select("*", F.explode(F.array(*[F.lit(n) for n in tolerances])).alias("tolerance"))
    d = names.join(m, "tolerance", "left").fillna(0, ["matched"])
    return d.select("tolerance", "n_pred", "n_truth", "matched", F.try_divide("matched", "n_pred").alias("precision"),
                    F.try_divide("matched", "n_truth").alias("recall"))
