"""Calibration, ranking, classification and displacement metrics as decomposable aggregates.

Sums of doubles go through decimals so that a result does not depend on the order of the rows.
Order statistics and curves work on counts per distinct value, cut into score slices, so neither
needs one task to sort everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fieldtrace.operators.ordered import HOT_ROWS, SMALL_BYTES, remaining_sum, running_sum, scan
from fieldtrace.session import plan_bytes

TASK_BYTES = 8 * 1024 * 1024  # bytes of the input's files whose rows one task sorts
SLICES = 1024  # score slices of a curve; the slice totals are this many rows


def exact_sum(c: Column, scale: int = 9) -> Column:
    """Order-independent sum of doubles, rounded at ``scale`` decimals per row."""
    return F.sum(c.cast(T.DecimalType(28, scale))).cast("double")


def exact_mean(c: Column, scale: int = 9) -> Column:
    return exact_sum(c, scale) / F.count(c)


def quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, tuple[float, str]],
              hot_rows: int | None = None) -> DataFrame:
    """AGG-15 / AGG-25 / AGG-35: exact order statistics per key: ``wanted`` maps an output name to (q, method) with method
    ``linear``, ``higher`` (index ceil(q(n-1))) or ``nearest_rank`` (index ceil(qn)-1)."""
    key = keys or ["_all"]
    known = df.filter(F.col(value).isNotNull()).select(*keys, value)
    if not keys:
        known = known.withColumn("_all", F.lit(0))
    size = plan_bytes(known)
    if hot_rows is None and size is not None and size <= SMALL_BYTES:
        # one sort per key; grouping equal values first only pays when a key is large
        by = Window.partitionBy(*key)
        d = known.select("*", F.row_number().over(by.orderBy(value)).alias("_c"), F.count(F.lit(1)).over(by).alias("_t"))
    else:
        d = _ranked_counts(known, key, value, hot_rows)
    aggs = [F.max("_t").alias("n")]
    for name, (q, method) in wanted.items():
        pos = F.lit(float(q)) * (F.col("_t") - 1)
        if method == "linear":
            aggs += [F.min(F.when(F.col("_c") > F.floor(pos), F.col(value))).alias(f"_lo_{name}"),
                     F.min(F.when(F.col("_c") > F.ceil(pos), F.col(value))).alias(f"_hi_{name}")]
        else:
            i = F.ceil(pos) if method == "higher" else F.ceil(F.lit(float(q)) * F.col("_t")) - 1
            aggs.append(F.min(F.when(F.col("_c") > i, F.col(value))).alias(name))
    out = d.groupBy(*key).agg(*aggs)
    cols = []
    for name, (q, method) in wanted.items():
        if method == "linear":
            pos = F.lit(float(q)) * (F.col("n") - 1)
            lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
            cols.append((lo + (hi - lo) * (pos - F.floor(pos))).cast("double").alias(name))
        else:
            cols.append(F.col(name))
    return out.select(*keys, "n", *cols)


def _ranked_counts(known: DataFrame, key: list[str], value: str, hot_rows: int | None) -> DataFrame:
    counts = known.groupBy(*key, value).agg(F.count(F.lit(1)).alias("_n"))
    d = scan(counts, key, [value], {"_c": running_sum(F.col("_n")), "_rest": remaining_sum(F.col("_n"))}, hot_rows)
    return d.withColumn("_t", F.col("_c") + F.col("_rest") - F.col("_n"))


def score_curve(df: DataFrame, keys: list[str], score: str, positive: Column, descending: bool = True) -> DataFrame:
    """Per distinct score: row and positive counts, and both accumulated from the best score on.

    ``score`` must lie in [0, 1]. Output columns: n, pos, cum_n, cum_pos (inclusive).
    """
    counts = df.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("n"), F.sum(positive.cast("long")).alias("pos"))
    # the best score sorts first
    counts = counts.withColumn("_o", -F.col(score) if descending else F.col(score))
    counts = counts.withColumn("_sl", F.floor(F.col("_o") * SLICES))
    w = Window.partitionBy(*keys, "_sl").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    local = counts.select("*", F.sum("n").over(w).alias("_ln"), F.sum("pos").over(w).alias("_lp"))
    sums = counts.groupBy(*keys, "_sl").agg(F.sum("n").alias("_sn"), F.sum("pos").alias("_sp"))
    sw = Window.partitionBy(*keys).orderBy("_sl").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*keys, "_sl", F.coalesce(F.sum("_sn").over(sw), F.lit(0)).alias("_bn"),
                       F.coalesce(F.sum("_sp").over(sw), F.lit(0)).alias("_bp"))
    return local.join(base, [*keys, "_sl"]).select(
        *keys, score, "n", "pos", (F.col("_ln") + F.col("_bn")).alias("cum_n"), (F.col("_lp") + F.col("_bp")).alias("cum_pos"))


def precision_at_coverage(df: DataFrame, keys: list[str], score: str, correct: Column, hot_rows: int | None = None) -> DataFrame:
    """AGG-16: precision and coverage when answering at each distinct threshold or above."""
    curve = score_curve(df, keys, score, correct)
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_t")) if keys else df.agg(F.count(F.lit(1)).alias("_t"))
    d = curve.join(total, keys) if keys else curve.join(F.broadcast(total), F.lit(True))  # one-row total
    return d.select(*keys, F.col(score).alias("threshold"), F.col("cum_n").alias("answered"),
                    (F.col("cum_n") / F.col("_t")).alias("coverage"), (F.col("cum_pos") / F.col("cum_n")).alias("precision"))


def reliability_bins(df: DataFrame, keys: list[str], score: str, correct: Column, bins: int = 10) -> DataFrame:
    """AGG-16: equal-width bins, 1.0 in the last one, empty bins absent."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.withColumn("bin", b).groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"), exact_mean(F.col(score)).alias("mean_score"),
        (F.sum(correct.cast("long")) / F.count(F.lit(1))).alias("accuracy"))


def calibration_summary(df: DataFrame, keys: list[str], score: str, correct: Column, bins: int = 10) -> DataFrame:
    """AGG-16: expected calibration error and Brier score."""
    y = correct.cast("double")
    bin_ = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    err = (F.col(score) - y) * (F.col(score) - y)
    per = df.withColumn("_bin", bin_).groupBy(*keys, "_bin").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col(score).cast(T.DecimalType(28, 9))).alias("_s"),
        F.sum(correct.cast("long")).alias("_p"), F.sum(err.cast(T.DecimalType(28, 9))).alias("_b"))
    gap = F.abs(F.col("_s") - F.col("_p"))
    return per.groupBy(*keys).agg(
        F.sum("_n").alias("n"), (F.sum(gap).cast("double") / F.sum("_n")).alias("ece"),
        (F.sum("_b").cast("double") / F.sum("_n")).alias("brier"))


def isotonic(df: DataFrame, keys: list[str], score: str, target: str) -> DataFrame:
    """AGG-17: exact pool-adjacent-violators steps (score_to, value, n).

    Pooling does not depend on its order, so slices are pooled first and their few blocks after.
    """
    counts = df.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("n"), F.sum(target).cast("double").alias("s"))
    counts = counts.withColumn("_sl", F.floor(F.col(score) * SLICES)).withColumnRenamed(score, "score_to")
    schema = T.StructType([f for f in counts.schema.fields if f.name in keys] + [
        T.StructField("_sl", T.LongType()), T.StructField("score_to", T.DoubleType()),
        T.StructField("n", T.LongType()), T.StructField("s", T.DoubleType())])

    def pool(pdf):
        from fieldtrace.operators.kernels import pav
        return pav(pdf.sort_values("score_to"), list(schema.names))

    first = counts.groupBy(*keys, "_sl").applyInPandas(pool, schema)
    coarse = first.withColumn("_sl", F.lit(0).cast("long"))
    return coarse.groupBy(*keys, "_sl").applyInPandas(pool, schema).select(
        *keys, "score_to", (F.col("s") / F.col("n")).alias("value"), "n")


def apply_steps(df: DataFrame, steps: DataFrame, keys: list[str], score: str, hot_rows: int | None = None) -> DataFrame:
    """AGG-17: value of the first step whose end is at or above the score; above the last, the last."""
    from fieldtrace.operators.asof import asof_join

    k = keys or ["_all"]
    left = df if keys else df.withColumn("_all", F.lit(0))
    right = steps if keys else steps.withColumn("_all", F.lit(0))
    d = asof_join(left, right, k, score, "score_to", {"_v": "value"}, "forward", hot_rows=hot_rows)
    top = right.groupBy(*k).agg(F.max_by("value", "score_to").alias("_top"))
    d = d.join(top, k).withColumn("calibrated", F.coalesce("_v", "_top"))
    return d.drop("_v", "_top", *([] if keys else ["_all"]))


def probability_metrics(df: DataFrame, keys: list[str], score: str, positive: Column, eps: float = 1e-6) -> DataFrame:
    """AGG-23: Brier, log loss (clipped), mid-rank AUC, average precision, prevalence and skill (null where a group has one class)."""
    y = positive.cast("double")
    p = F.least(F.greatest(F.col(score), F.lit(eps)), F.lit(1.0 - eps))
    base = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(positive.cast("long")).alias("positives"),
        exact_mean((F.col(score) - y) * (F.col(score) - y)).alias("brier"),
        exact_mean(F.when(positive, -F.log(p)).otherwise(-F.log(F.lit(1.0) - p))).alias("log_loss"))
    c = score_curve(df, keys, score, positive)
    # a positive beats every negative after its score and half of the negatives at it
    neg, cum_neg = F.col("n") - F.col("pos"), F.col("cum_n") - F.col("cum_pos")
    parts = c.groupBy(*keys).agg(
        F.sum(F.col("pos") * (F.lit(2) * cum_neg - neg)).alias("_u2"),
        exact_sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")).alias("_ap"))
    d = base.join(parts, keys) if keys else base.join(F.broadcast(parts), F.lit(True))  # one row each
    np_, nn = F.col("positives"), F.col("n") - F.col("positives")
    prev = np_ / F.col("n")
    return d.select(
        *keys, "n", "positives", "brier", "log_loss",
        (F.lit(1.0) - F.try_divide(F.col("_u2"), F.lit(2.0) * np_ * nn)).alias("auc"), F.try_divide(F.col("_ap"), np_).alias("average_precision"),
        prev.alias("prevalence"), (F.lit(1.0) - F.try_divide(F.col("brier"), prev * (F.lit(1.0) - prev))).alias("skill"))


def ranking_metrics(df: DataFrame, query: list[str], score: str, tie: list[str], chosen: Column) -> DataFrame:
    """AGG-22: top-1, top-3 and mean reciprocal rank of the chosen option (ties keep option order).

    The rank is the number of options of the query that sort before the chosen one.
    """
    w = Window.partitionBy(*query).orderBy(F.col(score).desc(), *tie)
    r = df.withColumn("_r", F.row_number().over(w)).filter(chosen)
    return r.agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("_r") == 1) / F.count(F.lit(1))).alias("top1"),
                 (F.count_if(F.col("_r") <= 3) / F.count(F.lit(1))).alias("top3"),
                 exact_mean(F.lit(1.0) / F.col("_r")).alias("mrr"))


def confusion(df: DataFrame, keys: list[str], truth: str, pred: str) -> DataFrame:
    """AGG-26: confusion counts in long form."""
    return df.groupBy(*keys, truth, pred).agg(F.count(F.lit(1)).alias("n"))


def multiclass_report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """AGG-26: accuracy, macro F1 over the classes seen, and the majority baseline."""
    c = confusion(df, [], truth, pred).withColumnsRenamed({truth: "_t", pred: "_p"})
    # two rows per confusion cell, one for each side of it
    sides = c.select(F.explode(F.array(
        F.struct(F.col("_t").alias("c"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), F.when(F.col("_t") == F.col("_p"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("_p").alias("c"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.lit(0).cast("long").alias("tp")))).alias("s")).select("s.*")
    per = sides.groupBy("c").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("tp").alias("tp"))
    return per.agg(
        F.sum("t").alias("n"), (F.sum("tp") / F.sum("t")).alias("accuracy"),
        exact_mean(F.lit(2.0) * F.col("tp") / (F.col("t") + F.col("p"))).alias("macro_f1"),
        (F.max("t") / F.sum("t")).alias("majority"))


def abstention_report(df: DataFrame, keys: list[str], answer: str, truth: str, rule: str, conf: str) -> DataFrame:
    """AGG-18: coverage, accuracy on answered rows, and the rule's accuracy on both parts."""
    answered = F.col(answer) != "unclear"
    hit = (F.col(answer) == F.col(truth)).cast("long")
    ref = (F.col(rule) == F.col(truth)).cast("long")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), (F.count_if(answered) / F.count(F.lit(1))).alias("coverage"),
        F.try_divide(F.sum(F.when(answered, hit)), F.count_if(answered)).alias("accuracy_answered"),
        F.try_divide(F.sum(F.when(answered, ref)), F.count_if(answered)).alias("rule_answered"),
        F.try_divide(F.sum(F.when(~answered, ref)), F.count_if(~answered)).alias("rule_abstained"),
        (F.sum(hit) / F.count(F.lit(1))).alias("forced_accuracy"))


def bootstrap_mean_difference(df: DataFrame, cluster: list[str], diff: Column, draws: int, seed: int) -> DataFrame:
    """AGG-24: percentile interval of a mean over clusters drawn with replacement.

    Each (draw, cluster) takes a Poisson(1) weight from a hash, the distributed form of the
    multinomial draw, so no draw needs to see all clusters in one place.
    """
    per = df.groupBy(*cluster).agg(F.sum(diff.cast(T.DecimalType(28, 9))).alias("_s"), F.count(F.lit(1)).alias("_n"))
    d = per.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("draw"), *cluster), F.lit(1_000_000_007)) / F.lit(1_000_000_007.0)
    # cumulative Poisson(1) probabilities
    cdf, p, term = [], 0.0, 0.36787944117144233
    for i in range(9):
        p += term
        cdf.append(p)
        term /= i + 1
    weight = sum((F.when(u >= c, 1).otherwise(0) for c in cdf[1:]), F.when(u >= cdf[0], 1).otherwise(0))
    sums = d.withColumn("_w", weight).groupBy("draw").agg(
        (F.sum(F.col("_s") * F.col("_w")).cast("double") / F.sum(F.col("_n") * F.col("_w"))).alias("mean"))
    return sums.agg(F.count("mean").alias("draws"), F.percentile("mean", F.lit(0.025)).alias("lo"),
                    F.percentile("mean", F.lit(0.975)).alias("hi"))


def displacement(df: DataFrame, keys: list[str], window: list[str], step: str, error: Column) -> DataFrame:
    """AGG-25: mean error over all steps (ADE) and over the last step of each window (FDE)."""
    last = df.groupBy(*keys, *window).agg(
        F.sum(error.cast(T.DecimalType(28, 9))).alias("_s"), F.count(F.lit(1)).alias("_n"), F.max_by(error, step).alias("_f"))
    return last.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("windows"), (F.sum("_s").cast("double") / F.sum("_n")).alias("ade"), exact_mean(F.col("_f")).alias("fde"))


def robust_prior(df: DataFrame, keys: list[str], value: str, hot_rows: int | None = None) -> DataFrame:
    """AGG-29: median and median absolute deviation per key.

    Where no key is hot, the rows go once to the partition of their key and are sorted there for both medians. Partitions
    grow with the input, so that a task's memory does not.
    """
    known = df.filter(F.col(value).isNotNull()).select(*keys, value)
    size = plan_bytes(known)
    if hot_rows is None and keys and size is not None and size > SMALL_BYTES and known.groupBy(*keys).count().filter(F.col("count") > HOT_ROWS).isEmpty():
        n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES)
        by = Window.partitionBy(*keys)
        pos = (F.col("n") - 1) * F.lit(0.5)

        def median(c):
            at = lambda i: F.min(F.when(F.col("_c") > i, F.col(c)))
            return at(F.floor(pos)), at(F.ceil(pos))

        def between(lo, hi):
            return (lo + (hi - lo) * (pos - F.floor(pos))).cast("double")

        for k in keys:
            known = known.filter(F.col(k).isNotNull())  # as the join below does
        d = known.repartition(n, *keys).select("*", F.row_number().over(by.orderBy(value)).alias("_c"), F.count(F.lit(1)).over(by).alias("n"))
        lo, hi = median(value)
        d = d.select(*keys, value, "n", between(lo.over(by), hi.over(by)).alias("median"))
        d = d.select(*keys, "n", "median", F.abs(F.col(value) - F.col("median")).alias("_d"))
        d = d.withColumn("_c", F.row_number().over(by.orderBy("_d")))
        lo, hi = median("_d")
        g = d.groupBy(*keys, "n", "median").agg(lo.alias("_lo"), hi.alias("_hi"))
        return g.select(*keys, "n", "median", between(F.col("_lo"), F.col("_hi")).alias("mad"))
    med = quantiles(df, keys, value, {"median": (0.5, "linear")}, hot_rows).withColumnRenamed("n", "_rows")
    dev = df.select(*keys, value).join(med, keys).withColumn("_d", F.abs(F.col(value) - F.col("median")))
    # the median rides along as part of the key, so the second pass already has it
    mad = quantiles(dev, [*keys, "_rows", "median"], "_d", {"mad": (0.5, "linear")}, hot_rows).drop("n")
    return mad.select(*keys, F.col("_rows").alias("n"), "median", "mad")


def average_precision(curve: DataFrame, keys: list[str], score: str, total: DataFrame) -> DataFrame:
    """AGG-20: 101-point interpolated average precision from a :func:`score_curve`.

    ``total`` has (keys, truth). The envelope at recall r is the best precision at recall >= r; each
    curve point serves the recall points at or below its own recall, so a max per point suffices.
    """
    d = curve.join(total, keys)
    recall, precision = F.col("cum_pos") / F.col("truth"), F.col("cum_pos") / F.col("cum_n")
    top = F.floor(recall * 100 + F.lit(1e-9)).cast("int")
    # best precision per highest reachable recall point, then a suffix maximum over 101 cells
    cells = d.groupBy(*keys, top.alias("_i")).agg(F.max(precision).alias("_p"), F.max("truth").alias("truth"))
    w = Window.partitionBy(*keys).orderBy(F.col("_i").desc())
    cells = cells.select("*", F.max("_p").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_e"),
                         F.lead("_i").over(w).alias("_next"))
    # cell i covers the points from the next lower cell (exclusive) up to i
    width = F.col("_i") - F.coalesce(F.col("_next"), F.lit(-1))
    # narrow decimals: a wide product would lose its scale
    share = F.sum(F.col("_e").cast(T.DecimalType(18, 9)) * width.cast(T.DecimalType(4, 0))).cast("double")
    return cells.groupBy(*keys).agg((share / F.lit(101.0)).alias("ap"))
