"""Model operators on tables with Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtrace.functions.decide import thin
from fieldtrace.operators.metrics import probability_metrics
from fieldtrace.session import cut_lineage, spread

BROADCAST_JOBS = 5_000  # checked bound for tables of a few vectors per job


def forest(train: DataFrame, features: list[str], label: str, trees: int = 160, depth: int = 6, weight: str | None = None, seed: int = 7):
    """ML-01 / ML-02: random forest over numeric columns; string labels are indexed by frequency."""
    stages = [VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep")]
    target = label
    if isinstance(train.schema[label].dataType, T.StringType):
        stages.append(StringIndexer(inputCol=label, outputCol="_y", handleInvalid="keep"))
        target = "_y"
    rf = RandomForestClassifier(featuresCol="_x", labelCol=target, numTrees=trees, maxDepth=depth, seed=seed, probabilityCol="_p", predictionCol="_pred", rawPredictionCol="_raw")
    if weight:
        rf = rf.setWeightCol(weight)
    # a file of few splits would leave all trees to few tasks
    return Pipeline(stages=[*stages, rf]).fit(spread(train, train.columns))


def score(model, rows: DataFrame, out: str = "score") -> DataFrame:
    """Probability of class 1 beside the rows' own columns."""
    return model.transform(rows).select(*rows.columns, vector_to_array("_p")[1].alias(out))


def class_weights(train: DataFrame, label: str) -> DataFrame:
    """ML-02: balanced weights n / (classes * n_class)."""
    n = train.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    tot = n.agg(F.sum("_n").alias("_t"), F.count(F.lit(1)).alias("_k"))
    w = n.join(F.broadcast(tot), F.lit(True)).select(label, (F.col("_t") / (F.col("_k") * F.col("_n"))).alias("weight"))  # one-row total
    return train.join(w, label)


def against_prior(scored: DataFrame, label: str, prior: float) -> DataFrame:
    """ML-01: metrics of the model and of the training prior on the same rows."""
    y = F.col(label) == 1
    m = probability_metrics(scored, [], "score", y)
    p = probability_metrics(scored.withColumn("score", F.lit(prior)), [], "score", y)
    return m.withColumn("model", F.lit("forest")).unionByName(p.withColumn("model", F.lit("prior")))


def logistic_path(train: DataFrame, dev: DataFrame, features: list[str], label: str, grid: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0), weight: str | None = None):
    """ML-03: standardised logistic models over C, the one with the least dev log loss kept.

    The ridge penalty of a summed loss with strength C is 1 / (C n) in Spark's mean loss.
    """
    n = train.count()
    best = None
    for c in grid:
        lr = LogisticRegression(featuresCol="_z", labelCol=label, regParam=1.0 / (c * n), standardization=False, probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_pred", maxIter=200)
        if weight:
            lr = lr.setWeightCol(weight)
        model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), StandardScaler(inputCol="_x", outputCol="_z", withMean=True), lr]).fit(train)
        loss = probability_metrics(score(model, dev), [], "score", F.col(label) == 1).first()["log_loss"]
        if best is None or loss < best[0]:
            best = (loss, c, model)
    return best


def shot_ranker(rows: DataFrame, features: list[str], label: str, weight: str, game: str):
    """ML-04: weighted logistic ranker trained on games whose hash leaves them out of validation."""
    valid = ~thin([F.col(game)], 3, 0.2)
    _, c, model = logistic_path(rows.filter(~valid), rows.filter(valid), features, label, weight=weight)
    return model, score(model, rows.filter(valid))


def team_clusters(rows: DataFrame, keys: list[str], row_id: str, vector: str, k: int = 3, rounds: int = 100, min_rows: int = 6) -> DataFrame:
    """ML-05: k-means per job in all jobs at once: labels by size (largest 0), margin = second distance minus
    first; jobs with fewer than ``min_rows`` rows get -1.

    Seeds are the smallest id and then the farthest rows, so the result does not depend on a random draw.
    A round joins rows to the array of centres of their job and averages; no job has to fit a task. The centres travel to
    the rows, not the rows to the centres, unless there are more than ``BROADCAST_JOBS`` jobs. Rounds go on until no
    centre of any job moves, ``rounds`` at most.
    """
    n = cut_lineage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    side = F.broadcast if n.count() <= BROADCAST_JOBS else (lambda d: d)
    kept = rows.join(side(n.filter(F.col("_n") >= min_rows).drop("_n")), keys, "left_semi").select(*keys, row_id, F.transform(vector, lambda v: v.cast("double")).alias("_v"))
    big = cut_lineage(spread(kept, [*keys, row_id]))  # a file of few splits would leave all rounds to few tasks

    def sq(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)

    def distances(centres):
        """Rows with their distances to the centres of their job, nearest first; a job's centres are one array."""
        packed = centres.groupBy(*keys).agg(F.collect_list(F.struct("_k", "_c")).alias("_all"))
        near = F.array_sort(F.transform("_all", lambda c: F.struct(F.sqrt(sq(F.col("_v"), c["_c"])).alias("d"), c["_k"].alias("k"))))
        return big.join(side(packed), keys).select(*keys, row_id, "_v", near.alias("_near"))

    first = lambda i, f: F.get("_near", F.lit(i))[f]
    centres = big.groupBy(*keys).agg(F.min_by("_v", row_id).alias("_c")).withColumn("_k", F.lit(0))
    for i in range(1, k):
        far = distances(centres).groupBy(*keys).agg(F.max_by("_v", F.struct(first(0, "d").alias("d"), -F.col(row_id))).alias("_c"))
        centres = cut_lineage(centres.unionByName(far.withColumn("_k", F.lit(i))))
    for _ in range(rounds):
        cells = distances(centres).select(*keys, first(0, "k").alias("_k"), F.posexplode("_v").alias("_i", "_x"))
        mean = cells.groupBy(*keys, "_k", "_i").agg((F.sum(F.col("_x").cast(T.DecimalType(28, 12))).cast("double") / F.count(F.lit(1))).alias("_m"))
        moved = mean.groupBy(*keys, "_k").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("_c"))
        old = centres.select(*keys, "_k", F.col("_c").alias("_old"))
        moved = cut_lineage(moved.join(side(old), [*keys, "_k"], "left").select(*keys, "_k", "_c", F.col("_c").eqNullSafe(F.col("_old")).alias("_still")))
        still = moved.filter(~F.col("_still")).isEmpty()
        centres = moved.drop("_still")
        if still:
            break
    got = distances(centres).select(*keys, row_id, first(0, "k").alias("_k"), (first(1, "d") - first(0, "d")).alias("margin"))
    size = got.groupBy(*keys, "_k").agg(F.count(F.lit(1)).alias("_n"))
    from fieldtrace.operators.ordered import top_k
    rank = top_k(size, keys, [F.col("_n").desc(), F.col("_k")], k, "_r").select(*keys, "_k", (F.col("_r") - 1).alias("cluster"))
    named = got.join(side(rank), [*keys, "_k"]).select(*keys, row_id, "cluster", "margin")
    return rows.select(*keys, row_id).join(named, [*keys, row_id], "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)))
