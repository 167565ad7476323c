"""Data-quality rules, leakage guards and acceptance gates. Violations come back as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrace.operators.ordered import prev, scan


def exclude_sealed(rows: DataFrame, sealed: DataFrame, keys: list[str]) -> DataFrame:
    """JOIN-18: rows whose key is on no never-train list."""
    return rows.join(sealed.select(*keys).distinct(), keys, "left_anti")


def split_overlap(splits: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """JOIN-18 / ORD-07 / SRC-22: keys present in more than one split, with the splits they are in."""
    parts = [d.select(*keys).distinct().withColumn("split", F.lit(n)) for n, d in splits.items()]
    g = reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.array_sort(F.collect_set("split")).alias("splits"))
    return g.filter(F.size("splits") > 1)


def symmetric_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """ORD-07: keys on one side only ("left" or "right"); empty means the same set."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    return x.join(y, keys, "left_anti").withColumn("side", F.lit("left")).unionByName(
        y.join(x, keys, "left_anti").withColumn("side", F.lit("right")))


def merge_many_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """JOIN-24: join that fails on a duplicate right key or a left row without a match."""
    cols = [c for c in right.columns if c not in keys]
    one = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in cols])
    d = left.join(one, keys, "left")
    message = F.when(F.col("_n").isNull(), F.lit("merge: key without a match")).otherwise(F.lit("merge: duplicate key"))
    ok = F.coalesce(F.col("_n") == 1, F.lit(False))
    return d.filter(F.when(ok, True).otherwise(F.raise_error(message).isNull())).drop("_n")


def merge_one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """JOIN-24: as :func:`merge_many_to_one`, and the left keys must be unique too."""
    cols = [c for c in left.columns if c not in keys]
    one = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"), *[F.first(c).alias(c) for c in cols])
    one = one.filter(F.when(F.col("_m") == 1, True).otherwise(F.raise_error(F.lit("merge: duplicate key")).isNull())).drop("_m")
    return merge_many_to_one(one, right, keys)


def count_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """DQ-01: rows failing each row-level rule, in one pass (a null test counts as a failure)."""
    agg = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(n) for n, ok in rules.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules]))
    return agg.select(pairs.alias("r")).select("r.*")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """DQ-01 / ORD-08: keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def clock_violations(df: DataFrame, keys: list[str], order: list[str], clock: str, hot_rows: int | None = None) -> DataFrame:
    """DQ-01: rows whose clock does not increase along the order."""
    d = scan(df, keys, order, {"_p": prev(F.col(clock))}, hot_rows)
    return d.filter(F.col(clock) <= F.col("_p")).withColumnRenamed("_p", "previous")


def orphans(child: DataFrame, parent: DataFrame, on: dict[str, str]) -> DataFrame:
    """DQ-01: child rows whose reference has no parent."""
    cond = reduce(lambda a, b: a & b, [child[c] == parent[p] for c, p in on.items()])
    return child.join(parent, cond, "left_anti")


def rule_status(facts: DataFrame, rules: list[str], blocking: list[str]) -> DataFrame:
    """DQ-02: outcome of each rule from (rule, outcome) facts, outcome in checked, skipped, violation.

    A rule without facts is skipped, never clean. Status: violations, partial (some facts skipped),
    checked, skipped.
    """
    spark = facts.sparkSession
    names = spark.createDataFrame([(r, r in blocking) for r in rules], "rule string, blocking boolean")
    g = facts.groupBy("rule").agg(
        F.count_if(F.col("outcome") != "skipped").alias("checked"), F.count_if(F.col("outcome") == "skipped").alias("skipped"),
        F.count_if(F.col("outcome") == "violation").alias("violations"))
    d = names.join(g, "rule", "left").fillna(0, ["checked", "skipped", "violations"])
    status = (F.when(F.col("violations") > 0, "violations").when(F.col("checked") == 0, "skipped")
              .when(F.col("skipped") > 0, "partial").otherwise("checked"))
    return d.withColumn("status", status).withColumn("blocks", F.col("blocking") & (F.col("violations") > 0))


def envelope(manifest: DataFrame, predictions: DataFrame, frame: list[str], score: str) -> DataFrame:
    """DQ-03: one row per manifest or predicted frame: missing (counts as empty), unexpected, bad scores."""
    p = predictions.groupBy(*frame).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(F.col(score).between(0, 1), F.lit(False))).alias("bad_scores"))
    m = manifest.groupBy(*frame).agg(F.count(F.lit(1)).alias("listed"))
    d = m.join(p, frame, "full_outer").fillna(0, ["n", "bad_scores", "listed"])
    status = (F.when(F.col("listed") == 0, "unexpected").when(F.col("listed") > 1, "duplicate").when(F.col("bad_scores") > 0, "bad_score")
              .when(F.col("n") == 0, "missing").otherwise("ok"))
    return d.withColumn("status", status)


def channel_census(spine: DataFrame, rows: DataFrame, frame: list[str], by: list[str]) -> DataFrame:
    """SRC-29: expected frames, frames with rows, and the status missing, empty, partial or present."""
    have = rows.select(*frame).distinct().withColumn("_has", F.lit(1))
    d = spine.select(*frame).distinct().join(have, frame, "left")
    g = d.groupBy(*by).agg(F.count(F.lit(1)).alias("expected"), F.count("_has").alias("present"))
    status = (F.when(F.col("present") == 0, "empty").when(F.col("present") < F.col("expected"), "partial").otherwise("present"))
    return g.withColumn("without", F.col("expected") - F.col("present")).withColumn("status", status)


def acceptance(metrics: DataFrame, criteria: DataFrame) -> DataFrame:
    """AGG-48: each criterion (path, op, threshold) against metrics (path, value): accepted, rejected or
    unmeasured. Two tables of one row per metric."""
    d = criteria.join(metrics, "path", "left")
    v, t = F.col("value"), F.col("threshold")
    ok = (F.when(F.col("op") == ">=", v >= t).when(F.col("op") == "<=", v <= t).when(F.col("op") == ">", v > t)
          .when(F.col("op") == "<", v < t).when(F.col("op") == "==", v == t))
    return d.withColumn("verdict", F.when(v.isNull() | F.isnan(v), "unmeasured").when(ok, "accepted").otherwise("rejected"))


def review_violations(reviews: DataFrame, evidence: DataFrame, fields: dict[str, list[str] | None], window: tuple[int, int]) -> DataFrame:
    """DQ-04: review rows breaking the contract, one row per broken rule.

    ``reviews`` has review_id, field, value, start, end, evidence_id; ``evidence`` has evidence_id, at.
    ``fields`` maps each permitted field to its permitted values (None for any).
    """
    d = reviews.join(evidence.select("evidence_id", F.col("at").alias("_at")), "evidence_id", "left")
    known = F.col("field").isin(list(fields))
    domain = F.lit(True)
    for name, values in fields.items():
        if values is not None:
            domain = domain & ((F.col("field") != name) | F.col("value").isin(values))
    codes = F.array_compact(F.array(
        F.when(~known, "unknown_field"), F.when(known & ~domain, "value_outside_domain"),
        F.when(~(F.col("start") < F.col("end")), "empty_interval"),
        F.when((F.col("start") < window[0]) | (F.col("end") > window[1]), "outside_window"),
        F.when(F.col("_at").isNull(), "unknown_evidence"),
        F.when(F.col("_at").isNotNull() & ~((F.col("_at") >= F.col("start")) & (F.col("_at") < F.col("end"))), "evidence_outside_interval")))
    return d.select("review_id", F.explode(codes).alias("violation"))
