"""Votes, pools and posteriors per key, with quorum and abstention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

DEC = T.DecimalType(28, 9)


def presence_evidence(df: DataFrame, keys: list[str], located: Column, inside: Column, min_rows: int = 10,
                      min_ratio: float = 0.5) -> DataFrame:
    """AGG-02: share of located rows inside, per track; tracks never located are omitted."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(located).alias("n_localized"),
                              F.count_if(located & inside).alias("n_inside")).filter("n_localized > 0")
    ratio = F.col("n_inside") / F.col("n_localized")
    return g.withColumn("ratio", ratio).withColumn("eligible", (F.col("n") >= min_rows) & (ratio >= min_ratio))


def weighted_vote(df: DataFrame, keys: list[str], candidate: str, weight: Column, quorum: int = 2, top: int = 3) -> DataFrame:
    """AGG-03: posterior over candidates with at least ``quorum`` reads, best ``top`` kept."""
    g = df.groupBy(*keys, candidate).agg(F.sum(weight.cast(DEC)).alias("_w"), F.count(F.lit(1)).alias("reads"))
    g = g.filter(F.col("reads") >= quorum)
    total = F.sum("_w").over(Window.partitionBy(*keys))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_w").desc(), candidate))
    d = g.select(*keys, candidate, "reads", (F.col("_w").cast("double") / total.cast("double")).alias("posterior"), rank.alias("rank"))
    return d.filter(F.col("rank") <= top)


def majority(df: DataFrame, keys: list[str], label: str, min_votes: int, dominance: float) -> DataFrame:
    """AGG-04 / AGG-05: the most frequent label when it has enough votes and share, else null."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"))
    g = counts.groupBy(*keys).agg(
        F.min_by(F.struct(label, "_n"), F.struct((-F.col("_n")).alias("n"), F.col(label))).alias("_b"), F.sum("_n").alias("votes"))
    ok = (F.col("_b._n") >= min_votes) & (F.col("_b._n") / F.col("votes") >= dominance)
    return g.select(*keys, F.when(ok, F.col(f"_b.{label}")).alias(label), F.col("_b._n").alias("top_votes"), "votes")


def pool_evidence(channels: list[tuple[DataFrame, float]], keys: list[str], label: str, weight: str,
                  allowed: DataFrame | None = None) -> DataFrame:
    """AGG-06 / JOIN-31: weighted sums per (key, label) over several channels; winner and its share.

    ``allowed`` optionally lists the permitted (keys, label) pairs.
    """
    parts = [d.select(*keys, label, (F.col(weight) * F.lit(float(w))).cast(DEC).alias("_w")) for d, w in channels]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    g = union.groupBy(*keys, label).agg(F.sum("_w").alias("_w"))
    if allowed is not None:
        g = g.join(allowed, [*keys, label], "left_semi")
    out = g.groupBy(*keys).agg(F.min_by(F.struct(label, "_w"), F.struct((-F.col("_w")).alias("w"), F.col(label))).alias("_b"),
                               F.sum("_w").alias("_t"))
    return out.select(*keys, F.col(f"_b.{label}").alias(label), (F.col("_b._w").cast("double") / F.col("_t").cast("double")).alias("share"))


def top_posterior(df: DataFrame, keys: list[str], candidate: str, prob: str, order: list[str], floor: float) -> DataFrame:
    """AGG-07: candidate with the largest probability at or above ``floor``; the first row wins a tie."""
    g = df.groupBy(*keys).agg(F.min_by(F.struct(candidate, prob), F.struct((-F.col(prob)).alias("p"), *order)).alias("_b"))
    return g.select(*keys, f"_b.{candidate}", f"_b.{prob}").filter(F.col(prob) >= floor)


def bind_cluster(df: DataFrame, keys: list[str], cluster: str, match: Column, min_matches: int = 2) -> DataFrame:
    """AGG-08: cluster 0 or 1 with more trusted matches; null when tied or fewer than ``min_matches``."""
    g = df.groupBy(*keys).agg(F.count_if(match & (F.col(cluster) == 0)).alias("n0"), F.count_if(match & (F.col(cluster) == 1)).alias("n1"))
    top = F.greatest("n0", "n1")
    pick = F.when((top >= min_matches) & (F.col("n0") != F.col("n1")), F.when(F.col("n0") > F.col("n1"), 0).otherwise(1))
    return g.withColumn("bound", pick)


def single_name(df: DataFrame, keys: list[str], candidate: str, survives: Column) -> DataFrame:
    """AGG-09: the key's name if exactly one candidate survives; filtered and conflict counts.

    Minimum and maximum decide "exactly one" without collecting the candidates.
    """
    kept = F.when(survives, F.col(candidate))
    g = df.groupBy(*keys).agg(F.min(kept).alias("_lo"), F.max(kept).alias("_hi"), F.count_if(~survives).alias("filtered"))
    return g.select(*keys, F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias("name"), "filtered",
                    F.coalesce(F.col("_lo") != F.col("_hi"), F.lit(False)).alias("conflicted"))


def attacked_ends(df: DataFrame, keys: list[str], team: str, side: str, order: str) -> DataFrame:
    """AGG-10: end attacked by teams 0 and 1: majority of located shots (first seen on a tie); both on
    one end drops the weaker (team 0 when equal); a silent team takes the other end."""
    located = F.col(side).isin("left", "right")
    aggs = []
    for m in (0, 1):
        mine = F.col(team) == m
        aggs += [F.count_if(mine & (F.col(side) == e)).alias(f"_{e[0]}{m}") for e in ("left", "right")]
        aggs += [F.min_by(F.when(located, F.col(side)), F.when(mine & located, F.col(order))).alias(f"_f{m}"),
                 F.count_if(mine).alias(f"_s{m}")]
    g = df.groupBy(*keys).agg(*aggs)

    def vote(m):
        a, b = F.col(f"_l{m}"), F.col(f"_r{m}")
        return F.when(a > b, "left").when(b > a, "right").otherwise(F.col(f"_f{m}")), F.greatest(a, b)

    (e0, n0), (e1, n1) = vote(0), vote(1)
    same = F.coalesce(e0 == e1, F.lit(False))
    b0 = F.when(same & (n0 <= n1), F.lit(None)).otherwise(e0)
    b1 = F.when(same & (n1 < n0), F.lit(None)).otherwise(e1)
    flip = lambda e: F.when(e == "left", "right").when(e == "right", "left")
    both = (F.col("_s0") > 0) & (F.col("_s1") > 0)
    return g.select(*keys, F.coalesce(b0, F.when(both, flip(b1))).alias("end0"), F.coalesce(b1, F.when(both, flip(b0))).alias("end1"))


def stat_key(pick: Column, event_read: Column, allowed: Column, conflicting: Column, concurrent: Column, entity: Column) -> Column:
    """AGG-12: person pick, else an allowed event read, demoted to ``e<entity>`` on conflict or concurrency."""
    fallback = F.concat(F.lit("e"), entity.cast("string"))
    return (F.when(pick.isNotNull(), pick).when(conflicting | concurrent, fallback)
            .when(event_read.isNotNull() & allowed, event_read).otherwise(fallback))


def position_descriptor(df: DataFrame, keys: list[str], perimeter: Column, paint: Column, min_samples: int = 150) -> DataFrame:
    """AGG-14: guard, big or wing by shares of samples outside and in the paint."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), (F.count_if(perimeter) / F.count(F.lit(1))).alias("perimeter"),
                              (F.count_if(paint) / F.count(F.lit(1))).alias("paint")).filter(F.col("samples") >= min_samples)
    role = (F.when((F.col("perimeter") >= 0.45) & (F.col("paint") <= 0.20), "guard")
            .when((F.col("paint") >= 0.40) & (F.col("perimeter") <= 0.20), "big").otherwise("wing"))
    return g.withColumn("position", role)


def conflict_rate(df: DataFrame, keys: list[str], track: str, label: str, quorum: int) -> DataFrame:
    """AGG-33: share of tracks with at least two labels that each reach the quorum."""
    n = df.groupBy(*keys, track, label).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= quorum)
    per = n.groupBy(*keys, track).agg(F.count(F.lit(1)).alias("_labels"))
    return per.groupBy(*keys).agg(F.count(F.lit(1)).alias("tracks"), F.count_if(F.col("_labels") >= 2).alias("conflicted"),
                                  (F.count_if(F.col("_labels") >= 2) / F.count(F.lit(1))).alias("rate"))


def track_identity(frames: DataFrame, keys: list[str], p: str, lineup: str | None = None, min_posterior: float = 0.9,
                   min_evidence: float = 1.0, min_legible: float = 0.2, max_nats: float = 3.0, floor: float = 1e-4) -> DataFrame:
    """AGG-39: posterior number of a track from per-frame distributions (last cell "unreadable").

    A frame weighs legibility squared, illegible frames weigh nothing, and no frame moves a candidate
    by more than ``max_nats``. The decision needs posterior and evidence.
    """
    from fieldtrace.functions.decide import restrict_to_lineup

    dist = restrict_to_lineup(F.col(p), F.col(lineup)) if lineup else F.col(p)
    d = frames.withColumn("_r", dist).withColumn("_leg", F.lit(1.0) - F.get("_r", F.size("_r") - 1))
    used = F.col("_leg") >= min_legible
    d = d.withColumn("_w", F.when(used, F.col("_leg") * F.col("_leg")).otherwise(0.0))
    inside = F.array_contains(lineup, F.col("_i")) if lineup else F.lit(True)
    total = F.aggregate(F.slice("_r", 1, F.size("_r") - 1), F.lit(0.0), lambda a, v: a + v)
    # every cell relative to the frame's best, in nats, clipped
    d = d.withColumn("_sum", total).withColumn("_best", F.array_max(F.slice("_r", 1, F.size("_r") - 1)))
    cells = d.select(*keys, "_w", "_sum", "_best", *([lineup] if lineup else []),
                     F.posexplode(F.slice("_r", 1, F.size("_r") - 1)).alias("_i", "_v")).filter(inside)
    ll = lambda v: F.log(F.greatest(v / F.col("_sum"), F.lit(floor)))
    nats = F.when(F.col("_sum") > 0, F.greatest(ll(F.col("_v")) - ll(F.col("_best")), F.lit(-max_nats))).otherwise(0.0)
    score = cells.groupBy(*keys, "_i").agg(F.sum((F.col("_w") * nats).cast(DEC)).cast("double").alias("_s"))
    by = Window.partitionBy(*keys)
    score = score.withColumn("_e", F.exp(F.col("_s") - F.max("_s").over(by)))
    best = score.groupBy(*keys).agg(F.min_by(F.struct("_i", "_e"), F.struct((-F.col("_s")).alias("s"), "_i")).alias("_b"), F.sum("_e").alias("_z"))
    ev = d.groupBy(*keys).agg(F.sum(F.col("_w").cast(DEC)).cast("double").alias("evidence"), F.count(F.lit(1)).alias("frames"))
    out = best.join(ev, keys).withColumn("posterior", F.col("_b._e") / F.col("_z"))
    decided = (F.col("posterior") >= min_posterior) & (F.col("evidence") >= min_evidence)
    status = F.when(decided, "identified").when(F.col("evidence") < min_evidence, "insufficient_evidence").otherwise("undecided")
    return out.select(*keys, F.col("_b._i").alias("top_number"), F.when(decided, F.col("_b._i")).alias("number"), "posterior",
                      "evidence", "frames", status.alias("status"))
