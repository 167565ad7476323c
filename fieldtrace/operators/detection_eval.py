"""Detection reports: matched counts with ignore regions and size strata, average precision over ten overlaps.

Boxes of one frame and class are matched inside one array expression, so a frame's few dozen objects stay in the JVM and
all thresholds come from one table of pairs. Everything across frames is counts, running sums and order statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.functions import geometry as G
from fieldtrace.operators.metrics import quantiles
from fieldtrace.operators.ordered import running_sum, scan, top_k

BOX = ("x1", "y1", "x2", "y2")
COCO = [x / 100 for x in range(50, 100, 5)]  # fixed values: the overlaps that mean average precision averages


def box(prefix: str = "") -> tuple[Column, ...]:
    return tuple(F.col(prefix + c) for c in BOX)


def frame_pairs(pred: DataFrame, truth: DataFrame, frame: list[str], value: Column) -> DataFrame:
    """Predictions with the truths of their frame; ``value`` may use the truth's box as r_x1 to r_y2."""
    t = truth.select(*frame, "truth_id", *[F.col(c).alias(f"r_{c}") for c in BOX])
    return pred.join(t, frame).select(*frame, "pred_id", "truth_id", "score", value.alias("value"))


def match_frames(pairs: DataFrame, frame: list[str], thresholds: list[float], farther: bool = False, last_tie: bool = False) -> DataFrame:
    """(frame, threshold, pred_id, truth_id, value): each prediction, best score first, takes the free truth with the
    largest value (smallest where ``farther``) if that reaches the threshold.

    Among equal values the smallest truth_id counts, or the largest where ``last_tie``.
    """
    sign = F.col("value") if farther else -F.col("value")
    tie = F.dense_rank().over(Window.partitionBy(*frame).orderBy(F.desc("truth_id") if last_tie else F.asc("truth_id")))
    ok = (lambda v, t: v <= t) if farther else (lambda v, t: v >= t)
    reach = F.lit(max(thresholds) if farther else min(thresholds))
    d = pairs.filter(ok(F.col("value"), reach)).withColumn("_tie", tie)
    item = F.struct((-F.col("score")).alias("o"), "pred_id", sign.alias("v"), "_tie", "truth_id", "value")
    g = d.groupBy(*frame).agg(F.array_sort(F.collect_list(item)).alias("_p"))  # one frame and class
    ids = d.select("pred_id", "truth_id").schema
    empty = F.array().cast(f"array<struct<pred_id:{ids['pred_id'].dataType.simpleString()},truth_id:{ids['truth_id'].dataType.simpleString()},value:double>>")

    def fold(t):
        def step(acc, x):
            used = F.exists(acc, lambda a: (a["pred_id"] == x["pred_id"]) | (a["truth_id"] == x["truth_id"]))
            return F.when(used, acc).otherwise(F.concat(acc, F.array(F.struct(x["pred_id"].alias("pred_id"), x["truth_id"].alias("truth_id"), x["value"].alias("value")))))
        return F.struct(t.alias("threshold"), F.aggregate(F.filter("_p", lambda p: ok(p["value"], t)), empty, step).alias("m"))

    runs = F.transform(F.array(*[F.lit(float(t)) for t in thresholds]), fold)
    return g.select(*frame, F.explode(runs).alias("_r")).select(*frame, "_r.threshold", F.explode("_r.m").alias("_m")).select(*frame, "threshold", "_m.*")


def detection_facts(pred: DataFrame, truth: DataFrame, regions: DataFrame, frame: list[str], label: str, score_threshold: float, min_iou: float, centre_px: float | None = None) -> DataFrame:
    """AGG-19: one fact per truth and prediction: gt, tp, fp, ignored as 0 or 1, the size of its box and the centre error
    of a match. An unmatched prediction in an ignore region is no false positive; a matched one is not asked.

    ``regions``: frame, boxes (array of struct x1..y2), polygons (array of arrays of struct x, y). Matching is by overlap,
    or by centre distance up to ``centre_px``.
    """
    key = [*frame, label]
    p = pred.filter(F.col("score") >= score_threshold)
    value = G.center_distance(box(), box("r_")) if centre_px is not None else G.iou(box(), box("r_"))
    m = match_frames(frame_pairs(p, truth, key, value), key, [min_iou if centre_px is None else centre_px], centre_px is not None).drop("threshold")
    size = G.size_bucket(box())
    one = lambda cond: F.when(cond, 1).otherwise(0)
    t = truth.join(m.select(*key, "truth_id", "value"), [*key, "truth_id"], "left").select(*key, size.alias("size"), F.lit(1).alias("gt"), one(F.col("value").isNotNull()).alias("tp"), F.lit(0).alias("predictions"),
                                                                                      F.lit(0).alias("fp"), F.lit(0).alias("ignored"), (F.col("value") if centre_px is not None else F.lit(None).cast("double")).alias("error"))
    hit = m.select(*key, "pred_id").withColumn("_hit", F.lit(True))
    q = p.join(hit, [*key, "pred_id"], "left").join(regions.select(*frame, "boxes", "polygons"), frame, "left")
    out = F.coalesce(G.ignored(box(), F.col("boxes"), F.col("polygons"), min_iou), F.lit(False))
    lone = F.col("_hit").isNull()
    q = q.select(*key, size.alias("size"), F.lit(0).alias("gt"), F.lit(0).alias("tp"), F.lit(1).alias("predictions"), one(lone & ~out).alias("fp"), one(lone & out).alias("ignored"), F.lit(None).cast("double").alias("error"))
    return t.unionByName(q)


def detection_report(pred: DataFrame, truth: DataFrame, regions: DataFrame, manifest: DataFrame, frame: list[str], label: str, by: str, score_threshold: float, min_iou: float,
                     centre_px: float | None = None, hot_rows: int | None = None) -> DataFrame:
    """AGG-19: counts, precision, recall and false positives per frame by class and ``by``, by class, and overall, each for
    all boxes and by size of the box; with ``centre_px`` also mean, median and 95th percentile of the centre error.

    Levels above the class carry "all". Frames are those of the manifest, with or without boxes.
    """
    frames = manifest.select(*frame).distinct()
    facts = detection_facts(pred, truth, regions, frame, label, score_threshold, min_iou, centre_px).join(frames, frame, "left_semi")
    text = lambda c: F.col(c).cast("string")
    level = lambda a, b: F.struct(a.alias("label"), b.alias("by"))
    every = F.lit("all")
    d = facts.select("*", F.explode(F.array(level(text(label), text(by)), level(text(label), every), level(every, every))).alias("_l"))
    d = d.select(F.col("_l.label").alias("label_"), F.col("_l.by").alias("by_"), F.explode(F.array("size", every)).alias("size_"), "gt", "tp", "predictions", "fp", "ignored", "error")
    keys = ["label_", "by_", "size_"]
    g = d.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("gt", "predictions", "tp", "fp", "ignored")])
    n = frames.select(F.explode(F.array(text(by), every)).alias("by_")).groupBy("by_").agg(F.count("*").alias("frames"))
    g = g.withColumn("fn", F.col("gt") - F.col("tp")).join(n, "by_")
    cols = [*keys, "frames", "gt", "predictions", "tp", "fp", "fn", "ignored", F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", "gt").alias("recall"), F.try_divide("fp", "frames").alias("fp_per_frame")]
    if centre_px is None:
        out = g.select(*cols)
    else:
        q = quantiles(d.filter(F.col("error").isNotNull()), keys, "error", {"error_median": (0.5, "linear"), "error_p95": (0.95, "nearest_rank")}, hot_rows).drop("n")
        mean = d.groupBy(*keys).agg(F.round(F.avg("error"), 9).alias("error_mean"))
        out = g.select(*cols).join(mean, keys).join(q, keys, "left")
    return out.withColumnsRenamed({"label_": "label", "by_": "by", "size_": "size"})


def precision_table(pred: DataFrame, truth: DataFrame, crowds: DataFrame, frame: list[str], label: str, thresholds: list[float] = COCO, max_dets: int = 100, hot_rows: int | None = None) -> DataFrame:
    """AGG-20: (label, threshold, truths, ap): average precision on 101 recall points, from one ranking per class.

    ``crowds`` (frame, x1..y2) are regions for every class: a prediction that matches no truth, but lies in a region with
    the threshold's share of its own area, counts neither way. ``max_dets`` predictions count per frame and class. Equal
    scores rank in the order of frame and pred_id. A class without truths has no precision and no row.
    """
    key = [*frame, label]
    top = top_k(pred, key, [F.desc("score"), F.col("pred_id")], max_dets, "_rank").drop("_rank")
    m = match_frames(frame_pairs(top, truth, key, G.iou(box(), box("r_"))), key, thresholds, last_tie=True)
    hits = m.groupBy(*key, "pred_id").agg(F.collect_set("threshold").alias("_hits"))
    c = crowds.select(*frame, *[F.col(x).alias(f"r_{x}") for x in BOX])
    inside = top.join(c, frame).groupBy(*key, "pred_id").agg(F.max(G.own_overlap(box(), box("r_"))).alias("_crowd"))
    d = top.select(*key, "pred_id", "score").join(hits, [*key, "pred_id"], "left").join(inside, [*key, "pred_id"], "left").withColumn("_neg", -F.col("score"))
    steps = {}
    for i, t in enumerate(thresholds):
        hit = F.coalesce(F.array_contains("_hits", float(t)), F.lit(False))
        counts = hit | ~F.coalesce(F.col("_crowd") >= t, F.lit(False))
        d = d.withColumn(f"_h{i}", hit.cast("long"))
        steps |= {f"_t{i}": running_sum(hit.cast("long")), f"_n{i}": running_sum(counts.cast("long"))}
    ranked = scan(d, [label], ["_neg", *frame, "pred_id"], steps, hot_rows)
    rows = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_h{i}").alias("hit"), F.col(f"_t{i}").alias("tp"), F.col(f"_n{i}").alias("n")) for i, t in enumerate(thresholds)]))
    totals = truth.groupBy(label).agg(F.count("*").alias("truths"))
    spine = totals.select(label, "truths", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    curve = ranked.select(label, rows.alias("_r")).select(label, "_r.*").filter("hit = 1").join(totals, label)  # precision peaks at hits
    # best precision per last recall point reached, then the best at or beyond each point
    cells = curve.groupBy(label, "threshold", F.floor(F.col("tp") * 100 / F.col("truths") + F.lit(1e-9)).cast("int").alias("_i")).agg(F.max(F.col("tp") / F.col("n")).alias("_p"))
    w = Window.partitionBy(label, "threshold").orderBy(F.desc("_i"))
    cells = cells.select("*", F.max("_p").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_e"), (F.col("_i") - F.coalesce(F.lead("_i").over(w), F.lit(-1))).alias("_w"))
    bits = F.array_sort(F.collect_list(F.struct("_i", "_e", "_w")))  # 101 at most, so the sum has one order
    ap = cells.groupBy(label, "threshold").agg((F.aggregate(bits, F.lit(0.0), lambda s, x: s + x["_e"] * x["_w"]) / 101).alias("ap"))
    return spine.join(ap, [label, "threshold"], "left").select(label, "threshold", "truths", F.coalesce("ap", F.lit(0.0)).alias("ap"))


def mean_precision(table: DataFrame, label: str) -> DataFrame:
    """AGG-20: mean average precision, and that at .50 and .75, per class and over the classes ("all")."""
    pick = lambda t: F.max(F.when(F.abs(F.col("threshold") - t) < 1e-9, F.col("ap")))
    each = table.groupBy(F.col(label).cast("string").alias("label")).agg(F.avg("ap").alias("map"), pick(0.5).alias("ap50"), pick(0.75).alias("ap75"))
    both = each.unionByName(each.groupBy(F.lit("all").alias("label")).agg(*[F.avg(c).alias(c) for c in ("map", "ap50", "ap75")]))
    return both.select("label", *[F.round(c, 9).alias(c) for c in ("map", "ap50", "ap75")])


def chain_churn(boxes: DataFrame, keys: list[str], frame: str, box_id: str, track: str, min_iou: float, min_chain: int, hot_rows: int | None = None) -> DataFrame:
    """AGG-34: boxes linked from frame to frame into chains, and how often a chain changes its track id.

    Between a frame and the next one with boxes, pairs are taken by falling overlap, one to one, from ``min_iou`` on. Chains
    are the components of these links, closed by label jumps in logarithmically many rounds; a flip is a link between
    different tracks. Flips count on chains of ``min_chain`` boxes at least.
    """
    from fieldtrace.operators.linking import components
    from fieldtrace.operators.matching import greedy_match
    from fieldtrace.operators.ordered import next_
    from fieldtrace.session import cut_lineage

    step = scan(boxes.select(*keys, frame).distinct(), keys, [frame], {"_to": next_(F.col(frame))}, hot_rows).filter("_to IS NOT NULL")
    b = boxes.select(*keys, F.col(frame).alias("_to"), F.col(box_id).alias("_b"), F.col(track).alias("_tb"), *[F.col(c).alias(f"r_{c}") for c in BOX])
    pairs = boxes.select(*keys, frame, F.col(box_id).alias("_a"), F.col(track).alias("_ta"), *BOX).join(step, [*keys, frame]).join(b, [*keys, "_to"])
    pairs = pairs.withColumn("_o", -G.iou(box(), box("r_"))).filter(F.col("_o") <= -min_iou).select(*keys, frame, "_a", "_b", "_o", (~F.col("_ta").eqNullSafe(F.col("_tb"))).cast("long").alias("_flip"))
    links = cut_lineage(greedy_match(pairs, [*keys, frame], "_a", "_b", ["_o", "_a", "_b"]))
    roots = components(boxes.select(*keys, F.col(box_id).alias("_a")).distinct(), links, keys, "_a", "_a", "_b")
    flips = links.groupBy(*keys, "_a").agg(F.sum("_flip").alias("_flip"))
    chains = roots.join(flips, [*keys, "_a"], "left").groupBy(*keys, "root").agg(F.count("*").alias("_n"), F.coalesce(F.sum("_flip"), F.lit(0)).alias("_f"))
    long_ = F.col("_n") >= min_chain
    d = chains.groupBy(*keys).agg(F.count("*").alias("chains"), F.count_if(long_).alias("long_chains"), F.count_if(long_ & (F.col("_f") > 0)).alias("flipped"),
                                  F.coalesce(F.sum(F.when(long_, F.col("_f"))), F.lit(0)).alias("flips"), F.coalesce(F.max(F.when(long_, F.col("_f"))), F.lit(0)).alias("most_flips"))
    return d.withColumn("flip_rate", F.col("flipped") / F.greatest("long_chains", F.lit(1))).withColumn("flips_per_chain", F.col("flips") / F.greatest("long_chains", F.lit(1)))
