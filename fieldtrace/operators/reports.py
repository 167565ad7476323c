"""Reports over matched, tracked and attributed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtrace.functions import geometry as G
from fieldtrace.operators.metrics import exact_mean, quantiles
from fieldtrace.operators.ordered import prev, scan, top_k


def detection_counts(pred: DataFrame, truth: DataFrame, manifest: DataFrame, frame: list[str], label: str, min_iou: float,
                     by: list[str]) -> DataFrame:
    """AGG-19: true and false positives, misses, ignored predictions, precision, recall and false positives
    per frame by ``by`` and overall (``rollup``); frames without predictions stay in the denominator.

    ``pred``: frame, label, pred_id, score, x1..y2; ``truth``: frame, label, truth_id, x1..y2, ignored. A
    prediction takes the best free truth in score order, so pairs sort by (-score, -iou).
    """
    from fieldtrace.operators.matching import greedy_match

    box = tuple(F.col(c) for c in ("x1", "y1", "x2", "y2"))
    rbox = tuple(F.col("r_" + c) for c in ("x1", "y1", "x2", "y2"))
    t = truth.select(*frame, label, "truth_id", "ignored", *[F.col(c).alias(f"r_{c}") for c in ("x1", "y1", "x2", "y2")])
    pairs = pred.join(t, [*frame, label]).withColumn("_iou", G.iou(box, rbox)).filter(F.col("_iou") >= min_iou)
    real = pairs.filter(~F.col("ignored")).select(*frame, label, "pred_id", "truth_id", (-F.col("score")).alias("_o1"), F.col("pred_id").alias("_o2"), (-F.col("_iou")).alias("_o3"))
    matched = greedy_match(real, [*frame, label], "pred_id", "truth_id", ["_o1", "_o2", "_o3"])
    hit = matched.select(*frame, label, "pred_id").withColumn("_tp", F.lit(1))
    over = pairs.filter("ignored").select(*frame, label, "pred_id").distinct().withColumn("_ig", F.lit(1))
    p = pred.select(*frame, label, "pred_id").join(hit, [*frame, label, "pred_id"], "left").join(over, [*frame, label, "pred_id"], "left")
    tp = F.col("_tp").isNotNull()
    p = p.groupBy(*frame, label).agg(F.count_if(tp).alias("tp"), F.count_if(~tp & F.col("_ig").isNotNull()).alias("ignored"), F.count_if(~tp & F.col("_ig").isNull()).alias("fp"))
    n = truth.filter(~F.col("ignored")).groupBy(*frame, label).agg(F.count(F.lit(1)).alias("truths"))
    d = p.join(n, [*frame, label], "full_outer").fillna(0, ["tp", "fp", "ignored", "truths"])
    d = d.join(manifest.select(*frame).distinct(), frame, "left_semi")
    g = d.rollup(label, *by).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("ignored").alias("ignored"), (F.sum("truths") - F.sum("tp")).alias("fn"))
    # frames are counted on the manifest, so a frame without any row still counts
    spine = manifest.select(*frame).distinct().rollup(*by).agg(F.count(F.lit(1)).alias("frames"))
    cond = F.lit(True)
    for c in by:
        spine = spine.withColumnRenamed(c, f"_m_{c}")
        cond = cond & F.col(c).eqNullSafe(F.col(f"_m_{c}"))
    g = g.join(spine, cond)
    return g.select(label, *by, "frames", "tp", "fp", "fn", "ignored", F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"),
                    F.try_divide("fp", "frames").alias("fp_per_frame"))


def tracking_scores(truth: DataFrame, pred: DataFrame, seq: list[str], frame: str, alphas: list[float]) -> DataFrame:
    """AGG-21: detection and association accuracy, their geometric mean (HOTA), localisation, and the identity
    scores (IDF1, precision and recall with their counts).

    ``truth``: seq, frame, gt, x1..y2; ``pred``: seq, frame, tr, x1..y2. Frames are matched one to one by
    global association plus overlap; association is then sums over (gt, tr) counts. The identity score
    needs the best assignment of a sequence's tracks: each group of tracks that met is solved alone.
    ``hota_by_iou`` lists HOTA at each overlap, in order.
    """
    from fieldtrace.operators.matching import optimal_match, sparse_match

    box = tuple(F.col(c) for c in ("x1", "y1", "x2", "y2"))
    rbox = tuple(F.col("r_" + c) for c in ("x1", "y1", "x2", "y2"))
    r = pred.select(*seq, frame, "tr", *[F.col(c).alias(f"r_{c}") for c in ("x1", "y1", "x2", "y2")])
    pairs = truth.join(r, [*seq, frame]).withColumn("iou", G.iou(box, rbox)).filter("iou > 0").select(*seq, frame, "gt", "tr", "iou")
    gt_n = truth.groupBy(*seq, "gt").agg(F.count(F.lit(1)).alias("n_gt"))
    tr_n = pred.groupBy(*seq, "tr").agg(F.count(F.lit(1)).alias("n_tr"))
    # share of the possible overlap of the pair in each frame, summed over frames
    rs = pairs.groupBy(*seq, frame, "gt").agg(F.sum("iou").alias("_sg"))
    cs = pairs.groupBy(*seq, frame, "tr").agg(F.sum("iou").alias("_st"))
    soft = pairs.join(rs, [*seq, frame, "gt"]).join(cs, [*seq, frame, "tr"])
    soft = soft.groupBy(*seq, "gt", "tr").agg(F.sum(F.col("iou") / (F.col("_sg") + F.col("_st") - F.col("iou"))).alias("_p"))
    align = soft.join(gt_n, [*seq, "gt"]).join(tr_n, [*seq, "tr"]).select(*seq, "gt", "tr", (F.col("_p") / (F.col("n_gt") + F.col("n_tr") - F.col("_p"))).alias("_a"))
    scored = pairs.join(align, [*seq, "gt", "tr"]).withColumn("score", F.col("_a") * F.col("iou"))
    named = F.explode(F.array(*[F.lit(float(a)) for a in alphas])).alias("alpha")
    total = truth.groupBy(*seq).agg(F.count(F.lit(1)).alias("n_truth")).join(pred.groupBy(*seq).agg(F.count(F.lit(1)).alias("n_pred")), seq, "full_outer").fillna(0, ["n_truth", "n_pred"])
    m = optimal_match(scored, [*seq, frame], "gt", "tr", "score", "total").join(pairs, [*seq, frame, "gt", "tr"])
    m = m.select("*", named).filter(F.col("iou") >= F.col("alpha") - 1e-9)
    tpa = m.groupBy(*seq, "alpha", "gt", "tr").agg(F.count(F.lit(1)).alias("c"), F.sum("iou").alias("loc"))
    tpa = tpa.join(gt_n, [*seq, "gt"]).join(tr_n, [*seq, "tr"])
    per = tpa.groupBy(*seq, "alpha").agg(F.sum("c").alias("tp"), F.sum(F.col("c") * F.col("c") / (F.col("n_gt") + F.col("n_tr") - F.col("c"))).alias("_as"), F.sum("loc").alias("_loc"))
    d = total.select("*", named).join(per, [*seq, "alpha"], "left").fillna(0.0, ["_as", "_loc"]).fillna(0, ["tp"])
    det = F.col("tp") / (F.col("n_truth") + F.col("n_pred") - F.col("tp"))
    ass = F.coalesce(F.try_divide("_as", "tp"), F.lit(0.0))
    h = d.groupBy(*seq).agg(F.avg(F.sqrt(det * ass)).alias("hota"), F.avg(det).alias("det_a"), F.avg(ass).alias("ass_a"), F.avg(F.coalesce(F.try_divide("_loc", "tp"), F.lit(1.0))).alias("loc_a"),
                            F.transform(F.array_sort(F.collect_list(F.struct("alpha", F.sqrt(det * ass).alias("v")))), lambda x: x["v"]).alias("hota_by_iou"))  # one value per overlap
    ident = pairs.filter("iou >= 0.5").groupBy(*seq, "gt", "tr").agg(F.count(F.lit(1)).alias("hits"))
    idtp = sparse_match(ident, seq, "gt", "tr", "hits").join(ident, [*seq, "gt", "tr"]).groupBy(*seq).agg(F.sum("hits").alias("idtp"))
    out = h.join(total, seq).join(idtp, seq, "left").fillna(0, ["idtp"])
    hits, truths, preds = F.col("idtp"), F.col("n_truth"), F.col("n_pred")
    return out.select(*seq, "hota", "det_a", "ass_a", "loc_a", "hota_by_iou", F.try_divide(F.lit(2.0) * hits, truths + preds).alias("idf1"), F.try_divide(hits, preds).alias("idp"),
                      F.try_divide(hits, truths).alias("idr"), "idtp", (preds - hits).alias("idfp"), (truths - hits).alias("idfn"))


def reviewed_tracking(truth: DataFrame, pred: DataFrame, reviewed: DataFrame, seq: list[str], frame: str, label: str, alphas: list[float]) -> DataFrame:
    """AGG-21: :func:`tracking_scores` per sequence and class, on the frames that a reviewer declared complete for the class.

    ``reviewed``: seq, frame, label, exhaustive. Predictions elsewhere are not judged; truth outside the coverage, a
    coverage that is not exhaustive, an identity twice in a frame and a box without a positive area are errors. A class
    with coverage and no box at all is there with zeros.
    """
    from fieldtrace.operators.quality import duplicate_keys

    key = [*seq, frame, label]
    stop = lambda cond, what: F.when(cond, F.raise_error(F.lit(what))).otherwise(F.lit(True)).cast("boolean")
    cover = reviewed.filter(stop(~F.coalesce("exhaustive", F.lit(False)), "evaluation requires exhaustive annotation")).select(*key).distinct()
    sane = lambda d: d.filter(stop(~F.coalesce((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")), F.lit(False)), "boxes need a positive width and height"))
    marked = sane(truth).join(cover.withColumn("_in", F.lit(1)), key, "left")
    inside = marked.filter(stop(F.col("_in").isNull(), "ground truth outside reviewed coverage")).drop("_in")
    scope = sane(pred).join(cover, key, "left_semi")
    for d, who in ((inside, "gt"), (scope, "tr")):
        if not duplicate_keys(d, [*key, who]).isEmpty():
            raise ValueError("duplicate identity in one frame")
    group = [*seq, label]
    n = cover.groupBy(*group).agg(F.count("*").alias("frames"))
    boxes = lambda d, name: d.groupBy(*group).agg(F.count("*").alias(name))
    d = n.join(boxes(inside, "truth_boxes"), group, "left").join(boxes(scope, "pred_boxes"), group, "left").fillna(0, ["truth_boxes", "pred_boxes"])
    s = tracking_scores(inside, scope, group, frame, alphas)
    zero = [c for c in s.columns if c not in (*group, "hota_by_iou")]
    return d.join(s, group, "left").fillna(0, zero)


def staged_census(df: DataFrame, by: list[str], rules: list[tuple[str, Column]], otherwise: str = "unattributed") -> DataFrame:
    """AGG-28: each row counts under the first rule that holds."""
    c = None
    for name, cond in rules:
        c = F.when(cond, name) if c is None else c.when(cond, name)
    return df.groupBy(*by, c.otherwise(otherwise).alias("rule")).agg(F.count(F.lit(1)).alias("n"))


def compare_runs(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """AGG-30: per line, both runs and their difference; a line missing on one side counts as zero."""
    x = a.select(*keys, *[F.col(v).alias(f"{v}_a") for v in values])
    y = b.select(*keys, *[F.col(v).alias(f"{v}_b") for v in values])
    d = x.join(y, keys, "full_outer").fillna(0)
    return d.select(*keys, *[c for v in values for c in (F.col(f"{v}_a"), F.col(f"{v}_b"), (F.col(f"{v}_b") - F.col(f"{v}_a")).alias(f"{v}_delta"))])


def label_consistency(df: DataFrame, keys: list[str], label: str, ident: str) -> DataFrame:
    """AGG-32: label groups that keep one id, and the share of rows on the group's most frequent id."""
    n = df.groupBy(*keys, label, ident).agg(F.count(F.lit(1)).alias("_n"))
    g = n.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("ids"), F.max("_n").alias("_top"), F.sum("_n").alias("_all"))
    return g.groupBy(*keys).agg(F.count(F.lit(1)).alias("labels"), F.count_if(F.col("ids") == 1).alias("consistent"), (F.sum("_top") / F.sum("_all")).alias("top_share"))


def greedy_naming(df: DataFrame, keys: list[str], label: str, ident: str) -> DataFrame:
    """AGG-32: ids named by labels one to one, most shared rows first; accuracy after naming."""
    from fieldtrace.operators.matching import greedy_match
    n = df.groupBy(*keys, label, ident).agg(F.count(F.lit(1)).alias("n")).withColumn("_o", -F.col("n"))
    m = greedy_match(n, keys, label, ident, ["_o"])
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    hit = m.groupBy(*keys).agg(F.sum("n").alias("hits"), F.count(F.lit(1)).alias("named"))
    return total.join(hit, keys).withColumn("accuracy", F.col("hits") / F.col("rows"))


def colour_collisions(df: DataFrame, frame: list[str], ident: str, colours: int) -> DataFrame:
    """AGG-34: rows of a frame that share a display colour (id modulo ``colours``) with another row."""
    per = df.groupBy(*frame, (F.col(ident) % colours).alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    return per.groupBy(*frame).agg(F.sum("_n").alias("boxes"), F.sum(F.when(F.col("_n") > 1, F.col("_n")).otherwise(0)).alias("colliding"))


def id_flips(df: DataFrame, chain: list[str], order: list[str], ident: str, hot_rows: int | None = None) -> DataFrame:
    """AGG-34: id changes along each physical chain."""
    d = scan(df, chain, order, {"_p": prev(F.col(ident))}, hot_rows)
    return d.groupBy(*chain).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_p") != F.col(ident)).alias("flips"), F.count_distinct(ident).alias("ids"))


def outage_verdicts(anchors: DataFrame, rows: dict[str, DataFrame], keys: list[str], anchor_id: str, t: str, row_t: str, reach: int) -> DataFrame:
    """AGG-36: channel counts around each anchor and the verdict: outage (all silent), partial, or live."""
    from fieldtrace.operators.interval import span_pairs
    union = None
    for name, d in rows.items():
        part = d.select(*keys, F.col(row_t).alias("_rt"), F.lit(name).alias("_ch"))
        union = part if union is None else union.unionByName(part)
    spans = anchors.select(*keys, anchor_id, (F.col(t) - reach).alias("_lo"), (F.col(t) + reach).alias("_hi"))
    width = 2 * reach + 1
    p = span_pairs(union, spans, keys, "_rt", "_lo", "_hi", width, max_length=width)
    n = p.groupBy(anchor_id).agg(*[F.count_if(F.col("_ch") == c).alias(c) for c in rows])
    d = anchors.join(n, anchor_id, "left").fillna(0, list(rows))
    live = sum((F.when(F.col(c) > 0, 1).otherwise(0) for c in list(rows)[1:]), F.when(F.col(list(rows)[0]) > 0, 1).otherwise(0))
    return d.withColumn("verdict", F.when(live == 0, "outage").when(live < len(rows), "partial").otherwise("live"))


def source_mix(df: DataFrame, keys: list[str], order: list[str], source: str, filled: str, hot_rows: int | None = None) -> DataFrame:
    """AGG-37: rows per source kind and the longest run of filled rows of each key."""
    from fieldtrace.operators.islands import island_ids
    d = island_ids(df, keys, order, F.col(source) == filled, None, "_r", hot_rows)
    runs = d.groupBy(*keys, "_r").agg(F.first(F.col(source) == filled).alias("_f"), F.count(F.lit(1)).alias("_n"))
    return runs.groupBy(*keys).agg(F.sum("_n").alias("rows"), F.sum(F.when(F.col("_f"), F.col("_n")).otherwise(0)).alias("filled_rows"),
                                   F.coalesce(F.max(F.when(F.col("_f"), F.col("_n"))), F.lit(0)).alias("longest_filled"))


def keypoint_rates(df: DataFrame, by: list[str], points: str, inside: Column) -> DataFrame:
    """AGG-38: per keypoint position, mean confidence and share of points satisfying ``inside`` (columns
    kp.x, kp.y, kp.c)."""
    d = df.select("*", F.posexplode(points).alias("keypoint", "kp"))
    return d.groupBy(*by, "keypoint").agg(F.count(F.lit(1)).alias("n"), exact_mean(F.col("kp.c")).alias("mean_conf"), (F.count_if(inside) / F.count(F.lit(1))).alias("inside_share"))


def accuracy_at(df: DataFrame, by: list[str], conf: str, correct: Column, thresholds: list[float]) -> DataFrame:
    """AGG-40: coverage and accuracy of the rows at or above each threshold."""
    d = df.select("*", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    on = F.col(conf) >= F.col("threshold")
    return d.groupBy(*by, "threshold").agg((F.count_if(on) / F.count(F.lit(1))).alias("coverage"), F.try_divide(F.count_if(on & correct), F.count_if(on)).alias("accuracy"))


def recovery_latency(swaps: DataFrame, hits: DataFrame, keys: list[str], swap_id: str, t: str, hit_t: str, cap: int) -> DataFrame:
    """AGG-40: time from a swap to the first correct row, at most ``cap``."""
    from fieldtrace.operators.asof import asof_join
    d = asof_join(swaps, hits, keys, t, hit_t, {"_h": hit_t}, "forward")
    return d.select(*keys, swap_id, F.least(F.coalesce(F.col("_h") - F.col(t), F.lit(cap)), F.lit(cap)).alias("latency"))


def tracker_diagnostics(df: DataFrame, keys: list[str], track: str) -> DataFrame:
    """AGG-46: tracks, tracks of one row, and the median length."""
    n = df.groupBy(*keys, track).agg(F.count(F.lit(1)).alias("_len"))
    med = quantiles(n, keys, "_len", {"median_length": (0.5, "linear")}).drop("n")
    return n.groupBy(*keys).agg(F.count(F.lit(1)).alias("tracklets"), F.count_if(F.col("_len") == 1).alias("singletons")).join(med, keys)


def retrieval_scores(reads: DataFrame, query: list[str], order: list[Column], read: str, truth: str) -> DataFrame:
    """AGG-50: per query: truth anywhere, first non-null read right, and whether anything was read."""
    first = top_k(reads.filter(F.col(read).isNotNull()), query, order, 1, "_r").select(*query, (F.col(read) == F.col(truth)).alias("_first"))
    g = reads.groupBy(*query).agg(F.coalesce(F.max(F.col(read) == F.col(truth)), F.lit(False)).alias("_any"))
    d = g.join(first, query, "left")
    return d.agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("_any")).alias("found"), F.count_if(F.coalesce("_first", F.lit(False))).alias("top1"), F.count("_first").alias("attempted"))


def rank_candidates(df: DataFrame, anchor: list[str], k: int, match: str, launch: str, proximity: str, read_conf: str, tie: str) -> DataFrame:
    """ORD-05: team mismatches last, known launch distance first, then distance (else proximity), then the
    more confident read."""
    far = F.col(match).isNotNull() & ~F.col(match)
    order = [far.cast("int"), F.col(launch).isNull().cast("int"), F.coalesce(F.col(launch), F.col(proximity)), -F.coalesce(F.col(read_conf), F.lit(0.0)), F.col(tie)]
    return top_k(df, anchor, order, k)


def label_consensus(df: DataFrame, keys: list[str], order: list[str], frame: str, label: str, min_frames: int = 2, hot_rows: int | None = None) -> DataFrame:
    """WIN-37: causal consensus at each reading: conflict once two labels have ever been seen, supported
    after ``min_frames`` distinct frames, else provisional. First readings of a frame carry the count."""
    from fieldtrace.operators.ordered import running_max, running_min, running_sum
    d = scan(df, [*keys, frame], order, {"_q": prev(F.col(label))}, hot_rows)
    d = d.withColumn("_new", F.col("_q").isNull().cast("int"))
    d = scan(d, keys, order, {"_lo": running_min(F.col(label)), "_hi": running_max(F.col(label)), "_n": running_sum(F.col("_new"))}, hot_rows)
    status = F.when(F.col("_lo") != F.col("_hi"), "conflict").when(F.col("_n") >= min_frames, "supported").otherwise("provisional")
    return d.select(*df.columns, F.col("_n").alias("frames"), status.alias("status"))


def quadratic_flight(df: DataFrame, keys: list[str], t: str, y: str, w: str, rounds: int, gate: float, min_inliers: int) -> DataFrame:
    """WIN-45: weighted least-squares parabola with inlier rounds, from normal-equation sums per key.

    Each round is an aggregate of moments and a join back, so a key never has to fit a task.
    """
    d = df.withColumn("_in", F.lit(True))
    fit = None
    for i in range(rounds):
        ww = F.when(F.col("_in"), F.col(w).cast("double"))
        u, v = F.col(t).cast("double"), F.col(y).cast("double")
        m = lambda c: F.sum((ww * c).cast(T.DecimalType(38, 9))).cast("double")
        g = d.groupBy(*keys).agg(F.count_if(F.col("_in")).alias("inliers"), *[m(c).alias(n) for n, c in (
            ("s0", F.lit(1.0)), ("s1", u), ("s2", u * u), ("s3", u * u * u), ("s4", u * u * u * u), ("y0", v), ("y1", u * v), ("y2", u * u * v))])
        c = F.col
        det = c("s4") * (c("s2") * c("s0") - c("s1") * c("s1")) - c("s3") * (c("s3") * c("s0") - c("s1") * c("s2")) + c("s2") * (c("s3") * c("s1") - c("s2") * c("s2"))
        a = c("y2") * (c("s2") * c("s0") - c("s1") * c("s1")) - c("s3") * (c("y1") * c("s0") - c("s1") * c("y0")) + c("s2") * (c("y1") * c("s1") - c("s2") * c("y0"))
        b = c("s4") * (c("y1") * c("s0") - c("y0") * c("s1")) - c("y2") * (c("s3") * c("s0") - c("s1") * c("s2")) + c("s2") * (c("s3") * c("y0") - c("y1") * c("s2"))
        k = c("s4") * (c("s2") * c("y0") - c("s1") * c("y1")) - c("s3") * (c("s3") * c("y0") - c("y1") * c("s2")) + c("y2") * (c("s3") * c("s1") - c("s2") * c("s2"))
        ok = (c("inliers") >= 3) & (F.abs(det) > 1e-9)
        fit = g.select(*keys, "inliers", *[F.when(ok, x / det).alias(n) for n, x in (("a", a), ("b", b), ("c", k))])
        if i < rounds - 1:
            base = d.drop("_in", "a", "b", "c", "inliers").join(fit, keys)
            res = F.abs(v - (F.col("a") * u * u + F.col("b") * u + F.col("c")))
            d = base.withColumn("_in", F.coalesce(res <= gate, F.lit(False)))
    return fit.filter(F.col("inliers") >= min_inliers)


def _parabola(m, r0: str, r1: str, r2: str):
    """Constant, slope and curvature from normal-equation sums (s0..s4 and the three right-hand sides)."""
    s0, s1, s2, s3, s4, y0, y1, y2 = (F.col(c) for c in ("s0", "s1", "s2", "s3", "s4", r0, r1, r2))
    det3 = lambda a, b, c: a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0])
    det = det3((s0, s1, s2), (s1, s2, s3), (s2, s3, s4))
    parts = (det3((y0, s1, s2), (y1, s2, s3), (y2, s3, s4)), det3((s0, y0, s2), (s1, y1, s3), (s2, y2, s4)), det3((s0, s1, y0), (s1, s2, y1), (s2, s3, y2)))
    return [F.try_divide(p, F.when(F.abs(det) > 1e-15, det)).alias(f"{m}{k}") for k, p in enumerate(parts)]


def best_flights(peaks: DataFrame, keys: list[str], near: Column, gate: float = 1.5, min_inliers: int = 6, span_min: float = 0.4, lookback: float = 1.6, end_max: float = 2.0, tries: int = 8) -> DataFrame:
    """WIN-45: the flight of each key into the rim, from ``peaks`` (keys, t, x, y, score) in rim-relative feet.

    Each of the first ``tries`` peaks near the rim is an arrival; the peaks up to ``lookback`` before it are fitted by
    x and y quadratic in time, where scores weigh both sides of the equations (so squares enter the sums). Three rounds
    drop peaks farther than ``gate`` from the curve. A fit needs enough inliers, span and an end near the rim; the one
    with the largest total score stays. All rounds are sums per (key, arrival): no key has to fit a task.
    """
    rows = peaks.select(*keys, "t", "x", "y", "score")
    arrivals = top_k(peaks.filter(near).select(*keys, F.col("t").alias("t_arr")), keys, [F.col("t_arr")], tries, "_rank").drop("_rank").distinct()
    d = rows.join(arrivals, keys).withColumn("u", F.col("t") - F.col("t_arr")).filter((F.col("u") <= 0.05) & (F.col("u") >= -lookback)).withColumn("_in", F.lit(True))
    by = [*keys, "t_arr"]
    u, w = F.col("u"), F.when(F.col("_in"), F.col("score") * F.col("score"))
    total = lambda c: F.sum((w * c).cast(T.DecimalType(38, 18))).cast("double")
    for _ in range(3):
        power = [F.lit(1.0), u, u * u, u * u * u, u * u * u * u]
        g = d.groupBy(*by).agg(F.count_if("_in").alias("_n"), *[total(p).alias(f"s{k}") for k, p in enumerate(power)],
                               *[total(power[k] * F.col(v)).alias(f"{v}{k}") for v in ("x", "y") for k in range(3)])
        fit = g.filter(F.col("_n") >= min_inliers).select(*by, *_parabola("cx", "x0", "x1", "x2"), *_parabola("cy", "y0", "y1", "y2"))
        d = d.select(*by, "t", "x", "y", "score", "u").join(fit, by)
        at = lambda c: F.col(f"{c}0") + F.col(f"{c}1") * u + F.col(f"{c}2") * u * u
        d = d.withColumn("_in", F.coalesce(F.hypot(at("cx") - F.col("x"), at("cy") - F.col("y")) <= gate, F.lit(False)))
    curve = [f"c{v}{k}" for v in "xy" for k in range(3)]
    g = d.filter("_in").groupBy(*by, *curve).agg(F.count(F.lit(1)).alias("n_inliers"), F.min("t").alias("t_launch"), (F.max("t") - F.min("t")).alias("span"), F.sum(F.col("score").cast(T.DecimalType(38, 18))).cast("double").alias("energy"))
    g = g.filter((F.col("n_inliers") >= min_inliers) & (F.col("span") >= span_min) & (F.hypot("cx0", "cy0") <= end_max))
    dt = F.col("t_launch") - F.col("t_arr")
    launch = [(F.col(f"{c}0") + F.col(f"{c}1") * dt + F.col(f"{c}2") * dt * dt).alias(f"launch_{c[1]}") for c in ("cx", "cy")]
    return top_k(g.select(*by, "t_launch", "n_inliers", "span", "energy", *launch), keys, [F.desc("energy"), F.col("t_arr")], 1, "_rank").drop("_rank")


def verdicts(traces: DataFrame, key: str, judge, out: str) -> DataFrame:
    """UDF-01: apply a caller's function (pandas frame in, frame of ``out`` out) to each batch of traces.

    Call it on cache misses only; it sees a batch, never the whole table.
    """
    def run(batches):
        for pdf in batches:
            yield judge(pdf)

    return traces.mapInPandas(run, f"{key} {traces.schema[key].dataType.simpleString()}, {out}")


def run_specialist(fn, inputs: dict[str, DataFrame], required: list[str], schema: T.StructType) -> DataFrame:
    """UDF-02: a table specialist ``dict of DataFrames -> DataFrame`` with a declared output.

    A missing required input is an error; an optional one is simply absent from the dict.
    """
    missing = [n for n in required if n not in inputs]
    if missing:
        raise KeyError(f"specialist needs {missing}")
    out = fn(inputs)
    have = {f.name: f.dataType for f in out.schema.fields}
    want = {f.name: f.dataType for f in schema.fields}
    if have != want:
        raise TypeError(f"specialist returned {have}, declared {want}")
    return out


def sweep(rows: DataFrame, variants: list[str], done: DataFrame, keys: list[str], fit, out: str) -> DataFrame:
    """UDF-03: (row, variant) jobs not done yet, each batch through the caller's function."""
    jobs = rows.withColumn("variant", F.explode(F.array(*[F.lit(v) for v in variants])))
    todo = jobs.join(done.select(*keys, "variant").distinct(), [*keys, "variant"], "left_anti")

    def run(batches):
        for pdf in batches:
            yield fit(pdf)

    return todo.mapInPandas(run, out)


def register_expand(spark, name: str = "expand_span") -> None:
    """UDF-04: SQL table function ``expand_span(start, end, step)``; ``explode(sequence(...))`` is the
    built-in form to prefer."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="t: bigint, share: double")
    class Expand:
        def eval(self, start: int, end: int, step: int):
            for t in range(start, end, step):
                yield t, (t - start) / (end - start)

    spark.udtf.register(name, Expand)
