"""The paths for hot keys give the same rows as the plain ones."""

from pyspark.sql import functions as F

from conftest import rows
from fieldtrace.operators import asof, folds, frames, interval, islands, matching, metrics
from fieldtrace.operators import ordered as o
from fieldtrace.plans import queries_pairs
from fieldtrace.plans.registry import DAY, HOUR

HOT = 80


def hot_events(tables):
    """Two thirds of the events on one key, some values null."""
    return tables.ev.select(
        F.when(F.col("event_id") % 3 < 2, 0).otherwise(F.col("user_id")).alias("key"), "us", "event_id", "event_type", "k",
        F.when(F.col("k") % 4 == 0, F.col("cents")).alias("v"))


def test_every_scan_kind(tables):
    d = hot_events(tables)
    ops = {
        "p": o.prev(F.col("v")), "n": o.next_(F.col("v")), "f": o.fill_forward(F.col("v")), "fx": o.fill_forward(F.col("v"), False),
        "b": o.fill_back(F.col("v")), "bx": o.fill_back(F.col("v"), False), "s": o.running_sum(F.col("v")), "sx": o.running_sum(F.col("v"), False), "rs": o.remaining_sum(F.col("v")),
        "m": o.running_max(F.col("v")), "mx": o.running_max(F.col("v"), False), "mi": o.running_min(F.col("v")), "r": o.row_number(),
    }
    plain = o.scan(d, ["key"], ["us"], ops)
    sliced = o.scan(d, ["key"], ["us"], ops, hot_rows=HOT)
    assert o.with_slices(d, ["key"], "us", HOT).select("_slice").distinct().count() > 4
    assert rows(plain.select(*plain.columns)) == rows(sliced.select(*plain.columns))


def test_slices_are_even_whatever_the_clock(spark):
    """One far clock, and a key whose rows all share one clock."""
    far = spark.range(2000).select(F.lit(0).alias("key"), F.when(F.col("id") == 7, F.lit(10**15)).otherwise(F.col("id")).alias("us"), F.col("id").alias("seq"))
    tied = spark.range(2000).select(F.lit(1).alias("key"), F.lit(5).alias("us"), F.col("id").alias("seq"))
    got = o.with_slices(far.unionByName(tied), ["key"], ["us", "seq"], 200).groupBy("key", "_slice").count().collect()
    assert {r["key"] for r in got} == {0, 1}
    for key in (0, 1):
        sizes = [r["count"] for r in got if r["key"] == key]
        assert len(sizes) >= 8 and max(sizes) <= 500


def test_scans_upon_scans_stay_small(spark):
    """The plan after several scans of a hot key does not repeat the ones before."""
    d = spark.range(3000).select(F.lit(0).alias("key"), F.col("id").alias("us"), (F.col("id") % 7).alias("v"))
    for i in range(3):
        d = o.scan(d, ["key"], ["us"], {f"s{i}": o.running_sum(F.col("v"))}, hot_rows=300)
    assert d._jdf.queryExecution().optimizedPlan().collectLeaves().size() <= 4
    assert d.orderBy(F.desc("us")).first()["s2"] == sum(i % 7 for i in range(3000))


def test_operators_on_a_hot_key(tables):
    d = hot_events(tables)
    left = d.filter("event_type = 'purchase'").select("key", "us", "event_id")
    right = d.filter("event_type = 'click'").select("key", "us", F.col("event_id").alias("rid"))
    for h in ("backward", "forward"):
        a = asof.asof_join(left, right, ["key"], "us", "us", {"rid": "rid"}, h, DAY)
        b = asof.asof_join(left, right, ["key"], "us", "us", {"rid": "rid"}, h, DAY, hot_rows=HOT)
        assert rows(a) == rows(b)
    assert rows(islands.label_runs(d, ["key"], ["us"], "event_type", DAY)) == rows(islands.label_runs(d, ["key"], ["us"], "event_type", DAY, hot_rows=HOT))
    assert rows(frames.densest_window(d, ["key"], "us", DAY)) == rows(frames.densest_window(d, ["key"], "us", DAY, HOT))
    q = {"a": (0.5, "linear"), "b": (0.9, "higher")}
    assert rows(metrics.quantiles(d, ["key"], "v", q)) == rows(metrics.quantiles(d, ["key"], "v", q, HOT))
    agg = {"n": F.count(F.lit(1)), "m": F.max("v")}
    for lo, hi in ((-DAY, DAY), (1, 2 * DAY), (-DAY, -1)):
        assert rows(frames.range_frame(d, ["key"], "us", lo, hi, agg, split=False)) == rows(frames.range_frame(d, ["key"], "us", lo, hi, agg, split=True))
    assert rows(frames.rows_frame(d, ["key"], ["us"], -2, 3, agg)) == rows(frames.rows_frame(d, ["key"], ["us"], -2, 3, agg, split=True, hot_rows=HOT))


def test_folds_on_a_hot_key(tables):
    d = hot_events(tables)
    assert rows(folds.min_gap_sample(d, ["key"], ["us"], 3 * HOUR)) == rows(folds.min_gap_sample(d, ["key"], ["us"], 3 * HOUR, hot_rows=HOT))
    r = d.select("key", F.col("us").alias("t0"), (F.col("us") + F.col("k") * 10**8).alias("t1"), F.when(F.col("k") % 3 > 0, F.col("k") % 2).alias("team"))
    assert rows(folds.team_runs(r, ["key"], HOUR)) == rows(folds.team_runs(r, ["key"], HOUR, hot_rows=HOT))
    c = d.select("key", (F.col("us") / HOUR).alias("t"), F.col("k").cast("double").alias("x"), F.lit(0.0).alias("y"), F.col("event_id").alias("id"))
    assert rows(folds.chain_candidates(c, ["key"], 2.0, 30.0)) == rows(folds.chain_candidates(c, ["key"], 2.0, 30.0, hot_rows=HOT))
    s = d.select("key", F.col("us").alias("t"), (F.col("k") % 9).alias("before"), (F.col("k") % 9 + F.col("k") % 5).alias("after"))
    assert rows(folds.score_steps(s, ["key"])) == rows(folds.score_steps(s, ["key"], hot_rows=HOT))


def test_greedy_rounds_equal_the_fold(tables):
    pairs = queries_pairs.match_candidates(tables)
    assert pairs.count() > 50
    a = matching.greedy_match(pairs, ["user_id"], "l", "r", ["gap"])
    b = matching.greedy_match(pairs, ["user_id"], "l", "r", ["gap"], max_pairs=2)
    assert rows(a) == rows(b.select(*a.columns))


def test_levels_keep_long_and_short_spans(spark):
    spans = spark.createDataFrame([(1, 0, 10_000_000, 1), (1, 5, 6, 2), (1, 900, 2_000, 3), (2, 0, 5, 4)], "p int, s long, e long, sid int")
    pts = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (1, 2_000, 3), (1, 9_999_999, 4), (2, 6, 5), (1, 10_000_001, 6)], "p int, t long, pid int")
    got = interval.span_pairs(pts, spans, ["p"], "t", "s", "e", 8).select("pid", "sid")
    assert rows(got) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 3), (4, 1)]
