"""Token streams and fixed-grid features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldtrace.operators.grid import dense_spine
from fieldtrace.operators.islands import carry_forward
from fieldtrace.operators.metrics import exact_sum
from fieldtrace.operators.ordered import fill_forward, next_, prev, row_number, scan, top_k

# Fixed order of the channels at one instant.
PRIORITY = {"clock": 0, "cut": 1, "score_delta": 2, "rim": 3, "player": 4, "ball": 5, "ball_control": 6, "jersey_read": 7,
            "name_call": 8, "pbp_anchor": 9}
TARGET_ONLY = ("pbp_anchor",)
LENGTH, WIDTH = 94.0, 50.0


def channel_priority(channel: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in PRIORITY.items() for v in kv]), channel), F.lit(99))


def token_stream(channels: dict[str, DataFrame | None], key: str, t: str = "t_ms", tie: str = "seq",
                 hot_rows: int | None = None) -> DataFrame:
    """ORD-01: union of the channels that exist in one total order (clock, channel, entity, source row)
    with a dense index per game. Each channel has (key, t, tie) and any token columns."""
    present = {n: d for n, d in channels.items() if d is not None}
    if not present:
        raise ValueError("a token stream needs at least one channel")
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.withColumn("channel", F.lit(n)) for n, d in present.items()])
    if "entity_id" not in union.columns:
        union = union.withColumn("entity_id", F.lit(None).cast("bigint"))
    union = union.withColumn("_pri", channel_priority(F.col("channel"))).withColumn("_ent", F.coalesce(F.col("entity_id").cast("bigint"), F.lit(-1)))
    d = scan(union, [key], [t, "_pri", "_ent", tie], {"token_idx": row_number()}, hot_rows)
    return d.withColumn("token_idx", F.col("token_idx") - 1).drop("_pri", "_ent")


def stream_meta(tokens: DataFrame, key: str) -> DataFrame:
    """SRC-19: tokens per channel, total, and the sorted channels of each game."""
    n = tokens.groupBy(key, "channel").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(key).agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("channel", "n"))).alias("channels"))


def cut_tokens(reads: DataFrame, key: str, t: str, gap: int, hot_rows: int | None = None) -> DataFrame:
    """A cut at the end of each pause between confident clock reads longer than ``gap``."""
    d = scan(reads, [key], [t], {"_p": prev(F.col(t))}, hot_rows)
    return d.filter(F.col(t) - F.col("_p") > gap).select(key, t, (F.col(t) - F.col("_p")).alias("value"))


def _mean(c: Column) -> Column:
    return exact_sum(c) / F.count(c)


def _std(c: Column) -> Column:
    m = _mean(c)
    return F.sqrt(F.greatest(exact_sum(c * c) / F.count(c) - m * m, F.lit(0.0)))


def game_grid(tokens: DataFrame, key: str, bin_ms: int, channels: list[str] | None = None, hot_rows: int | None = None) -> DataFrame:
    """WIN-15: one row of 36 features per (game, bin); bins span every observation channel, and the
    target-only channel never enters. The last token of a bin wins; counts saturate.

    Tokens need game, t_ms, token_idx, channel, entity_id, team_cluster, court_x, court_y, value, text,
    conf and period.
    """
    obs = tokens.filter(~F.col("channel").isin(*TARGET_ONLY)).withColumn("bin", F.floor(F.col("t_ms") / F.lit(bin_ms)))
    spine = dense_spine(obs, [key], "bin")
    used = obs if channels is None else obs.filter(F.col("channel").isin(*channels))
    ch, idx = F.col("channel"), F.col("token_idx")
    x, y, conf = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("court_x", "court_y", "conf"))
    value = F.coalesce(F.col("value").cast("double"), F.lit(0.0))

    def last(c: Column, name: str) -> Column:
        return F.max_by(c, F.when(ch == name, idx))

    def n(name: str) -> Column:
        return F.count_if(ch == name)

    is_p = ch == "player"
    team = F.coalesce(F.col("team_cluster").cast("int"), F.lit(-1))
    cells = [
        n("clock").alias("n_clock"), last(value, "clock").alias("clock"), last(F.coalesce(F.col("period").cast("double"), F.lit(0.0)), "clock").alias("period"),
        last(conf, "clock").alias("clock_conf"), n("cut").alias("n_cut"), n("score_delta").alias("n_score"), last(value, "score_delta").alias("score"),
        last(F.when(F.col("text") == "home", 1.0).otherwise(-1.0), "score_delta").alias("score_side"), n("ball").alias("n_ball"), last(x, "ball").alias("bx"),
        last(y, "ball").alias("by"), F.max(F.when(ch == "ball", conf)).alias("ball_conf"), n("rim").alias("n_rim"), last(x, "rim").alias("rx"), last(y, "rim").alias("ry"),
        n("ball_control").alias("n_control"),
        # a missing or zero distance reads as far
        F.min(F.when(ch == "ball_control", F.least(F.when(value == 0, 10.0).otherwise(value) / 10.0, F.lit(1.0)))).alias("control"),
        n("player").alias("n_player"), *[F.count_if(is_p & (team == m)).alias(f"n_team{m}") for m in (0, 1)],
        *[_mean(F.when(is_p & (team == m), c)).alias(f"{nm}{m}") for m in (0, 1) for nm, c in (("tx", x), ("ty", y))],
        _std(F.when(is_p, x)).alias("sx"), _std(F.when(is_p, y)).alias("sy"), _mean(F.when(is_p & F.col("conf").isNotNull(), F.col("conf").cast("double"))).alias("player_conf"),
        n("jersey_read").alias("n_read"), n("name_call").alias("n_name"), F.count(F.lit(1)).alias("n_tokens"),
    ]
    d = spine.join(used.groupBy(key, "bin").agg(*cells), [key, "bin"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    flag = lambda c: F.when(F.col(c) > 0, 1.0).otherwise(0.0)
    share = lambda c, k: F.least(zero(F.col(c)) / float(k), F.lit(1.0))
    clip = lambda c: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))
    d = scan(d, [key], ["bin"], {"_p": prev(F.struct("n_ball", "bx", "by"))}, hot_rows)
    moving = (F.col("n_ball") > 0) & (F.col("_p.n_ball") > 0)
    both = (F.col("n_ball") > 0) & (F.col("n_rim") > 0)
    dx, dy = F.col("bx") - F.col("rx"), F.col("by") - F.col("ry")
    rim = F.sqrt(dx * dx + dy * dy)
    many = F.col("n_player") > 1
    out = {
        "clock_seen": flag("n_clock"), "clock": zero(F.col("clock") / 2400.0), "period": zero(F.col("period") / 2.0), "clock_conf": zero(F.col("clock_conf")),
        "cut": flag("n_cut"), "score_seen": flag("n_score"), "score_delta": zero(F.col("score") / 3.0), "score_side": zero(F.col("score_side")),
        "ball_count": share("n_ball", 4), "ball_x": zero(F.col("bx") / LENGTH), "ball_y": zero(F.col("by") / WIDTH), "ball_conf": zero(F.col("ball_conf")),
        "rim_seen": flag("n_rim"), "rim_x": zero(F.col("rx") / LENGTH), "rim_y": zero(F.col("ry") / WIDTH), "control_seen": flag("n_control"),
        "control_min": zero(F.col("control")), "control_count": share("n_control", 4), "players": share("n_player", 12), "team0": share("n_team0", 6),
        "team1": share("n_team1", 6), "team0_x": zero(F.col("tx0") / LENGTH), "team0_y": zero(F.col("ty0") / WIDTH), "team1_x": zero(F.col("tx1") / LENGTH),
        "team1_y": zero(F.col("ty1") / WIDTH), "spread_x": F.when(many, F.col("sx") / 47.0).otherwise(0.0), "spread_y": F.when(many, F.col("sy") / 25.0).otherwise(0.0),
        "player_conf": zero(F.col("player_conf")), "reads": share("n_read", 3), "names": share("n_name", 3), "near_rim": F.when(both & (rim < 6.0), 1.0).otherwise(0.0),
        "rim_distance": F.when(both, F.least(rim / 10.0, F.lit(1.0))).otherwise(0.0),
        "ball_vx": F.when(moving, clip((F.col("bx") - F.col("_p.bx")) / 10.0)).otherwise(0.0), "ball_vy": F.when(moving, clip((F.col("by") - F.col("_p.by")) / 10.0)).otherwise(0.0),
        "tokens": share("n_tokens", 50), "bias": F.lit(1.0),
    }
    return d.select(key, "bin", *[c.cast("double").alias(nm) for nm, c in out.items()])


def ball_grid(tokens: DataFrame, key: str, bin_ms: int, age_cap: int, hot_rows: int | None = None) -> DataFrame:
    """WIN-17: highest-confidence located ball of each bin (the later one on a tie), last known place and age."""
    obs = tokens.filter(~F.col("channel").isin(*TARGET_ONLY)).withColumn("bin", F.floor(F.col("t_ms") / F.lit(bin_ms)))
    seen = obs.filter((F.col("channel") == "ball") & F.col("court_x").isNotNull())
    best = seen.groupBy(key, "bin").agg(F.max_by(F.struct("court_x", "court_y", "conf"), F.struct(F.coalesce("conf", F.lit(2.0)), "token_idx")).alias("_b"))
    d = dense_spine(obs, [key], "bin").join(best, [key, "bin"], "left")
    d = d.select(key, "bin", F.col("_b").isNotNull().alias("present"), (F.col("_b.court_x") / LENGTH).alias("x"), (F.col("_b.court_y") / WIDTH).alias("y"),
                 F.coalesce("_b.conf", F.lit(0.0)).alias("conf"), F.when(F.col("_b").isNotNull(), F.struct(F.col("_b.court_x") / LENGTH, F.col("_b.court_y") / WIDTH)).alias("_xy"))
    d = carry_forward(d, [key], ["bin"], "_xy", age_cap, "_last", hot_rows)
    return d.select(key, "bin", "present", "x", "y", "conf", F.col("_last.col1").alias("last_x"), F.col("_last.col2").alias("last_y"), F.col("_last_age").alias("age"))


def top_tracks(tokens: DataFrame, key: str, k: int = 16) -> DataFrame:
    """ORD-03: the ``k`` tracks of a game with most player and control tokens, ids breaking ties."""
    n = tokens.filter(F.col("channel").isin("player", "ball_control") & F.col("entity_id").isNotNull()).groupBy(key, "entity_id").agg(F.count(F.lit(1)).alias("n"))
    return top_k(n, [key], [F.col("n").desc(), F.col("entity_id")], k, "slot")


def track_grid(tokens: DataFrame, tracks: DataFrame, key: str, bin_ms: int, age_cap: int = 240, hot_rows: int | None = None) -> DataFrame:
    """WIN-16: 14 features per (game, track, bin) for the listed tracks.

    Reads carry their track in ``track_id``; the nearest other track is sought among the at most listed tracks of
    one bin. Only bins with tokens are shuffled and sorted; the empty bins behind each are told from it at the end.
    """
    obs = tokens.filter(~F.col("channel").isin(*TARGET_ONLY)).withColumn("bin", F.floor(F.col("t_ms") / F.lit(bin_ms)))
    ch, idx = F.col("channel"), F.col("token_idx")
    ball = obs.filter((ch == "ball") & F.col("court_x").isNotNull()).groupBy(key, "bin").agg(F.max_by(F.struct("court_x", "court_y"), idx).alias("_ball"))
    number = F.regexp_replace(F.col("text"), "[^0-9]", "").try_cast("int")
    mine = obs.withColumn("_e", F.when(ch == "jersey_read", F.col("track_id")).otherwise(F.col("entity_id"))).withColumn("_no", F.when(number <= 99, number))
    mine = mine.join(tracks.select(key, F.col("entity_id").alias("_e")), [key, "_e"], "left_semi")
    read = (ch == "jersey_read") & F.col("_no").isNotNull()
    value = F.col("value").cast("double")
    cells = mine.groupBy(key, F.col("_e").alias("entity_id"), "bin").agg(
        (F.count_if(ch == "player") > 0).alias("present"), F.max_by(F.struct(F.coalesce("court_x", F.lit(0.0)).alias("x"), F.coalesce("court_y", F.lit(0.0)).alias("y")), F.when(ch == "player", idx)).alias("_xy"),
        F.max(F.when(ch == "player", F.coalesce("conf", F.lit(0.0)))).alias("conf"),
        F.max_by(F.least(F.when(F.coalesce(value, F.lit(0.0)) == 0, 10.0).otherwise(value) / 10.0, F.lit(1.0)), F.when(ch == "ball_control", idx)).alias("control"),
        F.max_by(F.struct(F.col("_no").alias("no"), F.coalesce("conf", F.lit(0.0)).alias("c")), F.when(read, idx)).alias("_read"))
    cells = cells.filter("bin >= 0").join(ball, [key, "bin"], "left").withColumn("read_value", F.col("_read.no") / 99.0)
    seen = F.when(F.col("present"), F.struct(F.col("entity_id").alias("e"), F.col("_xy").alias("xy")))
    cells = cells.withColumn("_seen", F.collect_list(seen).over(Window.partitionBy(key, "bin")))  # at most the listed tracks
    ox, oy = (lambda o, c=c: F.col("_xy")[c] - o["xy"][c] for c in ("x", "y"))
    others = F.transform(F.filter("_seen", lambda o: o["e"] != F.col("entity_id")), lambda o: F.sqrt(ox(o) * ox(o) + oy(o) * oy(o)))
    cells = cells.withColumn("_near", F.when(F.col("present"), F.array_min(others))).drop("_seen")
    # a head before bin 0 holds the bins before a track's first token
    d = cells.unionByName(tracks.select(key, "entity_id", F.lit(-1).cast("long").alias("bin")), allowMissingColumns=True)
    box = F.when(F.col("read_value").isNotNull(), F.struct(F.col("bin").alias("t"), F.col("read_value").alias("v")))
    d = scan(d, [key, "entity_id"], ["bin"], {"_last": fill_forward(box), "_p": prev(F.struct("bin", "present", "_xy")), "_next": next_(F.col("bin"))}, hot_rows)
    d = d.join(obs.groupBy(key).agg(F.max("bin").alias("_top")), key)
    low, high = F.greatest(F.col("bin"), F.lit(0)), F.coalesce(F.col("_next") - 1, F.col("_top"))
    clip = lambda c: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    moved = F.col("present") & F.coalesce(F.col("_p.present") & (F.col("_p.bin") == F.col("bin") - 1), F.lit(False))
    bx, by = F.col("_xy.x") - F.col("_ball.court_x"), F.col("_xy.y") - F.col("_ball.court_y")
    own = {
        "present": zero(F.col("present")), "x": zero(F.col("_xy.x") / LENGTH), "y": zero(F.col("_xy.y") / WIDTH),
        "dx": F.when(moved, clip((F.col("_xy.x") - F.col("_p._xy.x")) / 10.0)).otherwise(0.0), "dy": F.when(moved, clip((F.col("_xy.y") - F.col("_p._xy.y")) / 10.0)).otherwise(0.0),
        "conf": zero(F.col("conf")), "ball_distance": zero(F.when(F.col("present") & F.col("_ball").isNotNull(), F.least(F.sqrt(bx * bx + by * by) / 10.0, F.lit(1.0)))),
        "control_distance": zero(F.col("control")), "neighbour_distance": zero(F.when(F.col("_near").isNotNull(), F.least(F.col("_near") / 10.0, F.lit(1.0)))),
        "read": F.col("_read").isNotNull().cast("double"), "read_value": zero(F.col("read_value")), "read_conf": zero(F.col("_read.c"))}
    d = d.select(key, "entity_id", F.col("bin").alias("_at"), "_last", *[c.alias(n) for n, c in own.items()], F.when(low <= high, F.sequence(low, high)).alias("_bins"))
    d = d.select("*", F.explode("_bins").alias("bin"))
    age = F.least((F.col("bin") - F.col("_last.t")) / F.lit(float(age_cap)), F.lit(1.0))
    return d.select(key, "entity_id", "bin", *[F.when(F.col("bin") == F.col("_at"), F.col(n)).otherwise(0.0).alias(n) for n in own],
                    zero(F.col("_last.v")).alias("last_read"), F.coalesce(age, F.lit(1.0)).alias("read_age"))


def local_references(boxes: DataFrame, frames: DataFrame, key: str, frame: str, reach: int = 45, keep: int = 15, split: float = 120.0) -> DataFrame:
    """WIN-13: median boxes per cluster of the ``keep`` boxes nearest in time within ``reach`` frames of
    each frame; clusters split where the centre jumps by more than ``split``.

    At most ``keep`` boxes per frame leave the range join, so clusters are cut inside an array.
    """
    from fieldtrace.operators.interval import span_pairs
    from fieldtrace.operators.islands import island_ids
    from fieldtrace.operators.metrics import quantiles

    spans = frames.select(key, F.col(frame).alias("_at")).distinct().withColumn("_lo", F.col("_at") - reach).withColumn("_hi", F.col("_at") + reach)
    width = 2 * reach + 1
    pairs = span_pairs(boxes, spans, [key], frame, "_lo", "_hi", width, max_length=width)
    near = top_k(pairs, [key, "_at"], [F.abs(F.col(frame) - F.col("_at")), F.col(frame), F.col("box_id")], keep, "_r")
    near = near.withColumn("_c", (F.col("x1") + F.col("x2")) / 2.0)
    d = island_ids(near, [key, "_at"], ["_c", "box_id"], None, split, "cluster")
    g = [key, "_at", "cluster"]
    out = None
    for c in ("x1", "y1", "x2", "y2"):
        q = quantiles(d, g, c, {c: (0.5, "linear")})
        out = q.select(*g, c) if out is None else out.join(q.select(*g, c), g)
    return out.withColumnRenamed("_at", frame)
