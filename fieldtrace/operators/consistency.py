"""DQ-02: consistency of a match state with itself and with its evidence, as facts per rule and frame.

A state is two tables: ``frames`` (one row per state frame, in the order of ``seq``) and ``entities`` (players and
balls of a frame, in the order of ``pos``). A rule judges only what its channel covers; what it can't judge is a
skipped fact with a reason, so silence never reads as a clean result. Facts are rows, counts come from one
``groupBy``; a frame's own entities are the only thing that is gathered per frame.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.operators.ordered import prev, scan

# Rules and the channel that owns each.
OWNERS = {
    "frame_clock": "camera",
    "source_alignment": "camera",
    "simultaneous_tracks": "players",
    "simultaneous_identity": "context",
    "geometry": "players",
    "calibration_gate": "calibration",
    "pitch_bounds": "calibration",
    "temporal_continuity": "camera",
    "ball_possession": "context",
    "orientation": "context",
    "motion_diagnostic": "players",
}
# Position states that are no observation.
UNOBSERVED = ["estimated", "extrapolated", "unknown", "unavailable"]
GEOMETRY = ["geometry", "calibration_gate", "pitch_bounds"]

FRAMES = """seq long, frame_id long, timestamp_s double, shot_id long, calibration_usable boolean, position_origin string, source_kind string,
has_players boolean, has_balls boolean, possession struct<team: string, status: string, hypotheses: array<struct<value: string, source: string, evidence_ids: array<string>>>>,
orientation array<struct<team: string, selected: int, hypotheses: array<struct<value: int, source: string, evidence_ids: array<string>>>>>"""
ENTITIES = "seq long, pos int, kind string, evidence_id string, tracklet_id string, identity string, team string, xy array<double>, position_status string"


def finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def point(xy: Column) -> Column:
    """Two finite coordinates."""
    return F.coalesce(F.size(xy) == 2, F.lit(False)) & finite(F.get(xy, 0)) & finite(F.get(xy, 1))


def observed(status: Column) -> Column:
    return status.isNull() | ~status.isin(UNOBSERVED)


def fact(rule: str | Column, outcome: str, code: str | Column | None = None, key: Column | None = None, refs: Column | None = None, blocking: bool = True) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_column(rule).alias("rule"), F.lit(outcome).alias("outcome"), as_column(code).cast("string").alias("code"),
                    (F.lit(None) if key is None else key).cast("string").alias("key"),
                    (F.array() if refs is None else F.array_compact(refs)).cast("array<string>").alias("evidence_ids"),
                    F.lit(blocking and outcome == "violation").alias("blocking"))


def facts_of(d: DataFrame, keys: list[str], found: list[Column]) -> DataFrame:
    """The facts that hold of each row: a null is none."""
    return d.select(*keys, "seq", "frame_id", "timestamp_s", "shot_id", F.explode(F.array_compact(F.array(*found))).alias("_f")).select(*keys, "seq", "frame_id", "timestamp_s", "shot_id", "_f.*")


def clock_facts(frames: DataFrame, keys: list[str]) -> DataFrame:
    """frame_clock: a frame id that is missing or was there before, or a clock that is no number."""
    own = Window.partitionBy(*keys, "frame_id", F.when(F.col("frame_id").isNull(), F.col("seq"))).orderBy("seq")
    d = frames.withColumn("_n", F.row_number().over(own))
    bad = F.col("frame_id").isNull() | (F.col("_n") > 1) | ~finite(F.col("timestamp_s"))
    return facts_of(d, keys, [fact("frame_clock", "checked"), F.when(bad, fact("frame_clock", "violation", "invalid_or_duplicate_frame_clock"))])


def source_facts(frames: DataFrame, keys: list[str], source: DataFrame | None) -> DataFrame:
    """source_alignment against (keys, frame_id, timestamp_s, and shot_id where the source knows it)."""
    rule = "source_alignment"
    if source is None:
        return facts_of(frames, keys, [fact(rule, "skipped", "source_frame_channel_absent")])
    cols = [c for c in ("timestamp_s", "shot_id") if c in source.columns]
    one = source.groupBy(*keys, F.col("frame_id").alias("_id")).agg(F.max_by(F.struct(*cols), F.struct(*cols)).alias("_s"))
    match = [F.col(f"_a.{k}") == F.col(f"_b.{k}") for k in keys]
    d = frames.alias("_a").join(one.alias("_b"), [*match, F.col("_a.frame_id") == F.col("_b._id")], "left").select("_a.*", "_s")
    differs = ~F.col("timestamp_s").eqNullSafe(F.col("_s.timestamp_s"))
    if "shot_id" in cols:
        differs = differs | ~F.col("shot_id").eqNullSafe(F.col("_s.shot_id"))
    return facts_of(d, keys, [fact(rule, "checked"), F.when(F.col("_s").isNull(), fact(rule, "violation", "frame_absent_from_source")).when(
        differs, fact(rule, "violation", "source_clock_or_camera_mismatch"))])


def simultaneous_facts(frames: DataFrame, players: DataFrame, keys: list[str]) -> DataFrame:
    """simultaneous_tracks and simultaneous_identity: one tracklet and one identity at a time within a shot."""
    absent = facts_of(frames.filter(~F.coalesce("has_players", F.lit(False))), keys,
                      [fact(r, "skipped", "player_channel_absent") for r in ("simultaneous_tracks", "simultaneous_identity")])
    found, d = [], players
    for rule, col, what, unknown in (("simultaneous_tracks", "tracklet_id", "tracklet", "shot_or_tracklet_unknown"), ("simultaneous_identity", "identity", "identity", "shot_or_identity_unknown")):
        same = Window.partitionBy(*keys, "seq", col).orderBy("pos")
        d = d.withColumn(f"_n_{what}", F.row_number().over(same)).withColumn(f"_r_{what}", F.lag("evidence_id").over(same))
        known = F.col("shot_id").isNotNull() & F.col(col).isNotNull()
        found += [F.when(known, fact(rule, "checked")).otherwise(fact(rule, "skipped", unknown)),
                  F.when(known & (F.col(f"_n_{what}") > 1), fact(rule, "violation", f"duplicate_simultaneous_{what}", F.concat(F.lit("shot:"), F.col("shot_id"), F.lit(f":{what}:"), F.col(col)),
                                                                F.array("evidence_id", f"_r_{what}")))]
    return absent.unionByName(facts_of(d, keys, found))


def geometry_facts(empty: DataFrame, entities: DataFrame, keys: list[str], calibrations: DataFrame | None, bounds: tuple[float, float, float, float] | None) -> DataFrame:
    """geometry, calibration_gate and pitch_bounds of each player and ball; ``empty`` are frames without any."""
    none = facts_of(empty, keys, [fact(r, "skipped", "no_entity_geometry_channel") for r in GEOMETRY])
    ref, xy = F.array("evidence_id"), F.col("xy")
    known, valid = xy.isNotNull(), point(xy)
    found = [F.when(~known, fact(r, "skipped", "position_unknown")) for r in GEOMETRY]
    found += [F.when(known, fact("geometry", "checked")),
              F.when(known & F.coalesce(F.col("position_status") == "unavailable", F.lit(False)), fact("geometry", "violation", "unavailable_position_has_coordinates", None, ref)),
              F.when(known & ~valid, fact("geometry", "violation", "invalid_position", None, ref))]
    provider = F.coalesce(F.col("position_origin") == "provider_tracking", F.lit(False))
    gated = known & ~provider & F.col("calibration_usable").isNotNull()
    found += [F.when(known & provider, fact("calibration_gate", "skipped", "provider_metric_positions_do_not_require_camera_calibration")),
              F.when(known & ~provider & F.col("calibration_usable").isNull(), fact("calibration_gate", "skipped", "calibration_channel_absent")),
              F.when(gated, fact("calibration_gate", "checked")),
              F.when(gated & ~F.col("calibration_usable"), fact("calibration_gate", "violation", "position_with_rejected_calibration", None, ref))]
    d = entities
    if calibrations is not None:
        fits = calibrations.groupBy(*keys, F.col("frame_id").alias("_id")).agg((F.count("*") == 1).alias("_one"), F.bool_and(F.coalesce("accepted", F.lit(False))).alias("_ok"))
        match = [F.col(f"_a.{k}") == F.col(f"_b.{k}") for k in keys]
        d = d.alias("_a").join(fits.alias("_b"), [*match, F.col("_a.frame_id") == F.col("_b._id")], "left").select("_a.*", F.coalesce(F.col("_one") & F.col("_ok"), F.lit(False)).alias("_fit"))
        found.append(F.when(gated & F.col("calibration_usable") & ~F.col("_fit"), fact("calibration_gate", "violation", "position_without_unique_accepted_source_calibration", None, ref)))
    if bounds is None:
        found.append(F.when(known, fact("pitch_bounds", "skipped", "explicit_pitch_bounds_absent")))
    else:
        x0, x1, y0, y1 = bounds
        inside = F.get(xy, 0).between(x0, x1) & F.get(xy, 1).between(y0, y1)
        found += [F.when(known & ~valid, fact("pitch_bounds", "skipped", "position_invalid")), F.when(known & valid, fact("pitch_bounds", "checked")),
                  F.when(known & valid & ~inside, fact("pitch_bounds", "violation", "outside_explicit_pitch_bounds", None, ref, blocking=False))]
    return none.unionByName(facts_of(d, keys, found))


def possession_facts(frames: DataFrame, keys: list[str]) -> DataFrame:
    """ball_possession: a team needs review, a provider's claim, or one localised ball and one of its own players as evidence.

    ``frames`` carries ``_balls`` and ``_players``: the frame's entities."""
    rule, p = "ball_possession", F.col("possession")
    covered = p.isNotNull() & F.coalesce("has_balls", F.lit(False))
    support = F.filter(F.coalesce(p["hypotheses"], F.array()), lambda h: h["value"] == p["team"])
    backed = lambda *sources: F.exists(support, lambda h: h["source"].isin(*sources) & (F.size(h["evidence_ids"]) > 0))
    local = F.filter("_balls", lambda b: point(b["xy"]) & observed(b["position_status"]))
    own = F.transform(F.filter("_players", lambda x: F.coalesce(x["team"] == p["team"], F.lit(False)) & point(x["xy"]) & observed(x["position_status"])), lambda x: x["evidence_id"])
    held = F.exists(support, lambda h: F.coalesce(F.arrays_overlap(h["evidence_ids"], F.array_compact(own)) & F.arrays_overlap(h["evidence_ids"], F.array_compact(F.transform(local, lambda b: b["evidence_id"]))), F.lit(False)))
    claimed = covered & p["team"].isNotNull()
    provider = F.coalesce(F.col("source_kind") == "provider", F.lit(False)) & F.coalesce(backed("provider_tracking", "provider"), F.lit(False))
    reviewed = F.coalesce(p["status"] == "reviewed", F.lit(False))
    refs = F.flatten(F.transform(support, lambda h: F.coalesce(h["evidence_ids"], F.array().cast("array<string>"))))
    unclear = (F.size("_balls") != 1) | (F.size(local) != 1) | ~F.coalesce(held, F.lit(False))
    return facts_of(frames, keys, [
        F.when(covered, fact(rule, "checked")).otherwise(fact(rule, "skipped", "ball_or_possession_channel_absent")),
        F.when(claimed & ~provider & reviewed & ~F.coalesce(backed("review"), F.lit(False)), fact(rule, "violation", "reviewed_possession_without_review_evidence", None, refs)),
        F.when(claimed & ~provider & ~reviewed & unclear, fact(rule, "violation", "unsupported_or_ambiguous_possession", None, refs))])


def orientation_facts(frames: DataFrame, keys: list[str]) -> DataFrame:
    """orientation: a direction of a team counts where evidence supports it; two teams can't share one."""
    rule = "orientation"
    some = F.coalesce(F.size("orientation") > 0, F.lit(False))
    backed = lambda t: F.filter(F.coalesce(t["hypotheses"], F.array()), lambda h: (h["value"] == t["selected"]) & (h["source"] != "unresolved") & (F.size(h["evidence_ids"]) > 0))
    d = frames.withColumn("_t", F.transform(F.coalesce("orientation", F.array()), lambda t: F.struct(t["team"].alias("team"), t["selected"].alias("selected"), F.flatten(F.transform(backed(t), lambda h: h["evidence_ids"])).alias("refs"),
                                                                                                F.when(t["selected"].isNull(), "unknown").when(~t["selected"].isin(-1, 1), "invalid").when(F.size(backed(t)) == 0, "unbacked").otherwise("supported").alias("state"))))
    good = F.filter("_t", lambda t: t["state"] == "supported")
    shared = (F.size(good) == 2) & (F.get(good, 0)["selected"] == F.get(good, 1)["selected"])
    frame_level = facts_of(d, keys, [F.when(~some, fact(rule, "skipped", "orientation_channel_absent")),
                                     F.when(shared, fact(rule, "violation", "opponents_share_attacking_direction", None, F.flatten(F.transform(good, lambda t: t["refs"]))))])
    each = d.select("*", F.explode("_t").alias("_e")).drop("_t")
    state = F.col("_e.state")
    return frame_level.unionByName(facts_of(each, keys, [
        F.when(state == "unknown", fact(rule, "skipped", "direction_unknown")).when(state == "unbacked", fact(rule, "skipped", "direction_evidence_unavailable")).otherwise(fact(rule, "checked")),
        F.when(state == "invalid", fact(rule, "violation", "invalid_orientation", F.col("_e.team")))]))


def paired(frames: DataFrame, keys: list[str], max_gap_s: float | None, hot_rows: int | None = None) -> DataFrame:
    """Each frame with the one before (``_p``), the clock step and the reason why the state breaks before it."""
    d = scan(frames, keys, ["seq"], {"_p": prev(F.struct("seq", "frame_id", "timestamp_s", "shot_id"))}, hot_rows)
    step = F.when(finite(F.col("timestamp_s")) & finite(F.col("_p.timestamp_s")), F.col("timestamp_s") - F.col("_p.timestamp_s"))
    d = d.withColumn("delta_s", step)
    unknown = F.col("delta_s").isNull() | F.col("shot_id").isNull() | F.col("_p.shot_id").isNull()
    reason = (F.when(F.col("_p").isNull(), F.lit(None)).when(unknown, "clock_or_camera_unknown").when(F.col("delta_s") <= 0, "nonincreasing_source_time")
              .when(F.col("shot_id") != F.col("_p.shot_id"), "camera_cut"))
    if max_gap_s is not None:
        reason = reason.when(F.col("delta_s") > max_gap_s, "sampling_gap")
    d = d.withColumn("reason", reason)
    # a frame id that broke before stays broken when it comes again
    same = Window.partitionBy(*keys, "frame_id", F.when(F.col("frame_id").isNull(), F.col("seq"))).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("_broken", F.col("frame_id").isNotNull() & F.max(F.col("reason").isNotNull()).over(same))


def boundaries(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Frames before which the state breaks, with the reason and the clock step."""
    return pairs.filter(F.col("reason").isNotNull()).select(*keys, "seq", "frame_id", F.col("_p.frame_id").alias("previous_frame_id"), "reason", "delta_s")


def motion_facts(pairs: DataFrame, players: DataFrame, keys: list[str], max_speed_m_s: float | None) -> DataFrame:
    """temporal_continuity of frame pairs, motion_diagnostic of tracklets that both frames of an unbroken pair localise."""
    cont, rule = "temporal_continuity", "motion_diagnostic"
    first = F.col("_p").isNull()
    unknown = F.col("reason") == "clock_or_camera_unknown"
    found = [F.when(first, fact(cont, "skipped", "no_previous_frame")).when(unknown, fact(cont, "skipped", "clock_or_camera_unknown")).otherwise(fact(cont, "checked")),
             F.when(F.col("reason") == "nonincreasing_source_time", fact(cont, "violation", "nonincreasing_source_time")), F.when(first, fact(rule, "skipped", "no_previous_frame"))]
    if max_speed_m_s is None:
        return facts_of(pairs, keys, [*found, F.when(~first, fact(rule, "skipped", "diagnostic_threshold_not_configured"))])
    closed = F.col("_broken") | F.col("delta_s").isNull() | (F.col("delta_s") <= 0)
    out = facts_of(pairs, keys, [*found, F.when(~first & closed, fact(rule, "skipped", "discontinuous_frame_pair"))])
    still = pairs.filter(~first & ~closed).select(*keys, "seq", "frame_id", "timestamp_s", "shot_id", "delta_s", F.col("_p.seq").alias("_ps"), F.col("_p.shot_id").alias("_pshot"))
    tracked = players.filter(F.col("tracklet_id").isNotNull())
    now = tracked.select(*keys, "seq", "tracklet_id", "xy", "evidence_id")
    before = tracked.groupBy(*keys, F.col("seq").alias("_ps"), "tracklet_id").agg(F.max_by(F.struct("xy", "evidence_id"), "pos").alias("_o"))
    met = (still.filter(F.col("shot_id").eqNullSafe(F.col("_pshot"))).join(now, [*keys, "seq"]).join(before, [*keys, "_ps", "tracklet_id"])
           .filter(point(F.col("xy")) & point(F.col("_o.xy"))))
    step = lambda i: F.get("xy", i) - F.get(F.col("_o.xy"), i)
    speed = F.sqrt(step(0) * step(0) + step(1) * step(1)) / F.col("delta_s")
    key = F.concat(F.lit("shot:"), F.col("shot_id"), F.lit(":tracklet:"), F.col("tracklet_id"))
    moved = facts_of(met, keys, [fact(rule, "checked"), F.when(speed > max_speed_m_s, fact(rule, "violation", "configured_speed_diagnostic_exceeded", key, F.array("_o.evidence_id", "evidence_id"), blocking=False))])
    lone = still.join(met.select(*keys, "seq").distinct(), [*keys, "seq"], "left_anti")
    return out.unionByName(moved).unionByName(facts_of(lone, keys, [fact(rule, "skipped", "no_corresponding_localized_tracks")]))


def check_state(frames: DataFrame, entities: DataFrame, keys: list[str], source: DataFrame | None = None, calibrations: DataFrame | None = None,
                bounds: tuple[float, float, float, float] | None = None, max_gap_s: float | None = None, max_speed_m_s: float | None = None,
                rules: list[str] | None = None, hot_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """DQ-02: (facts, boundaries) of all matches at once.

    ``frames`` and ``entities`` have ``keys`` and the columns of FRAMES and ENTITIES; kind is player or ball. A fact is
    checked, skipped (code: the reason) or a violation; a check that fails gives a checked and a violation fact.
    ``rules`` limits the work to these. ``bounds`` is (x_min, x_max, y_min, y_max) in the axes of ``xy``; gap and speed are policies of the caller.
    """
    for name, value in (("max_gap_s", max_gap_s), ("max_speed_m_s", max_speed_m_s)):
        if value is not None and not 0 < value < float("inf"):
            raise ValueError(f"{name} must be finite and positive")
    if bounds is not None and not (bounds[0] < bounds[1] and bounds[2] < bounds[3]):
        raise ValueError("bounds are x_min < x_max, y_min < y_max")
    head = frames.select(*keys, "seq", "frame_id", "timestamp_s", "shot_id", "calibration_usable", "position_origin", "has_players", "has_balls")
    placed = entities.join(head, [*keys, "seq"]).filter(F.when(F.col("kind") == "ball", F.coalesce("has_balls", F.lit(False))).otherwise(F.coalesce("has_players", F.lit(False))))
    players = placed.filter("kind <> 'ball'")
    seen = F.struct("evidence_id", "team", "xy", "position_status")
    held = placed.groupBy(*keys, "seq").agg(*[F.collect_list(F.when(cond, seen)).alias(name) for name, cond in (("_balls", F.col("kind") == "ball"), ("_players", F.col("kind") != "ball"))])  # one frame's entities
    full = frames.join(held, [*keys, "seq"], "left")
    for name in ("_balls", "_players"):
        full = full.withColumn(name, F.coalesce(name, F.array().cast(held.schema[name].dataType)))
    pairs = paired(head, keys, max_gap_s, hot_rows)
    parts = {("frame_clock",): lambda: clock_facts(head, keys), ("source_alignment",): lambda: source_facts(head, keys, source),
             ("simultaneous_tracks", "simultaneous_identity"): lambda: simultaneous_facts(head, players, keys),
             tuple(GEOMETRY): lambda: geometry_facts(full.filter("size(_balls) + size(_players) = 0"), placed, keys, calibrations, bounds),
             ("ball_possession",): lambda: possession_facts(full, keys), ("orientation",): lambda: orientation_facts(full, keys),
             ("temporal_continuity", "motion_diagnostic"): lambda: motion_facts(pairs, players, keys, max_speed_m_s)}
    wanted = set(OWNERS if rules is None else rules)
    facts = reduce(DataFrame.unionByName, [part() for names, part in parts.items() if wanted & set(names)]).filter(F.col("rule").isin(*wanted))
    return facts, boundaries(pairs, keys)


def report(facts: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """DQ-02: one row per match and rule: owner, counts, reasons of what was skipped, status.

    A match without frames skips every rule (``state_frames_absent``), a rule without facts is skipped as well.
    """
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(o).alias("owner")) for r, o in OWNERS.items()])).alias("_r")
    spine = matches.select(*keys).distinct().select(*keys, rules).select(*keys, "_r.rule", "_r.owner")
    by_code = facts.groupBy(*keys, "rule", "outcome", "code").agg(F.count("*").alias("n"), F.sum(F.col("blocking").cast("long")).alias("b"))
    total = by_code.groupBy(*keys, "rule").agg(*[F.sum(F.when(F.col("outcome") == o, F.col("n")).otherwise(0)).alias(c) for o, c in (("checked", "checked"), ("skipped", "skipped"), ("violation", "violations"))],
                                               F.sum("b").alias("blocking"), F.array_sort(F.collect_list(F.when(F.col("outcome") == "skipped", F.struct("code", "n")))).alias("skip_reasons"))
    d = spine.join(total, [*keys, "rule"], "left")
    nothing = F.col("checked").isNull()
    d = d.withColumn("_some", F.max(~nothing).over(Window.partitionBy(*keys)))  # a match has a row per rule
    why = F.when(~F.col("_some"), "state_frames_absent").otherwise("no_applicable_observations")
    d = d.withColumn("skip_reasons", F.when(nothing, F.array(F.struct(why.alias("code"), F.lit(1).cast("long").alias("n")))).otherwise(F.col("skip_reasons")))
    d = d.withColumn("skipped", F.when(nothing, 1).otherwise(F.col("skipped"))).fillna(0, ["checked", "violations", "blocking"]).drop("_some")
    status = F.when(F.col("violations") > 0, "violations").when((F.col("skipped") > 0) & (F.col("checked") > 0), "partial").when(F.col("skipped") > 0, "skipped").otherwise("checked")
    return d.withColumn("status", status)


def match_status(rules: DataFrame, keys: list[str]) -> DataFrame:
    """DQ-02: one status per match: violations, partial (something was skipped) or checked."""
    worst = F.when(F.max("violations") > 0, "violations").when(F.max("skipped") > 0, "partial").otherwise("checked")
    return rules.groupBy(*keys).agg(worst.alias("status"), F.sum("violations").alias("violations"), F.sum("skipped").alias("skipped"))


def blocked_frames(facts: DataFrame, keys: list[str]) -> DataFrame:
    """DQ-02: frames that a blocking violation rules out."""
    return facts.filter(F.col("blocking") & F.col("frame_id").isNotNull()).select(*keys, "frame_id").distinct()
