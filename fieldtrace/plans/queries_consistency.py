"""DQ-02 on the event table: an event is a state frame of its user's match, its number decides what is missing or wrong."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrace.operators import consistency
from fieldtrace.plans.registry import DAY, EV, HOUR, Tables, query

BOUNDS, GAP, SPEED = (0.0, 105.0, 0.0, 68.0), 72_000.0, 0.001

STATE = f"""{EV},
f AS (SELECT user_id, event_id AS seq, k, cents, CASE WHEN k = 99 THEN NULL WHEN k % 10 = 0 THEN k ELSE event_id + 1000 END AS frame_id,
  CASE WHEN k <> 98 THEN (us - CASE WHEN k % 10 = 3 THEN {36 * HOUR} ELSE 0 END) / 1000000.0::DOUBLE END AS timestamp_s, CASE WHEN k <> 97 THEN us // {3 * DAY} END AS shot_id,
  CASE WHEN event_type <> 'click' THEN k % 6 <> 0 END AS cal, event_type = 'purchase' AS metric, event_type = 'signup' AS provider, event_type <> 'error' AS has_players, k % 3 <> 0 AS has_balls FROM ev),
x AS (SELECT f.*, i AS pos, 'player' AS kind, 'p' || i AS evidence_id, i AS j, CASE WHEN (k + i) % 11 <> 0 THEN 't' || ((k * i) % 5) END AS tracklet_id,
    CASE WHEN (k + i) % 4 <> 0 THEN 'n' || ((k + i * i) % 6) END AS identity, (i % 2)::VARCHAR AS team FROM f, unnest(range(0, k % 5)) t(i) WHERE has_players
  UNION ALL SELECT f.*, 100 + i, 'ball', 'b' || i, i + 7, NULL, NULL, NULL FROM f, unnest(range(0, CASE WHEN k % 5 = 0 THEN 2 ELSE 1 END)) t(i) WHERE has_balls),
e AS (SELECT *, (k + j) % 13 <> 0 AS known, (k + j) % 17 <> 0 AND (k + j) % 19 <> 0 AND (k + j) % 13 <> 0 AS valid, (cents + 700 * j) % 12000 / 100.0::DOUBLE - 5 AS px, (cents * 3 + 300 * j) % 8000 / 100.0::DOUBLE - 5 AS py,
  CASE WHEN (k + j) % 5 = 0 THEN 'estimated' WHEN (k + j) % 23 = 0 THEN 'unavailable' END AS position_status FROM x)"""


def frames_of(t: Tables):
    k = F.col("k")
    text = lambda c: c.cast("string")
    ids = lambda cond, *names: F.when(cond, F.array().cast("array<string>")).otherwise(F.array(*names))
    claim = F.struct(F.when(k % 6 < 5, text(k % 2)).otherwise("9").alias("value"), F.when(k % 7 == 0, "review").when(k % 7 == 1, "provider").otherwise("nearest_player_proxy").alias("source"),
                     ids(k % 11 == 0, F.concat(F.lit("p"), text(k % 4)), F.lit("b0")).alias("evidence_ids"))
    possession = F.struct(F.when(k % 4 != 3, text(k % 2)).alias("team"), F.when(k % 5 == 0, "reviewed").otherwise("hypothesis").alias("status"), F.array(claim).alias("hypotheses"))
    def side(team, selected, source, evidence):
        return F.struct(F.lit(team).alias("team"), selected.cast("int").alias("selected"), F.array(F.struct(selected.cast("int").alias("value"), source.alias("source"), evidence.alias("evidence_ids"))).alias("hypotheses"))
    orientation = F.array(side("0", F.when(k % 4 == 1, 1).when(k % 4 == 2, -1).when(k % 4 == 3, 2), F.when(k % 6 == 0, "unresolved").otherwise("review"), ids(k % 13 == 0, F.lit("p0"))),
                          side("1", F.when(k % 5 < 3, 1).otherwise(-1), F.lit("review"), ids(F.lit(False), F.lit("p1"))))
    return t.ev.select(
        "user_id", F.col("event_id").alias("seq"), "k", "cents", F.when(k == 99, F.lit(None)).when(k % 10 == 0, k).otherwise(F.col("event_id") + 1000).alias("frame_id"),
        F.when(k != 98, (F.col("us") - F.when(k % 10 == 3, 36 * HOUR).otherwise(0)) / F.lit(1000000.0)).alias("timestamp_s"), F.when(k != 97, F.floor(F.col("us") / F.lit(3 * DAY))).alias("shot_id"),
        F.when(F.col("event_type") != "click", k % 6 != 0).alias("calibration_usable"), F.when(F.col("event_type") == "purchase", "provider_tracking").otherwise("camera").alias("position_origin"),
        F.when(F.col("event_type") == "signup", "provider").otherwise("video").alias("source_kind"), (F.col("event_type") != "error").alias("has_players"), (k % 3 != 0).alias("has_balls"),
        F.when(k % 8 != 0, possession).alias("possession"), F.when(k % 9 != 0, orientation).alias("orientation"))


def entities_of(frames):
    k, j = F.col("k"), F.col("j")
    i = F.explode(F.when(F.col("has_players") & (k % 5 > 0), F.sequence(F.lit(0), (k % 5 - 1).cast("int"))).otherwise(F.array().cast("array<int>")))
    text = lambda c: c.cast("string")
    players = frames.select("user_id", "seq", "k", "cents", i.alias("i")).select("user_id", "seq", "k", "cents", F.col("i").alias("pos"), F.lit("player").alias("kind"), F.concat(F.lit("p"), text(F.col("i"))).alias("evidence_id"),
        F.col("i").alias("j"), F.when((k + F.col("i")) % 11 != 0, F.concat(F.lit("t"), text((k * F.col("i")) % 5))).alias("tracklet_id"),
        F.when((k + F.col("i")) % 4 != 0, F.concat(F.lit("n"), text((k + F.col("i") * F.col("i")) % 6))).alias("identity"), text(F.col("i") % 2).alias("team"))
    b = F.explode(F.when(F.col("has_balls"), F.when(k % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).otherwise(F.array().cast("array<int>")))
    none = F.lit(None).cast("string")
    balls = frames.select("user_id", "seq", "k", "cents", b.alias("i")).select("user_id", "seq", "k", "cents", (F.col("i") + 100).alias("pos"), F.lit("ball").alias("kind"), F.concat(F.lit("b"), text(F.col("i"))).alias("evidence_id"),
        (F.col("i") + 7).alias("j"), none.alias("tracklet_id"), none.alias("identity"), none.alias("team"))
    px = (F.col("cents") + 700 * j) % 12000 / F.lit(100.0) - 5
    py = (F.col("cents") * 3 + 300 * j) % 8000 / F.lit(100.0) - 5
    xy = F.when((k + j) % 13 != 0, F.when((k + j) % 17 == 0, F.array(F.lit(float("nan")), py)).when((k + j) % 19 == 0, F.array(px)).otherwise(F.array(px, py)))
    status = F.when((k + j) % 5 == 0, "estimated").when((k + j) % 23 == 0, "unavailable")
    return players.unionByName(balls).select("user_id", "seq", "pos", "kind", "evidence_id", "tracklet_id", "identity", "team", xy.alias("xy"), status.alias("position_status"))


def checked(t: Tables, rules=None):
    frames = frames_of(t)
    k = F.col("k")
    source = frames.filter(F.col("frame_id").isNotNull() & (k % 10 != 0) & (k % 7 != 0)).select("user_id", "frame_id", (F.col("timestamp_s") + F.when(k % 12 == 5, 1).otherwise(0)).alias("timestamp_s"), "shot_id")
    fits = frames.select("user_id", "frame_id", F.explode(F.when(k % 4 == 0, F.array().cast("array<boolean>")).when(k % 4 == 1, F.array(F.lit(True))).when(k % 4 == 2, F.array(F.lit(False))).otherwise(F.array(F.lit(True), F.lit(True)))).alias("accepted"))
    return consistency.check_state(frames.drop("k", "cents"), entities_of(frames), ["user_id"], source, fits, BOUNDS, GAP, SPEED, rules)


def counted(facts, *rules):
    return facts.filter(F.col("rule").isin(*rules)).groupBy("user_id", "rule", "outcome", "code", "key").agg(F.count("*").alias("n"), F.sum(F.size("evidence_ids")).alias("refs"), F.sum(F.col("blocking").cast("int")).alias("blocking"))


GEOM = "('geometry'), ('calibration_gate'), ('pitch_bounds')"
# facts of each rule: rule, outcome, code, key, number of evidence ids, blocking
FACTS = f"""WITH {STATE},
n AS (SELECT user_id, seq, count(*) AS n, count_if(kind = 'ball') AS balls, count_if(kind = 'ball' AND valid AND position_status IS NULL) AS localized,
  count_if(evidence_id = 'b0' AND valid AND position_status IS NULL) AS b0 FROM e GROUP BY ALL),
d1 AS (SELECT *, row_number() OVER (PARTITION BY user_id, frame_id ORDER BY seq) AS rn FROM f),
s AS (SELECT user_id, frame_id AS sid, timestamp_s + CASE WHEN k % 12 = 5 THEN 1 ELSE 0 END AS sts, shot_id AS sshot FROM f WHERE frame_id IS NOT NULL AND k % 10 <> 0 AND k % 7 <> 0),
fs AS (SELECT f.*, sid, sts, sshot FROM f LEFT JOIN s ON f.user_id = s.user_id AND f.frame_id = sid),
pl AS (SELECT *, row_number() OVER (PARTITION BY user_id, seq, tracklet_id ORDER BY pos) AS nt, row_number() OVER (PARTITION BY user_id, seq, identity ORDER BY pos) AS ni FROM e WHERE kind = 'player'),
fit AS (SELECT user_id, frame_id AS fid, count(*) = 1 AND bool_and(ok) AS fine FROM (SELECT user_id, frame_id, unnest(CASE k % 4 WHEN 0 THEN []::BOOLEAN[] WHEN 1 THEN [true] WHEN 2 THEN [false] ELSE [true, true] END) AS ok FROM f) GROUP BY ALL),
g AS (SELECT e.*, coalesce(fine, false) AS fine, known AND NOT metric AND cal IS NOT NULL AS gated FROM e LEFT JOIN fit ON e.user_id = fit.user_id AND e.frame_id = fid),
po AS (SELECT f.*, CASE WHEN f.k % 4 <> 3 THEN (f.k % 2)::VARCHAR END AS team, f.k % 8 <> 0 AND has_balls AS covered, f.k % 5 = 0 AS reviewed, f.k % 6 < 5 AS support, f.k % 11 <> 0 AS cited,
    coalesce(balls, 0) AS balls, coalesce(localized, 0) AS localized, coalesce(b0, 0) > 0 AS b0, own.seq IS NOT NULL AS own
  FROM f LEFT JOIN n ON f.user_id = n.user_id AND f.seq = n.seq
  LEFT JOIN (SELECT user_id, seq FROM e WHERE kind = 'player' AND evidence_id = 'p' || (k % 4) AND team = (k % 2)::VARCHAR AND valid AND position_status IS NULL) own ON f.user_id = own.user_id AND f.seq = own.seq),
po2 AS (SELECT *, covered AND team IS NOT NULL AND NOT (provider AND support AND cited AND k % 7 = 1) AS claimed FROM po),
orient AS (SELECT *, CASE k % 4 WHEN 1 THEN 1 WHEN 2 THEN -1 WHEN 3 THEN 2 END AS s0, CASE WHEN k % 5 < 3 THEN 1 ELSE -1 END AS s1, k % 6 <> 0 AND k % 13 <> 0 AS backed FROM f WHERE k % 9 <> 0),
pr AS (SELECT *, lag(seq) OVER w AS ps, lag(frame_id) OVER w AS pf, lag(timestamp_s) OVER w AS pt, lag(shot_id) OVER w AS psh, timestamp_s - lag(timestamp_s) OVER w AS delta_s FROM f WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
pr2 AS (SELECT *, CASE WHEN ps IS NULL THEN NULL WHEN delta_s IS NULL OR shot_id IS NULL OR psh IS NULL THEN 'clock_or_camera_unknown' WHEN delta_s <= 0 THEN 'nonincreasing_source_time' WHEN shot_id <> psh THEN 'camera_cut' WHEN delta_s > {GAP} THEN 'sampling_gap' END AS reason FROM pr),
pr3 AS (SELECT *, frame_id IS NOT NULL AND bool_or(reason IS NOT NULL) OVER (PARTITION BY user_id, frame_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS broken FROM pr2),
still AS (SELECT * FROM pr3 WHERE ps IS NOT NULL AND NOT (broken OR delta_s IS NULL OR delta_s <= 0)),
old AS (SELECT * FROM e WHERE kind = 'player' AND tracklet_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, seq, tracklet_id ORDER BY pos DESC) = 1),
met AS (SELECT still.user_id, still.seq, still.shot_id, a.tracklet_id, sqrt((a.px - o.px) * (a.px - o.px) + (a.py - o.py) * (a.py - o.py)) / delta_s AS speed FROM still
  JOIN e a ON a.user_id = still.user_id AND a.seq = still.seq AND a.kind = 'player' AND a.valid JOIN old o ON o.user_id = still.user_id AND o.seq = still.ps AND o.tracklet_id = a.tracklet_id AND o.valid WHERE still.shot_id IS NOT DISTINCT FROM psh),
facts(user_id, rule, outcome, code, key, refs, blocking) AS (
SELECT user_id, 'frame_clock', 'checked', NULL, NULL, 0, 0 FROM f
UNION ALL SELECT user_id, 'frame_clock', 'violation', 'invalid_or_duplicate_frame_clock', NULL, 0, 1 FROM d1 WHERE frame_id IS NULL OR rn > 1 OR timestamp_s IS NULL
UNION ALL SELECT user_id, 'source_alignment', 'checked', NULL, NULL, 0, 0 FROM f
UNION ALL SELECT user_id, 'source_alignment', 'violation', CASE WHEN sid IS NULL THEN 'frame_absent_from_source' ELSE 'source_clock_or_camera_mismatch' END, NULL, 0, 1 FROM fs WHERE sid IS NULL OR timestamp_s IS DISTINCT FROM sts OR shot_id IS DISTINCT FROM sshot
UNION ALL SELECT user_id, unnest(['simultaneous_tracks', 'simultaneous_identity']), 'skipped', 'player_channel_absent', NULL, 0, 0 FROM f WHERE NOT has_players
UNION ALL SELECT user_id, 'simultaneous_tracks', CASE WHEN shot_id IS NULL OR tracklet_id IS NULL THEN 'skipped' ELSE 'checked' END, CASE WHEN shot_id IS NULL OR tracklet_id IS NULL THEN 'shot_or_tracklet_unknown' END, NULL, 0, 0 FROM pl
UNION ALL SELECT user_id, 'simultaneous_tracks', 'violation', 'duplicate_simultaneous_tracklet', 'shot:' || shot_id || ':tracklet:' || tracklet_id, 2, 1 FROM pl WHERE shot_id IS NOT NULL AND tracklet_id IS NOT NULL AND nt > 1
UNION ALL SELECT user_id, 'simultaneous_identity', CASE WHEN shot_id IS NULL OR identity IS NULL THEN 'skipped' ELSE 'checked' END, CASE WHEN shot_id IS NULL OR identity IS NULL THEN 'shot_or_identity_unknown' END, NULL, 0, 0 FROM pl
UNION ALL SELECT user_id, 'simultaneous_identity', 'violation', 'duplicate_simultaneous_identity', 'shot:' || shot_id || ':identity:' || identity, 2, 1 FROM pl WHERE shot_id IS NOT NULL AND identity IS NOT NULL AND ni > 1
UNION ALL SELECT f.user_id, r, 'skipped', 'no_entity_geometry_channel', NULL, 0, 0 FROM f LEFT JOIN n ON f.user_id = n.user_id AND f.seq = n.seq, (VALUES {GEOM}) v(r) WHERE n.n IS NULL
UNION ALL SELECT user_id, r, 'skipped', 'position_unknown', NULL, 0, 0 FROM g, (VALUES {GEOM}) v(r) WHERE NOT known
UNION ALL SELECT user_id, 'geometry', 'checked', NULL, NULL, 0, 0 FROM g WHERE known
UNION ALL SELECT user_id, 'geometry', 'violation', 'unavailable_position_has_coordinates', NULL, 1, 1 FROM g WHERE known AND position_status = 'unavailable'
UNION ALL SELECT user_id, 'geometry', 'violation', 'invalid_position', NULL, 1, 1 FROM g WHERE known AND NOT valid
UNION ALL SELECT user_id, 'calibration_gate', 'skipped', CASE WHEN metric THEN 'provider_metric_positions_do_not_require_camera_calibration' ELSE 'calibration_channel_absent' END, NULL, 0, 0 FROM g WHERE known AND NOT gated
UNION ALL SELECT user_id, 'calibration_gate', 'checked', NULL, NULL, 0, 0 FROM g WHERE gated
UNION ALL SELECT user_id, 'calibration_gate', 'violation', CASE WHEN cal THEN 'position_without_unique_accepted_source_calibration' ELSE 'position_with_rejected_calibration' END, NULL, 1, 1 FROM g WHERE gated AND NOT (cal AND fine)
UNION ALL SELECT user_id, 'pitch_bounds', CASE WHEN valid THEN 'checked' ELSE 'skipped' END, CASE WHEN NOT valid THEN 'position_invalid' END, NULL, 0, 0 FROM g WHERE known
UNION ALL SELECT user_id, 'pitch_bounds', 'violation', 'outside_explicit_pitch_bounds', NULL, 1, 0 FROM g WHERE valid AND NOT (px BETWEEN {BOUNDS[0]} AND {BOUNDS[1]} AND py BETWEEN {BOUNDS[2]} AND {BOUNDS[3]})
UNION ALL SELECT user_id, 'ball_possession', CASE WHEN covered THEN 'checked' ELSE 'skipped' END, CASE WHEN NOT covered THEN 'ball_or_possession_channel_absent' END, NULL, 0, 0 FROM po2
UNION ALL SELECT user_id, 'ball_possession', 'violation', 'reviewed_possession_without_review_evidence', NULL, CASE WHEN support AND cited THEN 2 ELSE 0 END, 1 FROM po2 WHERE claimed AND reviewed AND NOT (support AND cited AND k % 7 = 0)
UNION ALL SELECT user_id, 'ball_possession', 'violation', 'unsupported_or_ambiguous_possession', NULL, CASE WHEN support AND cited THEN 2 ELSE 0 END, 1 FROM po2 WHERE claimed AND NOT reviewed AND NOT (balls = 1 AND localized = 1 AND support AND cited AND own AND b0)
UNION ALL SELECT user_id, 'orientation', 'skipped', 'orientation_channel_absent', NULL, 0, 0 FROM f WHERE k % 9 = 0
UNION ALL SELECT user_id, 'orientation', CASE WHEN s0 IS NULL OR (s0 <> 2 AND NOT backed) THEN 'skipped' ELSE 'checked' END, CASE WHEN s0 IS NULL THEN 'direction_unknown' WHEN s0 <> 2 AND NOT backed THEN 'direction_evidence_unavailable' END, NULL, 0, 0 FROM orient
UNION ALL SELECT user_id, 'orientation', 'checked', NULL, NULL, 0, 0 FROM orient
UNION ALL SELECT user_id, 'orientation', 'violation', 'invalid_orientation', '0', 0, 1 FROM orient WHERE s0 = 2
UNION ALL SELECT user_id, 'orientation', 'violation', 'opponents_share_attacking_direction', NULL, 2, 1 FROM orient WHERE s0 <> 2 AND backed AND s0 = s1
UNION ALL SELECT user_id, 'temporal_continuity', CASE WHEN ps IS NULL OR reason = 'clock_or_camera_unknown' THEN 'skipped' ELSE 'checked' END, CASE WHEN ps IS NULL THEN 'no_previous_frame' WHEN reason = 'clock_or_camera_unknown' THEN reason END, NULL, 0, 0 FROM pr3
UNION ALL SELECT user_id, 'temporal_continuity', 'violation', reason, NULL, 0, 1 FROM pr3 WHERE reason = 'nonincreasing_source_time'
UNION ALL SELECT user_id, 'motion_diagnostic', 'skipped', CASE WHEN ps IS NULL THEN 'no_previous_frame' ELSE 'discontinuous_frame_pair' END, NULL, 0, 0 FROM pr3 WHERE ps IS NULL OR broken OR delta_s IS NULL OR delta_s <= 0
UNION ALL SELECT user_id, 'motion_diagnostic', 'skipped', 'no_corresponding_localized_tracks', NULL, 0, 0 FROM still WHERE NOT EXISTS (SELECT 1 FROM met WHERE met.user_id = still.user_id AND met.seq = still.seq)
UNION ALL SELECT user_id, 'motion_diagnostic', 'checked', NULL, NULL, 0, 0 FROM met
UNION ALL SELECT user_id, 'motion_diagnostic', 'violation', 'configured_speed_diagnostic_exceeded', 'shot:' || shot_id || ':tracklet:' || tracklet_id, 2, 0 FROM met WHERE speed > {SPEED})"""


def group_sql(*rules):
    names = ", ".join(f"'{r}'" for r in rules)
    return f"{FACTS} SELECT user_id, rule, outcome, code, key, count(*) AS n, sum(refs)::BIGINT AS refs, sum(blocking)::BIGINT AS blocking FROM facts WHERE rule IN ({names}) GROUP BY ALL"


GROUPS = {"dq02_clock": ("frame_clock", "source_alignment"), "dq02_simultaneous": ("simultaneous_tracks", "simultaneous_identity"), "dq02_geometry": ("geometry", "calibration_gate", "pitch_bounds"),
          "dq02_possession": ("ball_possession",), "dq02_orientation": ("orientation",), "dq02_motion": ("temporal_continuity", "motion_diagnostic")}
for _name, _rules in GROUPS.items():
    query(_name, group_sql(*_rules))(lambda t, rules=_rules: counted(checked(t, rules)[0], *rules))


@query("dq02_boundaries", f"{FACTS} SELECT user_id, seq, frame_id, pf AS previous_frame_id, reason, delta_s FROM pr3 WHERE reason IS NOT NULL")
def _(t: Tables):
    return checked(t)[1]


# a match without events in the source, and the counts and states of all rules
MATCHES = "m AS (SELECT DISTINCT user_id FROM ev UNION ALL SELECT -1)"
RULES = ", ".join(f"('{r}', '{o}')" for r, o in consistency.OWNERS.items())
REPORT = f"""{FACTS}, {MATCHES}, c AS (SELECT user_id, rule, count_if(outcome = 'checked') AS checked, count_if(outcome = 'skipped') AS skipped, count_if(outcome = 'violation') AS violations, sum(blocking)::BIGINT AS blocking FROM facts GROUP BY ALL),
why AS (SELECT user_id, rule, string_agg(code || ':' || n, ',' ORDER BY code) AS skip_reasons FROM (SELECT user_id, rule, code, count(*) AS n FROM facts WHERE outcome = 'skipped' GROUP BY ALL) GROUP BY ALL),
r AS (SELECT m.user_id, v.rule, v.owner, coalesce(checked, 0) AS checked, coalesce(skipped, 1) AS skipped, coalesce(violations, 0) AS violations, coalesce(blocking, 0) AS blocking,
  CASE WHEN c.rule IS NOT NULL THEN coalesce(skip_reasons, '') WHEN m.user_id = -1 THEN 'state_frames_absent:1' ELSE 'no_applicable_observations:1' END AS skip_reasons
  FROM m CROSS JOIN (VALUES {RULES}) v(rule, owner) LEFT JOIN c ON c.user_id = m.user_id AND c.rule = v.rule LEFT JOIN why ON why.user_id = m.user_id AND why.rule = v.rule)"""


def reported(t: Tables):
    matches = t.ev.select("user_id").unionByName(t.spark.sql("SELECT CAST(-1 AS BIGINT) AS user_id"))
    return consistency.report(checked(t)[0], matches, ["user_id"])


@query("dq02_report", REPORT + " SELECT *, CASE WHEN violations > 0 THEN 'violations' WHEN skipped > 0 AND checked > 0 THEN 'partial' WHEN skipped > 0 THEN 'skipped' ELSE 'checked' END AS status FROM r")
def _(t: Tables):
    return reported(t).withColumn("skip_reasons", F.array_join(F.transform("skip_reasons", lambda s: F.concat(s["code"], F.lit(":"), s["n"].cast("string"))), ","))


@query("dq02_match_status", REPORT + " SELECT user_id, CASE WHEN max(violations) > 0 THEN 'violations' WHEN max(skipped) > 0 THEN 'partial' ELSE 'checked' END AS status, sum(violations)::BIGINT AS violations, sum(skipped)::BIGINT AS skipped FROM r GROUP BY 1")
def _(t: Tables):
    return consistency.match_status(reported(t), ["user_id"])
