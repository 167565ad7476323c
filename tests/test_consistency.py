"""DQ-02 on literal states: what is unknown is skipped, what is wrong names its frame, key and evidence."""

import math

import pytest

from fieldtrace.operators import consistency as c


def frame(seq=1, frame_id=None, t=0.0, shot=0, players=None, balls=None, **more):
    base = {"seq": seq, "frame_id": seq if frame_id is None else frame_id, "timestamp_s": t, "shot_id": shot, "calibration_usable": None, "position_origin": None, "source_kind": None,
            "has_players": players is not None, "has_balls": balls is not None, "possession": None, "orientation": None} | more
    rows = [(seq, i, kind, *[e.get(k) for k in ("evidence_id", "tracklet_id", "identity", "team", "xy", "position_status")]) for kind, es in (("player", players or []), ("ball", balls or [])) for i, e in enumerate(es)]
    return base, rows


def run_all(spark, cases, source=None, fits=None, **config):
    """{case: (violations, rules, boundaries, blocked frames)}: each case is a match, all are checked in one plan."""
    heads = spark.createDataFrame([(m, *h.values()) for m, frames in cases.items() for h, _ in frames], f"match string, {c.FRAMES}")
    bodies = spark.createDataFrame([(m, *r) for m, frames in cases.items() for _, rows in frames for r in rows], f"match string, {c.ENTITIES}")
    src = None if source is None else spark.createDataFrame([(m, *r) for m, rows in source.items() for r in rows], "match string, frame_id long, timestamp_s double, shot_id long")
    cal = None if fits is None else spark.createDataFrame([(m, *r) for m, rows in fits.items() for r in rows], "match string, frame_id long, accepted boolean")
    facts, breaks = c.check_state(heads, bodies, ["match"], src, cal, **config)
    facts = facts.cache()
    out = {m: ([], {}, [], []) for m in cases}
    for r in facts.filter("outcome = 'violation'").collect():
        out[r["match"]][0].append(r)
    for r in c.report(facts, heads, ["match"]).collect():
        out[r["match"]][1][r["rule"]] = r
    for r in breaks.orderBy("match", "seq").collect():
        out[r["match"]][2].append(r)
    for r in c.blocked_frames(facts, ["match"]).orderBy("frame_id").collect():
        out[r["match"]][3].append(r["frame_id"])
    return out


def run(spark, *frames, **config):
    return run_all(spark, {"m": frames}, **config)["m"]


def codes(result):
    return {r["code"] for r in result[0]}


def player(track="3", name="Alex", xy=None, ref="p1", **more):
    return {"tracklet_id": track, "identity": name, "xy": xy, "evidence_id": ref, "team": "0"} | more


def test_missing_channels_are_unknown(spark):
    found, rules, _, blocked = run(spark, frame())
    assert not found and not blocked
    for r in ("simultaneous_tracks", "geometry", "ball_possession", "orientation", "source_alignment"):
        assert rules[r]["status"] == "skipped" and rules[r]["skip_reasons"]
    assert rules["frame_clock"]["status"] == "checked"
    matches = spark.createDataFrame([("m",)], "match string")
    heads = spark.createDataFrame([], f"match string, {c.FRAMES}")
    facts, _ = c.check_state(heads, spark.createDataFrame([], f"match string, {c.ENTITIES}"), ["match"])
    empty = c.report(facts, matches, ["match"]).collect()
    assert len(empty) == 11 and all(r["status"] == "skipped" and r["skip_reasons"][0]["code"] == "state_frames_absent" for r in empty)
    assert c.match_status(c.report(facts, matches, ["match"]), ["match"]).first()["status"] == "partial"


def test_duplicates_and_motion(spark):
    still, far = [player(xy=[0.0, 0.0])], [player(xy=[1000.0, 1000.0])]
    cases = {"twice": [frame(players=[player(xy=[5.0, 6.0]), player(xy=[7.0, 8.0], ref="p2")])], "cut": [frame(1, t=0.0, players=still), frame(2, t=0.2, shot=1, players=far)],
             "fast": [frame(1, t=0.0, players=still), frame(2, t=0.2, players=[player(xy=[10.0, 0.0])])], "slow": [frame(1, t=0.0, players=still), frame(2, t=0.2, players=[player(xy=[3.0, 0.0])])]}
    got = run_all(spark, cases, max_speed_m_s=20.0)
    issue = next(r for r in got["twice"][0] if r["rule"] == "simultaneous_tracks")
    assert issue["key"] == "shot:0:tracklet:3" and set(issue["evidence_ids"]) == {"p1", "p2"} and got["twice"][1]["simultaneous_tracks"]["owner"] == "players"
    assert {"duplicate_simultaneous_tracklet", "duplicate_simultaneous_identity"} == codes(got["twice"]) and got["twice"][3] == [1]
    assert not codes(got["cut"]) and [(b["frame_id"], b["reason"], b["previous_frame_id"]) for b in got["cut"][2]] == [(2, "camera_cut", 1)]
    assert codes(got["fast"]) == {"configured_speed_diagnostic_exceeded"} and not got["fast"][0][0]["blocking"] and not got["fast"][3] and not codes(got["slow"])


def test_geometry_calibration_and_bounds(spark):
    bad = {f"bad{i}": [frame(players=[player(xy=xy)])] for i, xy in enumerate([[math.nan, 2.0], [1.0, math.inf], [1.0], [None, 2.0]])}
    here = {"players": [player(xy=[2.0, 3.0])]}
    cases = bad | {"rejected": [frame(**here, calibration_usable=False)], "provider": [frame(**here, position_origin="provider_tracking", calibration_usable=True)], "out": [frame(players=[player(xy=[-1.0, 20.0])])]}
    fits = {"none": [], "one": [(1, True)], "refused": [(1, False)], "two": [(1, True), (1, True)]}
    cases |= {f"fit_{k}": [frame(**here, calibration_usable=True)] for k in fits}
    got = run_all(spark, cases, fits={f"fit_{k}": v for k, v in fits.items()}, bounds=(0, 104, 0, 68))
    assert all(codes(got[k]) == {"invalid_position"} and got[k][3] == [1] and got[k][1]["pitch_bounds"]["status"] == "skipped" for k in bad)
    assert codes(got["rejected"]) == {"position_with_rejected_calibration"}
    assert {k: bool(codes(got[f"fit_{k}"])) for k in fits} == {"none": True, "one": False, "refused": True, "two": True}
    assert codes(got["fit_none"]) == {"position_without_unique_accepted_source_calibration"}
    assert not codes(got["provider"]) and got["provider"][1]["calibration_gate"]["status"] == "skipped"
    assert codes(got["out"]) == {"outside_explicit_pitch_bounds"} and got["out"][3] == []
    assert run(spark, *cases["out"], rules=c.GEOMETRY)[1]["pitch_bounds"]["status"] == "skipped"
    for config in ({"bounds": (5, 1, 0, 1)}, {"max_gap_s": -1.0}):
        with pytest.raises(ValueError):
            run(spark, frame(), **config)


def test_source_mapping_and_clock(spark):
    cases = {"moved": [frame(t=0.2, shot=2)], "absent": [frame()], "time": [frame(1, t=0.0), frame(2, t=0.2), frame(3, t=2.0), frame(4, t=1.0)],
             "again": [frame(1), frame(2, frame_id=1, t=1.0)], "nan": [frame(1, t=math.nan)]}
    source = {k: [(f["frame_id"], f["timestamp_s"], f["shot_id"]) for f, _ in v[-1:]] + [(1, 0.0, 0), (2, 0.2, 0), (3, 2.0, 0)] * (k == "time") for k, v in cases.items()}
    source |= {"moved": [(1, 0.1, 1)], "absent": [(9, 0.0, 0)]}
    got = run_all(spark, cases, source=source, max_gap_s=0.3)
    assert codes(got["moved"]) == {"source_clock_or_camera_mismatch"} and codes(got["absent"]) == {"frame_absent_from_source"}
    assert [b["frame_id"] for b in got["time"][2]] == [3, 4] and got["time"][3] == [4] and codes(got["time"]) == {"nonincreasing_source_time"}
    assert "invalid_or_duplicate_frame_clock" in codes(got["again"]) and codes(got["nan"]) == {"invalid_or_duplicate_frame_clock"}


def claim(status="hypothesis", *hypotheses):
    return ("0", status, list(hypotheses))


def test_possession_needs_one_ball_and_its_own_player(spark):
    near = ("0", "nearest_player_proxy", ["p1", "b1"])
    one, two = [{"evidence_id": "b1", "xy": [1.0, 2.0]}], [{"evidence_id": "b1", "xy": [1.0, 2.0]}, {"evidence_id": "b2", "xy": [8.0, 9.0]}]
    here = lambda balls, poss, **more: [frame(players=[player(xy=[1.0, 1.0])], balls=balls, possession=poss, **more)]
    cases = {"clear": here(one, claim("hypothesis", near)), "two": here(two, claim("hypothesis", near)), "review": here(two, claim("reviewed", near, ("0", "review", ["p1"]))),
             "unreviewed": here(one, claim("reviewed", near)), "other": here(one, claim("hypothesis", ("0", "nearest_player_proxy", ["other", "b1"]))),
             "guess": here([one[0] | {"position_status": "estimated"}], claim("hypothesis", near)), "provider": here(two, claim("hypothesis", ("0", "provider", ["x"])), source_kind="provider"), "open": here(one, (None, "hypothesis", []))}
    got = {k: codes(v) for k, v in run_all(spark, cases, rules=["ball_possession"]).items()}
    unclear = {"unsupported_or_ambiguous_possession"}
    assert got == {"clear": set(), "two": unclear, "review": set(), "unreviewed": {"reviewed_possession_without_review_evidence"}, "other": unclear, "guess": unclear, "provider": set(), "open": set()}


def test_orientation_counts_with_support(spark):
    team = lambda name, value, source, ids: (name, value, [(value, source, ids)])
    cases = {"unresolved": [frame(orientation=[team(t, 1, "unresolved", ["p"]) for t in "01"])], "same": [frame(orientation=[team(t, 1, "review", ["p1"]) for t in "01"])],
             "opposed": [frame(orientation=[team("0", 1, "review", ["p1"]), team("1", -1, "review", ["p1"])])], "two": [frame(orientation=[team("0", 2, "review", ["p1"])])]}
    got = run_all(spark, cases, rules=["orientation"])
    assert got["unresolved"][1]["orientation"]["status"] == "skipped"
    assert {k: codes(v) for k, v in got.items()} == {"unresolved": set(), "same": {"opponents_share_attacking_direction"}, "opposed": set(), "two": {"invalid_orientation"}}


def test_hot_match_gives_the_same_pairs(spark):
    frames = [frame(i, t=float(i // 2), shot=i // 7) for i in range(1, 60)]
    heads = spark.createDataFrame([("m", *h.values()) for h, _ in frames], f"match string, {c.FRAMES}")
    plain = sorted(map(str, c.boundaries(c.paired(heads, ["match"], 0.5), ["match"]).collect()))
    assert plain == sorted(map(str, c.boundaries(c.paired(heads, ["match"], 0.5, hot_rows=10), ["match"]).collect())) and plain
