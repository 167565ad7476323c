"""Table contracts of the stages (types of the stored columns)."""

from __future__ import annotations

from pyspark.sql.types import StructType

_DDL = {
    "detections": "job_id string, frame_idx int, ts_ms bigint, det_idx int, cls tinyint, x1 float, y1 float, x2 float, y2 float, conf float, track_id int, is_detected boolean, court_x float, court_y float, court_conf float",
    "tracklets": "job_id string, track_id int, cls tinyint, frame_start int, frame_end int, ts_start_ms bigint, ts_end_ms bigint, n_detections int, mean_conf float",
    "court_frames": "job_id string, frame_idx int, ts_ms bigint, h array<double>, residual_ft float, n_points int",
    "entities": "job_id string, track_id int, entity_id int, team_cluster tinyint",
    "identity": "job_id string, track_id int, candidate string, prob float, bound_at_stage string, bound_at_frame int",
    "evidence": "job_id string, track_id int, frame_idx int, source_kind string, value_json string, weight float",
    "positions": "job_id string, frame_idx int, ts_ms bigint, cls tinyint, entity_id int, team_cluster tinyint, court_x float, court_y float, court_conf float",
    "ball_controls": "job_id string, frame_idx int, ts_ms bigint, entity_id int, team_cluster tinyint, court_x float, court_y float, ball_x float, ball_y float, dist_ft float, interpolated boolean",
    "atomic_events": "job_id string, event_id int, event_type string, frame_idx int, ts_ms bigint, entity_id int, team_cluster tinyint, court_x float, court_y float, possession_id int, payload_json string",
    "possessions": "job_id string, possession_id int, frame_start int, frame_end int, ts_start_ms bigint, ts_end_ms bigint, offense_team_cluster tinyint, outcome string",
    "shot_events": "job_id string, event_id int, frame_start int, frame_end int, ts_start_ms bigint, ts_end_ms bigint, court_end string, n_ball_obs int, verdict_attempt boolean, verdict_made boolean, confidence float, rationale string",
    "tokens": "game_key string, token_idx bigint, t_ms bigint, channel string, entity_id int, team_cluster tinyint, court_x float, court_y float, value float, text string, conf float, period tinyint, payload_json string",
}


def stage_schema(name: str) -> StructType:
    return StructType.fromDDL(_DDL[name])
