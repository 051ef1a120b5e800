"""Declared schemas of all stored data; nothing is inferred."""

BOX = "struct<x:int,y:int,w:int,h:int>"
DETAIL = "map<string,struct<first_seen_ts:double,first_decode_ts:double,last_seen_ts:double,decode_count:int>>"
DECODE = f"payload string, symbology string, roi {BOX}, frame_index bigint, ts double, source_id string, decoder string, latency_ms double"
SEGMENT_EVENT = "kind string, candidate_id string, frame_index bigint, ts double"
FRAME = "image binary, h int, w int, ts double, frame_index bigint, source_id string, discontinuity boolean"
PASS_EVENT = f"payload string, symbology string, first_seen_ts double, last_seen_ts double, decode_count int, cameras map<string,int>, best_frame array<string>, candidate_ids array<string>, event_id string, wall_time_iso string, first_decode_ts double, camera_detail {DETAIL}, revision int"
MISS_EVENT = "candidate_id string, source_id string, start_ts double, end_ts double, first_frame bigint, last_frame bigint, evidence_dir string, evidence_frame_count int, event_id string, wall_time_iso string, evidence_error string"
#: Both kinds of event in one row, and where a line couldn't be read, its text.
EVENT = f"kind string, {PASS_EVENT}, {MISS_EVENT.replace('event_id string, wall_time_iso string, ', '')}, _corrupt_record string"
TRUTH = "pass_id int, payload string, symbology string, first_frame bigint, last_frame bigint"
RESTART = "ts string, exit_code int, runtime_s double, delay_s double, reason string"
SNAPSHOT = "wall double, uptime_s double, fps double, read_rate_1h double, passes_per_hour double, decode_p50_ms double, decode_p95_ms double, frames_dropped bigint, frames_errors bigint, rss_mb double"
LOG = "ts string, level string, logger string, msg string, exc string, stats string"
BURST = "schema string, candidate_id string, frame_count int, frame_indices array<bigint>, ts_range array<double>, written_utc string, source_id string, segment_frames array<bigint>, segment_ts array<double>, reason string, outcome string, payloads array<string>, symbologies array<string>, tracking string, engine string, roi array<int>"
INJECT = "exposure_ms double, decoded boolean, blur_modules double, blur_px double, speed_mph double, px_per_module double, angle_deg double, contrast double, noise_sigma double, occlusion_frac double, direction string, modules int"
SYMBOLOGIES = ["qr", "datamatrix"]
VERSION = 2
