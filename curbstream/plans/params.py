"""Parameters of the event rules, the post-processing and the risk model."""
from __future__ import annotations

import copy
import json
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The official event classes.
CLASSES = [
    "accident", "near_miss", "red_light", "wrong_way", "illegal_u_turn", "stopped_vehicle", "jaywalking",
    "failure_to_yield", "illegal_turn", "solid_line_crossing", "stop_line", "congestion", "road_obstacle", "fire_smoke",
]

# Object class ids.
PERSON, TWO_WHEELERS, VEHICLES, ROAD_USERS = 0, (1, 3), (2, 3, 5, 7), (0, 1, 2, 3, 5, 7)
ANIMALS, OBJECTS, ADMITTED = (16, 17, 18, 19), (28,), (0, 1, 2, 3, 5, 7, 16, 17, 18, 19, 24, 26, 28)

# Post-processing defaults and per-class settings.
POST_DEFAULTS = {"merge_gap": 2.0, "min_len": 1.0, "start_offset": 0.0, "end_offset": 0.0, "min_confidence": 0.5}

EVENTS: dict[str, dict] = {
    "stopped_vehicle": dict(
        enabled=True, min_confidence=0.5, merge_gap=2.0, min_len=10.0, stop_speed=0.1, go_speed=0.3, go_sec=1.0, min_stationary_sec=10.0,
        moving_speed=0.5, require_moving_before=True, moved_before_bl=3.0, lone_min_sec=60.0, pass_radius_bl=4.0, link_gap_sec=5.0,
        link_iou=0.6, queue_max_sec=120.0, exclude_classes=[5], min_size_frac=0.04,
    ),
    "congestion": dict(
        enabled=True, min_confidence=0.5, merge_gap=5.0, min_len=15.0, bin_sec=1.0, speed_thr=0.2, min_vehicles=6, capacity_frac=0.6,
        min_len_sec=15.0, min_len_no_signal_sec=60.0, green_overlap_sec=10.0, moving_speed=0.5,
    ),
    "jaywalking": dict(
        enabled=True, min_confidence=0.5, merge_gap=2.0, min_len=1.0, min_sec=1.5, merge_gap_sec=2.0, edge_margin_bl=0.5,
        crosswalk_buffer_bl=0.6, vehicle_exit_bl=2.0, min_depth_bl=1.0, min_size_frac=0.03, min_move_bl=1.5, walk_speed_max=3.0,
    ),
    "wrong_way": dict(
        enabled=True, min_confidence=0.5, merge_gap=2.0, min_len=1.5, min_speed=0.5, cos_thr=-0.5, min_sec=1.5, min_strength=0.6,
        min_displacement_bl=2.0, min_median_speed=0.8, min_real_frac=0.7, reversal_window_sec=3.0,
    ),
    "accident": dict(
        enabled=True, min_confidence=0.6, merge_gap=5.0, min_len=1.0, v_min=0.8, drop_ratio=0.35, dv_min=0.8, heading_jump_deg=40.0,
        contact_iou=0.05, contact_pre_sec=1.0, contact_post_sec=0.5, still_speed=0.15, still_sec=3.0, confirm_window_sec=8.0,
        person_window_sec=20.0, person_radius_bl=2.0, max_len_sec=60.0, min_closing_bl=1.0, max_plausible_speed_bl=8.0, min_real_frac=0.6,
        reaction_dv_bl=0.6, deflection_deg=30.0, impact_confidence=0.6, lost_window_sec=1.0, fragment_radius_bl=3.0, fragment_gap_sec=3.0,
    ),
    "near_miss": dict(
        enabled=True, min_confidence=0.75, merge_gap=2.0, min_len=0.5, ttc_thr=1.0, brake_decel=1.5, brake_k_sigma=4.0, swerve_deg=25.0,
        swerve_percentile=99.5, max_dist_bl=6.0, min_speed=0.5, min_closing_bl=1.0, min_hits=2, motor_classes=[2, 3, 5, 7],
        min_size_frac=0.05, min_track_sec=1.5, max_plausible_speed_bl=8.0, min_real_frac=0.7, brake_drop_ratio=0.6, clear_ttc=3.0,
        max_len_sec=6.0, horizon_sec=3.0, queue_leader_speed=0.5,
    ),
    "red_light": dict(
        enabled=True, min_confidence=0.5, merge_gap=1.0, min_len=0.5, grace_sec=0.5, clear_bl=4.0, before_bl=0.3, after_bl=1.0,
        cross_window_sec=3.0, min_speed=0.5, max_len_sec=8.0, right_turn_deg=60.0,
    ),
    "stop_line": dict(
        enabled=True, min_confidence=0.5, merge_gap=2.0, min_len=2.0, stop_speed=0.1, min_stop_sec=2.0, min_past_bl=0.4, max_past_bl=3.0,
    ),
    "failure_to_yield": dict(
        enabled=True, min_confidence=0.6, merge_gap=1.0, min_len=0.3, min_speed=0.5, near_bl=1.5, min_sec=0.3, max_len_sec=6.0,
        vehicle_classes=[2, 5, 7], walk_speed_min=0.15, walk_speed_max=3.0,
    ),
    "solid_line_crossing": dict(enabled=True, min_confidence=0.5, merge_gap=1.0, min_len=0.3, hold_sec=1.0, min_speed=0.3, footprint_frac=0.35),
    "illegal_u_turn": dict(
        enabled=True, min_confidence=0.6, merge_gap=2.0, min_len=1.0, illegal_everywhere=False, u_turn_deg=150.0, min_speed=0.3,
        start_deg=15.0, settle_rate=10.0,
    ),
    "illegal_turn": dict(enabled=True, min_confidence=0.6, merge_gap=2.0, min_len=1.0, u_turn_deg=150.0, min_speed=0.3, start_deg=15.0, settle_rate=10.0),
    "road_obstacle": dict(
        enabled=True, min_confidence=0.6, merge_gap=3.0, min_len=3.0, animal_min_sec=3.0, object_min_sec=5.0, person_pad_bl=1.0,
        blob_enabled=False, blob_diff=30, blob_min_sec=5.0, blob_min_area_frac=0.0015, blob_confidence=0.5,
    ),
    "fire_smoke": dict(enabled=False, min_confidence=0.5, merge_gap=3.0, min_len=3.0, min_area_frac=0.002, flicker_thr=12.0, min_sec=3.0),
}

# The values below are fixed: results depend on them.
TRACKER = dict(
    max_jump_speed_bl=20.0, max_size_ratio=1.8, min_track_sec=1.0, max_interp_gap_sec=1.0, reliable_min_conf=0.4, reliable_min_size_frac=0.025,
    min_det_conf=0.1, savgol_window_sec=1.0,
)
SCENE = dict(
    grid_cols=64, road_min_tracks=2, road_min_frac=0.0, road_close=2, road_dilate=1, flow_min_tracks=3, flow_blur=1, moving_speed=0.5,
    auto_crosswalks=True, crosswalk_min_persons=4, queue_wait_sec=3.0, queue_min_tracks=3, queue_still_speed=0.15,
)
RISK = dict(
    target_hz=8.33, ema_alpha=0.3, peak_hold_sec=1.0, floor=0.01, floor_density=0.04, ttc_tau=1.5, ttc_max=2.0, horizon_sec=3.0,
    pair_dist_bl=6.0, min_closing_bl=1.0, closing_window_sec=1.0, conflict_memory_sec=1.5, min_size_frac=0.03, min_age_sec=1.0,
    min_track_conf=0.4, brake_ref=2.0, swerve_ref_deg_s=90.0, noise_k=3.0, density_norm=20, wrong_min_strength=0.6, stop_decel=1.0,
    road_min_obs=5, flow_min_support=30, queue_wait_sec=3.0, queue_min_tracks=3, queue_leader_speed=0.5,
)
RISK_WEIGHTS = dict(bias=-6.0, f_ttc=9.0, f_brake=0.0, f_swerve=0.0, f_conflict=1.0, f_wrong=2.5, f_redrun=0.0, f_ped=1.0, f_density=-3.0)
FEATURES = ["f_ttc", "f_brake", "f_swerve", "f_conflict", "f_wrong", "f_redrun", "f_ped", "f_density"]


def overlay(base: Mapping, extra: Mapping | None) -> dict:
    """Recursive overlay of nested settings; lists and scalars are replaced."""
    out = copy.deepcopy(dict(base))
    for k, v in (extra or {}).items():
        out[k] = overlay(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else copy.deepcopy(v)
    return out


def risk_weights(settings: Mapping | None = None, path: str | None = None) -> dict[str, float]:
    """Weights: defaults, then settings, then a JSON file when it exists."""
    w = {**RISK_WEIGHTS, **(settings or {})}
    if path:
        try:
            with open(path, encoding="utf-8") as f:
                w.update(json.load(f))
        except FileNotFoundError:
            pass
    return w


def class_params(events: Mapping[str, Mapping], label: str) -> dict[str, float]:
    """Post-processing values of a class: defaults, then the class, then its ``post`` block."""
    ev = events.get(label) or {}
    out = dict(POST_DEFAULTS)
    for source in (ev, ev.get("post") or {}):
        out.update({k: float(source[k]) for k in POST_DEFAULTS if k in source})
    return out


def class_param(events: Mapping[str, Mapping], name: str, label: str = "label") -> Column:
    """The post-processing value of each row's class as a column (a literal lookup, no join)."""
    e = None
    for c in sorted(set(CLASSES) | set(events)):
        v = F.lit(class_params(events, c)[name])
        e = F.when(F.col(label) == c, v) if e is None else e.when(F.col(label) == c, v)
    return e.otherwise(F.lit(POST_DEFAULTS[name]))


def sec(x: float) -> int:
    """Seconds as microseconds."""
    return int(round(x * 1e6))
