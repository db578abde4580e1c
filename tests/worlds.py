"""Made-up traffic for tests: objects that drive legs of constant velocity, filmed at any frame rate."""
from __future__ import annotations

from dataclasses import dataclass, field
from math import cos, pi, sin

import pandas as pd

WIDTH, HEIGHT = 1600, 900
ROAD = [[0, 340], [WIDTH, 340], [WIDTH, 860], [0, 860]]
SIZES = {0: (40.0, 110.0), 2: (120.0, 90.0), 16: (60.0, 45.0)}
RAW = "video_id long, ord long, frame long, t double, t_us long, track_id long, cls int, conf double, x1 double, y1 double, x2 double, y2 double"


@dataclass
class Mover:
    """Appears at ``at`` (ground point) ``begin`` seconds in and drives legs of (seconds, px/s right, px/s down)."""

    at: tuple[float, float]
    legs: list[tuple[float, float, float]]
    cls: int = 2
    begin: float = 0.0

    def boxes(self, step: float):
        w, h = SIZES[self.cls]
        total = sum(s for s, _, _ in self.legs)
        frame = -(-int(self.begin * 1e6) // int(step * 1e6))
        while frame * step <= self.begin + total + 1e-9:
            left, x, y = frame * step - self.begin, *self.at
            for s, dx, dy in self.legs:
                part = min(max(left, 0.0), s)
                x, y, left = x + dx * part, y + dy * part, left - s
            yield frame, x - w / 2, y - h, x + w / 2, y
            frame += 1


def arc(radius: float, start: float, sweep: float, seconds: float, parts: int = 24) -> list[tuple[float, float, float]]:
    """Legs along a circle; angles in half turns, 0 = right, growing downwards."""
    out, speed = [], radius * abs(sweep) * pi / seconds
    for i in range(parts):
        a = (start + sweep * (i + 0.5) / parts) * pi
        way = 1 if sweep > 0 else -1
        out.append((seconds / parts, -way * sin(a) * speed, way * cos(a) * speed))
    return out


@dataclass
class World:
    movers: list[Mover]
    seconds: float
    fps: float = 15.0
    scene: dict = field(default_factory=dict)
    lights: list[tuple[str, float, float, str]] = field(default_factory=list)


def detections(video: int, w: World) -> list[tuple]:
    step = 1 / w.fps
    return [(video, k * 1_000_000 + f, f, f * step, round(f * step * 1e6), k, m.cls, 0.8, *box) for k, m in enumerate(w.movers, 1) for f, *box in m.boxes(step) if f < w.seconds * w.fps]


def base_tables(spark, worlds: list[World]):
    """Raw detections, frames and videos of the worlds, one video each."""
    raw = pd.DataFrame([r for v, w in enumerate(worlds) for r in detections(v, w)], columns=[c.split()[0] for c in RAW.split(", ")])
    clock = [(v, f, f, f / w.fps, round(f / w.fps * 1e6)) for v, w in enumerate(worlds) for f in range(int(w.seconds * w.fps))]
    videos = spark.createDataFrame([(v, float(w.fps), WIDTH, HEIGHT, float(w.seconds)) for v, w in enumerate(worlds)], "video_id long, fps double, width int, height int, duration double")
    return spark.createDataFrame(raw, RAW), spark.createDataFrame(clock, "video_id long, frame long, pos long, t double, t_us long"), videos


def rule_tables(spark, worlds: list[World]):
    from functools import reduce

    from curbstream.operators import scene as sc
    from curbstream.operators.tracks import build_tracks
    from curbstream.plans.rules import Tables
    from curbstream.session import stage
    from curbstream.sources.documents import scene_shapes, shapes_for_videos

    raw, clock, videos = base_tables(spark, worlds)
    tracks = build_tracks(raw, clock, videos)
    drawn = []
    for v, w in enumerate(worlds):
        shapes, moves, right = scene_shapes(spark, {"normalized": False, "image_size": [WIDTH, HEIGHT], "carriageway": [ROAD], **w.scene})
        one = videos.filter(f"video_id = {v}")
        drawn.append(sc.scene_rows(shapes_for_videos(shapes, one), one, moves, right))
    lights = [(v, k, round(a * 1e6), round(b * 1e6), s) for v, w in enumerate(worlds) for k, a, b, s in w.lights]
    phases = spark.createDataFrame(lights, "video_id long, signal_id string, t0_us long, t1_us long, state string")
    scene = stage(reduce(lambda a, b: a.unionByName(b), drawn), "scene")
    return Tables(tracks, clock, videos, scene, stage(sc.learn(tracks), "cells"), stage(sc.flow_votes(tracks), "votes"), stage(phases, "phases"))
