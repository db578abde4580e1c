"""Drawn scene geometry and the grids learned from the tracks of each video.

A drawn scene is one small row per video (arrays of shapes), so its tests are plain column expressions.
A learned grid has at most 64 columns, a few thousand cells per video.
"""
from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbstream.functions import geometry as geo
from curbstream.operators.quantiles import exact_quantiles
from curbstream.plans.params import PERSON, SCENE, VEHICLES, sec

CELL = ["video_id", "iy", "ix"]


def grid_cell(cols: int = SCENE["grid_cols"]) -> Column:
    return F.greatest(F.lit(4.0), F.col("width") / F.lit(float(cols)))


def grid_size(cols: int = SCENE["grid_cols"]) -> tuple[Column, Column]:
    """Rows and columns of the grid of a video."""
    cell = grid_cell(cols)
    return F.ceil(F.col("height") / cell).cast("int"), F.ceil(F.col("width") / cell).cast("int")


def with_cell(df: DataFrame, x: str = "foot_x", y: str = "foot_y", cols: int = SCENE["grid_cols"]) -> DataFrame:
    gh, gw = grid_size(cols)
    return df.withColumns({"iy": geo.cell_of(y, grid_cell(cols), gh), "ix": geo.cell_of(x, grid_cell(cols), gw)})


def spread(df: DataFrame, reach: int = 1) -> DataFrame:
    """Copy each cell row to the cells within ``reach`` that lie in the grid (``gh`` by ``gw``)."""
    off = F.sequence(F.lit(-reach), F.lit(reach))
    d = df.withColumn("__dy", F.explode(off)).withColumn("__dx", F.explode(off))
    d = d.withColumns({"iy": F.col("iy") + F.col("__dy"), "ix": F.col("ix") + F.col("__dx")}).drop("__dy", "__dx")
    return d.filter((F.col("iy") >= 0) & (F.col("iy") < F.col("gh")) & (F.col("ix") >= 0) & (F.col("ix") < F.col("gw")))


def dilate(cells: DataFrame, steps: int) -> DataFrame:
    """Binary dilation with a 3x3 square, ``steps`` times."""
    return spread(cells.select(*CELL, "gh", "gw"), steps).distinct() if steps else cells


def erode(cells: DataFrame, steps: int) -> DataFrame:
    """Binary erosion with a 3x3 square, ``steps`` times; cells outside the grid count as empty."""
    full = (2 * steps + 1) ** 2
    return spread(cells.select(*CELL, "gh", "gw"), steps).groupBy(*CELL, "gh", "gw").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == full).drop("n")


def close_open(cells: DataFrame, close: int, dilate_by: int) -> DataFrame:
    return dilate(erode(dilate(cells, close), close), dilate_by)


def _grid(pdf: pd.DataFrame) -> np.ndarray:
    g = np.zeros((int(pdf["gh"].iloc[0]), int(pdf["gw"].iloc[0])), dtype=bool)
    g[pdf["iy"], pdf["ix"]] = True
    return g


def _rows(pdf: pd.DataFrame, mask: np.ndarray, **extra) -> pd.DataFrame:
    iy, ix = np.nonzero(mask)
    out = pd.DataFrame({"video_id": pdf["video_id"].iloc[0], "iy": iy.astype(np.int32), "ix": ix.astype(np.int32), "gh": pdf["gh"].iloc[0], "gw": pdf["gw"].iloc[0]})
    for k, a in extra.items():
        out[k] = a[iy, ix]
    return out


def _fill(pdf: pd.DataFrame) -> pd.DataFrame:
    road = _grid(pdf)
    # Flood the empty cells from a ring around the grid; what stays dry is a hole.
    wet = np.pad(np.zeros_like(road), 1, constant_values=True)
    free = np.pad(~road, 1, constant_values=True)
    while True:
        grown = wet.copy()
        grown[1:] |= wet[:-1]
        grown[:-1] |= wet[1:]
        grown[:, 1:] |= wet[:, :-1]
        grown[:, :-1] |= wet[:, 1:]
        grown &= free
        if (grown == wet).all():
            return _rows(pdf, ~wet[1:-1, 1:-1])
        wet = grown


def fill_holes(cells: DataFrame) -> DataFrame:
    """Fill empty cells that no 4-connected path joins to the outside. One video's grid is a few thousand cells."""
    return cells.groupBy("video_id").applyInPandas(_fill, cells.select(*CELL, "gh", "gw").schema)


def _depth(pdf: pd.DataFrame) -> pd.DataFrame:
    road = _grid(pdf)
    zy, zx = np.nonzero(~np.pad(road, 1))
    iy, ix = np.nonzero(road)
    d = np.zeros(road.shape)
    for y, x in zip(iy, ix):
        d[y, x] = np.sqrt(((zy - 1 - y) ** 2 + (zx - 1 - x) ** 2).min())
    return _rows(pdf, road, depth_cells=d)


def road_depth(road: DataFrame) -> DataFrame:
    """Distance (in cells) of each road cell to the nearest cell off the road, the frame border included."""
    schema = road.select(*CELL, "gh", "gw").withColumn("depth_cells", F.lit(0.0)).schema
    return road.groupBy("video_id").applyInPandas(_depth, schema)


def cell_visits(tracks: DataFrame, out: str, cols: int = SCENE["grid_cols"]) -> DataFrame:
    """Number of different tracks per cell."""
    gh, gw = grid_size(cols)
    d = with_cell(tracks, cols=cols).select(*CELL, gh.alias("gh"), gw.alias("gw"), "track_id").distinct()
    return d.groupBy(*CELL, "gh", "gw").agg(F.count(F.lit(1)).alias(out))


def vehicles(tracks: DataFrame) -> DataFrame:
    return tracks.filter(F.col("cls").isin(list(VEHICLES)))


def road_cells(tracks: DataFrame, cfg: Mapping = SCENE) -> DataFrame:
    """Cells several vehicle tracks drove through, closed, dilated and with holes filled."""
    veh = vehicles(tracks)
    visits = cell_visits(veh, "n", cfg["grid_cols"])
    n = veh.select("video_id", "track_id").distinct().groupBy("video_id").agg(F.count(F.lit(1)).alias("n_tracks"))
    need = F.greatest(F.lit(float(cfg["road_min_tracks"])), F.lit(cfg["road_min_frac"]) * F.col("n_tracks"))
    cells = visits.join(n, "video_id").filter(F.col("n") >= need).select(*CELL, "gh", "gw")
    return fill_holes(close_open(cells, cfg["road_close"], cfg["road_dilate"]))


def flow_votes(tracks: DataFrame, cfg: Mapping = SCENE) -> DataFrame:
    """One unit vote per vehicle track and cell: ``video_id, track_id, iy, ix, gh, gw, ux, uy``."""
    gh, gw = grid_size(cfg["grid_cols"])
    mv = with_cell(vehicles(tracks).filter(F.col("speed") > cfg["moving_speed"]), cols=cfg["grid_cols"])
    sp = F.greatest(geo.hypot(F.col("vx"), F.col("vy")), F.lit(1e-9))
    g = mv.groupBy(*CELL, gh.alias("gh"), gw.alias("gw"), "track_id").agg(F.sum(F.col("vx") / sp).alias("x"), F.sum(F.col("vy") / sp).alias("y"))
    n = geo.hypot(F.col("x"), F.col("y"))
    return g.filter(n > 1e-6).select(*CELL, "gh", "gw", "track_id", (F.col("x") / n).alias("ux"), (F.col("y") / n).alias("uy"))


def flow_field(votes: DataFrame, by: tuple = (), blur: int = SCENE["flow_blur"]) -> DataFrame:
    """Votes summed per cell and over the cells around it: ``CELL, by, fx, fy, fn``."""
    g = votes.groupBy(*CELL, "gh", "gw", *by).agg(F.sum("ux").alias("fx"), F.sum("uy").alias("fy"), F.count(F.lit(1)).alias("fn"))
    return spread(g, blur).groupBy(*CELL, *by).agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"), F.sum("fn").alias("fn"))


def direction(fx: Column, fy: Column, n: Column, min_support: float) -> tuple[Column, Column, Column]:
    """Unit direction and strength (0..1, 0 below the support) of summed votes."""
    d = F.greatest(n.cast("double"), F.lit(1e-9))
    mx, my = fx / d, fy / d
    coh = geo.hypot(mx, my)
    k = F.greatest(coh, F.lit(1e-9))
    return mx / k, my / k, F.when(n >= min_support, F.least(coh, F.lit(1.0))).otherwise(F.lit(0.0))


def queue_votes(tracks: DataFrame, cfg: Mapping = SCENE) -> DataFrame:
    """Median waiting position of each vehicle track that stood still for a while."""
    still = vehicles(tracks).filter(F.col("speed") < cfg["queue_still_speed"])
    key = ["video_id", "track_id"]
    g = still.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), (F.max("t_us") - F.min("t_us")).alias("span"), F.max("width").alias("width"), F.max("height").alias("height"))
    g = g.filter((F.col("n") >= 2) & (F.col("span") >= sec(cfg["queue_wait_sec"])))
    x = exact_quantiles(still, key, "foot_x", {"foot_x": 0.5}, 16.0).drop("n")
    y = exact_quantiles(still, key, "foot_y", {"foot_y": 0.5}, 16.0).drop("n")
    return g.drop("n", "span").join(x, key).join(y, key)


def queue_cells(tracks: DataFrame, cfg: Mapping = SCENE) -> DataFrame:
    v = cell_visits(queue_votes(tracks, cfg), "n", cfg["grid_cols"])
    return dilate(v.filter(F.col("n") >= cfg["queue_min_tracks"]), 2)


def crosswalk_cells(tracks: DataFrame, road: DataFrame, cfg: Mapping = SCENE) -> DataFrame:
    """Road cells many different pedestrians walked across."""
    ped = tracks.filter((F.col("cls") == PERSON) & ~F.col("rider") & (F.col("speed") > 0.2))
    v = cell_visits(ped, "n", cfg["grid_cols"]).filter(F.col("n") >= cfg["crosswalk_min_persons"])
    return dilate(v.join(road.select(*CELL), CELL, "left_semi"), 1)


def learn(tracks: DataFrame, cfg: Mapping = SCENE) -> DataFrame:
    """The learned grid: ``CELL, road, depth_cells, queue, crosswalk`` for the cells that carry anything."""
    road = road_cells(tracks, cfg)
    r = road_depth(road).select(*CELL, F.lit(True).alias("road"), "depth_cells")
    q = queue_cells(tracks, cfg).select(*CELL, F.lit(True).alias("queue"))
    out = r.join(q, CELL, "full")
    if cfg["auto_crosswalks"]:
        out = out.join(crosswalk_cells(tracks, road, cfg).select(*CELL, F.lit(True).alias("crosswalk")), CELL, "full")
    else:
        out = out.withColumn("crosswalk", F.lit(False))
    no = F.lit(False)
    return out.select(*CELL, F.coalesce("road", no).alias("road"), F.coalesce("depth_cells", F.lit(0.0)).alias("depth_cells"), F.coalesce("queue", no).alias("queue"), F.coalesce("crosswalk", no).alias("crosswalk"))


SHAPE_KINDS = ["carriageway", "non_road", "crosswalks", "queue_zones", "intersection", "fixed_objects", "no_u_turn_zones", "solid_lines", "lanes", "exit_zones", "stop_lines", "signal_rois"]


def scene_rows(shapes: DataFrame, videos: DataFrame, moves: list, right_turn_on_red: bool = False) -> DataFrame:
    """One row per video: an array of ``struct(ord, id, pts, signal, dir)`` per shape kind, in drawing order."""
    item = F.struct("ord", "id", "pts", "signal", "dir")
    aggs = [F.sort_array(F.collect_list(F.when(F.col("kind") == k, item))).alias(k) for k in SHAPE_KINDS]  # tens of shapes per video
    g = videos.select("video_id").join(shapes, "video_id", "left").groupBy("video_id").agg(*aggs)
    head = F.element_at(F.filter("signal_rois", lambda s: s["signal"] == "vehicle"), 1)
    g = g.withColumn("vehicle_signal", F.when(F.exists("signal_rois", lambda s: s["signal"] == "vehicle"), head["id"]))
    pairs = F.array(*[F.struct(F.lit(a).alias("entry"), F.lit(b).alias("exit")) for a, b in moves]) if moves else F.expr("CAST(array() AS ARRAY<STRUCT<entry: STRING, exit: STRING>>)")
    return g.withColumn("movements", pairs).withColumn("right_turn_on_red", F.lit(right_turn_on_red))


def in_any(x, y, shapes) -> Column:
    return F.exists(geo.c(shapes), lambda s: geo.poly_contains(x, y, s["pts"]))


def first_match(x, y, shapes) -> Column:
    """The first drawn shape that contains the point, null when none does."""
    hits = F.filter(geo.c(shapes), lambda s: geo.poly_contains(x, y, s["pts"]))
    return F.get(hits, F.lit(0))


def nearest_outline(x, y, shapes) -> Column:
    return F.array_min(F.transform(geo.c(shapes), lambda s: geo.line_distance(x, y, s["pts"], True)))


def drawn(kind: str) -> Column:
    return F.size(kind) > 0


def locate(df: DataFrame, scene: DataFrame, cells: DataFrame, x: str = "foot_x", y: str = "foot_y", kinds=("carriageway", "non_road", "crosswalks", "queue_zones")) -> DataFrame:
    """Add the scene arrays ``kinds`` and ``on_road``, ``road_px`` (distance to its edge), ``learned_crosswalk``, ``learned_queue``,
    ``has_road`` and ``has_crosswalks`` for the point (x, y). Drawn shapes come first, learned cells are the fallback.
    """
    has = cells.groupBy("video_id").agg(F.max("road").alias("__hr"), F.max("crosswalk").alias("__hc"))
    s = scene.join(has, "video_id", "left").select("video_id", *kinds, "__hr", "__hc")
    # Cells compress far below the planner's guess, which would broadcast those of all videos.
    d = with_cell(df.join(s, "video_id"), x, y).join(cells.hint("merge"), CELL, "left")
    road = F.when(drawn("carriageway"), in_any(x, y, "carriageway")).otherwise(F.coalesce("road", F.lit(False)))
    edge = F.least(nearest_outline(x, y, "carriageway"), nearest_outline(x, y, "non_road"))
    return d.withColumns(
        {
            "on_road": road & ~in_any(x, y, "non_road"),
            "road_px": F.when(drawn("carriageway"), F.when(road & ~in_any(x, y, "non_road"), edge).otherwise(0.0)).otherwise(F.coalesce("depth_cells", F.lit(0.0)) * grid_cell()),
            "learned_crosswalk": F.coalesce("crosswalk", F.lit(False)),
            "learned_queue": F.coalesce("queue", F.lit(False)),
            "has_road": drawn("carriageway") | F.coalesce("__hr", F.lit(False)),
            "has_crosswalks": drawn("crosswalks") | F.coalesce("__hc", F.lit(False)),
        }
    ).drop("iy", "ix", "road", "depth_cells", "queue", "crosswalk", "__hr", "__hc")


def in_queue(x: str = "foot_x", y: str = "foot_y") -> Column:
    """After :func:`locate`: inside a drawn queue zone, or a learned one where none is drawn."""
    return F.when(drawn("queue_zones"), in_any(x, y, "queue_zones")).otherwise(F.col("learned_queue"))


def lane_direction(df: DataFrame, scene: DataFrame, votes: DataFrame, x: str, y: str, own_out: bool, min_support: float = SCENE["flow_min_tracks"]) -> DataFrame:
    """Add ``dir_x, dir_y, strength`` of the lane at (x, y): a drawn lane, else the learned flow.

    ``own_out`` takes the track's own votes out of the flow, so a vehicle does not vote for itself.
    """
    d = with_cell(df.join(scene.select("video_id", "lanes"), "video_id"), x, y).join(flow_field(votes), CELL, "left")
    z = F.lit(0.0)
    if own_out:
        own = flow_field(votes, ("track_id",)).withColumnsRenamed({"fx": "ox", "fy": "oy", "fn": "on"})
        d = d.join(own, [*CELL, "track_id"], "left")
        fx, fy = F.coalesce("fx", z) - F.coalesce("ox", z), F.coalesce("fy", z) - F.coalesce("oy", z)
        n = F.coalesce("fn", F.lit(0)) - F.coalesce("on", F.lit(0))
        d = d.withColumns({"__fx": fx, "__fy": fy, "__fn": n}).drop("ox", "oy", "on")
    else:
        d = d.withColumns({"__fx": F.coalesce("fx", z), "__fy": F.coalesce("fy", z), "__fn": F.coalesce("fn", F.lit(0))})
    ux, uy, st = direction(F.col("__fx"), F.col("__fy"), F.col("__fn"), min_support)
    d = d.withColumn("__lane", first_match(x, y, "lanes"))
    has, lane = drawn("lanes"), F.col("__lane")
    pick = lambda drawn_v, flow_v: F.when(has, F.coalesce(drawn_v, z)).otherwise(flow_v)
    d = d.withColumns({"dir_x": pick(lane["dir"]["x"], ux), "dir_y": pick(lane["dir"]["y"], uy), "strength": pick(F.when(lane.isNotNull(), 1.0), st)})
    return d.drop("lanes", "fx", "fy", "fn", "__fx", "__fy", "__fn", "__lane", "iy", "ix")


def aligned_shapes(shapes: DataFrame, align: DataFrame, min_inliers: int = 40) -> DataFrame:
    """Warp normalised shapes by each video's matrix; a video without a plausible one keeps no drawn shape.

    ``align``: ``video_id, h`` (9 numbers, row order), ``inliers``.
    """
    ok = align.filter((F.col("inliers") >= min_inliers) & geo.plausible_warp("h"))
    d = shapes.join(ok.select("video_id", "h"), "video_id")
    warped = F.transform("pts", lambda p: F.struct(*[v.alias(n) for v, n in zip(geo.project(p["x"], p["y"]), ("x", "y"))]))
    n = F.size("pts")
    cx = F.aggregate("pts", F.lit(0.0), lambda a, p: a + p["x"]) / n
    cy = F.aggregate("pts", F.lit(0.0), lambda a, p: a + p["y"]) / n
    norm = F.greatest(geo.hypot(F.col("dir.x"), F.col("dir.y")), F.lit(1e-9))
    ax, ay = geo.project(cx, cy)
    bx, by = geo.project(cx + F.col("dir.x") / norm * 0.02, cy + F.col("dir.y") / norm * 0.02)
    d = d.withColumn("pts2", warped).withColumn("dir2", F.when(F.col("dir").isNotNull(), F.struct((bx - ax).alias("x"), (by - ay).alias("y"))))
    return d.drop("pts", "dir", "h").withColumnsRenamed({"pts2": "pts", "dir2": "dir"})
