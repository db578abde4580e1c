"""From raw tracker rows to the track table: cleaning, splitting, interpolation and kinematics.

Tracks of at most a block of rows are walked whole (see ``whole_tracks``): their rows move twice and are written once.
Of longer ones split pieces, completed rows, and the final rows are each written once. Their rows are partitioned by
``(video, track, time chunk)`` or ``(video, track, row block)``; per-track values are computed on
summaries and joined back per chunk, so one long track is always spread over tasks.
"""
from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbstream.functions import geometry as geo
from curbstream.operators.ordered import Scan, ordered_scan, row_blocks, time_halo, with_chunk
from curbstream.operators.quantiles import exact_quantiles
from curbstream.plans.params import ADMITTED, PERSON, TRACKER, TWO_WHEELERS, VEHICLES, sec
from curbstream.session import stage

CHUNK_US = 600_000_000
BLOCK_ROWS = 4096
TRACK = ["video_id", "track_id"]
PIECE_BITS = 24


def attach(df: DataFrame, keys: Sequence[str], chunk: str, per_key: DataFrame, how: str = "inner") -> DataFrame:
    """Join one-row-per-key values to rows through ``(key, chunk)``, so the rows of a hot key stay spread."""
    spread = df.select(*keys, chunk).distinct().join(per_key, list(keys))
    return df.join(spread, [*keys, chunk], how)


def admit(raw: DataFrame, min_conf: float = TRACKER["min_det_conf"], classes: Sequence[int] = ADMITTED) -> DataFrame:
    return raw.filter((F.col("conf") >= min_conf) & F.col("cls").isin(list(classes)))


def dedupe(raw: DataFrame, keys: Sequence[str] = ("video_id", "track_id", "frame"), order: str = "ord") -> DataFrame:
    """Keep the first input row per (video, track, frame)."""
    w = Window.partitionBy(*keys).orderBy(order)
    return raw.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def with_anchor(df: DataFrame) -> DataFrame:
    """Ground point and size of each box."""
    return df.withColumn("foot_x", (F.col("x1") + F.col("x2")) / 2).withColumn("foot_y", F.col("y2")).withColumn("size", geo.size_px())


def with_speed(df: DataFrame) -> DataFrame:
    return df.withColumn("speed", geo.hypot(F.col("vx"), F.col("vy")))


def majority_class(df: DataFrame, keys: Sequence[str] = TRACK) -> DataFrame:
    """Confidence-weighted vote per track; the lowest class wins a tie: ``keys, cls``."""
    w = F.when(F.col("conf") > 0, F.col("conf")).otherwise(F.lit(0.01))
    votes = df.groupBy(*keys, "cls").agg(F.round(F.sum(w), 9).alias("w"))
    return votes.groupBy(*keys).agg(F.max_by("cls", F.struct(F.col("w"), -F.col("cls"))).alias("cls"))


def uncut_box() -> Column:
    return (F.col("x1") > 2) & (F.col("y1") > 2) & (F.col("x2") < F.col("width") - 2) & (F.col("y2") < F.col("height") - 2)


def scale_counts(rows: DataFrame, videos: DataFrame) -> DataFrame:
    """Counted ground rows and sizes of vehicle boxes: ``video_id, foot_y, size, uncut, car, k``."""
    v = rows.filter(F.col("cls").isin(list(VEHICLES))).join(videos.select("video_id", "width", "height"), "video_id")
    uncut = uncut_box()
    v = v.select("video_id", "foot_y", "size", uncut.alias("uncut"), (uncut & (F.col("cls") == 2)).alias("car"))
    return v.groupBy("video_id", "foot_y", "size", "uncut", "car").agg(F.count(F.lit(1)).alias("k"))


def fit_scale(v: DataFrame, videos: DataFrame) -> DataFrame:
    """Typical vehicle size per image row: one row ``video_id, sc_a, sc_b, sc_min`` per video, of counted sizes.

    Median size in 10 bins of the ground row, then a line weighted by the bin counts. Uses cars that no
    border cuts when there are 30, else uncut vehicles, else all vehicles.
    """
    mode = v.groupBy("video_id").agg(F.sum(F.when(F.col("car"), F.col("k"))).alias("n_car"), F.sum(F.when(F.col("uncut"), F.col("k"))).alias("n_unc"))
    v = v.join(mode, "video_id")
    enough = F.coalesce(F.col("n_car"), F.lit(0)) >= 30
    v = v.filter(F.when(enough, F.col("car")).when(F.col("n_unc") > 0, F.col("uncut")).otherwise(F.lit(True)))
    v = stage(v.groupBy("video_id", "foot_y", "size").agg(F.sum("k").alias("k")), "scale_rows")
    return scale_line(v, videos)


def scale_line(v: DataFrame, videos: DataFrame) -> DataFrame:
    """The line fit of :func:`fit_scale` on counted rows ``video_id, foot_y, size, k``."""
    rng = v.groupBy("video_id").agg(F.min("foot_y").alias("y0"), F.max("foot_y").alias("y9"), F.sum("k").alias("n_all"))
    rng = rng.withColumn("step", (F.col("y9") + 1e-6 - F.col("y0")) / 10)
    d = v.join(rng, "video_id").withColumn("bin", F.least(F.floor((F.col("foot_y") - F.col("y0")) / F.col("step")), F.lit(9)))
    bins = weighted_median(d, ["video_id", "bin"])
    med_all = weighted_median(d, ["video_id"]).select("video_id", F.col("med").alias("m"))
    b = bins.filter("n >= 5").join(rng, "video_id")
    b = b.select("video_id", (F.col("y0") + (F.col("bin") + 0.5) * F.col("step")).alias("x"), "med", "n")
    s = b.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("nb"),
        (F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("xm"),
        (F.sum(F.col("n") * F.col("med")) / F.sum("n")).alias("ym"),
        F.collect_list(F.struct("x", "med", "n")).alias("pts"),  # at most 10
    )
    sxy = F.aggregate("pts", F.lit(0.0), lambda a, p: a + p["n"] * (p["x"] - F.col("xm")) * (p["med"] - F.col("ym")))
    sxx = F.aggregate("pts", F.lit(0.0), lambda a, p: a + p["n"] * (p["x"] - F.col("xm")) * (p["x"] - F.col("xm")))
    s = s.withColumn("slope", sxy / F.nullif(sxx, F.lit(0.0)))
    out = videos.select("video_id", "height").join(med_all, "video_id", "left").join(rng.select("video_id", "n_all"), "video_id", "left").join(s, "video_id", "left")
    line = (F.col("n_all") >= 30) & (F.col("nb") >= 2) & (F.col("slope") >= 0)
    h = F.col("height")
    return out.select(
        "video_id",
        F.when(F.col("m").isNull(), h * 0.08).when(line, F.col("ym") - F.col("slope") * F.col("xm")).otherwise(F.col("m")).alias("sc_a"),
        F.when(line, F.col("slope")).otherwise(F.lit(0.0)).alias("sc_b"),
        F.when(F.col("m").isNull(), h * 0.02).otherwise(F.col("m") * 0.25).alias("sc_min"),
    )


def weighted_median(v: DataFrame, keys: Sequence[str], width: float = 2.0) -> DataFrame:
    """Median of ``size`` counted ``k`` times: ``keys, med, n``; ranked in two levels (see quantiles)."""
    c = v.groupBy(*keys, "size").agg(F.sum("k").alias("k")).withColumn("__b", F.floor(F.col("size") / F.lit(width)))
    c = ordered_scan(c, keys, "__b", ["size"], [Scan("sum", "k", "hi")])
    n = c.groupBy(*keys).agg(F.sum("k").alias("n"))
    c = c.join(n, list(keys))
    f, g = F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)
    lo, hi = F.col("hi") - F.col("k"), F.col("hi") - 1
    a = c.groupBy(*keys).agg(F.max("n").alias("n"), F.max(F.when(f.between(lo, hi), F.col("size"))).alias("p"), F.max(F.when(g.between(lo, hi), F.col("size"))).alias("q"))
    return a.select(*keys, ((F.col("p") + F.col("q")) / 2).alias("med"), "n")


def split_pieces(raw: DataFrame, scale: DataFrame, videos: DataFrame, cfg: Mapping = TRACKER, chunk_us: int = CHUNK_US) -> DataFrame:
    """Cut tracks after long gaps and at implausible jumps. Adds ``src_id, piece`` and the new ``track_id``.

    A row without an earlier row within the allowed gap starts a piece, so only that much of the
    previous chunk has to be visible.
    """
    gap = sec(cfg["max_interp_gap_sec"])
    d = raw.join(scale, "video_id").join(videos.select("video_id", "width", "height"), "video_id")
    d = time_halo(with_anchor(d).withColumn("edge", geo.border()), "t_us", chunk_us, gap + 1, 0)
    d = dedupe(d, ["video_id", "track_id", "chunk", "frame"])
    w = Window.partitionBy("video_id", "track_id", "chunk").orderBy("frame")
    me = F.struct("t_us", "foot_x", "foot_y", "size", "edge")
    d = d.withColumn("__p", F.lag(me).over(w)).filter("home")
    p = F.col("__p")
    dt_us = F.col("t_us") - p["t_us"]
    dt = F.greatest(dt_us / 1e6, F.lit(1e-3))
    disp = geo.hypot(F.col("foot_x") - p["foot_x"], F.col("foot_y") - p["foot_y"]) / geo.row_scale("foot_y")
    ratio = F.greatest(F.col("size") / p["size"], p["size"] / F.col("size"))
    jump = ~F.col("edge") & ~p["edge"] & (((disp / dt > cfg["max_jump_speed_bl"]) & (disp > 1.0)) | (ratio > cfg["max_size_ratio"]))
    d = d.withColumn("__new", F.when(p.isNull() | (dt_us > gap) | jump, 1).otherwise(0))
    d = ordered_scan(d, TRACK, "chunk", ["frame"], [Scan("sum", "__new", "piece")])
    new_id = F.shiftleft(F.col("track_id").cast("bigint"), PIECE_BITS) + F.col("piece")
    return d.select("video_id", new_id.alias("track_id"), F.col("track_id").alias("src_id"), "piece", "chunk", "frame", "t", "t_us", "cls", "conf", "x1", "y1", "x2", "y2")


def interpolate(pieces: DataFrame, frames: DataFrame, cfg: Mapping = TRACKER, chunk_us: int = CHUNK_US) -> DataFrame:
    """Fill missing processed frames inside short gaps on a straight line (``conf`` 0, ``interp`` true).

    Tracks with a frame outside the clock are left alone.
    """
    gap = sec(cfg["max_interp_gap_sec"])
    d = pieces.drop("chunk").withColumn("interp", F.lit(False))
    g = d.join(frames.select("video_id", "frame", "pos"), ["video_id", "frame"], "left")
    off_clock = g.filter("pos IS NULL").select(*TRACK).distinct()
    g = time_halo(g, "t_us", chunk_us, 0, gap)
    w = Window.partitionBy(*TRACK, "chunk").orderBy("frame")
    box = F.struct("t", "t_us", "pos", "x1", "y1", "x2", "y2")
    g = g.withColumn("__n", F.lead(box).over(w)).filter("home")
    n = F.col("__n")
    g = g.filter((n["pos"] - F.col("pos") > 1) & (n["t_us"] - F.col("t_us") <= gap)).join(off_clock, TRACK, "left_anti")
    g = g.withColumn("pos", F.explode(F.sequence(F.col("pos") + 1, n["pos"] - 1)))
    clock = frames.select("video_id", "pos", F.col("frame").alias("__f"), F.col("t").alias("__ft"), F.col("t_us").alias("__fu"))
    g = g.join(clock, ["video_id", "pos"])
    a = (F.col("__fu") - F.col("t_us")) / (n["t_us"] - F.col("t_us"))

    def mix(k: str) -> Column:
        return (F.col(k) * (1 - a) + n[k] * a).alias(k)

    add = g.select(
        "video_id", "track_id", "src_id", "piece", F.col("__f").alias("frame"), F.col("__ft").alias("t"), F.col("__fu").alias("t_us"), "cls",
        F.lit(0.0).alias("conf"), *[mix(k) for k in ("x1", "y1", "x2", "y2")], F.lit(True).alias("interp"),
    )
    return with_chunk(d.unionByName(add), "t_us", chunk_us)


def complete_rows(pieces: DataFrame, frames: DataFrame, videos: DataFrame, scale: DataFrame, cfg: Mapping = TRACKER, chunk_us: int = CHUNK_US) -> DataFrame:
    """Class vote per piece, interpolation, ground point, border flag and the scale of the video."""
    d = attach(pieces.drop("cls"), TRACK, "chunk", majority_class(pieces))
    d = with_anchor(interpolate(d, frames, cfg, chunk_us))
    d = d.join(scale, "video_id").join(videos.select("video_id", "width", "height"), "video_id")
    return d.withColumn("edge", geo.border())


def track_values(rows: DataFrame, cfg: Mapping = TRACKER) -> DataFrame:
    """Per track: span, mean confidence of real rows, median size, row counts and rider share. Short tracks are left out."""
    real = F.when(~F.col("interp"), F.col("conf"))
    g = rows.groupBy(*TRACK).agg(
        (F.max("t_us") - F.min("t_us")).alias("span_us"), F.coalesce(F.avg(real), F.lit(0.0)).alias("track_conf"), F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.when(F.col("edge"), 0).otherwise(1)).alias("n_ok"), F.max("height").alias("__h"),
    ).filter(F.col("span_us") >= sec(cfg["min_track_sec"]))
    size = exact_quantiles(rows, TRACK, "size", {"track_size": 0.5}, 8.0).drop("n")
    g = g.join(size, TRACK)
    ok = (F.col("track_conf") >= cfg["reliable_min_conf"]) & (F.col("track_size") >= F.lit(cfg["reliable_min_size_frac"]) * F.col("__h"))
    return g.withColumn("reliable", ok).drop("__h")


def rider_tracks(rows: DataFrame, min_frac: float = 0.3) -> DataFrame:
    """Person tracks that mostly overlap a two-wheeler: ``video_id, track_id``."""
    p = rows.filter(F.col("cls") == PERSON).select(*TRACK, "frame", "x1", "y1", "x2", "y2")
    t = rows.filter(F.col("cls").isin(list(TWO_WHEELERS))).select("video_id", "frame", *[F.col(k).alias(f"w_{k}") for k in ("x1", "y1", "x2", "y2")])
    cx, cy = (F.col("x1") + F.col("x2")) / 2, F.col("y1") + 0.75 * (F.col("y2") - F.col("y1"))
    wh = F.col("w_y2") - F.col("w_y1")
    inside = cx.between(F.col("w_x1"), F.col("w_x2")) & (cy >= F.col("w_y1") - 0.2 * wh) & (cy <= F.col("w_y2"))
    iou = geo.box_iou(("x1", "y1", "x2", "y2"), ("w_x1", "w_y1", "w_x2", "w_y2"))
    near = F.col("w_x1").isNotNull() & ((iou > 0.1) | inside)
    t = t.withColumnsRenamed({"video_id": "w_video", "frame": "w_frame"})
    hit = p.join(t, (F.col("video_id") == F.col("w_video")) & (F.col("frame") == F.col("w_frame")) & near, "left_semi")
    share = p.groupBy(*TRACK).agg(F.count(F.lit(1)).alias("n")).join(hit.groupBy(*TRACK).agg(F.count(F.lit(1)).alias("k")), TRACK)
    return share.filter(F.col("k") / F.col("n") >= min_frac).select(*TRACK)


def rolling_median(cols: Sequence[Column]) -> Column:
    """Median of the non-null values of a short list of columns."""
    s = F.array_sort(F.array_compact(F.array(*cols)))
    n = F.size(s)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def ground_rows(rows: DataFrame, gap_us: int, chunk_us: int = CHUNK_US) -> DataFrame:
    """Ground row = box top + centred 9-row median height, robust to an occluded bottom. Adds ``fy``.

    Rows of a track are at most ``gap_us`` apart, so four neighbours lie within four gaps.
    """
    d = time_halo(rows.drop("chunk"), "t_us", chunk_us, 4 * gap_us, 4 * gap_us).withColumn("__h", F.col("y2") - F.col("y1"))
    w = Window.partitionBy(*TRACK, "chunk").orderBy("frame")
    around = [F.lag("__h", k).over(w) for k in range(4, 0, -1)] + [F.col("__h")] + [F.lead("__h", k).over(w) for k in range(1, 5)]
    for i, e in enumerate(around):
        d = d.withColumn(f"__h{i}", e)
    d = d.withColumn("fy", F.col("y1") + rolling_median([F.col(f"__h{i}") for i in range(9)])).filter("home")
    return d.drop("home", "__h", *[f"__h{i}" for i in range(9)])


MOTION = ["sx", "sy", "vx", "vy", "speed", "heading", "accel"]


def savgol(f: np.ndarray, at: np.ndarray, x: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Quadratic Savitzky-Golay values: of each row the window of ``2 half + 1`` values from ``at`` on, at ``x`` from its middle.

    The quadratic through a symmetric window follows from three weighted sums. Half 0 leaves a value as it is.
    """
    out = f.copy()
    for h in np.unique(half[half > 0]):
        r = np.flatnonzero(half == h)
        k = np.arange(-h, h + 1, dtype=float)
        win = np.lib.stride_tricks.sliding_window_view(f, 2 * h + 1)[at[r]]
        # Not by matrix products, whose last digits depend on the rows beside.
        s0, s1, s2 = win.sum(1), (win * k).sum(1), (win * (k * k)).sum(1)
        m2, m4, w = (k**2).sum(), (k**4).sum(), 2 * h + 1
        den = w * m4 - m2 * m2
        out[r] = (m4 * s0 - m2 * s2) / den + x[r] * (s1 / m2 + x[r] * (w * s2 - m2 * s0) / den)
    return out


def slope(v: np.ndarray, t: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Derivative of groups of rows laid end to end, second order inside and one-sided at their ends, 0 for a single row."""
    out, j = np.zeros(len(v)), np.flatnonzero(~first & ~last)
    a, z = t[j] - t[j - 1], t[j + 1] - t[j]
    out[j] = -z / (a * (a + z)) * v[j - 1] + (z - a) / (a * z) * v[j] + a / (z * (a + z)) * v[j + 1]
    j = np.flatnonzero(first & ~last)
    out[j] = (v[j + 1] - v[j]) / (t[j + 1] - t[j])
    j = np.flatnonzero(last & ~first)
    out[j] = (v[j] - v[j - 1]) / (t[j] - t[j - 1])
    return out


def smooth_groups(c: Mapping[str, np.ndarray], starts: np.ndarray) -> np.ndarray:
    """Motion of tracks, or blocks of them, that begin at ``starts``, a row each of ``MOTION``; whole rows come in order.

    Rows near an end of the track take the polynomial of the first or last full window.
    """
    seq = c["seq"]
    group = np.zeros(len(seq), int)
    group[starts[1:]] = 1
    group = np.cumsum(group)
    q = {k: v[seq] for k, v in c.items()}
    g = group[seq]
    begin = np.searchsorted(g, np.arange(len(starts)))
    count = np.diff(np.append(begin, len(g)))
    first, last = np.zeros(len(g), bool), np.zeros(len(g), bool)
    first[1:], last[:-1] = g[1:] != g[:-1], g[1:] != g[:-1]
    first[:1] = last[-1:] = True
    i, h = q["rn"] - 1, q["half"].astype(int)
    i0 = i[np.minimum(begin, len(i) - 1)]
    centre = np.clip(i, h, q["n_seq"] - 1 - h)
    at = np.clip(centre - i0[g] - h, 0, np.maximum(count[g] - 2 * h - 1, 0))
    x, at = i - (at + i0[g] + h), at + begin[g]
    t = q["t_us"] / 1e6
    sx, sy, ay = (savgol(q[k], at, x, h) for k in ("foot_x", "fy", "y1"))
    scale = np.maximum(q["sc_min"], q["sc_a"] + q["sc_b"] * sy)
    vx, vy = slope(sx, t, first, last) / scale, slope(ay, t, first, last) / scale
    speed = np.sqrt(vx * vx + vy * vy)
    accel = slope(savgol(speed, at, x, h), t, first, last)
    values = np.column_stack([sx, sy, vx, vy, speed, np.degrees(np.arctan2(vy, vx)), accel])
    # Border rows carry the number of the whole row whose motion they take.
    out = values[c["rn"] - 1 - i0[group] + begin[group]]
    out[~seq, 0], out[~seq, 1] = c["foot_x"][~seq], c["fy"][~seq]
    return out


BLOCK = [*TRACK, "block"]
SMOOTHED = ["rn", "seq", "n_seq", "half", "t_us", "foot_x", "fy", "y1", "sc_a", "sc_b", "sc_min"]


def _smoothed(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The home rows of whole blocks that begin at ``starts``, with their motion."""
    # Past the end of a track a block may hold copies only, too few for a window.
    home = np.add.reduceat(t["home"].to_numpy().astype(int), starts) > 0
    size = np.diff(np.append(starts, t.num_rows))
    t = t.filter(pa.array(np.repeat(home, size)))
    if t.num_rows == 0:
        return
    out = smooth_groups({k: t[k].to_numpy() for k in SMOOTHED}, np.cumsum(size[home]) - size[home])
    for k, m in enumerate(MOTION):
        t = t.append_column(m, pa.array(out[:, k]))
    yield from t.filter(t["home"]).to_batches()


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of a sorted partition and where they begin; only the rows of the group at the end of a batch wait for the next."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows == 0:
            continue
        t = pa.Table.from_batches([*rest, b]).combine_chunks()
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for k in keys:
            v = t[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(new)
        if len(starts) > 1:
            yield t.slice(0, starts[-1]), starts[:-1]
        rest = t.slice(starts[-1]).to_batches()
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks(), np.zeros(1, int)


def smooth_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a sorted partition one after the other."""
    for t, starts in whole_groups(batches, BLOCK):
        yield from _smoothed(t, starts)


def window_rows(dt: Column, window_sec: float) -> Column:
    """Odd number of rows of the smoothing window: about ``window_sec`` long, 5 rows at least."""
    want = F.greatest(F.bround(F.lit(window_sec) / dt).cast("int"), F.lit(4))
    return F.when(want % 2 == 0, want + 1).otherwise(want)


def smoothing_half(n: Column, dt: Column, window_sec: float) -> Column:
    """Half width of the smoothing window within a track of ``n`` rows; 0 = none."""
    win = F.least(window_rows(dt, window_sec), F.when(n % 2 == 1, n).otherwise(n - 1))
    return F.when(win >= 5, (win - 1) / 2).otherwise(F.lit(0)).cast("int")


def add_kinematics(rows: DataFrame, cfg: Mapping = TRACKER, chunk_us: int = CHUNK_US, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``sx, sy, vx, vy, speed, heading, accel`` (body lengths). Needs ``chunk, n_ok, n_rows, edge`` and the scale.

    Rows cut by the border take the motion of the nearest whole row of their track.
    """
    gap = sec(cfg["max_interp_gap_sec"])
    d = ground_rows(rows, gap, chunk_us)
    d = d.withColumn("__seq", ~F.col("edge") | (F.col("n_ok") < 2)).withColumn("__one", F.col("__seq").cast("int")).withColumn("__ts", F.when(F.col("__seq"), F.col("t_us")))
    d = ordered_scan(d, TRACK, "chunk", ["frame"], [Scan("sum", "__one", "__k"), Scan("count", "frame", "__all"), Scan("last_before", "__ts", "__pts")])
    d = stage(d, "ground")
    d = d.withColumn("__sa", F.when(F.col("__seq"), F.col("__all")))
    steps = d.filter("__seq AND __pts IS NOT NULL").select(*TRACK, ((F.col("t_us") - F.col("__pts")) / 1e6).alias("dt"))
    dt = stage(exact_quantiles(steps, TRACK, "dt", {"dt_med": 0.5}, 1.0).drop("n"), "sampling")
    # The widest window of any track sets how far blocks overlap; the sampling rate itself has no limit.
    mh = (dt.agg(F.max(window_rows(F.col("dt_med"), cfg["savgol_window_sec"]))).first()[0] or 5) // 2
    d = ordered_scan(d, TRACK, "chunk", ["frame"], [Scan("last_before", "__sa", "__pa"), Scan("next_after", "__sa", "__na")])
    d = attach(d, TRACK, "chunk", dt, "left")
    n = F.when(F.col("n_ok") < 2, F.col("n_rows")).otherwise(F.col("n_ok"))
    d = d.withColumn("__n", n).withColumn("__half", smoothing_half(F.col("__n"), F.coalesce("dt_med", F.lit(1.0)), cfg["savgol_window_sec"]))
    # The whole row whose motion a border row takes; an equal distance takes the next one.
    prev_nearer = F.col("__na").isNull() | (F.col("__all") - F.col("__pa") < F.col("__na") - F.col("__all"))
    d = d.withColumn("__rn", F.when(F.col("__seq"), F.col("__k")).when(F.coalesce(prev_nearer, F.lit(False)), F.col("__k")).otherwise(F.col("__k") + 1))
    d = d.withColumnsRenamed({"__rn": "rn", "__n": "n_seq", "__half": "half", "__seq": "seq"})
    d = d.select(*[c for c in d.columns if not c.startswith("__") and c != "dt_med"])
    d = row_blocks(d, "rn", block_rows, 4 * mh + 4).filter("seq OR home").drop("chunk")
    schema = T.StructType([*d.schema.fields, *[T.StructField(m, T.DoubleType()) for m in MOTION]])
    d = d.repartition(*BLOCK).sortWithinPartitions(*BLOCK, "rn", F.col("seq").desc(), "frame").mapInArrow(smooth_blocks, schema)
    return d.drop("block", "home", "rn", "n_seq", "half", "seq", "fy")


TRACK_COLUMNS = [
    "video_id", "track_id", "src_id", "frame", "t", "t_us", "cls", "conf", "x1", "y1", "x2", "y2", "foot_x", "foot_y", "size", "edge", "interp",
    "track_conf", "track_size", "reliable", "rider", "sx", "sy", "vx", "vy", "speed", "heading", "accel", "sc_a", "sc_b", "sc_min", "width", "height",
]
#: What is written of them but ``rider``: the others are worked out from these where they are read.
STORED = [c for c in TRACK_COLUMNS if c not in ("foot_x", "foot_y", "size", "speed", "rider")]


def voted_counts(raw: DataFrame, videos: DataFrame, chunk_us: int = CHUNK_US) -> DataFrame:
    """:func:`scale_counts` of admitted raw rows, with the class vote of the unsplit tracks."""
    d = with_chunk(dedupe(raw), "t_us", chunk_us)
    d = attach(d.drop("cls"), TRACK, "chunk", majority_class(d))
    return scale_counts(with_anchor(d), videos)


def scale_of(raw: DataFrame, videos: DataFrame, chunk_us: int = CHUNK_US) -> DataFrame:
    """Row scale per video from the raw rows, with the class vote of the unsplit tracks."""
    return fit_scale(stage(voted_counts(admit(raw), videos, chunk_us), "scale_counts"), videos)


def chunked_tracks(raw: DataFrame, frames: DataFrame, videos: DataFrame, scale: DataFrame, cfg: Mapping = TRACKER, chunk_us: int = CHUNK_US, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The track table without ``rider`` of admitted rows of tracks of any length."""
    pieces = stage(split_pieces(raw, scale, videos, cfg, chunk_us), "pieces")
    rows = stage(complete_rows(pieces, frames, videos, scale, cfg, chunk_us), "rows")
    values = stage(track_values(rows, cfg), "track_values")
    return add_kinematics(attach(rows, TRACK, "chunk", values), cfg, chunk_us, block_rows).select(*STORED)


@dataclass
class Parts:
    """Admitted rows by the length of their tracks, the scale of all videos, and for short tracks the rows dealt out to be walked."""

    videos: DataFrame
    scale: DataFrame
    dealt: DataFrame
    long: DataFrame | None


def parts_of(raw: DataFrame, frames: DataFrame, videos: DataFrame, cfg: Mapping = TRACKER, chunk_us: int = CHUNK_US, block_rows: int = BLOCK_ROWS) -> Parts:
    """Tracks of at most ``block_rows`` rows within the length of a chunk are short; only others go through chunks."""
    from curbstream.operators import whole_tracks as whole

    videos, raw = stage(videos, "videos"), admit(raw)
    lengths = raw.groupBy(*TRACK).agg(F.count(F.lit(1)).alias("n"), (F.max("t_us") - F.min("t_us")).alias("span"))
    lengths = stage(lengths.select(*TRACK, ((F.col("n") > block_rows) | (F.col("span") > chunk_us)).alias("long")), "track_lengths")
    short, long = raw, None
    if not lengths.filter("long").isEmpty():
        ids = lengths.filter("long").select(*TRACK)
        short, long = raw.join(ids, TRACK, "left_anti"), raw.join(ids, TRACK, "left_semi")
    looked = stage(whole.look_at(short, videos, cfg), "track_gaps")
    counts = looked.filter("k IS NOT NULL").select("video_id", "foot_y", "size", "uncut", "car", "k")
    if long is not None:
        counts = counts.unionByName(stage(voted_counts(long, videos, chunk_us), "scale_counts"))
    scale = stage(fit_scale(counts, videos), "scale")
    marks = lengths.filter("NOT long").select(*TRACK).join(scale, "video_id").join(videos.select("video_id", "width", "height"), "video_id")
    return Parts(videos, scale, whole.dealt_rows(short, looked, frames, marks), long)


def filled_tracks(raw: DataFrame, frames: DataFrame, videos: DataFrame, cfg: Mapping = TRACKER, chunk_us: int = CHUNK_US, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pieces of tracks with filled gaps: ``video_id, track_id, frame, t, t_us, conf, x1, y1, x2, y2, interp``."""
    from curbstream.operators import whole_tracks as whole

    p = parts_of(raw, frames, videos, cfg, chunk_us, block_rows)
    cols = ["video_id", "track_id", "frame", "t", "t_us", "conf", "x1", "y1", "x2", "y2", "interp"]
    d = whole.walk(p.dealt, cfg, _fields(raw, cols), motion=False)
    if p.long is not None:
        pieces = stage(split_pieces(p.long, p.scale, p.videos, cfg, chunk_us), "pieces")
        d = d.unionByName(interpolate(pieces, frames, cfg, chunk_us).select(*cols))
    return d


def _fields(raw: DataFrame, cols: Sequence[str]) -> T.StructType:
    """Fields of the track table: those of the raw rows, or as named."""
    kinds = {"track_id": T.LongType(), "src_id": raw.schema["track_id"].dataType} | {c: T.BooleanType() for c in ("edge", "interp", "reliable")}
    own = {f.name: f.dataType for f in raw.schema.fields}
    return T.StructType([T.StructField(c, kinds.get(c) or own.get(c) or T.DoubleType()) for c in cols])


def build_tracks(raw: DataFrame, frames: DataFrame, videos: DataFrame, cfg: Mapping = TRACKER, chunk_us: int = CHUNK_US, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The track table of all videos, written once and read back; rows of persons, who may be riders, are written again with ``rider``."""
    from curbstream.operators import whole_tracks as whole

    p = parts_of(raw, frames, videos, cfg, chunk_us, block_rows)
    d = whole.walk(p.dealt, cfg, _fields(raw, STORED))
    d = d.withColumns({c: F.col(c).cast(p.videos.schema[c].dataType) for c in ("width", "height")})
    if p.long is not None:
        d = d.unionByName(chunked_tracks(p.long, frames, p.videos, p.scale, cfg, chunk_us, block_rows))
    d = with_speed(with_anchor(stage(d.withColumn("person", F.col("cls") == PERSON), "tracks", by="person")))
    riders = stage(rider_tracks(d.filter(F.col("person") | F.col("cls").isin(list(TWO_WHEELERS)))), "riders")
    people = d.filter("person").join(riders.withColumn("rider", F.lit(True)), TRACK, "left").withColumn("rider", F.coalesce("rider", F.lit(False)))
    people = with_speed(with_anchor(stage(people.select(*STORED, "rider"), "tracks_people")))
    return d.filter("NOT person").withColumn("rider", F.lit(False)).select(*TRACK_COLUMNS).unionByName(people.select(*TRACK_COLUMNS))


def dense_ids(raw: DataFrame) -> DataFrame:
    """Dense per-video ids in order of first appearance. Numbered per first frame, then shifted, so no video is one task."""
    first = raw.groupBy(*TRACK).agg(F.min("frame").alias("__f"))
    d = ordered_scan(first, ["video_id"], "__f", ["track_id"], [Scan("count", "track_id", "new_id")])
    return d.select(*TRACK, "new_id")
