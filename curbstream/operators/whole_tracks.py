"""Tracks that fit into one block of rows, each whole in one task, in two sorted passes over Arrow batches.

The chunked steps of ``tracks`` move every row a dozen times, which a track of millions of rows needs and a short one does not.
Here rows move twice, by track: the first pass looks at the sizes of boxes and at the gaps, the second cuts, fills and smooths.
A task holds one Arrow batch and the track at its end, which has at most ``block_rows`` rows. The rows are those of the chunked
steps (tested).
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbstream.operators.tracks import MOTION, PIECE_BITS, TRACK, smooth_groups, uncut_box, whole_groups, with_anchor
from curbstream.plans.params import VEHICLES, sec

Arrays = dict[str, np.ndarray]
BOX = ["x1", "y1", "x2", "y2"]
DEALT = [*TRACK, "frame", "ord", "t", "t_us", "cls", "conf", *BOX]
NEAR = 4  # rows on either side whose heights make the ground row


def _of_group(flag: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Running count of ``flag`` within groups; ``start`` is the index of the first row of each row's group."""
    c = np.cumsum(flag)
    return c - c[start] + flag[start]


def _starts(new: np.ndarray) -> np.ndarray:
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _changes(*cols: np.ndarray) -> np.ndarray:
    new = np.zeros(len(cols[0]), bool)
    new[:1] = True
    for v in cols:
        new[1:] |= v[1:] != v[:-1]
    return new


def _size(c: Mapping[str, np.ndarray]) -> np.ndarray:
    return np.sqrt(np.fmax(c["x2"] - c["x1"], 1.0) * np.fmax(c["y2"] - c["y1"], 1.0))


def _medians(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Median of the values of each of ``n`` groups, NaN for one without any."""
    order = np.lexsort((values, group))
    v, count = values[order], np.bincount(group, minlength=n)
    begin = np.cumsum(count) - count
    p = 0.5 * (count - 1)
    at = lambda r: v[np.minimum(begin + np.maximum(r, 0), max(len(v) - 1, 0)).astype(int)] if len(v) else np.zeros(n)
    lo, hi = at(np.floor(p)), at(np.ceil(p))
    return np.where(count > 0, lo + (hi - lo) * (p - np.floor(p)), np.nan)


def _votes(cls: np.ndarray, conf: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Class of each group by ``tracks.majority_class``."""
    order = np.lexsort((cls, group))
    k, g = cls[order], group[order]
    begin = np.flatnonzero(_changes(g, k))
    w = np.round(np.add.reduceat(np.where(conf[order] > 0, conf[order], 0.01), begin), 9)
    k, g = k[begin], g[begin]
    best = np.lexsort((-k, w, g))
    return k[best][np.flatnonzero(np.append(g[best][1:] != g[best][:-1], True))]


def look(gap_us: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of sorted rows: counted sizes of vehicle boxes, frames between which rows may be missing, and the frames that occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in whole_groups(batches, TRACK):
            c = {k: t[k].to_numpy() for k in t.column_names}
            first = np.flatnonzero(_changes(c["video_id"], c["track_id"], c["frame"]))
            c = {k: v[first] for k, v in c.items()}
            new = _changes(c["video_id"], c["track_id"])
            track, video, frame = np.cumsum(new) - 1, c["video_id"], c["frame"].astype(np.int64)
            cls = _votes(c["cls"], c["conf"], track)[track]

            v, uncut = np.flatnonzero(np.isin(cls, VEHICLES)), c["uncut"]
            size, foot, flags = c["size"][v], c["foot_y"][v], uncut[v] + 2 * (uncut & (cls == 2))[v]
            v, size, foot, flags = (x[np.lexsort((size, foot, flags, video[v]))] for x in (v, size, foot, flags))
            at = np.flatnonzero(_changes(video[v], flags, foot, size))
            yield _told(t, video[v][at], foot_y=foot[at], size=size[at], uncut=flags[at] % 2 == 1, car=flags[at] > 1, k=np.diff(np.append(at, len(v))))

            i = np.flatnonzero(~new[1:] & (frame[1:] - frame[:-1] > 1) & (c["t_us"][1:] - c["t_us"][:-1] <= gap_us))
            yield _told(t, video[i], track_id=c["track_id"][i], f0=frame[i], f1=frame[i + 1])

            word = frame >> 6
            order = np.lexsort((word, video))
            bit = (np.uint64(1) << (frame & 63).astype(np.uint64))[order]
            at = np.flatnonzero(_changes(video[order], word[order]))
            yield _told(t, video[order][at], word=word[order][at], mask=np.bitwise_or.reduceat(bit, at).view(np.int64))

    return run


LOOK = "foot_y double, size double, uncut boolean, car boolean, k bigint, f0 bigint, f1 bigint, word bigint, mask bigint"


def _told(t: pa.Table, video: np.ndarray, **cols: np.ndarray) -> pa.RecordBatch:
    """A batch of :func:`look`, with nulls in the columns that are not given."""
    kinds = {"video_id": t.schema.field("video_id").type, "track_id": t.schema.field("track_id").type}
    kinds |= {k: {"double": pa.float64(), "boolean": pa.bool_(), "bigint": pa.int64()}[v] for k, v in (x.split() for x in LOOK.split(", "))}
    cols["video_id"] = video
    return pa.RecordBatch.from_arrays([pa.array(cols[k], v) if k in cols else pa.nulls(len(video), v) for k, v in kinds.items()], names=list(kinds))


def look_at(rows: DataFrame, videos: DataFrame, cfg: Mapping) -> DataFrame:
    d = with_anchor(rows).join(videos.select("video_id", "width", "height"), "video_id").withColumn("uncut", uncut_box())
    d = d.select(*TRACK, "frame", "ord", "t_us", "cls", "conf", "foot_y", "size", "uncut")
    kinds = T.StructType([*(d.schema[k] for k in TRACK), *T.StructType.fromDDL(LOOK).fields])
    return d.repartition(*TRACK).sortWithinPartitions(*TRACK, "frame", "ord").mapInArrow(look(sec(cfg["max_interp_gap_sec"])), kinds)


def missing_rows(looked: DataFrame, frames: DataFrame) -> DataFrame:
    """Processed frames inside the gaps: ``video_id, track_id, frame, t, t_us``. The clock's ``pos`` grows with its frames."""
    at = lambda f, p: frames.select("video_id", F.col("frame").alias(f), F.col("pos").alias(p))
    g = looked.filter("f0 IS NOT NULL").select(*TRACK, "f0", "f1").join(at("f0", "p0"), ["video_id", "f0"]).join(at("f1", "p1"), ["video_id", "f1"])
    g = g.filter("p1 - p0 > 1").select(*TRACK, F.explode(F.expr("sequence(p0 + 1, p1 - 1)")).alias("pos"))
    return g.join(frames.select("video_id", "pos", "frame", "t", "t_us"), ["video_id", "pos"]).drop("pos")


def off_clock(looked: DataFrame, frames: DataFrame) -> DataFrame:
    """Frames of rows that the clock lacks: ``video_id, frame``. 64 frames are a word, so few rows meet."""
    here = looked.filter("mask IS NOT NULL").groupBy("video_id", "word").agg(F.expr("bit_or(mask)").alias("mask"))
    clock = frames.groupBy("video_id", F.expr("shiftright(CAST(frame AS BIGINT), 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(frame & 63 AS INT)))").alias("known"))
    d = here.join(clock, ["video_id", "word"], "left").withColumn("off", F.expr("mask & ~coalesce(known, 0L)")).filter("off <> 0")
    return d.select("video_id", "word", "off", F.explode(F.expr("sequence(0, 63)")).alias("i")).filter("getbit(off, i) = 1").select("video_id", (F.col("word") * 64 + F.col("i")).alias("frame"))


def filled(t: pa.Table, cfg: Mapping) -> Arrays:
    """Pieces of whole tracks with filled gaps, a row each in the order of their frames; ``g`` numbers the pieces.

    A track begins with a mark without frame that holds the scale and the frame size in its box and confidence.
    """
    gap = sec(cfg["max_interp_gap_sec"])
    mark = t["frame"].is_null().to_numpy()
    m = t.filter(pa.array(mark))
    of = (np.cumsum(mark) - 1)[~mark]
    c = {k: v.to_numpy() for k, v in zip(t.column_names, t.filter(pa.array(~mark)).columns, strict=True) if k not in ("ord", "cls")}
    real = ~t["ord"].is_null().to_numpy()[~mark]
    c["cls"] = t["cls"].fill_null(0).to_numpy()[~mark]
    for k, v in {"sc_a": "x1", "sc_b": "y1", "sc_min": "x2", "height": "y2", "width": "conf"}.items():
        c[k] = m[v].to_numpy()[of]
    # The first real row of a frame counts.
    i = np.flatnonzero(real)
    again = ~_changes(of[i], c["frame"][i])
    keep = np.ones(len(real), bool)
    keep[i[again]] = False
    c, of, real = {k: v[keep] for k, v in c.items()}, of[keep], real[keep]

    i = np.flatnonzero(real)
    r = {k: v[i] for k, v in c.items()}
    size, foot_x, edge = _size(r), (r["x1"] + r["x2"]) / 2, _edge(r)
    new = _changes(of[i])
    dt_us = np.append(0, np.diff(r["t_us"]))
    back = np.maximum(np.arange(len(i)) - 1, 0)
    disp = np.sqrt((foot_x - foot_x[back]) ** 2 + (r["y2"] - r["y2"][back]) ** 2) / np.fmax(r["sc_min"], r["sc_a"] + r["sc_b"] * r["y2"])
    ratio = np.fmax(size / size[back], size[back] / size)
    jump = ~edge & ~edge[back] & (((disp / np.maximum(dt_us / 1e6, 1e-3) > cfg["max_jump_speed_bl"]) & (disp > 1.0)) | (ratio > cfg["max_size_ratio"]))
    cut = new | (dt_us > gap) | jump
    g = np.cumsum(cut) - 1
    piece = _of_group(cut, _starts(new))
    cls = _votes(r["cls"], r["conf"], g)

    # A row to fill lies between two rows of one piece that are near in time.
    last = np.cumsum(real) - 1
    p, n = np.maximum(last, 0), np.minimum(last + 1, len(i) - 1)
    fit = (last >= 0) & (last + 1 < len(i)) & (g[p] == g[n]) & (r["t_us"][n] - r["t_us"][p] <= gap) & (of == of[i][p])
    if "off" in r:
        fit &= ~np.bincount(g, weights=r["off"].astype(float), minlength=g[-1] + 1).astype(bool)[g[p]]
    f = np.flatnonzero(~real & fit)
    a = (c["t_us"][f] - r["t_us"][p[f]]) / (r["t_us"][n[f]] - r["t_us"][p[f]])
    for k in BOX:
        c[k] = c[k].copy()
        c[k][f] = r[k][p[f]] * (1 - a) + r[k][n[f]] * a
    c["conf"] = np.where(real, c["conf"], 0.0)
    out = np.flatnonzero(real | (~real & fit))
    d = {k: v[out] for k, v in c.items()}
    d |= {"g": g[p[out]], "interp": ~real[out], "src_id": d["track_id"], "piece": piece[p[out]]}
    d["cls"] = cls[d["g"]]
    d["track_id"] = (d["src_id"].astype(np.int64) << PIECE_BITS) + d["piece"]
    return d


def _edge(c: Mapping[str, np.ndarray]) -> np.ndarray:
    mx, my = np.maximum(2.0, 0.005 * c["width"]), np.maximum(2.0, 0.005 * c["height"])
    return (c["y1"] <= my) | (c["y2"] >= c["height"] - my) | (c["x1"] <= mx) | (c["x2"] >= c["width"] - mx)


def moving(d: Arrays, cfg: Mapping) -> Arrays:
    """Filled rows of pieces that last long enough, with the values of their track and its motion."""
    begin = np.flatnonzero(_changes(d["g"]))
    span = np.maximum.reduceat(d["t_us"], begin) - np.minimum.reduceat(d["t_us"], begin)
    n_rows = np.diff(np.append(begin, len(d["g"])))
    long = np.repeat(span >= sec(cfg["min_track_sec"]), n_rows)
    d = {k: v[long] for k, v in d.items()}
    if not long.any():
        return d
    new = _changes(d["g"])
    begin, g, start = np.flatnonzero(new), np.cumsum(new) - 1, _starts(new)
    n, n_rows = len(begin), np.diff(np.append(begin, len(new)))
    d |= {"foot_x": (d["x1"] + d["x2"]) / 2, "foot_y": d["y2"], "size": _size(d), "edge": _edge(d)}
    n_real = np.add.reduceat((~d["interp"]).astype(np.int64), begin)
    conf = np.add.reduceat(np.where(d["interp"], 0.0, d["conf"]), begin) / np.maximum(n_real, 1)
    size = _medians(d["size"], g, n)
    d |= {"track_conf": conf[g], "track_size": size[g]}
    d["reliable"] = (d["track_conf"] >= cfg["reliable_min_conf"]) & (d["track_size"] >= cfg["reliable_min_size_frac"] * d["height"])

    # Ground row: box top + median height of the rows around.
    around = np.arange(len(g))[:, None] + np.arange(-NEAR, NEAR + 1)
    inside = (around >= start[:, None]) & (around < (start + n_rows[g])[:, None])
    h = np.sort(np.where(inside, (d["y2"] - d["y1"])[np.clip(around, 0, len(g) - 1)], np.nan), axis=1)
    k, i = inside.sum(1), np.arange(len(g))
    d["fy"] = d["y1"] + (h[i, (k - 1) // 2] + h[i, k // 2]) / 2

    n_ok = np.add.reduceat((~d["edge"]).astype(np.int64), begin)
    seq = ~d["edge"] | (n_ok < 2)[g]
    n_seq = np.where(n_ok < 2, n_rows, n_ok)
    q = np.flatnonzero(seq)
    same = g[q][1:] == g[q][:-1]
    dt = _medians((np.diff(d["t_us"][q]) / 1e6)[same], g[q][1:][same], n)
    half = _half(n_seq, np.where(np.isnan(dt), 1.0, dt), cfg["savgol_window_sec"])
    # A border row takes the motion of the nearest whole row; an equal distance takes the next one.
    rank, far = _of_group(seq, start), np.iinfo(np.int64).max // 2
    prev = np.maximum.accumulate(np.where(seq, i, -1))
    ahead = np.minimum.accumulate(np.where(seq, i, far)[::-1])[::-1]
    none = ahead >= start + n_rows[g]
    nearer = none | ((prev >= start) & (i - prev < ahead - i))
    rn = np.where(seq | nearer, rank, rank + 1)
    cols = {"seq": seq, "rn": rn, "n_seq": n_seq[g], "half": half[g]} | {k: d[k] for k in ("t_us", "foot_x", "fy", "y1", "sc_a", "sc_b", "sc_min")}
    out = smooth_groups(cols, begin)
    return d | {m: out[:, j] for j, m in enumerate(MOTION)}


def _half(n: np.ndarray, dt: np.ndarray, window_sec: float) -> np.ndarray:
    """``tracks.smoothing_half`` of arrays."""
    odd = np.where(n % 2 == 1, n, n - 1)
    with np.errstate(divide="ignore"):
        want = np.minimum(np.maximum(np.round(window_sec / dt), 4), odd + 1).astype(np.int64)
    win = np.minimum(np.where(want % 2 == 0, want + 1, want), odd)
    return np.where(win >= 5, (win - 1) // 2, 0)


def dealt_rows(rows: DataFrame, looked: DataFrame, frames: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows, frames to fill and the mark of each track (with scale and frame size), sorted by track and frame."""
    d = rows.select(*DEALT)
    off = off_clock(looked, frames)
    if not off.isEmpty():
        d = d.join(off.withColumn("off", F.lit(True)), ["video_id", "frame"], "left").withColumn("off", F.coalesce("off", F.lit(False)))
    marks = marks.select(*TRACK, *[F.col(a).cast("double").alias(b) for a, b in (("sc_a", "x1"), ("sc_b", "y1"), ("sc_min", "x2"), ("height", "y2"), ("width", "conf"))])
    d = d.unionByName(missing_rows(looked, frames), allowMissingColumns=True).unionByName(marks, allowMissingColumns=True)
    return d.repartition(*TRACK).sortWithinPartitions(*TRACK, "frame", "ord")


def walk(dealt: DataFrame, cfg: Mapping, fields: T.StructType, motion: bool = True) -> DataFrame:
    """One pass over :func:`dealt_rows`: the columns ``fields`` of the pieces' rows, with ``motion`` those of the track table."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in whole_groups(batches, TRACK):
            if t["ord"].null_count == t.num_rows:
                continue
            d = filled(t, cfg)
            d = moving(d, cfg) if motion else d
            if len(d["g"]):
                yield pa.RecordBatch.from_arrays([pa.array(d[f.name], f.type, from_pandas=True) for f in kinds], schema=kinds)

    return dealt.mapInArrow(run, fields)
