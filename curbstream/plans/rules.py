"""Event rules over the track table. Each rule maps tables and parameters to segments:
``video_id, label, start_us, end_us, confidence, tracks, info``.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbstream.functions import geometry as geo
from curbstream.operators import scene as sc
from curbstream.operators.intervals import merge_intervals, overlap_join
from curbstream.operators.lookup import next_change, state_at
from curbstream.operators.ordered import Scan, ordered_scan, runs, time_halo, with_chunk
from curbstream.operators.quantiles import exact_quantiles
from curbstream.plans.params import ANIMALS, OBJECTS, PERSON, ROAD_USERS, VEHICLES, sec
from curbstream.session import stage

TRACK = ["video_id", "track_id"]
CHUNK = 600_000_000
BUCKET = 60_000_000
GAP = 1_000_000  # rows of a track are at most this far apart
BOX = ("x1", "y1", "x2", "y2")


@dataclass
class Tables:
    """The inputs of the rules. ``scene`` has one row per video, ``cells`` and ``votes`` are learned from the tracks."""

    tracks: DataFrame
    frames: DataFrame
    videos: DataFrame
    scene: DataFrame
    cells: DataFrame
    votes: DataFrame
    phases: DataFrame
    thumbs: DataFrame | None = None


Rule = Callable[[Tables, Mapping], DataFrame]
RULES: dict[str, Rule] = {}


def rule(label: str) -> Callable[[Rule], Rule]:
    def add(fn: Rule) -> Rule:
        RULES[label] = fn
        return fn

    return add


def segments(df: DataFrame, label: str, conf, tracks: Column | None = None, **info: Column) -> DataFrame:
    kv = [x for k, v in info.items() for x in (F.lit(k), v.cast("string"))]
    return df.select(
        "video_id", F.lit(label).alias("label"), F.col("start_us").cast("bigint"), F.col("end_us").cast("bigint"),
        (conf if isinstance(conf, Column) else F.lit(float(conf))).cast("double").alias("confidence"),
        (tracks if tracks is not None else F.array("track_id")).cast("array<bigint>").alias("tracks"),
        (F.create_map(*kv) if kv else F.expr("CAST(map() AS MAP<STRING, STRING>)")).alias("info"),
    )


def kind(t: DataFrame, which: str, reliable: bool = True) -> DataFrame:
    d = t.filter("reliable") if reliable else t
    if which == "person":
        return d.filter((F.col("cls") == PERSON) & ~F.col("rider"))
    return d.filter(F.col("cls").isin(list(VEHICLES if which == "vehicle" else ROAD_USERS)))


def rows_in(rows: DataFrame, spans: DataFrame, lo: str = "start_us", hi: str = "end_us", keys: Sequence[str] = TRACK, t: str = "t_us", bucket: int = BUCKET) -> DataFrame:
    """Rows whose time lies in a span of the same key, with the columns of the span."""
    return overlap_join(rows, spans, keys, (t, t), (lo, hi), bucket)


def signal_state(df: DataFrame, phases: DataFrame, signal: str, t: str, ties: Sequence[str], out: str = "state") -> DataFrame:
    """State of a row's signal at ``t``. A null signal means the only head of the video, unknown when there are more."""
    return state_at(with_head(df, phases, signal), phases.withColumnRenamed("signal_id", "__sig"), ["video_id", "__sig"], t, ties, out, CHUNK).drop("__sig")


def with_head(df: DataFrame, phases: DataFrame, signal: str) -> DataFrame:
    only = phases.groupBy("video_id").agg(F.when(F.count_distinct("signal_id") == 1, F.max("signal_id")).alias("__only"))
    d = df.join(only, "video_id", "left").withColumn("__sig", F.coalesce(F.col(signal).cast("string"), F.col("__only"), F.lit("")))
    return d.drop("__only")


def known_videos(phases: DataFrame) -> DataFrame:
    return phases.filter("state <> 'unknown'").select("video_id").distinct()


# ---------------------------------------------------------------- one camera-wide table


@rule("wrong_way")
def wrong_way(x: Tables, p: Mapping) -> DataFrame:
    v = kind(x.tracks, "vehicle").select(*TRACK, "frame", "t_us", "sx", "sy", "vx", "vy", "speed", "interp", "sc_a", "sc_b", "sc_min", "width", "height")
    d = sc.lane_direction(v, x.scene, x.votes, "sx", "sy", True).join(x.scene.select("video_id", "intersection"), "video_id")
    cos = (F.col("vx") * F.col("dir_x") + F.col("vy") * F.col("dir_y")) / F.greatest("speed", F.lit(1e-9))
    sure = (F.col("speed") > p["min_speed"]) & (F.col("strength") >= p["min_strength"])
    d = d.withColumn("cos", cos).withColumns({"against": sure & (cos < p["cos_thr"]) & ~sc.in_any("sx", "sy", "intersection"), "along": sure & (cos > 0.5)})
    d = stage(d.drop("intersection", "dir_x", "dir_y"), "wrong_way_rows")
    r = runs(d, TRACK, "t_us", "against", sec(p["min_sec"]), 500_000, CHUNK)
    r = stage(r.select(*TRACK, "start_us", "end_us", (F.col("start_us") - sec(p["reversal_window_sec"])).alias("w0"), (F.col("start_us") - 1).alias("w1")), "wrong_way_runs")
    own = d.join(r.select(*TRACK).distinct(), TRACK, "left_semi")
    at = F.struct("sx", "sy")
    # A moving vehicle leaves the view, so a run is short.
    g = rows_in(own, r.drop("w0", "w1")).groupBy(*TRACK, "start_us", "end_us").agg(
        F.min_by(at, "t_us").alias("a"), F.max_by(at, "t_us").alias("b"), F.percentile("speed", F.lit(0.5)).alias("med"), F.avg(F.when(F.col("interp"), 0.0).otherwise(1.0)).alias("real"),
        F.avg("strength").alias("st"), F.avg(-F.col("cos")).alias("nc"), *[F.max(c).alias(c) for c in ("sc_a", "sc_b", "sc_min")],
    )
    disp = geo.hypot(F.col("b.sx") - F.col("a.sx"), F.col("b.sy") - F.col("a.sy")) / geo.row_scale((F.col("a.sy") + F.col("b.sy")) / 2)
    g = g.filter((disp >= p["min_displacement_bl"]) & (F.col("med") >= p["min_median_speed"]) & (F.col("real") >= p["min_real_frac"]))
    # Moving with the flow just before is an id switch, not a wrong-way driver.
    step = ordered_scan(with_chunk(own, "t_us", CHUNK), TRACK, "chunk", ["t_us"], [Scan("lag", "t_us", "__p")]).filter("__p IS NOT NULL")
    dt = exact_quantiles(step.withColumn("dt", F.col("t_us") - F.col("__p")), TRACK, "dt", {"dt": 0.5}, 100_000.0).drop("n")
    before = rows_in(own.filter("along"), r, "w0", "w1").groupBy(*TRACK, "start_us").agg(F.count(F.lit(1)).alias("n_along"))
    g = g.join(dt, TRACK, "left").join(before, [*TRACK, "start_us"], "left")
    g = g.filter(F.coalesce(F.col("n_along") * F.coalesce("dt", F.lit(1e5)), F.lit(0.0)) < 1e6)
    conf = F.least(F.greatest(F.col("st") * F.col("nc"), F.lit(0.0)), F.lit(1.0))
    return segments(g, "wrong_way", conf)


@rule("congestion")
def congestion(x: Tables, p: Mapping) -> DataFrame:
    v = kind(x.tracks, "vehicle", False).select(*TRACK, "t_us", "foot_x", "foot_y", "vx", "vy", "speed", "width", "height")
    v = sc.locate(v, x.scene, x.cells).filter("on_road OR NOT has_road").select(*TRACK, "t_us", "foot_x", "foot_y", "vx", "vy", "speed", "width", "height")
    v = stage(v, "congestion_rows")
    mv = v.filter(F.col("speed") > p["moving_speed"]).groupBy(*TRACK).agg(geo.heading(F.avg("vx"), F.avg("vy")).alias("ang"))
    first = v.groupBy(*TRACK).agg(*[F.min_by(c, "t_us").alias(c) for c in ("foot_x", "foot_y", "width", "height")])
    lane = sc.lane_direction(first, x.scene, x.votes, "foot_x", "foot_y", False)
    a = lane.join(mv, TRACK, "left").withColumn("ang", F.coalesce("ang", F.when(F.col("strength") > 0.3, geo.heading("dir_x", "dir_y"))))
    hist = a.filter("ang IS NOT NULL").groupBy("video_id", F.least(F.floor((F.col("ang") + 180) / 10), F.lit(35)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    axis = hist.groupBy("video_id").agg((F.max_by("bin", F.struct(F.col("n"), -F.col("bin"))) * 10.0 - 175.0).alias("axis"))
    a = a.join(axis, "video_id", "left")
    grp = F.when(F.col("axis").isNull(), F.lit(0)).otherwise(F.floor(F.pmod(F.col("ang") - F.col("axis") + 45.0, F.lit(360.0)) / 90.0))
    a = a.select(*TRACK, grp.cast("int").alias("grp")).filter("grp IS NOT NULL")
    bin_us = sec(p["bin_sec"])
    # A second of one track is a handful of rows, a second of one video a handful of tracks.
    per = v.groupBy(*TRACK, (F.floor(F.col("t_us") / bin_us) * bin_us).alias("bin_us")).agg(F.percentile("speed", F.lit(0.5)).alias("m"))
    b = per.join(a, TRACK).groupBy("video_id", "grp", "bin_us").agg(F.count(F.lit(1)).alias("n"), F.percentile("m", F.lit(0.5)).alias("m"))
    b = stage(b, "congestion_bins")
    cap = exact_quantiles(b, ["video_id", "grp"], "n", {"cap": 0.95}, 8.0).select("video_id", "grp", "cap")
    hot = b.join(cap, ["video_id", "grp"]).filter((F.col("n") >= F.greatest(F.lit(float(p["min_vehicles"])), p["capacity_frac"] * F.col("cap"))) & (F.col("m") < p["speed_thr"]))
    hot = hot.select("video_id", F.col("bin_us").alias("start_us")).distinct().withColumn("end_us", F.col("start_us"))
    r = merge_intervals(hot, ["video_id"], gap=3 * bin_us, chunk_us=CHUNK).filter(F.col("end_us") - F.col("start_us") >= sec(p["min_len_sec"]))
    r = r.select("video_id", "start_us", (F.col("end_us") + bin_us).cast("bigint").alias("end_us")).join(x.scene.select("video_id", "vehicle_signal"), "video_id", "left")
    r = stage(r, "congestion_runs")
    ph = x.phases.select("video_id", "signal_id", "t0_us", "t1_us", "state")
    heads = ph.filter("state <> 'unknown'").groupBy("video_id").agg(F.collect_set("signal_id").alias("heads"))  # a few per video
    known = F.when(F.col("vehicle_signal").isNull(), F.size("heads") > 0).otherwise(F.array_contains("heads", F.col("vehicle_signal")))
    state = r.join(heads, "video_id", "left").select("video_id", "start_us", F.coalesce(known, F.lit(False)).alias("known"))
    green = overlap_join(r, ph.filter("state = 'green'").drop("state"), ["video_id"], ("start_us", "end_us"), ("t0_us", "t1_us"), BUCKET)
    green = green.filter("vehicle_signal IS NULL OR signal_id = vehicle_signal").groupBy("video_id", "start_us").agg(F.sum(F.least("end_us", "t1_us") - F.greatest("start_us", "t0_us")).alias("green"))
    d = r.join(state, ["video_id", "start_us"]).join(green, ["video_id", "start_us"], "left")
    ok = F.when(F.col("known"), F.coalesce("green", F.lit(0)) >= sec(p["green_overlap_sec"])).otherwise(F.col("end_us") - F.col("start_us") >= sec(p["min_len_no_signal_sec"]))
    return segments(d.filter(ok), "congestion", 0.8, F.array().cast("array<bigint>"))


def boxed(points: DataFrame, boxes: DataFrame, pad: Column | float = 0.0) -> DataFrame:
    """Keys (track, frame) of points that lie inside a box of the same frame, widened by ``pad``."""
    pad = pad if isinstance(pad, Column) else F.lit(pad)
    b = boxes.select(F.col("video_id").alias("__v"), F.col("frame").alias("__f"), *[F.col(c).alias(f"__{c}") for c in BOX])
    inside = (F.col("foot_x") >= F.col("__x1") - pad) & (F.col("foot_x") <= F.col("__x2") + pad) & (F.col("foot_y") >= F.col("__y1") - pad) & (F.col("foot_y") <= F.col("__y2") + pad)
    return points.join(b, (F.col("video_id") == F.col("__v")) & (F.col("frame") == F.col("__f")) & inside, "left_semi").select(*TRACK, "frame")


@rule("jaywalking")
def jaywalking(x: Tables, p: Mapping) -> DataFrame:
    ped = kind(x.tracks, "person").filter((F.col("track_size") >= p["min_size_frac"] * F.col("height")) & ~F.col("edge"))
    ped = ped.select(*TRACK, "frame", "t_us", "foot_x", "foot_y", "speed", "width", "height", geo.row_scale("foot_y").alias("bl"))
    med = exact_quantiles(ped, ["video_id"], "bl", {"bl_med": 0.5}, 4.0).drop("n")
    d = sc.locate(ped, x.scene, x.cells).join(med, "video_id").filter("has_road")
    buf = F.col("bl_med") * p["crosswalk_buffer_bl"]
    near_cw = F.when(sc.drawn("crosswalks"), sc.in_any("foot_x", "foot_y", "crosswalks") | F.coalesce(sc.nearest_outline("foot_x", "foot_y", "crosswalks") <= buf, F.lit(False))).otherwise(F.col("learned_crosswalk"))
    depth = F.col("road_px") / F.col("bl")
    d = d.withColumn("depth", depth).withColumn("cand", F.col("on_road") & (depth >= p["edge_margin_bl"]) & (F.col("speed") <= p["walk_speed_max"]) & ~near_cw)
    conf = F.when(sc.drawn("carriageway") & sc.drawn("crosswalks"), 0.8).otherwise(0.6)
    d = stage(d.select(*TRACK, "frame", "t_us", "foot_x", "foot_y", "bl", "depth", "cand", conf.alias("conf")), "jaywalking_rows")
    veh = kind(x.tracks, "vehicle", False).select("video_id", "frame", "speed", *BOX)
    c = d.filter("cand")
    # People in or next to vehicles are riders, passengers or drivers.
    off = boxed(c, veh).union(boxed(c, veh.filter("speed < 0.2"), F.col("bl") * p["vehicle_exit_bl"])).distinct()
    d = d.join(off.withColumn("__off", F.lit(True)), [*TRACK, "frame"], "left").withColumn("cand", F.col("cand") & F.col("__off").isNull())
    r = runs(d, TRACK, "t_us", "cand", sec(p["min_sec"]), sec(p["merge_gap_sec"]), CHUNK)
    at = F.struct("foot_x", "foot_y")
    r = r.join(d.select(*TRACK, F.col("t_us").alias("start_us"), at.alias("a")), [*TRACK, "start_us"]).select(*TRACK, "start_us", "end_us", "a")
    g = rows_in(d, r).groupBy(*TRACK, "start_us", "end_us").agg(
        F.max("depth").alias("depth"), F.max(geo.hypot(F.col("foot_x") - F.col("a.foot_x"), F.col("foot_y") - F.col("a.foot_y"))).alias("reach"), F.percentile("bl", F.lit(0.5)).alias("bl"), F.max("conf").alias("conf")
    )
    g = g.filter((F.col("depth") >= p["min_depth_bl"]) & (F.col("reach") / F.col("bl") >= p["min_move_bl"]))
    return segments(g, "jaywalking", F.col("conf"))


@rule("road_obstacle")
def road_obstacle(x: Tables, p: Mapping) -> DataFrame:
    d = x.tracks.filter(F.col("cls").isin([*ANIMALS, *OBJECTS])).select(*TRACK, "frame", "t_us", "cls", "speed", "foot_x", "foot_y", "width", "height", geo.row_scale("foot_y").alias("bl"))
    people = x.tracks.filter(F.col("cls") == PERSON)
    d = d.join(boxed(d, people, F.col("bl") * p["person_pad_bl"]), [*TRACK, "frame"], "left_anti")
    d = sc.locate(d, x.scene, x.cells).filter("has_road")
    animal = F.col("cls").isin(list(ANIMALS))
    d = d.withColumn("on", F.col("on_road") & (animal | (F.col("speed") < 0.3))).select(*TRACK, "t_us", "cls", "on")
    r = runs(d, [*TRACK, "cls"], "t_us", "on", 0, 1_000_000, CHUNK)
    need = F.when(animal, sec(p["animal_min_sec"])).otherwise(sec(p["object_min_sec"]))
    out = segments(r.filter(F.col("end_us") - F.col("start_us") >= need), "road_obstacle", 0.65, cls=F.col("cls"))
    if p["blob_enabled"] and x.thumbs is not None:
        from curbstream.plans.thumbnails import static_blobs

        b = static_blobs(x, p)
        out = out.unionByName(segments(b, "road_obstacle", p["blob_confidence"], F.array().cast("array<bigint>"), source=F.lit("blob")))
    return out


@rule("fire_smoke")
def fire_smoke(x: Tables, p: Mapping) -> DataFrame:
    from curbstream.plans.thumbnails import flicker_runs

    if x.thumbs is None:
        return segments(x.videos.filter(F.lit(False)).select("video_id", F.lit(0).alias("start_us"), F.lit(0).alias("end_us")), "fire_smoke", 0.5, F.array().cast("array<bigint>"))
    return segments(flicker_runs(x.thumbs, p), "fire_smoke", 0.5, F.array().cast("array<bigint>"), source=F.lit("heuristic"))


# ---------------------------------------------------------------- stopped vehicles


def stationary_episodes(d: DataFrame, p: Mapping) -> DataFrame:
    """Rows with their stop segment: ``seg`` changes after ``go_sec`` above ``go_speed``; ``ends`` marks that row."""
    go = sec(p["go_sec"])
    h = time_halo(d, "t_us", CHUNK, go + 3 * GAP, 0)
    w = Window.partitionBy(*TRACK, "chunk").orderBy("t_us")
    fast = F.col("speed") > p["go_speed"]
    h = h.withColumn("__slow_t", F.when(~fast, F.col("t_us"))).withColumn("__last_slow", F.last("__slow_t", ignorenulls=True).over(w))
    # Start of the fast run: the first row after the last slow one.
    h = h.withColumn("__fast", fast).withColumn("__since", F.min(F.when(F.col("__fast"), F.col("t_us"))).over(Window.partitionBy(*TRACK, "chunk", "__last_slow")))
    h = h.withColumn("__held", F.col("__fast") & (F.col("t_us") - F.col("__since") >= go))
    h = h.withColumn("ends", (F.col("__held") & ~F.coalesce(F.lag("__held").over(w), F.lit(False))).cast("int")).filter("home")
    h = h.select(*d.columns, "chunk", "ends")
    h = ordered_scan(h, TRACK, "chunk", ["t_us"], [Scan("sum", "ends", "__n")])
    return h.withColumn("seg", F.col("__n") - F.col("ends")).drop("__n", "chunk")


STOP = ["lost", "x", "y", "moved", "hx", "hy", "sc_a", "sc_b", "sc_min", "width", "height"]


def link_stops(e: DataFrame, gap_us: int, iou_min: float) -> DataFrame:
    """Stops at one place under changing ids become one: the values of the first, the last end, all tracks in order.

    In start order each stop joins the first chain, by its head's start, that was lost within the gap before and whose head's
    box it overlaps. A camera's stops fall into stretches that no chain can cross; each stretch is walked once in start
    order, holding only the chains that may still grow.
    """
    e = stage(e.withColumn("node", F.struct("start_us", "track_id")), "stops")
    own = [f"b{c}" for c in BOX]
    d = e.select("video_id", "node", "start_us", "track_id", "end_us", "lost", *own).withColumn("__reach", F.when(F.col("lost"), F.col("end_us") + gap_us))
    d = ordered_scan(with_chunk(d, "start_us", CHUNK), ["video_id"], "chunk", ["start_us", "track_id"], [Scan("max_before", "__reach", "__upto")])
    d = d.withColumn("__cut", F.when(F.coalesce(F.col("start_us") <= F.col("__upto"), F.lit(False)), 0).otherwise(1))
    d = ordered_scan(d, ["video_id"], "chunk", ["start_us", "track_id"], [Scan("sum", "__cut", "stretch")])
    cols = ["video_id", "stretch", "start_us", "track_id", "end_us", "lost", *own]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, chains = None, []  # a chain: end, head, head's box
        for batch in batches:
            heads: list[tuple[int, int]] = []
            for video, stretch, start, track, end, lost, *box in zip(*(batch.column(c).to_pylist() for c in cols), strict=True):
                if (video, stretch) != place:
                    place, chains = (video, stretch), []
                chains = [c for c in chains if c[0] >= start - gap_us]
                at = next((i for i, c in enumerate(chains) if c[0] <= start and _iou(c[2], box) > iou_min), None)
                chain = (end, (start, track), box) if at is None else (end, *chains[at][1:])
                heads.append(chain[1])
                if at is None:
                    chains += [chain] if lost else []
                else:
                    chains[at : at + 1] = [chain] if lost else []
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("video_id", "start_us", "track_id")), *(pa.array([h[i] for h in heads], pa.int64()) for i in (0, 1))], names=["video_id", "start_us", "track_id", "head_us", "head_track"])

    width = max(1, int(e.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = d.select(*cols).repartition(width, "video_id", "stretch").sortWithinPartitions("video_id", "stretch", "start_us", "track_id")
    up = dealt.mapInArrow(walk, "video_id bigint, start_us bigint, track_id bigint, head_us bigint, head_track bigint")
    up = up.select("video_id", F.struct("start_us", "track_id").alias("node"), F.struct(F.col("head_us").alias("start_us"), F.col("head_track").alias("track_id")).alias("head"))
    e = e.join(up, ["video_id", "node"])
    first, last = F.struct(*[c for c in STOP if c != "lost"]), F.col("lost")
    g = e.groupBy("video_id", "head").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.max_by(last, "node").alias("lost"), F.min_by(first, "node").alias("f"), F.transform(F.sort_array(F.collect_list("node")), lambda n: n["track_id"]).alias("tracks"))
    return g.select("video_id", "start_us", "end_us", "lost", "f.*", "tracks")


def _iou(a: Sequence[float], b: Sequence[float]) -> float:
    both = max(min(a[2], b[2]) - max(a[0], b[0]), 0.0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0.0)
    area = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / area if area > 0 else 0.0


@rule("stopped_vehicle")
def stopped_vehicle(x: Tables, p: Mapping, link: bool = True) -> DataFrame:
    allv = kind(x.tracks, "vehicle", False).select(*TRACK, "t_us", "foot_x", "foot_y", "vx", "vy", "speed", "width", "height")
    v = kind(x.tracks, "vehicle").filter(~F.col("cls").isin(list(p["exclude_classes"])) & (F.col("track_size") >= p["min_size_frac"] * F.col("height")))
    v = v.select(*TRACK, "t_us", "foot_x", "foot_y", "sx", "sy", "vx", "vy", "speed", *BOX, "sc_a", "sc_b", "sc_min", "width", "height")
    d = stage(stationary_episodes(v, p), "stop_rows")
    ep = d.groupBy(*TRACK, "seg").agg(
        F.min(F.when(F.col("speed") < p["stop_speed"], F.col("t_us"))).alias("start_us"), F.max(F.when(F.col("speed") <= p["go_speed"], F.col("t_us"))).alias("end_us"), (F.max("ends") == 0).alias("lost"),
        *[F.max(c).alias(c) for c in ("sc_a", "sc_b", "sc_min", "width", "height")],
    ).filter("start_us IS NOT NULL")
    ep = stage(ep.withColumns({"w0": F.col("start_us") - 15_000_000, "w1": F.col("start_us") - 1}), "stop_episodes")
    key = [*TRACK, "seg"]
    inside = rows_in(d.drop("sc_a", "sc_b", "sc_min", "width", "height", "seg", "ends"), ep.select(*key, "start_us", "end_us"))
    box = inside.groupBy(*key).agg(*[F.avg(c).alias(f"b{c}") for c in BOX])
    px = exact_quantiles(inside, key, "foot_x", {"x": 0.5}, 16.0).drop("n")
    py = exact_quantiles(inside, key, "foot_y", {"y": 0.5}, 16.0).drop("n")
    start = d.select(*TRACK, F.col("t_us").alias("start_us"), F.col("sx").alias("x0"), F.col("sy").alias("y0"))
    pre = rows_in(d.select(*TRACK, "t_us", "sx", "sy", "vx", "vy", "speed"), ep.select(*key, "w0", "w1"), "w0", "w1")
    mv = F.when(F.col("speed") > p["moving_speed"], F.struct("t_us", "vx", "vy"))
    # The 15 s before a stop are at most a few hundred rows.
    pre = pre.groupBy(*key).agg(F.min_by(F.struct("sx", "sy"), "t_us").alias("a"), F.slice(F.sort_array(F.collect_list(mv), asc=False), 1, 5).alias("mv"))
    e = ep.join(start, [*TRACK, "start_us"]).join(box, key).join(px, key).join(py, key).join(pre, key, "left")
    disp = geo.hypot(F.col("x0") - F.col("a.sx"), F.col("y0") - F.col("a.sy")) / geo.row_scale("y0")
    e = e.withColumn("moved", F.coalesce(disp >= p["moved_before_bl"], F.lit(False)))
    n = F.nullif(F.size("mv"), F.lit(0))
    mx, my = F.aggregate("mv", F.lit(0.0), lambda a, r: a + r["vx"]) / n, F.aggregate("mv", F.lit(0.0), lambda a, r: a + r["vy"]) / n
    norm = F.greatest(geo.hypot(mx, my), F.lit(1e-9))
    e = e.withColumns({"hx": F.when(F.col("moved"), mx / norm), "hy": F.when(F.col("moved"), my / norm)})
    e = stage(e.drop("a", "mv", "w0", "w1", "x0", "y0", "seg"), "stop_candidates")
    if link:
        e = link_stops(e, sec(p["link_gap_sec"]), p["link_iou"])
    else:
        e = e.withColumn("tracks", F.array("track_id"))
    e = e.filter(F.col("end_us") - F.col("start_us") >= sec(p["min_stationary_sec"]))
    e = e.filter("moved") if p["require_moving_before"] else e
    e = sc.locate(e, x.scene, x.cells, "x", "y").filter("on_road OR NOT has_road").withColumn("queued", sc.in_queue("x", "y"))
    e = e.join(x.scene.select("video_id", "vehicle_signal", "intersection"), "video_id")
    e = e.withColumn("junction", sc.in_any("x", "y", "intersection")).drop("carriageway", "non_road", "crosswalks", "queue_zones", "intersection")
    e = sc.lane_direction(e, x.scene, x.votes, "x", "y", False)
    sure = F.col("strength") > 0.3
    e = e.withColumns({"hx": F.coalesce("hx", F.when(sure, F.col("dir_x"))), "hy": F.coalesce("hy", F.when(sure, F.col("dir_y")))})
    e = e.withColumn("ep", F.struct("video_id", F.element_at("tracks", 1).alias("k"), "start_us")).withColumn("r", p["pass_radius_bl"] * geo.row_scale("y"))
    e = stage(e.select("ep", "video_id", "tracks", "start_us", "end_us", "x", "y", "r", "hx", "hy", "queued", "junction", "vehicle_signal"), "stop_checked")
    # Twenty samples of the signal over a stop in a queue.
    known = x.phases.filter("state <> 'unknown'").select("video_id", F.col("signal_id").alias("vehicle_signal")).distinct().withColumn("known", F.lit(True))
    sm = e.filter("queued AND vehicle_signal IS NOT NULL").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(19))))
    sm = sm.select("ep", "video_id", "vehicle_signal", "i", F.round(F.col("start_us") + (F.col("end_us") - F.col("start_us")) * F.col("i") / 19.0).cast("bigint").alias("t_us"))
    sm = signal_state(sm, x.phases, "vehicle_signal", "t_us", ["ep", "i"]).groupBy("ep").agg(F.avg(F.when(F.col("state") == "green", 0.0).otherwise(1.0)).alias("not_green"))
    e = e.join(known, ["video_id", "vehicle_signal"], "left").join(sm, "ep", "left")
    queue = F.when(F.col("queued") & F.coalesce("known", F.lit(False)), F.col("not_green") > 0.5).otherwise(F.col("queued")) | F.col("junction")
    e = e.withColumn("queue", queue)
    near = overlap_join(allv.select("video_id", "track_id", "t_us", "foot_x", "foot_y", "vx", "vy", "speed"), e.select("ep", "video_id", "tracks", "start_us", "end_us", "x", "y", "r", "hx", "hy"), ["video_id"], ("t_us", "t_us"), ("start_us", "end_us"), BUCKET)
    dist = geo.hypot(F.col("foot_x") - F.col("x"), F.col("foot_y") - F.col("y"))
    near = near.filter(~F.array_contains("tracks", F.col("track_id")) & (dist < 3 * F.col("r")))
    same = F.col("hx").isNull() | ((F.col("vx") * F.col("hx") + F.col("vy") * F.col("hy")) / F.greatest("speed", F.lit(1e-9)) > 0.5)
    passing = (dist < F.col("r")) & (F.col("speed") > p["moving_speed"]) & same
    near = stage(near.select("ep", "track_id", "speed", passing.alias("passing")), "stop_neighbours")
    cnt = near.groupBy("ep").agg(F.count(F.lit(1)).alias("n_near"), F.count_distinct(F.when(F.col("passing"), F.col("track_id"))).alias("passers"))
    med = exact_quantiles(near, ["ep"], "speed", {"near_speed": 0.5}, 0.1).drop("n")
    e = e.join(cnt, "ep", "left").join(med, "ep", "left")
    dur = F.col("end_us") - F.col("start_us")
    jam = (F.coalesce("n_near", F.lit(0)) >= 10) & (F.col("near_speed") < 0.3)
    conf = F.when(F.coalesce(jam, F.lit(False)) | (F.col("queue") & (dur < sec(p["queue_max_sec"]))), 0.2).when(F.col("passers") >= 1, 0.9).when(dur >= sec(p["lone_min_sec"]), 0.7).otherwise(0.3)
    return segments(e, "stopped_vehicle", conf, F.array_sort("tracks"), passers=F.coalesce("passers", F.lit(0)))


# ---------------------------------------------------------------- lines and crossings


def line_rows(x: Tables) -> DataFrame:
    """Vehicle rows beside each stop line: ``line, signal, fx, fy`` (front point), ``d`` (body lengths past the line), ``along``, ``ext``."""
    v = kind(x.tracks, "vehicle").join(x.scene.select("video_id", "stop_lines"), "video_id").filter(sc.drawn("stop_lines"))
    s, sp = geo.row_scale("sy"), F.greatest("speed", F.lit(1e-9))
    push = F.when(sp > 0.3, 0.5 * s / sp).otherwise(0.0)
    v = v.withColumns({"fx": F.col("sx") + push * F.col("vx"), "fy": F.col("sy") + push * F.col("vy")})
    v = v.select(*TRACK, "frame", "t_us", "fx", "fy", "speed", "heading", "sx", "sy", geo.row_scale("fy").alias("bl"), F.explode("stop_lines").alias("ln"))
    v = v.withColumns({"line": F.col("ln.id"), "signal": F.col("ln.signal"), "pts": F.col("ln.pts"), "app": F.col("ln.dir")})
    side = geo.line_side("fx", "fy")
    n = F.size("pts")
    mx = F.aggregate("pts", F.lit(0.0), lambda a, q: a + q["x"]) / n - F.col("app.x") * 10.0
    my = F.aggregate("pts", F.lit(0.0), lambda a, q: a + q["y"]) / n - F.col("app.y") * 10.0
    v = v.withColumns({"side": side, "from_drawn": F.when(F.col("app").isNotNull(), geo.line_side(mx, my))})
    v = stage(v.drop("ln"), "line_rows")
    # Where no approach is drawn, the first crossing of each track votes for the side it came from.
    h = time_halo(v.filter("app IS NULL"), "t_us", CHUNK, GAP, 0)
    w = Window.partitionBy(*TRACK, "line", "chunk").orderBy("t_us")
    h = h.withColumns({"px": F.lag("fx").over(w), "py": F.lag("fy").over(w), "ps": F.lag("side").over(w)}).filter("home AND px IS NOT NULL")
    h = h.filter(geo.path_crosses("px", "py", "fx", "fy")).groupBy(*TRACK, "line").agg(F.min_by("ps", "t_us").alias("s"))
    votes = h.groupBy("video_id", "line").agg(F.when(F.sum("s") >= 0, 1.0).otherwise(-1.0).alias("from_votes"))
    v = v.join(votes, ["video_id", "line"], "left")
    src = F.coalesce("from_drawn", "from_votes", F.lit(1.0))
    d = geo.line_distance("fx", "fy") / F.col("bl")
    a, b = F.get("pts", F.lit(0)), F.get("pts", F.size("pts") - 1)
    ux, uy = b["x"] - a["x"], b["y"] - a["y"]
    along = ((F.col("fx") - a["x"]) * ux + (F.col("fy") - a["y"]) * uy) / F.greatest(ux * ux + uy * uy, F.lit(1e-9))
    ext = F.col("bl") / F.greatest(geo.hypot(ux, uy), F.lit(1e-9))
    v = v.withColumns({"d": F.when(F.col("side") == src, -d).otherwise(d), "along": along, "ext": ext})
    return v.drop("pts", "app", "side", "from_drawn", "from_votes")


def in_span(margin: float) -> Column:
    return (F.col("along") >= -margin * F.col("ext")) & (F.col("along") <= 1 + margin * F.col("ext"))


@rule("red_light")
def red_light(x: Tables, p: Mapping) -> DataFrame:
    d = stage(line_rows(x), "line_distances")
    key = [*TRACK, "line"]
    win = sec(p["cross_window_sec"])
    h = time_halo(d, "t_us", CHUNK, win, win)
    w = Window.partitionBy(*key, "chunk").orderBy("t_us")
    h = h.withColumns({
        "pd": F.lag("d").over(w),
        "was": F.max((F.col("d") <= -p["before_bl"]).cast("int")).over(w.rangeBetween(-win, -1)),
        "gets": F.max((F.col("d") >= p["after_bl"]).cast("int")).over(w.rangeBetween(1, win)),
    }).filter("home")
    hit = (F.col("d") >= 0) & (F.col("pd") < 0) & in_span(0.5) & (F.col("speed") >= p["min_speed"]) & (F.col("was") == 1) & (F.col("gets") == 1)
    k = h.filter(hit).groupBy(*key).agg(F.min("t_us").alias("start_us"), F.max("signal").alias("signal"))
    k = signal_state(k, x.phases, "signal", "start_us", [*TRACK, "line"]).filter((F.col("state") == "red") & (F.col("start_us") - F.col("state_since") >= sec(p["grace_sec"])))
    k = k.join(known_videos(x.phases), "video_id", "left_semi").join(x.scene.select("video_id", "right_turn_on_red"), "video_id")
    cap = sec(p["max_len_sec"])
    k = stage(k.withColumns({"w0": F.col("start_us") + 1, "w1": F.col("start_us") + cap, "w5": F.col("start_us") + 5_000_000}), "red_crossings")
    # Turning right: clockwise heading gathered over the moving rows of the next 5 s.
    tr = rows_in(d.filter("speed > 0.5").select(*key, "t_us", "heading"), k.filter("right_turn_on_red").select(*key, "start_us", "w5"), "start_us", "w5", key)
    wt = Window.partitionBy(*key, "start_us").orderBy("t_us")
    tr = tr.withColumn("dh", geo.angle_diff("heading", F.lag("heading").over(wt))).withColumn("cum", F.sum("dh").over(wt.rowsBetween(Window.unboundedPreceding, 0)))
    right = tr.groupBy(*key).agg(F.max("cum").alias("m")).filter(F.col("m") > p["right_turn_deg"]).select(*key)
    k = k.join(right, key, "left_anti")
    past = rows_in(d.filter(F.col("d") >= p["clear_bl"]).select(*key, "t_us"), k.select(*key, "w0", "w1"), "w0", "w1", key).groupBy(*key).agg(F.min("t_us").alias("past_us"))
    last = d.groupBy(*key).agg(F.max("t_us").alias("last_us"))
    k = k.join(past, key, "left").join(last, key)
    k = k.withColumn("end_us", F.least(F.coalesce("past_us", "last_us"), F.col("w1")))
    return segments(k, "red_light", 0.8, line=F.col("line"))


@rule("stop_line")
def stop_line(x: Tables, p: Mapping) -> DataFrame:
    d = line_rows(x).join(known_videos(x.phases), "video_id", "left_semi").join(x.scene.select("video_id", "intersection"), "video_id")
    bad = F.col("d").between(p["min_past_bl"], p["max_past_bl"]) & in_span(0.3) & (F.col("speed") < p["stop_speed"]) & ~sc.in_any("sx", "sy", "intersection")
    d = stage(d.withColumn("bad", bad).select(*TRACK, "line", "signal", "t_us", "d", "bad"), "stop_line_rows")
    key = [*TRACK, "line"]
    r = runs(d, key, "t_us", "bad", sec(p["min_stop_sec"]), 0, CHUNK, aggs=[F.max("signal").alias("signal")])
    r = r.join(d.filter("d < -0.3").select(*key).distinct(), key, "left_semi").drop("island", "n_rows")
    r = stage(r, "stop_line_runs")
    s = rows_in(d.filter("bad").select(*key, "t_us"), r, keys=key)
    s = signal_state(s, x.phases, "signal", "t_us", key).groupBy(*key, "start_us").agg(F.avg(F.when(F.col("state") == "red", 1.0).otherwise(0.0)).alias("red"))
    r = r.join(s.filter("red >= 0.5").select(*key, "start_us"), [*key, "start_us"], "left_semi")
    r = next_change(with_head(r, x.phases, "signal"), x.phases.withColumnRenamed("signal_id", "__sig"), ["video_id", "__sig"], "start_us", "green", [*TRACK, "line"], "green_us", CHUNK)
    r = r.withColumn("end_us", F.least("end_us", F.coalesce("green_us", F.col("end_us")))).filter("end_us > start_us")
    return segments(r, "stop_line", 0.7, line=F.col("line"))


@rule("solid_line_crossing")
def solid_line_crossing(x: Tables, p: Mapping) -> DataFrame:
    v = kind(x.tracks, "vehicle").join(x.scene.select("video_id", "solid_lines"), "video_id").filter(sc.drawn("solid_lines"))
    fast = v.groupBy(*TRACK).agg(F.max("speed").alias("m")).filter(F.col("m") >= p["min_speed"]).select(*TRACK)
    v = v.select(*TRACK, "t_us", "sx", "sy", *BOX, F.explode("solid_lines").alias("ln")).join(fast, TRACK, "left_semi")
    v = v.withColumns({"line": F.col("ln.id"), "pts": F.col("ln.pts"), "top": geo.foot_top(frac=p["footprint_frac"])}).drop("ln")
    sides = F.array(*[geo.line_side(a, b) for a in ("x1", "x2") for b in ("top", "y2")])
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("top") + F.col("y2")) / 2
    diag = geo.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("top"))
    touch = (F.array_min(sides) != F.array_max(sides)) & (geo.line_distance(cx, cy) <= diag / 2)
    d = stage(v.select(*TRACK, "line", "t_us", geo.line_side("sx", "sy").alias("side"), touch.alias("touch")), "solid_line_rows")
    key = [*TRACK, "line"]
    span = sec(p["hold_sec"]) + 5_000_000
    r = runs(d, key, "t_us", "touch", chunk_us=CHUNK).drop("island", "n_rows").withColumns({"w0": F.col("start_us") - span, "w1": F.col("end_us") + span})
    a = rows_in(d.select(*key, "t_us", "side"), r, "w0", "w1", key)
    pre, post = F.col("t_us") < F.col("start_us"), F.col("t_us") > F.col("end_us")
    g = a.groupBy(*key, "start_us", "end_us").agg(
        F.avg(F.when(pre, F.col("side"))).alias("sb"), F.min(F.when(post, F.col("side"))).alias("s0"), F.max(F.when(post, F.col("side"))).alias("s1"),
        (F.max(F.when(post, F.col("t_us"))) - F.min(F.when(post, F.col("t_us")))).alias("held"),
    )
    g = g.filter((F.col("s0") == F.col("s1")) & (F.col("held") >= sec(p["hold_sec"])) & (F.col("sb") * F.col("s0") < 0))
    return segments(g, "solid_line_crossing", 0.7)


@rule("failure_to_yield")
def failure_to_yield(x: Tables, p: Mapping) -> DataFrame:
    """Crosswalks: the drawn ones by number, else the learned cells as number 0."""

    def on_crosswalk(d: DataFrame) -> DataFrame:
        d = sc.locate(d, x.scene, x.cells, kinds=("carriageway", "non_road", "crosswalks")).filter("has_crosswalks")
        hit = sc.first_match("foot_x", "foot_y", "crosswalks")
        return d.withColumn("cw", F.when(sc.drawn("crosswalks"), hit["ord"]).otherwise(F.when(F.col("learned_crosswalk"), F.lit(0)))).withColumn("drawn", sc.drawn("crosswalks"))

    ped = kind(x.tracks, "person").filter(F.col("speed").between(p["walk_speed_min"], p["walk_speed_max"]))
    ped = on_crosswalk(ped.select(*TRACK, "frame", "foot_x", "foot_y", "width", "height")).filter("cw IS NOT NULL").select(*TRACK, "frame", "foot_x", "foot_y", "cw")
    ped = ped.join(boxed(ped, kind(x.tracks, "vehicle", False)), [*TRACK, "frame"], "left_anti")
    ped = ped.select("video_id", "frame", "cw", F.col("foot_x").alias("px"), F.col("foot_y").alias("py"))
    v = kind(x.tracks, "vehicle").filter(F.col("cls").isin(list(p["vehicle_classes"])))
    v = on_crosswalk(v.select(*TRACK, "frame", "t_us", "foot_x", "foot_y", "vx", "vy", "speed", *BOX, geo.row_scale("foot_y").alias("bl"), "width", "height"))
    v = stage(v.select(*TRACK, "frame", "t_us", "foot_x", "foot_y", "vx", "vy", "speed", *BOX, "bl", "cw", "drawn", "crosswalks"), "yield_rows")
    # One row per track row and crosswalk number the track ever meets.
    met = v.filter("cw IS NOT NULL").select(*TRACK, F.col("cw").alias("c")).distinct()
    m = v.drop("crosswalks").join(met, TRACK).withColumn("on", F.coalesce(F.col("cw") == F.col("c"), F.lit(False)))
    key = [*TRACK, "c"]
    r = runs(m, key, "t_us", "on", sec(p["min_sec"]), 500_000, CHUNK).drop("island", "n_rows")
    cap = sec(p["max_len_sec"])
    r = r.withColumns({"entry": F.col("start_us") + 1_000_000, "s": F.col("start_us"), "e": F.least(F.col("end_us"), F.col("start_us") + cap)})
    r = stage(r, "yield_runs")
    en = rows_in(v.select(*TRACK, "t_us", "speed"), r.select(*key, "s", "entry"), "s", "entry").groupBy(*key, "s").agg(F.percentile("speed", F.lit(0.5)).alias("med"))
    r = r.join(en.filter(F.col("med") >= p["min_speed"]).select(*key, "s"), [*key, "s"], "left_semi")
    cws = x.scene.select("video_id", F.explode("crosswalks").alias("k")).select("video_id", F.col("k.ord").alias("c"), F.col("k.signal").alias("sig"))
    r = r.join(cws, ["video_id", "c"], "left")
    r = state_at(r.withColumn("__sig", F.coalesce("sig", F.lit(""))), x.phases.withColumnRenamed("signal_id", "__sig"), ["video_id", "__sig"], "s", [*TRACK, "c"], "st", CHUNK).filter("st <> 'green'")
    r = stage(r.select(*key, "s", "e"), "yield_open")
    near = rows_in(v.select(*TRACK, "frame", "t_us", "foot_x", "foot_y", "vx", "vy", "bl"), r, "s", "e")
    near = near.join(ped.withColumnRenamed("cw", "c"), ["video_id", "frame", "c"])
    dx, dy = (F.col("px") - F.col("foot_x")) / F.col("bl"), (F.col("py") - F.col("foot_y")) / F.col("bl")
    sp = geo.hypot(F.col("vx"), F.col("vy"))
    near = near.filter((geo.hypot(dx, dy) <= p["near_bl"]) & ((sp < 1e-6) | ((dx * F.col("vx") + dy * F.col("vy")) / sp > -0.5)))
    r = r.join(near.select(*key, "s").distinct(), [*key, "s"], "left_semi")
    r = stage(r, "yield_conflicts")
    # Widen to the rows where the footprint touches the crossing: from entering to leaving it.
    w = v.join(r.select(*key).distinct(), TRACK).withColumn("pts", F.get(F.filter("crosswalks", lambda k: k["ord"] == F.col("c")), F.lit(0))["pts"])
    w = w.withColumn("top", geo.foot_top())
    touch = F.lit(False)
    for px in (F.col("x1"), (F.col("x1") + F.col("x2")) / 2, F.col("x2")):
        for py in (F.col("top"), F.col("y2")):
            touch = touch | geo.poly_contains(px, py)
    w = w.select(*key, "t_us", "drawn", F.when(F.col("drawn"), touch).otherwise(F.lit(False)).alias("touch"))
    own = rows_in(w, r, "s", "e", key).select(*key, "t_us", "s").withColumn("__in", F.lit(True))
    w = w.join(own, [*key, "t_us"], "left").withColumn("touch", F.coalesce("touch", F.lit(False)) | F.col("__in").isNotNull())
    from curbstream.operators.ordered import run_rows

    isl = run_rows(w.select(*key, "t_us", "touch", "s"), key, "t_us", "touch", chunk_us=CHUNK)
    b = isl.groupBy(*key, "island").agg(F.min("t_us").alias("a_us"), F.max("t_us").alias("b_us"))
    hit = isl.filter("s IS NOT NULL").select(*key, "island", "s").distinct().join(b, [*key, "island"])
    flag = v.select(*TRACK, "drawn").groupBy("video_id").agg(F.max("drawn").alias("drawn"))
    out = r.join(hit, [*key, "s"]).join(flag, "video_id")
    out = out.withColumn("start_us", F.when(F.col("drawn"), F.col("a_us")).otherwise(F.col("s")))
    end = F.when(F.col("drawn"), F.col("b_us")).otherwise(F.col("e"))
    lim = rows_in(v.select(*TRACK, "t_us"), out.select(*key, "s", "start_us", F.least(end, F.col("start_us") + cap).alias("lim")), "start_us", "lim").groupBy(*key, "s").agg(F.max("t_us").alias("end_us"))
    return segments(out.join(lim, [*key, "s"]), "failure_to_yield", F.when(F.col("drawn"), 0.75).otherwise(0.55), crosswalk=F.col("c"))


# ---------------------------------------------------------------- turns


def turn_changes(v: DataFrame, min_speed: float) -> DataFrame:
    """Moving rows with the heading change gathered so far (``cum``, unwrapped)."""
    m = with_chunk(v.filter(F.col("speed") > min_speed), "t_us", CHUNK)
    m = ordered_scan(m, TRACK, "chunk", ["t_us"], [Scan("lag", "heading", "__ph")])
    m = m.withColumn("dh", F.coalesce(geo.angle_diff("heading", "__ph"), F.lit(0.0)))
    return ordered_scan(m, TRACK, "chunk", ["t_us"], [Scan("sum", "dh", "cum")]).drop("chunk", "__ph", "dh")


def turn_windows(m: DataFrame, p: Mapping) -> DataFrame:
    """Start and end of the turn of each track in ``m`` (moving rows with ``cum``).

    It starts when the change leaves ``start_deg`` around its first values and ends when the rate stays
    below ``settle_rate`` for 1 s after the largest change.
    """
    m = with_chunk(m, "t_us", CHUNK)
    m = stage(ordered_scan(m, TRACK, "chunk", ["t_us"], [Scan("count", "t_us", "rn"), Scan("lag", "t_us", "tp"), Scan("lead", "t_us", "tn"), Scan("lag", "cum", "cp"), Scan("lead", "cum", "cn")]), "turn_rows")
    base = m.filter("rn <= 5").groupBy(*TRACK).agg(F.percentile("cum", F.lit(0.5)).alias("base"), F.max("rn").alias("k"))
    m = m.join(base.filter("k >= 3").drop("k"), TRACK).withColumn("dev", F.abs(F.col("cum") - F.col("base")))
    hs, hd = (F.col("t_us") - F.col("tp")) / 1e6, (F.col("tn") - F.col("t_us")) / 1e6
    mid = (hs * hs * F.col("cn") + (hd * hd - hs * hs) * F.col("cum") - hd * hd * F.col("cp")) / (hs * hd * (hd + hs))
    rate = F.abs(F.when(hs.isNull(), (F.col("cn") - F.col("cum")) / hd).when(hd.isNull(), (F.col("cum") - F.col("cp")) / hs).otherwise(mid))
    peak = m.groupBy(*TRACK).agg(
        F.min(F.when(F.col("dev") > p["start_deg"], F.col("t_us"))).alias("start_us"), F.max_by("t_us", F.struct(F.col("dev"), -F.col("t_us"))).alias("peak_us"), F.max("t_us").alias("last_us")
    ).filter("start_us IS NOT NULL")
    calm = m.join(peak.select(*TRACK, "peak_us"), TRACK).filter("t_us >= peak_us").withColumn("calm", rate < p["settle_rate"])
    r = runs(calm, TRACK, "t_us", "calm", 1_000_000, 0, CHUNK).groupBy(*TRACK).agg(F.min("start_us").alias("calm_us"))
    d = peak.join(r, TRACK, "left")
    return d.select(*TRACK, "start_us", F.greatest(F.coalesce("calm_us", "last_us"), F.col("peak_us")).alias("end_us"))


def turn_range(m: DataFrame) -> DataFrame:
    return m.groupBy(*TRACK).agg((F.max("cum") - F.min("cum")).alias("ptp"), F.count(F.lit(1)).alias("n_moving"), F.min_by("cum", "t_us").alias("c0")).filter("n_moving >= 3")


@rule("illegal_u_turn")
def illegal_u_turn(x: Tables, p: Mapping) -> DataFrame:
    s = x.scene.select("video_id", "no_u_turn_zones")
    v = kind(x.tracks, "vehicle").select(*TRACK, "t_us", "sx", "sy", "speed", "heading").join(s, "video_id")
    v = v if p["illegal_everywhere"] else v.filter(sc.drawn("no_u_turn_zones"))
    m = stage(turn_changes(v, p["min_speed"]), "u_turn_rows")
    turn = turn_range(m).filter(F.col("ptp") >= p["u_turn_deg"])
    m = m.join(turn, TRACK)
    half = F.abs(F.abs(F.col("cum") - F.col("c0")) - F.col("ptp") / 2)
    mid = m.groupBy(*TRACK).agg(F.min_by(F.struct("sx", "sy", "no_u_turn_zones"), F.struct(half.alias("h"), "t_us")).alias("m"))
    mid = mid.withColumns({"mx": F.col("m.sx"), "my": F.col("m.sy"), "z": F.col("m.no_u_turn_zones")}).filter((F.size("z") == 0) | sc.in_any("mx", "my", "z"))
    d = turn_windows(m.select(*TRACK, "t_us", "cum"), p).join(mid, TRACK)
    return segments(d, "illegal_u_turn", F.when(F.size("z") > 0, 0.75).otherwise(0.55))


@rule("illegal_turn")
def illegal_turn(x: Tables, p: Mapping) -> DataFrame:
    s = x.scene.select("video_id", "exit_zones", "movements").filter(sc.drawn("exit_zones") & sc.drawn("movements"))
    v = kind(x.tracks, "vehicle").select(*TRACK, "t_us", "sx", "sy", "speed", "heading").join(s.select("video_id"), "video_id", "left_semi")
    v = stage(v, "turn_input")
    n = ordered_scan(with_chunk(v, "t_us", CHUNK), TRACK, "chunk", ["t_us"], [Scan("count", "t_us", "rn")]).drop("chunk")
    total = v.groupBy(*TRACK).agg(F.count(F.lit(1)).alias("n"))
    ends = n.join(total, TRACK).filter("rn <= 10 OR rn > n - 10").join(s, "video_id").withColumn("zone", sc.first_match("sx", "sy", "exit_zones")["id"]).filter("zone IS NOT NULL")
    g = ends.groupBy(*TRACK).agg(F.min_by("zone", F.when(F.col("rn") <= 10, F.col("rn"))).alias("entry"), F.max_by("zone", F.when(F.col("rn") > F.col("n") - 10, F.col("rn"))).alias("exit"), F.first("movements").alias("movements"))
    g = g.filter("entry <> exit").filter(~F.exists("movements", lambda q: (q["entry"] == F.col("entry")) & (q["exit"] == F.col("exit"))))
    m = stage(turn_changes(v.join(g.select(*TRACK), TRACK, "left_semi"), p["min_speed"]), "turn_moving")
    m = m.join(turn_range(m).filter(F.col("ptp") < p["u_turn_deg"]).select(*TRACK), TRACK, "left_semi")
    d = turn_windows(m.select(*TRACK, "t_us", "cum"), p).join(g, TRACK)
    return segments(d, "illegal_turn", 0.75, movement=F.concat_ws(">", "entry", "exit"))
