"""Rules over small image cells kept as rows ``video_id, t_us, py, px, h, s, v, gray``."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curbstream.operators import scene as sc
from curbstream.operators.intervals import overlap_join
from curbstream.operators.ordered import DAY_US, Scan, ordered_scan, runs, time_halo, with_chunk
from curbstream.operators.quantiles import exact_quantiles
from curbstream.plans.params import sec
from curbstream.session import stage

CHUNK = 3_600_000_000
LEAST_PICTURES = 20


def flicker_runs(thumbs: DataFrame, p: Mapping, keys: tuple = ("video_id",)) -> DataFrame:
    """Times at which enough flame-coloured cells change brightness, as runs."""
    cell = [*keys, "py", "px"]
    d = ordered_scan(with_chunk(thumbs, "t_us", CHUNK), cell, "chunk", ["t_us"], [Scan("lag", "v", "__pv")])
    mask = (F.col("h") <= 30) & (F.col("s") >= 120) & (F.col("v") >= 200)
    g = d.groupBy(*keys, "t_us").agg(F.avg(mask.cast("double")).alias("share"), F.avg(F.when(mask, F.abs(F.col("v") - F.col("__pv")))).alias("change"))
    g = g.withColumn("fire", F.coalesce((F.col("share") >= p["min_area_frac"]) & (F.col("change") >= p["flicker_thr"]), F.lit(False)))
    g = stage(g.select(*keys, "t_us", "fire"), "flicker")
    return runs(g, list(keys), "t_us", "fire", sec(p["min_sec"]), 1_500_000, CHUNK).drop("island", "n_rows")


def static_cells(thumbs: DataFrame, p: Mapping) -> DataFrame:
    """Cells that differ from their own median of 60 to 10 s ago (8 samples at least)."""
    h = time_halo(thumbs, "t_us", CHUNK, 60_000_000, 0)
    w = Window.partitionBy("video_id", "py", "px", "chunk").orderBy("t_us").rangeBetween(-60_000_000, -10_000_000)
    h = h.withColumns({"n": F.count("gray").over(w), "bg": F.percentile("gray", F.lit(0.5)).over(w)}).filter("home")
    return h.filter((F.col("n") >= 8) & (F.abs(F.col("gray") - F.floor("bg")) > p["blob_diff"])).select("video_id", "t_us", "py", "px")


def static_blobs(x, p: Mapping) -> DataFrame:
    """Foreground that stays in place on the road and that no tracked box explains: ``video_id, start_us, end_us``.

    Only ``video_id, t_us, py, px, gray`` of the pictures are read. A cell's background comes from its own past, a picture's
    regions from its foreground cells alone, so no task holds a picture of all times. Videos with fewer than 20 pictures have none.
    """
    times = stage(x.thumbs.groupBy("video_id", "t_us").agg((F.max("py") + 1).alias("gh"), (F.max("px") + 1).alias("gw")), "picture_times")
    size = times.groupBy("video_id").agg(F.max("gh").alias("gh"), F.max("gw").alias("gw"), F.count(F.lit(1)).alias("pictures")).filter(F.col("pictures") >= LEAST_PICTURES)
    size = stage(size.drop("pictures"), "picture_sizes")
    vid = x.videos.select("video_id", "width", "height").join(size, "video_id")
    fg = stage(static_cells(x.thumbs, p), "picture_foreground").join(size, "video_id")
    fg = fg.withColumnsRenamed({"py": "iy", "px": "ix"})
    # Opening with a 3x3 square; cells outside the picture do not erode.
    n = sc.spread(fg).groupBy("video_id", "t_us", "iy", "ix", "gh", "gw").agg(F.count(F.lit(1)).alias("n"))
    rows = F.least(F.col("iy") + 1, F.col("gh") - 1) - F.greatest(F.col("iy") - 1, F.lit(0)) + 1
    cols = F.least(F.col("ix") + 1, F.col("gw") - 1) - F.greatest(F.col("ix") - 1, F.lit(0)) + 1
    fg = sc.spread(n.filter(F.col("n") == rows * cols).drop("n")).distinct().select("video_id", "t_us", "iy", "ix")
    fg = fg.join(vid, "video_id").withColumns({"cx": (F.col("ix") + 0.5) * F.col("width") / F.col("gw"), "cy": (F.col("iy") + 0.5) * F.col("height") / F.col("gh"), "py": F.col("iy"), "px": F.col("ix")}).drop("iy", "ix")
    fg = sc.locate(fg, x.scene, x.cells, "cx", "cy").filter("on_road").select("video_id", "t_us", "py", "px", "width", "height", "gw", "gh")
    # The boxed frame nearest in time, if within a second.
    t = times.select("video_id", "t_us").withColumns({"lo": F.col("t_us") - 999_999, "hi": F.col("t_us") + 999_999})
    fr = x.tracks.select("video_id", F.col("t_us").alias("bt")).distinct()
    near = overlap_join(fr, t, ["video_id"], ("bt", "bt"), ("lo", "hi"), 60_000_000).groupBy("video_id", "t_us").agg(F.min_by("bt", F.struct(F.abs(F.col("bt") - F.col("t_us")), "bt")).alias("bt"))
    b = x.tracks.select("video_id", F.col("t_us").alias("bt"), "x1", "y1", "x2", "y2").join(near, ["video_id", "bt"]).drop("bt").withColumn("pad", 0.2 * (F.col("x2") - F.col("x1"))).withColumnsRenamed({"video_id": "bv", "t_us": "bt"})
    sx, sy = F.col("gw") / F.col("width"), F.col("gh") / F.col("height")
    hit = (F.col("py") >= F.floor((F.col("y1") - F.col("pad")) * sy)) & (F.col("py") <= F.floor((F.col("y2") + F.col("pad")) * sy)) & (F.col("px") >= F.floor((F.col("x1") - F.col("pad")) * sx)) & (F.col("px") <= F.floor((F.col("x2") + F.col("pad")) * sx))
    fg = stage(fg.join(b, (F.col("video_id") == F.col("bv")) & (F.col("t_us") == F.col("bt")) & hit, "left_anti").select("video_id", "t_us", "py", "px"), "picture_things").withColumn("fg", F.lit(1))
    # Sample numbers make "held n samples in a row" a difference of counts.
    ts = with_chunk(times.select("video_id", "t_us"), "t_us", DAY_US)
    ts = stage(ordered_scan(ts, ["video_id"], "chunk", ["t_us"], [Scan("count", "t_us", "k"), Scan("lag", "t_us", "__p")]), "picture_numbers")
    step = exact_quantiles(ts.filter("__p IS NOT NULL").withColumn("dt", F.col("t_us") - F.col("__p")), ["video_id"], "dt", {"step": 0.5}, 1e5).drop("n")
    hold = step.select("video_id", F.greatest(F.lit(2), F.bround(F.lit(sec(p["blob_min_sec"])) / F.greatest("step", F.lit(1_000)))).cast("bigint").alias("hold"))
    cell = ["video_id", "py", "px"]
    f = fg.join(ts.select("video_id", "t_us", "k"), ["video_id", "t_us"]).withColumn("chunk", F.floor(F.col("k") / 3600))
    f = ordered_scan(f, cell, "chunk", ["k"], [Scan("lag", "k", "__pk")]).withColumn("first", F.when(F.col("__pk") == F.col("k") - 1, None).otherwise(F.col("k")))
    f = ordered_scan(f, cell, "chunk", ["k"], [Scan("last", "first", "k0")]).join(hold, "video_id").filter(F.col("k") - F.col("k0") + 1 >= F.col("hold"))
    area = f.groupBy("video_id", "t_us").agg(F.count(F.lit(1)).alias("n")).join(size, "video_id").filter(F.col("n") >= p["blob_min_area_frac"] * F.col("gh") * F.col("gw")).select("video_id", "t_us").withColumn("on", F.lit(True))
    s = ts.join(area, ["video_id", "t_us"], "left").withColumn("on", F.coalesce("on", F.lit(False)))
    r = runs(s, ["video_id"], "t_us", "on", 0, 2_000_000, DAY_US, aggs=[F.min("k").alias("k1")]).join(hold, "video_id")
    back = ts.select("video_id", F.col("k").alias("kb"), F.col("t_us").alias("start2"))
    r = r.withColumn("kb", F.greatest(F.col("k1") - F.col("hold") + 1, F.lit(1))).join(back, ["video_id", "kb"])
    return r.select("video_id", F.col("start2").alias("start_us"), "end_us")
