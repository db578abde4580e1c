"""JSON documents: scenes, ground truth, predictions and reviews."""
from __future__ import annotations

import json
import os
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHAPES = "video_id BIGINT, kind STRING, ord INT, id STRING, pts ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>, signal STRING, dir STRUCT<x: DOUBLE, y: DOUBLE>"
LABELS = "map<string, struct<duration: double, fps: double, events: array<array<string>>, risk: array<array<double>>>>"


def sane_fps(fps: Column) -> Column:
    return F.when(fps.between(1.0, 240.0), fps).otherwise(F.lit(25.0))


def read_scene(path: str) -> dict | None:
    if not path or not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def scene_shapes(spark: SparkSession, scene: Mapping | None) -> tuple[DataFrame, list[tuple[str, str]], bool]:
    """A scene document as a small table of normalised shapes, its allowed movements and the right-turn flag.

    A scene is drawn by hand, so the table has tens of rows. ``ord`` carries "the first match wins".
    """
    scene = scene or {}
    iw, ih = (1.0, 1.0) if scene.get("normalized", True) else scene["image_size"]
    rows = []

    def add(kind, i, pts, ident=None, signal=None, direction=None):
        p = [(float(x) / iw, float(y) / ih) for x, y in pts]
        d = (float(direction[0]) / iw, float(direction[1]) / ih) if direction else None
        rows.append((kind, i, str(ident if ident is not None else i), p, signal, d))

    for kind in ("carriageway", "non_road", "queue_zones", "intersection", "fixed_objects", "no_u_turn_zones", "solid_lines"):
        for i, p in enumerate(scene.get(kind, [])):
            add(kind, i, p)
    for i, c in enumerate(scene.get("crosswalks", [])):
        c = c if isinstance(c, Mapping) else {"polygon": c}
        add("crosswalks", i, c["polygon"], None, c.get("signal"))
    for i, ln in enumerate(scene.get("lanes", [])):
        add("lanes", i, ln["polygon"], ln.get("id"), None, ln["direction"])
    for i, z in enumerate(scene.get("exit_zones", [])):
        add("exit_zones", i, z["polygon"], z.get("id"))
    for i, s in enumerate(scene.get("stop_lines", [])):
        add("stop_lines", i, s["points"], s.get("id"), s.get("signal"), s.get("approach"))
    for i, g in enumerate(scene.get("signal_rois", [])):
        x1, y1, x2, y2 = g["rect"]
        add("signal_rois", i, [(x1, y1), (x2, y1), (x2, y2), (x1, y2)], g.get("id"), g.get("kind", "vehicle"))
    schema = "kind STRING, ord INT, id STRING, pts ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>, signal STRING, dir STRUCT<x: DOUBLE, y: DOUBLE>"
    moves = [(str(a), str(b)) for a, b in scene.get("allowed_movements", [])]
    return spark.createDataFrame(rows, schema), moves, bool(scene.get("right_turn_on_red", False))


def shapes_for_videos(shapes: DataFrame, videos: DataFrame) -> DataFrame:
    """The drawn shapes in the pixels of each video. Directions become unit vectors in pixel space."""
    d = videos.select("video_id", "width", "height").join(F.broadcast(shapes))  # tens of rows
    scale = F.transform("pts", lambda p: F.struct((p["x"] * F.col("width")).alias("x"), (p["y"] * F.col("height")).alias("y")))
    dx, dy = F.col("dir.x") * F.col("width"), F.col("dir.y") * F.col("height")
    n = F.nullif(F.sqrt(dx * dx + dy * dy), F.lit(0.0))
    unit = F.when(F.col("dir").isNotNull(), F.struct((dx / n).alias("x"), (dy / n).alias("y")))
    return d.select("video_id", "kind", "ord", "id", scale.alias("pts"), "signal", unit.alias("dir"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth or predictions: ``video, duration, fps, events, risk`` per video, from one or many JSON files.

    The videos may sit at the top level or under ``videos``; entries without ``events`` are left out.
    """
    t = spark.read.text(path, wholetext=True)
    inner = F.from_json(F.coalesce(F.get_json_object("value", "$.videos"), F.col("value")), LABELS)
    d = t.select(F.explode(inner).alias("video", "e")).select("video", "e.*")
    return d.filter("events IS NOT NULL")


def label_events(labels: DataFrame) -> DataFrame:
    """One row per event: ``video, pos, start_us, end_us, label``. Rows that are no [start, end, label] get nulls."""
    e = labels.select("video", F.posexplode("events").alias("pos", "v"))

    def us(i: int) -> Column:
        return F.round(F.get("v", F.lit(i)).try_cast("double") * 1e6).cast("bigint")

    return e.select("video", "pos", us(0).alias("start_us"), us(1).alias("end_us"), F.get("v", F.lit(2)).alias("label"))


def label_curve(labels: DataFrame) -> DataFrame:
    c = labels.select("video", F.posexplode("risk").alias("pos", "v"))
    return c.select("video", "pos", F.round(F.get("v", F.lit(0)) * 1e6).cast("bigint").alias("t_us"), F.get("v", F.lit(1)).alias("score"))


def _json_list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def prediction_rows(events: DataFrame, risk: DataFrame, videos: DataFrame | None = None) -> DataFrame:
    """The JSON value of each video for export: ``events`` as [start, end, label], ``risk`` as [t, score], numbers as numbers.

    Both lists are as long as the clip. ``videos`` adds clips without events and their ``duration`` and ``fps``.
    """
    row = lambda *parts: F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))
    num = lambda c: F.to_json(F.struct(F.col(c).alias("v")))
    number = lambda c: F.regexp_extract(num(c), r":(.*)\}$", 1)
    label = F.regexp_extract(F.to_json(F.struct(F.col("label").alias("v"))), r":(.*)\}$", 1)
    e = events.select("video_id", "start", "end", "label", row(number("start"), number("end"), label).alias("item"))
    e = e.groupBy("video_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("start", "end", "label", "item"))), lambda x: x["item"]).alias("events"))
    c = risk.select("video_id", "t", row(number("t"), number("score")).alias("item"))
    c = c.groupBy("video_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "item"))), lambda x: x["item"]).alias("risk"))
    d = e.join(c, "video_id", "full")
    none = F.array().cast("array<string>")
    parts = [F.concat(F.lit('"events":'), _json_list(F.coalesce("events", none))), F.concat(F.lit('"risk":'), _json_list(F.coalesce("risk", none)))]
    if videos is not None:
        d = videos.select("video_id", "duration", "fps").join(d, "video_id", "left")
        parts = [F.concat(F.lit('"duration":'), number("duration")), F.concat(F.lit('"fps":'), number("fps")), *parts]
    return d.select("video_id", F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("json"))


def write_predictions(rows: DataFrame, path: str, team: str, names: DataFrame | None = None) -> None:
    """JSON lines, one document per video: ``team`` and ``videos`` with the one clip; readers take a folder of them."""
    d = rows if names is None else rows.join(names, "video_id")
    name = F.col("video") if names is not None else F.col("video_id").cast("string")
    key = F.regexp_extract(F.to_json(F.struct(name.alias("v"))), r":(.*)\}$", 1)
    lead = F.regexp_extract(F.to_json(F.struct(F.lit(team).alias("v"))), r":(.*)\}$", 1)
    d.select(F.concat(F.lit('{"team":'), lead, F.lit(',"videos":{'), key, F.lit(":"), F.col("json"), F.lit("}}")).alias("value")).write.text(path)


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    schema = "reviewed ARRAY<STRUCT<video: STRING, t: DOUBLE, label: STRING, verdict: STRING, note: STRING>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode("reviewed").alias("r")).select("r.*")


def write_report(rows: DataFrame, path: str) -> None:
    """A result table as JSON lines, nulls included, for pages that show it."""
    rows.write.option("ignoreNullFields", "false").json(path)
