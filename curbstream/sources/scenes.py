"""A drawn scene per camera: JSON documents as a table, read and taken apart by Spark however many cameras there are.

A document without ``normalized`` is drawn in shares of the picture; with ``normalized: false`` in the pixels of
``image_size``. ``ord`` is the place of a shape in its list and carries "the first match wins". What a document leaves out
has no shapes; a document that is no JSON gives a camera without any.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curbstream.operators.scene import scene_rows

_LINE = "ARRAY<ARRAY<DOUBLE>>"
PLAIN = ("carriageway", "non_road", "queue_zones", "intersection", "fixed_objects", "no_u_turn_zones", "solid_lines")
#: Crosswalks are a polygon or an object with one, so they are parsed one by one.
DOCUMENT = ", ".join(
    ["normalized BOOLEAN", "image_size ARRAY<DOUBLE>", *[f"{k} ARRAY<{_LINE}>" for k in PLAIN], "crosswalks ARRAY<STRING>", f"lanes ARRAY<STRUCT<id: STRING, polygon: {_LINE}, direction: ARRAY<DOUBLE>>>",
     f"exit_zones ARRAY<STRUCT<id: STRING, polygon: {_LINE}>>", f"stop_lines ARRAY<STRUCT<id: STRING, points: {_LINE}, signal: STRING, approach: ARRAY<DOUBLE>>>", "signal_rois ARRAY<STRUCT<id: STRING, rect: ARRAY<DOUBLE>, kind: STRING>>",
     "allowed_movements ARRAY<ARRAY<STRING>>", "right_turn_on_red BOOLEAN"]
)


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    """``camera, json``: one document a file, named after its camera."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.json)?$", 1)
    return spark.read.text(path, wholetext=True).select(name.alias("camera"), F.col("value").alias("json"))


def parsed(documents: DataFrame) -> DataFrame:
    """``camera`` and its document as a struct ``d``."""
    return documents.select("camera", F.from_json("json", DOCUMENT).alias("d"))


def camera_shapes(documents: DataFrame) -> DataFrame:
    """One row a shape, in shares of the picture: ``camera, kind, ord, id, pts, signal, dir``."""
    d = parsed(documents)
    own = F.coalesce("d.normalized", F.lit(True))
    one = F.lit(1.0)
    d = d.withColumns({"w": F.when(own, one).otherwise(F.get("d.image_size", F.lit(0))), "h": F.when(own, one).otherwise(F.get("d.image_size", F.lit(1)))})
    point = lambda x, y: F.struct((x / F.col("w")).alias("x"), (y / F.col("h")).alias("y"))
    line = lambda a: F.transform(a, lambda p: point(F.get(p, F.lit(0)), F.get(p, F.lit(1))))
    way = lambda a: F.when(F.size(F.coalesce(a, F.array())) == 2, point(F.get(a, F.lit(0)), F.get(a, F.lit(1))))
    text, none = F.lit(None).cast("string"), F.lit(None).cast("array<double>")

    def item(kind: str, i: Column, pts: Column, ident: Column = text, signal: Column = text, direction: Column = none) -> Column:
        return F.struct(F.lit(kind).alias("kind"), i.alias("ord"), F.coalesce(ident, i.cast("string")).alias("id"), pts.alias("pts"), signal.alias("signal"), way(direction).alias("dir"))

    def crosswalk(x: Column, i: Column) -> Column:
        pts = F.from_json(F.coalesce(F.get_json_object(x, "$.polygon"), x), _LINE)
        return item("crosswalks", i, line(pts), text, F.get_json_object(x, "$.signal"))

    def head(s: Column, i: Column) -> Column:
        x1, y1, x2, y2 = (F.get(s["rect"], F.lit(j)) for j in range(4))
        return item("signal_rois", i, F.array(point(x1, y1), point(x2, y1), point(x2, y2), point(x1, y2)), s["id"], F.coalesce(s["kind"], F.lit("vehicle")))

    def shape(kind: str) -> Callable[[Column, Column], Column]:
        return lambda a, i: item(kind, i, line(a))

    lists = [F.transform(f"d.{k}", shape(k)) for k in PLAIN]
    lists += [
        F.transform("d.crosswalks", crosswalk), F.transform("d.lanes", lambda s, i: item("lanes", i, line(s["polygon"]), s["id"], text, s["direction"])), F.transform("d.exit_zones", lambda s, i: item("exit_zones", i, line(s["polygon"]), s["id"])),
        F.transform("d.stop_lines", lambda s, i: item("stop_lines", i, line(s["points"]), s["id"], s["signal"], s["approach"])), F.transform("d.signal_rois", head),
    ]
    # A kind that is missing is null and would make the whole list null.
    every = F.flatten(F.filter(F.array(*lists), lambda a: a.isNotNull()))
    return d.select("camera", F.explode(every).alias("s")).select("camera", "s.*")


def camera_flags(documents: DataFrame) -> DataFrame:
    """``camera, movements, right_turn_on_red``."""
    pairs = F.transform(F.coalesce("d.allowed_movements", F.array().cast("array<array<string>>")), lambda m: F.struct(F.get(m, F.lit(0)).alias("entry"), F.get(m, F.lit(1)).alias("exit")))
    return parsed(documents).select("camera", pairs.alias("movements"), F.coalesce("d.right_turn_on_red", F.lit(False)).alias("right_turn_on_red"))


def shapes_of_cameras(shapes: DataFrame, videos: DataFrame) -> DataFrame:
    """Each video's shapes in its own pixels; ``videos`` names the camera. Directions become unit vectors."""
    d = videos.select("video_id", "camera", "width", "height").join(shapes, "camera")
    pts = F.transform("pts", lambda p: F.struct((p["x"] * F.col("width")).alias("x"), (p["y"] * F.col("height")).alias("y")))
    dx, dy = F.col("dir.x") * F.col("width"), F.col("dir.y") * F.col("height")
    n = F.nullif(F.sqrt(dx * dx + dy * dy), F.lit(0.0))
    unit = F.when(F.col("dir").isNotNull(), F.struct((dx / n).alias("x"), (dy / n).alias("y")))
    return d.select("video_id", "kind", "ord", "id", pts.alias("pts"), "signal", unit.alias("dir"))


def camera_scenes(documents: DataFrame, videos: DataFrame) -> DataFrame:
    """The scene row of every video, from the document of its camera; a video without one has no shapes."""
    rows = scene_rows(shapes_of_cameras(camera_shapes(documents), videos), videos, [])
    flags = videos.select("video_id", "camera").join(camera_flags(documents), "camera").drop("camera")
    empty = rows.select("video_id", F.col("movements").alias("__m"))
    d = rows.drop("movements", "right_turn_on_red").join(flags, "video_id", "left").join(empty, "video_id")
    return d.withColumns({"movements": F.coalesce("movements", "__m"), "right_turn_on_red": F.coalesce("right_turn_on_red", F.lit(False))}).drop("__m")
