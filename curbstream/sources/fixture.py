"""A closed-form set of trajectories over the customer table, one 20 s video per 40 customers.

Only exact arithmetic is used, so Spark and other engines give equal rows. The same text, with the
frame source filled in, serves both.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbstream.sources.tables import table

WIDTH, HEIGHT, FPS, N_FRAMES, FRAME_US = 1280, 720, 12.5, 250, 80_000

RAW_SQL = """SELECT video_id, track_id * 1000 + frame AS ord, frame, t, t_us, track_id, cls, conf,
  cx - w / 2 AS x1, foot_y - h AS y1, cx + w / 2 AS x2, foot_y AS y2 FROM (
  SELECT *, CASE WHEN cls = 0 THEN 30e0 ELSE 0.18e0 * foot_y END AS w, CASE WHEN cls = 0 THEN 80e0 ELSE 0.135e0 * foot_y END AS h FROM (
  SELECT cast(floor(c_custkey/40) AS bigint) AS video_id, c_custkey AS track_id, frame, frame*0.08e0 AS t, frame*80000 AS t_us,
    CASE c_custkey%10 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 3 WHEN 4 THEN 5 WHEN 5 THEN 7 ELSE 2 END AS cls,
    0.35e0+((c_custkey*31+frame*17)%60)/100e0 AS conf,
    CASE c_custkey%5
      WHEN 0 THEN 40e0+(c_custkey%37)*8+(frame-(c_custkey*7)%100)*0.08e0*(60+c_custkey%90)
      WHEN 1 THEN 100e0+(c_custkey%41)*10+least((frame-(c_custkey*7)%100)*0.08e0,2e0)*(80+c_custkey%60)
      WHEN 2 THEN 1240e0-(c_custkey%29)*8-(frame-(c_custkey*7)%100)*0.08e0*(50+c_custkey%80)
      WHEN 3 THEN 300e0+(c_custkey%70)*10
      ELSE 80e0+(c_custkey%53)*8+(least((frame-(c_custkey*7)%100)*0.08e0,3e0)+greatest((frame-(c_custkey*7)%100)*0.08e0-5e0,0e0))*(70+c_custkey%50) END AS cx,
    CASE WHEN c_custkey%5=3 THEN 240e0+(frame-(c_custkey*7)%100)*0.08e0*(20+c_custkey%25)
         WHEN c_custkey%5=2 THEN 360e0+(c_custkey%3)*12 ELSE 430e0+(c_custkey%4)*14 END AS foot_y
  FROM ({source}) src
  WHERE frame >= (c_custkey*7)%100 AND frame < (c_custkey*7)%100+60+(c_custkey*13)%90
    AND (c_custkey*3+frame)%23 <> 0 AND NOT (c_custkey%11=0 AND frame-(c_custkey*7)%100 BETWEEN 40 AND 59)) p) q"""

DUCK_RAW = RAW_SQL.format(source=f"SELECT c_custkey, unnest(range(0, {N_FRAMES})) AS frame FROM customer")
SPARK_SOURCE = "SELECT /*+ BROADCAST(f) */ c_custkey, f.id AS frame FROM {customer} CROSS JOIN {numbers} f"


def _spread(df: DataFrame, key: str) -> DataFrame:
    """Few and short rows that each become many: dealt over tasks first, as their file is a single split."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _numbers(spark: SparkSession) -> DataFrame:
    """Frame numbers. A cross join with them tells the planner how many rows come out; ``explode`` would leave it with the
    size of the input, and it would broadcast all rows of the tracks."""
    return spark.range(0, N_FRAMES, 1, 1)


def tracks_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Tracker output: ``video_id, ord, frame, t, t_us, track_id, cls, conf, x1, y1, x2, y2``."""
    customers = _spread(table(spark, folder, "customer").select("c_custkey"), "c_custkey")
    return spark.sql(RAW_SQL.format(source=SPARK_SOURCE), customer=customers, numbers=_numbers(spark))


def _video_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(F.floor(F.col("c_custkey") / 40).cast("bigint").alias("video_id"))


def videos(spark: SparkSession, folder: str) -> DataFrame:
    v = _video_ids(spark, folder).distinct()
    return v.select("video_id", F.lit(FPS).alias("fps"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), F.lit(N_FRAMES / FPS).alias("duration"))


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """The clock of processed frames, empty ones included."""
    f = _spread(_video_ids(spark, folder), "video_id").distinct().crossJoin(F.broadcast(_numbers(spark).withColumnRenamed("id", "frame")))
    return f.select("video_id", "frame", F.col("frame").alias("pos"), (F.col("frame") * F.lit(0.08)).alias("t"), (F.col("frame") * FRAME_US).alias("t_us"))


def scene_document() -> dict:
    """The drawn scene of every fixture video, in pixels."""
    return {
        "normalized": False,
        "image_size": [WIDTH, HEIGHT],
        "carriageway": [[[0, 250], [1280, 250], [1280, 600], [0, 600]]],
        "crosswalks": [{"polygon": [[590, 240], [690, 240], [690, 610], [590, 610]]}],
        "stop_lines": [{"id": "S1", "points": [[600, 250], [600, 600]], "signal": "main", "approach": [1, 0]}],
        "solid_lines": [[[0, 400], [1280, 400]]],
        "lanes": [{"id": "L1", "polygon": [[0, 340], [1280, 340], [1280, 520], [0, 520]], "direction": [1, 0]}],
        "exit_zones": [{"id": "W", "polygon": [[0, 300], [250, 300], [250, 600], [0, 600]]}, {"id": "E", "polygon": [[900, 300], [1280, 300], [1280, 600], [900, 600]]}],
        "allowed_movements": [["W", "E"]],
        "no_u_turn_zones": [[[300, 250], [900, 250], [900, 600], [300, 600]]],
        "signal_rois": [{"id": "main", "rect": [10, 10, 40, 90], "kind": "vehicle"}],
    }


def signal_samples(spark: SparkSession, folder: str) -> DataFrame:
    """One sample per frame of the single head ``main``: red in even 7 s slots, else green."""
    f = frames(spark, folder)
    red = F.floor(F.col("t_us") / 7_000_000) % 2 == 0
    return f.select("video_id", F.lit("main").alias("signal_id"), "t_us", F.when(red, "red").otherwise("green").alias("state"))
