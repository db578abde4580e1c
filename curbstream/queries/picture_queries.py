"""Rules over small pictures: things that lie on the road, and flames. One series of pictures per supplier.

Every picture has 12 by 20 cells over a frame of 400 by 240. From the 30th second on some series show a box that stays, half
of them under a tracked vehicle, some off the road, some too small; others flicker in flame colours for a while.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from curbstream.operators import scene as sc
from curbstream.plans import rules, thumbnails
from curbstream.plans.explore import labelled_clips, thin_curve
from curbstream.plans.params import EVENTS
from curbstream.queries.metric_queries import CURVE, timeline
from curbstream.queries.registry import query
from curbstream.queries.series_queries import EV
from curbstream.sources.documents import scene_shapes, shapes_for_videos
from curbstream.sources.tables import events, table

ROWS, COLS, SECONDS, WIDTH, HEIGHT = 12, 20, 75, 400, 240
BOX = "(v % 3 <> 0 AND t >= 30 AND t < 50 + v % 20 AND py >= y0 AND py < y0 + 3 AND px >= 3 + v % 9 AND px < 3 + v % 9 + wide)"
#: Fixed arithmetic, so that both engines see the same pictures.
PICTURES = f"""SELECT v AS video_id, t * 1000000 AS t_us, py, px, CASE WHEN flame THEN 20 ELSE 90 END AS h, CASE WHEN flame THEN 200 ELSE 40 END AS s, CASE WHEN flame THEN 205 + ((t * 7 + px * 3 + py) % 5) * 12 ELSE 120 END AS v,
  60 + (px * 5 + py * 3) % 40 + (t * px + py) % 7 + CASE WHEN {BOX} THEN 80 ELSE 0 END AS gray
  FROM (SELECT *, v % 4 = 1 AND t >= 20 AND t < 24 + v % 30 AND py < 4 AND px >= 6 AND px < 9 AS flame, CASE WHEN v % 7 = 0 THEN 0 ELSE 6 END AS y0, CASE WHEN v % 5 = 0 THEN 2 ELSE 4 END AS wide FROM ({{source}}) src) p"""
SPARK_SOURCE = f"""SELECT /*+ BROADCAST(c) */ s_suppkey AS v, c.id DIV {ROWS * COLS} AS t, CAST(c.id % {ROWS * COLS} DIV {COLS} AS INT) AS py, CAST(c.id % {COLS} AS INT) AS px
  FROM {{supplier}} CROSS JOIN {{cells}} c"""
DUCK = f"th AS ({PICTURES.format(source=f'SELECT s_suppkey AS v, t, py, px FROM supplier, (SELECT unnest(range(0, {SECONDS})) AS t), (SELECT unnest(range(0, {ROWS})) AS py), (SELECT unnest(range(0, {COLS})) AS px)')})"
PATH = [[0, 60], [WIDTH, 60], [WIDTH, HEIGHT], [0, HEIGHT]]
P = EVENTS["road_obstacle"]


def _suppliers(spark, folder):
    """Short rows that each become many: dealt over tasks first, as their file is a single split."""
    return table(spark, folder, "supplier").select("s_suppkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "s_suppkey")


def pictures(spark, folder):
    # Cross joined with numbers, which tells the planner how many rows come out; exploded ones it would broadcast.
    return spark.sql(PICTURES.format(source=SPARK_SOURCE), supplier=_suppliers(spark, folder), cells=spark.range(0, SECONDS * ROWS * COLS, 1, 1))


def inputs(spark, folder) -> rules.Tables:
    sup = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("video_id"))
    videos = sup.withColumns({"fps": F.lit(1.0), "width": F.lit(WIDTH), "height": F.lit(HEIGHT), "duration": F.lit(float(SECONDS))})
    shapes, moves, right = scene_shapes(spark, {"normalized": False, "image_size": [WIDTH, HEIGHT], "carriageway": [PATH]})
    none = spark.createDataFrame([], "video_id bigint, iy int, ix int, road boolean, depth_cells double, queue boolean, crosswalk boolean")
    # A vehicle over the place of the box, in every second series.
    at = _suppliers(spark, folder).select(F.col("s_suppkey").alias("video_id")).filter("video_id % 2 = 0").crossJoin(F.broadcast(spark.range(0, SECONDS, 1, 1).withColumnRenamed("id", "t")))
    x1 = (3 + F.col("video_id") % 9) * 20.0
    boxes = at.select("video_id", (F.col("t") * 1_000_000 + 300_000).cast("bigint").alias("t_us"), x1.alias("x1"), F.lit(125.0).alias("y1"), (x1 + 75.0).alias("x2"), F.lit(175.0).alias("y2"))
    return rules.Tables(boxes, videos, videos, sc.scene_rows(shapes_for_videos(shapes, videos), videos, moves, right), none, none, none, pictures(spark, folder))


@query(
    "static_blobs",
    f"""WITH {DUCK}, bg AS (SELECT video_id, t_us, py, px, gray, count(*) OVER w AS n, quantile_cont(gray, 0.5) OVER w AS m FROM th WINDOW w AS (PARTITION BY video_id, py, px ORDER BY t_us RANGE BETWEEN 60000000 PRECEDING AND 10000000 PRECEDING)),
    f0 AS (SELECT video_id, t_us, py, px FROM bg WHERE n >= 8 AND abs(gray - floor(m)) > {P['blob_diff']}),
    d AS (SELECT unnest([-1, 0, 1]) AS d),
    e0 AS (SELECT video_id, t_us, py + a.d AS py, px + b.d AS px FROM f0, d a, d b),
    er AS (SELECT video_id, t_us, py, px FROM e0 WHERE py BETWEEN 0 AND {ROWS - 1} AND px BETWEEN 0 AND {COLS - 1} GROUP BY 1, 2, 3, 4
      HAVING count(*) = (least(py + 1, {ROWS - 1}) - greatest(py - 1, 0) + 1) * (least(px + 1, {COLS - 1}) - greatest(px - 1, 0) + 1)),
    op AS (SELECT DISTINCT video_id, t_us, py + a.d AS py, px + b.d AS px FROM er, d a, d b WHERE py + a.d BETWEEN 0 AND {ROWS - 1} AND px + b.d BETWEEN 0 AND {COLS - 1}),
    bx AS (SELECT s_suppkey AS video_id, (3 + s_suppkey % 9) * 20e0 AS x1 FROM supplier WHERE s_suppkey % 2 = 0),
    fg AS (SELECT op.* FROM op LEFT JOIN bx USING (video_id) WHERE (py + 0.5e0) * 20 >= 60 AND NOT coalesce(py BETWEEN 5 AND 9 AND px BETWEEN floor((x1 - 15e0) / 20) AND floor((x1 + 90e0) / 20), false)),
    ru AS (SELECT *, t_us - 1000000 * row_number() OVER (PARTITION BY video_id, py, px ORDER BY t_us) AS isl FROM fg),
    hd AS (SELECT *, row_number() OVER (PARTITION BY video_id, py, px, isl ORDER BY t_us) AS held FROM ru),
    st AS (SELECT video_id, t_us FROM hd WHERE held >= 5 GROUP BY 1, 2 HAVING count(*) >= {P['blob_min_area_frac']}e0 * {ROWS * COLS}),
    si AS (SELECT *, t_us - 1000000 * row_number() OVER (PARTITION BY video_id ORDER BY t_us) AS isl FROM st)
    SELECT video_id, greatest(0, min(t_us) - 4000000) AS start_us, max(t_us) AS end_us FROM si GROUP BY video_id, isl""",
)
def q_blobs(spark, folder):
    return thumbnails.static_blobs(inputs(spark, folder), P)


FIRE = EVENTS["fire_smoke"]


@query(
    "rule_fire_smoke",
    f"""WITH {DUCK}, lg AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY video_id, py, px ORDER BY t_us)) AS dv, h <= 30 AND s >= 120 AND v >= 200 AS hot FROM th),
    g AS (SELECT video_id, t_us, avg(CASE WHEN hot THEN 1e0 ELSE 0e0 END) AS share, avg(dv) FILTER (hot) AS change FROM lg GROUP BY 1, 2),
    f AS (SELECT *, t_us - 1000000 * row_number() OVER (PARTITION BY video_id ORDER BY t_us) AS isl FROM g WHERE share >= {FIRE['min_area_frac']}e0 AND change >= {FIRE['flicker_thr']}e0)
    SELECT video_id, 'fire_smoke' AS label, min(t_us) AS start_us, max(t_us) AS end_us, 0.5e0 AS confidence FROM f GROUP BY video_id, isl HAVING max(t_us) - min(t_us) >= {FIRE['min_sec']}e0 * 1e6""",
)
def q_fire(spark, folder):
    return rules.RULES["fire_smoke"](inputs(spark, folder), FIRE).select("video_id", "label", "start_us", "end_us", "confidence")


@query("thin_curve", f"WITH {CURVE}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM fr) SELECT user_id, event_id, t_us FROM r WHERE (rn - 1) % greatest(1, n // 20) = 0")
def q_thin(spark, folder):
    curve, _ = timeline(spark, folder)
    return thin_curve(curve, ["user_id"], "t_us", ["event_id"], most=20).select("user_id", "event_id", "t_us")


@query("labelled_clips", f"WITH {EV}, l AS (SELECT user_id, count(*) AS n_events FROM ev WHERE event_type = 'error' AND value > 60 GROUP BY 1) SELECT user_id, n_events FROM (SELECT DISTINCT user_id FROM ev) LEFT JOIN l USING (user_id)")
def q_clips(spark, folder):
    e = events(spark, folder)
    found = e.filter("event_type = 'error' AND value > 60").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"))
    return labelled_clips(found, e.select("user_id"), "user_id")
