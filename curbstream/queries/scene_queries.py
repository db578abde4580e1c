"""Geometry, learned grids, signals and pairs over the trajectory fixture."""
from __future__ import annotations

from pyspark.sql import functions as F

from curbstream.functions import geometry as geo
from curbstream.operators import lookup, pairs, scene, series
from curbstream.queries import track_sql as q
from curbstream.queries.registry import query
from curbstream.queries.track_queries import r, rd, track_table
from curbstream.sources import documents
from curbstream.sources import fixture as fx
from curbstream.sources.tables import table

IX, IY = "least(greatest(CAST(trunc({x} / 20e0) AS INT), 0), 63)", "least(greatest(CAST(trunc({y} / 20e0) AS INT), 0), 35)"
CELLS = f"{q.TRACKS}, tc AS (SELECT *, {IX.format(x='foot_x')} AS ix, {IY.format(y='foot_y')} AS iy FROM tracks)"
OFF = "(SELECT unnest(range(-1, 2)) AS dy) o1, (SELECT unnest(range(-1, 2)) AS dx) o2"
IN = "iy + dy BETWEEN 0 AND 35 AND ix + dx BETWEEN 0 AND 63"


def dil(out: str, src: str) -> str:
    return f"{out} AS (SELECT DISTINCT video_id, CAST(iy + dy AS INT) AS iy, CAST(ix + dx AS INT) AS ix FROM {src}, {OFF} WHERE {IN})"


def ero(out: str, src: str) -> str:
    return f"{out} AS (SELECT video_id, CAST(iy + dy AS INT) AS iy, CAST(ix + dx AS INT) AS ix FROM {src}, {OFF} WHERE {IN} GROUP BY 1, 2, 3 HAVING count(*) = 9)"


ROAD = f"""{CELLS}, r0 AS (SELECT video_id, iy, ix FROM tc WHERE cls IN {q.VEH} GROUP BY 1, 2, 3 HAVING count(DISTINCT track_id) >= 2),
  {dil('r1', 'r0')}, {dil('r2', 'r1')}, {ero('r3', 'r2')}, {ero('r4', 'r3')}, {dil('r5', 'r4')},
  al AS (SELECT video_id, iy, ix FROM (SELECT DISTINCT video_id FROM r5) v, (SELECT CAST(unnest(range(0, 36)) AS INT) AS iy) a, (SELECT CAST(unnest(range(0, 64)) AS INT) AS ix) b),
  em AS MATERIALIZED (SELECT * FROM al ANTI JOIN r5 USING (video_id, iy, ix)),
  wet AS (SELECT * FROM em WHERE iy IN (0, 35) OR ix IN (0, 63) UNION SELECT em.* FROM wet JOIN em ON em.video_id = wet.video_id AND abs(em.iy - wet.iy) + abs(em.ix - wet.ix) = 1),
  road AS (SELECT * FROM al ANTI JOIN wet USING (video_id, iy, ix))"""


@query("road_cells", f"WITH RECURSIVE {ROAD} SELECT * FROM road")
def q_road(spark, folder):
    return scene.road_cells(track_table(spark, folder)).select("video_id", "iy", "ix")


@query("cell_dilation", f"WITH {CELLS}, r0 AS (SELECT video_id, iy, ix FROM tc WHERE cls IN {q.VEH} GROUP BY 1, 2, 3 HAVING count(DISTINCT track_id) >= 2), {dil('r1', 'r0')}, {dil('r2', 'r1')} SELECT * FROM r2")
def q_dilate(spark, folder):
    v = scene.cell_visits(scene.vehicles(track_table(spark, folder)), "n").filter("n >= 2")
    return scene.dilate(v, 2).select("video_id", "iy", "ix")


@query(
    "road_depth",
    f"""WITH RECURSIVE {ROAD}, ex AS (SELECT video_id, iy, ix FROM (SELECT DISTINCT video_id FROM road) v, (SELECT CAST(unnest(range(-1, 37)) AS INT) AS iy) a, (SELECT CAST(unnest(range(-1, 65)) AS INT) AS ix) b),
    off AS (SELECT * FROM ex ANTI JOIN road USING (video_id, iy, ix))
    SELECT a.video_id, a.iy, a.ix, round(sqrt(min((a.iy - b.iy) * (a.iy - b.iy) + (a.ix - b.ix) * (a.ix - b.ix))), 6) AS depth FROM road a JOIN off b USING (video_id) GROUP BY 1, 2, 3""",
)
def q_depth(spark, folder):
    d = scene.road_depth(scene.road_cells(track_table(spark, folder)))
    return d.select("video_id", "iy", "ix", F.round("depth_cells", 6).alias("depth"))


VOTES = f"""{CELLS}, fv0 AS (SELECT video_id, iy, ix, track_id, sum(vx / greatest(sqrt(vx * vx + vy * vy), 1e-9)) AS x, sum(vy / greatest(sqrt(vx * vx + vy * vy), 1e-9)) AS y FROM tc WHERE cls IN {q.VEH} AND speed > 0.5e0 GROUP BY 1, 2, 3, 4),
  fv AS (SELECT video_id, iy, ix, track_id, x / sqrt(x * x + y * y) AS ux, y / sqrt(x * x + y * y) AS uy FROM fv0 WHERE sqrt(x * x + y * y) > 1e-6),
  ff AS (SELECT video_id, CAST(iy + dy AS INT) AS iy, CAST(ix + dx AS INT) AS ix, sum(ux) AS fx, sum(uy) AS fy, count(*) AS fn FROM fv, {OFF} WHERE {IN} GROUP BY 1, 2, 3)"""


@query(
    "flow_field",
    f"""WITH {VOTES}, d AS (SELECT *, sqrt(fx * fx + fy * fy) / fn AS coh FROM ff)
    SELECT video_id, iy, ix, fn, round(fx / fn / greatest(coh, 1e-9), 4) + 0e0 AS dir_x, round(fy / fn / greatest(coh, 1e-9), 4) + 0e0 AS dir_y, round(CASE WHEN fn >= 3 THEN least(coh, 1e0) ELSE 0e0 END, 5) AS strength FROM d""",
)
def q_flow(spark, folder):
    f = scene.flow_field(scene.flow_votes(track_table(spark, folder)))
    x, y, s = scene.direction(F.col("fx"), F.col("fy"), F.col("fn"), 3)
    f = f.select("video_id", "iy", "ix", "fn", x.alias("dir_x"), y.alias("dir_y"), F.round(s, 5).alias("strength"))
    return r(f, 4, "dir_x", "dir_y")


@query(
    "flow_leave_one_out",
    f"""WITH {VOTES}, ow AS (SELECT video_id, track_id, CAST(iy + dy AS INT) AS iy, CAST(ix + dx AS INT) AS ix, sum(ux) AS ox, sum(uy) AS oy, count(*) AS n FROM fv, {OFF} WHERE {IN} GROUP BY 1, 2, 3, 4),
    vi AS (SELECT DISTINCT video_id, track_id, iy, ix FROM tc WHERE cls IN {q.VEH})
    SELECT vi.*, coalesce(fn, 0) - coalesce(n, 0) AS support, round(CASE WHEN coalesce(fn, 0) - coalesce(n, 0) >= 3 THEN least(1e0, sqrt((fx - coalesce(ox, 0e0)) * (fx - coalesce(ox, 0e0)) + (fy - coalesce(oy, 0e0)) * (fy - coalesce(oy, 0e0))) / (fn - coalesce(n, 0))) ELSE 0e0 END, 5) AS strength
    FROM vi LEFT JOIN ff USING (video_id, iy, ix) LEFT JOIN ow USING (video_id, track_id, iy, ix)""",
)
def q_loo(spark, folder):
    t = track_table(spark, folder)
    votes = scene.flow_votes(t)
    own = scene.flow_field(votes, ("track_id",)).withColumnsRenamed({"fx": "ox", "fy": "oy", "fn": "on"})
    v = scene.with_cell(scene.vehicles(t)).select("video_id", "track_id", "iy", "ix").distinct()
    d = v.join(scene.flow_field(votes), ["video_id", "iy", "ix"], "left").join(own, ["video_id", "iy", "ix", "track_id"], "left").na.fill(0)
    n = F.col("fn") - F.col("on")
    _, _, s = scene.direction(F.col("fx") - F.col("ox"), F.col("fy") - F.col("oy"), n, 3)
    return d.select("video_id", "track_id", "iy", "ix", n.alias("support"), F.round(s, 5).alias("strength"))


QUEUE = f"""{CELLS}, qs AS (SELECT video_id, track_id, {IX.format(x='quantile_cont(foot_x, 0.5)')} AS ix, {IY.format(y='quantile_cont(foot_y, 0.5)')} AS iy FROM tc WHERE cls IN {q.VEH} AND speed < 0.15e0 GROUP BY 1, 2 HAVING count(*) >= 2 AND max(t_us) - min(t_us) >= 3000000),
  q0 AS (SELECT video_id, iy, ix FROM qs GROUP BY 1, 2, 3 HAVING count(*) >= 1), {dil('q1', 'q0')}, {dil('q2', 'q1')}"""


@query("queue_cells", f"WITH {QUEUE} SELECT * FROM q2")
def q_queue(spark, folder):
    from curbstream.plans.params import SCENE

    return scene.queue_cells(track_table(spark, folder), {**SCENE, "queue_min_tracks": 1}).select("video_id", "iy", "ix")


@query("crosswalk_cells", f"WITH RECURSIVE {ROAD}, w0 AS (SELECT video_id, iy, ix FROM tc SEMI JOIN road USING (video_id, iy, ix) WHERE cls = 0 AND NOT rider AND speed > 0.2e0 GROUP BY 1, 2, 3 HAVING count(DISTINCT track_id) >= 2), {dil('w1', 'w0')} SELECT * FROM w1")
def q_crosswalk(spark, folder):
    from curbstream.plans.params import SCENE

    t = track_table(spark, folder)
    return scene.crosswalk_cells(t, scene.road_cells(t), {**SCENE, "crosswalk_min_persons": 2}).select("video_id", "iy", "ix")


@query("road_fraction", f"WITH RECURSIVE {ROAD} SELECT video_id, round(count(*) / 2304e0, 3) AS road_fraction FROM road GROUP BY 1")
def q_fraction(spark, folder):
    d = scene.road_cells(track_table(spark, folder))
    return d.groupBy("video_id").agg(F.round(F.count(F.lit(1)) / (F.max("gh") * F.max("gw")), 3).alias("road_fraction"))


POLY = [(100.0, 300.0), (700.0, 260.0), (1100.0, 420.0), (640.0, 380.0), (200.0, 560.0)]
EDGES = "pe(x0, y0, x1, y1) AS (VALUES " + ", ".join(f"({POLY[i - 1][0]}e0, {POLY[i - 1][1]}e0, {x}e0, {y}e0)" for i, (x, y) in enumerate(POLY)) + ")"
LINE = [(150.0, 500.0), (520.0, 410.0), (900.0, 440.0), (1200.0, 300.0)]
SEGL = "le(k, x0, y0, x1, y1) AS (VALUES " + ", ".join(f"({i}, {LINE[i][0]}e0, {LINE[i][1]}e0, {LINE[i + 1][0]}e0, {LINE[i + 1][1]}e0)" for i in range(len(LINE) - 1)) + ")"


def pts(points):
    return F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in points])


@query(
    "point_in_polygon",
    f"""WITH {q.RAW}, {EDGES}, p AS (SELECT video_id, track_id, frame, (x1 + x2) / 2 AS x, y2 AS y FROM raw)
    SELECT video_id, track_id, frame, count(*) FILTER (WHERE (pe.y1 > y) <> (pe.y0 > y) AND x < (pe.x0 - pe.x1) * (y - pe.y1) / (pe.y0 - pe.y1) + pe.x1) % 2 = 1 AS inside FROM p, pe GROUP BY 1, 2, 3""",
)
def q_pip(spark, folder):
    d = fx.tracks_raw(spark, folder).select("video_id", "track_id", "frame", ((F.col("x1") + F.col("x2")) / 2).alias("x"), F.col("y2").alias("y"))
    return d.select("video_id", "track_id", "frame", geo.poly_contains("x", "y", pts(POLY)).alias("inside"))


@query(
    "line_distance_side",
    f"""WITH {q.RAW}, {SEGL}, p AS (SELECT video_id, track_id, frame, (x1 + x2) / 2 AS x, y2 AS y FROM raw),
    d AS (SELECT p.*, k, least(greatest(((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)), 0e0), 1e0) AS u, x0, y0, x1, y1 FROM p, le),
    e AS (SELECT *, sqrt((x - x0 - u * (x1 - x0)) * (x - x0 - u * (x1 - x0)) + (y - y0 - u * (y1 - y0)) * (y - y0 - u * (y1 - y0))) AS dist FROM d)
    SELECT video_id, track_id, frame, round(dist, 6) AS dist, CASE WHEN (x1 - x0) * (y - y0) - (y1 - y0) * (x - x0) < 0 THEN -1e0 ELSE 1e0 END AS side FROM e QUALIFY row_number() OVER (PARTITION BY video_id, track_id, frame ORDER BY e.dist, k) = 1""",
)
def q_line(spark, folder):
    d = fx.tracks_raw(spark, folder).select("video_id", "track_id", "frame", ((F.col("x1") + F.col("x2")) / 2).alias("x"), F.col("y2").alias("y"))
    return d.select("video_id", "track_id", "frame", F.round(geo.line_distance("x", "y", pts(LINE)), 6).alias("dist"), geo.line_side("x", "y", pts(LINE)).alias("side"))


PAIRS = f"""{q.TRACKS}, us AS MATERIALIZED (SELECT video_id, track_id, frame, t_us, cls, sx, sy, round(vx, 6) AS vx, round(vy, 6) AS vy, x1, y1, x2, y2, speed, {q.SCALE.format(y='sy')} AS sc FROM tracks WHERE reliable AND NOT edge AND cls IN (0, 1, 2, 3, 5, 7)),
  pr AS (SELECT a.video_id, a.frame, a.t_us, a.track_id AS a_id, b.track_id AS b_id, sqrt((b.sx - a.sx) * (b.sx - a.sx) + (b.sy - a.sy) * (b.sy - a.sy)) AS dist, a.sc AS sca, b.sc AS scb, b.sx - a.sx AS dx, b.sy - a.sy AS dy,
    b.vx * b.sc - a.vx * a.sc AS rvx, b.vy * b.sc - a.vy * a.sc AS rvy, a.x1 AS ax1, a.y2 - 0.35e0 * (a.y2 - a.y1) AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y2 - 0.35e0 * (b.y2 - b.y1) AS by1, b.x2 AS bx2, b.y2 AS by2
    FROM us a JOIN us b ON a.video_id = b.video_id AND a.frame = b.frame AND a.track_id < b.track_id WHERE sqrt((b.sx - a.sx) * (b.sx - a.sx) + (b.sy - a.sy) * (b.sy - a.sy)) < 2e0 * greatest(a.sc, b.sc)),
  pc2 AS (SELECT *, -(rvx * dx + rvy * dy) / greatest(dist, 1e-6) / ((sca + scb) / 2) AS closing FROM pr)"""


def _pairs(spark, folder, max_bl, rounded=False):
    t = track_table(spark, folder).filter("reliable AND NOT edge AND cls IN (0, 1, 2, 3, 5, 7)").withColumn("sc", geo.row_scale("sy"))
    # Rounded so that rounding noise in the velocity of parallel tracks cannot decide whether boxes graze each other.
    t = r(t, 6, "vx", "vy") if rounded else t
    top = F.lit(max_bl) * geo.row_scale(F.lit(2.0) * F.col("height"))
    return pairs.candidate_pairs(t, F.lit(max_bl) * F.col("sc"), top, ["t_us", "vx", "vy", "sc", "x1", "y1", "x2", "y2"])


@query("pair_candidates", f"WITH {PAIRS.replace('round(vx, 6) AS vx, round(vy, 6) AS vy', 'vx, vy')} SELECT video_id, frame, a_id, b_id, round(dist, 4) AS dist, round(closing, 3) + 0e0 AS closing FROM pc2")
def q_pairs(spark, folder):
    d = _pairs(spark, folder, 2.0).withColumn("closing", pairs.closing_speed())
    d = d.select("video_id", "frame", F.col("a_track_id").alias("a_id"), F.col("b_track_id").alias("b_id"), F.round("dist", 4).alias("dist"), "closing")
    return r(d, 3, "closing")


@query(
    "pair_ttc",
    f"""WITH {PAIRS}, st AS (SELECT unnest(range(1, 31)) AS k), tt AS (SELECT video_id, frame, a_id, b_id, CASE WHEN least(ax2, bx2) > greatest(ax1, bx1) AND least(ay2, by2) > greatest(ay1, by1) THEN 0e0 ELSE
      (SELECT min(k) * 0.1e0 FROM st WHERE least(ax2 - rvx * k * 0.1e0, bx2) > greatest(ax1 - rvx * k * 0.1e0, bx1) AND least(ay2 - rvy * k * 0.1e0, by2) > greatest(ay1 - rvy * k * 0.1e0, by1)) END AS ttc FROM pc2)
    SELECT video_id, frame, a_id, b_id, round(ttc, 4) AS ttc FROM tt WHERE ttc IS NOT NULL""",
)
def q_ttc(spark, folder):
    d = pairs.with_pair_ttc(_pairs(spark, folder, 2.0, rounded=True)).filter("ttc IS NOT NULL")
    return d.select("video_id", "frame", F.col("a_track_id").alias("a_id"), F.col("b_track_id").alias("b_id"), F.round("ttc", 4).alias("ttc"))


SAMPLES = f"""sa AS (SELECT video_id, f * 80000 AS t_us, CASE WHEN (f * 80000) // 7000000 % 2 = 0 THEN 'red' ELSE 'green' END AS st FROM (SELECT DISTINCT CAST(floor(c_custkey / 40) AS BIGINT) AS video_id FROM customer) v, (SELECT unnest(range(0, {fx.N_FRAMES})) AS f) g)"""


@query(
    "signal_timeline",
    f"""WITH {SAMPLES}, ch AS (SELECT *, lag(st) OVER w AS p, lead(t_us) OVER w AS nt FROM sa WINDOW w AS (PARTITION BY video_id ORDER BY t_us)),
    gi AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> st THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY t_us) AS g FROM ch)
    SELECT video_id, 'main' AS signal_id, min(t_us) AS t0_us, max(coalesce(nt, t_us + 80000)) AS t1_us, any_value(st) AS state FROM gi GROUP BY video_id, g""",
)
def q_timeline(spark, folder):
    return phases_of(spark, folder).select("video_id", "signal_id", "t0_us", "t1_us", "state")


def phases_of(spark, folder):
    from curbstream.plans.detect import signal_timeline

    return signal_timeline(fx.signal_samples(spark, folder))


@query(
    "lamp_votes",
    """WITH px AS (SELECT o_custkey AS signal_id, l_partkey % 180 AS h, CAST(l_quantity * 5 AS INT) AS s, l_suppkey * 7 % 256 AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    m AS (SELECT signal_id, greatest(60, CAST(trunc(quantile_cont(v, 0.5)) AS INT) + 25) AS lim, count(*) AS n FROM px GROUP BY 1),
    c AS (SELECT signal_id, any_value(n) AS n, count(*) FILTER (WHERE v >= lim AND s >= 60 AND (h <= 12 OR h >= 165)) AS red, count(*) FILTER (WHERE v >= lim AND s >= 60 AND h > 12 AND h <= 32) AS amber,
      count(*) FILTER (WHERE v >= lim AND s >= 60 AND h BETWEEN 45 AND 100) AS green FROM px JOIN m USING (signal_id) GROUP BY 1),
    k AS (SELECT *, greatest(red, amber, green) AS best, red + amber + green - greatest(red, amber, green) - least(red, amber, green) AS second FROM c)
    SELECT signal_id, red, amber, green, CASE WHEN best < greatest(3, 0.0015e0 * n) OR best < 2 * second THEN 'unknown' WHEN best = red THEN 'red' WHEN best = amber THEN 'amber' ELSE 'green' END AS state FROM k""",
)
def q_lamp(spark, folder):
    from curbstream.operators.signals import lamp_votes

    li = table(spark, folder, "lineitem").join(table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("signal_id")), "l_orderkey")
    px = li.select("signal_id", (F.col("l_partkey") % 180).alias("h"), (F.col("l_quantity") * 5).cast("int").alias("s"), (F.col("l_suppkey") * 7 % 256).alias("v"))
    return lamp_votes(px, ["signal_id"], min_pixels=3)


def scene_of(spark, folder):
    shapes, moves, rtor = documents.scene_shapes(spark, fx.scene_document())
    v = fx.videos(spark, folder)
    return scene.scene_rows(documents.shapes_for_videos(shapes, v), v, moves, rtor)


@query("scene_shapes", "SELECT DISTINCT CAST(floor(c_custkey / 40) AS BIGINT) AS video_id, k.kind, k.n FROM customer, (VALUES ('carriageway', 1), ('crosswalks', 1), ('stop_lines', 1), ('solid_lines', 1), ('lanes', 1), ('exit_zones', 2), ('no_u_turn_zones', 1), ('signal_rois', 1)) k(kind, n)")
def q_shapes(spark, folder):
    shapes, _, _ = documents.scene_shapes(spark, fx.scene_document())
    d = documents.shapes_for_videos(shapes, fx.videos(spark, folder))
    return d.groupBy("video_id", "kind").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query(
    "warp_points",
    f"""WITH {q.RAW}, p AS (SELECT video_id, track_id, frame, (x1 + x2) / 2 / 1280e0 AS x, y2 / 720e0 AS y FROM raw)
    SELECT video_id, track_id, frame, round((1.02e0 * x + 0.01e0 * y - 0.005e0) / (0.01e0 * x - 0.02e0 * y + 1e0), 6) + 0e0 AS wx, round((0.015e0 * x + 0.98e0 * y + 0.004e0) / (0.01e0 * x - 0.02e0 * y + 1e0), 6) + 0e0 AS wy FROM p""",
)
def q_warp(spark, folder):
    h = F.array(*[F.lit(v) for v in (1.02, 0.01, -0.005, 0.015, 0.98, 0.004, 0.01, -0.02, 1.0)])
    d = fx.tracks_raw(spark, folder).select("video_id", "track_id", "frame", ((F.col("x1") + F.col("x2")) / 2 / 1280.0).alias("x"), (F.col("y2") / 720.0).alias("y"))
    x, y = geo.project("x", "y", h=h)
    return r(d.select("video_id", "track_id", "frame", x.alias("wx"), y.alias("wy")), 6, "wx", "wy")


@query("time_labels", "SELECT o_orderkey, format('{}:{:04.1f}', CAST(floor(sqrt(o_totalprice) / 60) AS BIGINT), sqrt(o_totalprice) - 60 * floor(sqrt(o_totalprice) / 60)) AS at, replace(lower(o_orderpriority), '_', ' ') AS label FROM orders")
def q_mmss(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", geo.mmss(F.sqrt("o_totalprice")).alias("at"), geo.pretty_label(F.lower("o_orderpriority")).alias("label"))


# One drawn scene per camera: a document a nation, half of them in pixels, some without crosswalks.
SIZES = ["*", "CASE WHEN n_nationkey % 2 = 0 THEN '1' ELSE '1000' END AS w", "CASE WHEN n_nationkey % 2 = 0 THEN '1' ELSE '500' END AS h",
         "CASE WHEN n_nationkey % 2 = 0 THEN concat('0.', CAST(1 + n_nationkey % 9 AS STRING)) ELSE CAST(50 * (1 + n_nationkey % 9) AS STRING) END AS y"]
DOCS = """concat('{"normalized": ', CASE WHEN n_nationkey % 2 = 0 THEN 'true' ELSE 'false, "image_size": [1000, 500]' END,
  ', "carriageway": [[[0, ', y, '], [', w, ', ', y, '], [', w, ', ', h, '], [0, ', h, ']]]', CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE concat(', "crosswalks": [{"polygon": [[0, 0], [', w, ', 0], [0, ', h, ']], "signal": "p', n_nationkey, '"}, [[0, 0], [0, ', h, '], [', w, ', ', h, ']]]') END,
  ', "lanes": [{"id": "L', n_regionkey, '", "polygon": [[0, 0], [', w, ', 0], [', w, ', ', y, ']], "direction": [', w, ', 0]}], "stop_lines": [{"points": [[0, 0], [', w, ', ', h, ']], "signal": "main", "approach": [0, ', h, ']}], "signal_rois": [{"id": "main", "rect": [0, 0, ', w, ', ', y, ']}]}') AS json"""


@query(
    "camera_scenes",
    """WITH n AS (SELECT CAST(n_nationkey AS BIGINT) AS video_id, n_nationkey, n_regionkey, (1 + n_nationkey % 9) / 10e0 AS y FROM nation)
    SELECT video_id, 'carriageway' AS kind, 0 AS ord, '0' AS id, NULL AS signal, 4 AS n_pts, 400e0 AS x, round(400 * (2 * y + 2) / 4, 6) AS y, NULL AS dir_x, NULL AS dir_y FROM n
    UNION ALL SELECT video_id, 'crosswalks', 0, '0', 'p' || n_nationkey, 3, round(800 / 3e0, 6), round(400 / 3e0, 6), NULL, NULL FROM n WHERE n_nationkey % 3 <> 0
    UNION ALL SELECT video_id, 'crosswalks', 1, '1', NULL, 3, round(800 / 3e0, 6), round(800 / 3e0, 6), NULL, NULL FROM n WHERE n_nationkey % 3 <> 0
    UNION ALL SELECT video_id, 'lanes', 0, 'L' || n_regionkey, NULL, 3, round(1600 / 3e0, 6), round(400 * y / 3, 6), 1e0, 0e0 FROM n
    UNION ALL SELECT video_id, 'stop_lines', 0, '0', 'main', 2, 400e0, 200e0, 0e0, 1e0 FROM n
    UNION ALL SELECT video_id, 'signal_rois', 0, 'main', 'vehicle', 4, 400e0, round(200 * y, 6), NULL, NULL FROM n""",
)
def q_cameras(spark, folder):
    from curbstream.sources import scenes

    docs = table(spark, folder, "nation").selectExpr(*SIZES).selectExpr("CAST(n_nationkey AS STRING) AS camera", DOCS)
    videos = table(spark, folder, "nation").select(F.col("n_nationkey").cast("bigint").alias("video_id"), F.col("n_nationkey").cast("string").alias("camera"), F.lit(800).alias("width"), F.lit(400).alias("height"))
    d = scenes.shapes_of_cameras(scenes.camera_shapes(docs), videos)
    mean = lambda a: F.round(F.aggregate("pts", F.lit(0.0), lambda s, p: s + p[a]) / F.size("pts"), 6)
    return d.select("video_id", "kind", "ord", "id", "signal", F.size("pts").alias("n_pts"), mean("x").alias("x"), mean("y").alias("y"), F.round("dir.x", 6).alias("dir_x"), F.round("dir.y", 6).alias("dir_y"))
