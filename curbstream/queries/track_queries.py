"""Track-table operators over the trajectory fixture."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbstream.operators import series, tracks
from curbstream.plans import explore
from curbstream.queries import track_sql as q
from curbstream.queries.registry import query
from curbstream.sources import fixture as fx
from curbstream.sources.tables import table

_BUILT: dict[tuple, DataFrame] = {}


def track_table(spark: SparkSession, folder: str) -> DataFrame:
    """The staged track table of a folder, built once per session."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _BUILT:
        _BUILT[key] = tracks.build_tracks(fx.tracks_raw(spark, folder), fx.frames(spark, folder), fx.videos(spark, folder))
    return _BUILT[key]


def r(df: DataFrame, n: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, n) + F.lit(0.0) for c in cols})


def rd(n: int, *cols: str) -> str:
    return ", ".join(f"round({c}, {n}) + 0e0 AS {c}" for c in cols)


@query("tracks_raw", f"WITH {q.RAW} SELECT video_id, ord, frame, t_us, track_id, cls, {rd(6, 't', 'conf', 'x1', 'y1', 'x2', 'y2')} FROM raw")
def q_raw(spark, folder):
    return r(fx.tracks_raw(spark, folder), 6, "t", "conf", "x1", "y1", "x2", "y2").select("video_id", "ord", "frame", "t_us", "track_id", "cls", "t", "conf", "x1", "y1", "x2", "y2")


@query("frame_clock", f"WITH {q.RAW}, v AS (SELECT DISTINCT video_id FROM raw) SELECT video_id, unnest(range(0, {fx.N_FRAMES})) AS frame FROM v")
def q_frames(spark, folder):
    return fx.frames(spark, folder).select("video_id", "frame")


@query("video_meta", "SELECT o_orderkey AS video_id, CASE WHEN o_totalprice / 1000e0 BETWEEN 1 AND 240 THEN o_totalprice / 1000e0 ELSE 25e0 END AS fps FROM orders")
def q_meta(spark, folder):
    from curbstream.sources.documents import sane_fps

    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("video_id"), sane_fps(F.col("o_totalprice") / 1000.0).alias("fps"))


@query(
    "dedupe_rows",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) AS k FROM lineitem) WHERE k = 1""",
)
def q_dedupe(spark, folder):
    li = table(spark, folder, "lineitem").withColumn("ord", F.struct("l_partkey", "l_suppkey", "l_quantity"))
    return tracks.dedupe(li, ["l_orderkey", "l_linenumber"], "ord").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("majority_class", f"WITH {q.DEDUPED}, {q.majority('m', 'dd')} SELECT * FROM m")
def q_majority(spark, folder):
    return tracks.majority_class(tracks.dedupe(tracks.admit(fx.tracks_raw(spark, folder))))


@query("majority_vote", "SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY round(sum(value), 6) DESC, event_type) AS k FROM events GROUP BY 1, 2) WHERE k = 1")
def q_vote(spark, folder):
    e = table(spark, folder, "events").select("user_id", F.col("value").alias("conf"), "event_type")
    rank = e.select("event_type").distinct().select("event_type", F.ascii("event_type").alias("a"), F.ascii(F.substring("event_type", 2, 1)).alias("b"))
    e = e.join(rank.select("event_type", (F.col("a") * 256 + F.col("b")).alias("cls")), "event_type")
    m = tracks.majority_class(e, ["user_id"])
    return m.join(rank.select("event_type", (F.col("a") * 256 + F.col("b")).alias("cls")), "cls").select("user_id", "event_type")


@query("row_scale", f"WITH {q.SCALED} SELECT video_id, {rd(5, 'sc_a', 'sc_b', 'sc_min')} FROM scale")
def q_scale(spark, folder):
    return r(tracks.scale_of(fx.tracks_raw(spark, folder), fx.videos(spark, folder)), 5, "sc_a", "sc_b", "sc_min")


@query(
    "weighted_line_fit",
    """WITH v AS (SELECT p_brand AS g, CAST(p_size AS DOUBLE) AS fy, p_retailprice AS s FROM part), sr AS (SELECT g, min(fy) AS y0, (max(fy) + 1e-6 - min(fy)) / 10 AS step, count(*) AS n_all, quantile_cont(s, 0.5) AS m FROM v GROUP BY 1),
    sb AS (SELECT g, y0 + (least(floor((fy - y0) / step), 9) + 0.5e0) * step AS x, quantile_cont(s, 0.5) AS y, count(*) AS n FROM v JOIN sr USING (g) GROUP BY 1, 2 HAVING count(*) >= 5),
    sc AS (SELECT g, count(*) AS nb, sum(n * x) / sum(n) AS xm, sum(n * y) / sum(n) AS ym FROM sb GROUP BY 1), sl AS (SELECT g, sum(n * (x - xm) * (y - ym)) / sum(n * (x - xm) * (x - xm)) AS b FROM sb JOIN sc USING (g) GROUP BY 1)
    SELECT g AS video_id, round(CASE WHEN n_all >= 30 AND nb >= 2 AND b >= 0 THEN ym - b * xm ELSE m END, 4) AS sc_a, round(CASE WHEN n_all >= 30 AND nb >= 2 AND b >= 0 THEN b ELSE 0 END, 5) AS sc_b, round(m * 0.25e0, 4) AS sc_min
    FROM sr LEFT JOIN sc USING (g) LEFT JOIN sl USING (g)""",
)
def q_fit(spark, folder):
    p = table(spark, folder, "part").select(F.col("p_brand").alias("video_id"), F.col("p_size").cast("double").alias("foot_y"), F.col("p_retailprice").alias("size"), F.lit(1).alias("k"))
    s = tracks.scale_line(p, p.select("video_id").distinct().withColumn("height", F.lit(720)))
    return s.select("video_id", F.round("sc_a", 4).alias("sc_a"), F.round("sc_b", 5).alias("sc_b"), F.round("sc_min", 4).alias("sc_min"))


def _pieces(spark, folder):
    v = fx.videos(spark, folder)
    raw = fx.tracks_raw(spark, folder)
    return tracks.split_pieces(tracks.admit(raw), tracks.scale_of(raw, v), v)


@query("split_tracks", f"WITH {q.PIECES} SELECT video_id, track_id, src_id, piece, frame FROM pieces")
def q_split(spark, folder):
    return _pieces(spark, folder).select("video_id", "track_id", "src_id", "piece", "frame")


@query("interpolate_gaps", f"WITH {q.FILLED} SELECT video_id, track_id, frame, t_us, interp, {rd(5, 'conf', 'x1', 'y1', 'x2', 'y2')} FROM filled")
def q_interp(spark, folder):
    d = tracks.filled_tracks(fx.tracks_raw(spark, folder), fx.frames(spark, folder), fx.videos(spark, folder))
    return r(d, 5, "conf", "x1", "y1", "x2", "y2").select("video_id", "track_id", "frame", "t_us", "interp", "conf", "x1", "y1", "x2", "y2")


@query("track_stats", f"WITH {q.VALUED} SELECT DISTINCT video_id, track_id, reliable, {rd(9, 'track_conf', 'track_size')} FROM rows1")
def q_stats(spark, folder):
    return r(track_table(spark, folder), 9, "track_conf", "track_size").select("video_id", "track_id", "reliable", "track_conf", "track_size").distinct()


@query("riders", f"WITH {q.VALUED} SELECT * FROM rid")
def q_riders(spark, folder):
    return track_table(spark, folder).filter("rider AND cls = 0").select("video_id", "track_id").distinct()


@query("track_kinematics", f"WITH {q.TRACKS} SELECT video_id, track_id, frame, cls, edge, interp, {rd(5, 'foot_x', 'foot_y', 'sx', 'sy')}, {rd(4, 'vx', 'vy', 'speed', 'accel')} FROM tracks")
def q_kin(spark, folder):
    d = r(r(track_table(spark, folder), 5, "foot_x", "foot_y", "sx", "sy"), 4, "vx", "vy", "speed", "accel")
    return d.select("video_id", "track_id", "frame", "cls", "edge", "interp", "foot_x", "foot_y", "sx", "sy", "vx", "vy", "speed", "accel")


@query("tracks_per_class", f"WITH {q.VALUED} SELECT video_id, cls, count(DISTINCT track_id) AS n_tracks FROM rows1 GROUP BY 1, 2")
def q_per_class(spark, folder):
    return explore.tracks_per_class(track_table(spark, folder))


@query("counts_per_second", f"WITH {q.VALUED} SELECT video_id, cls, CAST(t_us // 1000000 AS BIGINT) AS second, count(DISTINCT track_id) AS n_objects FROM rows1 GROUP BY 1, 2, 3")
def q_per_second(spark, folder):
    return explore.counts_per_second(track_table(spark, folder))


@query("speed_quantiles", f"WITH {q.TRACKS} SELECT video_id, round(quantile_cont(speed, 0.5), 2) AS p50, round(quantile_cont(speed, 0.9), 2) AS p90, count(*) AS n FROM tracks WHERE speed > 0.3e0 GROUP BY 1")
def q_speed(spark, folder):
    return explore.speed_quantiles(track_table(spark, folder))


@query("speed_histogram", f"WITH {q.TRACKS} SELECT video_id, CAST(least(floor(least(speed, 8e0) / 0.5e0), 15) AS INT) AS bin, count(*) AS n FROM tracks WHERE speed > 0.3e0 GROUP BY 1, 2")
def q_hist(spark, folder):
    return explore.speed_histogram(track_table(spark, folder))


@query(
    "heatmap",
    f"WITH {q.VALUED} SELECT video_id, CAST(least(floor(foot_x / 20e0), 63) AS INT) AS bx, CAST(least(floor(foot_y / 20e0), 35) AS INT) AS by, count(*) AS n, round(ln(1 + count(*)), 6) AS heat FROM rows1 WHERE foot_x BETWEEN 0 AND 1280 AND foot_y BETWEEN 0 AND 720 GROUP BY 1, 2, 3",
)
def q_heat(spark, folder):
    return explore.heatmap(track_table(spark, folder).drop("width", "height"), fx.videos(spark, folder))


@query(
    "net_directions",
    f"WITH {q.TRACKS} SELECT video_id, track_id, count(*) AS n, round(degrees(atan2(arg_max(sy, t_us) - arg_min(sy, t_us), arg_max(sx, t_us) - arg_min(sx, t_us))), 3) + 0e0 AS angle FROM tracks GROUP BY 1, 2 HAVING count(*) >= 5",
)
def q_dirs(spark, folder):
    return r(explore.net_directions(track_table(spark, folder)), 3, "angle")


@query("track_id_remap", f"WITH {q.RAW}, f AS (SELECT video_id, track_id, min(frame) AS f0 FROM raw GROUP BY 1, 2) SELECT video_id, track_id, dense_rank() OVER (PARTITION BY video_id ORDER BY f0, track_id) AS new_id FROM f")
def q_remap(spark, folder):
    return tracks.dense_ids(fx.tracks_raw(spark, folder))


@query("stride_sampling", f"WITH {q.RAW} SELECT video_id, track_id, frame FROM raw WHERE frame % 2 = 0")
def q_stride(spark, folder):
    # The operator itself: keep every second frame, as a 25 fps source is processed at 12.5 Hz.
    return series.sample_stride(fx.tracks_raw(spark, folder), series.stride_for(25.0, 12.5, 2)).select("video_id", "track_id", "frame")
