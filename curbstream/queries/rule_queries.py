"""Event rules, final events and risk over the trajectory fixture."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbstream.operators import scene as sc
from curbstream.plans import conflicts, detect, risk, rules, tuning
from curbstream.plans.params import EVENTS, RISK, RISK_WEIGHTS
from curbstream.queries import track_sql as q
from curbstream.queries.metric_queries import ALARMS, ASSIGN, BUCKET, CURVE, label_sql, timeline
from curbstream.queries.online_queries import RISK_SQL, quantities
from curbstream.queries.registry import query
from curbstream.queries.scene_queries import scene_of
from curbstream.queries.series_queries import T0
from curbstream.queries.track_queries import r, track_table
from curbstream.session import stage
from curbstream.sources import fixture as fx
from curbstream.sources.tables import events, table

_INPUTS: dict[tuple, rules.Tables] = {}
_SEGMENTS: dict[tuple, DataFrame] = {}
_RISK: dict[tuple, DataFrame] = {}


def inputs(spark: SparkSession, folder: str) -> rules.Tables:
    """Rule inputs of a folder, staged once per session."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _INPUTS:
        t = track_table(spark, folder)
        phases = detect.signal_timeline(fx.signal_samples(spark, folder))
        _INPUTS[key] = rules.Tables(
            t, fx.frames(spark, folder), stage(fx.videos(spark, folder), "videos"), stage(scene_of(spark, folder), "scene"), stage(sc.learn(t), "cells"), stage(sc.flow_votes(t), "votes"), stage(phases, "phases")
        )
    return _INPUTS[key]


def shown(df: DataFrame) -> DataFrame:
    d = df.select("video_id", "label", "start_us", "end_us", F.round("confidence", 4).alias("confidence"), F.array_join("tracks", ",").alias("tracks"))
    return d


VEHICLES = f"cls IN {q.VEH}"


def rule_segments(spark: SparkSession, folder: str, label: str) -> DataFrame:
    """The segments of one rule, staged once per session."""
    key = (spark.sparkContext.applicationId, folder, label)
    if key not in _SEGMENTS:
        _SEGMENTS[key] = stage(rules.RULES[label](inputs(spark, folder), EVENTS[label]), f"segments_{label}")
    return _SEGMENTS[key]


def _rule(label: str, sql: str | None = None) -> None:
    @query(f"rule_{label}", sql)
    def run(spark, folder):
        return shown(rule_segments(spark, folder, label))


WRONG = f"""WITH {q.TRACKS}, v AS (SELECT *, CASE WHEN sx >= 0 AND sx < 1280 AND sy >= 340 AND sy < 520 THEN 1e0 ELSE 0e0 END AS st FROM tracks WHERE reliable AND {VEHICLES}),
  c AS (SELECT *, CASE WHEN st > 0 THEN vx / greatest(speed, 1e-9) ELSE 0e0 END AS cs, row_number() OVER (PARTITION BY video_id, track_id ORDER BY t_us) AS rn FROM v),
  f AS (SELECT *, lag(rn) OVER w AS pr, lag(t_us) OVER w AS pt FROM c WHERE speed > 0.5e0 AND st >= 0.6e0 AND cs < -0.5e0 WINDOW w AS (PARTITION BY video_id, track_id ORDER BY rn)),
  g AS (SELECT *, sum(CASE WHEN rn = pr + 1 OR t_us - pt <= 500000 THEN 0 ELSE 1 END) OVER (PARTITION BY video_id, track_id ORDER BY rn) AS isl FROM f),
  ru AS (SELECT video_id, track_id, min(t_us) AS s, max(t_us) AS e FROM g GROUP BY video_id, track_id, isl HAVING max(t_us) - min(t_us) >= 1500000),
  dt AS (SELECT video_id, track_id, quantile_cont(d, 0.5) AS dt FROM (SELECT video_id, track_id, t_us - lag(t_us) OVER (PARTITION BY video_id, track_id ORDER BY t_us) AS d FROM v) GROUP BY 1, 2),
  st AS (SELECT ru.*, arg_min(sx, t_us) AS x0, arg_min(sy, t_us) AS y0, arg_max(sx, t_us) AS x1, arg_max(sy, t_us) AS y1, quantile_cont(speed, 0.5) AS med, avg(CASE WHEN interp THEN 0e0 ELSE 1e0 END) AS rl, avg(st) AS ms, avg(-cs) AS mc,
    any_value(sc_a) AS sc_a, any_value(sc_b) AS sc_b, any_value(sc_min) AS sc_min FROM ru JOIN c USING (video_id, track_id) WHERE t_us BETWEEN s AND e GROUP BY ALL)
  SELECT video_id, 'wrong_way' AS label, s AS start_us, e AS end_us, round(least(greatest(ms * mc, 0e0), 1e0), 4) AS confidence, CAST(track_id AS VARCHAR) AS tracks FROM st JOIN dt USING (video_id, track_id)
  WHERE sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) / {q.SCALE.format(y='((y0 + y1) / 2)')} >= 2 AND med >= 0.8e0 AND rl >= 0.7e0
    AND (SELECT count(*) FROM c WHERE c.video_id = st.video_id AND c.track_id = st.track_id AND c.t_us >= st.s - 3000000 AND c.t_us < st.s AND c.speed > 0.5e0 AND c.st >= 0.6e0 AND c.cs > 0.5e0) * dt < 1e6"""

LINE_D = f"""v AS (SELECT *, {q.SCALE.format(y='sy')} AS s FROM tracks WHERE reliable AND {VEHICLES}),
  fp AS (SELECT *, sx + CASE WHEN speed > 0.3e0 THEN 0.5e0 * s * vx / speed ELSE 0e0 END AS fx, sy + CASE WHEN speed > 0.3e0 THEN 0.5e0 * s * vy / speed ELSE 0e0 END AS fy FROM v),
  dd2 AS (SELECT *, {q.SCALE.format(y='fy')} AS bl, sqrt((fx - 600e0) * (fx - 600e0) + (fy - least(greatest(fy, 250e0), 600e0)) * (fy - least(greatest(fy, 250e0), 600e0))) AS dist FROM fp),
  sd AS (SELECT *, CASE WHEN fx > 600e0 THEN dist / bl ELSE -dist / bl END AS d, (fy - 250e0) / 350e0 AS al, bl / 350e0 AS ext FROM dd2),
  red AS (SELECT *, CASE WHEN t_us // 7000000 % 2 = 0 THEN 'red' ELSE 'green' END AS sig FROM sd)"""
RED = f"""WITH {q.TRACKS}, {LINE_D},
  k AS (SELECT *, lag(d) OVER w AS pd, max(d <= -0.3e0) OVER (PARTITION BY video_id, track_id ORDER BY t_us RANGE BETWEEN 3000000 PRECEDING AND 1 PRECEDING) AS was,
    max(d >= 1e0) OVER (PARTITION BY video_id, track_id ORDER BY t_us RANGE BETWEEN 1 FOLLOWING AND 3000000 FOLLOWING) AS gets FROM red WINDOW w AS (PARTITION BY video_id, track_id ORDER BY t_us)),
  h AS (SELECT video_id, track_id, min(t_us) AS s FROM k WHERE d >= 0 AND pd < 0 AND al >= -0.5e0 * ext AND al <= 1 + 0.5e0 * ext AND speed >= 0.5e0 AND was AND gets GROUP BY 1, 2),
  o AS (SELECT * FROM h WHERE s // 7000000 % 2 = 0 AND s - (SELECT min(t0) FROM (SELECT DISTINCT CAST(ceil((t_us // 7000000 * 7000000) / 80000e0) AS BIGINT) * 80000 AS t0, t_us // 7000000 AS slot FROM red) z WHERE z.slot = h.s // 7000000) >= 500000)
  SELECT video_id, 'red_light' AS label, s AS start_us, least(coalesce((SELECT min(t_us) FROM red r WHERE r.video_id = o.video_id AND r.track_id = o.track_id AND r.t_us > o.s AND r.d >= 4),
    (SELECT max(t_us) FROM red r WHERE r.video_id = o.video_id AND r.track_id = o.track_id)), s + 8000000) AS end_us, 0.8e0 AS confidence, CAST(track_id AS VARCHAR) AS tracks FROM o"""

SOLID = f"""WITH {q.TRACKS}, v AS (SELECT *, y2 - 0.35e0 * (y2 - y1) AS top, row_number() OVER (PARTITION BY video_id, track_id ORDER BY t_us) AS rn, CASE WHEN sy < 400e0 THEN -1e0 ELSE 1e0 END AS side,
    max(speed) OVER (PARTITION BY video_id, track_id) AS ms FROM tracks WHERE reliable AND {VEHICLES}),
  f AS (SELECT *, rn - row_number() OVER (PARTITION BY video_id, track_id ORDER BY rn) AS isl FROM v WHERE ms >= 0.3e0 AND (top < 400e0) <> (y2 < 400e0)
    AND sqrt(power((x1 + x2) / 2 - least(greatest((x1 + x2) / 2, 0e0), 1280e0), 2) + power((top + y2) / 2 - 400e0, 2)) <= sqrt((x2 - x1) * (x2 - x1) + (y2 - top) * (y2 - top)) / 2),
  ru AS (SELECT video_id, track_id, min(t_us) AS s, max(t_us) AS e FROM f GROUP BY video_id, track_id, isl),
  a AS (SELECT ru.*, avg(side) FILTER (WHERE t_us < s) AS sb, min(side) FILTER (WHERE t_us > e) AS s0, max(side) FILTER (WHERE t_us > e) AS s1, max(t_us) FILTER (WHERE t_us > e) - min(t_us) FILTER (WHERE t_us > e) AS held
    FROM ru JOIN v USING (video_id, track_id) WHERE t_us BETWEEN s - 6000000 AND e + 6000000 GROUP BY ALL)
  SELECT video_id, 'solid_line_crossing' AS label, s AS start_us, e AS end_us, 0.7e0 AS confidence, CAST(track_id AS VARCHAR) AS tracks FROM a WHERE s0 = s1 AND held >= 1000000 AND sb * s0 < 0"""

STOP_LINE = f"""WITH {q.TRACKS}, {LINE_D},
  b AS (SELECT *, row_number() OVER (PARTITION BY video_id, track_id ORDER BY t_us) AS rn, d BETWEEN 0.4e0 AND 3e0 AND al >= -0.3e0 * ext AND al <= 1 + 0.3e0 * ext AND speed < 0.1e0 AS bad FROM red),
  i AS (SELECT *, rn - row_number() OVER (PARTITION BY video_id, track_id ORDER BY rn) AS isl FROM b WHERE bad),
  ru AS (SELECT video_id, track_id, min(t_us) AS s, max(t_us) AS e, avg(CASE WHEN sig = 'red' THEN 1e0 ELSE 0e0 END) AS red FROM i GROUP BY video_id, track_id, isl HAVING max(t_us) - min(t_us) >= 2000000),
  g AS (SELECT *, least(e, coalesce((SELECT min(t0) FROM (SELECT CAST(ceil((2 * k + 1) * 7000000 / 80000e0) AS BIGINT) * 80000 AS t0 FROM (SELECT unnest(range(0, 2)) AS k)) WHERE t0 > s AND t0 < 20000000), e)) AS e2 FROM ru
    WHERE red >= 0.5e0 AND EXISTS (SELECT 1 FROM red r WHERE r.video_id = ru.video_id AND r.track_id = ru.track_id AND r.d < -0.3e0))
  SELECT video_id, 'stop_line' AS label, s AS start_us, e2 AS end_us, 0.7e0 AS confidence, CAST(track_id AS VARCHAR) AS tracks FROM g WHERE e2 > s"""

JAYWALKING = f"""WITH {q.TRACKS}, p0 AS (SELECT *, {q.SCALE.format(y='foot_y')} AS bl FROM tracks WHERE reliable AND cls = 0 AND NOT rider AND track_size >= {0.03 * fx.HEIGHT}e0 AND NOT edge),
  pm AS (SELECT video_id, quantile_cont(bl, 0.5) AS med FROM p0 GROUP BY 1),
  p1 AS (SELECT p0.*, med, foot_x >= 0 AND foot_x < 1280 AND foot_y >= 250 AND foot_y < 600 AS inside, least(foot_x, 1280 - foot_x, foot_y - 250, 600 - foot_y) / bl AS dep,
    greatest(590 - foot_x, foot_x - 690, 0e0) AS gx, greatest(240 - foot_y, foot_y - 610, 0e0) AS gy FROM p0 JOIN pm USING (video_id)),
  p2 AS (SELECT *, CASE WHEN inside THEN dep ELSE 0e0 END AS depth, inside AND dep >= 0.5e0 AND speed <= 3e0 AND sqrt(gx * gx + gy * gy) > 0.6e0 * med AS cand FROM p1),
  vv AS (SELECT video_id, frame, x1, y1, x2, y2, speed FROM tracks WHERE {VEHICLES}),
  hid AS (SELECT DISTINCT p2.video_id, p2.track_id, p2.frame FROM p2 JOIN vv ON vv.video_id = p2.video_id AND vv.frame = p2.frame AND ((foot_x BETWEEN vv.x1 AND vv.x2 AND foot_y BETWEEN vv.y1 AND vv.y2)
    OR (vv.speed < 0.2e0 AND foot_x BETWEEN vv.x1 - 2 * bl AND vv.x2 + 2 * bl AND foot_y BETWEEN vv.y1 - 2 * bl AND vv.y2 + 2 * bl)) WHERE cand),
  p3 AS (SELECT p2.*, cand AND hid.track_id IS NULL AS ok, row_number() OVER (PARTITION BY p2.video_id, p2.track_id ORDER BY t_us) AS rn FROM p2 LEFT JOIN hid USING (video_id, track_id, frame)),
  i0 AS (SELECT *, lag(rn) OVER w AS pr, lag(t_us) OVER w AS pt FROM p3 WHERE ok WINDOW w AS (PARTITION BY video_id, track_id ORDER BY rn)),
  i1 AS (SELECT *, sum(CASE WHEN rn = pr + 1 OR t_us - pt <= 2000000 THEN 0 ELSE 1 END) OVER (PARTITION BY video_id, track_id ORDER BY rn) AS isl FROM i0),
  ru AS (SELECT video_id, track_id, min(t_us) AS s, max(t_us) AS e, arg_min(foot_x, t_us) AS x0, arg_min(foot_y, t_us) AS y0 FROM i1 GROUP BY video_id, track_id, isl HAVING max(t_us) - min(t_us) >= 1500000),
  g AS (SELECT ru.*, max(depth) AS deep, max(sqrt((foot_x - x0) * (foot_x - x0) + (foot_y - y0) * (foot_y - y0))) AS reach, quantile_cont(bl, 0.5) AS b FROM ru JOIN p3 USING (video_id, track_id) WHERE t_us BETWEEN s AND e GROUP BY ALL)
  SELECT video_id, 'jaywalking' AS label, s AS start_us, e AS end_us, 0.8e0 AS confidence, CAST(track_id AS VARCHAR) AS tracks FROM g WHERE deep >= 1e0 AND reach / b >= 1.5e0"""

for _label, _sql in (
    ("wrong_way", WRONG), ("congestion", None), ("stopped_vehicle", None), ("jaywalking", JAYWALKING), ("road_obstacle", None), ("red_light", RED), ("stop_line", STOP_LINE), ("solid_line_crossing", SOLID),
    ("failure_to_yield", None), ("illegal_u_turn", None), ("illegal_turn", None), ("near_miss", None), ("accident", None),
):
    _rule(_label, _sql)


@query(
    "stationary_episodes",
    f"""WITH {q.TRACKS}, v AS (SELECT *, count(*) FILTER (WHERE speed <= 0.3e0) OVER (PARTITION BY video_id, track_id ORDER BY t_us) AS g FROM tracks WHERE {VEHICLES}),
    h AS (SELECT *, speed > 0.3e0 AND t_us - min(t_us) FILTER (WHERE speed > 0.3e0) OVER (PARTITION BY video_id, track_id, g) >= 1000000 AS held FROM v),
    e AS (SELECT *, CASE WHEN held AND NOT coalesce(lag(held) OVER (PARTITION BY video_id, track_id ORDER BY t_us), false) THEN 1 ELSE 0 END AS ends FROM h),
    s AS (SELECT *, sum(ends) OVER (PARTITION BY video_id, track_id ORDER BY t_us) - ends AS seg FROM e)
    SELECT video_id, track_id, min(t_us) FILTER (WHERE speed < 0.1e0) AS start_us, max(t_us) FILTER (WHERE speed <= 0.3e0) AS end_us, max(ends) = 0 AS lost FROM s GROUP BY video_id, track_id, seg HAVING count(*) FILTER (WHERE speed < 0.1e0) > 0""",
)
def q_episodes(spark, folder):
    v = sc.vehicles(track_table(spark, folder)).select("video_id", "track_id", "t_us", "speed")
    d = rules.stationary_episodes(v, EVENTS["stopped_vehicle"])
    g = d.groupBy("video_id", "track_id", "seg").agg(F.min(F.when(F.col("speed") < 0.1, F.col("t_us"))).alias("start_us"), F.max(F.when(F.col("speed") <= 0.3, F.col("t_us"))).alias("end_us"), (F.max("ends") == 0).alias("lost"))
    return g.filter("start_us IS NOT NULL").select("video_id", "track_id", "start_us", "end_us", "lost")


@query(
    "abrupt_moments",
    f"""WITH {q.TRACKS}, v AS (SELECT video_id, track_id, t_us, speed, cos(radians(heading)) * speed AS hx, sin(radians(heading)) * speed AS hy FROM tracks WHERE reliable AND {VEHICLES}),
    m AS (SELECT *, avg(speed) OVER b AS b0, avg(speed) OVER a AS a0, degrees(atan2(avg(hy) OVER b, avg(hx) OVER b)) AS hb, degrees(atan2(avg(hy) OVER a, avg(hx) OVER a)) AS ha FROM v
      WINDOW b AS (PARTITION BY video_id, track_id ORDER BY t_us RANGE BETWEEN 1000000 PRECEDING AND 200001 PRECEDING), a AS (PARTITION BY video_id, track_id ORDER BY t_us RANGE BETWEEN 200000 FOLLOWING AND 999999 FOLLOWING)),
    d AS (SELECT *, coalesce(b0 >= 0.8e0 AND a0 <= 0.35e0 * b0 AND b0 - a0 >= 0.8e0, false) AS dr, coalesce(b0 >= 0.8e0 AND a0 >= 0.3e0 AND abs(ha - hb - 360 * floor((ha - hb + 180) / 360)) > 40, false) AS tu FROM m),
    f AS (SELECT *, coalesce(lag(dr OR tu) OVER (PARTITION BY video_id, track_id ORDER BY t_us), false) AS pf FROM d)
    SELECT video_id, track_id, t_us, CASE WHEN dr THEN 'drop' ELSE 'turn' END AS hit FROM f WHERE (dr OR tu) AND NOT pf""",
)
def q_moments(spark, folder):
    v = sc.vehicles(track_table(spark, folder)).filter("reliable").select("video_id", "track_id", "t_us", "speed", "heading")
    return conflicts.abrupt_moments(v, EVENTS["accident"]).select("video_id", "track_id", "t_us", "hit")


@query(
    "heading_changes",
    f"""WITH {q.TRACKS}, m AS (SELECT video_id, track_id, t_us, heading, lag(heading) OVER (PARTITION BY video_id, track_id ORDER BY t_us) AS ph FROM tracks WHERE reliable AND {VEHICLES} AND speed > 0.3e0),
    c AS (SELECT *, sum(CASE WHEN ph IS NULL THEN 0e0 ELSE heading - ph + 180 - 360 * floor((heading - ph + 180) / 360) - 180 END) OVER (PARTITION BY video_id, track_id ORDER BY t_us) AS cum FROM m)
    SELECT video_id, track_id, count(*) AS n_moving, round(max(cum) - min(cum), 3) AS turn FROM c GROUP BY 1, 2 HAVING count(*) >= 3""",
)
def q_turns(spark, folder):
    v = sc.vehicles(track_table(spark, folder)).filter("reliable").select("video_id", "track_id", "t_us", "heading", "speed")
    return rules.turn_range(rules.turn_changes(v, 0.3)).select("video_id", "track_id", "n_moving", F.round("ptp", 3).alias("turn"))


def segments_of(spark, folder) -> DataFrame:
    segments, errors = detect.detect(inputs(spark, folder), run=lambda label: rule_segments(spark, folder, label))
    if errors:
        raise RuntimeError(f"rules failed: {errors}")
    return segments


@query("final_events")
def q_final(spark, folder):
    return detect.final_events(segments_of(spark, folder), inputs(spark, folder).videos)


@query("event_counts")
def q_counts(spark, folder):
    return segments_of(spark, folder).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("video_id").alias("n_videos"))


@query("event_documents")
def q_documents(spark, folder):
    from curbstream.sources.documents import prediction_rows

    rk = risk_of(spark, folder).select("video_id", F.round(F.col("t_us") / 1e6, 2).alias("t"), F.round("score", 4).alias("score"))
    return prediction_rows(q_final(spark, folder), rk, inputs(spark, folder).videos)


def risk_of(spark, folder) -> DataFrame:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _RISK:
        raw = stage(quantities(spark, folder), "risk_raw")
        _RISK[key] = stage(risk.combine(stage(risk.features(raw), "risk_features")), "risk")
    return _RISK[key]


@query("risk_scores", RISK_SQL)
def q_risk(spark, folder):
    return r(risk_of(spark, folder), 5, "score")


FEATS = f"""ft AS (SELECT user_id, event_id, t_us, value / 500e0 AS f_ttc, event_id % 7 / 7e0 AS f_conflict, CASE WHEN event_type = 'error' THEN 1e0 ELSE 0e0 END AS f_wrong, CASE WHEN event_type = 'view' THEN 1e0 ELSE 0e0 END AS f_ped,
  least(1e0, value / 100e0) AS f_density FROM tl)"""
LOGIT = "1e0 / (1 + exp(-(-6e0 + 9e0 * f_ttc + 1e0 * f_conflict + 2.5e0 * f_wrong + 1e0 * f_ped - 3e0 * f_density)))"


def feature_rows(spark, folder) -> DataFrame:
    """Event rows as feature rows, on the stretched timeline of the scoring queries."""
    e = events(spark, folder).withColumn("t_us", F.floor((F.col("t_us") - T0) / 3600).cast("bigint"))
    one = lambda t: F.when(F.col("event_type") == t, 1.0).otherwise(0.0)
    z = F.lit(0.0)
    return e.select(
        "user_id", F.col("event_id").alias("frame"), "t_us", (F.col("value") / 500.0).alias("f_ttc"), z.alias("f_brake"), z.alias("f_swerve"), (F.col("event_id") % 7 / 7.0).alias("f_conflict"),
        one("error").alias("f_wrong"), z.alias("f_redrun"), one("view").alias("f_ped"), F.least(F.lit(1.0), F.col("value") / 100.0).alias("f_density"),
    )


@query(
    "risk_combine",
    f"""WITH RECURSIVE {CURVE}, {FEATS}, o AS (SELECT *, {LOGIT} AS r, row_number() OVER (PARTITION BY user_id ORDER BY t_us) AS rn FROM ft),
    f AS (SELECT user_id, event_id, t_us, rn, f_density, r AS e FROM o WHERE rn = 1 UNION ALL SELECT o.user_id, o.event_id, o.t_us, o.rn, o.f_density, f.e + 0.3e0 * (o.r - f.e) FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1)
    SELECT user_id, event_id AS frame, round(least(1e0, greatest(max(e) OVER (PARTITION BY user_id ORDER BY t_us RANGE BETWEEN 1000000 PRECEDING AND CURRENT ROW), 0.01e0 + 0.04e0 * f_density)), 6) AS score FROM f""",
)
def q_combine(spark, folder):
    return risk.combine(feature_rows(spark, folder), RISK_WEIGHTS, RISK, keys=("user_id",)).select("user_id", "frame", F.round("score", 6).alias("score"))


@query("fit_weights")
def q_fit(spark, folder):
    from curbstream.operators.metrics import label_frames

    _, gt = timeline(spark, folder)
    d = label_frames(feature_rows(spark, folder), gt.filter("label = 'accident'"), gt.filter("label = 'near_miss'"), ["user_id"], "t_us", "frame", BUCKET, fit=True)
    w = tuning.fit_weights(d)
    return spark.createDataFrame([(k, float(v)) for k, v in w.items()], "name string, weight double")


STEPS, LOWEST = 61, RISK_WEIGHTS["bias"] - 4.0
#: The step is part of the user number, so that the alarm SQL runs once for all of them.
SWEEP = f"""{CURVE.replace('fr AS', 'fr0 AS').replace('acc AS', 'acc0 AS').replace('nm AS', 'nm0 AS')}, {FEATS}, stp AS (SELECT unnest(range(0, {STEPS})) AS step),
  fr AS (SELECT step * 1000000 + user_id AS user_id, event_id, t_us, 1e0 / (1 + exp(-({LOWEST}e0 + step * 0.1e0 + 9e0 * f_ttc + 1e0 * f_conflict + 2.5e0 * f_wrong + 1e0 * f_ped - 3e0 * f_density))) AS score FROM ft, stp),
  acc AS (SELECT step * 1000000 + user_id AS user_id, s, e, event_id FROM acc0, stp), nm AS (SELECT step * 1000000 + user_id AS user_id, s, e FROM nm0, stp), {ALARMS.replace('0.1e0', '0.5e0')},
  ly AS (SELECT user_id, alarm_us FROM {label_sql('al', 'alarm_us')} WHERE y IS NOT NULL), {ASSIGN},
  n AS (SELECT step, (SELECT count(*) FROM ly WHERE user_id // 1000000 = step) AS n_alarms, (SELECT count(*) FROM asg WHERE user_id // 1000000 = step) AS n_matched, (SELECT count(*) FROM acc0) AS n_acc FROM stp)"""


@query(
    "bias_sweep",
    f"WITH RECURSIVE {SWEEP} SELECT CAST(step AS INT) AS step, round({LOWEST}e0 + step * 0.1e0, 4) AS bias, n_alarms, n_matched, round(CASE WHEN n_alarms + n_acc > 0 THEN 2e0 * n_matched / (n_alarms + n_acc) ELSE 0e0 END, 6) AS f1 FROM n",
)
def q_sweep(spark, folder):
    _, gt = timeline(spark, folder)
    s = tuning.bias_sweep(feature_rows(spark, folder), gt, RISK_WEIGHTS, "user_id", "t_us", "frame", bucket_us=BUCKET)
    return s.select("step", F.round("bias", 4).alias("bias"), "n_alarms", "n_matched", F.round("f1", 6).alias("f1"))


@query(
    "signal_flicker",
    f"""WITH th AS (SELECT l_suppkey % 25 AS video_id, CAST(floor(epoch_us(CAST(l_shipdate AS TIMESTAMP)) / 86400000000) AS BIGINT) * 1000000 AS t_us, l_partkey % 8 AS py, l_linenumber % 8 AS px, CAST(trunc(190 + max(l_quantity)) AS INT) AS v FROM lineitem GROUP BY 1, 2, 3, 4),
    lg AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY video_id, py, px ORDER BY t_us)) AS dv, v >= 200 AS hot FROM th),
    g AS (SELECT video_id, t_us, avg(CASE WHEN hot THEN 1e0 ELSE 0e0 END) AS share, avg(dv) FILTER (hot) AS change, row_number() OVER (PARTITION BY video_id ORDER BY t_us) AS rn FROM lg GROUP BY 1, 2),
    f AS (SELECT *, lag(rn) OVER w AS pr, lag(t_us) OVER w AS pt FROM g WHERE share >= {EVENTS['fire_smoke']['min_area_frac']}e0 AND change >= {EVENTS['fire_smoke']['flicker_thr']}e0 WINDOW w AS (PARTITION BY video_id ORDER BY t_us)),
    i AS (SELECT *, sum(CASE WHEN rn = pr + 1 OR t_us - pt <= 1500000 THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY t_us) AS isl FROM f)
    SELECT video_id, min(t_us) AS start_us, max(t_us) AS end_us FROM i GROUP BY video_id, isl HAVING max(t_us) - min(t_us) >= {EVENTS['fire_smoke']['min_sec']}e0 * 1e6""",
)
def q_flicker(spark, folder):
    """The step-change rule over cells derived from the order lines: one picture per supplier and day."""
    from curbstream.plans.thumbnails import flicker_runs
    from curbstream.sources.tables import epoch_us

    li = table(spark, folder, "lineitem").select((F.col("l_suppkey") % 25).alias("video_id"), (F.floor(epoch_us("l_shipdate") / 86_400_000_000) * 1_000_000).alias("t_us"), (F.col("l_partkey") % 8).alias("py"), (F.col("l_linenumber") % 8).alias("px"), "l_quantity")
    th = li.groupBy("video_id", "t_us", "py", "px").agg(F.lit(20).alias("h"), F.lit(200).alias("s"), (F.lit(190) + F.max("l_quantity")).cast("int").alias("v"))
    return flicker_runs(th, EVENTS["fire_smoke"])
