"""Grid search over finishing values and what-if runs of risk settings, over the event timeline."""
from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from curbstream.operators.metrics import TIOU_THRESHOLDS
from curbstream.operators.post import POST
from curbstream.plans import tuning
from curbstream.plans.params import RISK, RISK_WEIGHTS, class_params
from curbstream.queries.metric_queries import CURVE, SIDES, TAUS, match_sql
from curbstream.queries.registry import query
from curbstream.queries.rule_queries import FEATS, feature_rows
from curbstream.queries.series_queries import POST_DURATION, T0
from curbstream.sources.tables import event_spans

EVENTS = {"accident": {"min_confidence": 0.05, "merge_gap": 1.0, "min_len": 0.5}, "near_miss": {"min_confidence": 0.1, "merge_gap": 1.0, "min_len": 0.5}}
VALUES = {"accident": {"min_confidence": [0.02, 0.1, 0.3], "merge_gap": [1.0, 3600.0]}, "near_miss": {"min_confidence": [0.05, 0.2], "merge_gap": [0.0, 7200.0], "min_len": [0.5, 1800.0]}}


def _values() -> str:
    rows = []
    for label, choices in VALUES.items():
        now = class_params(EVENTS, label)
        for i, combo in enumerate([(), *itertools.product(*choices.values())]):
            v = {**now, **dict(zip(choices, combo))}
            rows.append(f"({i}, '{label}', " + ", ".join(f"{v[n]}e0" for n in POST) + ")")
    return ", ".join(rows)


def finished_sql(grid: str, suffix: str) -> str:
    """Final events under every row of ``grid``; the group is video and parameter row."""
    p = "PARTITION BY param_id, video_id, label"
    return f"""s{suffix} AS (SELECT param_id, user_id AS video_id, label, start_us - {T0} AS s, end_us - {T0} AS e, value / 500e0 AS conf, g.* EXCLUDE (param_id, label)
      FROM (SELECT *, CASE event_type WHEN 'purchase' THEN 'near_miss' ELSE 'accident' END AS label FROM sp WHERE event_type IN ('view', 'purchase', 'signup')) JOIN {grid} g USING (label) WHERE value / 500e0 >= min_confidence),
    r{suffix} AS (SELECT *, max(e) OVER ({p} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s{suffix}),
    i{suffix} AS (SELECT *, sum(CASE WHEN s - reach <= merge_gap * 1e6 THEN 0 ELSE 1 END) OVER ({p} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM r{suffix}),
    m1{suffix} AS (SELECT param_id, video_id, label, min(s) AS s, max(e) AS e, any_value(min_len) AS min_len, any_value(start_offset) AS so, any_value(end_offset) AS eo FROM i{suffix} GROUP BY param_id, video_id, label, isl),
    c{suffix} AS (SELECT param_id, video_id, label, greatest(0, s + CAST(round(so * 1e6) AS BIGINT)) AS s, least(CAST(round({POST_DURATION}e0 * 1e6) AS BIGINT), e + CAST(round(eo * 1e6) AS BIGINT)) AS e FROM m1{suffix} WHERE e - s >= min_len * 1e6),
    c2{suffix} AS (SELECT *, max(e) OVER ({p} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c{suffix} WHERE e - s >= 100000),
    c3{suffix} AS (SELECT *, sum(CASE WHEN s - reach <= 0 THEN 0 ELSE 1 END) OVER ({p} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM c2{suffix}),
    f{suffix} AS (SELECT param_id, video_id, label, CAST(round(round(min(s) / 1e6, 2) * 1e6) AS BIGINT) AS start_us, CAST(round(least(round(max(e) / 1e6, 2), floor({POST_DURATION}e0 * 100e0) / 100e0) * 1e6) AS BIGINT) AS end_us FROM c3{suffix} GROUP BY param_id, video_id, label, isl)"""


GRID = f"""{SIDES.replace('gt AS', 'gt0 AS').replace('pr AS', 'pr0 AS')}, grid(param_id, label, {', '.join(POST)}) AS (VALUES {_values()}), {finished_sql('grid', '')},
  gt AS (SELECT video_id * 1000 + param_id AS video_id, label, start_us - {T0} AS start_us, end_us - {T0} AS end_us, gt_id FROM gt0 JOIN grid USING (label)),
  pr AS (SELECT video_id * 1000 + param_id AS video_id, label, start_us, end_us, start_us AS pred_id FROM f WHERE end_us > start_us)"""
GRID_SCORES = f"""{match_sql(True)}, k AS (SELECT param_id, label, tau, (SELECT count(*) FROM gt WHERE gt.label = grid.label AND gt.video_id % 1000 = param_id) AS n_gt, (SELECT count(*) FROM pr WHERE pr.label = grid.label AND pr.video_id % 1000 = param_id) AS n_pred,
    (SELECT count(*) FROM m WHERE m.label = grid.label AND m.video_id % 1000 = param_id AND iou >= tau) AS tp FROM grid, {TAUS}),
  sc AS (SELECT param_id, label, avg(CASE WHEN n_gt + n_pred > 0 THEN 2e0 * tp / (n_gt + n_pred) ELSE 0e0 END) AS f1, max(CASE WHEN tau = {TIOU_THRESHOLDS[0]}e0 AND n_pred > 0 THEN tp / CAST(n_pred AS DOUBLE) ELSE 0e0 END) AS prec, max(n_pred) AS n_pred, max(n_gt) AS n_gt FROM k GROUP BY 1, 2)"""


def _sides(spark, folder):
    sp = event_spans(spark, folder, 600).withColumns({"start_us": F.col("start_us") - T0, "end_us": F.col("end_us") - T0, "video_id": F.col("user_id")})
    gt = sp.filter(F.col("event_type").isin("error", "click")).select("video_id", F.when(F.col("event_type") == "error", "accident").otherwise("near_miss").alias("label"), "start_us", "end_us", F.col("event_id").alias("gt_id"))
    seg = sp.filter(F.col("event_type").isin("view", "purchase", "signup")).select("video_id", F.when(F.col("event_type") == "purchase", "near_miss").otherwise("accident").alias("label"), "start_us", "end_us", (F.col("value") / 500.0).alias("confidence"))
    return seg, gt, seg.select("video_id").distinct().withColumn("duration", F.lit(POST_DURATION))


@query("post_grid_search", f'WITH RECURSIVE {GRID}, {GRID_SCORES} SELECT param_id, label, round(f1, 6) AS f1, round(prec, 6) AS "precision", n_pred, n_gt FROM sc')
def q_grid(spark, folder):
    seg, gt, dur = _sides(spark, folder)
    s = tuning.post_grid_search(seg, gt, dur, tuning.post_grid(spark, EVENTS, VALUES))
    return s.select("param_id", "label", F.round("f1", 6).alias("f1"), F.round("precision", 6).alias("precision"), "n_pred", "n_gt")


@query(
    "best_params",
    f"""WITH RECURSIVE {GRID}, {GRID_SCORES},
    b AS (SELECT sc.*, (SELECT f1 FROM sc z WHERE z.label = sc.label AND z.param_id = 0) AS f1_before FROM sc QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(f1, 9) DESC, param_id) = 1),
    ob AS (SELECT e.*, row_number() OVER (PARTITION BY e.gt_id ORDER BY iou DESC, pred_id) AS rn FROM e JOIN b ON b.label = e.label AND b.param_id = e.video_id % 1000),
    of AS (SELECT ob.label, (g.start_us - p.start_us) / 1e6 AS ds, (g.end_us - p.end_us) / 1e6 AS de FROM ob JOIN gt g ON g.video_id = ob.video_id AND g.gt_id = ob.gt_id JOIN pr p ON p.video_id = ob.video_id AND p.label = ob.label AND p.pred_id = ob.pred_id WHERE rn = 1),
    md AS (SELECT label, round(quantile_cont(ds, 0.5), 2) AS so2, round(quantile_cont(de, 0.5), 2) AS eo2 FROM of GROUP BY label)
    SELECT label, param_id, round(f1_before, 6) AS f1_before, round(f1, 6) AS f1_grid, so2 AS start_median, eo2 AS end_median FROM b LEFT JOIN md USING (label)""",
)
def q_best(spark, folder):
    """The grid's choice and the offsets it tries; whether they are taken is tested by ``tests/test_post.py``."""
    seg, gt, dur = _sides(spark, folder)
    best, offsets = tuning.best_of_grid(seg, gt, dur, tuning.post_grid(spark, EVENTS, VALUES))
    return best.join(offsets, "label", "left").select("label", "param_id", F.round("f1_before", 6).alias("f1_before"), F.round("f1", 6).alias("f1_grid"), F.col("new_start").alias("start_median"), F.col("new_end").alias("end_median"))


SETTINGS = {"as is": {}, "hotter": {"weights": {"bias": -5.0, "f_ttc": 11.0}}, "slow": {"ema_alpha": 0.2, "floor": 0.02}}
OWN = {n: {"w": {**RISK_WEIGHTS, **s.get("weights", {})}, "alpha": s.get("ema_alpha", RISK["ema_alpha"]), "floor": s.get("floor", RISK["floor"])} for n, s in SETTINGS.items()}
SET_SQL = ", ".join(f"('{n}', {o['w']['bias']}e0, {o['w']['f_ttc']}e0, {o['alpha']}e0, {o['floor']}e0)" for n, o in OWN.items())


@query(
    "risk_what_if",
    f"""WITH RECURSIVE {CURVE}, {FEATS}, st(setting, bias, ttc, alpha, floor) AS (VALUES {SET_SQL}),
    o AS (SELECT *, 1e0 / (1 + exp(-(bias + ttc * f_ttc + 1e0 * f_conflict + 2.5e0 * f_wrong + 1e0 * f_ped - 3e0 * f_density))) AS r, row_number() OVER (PARTITION BY setting, user_id ORDER BY t_us) AS rn FROM ft, st),
    f AS (SELECT setting, user_id, event_id, t_us, rn, f_density, floor, r AS e FROM o WHERE rn = 1 UNION ALL SELECT o.setting, o.user_id, o.event_id, o.t_us, o.rn, o.f_density, o.floor, f.e + o.alpha * (o.r - f.e) FROM f JOIN o ON o.setting = f.setting AND o.user_id = f.user_id AND o.rn = f.rn + 1)
    SELECT setting, user_id, event_id AS frame, round(least(1e0, greatest(max(e) OVER (PARTITION BY setting, user_id ORDER BY t_us RANGE BETWEEN 1000000 PRECEDING AND CURRENT ROW), floor + 0.04e0 * f_density)), 6) AS score FROM f""",
)
def q_what_if(spark, folder):
    return tuning.risk_what_if(feature_rows(spark, folder), SETTINGS, keys=("user_id",)).select("setting", "user_id", "frame", F.round("score", 6).alias("score"))
