"""Scoring operators: temporal matching, F1, average precision, alarms, validation and suppression."""
from __future__ import annotations

from pyspark.sql import functions as F

from curbstream.operators import metrics, post
from curbstream.operators.ordered import DAY_US
from curbstream.plans.params import CLASSES
from curbstream.queries.registry import query
from curbstream.queries.series_queries import EV, HOUR, T0, spans
from curbstream.sources.tables import event_spans, events, table

# Errors and clicks act as ground truth, the other three types as predictions of the two classes.
SIDES = f"""{spans(600)},
  gt AS (SELECT user_id AS video_id, CASE event_type WHEN 'error' THEN 'accident' ELSE 'near_miss' END AS label, start_us, end_us, event_id AS gt_id FROM sp WHERE event_type IN ('error', 'click')),
  pr AS (SELECT user_id AS video_id, CASE event_type WHEN 'purchase' THEN 'near_miss' ELSE 'accident' END AS label, start_us, end_us, event_id AS pred_id FROM sp WHERE event_type IN ('view', 'purchase', 'signup'))"""
IOU = "(least(g.end_us, p.end_us) - greatest(g.start_us, p.start_us)) / CAST((g.end_us - g.start_us) + (p.end_us - p.start_us) - (least(g.end_us, p.end_us) - greatest(g.start_us, p.start_us)) AS DOUBLE)"
TAUS = "(VALUES (0.3e0), (0.5e0), (0.7e0)) tt(tau)"


def pairs_sql(by_label: bool) -> str:
    on = "g.label = p.label AND " if by_label else ""
    lab = "g.label" if by_label else "''"
    return f"""e AS (SELECT g.video_id, {lab} AS label, g.gt_id, p.pred_id, {IOU} AS iou FROM gt g JOIN pr p ON {on} g.video_id = p.video_id AND g.start_us < p.end_us AND p.start_us < g.end_us WHERE {IOU} >= 0.3e0)"""


def match_sql(by_label: bool) -> str:
    """Greedy matching: walk the edges of a group in order with the taken ends in lists."""
    return f"""{pairs_sql(by_label)},
    er AS (SELECT *, row_number() OVER (PARTITION BY video_id, label ORDER BY iou DESC, gt_id DESC, pred_id DESC) AS rn FROM e),
    mm AS (SELECT video_id, label, rn, gt_id, pred_id, iou, [gt_id] AS ug, [pred_id] AS up, true AS kept FROM er WHERE rn = 1
      UNION ALL SELECT er.video_id, er.label, er.rn, er.gt_id, er.pred_id, er.iou,
        CASE WHEN list_contains(mm.ug, er.gt_id) OR list_contains(mm.up, er.pred_id) THEN mm.ug ELSE list_append(mm.ug, er.gt_id) END,
        CASE WHEN list_contains(mm.ug, er.gt_id) OR list_contains(mm.up, er.pred_id) THEN mm.up ELSE list_append(mm.up, er.pred_id) END,
        NOT (list_contains(mm.ug, er.gt_id) OR list_contains(mm.up, er.pred_id))
      FROM mm JOIN er ON er.video_id = mm.video_id AND er.label = mm.label AND er.rn = mm.rn + 1),
    m AS (SELECT video_id, label, gt_id, pred_id, iou FROM mm WHERE kept)"""


PRF = """round(CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END, 6) AS "precision",
    round(CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2e0 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1"""
PER_CLASS = f"""c AS (SELECT l.label, tau, (SELECT count(*) FROM gt WHERE gt.label = l.label) AS ng, (SELECT count(*) FROM pr WHERE pr.label = l.label) AS np,
    (SELECT count(*) FROM m WHERE m.label = l.label AND m.iou >= tau) AS tp FROM (SELECT label FROM gt UNION SELECT label FROM pr) l, {TAUS}),
    pc AS (SELECT label, tau, tp, np - tp AS fp, ng - tp AS fn FROM c)"""


def sides(spark, folder):
    sp = event_spans(spark, folder, 600)
    gt = sp.filter(F.col("event_type").isin("error", "click")).select(
        F.col("user_id").alias("video_id"), F.when(F.col("event_type") == "error", "accident").otherwise("near_miss").alias("label"), "start_us", "end_us", F.col("event_id").alias("gt_id")
    )
    pr = sp.filter(F.col("event_type").isin("view", "purchase", "signup")).select(
        F.col("user_id").alias("video_id"), F.when(F.col("event_type") == "purchase", "near_miss").otherwise("accident").alias("label"), "start_us", "end_us", F.col("event_id").alias("pred_id")
    )
    return gt, pr


def rounded(df, cols, n=6):
    return df.select(*[F.round(c, n).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("tiou_pairs", f"WITH {SIDES}, {pairs_sql(True)} SELECT video_id, label, gt_id, pred_id, round(iou, 6) AS iou FROM e")
def q_pairs(spark, folder):
    gt, pr = sides(spark, folder)
    return rounded(metrics.iou_pairs(gt, pr, ["video_id", "label"], 0.3, DAY_US).select("video_id", "label", "gt_id", "pred_id", "iou"), ["iou"])


@query("tiou_match", f"WITH RECURSIVE {SIDES}, {match_sql(True)} SELECT video_id, label, gt_id, pred_id, round(iou, 6) AS iou FROM m")
def q_match(spark, folder):
    gt, pr = sides(spark, folder)
    return rounded(metrics.match_segments(gt, pr, ["video_id", "label"]), ["iou"])


@query("f1_by_class_tau", f"WITH RECURSIVE {SIDES}, {match_sql(True)}, {PER_CLASS} SELECT label, tau, tp, fp, fn, {PRF} FROM pc")
def q_f1(spark, folder):
    return rounded(metrics.per_class_f1(*sides(spark, folder)), ["precision", "recall", "f1"])


@query("micro_f1", f"WITH RECURSIVE {SIDES}, {match_sql(True)}, {PER_CLASS}, t AS (SELECT tau, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM pc GROUP BY tau) SELECT tau, tp, fp, fn, {PRF} FROM t")
def q_micro(spark, folder):
    return rounded(metrics.micro(metrics.per_class_f1(*sides(spark, folder))), ["precision", "recall", "f1"])


@query(
    "class_agnostic_f1",
    f"""WITH RECURSIVE {SIDES}, {match_sql(False)}, t AS (SELECT tau, (SELECT count(*) FROM m WHERE iou >= tau) AS tp, (SELECT count(*) FROM pr) AS np, (SELECT count(*) FROM gt) AS ng FROM {TAUS}),
    u AS (SELECT tau, tp, np - tp AS fp, ng - tp AS fn FROM t) SELECT tau, tp, fp, fn, {PRF} FROM u""",
)
def q_agnostic(spark, folder):
    return rounded(metrics.class_agnostic_f1(*sides(spark, folder)), ["precision", "recall", "f1"])


@query(
    "macro_score",
    f"""WITH RECURSIVE {SIDES}, {match_sql(True)}, {PER_CLASS}, f AS (SELECT label, avg(2e0 * tp / (2 * tp + fp + fn)) AS f1m FROM pc GROUP BY label)
    SELECT round(avg(f1m), 6) AS score_a, count(*) AS n_classes FROM f""",
)
def q_macro(spark, folder):
    return rounded(metrics.score_a(metrics.per_class_f1(*sides(spark, folder))), ["score_a"])


@query(
    "boundary_offsets",
    f"""WITH {SIDES}, {pairs_sql(True)}, b AS (SELECT e.*, row_number() OVER (PARTITION BY gt_id ORDER BY iou DESC, pred_id) AS rn FROM e),
    o AS (SELECT b.label, (g.start_us - p.start_us) / 1e6 AS ds, (g.end_us - p.end_us) / 1e6 AS de FROM b JOIN gt g USING (gt_id) JOIN pr p USING (pred_id) WHERE rn = 1)
    SELECT label, round(quantile_cont(ds, 0.5), 4) AS start_offset, round(quantile_cont(de, 0.5), 4) AS end_offset, count(*) AS n FROM o GROUP BY label""",
)
def q_offsets(spark, folder):
    from curbstream.operators.quantiles import exact_quantiles

    o = metrics.boundary_offsets(*sides(spark, folder))
    a = exact_quantiles(o, ["label"], "d_start", {"start_offset": 0.5}, 600.0)
    b = exact_quantiles(o, ["label"], "d_end", {"end_offset": 0.5}, 600.0)
    return a.join(b.drop("n"), "label").select("label", F.round("start_offset", 4).alias("start_offset"), F.round("end_offset", 4).alias("end_offset"), "n")


AP = """c AS (SELECT score, sum(y) AS p, count(*) AS k FROM s GROUP BY score),
    r AS (SELECT p, sum(p) OVER (ORDER BY score DESC) AS cp, sum(k) OVER (ORDER BY score DESC) AS ck FROM c),
    ap AS (SELECT sum(p * cp / CAST(ck AS DOUBLE)) / (SELECT sum(y) FROM s) AS ap_raw, (SELECT avg(y) FROM s) AS pos_rate, (SELECT count(*) FROM s) AS n FROM r)"""


@query(
    "average_precision",
    f"""WITH s AS (SELECT n_chars AS score, quality AS y FROM documents JOIN labels USING (doc_id)), {AP}
    SELECT round(ap_raw, 6) AS ap_raw, round(pos_rate, 6) AS pos_rate, n, round(greatest(0e0, (ap_raw - pos_rate) / (1 - pos_rate)), 6) AS ap FROM ap""",
)
def q_ap(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", F.col("n_chars").alias("score")).join(table(spark, folder, "labels").select("doc_id", "quality"), "doc_id")
    return rounded(metrics.average_precision(d, "score", "quality", 64.0), ["ap_raw", "pos_rate", "ap"])


# Time is stretched so that event spacing is of the order of the metric's seconds: one hour acts as one second.
CURVE = f"""{EV}, tl AS (SELECT event_id, user_id, event_type, value, (t_us - {T0}) // 3600 AS t_us FROM ev),
  fr AS (SELECT user_id, event_id, t_us, value / 500e0 AS score FROM tl),
  acc AS (SELECT user_id, t_us AS s, t_us + CAST(round(value * 1e4) AS BIGINT) AS e, event_id FROM tl WHERE event_type = 'error'),
  nm AS (SELECT user_id, t_us AS s, t_us + CAST(round(value * 1e4) AS BIGINT) AS e FROM tl WHERE event_type = 'click')"""


def label_sql(rows: str, t: str) -> str:
    return f"""(SELECT f.*, CASE WHEN EXISTS (SELECT 1 FROM acc a WHERE a.user_id = f.user_id AND a.s <= f.{t} AND f.{t} <= a.e) THEN NULL
      WHEN EXISTS (SELECT 1 FROM acc a WHERE a.user_id = f.user_id AND a.s - 5000000 <= f.{t} AND f.{t} < a.s) THEN 1
      WHEN EXISTS (SELECT 1 FROM nm WHERE nm.user_id = f.user_id AND nm.s - 5000000 <= f.{t} AND f.{t} <= nm.e) THEN NULL ELSE 0 END AS y FROM {rows} f)"""


def fit_label_sql(rows: str, t: str) -> str:
    return f"""(SELECT f.*, CASE WHEN EXISTS (SELECT 1 FROM acc a WHERE a.user_id = f.user_id AND a.s - 5000000 <= f.{t} AND f.{t} < a.s) THEN 1
      WHEN EXISTS (SELECT 1 FROM acc a WHERE a.user_id = f.user_id AND a.s <= f.{t} AND f.{t} <= a.e) THEN NULL
      WHEN EXISTS (SELECT 1 FROM nm WHERE nm.user_id = f.user_id AND nm.s - 5000000 <= f.{t} AND f.{t} <= nm.e) THEN NULL ELSE 0 END AS y FROM {rows} f)"""


ALARMS = """ho AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS rn FROM fr),
  hr AS (SELECT *, lag(rn) OVER w AS prn, lag(t_us) OVER w AS pt FROM ho WHERE score >= 0.1e0 WINDOW w AS (PARTITION BY user_id ORDER BY rn)),
  hi AS (SELECT *, sum(CASE WHEN rn = prn + 1 OR t_us - pt < 2000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY rn) AS isl FROM hr),
  al AS (SELECT user_id, min(t_us) AS alarm_us, max(t_us) AS alarm_end_us FROM hi GROUP BY user_id, isl)"""
ASSIGN = """ed AS (SELECT acc.user_id, acc.event_id AS gt_id, acc.s, ly.alarm_us, row_number() OVER (PARTITION BY acc.user_id ORDER BY acc.s, acc.e, acc.event_id, ly.alarm_us) AS rn
    FROM acc JOIN ly ON ly.user_id = acc.user_id AND acc.s - 10000000 <= ly.alarm_us AND ly.alarm_us < acc.s),
  wa AS (SELECT user_id, rn, gt_id, s, alarm_us, [gt_id] AS ug, [alarm_us] AS ua, true AS kept FROM ed WHERE rn = 1
    UNION ALL SELECT ed.user_id, ed.rn, ed.gt_id, ed.s, ed.alarm_us,
      CASE WHEN list_contains(wa.ug, ed.gt_id) OR list_contains(wa.ua, ed.alarm_us) THEN wa.ug ELSE list_append(wa.ug, ed.gt_id) END,
      CASE WHEN list_contains(wa.ug, ed.gt_id) OR list_contains(wa.ua, ed.alarm_us) THEN wa.ua ELSE list_append(wa.ua, ed.alarm_us) END,
      NOT (list_contains(wa.ug, ed.gt_id) OR list_contains(wa.ua, ed.alarm_us))
    FROM wa JOIN ed ON ed.user_id = wa.user_id AND ed.rn = wa.rn + 1),
  asg AS (SELECT user_id, gt_id, alarm_us, (s - alarm_us) / 1e6 AS tta FROM wa WHERE kept)"""
BUCKET = 20_000_000


def timeline(spark, folder):
    tl = events(spark, folder).withColumn("t_us", F.floor((F.col("t_us") - T0) / 3600).cast("bigint"))
    end = F.col("t_us") + F.round(F.col("value") * 1e4).cast("bigint")
    curve = tl.select("user_id", "event_id", "t_us", (F.col("value") / 500.0).alias("score"))
    gt = tl.filter(F.col("event_type").isin("error", "click")).select(
        "user_id", F.when(F.col("event_type") == "error", "accident").otherwise("near_miss").alias("label"), F.col("t_us").alias("start_us"), end.alias("end_us"), F.col("event_id").alias("gt_id")
    )
    return curve, gt


def alarms_of(curve):
    return metrics.alarm_starts(curve, ["user_id"], "t_us", "score", ["event_id"], theta=0.1)


@query("frame_labels", f"WITH {CURVE} SELECT user_id, event_id, y FROM {label_sql('fr', 't_us')}")
def q_labels(spark, folder):
    curve, gt = timeline(spark, folder)
    return metrics.label_frames(curve, gt.filter("label = 'accident'"), gt.filter("label = 'near_miss'"), ["user_id"], "t_us", "event_id", BUCKET).select("user_id", "event_id", "y")


@query("training_labels", f"WITH {CURVE} SELECT user_id, event_id, y FROM {fit_label_sql('fr', 't_us')}")
def q_fit_labels(spark, folder):
    curve, gt = timeline(spark, folder)
    d = metrics.label_frames(curve, gt.filter("label = 'accident'"), gt.filter("label = 'near_miss'"), ["user_id"], "t_us", "event_id", BUCKET, fit=True)
    return d.select("user_id", "event_id", "y")


@query("alarm_starts", f"WITH {CURVE}, {ALARMS} SELECT * FROM al")
def q_alarms(spark, folder):
    return alarms_of(timeline(spark, folder)[0])


@query("alarm_assignment", f"WITH RECURSIVE {CURVE}, {ALARMS}, ly AS (SELECT * FROM al), {ASSIGN} SELECT * FROM asg")
def q_assign(spark, folder):
    curve, gt = timeline(spark, folder)
    return metrics.assign_alarms(alarms_of(curve), gt.filter("label = 'accident'"), ["user_id"], BUCKET)


@query(
    "score_b",
    f"""WITH RECURSIVE {CURVE.replace("value / 500e0 AS score", "least(1e0, value / 100e0) AS score")}, {ALARMS.replace("0.1e0", "0.5e0")},
    ly AS (SELECT user_id, alarm_us FROM {label_sql('al', 'alarm_us')} WHERE y IS NOT NULL), {ASSIGN},
    s AS (SELECT score, y FROM {label_sql('fr', 't_us')} WHERE y IS NOT NULL), {AP},
    k AS (SELECT ap_raw, pos_rate, n, greatest(0e0, (ap_raw - pos_rate) / (1 - pos_rate)) AS ap, (SELECT count(*) FROM ly) AS n_alarms, (SELECT count(*) FROM acc) AS n_accidents,
      (SELECT count(*) FROM asg) AS n_matched, (SELECT sum(tta) FROM asg) AS tta FROM ap),
    z AS (SELECT *, n_matched / CAST(n_alarms AS DOUBLE) AS p, n_matched / CAST(n_accidents AS DOUBLE) AS r, tta / n_accidents AS mtta FROM k)
    SELECT round(ap_raw, 6) AS ap_raw, round(pos_rate, 6) AS pos_rate, n, round(ap, 6) AS ap, n_alarms, n_accidents, n_matched, round(p, 6) AS alarm_precision, round(r, 6) AS alarm_recall,
      round(2 * p * r / (p + r), 6) AS f1_alarm, round(mtta, 6) AS mtta, round(0.4e0 * ap + 0.4e0 * 2 * p * r / (p + r) + 0.2e0 * least(1e0, mtta / 10), 6) AS score_b FROM z""",
)
def q_score_b(spark, folder):
    curve, gt = timeline(spark, folder)
    curve = curve.withColumn("score", F.least(F.lit(1.0), F.col("score") * 500.0 / 100.0))
    b = metrics.score_b(curve, gt, ["user_id"], "t_us", "score", "event_id", bucket_us=BUCKET)
    return rounded(b, ["ap_raw", "pos_rate", "ap", "alarm_precision", "alarm_recall", "f1_alarm", "mtta", "score_b"])


@query(
    "risk_summary",
    f"""WITH {CURVE} SELECT f.user_id, max(score) AS max_score, coalesce(max(score) FILTER (WHERE EXISTS (SELECT 1 FROM acc WHERE acc.user_id = f.user_id AND acc.s - 5000000 <= f.t_us AND f.t_us < acc.s)), 0) AS pre_max,
    max(score) >= 0.5e0 AND NOT bool_or(EXISTS (SELECT 1 FROM acc WHERE acc.user_id = f.user_id)) AS false_alarm FROM fr f GROUP BY f.user_id""",
)
def q_risk_summary(spark, folder):
    curve, gt = timeline(spark, folder)
    return metrics.risk_summary(curve, gt.filter("label = 'accident'"), ["user_id"], "t_us", "score", BUCKET)


@query(
    "suppress_overlaps",
    f"""WITH {spans(60)}, s AS (SELECT c_nationkey AS video_id, event_type, event_id, start_us, end_us, value, user_id FROM sp JOIN customer ON c_custkey = user_id)
    SELECT video_id, event_type AS label, event_id, start_us, end_us FROM s a WHERE NOT (event_type = 'purchase' AND EXISTS (SELECT 1 FROM s b WHERE b.video_id = a.video_id AND b.user_id = a.user_id
      AND b.event_type = 'error' AND b.value >= 30e0 AND a.start_us <= b.end_us + {HOUR} AND b.start_us <= a.end_us + {HOUR}))""",
)
def q_suppress(spark, folder):
    s = event_spans(spark, folder, 60).join(table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("video_id")), "user_id")
    s = s.select("video_id", F.col("event_type").alias("label"), "event_id", "start_us", "end_us", "value", F.array("user_id").alias("tracks"))
    d = post.drop_overlapping(s, s.filter("label = 'error' AND value >= 30"), F.col("label") == "purchase", HOUR)
    return d.select("video_id", "label", "event_id", "start_us", "end_us")


@query(
    "unreported_candidates",
    f"""WITH {spans(60)}, c AS (SELECT *, value / 500e0 AS confidence FROM sp), r AS (SELECT * FROM c WHERE confidence >= 0.2e0),
    x AS (SELECT * FROM c a WHERE confidence < 0.2e0 AND NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = a.user_id AND r.event_type = a.event_type AND a.start_us < r.end_us AND r.start_us < a.end_us)),
    k AS (SELECT user_id AS video_id, event_type AS label, start_us, end_us, confidence, row_number() OVER (PARTITION BY user_id ORDER BY confidence DESC, start_us, end_us, event_type) AS rank FROM x)
    SELECT * FROM k WHERE rank <= 10""",
)
def q_unreported(spark, folder):
    c = event_spans(spark, folder, 60).select(F.col("user_id").alias("video_id"), F.col("event_type").alias("label"), "start_us", "end_us", (F.col("value") / 500.0).alias("confidence"))
    d = post.unreported_candidates(c, c.filter("confidence >= 0.2"), F.lit(0.2), 10)
    return d.select("video_id", "label", "start_us", "end_us", "confidence", F.col("rank").cast("bigint").alias("rank"))


# Durations are per user; labels outside the class list, reversed times and late ends occur in the data by construction.
SEGS = f"""{EV}, sg AS (SELECT event_id, user_id AS video_id, CASE event_type WHEN 'error' THEN 'accident' WHEN 'click' THEN 'near_miss' WHEN 'view' THEN 'congestion' WHEN 'purchase' THEN 'stop_line' ELSE 'signup' END AS label,
  ((t_us - {T0}) // 1000) / 1e3 AS "start", ((t_us - {T0}) // 1000) / 1e3 + (value - 10e0) * 60e0 AS "end" FROM ev), du AS (SELECT video_id, max("start") - 7200e0 AS duration FROM sg GROUP BY video_id)"""
OFFICIAL = ", ".join(f"'{c}'" for c in CLASSES)


def submitted(spark, folder):
    e = events(spark, folder)
    label = F.create_map(*[F.lit(x) for kv in (("error", "accident"), ("click", "near_miss"), ("view", "congestion"), ("purchase", "stop_line"), ("signup", "signup")) for x in kv])[F.col("event_type")]
    s = (F.floor((F.col("t_us") - T0) / 1000) / 1e3).alias("start")
    d = e.select("event_id", F.col("user_id").alias("video_id"), label.alias("label"), s, (s + (F.col("value") - 10.0) * 60.0).alias("end"))
    return d, d.groupBy("video_id").agg((F.max("start") - 7200.0).alias("duration"))


@query(
    "validate_segments",
    f"""WITH {SEGS}, o AS (SELECT *, lag("end") OVER (PARTITION BY video_id, label ORDER BY "start", "end", event_id) AS pe FROM sg WHERE label IN ({OFFICIAL}))
    SELECT video_id, 'bad_times' AS rule, event_id AS row_id FROM sg WHERE NOT ("start" >= 0 AND "start" < "end")
    UNION ALL SELECT video_id, 'unknown_label', event_id FROM sg WHERE label NOT IN ({OFFICIAL})
    UNION ALL SELECT video_id, 'after_video_end', event_id FROM sg JOIN du USING (video_id) WHERE label IN ({OFFICIAL}) AND "end" > duration + 0.5e0
    UNION ALL SELECT video_id, 'overlap', event_id FROM o WHERE "start" < pe""",
)
def q_validate(spark, folder):
    return post.validate_segments(*submitted(spark, folder), "event_id")


@query(
    "clean_events",
    f"""WITH RECURSIVE {SEGS}, ok AS (SELECT video_id, label, event_id, CAST(round("start" * 1e3) AS BIGINT) AS s, CAST(round(least("end", duration) * 1e3) AS BIGINT) AS e FROM sg JOIN du USING (video_id)
      WHERE label IN ({OFFICIAL}) AND "start" >= 0 AND "start" < least("end", duration)),
    o AS (SELECT *, row_number() OVER (PARTITION BY video_id, label ORDER BY s, event_id) AS rn FROM ok),
    f AS (SELECT video_id, label, event_id, s, e, rn, e AS reach, true AS kept FROM o WHERE rn = 1
      UNION ALL SELECT o.video_id, o.label, o.event_id, o.s, o.e, o.rn, CASE WHEN o.s >= f.reach THEN o.e ELSE f.reach END, o.s >= f.reach FROM f JOIN o ON o.video_id = f.video_id AND o.label = f.label AND o.rn = f.rn + 1)
    SELECT video_id, label, event_id, s / 1e3 AS "start", e / 1e3 AS "end" FROM f WHERE kept""",
)
def q_clean(spark, folder):
    return post.clean_events(*submitted(spark, folder), ["event_id"])


@query(
    "validate_curve",
    f"""WITH {EV}, c AS (SELECT user_id AS video_id, event_id, t_us + CAST(round(sin(event_id) * 4e9) AS BIGINT) AS t_us, value / 300e0 AS score FROM ev),
    l AS (SELECT *, coalesce(lag(t_us) OVER (PARTITION BY video_id ORDER BY event_id), -1000000) AS pt FROM c)
    SELECT video_id, 'time_goes_back' AS rule, event_id AS row_id FROM l WHERE t_us < pt UNION ALL SELECT video_id, 'score_out_of_range', event_id FROM l WHERE NOT score BETWEEN 0 AND 1""",
)
def q_validate_curve(spark, folder):
    c = events(spark, folder).select(
        F.col("user_id").alias("video_id"), "event_id", (F.col("t_us") + F.round(F.sin(F.col("event_id").cast("double")) * 4e9).cast("bigint")).alias("t_us"), (F.col("value") / 300.0).alias("score")
    )
    return post.validate_curve(c, "t_us", "score", "event_id")


@query(
    "missing_extra_videos",
    """SELECT DISTINCT c_custkey AS video_id, 'missing' AS issue FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)
    UNION ALL SELECT DISTINCT user_id, 'extra' FROM events WHERE user_id NOT IN (SELECT o_custkey FROM orders) AND user_id NOT IN (SELECT c_custkey FROM customer)""",
)
def q_missing(spark, folder):
    return post.missing_and_extra(
        table(spark, folder, "customer").select(F.col("c_custkey").alias("video_id")), table(spark, folder, "events").select(F.col("user_id").alias("video_id"))
    )


@query(
    "score_classes",
    "SELECT DISTINCT event_type AS label FROM events UNION SELECT DISTINCT o_orderstatus FROM orders",
)
def q_classes(spark, folder):
    e = table(spark, folder, "events").select(F.col("event_type").alias("label"))
    return e.union(table(spark, folder, "orders").select("o_orderstatus")).distinct()


@query(
    "class_examples",
    f"""WITH {spans(60)}, c AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events WHERE event_type = 'click' AND value >= 50e0),
    v AS (SELECT s.*, EXISTS (SELECT 1 FROM c WHERE c.user_id = s.user_id AND s.start_us - 1000000 <= c.t AND c.t <= s.end_us + 1000000) AS verified FROM sp s WHERE event_type <> 'click'),
    r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY verified DESC, least(end_us - start_us, 10000000) DESC, user_id, start_us, end_us) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM v)
    SELECT event_type AS label, user_id AS video_id, start_us, end_us, verified, n FROM r WHERE rn = 1""",
)
def q_examples(spark, folder):
    from curbstream.plans.explore import class_examples

    sp = event_spans(spark, folder, 60)
    ev = sp.filter("event_type <> 'click'").select(F.col("user_id").alias("video_id"), F.col("event_type").alias("label"), "start_us", "end_us")
    c = sp.filter("event_type = 'click' AND value >= 50").select(F.col("user_id").alias("video_id"), F.col("start_us").alias("t_us"), F.lit("correct").alias("verdict"))
    return class_examples(ev, c.join(ev.select("label").distinct().withColumn("verdict", F.lit("correct")), "verdict"))
