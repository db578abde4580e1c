"""Scoring of segments and risk curves against ground truth."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbstream.operators.greedy import match_one_to_one
from curbstream.operators.intervals import merge_intervals, overlap_join, tiou
from curbstream.operators.ordered import DAY_US, Scan, ordered_scan, runs

# Fixed values of the metric.
TIOU_THRESHOLDS = (0.3, 0.5, 0.7)
ALARM_THRESHOLD = 0.5
ALARM_MERGE_US = 2_000_000
POSITIVE_US = 5_000_000
ALARM_WINDOW_US = 10_000_000
WEIGHT_A, WEIGHT_B = 0.7, 0.3
WEIGHT_AP, WEIGHT_F1, WEIGHT_TTA = 0.4, 0.4, 0.2


def one_row(*parts: DataFrame) -> DataFrame:
    """Put one-row tables with different columns side by side."""
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p, allowMissingColumns=True)
    return u.agg(*[F.max(c).alias(c) for c in u.columns])


def iou_pairs(gt: DataFrame, pred: DataFrame, keys: Sequence[str], min_iou: float, bucket_us: int) -> DataFrame:
    """Pairs of ground truth (``gt_id``) and prediction (``pred_id``) with tIoU of at least ``min_iou``."""
    g = gt.select(*keys, "gt_id", F.col("start_us").alias("g0"), F.col("end_us").alias("g1"))
    p = pred.select(*keys, "pred_id", F.col("start_us").alias("p0"), F.col("end_us").alias("p1"))
    j = overlap_join(g, p, keys, ("g0", "g1"), ("p0", "p1"), bucket_us)
    j = j.withColumn("iou", tiou(F.col("g0").cast("double"), F.col("g1").cast("double"), F.col("p0").cast("double"), F.col("p1").cast("double")))
    return j.filter(F.col("iou") >= min_iou)


def match_segments(gt: DataFrame, pred: DataFrame, keys: Sequence[str], min_iou: float = TIOU_THRESHOLDS[0], bucket_us: int = DAY_US) -> DataFrame:
    """Greedy one-to-one matches by descending (tIoU, gt_id, pred_id). The matches of a higher threshold are
    those of ``min_iou`` that reach it.
    """
    e = iou_pairs(gt, pred, keys, min_iou, bucket_us)
    e = e.select(*keys, (-F.col("iou")).alias("r1"), (-F.col("gt_id")).alias("r2"), (-F.col("pred_id")).alias("r3"), "gt_id", "pred_id", "iou")
    return match_one_to_one(e, keys, "gt_id", "pred_id", ["r1", "r2", "r3"]).select(*keys, "gt_id", "pred_id", "iou")


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; each is 0 where its denominator is 0."""
    z = F.lit(0.0)
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(z)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(z)
    return p, r, F.when(2 * tp + fp + fn > 0, 2.0 * tp / (2 * tp + fp + fn)).otherwise(z)


def count_outcomes(gt: DataFrame, pred: DataFrame, matches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Pooled tp, fp, fn per threshold and ``by`` columns, over the videos of the ground truth."""
    taus = F.explode(F.array(*[F.lit(t) for t in TIOU_THRESHOLDS])).alias("tau")
    n_gt = gt.groupBy(*by).agg(F.count(F.lit(1)).alias("n_gt"))
    n_pr = pred.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pred"))
    tp = matches.select(*by, "iou", taus).filter("iou >= tau").groupBy(*by, "tau").agg(F.count(F.lit(1)).alias("tp"))
    base = n_gt.join(n_pr, list(by), "full") if by else one_row(n_gt, n_pr)
    base = base.select(*by, F.coalesce("n_gt", F.lit(0)).alias("n_gt"), F.coalesce("n_pred", F.lit(0)).alias("n_pred"), taus)
    out = base.join(tp, [*by, "tau"], "left").withColumn("tp", F.coalesce("tp", F.lit(0)))
    out = out.withColumn("fp", F.col("n_pred") - F.col("tp")).withColumn("fn", F.col("n_gt") - F.col("tp"))
    p, r, f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return out.select(*by, "tau", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def per_class_f1(gt: DataFrame, pred: DataFrame, bucket_us: int = DAY_US) -> DataFrame:
    """F1 per (label, tau). Inputs: ``video_id, label, start_us, end_us`` and ``gt_id`` / ``pred_id``."""
    m = match_segments(gt, pred, ["video_id", "label"], bucket_us=bucket_us)
    return count_outcomes(gt, pred, m, ["label"])


def class_agnostic_f1(gt: DataFrame, pred: DataFrame, bucket_us: int = DAY_US) -> DataFrame:
    m = match_segments(gt, pred, ["video_id"], bucket_us=bucket_us)
    return count_outcomes(gt, pred, m, [])


def score_a(per_class: DataFrame) -> DataFrame:
    """Mean over classes of the mean F1 over thresholds, with the pooled counts per threshold beside it."""
    return per_class.groupBy("label").agg(F.avg("f1").alias("f1_mean")).agg(F.avg("f1_mean").alias("score_a"), F.count(F.lit(1)).alias("n_classes"))


def micro(per_class: DataFrame) -> DataFrame:
    g = per_class.groupBy("tau").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    p, r, f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return g.select("tau", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def boundary_offsets(gt: DataFrame, pred: DataFrame, bucket_us: int = DAY_US, min_iou: float = TIOU_THRESHOLDS[0]) -> DataFrame:
    """Start and end offset (s) of the best prediction of each ground-truth event."""
    e = iou_pairs(gt, pred, ["video_id", "label"], min_iou, bucket_us)
    best = e.groupBy("video_id", "label", "gt_id").agg(F.max_by(F.struct("g0", "g1", "p0", "p1"), F.struct(F.col("iou"), -F.col("pred_id"))).alias("b"))
    return best.select("video_id", "label", "gt_id", ((F.col("b.g0") - F.col("b.p0")) / 1e6).alias("d_start"), ((F.col("b.g1") - F.col("b.p1")) / 1e6).alias("d_end"))


def label_frames(frames: DataFrame, accidents: DataFrame, near: DataFrame, keys: Sequence[str], t_us: str, frame_id: str, bucket_us: int = DAY_US, fit: bool = False) -> DataFrame:
    """Add ``y``: 1 in the 5 s before an accident, null (ignored) inside one or around a near miss, else 0.

    The metric ignores in-accident rows first. ``fit=True`` gives the training labels instead, where a row
    before an accident stays positive even when another interval would ignore it.
    """
    pos = F.lit(POSITIVE_US)
    a = accidents.select(*keys, (F.col("start_us") - pos).alias("__w0"), F.col("end_us").alias("__w1"), F.col("start_us").alias("__s"), F.lit(1).alias("__kind"))
    n = near.select(*keys, (F.col("start_us") - pos).alias("__w0"), F.col("end_us").alias("__w1"), F.col("start_us").alias("__s"), F.lit(0).alias("__kind"))
    ev = a.unionByName(n)
    hits = overlap_join(frames.select(*keys, t_us, frame_id), ev, keys, (t_us, t_us), ("__w0", "__w1"), bucket_us)
    acc = F.col("__kind") == 1
    flags = hits.groupBy(*keys, frame_id).agg(
        F.max(acc & (F.col(t_us) >= F.col("__s"))).alias("__in"),
        F.max(acc & (F.col(t_us) < F.col("__s"))).alias("__pre"),
        F.max(~acc).alias("__nm"),
    )
    d = frames.join(flags, [*keys, frame_id], "left")
    if fit:
        y = F.when(F.col("__pre"), 1).when(F.col("__in") | F.col("__nm"), None).otherwise(0)
    else:
        y = F.when(F.col("__in"), None).when(F.col("__pre"), 1).when(F.col("__nm"), None).otherwise(0)
    return d.select(*[F.col(c) for c in frames.columns], y.alias("y"))


def average_precision(df: DataFrame, score: str, label: str, width: float) -> DataFrame:
    """One row: ``ap_raw``, ``pos_rate``, ``ap`` (normalised by chance), ``n``.

    Rows are counted per distinct score, the counts are ranked in score buckets of ``width``, so no
    single task sorts all the scores.
    """
    c = df.groupBy((-F.col(score)).alias("neg")).agg(F.sum(label).alias("p"), F.count(F.lit(1)).alias("k"))
    c = c.withColumn("b", F.floor(F.col("neg") / F.lit(float(width))).cast("bigint"))
    c = ordered_scan(c, [], "b", ["neg"], [Scan("sum", "p", "cp"), Scan("sum", "k", "ck")])
    t = c.agg(
        F.sum("p").alias("np"), F.sum("k").alias("n"), F.sum(F.when(F.col("p") > 0, F.col("p") * F.col("cp") / F.col("ck"))).alias("area")
    )
    raw = F.when(F.col("np") > 0, F.col("area") / F.col("np")).otherwise(F.lit(0.0))
    rate = F.when(F.col("n") > 0, F.col("np") / F.col("n")).otherwise(F.lit(0.0))
    t = t.select(raw.alias("ap_raw"), rate.alias("pos_rate"), F.coalesce("n", F.lit(0)).alias("n"))
    norm = F.when(F.col("pos_rate") < 1, F.greatest(F.lit(0.0), (F.col("ap_raw") - F.col("pos_rate")) / (1 - F.col("pos_rate")))).otherwise(F.lit(0.0))
    return t.withColumn("ap", norm)


def alarm_starts(curve: DataFrame, keys: Sequence[str], t_us: str, score: str, ties: Sequence[str] = (), theta: float = ALARM_THRESHOLD, gap_us: int = ALARM_MERGE_US, chunk_us: int = DAY_US) -> DataFrame:
    """Runs of ``score >= theta`` over consecutive samples, joined when the gap is below ``gap_us``."""
    d = curve.withColumn("__hot", F.col(score) >= F.lit(theta))
    r = runs(d, keys, t_us, "__hot", chunk_us=chunk_us, ties=ties)
    return merge_intervals(r, keys, "start_us", "end_us", gap_us, strict=True, chunk_us=chunk_us).select(*keys, F.col("start_us").alias("alarm_us"), F.col("end_us").alias("alarm_end_us"))


def assign_alarms(alarms: DataFrame, accidents: DataFrame, keys: Sequence[str], bucket_us: int = DAY_US) -> DataFrame:
    """Accidents in time order each take the earliest free alarm in the 10 s before them."""
    a = alarms.select(*keys, "alarm_us")
    x = accidents.select(*keys, F.col("gt_id"), F.col("start_us").alias("__s"), (F.col("start_us") - F.lit(ALARM_WINDOW_US)).alias("__lo"), (F.col("start_us") - 1).alias("__hi"), F.col("end_us").alias("__e"))
    e = overlap_join(a, x, keys, ("alarm_us", "alarm_us"), ("__lo", "__hi"), bucket_us)
    m = match_one_to_one(e.select(*keys, F.col("__s").alias("r1"), F.col("__e").alias("r2"), F.col("gt_id").alias("r3"), F.col("alarm_us").alias("r4"), "gt_id", "alarm_us"), keys, "gt_id", "alarm_us", ["r1", "r2", "r3", "r4"])
    return m.select(*keys, "gt_id", "alarm_us", ((F.col("r1") - F.col("alarm_us")) / 1e6).alias("tta"))


def score_b(curve: DataFrame, gt: DataFrame, keys: Sequence[str], t_us: str, score: str, frame_id: str, width: float = 1e-3, bucket_us: int = DAY_US, chunk_us: int = DAY_US) -> DataFrame:
    """One row with the parts of the risk score. ``gt`` holds ``keys, label, start_us, end_us, gt_id``."""
    acc, near = gt.filter("label = 'accident'"), gt.filter("label = 'near_miss'")
    y = label_frames(curve, acc, near, keys, t_us, frame_id, bucket_us).filter("y IS NOT NULL")
    ap = average_precision(y, score, "y", width)
    al = alarm_starts(curve, keys, t_us, score, [frame_id], chunk_us=chunk_us).withColumn("__aid", F.col("alarm_us"))
    al = label_frames(al, acc, near, keys, "alarm_us", "__aid", bucket_us).filter("y IS NOT NULL").select(*keys, "alarm_us")
    m = assign_alarms(al, acc, keys, bucket_us)
    one = one_row(
        ap,
        al.agg(F.count(F.lit(1)).alias("n_alarms")),
        acc.agg(F.count(F.lit(1)).alias("n_accidents")),
        m.agg(F.count(F.lit(1)).alias("n_matched"), F.coalesce(F.sum("tta"), F.lit(0.0)).alias("tta_sum")),
    )
    z = F.lit(0.0)
    p = F.when(F.col("n_alarms") > 0, F.col("n_matched") / F.col("n_alarms")).otherwise(z)
    r = F.when(F.col("n_accidents") > 0, F.col("n_matched") / F.col("n_accidents")).otherwise(z)
    one = one.withColumn("alarm_precision", p).withColumn("alarm_recall", r)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(z)
    mtta = F.when(F.col("n_accidents") > 0, F.col("tta_sum") / F.col("n_accidents")).otherwise(z)
    one = one.withColumn("f1_alarm", f1).withColumn("mtta", mtta)
    b = F.lit(WEIGHT_AP) * F.col("ap") + F.lit(WEIGHT_F1) * F.col("f1_alarm") + F.lit(WEIGHT_TTA) * F.least(F.lit(1.0), F.col("mtta") / (ALARM_WINDOW_US / 1e6))
    return one.withColumn("score_b", b).drop("tta_sum")


def model_score(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: 0.7 A + 0.3 B, or A alone where the ground truth has no accident."""
    j = one_row(a.select("score_a"), b.select("score_b", "n_accidents"))
    s = F.when(F.col("n_accidents") > 0, WEIGHT_A * F.col("score_a") + WEIGHT_B * F.col("score_b")).otherwise(F.col("score_a"))
    return j.select("score_a", "score_b", s.alias("model_score"))


def risk_summary(curve: DataFrame, accidents: DataFrame, keys: Sequence[str], t_us: str, score: str, bucket_us: int = DAY_US) -> DataFrame:
    """Per key: the highest score, the highest score in the 5 s before an accident, and whether a key without
    accidents raises a false alarm.
    """
    top = curve.groupBy(*keys).agg(F.max(score).alias("max_score"))
    x = accidents.select(*keys, (F.col("start_us") - POSITIVE_US).alias("__lo"), (F.col("start_us") - 1).alias("__hi"))
    pre = overlap_join(curve.select(*keys, t_us, score), x, keys, (t_us, t_us), ("__lo", "__hi"), bucket_us)
    pre = pre.groupBy(*keys).agg(F.max(score).alias("pre_max"))
    n = accidents.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_acc"))
    d = top.join(pre, list(keys), "left").join(n, list(keys), "left")
    return d.select(*keys, "max_score", F.coalesce("pre_max", F.lit(0.0)).alias("pre_max"), (F.col("n_acc").isNull() & (F.col("max_score") >= ALARM_THRESHOLD)).alias("false_alarm"))
