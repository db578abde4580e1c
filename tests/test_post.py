"""Final events never overlap within a class and stay inside the video; suppression and documents."""
import json

import numpy as np
from pyspark.sql import functions as F

from curbstream.operators import metrics, post
from curbstream.plans.params import CLASSES, EVENTS, class_params, overlay
from curbstream.sources import documents

SEG = "video_id long, label string, start_us long, end_us long, confidence double, tracks array<long>"


def test_clean_segments_stay_apart_and_inside(spark):
    """Dense, reversed, negative and overlong segments of one clip per class; every class has settings of its own."""
    g = np.random.default_rng(77)
    cfg = {c: {"merge_gap": round(0.4 * (i % 6), 1), "min_len": round(0.25 * (i % 5), 2), "start_offset": 0.2 * (i % 3) - 0.2, "end_offset": 0.3 - 0.3 * (i % 3), "min_confidence": 0.25} for i, c in enumerate(CLASSES)}
    length = {v: 5.0 + 11.0 * v for v in range(12)}
    rows = []
    for v, n in length.items():
        for c in CLASSES:
            at = g.normal(n / 2, n / 2, 9)
            rows += [(v, c, int(s * 1e6), int((s + d) * 1e6), float(q), []) for s, d, q in zip(at, g.exponential(n / 6, 9) - 0.5, g.random(9), strict=True)]
    clips = spark.createDataFrame(list(length.items()), "video_id long, duration double")
    out = post.postprocess(spark.createDataFrame(rows, SEG), clips, cfg)
    groups = {}
    for r in out.collect():
        groups.setdefault((r.video_id, r.label), []).append((r.start, r.end))
    assert len(groups) > 100
    for (v, _), spans in groups.items():
        spans.sort()
        flat = [x for s in spans for x in s]
        assert flat == sorted(flat) and flat[0] >= 0 and flat[-1] <= length[v] and all(s < e for s, e in spans)
        assert all(x == round(x, 2) for x in flat)
    assert post.validate_segments(out.withColumn("id", F.monotonically_increasing_id()), clips, "id").count() == 0


def test_touching_segments_merge_and_weak_ones_drop(spark):
    d = spark.createDataFrame([(0, 10.0)], "video_id long, duration double")
    s = spark.createDataFrame([(0, "jaywalking", 1_000_000, 3_000_000, 1.0, []), (0, "jaywalking", 3_000_000, 5_000_000, 1.0, []), (0, "accident", 1_000_000, 3_000_000, 0.2, [])], SEG)
    got = post.postprocess(s, d, {"jaywalking": {"merge_gap": 0, "min_len": 0}, "accident": {"min_confidence": 0.6}}).collect()
    assert [(r.label, r.start, r.end) for r in got] == [("jaywalking", 1.0, 5.0)]


def test_near_miss_of_a_crash_is_suppressed(spark):
    m = 1_000_000
    s = spark.createDataFrame(
        [(0, "accident", 3 * m, 5 * m, 0.8, [1, 2]), (0, "near_miss", 2 * m, 3 * m, 0.8, [2, 1]), (0, "near_miss", 20 * m, 21 * m, 0.8, [2, 1]), (0, "near_miss", 3 * m, 4 * m, 0.8, [7, 8])], SEG
    )
    got = sorted((r.label, r.start_us // m) for r in post.suppress_near_misses(s, EVENTS).collect())
    assert got == [("accident", 3), ("near_miss", 3), ("near_miss", 20)]


def test_perfect_prediction_scores_one(spark):
    rows = [(0, "accident", 5_000_000, 8_000_000, 1), (0, "red_light", 1_000_000, 2_000_000, 2), (1, "accident", 1_000_000, 9_000_000, 3)]
    gt = spark.createDataFrame(rows, "video_id long, label string, start_us long, end_us long, gt_id long")
    pr = gt.withColumnRenamed("gt_id", "pred_id")
    assert abs(metrics.score_a(metrics.per_class_f1(gt, pr)).first().score_a - 1.0) < 1e-12
    extra = pr.union(spark.createDataFrame([(0, "congestion", 0, 1_000_000, 9), (0, "stop_line", 0, 1_000_000, 10)], pr.schema))
    assert abs(metrics.score_a(metrics.per_class_f1(gt, extra)).first().score_a - 0.5) < 1e-12


def test_settings():
    assert overlay({"a": {"b": 1, "c": [1]}}, {"a": {"c": [2]}}) == {"a": {"b": 1, "c": [2]}}
    assert class_params({"x": {"min_len": 3, "post": {"min_len": 4}}}, "x")["min_len"] == 4.0


def test_label_documents(spark, tmp_path):
    doc = {"team": "t", "videos": {"a.mp4": {"duration": 12.5, "fps": 25.0, "events": [[1.0, 2.5, "accident"], ["x", 3, "stop_line"]], "risk": [[0.0, 0.1], [0.04, 0.2]]}, "b.mp4": {"duration": 3.0}}}
    p = tmp_path / "p.json"
    p.write_text(json.dumps(doc))
    d = documents.read_labels(spark, str(p))
    assert [r.video for r in d.collect()] == ["a.mp4"]
    ev = [(r.start_us, r.end_us, r.label) for r in documents.label_events(d).orderBy("pos").collect()]
    assert ev == [(1_000_000, 2_500_000, "accident"), (None, 3_000_000, "stop_line")]
    assert [(r.t_us, r.score) for r in documents.label_curve(d).orderBy("pos").collect()] == [(0, 0.1), (40_000, 0.2)]


def test_bad_alignment_drops_the_drawn_scene(spark):
    from curbstream.operators.scene import aligned_shapes

    sh = spark.createDataFrame([("lanes", 0, "L", [(0.1, 0.2), (0.5, 0.2), (0.5, 0.6)], None, (1.0, 0.0))], "kind string, ord int, id string, pts array<struct<x:double,y:double>>, signal string, dir struct<x:double,y:double>")
    sh = sh.withColumn("video_id", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])))
    eye, flip = [1.0, 0, 0.1, 0, 1, 0, 0, 0, 1], [0.1, 0, 0, 0, 0.1, 0, 0, 0, 1.0]
    al = spark.createDataFrame([(1, [float(v) for v in eye], 80), (2, [float(v) for v in flip], 80), (3, [float(v) for v in eye], 10)], "video_id int, h array<double>, inliers int")
    got = aligned_shapes(sh, al).collect()
    assert [r.video_id for r in got] == [1] and abs(got[0].pts[0].x - 0.2) < 1e-12 and got[0].dir.x > 0


def test_prediction_documents_read_back(spark, tmp_path):
    ev = spark.createDataFrame([(1, 1.0, 2.5, "accident"), (1, 0.25, 0.5, "stop_line"), (2, 3.0, 4.0, "red_light")], "video_id long, start double, end double, label string")
    rk = spark.createDataFrame([(1, 0.04, 0.2), (1, 0.0, 0.1), (3, 0.0, 0.5)], "video_id long, t double, score double")
    vids = spark.createDataFrame([(v, 5.0, 25.0) for v in (1, 2, 3, 4)], "video_id long, duration double, fps double")
    names = vids.selectExpr("video_id", "concat('clip \"', video_id, '\".mp4') as video")
    rows = documents.prediction_rows(ev, rk, vids)
    doc = {r.video_id: json.loads(r.json) for r in rows.collect()}
    assert doc[1] == {"duration": 5.0, "fps": 25.0, "events": [[0.25, 0.5, "stop_line"], [1.0, 2.5, "accident"]], "risk": [[0.0, 0.1], [0.04, 0.2]]}
    assert doc[4] == {"duration": 5.0, "fps": 25.0, "events": [], "risk": []}
    documents.write_predictions(rows, str(tmp_path / "out"), "own team", names)
    lines = [json.loads(x) for f in (tmp_path / "out").glob("part-*") for x in f.read_text().splitlines()]
    assert {d["team"] for d in lines} == {"own team"} and {k for d in lines for k in d["videos"]} == {f'clip "{v}".mp4' for v in (1, 2, 3, 4)}


def test_staging_needs_a_shared_folder(monkeypatch):
    import pytest

    from curbstream import session

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "yarn"}.get(key, default)

    with pytest.raises(ValueError, match="share"):
        session.staging_root(type("S", (), {"conf": Conf()})())


def test_best_values_and_offsets(spark):
    """A gate that drops the wrong half wins, offsets are kept where they help, a class that is mostly wrong goes off."""
    from curbstream.plans import tuning

    gt = [(v, "accident", 10_000_000 + k * 40_000_000, 20_000_000 + k * 40_000_000, v * 10 + k) for v in range(4) for k in range(3)] + [(0, "jaywalking", 0, 1_000_000, 99)]
    seg = [(v, lab, s - 4_000_000, e - 3_000_000, 0.9) for v, lab, s, e, _ in gt if lab == "accident"] + [(v, "accident", 25_000_000, 29_000_000, 0.6) for v in range(4)] + [(v, "jaywalking", 50_000_000, 60_000_000, 0.9) for v in range(3)]
    cols = "video_id bigint, label string, start_us bigint, end_us bigint, "
    g, s = spark.createDataFrame(gt, cols + "gt_id bigint"), spark.createDataFrame(seg, cols + "confidence double")
    durations = spark.createDataFrame([(v, 200.0) for v in range(4)], "video_id bigint, duration double")
    events = {k: {"min_confidence": 0.5, "merge_gap": 1.0, "min_len": 0.5} for k in ("accident", "jaywalking", "wrong_way")}
    grid = tuning.post_grid(spark, events, {"accident": {"min_confidence": [0.7, 0.95]}, "jaywalking": {"merge_gap": [0.0]}, "wrong_way": {"min_len": [9.0]}})
    best = {r.label: r for r in tuning.best_params(s, g, durations, grid).collect()}
    a, j, w = best["accident"], best["jaywalking"], best["wrong_way"]
    assert (a.param_id, a.min_confidence, a.moved, a.start_offset, a.end_offset, a.f1_after, a.precision, a.enabled) == (1, 0.7, True, 4.0, 3.0, 1.0, 1.0, True) and a.f1_before < 0.7
    assert (j.param_id, j.moved, j.n_pred, j.n_gt, j.enabled) == (0, False, 3, 1, False)
    assert (w.param_id, w.n_pred, w.n_gt, w.f1_after, w.enabled) == (0, 0, 0, 0.0, True)
