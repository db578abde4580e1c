"""Tables that grow are told to the planner in their real size, and their rows are dealt over tasks."""
import pytest
from pyspark.sql import functions as F

from curbstream.operators import metrics
from curbstream.plans import tuning
from curbstream.plans.params import FEATURES, RISK_WEIGHTS
from curbstream.session import stage
from curbstream.sources import fixture as fx

SF = "/root/testdata/sf0.001"


def estimate(df) -> int:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


@pytest.mark.parametrize("make", [fx.tracks_raw, fx.frames, fx.signal_samples])
def test_fixture_rows_are_not_taken_for_few(spark, make):
    d = make(spark, SF)
    assert estimate(d) >= 8 * d.count()
    assert d.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_staged_tables_count_unpacked(spark):
    d = stage(spark.range(0, 300_000, 1, 2).select((F.col("id") % 100).alias("a"), F.lit(7).cast("bigint").alias("b")), "sizes")
    assert estimate(d) >= 200_000  # its file has a tenth of that


def test_bias_steps_are_not_taken_for_few(spark, monkeypatch):
    seen = []

    def stop(d, *_):
        seen.append(d)
        raise InterruptedError

    monkeypatch.setattr(metrics, "alarm_starts", stop)
    feats = spark.range(0, 1000, 1, 2).select(F.lit("u").alias("user_id"), F.col("id").alias("t_us"), F.col("id").alias("frame"), *[F.lit(0.5).alias(f) for f in FEATURES])
    gt = feats.select("user_id", F.lit("accident").alias("label"))
    with pytest.raises(InterruptedError):
        tuning.bias_sweep(feats, gt, RISK_WEIGHTS, "user_id", "t_us", "frame")
    assert seen[0].count() == 61_000
    assert estimate(seen[0]) >= 8 * 61_000


def test_copies_of_segments_are_dealt_over_tasks(spark, monkeypatch):
    from curbstream.operators import intervals, post

    seen, scan = [], intervals.ordered_scan

    def look(df, *rest):
        seen.append(df)
        return scan(df, *rest)

    monkeypatch.setattr(intervals, "ordered_scan", look)
    seg = spark.range(0, 400, 1, 1).select((F.col("id") % 20).alias("video_id"), F.lit("accident").alias("label"), (F.col("id") * 10).alias("start_us"), (F.col("id") * 10 + 5).alias("end_us"), F.lit(0.9).alias("confidence"))
    grid = tuning.post_grid(spark, {"accident": {}}, {"accident": {"merge_gap": [0.0, 1.0]}})
    post.postprocess_each(seg, seg.select("video_id").distinct().withColumn("duration", F.lit(9.0)), grid)
    assert seen[0].where("param_id = 0").select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_tracks_are_smoothed_in_batches_and_not_one_by_one(spark):
    """Blocks cut by batches and blocks of copies only, which failed before, give the rows of one block a track."""
    from curbstream.operators import tracks

    raw, frames, videos = (f(spark, SF).filter("video_id = 0") for f in (fx.tracks_raw, fx.frames, fx.videos))
    whole = tracks.build_tracks(raw, frames, videos)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    cut = tracks.build_tracks(raw, frames, videos, block_rows=16)
    rounded = lambda d: {tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in d.select("track_id", "frame", *tracks.MOTION).collect()}
    try:
        assert rounded(cut) == rounded(whole) and whole.count() > 1000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_learned_cells_are_not_broadcast(spark):
    """They compress to a few bytes a cell, so that the planner took the cells of many videos for a small table."""
    from curbstream.operators import scene as sc

    cells = stage(spark.range(0, 200_000, 1, 1).select((F.col("id") / 400).cast("bigint").alias("video_id"), (F.col("id") % 36).cast("int").alias("iy"), (F.col("id") % 64).cast("int").alias("ix"), F.lit(True).alias("road"), F.lit(1.0).alias("depth_cells"), F.lit(False).alias("queue"), F.lit(False).alias("crosswalk")), "cells")
    none = F.expr("CAST(array() AS ARRAY<STRUCT<pts: ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>>>)")
    drawn = spark.range(0, 500).select(F.col("id").alias("video_id"), *[none.alias(k) for k in ("carriageway", "non_road", "crosswalks", "queue_zones")])
    rows = spark.range(0, 100_000).select((F.col("id") % 500).alias("video_id"), (F.col("id") % 1280).cast("double").alias("foot_x"), (F.col("id") % 720).cast("double").alias("foot_y"), F.lit(1280).alias("width"), F.lit(720).alias("height"))
    plan = sc.locate(rows, drawn, cells)._jdf.queryExecution().sparkPlan().toString()
    found = [x for x in plan.split("\n") if "Join" in x and "iy#" in x]
    assert found and all("SortMergeJoin" in x for x in found), plan


def test_pictures_are_not_taken_for_few(spark):
    """Exploded cells were taken for the few suppliers they come from, and what is worked out from them was broadcast."""
    from curbstream.queries import picture_queries as pq

    for d in (pq.pictures(spark, SF), pq.inputs(spark, SF).tracks):
        assert estimate(d) >= 8 * d.count()
        assert d.select(F.spark_partition_id().alias("p")).distinct().count() > 1
