"""Stream and batch scores agree, late frames go to the side table, the last two stages look back only, a threat raises the risk."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from worlds import HEIGHT, ROAD, WIDTH, Mover, World, arc, base_tables

from curbstream.operators.metrics import alarm_starts
from curbstream.plans import risk
from curbstream.streaming import risk as live


def quantities(video: int, n: int, step_us: int) -> pd.DataFrame:
    g = np.random.default_rng(video + 40)
    t = np.arange(n) * step_us
    near = np.where(g.random(n) < 0.3, g.gamma(2.0, 0.6, n), np.nan)
    return pd.DataFrame({"video_id": video, "frame": np.arange(n), "t_us": t, "ttc": near, "ped_ttc": np.nan, "decel": g.exponential(0.8, n), "swerve": g.exponential(20.0, n), "wrong": (g.random(n) < 0.05) * 1.0, "redrun": (g.random(n) < 0.03) * 1.0, "n_veh": g.integers(0, 30, n) * 1.0, "ped": (g.random(n) < 0.08) * 1.0})


@pytest.fixture(scope="module")
def frames():
    return pd.concat([quantities(v, 70 + 15 * v, 100_000 + 20_000 * v) for v in range(3)], ignore_index=True)


def to_spark(spark, d):
    rows = [tuple(None if isinstance(x, float) and np.isnan(x) else x for x in r) for r in d.astype(object).itertuples(index=False)]
    return spark.createDataFrame(rows, live.RAW_SCHEMA)


def play(spark, folder, parts, transform, schema, name):
    """Writes the parts as files and reads them as a stream, one file at a time."""
    for i, p in enumerate(parts):
        p.coalesce(1).write.mode("append").parquet(str(folder / "in"))
        import time

        time.sleep(1.1 if i + 1 < len(parts) else 0)  # files are read in the order of their times
    q = transform(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))).writeStream.format("memory").queryName(name)
    q.outputMode("append").option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).collect()


def test_stream_like_batch_and_late_frames_aside(spark, frames, tmp_path):
    raw = to_spark(spark, frames)
    want = {(r.video_id, r.frame): r.score for r in risk.combine(risk.features(raw)).collect()}
    parts = [raw.filter("frame < 31"), raw.filter("frame >= 31 AND frame < 60"), raw.filter("frame >= 60 OR frame = 12")]
    rows = play(spark, tmp_path, parts, live.score_stream, live.RAW_SCHEMA, "scored")
    got = {(r.video_id, r.frame): r.score for r in rows if not r.late}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9
    assert sorted((r.video_id, r.frame, r.score) for r in rows if r.late) == [(v, 12, None) for v in range(3)]


def test_scores_look_back_only(spark, frames):
    score = lambda d: {(r.video_id, r.frame): r.score for r in risk.combine(risk.features(to_spark(spark, d))).collect()}
    whole, first = score(frames), score(frames[frames["frame"] < 40])
    assert len(first) == 120 and all(whole[k] == pytest.approx(s, abs=1e-12) for k, s in first.items())


def test_alarms_like_batch(spark, frames, tmp_path):
    g = np.random.default_rng(3)
    scores = spark.createDataFrame(frames[["video_id", "frame", "t_us"]].assign(score=np.where(g.random(len(frames)) < 0.25, 0.8, 0.2)), live.SCORE_SCHEMA)
    want = {(r.video_id, r.alarm_us) for r in alarm_starts(scores, ["video_id"], "t_us", "score").collect()}
    rows = play(spark, tmp_path, [scores.filter("frame < 40"), scores.filter("frame >= 40")], live.alarm_stream, live.SCORE_SCHEMA, "rung")
    assert {(r.video_id, r.alarm_us) for r in rows} == want and len(want) > 3


THREAT = World([Mover((1500, 600), [(4.2, -240, 0), (0.5, -120, 0), (5, 0, 0)]), Mover((330, 600), [(9.7, -9, 0)])], 10, 12.5)
FREE = World([Mover((1500, 520), [(9.5, -140, 0)]), Mover((1450, 700), [(9.5, -130, 0)])], 10, 12.5)
#: Cars that stop and go over drawn shapes, people, a red light, a car against the lane, a car that comes back too late to be itself.
BUSY = World(
    [Mover((1500, 500 + 45 * i), [(3, -180 - 15 * i, 0), (4, 0, 0), (5, -90, 5)], begin=0.4 * i) for i in range(6)]
    + [Mover((420, 780), arc(190, 1, 1, 3.5), begin=4), Mover((1500, 820), [(6, -250, 0)], begin=5), Mover((560, 840), [(5, 0, -12)], 0, 4), Mover((300, 620), [(11, 130, 0)], begin=1), Mover((1200, 380), [(8, -120, 0)], begin=3), Mover((900, 360), [(9, 2, 40)], 0, 2), Mover((700, 700), [(9, -20, -25)], 0, 1.5), Mover((1500, 640), [(2.5, -250, 0)], begin=9)],
    12, 25.0, {"lanes": [{"id": "w", "polygon": [[0, 340], [1600, 340], [1600, 860], [0, 860]], "direction": [-1, 0]}], "stop_lines": [{"id": "A", "points": [[900, 340], [900, 860]], "signal": "g", "approach": [-1, 0]}], "crosswalks": [[[640, 340], [740, 340], [740, 860], [640, 860]]]},
    [("g", 0, 5, "red"), ("g", 5, 7, "unknown"), ("g", 7, 9, "green"), ("g", 9, 12, "red")],
)
#: The same traffic for long enough that cells, flow and scale are learned; nothing is drawn.
LEARNED = World([Mover((1500, 480 + 30 * (i % 9)), [(6, -220, 0), (4 if i % 3 else 0, 0, 0), (2, -200, 0)], begin=1.3 * i) for i in range(26)] + [Mover((100, 560), [(9, 150, 0)], begin=24), Mover((700, 420), [(12, 0, 15)], 0, 20)], 40, 12.5)


def risk_inputs(spark, worlds):
    """Raw tracks, clock, videos, scene (drawn shapes only where a world has some) and signal samples."""
    from functools import reduce

    from curbstream.operators import scene as sc
    from curbstream.session import stage
    from curbstream.sources.documents import scene_shapes, shapes_for_videos

    raw, clock, videos = base_tables(spark, worlds)
    drawn = []
    for v, w in enumerate(worlds):
        shapes, moves, right = scene_shapes(spark, {"normalized": False, "image_size": [WIDTH, HEIGHT], "carriageway": [ROAD], **w.scene} if w.scene else {})
        one = videos.filter(f"video_id = {v}")
        drawn.append(sc.scene_rows(shapes_for_videos(shapes, one), one, moves, right))
    scene = stage(reduce(lambda a, b: a.unionByName(b), drawn), "scene")
    lights = [(v, k, f, round(f / w.fps * 1e6), s) for v, w in enumerate(worlds) for k, a, b, s in w.lights for f in range(int(w.seconds * w.fps)) if a <= f / w.fps < b]
    samples = spark.createDataFrame([(v, k, t, s) for v, k, _, t, s in lights], "video_id long, signal_id string, t_us long, state string")
    return stage(raw, "raw"), stage(clock, "clock"), stage(videos, "videos"), scene, stage(samples, "samples")


def measured(d):
    names = [c.split()[0] for c in live.RAW_SCHEMA.split(", ")][3:]
    return {(r.video_id, r.frame): tuple(r[c] for c in names) for r in d.collect()}


def same(a, b):
    assert a.keys() == b.keys()
    off = [(k, a[k], b[k]) for k in sorted(a) if any((x is None) != (y is None) or (x is not None and abs(x - y) > 1e-6 * max(1, abs(x))) for x, y in zip(a[k], b[k], strict=True))]
    assert not off, off[:3]


@pytest.fixture(scope="module")
def traffic(spark):
    return risk_inputs(spark, [THREAT, FREE, BUSY, LEARNED])


@pytest.fixture(scope="module")
def batch(spark, traffic):
    from curbstream.session import stage

    return stage(risk.measure(*traffic), "measured")


def test_threat_against_free_flow(batch):
    top = {r[0]: r[1] for r in risk.combine(risk.features(batch)).groupBy("video_id").agg(F.max("score")).collect()}
    assert top[0] > 0.5 > 0.3 > top[1], top


def test_quantities_look_back_only(spark, traffic, batch):
    """Raw tracks cut off in the middle give the same values up to there, for every quantity, and each quantity occurs."""
    raw, clock, videos, scene, samples = traffic
    cut = "t_us < 17000000 AND (video_id = 3 OR t_us < 6000000)"
    first = measured(risk.measure(raw.filter(cut), clock.filter(cut), videos, scene, samples.filter(cut)))
    whole = measured(batch)
    assert len(first) > 200 and max(k[1] for k in first) < max(k[1] for k in whole)
    same(first, {k: v for k, v in whole.items() if k in first})
    seen = [sum(bool(v[i]) for v in whole.values()) for i in range(8)]
    assert all(seen), list(zip(live.RAW_SCHEMA.split(", ")[3:], seen))


def track_stream(traffic):
    """Rows of all videos with a tick a frame, the last one closing its video."""
    from curbstream.streaming import live as lv

    raw, clock, _, _, samples = traffic
    heads = samples.groupBy("video_id", "t_us").agg(F.map_from_entries(F.collect_list(F.struct("signal_id", "state"))).alias("signals"))
    end = clock.groupBy("video_id").agg(F.max("frame").alias("__end"))
    ticks = clock.join(heads, ["video_id", "t_us"], "left").join(end, "video_id")
    ticks = ticks.select("video_id", "frame", "t_us", "signals", (F.col("frame") >= F.col("__end") - 2).alias("last"))
    rows = raw.drop("t").withColumn("last", F.lit(False)).unionByName(ticks, allowMissingColumns=True)
    return rows.select([c.split()[0] for c in lv.TRACK_SCHEMA.split(", ")]).withColumn("cls", F.col("cls").cast("int"))


def test_stream_from_tracks_like_batch(spark, traffic, batch, tmp_path):
    """Frames that arrive shuffled within the delay give the batch's quantities; a late row changes nothing; an ended video leaves no state."""
    from curbstream.streaming import live as lv

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", lv.STATE_STORE)
    rows = track_stream(traffic)
    _, _, videos, scene, _ = traffic
    # A part takes in rows of the next half second now and then: within the delay of a second.
    slot = F.floor((F.col("t_us") + F.when(~F.col("last"), F.pmod(F.xxhash64("frame"), F.lit(500_000))).otherwise(0)) / 4_500_000)
    parts = [rows.filter(slot == i) for i in range(9)]
    parts[2] = parts[2].unionByName(rows.filter("video_id = 3 AND track_id = 1 AND frame = 10"))
    whole = []
    play_with = lambda s: lv.motion_stream(s, videos, 1_000_000)
    got = play(spark, tmp_path / "a", parts, lambda s: lv.quantity_stream(play_with(s), scene), lv.TRACK_SCHEMA, "quantities")
    whole = measured(spark.createDataFrame(got, live.RAW_SCHEMA))
    same(whole, measured(batch))
    late = play(spark, tmp_path / "b", parts, lambda s: lv.late_rows(play_with(s)), lv.TRACK_SCHEMA, "late_rows")
    assert [(r.video_id, r.track_id, r.frame) for r in late] == [(3, 1, 10)]
    for i in (0, 1):
        left = spark.read.format("statestore").option("operatorId", i).option("stateVarName", "tracks").load(str(tmp_path / "a" / "cp"))
        assert left.count() == 0


def test_estimator_of_a_user(spark, frames, tmp_path):
    from curbstream.streaming import live as lv

    class Toy:
        """Counts the rows it was given and adds a quantity up. Tasks cannot import this module, so the class is sent to them."""

        def reset(self, meta):
            self.n, self.total = 0, float(meta["video_id"])

        def step(self, row):
            self.n, self.total = self.n + 1, self.total + row["decel"]
            return self.total / self.n

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", lv.STATE_STORE)
    raw = to_spark(spark, frames)
    got = play(spark, tmp_path, [raw.filter("frame < 31"), raw.filter("frame >= 31")], lambda s: lv.estimate(s, Toy), live.RAW_SCHEMA, "toy")
    want = {}
    for v, d in frames.groupby("video_id"):
        want |= {(v, f): (v + s) / (i + 1) for i, (f, s) in enumerate(zip(d["frame"], d["decel"].cumsum(), strict=True))}
    assert {(r.video_id, r.frame): r.score for r in got} == pytest.approx(want)
