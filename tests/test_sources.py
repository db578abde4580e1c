"""Scenes per camera like the single-document way, track files and reports read back."""
import json
import random

from pyspark.sql import functions as F
from worlds import HEIGHT, ROAD, WIDTH, Mover, World, base_tables

from curbstream.operators import scene as sc
from curbstream.sources import documents, fixture, scenes, tracks

CAMERAS = {
    "north": fixture.scene_document() | {"right_turn_on_red": True, "fixed_objects": [[[0, 0], [5, 0], [5, 5]]]},
    "south": {"carriageway": [[[0, 0.2], [1, 0.2], [1, 0.9]], [[0, 0], [0.1, 0], [0.1, 0.1]]], "crosswalks": [[[0, 0], [1, 0], [1, 1]], {"polygon": [[0, 0], [0.5, 0], [0.5, 1]], "signal": "p"}], "stop_lines": [{"points": [[0, 0], [1, 1]]}]},
    "bare": {},
}


def plain(d):
    return sorted(((r.kind, r.ord, r.id, r.signal, [(round(p.x, 6), round(p.y, 6)) for p in r.pts], None if r.dir is None else (round(r.dir.x, 6), round(r.dir.y, 6))) for r in d.collect()), key=str)


def test_scene_of_each_camera(spark, tmp_path):
    for name, doc in CAMERAS.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "broken.json").write_text("no document")
    docs = scenes.read_scenes(spark, str(tmp_path))
    assert {r.camera for r in docs.collect()} == {*CAMERAS, "broken"}
    videos = spark.createDataFrame([(1, "north", 640, 360), (2, "south", 1000, 500), (3, "bare", 10, 10), (4, "broken", 10, 10), (5, "none", 10, 10), (6, "south", 200, 100)], "video_id bigint, camera string, width int, height int")
    shapes = scenes.shapes_of_cameras(scenes.camera_shapes(docs), videos)
    rows = {r.video_id: r for r in scenes.camera_scenes(docs, videos).collect()}
    assert set(rows) == {1, 2, 3, 4, 5, 6}
    for v, name in ((1, "north"), (2, "south"), (3, "bare"), (6, "south")):
        want, moves, right = documents.scene_shapes(spark, CAMERAS[name])
        one = videos.filter(f"video_id = {v}")
        assert plain(shapes.filter(f"video_id = {v}")) == plain(documents.shapes_for_videos(want, one))
        assert [(m.entry, m.exit) for m in rows[v].movements] == moves and rows[v].right_turn_on_red == right
        whole = sc.scene_rows(documents.shapes_for_videos(want, one), one, moves, right).first()
        assert rows[v].vehicle_signal == whole.vehicle_signal and [len(rows[v][k]) for k in sc.SHAPE_KINDS] == [len(whole[k]) for k in sc.SHAPE_KINDS]
    assert all(not rows[v][k] for v in (3, 4, 5) for k in sc.SHAPE_KINDS)


def test_track_files(spark, tmp_path):
    raw, _, _ = base_tables(spark, [World([Mover((1500, 600), [(4, -200, 0)])], 5, 10), World([Mover((1500, 600), [(4, -200, 0)])] * 3, 5, 10)])
    late = raw.drop("t").withColumns({"t_us": F.col("t_us") + 7_200_000_000, "frame": F.col("frame") + 72_000})
    rows = raw.drop("t").unionByName(late)
    tracks.write_tracks(rows, str(tmp_path / "t"))
    key = lambda d: sorted(tuple(r) for r in d.select(sorted(rows.columns)).collect())
    back = tracks.read_tracks(spark, str(tmp_path / "t"))
    assert key(back) == key(rows) and back.filter("abs(t - t_us / 1e6) > 1e-9").isEmpty()
    one = tracks.read_video(spark, str(tmp_path / "t"), 1)
    assert key(one) == key(rows.filter("video_id = 1")) and len(one.inputFiles()) <= 4
    s = tracks.stream_tracks(spark, str(tmp_path / "t" / "*" / "*"))
    q = s.writeStream.format("memory").queryName("track_files").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert key(spark.table("track_files")) == key(rows) and spark.table("track_files").filter("last IS NOT NULL").isEmpty()


def test_report(spark, tmp_path):
    documents.write_report(spark.createDataFrame([("a", 1.5), ("b", None)], "label string, f1 double"), str(tmp_path / "r"))
    lines = [json.loads(x) for f in (tmp_path / "r").glob("part-*") for x in f.read_text().splitlines()]
    assert sorted(lines, key=str) == [{"label": "a", "f1": 1.5}, {"label": "b", "f1": None}]


def test_things_on_the_road_like_a_plain_walk(spark):
    """Pictures at odd times, several videos, boxes of tracks beside them; against numpy on whole pictures."""
    import numpy as np

    from curbstream.plans import rules, thumbnails
    from curbstream.plans.params import EVENTS

    r, p, rows, boxes, want = random.Random(8), EVENTS["road_obstacle"] | {"blob_min_area_frac": 0.01}, [], [], []
    for v in range(6):
        n = 15 if v == 5 else 70
        at = np.cumsum([r.choice([900_000, 1_000_000, 1_100_000]) for _ in range(n)])
        pic = np.array([[[60 + (y * 3 + x * 5 + k) % 9 for x in range(16)] for y in range(9)] for k in range(n)])
        y, x, a, b = r.randrange(4, 6), r.randrange(2, 11), 25 + v, 45 + 3 * v
        pic[a:b, y : y + 3, x : x + 4] += 70
        pic[r.randrange(n), 4, 4] += 90
        own = []
        if v % 2:
            own = [(v, int(at[k]) + r.randrange(-400_000, 400_000), 100.0 * x, 100.0 * y, 100.0 * x + 150, 100.0 * y + 350) for k in range(a + 4, min(n, a + 12))]
        boxes += own
        rows += [(v, int(at[k]), i, j, int(pic[k, i, j])) for k in range(n) for i in range(9) for j in range(16)]
        fg = np.zeros(pic.shape, bool)
        for k in range(n) if n >= 20 else ():
            past = (at >= at[k] - 60_000_000) & (at <= at[k] - 10_000_000)
            if past.sum() < 8:
                continue
            f = np.abs(pic[k] - np.floor(np.median(pic[past], 0))) > p["blob_diff"]
            e = np.array([[f[max(0, i - 1) : i + 2, max(0, j - 1) : j + 2].all() for j in range(16)] for i in range(9)])
            f = np.array([[e[max(0, i - 1) : i + 2, max(0, j - 1) : j + 2].any() for j in range(16)] for i in range(9)])
            f[: int(np.ceil(ROAD[0][1] / 100 - 0.5))] = False  # above the road
            if own:
                t = min({o[1] for o in own}, key=lambda t: (abs(t - at[k]), t))
                for _, bt, x1, y1, x2, y2 in own:
                    if bt == t and abs(t - at[k]) < 1_000_000:
                        pad = 0.2 * (x2 - x1)
                        f[max(0, int((y1 - pad) / 100)) : int((y2 + pad) / 100) + 1, max(0, int((x1 - pad) / 100)) : int((x2 + pad) / 100) + 1] = False
            fg[k] = f
        hold = max(2, round(5_000_000 / np.median(np.diff(at))))
        still = [k for k in range(hold - 1, n) if fg[k - hold + 1 : k + 1].all(0).sum() >= p["blob_min_area_frac"] * 144]
        while still:
            last = still[0]
            for k in still[1:]:
                if k != last + 1:
                    break
                last = k
            want.append((v, int(at[max(0, still[0] - hold + 1)]), int(at[last])))
            still = [k for k in still if k > last]
    videos = spark.createDataFrame([(v, 25.0, WIDTH, HEIGHT, 80.0) for v in range(6)], "video_id bigint, fps double, width int, height int, duration double")
    shapes, moves, right = documents.scene_shapes(spark, {"normalized": False, "image_size": [WIDTH, HEIGHT], "carriageway": [[[0, 340], [WIDTH, 340], [WIDTH, HEIGHT], [0, HEIGHT]]]})
    cells = spark.createDataFrame([], "video_id bigint, iy int, ix int, road boolean, depth_cells double, queue boolean, crosswalk boolean")
    seen = spark.createDataFrame(boxes, "video_id bigint, t_us bigint, x1 double, y1 double, x2 double, y2 double")
    th = spark.createDataFrame(rows, "video_id bigint, t_us bigint, py int, px int, gray int")
    x = rules.Tables(seen, videos, videos, sc.scene_rows(documents.shapes_for_videos(shapes, videos), videos, moves, right), cells, cells, cells, th)
    got = sorted(tuple(g) for g in thumbnails.static_blobs(x, p).collect())
    assert got == sorted(want) and len(want) >= 5
