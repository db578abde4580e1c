"""Short tracks are walked whole; the rows are those of the chunked steps, which stay for long ones."""
import pytest
from pyspark.sql import functions as F

from curbstream.operators import tracks
from curbstream.sources import fixture as fx

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def world(spark):
    """Two videos with repeated rows, a frame that the clock lacks, and frames that one video's clock skips."""
    raw, frames, videos = (f(spark, SF).filter("video_id < 2") for f in (fx.tracks_raw, fx.frames, fx.videos))
    twice = raw.filter("frame % 7 = 3").withColumns({"ord": F.col("ord") + 500_000, "x1": F.col("x1") + 9.0, "cls": F.lit(7)})
    raw = raw.unionByName(twice).withColumn("conf", F.when((F.col("video_id") == 1) & (F.col("frame") % 11 == 0), 0.05).otherwise(F.col("conf")))
    frames = frames.filter("NOT (video_id = 0 AND frame = 101) AND NOT (video_id = 1 AND frame % 11 = 0 AND frame > 150)")
    frames = frames.withColumn("pos", F.expr("CAST(row_number() OVER (PARTITION BY video_id ORDER BY frame) - 1 AS BIGINT)"))
    return raw.localCheckpoint(), frames.localCheckpoint(), videos.localCheckpoint()


def rounded(df):
    return sorted(tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r) for r in df.select("video_id", "track_id", "frame", *tracks.TRACK_COLUMNS).collect())


def test_short_tracks_give_the_rows_of_the_chunked_steps(spark, world):
    whole = tracks.build_tracks(*world)
    some, none = tracks.build_tracks(*world, block_rows=90), tracks.build_tracks(*world, block_rows=16)
    assert whole.schema == some.schema == none.schema
    want = rounded(none)
    assert len(want) > 2000 and any(r[-1] is not None for r in want)
    assert rounded(some) == want and rounded(whole) == want


def test_filled_rows_are_those_of_the_chunked_steps(spark, world):
    whole, cut = tracks.filled_tracks(*world), tracks.filled_tracks(*world, block_rows=90)
    show = lambda d: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in d.collect())
    assert show(whole) == show(cut) and whole.filter("interp").count() > 20


def test_rows_of_short_tracks_are_written_once(spark, world, monkeypatch):
    """Pieces, completed rows and ground rows were each written and moved again, which made the disk fail."""
    names, stage = [], tracks.stage

    def seen(df, name, *rest, **more):
        names.append(name)
        return stage(df, name, *rest, **more)

    monkeypatch.setattr(tracks, "stage", seen)
    d = tracks.build_tracks(*world)
    assert d.count() > 2000 and not {"pieces", "rows", "ground"} & set(names), names
    assert {"pieces", "rows", "ground"} <= (names.clear() or tracks.build_tracks(*world, block_rows=16) and set(names))
