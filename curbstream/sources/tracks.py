"""Raw tracks as files: tracker output of any number of cameras, at rest or as a stream of new files."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRACKS = "video_id BIGINT, ord BIGINT, frame BIGINT, t_us BIGINT, track_id BIGINT, cls INT, conf DOUBLE, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE"
#: What a stream has besides: head states and the mark of a video's end, on the rows without a track that every frame sends.
TICKS = TRACKS + ", signals MAP<STRING, STRING>, last BOOLEAN"


def write_tracks(rows: DataFrame, path: str, mode: str = "error") -> None:
    """One folder per camera-hour, so that readers of a video or a time open few files."""
    d = rows.withColumns({"hour": F.floor(F.col("t_us") / 3_600_000_000), "part": F.pmod(F.xxhash64("video_id"), F.lit(256))})
    d.repartition("part", "hour").sortWithinPartitions("video_id", "t_us", "ord").write.mode(mode).partitionBy("part", "hour").parquet(path)


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Raw tracks with the time in seconds; files without rows or columns beyond these are fine."""
    d = spark.read.schema(TRACKS).parquet(path)
    return d.withColumn("t", F.col("t_us") / 1e6)


def read_video(spark: SparkSession, path: str, video_id: int) -> DataFrame:
    """The rows of one video: only its folder is opened."""
    d = spark.read.schema(TRACKS + ", part BIGINT, hour BIGINT").parquet(path)
    part = spark.range(1).select(F.pmod(F.xxhash64(F.lit(video_id).cast("bigint")), F.lit(256))).first()[0]
    return d.filter((F.col("part") == part) & (F.col("video_id") == video_id)).drop("part", "hour")


def stream_tracks(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """New files of tracks and ticks as they come, for ``curbstream.streaming.live.motion_stream``."""
    return spark.readStream.schema(TICKS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
