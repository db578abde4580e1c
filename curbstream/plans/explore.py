"""Exploration reports: counts, speeds, heat maps, phases and trajectories."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curbstream.operators.ordered import DAY_US, Scan, ordered_scan, row_blocks, with_chunk
from curbstream.operators.quantiles import exact_quantiles
from curbstream.operators.series import number_rows
from curbstream.operators.tracks import attach


def phase_stats(phases: DataFrame, keys: Sequence[str], chunk_us: int = DAY_US) -> DataFrame:
    """Mean length and count per state, without the first and the last phase of a head (cut by the clip)."""
    d = with_chunk(phases, "t0_us", chunk_us, "__chunk")
    d = ordered_scan(d, keys, "__chunk", ["t0_us", "t1_us"], [Scan("lag", "t0_us", "__a"), Scan("lead", "t0_us", "__b")])
    d = d.filter("__a IS NOT NULL AND __b IS NOT NULL")
    return d.groupBy(*keys, "state").agg(F.round(F.avg((F.col("t1_us") - F.col("t0_us")) / 1e6), 1).alias("mean_sec"), F.count(F.lit(1)).alias("n"))


def trails(df: DataFrame, keys: Sequence[str], order: Sequence[str], t_us: str, cols: Sequence[str], n: int, chunk_us: int = DAY_US) -> DataFrame:
    """The last ``n`` points of a key at each row, as an array of structs."""
    d = number_rows(df, keys, order, t_us, "__rn", chunk_us)
    d = row_blocks(d, "__rn", max(4096, 4 * n), n - 1)
    w = Window.partitionBy(*keys, "block").orderBy("__rn").rowsBetween(-(n - 1), 0)
    return d.withColumn("trail", F.collect_list(F.struct(*cols)).over(w)).filter("home").drop("__rn", "block", "home")


def tracks_per_class(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy("video_id", "cls").agg(F.count_distinct("track_id").alias("n_tracks"))


def counts_per_second(tracks: DataFrame) -> DataFrame:
    """Distinct objects per class and second."""
    sec = F.floor(F.col("t_us") / 1_000_000).cast("bigint").alias("second")
    return tracks.groupBy("video_id", "cls", sec).agg(F.count_distinct("track_id").alias("n_objects"))


def speed_quantiles(tracks: DataFrame, moving: float = 0.3) -> DataFrame:
    q = exact_quantiles(tracks.filter(F.col("speed") > moving), ["video_id"], "speed", {"p50": 0.5, "p90": 0.9}, 0.05)
    return q.select("video_id", F.round("p50", 2).alias("p50"), F.round("p90", 2).alias("p90"), "n")


def speed_histogram(tracks: DataFrame, bins: int = 16, top: float = 8.0, moving: float = 0.3) -> DataFrame:
    """Clipped speed histogram; the last bin holds its upper edge."""
    v = F.least(F.greatest(F.col("speed"), F.lit(0.0)), F.lit(top))
    b = F.least(F.floor(v / F.lit(top / bins)), F.lit(bins - 1)).cast("int").alias("bin")
    return tracks.filter(F.col("speed") > moving).groupBy("video_id", b).agg(F.count(F.lit(1)).alias("n"))


def heatmap(tracks: DataFrame, videos: DataFrame, nx: int = 64, ny: int = 36) -> DataFrame:
    """Counts of foot points inside the frame on an ``nx`` by ``ny`` grid, with log1p."""
    d = tracks.join(videos.select("video_id", "width", "height"), "video_id")
    d = d.filter(F.col("foot_x").between(0, F.col("width")) & F.col("foot_y").between(0, F.col("height")))
    bx = F.least(F.floor(F.col("foot_x") / (F.col("width") / nx)), F.lit(nx - 1)).cast("int").alias("bx")
    by = F.least(F.floor(F.col("foot_y") / (F.col("height") / ny)), F.lit(ny - 1)).cast("int").alias("by")
    return d.groupBy("video_id", bx, by).agg(F.count(F.lit(1)).alias("n")).withColumn("heat", F.round(F.log1p("n"), 6))


def net_directions(tracks: DataFrame, min_rows: int = 5) -> DataFrame:
    """Direction (deg) from the first to the last position of each track."""
    g = tracks.groupBy("video_id", "track_id").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(F.struct("sx", "sy"), "t_us").alias("a"), F.max_by(F.struct("sx", "sy"), "t_us").alias("b")
    )
    ang = F.degrees(F.atan2(F.col("b.sy") - F.col("a.sy"), F.col("b.sx") - F.col("a.sx")))
    return g.filter(F.col("n") >= min_rows).select("video_id", "track_id", "n", ang.alias("angle"))


def lighting(brightness: DataFrame) -> DataFrame:
    """Mean brightness (0..255) per video and its bucket."""
    g = brightness.groupBy("video_id").agg(F.avg("gray").alias("m"))
    cond = F.when(F.col("m") < 60, "night").when(F.col("m") < 100, "dusk/overcast").otherwise("day")
    return g.select("video_id", F.round("m", 1).alias("brightness"), cond.alias("condition"))


def real_time_factor(run_log: DataFrame, videos: DataFrame) -> DataFrame:
    g = run_log.groupBy("video_id").agg(F.sum("sec").alias("sec")).join(videos.select("video_id", "duration"), "video_id")
    return g.select("video_id", "sec", F.round(F.col("sec") / F.col("duration"), 4).alias("rtf"))


def class_examples(events: DataFrame, reviews: DataFrame, bucket_us: int = DAY_US) -> DataFrame:
    """Per class the best example: verified ones first, then the longest (10 s at most count)."""
    from curbstream.operators.intervals import overlap_join

    ok = reviews.filter("verdict = 'correct'").select("video_id", "label", F.col("t_us").alias("__t"))
    e = events.withColumn("__lo", F.col("start_us") - 1_000_000).withColumn("__hi", F.col("end_us") + 1_000_000)
    key = ["video_id", "label", "start_us", "end_us"]
    hit = overlap_join(ok, e.select(*key, "__lo", "__hi"), ["video_id", "label"], ("__t", "__t"), ("__lo", "__hi"), bucket_us)
    e = events.select(*key).join(hit.select(*key).distinct().withColumn("verified", F.lit(True)), key, "left").withColumn("verified", F.coalesce("verified", F.lit(False)))
    rank = F.struct("verified", F.least(F.col("end_us") - F.col("start_us"), F.lit(10_000_000)), -F.col("video_id"), -F.col("start_us"), -F.col("end_us"))
    g = e.groupBy("label").agg(F.max_by(F.struct("video_id", "start_us", "end_us", "verified"), rank).alias("b"), F.count(F.lit(1)).alias("n"))
    return g.select("label", "b.*", "n")


def thin_curve(curve: DataFrame, keys: Sequence[str], t_us: str, ties: Sequence[str] = (), every: int | None = None, most: int = 1500, chunk_us: int = DAY_US) -> DataFrame:
    """Every n-th sample of each curve from its first one on; without ``every``, so that about ``most`` remain."""
    d = ordered_scan(with_chunk(curve, t_us, chunk_us, "__c"), keys, "__c", [t_us, *ties], [Scan("count", t_us, "__rn")])
    if every is not None:
        d = d.withColumn("__step", F.lit(every))
    else:
        n = curve.groupBy(*keys).agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / most)).alias("__step"))
        d = attach(d, keys, "__c", n)
    return d.filter(F.pmod(F.col("__rn") - 1, F.col("__step")) == 0).select(*curve.columns)


def labelled_clips(labels: DataFrame, normal: DataFrame, key: str = "video_id") -> DataFrame:
    """Labelled clips and clips known to be without events, which have the columns they lack as null; a labelled clip stays as it is."""
    quiet = normal.join(labels.select(key).distinct(), key, "left_anti").dropDuplicates([key])
    return labels.unionByName(quiet, allowMissingColumns=True)
