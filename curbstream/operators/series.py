"""Causal time-series operators: sampling, trailing fits, smoothing and noise floors."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curbstream.operators.greedy import keep_non_overlapping
from curbstream.operators.ordered import DAY_US, Scan, ordered_scan, row_blocks, time_halo, with_chunk

EMA_BLOCK = 256


def stride_for(fps: float, target_hz: float | None, fallback: int) -> int:
    """Frames per processed frame so that about ``target_hz`` frames a second remain."""
    return max(1, round(fps / target_hz)) if target_hz else fallback


def sample_stride(frames: DataFrame, stride: int, frame: str = "frame") -> DataFrame:
    return frames.filter(F.pmod(F.col(frame), F.lit(stride)) == 0)


def sample_min_gap(df: DataFrame, keys: Sequence[str], t_us: str, gap_us: int, ties: Sequence[str] = (), chunk_us: int = DAY_US) -> DataFrame:
    """Keep the first row of a key, then each row at least ``gap_us`` after the last kept one."""
    d = df.withColumn("__until", F.col(t_us) + F.lit(gap_us))
    return keep_non_overlapping(d, keys, t_us, "__until", ties, chunk_us).drop("__until")


def trailing_slope(df: DataFrame, keys: Sequence[str], t_us: str, value: str, window_us: int, min_n: int, out: str, chunk_us: int = DAY_US, per_us: float = 1e6) -> DataFrame:
    """Least-squares slope of ``value`` over the last ``window_us`` (both ends included); null below ``min_n`` rows."""
    d = time_halo(df, t_us, chunk_us, window_us, 0)
    # Time from the start of the chunk, so that sums stay small.
    d = d.withColumn("__t", (F.col(t_us) - F.col("chunk") * F.lit(chunk_us)) / F.lit(per_us))
    w = Window.partitionBy(*keys, "chunk").orderBy(t_us).rangeBetween(-window_us, 0)
    d = d.withColumn(out, F.when(F.count(value).over(w) >= min_n, F.regr_slope(F.col(value), F.col("__t")).over(w)))
    return d.filter("home").drop("__t", "chunk", "home")


def window_mean(df: DataFrame, keys: Sequence[str], t_us: str, specs: dict[str, tuple[str, int, int]], chunk_us: int = DAY_US) -> DataFrame:
    """Means over half-open windows: ``specs[out] = (value, lo_us, hi_us)`` averages rows with t+lo <= t' < t+hi."""
    before = max(0, *[-lo for _, lo, _ in specs.values()], 0)
    after = max(0, *[hi for _, _, hi in specs.values()], 0)
    d = time_halo(df, t_us, chunk_us, before, after)
    w = Window.partitionBy(*keys, "chunk").orderBy(t_us)
    for out, (v, lo, hi) in specs.items():
        d = d.withColumn(out, F.avg(v).over(w.rangeBetween(lo, hi - 1)))
    return d.filter("home").drop("chunk", "home")


def peak_hold(df: DataFrame, keys: Sequence[str], t_us: str, value: str, hold_us: int, out: str, chunk_us: int = DAY_US) -> DataFrame:
    """Maximum over the last ``hold_us`` (both ends included)."""
    d = time_halo(df, t_us, chunk_us, hold_us, 0)
    w = Window.partitionBy(*keys, "chunk").orderBy(t_us).rangeBetween(-hold_us, 0)
    return d.withColumn(out, F.max(value).over(w)).filter("home").drop("chunk", "home")


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], t_us: str, out: str, chunk_us: int = DAY_US) -> DataFrame:
    d = with_chunk(df, t_us, chunk_us, "__chunk")
    return ordered_scan(d, keys, "__chunk", order, [Scan("count", t_us, out)]).drop("__chunk")


def noise_floor(df: DataFrame, keys: Sequence[str], order: Sequence[str], t_us: str, value: str, k: float, last_n: int, min_n: int, out: str, chunk_us: int = DAY_US) -> DataFrame:
    """``k`` times the median of the last ``last_n`` values, 0 until ``min_n`` were seen."""
    d = number_rows(df, keys, order, t_us, "__rn", chunk_us)
    d = row_blocks(d, "__rn", max(4096, 4 * last_n), last_n - 1)
    w = Window.partitionBy(*keys, "block").orderBy("__rn").rowsBetween(-(last_n - 1), 0)
    d = d.withColumn(out, F.when(F.col("__rn") >= min_n, F.lit(k) * F.percentile(F.col(value), F.lit(0.5)).over(w)).otherwise(F.lit(0.0)))
    return d.filter("home").drop("__rn", "block", "home")


def ema(df: DataFrame, keys: Sequence[str], order: Sequence[str], t_us: str, value: str, alpha: float, out: str, chunk_us: int = DAY_US) -> DataFrame:
    """Exponential moving average: e = value on the first row, then ``e += alpha * (value - e)``.

    Inside a block of 256 rows the recurrence is a weighted prefix sum; a block takes the value of the
    block before it, older ones weigh below ``(1 - alpha) ** 256``, which no double can show for the
    smoothing factors used (0.7 ** 256 is about 2e-40).
    """
    beta = 1.0 - alpha
    if beta**EMA_BLOCK > 1e-18:
        raise ValueError("alpha too small for the block length")
    d = number_rows(df, keys, order, t_us, "__rn", chunk_us)
    d = d.withColumn("__i", (F.col("__rn") - 1) % EMA_BLOCK).withColumn("__blk", F.floor((F.col("__rn") - 1) / EMA_BLOCK))
    weight = F.when(F.col("__rn") == 1, F.lit(1.0)).otherwise(F.lit(alpha))
    d = d.withColumn("__x", weight * F.col(value) * F.pow(F.lit(beta), -F.col("__i")))
    part = [*keys, "__blk"]
    tail = d.groupBy(*part).agg(F.sum("__x").alias("__sum"), F.max("__i").alias("__top"))
    tail = tail.select(*keys, (F.col("__blk") + 1).alias("__blk"), (F.pow(F.lit(beta), F.col("__top")) * F.col("__sum")).alias("__carry"))
    w = Window.partitionBy(*part).orderBy("__rn").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("__own", F.pow(F.lit(beta), F.col("__i")) * F.sum("__x").over(w)).join(tail, part, "left")
    d = d.withColumn(out, F.col("__own") + F.pow(F.lit(beta), F.col("__i") + 1) * F.coalesce(F.col("__carry"), F.lit(0.0)))
    return d.select(*[F.col(c) for c in df.columns], out)


def mode_filter(df: DataFrame, keys: Sequence[str], order: Sequence[str], t_us: str, state: str, states: Sequence[str], half: int, out: str, chunk_us: int = DAY_US) -> DataFrame:
    """Centred majority of the ``2 * half + 1`` rows around each row; the alphabetically first state wins a tie."""
    d = number_rows(df, keys, order, t_us, "__rn", chunk_us)
    d = row_blocks(d, "__rn", max(4096, 8 * half), half)
    w = Window.partitionBy(*keys, "block").orderBy("__rn").rowsBetween(-half, half)
    votes = []
    for s in sorted(states):
        votes.append(F.struct(F.sum(F.when(F.col(state) == s, 1).otherwise(0)).over(w).alias("n"), F.lit(s).alias("s")))
    d = d.withColumn("__v", F.array(*votes))
    best = F.array_max(F.transform("__v", lambda v: v["n"]))
    d = d.withColumn(out, F.element_at(F.filter("__v", lambda v: v["n"] == best), 1)["s"])
    return d.filter("home").drop("__rn", "block", "home", "__v")


