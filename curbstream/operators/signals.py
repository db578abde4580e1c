"""Signal heads: from pixels to samples."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Lamp colours as hue ranges (0..180), brightness and saturation floors.
LIT_V, LIT_OVER_MEDIAN, LIT_S = 60, 25, 60
RED_LOW, RED_HIGH, AMBER_HIGH, GREEN_LOW, GREEN_HIGH = 12, 165, 32, 45, 100


def lamp_votes(pixels: DataFrame, keys: Sequence[str], min_pixels: int = 12, min_frac: float = 0.0015) -> DataFrame:
    """State of a head at one time from its pixels ``keys, h, s, v``: counts per colour and ``state``.

    Brightness has at most 256 values, so its median comes from a histogram.
    """
    hist = pixels.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("k"))
    per = hist.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("v", "k"))).alias("h"), F.sum("k").alias("n"))

    def at(rank):
        # Smallest value whose running count passes the rank.
        run = F.aggregate(
            "h", F.struct(F.lit(0).cast("bigint").alias("c"), F.lit(None).cast("bigint").alias("v")),
            lambda a, p: F.struct((a["c"] + p["k"]).alias("c"), F.when(a["v"].isNull() & (a["c"] + p["k"] > rank), p["v"].cast("bigint")).otherwise(a["v"]).alias("v")),
        )
        return run["v"]

    med = (at(F.floor((F.col("n") - 1) / 2)) + at(F.ceil((F.col("n") - 1) / 2))) / 2
    lim = per.select(*keys, "n", F.greatest(F.lit(LIT_V), med.cast("int") + LIT_OVER_MEDIAN).alias("lim"))
    lit = (F.col("v") >= F.col("lim")) & (F.col("s") >= LIT_S)
    h = F.col("h")
    c = pixels.join(lim, list(keys)).groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.count_if(lit & ((h <= RED_LOW) | (h >= RED_HIGH))).alias("red"),
        F.count_if(lit & (h > RED_LOW) & (h <= AMBER_HIGH)).alias("amber"),
        F.count_if(lit & h.between(GREEN_LOW, GREEN_HIGH)).alias("green"),
    )
    best = F.greatest("red", "amber", "green")
    second = F.col("red") + F.col("amber") + F.col("green") - best - F.least("red", "amber", "green")
    weak = (best < F.greatest(F.lit(float(min_pixels)), F.lit(min_frac) * F.col("n"))) | (best < 2 * second)
    state = F.when(weak, "unknown").when(best == F.col("red"), "red").when(best == F.col("amber"), "amber").otherwise("green")
    return c.select(*keys, "red", "amber", "green", state.alias("state"))
