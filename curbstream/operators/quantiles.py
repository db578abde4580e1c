"""Exact quantiles of groups of any size, with linear interpolation."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curbstream.operators.ordered import Scan, ordered_scan


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: dict[str, float], width: float) -> DataFrame:
    """``keys``, one column per quantile, and the row count ``n``.

    Equal values are counted first (map-side), the counts are ranked in two levels with value buckets
    of ``width``, and only the one or two values at each wanted rank are kept. No group is held in memory.
    """
    v = F.col(value)
    c = df.filter(v.isNotNull()).groupBy(*keys, v.cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__k"))
    c = c.withColumn("__b", F.floor(F.col("__v") / F.lit(float(width))).cast("bigint"))
    c = ordered_scan(c, keys, "__b", ["__v"], [Scan("sum", "__k", "__hi")])
    tot = c.groupBy(*keys, "__b").agg(F.sum("__k").alias("__k"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    tot = tot.select(*keys, "__b", F.sum("__k").over(w).alias("__n"))
    c = c.join(tot, [*keys, "__b"])
    lo_rank, hi_rank = F.col("__hi") - F.col("__k"), F.col("__hi") - 1
    aggs, outs, picks = [], [], F.lit(False)
    for i, (name, q) in enumerate(qs.items()):
        p = F.lit(float(q)) * (F.col("__n") - 1)
        f, g = F.floor(p), F.ceil(p)
        in_f, in_g = f.between(lo_rank, hi_rank), g.between(lo_rank, hi_rank)
        picks = picks | in_f | in_g
        aggs += [
            F.max(F.when(in_f, F.col("__v"))).alias(f"__f{i}"),
            F.max(F.when(in_g, F.col("__v"))).alias(f"__g{i}"),
            F.max(p - f).alias(f"__w{i}"),
        ]
        fv, gv, wt = F.col(f"__f{i}"), F.col(f"__g{i}"), F.col(f"__w{i}")
        outs.append((fv + (gv - fv) * wt).alias(name))
    g = c.filter(picks).groupBy(*keys).agg(F.max("__n").alias("n"), *aggs)
    return g.select(*keys, *outs, "n")


def mad_sigma(df: DataFrame, keys: Sequence[str], value: str, width: float) -> DataFrame:
    """``keys, sigma, n``: 1.4826 times the median absolute deviation."""
    med = exact_quantiles(df, keys, value, {"__med": 0.5}, width)
    d = df.join(med.select(*keys, "__med"), list(keys)).withColumn("__dev", F.abs(F.col(value) - F.col("__med")))
    q = exact_quantiles(d, keys, "__dev", {"__mad": 0.5}, width)
    return q.select(*keys, (F.lit(1.4826) * F.col("__mad")).alias("sigma"), "n")
