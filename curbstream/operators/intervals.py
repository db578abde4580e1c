"""Interval algebra: merging, overlap joins, stabbing and suppression."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbstream.operators.ordered import DAY_US, Scan, islands, ordered_scan, with_chunk


def merge_intervals(
    df: DataFrame,
    keys: Sequence[str],
    start: str = "start_us",
    end: str = "end_us",
    gap: Column | int = 0,
    strict: bool = False,
    aggs: Sequence[Column] = (),
    chunk_us: int = DAY_US,
    ties: Sequence[str] = (),
    parts: int | None = None,
) -> DataFrame:
    """Join intervals of a key whose gap is at most ``gap`` (below it when ``strict``).

    Returns ``keys, start, end, n_merged`` and ``aggs``. For "value of the first interval" use
    ``min_by(x, struct(start, end, ties...))`` in ``aggs``.
    """
    d = merge_islands(df, keys, start, end, gap, strict, chunk_us, ties, parts)
    return (
        d.groupBy(*keys, "island")
        .agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n_merged"), *aggs)
        .drop("island")
    )


def merge_islands(
    df: DataFrame,
    keys: Sequence[str],
    start: str = "start_us",
    end: str = "end_us",
    gap: Column | int = 0,
    strict: bool = False,
    chunk_us: int = DAY_US,
    ties: Sequence[str] = (),
    parts: int | None = None,
) -> DataFrame:
    """The rows of ``df`` with the id of their merged interval in ``island``.

    ``parts`` deals the rows over as many tasks, however well they compress on the way; without it the planner chooses.
    """
    gap = gap if isinstance(gap, Column) else F.lit(gap)
    order = [start, end, *ties]
    d = with_chunk(df.drop("island"), start, chunk_us, "__chunk")
    if parts:
        d = d.repartition(parts, *keys, "__chunk")
    d = ordered_scan(d, keys, "__chunk", order, [Scan("max_before", end, "__reach")])
    dist = F.col(start) - F.col("__reach")
    joined = (dist < gap) if strict else (dist <= gap)
    d = d.withColumn("__new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    return islands(d, keys, "__chunk", order, "__new").drop("__chunk", "__reach", "__new")


def _buckets(start: Column, end: Column, bucket_us: int) -> Column:
    lo = F.floor(start / F.lit(bucket_us)).cast("bigint")
    hi = F.floor(F.greatest(start, end) / F.lit(bucket_us)).cast("bigint")
    return F.explode(F.sequence(lo, hi))


def overlap_join(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str],
    a_span: tuple[str, str],
    b_span: tuple[str, str],
    bucket_us: int,
    condition: Column | None = None,
    how: str = "inner",
) -> DataFrame:
    """Join rows of equal ``keys`` whose closed spans meet, through time buckets.

    Both sides are copied into the buckets they touch, so a long-lived key is split over tasks; a pair
    is kept only in the first bucket both touch, so no duplicate removal is needed. Columns of ``a`` and
    ``b`` other than ``keys`` must differ. ``how`` may be ``inner``, ``left``, ``left_semi`` or
    ``left_anti``; the last three need every ``a`` span to lie in one bucket (points do), which holds
    by construction when ``a_span`` names the same column twice.
    """
    if how != "inner" and a_span[0] != a_span[1]:
        raise ValueError("only point spans may use an outer, semi or anti overlap join")
    s1, e1, s2, e2 = (F.col(c) for c in (*a_span, *b_span))
    x = a.withColumn("__bk", _buckets(s1, e1, bucket_us))
    rest = [c for c in b.columns if c not in keys]
    y = b.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *rest, _buckets(s2, e2, bucket_us).alias("__bk2"))
    cond = (F.col("__bk") == F.col("__bk2")) & (s1 <= e2) & (s2 <= e1)
    for k in keys:
        cond = (F.col(k) == F.col(f"__k_{k}")) & cond
    cond = cond & (F.col("__bk") == F.floor(F.greatest(s1, s2) / F.lit(bucket_us)).cast("bigint"))
    if condition is not None:
        cond = cond & condition
    j = x.join(y, cond, how)
    return j.select(*a.columns) if how in ("left_semi", "left_anti") else j.select(*a.columns, *rest)


def tiou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Temporal intersection over union; 0 when the union is empty."""
    inter = F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))
    union = (e1 - s1) + (e2 - s2) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))
