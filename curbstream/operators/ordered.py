"""Ordered operators that never put a whole key into one task.

A window over ``PARTITION BY key`` sends every row of a key to one task. Here each key is cut into
time chunks: windows run inside ``(key, chunk)``, each chunk is summarised to one row, the summaries
are scanned in chunk order, and the scan result is joined back on ``(key, chunk)``, which is how the
rows are already partitioned. Results are the same for every chunk length.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
UNB, CUR = Window.unboundedPreceding, 0


@dataclass(frozen=True)
class Scan:
    """One scan column.

    kind: ``lag``/``lead`` (neighbouring row), ``sum`` (inclusive running sum), ``count`` (1-based
    row number), ``max_before`` (running maximum of the earlier rows), ``last_before`` (last non-null
    value of the earlier rows), ``last`` (the same, current row included), ``next_after`` (first
    non-null value of the later rows).
    """

    kind: str
    col: str
    out: str


def with_chunk(df: DataFrame, t_us: str, chunk_us: int, out: str = "chunk") -> DataFrame:
    return df.withColumn(out, F.floor(F.col(t_us) / F.lit(chunk_us)).cast("bigint"))


def ordered_scan(df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], scans: Sequence[Scan]) -> DataFrame:
    """Add the scan columns to ``df``. ``chunk`` must grow with ``order``; keys and chunk must not be null."""
    pos = F.struct(*order)
    part = [*keys, chunk]
    local = Window.partitionBy(*part).orderBy(*order)
    outer = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(chunk)
    aggs: list[Column] = []
    carries: list[Column] = []
    for i, s in enumerate(scans):
        c, name = F.col(s.col), f"__s{i}"
        present = F.when(c.isNotNull(), pos)
        if s.kind == "lag":
            aggs.append(F.max_by(F.struct(c.alias("v")), pos).alias(name))
            carries.append(F.lag(name).over(outer))
        elif s.kind == "lead":
            aggs.append(F.min_by(F.struct(c.alias("v")), pos).alias(name))
            carries.append(F.lead(name).over(outer))
        elif s.kind in ("sum", "count"):
            aggs.append((F.sum(c) if s.kind == "sum" else F.count(F.lit(1))).alias(name))
            carries.append(F.sum(name).over(outer.rowsBetween(UNB, -1)))
        elif s.kind == "max_before":
            aggs.append(F.max(c).alias(name))
            carries.append(F.max(name).over(outer.rowsBetween(UNB, -1)))
        elif s.kind in ("last_before", "last"):
            aggs.append(F.max_by(c, present).alias(name))
            carries.append(F.last(name, ignorenulls=True).over(outer.rowsBetween(UNB, -1)))
        elif s.kind == "next_after":
            aggs.append(F.min_by(c, present).alias(name))
            back = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(F.col(chunk).desc())
            carries.append(F.last(name, ignorenulls=True).over(back.rowsBetween(UNB, -1)))
        else:
            raise ValueError(s.kind)
    summary = df.groupBy(*part).agg(*aggs)
    summary = summary.select(*part, *[c.alias(f"__c{i}") for i, c in enumerate(carries)])
    here: dict[str, Column] = {}
    for i, s in enumerate(scans):
        c = F.col(s.col)
        if s.kind == "lag":
            e = F.lag(F.struct(c.alias("v"))).over(local)
        elif s.kind == "lead":
            e = F.lead(F.struct(c.alias("v"))).over(local)
        elif s.kind == "sum":
            e = F.sum(c).over(local.rowsBetween(UNB, CUR))
        elif s.kind == "count":
            e = F.row_number().over(local)
        elif s.kind == "max_before":
            e = F.max(c).over(local.rowsBetween(UNB, -1))
        elif s.kind == "last_before":
            e = F.last(c, ignorenulls=True).over(local.rowsBetween(UNB, -1))
        elif s.kind == "last":
            e = F.last(c, ignorenulls=True).over(local.rowsBetween(UNB, CUR))
        else:
            # Backwards, so that the frame grows row by row; a frame that shrinks would be re-read at every row.
            e = F.last(c, ignorenulls=True).over(Window.partitionBy(*part).orderBy(*[F.col(o).desc() for o in order]).rowsBetween(UNB, -1))
        here[f"__l{i}"] = e
    out = df.withColumns(here).join(summary, part, "left")
    cols: list[Column] = []
    for i, s in enumerate(scans):
        own, carry = F.col(f"__l{i}"), F.col(f"__c{i}")
        if s.kind in ("lag", "lead"):
            v = F.coalesce(own, carry)["v"]
        elif s.kind in ("sum", "count"):
            v = own + F.coalesce(carry, F.lit(0))
        elif s.kind == "max_before":
            v = F.greatest(own, carry)
        else:
            v = F.coalesce(own, carry)
        cols.append(v.alias(s.out))
    return out.select(*[F.col(c) for c in df.columns], *cols)


def islands(df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], start_flag: str, out: str = "island") -> DataFrame:
    """Number the islands of each key: a running sum of the 0/1 ``start_flag``."""
    return ordered_scan(df, keys, chunk, order, [Scan("sum", start_flag, out)])


def run_rows(
    df: DataFrame,
    keys: Sequence[str],
    t_us: str,
    flag: str,
    max_gap_us: int = 0,
    chunk_us: int = DAY_US,
    ties: Sequence[str] = (),
) -> DataFrame:
    """The rows where ``flag`` holds, with the id of their run in ``island``.

    A run is a maximal stretch of consecutive flagged rows; runs whose gap is at most ``max_gap_us``
    are one run. A null flag counts as false.
    """
    order = [t_us, *ties]
    d = with_chunk(df, t_us, chunk_us, "__chunk").withColumn("__on", F.coalesce(F.col(flag), F.lit(False)))
    d = d.withColumn("__on_t", F.when(F.col("__on"), F.col(t_us)))
    d = ordered_scan(d, keys, "__chunk", order, [Scan("lag", "__on", "__prev_on"), Scan("last_before", "__on_t", "__prev_t")])
    joined = F.coalesce(F.col("__prev_on"), F.lit(False)) | F.coalesce(F.col(t_us) - F.col("__prev_t") <= F.lit(max_gap_us), F.lit(False))
    d = d.filter("__on").withColumn("__new", F.when(joined, 0).otherwise(1))
    d = islands(d, keys, "__chunk", order, "__new")
    return d.drop("__on", "__on_t", "__prev_on", "__prev_t", "__new", "__chunk")


def runs(
    df: DataFrame,
    keys: Sequence[str],
    t_us: str,
    flag: str,
    min_us: int = 0,
    max_gap_us: int = 0,
    chunk_us: int = DAY_US,
    aggs: Sequence[Column] = (),
    ties: Sequence[str] = (),
) -> DataFrame:
    """Runs of a flag lasting at least ``min_us``: ``keys, island, start_us, end_us, n_rows`` and ``aggs``."""
    d = run_rows(df, keys, t_us, flag, max_gap_us, chunk_us, ties)
    g = d.groupBy(*keys, "island").agg(
        F.min(t_us).alias("start_us"), F.max(t_us).alias("end_us"), F.count(F.lit(1)).alias("n_rows"), *aggs
    )
    return g.filter(F.col("end_us") - F.col("start_us") >= F.lit(min_us))


def time_halo(df: DataFrame, t_us: str, chunk_us: int, before_us: int, after_us: int) -> DataFrame:
    """Copy each row into every chunk whose rows can see it through a ``[-before, +after]`` RANGE frame.

    Adds ``chunk`` and ``home`` (false on the copies). Windows over ``(key, chunk)`` are then exact for
    the home rows; keep those with ``filter('home')``. Narrow: no shuffle.
    """
    own = F.floor(F.col(t_us) / F.lit(chunk_us)).cast("bigint")
    lo = F.floor((F.col(t_us) - F.lit(after_us)) / F.lit(chunk_us)).cast("bigint")
    hi = F.floor((F.col(t_us) + F.lit(before_us)) / F.lit(chunk_us)).cast("bigint")
    d = df.withColumn("__own", own).withColumn("chunk", F.explode(F.sequence(lo, hi)))
    return d.withColumn("home", F.col("chunk") == F.col("__own")).drop("__own")


def row_blocks(df: DataFrame, rn: str, size: int, halo: int) -> DataFrame:
    """As :func:`time_halo`, for ROWS frames of up to ``halo`` rows: cut by the 1-based row number ``rn``."""
    i = F.col(rn) - F.lit(1)
    own = F.floor(i / F.lit(size)).cast("bigint")
    lo = F.floor((i - F.lit(halo)) / F.lit(size)).cast("bigint")
    hi = F.floor((i + F.lit(halo)) / F.lit(size)).cast("bigint")
    d = df.withColumn("__own", own).withColumn("block", F.explode(F.sequence(F.greatest(lo, F.lit(0)), hi)))
    return d.withColumn("home", F.col("block") == F.col("__own")).drop("__own")
