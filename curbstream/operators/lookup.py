"""Time lookups: as-of, nearest, and state-at-time over phases.

A scan reads its input twice, so an input that took joins or scans itself is staged first.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbstream.operators.ordered import DAY_US, Scan, ordered_scan, with_chunk
from curbstream.session import stage

UNKNOWN = "unknown"


def asof_last(
    probes: DataFrame, facts: DataFrame, keys: Sequence[str], t_us: str, values: Sequence[str], ties: Sequence[str], chunk_us: int = DAY_US
) -> DataFrame:
    """Each probe row with the fact values at or before its time (null when there are none)."""
    return _both_sides(probes, facts, keys, t_us, values, ties, chunk_us, ("last",))


def nearest_in_time(
    probes: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    t_us: str,
    values: Sequence[str],
    ties: Sequence[str],
    tolerance_us: int,
    chunk_us: int = DAY_US,
) -> DataFrame:
    """Each probe row with the values of the fact nearest in time, if it is closer than ``tolerance_us``.

    The earlier fact wins an equal distance.
    """
    return _both_sides(probes, facts, keys, t_us, values, ties, chunk_us, ("last", "next_after"), tolerance_us)


def _both_sides(probes, facts, keys, t_us, values, ties, chunk_us, kinds, tolerance_us=None) -> DataFrame:
    ties = [c for c in ties if c not in keys and c != t_us]
    fact = F.struct(F.col(t_us).alias("t"), *[F.col(v).alias(v) for v in values])
    f = facts.select(*keys, t_us, F.lit(0).alias("__side"), *[F.col(c) for c in ties], fact.alias("__fact"))
    p = probes.withColumn("__side", F.lit(1)).withColumn("__fact", F.lit(None).cast(f.schema["__fact"].dataType))
    u = with_chunk(f.unionByName(p, allowMissingColumns=True), t_us, chunk_us, "__chunk")
    scans = [Scan(k, "__fact", f"__{k}") for k in kinds]
    u = ordered_scan(stage(u, "lookup_sides"), keys, "__chunk", [t_us, "__side", *ties], scans).filter("__side = 1")
    if len(kinds) == 1:
        pick: Column = F.col("__last")
    else:
        back = F.col(t_us) - F.col("__last.t")
        ahead = F.col("__next_after.t") - F.col(t_us)
        near = F.when(ahead.isNull() | (back <= ahead), F.col("__last")).otherwise(F.col("__next_after"))
        pick = F.when(F.abs(near["t"] - F.col(t_us)) < F.lit(tolerance_us), near)
    u = u.withColumn("__pick", pick)
    return u.select(*[F.col(c) for c in probes.columns], *[F.col(f"__pick.{v}").alias(v) for v in values])


def phases_from_samples(samples: DataFrame, keys: Sequence[str], t_us: str, state: str, ties: Sequence[str], tail_us: Column | int, chunk_us: int = DAY_US) -> DataFrame:
    """Run-length encode samples: ``keys, t0_us, t1_us, state, n_samples``. A phase ends where the next one
    starts; the last one ends ``tail_us`` after its last sample.
    """
    order = [t_us, *ties]
    d = with_chunk(samples, t_us, chunk_us, "__chunk")
    d = ordered_scan(d, keys, "__chunk", order, [Scan("lag", state, "__prev"), Scan("lead", t_us, "__next_t")])
    d = stage(d.withColumn("__new", F.when(F.col("__prev").isNull() | (F.col("__prev") != F.col(state)), 1).otherwise(0)), "phase_starts")
    d = ordered_scan(d, keys, "__chunk", order, [Scan("sum", "__new", "__ph")])
    tail = tail_us if isinstance(tail_us, Column) else F.lit(tail_us)
    d = d.withColumn("__end", F.coalesce(F.col("__next_t"), F.col(t_us) + tail))
    return (
        d.groupBy(*keys, "__ph")
        .agg(F.min(t_us).alias("t0_us"), F.max("__end").alias("t1_us"), F.first(state).alias("state"), F.count(F.lit(1)).alias("n_samples"))
        .drop("__ph")
    )


def state_at(probes: DataFrame, phases: DataFrame, keys: Sequence[str], t_us: str, ties: Sequence[str], out: str = "state", chunk_us: int = DAY_US) -> DataFrame:
    """State of the phase with ``t0 <= t < t1`` and the start of that phase (``<out>_since``); unknown otherwise.

    Phases of one key do not overlap, so the phase that contains ``t`` is the last one that started.
    Where several start together, an empty one is no candidate.
    """
    p = phases.filter("t1_us > t0_us").select(*keys, F.col("t0_us").alias(t_us), F.col("t0_us").alias("__t0"), F.col("t1_us").alias("__t1"), F.col("state").alias("__st"))
    ties = [c for c in ties if c not in keys and c != t_us]
    for c in ties:
        p = p.withColumn(c, F.lit(None).cast(probes.schema[c].dataType))
    d = asof_last(probes, p, keys, t_us, ["__t0", "__t1", "__st"], ties, chunk_us)
    inside = F.col(t_us) < F.col("__t1")
    return d.select(
        *[F.col(c) for c in probes.columns],
        F.coalesce(F.when(inside, F.col("__st")), F.lit(UNKNOWN)).alias(out),
        F.when(inside, F.col("__t0")).alias(f"{out}_since"),
    )


def next_change(probes: DataFrame, phases: DataFrame, keys: Sequence[str], t_us: str, to_state: str, ties: Sequence[str], out: str = "next_us", chunk_us: int = DAY_US) -> DataFrame:
    """Start of the first phase in ``to_state`` that begins after the probe time."""
    f = phases.filter(F.col("state") == to_state).select(*keys, F.col("t0_us").alias(t_us), F.lit(1).alias("__side"), F.col("t0_us").alias("__at"))
    p = probes.withColumn("__side", F.lit(2)).withColumn("__at", F.lit(None).cast("bigint"))
    u = with_chunk(f.unionByName(p, allowMissingColumns=True), t_us, chunk_us, "__chunk")
    u = ordered_scan(u, keys, "__chunk", [t_us, "__side", *ties], [Scan("next_after", "__at", out)]).filter("__side = 2")
    return u.select(*[F.col(c) for c in probes.columns], out)
