"""From tables to final events."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbstream.operators.lookup import phases_from_samples
from curbstream.operators.ordered import Scan, ordered_scan, with_chunk
from curbstream.operators.quantiles import exact_quantiles
from curbstream.operators.series import mode_filter

SIGNAL_STATES = ["amber", "green", "red", "unknown"]


def signal_timeline(samples: DataFrame, smooth_sec: float = 1.0, chunk_us: int = 3_600_000_000) -> DataFrame:
    """Samples ``video_id, signal_id, t_us, state`` to phases ``video_id, signal_id, t0_us, t1_us, state``.

    The majority filter spans ``smooth_sec`` at the head's own sample spacing; heads are grouped by that
    width, of which there are few.
    """
    key = ["video_id", "signal_id"]
    d = ordered_scan(with_chunk(samples, "t_us", chunk_us), key, "chunk", ["t_us"], [Scan("lag", "t_us", "__p")])
    steps = d.filter("__p IS NOT NULL").select(*key, (F.col("t_us") - F.col("__p")).alias("dt"))
    dt = exact_quantiles(steps, key, "dt", {"dt": 0.5}, 10_000.0).drop("n")
    dt = samples.select(*key).distinct().join(dt, key, "left").withColumn("dt", F.coalesce("dt", F.lit(1e6)))
    n = F.bround(F.lit(smooth_sec * 1e6) / F.greatest("dt", F.lit(1e3))).cast("int")
    dt = dt.withColumn("half", F.shiftright(F.greatest(n, F.lit(1)), 1))
    halves = [r[0] for r in dt.select("half").distinct().collect()]  # one value per sampling rate, 500 at most
    d = samples.join(dt, key)
    parts = [mode_filter(d.filter(F.col("half") == h), key, ["t_us"], "t_us", "state", SIGNAL_STATES, h, "smooth", chunk_us) for h in halves]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    u = u.select(*key, "t_us", F.col("smooth").alias("state"), F.col("dt").cast("bigint").alias("dt"))
    out = phases_from_samples(u, [*key, "dt"], "t_us", "state", [], F.col("dt"), chunk_us)
    return out.select(*key, "t0_us", "t1_us", "state")


def detect(x, events: dict | None = None, labels: list[str] | None = None, run: Callable[[str], DataFrame] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Segments of all enabled rules, and the error text of rules that failed.

    Each rule is written on its own, so one that fails takes no other with it. ``run`` gives a rule's staged segments
    where they are kept elsewhere.
    """
    from curbstream.plans import conflicts  # noqa: F401  registers its rules
    from curbstream.plans.params import CLASSES, EVENTS
    from curbstream.plans.rules import RULES
    from curbstream.session import stage

    events = events or EVENTS
    out, errors = None, {}
    for label in labels or CLASSES:
        if not events[label].get("enabled", True):
            continue
        try:
            s = run(label) if run else stage(RULES[label](x, events[label]), f"segments_{label}")
        except Exception as e:  # the rule is left out and reported
            errors[label] = str(e)
            continue
        out = s if out is None else out.unionByName(s)
    if out is None:
        raise RuntimeError(f"no rule gave a result: {errors}")
    return out, errors


def final_events(segments: DataFrame, videos: DataFrame, events: dict | None = None) -> DataFrame:
    """Final events of all videos, in the order of video, start, end and label."""
    from curbstream.operators.post import postprocess, suppress_near_misses
    from curbstream.plans.params import EVENTS

    events = events or EVENTS
    return postprocess(suppress_near_misses(segments, events), videos, events).orderBy("video_id", "start", "end", "label")
