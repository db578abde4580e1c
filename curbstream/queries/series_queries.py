"""Ordered, interval and lookup operators over the event and order tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from curbstream.operators import greedy, intervals, lookup, ordered, post, quantiles, series
from curbstream.plans.params import POST_DEFAULTS
from curbstream.queries.registry import query
from curbstream.sources.tables import epoch_us, event_spans, events, table

HOUR = 3_600_000_000

EV = "ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS t_us FROM events)"


def spans(stretch: int) -> str:
    return f"sp AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS start_us, epoch_us(ts) + CAST(round(value * 1e6 * {stretch}) AS BIGINT) AS end_us FROM events)"


@query(
    "runs",
    f"""WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS rn FROM ev),
    f AS (SELECT *, rn - row_number() OVER (PARTITION BY user_id ORDER BY rn) AS isl FROM r WHERE value >= 50e0)
    SELECT user_id, min(t_us) AS start_us, max(t_us) AS end_us, count(*) AS n_rows FROM f GROUP BY user_id, isl""",
)
def q_runs(spark, folder):
    e = events(spark, folder).withColumn("hot", F.col("value") >= 50.0)
    return ordered.runs(e, ["user_id"], "t_us", "hot", ties=["event_id"]).drop("island")


@query(
    "runs_min_duration",
    f"""WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS rn FROM ev),
    f AS (SELECT *, lag(rn) OVER w AS prn, lag(t_us) OVER w AS pt FROM r WHERE value >= 50e0 WINDOW w AS (PARTITION BY user_id ORDER BY rn)),
    g AS (SELECT *, sum(CASE WHEN rn = prn + 1 OR t_us - pt <= 6 * {HOUR} THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY rn) AS isl FROM f)
    SELECT user_id, min(t_us) AS start_us, max(t_us) AS end_us, count(*) AS n_rows, max(value) AS top FROM g GROUP BY user_id, isl
    HAVING max(t_us) - min(t_us) >= {HOUR}""",
)
def q_runs_min(spark, folder):
    e = events(spark, folder).withColumn("hot", F.col("value") >= 50.0)
    r = ordered.runs(e, ["user_id"], "t_us", "hot", HOUR, 6 * HOUR, ties=["event_id"], aggs=[F.max("value").alias("top")])
    return r.drop("island")


def merge_sql(keys: str, stretch: int, gap: int, op: str) -> str:
    return f"""WITH {spans(stretch)},
    r AS (SELECT *, max(end_us) OVER (PARTITION BY {keys} ORDER BY start_us, end_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp),
    g AS (SELECT *, sum(CASE WHEN start_us - reach {op} {gap} THEN 0 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY start_us, end_us, event_id) AS isl FROM r)
    SELECT {keys}, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS n_merged, max(value) AS top,
      arg_min(event_id, (start_us, end_us, event_id)) AS first_id FROM g GROUP BY {keys}, isl"""




def _merged(spark, folder, keys, stretch, gap, strict=False):
    aggs = [F.max("value").alias("top"), F.min_by("event_id", F.struct("start_us", "end_us", "event_id")).alias("first_id")]
    return intervals.merge_intervals(event_spans(spark, folder, stretch), keys, gap=gap, strict=strict, aggs=aggs, ties=["event_id"])


@query("merge_intervals", merge_sql("event_type", 10, 60_000_000, "<="))
def q_merge(spark, folder):
    return _merged(spark, folder, ["event_type"], 10, 60_000_000)


@query("merge_intervals_strict", merge_sql("user_id, event_type", 600, HOUR, "<"))
def q_merge_strict(spark, folder):
    return _merged(spark, folder, ["user_id", "event_type"], 600, HOUR, True)


POST_EVENTS = {
    "click": {"min_confidence": 0.05, "merge_gap": 7200.0, "min_len": 600.0},
    "error": {"min_confidence": 0.02, "post": {"merge_gap": 0.0, "start_offset": -90.5, "end_offset": 30.25}},
    "view": {"min_confidence": 0.1, "min_len": 3600.0, "end_offset": -600.0},
    "purchase": {"merge_gap": 86400.0, "min_confidence": 0.2},
    "signup": {"min_confidence": 0.0, "start_offset": 60.125},
}
T0 = 1_704_067_200_000_000  # 2024-01-01, the first day of the event table
POST_DURATION = 30 * 86400.0 - 0.003


@query(
    "class_params",
    "SELECT * FROM (VALUES "
    + ", ".join(
        f"('{c}', {ps['merge_gap']}e0, {ps['min_len']}e0, {ps['start_offset']}e0, {ps['end_offset']}e0, {ps['min_confidence']}e0)"
        for c, ps in sorted((c, {**POST_DEFAULTS, **{k: v for k, v in e.items() if k != "post"}, **e.get("post", {})}) for c, e in POST_EVENTS.items())
    )
    + ") t(event_type, merge_gap, min_len, start_offset, end_offset, min_confidence) WHERE event_type IN (SELECT event_type FROM events)",
)
def q_class_params(spark, folder):
    from curbstream.plans.params import class_param

    e = table(spark, folder, "events").select("event_type").distinct()
    return e.select("event_type", *[class_param(POST_EVENTS, n, "event_type").alias(n) for n in POST_DEFAULTS])


POST_VALUES = ", ".join(
    f"('{c}', {p['merge_gap']}e0, {p['min_len']}e0, {p['start_offset']}e0, {p['end_offset']}e0, {p['min_confidence']}e0)"
    for c, p in ((c, {**POST_DEFAULTS, **{k: v for k, v in e.items() if k != "post"}, **e.get("post", {})}) for c, e in POST_EVENTS.items())
)


@query(
    "postprocess_segments",
    f"""WITH {spans(60)}, p(event_type, gap, min_len, so, eo, gate) AS (VALUES {POST_VALUES}),
    s AS (SELECT user_id, event_type, start_us - {T0} AS s, end_us - {T0} AS e, value / 500e0 AS conf, p.* EXCLUDE (event_type)
      FROM sp JOIN p USING (event_type) WHERE value / 500e0 >= gate),
    r AS (SELECT *, max(e) OVER (PARTITION BY user_id, event_type ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
    g AS (SELECT *, sum(CASE WHEN s - reach <= gap * 1e6 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, event_type ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM r),
    m AS (SELECT user_id, event_type, min(s) AS s, max(e) AS e, max(conf) AS conf, any_value(min_len) AS min_len, any_value(so) AS so, any_value(eo) AS eo
      FROM g GROUP BY user_id, event_type, isl),
    c AS (SELECT user_id, event_type, conf, greatest(0, s + CAST(round(so * 1e6) AS BIGINT)) AS s,
        least(CAST(round({POST_DURATION}e0 * 1e6) AS BIGINT), e + CAST(round(eo * 1e6) AS BIGINT)) AS e FROM m WHERE e - s >= min_len * 1e6),
    c2 AS (SELECT *, max(e) OVER (PARTITION BY user_id, event_type ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c WHERE e - s >= 100000),
    c3 AS (SELECT *, sum(CASE WHEN s - reach <= 0 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, event_type ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM c2),
    f AS (SELECT user_id, event_type, round(min(s) / 1e6, 2) AS "start", least(round(max(e) / 1e6, 2), floor({POST_DURATION}e0 * 100e0) / 100e0) AS "end", max(conf) AS confidence
      FROM c3 GROUP BY user_id, event_type, isl)
    SELECT user_id AS video_id, event_type AS label, "start", "end", confidence FROM f WHERE "end" > "start" """,
)
def q_postprocess(spark, folder):
    e = event_spans(spark, folder, 60)
    s = e.select(
        F.col("user_id").alias("video_id"),
        F.col("event_type").alias("label"),
        (F.col("start_us") - T0).alias("start_us"),
        (F.col("end_us") - T0).alias("end_us"),
        (F.col("value") / 500.0).alias("confidence"),
    )
    d = s.select("video_id").distinct().withColumn("duration", F.lit(POST_DURATION))
    return post.postprocess(s, d, POST_EVENTS)


@query(
    "greedy_nonoverlap",
    f"""WITH RECURSIVE {spans(60)}, o AS (SELECT user_id, event_type, event_id, start_us, greatest(start_us, end_us) AS end_us,
        row_number() OVER (PARTITION BY user_id, event_type ORDER BY start_us, event_id) AS rn FROM sp),
    f AS (SELECT user_id, event_type, event_id, start_us, end_us, rn, end_us AS reach, true AS kept FROM o WHERE rn = 1
      UNION ALL SELECT o.user_id, o.event_type, o.event_id, o.start_us, o.end_us, o.rn, CASE WHEN o.start_us >= f.reach THEN o.end_us ELSE f.reach END, o.start_us >= f.reach
      FROM f JOIN o ON o.user_id = f.user_id AND o.event_type = f.event_type AND o.rn = f.rn + 1)
    SELECT user_id, event_type, event_id, start_us, end_us FROM f WHERE kept""",
)
def q_greedy(spark, folder):
    e = event_spans(spark, folder, 60).select("user_id", "event_type", "event_id", "start_us", "end_us")
    return greedy.keep_non_overlapping(e, ["user_id", "event_type"], "start_us", "end_us", ["event_id"])


@query(
    "min_gap_sampling",
    f"""WITH RECURSIVE {EV}, o AS (SELECT user_id, event_id, t_us, row_number() OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS rn FROM ev),
    f AS (SELECT user_id, event_id, t_us, rn, t_us AS sel, true AS kept FROM o WHERE rn = 1
      UNION ALL SELECT o.user_id, o.event_id, o.t_us, o.rn, CASE WHEN o.t_us - f.sel >= 12 * {HOUR} THEN o.t_us ELSE f.sel END, o.t_us - f.sel >= 12 * {HOUR}
      FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1)
    SELECT user_id, event_id, t_us FROM f WHERE kept""",
)
def q_min_gap(spark, folder):
    e = events(spark, folder).select("user_id", "event_id", "t_us")
    return series.sample_min_gap(e, ["user_id"], "t_us", 12 * HOUR, ["event_id"])


@query(
    "asof_last",
    f"""WITH {EV}, x AS (SELECT user_id, event_id, t_us, CASE WHEN event_type = 'error' THEN value END AS err, event_type FROM ev),
    y AS (SELECT *, last_value(err IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t_us, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END, event_id
        ROWS UNBOUNDED PRECEDING) AS last_error FROM x)
    SELECT user_id, event_id, t_us, last_error FROM y WHERE event_type = 'view'""",
)
def q_asof(spark, folder):
    e = events(spark, folder)
    probes = e.filter("event_type = 'view'").select("user_id", "event_id", "t_us")
    facts = e.filter("event_type = 'error'").select("user_id", "event_id", "t_us", F.col("value").alias("last_error"))
    return lookup.asof_last(probes, facts, ["user_id"], "t_us", ["last_error"], ["event_id"])


@query(
    "nearest_in_time",
    f"""WITH {EV}, a AS (SELECT * FROM ev WHERE event_type = 'view'), b AS (SELECT * FROM ev WHERE event_type = 'click'),
    j AS (SELECT a.user_id, a.event_id, a.t_us, b.event_id AS near_id, b.value AS near_value,
      row_number() OVER (PARTITION BY a.event_id ORDER BY abs(b.t_us - a.t_us), b.t_us, b.event_id DESC) AS rn
      FROM a JOIN b ON a.user_id = b.user_id AND abs(b.t_us - a.t_us) < 24 * {HOUR})
    SELECT a.user_id, a.event_id, a.t_us, j.near_id, j.near_value FROM a LEFT JOIN (SELECT * FROM j WHERE rn = 1) j ON j.event_id = a.event_id""",
)
def q_nearest(spark, folder):
    e = events(spark, folder)
    probes = e.filter("event_type = 'view'").select("user_id", "event_id", "t_us")
    facts = e.filter("event_type = 'click'").select("user_id", "event_id", "t_us", F.col("event_id").alias("near_id"), F.col("value").alias("near_value"))
    return lookup.nearest_in_time(probes, facts, ["user_id"], "t_us", ["near_id", "near_value"], ["event_id"], 24 * HOUR)


PHASES = """ord AS (SELECT o_custkey AS head_id, o_orderkey, epoch_us(o_orderdate) AS t_us, o_orderstatus AS state FROM orders),
    ch AS (SELECT *, lag(state) OVER w AS prev, lead(t_us) OVER w AS nt FROM ord WINDOW w AS (PARTITION BY head_id ORDER BY t_us, o_orderkey)),
    ci AS (SELECT *, sum(CASE WHEN prev IS NULL OR prev <> state THEN 1 ELSE 0 END) OVER (PARTITION BY head_id ORDER BY t_us, o_orderkey) AS ph FROM ch),
    phases AS (SELECT head_id, min(t_us) AS t0_us, max(coalesce(nt, t_us + 86400000000)) AS t1_us, any_value(state) AS state, count(*) AS n_samples FROM ci GROUP BY head_id, ph)"""
SHIP = "ship AS (SELECT o_custkey AS head_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, epoch_us(l_shipdate) AS t_us FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _phases(spark, folder):
    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("head_id"), "o_orderkey", epoch_us("o_orderdate").alias("t_us"), F.col("o_orderstatus").alias("state"))
    return lookup.phases_from_samples(o, ["head_id"], "t_us", "state", ["o_orderkey"], 86_400_000_000, 90 * ordered.DAY_US)


def _probes(spark, folder):
    li = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", epoch_us("l_shipdate").alias("t_us"))
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("head_id"))
    return li.join(o, "l_orderkey").select("head_id", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "t_us")


SHIP_TIES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


@query("signal_phases", f"WITH {PHASES} SELECT * FROM phases")
def q_phases(spark, folder):
    return _phases(spark, folder)


@query(
    "interval_lookup",
    f"""WITH {PHASES}, {SHIP} SELECT s.*, coalesce(p.state, 'unknown') AS state, p.t0_us AS state_since FROM ship s
    LEFT JOIN phases p ON p.head_id = s.head_id AND p.t0_us <= s.t_us AND s.t_us < p.t1_us""",
)
def q_state_at(spark, folder):
    return lookup.state_at(_probes(spark, folder), _phases(spark, folder), ["head_id"], "t_us", SHIP_TIES, chunk_us=90 * ordered.DAY_US)


@query(
    "next_change",
    f"""WITH {PHASES}, {SHIP} SELECT s.head_id, s.l_orderkey, s.l_linenumber, s.l_partkey, s.l_suppkey, s.l_quantity, s.t_us, n.next_us FROM
    (SELECT *, row_number() OVER () AS k FROM ship) s LEFT JOIN
    (SELECT head_id, t_us, min(t0_us) AS next_us FROM (SELECT DISTINCT head_id, t_us FROM ship) d JOIN phases p USING (head_id) WHERE p.state = 'F' AND p.t0_us > d.t_us GROUP BY 1, 2) n
    ON n.head_id = s.head_id AND n.t_us = s.t_us""",
)
def q_next_change(spark, folder):
    return lookup.next_change(_probes(spark, folder), _phases(spark, folder), ["head_id"], "t_us", "F", SHIP_TIES, chunk_us=90 * ordered.DAY_US)


@query(
    "signal_known",
    f"WITH {PHASES} SELECT head_id, bool_or(state <> 'P') AS known FROM phases GROUP BY head_id",
)
def q_known(spark, folder):
    return _phases(spark, folder).groupBy("head_id").agg(F.bool_or(F.col("state") != "P").alias("known"))


@query(
    "phase_stats",
    f"""WITH {PHASES}, x AS (SELECT *, row_number() OVER (PARTITION BY head_id ORDER BY t0_us, t1_us) AS a, row_number() OVER (PARTITION BY head_id ORDER BY t0_us DESC, t1_us DESC) AS b FROM phases)
    SELECT head_id, state, round(avg((t1_us - t0_us) / 1e6), 1) AS mean_sec, count(*) AS n FROM x WHERE a > 1 AND b > 1 GROUP BY head_id, state""",
)
def q_phase_stats(spark, folder):
    from curbstream.plans.explore import phase_stats

    return phase_stats(_phases(spark, folder), ["head_id"], 90 * ordered.DAY_US)


@query(
    "overlap_sum",
    f"""WITH {spans(600)}, w AS (SELECT * FROM sp WHERE event_type = 'purchase'), g AS (SELECT * FROM sp WHERE event_type = 'view')
    SELECT w.user_id, w.event_id, round(sum(greatest(0, least(w.end_us, g.end_us) - greatest(w.start_us, g.start_us))) / 1e6, 3) AS green_sec
    FROM w JOIN g ON w.user_id = g.user_id AND w.start_us <= g.end_us AND g.start_us <= w.end_us GROUP BY 1, 2""",
)
def q_overlap_sum(spark, folder):
    sp = event_spans(spark, folder, 600)
    w = sp.filter("event_type = 'purchase'").select("user_id", "event_id", "start_us", "end_us")
    g = sp.filter("event_type = 'view'").select("user_id", F.col("start_us").alias("g0"), F.col("end_us").alias("g1"))
    j = intervals.overlap_join(w, g, ["user_id"], ("start_us", "end_us"), ("g0", "g1"), 24 * HOUR)
    part = F.greatest(F.lit(0), F.least("end_us", "g1") - F.greatest("start_us", "g0"))
    return j.groupBy("user_id", "event_id").agg(F.round(F.sum(part) / 1e6, 3).alias("green_sec"))


@query(
    "active_at",
    f"""WITH {spans(60)}, {EV} SELECT e.event_id, count(s.event_id) AS n_active FROM (SELECT * FROM ev WHERE event_type = 'view') e
    LEFT JOIN sp s ON s.user_id = e.user_id AND s.event_type <> 'view' AND s.start_us <= e.t_us AND e.t_us <= s.end_us GROUP BY e.event_id""",
)
def q_active(spark, folder):
    e = events(spark, folder).filter("event_type = 'view'").select("user_id", "event_id", "t_us")
    s = event_spans(spark, folder, 60).filter("event_type <> 'view'").select("user_id", F.col("event_id").alias("seg"), "start_us", "end_us")
    j = intervals.overlap_join(e, s, ["user_id"], ("t_us", "t_us"), ("start_us", "end_us"), 24 * HOUR, how="left")
    return j.groupBy("event_id").agg(F.count("seg").alias("n_active"))




@query(
    "trailing_slope",
    f"""WITH {EV}, x AS (SELECT *, (t_us - {T0}) / 3.6e9 AS h FROM ev)
    SELECT user_id, event_id, t_us, round(CASE WHEN count(*) OVER w >= 3 THEN regr_slope(value, h) OVER w END, 5) AS slope FROM x
    WINDOW w AS (PARTITION BY user_id ORDER BY t_us RANGE BETWEEN {24 * HOUR} PRECEDING AND CURRENT ROW)""",
)
def q_slope(spark, folder):
    e = events(spark, folder).select("user_id", "event_id", "t_us", "value")
    d = series.trailing_slope(e, ["user_id"], "t_us", "value", 24 * HOUR, 3, "slope", 7 * ordered.DAY_US, 3.6e9)
    return d.select("user_id", "event_id", "t_us", F.round("slope", 5).alias("slope"))


@query(
    "window_mean",
    f"""WITH {EV} SELECT user_id, event_id, t_us, round(avg(value) OVER (PARTITION BY user_id ORDER BY t_us RANGE BETWEEN {12 * HOUR} PRECEDING AND {HOUR + 1} PRECEDING), 6) AS before_mean,
    round(avg(value) OVER (PARTITION BY user_id ORDER BY t_us RANGE BETWEEN {HOUR} FOLLOWING AND {12 * HOUR - 1} FOLLOWING), 6) AS after_mean FROM ev""",
)
def q_window_mean(spark, folder):
    e = events(spark, folder).select("user_id", "event_id", "t_us", "value")
    d = series.window_mean(e, ["user_id"], "t_us", {"b": ("value", -12 * HOUR, -HOUR), "a": ("value", HOUR, 12 * HOUR)}, 7 * ordered.DAY_US)
    return d.select("user_id", "event_id", "t_us", F.round("b", 6).alias("before_mean"), F.round("a", 6).alias("after_mean"))


@query(
    "ema",
    f"""WITH RECURSIVE {EV}, o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS rn FROM ev),
    f AS (SELECT user_id, event_id, rn, sqrt(value) AS e FROM o WHERE rn = 1
      UNION ALL SELECT o.user_id, o.event_id, o.rn, f.e + 0.3e0 * (sqrt(o.value) - f.e) FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1)
    SELECT user_id, event_id, round(e, 6) AS ema FROM f""",
)
def q_ema(spark, folder):
    e = events(spark, folder).select("user_id", "event_id", "t_us", F.sqrt("value").alias("value"))
    return series.ema(e, ["user_id"], ["t_us", "event_id"], "t_us", "value", 0.3, "e", 7 * ordered.DAY_US).select("user_id", "event_id", F.round("e", 6).alias("ema"))


@query(
    "peak_hold",
    f"WITH {EV} SELECT user_id, event_id, max(value) OVER (PARTITION BY user_id ORDER BY t_us RANGE BETWEEN {24 * HOUR} PRECEDING AND CURRENT ROW) AS peak FROM ev",
)
def q_peak(spark, folder):
    e = events(spark, folder).select("user_id", "event_id", "t_us", "value")
    return series.peak_hold(e, ["user_id"], "t_us", "value", 24 * HOUR, "peak", 7 * ordered.DAY_US).select("user_id", "event_id", "peak")


@query(
    "noise_floor",
    f"""WITH {EV} SELECT user_id, event_id, round(CASE WHEN count(*) OVER w >= 20 THEN 3e0 * quantile_cont(value, 0.5) OVER w ELSE 0e0 END, 6) AS floor
    FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t_us, event_id ROWS BETWEEN 599 PRECEDING AND CURRENT ROW)""",
)
def q_noise(spark, folder):
    e = events(spark, folder).select("user_id", "event_id", "t_us", "value")
    d = series.noise_floor(e, ["user_id"], ["t_us", "event_id"], "t_us", "value", 3.0, 600, 20, "f", 7 * ordered.DAY_US)
    return d.select("user_id", "event_id", F.round("f", 6).alias("floor"))


@query(
    "mode_filter",
    f"""WITH {EV}, w AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS rn FROM ev),
    v AS (SELECT a.user_id, a.event_id, b.event_type AS s, count(*) AS n FROM w a JOIN w b ON a.user_id = b.user_id AND b.rn BETWEEN a.rn - 3 AND a.rn + 3 GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY n DESC, s) AS k FROM v)
    SELECT user_id, event_id, s AS state FROM r WHERE k = 1""",
)
def q_mode(spark, folder):
    e = events(spark, folder).select("user_id", "event_id", "t_us", "event_type")
    d = series.mode_filter(e, ["user_id"], ["t_us", "event_id"], "t_us", "event_type", ["click", "error", "purchase", "signup", "view"], 3, "state", 7 * ordered.DAY_US)
    return d.select("user_id", "event_id", "state")


@query(
    "exact_quantiles",
    f"""WITH {EV} SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.995), 6) AS p995, count(*) AS n
    FROM ev GROUP BY event_type""",
)
def q_quantiles(spark, folder):
    q = quantiles.exact_quantiles(events(spark, folder), ["event_type"], "value", {"p50": 0.5, "p90": 0.9, "p995": 0.995}, 1.0)
    return q.select("event_type", *[F.round(c, 6).alias(c) for c in ("p50", "p90", "p995")], "n")


@query(
    "robust_noise",
    f"""WITH {EV}, m AS (SELECT event_type, quantile_cont(value, 0.5) AS med FROM ev GROUP BY 1)
    SELECT event_type, round(greatest(1.5e0, 4e0 * 1.4826e0 * quantile_cont(abs(value - med), 0.5)), 6) AS a_brake FROM ev JOIN m USING (event_type) GROUP BY 1 HAVING count(*) > 50""",
)
def q_robust(spark, folder):
    from curbstream.operators.quantiles import mad_sigma

    d = mad_sigma(events(spark, folder), ["event_type"], "value", 1.0).filter("n > 50")
    return d.select("event_type", F.round(F.greatest(F.lit(1.5), 4.0 * F.col("sigma")), 6).alias("a_brake"))


@query(
    "trail",
    f"""WITH {EV} SELECT user_id, event_id, count(*) OVER w AS n_points, sum(event_id) OVER w::BIGINT AS id_sum FROM ev
    WINDOW w AS (PARTITION BY user_id ORDER BY t_us, event_id ROWS BETWEEN 24 PRECEDING AND CURRENT ROW)""".replace("sum(event_id) OVER w::BIGINT", "CAST(sum(event_id) OVER w AS BIGINT)"),
)
def q_trail(spark, folder):
    from curbstream.plans.explore import trails

    d = trails(events(spark, folder), ["user_id"], ["t_us", "event_id"], "t_us", ["event_id"], 25)
    return d.select("user_id", "event_id", F.size("trail").cast("bigint").alias("n_points"), F.aggregate("trail", F.lit(0).cast("bigint"), lambda a, r: a + r["event_id"]).alias("id_sum"))


@query(
    "hit_sessions",
    f"""WITH {EV}, o AS (SELECT *, lag(t_us) OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS pt FROM ev),
    s AS (SELECT *, sum(CASE WHEN pt IS NULL OR t_us - pt > 12 * {HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS ses,
      CASE WHEN pt IS NOT NULL AND t_us - pt <= 3 * {HOUR} THEN 1 ELSE 0 END AS tight FROM o)
    SELECT user_id, min(t_us) AS t_first, max(t_us) AS t_last, count(*) AS n_hits FROM s GROUP BY user_id, ses HAVING max(tight) = 1""",
)
def q_sessions(spark, folder):
    from curbstream.operators.pairs import hit_sessions

    e = events(spark, folder).select("user_id", "event_id", "t_us")
    return hit_sessions(e, ["user_id"], "t_us", ["event_id"], 12 * HOUR, F.lit(3 * HOUR), 2, [], 7 * ordered.DAY_US).select("user_id", "t_first", "t_last", "n_hits")
