"""Risk scores and alarms on streams. The state of a video is the bounded past that its next frames need.

The batch twin is ``curbstream.plans.risk.features`` followed by ``combine``; both give the same scores. A batch of frames is
worked as columns: the kept past and the new frames make one table, and rolling windows over it give every quantity.
"""
from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from curbstream.plans.params import FEATURES, RISK, RISK_WEIGHTS

RAW_SCHEMA = "video_id bigint, frame bigint, t_us bigint, ttc double, ped_ttc double, decel double, swerve double, wrong double, redrun double, n_veh double, ped double"
SCORE_SCHEMA = "video_id bigint, frame bigint, t_us bigint, score double"
SCORED_SCHEMA = SCORE_SCHEMA + ", late boolean"
#: The kept past: time, the two noisy quantities, the conflict proximity and the averaged score of the last frames.
STATE = "t array<bigint>, decel array<double>, swerve array<double>, near array<double>, mean array<double>"
PAST = [c.split()[0] for c in STATE.split(", ")]
NOISE_ROWS, NOISE_MIN = 600, 20


def read_raw(spark, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Replay recorded quantities as a stream, a few files at a time."""
    return spark.readStream.schema(RAW_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def _most_recent(values: pd.Series, t_us: np.ndarray, seconds: float) -> np.ndarray:
    """Maximum over the last ``seconds``, both ends included."""
    at = pd.Series(values.to_numpy(), index=pd.to_datetime(t_us, unit="us"))
    return at.rolling(pd.Timedelta(microseconds=round(seconds * 1e6)), closed="both").max().to_numpy()


def score_frames(past: pd.DataFrame, new: pd.DataFrame, weights: Mapping[str, float], p: Mapping) -> tuple[np.ndarray, pd.DataFrame]:
    """Scores of new frames in time order, and the past to keep. ``past`` has the columns of ``STATE``."""
    k = len(past)
    d = pd.concat([past, new], ignore_index=True)
    t = d["t"].to_numpy(np.int64)
    near = np.where(new["ttc"] < p["ttc_max"], np.exp(-new["ttc"] / p["ttc_tau"]), 0.0)
    d.loc[k:, "near"] = near
    f = {"f_ttc": near, "f_wrong": new["wrong"], "f_redrun": new["redrun"], "f_ped": new["ped"], "f_density": np.minimum(1.0, new["n_veh"] / p["density_norm"])}
    for name, column, least in (("f_brake", "decel", p["brake_ref"]), ("f_swerve", "swerve", p["swerve_ref_deg_s"])):
        usual = d[column].rolling(NOISE_ROWS, min_periods=NOISE_MIN).median().fillna(0.0)[k:]
        f[name] = np.minimum(new[column].to_numpy() / np.maximum(max(least, 1e-6), p["noise_k"] * usual.to_numpy()), 1.0)
    f["f_conflict"] = _most_recent(d["near"], t, p["conflict_memory_sec"])[k:] * np.maximum(f["f_brake"], f["f_swerve"])
    z = weights["bias"] + sum(weights.get(c, 0.0) * np.asarray(f[c], float) for c in FEATURES)
    raw = pd.Series(1.0 / (1.0 + np.exp(-z)))
    before = past["mean"].iloc[-1:].reset_index(drop=True)
    d.loc[k:, "mean"] = pd.concat([before, raw], ignore_index=True).ewm(alpha=p["ema_alpha"], adjust=False).mean().to_numpy()[len(before) :]
    held = _most_recent(d["mean"], t, p["peak_hold_sec"])[k:]
    score = np.minimum(np.maximum(held, p["floor"] + p["floor_density"] * np.asarray(f["f_density"], float)), 1.0)
    # The noise needs a number of frames, the memories a stretch of time.
    keep = (np.arange(len(d)) >= len(d) - NOISE_ROWS + 1) | (t >= t[-1] - round(max(p["conflict_memory_sec"], p["peak_hold_sec"]) * 1e6))
    return score, d.loc[keep, PAST]


def _scorer(weights: Mapping[str, float], p: Mapping, idle_ms: int | None):
    def score(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("t_us", kind="stable").rename(columns={"t_us": "t"})
        past = pd.DataFrame({c: np.asarray(v) for c, v in zip(PAST, state.get, strict=True)} if state.exists else {c: np.zeros(0, np.int64 if c == "t" else float) for c in PAST})
        seen = past["t"].max() if len(past) else -1
        late = (rows["t"] <= seen) | rows["t"].duplicated()
        new = rows[~late].reset_index(drop=True)
        out = rows[["video_id", "frame", "t"]].rename(columns={"t": "t_us"}).assign(score=np.nan, late=late)
        if len(new):
            values, past = score_frames(past, new, weights, p)
            out.loc[~late, "score"] = values
            state.update(tuple(past[c].tolist() for c in PAST))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield out

    return score


def _timeout(idle_ms: int | None) -> str:
    return GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def score_stream(raw: DataFrame, weights: Mapping[str, float] = RISK_WEIGHTS, p: Mapping = RISK, idle_ms: int | None = None) -> DataFrame:
    """Scores of a stream of raw quantities, one state per video: ``video_id, frame, t_us, score, late``.

    A frame that comes after a later one, or again, cannot change the past: it gets no score and ``late`` is true, so
    ``filter("late")`` is the side table. With ``idle_ms`` the state of a video goes when nothing has come for so long; such a
    stream wakes up for time-outs, so a replay that is to end by itself leaves it unset.
    """
    cols = [c.split()[0] for c in RAW_SCHEMA.split(", ")]
    return raw.select(*cols).groupBy("video_id").applyInPandasWithState(_scorer(weights, p, idle_ms), SCORED_SCHEMA, STATE, "append", _timeout(idle_ms))


ALARM_SCHEMA = "video_id bigint, alarm_us bigint"


def _alarms(theta: float, gap_us: int, idle_ms: int | None):
    def alarms(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        hot_before, end = state.get if state.exists else (False, None)
        d = pd.concat(list(batches)).sort_values("t_us", kind="stable")
        t, hot = d["t_us"].to_numpy(), (d["score"] >= theta).to_numpy()
        # A run starts at a hot sample after a cold one; it is an alarm when the last hot sample is at least the gap away.
        starts = hot & ~np.concatenate([[hot_before], hot[:-1]])
        last = pd.Series(np.where(hot, t, np.nan)).ffill().shift(1).fillna(-np.inf if end is None else end).to_numpy()
        fires = t[starts & (t - last >= gap_us)]
        state.update((bool(hot[-1]), int(t[hot][-1]) if hot.any() else end))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"video_id": np.full(len(fires), key[0]), "alarm_us": fires})

    return alarms


def alarm_stream(scores: DataFrame, theta: float = 0.5, gap_us: int = 2_000_000, idle_ms: int | None = None) -> DataFrame:
    """Alarm times of a score stream, emitted at the first hot sample."""
    d = scores.select("video_id", "t_us", "score").filter("score IS NOT NULL")
    return d.groupBy("video_id").applyInPandasWithState(_alarms(theta, gap_us, idle_ms), ALARM_SCHEMA, "hot boolean, end_us bigint", "append", _timeout(idle_ms))


def approx_counts_stream(tracks: DataFrame, delay: str = "10 seconds", error: float = 0.01) -> DataFrame:
    """Approximate number of objects per class and second of a track stream (event time in ``ts``); rows later than ``delay`` are dropped."""
    w = F.window("ts", "1 second")
    return tracks.withWatermark("ts", delay).groupBy("video_id", "cls", w).agg(F.approx_count_distinct("track_id", error).alias("n_objects"))
