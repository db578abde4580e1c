"""Ordered operators give the same rows for every chunk length, and the brute-force answer."""
import random

import pytest
from pyspark.sql import functions as F

from curbstream.operators import greedy, intervals, ordered, quantiles, series

CHUNKS = [3, 17, 10_000]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = [(k, i, rng.randrange(0, 400), rng.random() < 0.6, rng.random()) for k in ("hot", "hot", "hot", "a") for i in range(120)]
    data = [(k, n, t, on, v) for n, (k, _, t, on, v) in enumerate(data)]
    return data, spark.createDataFrame(data, "k string, id long, t long, on boolean, v double").cache()


def by_key(data):
    out = {}
    for r in sorted(data, key=lambda r: (r[0], r[2], r[1])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("chunk", CHUNKS)
def test_runs(rows, chunk):
    data, df = rows
    want = set()
    for k, rs in by_key(data).items():
        found = []
        for i, r in enumerate(rs):
            if r[3]:
                if found and (found[-1][2] == i - 1 or r[2] - found[-1][1] <= 2):
                    found[-1][1:] = [r[2], i]
                else:
                    found.append([r[2], r[2], i])
        want |= {(k, s, e) for s, e, _ in found if e - s >= 3}
    got = ordered.runs(df, ["k"], "t", "on", 3, 2, chunk, ties=["id"]).select("k", "start_us", "end_us").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("chunk", CHUNKS)
@pytest.mark.parametrize("strict", [False, True])
def test_merge(rows, chunk, strict):
    data, df = rows
    want = []
    for k, rs in by_key(data).items():
        last = None
        for s, e in sorted((r[2], r[2] + int(r[4] * 6)) for r in rs):
            if last and (s - last[2] < 2 if strict else s - last[2] <= 2):
                last[2] = max(last[2], e)
            else:
                last = [k, s, e]
                want.append(last)
    d = df.select("k", "id", F.col("t").alias("start_us"), (F.col("t") + F.floor(F.col("v") * 6)).alias("end_us"))
    got = intervals.merge_intervals(d, ["k"], gap=2, strict=strict, chunk_us=chunk, ties=["id"]).select("k", "start_us", "end_us").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


@pytest.mark.parametrize("limit", [0, 2000])
def test_greedy_keep(rows, limit):
    """With limit 0 every group goes the distributed way."""
    data, df = rows
    want = set()
    for k, rs in by_key(data).items():
        reach = -1
        for r in rs:
            if r[2] >= reach:
                want.add(r[1])
                reach = r[2] + 1 + int(r[4] * 9)
    d = df.select("k", "id", "t", (F.col("t") + 1 + F.floor(F.col("v") * 9)).alias("e"))
    got = greedy.keep_non_overlapping(d, ["k"], "t", "e", ["id"], 50, limit).select("id").collect()
    assert {r[0] for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("limit", [0, 2000])
def test_matching(spark, limit):
    rng = random.Random(3)
    edges = [("k", i, j, rng.randrange(20)) for i in range(15) for j in range(15) if rng.random() < 0.5]
    used_i, used_j, want = set(), set(), set()
    for w, i, j in sorted((w, i, j) for _, i, j, w in edges):
        if i not in used_i and j not in used_j:
            used_i.add(i), used_j.add(j), want.add((i, j))
    d = spark.createDataFrame(edges, "k string, i long, j long, w long").select("k", F.col("w").alias("r1"), F.col("i").alias("r2"), F.col("j").alias("r3"), "i", "j")
    got = greedy.match_one_to_one(d, ["k"], "i", "j", ["r1", "r2", "r3"], limit).select("i", "j").collect()
    assert {tuple(r) for r in got} == want


@pytest.mark.parametrize("chunk", CHUNKS)
def test_ema_and_next(rows, chunk):
    data, df = rows
    want = {}
    for rs in by_key(data).values():
        e = None
        for r in rs:
            e = r[4] if e is None else e + 0.3 * (r[4] - e)
            want[r[1]] = e
    got = series.ema(df, ["k"], ["t", "id"], "t", "v", 0.3, "e", chunk).collect()
    assert all(abs(want[r.id] - r.e) < 1e-12 for r in got) and len(got) == len(want)


def test_quantiles(rows):
    import numpy as np

    data, df = rows
    got = {r.k: r for r in quantiles.exact_quantiles(df, ["k"], "v", {"a": 0.5, "b": 0.9, "c": 0.0}, 0.05).collect()}
    for k, rs in by_key(data).items():
        v = [r[4] for r in rs]
        assert np.allclose([got[k].a, got[k].b, got[k].c], np.quantile(v, [0.5, 0.9, 0.0])) and got[k].n == len(v)


def test_halo_windows_are_exact(rows):
    _, df = rows
    a = series.window_mean(df, ["k"], "t", {"m": ("v", -9, 4)}, 13).select("id", F.round("m", 9)).collect()
    b = series.window_mean(df, ["k"], "t", {"m": ("v", -9, 4)}, 100_000).select("id", F.round("m", 9)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_state_boundaries(spark):
    from curbstream.operators.lookup import state_at

    ph = spark.createDataFrame([(1, 0, 10, "red"), (1, 10, 20, "green")], "v long, t0_us long, t1_us long, state string")
    pr = spark.createDataFrame([(1, t) for t in (-1, 0, 9, 10, 19, 20)], "v long, t long")
    got = {r.t: r.state for r in state_at(pr, ph, ["v"], "t", []).collect()}
    assert got == {-1: "unknown", 0: "red", 9: "red", 10: "green", 19: "green", 20: "unknown"}
