"""Scans read their input twice, so lookups hand them tables and not what joins or other scans would make again."""
from curbstream.operators import lookup


def test_lookups_scan_tables(spark, monkeypatch):
    seen, scan = [], lookup.ordered_scan
    monkeypatch.setattr(lookup, "ordered_scan", lambda d, *a: seen.append(d) or scan(d, *a))
    samples = spark.createDataFrame([(1, 0, "R"), (1, 10, "R"), (1, 20, "G"), (2, 5, "G")], "k long, t long, s string")
    probes = spark.createDataFrame([(1, 15), (1, 25), (2, 4), (2, 6), (3, 1)], "k long, t long")
    phases = lookup.phases_from_samples(samples, ["k"], "t", "s", [], 10, 7)
    got = lookup.state_at(probes, phases, ["k"], "t", [], chunk_us=7)
    assert sorted(tuple(r) for r in got.collect()) == sorted([(1, 15, "R", 0), (1, 25, "G", 20), (2, 4, "unknown", None), (2, 6, "G", 5), (3, 1, "unknown", None)], key=tuple)
    assert len(seen) == 3 and all(d.inputFiles() for d in seen[1:])
