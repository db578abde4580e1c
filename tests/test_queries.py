"""Registered queries against their SQL on the smallest tables. All of them: ``python tests/oracle.py``."""
import pytest
from oracle import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["runs", "merge_intervals", "postprocess_segments", "greedy_nonoverlap", "tiou_match", "score_b", "average_precision", "interval_lookup", "validate_segments", "split_tracks", "track_kinematics", "stationary_episodes", "road_cells", "rule_red_light"]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, con, name):
    ok, msg, diff = compare(spark, con, queries()[name], oracle_sql()[name], FOLDER)
    assert ok, (msg, diff)


def test_entry(spark):
    assert entry(spark).count() > 0
    assert set(oracle_sql()) <= set(queries())
