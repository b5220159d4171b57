"""Registered queries against their SQL on the smallest tables; ``tests/oracle.py`` compares all of them."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
SUBSET = ("c03_drop_parked", "c05_one_box_per_ball", "t06_descent_runs", "t09_whole_flight", "g07_rejections", "g13_event_index", "a01_ballistic_fit",
          "p01_point_in_polygon", "p09_facing", "i05_hue_vote", "i07_overlap_groups", "b03_releases", "m02_nearest_first", "m04_nearest_mark", "m08_label_claims",
          "e04_threshold_f1", "e19_auc_and_confusion", "s01_scan_round_trip", "s05_notes_to_key", "st02_window_counts")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", SUBSET)
def test_equals_sql(spark, con, name):
    ok, n, note = compare(spark, con, FOLDER, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, note
    assert n > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_unknown_site_fails(spark):
    from flightline.operators import sites
    rows = spark.createDataFrame([("a", 1), ("z", 2)], "video string, v long")
    dim = spark.createDataFrame([("a", 5.0)], "video string, rim double")
    with pytest.raises(sites.UnknownSite):
        sites.require_sites(rows, dim, ["video"])
    with pytest.raises(Exception, match="no measured site for z"):
        sites.with_sites(rows, dim, ["video"]).collect()
