"""Registered queries against their SQL twins, their plans, and results that must not depend on how rows are split."""

import contextlib
import io
import os

import compare
import pytest

import __spark_entry__
import trackloom
from trackloom.plans.sequence import row_index
from trackloom.registry import fixtures

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
#: A part of the queries for a quick run; with ALL_QUERIES=1 all that have SQL are compared.
QUICK = [
    "align_satellites", "apply_cuts_track", "consolidate", "discover_inputs", "display_formats", "duplicate_times", "energy_rate", "enrich_speed",
    "filter_invalid", "global_boundaries", "interpolate_linear", "merge_tracks_bridge", "nmea_tokenize", "quantile_class", "rank_position",
    "read_gpx", "read_igc", "read_kml", "row_index", "sample_dem_nearest", "sidecar_join", "track_bounds", "track_summary", "write_gpx",
]
SQL = __spark_entry__.oracle_sql()
NAMES = sorted(SQL) if os.environ.get("ALL_QUERIES") else [n for n in QUICK if n in SQL]


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, con, name):
    assert not compare.differences(__spark_entry__.queries()[name](spark, SF), con, SQL[name])


@pytest.mark.parametrize("name", ["enrich_speed", "quantile_class", "track_summary"])
def test_plans_have_no_product_of_rows(spark, name):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        __spark_entry__.queries()[name](spark, SF).explain()
    assert "CartesianProduct" not in text.getvalue() and "NestedLoop" not in text.getvalue()


def test_columns_do_not_depend_on_the_size(spark):
    points = row_index(fixtures.track(spark, SF))
    whole = trackloom.enrich_speed(points)
    spark.conf.set("trackloom.targetRows", "20")
    try:
        parts = trackloom.enrich_speed(points)
        assert parts.columns == whole.columns
        rows = [sorted(str(r) for r in df.collect()) for df in (whole, parts)]
    finally:
        spark.conf.unset("trackloom.targetRows")
    assert rows[0] == rows[1]


def test_entry_has_every_query_with_sql():
    assert set(SQL) <= set(__spark_entry__.queries())
