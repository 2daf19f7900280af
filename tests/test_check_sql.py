"""Registered queries against the check engine.

A broad subset runs by default; CHROMATILE_ALL=1 runs every query.
"""

import os

import pytest
from conftest import SF
from oracle import compare, connect

from chromatile.plans import load

QUERIES, ORACLES = load()
DEFAULT = (
    "coverage_by_color color_features lab_to_rgb parse_color_text exact_fill grain_fill apply_tone remap_boxes nearest_other"
    " range_stats bin_edges_even label_bins white_patch tone_fit elbow_k drop_range load_catalog load_presets load_sessions"
    " palette_manifest box_mean morphology seam_mismatch resize mesh_warp pin_edges period_fill walk_tree sync_ranges"
    " stack_composite recent_colors debounce"
).split()
NAMES = sorted(ORACLES) if os.environ.get("CHROMATILE_ALL") else DEFAULT


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_check_sql(spark, con, name):
    message, _ = compare(spark, con, SF, name, QUERIES[name], ORACLES[name])
    assert message == ""


def test_every_check_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) >= 100
