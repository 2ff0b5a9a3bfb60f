"""Registered queries against their SQL on the smallest tables: a sample of every family.

``python check.py SF_DIR`` compares all of them.
"""

import pytest

import __spark_entry__ as contract
from check import compare, connect

SF = "/root/testdata/sf0.001"
NAMES = [
    "flagship_stick_posteriors", "s1_series_observations", "s2_document_terms", "s3_clustering_csv",
    "s5_wide_frame", "p2_one_hot_dense", "p7_input_checks",
    "a4_cluster_topics", "a7_fixed_histogram",
    "a11_batch_standard_error", "w3_log_pmf_triangle", "w6_moved_labels",
    "w7_neighbour_candidates", "m14_joint_score",
    "m18_leave_one_out", "m21_validation_table", "t3_gumbel_resample",
    "ps1_weighted_co_occurrence", "ps3_information_losses", "ps4_rand_over_draws",
    "j4_younger_clusters_between", "g1_recent_random_start",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    line = compare(spark, con, name, SF)
    assert line.startswith("ok"), line


def test_contract(spark):
    assert contract.entry(spark).columns
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", ["m5_count_predictive", "m18_leave_one_out_counts"])
def test_line_items_are_counted_once(spark, name):
    """Predictives read the counts many times, so they come from a written table."""
    assert not any("lineitem" in path for path in contract.queries()[name](spark, SF).inputFiles())
