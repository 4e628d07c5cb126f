"""Registered queries against their SQL at sf0.001.

By default one query per operator family; TRUSTFRAME_ALL=1 runs all of them.
"""

import os

import compare
import pytest

import __spark_entry__ as entry_points
from trustframe import checks

SF = "/root/testdata/sf0.001"
checks.load_all()
FAMILIES = """load_features class_count duplicate_listing dedupe cleaned_dataset report feature_scores label_encode minmax_scale
dataset_tags dataset_select_all pending_work capped_sample stratified_split kfold stratified_bootstrap oversample
undersampled_folds permute_labels random_subspaces weighted_subspaces_worst f1_weighted mcc balanced_accuracy_closed roc_auc
average_precision cv_scores ttest_corrected paired_conclusions global_ranks score_table gnb_subspaces radius_kernel
knn_fractional nearest_parts pair_tables diversity_summary redundancy_probe association_score association_status
similarity_detail random_subspace_vote umce_vote_contrast wilcoxon resampling_bac robust_vote dynamic_union
dynamic_eliminate mask_quality monte_carlo_min memory_buffer budget_active budget_combined""".split()
NAMES = list(checks.QUERIES) if os.environ.get("TRUSTFRAME_ALL") else FAMILIES


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    _, _, problem = compare.check(spark, con, name, checks.QUERIES[name], checks.ORACLES.get(name), SF)
    assert problem is None


def test_entry(spark):
    assert entry_points.entry(spark).count() == 1
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
