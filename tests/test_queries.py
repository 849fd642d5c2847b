"""Registered queries against their SQL twins on the smallest tables."""

from pathlib import Path

import pytest
from compare import differences, open_tables

from checks import QUERIES, SQL

SF_DIR = "/root/testdata/sf0.001"
# One query per area; `tests/compare.py` runs them all.
NAMES = (
    "iqr_ranked csv_ingestion model_features category_metrics box_stats rank_anomalies top_global waterfall_table "
    "sample_per_category knn_join lof_train_scores windowed_flag_counts"
).split()


@pytest.fixture(scope="module")
def con():
    if not Path(SF_DIR).exists():
        pytest.skip("tables not present")
    return open_tables(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    assert differences(spark, con, SF_DIR, name, QUERIES[name], SQL[name]) is None


def test_every_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)
