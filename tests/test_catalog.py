import pytest

import __spark_entry__ as entry_points
from check import connect, differences
from motifline.catalog import oracles, queries

SAMPLE = ["grouped_csv", "group_kfold", "fold_roles", "pca_apply", "explain_path", "path_summary", "mcnemar_aligned", "robustness"]


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_oracle_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    without = set(queries.queries()) - set(oracles.oracle_sql())
    assert without == {"reconstruction_error_100", "detect_windows_100", "robustness_windows"}


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["event_type", "steps", "accuracy", "precision", "recall", "f1"]
    assert df.count() == 5


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, sf, con, name):
    assert differences(entry_points.queries()[name](spark, sf), con, entry_points.oracle_sql()[name]) == ""
