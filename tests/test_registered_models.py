"""The model queries end with the library's own parameters; their answers to a planted rule are compared with SQL in test_oracle."""

import time

import pytest

from checks import models as registered
from checks.base import QUERIES

FOLDER = "/root/testdata/sf0.001"
SECONDS = 240  # for one query on 6,000 rows, on a slow machine


def test_production_parameters():
    assert dict(registered.SETTINGS.parameters) == {}
    full = registered.models.DEFAULTS
    assert full["random_forest"]["n_estimators"] == full["gbt"]["n_estimators"] == 100
    assert (full["random_forest"]["max_depth"], full["svm"]["kernel"]) == (20, "rbf")


@pytest.mark.parametrize("name, rows", [("rf_score", None), ("tree_importance", 5), ("search_report", 10), ("cv_report", 5)])
def test_queries_end(spark, name, rows):
    started = time.monotonic()
    found = QUERIES[name](spark, FOLDER).collect()
    assert time.monotonic() - started < SECONDS
    assert len(found) == (rows or spark.read.parquet(f"{FOLDER}/lineitem.parquet").count())
    if name == "rf_score":
        assert all(0 <= r.probability <= 1 for r in found)
    if name == "search_report":
        assert all(0 < r.mean_average_precision <= 1 for r in found)
