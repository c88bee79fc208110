"""The association queries fit every feature of the table."""

import pytest

from loomstat import catalogue


@pytest.mark.parametrize("name,models", [("associations_continuous", 2), ("associations_binary", 1), ("associations_survival", 1), ("associations_grouped", 1)])
def test_all_features_are_fitted(spark, sf, name, models):
    got = catalogue.QUERIES[name](spark, sf).toPandas()
    assert len(got) == 64 * models and got.groupby("model").feature.nunique().eq(64).all()
    assert got.status.eq("ok").all()
