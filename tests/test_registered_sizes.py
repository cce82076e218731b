"""The model queries are registered with the sizes of the original analysis; the operators are stopped before they run."""

import inspect
import os

import pytest

import __spark_entry__ as entry
from staylens.operators import segments, topics, trees
from staylens.plans import hosts, occupancy, reviews

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not there")

LDA = {"k": 40, "max_iter": 50}
BOOSTED = {"max_iter": 100, "max_depth": 6}
SIZES = [
    ("elbow", segments, "elbow", {"ks": range(2, 21), "nstart": 5, "max_iter": 25}),
    ("impute_pmm", segments, "impute_pmm", {"maxit": 5}),
    ("host_segments", hosts, "host_segments", {"k": 7, "nstart": 5, "maxit": 5}),
    ("gbt_importance", trees, "gbt_multiclass", BOOSTED),
    ("shapley_values", trees, "gbt_multiclass", BOOSTED),
    ("occupancy_model", occupancy, "occupancy_model", {"max_iter": 100}),
    ("lda_topics", topics, "lda", LDA),
    ("lda_document_topics", topics, "lda", LDA),
    ("complaint_impact", reviews, "complaint_topics", LDA),
    ("topic_search", topics, "topic_search", {"ks": range(5, 101, 5), "sweeps": 60}),
]


class Called(Exception):
    pass


@pytest.mark.parametrize("name, module, operator, wanted", SIZES, ids=[f"{s[0]}-{s[2]}" for s in SIZES])
def test_sizes(spark, monkeypatch, name, module, operator, wanted):
    sign = inspect.signature(getattr(module, operator))

    def stop(*args, **kwargs):
        bound = sign.bind(*args, **kwargs)
        bound.apply_defaults()
        raise Called({k: bound.arguments[k] for k in wanted})

    monkeypatch.setattr(module, operator, stop)
    with pytest.raises(Called) as e:
        entry.queries()[name](spark, FOLDER)
    assert e.value.args[0] == wanted
