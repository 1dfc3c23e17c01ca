"""The physical plans are the ones meant."""

import os
import re

import pytest

import catalog

SF_DIR = "/root/testdata/sf0.001"
catalog.load_all()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not found")

# Block products and fitted models work in Arrow batches; everything else stays in the JVM.
IN_ARROW = {
    "pairwise_count",
    "pairwise_count_grouped",
    "pairwise_cor",
    "q_cor_graph",
    "pairwise_distance",
    "index_silhouette",
}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_no_product_and_no_python(spark, name):
    text = plan(catalog.QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|PythonUDF", text)
    if name not in IN_ARROW:
        assert not re.search(r"InPandas|InArrow", text)


def test_only_needed_columns_are_read(spark):
    text = plan(catalog.QUERIES["q_top_words"](spark, SF_DIR))
    schemas = set(re.findall(r"ReadSchema: struct<([^>]*)>", text))
    assert schemas == {"text:string"}


def test_filters_reach_the_scan(spark):
    text = plan(catalog.QUERIES["filter_cmp"](spark, SF_DIR))
    assert "GreaterThan(l_quantity,30.0)" in text and "LessThanOrEqual(l_di" in text  # Spark cuts long lists


def test_top_n_is_pruned_in_every_task(spark):
    assert "WindowGroupLimit" in plan(catalog.QUERIES["topn_group"](spark, SF_DIR))
    assert "TakeOrderedAndProject" in plan(catalog.QUERIES["topn_global"](spark, SF_DIR))
