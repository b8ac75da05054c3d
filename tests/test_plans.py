"""What the physical plans must and must not have."""

import re

import pytest

from noticeworks import plans
from tests.compare import DATA


def plan(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_no_cartesian_product(spark, name):
    assert "CartesianProduct" not in plan(plans.QUERIES[name](spark, DATA))


def test_scan_is_pruned_and_filtered(spark):
    text = plan(plans.QUERIES["SRC_01_18_pruned_scan"](spark, DATA))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(l_shipdate.*EqualTo\(l_returnflag,R\)", text)
    assert re.search(r"ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string,l_shipdate:timestamp_ntz>", text)


@pytest.mark.parametrize("name", ["Q_01_notice_list", "SRT_04_price", "SRT_12_work_queue", "SCO_10_18_SRT_09_cosine", "Q_10_agencies_SRT_07"])
def test_pages_are_taken_without_a_full_sort(spark, name):
    assert "TakeOrderedAndProject" in plan(plans.QUERIES[name](spark, DATA))


@pytest.mark.parametrize("name", ["WIN_01_02_latest_version", "WIN_10_top_topics", "JOIN_14_top_keywords", "Q_11_WIN_08_SRT_06_customer_matches"])
def test_ranked_picks_are_limited_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(plans.QUERIES[name](spark, DATA))


#: An automaton walks texts, and JSON of any shape is masked, in Arrow batches.
IN_BATCHES = ("AGG_18", "AGG_19", "SRT_13", "MAP_09_masked_json")


@pytest.mark.parametrize("name", [n for n in plans.QUERIES if n.startswith(("FLT", "SRT", "AGG", "JOIN", "CASE", "MAP")) and not n.startswith(IN_BATCHES)])
def test_relational_queries_stay_out_of_python(spark, name):
    assert not re.search(r"ArrowEvalPython|MapInPandas|BatchEvalPython|FlatMapGroupsInPandas", plan(plans.QUERIES[name](spark, DATA)))


@pytest.mark.parametrize("name", ["AGG_18_JOIN_15_keyword_presence", "AGG_19_keyword_frequency"])
def test_keyword_texts_are_walked_once_and_not_shuffled_on(spark, name):
    """One walk for each text; after it rows hold numbers and terms, no text."""
    text = plan(plans.QUERIES[name](spark, DATA))
    assert text.count(") ArrowEvalPython") == 1 and "BatchEvalPython" not in text
    walk = re.search(r"\((\d+)\) ArrowEvalPython", text)[1]
    after = [m for m in re.finditer(r"\((\d+)\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", text) if int(m[1]) > int(walk)]
    assert after and not any(re.search(r"\b(title|text)#", m[2]) for m in after)


@pytest.mark.parametrize("name", ["WIN_07_neighbours", "Q_05_notice_detail"])
def test_neighbours_come_without_one_partition_for_all(spark, name):
    assert "SinglePartition" not in plan(plans.QUERIES[name](spark, DATA))
