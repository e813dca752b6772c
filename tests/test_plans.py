"""Shapes of physical plans that matter at scale."""

import pytest

from jobloom.plans import QUERIES


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["win_top10_vac", "jn_com_detail"])
def test_top_n_is_limited_before_the_shuffle(spark, small, key):
    assert "WindowGroupLimit" in physical(QUERIES[key](spark, small))


def test_filter_and_columns_reach_the_scan(spark, small):
    text = physical(QUERIES["flt_active"](spark, small))
    assert "PushedFilters: [IsNotNull(o_orderstatus)" in text or "o_orderstatus" in text.split("PushedFilters")[1][:120]
    assert "o_totalprice" not in text.split("ReadSchema")[1]


@pytest.mark.parametrize("key", ["lim_page", "top_companies", "agg_top_tech"])
def test_sorted_pages_keep_only_the_page(spark, small, key):
    assert "TakeOrderedAndProject" in physical(QUERIES[key](spark, small))


NATIVE = ["win_latest", "win_industry_pct", "agg_company_metrics", "jn_dup_pairs", "txt_tech", "txt_noise", "sc_overall", "up_vacancy", "hsh_content"]


@pytest.mark.parametrize("key", NATIVE)
def test_no_python_and_no_product(spark, small, key):
    text = physical(QUERIES[key](spark, small))
    for word in ("Python", "InPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in text


@pytest.mark.parametrize("key", ["win_latest", "win_dedup_analysis", "jn_ttl_lookup", "cdc_ttl", "cdc_changed", "up_source", "top_companies"])
def test_picks_are_limited_before_the_shuffle_and_pruned(spark, small, key):
    text = physical(QUERIES[key](spark, small))
    assert "WindowGroupLimit" in text
    if key in ("jn_ttl_lookup", "cdc_ttl"):
        assert "html" not in text
    else:
        assert "SortAggregate" not in text


PAGE_KEYS = sorted(k for k in QUERIES if k.startswith("pg_") and k not in ("pg_spa", "pg_job_detail", "pg_pipeline"))


@pytest.mark.parametrize("key", PAGE_KEYS)
def test_pages_are_read_once(spark, small, key):
    assert physical(QUERIES[key](spark, small)).count("MapInPandas") == 1


@pytest.mark.parametrize("key", ["sc_vacancy", "rg_score_fn"])
def test_a_rank_over_all_rows_is_not_one_task(spark, small, key):
    assert "SinglePartition" not in physical(QUERIES[key](spark, small))


@pytest.mark.parametrize("key", ["jn_semi_analysis", "jn_anti_analysis", "jn_semi_open"])
def test_existence_tests_shrink_child_keys_first(spark, small, key):
    text = physical(QUERIES[key](spark, small))
    assert "HashAggregate" in text and "CartesianProduct" not in text
