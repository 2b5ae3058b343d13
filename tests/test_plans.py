"""What the optimizer makes of the queries: narrow scans, pushed filters, no cartesian products, no stray Python."""

import io
import re
from contextlib import redirect_stdout
from importlib import import_module

import __spark_entry__ as entry
import pytest

QUERIES = {n: q for m in entry.CORE for n, q in import_module(f"minegrove.plans.{m}").QUERIES.items()}
#: Queries whose operators need Python workers or fit models.
WITH_PYTHON = {"son_candidates", "edge_betweenness", "girvan_newman", "gbt_predict", "hybrid_predict", "bfr_assignments", "bfr_rounds", "bfr_nearest"}
#: The columns that some scans may read at most.
COLUMNS = {
    "review_summary": {"review": {"user_id", "business_id", "date"}},
    "top10_users": {"review": {"user_id"}},
    "city_avg_stars": {"review": {"business_id", "stars"}, "business": {"business_id", "city"}},
    "partition_profile": {"review": {"business_id"}},
    "bloom_fpr": {"orders": {"o_custkey", "o_orderkey"}},
    "transaction_baskets": {"orders": {"o_orderkey", "o_custkey", "o_orderdate"}, "lineitem": {"l_orderkey", "l_partkey"}},
    "p1_found": {"yelp_val": {"val_id", "user_id", "business_id", "rated_at"}, "yelp_user": {"user_id", "created_at", "deleted_at"}},
    "p4_found": {"review": {"review_id", "user_id", "business_id", "date"}},
}


def plan(frame):
    out = io.StringIO()
    with redirect_stdout(out):
        frame.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WITH_PYTHON))
def test_no_cartesian_product_and_no_python(name, spark, data):
    text = plan(QUERIES[name](spark, data))
    assert "CartesianProduct" not in text
    assert not re.search(r"Python|Pandas|MapInArrow", text)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_scans_are_narrow(name, spark, data):
    text = plan(QUERIES[name](spark, data))
    scans = re.findall(r"Location: \w+ \[[^\]]*/(\w+)\.parquet\].*?ReadSchema: struct<([^>]*)>", text, re.S)
    assert set(COLUMNS[name]) <= {location for location, _ in scans}
    for location, schema in scans:
        if location in COLUMNS[name]:
            assert {c.split(":")[0] for c in schema.split(",") if c} <= COLUMNS[name][location]


def test_year_filters_run_in_the_scan_stage(spark, data):
    text = plan(QUERIES["cold_start_anti"](spark, data))
    assert "PushedFilters" in text and "IsNotNull" in text
