"""Driver contract: entry() runs, every oracle key is a query, oracles agree on sf0.001."""

import os
import sys

import pytest

SF = "/root/testdata/sf0.001"
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["line_no", "line"] and df.count() > 0
    qs, orc = E.queries(), E.oracle_sql()
    assert set(orc) <= set(qs)
    assert len(qs) >= 90


FAST = ["window_query", "digest", "group_by_topic", "index_order", "ingest_feed", "ingest_listing", "ingest_video",
        "validate_record", "first_valid_attempt", "normalize_entities", "status_tier", "throttle_wait", "leak_scan",
        "scan_feed", "main_text", "sanitize_title", "stream_index", "union_adapters"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
@pytest.mark.parametrize("name", FAST)
def test_oracle_small(spark, name):
    import __spark_entry__ as E
    from oracle_check import compare, duck
    r = compare(spark, duck(SF), name, E.queries()[name], E.oracle_sql().get(name), SF)
    assert r.get("ok") is True, r
