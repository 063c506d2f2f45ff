"""A sample of the registered queries against their SQL on the smallest tables."""

from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
SAMPLE = ["g1_dedupe_keep_first", "g3_merge_cached_live", "g4_propagate_by_molecule", "j2_search_many", "j4_country_gap_rows", "w4_page_of_queries", "k2_upsert_products", "t2_stream_progress", "d13_enrich_rows"]


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, name):
    from oracle import compare, connect

    from rxatlas.plans import catalog

    if not catalog.QUERIES:
        catalog.load()
    ok, message, _ = compare(spark, connect(SF), name, SF)
    assert ok, message


def test_every_sql_has_a_query():
    from rxatlas.plans import catalog

    if not catalog.QUERIES:
        catalog.load()
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 150
