import pytest

import __spark_entry__ as entry
from auditloom import catalog_queries
from auditloom.operators import catalog, page_rules, site_rules
from tests.oracle import same


def test_seventy_two_rules_once_each():
    ids = [r.id for r in page_rules.RULES] + [r.id for r in site_rules.RULES]
    assert len(ids) == len(set(ids)) == 72
    assert len(page_rules.RULES) == 35


def test_overrides(spark):
    i = spark.createDataFrame([("HTTP-5XX", "critical"), ("CONTENT-THIN", "high")], "rule_id string, severity string")
    got = catalog.apply_overrides(i, {"disable": ["http-5xx"], "severity": {"content-thin": "low"}}).collect()
    assert [tuple(r) for r in got] == [("CONTENT-THIN", "low")]
    with pytest.raises(ValueError):
        catalog.check_overrides({"disable": ["HTTP-5XX"], "severity": {"HTTP-5XX": "low"}})
    with pytest.raises(ValueError):
        catalog.check_overrides({"disable": ["NO-SUCH"]})


@pytest.mark.parametrize("name", ["page_meta_title_too_short", "page_content_thin", "url_normalize", "links_extract", "title_pixels", "http_404_internal", "http_redirect_chain", "index_orphan", "canon_chain", "asset_broken", "click_depth", "diff_status", "site_title_duplicate"])
def test_oracle(spark, name):
    folder = "/root/testdata/sf0.01"
    same(catalog_queries.QUERIES[name](spark, folder), catalog_queries.ORACLE_SQL[name], folder)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["url", "title", "pages"]
    df.collect()
    assert set(entry.oracle_sql()) <= set(entry.queries())
