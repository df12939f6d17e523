"""Fragments of pages that come from one order or one document are dealt once, however often they are grouped."""

import pytest

import __spark_entry__ as entry
from twinfold.operators import flows
from twinfold.plans import tables
from twinfold.session import cut_lineage, together

SF = "/root/testdata/sf0.001"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_checkpoints_know_how_rows_lie(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    with together(spark):
        kept = cut_lineage(spark.range(100).selectExpr("id % 7 as page_id", "id as n").repartition(4, "page_id"))
    assert spark.conf.get("spark.sql.adaptive.enabled") == before
    assert exchanges(kept.groupBy("page_id", "n").count()) == 0


def test_pages_of_line_items_stay_together(spark):
    numbered = tables.numbered_lines(spark, SF)
    for name in ("page_tables", "rules", "ruled_texts", "scaffold_rules", "scaffold_texts"):
        assert exchanges(tables.relation(spark, SF, name, numbered).groupBy("page_id", "y").count()) == 0


def test_reading_in_one_column_deals_no_fragments(spark):
    assert exchanges(entry.queries()["reading_order_single"](spark, SF)) == 0


def test_page_texts_deal_documents_and_no_words(spark):
    plan = entry.queries()["page_text"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "REPARTITION_BY_NUM" not in line] == []
    assert "Join" not in plan


@pytest.mark.parametrize("name", ["reading_order_two", "fragment_coverage"])
def test_reading_in_two_columns_deals_no_fragments(spark, monkeypatch, name):
    seen, read = [], flows.read_pages

    def watched(*args):
        lines = read(*args)
        seen.append([x for x in lines._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x])
        return lines

    monkeypatch.setattr(flows, "read_pages", watched)
    assert entry.queries()[name](spark, SF).count() > 0
    assert seen == [[]]
