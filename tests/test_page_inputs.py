"""Derived pages and table bands: line items are numbered once, text rows are folded once."""

import pytest

from twinfold.operators import bands
from twinfold.plans import tables

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id long, frag_id long, text string, x double, y double, width double, height double, page_width double"


@pytest.mark.parametrize("name", ["page_tables", "rules", "ruled_texts", "scaffold_texts"])
def test_pages_of_numbered_lines_hold_the_same_rows(spark, name):
    numbered = tables.relation(spark, SF, name, tables.numbered_lines(spark, SF))
    whole = tables.relation(spark, SF, name)
    assert numbered.schema == whole.schema
    assert numbered.exceptAll(whole).isEmpty() and whole.exceptAll(numbered).isEmpty()
    assert "Window" not in numbered._jdf.queryExecution().optimizedPlan().toString()


def test_bands_fold_rows_once(spark, monkeypatch):
    calls = []
    fold = bands.group_rows
    monkeypatch.setattr(bands, "group_rows", lambda items, *keys: calls.append(1) or fold(items, *keys))
    cells = [(1, 0, "TABLE 1. Doses", 30.0, 100.0, 100.0, 10.0, 640.0)]
    cells += [(1, 10 + c, f"Column {c}", 30.0 + 140 * c, 120.0, 60.0, 10.0, 640.0) for c in range(4)]
    cells += [(1, 100 * r + c, str(r + c), 30.0 + 140 * c, 120.0 + 20 * r, 50.0, 10.0, 640.0) for r in range(1, 4) for c in range(4)]
    cells += [(1, 1000, "TABLE 1 shows that", 30.0, 600.0, 100.0, 10.0, 640.0)]
    found = [tuple(r) for r in bands.table_bands(spark.createDataFrame(cells, SCHEMA)).collect()]
    assert found == [(1, 99.0, 192.0, 3)]
    assert len(calls) == 1
