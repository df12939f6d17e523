"""Queries over pages equal their comparison SQL on empty, unknown and very long documents."""

import duckdb

import __spark_entry__ as entry

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def both(spark, folder, name, rows):
    """Rows of the query and of its comparison SQL."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    wanted = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    found = entry.queries()[name](spark, str(folder)).select(*columns)
    return sorted(map(tuple, found.collect()), key=repr), sorted(wanted.fetchall(), key=repr)


def test_empty_and_unknown_pages_are_measured(spark, tmp_path):
    rows = [(0, "", "en", "s", 0), (1, None, "en", "s", None), (2, "abc", "en", "s", 3), (3, "a" * 9000, "en", "s", 9000)]
    found, wanted = both(spark, tmp_path, "render_limit_filter", rows)
    assert found == wanted
    assert (0, True, 800, 1) in found


def long_pages(lines):
    return [(k, "\n".join(f"line {i}" for i in range(n)), "en", "s", 9 * n) for k, n in enumerate(lines)]


def test_captions_far_down_a_page_keep_their_targets(spark, tmp_path):
    found, wanted = both(spark, tmp_path, "caption_targets", long_pages([1100, 1001, 40]))
    assert found == wanted
    assert any(verdict == "ok" and int(region.split("-r")[1]) > 1000 for _, region, verdict in found)


def test_boxes_far_down_a_page_are_valid(spark, tmp_path):
    found, wanted = both(spark, tmp_path, "validate_page", long_pages([1100, 1001, 40]))
    assert found == wanted
    assert any(code == "invalid-box" for _, code, _ in found)
