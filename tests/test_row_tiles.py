"""Text rows over tiles of y: rows that lie across tiles, and how often fragments are dealt."""

import random

from twinfold.operators import layout as la

SCHEMA = "page_id long, frag_id long, text string, x double, y double, width double, height double, page_width double"


def _plain(items):
    found, row = {}, None
    for f in sorted(items, key=lambda f: (f[4], f[3], f[1])):
        if row is None or not abs(row[4] - f[4]) < min(row[6], f[6]) * 0.45:
            row = f
        found[f[1]] = row[1]
    return found


def _page(page, lines, pitch, slope, rng):
    return [
        (page, line * 100 + w, f"w{w}", 30.0 * w, pitch * line + slope * w - 2, 25.0, rng.choice([6.0, 9.0, 12.0]), 640.0)
        for line in range(lines)
        for w in range(rng.randrange(1, 12))
    ]


def test_rows_across_tiles_equal_the_plain_fold(spark):
    rng = random.Random(3)
    rows = []
    for page, (pitch, slope) in enumerate([(20.0, 0.3), (512.0, 0.5), (256.0, 3.0), (16.0, 2.0), (5.0, 1.0), (1.0, 0.1)]):
        rows += _page(page, 150, pitch, slope, rng)
    got = la.group_rows(spark.createDataFrame(rows, SCHEMA)).collect()
    found = {(r.page_id, r.frag_id): r.row_frag for r in got}
    wanted = {(p, f): a for p in range(6) for f, a in _plain([r for r in rows if r[0] == p]).items()}
    assert found == wanted and len(got) == len(rows)
    tiles = {}
    for r in got:
        tiles.setdefault((r.page_id, r.row_frag), set()).add(r.row_tile)
    assert all(len(t) == 1 for t in tiles.values())


def test_lines_deal_fragments_once(spark):
    df = spark.createDataFrame(_page(1, 50, 20.0, 0.3, random.Random(1)), SCHEMA)
    plan = la.line_text(la.group_rows(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_gutters_take_few_shuffles(spark):
    df = spark.createDataFrame(_page(1, 50, 20.0, 0.3, random.Random(1)), SCHEMA)
    plan = la.find_gutter(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") < 80


def test_one_column_pages_are_dealt_for_rows_and_for_numbers(spark):
    df = spark.createDataFrame(_page(1, 50, 20.0, 0.3, random.Random(1)), SCHEMA)
    none = spark.createDataFrame([], "page_id bigint, cut double")
    plan = la.reading_order(df, none)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") < 12
