from twinfold.operators import validation as va

SCHEMA = "table_id long, cell_id string, role string, header_ids array<string>"
ROWS = [
    # a cycle of three, a repeated reference and one cell given twice
    (1, "a", "header", ["c"]), (1, "b", "header", ["a", "a"]), (1, "c", "header", ["b"]), (1, "c", "header", ["b"]),
    # itself, a value, a cell that is not there; the header it may refer to
    (2, "a", "header", ["a"]), (2, "b", "value", ["a", "c", "x"]), (2, "c", "value", []),
    # a chain is no cycle; a cell without an id refers to nothing
    (3, "a", "header", []), (3, "b", "header", ["a"]), (3, "d", "value", ["b"]), (3, None, "value", ["a"]),
    # no reference at all, and null lists
    (4, "a", "header", []), (5, "a", "header", None),
]


def test_header_references_meet_the_headers_once(spark):
    found = va.header_cycles(spark.createDataFrame(ROWS, SCHEMA))
    assert {r.table_id: (r.invalid_targets, r.cyclic) for r in found.collect()} == {1: (0, True), 2: (3, False), 3: (1, False)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1, plan
