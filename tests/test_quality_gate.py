import os

from twinfold.plans import sides

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


def test_texts_are_searched_once_for_failures(spark):
    gate = sides.quality_gate(spark, FOLDER)
    found, passed = sides._anchors(spark, FOLDER)
    wanted = {}
    for r in found.where("not found and case_id % 2 <> 0").collect():
        wanted[r.case_id, "anchor"] = wanted.get((r.case_id, "anchor"), 0) + 1
    for r in passed.where("not passed and case_id % 3 = 0").collect():
        wanted[r.case_id, "order"] = wanted.get((r.case_id, "order"), 0) + 1
    assert wanted and {(r.case_id, r.kind): r.failures for r in gate.collect()} == wanted
    assert gate._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 0
