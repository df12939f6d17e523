"""Panel roles: fragments meet their panels in one join, and the guards leave the texts where they are."""

import random

from pyspark.sql import functions as F

from twinfold.operators import geometry as ge

SCHEMA = "page_id long, frag_id long, text string, x double, y double, width double, height double"
BOXES = "page_id long, panel int, x double, y double, width double, height double"


def _boxes(rng, pages, many, sizes):
    return [(p, k, rng.choice([0.0, 100.0]), float(rng.randrange(0, 2000)), rng.choice(sizes), rng.choice(sizes)) for p in range(pages) for k in range(many)]


def _inputs(spark):
    rng = random.Random(11)
    frags = [(p, i, "word", float(rng.randrange(0, 500)), float(rng.randrange(-50, 2300)), 40.0, rng.choice([12.0, 12.0, 256.0, 700.0])) for p in range(4) for i in range(150)]
    panels = _boxes(rng, 3, 5, [300.0, 620.0])
    insets = _boxes(rng, 3, 4, [120.0, 400.0])
    return frags, panels, insets, [spark.createDataFrame(rows, schema) for rows, schema in ((frags, SCHEMA), (panels, BOXES), (insets, BOXES))]


def _role(f, panels, insets):
    holds = lambda a: a[2] <= f[3] and a[3] <= f[4] and a[2] + a[4] >= f[3] + f[5] and a[3] + a[5] >= f[4] + f[6]
    beside = lambda a: f[4] < a[3] + a[5] and f[4] + f[6] > a[3]
    meets = lambda a: beside(a) and f[3] < a[2] + a[4] and f[3] + f[5] > a[2]
    own = [a for a in panels if a[0] == f[0] and holds(a)]
    if not own:
        return None, "reject" if any(beside(a) for a in panels if a[0] == f[0]) else "outside"
    panel = min(a[1] for a in own)
    aside = [a for a in insets if a[0] == f[0] and a[1] == panel]
    if len(own) > 1:
        return panel, "reject"
    return panel, "glossary" if any(map(holds, aside)) else "reject" if any(map(meets, aside)) else "main"


def test_roles_equal_the_plain_rules_for_low_and_tall_fragments(spark):
    frags, panels, insets, tables = _inputs(spark)
    found = {(r.page_id, r.frag_id): (r.panel, r.role) for r in ge.panel_ownership(*tables).collect()}
    wanted = {(f[0], f[1]): _role(f, panels, insets) for f in frags}
    assert found == wanted
    assert {role for _, role in wanted.values()} == {"main", "glossary", "reject", "outside"}


def test_guards_read_low_fragments_once(spark):
    _, _, _, (frags, panels, insets) = _inputs(spark)
    frags = frags.withColumn("height", F.lit(12.0))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        guards = ge.panel_guards(ge.panel_ownership(ge.guard_marks(frags), panels, insets), panels, insets, 620.0)
        prepared = guards._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum("Scan ExistingRDD" in line and "frag_id" in line for line in prepared.splitlines()) == 1
