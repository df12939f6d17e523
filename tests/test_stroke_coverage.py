"""Slots covered by the union of a band's strokes."""

import random

from twinfold.operators import layout as la


def _state(strokes, low, high):
    met = sorted((a, b) for a, b in strokes if a < high and b > low)
    if not met:
        return 0
    at = low
    for a, b in met:
        if a > at:
            return -1
        at = max(at, b)
    return 1 if at >= high else -1


def test_coverage_equals_the_plain_sweep_without_sorting_slots(spark):
    rng = random.Random(4)
    strokes = [(b, float(a), float(a + rng.choice([0, 2, 5, 9]))) for b in range(40) for a in rng.choices(range(60), k=rng.randrange(12))]
    slots = [(b, s, 4.0 * s, 4.0 * s + rng.choice([4, 7])) for b in range(40) for s in range(15)]
    df = la.stroke_coverage(
        spark.createDataFrame(strokes, "band_id int, low double, high double"), spark.createDataFrame(slots, "band_id int, slot_id int, low double, high double")
    )
    wanted = {(b, s): _state([(x, y) for c, x, y in strokes if c == b], low, high) for b, s, low, high in slots}
    assert {(r.band_id, r.slot_id): r.coverage for r in df.collect()} == wanted
    assert set(wanted.values()) == {-1, 0, 1}
    windows = [line for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "windowspecdefinition" in line]
    assert windows and not any("slot_id" in line for line in windows)
