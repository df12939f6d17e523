"""Small fixtures against brute force or hand-made results."""

import io
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from twinfold.operators import evaluation as ev
from twinfold.operators import geometry as ge
from twinfold.operators import graph
from twinfold.operators import layout as la
from twinfold.operators import ledger as lg
from twinfold.operators import units as un
from twinfold.sources import markup, packages, replies, sinks
from twinfold.streaming import qc_stream, stateful


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_cycles_on_long_chain_and_branches(spark):
    chain = [("chain", i, i + 1) for i in range(300)]
    ring = [("ring", i, (i + 1) % 7) for i in range(7)]
    tree = [("tree", 0, 1), ("tree", 0, 2), ("tree", 1, 3), ("tree", 2, 3)]
    tail = [("tail", 0, 1), ("tail", 1, 2), ("tail", 2, 1), ("tail", 2, 3), ("tail", 3, 4)]
    self_loop = [("self", 5, 5)]
    e = spark.createDataFrame(chain + ring + tree + tail + self_loop, "g string, src int, dst int")
    assert rows(graph.cycle_groups(e, "g")) == [("ring",), ("self",), ("tail",)]


def test_chain_positions(spark):
    nodes = spark.createDataFrame([(1, i) for i in range(40)] + [(2, i) for i in range(3)], "g int, n int")
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(39)] + [(2, i, (i + 1) % 3) for i in range(3)], "g int, src int, dst int")
    got = rows(graph.chain_positions(nodes, edges, "g", "n"))
    assert got == [(1, i, 0, i) for i in range(40)]


def test_components(spark):
    nodes = spark.createDataFrame([(1, i) for i in range(60)], "g int, n int")
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(30)] + [(1, 40, 55), (1, 55, 41)], "g int, src int, dst int")
    got = {n: c for _, n, c in rows(graph.components(nodes, edges, "g", "n"))}
    assert all(got[i] == 0 for i in range(31))
    assert (got[40], got[41], got[55], got[33]) == (40, 40, 40, 33)


def _fold_rows(items):
    """Plain fold over one page, the definition of a text row."""
    out, last = {}, None
    for f, x, y, h in sorted(items, key=lambda i: (i[2], i[1], i[0])):
        if last is None or not abs(last[2] - y) < min(last[3], h) * 0.45:
            last = (f, x, y, h)
        out[f] = last[0]
    return out


def test_group_rows_is_a_fold_not_a_lag(spark):
    import random

    rnd = random.Random(5)
    items = [(i, round(rnd.uniform(0, 500), 1), round(rnd.uniform(0, 900), 1), rnd.choice([8.0, 12.0, 30.0])) for i in range(400)]
    slope = [(1000 + i, 10.0 * i, 2000.0 + 3.0 * i, 12.0) for i in range(20)]
    df = spark.createDataFrame([(1, i, "w", x, y, 5.0, h) for i, x, y, h in items + slope], "page_id int, frag_id bigint, text string, x double, y double, width double, height double")
    got = {r.frag_id: r.row_frag for r in la.group_rows(df).collect()}
    assert got == _fold_rows(items + slope)


def test_reading_order_two_columns_with_separator(spark):
    frags = [
        ("Title across", 20, 0, 360), ("left one", 10, 30, 80), ("right one", 220, 30, 80), ("left two", 10, 50, 80), ("right two", 220, 50, 80),
        ("Break across", 20, 80, 360), ("left three", 10, 110, 80), ("right three", 220, 110, 80),
    ]
    df = spark.createDataFrame([(1, i, t, float(x), float(y), float(w), 12.0) for i, (t, x, y, w) in enumerate(frags)], "page_id int, frag_id bigint, text string, x double, y double, width double, height double")
    cut = spark.createDataFrame([(1, 200.0)], "page_id int, cut double")
    lines = la.reading_order(df, cut).orderBy("seq").collect()
    assert [r.text for r in lines] == ["Title across", "left one", "left two", "right one", "right two", "Break across", "left three", "right three"]


def test_overlap_counts_against_brute_force(spark):
    import random

    rnd = random.Random(3)
    items = [(i, rnd.uniform(0, 900), rnd.uniform(0, 900), rnd.uniform(1, 300), rnd.uniform(1, 60)) for i in range(150)]
    df = spark.createDataFrame([(1, i, x, y, w, h) for i, x, y, w, h in items], "page_id int, frag_id int, x double, y double, width double, height double")
    order = sorted(items, key=lambda i: i[1])
    cand = sum(1 for i, a in enumerate(order) for b in order[i + 1 :] if b[1] < a[1] + a[3])
    pairs = sum(1 for i, a in enumerate(items) for b in items[i + 1 :] if a[1] < b[1] + b[3] and b[1] < a[1] + a[3] and a[2] < b[2] + b[4] and b[2] < a[2] + a[4])
    assert rows(ge.overlapping_fragments(df)) == [(1, cand, "overlap", pairs)]


def test_crop_cover_keeps_first_of_equal_boxes(spark):
    boxes = [(1, 0, 0, 0, 100, 100), (1, 1, 10, 10, 20, 20), (1, 2, 0, 0, 100, 100), (1, 3, 90, 90, 20, 20)]
    df = spark.createDataFrame([(p, o, *map(float, b)) for p, o, *b in boxes], "page_id int, ord int, x double, y double, width double, height double")
    assert sorted(r.ord for r in ge.crop_cover(df).collect()) == [0, 3]


def test_panel_guards_accept_and_reject(spark):
    prose = "one two three four five six"
    frags = [("What is a clot and why?", 20, 110, 150)] + [(prose, 20, 130 + 15 * i, 200) for i in range(4)]
    frags += [("Glossary of terms", 420, 110, 100)] + [("word", 420, 130 + 15 * i, 50) for i in range(3)] + [("intro", 20, 10, 50)]
    good = [(1, i, t, float(x), float(y), float(w), 12.0) for i, (t, x, y, w) in enumerate(frags)]
    bad = [(2, i, t, x, y, w, h) for _, i, t, x, y, w, h in good if t != "Glossary of terms"]
    df = spark.createDataFrame(good + bad, "page_id int, frag_id int, text string, x double, y double, width double, height double")
    panels = spark.createDataFrame([(p, 0, 0.0, 100.0, 620.0, 300.0) for p in (1, 2)], "page_id int, panel int, x double, y double, width double, height double")
    insets = spark.createDataFrame([(p, 0, 400.0, 100.0, 200.0, 200.0) for p in (1, 2)], "page_id int, panel int, x double, y double, width double, height double")
    owned = ge.panel_ownership(df, panels, insets)
    assert rows(ge.panel_guards(owned, panels, insets, 620.0)) == [(1, 1, True), (2, 1, False)]


def test_pilot_scores(spark):
    gold = spark.createDataFrame(
        [("r1", "c1", "number", "3 mg", []), ("r2", "c1", None, None, ["number"]), ("r3", "c2", "negation", "no fue", ["number"])],
        "run_id string, case_id string, seed_category string, seed_span string, clean_categories array<string>",
    )
    found = spark.createDataFrame(
        [("r1", "baseline", "number", "3", "rule"), ("r2", "baseline", "number", "7", "rule"), ("r3", "baseline", "other", None, "rule"),
         ("r1", "enhanced", "number", "about 3 mg daily", "model"), ("r3", "enhanced", "negation", "no fue visto", "model")],
        "run_id string, arm string, category string, draft_span string, provenance string",
    )
    scores = {r.arm: r for r in ev.precision_recall(ev.score_arms(ev.match_findings(found, gold), gold)).collect()}
    b, e = scores["baseline"], scores["enhanced"]
    assert (b.true_positive, b.false_negative, b.false_positive, b.warning_volume, b.unadjudicated, b.recall, b.precision) == (1, 1, 1, 3, 1, 0.5, None)
    assert (e.true_positive, e.false_negative, e.false_positive, e.recall, e.precision) == (2, 0, 0, 1.0, 1.0)
    assert b.precision_status == "not measured"


def test_reserved_cost_bound(spark):
    row = spark.range(1).select(lg.max_call_cost(F.lit(Decimal(1))), lg.max_call_cost(F.lit(Decimal("1.1")))).first()
    assert tuple(row) == (Decimal("0.06334656"), Decimal("0.06968122"))


def test_distribute_text_matches_definition(spark):
    df = spark.createDataFrame([(["abc", "defghij", "k"], "one two, three four"), (["x"], "whole"), (["aa", "bb"], "")], "runs array<string>, translated string")
    parts = [r.parts for r in un.distribute_text(df).collect()]
    assert ["".join(p) for p in parts] == ["one two, three four", "whole", ""]
    assert parts[0] == ["one ", "two, three ", "four"]
    assert parts[1] == ["whole"]


def test_inline_contract(spark):
    s = "⟦DOC_0000⟧a⟦DOC_0001⟧b"
    df = spark.createDataFrame([(s, "⟦DOC_0000⟧x⟦DOC_0001⟧"), (s, "⟦DOC_0001⟧x⟦DOC_0000⟧y"), ("a", "b"), ("a", s)], "source string, target string")
    assert [r.valid for r in un.inline_contract(df).collect()] == [True, False, True, False]


def test_html_units(spark):
    html = "<head><title>T &amp; U</title><script>var p='<p>no</p>'</script></head><body><p>One <b>bold</b>.<p>Two</p>loose<td>12</td><li>\n x </li></body>"
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    assert [(r.unit_id, r.text) for r in markup.read_units_html(df).orderBy("ord").collect()] == [
        ("pkg_00000000", "T & U"), ("pkg_00000001", "One bold."), ("pkg_00000002", "Two"), ("pkg_00000003", "x"),
    ]


def _docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml"'
    body = (
        f'<w:document {w}><w:body><w:p w14:paraId="A1"><w:r><w:t>Hello </w:t></w:r><w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:t>CODE</w:t></w:r>'
        f'<w:r><w:fldChar w:fldCharType="end"/></w:r><w:r><w:t>world</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>12</w:t></w:r></w:p></w:body></w:document>'
    )
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("word/media/a.png", b"png")
        z.writestr("[Content_Types].xml", "<Types/>")
    return buffer.getvalue()


def test_packages(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(_docx())
    files = packages.read_packages(spark, str(tmp_path))
    units = packages.read_units_ooxml(files).orderBy("ord").collect()
    assert [(u.text, u.role, u.budget_multiplier) for u in units] == [("Hello world", "body", 1.0), ("cell", "table_cell", 0.94)]
    assert all(u.unit_id.startswith("docx_") and len(u.unit_id) == 25 for u in units)
    inventory = packages.package_inventory(packages.package_members(files)).collect()
    assert {r.part: r.kind for r in inventory} == {"word/document.xml": "xml", "word/media/a.png": "media", "[Content_Types].xml": "other"}
    assert all(r.accepted for r in inventory)


def test_json_records_and_write_once(spark, tmp_path):
    (tmp_path / "gold.json").write_text('{"version": 1, "gold": [{"runId": "r", "caseId": "c", "seed": null, "adjudicatedCleanCategories": ["number"]}]}')
    gold = replies.read_gold(spark, str(tmp_path / "gold.json"))
    assert [r.run_id for r in gold.collect()] == ["r"]
    sinks.write_report(gold, str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_report(gold, str(tmp_path / "out"))


def test_rate_limit_window_starts_at_first_request(spark):
    minute = 60_000_000
    times = [0, 10, 20, 30, 59, 60, 61, 200]
    df = spark.createDataFrame([("a", i, t * minute) for i, t in enumerate(times)], "client string, request_id int, at_us bigint")
    got = [a for _, a in rows(stateful.hourly_rate_limit(df, "client", 3, ["request_id"]))]
    assert got == [True, True, True, False, False, True, True, True]


def test_lifecycle_reports_illegal_events(spark):
    events = ["reserve", "accept", "start", "observe", "accept", "receipt", "start"]
    df = spark.createDataFrame([("c", i, i, e, True) for i, e in enumerate(events)], "call_id string, event_id int, at_us bigint, event string, valid boolean")
    got = rows(stateful.call_lifecycle(df, ["event_id"]))
    assert [(s, l) for _, s, l in got] == [
        ("reserved", True), ("reserved", False), ("started", True), ("started", True), ("pending-billing", True), ("reconciled", True), ("reconciled", False),
    ]


def test_last_observation_counts(spark):
    events = [("reserve", True), ("start", True), ("observe", True), ("observe", False), ("accept", True)]
    df = spark.createDataFrame([("c", i, i, e, v) for i, (e, v) in enumerate(events)], "call_id string, event_id int, at_us bigint, event string, valid boolean")
    assert rows(stateful.call_lifecycle(df, ["event_id"]))[-1][1] == "unknown-cost"


def test_refused_attempts_leave_room(spark):
    df = spark.createDataFrame([("b", i, i, n) for i, n in enumerate((999, 2, 1, 1))], "budget_id string, request_id int, at_us bigint, attempts int")
    assert [r[1:] for r in rows(stateful.lifetime_attempts(df, 1000, ["request_id"]))] == [(0, True), (999, False), (999, True), (1000, False)]


def test_admission_blockers_and_prior_hold(spark):
    df = spark.createDataFrame([("b", i, 0, 1, i == 1) for i in range(4)], "budget_id string, request_id int, at_us bigint, calls int, blocked boolean")
    step = stateful.admission_step(6_334_656, 15_000_000, 20_000_000, 20_000_000, 2_000_000)
    assert [a for _, a in rows(stateful.admission(df, step, ["request_id"]))] == [True, False, True, False]


def test_starts_over_midnight(spark):
    noon, hour = 3 * stateful.HOUR_US, stateful.HOUR_US  # noon of the accounting day
    starts = [(0, noon, noon + hour), (1, noon, noon + 13 * hour), (2, noon + 14 * hour, noon + 30 * hour), (3, noon + hour, noon + 15 * hour), (4, noon + hour, noon + hour)]
    df = spark.createDataFrame([(i, "b", r, s, 60) for i, r, s in starts], "request_id int, budget_id string, reserved_us bigint, started_us bigint, cost int")
    got = {r.request_id: (r.moved, r.fits) for r in stateful.midnight_rollover(df, 130, ["request_id"]).collect()}
    # the next day holds call 1 (moved) and call 2 (reserved, not started), so call 3 is refused; same-day starts go ahead
    assert got == {0: (False, True), 1: (True, True), 2: (False, True), 3: (True, False), 4: (False, True)}


def test_streams_match_logs(spark, tmp_path):
    minute = 60_000_000
    source = tmp_path / "in"
    data = [("a" if i % 2 else "b", i, i * 7 * minute) for i in range(40)]
    df = spark.createDataFrame(data, "client string, request_id int, at_us bigint")
    df.coalesce(1).write.json(str(source))
    stream = spark.readStream.schema(df.schema).json(str(source))
    out = stateful.run_stream(
        stream, "client", ["at_us", "request_id"], stateful.rate_limit_step(3), ["at_us"], "allowed boolean", stateful.RATE_STATE, ["request_id"]
    )
    q = out.writeStream.format("memory").queryName("limits").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("limits")) == rows(stateful.hourly_rate_limit(df, "client", 3, ["request_id"]))


def test_qc_stream_is_stateless(spark, tmp_path):
    pairs = spark.createDataFrame([(1, "ko", "Give 2 mg.", "3 mg.")], "pair_id int, lang string, source string, draft string")
    pairs.write.json(str(tmp_path / "p"))
    stream = spark.readStream.schema(pairs.schema).json(str(tmp_path / "p"))
    q = qc_stream.qc_stream(stream).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.category for r in spark.table("found").collect()} == {"number", "unit"}
