"""Queries of draft structure and nested case records."""

from __future__ import annotations

from pyspark.sql import functions as F

from pyspark.sql.window import Window

from twinfold.operators import drafts as dr
from twinfold.operators import geometry as ge
from twinfold.plans import boxes
from twinfold.plans.tables import ansi, read, relation
from twinfold.sources import packages, replies

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


@query(
    "ocr_lines",
    f"""WITH l AS (SELECT * FROM ({ansi('lines')}) AS x), b AS (SELECT doc_id, bool_and(trim(text) <> '' AND NOT (doc_id % 8 = 4 AND line = 1) AND 10 * line + 12 <= 8000
      AND NOT regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{{9F}}]')) AS ok FROM l GROUP BY 1)
    SELECT l.doc_id AS crop_id, line AS ord, CAST(100 + CASE doc_id % 4 WHEN 0 THEN 5 WHEN 1 THEN 10 * line WHEN 2 THEN 8000 - 5 - 40 ELSE 8000 - 10 * line - 12 END AS DOUBLE) AS x,
      CAST(200 + CASE doc_id % 4 WHEN 0 THEN 10 * line WHEN 1 THEN 8000 - 5 - 40 WHEN 2 THEN 8000 - 10 * line - 12 ELSE 5 END AS DOUBLE) AS y FROM l JOIN b USING (doc_id) WHERE b.ok""",
)
def ocr_lines(spark, folder):
    l = relation(spark, folder, "lines")
    top = (10 * F.col("line")).cast("double")
    bad = (F.col("doc_id") % 8 == 4) & (F.col("line") == 1)
    lines = l.select(
        F.col("doc_id").alias("crop_id"), F.col("line").alias("ord"), "text", F.when(bad, F.lit(float("nan"))).otherwise(5.0).alias("x0"), top.alias("y0"), F.lit(45.0).alias("x1"), (top + 12).alias("y1")
    )
    crops = read(spark, folder, "documents").select(
        F.col("doc_id").alias("crop_id"), F.col("doc_id").alias("page_id"), F.lit(100.0).alias("x"), F.lit(200.0).alias("y"), F.lit(8000.0).alias("width"), F.lit(8000.0).alias("height"),
        F.lit(9000.0).alias("page_width"), F.lit(9000.0).alias("page_height"), (F.col("doc_id") % 4 * 90).cast("int").alias("rotation"),
    )
    return dr.ocr_lines(lines, crops).select("crop_id", "ord", "x", "y")


@query(
    "panel_segments",
    boxes._PANEL
    + """, s AS (SELECT k.page_id, k.frag_id, CASE WHEN role = 'outside' THEN (SELECT min(p.panel) FROM p WHERE p.page_id = k.page_id AND p.y >= k.y + k.height) ELSE k.panel END AS segment_panel,
      CASE role WHEN 'outside' THEN 0 WHEN 'main' THEN 1 ELSE 2 END AS segment_part FROM k WHERE role <> 'reject')
    SELECT page_id, segment_panel, segment_part, count(*) AS fragments FROM s GROUP BY ALL""",
)
def panel_segments(spark, folder):
    panels, insets = boxes._panels(spark, folder)
    owned = ge.panel_ownership(boxes.fragments(spark, folder).select("page_id", "frag_id", "x", "y", "width", "height"), panels, insets)
    done = dr.panel_segments(owned, panels)
    return done.groupBy("page_id", "segment_panel", "segment_part").agg(F.count("*").alias("fragments"))


@query(
    "rule_bands",
    """WITH RECURSIVE s AS (SELECT l_orderkey AS page_id, CASE WHEN l_linestatus = 'F' THEN 'h' ELSE 'v' END AS axis, CAST(l_partkey AS DOUBLE) AS low, CAST(l_partkey AS DOUBLE) + l_quantity * 4 AS high,
      l_partkey * 1000000 + l_suppkey * 100 + l_linenumber AS stroke_id FROM lineitem),
    n AS (SELECT *, row_number() OVER (PARTITION BY page_id, axis ORDER BY low, stroke_id, high) AS rn FROM s),
    w(page_id, axis, rn, band, lo, hi) AS (SELECT page_id, axis, rn, 0, low, high FROM n WHERE rn = 1
      UNION ALL SELECT n.page_id, n.axis, n.rn, CASE WHEN n.low <= w.hi AND n.high >= w.lo THEN w.band ELSE w.band + 1 END, CASE WHEN n.low <= w.hi AND n.high >= w.lo THEN greatest(w.lo, n.low) ELSE n.low END,
        CASE WHEN n.low <= w.hi AND n.high >= w.lo THEN least(w.hi, n.high) ELSE n.high END FROM w JOIN n ON n.page_id = w.page_id AND n.axis = w.axis AND n.rn = w.rn + 1)
    SELECT w.page_id, w.axis, CAST(band AS INT) AS band, count(*) AS strokes, max(n.low) AS low, min(n.high) AS high FROM w JOIN n USING (page_id, axis, rn) GROUP BY ALL""",
)
def rule_bands(spark, folder):
    li = read(spark, folder, "lineitem")
    low = F.col("l_partkey").cast("double")
    strokes = li.select(
        F.col("l_orderkey").alias("page_id"), F.when(F.col("l_linestatus") == "F", "h").otherwise("v").alias("axis"),
        (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 100 + F.col("l_linenumber")).alias("stroke_id"), low.alias("at"), low.alias("low"), (low + F.col("l_quantity") * 4).alias("high"),
    )
    return dr.rule_bands(strokes)


@query(
    "native_table_grid",
    """WITH d AS (SELECT l_orderkey, l_linenumber, any_value(l_partkey) AS pk, count(*) AS n FROM lineitem GROUP BY ALL), t AS (SELECT l_orderkey AS table_id, bool_and(n = 1) AS one, count(*) AS data, max(l_linenumber) AS hi,
      bool_or(pk % 11 = 0) AS moved, bool_or(pk % 13 = 0) AS words FROM d GROUP BY 1)
    SELECT table_id, data + 1 AS rows, 3 AS columns, one AND data >= 2 AND NOT moved AND NOT words AS accepted FROM t WHERE one""",
)
def native_table_grid(spark, folder):
    li = read(spark, folder, "lineitem")
    single = li.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.first("l_partkey").alias("pk"), F.first("l_quantity").alias("qty"), F.first("l_returnflag").alias("flag"))
    bad = single.where("n > 1").select("l_orderkey").distinct()
    data = single.join(bad, "l_orderkey", "left_anti")
    rank = data.withColumn("row", F.count("*").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")))
    words = F.col("pk") % 13 == 0
    texts = F.array(F.col("flag"), F.when(words, "text").otherwise(F.col("qty").cast("int").cast("string")), F.col("pk").cast("string"))
    cells = rank.select("l_orderkey", "row", "pk", F.posexplode(texts).alias("c", "text"))
    head = data.select("l_orderkey").distinct().select("l_orderkey", F.lit(0).alias("row"), F.lit(1).alias("pk"), F.posexplode(F.array(F.lit("Flag"), F.lit("Quantity"), F.lit("Part"))).alias("c", "text"))
    both = head.select("l_orderkey", F.col("row").cast("bigint").alias("row"), F.col("pk").cast("bigint").alias("pk"), "c", "text").unionByName(cells)
    shift = F.when((F.col("pk") % 11 == 0) & (F.col("c") == 1), 40.0).otherwise(0.0)
    frags = both.select(
        F.col("l_orderkey").alias("table_id"), "row", F.col("c").alias("frag_id"), "text", (F.col("c") * 150.0 + shift).alias("x"), (F.col("row") * 20.0).alias("y"), F.lit(60.0).alias("width"), F.lit(12.0).alias("height")
    )
    return dr.native_table_grid(frags, 600.0)


@query(
    "merge_drafts",
    f"""WITH r AS ({ansi('regions')}), e AS ({ansi('edges')}), f AS (SELECT * FROM ({ansi('fragments')}) AS x), z AS (SELECT page_id, line, count(*) AS n FROM f GROUP BY ALL),
    s AS (SELECT page_id, from_id AS id FROM e WHERE type <> 'reading-next' UNION SELECT page_id, to_id FROM e WHERE type <> 'reading-next')
    SELECT r.page_id, r.seq AS draft_id, CASE WHEN r.seq % 7 = 6 AND z.n = 1 THEN NULL WHEN r.status = 'verified' OR EXISTS (SELECT 1 FROM s WHERE s.page_id = r.page_id AND s.id = r.region_id) THEN 'protected'
      WHEN r.seq % 7 = 6 THEN 'region-ownership' ELSE 'replace' END AS verdict FROM r JOIN z ON z.page_id = r.page_id AND z.line = r.seq WHERE NOT (r.seq % 7 = 6 AND z.n = 1)""",
)
def merge_drafts(spark, folder):
    f = relation(spark, folder, "fragments")
    owned = f.select("page_id", "frag_id", F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit("-r"), F.col("line").cast("string")).alias("region_id"))
    drafts = f.where("not (line % 7 = 6 and frag_id % 100000 = 0)").select("page_id", F.col("line").alias("draft_id"), "frag_id")
    return dr.merge_drafts(relation(spark, folder, "regions"), owned, drafts, relation(spark, folder, "edges"))


@query(
    "figure_caption_candidates",
    f"""WITH l AS ({ansi('lines')}), g AS (SELECT doc_id, line FROM l WHERE doc_id % 5 <> 1 AND doc_id % 5 <> 2)
    SELECT doc_id AS page_id, line AS frame_id, line AS image_id, line AS caption_seq, 1 AS lines FROM g""",
)
def figure_caption_candidates(spark, folder):
    l = relation(spark, folder, "lines")
    base = (400 * F.col("line")).cast("double")
    k = F.col("doc_id") % 5

    def boxed(name, y, height, x=10.0, width=300.0):
        return [F.col("doc_id").alias("page_id"), F.col("line").alias(name), F.lit(x).alias("x"), y.alias("y"), F.lit(width).alias("width"), height.alias("height")]

    frames = l.select(*boxed("frame_id", base, F.lit(300.0)))
    images = l.select(*boxed("image_id", base + 10, F.when(k == 2, 400.0).otherwise(150.0), 20.0, 200.0))
    lines = l.select(*boxed("seq", base + 200, F.lit(20.0), 20.0, 200.0), F.when(k == 1, F.col("text")).otherwise(F.concat(F.lit("Figure 3 "), "text")).alias("text"))
    return dr.figure_caption_candidates(frames, images, lines)


@query(
    "equation_layout_check",
    """SELECT doc_id AS eq_id, CASE doc_id % 6 WHEN 1 THEN 'misplaced' WHEN 2 THEN 'bar-reused' WHEN 3 THEN 'cyclic' WHEN 4 THEN 'two-parents' ELSE 'ok' END AS verdict FROM documents""",
)
def equation_layout_check(spark, folder):
    d = read(spark, folder, "documents").select(F.col("doc_id").alias("eq_id"), (F.col("doc_id") % 6).alias("k"))
    tok = lambda i, x, y: F.struct(F.lit(i).alias("token_id"), x.alias("x"), y.alias("y"), F.lit(8.0).alias("width"), F.lit(8.0).alias("height"))
    n = F.lit
    tokens = d.select(
        "eq_id",
        F.explode(
            F.array(
                tok("n", n(12.0), n(0.0)), tok("d", F.when(F.col("k") == 1, 200.0).otherwise(12.0), n(30.0)), tok("b", n(50.0), n(15.0)), tok("s", n(60.0), n(20.0)), tok("q", n(60.0), n(5.0))
            )
        ).alias("t"),
    ).select("eq_id", "t.*")
    bars = d.select("eq_id", n("bar").alias("bar_id"), n(10.0).alias("x"), n(20.0).alias("y"), n(20.0).alias("width"), n(1.0).alias("height"))
    none = n(None).cast("string")
    rel = lambda r, kind, bar, base, token, place: F.struct(n(r).alias("rel_id"), n(kind).alias("kind"), bar.alias("bar_id"), base.alias("base_id"), n(token).alias("token_id"), place.alias("place"))
    always = [rel(1, "fraction", n("bar"), none, "n", n("above")), rel(1, "fraction", n("bar"), none, "d", n("below")), rel(2, "subscript", none, n("b"), "s", none)]
    extra = (
        F.when(F.col("k") == 2, F.array(rel(3, "overbar", n("bar"), none, "d", n("below"))))
        .when(F.col("k") == 3, F.array(rel(3, "superscript", none, n("s"), "b", none)))
        .when(F.col("k") == 4, F.array(rel(3, "subscript", none, n("q"), "s", none)))
        .otherwise(F.array().cast("array<struct<rel_id:int,kind:string,bar_id:string,base_id:string,token_id:string,place:string>>"))
    )
    relations = d.select("eq_id", F.explode(F.concat(F.array(*always), extra)).alias("r")).select("eq_id", "r.*")
    return dr.equation_layout_check(tokens, bars, relations)


def _manifest(spark, folder):
    """Nested case records built from documents; some break one rule each."""
    d = read(spark, folder, "documents")
    k = F.col("doc_id") % 9
    section = lambda i, t: F.struct(F.lit(i).alias("id"), F.lit("Label").alias("label"), t.alias("text"))
    finding = F.struct(
        F.lit("f1").alias("id"), F.lit("Numbers").alias("title"), F.when(k == 1, "open").otherwise("passed").alias("status"), F.lit("rule").alias("basis"),
        F.lit("s1").alias("sourceSection"), F.when(k == 2, "t9").otherwise("t1").alias("targetSection"),
    )
    translation = F.struct(
        F.when(k == 3, "xx").otherwise("ko").alias("language"), F.lit("AI_DRAFT_UNREVIEWED").alias("status"), F.lit("/assets/p.png").alias("preview"), F.lit("/assets/d.docx").alias("download"),
        F.array(section("t1", F.col("text"))).alias("sections"), F.array(finding).alias("findings"),
    )
    source = F.struct(
        F.lit("cite").alias("citation"), F.when(k == 4, "http://x").otherwise("https://x.org/a").alias("url"), F.when(k == 5, "ARR").otherwise("CC BY 4.0").alias("license"), F.lit("none").alias("modifications"),
        F.lit("/assets/s.png").alias("preview"), F.when(k == 6, F.array(section("s1", F.col("text")), section("s1", F.lit("b")))).otherwise(F.array(section("s1", F.col("text")))).alias("sections"),
    )
    return d.select(
        F.col("doc_id").cast("string").alias("id"), F.when(k == 7, "").otherwise("Title").alias("title"), F.lit("recorded").alias("mode"), F.lit("2026-01-01").alias("generatedUtc"), F.lit("gen").alias("generator"), F.lit("scope").alias("scope"),
        source.alias("source"), F.array(translation).alias("translations"),
    )


@query(
    "manifest_rules",
    """SELECT CASE doc_id % 9 WHEN 1 THEN 'finding-status' WHEN 2 THEN 'finding-section' WHEN 3 THEN 'language' WHEN 4 THEN 'url' WHEN 5 THEN 'license' WHEN 6 THEN 'section-repeated' ELSE 'title-or-mode' END AS rule,
    CAST(doc_id AS VARCHAR) AS case_id, 1 AS n FROM documents WHERE doc_id % 9 NOT IN (0, 8)""",
)
def manifest_rules(spark, folder):
    return replies.manifest_rules(_manifest(spark, folder))


@query(
    "read_manifest",
    "SELECT 'source' AS part, count(*) + count(*) FILTER (WHERE doc_id % 9 = 6) AS n FROM documents UNION ALL SELECT 'target', count(*) FROM documents UNION ALL SELECT 'finding', count(*) FROM documents",
)
def read_manifest(spark, folder):
    p = replies.explode_manifest(_manifest(spark, folder))
    named = {"source": "source_sections", "target": "target_sections", "finding": "findings"}
    out = None
    for part, key in named.items():
        one = p[key].groupBy(F.lit(part).alias("part")).agg(F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "pair_sections",
    "SELECT CAST(doc_id AS VARCHAR) AS case_id, length(text) AS source_length, length(text) AS target_length FROM documents WHERE doc_id % 9 NOT IN (2, 6) UNION ALL SELECT CAST(doc_id AS VARCHAR), length(text), length(text) FROM documents WHERE doc_id % 9 = 6 UNION ALL SELECT CAST(doc_id AS VARCHAR), 1, length(text) FROM documents WHERE doc_id % 9 = 6",
)
def pair_sections(spark, folder):
    return replies.pair_sections(_manifest(spark, folder)).select(
        "case_id", F.length("source").cast("bigint").alias("source_length"), F.length("target").cast("bigint").alias("target_length")
    )


@query(
    "package_inventory",
    """SELECT page_id AS doc_id, part, CASE WHEN part = 'word/media/i.png' THEN 'media' WHEN lower(part) = 'word/document.xml' THEN 'xml' ELSE 'other' END AS kind, page_id % 6 <> 1 AND page_id % 6 <> 2 AS accepted
    FROM (SELECT page_id, unnest(['word/media/i.png', 'word/document.xml', CASE WHEN page_id % 6 = 1 THEN '../x.bin' WHEN page_id % 6 = 2 THEN 'Word/Document.xml' ELSE 'x.bin' END]) AS part FROM pages)""",
)
def package_inventory(spark, folder):
    k = F.col("page_id") % 6
    parts = F.array(F.lit("word/media/i.png"), F.lit("word/document.xml"), F.when(k == 1, "../x.bin").when(k == 2, "Word/Document.xml").otherwise("x.bin"))
    members = read(spark, folder, "pages").select(
        F.col("page_id").alias("doc_id"), F.explode(parts).alias("part"), F.length("html").cast("bigint").alias("bytes"), F.col("html").cast("binary").alias("content")
    )
    return packages.package_inventory(members).select("doc_id", "part", "kind", "accepted")
