"""Queries over page geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinfold.operators import geometry as ge
from twinfold.plans.tables import ansi, relation

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def fragments(spark, folder):
    """Visible fragments only."""
    return relation(spark, folder, "fragments").where("trim(text) <> ''")


_F = f"f AS MATERIALIZED (SELECT * FROM ({ansi('fragments')}) AS x WHERE trim(text) <> '')"
_R = f"r AS MATERIALIZED ({ansi('regions')})"
_S = f"s AS MATERIALIZED ({ansi('strokes')})"
_I = f"im AS MATERIALIZED ({ansi('images')})"


def _inside(a: str, b: str) -> str:
    return (
        f"{a}.x <= {b}.x AND {a}.y <= {b}.y AND {a}.x + {a}.width >= {b}.x + {b}.width AND {a}.y + {a}.height >= {b}.y + {b}.height"
    )


def _cross(a: str, b: str) -> str:
    return (
        f"{a}.x < {b}.x + {b}.width AND {a}.x + {a}.width > {b}.x AND {a}.y < {b}.y + {b}.height AND {a}.y + {a}.height > {b}.y"
    )


def _touch(a: str, b: str) -> str:
    return (
        f"{a}.x <= {b}.x + {b}.width AND {a}.x + {a}.width >= {b}.x AND {a}.y <= {b}.y + {b}.height AND {a}.y + {a}.height >= {b}.y"
    )


@query(
    "coincident_fragments",
    f"WITH {_F} SELECT page_id, x, y, count(*) AS n FROM f GROUP BY ALL HAVING count(*) > 1",
)
def coincident_fragments(spark, folder):
    return ge.coincident_fragments(fragments(spark, folder))


@query(
    "overlapping_fragments",
    f"""WITH {_F}, o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY x, frag_id) AS rn FROM f),
    c AS (SELECT a.page_id, count(*) AS n FROM o a JOIN o b ON a.page_id = b.page_id AND b.rn > a.rn AND b.x < a.x + a.width GROUP BY 1),
    p AS (SELECT a.page_id, count(*) AS n FROM f a JOIN f b ON a.page_id = b.page_id AND a.frag_id < b.frag_id AND {_cross('a', 'b')} GROUP BY 1),
    pg AS (SELECT DISTINCT page_id FROM f)
    SELECT pg.page_id, coalesce(c.n, 0) AS candidates, CASE WHEN coalesce(p.n, 0) > 0 THEN 'overlap' ELSE 'clear' END AS status,
      coalesce(p.n, 0) AS pairs FROM pg LEFT JOIN c USING (page_id) LEFT JOIN p USING (page_id)""",
)
def overlapping_fragments(spark, folder):
    return ge.overlapping_fragments(fragments(spark, folder))


@query(
    "crop_cover",
    f"""WITH {_F}, b AS (SELECT page_id, frag_id AS ord, x - x % 90 AS x, CAST(400 * line AS DOUBLE) AS y, CASE WHEN frag_id % 5 = 0 THEN 180.0 ELSE 90.0 END AS width,
      CASE WHEN frag_id % 7 = 0 THEN 80.0 ELSE 40.0 END AS height FROM f),
    d AS (SELECT page_id, x, y, CAST(width AS DOUBLE) AS width, CAST(height AS DOUBLE) AS height, min(ord) AS ord FROM b GROUP BY ALL)
    SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM d o WHERE o.page_id = d.page_id AND o.ord <> d.ord AND {_inside('o', 'd')})""",
)
def crop_cover(spark, folder):
    f = fragments(spark, folder)
    boxes = f.select(
        "page_id",
        F.col("frag_id").alias("ord"),
        (F.col("x") - F.col("x") % 90).alias("x"),
        (400 * F.col("line")).cast("double").alias("y"),
        F.when(F.col("frag_id") % 5 == 0, 180.0).otherwise(90.0).alias("width"),
        F.when(F.col("frag_id") % 7 == 0, 80.0).otherwise(40.0).alias("height"),
    )
    return ge.crop_cover(boxes)


@query(
    "cell_ownership",
    f"""WITH {_F}, {_R}, {_S}, o AS (SELECT f.page_id, f.frag_id, count(*) AS n FROM f JOIN r ON r.page_id = f.page_id AND {_inside('r', 'f')} GROUP BY ALL),
    k AS (SELECT DISTINCT f.page_id, f.frag_id FROM f JOIN s ON s.page_id = f.page_id AND {_cross('f', 's')}),
    j AS (SELECT f.page_id, coalesce(o.n, 0) AS n, k.frag_id IS NOT NULL AS cut FROM f LEFT JOIN o USING (page_id, frag_id) LEFT JOIN k USING (page_id, frag_id))
    SELECT page_id, count(*) AS fragments, count(*) FILTER (WHERE n <> 1) AS unowned, count(*) FILTER (WHERE cut) AS cut,
      count(*) FILTER (WHERE n <> 1) = 0 AND count(*) FILTER (WHERE cut) = 0 AS accepted FROM j GROUP BY 1""",
)
def cell_ownership(spark, folder):
    cells = relation(spark, folder, "regions").select("page_id", "region_id", "x", "y", "width", "height")
    rules = relation(spark, folder, "strokes").select("page_id", "stroke_id", "x", "y", "width", "height")
    return ge.cell_ownership(fragments(spark, folder), cells, rules)


def _panels(spark, folder):
    r = relation(spark, folder, "regions").where("seq % 2 = 0")
    zero = F.lit(0.0)
    panels = r.select("page_id", F.col("seq").alias("panel"), zero.alias("x"), "y", F.lit(620.0).alias("width"), F.lit(300.0).alias("height"))
    insets = panels.select(
        "page_id", "panel", F.lit(400.0).alias("x"), "y", F.lit(200.0).alias("width"), F.lit(200.0).alias("height")
    )
    return panels, insets


_PANEL = f"""WITH {_F}, {_R}, p AS (SELECT page_id, seq AS panel, 0.0 AS x, y, 620.0 AS width, 300.0 AS height FROM r WHERE seq % 2 = 0),
    n AS (SELECT page_id, panel, 400.0 AS x, y, 200.0 AS width, 200.0 AS height FROM p),
    o AS (SELECT f.page_id, f.frag_id, count(*) AS owners, min(p.panel) AS panel FROM f JOIN p ON p.page_id = f.page_id AND {_inside('p', 'f')} GROUP BY ALL),
    be AS (SELECT DISTINCT f.page_id, f.frag_id FROM f JOIN p ON p.page_id = f.page_id AND f.y < p.y + p.height AND f.y + f.height > p.y),
    j AS (SELECT f.*, o.owners, o.panel, be.frag_id IS NOT NULL AS beside,
      EXISTS (SELECT 1 FROM n WHERE n.page_id = f.page_id AND n.panel = o.panel AND {_inside('n', 'f')}) AS aside,
      EXISTS (SELECT 1 FROM n WHERE n.page_id = f.page_id AND n.panel = o.panel AND {_cross('n', 'f')}) AS meets
      FROM f LEFT JOIN o USING (page_id, frag_id) LEFT JOIN be USING (page_id, frag_id)),
    k AS (SELECT *, CASE WHEN owners > 1 THEN 'reject' WHEN owners IS NULL THEN CASE WHEN beside THEN 'reject' ELSE 'outside' END WHEN aside THEN 'glossary' WHEN meets THEN 'reject' ELSE 'main' END AS role FROM j)"""


@query("panel_ownership", _PANEL + " SELECT page_id, panel, role, count(*) AS fragments FROM k GROUP BY ALL")
def panel_ownership(spark, folder):
    panels, insets = _panels(spark, folder)
    owned = ge.panel_ownership(fragments(spark, folder).select("page_id", "frag_id", "x", "y", "width", "height"), panels, insets)
    return owned.groupBy("page_id", "panel", "role").agg(F.count("*").alias("fragments"))


@query(
    "panel_guards",
    _PANEL
    + " SELECT page_id, count(DISTINCT panel) AS panels, false AS accepted FROM k GROUP BY page_id",
)
def panel_guards(spark, folder):
    panels, insets = _panels(spark, folder)
    owned = ge.panel_ownership(ge.guard_marks(fragments(spark, folder)), panels, insets)
    return ge.panel_guards(owned, panels, insets, 620.0)


@query(
    "raster_overlap",
    f"""WITH {_R}, {_I}, p AS ({ansi('doc_pages')}) SELECT r.page_id, r.region_id, CASE WHEN NOT p.visual_inventory_confirmed OR r.x + r.width > p.width OR r.y + r.height > p.height THEN 'unknown'
      WHEN EXISTS (SELECT 1 FROM im WHERE im.page_id = r.page_id AND {_touch('r', 'im')}) THEN 'raster-overlap' ELSE 'raster-disjoint' END AS status FROM r JOIN p USING (page_id)""",
)
def raster_overlap(spark, folder):
    pages = relation(spark, folder, "doc_pages").withColumnRenamed("visual_inventory_confirmed", "complete")
    return ge.raster_overlap(relation(spark, folder, "regions"), relation(spark, folder, "images"), pages)


@query(
    "glyph_rule_contacts",
    f"""WITH {_F}, {_R}, {_S}, g AS (SELECT *, 'p' || page_id || '-r' || line AS region_id FROM f),
    ng AS (SELECT g.page_id, g.region_id, count(*) AS glyphs, bool_and({_inside('r', 'g')}) AS ins FROM g JOIN r USING (page_id, region_id) GROUP BY ALL),
    nr AS (SELECT page_id, region_id, count(*) AS rules FROM s GROUP BY ALL),
    b AS (SELECT page_id, region_id, glyphs, rules, glyphs * rules AS pairs, ins AS ok FROM ng JOIN nr USING (page_id, region_id)),
    m AS (SELECT b.region_id, count(*) FILTER (WHERE {_cross('g', 's')}) AS c, count(*) FILTER (WHERE NOT ({_cross('g', 's')})) AS t FROM b JOIN g USING (page_id, region_id) JOIN s USING (page_id, region_id) WHERE b.ok AND {_touch('g', 's')} GROUP BY 1)
    SELECT b.page_id, b.region_id, b.glyphs, b.rules, b.pairs, coalesce(m.c, 0) AS crossing, coalesce(m.t, 0) AS touching,
      CASE WHEN NOT b.ok THEN 'unknown' WHEN coalesce(m.c, 0) > 0 THEN 'crossing' WHEN coalesce(m.t, 0) > 0 THEN 'touching' ELSE 'disjoint' END AS status FROM b LEFT JOIN m USING (region_id)""",
)
def glyph_rule_contacts(spark, folder):
    glyphs = fragments(spark, folder).withColumn(
        "region_id",
        F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit("-r"), F.col("line").cast("string")),
    )
    return ge.glyph_rule_contacts(
        glyphs, relation(spark, folder, "strokes"), relation(spark, folder, "regions")
    )
