"""Box relations on pages: tiled joins, so that one crowded page is spread out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TILE = 256.0


def _tile(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(size))


def point_tile(df: DataFrame, x: str = "x", y: str = "y", size: float = TILE) -> DataFrame:
    """The tile of the upper left corner."""
    return df.withColumns({"_tx": _tile(F.col(x), size), "_ty": _tile(F.col(y), size)})


def box_tiles(df: DataFrame, x="x", y="y", w="width", h="height", size: float = TILE) -> DataFrame:
    """One row per tile a box touches, edges included."""
    across = F.sequence(_tile(F.col(x), size), _tile(F.col(x) + F.col(w), size))
    down = F.sequence(_tile(F.col(y), size), _tile(F.col(y) + F.col(h), size))
    return df.withColumn("_tx", F.explode(across)).withColumn("_ty", F.explode(down))


def contains(a: str, b: str) -> Column:
    """Box ``a`` holds box ``b``; both are column prefixes."""
    return F.expr(
        f"{a}x <= {b}x and {a}y <= {b}y and {a}x + {a}width >= {b}x + {b}width and {a}y + {a}height >= {b}y + {b}height"
    )


def touches(a: str, b: str) -> Column:
    return F.expr(
        f"{a}x <= {b}x + {b}width and {a}x + {a}width >= {b}x and {a}y <= {b}y + {b}height and {a}y + {a}height >= {b}y"
    )


def crosses(a: str, b: str) -> Column:
    """Positive common area."""
    return F.expr(
        f"{a}x < {b}x + {b}width and {a}x + {a}width > {b}x and {a}y < {b}y + {b}height and {a}y + {a}height > {b}y"
    )


def prefixed(df: DataFrame, prefix: str, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def contained_in(inner: DataFrame, outer: DataFrame, size: float = TILE) -> DataFrame:
    """Pairs ``i_* , o_*`` on one page with the inner box inside the outer box.

    The inner corner lies in one tile; only the outer box is repeated.
    """
    keep = ("page_id", "_tx", "_ty")
    i = prefixed(point_tile(inner, size=size), "i_", keep)
    o = prefixed(box_tiles(outer, size=size), "o_", keep)
    return i.join(o, list(keep)).where(contains("o_", "i_")).drop("_tx", "_ty")


def touching(left: DataFrame, right: DataFrame, size: float = TILE, relation=touches) -> DataFrame:
    """Each related pair ``l_* , r_*`` once: in the tile of their common corner."""
    keep = ("page_id", "_tx", "_ty")
    a = prefixed(box_tiles(left, size=size), "l_", keep)
    b = prefixed(box_tiles(right, size=size), "r_", keep)
    home = (F.col("_tx") == _tile(F.greatest("l_x", "r_x"), size)) & (
        F.col("_ty") == _tile(F.greatest("l_y", "r_y"), size)
    )
    return a.join(b, list(keep)).where(relation("l_", "r_") & home).drop("_tx", "_ty")


def coincident_fragments(fragments: DataFrame) -> DataFrame:
    """Origins shared by several fragments (map-side counted)."""
    return fragments.groupBy("page_id", "x", "y").agg(F.count("*").alias("n")).where("n > 1")


def overlap_candidates(fragments: DataFrame, size: float = TILE) -> DataFrame:
    """Per page: pairs whose x ranges meet in a left-to-right sweep, without listing them.

    A pair is a candidate when the later box starts before the earlier one ends.
    Ranks come from counted distinct x values, so equal starts weigh nothing.
    """
    starts = fragments.groupBy("page_id", "x").agg(F.count("*").alias("n"))
    ends = fragments.groupBy("page_id", (F.col("x") + F.col("width")).alias("x")).agg(F.count("*").alias("e"))
    marks = starts.join(ends, ["page_id", "x"], "full_outer").fillna(0, ["n", "e"])
    tiled = marks.withColumn("_t", _tile(F.col("x"), size))
    inside = Window.partitionBy("page_id", "_t").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("page_id").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    sums = tiled.groupBy("page_id", "_t").agg(F.sum("n").alias("tn")).select(
        "page_id", "_t", F.coalesce(F.sum("tn").over(across), F.lit(0)).alias("base")
    )
    ranked = tiled.withColumn("local", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(sums, ["page_id", "_t"])
    before = F.col("base") + F.col("local")
    # Starts before each end, less starts up to and including the own start.
    return ranked.groupBy("page_id").agg(
        (
            F.sum(F.col("e") * before) - F.sum(F.col("n") * before) - F.sum(F.col("n") * (F.col("n") + 1) / 2)
        ).cast("bigint").alias("candidates")
    )


def overlapping_fragments(fragments: DataFrame, limit: int | None = None) -> DataFrame:
    """Status per page: ``limit``, ``overlap`` with a pair count, or ``clear``.

    ``limit``, if given, leaves pages with more candidates unpaired; by default every page is paired.
    """
    counted = overlap_candidates(fragments).withColumn("held", F.lit(False) if limit is None else F.col("candidates") > limit)
    open_pages = fragments.join(counted.where("not held").select("page_id"), "page_id", "left_semi")
    boxes = open_pages.select("page_id", "frag_id", "x", "y", "width", "height")
    pairs = touching(boxes, boxes, relation=crosses).where("l_frag_id < r_frag_id")
    n = pairs.groupBy("page_id").agg(F.count("*").alias("pairs"))
    joined = counted.join(n, "page_id", "left")
    status = F.when(F.col("held"), "limit").when(F.col("pairs") > 0, "overlap").otherwise("clear")
    return joined.select(
        "page_id", "candidates", status.alias("status"), F.coalesce("pairs", F.lit(0).cast("bigint")).alias("pairs")
    )


def crop_cover(boxes: DataFrame) -> DataFrame:
    """Boxes not inside another box; of equal boxes the first by ``ord`` stays.

    Equal boxes collapse before any join, so copies cannot multiply.
    """
    single = boxes.groupBy("page_id", "x", "y", "width", "height").agg(F.min("ord").alias("ord"))
    inner = contained_in(single, single).where("i_ord <> o_ord").select("page_id", F.col("i_ord").alias("ord")).distinct()
    return single.join(inner, ["page_id", "ord"], "left_anti")


def cell_ownership(fragments: DataFrame, cells: DataFrame, rules: DataFrame) -> DataFrame:
    """Verdict per page table: every fragment in exactly one cell and across no rule."""
    owners = contained_in(fragments.select("page_id", "frag_id", "x", "y", "width", "height"), cells)
    counts = owners.groupBy("page_id", F.col("i_frag_id").alias("frag_id")).agg(F.count("*").alias("owners"))
    cut = (
        touching(fragments.select("page_id", "frag_id", "x", "y", "width", "height"), rules, relation=crosses)
        .select("page_id", F.col("l_frag_id").alias("frag_id"))
        .distinct()
        .withColumn("cut", F.lit(True))
    )
    joined = fragments.join(counts, ["page_id", "frag_id"], "left").join(cut, ["page_id", "frag_id"], "left")
    return joined.groupBy("page_id").agg(
        F.count("*").alias("fragments"),
        F.count_if(F.coalesce("owners", F.lit(0)) != 1).alias("unowned"),
        F.count_if(F.coalesce("cut", F.lit(False))).alias("cut"),
    ).withColumn("accepted", (F.col("unowned") == 0) & (F.col("cut") == 0))


QUESTION = r"(?i)^(?:What|How|Why|Who|When|Where|Which)\b.{2,110}\?\z"
GLOSSARY_TITLE = "Glossary of terms"
NOT_PROSE = r"(?i)\b(?:Table|Figure|Fig\.|Equation)|[=∑∫ψασ\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"


def panel_ownership(fragments: DataFrame, panels: DataFrame, insets: DataFrame) -> DataFrame:
    """Role of each fragment against question panels ``(panel, x, y, width, height)``.

    ``main``, ``glossary`` or ``outside``; ``reject`` marks text that meets an
    inset without lying in it, lies in two panels or stands beside a panel.
    """
    box = ("x", "y", "width", "height")
    held = panels.select("page_id", "panel", *[F.col(c).alias(f"p_{c}") for c in box])
    aside = insets.select("page_id", "panel", *[F.col(c).alias(f"i_{c}") for c in box]).join(held, ["page_id", "panel"])
    marks = held.withColumn("_inset", F.lit(False)).unionByName(aside.withColumn("_inset", F.lit(True)), allowMissingColumns=True)
    top, bottom = F.coalesce("i_y", "p_y"), F.coalesce(F.col("i_y") + F.col("i_height"), F.col("p_y") + F.col("p_height"))
    inset, inside, at = F.col("_inset"), contains("p_", ""), _tile(F.col("y"), TILE)

    def facts(items: DataFrame, marks: DataFrame, by: list[str]) -> DataFrame:
        home = F.col("_ty") == at
        return items.join(marks, ["page_id", "_ty"], "left").groupBy(*by).agg(
            F.count_if(~inset & inside & home).alias("_owners"),
            F.min(F.when(~inset & inside, F.col("panel"))).alias("panel"),
            F.bool_or(~inset & F.expr("y < p_y + p_height and y + height > p_y")).alias("_beside"),
            F.bool_or(inset & inside & contains("i_", "")).alias("_aside"),
            F.bool_or(inset & inside & crosses("i_", "")).alias("_meets"),
        )

    # A fragment lower than a tile finds all it can meet in the tile of its top, as marks reach one tile up; its rows are
    # then together after the join. Taller ones are repeated over their tiles.
    short = F.coalesce(F.col("height") <= TILE, F.lit(False))
    reach = marks.withColumn("_ty", F.explode(F.sequence(_tile(top - TILE, TILE), _tile(bottom, TILE))))
    touched = marks.withColumn("_ty", F.explode(F.sequence(_tile(top, TILE), _tile(bottom, TILE))))
    tiles = F.sequence(at, _tile(F.col("y") + F.col("height"), TILE))
    low = facts(fragments.where(short).withColumn("_ty", at), reach, [*fragments.columns, "_ty"]).drop("_ty")
    tall = facts(fragments.where(~short).withColumn("_ty", F.explode_outer(tiles)), touched, fragments.columns)
    found = low.unionByName(tall)
    role = (
        F.when(F.col("_owners") > 1, "reject")
        .when(F.col("_owners") == 0, F.when(F.col("_beside"), "reject").otherwise("outside"))
        .when(F.col("_aside"), "glossary")
        .when(F.col("_meets"), "reject")
        .otherwise("main")
    )
    return found.select(*fragments.columns, "panel", role.alias("role"))


def guard_marks(fragments: DataFrame) -> DataFrame:
    """Fragments with what the panel guards ask of their text in place of the text."""
    trimmed = F.trim("text")
    return fragments.withColumns(
        {
            "wordy": F.size(F.split(trimmed, r"\s+")) >= 6,
            "titled": trimmed == GLOSSARY_TITLE,
            "question": trimmed.rlike(QUESTION),
            "other": F.col("text").rlike(NOT_PROSE),
        }
    ).drop("text")


def panel_guards(owned: DataFrame, panels: DataFrame, insets: DataFrame, page_width: float) -> DataFrame:
    """Pages whose panel reading is acceptable, after the content guards; ``owned`` has texts or their ``guard_marks``."""
    marked = guard_marks(owned) if "text" in owned.columns else owned
    inset_y = insets.select("page_id", "panel", F.col("y").alias("inset_y"))
    frame = panels.select("page_id", "panel", F.col("y").alias("panel_y")).join(inset_y, ["page_id", "panel"])
    frame = frame.groupBy("page_id", "panel").agg(F.count("*").alias("frames"), F.min("panel_y").alias("panel_y"), F.min("inset_y").alias("inset_y"))
    main = F.col("role") == "main"
    prose = main & (F.col("width") > page_width * 0.12) & F.col("wordy")
    title = (F.col("role") == "glossary") & F.col("titled")
    # Text outside all panels makes one more group of a page, which has no guards of its own.
    per_panel = marked.groupBy("page_id", "panel").agg(
        F.min_by("question", F.when(main, F.struct("y", "x"))).alias("question"),
        F.min(F.when(main, F.col("y"))).alias("first_y"),
        F.count_if(prose).alias("prose"),
        F.count_if(F.col("role") == "glossary").alias("aside"),
        F.count_if(title).alias("titles"),
        F.max(F.when(title, F.col("y"))).alias("title_y"),
        F.count_if(F.col("other")).alias("other"),
        F.bool_or(F.col("role") == "reject").alias("rejected"),
    )
    ok = (
        (F.col("frames") == 1)
        & (F.col("first_y") - F.col("panel_y") <= 40)
        & F.col("question")
        & (F.col("prose") >= 4)
        & (F.col("titles") == 1)
        & (F.col("title_y") - F.col("inset_y") <= 40)
        & (F.col("aside") >= 4)
        & (F.col("other") == 0)
    )
    held = F.col("panel").isNotNull()
    guard = per_panel.join(frame, ["page_id", "panel"], "left").groupBy("page_id").agg(
        F.bool_or("rejected").alias("rejected"), F.bool_and(F.when(held, F.coalesce(ok, F.lit(False)))).alias("content_ok"), F.count_if(held).alias("panels")
    )
    return guard.select("page_id", "panels", (~F.col("rejected") & F.coalesce("content_ok", F.lit(False))).alias("accepted"))


def raster_overlap(regions: DataFrame, images: DataFrame, pages: DataFrame) -> DataFrame:
    """Status of each region against all image boxes of its page (shared edges count)."""
    single = images.select("page_id", "x", "y", "width", "height").distinct()
    boxes = regions.select("page_id", "region_id", "x", "y", "width", "height")
    hit = touching(boxes, single).select("page_id", F.col("l_region_id").alias("region_id")).distinct().withColumn(
        "hit", F.lit(True)
    )
    page = pages.select("page_id", "complete", F.col("width").alias("_pw"), F.col("height").alias("_ph"))
    joined = regions.join(hit, ["page_id", "region_id"], "left").join(page, "page_id", "left")
    on_page = (
        (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") + F.col("width") <= F.col("_pw")) & (F.col("y") + F.col("height") <= F.col("_ph"))
    )
    known = F.coalesce("complete", F.lit(False)) & F.coalesce(on_page, F.lit(False))
    status = F.when(~known, "unknown").when(F.col("hit"), "raster-overlap").otherwise("raster-disjoint")
    return joined.select("page_id", "region_id", status.alias("status"))


def glyph_rule_contacts(glyphs: DataFrame, rules: DataFrame, regions: DataFrame, limit: int | None = None) -> DataFrame:
    """Crossing and touching pairs of painted glyphs and rules per region.

    ``limit``, if given, is a pair budget checked from the two counts: a region above it is ``unknown`` and not paired.
    Spaces take no part.
    """
    g = glyphs.where("text <> ' '")
    n_g = g.groupBy("page_id", "region_id").agg(F.count("*").alias("glyphs"))
    n_r = rules.groupBy("page_id", "region_id").agg(F.count("*").alias("rules"))
    box = regions.select(
        "page_id", "region_id", F.col("x").alias("b_x"), F.col("y").alias("b_y"), F.col("width").alias("b_width"), F.col("height").alias("b_height")
    )
    inside = g.join(box, ["page_id", "region_id"]).groupBy("page_id", "region_id").agg(
        F.bool_and(contains("b_", "")).alias("inside")
    )
    base = (
        n_g.join(n_r, ["page_id", "region_id"])
        .join(inside, ["page_id", "region_id"], "left")
        .withColumn("pairs", F.col("glyphs") * F.col("rules"))
        .withColumn("usable", (F.lit(True) if limit is None else F.col("pairs") <= limit) & F.coalesce("inside", F.lit(False)))
    )
    ready = base.where("usable").select("page_id", "region_id")
    cols = ["page_id", "region_id", "x", "y", "width", "height"]
    key = F.concat_ws("|", F.col("page_id").cast("string"), F.col("region_id"))
    left = g.join(ready, ["page_id", "region_id"], "left_semi").select(*cols).withColumn("page_id", key)
    right = rules.join(ready, ["page_id", "region_id"], "left_semi").select(*cols).withColumn("page_id", key)
    met = touching(left, right).withColumn("cross", crosses("l_", "r_"))
    n = met.groupBy(F.col("l_region_id").alias("region_id")).agg(
        F.count_if(F.col("cross")).alias("crossing"), F.count_if(~F.col("cross")).alias("touching")
    )
    zero = F.lit(0).cast("bigint")
    joined = base.join(n, "region_id", "left").withColumns(
        {"crossing": F.coalesce("crossing", zero), "touching": F.coalesce("touching", zero)}
    )
    status = (
        F.when(~F.col("usable"), "unknown")
        .when(F.col("crossing") > 0, "crossing")
        .when(F.col("touching") > 0, "touching")
        .otherwise("disjoint")
    )
    return joined.select("page_id", "region_id", "glyphs", "rules", "pairs", "crossing", "touching", status.alias("status"))
