"""Structural rules over pages, regions, edges and table cells.

Issues are rows ``(code, page_id or table_id, item)``; no row means no issue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinfold.functions import text as tx
from twinfold.operators import graph
from twinfold.operators.predicates import UNREADABLE, box_inside
from twinfold.session import cut_lineage

# ---- fixed values ----------------------------------------------------------
MAX_HEADER_REFS = 40_000
ROLES = ("header", "value", "blank")
NOTE_ID = r"^[A-Za-z0-9._-]{1,128}\z"
NOTE_LIMIT = 128


def _issue(df: DataFrame, code: str, *keys: str) -> DataFrame:
    return df.select(F.lit(code).alias("code"), *keys)


def usable_tables(tables: DataFrame) -> DataFrame:
    """Tables that have a grid, of any size."""
    return tables.where((F.col("row_count") >= 1) & (F.col("column_count") >= 1))


def _in_grid() -> Column:
    return (
        (F.col("row") >= 0)
        & (F.col("col") >= 0)
        & (F.col("row_span") > 0)
        & (F.col("col_span") > 0)
        & (F.col("row") + F.col("row_span") <= F.col("row_count"))
        & (F.col("col") + F.col("col_span") <= F.col("column_count"))
    )


def grid_occupancy(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """Claims per grid slot: ``(table_id, row, col, claims)`` for slots not claimed exactly once.

    The slot list of a table is bounded by the grid limit, and equal claims are
    counted before the shuffle.
    """
    good = usable_tables(tables)
    spans = cells.join(good, "table_id").where(_in_grid())
    distinct = spans.groupBy("table_id", "row", "col", "row_span", "col_span").agg(F.count("*").alias("n"))
    rows = distinct.select(
        "table_id", "col", "col_span", "n", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("row_span") - 1)).alias("row")
    )
    claims = (
        rows.select("table_id", "row", "n", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("col_span") - 1)).alias("col"))
        .groupBy("table_id", "row", "col")
        .agg(F.sum("n").alias("claims"))
    )
    slots = good.select(
        "table_id", "column_count", F.explode(F.sequence(F.lit(0), F.col("row_count") - 1)).alias("row")
    ).select("table_id", "row", F.explode(F.sequence(F.lit(0), F.col("column_count") - 1)).alias("col"))
    zero = F.lit(0).cast("bigint")
    return (
        slots.join(claims, ["table_id", "row", "col"], "left")
        .select("table_id", "row", "col", F.coalesce("claims", zero).alias("claims"))
        .where("claims <> 1")
    )


def cell_rules(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """Broken cell rules as ``(code, table_id, cell_id, n)``."""
    joined = cells.join(tables, "table_id")
    blank_text = tx.is_blank(F.coalesce("text", F.lit("")))
    blank_reason = tx.is_blank(F.coalesce("blank_reason", F.lit("")))
    row_rules = {
        "invalid-span": ~F.coalesce(_in_grid(), F.lit(False)),
        "invalid-role": ~F.coalesce(F.col("role").isin(*ROLES), F.lit(False)),
        "blank-needs-reason": (F.col("role") == "blank") & blank_reason,
        "blank-with-text": (F.col("role") == "blank") & ~blank_text,
        "value-without-text": (F.col("role") != "blank") & blank_text,
        "unreadable-glyph": F.coalesce(F.col("text").rlike(UNREADABLE), F.lit(False)),
        "repeated-header-ref": F.size("header_ids") != F.size(F.array_distinct("header_ids")),
    }
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(code)) for code, bad in row_rules.items()]))
    per_cell = (
        joined.select("table_id", "cell_id", F.explode_outer(broken).alias("code"))
        .where("code is not null")
        .groupBy("code", "table_id", "cell_id")
        .agg(F.count("*").alias("n"))
    )
    ids = cells.groupBy("table_id", "cell_id").agg(F.count("*").alias("n")).where("n > 1")
    anchors = cells.groupBy("table_id", "row", "col").agg(F.count("*").alias("n")).where("n > 1")
    refs = (
        cells.groupBy("table_id").agg(F.sum(F.size("header_ids")).alias("n")).where(F.col("n") > MAX_HEADER_REFS)
    )
    none = F.lit(None).cast("string").alias("cell_id")
    return (
        per_cell.unionByName(ids.select(F.lit("duplicate-cell").alias("code"), "table_id", "cell_id", "n"))
        .unionByName(
            anchors.select(
                F.lit("duplicate-anchor").alias("code"), "table_id", F.concat_ws(":", "row", "col").alias("cell_id"), "n"
            )
        )
        .unionByName(refs.select(F.lit("too-many-header-refs").alias("code"), "table_id", none, "n"))
    )


def header_cycles(cells: DataFrame) -> DataFrame:
    """Invalid header targets and tables whose header references form a cycle.

    References meet the header cells once; what is found is written for the count and for the search for cycles.
    """
    refs = cells.select("table_id", "cell_id", F.explode("header_ids").alias("header_id")).distinct()
    heads = cells.where("role = 'header'").select("table_id", F.col("cell_id").alias("header_id")).distinct()
    valid = F.coalesce(F.col("_head") & (F.col("cell_id") != F.col("header_id")), F.lit(False))
    judged = refs.join(heads.withColumn("_head", F.lit(True)), ["table_id", "header_id"], "left").withColumn("_valid", valid)
    judged = cut_lineage(judged.select("table_id", F.col("header_id").alias("src"), F.col("cell_id").alias("dst"), "_valid"))
    invalid = judged.where("not _valid").groupBy("table_id").agg(F.count("*").alias("invalid_targets"))
    cyclic = graph.cycle_groups(judged.where("_valid").drop("_valid"), "table_id", distinct=True).withColumn("cyclic", F.lit(True))
    return invalid.join(cyclic, "table_id", "full_outer").select(
        "table_id",
        F.coalesce("invalid_targets", F.lit(0).cast("bigint")).alias("invalid_targets"),
        F.coalesce("cyclic", F.lit(False)).alias("cyclic"),
    )


def reading_links(edges: DataFrame) -> DataFrame:
    return edges.where("type = 'reading-next'").select(
        "page_id", F.col("from_id").alias("src"), F.col("to_id").alias("dst"), "status"
    )


def reading_cycles(edges: DataFrame) -> DataFrame:
    return graph.cycle_groups(reading_links(edges), "page_id")


def reading_path(regions: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """One verdict per page: whether its targets lie on one verified chain.

    ``ambiguous``, ``disconnected``, ``unverified`` or ``ok``; pages with fewer
    than two targets are ``ok``.
    """
    known = regions.select("page_id", "region_id").distinct()
    links = (
        reading_links(edges)
        .join(known.withColumnRenamed("region_id", "src"), ["page_id", "src"], "left_semi")
        .join(known.withColumnRenamed("region_id", "dst"), ["page_id", "dst"], "left_semi")
    )
    branching = graph.branching_groups(links, "page_id").withColumn("branching", F.lit(True))
    simple = links.join(branching, "page_id", "left_anti")
    placed = graph.chain_positions(known.join(branching, "page_id", "left_anti"), simple, "page_id", "region_id")
    wanted = targets.select("page_id", "region_id").distinct()
    counts = wanted.groupBy("page_id").agg(F.count("*").alias("targets"))
    spans = (
        wanted.join(placed, ["page_id", "region_id"])
        .groupBy("page_id", "root")
        .agg(F.count("*").alias("found"), F.min("position").alias("lo"), F.max("position").alias("hi"))
        .join(counts, "page_id")
        .where("found = targets")
    )
    open_steps = (
        simple.where("status <> 'verified'")
        .join(placed.withColumnRenamed("region_id", "src"), ["page_id", "src"])
        .join(spans, ["page_id", "root"])
        .where("position >= lo and position < hi")
        .groupBy("page_id")
        .agg(F.count("*").alias("open_steps"))
    )
    joined = counts.join(branching, "page_id", "left").join(
        spans.select("page_id", "found"), "page_id", "left"
    ).join(open_steps, "page_id", "left")
    verdict = (
        F.when(F.col("targets") < 2, "ok")
        .when(F.col("branching"), "ambiguous")
        .when(F.col("found").isNull(), "disconnected")
        .when(F.col("open_steps") > 0, "unverified")
        .otherwise("ok")
    )
    return joined.select("page_id", verdict.alias("verdict"))


def fragment_ownership(owned: DataFrame, fragments: DataFrame) -> DataFrame:
    """Duplicate, missing and foreign fragments as ``(code, page_id, frag_id)``."""
    claims = owned.groupBy("page_id", "frag_id").agg(F.count("*").alias("n"))
    expected = fragments.select("page_id", "frag_id").distinct().withColumn("known", F.lit(True))
    both = claims.join(expected, ["page_id", "frag_id"], "full_outer")
    codes = F.array_compact(
        F.array(
            F.when(F.col("n") > 1, F.lit("duplicate-fragment")),
            F.when(F.col("n").isNull(), F.lit("missing-fragment")),
            F.when(F.col("known").isNull(), F.lit("foreign-fragment")),
        )
    )
    return both.select(F.explode(codes).alias("code"), "page_id", "frag_id")


def parse_note_ref(ref: Column) -> Column:
    """``struct(region, cell)`` of ``region`` or ``region@cell``; NULL when malformed."""
    shape = r"^([A-Za-z0-9._-]{1,128})(?:@([A-Za-z0-9._-]{1,128}))?\z"
    cell = F.regexp_extract(ref, shape, 2)
    return F.when(
        ref.rlike(shape),
        F.struct(F.regexp_extract(ref, shape, 1).alias("region"), F.when(cell != "", cell).alias("cell")),
    )


def footnote_targets(refs: DataFrame, regions: DataFrame, cells: DataFrame) -> DataFrame:
    """Verdict per note over its ``refs(page_id, note_id, ref)``.

    References are counted per distinct value first, then joined.
    """
    counted = refs.groupBy("page_id", "note_id", "ref").agg(F.count("*").alias("n")).withColumn(
        "p", parse_note_ref(F.col("ref"))
    )
    target = regions.select(
        "page_id",
        F.col("region_id").alias("_region"),
        F.col("type").alias("_type"),
        F.col("status").alias("_status"),
    ).dropDuplicates(["page_id", "_region"])
    cell_n = cells.groupBy(F.col("table_id").alias("_region"), F.col("cell_id").alias("_cell")).agg(
        F.count("*").alias("_cells")
    )
    broad = (
        counted.where("p.cell is null and p is not null")
        .select("page_id", "note_id", F.col("p.region").alias("_region"))
        .distinct()
        .withColumn("_broad", F.lit(True))
    )
    joined = (
        counted.withColumns({"_region": F.col("p.region"), "_cell": F.col("p.cell")})
        .join(target, ["page_id", "_region"], "left")
        .join(cell_n, ["_region", "_cell"], "left")
        .join(broad, ["page_id", "note_id", "_region"], "left")
    )
    problem = (
        F.when(F.col("p").isNull(), "malformed")
        .when(F.col("n") > 1, "repeated")
        .when(F.col("_cell").isNotNull() & F.col("_broad"), "overlapping")
        .when(F.col("_type").isNull(), "absent")
        .when(F.col("_region") == F.col("note_id"), "self")
        .when(F.col("_type") == "footnote", "note-to-note")
        .when(F.col("_status") != "verified", "unverified")
        .when(F.col("_cell").isNotNull() & (F.col("_type") != "table"), "cell-outside-table")
        .when(F.col("_cell").isNotNull() & (F.coalesce("_cells", F.lit(0)) != 1), "cell-missing")
    )
    per_note = joined.withColumn("problem", problem).groupBy("page_id", "note_id").agg(
        F.sum("n").alias("refs"), F.min("problem").alias("problem")
    )
    verdict = F.when(F.col("refs") > NOTE_LIMIT, "too-many").otherwise(F.coalesce("problem", F.lit("ok")))
    return per_note.select("page_id", "note_id", "refs", verdict.alias("verdict"))


def caption_targets(regions: DataFrame, edges: DataFrame) -> DataFrame:
    """Every caption with its link verdict."""
    links = edges.where("type = 'caption-of'").select(
        "page_id", F.col("from_id").alias("region_id"), F.col("to_id").alias("target"), F.col("status").alias("edge_status")
    )
    goal = regions.select(
        "page_id",
        F.col("region_id").alias("target"),
        (
            F.col("type").isin("figure", "table")
            & (F.col("status") == "verified")
            & box_inside("x", "y", "width", "height", F.col("page_width"), F.col("page_height"))
            & ~F.coalesce("text", F.lit("")).rlike(UNREADABLE)
        ).alias("good"),
    )
    per = (
        links.join(goal, ["page_id", "target"], "left")
        .groupBy("page_id", "region_id")
        .agg(
            F.count("*").alias("links"),
            F.count_if(F.col("edge_status") == "verified").alias("verified"),
            F.count_if(F.coalesce("good", F.lit(False))).alias("good"),
        )
    )
    captions = regions.where("type = 'caption'").select("page_id", "region_id")
    joined = captions.join(per, ["page_id", "region_id"], "left")
    verdict = (
        F.when(F.col("links").isNull(), "unlinked")
        .when((F.col("links") != 1) | (F.col("verified") != 1), "unresolved")
        .when(F.col("good") != 1, "invalid-target")
        .otherwise("ok")
    )
    return joined.select("page_id", "region_id", verdict.alias("verdict"))


def region_issues(regions: DataFrame) -> DataFrame:
    """Row-level region issues of a whole-page check, one narrow pass."""
    rules = {
        "invalid-box": ~box_inside("x", "y", "width", "height", F.col("page_width"), F.col("page_height")),
        "unreadable-glyph": F.coalesce("text", F.lit("")).rlike(UNREADABLE),
        "unreasoned-exclusion": (F.col("status") == "excluded") & tx.is_blank(F.coalesce("exclusion_reason", F.lit(""))),
        "unverified-region": F.col("status") != "verified",
    }
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(code)) for code, bad in rules.items()]))
    return regions.select("page_id", F.col("region_id").alias("item"), F.explode_outer(broken).alias("code")).where(
        "code is not null"
    )


def validate_page(
    pages: DataFrame, regions: DataFrame, edges: DataFrame, owned: DataFrame, fragments: DataFrame
) -> DataFrame:
    """Issue counts ``(page_id, code, n)`` of whole-page validation."""
    row = region_issues(regions).select("page_id", "code")
    repeated = (
        regions.groupBy("page_id", "region_id").count().where("count > 1").select("page_id", F.lit("duplicate-region").alias("code"))
    )
    owner = fragment_ownership(owned, fragments).select("page_id", "code")
    inventory = pages.where("not visual_inventory_confirmed").select("page_id", F.lit("inventory-unconfirmed").alias("code"))
    open_edges = edges.where("status <> 'verified'").select("page_id", F.lit("unverified-edge").alias("code"))
    known = regions.select("page_id", "region_id").distinct()
    loose = (
        edges.join(known.withColumnRenamed("region_id", "to_id"), ["page_id", "to_id"], "left_anti")
        .unionByName(edges.join(known.withColumnRenamed("region_id", "from_id"), ["page_id", "from_id"], "left_anti"))
        .select("page_id", F.lit("dangling-edge").alias("code"))
    )
    cycles = reading_cycles(edges).select("page_id", F.lit("reading-cycle").alias("code"))
    caption = caption_targets(regions, edges).where("verdict <> 'ok'").select(
        "page_id", F.lit("caption-link").alias("code")
    )
    everything = row
    for part in (repeated, owner, inventory, open_edges, loose, cycles, caption):
        everything = everything.unionByName(part)
    return everything.groupBy("page_id", "code").agg(F.count("*").alias("n"))


def restructure_check(before: DataFrame, after: DataFrame, regions: DataFrame, edges: DataFrame) -> DataFrame:
    """Verdict per edit: fragments kept exactly once, text kept, sources adjacent, no other links.

    ``before(edit_id, page_id, region_id, ord)``; ``after(edit_id, ord, text,
    frag_ids)``; regions carry ``text`` and ``frag_ids``.
    """
    originals = before.join(regions.select("page_id", "region_id", "text", "frag_ids"), ["page_id", "region_id"])

    def fragments(df: DataFrame, name: str) -> DataFrame:
        return (
            df.select("edit_id", F.explode("frag_ids").alias("f")).groupBy("edit_id", "f").agg(F.count("*").alias(name))
        )

    moved = (
        fragments(originals, "n_before")
        .join(fragments(after, "n_after"), ["edit_id", "f"], "full_outer")
        .groupBy("edit_id")
        .agg(F.bool_and(F.col("n_before").eqNullSafe(1) & F.col("n_after").eqNullSafe(1)).alias("fragments_kept"))
    )

    def content(df: DataFrame, name: str) -> DataFrame:
        bare = F.regexp_replace("text", r"(?U)\s+", "")
        parts = F.array_sort(F.collect_list(F.struct("ord", bare.alias("t"))))
        return df.groupBy("edit_id").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias(name))

    same = content(originals, "a").join(content(after, "b"), "edit_id").select("edit_id", (F.col("a") == F.col("b")).alias("text_kept"))
    order = Window.partitionBy("edit_id").orderBy("ord")
    steps = before.withColumn("next_id", F.lead("region_id").over(order)).where("next_id is not null")
    linked = steps.join(
        edges.where("type = 'reading-next'").select(
            "page_id", F.col("from_id").alias("region_id"), F.col("to_id").alias("next_id"), F.lit(True).alias("linked")
        ).distinct(),
        ["page_id", "region_id", "next_id"],
        "left",
    ).groupBy("edit_id").agg(F.bool_and(F.coalesce("linked", F.lit(False))).alias("adjacent"))
    semantic = edges.where("type <> 'reading-next'").select("page_id", F.explode(F.array("from_id", "to_id")).alias("region_id")).distinct()
    touched = before.join(semantic, ["page_id", "region_id"], "left_semi").select("edit_id").distinct().withColumn(
        "touched", F.lit(True)
    )
    edits = before.select("edit_id").distinct()
    yes, no = F.lit(True), F.lit(False)
    return (
        edits.join(moved, "edit_id", "left")
        .join(same, "edit_id", "left")
        .join(linked, "edit_id", "left")
        .join(touched, "edit_id", "left")
        .select(
            "edit_id",
            F.coalesce("fragments_kept", yes).alias("fragments_kept"),
            F.coalesce("text_kept", no).alias("text_kept"),
            F.coalesce("adjacent", yes).alias("adjacent"),
            F.coalesce("touched", no).alias("semantic_link"),
        )
    )


def invalidate_closure(edges: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(regions, edges)`` that return to proposed when ``changed(page_id, node)`` change.

    Captions and notes pointing at a changed region change too, transitively.
    """
    up = edges.where("type in ('caption-of', 'footnote-of') and from_id <> to_id").select(
        "page_id", F.col("to_id").alias("src"), F.col("from_id").alias("dst")
    )
    hit = graph.reach(up, changed, "page_id")
    touched = (
        edges.join(hit.withColumnRenamed("node", "from_id"), ["page_id", "from_id"], "left_semi")
        .unionByName(edges.join(hit.withColumnRenamed("node", "to_id"), ["page_id", "to_id"], "left_semi"))
        .select("page_id", "edge_id")
        .distinct()
    )
    return hit, touched


def cell_binding_check(cells: DataFrame, assignments: DataFrame, fragments: DataFrame) -> DataFrame:
    """Verdict per table: every fragment in one cell and joined text equal to the cell text.

    ``assignments(table_id, cell_id, frag_id, ord, joiner)``.
    """
    claims = assignments.groupBy("table_id", "frag_id").agg(F.count("*").alias("n"))
    owned = fragments.select("table_id", "frag_id").distinct().join(claims, ["table_id", "frag_id"], "full_outer")
    per_frag = owned.groupBy("table_id").agg(F.bool_and(F.col("n").eqNullSafe(1)).alias("fragments_ok"))
    parts = F.array_sort(F.collect_list(F.struct("ord", F.concat(F.coalesce("joiner", F.lit("")), F.col("frag_text")).alias("t"))))
    texts = (
        assignments.join(fragments.select("table_id", "frag_id", F.col("text").alias("frag_text")), ["table_id", "frag_id"])
        .groupBy("table_id", "cell_id")
        .agg(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("joined"))
    )
    filled = cells.where("role <> 'blank'").join(texts, ["table_id", "cell_id"], "left")
    per_cell = filled.groupBy("table_id").agg(F.bool_and(F.col("joined").eqNullSafe(F.col("text"))).alias("texts_ok"))
    return per_cell.join(per_frag, "table_id", "full_outer").select(
        "table_id",
        F.coalesce("fragments_ok", F.lit(False)).alias("fragments_ok"),
        F.coalesce("texts_ok", F.lit(True)).alias("texts_ok"),
    )
