"""Reading order of positioned fragments.

The two long operators write what they need of their input to the checkpoint folder
once, because every later branch reads it again. Rows, gutters and lines are joins and windows over ``fragments(page_id, frag_id,
text, x, y, width, height)``. A crowded page is cut into bands of y, and only one
text line is ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinfold.functions import text as tx
from twinfold.operators import geometry as ge
from twinfold.operators import graph
from twinfold.operators.wide_window import next_mark, previous_value, running_before
from twinfold.session import cut_lineage

# ---- fixed values ----------------------------------------------------------
SAME_ROW, TOUCH, SPACE_GAP = 0.45, 0.12, 0.12
PROSE_WORDS, PROSE_WIDTH, SHORT_PROSE_WIDTH, CROSS_WIDTH = 6, 0.25, 0.12, 0.65
GAP_WIDTH, SPAN_WIDTH, VETO_ROWS, PROSE_LINES = 0.015, 0.4, 5, 4
ROW_TILE = 512.0
RANK_TILE = 64


def visible(fragments: DataFrame) -> DataFrame:
    """Fragments with text and finite boxes; heights are at least one."""
    ok = ~tx.is_blank(F.col("text"))
    for c in ("x", "y", "width", "height"):
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return fragments.where(ok).withColumn("height", F.greatest(F.lit(1.0), "height"))


def _row_tiles(fragments: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``row_tile``: a tile of y that no text row leaves.

    A tile whose first fragment does not surely start a row belongs to the tile above it. That shows from the tiles'
    first and last fragments, so only those are shuffled; fragments are joined only if some tile belongs to another.
    """
    tiled = fragments.withColumn("row_tile", F.floor(F.col("y") / ROW_TILE)).where("row_tile is not null")
    ends = tiled.groupBy(*keys, "row_tile").agg(
        F.min(F.struct("y", "x", "frag_id", "height")).alias("_first"), F.max("y").alias("_last")
    )
    down = Window.partitionBy(*keys).orderBy("row_tile")
    step = F.col("_first.y") - F.lag("_last").over(down)
    own = F.when(F.coalesce(step >= SAME_ROW * F.col("_first.height"), F.lag("_last").over(down).isNull()), F.col("row_tile"))
    homes = ends.withColumn("_own", own).select(*keys, "row_tile", F.last("_own", True).over(down).alias("_home"))
    moved = cut_lineage(homes.where("_home <> row_tile"))
    if moved.isEmpty():
        return tiled
    home = F.coalesce("_home", "row_tile")
    return tiled.join(moved, [*keys, "row_tile"], "left").withColumn("row_tile", home).drop("_home")


def group_rows(fragments: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Add ``row_y``, ``row_x`` and ``row_frag``: the first fragment of the text row; and ``row_tile``, by which rows lie together.

    A fragment joins the current row while its y is close to that of the row's
    first fragment. A step of y beyond the reach of the fragment always starts a
    row, so the fold runs only inside such islands, each about one text line.
    Fragments are shuffled once, by keys and ``row_tile``.
    """
    keys = keys or ["page_id"]
    order = ["y", "x", "frag_id"]
    plain = [c for c in fragments.columns if c not in (*keys, *order, "height")]
    by = [*keys, "row_tile"]
    local = Window.partitionBy(*by).orderBy(*order)
    far = F.col("y") - F.lag("y").over(local) >= SAME_ROW * F.col("height")
    starts = _row_tiles(fragments, keys).withColumn("_start", F.when(F.coalesce(far, F.lit(True)), 1).otherwise(0))
    members = starts.withColumn("_island", F.sum("_start").over(local))
    folded = members.groupBy(*by, "_island").agg(F.array_sort(F.collect_list(F.struct(*order, "height", *plain))).alias("items"))
    start = F.col("items")[0]
    marked_type = "struct<y:double,x:double,frag_id:bigint,height:double>"
    begin = F.expr(f"struct(cast(null as {marked_type}) as a, cast(array() as array<{marked_type}>) as o)")

    def near(a: Column, it: Column) -> Column:
        return F.coalesce(F.abs(a["y"] - it["y"]) < F.least(a["height"], it["height"]) * SAME_ROW, F.lit(False))

    def mark(it: Column) -> Column:
        return F.struct(it["y"], it["x"], it["frag_id"], it["height"]).cast(marked_type)

    def step(state: Column, it: Column) -> Column:
        anchor = F.when(near(state["a"], it), state["a"]).otherwise(mark(it))
        return F.struct(anchor.alias("a"), F.concat(state["o"], F.array(anchor)).alias("o"))

    together = F.forall("items", lambda i: near(start, i))
    anchors = F.when(together, F.transform("items", lambda i: mark(start))).otherwise(
        F.aggregate("items", begin, step, lambda s: s["o"])
    )
    pairs = folded.select(*by, F.explode(F.arrays_zip(F.col("items").alias("i"), anchors.alias("a"))).alias("m"))
    return pairs.select(
        *[F.col(c) if c in keys else F.col(f"m.i.{c}").alias(c) for c in fragments.columns],
        F.col("m.a.y").alias("row_y"),
        F.col("m.a.x").alias("row_x"),
        F.col("m.a.frag_id").alias("row_frag"),
        "row_tile",
    )


def line_text(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One line per text row: joined text, box, fragment ids in x order."""
    keys = keys or ["page_id"]
    item = F.struct("x", "y", "frag_id", "width", "height", "text")
    together = ["row_tile"] if "row_tile" in rows.columns else []
    by_row = rows.groupBy(*keys, *together, "row_y", "row_x", "row_frag").agg(
        F.array_sort(F.collect_list(item)).alias("items"),
        F.min("x").alias("x"),
        F.min("y").alias("y"),
        F.max(F.col("x") + F.col("width")).alias("_right"),
        F.max(F.col("y") + F.col("height")).alias("_bottom"),
    )

    def piece(it: Column, i: Column) -> Column:
        last = F.try_element_at("items", i)
        gap = it["x"] - last["x"] - last["width"]
        spaced = (
            (i > 0)
            & (gap > F.greatest(F.lit(1.0), it["height"] * SPACE_GAP))
            & ~last["text"].rlike(r"(?U)\s\z")
            & ~it["text"].rlike(r"(?U)^\s")
        )
        return F.concat(F.when(F.coalesce(spaced, F.lit(False)), F.lit(" ")).otherwise(F.lit("")), it["text"])

    return by_row.select(
        *keys,
        "row_y",
        "row_x",
        "row_frag",
        tx.strip_space(F.array_join(F.transform("items", piece), "")).alias("text"),
        "x",
        "y",
        (F.col("_right") - F.col("x")).alias("width"),
        (F.col("_bottom") - F.col("y")).alias("height"),
        F.transform("items", lambda i: i["frag_id"]).alias("fragment_ids"),
    )


def _cuts(start: float, end: float) -> list[float]:
    found, at = [], start
    while at <= end:
        found.append(at)
        at += 0.01
    return found


def _words() -> Column:
    return F.size(F.split(tx.strip_space(F.col("text")), r"(?U)\s+"))


def _ranked(fragments: DataFrame, value: Column, name: str) -> DataFrame:
    """Value and 0-based rank of the distinct values of a page with their counts."""
    counted = fragments.groupBy("page_id", value.alias(name)).agg(F.count("*").alias("n"))
    tile = F.floor(F.col(name) / ROW_TILE)
    return running_before(counted, ["page_id"], tile, [F.col(name)], {"rank": F.col("n")})


def _value_at(wanted: DataFrame, rank: str, ranks: DataFrame, name: str) -> DataFrame:
    """The value ``name`` at a wanted rank; a rank meets only the values of its own stretch of ranks."""
    stretch = lambda c: F.floor(c / RANK_TILE)
    held = ranks.withColumn("_t", F.explode(F.sequence(stretch(F.col("rank")), stretch(F.col("rank") + F.col("n") - 1))))
    asked = wanted.select("page_id", rank, stretch(F.col(rank)).alias("_t")).distinct()
    found = asked.join(held, ["page_id", "_t"]).where(F.col(rank).between(F.col("rank"), F.col("rank") + F.col("n") - 1))
    return found.select("page_id", rank, F.col("edge").alias(name))


def _runs(rows: DataFrame) -> DataFrame:
    """Touching runs of a row as ``(page_id, x0, x1, words)``; windows span one row."""
    by = ["page_id", *(["row_tile"] if "row_tile" in rows.columns else []), "row_frag"]
    w = Window.partitionBy(*by).orderBy("x", "y", "frag_id")
    gap = F.col("x") - F.lag(F.col("x") + F.col("width")).over(w)
    reach = F.greatest(F.lit(2.0), F.least(F.col("height"), F.lag("height").over(w)) * 0.3)
    new = F.when(F.coalesce(gap > reach, F.lit(False)), 1).otherwise(0)
    marked = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    return marked.groupBy(*by, "_run").agg(
        F.min("x").alias("x0"),
        F.max_by(F.col("x") + F.col("width"), F.struct("x", "y", "frag_id")).alias("x1"),
        F.sum("words").alias("words"),
    )


def _search(fragments: DataFrame, runs: DataFrame, ranks_right: DataFrame, ranks_left: DataFrame, fractions: list[float]) -> DataFrame:
    """All gutter measures per page and cut, from at most one bin per cut and page.

    Fragments left of a cut are a prefix of the page in order of right edges, and
    those right of it a suffix in order of left edges, so the percentiles are
    values at known ranks and nothing is repeated per cut.
    """
    cuts = F.array(*[F.lit(f) for f in fractions])
    n_cuts = len(fractions)
    width = F.col("page_width")
    right = F.col("x") + F.col("width")

    def cuts_before(edge: Column, own: bool) -> Column:
        """Number of cuts left of an edge, a cut at the edge with ``own``; cuts are 0.01 apart, so four tries decide."""
        left = (lambda f: width * f <= edge) if own else (lambda f: width * f < edge)
        guess = F.floor((edge / width - fractions[0]) / 0.01).cast("int") - 1
        low = F.greatest(F.lit(0), F.least(F.lit(n_cuts), guess))
        near = sum((F.when((low + k < n_cuts) & left(F.get(cuts, low + k)), 1).otherwise(0) for k in range(4)), low)
        return F.when(width > 0, near).otherwise(F.size(F.filter(cuts, left)))

    body = (F.col("width") > width * PROSE_WIDTH) & (F.col("words") >= PROSE_WORDS)
    short = (F.col("width") > width * SHORT_PROSE_WIDTH) & (F.col("words") >= PROSE_WORDS)
    binned = fragments.withColumns(
        {
            "_rb": cuts_before(right, False),
            "_lb": cuts_before(F.col("x"), True),
            "_body": body,
            "_short": short,
            "_narrow": F.col("width") < width * CROSS_WIDTH,
            "_right": right,
        }
    )
    # Each fragment counts once where its right edge lies and once where its left edge lies.
    ends = F.array(F.struct(F.col("_rb").alias("c"), F.lit(True).alias("left")), F.struct(F.col("_lb").alias("c"), F.lit(False).alias("left")))
    events = binned.select("page_id", "page_width", "x", "y", "_body", "_short", "_narrow", "_right", F.inline(ends))
    left, starts = F.col("left"), ~F.col("left")
    counted = events.groupBy("page_id", "c").agg(
        F.first("page_width").alias("page_width"),
        F.count_if(left).alias("nl"),
        F.min(F.when(left, F.col("y"))).alias("l_lo"),
        F.max(F.when(left, F.col("y"))).alias("l_hi"),
        F.count_if(left & F.col("_body")).alias("bl"),
        F.max(F.when(left & F.col("_body"), F.col("_right"))).alias("b_end"),
        F.count_if(left & F.col("_short")).alias("sl"),
        F.count_if(left & F.col("_narrow")).alias("close_n"),
        F.count_if(left & F.col("_narrow") & F.col("_body")).alias("close_b"),
        F.count_if(starts).alias("nr"),
        F.min(F.when(starts, F.col("y"))).alias("r_lo"),
        F.max(F.when(starts, F.col("y"))).alias("r_hi"),
        F.count_if(starts & F.col("_body")).alias("br"),
        F.min(F.when(starts & F.col("_body"), F.col("x"))).alias("b_start"),
        F.count_if(starts & F.col("_short")).alias("sr"),
        F.count_if(starts & F.col("_narrow")).alias("open_n"),
        F.count_if(starts & F.col("_narrow") & F.col("_body")).alias("open_b"),
    )
    wide = runs.select(
        "page_id",
        F.explode(
            F.array(
                F.struct(cuts_before(F.col("x0"), True).alias("c"), F.lit(1).alias("d")),
                F.struct(cuts_before(F.col("x1"), False).alias("c"), F.lit(-1).alias("d")),
            )
        ).alias("e"),
    )
    spans = wide.groupBy("page_id", F.col("e.c").alias("c")).agg(F.sum("e.d").alias("span_d"))
    # Edges of runs are edges of fragments. A cut without an edge measures like the one before it, which would win the tie.
    full = counted.join(spans, ["page_id", "c"], "left")
    upto = Window.partitionBy("page_id").orderBy("c").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("page_id").orderBy("c").rowsBetween(1, Window.unboundedFollowing)
    zero = F.lit(0)
    cum = {n: F.coalesce(F.sum(n).over(upto), zero) for n in ("nl", "bl", "sl", "close_n", "close_b", "open_n", "open_b", "span_d")}
    cum |= {n: F.coalesce(F.sum(n).over(after), zero) for n in ("nr", "br", "sr")}
    cum |= {n: F.min(n).over(upto) for n in ("l_lo",)} | {n: F.max(n).over(upto) for n in ("l_hi", "b_end")}
    cum |= {n: F.min(n).over(after) for n in ("r_lo", "b_start")} | {"r_hi": F.max("r_hi").over(after)}
    page = Window.partitionBy("page_id")
    measured = full.select(
        "page_id", F.sum("nl").over(page).alias("total"), "page_width", "c", *[e.alias(n) for n, e in cum.items()]
    ).where((F.col("c") < n_cuts) & (F.col("nl") >= 2) & (F.col("nr") >= 2))
    half_up = lambda v: F.floor(v + 0.5)
    targets = measured.withColumns(
        {
            "_rank_l": half_up((F.col("nl") - 1) * 0.9),
            "_rank_r": F.col("total") - F.col("nr") + half_up((F.col("nr") - 1) * 0.1),
        }
    )
    wanted = targets.select("page_id", F.col("_rank_l").cast("bigint").alias("_rank_l"), F.col("_rank_r").cast("bigint").alias("_rank_r"))
    left_at = _value_at(wanted, "_rank_l", ranks_right, "gap_start")
    right_at = _value_at(wanted, "_rank_r", ranks_left, "gap_end")
    return targets.join(left_at, ["page_id", "_rank_l"]).join(right_at, ["page_id", "_rank_r"])


def _best(prose_score: bool, require_prose: bool) -> Column:
    """The cut of the best gap per page, as an aggregate over the measures."""
    start, end = ("b_end", "b_start") if prose_score else ("gap_start", "gap_end")
    n_left, n_right = ("bl", "br") if prose_score else ("nl", "nr")
    crossing = (
        F.col("open_b") - F.col("close_b") if prose_score else F.col("open_n") - F.col("close_n")
    )
    overlap = F.least("l_hi", "r_hi") - F.greatest("l_lo", "r_lo")
    ok = (F.col(end) - F.col(start) >= F.col("page_width") * GAP_WIDTH) & (overlap > 0)
    if prose_score:
        ok = ok & (F.col("bl") >= PROSE_LINES) & (F.col("br") >= PROSE_LINES)
    if require_prose:
        ok = ok & (F.col("sl") >= PROSE_LINES) & (F.col("sr") >= PROSE_LINES)
    veto = (F.col("span_d") >= VETO_ROWS) & (F.col("span_d") > F.col("bl") + F.col("br"))
    score = F.least(n_left, n_right) * 2 - crossing * 3
    return F.max_by((F.col(start) + F.col(end)) / 2, F.when(ok & ~veto & (score > 0), F.struct(score, -F.col("c"))))


def find_gutter(fragments: DataFrame, rows: DataFrame | None = None, prefer_prose: bool = True) -> DataFrame:
    """``(page_id, cut)`` of two-column pages; fragments carry ``page_width``.

    Fragments are written once without their texts, and the wide runs of words once, as both searches read them.
    """
    names = ["page_id", "frag_id", "x", "y", "width", "height", "page_width"]
    fragments = cut_lineage(fragments.select(*names, _words().alias("words")))
    rows = rows.withColumn("words", _words()) if rows is not None else group_rows(fragments.drop("page_width"))
    runs = _runs(rows).where(F.col("words") >= PROSE_WORDS).join(fragments.select("page_id", "page_width").distinct(), "page_id")
    runs = cut_lineage(runs.where(F.col("x1") - F.col("x0") > F.col("page_width") * SPAN_WIDTH))
    right_ranks = _ranked(fragments, F.col("x") + F.col("width"), "edge")
    left_ranks = _ranked(fragments, F.col("x"), "edge")
    middle = _search(fragments, runs, right_ranks, left_ranks, _cuts(0.35, 0.65))
    outer = _search(fragments, runs, right_ranks, left_ranks, _cuts(0.25, 0.75))
    prose = _best(True, False) if prefer_prose else F.lit(None).cast("double")
    inner = middle.groupBy("page_id").agg(prose.alias("c1"), _best(False, False).alias("c2"))
    found = inner.join(outer.groupBy("page_id").agg(_best(False, True).alias("c3")), "page_id", "full_outer")
    return found.select("page_id", F.coalesce("c1", "c2", "c3").alias("cut")).where("cut is not null")


def _spanning(fragments: DataFrame) -> DataFrame:
    """Fragments that cross the cut, with everything touching them on their line."""
    cols = ["page_id", "frag_id", "x", "y", "width", "height"]
    seed = fragments.where("x < cut and x + width > cut")
    pages = fragments.join(seed.select("page_id").distinct(), "page_id", "left_semi").select(*cols)
    inflated = pages.select(
        "page_id", "frag_id", (F.col("x") - 2.0).alias("x"), "y", (F.col("width") + 4.0 + F.col("height") * TOUCH).alias("width"), "height",
        F.col("x").alias("ox"), F.col("width").alias("ow"),
    )
    near = ge.touching(inflated, inflated)
    low = F.least("l_height", "r_height")
    gap = F.least(
        F.abs(F.col("l_ox") - F.col("r_ox") - F.col("r_ow")), F.abs(F.col("r_ox") - F.col("l_ox") - F.col("l_ow"))
    )
    links = near.where(
        (F.col("l_frag_id") != F.col("r_frag_id"))
        & (F.abs(F.col("l_y") - F.col("r_y")) < low * SAME_ROW)
        & (gap <= F.greatest(F.lit(1.0), low * TOUCH))
    ).select("page_id", F.col("l_frag_id").alias("src"), F.col("r_frag_id").alias("dst"))
    hit = graph.reach(links, seed.select("page_id", F.col("frag_id").alias("node")), "page_id")
    return hit.withColumnRenamed("node", "frag_id").withColumn("spanning", F.lit(True))


def reading_order(fragments: DataFrame, gutters: DataFrame | None = None) -> DataFrame:
    """Lines in reading order: ``(page_id, seq, text, box, column, fragment_ids)``.

    Separator lines cross the gutter and split the page into bands; a band is
    read left column first. ``gutters(page_id, cut)`` lists two-column pages; without it there are none.
    """
    items = visible(fragments)
    items = items.withColumn("cut", F.lit(None).cast("double")) if gutters is None else items.join(gutters, "page_id", "left")
    lines = ordered_lines(items, gutters is not None)
    return sequence_lines(lines, [F.col(c) for c in LINE_ORDER]).select(
        "page_id", "seq", "text", "x", "y", "width", "height", "column", "fragment_ids"
    )


#: Columns of ``ordered_lines`` that order the lines of a page.
LINE_ORDER = ("_ky", "_kx", "_kf", "part", "_oy", "_ox", "_ry", "row_x", "row_frag")


def ordered_lines(items: DataFrame, columns: bool = True) -> DataFrame:
    """Lines with the columns ``LINE_ORDER``; ``items`` are visible fragments with ``cut``, null on one-column pages.

    Without ``columns`` every page is a one-column page.

    One-column pages have no separators, so their fragments go straight into rows. On the others the fragments are placed
    without their texts, which are joined again once.
    """
    end = F.struct(F.lit(float("inf")).alias("y"), F.lit(float("inf")).alias("x"), F.lit(0).cast("bigint").alias("f"))
    plain = line_text(group_rows(items.where("cut is null"))).withColumns({"k": end, "part": F.lit(0), "column": F.lit("full")})
    lines = plain
    if columns:
        crossed = cut_lineage(items.where("cut is not null"))
        placed = cut_lineage(_placed(crossed.drop("text"), end))
        keys = ["page_id", "k", "part", "column"]
        lines = line_text(group_rows(crossed.join(placed, ["page_id", "frag_id"]), keys), keys).unionByName(plain)
    on_separator = F.col("part") == 2
    return lines.withColumns(
        {
            "_ky": F.col("k.y"),
            "_kx": F.col("k.x"),
            "_kf": F.col("k.f"),
            "_oy": F.when(on_separator, F.col("x")).otherwise(F.col("row_y")),
            "_ox": F.when(on_separator, F.when(F.col("column") == "left", 0).when(F.col("column") == "full", 1).otherwise(2)).otherwise(0),
            "_ry": F.col("row_y"),
        }
    )


def _placed(items: DataFrame, end: Column) -> DataFrame:
    """``(page_id, frag_id, k, part, column)``: the separator above which a fragment is read, and its side."""
    span = _spanning(items)
    marked = items.join(span, ["page_id", "frag_id"], "left").withColumn("spanning", F.coalesce("spanning", F.lit(False)))
    sep_rows = group_rows(marked.where("spanning"))
    seps = sep_rows.groupBy("page_id", "row_tile", "row_frag", "row_y", "row_x").agg(
        F.min("y").alias("sep_y"), F.max(F.when(F.col("frag_id") == F.col("row_frag"), F.col("height"))).alias("anchor_h")
    )
    seps = cut_lineage(
        seps.withColumn(
            "k", F.struct(F.col("row_y").alias("y"), F.col("row_x").alias("x"), F.col("row_frag").cast("bigint").alias("f"))
        )
    )
    rest = marked.where("not spanning")
    # The first separator below a fragment, by an as-of lookup on y.
    rest_below = next_mark(
        rest, seps.select("page_id", F.col("sep_y").alias("y"), "k"), ["page_id"], "y", "k", ROW_TILE, "k_below"
    )
    size = 64.0
    rest_t = rest.withColumn("_t", F.floor(F.col("y") / size))
    seps_t = seps.withColumn("_t", F.explode(F.sequence(F.floor((F.col("row_y") - F.col("anchor_h")) / size), F.floor((F.col("row_y") + F.col("anchor_h")) / size))))
    base = (
        rest_t.join(seps_t.select("page_id", "_t", "row_y", "anchor_h", "k"), ["page_id", "_t"])
        .where(F.abs(F.col("y") - F.col("row_y")) < F.least("height", "anchor_h") * SAME_ROW)
        .groupBy("page_id", "frag_id")
        .agg(F.min("k").alias("k_peer"))
    )
    placed = rest_below.join(base, ["page_id", "frag_id"], "left")
    k_below, k_peer = F.coalesce("k_below", end), F.coalesce("k_peer", end)
    peer = F.col("k_peer").isNotNull() & (k_peer <= k_below)
    side = F.when(F.col("x") < F.col("cut"), "left").otherwise("right")
    body = placed.select(
        "page_id",
        "frag_id",
        F.when(peer, k_peer).otherwise(k_below).alias("k"),
        F.when(peer, 2).when(side == "right", 1).otherwise(0).alias("part"),
        side.alias("column"),
    )
    k = F.struct(F.col("row_y").alias("y"), F.col("row_x").alias("x"), F.col("row_frag").cast("bigint").alias("f"))
    return body.unionByName(sep_rows.select("page_id", "frag_id", k.alias("k"), F.lit(2).alias("part"), F.lit("full").alias("column")))


def sequence_lines(lines: DataFrame, order: list[Column]) -> DataFrame:
    """Number the lines of a page from zero."""
    return lines.withColumn("seq", F.row_number().over(Window.partitionBy("page_id").orderBy(*order)) - 1)


def page_text(lines: DataFrame) -> DataFrame:
    """Line count, column count and text hash per page; the text itself is one row."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return lines.groupBy("page_id").agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"),
        F.count("*").alias("lines"),
        F.when(F.bool_or(F.col("column").isin("left", "right")), 2).otherwise(1).alias("columns"),
        F.count_if(F.col("column") == "table").alias("table_lines"),
    )


def propose_regions(typed: DataFrame) -> DataFrame:
    """Consecutive table lines form one region, any other line its own.

    ``typed(page_id, seq, type, status, text, x, y, width, height)``.
    """
    w = Window.partitionBy("page_id").orderBy("seq")
    table = F.col("type") == "table"
    new = F.when(table & F.coalesce(F.lag("type").over(w) == "table", F.lit(False)), 0).otherwise(1)
    marked = typed.withColumn("_new", new).withColumn("_r", F.sum("_new").over(w) - 1)
    grouped = marked.groupBy("page_id", F.col("_r").alias("ord")).agg(
        F.first("type").alias("type"),
        F.min("status").alias("status"),
        F.count("*").alias("lines"),
        F.min("x").alias("x"),
        F.min("y").alias("y"),
        F.max(F.col("x") + F.col("width")).alias("_x1"),
        F.max(F.col("y") + F.col("height")).alias("_y1"),
    )
    return grouped.select(
        "page_id",
        F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit("-r"), F.col("ord").cast("string")).alias("region_id"),
        "ord",
        "type",
        "status",
        "lines",
        "x",
        "y",
        (F.col("_x1") - F.col("x")).alias("width"),
        (F.col("_y1") - F.col("y")).alias("height"),
    )


def reading_edges(regions: DataFrame) -> DataFrame:
    """Proposed ``reading-next`` edges between consecutive regions.

    Positions are numbered already, so the next region is an equality join and
    no page is sorted in one task.
    """
    after = regions.select("page_id", (F.col("ord") - 1).alias("ord"), F.col("region_id").alias("to_id"))
    return regions.join(after, ["page_id", "ord"]).select(
        "page_id",
        F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit("-e"), F.col("ord").cast("string")).alias("edge_id"),
        F.col("region_id").alias("from_id"),
        "to_id",
        F.lit("proposed").alias("status"),
    )


def page_issues(pages: DataFrame, regions: DataFrame, owned: DataFrame, fragments: DataFrame) -> DataFrame:
    """Issues of a proposed page as ``(page_id, code, n)``.

    ``pages(page_id, has_images, ocr_text)``.
    """
    by_type = {"table": "table-grid-unverified", "equation": "equation-unverified", "caption": "caption-link-unresolved"}
    code = F.lit(None).cast("string")
    for kind, name in by_type.items():
        code = F.when(F.col("type") == kind, name).otherwise(code)
    typed = regions.select("page_id", code.alias("code")).where("code is not null")
    loose = fragments.join(owned.select("page_id", "frag_id").distinct(), ["page_id", "frag_id"], "left_anti").select(
        "page_id", F.lit("unplaced-fragment").alias("code")
    )
    counts = fragments.groupBy("page_id").agg(F.count("*").alias("n"))
    p = pages.join(counts, "page_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    has_ocr = ~tx.is_blank(F.coalesce("ocr_text", F.lit("")))
    flags = F.array_compact(
        F.array(
            F.when(F.col("has_images"), F.lit("raster-content-unassessed")),
            F.when(has_ocr & (F.col("n") > 0), F.lit("visual-ocr-unverified")),
            F.when(has_ocr & (F.col("n") == 0), F.lit("ocr-order-unverified")),
            F.when(~has_ocr & (F.col("n") == 0), F.lit("empty-page-unassessed")),
        )
    )
    page_level = p.select("page_id", F.explode(flags).alias("code"))
    return typed.unionByName(loose).unionByName(page_level).groupBy("page_id", "code").agg(F.count("*").alias("n"))


def stroke_components(strokes: DataFrame) -> DataFrame:
    """Component label of each stroke; strokes whose boxes touch belong together."""
    boxes = strokes.select("page_id", "stroke_id", "x", "y", "width", "height")
    links = ge.touching(boxes, boxes).select("page_id", F.col("l_stroke_id").alias("src"), F.col("r_stroke_id").alias("dst"))
    return graph.components(boxes, links, "page_id", "stroke_id")


def stroke_coverage(strokes: DataFrame, slots: DataFrame) -> DataFrame:
    """1 when the union of strokes covers a slot, 0 when none meets it, -1 when partial.

    ``strokes(band_id, low, high)``, ``slots(band_id, slot_id, low, high)``. Equal
    strokes collapse first; then strokes of a band that meet become one run, and only these and the slots' ends are sorted.
    """
    single = strokes.groupBy("band_id", "low").agg(F.max("high").alias("high"))
    # A slot is covered when one run holds it, so slots and strokes are not paired.
    order = Window.partitionBy("band_id").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    opens = F.when(F.col("low") <= F.max("high").over(order), 0).otherwise(1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    runs = single.withColumn("_open", opens).withColumn("_run", F.sum("_open").over(upto)).groupBy("band_id", "_run").agg(
        F.min("low").alias("s_low"), F.max("high").alias("s_high")
    )
    # The last run that begins before a slot's end holds the slot, if any does.
    marks = runs.select("band_id", F.col("s_low").alias("_at"), F.struct("s_low", "s_high").alias("_last"))
    ends = slots.select("band_id", "slot_id", "low", "high", F.col("high").alias("_at"))
    both = ends.withColumn("_mark", F.lit(0)).unionByName(marks.withColumn("_mark", F.lit(1)), allowMissingColumns=True)
    so_far = Window.partitionBy("band_id").orderBy("_at", "_mark").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumns({"_run": F.last("_last", True).over(so_far), "_reach": F.max("_last.s_high").over(so_far)}).where("_mark = 0")
    met = F.coalesce(F.col("_reach") > F.col("low"), F.lit(False))
    held = (F.col("_run.s_low") <= F.col("low")) & (F.col("_run.s_high") >= F.col("high"))
    return seen.select("band_id", "slot_id", F.when(~met, 0).when(held, 1).otherwise(-1).alias("coverage"))
