"""Comparisons of two sides as full outer joins on declared identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.functions import text as tx

# ---- fixed values ----------------------------------------------------------
NUMERIC = r"(?U)[+\-−]?(?:\p{N}+(?:[.,]\p{N}+)?|\.\p{N}+)(?:[eE][+\-]?\p{N}+)?"
NOTATION = "[+\\-−⁺⁻₊₋≤≥<>≈=±×÷/^]"
UNITS = r"(?<!\p{L})(?:mcg|mg|kg|mL|μL|µL|μg|µg|mm|cm|g|L|m|%)(?!\p{L})"
SUPPORTED_UNITS = ("mcg", "mg", "kg", "mL", "μL", "µL", "μg", "µg", "g", "L", "mm", "cm", "m", "%", "h", "min", "s")
LABEL_LITERAL = (
    r"(?<![\p{L}\p{N}_])[A-Za-z][A-Za-z0-9]*[_^](?:\{[+\-−]?[A-Za-z0-9]+\}|[+\-−]?[A-Za-z0-9]+)"
    r"|(?<![\p{L}\p{N}_])[A-Za-z][A-Za-z0-9]*(?=[¹²³⁰-₟])"
    r"|(?<![\p{L}\p{M}])(?:mcg|mg|kg|mL|μL|µL|μg|µg|mm|cm|min|g|L|m|h|s)(?![\p{L}\p{M}])"
    r"|(?:[0-9]+(?:[.,][0-9]+)*|[.,][0-9]+)(?:[eE][+\-−]?[0-9]+)?"
    r"|[\p{N}\p{Sm}\p{IsGreek}⁰-₟_/^%]|(?<![A-Za-z])-|-(?![A-Za-z])"
)
PREVIEW, TOLERANCE, SHEET_LIMIT = 160, 0.5, 200


def multiset_diff(source: DataFrame, draft: DataFrame) -> DataFrame:
    """Keys of a pair with unequal counts; inputs are ``(pair_id, key, n)``."""
    both = source.select("pair_id", "key", F.col("n").alias("ns")).join(
        draft.select("pair_id", "key", F.col("n").alias("nd")), ["pair_id", "key"], "full_outer"
    )
    zero = F.lit(0).cast("bigint")
    return both.select(
        "pair_id", "key", F.coalesce("ns", zero).alias("source_n"), F.coalesce("nd", zero).alias("draft_n")
    ).where("source_n <> draft_n")


def compare_tables(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Issues per table anchor. Header references are compared as anchors.

    Inputs are valid cells; several cells at one anchor are a validation issue
    and must be filtered before.
    """

    def described(cells: DataFrame, p: str) -> DataFrame:
        anchor = F.concat_ws(":", "row", "col")
        own = cells.select("table_id", "cell_id", anchor.alias("anchor"))
        refs = (
            cells.select("table_id", F.concat_ws(":", "row", "col").alias("anchor"), F.explode("header_ids").alias("cell_id"))
            .join(own.withColumnRenamed("anchor", "target"), ["table_id", "cell_id"])
            .groupBy("table_id", "anchor")
            .agg(F.array_sort(F.collect_set("target")).alias(f"{p}heads"))
        )
        base = cells.select(
            "table_id",
            anchor.alias("anchor"),
            *[F.col(c).alias(p + c) for c in ("row_span", "col_span", "text", "role", "blank_reason")],
            F.array_sort("frag_ids").alias(f"{p}frags"),
            F.lit(True).alias(f"{p}here"),
        )
        return base.join(refs, ["table_id", "anchor"], "left")

    both = described(expected, "e_").join(described(actual, "a_"), ["table_id", "anchor"], "full_outer")
    here = F.col("e_here") & F.col("a_here")

    def unlike(name: str) -> Column:
        return here & ~F.col(f"e_{name}").eqNullSafe(F.col(f"a_{name}"))

    codes = {
        "missing-anchor": F.col("a_here").isNull(),
        "extra-anchor": F.col("e_here").isNull(),
        "span-mismatch": unlike("row_span") | unlike("col_span"),
        "text-mismatch": unlike("text"),
        "role-mismatch": unlike("role"),
        "blank-reason-mismatch": unlike("blank_reason"),
        "source-mismatch": unlike("frags"),
        "header-mismatch": unlike("heads"),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(b, F.lit(False)), F.lit(c)) for c, b in codes.items()]))
    return both.select("table_id", "anchor", F.explode_outer(found).alias("code")).where("code is not null")


def compare_structure(source: DataFrame, target: DataFrame) -> DataFrame:
    """Status per pair over ``(pair_id, region_id, ord, type, text)`` of both sides.

    Literals are compared in order. Regions that do not correspond or an
    unsupported unit make the whole pair ``unknown``.
    """

    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select("pair_id", "region_id", *[F.col(c).alias(p + c) for c in ("ord", "type", "text")])

    both = side(source, "s_").join(side(target, "t_"), ["pair_id", "region_id"], "full_outer")
    s, t = F.col("s_text"), F.col("t_text")

    def literal(pattern: str) -> Column:
        return tx.matches(s, pattern) != tx.matches(t, pattern)

    def odd_unit(text: Column) -> Column:
        bare = F.regexp_replace(text, NUMERIC, "#")
        words = F.regexp_extract_all(bare, F.lit(r"(?U)#\s*([\p{L}μµ][\p{L}μµ/²³⁻¹]*)"), F.lit(1))
        return F.exists(words, lambda w: ~w.isin(*SUPPORTED_UNITS))

    value = F.col("s_type") == "value"
    absent = F.col("s_ord").isNull() | F.col("t_ord").isNull() | (F.col("s_type") != F.col("t_type"))
    codes = {
        "region-order-changed": F.col("s_ord") != F.col("t_ord"),
        "missing-cell-content": value & t.isNotNull() & tx.is_blank(t),
        "cell-numeric-changed": value & literal(NUMERIC),
        "cell-notation-changed": value & literal(NOTATION),
        "cell-unit-changed": value & literal(UNITS),
        "equation-literal-changed": (F.col("s_type") == "equation") & (s != t),
    }
    judged = both.select(
        "pair_id",
        F.coalesce(absent, F.lit(True)).alias("absent"),
        F.coalesce(value & (odd_unit(s) | odd_unit(t)), F.lit(False)).alias("odd"),
        *[F.coalesce(b, F.lit(False)).alias(c) for c, b in codes.items()],
    )
    names = [f"`{c}`" for c in codes]
    per = judged.groupBy("pair_id").agg(
        F.bool_or("absent").alias("absent"),
        F.bool_or("odd").alias("odd"),
        *[F.count_if(F.col(n)).alias(c) for n, c in zip(names, codes)],
    )
    total = sum((F.col(n) for n in names), F.lit(0))
    status = (
        F.when(F.col("absent"), "unknown").when(F.col("odd"), "unknown").when(total > 0, "changed").otherwise("matched")
    )
    reason = F.when(F.col("absent"), "region-correspondence-missing").when(F.col("odd"), "unsupported-cell-unit")
    return per.select("pair_id", status.alias("status"), reason.alias("reason"), total.cast("bigint").alias("issues"))


def restore_paragraphs(source: DataFrame, draft: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(paragraphs, documents)``: draft text where present, source text elsewhere.

    Inputs are ``(doc_id, part, para_id, ord, text)``. A draft id unknown to the
    source rejects its part; no kept correspondence rejects the document.
    """
    key = ["doc_id", "part", "para_id"]
    joined = source.join(draft.select(*key, F.col("text").alias("_draft")), key, "left")
    merged = joined.select(
        *key,
        "ord",
        F.coalesce("_draft", "text").alias("text"),
        F.col("_draft").isNull().alias("restored"),
        F.when(F.col("_draft").isNull(), F.substring("text", 1, PREVIEW)).alias("preview"),
    )
    foreign = (
        draft.join(source.select(*key), key, "left_anti")
        .groupBy("doc_id")
        .agg(F.count_distinct("part").alias("rejected_parts"))
    )
    per = merged.groupBy("doc_id").agg(
        F.count_if(~F.col("restored")).alias("kept"), F.count_if("restored").alias("restored")
    )
    docs = per.join(foreign, "doc_id", "left").withColumn("rejected_parts", F.coalesce("rejected_parts", F.lit(0).cast("bigint")))
    status = F.when(F.col("rejected_parts") > 0, "part-rejected").when(
        (F.col("restored") > 0) & (F.col("kept") == 0), "no-correspondence"
    ).otherwise("ok")
    return merged, docs.withColumn("status", status)


def package_correspondence(source: DataFrame, draft: DataFrame) -> DataFrame:
    """Issues between two packages ``(doc_id, part, sha256)`` by part class."""
    both = source.select("doc_id", "part", F.col("sha256").alias("s")).join(
        draft.select("doc_id", "part", F.col("sha256").alias("d")), ["doc_id", "part"], "full_outer"
    )
    kind = (
        F.when(F.lower("part").endswith(".rels") | (F.col("part") == "[Content_Types].xml"), "authority")
        .when(F.startswith("part", F.lit("word/media/")), "media")
        .when(F.startswith("part", F.lit("word/")) & F.endswith("part", F.lit(".xml")), "text")
        .otherwise("other")
    )
    code = (
        F.when(F.col("s").isNull() | F.col("d").isNull(), "member-set")
        .when((kind == "authority") & (F.col("s") != F.col("d")), "authority-changed")
        .when((kind == "other") & (F.col("s") != F.col("d")), "content-changed")
    )
    return both.select("doc_id", "part", kind.alias("kind"), code.alias("code"))


def compare_geometry(source: DataFrame, target: DataFrame) -> DataFrame:
    """Changes between rendered members ``(doc_id, story_type, chain, kind, idx, page, x, y, w, h)``."""
    key = ["doc_id", "story_type", "chain", "kind", "idx"]
    values = ("page", "x", "y", "w", "h")
    both = source.select(*key, *[F.col(c).alias("s_" + c) for c in values]).join(
        target.select(*key, *[F.col(c).alias("t_" + c) for c in values]), key, "full_outer"
    )
    present = F.col("s_page").isNotNull() & F.col("t_page").isNotNull()
    codes = [F.when(~present, F.lit("member-coverage")), F.when(present & (F.col("s_page") != F.col("t_page")), F.lit("page"))]
    codes += [F.when(present & (F.abs(F.col(f"s_{c}") - F.col(f"t_{c}")) > TOLERANCE), F.lit(c)) for c in values[1:]]
    return both.select(*key, F.explode_outer(F.array_compact(F.array(*codes))).alias("change")).where("change is not null")


def geometry_rules(members: DataFrame, stories: DataFrame) -> DataFrame:
    """Verdict per document: contiguous chains and member indices, finite points."""
    chains = stories.groupBy("doc_id", "story_type").agg(
        F.count("*").alias("n"), F.count_distinct("chain").alias("d"), F.min("chain").alias("lo"), F.max("chain").alias("hi")
    )
    chain_ok = chains.groupBy("doc_id").agg(
        F.bool_and(
            (F.col("n") == F.col("d")) & (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & F.col("story_type").between(1, 17)
        ).alias("chains_ok")
    )
    finite = F.lit(True)
    for c in ("x", "y", "w", "h"):
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) >= 0) & (F.col(c) < float("inf"))
    per = members.groupBy("doc_id", "story_type", "chain", "kind").agg(
        F.count("*").alias("n"),
        F.count_distinct("idx").alias("d"),
        F.min("idx").alias("lo"),
        F.max("idx").alias("hi"),
        F.bool_and(F.coalesce(finite & (F.col("page") > 0), F.lit(False))).alias("points_ok"),
    )
    member_ok = per.groupBy("doc_id").agg(
        F.bool_and((F.col("n") == F.col("d")) & (F.col("lo") == 1) & (F.col("hi") == F.col("n"))).alias("members_ok"),
        F.bool_and("points_ok").alias("points_ok"),
    )
    return chain_ok.join(member_ok, "doc_id", "left").select(
        "doc_id",
        "chains_ok",
        F.coalesce("members_ok", F.lit(True)).alias("members_ok"),
        F.coalesce("points_ok", F.lit(True)).alias("points_ok"),
    )


def audit_coverage(inventory: DataFrame, evidence: DataFrame, findings: DataFrame) -> DataFrame:
    """Verdict per medium: evidence bound to the inventory or exactly one failure finding.

    ``inventory(doc_id, part, sha256, bytes)``, ``evidence(doc_id, part, sha256,
    bytes, width, height, lines)``, ``findings(doc_id, part, kind, x, y, w, h)``.
    """
    key = ["doc_id", "part"]
    seen = evidence.groupBy(*key).agg(
        F.count("*").alias("evidence"),
        *[F.max(c).alias("e_" + c) for c in ("sha256", "bytes", "width", "height", "lines")],
    )
    counts = findings.groupBy(*key).agg(
        F.count_if(F.col("kind") == "failure").alias("failures"),
        F.count_if(F.col("kind") == "ocr").alias("ocr"),
        F.max(F.when(F.col("kind") == "ocr", F.col("x") + F.col("w"))).alias("right"),
        F.max(F.when(F.col("kind") == "ocr", F.col("y") + F.col("h"))).alias("bottom"),
    )
    joined = inventory.join(seen, key, "left").join(counts, key, "left").fillna(0, ["evidence", "failures", "ocr"])
    verdict = (
        F.when(F.col("evidence") > 1, "evidence-repeated")
        .when((F.col("evidence") == 1) & (F.col("failures") > 0), "conflicting")
        .when((F.col("evidence") == 0) & (F.col("failures") == 0), "uncovered")
        .when((F.col("evidence") == 0) & (F.col("failures") > 1), "failure-repeated")
        .when((F.col("evidence") == 0) & (F.col("ocr") > 0), "unbound-finding")
        .when(
            (F.col("evidence") == 1) & ((F.col("e_sha256") != F.col("sha256")) | (F.col("e_bytes") != F.col("bytes"))),
            "evidence-unbound",
        )
        .when(F.col("ocr") > F.coalesce("e_lines", F.lit(0)), "too-many-findings")
        .when((F.col("right") > F.col("e_width")) | (F.col("bottom") > F.col("e_height")), "outside-image")
        .otherwise("ok")
    )
    return joined.select(*key, verdict.alias("verdict"))


def report_binding(reports: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each job with the first reason its report cannot be admitted."""
    r = reports.select("job_id", *[F.col(c).alias("r_" + c) for c in ("source_sha256", "target_sha256", "lang", "status", "exit_code", "blocked", "issues")])
    j = jobs.join(r, "job_id", "left")
    clean = (F.col("r_status") == "PASS") & (F.col("r_exit_code") == 0) & ~F.col("r_blocked") & (F.col("r_issues") == 0)
    held = F.col("r_status").isin("BLOCKED", "VISUAL_TEXT_REVIEW_REQUIRED") & (F.col("r_exit_code") != 0) & F.col("r_blocked") & (F.col("r_issues") > 0)
    timeout = (F.col("r_status") == "TIMEOUT") & F.col("r_blocked") & (F.col("r_exit_code") != 0)
    verdict = (
        F.when(F.col("r_status").isNull(), "missing")
        .when((F.col("r_source_sha256") != F.col("source_sha256")) | (F.col("r_target_sha256") != F.col("target_sha256")), "unbound")
        .when(F.col("r_lang") != F.col("lang"), "language")
        .when(timeout, "held")
        .when(clean | held, "admitted")
        .otherwise("inconsistent")
    )
    return j.select("job_id", verdict.alias("verdict"))


def apply_sheet(labels: DataFrame, sheet: DataFrame) -> DataFrame:
    """Verdict per sheet; targets are taken for all labels or for none.

    Both sides are ``(sheet_id, ord, label_id, source_text, x, y, width, height, lang, image_sha256)``;
    the sheet adds ``target_text``.
    """
    same = ("label_id", "source_text", "x", "y", "width", "height", "lang", "image_sha256")
    both = labels.select("sheet_id", "ord", *[F.col(c).alias("l_" + c) for c in same]).join(
        sheet.select("sheet_id", "ord", *[F.col(c).alias("s_" + c) for c in same], "target_text"), ["sheet_id", "ord"], "full_outer"
    )
    bound = F.lit(True)
    for c in same:
        bound = bound & F.coalesce(F.col(f"l_{c}") == F.col(f"s_{c}"), F.lit(False))
    literals = lambda t: tx.matches(t, LABEL_LITERAL)
    filled = ~tx.is_blank(F.col("target_text"))
    per = both.groupBy("sheet_id").agg(
        F.count("*").alias("labels"),
        F.bool_and(bound).alias("bound"),
        F.bool_and(filled).alias("filled"),
        F.bool_and(F.coalesce(literals(F.col("l_source_text")) == literals(F.col("target_text")), F.lit(False))).alias("literals"),
    )
    verdict = (
        F.when(F.col("labels") > SHEET_LIMIT, "too-many")
        .when(~F.col("bound"), "mismatch")
        .when(~F.col("filled"), "blank")
        .when(~F.col("literals"), "literals")
        .otherwise("applied")
    )
    return per.select("sheet_id", "labels", verdict.alias("verdict"))


def retain_cell_sources(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Fragment ids stay only where id, text, position and spans are all equal."""
    key = ["table_id", "cell_id", "text", "row", "col", "row_span", "col_span"]
    kept = previous.groupBy(*key).agg(F.first("frag_ids").alias("_frags"))
    return current.drop("frag_ids").join(kept, key, "left").withColumnRenamed("_frags", "frag_ids")


def manifest_truth_check(manifest: DataFrame, truth: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Issues between a case manifest and the frozen truth of the same cases."""
    fields = ("page", "source_sha256", "image_sha256", "fragments")
    t = truth.groupBy("case_id").agg(
        *[F.first(f).alias("t_" + f) for f in fields], F.collect_set("kind").alias("kinds")
    )
    both = manifest.join(t, "case_id", "full_outer")
    absent = F.array_except(F.array(*[F.lit(k) for k in required]), F.col("kinds"))
    codes = [
        F.when(F.col("page").isNull() | F.col("t_page").isNull(), F.lit("case-set")),
        *[F.when(F.col(f) != F.col("t_" + f), F.lit(f)) for f in fields],
        F.when(F.size(absent) > 0, F.lit("required-kind")),
    ]
    return both.select("case_id", F.explode_outer(F.array_compact(F.array(*codes))).alias("code")).where("code is not null")


def registered_restore(requests: DataFrame, registry: DataFrame, unverified: DataFrame) -> DataFrame:
    """``RESTORED`` or ``ABSTAIN`` with a reason per request.

    ``unverified(key)`` lists registered graphs that still have open issues.
    """
    reg = registry.select("key", F.col("version").alias("r_version"), F.col("sha256").alias("r_sha"), F.lit(True).alias("known"))
    bad = unverified.select("key").distinct().withColumn("bad", F.lit(True))
    j = requests.join(reg, "key", "left").join(bad, "key", "left")
    reason = (
        F.when(F.col("known").isNull(), "SOURCE_NOT_REGISTERED")
        .when(F.col("r_version") != F.col("version"), "SOURCE_VERSION_MISMATCH")
        .when(~F.col("r_sha").rlike(r"^[a-f0-9]{64}\z") | (F.col("r_sha") != F.col("sha256")), "SOURCE_HASH_MISMATCH")
        .when(F.col("bad"), "REGISTERED_STRUCTURE_UNVERIFIED")
    )
    return j.select("request_id", F.when(reason.isNull(), "RESTORED").otherwise("ABSTAIN").alias("status"), reason.alias("reason"))
