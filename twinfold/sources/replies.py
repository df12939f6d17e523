"""Stored model replies and nested case documents as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.functions import text as tx
from twinfold.operators.predicates import TARGET_LANGUAGES

# ---- fixed values ----------------------------------------------------------
REPLY_CATEGORIES = ("number", "unit", "direction", "negation", "terminology", "omission", "other")
SEVERITIES = ("info", "review", "high")
FINDING_LIMIT, RATIONALE_LIMIT, CONTENT_LIMIT, MODEL_LIMIT = 8, 600, 12_000, 200
FINDING_KEYS = ("category", "severity", "sourceSpan", "draftSpan", "rationale")

REPLY = (
    "model string, choices array<struct<finish_reason: string, message: struct<content: string>>>, "
    "usage struct<prompt_tokens: string, completion_tokens: string>"
)
CONTENT = "findings array<map<string,string>>"


def parse_model_findings(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(findings, verdicts)`` of ``responses(pair_id, body)``.

    A reply is taken whole or rejected whole; verdicts carry the first reason.
    """
    parsed = responses.withColumn("r", F.from_json("body", REPLY)).withColumns(
        {"choice": F.try_element_at("r.choices", F.lit(1)), "usage": F.col("r.usage")}
    )
    content = F.col("choice.message.content")
    opened = parsed.withColumn("c", F.from_json(content, CONTENT)).withColumn("items", F.col("c.findings"))

    def bad_item(item: Column) -> Column:
        odd_key = F.exists(F.map_keys(item), lambda k: ~k.isin(*FINDING_KEYS))
        good = (
            item["category"].isin(*REPLY_CATEGORIES)
            & item["severity"].isin(*SEVERITIES)
            & ~tx.is_blank(item["rationale"])
            & (F.length(item["rationale"]) <= RATIONALE_LIMIT)
        )
        return odd_key | ~F.coalesce(good, F.lit(False))

    def token(name: str) -> Column:
        return F.coalesce(F.col(f"usage.{name}").rlike(r"^\d{1,9}\z"), F.lit(False))

    repeated = F.exists(
        F.array(*[F.lit(k) for k in ("findings", "model", "usage", "choices")]),
        lambda k: F.regexp_count("body", F.concat(F.lit('"'), k, F.lit('"\\s*:'))) > 1,
    )
    reason = (
        F.when(F.col("r").isNull() | F.col("choice").isNull(), "schema")
        .when(repeated, "repeated-key")
        .when(~F.col("choice.finish_reason").eqNullSafe("stop"), "unfinished")
        .when(tx.is_blank(content) | (F.length(content) > CONTENT_LIMIT) | content.rlike("(?i)</?think"), "content")
        .when(F.col("items").isNull(), "findings")
        .when(F.size("items") > FINDING_LIMIT, "too-many")
        .when(F.exists("items", bad_item), "finding")
        .when(tx.is_blank(F.col("r.model")) | (F.length("r.model") > MODEL_LIMIT), "model")
        .when(~token("prompt_tokens") | ~token("completion_tokens"), "usage")
    )
    judged = opened.withColumn("reason", reason)
    fields = {
        "category": "category",
        "severity": "severity",
        "rationale": "rationale",
        "sourceSpan": "source_span",
        "draftSpan": "draft_span",
    }
    findings = (
        judged.where("reason is null")
        .select("pair_id", F.explode("items").alias("f"))
        .select("pair_id", *[F.col("f")[k].alias(v) for k, v in fields.items()])
    )
    verdicts = judged.select(
        "pair_id",
        "reason",
        F.col("r.model").alias("model"),
        F.when(F.col("reason").isNull(), F.col("usage.prompt_tokens").try_cast("int")).alias("prompt_tokens"),
        F.when(F.col("reason").isNull(), F.col("usage.completion_tokens").try_cast("int")).alias("completion_tokens"),
    )
    return findings, verdicts


_FINDING = "struct<category:string,draftSpan:string,provenance:string>"
_ARM = f"struct<draftSha256:string,findings:array<{_FINDING}>>"
CASES_SCHEMA = "cases array<struct<id:string,author:string,license:string,targetLanguage:string,source:string,sourceSha256:string>>"
GOLD_SCHEMA = (
    "gold array<struct<runId:string,caseId:string,seed:struct<category:string,draftSpan:string>,"
    "adjudicatedCleanCategories:array<string>>>"
)
RUNS_SCHEMA = (
    "runs array<struct<runId:string,caseId:string,targetLanguage:string,draft:string,draftSha256:string,"
    f"baseline:{_ARM},enhanced:{_ARM},latencyMs:double,promptTokens:int,completionTokens:int>>"
)


def _records(spark: SparkSession, path: str, schema: str, field: str) -> DataFrame:
    read = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return read.select(F.explode(field).alias("x")).select("x.*")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    c = _records(spark, path, CASES_SCHEMA, "cases")
    return c.select(
        F.col("id").alias("case_id"),
        "author",
        "license",
        F.col("targetLanguage").alias("lang"),
        "source",
        F.col("sourceSha256").alias("source_sha256"),
    )


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    g = _records(spark, path, GOLD_SCHEMA, "gold")
    return g.select(
        F.col("runId").alias("run_id"),
        F.col("caseId").alias("case_id"),
        F.col("seed.category").alias("seed_category"),
        F.col("seed.draftSpan").alias("seed_span"),
        F.col("adjudicatedCleanCategories").alias("clean_categories"),
    )


def read_runs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(runs, findings)`` in the long form the scorers take."""
    r = _records(spark, path, RUNS_SCHEMA, "runs")
    runs = r.select(
        F.col("runId").alias("run_id"),
        F.col("caseId").alias("case_id"),
        F.col("targetLanguage").alias("lang"),
        "draft",
        F.col("draftSha256").alias("draft_sha256"),
        F.col("baseline.draftSha256").alias("baseline_sha256"),
        F.col("enhanced.draftSha256").alias("enhanced_sha256"),
        F.col("latencyMs").alias("latency_ms"),
        F.col("promptTokens").alias("prompt_tokens"),
        F.col("completionTokens").alias("completion_tokens"),
    )
    arms = F.array(
        *[F.struct(F.lit(a).alias("arm"), F.col(f"{a}.findings").alias("items")) for a in ("baseline", "enhanced")]
    )
    findings = (
        r.select(F.col("runId").alias("run_id"), F.explode(arms).alias("a"))
        .select("run_id", F.col("a.arm").alias("arm"), F.explode("a.items").alias("f"))
        .select("run_id", "arm", "f.category", F.col("f.draftSpan").alias("draft_span"), "f.provenance")
    )
    return runs, findings


_SECTION = "struct<id:string,label:string,text:string>"
_QC = "struct<id:string,title:string,status:string,basis:string,sourceSection:string,targetSection:string>"
MANIFEST_SCHEMA = (
    "id string, title string, mode string, generatedUtc string, generator string, scope string, "
    f"source struct<citation:string,url:string,license:string,modifications:string,preview:string,sections:array<{_SECTION}>>, "
    f"translations array<struct<language:string,status:string,preview:string,download:string,sections:array<{_SECTION}>,findings:array<{_QC}>>>"
)


def explode_manifest(cases: DataFrame) -> dict[str, DataFrame]:
    """Sections, translations and findings of nested case records."""
    source = cases.select(
        F.col("id").alias("case_id"), F.explode_outer("source.sections").alias("s")
    ).select("case_id", F.lit(None).cast("string").alias("language"), "s.*")
    each = cases.select(F.col("id").alias("case_id"), F.explode_outer("translations").alias("t"))
    target = each.select("case_id", "t.language", F.explode_outer("t.sections").alias("s")).select(
        "case_id", "language", "s.*"
    )
    findings = each.select("case_id", "t.language", F.explode_outer("t.findings").alias("f")).select(
        "case_id", "language", "f.*"
    )
    return {
        "source_sections": source.where("id is not null"),
        "target_sections": target.where("id is not null"),
        "translations": each.select("case_id", "t.language", "t.status", "t.preview", "t.download"),
        "findings": findings.where("id is not null"),
    }


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)


def manifest_rules(cases: DataFrame, languages: tuple[str, ...] = TARGET_LANGUAGES) -> DataFrame:
    """Broken manifest rules as ``(rule, case_id, n)``."""
    blank = lambda name: tx.is_blank(F.col(name))
    asset = r"^/assets/[A-Za-z0-9._-]+\z"
    row_rules = {
        "title-or-mode": blank("title") | (F.col("mode") != "recorded"),
        "provenance": blank("generator") | blank("scope") | blank("source.citation") | blank("source.modifications"),
        "url": ~F.coalesce(F.col("source.url").rlike(r"^https://[^\s/]+"), F.lit(False)),
        "license": ~F.col("source.license").eqNullSafe("CC BY 4.0"),
        "asset": ~F.coalesce(F.col("source.preview").rlike(asset), F.lit(False)) | F.col("source.preview").contains(".."),
        "content": (F.coalesce(F.size("source.sections"), F.lit(0)) < 1) | (F.coalesce(F.size("translations"), F.lit(0)) < 1),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(b, F.lit(True)), F.lit(r)) for r, b in row_rules.items()]))
    rows = cases.select(F.col("id").alias("case_id"), F.explode(broken).alias("rule"))
    parts = explode_manifest(cases)
    sections = parts["source_sections"].unionByName(parts["target_sections"])
    same = ["case_id", "language", "id"]
    repeated = sections.groupBy(*same).count().where("count > 1").select("case_id", F.lit("section-repeated").alias("rule"))
    empty = sections.where(blank("text")).select("case_id", F.lit("section-empty").alias("rule"))
    lang = (
        parts["translations"]
        .groupBy("case_id", "language")
        .count()
        .where(~F.col("language").isin(*languages) | (F.col("count") > 1))
        .select("case_id", F.lit("language").alias("rule"))
    )
    draft = parts["translations"].where("status <> 'AI_DRAFT_UNREVIEWED'").select("case_id", F.lit("translation-status").alias("rule"))
    status = parts["findings"].where(~F.col("status").isin("passed", "needs-review", "blocked")).select(
        "case_id", F.lit("finding-status").alias("rule")
    )
    have_src = parts["source_sections"].select("case_id", F.col("id").alias("sourceSection")).distinct()
    have_dst = parts["target_sections"].select("case_id", "language", F.col("id").alias("targetSection")).distinct()
    lost_src = parts["findings"].join(have_src, ["case_id", "sourceSection"], "left_anti")
    lost_dst = parts["findings"].join(have_dst, ["case_id", "language", "targetSection"], "left_anti")
    lost = lost_src.select("case_id", "language", "id").unionByName(lost_dst.select("case_id", "language", "id"))
    missing = lost.distinct().select("case_id", F.lit("finding-section").alias("rule"))
    out = rows
    for part in (repeated, empty, lang, draft, status, missing):
        out = out.unionByName(part)
    return out.groupBy("rule", "case_id").agg(F.count("*").alias("n"))


def pair_sections(cases: DataFrame) -> DataFrame:
    """Source and target section texts matched by the findings that name both."""
    p = explode_manifest(cases)
    src = p["source_sections"].select("case_id", F.col("id").alias("sourceSection"), F.col("text").alias("source"))
    dst = p["target_sections"].select(
        "case_id", "language", F.col("id").alias("targetSection"), F.col("text").alias("target")
    )
    return (
        p["findings"]
        .join(src, ["case_id", "sourceSection"])
        .join(dst, ["case_id", "language", "targetSection"])
        .select("case_id", "language", F.col("id").alias("finding_id"), "source", "target")
    )
