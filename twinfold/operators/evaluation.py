"""Controlled variants and scoring of findings against gold labels.

Relations: ``runs(run_id, case_id, lang, draft, draft_sha256, baseline_sha256,
enhanced_sha256, latency_ms, prompt_tokens, completion_tokens)``,
``findings(run_id, arm, category, draft_span, provenance)``,
``gold(run_id, case_id, seed_category, seed_span, clean_categories)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.functions import text as tx

# ---- fixed values ----------------------------------------------------------
CATEGORIES = ("number", "unit", "direction", "negation", "terminology", "omission", "other")
PROVENANCES = ("model", "rule")
ARMS = ("baseline", "enhanced")
OVERLAP_LIMIT = 120
MEASURED, NOT_MEASURED = "measured on adjudicated findings only", "not measured"


def seed_variants(drafts: DataFrame, mutations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(variants, gold, rejected)`` from drafts and one mutation per case.

    The gold table is separate: variants never carry the seed. A mutation whose
    ``before`` text does not occur exactly once is rejected, not guessed.
    """
    joined = drafts.join(mutations, "case_id").withColumn(
        "_n", tx.occurrences(F.col("draft"), F.col("before"))
    )
    usable = joined.where("_n = 1")
    kinds = F.explode(
        F.array(
            F.struct(F.lit("control").alias("kind"), F.col("draft").alias("text")),
            F.struct(
                F.lit("seeded").alias("kind"),
                F.replace(F.col("draft"), F.col("before"), F.col("after")).alias("text"),
            ),
        )
    )
    both = usable.withColumn("_k", kinds)
    run_id = F.concat_ws("-", "case_id", "_k.kind").alias("run_id")
    variants = both.select(
        run_id,
        "case_id",
        F.col("_k.text").alias("draft"),
        tx.sha256_hex(F.col("_k.text")).alias("draft_sha256"),
    )
    seeded = F.col("_k.kind") == "seeded"
    clean = (
        F.when(~seeded, F.array(F.lit("number")))
        .when(F.col("category") == "direction", F.array(F.lit("number")))
        .when(F.col("category") == "negation", F.array(F.lit("number")))
        .otherwise(F.array().cast("array<string>"))
    )
    gold = both.select(
        run_id,
        "case_id",
        F.when(seeded, F.col("category")).alias("seed_category"),
        F.when(seeded, F.coalesce("affected", "after")).alias("seed_span"),
        clean.alias("clean_categories"),
    )
    rejected = joined.where("_n <> 1").select("case_id", F.col("_n").alias("found"))
    return variants, gold, rejected


def attach_case_gold(runs: DataFrame, cases: DataFrame, gold: DataFrame) -> DataFrame:
    """Runs with their case and gold row; unmatched runs stay, marked by ``problem``."""
    case = cases.select("case_id", F.col("lang").alias("_case_lang"), F.lit(True).alias("_has_case"))
    label = gold.select(
        "run_id",
        F.col("case_id").alias("_gold_case"),
        "seed_category",
        "seed_span",
        "clean_categories",
        F.lit(True).alias("_has_gold"),
    )
    joined = runs.join(case, "case_id", "left").join(label, "run_id", "left")
    problem = (
        F.when(F.col("_has_case").isNull() | (F.col("_case_lang") != F.col("lang")), F.lit("case"))
        .when(F.col("_has_gold").isNull() | (F.col("_gold_case") != F.col("case_id")), F.lit("gold"))
        .alias("problem")
    )
    kept = [c for c in joined.columns if not c.startswith("_")]
    return joined.select(*kept, problem)


def _rule(df: DataFrame, rule: str, key: str, bad: Column) -> DataFrame:
    return df.where(F.coalesce(bad, F.lit(True))).select(F.lit(rule).alias("rule"), F.col(key).alias("id"))


def _repeated(df: DataFrame, rule: str, key: str) -> DataFrame:
    return df.groupBy(key).count().where("count > 1").select(F.lit(rule).alias("rule"), F.col(key).alias("id"))


def _hash_bad(declared: str, text: str) -> Column:
    return ~F.col(declared).rlike(r"^[a-f0-9]{64}\z") | (F.col(declared) != tx.sha256_hex(F.col(text)))


def validate_eval_inputs(
    cases: DataFrame, runs: DataFrame, gold: DataFrame, findings: DataFrame
) -> DataFrame:
    """All violations as ``(rule, id)``; a report is valid only if there are none."""
    needed = ("case_id", "source", "lang", "author", "license")
    incomplete = F.lit(False)
    for field in needed:
        incomplete = incomplete | F.coalesce(F.length(field), F.lit(0)).__eq__(0)
    seed = F.col("seed_category").isNotNull() | F.col("seed_span").isNotNull()
    good_seed = F.col("seed_category").isin(*CATEGORIES) & (F.length("seed_span") > 0)
    known = F.forall("clean_categories", lambda c: c.isin(*CATEGORIES))
    attached = attach_case_gold(runs, cases, gold)
    counts = (F.col("prompt_tokens") < 0) | (F.col("completion_tokens") < 0)
    latency = (F.col("latency_ms") < 0) | F.isnan(F.col("latency_ms").cast("double"))
    arms = (F.col("baseline_sha256") != F.col("draft_sha256")) | (
        F.col("enhanced_sha256") != F.col("draft_sha256")
    )
    parts = [
        _rule(cases, "case-fields", "case_id", incomplete),
        _repeated(cases, "case-duplicate", "case_id"),
        _rule(cases, "case-hash", "case_id", _hash_bad("source_sha256", "source")),
        _repeated(gold, "gold-duplicate", "run_id"),
        _rule(gold, "gold-seed", "run_id", seed & ~F.coalesce(good_seed, F.lit(False))),
        _rule(gold, "gold-clean", "run_id", ~known),
        _repeated(runs, "run-duplicate", "run_id"),
        _rule(attached, "run-case", "run_id", F.coalesce(F.col("problem") == "case", F.lit(False))),
        _rule(attached, "run-gold", "run_id", F.coalesce(F.col("problem") == "gold", F.lit(False))),
        _rule(runs, "draft-hash", "run_id", _hash_bad("draft_sha256", "draft")),
        _rule(runs, "arm-hash", "run_id", arms),
        _rule(
            attached,
            "seed-span",
            "run_id",
            F.coalesce(~F.contains("draft", F.col("seed_span")), F.lit(False)),
        ),
        _rule(runs, "latency", "run_id", latency),
        _rule(runs, "tokens", "run_id", counts),
        _rule(
            findings,
            "finding",
            "run_id",
            ~(F.col("category").isin(*CATEGORIES) & F.col("provenance").isin(*PROVENANCES)),
        ),
        _rule(
            gold.join(runs, "run_id", "left_anti"), "denominator", "run_id", F.lit(True)
        ),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def match_findings(findings: DataFrame, gold: DataFrame) -> DataFrame:
    """Each distinct finding with its verdict and how often it was reported.

    Equal findings are counted before the join, which also takes the weight off
    a run that holds very many of them.
    """
    counted = findings.groupBy("run_id", "arm", "category", "draft_span").agg(F.count("*").alias("n"))
    joined = counted.join(gold, "run_id")
    found, seed = F.col("draft_span"), F.col("seed_span")
    overlap = (F.length(found) > 0) & (
        F.startswith(seed, found) | ((F.length(found) <= OVERLAP_LIMIT) & F.contains(found, seed))
    )
    hit = F.coalesce((F.col("category") == F.col("seed_category")) & overlap, F.lit(False))
    clean = F.array_contains("clean_categories", F.col("category"))
    verdict = F.when(hit, "hit").when(clean, "false-positive").otherwise("unadjudicated")
    return joined.select("run_id", "arm", "category", "draft_span", "seed_category", verdict.alias("verdict"), "n")


def score_arms(matched: DataFrame, gold: DataFrame) -> DataFrame:
    """Counts per arm; every seeded run is a hit or a miss in every arm."""
    per_run = matched.groupBy("run_id", "arm").agg(
        F.max(F.when(F.col("verdict") == "hit", 1).otherwise(0)).alias("hit"),
        F.sum("n").alias("volume"),
        F.sum(F.when(F.col("verdict") == "false-positive", F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("verdict") == "unadjudicated", F.col("n")).otherwise(0)).alias("un"),
    )
    counts = per_run.groupBy("arm").agg(
        F.sum("hit").alias("true_positive"),
        F.sum("fp").alias("false_positive"),
        F.sum("volume").alias("warning_volume"),
        F.sum("un").alias("unadjudicated"),
    )
    seeded = gold.agg(F.count_if(F.col("seed_category").isNotNull()).alias("seeded"))
    arms = seeded.select("seeded", F.explode(F.array(*[F.lit(a) for a in ARMS])).alias("arm"))
    zero = F.lit(0).cast("bigint")
    done = arms.join(counts, "arm", "left")
    fields = ["true_positive", "false_positive", "warning_volume", "unadjudicated"]
    return done.select("arm", "seeded", *[F.coalesce(f, zero).alias(f) for f in fields]).withColumn(
        "false_negative", F.col("seeded") - F.col("true_positive")
    )


def precision_recall(scores: DataFrame) -> DataFrame:
    """Recall and precision; precision stays NULL with a status unless fully adjudicated."""
    tp, fp = F.col("true_positive"), F.col("false_positive")
    recall = F.when(F.col("seeded") > 0, tp / F.col("seeded"))
    measurable = (F.col("unadjudicated") == 0) & (tp + fp > 0)
    precision = F.when(measurable, tp / (tp + fp))
    status = F.when(measurable, MEASURED).otherwise(NOT_MEASURED)
    return scores.withColumns({"recall": recall, "precision": precision, "precision_status": status})


def per_category(matched: DataFrame, gold: DataFrame) -> DataFrame:
    """Seeded runs and runs detected by each arm, per seed category."""
    detected = (
        matched.where("verdict = 'hit'")
        .groupBy("run_id", "arm")
        .agg(F.first("seed_category").alias("category"))
        .groupBy("category")
        .pivot("arm", list(ARMS))
        .count()
    )
    seeded = gold.where("seed_category is not null").groupBy(F.col("seed_category").alias("category")).agg(
        F.count("*").alias("seeded")
    )
    zero = F.lit(0).cast("bigint")
    return seeded.join(detected, "category", "left").select(
        "category", "seeded", *[F.coalesce(a, zero).alias(f"{a}_detected") for a in ARMS]
    )


def run_totals(runs: DataFrame, gold: DataFrame) -> DataFrame:
    """Sample, seeded and control counts, languages, latency and token sums in one row."""
    seeded = gold.select("run_id", F.col("seed_category").isNotNull().alias("_seeded"))
    return runs.join(seeded, "run_id", "left").agg(
        F.count("*").alias("sample_count"),
        F.count_if(F.col("_seeded")).alias("seeded_count"),
        F.count_if(~F.col("_seeded")).alias("control_count"),
        F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("languages"),
        F.sum("latency_ms").alias("total_latency_ms"),
        F.sum("prompt_tokens").alias("total_prompt_tokens"),
        F.sum("completion_tokens").alias("total_completion_tokens"),
    )


def latency_token_report(runs: DataFrame) -> DataFrame:
    return runs.groupBy("lang").agg(
        F.count("*").alias("runs"),
        F.sum("latency_ms").alias("latency_ms"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
    )


def resume_missing(work: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(still to do, conflicting)``: a finished id with another hash is a violation."""
    finished = done.select("run_id", F.col("draft_sha256").alias("_sha"))
    todo = work.join(finished.select("run_id"), "run_id", "left_anti")
    conflicts = work.join(finished, "run_id").where("draft_sha256 <> _sha").select("run_id")
    return todo, conflicts
