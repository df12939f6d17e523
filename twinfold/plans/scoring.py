"""Queries of variants, input validation and finding scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinfold.functions import text as tx
from twinfold.operators import evaluation as ev
from twinfold.plans import tables
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


def _hash(text: str, key: str, every: int):
    """Declared hash of a text, wrong on a known share of rows."""
    return F.when(F.col(key) % every == 0, F.lit("0" * 64)).otherwise(tx.sha256_hex(F.col(text)))


def cases(spark, folder):
    return relation(spark, folder, "eval_cases").withColumn("source_sha256", _hash("source", "doc_id", 41))


def runs(spark, folder):
    r = relation(spark, folder, "eval_runs")
    return r.withColumns(
        {
            "draft_sha256": _hash("draft", "doc_id", 43),
            "baseline_sha256": _hash("draft", "doc_id", 43),
            "enhanced_sha256": _hash("draft", "doc_id", 47),
        }
    )


def gold(spark, folder):
    g = relation(spark, folder, "eval_gold")
    return g.withColumn("clean_categories", F.split("clean", ",")).drop("clean")


def findings(spark, folder):
    return relation(spark, folder, "eval_findings")


_G = f"WITH g AS ({ansi('eval_gold')}), f AS ({ansi('eval_findings')}), r AS ({ansi('eval_runs')}), c AS ({ansi('eval_cases')}), "
_M = _G + (
    "m AS (SELECT f.*, g.seed_category, CASE WHEN coalesce(f.category = g.seed_category AND length(f.draft_span) > 0 AND "
    "(starts_with(g.seed_span, f.draft_span) OR (length(f.draft_span) <= 120 AND contains(f.draft_span, g.seed_span))), false) THEN 'hit' "
    "WHEN list_contains(string_split(g.clean, ','), f.category) THEN 'false-positive' ELSE 'unadjudicated' END AS verdict "
    "FROM f JOIN g USING (run_id)), "
    "sc AS (SELECT a.arm, (SELECT count(seed_category) FROM g) AS seeded, "
    "(SELECT count(DISTINCT run_id) FROM m WHERE verdict = 'hit' AND m.arm = a.arm) AS true_positive, "
    "(SELECT count(*) FROM m WHERE verdict = 'false-positive' AND m.arm = a.arm) AS false_positive, "
    "(SELECT count(*) FROM m WHERE m.arm = a.arm) AS warning_volume, "
    "(SELECT count(*) FROM m WHERE verdict = 'unadjudicated' AND m.arm = a.arm) AS unadjudicated "
    "FROM (SELECT unnest(['baseline', 'enhanced']) AS arm) a)"
)


@query(
    "seed_variants",
    f"""WITH p AS ({ansi('pairs')}), m AS (SELECT pair_id, draft, replace(draft, '2.5 ', '3.5 ') AS changed FROM p
      WHERE (length(draft) - length(replace(draft, '2.5 ', ''))) / 4 = 1),
    v AS (SELECT 'case-' || pair_id AS case_id, 'control' AS kind, draft FROM m UNION ALL SELECT 'case-' || pair_id, 'seeded', changed FROM m)
    SELECT case_id || '-' || kind AS run_id, case_id, sha256(draft) AS draft_sha256 FROM v""",
)
def seed_variants(spark, folder):
    return _variants(spark, folder)[0].select("run_id", "case_id", "draft_sha256")


def _variants(spark, folder):
    drafts = relation(spark, folder, "pairs").select(
        F.concat(F.lit("case-"), F.col("pair_id").cast("string")).alias("case_id"), "draft"
    )
    mutations = tables.read(spark, folder, "documents").select(
        F.concat(F.lit("case-"), F.col("doc_id").cast("string")).alias("case_id"),
        F.lit("2.5 ").alias("before"),
        F.lit("3.5 ").alias("after"),
        F.lit("number").alias("category"),
        F.lit(None).cast("string").alias("affected"),
    )
    return ev.seed_variants(drafts, mutations)


@query(
    "seed_gold",
    f"""WITH p AS ({ansi('pairs')}), m AS (SELECT pair_id FROM p WHERE (length(draft) - length(replace(draft, '2.5 ', ''))) / 4 = 1)
    SELECT 'case-' || pair_id || '-control' AS run_id, CAST(NULL AS VARCHAR) AS seed_category, CAST(NULL AS VARCHAR) AS seed_span, 'number' AS clean FROM m
    UNION ALL SELECT 'case-' || pair_id || '-seeded', 'number', '3.5 ', '' FROM m""",
)
def seed_gold(spark, folder):
    g = _variants(spark, folder)[1]
    return g.select("run_id", "seed_category", "seed_span", F.array_join("clean_categories", ",").alias("clean"))


@query(
    "attach_case_gold",
    _G + "x AS (SELECT r.run_id, r.lang AS rl, c.lang AS cl FROM r LEFT JOIN c USING (case_id)) "
    "SELECT CASE WHEN rl <> cl THEN 'case' ELSE 'none' END AS problem, count(*) AS runs FROM x GROUP BY ALL",
)
def attach_case_gold(spark, folder):
    a = ev.attach_case_gold(runs(spark, folder), cases(spark, folder), gold(spark, folder))
    return a.groupBy(F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count("*").alias("runs"))


@query(
    "validate_eval_inputs",
    _G
    + """v AS (SELECT 'case-fields' AS rule, case_id AS id FROM c WHERE author = ''
    UNION ALL SELECT 'case-hash', case_id FROM c WHERE doc_id % 41 = 0
    UNION ALL SELECT 'gold-clean', run_id FROM g WHERE contains(clean, 'style')
    UNION ALL SELECT 'run-case', run_id FROM r WHERE lang = 'xx'
    UNION ALL SELECT 'draft-hash', run_id FROM r WHERE doc_id % 43 = 0
    UNION ALL SELECT 'arm-hash', run_id FROM r WHERE (doc_id % 43 = 0) <> (doc_id % 47 = 0)
    UNION ALL SELECT 'seed-span', r.run_id FROM r JOIN g USING (run_id) WHERE NOT contains(r.draft, g.seed_span)
    UNION ALL SELECT 'tokens', run_id FROM r WHERE completion_tokens < 0
    UNION ALL SELECT 'finding', run_id FROM f WHERE provenance NOT IN ('model', 'rule')) SELECT rule, id FROM v""",
)
def validate_eval_inputs(spark, folder):
    return ev.validate_eval_inputs(
        cases(spark, folder), runs(spark, folder), gold(spark, folder), findings(spark, folder)
    )


def _matched(spark, folder):
    return ev.match_findings(findings(spark, folder), gold(spark, folder))


@query(
    "match_findings",
    _M + " SELECT run_id, arm, category, draft_span, verdict, count(*) AS n FROM m GROUP BY ALL",
)
def match_findings(spark, folder):
    return _matched(spark, folder).drop("seed_category")


@query(
    "score_arms",
    _M + " SELECT *, seeded - true_positive AS false_negative FROM sc",
)
def score_arms(spark, folder):
    return ev.score_arms(_matched(spark, folder), gold(spark, folder))


@query(
    "precision_recall",
    _M
    + " SELECT arm, true_positive / seeded AS recall, CASE WHEN unadjudicated = 0 AND true_positive + false_positive > 0 "
    "THEN true_positive / (true_positive + false_positive) END AS precision, CASE WHEN unadjudicated = 0 AND true_positive + false_positive > 0 "
    "THEN 'measured on adjudicated findings only' ELSE 'not measured' END AS precision_status FROM sc",
)
def precision_recall(spark, folder):
    scores = ev.precision_recall(ev.score_arms(_matched(spark, folder), gold(spark, folder)))
    return scores.select("arm", "recall", "precision", "precision_status")


@query(
    "per_category",
    _M
    + ", h AS (SELECT DISTINCT run_id, arm, seed_category FROM m WHERE verdict = 'hit') SELECT g.seed_category AS category, count(*) AS seeded, "
    "count(b.run_id) AS baseline_detected, count(e.run_id) AS enhanced_detected FROM g "
    "LEFT JOIN (SELECT run_id FROM h WHERE arm = 'baseline') b USING (run_id) LEFT JOIN (SELECT run_id FROM h WHERE arm = 'enhanced') e USING (run_id) "
    "WHERE g.seed_category IS NOT NULL GROUP BY 1",
)
def per_category(spark, folder):
    return ev.per_category(_matched(spark, folder), gold(spark, folder))


@query(
    "run_totals",
    _G
    + "z AS (SELECT 1) SELECT count(*) AS sample_count, count(g.seed_category) AS seeded_count, count(*) - count(g.seed_category) AS control_count, "
    "array_to_string(list_sort(list_distinct(list(r.lang))), ',') AS languages, CAST(sum(latency_ms) AS BIGINT) AS total_latency_ms, "
    "CAST(sum(prompt_tokens) AS BIGINT) AS total_prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS total_completion_tokens FROM r JOIN g USING (run_id)",
)
def run_totals(spark, folder):
    return ev.run_totals(runs(spark, folder), gold(spark, folder))


@query(
    "latency_token_report",
    _G
    + "z AS (SELECT 1) SELECT lang, count(*) AS runs, CAST(sum(latency_ms) AS BIGINT) AS latency_ms, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, "
    "CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens FROM r GROUP BY lang",
)
def latency_token_report(spark, folder):
    return ev.latency_token_report(runs(spark, folder))


@query(
    "resume_missing",
    _G + "z AS (SELECT 1) SELECT 'todo' AS kind, run_id FROM r WHERE doc_id % 3 = 0 "
    "UNION ALL SELECT 'conflict', run_id FROM r WHERE doc_id % 3 <> 0 AND doc_id % 43 <> 0 AND doc_id % 53 = 0",
)
def resume_missing(spark, folder):
    work = runs(spark, folder)
    done = work.where("doc_id % 3 <> 0").select(
        "run_id",
        F.when(F.col("doc_id") % 53 == 0, F.lit("0" * 64)).otherwise(F.col("draft_sha256")).alias("draft_sha256"),
    )
    todo, conflicts = ev.resume_missing(work, done)
    return todo.select(F.lit("todo").alias("kind"), "run_id").unionByName(
        conflicts.select(F.lit("conflict").alias("kind"), "run_id")
    )
