"""Secret scan with corpus-wide ownership frequency.

Every text is searched once per kind; where a kind occurs, its matches and the pieces between them give code-point
positions. Each candidate's value is hashed, and the corpus counts the distinct repositories and owners of every hash.
A value of few owners looks like a live credential of theirs; one that many owners hold is a copied example.

Kinds: ``assign``, ``access`` and ``hex`` are fixed patterns whose matches always stay. ``token`` is the kind that this
method adds: a run of 20 or more credential characters with an upper and a lower letter and a digit, outside the
matches of the other kinds, reported only where the corpus shows one owner for it.

``documents`` has no repository: a source stands for the owner and its part in one language for a repository.

Everything is DataFrame functions. Counts are summed map-side from distinct (hash, owner, repository), so a value that
a third of all rows hold is a few rows by then. Nulls: a null text is empty; a null owner or repository is one of its
own. Repeated rows are scanned each and count as one repository. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.session import cut_lineage

# The base patterns, in their listed order.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ASSIGN_LEAST = 12
ORDER = {"assign": 0, "access": 1, "hex": 2, "token": 3}
MAX_OWNERS = 1

_SPANS = "array<struct<start:int,rank:int,stop:int,kind:string,value:string>>"


def _spans(text: Column, kind: str, pattern: str, value_group: int = 0) -> Column:
    """Structs of every leftmost non-overlapping match: code-point start and end, and the value inside it."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else matches
    between = F.split(text, pattern, -1)
    zipped = F.arrays_zip(between.alias("gap"), matches.alias("hit"), values.alias("value"))
    placed = F.aggregate(
        zipped,
        F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out")),
        lambda state, x: F.struct(
            (state["at"] + F.char_length(x["gap"]) + F.coalesce(F.char_length(x["hit"]), F.lit(0))).alias("at"),
            F.when(x["hit"].isNull(), state["out"])
            .otherwise(
                F.concat(
                    state["out"],
                    F.array(
                        F.struct(
                            (state["at"] + F.char_length(x["gap"])).alias("start"),
                            F.lit(ORDER[kind]).alias("rank"),
                            (state["at"] + F.char_length(x["gap"]) + F.char_length(x["hit"])).alias("stop"),
                            F.lit(kind).alias("kind"),
                            x["value"].alias("value"),
                        )
                    ),
                )
            )
            .alias("out"),
        ),
        lambda state: state["out"],
    )
    return F.when(text.rlike(pattern), placed).otherwise(F.array().cast(_SPANS))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``base`` and ``extra``, arrays of match structs, to every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    assign = F.filter(_spans(text, "assign", ASSIGN, 2), lambda x: F.char_length(x["value"]) >= ASSIGN_LEAST)
    found = docs.withColumns({"_assign": assign, "_access": _spans(text, "access", ACCESS), "_hex": _spans(text, "hex", HEX), "_token": _spans(text, "token", TOKEN)})
    base = F.array_sort(F.concat("_assign", "_access", "_hex"))
    live = F.filter(
        "_token",
        lambda x: x["value"].rlike("[0-9]")
        & x["value"].rlike("[a-z]")
        & x["value"].rlike("[A-Z]")
        & ~F.exists("base", lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"])),
    )
    return found.withColumn("base", base).withColumn("extra", live).drop("_assign", "_access", "_hex", "_token")


def ownership(candidates: DataFrame) -> DataFrame:
    """``(hash, n_owners, n_repositories)`` of rows ``(hash, owner, repository)``."""
    each = candidates.select("hash", "owner", "repository").groupBy("hash", "owner", "repository").agg(F.lit(1).alias("_one"))
    by_owner = each.groupBy("hash", "owner").agg(F.count("*").alias("_n"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("_n").alias("n_repositories"))


def find_secrets(
    docs: DataFrame, owner: Column, repository: Column, key: list[str], text_col: str = "text", max_owners: int = MAX_OWNERS
) -> DataFrame:
    """Rows of ``key`` with ``base`` and ``spans`` (base and added matches) and counts of live and copied values.

    ``key`` columns must tell rows apart that should be; rows alike in all of them share one result row each.
    """
    scanned = cut_lineage(
        scan(docs.withColumn("_print", F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))), text_col).select(
            *key, "_print", owner.alias("_owner"), repository.alias("_repository"), "base", "extra"
        )
    )
    held = scanned.where((F.size("base") > 0) | (F.size("extra") > 0)).select(
        *key, "_print", "_owner", "_repository", F.explode(F.concat("base", "extra")).alias("s")
    )
    # equal rows have equal matches: one of them is enough until the result is put together
    marks = held.dropDuplicates([*key, "_print", "_owner", "_repository", "s"]).withColumn("hash", F.sha2("s.value", 256))
    counts = ownership(
        marks.select("hash", F.col("_owner").alias("owner"), F.col("_repository").alias("repository"))
    )
    judged = (
        marks.join(counts, "hash")
        .groupBy(*key, "_print")
        .agg(
            F.collect_set(F.when((F.col("s.kind") != "token") | (F.col("n_owners") <= max_owners), F.col("s"))).alias("_all"),
            F.count(F.when(F.col("n_owners") <= max_owners, 1)).alias("n_live"),
            F.count(F.when(F.col("n_owners") > max_owners, 1)).alias("n_copied"),
            F.collect_set(F.when(F.col("n_owners") <= max_owners, F.struct("s.start", "s.stop"))).alias("live"),
        )
    )
    joined = judged.select(*[F.col(k).alias(f"_k_{k}") for k in key], F.col("_print").alias("_k_print"), "_all", "n_live", "n_copied", "live")
    same = F.col("_print") == F.col("_k_print")
    for k in key:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return scanned.join(joined, same, "left").select(
        *key,
        "_print",
        "base",
        F.array_sort(F.coalesce("_all", F.array().cast(_SPANS))).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
        F.array_sort(F.coalesce("live", F.array().cast("array<struct<start:int,stop:int>>"))).alias("live"),
    )


def written(spans: str) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ","
    )


def count_of(kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint")


def owner_columns() -> tuple[Column, Column]:
    return F.col("source"), F.struct("source", "lang")


def secret_report(docs: DataFrame) -> DataFrame:
    owner, repository = owner_columns()
    return find_secrets(docs, owner, repository, ["doc_id"]).select(
        "doc_id",
        count_of("assign").alias("n_assign"),
        count_of("access").alias("n_access"),
        count_of("hex").alias("n_hex"),
        F.sha2(written("base"), 256).alias("base_sha256"),
        written("spans").alias("spans"),
        "n_live",
        "n_copied",
    )


def _cut(text: Column, live: Column, mask: str) -> Column:
    """The text with the union of the spans replaced by the mask; the spans are sorted."""
    done = F.aggregate(
        live,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda state, x: F.when(x["stop"] <= state["at"], state).otherwise(
            F.struct(
                x["stop"].alias("at"),
                F.when(
                    x["start"] >= state["at"],
                    F.concat(state["out"], F.substring(text, state["at"] + 1, x["start"] - state["at"]), F.lit(mask)),
                )
                .otherwise(state["out"])
                .alias("out"),
            )
        ),
    )
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.char_length(text)))


def mask_secrets(docs: DataFrame, mask: str = "[secret]", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows with every live-looking value's match replaced by the mask; copied examples stay in the text.

    A row without such a match comes back unchanged. ``n_chars``, if there, follows the new text.
    """
    owner, repository = owner_columns()
    found = (
        find_secrets(docs, owner, repository, [id_col], text_col)
        .where(F.size("live") > 0)
        .select(F.col(id_col).alias("_id"), F.col("_print").alias("_p"), "live")
        .dropDuplicates(["_id", "_p"])
    )
    # the row travels as one struct, so its column names cannot clash with those joined to it
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_print")
    )
    row = F.col("_row")
    joined = packed.join(found, row[id_col].eqNullSafe(F.col("_id")) & (F.col("_print") == F.col("_p")), "left")
    changed = joined.withColumn("_new", F.when(F.col("live").isNull(), row[text_col]).otherwise(_cut(row[text_col], F.col("live"), mask)))
    out = {c: row[c] for c in docs.columns} | {text_col: F.col("_new")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("live").isNull(), row["n_chars"]).otherwise(F.char_length("_new").cast("bigint"))
    return changed.select(*[value.alias(c) for c, value in out.items()])
