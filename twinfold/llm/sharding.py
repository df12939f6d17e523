"""Sharding over fixed virtual slots with a versioned slot-to-shard map.

A record is hashed into one of some thousand virtual slots. Bytes and rows are summed per slot, and slots, never
records, are dealt to shards: largest first, each to the lightest shard. The map is a small table (version, slot,
shard, bytes, n_rows) that is stored, read back and edited when shards are added or have grown apart. An edit moves
only the slots that must move and gets the next version.

Only the slot totals, a fixed number of rows, are ever brought together. A record moves once, without its text, to get
its place. Everything is DataFrame functions.

Rows: null text counts as empty, null id is hashed like any value. Repeated rows share a slot and get places one after
another. An empty table gives an empty result. Other columns are carried along untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 4096
SHARDS = 16
_MAP = "version int, slot int, shard int, bytes bigint, n_rows bigint"


def slot_of(keys: list[Column], slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """Adds ``_size`` (UTF-8 bytes and 1), ``_crc`` and the virtual ``_slot`` to every record."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns(
        {"_size": F.octet_length(text).cast("bigint") + 1, "_crc": F.crc32(F.encode(text, "UTF-8"))}
    ).withColumn("_slot", slot_of([F.col(id_col), F.col("_crc"), F.col("_size")], slots))


def slot_totals(records: DataFrame) -> DataFrame:
    return records.groupBy(F.col("_slot").alias("slot")).agg(
        F.sum("_size").alias("bytes"), F.count("*").alias("n_rows")
    )


def _empty_loads(shards: int) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda i: F.struct(F.lit(0).cast("bigint").alias("bytes"), i.cast("int").alias("shard")),
    )


def _deal(order: Column, loads: Column) -> Column:
    """Folds slots in the given order onto the least loaded of ``loads`` (structs of bytes and shard)."""
    start = F.struct(
        loads.alias("loads"),
        F.array().cast("array<struct<slot:int,shard:int,bytes:bigint,n_rows:bigint>>").alias("placed"),
    )

    def place(state: Column, item: Column) -> Column:
        least = F.array_min(state.loads)
        return F.struct(
            F.transform(
                state.loads,
                lambda x: F.when(
                    x.shard == least.shard, F.struct((x.bytes + item.bytes).alias("bytes"), x.shard.alias("shard"))
                ).otherwise(x),
            ).alias("loads"),
            F.concat(
                state.placed,
                F.array(
                    F.struct(
                        item.slot.alias("slot"),
                        least.shard.alias("shard"),
                        item.bytes.alias("bytes"),
                        item.n_rows.alias("n_rows"),
                    )
                ),
            ).alias("placed"),
        )

    return F.aggregate(order, start, place, lambda state: state.placed)


def build_map(totals: DataFrame, shards: int = SHARDS, version: int = 1) -> DataFrame:
    """A new map: slots by falling bytes, each to the lightest shard so far."""
    order = F.sort_array(
        F.collect_list(F.struct("bytes", (-F.col("slot")).alias("minus"), "slot", "n_rows")), asc=False
    )
    return (
        totals.agg(order.alias("slots"))
        .select(F.explode(_deal(F.col("slots"), _empty_loads(shards))).alias("s"))
        .select(F.lit(version).alias("version"), "s.slot", "s.shard", "s.bytes", "s.n_rows")
    )


def rebalance(old: DataFrame, totals: DataFrame, shards: int) -> DataFrame:
    """The next version of a map for current totals and ``shards`` shards.

    Each shard keeps its slots, smallest first, up to the mean load; the rest, and the slots of shards that are gone
    or that the old map lacks, are dealt anew to the lightest shards. What fits stays where it is.
    """
    ranked = Window.partitionBy("shard").orderBy("bytes", "slot").rowsBetween(Window.unboundedPreceding, 0)
    current = totals.join(F.broadcast(old.select("slot", "shard", "version")), "slot", "left")
    all_slots = Window.partitionBy(F.lit(0))
    marked = current.withColumns(
        {"_load": F.sum("bytes").over(ranked), "_mean": F.sum("bytes").over(all_slots) / shards}
    ).withColumn("stays", F.col("shard").isNotNull() & (F.col("shard") < shards) & (F.col("_load") <= F.col("_mean")))
    held = F.aggregate(
        F.col("kept"),
        _empty_loads(shards),
        lambda loads, item: F.transform(
            loads,
            lambda x: F.when(
                x.shard == item.shard, F.struct((x.bytes + item.bytes).alias("bytes"), x.shard.alias("shard"))
            ).otherwise(x),
        ),
    )
    item = F.struct("bytes", (-F.col("slot")).alias("minus"), "slot", "n_rows", "shard")
    gathered = marked.agg(
        F.collect_list(F.when(F.col("stays"), item)).alias("kept"),
        F.sort_array(F.collect_list(F.when(~F.col("stays"), item)), asc=False).alias("loose"),
        (F.coalesce(F.max("version"), F.lit(0)) + 1).cast("int").alias("version"),
    )
    placed = F.concat(
        F.transform("kept", lambda x: F.struct(x.slot.alias("slot"), x.shard.alias("shard"), x.bytes.alias("bytes"), x.n_rows.alias("n_rows"))),
        _deal(F.col("loose"), F.col("held")),
    )
    return (
        gathered.withColumn("held", held)
        .select("version", F.explode(placed).alias("s"))
        .select("version", "s.slot", "s.shard", "s.bytes", "s.n_rows")
    )


def store_map(slot_map: DataFrame, path: str) -> None:
    """Adds a version to the stored map; an existing version is never overwritten."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    stored = spark.read.schema(_MAP).parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == version)


def assign(records: DataFrame, slot_map: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds ``shard``, ``map_version`` and the ``place`` in the shard, gapless from 0.

    Places follow the slot order of the shard: rows in earlier slots, then the row's number within its own slot. So no
    window is wider than a virtual slot.
    """
    before = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.select(
        F.col("slot").alias("_slot"),
        "shard",
        F.col("version").alias("map_version"),
        F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("_first"),
    )
    within = Window.partitionBy("_slot").orderBy(id_col, "_crc", "_size")
    return (
        records.withColumn("_n", F.row_number().over(within))
        .join(F.broadcast(starts), "_slot")  # one row per virtual slot
        .withColumn("place", (F.col("_first") + F.col("_n") - 1).cast("bigint"))
        .drop("_first", "_n")
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, slot_map: DataFrame | None = None) -> DataFrame:
    """The contract's rows: documents over shards of near equal bytes. ``slot_map`` reuses a stored map."""
    records = sized(docs.select("doc_id", "text"), slots=slots).drop("text")
    chosen = build_map(slot_totals(records), shards) if slot_map is None else slot_map
    return assign(records, chosen).select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        F.col("place").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("_slot").alias("virtual_slot"),
        "map_version",
    )
