"""Sharding through fixed virtual slots.

A record's slot is a hash of its key and never changes. Bytes are added up per slot; a slot-to-shard map,
stored as a versioned table, is filled by giving the largest slots to the lightest shard. When shards are
added or loads drift, `rebalance` edits the map: only edited slots move. A stored map is used as it is while
it holds all slots and no shard is more than `TOLERANCE` above the mean; else its next version is stored.

Everything is DataFrame code. The map has `n_slots` rows whatever the input, so that it may be broadcast.

Defined results: a null text counts 1 byte and has the CRC-32 of the empty text (0); a null doc_id hashes
to one slot like any other key; repeated rows each get a position of their own; an empty table gives an
empty result; other columns of the input are ignored. doc_id is taken to be close to a key: rows of one
doc_id share a slot and so one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut, exists, new_path, table

N_SLOTS = 4096
N_SHARDS = 16
TOLERANCE = 0.02


def slot_of(key: Column, n_slots: int = N_SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_slots)).cast("int")


def _deal(slots: DataFrame, loads: Column) -> DataFrame:
    """Largest slot first, each to the lightest shard (the first of equals). slots: slot, bytes, at most
    n_slots rows; loads: array of the shards' bytes so far. Gives slot, shard."""
    one = slots.agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "slot"))).alias("s"))

    def put(acc: Column, x: Column) -> Column:
        to = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int") - 1
        grown = F.transform(acc["loads"], lambda v, i: F.when(i == to, v - x["less"]).otherwise(v))
        return F.struct(
            grown.alias("loads"),
            F.concat(acc["dealt"], F.array(F.struct(x["slot"].alias("slot"), to.alias("shard")))).alias("dealt"),
        )

    none = F.expr("cast(array() as array<struct<slot:int,shard:int>>)")
    start = F.struct(loads.alias("loads"), none.alias("dealt"))
    return one.select(F.inline(F.aggregate("s", start, put, lambda acc: acc["dealt"])))


def assign(slots: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """Version 1 of the map: version, slot, shard, for slots(slot, bytes)."""
    loads = F.array_repeat(F.lit(0).cast("bigint"), n_shards)
    return _deal(slots, loads).select(F.lit(1).alias("version"), "slot", "shard")


def rebalance(slot_map: DataFrame, slots: DataFrame, n_shards: int) -> DataFrame:
    """The next version of a map, for the slots' present bytes and n_shards (not fewer than before).

    Shards above the new mean give away slots, smallest first, as long as what they give fits in their
    excess; those slots go, largest first, to the lightest shards. All other slots keep their shard; slots
    that the map does not hold yet are dealt too."""
    known = slots.join(F.broadcast(slot_map), "slot", "left").select("slot", "bytes", "shard", "version")
    mean = known.agg((F.sum("bytes") / n_shards).alias("mean"))
    load = Window.partitionBy("shard")
    given = load.orderBy("bytes", "slot").rowsBetween(Window.unboundedPreceding, 0)
    marked = (
        known.crossJoin(F.broadcast(mean))  # one row
        .withColumn("excess", F.sum("bytes").over(load) - F.col("mean"))
        .withColumn("moves", F.col("shard").isNull() | (F.sum("bytes").over(given) <= F.col("excess")))
    )
    stay = marked.filter(~F.col("moves"))
    sums = F.map_from_entries(F.collect_list(F.struct("shard", "load")))
    loads = stay.groupBy("shard").agg(F.sum("bytes").alias("load")).agg(sums.alias("m"))
    shards = F.sequence(F.lit(0), F.lit(n_shards - 1))
    kept = F.transform(shards, lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("bigint"))
    row = loads.select(kept.alias("loads")).first()  # n_shards numbers
    dealt = _deal(marked.filter("moves"), F.array(*[F.lit(v).cast("bigint") for v in row["loads"]]))
    version = slot_map.agg((F.max("version") + 1).alias("version"))
    return (
        stay.select("slot", "shard").unionByName(dealt).crossJoin(F.broadcast(version)).select("version", "slot", "shard")
    )


def store(spark: SparkSession, slot_map: DataFrame, path: str) -> DataFrame:
    """Add a version to the stored map; gives it back as read from there. Each version is a folder that must
    not exist yet, so that of two writers of one version one fails."""
    version = slot_map.agg(F.max("version")).first()[0] or 1
    slot_map.select("slot", "shard").coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")
    return load(spark, path, version)


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the stored map, the newest unless one is named."""
    every = spark.read.schema("slot int, shard int, version int").parquet(path)
    if version is None:
        version = every.agg(F.max("version")).first()[0] or 0
    return every.filter(F.col("version") == version)


def current_map(per_slot: DataFrame, n_shards: int, path: str, tolerance: float = TOLERANCE) -> DataFrame:
    """The stored map for per_slot(slot, bytes): made if there is none, edited if it has to be."""
    spark = per_slot.sparkSession
    if not exists(spark, path):
        return store(spark, assign(per_slot, n_shards), path)
    now = load(spark, path)
    loads = {r["shard"]: r["bytes"] for r in per_slot.join(now, "slot", "left").groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()}  # shards + 1 rows
    most = (1 + tolerance) * sum(loads.values()) / n_shards
    if None not in loads and set(loads) <= set(range(n_shards)) and all(b <= most for b in loads.values()):
        return now
    return store(spark, rebalance(now, per_slot, n_shards), path)


def shard(docs: DataFrame, n_shards: int = N_SHARDS, n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """Every row of docs(doc_id, text) with its slot, its shard and its place in the shard (from 0,
    without gaps): doc_id, size, text_crc32, virtual_slot, shard, place. map_path: where the map is stored; a
    new one is made where none is named."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    slim = cut(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            slot_of(F.col("doc_id"), n_slots).alias("virtual_slot"),
        ),
        "slots",
    )
    per_slot = cut(
        slim.groupBy(F.col("virtual_slot").alias("slot")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")),
        "slot-bytes",
    )
    slot_map = current_map(per_slot.select("slot", "bytes"), n_shards, map_path or new_path(spark, "slot-map"))
    before = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        per_slot.join(F.broadcast(slot_map), "slot")
        .withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0)))
        .select(F.col("slot").alias("virtual_slot"), "shard", "start")
    )
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        slim.withColumn("at", F.row_number().over(within) - 1)
        .join(F.broadcast(starts), "virtual_slot")
        .select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("start") + F.col("at")).alias("place"))
    )


def op3_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    return shard(table(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("place").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )
