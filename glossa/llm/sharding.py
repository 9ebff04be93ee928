"""Sharding over fixed virtual slots.

Records hash into a fixed number of virtual slots. Bytes and rows are summed per slot, and a versioned
slot-to-shard map says which shard holds a slot. Rebalancing edits the map and never the hash: version 0
deals slots round-robin, each later version keeps a slot where it is as long as its shard stays within an
equal share, and moves the others, largest first, to the shard with the fewest bytes.

All of it is DataFrame and SQL functions. The map has as many rows as there are virtual slots, whatever the
data's size; only it is broadcast, and only it is folded in one task.

Cases: null text counts as empty; null or repeated ids, repeated rows and empty texts are records like any
other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written

N_SLOTS = 8192
OVERHEAD = 8


def records(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot); size is the text's UTF-8 bytes plus a fixed overhead."""
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text_or_empty()) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(text_or_empty().cast("binary")).cast("long").alias("text_crc32"),
    )
    return rows.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(n_slots)).cast("long"))


def slot_loads(recs: DataFrame) -> DataFrame:
    """(virtual_slot, bytes, n_rows) of the slots in use; summed on the map side first."""
    return recs.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_rows"))


def initial_map(spark: SparkSession, loads: DataFrame, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """Version 0: every virtual slot, dealt round-robin."""
    slots = spark.range(0, n_slots, 1, 1).withColumnRenamed("id", "virtual_slot")
    return slots.join(loads, "virtual_slot", "left").select(
        F.lit(0).alias("version"),
        "virtual_slot",
        F.pmod(F.col("virtual_slot"), F.lit(n_shards)).cast("int").alias("shard"),
        F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"),
        F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"),
    )


def rebalanced(slot_map: DataFrame, n_shards: int) -> DataFrame:
    """The next version of a map, for `n_shards` shards (as many as before, or more).

    Slots are taken largest first. One stays if its shard keeps within an equal share of all bytes; the others
    move, largest first, to the shard with the fewest bytes (the lowest number among equals). Ties go by slot.
    """
    zeros = f"transform(sequence(1, {n_shards}), i -> 0L)"
    added = lambda at: f"transform(a.load, (v, i) -> if(i = {at}, v - x.less, v))"
    lightest = "(array_position(a.load, array_min(a.load)) - 1)"
    # Text of fixed-width codes, a slot each, grows cheaply where arrays of structs would be copied at each step.
    stay = f"""aggregate(slots, named_struct('load', {zeros}, 'codes', ''), (a, x) ->
        if(a.load[x.shard] - x.less <= share,
           named_struct('load', {added("x.shard")}, 'codes', concat(a.codes, '1')),
           named_struct('load', a.load, 'codes', concat(a.codes, '0'))))"""
    move = f"""aggregate(pool, named_struct('load', stay.load, 'codes', ''), (a, x) ->
        named_struct('load', {added(lightest)}, 'codes', concat(a.codes, lpad(hex({lightest}), 4, '0'))))"""
    one = slot_map.groupBy().agg(
        (F.max("version") + 1).alias("version"),
        F.ceil(F.sum("bytes") / n_shards).cast("long").alias("share"),
        F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "virtual_slot", "shard", "n_rows"))).alias("slots"),
    )
    two = one.withColumn("stay", F.expr(stay))
    two = two.withColumn("kept", F.expr("filter(slots, (x, i) -> substring(stay.codes, i + 1, 1) = '1')"))
    two = two.withColumn("pool", F.expr("filter(slots, (x, i) -> substring(stay.codes, i + 1, 1) = '0')"))
    two = two.withColumn("codes", F.expr(f"({move}).codes"))
    dealt = "transform(pool, (x, i) -> named_struct('less', x.less, 'virtual_slot', x.virtual_slot, 'shard', cast(conv(substring(codes, 4 * i + 1, 4), 16, 10) as int), 'n_rows', x.n_rows))"
    return two.select("version", F.explode(F.expr(f"concat(kept, {dealt})")).alias("s")).select(
        "version", "s.virtual_slot", "s.shard", (-F.col("s.less")).alias("bytes"), "s.n_rows"
    )


def placed(recs: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Records with their shard and their place in it, from 0 without gaps.

    A place is what stands before the virtual slot in its shard plus the rank in the virtual slot, so no task
    sorts more than a slot's records.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    bases = slot_map.select("virtual_slot", "shard", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")) - 1
    return recs.withColumn("rank", rank).join(F.broadcast(bases), "virtual_slot").withColumn("slot", F.col("base") + F.col("rank"))


def sharded(docs: DataFrame, n_shards: int = 24, n_slots: int = N_SLOTS) -> tuple[DataFrame, DataFrame]:
    """Placed records and the map's stored versions (0 and the rebalanced 1)."""
    spark = docs.sparkSession
    recs = written(records(docs, n_slots), "shard-records")
    first = written(initial_map(spark, slot_loads(recs), n_shards, n_slots), "slot-map-0")
    versions = written(first.unionByName(rebalanced(first, n_shards)).coalesce(1), "slot-map")
    latest = versions.where(F.col("version") == 1)
    return placed(recs, latest), versions


def query(docs: DataFrame) -> DataFrame:
    rows, _ = sharded(docs)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )
