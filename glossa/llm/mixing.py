"""Mixing sources to target weights by Sainte-Laguë apportionment.

Each source's words form blocks of equal size. The blocks of the mix go to sources by highest quotients
(votes over 1, 3, 5, ...), a source's blocks go to its shards likewise, and inside a shard the quota is drawn
from the blocks by systematic selection with a seeded start over a seeded order of documents. Every step is a
DataFrame or SQL function; blocks are never listed one by one, since what a document gives follows from its
place among its shard's words.

Highest quotients without a loop over seats: rounding votes over one divisor gives a valid apportionment of
nearly the right size, and the few seats too many or too few are settled by ranking the next quotients. With
m seats over and S parties a party can win at most votes / all * (m + S) + 1 of them, so ranking looks at no
more than a few rows a party.

Cases: null text has no words; a null source is a source of its own, the last; documents without words and
sources without words get 0; repeated rows are documents like any other, and so are null ids; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, written

WEIGHTS = (5, 2, 1)
REPEATS = 3
BLOCK_WORDS = 16
SHARD_BLOCKS = 65536
MAX_SHARDS = 4096
SEED = "mix-1"


def _draw(*parts):
    """A hex digest that the seed and `parts` decide."""
    return F.md5(F.concat_ws(":", F.lit(SEED), *[F.coalesce(F.col(p).cast("string"), F.lit("?")) for p in parts]).cast("binary"))


def _number(digest):
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size) with `target`: shares by weight, none above `repeats` times the source's size.

    Resharing an excess by weight until none is above ends where target = least(cap, level * weight); the level is
    the largest of (all - caps of the k scarcest) / (weights of the rest) over k.
    """
    everything = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("rank", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * repeats)
    scarce = everything.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn(
        "level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(scarce), F.lit(0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(scarce), F.lit(0))),
    )
    return ranked.withColumn("level", F.max("level").over(everything)).withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))).drop("level", "cap", "weight")


def apportioned(df: DataFrame, group: list[str], party: str, votes: str, house: str, out: str) -> DataFrame:
    """`df` with `out`: the seats of each party of a group, by highest quotients; ties go to the lower party.

    `house` holds the group's seats in each of its rows; parties are numbers, and those without votes get none.
    """
    of = Window.partitionBy(*[F.col(c) for c in group]) if group else Window.partitionBy(F.lit(0))
    every = df.columns
    live = df.withColumn("_all", F.sum(votes).over(of)).withColumn("_n", F.count(F.lit(1)).over(of))
    live = live.withColumn("_q", F.when(F.col("_all") > 0, F.floor(F.col(votes) * F.col(house) / F.col("_all") + F.lit(0.5))).otherwise(0).cast("long"))
    live = live.withColumn("_m", F.when(F.col("_all") > 0, F.col(house) - F.sum("_q").over(of)).otherwise(0).cast("long"))
    more = F.least(F.abs("_m"), F.ceil(F.col(votes) / F.col("_all") * (F.abs("_m") + F.col("_n"))) + 1)
    steps = F.when((F.col("_m") == 0) | (F.col(votes) <= 0), 1).when(F.col("_m") < 0, F.greatest(F.lit(1), F.least(more, F.col("_q")))).otherwise(more)
    long = live.withColumn("_e", F.explode(F.sequence(F.lit(1).cast("long"), steps.cast("long"))))
    won = F.col(votes) / (2 * (F.col("_q") + F.col("_e")) - 1)
    lost = -F.col(votes) / (2 * (F.col("_q") - F.col("_e")) + 1)
    able = (F.col(votes) > 0) & ((F.col("_m") > 0) | (F.col("_q") >= F.col("_e")))
    long = long.withColumn("_quotient", F.when(able, F.when(F.col("_m") < 0, lost).otherwise(won)))
    order = Window.partitionBy(*[F.col(c) for c in group]) if group else Window.partitionBy(F.lit(0))
    long = long.withColumn("_rank", F.row_number().over(order.orderBy(F.col("_quotient").desc_nulls_last(), F.when(F.col("_m") < 0, -F.col(party)).otherwise(F.col(party)))))
    taken = F.sum(F.when(F.col("_rank") <= F.abs("_m"), F.signum("_m")).otherwise(0)).cast("long")
    return long.groupBy(*every, "_q").agg(taken.alias("_d")).withColumn(out, F.col("_q") + F.col("_d")).drop("_q", "_d")


def mixed(docs: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies) of each document.

    `taken`: how many of its words, repeats counted, the mix takes; `copies`: how often it takes the middle one, for
    mixing by whole documents.
    """
    recs = written(docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words().alias("size")), "mix-records")
    recs = recs.withColumn("draw", _draw("doc_id"))
    sizes = recs.groupBy("source").agg(F.sum("size").alias("source_size"))
    src = targets(sizes, weights, repeats)
    spread = F.ceil(F.col("source_size") / F.lit(block_words * SHARD_BLOCKS))
    src = written(src.withColumn("n_shards", F.greatest(F.lit(1), F.least(F.lit(MAX_SHARDS), spread)).cast("long")), "mix-sources")

    at = src.select(F.col("source").alias("_source"), "rank", "n_shards", "source_size", "target")
    rows = recs.join(at, recs["source"].eqNullSafe(at["_source"])).drop("_source")
    rows = rows.withColumn("shard", _number(F.col("draw")) % F.col("n_shards"))

    shards = rows.groupBy("rank", "shard").agg(F.sum("size").alias("words"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
    half = F.expr(f"(2 * words + {block_words}) div {2 * block_words}")
    shards = shards.withColumn("blocks", F.when(F.col("words") > 0, F.greatest(F.lit(1).cast("long"), half)).otherwise(F.lit(0).cast("long")))
    parties = shards.groupBy("rank").agg(F.sum("blocks").alias("all_blocks"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
    parties = parties.withColumn("entitled", F.when(F.col("source_size") > 0, F.col("target") * F.col("all_blocks") / F.col("source_size")).otherwise(F.lit(0.0)))
    parties = parties.withColumn("house", F.round(F.sum("entitled").over(Window.partitionBy(F.lit(0)))).cast("long"))
    parties = apportioned(parties, [], "rank", "entitled", "house", "seats")
    parties = parties.select("rank", F.least("seats", F.col("all_blocks") * repeats).alias("seats"))
    shards = apportioned(shards.join(parties, "rank").select("rank", "shard", "words", "blocks", "seats"), ["rank"], "shard", "blocks", "seats", "quota")
    shards = shards.withColumn("quota", F.least("quota", F.col("blocks") * repeats))
    shards = shards.withColumn("start", F.when(F.col("blocks") > 0, _number(_draw("rank", "shard")) % F.col("blocks")))
    shards = written(shards.select("rank", "shard", "words", "blocks", "quota", "start"), "mix-quotas")

    rows = rows.join(shards, ["rank", "shard"])
    order = Window.partitionBy("rank", "shard").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("size").over(order))

    def drawn(x: str) -> str:
        """Words that one draw of the quota's remainder takes from the first `x` words of the shard."""
        j = f"(({x}) * blocks div words)"
        upto = lambda k: f"(({k}) * (quota % blocks) + start) div blocks"
        full = f"({upto(j)})"
        picked = f"({upto(f'{j} + 1')} - {full})"
        return f"(({full} * words + {picked} * (({x}) * blocks - {j} * words)) div blocks)"

    taken = F.expr(f"CASE WHEN words > 0 AND size > 0 THEN (quota div blocks) * size + {drawn('upto')} - {drawn('upto - size')} ELSE 0L END")
    middle = "((upto - size + size div 2) * blocks div words)"
    chosen = f"((({middle} + 1) * (quota % blocks) + start) div blocks - ({middle} * (quota % blocks) + start) div blocks)"
    copies = F.expr(f"CASE WHEN words > 0 AND size > 0 THEN (quota div blocks) + {chosen} ELSE 0L END")
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), copies.cast("long").alias("copies"))


def query(docs: DataFrame) -> DataFrame:
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken")
