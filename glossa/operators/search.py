"""Tiered search over the pool: equal names, then names that start so, then fuzzy ones by score."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fuzzy, text

DEFAULT_LIMIT, MAX_LIMIT, BAND = 20, 500, 1000.0


def clamp_limit(limit: float | None) -> int:
    return DEFAULT_LIMIT if limit is None else max(1, min(MAX_LIMIT, math.floor(limit)))


def _ranked(rows: DataFrame, query: Column) -> DataFrame:
    """Rows that match, with tier and score; an empty query lists everything."""
    q = text.trim(query)
    listing = q == ""
    t = F.when(listing, 0).otherwise(fuzzy.tier(q, F.col("id"), F.col("display")))
    rows = rows.withColumn("tier", t)
    score = F.when(~listing & (F.col("tier") == 2), fuzzy.best_score(q, F.col("id"), F.col("display")))
    rows = rows.withColumn("_score", score)
    return rows.where((F.col("tier") < 2) | F.col("_score").isNotNull()).withColumn("score", F.when(F.col("_score").isNotNull(), F.least(F.col("_score") / BAND, F.lit(1.0))))


#: The key under which an index of sets lists all of them.
ALL = -1


def _members(set_: Column) -> Column:
    """The numbers of a set of characters, as `fuzzy.characters` makes it."""
    return F.filter(F.sequence(F.lit(0), F.lit(fuzzy.N_CHARACTERS - 1)), lambda b: F.getbit(set_, b) == 1)


def _in_order(query: Column) -> Column:
    """A pattern, linear in a name, for the names that have a query's characters in order."""
    one = lambda c: F.when(c.rlike("^[A-Za-z0-9]$"), c).otherwise(F.concat(F.lit("\\"), c))
    return F.concat(F.lit("^"), F.array_join(F.transform(F.filter(F.split(query, ""), lambda c: c != ""), lambda c: F.concat(F.lit("[^"), one(c), F.lit("]*+"), one(c))), ""))


def search_many(pool: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, rank, category, id, display, sub_kind, tier, score, matches_total) for each of queries (query_id, query, limit), however many.

    Every kind of match has the query as a subsequence. Very many names share few sets of characters, so those sets are indexed by character, and a query looks up the one of its
    characters that the fewest names have. Sets that hold all of a query's lead to their names, which are tested for order, then scored. Limits are at most MAX_LIMIT. An empty query lists
    the pool, whose first rows are found once.
    """
    asked = queries.withColumn("_q", F.lower(text.trim(F.col("query"))))
    # Sets and scores cost much and their rows are short, so they are dealt by number of tasks, not of bytes.
    tasks = int(pool.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = pool.select("id", "display").distinct().repartition(tasks, "id", "display")
    low = [F.lower(F.coalesce(c, F.lit(""))) for c in ("id", "display")]
    names = names.withColumn("_there", fuzzy.characters(F.concat(*low)))
    sets = names.groupBy("_there").agg(F.count(F.lit(1)).alias("_n"))
    index = sets.select("_there", "_n", F.explode(F.concat(F.array(F.lit(ALL)), _members(F.col("_there")))).alias("_key"))
    frequency = index.groupBy("_key").agg(F.sum("_n").alias("_n"))
    distinct = asked.where("_q <> ''").select("_q").distinct().withColumn("_asked", fuzzy.characters(F.col("_q")))
    # Characters that sets do not tell leave a query with ALL.
    needed = distinct.select("_q", "_asked", F.explode(F.concat(F.array(F.lit(ALL)), _members(F.col("_asked")))).alias("_key")).join(frequency, "_key", "left")
    rarest = needed.groupBy("_q", "_asked").agg(F.min_by("_key", F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_key").alias("k"))).alias("_key"))
    may = index.join(rarest, "_key").where(F.col("_asked").bitwiseAND(F.bitwise_not(F.col("_there"))) == 0).select("_there", "_q", _in_order(F.col("_q")).alias("_order"))
    met = names.join(may, "_there").where(F.rlike(low[0], F.col("_order")) | F.rlike(low[1], F.col("_order")))
    found = _ranked(met.select("_q", "id", "display").repartition(tasks, "_q", "id", "display"), F.col("_q"))
    found = found.select("_q", F.col("id").alias("_id"), F.col("display").alias("_display"), "tier", "_score", "score")
    rows = found.join(asked.where("_q <> ''"), "_q").join(pool, F.col("_id").eqNullSafe(F.col("id")) & F.col("_display").eqNullSafe(F.col("display")))
    rows = rows.select("query_id", "limit", "category", "cat_ord", "seq", "id", "display", "sub_kind", "tier", "_score", "score")
    total = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("matches_total"))
    order = Window.partitionBy("query_id").orderBy("tier", F.col("_score").desc_nulls_last(), "cat_ord", "seq", "id")
    top = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= MAX_LIMIT).where("rank <= limit").join(total, "query_id")

    first = pool.orderBy("cat_ord", "seq", "id").limit(MAX_LIMIT).withColumn("rank", F.row_number().over(Window.orderBy("cat_ord", "seq", "id")))  # MAX_LIMIT rows
    ranks = lambda most: F.explode(F.sequence(F.lit(1), most)).alias("rank")
    every = pool.agg(F.count(F.lit(1)).alias("matches_total")).select("matches_total", ranks(F.lit(MAX_LIMIT)))
    blank = asked.where("_q = '' AND limit > 0").select("query_id", ranks(F.least(F.col("limit"), F.lit(MAX_LIMIT))))
    listing = blank.join(first.join(every, "rank"), "rank").withColumn("tier", F.lit(0)).withColumn("score", F.lit(None).cast("double"))
    out = ["query_id", "rank", "category", "id", "display", "sub_kind", "tier", "score", "matches_total"]
    return top.select(*out).unionByName(listing.select(*out))


def search(pool: DataFrame, query: str = "", category: str | None = None, limit: float | None = None) -> DataFrame:
    """As `search_many` for one query; the limit is part of the sort, so only that many rows are kept per task."""
    rows = pool.where(F.col("category") == category) if category else pool
    rows = _ranked(rows, F.lit(query or ""))
    total = rows.agg(F.count(F.lit(1)).alias("matches_total"))
    top = rows.orderBy("tier", F.col("_score").desc_nulls_last(), "cat_ord", "seq", "id").limit(clamp_limit(limit))
    return top.join(F.broadcast(total)).select("category", "cat_ord", "seq", "id", "display", "sub_kind", "tier", "score", "matches_total")
