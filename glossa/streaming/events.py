"""Debounced checks, versioned values and stale results of keyed change events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GAP = "500 milliseconds"


def debounce(events: DataFrame, key: str, ts: str, gap_ms: int = 500) -> DataFrame:
    """(key, fires_at, n): a check fires `gap_ms` after the last of a run of changes; changes closer than that merge."""
    w = Window.partitionBy(key).orderBy(ts)
    gap = F.make_dt_interval(secs=F.lit(gap_ms / 1000))
    opens = F.coalesce(F.col(ts) - F.lag(ts).over(w) >= gap, F.lit(True))
    rows = events.withColumn("_s", F.sum(F.when(opens, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy(key, "_s").agg(F.max(ts).alias("_last"), F.count(F.lit(1)).alias("n"))
    return out.select(key, (F.col("_last") + gap).alias("fires_at"), "n")


def debounce_stream(events: DataFrame, key: str, ts: str, delay: str = "10 seconds", gap: str = GAP) -> DataFrame:
    """As `debounce`, on a stream: session windows per key, emitted once the watermark has passed their end."""
    windows = events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return windows.select(key, F.col("w.end").alias("fires_at"), "n")


def latest_version(rows: DataFrame, key: str, version: str) -> DataFrame:
    """One row a key, that of the highest version."""
    rest = [c for c in rows.columns if c not in (key, version)]
    top = rows.groupBy(key).agg(F.max(F.struct(version, *rest)).alias("v"))
    return top.select(key, f"v.{version}", *[F.col(f"v.{c}").alias(c) for c in rest])


def drop_stale(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """Results whose sequence number is still their key's current one."""
    return rows.withColumn("_m", F.max(seq).over(Window.partitionBy(key))).where(F.col(seq) == F.col("_m")).drop("_m")


def open_keys(rows: DataFrame, key: str, ts: str, kind: str, closing: str = "close") -> DataFrame:
    """Rows of keys that no later closing event has evicted."""
    closed = rows.where(F.col(kind) == closing).groupBy(key).agg(F.max(ts).alias("_closed"))
    return rows.where(F.col(kind) != closing).join(closed, key, "left").where(F.col("_closed").isNull() | (F.col(ts) > F.col("_closed"))).drop("_closed")


def answered(requests: DataFrame, evictions: DataFrame, key: str, started: str, finished: str) -> DataFrame:
    """`requests` with `stored`: every result is returned, but kept only if its key saw no later request and no eviction until it was finished.

    requests: (key, id, started, finished, ...); evictions: (key, id, started). `id` orders what happens at one time.
    """
    marks = requests.withColumn("_evicted", F.lit(False)).unionByName(evictions.select(key, "id", started).withColumn("_evicted", F.lit(True)), allowMissingColumns=True)
    next_ = F.lead(started).over(Window.partitionBy(key).orderBy(started, "id"))
    return marks.withColumn("stored", next_.isNull() | (next_ > F.col(finished))).where("NOT _evicted").drop("_evicted")


def diagnostics(results: DataFrame, documents: DataFrame, key: str = "doc_key") -> DataFrame:
    """(key, nth, line, msg): the list of each document's newest result, which replaces all earlier ones; lines are moved inside the document.

    results: (key, seq, found array<struct<line,msg>>); documents: (key, n_lines). A newest result with an empty list leaves a document without any.
    """
    newest = latest_version(results, key, "seq").join(documents, key)
    rows = newest.select(key, "n_lines", F.posexplode("found").alias("nth", "_d"))
    line = F.least(F.greatest(F.col("_d.line") - 1, F.lit(0)), F.greatest(F.col("n_lines") - 1, F.lit(0)))
    return rows.select(key, "nth", line.alias("line"), F.col("_d.msg").alias("msg"))


def latest_stream(rows: DataFrame, key: str, version: str) -> DataFrame:
    """A running table, for update mode: the row of the highest version of each key so far."""
    rest = [c for c in rows.columns if c not in (key, version)]
    top = rows.groupBy(key).agg(F.max(F.struct(version, *rest)).alias("v"))
    return top.select(key, f"v.{version}", *[F.col(f"v.{c}").alias(c) for c in rest])
