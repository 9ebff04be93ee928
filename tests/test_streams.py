"""Streams with state against their batch forms, with a restart from a checkpoint between."""

import pytest
from pyspark.sql import functions as F

from glossa.plans import catalogue
from glossa.plans import tables as T
from glossa.streaming import events as E
from glossa.streaming import stateful

SF = "/root/testdata/sf0.001"
SOME = "user_id % 4 = 0"


@pytest.fixture()
def rocks(spark):
    name, provider = stateful.PROVIDER
    before = spark.conf.get(name)
    spark.conf.set(name, provider)
    yield spark
    spark.conf.set(name, before)


def streamed(spark, rows, processor, tmp_path, ts="at_ts"):
    """The processor's rows after two runs: the first half of the rows out of order, then, from the checkpoint, the rest and a far later row that lets all timers run."""
    rows = rows.withColumn("_half", F.ntile(2).over(T.Window.orderBy(ts)))
    end = rows.agg(F.max(ts).alias("m")).first().m
    flush = rows.limit(1).withColumn("user_id", F.lit(-1).cast(rows.schema["user_id"].dataType)).withColumn(ts, F.lit(end) + F.expr("INTERVAL 400 DAYS"))
    out = []
    for k, part in enumerate((rows.where("_half = 1").orderBy(F.rand(3)), rows.where("_half = 2").orderBy(F.rand(4)), flush, flush.withColumn(ts, F.col(ts) + F.expr("INTERVAL 1 DAY")))):
        part.drop("_half").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(rows.drop("_half").schema).parquet(f"{tmp_path}/in")
        name = f"kept_{processor.__name__.lower()}_{k}"
        q = stateful.kept_in_order(stream, processor, "user_id", ts, "nth", "1 second").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
    return spark.read.parquet(f"{tmp_path}/out").where("key >= 0")


def test_answers(rocks, tmp_path):
    spark = rocks
    marks = T.table(spark, SF, "events").where(SOME).select("user_id", F.col("event_id").alias("id"), "ts", F.expr("ts + make_dt_interval(0, 0, cast(10 * (event_id % 700) as int))").alias("finished"))
    want = {r.id: r.stored for r in E.answered(marks.where("id % 23 <> 0"), marks.where("id % 23 = 0"), "user_id", "ts", "finished").collect()}
    ask = marks.select("user_id", "id", F.col("ts").alias("at_ts"), F.when(F.col("id") % 23 == 0, "close").otherwise("ask").alias("kind"), F.col("id").alias("version"), F.col("id").alias("nth"))
    done = marks.where("id % 23 <> 0").select("user_id", "id", F.col("finished").alias("at_ts"), F.lit("done").alias("kind"), F.col("id").alias("version"), (F.col("id") + (1 << 40)).alias("nth"))
    got = streamed(spark, ask.unionByName(done), stateful.Answers, tmp_path).collect()
    assert {r.id: r.stored for r in got} == want and len(got) == len(want) and set(want.values()) == {True, False}


def test_a_kept_version_answers_at_once(rocks, tmp_path):
    spark = rocks
    rows = [(1, 10, "ask", 7, 0), (1, 10, "done", 7, 5), (1, 11, "ask", 7, 6), (1, 12, "ask", 8, 7), (1, 12, "done", 8, 8), (1, 13, "ask", 8, 9), (1, 0, "close", 0, 10), (1, 14, "ask", 8, 11), (1, 14, "done", 8, 12)]
    df = spark.createDataFrame([(k, i, kind, v, s) for k, i, kind, v, s in rows], "user_id long, id long, kind string, version long, s long").selectExpr("*", "timestamp_seconds(s + 1000) AS at_ts", "s AS nth").drop("s")
    got = {r.id: (r.stored, r.kept_id) for r in streamed(spark, df, stateful.Answers, tmp_path).collect()}
    assert got == {10: (True, None), 11: (False, 10), 12: (True, None), 13: (False, 12), 14: (True, None)}


def test_open_rows(rocks, tmp_path):
    spark = rocks
    rows = T.table(spark, SF, "events").where(SOME).select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("at_ts"), F.when(F.col("event_id") % 23 == 0, "close").otherwise("change").alias("kind"), F.col("event_id").alias("nth"))
    want = {r.id for r in E.open_keys(rows, "user_id", "at_ts", "kind").collect()}
    got = streamed(spark, rows, stateful.OpenRows, tmp_path).groupBy("id").agg(F.count_if("open").alias("came"), F.count_if(~F.col("open")).alias("went")).collect()
    assert {r.id for r in got if r.came > r.went} == want and all(r.came == 1 and r.went <= 1 for r in got) and any(r.went for r in got)


def test_modes(rocks, tmp_path):
    spark = rocks
    rows = catalogue.settings_and_runs(spark, SF).where(SOME)
    want = {r.event_id: (r.mode_at, r.binary_at, r.met) for r in catalogue.ST.modes(rows, "user_id", ["ts", "event_id"]).collect()}
    stream = rows.select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("at_ts"), "kind", "mode", "binary", "err", F.col("event_id").alias("nth"))
    got = {r.id: (r.mode, r.binary, r.met) for r in streamed(spark, stream, stateful.Modes, tmp_path).collect()}
    assert got == want
