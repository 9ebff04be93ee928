"""Folders of manuals, what is scanned and parsed how often, and searches against plain scoring."""

import random
import re

import pytest
from pyspark.sql import functions as F

from glossa.operators import corpus as C
from glossa.operators import extract, facts, markup, textlines
from glossa.operators import search as S
from glossa.plans import catalogue
from glossa.plans import tables as T

SF = "/root/testdata/sf0.001"
WRONG = {
    "options.yo": "sect(History)\nstartitem()\nitem(tt({name}))(\nAs `var(name)tt(=)var(pattern) (e.g. `tt(foo=*)').\n)\nenditem()\n",
    "expn.yo": "sect(Modifiers)\nstartitem()\nitem(tt({name}))(Here `tt(%)' and `tt(#%) are not active.)\nenditem()\n",
    "jobs.yo": "sect(Jobs)\nstartsitem()\nsitem(tt(%)var(number))(By number in {name}.)\nendsitem()\n",
}


@pytest.fixture()
def folders(tmp_path):
    for manual, name in (("one", "AA"), ("two", "BB")):
        (tmp_path / manual).mkdir()
        for file, text in WRONG.items():
            (tmp_path / manual / file).write_text(text.replace("{name}", name))
        (tmp_path / manual / "notes.txt").write_text("no manual file")
    return tmp_path


def test_folders_of_manuals_are_one_table(spark, folders):
    files = markup.read_manuals(spark, f"{folders}/*")
    records = extract.corpus(markup.entry_table(files)).select("manual", "category", "id", "seq", F.get_json_object("payload", "$.desc").alias("desc")).collect()
    assert {tuple(r) for r in records} == {
        *((m, "option", n.lower(), 0, "As `name=pattern` (e.g. `foo=*`).") for m, n in (("one", "AA"), ("two", "BB"))),
        *((m, "history", n, 0, "Here `%` and `#%` are not active.") for m, n in (("one", "AA"), ("two", "BB"))),
        *((m, "job_spec", "%number", 0, f"By number in {n}.") for m, n in (("one", "AA"), ("two", "BB"))),
    }
    assert markup.read_manual(spark, f"{folders}/one").count() == 3


def test_only_the_files_asked_for_are_read(spark, folders):
    rows = markup.read_manuals(spark, f"{folders}/*", ["jobs.yo"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "file_name" in plan and rows.count() == 2
    (folders / "one" / "options.yo").unlink()  # what is not asked for need not be there
    assert {r.manual for r in rows.collect()} == {"one", "two"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_each_file_is_parsed_once(spark):
    """Extractors read the written entries, from the folders of their own files."""
    plan = plan_of(catalogue.corpus_extract(spark, SF))
    assert "MapInPandas" not in plan and "MapInArrow" not in plan
    assert len(re.findall(r"PartitionFilters: \[[^\]]*file#\d+ = ", plan)) >= 22


def test_lines_are_scanned_once(spark):
    lines = T.shell(spark, SF)
    assert plan_of(facts.facts_of_lines(lines)).count("MapInArrow") == 1
    assert plan_of(facts.analyzed(lines)).count("MapInArrow") == 2  # lines, and documents for what spans lines


def plain_score(p, name):
    h = name.lower()
    if p == h:
        return 2147483647
    k, last, first, total = 0, -2, -1, 0
    for i, c in enumerate(h):
        if k < len(p) and c == p[k]:
            total += 15 * (i == last + 1) + 10 * (i == 0 or name[i - 1] in "_-./ \t")
            first, last, k = (i if first < 0 else first), i, k + 1
    return max(1, 100 + 200 * (first == 0) - first + total - len(h) // 8) if k == len(p) else None


def test_searches_against_plain_scoring(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcABC_ .é") for _ in range(n))
    names = sorted({word(rng.randint(1, 9)).strip() or "x" for _ in range(250)})
    records = [("k", i, x if rng.random() < 0.8 else f"<{x}>", x) for i, x in enumerate(names)]
    pool = spark.createDataFrame([(c, 0, i, x, d, None) for c, i, x, d in records], "category string, cat_ord int, seq long, id string, display string, sub_kind string")
    queries = [(i, word(rng.randint(0, 4)), rng.choice([3, 400])) for i in range(120)]
    got = {}
    for r in S.search_many(pool, spark.createDataFrame(queries, "query_id int, query string, limit int")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.tier, r.matches_total))
    for i, query, limit in queries:
        q = query.strip(" ").lower()
        want = []
        for _, seq, x, d in records:
            low = (x.lower(), d.lower())
            tier = 0 if not q or q in low else 1 if any(v.startswith(q) for v in low) else 2
            scores = [s for v in {x, d} if v.isascii() and q.isascii() and (s := plain_score(q, v)) is not None] if tier == 2 else []
            if tier < 2 or scores:
                want.append((tier, -max(scores, default=0), seq, x))
        want.sort()
        assert [(a, b, c) for a, b, c, _ in sorted(got.get(i, []))] == [(k + 1, w[3], w[0]) for k, w in enumerate(want[:limit])], query
        assert {n for *_, n in got.get(i, [])} <= {len(want)}
    plan = plan_of(S.search_many(pool, spark.createDataFrame(queries, "query_id int, query string, limit int")))
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_ten_thousand_searches(spark):
    pool = C.pool(T.corpus(spark, SF), catalogue._dim(spark))
    asked = spark.range(10_001).select(F.col("id").cast("int").alias("query_id"), F.concat(F.lit("cust"), F.col("id") % 150).alias("query"), F.lit(1).alias("limit"))
    rows = S.search_many(pool, asked)
    assert rows.select("query_id").distinct().count() == 10_001


def test_long_lines_take_time_in_proportion(spark):
    """Tokens, names and pairs of a line of a hundred thousand words."""
    text = " ".join(f"w{i}=v{i}" for i in range(100_000))
    lines = textlines.doc_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    rows = textlines.matched(lines, ["doc_id", "line_no"], F.col("text"), "[a-z0-9]+")
    last = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("start", "end", "word")).alias("m")).first()
    assert last.n == 200_000 and last.m.end == len(text) and text[last.m.start : last.m.end] == last.m.word
