"""Table functions called from SQL, and artifacts as text."""

import json
from pathlib import Path

import pytest

from glossa.operators import markup, render
from glossa.plans import catalogue, sql_functions
from glossa.sources import artifacts as A


def test_entries_from_sql(spark):
    assert sql_functions.register(spark) == ["glossa_entries"]
    spark.createDataFrame(list(catalogue.MINIATURE.items()), "file string, value string").createOrReplaceTempView("files")
    got = spark.sql("SELECT * FROM glossa_entries(TABLE(files)) ORDER BY file, pos").collect()
    want = markup.entries(spark.table("files")).orderBy("file", "pos").collect()
    assert got == want and got


@pytest.mark.parametrize(("query", "says"), [("TABLE(SELECT 1 AS file, 'x' AS value)", "file as text"), ("TABLE(SELECT 'x' AS file)", "column value"), ("'x'", "takes a table")])
def test_types_are_checked_when_analyzed(spark, query, says):
    sql_functions.register(spark)
    with pytest.raises(Exception, match=says):
        spark.sql(f"SELECT * FROM glossa_entries({query})").schema  # noqa: B018


def test_tools_by_name(spark):
    shown = render.rendered(catalogue._miniature(spark)).cache()
    flags = spark.createDataFrame([("beep", [("B", "+")])], "id string, flags array<struct<char:string,on:string>>")
    sql_functions.register(spark, shown, flags)
    spark.createDataFrame([("NO_BEEP",), ("be_ep",), ("x",)], "raw string").createOrReplaceTempView("asked")
    got = {r.raw: (r.id, r.negated) for r in spark.sql("SELECT raw, o.id, o.negated FROM asked, LATERAL glossa_option(asked.raw) o").collect()}
    assert got == {"NO_BEEP": ("beep", True), "be_ep": ("beep", False), "x": (None, None)}
    assert spark.sql("SELECT markdown FROM glossa_describe('option', 'ring')").first().markdown == catalogue._RING
    assert [r.id for r in spark.sql("SELECT id FROM glossa_flag('+B')").collect()] == ["beep"]


def test_artifacts_are_indented_json_with_an_index(spark, tmp_path):
    entries = markup.entry_table(spark.createDataFrame(list(catalogue.MINIATURE.items()), "file string, value string"))
    for _ in range(2):  # again over the first
        A.write_artifacts(entries, str(tmp_path / "json"), "1.2", "5.9")
    found = {p.name: p.read_text() for p in Path(tmp_path, "json").iterdir() if p.suffix == ".json"}
    index = json.loads(found.pop("index.json"))
    assert sorted(found) == index["files"] and len(found) == 22 and not [p for p in Path(tmp_path, "json").iterdir() if p.name.startswith("_aside")]
    for text in found.values():
        assert text == json.dumps(json.loads(text), indent=2, ensure_ascii=False) + "\n"
    options = json.loads(found["options.json"])
    assert index["counts"]["options"] == len(options) == 2 and index["counts"]["builtins"] == 0 and found["builtins.json"] == "[]\n"
    assert list(options[1]) == ["name", "display", "flags", "defaultIn", "category", "desc", "aliasOf", "markdown"] and options[1]["markdown"] == catalogue._RING


def test_json_text_keeps_chosen_nulls(spark):
    df = spark.createDataFrame([(None, None, "a\"\\\n\u0001é/", [], [True, None])], "match struct<sub_kind:string>, score long, text string, none array<string>, flags array<boolean>")
    kind = df.schema
    text = df.select(A.json_text(A.F.struct(*kind.names), kind, 0, frozenset(["match"]))).first()[0]
    want = {"match": None, "text": "a\"\\\n\u0001é/", "none": [], "flags": [True, None]}
    assert text == json.dumps(want, indent=2, ensure_ascii=False)
