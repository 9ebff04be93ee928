"""Folders, printed results, and the last snippet of a name."""

import json

import pytest

from glossa.sources import artifacts, files


def test_first_folder(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "c").mkdir()
    (tmp_path / "a").write_text("a file")
    names = [str(tmp_path / x) for x in "zabc"]
    assert files.first_folder(spark, names) == names[2]
    with pytest.raises(FileNotFoundError):
        files.first_folder(spark, names[:2])


def test_printed(spark):
    rows = spark.createDataFrame([("ä", None, [1.5])], "id string, sub_kind string, score array<double>")
    text = files.printed(rows)
    assert text.endswith("]\n") and '\n  {\n    "id": "ä",\n    "sub_kind": null,' in text
    assert files.without_keys(json.loads(text), "score") == [{"id": "ä", "sub_kind": None}]
    assert files.printed(rows.limit(0)) == "[]\n"


def test_too_much_to_print(spark):
    assert len(json.loads(files.printed(spark.range(files.MAX_PRINTED)))) == files.MAX_PRINTED
    with pytest.raises(ValueError, match="more than"):
        files.printed(spark.range(files.MAX_PRINTED + 1))


def test_last_snippet_of_a_name_stays(spark):
    rows = [(0, "x", "zz", ["1"], "z"), (1, "y", "p", [], "d"), (2, "x", "aa", ["2"], "a"), (3, "x", None, None, None)]
    snippets = spark.createDataFrame(rows, "place int, name string, prefix string, body array<string>, description string")
    found = artifacts.snippet_map(snippets.where("place < 3")).first().snippets
    assert {k: v.body for k, v in found.items()} == {"x": ["2"], "y": []}
    assert artifacts.snippet_map(snippets).first().snippets["x"].prefix is None
