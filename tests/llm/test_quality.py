"""Quality rules against a direct reading of the base figures, and single lines."""

import random
import re
from collections import Counter

import pytest

from glossa.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(zip(w, w[1:], w[2:], w[3:], w[4:]))
    covered = {k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n, r = len(w), len(covered)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, r, n < 10 or 100 * r > 20 * n


def test_base_figures(spark):
    rng = random.Random(6)
    texts = [None, "", " \n", "a b c d e a b c d e", "x\x1fy\xa0z q", "word " * 500, "é ü\n" * 12]
    texts += [" ".join(rng.choice("abcdefgh") + rng.choice(["", ".", "\n", "#"]) for _ in range(rng.randint(0, 120))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "doc_id long, text string, kept boolean")
    rows = quality.query(df).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows} == {i: base(t) for i, t in enumerate(texts)}
    assert not any(r.kept and r.base_failed for r in rows)
    assert quality.query(df.limit(0)).collect() == []


@pytest.mark.parametrize(
    ("line", "rule"),
    [
        ("A plain sentence, as prose has them.", None),
        ("short title", None),
        ("Rewh.### And&&& a$$$ thouhe$$$ and&&&", "punctuation"),
        ("OF!! ERATER!! THE!! EDTIONTION!! ANERING!!", "punctuation"),
        ("one two three four five six seven eight nine ten eleven twelve", "punctuation"),
        ("home » news » about » more.", "navigation"),
        ("Next", "navigation"),
        ("Licensed under the Apache License, Version 2.0.", "boilerplate"),
        ("We use cookies to improve this site; accept our policy.", "boilerplate"),
    ],
)
def test_lines(line, rule):
    assert quality.line_fails(line) == rule


def test_verdicts_and_cleaned_texts(spark):
    good = "This is a sentence with enough words, and it ends as it should."
    texts = [good, good + "\nAll rights reserved.", good + "\n" + "a### b*** c$$$ " * 20, "All rights reserved.\nReleased under the MIT License, as is usual here and there."]
    rows = quality.judged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), with_text=True).orderBy("doc_id").collect()
    assert [r.kept for r in rows] == [True, True, False, False]
    assert rows[1].clean_text == good
