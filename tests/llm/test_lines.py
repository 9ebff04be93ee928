"""Line dedup against a direct reading of the rule."""

import hashlib
import random

from pyspark.sql import functions as F

from glossa.llm import lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, s, k):
    for _ in range(k):
        i = rng.randrange(len(s) + 1)
        s = rng.choice([s[:i] + rng.choice("abcé ") + s[i:], s[:i] + s[i + 1 :], s[:i] + rng.choice("xyz") + s[i + 1 :]])
    return s


def test_banded_distance(spark):
    rng = random.Random(5)
    pairs = []
    for k in range(1500):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 40)))
        pairs.append((a, edited(rng, a, rng.randint(0, 5)) if k % 10 else "".join(rng.choice("ab") for _ in range(rng.randint(0, 5)))))
    pairs.append(("q" * 9000 + "abc" + "r" * 20000, "q" * 9000 + "axc" + "r" * 20000))
    df = spark.createDataFrame(pairs, "a string, b string")
    for edits in (1, 2, 3):
        wrong = df.where(lines.within_edits("a", "b", edits) != (F.levenshtein("a", "b") <= edits)).collect()
        assert wrong == []


def brute(docs):
    seen, out = {}, []
    for doc_id, text in sorted(docs):
        rows, n, equal, near = [], 0, 0, 0
        for line in (text or "").split("\n"):
            if line.strip():
                n += 1
                if line in seen:
                    equal += 1
                    continue
                close = len(line) >= 24 and any(len(x) >= 24 and abs(len(x) - len(line)) <= 2 and distance(x, line) <= 2 for x in seen)
                seen[line] = True
                if close:
                    near += 1
                    continue
            rows.append(line)
        kept = "\n".join(rows)
        out.append((doc_id, n, equal, near, len(kept.encode()), hashlib.md5(kept.encode()).hexdigest()))
    return out


def test_against_brute_force(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdefé ") for _ in range(rng.randint(20, 60))) for _ in range(25)]
    docs = [(0, None), (1, ""), (2, "\n \n\t\n"), (3, "a\na\na"), (4, "z" * 5000 + "\n" + "z" * 4999)]
    for i in range(5, 80):
        docs.append((i, "\n".join(edited(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3, 4])) if rng.random() < 0.8 else rng.choice(["", " ", "the end"]) for _ in range(rng.randint(1, 6)))))
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, line string").repartition(4)
    got = sorted(tuple(r) for r in lines.query(df).collect())
    assert got == brute(docs)


def test_equal_rows_and_no_rows(spark):
    text = "one line that is long enough for edits\nanother"
    rows = lines.query(spark.createDataFrame([(1, text), (1, text), (None, "another"), (2, "one line that is long enough for edit")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_lines, r.n_equal, r.n_near) for r in rows) == [(0, 1, 0, 0), (1, 2, 1, 0), (1, 2, 1, 0), (2, 1, 0, 1)]
    assert lines.query(spark.createDataFrame([], "doc_id long, text string")).collect() == []
