"""Texts cut and put together again, against a plain version on strings."""

import random
from hashlib import sha256

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st

from glossa.llm import middle
from glossa.llm.sql import ORACLES


def plain(doc_id, text):
    text = text or ""
    h = sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


@given(st.integers(-(2**40), 2**40), st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("<PSM>"))))
def test_one_text(doc_id, text):
    *rest, out = middle.rearranged(doc_id, text.encode())
    assert (*rest, out.decode()) == plain(doc_id, text)


@given(st.binary(max_size=60))
def test_bytes_that_are_no_text_are_kept(raw):
    n, form, a, b, out = middle.rearranged(11, raw)
    assert n <= len(raw) and sorted(out) == sorted(raw + (b"" if form == "plain" else b"<P><S><M>"))


@given(st.integers(1, 2**300), st.data())
def test_ranked_bit(mask, data):
    places = [i for i in range(mask.bit_length()) if mask >> i & 1]
    k = data.draw(st.integers(0, len(places) - 1))
    assert middle.ranked_bit(mask, k) == places[k]


def corpus():
    rng = random.Random(5)
    docs = [(None, "an id that is not there"), (1, None), (2, ""), (3, "<P"), (4, "with <S> in it"), (5, "<<S<P<M"), (5, "<<S<P<M"), (6, "é"), (7, "\x00\n"), (8, "𝒳" * 400_000)]
    return docs + [(i, "".join(rng.choice("ab <>PSM\né漢😀\r") for _ in range(rng.randint(0, 90)))) for i in range(10, 400)]


def test_rows_forms_and_restored_texts(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, output string, n int")
    key = lambda r: (r[0] if r[0] is not None else -1, *map(str, r[1:]))
    hexed = lambda x: sha256(x.encode()).hexdigest()
    want = [(i, *plain(i, t)[:4], hexed(plain(i, t)[4]), hexed(t or "")) for i, t in docs]
    assert sorted(map(tuple, middle.query(df).collect()), key=key) == sorted(want, key=key)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    outputs = middle.transformed(df).collect()
    assert sorted((str(r.doc_id), bytes(r.output).decode()) for r in outputs) == sorted((str(i), plain(i, t)[4]) for i, t in docs)


def test_no_rows(spark):
    assert middle.query(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    got = middle.query(spark.read.parquet(f"{sf}/documents.parquet"))
    names = sorted(got.columns)
    cur = con.execute(f"SELECT {', '.join(names)} FROM ({ORACLES['op12_middle']})")
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, cur.fetchall()))
