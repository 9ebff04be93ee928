"""Packing against the tokenizers library and against the rules of a packing."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from glossa.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
TEXTS = [None, "", "a", "Straße  und\tmehr\r\n\n  x", "word " * 3000, "z" * 5000, "<|endoftext|> inside <|endoftext|>", "it's we'll 123 — ¡olé! 日本語    x", "word " * 3000]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_those_of_the_tokenizers_library(text):
    assert packing.encoder(PATH).encode(text, allowed_special="all", disallowed_special=()) == TOKENIZER.encode(text, add_special_tokens=False).ids


def check(rows, docs, capacity=1024):
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    for doc_id, text in docs:
        ids = np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted(by_doc.pop(doc_id), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert r.length == capacity or r.piece == 0
            at += r.length
        assert at == len(ids)
    assert not by_doc
    return len(by_seq)


def test_every_piece_is_placed_once_without_gaps(spark):
    docs = list(enumerate(TEXTS))
    df = spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id long, text string, length int")
    check(packing.query(df, PATH).collect(), docs)


def test_empty_table(spark):
    assert packing.query(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_plans_hold_the_histogram_and_come_near_the_least():
    rng = np.random.default_rng(3)
    for n in (50, 2000, 60000):
        lengths = np.minimum(1024, np.maximum(1, rng.lognormal(6, 1, n).astype(int)))
        histogram = {int(a): int(b) for a, b in zip(*np.unique(lengths, return_counts=True), strict=True)}
        total = defaultdict(int)
        sequences = 0
        for pattern, times in packing.plan(histogram):
            assert sum(a * b for a, b in pattern) <= 1024
            sequences += times
            for a, b in pattern:
                total[a] += b * times
        assert dict(total) == histogram
        assert sequences <= max(-(-int(lengths.sum()) // 1024), int((lengths > 512).sum())) * 1.005 + 3


def least_sequences(items, capacity):
    """The least number of sequences, by depth-first search."""
    items, best = sorted(items, reverse=True), len(items)

    def search(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(items):
            best = len(rooms)
            return
        for room in sorted(set(rooms)):
            if room >= items[k]:
                rest = list(rooms)
                rest[rest.index(room)] -= items[k]
                search(k + 1, rest)
        search(k + 1, [*rooms, capacity - items[k]])

    search(0, [])
    return best


def test_small_plans_against_the_optimum():
    rng = np.random.default_rng(6)
    for _ in range(25):
        items = rng.integers(5, 60, rng.integers(1, 11)).tolist()
        histogram = {int(a): int(b) for a, b in zip(*np.unique(items, return_counts=True), strict=True)}
        assert sum(t for _, t in packing.plan(histogram, capacity=64)) <= least_sequences(items, 64) + 1


def test_the_program_is_solved_at_every_size(monkeypatch):
    calls = []
    solve = packing.covering
    monkeypatch.setattr(packing, "covering", lambda *a: calls.append(1) or solve(*a))
    rng = np.random.default_rng(2)
    for n in (1, 7, 1507, 4096, 4097):
        lengths = rng.integers(1, 1024, n)
        packing.plan({int(a): int(b) for a, b in zip(*np.unique(lengths, return_counts=True), strict=True)})
        assert calls
        calls.clear()


def test_never_more_sequences_than_largest_first_alone():
    rng = np.random.default_rng(5)
    for n, times in ((300, 1), (3000, 1), (3000, 100)):
        lengths = np.minimum(1023, np.maximum(2, rng.lognormal(6.3, 0.6, n).astype(int)))
        histogram = {int(a): int(b) * times for a, b in zip(*np.unique(lengths, return_counts=True), strict=True)}
        alone = sum(t for _, t in packing.filled(sorted(histogram), dict(histogram), 1024))
        assert sum(t for _, t in packing.plan(histogram)) <= alone
