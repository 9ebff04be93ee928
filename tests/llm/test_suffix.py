"""Suffix arrays and common prefixes against sorting."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from glossa.llm import suffix


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.binary(max_size=80), st.text("ab", max_size=120).map(str.encode), st.text("abc ", min_size=1, max_size=9).map(lambda x: x.encode() * 9)))
def test_arrays_and_prefixes(data):
    s = np.frombuffer(data, np.uint8)
    want = sorted(range(len(data)), key=lambda i: data[i:])
    got = suffix.suffix_array(s)
    assert got.tolist() == want
    shared = suffix.permuted_prefixes(s, got, 100)
    for p, q in zip(want, want[1:]):
        k = 0
        while k < 100 and max(p, q) + k < len(data) and data[p + k] == data[q + k]:
            k += 1
        assert shared[q] == k
