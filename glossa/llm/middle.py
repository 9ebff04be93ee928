"""Fill-in-the-middle: texts cut in three and put together again with marks, by bit-parallel arithmetic on big integers.

A text's UTF-8 bytes become one integer with a bit a byte: `bytes.translate` maps a class of bytes to ones and the rest to zeros, and the digits
are read in base two. Shifted boolean operations on these masks mark the last byte of every code point, `bit_count` gives their number, and
the bit of a given rank is found by halving: each step counts the lower half and goes on in the half that holds it.

How a text is cut and which form it gets follows from its id alone (a SHA-256 of a salt and the id), so reruns and retried tasks agree.

Cases: a null text is empty; an empty text, one that holds a mark and the share that the rates leave are `plain`, with null lengths. A null id counts as
the empty word. Texts are bytes to this operator: bytes that no code point begins belong to the code point before them, or to the first. Rows that
repeat are cut alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Texts of a hundred that are transformed, and of those transformed that begin with the suffix.
RATE, SUFFIX_FIRST = 90, 20
#: Of bytes: those that go on with a code point, as ones.
_GOES_ON = bytes(49 if 0x80 <= b < 0xC0 else 48 for b in range(256))


def unit_ends(text: bytes) -> int:
    """A bit for each byte that ends a code point, the first byte's lowest."""
    if not text:
        return 0
    goes_on = int(text[::-1].translate(_GOES_ON), 2)
    top = 1 << (len(text) - 1)
    begins = (top << 1) - 1 & ~goes_on & ~1  # but for the first byte, which needs none before it
    return begins >> 1 | top


def ranked_bit(mask: int, rank: int) -> int:
    """The place of the bit with `rank` lower ones below it, by halving."""
    at, width = 0, mask.bit_length()
    while width > 1:
        half = width >> 1
        low = mask & (1 << half) - 1
        below = low.bit_count()
        if rank < below:
            mask, width = low, half
        else:
            mask, width, at, rank = mask >> half, width - half, at + half, rank - below
    return at


def draws(doc_id: object, salt: str) -> tuple[int, int, int, int]:
    """Four numbers below 2**32 of an id."""
    h = sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(h[k : k + 8], 16) for k in range(0, 32, 8))  # type: ignore[return-value]


def rearranged(doc_id: object, text: bytes, salt: str = "1", rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, bytes]:
    """(code points, form, prefix's and middle's code points, output) of a text."""
    ends = unit_ends(text)
    n = ends.bit_count()
    h1, h2, h3, h4 = draws(doc_id, salt)
    marks = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if not text or h3 % 100 >= rate or any(m in text for m in marks):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    cut = [ranked_bit(ends, k - 1) + 1 if k else 0 for k in (a, b)]
    prefix, middle, suffix = text[: cut[0]], text[cut[0] : cut[1]], text[cut[1] :]
    p, s, m = marks
    if h4 % 100 < suffix_first:
        return n, "spm", a, b - a, s + suffix + p + prefix + m + middle
    return n, "psm", a, b - a, p + prefix + s + suffix + m + middle


SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output binary"


def transformed(docs: DataFrame, salt: str = "1", rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): every row's text in its form, as UTF-8."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            # A few MB of text at a time: neither the number of rows in a batch nor their lengths are bounded by it.
            at, size, out = 0, 0, []
            for i, d in enumerate(ids):
                text = batch.column("_text")[i].as_py()
                out.append(rearranged(d, text, salt, rate, suffix_first))
                size += len(text)
                if size > 4_000_000 or i + 1 == len(ids):
                    n, form, prefix, middle, output = zip(*out, strict=True)
                    cols = [pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary())]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(out)), *cols], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
                    at, size, out = i + 1, 0, []

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def restored(output: Column | str, form: Column | str) -> Column:
    """The text of an output and its form: the parts between the marks, none of which the text itself may hold."""
    output, form = (F.col(x) if isinstance(x, str) else x for x in (output, form))
    parts = F.split(output.cast("string"), "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    part = lambda k: F.get(parts, F.lit(k))
    return (
        F.when(form == "psm", F.concat(part(1), part(3), part(2)).cast("binary"))
        .when(form == "spm", F.concat(part(2), part(3), part(1)).cast("binary"))
        .otherwise(output.cast("binary"))
    )


def query(docs: DataFrame) -> DataFrame:
    rows = transformed(docs)
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restored("output", "form"), 256).alias("restored_sha256")]
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)
