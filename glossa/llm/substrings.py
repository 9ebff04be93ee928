"""Exact removal of long substrings that occur earlier, by suffix arrays of shards.

Every window of `length` bytes has an anchor, the leftmost of its k-byte strings with the least hash. Windows in
a row with the same anchor form a segment; equal windows have equal anchors, so they can only be found under the same
anchor hash. The job has four exchanges, and none of them moves a text more than once:

1. Segments go by anchor hash, as packed numbers without text. Equal segments are interned: the earliest one
   stands for all, and the windows of the others are repeats of it. An anchor with a single distinct segment is done.
2. The distinct segments of the other anchors fetch their bytes. Each is cut in two, so that all windows of a half hold
   the anchor and the bytes beside it, and the halves go to shards by the hash of those.
3. Each shard joins its halves into one text, induces its suffix array, and reads off the permuted common prefixes
   which windows are equal; all but the earliest of a kind are repeats.
4. Repeats and texts meet by document; their union is cut out.

Rows between exchanges are packed blocks of numbers, sized by the input: there are as many buckets as the text has blocks
of a fixed size, so a task's memory does not grow with the table. Copies inside a task's block are interned before the
first exchange, so a string that a third of all documents share sends one segment a block.

Positions are compared as (doc_id, start). Cases: null texts are empty; a null id comes before all others; rows that share an id
are ordered by the CRC-32 of their texts, and equal rows stand at the same place, so neither repeats the other; texts
shorter than `length` have no windows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .suffix import permuted_prefixes, suffix_array
from .vector import ARROW_ROWS, U, groups, mix, prefix_hash, range_hash

LENGTH = 100
GRAM = 32
SIDE = 34
GROUP = 1 << 20
#: Texts longer than this are cut into overlapping parts; positions in a part have 24 bits.
PART = 8 << 20
TASK_BLOCK, DOC_BLOCK, RUN_BLOCK, SHARD = 24 << 20, 6 << 20, 12 << 20, 2 << 20
NULL_ID = -(1 << 63)

#: Columns of packed blocks.
RUNS = [("v", "<i8"), ("rh", "<i8"), ("doc", "<i8"), ("tag", "<u4"), ("start", "<i8"), ("n", "u1"), ("off", "u1")]
SPANS = [("doc", "<i8"), ("tag", "<u4"), ("start", "<i8"), ("n", "<i4")]
ASKED = [("doc", "<i8"), ("tag", "<u4"), ("start", "<i8"), ("n", "u1"), ("off", "u1")]
HALVES = [("key", "<i8"), ("doc", "<i8"), ("tag", "<u4"), ("start", "<i8"), ("n", "u1")]

Table = dict[str, np.ndarray]


def pack(table: Table, spec: list[tuple[str, str]]) -> bytes:
    """The columns one after the other, each by byte planes, which compress well."""
    return b"".join(np.ascontiguousarray(np.ascontiguousarray(table[c], t).view(np.uint8).reshape(-1, np.dtype(t).itemsize).T).tobytes() for c, t in spec)


def unpack(blocks: list[tuple[int, bytes]], spec: list[tuple[str, str]]) -> Table:
    parts: dict[str, list[np.ndarray]] = {c: [] for c, _ in spec}
    for n, data in blocks:
        at = 0
        for c, t in spec:
            w = np.dtype(t).itemsize
            parts[c].append(np.ascontiguousarray(np.frombuffer(data, np.uint8, n * w, at).reshape(w, n).T).view(t).ravel())
            at += n * w
    return {c: np.concatenate(parts[c]) if parts[c] else np.empty(0, t) for c, t in spec}


def by_bucket(table: Table, spec, bucket: np.ndarray, kind: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Rows (bucket, kind, n, data): the table dealt to buckets."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    sorted_ = {c: table[c][order] for c, _ in spec}
    at, first = np.unique(bucket[order], return_index=True)
    for b, i, j in zip(at.tolist(), first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
        yield b, kind, j - i, pack({c: x[i:j] for c, x in sorted_.items()}, spec)


SCHEMA = "bucket long, kind int, n long, data binary"
NAMES = ["bucket", "kind", "n", "data"]


def _batches(rows: Iterator[tuple[int, int, int, bytes]], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=NAMES)

    for row in rows:
        held.append(row)
        size += len(row[3])
        if size > most:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _table(rows: Iterator[tuple[int, int, int, bytes]]) -> pa.Table:
    return pa.Table.from_batches(_batches(rows), schema=pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("n", pa.int64()), ("data", pa.binary())]))


def _blocks(table: pa.Table, kind: int) -> list[tuple[int, bytes]]:
    return [(n, d) for k, n, d in zip(*(table.column(c).to_pylist() for c in ("kind", "n", "data")), strict=True) if k == kind]


def segments(texts: list[bytes]) -> Table:
    """The segments of some texts: anchor hash `v`, content hash `rh`, text number, start, windows `n`, anchor's offset."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    offset = np.cumsum(size) - size
    none = {c: np.empty(0, np.int64) for c in ("v", "rh", "doc", "start", "n", "off")}
    if len(data) < LENGTH:
        return none
    prefix = prefix_hash(data)
    gram = np.arange(len(data) - GRAM + 1)
    h = range_hash(prefix, gram, gram + GRAM)
    low = U((1 << 24) - 1)
    c = (h & ~low) | gram.astype(U)
    m, have, want = c, 1, LENGTH - GRAM + 1
    while 2 * have <= want:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    m = np.minimum(m[: len(m) - (want - have)], m[want - have :])
    doc = np.repeat(np.arange(len(texts)), size)[: len(m)]
    at = np.arange(len(m))
    valid = at + LENGTH <= (offset + size)[doc]
    edge = np.concatenate(([True], (m[1:] != m[:-1]) | (doc[1:] != doc[:-1]) | (valid[1:] != valid[:-1])))
    first = np.flatnonzero(edge)
    last = np.concatenate((first[1:], [len(m)]))
    good = valid[first]
    first, last = first[good], last[good]
    anchor = (m[first] & low).astype(np.int64)
    return {"v": h[anchor].astype(np.int64), "rh": range_hash(prefix, first, last - 1 + LENGTH).astype(np.int64), "doc": doc[first], "start": first - offset[doc[first]], "n": last - first, "off": anchor - first}


def parts(ids: np.ndarray, tags: np.ndarray, texts: list[bytes]) -> Iterator[tuple[int, int, int, bytes]]:
    """(doc, tag, base, bytes): long texts in parts that overlap by less than a window."""
    for i, t, x in zip(ids.tolist(), tags.tolist(), texts, strict=True):
        for base in range(0, max(1, len(x) - LENGTH + 1), PART):
            yield i, t, base, x[base : base + PART + LENGTH - 1]


def interned(runs: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, earliest, repeat): runs sorted by anchor, content and place; the first of each content; those that stand later than it."""
    order = np.lexsort((runs["start"], runs["tag"], runs["doc"], runs["rh"], runs["v"]))
    v, rh = runs["v"][order], runs["rh"][order]
    new = np.concatenate(([True], (v[1:] != v[:-1]) | (rh[1:] != rh[:-1])))[: len(order)]
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) if len(order) else order
    same = np.ones(len(order), bool)
    for c in ("doc", "tag", "start"):
        x = runs[c][order]
        same &= x == x[head]
    return order, new, ~same


def _windows(runs: Table, at: np.ndarray) -> Table:
    return {c: runs[c][at].astype(t) for c, t in SPANS}


def _doc_bucket(table: Table, deal: int) -> np.ndarray:
    return (mix(table["doc"].astype(np.int64).view(U)) % U(deal)).astype(np.int64)


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    ids = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
    tags = batch.column("tag").to_numpy(zero_copy_only=False).astype(np.uint32)
    return ids, tags, [(x or "").encode("utf-8", "surrogatepass") for x in batch.column("_text").to_pylist()]


def run_blocks(docs: DataFrame, deal: int) -> DataFrame:
    """Exchange 1's rows: kind 0, segments by anchor hash; kind 1, repeats that a task's block shows already."""

    def settle(held: list[Table]) -> Iterator[tuple[int, int, int, bytes]]:
        runs = {c: np.concatenate([x[c] for x in held]) for c, _ in RUNS}
        order, new, repeat = interned(runs)
        keep = order[~repeat]
        kept = {c: runs[c][keep] for c, _ in RUNS}
        yield from by_bucket(kept, RUNS, (mix(kept["v"].astype(np.int64).view(U)) % U(deal)).astype(np.int64), 0)
        spans = _windows(runs, order[repeat])
        yield from by_bucket(spans, SPANS, _doc_bucket(spans, deal), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            whole = list(parts(*_texts(batch)))
            raw = [x[3] for x in whole]
            ids, tags, bases = (np.array([x[k] for x in whole], t) for k, t in ((0, np.int64), (1, np.uint32), (2, np.int64)))
            for a, b in groups(raw, GROUP):
                found = segments(raw[a:b])
                own = found["doc"] + a
                held.append(found | {"doc": ids[own], "tag": tags[own], "start": found["start"] + bases[own]})
                size += sum(map(len, raw[a:b]))
                if size > TASK_BLOCK:
                    yield from _batches(settle(held))
                    held, size = [], 0
        if held:
            yield from _batches(settle(held))

    return docs.mapInArrow(run, SCHEMA)


def doc_blocks(docs: DataFrame, deal: int) -> DataFrame:
    """Texts by document bucket, compressed: kind 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)

        def rows(ids, tags, texts):
            bucket = _doc_bucket({"doc": ids}, deal)
            for b in np.unique(bucket).tolist():
                at = np.flatnonzero(bucket == b)
                own = {"doc": ids[at], "tag": tags[at], "size": np.array([len(texts[i]) for i in at], np.int64)}
                yield b, 0, len(at), pack(own, [("doc", "<i8"), ("tag", "<u4"), ("size", "<i8")]) + squeeze.compress(b"".join(texts[i] for i in at))

        for batch in batches:
            if batch.num_rows:
                yield from _batches(rows(*_texts(batch)))

    return docs.mapInArrow(run, SCHEMA)


def _documents(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Ids, tags and texts of a group's kind 0, by place."""
    spec = [("doc", "<i8"), ("tag", "<u4"), ("size", "<i8")]
    ids, tags, texts = [], [], []
    for n, data in _blocks(table, 0):
        head = unpack([(n, data)], spec)
        text = zstandard.ZstdDecompressor().decompress(data[n * 20 :], max_output_size=max(1, int(head["size"].sum())))
        end = np.cumsum(head["size"])
        ids.append(head["doc"])
        tags.append(head["tag"])
        texts += [text[e - s : e] for s, e in zip(head["size"].tolist(), end.tolist(), strict=True)]
    i, t = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (ids, tags))
    order = np.lexsort((t, i))
    return i[order], t[order], [texts[k] for k in order.tolist()]


def _place(ids: np.ndarray, tags: np.ndarray, doc: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """The first place of (doc, tag) among sorted (ids, tags)."""
    if len(ids) and (ids[1:] != ids[:-1]).all():
        return np.searchsorted(ids, doc)
    at: dict[tuple[int, int], int] = {}
    for k, x in enumerate(zip(ids.tolist(), tags.tolist(), strict=True)):
        at.setdefault(x, k)
    return np.fromiter((at[x] for x in zip(doc.tolist(), tag.tolist(), strict=True)), np.int64, len(doc))


def settled(runs: DataFrame, deal: int) -> DataFrame:
    """After exchange 1, by document bucket: repeats (kind 1), and the distinct segments of anchors that have several (kind 2)."""

    def run(table: pa.Table) -> pa.Table:
        runs = unpack(_blocks(table, 0), RUNS)
        order, new, repeat = interned(runs)
        v = runs["v"][order]
        of = np.cumsum(np.concatenate(([True], v[1:] != v[:-1]))[: len(v)]) - 1
        asked = order[new & (np.bincount(of, weights=new)[of] > 1)]
        known = unpack(_blocks(table, 1), SPANS)
        found = _windows(runs, order[repeat])
        spans = {c: np.concatenate((known[c], found[c])) for c, _ in SPANS}
        want = {c: runs[c][asked] for c, _ in ASKED}

        def rows():
            yield from by_bucket(spans, SPANS, _doc_bucket(spans, deal), 1)
            yield from by_bucket(want, ASKED, _doc_bucket(want, deal), 2)

        return _table(rows())

    return runs.groupBy("bucket").applyInArrow(run, SCHEMA)


def halves(both: DataFrame, deal: int) -> DataFrame:
    """After exchange 2, by shard: halves of segments with their bytes (kind 0)."""

    def run(table: pa.Table) -> pa.Table:
        asked = unpack(_blocks(table, 2), ASKED)
        if not len(asked["doc"]):
            return _table(iter(()))
        ids, tags, texts = _documents(table)
        at = _place(ids, tags, asked["doc"], asked["tag"])
        out: dict[str, list] = {c: [] for c, _ in HALVES}
        data: list[bytes] = []
        lut_rows = zip(at.tolist(), asked["doc"].tolist(), asked["tag"].tolist(), asked["start"].tolist(), asked["n"].tolist(), asked["off"].tolist(), strict=True)
        grams: list[bytes] = []
        for k, doc, tag, start, n, off in lut_rows:
            text, anchor = texts[k], start + off
            split = min(n, max(0, off - SIDE))  # windows before it have more than SIDE bytes left of the anchor
            for lo, hi, gram in ((0, split, anchor - SIDE), (split, n, anchor)):
                if hi > lo:
                    for c, x in zip(("doc", "tag", "start", "n"), (doc, tag, start + lo, hi - lo), strict=True):
                        out[c].append(x)
                    data.append(text[start + lo : start + hi - 1 + LENGTH])
                    grams.append(text[gram : gram + GRAM + SIDE])
        joined = np.frombuffer(b"".join(grams), np.uint8)
        first = np.arange(len(grams)) * (GRAM + SIDE)
        key = range_hash(prefix_hash(joined), first, first + GRAM + SIDE).astype(np.int64)
        table_ = {"key": key} | {c: np.array(x, np.int64) for c, x in out.items() if c != "key"}
        bucket = (mix(key.view(U)) % U(deal)).astype(np.int64)

        def rows():
            order = np.argsort(bucket, kind="stable")
            for b, own in zip(*_split(bucket[order], order), strict=True):
                yield b, 0, len(own), pack({c: table_[c][own] for c, _ in HALVES}, HALVES) + b"".join(data[i] for i in own.tolist())

        return _table(rows())

    return both.groupBy("bucket").applyInArrow(run, SCHEMA)


def _split(sorted_: np.ndarray, order: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    at, first = np.unique(sorted_, return_index=True)
    return at.tolist(), np.split(order, first[1:]) if len(at) else []


def repeats(table: Table, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(half, window) of each window of a shard's joined halves that an earlier equal one repeats; `first`: where halves start in `data`."""
    array = suffix_array(data, LENGTH + 4)
    boundary = permuted_prefixes(data, array, LENGTH)[array] < LENGTH
    kind = np.cumsum(boundary)
    half = np.full(len(data), -1, np.int64)
    n = table["n"].astype(np.int64)
    windows = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    owner = np.repeat(np.arange(len(n)), n)
    half[first[owner] + windows] = owner
    own = half[array]
    kind, own, at = kind[own >= 0], own[own >= 0], array[own >= 0]
    window = at - first[own]
    place = np.lexsort((table["start"], table["tag"], table["doc"]))
    rank = np.empty(len(place), np.int64)
    doc, tag = table["doc"][place], table["tag"][place]
    changed = np.concatenate(([True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])))
    rank[place] = np.cumsum(changed)
    key = rank[own] << 40 | (table["start"][own] + window)
    edge = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
    least = np.repeat(np.minimum.reduceat(key, edge), np.diff(np.concatenate((edge, [len(key)]))))
    again = key > least
    return own[again], window[again]


def sorted_shards(blocks: DataFrame, deal: int) -> DataFrame:
    """After exchange 3, by document bucket: repeats (kind 1) that the shards' suffix arrays show."""

    def run(table: pa.Table) -> pa.Table:
        heads, data = [], []
        for n, raw in _blocks(table, 0):
            heads.append((n, raw))
            data.append(raw[n * 29 :])
        all_ = unpack(heads, HALVES)
        size = all_["n"].astype(np.int64) + LENGTH - 1
        end = np.cumsum(size)
        text = np.frombuffer(b"".join(data), np.uint8)
        _, of, count = np.unique(all_["key"], return_inverse=True, return_counts=True)
        shared = np.flatnonzero(count[of] > 1)
        shared = shared[np.argsort(of[shared], kind="stable")]
        found: list[Table] = []
        at = 0
        while at < len(shared):  # halves with one key stay together; the rest of a shard may be sorted apart
            stop = int(np.searchsorted(np.cumsum(size[shared[at:]]), SHARD)) + at + 1
            while stop < len(shared) and of[shared[stop]] == of[shared[stop - 1]]:
                stop += 1
            own = shared[at:stop]
            part = {c: x[own] for c, x in all_.items()}
            joined = np.concatenate([text[end[i] - size[i] : end[i]] for i in own.tolist()])
            half, window = repeats(part, joined, np.cumsum(size[own]) - size[own])
            order = np.lexsort((window, half))
            half, window = half[order], window[order]
            new = np.concatenate(([True], (half[1:] != half[:-1]) | (window[1:] != window[:-1] + 1)))[: len(half)]
            first = np.flatnonzero(new)
            runs = np.diff(np.concatenate((first, [len(half)])))
            found.append({"doc": part["doc"][half[first]], "tag": part["tag"][half[first]], "start": part["start"][half[first]] + window[first], "n": runs})
            at = stop
        spans = {c: np.concatenate([x[c] for x in found]) if found else np.empty(0, np.int64) for c, _ in SPANS}
        return _table(by_bucket(spans, SPANS, _doc_bucket(spans, deal), 1))

    return blocks.groupBy("bucket").applyInArrow(run, SCHEMA)


def cut_out(both: DataFrame) -> DataFrame:
    """After exchange 4: each document with its removed spans and the bytes that are left."""
    schema = "doc_id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary"
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(table: pa.Table) -> pa.Table:
        ids, tags, texts = _documents(table)
        spans = unpack(_blocks(table, 1), SPANS)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        offset = np.cumsum(size) - size
        place = _place(ids, tags, spans["doc"], spans["tag"]) if len(spans["doc"]) else np.empty(0, np.int64)
        start = offset[place] + spans["start"]
        end = start + spans["n"] + LENGTH - 1
        order = np.argsort(start)
        start, end, place = start[order], end[order], place[order]
        reach = np.maximum.accumulate(end) if len(end) else end
        new = np.concatenate(([True], (start[1:] > reach[:-1]) | (place[1:] != place[:-1])))[: len(start)]
        first = np.flatnonzero(new)
        last = reach[np.concatenate((first[1:], [len(start)])) - 1] if len(first) else first
        of: dict[int, list[tuple[int, int]]] = {}
        for p, a, b in zip(place[first].tolist(), start[first].tolist(), last.tolist(), strict=True):
            of.setdefault(p, []).append((a - int(offset[p]), b - int(offset[p])))
        cols: tuple[list, ...] = ([], [], [], [])
        leader = 0
        for k, text in enumerate(texts):
            if not (k and ids[k] == ids[leader] and tags[k] == tags[leader]):
                leader = k  # equal rows share the spans of the first
            own, at, kept = of.get(leader, []), 0, []
            for a, b in own:
                kept.append(text[at:a])
                at = b
            kept.append(text[at:])
            for c, x in zip(cols, (None if ids[k] == NULL_ID else int(ids[k]), len(text), [{"start": a, "end": b} for a, b in own], b"".join(kept)), strict=True):
                c.append(x)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), span, pa.binary()), strict=True)], names=["doc_id", "n_bytes", "spans", "kept"])

    return both.groupBy("bucket").applyInArrow(run, schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row: the maximal removed spans and the bytes that stay."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.col("text").cast("string").alias("_text"))
    total = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    shared_ids = written(rows.groupBy("id").count().where("count > 1").select("id"), "shared-ids")
    if shared_ids.isEmpty():
        rows = rows.withColumn("tag", F.lit(0).cast("long"))
    else:
        twice = shared_ids.withColumn("twice", F.lit(True))
        rows = rows.join(twice, "id", "left").select("id", "_text", F.when(F.col("twice"), F.crc32(F.coalesce("_text", F.lit("")).cast("binary"))).otherwise(0).cast("long").alias("tag"))
    docs_deal, runs_deal = total // DOC_BLOCK + 4, total // RUN_BLOCK + 4

    known = written(settled(run_blocks(rows, runs_deal), docs_deal), "segments")
    asked = known.where("kind = 2").agg(F.sum("n")).first()[0] or 0
    found = known.where("kind = 1")
    if asked:
        texts = doc_blocks(rows, docs_deal)
        blocks = halves(texts.unionByName(known.where("kind = 2")), asked * 2 * LENGTH // (4 * SHARD) + 4)
        found = found.unionByName(written(sorted_shards(blocks, docs_deal), "repeats"))
    return cut_out(doc_blocks(rows, docs_deal).unionByName(found))


def query(docs: DataFrame) -> DataFrame:
    rows = without_repeats(docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
