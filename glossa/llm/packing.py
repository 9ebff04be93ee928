"""Packing documents into sequences: a configuration linear program over the histogram of piece lengths.

Documents become token ids; longer ones than a sequence are cut from the end, so that only the first piece is
shorter. Which pieces share a sequence depends on lengths alone, so the driver plans with the histogram (as many rows as a
sequence has tokens, whatever the data's size). Multiplicative weights solve the program "fewest patterns that cover
all lengths": each round a knapsack table prices the best patterns for the current weights, and lengths that are covered
already lose weight. The averaged solution is rounded down, and the rest is solved anew, at every size. Where all weights are below one, the
solution's full patterns count once each, heaviest first, if that takes fewer sequences than none of them. What rounding leaves is packed largest first, each sequence filled as far as lengths allow.
The plan is compared with largest first alone and the shorter one is taken: on the tables at hand that is largest first, within 0.25 percent of the bound by volume, an accuracy that
multiplicative weights reach only after some hundred thousand rounds. Pieces then find their place by their
rank among pieces of their length.

Cases: null and empty texts are the end mark alone; null or repeated ids and repeated rows are pieces of their own; an
empty table gives no rows; other columns are ignored; a text of any length is cut by one task.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .vector import ARROW_ROWS

CAPACITY = 1024
END = 2
#: Copies of the weights that learn side by side, and rounds of each.
REPLICAS, ROUNDS = 16, 24
#: So often the program is solved for what rounding left. Patterns that leave a larger part of a sequence empty wait for another solution.
PLANS, WASTE = 6, 1 / 128


def _stands(spec: dict, path: str) -> None:
    """Raise if a tokenizers file is not of the kind that `encoder` runs: byte-level BPE, its common split, no normalizer, ids in merge order."""
    before, model = spec["pre_tokenizer"], spec["model"]
    bare = before["type"] == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not spec.get("normalizer")
    plain = model["type"] == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix") and not model.get("ignore_merges")
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [model["vocab"][a + b] for a, b in pairs]
    if not (bare and plain and ids == sorted(ids)):
        raise ValueError(f"not a plain byte-level BPE with ids in merge order: {path}")


@lru_cache(maxsize=2)
def encoder(path: str):
    """The byte-level BPE of a tokenizers file, run by tiktoken's faster core: in such a file ids follow merge order."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(visible))}
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    _stands(spec, path)
    split = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding(base64.b16encode(path.encode()).decode(), pat_str=split, mergeable_ranks=ranks, special_tokens=special)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all full but the first."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            row, cols = [], ([], [], [], [])
            for i, text in enumerate(batch.column("_text").to_pylist()):
                ids = np.array([*encode(text or "", allowed_special="all", disallowed_special=()), end], "<u4")
                for k, (start, n) in enumerate(cut(len(ids), capacity)):
                    row.append(i)
                    for c, v in zip(cols, (k, start, n, zlib.crc32(ids[start : start + n].tobytes())), strict=True):
                        c.append(v)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), *map(pa.array, cols, kinds)], names=names)

    rows = docs.select("doc_id", F.col("text").cast("string").alias("_text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


Pattern = tuple[tuple[int, int], ...]


def priced(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> list[dict[int, int]]:
    """For each row of prices the pattern of highest price, by a knapsack table over the capacity; as counts by position in `lengths` (descending)."""
    k = len(prices)
    best = np.zeros((k, capacity + 1))
    took = np.full((k, capacity + 1), -1, np.int32)
    rows = np.arange(k)
    for c in range(1, capacity + 1):
        best[:, c] = best[:, c - 1]
        i = int(np.searchsorted(-lengths, -c))
        if i < len(lengths):
            value = best[:, c - lengths[i:]] + prices[:, i:]
            j = value.argmax(axis=1)
            top = value[rows, j]
            better = top > best[:, c] + 1e-12
            best[better, c] = top[better]
            took[better, c] = i + j[better]
    found = []
    for r in range(k):
        pattern: dict[int, int] = {}
        c = capacity
        while c > 0:
            if (j := int(took[r, c])) < 0:
                c -= 1
            else:
                pattern[j] = pattern.get(j, 0) + 1
                c -= int(lengths[j])
        found.append(pattern)
    return found


def covering(lengths: np.ndarray, counts: np.ndarray, capacity: int, rng: np.random.Generator) -> list[tuple[dict[int, int], float]]:
    """A fractional solution of the configuration program by multiplicative weights: patterns and how often each."""
    prices = np.tile(lengths / capacity, (REPLICAS, 1)) * rng.uniform(0.97, 1.03, (REPLICAS, len(lengths)))
    covered = np.zeros((REPLICAS, len(lengths)))
    used: list[tuple[dict[int, int], int, float]] = []
    for _ in range(ROUNDS):
        for r, pattern in enumerate(priced(prices, lengths, capacity)):
            at, n = np.fromiter(pattern, int), np.fromiter(pattern.values(), float)
            step = float((counts[at] / n).min())
            used.append((pattern, r, step))
            covered[r, at] += step * n / counts[at]
            prices[r, at] *= np.exp(-0.25 * step * n / counts[at])
    scale = 1 / np.maximum(1, covered.max(axis=1)) / REPLICAS
    return [(p, step * float(scale[r])) for p, r, step in used]


def filled(lengths: list[int], left: dict[int, int], capacity: int) -> Iterator[tuple[Pattern, int]]:
    """Largest first; each sequence is filled as far as the lengths that are left allow."""
    while left:
        big = max(left)
        stock = dict(left)
        stock[big] -= 1
        room, reach, steps = capacity - big, 1, []
        for n in sorted(stock, reverse=True):
            if n <= room:
                copies, k = min(stock[n], room // n), 1
                while copies > 0:
                    take = min(k, copies)
                    steps.append((n, take, reach))
                    reach |= (reach << (n * take)) & ((1 << (room + 1)) - 1)
                    copies, k = copies - take, 2 * k
                if reach >> room & 1:
                    break
        at, pattern = reach.bit_length() - 1, {big: 1}
        for n, take, before in reversed(steps):
            if not before >> at & 1:
                pattern[n] = pattern.get(n, 0) + take
                at -= n * take
        times = min(left[n] // c for n, c in pattern.items())
        for n, c in pattern.items():
            left[n] -= times * c
            if not left[n]:
                del left[n]
        yield tuple(sorted(pattern.items(), reverse=True)), times


def plan(histogram: dict[int, int], capacity: int = CAPACITY, seed: int = 1) -> list[tuple[Pattern, int]]:
    """Patterns (lengths and how many of each) with the number of sequences of each; together they hold the histogram exactly."""
    rng = np.random.default_rng(seed)
    left = {n: c for n, c in histogram.items() if c}
    out: list[tuple[Pattern, int]] = []
    if capacity in left:
        out.append((((capacity, 1),), left.pop(capacity)))
    filler = list(filled(sorted(left), dict(left), capacity))
    begun, solution = len(out), {}
    for _ in range(PLANS):
        if not left:
            break
        lengths = np.array(sorted(left, reverse=True))
        counts = np.array([left[int(n)] for n in lengths], float)
        solution = {}
        for pattern, weight in covering(lengths, counts, capacity, rng):
            named = tuple((int(lengths[j]), c) for j, c in sorted(pattern.items()))
            if capacity - sum(n * c for n, c in named) <= capacity * WASTE:
                solution[named] = solution.get(named, 0.0) + weight
        used, left = rounded(solution, left, 0)
        out += used
        if not used:
            break
    up, rest = rounded(solution, left, 1)
    ways = [list(filled(sorted(left), dict(left), capacity)), up + list(filled(sorted(rest), dict(rest), capacity))]
    ways = [out[begun:] + way for way in ways] + [filler]
    return out[:begun] + min(ways, key=lambda way: sum(times for _, times in way))


def rounded(solution: dict[Pattern, float], left: dict[int, int], least: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """The patterns by weight, heaviest first, each rounded down but `least` times at least, as far as the lengths in `left` allow; and what is left then."""
    left, out = dict(left), []
    for pattern, weight in sorted(solution.items(), key=lambda x: (-x[1], x[0])):
        times = min(max(least, int(weight)), *(left.get(n, 0) // c for n, c in pattern))
        if times > 0:
            out.append((pattern, times))
            for n, c in pattern:
                left[n] -= times * c
    return out, {n: c for n, c in left.items() if c}


def places(patterns: list[tuple[Pattern, int]]) -> dict[str, np.ndarray]:
    """Runs of ranks, by length: where pieces of a length and rank go. Sorted by key = length << 40 | first rank."""
    runs, ranks, sequence = [], {}, 0
    for pattern, times in patterns:
        offset = 0
        for n, c in pattern:
            runs.append((n << 40 | ranks.get(n, 0), c, sequence, offset))
            ranks[n] = ranks.get(n, 0) + c * times
            offset += n * c
        sequence += times
    table = np.array(sorted(runs), np.int64).reshape(-1, 4)
    return dict(zip(("key", "copies", "sequence", "offset"), table.T.copy(), strict=True))


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Every piece with its sequence and its place there."""
    spark = docs.sparkSession
    rows = written(pieces(docs, tokenizer, capacity, end), "pieces")
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = places(plan(histogram, capacity))
    deal = max(16, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("deal", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(deal)).cast("int"))
    before = Window.partitionBy("length").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("length", "deal").agg(F.count(F.lit(1)).alias("n")).select("length", "deal", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "deal").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("rank", F.row_number().over(own) - 1).join(bases, ["length", "deal"]).withColumn("rank", F.col("base") + F.col("rank"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(runs["key"], n << 40 | rank, side="right") - 1
            nth = rank - (runs["key"][at] & ((1 << 40) - 1))
            sequence = runs["sequence"][at] + nth // runs["copies"][at]
            offset = runs["offset"][at] + nth % runs["copies"][at] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    schema = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(run, schema)


def query(docs: DataFrame, tokenizer: str) -> DataFrame:
    return packed(docs, tokenizer)
