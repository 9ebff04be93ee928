"""Line dedup by a segment-partition edit join, in DataFrame and SQL functions alone.

A line goes where an earlier one (smaller doc_id, or the same document and smaller number) is equal, or differs by at most
EDITS edits while both have MIN_CHARS characters. Lines without a word stay and stand for nothing.

The join splits a line into EDITS + 1 even segments; of two lines within EDITS edits, one has a segment of the other
unchanged, and near its old place. Lines are indexed by (length, segment number, segment), and probe the index for
their own and shorter lengths at the few places where a segment can then be. Hashed keys are dealt once, without the lines' texts;
what they are dealt to finds the keys that two lines share, and the lines that hold those. A pair must then have letter
counts that so few edits allow, and is verified by bit-parallel edit distance over a band of 2 * EDITS + 1 diagonals, after
its common head and tail are stripped.

Only an equal or near line of smaller place matters, so exact copies are one line with its first place, summed before anything is
dealt: a line that a third of all documents hold is one row from the first sum on, and has its keys made once.

Cases: null texts have no lines; rows that share an id (or have none) share their places, so they do not repeat each
other at one line number; a null id comes first; an empty table gives no rows; a text of any length is one task's; other columns are
kept by `deduplicated` and ignored by the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, text_or_empty, written

EDITS = 2
MIN_CHARS = 24
#: What letter counts are taken of; an edit changes two of them by one at most.
LETTERS = [*"abcdefghijklmnopqrstuvwxyz", "0123456789", " ", ".,;:!?", "ABCDEFGHIJKLM", "NOPQRSTUVWXYZ"]


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, line_no, line, h1, h2) of every line with a word; h1 and h2 name the line."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split(text_or_empty(), "\n", -1)).alias("line_no", "line"))
    return lines.where(F.col("line").rlike(WORD)).withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit("2"), "line"))


def distinct_lines(docs: DataFrame) -> DataFrame:
    """(h1, h2, line, place, times) of every distinct line with a word; `place` is its first (doc_id, line_no)."""
    place = F.min(F.struct("doc_id", "line_no")).alias("place")
    return occurrences(docs).groupBy("h1", "h2").agg(F.first("line").alias("line"), place, F.count(F.lit(1)).alias("times"))


def keys(lines: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, key, probe): the index and probe keys of long lines. `probe` is false for a line's own segments."""
    parts = edits + 1
    specs = [
        (gap, i, shift, "true" if gap or shift else "false")
        for gap in range(parts)  # how much longer the probing line is than the indexed one
        for i in range(parts)
        for shift in range(max(-i, gap - (edits - i)), min(i, gap + edits - i) + 1)
    ]
    listed = ", ".join(f"named_struct('gap', {g}, 'i', {i}, 'shift', {d}, 'probe', {p})" for g, i, d, p in specs)
    # The places become rows first, so that one small expression over plain columns makes all keys, in compiled code.
    m = "(n - s.gap)"
    size = f"({m} div {parts} + if(s.i >= {parts} - {m} % {parts}, 1, 0))"
    at = f"(s.i * ({m} div {parts}) + greatest(0, s.i - {parts} + {m} % {parts}) + s.shift)"
    long = lines.select("h1", "line", F.char_length("line").alias("n")).where(F.col("n") >= min_chars)
    long = long.withColumn("flat", F.octet_length("line") == F.col("n"))  # then bytes are characters, and cutting them out needs no count
    rows = long.select("h1", "line", "n", "flat", F.explode(F.expr(f"array({listed})")).alias("s"))
    rows = rows.where(F.expr(f"{m} >= {min_chars} and {at} >= 0 and {at} + {size} <= n"))
    key = lambda text: f"xxhash64({m}, s.i, substring({text}, {at} + 1, {size}))"
    return rows.select("h1", F.expr(f"if(flat, {key('cast(line as binary)')}, {key('line')})").alias("key"), "s.probe")


def letter_counts(line: str = "line") -> Column:
    n = F.char_length(line)
    return F.array(*[(n - F.char_length(F.translate(line, x, ""))).cast("int") for x in LETTERS])


def _bound(value: str, name: str, body: str) -> str:
    """SQL's `let`: `body` with `name` standing for `value`."""
    return f"transform(array({value}), {name} -> {body})[0]"


def within_edits(a: str, b: str, edits: int = EDITS) -> Column:
    """Whether two lines (columns) are at most `edits` edits apart: the distance on a band, a column of it a step, in bits."""
    halves = "array(4096, 2048, 1024, 512, 256, 128, 64, 32, 16, 8, 4, 2, 1)"
    least = f"least(char_length({a}), char_length({b}))"
    # More than once each, so that common heads and tails longer than the steps together are stripped too.
    steps = f"concat(array_repeat(8192, cast({least} div 8192 as int)), {halves})"
    head = f"aggregate({steps}, 0, (k, s) -> if(k + s <= {least} and substring({a}, k + 1, s) = substring({b}, k + 1, s), k + s, k))"
    tail_of = lambda x: f"substring({x}, char_length({x}) - k - s + 1, s)"
    tail = f"aggregate({steps}, 0, (k, s) -> if(k + s <= {least} - head and {tail_of(a)} = {tail_of(b)}, k + s, k))"
    middle = lambda x: f"substring({x}, head + 1, char_length({x}) - head - tail)"
    full = (1 << (2 * edits + 1)) - 1
    equal = " | ".join(f"if(coalesce(get(p, j - {edits} + {k} - 1) = get(t, j - 1), false), {1 << k}, 0)" for k in range(2 * edits + 1))
    diagonal = _bound(
        equal,
        "x",
        _bound(
            f"((((x & s.vp) + s.vp) ^ s.vp) | x | s.vn) & {full}",
            "d0",
            _bound(
                f"(s.vn | ~(d0 | s.vp)) & {full}",
                "hp",
                _bound(
                    "d0 & s.vp",
                    "hn",
                    f"""named_struct(
                    'vp', (hn | ~(shiftright(d0, 1) | hp)) & {full},
                    'vn', shiftright(d0, 1) & hp,
                    'd', s.d + if(j + {edits} <= size(p), if((d0 & {1 << (2 * edits)}) = 0, 1, 0),
                        (shiftright(hp, greatest(0, size(p) - j + {edits})) & 1) - (shiftright(hn, greatest(0, size(p) - j + {edits})) & 1)))""",
                ),
            ),
        ),
    )
    start = f"named_struct('vp', {((1 << (edits + 1)) - 1) << edits}, 'vn', 0, 'd', least({edits}, size(p)))"
    walk = f"aggregate(sequence(1, size(t)), {start}, (s, j) -> if(s.d > 3 * {edits}, s, {diagonal})).d <= {edits}"
    chars = lambda x: f"split({x}, '')"
    banded = _bound(f"named_struct('p', {chars('m.a')}, 't', {chars('m.b')})", "w", walk.replace("size(p)", "size(w.p)").replace("size(t)", "size(w.t)").replace("get(p,", "get(w.p,").replace("get(t,", "get(w.t,"))
    decided = f"""case when abs(char_length(m.a) - char_length(m.b)) > {edits} then false
        when least(char_length(m.a), char_length(m.b)) = 0 then true
        else {banded} end"""
    inner = _bound(f"named_struct('a', {middle(a)}, 'b', {middle(b)})", "m", decided)
    return F.expr(_bound(head, "head", _bound(tail, "tail", inner)))


def near_lines(lines: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2) of the lines (h1, h2, line, place), all distinct, that an earlier one is near to."""
    whole = Window.partitionBy("key")  # dealt and sorted once, with no join; a key's rows are held on disk where they are many
    keyed = keys(lines, edits, min_chars).withColumn("a", F.min("h1").over(whole)).withColumn("b", F.max("h1").over(whole)).withColumn("only_probes", F.min("probe").over(whole))
    members = written(keyed.where("a <> b AND NOT only_probes").select("h1", "key", "probe").distinct(), "line-members")
    wanted = written(members.select("h1").distinct(), "line-names")
    texts = lines.join(wanted.hint("merge"), "h1", "left_semi").select("h1", "h2", "place", "line", letter_counts().alias("letters"))
    texts = written(texts, "line-texts")

    facts = texts.select("h1", "h2", "letters", F.char_length("line").alias("n"), "place")
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("h1", "h2", "letters", "n", "place")]
    placed = members.join(facts, "h1")
    left = placed.where(~F.col("probe")).select("key", *side("x"))
    right = placed.select("key", *side("y"))
    apart = F.aggregate(F.zip_with("letters_x", "letters_y", lambda p, q: F.abs(p - q)), F.lit(0), lambda s, x: s + x)
    different = (F.col("h1_x") != F.col("h1_y")) | (F.col("h2_x") != F.col("h2_y"))
    pairs = left.join(right, (left["key"] == right["key"]) & different & (F.abs(F.col("n_x") - F.col("n_y")) <= edits) & (apart <= 2 * edits))
    first = F.col("place_x") < F.col("place_y")
    name = lambda x: F.struct(F.col(f"h1_{x}").alias("h1"), F.col(f"h2_{x}").alias("h2"))
    pairs = pairs.where(first | (F.col("place_y") < F.col("place_x"))).select(F.when(first, name("x")).otherwise(name("y")).alias("a"), F.when(first, name("y")).otherwise(name("x")).alias("b")).distinct()
    of = texts.select(F.struct("h1", "h2").alias("of"), "line")
    pairs = pairs.join(of.select(F.col("of").alias("a"), F.col("line").alias("line_a")), "a").join(of.select(F.col("of").alias("b"), F.col("line").alias("line_b")), "b")
    return pairs.where(within_edits("line_a", "line_b", edits)).select("b.h1", "b.h2").distinct()


def judged_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text_hash, line_no, near) of the lines that go."""
    lines = written(distinct_lines(docs), "lines")
    near = written(near_lines(lines, edits, min_chars), "near-lines").withColumn("near", F.lit(True))
    places = occurrences(docs).select("doc_id", "text_hash", "line_no", "h1", "h2")
    first = lines.select("h1", "h2", F.col("place").alias("first"), "times")
    first = first.join(near, ["h1", "h2"], "left").where("times > 1 OR near").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    gone = places.join(first, ["h1", "h2"])
    here = F.struct("doc_id", "line_no")
    return gone.where(F.col("near") | (here > F.col("first"))).select("doc_id", "text_hash", "line_no", (here <= F.col("first")).alias("near"))


def deduplicated(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """`docs` with `_lines` (lines with a word), `_equal` and `_near` (how many went for an equal or near earlier line) and `_kept` (the rest of the text)."""
    gone = judged_lines(docs, edits, min_chars).groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
        F.collect_set("line_no").alias("_gone"), F.count_if("near").alias("_near_rows"), F.count(F.lit(1)).alias("_rows")
    )
    rows = docs.withColumn("_text_hash", F.xxhash64("text"))
    rows = rows.join(gone, rows["doc_id"].eqNullSafe(gone["_id"]) & (rows["_text_hash"] == gone["_hash"]), "left")
    lines = F.split(text_or_empty(), "\n", -1)
    rest = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("_gone"), i)), "\n")
    share = F.size("_gone") / F.col("_rows")  # equal rows counted together
    return rows.select(
        *[rows[c] for c in docs.columns],
        F.size(F.filter(lines, lambda x: x.rlike(WORD))).cast("long").alias("_lines"),
        F.coalesce(F.size("_gone") - F.round(F.col("_near_rows") * share), F.lit(0)).cast("long").alias("_equal"),
        F.coalesce(F.round(F.col("_near_rows") * share), F.lit(0)).cast("long").alias("_near"),
        F.when(F.col("_gone").isNull(), text_or_empty()).otherwise(rest).alias("_kept"),
    )


def query(docs: DataFrame) -> DataFrame:
    rows = deduplicated(docs.select("doc_id", "text"))
    return rows.select(
        "doc_id", F.col("_lines").alias("n_lines"), F.col("_equal").alias("n_equal"), F.col("_near").alias("n_near"),
        F.octet_length("_kept").cast("long").alias("kept_bytes"), F.md5(F.col("_kept").cast("binary")).alias("kept_md5"),
    )
