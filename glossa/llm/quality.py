"""Line-first cleaning: rules judge single lines, failing lines go, and documents that lose too much go too.

A line with a word fails where a rule says so:
- punctuation: symbols make up over a tenth of its word characters, or over a third of its words carry doubled
  marks, or it has twelve words or more without a single mark that ends or parts a sentence;
- navigation: over a quarter of its words, and three at least, are separators, or a line of up to four words
  without an ending mark is made of menu terms;
- boilerplate: a line of up to 25 words that speaks of licences, rights, cookies or scripts.

Lines without words stay as they are and are no loss. A document is kept if the base rules pass (ten words, and at most a
fifth of the words in repeated five-word windows), if at most half of its word characters were in lines that failed,
by whichever rule, and if any other line is left.

Cases: null text has no words and fails, as empty texts do; repeated rows are judged alike; an empty table gives
no rows; other columns are carried only where asked for. A text is always judged whole, by one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .vector import ARROW_ROWS, Words, groups, mix

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_LOSS = 0.5
MAX_SYMBOLS = 0.1
MAX_DOUBLED = 1 / 3
MAX_SEPARATORS = 0.25
UNMARKED_WORDS = 12
MENU_WORDS = 4
BOILERPLATE_WORDS = 25

SPACES = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"
#: Fixed values of the line rules, in the notation that Python and RE2 share.
LINE_SYMBOLS = r"[#*$%&|<>~^=_\\{}@+]"
DOUBLED = r"!!|\?\?|\.\.\.\."
MARKS = r"[.,;:!?…。！？]"
SEPARATOR = r"^(\||»|›|·|>|>>|/|•|→)$"
MENU = r"(?i)^(home|menu|next|previous|prev|back|search|login|log in|sign in|sign up|register|contact|contact us|about|about us|sitemap|share|print|top|skip to content|read more)$"
BOILERPLATE = r"(?i)(all rights reserved|\blicen[cs]ed under\b|\breleased under the\b|general public license|\bcopyright\b|©|\bcookies?\b.*\b(use|accept|policy)|\bprivacy policy\b|\bterms of (use|service)\b|\benable javascript\b)"

_rules = {k: re.compile(v) for k, v in {"symbol": LINE_SYMBOLS, "doubled": DOUBLED, "marks": MARKS, "separator": SEPARATOR, "menu": MENU, "boilerplate": BOILERPLATE, "word": r"[^\x20\x09-\x0D]+"}.items()}


_LINE_SYMBOLS = "#*$%&|<>~^=_\\{}@+"
_DOUBLED = ("!!", "??", "....")
_BOILERPLATE_WORDS = ("reserved", "licen", "released under", "copyright", "©", "cookie", "privacy", "terms of", "javascript")
_SEPARATORS = "|»›·>/•→"
_ENDING = ".!?…。！？:;\"')]"


class Clues:
    """Which of a text's lines can fail at all; most texts have no clue, and then no pattern is tried on their lines."""

    def __init__(self, text: str):
        self.symbol = any(c in text for c in _LINE_SYMBOLS)
        self.doubled = any(c in text for c in _DOUBLED)
        self.separator = any(c in text for c in _SEPARATORS)
        low = text.lower()
        self.boilerplate = any(c in low for c in _BOILERPLATE_WORDS)


def line_fails(line: str, clues: Clues | None = None) -> str | None:
    """The name of the rule that a line with a word fails, or None."""
    clues = clues or Clues(line)
    if clues.symbol and len(_rules["symbol"].findall(line)) > MAX_SYMBOLS * (len(line) - sum(map(line.count, SPACES))):
        return "punctuation"
    if clues.doubled and _rules["doubled"].search(line):
        words = _rules["word"].findall(line)
        if sum(1 for w in words if _rules["doubled"].search(w)) > MAX_DOUBLED * len(words):
            return "punctuation"
    if "." not in line and "," not in line and not _rules["marks"].search(line) and len(_rules["word"].findall(line)) >= UNMARKED_WORDS:
        return "punctuation"
    if clues.separator:
        words = _rules["word"].findall(line)
        if sum(1 for w in words if _rules["separator"].match(w)) > max(2, MAX_SEPARATORS * len(words)):
            return "navigation"
    bare = line.strip(SPACES)
    if bare[-1] not in _ENDING and len(_rules["word"].findall(line)) <= MENU_WORDS and _rules["menu"].match(bare):
        return "navigation"
    if clues.boilerplate and _rules["boilerplate"].search(line) and len(_rules["word"].findall(line)) <= BOILERPLATE_WORDS:
        return "boilerplate"
    return None


def cleaned_text(text: str) -> tuple[str, int, int]:
    """The text without its failing lines, the word characters in those, and whether any are left."""
    out, lost, left, clues = [], 0, 0, Clues(text)
    for line in text.split("\n"):
        if bare := line.strip(SPACES):
            if line_fails(line, clues):
                lost += len(line) - sum(map(line.count, SPACES))
                continue
            left += len(bare)
        out.append(line)
    return "\n".join(out), lost, left


def repeated_words(words: Words, n: int = 5) -> np.ndarray:
    """By text: the words inside n-word windows that the text has twice or more."""
    key, at = words.windows(n)
    key = mix(key + words.doc[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key)
    key = key[order]
    same = np.zeros(len(key), bool)
    same[1:] = key[1:] == key[:-1]
    same[:-1] |= same[1:]
    cover = np.zeros(len(words.start) + n + 1, np.int64)
    hit = at[order[same]]
    cover[hit] += 1
    np.subtract.at(cover, hit + n, 1)
    covered = np.cumsum(cover)[: len(words.start)] > 0
    return np.bincount(words.doc[covered], minlength=len(words.count)).astype(np.int64)


FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("clean_text", pa.string())]


def _judge(texts: list[str], with_text: bool) -> list[pa.Array]:
    rows: list[tuple] = []
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    for a, b in groups(raw):
        words = Words(raw[a:b])
        repeats = repeated_words(words)
        for text, n, r in zip(texts[a:b], words.count.tolist(), repeats.tolist(), strict=True):
            chars = len(text) - sum(map(text.count, SPACES))
            lines = [x for x in text.split("\n") if x.strip(SPACES)]
            failed = n < MIN_WORDS or 100 * r > MAX_REPEAT_PERCENT * n
            clean, lost, left = cleaned_text(text) if with_text or not failed else (None, 0, 0)
            rows.append((n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), r, failed, not failed and left > 0 and lost <= MAX_LOSS * chars, clean if with_text else None))
    columns = zip(*rows, strict=True) if rows else [[] for _ in FIELDS]
    return [pa.array(list(c), kind) for c, (_, kind) in zip(columns, FIELDS, strict=True)]


def judged(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """The columns in `carry`, then every figure of the rules, `kept`, and, if asked for, the cleaned text."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    fields = [f for f in FIELDS if with_text or f[0] != "clean_text"]
    rows = docs.select(*carry, F.col("text").cast("string").alias("_text"))
    kinds = {pa.int64(): T.LongType(), pa.bool_(): T.BooleanType(), pa.string(): T.StringType()}
    schema = T.StructType(rows.schema.fields[:-1] + [T.StructField(n, kinds[k]) for n, k in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _judge([x or "" for x in batch.column("_text").to_pylist()], with_text)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), *out[: len(fields)]], names=[*carry, *(n for n, _ in fields)])

    return rows.mapInArrow(run, schema)


def query(docs: DataFrame) -> DataFrame:
    names = [n for n, _ in FIELDS if n != "clean_text"]
    return judged(docs).select("doc_id", *names)
