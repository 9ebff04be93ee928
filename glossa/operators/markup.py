"""Manual markup to rows: a recursive macro language, parsed a file at a time, as flat entries.

The tree has no shape that a table could hold, so it never leaves the parser: what leaves is a row for each list entry, heading and
command macro, with its text, its tokens, and where it stands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.stored import stored

#: Macros that stand for a character.
CHARACTERS = {"AMP": "&", "DASH": "-", "HASH": "#", "LPAR": "(", "LSQUARE": "[", "PIPE": "|", "PLUS": "+", "RPAR": ")", "RSQUARE": "]", "SPACES": " "}
#: Macros without text of their own.
SILENT = {"COMMENT", "cindex", "findex", "pindex", "vindex", "chapter", "texinode", "startitem", "enditem", "startsitem", "endsitem", "startmenu", "endmenu", "ifzman"}
#: Typing errors in the manual's files, and what they should read.
FIXES = {
    "options.yo": ("`var(name)tt(=)var(pattern) (e.g. `tt(foo=*)')", "`var(name)tt(=)var(pattern)' (e.g. `tt(foo=*)')"),
    "expn.yo": ("`tt(%)' and `tt(#%) are not active", "`tt(%)' and `tt(#%)' are not active"),
}

_CALL = re.compile(r"[A-Za-z][A-Za-z0-9_]*(?=\()")


@dataclass
class Macro:
    name: str
    args: list[list]


def parse(source: str) -> list[str | Macro]:
    """Text and macros of a source. A macro whose parentheses do not close is text.

    Each open parenthesis is matched once, beforehand; arguments are then parsed from a list of work, so time is linear and nesting may be of any depth.
    """
    closes = _closings(source)
    root: list[str | Macro] = []
    work = [(root, 0, len(source))]
    while work:
        nodes, at, end = work.pop()
        text = at
        while at < end:
            c = source[at]
            # A plus right before a macro only parts it from what stands before.
            call = _macro(source, at + 1, closes) if c == "+" else _macro(source, at, closes) if c.isalpha() else None
            if not call:
                at += 1
                continue
            if text < at:
                nodes.append(source[text:at])
            name, spans = call
            macro = Macro(name, [[] for _ in spans])
            nodes.append(macro)
            work.extend((arg, i + 1, j) for arg, (i, j) in zip(macro.args, spans, strict=True))
            at = text = spans[-1][1] + 1
        if text < end:
            nodes.append(source[text:end])
    return root


def _closings(source: str) -> dict[int, int]:
    """Where each parenthesis closes that does."""
    open_, out = [], {}
    for m in re.finditer(r"[()]", source):
        if m[0] == "(":
            open_.append(m.start())
        elif open_:
            out[open_.pop()] = m.start()
    return out


def _macro(source: str, at: int, closes: dict[int, int]) -> tuple[str, list[tuple[int, int]]] | None:
    """The name of the macro at a place, and where its arguments open and close."""
    if at > 0 and (source[at - 1].isascii() and source[at - 1].isalpha() or source[at - 1] == "_"):
        return None
    name = _CALL.match(source, at)
    spans: list[tuple[int, int]] = []
    at = name.end() if name else at
    while name and source.startswith("(", at):
        if at not in closes:
            return None
        spans.append((at, closes[at]))
        at = closes[at] + 1
    return (name[0], spans) if spans else None


#: Macros whose arguments are code.
_CODE = ("tt", "var", "example")


def rendered(nodes: list, code: bool = False) -> str:
    """The text of nodes; inner macros first, from a list, so that nesting may be of any depth."""
    order, work = [], [(n, code) for n in nodes if not isinstance(n, str)]
    while work:
        m, c = work.pop()
        order.append((m, c))
        work.extend((n, c or m.name in _CODE) for arg in m.args for n in arg if not isinstance(n, str))
    done: dict[tuple[int, bool], str] = {}
    joined = lambda part, c: "".join(n if isinstance(n, str) else done[id(n), c] for n in part)
    for m, c in reversed(order):
        done[id(m), c] = _one(m, c, [joined(arg, c or m.name in _CODE) for arg in m.args])
    return joined(nodes, code)


def _one(m: Macro, code: bool, args: list[str]) -> str:
    arg = lambda i: args[i] if i < len(args) else ""
    if m.name in CHARACTERS:
        return CHARACTERS[m.name]
    if m.name in ("tt", "var"):
        return arg(0)
    if m.name == "example":
        return f"\n\n```zsh\n{plain_text(arg(0))}\n```\n\n"
    if code and len(m.args) == 1 and not m.args[0] and m.name not in SILENT:
        return f"{m.name}()"
    if m.name in SILENT:
        return ""
    if m.name == "ifnzman":
        return arg(0)
    if m.name == "manref":
        return f"{arg(0)}({arg(1)})"
    if m.name == "sitem":
        return f"- {arg(0)}: {arg(1)}" if len(m.args) > 1 else arg(0)
    return "".join(args)


def plain_text(s: str) -> str:
    """Without escapes of apostrophes, long gaps, and white space at the ends."""
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"(?<!`)\\'", "'", s)).strip()


def plain(nodes: list) -> str:
    return plain_text(rendered(nodes))


def header_text(nodes: list) -> str:
    return re.sub(r"\s+", " ", plain(nodes)).strip()


def _tight(s: str) -> str:
    return re.sub(r"\s+\.(?=$|[\s)\]}>\"'])", ".", re.sub(r"\s+([,;:!?])", r"\1", s))


_REFERS = re.compile(r"\b(?:see|in|described in|noted in)$", re.I)
_FENCE = re.compile(r"(?m)^([^\S\n]*```[^\n]*)$")
#: A backslash behind text at a line's end, with the lines after it that hold no more than a backslash.
_GOES_ON = re.compile(r"(?<=\S)[^\S\n]*\\[^\S\n]*(?:\n[^\S\n]*\\?[^\S\n]*(?=\n|\Z))*(?:\n|\Z)")


def _paragraphs(raw: str) -> Iterator[tuple[bool, str]]:
    """The paragraphs of prose, and the lines of code, each with whether blank lines stand before it."""
    parts, gap = _FENCE.split(raw), False
    for k, part in enumerate(parts):
        if k % 2:
            yield gap, part.strip()
            gap = False
            continue
        lines = part.split("\n")[bool(k) : -1 if k + 1 < len(parts) else None]
        code = k % 4 == 2
        if code:
            runs = [[x.rstrip()] for x in lines]
        else:
            lines = _GOES_ON.sub("\0", "\n".join(lines)).split("\n") if lines else []
            runs = [list(g) for _, g in groupby(lines, key=lambda x: x.strip() in ("", "\\"))]
        for run in runs:
            if run[0].strip() in (("",) if code else ("", "\\")):
                gap = True
                continue
            yield gap, run[0] if code else _tight(re.sub(r"`([^`\n]+?)'", r"`\1`", re.sub(r"\s+", " ", " ".join(run).replace("\0", " ")).strip()))
            gap = False


def body_text(raw: str) -> str:
    """Paragraphs as one line each, code as it is; quotes as code spans; a paragraph that ends by referring takes in the next."""
    out: list[str] = []
    for gap, text in _paragraphs(raw):
        if out and gap and _REFERS.search(out[-1]) and not out[-1].startswith("```") and not text.startswith("```"):
            out[-1] += " " + text
        else:
            out += ["", text] if gap and out else [text]
    return _tight(re.sub(r"(\b(?:see|in|described in|noted in))\n\n([A-Z][^\n]+)", r"\1 \2", "\n".join(out), flags=re.I))


def tokens(nodes: list) -> list[tuple[str, str]]:
    """(kind, text) of the tt and var macros, outermost, in order."""
    out: list[tuple[str, str]] = []
    work = nodes[::-1]
    while work:
        n = work.pop()
        if isinstance(n, str):
            continue
        if n.name in ("tt", "var"):
            out.append((n.name, rendered(n.args[0] if n.args else [], True)))
        else:
            work.extend(x for arg in reversed(n.args) for x in reversed(arg))
    return out


TOKENS = "array<struct<kind:string,text:string>>"
SCHEMA = (
    f"manual string, file string, pos long, kind string, header string, header_plain string, header_tokens {TOKENS}, indented boolean, body string, body_plain string, body_tokens {TOKENS}, "
    "second string, section string, sect string, first_section boolean, first_sect boolean, item_depth int, sitem_depth int, item_list int, sitem_list int, item_list_sect int, sitem_list_sect int, sitem_list_file int"
)


def entries_of(file: str, source: str, manual: str = "") -> Iterator[dict]:
    """The rows of a file of a manual. Lists are numbered from 1 since the last heading, the last `sect` and the file's start."""
    wrong, right = FIXES.get(file.rpartition("/")[2], ("", ""))
    nodes = parse(source.replace(wrong, right) if wrong else source)
    section = sect = ""
    seen_section: set[str] = set()
    seen_sect: set[str] = set()
    first_section = first_sect = True
    depth = {"item": 0, "sitem": 0}
    count = {k: {"item": 0, "sitem": 0} for k in ("section", "sect", "file")}
    for pos, n in enumerate(nodes):
        if not isinstance(n, Macro):
            continue
        arg = lambda i, n=n: n.args[i] if i < len(n.args) else []
        body = None
        if n.name in ("sect", "subsect"):
            section = plain(arg(0))
            first_section = section not in seen_section
            seen_section.add(section)
            count["section"] = {"item": 0, "sitem": 0}
            if n.name == "sect":
                sect = section
                first_sect = sect not in seen_sect
                seen_sect.add(sect)
                count["sect"] = {"item": 0, "sitem": 0}
        elif n.name in ("startitem", "startsitem"):
            k = n.name[5:]
            if depth[k] == 0:
                for c in count.values():
                    c[k] += 1
            depth[k] += 1
            continue
        elif n.name in ("enditem", "endsitem"):
            k = n.name[3:]
            depth[k] = max(0, depth[k] - 1)
            continue
        elif n.name in ("item", "sitem"):
            body = arg(1)
        elif n.name == "xitem":
            pass
        elif n.name in ("alias", "module", "zlecmd") or (n.name in ("tt", "var")) or tokens([n]):
            pass
        else:
            continue
        whole = n.name in ("tt", "var") or n.name not in ("sect", "subsect", "item", "sitem", "xitem", "alias", "module", "zlecmd")
        head = [n] if whole else arg(0)
        yield {
            "manual": manual, "file": file, "pos": pos, "kind": "text" if whole else n.name, "header": header_text(head), "header_plain": plain(head), "header_tokens": tokens(head),
            "indented": bool(head) and isinstance(head[0], Macro) and head[0].name == "SPACES",
            "body": None if body is None else body_text(plain(body)), "body_plain": None if body is None else plain(body), "body_tokens": None if body is None else tokens(body),
            "second": header_text(arg(1)) if n.name in ("alias", "module") else None, "section": section, "sect": sect, "first_section": first_section, "first_sect": first_sect,
            "item_depth": depth["item"], "sitem_depth": depth["sitem"], "item_list": count["section"]["item"], "sitem_list": count["section"]["sitem"],
            "item_list_sect": count["sect"]["item"], "sitem_list_sect": count["sect"]["sitem"], "sitem_list_file": count["file"]["sitem"],
        }


def entries(files: DataFrame) -> DataFrame:
    """Entry rows of files (file, value), and of which manual if they say so; the parser takes one file at a time."""
    names = [x.split(" ")[0] for x in SCHEMA.replace(TOKENS, "tokens").split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [row for manual, file, value in zip(batch["manual"], batch["file"], batch["value"], strict=True) for row in entries_of(file, value or "", manual)]
            for row in rows:
                for c in ("header_tokens", "body_tokens"):
                    row[c] = None if row[c] is None else [{"kind": k, "text": t} for k, t in row[c]]
            if rows:
                yield pd.DataFrame(rows, columns=names)

    manual = F.col("manual").cast("string") if "manual" in files.columns else F.lit("")
    return files.select(manual.alias("manual"), "file", "value").mapInPandas(run, SCHEMA)


def entry_table(files: DataFrame) -> DataFrame:
    """The entries of files as a written table, a folder a file name: every file is parsed once, and each reader's filter on `file` prunes the folders that it does not need."""
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["manual", "file"] if "manual" in files.columns else ["file"]
    return stored(entries(files.repartition(tasks, *keys)), "entries", ["file"])


def read_manual(spark: SparkSession, path: str) -> DataFrame:
    """(file, value) of a folder of manual files."""
    return read_manuals(spark, path).drop("manual")


def read_manuals(spark: SparkSession, path: str, files: list[str] | None = None) -> DataFrame:
    """(manual, file, value) of the manual files in a folder or, by a pattern, in several; a manual is named by its folder. `files` are the only names that are read.

    Spark's own reader plans the files and so reaches every store that Spark reads; the filter is on file names, so other files are not opened.
    """
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.yo").select("value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("file"))
    rows = rows.where(F.col("file").isin(files)) if files else rows
    return rows.select(F.regexp_extract("_path", r"([^/]+)/[^/]+$", 1).alias("manual"), "file", "value")


def alias_groups(rows: DataFrame, head: Column, scope: tuple[str, ...] = ("manual", "file")) -> DataFrame:
    """Entries under the next one that has a body: rows + `_head`, `_group` (its position), `_place` (0 the entry with the body, then its aliases in order).

    A row without a head ends a run; entries that no body follows are dropped.
    """
    rows = rows.withColumn("_head", head)
    order = Window.partitionBy(*scope).orderBy("pos")
    ends = F.when(F.col("_head").isNull() | F.col("body").isNotNull(), 1).otherwise(0)
    run = F.coalesce(F.sum(ends).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_run", run).where("_head IS NOT NULL")
    own = Window.partitionBy(*scope, "_run")
    closing = F.max(F.when(F.col("body").isNotNull(), F.col("pos"))).over(own)
    rows = rows.withColumn("_group", closing).where("_group IS NOT NULL")
    shared = [F.max(F.when(F.col("body").isNotNull(), F.struct(c))).over(own)[c].alias(f"_{c}") for c in ("body", "body_plain", "section")]
    place = F.when(F.col("body").isNotNull(), 0).otherwise(F.row_number().over(own.orderBy("pos")))
    return rows.select(*rows.columns, place.alias("_place"), *shared)


def section_extents(rows: DataFrame) -> DataFrame:
    """(manual, file, level, name, start, end, sect_end): headings and where they end: at the next of either level, or the next `sect`."""
    heads = rows.where(F.col("kind").isin("sect", "subsect"))
    order = Window.partitionBy("manual", "file").orderBy("pos")
    sect_after = F.first(F.when(F.col("kind") == "sect", F.col("pos")), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    return heads.select("manual", "file", F.col("kind").alias("level"), F.col("section").alias("name"), F.col("pos").alias("start"), F.lead("pos").over(order).alias("end"), F.when(F.col("kind") == "sect", sect_after).alias("sect_end"))
