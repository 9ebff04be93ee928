"""What an editor asks of places in documents: the token there, what is known of it, and what may be typed.

Places are rows, as many as a user likes, up to every column of every line. What depends on the text alone is found once a line or once a distinct name and
kept as spans with their answers; places meet spans by equality of document and bin, so neither a place nor a name is asked of the whole corpus.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .facts import REMEMBERED, SYMBOL_EDGES, TOKEN_ENDS, WORD, active, binned, by_document, contexts, gathered, present, text_contexts, trim, with_facts
from .resolve import begun, flag_index, resolve
from .textlines import NAME, function_docs, function_index, matched, name_tokens

#: What ends a token, as a class.
DELIMITERS = r"\s;&|()<>{}\"'`$="
#: Categories offered in general code, in this order.
GENERAL = ("builtin", "reserved_word", "precmd", "shell_param")
#: Characters of a bin.
BIN = 256
#: Lines whose answers are made at once, and the most beginnings of names that go to every task; a larger corpus meets places by joins.
LINES_AT_ONCE, MOST_BEGINNINGS = 20_000, 200_000


def token_at(points: DataFrame, lines: DataFrame) -> DataFrame:
    """(points.*, token, start, end) of the token around each (doc_id, line_no, char_no), or nulls."""
    rows = points.join(lines.select("doc_id", "line_no", "text"), ["doc_id", "line_no"], "left")
    before = F.regexp_extract(F.expr("substring(text, 1, cast(char_no as int))"), f"[^{DELIMITERS}]*$", 0)
    after = F.regexp_extract(F.expr("substring(text, cast(char_no as int) + 1)"), f"^[^{DELIMITERS}]*", 0)
    whole = F.concat(before, after)
    start = F.col("char_no") - F.length(before)
    some = whole != ""
    return rows.select(*points.columns, F.when(some, whole).alias("token"), F.when(some, start).alias("start"), F.when(some, start + F.length(whole)).alias("end"))


def _windows(lengths: Column) -> Column:
    """array<struct<start,end,text>> of a line: texts of the given lengths from every edge on that end at an edge too."""
    each = lambda a: F.transform(lengths, lambda n: F.struct(a.alias("start"), (a + n).alias("end"), F.substring("text", a.cast("int") + 1, n).alias("text")))
    after = lambda w: F.substring("text", w["end"].cast("int") + 1, F.lit(1))
    return F.filter(F.flatten(F.transform("edges", each)), lambda w: (w["end"] <= F.col("cut")) & ((after(w) == "") | after(w).rlike(f"[{SYMBOL_EDGES}]")))


def _lengths(symbols: DataFrame) -> DataFrame:
    """One row, of as many numbers as symbols have lengths."""
    return symbols.select(F.length("id").alias("n")).distinct().agg(F.collect_list("n").alias("_lengths"))


def symbol_spans(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """(doc_id, line_no, start, end, id, seq): every place of a symbol (id, seq) in the active text that ends or brackets, or blanks, surround.

    Texts of the symbols' lengths from every such edge on meet the symbols by equality: as many as there are lengths, whatever the number of symbols. The symbols go to the texts, which
    are many more: they are the operators of a language.
    """
    rows = with_facts(lines, pieces=True).where("edges IS NOT NULL").crossJoin(F.broadcast(_lengths(symbols)))
    rows = rows.select("doc_id", "line_no", F.inline(_windows(F.col("_lengths")))).withColumnRenamed("text", "id")
    return rows.join(F.broadcast(symbols.select("id", "seq")), "id").select("doc_id", "line_no", "start", "end", "id", "seq")


def longest_symbol_at(points: DataFrame, spans: DataFrame) -> DataFrame:
    """(points.*, id, start, end): the longest symbol around each (doc_id, line_no, char_no), then the first of the dictionary, then the leftmost; or nulls."""
    of = F.struct((F.col("start") - F.col("end")).alias("size"), "seq", F.col("start").alias("at"), "id", "start", "end")
    found = binned(spans, ["doc_id", "line_no"], F.col("start"), F.col("end") - 1, of, BIN)
    rows = points.withColumn("_bin", F.floor(F.col("char_no") / BIN)).join(found, ["doc_id", "line_no", "_bin"], "left")
    rows = rows.withColumn("_b", F.array_min(F.filter("_spans", lambda x: (F.col("char_no") >= x["start"]) & (F.col("char_no") < x["end"]))))
    return rows.select(*points.columns, "_b.id", "_b.start", "_b.end")


def _probes(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """(doc_id, line_no, line_start, start, end, pri, need, category, raw): all that may be asked of a line's spans, by one pass over it.

    `need` is the context in which a span counts, or `token` for the bare spans of tokens; words end a character later, since they may be asked for at their end.
    """
    rows = with_facts(lines, pieces=True).where("tokens IS NOT NULL").crossJoin(F.broadcast(_lengths(symbols)))
    one = lambda start, end, pri, need, category, raw: F.struct(start.alias("start"), end.alias("end"), F.lit(pri).alias("pri"), F.lit(need).cast("string").alias("need"), F.lit(category).alias("category"), raw.alias("raw"))
    spans = lambda found, pri, need, category, more=0: F.transform(found, lambda x: one(x["start"], x["end"] + more, pri, need, category, x["text"]))
    first = lambda kind: F.get(F.filter("facts", lambda f: f["kind"] == kind), F.lit(0))
    tokens = F.col("tokens")
    of = lambda flag: F.filter(tokens, lambda t: t[flag])
    redir, subst = first("redir"), first("process-subst")
    tail = F.regexp_extract(F.substring(active(), redir["span_end"].cast("int") + 1, F.length("text")), f"^[^{TOKEN_ENDS}]*", 0)
    whole = one(F.lit(0).cast("long"), F.length("text").cast("long") + 1, 8, None, "process_subst", F.concat(F.left(subst["text"], F.lit(2)), F.lit("...)")))
    signs = F.filter(_windows(F.col("_lengths")), lambda w: w["text"].rlike(f"[{TOKEN_ENDS}]") & (X.trim(w["text"]) == w["text"]))  # what is resolved is trimmed
    parts = [
        spans(tokens, 99, "token", "token"), spans(tokens, 0, "setopt", "option"), spans(F.filter(tokens, lambda t: t["text"].rlike("^[+-][A-Za-z0-9]$")), 1, "setopt", "flag"), spans(tokens, 2, "cond", "cond_op"), spans(signs, 2, "symbol", "cond_op"),
        spans(F.col("words"), 3, None, "function", 1), spans(F.col("words"), 4, None, "shell_param", 1), spans(of("precmd"), 5, None, "precmd"), spans(of("head"), 6, None, "builtin"),
        F.when(redir.isNotNull(), F.array(one(redir["span_start"], redir["span_end"] + F.length(tail), 7, None, "redir", F.concat(redir["text"], tail)))).otherwise(F.array()),
        F.when(subst.isNotNull(), F.array(whole)).otherwise(F.array()), spans(of("reserved"), 9, None, "complex_command"), spans(of("reserved"), 10, None, "reserved_word"),
    ]
    return rows.select("doc_id", "line_no", "line_start", F.inline(F.concat(*parts)))


def hovered(points: DataFrame, lines: DataFrame, contexts: DataFrame, corpus: DataFrame, flags: DataFrame) -> DataFrame:
    """(doc_id, line_no, char_no, source, category, id, start, end, body): what is known of each place (doc_id, line_no, char_no), a row a place.

    The first that knows something answers: in option settings an option, or a single-letter flag that names exactly one; in tests the operator
    that is the token there or, where there is none, the longest symbol; a function of the document that has a comment (`body`); a parameter;
    a precommand, a builtin, the line's first redirection, its first process substitution; a complex command, a reserved word. `start` and `end` are places in the line, null where no token gives a range.

    lines: (doc_id, line_no, line_start, text); contexts: spans of `analyzed`, kind ctx; corpus: (category, id, seq, group_op); flags: (id, flags) of the options.
    Every distinct name is resolved once, in one join. A place meets the spans of its part of the line, and then the contexts of its part of the document, as one row each.
    """
    symbols = corpus.where((F.col("category") == "cond_op") & F.col("id").rlike(f"[{TOKEN_ENDS}]")).select("id", "seq")
    probes = _probes(lines, symbols)
    asked = probes.where(~F.col("category").isin("token", "function", "flag")).select("category", "raw").distinct()
    answers = resolve(asked, corpus).where("id IS NOT NULL").join(corpus.select("category", "id", "seq"), ["category", "id"])
    letters = flag_index(flags).select(F.lit("flag").alias("category"), "id", F.concat("on", "char").alias("raw"), F.lit(0).cast("long").alias("seq"))
    answers = answers.unionByName(letters)
    found = probes.where(~F.col("category").isin("token", "function")).join(answers, ["category", "raw"]).withColumn("body", F.lit(None).cast("string"))
    docs = function_docs(function_index(lines)).select("doc_id", F.col("name").alias("raw"), F.col("doc_text").alias("body"))
    own = probes.where("category = 'function'").join(docs.hint("merge"), ["doc_id", "raw"]).withColumn("id", F.col("raw")).withColumn("seq", F.lit(0).cast("long"))
    bare = probes.where("category = 'token'").select("doc_id", "line_no", "start", "end", "need")

    longer = F.col("pri").isin(3, 4).cast("int")
    category = F.when(F.col("category") == "flag", "option").otherwise(F.col("category"))
    answer = F.struct("pri", category.alias("category"), "id", F.when(F.col("pri") != 8, F.col("start")).alias("start"), F.when(F.col("pri") != 8, F.col("end") - longer).alias("end"), "body")
    rank = F.struct("pri", (F.when(F.col("need") == "symbol", F.col("start") - F.col("end")).otherwise(0)).alias("longest"), "seq", "start")
    place = ["doc_id", "line_no", "start", "end", "need"]
    spans = found.unionByName(own).select(*place, rank.alias("rank"), answer.alias("answer"))
    spans = spans.unionByName(bare.select(*place, F.struct("start", "end").alias("range")), allowMissingColumns=True).where("start < end")
    spans = binned(spans, ["doc_id", "line_no"], F.col("start"), F.col("end") - 1, F.struct("start", "end", "need", "rank", "answer", "range"), BIN)

    at = points.select("doc_id", "line_no", "char_no").withColumn("_bin", F.floor(F.col("char_no") / BIN)).join(spans, ["doc_id", "line_no", "_bin"], "left")
    at = at.withColumn("_in", F.coalesce(F.filter("_spans", lambda x: (F.col("char_no") >= x["start"]) & (F.col("char_no") < x["end"])), F.array())).drop("_spans", "_bin")
    best = lambda need: F.array_min(F.transform(F.filter("_in", lambda x: need(x["need"]) & x["answer"].isNotNull()), lambda x: F.struct(x["rank"].alias("rank"), x["answer"].alias("answer"))))["answer"]
    is_ = lambda name: lambda need: need.eqNullSafe(name)
    place = at.select(
        "doc_id", "line_no", "char_no", F.array_max(F.transform(F.filter("_in", lambda x: x["need"].eqNullSafe("token")), lambda x: x["range"])).alias("_token"),
        best(is_("setopt")).alias("_setopt"), best(is_("cond")).alias("_cond"), best(is_("symbol")).alias("_symbol"), best(lambda need: need.isNull()).alias("_any"),
    )
    place = _in_contexts(place, lines, contexts)
    tested = F.when(F.col("_token").isNotNull(), F.col("_cond")).otherwise(F.col("_symbol"))
    place = place.withColumn("_a", F.coalesce(F.when(F.col("_ctx") == 2, F.col("_setopt")), F.when(F.col("_ctx") == 1, tested), F.col("_any")))
    source = F.when(F.col("_a.category") == "function", "function").when(F.col("_a").isNotNull(), "corpus")
    range_ = lambda c: F.when(F.col("_a.pri") == 8, F.col(f"_token.{c}")).otherwise(F.col(f"_a.{c}")).alias(c)
    return place.select("doc_id", "line_no", "char_no", source.alias("source"), F.when(source == "corpus", F.col("_a.category")).alias("category"), F.col("_a.id").alias("id"), range_("start"), range_("end"), F.col("_a.body").alias("body"))


def word_at(points: DataFrame, lines: DataFrame) -> DataFrame:
    """(points.*, typed): the word that each place (doc_id, line_no, char_no) is in or at the end of, comments included; empty without one."""
    spans = matched(lines, ["doc_id", "line_no"], F.col("text"), WORD)
    found = binned(spans, ["doc_id", "line_no"], F.col("start"), F.col("end"), F.struct("start", "end", "word"), BIN)
    rows = points.withColumn("_bin", F.floor(F.col("char_no") / BIN)).join(found, ["doc_id", "line_no", "_bin"], "left")
    hit = F.filter("_spans", lambda x: (F.col("char_no") >= x["start"]) & (F.col("char_no") <= x["end"]))
    return rows.select(*points.columns, F.coalesce(F.get(hit, F.lit(0))["word"], F.lit("")).alias("typed"))  # words do not touch


def _in_contexts(points: DataFrame, lines: DataFrame, contexts: DataFrame) -> DataFrame:
    """(points.*, _ctx) of places (doc_id, line_no, char_no) in lines: 2 in option settings, 1 in tests, else 0; contexts cover their end too."""
    pri = F.when(F.col("ctx") == "setopt", 2).otherwise(1)
    spans = binned(contexts.where(F.col("ctx").isin("setopt", "cond")), ["doc_id"], F.col("span_start"), F.col("span_end"), F.struct(F.col("span_start").alias("a"), F.col("span_end").alias("b"), pri.alias("pri")), BIN)
    rows = points.join(lines.select("doc_id", "line_no", "line_start").hint("merge"), ["doc_id", "line_no"]).withColumn("_at", F.col("line_start") + F.col("char_no"))
    rows = rows.withColumn("_bin", F.floor(F.col("_at") / BIN)).join(spans, ["doc_id", "_bin"], "left")
    hit = F.transform(F.filter("_spans", lambda x: (F.col("_at") >= x["a"]) & (F.col("_at") <= x["b"])), lambda x: x["pri"])
    return rows.select(*points.columns, F.coalesce(F.array_max(hit), F.lit(0)).alias("_ctx"))


def routed(points: DataFrame, lines: DataFrame, contexts: DataFrame) -> DataFrame:
    """(doc_id, line_no, char_no, route, typed): what is asked at each place: options, the operators of tests, or general code; arithmetic is general."""
    rows = _in_contexts(word_at(points.select("doc_id", "line_no", "char_no"), lines), lines, contexts)
    return rows.select("doc_id", "line_no", "char_no", F.when(F.col("_ctx") == 2, "setopt").when(F.col("_ctx") == 1, "cond").otherwise("general").alias("route"), "typed")


def completions(asks: DataFrame, lines: DataFrame, corpus: DataFrame) -> DataFrame:
    """(doc_id, route, typed, part, seq, label, category, id): what may be typed, for each distinct (doc_id, route, typed) of `asks`; `part` and `seq` order it.

    Options: names that what is typed begins, case and underscores aside, then the same with `no` before them, as `no_name`. Tests: every operator. General code: the
    document's own names that what is typed begins, in order of first use, then builtins, reserved words, precommands and parameters that are names; never what is typed itself.
    Names meet what is typed by their beginnings, in the document's own names within the document. corpus: (category, id, seq).
    """
    asks = asks.select("doc_id", "route", "typed").distinct()
    names = corpus.select("category", "id", "seq")
    beginnings = lambda rows, typed: begun(rows, "label", typed).unionByName(rows.withColumn("key", F.lit("")))
    shown = ["doc_id", "route", "typed", "part", "seq", "label", "category", "id"]

    options = names.where("category = 'option'")
    forms = options.select(F.lit(0).alias("part"), "seq", F.col("id").alias("label"), F.col("id").alias("shown"), "category", "id")
    forms = forms.unionByName(options.select(F.lit(1).alias("part"), "seq", F.concat(F.lit("no"), "id").alias("label"), F.concat(F.lit("no_"), "id").alias("shown"), "category", "id"))
    typed = asks.where("route = 'setopt'").withColumn("key", X.option_name("typed"))
    setopt = typed.join(beginnings(forms, typed), "key").drop("label").withColumnRenamed("shown", "label").select(*shown)

    tests = names.where("category = 'cond_op'").select(F.lit("cond").alias("route"), F.lit(0).alias("part"), "seq", F.col("id").alias("label"), "category", "id")
    cond = asks.where("route = 'cond'").join(tests, "route").select(*shown)

    general = asks.where("route = 'general'").withColumn("key", F.col("typed"))
    part = F.array_position(F.array(*map(F.lit, GENERAL)), F.col("category")).cast("int")
    listed = names.where(F.col("category").isin(*GENERAL)).where(X.is_word("id")).select(part.alias("part"), "seq", F.col("id").alias("label"), "category", "id")
    known = general.join(beginnings(listed, general), "key").where("label <> typed").select(*shown)
    first = Window.partitionBy("doc_id").orderBy("line_no", "pos")
    used = name_tokens(lines).select("doc_id", F.lit(0).alias("part"), (F.row_number().over(first) - 1).cast("long").alias("seq"), F.col("token").alias("label"), F.lit("document").alias("category"), F.lit(None).cast("string").alias("id"))
    own = general.join(beginnings(used, general), ["doc_id", "key"]).where("label <> typed").select(*shown)
    return setopt.unionByName(cond).unionByName(known).unionByName(own)


def _small(corpus: DataFrame) -> bool:
    """Whether all beginnings of a corpus's names may go to every task."""
    return (corpus.agg(F.sum(F.length("id") + 1)).first()[0] or 0) <= MOST_BEGINNINGS


def columns_of(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, char_no): every place of every line."""
    return lines.select("doc_id", "line_no", F.explode(F.sequence(F.lit(0).cast("long"), F.length("text").cast("long"))).alias("char_no"))


#: The patterns of words, names between white space, comments and declarations, as columns have them.
_WORDS, _NAMES = re.compile(WORD), re.compile(NAME, re.ASCII)


def _ranges(starts: list[int], texts: list[str], scan) -> list[list[tuple[int, int, int]]]:
    """Of each line, the (from, to, 2 or 1) of its places in option settings and in tests, ends included; found by the lines' starts."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for kind, a, b in text_contexts(starts, texts, scan):
        if kind != "arith":
            k = max(bisect_left(starts, a + 1) - 1, 0)
            while k < len(texts) and starts[k] <= b:
                out[k].append((max(a - starts[k], 0), min(b - starts[k], len(texts[k])), 2 if kind == "setopt" else 1))
                k += 1
    return out


def _codes(text: str, ranges: list[tuple[int, int, int]]) -> bytearray:
    """Of each place of a line: 2 in option settings, 1 in tests, else 0."""
    code = bytearray(len(text) + 1)
    for a, b, pri in sorted(ranges, key=lambda x: x[2]):
        code[a : b + 1] = bytes((pri,)) * (b + 1 - a)
    return code


_ROUTES = ("general", "cond", "setopt")


def _asks(starts: list[int], texts: list[str], scan) -> list[dict]:
    """What is asked at all places of a document, each (route, typed) once, with the document's own names that may be typed, by first use."""
    asked: dict[tuple[int, str], None] = {}
    for text, spans in zip(texts, _ranges(starts, texts, scan), strict=True):
        code, at = _codes(text, spans), 0
        for m in _WORDS.finditer(text):
            a, b = m.span()
            asked.update(((k, ""), None) for k in set(code[at:a]))
            asked.update(((k, m.group()), None) for k in set(code[a : b + 1]))
            at = b + 1
        asked.update(((k, ""), None) for k in set(code[at:]))
    seq = {x: k for k, x in enumerate(dict.fromkeys(x for text in texts for x in _NAMES.findall(text)))}
    names, out = sorted(seq), []
    for k, typed in asked:
        own, at = [], bisect_left(names, typed) if k == 0 else len(names)
        while at < len(names) and names[at].startswith(typed):
            if names[at] != typed:
                own.append({"seq": seq[names[at]], "label": names[at]})
            at += 1
        out.append({"route": _ROUTES[k], "typed": typed, "own": own})
    return out


def completions_everywhere(lines: DataFrame, corpus: DataFrame) -> DataFrame:
    """As `completions` of what is asked at every place of every line (`routed`).

    A document is one row: what is asked there and its own names are found in one pass over its lines, and no place becomes a row. The corpus's names go to all tasks by their beginnings if they are few enough.
    """
    if not _small(corpus):
        return completions(routed(columns_of(lines), lines, contexts(lines)), lines, corpus)
    one = pa.struct([("route", pa.string()), ("typed", pa.string()), ("own", pa.list_(pa.struct([("seq", pa.int64()), ("label", pa.string())])))])

    def answer(some: pa.RecordBatch, scan) -> pa.Array:
        return pa.array([_asks(*own, scan) for own in present(some.column("lines"))], pa.list_(one))

    asks = by_document(gathered(lines), "array<struct<route:string,typed:string,own:array<struct<seq:long,label:string>>>>", answer, most=LINES_AT_ONCE).select("doc_id", F.inline("_made"))

    names = corpus.select("category", "id", "seq")
    name = lambda route, part, rows, shown, label: rows.select(F.lit(route).alias("route"), shown.alias("_shown"), F.struct(part.alias("part"), "seq", label.alias("label"), "category", "id").alias("_item"))
    options, of = names.where("category = 'option'"), F.col("id")
    listed = names.where(F.col("category").isin(*GENERAL)).where(X.is_word("id"))
    part = F.array_position(F.array(*map(F.lit, GENERAL)), F.col("category")).cast("int")
    offered = name("setopt", F.lit(0), options, of, of).unionByName(name("setopt", F.lit(1), options, F.concat(F.lit("no"), of), F.concat(F.lit("no_"), of)))
    offered = offered.unionByName(name("general", part, listed, of, of)).unionByName(name("cond", F.lit(0), names.where("category = 'cond_op'"), F.lit(""), of))
    begun_ = F.explode(F.transform(F.sequence(F.lit(0), F.length("_shown")), lambda n: F.left("_shown", n)))
    offered = offered.select("route", begun_.alias("_key"), "_item").groupBy("route", "_key").agg(F.collect_list("_item").alias("_items"))

    key = F.when(F.col("route") == "setopt", X.option_name("typed")).when(F.col("route") == "cond", "").otherwise(F.col("typed"))
    rows = asks.withColumn("_key", key).join(F.broadcast(offered), ["route", "_key"], "left")  # their size is checked
    kind = "array<struct<part:int,seq:long,label:string,category:string,id:string>>"
    known = F.filter(F.coalesce("_items", F.array().cast(kind)), lambda x: (F.col("route") != "general") | (x["label"] != F.col("typed")))
    own = F.transform("own", lambda x: F.struct(F.lit(0).alias("part"), x["seq"].alias("seq"), x["label"].alias("label"), F.lit("document").alias("category"), F.lit(None).cast("string").alias("id")))
    return rows.select("doc_id", "route", "typed", F.inline(F.concat(known.cast(kind), own.cast(kind))))


#: As columns have them: white space in a line, and what a comment and a declaration look like.
_END, _EDGE, _TAIL = (re.compile(x, re.ASCII) for x in (f"[{TOKEN_ENDS}]", f"[{SYMBOL_EDGES}]", f"[^{TOKEN_ENDS}]*"))
_COMMENT, _COMMENT_MARK, _NUMBER, _FLAG = re.compile(r"\s*#", re.ASCII), re.compile(r"\s*# ?", re.ASCII), re.compile("[0-9]+"), re.compile("[+-][A-Za-z0-9]")
_DECLARED = (re.compile(rf"\s*({WORD})\s*\(\)", re.ASCII), re.compile(rf"\s*function\s+({WORD})", re.ASCII))
_NO = re.compile("no_?", re.IGNORECASE | re.ASCII)


class _Known:
    """What a task knows: a corpus's names (category, id, seq, group_op) and the flags (raw, id) that name one option. Answers are as those of `resolve`."""

    def __init__(self, names: list[tuple], letters: list[tuple]):
        self.seq: dict[tuple[str, str], int] = {}
        self.by_op: dict[str, list[tuple[str, str]]] = {}
        for category, id_, seq, op in names:
            self.seq[category, id_] = min(seq, self.seq.get((category, id_), seq))
            if category == "redir" and op:
                self.by_op.setdefault(op, []).append((id_, id_[len(op) :].lstrip(" ")))
        self.letters = dict(letters)
        self.lengths = sorted({len(x) for c, x in self.seq if c == "cond_op" and _END.search(x)})
        self.longest = max(map(len, self.by_op), default=0)

    def answer(self, category: str, raw: str) -> tuple[int, str] | None:
        """(seq, id) of a raw name in a category."""
        if category == "flag":
            return (0, self.letters[raw]) if raw in self.letters else None
        text = trim(raw)
        keys = [text]
        if category == "option":
            no = _NO.match(text)
            keys = [trim(x).replace("_", "").lower() for x in ([text, text[no.end() :]] if no else [text])]
        elif category == "redir":
            keys = [self._redir(text)]
        return next(((self.seq[category, k], k) for k in keys if k and (category, k) in self.seq), None)

    def _redir(self, text: str) -> str | None:
        number = _NUMBER.match(text)
        body = text[number.end() :] if number else text
        op = next((body[:n] for n in range(min(self.longest, len(body)), 0, -1) if body[:n] in self.by_op), None)
        if op is None:
            return None
        docs, rest = self.by_op[op], body[len(op) :]
        kind = "number" if _NUMBER.fullmatch(rest) else rest if rest in ("-", "p", "") else "word"
        same = docs if len(docs) == 1 else [d for d in docs if d[1] == kind]
        return same[0][0] if len(same) == 1 else None


def _line_answers(text: str, scan, known: _Known) -> tuple[list, list, list]:
    """(tokens, words, answers) of a line: the ranges of its tokens, its words, and what is known of its spans, as (need, from, to, rank, (category, id, start, end)); `need` is 2 in option settings, 1 for a token and -1 for a symbol in tests, 0 anywhere."""
    cut, facts, tokens, words, edges = scan.one(text)
    out = []

    def ask(need: int, start: int, end: int, pri: int, category: str, raw: str, more: int = 0) -> None:
        if start < end + more and (hit := known.answer(category, raw)):
            out.append((need, start, end + more, (pri, start - end if need < 0 else 0, hit[0], start), ("option" if category == "flag" else category, hit[1], *((None, None) if pri == 8 else (start, end)))))

    for start, end, word, precmd, head, reserved in tokens:
        ask(2, start, end, 0, "option", word)
        if _FLAG.fullmatch(word):
            ask(2, start, end, 1, "flag", word)
        ask(1, start, end, 2, "cond_op", word)
        if precmd:
            ask(0, start, end, 5, "precmd", word)
        if head:
            ask(0, start, end, 6, "builtin", word)
        if reserved:
            ask(0, start, end, 9, "complex_command", word)
            ask(0, start, end, 10, "reserved_word", word)
    for start in edges:
        for n in known.lengths:
            if start + n <= cut and ("cond_op", sign := text[start : start + n]) in known.seq and _END.search(sign) and (start + n == len(text) or _EDGE.match(text, start + n)) and trim(sign) == sign:
                ask(-1, start, start + n, 2, "cond_op", sign)
    for start, end, word in words:
        ask(0, start, end, 4, "shell_param", word, 1)
    if redir := next((f for f in facts if f["kind"] == "redir"), None):
        tail = _TAIL.match(text, redir["span_end"], cut).group()
        ask(0, redir["span_start"], redir["span_end"] + len(tail), 7, "redir", redir["text"] + tail)
    if subst := next((f for f in facts if f["kind"] == "process-subst"), None):
        ask(0, 0, len(text) + 1, 8, "process_subst", subst["text"][:2] + "...)")
    return [(a, b) for a, b, *_ in tokens], words, out


def _documented(numbers: list[int], texts: list[str]) -> dict[str, str]:
    """The functions of a document that have a comment, as `function_docs`."""
    above, below, names, run = {}, {}, [], []
    for number, text in zip([*numbers, None], [*texts, ""], strict=True):
        if number is not None and _COMMENT.match(text):
            run.append((number, _COMMENT_MARK.sub("", text, count=1)))
            continue
        if run:
            above[run[-1][0] + 1] = below[run[0][0] - 1] = "\n".join(x for _, x in run)
            run = []
        if number is not None and (m := (_DECLARED[0].match(text) if "(" in text else None) or (_DECLARED[1].match(text) if "function" in text else None)):
            names.append((number, m[1]))
    return {name: doc for number, name in names if (doc := above.get(number) or below.get(number))}


def _order(x: tuple) -> tuple:
    return (x[3], x[4] if x[4][2] is not None else (*x[4][:2], -1, -1))


def _line_hovers(text: str, ranges: list[tuple[int, int, int]], of: tuple[list, list, list], docs: dict[str, str]) -> list[tuple]:
    """(from, to, source, category, id, start, end, body) of a line's places, those that stand together and know the same as one."""
    tokens, words, answers = of
    if docs:
        answers = answers + [(0, a, b + 1, (3, 0, 0, a), ("function", w, a, b)) for a, b, w in words if w in docs]
    if not ranges:
        answers = [x for x in answers if x[0] == 0]
    by_token = bool(ranges) or any(x[4][2] is None for x in answers)
    edges = {0, len(text) + 1, *(x[k] for x in answers for k in (1, 2)), *(a for a, _, _ in ranges), *(b + 1 for _, b, _ in ranges)}
    edges = sorted(edges.union(*tokens) if by_token else edges)
    answers, code = sorted(answers, key=lambda x: x[1]), _codes(text, ranges) if ranges else None
    out: list[tuple] = []
    here: list[tuple] = []  # what covers the place, so the work is linear in a line
    k = t = 0
    for a, end in zip(edges, edges[1:]):
        here = [x for x in here if x[2] > a]
        while k < len(answers) and answers[k][1] <= a:
            here.append(answers[k])
            k += 1
        token = None
        if by_token:
            while t < len(tokens) and tokens[t][1] <= a:
                t += 1
            token = tokens[t] if t < len(tokens) and tokens[t][0] <= a else None
        ctx = code[a] if code else 0
        need = 2 if ctx == 2 else (1 if token else -1) if ctx == 1 else None
        best = min((x for x in here if x[0] == need), key=_order, default=None) or min((x for x in here if x[0] == 0), key=_order, default=None)
        if best is None:
            found = (None,) * 6
        else:
            category, id_, start, stop = best[4]
            if start is None:
                start, stop = token or (None, None)
            own = category == "function"
            found = ("function" if own else "corpus", None if own else category, id_, start, stop, docs[id_] if own else None)
        if out and out[-1][2:] == found:
            out[-1] = (out[-1][0], end - 1, *found)
        else:
            out.append((a, end - 1, *found))
    return out


def hovered_in(points: DataFrame, lines: DataFrame, corpus: DataFrame, flags: DataFrame) -> DataFrame:
    """As `hovered`, in the contexts of the lines themselves.

    A document is one row: its contexts, its commented functions and what is known of its lines are found in one pass, and places that stand together and know the same are one span. A place meets the
    spans of its part of the line as one row, and no name, context or function is joined. The corpus's names go to all tasks if they are few enough.
    """
    if not _small(corpus):
        return hovered(points, lines, contexts(lines), corpus, flags)
    names = [tuple(r) for r in corpus.where("id IS NOT NULL").select("category", "id", "seq", "group_op").collect()]  # their size is checked
    letters = [tuple(r) for r in flag_index(flags).select(F.concat("on", "char"), "id").collect()]
    span = pa.struct([("a", pa.int64()), ("z", pa.int64()), ("source", pa.string()), ("category", pa.string()), ("id", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("body", pa.string())])
    held: dict = {}

    def answer(some: pa.RecordBatch, scan) -> pa.Array:
        if not held:
            held.update(known=_Known(names, letters), lines={})
        known, seen = held["known"], held["lines"]
        flat = pc.list_flatten(some.column("lines"))
        numbers = [n for n, x in zip(flat.field("line_no").to_pylist(), flat.field("text").is_valid().to_pylist(), strict=True) if x]
        of, bins, sizes, upto, columns, at = [], [], [0], [0], [[] for _ in span], 0
        for starts, texts in present(some.column("lines")):
            own, at = numbers[at : at + len(texts)], at + len(texts)
            docs = _documented(own, texts)
            for number, text, ranges in zip(own, texts, _ranges(starts, texts, scan), strict=True):
                if text not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[text] = _line_answers(text, scan, known) if text else ([], [], [])
                last = None
                for row in _line_hovers(text, ranges, seen[text], docs):
                    for bin_ in range(row[0] // BIN, row[1] // BIN + 1):
                        if bin_ != last:
                            if last is not None:
                                upto.append(len(columns[0]))
                            of.append(number)
                            bins.append(last := bin_)
                        for column, value in zip(columns, row, strict=True):
                            column.append(value)
                upto.append(len(columns[0]))
            sizes.append(len(of))
        spans = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, span, strict=True)], fields=list(span))
        rows = pa.StructArray.from_arrays([pa.array(of, pa.int64()), pa.array(bins, pa.int64()), pa.ListArray.from_arrays(pa.array(upto, pa.int32()), spans)], names=["line_no", "_bin", "_spans"])
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), rows)

    kind = "array<struct<line_no:long,_bin:long,_spans:array<struct<a:long,z:long,source:string,category:string,id:string,start:long,end:long,body:string>>>>"
    found = by_document(gathered(lines), kind, answer, pieces=True, most=LINES_AT_ONCE).select("doc_id", F.inline("_made"))
    at = points.select("doc_id", "line_no", "char_no").withColumn("_bin", F.floor(F.col("char_no") / BIN)).join(found.hint("merge"), ["doc_id", "line_no", "_bin"], "left")
    at = at.withColumn("_a", F.get(F.filter("_spans", lambda x: (F.col("char_no") >= x["a"]) & (F.col("char_no") <= x["z"])), F.lit(0)))
    return at.select("doc_id", "line_no", "char_no", *(F.col(f"_a.{c}") for c in ("source", "category", "id", "start", "end", "body")))
