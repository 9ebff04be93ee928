"""What an editor asks, in cases worked out by hand."""

import time
from itertools import product

import pytest

from glossa.operators import editor, facts, textlines

CORPUS = [
    ("option", "autocd", 0, None), ("option", "notify", 1, None), ("cond_op", "-f", 0, None), ("cond_op", "&&", 1, None), ("cond_op", "<", 2, None), ("cond_op", "=~ <", 3, None), ("builtin", "cd", 0, None), ("builtin", "[", 1, None), ("builtin", "-x", 2, None),
    ("precmd", "noglob", 0, None), ("shell_param", "HOME", 0, None), ("redir", "> word", 0, ">"), ("redir", ">& number", 1, ">&"), ("redir", ">& word", 2, ">&"), ("process_subst", "<(...)", 0, None), ("complex_command", "while", 0, None),
    ("reserved_word", "while", 0, None), ("reserved_word", "do", 1, None),
]
#: Text, line, column, and what is known there: category and id, and the range.
HOVERS = [
    ("setopt AUTO_CD", 0, 9, ("option", "autocd", 7, 14)),
    ("setopt no_auto_cd", 0, 17, ("nothing",)),
    ("setopt NOTIFY", 0, 8, ("option", "notify", 7, 13)),
    ("setopt -J \\\n  +J -B", 1, 3, ("nothing",)),
    ("setopt -J \\\n  +J -B", 1, 5, ("option", "autocd", 5, 7)),
    ("ls -B", 0, 4, ("nothing",)),
    ("[[ -f x && y < z ]]", 0, 4, ("cond_op", "-f", 3, 5)),
    ("[[ -f x && y < z ]]", 0, 9, ("cond_op", "&&", 8, 10)),
    ("[[ -f x && y < z ]]", 0, 13, ("cond_op", "<", 13, 14)),
    ("[[ a =~ < b ]]", 0, 8, ("cond_op", "=~ <", 5, 9)),
    ("[[ a< b ]]", 0, 4, ("nothing",)),
    ("# says\nf() { f }", 1, 7, ("function", "f", 6, 7)),
    ("f() { f }\n# says", 0, 1, ("function", "f", 0, 1)),
    ("#\nf() { f }", 1, 0, ("nothing",)),
    ("print $HOME/x", 0, 11, ("shell_param", "HOME", 7, 11)),
    ("print x # HOME", 0, 11, ("nothing",)),
    ("noglob cd x", 0, 2, ("precmd", "noglob", 0, 6)),
    ("noglob cd x", 0, 8, ("builtin", "cd", 7, 9)),
    ("cd cd", 0, 4, ("builtin", "cd", 3, 5)),
    ("ls >&1", 0, 4, ("redir", ">& number", 3, 6)),
    ("ls > a >&1", 0, 8, ("nothing",)),
    ("ls <(a)", 0, 1, ("process_subst", "<(...)", 0, 2)),
    ("ls <(a)", 0, 2, ("process_subst", "<(...)", None, None)),
    ("while x; do", 0, 1, ("complex_command", "while", 0, 5)),
    ("while x; do", 0, 10, ("reserved_word", "do", 9, 11)),
]


def test_hover(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(HOVERS)], "doc_id long, text string")
    lines = textlines.doc_lines(docs)
    points = spark.createDataFrame([(i, line, char) for i, (_, line, char, _) in enumerate(HOVERS)], "doc_id long, line_no long, char_no long")
    corpus = spark.createDataFrame(CORPUS, "category string, id string, seq long, group_op string")
    flags = spark.createDataFrame([("autocd", [("J", "-"), ("B", "-")]), ("notify", [("J", "-")])], "id string, flags array<struct<char:string,on:string>>")
    rows = {r.doc_id: r for r in editor.hovered(points, lines, facts.analyzed(lines).where("kind = 'ctx'"), corpus, flags).collect()}
    assert len(rows) == len(HOVERS)
    for i, (text, *_, want) in enumerate(HOVERS):
        r = rows[i]
        got = ("nothing",) if r.source is None else (r.category or r.source, r.id, r.start, r.end)
        assert got == want, text


def test_function_comment_is_the_body(spark):
    lines = textlines.doc_lines(spark.createDataFrame([(1, "# a\n#  b\nf() { }\nf() { }\n# c\nf() { }")], "doc_id long, text string"))
    assert [(r.name, r.doc_text) for r in textlines.function_docs(textlines.function_index(lines)).collect()] == [("f", "c")]


SYMBOLS = ["<", "<=", "= <", "[", "&&", "( )"]


@pytest.mark.parametrize("text", ["< <= = < && ( ) [<]", "a<= <=", "[[ <] = <", "<&& && # <", ""])
def test_symbols_against_brute_force(spark, text):
    symbols = spark.createDataFrame(list(zip(SYMBOLS, range(9))), "id string, seq long")
    lines = textlines.doc_lines(spark.createDataFrame([(0, text)], "doc_id long, text string"))
    cut = facts.comment_start(text)
    edge = lambda k: not 0 <= k < len(text) or text[k] in " []"
    places = [(-len(s), i, a, s) for (i, s), a in product(enumerate(SYMBOLS), range(len(text))) if text.startswith(s, a) and edge(a - 1) and edge(a + len(s)) and a + len(s) <= (len(text) if cut is None else cut)]
    want = [min((p for p in places if p[2] <= k < p[2] - p[0]), default=None) for k in range(len(text) + 1)]
    points = spark.createDataFrame([(0, 0, k) for k in range(len(text) + 1)], "doc_id long, line_no long, char_no long")
    got = {r.char_no: (r.id, r.start) for r in editor.longest_symbol_at(points, editor.symbol_spans(lines, symbols)).collect()}
    assert [got[k] for k in range(len(text) + 1)] == [(w[3], w[2]) if w else (None, None) for w in want]


def test_completions(spark):
    lines = textlines.doc_lines(spark.createDataFrame([(1, "cdx cd one-two\nsetopt no_au \\\n  x\n[[ -f ]]\n(( cd ))")], "doc_id long, text string"))
    points = spark.createDataFrame([(1, 0, 5), (1, 1, 12), (1, 2, 1), (1, 3, 3), (1, 4, 5)], "doc_id long, line_no long, char_no long")
    routes = editor.routed(points, lines, facts.analyzed(lines).where("kind = 'ctx'"))
    assert sorted((r.line_no, r.route, r.typed) for r in routes.collect()) == [(0, "general", "cd"), (1, "setopt", "no_au"), (2, "setopt", ""), (3, "cond", ""), (4, "general", "cd")]
    corpus = spark.createDataFrame(CORPUS, "category string, id string, seq long, group_op string")
    rows = editor.completions(routes, lines, corpus).collect()
    of = lambda route, typed: [r.label for r in sorted(rows, key=lambda r: (r.part, r.seq)) if (r.route, r.typed) == (route, typed)]
    assert of("general", "cd") == ["cdx"]
    assert of("setopt", "no_au") == ["no_autocd"]
    assert of("setopt", "") == ["autocd", "notify", "no_autocd", "no_notify"]
    assert of("cond", "") == ["-f", "&&", "<", "=~ <"]


def test_editor_words(spark):
    lines = textlines.doc_lines(spark.createDataFrame([(1, "a.b -1.5e3x .5 foo-bar_1 $x=\"y\"\n\n3. -é")], "doc_id long, text string"))
    got = [(r.line_no, r.start, r.word) for r in textlines.editor_words(lines).orderBy("line_no", "start").collect()]
    assert got == [(0, 0, "a"), (0, 2, "b"), (0, 4, "-1.5e3x"), (0, 12, ".5"), (0, 15, "foo-bar_1"), (0, 26, "x"), (0, 29, "y"), (2, 0, "3"), (2, 3, "-é")]


TEXTS = [t for t, *_ in HOVERS] + ["cdx cd one-two\nsetopt no_au \\\n  x -y\n[[ -f ]] && cd cdx\n(( cd ))\n", "", "- --a b- \u0085c", "[ a && b ] || test -f cd\n\n# cd cdy\nsetopt NO_A"]


@pytest.mark.parametrize("most", [editor.MOST_BEGINNINGS, 0])
def test_completions_of_all_places(spark, monkeypatch, most):
    """As the completions of each place, for a small corpus and for one that does not go to the tasks."""
    lines = textlines.doc_lines(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"))
    corpus = spark.createDataFrame(CORPUS, "category string, id string, seq long, group_op string")
    routes = editor.routed(editor.columns_of(lines), lines, facts.contexts(lines))
    key = lambda df: sorted(map(str, df.collect()))
    want = key(editor.completions(routes, lines, corpus))
    monkeypatch.setattr(editor, "MOST_BEGINNINGS", most)
    assert key(editor.completions_everywhere(lines, corpus)) == want


@pytest.mark.parametrize("most", [editor.MOST_BEGINNINGS, 0])
def test_hovers_of_all_places(spark, monkeypatch, most):
    """As the hover of each place, for a small corpus and for one that does not go to the tasks."""
    more = ["# a\n#  b\nf() { }\nf() { f }\n# c\nf() { }\n\n #x\nfunction g h\ng f", "[[ a <= b]] && [[ <]] # HOME", "setopt NO_notify +J \\\n -J <(a) no__autocd # x\ncd >&p 12>&1 >&- > w", "ls <(a b) =(c) noglob HOME; while cd", "cd HOME; [[ -f x ]]; " * 40]
    lines = textlines.doc_lines(spark.createDataFrame(list(enumerate(TEXTS + more)), "doc_id long, text string"))
    corpus = spark.createDataFrame(CORPUS, "category string, id string, seq long, group_op string")
    flags = spark.createDataFrame([("autocd", [("J", "-"), ("B", "-")]), ("notify", [("J", "-"), ("J", "+")])], "id string, flags array<struct<char:string,on:string>>")
    key = lambda df: sorted(map(str, df.collect()))
    want = key(editor.hovered(editor.columns_of(lines), lines, facts.contexts(lines), corpus, flags))
    monkeypatch.setattr(editor, "MOST_BEGINNINGS", most)
    assert key(editor.hovered_in(editor.columns_of(lines), lines, corpus, flags)) == want


def test_hovers_of_a_long_line_take_time_in_proportion():
    known, scan = editor._Known([tuple(x) for x in CORPUS], []), facts._Scan(pieces=True)
    text = "cd HOME <(a); while [[ -f x ]]; do " * 3_000
    began = time.perf_counter()
    rows = editor._line_hovers(text, editor._ranges([0], [text], scan)[0], editor._line_answers(text, scan, known), {})
    assert rows[0][0] == 0 and rows[-1][1] == len(text) and time.perf_counter() - began < 20
