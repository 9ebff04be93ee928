"""Markup, extractors and rendering on small manuals."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glossa.operators import extract, markup, render

SAMPLE = """sect(Widgets)
startitem()
xitem(tt(alpha) var(x))
item(tt(beta) [ var(y) ])(
Turn the tt(beta) knob, see `tt(alpha)'.
)
item(tt(gamma))(
startitem()
item(tt(inner))(nested)
enditem()
)
enditem()
"""


def test_entries_of_a_sample():
    rows = [r for r in markup.entries_of("a.yo", SAMPLE) if r["kind"] in ("item", "xitem")]
    assert [(r["kind"], r["header"], r["item_depth"]) for r in rows] == [("xitem", "alpha x", 1), ("item", "beta [ y ]", 1), ("item", "gamma", 1)]
    assert rows[1]["body"] == "Turn the beta knob, see `alpha`."


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("tt(realpath+LPAR()3+RPAR())", "realpath(3)"),
        ("a tt(unclosed", "a tt(unclosed"),
        ("xtt(a) 1tt(b)", "xtt(a) 1b".replace("xtt(a)", "a")),
        ("manref(zsh)(1)", "zsh(1)"),
        ("tt(f())", "f()"),
        ("ifzman(no)ifnzman(yes)cindex(x)", "yes"),
        ("one (two) tt(three (four))", "one (two) three (four)"),
    ],
)
def test_rendering_of_macros(source, text):
    assert markup.plain(markup.parse(source)) == text


@settings(max_examples=200, deadline=None)
@given(st.text("ab_1 +()\n\\`'", max_size=60))
def test_parsing_never_fails_and_bodies_are_stable(text):
    once = markup.body_text(markup.plain(markup.parse(text)))
    assert not re.search(r"\n{3,}", once)


def test_paragraphs_code_and_references():
    raw = "One line\ntwo lines .\n\n\nsee\n\nThe Manual , now\n```zsh\na  b\n```\nend \\\n\nmore"
    assert markup.body_text(raw) == "One line two lines.\n\nsee The Manual, now\n```zsh\na  b\n```\nend more"


def rows_of(spark, file, text):
    return markup.entries(spark.createDataFrame([(file, text)], "file string, value string"))


def test_conditions(spark):
    e = rows_of(spark, "cond.yo", "startitem()\nxitem(tt(-a) var(file))\nitem(tt(-e) var(file))(true)\nitem(var(a) tt(=) var(b))(same)\nitem(tt(-z))(no operand)\nenditem()")
    got = [(r.op, list(r.operands), r.arity, r.desc) for r in extract.cond_ops(e).orderBy("seq").collect()]
    assert got == [("-e", ["file"], "unary", "true"), ("-a", ["file"], "unary", "true"), ("=", ["a", "b"], "binary", "same")]


def test_builtins_override_macros_and_share_synopses(spark):
    text = "alias(x)(y)\nmodule(m)(zsh/m)\nstartitem()\nxitem(tt(m) var(a))\nxitem(SPACES()tt([ more ]))\nitem(tt(n) var(b))(Same as tt(q).  The zsh/n Module\n)\nenditem()\nzlecmd(z)"
    got = {r.name: (list(r.synopsis), r.module, r.alias_of) for r in extract.builtins(rows_of(spark, "builtins.yo", text)).collect()}
    assert got["x"] == (["x"], None, "y")
    assert got["m"] == (["m a", "[ more ]"], "zsh/n", "q") and got["n"] == (["n b", "[ more ]"], "zsh/n", "q")
    assert got["z"][0] == ["z"]


def test_tied_parameters_and_pending_heads(spark):
    text = "sect(Parameters Set By The Shell)\nstartitem()\nvindex(X)\nxitem(tt(first))\nitem(tt(path) <S> (tt(PATH) <S>))(Paths.)\nenditem()"
    got = [(r.name, r.tied) for r in extract.shell_params(rows_of(spark, "params.yo", text)).orderBy("seq").collect()]
    assert got == [("path", "PATH"), ("PATH", "path"), ("first", None)]


def test_expansions_by_group_and_unknown_ones(spark):
    text = "sect(Parameter Expansion)\nstartitem()\nxitem(tt(${)var(name)tt(:-)var(word)tt(}))\nitem(tt(${)var(name)tt(-)var(word)tt(}))(Default.)\nenditem()"
    got = [(r.sig, r.order_in_group, r.sub_kind, list(r.placeholders)) for r in extract.param_expns(rows_of(spark, "expn.yo", text)).orderBy("seq").collect()]
    assert got == [("${name:-word}", 0, "default", ["name", "word"]), ("${name-word}", 1, "default", ["name", "word"])]
    with pytest.raises(Exception, match="unknown parameter expansion"):
        extract.param_expns(rows_of(spark, "expn.yo", text.replace(":-", ":!"))).collect()


def test_complex_commands_first_wins_with_alternates(spark):
    text = "sect(Complex Commands)\nstartitem()\nitem(tt(if) var(list) tt(then) var(list) tt(fi))(If.)\nitem(tt(if) var(other))(Again.)\nitem(tt({) var(try) tt(} always {) var(l) tt(}))(Try.)\nenditem()\nsect(Alternate Forms For Complex Commands)\nstartitem()\nitem(tt(if) var(list) tt({) var(list) tt(}))(Short.)\nenditem()"
    got = [(r.name, r.desc, [a.template for a in r.alternate_forms], list(r.body_keywords)) for r in extract.complex_commands(rows_of(spark, "grammar.yo", text)).orderBy("seq").collect()]
    assert got == [("if", "If.", ["if list { list }"], ["then", "fi"]), ("{try}always", "Try.", [], ["always"])]


def test_suspicious_rules(spark):
    docs = spark.createDataFrame([(1, "fine `x`"), (2, "see ."), (3, "tt(x) and a`b"), (4, "a\\\nb, , c"), (5, "```\na`b\n```\nabc+(d)")], "id long, md string")
    got = sorted((r.id, r.ord) for r in render.suspicious(docs).collect())
    assert got == [(2, 0), (3, 2), (3, 3), (4, 1), (4, 5), (5, 4)]


def test_parsing_takes_any_depth_in_linear_time():
    n = 10_000
    assert markup.plain(markup.parse("tt(" * n)) == "tt(" * n
    assert markup.plain(markup.parse("tt(a " * n + ")" * n)) == ("a " * n).strip()
    assert markup.plain(markup.parse("a tt(b tt(c) d")) == "a tt(b c d"
    assert markup.tokens(markup.parse("noderef(" * n + "tt(x)" + ")" * n)) == [("tt", "x")]


def test_bodies():
    assert markup.body_text("a \\\n\n\\\nb\n\\\nc") == "a b\n\nc"
    assert markup.body_text("```\nx  \n\n\ny\n```\nas described in\n\nPart `two' .") == "```\nx\n\ny\n```\nas described in Part `two`."
