"""The 22 record collections, from entry rows.

Each extractor takes the entries of any number of manuals and returns typed rows with `manual` and `seq`, their order in it. Closed sets fail loudly on
names that they do not hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import closed, flag_args, option_name
from .corpus import last_wins, merged_duplicates, united
from .markup import alias_groups

#: Sections of options.
OPTION_SECTIONS = ("Changing Directories", "Completion", "Expansion and Globbing", "History", "Initialisation", "Input/Output", "Job Control", "Prompting", "Scripts and Functions", "Shell Emulation", "Shell State", "Zle", "Option Aliases")
#: Emulations by default mark.
DEFAULTS = {"D": ("csh", "ksh", "sh", "zsh"), "C": ("csh",), "K": ("ksh",), "S": ("sh",), "Z": ("zsh",)}
#: Precommand modifiers.
PRECMDS = ("-", "builtin", "command", "exec", "nocorrect", "noglob")
#: Words in the bodies of complex commands, and the words that open one.
BODY_WORDS = ("do", "done", "in", "then", "elif", "else", "fi", "esac", "always", "end")
OPENING_WORDS = ("if", "while", "until", "repeat", "case", "select", "function", "time")
#: Process substitutions.
PROCESS_SUBSTS = (("<(...)", "<(list)"), (">(...)", ">(list)"), ("=(...)", "=(list)"))
#: Parameter expansions by kind, as the manual writes them; names between marks are placeholders.
EXPANSIONS = {
    "plain": "${name}", "set-test": "${+name}", "default": "${name-word} ${name:-word}", "alt": "${name+word} ${name:+word}", "assign": "${name=word} ${name:=word} ${name::=word}",
    "err": "${name?word} ${name:?word}", "strip-pre": "${name#pattern} ${name##pattern}", "strip-suf": "${name%pattern} ${name%%pattern}", "exclude": "${name:#pattern}",
    "array-remove": "${name:|arrayname}", "array-retain": "${name:*arrayname}", "array-zip": "${name:^arrayname} ${name:^^arrayname}", "substring": "${name:offset} ${name:offset:length}",
    "replace": "${name/pattern/repl} ${name//pattern/repl} ${name:/pattern/repl}", "length": "${#spec}", "rc-expand": "${^spec} ${^^spec}", "word-split": "${=spec} ${==spec}", "glob-subst": "${~spec} ${~~spec}",
}
#: Job specifications in the manual's order.
JOB_SPECS = (("%number", "number"), ("%string", "string"), ("%?string", "contains"), ("%%", "current"), ("%+", "current"), ("%-", "previous"))
#: The file of each collection.
FILES = {
    "option": "options.yo", "cond_op": "cond.yo", "builtin": "builtins.yo", "precmd": "grammar.yo", "shell_param": "params.yo", "complex_command": "grammar.yo", "reserved_word": "grammar.yo",
    "redir": "redirect.yo", "process_subst": "expn.yo", "param_expn": "expn.yo", "subscript_flag": "params.yo", "param_flag": "expn.yo", "history": "expn.yo", "glob_op": "expn.yo",
    "glob_flag": "expn.yo", "glob_qualifier": "expn.yo", "prompt_escape": "prompt.yo", "zle_widget": "zle.yo", "keymap": "zle.yo", "job_spec": "jobs.yo", "arith_op": "arith.yo", "special_function": "func.yo",
}



def _of(e: DataFrame, category: str) -> DataFrame:
    return e.where(F.col("file") == FILES[category])


def _items(e: DataFrame, depth: int | None = 1) -> DataFrame:
    rows = e.where(F.col("kind").isin("item", "xitem"))
    return rows if depth is None else rows.where(F.col("item_depth") == depth)


def _sitems(e: DataFrame) -> DataFrame:
    return e.where((F.col("kind") == "sitem") & (F.col("sitem_depth") == 1))


def _in(e: DataFrame, name: str) -> DataFrame:
    """Rows from a heading to the next of either level."""
    return e.where((F.col("section") == name) & F.col("first_section"))


def _in_sect(e: DataFrame, name: str) -> DataFrame:
    """Rows of a section with all its subsections."""
    return e.where((F.col("sect") == name) & F.col("first_sect"))


def _texts(kind: str, column: str = "header_tokens", trim: bool = True) -> Column:
    found = F.transform(F.filter(column, lambda t: t["kind"] == kind), lambda t: F.trim(t["text"]) if trim else t["text"])
    return F.filter(found, lambda x: x != "") if trim else found


def _tt(i: int = 0, trim: bool = True) -> Column:
    return F.get(_texts("tt", trim=trim), F.lit(i))


def _seq(*order: str | Column) -> Column:
    return (F.row_number().over(Window.partitionBy("manual").orderBy(*order)) - 1).cast("long").alias("seq")


def _flat(e: DataFrame, head: Column, scope: tuple[str, ...] = ("manual", "file")) -> DataFrame:
    """Aliased entries, each with the body it shares: the entry with the body first, then its aliases."""
    return alias_groups(e, head, scope).withColumn("desc", F.col("_body"))


def _filled(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def _flags(signed: Column) -> Column:
    """array<struct<char,on>> of texts that are a sign and a character."""
    ok = F.filter(signed, lambda x: x.rlike("^[+-][A-Za-z0-9]$"))
    return F.transform(ok, lambda x: F.struct(F.substring(x, 2, 1).alias("char"), F.substring(x, 1, 1).alias("on")))


def options(entries: DataFrame) -> DataFrame:
    e = _of(entries, "option")
    rows = _items(e, None).where("body IS NOT NULL").withColumn("display", _tt()).where(F.col("display").rlike("^[A-Z_]+$"))
    sign = _tt()
    listed = _sitems(_in(e, "Default set")).where("sitem_list = 1").select("manual", "pos", sign.alias("flag"), F.trim("body_plain").alias("target"))
    listed = listed.where(F.col("flag").rlike("^[+-][A-Za-z0-9]$") & (F.col("target") != ""))
    flip = F.when(F.substring("flag", 1, 1) == "-", "+").otherwise("-")
    on = F.when(F.startswith("target", F.lit("NO_")), flip).otherwise(F.substring("flag", 1, 1))
    single = listed.select("manual", option_name(F.regexp_replace("target", "^NO_", "")).alias("name"), "pos", F.struct(F.substring("flag", 2, 1).alias("char"), on.alias("on")).alias("f"))
    single = single.groupBy("manual", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "f"))), lambda x: x["f"]).alias("_listed"))
    marks = F.regexp_extract_all("header_plain", F.lit("<([DKSCZ])>"), F.lit(1))
    table = F.create_map(*[x for k, v in DEFAULTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    target = F.get(_texts("tt", "body_tokens"), F.lit(0))
    alias = F.when((F.col("section") == "Option Aliases") & target.isNotNull(), F.struct(option_name(target).alias("target"), F.col("body_plain").rlike(r"\bNO_").alias("negated")))
    own = _flags(F.slice(_texts("tt"), 2, 99))
    rows = rows.withColumn("name", option_name("display")).join(single, ["manual", "name"], "left")
    none = F.array().cast("array<struct<char:string,on:string>>")
    return rows.select(
        _seq("pos"), "manual", "name", "display", F.array_distinct(F.concat(F.coalesce("_listed", none), own)).alias("flags"),
        F.array_distinct(F.flatten(F.transform(marks, lambda m: table[m]))).alias("default_in"),
        closed("section", OPTION_SECTIONS, "option section").alias("category"), F.col("body").alias("desc"), alias.alias("alias_of"),
    )


def cond_ops(entries: DataFrame) -> DataFrame:
    places = F.transform("header_tokens", lambda t, i: F.struct(i.alias("i"), t["kind"].alias("kind"), t["text"].alias("text")))
    op = F.get(F.filter(places, lambda t: (t["kind"] == "tt") & t["text"].rlike(r"^(?:[-=!<>~|&]|\w)")), F.lit(0))
    operands = _texts("var", trim=False)
    binary = F.exists(places, lambda t: (t["kind"] == "var") & (t["i"] < op["i"]))
    need = F.when(binary, 2).otherwise(1)
    enough = op.isNotNull() & (F.size(F.filter(F.slice(operands, F.lit(1), need), lambda x: x != "")) == need)
    head = F.when(enough, F.struct(op["text"].alias("op"), F.slice(operands, F.lit(1), need).alias("operands"), F.when(binary, "binary").otherwise("unary").alias("arity")))
    rows = _flat(_items(_of(entries, "cond_op"), None), head)
    return rows.select(_seq("_group", "_place"), "manual", "_head.op", "_head.operands", "desc", "_head.arity")


def builtins(entries: DataFrame) -> DataFrame:
    e = _of(entries, "builtin")
    tidy = F.regexp_replace(F.regexp_replace(F.regexp_replace("header_plain", r"\\\n", "\n"), r"(?m)\\$", ""), r"\n{2,}", "\n")
    synopsis = _filled(F.trim(F.array_join(F.transform(F.split(tidy, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " "))), "\n")))
    rows = alias_groups(_items(e, None), synopsis)
    own = Window.partitionBy("manual", "file", "_group")
    lines = F.array_sort(F.collect_list(F.when(F.col("indented"), F.struct("pos", F.col("_head").alias("t")))).over(own))
    rows = rows.withColumn("_tail", F.transform(lines, lambda x: x["t"])).where(~F.col("indented"))
    name = F.regexp_extract("_head", r"^(\S+)", 1)
    same = F.coalesce(_filled(F.regexp_extract("_body_plain", r"\bSame as `([^']*)'", 1)), _filled(F.regexp_extract("_body_plain", r"\bSame as (?!`[^']*')([^.\s]+)", 1)))
    module = _filled(F.regexp_extract(F.regexp_replace("_body_plain", r"\s+", " "), r"\bThe (\S+) Module\b", 1))
    last = rows.select("manual", (F.struct(F.lit(1).alias("k"), "_group", "pos")).alias("seq"), name.alias("name"), F.concat(F.array("_head"), "_tail").alias("synopsis"), F.col("_body").alias("desc"), module.alias("module"), same.alias("alias_of"))
    m = e.where(F.col("kind").isin("alias", "module", "zlecmd") & (F.col("header") != "") & ((F.col("kind") == "zlecmd") | (F.col("second") != "")))
    of = lambda kind: F.when(F.col("kind") == kind, F.col("second"))
    desc = F.when(F.col("kind") == "alias", F.concat(F.lit("Same as `"), "second", F.lit("`."))).when(F.col("kind") == "module", F.concat(F.lit("Available via the `"), "second", F.lit("` module."))).otherwise("See ZLE builtins.")
    first = m.select("manual", F.struct(F.lit(0).alias("k"), F.col("pos").alias("_group"), "pos").alias("seq"), F.col("header").alias("name"), F.array("header").alias("synopsis"), desc.alias("desc"), of("module").alias("module"), of("alias").alias("alias_of"))
    kept = last_wins(first.unionByName(last).where("name <> ''"), ["manual", "name"])
    return kept.select(_seq("seq"), "manual", "name", "synopsis", "desc", "module", "alias_of")


def precmds(entries: DataFrame) -> DataFrame:
    name = F.regexp_extract("header", r"^(\S+)", 1)
    rows = _items(_of(entries, "precmd"), None).where((F.col("section") == "Precommand Modifiers") & F.col("body").isNotNull() & name.isin(*PRECMDS))
    return rows.select(_seq("pos"), "manual", name.alias("name"), F.array("header").alias("synopsis"), F.col("body").alias("desc"))


def shell_params(entries: DataFrame) -> DataFrame:
    """Parameters of the shell, then those of widgets; tied pairs give two rows; pending heads come after those of the entry itself."""
    params, zle = _of(entries, "shell_param"), entries.where(F.col("file") == "zle.yo")
    parts = [(_items(_in(params, long)).where("item_list = 1"), short, True) for long, short in (("Parameters Set By The Shell", "shell-set"), ("Parameters Used By The Shell", "shell-used"))]
    parts.append((_items(_in_sect(zle, "User-Defined Widgets")).where("item_list_sect = 1"), "zle-widget", False))
    out = None
    for k, (rows, section, may_tie) in enumerate(parts):
        name, tied = _tt(), _tt(1)
        shown = F.concat(F.lit("("), tied)
        ties = F.lit(may_tie) & tied.isNotNull() & (F.contains("header_plain", F.concat(shown, F.lit(" "))) | F.contains("header_plain", F.concat(shown, F.lit(")"))))
        pair = lambda a, b: F.struct(a.alias("name"), b.alias("tied"))
        heads = F.when(ties, F.array(pair(name, tied), pair(tied, name))).when(name.isNotNull(), F.array(pair(name, F.lit(None).cast("string"))))
        flat = _flat(rows, heads).select("manual", "_group", "_place", "desc", F.posexplode("_head").alias("i", "h"))
        part = flat.select("manual", F.lit(k).alias("k"), "_group", "_place", "i", F.col("h.name"), F.col("h.name").alias("sig"), "desc", F.lit(section).alias("section"), F.col("h.tied"))
        out = part if out is None else out.unionByName(part)
    return out.select(_seq("k", "_group", "_place", "i"), "manual", "name", "sig", "desc", "section", "tied")


def _head_key(sig: Column) -> Column:
    word = F.regexp_extract(sig, r"^(\S*)", 1)
    return (
        F.when(sig.startswith("[["), "[[")
        .when(sig.startswith("("), "(")
        .when(sig.startswith("{"), F.when(sig.rlike(r"\}\s*always\s*\{"), "{try}always").otherwise("{"))
        .when(word.isin(*OPENING_WORDS), word)
        .when(word == "for", F.when(sig.startswith("for (("), "for-arith").otherwise("for"))
        .when(word == "foreach", "for")
    )


def _body_words(column: str = "header_tokens") -> Column:
    words = F.flatten(F.transform(_texts("tt", column, trim=False), lambda x: F.split(F.lower(x), r"\s+")))
    return F.array_distinct(F.filter(words, lambda w: w.isin(*BODY_WORDS)))


def complex_commands(entries: DataFrame) -> DataFrame:
    e = _of(entries, "complex_command")
    base = alias_groups(_items(_in(e, "Complex Commands")).where("item_list = 1"), F.col("header"))
    base = base.withColumn("key", _head_key(F.col("_head"))).where("key IS NOT NULL")
    first = base.groupBy("manual", "_group").agg(F.min_by(F.struct("key", F.col("_head").alias("sig"), _body_words().alias("words"), F.col("_body").alias("desc")), F.struct(F.col("pos"))).alias("w"))
    first = first.groupBy("manual", "w.key").agg(F.min("_group").alias("at"), F.min_by("w", "_group").alias("w"))
    alt = _items(_in(e, "Alternate Forms For Complex Commands")).where("item_list = 1 AND header <> ''").withColumn("key", _head_key(F.col("header"))).where("key IS NOT NULL")
    form = F.struct(F.col("header").alias("template"), _body_words().alias("keywords"), F.lit(None).cast("string").alias("requires"))
    alt = alt.select("manual", "key", "pos", form.alias("form")).groupBy("manual", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "form"))), lambda x: x["form"]).alias("forms"))
    none = F.array().cast("array<struct<template:string,keywords:array<string>,requires:string>>")
    rows = first.join(alt, ["manual", "key"], "left")
    return rows.select(_seq("at"), "manual", F.col("key").alias("name"), "w.sig", "w.desc", F.lit("Complex Commands").alias("section"), F.coalesce("forms", none).alias("alternate_forms"), F.col("w.words").alias("body_keywords"))


def reserved_words(entries: DataFrame) -> DataFrame:
    """The words of the manual's list, then the closing brace, which is recognized anywhere."""
    e = _in(_of(entries, "reserved_word"), "Reserved Words")
    words = e.select("manual", "pos", F.explode(F.filter("header_tokens", lambda t: t["kind"] == "tt")).alias("t")).where(F.col("t.text").rlike(r"\bdo\b") & F.col("t.text").rlike(r"\btypeset\b"))
    listed = words.groupBy("manual").agg(F.min_by("t.text", "pos").alias("text")).select("manual", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("i", "name")).where("name NOT IN ('', '}')").select("manual", F.col("i").cast("long").alias("i"), "name", F.lit("command").alias("pos"))
    brace = listed.select("manual").distinct().select("manual", F.lit(1 << 30).cast("long"), F.lit("}"), F.lit("any"))
    rows = listed.union(brace)
    return rows.select(_seq("i"), "manual", "name", F.col("name").alias("sig"), F.lit("Reserved Words").alias("section"), "pos")


def redirections(entries: DataFrame) -> DataFrame:
    e = _of(entries, "redir").withColumn("_there", F.max(F.col("section") == "Redirection").over(Window.partitionBy("manual", "file")))
    e = e.where(~F.col("_there") | ((F.col("section") == "Redirection") & F.col("first_section")))  # a file without the heading is all about it
    rows = _flat(_items(e), _filled(F.col("header")))
    return rows.select(_seq("_group", "_place"), "manual", F.col("_head").alias("sig"), F.regexp_extract("_head", r"^\S+", 0).alias("group_op"), "desc", F.lit("Redirection").alias("section"))


def process_substs(entries: DataFrame) -> DataFrame:
    """Fixed rows, if the manual has their section."""
    there = _of(entries, "process_subst").where((F.col("section") == "Process Substitution") & F.col("kind").isin("sect", "subsect")).select("manual").distinct()
    listed = F.array(*[F.struct(F.lit(op).alias("op"), F.lit(sig).alias("sig")) for op, sig in PROCESS_SUBSTS])
    return there.select("manual", F.posexplode(listed).alias("i", "r")).select("manual", F.col("i").cast("long").alias("seq"), "r.op", "r.sig", F.lit("Process Substitution").alias("section"))


def param_expns(entries: DataFrame) -> DataFrame:
    rows = alias_groups(_items(_in(_of(entries, "param_expn"), "Parameter Expansion")), _filled(F.col("header")))
    own = Window.partitionBy("manual", "file", "_group")
    sigs = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("_head").alias("sig"))).over(own)), lambda x: x["sig"])
    kinds = F.create_map(*[F.lit(x) for kind, listed in EXPANSIONS.items() for sig in listed.split() for x in (sig, kind)])
    rows = rows.select("manual", "_group", "pos", F.col("_head").alias("sig"), F.col("_body").alias("desc"), sigs.alias("group_sigs"))
    known = [s for x in EXPANSIONS.values() for s in x.split()]
    order = F.row_number().over(Window.partitionBy("manual", "_group").orderBy("pos")) - 1
    rows = rows.withColumn("order_in_group", order).withColumn("sig", closed("sig", known, "parameter expansion"))
    return rows.select(_seq("_group", "pos"), "manual", "sig", "group_sigs", "order_in_group", kinds[F.col("sig")].alias("sub_kind"), F.regexp_extract_all("sig", F.lit("([a-z]+)"), F.lit(1)).alias("placeholders"), "desc", F.lit("Parameter Expansion").alias("section"))


def _flag_section(e: DataFrame, section: str) -> DataFrame:
    rows = _items(_in(e, section)).where("body IS NOT NULL")
    return rows.select(_seq("pos"), "manual", F.col("header").alias("flag"), flag_args("header").alias("args"), F.col("header").alias("sig"), F.col("body").alias("desc"), "section")


def subscript_flags(entries: DataFrame) -> DataFrame:
    return _flag_section(_of(entries, "subscript_flag"), "Subscript Flags")


def param_flags(entries: DataFrame) -> DataFrame:
    return _flag_section(_of(entries, "param_flag"), "Parameter Expansion Flags")


def history(entries: DataFrame) -> DataFrame:
    e = _of(entries, "history")
    out = None
    for k, (section, kind) in enumerate((("Event Designators", "event-designator"), ("Word Designators", "word-designator"), ("Modifiers", "modifier"))):
        if kind == "word-designator":
            rows = _sitems(_in(e, section)).where("sitem_list = 1 AND body IS NOT NULL").select("manual", F.col("pos").alias("_group"), F.lit(0).alias("_place"), F.col("header").alias("_head"), F.col("body").alias("desc"))
        else:
            rows = _flat(_items(_in(e, section)).where("item_list = 1"), _filled(F.col("header"))).select("manual", "_group", "_place", "_head", "desc")
        part = rows.select("manual", F.lit(k).alias("k"), "_group", "_place", F.col("_head").alias("key"), F.col("_head").alias("sig"), "desc", F.lit(section).alias("section"), F.lit(kind).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out.select(_seq("k", "_group", "_place"), "manual", "key", "sig", "desc", "section", "kind")


def glob_ops(entries: DataFrame) -> DataFrame:
    e = _of(entries, "glob_op")
    out = None
    for k, (section, kind) in enumerate((("Glob Operators", "standard"), ("ksh-like Glob Operators", "ksh-like"))):
        rows = _flat(_items(_in(e, section)), _filled(F.col("header")))
        part = rows.select("manual", F.lit(k).alias("k"), "_group", "_place", F.col("_head").alias("op"), F.col("_head").alias("sig"), "desc", F.lit(section).alias("section"), F.lit(kind).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out.select(_seq("k", "_group", "_place"), "manual", "op", "sig", "desc", "section", "kind")


def _glob_marks(e: DataFrame, section: str, apart: bool) -> DataFrame:
    rows = _items(_in(e, section)).where("item_list = 1 AND body <> ''")
    tt, var = _texts("tt", trim=False), _texts("var", trim=False)
    one = F.array(F.struct(F.coalesce(F.get(tt, F.lit(0)), F.col("header")).alias("flag"), var.alias("args"), F.col("header").alias("sig")))
    each = F.transform(tt, lambda x: F.struct(x.alias("flag"), F.array().cast("array<string>").alias("args"), x.alias("sig")))
    listed = F.when(F.lit(apart) & (F.size(var) == 0) & (F.size(tt) > 1), each).otherwise(one)
    rows = rows.select("manual", "pos", F.posexplode(listed).alias("i", "r"), F.col("body").alias("desc"), "section")
    return rows.select(_seq("pos", "i"), "manual", "r.flag", "r.args", "r.sig", "desc", "section")


def glob_flags(entries: DataFrame) -> DataFrame:
    return _glob_marks(_of(entries, "glob_flag"), "Globbing Flags", True)


def glob_qualifiers(entries: DataFrame) -> DataFrame:
    return _glob_marks(_of(entries, "glob_qualifier"), "Glob Qualifiers", False)


def prompt_escapes(entries: DataFrame) -> DataFrame:
    key = _filled(F.regexp_extract("header", r"^%\S+", 0))
    rows = _flat(_items(_of(entries, "prompt_escape")), F.when(key.isNotNull(), F.struct(key.alias("key"), F.col("header").alias("sig"))))
    return rows.select(_seq("_group", "_place"), "manual", "_head.key", "_head.sig", "desc", F.col("_section").alias("section"))


def zle_widgets(entries: DataFrame) -> DataFrame:
    e = _of(entries, "zle_widget")
    out = None
    for k, (rows, kind) in enumerate(((_in_sect(e, "Standard Widgets"), "standard"), (_in(e, "Special Widgets"), "special"))):
        name = _filled(F.get(_texts("tt", trim=False), F.lit(0)))
        flat = _flat(_items(rows), F.when(name.isNotNull(), F.struct(name.alias("name"), F.col("header").alias("sig"))))
        part = flat.select("manual", F.lit(k).alias("k"), "_group", "_place", "_head.name", "_head.sig", "desc", F.col("_section").alias("section"), F.lit(kind).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out.select(_seq("k", "_group", "_place"), "manual", "name", "sig", "desc", "section", "kind")


def keymaps(entries: DataFrame) -> DataFrame:
    rows = _sitems(_in_sect(_of(entries, "keymap"), "Keymaps")).where("sitem_list_sect = 1 AND body IS NOT NULL").withColumn("name", _tt()).where("name IS NOT NULL")
    linked = F.when(F.col("name") == "emacs", F.array(F.lit("main"))).otherwise(F.array().cast("array<string>"))
    return rows.select(_seq("pos"), "manual", "name", F.col("name").alias("sig"), F.col("body").alias("desc"), F.lit("Keymaps").alias("section"), (F.col("name") == ".safe").alias("is_special"), linked.alias("linked_from"))


def job_specs(entries: DataFrame) -> DataFrame:
    """The manual's rows by their place, next to the fixed keys."""
    rows = _sitems(_in_sect(_of(entries, "job_spec"), "Jobs")).where("sitem_list_sect = 1").withColumn("seq", _seq("pos"))
    table = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("kind")) for k, v in JOB_SPECS])
    spec = F.get(table, F.col("seq").cast("int"))
    return rows.where(spec.isNotNull() & F.col("body").isNotNull()).select("manual", "seq", spec["key"].alias("key"), F.col("header").alias("sig"), F.col("body").alias("desc"), F.lit("Jobs").alias("section"), spec["kind"].alias("kind"))


def arith_ops(entries: DataFrame) -> DataFrame:
    rows = _sitems(_of(entries, "arith_op")).where("sitem_list_file = 1 AND body IS NOT NULL")
    low = F.lower("body")
    arity = F.when(low.startswith("unary"), "unary").when(low.startswith("ternary"), "ternary").otherwise("binary")
    ops = F.split(F.trim(F.get(_texts("tt", trim=False), F.lit(0))), r"\s+")
    long = rows.select("manual", "pos", F.posexplode(ops).alias("i", "op"), arity.alias("arity"), F.col("body").alias("desc")).where("op <> ''")
    long = long.select("manual", F.struct("pos", "i").alias("seq"), "op", "arity", "desc")
    kept = merged_duplicates(long, ["manual", "op"], "seq", "arity", "desc", "overloaded")
    return kept.select(_seq("seq"), "manual", "op", F.col("op").alias("sig"), "desc", F.lit("Arithmetic Evaluation").alias("section"), "arity")


def special_functions(entries: DataFrame) -> DataFrame:
    e = _of(entries, "special_function")
    hooks = _items(_in(e, "Hook Functions")).where("item_list = 1 AND body IS NOT NULL").withColumn("name", _tt()).where("name IS NOT NULL")
    hooks = hooks.select("manual", F.lit(0).alias("k"), "pos", "name", F.col("header").alias("sig"), F.col("body").alias("desc"), "section", F.lit("hook").alias("kind"), F.concat("name", F.lit("_functions")).alias("hook_array"))
    template = F.size(_texts("var", trim=False)) > 0
    literal = F.coalesce(_filled(F.regexp_extract(F.trim("header"), "^TRAP[A-Z0-9]+", 0)), _tt())
    traps = _items(_in(e, "Trap Functions")).where("item_list = 1 AND body IS NOT NULL")
    traps = traps.withColumn("name", F.when(template, F.concat(F.coalesce(_tt(), F.lit("")), F.lit("NAL"))).otherwise(literal)).where("name IS NOT NULL")
    traps = traps.select("manual", F.lit(1).alias("k"), "pos", "name", F.col("header").alias("sig"), F.col("body").alias("desc"), "section", F.when(template, "trap-template").otherwise("trap-literal").alias("kind"), F.lit(None).cast("string").alias("hook_array"))
    return hooks.unionByName(traps).select(_seq("k", "pos"), "manual", "name", "sig", "desc", "section", "kind", "hook_array")


#: Extractor, key column and facet of each category, in listing order.
EXTRACTORS = {
    "option": (options, "name", None), "cond_op": (cond_ops, "op", "arity"), "builtin": (builtins, "name", None), "precmd": (precmds, "name", None), "shell_param": (shell_params, "name", "section"),
    "complex_command": (complex_commands, "name", None), "reserved_word": (reserved_words, "name", "pos"), "redir": (redirections, "sig", None), "process_subst": (process_substs, "op", None),
    "param_expn": (param_expns, "sig", "sub_kind"), "subscript_flag": (subscript_flags, "flag", None), "param_flag": (param_flags, "flag", None), "history": (history, "key", "kind"), "glob_op": (glob_ops, "op", "kind"),
    "glob_flag": (glob_flags, "flag", None), "glob_qualifier": (glob_qualifiers, "flag", None), "prompt_escape": (prompt_escapes, "key", "section"), "zle_widget": (zle_widgets, "name", None),
    "keymap": (keymaps, "name", None), "job_spec": (job_specs, "key", "kind"), "arith_op": (arith_ops, "op", "arity"), "special_function": (special_functions, "name", "kind"),
}


def sub_kind(category: str) -> Column:
    """The facet of a category's rows."""
    if category == "zle_widget":
        return F.concat_ws(":", "kind", "section")
    if category == "keymap":
        return F.when(F.col("is_special"), "special").otherwise("regular")
    facet = EXTRACTORS[category][2]
    return F.col(facet) if facet else F.lit(None).cast("string")


def corpus(entries: DataFrame) -> DataFrame:
    """(manual, category, id, seq, display, sub_kind, group_op, payload): all records, keyed, each record whole as JSON in `payload`."""
    parts = []
    for category, (extract, key, _) in EXTRACTORS.items():
        rows = extract(entries)
        group_op = F.col("group_op") if category == "redir" else F.lit(None).cast("string")
        display = F.col("display") if category == "option" else F.col(key)
        payload = F.to_json(F.struct(*[c for c in rows.columns if c not in ("seq", "manual")]))
        parts.append(rows.select("manual", F.lit(category).alias("category"), F.col(key).alias("id"), "seq", display.alias("display"), sub_kind(category).alias("sub_kind"), group_op.alias("group_op"), payload.alias("payload")))
    return last_wins(united(parts), ["manual", "category", "id"])
