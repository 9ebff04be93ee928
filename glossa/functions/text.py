"""Text functions over columns; all of them run in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: white space as scripts trim it (wider than the engine's blank).
BLANK = "[\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
#: The functions whose hook arrays are called <name>_functions.
HOOKS = ("chpwd", "periodic", "precmd", "preexec", "zshaddhistory", "zshexit")


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim(x: Column | str) -> Column:
    return F.regexp_replace(_col(x), f"^{BLANK}+|{BLANK}+$", "")


def squeeze(x: Column | str) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return trim(F.regexp_replace(_col(x), f"{BLANK}+", " "))


def option_name(x: Column | str) -> Column:
    return F.lower(F.translate(trim(x), "_", ""))


def norm_key(category: Column | str, raw: Column | str) -> Column:
    """The key a raw token has in a category: options ignore case and underscores, others only outer white space."""
    return F.when(_col(category) == "option", option_name(raw)).otherwise(trim(raw))


def has_no(x: Column | str) -> Column:
    return trim(x).rlike("(?i)^no_?")


def without_no(x: Column | str) -> Column:
    return F.regexp_replace(trim(x), "(?i)^no_?", "")


def without_fd(x: Column | str) -> Column:
    """A redirection without its leading file descriptor."""
    return F.regexp_replace(trim(x), "^[0-9]+", "")


def tail_kind(x: Column | str) -> Column:
    """What follows a redirection's operator: number, -, p, word, or nothing."""
    x = _col(x)
    return F.when(x.rlike("^[0-9]+$"), "number").when(x.isin("-", "p"), x).when(x != "", "word").otherwise("")


def history_key(x: Column | str) -> Column:
    """The event designator template of a token, or null."""
    t = trim(x)
    return (
        F.when(t.isin("!!", "!#", "!{...}"), t)
        .when(t.rlike(r"^!\?[^?]+\??$"), "!?str[?]")
        .when(t.startswith("!?"), F.lit(None))
        .when(t.rlike(r"^!-[0-9]+$"), "!-n")
        .when(t.startswith("!-"), F.lit(None))
        .when(t.rlike(r"^![0-9]+$"), "!n")
        .when(t.rlike(r"^![^!\s]+$"), "!str")
        .when(t.rlike(r"^\^[^^]+\^[^^]+\^?$"), "!!")
    )


def job_key(x: Column | str) -> Column:
    t = trim(x)
    return (
        F.when(t.isin("%%", "%+", "%-"), t)
        .when(t.rlike(r"^%[0-9]+$"), "%number")
        .when(t.rlike(r"^%\?.+$"), "%?string")
        .when(t.rlike(r"^%[^?].*$"), "%string")
    )


def flag_key(category: Column | str, x: Column | str) -> Column:
    """A flag without the parentheses (and the category's mark) around it, or null."""
    t = trim(x)
    mark = F.when(_col(category) == "glob_flag", "#").when(_col(category) == "glob_qualifier", "#q").otherwise("")
    inner = F.when(t.rlike(r"^\(.+\)$"), F.substring(t, F.lit(2), F.length(t) - 2))
    bare = F.when((mark != "") & inner.startswith(mark), F.substring(inner, F.length(mark) + 1, F.length(inner))).otherwise(inner)
    return F.when(bare != "", bare)


def candidate_keys(category: Column | str, raw: Column | str) -> Column:
    """array<struct<pri,key>>: the keys under which a category may hold a token, in order of preference."""
    c, t = _col(category), trim(raw)
    plain = norm_key(c, raw)
    hook = F.when(t.endswith("_functions") & F.regexp_replace(t, "_functions$", "").isin(*HOOKS), F.regexp_replace(t, "_functions$", ""))
    trap = F.when(t.rlike("^TRAP[A-Z0-9]+$"), "TRAPNAL")
    keys = (
        F.when(c == "history", F.array(history_key(raw)))
        .when(c == "job_spec", F.array(job_key(raw)))
        .when(c == "special_function", F.array(plain, hook, trap))
        .when(c == "option", F.array(plain, F.when(has_no(raw), option_name(without_no(raw)))))
        .when(c.isin("subscript_flag", "param_flag", "glob_flag", "glob_qualifier"), F.array(plain, flag_key(c, raw)))
        .otherwise(F.array(plain))
    )
    numbered = F.transform(keys, lambda k, i: F.struct(i.alias("pri"), k.alias("key")))
    return F.filter(numbered, lambda k: k["key"].isNotNull() & (k["key"] != ""))


def is_word(x: Column | str) -> Column:
    return _col(x).rlike("^[A-Za-z0-9_][A-Za-z0-9_-]*$")


def first_seen(tokens: Column | str) -> Column:
    """The tokens that are names, each once, where it first stands."""
    return F.array_distinct(F.filter(_col(tokens), is_word))


def flag_args(sig: Column | str) -> Column:
    """The non-empty middle parts of a flag's signature between colons."""
    parts = F.split(_col(sig), ":")
    middle = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
    return F.filter(middle, lambda x: x != "")


def comment_start(line: Column | str) -> Column:
    """The offset of the first `#` outside quotes and escapes, or null; only lines that have one are walked."""
    line = _col(line)
    chars = F.split(line, "")
    start = F.struct(F.lit(-1).alias("at"), F.lit(0).alias("i"), F.lit("").alias("q"), F.lit(False).alias("esc"))

    def step(s: Column, c: Column) -> Column:
        open_, esc = s["q"], s["esc"]
        at = F.when((s["at"] < 0) & (c == "#") & (open_ == "") & ~esc, s["i"]).otherwise(s["at"])
        is_quote = c.isin("'", '"', "`") & ~esc
        q = F.when(is_quote & (open_ == ""), c).when(is_quote & (open_ == c), F.lit("")).otherwise(open_)
        return F.struct(at.alias("at"), (s["i"] + 1).alias("i"), q.alias("q"), ((c == "\\") & ~esc & (open_ != "'")).alias("esc"))

    found = F.aggregate(chars, start, step, lambda s: s["at"])
    return F.when(F.contains(line, F.lit("#")), F.nullif(found, F.lit(-1)))


def active_text(line: Column | str) -> Column:
    """A line up to its comment."""
    at = comment_start(line)
    return F.when(at.isNull(), _col(line)).otherwise(F.substring(_col(line), F.lit(1), at))


def function_name(line: Column | str) -> Column:
    """The name a line declares: `name() ...` or `function name ...`; null without one."""
    line = _col(line)
    return F.coalesce(
        F.nullif(F.regexp_extract(line, r"^\s*([A-Za-z0-9_][A-Za-z0-9_-]*)\s*\(\)", 1), F.lit("")),
        F.nullif(F.regexp_extract(line, r"^\s*function\s+([A-Za-z0-9_][A-Za-z0-9_-]*)", 1), F.lit("")),
    )


#: Commands that read a file, and the file.
READS = r"(?:^|[;&|]\s*|\s)(?:source|\.)\s+([^\s;&|]+)"


def source_paths(line: Column | str) -> Column:
    """array<struct<path,start>>: what `source` and `.` commands of the active text read, and where it first stands from the command on; without paths that start with a variable."""
    line = _col(line)
    active = active_text(line)
    found = F.arrays_zip(F.regexp_extract_all(active, F.lit(READS), F.lit(0)).alias("whole"), F.regexp_extract_all(active, F.lit(READS), F.lit(1)).alias("path"))
    none = F.array().cast("array<struct<path:string,start:int>>")

    def step(s: Column, m: Column) -> Column:
        at = F.call_function("locate", m["whole"], active, s["end"])
        start = F.call_function("locate", m["path"], line, at) - 1
        kept = F.when(m["path"].startswith("$") | (start < 0), s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(m["path"].alias("path"), start.alias("start")))))
        return F.struct((at + F.length(m["whole"])).alias("end"), kept.alias("out"))

    return F.aggregate(found, F.struct(F.lit(1).alias("end"), none.alias("out")), step, lambda s: s["out"])


def first_error(stderr: Column | str) -> Column:
    """struct<line,msg> of the first line with a position, else of line 1; null for blank text."""
    whole = trim(stderr)
    pattern = r"(?m)^(?:/dev/stdin|zsh):([0-9]+): (.*)$"
    line = F.regexp_extract(whole, pattern, 1)
    found = F.struct(line.cast("int").alias("line"), F.regexp_extract(whole, pattern, 2).alias("msg"))
    return F.when(whole == "", F.lit(None)).when(line != "", found).otherwise(F.struct(F.lit(1).alias("line"), whole.alias("msg")))


def equal_map(stdout: Column | str) -> Column:
    """map<string,string> of the lines k=v with a key; the last value of a key stays, at the key's first place. Pairs are sorted by key once."""
    lines = F.filter(F.split(_col(stdout), "\n"), lambda x: F.instr(x, "=") > 1)
    pairs = F.array_sort(F.transform(lines, lambda x, i: F.struct(F.substring_index(x, "=", 1).alias("k"), i.alias("i"), F.substring(x, F.instr(x, "=") + 1, F.length(x)).alias("v"))))
    near = lambda i, step: F.get(pairs, i + step)["k"]
    # In order of keys, the first of a run gives the place, the last the value.
    firsts = F.transform(F.filter(F.transform(pairs, lambda p, i: F.struct(p["i"].alias("i"), p["k"].alias("k"), near(i, -1).eqNullSafe(p["k"]).alias("same"))), lambda p: ~p["same"]), lambda p: F.struct(p["i"].alias("i"), p["k"].alias("k")))
    lasts = F.transform(F.filter(F.transform(pairs, lambda p, i: F.struct(p["v"].alias("v"), near(i, 1).eqNullSafe(p["k"]).alias("same"))), lambda p: ~p["same"]), lambda p: p["v"])
    kept = F.array_sort(F.zip_with(firsts, lasts, lambda f, v: F.struct(f["i"].alias("i"), f["k"].alias("k"), v.alias("v"))))
    return F.map_from_arrays(F.transform(kept, lambda p: p["k"]), F.transform(kept, lambda p: p["v"]))


def nonempty_lines(x: Column | str) -> Column:
    return F.filter(F.split(_col(x), "\n"), lambda l: l != "")


def let(value: Column, f) -> Column:
    """`f` of a value that is computed once, however often `f` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def is_setopt(command: Column | str) -> Column:
    """Whether a command sets options: setopt, unsetopt, or set with a flag of either sign."""

    def sets(words: Column) -> Column:
        head = F.element_at(words, 1)
        flags = F.exists(F.slice(words, F.lit(2), F.size(words)), lambda w: w.rlike("^[-+][A-Za-z0-9]"))
        return head.isin("setopt", "unsetopt") | ((head == "set") & flags)

    return let(F.split(trim(command), r"\s+"), sets)


#: The tools that prose may name.
TOOLS = ("zsh_classify", "zsh_search", "zsh_describe", "zsh_lookup_option")


def subcommand_name(x: Column | str) -> Column:
    """A tool's name as a subcommand."""
    return F.regexp_replace(_col(x), "^zsh_", "")


def cli_prose(x: Column | str, program: str) -> Column:
    """Prose in which tools are named as a program's subcommands."""
    text = _col(x)
    for tool in TOOLS:
        text = F.replace(text, F.lit(tool), F.concat(F.lit(f"{program} "), subcommand_name(F.lit(tool))))
    return text


def arity_signature(op: Column | str, operands: Column | str, arity: Column | str) -> Column:
    """`op a` for unary, `a op b` for binary conditions."""
    o = _col(operands)
    return F.when(_col(arity) == "unary", F.concat_ws(" ", _col(op), F.get(o, F.lit(0)))).otherwise(F.concat_ws(" ", F.get(o, F.lit(0)), _col(op), F.get(o, F.lit(1))))


def padded(command: Column | str, state: Column | str, width: int = 20) -> Column:
    """A command padded to a column, then what it turns the option to."""
    c = _col(command)
    return F.concat(F.rpad(c, F.greatest(F.lit(width), F.length(c)), F.lit(" ")), F.lit("# "), _col(state))


def any_of(value: Column, names: Sequence[str]) -> Column:
    return value.isin(*names)


def closed(value: Column | str, names: Sequence[str], label: str) -> Column:
    """The value if it is one of `names`; else the query fails with what was met."""
    v = _col(value)
    return F.when(v.isin(*names), v).otherwise(F.raise_error(F.concat(F.lit(f"unknown {label}: "), F.coalesce(v, F.lit("null")))))
