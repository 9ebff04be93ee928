"""Records as markdown, the ordered relation of all of them, quality rules over it, and dump files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import option_name
from .corpus import CATEGORIES, united
from .extract import EXTRACTORS

#: What dumps call the roles of special functions.
FUNCTION_ROLES = {"hook": "hook function", "trap-literal": "trap function", "trap-template": "trap function (template)"}
GAP = "\n\n"


def code(x: Column | str) -> Column:
    return F.concat(F.lit("`"), F.col(x) if isinstance(x, str) else x, F.lit("`"))


def block(lines: Column) -> Column:
    """A fenced block of an array's lines."""
    return F.concat(F.lit("```zsh\n"), F.array_join(lines, "\n"), F.lit("\n```"))


def _doc(*parts: Column | None) -> Column:
    """Parts apart by a blank line; null parts are left out."""
    return F.concat_ws(GAP, *[p for p in parts if p is not None])


def _said(label: str, value: Column) -> Column:
    return F.concat(F.lit(label), value)


#: What texts are made of: fenced regions (to the end of their last line or of the text), code spans, words, ends of lines, gaps, and single backticks. The group is a word that may name an option.
PIECES = r"(?<![^\n])```(?s:.*?)(?:\n```[^\n]*|\z)|`[^`\n]+`|(?<!\$)(?<!\$\{)([A-Z][A-Z0-9_]*+(?![a-z]))|[A-Za-z0-9_]+|\n|[^A-Za-z0-9_`\n]+|`"


def option_refs(rows: DataFrame, key: list[str], column: str, names: DataFrame, within: list[str] | None = None) -> DataFrame:
    """`rows` with the option names in `column` set bold, outside fences, code spans and parameter references. names: (id), or (within, id), the names of each `within`.

    Texts are cut into pieces where they are; only words that look like options leave them, with their places, meet the names by equality, with and without a leading no, and come back as one row a text.
    The work is linear in a text.
    """
    within = within or []
    words = rows.select(*dict.fromkeys([*key, *within]), F.posexplode(F.regexp_extract_all(column, F.lit(PIECES), F.lit(1))).alias("_at", "_word")).where("_word <> ''")
    other = F.when(F.col("_word").rlike("^NO_?"), option_name(F.regexp_replace("_word", "^NO_?", "")))
    asked = words.select(*dict.fromkeys([*key, *within]), "_at", F.explode(F.array_compact(F.array(option_name("_word"), other))).alias("id"))
    hits = asked.join(names.select(*within, "id").distinct(), [*within, "id"])
    places = hits.groupBy(*key).agg(F.array_sort(F.collect_set("_at")).alias("_at"))
    bits, at = F.col("_bits"), F.col("_at")
    upto = lambda a, k: F.array_join(F.slice(bits, a + 1, k), "")
    # What stands before each place, from the one before it on, and the word; then the rest.
    since = lambda j: F.coalesce(F.get(at, j - 1) + 1, F.lit(0))
    bold = F.transform(at, lambda a, j: F.concat(upto(since(j), a - since(j)), F.lit("**`"), F.get(bits, a), F.lit("`**")))
    text = F.concat(F.array_join(bold, ""), upto(F.element_at(at, -1) + 1, F.size(bits) - F.element_at(at, -1) - 1))
    rows = rows.join(places, key, "left").withColumn("_bits", F.when(at.isNotNull(), F.regexp_extract_all(column, F.lit(PIECES), F.lit(0))))
    return rows.withColumn(column, F.when(at.isNotNull(), text).otherwise(F.col(column))).drop("_bits", "_at")


#: Categories whose descriptions have their option names set bold.
WITH_REFS = ("option", "cond_op", "param_flag", "subscript_flag", "history", "glob_op", "glob_flag", "glob_qualifier", "complex_command")


def _args() -> Column:
    return F.when(F.size("args") > 0, F.concat(F.lit(" (args: "), F.array_join("args", ", "), F.lit(")"))).otherwise("")


#: Stands for a description that is filled in later; no manual holds this character.
SLOT = "\0"


def markdown(category: str, desc: Column | None = None) -> Column:
    """A record's markdown, from the columns of its collection (options also need `alias_display`); `desc` instead of its description, where it has one."""
    desc = (F.col("desc") if desc is None else F.when(F.col("desc").isNotNull(), desc)) if category not in ("process_subst", "reserved_word") else None
    title = code(EXTRACTORS[category][1])
    if category == "option":
        name = F.lower("display")
        lines = F.concat(F.array(_labelled("setopt", name, "on"), _labelled("unsetopt", name, "off")), F.transform("flags", lambda f: F.concat(_labelled("set", F.concat(f["on"], f["char"]), "on"), F.lit("\n"), _labelled("set", F.concat(F.when(f["on"] == "-", "+").otherwise("-"), f["char"]), "off"))))
        state = F.when(F.array_contains("default_in", "zsh"), "on").otherwise("off")
        alias = F.when(F.col("alias_of").isNotNull(), _said("_Alias of:_ ", code(F.concat(F.when(F.col("alias_of.negated"), "NO_").otherwise(""), "alias_display"))))
        return _doc(code("display"), block(lines), F.concat(F.lit("**Default in zsh: `"), state, F.lit("`**")), desc, alias, _said("_Option category:_ ", F.col("category")))
    if category == "cond_op":
        star = lambda i: F.concat(F.lit("*"), F.get("operands", F.lit(i)), F.lit("*"))
        return _doc(F.when(F.col("arity") == "unary", F.concat(code("op"), F.lit(" "), star(0))).otherwise(F.concat(star(0), F.lit(" "), code("op"), F.lit(" "), star(1))), desc)
    if category == "builtin":
        return _doc(title, block(F.col("synopsis")), desc, _said("_Alias of:_ ", code("alias_of")), _said("_Module:_ ", code("module")))
    if category == "precmd":
        return _doc(title, block(F.col("synopsis")), desc, F.lit("_Role:_ precommand modifier"))
    if category == "shell_param":
        return _doc(title, desc, _said("_Tied with:_ ", code("tied")), _said("_Category:_ Shell Parameter — ", F.col("section")))
    if category == "complex_command":
        alt = F.when(F.size("alternate_forms") > 0, F.concat(F.lit("_Alternate forms:_" + GAP), block(F.transform("alternate_forms", lambda a: a["template"]))))
        words = F.when(F.size("body_keywords") > 0, _said("_Body keywords:_ ", F.array_join(F.transform("body_keywords", code), " ")))
        return _doc(title, block(F.array("sig")), desc, alt, words, F.lit("_Role:_ complex command"))
    if category == "reserved_word":
        return _doc(title, F.concat(F.lit("_Role:_ reserved word ("), F.col("pos"), F.lit(" position)")))
    if category == "redir":
        return _doc(code("group_op"), block(F.array("sig")), desc, F.lit("_Category:_ Redirection"))
    if category == "process_subst":
        return _doc(title, F.lit("_Category:_ Process Substitution"))
    if category == "param_expn":
        many, n = F.size("group_sigs") > 1, F.size("group_sigs").cast("string")
        form = F.when(many, F.concat(F.lit(", form "), (F.col("order_in_group") + 1).cast("string"), F.lit(" of "), n)).otherwise("")
        lines = F.transform("group_sigs", lambda s, i: F.when(i == F.col("order_in_group"), F.concat(s, F.lit("    # <- this form"))).otherwise(s))
        return _doc(F.concat(title, F.lit("    _("), "sub_kind", form, F.lit(")_")), F.when(many, block(lines)), desc, F.lit("_Category:_ Parameter Expansion"))
    if category in ("subscript_flag", "param_flag", "glob_flag", "glob_qualifier"):
        role = {"subscript_flag": "subscript flag", "param_flag": "parameter-expansion flag", "glob_flag": "glob flag", "glob_qualifier": "glob qualifier"}[category]
        return _doc(code("sig"), desc, F.concat(F.lit(f"_Role:_ {role}"), _args()))
    if category == "history":
        return _doc(code("sig"), desc, _said("_Role:_ history ", F.regexp_replace("kind", "-", " ")))
    if category == "glob_op":
        return _doc(code("sig"), desc, F.concat(F.lit("_Role:_ glob operator ("), "kind", F.lit(")")))
    if category == "prompt_escape":
        return _doc(code("sig"), desc, _said("_Category:_ Prompt Escape — ", F.col("section")))
    if category == "zle_widget":
        return _doc(title, block(F.array("sig")), desc, F.concat(F.lit("_Role:_ ZLE "), "kind", F.lit(" widget")), _said("_Subsection:_ ", F.col("section")))
    if category == "keymap":
        linked = F.when(F.size("linked_from") > 0, _said("_Linked from:_ ", F.array_join(F.transform("linked_from", code), ", ")))
        return _doc(title, desc, F.lit("_Role:_ ZLE keymap"), F.when(F.col("is_special"), "_Special:_ cannot be altered"), linked)
    if category in ("job_spec", "arith_op"):
        role, kind, shown = ("job spec", "kind", "sig") if category == "job_spec" else ("arithmetic operator", "arity", "op")
        return _doc(code(shown), desc, F.concat(F.lit(f"_Role:_ {role} ("), kind, F.lit(")")))
    roles = F.create_map(*[F.lit(x) for kv in FUNCTION_ROLES.items() for x in kv])
    hook = F.when(F.col("hook_array").isNotNull(), block(F.array(F.concat("hook_array", F.lit("=( funcname1 funcname2 ... )")))))
    return _doc(title, desc, hook, _said("_Role:_ ", roles[F.col("kind")]))


def _labelled(command: str, arg: Column, state: str) -> Column:
    whole = F.concat(F.lit(command + " "), arg)
    return F.concat(F.rpad(whole, F.greatest(F.lit(20), F.length(whole)), F.lit(" ")), F.lit(f" # {state}"))


def rendered(entries: DataFrame) -> DataFrame:
    """(manual, category, id, seq, display, markdown) of all records.

    The descriptions of all collections meet the options' names together: one pass over their words, whatever the number of collections.
    """
    names = EXTRACTORS["option"][0](entries).select("manual", F.col("name").alias("id"), "display")
    found = {category: extract(entries) for category, (extract, _, _) in EXTRACTORS.items()}
    texts = united([found[c].select("manual", F.lit(c).alias("category"), "seq", "desc") for c in WITH_REFS])
    texts = option_refs(texts, ["manual", "category", "seq"], "desc", names, ["manual"])
    parts = []
    for category, rows in found.items():
        key = EXTRACTORS[category][1]
        if category == "option":
            of = names.select("manual", F.col("id").alias("_target"), F.col("display").alias("_shown"))
            rows = rows.withColumn("_target", F.col("alias_of.target")).join(of, ["manual", "_target"], "left").withColumn("alias_display", F.coalesce("_shown", "alias_of.target")).drop("_target", "_shown")
        display = F.col("display") if category == "option" else F.col(key)
        # Where a description goes is left open until the texts are there.
        desc = F.lit(SLOT) if category in WITH_REFS else None
        shown = markdown(category, desc)
        own = F.col("desc") if category in WITH_REFS else F.lit(None).cast("string")
        parts.append(rows.select("manual", F.lit(category).alias("category"), F.col(key).alias("id"), "seq", display.alias("display"), shown.alias("markdown"), own.isNotNull().alias("_open")))
    out = united(parts).join(texts, ["manual", "category", "seq"], "left")
    return out.select("manual", "category", "id", "seq", "display", F.when(F.col("_open"), F.replace("markdown", F.lit(SLOT), F.col("desc"))).otherwise(F.col("markdown")).alias("markdown"))


def ref_docs(docs: DataFrame) -> DataFrame:
    """(manual, kind, id, heading, md, ord): each manual's categories in order, records in theirs, shell parameters by name as dictionaries sort it."""
    place = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category"))
    name = F.when(F.col("category") == "shell_param", F.collate(F.col("id"), "UNICODE"))
    order = F.row_number().over(Window.partitionBy("manual").orderBy(place, name, "seq")) - 1
    return docs.select("manual", F.col("category").alias("kind"), "id", F.col("display").alias("heading"), F.col("markdown").alias("md"), order.cast("long").alias("ord"))


#: Rules of suspicious markdown, name and pattern; that of backticks is a count.
SUSPICIOUS = (
    ("empty ref", r"\b(?:See|see|described in|noted in) (?:\\ )?\."),
    ("dangling continuation", r"(?m)\\$"),
    ("raw yodl marker", r"\b(?:tt|var|example|manref|noderef)\("),
    ("unbalanced inline backticks", None),
    ('stray "+" before macro-shaped call', r"[A-Za-z_][A-Za-z0-9_]+\+\("),
    ("double comma (null reference substitution)", r",\s*,"),
)


def odd_backticks(md: Column) -> Column:
    """Whether a line outside fences has an odd number of backticks."""
    start = F.struct(F.lit(False).alias("fence"), F.lit(False).alias("odd"))
    count = lambda x: F.length(x) - F.length(F.replace(x, F.lit("`"), F.lit("")))
    opens = lambda x: F.startswith(x, F.lit("```"))
    step = lambda s, x: F.struct(F.when(opens(x), ~s["fence"]).otherwise(s["fence"]).alias("fence"), (s["odd"] | (~opens(x) & ~s["fence"] & (count(x) % 2 == 1))).alias("odd"))
    return F.aggregate(F.split(md, "\n", -1), start, step, lambda s: s["odd"])


def suspicious(docs: DataFrame, id_: str = "id", md: str = "md") -> DataFrame:
    """(id, rule) of every rule that a text fails, in the rules' order."""
    fails = lambda pattern: odd_backticks(F.col(md)) if pattern is None else F.col(md).rlike(pattern)
    found = F.array_compact(F.array(*[F.when(fails(p), F.struct(F.lit(i).alias("ord"), F.lit(name).alias("rule"))) for i, (name, p) in enumerate(SUSPICIOUS)]))
    return docs.select(F.col(id_).alias("id"), F.explode(found).alias("h")).select("id", F.col("h.ord").alias("ord"), "h.rule")


def suspicious_counts(docs: DataFrame, id_: str = "id", md: str = "md") -> DataFrame:
    """(ord, rule, n): texts that fail each rule, and with nulls the failures in all."""
    hits = suspicious(docs, id_, md)
    return hits.rollup("ord").agg(F.when(F.grouping("ord") == 0, F.first("rule")).alias("rule"), F.count(F.lit(1)).alias("n")).select("ord", "rule", "n")


def dump_text(refs: DataFrame, preambles: dict[str, str] | None = None) -> DataFrame:
    """(manual, file, text): a manual's file of all records, one a category, and one of what the rules found."""
    shown = F.concat(F.lit("## "), "heading", F.lit(GAP), "md")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", shown.alias("s")))), lambda x: x["s"]), "\n\n---\n\n")
    rows = refs.groupingSets([["manual", "kind"], ["manual"]], "manual", "kind").agg(joined.alias("body"), F.grouping("kind").alias("_all"))
    before = F.lit("")
    for kind, text in (preambles or {}).items():
        before = F.when((F.col("kind") == kind) & (F.col("_all") == 0), f"<!-- preamble for category -->{GAP}{text}{GAP}---{GAP}").otherwise(before)
    files = rows.select("manual", F.when(F.col("_all") == 1, "all.md").otherwise(F.concat("kind", F.lit(".md"))).alias("file"), F.concat(before, "body", F.lit("\n")).alias("text"))
    named = F.struct("manual", F.concat_ws(":", "kind", "id").alias("id"))
    hits = suspicious(refs.withColumn("id", named)).select("id.manual", "id.id", "ord", "rule")
    line = F.concat(F.lit("- "), "id", F.lit(" — "), "rule")
    listed = F.array_sort(F.collect_list(F.struct("id", "ord", line.alias("s"))))
    report = hits.groupBy("manual").agg(F.array_join(F.transform(listed, lambda x: F.concat(x["s"], F.lit("\n"))), "").alias("text"))
    report = refs.select("manual").distinct().join(report, "manual", "left").select("manual", F.lit("suspicious.md").alias("file"), F.coalesce("text", F.lit("")).alias("text"))
    return files.unionByName(report)
