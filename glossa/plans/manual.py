"""A manual with a part of every collection, made of the nation table, and its records by the rules, as SQL.

`{l}`, `{L}` and `{k}` stand for a nation's name as an option's id, as an option's display, and its number. A part's item stands once for each nation, or once for
the first one (`ONCE`); its records are listed by hand in the order they must come in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

EACH, ONCE = True, False
#: file, text before, item, how often, text after.
PARTS = (
    ("options.yo", "sect(Zle)\nstartitem()\n", "item(tt({L}) (tt(PLUS()q)) <D> <Z>)(\nTurn {l} on, see tt({L}) too.\n)\n", EACH, "enditem()\n"),
    ("options.yo", "sect(History)\nstartitem()\n", "item(tt(MENDED))(\nAs `var(name)tt(=)var(pattern) (e.g. `tt(foo=*)') in {l}.\n)\n", ONCE, "enditem()\n"),
    ("cond.yo", "startitem()\n", "xitem(tt(-{l}) var(file))\nitem(var(a) tt(={l}) var(b))(Cond {l}.)\n", EACH, "enditem()\n"),
    ("builtins.yo", "startitem()\n", "item(tt({l}) [ tt(-x) ] var(arg))(Run {l}. The zsh/{l} Module)\n", EACH, "enditem()\n"),
    ("grammar.yo", "sect(Precommand Modifiers)\nstartitem()\n", "item(tt(noglob) var(command))(No globs in {l}.)\nitem(tt(exec) [ tt(-cl) ])(Replace {l}.)\n", ONCE, "enditem()\n"),
    ("grammar.yo", "sect(Complex Commands)\nstartitem()\n", "item(tt(if) var(list) tt(then) var(list) tt(fi))(If {l}.)\n", ONCE, "enditem()\n"),
    ("grammar.yo", "sect(Alternate Forms For Complex Commands)\nstartitem()\n", "item(tt(if) var(list) tt({) var(list) tt(}))(Short {l}.)\n", ONCE, "enditem()\n"),
    ("grammar.yo", "sect(Reserved Words)\nThe words are\n\n", "startitem()\nitem(tt(do {l} typeset }))()\nenditem()\n", ONCE, ""),
    ("params.yo", "sect(Parameters Set By The Shell)\nstartitem()\n", "item(tt({l}) <S> (tt({L}) <S>))(Param {l}.)\n", EACH, "enditem()\n"),
    ("params.yo", "sect(Subscript Flags)\nstartitem()\n", "item(tt({l}:)var(string)tt(:))(Sub {l}.)\n", EACH, "enditem()\n"),
    ("redirect.yo", "sect(Redirection)\nstartitem()\n", "item(tt(<{l}) var(word))(Read {l}.)\n", EACH, "enditem()\n"),
    ("expn.yo", "sect(Process Substitution)\nText.\nsect(Parameter Expansion)\nstartitem()\n", "xitem(tt(${)var(name)tt(:-)var(word)tt(}))\nitem(tt(${)var(name)tt(-)var(word)tt(}))(Default {l}.)\n", ONCE, "enditem()\n"),
    ("expn.yo", "sect(Parameter Expansion Flags)\nstartitem()\n", "item(tt({l}))(Flag {l}.)\n", EACH, "enditem()\n"),
    ("expn.yo", "sect(Event Designators)\nstartitem()\n", "item(tt(!{l}))(Event {l}.)\n", EACH, "enditem()\n"),
    ("expn.yo", "sect(Word Designators)\nstartsitem()\n", "sitem(tt(w{k}))(Word {l}.)\n", EACH, "endsitem()\n"),
    ("expn.yo", "sect(Modifiers)\nstartitem()\n", "item(tt(m{l}))(Mod {l}.)\n", EACH, "item(tt(mended))(Here `tt(%)' and `tt(#%) are not active.)\nenditem()\n"),
    ("expn.yo", "sect(Glob Operators)\nstartitem()\n", "item(tt(*{l}))(Glob {l}.)\n", EACH, "enditem()\n"),
    ("expn.yo", "sect(ksh-like Glob Operators)\nstartitem()\n", "item(tt(@{l}))(Ksh {l}.)\n", EACH, "enditem()\n"),
    ("expn.yo", "sect(Globbing Flags)\nstartitem()\n", "item(tt({l}))(Globbing {l}.)\n", EACH, "enditem()\n"),
    ("expn.yo", "sect(Glob Qualifiers)\nstartitem()\n", "item(tt({l})var(sec))(Qualifier {l}.)\n", EACH, "enditem()\n"),
    ("prompt.yo", "sect(Login information)\nstartitem()\n", "item(tt(%{l}))(Prompt {l}.)\n", EACH, "enditem()\n"),
    ("zle.yo", "sect(Keymaps)\nstartsitem()\n", "sitem(tt({l}))(Keymap {l}.)\n", EACH, "sitem(tt(emacs))(Emacs.)\nsitem(tt(.safe))(Safe.)\nendsitem()\n"),
    ("zle.yo", "sect(User-Defined Widgets)\nstartitem()\n", "item(tt(Z{L}))(Widget parameter {l}.)\n", EACH, "enditem()\n"),
    ("zle.yo", "sect(Standard Widgets)\nsubsect(Movement)\nstartitem()\n", "item(tt({l}-char) (^B) (unbound) (unbound))(Move {l}.)\n", EACH, "enditem()\n"),
    ("zle.yo", "sect(Special Widgets)\nstartitem()\n", "item(tt(zle-{l}))(Special {l}.)\n", EACH, "enditem()\n"),
    ("jobs.yo", "sect(Jobs)\nstartsitem()\n", "sitem(tt(%)var(number))(By number {l}.)\nsitem(tt(%)var(string))(By name {l}.)\n", ONCE, "endsitem()\n"),
    ("arith.yo", "startsitem()\n", "sitem(tt(u{k} b{k}))(unary {l})\nsitem(tt(b{k}))(plus {l})\n", EACH, "endsitem()\n"),
    ("func.yo", "sect(Hook Functions)\nstartitem()\n", "item(tt({l}))(Hook {l}.)\n", EACH, "enditem()\n"),
    ("func.yo", "sect(Trap Functions)\nstartitem()\n", "item(tt(TRAP{k}))(Trap {l}.)\n", EACH, "item(tt(TRAPSIG)var(NAL))(Template.)\nenditem()\n"),
)
#: Records: category, which run of records, how often, id, facet, payload, markdown.
RECORDS = (
    ("option", 0, EACH, "{l}", None, '{"name":"{l}","display":"{L}","flags":[{"char":"q","on":"+"}],"default_in":["csh","ksh","sh","zsh"],"category":"Zle","desc":"Turn {l} on, see {L} too."}',
     "`{L}`\n\n```zsh\n{on} # on\n{off} # off\nset +q               # on\nset -q               # off\n```\n\n**Default in zsh: `on`**\n\nTurn {l} on, see **`{L}`** too.\n\n_Option category:_ Zle"),
    ("option", 1, ONCE, "mended", None, '{"name":"mended","display":"MENDED","flags":[],"default_in":[],"category":"History","desc":"As `name=pattern` (e.g. `foo=*`) in {l}."}',
     "`MENDED`\n\n```zsh\nsetopt mended        # on\nunsetopt mended      # off\n```\n\n**Default in zsh: `off`**\n\nAs `name=pattern` (e.g. `foo=*`) in {l}.\n\n_Option category:_ History"),
    ("cond_op", 0, EACH, "={l}", "binary", '{"op":"={l}","operands":["a","b"],"desc":"Cond {l}.","arity":"binary"}', "*a* `={l}` *b*\n\nCond {l}."),
    ("cond_op", 0, EACH, "-{l}", "unary", '{"op":"-{l}","operands":["file"],"desc":"Cond {l}.","arity":"unary"}', "`-{l}` *file*\n\nCond {l}."),
    ("builtin", 0, EACH, "{l}", None, '{"name":"{l}","synopsis":["{l} [ -x ] arg"],"desc":"Run {l}. The zsh/{l} Module","module":"zsh/{l}"}', "`{l}`\n\n```zsh\n{l} [ -x ] arg\n```\n\nRun {l}. The zsh/{l} Module\n\n_Module:_ `zsh/{l}`"),
    ("precmd", 0, ONCE, "noglob", None, '{"name":"noglob","synopsis":["noglob command"],"desc":"No globs in {l}."}', "`noglob`\n\n```zsh\nnoglob command\n```\n\nNo globs in {l}.\n\n_Role:_ precommand modifier"),
    ("precmd", 0, ONCE, "exec", None, '{"name":"exec","synopsis":["exec [ -cl ]"],"desc":"Replace {l}."}', "`exec`\n\n```zsh\nexec [ -cl ]\n```\n\nReplace {l}.\n\n_Role:_ precommand modifier"),
    ("shell_param", 0, EACH, "{l}", "shell-set", '{"name":"{l}","sig":"{l}","desc":"Param {l}.","section":"shell-set","tied":"{L}"}', "`{l}`\n\nParam {l}.\n\n_Tied with:_ `{L}`\n\n_Category:_ Shell Parameter — shell-set"),
    ("shell_param", 0, EACH, "{L}", "shell-set", '{"name":"{L}","sig":"{L}","desc":"Param {l}.","section":"shell-set","tied":"{l}"}', "`{L}`\n\nParam {l}.\n\n_Tied with:_ `{l}`\n\n_Category:_ Shell Parameter — shell-set"),
    ("shell_param", 1, EACH, "Z{L}", "zle-widget", '{"name":"Z{L}","sig":"Z{L}","desc":"Widget parameter {l}.","section":"zle-widget"}', "`Z{L}`\n\nWidget parameter {l}.\n\n_Category:_ Shell Parameter — zle-widget"),
    ("complex_command", 0, ONCE, "if", None, '{"name":"if","sig":"if list then list fi","desc":"If {l}.","section":"Complex Commands","alternate_forms":[{"template":"if list { list }","keywords":[]}],"body_keywords":["then","fi"]}',
     "`if`\n\n```zsh\nif list then list fi\n```\n\nIf {l}.\n\n_Alternate forms:_\n\n```zsh\nif list { list }\n```\n\n_Body keywords:_ `then` `fi`\n\n_Role:_ complex command"),
    ("reserved_word", 0, ONCE, "do", "command", '{"name":"do","sig":"do","section":"Reserved Words","pos":"command"}', "`do`\n\n_Role:_ reserved word (command position)"),
    ("reserved_word", 0, ONCE, "{l}", "command", '{"name":"{l}","sig":"{l}","section":"Reserved Words","pos":"command"}', "`{l}`\n\n_Role:_ reserved word (command position)"),
    ("reserved_word", 0, ONCE, "typeset", "command", '{"name":"typeset","sig":"typeset","section":"Reserved Words","pos":"command"}', "`typeset`\n\n_Role:_ reserved word (command position)"),
    ("reserved_word", 0, ONCE, "}", "any", '{"name":"}","sig":"}","section":"Reserved Words","pos":"any"}', "`}`\n\n_Role:_ reserved word (any position)"),
    ("redir", 0, EACH, "<{l} word", None, '{"sig":"<{l} word","group_op":"<{l}","desc":"Read {l}.","section":"Redirection"}', "`<{l}`\n\n```zsh\n<{l} word\n```\n\nRead {l}.\n\n_Category:_ Redirection"),
    ("process_subst", 0, ONCE, "<(...)", None, '{"op":"<(...)","sig":"<(list)","section":"Process Substitution"}', "`<(...)`\n\n_Category:_ Process Substitution"),
    ("process_subst", 0, ONCE, ">(...)", None, '{"op":">(...)","sig":">(list)","section":"Process Substitution"}', "`>(...)`\n\n_Category:_ Process Substitution"),
    ("process_subst", 0, ONCE, "=(...)", None, '{"op":"=(...)","sig":"=(list)","section":"Process Substitution"}', "`=(...)`\n\n_Category:_ Process Substitution"),
    ("param_expn", 0, ONCE, "${name:-word}", "default", '{"sig":"${name:-word}","group_sigs":["${name:-word}","${name-word}"],"order_in_group":0,"sub_kind":"default","placeholders":["name","word"],"desc":"Default {l}.","section":"Parameter Expansion"}',
     "`${name:-word}`    _(default, form 1 of 2)_\n\n```zsh\n${name:-word}    # <- this form\n${name-word}\n```\n\nDefault {l}.\n\n_Category:_ Parameter Expansion"),
    ("param_expn", 0, ONCE, "${name-word}", "default", '{"sig":"${name-word}","group_sigs":["${name:-word}","${name-word}"],"order_in_group":1,"sub_kind":"default","placeholders":["name","word"],"desc":"Default {l}.","section":"Parameter Expansion"}',
     "`${name-word}`    _(default, form 2 of 2)_\n\n```zsh\n${name:-word}\n${name-word}    # <- this form\n```\n\nDefault {l}.\n\n_Category:_ Parameter Expansion"),
    ("subscript_flag", 0, EACH, "{l}:string:", None, '{"flag":"{l}:string:","args":["string"],"sig":"{l}:string:","desc":"Sub {l}.","section":"Subscript Flags"}', "`{l}:string:`\n\nSub {l}.\n\n_Role:_ subscript flag (args: string)"),
    ("param_flag", 0, EACH, "{l}", None, '{"flag":"{l}","args":[],"sig":"{l}","desc":"Flag {l}.","section":"Parameter Expansion Flags"}', "`{l}`\n\nFlag {l}.\n\n_Role:_ parameter-expansion flag"),
    ("history", 0, EACH, "!{l}", "event-designator", '{"key":"!{l}","sig":"!{l}","desc":"Event {l}.","section":"Event Designators","kind":"event-designator"}', "`!{l}`\n\nEvent {l}.\n\n_Role:_ history event designator"),
    ("history", 1, EACH, "w{k}", "word-designator", '{"key":"w{k}","sig":"w{k}","desc":"Word {l}.","section":"Word Designators","kind":"word-designator"}', "`w{k}`\n\nWord {l}.\n\n_Role:_ history word designator"),
    ("history", 2, EACH, "m{l}", "modifier", '{"key":"m{l}","sig":"m{l}","desc":"Mod {l}.","section":"Modifiers","kind":"modifier"}', "`m{l}`\n\nMod {l}.\n\n_Role:_ history modifier"),
    ("history", 3, ONCE, "mended", "modifier", '{"key":"mended","sig":"mended","desc":"Here `%` and `#%` are not active.","section":"Modifiers","kind":"modifier"}', "`mended`\n\nHere `%` and `#%` are not active.\n\n_Role:_ history modifier"),
    ("glob_op", 0, EACH, "*{l}", "standard", '{"op":"*{l}","sig":"*{l}","desc":"Glob {l}.","section":"Glob Operators","kind":"standard"}', "`*{l}`\n\nGlob {l}.\n\n_Role:_ glob operator (standard)"),
    ("glob_op", 1, EACH, "@{l}", "ksh-like", '{"op":"@{l}","sig":"@{l}","desc":"Ksh {l}.","section":"ksh-like Glob Operators","kind":"ksh-like"}', "`@{l}`\n\nKsh {l}.\n\n_Role:_ glob operator (ksh-like)"),
    ("glob_flag", 0, EACH, "{l}", None, '{"flag":"{l}","args":[],"sig":"{l}","desc":"Globbing {l}.","section":"Globbing Flags"}', "`{l}`\n\nGlobbing {l}.\n\n_Role:_ glob flag"),
    ("glob_qualifier", 0, EACH, "{l}", None, '{"flag":"{l}","args":["sec"],"sig":"{l}sec","desc":"Qualifier {l}.","section":"Glob Qualifiers"}', "`{l}sec`\n\nQualifier {l}.\n\n_Role:_ glob qualifier (args: sec)"),
    ("prompt_escape", 0, EACH, "%{l}", "Login information", '{"key":"%{l}","sig":"%{l}","desc":"Prompt {l}.","section":"Login information"}', "`%{l}`\n\nPrompt {l}.\n\n_Category:_ Prompt Escape — Login information"),
    ("zle_widget", 0, EACH, "{l}-char", "standard:Movement", '{"name":"{l}-char","sig":"{l}-char (^B) (unbound) (unbound)","desc":"Move {l}.","section":"Movement","kind":"standard"}',
     "`{l}-char`\n\n```zsh\n{l}-char (^B) (unbound) (unbound)\n```\n\nMove {l}.\n\n_Role:_ ZLE standard widget\n\n_Subsection:_ Movement"),
    ("zle_widget", 1, EACH, "zle-{l}", "special:Special Widgets", '{"name":"zle-{l}","sig":"zle-{l}","desc":"Special {l}.","section":"Special Widgets","kind":"special"}', "`zle-{l}`\n\n```zsh\nzle-{l}\n```\n\nSpecial {l}.\n\n_Role:_ ZLE special widget\n\n_Subsection:_ Special Widgets"),
    ("keymap", 0, EACH, "{l}", "regular", '{"name":"{l}","sig":"{l}","desc":"Keymap {l}.","section":"Keymaps","is_special":false,"linked_from":[]}', "`{l}`\n\nKeymap {l}.\n\n_Role:_ ZLE keymap"),
    ("keymap", 1, ONCE, "emacs", "regular", '{"name":"emacs","sig":"emacs","desc":"Emacs.","section":"Keymaps","is_special":false,"linked_from":["main"]}', "`emacs`\n\nEmacs.\n\n_Role:_ ZLE keymap\n\n_Linked from:_ `main`"),
    ("keymap", 1, ONCE, ".safe", "special", '{"name":".safe","sig":".safe","desc":"Safe.","section":"Keymaps","is_special":true,"linked_from":[]}', "`.safe`\n\nSafe.\n\n_Role:_ ZLE keymap\n\n_Special:_ cannot be altered"),
    ("job_spec", 0, ONCE, "%number", "number", '{"key":"%number","sig":"%number","desc":"By number {l}.","section":"Jobs","kind":"number"}', "`%number`\n\nBy number {l}.\n\n_Role:_ job spec (number)"),
    ("job_spec", 0, ONCE, "%string", "string", '{"key":"%string","sig":"%string","desc":"By name {l}.","section":"Jobs","kind":"string"}', "`%string`\n\nBy name {l}.\n\n_Role:_ job spec (string)"),
    ("arith_op", 0, EACH, "u{k}", "unary", '{"op":"u{k}","sig":"u{k}","desc":"unary {l}","section":"Arithmetic Evaluation","arity":"unary"}', "`u{k}`\n\nunary {l}\n\n_Role:_ arithmetic operator (unary)"),
    ("arith_op", 0, EACH, "b{k}", "overloaded", '{"op":"b{k}","sig":"b{k}","desc":"unary {l}\\n\\nplus {l}","section":"Arithmetic Evaluation","arity":"overloaded"}', "`b{k}`\n\nunary {l}\n\nplus {l}\n\n_Role:_ arithmetic operator (overloaded)"),
    ("special_function", 0, EACH, "{l}", "hook", '{"name":"{l}","sig":"{l}","desc":"Hook {l}.","section":"Hook Functions","kind":"hook","hook_array":"{l}_functions"}', "`{l}`\n\nHook {l}.\n\n```zsh\n{l}_functions=( funcname1 funcname2 ... )\n```\n\n_Role:_ hook function"),
    ("special_function", 1, EACH, "TRAP{k}", "trap-literal", '{"name":"TRAP{k}","sig":"TRAP{k}","desc":"Trap {l}.","section":"Trap Functions","kind":"trap-literal"}', "`TRAP{k}`\n\nTrap {l}.\n\n_Role:_ trap function"),
    ("special_function", 2, ONCE, "TRAPSIGNAL", "trap-template", '{"name":"TRAPSIGNAL","sig":"TRAPSIGNAL","desc":"Template.","section":"Trap Functions","kind":"trap-template"}', "`TRAPSIGNAL`\n\nTemplate.\n\n_Role:_ trap function (template)"),
)

_DIGITS = ("0123456789", "ABCDEFGHIJ")


def manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(manual, file, value): the files of a manual for each region, which tells of its nations."""
    display = F.translate("n_name", *_DIGITS)
    names = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("manual"), F.col("n_nationkey").cast("long").alias("k"), display.alias("display"), F.lower(F.translate(display, "_", "")).alias("name"))
    one = names.groupBy("manual").agg(F.array_sort(F.collect_list(F.struct("k", "display", "name"))).alias("names"))

    def text(before: str, item: str, each: bool, after: str):
        listed = F.col("names") if each else F.slice("names", 1, 1)
        own = F.transform(listed, lambda x: F.replace(F.replace(F.replace(F.lit(item), F.lit("{l}"), x["name"]), F.lit("{L}"), x["display"]), F.lit("{k}"), x["k"].cast("string")))
        return F.concat(F.lit(before), F.array_join(own, ""), F.lit(after))

    files = dict.fromkeys(p[0] for p in PARTS)
    rows = F.array(*[F.struct(F.lit(f).alias("file"), F.concat(*[text(*p[1:]) for p in PARTS if p[0] == f]).alias("value")) for f in files])
    return one.select("manual", F.explode(rows).alias("r")).select("manual", "r.file", "r.value")


def _values(rows) -> str:
    quoted = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)


def _filled(column: str) -> str:
    out = column
    for mark, value in (("{l}", "l"), ("{L}", "d"), ("{k}", "CAST(k AS VARCHAR)"), ("{on}", "rpad('setopt ' || lower(d), CAST(greatest(20, 7 + length(d)) AS INTEGER), ' ')"), ("{off}", "rpad('unsetopt ' || lower(d), CAST(greatest(20, 9 + length(d)) AS INTEGER), ' ')")):
        out = f"replace({out}, '{mark}', {value})"
    return out


#: CTE `r`: manual, category, id, seq, sub_kind, payload and markdown of every record.
RECORDS_SQL = f"""WITH n0 AS (SELECT 'r' || n_regionkey AS manual, CAST(n_nationkey AS BIGINT) AS k, translate(n_name, '{_DIGITS[0]}', '{_DIGITS[1]}') AS d FROM nation),
n AS (SELECT manual, k, d, lower(replace(d, '_', '')) AS l, row_number() OVER (PARTITION BY manual ORDER BY k) AS i FROM n0),
t(nth, category, run, each_, id, sub, payload, md) AS (VALUES {_values((k, *r) for k, r in enumerate(RECORDS))}),
r AS (SELECT manual, category, {_filled("id")} AS id, row_number() OVER (PARTITION BY manual, category ORDER BY run, CASE WHEN each_ THEN i END, nth) - 1 AS seq, sub AS sub_kind, {_filled("payload")} AS payload, {_filled("md")} AS markdown
    FROM t JOIN n ON each_ OR i = 1)"""
