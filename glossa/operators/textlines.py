"""Lines of documents: offsets, continuation blocks, declarations, occurrences, comments beside declarations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def doc_lines(docs: DataFrame, doc: str = "doc_id", body: str = "text") -> DataFrame:
    """(doc_id, line_no, line_start, text): lines from 0 with their offsets, in characters."""
    parts = F.split(F.coalesce(F.col(body), F.lit("")), "\n", -1)
    rows = docs.select(F.col(doc).alias("doc_id"), F.posexplode(parts).alias("line_no", "text"))
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("long")
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), start.alias("line_start"), "text")


def goes_on(text: Column | str) -> Column:
    """Whether a line ends in a backslash, blanks after it aside."""
    return (F.col(text) if isinstance(text, str) else text).rlike(rf"\\{X.BLANK}*\z")


def with_blocks(lines: DataFrame) -> DataFrame:
    """`lines` with `_block`, which numbers a document's runs of continued lines: a line goes on if it ends in a backslash, blanks after it aside."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    opens = F.coalesce(~goes_on(F.lag("text").over(w)), F.lit(True))
    return lines.withColumn("_opens", opens).withColumn("_block", F.sum(F.when(F.col("_opens"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def joined_lines(parts: Column) -> Column:
    """The active texts of a run of lines as one: each without a backslash at its end and trimmed."""
    return X.trim(F.array_join(F.transform(parts, lambda x: X.trim(F.regexp_replace(x, rf"\\{X.BLANK}*\z", ""))), " "))


def continued_blocks(lines: DataFrame) -> DataFrame:
    """(doc_id, block_start, block_end, text): runs of continued lines joined, comments cut first."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", X.active_text("text").alias("text"))))
    blocks = with_blocks(lines).groupBy("doc_id", "_block").agg(F.min("line_no").alias("block_start"), F.max("line_no").alias("block_end"), ordered.alias("_lines"))
    return blocks.select("doc_id", "block_start", "block_end", joined_lines(F.transform("_lines", lambda x: x["text"])).alias("text"))


def matched(rows: DataFrame, keys: list[str], text: Column, pattern: str) -> DataFrame:
    """(keys, start, end, word): every match of a pattern in each row's text with its place, in characters from 0. `keys` must tell rows apart.

    Lengths of gaps and matches are added up by a window over a row's pieces, so the work is linear in a text, whatever its length.
    """
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("word"))
    rows = rows.select(*keys, F.posexplode(pieces).alias("_i", "_p"))
    size = F.length("_p.gap") + F.coalesce(F.length("_p.word"), F.lit(0))
    end = F.sum(size).over(Window.partitionBy(*keys).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)).cast("long")
    rows = rows.select(*keys, end.alias("end"), F.col("_p.word").alias("word")).where("word IS NOT NULL")
    return rows.select(*keys, (F.col("end") - F.length("word")).alias("start"), "end", "word")


#: What ends an editor's word, one by one; a number may hold a dot.
SEPARATORS = ("`", "~", "!", "@", "#", "$", "%", "^", "&", "*", "(", ")", "=", "+", "[", "{", "]", "}", "\\", "|", ";", ":", "'", '"', ",", ".", "<", ">", "/", "?")
EDITOR_WORD = r"-?\d*\.\d\w*|[^" + "".join("\\" + c for c in SEPARATORS) + r"\s]+"


def editor_words(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, start, end, word): what an editor takes for words."""
    return matched(lines, ["doc_id", "line_no"], F.col("text"), EDITOR_WORD)


def function_index(lines: DataFrame) -> DataFrame:
    """(doc_id, name, line_no, name_start, doc_text): declarations, with the comment run directly above, else directly below."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    comment = F.col("text").rlike(r"^\s*#")
    rows = lines.withColumn("_name", X.function_name("text")).withColumn("_c", comment)
    rows = rows.withColumn("_run", F.sum(F.when(F.col("_c") & F.coalesce(F.lag("_c").over(w), F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    stripped = F.regexp_replace("text", r"^\s*# ?", "")
    ordered = F.array_sort(F.collect_list(F.struct("line_no", stripped.alias("t"))))
    runs = rows.where("_c").groupBy("doc_id", "_run").agg(F.min("line_no").alias("a"), F.max("line_no").alias("b"), F.array_join(F.transform(ordered, lambda x: x["t"]), "\n").alias("doc"))
    names = rows.where("_name IS NOT NULL").select("doc_id", F.col("_name").alias("name"), "line_no", (F.instr("text", F.col("_name")) - 1).cast("long").alias("name_start"))
    above = runs.select("doc_id", (F.col("b") + 1).alias("line_no"), F.col("doc").alias("above"))
    below = runs.select("doc_id", (F.col("a") - 1).alias("line_no"), F.col("doc").alias("below"))
    both = names.join(above, ["doc_id", "line_no"], "left").join(below, ["doc_id", "line_no"], "left")
    return both.select("doc_id", "name", "line_no", "name_start", F.coalesce(F.nullif("above", F.lit("")), F.nullif("below", F.lit(""))).alias("doc_text"))


def function_docs(index: DataFrame) -> DataFrame:
    """(doc_id, name, doc_text): the comment of each name, that of its last declaration that has one."""
    return index.where("doc_text IS NOT NULL").groupBy("doc_id", "name").agg(F.max_by("doc_text", "line_no").alias("doc_text"))


def definitions(index: DataFrame) -> DataFrame:
    """(doc_id, name, line_no): where each name is declared first."""
    return index.groupBy("doc_id", "name").agg(F.min("line_no").alias("line_no"))


def symbols(index: DataFrame, query: str = "") -> DataFrame:
    """Declarations whose name contains the query, in any case."""
    return index.where(F.contains(F.lower("name"), F.lit(query.lower())))


def occurrences(lines: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, line_no, word, start): whole-word places in active text. words: (doc_id, word).

    Each line is cut into its names once; words meet them by equality, whatever the number of words.
    """
    rows = matched(lines, ["doc_id", "line_no"], X.active_text("text"), "[A-Za-z0-9_-]+")
    return rows.join(words.select("doc_id", "word").distinct(), ["doc_id", "word"]).select("doc_id", "line_no", "word", "start")


def renamed(lines: DataFrame, old: str, new: str) -> DataFrame:
    """Lines with every whole-word `old` of the active text replaced; fails for a new name that is not one."""
    import re

    if not re.fullmatch(r"[A-Za-z0-9_][A-Za-z0-9_-]*", new):
        raise ValueError(f"not a name: {new!r}")
    active = X.active_text("text")
    changed = F.regexp_replace(active, rf"(?<![\w-]){re.escape(old)}(?![\w-])", new)
    return lines.withColumn("text", F.concat(changed, F.substring("text", F.length(active) + 1, F.length("text"))))


#: A name between white space.
NAME = r"(?<!\S)[A-Za-z0-9_][A-Za-z0-9_-]*+(?!\S)"


def name_tokens(lines: DataFrame) -> DataFrame:
    """(doc_id, token, line_no, pos): the names a document uses, each once, by first place.

    A place is one number, line before position, so that the least is kept without sorting all names.
    """
    rows = lines.select("doc_id", "line_no", F.posexplode(F.regexp_extract_all("text", F.lit(NAME), F.lit(0))).alias("i", "token"))
    place = F.shiftleft("line_no", 32).bitwiseOR(F.col("i").cast("long"))
    return rows.groupBy("doc_id", "token").agg(F.min(place).alias("p")).select("doc_id", "token", F.shiftright("p", 32).alias("line_no"), F.col("p").bitwiseAND(F.lit(0xFFFFFFFF)).alias("pos"))


def sources(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, path, start): files that lines read, and where in the line their names stand."""
    return lines.select("doc_id", "line_no", F.explode(X.source_paths("text")).alias("_s")).select("doc_id", "line_no", "_s.path", "_s.start")


def unbalanced_backticks(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no): lines outside fences with an odd number of backticks."""
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.startswith(F.ltrim("text"), F.lit("```"))
    inside = F.sum(F.when(fence, 1).otherwise(0)).over(w) % 2 == 1
    odd = (F.length("text") - F.length(F.replace("text", F.lit("`"), F.lit("")))) % 2 == 1
    return lines.withColumn("_f", fence).withColumn("_in", inside).where(~F.col("_f") & ~F.col("_in") & odd).select("doc_id", "line_no")
