"""The corpus relation: keyed records of 22 categories in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The categories in listing order.
CATEGORIES = (
    "option", "cond_op", "builtin", "precmd", "shell_param", "complex_command", "reserved_word", "redir", "process_subst", "param_expn", "subscript_flag",
    "param_flag", "history", "glob_op", "glob_flag", "glob_qualifier", "prompt_escape", "zle_widget", "keymap", "job_spec", "arith_op", "special_function",
)
#: The same categories in the order in which a token is classified.
CLASSIFY_ORDER = (
    "complex_command", "reserved_word", "precmd", "builtin", "cond_op", "special_function", "shell_param", "process_subst", "param_expn", "param_flag", "subscript_flag",
    "glob_flag", "glob_qualifier", "glob_op", "history", "prompt_escape", "job_spec", "zle_widget", "keymap", "arith_op", "option", "redir",
)


def category_dim(spark: SparkSession, categories=CATEGORIES, classify_order=CLASSIFY_ORDER) -> DataFrame:
    """(category, cat_ord, classify_ord): as many rows as there are categories."""
    rows = [(c, i, classify_order.index(c)) for i, c in enumerate(categories)]
    return spark.createDataFrame(rows, "category string, cat_ord int, classify_ord int")


def united(parts: list[DataFrame]) -> DataFrame:
    """The rows of all parts, by names of columns; paired up, so that the plans that are looked at while this is built do not grow one by one."""
    while len(parts) > 1:
        parts = [a.unionByName(b) for a, b in zip(parts[::2], parts[1::2], strict=False)] + parts[len(parts) // 2 * 2 :]
    return parts[0]


def last_wins(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """One row a key: the values of its last row, at the place of its first."""
    rest = [c for c in rows.columns if c not in keys and c != seq]
    kept = rows.groupBy(*keys).agg(F.min(seq).alias(seq), F.max_by(F.struct(*rest), F.col(seq)).alias("_v"))
    return kept.select(*keys, seq, *[F.col(f"_v.{c}").alias(c) for c in rest])


def first_wins(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """One row a key: its first row."""
    rest = [c for c in rows.columns if c not in keys and c != seq]
    kept = rows.groupBy(*keys).agg(F.min(seq).alias(seq), F.min_by(F.struct(*rest), F.col(seq)).alias("_v"))
    return kept.select(*keys, seq, *[F.col(f"_v.{c}").alias(c) for c in rest])


def merged_duplicates(rows: DataFrame, key: str | list[str], seq: str, kind: str, text: str, merged_kind: str) -> DataFrame:
    """One row a key: a key seen again becomes `merged_kind`, its texts joined by a blank line in order."""
    ordered = F.array_sort(F.collect_list(F.struct(seq, text)))
    key = [key] if isinstance(key, str) else key
    one = rows.groupBy(*key).agg(F.min(seq).alias(seq), F.count(F.lit(1)).alias("_n"), F.min_by(kind, seq).alias("_kind"), ordered.alias("_all"))
    return one.select(*key, seq, F.when(F.col("_n") > 1, merged_kind).otherwise(F.col("_kind")).alias(kind), F.array_join(F.transform("_all", lambda x: x[text]), "\n\n").alias(text))


def display_of(category: Column, id_: Column, display: Column) -> Column:
    """Options are shown as written, all others by id."""
    return F.when(category == "option", display).otherwise(id_)


def pool(corpus: DataFrame, dim: DataFrame, category: str | None = None) -> DataFrame:
    """What searches look at: (category, cat_ord, seq, id, display, sub_kind); an unknown category has no rows."""
    rows = corpus.where(F.col("category") == category) if category else corpus
    shown = display_of(F.col("category"), F.col("id"), F.col("display"))
    return rows.join(F.broadcast(dim), "category").select("category", "cat_ord", "seq", "id", shown.alias("display"), "sub_kind")


def counts(corpus: DataFrame) -> DataFrame:
    """(category, n) with a last row, of null category, for all."""
    return corpus.rollup("category").agg(F.count(F.lit(1)).alias("n"))


def info(corpus: DataFrame, dim: DataFrame) -> DataFrame:
    """(category, cat_ord, n) of every category, in order; those without rows have 0."""
    n = corpus.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return dim.join(n, "category", "left").select("category", "cat_ord", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def index_many(rows: DataFrame, keys: list[str], seq: str, value: str) -> DataFrame:
    """(keys, values): the values of each key in order."""
    ordered = F.array_sort(F.collect_list(F.struct(seq, value)))
    return rows.groupBy(*keys).agg(F.transform(ordered, lambda x: x[value]).alias("values"))


def unique_only(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value) of the keys with exactly one row."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(value).alias(value)).where("_n = 1").drop("_n")


def last_n(rows: DataFrame, key: list[str], seq: str, n: int) -> DataFrame:
    """The newest n rows of each key, or of all."""
    w = Window.partitionBy(*key).orderBy(F.col(seq).desc()) if key else None
    if w is None:
        return rows.orderBy(F.col(seq).desc()).limit(n)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
