"""From raw documents to packed sequences: five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns of
`documents`; other columns a table may have are left behind at the first stage.

- quality rules: documents that the rules reject go, and so do failing lines of the others.
- line dedup: lines that an earlier line equals or nearly equals go; documents with no other line left go.
- near-dedup: of each group of near-duplicates (five-word shingles, similarity 0.8) the one with the smallest id stays.
- mixing: each document is repeated or left out as a whole, by whether the mix takes its middle word.
- packing: a row per piece, with its sequence and its place there.

SQL has no tokenizer, so there is no SQL for `run`; the tests hold it against a plain version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import lines, minhash, mixing, packing, quality
from glossa.llm.common import WORD, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOKENIZER = "byte_bpe_50k.json"


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    """The columns of `documents` with another text."""
    return docs.select("doc_id", F.col(text).alias("text"), "lang", "source", F.char_length(text).cast("long").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality.judged(docs, ("doc_id", "lang", "source"), with_text=True)
    return _with_text(judged.where("kept"), "clean_text")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = lines.deduplicated(docs.select(*COLUMNS))
    return _with_text(rows.where((F.col("_lines") == 0) | F.col("_kept").rlike(WORD)), "_kept")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    stay = minhash.grouped(docs).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    return docs.select(*COLUMNS).join(stay, docs["doc_id"].eqNullSafe(stay["_id"]), "left_semi")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    copies = mixing.mixed(docs).groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size")).agg(F.max("copies").alias("_copies"))
    rows = docs.select(*COLUMNS, mixing.n_words().alias("_words"))
    rows = rows.join(copies, rows["doc_id"].eqNullSafe(copies["_id"]) & rows["source"].eqNullSafe(copies["_source"]) & (rows["_words"] == copies["_size"]))
    return rows.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*COLUMNS)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("packed_sequences", packed_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
