"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from . import images, jaccard, lines, middle, minhash, mixing, packing, quality, sharding, substrings, toxicity, warc, whitening
from .common import table
from .sql import ORACLES


def op1_sharding(spark, sf_dir):
    return sharding.query(table(spark, sf_dir, "documents"))


def op2_toxicity(spark, sf_dir):
    return toxicity.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_substrings(spark, sf_dir):
    return substrings.query(table(spark, sf_dir, "documents"))


def op4_warc(spark, sf_dir):
    return warc.query(table(spark, sf_dir, "pages"))


def op5_lines(spark, sf_dir):
    return lines.query(table(spark, sf_dir, "documents"))


def op6_images(spark, sf_dir):
    return images.query(table(spark, sf_dir, "embeddings"))


def op7_mixing(spark, sf_dir):
    return mixing.query(table(spark, sf_dir, "documents"))


def op10_quality(spark, sf_dir):
    return quality.query(table(spark, sf_dir, "documents"))


def op8_minhash(spark, sf_dir):
    return minhash.query(table(spark, sf_dir, "documents"))


def op9_packing(spark, sf_dir):
    import public_tokenizers

    return packing.query(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_whitening(spark, sf_dir):
    return whitening.query(table(spark, sf_dir, "embeddings"))


def op12_middle(spark, sf_dir):
    return middle.query(table(spark, sf_dir, "documents"))


def op13_jaccard(spark, sf_dir):
    return jaccard.query(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") or name == "pipeline"}


def oracle_sql() -> dict[str, str]:
    found = dict(ORACLES)
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
