"""The pipeline: each stage's rows follow from its operator, and the whole holds together."""

import os
from collections import Counter

import corpus_pipeline as P
from glossa.llm import quality
from glossa.llm.common import table, written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    names = [n for n, _ in P.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_dedup", "source_mix", "packed_sequences"]
    seen = []
    for name, stage in P.STAGES:
        docs = written(stage(spark, docs, SF), name)
        seen.append(docs.collect())
        if name != names[-1]:
            assert tuple(docs.columns) == P.COLUMNS
            assert all(r.n_chars == len(r.text) for r in seen[-1])
    cleaned, unique, near, mix, packed = seen
    kept = {r.doc_id for r in quality.query(table(spark, SF, "documents")).where("kept").collect()}
    assert {r.doc_id for r in cleaned} == kept
    lines = Counter(x for r in unique for x in r.text.split("\n") if x.strip())
    assert max(lines.values()) == 1
    assert {r.doc_id for r in near} <= {r.doc_id for r in unique} and len(near) == len({r.doc_id for r in near})
    assert {r.doc_id for r in mix} <= {r.doc_id for r in near} and max(Counter(r.doc_id for r in mix).values()) <= 3
    assert {r.doc_id for r in packed} == {r.doc_id for r in mix}
    load = Counter()
    for r in packed:
        load[r.sequence_id] += r.length
    assert max(load.values()) <= 1024


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(os.path.join(tmp_path, "documents.parquet"))
    assert P.run(spark, str(tmp_path)).collect() == []
