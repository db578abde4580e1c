import re
from collections import Counter

import brute
import corpus_pipeline
from curbstream.llm import mixing


def test_stages(spark):
    """Each stage against a plain version of its decision, on its own input."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(folder + "/documents.parquet")
    columns, before = docs.columns, docs.collect()
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, spark.createDataFrame(before, docs.schema), folder)
        assert out.columns == columns, name
        after = out.collect()
        if name == "language ID":
            assert 0.95 * len(before) <= len(after) <= len(before)
        elif name == "exact dedup":
            first = {}
            for r in before:
                k = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
                first[k] = min(first.get(k, r.doc_id), r.doc_id)
            assert sorted(r.doc_id for r in after) == sorted(first.values())
        elif name == "n-gram Jaccard join":
            want = brute.jaccard_components([(r.doc_id, r.text) for r in before])
            assert sorted(r.doc_id for r in after) == sorted(d for d, (_, c) in want.items() if c == d)
        else:
            plan = mixing.mix_sources(spark.createDataFrame(before, docs.schema)).collect()
            assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in plan for _ in range(r.copies))
        before = after
    packed = corpus_pipeline.pack(spark, spark.createDataFrame(before, docs.schema), folder).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in before)


def test_empty(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, "") if docs.columns[0] == "doc_id" else docs
        assert docs.count() == 0
