"""The pipeline against plain Python, and the registration of its queries."""

import zlib

import numpy as np
from data import SCHEMA, alnum_words, corpus
from test_text_operators import expected_components, expected_cut, expected_hits

import __spark_entry__
import corpus_pipeline
from tracemill.llm import queries, tokens


def test_pipeline(spark, tmp_path):
    rows = corpus()
    items = [(1, " ".join(rows[95][1].split()[5:30])), (2, "nothing like this stands in any of these documents at all, so it hits none")]
    for name, data, schema in (("documents", rows, SCHEMA), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    kept = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert len(kept) < len(rows)
    groups = {}
    for row, (doc_id, _, component) in zip(kept, expected_components(kept), strict=True):
        if doc_id is None or doc_id == component:
            groups[doc_id, row[1]] = row
    kept = list(groups.values())
    kept = [(r[0], cut[4]) for r, cut in zip(kept, expected_cut(kept, 35), strict=True)]
    hits = expected_hits(kept, items)
    clean = [r for r, hit in zip(kept, hits, strict=True) if not hit[5] or r[0] is None]
    assert 20 < len(clean) < len(rows) and all(alnum_words(r[1]) is not None for r in clean)

    whole = tokens.tokenizer(tokens.default_path()).whole
    want = set()
    for doc_id, text in clean:
        ids = whole.encode(text, add_special_tokens=False).ids + [1]
        want |= {(doc_id, p // 4096, p, len(ids[p:p + 4096]), zlib.crc32(np.array(ids[p:p + 4096], "<u4").tobytes())) for p in range(0, len(ids), 4096)}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {tuple(r)[:5] for r in got} == want and len(got) == len(want)


def test_stages_return_documents(spark):
    docs = spark.createDataFrame(corpus()[:8], SCHEMA)
    spark_dir = "/root/testdata/sf0.001"
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, spark_dir)
        assert out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), spark_dir).count() == 0


def test_registered():
    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)} and set(queries.QUERIES) | {"pipeline"} <= names
    assert set(queries.ORACLES) <= set(queries.QUERIES)
