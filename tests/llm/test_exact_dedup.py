import hashlib
import re

from kestrane.llm.exact_dedup import exact_dedup
from kestrane.llm.queries import op3_exact_dedup


def expected(docs):
    groups = {}
    for i, (d, t) in enumerate(docs):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), float("inf") if d is None else d, i))
    out = []
    for text, rows in groups.items():
        keep = min(rows)[1]
        for k, (_, d, i) in enumerate(sorted(rows)):
            out.append((docs[i][0], None if keep == float("inf") else keep, len(rows), k == 0, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, op3_exact_dedup(spark, sf_dir).collect()), key=repr) == expected(docs)


def test_small_blocks_and_edges(edge_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in edge_docs.collect()]
    for block in (5000, 60000):
        assert sorted(map(tuple, exact_dedup(edge_docs, block=block).drop("t1", "t2").collect()), key=repr) == expected(docs)
    assert exact_dedup(no_docs).count() == 0


def test_levels(spark):
    docs = [(i, t) for i, t in enumerate(["abcdefg", "ab cd efg", "abcdef", "gabcdef", "abcabc", "abc", "abca bc", "abcabd", "a", ""])]
    assert sorted(map(tuple, exact_dedup(spark.createDataFrame(docs, "doc_id long, text string"), block=2).drop("t1", "t2").collect()), key=repr) == expected(docs)
