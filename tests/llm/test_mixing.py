import re
from collections import Counter

from pyspark.sql import functions as F

from kestrane.llm.mixing import mix, mixed_documents, with_draw
from kestrane.llm.queries import op6_mixing


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Sharing by weight, again and again, until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, fixed, free = share * sum(sizes.values()), {}, set(names)
    while free:
        level = left / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > most * sizes[s]]
        if not over:
            return fixed | {s: level * w[s] for s in free}
        for s in over:
            fixed[s] = most * sizes[s]
            left -= fixed[s]
            free.remove(s)
    return fixed


def check(docs, got, slack=1):
    sizes, size = {}, {}
    for d, s, t in docs:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sizes[s] = sizes.get(s, 0) + n
        size[d] = n
    want, words = targets(sizes), {}
    assert len(got) == len(docs)
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r["size"]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        words[r.source] = words.get(r.source, 0) + r.taken
    for s in sizes:
        assert abs(words[s] - want[s]) <= slack, s


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = op6_mixing(spark, sf_dir).collect()
    check(docs, got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, op6_mixing(spark, sf_dir).collect()))
    epochs = {}
    for r in got:
        if r["size"]:
            epochs.setdefault(r.source, set()).add(r.taken // r["size"])
    assert all(max(x) - min(x) <= 1 for x in epochs.values())  # whole epochs come before any second draw


def test_edges(spark):
    rows = [(i, s, "w " * n, "x") for i, (s, n) in enumerate([("a", 10), ("a", 0), ("b", 400), (None, 7), (None, 3), ("é", 1), ("~", 90), ("b", 5), ("z", 0)])] + [(20, "b", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, size string")
    check([(d, s, t) for d, s, t, _ in rows], mix(docs).collect())
    assert mix(docs.limit(0)).count() == 0
    same = spark.createDataFrame([(1, "a", "x y z", "q")] * 4 + [(None, None, None, None)], docs.schema)
    assert sum(r.taken for r in mix(same).collect()) in (17, 18, 16)


def test_whole_copies(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    n = {}
    for r in out.collect():
        n[r.doc_id] = n.get(r.doc_id, 0) + 1
    assert set(n.values()) <= {1, 2}


def test_quality_weighs(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "'s' as source", "if(id % 2 = 0, 'good words here', '### $$$ a1%') as text")
    both = docs.unionByName(spark.range(4000, 4600).selectExpr("id as doc_id", "'a' as source", "repeat('w ', 60) as text"))
    got = {r.q: r.n for r in mix(both).filter("source = 's' and taken > size").selectExpr("doc_id % 2 = 0 as q").groupBy("q").count().withColumnRenamed("count", "n").collect()}
    assert got.get(True, 0) > 2 * got.get(False, 0)


def brute(docs, drawn):
    """(doc_id, taken) of the method, source by source; drawn: key of each doc_id."""
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, _, t in docs}
    sizes, out = {}, {}
    for d, s, _ in docs:
        sizes[s] = sizes.get(s, 0) + size[d]
    for s, target in targets(sizes).items():
        epochs = int(target // sizes[s]) if sizes[s] else 0
        left = int(target - epochs * sizes[s] + 0.5)
        for d in sorted((d for d, x, _ in docs if x == s), key=lambda d: drawn[d]):
            part = min(left, size[d])
            left -= part
            out[d] = epochs * size[d] + part
    return out


def test_which_documents_are_drawn(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = [(r.doc_id, r.source, r.text) for r in table.collect()]
    keys = {r.doc_id: r.mix_key for r in with_draw(table).collect()}
    assert {r.doc_id: r.taken for r in op6_mixing(spark, sf_dir).collect()} == brute(docs, keys)


def test_whole_copies_edges(spark, edge_docs):
    docs = edge_docs.withColumn("source", F.when(F.col("doc_id") > 5, "s"))
    got = mixed_documents(docs)
    assert got.columns == docs.columns and mixed_documents(docs.limit(0)).count() == 0
    assert {r.doc_id for r in got.collect()} <= {r.doc_id for r in docs.collect()}
    same = spark.createDataFrame([(1, "a", "x y z")] * 4 + [(2, "b", "w " * 50), (None, None, None)], "doc_id long, source string, text string")
    n = Counter(r.doc_id for r in mixed_documents(same).collect())
    assert n[1] in (4, 8) and n[2] in (1, 2)  # repeated rows are taken alike
