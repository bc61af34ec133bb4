import re
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from kestrane.llm import filters
from kestrane.llm.toxicity import fit

from .test_similarity_join import brute


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(stage(spark, tables[-1], sf_dir).cache())
    assert all(t.columns == docs.columns for t in tables[:-1])
    text = {r.doc_id: r.text for r in docs.collect()}
    ids = [[r.doc_id for r in t.collect()] for t in tables]
    scorer = fit(docs, labels)
    assert sorted(ids[1]) == sorted(d for d in ids[0] if scorer.score(text[d])[0] < 0.7)
    groups = {}
    for d in ids[1]:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text[d]), []).append((-len(text[d]), d))
    assert sorted(ids[2]) == sorted(min(g)[1] for g in groups.values())
    assert sorted(ids[3]) == sorted({c for _, c, _, _ in brute([(d, text[d]) for d in ids[2]])})
    copies = Counter(ids[4])
    assert set(copies) <= set(ids[3]) and set(copies.values()) <= {1, 2}
    assert sorted(ids[5]) == sorted(ids[4])
    assert rows(corpus_pipeline.run(spark, sf_dir)) == rows(tables[5])


def test_edges(edge_docs, no_docs):
    kept = filters.without_exact_copies(edge_docs)
    assert kept.columns == edge_docs.columns
    best = {}
    for r in edge_docs.collect():
        t = re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
        best.setdefault(t, []).append((-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
    assert Counter(r.doc_id for r in kept.collect()) == Counter(None if null else d for _, null, d in map(min, best.values()))
    assert len({re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in edge_docs.collect()}) == kept.count()
    near = filters.without_near_copies(edge_docs)
    assert near.columns == edge_docs.columns and 8 not in {r.doc_id for r in near.collect()}
    for f in (filters.without_exact_copies, filters.without_near_copies):
        assert f(no_docs).count() == 0


def test_rows_that_share_an_id(spark):
    words = [f"word{i}" for i in range(200)]
    near, other = " ".join(words), " ".join(reversed(words))
    docs = spark.createDataFrame([
        (1, near, "x"), (5, near + " end", "x"), (5, other, "y"), (None, near + " more", "z"), (None, "of its own kind", "z"),
        (7, "a b c d", "long"), (7, "abc d", "short"), (8, "abcd", "x"), (9, "", "x"), (9, "", "x")], "doc_id long, text string, t1 string")
    got = [(r.doc_id, r.text) for r in filters.without_near_copies(docs).collect()]
    want = [(1, near), (5, other), (None, "of its own kind"), (7, "a b c d"), (7, "abc d"), (8, "abcd"), (9, ""), (9, "")]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    got = {r.t1 for r in filters.without_exact_copies(docs).filter("text like 'a%b%c%d'").collect()}
    assert got == {"long"}
    repeats = spark.createDataFrame([(3, "one two three", s) for s in "abc"] + [(4, "one two three", "d")], docs.schema)
    for f in (filters.without_near_copies, filters.without_exact_copies):
        assert [(r.doc_id, r.text) for r in f(repeats).collect()] == [(3, "one two three")]
        assert f(repeats).collect() == f(repeats).collect()


def test_the_pipeline_on_edges(spark, edge_docs, tmp_path):
    docs = edge_docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.when(F.col("doc_id") > 3, "s").alias("source"), F.length("text").cast("long").alias("n_chars"), "kept", F.col("rid").alias("row"))
    for name, rows in (("some", docs), ("none", docs.limit(0))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(i, i % 2, 0) for i in range(9)] + [(None, 0, 1), (7, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/some").collect()
    n = Counter(r.doc_id for r in got)
    assert {1, 10, 11} & set(n) and 2 not in n and max(n.values()) <= 2 and all(r.n_tokens * 4 == len(r.ids) for r in got)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
