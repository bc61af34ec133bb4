import math
import re
from collections import Counter

import pytest
from pyspark.sql import Row

from kestrane.llm.lexical_search import lexical_search, term_runs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top):
    words = [(i, Counter(terms(t))) for i, t in docs]
    words = [(i, c, sum(c.values())) for i, c in words if c]
    n_docs, n_terms = len(words), sum(n for _, _, n in words)
    df = Counter(t for _, c, _ in words for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, c, n in words:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t, k in Counter(terms(text)).items() if t in c)
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("text", ["", "a", "The QUICK brown-fox's ÉTÉ été 日本 x1 1x [y] {z} ~\x7f\x00end", " ", "ÀÉ word"])
def test_terms_are_those_of_the_pattern(text):
    assert [t.decode() for run in term_runs(text) for t in run] == terms(text)


def test_long_texts_are_split_whole(monkeypatch):
    monkeypatch.setattr("kestrane.llm.lexical_search.PIECE", 40)
    text = "word " * 30 + "x" * 200 + " tail, end" * 9 + "é" * 90
    assert [t.decode() for run in term_runs(text) for t in run] == terms(text)


@pytest.fixture(scope="module")
def table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    return docs, items


@pytest.mark.parametrize("block,shard", [(1 << 17, 1 << 21), (50, 300)])
def test_equals_brute_force(spark, table, block, shard):
    docs, items = table
    got = lexical_search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), block=block, shard=shard)
    assert rows(got) == brute(docs, items, 20)


def test_steps_within_a_shard(spark, table, monkeypatch):
    docs, items = table
    from kestrane.llm import lexical_search as module

    rows_of, best = [(i, Counter(terms(t))) for i, t in docs], {}
    import numpy as np

    vocabulary = {t: k for k, t in enumerate(sorted({t for _, text in items for t in terms(text)}))}
    kept = [(i, c) for i, c in rows_of if c]
    df = Counter(t for _, c in kept for t in c)
    weights = np.array([math.floor(1000 * math.log((2 * len(kept) + 2) / (2 * df[t] + 1))) if df[t] else 0 for t in vocabulary], np.int64)
    own = [[(vocabulary[t], k) for t, k in c.items() if t in vocabulary] for _, c in kept]
    flat = np.array([x for o in own for x in o], np.int64).reshape(-1, 2)
    shard = module.Shard(weights, len(kept), sum(sum(c.values()) for _, c in kept), np.array([i for i, _ in kept]), np.zeros(len(kept), np.int64), np.array([sum(c.values()) for _, c in kept]), np.array([len(o) for o in own]), flat[:, 0], flat[:, 1])
    monkeypatch.setattr(module, "STEP", 7)
    probes = 0
    for item, text in items:
        best = module.Best(3)
        c = Counter(t for t in terms(text) if t in vocabulary)
        shard.search(np.array([vocabulary[t] for t in c], np.int64), np.array(list(c.values()), np.int64), best)
        probes += best.threshold > 0
        assert sorted((item, r, int(d), int(s)) for r, (s, _, d) in enumerate(best.rows, 1)) == sorted(brute(docs, [(item, text)], 3))
    assert probes


def test_ties_nulls_repeats_and_clashing_names(spark):
    docs = spark.createDataFrame([(5, "alpha beta", "p"), (None, "alpha beta", "q"), (3, "alpha beta", None), (3, "alpha beta", None), (9, None, "x"), (8, "", "x"), (7, "gamma " * 50, "x"), (None, None, None)], "doc_id long, text string, score string")
    items = spark.createDataFrame([(1, "alpha"), (1, "ALPHA"), (2, None), (3, "nowhere"), (None, "gamma beta beta")], "item_id long, text string")
    items = items.withColumn("doc_id", items.item_id)
    got = lexical_search(docs, items, top=3)
    assert [f.name for f in got.schema] == ["item_id", "rank", "doc_id", "score"]
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint", "bigint"]
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows(got) == brute(plain, [(r.item_id, r.text) for r in items.collect()], 3)
    assert [r.doc_id for r in got.where("item_id = 1").orderBy("rank", "doc_id").collect()] == [3, 3, 3, 3, 5, 5]


def test_empty_tables(spark, no_docs):
    items = spark.createDataFrame([Row(item_id=1, text="a b")])
    assert lexical_search(no_docs, items).count() == 0
    docs = spark.createDataFrame([Row(doc_id=1, text="a b")])
    assert lexical_search(docs, items.limit(0)).count() == 0
