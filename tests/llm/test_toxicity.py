import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrane.llm import toxicity as tox
from kestrane.llm.queries import op9_toxicity
from kestrane.llm.toxicity import Index, fit, toxicity, without_toxic


@pytest.mark.parametrize("often", [0.0, 0.09, 2.0])
def test_index_is_exact(monkeypatch, often):
    monkeypatch.setattr(tox, "OFTEN", often)  # all terms dense, some, none
    r = np.random.default_rng(4)
    idf = r.uniform(1, 5, 40)
    vectors = [(r.choice(40, n, False), r.integers(1, 9, n)) for n in r.integers(0, 6, 700)]
    index = Index(vectors, idf, r.integers(0, 2, 700), list(range(700)))
    unit = [dict(zip(*map(np.ndarray.tolist, index.row(i)))) for i in range(700)]
    for q in vectors[:200]:
        v = Index.weighed(*q, idf)
        sims = np.array([sum(x * u.get(t, 0.0) for t, x in zip(*v)) for u in unit])
        (got,) = index.nearest([v], 7)
        positive = np.sort(sims[sims > 1e-12])[::-1]
        if not len(positive):
            assert got == []
            continue
        kth = positive[min(7, len(positive)) - 1]
        assert sorted(i for i, _ in got) == np.flatnonzero(sims >= max(kth - 1e-9, 1e-12)).tolist()
        assert np.allclose([s for _, s in got], sims[[i for i, _ in got]])


def test_query_on_held_out_rows(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.1")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = op9_toxicity(spark, sf_dir).collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    test = [r for r in got if r.held_out and r.doc_id in truth]
    caught = [r for r in test if r.predicted]
    hits = sum(truth[r.doc_id] for r in caught)
    assert hits >= 0.95 * len(caught) and hits >= 0.85 * sum(truth[r.doc_id] for r in test)


def test_labels_of_held_out_rows_play_no_part(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("toxic", F.when(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(toxicity(docs, labels).collect()) == sorted(toxicity(docs, flipped).collect())


def test_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(9)] + [(None, 1, None), (3, None, None)], "doc_id long, toxic int, text string")
    got = toxicity(edge_docs, labels).collect()
    assert len(got) == edge_docs.count()
    assert all(r.held_out is not None and 0 <= r.score <= 1 for r in got)
    assert toxicity(no_docs, labels).count() == 0
    assert {r.score for r in toxicity(edge_docs, labels.limit(0)).collect()} == {0.0}
    assert without_toxic(edge_docs, labels.limit(0)).count() == edge_docs.count()
    words = [(i, ("plain words only " if i % 4 else "awfulness and plain words ") + f"number{i}", None, None) for i in range(400)]
    docs = spark.createDataFrame(words, edge_docs.schema)
    scorer = fit(docs, spark.createDataFrame([(i, int(i % 4 == 0), "") for i in range(400)], labels.schema))
    assert scorer.score("such awfulness here")[0] > 0.9 and scorer.score("such words here")[0] < 0.1


def test_a_copy_of_an_example_in_plain_words_is_found(spark, edge_docs):
    name = ["".join("abcdefghij"[int(c)] for c in f"{i:03d}") for i in range(120)]
    texts = [(i, f"{n}alpha {n}beta {n}gamma {n}delta shared plain words", None, None) for i, n in enumerate(name)]
    scorer = fit(spark.createDataFrame(texts, edge_docs.schema), spark.createDataFrame([(i, int(i % 8 == 0), "") for i in range(120)], "doc_id long, toxic int, text string"))
    ids = [i for i in scorer.index.ids if i % 8 == 0]
    assert ids
    for i in ids:
        score, evidence = scorer.score(texts[i][1] + " more")
        assert evidence.startswith(f"{i}:1:") and score > scorer.score("shared plain words")[0]


def test_scores_against_brute_force(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scorer, text = fit(docs, labels), {r.doc_id: r.text or "" for r in docs.collect()}
    index, terms = scorer.index, scorer.vectors.terms
    stem = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    held = {w: sum(w in set(stem(t)) for t in text.values()) for w in list(terms)[:50]}
    assert all(abs(index.idf[terms[w]] / (tox.BOOST if terms[w] < scorer.vectors.marked else 1) - (np.log((1 + len(text)) / (1 + n)) + 1)) < 1e-9 for w, n in held.items())
    assert set(index.ids) == {r.doc_id for r in labels.collect() if r.doc_id in text and zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    assert set(terms) == {s for i in index.ids for s in stem(text[i])}

    def vector(t):
        words = Counter(stem(t))
        v = {terms[w]: 1 + math.log(n) for w, n in words.items() if w in terms}
        hits = sum(n for w, n in words.items() if terms.get(w, 10**9) < scorer.vectors.marked)
        if hits:
            v[len(terms) + int(math.log2(1 + 1023 * hits / words.total()))] = 1.0
        v = {k: x * index.idf[k] for k, x in v.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {k: x / norm for k, x in v.items()}

    examples = [vector(text[i]) for i in index.ids]
    for r in toxicity(docs, labels).collect():
        v = vector(text[r.doc_id])
        sims = np.array([sum(x * e.get(k, 0.0) for k, x in v.items()) for e in examples])
        kth = np.sort(sims)[-tox.NEIGHBOURS] if len(sims) >= tox.NEIGHBOURS else 0
        near = [i for i in range(len(sims)) if sims[i] >= max(kth - 1e-9, 1e-12)]
        w = [(sims[i] ** 2 * scorer.class_weight[int(index.labels[i])], index.labels[i]) for i in near]
        prior = min(scorer.class_weight)
        raw = (sum(x for x, y in w if y) + prior * scorer.base) / (sum(x for x, _ in w) + prior)
        want = 0.999 * np.interp(raw, scorer.cuts, scorer.values) + 0.001 * raw if v else scorer.base
        assert abs(r.score - want) < 1e-6, r.doc_id
        if v and r.evidence:
            assert float(r.evidence.split(",")[0].split(":")[2]) == round(float(sims.max()), 3)


def test_without_toxic_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    scores = toxicity(edge_docs, labels).collect()
    kept = without_toxic(edge_docs, labels)
    assert kept.columns == edge_docs.columns and kept.count() == sum(r.score < tox.THRESHOLD for r in scores)
    assert without_toxic(no_docs, labels).count() == 0


def test_repeated_ids_give_the_same_scorer(spark):
    rows = [(i % 40, f"plain words of {i} kind{i % 7}") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(40)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (sorted(map(tuple, toxicity(d, labels).collect())) for d in (docs, docs.repartition(7)))
    assert a == b


def test_terms_are_whole_words_and_pairs_where_there_are_no_spaces():
    assert tox.terms_of("Internationalization, internally; don't") == ["internationalization", "internally", "don", "t"]
    assert tox.terms_of("これは毒 abc 毒") == ["これ", "れは", "は毒", "abc", "毒"]


def test_scripts_without_spaces(spark):
    texts = [(i, f"これは{'日月火水木金土'[i % 7]}曜日の文章です" + ("毒舌" if i % 4 == 0 else "") + f"と{'春夏秋冬'[i % 3]}の話") for i in range(200)]
    scorer = fit(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int"))
    assert scorer.score("そして最後に毒舌と言う")[0] > 0.7 > 0.3 > scorer.score("そして最後に文章です")[0]
