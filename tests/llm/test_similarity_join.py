import random

import numpy as np

from kestrane.llm import similarity_join as sj
from kestrane.llm.queries import op7_ngram_jaccard


def sets(text):
    w = (text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    """(doc_id, class_id, n_links, class_size) by comparing all pairs that share a shingle."""
    s, where, up = [sets(t) for _, t in docs], {}, list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [0] * len(docs)
    for i, x in enumerate(s):
        for g in x:
            where.setdefault(g, []).append(i)
    for i, x in enumerate(s):
        for j in {j for g in x for j in where[g] if j > i}:
            both = len(x & s[j])
            if both >= 0.8 * (len(x) + len(s[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                up[max(root(i), root(j))] = min(root(i), root(j))
    members = {}
    for i in range(len(docs)):
        members.setdefault(root(i), []).append(i)
    out = []
    for m in members.values():
        ids = [docs[i][0] for i in m if docs[i][0] is not None]
        out += [(docs[i][0], min(ids) if ids else None, links[i], len(m)) for i in m]
    return sorted(out, key=repr)


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, op7_ngram_jaccard(spark, sf_dir).collect()), key=repr) == brute(docs)


def near_copies(n, seed=1, words=120):
    r = random.Random(seed)
    base = [f"w{r.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(0, 5)):
            w[r.randrange(words)] = f"x{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_large_groups_by_blocks(spark, monkeypatch, request):
    monkeypatch.setattr(sj, "SMALL", 3)
    monkeypatch.setattr(sj, "BLOCK", 16)
    monkeypatch.setattr(sj, "STRIP", 5)
    monkeypatch.setattr(sj, "BLOCK_SHINGLES", 1000)
    monkeypatch.setattr(sj, "PAIRS", 10)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # groups go over batches
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch"))
    texts = near_copies(70) + near_copies(9, 2) + near_copies(2, 3) + ["alone in the world with nobody near"] * 3 + ["tiny", "tiny ", "tiny text", "", None]
    docs = [(i * 3 % 257, t, "x") for i, t in enumerate(texts)] + [(None, texts[0], "y"), (0, texts[0], "y")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, node string")
    assert sorted(map(tuple, sj.near_duplicates(frame).collect()), key=repr) == brute([d[:2] for d in docs])


def test_pruning_keeps_what_reaches_the_threshold():
    least = sj.least_matches()
    assert sorted(least) == list(range(16, 161, 16)) and all(0 < m < n for n, m in least.items())
    r = np.random.default_rng(0)
    equal = np.cumsum(r.random((200_000, 160)) < 0.8, axis=1)
    lost = np.zeros(len(equal), bool)
    for n, m in least.items():
        lost |= equal[:, n - 1] < m
    assert lost.mean() < 1e-4
    low = np.cumsum(r.random((20_000, 160)) < 0.4, axis=1)
    assert (low[:, 31] >= least[32]).mean() < 0.5 and (low[:, 159] >= least[160]).mean() < 1e-3


def test_pairs_by_rows_and_by_blocks_agree():
    r = np.random.default_rng(1)
    values = np.where(r.random((60, sj.VALUES)) < 0.85, np.arange(sj.VALUES), r.integers(1000, 9000, (60, sj.VALUES))).astype(np.uint32)
    least = sj.least_matches()
    i, j = np.triu_indices(60, 1)
    assert 0 < len(sj.still_alike(values, i, j, least)[0]) < len(i)
    for a, b in zip(sj.still_alike(values, i, j, least), sj.surviving(values, values, True, least)):
        assert a.tolist() == b.tolist()


def test_roots_are_components():
    r = np.random.default_rng(3)
    for n, m in ((50, 30), (400, 380), (9, 0), (300, 900)):
        i, j = r.integers(0, n, (2, m))
        up = list(range(n))
        for a, b in zip(i.tolist(), j.tolist()):
            x, y = up[a], up[b]
            up = [min(x, y) if u in (x, y) else u for u in up]
        assert sj.roots_of(n, i, j).tolist() == up
    chain = np.arange(4999)
    assert not sj.roots_of(5000, chain, chain + 1).any()


def test_both_ways_of_counting_agree():
    r = np.random.default_rng(2)
    a = [np.unique(r.integers(0, 9000, 300).astype(np.uint64)) for _ in range(20)]
    assert sj._common_counts(a, a[:7]).tolist() == [[float(len(np.intersect1d(x, y))) for y in a[:7]] for x in a]


def test_pairs_of_unlike_sizes_have_no_links():
    sets = [np.arange(n, dtype=np.uint64) for n in (10, 100, 100)]
    assert [x.tolist() for x in sj.exact_links(sets, np.array([0, 0]), np.array([1, 2]))] == [[], []]
    assert [x.tolist() for x in sj.exact_links(sets, np.array([], int), np.array([], int))] == [[], []]
    assert [x.tolist() for x in sj.exact_links(sets, np.array([0, 1]), np.array([1, 2]))] == [[1], [2]]


def test_edges(edge_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert sorted(map(tuple, sj.near_duplicates(edge_docs).collect()), key=repr) == brute(docs)
    assert sj.near_duplicates(no_docs).count() == 0


def test_there_is_one_threshold():
    import inspect

    assert "threshold" not in inspect.signature(sj.near_duplicates).parameters  # bands and pruning are for THRESHOLD
