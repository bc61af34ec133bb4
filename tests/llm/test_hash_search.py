import math
import random

import numpy as np
import pytest

from kestrane.llm import hash_search as module
from kestrane.llm.hash_search import Index, Rotation, nearest_vectors, share_of, substring

SCHEMA = "vec_id long, embedding array<double>, score string"


def brute(rows, top=20, every=20):
    whole = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    width = max([len(v) for _, v in whole], default=0)
    whole = [(i, np.array(list(v) + [0.0] * (width - len(v)))) for i, v in whole]
    queries = {}
    for i, v in whole:
        if i % every == 0 and (i not in queries or v.tolist() < queries[i].tolist()):
            queries[i] = v
    out = []
    for i, q in queries.items():
        scored = sorted((-float((v * q).sum()), j) for j, v in whole if j != i)
        out += [(i, r, j, -s) for r, (s, j) in enumerate(scored[:top], 1)]
    return sorted(out)


def rows(df):
    return sorted(map(tuple, df.collect()))


def vectors(spark, found):
    return spark.createDataFrame([(i, v, "x") for i, v in found], SCHEMA)


def recall(got, want):
    pairs = {(q, v) for q, _, v, _ in want}
    return len(pairs & {(q, v) for q, _, v, _ in got}) / max(1, len(pairs))


def gaussian(n, width, seed, lengths=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    x *= rng.uniform(0.2, 3, (n, 1)) if lengths else 1 / np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, v) for i, v in enumerate(x.tolist())]


def test_pigeonhole_shares_find_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 63, 400, dtype=np.uint64) << np.uint64(1)
    query = codes[:20] ^ np.array([sum(1 << b for b in random.Random(i).sample(range(64), i)) for i in range(20)], np.uint64)
    for radius in (0, 1, 5, 13, 22, 31):
        found = []
        for part in range(module.PARTS):
            if share_of(radius, part) >= 0:
                index = Index(part, np.arange(400), codes, np.zeros((400, 1)))
                q, r = index.probe(query, radius)
                found += list(zip(q.tolist(), index.ids[r].tolist()))
        apart = np.bitwise_count(query[:, None] ^ codes)
        assert len(found) == len(set(found))
        assert set(found) == set(zip(*(x.tolist() for x in np.nonzero(apart <= radius))))


def test_rotation_keeps_near_vectors_near():
    x = np.array([v for _, v in gaussian(2000, 65, 3)])
    rotation = Rotation(x, 64, 20)
    near = x + np.random.default_rng(4).normal(size=x.shape) * 0.02
    apart = np.bitwise_count(rotation.codes(x) ^ rotation.codes(near))
    other = np.bitwise_count(rotation.codes(x) ^ np.roll(rotation.codes(x), 1))
    assert apart.mean() < 8 and other.mean() > 25
    assert substring(rotation.codes(x), 3).max() < 1 << module.WIDTH


@pytest.mark.parametrize("rows_of,lengths", [(4096, False), (100, True)])
def test_recall_and_exact_scores(spark, rows_of, lengths):
    data = gaussian(1500, 24, 5, lengths)
    want = brute(data)
    got = rows(nearest_vectors(vectors(spark, data), bucket_rows=rows_of))
    assert recall(got, want) >= 0.9
    assert len({(q, r) for q, r, *_ in got}) == len(got) == len(want)
    scores = {(q, v): s for q, _, v, s in brute(data, top=1500)}
    assert all(scores[q, v] == pytest.approx(s, abs=1e-12) for q, _, v, s in got)


def test_radius_of_all_bits_is_exact(spark):
    data = gaussian(900, 24, 6, True)
    assert [r[:3] for r in rows(nearest_vectors(vectors(spark, data), radius=64, bucket_rows=64))] == [r[:3] for r in brute(data)]


def test_given_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in table.collect()])
    got = rows(nearest_vectors(table))
    assert recall(got, want) >= 0.9 and len(got) == len(want)


def test_hot_vector_is_cut_and_ties_go_by_id(spark):
    same = [0.6, 0.8, 0.0, 0.1]
    data = [(i, same) for i in range(0, 700)] + [(1000 + i, v) for i, v in gaussian(200, 4, 8)]
    random.Random(1).shuffle(data)
    got = nearest_vectors(vectors(spark, data), bucket_rows=32)
    assert [r[2] for r in rows(got.where("query_id = 20"))] == [i for i in range(21) if i != 20]
    assert recall(rows(got), brute(data)) >= 0.9


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (20, [0.0, 1.0]), (3, [1.0]), (4, [0.5, 0.5]), (4, [0.5, 0.5]), (5, None), (6, []), (7, [0.0, 0.0]), (40, [nan, 1.0]), (9, [inf, 1.0]), (10, [None, 1.0]), (None, [1.0, 1.0]), (60, [0.0, 0.0]), (-20, [3.0, 4.0])]
    got = nearest_vectors(vectors(spark, data))
    assert rows(got) == brute(data)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    assert nearest_vectors(vectors(spark, [])).count() == 0
    assert nearest_vectors(vectors(spark, [(20, [1.0])])).count() == 0
    assert nearest_vectors(vectors(spark, [(1, [1.0]), (2, [2.0])])).count() == 0
