import hashlib
import re

from pyspark.sql import functions as F

from kestrane.llm import fingerprints as fp
from kestrane.llm.fingerprints import fingerprints
from kestrane.llm.queries import op4_document_fingerprints


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def neighbours(docs, spark=None):
    """Rows with the row that follows; the order of equal ids is by Spark's hash."""
    texts = sorted({t for _, t in docs})
    hashes = {r.text: r.h for r in spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.xxhash64("text").alias("h")).collect()} if spark else {}
    order = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), hashes.get(d[1], 0), d[1]))
    return [(a, b) for a, b in zip(order, order[1:] + order[:1])]


def edited(text, following):
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def check(docs, got, spark=None):
    want = sorted(((d[0], len(d[1]), hashlib.sha256(edited(d[1], n[1]).encode()).hexdigest()) for d, n in neighbours(docs, spark)), key=repr)
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == want


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = op4_document_fingerprints(spark, sf_dir).collect()
    check(docs, got)
    by_id, text = {r.doc_id: r for r in got}, dict(docs)
    same = {}
    for d, t in docs:
        same.setdefault(t, set()).add(by_id[d].fingerprint)
    assert all(len(x) == 1 for x in same.values())
    errors = []
    for (d, t), (_, n) in neighbours(docs):
        a, b, c = shingles(t), shingles(edited(t, n)), shingles(n)
        errors += [by_id[d].jaccard_edited - len(a & b) / len(a | b), by_id[d].jaccard_next - len(a & c) / len(a | c)] if len(a) > 100 else []
    assert sum(map(abs, errors)) / len(errors) < 0.05 and abs(sum(errors)) / len(errors) < 0.01
    assert sum(r.near_edited for r in got) > 5 * sum(r.near_next for r in got)


def test_edges(spark, edge_docs, no_docs):
    docs = [(r.doc_id, r.text or "") for r in edge_docs.collect()]
    got = fingerprints(edge_docs).collect()
    check(docs, got, spark)
    assert all(r.fingerprint == "" for r in got if r.doc_id in (4, 5, 6)) and all(r.fingerprint for r in got if r.doc_id == 2)
    assert fingerprints(no_docs).count() == 0
    one = spark.createDataFrame([(5, "a b")], "doc_id long, text string")
    assert [(r.near_next, r.n_chars) for r in fingerprints(one).collect()] == [(1.0, 3)]


def test_many_ranges_and_ids_with_many_rows(spark, monkeypatch):
    monkeypatch.setattr(fp, "ROWS", 16)
    many = [(i * i * 7 % 100003, f"t{i} x y z u v {i}") for i in range(700)]
    check(many, fingerprints(spark.createDataFrame(many, "doc_id long, text string")).collect(), spark)
    hot = many[:100] + [(7, f"seven {i} of {i * i}") for i in range(300)] + [(None, f"none {i}") for i in range(200)] + [((1 << 63) - 1, f"last {i}") for i in range(90)] + [(7, "seven again")] * 40
    rows = spark.createDataFrame(hot, "doc_id long, text string")
    check(hot, fingerprints(rows).collect(), spark)
    with monkeypatch.context() as m:  # fewer ranges than there are rows for: the parts of ids with many rows stay few as well
        m.setattr(fp, "RANGES", 6)
        check(hot, fingerprints(rows).collect(), spark)
    parted = fp.with_next(rows, ["text"]).withColumn("p", F.spark_partition_id()).groupBy("p").count()
    assert parted.count() > 1


def test_united_sketches_are_the_sketch_of_the_union(spark):
    words = [f"w{i}" for i in range(60)]
    pairs = [(" ".join(words[:n]), " ".join(words[m:])) for n, m in ((40, 20), (4, 57), (3, 58), (0, 60), (60, 60), (5, 55))]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = fp.with_sketch(fp.with_sketch(df, "a", "sa"), "b", "sb").withColumn("u", fp.united(F.col("sa"), F.col("sb"))).orderBy("i").collect()
    for r, (a, b) in zip(got, pairs):
        every = [h for t in (a, b) if t for h in fp_hashes(spark, t)]
        below = sorted({h for h in every if h < fp._threshold(fp.FRACTION)})
        assert r.u == (below or sorted(every)[:1])


def fp_hashes(spark, text):
    w = text.split()
    runs = [w[i : i + 5] for i in range(max(1, len(w) - 4))]
    return [r.h for r in spark.createDataFrame([(x,) for x in runs], "w array<string>").select(F.xxhash64("w").alias("h")).collect()]
