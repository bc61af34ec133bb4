"""Toxicity by the nearest labelled examples under TF-IDF cosine.

Terms are all words in a bounded sample of labelled rows, pairs of characters where a script has
no spaces, and a mark of how dense a text is in terms that go with the label; those terms and marks weigh more.
Their document frequencies are counted over the whole corpus. The examples' vectors lie in an
inverted index of blocks, each with the greatest weight that any term has in it. A search
visits blocks by falling upper bound and stops when none can reach the k-th best, so its
neighbours are exact; all that tie with the k-th count. Their votes, weighted by cosine and by
the share of the labelled rows that their class's sample is, give a raw score, which is
calibrated by isotonic regression on the examples, each left out of its own neighbours.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SLICE, map_rows, materialise, sliced, text_of, tidy

#: Labelled rows in the sample, of each label; neighbours; examples in a block.
EXAMPLES, NEIGHBOURS, BLOCK = 1000, 15, 64
#: Share of the examples above which a term's weights lie in the dense matrix.
OFTEN = 1 / 16
#: Marks of density, each twice as dense as the one before.
DENSITIES = 11
#: How many times the weight a term has that goes with the label: the log-likelihood ratio and the lift from which it does.
BOOST, RATIO, LIFT = 16.0, 15.0, 4.0
THRESHOLD = 0.7
#: Texts whose scores one worker remembers.
KNOWN = 10_000
_WORD = re.compile(r"[^\W\d_]+")
#: Letters of scripts without spaces between words.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\U00020000-\U0003ffff]")


def terms_of(text: str) -> list[str]:
    """The words of a text in lower case; of a word in a script without spaces, all its pairs of characters."""
    words = _WORD.findall(text.lower())
    if text.isascii() or not _UNSPACED.search(text):
        return words
    return [t for w in words for t in ([w[i : i + 2] for i in range(max(1, len(w) - 1))] if _UNSPACED.search(w) else (w,))]


class Vectors:
    """Term numbers and counts of texts, over a fixed table of terms, of which the first `marked` go with the label."""

    def __init__(self, terms: list[str], marked: int):
        self.marked = marked
        self.terms = {t: i for i, t in enumerate(terms)}

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Terms and their counts; the term len(terms) + b marks a density of about 2^b marked terms in 1024."""
        every = terms_of(text)
        found = Counter(every)
        terms = np.array(list(map(self.terms.get, found, repeat(-1))), np.int64)
        counts = np.fromiter(found.values(), np.int64, len(found))
        here = terms >= 0
        terms, counts = terms[here], counts[here]
        hits = int(counts[terms < self.marked].sum())
        if hits:
            terms, counts = np.append(terms, len(self.terms) + int(np.log2(1 + 1023 * hits / len(every)))), np.append(counts, 1)
        return terms, counts


class Index:
    """Exact top-k cosine over the examples, by blocks with the greatest weight of each term.

    Terms that many examples hold would have postings nearly everywhere: their weights lie in
    a dense matrix, with which the shares of a batch of texts in all cosines are one product.
    The greatest of those shares in a block and the greatest weights of the other terms there
    bound the block's cosines; blocks are visited by falling bound.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, labels: np.ndarray, ids: list[int]):
        """vectors: terms and their counts."""
        unit = [self.weighed(*v, idf) for v in vectors]
        # alike examples side by side: by their heaviest terms
        order = sorted(range(len(unit)), key=lambda i: (unit[i][0][np.lexsort((unit[i][0], -unit[i][1]))[:3]].tolist(), i))
        unit = [unit[i] for i in order]
        self.idf, self.labels, self.ids = idf, labels[order], [ids[i] for i in order]
        sizes = np.array([len(t) for t, _ in unit], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.row_terms = np.concatenate([np.zeros(0, np.int32), *(t for t, _ in unit)]).astype(np.int32)
        self.row_weights = np.concatenate([np.zeros(0), *(w for _, w in unit)])
        self.blocks = np.arange(0, len(unit), BLOCK)
        rows = np.repeat(np.arange(len(unit)), sizes)
        often = np.bincount(self.row_terms, minlength=len(idf)) > len(unit) * OFTEN
        self.column = np.where(often, np.cumsum(often) - 1, -1)
        dense = often[self.row_terms]
        self.dense = np.zeros((int(often.sum()), len(unit)))
        self.dense[self.column[self.row_terms[dense]], rows[dense]] = self.row_weights[dense]
        # postings of the other terms, by term and example, and the runs of a term in a block, each with its greatest weight
        by = np.flatnonzero(~dense)[np.argsort(self.row_terms[~dense], kind="stable")]
        self.at, self.weight, terms = rows[by], self.row_weights[by], self.row_terms[by]
        block = self.at // BLOCK
        new = np.flatnonzero(np.concatenate([[True], (terms[1:] != terms[:-1]) | (block[1:] != block[:-1])])) if len(by) else np.zeros(0, np.int64)
        self.run = np.append(new, len(by))
        self.block = block[new]
        self.most = np.maximum.reduceat(self.weight, new) if len(new) else np.zeros(0)
        self.runs = np.searchsorted(terms[new], np.arange(len(idf) + 1))

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of an example, a vector of length 1."""
        a, b = self.starts[i], self.starts[i + 1]
        return self.row_terms[a:b], self.row_weights[a:b]

    @staticmethod
    def weighed(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = (1 + np.log(counts)) * idf[terms]
        norm = np.sqrt((x * x).sum())
        return (terms, x / norm) if norm else (terms[:0], x[:0])

    def nearest(self, texts: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, without: list[int] | None = None) -> list[list[tuple[int, float]]]:
        """For each vector (terms, weights) the (example, cosine) of the k nearest and of all that tie with the last, by falling cosine.

        Only cosines above 0. `without`: an example for each vector that is left out.
        """
        q = np.zeros((len(texts), len(self.dense)))
        for i, (terms, weights) in enumerate(texts):
            column = self.column[terms]
            q[i, column[column >= 0]] = weights[column >= 0]
        shares = q @ self.dense
        return [self._nearest(shares[i], *v, k, without[i] if without else -1) for i, v in enumerate(texts)]

    def _nearest(self, scores: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, without: int) -> list[tuple[int, float]]:
        """The search of one text; scores: the dense terms' shares in all cosines."""
        if not len(scores):
            return []
        rare = self.column[terms] < 0
        terms, weights = terms[rare], weights[rare]
        runs, sizes = _expanded(self.runs[terms], self.runs[terms + 1])
        weights, blocks, n = np.repeat(weights, sizes), self.block[runs], len(self.blocks)
        bound = np.maximum.reduceat(scores, self.blocks) + np.bincount(blocks, weights * self.most[runs], n)
        order, done = np.argsort(-bound, kind="stable"), np.zeros(n, bool)
        kth, lo, step, found = 0.0, 0, 4, np.zeros(len(scores))
        while lo < n and bound[order[lo]] > 0 and bound[order[lo]] >= kth - 1e-9:
            visit = np.zeros(n, bool)
            visit[order[lo : lo + step]] = True
            visit &= bound >= kth - 1e-9
            at = visit[blocks]
            postings, sizes = _expanded(self.run[runs[at]], self.run[runs[at] + 1])
            scores += np.bincount(self.at[postings], self.weight[postings] * np.repeat(weights[at], sizes), len(scores))
            done |= visit
            found = np.where(np.repeat(done, BLOCK)[: len(scores)], scores, 0.0)
            if without >= 0:
                found[without] = 0.0
            if len(found) >= k:
                kth = np.partition(found, -k)[-k]
            lo, step = lo + step, 4 * step
        near = np.flatnonzero(found >= max(kth - 1e-9, 1e-12))
        near = near[np.lexsort((near, -found[near].round(9)))]
        return list(zip(near.tolist(), found[near].tolist()))


def _expanded(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges in a row, and the sizes of the ranges."""
    sizes = ends - starts
    out = np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
    out += np.arange(len(out))
    return out, sizes


class Scorer:
    """Calibrated scores of texts, with their nearest examples."""

    def __init__(self, vectors: Vectors, index: Index, class_weight: tuple[float, float]):
        self.vectors, self.index, self.class_weight = vectors, index, class_weight
        empty = np.flatnonzero(np.diff(index.starts) == 0).tolist()
        self.base = self._share(empty or range(len(index.labels)))
        self.cuts, self.values = self._calibrate()
        self.known: dict[bytes, tuple[float, str]] = {}

    def _share(self, examples) -> float:
        w = [self.class_weight[int(self.index.labels[i])] for i in examples]
        return sum(x for x, i in zip(w, examples) if self.index.labels[i]) / (sum(w) + 1e-9)

    def _raw(self, near: list[tuple[int, float]]) -> float:
        """Votes by squared cosine, with one vote's worth of the base share."""
        w = [(s * s * self.class_weight[int(self.index.labels[i])], self.index.labels[i]) for i, s in near]
        prior = min(self.class_weight)
        return (sum(x for x, y in w if y) + prior * self.base) / (sum(x for x, _ in w) + prior)

    def _calibrate(self) -> tuple[np.ndarray, np.ndarray]:
        """Pools of adjacent raw scores, so that the share of label 1 never falls as the score rises."""
        pools = []
        labels, row = self.index.labels, self.index.row
        known = np.flatnonzero(np.diff(self.index.starts)).tolist()
        near = [x for lo in range(0, len(known), SLICE) for x in self.index.nearest([row(i) for i in known[lo : lo + SLICE]], without=known[lo : lo + SLICE])]
        raw = sorted((self._raw(x), self.class_weight[int(labels[i])], int(labels[i])) for i, x in zip(known, near))
        for r, w, y in raw:
            pools.append([r, r, w, w * y])
            while len(pools) > 1 and (pools[-2][1] == pools[-1][0] or pools[-2][3] * pools[-1][2] >= pools[-1][3] * pools[-2][2]):
                _, high, a, b = pools.pop()
                pools[-1][1] = high
                pools[-1][2] += a
                pools[-1][3] += b
        if not pools:
            return np.array([0.0, 1.0]), np.array([0.0, 1.0])
        return np.array([x for p in pools for x in p[:2]]), np.array([p[3] / p[2] for p in pools for _ in (0, 1)])

    def scores(self, texts: list[str]) -> list[tuple[float, str]]:
        """The score of each text and up to three nearest examples as id:label:cosine; equal texts are looked up once."""
        keys = [hashlib.blake2b(t.encode(), digest_size=16).digest() for t in texts]
        out = {k: self.known[k] for k in keys if k in self.known}
        new = {k: t for k, t in zip(keys, texts) if k not in out}
        vectors = {k: v for k, v in zip(new, map(self.vectors.counts, new.values())) if len(v[0])}
        near = self.index.nearest([self.index.weighed(*v, self.index.idf) for v in vectors.values()])
        out |= dict.fromkeys(new.keys() - vectors.keys(), (float(min(1.0, max(0.0, self.base))), ""))
        out |= {k: self._told(x) for k, x in zip(vectors, near)}
        if len(self.known) > KNOWN:
            self.known.clear()
        self.known |= {k: out[k] for k in new}
        return [out[k] for k in keys]

    def _told(self, near: list[tuple[int, float]]) -> tuple[float, str]:
        raw = self._raw(near)
        # the raw score breaks ties between equal pools; digits that depend on the order of addition go
        value = round(0.999 * float(np.interp(raw, self.cuts, self.values)) + 0.001 * raw, 9)
        return min(1.0, max(0.0, value)), ",".join(f"{self.index.ids[i]}:{int(self.index.labels[i])}:{s:.3f}" for i, s in near[:3])

    def score(self, text: str) -> tuple[float, str]:
        return self.scores([text])[0]


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 1, F.lit(False))


def _examples(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str) -> tuple[DataFrame, tuple[float, float]]:
    """(doc_id, label, text) of the sample, and what one example of either label stands for."""
    known = labels.filter(~held_out(F.col(doc_id)) & F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("id")).agg((F.max(label) > 0).cast("int").alias("label"))
    totals = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    picked = []
    for y in (0, 1):  # a sample of fixed size: the smallest hashes
        picked += known.filter(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(EXAMPLES).collect()
    taken = Counter(r.label for r in picked)
    weight = tuple(totals.get(y, 0) / taken[y] if taken[y] else 1.0 for y in (0, 1))
    sample = docs.sparkSession.createDataFrame(picked, known.schema)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), text_of(text).alias("text")).join(F.broadcast(sample), "id")
    # where an id repeats, the text that hashes lowest
    rows = rows.groupBy("id").agg(F.min_by(F.struct("label", "text"), F.struct(F.xxhash64("text"), F.col("text"))).alias("r"))
    return materialise(rows.select("id", "r.label", "r.text"), "examples"), weight


def _terms(sample: DataFrame) -> tuple[list[str], int]:
    """All terms of the sample, first those that go with label 1, by the log-likelihood ratio of their document counts, and how many these are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n[label].update({"", *terms_of(text)})
        terms = sorted(n[0].keys() | n[1].keys())
        yield pa.RecordBatch.from_pydict({"term": pa.array(terms, pa.string()), "n0": pa.array([n[0][t] for t in terms], pa.int64()), "n1": pa.array([n[1][t] for t in terms], pa.int64())})

    counts = sample.select("text", "label").mapInArrow(count, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("a"), F.sum("n1").alias("b"))
    total = counts.filter("term = ''").head()
    if total is None:
        return [], 0
    a, b, na, nb = F.col("a"), F.col("b"), F.lit(float(max(total.a, 1))), F.lit(float(max(total.b, 1)))
    share = (a + b) / (na + nb)
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    ratio = 2 * (part(a, na * share) + part(b, nb * share) + part(na - a, na * (1 - share)) + part(nb - b, nb * (1 - share)))
    best = counts.filter("term <> ''").withColumn("g", F.round(ratio, 9)).filter((F.col("g") > RATIO) & (b / nb > LIFT * a / na) & (b >= 3))
    marked = [r.term for r in best.orderBy(F.desc("g"), "term").collect()]
    every = counts.filter("term <> ''").select("term").toArrow().column(0).to_pylist()  # as many as two samples of a fixed size hold
    return marked + sorted(set(every) - set(marked)), len(marked)


def _document_counts(docs: DataFrame, terms: list[str], marked: int, text: str) -> tuple[np.ndarray, int]:
    """How many documents of the corpus hold each term, and how many there are."""
    size = len(terms) + DENSITIES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, n = Vectors(terms, marked), np.zeros(size + 1, np.int64)
        for batch in sliced(batches):
            for t in batch.column(0).to_pylist():
                n[vectors.counts(t)[0]] += 1
            n[size] += batch.num_rows
        tidy()
        yield pa.RecordBatch.from_pydict({"term": pa.array(np.arange(size + 1), pa.int64()), "n": pa.array(n)})

    got = docs.select(text_of(text).alias("text")).mapInArrow(count, "term long, n long").filter("n > 0").groupBy("term").agg(F.sum("n").alias("n"))
    n = np.zeros(size + 1, np.int64)
    got = got.toArrow()  # one row a term
    n[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return n[:size], int(n[size])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Scorer:
    """The scorer, from the labelled rows outside the held-out third and the whole corpus's counts."""
    sample, weight = _examples(docs, labels, doc_id, text, label)
    terms, marked = _terms(sample)
    df, n = _document_counts(docs, terms, marked, text)
    idf = np.log((1 + n) / (1 + df)) + 1
    idf[:marked] *= BOOST
    idf[len(terms) :] *= BOOST
    rows = sample.orderBy("id").toArrow()  # two samples of a fixed size
    vectors = Vectors(terms, marked)
    index = Index([vectors.counts(t) for t in rows.column("text").to_pylist()], idf, rows.column("label").to_numpy().astype(int), rows.column("id").to_pylist())
    return Scorer(vectors, index, weight)


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted, evidence: one row per row of docs.

    evidence: up to three nearest examples as doc_id:label:cosine. Only the text is scored.
    Null text counts as empty; a text without any term of the examples has the share of label 1
    among the examples without terms. Without labels every score is 0. Null and repeated ids and
    repeated rows pass through, an empty table gives no rows, texts of any length are scored
    whole, and other columns of docs and labels, whatever their names, play no part. Labels
    without an id or a value teach nothing; an id with several labels has the greatest.
    """
    handed = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, doc_id, text, label))  # bounded: the words of two samples

    def make():
        scorer = handed.value

        def work(doc_id, text):
            got = scorer.scores(text)
            return {"doc_id": doc_id, "score": [s for s, _ in got], "evidence": [e for _, e in got]}

        return work

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    out = map_rows(rows, make, "doc_id long, score double, evidence string", lambda: handed.value.known.clear())
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


def without_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """The rows of docs that score below THRESHOLD, with all their columns, whatever their names.

    Null text counts as empty; null and repeated ids and repeated rows are judged by their text.
    Without labels all rows stay. An empty table gives no rows.
    """
    handed = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, doc_id, text, label))

    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = handed.value
        for batch in sliced(batches):
            got = scorer.scores([t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array([s < THRESHOLD for s, _ in got], pa.bool_()))
        scorer.known.clear()
        tidy()

    return docs.mapInArrow(keep, docs.schema)
