"""Ranked lexical search by MaxScore over shards of the documents.

Items are searched in blocks of a bounded number of terms. For a block, one pass turns the
documents into postings of the block's terms, with the corpus counts beside them; a second
reads the postings in shards. In a shard, an item's terms are ordered by their upper bounds
(the greatest share of a score that a posting there has). Terms whose bounds together stay
under the item's threshold, the score of its last place so far, are non-essential: documents
come from the postings of the essential terms alone, and the others are probed, greatest
bound first, only while a document can still reach the threshold. Each task gives at most
`top` documents an item, so what is merged in the end is small.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import _arrow_schema, materialise, sliced, text_of

TOP = 20
#: Terms of the items of a block; postings of a shard; documents of a step within it; bytes split at a time; parts of an item's first merge.
BLOCK_TERMS, SHARD, STEP, PIECE, PARTS = 1 << 17, 1 << 21, 4096, 1 << 22, 64

#: Bytes outside terms become spaces, A-Z lower case; bytes from 0x80 on belong to code points that are all inside terms.
_TABLE = bytes(b | 0x20 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_POSTINGS = "summary boolean, doc_id long, docs long, n long, terms array<int>, counts array<long>"
_FOUND = "item long, item_id long, doc_id long, score long"


def term_runs(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of a bounded size."""
    data = text.encode().translate(_TABLE)
    at = 0
    while len(data) - at > PIECE:
        end = data.rfind(b" ", at, at + PIECE)
        end = end if end > at else data.find(b" ", at + PIECE)
        if end < 0:
            break
        yield data[at:end].split()
        at = end
    yield data[at:].split()


class Items:
    """A block of items: their terms as numbers of the block's vocabulary, with repeats counted."""

    def __init__(self, first: int, rows: list[tuple[int | None, Counter]]):
        self.first, self.ids = first, [i for i, _ in rows]
        self.vocabulary = {t: k for k, t in enumerate(sorted(set().union(*(c for _, c in rows))))}
        self.terms = [np.array([self.vocabulary[t] for t in c], np.int64) for _, c in rows]
        self.repeats = [np.array(list(c.values()), np.int64) for _, c in rows]


def item_blocks(items: DataFrame, text: str, item_id: str, size: int) -> Iterator[Items]:
    """The items in blocks of about `size` terms; only one block is held at a time."""
    rows, held, first = [], 0, 0
    for item, words in items.select(items[item_id].cast("long"), text_of(text)).toLocalIterator():
        counts = Counter()
        for run in term_runs(words):
            counts.update(run)
        rows.append((item, counts))
        held += len(counts)
        if held >= size:
            yield Items(first, rows)
            rows, held, first = [], 0, first + len(rows)
    if held:
        yield Items(first, rows)


def postings(docs: DataFrame, vocabulary: dict[bytes, int], text: str, doc_id: str) -> DataFrame:
    """One row a document with terms: its length, the vocabulary's terms in it and how often; and a summary a task, with documents, terms and document frequencies."""
    schema = _arrow_schema(_POSTINGS, docs.sparkSession)

    def batch(summary, ids, docs, n, terms, counts):
        offsets = np.cumsum([0] + [len(t) for t in terms]).astype(np.int32)
        flat = lambda parts, kind: pa.array(np.concatenate([np.zeros(0, kind), *parts]).astype(kind))
        columns = [pa.array([summary] * len(n), pa.bool_()), pa.array(ids, pa.int64()), pa.array(docs, pa.int64()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, flat(terms, np.int32)), pa.ListArray.from_arrays(offsets, flat(counts, np.int64))]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, df, held, total = vocabulary.get, np.zeros(len(vocabulary), np.int64), 0, 0
        for part in sliced(batches):
            ids, n, terms, counts = [], [], [], []
            for key, words in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                length, found = 0, Counter()
                for t in term_runs(words):
                    length += len(t)
                    found.update(map(number, t))
                if length:
                    found.pop(None, None)
                    own = np.fromiter(found.keys(), np.int64, len(found))
                    df[own] += 1
                    ids.append(key)
                    n.append(length)
                    terms.append(own)
                    counts.append(np.fromiter(found.values(), np.int64, len(found)))
            held, total = held + len(n), total + sum(n)
            yield batch(False, ids, [None] * len(n), n, terms, counts)
        own = np.flatnonzero(df)
        yield batch(True, [None], [held], [total], [own], [df[own]])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, _POSTINGS)


class Best:
    """The best documents of one item so far: score, whether the id is null, id."""

    def __init__(self, top: int):
        self.top, self.rows, self.threshold = top, np.zeros((0, 3), np.int64), 0

    def add(self, score: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        rows = np.concatenate([self.rows, np.stack([score, null, ids], 1)])
        self.rows = rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))[: self.top]]
        if len(self.rows) == self.top:
            self.threshold = int(self.rows[-1, 0])


class Shard:
    """Postings of some documents by term, with the share of a score that each one gives."""

    def __init__(self, weights: np.ndarray, n_docs: int, n_terms: int, ids, null, n, sizes, terms, counts):
        self.ids, self.null, self.docs = ids, null, len(ids)
        longest = int(n.max(initial=0))
        n = n.astype(object) if 25 * longest * n_docs >= 1 << 63 else n
        norm = (100 - 25 + (25 * n * n_docs) // n_terms).astype(np.int64)
        doc = np.repeat(np.arange(len(ids)), sizes)
        order = np.argsort(terms, kind="stable")  # documents ascend within a term
        doc, terms, counts = doc[order], terms[order], counts[order]
        self.keys = terms * self.docs + doc
        self.doc = doc
        self.share = weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 12 * norm[doc]))
        self.bound = np.zeros(len(weights), np.int64)
        if len(terms):
            first = np.flatnonzero(np.diff(terms, prepend=-1))
            self.bound[terms[first]] = np.maximum.reduceat(self.share, first)

    def search(self, terms: np.ndarray, repeats: np.ndarray, best: Best) -> None:
        """Merge the shard's documents of one item into its best ones."""
        bounds = repeats * self.bound[terms]
        order = np.argsort(bounds, kind="stable")
        order = order[bounds[order] > 0]
        terms, repeats, reach = terms[order], repeats[order], np.cumsum(bounds[order])
        if not len(terms) or reach[-1] < best.threshold:
            return
        for low in range(0, self.docs, STEP):
            high = min(low + STEP, self.docs)
            begin, end = (np.searchsorted(self.keys, terms * self.docs + x) for x in (low, high))
            essential = int(np.searchsorted(reach, best.threshold))  # terms before this one cannot reach the threshold together
            score = np.zeros(high - low, np.int64)
            for k in range(essential, len(terms)):
                score[self.doc[begin[k] : end[k]] - low] += repeats[k] * self.share[begin[k] : end[k]]
            found = np.flatnonzero(score)
            for k in range(essential - 1, -1, -1):
                found = found[score[found] + reach[k] >= best.threshold]
                if not len(found):
                    break
                own = self.doc[begin[k] : end[k]] - low
                if len(own):
                    at = np.minimum(np.searchsorted(own, found), len(own) - 1)
                    held = own[at] == found
                    score[found[held]] += repeats[k] * self.share[begin[k] + at[held]]
            found = found[score[found] >= best.threshold]
            if len(found):
                best.add(score[found], self.null[low + found], self.ids[low + found])


def _search(rows: DataFrame, items: Items, weights: np.ndarray, n_docs: int, n_terms: int, top: int, size: int) -> DataFrame:
    schema = _arrow_schema(_FOUND, rows.sparkSession)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
        held, postings = [], 0

        def shard() -> Shard:
            t = pa.Table.from_batches(held)
            terms, counts = (t.column(c).combine_chunks() for c in ("terms", "counts"))
            ids = t.column("doc_id")
            return Shard(weights, n_docs, n_terms, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy().astype(np.int64), t.column("n").to_numpy(), terms.value_lengths().to_numpy(), terms.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy())

        for part in sliced(batches):
            held.append(part)
            postings += len(part.column(2).flatten()) + part.num_rows
            if postings >= size:
                yield shard()
                held, postings = [], 0
        if held:
            yield shard()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in items.ids]
        for shard in shards(batches):
            for b, terms, repeats in zip(best, items.terms, items.repeats):
                shard.search(terms, repeats, b)
        for i, (item, b) in enumerate(zip(items.ids, best)):
            if k := len(b.rows):
                columns = [pa.array([items.first + i] * k), pa.array([item] * k, pa.int64()), pa.array(b.rows[:, 2], mask=b.rows[:, 1] > 0), pa.array(b.rows[:, 0])]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return rows.mapInArrow(run, _FOUND)


def _best(found: DataFrame, top: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def lexical_search(docs: DataFrame, items: DataFrame, top: int = TOP, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", block: int = BLOCK_TERMS, shard: int = SHARD) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` documents with the highest score above 0 for each row of items.

    Equal scores go by ascending doc_id, null last. Null texts have no terms; an item without
    terms, or whose terms no document holds, has no rows, and empty tables give none. Repeated
    ids and repeated rows are documents and items of their own, each item row with its own
    ranks. Texts of any length are read whole; other columns, whatever their names, play no part.
    """
    spark = docs.sparkSession
    out = []
    for part in item_blocks(items, item_text, item_id, block):
        rows = materialise(postings(docs, part.vocabulary, text, doc_id), "postings")
        summary = rows.where("summary")
        n_docs, n_terms = summary.agg(F.sum("docs"), F.sum("n")).first()
        if not n_docs:
            break
        weights = np.zeros(len(part.vocabulary), np.int64)
        held = summary.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.counts").alias("df"))
        for term, df in held.collect():  # no more rows than the block has terms
            weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        out.append(_search(rows.where("NOT summary").select("doc_id", "n", "terms", "counts"), part, weights, n_docs, n_terms, top, shard))
    found = out[0] if out else spark.createDataFrame([], _FOUND)
    for more in out[1:]:
        found = found.unionAll(more)
    found = _best(found.withColumn("part", F.pmod(F.hash("doc_id"), F.lit(PARTS))), top, "item", "part").drop("rank")
    return _best(found, top, "item").select("item_id", "rank", "doc_id", "score")
