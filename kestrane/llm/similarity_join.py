"""Near duplicates: Jaccard join on word shingles with Bayesian candidate pruning.

1. Every text becomes its set of five-word shingles and that set's MinHash values. Texts
   with the same set are one node with a number of copies.
2. Nodes whose values agree on a whole band meet in a bucket. Buckets that hold the same
   nodes are one. A large bucket is split into blocks of nodes, and its nodes go to pairs of
   blocks; pairs of nodes are looked at inside a task and never given out as rows.
3. Pairs are compared a few values at a time. With m of n values equal, a pair is dropped as
   soon as the posterior probability that its similarity reaches the threshold, under a
   uniform prior, is below the tolerance; only pairs that are left look at the next values.
4. What survives links nodes into components; inside a component, again by pairs of blocks,
   all pairs go through the pruning and the survivors are verified exactly on their shingles.

A task sees two blocks at a time, whatever the size of a bucket or of a group of near copies,
and gives out as many rows as it has nodes: their links and a spanning forest of them. A block
is bounded in nodes and, where it holds shingles, in their number. Shingles stand for their
64-bit hashes and nodes for the 128-bit hash of their set: two sets are taken for one with a
chance of about n^2 / 2^129 over n texts, which is not checked further.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialise, sliced, text_keys, text_of, tidy

WORDS, THRESHOLD = 5, 0.8
#: MinHash values in all and in a band: a pair at 0.8 misses all 32 bands with a chance of 3e-6.
VALUES, BAND = 160, 5
#: Posterior probability below which a pair is dropped; values compared at a time.
TOLERANCE, STEP = 1e-6, 16
#: Nodes and shingles of a block, and nodes of it that are compared with the other block at a time.
BLOCK, BLOCK_SHINGLES, STRIP = 2048, 1 << 22, 256
#: Nodes up to which groups are compared side by side; pairs that are compared at a time.
SMALL, PAIRS = 64, 1 << 17
#: Documents up to which the table of those to verify is broadcast (16 MB); it is shuffled beyond.
BROADCAST_NODES = 500_000
CACHE = 100_000

_rng = np.random.default_rng(20_011)
_A = (_rng.integers(0, 1 << 63, VALUES, np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, VALUES, np.uint64)
_M = (_rng.integers(0, 1 << 63, WORDS, np.uint64) << np.uint64(1)) | np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHashes()


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of `words` words, or of all words if there are fewer."""
    w = text.encode().split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, w), np.uint64, len(w))
    n = min(words, len(w))
    total = np.zeros(len(w) - n + 1, np.uint64)
    for j in range(n):
        total += h[j : len(w) - n + 1 + j] * _M[j]
    return np.unique(_mixed(total + np.uint64(n)))


def minhash(sh: np.ndarray) -> np.ndarray:
    out = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(sh), 2048):
        part = sh[lo : lo + 2048]
        out = np.minimum(out, ((part[None, :] * _A[:, None] + _B[:, None]) >> np.uint64(32)).astype(np.uint32).min(axis=1))
    return out


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For n values compared, the fewest equal ones with which a pair is kept.

    The posterior after m of n, with a uniform prior, is Beta(m + 1, n - m + 1); its mass at
    or above t is the chance of at most m successes in n + 1 trials at t.
    """
    out = {}
    for n in range(STEP, VALUES + 1, STEP):
        tail = 0.0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                out[n] = m
                break
    return out


def surviving(x: np.ndarray, y: np.ndarray, same: bool, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i of x, j of y) that survive the pruning; i < j where the blocks are the same."""
    n = STEP
    equal = np.zeros((len(x), len(y)), np.int16)
    for k in range(n):
        equal += x[:, k, None] == y[None, :, k]
    keep = equal >= least[n]
    if same:
        keep = np.triu(keep, 1)
    i, j = np.nonzero(keep)
    matches = equal[i, j]
    while n < VALUES and len(i):
        matches = matches + (x[i, n : n + STEP] == y[j, n : n + STEP]).sum(axis=1)
        n += STEP
        kept = matches >= least[n]
        i, j, matches = i[kept], j[kept], matches[kept]
    return i, j


def still_alike(values: np.ndarray, i: np.ndarray, j: np.ndarray, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows (i, j) that survive the pruning."""
    n, matches = 0, np.zeros(len(i), np.int64)
    while n < VALUES and len(i):
        matches += (values[i, n : n + STEP] == values[j, n : n + STEP]).sum(axis=1)
        n += STEP
        kept = matches >= least[n]
        i, j, matches = i[kept], j[kept], matches[kept]
    return i, j


def roots_of(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row that each of n rows is connected to by the pairs (i, j)."""
    up = np.arange(n)
    while True:
        low, new = np.minimum(up[i], up[j]), up.copy()
        for at in (i, j, up[i], up[j]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == up).all():
            return up
        up = new


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """`roots_of` pairs that come by stretches, of which none is kept."""
    up = np.arange(n)
    for i, j in pairs:
        if len(i):
            lower = np.flatnonzero(up != np.arange(n))
            up = roots_of(n, np.concatenate([i, lower]), np.concatenate([j, up[lower]]))
    return up


def nodes_of(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, t1, t2, node (128-bit hash of the shingle set), n_shingles, values: one row per row.

    t1, t2: a 128-bit key of the text, as `text_keys` gives it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            node, n, values = [], [], []
            for t in batch.column(3).to_pylist():
                sh = shingles(t)
                node.append(xxhash.xxh3_128_digest(sh.tobytes()))
                n.append(len(sh))
                values.append(minhash(sh).tobytes())
            _words.clear()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(node, pa.binary()), pa.array(n, pa.int32()), pa.array(values, pa.binary())], names=["doc_id", "t1", "t2", "node", "n_shingles", "values"])
        tidy()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *text_keys(text), text_of(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, t1 long, t2 long, node binary, n_shingles int, values binary")


def _dealt(rows: DataFrame, blocks: Column) -> DataFrame:
    """rows (g, node, ...) dealt to pairs of blocks of their group g: with lo, hi and block.

    A node goes to every pair that its block is in: (block, other) for all blocks of its
    group. The block is drawn from the node, and there are as many as the group needs.
    """
    rows = rows.withColumn("blocks", F.greatest(F.lit(1), blocks).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other", "blocks")
    return rows.repartition("g", "lo", "hi").sortWithinPartitions("g", "lo", "hi")


def _over_groups(rows: DataFrame, work: Callable[[pa.Table, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """`work` over rows that are dealt and sorted by (g, lo, hi): it gets whole groups, as many as a batch holds, and where they start."""

    def starts(batch) -> np.ndarray:
        keys = np.stack([batch.column(c).to_numpy() for c in ("g", "lo", "hi")])
        return np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1

    def key(batch, at: int) -> tuple:
        return tuple(batch.column(c)[at].as_py() for c in ("g", "lo", "hi"))

    def told(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        return work(table, np.concatenate([[0], starts(table), [len(table)]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = starts(batch).tolist()
            if held and key(batch, 0) != key(held[-1], held[-1].num_rows - 1):
                new = [0, *new]
            if new:
                ready = [*held, *([batch.slice(0, new[-1])] if new[-1] else [])]
                if ready:
                    yield told(ready)
                held = []
            held.append(batch.slice(new[-1]) if new else batch)
        if held:
            yield told(held)
        held = []
        tidy()

    return rows.mapInArrow(run, schema)


def _matrix_of(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, VALUES)


def alike_rows(table: pa.Table, starts: np.ndarray, least: dict[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (i, j) that survive the pruning inside the groups of a table, by stretches: small groups side by side, then each large one."""
    values, (lo, hi, block) = _matrix_of(table["values"]), (table[c].to_numpy() for c in ("lo", "hi", "block"))
    ends, sizes = starts[1:], np.diff(starts)
    small = (sizes <= SMALL) & (lo[starts[:-1]] == hi[starts[:-1]])
    rows = np.flatnonzero(np.repeat(small, sizes))
    after = np.repeat(ends, sizes)[rows] - rows - 1  # rows of the group that come after
    total = np.cumsum(after)
    at = 0
    while at < len(rows):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        n = after[at:end]
        i = np.repeat(rows[at:end], n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        yield still_alike(values, i, j, least)
        at = end
    for k in np.flatnonzero(~small).tolist():
        group = np.arange(starts[k], ends[k])
        low, high = group[block[group] == lo[starts[k]]], group[block[group] == hi[starts[k]]]
        same = bool(lo[starts[k]] == hi[starts[k]])
        for at in range(0, len(low), STRIP) if len(high) else ():
            others = high[at:] if same else high
            i, j = surviving(values[low[at : at + STRIP]], values[others], same, least)
            yield low[at + i], others[j]


def _bucket_edges(met: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): spanning edges of the pairs that survive the pruning inside buckets (g, node, n_bucket)."""
    least = least_matches()

    def work(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        root = forest(len(table), alike_rows(table, starts, least))
        lower = np.flatnonzero(root != np.arange(len(root)))
        node = table["node"].combine_chunks()
        return pa.RecordBatch.from_arrays([node.take(pa.array(lower)), node.take(pa.array(root[lower]))], names=["a", "b"])

    rows = met.join(nodes.select("node", "values"), "node")
    return _over_groups(_dealt(rows, F.ceil(F.col("n_bucket") / BLOCK)), work, "a binary, b binary")


def _once(met: DataFrame) -> DataFrame:
    """met (bucket, node) with one of all buckets that hold the same nodes: (g, node, n_bucket)."""
    drawn = [F.bit_xor(F.xxhash64(F.lit(k), F.col("node"))).alias(f"x{k}") for k in (0, 1)]
    sets = met.groupBy("bucket").agg(F.count("*").alias("n_bucket"), *drawn)
    kept = materialise(sets.groupBy("n_bucket", "x0", "x1").agg(F.min("bucket").alias("bucket")).select("bucket", "n_bucket"), "sets")
    return met.join(kept, "bucket").withColumnRenamed("bucket", "g")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component, for all nodes of edges (a, b).

    Every round, each node takes the least label among its neighbours', and then the label of
    that label; rounds end when no label changes. The tables are written between rounds.
    """
    edges = materialise(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = materialise(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("label").alias("m"))
        lower = materialise(labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label")), "lower")
        up = lower.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = materialise(lower.join(up, "label", "left").select("node", "old", F.least("label", "further").alias("label")), "jumped")
        labels = jumped.select("node", "label")
        if not jumped.filter("label <> old").head(1):
            return labels


def _with_shingles(docs: DataFrame, members: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(node, sh) of the nodes to verify: each from the text of its first document.

    members: doc_id, node. The texts are read again and only those asked for are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sh = [shingles(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sh], pa.binary()), pa.array([s.tobytes() for s in sh], pa.binary())], names=["node", "sh"])
        _words.clear()
        tidy()

    wanted = members.select(F.col("doc_id").alias("wanted")).distinct()
    wanted = F.broadcast(wanted) if members.count() <= BROADCAST_NODES else wanted
    rows = docs.select(F.col(doc_id).cast("long").alias("d"), text_of(text).alias("text")).join(wanted, F.col("d").eqNullSafe(F.col("wanted")), "left_semi")
    return rows.select("text").mapInArrow(run, "node binary, sh binary")


def _sets_of(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def exact_links(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) of sets whose Jaccard similarity reaches the threshold."""
    sizes = np.array([len(s) for s in sets])
    ok = np.minimum(sizes[i], sizes[j]) >= threshold * np.maximum(sizes[i], sizes[j]) - 1e-9
    i, j = i[ok], j[ok]
    if not len(i):
        return i, j
    rows, cols = np.unique(i), np.unique(j)
    if len(i) < 4 * (len(rows) + len(cols)) or len(i) < len(rows) * len(cols) // 8:
        both = np.array([len(np.intersect1d(sets[p], sets[q], assume_unique=True)) for p, q in zip(i.tolist(), j.tolist())], float)
    else:
        both = _common_counts([sets[p] for p in rows], [sets[q] for q in cols])[np.searchsorted(rows, i), np.searchsorted(cols, j)]
    hit = both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9
    return i[hit], j[hit]


def _common_counts(sx: list[np.ndarray], sy: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over stretches of the shingles that both sides have."""
    ax, ay = np.unique(np.concatenate(sx)), np.unique(np.concatenate(sy))
    terms = np.intersect1d(ax, ay, assume_unique=True)
    out = np.zeros((len(sx), len(sy)), np.float32)
    for lo in range(0, len(terms), 4096):
        part = terms[lo : lo + 4096]
        out += _matrix(sx, part) @ _matrix(sy, part).T
    return out


def _matrix(sets: list[np.ndarray], terms: np.ndarray) -> np.ndarray:
    m = np.zeros((len(sets), len(terms)), np.float32)
    for i, s in enumerate(sets):
        s = s[np.searchsorted(s, terms[0]) : np.searchsorted(s, terms[-1], "right")]
        at = np.searchsorted(terms, s)
        m[i, at[terms[at] == s]] = 1
    return m


def near_classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, t1, t2, class_id, n_links, class_size, kept, alone: one row per row of docs.

    As `near_duplicates`, with a key of the text (t1, t2), whether the row is the one of its
    class that stays (the least doc_id, null last, then the least key; repeated rows agree), and
    whether its text has no words.
    """
    least = least_matches()
    rows = materialise(nodes_of(docs, text, doc_id), "nodes")
    solid = rows.filter("n_shingles > 0")
    first = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "t1", "t2")
    nodes = materialise(solid.groupBy("node").agg(F.min(first).alias("first"), F.count("*").alias("copies"), F.min("values").alias("values"), F.min("n_shingles").alias("n")), "distinct")
    width = 4 * BAND
    bands = nodes.select("node", F.posexplode(F.array(*[F.xxhash64(F.lit(b), F.substring("values", b * width + 1, width)) for b in range(VALUES // BAND)])).alias("band", "bucket"))
    bands = bands.select("node", F.xxhash64("band", "bucket").alias("bucket"))
    shared = materialise(bands.groupBy("bucket").agg(F.count("*").alias("n_bucket")).filter("n_bucket > 1").select("bucket"), "buckets")
    met = materialise(bands.join(shared, "bucket"), "met")
    groups = components(_bucket_edges(_once(met), nodes))
    members = groups.join(nodes, "node")
    sizes = materialise(members.groupBy("label").agg(F.count("*").alias("n_group"), F.sum("n").alias("n_all")), "sizes")
    members = materialise(groups.join(sizes, "label").join(nodes, "node"), "members")
    sh = _with_shingles(docs, members.select(F.col("first.doc_id").alias("doc_id"), "node"), text, doc_id)
    ready = members.join(sh.groupBy("node").agg(F.min("sh").alias("sh")), "node")

    def work(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        sets, copies = _sets_of(table["sh"]), table["copies"].to_numpy()
        links = np.zeros(len(table), np.int64)

        def verified() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for i, j in alike_rows(table, starts, least):
                i, j = exact_links(sets, i, j)
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                yield i, j

        root = forest(len(table), verified())
        node = table["node"].combine_chunks()
        return pa.RecordBatch.from_arrays([node, node.take(pa.array(root)), pa.array(links)], names=["a", "b", "links"])

    dealt = _dealt(ready.select(F.xxhash64("label").alias("g"), "n_group", "n_all", "node", "values", "copies", "sh"), F.greatest(F.ceil(F.col("n_group") / BLOCK), F.ceil(F.col("n_all") / BLOCK_SHINGLES)))
    found = materialise(_over_groups(dealt.drop("n_group", "n_all"), work, "a binary, b binary, links long"), "links")
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    classes = components(found.select("a", "b"))
    about = nodes.select("node", "first", "copies").join(links, "node", "left").join(classes, "node", "left")
    about = materialise(about.select("node", "copies", F.coalesce("links", F.lit(0)).alias("links"), "first", F.coalesce("label", "node").alias("label")), "about")
    whole = materialise(about.groupBy("label").agg(F.min("first").alias("stays"), F.sum("copies").alias("class_size")), "classes")
    told = materialise(about.join(whole, "label").select("node", "stays", "class_size", (F.col("links") + F.col("copies") - 1).alias("n_links")), "told")
    stays = F.col("stays.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("stays.t1") == F.col("t1")) & (F.col("stays.t2") == F.col("t2"))
    joined = solid.join(told, "node").select("doc_id", "t1", "t2", F.col("stays.doc_id").alias("class_id"), "n_links", "class_size", stays.alias("kept"), F.lit(False).alias("alone"))
    no, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    empty = rows.filter("n_shingles = 0").select("doc_id", "t1", "t2", F.col("doc_id").alias("class_id"), no.alias("n_links"), one.alias("class_size"), F.lit(True).alias("kept"), F.lit(True).alias("alone"))
    return joined.unionByName(empty)


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, class_id, n_links, class_size: one row per row of docs.

    n_links: other rows whose shingles have a Jaccard similarity of at least THRESHOLD,
    copies included; class_id: the least doc_id among the rows that links connect, directly
    or through others. A text without words, null counted as empty, has no links and is a
    class of its own. Null ids are rows; repeated rows are copies. Empty tables give no rows.
    Texts of any length count whole, and other columns of docs, whatever their names, play no part.
    """
    return near_classes(docs, text, doc_id).select("doc_id", "class_id", "n_links", "class_size")
