"""Nearest vectors by multi-index hashing.

Vectors become binary codes: signs after a rotation that is learned from a bounded sample.
Largest inner product is turned into smallest angle first, by one more component that gives
all rows the same length. A code is split into substrings, and each substring is an index
of all rows: rows of equal substring stand together. Codes within a Hamming radius agree with
the query's in at least one substring up to the radius's share of it (pigeonhole), so a query
probes each index at all values that near; what it meets within the radius is reranked on
the original vectors. The radius is the one that holds the true neighbours of sampled queries,
found by brute force over all rows.

An index is dealt out by the first bits of its substring, so that a query goes only to the
buckets that its probes can reach. A bucket with many rows is cut into parts by a hash. Within a bucket the rows
come first and become the index; the queries then stream past it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import _arrow_schema, materialise

TOP = 20
#: The code's substrings and their bits.
PARTS, WIDTH = 4, 16
#: Rows from which the rotation is learned; queries that set the radius, and the share of their neighbours that it must hold; rounds of learning.
SAMPLE, TRIALS, SHARE, ROUNDS = 8192, 256, 0.985, 30
#: Components of the sample; rows of a bucket's part; queries that are probed together; pairs that are reranked together.
COMPONENTS, BUCKET, STEP, PAIRS = 1 << 22, 4096, 64, 1 << 15

_FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, vector, norm of the rows that take part: no null, zero or non-finite vector."""
    element = "float" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), vectors[embedding].cast(f"array<{element}>").alias("vector"))
    whole = "vec_id IS NOT NULL AND vector IS NOT NULL AND NOT exists(vector, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"
    norm = F.expr("sqrt(aggregate(vector, 0D, (s, x) -> s + double(x) * double(x)))")
    return rows.where(whole).withColumn("norm", norm).where("norm > 0")


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """The vectors of an Arrow column as rows of a matrix, shorter ones ended by zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes, flat = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) == len(sizes) * width and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def inner(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, each summed alike: equal vectors score equally wherever they stand."""
    return (vectors * query).sum(1)


class Rotation:
    """A learned rotation to binary codes."""

    def __init__(self, sample: np.ndarray, bits: int, rounds: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean = sample.mean(0)
        width = sample.shape[1]
        held = max(width, bits)
        data = np.zeros((len(sample), held))
        data[:, :width] = sample - self.mean
        # principal axes first, then alternate: signs that fit the rotated sample, rotation that fits the signs
        axes = np.linalg.svd(data.T @ data)[0][:, :bits] if held == width else np.eye(held)[:, :bits]
        turn = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
        low = data @ axes
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(low @ turn >= 0, 1.0, -1.0).T @ low)
            turn = (u @ v).T
        self.turn = (axes @ turn)[:width]

    def codes(self, rows: np.ndarray) -> np.ndarray:
        """Codes of the lifted vectors, one unsigned 64-bit number each."""
        bits = (rows - self.mean) @ self.turn >= 0
        return (bits.astype(np.uint64) << np.arange(bits.shape[1], dtype=np.uint64)).sum(1, dtype=np.uint64)


def substring(codes: np.ndarray, part: int) -> np.ndarray:
    return (codes >> np.uint64(part * WIDTH)) & np.uint64((1 << WIDTH) - 1)


def share_of(radius: int, part: int) -> int:
    """The greatest distance of substring `part` that must be probed; -1 for none.

    If radius = a * PARTS + b, a code within it is within a of one of the first b + 1
    substrings, or within a - 1 of one of the others.
    """
    a, b = divmod(radius, PARTS)
    return a if part <= b else a - 1


def lifted(vectors: np.ndarray, lift: np.ndarray) -> np.ndarray:
    return np.concatenate([vectors, lift[:, None]], 1)


class Index:
    """Rows of one bucket's part, by the values of one substring."""

    def __init__(self, part: int, ids: np.ndarray, codes: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((ids, substring(codes, part)))
        self.part, self.ids, self.codes, self.vectors = part, ids[order], codes[order], vectors[order]
        self.values, self.first = np.unique(substring(self.codes, part), return_index=True)
        self.sizes = np.diff(np.append(self.first, len(order)))

    def probe(self, codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) pairs within the radius that no earlier substring finds."""
        near = np.bitwise_count(substring(codes, self.part)[:, None] ^ self.values) <= share_of(radius, self.part)
        query, value = np.nonzero(near)
        sizes = self.sizes[value]
        query = np.repeat(query, sizes)
        row = np.arange(len(query)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.first[value], sizes)
        apart = codes[query] ^ self.codes[row]
        held = np.bitwise_count(apart) <= radius
        query, row, apart = query[held], row[held], apart[held]
        first = np.ones(len(query), bool)
        for earlier in range(self.part):
            first &= np.bitwise_count(substring(apart, earlier)) > share_of(radius, earlier)
        return query[first], row[first]

    def nearest(self, ids: np.ndarray, codes: np.ndarray, vectors: np.ndarray, floors: np.ndarray, radius: int, top: int) -> tuple[np.ndarray, ...]:
        """query_id, vec_id, score of each query's best rows here, none below its floor."""
        out = []
        for lo in range(0, len(ids), STEP):
            query, row = self.probe(codes[lo : lo + STEP], radius)
            query += lo
            keep = ids[query] != self.ids[row]
            query, row = query[keep], row[keep]
            score = np.concatenate([np.zeros(0), *(inner(self.vectors[row[k : k + PAIRS]], vectors[query[k : k + PAIRS]]) for k in range(0, len(row), PAIRS))])
            keep = score >= floors[query]
            query, row, score = query[keep], row[keep], score[keep]
            order = np.lexsort((self.ids[row], -score, query))
            query, row, score = query[order], row[order], score[order]
            begin = np.flatnonzero(np.diff(query, prepend=-1))
            rank = np.arange(len(query)) - np.repeat(begin, np.diff(np.append(begin, len(query))))
            keep = rank < top
            out.append((ids[query[keep]], self.ids[row[keep]], score[keep]))
        return tuple(np.concatenate([x[k] for x in out]) for k in range(3)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def brute_force(rows: DataFrame, queries: list[tuple[int, np.ndarray]], width: int, top: int) -> DataFrame:
    """query_id, vec_id, score: the nearest rows of a bounded list of queries, by looking at every row."""
    schema = _arrow_schema(_FOUND, rows.sparkSession)
    numbers = np.array([i for i, _ in queries], np.int64)
    vectors = np.array([v for _, v in queries]).reshape(len(queries), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0)) for _ in queries]
        for batch in batches:
            for lo in range(0, batch.num_rows, BUCKET):
                part = batch.slice(lo, BUCKET)
                ids, data = part.column(0).to_numpy(), matrix(part.column(1), width)
                scores = vectors @ data.T
                for k, row in enumerate(scores):
                    row[ids == numbers[k]] = -np.inf
                    keep = np.argsort(-row, kind="stable")[:top]
                    keep = keep[np.isfinite(row[keep])]
                    i, s = np.concatenate([best[k][0], ids[keep]]), np.concatenate([best[k][1], inner(data[keep], vectors[k])])
                    order = np.lexsort((i, -s))[:top]
                    best[k] = i[order], s[order]
        for number, (i, s) in zip(numbers, best):
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), number)), pa.array(i), pa.array(s)], schema=schema)

    return ranked(rows.select("vec_id", "vector").mapInArrow(run, _FOUND), top)


def ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def sampled(rows: DataFrame, n: int) -> DataFrame:
    """n rows, the same ones at every run: the least hashes of id and vector."""
    return rows.orderBy(F.xxhash64("vec_id", "vector"), "vec_id").limit(n)


def codes_of(vectors: np.ndarray, norms: np.ndarray, rotation: Rotation, reach: float, query: bool) -> np.ndarray:
    """Codes of rows, lifted to the length `reach`, or of queries, stretched to it."""
    if query:
        return rotation.codes(lifted(vectors * (reach / norms)[:, None], np.zeros(len(vectors))))
    return rotation.codes(lifted(vectors, np.sqrt(np.maximum(reach**2 - norms**2, 0))))


def coded(rows: DataFrame, rotation: Rotation, reach: float, width: int, sample: tuple[np.ndarray, np.ndarray] | None = None, top: int = TOP) -> DataFrame:
    """The rows with their codes; with a sample of all rows, as queries, with the score that is the `top`th best in it as their floor."""
    spark = rows.sparkSession
    ddl = f"vec_id long, vector {rows.schema['vector'].dataType.simpleString()}, code long, floor double"
    schema = _arrow_schema(ddl, spark)

    def floor(ids, data, norms) -> np.ndarray:
        if len(sample[0]) <= top:
            return np.full(len(ids), -np.inf)
        scores = data @ sample[1].T
        scores[ids[:, None] == sample[0]] = -np.inf
        return np.partition(scores, -top, 1)[:, -top] - 1e-9 * norms * reach  # what rounding may take from equal scores

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids, data, norms = part.column(0).to_numpy(), matrix(part.column(1), width), part.column(2).to_numpy()
                codes = codes_of(data, norms, rotation, reach, sample is not None).view(np.int64)
                floors = pa.array(floor(ids, data, norms)) if sample else pa.nulls(len(ids), pa.float64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(schema.field("vector").type), pa.array(codes), floors], schema=schema)

    return rows.select("vec_id", "vector", "norm").mapInArrow(run, ddl)


def radius_for(index: DataFrame, queries: DataFrame, rotation: Rotation, reach: float, width: int, top: int, trials: int, share: float) -> int:
    """The Hamming radius that holds `share` of the true neighbours of sampled queries."""
    trial = [(r.vec_id, np.array(list(r.vector) + [0.0] * (width - len(r.vector)), np.float64), r.norm) for r in sampled(queries, trials).collect()]
    if not trial:
        return 0
    codes = codes_of(np.array([v for _, v, _ in trial]), np.array([n for *_, n in trial]), rotation, reach, True)
    own = dict(zip((i for i, *_ in trial), codes.view(np.int64).tolist()))
    found = brute_force(index, [(i, v) for i, v, _ in trial], width, top).select("query_id", "vec_id")  # `top` rows a trial query
    pairs = index.select("vec_id", "code").join(F.broadcast(found), "vec_id").select("query_id", "code").collect()
    apart = sorted(((own[r.query_id] ^ r.code) & (1 << 64) - 1).bit_count() for r in pairs)
    return apart[min(len(apart) - 1, int(share * len(apart)))] if apart else 0


def bucket(code: str, part: int, bits: int) -> str:
    """SQL for the first `bits` bits of substring `part`."""
    return f"cast(shiftrightunsigned({code}, {part * WIDTH + WIDTH - bits}) & {(1 << bits) - 1} as int)"


def probed(index: DataFrame, queries: DataFrame, n: int, radius: int, width: int, top: int, rows: int) -> DataFrame:
    """query_id, vec_id, score: the best rows of each bucket's part for each query that probes it."""
    bits = min(WIDTH, max(0, (max(n - 1, 0) // rows).bit_length()))
    tables = [(part, share_of(radius, part)) for part in range(PARTS) if share_of(radius, part) >= 0]
    placed = index.select("*", F.explode(F.expr("array(" + ", ".join(f"struct({part} AS part, {bucket('code', part, bits)} AS bucket)" for part, _ in tables) + ")")).alias("at")).select("vec_id", "vector", "code", "floor", "at.part", "at.bucket")
    # at most PARTS * 2^WIDTH rows
    sizes = materialise(placed.groupBy("part", "bucket").agg(F.expr(f"cast(if(count(*) > {2 * rows}, ceil(count(*) / {rows}), 1) as int)").alias("cuts")), "buckets")
    placed = placed.join(F.broadcast(sizes), ["part", "bucket"]).withColumn("cut", F.expr("pmod(xxhash64(vec_id, vector), cuts)")).withColumn("query", F.lit(False))
    # a query goes to all buckets whose bits differ from its own in no more places than the substring may
    reach = "concat(" + ", ".join(f"transform(filter(sequence(0, {(1 << bits) - 1}), x -> bit_count(x) <= {share}), x -> struct({part} AS part, x ^ {bucket('code', part, bits)} AS bucket))" for part, share in tables) + ")"
    sent = queries.select("*", F.explode(F.expr(reach)).alias("at")).select("vec_id", "vector", "code", "floor", "at.part", "at.bucket")
    sent = sent.join(F.broadcast(sizes), ["part", "bucket"]).withColumn("cut", F.explode(F.expr("sequence(0L, cuts - 1L)"))).withColumn("query", F.lit(True))
    columns = ["part", "bucket", "cut", "query", "vec_id", "vector", "code", "floor"]
    both = placed.select(columns).unionAll(sent.select(columns))
    schema = _arrow_schema(_FOUND, index.sparkSession)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, built = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(keys)]):
                *key, query = keys[lo].tolist()
                if key != at:
                    at, held, built = key, [], None
                ids, codes = (batch.column(k).slice(lo, hi - lo).to_numpy() for k in (4, 6))
                vectors = matrix(batch.column(5).slice(lo, hi - lo), width)
                if not query:
                    held.append((ids.copy(), codes.view(np.uint64).copy(), vectors))
                    continue
                if held and built is None:
                    built, held = Index(key[0], *(np.concatenate([h[k] for h in held]) for k in range(3))), []
                if built is not None:
                    floors = batch.column(7).slice(lo, hi - lo).to_numpy()
                    got = built.nearest(ids, codes.view(np.uint64), vectors, floors, radius, top)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], schema=schema)

    return both.repartition("part", "bucket", "cut").sortWithinPartitions("part", "bucket", "cut", "query").mapInArrow(found, _FOUND)


def nearest_vectors(vectors: DataFrame, top: int = TOP, every: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", bucket_rows: int = BUCKET, share: float = SHARE, radius: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, the `top` other rows with the largest inner product.

    Equal scores go by ascending id. Rows whose id or vector is null, and vectors that are zero,
    empty, or hold null or non-finite components take no part; shorter vectors count as ended by
    zeros. Rows that repeat a query's id are not among its results; of several query rows with
    one id the least vector is the query. With fewer rows than `top`, all of them come out; an
    empty table gives no rows. Other columns, whatever their names, play no part. The radius is
    found by `radius_for` unless it is given; one of all bits makes the search exact. Queries for
    which fewer than `top` rows lie within it are searched again with twice the radius.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, embedding)
    n, reach, width = rows.agg(F.count("*"), F.max("norm"), F.max(F.size("vector"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    held = sampled(rows, max(top + 1, min(SAMPLE, COMPONENTS // width))).collect()
    ids = np.array([r.vec_id for r in held], np.int64)
    data = np.array([list(r.vector) + [0.0] * (width - len(r.vector)) for r in held], np.float64)
    rotation = Rotation(lifted(data, np.sqrt(np.maximum(reach**2 - np.array([r.norm for r in held]) ** 2, 0))), PARTS * WIDTH, ROUNDS)
    asking = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("vector", "norm")).alias("v")).select("vec_id", "v.vector", "v.norm")
    index = materialise(coded(rows, rotation, reach, width), "coded")
    if radius is None:
        radius = PARTS * WIDTH if n <= top + 1 else radius_for(index, asking, rotation, reach, width, top, TRIALS, share)
    queries = materialise(coded(asking, rotation, reach, width, (ids, data), top), "queries")
    out = None
    while True:
        found = materialise(ranked(probed(index, queries, n, radius, width, top, bucket_rows), top), "found")
        if radius >= PARTS * WIDTH:
            break
        whole = found.where(F.col("rank") == top).select("query_id")
        queries = queries.join(whole, queries.vec_id == whole.query_id, "left_anti")
        kept = found.join(whole, "query_id", "left_semi")
        out = kept if out is None else out.unionByName(kept)
        if queries.isEmpty():
            return out.select("query_id", "rank", "vec_id", "score")
        radius = min(PARTS * WIDTH, 2 * radius + 1)
    return (found if out is None else out.unionByName(found)).select("query_id", "rank", "vec_id", "score")
