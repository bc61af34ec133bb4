"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often over the corpus.

Both tokenizers' tokens end at bytes of one string. A label a byte tells which end there
(none, A, B, both); a regular expression scans the labels for spans up to each one that says
both, and the labels counted in a span give the numbers of A and B tokens of a group.

No token of either goes on over a space between two other signs than white space, so a text is
cut there, and each distinct piece is encoded, labelled and scanned once while it is
remembered; a document is a row of pieces. Documents are aligned in chunks of a bounded text. A chunk keeps its distinct pairs of ids
once, with how many of its documents hold each, and its documents refer to them by place. The
corpus counts are sums over chunks; they go back to the chunks' pairs by a join, and a chunk's
documents meet its pairs again as one small group. No row a link, nor a row a document and pair, is shuffled.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import _arrow_schema, materialise, sliced, text_of, tidy
from .bpe import byte_of_char
from .pieces import spaced_pieces
from .token_counts import PieceCounter

#: Code points and rows of a chunk; pairs that are expanded at a time; pairs of a group from which its distinct ids are paired instead.
TEXT, ROWS, PAIRS, LARGE = 1 << 20, 1000, 1 << 21, 4096

#: Pieces, and links of pieces, that are remembered before all are forgotten.
REMEMBERED, LINKS = 500_000, 1 << 23

_SPAN = re.compile(rb"[12]*3")
_CHUNKS = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, place array<int>, links array<long>, pairs array<long>, docs array<long>"
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

_loaded: dict[tuple[str, str], "Aligner"] = {}


def group_sizes(a_ends: np.ndarray, b_ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of A and B tokens of each group, from the bytes where they end; both lists end at `size`."""
    labels = np.zeros(size, np.uint8)
    labels[a_ends - 1] = 1
    labels[b_ends - 1] += 2
    spans = _SPAN.findall((labels + 48).tobytes().translate(None, b"0"))
    kinds = set(spans)
    return tuple(np.fromiter(map({s: s.count(k) + 1 for s in kinds}.__getitem__, spans), np.int64, len(spans)) for k in (b"1", b"2"))


def pieces_of(text: str) -> list[str]:
    """The text after a space, cut at certain places, each piece without the space before it."""
    first, *rest = spaced_pieces(" " + text)
    return [first[1:], *rest] if first else rest


def batched(pieces: list[str], size: int) -> Iterator[list[str]]:
    """Stretches of pieces of about so many code points."""
    held = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
    at = 0
    while at < len(pieces):
        end = max(at + 1, int(np.searchsorted(held, (held[at - 1] if at else 0) + size, "right")))
        yield pieces[at:end]
        at = end


class Aligner:
    """Encodes texts with both tokenizers and groups their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True  # their strings are plain text
        self.b = PieceCounter(b_path)
        back, model = byte_of_char(), self.b.model
        vocabulary = [self.a.id_to_token(i) for i in range(self.a.get_vocab_size())]
        a_bytes = [bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t in vocabulary]
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any(re.search(r"\S ", t.decode("utf-8", "replace")) for t in a_bytes) or any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("tokens of these vocabularies go on over spaces between words")
        self.n_b = len(b_bytes)
        self.bytes = [pa.array(x, pa.binary()) for x in (a_bytes, b_bytes)]
        self.width = [np.array([len(t) for t in x], np.int64) for x in (a_bytes, b_bytes)]
        # ids as text, with what follows them inside a group and at the end of its part
        parts = [[f"{i}{c}" for i in range(n)] for n, last in ((len(a_bytes), "|"), (len(b_bytes), ";")) for c in (",", last)]
        self.words, self.first = pa.array(sum(parts, []), pa.string()), np.cumsum([0] + [len(p) for p in parts])
        self.forget()

    def forget(self) -> None:
        """Pieces by number, and by number whether they are told byte for byte, their numbers of A, B, groups and links, their groups as text, and their links."""
        self.number: dict[str, int] = {}
        self.told = np.zeros((0, 5), np.int64)
        self.spelt: list[bytes] = []
        self.starts, self.pairs, self.counts = np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)

    def learn(self, pieces: list[str]) -> None:
        """Encode and align pieces that are not remembered."""
        a = [x.ids for x in self.a.encode_batch_fast([" " + p for p in pieces], add_special_tokens=False)]
        if max(map(len, pieces)) <= self.b.chunk:
            b = self.b.model.encode(pieces, num_threads=1)
        else:
            b = [self.b.pieces(p).tolist() for p in pieces]
        whole = [(" " + p).encode() for p in pieces]
        sizes = [np.fromiter(map(len, ids), np.int64, len(pieces)) for ids in (a, b)]
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())) for ids, n in zip((a, b), sizes))
        good = self._told(0, a, sizes[0], whole) & self._told(1, b, sizes[1], whole)
        if not good.all():
            a, b = (ids[np.repeat(good, n)] for ids, n in zip((a, b), sizes))
            sizes = [n * good for n in sizes]
        ends = [np.cumsum(self.width[k][ids]) for k, ids in enumerate((a, b))]
        n_a, n_b = group_sizes(*ends, int(ends[0][-1]) if len(a) else 0)
        before = np.searchsorted(np.append(0, np.cumsum(n_a)), np.append(0, np.cumsum(sizes[0])))  # groups before each piece
        links = np.append(0, np.cumsum(n_a * n_b))[before]
        of = np.repeat(np.arange(len(pieces)), np.diff(before))
        keys, counts = self.links(a, b, n_a, n_b, of)
        span = len(self.bytes[0]) * self.n_b
        self.number.update(zip(pieces, range(len(self.spelt), len(self.spelt) + len(pieces))))
        self.told = np.concatenate([self.told, np.stack([good, *sizes, np.diff(before), np.diff(links)], 1)])
        self.spelt += self._spelt(a, b, n_a, n_b, np.append(0, np.cumsum(sizes[0] + sizes[1])))
        at = np.searchsorted(keys, np.arange(1, len(pieces) + 1) * span)
        self.starts = np.concatenate([self.starts, len(self.pairs) + at])
        self.pairs, self.counts = np.concatenate([self.pairs, (keys % span).astype(np.int32)]), np.concatenate([self.counts, counts])

    def _told(self, k: int, ids: np.ndarray, sizes: np.ndarray, whole: list[bytes]) -> np.ndarray:
        """Whether the ids of each text, so many of them, stand for its bytes."""
        at = np.append(0, np.cumsum(sizes))
        ends = np.append(0, np.cumsum(self.width[k][ids]))[at]
        out = np.diff(ends) == np.fromiter(map(len, whole), np.int64, len(whole))
        if self._joined(k, ids[np.repeat(out, sizes)]) != b"".join([w for w, held in zip(whole, out.tolist()) if held]):
            for i in np.flatnonzero(out).tolist():
                out[i] = self._joined(k, ids[at[i] : at[i + 1]]) == whole[i]
        return out

    def _joined(self, k: int, ids: np.ndarray) -> bytes:
        return b"".join(_text_of(self.bytes[k].take(pa.array(ids[lo : lo + PAIRS]))) for lo in range(0, len(ids), PAIRS))

    def _spelt(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """`a1,a2|b1;a3|b2,b3;`: the groups of each piece, whose tokens of both lie between the bounds."""
        last = [np.zeros(len(x), np.int64) for x in (a, b)]
        for k, n in enumerate((n_a, n_b)):
            last[k][np.cumsum(n) - 1] = 1
        others = np.repeat(np.cumsum(n_b) - n_b, n_a), np.repeat(np.cumsum(n_a), n_b)
        codes = np.empty(len(a) + len(b), np.int64)
        for k, ids in enumerate((a, b)):
            codes[np.arange(len(ids)) + others[k]] = self.first[2 * k + last[k]] + ids
        words = self.words.take(pa.array(codes))
        at = np.append(0, np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)))[bounds].tolist()
        text = _text_of(words)
        return [text[x:y] for x, y in zip(at, at[1:])]

    def links(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (piece, A id, B id), as one number, and the links of each; doc is the piece of each group."""
        a0, b0, size = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b, n_a * n_b
        keys, counts, held = [], [], 0

        def folded() -> None:
            nonlocal keys, counts, held
            key, place = np.unique(np.concatenate(keys), return_inverse=True)
            keys, counts, held = [key], [np.bincount(place, np.concatenate(counts), len(key)).astype(np.int64)], 0

        def add(key: np.ndarray, count: np.ndarray) -> None:
            nonlocal held
            keys.append(key)
            counts.append(count)
            held += len(key)
            if held >= 4 * PAIRS:
                folded()

        span = len(self.bytes[0]) * self.n_b
        small = np.flatnonzero(size <= LARGE)
        total = np.cumsum(size[small])
        for lo in range(0, int(total[-1]) if len(total) else 0, PAIRS):
            g = small[np.searchsorted(total, lo, side="right") if lo else 0 : np.searchsorted(total, lo + PAIRS, side="right")]
            own = np.repeat(g, size[g])
            k = np.arange(len(own)) - np.repeat(np.cumsum(size[g]) - size[g], size[g])
            add(doc[own] * span + a[a0[own] + k // n_b[own]] * self.n_b + b[b0[own] + k % n_b[own]], np.ones(len(own), np.int64))
        for g in np.flatnonzero(size > LARGE):
            ua, ca = np.unique(a[a0[g] : a0[g] + n_a[g]], return_counts=True)
            ub, cb = np.unique(b[b0[g] : b0[g] + n_b[g]], return_counts=True)
            step = max(1, PAIRS // len(ub))
            for lo in range(0, len(ua), step):
                add((doc[g] * span + ua[lo : lo + step, None] * self.n_b + ub).ravel(), (ca[lo : lo + step, None] * cb).ravel())
        if not keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        folded()
        return keys[0], counts[0]

    def aligned(self, texts: list[str]) -> dict[str, list]:
        """Result columns of the texts of a chunk, and the chunk's pairs with the numbers of their documents."""
        if len(self.spelt) > REMEMBERED or len(self.pairs) > LINKS:
            self.forget()
        rows = [pieces_of(t) if t else [] for t in texts]
        every = [p for own in rows for p in own]
        if new := sorted(set(every).difference(self.number)):
            for group in batched(new, TEXT):
                self.learn(group)
        code = np.fromiter(map(self.number.__getitem__, every), np.int64, len(every))
        doc = np.repeat(np.arange(len(texts)), [len(own) for own in rows])
        good = np.bincount(doc, 1 - self.told[code, 0], len(texts)) == 0  # told byte for byte, all of it
        code, doc = code[good[doc]], doc[good[doc]]
        bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
        sums = np.diff(np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.told[code, 1:], 0)])[bounds], axis=0)
        spelt = list(map(self.spelt.__getitem__, code.tolist()))
        texts_of = [b"".join(spelt[x:y]) for x, y in zip(bounds.tolist(), bounds[1:].tolist())]
        # a document's links: those of its distinct pieces, as often as it has them
        known = len(self.spelt)
        held, often = np.unique(doc * known + code, return_counts=True)
        of, piece = held // known if known else held, held % known if known else held
        size = self.starts[piece + 1] - self.starts[piece]
        at = np.repeat(self.starts[piece] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        span = len(self.bytes[0]) * self.n_b
        keys, place = np.unique(np.repeat(of, size) * span + self.pairs[at], return_inverse=True)
        counts = np.zeros(len(keys), np.int64)
        np.add.at(counts, place, np.repeat(often, size) * self.counts[at])
        pairs, place, docs = np.unique(keys % span, return_inverse=True, return_counts=True)
        return {
            **dict(zip(("n_a", "n_b", "n_groups", "n_links"), sums.T)),
            "groups_sha256": [hashlib.sha256(t[:-1]).hexdigest() if t else "" for t in texts_of],
            "offsets": np.searchsorted(keys, np.arange(len(texts) + 1) * span), "place": place, "links": counts, "pairs": pairs, "docs": docs,
        }


def _text_of(words: pa.StringArray | pa.BinaryArray) -> bytes:
    """All values of the array, one after the other."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    return words.buffers()[2][int(offsets[0]) : int(offsets[-1])].to_pybytes()


def aligner_for(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = Aligner(a_path, b_path)
    return _loaded[a_path, b_path]


def chunked(batches: Iterator[pa.RecordBatch], text: int, rows: int) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of chunks of about so many code points, and so many rows at most."""
    ids, texts, held = [], [], 0
    for batch in sliced(batches, 100):
        for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if texts and (held + len(t) > text or len(texts) >= rows):
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(key)
            texts.append(t)
            held += len(t)
    if texts:
        yield ids, texts


def chunks(docs: DataFrame, a_path: str, b_path: str, text: str = "text", doc_id: str = "doc_id", size: int = TEXT, rows: int = ROWS) -> DataFrame:
    """A row a document: its numbers, and its links by their place among the pairs of its chunk; and a row a chunk, with its pairs and how many of its documents hold each."""
    schema = _arrow_schema(_CHUNKS, docs.sparkSession)

    def lists(offsets, values, kind):
        return pa.ListArray.from_arrays(np.asarray(offsets, np.int32), pa.array(values.astype(kind)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_for(a_path, b_path)
        for k, (ids, texts) in enumerate(chunked(batches, size, rows)):
            got, n = aligner.aligned(texts), len(texts)
            chunk = (TaskContext.get().partitionId() << 32) + k
            none = [None] * n
            columns = {"chunk": [chunk] * n, "doc_id": ids, **{c: got[c] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")}, "place": lists(got["offsets"], got["place"], np.int32), "links": lists(got["offsets"], got["links"], np.int64), "pairs": none, "docs": none}
            yield _batch(columns, schema)
            one = [0, len(got["pairs"])]
            yield _batch({f.name: [None] for f in schema} | {"chunk": [chunk], "pairs": lists(one, got["pairs"], np.int64), "docs": lists(one, got["docs"], np.int64)}, schema)
        tidy()

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, _CHUNKS)


def _batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in schema], schema=schema)


def pair_counts(parts: DataFrame, n_b: int) -> DataFrame:
    """pair, count, best: how many documents hold each pair linked, and whether no other B id has a higher count with its A id."""
    held = parts.select(F.explode(F.arrays_zip("pairs", "docs")).alias("p")).select("p.pairs", "p.docs")
    counts = materialise(held.groupBy(F.col("pairs").alias("pair")).agg(F.sum("docs").alias("count")).withColumn("a", F.expr(f"pair div {n_b}")), "pair-counts")
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))  # at most a row for each id of A's vocabulary
    return counts.join(F.broadcast(highest), "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def _totals(key, rows: pa.Table, scored: pa.Table) -> pa.Table:
    """The rows of one chunk with the counts of their links."""
    scored = scored.sort_by("at")
    count, best = scored["count"].to_numpy(), scored["best"].to_numpy().astype(np.int64)
    place, links = (rows[c].combine_chunks() for c in ("place", "links"))
    ends = np.append(0, np.cumsum(place.value_lengths().to_numpy()))
    at, n = place.flatten().to_numpy(), links.flatten().to_numpy()
    total = lambda x: pa.array(np.diff(np.append(0, np.cumsum(x[at] * n))[ends]))
    return rows.drop_columns(["chunk", "place", "links"]).add_column(5, "n_best", total(best)).add_column(6, "count_sum", total(count))


def alignment(docs: DataFrame, a_path: str, b_path: str, text: str = "text", doc_id: str = "doc_id", size: int = TEXT, rows: int = ROWS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per row.

    Texts that are null, empty, or not told by their tokens byte for byte have no tokens: zeros
    and an empty digest. Null and repeated ids and repeated rows are documents of their own, an
    empty table gives no rows, texts of any length are aligned whole (a group of very many
    tokens by its distinct ids), and other columns, whatever their names, play no part.
    """
    import sentencepiece

    n_b = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    parts = materialise(chunks(docs, a_path, b_path, text, doc_id, size, rows), "aligned")
    dictionary = parts.where("pairs IS NOT NULL").select("chunk", "pairs", "docs")
    held = dictionary.select(F.col("chunk").alias("of_chunk"), F.posexplode("pairs").alias("at", "pair"))
    scored = held.join(pair_counts(dictionary, n_b), "pair").select("of_chunk", "at", "count", "best")
    rows_of = parts.where("pairs IS NULL").select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "place", "links")
    return rows_of.groupBy("chunk").cogroup(scored.groupBy("of_chunk")).applyInArrow(_totals, _RESULT)
