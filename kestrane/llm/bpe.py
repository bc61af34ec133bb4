"""BPE encoding and decoding with forced-boundary splitting.

Two bytes that are adjacent inside no vocabulary token can never be merged, so between them
lies a certain cut. `ForcedCuts` reads the adjacent byte pairs off the vocabulary and cuts
every text wherever a pair of it is absent from that table. A cut at a border of the
tokenizer's words ends a word there; at a cut inside a word the left fragment has no
end-of-word mark: it is encoded with the sign after the cut, whose own ids are taken off again.
Fragments are encoded independently by the tokenizers library,
each distinct one once while it is remembered, and their ids are concatenated.

The table of pairs covers code points below LIMIT, whose lower case and class are single and
settled. A stretch between white space that holds another code point or may hold a special
token stays whole; one that holds an apostrophe, which may begin a contraction, is cut at
borders of words only.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ._common import map_rows, text_of, tidy
from .pieces import DIGIT, FAR, LIMIT, SPACE, Remembered, char_classes, code_points, grouped, single_word

#: Code points of the texts that are split at a time; bytes of ids that are decoded at a time; fragments of a generation.
GROUP, PART, REMEMBERED = 1 << 17, 1 << 20, 60_000

_loaded: dict[str, "ForcedCuts"] = {}


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def token_pairs(vocab, suffix: str) -> set[tuple[int, int]]:
    """All pairs of bytes that are adjacent inside some token."""
    back = byte_of_char()
    pairs = set()
    for token in vocab:
        body = token.removesuffix(suffix) if suffix else token
        known = [back.get(c, -1) for c in body]
        pairs.update(zip(known, known[1:]))
    return pairs


class ForcedCuts:
    """Encoder of whole texts by fragments between certain cuts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.suffix = self.tokenizer.model.end_of_word_suffix or ""
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        tokens = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())]
        pairs = token_pairs((t for t in tokens if t not in special), self.suffix)
        spaced = any(b in p for p in pairs for b in b" \t\n\v\f\r")
        if not self.suffix or spaced or self.tokenizer.decoder is not None or any(not s.startswith("<|") or " " in s for s in special):
            raise ValueError("this vocabulary has no ends of words, joins tokens across spaces, or decodes across tokens")
        self.tokens = pa.array(tokens, pa.string()).cast(pa.binary())
        self.ends = np.array([t.endswith(self.suffix) for t in tokens])
        self._table(pairs)
        self.known = Remembered(self._encode, REMEMBERED)

    def _table(self, pairs: set[tuple[int, int]]) -> None:
        """cut[c, d]: 1 for a cut between c and d at a border of words, 2 inside a word, 3 for a border without a cut."""
        self.kind = char_classes()
        kind = np.append(self.kind[:LIMIT], FAR)
        lower = [ord(chr(c).lower()) if kind[c] <= DIGIT + 1 else c for c in range(LIMIT)]
        self.lower = np.array([*lower, 0], np.uint32)
        first, last = (np.array([chr(c).encode()[i] for c in lower] + [0]) for i in (0, -1))
        joined = np.zeros((256, 256), bool)
        for a, b in pairs:
            joined[a, b] = True
        k, m = kind[:, None], kind[None, :]
        known = (k <= DIGIT + 1) & (m <= DIGIT + 1)
        border, absent = (k != m) | (k == DIGIT), ~joined[last[:, None], first[None, :]]
        cut = np.where(known & absent, np.where(border, 1, 2), np.where(border, 3, 0)).astype(np.uint8)
        cut[(k == SPACE) | (m == SPACE)] = 1
        self.cut = cut.ravel()

    def fragments(self, text: str) -> tuple[list[str], np.ndarray]:
        """The fragments of a text and the places where they start; one whose word goes on has the sign after the cut and a space at its end."""
        raw = code_points(text)
        if not len(raw):
            return [], np.zeros(0, np.int64)
        code = np.minimum(raw, LIMIT).astype(np.int32)
        kind = self.kind[np.minimum(raw, 0x10000)]
        cut = self.cut[code[:-1] * (LIMIT + 1) + code[1:]]
        low = self.lower[code]
        foreign = kind > DIGIT + 1
        foreign[:-1] |= (raw[:-1] == 60) & (raw[1:] == 124)  # "<|" may begin a special token
        mixed = raw == 39
        mixed[1:] |= cut == 3
        cut[cut == 3] = 0
        if foreign.any() or mixed.any():
            space = kind == SPACE
            stretch = np.cumsum(space, dtype=np.int32)
            mark = np.zeros(stretch[-1] + 1, bool)
            mark[stretch[mixed]] = True
            cut[mark[stretch[1:]] & (cut == 2)] = 0
            mark[:] = False
            mark[stretch[foreign]] = True
            kept = mark[stretch] & ~space
            cut[kept[1:] & kept[:-1]] = 0
            low[kept] = raw[kept]
        ends = np.append(np.flatnonzero(cut), len(raw) - 1) + 1
        starts = np.concatenate([[0], ends[:-1]])
        solid = kind[starts] != SPACE
        starts, ends = starts[solid], ends[solid]
        lowered = low.tobytes().decode("utf-32-le")
        out = [lowered[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        inside = np.append(cut == 2, False)
        for i in np.flatnonzero(inside[ends - 1]).tolist():
            out[i] += lowered[ends[i]] + " "
        return out, starts

    def _encode(self, fragments: list[str]) -> dict[str, bytes]:
        """Ids of fragments, as little-endian unsigned 32-bit integers."""
        out = {}
        words = [f for f in fragments if single_word(f)]
        if words:  # one word each: told apart by the ends of words
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
            after = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            flat = ids.tobytes()
            out = {w: flat[a:b] for w, a, b in zip(words, [0, *after[:-1].tolist()], after.tolist(), strict=True)}
        rest = [f for f in fragments if f not in out]
        self._single([f for f in rest if f[-1] != " "], out)
        self._single(sorted({f[-2] for f in rest if f[-1] == " "} - out.keys()), out)
        whole: dict[str, bytes] = {}
        self._single([f[:-1] for f in rest if f[-1] == " "], whole)
        for f in rest:
            if f[-1] == " ":  # the sign after the cut ends the word; its own ids go
                out[f] = whole[f[:-1]].removesuffix(out[f[-2]])
        return out

    def _single(self, fragments: list[str], out: dict[str, bytes]) -> None:
        for f, got in zip(fragments, self.tokenizer.encode_batch_fast(fragments, add_special_tokens=False)):
            out[f] = np.array(got.ids, "<u4").tobytes()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as little-endian unsigned 32-bit integers."""
        out = []
        for group, places in grouped(texts, GROUP):
            fragments, starts = self.fragments("\n".join(group))
            ids = self.known.of(fragments)
            bounds = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in group])).tolist()
            got = [b"".join(ids[a:b]) for a, b in zip(bounds, bounds[1:])]
            out += [got[i] for i in places]
        return out

    def decode(self, ids: bytes) -> bytes:
        """The decoded text in UTF-8: tokens with their marks, joined by spaces."""
        return b" ".join(self._decoded([ids[i : i + PART] for i in range(0, len(ids), PART)]))

    def decode_batch(self, ids: list[bytes]) -> list[bytes]:
        """The decoded texts, in groups whose tokens fit in an Arrow array."""
        out, at = [], 0
        while at < len(ids):
            end, size = at, 0
            while end < len(ids) and size + len(ids[end]) <= PART:
                size += len(ids[end])
                end += 1
            out += self._decoded(ids[at:end]) if end > at else [self.decode(ids[at])]
            at = max(end, at + 1)
        return out

    def _decoded(self, ids: list[bytes]) -> list[bytes]:
        flat = pa.array(np.frombuffer(b"".join(ids), "<u4"))
        offsets = np.cumsum([0] + [len(i) // 4 for i in ids]).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(offsets, self.tokens.take(flat)), b" ").to_pylist()


def forget() -> None:
    """Let go of the tokenizer and of the pieces it remembers."""
    _loaded.clear()


def cuts_for(path: str) -> ForcedCuts:
    if path not in _loaded:
        _loaded[path] = ForcedCuts(path)
        tidy()  # what the vocabulary took to read
    return _loaded[path]


def _coded(docs: DataFrame, path: str, text: str, doc_id: str, results, schema: str) -> DataFrame:
    def make():
        enc = cuts_for(path)

        def work(doc_id, text):
            ids = enc.encode_batch(text)
            return {"doc_id": doc_id, **results(ids, enc.decode_batch(ids))}

        return work

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), text_of(text).alias("text"))
    return map_rows(rows, make, schema, forget)


def encode_and_decode(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit), decoded (string): one row per row.

    Null text counts as empty: no ids and an empty decoded text. Repeated rows are rows, ids
    may repeat or be null, an empty table gives no rows, and other columns of docs, whatever
    their names, play no part. Texts of any length are encoded whole.
    """
    return _coded(docs, path, text, doc_id, lambda ids, decoded: {"ids": ids, "decoded": decoded}, "doc_id long, ids binary, decoded string")


def _digests(ids: list[bytes], decoded: list[bytes]) -> dict[str, list]:
    return {"n_tokens": [len(i) // 4 for i in ids],
            "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
            "decoded_sha256": [hashlib.sha256(d).hexdigest() for d in decoded]}


def bpe_digest(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of `encode_and_decode`, hashed where it is made.

    With `ids`, also the ids as they are. Rows as there.
    """
    results = lambda i, d: _digests(i, d) | ({"ids": i} if ids else {})
    return _coded(docs, path, text, doc_id, results, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if ids else ""))
