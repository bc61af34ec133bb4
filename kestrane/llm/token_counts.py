"""Token counts of whole texts, huge ones by overlapping chunks that are spliced exactly.

A greedy pair-merging encoding is valid exactly if every two adjacent tokens are what
the encoder makes of their joint text. So two encodings of overlapping chunks may be
joined at a place where both have a token boundary with the same token on either side:
all adjacent pairs of the result occur in one of the two valid encodings, and the result
is the encoding of the whole. If an overlap has no such place it is doubled; a text
where even a whole chunk's overlap has none is encoded in one piece.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ._common import map_rows, text_of

#: Code points of a chunk and of the first overlap; longer texts than a chunk are cut.
CHUNK, OVERLAP = 16_384, 256
LIMIT = 4096

_loaded: dict[str, "PieceCounter"] = {}


class PieceCounter:
    """Counts the ids that sentencepiece gives for a text."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        n = self.model.get_piece_size()
        width = np.zeros(n, np.int64)
        self.inside = np.zeros(n, bool)  # a byte inside a character
        for i in range(n):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                b = int(piece[1:-1], 16)
                self.inside[i] = 0x80 <= b < 0xC0
                width[i] = not self.inside[i]
            else:
                width[i] = len(piece)
        self.width = width

    def _encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and the code point at which each starts; the leading mark that the model adds is before 0."""
        ids = np.array(self.model.encode(text), np.int64)
        return ids, np.cumsum(self.width[ids]) - self.width[ids] - 1

    def _boundaries(self, ids: np.ndarray, starts: np.ndarray, low: int, high: int) -> dict[tuple, int]:
        """(place, token before, token after) to the number of the token after, for places in [low, high)."""
        first, last = np.searchsorted(starts, [low, high])
        return {(int(starts[i]), int(ids[i - 1]), int(ids[i])): i for i in range(max(1, first), last) if not self.inside[ids[i]] and not self.inside[ids[i - 1]] and starts[i - 1] >= low and not self.model.is_byte(int(ids[i]))}

    def pieces(self, text: str) -> np.ndarray:
        """Ids of the whole text, by chunks if it is longer than one."""
        return np.concatenate([np.zeros(0, np.int64), *self._parts(text)])

    def count(self, text: str) -> int:
        return len(self.model.encode(text)) if len(text) <= self.chunk else sum(map(len, self._parts(text)))

    def _parts(self, text: str) -> list[np.ndarray]:
        """Stretches of ids whose concatenation is the encoding of the text."""
        at = taken = 0  # where the chunk at hand begins; how many of its tokens are given out
        ids, starts = self._encode(text[: self.chunk])
        out = []
        while at + self.chunk < len(text):
            end, over = at + self.chunk, self.overlap
            while True:
                begin = end - over
                if begin <= at:  # no overlap is wide enough: the text has no stable place here
                    return [self._encode(text)[0]]
                more, mstarts = self._encode(text[begin : begin + self.chunk])
                here = self._boundaries(ids, starts + at, begin, end)
                there = self._boundaries(more, mstarts + begin, begin, end)
                common = sorted(k for k in here.keys() & there.keys() if here[k] > taken)
                if common:
                    break
                over *= 2
            cut = common[len(common) // 2]
            out.append(ids[taken : here[cut]])
            ids, starts, at, taken = more, mstarts, begin, there[cut]
        return [*out, ids[taken:]]


def counter_for(path: str) -> PieceCounter:
    if path not in _loaded:
        _loaded[path] = PieceCounter(path)
    return _loaded[path]


def token_counts(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per row; null text counts as empty (0 tokens).

    Null and repeated ids and repeated rows pass through, an empty table gives no rows, texts of
    any length are counted whole, and other columns of docs, whatever their names, play no part.
    """

    def make():
        counter = counter_for(path)

        def work(doc_id, text):
            short = [i for i, t in enumerate(text) if len(t) <= counter.chunk]
            n = [0] * len(text)
            for lo in range(0, len(short), 256):
                part = short[lo : lo + 256]
                for i, ids in zip(part, counter.model.encode([text[i] for i in part], num_threads=1)):
                    n[i] = len(ids)
            for i in set(range(len(text))).difference(short):
                n[i] = counter.count(text[i])
            return {"doc_id": doc_id, "n_bytes": [len(t.encode()) for t in text], "n_tokens": n, "over_limit": [x > limit for x in n]}

        return work

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), text_of(text).alias("text"))
    return map_rows(rows, make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
