"""What the tokenizer operators share: classes of code points, and a bounded memory of encoded pieces."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import numpy as np

#: Code points whose class and lower case are single and settled; others are told roughly.
LIMIT = 0x180
SPACE, LETTER, DIGIT, MARK, BLANK, FAR = range(6)
#: Pieces of a generation; a worker remembers two.
REMEMBERED = 100_000


def char_class(c: int) -> int:
    """The class by which the tokenizers' patterns split words.

    BLANK: white space of other kinds and controls; FAR: any other code point that has no
    settled class here.
    """
    if c in (32, *range(9, 14)):
        return SPACE
    kind = unicodedata.category(chr(c))
    if kind[0] == "Z" or kind == "Cc":
        return BLANK
    if c >= LIMIT or kind[0] == "C" or len(chr(c).lower()) != 1 or ord(chr(c).lower()) >= LIMIT:
        return FAR
    return {"L": LETTER, "N": DIGIT}.get(kind[0], MARK)


def char_classes() -> np.ndarray:
    """The classes of the code points up to 0xFFFF, and of all beyond, which hold no white space."""
    return np.array([char_class(c) for c in range(0x10000)] + [FAR], np.uint8)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


_UNSETTLED = frozenset(chr(c) for c in range(LIMIT) if char_class(c) == FAR)


def single_word(piece: str) -> bool:
    """Whether a piece is letters alone, of settled class."""
    return piece.isalpha() and (piece.isascii() or (max(piece) < chr(LIMIT) and _UNSETTLED.isdisjoint(piece)))


class Remembered:
    """Values of pieces in two generations: when the younger is full it becomes the older, whose pieces are dropped unless they occur again."""

    def __init__(self, encode: Callable[[list[str]], dict[str, bytes]], size: int = REMEMBERED):
        self.encode, self.size = encode, size
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def of(self, pieces: list[str]) -> list[bytes]:
        """The value of each piece; those not remembered are encoded, each once."""
        distinct = set(pieces)
        new = distinct.difference(self.young)
        if new:
            fresh = {k: self.old[k] for k in new if k in self.old}
            fresh |= self.encode(sorted(new.difference(fresh)))
            if len(self.young) + len(fresh) > self.size:
                self.old, self.young = self.young, {p: self.young[p] for p in distinct.difference(new)}
            self.young |= fresh
        return list(map(self.young.__getitem__, pieces))


#: A space beside other white space or at the end, where split() would not cut as it should; the places to cut.
_ODD, _CUT = re.compile(r" (?:\s|\Z)|\s "), re.compile(r"(?<=\S)(?= \S)")


def spaced_pieces(text: str) -> list[str]:
    """The text cut before each space between two signs other than white space; all pieces but the first without that space."""
    if _ODD.search(text):
        first, *rest = _CUT.split(text)
        return [first, *[p[1:] for p in rest]]
    return text.split(" ")


def grouped(texts: list[str], size: int):
    """Runs of texts of about so many code points; a text that repeats the one before it is there once, with the place of each."""
    at = 0
    while at < len(texts):
        group, places, held = [texts[at]], [0], len(texts[at])
        at += 1
        while at < len(texts) and held < size:
            if texts[at] != group[-1]:
                group.append(texts[at])
                held += len(texts[at]) + 1
            places.append(len(group) - 1)
            at += 1
        yield group, places
