r"""Secrets in texts and in what is encoded inside them.

A worklist of layers: the text itself is scanned, then URL escapes, Unicode escapes and
character references, base64 runs and compressed data found in a layer are unwrapped into
new layers (bytes as UTF-8 or Latin-1, and as UTF-16 and UTF-32 where they hold such text), which are scanned and unwrapped in turn until nothing new appears. A layer
seen before (same content at the same place) is not taken up again. Every layer knows how
its characters map to its parent's, so each finding is told as a span of the original text;
inside compressed data a finding has the span of all that holds it. What comes out of compressed data is
taken up window by window as it is unpacked, at any size, until all kinds are found in it.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import bz2
import hashlib
import html
import lzma
import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark.sql import DataFrame

from ._common import map_rows, text_of

KINDS = ("assign", "access", "hex")
#: Unpacked bytes that are taken up at a time, and how many of them again with the next ones; bytes by which nested data is known.
WINDOW, OVERLAP, HEAD = 8 << 20, 64 << 10, 64 << 10
#: Nested streams that are unpacked inside each other.
DEEP = 40

_ASSIGN = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNI = re.compile(r"(?:(?:\\u|%u)[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|(?:\\x[0-9A-Fa-f]{2})+|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&(?:quot|apos|equals|colon|amp);")
#: Base64, in lines of 76 or 64 with line ends that may themselves be escaped, or in one run.
_LINE_END = r"(?:\r?\n|(?:\\r)?\\n)"
_B64 = re.compile(rf"(?:[A-Za-z0-9+/]{{76}}{_LINE_END}|[A-Za-z0-9+/]{{64}}{_LINE_END})+[A-Za-z0-9+/]{{1,76}}={{0,2}}|[A-Za-z0-9+/_-]{{16,}}={{0,2}}")
_ENDS = re.compile(r"[\r\n]|\\[rn]")
_PART = re.compile(r"[A-Za-z0-9]{16,}={0,2}")
_BYTE = re.compile(r"%[0189A-Fa-f][0-9A-Fa-f]|\\x[0189A-Fa-f]|[%\\]u00[0189A-Fa-f]|&#")
_UNI_BYTE = re.compile(r"(?:\\x|[%\\]u00)[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|\\[abfnrtv0\\'\"]")
#: Signs of which each match of a pattern has one.
_SIGNS = {_URL: "%", _UNI: "\\&%", _UNI_BYTE: "\\&%"}
_MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9](?:1AY&SY|\x17\x72\x45\x38\x50\x90)|\xfd7zXZ\0|\x28\xb5\x2f\xfd")
_PADDING = re.compile(rb"\0*")
#: The shortest secret has 12 characters.
_WIDE = re.compile(rb"(?:[\x01-\x7f]\0\0\0){12,}|(?:\0\0\0[\x01-\x7f]){12,}|(?:[\x01-\x7f]\0){12,}|(?:\0[\x01-\x7f]){12,}")
#: What any secret, plain or escaped, has at least.
_HOLDS = re.compile(r"[\x20-\x7e]{12}")
#: What any such stretch has.
_WIDE_PART = re.compile(rb"\0[\x01-\x7f]\0[\x01-\x7f]\0|\0\0\0[\x01-\x7f]\0\0\0")
_ENCODED = re.compile(r"%[0-9A-Fa-fu]|\\[uUx]|&#|&[a-z]|[A-Za-z0-9+/_-]{16}")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the three rules over one text, code points, by start and kind.

    Leftmost matches that do not overlap within a kind; an assignment whose value has under
    six characters is dropped with what it covers. {n,} stands for a greedy run dropped when short.
    """
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end() - m.start(1) >= 6] if ":" in text or "=" in text else []
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return ordered(found)


def ordered(spans) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def told(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


class Layer:
    """A decoded text, and where its characters stand in the text of its parent.

    It is cut into stretches: character i of the stretch that begins at cuts[k] stands for the
    parent's bases[k] + i * nums[k] / dens[k] up to the same of i + 1, rounded outwards. `end`: what the
    last character reaches to, if more. A layer without a parent is the original text, or
    stands as a whole for one `span` of it.
    """

    def __init__(self, text: str, parent: Layer | None = None, cuts=(0,), bases=(0,), nums=(1,), dens=(1,), end: int = 0, span: tuple[int, int] | None = None):
        self.text, self.parent, self.end, self.span = text, parent, end, span
        self.begun, self.goes_on = False, False  # a window of a stream, with more before or after it
        self.cuts, self.bases, self.nums, self.dens = cuts, bases, nums, dens

    def original(self, start: int, end: int) -> tuple[int, int]:
        layer = self
        while layer.parent is not None:
            i, j = bisect.bisect_right(layer.cuts, start) - 1, bisect.bisect_right(layer.cuts, end - 1) - 1
            start, last = layer.bases[i] + (start - layer.cuts[i]) * layer.nums[i] // layer.dens[i], end == len(layer.text)
            end = layer.bases[j] - (end - layer.cuts[j]) * -layer.nums[j] // layer.dens[j]
            end = max(end, layer.end) if last else end
            layer = layer.parent
        return layer.span or (start, end)


def _opaque(layer: Layer) -> bool:
    return layer.parent is None and layer.span is not None


def _widths(text: str, widths) -> Iterator[tuple[int, int, int]]:
    """(character, place in the source, width) where stretches of characters of one width begin."""
    w = np.asarray(widths, np.int64)
    first = np.flatnonzero(np.diff(w, prepend=-1))
    places = np.cumsum(w) - w
    yield from zip(first.tolist(), places[first].tolist(), w[first].tolist())


def _rewritten(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with each match of the pattern replaced by what it encodes, if any decodes.

    decode gives the text and how many characters of the match stand for each of its own: one
    number, or one for each.
    """
    if not any(sign in layer.text for sign in _SIGNS[pattern]):
        return None
    out, at, size = [], 0, 0
    cuts, bases, nums = array("q"), array("q"), array("q")

    def add(piece: str, base: int, num: int) -> None:
        nonlocal size
        cuts.append(size)
        bases.append(base)
        nums.append(num)
        size += len(piece)
        out.append(piece)

    for m in pattern.finditer(layer.text):
        got = decode(m.group())
        if not got or not got[0]:
            continue
        if at < m.start():
            add(layer.text[at : m.start()], at, 1)
        text, width = got
        if isinstance(width, int):
            add(text, m.start(), width)
        else:
            stretches = [*_widths(text, width), (len(text), 0, 0)]
            for (i, place, w), (j, _, _) in zip(stretches, stretches[1:]):
                add(text[i:j], m.start() + place, w)
        at = m.end()
    if not out:
        return None
    if at < len(layer.text):
        add(layer.text[at:], at, 1)
    if _opaque(layer):
        return Layer("".join(out), span=layer.span)
    return Layer("".join(out), layer, cuts, bases, nums, _Ones())


class _Ones:
    """A one at every place."""

    def __getitem__(self, i: int) -> int:
        return 1


def _url(run: str):
    raw = bytes.fromhex(run.replace("%", ""))
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return raw.decode("latin-1"), 3
    return text, 3 if len(text) == len(raw) else 3 * _utf8_widths(text)


def _url_bytes(run: str):
    return bytes.fromhex(run.replace("%", "")).decode("latin-1"), 3


def _utf8_widths(text: str) -> np.ndarray:
    """Bytes of each character."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)


_SHORT = dict(zip("abfnrtv0\\'\"", "\a\b\f\n\r\t\v\0\\'\""))


def _uni_bytes(one: str):
    if len(one) == 2:
        return _SHORT[one[1]], 2
    n = int(one[3:-1], 16) if one[:3] in ("&#x", "&#X") else int(one[2:-1]) if one[0] == "&" else int(one[-2:], 16)
    return (chr(n), len(one)) if n < 256 else None


def _unicode(run: str):
    if run[0] == "&":
        text = html.unescape(run)
        return text, [len(run)] + [0] * (len(text) - 1)
    if run[:2] in ("\\U",) or run.startswith("\\u{"):
        n = int(run.strip("\\uU{}"), 16)
        return (chr(n), len(run)) if n < 0x110000 and not 0xD800 <= n < 0xE000 else None
    step = 4 if run[1] == "x" else 6
    units = [int(run[i + 2 : i + step], 16) for i in range(0, len(run), step)]
    if not any(0xD800 <= u < 0xE000 for u in units):
        return "".join(map(chr, units)), step
    out, widths, i = [], [], 0
    while i < len(units):
        if 0xD800 <= units[i] < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1] < 0xE000:
            out.append(chr(0x10000 + (units[i] - 0xD800 << 10) + units[i + 1] - 0xDC00))
            widths.append(2 * step)
            i += 2
        else:
            out.append(chr(units[i]) if not 0xD800 <= units[i] < 0xE000 else "�")
            widths.append(step)
            i += 1
    return "".join(out), widths


def _plain(raw: bytes) -> bool:
    """Whether the bytes are UTF-8 that reads as text."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return False
    return text.replace("\t", "").replace("\n", "").replace("\r", "").isprintable()


class _Zstandard:
    """A zstandard stream in the manner of zlib's objects; small inputs at a time bound what comes out of one."""

    def __init__(self):
        self.d, self.eof, self.unused_data, self.unconsumed_tail = zstandard.ZstdDecompressor().decompressobj(), False, b"", b""

    def decompress(self, data, room: int) -> bytes:
        data, out = memoryview(data), bytearray()
        while len(data) and not self.d.eof and len(out) < room:
            out += self.d.decompress(data[:256])
            data = data[256:]
        self.eof, self.unconsumed_tail = self.d.eof, bytes(data) if not self.d.eof else b""
        self.unused_data = bytes(self.d.unused_data) + bytes(data) if self.d.eof else b""
        return bytes(out)


class _Buffered:
    """A bzip2 or xz stream in the manner of zlib's objects: it keeps its input itself."""

    def __init__(self, d):
        self.d, self.unconsumed_tail = d, b""

    def decompress(self, data, room: int) -> bytes:
        return self.d.decompress(data, room) if not self.d.eof else b""

    @property
    def more(self) -> bool:
        return not self.d.eof and not self.d.needs_input

    @property
    def eof(self) -> bool:
        return self.d.eof

    @property
    def unused_data(self) -> bytes:
        return self.d.unused_data


def _decompressor(head: bytes):
    if head[:4] == b"\x28\xb5\x2f\xfd":
        return _Zstandard()
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if head[:1] == b"\x78":
        return zlib.decompressobj()
    return _Buffered(bz2.BZ2Decompressor() if head[:3] == b"BZh" else lzma.LZMADecompressor(lzma.FORMAT_XZ))


_BROKEN = (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError, zstandard.ZstdError)


class Members:
    """Gzip, zlib, bzip2, xz or zstandard data, all members that follow each other, unpacked window by window."""

    def __init__(self):
        self.d, self.any, self.whole, self.broken = None, False, False, False

    def unpack(self, raw: bytes, at: int) -> Iterator[bytes]:
        """What the bytes from `at` unpack to; `end`, `whole` and `broken` tell how far it went: whole at the end of a last member, neither if more bytes may follow."""
        self.end = first = at
        while True:
            if self.d is None:
                if not _MAGIC.match(raw, at):
                    return
                self.d, self.whole = _decompressor(raw[at : at + 6]), False
            data = memoryview(raw)[at:]
            while True:
                try:
                    out = self.d.decompress(data, WINDOW)
                except _BROKEN:
                    self.broken, self.whole = True, self.end > first  # up to the last whole member
                    return
                if out:
                    self.any = True
                    yield out
                data = self.d.unconsumed_tail
                if self.d.eof or not (data or len(out) >= WINDOW or getattr(self.d, "more", False)):
                    break
            if not self.d.eof:
                self.end = len(raw)
                return
            self.end, self.whole = len(raw) - len(self.d.unused_data), True
            at, self.d = self.end + len(_PADDING.match(raw, self.end).group()), None


def inflated(raw: bytes) -> Iterator[bytes] | None:
    """Deflate data without a header, which nothing but its end at the end of the bytes tells apart, window by window."""

    def unpack() -> Iterator[bytes]:
        d, data = zlib.decompressobj(-15), raw
        while not d.eof and (out := d.decompress(data, WINDOW)):
            yield out
            data = d.unconsumed_tail
        yield d.eof and not d.unused_data

    try:
        size = 0
        for out in unpack():  # once through, to see whether it ends
            size += len(out) if isinstance(out, bytes) else 0
    except zlib.error:
        return None
    return (x for x in unpack() if isinstance(x, bytes)) if out and size else None


def _unbase64(run: str) -> bytes | None:
    body = (_ENDS.sub("", run) if "\n" in run or "\\" in run else run).rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4))
    except (binascii.Error, ValueError):
        return None


def _embedded(layer: Layer, start: int, run: str, raw: bytes) -> Layer:
    """The bytes that a base64 run holds, as characters up to 255: byte i takes the characters from 4/3 i on."""
    text = raw.decode("latin-1")
    if _opaque(layer):
        return Layer(text, span=layer.span)
    if "\n" in run or "\\" in run:
        return Layer(text, span=layer.original(start, start + len(run)))
    return Layer(text, layer, (0,), (start,), (4,), (3,), start + len(run))  # with the padding


def _texts(layer: Layer, raw: bytes) -> Iterator[Layer]:
    """What the bytes of a layer read as: UTF-8, Latin-1 where they are no UTF-8, and the ASCII stretches of UTF-16 and UTF-32."""
    if _opaque(layer) or raw.isascii():
        yield layer  # all rules are of ASCII characters, and places do not matter
    else:
        try:
            text = raw.decode()
            cuts, bases, nums = (array("q", x) for x in zip(*_widths(text, _utf8_widths(text))))
            yield Layer(text, layer, cuts, bases, nums, _Ones())
        except UnicodeDecodeError:
            yield layer
    yield from _wide_texts(layer, raw)


def _wide_texts(layer: Layer, raw: bytes) -> Iterator[Layer]:
    for m in _WIDE.finditer(raw) if _WIDE_PART.search(raw) else ():
        text = m.group().replace(b"\0", b"").decode()
        step = len(m.group()) // len(text)
        yield Layer(text, span=layer.span) if _opaque(layer) else Layer(text, layer, (0,), (m.start(),), (step,), (1,))


class Scan:
    """The worklist of one text."""

    def __init__(self, text: str):
        self.base = base_spans(text)
        self.found, self.layers = set(self.base), 0
        self.seen, self.work = {(text, 0, len(text))}, deque()
        self.deep: deque[tuple[Layer, bytes]] = deque()
        if text and _ENCODED.search(text):
            self.work.append(Layer(text))
            while self.work or self.deep:
                if self.deep:
                    self.unpack(*self.deep.popleft())
                else:
                    self.unwrap(self.work.popleft())

    def push(self, new: Layer | None) -> None:
        """Scan a layer that was not seen before, and put it on the list if it may hold others."""
        if new is None or not _HOLDS.search(new.text):
            return
        key = (hashlib.sha256(new.text.encode("utf-8", "replace")).digest(), *new.original(0, len(new.text)))
        if key not in self.seen:
            self.seen.add(key)
            self.layers += 1
            self.found.update((k, *new.original(a, b)) for k, a, b in base_spans(new.text))
            if _ENCODED.search(new.text):
                self.work.append(new)

    def unwrap(self, layer: Layer) -> None:
        self.push(_rewritten(layer, _URL, _url))
        self.push(_rewritten(layer, _UNI, _unicode))
        if _BYTE.search(layer.text):  # escapes may spell bytes
            for pattern, decode in ((_URL, _url_bytes), (_UNI_BYTE, _uni_bytes)):
                spelled = _rewritten(layer, pattern, decode)
                if spelled:
                    raw = spelled.text.encode("latin-1", "replace")
                    self.unpack(spelled, raw)
                    for new in _wide_texts(spelled, raw):
                        self.push(new)
        for m in _B64.finditer(layer.text):
            run = m.group()
            if layer.begun and not m.start() or layer.goes_on and m.end() == len(layer.text):
                self.cut_run(layer, m)
            elif not self.base64_run(layer, m.start(), run):  # a path or a name may precede the encoded part
                for p in _PART.finditer(run):
                    if p.end() - p.start() < len(run):
                        self.base64_run(layer, m.start() + p.start(), p.group())

    def cut_run(self, layer: Layer, m: re.Match) -> None:
        """A run that a window cuts: its first character may stand anywhere in a group of four, and its last group may lack some."""
        for k in range(4 if layer.begun and not m.start() else 1):
            run = m.group()[k:]
            self.base64_run(layer, m.start() + k, run[: len(run) - len(run) % 4] if m.end() == len(layer.text) else run)

    def base64_run(self, layer: Layer, start: int, run: str) -> bool:
        raw = _unbase64(run)
        return bool(raw) and self.take(_embedded(layer, start, run, raw), raw)

    def take(self, layer: Layer, raw: bytes) -> bool:
        """Take up all that the bytes may be; whether they read as text or begin with compressed data."""
        for new in _texts(layer, raw):
            self.push(new)
        return self.unpack(layer, raw) or _plain(raw) or self.inflate(layer, raw)

    def unpack(self, layer: Layer, raw: bytes, above: Unpacked | None = None, known: int = 0) -> bool:
        """Take up the compressed data in the bytes of a layer; whether they begin with some.

        `above`: the stream whose window the bytes are, to which more may follow; it has looked
        at the first `known` bytes before.
        """
        at, first = 0, False
        while m := _MAGIC.search(raw, at):
            at = m.start() + 1
            if m.end() <= known:
                continue
            members, inner = Members(), None
            for out in members.unpack(raw, m.start()):
                inner = inner or Unpacked(self, layer.span if _opaque(layer) else None, layer, m.start(), raw, above)
                inner.hold(out)
            if inner:
                inner.close(members, raw)
                at = members.end if members.whole else at
                first = first or not m.start()
        return first

    def inflate(self, layer: Layer, raw: bytes) -> bool:
        out = inflated(raw)
        if out:
            inner = Unpacked(self, layer.original(0, len(raw)), layer, 0, raw, None)
            for x in out:
                inner.feed(x)
        return bool(out)

    def complete(self, span: tuple[int, int]) -> bool:
        """Whether all kinds are known at a span: nothing that stands for it as a whole can add to them."""
        return all((k, *span) in self.found for k in KINDS)


class Unpacked:
    """What comes out of compressed data, window by window; all of it stands for one span.

    The first window waits until the end of the data, and so its span, is known. Nested data
    that goes on beyond a window is kept open, and fed from the next ones.
    """

    def __init__(self, scan: Scan, span: tuple[int, int] | None, layer: Layer, start: int, raw: bytes, above: Unpacked | None):
        self.scan, self.span, self.layer, self.start, self.above = scan, span, layer, start, above
        self.head = hashlib.sha256(raw[start : start + HEAD]).digest()
        self.tail, self.open, self.waiting = b"", [], []
        self.depth = above.depth + 1 if above else 0
        while above and above.head != self.head:
            above = above.above
        self.cycle = above is not None  # data that holds itself

    def hold(self, data: bytes) -> None:
        """Take up a window at once if the span is known, or keep it until it is."""
        if self.span is not None:
            self.feed(data)
        else:
            self.waiting.append(zlib.compress(data, 1))

    def close(self, members: Members, raw: bytes) -> None:
        """The data at hand has come to its end; it stays open if more may follow."""
        if self.span is None:
            self.span = self.layer.original(self.start, max(members.end, self.start + 1))
            for data in self.waiting:
                self.feed(zlib.decompress(data))
            self.waiting = []
        if self.above and not (members.whole or members.broken):
            self.above.open.append((members, self))

    def feed(self, data: bytes) -> None:
        if self.cycle or not data or self.scan.complete(self.span):
            return
        still = []
        for members, inner in self.open:
            for out in members.unpack(data, 0):
                inner.feed(out)
            if not (members.whole or members.broken):
                still.append((members, inner))
        self.open = still
        window, known = self.tail + data, len(self.tail)
        self.tail = window[-OVERLAP:]
        key = ("window", hashlib.sha256(window).digest(), *self.span)
        if key in self.scan.seen:
            return
        self.scan.seen.add(key)
        layer = Layer(window.decode("latin-1"), span=self.span)
        layer.begun, layer.goes_on = known > 0, len(data) >= WINDOW
        for new in _texts(layer, window):
            self.scan.push(new)
        if self.depth >= DEEP:
            self.scan.deep.append((layer, window))  # later, from the list
        elif not self.scan.unpack(layer, window, self, known) and not known and not _plain(window):
            self.scan.inflate(layer, window)


def all_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], int]:
    """Base spans, all spans, and layers unwrapped."""
    scan = Scan(text)
    return scan.base, ordered(scan.found) if scan.layers else scan.base, scan.layers


def secret_scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_layers: one row per row.

    The counts and the hash are of the base rules over the text itself; `spans` adds what the
    unwrapped layers hold. Null text counts as empty: no spans, the hash of nothing. Null and
    repeated ids and repeated rows pass through, an empty table gives no rows, and other columns
    of docs, whatever their names, play no part. Texts of any length are scanned whole, and so is
    what they unpack to, by windows of WINDOW bytes with an overlap.
    """

    def make():
        def work(doc_id, text):
            got = [all_spans(t) for t in text]
            counts = {f"n_{kind}": [sum(s[0] == kind for s in b) for b, _, _ in got] for kind in KINDS}
            return {"doc_id": doc_id, **counts,
                    "base_sha256": [hashlib.sha256(told(b).encode()).hexdigest() for b, _, _ in got],
                    "spans": [told(s) for _, s, _ in got],
                    "n_layers": [n for _, _, n in got]}

        return work

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), text_of(text).alias("text"))
    return map_rows(rows, make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long")
