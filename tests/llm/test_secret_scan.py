import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import urllib.parse
import zlib

import zstandard

from kestrane.llm import secret_scan as module
from kestrane.llm.queries import op1_secret_scans
from kestrane.llm.secret_scan import all_spans, base_spans, secret_scan

KEY = "AKIA" + "ABCDEFGH01234567"


def brute(text):
    out = [("assign", m.start(), m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m.group(2)) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def test_base_rules():
    for t in ["", "token: token:abcdefg", "PassWord = 'abcdef'", "api_key=abc", "toKen=abcdefg", "é" * 5 + f' secret="{KEY}" ' + "0123456789abcdef" * 3, "AKIAAKIA" + "A" * 16, "x" * 30 + "deadbeef" * 3 + "g" + "deadbee" * 3, 'password"  :   "x-y_z=.+/"']:
        assert base_spans(t) == brute(t), t


def found(text):
    base, spans, _ = all_spans(text)
    assert set(base) <= set(spans)
    return [s for s in spans if s not in base]


def test_layers():
    inner = 'password = "hunter2hunter2"'
    pad = "été lorem ipsum "
    for encode in (
        urllib.parse.quote,
        lambda t: "".join(f"%{b:02x}" for b in t.encode()),
        lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
        lambda t: "".join(f"&#{ord(c)};" for c in t),
        lambda t: base64.b64encode(t.encode()).decode(),
        lambda t: base64.urlsafe_b64encode(gzip.compress(t.encode())).decode(),
        lambda t: base64.b64encode(base64.b64encode(zlib.compress(t.encode()))).decode(),
        lambda t: urllib.parse.quote(urllib.parse.quote(base64.b64encode(t.encode()).decode(), safe="")),
        lambda t: base64.b64encode("".join(f"\\u{ord(c):04x}" for c in t).encode()).decode(),
        lambda t: base64.encodebytes((t + " filler words" * 20).encode()).decode().strip(),
    ):
        code = encode(inner)
        text = f"{pad}{code} and more"
        got = found(text)
        assert got, code
        assert all(len(pad) <= a < b <= len(pad) + len(code) for _, a, b in got), (code, got)
        assert {"assign"} <= {k for k, _, _ in got}
    assert found(f"blob {base64.b64encode(KEY.encode()).decode()} end") == [("access", 5, 33)]


def test_mapping_is_tight():
    text = "see q=" + urllib.parse.quote("a b") + "&token%3Dabcdef99 end"
    (kind, a, b), = found(text)
    assert kind == "assign" and text[a:b] == "token%3Dabcdef99"


def test_plain_text_adds_nothing_and_loops_end():
    assert found("The quick brown fox %% 100% \\u of " + "abcdefghijklmnopqrstuvwx " * 3) == []
    assert found("%25" * 50 + "41") == []


def test_rows(edge_docs, no_docs):
    got = secret_scan(edge_docs).collect()
    assert len(got) == edge_docs.count()
    assert all(r.spans == "" and r.n_assign == 0 for r in got if r.doc_id in (4, 5, 6))
    assert secret_scan(no_docs).count() == 0


def test_bytes_of_any_kind():
    inner = 'password = "hunter2hunter2"'
    b64 = lambda raw: base64.b64encode(raw).decode()
    for raw in (f"prix : 5 € {inner}".encode(), ("﻿" + inner).encode(), f"a​b\f\0 {inner}".encode(), f"déjà {inner}".encode("latin-1"), b"\x89\xff\0\1 " + inner.encode(),
                inner.encode("utf-16"), inner.encode("utf-16-be"), b"\xff" + inner.encode("utf-16-le"), inner.encode("utf-32"), b"\x01\xff head " + gzip.compress(inner.encode("utf-16"))):
        code = b64(raw)
        got = found(f"see {code} end")
        assert "assign" in {k for k, _, _ in got}, raw
        assert all(4 <= a < b <= 4 + len(code) for _, a, b in got)
    zs = zstandard.ZstdCompressor().compress
    for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress, zs):
        raw = pack(b"nothing here ") + pack(b"pass") + pack(inner[4:].encode() + b" e" * 9)
        for encode in (b64, urllib.parse.quote, lambda r: "".join(f"%{b:02x}" for b in r), lambda r: "".join(f"\\x{b:02x}" for b in r), lambda r: repr(r)[2:-1], lambda r: "".join(f"&#{b};" for b in r)):
            text = f"é…see {encode(raw)} end"
            got = found(text)
            assert "assign" in {k for k, _, _ in got}, (pack, text)
            assert all(6 <= a < b <= len(text) - 4 for _, a, b in got)
    assert found("see " + "".join(f"%{b:02x}" for b in inner.encode("utf-16-le")) + " end")


def decoded(text):
    """(start, end, inner text) of runs of a text that decode as a whole, one step deep; plain and slow."""
    out = []
    for m in re.finditer(r"(?:%[0-9A-Fa-f]{2})+", text):
        out.append((*m.span(), urllib.parse.unquote_to_bytes(m.group())))
    for m in re.finditer(r"(?:\\u[0-9a-f]{4})+", text):
        out.append((*m.span(), "".join(chr(int(x, 16)) for x in m.group().split("\\u")[1:]).encode("utf-8", "replace")))
    for m in re.finditer(r"[A-Za-z0-9+/]{16,}={0,2}", text):
        try:
            out.append((*m.span(), base64.b64decode(m.group(), validate=True)))
        except ValueError:
            pass
    for a, b, raw in out:
        for unpack in (gzip.decompress, zlib.decompress, bz2.decompress, lzma.decompress, lambda x: zlib.decompress(x, -15), lambda x: zstandard.ZstdDecompressor().decompressobj().decompress(x)):
            try:
                yield a, b, unpack(raw).decode("utf-8", "ignore")
            except Exception:  # noqa: BLE001
                pass
        yield a, b, raw.decode("utf-8", "ignore")


def kinds(text, deep=6):
    return {k for k, _, _ in brute(text)} | {k for _, _, t in decoded(text) if deep for k in kinds(t, deep - 1)}


def test_query_against_a_recursive_decoder(spark, sf_dir, tmp_path):
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet")
    inner = [f'a note: {x} and on, as long as it takes' for x in ('token="abcdef0123"', KEY, "deadbeef" * 3, "nothing")]
    coded = [f(x) for x in inner for f in (urllib.parse.quote, lambda x: base64.b64encode(x.encode()).decode(), lambda x: base64.b64encode(gzip.compress(x.encode())).decode(), lambda x: base64.b64encode(base64.b64encode(x.encode())).decode())]
    made = spark.createDataFrame([(10**6 + i, f"été {x} fin") for i, x in enumerate(coded)], "doc_id long, text string")
    sf_dir = str(tmp_path)
    whole.unionByName(made, allowMissingColumns=True).write.parquet(f"{sf_dir}/documents.parquet")
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    order, deep = ["assign", "access", "hex"], 0
    for r in op1_secret_scans(spark, sf_dir).collect():
        base = brute(text[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == kind for k, _, _ in base) for kind in order]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert set(base) <= set(spans) and spans == sorted(spans, key=lambda s: (s[1], order.index(s[0]), s[2]))
        more = [s for s in spans if s not in base]
        for a, b, inner in decoded(text[r.doc_id]):
            for k in kinds(inner):
                deep += 1
                assert any(s[0] == k and s[1] < b and s[2] > a for s in spans), (r.doc_id, k, a, b)
        for k, a, b in more:  # nothing is found that is not there
            assert any(x < b and y > a for x, y, _ in decoded(text[r.doc_id])) or any(x < b and y > a for _, x, y in base) or re.search("%|&|\\\\", text[r.doc_id][a:b])
    assert deep


def test_random_nesting():
    r = random.Random(11)
    steps = [
        lambda x: base64.b64encode(x).decode(), lambda x: "".join(f"%{b:02X}" for b in x), lambda x: base64.b64encode(gzip.compress(x)).decode(), lambda x: base64.b64encode(zlib.compress(x)[2:-4]).decode(),
        lambda x: base64.b64encode(bz2.compress(x)).decode(), lambda x: base64.b64encode(lzma.compress(x)).decode(), lambda x: base64.b64encode(zstandard.compress(x)).decode(),
        lambda x: base64.b64encode(gzip.compress(b"first ") + gzip.compress(x)).decode(), lambda x: base64.b64encode(("\u00a0\u200b" + x.decode()).encode()).decode(), lambda x: base64.b64encode(x.decode().encode("utf-16")).decode()]
    secrets = {"assign": 'password: "hunter2hunter2"', "access": KEY, "hex": "deadbeef" * 4}
    for _ in range(300):
        kind = r.choice(list(secrets))
        code = "text " + secrets[kind] + " more text"
        for _ in range(r.randrange(1, 5)):
            code = r.choice(steps)(code.encode())
        got = found(f"héllo {code} .")
        assert any(k == kind and 6 <= a < b <= 6 + len(code) for k, a, b in got), (kind, code[:200])


def test_long_runs_take_neither_much_time_nor_memory():
    import resource
    import time

    r = random.Random(3)
    raw = r.randbytes(6 << 20) + b' token="abcdef0123" ' + r.randbytes(1 << 10)
    text = "img " + base64.b64encode(raw).decode() + " end"
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.process_time()
    got = found(text)
    assert time.process_time() - began < 20  # a third of that on an idle machine; before, it grew with the square
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300 << 10
    at = (6 << 20) + 1
    assert ("assign", 4 + at * 4 // 3, 4 + -(-(at + 18) * 4 // 3)) in [(k, a, b) for k, a, b in got if k == "assign"] or any(k == "assign" and abs(a - 4 - at * 4 // 3) <= 2 for k, a, b in got)


def test_layers_of_any_size():
    d = zlib.compressobj(1)
    packed = b"".join([*(d.compress(b"some words and \n" * (1 << 16)) for _ in range(270)), d.compress(b"password: hunter2hunter2"), d.flush()])
    text = f"blob {base64.b64encode(packed).decode()} end"
    assert {k for k, _, _ in found(text)} == {"assign"}


def test_what_lies_across_windows(monkeypatch):
    monkeypatch.setattr(module, "WINDOW", 4000)
    monkeypatch.setattr(module, "OVERLAP", 200)
    r = random.Random(5)
    noise = lambda n: bytes(r.choice(b"abcdefghijklmnop \n") for _ in range(n))
    inner = b' password="hunter2hunter2" '
    for pack in (gzip.compress, bz2.compress, lzma.compress, zstandard.compress):
        for place in range(3900, 4100, 23):  # the secret itself across a border
            assert "assign" in {k for k, _, _ in found("see " + base64.b64encode(pack(noise(place) + inner + noise(900))).decode())}, (pack, place)
        nested = pack(r.randbytes(9000) + gzip.compress(r.randbytes(11_000) + inner + r.randbytes(9000)) + r.randbytes(900))  # a stream inside, over many windows
        assert "assign" in {k for k, _, _ in found("see " + base64.b64encode(nested).decode())}, pack
    for shift in range(5):  # a run of base64 over many windows
        nested = gzip.compress(b"x " * 10 + b"y" * shift + b" " + base64.b64encode(noise(12_000) + inner + noise(9000)) + b" z")
        assert "assign" in {k for k, _, _ in found("see " + base64.b64encode(nested).decode())}, shift


def test_deep_nesting_ends():
    code = b'token="abcdef0123"'
    for _ in range(120):
        code = zlib.compress(code)
    assert {k for k, _, _ in found("see " + base64.b64encode(code).decode())} == {"assign"}


def test_base64_in_lines_whose_ends_are_escaped():
    body = base64.b64encode(b"filler words " * 4 + b'password = "hunter2hunter2" and more filler words').decode()
    for width in (64, 76):
        for end in ("\\n", "\\r\\n", "\n", "\r\n"):
            text = '{"key": "' + end.join(body[i : i + width] for i in range(0, len(body), width)) + '"}'
            got = found(text)
            assert {k for k, _, _ in got} == {"assign"} and all(9 <= a < b <= len(text) - 2 for _, a, b in got), (width, end)
