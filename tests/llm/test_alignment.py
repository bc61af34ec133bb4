import hashlib
import json
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kestrane.llm import alignment as module
from kestrane.llm.alignment import Aligner, alignment, group_sizes
from kestrane.llm.bpe import byte_of_char
from kestrane.llm.queries import tokenizer


@pytest.fixture(scope="module")
def paths():
    return tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")


class Plain:
    """The alignment token by token, without labels or chunks."""

    def __init__(self, a_path, b_path):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        back = byte_of_char()
        self.a_bytes = {i: bytes(back[c] for c in t) for t, i in json.load(open(a_path))["model"]["vocab"].items() if all(c in back for c in t)}

    def b_bytes(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def groups(self, text):
        if not text:
            return []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        pieces = [self.a_bytes[i] for i in a], [self.b_bytes(i) for i in b]
        if any(b"".join(p) != (" " + text).encode() for p in pieces):
            return []
        out, i, j, at_a, at_b, first = [], 0, 0, 0, 0, (0, 0)
        while i < len(a) or j < len(b):
            if at_a <= at_b:
                at_a, i = at_a + len(pieces[0][i]), i + 1
            else:
                at_b, j = at_b + len(pieces[1][j]), j + 1
            if at_a == at_b:
                out.append((a[first[0] : i], b[first[1] : j]))
                first = (i, j)
        return out

    def rows(self, docs):
        aligned = [(i, self.groups(t)) for i, t in docs]
        links = [Counter((x, y) for a, b in g for x in a for y in b) for _, g in aligned]
        count = Counter(p for x in links for p in x)
        highest = defaultdict(int)
        for (x, _), n in count.items():
            highest[x] = max(highest[x], n)
        out = []
        for (i, g), own in zip(aligned, links):
            spelt = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
            out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(own.values()), sum(n for p, n in own.items() if count[p] == highest[p[0]]), sum(n * count[p] for p, n in own.items()), hashlib.sha256(spelt.encode()).hexdigest() if g else ""))
        return sorted(out, key=str)


@pytest.fixture(scope="module")
def plain(paths):
    return Plain(*paths)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_spans_up_to_both_labels():
    sizes = group_sizes(np.array([1, 3, 4, 6]), np.array([2, 3, 6]), 6)
    assert [x.tolist() for x in sizes] == [[2, 2], [2, 1]]


@pytest.mark.parametrize("size,n", [(1 << 20, 1000), (3000, 7)])
def test_equals_token_by_token(spark, sf_dir, paths, plain, size, n):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").repartition(3)
    assert rows(alignment(docs, *paths, size=size, rows=n)) == plain.rows([tuple(r) for r in docs.collect()])


def test_edges_very_long_groups_and_clashing_names(spark, paths, plain, edge_docs, monkeypatch):
    extra = [(20, "▁ is the sign for a space", None, None), (21, "<|endoftext|> <s> </s> <0x41>", None, None), (22, "日本語の文章です。" * 40, None, None), (23, "\u0000\u0001 \x7f﻿", None, None), (24, "=" * 5000 + "-" * 4999 + "é" * 3001, None, None)]
    docs = edge_docs.unionAll(spark.createDataFrame(extra, edge_docs.schema)).withColumnRenamed("kept", "pairs").withColumnRenamed("rid", "chunk")
    got = alignment(docs, *paths)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("doc_id", "bigint"), ("n_a", "bigint"), ("n_b", "bigint"), ("n_groups", "bigint"), ("n_links", "bigint"), ("n_best", "bigint"), ("count_sum", "bigint"), ("groups_sha256", "string")]
    assert rows(got) == plain.rows([(r.doc_id, r.text) for r in docs.collect()])


def test_no_rows(spark, no_docs, paths):
    assert alignment(no_docs, *paths).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list(" \n\tabcdeAZ.,'0189éßñ日本語😀▁　́<|>=")), max_size=40), min_size=1, max_size=5))
def test_random_texts(texts):
    paths = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
    aligner, plain = module.aligner_for(*paths), _plain(paths)
    got = aligner.aligned(texts)
    want = [plain.groups(t) for t in texts]
    assert got["n_groups"].tolist() == [len(g) for g in want]
    assert got["n_links"].tolist() == [sum(len(a) * len(b) for a, b in g) for g in want]
    for i, g in enumerate(want):
        own = Counter((x * aligner.n_b + y) for a, b in g for x in a for y in b)
        lo, hi = got["offsets"][i : i + 2]
        assert dict(zip(got["pairs"][got["place"][lo:hi]].tolist(), got["links"][lo:hi].tolist())) == own


_kept = {}


def _plain(paths):
    if paths not in _kept:
        _kept[paths] = Plain(*paths)
    return _kept[paths]


@pytest.mark.parametrize("large,pairs", [(0, 4), (3, 5), (10**9, 1)])
def test_ways_to_pair_agree(paths, monkeypatch, large, pairs):
    text = ["aaaa bbbb   cccc ééé日本 the end of it " * 3, "", "x"]
    aligner = Aligner(*paths)
    want = aligner.aligned(text)
    monkeypatch.setattr(module, "LARGE", large)
    monkeypatch.setattr(module, "PAIRS", pairs)
    got = aligner.aligned(text)
    for k in ("offsets", "place", "links", "pairs", "docs"):
        assert got[k].tolist() == want[k].tolist()
    assert got["groups_sha256"] == want["groups_sha256"]
