import hashlib
import random
import zlib

import numpy as np
import pytest

from kestrane.llm import arrow_output, bpe, pieces, token_counts
from kestrane.llm.queries import op2_token_counts, op5_token_id_output, op10_bpe, tokenizer

TRICKY = ["", " ", "  a  b ", "a\n b", "a \n b\t c  ", "don't we'll I'M 'S x'", "été Ünï ÇA İstanbul ΣΑΣ ς", "a<|endoftext|>b <|endoftext|> c", "<|startoftext|>x y<|endoftext|>", "123 4,5.6 a1b2 #$%&*** foo###", "é ́x", "日本語 テキスト 🙂🙃", "x y  z \x1c q", "▁ literal ▁▁", "token=abc,def;(ghi)", "\x85 a 　 b"]


def random_texts(n, seed=5, chars="abcdeABC  \n\t'0123.,#é<|>ß🙂 ▁"):
    r = random.Random(seed)
    return ["".join(r.choice(chars) for _ in range(r.randrange(0, 90))) for _ in range(n)]


def test_forced_cuts_equal_the_library():
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    enc, lib = bpe.ForcedCuts(path), Tokenizer.from_file(path)
    texts = TRICKY + random_texts(3000) + random_texts(3000, 8, "aélz'ÉñT!,.%*é-5½ª ") + random_texts(2000, 12, "zqxjkvwÿþß×÷$~^|") + ["!'s ''ll a'llb é,*** xé,é'S," * 9]
    got = enc.encode_batch(texts)
    for t, ids, text in zip(texts, got, enc.decode_batch(got), strict=True):
        want = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, t
        assert text.decode() == lib.decode(want, skip_special_tokens=False), t


def test_cuts_are_the_absent_pairs():
    enc = bpe.ForcedCuts(tokenizer("word_bpe_49k.json"))
    pairs = bpe.token_pairs(enc.tokenizer.get_vocab(), "</w>")
    text = "".join(chr(c) for c in range(97, 123)) * 40 + "zqxjkvbqzxwq" * 20
    fragments, starts = enc.fragments(text)
    cut = {i for i, (a, b) in enumerate(zip(text.encode(), text.encode()[1:]), 1) if (a, b) not in pairs}
    assert set(starts[1:].tolist()) == cut and cut
    assert "".join(f[:-2] if f[-1] == " " else f for f in fragments) == text and all(f[-1] == " " for f in fragments[:-1])
    assert [f[-2] for f in fragments[:-1]] == [text[i] for i in starts[1:].tolist()]


def test_remembered_pieces_stay_bounded():
    seen = []
    known = pieces.Remembered(lambda new: seen.append(new) or {p: p.encode() for p in new}, 10)
    for lo in range(0, 200, 3):
        some = [f"w{i}" for i in range(lo, lo + 7)] + ["often", "often"]
        assert known.of(some) == [p.encode() for p in some]
        assert len(known.young) <= 17 and len(known.old) <= 17
    assert sum("often" in s for s in seen) == 1


def test_byte_fragments_equal_the_library():
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    enc, lib = arrow_output.ByteEncoder(path), Tokenizer.from_file(path)
    texts = TRICKY + random_texts(3000, 6) + random_texts(3000, 9, "ab 0\n\t é!'s\u0085\u2003") + ["", "", "x", "x"] + random_texts(2000, 10, "a <|endoftext|>\n")
    for t, ids in zip(texts, enc.encode_batch(texts)):
        assert np.frombuffer(ids, enc.dtype).tolist() == lib.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("chunk,overlap", [(64, 8), (200, 16), (33, 2)])
def test_spliced_chunks_equal_whole(chunk, overlap):
    path = tokenizer("piece_bpe_32k.model")
    c = token_counts.PieceCounter(path, chunk, overlap)
    r = random.Random(chunk)
    words = "the of Straße été naïve 日本語 🙂 foo### bar&&& aaaaaaaaaaaaaaaa  x\n\n y\t▁ <s> http://a.b/c?d=e 1234567890".split(" ")
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(1, 400))) for _ in range(60)] + ["a" * 1000, " " * 1000, "🙂" * 500, "ab" * 700] + [t * 30 for t in TRICKY]
    for t in texts:
        assert c.pieces(t).tolist() == c.model.encode(t), t
        assert c.count(t) == len(c.model.encode(t))


def test_shards_round_trip(tmp_path):
    import pyarrow as pa

    r, path = random.Random(3), str(tmp_path / "x.arrow")
    docs = [np.array([r.randrange(60000) for _ in range(r.choice([1, 2, 7, 300]))], "<u2") for _ in range(200)]
    with pa.OSFile(path, "wb") as sink:
        w = arrow_output.ShardWriter(sink, np.dtype("<u2"), 16, 4)
        for d in docs:
            w.add(d)
        w.close()
    with pa.memory_map(path) as m:
        f = pa.ipc.open_file(m)
        places, at = arrow_output.Places(f), 0
        t = f.read_all()
        used = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t["used"].chunks])
        ends = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t["ends"].chunks])
        assert used.sum() == sum(map(len, docs)) and used[: used.sum()].all()
        assert np.flatnonzero(ends).tolist() == (np.cumsum([len(d) for d in docs]) - 1).tolist()
        for d in docs:
            assert np.concatenate(list(places.stretches(at, len(d)))).tolist() == d.tolist()
            assert places.crc32(at, len(d)) == zlib.crc32(d.astype("<u4").tobytes())
            at += len(d)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_queries_against_the_libraries(spark, sf_dir):
    import sentencepiece
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    n = {d.doc_id: len(sp.encode(d.text)) for d in docs}
    assert rows(op2_token_counts(spark, sf_dir)) == sorted(((d.doc_id, len(d.text.encode()), n[d.doc_id], n[d.doc_id] > 4096) for d in docs), key=repr)
    lib, at, want = Tokenizer.from_file(tokenizer("byte_bpe_50k.json")), 0, []
    for d in docs:
        ids = lib.encode(d.text, add_special_tokens=False).ids + [2]
        want.append((d.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert rows(op5_token_id_output(spark, sf_dir)) == sorted(want, key=repr)
    lib, want = Tokenizer.from_file(tokenizer("word_bpe_49k.json")), []
    for d in docs:
        ids = lib.encode(d.text, add_special_tokens=False).ids
        want.append((d.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert rows(op10_bpe(spark, sf_dir)) == sorted(want, key=repr)


def test_repeated_texts_encode_as_the_library_does(monkeypatch):
    monkeypatch.setattr(bpe, "GROUP", 8)  # groups end between copies
    enc = bpe.ForcedCuts(tokenizer("word_bpe_49k.json"))
    texts = ["", "", "one two", "one two", "one two", "Three's", "", "one two", "", ""]
    monkeypatch.setattr(bpe, "PART", 8)  # two ids at a time
    got = enc.encode_batch(texts)
    for t, ids, decoded in zip(texts, got, enc.decode_batch(got), strict=True):
        want = enc.tokenizer.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and decoded.decode() == enc.tokenizer.decode(want, skip_special_tokens=False)
    assert enc.encode_batch([]) == []


def test_edges(edge_docs, no_docs):
    sp, byte, word = (tokenizer(n) for n in ("piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"))
    n = edge_docs.count()
    got = token_counts.token_counts(edge_docs, sp).collect()
    assert len(got) == n and {(r.doc_id, r.n_tokens) for r in got} >= {(4, 0), (5, 0), (None, 0)}
    got = bpe.encode_and_decode(edge_docs, word).collect()
    assert len(got) == n and any(r.doc_id == 5 and bytes(r.ids) == b"" and r.decoded == "" for r in got)
    got = sorted(arrow_output.token_id_output(edge_docs, byte).collect(), key=lambda r: r.start)
    assert len(got) == n and got[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    assert [r.doc_id for r in got if r.doc_id is not None] == sorted(r.doc_id for r in got if r.doc_id is not None)
    for f in (lambda d: token_counts.token_counts(d, sp), lambda d: bpe.encode_and_decode(d, word), lambda d: arrow_output.token_id_output(d, byte)):
        assert f(no_docs).count() == 0


def test_byte_encoder_on_odd_spaces_and_special_strings():
    encoder, r = arrow_output.ByteEncoder(tokenizer("byte_bpe_50k.json")), random.Random(1)
    parts = [" ", " ,", "  ", "\n", "\t", "\r\n", "a", "the", "word", "é", "日本", "😀", "'s", "'ll", "don't", "1", "23", ".", ",", "<|endoftext|>", "<|", "|>", " ", "　", "\x1c", "\x85", "ñ", "A", "(", "-", "​", "́"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(30))) for _ in range(5000)]
    want = encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    assert [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode_batch(texts)] == [x.ids for x in want]


def test_byte_words_are_cut_where_kinds_meet_and_encoded_once():
    enc, r = arrow_output.ByteEncoder(tokenizer("byte_bpe_50k.json")), random.Random(7)
    words = ["".join(r.choice("abcdefghé") for _ in range(r.randrange(2, 9))) for _ in range(200)]
    given = []
    encode = enc.known.encode
    enc.known.encode = lambda new: given.extend(new) or encode(new)
    enc.encode_batch([" " + " ".join(words) + " x, y. (z) 12\n"])
    given.clear()
    texts = ["".join(f" {w}{r.choice(['', ',', '.', ').', '12'])}" for w in r.choices(words, k=500)) for _ in range(9)]
    want = enc.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode_batch(texts)] == [x.ids for x in want]
    assert len(given) <= 4  # the signs after the words, not each word with each of them


def test_byte_cuts_equal_the_library_over_kinds_of_signs(monkeypatch):
    enc, r = arrow_output.ByteEncoder(tokenizer("byte_bpe_50k.json")), random.Random(11)
    monkeypatch.setattr(arrow_output, "GATHERED", 7)
    monkeypatch.setattr(arrow_output, "LONGEST", 5)
    monkeypatch.setattr(arrow_output, "TOGETHER", 3)
    signs = [" ", " ", " ", "\n", "\n", "\n\n", "\t", "a", "b", "Z", "Ġ", "é", "İ", "ſ", "ß", "1", "²", "½", ".", ",", "×", "_", "'", "'s", "<", "|", "<|", "|>", "<|endoftext|>", "ж", "語", "🙂", " ", "­", " ", " ", " ", "​", "　", "\u0085", "\x00", "\x1c", "\x7f", "́", "ſ", "ƀ"]
    texts = ["".join(r.choice(signs) for _ in range(r.randrange(14))) for _ in range(20000)]
    texts += ["".join(r.choice([" ", "\n", "a", "é", "1", "."]) for _ in range(r.randrange(9))) for _ in range(20000)]
    want = enc.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    for t, got, ids in zip(texts, enc.encode_batch(texts), want, strict=True):
        assert np.frombuffer(got, enc.dtype).tolist() == ids.ids, t
    assert enc.encode_batch([]) == [] and enc.encode_batch([""]) == [b""]
