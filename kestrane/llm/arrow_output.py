"""Token ids as Arrow files of fixed-size lists, and their reader.

The documents are sorted by id over range partitions; each task encodes its documents,
appends an end id to each and writes one shard: `ids-NNNNN.arrow`, an Arrow file whose
batches hold fixed-size lists of ids and of two bit masks (`used`: not padding; `ends`:
last id of a document), and `docs-NNNNN.arrow` with each document's id, first place and
number of ids in the shard. Equal-length rows can be read in place from a memory map.
Ids are 16-bit where the vocabulary fits, else 32-bit.
"""

from __future__ import annotations

import os
import posixpath
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import shared_path, text_of, tidy
from .bpe import byte_of_char
from .pieces import BLANK, DIGIT, FAR, LETTER, LIMIT, MARK, SPACE, Remembered, char_class, char_classes, grouped

#: Ids of a row, rows of a batch.
LENGTH, ROWS = 2048, 64
#: Code points of the texts that are cut at a time, bytes of the rows taken from a batch, words whose ids are gathered at a time.
GROUP, TAKEN, GATHERED = 1 << 22, 1 << 23, 1 << 18
#: Words that are encoded together, those of a remembered generation, bytes of the longest that is remembered.
TOGETHER, REMEMBERED, LONGEST = 4096, 400_000, 256
END_ID = 2

#: Kinds of signs beside those of `pieces`: a line feed, and what no word is cut at.
FEED, OTHER = 6, 7
_SETTLED = {kind: re.escape("".join(chr(c) for c in range(LIMIT) if char_class(c) == kind and c != 39)) for kind in (LETTER, DIGIT, MARK)}
_WORD = re.compile(f" ?(?:{'|'.join(f'[{signs}]+' for signs in _SETTLED.values())})|\n")
_loaded: dict[str, "ByteEncoder"] = {}


def byte_kinds() -> tuple[np.ndarray, np.ndarray]:
    """The kinds of the bytes below 128, and of the code points up to 0xFFFF; settled letters, digits and marks have theirs, white space is BLANK but for SPACE and FEED."""
    kinds = char_classes()[:0x10000].copy()
    kinds[(kinds == FAR) | (np.arange(0x10000) == 39)] = OTHER
    kinds[kinds == SPACE] = BLANK
    kinds[32], kinds[10] = SPACE, FEED
    first = np.full(256, OTHER, np.uint8)
    first[:128] = kinds[:128]
    return first, kinds


class ByteEncoder:
    """Ids of a byte-level vocabulary, by the words between certain cuts.

    No word of the tokenizer goes on over a space between two other signs than white space, nor
    over one into what is a special token, so texts are cut before each such space. A
    stretch of settled letters, digits and other signs (no apostrophe, no "<|") is cut further where these kinds meet, and
    around one or two line feeds between them; any other stays whole. The words of a group of texts are
    told apart in Arrow and looked up while they are remembered. New ones of one kind of signs are encoded
    together by the tokenizer's model, which needs no search for words then, others by the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.shown = {b: c for c, b in byte_of_char().items()}
        self.mark, self.shown[32] = self.shown[32], " "
        self.spaced = np.array([self.tokenizer.id_to_token(i).startswith(self.mark) for i in range(self.tokenizer.get_vocab_size())])
        self.first, self.kinds = byte_kinds()
        self.known = Remembered(self._encode, REMEMBERED)

    def _encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        spaced, bare, rest = [], [], []
        for w in words:
            (bare if w.isalpha() else spaced if w[0] == 32 and w[1:].isalpha() else rest).append(w)
        whole = []
        for w in rest:
            text = w.decode()
            (whole if "<|" in text or not _WORD.fullmatch(text) else spaced if w[0] == 32 else bare).append(w)
        out = {}
        for some, put in ((spaced, self.mark), (bare, self.mark + " ")):
            for lo in range(0, len(some), TOGETHER):
                part = some[lo : lo + TOGETHER]
                out |= zip(part, self._together(part, put), strict=True)
        got = self.tokenizer.encode_batch_fast([w.decode() for w in whole], add_special_tokens=False)
        out |= zip(whole, [np.array(x.ids, self.dtype).tobytes() for x in got], strict=True)
        return out

    def _together(self, words: list[bytes], put: str) -> list[bytes]:
        """Ids of words of one kind of signs, told apart by the tokens that begin with a space: the words' own, or one put before each that is taken off."""
        off = put.count(" ")
        joined = b" " + b" ".join(words) if off else b"".join(words)
        shown = joined.decode("latin-1")
        if not joined.isascii() or b"\n" in joined:
            shown = shown.translate(self.shown)
        ids = np.array(self.words.encode_batch_fast([shown.replace(" ", " " + put)], add_special_tokens=False)[0].ids, self.dtype)
        starts, size, flat = np.flatnonzero(self.spaced[ids]), self.dtype.itemsize, ids.tobytes()
        return [flat[a:b] for a, b in zip(((starts + off) * size).tolist(), [*(starts[1:] * size).tolist(), len(flat)])]

    def _kinds(self, data: np.ndarray) -> np.ndarray:
        """The kind of the sign that each byte belongs to."""
        kind = self.first[data]
        for lead, wide in ((0xC0, 2), (0xE0, 3)):
            at = np.flatnonzero((data >= lead) & (data < lead + (32 >> wide - 2)))
            if len(at):
                code = data[at].astype(np.int32) - lead
                for i in range(1, wide):
                    code = code << 6 | data[at + i] & 63
                for i in range(wide):
                    kind[at + i] = self.kinds[code]
        return kind

    def cuts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The places in UTF-8 data where words start; bounds: those where texts start, and the end. Texts are not empty."""
        kind, begins = self._kinds(data), bounds[:-1]
        white = (kind == SPACE) | (kind == FEED) | (kind == BLANK)
        after = np.append(white[1:], False)  # white space follows
        before = np.append(False, white[:-1])
        after[bounds[1:] - 1] = before[begins] = False
        alone = ~(before | after)
        single = (kind == SPACE) & alone
        single[bounds[1:] - 1] = False
        feed = np.flatnonzero((kind == FEED) & ~before)
        two = feed[after[feed]]  # of two line feeds before something else, the first
        two = two[(kind[two + 1] == FEED) & ~after[two + 1] & ~np.isin(two + 2, bounds)]
        start = single.copy()
        start[begins] = True
        bad = (kind >= OTHER) | (kind == BLANK) | (white & ~single & ~((kind == FEED) & alone))
        bad[two] = bad[two + 1] = False
        bad[np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))] = True  # "<|" may begin a special token
        stretch = np.cumsum(start, dtype=np.int64 if len(data) > 1 << 31 else np.int32)
        whole = np.zeros(stretch[-1] + 1, bool)
        whole[stretch[np.flatnonzero(bad)]] = True
        inner = 1 + np.flatnonzero((kind[1:] != kind[:-1]) & (kind[:-1] != SPACE) | (kind[1:] == FEED))
        start[inner[~whole[stretch[inner]]]] = True
        return np.flatnonzero(start)

    def _group(self, texts: list[str]) -> list[bytes]:
        data = pa.array(texts, pa.large_string())
        bounds = np.frombuffer(data.buffers()[1], np.int64, len(texts) + 1)
        filled = np.flatnonzero(np.diff(bounds))
        if not len(filled):
            return [b""] * len(texts)
        starts = self.cuts(np.frombuffer(data.buffers()[2], np.uint8, bounds[-1]), np.append(bounds[filled], bounds[-1]))
        offsets = np.append(starts, bounds[-1])
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), data.buffers()[2]]).dictionary_encode()
        ids = self._looked_up(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.array([len(i) for i in ids]) // self.dtype.itemsize
        first, flat, at = np.cumsum(size) - size, np.frombuffer(b"".join(ids), self.dtype), words.indices.to_numpy()
        parts = []
        for lo in range(0, len(at), GATHERED):
            some = at[lo : lo + GATHERED]
            n = size[some]
            parts.append(flat[np.repeat(first[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        every = np.concatenate(parts)
        places = np.append(0, np.cumsum(size[at]))[np.searchsorted(starts, bounds)].tolist()
        return [every[a:b].tobytes() for a, b in zip(places, places[1:])]

    def _looked_up(self, words: list[bytes]) -> list[bytes]:
        long = [w for w in words if len(w) > LONGEST]
        if not long:
            return self.known.of(words)
        apart = self._encode(long)
        short = iter(self.known.of([w for w in words if len(w) <= LONGEST]))
        return [apart[w] if len(w) > LONGEST else next(short) for w in words]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        out = []
        for group, places in grouped(texts, GROUP):
            got = self._group(group)
            out += [got[i] for i in places]
        return out


def encoder_for(path: str) -> ByteEncoder:
    if path not in _loaded:
        _loaded[path] = ByteEncoder(path)
    return _loaded[path]


def filesystem(uri: str):
    """The Arrow file system of a Hadoop-style URI, and the path in it; Hadoop's names of the object stores are Arrow's with a letter more."""
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "/", re.sub(r"^s3[an]:", "s3:", re.sub(r"^wasbs?:", "abfs:", uri)))
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def shard_schema(dtype: np.dtype, length: int) -> pa.Schema:
    row = lambda kind: pa.list_(pa.field("item", kind, nullable=False), length)
    return pa.schema([pa.field("ids", row(pa.from_numpy_dtype(dtype))), pa.field("used", row(pa.bool_())), pa.field("ends", row(pa.bool_()))])


class ShardWriter:
    """Packs documents into rows of equal length, batch by batch."""

    def __init__(self, sink, dtype: np.dtype, length: int, rows: int):
        self.length, self.rows, self.dtype = length, rows, dtype
        self.schema = shard_schema(dtype, length)
        self.file = pa.ipc.new_file(sink, self.schema)
        self.ids: list[np.ndarray] = []
        self.held, self.total, self.ends = 0, 0, []

    def add(self, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        self.ends.append(self.held - 1)
        if self.held >= self.length * self.rows:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        flat, full = np.concatenate(self.ids or [np.zeros(0, self.dtype)]), self.length * self.rows
        ends = np.zeros(-(-len(flat) // self.length) * self.length, bool)
        ends[self.ends] = True
        n = len(flat) if last else len(flat) // full * full
        for lo in range(0, n, full):
            part = flat[lo : min(n, lo + full)]
            size = -(-len(part) // self.length) * self.length
            ids = np.zeros(size, self.dtype)
            ids[: len(part)] = part
            columns = (ids, np.arange(size) < len(part), ends[lo : lo + size])
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip(columns, self.schema)]
            self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.ids, self.held, self.ends = [flat[n:]], len(flat) - n, [e - n for e in self.ends if e >= n]

    def close(self) -> None:
        self._flush(True)
        self.file.close()


def write_shards(docs: DataFrame, path: str, folder: str, end_id: int = END_ID, length: int = LENGTH, rows: int = ROWS,
                 text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Encode and write; gives (shard, n_ids, n_docs) as the tasks report them.

    A shard is written under a name of its attempt and then renamed, so a task that is
    run again leaves the same files.
    """
    texts = docs.select(docs[doc_id].cast("long").alias("doc_id"), text_of(text).alias("text")).withColumn("hash", F.xxhash64("text"))
    ordered = texts.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").drop("hash")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, task = encoder_for(path), TaskContext.get()
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        end = np.array([end_id], enc.dtype).tobytes()
        shard, mark = task.partitionId(), f".{task.taskAttemptId()}"
        name = lambda kind, ending="": posixpath.join(base, f"{kind}-{shard:05d}.arrow{ending}")
        index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        n_docs = 0
        with fs.open_output_stream(name("ids", mark)) as sink, fs.open_output_stream(name("docs", mark)) as isink, pa.ipc.new_file(isink, index_schema) as index:
            out = ShardWriter(sink, enc.dtype, length, rows)
            for batch in batches:
                taken = max(1, batch.num_rows * TAKEN // max(1, batch.nbytes))
                for lo in range(0, batch.num_rows, taken):
                    part = batch.slice(lo, taken)
                    start, entries = out.total, []
                    for ids in enc.encode_batch(part.column(1).to_pylist()):
                        flat = np.frombuffer(ids + end, enc.dtype)
                        entries.append((start, len(flat)))
                        start += len(flat)
                        out.add(flat)
                    index.write_batch(pa.RecordBatch.from_arrays([part.column(0), pa.array([s for s, _ in entries], pa.int64()), pa.array([n for _, n in entries], pa.int64())], schema=index_schema))
                    n_docs += part.num_rows
            out.close()
        for kind in ("ids", "docs"):
            fs.move(name(kind, mark), name(kind))
        tidy()
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n_ids": pa.array([out.total], pa.int64()), "n_docs": pa.array([n_docs], pa.int64())})

    return ordered.mapInArrow(write, "shard int, n_ids long, n_docs long")


def read_shards(spark, folder: str, shards: list[tuple[int, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files; shards: (number, ids before it).

    The list holds one small entry a shard, that is a task of the writing job.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        opened = lambda p: pa.memory_map(p) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(p)
        for batch in batches:
            for shard, before in zip(*(c.to_pylist() for c in batch.columns)):
                with opened(posixpath.join(base, f"ids-{shard:05d}.arrow")) as a, opened(posixpath.join(base, f"docs-{shard:05d}.arrow")) as b:
                    ids, index = pa.ipc.open_file(a), pa.ipc.open_file(b)
                    places = Places(ids)
                    for k in range(index.num_record_batches):
                        part = index.get_batch(k)
                        start, n = (part.column(i).to_numpy() for i in (1, 2))
                        crc = [places.crc32(int(s), int(x)) for s, x in zip(start, n)]
                        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(start + before), part.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    import pyarrow.fs  # noqa: F401

    todo = spark.createDataFrame(shards, "shard int, before long").repartition(max(1, len(shards)), "shard")
    return todo.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


class Places:
    """Random access to the ids of a shard by their place in it."""

    def __init__(self, file):
        self.file = file
        self.length = file.schema.field("ids").type.list_size
        self.batch_ids = file.get_batch(0).num_rows * self.length if file.num_record_batches else 1
        self.at, self.flat = -1, None

    def _batch(self, k: int) -> np.ndarray:
        if k != self.at:
            self.at, self.flat = k, self.file.get_batch(k).column(0).values.to_numpy()
        return self.flat

    def stretches(self, start: int, n: int) -> Iterator[np.ndarray]:
        while n > 0:
            k, off = divmod(start, self.batch_ids)
            part = self._batch(k)[off : off + n]
            yield part
            start, n = start + len(part), n - len(part)

    def crc32(self, start: int, n: int) -> int:
        crc = 0
        for part in self.stretches(start, n):
            crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
        return crc


def token_id_output(docs: DataFrame, path: str, folder: str | None = None, **options) -> DataFrame:
    """Write the shards, then give doc_id, start, n_tokens, ids_crc32 as read back.

    Rows are in ascending order of doc_id, nulls first, equal ids by a hash of the text, so that
    an id with many rows spreads over shards; a null text counts as empty and has the end id
    alone. Repeated rows are rows, an empty table gives no rows, texts of any length are encoded
    whole, and other columns of docs, whatever their names, play no part.
    """
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "token-ids")
    totals = sorted((r.shard, r.n_ids) for r in write_shards(docs, path, folder, **options).collect())
    before, shards = 0, []
    for shard, n in totals:
        shards.append((shard, before))
        before += n
    return read_shards(spark, folder, shards)
