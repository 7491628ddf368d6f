"""Token ids as files of fixed-width packed bits.

An id takes the fewest bits that hold the vocabulary's largest one. Ids stand in
blocks of a fixed number, each from a byte's start on, low bits first; behind the
blocks come their offsets, where each document begins, and the documents' ids, and
at the end a trailer of fixed size, so a reader opens a file with one read and
unpacks any range of ids with a few numpy operations. Documents may cross blocks.

``write`` deals encoded documents into shards by ranges of doc_id, whose bounds are
quantiles of that column alone, so that no text is encoded for a sample; where one
id spans several quantiles, its rows are dealt over the shards between by their
text's hash. A task streams its rows in order into a file of its own. The list of
files is a table that Spark commits: files of lost or repeated attempts aren't in
it. ``read`` opens the listed files, a file a task at a time, and reads them in
stretches; a shard's place in the whole is the sum of the ids of those before it.

The folder is one that Arrow reaches (a shared mount, hdfs, s3, gs) and that all
executors share. Memory is bounded by a stretch of ids and a shard's index.

Edge cases: a null or empty text is a document with the end id alone; rows without
doc_id come first; rows that repeat an id are documents of their own, ordered by
their text's hash (rows alike in both stand together, in one file); texts of any
length are encoded whole; an empty table gives no files and an empty result;
further columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlume.llm.common import Scratch, map_texts, texts_of
from barlume.llm.vocabularies import byte_level

TOKENIZER = "byte_bpe_50k.json"
END = 2
#: Ids of a block; ids that are unpacked at once.
BLOCK, STRETCH = 1 << 16, 1 << 20
_MAGIC = b"packids1"
_TRAILER = struct.Struct("<IIQQQ8s")  # bits, block, ids, documents, blocks, magic


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def width(vocabulary: int) -> int:
    """The fewest bits that hold every id of a vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, low bits first, filled up to a byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    step = 1 << 13  # of a multiple of eight ids, whole bytes
    places = np.arange(bits, dtype=np.uint32)
    return b"".join(np.packbits((ids[i : i + step, None].astype(np.uint32) >> places & 1).astype(np.uint8), bitorder="little").tobytes() for i in range(0, len(ids), step))


def unpack(data: bytes | memoryview, bits: int, first: int, n: int) -> np.ndarray:
    """``n`` ids from the ``first`` one on, as unsigned 32-bit integers."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n, first * bits // 8).astype(np.uint32)
    at = np.arange(first, first + n, dtype=np.int64) * bits
    raw = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(5, np.uint8)))
    byte = at >> 3
    out = raw[byte].astype(np.uint64)
    for k in range(1, (bits + 14) // 8):
        out |= raw[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return (out >> (at & 7).astype(np.uint64) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class FileWriter:
    """Writes one file; documents are added in order."""

    def __init__(self, sink, bits: int, block: int = BLOCK) -> None:
        self.sink, self.bits, self.block = sink, bits, block
        self._held: list[np.ndarray] = []
        self._waiting = self.n_ids = 0
        self._offsets, self._starts, self._docs = [0], [0], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._held.append(ids)
        self._waiting += len(ids)
        self.n_ids += len(ids)
        self._docs.append(doc_id)
        self._starts.append(self.n_ids)
        if self._waiting >= max(self.block, STRETCH):
            self._flush(False)

    def _flush(self, all_of_it: bool) -> None:
        ids = np.concatenate(self._held) if self._held else np.zeros(0, np.uint32)
        stop = len(ids) if all_of_it else len(ids) // self.block * self.block
        for i in range(0, stop, self.block):
            packed = pack(ids[i : min(stop, i + self.block)], self.bits)
            self.sink.write(packed)
            self._offsets.append(self._offsets[-1] + len(packed))
        self._held, self._waiting = [ids[stop:]], len(ids) - stop

    def close(self) -> None:
        self._flush(True)
        null = np.array([d is None for d in self._docs], np.uint8)
        for part in (np.array(self._offsets, "<u8"), np.array(self._starts, "<u8"), np.array([d or 0 for d in self._docs], "<i8"), null):
            self.sink.write(part.tobytes())
        self.sink.write(_TRAILER.pack(self.bits, self.block, self.n_ids, len(self._docs), len(self._offsets) - 1, _MAGIC))
        self.sink.close()


class FileReader:
    """Random access to a file: ``tokens(a, b)``, ``document(i)``; ``stretches`` reads all in order."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        self.bits, self.block, self.n_ids, self.n_docs, n_blocks, magic = _TRAILER.unpack(self._at(size - _TRAILER.size, _TRAILER.size))
        if magic != _MAGIC:
            raise ValueError("not a file of packed ids")
        index = self._at(size - _TRAILER.size - 8 * (n_blocks + 1) - 8 * (self.n_docs + 1) - 9 * self.n_docs, 8 * (n_blocks + self.n_docs + 2) + 9 * self.n_docs)
        self.offsets = np.frombuffer(index, "<u8", n_blocks + 1).astype(np.int64)
        at = 8 * (n_blocks + 1)
        self.starts = np.frombuffer(index, "<u8", self.n_docs + 1, at).astype(np.int64)
        at += 8 * (self.n_docs + 1)
        self.doc_ids = np.frombuffer(index, "<i8", self.n_docs, at)
        self.null = np.frombuffer(index, np.uint8, self.n_docs, at + 8 * self.n_docs).astype(bool)

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` to ``stop`` of the file."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, (stop - 1) // self.block
        data = self._at(int(self.offsets[a]), int(self.offsets[b + 1] - self.offsets[a]))
        out = []
        for k in range(a, b + 1):
            low, high = max(start, k * self.block), min(stop, (k + 1) * self.block)
            piece = memoryview(data)[self.offsets[k] - self.offsets[a] : self.offsets[k + 1] - self.offsets[a]]
            out.append(unpack(piece, self.bits, low - k * self.block, high - low))
        return np.concatenate(out)

    def document(self, i: int) -> np.ndarray:
        return self.tokens(int(self.starts[i]), int(self.starts[i + 1]))

    def stretches(self, most: int = STRETCH) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first document, one past the last, their ids): whole documents, about ``most`` ids or one document at a time."""
        i = 0
        while i < self.n_docs:
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + most, "right")) - 1)
            yield i, j, self.tokens(int(self.starts[i]), int(self.starts[j]))
            i = j


@dataclass
class TokenFiles:
    """The written files: a table (shard, path, n_docs, n_ids), and how many there are."""

    files: DataFrame
    count: int


def _bounds(docs: DataFrame, shards: int) -> np.ndarray:
    """Quantiles of doc_id that part it into so many ranges; any bounds are right, these are even."""
    if shards < 2:
        return np.zeros(0, np.int64)
    found = docs.agg(F.percentile_approx("doc_id", [k / shards for k in range(1, shards)], 100 * shards)).first()[0]
    return np.array(sorted(found or []), np.int64)


def write(docs: DataFrame, scratch: Scratch, path: str | None = None, end: int = END, shards: int | None = None, block: int = BLOCK) -> TokenFiles:
    """Encode the whole texts of ``docs`` (doc_id, text) and write their ids, each document ended by ``end``, in ascending order of doc_id."""
    path = path or default_path()
    shards = shards or max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie"))
    bounds = _bounds(rows, shards)
    bits = width(max(len(byte_level(path, True).entries), end + 1))
    folder = f"{scratch.root}/ids"

    def make():
        encoder = byte_level(path, True)

        def work(chunk: pa.Table) -> pa.Table:
            flat, at = encoder.encode(texts_of(chunk.column("text")))
            n = np.diff(at) + 1
            ids = np.full(len(flat) + len(n), end, np.uint32)
            stops = np.cumsum(n)
            text = np.ones(len(ids), bool)
            text[stops - 1] = False
            ids[text] = flat
            packed = [pack(x, bits) for x in np.split(ids, stops[:-1])]
            doc = chunk.column("doc_id").combine_chunks()
            known = doc.is_valid().to_numpy(zero_copy_only=False)
            key = doc.fill_null(0).to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(bounds, key, "left"), np.searchsorted(bounds, key, "right")
            share = chunk.column("tie").to_numpy().astype(np.float64) / 2**64 + 0.5
            shard = np.where(known, low + np.minimum(((high - low + 1) * share).astype(np.int64), high - low), 0)
            return pa.table({"shard": pa.array(shard, pa.int32()), "doc_id": doc, "tie": chunk.column("tie"), "n": pa.array(n), "packed": pa.array(packed, pa.binary())})

        return work

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        writer, open_shard, at = None, None, ""

        def closed() -> pa.RecordBatch:
            writer.close()
            return pa.RecordBatch.from_pydict({"shard": pa.array([open_shard], pa.int32()), "path": [at], "n_docs": [len(writer._docs)], "n_ids": [writer.n_ids]})

        for batch in batches:
            for shard, doc, n, packed in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "n")), batch.column("packed"), strict=True):
                if shard != open_shard:
                    if writer:
                        yield closed()
                    open_shard, at = shard, f"{folder}/{shard:06d}-{TaskContext.get().taskAttemptId()}.ids"
                    writer = FileWriter(store.open_output_stream(f"{root}/{at.rpartition('/')[2]}"), bits, block)
                writer.add(doc, unpack(packed.as_buffer(), bits, 0, n))
        if writer:
            yield closed()

    coded = map_texts(rows, make, "shard int, doc_id long, tie long, n long, packed binary")
    dealt = coded.repartition(shards, "shard").sortWithinPartitions("shard", "doc_id", "tie")
    files = scratch.put(dealt.mapInArrow(store, "shard int, path string, n_docs long, n_ids long"), "files")
    return TokenFiles(files, files.count())


def read(written: TokenFiles) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, as the files have them."""
    # one row a file, so one task sums them up
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = written.files.select("path", before.alias("base")).repartition(max(1, written.count))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as source:
                    reader = FileReader(source)
                    for i, j, ids in reader.stretches():
                        starts = reader.starts[i : j + 1]
                        data, own = memoryview(ids.astype("<u4").tobytes()), (starts - starts[0]) * 4
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": pa.array(reader.doc_ids[i:j], pa.int64(), mask=reader.null[i:j]), "start": pa.array(starts[:-1] + base), "n_tokens": pa.array(np.diff(starts)),
                            "ids_crc32": pa.array([zlib.crc32(data[a:b]) for a, b in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)], pa.int64()),
                        })

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
