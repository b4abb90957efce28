"""Token ids in binary files of patched frame-of-reference blocks (operator 3).

A file holds the ids of consecutive documents, in blocks of ``BLOCK`` ids (the last may be
shorter, padded with its minimum). Of each block the minimum is subtracted; the rest is
packed at the width that ``FIT`` of its values fit; of the values that do not, the low bits
are packed too and place and high bits stand in the exception list behind the packed bits.
After the blocks stand, as plain little-endian arrays, the index of blocks (place, minimum,
width, number of exceptions) and that of documents (id, whether it is known, number of ids),
and last the counts of both and ``MAGIC``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.common import batch_of, chunks, column, small_batches, strings
from runledger.llm.tokens import ENCODED_CHARS, spaced_encoder
from runledger.session import scratch_path

MAGIC, BLOCK, FIT = b"PFOR0001", 256, 0.9
#: Bytes of one bit of all values of a block; a block's packed part holds these bit by bit.
PLANE = BLOCK // 8
FLUSH_IDS, READ_BLOCKS, DOC_ROWS = 1 << 20, 4096, 10_000
#: Bytes of packed ids from which on the documents that follow go to another file of the task.
FILE_BYTES = 16 << 20
TAIL, TAIL_BYTES = "<QQQ8s", 32

#: A file's folder tells its first document, its number within its task, and the counts of documents and ids.
NAMED = r"/file=(none|-?\d+)_(\d+)_(\d+)_(\d+)/[^/]*$"
WRITTEN = "file string, content binary"
READ_BACK = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def pack_blocks(ids: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Payloads, minima, widths and exception counts of an array of whole blocks."""
    rows = ids.reshape(-1, BLOCK).astype(np.uint32)
    low = rows.min(axis=1)
    rest = rows - low[:, None]
    rank = min(BLOCK - 1, int(np.ceil(FIT * BLOCK)) - 1)
    fitting = np.partition(rest, rank, axis=1)[:, rank]
    width = np.ceil(np.log2(fitting.astype(np.float64) + 1)).astype(np.uint8)
    over = rest >> np.minimum(width, 31)[:, None] if len(rows) else rest
    over[width >= 32] = 0
    spilled = (over > 0).sum(axis=1).astype(np.uint16)
    payloads: list[bytes] = [b""] * len(rows)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        values, packed = rest[at], np.zeros((len(at), w * PLANE), dtype=np.uint8)
        for b in range(w):
            if b % 8 == 0:
                octet = (values >> np.uint32(b)).astype(np.uint8)
            packed[:, b * PLANE : (b + 1) * PLANE] = np.packbits(octet & np.uint8(1 << b % 8), axis=1, bitorder="little")
        data = packed.tobytes()
        for k, i in enumerate(at.tolist()):
            payloads[i] = data[k * w * PLANE : (k + 1) * w * PLANE]
    for i in np.flatnonzero(spilled).tolist():
        places = np.flatnonzero(over[i])
        payloads[i] += places.astype("<u1").tobytes() + over[i][places].astype("<u4").tobytes()
    return payloads, low, width, spilled


def unpack_blocks(data: bytes, start: np.ndarray, low: np.ndarray, width: np.ndarray, spilled: np.ndarray) -> np.ndarray:
    """The ids of consecutive blocks; ``start`` counts from the first byte of ``data``."""
    raw = np.frombuffer(data, dtype=np.uint8)
    out = np.zeros((len(start), BLOCK), dtype=np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        at = np.flatnonzero(width == w)
        first = start[at].astype(np.int64)[:, None] + np.arange(PLANE)
        values = np.zeros((len(at), BLOCK), dtype=np.uint32)
        for low_bit in range(0, w, 8):
            octet = np.zeros((len(at), BLOCK), dtype=np.uint8)
            for b in range(low_bit, min(w, low_bit + 8)):
                octet |= np.unpackbits(raw[first + b * PLANE], axis=1, bitorder="little") << np.uint8(b - low_bit)
            values |= octet.astype(np.uint32) << np.uint32(low_bit)
        out[at] = values
    for i in np.flatnonzero(spilled).tolist():
        a, n, w = int(start[i]) + BLOCK * int(width[i]) // 8, int(spilled[i]), np.uint32(width[i])
        out[i, raw[a : a + n]] |= np.frombuffer(data, "<u4", n, a + n) << w
    return (out + low[:, None]).reshape(-1)


class Writer:
    """Streams ids to a URI or a stream; memory holds one flush of ids and the two indexes."""

    def __init__(self, target: str | pa.NativeFile):
        if isinstance(target, str):
            system, path = fs.FileSystem.from_uri(target)
            system.create_dir(path.rpartition("/")[0], recursive=True)
            target = system.open_output_stream(path)
        self._out = target
        self._held: list[bytes] = []
        self._held_ids = self._place = 0
        self._index: list[tuple[np.ndarray, ...]] = []
        self._docs: list[int | None] = []
        self._sizes: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self._docs.append(doc_id)
        self._sizes.append(len(ids) // 4)
        self._held.append(ids)
        self._held_ids += len(ids) // 4
        if self._held_ids >= FLUSH_IDS:
            self._flush(False)

    @property
    def n_packed(self) -> int:
        """Bytes of packed ids so far."""
        return self._place

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self._held), dtype="<u4")
        whole = len(ids) // BLOCK * BLOCK
        self._held, self._held_ids = [ids[whole:].tobytes()], len(ids) - whole
        if last and whole < len(ids):
            short = ids[whole:]
            ids = np.concatenate([ids, np.full(BLOCK - len(short), short.min(), dtype=np.uint32)])
            whole = len(ids)
        if not whole:
            return
        payloads, low, width, spilled = pack_blocks(ids[:whole])
        lengths = np.fromiter(map(len, payloads), dtype=np.uint64, count=len(payloads))
        place = np.cumsum(lengths) - lengths + np.uint64(self._place)
        self._index.append((place, low, width, spilled))
        self._out.write(b"".join(payloads))
        self._place += int(lengths.sum())

    def close(self) -> tuple[int, int, int]:
        """Number of documents, ids and bytes."""
        self._flush(True)
        n_blocks = sum(len(x[0]) for x in self._index)
        for k, kind in enumerate(("<u8", "<u4", "<u1", "<u2")):
            for part in self._index:
                self._out.write(part[k].astype(kind).tobytes())
        known = np.array([d is not None for d in self._docs], dtype="<u1")
        self._out.write(np.array([d or 0 for d in self._docs], dtype="<i8").tobytes())
        self._out.write(known.tobytes())
        self._out.write(np.array(self._sizes, dtype="<u8").tobytes())
        self._out.write(struct.pack(TAIL, self._place, n_blocks, len(self._docs), MAGIC))
        size = self._out.tell()
        self._out.close()
        return len(self._docs), sum(self._sizes), size


class Reader:
    """The documents of a file and their ids, a run of blocks at a time."""

    def __init__(self, source: str | pa.Buffer):
        if isinstance(source, str):
            system, path = fs.FileSystem.from_uri(source)
            self._in = system.open_input_file(path)
        else:
            self._in = pa.BufferReader(source)
        size = self._in.size()
        self._payload, n_blocks, n_docs, magic = struct.unpack(TAIL, self._in.read_at(TAIL_BYTES, size - TAIL_BYTES))
        if magic != MAGIC:
            raise ValueError(f"{source} is not a token file")
        at = self._payload

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            length = np.dtype(kind).itemsize * n
            at += length
            return np.frombuffer(self._in.read_at(length, at - length), dtype=kind)

        self._start, self._low, self._width, self._spilled = (take(k, n_blocks) for k in ("<u8", "<u4", "<u1", "<u2"))
        self.doc_ids, self.known, self.sizes = (take(k, n_docs) for k in ("<i8", "<u1", "<u8"))

    def blocks(self, first: int, last: int) -> np.ndarray:
        """The ids of blocks ``first`` to ``last``, exclusive, padding included."""
        start = int(self._start[first])
        end = int(self._start[last]) if last < len(self._start) else self._payload
        part = slice(first, last)
        data = self._in.read_at(end - start, start)
        return unpack_blocks(data, self._start[part] - np.uint64(start), self._low[part], self._width[part], self._spilled[part])

    def ids_of(self, index: int) -> np.ndarray:
        """The ids of one document, found by the block index."""
        first = int(self.sizes[:index].sum())
        last = first + int(self.sizes[index])
        if first == last:
            return np.zeros(0, dtype=np.uint32)
        a, b = first // BLOCK, -(-last // BLOCK)
        return self.blocks(a, b)[first - a * BLOCK : last - a * BLOCK]

    def documents(self) -> Iterator[tuple[int, int]]:
        """Index and crc32 of each document, in the order of the file."""
        ends = np.cumsum(self.sizes.astype(np.int64))
        held, base, block = np.zeros(0, dtype="<u4"), 0, 0
        for i, end in enumerate(ends.tolist()):
            at, crc = end - int(self.sizes[i]), 0
            while True:
                upto = min(end, base + len(held))
                if upto > at:
                    crc = zlib.crc32(held[at - base : upto - base].tobytes(), crc)
                    at = upto
                if at >= end:
                    break
                base += len(held)
                held = self.blocks(block, min(block + READ_BLOCKS, len(self._start))).astype("<u4", copy=False)
                block += READ_BLOCKS
            yield i, crc


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write the ids of all documents in ascending ``doc_id``; one manifest row per file.

    A range partition of ``doc_id`` becomes files of about ``FILE_BYTES`` in the shared folder.
    Spark writes and reads them, so any store that it reaches will do, and commits no file of
    a lost or doubled attempt. Its text writer adds ``MAGIC`` behind each file's one row of
    bytes. The manifest is read from the names; ``content`` is read only where it is used.
    Texts are read whole; a null text is empty (its end id only), a null ``doc_id`` comes
    first, equal ids follow the order of their texts. No documents, no files. Other columns
    are not read.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "token-files")
    schema = pa.schema([("file", pa.string()), ("content", pa.binary())])
    end = np.array([end_id], dtype="<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out, sink, name, number = spaced_encoder(tokenizer_path), None, None, "", 0

        def closed() -> pa.RecordBatch:
            n_docs, n_ids, n_bytes = out.close()
            content = sink.getvalue().slice(0, n_bytes - len(MAGIC))
            places = pa.py_buffer(np.array([0, len(content)], dtype=np.int32))
            return batch_of(schema, file=[f"{name}_{n_docs}_{n_ids}"], content=pa.Array.from_buffers(pa.binary(), 1, [None, places, content]))

        for batch in batches:
            texts, ids = strings(batch), column(batch, "doc_id").to_pylist()
            for a, b in chunks(texts, ENCODED_CHARS):
                for doc_id, found in zip(ids[a:b], encode(texts[a:b]), strict=True):
                    if out is None:
                        sink, name = pa.BufferOutputStream(), f"{'none' if doc_id is None else doc_id}_{number}"
                        out = Writer(sink)
                    out.add(doc_id, found + end)
                    if out.n_packed >= FILE_BYTES:
                        yield closed()
                        out, number = None, number + 1
        if out is not None:
            yield closed()

    ordered = small_batches(docs).select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = ordered.mapInArrow(write, WRITTEN).select("file", F.col("content").cast("string").alias("value"))
    files.write.partitionBy("file").option("lineSep", MAGIC.decode()).option("compression", "none").text(folder)
    first, number, n_docs, n_ids = (F.regexp_extract("path", NAMED, i) for i in (1, 2, 3, 4))
    return spark.read.format("binaryFile").load(folder).select(
        "path",
        F.when(first != "none", first).cast("bigint").alias("first_doc"),
        number.cast("bigint").alias("number"),
        n_docs.cast("bigint").alias("n_docs"),
        n_ids.cast("bigint").alias("n_ids"),
        F.col("length").alias("n_bytes"),
        "content",
    )


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Read files back: ``doc_id, start, n_tokens, ids_crc32`` per document.

    ``start`` counts the ids of all documents before it. The window that adds up the files
    has one row per file, as has the side of the join that is sent to every task.
    """
    before = Window.orderBy(F.col("first_doc").asc_nulls_first(), "number").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, base in zip(column(batch, "content"), column(batch, "base").to_pylist(), strict=True):
                file = Reader(content.as_buffer())
                sizes = file.sizes.astype(np.int64)
                starts, crcs = np.cumsum(sizes) - sizes + base, []
                for i, crc in file.documents():
                    crcs.append(crc)
                    if len(crcs) == DOC_ROWS or i == len(sizes) - 1:
                        part = slice(i + 1 - len(crcs), i + 1)
                        yield batch_of(
                            schema,
                            doc_id=pa.array(file.doc_ids[part], mask=file.known[part] == 0),
                            start=starts[part],
                            n_tokens=sizes[part],
                            ids_crc32=crcs,
                        )
                        crcs = []

    files = manifest.select("path", "content").join(F.broadcast(placed), "path").select("base", "content")
    return files.mapInArrow(read, READ_BACK)
