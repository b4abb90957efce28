"""Exact deduplication through an extendible-hash index in shared files (operator 5)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.common import batch_of, column, small_batches
from runledger.session import cut

#: A bucket above this many bytes of text is split; the directory has 2^MAX_DEPTH cells at most.
BUCKET_BYTES, MAX_DEPTH = 8 << 20, 16
#: Texts that a task holds while it joins equal ones before the shuffle.
COLLAPSE_BYTES = 16 << 20

KEYS = "doc_id bigint, hash_key bigint, text_sha256 binary, n_bytes bigint"
ENTRIES = "bucket bigint, hash_key bigint, body binary, text_sha256 binary, keep_id bigint, group_size bigint"
INDEX = "bucket bigint, hash_key bigint, chain int, text_sha256 binary, keep_id bigint, group_size bigint, n_bytes bigint"


def normalised(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased; ``bytes.lower`` leaves all other bytes alone."""
    return (text or "").encode().lower()


def key_of(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def cell_of(keys: np.ndarray, depth: int) -> np.ndarray:
    """The highest ``depth`` bits of signed 64-bit keys."""
    return (keys.astype(np.int64).view(np.uint64) >> np.uint64(64 - depth)).astype(np.int64) if depth else np.zeros(len(keys), dtype=np.int64)


def larger(a: int | None, b: int | None) -> int | None:
    return a if b is None or (a is not None and a >= b) else b


def directory_of(cells: dict[int, int], capacity: int, max_depth: int) -> tuple[int, list[int]]:
    """Directory (global depth, bucket of each slot) over loads of cells of ``max_depth`` bits.

    It starts with one bucket. The overfull bucket is split on its next bit; when the bucket
    is as deep as the directory, the directory doubles first. Buckets come out numbered in
    the order of their keys.
    """
    loads = np.zeros(1 << max_depth, dtype=np.int64)
    for cell, load in cells.items():
        loads[cell] = load
    total = np.concatenate([[0], np.cumsum(loads)])
    depth, slots = 0, [(0, 0)]  # of each slot: (prefix, local depth) of its bucket
    waiting = [(0, 0)]
    while waiting:
        prefix, local = waiting.pop()
        width = max_depth - local
        if local == max_depth or total[(prefix + 1) << width] - total[prefix << width] <= capacity:
            continue
        if local == depth:
            slots = [s for s in slots for _ in range(2)]
            depth += 1
        span = 1 << (depth - local - 1)
        first = prefix << (depth - local)
        halves = [(2 * prefix, local + 1), (2 * prefix + 1, local + 1)]
        slots[first : first + 2 * span] = [halves[0]] * span + [halves[1]] * span
        waiting += halves
    numbers: dict[tuple[int, int], int] = {}
    return depth, [numbers.setdefault(s, len(numbers)) for s in slots]


def text_keys(docs: DataFrame) -> DataFrame:
    """``doc_id, hash_key, text_sha256, n_bytes`` of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("hash_key", pa.int64()), ("text_sha256", pa.binary()), ("n_bytes", pa.int64())])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [normalised(t) for t in column(batch, "text").to_pylist()]
            digests = [hashlib.sha256(b).digest() for b in bodies]
            yield batch_of(
                schema,
                doc_id=column(batch, "doc_id"),
                hash_key=[key_of(d) for d in digests],
                text_sha256=digests,
                n_bytes=[len(b) for b in bodies],
            )

    return small_batches(docs).select("doc_id", "text").mapInArrow(keys, KEYS)


def entries(docs: DataFrame, depth: int, directory: list[int]) -> DataFrame:
    """One row per different text of a task: bucket, key, text, largest ``doc_id``, rows.

    Copies join within ``COLLAPSE_BYTES`` of a task's texts, so a text that a third of all
    documents hold reaches its owner a few times only.
    """
    schema = pa.schema(
        [("bucket", pa.int64()), ("hash_key", pa.int64()), ("body", pa.binary()), ("text_sha256", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())]
    )
    slots = np.array(directory, dtype=np.int64)

    def flush(held: dict[bytes, list]) -> pa.RecordBatch:
        digests = [hashlib.sha256(b).digest() for b in held]
        keys = np.array([key_of(d) for d in digests], dtype=np.int64)
        return batch_of(
            schema,
            bucket=slots[cell_of(keys, depth)],
            hash_key=keys,
            body=list(held),
            text_sha256=digests,
            keep_id=[v[0] for v in held.values()],
            group_size=[v[1] for v in held.values()],
        )

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size = 0
        for batch in batches:
            for doc_id, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "text").to_pylist(), strict=True):
                body = normalised(text)
                if body in held:
                    found = held[body]
                    found[0], found[1] = larger(found[0], doc_id), found[1] + 1
                else:
                    held[body] = [doc_id, 1]
                    size += len(body)
                    if size > COLLAPSE_BYTES:
                        yield flush(held)
                        held, size = {}, 0
        if held:
            yield flush(held)

    return small_batches(docs).select("doc_id", "text").mapInArrow(collapse, ENTRIES)


def owned(rows: DataFrame) -> DataFrame:
    """Owner tasks: chains of different texts with one key, told apart by their bytes.

    Rows come sorted by bucket and key; a task holds the chain of one key only.
    """
    names = [f.split()[0] for f in INDEX.split(", ")]
    schema = pa.schema(
        [("bucket", pa.int64()), ("hash_key", pa.int64()), ("chain", pa.int32()), ("text_sha256", pa.binary())]
        + [("keep_id", pa.int64()), ("group_size", pa.int64()), ("n_bytes", pa.int64())]
    )

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        chain: list[list] = []  # [text, sha256, keep_id, rows]
        out: list[tuple] = []

        def close() -> None:
            if len({c[1] for c in chain}) < len(chain):
                raise ValueError("two different texts have one SHA-256")
            out.extend((*at, n, c[1], c[2], c[3], len(c[0])) for n, c in enumerate(chain))

        for batch in batches:
            columns = [column(batch, n) for n in ("bucket", "hash_key", "body", "text_sha256", "keep_id", "group_size")]
            for bucket, key, body, digest, keep_id, rows in zip(*(c.to_pylist() for c in columns), strict=True):
                if (bucket, key) != at:
                    if at is not None:
                        close()
                    at, chain = (bucket, key), []
                for link in chain:
                    if link[0] == body:
                        link[2], link[3] = larger(link[2], keep_id), link[3] + rows
                        break
                else:
                    chain.append([body, digest, keep_id, rows])
            if out:
                yield batch_of(schema, **dict(zip(names, map(list, zip(*out, strict=True)), strict=True)))
                out = []
        if at is not None:
            close()
            yield batch_of(schema, **dict(zip(names, map(list, zip(*out, strict=True)), strict=True)))

    return rows.repartition("bucket").sortWithinPartitions("bucket", "hash_key").mapInArrow(chained, INDEX)


def hash_index(docs: DataFrame, keys: DataFrame, bucket_bytes: int = BUCKET_BYTES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The index files of ``docs``, written to the shared folder and read back.

    ``bucket, hash_key, chain, text_sha256, keep_id, group_size, n_bytes``, one row per
    different text. The directory is built from the loads of at most ``2**max_depth`` cells.
    """
    cells = (
        keys.groupBy(F.shiftrightunsigned("hash_key", 64 - max_depth).alias("cell")).agg(F.sum("n_bytes").alias("load")).collect()
    )
    depth, directory = directory_of({r["cell"]: r["load"] for r in cells}, bucket_bytes, max_depth)
    return cut(owned(entries(docs, depth, directory)), "hash-index")


def exact_groups(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Groups of equal texts (operator 5), one row per document, dropped ones too.

    ``doc_id, keep_id, group_size, kept, text_sha256``: texts are equal when identical after
    lower-casing A-Z only; the row with the largest ``doc_id`` stays. A null text counts as
    empty, a null ``doc_id`` as smaller than any other (it stays only where all are null).
    Rows that repeat a ``doc_id`` with an equal text each count and carry the same verdict.
    No documents, no rows. Other columns are not read.
    """
    keys = cut(text_keys(docs), "text-keys")
    index = hash_index(docs, keys, bucket_bytes, max_depth)
    return keys.join(index.select("hash_key", "text_sha256", "keep_id", "group_size"), ["hash_key", "text_sha256"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("text_sha256")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one per group of equal texts, with all their columns.

    Of rows that repeat a ``doc_id`` with an equal text one stays.
    """
    groups = exact_groups(docs).filter("kept").select(F.col("doc_id").alias("__kept_id"), F.unhex("text_sha256").alias("__kept_sha")).distinct()
    names = docs.columns
    body = F.translate(F.coalesce(F.col("text"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    marked = docs.withColumn("__text_sha", F.unhex(F.sha2(body, 256)))
    left = marked.join(groups, F.col("doc_id").eqNullSafe(F.col("__kept_id")) & (F.col("__text_sha") == F.col("__kept_sha")), "left_semi")
    first = Window.partitionBy("doc_id", "__text_sha").orderBy(F.xxhash64(*[F.col(n).cast("string") for n in names]))
    return left.withColumn("__copy_no", F.row_number().over(first)).filter("__copy_no = 1").select(*names)
