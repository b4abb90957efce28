"""What the operators share: input columns, byte-balanced chunks, the shared folder."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from runledger.session import scratch_path

CHUNK_BYTES = 1 << 20
#: Rows of an Arrow batch of texts.
ARROW_ROWS = 1000
#: Spaces of the word pattern ``[^\x20\x09-\x0D]+``; ``bytes.split()`` parts at the same six.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, in a session whose Arrow batches hold at most ``ARROW_ROWS`` rows.

    Whole texts are wide: at the default of 10,000 rows a batch takes tens of megabytes in
    the executor and again in its Python worker, and with long texts far more.
    """
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(name)) > ARROW_ROWS:
        conf.set(name, ARROW_ROWS)
    return docs


def shared_uri(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, with the scheme by which Spark finds it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, label))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def to_workers(spark: SparkSession, uri: str) -> str:
    """A name by which ``on_worker`` finds a written folder, whatever store it is in.

    Python workers open a mounted folder where it is; of any other Spark brings a copy to
    every executor.
    """
    if uri.startswith("file:"):
        return "/" + uri.removeprefix("file:").lstrip("/")
    spark.sparkContext.addFile(uri, recursive=True)
    return uri.rpartition("/")[2]


def on_worker(name: str) -> str:
    """The local path of a folder that went through ``to_workers``."""
    return name if name.startswith("/") else SparkFiles.get(name)


def per_process(name: str) -> dict:
    """A dict that all tasks of a Python worker share.

    Functions reach the workers by value, with globals of their own in every task, so a
    module's globals cannot keep a loaded tokenizer.
    """
    module = sys.modules.setdefault("runledger_worker", types.ModuleType("runledger_worker"))
    return module.__dict__.setdefault(name, {})


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def strings(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Whole texts of a batch; null counts as empty."""
    return [t or "" for t in column(batch, name).to_pylist()]


def chunks(texts: list[str], size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``size`` characters, one text at least."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > size:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    arrays = []
    for field in schema:
        values = columns[field.name]
        if isinstance(values, (pa.Array, pa.ChunkedArray)):
            arrays.append(values if values.type == field.type else values.cast(field.type))
        else:
            arrays.append(pa.array(values, type=field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All indexes of the given ranges, one range after the other."""
    lengths = np.asarray(lengths, dtype=np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, dtype=np.int64) - (ends - lengths), lengths)
