"""Run journal as a Spark data source that keeps the order of appends.

A journal is a folder of line files and manifests. The tasks of an append write files of
their own; the commit then shows them all at once by one manifest, which carries the
number of the append and names the files in the order of their partitions. A reader looks
at manifests only, so the files of tasks that failed, ran twice or were aborted are never
seen. Lines are ordered by ``(append, part, line_no)`` over all appends, and no record
needs a sequence number of its own. One writer at a time appends, as with a single file;
should two meet, both appends stay, in the order of their manifests' names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from runledger.sources import journal

FORMAT = "runledger_journal"
LINES = "append BIGINT, part INT, line_no BIGINT, line STRING"
PLACE = ["append", "part", "line_no"]
MANIFESTS, FILES = "manifests", "lines"
#: Lines of one Arrow batch, and bytes that are held while a file is read.
BATCH_LINES, READ_BYTES = 10_000, 4 << 20


def folder_of(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "file:///" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def manifests(path: str, after: int = 0, upto: int | None = None) -> list[tuple[int, dict]]:
    """Number and content of every append after ``after`` and up to ``upto``, in order."""
    system, folder = folder_of(path)
    infos = system.get_file_info(fs.FileSelector(f"{folder}/{MANIFESTS}", allow_not_found=True))
    found = []
    for name in sorted(i.base_name for i in infos if i.base_name.endswith(".json")):
        number = int(name.split("-")[0])
        if number > after and (upto is None or number <= upto):
            with system.open_input_stream(f"{folder}/{MANIFESTS}/{name}") as data:
                found.append((number, json.loads(data.read())))
    return found


@dataclass
class Written(WriterCommitMessage):
    part: int
    file: str
    lines: int


class JournalWriter(DataSourceArrowWriter):
    """One file per task; ``commit`` numbers the append and shows its files."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, folder = folder_of(self.path)
        part, name, lines, out = TaskContext.get().partitionId(), f"{uuid.uuid4().hex}.jsonl", 0, None
        for batch in iterator:
            rows = batch.column(batch.schema.get_field_index("line")).to_pylist()
            if rows and out is None:
                system.create_dir(f"{folder}/{FILES}", recursive=True)
                out = system.open_output_stream(f"{folder}/{FILES}/{name}")
            if rows:
                out.write("".join(f"{row}\n" for row in rows).encode())
                lines += len(rows)
        if out is not None:
            out.close()
        return Written(part, name, lines)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = folder_of(self.path)
        files = sorted((m.part, m.file, m.lines) for m in messages if m is not None and m.lines)
        known = manifests(self.path)
        number = known[-1][0] + 1 if known else 1
        name = f"{number:012d}-{uuid.uuid4().hex}"
        system.create_dir(f"{folder}/{MANIFESTS}", recursive=True)
        with system.open_output_stream(f"{folder}/{MANIFESTS}/{name}.tmp") as out:
            out.write(json.dumps({"files": [{"part": p, "file": f, "lines": n} for p, f, n in files]}).encode())
        system.move(f"{folder}/{MANIFESTS}/{name}.tmp", f"{folder}/{MANIFESTS}/{name}.json")

    def abort(self, messages: list[Written | None]) -> None:
        """Remove what finished tasks wrote; what others left stays unseen."""
        system, folder = folder_of(self.path)
        for m in messages:
            if m is not None and m.lines:
                system.delete_file(f"{folder}/{FILES}/{m.file}")


class LineFile(InputPartition):
    def __init__(self, append: int, part: int, file: str) -> None:
        self.append, self.part, self.file = append, part, file


def line_files(path: str, after: int = 0, upto: int | None = None) -> list[LineFile]:
    return [LineFile(n, f["part"], f["file"]) for n, content in manifests(path, after, upto) for f in content["files"]]


def read_lines(path: str, part: LineFile) -> Iterator[pa.RecordBatch]:
    """The lines of one file, a bounded piece at a time."""
    system, folder = folder_of(path)
    schema = pa.schema([("append", pa.int64()), ("part", pa.int32()), ("line_no", pa.int64()), ("line", pa.string())])

    def batch(rows: list[bytes], first: int) -> pa.RecordBatch:
        n = len(rows)
        columns = [pa.array([part.append] * n, pa.int64()), pa.array([part.part] * n, pa.int32()), pa.array(range(first, first + n), pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, pa.array([r.decode("utf-8", "replace") for r in rows], pa.string())], schema=schema)

    with system.open_input_stream(f"{folder}/{FILES}/{part.file}") as data:
        held, number = b"", 0
        while piece := data.read(READ_BYTES):
            *rows, held = (held + piece).split(b"\n")
            for at in range(0, len(rows), BATCH_LINES):
                some = rows[at : at + BATCH_LINES]
                yield batch(some, number)
                number += len(some)
        if held:
            yield batch([held], number)


class JournalReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return line_files(self.path) or [LineFile(0, 0, "")]  # Spark wants one at least

    def read(self, partition: LineFile) -> Iterator[pa.RecordBatch]:
        return read_lines(self.path, partition) if partition.file else iter(())


class JournalStreamReader(DataSourceStreamReader):
    """Offsets are numbers of appends: a micro-batch holds whole appends."""

    def __init__(self, path: str) -> None:
        self.path = path

    def initialOffset(self) -> dict:
        return {"append": 0}

    def latestOffset(self) -> dict:
        known = manifests(self.path)
        return {"append": known[-1][0] if known else 0}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return line_files(self.path, start["append"], end["append"])

    def read(self, partition: LineFile) -> Iterator[pa.RecordBatch]:
        return read_lines(self.path, partition)

    def commit(self, end: dict) -> None:
        """Appends are never removed."""


class JournalSource(DataSource):
    """``format("runledger_journal").option("path", ...)``; written rows have one column, ``line``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> DataSourceReader:
        return JournalReader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return JournalStreamReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("a journal is only appended to")
        return JournalWriter(self.options["path"])


def append(records: DataFrame, path: str) -> None:
    """Append records in their order: by partition, and as they stand inside each.

    Sort them first if one append is to have an order of its own.
    """
    records.sparkSession.dataSource.register(JournalSource)
    lines = records.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("line"))
    lines.write.format(FORMAT).mode("append").option("path", path).save()


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their place in the journal."""
    spark.dataSource.register(JournalSource)
    return spark.read.format(FORMAT).option("path", path).load()


def read(spark: SparkSession, path: str, on_corrupt: str = "fail") -> DataFrame:
    """Typed records with ``append, part, line_no``, in the way of ``journal.read_journal``.

    Blank lines are skipped, the last line of the whole journal is dropped if it does not
    parse, and any other bad line fails the read or, with ``report``, comes back alone. The
    last place is one row, found by a partial maximum per task.
    """
    lines = scan(spark, path)
    place = F.struct(*PLACE)
    last = lines.agg(F.max(place).alias("last"))
    marked = (
        lines.filter(F.trim("line") != "")
        .withColumn("r", journal.parsed(F.col("line")))
        .withColumn("ok", journal.is_good(F.col("r")))
        .join(F.broadcast(last))
        .filter(F.col("ok") | (place != F.col("last")))
        .drop("last")
    )
    if on_corrupt == "report":
        return marked.filter(~F.col("ok")).drop("ok", "r")
    where = F.concat(F.lit("journal is corrupt at append "), F.col("append").cast("string"), F.lit(", part "), F.col("part").cast("string"), F.lit(", line "), F.col("line_no").cast("string"))
    return journal.typed(marked.withColumn("r", F.when(F.col("ok"), F.col("r")).otherwise(F.raise_error(where))).drop("ok"))


def tail(spark: SparkSession, path: str) -> DataFrame:
    """The good records of the journal as a stream, whole appends at a time, with their place."""
    spark.dataSource.register(JournalSource)
    lines = spark.readStream.format(FORMAT).option("path", path).load()
    return journal.typed(lines.withColumn("r", journal.parsed(F.col("line"))).filter(journal.is_good(F.col("r"))))
