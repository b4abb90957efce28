"""The ordered journal: order over appends, failed tasks, torn and bad lines, streams."""

import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from runledger.session import scratch_path
from runledger.sources import ordered_journal as oj
from runledger.streaming import processors


@pytest.fixture
def path(spark):
    return scratch_path(spark, "ordered-journal")


def finished(spark, ids):
    return spark.createDataFrame([("job_finished", str(i)) for i in ids], "record STRING, job_id STRING").coalesce(1)


def in_order(df):
    return [r.job_id for r in df.orderBy(*oj.PLACE).collect()]


def test_order_over_appends(spark, path):
    """Records without a sequence number come back as they were appended, partition by partition."""
    due = []
    for k in range(3):
        ids = [f"{k}-{i}" for i in range(40)]
        many = spark.createDataFrame([("job_finished", x, i) for i, x in enumerate(ids)], "record STRING, job_id STRING, i INT").repartitionByRange(4, "i").sortWithinPartitions("i")
        oj.append(many.drop("i"), path)
        due += ids
    assert in_order(oj.read(spark, path)) == due
    assert [n for n, _ in oj.manifests(path)] == [1, 2, 3]


def test_failed_append_is_unseen(spark, path):
    oj.append(finished(spark, [1, 2]), path)
    bad = spark.range(40).repartition(4).select(
        F.lit("job_finished").alias("record"),
        F.when(F.col("id") == 33, F.raise_error(F.lit("lost"))).otherwise(F.col("id").cast("string")).alias("job_id"),
    )
    with pytest.raises(Exception, match="lost"):
        oj.append(bad, path)
    assert in_order(oj.read(spark, path)) == ["1", "2"]
    oj.append(finished(spark, [3]), path)
    assert in_order(oj.read(spark, path)) == ["1", "2", "3"]


def test_left_over_files_are_unseen(spark, path):
    oj.append(finished(spark, [1]), path)
    with open(f"{path.removeprefix('file:')}/{oj.FILES}/left-over.jsonl", "w") as out:
        out.write('{"record": "job_finished", "job_id": "ghost"}\n')
    assert in_order(oj.read(spark, path)) == ["1"]


def _append_text(spark, path, *lines):
    spark.dataSource.register(oj.JournalSource)
    text = spark.createDataFrame([(x,) for x in lines], "line STRING").coalesce(1)
    text.write.format(oj.FORMAT).mode("append").option("path", path).save()


def test_torn_and_bad_lines(spark, path):
    good = '{"record": "job_finished", "job_id": "1"}'
    _append_text(spark, path, good, "", good)
    _append_text(spark, path, good, good[:20])
    assert oj.read(spark, path).count() == 3
    _append_text(spark, path, good)
    with pytest.raises(Exception, match="corrupt at append 2"):
        oj.read(spark, path).collect()
    assert [(r.append, r.line_no) for r in oj.read(spark, path, "report").collect()] == [(2, 1)]


def test_empty(spark, path):
    assert oj.read(spark, path).count() == 0
    oj.append(finished(spark, [1]).filter("false"), path)
    assert oj.read(spark, path).count() == 0
    with pytest.raises(Exception, match="only appended"):
        finished(spark, [1]).select(F.lit("x").alias("line")).write.format(oj.FORMAT).mode("overwrite").option("path", path).save()


def test_stream_goes_on_where_it_ended(spark, path):
    out, checkpoint = f"{path}-out", f"{path}-checkpoint"

    def run():
        stream = oj.tail(spark, path).select("append", "job_id").writeStream.format("parquet").option("path", out)
        stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return rows(spark.read.parquet(out))

    oj.append(finished(spark, [1, 2]), path)
    assert run() == [(1, "1"), (1, "2")]
    oj.append(finished(spark, [3]), path)
    oj.append(finished(spark, [4]), path)
    assert run() == [(1, "1"), (1, "2"), (2, "3"), (3, "4")]
    assert processors.drain(oj.tail(spark, path).select("job_id"), "tail").count() == 4


def test_long_lines_and_pieces(spark, path, monkeypatch):
    long = "x" * 3_000
    _append_text(spark, path, *[f'{{"record": "job_finished", "job_id": "{i}", "reason": "{long}"}}' for i in range(50)])
    part = oj.line_files(path)[0]
    whole = [r for b in oj.read_lines(path, part) for r in b.column(3).to_pylist()]
    monkeypatch.setattr(oj, "READ_BYTES", 1_000)
    assert [r for b in oj.read_lines(path, part) for r in b.column(3).to_pylist()] == whole and len(whole) == 50
    assert os.path.isdir(path.removeprefix("file:"))
