"""Operators whose files Python workers make or read, with shared folders that only Spark can open."""

import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest

from runledger import session
from runledger.llm import token_file, tokens, toxicity

WORD = public_tokenizers.path("word_bpe_49k.json")
DOC = "doc_id long, text string"


@pytest.fixture(params=["spark only", "no scheme"])
def store(request, spark, tmp_path, monkeypatch):
    """The shared folder in a file system that Arrow does not know, and as a plain path on a cluster."""
    name, hadoop = f"runs{uuid.uuid4().hex}", spark._jsc.hadoopConfiguration()  # its mounts are kept by name
    link = f"fs.viewfs.mounttable.{name}.link./shared"
    if request.param == "spark only":
        hadoop.set(link, f"file://{tmp_path}")
        monkeypatch.setattr(session, "shared_dir", lambda spark: f"viewfs://{name}/shared")
    else:
        monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
        monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path))
    yield tmp_path
    hadoop.unset(link)


def read_back(docs, end_id):
    """What ``op3`` returns, by the library."""
    start, want = 0, []
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or "")):
        ids = np.array([*tokens.tokenizer(WORD).encode(text or "", add_special_tokens=False).ids, end_id], dtype="<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return want


def test_token_files(spark, store):
    docs = [(None, "no id"), (-3, None), *((i, f"text {i} of many " * (i % 5)) for i in range(60))]
    manifest = token_file.write_token_files(spark.createDataFrame(docs, DOC).repartition(4), WORD, 2)
    assert sorted((tuple(r) for r in token_file.read_token_files(manifest).collect()), key=lambda r: r[1]) == read_back(docs, 2)
    files = manifest.collect()
    found = list(store.glob("token-files-*/*/part-*"))
    assert sum(f.n_docs for f in files) == len(docs) and len(found) == len(files)
    for path in found:  # they stand there in the format of the module
        reader = token_file.Reader(f"file://{path}")
        assert (len(reader.sizes), int(reader.sizes.sum()), path.stat().st_size) in [(f.n_docs, f.n_ids, f.n_bytes) for f in files]


def test_an_id_with_many_rows_becomes_several_files(spark, monkeypatch):
    monkeypatch.setattr(token_file, "FILE_BYTES", 1)
    docs = [(7, f"{i} " + "lo ra " * 110_000) for i in range(10)] + [(None, "x"), (8, "y")]
    manifest = token_file.write_token_files(spark.createDataFrame(docs, DOC), WORD, 2)
    assert manifest.filter("n_docs > 0").count() > spark.createDataFrame(docs, DOC).repartitionByRange("doc_id").rdd.getNumPartitions()
    got = token_file.read_token_files(manifest).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == read_back(docs, 2)


def test_toxicity(spark, store):
    docs = [(i, f"krazok lo{i % 3} ba" if i % 3 == 0 else f"sha{i % 5} ne lo") for i in range(120)]
    df, marks = spark.createDataFrame(docs, DOC), spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in docs], "doc_id long, toxic int")
    rows = toxicity.toxicity(df, marks).collect()
    assert {r.doc_id: r.predicted for r in rows} == {i: int(i % 3 == 0) for i, _ in docs}
    assert list(store.glob("toxicity-model-*/part=0/*.parquet"))
