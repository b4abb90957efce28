"""Operator 12 against a plain Kneser-Ney model, and on held-out rows."""

import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from brute import KneserNey
from pyspark.sql import functions as F

from runledger.llm import queries, toxicity

SF = os.environ.get("TEST_SF_BIG", "/root/testdata/sf0.1")
DOC, LABEL = "doc_id long, text string", "doc_id long, quality int, toxic int"


def corpus(seed, n, toxic_share=0.3):
    """Documents of made-up words, and rude ones with a few words of their own."""
    rng = random.Random(seed)
    plain = ["".join(rng.choice(["ba", "ne", "lo", "ti", "ru", "sha", "ü"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    rude = ["krazok", "zokkra", "grokzit"]
    docs, labels = [], []
    for i in range(n):
        words, toxic = [rng.choice(plain) for _ in range(rng.randint(20, 120))], int(rng.random() < toxic_share)
        for _ in range(3 * toxic):
            words.insert(rng.randint(0, len(words)), rng.choice(rude) + rng.choice(["", "s", "ba"]))
        docs.append((i, " ".join(words)))
        if rng.random() < 0.7:
            labels.append((i, None, toxic))
    return docs, labels


def test_ratios_equal_the_plain_model(spark):
    docs, labels = corpus(1, 120)
    toxic = {d: t for d, _, t in labels}
    crc = {d: zlib.crc32(str(d).encode()) for d, _ in docs}
    learned = [(t, toxic[d]) for d, t in docs if d in toxic and crc[d] % 4 != 2 and crc[d] // 4 % toxicity.FOLD != 0]
    plain = KneserNey(learned)
    marked = toxicity.held_out(spark.createDataFrame(docs, DOC))
    model = toxicity.train(marked, spark.createDataFrame(labels, LABEL))
    texts = [docs[0][1], docs[5][1], "krazok unseenword 漢字", "", "é " * 3]
    sums, counts = model.evidence(texts, {})
    assert np.allclose(sums, [plain.ratio(t) for t in texts], atol=1e-9)
    assert counts.tolist() == [len(plain.words(t)) for t in texts]


def test_parts_do_not_change_results(spark, monkeypatch):
    docs, labels = corpus(2, 100)
    marked, marks = toxicity.held_out(spark.createDataFrame(docs, DOC)), spark.createDataFrame(labels, LABEL)
    one = toxicity.train(marked, marks)
    monkeypatch.setattr(toxicity, "PART_ENTRIES", 300)
    many = toxicity.train(marked, marks)
    assert one.parts == 1 and many.parts > 3
    texts = [t for _, t in docs] + ["unseen wörds 漢字"]
    assert np.allclose(one.evidence(texts, {})[0], many.evidence(texts, {})[0], atol=1e-9)


def test_odd_rows(spark):
    docs, labels = corpus(3, 300)
    odd = [(None, "krazok krazoks zokkra"), (None, None), (900, None), (901, ""), (902, "12 !!"), (903, "lo " * 200_000), (904, docs[0][1]), (904, docs[0][1])]
    marks = [*labels, (900, None, 1), (901, None, None), (1, None, None), (5000, 1, 1), (None, 1, 1)]
    df = spark.createDataFrame(docs + odd, DOC).select("*", *[F.lit(1).alias(n) for n in ("toxic", "score", "fold", "gram", "held_out")])
    rows = toxicity.toxicity(df, spark.createDataFrame(marks, LABEL)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((d is None, d or 0) for d, _ in docs + odd)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    truth = {d: "kra" in t or "grok" in t for d, t in docs}
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([bool(p) == t for p, t in held]) > 0.95
    empty = [r.score for r in rows if r.doc_id in (900, 901, 902)]
    assert len(set(empty)) == 1


def test_one_class_or_nothing(spark):
    docs, labels = corpus(4, 40)
    df = spark.createDataFrame(docs, DOC)
    for marks, share in (([], 0.0), ([(d, 1, 0) for d, _, _ in labels], 0.0), ([(d, 1, 1) for d, _, _ in labels], 1.0)):
        rows = toxicity.toxicity(df, spark.createDataFrame(marks, LABEL)).collect()
        assert {r.score for r in rows} == {share}
    assert toxicity.toxicity(df.filter("false"), spark.createDataFrame(labels, LABEL)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_held_out_rows(spark):
    """English rows: in the other languages of this table the labelled texts have no words of their own."""
    names = {n: f"{SF}/{n}.parquet" + ("/*.parquet" if os.path.isdir(f"{SF}/{n}.parquet") else "") for n in ("documents", "labels")}
    toxic = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{names['labels']}' JOIN '{names['documents']}' USING (doc_id) WHERE lang = 'en'").fetchall())
    rows = queries.op12_toxicity(spark, SF).collect()
    held = [(r.predicted, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic]
    hits = sum(p and t for p, t in held)
    assert hits >= 0.85 * sum(t for _, t in held) and hits >= 0.9 * sum(p for p, _ in held)
