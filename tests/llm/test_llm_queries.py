"""The numbered queries on the given tables, against their SQL or brute force."""

import os
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from brute import fingerprint, ids_of, linked, packing_is_valid, pieces, similar_roots
from tokenizers import Tokenizer

import corpus_pipeline
from runledger.llm import contamination, exact, language, queries, sql
from runledger.llm.common import documents

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def docs(duck):
    return duck.execute("SELECT doc_id, text, lang FROM documents ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", list(sql.SQL))
def test_query_matches_sql(spark, duck, name):
    found = duck.execute(sql.SQL[name])
    names = [d[0] for d in found.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(r) for r in df.select(*names).collect()) == sorted(found.fetchall())


def test_token_files(spark, docs):
    tokenizer, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for d, t, _ in docs:
        ids = ids_of(tokenizer, t, 2)
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in queries.op3_token_files(spark, SF).collect()) == want


def test_held_out_accuracy(spark, docs):
    lang = {d: x for d, _, x in docs}
    got = queries.op7_language_id(spark, SF).collect()
    assert {r.doc_id for r in got if r.held_out} == {d for d in lang if zlib.crc32(str(d).encode()) % 4 == 2}
    held = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out and lang[r.doc_id]]
    assert np.mean(held) >= 0.97


def test_packing(spark, docs):
    got = queries.op8_best_fit_packing(spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == pieces(public_tokenizers.path("word_bpe_49k.json"), [d[:2] for d in docs])
    assert packing_is_valid(got) <= -(-sum(r.length for r in got) // 2048) + 1


def test_token_counts(spark, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op9_token_counts(spark, SF).collect()}
    for d, t, _ in docs:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        assert got[d] == (len((t or "").encode()), n, n > 512)


def test_simhash(spark, docs):
    prints = [fingerprint(t) for _, t, _ in docs]
    want = [(d, format(p, "016x"), docs[root][0]) for (d, _, _), p, root in zip(docs, prints, linked(prints))]
    assert sorted(tuple(r) for r in queries.op10_simhash_groups(spark, SF).collect()) == want


def test_pipeline_against_brute_force(spark, docs, duck):
    left = {d: t for d, t, _ in docs if language.has_letter(t)}
    keep = {}
    for d, t in left.items():
        keep[exact.normalised(t)] = max(d, keep.get(exact.normalised(t), d))
    left = {d: left[d] for d in sorted(keep.values())}
    low = similar_roots(left)
    left = {d: t for d, t in left.items() if low[d] == d}
    items = duck.execute("SELECT item_id, text FROM benchmark").fetchall()
    from brute import contained

    left = {d: left[d] for d in left.keys() - {d for _, d, _, _ in contained(list(left.items()), items)}}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == pieces(public_tokenizers.path("word_bpe_49k.json"), left.items())
    assert packing_is_valid(got) <= -(-sum(r.length for r in got) // 2048) + 1


def test_stages_keep_the_columns(spark):
    docs = documents(spark, SF).limit(60)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == documents(spark, SF).columns
    assert contamination.THRESHOLD == 0.8
