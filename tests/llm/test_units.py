"""The parts of the operators that need no session."""

import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from runledger.llm import exact, language, packing, simhash, token_file, tokens
from runledger.llm.fm_index import FMIndex

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LETTERS = "aAbBzZéÉßÜ'’st.,!|<>0189 \n\t\r\x0b\x0c\x1c\x85\xa0ªºµ×÷ĀįİıŁ́̈Kﬁ漢😀̱Hh"


def test_matching_statistics_against_all_substrings():
    rng = np.random.default_rng(1)
    for _ in range(30):
        depth, sigma = int(rng.integers(2, 9)), int(rng.integers(2, 5))
        texts = [rng.integers(1, sigma + 1, rng.integers(1, 40)) for _ in range(rng.integers(1, 8))]
        ids = np.concatenate([np.concatenate([t, [0]]) for t in texts])
        index = FMIndex(ids, depth)
        asked = [rng.integers(1, sigma + 2, rng.integers(0, 30)) for _ in range(5)] + [texts[0], np.array([-1, 1])]
        sizes = np.array([len(x) for x in asked])
        starts = np.cumsum(sizes) - sizes
        known, rows = index.matching_statistics(np.concatenate(asked).astype(np.int64), starts, sizes)
        inside = {tuple(t[i : i + m]) for t in texts for m in range(1, depth + 1) for i in range(len(t) - m + 1)}
        for start, x in zip(starts, asked):
            for i in range(len(x)):
                m = 0
                while m < depth and i + m < len(x) and tuple(x[i : i + m + 1]) in inside:
                    m += 1
                assert known[start + i] == m
                if m:
                    at = index.order[rows[start + i]]
                    assert (ids[at : at + m] == x[i : i + m]).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50), st.integers(0, 2**32 - 1)), max_size=700))
def test_blocks_round_trip(values):
    ids = np.array(values + [7] * (-len(values) % token_file.BLOCK), dtype=np.uint32)
    payloads, low, width, spilled = token_file.pack_blocks(ids)
    sizes = np.array([len(p) for p in payloads], dtype=np.int64)
    back = token_file.unpack_blocks(b"".join(payloads), (np.cumsum(sizes) - sizes).astype(np.uint64), low, width, spilled)
    assert (back == ids).all()


def test_file_round_trip_and_single_documents(tmp_path, monkeypatch):
    monkeypatch.setattr(token_file, "FLUSH_IDS", 1000)
    monkeypatch.setattr(token_file, "READ_BLOCKS", 2)
    rng = np.random.default_rng(2)
    docs = [(i if i % 5 else None, rng.integers(0, 49408, rng.integers(0, 900)).astype("<u4")) for i in range(40)]
    uri = f"file://{tmp_path}/a/x.pfor"
    writer = token_file.Writer(uri)
    for doc_id, ids in docs:
        writer.add(doc_id, ids.tobytes())
    n_docs, n_ids, _ = writer.close()
    reader = token_file.Reader(uri)
    assert (n_docs, n_ids) == (len(docs), sum(len(i) for _, i in docs))
    assert [d if k else None for d, k in zip(reader.doc_ids.tolist(), reader.known)] == [d for d, _ in docs]
    assert all((reader.ids_of(i) == ids).all() for i, (_, ids) in enumerate(docs))
    import zlib

    assert [c for _, c in reader.documents()] == [zlib.crc32(ids.tobytes()) for _, ids in docs]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=LETTERS, max_size=25), st.booleans())
def test_spaced_encoder_agrees_with_the_library(text, special):
    text += "<|endoftext|>x" if special else ""
    want = tokens.tokenizer(WORD).encode(text, add_special_tokens=False).ids
    assert tokens.spaced_encoder(WORD)([text, text]) == [np.array(want, dtype="<u4").tobytes()] * 2


def test_spaced_encoder_with_a_small_table(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_PARTS", 5)
    monkeypatch.setattr(tokens, "CACHED_CHARS", 4)
    encoder, rng = tokens.SpacedEncoder(WORD), random.Random(1)
    words = ["don't", "Ähre", "x" * 200, "a,b", "12.5", "...", "", "the", "quick", "fox"]
    for _ in range(30):
        texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(4)]
        assert encoder(texts) == [np.array(tokens.tokenizer(WORD).encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab .,'é1\n<|>", max_size=200))
def test_safe_pieces_keep_the_count(text):
    cut = tokens.safe_pieces(text, 10)
    encode = tokens.tokenizer(BYTE).encode
    assert "".join(cut) == text
    assert sum(len(encode(p, add_special_tokens=False)) for p in cut) == len(encode(text, add_special_tokens=False))


def test_directory_doubles_where_it_must():
    assert exact.directory_of({}, 10, 4) == (0, [0])
    depth, slots = exact.directory_of({0: 8, 1: 8, 15: 8}, 10, 4)
    assert depth == 4 and slots[0] != slots[1] and slots[8:] == [slots[8]] * 8
    assert slots == sorted(slots)
    assert exact.directory_of({3: 1000}, 10, 2)[0] == 2  # one cell cannot be split further


def test_tries_find_all_near_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    prints = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(6))]))
    groups = (prints >> np.uint64(62)).astype(np.int64)
    a, b = simhash.trie_pairs(prints, groups)
    want = {(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if groups[i] == groups[j] and bin(int(prints[i] ^ prints[j])).count("1") <= 3}
    got = [tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())]
    assert set(got) == want and len(got) == len(want)


def test_shares_cover_the_open_bits():
    for bits in ((1 << 64) - 1, (1 << 48) - 1, 0xF0F0F0F0):
        parts = simhash.shares(bits, 4)
        assert sum(parts) == bits and len({bin(p).count("1") for p in parts}) <= 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_packs_are_valid_and_no_worse_than_best_fit(sizes):
    sizes = np.array(sizes, dtype=np.int64)
    bins = packing.pack(sizes, 64)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sizes[b].sum() <= 64 for b in bins)
    assert len(bins) <= len(packing.best_fit(sizes, 64))


@pytest.mark.parametrize(
    ("sizes", "bins"),
    [
        ([7, 2, 7, 2, 1, 1], [[0, 1], [2, 3], [4, 5]]),  # moves
        ([6, 3, 5, 4, 2], [[0, 1], [2, 3], [4]]),  # 6 and 5 change places, then 2 moves
        ([8, 1, 8, 1, 2, 1], [[0, 1], [2, 3], [4, 5]]),  # 2 for 1, then moves
    ],
)
def test_swaps_empty_a_bin(sizes, bins):
    found = packing.Swaps(np.array(sizes), bins, 10).run()
    assert len(found) == -(-sum(sizes) // 10)
    assert all(sum(sizes[i] for i in b) <= 10 for b in found)


def test_language_masks_and_corner_texts():
    nothing = language.Model([], np.zeros((0, 1 << language.SLOT_BITS), dtype=np.uint64), np.zeros(0))
    assert nothing.predict("words") == ("und", 0.0)
    table = np.zeros((1, 1 << language.SLOT_BITS), dtype=np.uint64)
    for h in range(language.HASHES):
        table[0, language.slots_of(language.grams_of("hello there"), h)] |= np.uint64(2)
    model = language.Model(["de", "en"], table, np.zeros(2))
    assert model.predict("hello there") == ("en", 1.0)
    assert model.predict("zzz qqq") == ("de", 0.0)
    assert [model.predict(t)[0] for t in (None, "", "12 34 !!")] == ["und"] * 3
    assert model.predict("x")[0] in ("de", "en")


@pytest.mark.parametrize("n", [9, 70])
def test_many_languages(n):
    names = [f"l{i:02}" for i in range(n)]
    table = np.zeros((-(-n // 64), 1 << language.SLOT_BITS), dtype=np.uint64)
    for i, word in enumerate(names):
        for h in range(language.HASHES):
            table[i >> 6, language.slots_of(language.grams_of("w" + chr(97 + i % 26) * 3 + chr(97 + i // 26)), h)] |= np.uint64(1 << (i & 63))
    model = language.Model(names, table, np.zeros(n))
    assert model.predict("w" + "b" * 3 + "a")[0] == "l01"
    assert model.predict("w" + chr(97 + (n - 1) % 26) * 3 + chr(97 + (n - 1) // 26))[0] == names[-1]
