"""Token ids of whole texts, and token counts (operator 9)."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from runledger.llm.common import CHUNK_BYTES, batch_of, chunks, column, per_process, small_batches, strings

COUNT_SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
#: Longest part that stays in the table of parts, and how many a generation of it holds.
CACHED_CHARS, CACHED_PARTS = 64, 400_000
#: Characters that the encoder takes at a time, and new parts that go to the library at a time.
ENCODED_CHARS, ENCODED_PARTS = 1 << 20, 4096
#: How the tokens that end a word are written in the vocabulary.
WORD_END = "</w>"
#: Characters below U+0130 lower-case one to one and have no combining marks; their letters.
NOT_PLAIN = re.compile(r"[^\x00-\u012f]")
LETTERS = r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u012f"
PARTS = re.compile(rf"[{LETTERS}]+|[^{LETTERS} \n\r\t]+")
QUOTED_PARTS = re.compile(rf"[^' \n\r\t]*'[^ \n\r\t]*|{PARTS.pattern}")
#: Texts longer than this are split at safe places before they are counted.
PIECE_CHARS = 1 << 16


def tokenizer(path: str):
    """The tokenizer of a file, loaded once per worker; Spark gives the parallelism, not the library."""
    loaded = per_process("tokenizers")
    if path not in loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        loaded[path] = Tokenizer.from_file(path)
    return loaded[path]


class SpacedEncoder:
    """Ids by a lower-casing tokenizer that drops white space, with a table of parts.

    Such a tokenizer cuts at white space and wherever letters meet other characters, but
    for apostrophes; no token and no rule reaches across. So a text's ids are those of its
    parts in order, and a part is encoded once and then looked up. Words with an apostrophe
    stay whole; texts with special strings or characters that are ``NOT_PLAIN`` go to the library
    as they are. The table has two generations of ``CACHED_PARTS`` entries: when the young
    one is full it becomes the old one, whose parts come back as they are met. That bounds
    memory and keeps frequent parts.
    """

    def __init__(self, path: str):
        self._tokenizer = tokenizer(path)
        vocabulary = self._tokenizer.get_vocab()
        self._ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self._ends_word[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        whole: set[str] = set()
        parts = [self._parts(t, whole) for t in texts]
        if len(self._young) > CACHED_PARTS:
            self._young, self._old = {}, self._young
        young, old = self._young, self._old
        fresh = set().union(*parts).difference(young)
        known = fresh.intersection(old)
        young.update(zip(known, map(old.__getitem__, known)))
        fresh.difference_update(known)
        self._encode(fresh, whole)
        ids = [b"".join(map(young.__getitem__, p)) for p in parts]
        for part in fresh:
            if len(part) > CACHED_CHARS:
                del young[part]
        return ids

    def _encode(self, fresh: set[str], whole: set[str]) -> None:
        """Put new parts into the table. Runs of letters go to the library as one text of
        spaced words, each of which ends with a token that ends a word; should their number
        not agree, and for all other parts, each is a text of its own.
        """
        runs = [p for p in fresh.difference(whole) if p.isalpha()]
        for at in range(0, len(runs), ENCODED_PARTS):
            some = runs[at : at + ENCODED_PARTS]
            ids = np.array(self._tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self._ends_word[ids]) + 1
            if len(ends) == len(some):
                data, stops = ids.tobytes(), (4 * ends).tolist()
                self._young.update(zip(some, map(data.__getitem__, map(slice, [0, *stops], stops))))
        for part in fresh.difference(self._young):
            self._young[part] = np.array(self._tokenizer.encode(part, add_special_tokens=False).ids, dtype="<u4").tobytes()

    @staticmethod
    def _parts(text: str, whole: set[str]) -> list[str]:
        if "<|" in text or not (text.isascii() or not NOT_PLAIN.search(text)):
            whole.add(text)
            return [text]
        return (QUOTED_PARTS if "'" in text else PARTS).findall(text.lower())


def spaced_encoder(path: str) -> SpacedEncoder:
    loaded = per_process("spaced encoders")
    if path not in loaded:
        loaded[path] = SpacedEncoder(path)
    return loaded[path]


def safe_pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """The text cut before single spaces between two ASCII letters, about every ``size`` characters.

    A byte-level tokenizer puts such a space at the head of the word after it, so no token
    reaches across the cut. A text without such a place stays whole.
    """
    if len(text) <= size:
        return [text]
    pieces, start, at = [], 0, size
    while at < len(text) - 1:
        at = text.find(" ", at, len(text) - 1)
        if at < 0:
            break
        before, after = text[at - 1], text[at + 1]
        if before.isascii() and before.isalpha() and after.isascii() and after.isalpha():
            pieces.append(text[start:at])
            start, at = at, at + size
        else:
            at += 1
    pieces.append(text[start:])
    return pieces


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """Bytes and tokens of every text (operator 9): ``doc_id, n_bytes, n_tokens, over_limit``.

    Batches for the library hold about a megabyte whatever the row count, texts above
    ``PIECE_CHARS`` are cut at safe places, and only lengths leave the function. Special
    strings inside texts are handled as is the library's default; no special tokens are
    added. A null text counts as empty (0, 0, false), a null ``doc_id`` stays null, repeated
    rows give a row each and columns other than ``doc_id`` and ``text`` are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(tokenizer_path).encode_batch_fast
        for batch in batches:
            texts = strings(batch)
            pieces, owner = [], []
            for i, text in enumerate(texts):
                cut = safe_pieces(text)
                pieces += cut
                owner += [i] * len(cut)
            lengths = np.zeros(len(pieces), dtype=np.int64)
            for a, b in chunks(pieces, CHUNK_BYTES):
                lengths[a:b] = [len(e) for e in encode(pieces[a:b], add_special_tokens=False)]
            tokens = np.zeros(len(texts), dtype=np.int64)
            np.add.at(tokens, np.array(owner, dtype=np.int64), lengths)
            yield batch_of(
                schema,
                doc_id=column(batch, "doc_id"),
                n_bytes=[len(t.encode()) for t in texts],
                n_tokens=tokens,
                over_limit=tokens > limit,
            )

    return small_batches(docs).select("doc_id", "text").mapInArrow(count, COUNT_SCHEMA)
