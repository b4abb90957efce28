"""Phrases that are more than chance, from weighted automata of word sequences (operator 11)."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.automata import DEPTH, Automaton, starts_of
from runledger.llm.common import batch_of, chunks, column, small_batches, strings
from runledger.session import cut

#: Words of a shard, which becomes one automaton per prefix range (label numbers take 21 bits).
SHARD_WORDS, LABEL_BITS = 1_500_000, 21
#: Word windows that one prefix range is to hold. Where ranges part is found from one in so many
#: documents (``SAMPLE_DOCS`` at least), and about so many windows of them for every range.
RANGE_WINDOWS, SAMPLE_SHARE, SAMPLE_DOCS, RANGE_KEYS = 1_500_000, 0.01, 2_000, 64
#: Factor of the score, and per cent of its occurrences that a phrase may share with a longer one.
SCALE, INSIDE = 2_000_000, 80

#: Piece ends, all turned into one of them, which then stands alone between spaces.
PIECE_END = b"."
ONE_END = bytes(PIECE_END[0] if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))

Bound = tuple[bytes, ...]


def marked_words(texts: list[str]) -> list[bytes]:
    """Words of all texts in order, A-Z in lower case, with ``PIECE_END`` behind every piece."""
    body = PIECE_END.join(t.encode() for t in texts).lower().translate(ONE_END)
    return (body + PIECE_END).replace(PIECE_END, b" . ").split()


class Shard:
    """Words of one language until there are enough for an automaton."""

    def __init__(self) -> None:
        numbers = count(1)
        self.number: dict[bytes, int] = defaultdict(lambda: next(numbers))
        self.number[PIECE_END] = 0
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, texts: list[str]) -> None:
        words = marked_words(texts)
        self.held.append(np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words)))
        self.size += len(words)

    def windows(self) -> Iterator[tuple[list[bytes], list[np.ndarray], np.ndarray]]:
        """Sorted words, different windows of up to ``DEPTH`` words in ascending order, and counts.

        A window starts at each word and ends with its piece. A shard with a very long text
        is cut into runs that overlap by what a window needs.
        """
        whole = np.concatenate([*self.held, np.zeros(DEPTH, dtype=np.int64)])
        names = list(self.number)
        for at in range(0, self.size, SHARD_WORDS):
            run = whole[at : at + SHARD_WORDS + DEPTH - 1]
            used = np.unique(run)
            used = used[used > 0]
            by_name = sorted(used.tolist(), key=lambda i: names[i])
            rank = np.zeros(len(names), dtype=np.int64)
            rank[by_name] = np.arange(1, len(by_name) + 1)
            labels = rank[run]
            n = min(SHARD_WORDS, self.size - at)
            columns = [labels[:n]]
            for k in range(1, DEPTH):
                columns.append(np.where(columns[-1] > 0, labels[k : n + k], 0))
            begins = columns[0] > 0
            columns = [c[begins] for c in columns]
            if not len(columns[0]):
                continue
            heads, head = np.unique(columns[0] << LABEL_BITS | columns[1], return_inverse=True)
            codes, times = np.unique(head << 2 * LABEL_BITS | columns[2] << LABEL_BITS | columns[3], return_counts=True)
            mask = (1 << LABEL_BITS) - 1
            pair = heads[codes >> 2 * LABEL_BITS]
            yield [names[i] for i in by_name], [pair >> LABEL_BITS, pair & mask, codes >> LABEL_BITS & mask, codes & mask], times


def cuts_of(lang: bytes, words: list[bytes], columns: list[np.ndarray], bounds: list[Bound]) -> list[int]:
    """For each bound, how many of the sorted windows of ``lang`` lie before it."""
    places = []
    for bound in bounds:
        low, high = 0, len(columns[0])
        if bound[0] != lang:
            places.append(0 if bound[0] < lang else high)
            continue
        for k, column_ in enumerate(columns):
            if k + 1 >= len(bound):
                break
            label = bisect_left(words, bound[k + 1])
            known = label < len(words) and words[label] == bound[k + 1]
            part = column_[low:high]
            start = low + int(np.searchsorted(part, label + 1))
            high = low + int(np.searchsorted(part, label + 2)) if known else start
            low = start
        places.append(low)
    return places


def packed_words(words: list[bytes]) -> bytes:
    return b" ".join(words)


def summed(weights: np.ndarray):
    """Weight of a prefix: the occurrences of all windows that begin with it."""
    total = np.concatenate([[0], np.cumsum(weights)])
    return lambda depth, starts: np.diff(total[np.append(starts, len(weights))])


def with_lang(docs: DataFrame) -> DataFrame:
    return small_batches(docs).select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")


def range_bounds(docs: DataFrame) -> list[Bound]:
    """Windows (language, words) at which prefix ranges part, from a sample of documents.

    The sample decides where tasks begin and end, not what they find. A range should hold
    ``RANGE_WINDOWS`` windows; the driver gets ``RANGE_KEYS`` windows for each range, so
    their number and the sample grow with the documents.
    """
    n = docs.count()
    share = min(1.0, max(SAMPLE_SHARE, SAMPLE_DOCS / max(1, n)))
    stride = max(1, int(RANGE_WINDOWS * share / RANGE_KEYS))
    schema = pa.schema([("window", pa.list_(pa.binary()))])

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, lang in zip(strings(batch), column(batch, "lang").to_pylist(), strict=True):
                words = marked_words([text])
                for at in range(zlib.crc32(text[:64].encode()) % stride, len(words), stride):
                    if words[at] != PIECE_END:
                        window = words[at : at + DEPTH]
                        found.append([lang.encode(), *(window[: window.index(PIECE_END)] if PIECE_END in window else window)])
            yield batch_of(schema, window=found)

    sample = with_lang(docs.sample(share, seed=11) if share < 1 else docs).mapInArrow(taken, "window array<binary>")
    keys = sorted(tuple(w) for w in sample.toArrow().column("window").to_pylist())
    ranges_wanted = -(-int(len(keys) * stride / share) // RANGE_WINDOWS)
    return sorted({keys[len(keys) * k // ranges_wanted] for k in range(1, ranges_wanted)})


def shard_automata(docs: DataFrame, bounds: list[Bound]) -> DataFrame:
    """``part, lang, words, automaton``: what each shard counted, one row per prefix range."""
    schema = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("words", pa.binary()), ("automaton", pa.binary())])

    def rows(lang: str, shard: Shard) -> Iterator[pa.RecordBatch]:
        for words, columns, times in shard.windows():
            edges = [0, *cuts_of(lang.encode(), words, columns, bounds), len(times)]
            for part, (a, b) in enumerate(zip(edges, edges[1:])):
                if a < b:
                    used, local = np.unique(np.concatenate([c[a:b] for c in columns]), return_inverse=True)
                    ends = int(used[0] == 0)
                    local = (local + 1 - ends).reshape(DEPTH, b - a)
                    machine = Automaton.of_sorted(list(local), summed(times[a:b]))
                    names = packed_words([words[i - 1] for i in used[ends:].tolist()])
                    yield batch_of(schema, part=[part], lang=[lang], words=[names], automaton=[machine.to_bytes()])

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[str, Shard] = {}
        for batch in batches:
            texts, langs = strings(batch), column(batch, "lang").to_pylist()
            for lang in sorted(set(langs)):
                mine = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                for a, b in chunks(mine):
                    shard = shards.setdefault(lang, Shard())
                    shard.add(mine[a:b])
                    if sum(s.size for s in shards.values()) >= SHARD_WORDS:
                        largest = max(shards, key=lambda x: shards[x].size)
                        yield from rows(largest, shards.pop(largest))
        for lang, shard in shards.items():
            yield from rows(lang, shard)

    return with_lang(docs).mapInArrow(built, "part int, lang string, words binary, automaton binary")


def edge_prefixes(columns: list[np.ndarray], total: np.ndarray, number: dict[bytes, int], bound: Bound, least: int) -> dict[str, tuple[int, int]]:
    """Words and count of each prefix of ``bound`` that stands here fewer than ``least`` times."""
    found, low, high = {}, 0, len(columns[0])
    for k in range(1, len(bound)):
        label = number.get(bound[k], -1)
        part = columns[k - 1][low:high]
        low, high = low + int(np.searchsorted(part, label)), low + int(np.searchsorted(part, label, side="right"))
        times = int(total[high] - total[low])
        if not times:
            break
        if times < least:
            found[b" ".join(bound[1 : k + 1]).decode()] = k, times
    return found


def united_counts(automata: DataFrame, bounds: list[Bound], least: int) -> DataFrame:
    """``lang, phrase, words, f`` of all phrases of up to ``DEPTH`` words with ``f >= least``.

    The automata of a prefix range are united and their weights added. A prefix of the
    window at either end of a range may have more occurrences next door, so it goes on
    whatever its count, and the sums decide. ``words`` 0 holds the words of a language.
    """
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("f", pa.int64())])

    def unite(key: tuple, table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        ends = [bounds[i] for i in (part - 1, part) if 0 <= i < len(bounds)]
        out: dict[str, list] = {n: [] for n in schema.names}
        for lang in sorted(set(table.column("lang").to_pylist())):
            mine = table.filter(pc.equal(table.column("lang"), lang))
            names, counted, lists = [], [], [x.split() for x in mine.column("words").to_pylist()]
            names = sorted(set().union(*lists))
            number = {w: i for i, w in enumerate(names, 1)}
            gathered: list[list[np.ndarray]] = [[] for _ in range(DEPTH)]
            for words, data in zip(lists, mine.column("automaton").to_pylist(), strict=True):
                label = np.array([0, *map(number.__getitem__, words)], dtype=np.int32)
                columns, weight = Automaton.from_bytes(data).paths()
                for k in range(DEPTH):
                    gathered[k].append(label[columns[k]])
                counted.append(weight)
            columns, weight = [np.concatenate(c) for c in gathered], np.concatenate(counted)
            order = np.lexsort(columns[::-1])
            columns, total = [c[order] for c in columns], np.concatenate([[0], np.cumsum(weight[order])])
            starts = starts_of(columns)
            found = [edge_prefixes(columns, total, number, bound, least) for bound in ends if bound[0] == lang.encode()]
            for phrase, (k, times) in {phrase: x for some in found for phrase, x in some.items()}.items():
                for name, value in zip(schema.names, (lang, phrase, k, times), strict=True):
                    out[name].append(value)
            for k in range(1, DEPTH + 1):
                here = starts[k]
                times = np.diff(total[np.append(here, len(order))])
                kept = np.flatnonzero((columns[k - 1][here] > 0) & (times >= least))
                rows = here[kept]
                out["phrase"] += [b" ".join(names[x - 1] for x in row).decode() for row in zip(*[c[rows].tolist() for c in columns[:k]])]
                out["lang"] += [lang] * len(rows)
                out["words"] += [k] * len(rows)
                out["f"] += times[kept].tolist()
            out["lang"].append(lang)
            out["phrase"].append(None)
            out["words"].append(0)
            out["f"].append(int(total[-1]))
        return pa.table(out, schema=schema)

    ddl = "lang string, phrase string, words int, f bigint"
    united = automata.groupBy("part").applyInArrow(unite, ddl)
    return united.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).filter(f"words = 0 or f >= {int(least)}")


def part_counts(counts: DataFrame, bounds: list[Bound]) -> DataFrame:
    """``lang, phrase, a, cut, l, r``: the counts of both parts of every cut of every candidate.

    What is asked goes to the prefix range that holds it. There the asked sequences are
    composed with the automaton of the range's counts.
    """
    ask = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("asked", pa.string()), ("phrase", pa.string()), ("a", pa.int64()), ("cut", pa.int32()), ("head", pa.bool_())])
    have = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])
    told = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("a", pa.int64()), ("cut", pa.int32()), ("head", pa.bool_()), ("f", pa.int64())])

    def part_of(lang: str, words: list[str]) -> int:
        return bisect_right(bounds, (lang.encode(), *[w.encode() for w in words]))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                words = r["phrase"].split(" ")
                for k in range(1, len(words)):
                    for part, head in ((words[:k], True), (words[k:], False)):
                        rows.append((part_of(r["lang"], part), r["lang"], " ".join(part), r["phrase"], r["f"], k, head))
            yield batch_of(ask, **dict(zip(ask.names, map(list, zip(*rows, strict=True)) if rows else [[]] * len(ask), strict=True)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, phrases = column(batch, "lang").to_pylist(), column(batch, "phrase").to_pylist()
            yield batch_of(have, part=[part_of(x, p.split(" ")) for x, p in zip(langs, phrases)], lang=langs, phrase=phrases, f=column(batch, "f"))

    def labels(lists: list[list[bytes]], number: dict[bytes, int], missing: int) -> list[np.ndarray]:
        return [np.array([number.get(x[k], missing) if k < len(x) else 0 for x in lists], dtype=np.int64) for k in range(DEPTH)]

    def compose(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = np.zeros(left.num_rows, dtype=np.int64)
        langs = np.array(left.column("lang").to_pylist(), dtype=object)
        for lang in sorted(set(langs.tolist())):
            mine = right.filter(pc.equal(right.column("lang"), lang))
            lists = sorted(zip((p.encode().split(b" ") for p in mine.column("phrase").to_pylist()), mine.column("f").to_pylist()))
            if not lists:
                continue
            words, f = [x for x, _ in lists], np.array([n for _, n in lists], dtype=np.int64)
            number = {w: i for i, w in enumerate(sorted(set().union(*words)), 1)}
            length = np.array([len(x) for x in words])
            machine = Automaton.of_sorted(labels(words, number, 0), lambda depth, starts: np.where(length[starts] == depth, f[starts], 0))
            at = np.flatnonzero(langs == lang)
            wanted = [x.encode().split(b" ") for x in left.column("asked").take(pa.array(at)).to_pylist()]
            found[at] = machine.compose(labels(wanted, number, -1), np.array([len(x) for x in wanted]))
        return pa.table([left.column(n) for n in told.names[:-1]] + [pa.array(found)], schema=told)

    phrases = counts.filter("words > 0").select("lang", "phrase", "words", "f")
    requests = phrases.filter("words > 1").mapInArrow(asked, "part int, lang string, asked string, phrase string, a bigint, cut int, head boolean")
    holders = phrases.mapInArrow(placed, "part int, lang string, phrase string, f bigint")
    answers = requests.groupBy("part").cogroup(holders.groupBy("part")).applyInArrow(compose, "lang string, phrase string, a bigint, cut int, head boolean, f bigint")
    sides = [F.max(F.when(F.col("head") == head, F.col("f"))).alias(name) for name, head in (("l", True), ("r", False))]
    return answers.groupBy("lang", "phrase", "a", "cut").agg(*sides)


def phrases(docs: DataFrame, least: int = 30, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of two to four words of every language (operator 11).

    ``lang, rank, phrase, a, l, r, n, score``. A null language is ``und``, a null or empty
    text has no words, repeated rows count each; other columns than ``text`` and ``lang`` are
    not read; no documents, no rows.

    Shards count windows of up to four words in automata, cut at prefix ranges; tasks unite
    the automata of a range. All other counts follow, as a phrase's count is that of the
    windows it begins. Everything after ``united_counts`` works on phrases with ``least``
    occurrences, whose parts have as many.
    """
    bounds = range_bounds(docs)
    counts = cut(united_counts(shard_automata(docs, bounds), bounds, least), "phrase-counts")
    exact = "decimal(38,0)"
    cuts = part_counts(counts, bounds).withColumn("score", F.expr(f"cast(cast({SCALE} as {exact}) * a as {exact}) div cast(l + r as {exact})"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    found = cut(best.select("lang", "phrase", "a", "best.l", "best.r", "best.score"), "phrase-scores")

    words = F.split("phrase", " ")
    within = F.expr("flatten(transform(sequence(2, size(w) - 1), k -> transform(sequence(1, size(w) - k + 1), i -> array_join(slice(w, i, k), ' '))))")
    inside = found.select("lang", "a", words.alias("w")).filter("size(w) > 2").select("lang", F.col("a").alias("longer"), F.explode(within).alias("phrase"))
    covered = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    lies_inside = F.expr(f"coalesce(cast(100 as {exact}) * longer >= cast({INSIDE} as {exact}) * a, false)")
    kept = found.join(covered, ["lang", "phrase"], "left").filter(~lies_inside)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    sizes = counts.filter("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
