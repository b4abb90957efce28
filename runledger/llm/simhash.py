"""SimHash fingerprints and a binary-trie self-join of them (operator 10)."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.common import batch_of, column, ranges, small_batches, strings
from runledger.llm.components import components
from runledger.session import cut

SHINGLE, SEED, BITS, MAX_BITS = 3, 42, 64, 3
#: Fingerprints with equal bits in a block that one trie may hold; above, the block is split.
HOT_ROWS = 100_000
#: Node pairs with at most this many leaf pairs are compared outright.
LEAF_PAIRS = 64
#: Shingle minima in a band, and the share of pairs at the similarity asked for that no band may miss.
BAND_ROWS, MISSED = 4, 1e-4
#: Documents of a bucket that one task holds; a larger bucket is dealt to parts, every two of which meet in a task.
TILE_ROWS = 4_000
#: Fingerprints of whole groups that are joined in one go.
JOINED_ROWS = 200_000


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text, unsigned: a bit is 1 if set in over half of the shingle hashes."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return 0
    body = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(body, SEED)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = (starts + lengths)[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(body[a:b], SEED) for a, b in zip(starts.tolist(), ends)], dtype=">u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` of every row; ``fp`` holds the 64 bits as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint_of(t) for t in strings(batch)], dtype=np.uint64)
            yield batch_of(schema, doc_id=column(batch, "doc_id"), fp=prints.view(np.int64))

    return small_batches(docs).select("doc_id", "text").mapInArrow(hashed, "doc_id bigint, fp bigint")


def trie_pairs(prints: np.ndarray, groups: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one group whose fingerprints differ in at most ``max_bits`` bits.

    ``prints`` are sorted by (group, value), so a trie node is a range of rows. Pairs of
    nodes go down together, one bit at a time; a pair of unlike children has one more
    differing bit, and pairs above the budget are pruned.
    """
    n = len(prints)
    edges = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1], [True]])) if n else np.zeros(1, dtype=np.int64)
    l1, r1 = edges[:-1].astype(np.int64), edges[1:].astype(np.int64)
    l2, r2, diff = l1.copy(), r1.copy(), np.zeros(len(l1), dtype=np.int64)
    found_a, found_b = [], []
    for bit in range(BITS - 1, -2, -1):
        same = l1 == l2
        size = np.where(same, (r1 - l1) * (r1 - l1 - 1) // 2, (r1 - l1) * (r2 - l2))
        live = (size > 0) & (diff <= max_bits)
        leaf = live & ((size <= LEAF_PAIRS) | (bit < 0))
        for part in np.array_split(np.flatnonzero(leaf), max(1, int(size[leaf].sum()) // 2_000_000 + 1)):
            a, b = _all_pairs(l1[part], r1[part], l2[part], r2[part])
            near = np.bitwise_count(prints[a] ^ prints[b]) <= max_bits
            found_a.append(a[near])
            found_b.append(b[near])
        live &= ~leaf
        if bit < 0 or not live.any():
            break
        l1, r1, l2, r2, diff, same = l1[live], r1[live], l2[live], r2[live], diff[live], same[live]
        ones = np.concatenate([[0], np.cumsum((prints >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)])
        m1, m2 = r1 - (ones[r1] - ones[l1]), r2 - (ones[r2] - ones[l2])
        cross = ~same
        l1, r1, l2, r2, diff = (
            np.concatenate(x)
            for x in (
                (l1, m1, l1, m1[cross]),
                (m1, r1, m1, r1[cross]),
                (l2, m2, m2, l2[cross]),
                (m2, r2, r2, m2[cross]),
                (diff, diff, diff + 1, diff[cross] + 1),
            )
        )
    return np.concatenate(found_a), np.concatenate(found_b)


def _all_pairs(l1: np.ndarray, r1: np.ndarray, l2: np.ndarray, r2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of every pair of the given node pairs; pairs within one node once."""
    sizes = (r1 - l1) * (r2 - l2)
    of = np.repeat(np.arange(len(l1)), sizes)
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    width = (r2 - l2)[of] if len(of) else of
    a, b = l1[of] + place // np.maximum(width, 1), l2[of] + place % np.maximum(width, 1)
    keep = (l1[of] != l2[of]) | (a < b)
    return a[keep], b[keep]


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row that each of ``n`` rows reaches over the pairs."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            return root
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]


def shares(open_bits: int, parts: int) -> list[int]:
    """Masks that deal the set bits of ``open_bits`` evenly into ``parts`` runs, highest first."""
    places = [b for b in range(BITS - 1, -1, -1) if open_bits >> b & 1]
    cuts = [len(places) * k // parts for k in range(parts + 1)]
    return [sum(1 << b for b in places[i:j]) for i, j in zip(cuts, cuts[1:])]


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def block_rows(prints: DataFrame, max_bits: int, hot_rows: int) -> DataFrame:
    """``space, fp, block``: fingerprints of one space that may be near share a block.

    Cut into ``max_bits + 1`` blocks, two near fingerprints are equal in one of them at
    least. A block value that over ``hot_rows`` fingerprints share is cut again: of its
    members' other bits one share must be equal as well. No row is dropped. ``block`` is a
    hash; two blocks that meet by chance are compared in vain, no more.
    """
    parts = max_bits + 1
    levels = [(prints.select("space", "fp", F.xxhash64("space").alias("block")), (1 << BITS) - 1)]
    done: list[DataFrame] = []
    for depth in range(3):
        hot_levels = []
        for rows, open_bits in levels:
            for k, mask in enumerate(shares(open_bits, parts)):
                value = F.col("fp").bitwiseAND(F.lit(signed(mask)))
                keyed = rows.select("space", "fp", F.xxhash64("block", F.lit(depth), F.lit(k), value).alias("block"))
                hot_levels.append((keyed, open_bits & ~mask))
        if depth == 2:
            done += [rows for rows, _ in hot_levels]
            break
        every = hot_levels[0][0]
        for rows, _ in hot_levels[1:]:
            every = every.unionByName(rows)
        hot = cut(every.groupBy("block").count().filter(F.col("count") > hot_rows).select("block"), "hot-blocks")
        if not hot.head(1):
            done.append(every)
            break
        done.append(every.join(hot, "block", "left_anti").select("space", "fp", "block"))
        levels = [(rows.join(hot, "block", "left_semi").select("space", "fp", "block"), left) for rows, left in hot_levels]
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result


def near_links(prints: DataFrame, max_bits: int = MAX_BITS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Links ``space, a, b`` that join all fingerprints of a space within ``max_bits`` bits.

    Tries of whole blocks are joined in tasks that hold about ``JOINED_ROWS`` fingerprints;
    of each trie the links of a spanning forest come out, which keep every fingerprint's
    class and grow with the fingerprints instead of the pairs.
    """
    schema = pa.schema([("space", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])

    def join(blocks: np.ndarray, prints: np.ndarray, spaces: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((prints.view(np.uint64), blocks))
        blocks, prints, spaces = blocks[order], prints[order].view(np.uint64), spaces[order]
        a, b = trie_pairs(prints, blocks, max_bits)
        root = spanning(len(prints), a, b)
        left = np.flatnonzero(root != np.arange(len(prints)))
        right = root[left]
        return batch_of(schema, space=spaces[left], a=prints[left].view(np.int64), b=prints[right].view(np.int64))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            held.append(tuple(column(batch, name).to_numpy() for name in ("block", "fp", "space")))
            size += batch.num_rows
            if size >= JOINED_ROWS:
                rows = [np.concatenate(x) for x in zip(*held, strict=True)]
                other = np.flatnonzero(rows[0] != rows[0][-1])
                whole = int(other[-1]) + 1 if len(other) else 0
                if whole:
                    yield join(*(x[:whole] for x in rows))
                held, size = [tuple(x[whole:] for x in rows)], 0 if whole else size // 2
        if held:
            yield join(*(np.concatenate(x) for x in zip(*held, strict=True)))

    blocks = block_rows(prints, max_bits, hot_rows)
    return blocks.repartition("block").sortWithinPartitions("block").mapInArrow(joined, "space int, a bigint, b bigint")


def near_groups(docs: DataFrame, max_bits: int = MAX_BITS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Near-duplicate classes (operator 10): ``doc_id, fingerprint, component_id``.

    Documents link when their fingerprints differ in ``max_bits`` bits or fewer;
    ``component_id`` is the smallest ``doc_id`` reachable. Equal fingerprints become one row
    before the join. A null text, or one without words, has fingerprint zero and links like
    any other; a null ``doc_id`` takes part and is never the smallest unless alone; repeated
    rows give a row each; no documents, no rows. Other columns are not read.
    """
    prints = cut(fingerprints(docs), "fingerprints")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(near_links(least.select(F.lit(0).alias("space"), "fp"), max_bits, hot_rows))
    rooted = least.join(roots, least["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = rooted.join(lowest, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingles_of(text: str, shingle: int) -> np.ndarray:
    """Sorted 32-bit hashes of the different word runs of a text; none without words."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint32)
    return np.array(sorted({zlib.crc32(b" ".join(words[i : i + shingle])) for i in range(max(1, len(words) - shingle + 1))}), dtype=np.uint32)


def bands_for(similarity: float, rows: int = BAND_ROWS, missed: float = MISSED) -> int:
    """Bands of ``rows`` minima after which at most ``missed`` of the pairs of that similarity share none."""
    met = similarity**rows
    return 1 if met >= 1 else max(1, math.ceil(math.log(missed) / math.log1p(-met)))


def bands(docs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """``doc_id, space, fp``: fingerprints of the word runs of each document, one per band.

    The least of the run hashes under one mixing is the same in two documents with a chance
    equal to their similarity, whatever the kind of edit; a band joins ``BAND_ROWS`` of them.
    Rows without words or ``doc_id`` have none.
    """
    count, width = bands_for(similarity), BAND_ROWS
    schema = pa.schema([("doc_id", pa.int64()), ("space", pa.int32()), ("fp", pa.int64())])
    drawn = np.random.default_rng(SEED).integers(0, 1 << 64, size=(2, count * width), dtype=np.uint64)
    factors, shifts = drawn[0] | np.uint64(1), drawn[1]

    def of(runs: np.ndarray) -> np.ndarray:
        h = (runs.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        least = np.full(count * width, np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(h), 1 << 12):
            least = np.minimum(least, (h[at : at + (1 << 12), None] * factors + shifts).min(axis=0))
        rows = least.reshape(count, width).astype("<u8")
        return np.array([xxhash.xxh64_intdigest(row.tobytes(), SEED) for row in rows], dtype=np.uint64).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, prints = [], []
            for doc_id, text in zip(column(batch, "doc_id").to_pylist(), strings(batch), strict=True):
                runs = shingles_of(text, shingle)
                if len(runs) and doc_id is not None:
                    ids.append(doc_id)
                    prints.append(of(runs))
            flat = np.concatenate(prints) if prints else np.zeros(0, dtype=np.int64)
            yield batch_of(schema, doc_id=np.repeat(np.array(ids, dtype=np.int64), count), space=np.tile(np.arange(count, dtype=np.int32), len(ids)), fp=flat)

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id bigint, space int, fp bigint")


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, shingles``: 32-bit hashes of the different word runs of each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of(schema, doc_id=column(batch, "doc_id"), shingles=[shingles_of(text, shingle).view(np.int32) for text in strings(batch)])

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id bigint, shingles array<int>")


def links_across(ids: np.ndarray, roots: np.ndarray, flat: np.ndarray, sizes: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that join documents as all pairs of ``similarity`` or more would, given their classes.

    Classes are walked: each document reached is compared with all that no class has reached
    yet, and one that is near brings its whole class along. What is never compared is in one
    class already, so a family around one text costs a pass or two and not all of its pairs.
    """
    _, codes = np.unique(flat, return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    _, classes = np.unique(roots, return_inverse=True)
    of_class = np.split(np.argsort(classes, kind="stable"), np.cumsum(np.bincount(classes))[:-1])
    marks = np.zeros(int(codes.max()) + 1 if len(codes) else 1, dtype=bool)
    left = np.ones(len(ids), dtype=bool)
    rows = np.arange(len(ids))
    held, at = codes, starts
    links: list[tuple[int, int]] = []
    for first in range(len(ids)):
        if not left[first]:
            continue
        queue = of_class[classes[first]].tolist()
        left[queue] = False
        while queue:
            x = queue.pop()
            if 2 * np.count_nonzero(left[rows]) < len(rows):
                rows = rows[left[rows]]
                held = codes[ranges(starts[rows], sizes[rows])]
                at = np.cumsum(sizes[rows]) - sizes[rows]
            if not len(rows):
                return links
            mine = codes[starts[x] : starts[x] + sizes[x]]
            marks[mine] = True
            both = np.add.reduceat(marks[held], at, dtype=np.int64)
            marks[mine] = False
            near = rows[left[rows] & (both >= similarity * (sizes[x] + sizes[rows] - both))]
            for y in near.tolist():
                if left[y]:
                    links.append((int(ids[x]), int(ids[y])))
                    more = of_class[classes[y]]
                    left[more] = False
                    queue += more.tolist()
    return links


def open_members(rows: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """``space, fp, doc_id, root, n`` of the documents in buckets where a pair is still unchecked.

    The head of a bucket was compared with all of it, so it and its equals are left out, as
    are repeats of one set in one class, buckets of one class, and buckets that hold just
    the documents of another one.
    """
    labelled = rows.join(roots.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left").join(sets.select("doc_id", F.xxhash64("shingles").alias("key")), "doc_id")
    heads = labelled.filter("doc_id = head").select("space", "fp", F.col("key").alias("head_key"))
    rest = labelled.join(heads, ["space", "fp"]).filter("key <> head_key")
    rest = rest.groupBy("space", "fp", F.coalesce("root", "doc_id").alias("root"), "key").agg(F.min("doc_id").alias("doc_id"))
    rest = cut(rest.select("space", "fp", "doc_id", "root"), "bucket-rest")
    found = rest.groupBy("space", "fp").agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("doc_id").cast("decimal(20,0)")).alias("mark"), F.min("root").alias("low"), F.max("root").alias("high"), F.min("doc_id").alias("least")
    )
    open_ones = found.filter("low <> high").groupBy("n", "mark", "least").agg(F.min(F.struct("space", "fp")).alias("one")).select("one.space", "one.fp", "n")
    return rest.join(open_ones, ["space", "fp"])


def fingerprint_classes(docs: DataFrame, worded: DataFrame) -> DataFrame:
    """``doc_id, space, fp``: the SimHash class (``near_groups``) of each document in ``worded``.

    ``space`` is -1, which no band has, and ``fp`` the smallest ``doc_id`` of the class.
    """
    found = near_groups(docs).join(worded, "doc_id", "left_semi")
    return found.select("doc_id", F.lit(-1).alias("space"), F.col("component_id").alias("fp")).distinct()


def similar_groups(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, hot_rows: int = TILE_ROWS) -> DataFrame:
    """``node, root`` of documents in classes of near copies, by checked links.

    Documents of one class of SimHash fingerprints (``near_groups``, operator 10) are
    candidates. Copies with more edits than the fingerprints bear are found by ``bands``:
    documents that share one of these are candidates as well. A pair is a link if the
    shingle sets have at least ``similarity`` in common, and all candidates count. First each
    bucket's head, the document with the most candidates, is compared with the bucket. Where
    a bucket then still has several classes, they are walked in one task (``links_across``),
    or, of over ``hot_rows`` documents, in a task for every two of its parts.
    """
    found = cut(bands(docs, similarity, shingle), "bands")
    prints = found.unionByName(fingerprint_classes(docs, found.filter("space = 0").select("doc_id")))
    shared = prints.groupBy("space", "fp").agg(F.count("*").alias("mates")).filter("mates > 1")
    rows = cut(prints.join(shared, ["space", "fp"]), "buckets", replaces=found)
    degrees = rows.groupBy("doc_id").agg(F.sum("mates").alias("degree"))
    heads = rows.join(degrees, "doc_id").groupBy("space", "fp").agg((-F.max(F.struct("degree", -F.col("doc_id")))["col2"]).alias("head"))
    rows = cut(rows.join(heads, ["space", "fp"]).select("doc_id", "space", "fp", "head").distinct(), "headed", replaces=rows)
    pairs = cut(rows.select(F.least("head", "doc_id").alias("a"), F.greatest("head", "doc_id").alias("b")).filter("a <> b").distinct(), "near-pairs")
    sets = shingle_sets(docs.select("doc_id", "text").join(rows.select("doc_id").distinct(), "doc_id", "left_semi"), shingle)
    # rows that repeat an id are one document
    sets = cut(sets.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("shingles")))).alias("shingles")), "shingle-sets")
    left, right = (sets.select(F.col("doc_id").alias(k), F.col("shingles").alias(f"of_{k}")) for k in ("a", "b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    checked = pairs.join(left, "a").join(right, "b").filter(both >= similarity * (F.size("of_a") + F.size("of_b") - both))
    roots = cut(components(checked.select("a", "b")), "roots")

    members = cut(open_members(rows, roots, sets), "open-buckets", replaces=rows)
    if not members.head(1):
        return roots
    parts = F.ceil(F.col("n") / F.lit(hot_rows)).cast("int")
    mine = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("parts")).cast("int")
    other = F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("parts") - 1), F.col("part"))))
    tiled = members.withColumn("parts", parts).withColumn("part", mine).select("space", "fp", "doc_id", "root", "part", other.alias("other"))
    tiled = tiled.select("space", "fp", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "doc_id", "root").join(sets, "doc_id")

    def walked(table: pa.Table) -> pa.Table:
        lists = table["shingles"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        found = links_across(table["doc_id"].to_numpy(), table["root"].to_numpy(), lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64), similarity)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    links = tiled.groupBy("space", "fp", "i", "j").applyInArrow(walked, "a bigint, b bigint")
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))


def drop_near_copies(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without near copies, with all their columns.

    Of a class of documents (``similar_groups``) the one with the smallest ``doc_id`` stays.
    Rows without words or ``doc_id`` stay; of rows that repeat a ``doc_id`` one stays.
    """
    gone = similar_groups(docs, similarity).filter("node <> root").select(F.col("node").alias("__gone_id"))
    names = docs.columns
    left = docs.join(gone, F.col("doc_id") == F.col("__gone_id"), "left_anti")
    known = left.filter(F.col("doc_id").isNotNull())
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64(*[F.col(n).cast("string") for n in names]))
    one = known.withColumn("__copy_no", F.row_number().over(first)).filter("__copy_no = 1").select(*names)
    return one.unionByName(left.filter(F.col("doc_id").isNull()))
