"""SimHash fingerprints, and all links between fingerprints that differ in few bits.

Fingerprints within ``most`` bits agree in at least one of ``most + 1`` blocks of bits, so they meet in the group of
that block's value. A group that is still large is cut again by blocks of its remaining bits, by the same argument;
as its fingerprints are distinct and agree in all other bits, this ends below any size. Within a group a hierarchical
index over Gray order finds the links: runs of neighbours share long bit patterns, which an upper node holds once,
and a whole run is pruned when the differences added up on the way down exceed ``most``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces_of, stored, texts
from .graph import components, merge_labels

#: The public seed of the shingle hash.
SEED = 42
BITS = 64
#: Groups above this are cut again. It steers memory per task, not results.
GROUP_ROWS = 2048
FANOUT = 8
PAIRS_AT_ONCE = 1 << 21


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of the shingles of a text, lower-cased in A-Z; fewer words than ``width`` are one shingle."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    digest = xxhash.xxh64_intdigest
    runs = zip(*(words[k:] for k in range(width)), strict=False)
    return np.fromiter((digest(s, SEED) for s in map(b" ".join, runs)), np.uint64, len(words) - width + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes, as a signed long; none: zero."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 65536):
        part = hashes[k : k + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0].astype(np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) of every row; a text without words has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text"):
            found = [fingerprint(shingle_hashes(t, width)) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, pa.int64())], ["doc_id", "fp"])

    rows = texts(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; groups whose keys collide are merged, which costs time and loses nothing."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _cut(blocks: int):
    """Rows (fp, key, rest): one for each block of the remaining bits, keyed by what they agreed in before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, key, rest = (batch[c].to_numpy(zero_copy_only=False).view(np.uint64) for c in ("fp", "key", "rest"))
            for mask in np.unique(rest):
                at = rest == mask
                bits = [b for b in range(BITS) if int(mask) >> b & 1]
                for part in np.array_split(bits, blocks):
                    if not len(part):
                        continue
                    own = np.uint64(sum(1 << int(b) for b in part))
                    new = _mixed(_mixed(key[at] ^ own) ^ (fp[at] & own))
                    left = np.full(int(at.sum()), mask & ~own, np.uint64)
                    columns = [pa.array(x.view(np.int64)) for x in (fp[at], new, left)]
                    yield pa.RecordBatch.from_arrays(columns, ["fp", "key", "rest"])

    return run


def _gray_rank(codes: np.ndarray) -> np.ndarray:
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def near_pairs(keys: np.ndarray, fps: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of positions within ``most`` bits in their group, part by part: the hierarchical Gray-order index.

    ``keys`` and ``fps`` are sorted by key and Gray rank; ``fps`` may have several words a row. Level 0 holds the fingerprints; a node of the next level
    covers ``FANOUT`` neighbours of one group and keeps the bits that all of them share. What a child shares beyond
    its parent is compared on the way down and added to the differences so far.
    """
    n = len(fps)
    wide = fps.ndim > 1
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, n])
    group = np.repeat(np.arange(len(starts)), sizes)
    low, high, owner, last = fps.copy(), fps.copy(), group, np.arange(n)
    levels = []  # from the leaves up: pattern, shared bits, last position covered, first child, children
    first, many = np.arange(n), np.ones(n, np.int64)
    while True:
        shared = ~(low ^ high)
        levels.append([low & shared, shared, last, first, many])
        begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        count = np.diff(np.r_[begin, len(owner)])
        if (count == 1).all():
            break
        inside = np.arange(len(owner)) - np.repeat(begin, count)
        first = np.flatnonzero(inside % FANOUT == 0)
        many = np.diff(np.r_[first, len(owner)])
        low, high = np.bitwise_and.reduceat(low, first), np.bitwise_or.reduceat(high, first)
        last, owner = last[first + many - 1], owner[first]
    for lower, upper in zip(levels, levels[1:], strict=False):
        lower.append(lower[1] & ~np.repeat(upper[1], upper[4], axis=0))
    levels[-1].append(levels[-1][1])

    load = np.cumsum(np.repeat(sizes, sizes))
    at_once = PAIRS_AT_ONCE // (fps.shape[1] if wide else 1)
    k = 0
    while k < n:
        stop = max(k + 1, int(np.searchsorted(load, (load[k - 1] if k else 0) + at_once, "right")))
        query = np.arange(k, min(stop, n))
        node, acc = group[query], np.zeros(len(query), np.uint16 if wide else np.uint8)
        for depth in range(len(levels) - 1, -1, -1):
            pattern, _, last, _, _, own = levels[depth]
            ahead = last[node] > query
            query, node, acc = query[ahead], node[ahead], acc[ahead]
            differ = np.bitwise_count((fps[query] ^ pattern[node]) & own[node])
            acc = acc + (differ.sum(axis=1, dtype=np.uint16) if wide else differ)
            near = acc <= most
            query, node, acc = query[near], node[near], acc[near]
            if depth:
                first, many = levels[depth][3][node], levels[depth][4][node]
                offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                query, acc = np.repeat(query, many), np.repeat(acc, many)
                node = np.repeat(first, many) + offset
        yield query, node
        k = stop


def index_links(keys: np.ndarray, fps: np.ndarray, most: int) -> np.ndarray:
    """Labels of positions joined by a link within their group."""
    labels = np.arange(len(fps))
    for a, b in near_pairs(keys, fps, most):
        merge_labels(labels, a, b)
    return labels


def _search(most: int):
    def links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((_gray_rank(fps), keys))
        keys, fps = keys[order], fps[order]
        labels = index_links(keys, fps, most)
        linked = np.flatnonzero(labels != np.arange(len(labels)))
        pairs = [pa.array(x.view(np.int64)) for x in (fps[linked], fps[labels[linked]])]
        return pa.RecordBatch.from_arrays(pairs, ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by key; the last group of what is held waits for the rest of it."""
        keys, fps = np.empty(0, np.uint64), np.empty(0, np.uint64)
        for batch in batches:
            keys = np.r_[keys, batch["key"].to_numpy(zero_copy_only=False).view(np.uint64)]
            fps = np.r_[fps, batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)]
            if len(keys) >= 32768 and keys[0] != keys[-1]:
                whole = np.flatnonzero(keys != keys[-1])[-1] + 1
                yield links(keys[:whole], fps[:whole])
                keys, fps = keys[whole:], fps[whole:]
        if len(keys):
            yield links(keys, fps)

    return run


def near_links(codes: DataFrame, most: int = 3, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(a, b): links between the distinct longs ``fp`` of ``codes`` that connect exactly what pairs within ``most``
    differing bits connect. Of each group only a spanning forest is returned, never all pairs."""
    shape = "fp long, key long, rest long"
    rows = codes.select("fp", F.lit(0).cast("long").alias("key"), F.lit(-1).cast("long").alias("rest"))
    found = []
    while True:
        rows = stored(rows.mapInArrow(_cut(most + 1), shape), "simhash-blocks")
        large = rows.groupBy("key").count().where(F.col("count") > group_rows).select("key")
        large = stored(large, "simhash-large")
        some = not large.isEmpty()
        small = rows.join(large, "key", "left_anti") if some else rows
        dealt = small.repartition("key").sortWithinPartitions("key").select("key", "fp")
        found.append(dealt.mapInArrow(_search(most), "a long, b long"))
        if not some:
            break
        rows = rows.join(large, "key", "left_semi").select("fp", "key", "rest")
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    return links


def near_duplicates(
    docs: DataFrame, width: int = 3, most: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, fp long, component_id) of every row: the smallest id reachable over fingerprints that differ in at
    most ``most`` bits.

    Missing and empty texts have fingerprint zero and link like any other. Equal fingerprints are one class, found
    by an aggregate, so thousands of copies cost one row in the search. Missing ids are rows like any other, but
    never a component's id unless it has no other. Repeated rows stay. Other columns are left out; an empty table
    gives an empty result.
    """
    rows = stored(fingerprints(docs, width, id_col, text_col), "simhash")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    joined = components(near_links(classes, most)).withColumnRenamed("id", "fp")
    members = joined.join(classes, "fp")
    least = members.groupBy("root").agg(F.min("first").alias("least"))
    linked = stored(joined.join(least, "root").select("fp", "least"), "simhash-linked")
    named = classes.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, width: int = 3, most: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, all columns kept: the row whose id is the component's, or the first
    by hash among rows that share it or have none. Rows are told apart by a number given when they are stored."""
    key = "_simhash_row"
    numbered = stored(docs.withColumn(key, F.monotonically_increasing_id()), "simhash-rows")
    found = near_duplicates(numbered, width, most, key, text_col)
    ids = found.withColumnRenamed("doc_id", key).join(numbered.select(key, F.col(id_col).alias("id")), key)
    best = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col(key).alias("row")))
    kept = ids.groupBy("component_id").agg(best.alias("best")).select(F.col("best.row").alias(key))
    return numbered.join(kept, key, "left_semi").select(*(numbered[c] for c in docs.columns))
