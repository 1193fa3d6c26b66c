"""Documents whose sets of word shingles have a Jaccard similarity above a threshold, and what they connect.

SimHash fingerprints say which documents to compare, found by the hierarchical Gray-order index of ``simhash``. At a
similarity of 0.8 fingerprints of 64 bits differ in 9.7 bits on average, so blocks of bits for such a radius would have
less than four bits each and select nothing. Bands of MinHash values deal the documents instead, and fingerprints have
256 bits. Every candidate is confirmed by the similarity of the whole sets. Leads of bands connect most of a group first, with one
candidate for each member and round. What is still apart is searched by the index in every band; the documents that it
connects are compared where their sets lie together, and only links that connect groups are returned, so rows are in
proportion to the members whether they are similar to one of them, only to their neighbours, or almost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces_of, stored, texts
from .graph import components, merge_labels
from .simhash import SEED, _gray_rank, _mixed, fingerprint, near_pairs, shingle_hashes

#: Words of a fingerprint, 64 bits each.
PLANES = ("s0", "s1", "s2", "s3")
BLOCK = 1024


@dataclass(frozen=True)
class Similar:
    """Shingles of ``width`` words, similarity ``least``. A pair is a candidate when all ``rows`` values of one of
    ``bands`` agree and its fingerprints differ in at most ``most_apart`` of 256 bits: a pair at 0.8 is missed with a
    chance of 2 in 100,000, a more similar one with less. (Bits differ with a chance of 0.15, for four shingles and
    five of 0.19.) Leads go on while one in ``productive`` of the pairs they make is similar. ``block`` members of a band,
    or of a group of candidates, are a side of a tile, less if their sets have more than ``hashes`` values in all. There
    each is compared with its ``nearest`` candidates before the others. ``part`` partners follow one copy of a set.
    These five steer the work only."""

    width: int = 5
    least: float = 0.8
    bands: int = 28
    rows: int = 5
    most_apart: int = 76
    productive: int = 4
    nearest: int = 4
    block: int = 2048
    hashes: int = 1_000_000
    part: int = 4096


def minima(hashes: np.ndarray, count: int) -> np.ndarray:
    """The smallest of ``hashes`` under each of ``count`` orders."""
    rng = np.random.default_rng(SEED)
    turn = rng.integers(0, 2**64, count, np.uint64)[:, None]
    factor = rng.integers(0, 2**64, count, np.uint64)[:, None] | np.uint64(1)
    out = np.full(count, ~np.uint64(0))
    for k in range(0, len(hashes), BLOCK):
        np.minimum(out, ((hashes[None, k : k + BLOCK] ^ turn) * factor).min(axis=1), out=out)
    return out


def shingle_set(text: str, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, width))


def wide_fingerprint(hashes: np.ndarray) -> list[int]:
    """The SimHash fingerprint, and those of the same shingles under other hashes."""
    salts = _mixed(np.arange(1, len(PLANES), dtype=np.uint64))
    return [fingerprint(hashes), *(fingerprint(_mixed(hashes ^ salt)) for salt in salts)]


def _codes(how: Similar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text"):
            out = []
            for text in batch["text"].to_pylist():
                hashes = shingle_set(text, how.width)
                least = minima(hashes, how.bands * how.rows)
                key = _mixed(np.arange(1, how.bands + 1, dtype=np.uint64))
                for part in least.reshape(how.bands, how.rows).T:
                    key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + part)
                cls = np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes(), SEED)).view(np.int64)
                out.append((int(cls), len(hashes), *wide_fingerprint(hashes), key.view(np.int64)))
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * len(PLANES), pa.list_(pa.int64())]
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["doc_id", "cls", "n", *PLANES, "keys"],
            )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text"):
            found = [shingle_set(t, width).tobytes() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["cls"], pa.array(found, pa.binary())], ["cls", "hashes"])

    return run


def _confirmed(least: float):
    """Rows sorted by (a, split, b): the set of ``a`` comes first, with no ``b``, and the sets to compare follow it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = np.empty(0, np.uint64)
        for batch in batches:
            keep = []
            for b, raw in zip(batch["b"].to_pylist(), batch["hashes"], strict=True):
                own = np.frombuffer(raw.as_buffer(), np.uint64)
                if b is None:
                    lead = own
                    keep.append(False)
                    continue
                both = len(np.intersect1d(lead, own, assume_unique=True))
                keep.append(both >= least * (len(lead) + len(own) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _near(x: str, y: str, how: Similar) -> tuple[Column, Column]:
    """Differing bits of the fingerprints; and that sizes allow the similarity and the fingerprints are near."""
    small, large = F.least(f"{x}.n", f"{y}.n"), F.greatest(f"{x}.n", f"{y}.n")
    apart = sum(F.bit_count(F.col(f"{x}.{s}").bitwiseXOR(F.col(f"{y}.{s}"))) for s in PLANES)
    return apart, (small >= F.lit(how.least) * large - 1e-9) & (apart <= how.most_apart)


def _of_roots(root: np.ndarray) -> np.ndarray:
    """Labels of positions: the first position with the same root."""
    _, first, inverse = np.unique(root, return_index=True, return_inverse=True)
    return first[inverse]


def _candidates(how: Similar):
    """For a tile of a band: each member with a candidate of another root, with its own root and one that the candidates
    connect it to. Rows are no more than the members."""

    def tile(table: pa.Table) -> Iterator[pa.RecordBatch]:
        fps = np.stack([table[c].to_numpy().view(np.uint64) for c in PLANES], axis=1)
        order = np.lexsort([_gray_rank(fps[:, k]) for k in reversed(range(len(PLANES)))])
        cls, n, root = (table[c].to_numpy()[order] for c in ("cls", "n", "root"))
        own = _of_roots(root)
        labels, taken = own.copy(), np.zeros(len(cls), bool)
        for a, b in near_pairs(np.zeros(len(cls), np.int64), fps[order], how.most_apart):
            fit = (own[a] != own[b]) & (np.minimum(n[a], n[b]) >= how.least * np.maximum(n[a], n[b]) - 1e-9)
            a, b = a[fit], b[fit]
            taken[a] = taken[b] = True
            merge_labels(labels, own[a], own[b])
            labels = labels[labels]
        columns = [cls[taken], root[taken], root[labels[own[taken]]]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cls", "root", "other"])

    return _by_tile(tile)


def _compared(how: Similar):
    """For a tile of a group of candidates, with their sets: links between roots, no more than connect them. In the tile of
    a block with itself all rows are on side 0."""

    def tile(table: pa.Table) -> Iterator[pa.RecordBatch]:
        n, root, side = (table[c].to_numpy() for c in ("n", "root", "side"))
        fps = np.stack([table[c].to_numpy().view(np.uint64) for c in PLANES], axis=1)
        sets = [np.frombuffer(raw.as_buffer(), np.uint64) for raw in table["hashes"]]
        ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
        ids = np.split(ids, np.cumsum([len(s) for s in sets])[:-1])
        seen = np.zeros(sum(map(len, ids)) + 1, bool)
        labels = own = _of_roots(root)
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if side.any() else left
        # The nearest first, as they connect most of what the others need not be compared for.
        for nearest in (how.nearest, None):
            for i in left.tolist():
                js = right[right > i] if right is left else right
                js = js[labels[js] != labels[i]]
                apart = np.bitwise_count(fps[js] ^ fps[i]).sum(axis=1, dtype=np.int64)
                small, large = np.minimum(n[js], n[i]), np.maximum(n[js], n[i])
                fit = (apart <= how.most_apart) & (small >= how.least * large - 1e-9) & (small > 0)
                js, apart = js[fit], apart[fit]
                if nearest is not None and len(js) > nearest:
                    js = js[np.argpartition(apart, nearest)[:nearest]]
                if not len(js):
                    continue
                seen[ids[i]] = True
                many = np.array([len(ids[j]) for j in js])
                both = np.add.reduceat(seen[np.concatenate([ids[j] for j in js])].astype(np.int32), np.cumsum(many) - many)
                seen[ids[i]] = False
                js = js[both >= how.least * (n[i] + n[js] - both) - 1e-9]
                if len(js):
                    joined = np.unique(np.r_[labels[i], labels[js]])
                    labels = np.where(np.isin(labels, joined), joined[0], labels)
        moved = np.flatnonzero((own == np.arange(len(own))) & (labels != own))
        yield pa.RecordBatch.from_arrays([pa.array(root[moved]), pa.array(root[labels[moved]])], ["a", "b"])

    return _by_tile(tile)


def _by_tile(tile):
    """Rows arrive sorted by (key, tile)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, tiles = batch["key"].to_numpy(), batch["tile"].to_numpy()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]) | (tiles[1:] != tiles[:-1])) + 1), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and (held[-1]["key"][0].as_py(), held[-1]["tile"][0].as_py()) != (keys[a], tiles[a]):
                    yield from tile(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from tile(pa.Table.from_batches(held))

    return run


def _tiles(placed: DataFrame, how: Similar, with_sets: bool = False) -> DataFrame:
    """Members (key, own, root) once for each pair of blocks of their key that their block is in."""
    hashes = F.sum("own.n") / F.lit(how.hashes) if with_sets else F.lit(1)
    count = F.greatest(F.count("*") / F.lit(how.block), hashes)
    sizes = placed.groupBy("key").agg(F.ceil(count).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("own.cls", F.lit(SEED)), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = placed.join(sizes, "key").select("key", "blocks", "root", "own.*", own.alias("i")).withColumn("j", other)
    tile = F.least("i", "j").cast("long") * F.col("blocks") + F.greatest("i", "j")
    return rows.select("key", tile.alias("tile"), (F.col("i") > F.col("j")).cast("int").alias("side"), "cls", "n", *PLANES, "root")


class _Groups:
    """Classes with the root of their group so far, and the confirmation of candidates by whole ``sets``."""

    def __init__(self, how: Similar):
        self.how = how
        self.roots: DataFrame | None = None
        self.sets: DataFrame | None = None

    def placed(self, frame: DataFrame, at: str, name: str) -> DataFrame:
        """``frame`` with the root of the class in column ``at``."""
        if self.roots is None:
            return frame.withColumn(name, F.col(at))
        roots = self.roots.select(F.col("id").alias("_id"), F.col("root").alias("_root"))
        return frame.join(roots, F.col(at) == F.col("_id"), "left").withColumn(name, F.coalesce("_root", at)).drop("_id", "_root")

    def linked(self, pairs: DataFrame) -> int:
        """Compare distinct pairs (a, b), join the groups of those that are similar, and count these."""
        sets = self.sets
        # The set of a frequent a is sent once to each of its parts; those of its partners follow it there.
        parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(self.how.part)).cast("int").alias("parts"))
        split = F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("split")
        follow = pairs.join(parts, "a").select("a", split, "b").join(sets, F.col("b") == sets["cls"]).select("a", "split", "b", "hashes")
        first = parts.join(sets, F.col("a") == sets["cls"]).select(
            "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("split"), F.lit(None).cast("long").alias("b"), "hashes"
        )
        both = first.union(follow).repartition("a", "split").sortWithinPartitions("a", "split", F.col("b").asc_nulls_first())
        links = stored(both.select("a", "b", "hashes").mapInArrow(_confirmed(self.how.least), "a long, b long"), "similar-links")
        found = links.count()
        if found:
            # Only groups are linked from here on, so links between the same groups are one.
            self.merge(self.placed(self.placed(links, "a", "ra"), "b", "rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        return found

    def merge(self, ends: DataFrame) -> None:
        """Join groups by links (a, b) between their roots."""
        merged = stored(components(ends.distinct()), "similar-merged")
        if self.roots is None:
            self.roots = merged
        else:
            new = merged.select(F.col("id").alias("root"), F.col("root").alias("_new"))
            moved = self.roots.join(new, "root", "left").select("id", F.coalesce("_new", "root").alias("root"))
            self.roots = stored(moved.union(merged.join(self.roots.select("id"), "id", "left_anti")), "similar-roots")


def _open_bands(groups: _Groups, members: DataFrame) -> DataFrame:
    """(key, own, root) of the bands whose members are in several groups."""
    placed = groups.placed(members.select("key", "own"), "own.cls", "root")
    placed = stored(placed, "similar-placed")
    several = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return stored(placed.join(several.select("key"), "key", "left_semi"), "similar-open")


def similar_documents(docs: DataFrame, how: Similar | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) of every row: the smallest id reachable over pairs of at least ``how.least``.

    Ids are numbers. Missing texts are empty texts, and texts with equal sets, empty ones too, are one class. A text
    of fewer words than a shingle is one shingle. Repeated rows stay, other columns are left out; an empty table gives
    an empty result. A text of any length is one set of eight bytes a distinct shingle.

    Rounds of leads: one member of each band is compared with the members that are not in its group yet, and each
    member takes the nearest of its bands' leads, so a round has at most one pair for each member. Once leads connect
    little, the Gray-order index finds the members of every band that have candidates in other groups. What candidates
    connect is compared in tiles, all pairs that are not connected yet, and the links between groups are joined.
    """
    how = how or Similar()
    rows = texts(docs, id_col, text_col)
    shape = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, cls long, n int, {', '.join(f'{c} long' for c in PLANES)}, keys array<long>"
    codes = stored(rows.mapInArrow(_codes(how), shape), "similar-codes")
    same = [F.first(c).alias(c) for c in ("n", *PLANES, "keys")]
    classes = stored(codes.groupBy("cls").agg(F.min("doc_id").alias("first"), *same), "similar-classes")
    groups = _Groups(how)
    members = classes.select(F.struct("cls", "n", *PLANES).alias("own"), F.explode("keys").alias("key"))
    bands = _open_bands(groups, members)
    wanted = bands.select("own.cls").distinct().join(classes, "cls").select("cls", F.col("first").alias("doc_id"))
    made = rows.join(wanted, "doc_id").select("cls", "text").mapInArrow(_sets(how.width), "cls long, hashes binary")
    groups.sets = stored(made, "similar-sets")

    turn = 0
    while True:
        order = F.col("own.cls") if turn == 0 else F.xxhash64("own.cls", F.lit(turn))
        leads = bands.groupBy("key").agg(F.min(F.struct(order.alias("order"), "own", F.col("root").alias("lead_root"))).alias("lead"))
        leads = leads.select("key", F.col("lead.own").alias("lead"), "lead.lead_root")
        apart, near = _near("lead", "own", how)
        pairs = bands.join(leads, "key").where((F.col("root") != F.col("lead_root")) & near)
        nearest = F.min(F.struct(apart.alias("apart"), F.col("lead.cls").alias("a"))).alias("best")
        pairs = stored(pairs.groupBy(F.col("own.cls").alias("b")).agg(nearest).select("best.a", "b"), "similar-pairs")
        tried = pairs.count()
        linked = groups.linked(pairs) if tried else 0
        if linked:
            bands = _open_bands(groups, bands)
        turn += 1
        if linked * how.productive < tried or not linked:
            break

    tiles = _tiles(bands, how)
    found = tiles.repartition("key", "tile").sortWithinPartitions("key", "tile").mapInArrow(_candidates(how), "cls long, root long, other long")
    found = stored(found.distinct(), "similar-candidates")
    grouped = stored(components(found.select(F.col("root").alias("a"), F.col("other").alias("b"))), "similar-grouped")
    own = classes.select("cls", F.struct("cls", "n", *PLANES).alias("own"))
    left = found.select("cls", "root").distinct().join(grouped.select(F.col("id").alias("root"), F.col("root").alias("key")), "root")
    left = stored(left.join(own, "cls").select("key", "own", "root"), "similar-left")
    tiles = _tiles(left, how, with_sets=True).join(groups.sets, "cls").repartition("key", "tile").sortWithinPartitions("key", "tile")
    links = stored(tiles.mapInArrow(_compared(how), "a long, b long"), "similar-links")
    if not links.isEmpty():
        groups.merge(links)

    named = groups.placed(classes.select("cls", "first"), "cls", "root")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stored(named.join(least, "root").select("cls", "component_id"), "similar-named")
    return codes.select("doc_id", "cls").join(named, "cls").select("doc_id", "component_id")


def keep_one(docs: DataFrame, how: Similar | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, all columns kept: the row with the smallest id, or the first among rows
    that share it or have none. Rows are told apart by a number given when they are stored."""
    key = "_similar_row"
    numbered = stored(docs.withColumn(key, F.monotonically_increasing_id()), "similar-rows")
    found = similar_documents(numbered, how, key, text_col)
    ids = found.withColumnRenamed("doc_id", key).join(numbered.select(key, F.col(id_col).alias("id")), key)
    best = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col(key).alias("row")))
    kept = ids.groupBy("component_id").agg(best.alias("best")).select(F.col("best.row").alias(key))
    return numbered.join(kept, key, "left_semi").select(*(numbered[c] for c in docs.columns))
