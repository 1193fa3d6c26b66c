"""Exact duplicates by composable polynomial fingerprints, confirmed by comparing the texts chunk by chunk.

A text is cut into chunks of bytes. The fingerprint of bytes b_0..b_(n-1) is sum b_i * B^(n-1-i) modulo four primes, so
the fingerprint of two strings in a row is H(xy) = H(x) * B^|y| + H(y): each chunk is hashed by whichever task reads
it, shifted by the number of bytes that follow it, and a grouped sum puts the text together, in any order. Inside a
chunk the same rule joins blocks of 256 bytes, whose sums stay below 2^53 and are one exact product of matrices.

Texts of one length and fingerprint are a class. Every member is then compared with the row that the class keeps, chunk
by chunk in a join. A member that differs anywhere leaves for a class of its own kind in the next round, so the result
is exact whatever the fingerprints do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces_of, stored, texts

BLOCK = 256
#: Blocks that are widened to doubles at a time: eight megabytes.
BLOCKS_AT_ONCE = 4096


@dataclass(frozen=True)
class Fingerprint:
    """``primes`` below 2^31 (so products fit a long), a base for each, and the bytes of a chunk. Four primes make two
    longs; smaller ones only make more work for the comparison."""

    primes: tuple[int, int, int, int] = (2147483647, 2147483629, 2147483587, 2147483579)
    bases: tuple[int, int, int, int] = (1103527590, 377401600, 1220703125, 893871739)
    chunk: int = 1 << 20
    #: Members of a class that are compared with one copy of the kept row's chunks.
    members: int = 1024


def residues(chunks: list[bytes], rule: Fingerprint) -> np.ndarray:
    """(chunks, 4) residues of whole byte strings."""
    primes = np.array(rule.primes, np.uint64)
    padded = b"".join([part for c in chunks for part in (bytes(-len(c) % BLOCK), c)])  # leading zeros add nothing
    blocks = np.frombuffer(padded, np.uint8).reshape(-1, BLOCK)
    powers = np.array([[pow(b, BLOCK - 1 - i, p) for b, p in zip(rule.bases, rule.primes, strict=True)] for i in range(BLOCK)], float)
    hashed = np.empty((len(blocks), 4), np.uint64)
    for k in range(0, len(blocks), BLOCKS_AT_ONCE):
        hashed[k : k + BLOCKS_AT_ONCE] = (blocks[k : k + BLOCKS_AT_ONCE].astype(float) @ powers).astype(np.uint64) % primes
    many = np.array([-(-len(c) // BLOCK) for c in chunks], np.int64)
    out = np.zeros((len(chunks), 4), np.uint64)
    if not len(blocks):
        return out
    step = [pow(b, BLOCK, p) for b, p in zip(rule.bases, rule.primes, strict=True)]
    shifts = np.ones((int(many.max()), 4), np.uint64)
    for i in range(1, len(shifts)):
        shifts[i] = shifts[i - 1] * np.array(step, np.uint64) % primes
    end = np.cumsum(many)
    after = np.repeat(end, many) - 1 - np.arange(len(blocks))
    full = many > 0
    starts = (end - many)[full]
    out[full] = np.add.reduceat(hashed * shifts[after] % primes, starts, axis=0) % primes
    return out


def combined(left: np.ndarray, right: np.ndarray, right_bytes: int, rule: Fingerprint) -> np.ndarray:
    """Residues of a string from those of its two parts."""
    pairs = zip(left, right, rule.bases, rule.primes, strict=True)
    return np.array([(int(x) * pow(b, right_bytes, p) + int(y)) % p for x, y, b, p in pairs], np.uint64)


def _cut(chunk: int, shape: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lower-cased chunks of every text; the first one brings the digest of the whole."""
        for batch in pieces_of(batches, "text"):
            rows = batch["row"].to_pylist()
            for first in range(0, len(rows), 1024):
                out: dict[str, list] = {name: [] for name in ("row", "at", "part", "n_bytes", "after", "text_sha256", "piece")}
                held = 0
                for at, text in enumerate(batch["text"].slice(first, 1024).cast(pa.large_binary()).to_pylist(), first):
                    text = text.lower()  # of bytes: A-Z alone
                    for part, start in enumerate(range(0, max(1, len(text)), chunk)):
                        piece = text[start : start + chunk]
                        after = len(text) - start - len(piece)
                        digest = None if part else hashlib.sha256(text).hexdigest()
                        for name, value in zip(out, (rows[at], at, part, len(text), after, digest, piece), strict=True):
                            out[name].append(value)
                        held += len(piece)
                        if held > 8 << 20:
                            yield _chunk_rows(batch, out, shape)
                            out, held = {name: [] for name in out}, 0
                if out["row"]:
                    yield _chunk_rows(batch, out, shape)

    return run


def _chunk_rows(batch: pa.RecordBatch, out: dict[str, list], shape: pa.Schema) -> pa.RecordBatch:
    ids = batch["doc_id"].take(pa.array(out["at"], pa.int64()))
    columns = {**{k: pa.array(v, shape.field(k).type) for k, v in out.items() if k != "at"}, "doc_id": ids}
    return pa.RecordBatch.from_arrays([columns[n] for n in shape.names], shape.names)


def _hash(rule: Fingerprint):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Residues of every chunk, already shifted by the bytes that follow it."""
        for batch in pieces_of(batches, "piece"):
            found = residues(batch["piece"].to_pylist(), rule)
            after = batch["after"].to_numpy()
            for k in np.flatnonzero(after):
                found[k] = combined(found[k], np.zeros(4, np.uint64), int(after[k]), rule)
            columns = [pa.array(found[:, i].astype(np.int64)) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch["row"], *columns], ["row", "r0", "r1", "r2", "r3"])

    return run


def _chunks(docs: DataFrame, rule: Fingerprint, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, part, n_bytes, after, text_sha256, piece) of every chunk, stored. The text travels to Python once."""
    kind = docs.schema[id_col].dataType
    fields = "row long, part int, n_bytes long, after long, text_sha256 string, piece binary"
    shape = T.StructType([*T.StructType.fromDDL(fields).fields, T.StructField("doc_id", kind)])
    types = [("row", pa.int64()), ("part", pa.int32()), ("n_bytes", pa.int64()), ("after", pa.int64()), ("text_sha256", pa.string()),
             ("piece", pa.binary()), ("doc_id", pa.null())]
    rows = texts(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    return stored(rows.mapInArrow(_cut(rule.chunk, pa.schema(types)), shape), "exact-chunks")


def _fingerprints(chunks: DataFrame, rule: Fingerprint) -> DataFrame:
    """(row, doc_id, n_bytes, text_sha256, f0, f1) of every row, stored. Only residues are shuffled, never texts."""
    hashed = chunks.select("row", "after", "piece").mapInArrow(_hash(rule), "row long, r0 long, r1 long, r2 long, r3 long")
    sums = hashed.groupBy("row").agg(*[(F.sum(f"r{i}") % p).alias(f"r{i}") for i, p in enumerate(rule.primes)])
    whole = sums.select(
        "row",
        (F.shiftleft("r0", 31) + F.col("r1")).alias("f0"),
        (F.shiftleft("r2", 31) + F.col("r3")).alias("f1"),
    )
    heads = chunks.where("part = 0").select("row", "doc_id", "n_bytes", "text_sha256")
    return stored(heads.join(whole, "row"), "exact-rows")


SAME = ["n_bytes", "f0", "f1"]


def _classes(rows: DataFrame) -> DataFrame:
    """Per class: its rows, and the id and row that stay: the largest id, of equal ids the first row."""
    best = F.max(F.struct("doc_id", (-F.col("row")).alias("place")))
    return rows.groupBy(*SAME).agg(F.count("*").alias("group_size"), best.alias("best")).select(
        *SAME, "group_size", F.col("best.doc_id").alias("keep_id"), (-F.col("best.place")).alias("keep_row")
    )


def _refuted(chunks: DataFrame, members: DataFrame, rule: Fingerprint) -> DataFrame:
    """Rows of classes of two and more that differ from the row their class keeps. The kept row's chunks are repeated
    once for every ``rule.members`` members, so no join key has more rows than that."""
    copies = F.ceil(F.col("group_size") / rule.members).cast("int")
    others = members.where("row <> keep_row").select(
        "row", "keep_row", F.pmod(F.xxhash64("row"), copies).cast("int").alias("copy"), F.lit(False).alias("leads")
    )
    leads = members.where("row = keep_row").select(
        "row", "keep_row", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"), F.lit(True).alias("leads")
    )
    # A hash table of the short list in every partition: the texts stream past it and are never sorted.
    asked = others.union(leads).hint("shuffle_hash")
    pieces = stored(chunks.select("row", "part", "piece").join(asked, "row"), "exact-pieces")
    key = ["keep_row", "copy", "part"]
    kept = pieces.where("leads").select(*key, F.col("piece").alias("kept_piece"))
    pairs = pieces.where("not leads").join(kept, key, "left")
    return pairs.where(~F.col("piece").eqNullSafe(F.col("kept_piece"))).select("row").distinct()


def exact_groups(
    docs: DataFrame, rule: Fingerprint | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(row, doc_id, keep_id, group_size, kept, text_sha256, n_bytes) of every row: the id that stays of all rows whose
    texts are equal after lower-casing A-Z, their number, whether this row stays, and digest and length of the
    lower-cased text.

    The row with the largest id stays; a row without an id only if no other of its group has one; of rows that repeat
    the id, one stays. A missing text is an empty one, and all empty texts are one group. Very long texts are cut into
    chunks, never shortened. Repeated rows are rows of their own. Other columns are left out, whatever their names; an
    empty table gives an empty result. ``row`` is a number given to each row of this call.
    """
    rule = rule or Fingerprint()
    chunks = _chunks(docs, rule, id_col, text_col)
    rest, settled = _fingerprints(chunks, rule), []
    columns = ["row", "doc_id", "keep_id", "keep_row", "group_size", "text_sha256", "n_bytes"]
    while True:
        classes = stored(_classes(rest), "exact-classes")
        single = classes.where("group_size = 1")
        several = stored(rest.join(classes.where("group_size > 1"), SAME), "exact-members")
        wrong = stored(_refuted(chunks, several, rule), "exact-refuted")
        alone = rest.join(single.select(F.col("keep_row").alias("row")), "row", "left_semi").select(
            "row", "doc_id", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("group_size"),
            "text_sha256", "n_bytes",
        )
        if wrong.isEmpty():
            settled.append(alone.union(several.select(*columns)))
            break
        right = several.join(wrong, "row", "left_anti")
        sizes = right.groupBy("keep_row").agg(F.count("*").alias("group_size"))
        settled.append(alone.union(right.drop("group_size").join(sizes, "keep_row").select(*columns)))
        rest = stored(several.join(wrong, "row", "left_semi").select(*rest.columns), "exact-rows")
    found = settled[0]
    for more in settled[1:]:
        found = found.union(more)
    return found.select(
        "row", "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256", "n_bytes"
    )


def keep_one(docs: DataFrame, rule: Fingerprint | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept. Odd rows as in :func:`exact_groups`."""
    key = "_exact_row"
    numbered = stored(docs.withColumn(key, F.monotonically_increasing_id()), "exact-input")
    # The row's number settles equal ids here, so the two are compared together.
    order = F.struct(F.col(id_col).alias("id"), (-F.col(key)).alias("place")).alias("doc_id")
    groups = exact_groups(numbered.select(order, F.col(text_col).alias("text")), rule)
    kept = groups.where("kept").select((-F.col("doc_id.place")).alias(key))
    return numbered.join(kept, key, "left_semi").drop(key)
