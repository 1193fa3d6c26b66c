"""Embedding near-duplicates: all pairs of a cosine or more, by int8 tile products with exact error bounds.

Unit vectors are dealt to the nearest of some pivots. By the triangle inequality for angles, a vector can only be
linked into a pivot's cell when its angle to the pivot is at most the cell's radius plus the threshold's angle, so
it is sent to those cells alone. Cells are cut into blocks; a pair of blocks is a tile, done by one product of int8
matrices. For each vector the quantisation error is known exactly, which bounds the error of each product; only pairs
that may reach the threshold are computed again in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .graph import components, merge_labels


@dataclass(frozen=True)
class Tiling:
    """``block``: vectors in a block; a vector travels once for each block it may have links in. ``pivots``: most pivots, a bounded sample; they steer the work alone, as any
    set of pivots gives all pairs."""

    block: int = 8192
    pivots: int = 64


def usable(vector: Column) -> Column:
    """True for a vector that has a direction: not missing, no missing or non-finite component, not all zero."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(wide, lambda x: x.isNotNull() & (F.abs(x) < math.inf) & ~F.isnan(x))
    return F.coalesce(vector.isNotNull() & finite & F.exists(wide, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so squares of extreme values do not overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, their scale, and the length of what the codes leave out, for each row."""
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None])
    error = np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes.astype(np.int8), scale, error


#: Rows of a product at a time: bounds the memory of a tile, whose blocks are larger.
PRODUCT_ROWS = 1024


def tile_links(left: np.ndarray, right: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) with a cosine of at least ``least`` between unit rows of ``left`` and ``right``, in parts.

    With x = q + e, |x.y - q.r| <= |q||f| + |e||y|: the product of the codes is exact (integers below 2^24 in single
    precision for up to 1,000 components, doubles beyond), so pairs below the threshold by more than this bound are
    settled without the full product.
    """
    kind = np.float32 if left.shape[1] <= 1000 else np.float64
    (a, sa, ea), (b, sb, eb) = quantised(left), quantised(right)
    norm = np.sqrt((a.astype(np.float64) ** 2).sum(axis=1)) * sa
    slack = 1e-6  # of the scaling of the exact product in single precision
    for r in range(0, len(left), PRODUCT_ROWS):
        for c in range(0, len(right), PRODUCT_ROWS):
            rows, columns = slice(r, r + PRODUCT_ROWS), slice(c, c + PRODUCT_ROWS)
            lowest = (least - slack - ea[rows])[:, None] - norm[rows, None] * eb[None, columns]
            product = a[rows].astype(kind) @ b[columns].astype(kind).T
            i, j = np.nonzero(product >= (lowest / sa[rows, None] / sb[None, columns]).astype(kind))
            for k in range(0, len(i), 1 << 16):
                at, to = i[k : k + (1 << 16)] + r, j[k : k + (1 << 16)] + c
                sure = (left[at] * right[to]).sum(axis=1) >= least
                yield at[sure], to[sure]


def _cells(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Home cell and angle to its pivot."""
        for batch in batches:
            if not batch.num_rows:
                continue
            cosines = np.clip(_unit(_matrix(batch["vector"])) @ pivots.T, -1, 1)
            home = cosines.argmax(axis=1)
            angle = np.arccos(cosines[np.arange(len(home)), home])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(home.astype(np.int32)), pa.array(angle)], [*batch.schema.names, "cell", "angle"]
            )

    return run


def _dealt(pivots: np.ndarray, radius: np.ndarray, blocks: np.ndarray, reach: float):
    """One row for each tile a vector takes part in: the pair of its own block and another, smaller one first."""
    offset = np.cumsum(blocks) - blocks  # blocks are numbered through all cells
    total = int(blocks.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                unit = _unit(_matrix(part["vector"]))
                angle = np.arccos(np.clip(unit @ pivots.T, -1, 1))
                own = offset[part["cell"].to_numpy()] + part["block"].to_numpy()
                row, cell = np.nonzero((angle <= radius[None, :] + reach + 1e-6) & (blocks > 0)[None, :])
                many = blocks[cell]
                row = np.repeat(row, many)
                other = np.repeat(offset[cell], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                tile = np.minimum(own[row], other) * total + np.maximum(own[row], other)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tile), pa.array(own[row]), part["class_id"].take(at), part["n"].take(at), part["vector"].take(at)],
                    ["tile", "block", "class_id", "n", "vector"],
                )

    return run


def _tiles(least: float):
    """For each tile, the vectors with links: (class_id, linked rows, root of its set in this tile)."""

    def tile(block: np.ndarray, ids: np.ndarray, n: np.ndarray, unit: np.ndarray) -> pa.RecordBatch:
        first, second = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        links, labels = np.zeros(len(ids), np.int64), np.arange(len(ids))
        apart = block.min() != block.max()
        for i, j in tile_links(unit[first], unit[second], least):
            i, j = first[i], second[j]
            if not apart:  # each pair once
                once = i < j
                i, j = i[once], j[once]
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            merge_labels(labels, i, j)
        hit = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[hit]), pa.array(links[hit]), pa.array(ids[labels[hit]])], ["class_id", "links", "root"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by tile, whose size is bounded by two blocks."""
        held: list[pa.RecordBatch] = []

        def done(parts: list[pa.RecordBatch], total: list[int]) -> pa.RecordBatch | None:
            table = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            block = table["block"].to_numpy()
            # A tile of two blocks of which one sent nothing has no pairs; its number tells which tiles are diagonal.
            number = int(table["tile"][0].as_py())
            diagonal = number // total[0] == number % total[0]
            if not diagonal and block.min() == block.max():
                return None
            return tile(
                block, table["class_id"].to_numpy(), table["n"].to_numpy(), _unit(_matrix(table["vector"]))
            )

        total: list[int] = []
        for batch in batches:
            if not total and batch.num_rows:
                total.append(batch["total"][0].as_py())
            tiles = batch["tile"].to_numpy()
            cuts = [0, *(np.flatnonzero(tiles[1:] != tiles[:-1]) + 1), len(tiles)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and held[-1]["tile"][0].as_py() != int(tiles[a]):
                    if (out := done(held, total)) is not None:
                        yield out
                    held = []
                held.append(batch.slice(a, b - a))
        if held and (out := done(held, total)) is not None:
            yield out

    return run


def near_vectors(
    rows: DataFrame,
    least: float = 0.9,
    tiling: Tiling | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: rows linked directly, the smallest id reachable, and
    whether this row has that id.

    Vectors that are missing, zero, of another length than the most common one, or with missing or non-finite
    components link with nothing. Equal vectors are one class and link with each other. Rows without an id are
    counted like any other but name no component. Other columns are left out; an empty table gives an empty result.
    """
    tiling = tiling or Tiling()
    given = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))
    lengths = given.where(usable(F.col("vector"))).groupBy(F.size("vector").alias("size")).count()
    common = lengths.orderBy(F.desc("count"), "size").first()
    if common is None:
        return given.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
        )
    linked = usable(F.col("vector")) & (F.size("vector") == common["size"])
    plain = F.when(linked, F.transform("vector", lambda x: x.cast("double") + F.lit(0.0)))
    given = given.select("vec_id", plain.alias("vector"))
    good = given.where(F.col("vector").isNotNull())
    classes = stored(
        good.groupBy("vector").agg(F.count("*").alias("n"), F.min("vec_id").alias("first")).withColumn(
            "class_id", F.monotonically_increasing_id()
        ),
        "vectors",
    )
    count = classes.count()
    sample = classes.orderBy(F.xxhash64("vector")).limit(min(tiling.pivots, math.ceil(count / tiling.block)))
    pivots = _unit(np.array([r["vector"] for r in sample.select("vector").collect()]))
    shape = "class_id long, n long, vector array<double>"
    homes = stored(
        classes.select("class_id", "n", "vector").mapInArrow(_cells(pivots), f"{shape}, cell int, angle double"), "vectors"
    )
    sizes = homes.groupBy("cell").agg(F.count("*").alias("rows"), F.max("angle").alias("angle")).collect()
    radius, blocks = np.full(len(pivots), -math.inf), np.zeros(len(pivots), np.int64)
    for r in sizes:
        radius[r["cell"]], blocks[r["cell"]] = r["angle"], math.ceil(r["rows"] / tiling.block)
    cut = F.element_at(F.lit(blocks.tolist()).cast("array<long>"), F.col("cell") + 1)
    blocked = homes.withColumn("block", F.pmod(F.xxhash64("class_id"), cut))
    dealt = blocked.mapInArrow(
        _dealt(pivots, radius, blocks, math.acos(least)), "tile long, block long, class_id long, n long, vector array<double>"
    ).withColumn("total", F.lit(int(blocks.sum())).cast("long"))
    found = stored(
        dealt.repartition("tile")
        .sortWithinPartitions("tile")
        .mapInArrow(_tiles(least), "class_id long, links long, root long"),
        "vector-links",
    )
    joined = components(found.select(F.col("class_id").alias("a"), F.col("root").alias("b")))
    joined = joined.withColumnRenamed("id", "class_id")
    members = joined.join(classes.select("class_id", "first"), "class_id")
    least_id = members.groupBy("root").agg(F.min("first").alias("least"))
    roots = joined.join(least_id, "root").select("class_id", "least")
    per_class = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    named = (
        classes.join(per_class, "class_id", "left")
        .join(roots, "class_id", "left")
        .select(
            "vector",
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("least", "first").alias("component_id"),
        )
    )
    out = given.join(named, "vector", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
