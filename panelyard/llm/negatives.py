"""Hard negatives: best-first search of a packed R-tree for rows whose inner products fall into a window.

Vectors are made integers, so scores are exact. The rows are packed by sort-tile-recursive order: cut by quantiles of the
first coordinate, each slab by quantiles of the second, and what is still too large by a hash; the cells are the tree's
pages of a few thousand rows, each held by one task. A page is packed the same way inside, along its coordinates of most
spread, into leaves and nodes over them. The box of a node bounds the inner product with an anchor coordinate by
coordinate. A queue opens the box with the highest bound first and leaves out boxes that miss every window of the anchor
or lie strictly below the k-th score found.

An anchor searches its own page first. With the scores found there it visits only the pages whose boxes can still hold
better rows; boxes of pages, and rows of pages, meet the anchors in streams that are sorted by node, cut so that neither
the anchors nor the pages of one task grow with the table.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


@dataclass(frozen=True)
class Tree:
    """Rows of a page and of a leaf, children of a node inside a page, pages below one node over them, and the anchors
    that one task takes through a page."""

    page: int = 8192
    leaf: int = 256
    fan_out: int = 8
    upper: int = 1024
    anchors: int = 16384
    scale: float = 256.0


#: Integer components stay below this, so a product of vectors of 256 components fits a long.
LARGEST = 2.0**27
NO_FLOOR = -(2**62)
#: What travels to a node: its own rows or boxes (``role`` 0), then the anchors that visit it (``role`` 1). ``asks`` are
#: the anchor's windows, flat: lowest score, highest score, and the k-th score found so far, for each.
STREAM = "node string, slice int, role int, row long, id long, label long, page string, vector array<long>, asks array<long>"
FOUND = "row long, ask int, found_row long, found_id long, score long"


def _prepared(rows: DataFrame, anchor: Column, id_col: str, label_col: str, vector_col: str, scale: float) -> DataFrame:
    whole = F.transform(vector_col, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    usable = F.forall(vector_col, lambda x: x.isNotNull() & (F.abs(x.cast("double") * scale) < LARGEST))
    good = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.coalesce(usable, F.lit(False)))
    return good.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("long").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("asks_for"),
        whole.cast("array<long>").alias("vector"),
    )


def _place(cuts: Column, value: Column) -> Column:
    return F.coalesce(F.size(F.filter(cuts, lambda c: c <= value)), F.lit(0))


def _paged(rows: DataFrame, tree: Tree) -> DataFrame:
    """``rows`` with their page, for each length of vectors on its own. The tables of cuts hold as many numbers as there
    are pages, a few thousandths of the rows; equal coordinates that overfill a cell are dealt by a hash."""
    rows = rows.withColumn("size", F.size("vector"))
    rows = rows.withColumns({"x0": F.get("vector", F.lit(0)), "x1": F.get("vector", F.lit(1))})
    pages = math.ceil(rows.count() / tree.page)
    slabs = max(1, math.ceil(math.sqrt(pages)))
    shares = F.lit([k / slabs for k in range(1, slabs)]).cast("array<double>")
    if slabs > 1:
        first = rows.groupBy("size").agg(F.percentile_approx("x0", shares, 10000).alias("cuts"))
        rows = rows.join(first, "size").withColumn("slab", _place(F.col("cuts"), F.col("x0"))).drop("cuts")
        second = rows.groupBy("size", "slab").agg(F.percentile_approx("x1", shares, 10000).alias("cuts"))
        rows = rows.join(second, ["size", "slab"]).withColumn("cell", _place(F.col("cuts"), F.col("x1"))).drop("cuts")
    else:
        rows = rows.withColumns({"slab": F.lit(0), "cell": F.lit(0)})
    key = ["size", "slab", "cell"]
    parts = rows.groupBy(*key).agg(F.ceil(F.count("*") / tree.page).alias("parts"))
    part = F.pmod(F.xxhash64("row"), F.col("parts"))
    return rows.join(parts, key).select("row", "id", "label", "asks_for", "vector", F.concat_ws("-", *key, part).alias("page"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _exact(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same matrices in the smallest type that holds their inner products exactly."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * x.shape[1]
    kind = np.float32 if most < 2.0**24 else np.float64 if most < 2.0**53 else np.int64
    return x.astype(kind, copy=False), y.astype(kind, copy=False)


def packed_order(x: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Positions of the rows of each leaf, in sort-tile-recursive order along the coordinates of most spread."""
    deep = max(1, math.ceil(math.log2(max(2, math.ceil(len(x) / leaf)))))
    axes = np.argsort(-x.var(axis=0), kind="stable")[:deep]
    leaves: list[np.ndarray] = []

    def tile(at: np.ndarray, depth: int) -> None:
        many = math.ceil(len(at) / leaf)
        if many <= 1 or depth == len(axes):
            leaves.extend(at[k : k + leaf] for k in range(0, len(at), leaf))
            return
        slabs = math.ceil(many ** (1 / (len(axes) - depth)))
        wide = math.ceil(many / slabs) * leaf
        at = at[np.argsort(x[at, axes[depth]], kind="stable")]
        for k in range(0, len(at), wide):
            tile(at[k : k + wide], depth + 1)

    tile(np.arange(len(x)), 0)
    return leaves


class Page:
    """One page of the tree: rows in packed order, boxes of leaves and of the nodes above them, root last."""

    def __init__(self, row: np.ndarray, ids: np.ndarray, label: np.ndarray, x: np.ndarray, tree: Tree):
        order = packed_order(x, tree.leaf)
        self.span = np.cumsum([0, *[len(o) for o in order]])
        at = np.concatenate(order)
        self.row, self.ids, self.label, self.x = row[at], ids[at], label[at], x[at]
        low, high = np.minimum.reduceat(self.x, self.span[:-1]), np.maximum.reduceat(self.x, self.span[:-1])
        lows, highs, self.children = [low], [high], [range(0)] * len(low)
        base = 0
        while len(low) > 1:
            first = np.arange(0, len(low), tree.fan_out)
            self.children += [range(base + f, base + min(f + tree.fan_out, len(low))) for f in first]
            base += len(low)
            low, high = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
            lows.append(low)
            highs.append(high)
        self.low, self.high = np.concatenate(lows), np.concatenate(highs)
        self.leaves = len(order)

    def search(self, anchors: list[tuple], x: np.ndarray, k: int, same: bool) -> list[tuple]:
        """(anchor's row, ask, found row, found id, score) of the best ``k`` in every window."""
        below, above = bounds(self.low, self.high, x)
        out = []
        for n, (row, label, asks) in enumerate(anchors):
            vector = x[n]
            windows = [[asks[i], asks[i + 1], asks[i + 2], []] for i in range(0, len(asks), 3)]
            queue = [(-above[n, -1], len(self.children) - 1)]
            while queue:
                top, node = heapq.heappop(queue)
                top = -top
                if top < min(max(w[0], w[2]) for w in windows):
                    break  # every box left is lower still
                live = [w for w in windows if top >= max(w[0], w[2]) and below[n, node] <= w[1]]
                if not live:
                    continue
                if node >= self.leaves:
                    for child in self.children[node]:
                        heapq.heappush(queue, (-above[n, child], child))
                    continue
                first, last = self.span[node], self.span[node + 1]
                scores = self.x[first:last] @ vector
                # Most rows lie below every window's floor; the few others are looked at closely.
                hit = np.flatnonzero(scores >= min(max(w[0], w[2]) for w in live))
                hit = hit[(self.label[first + hit] == label) == same]
                if same:
                    hit = hit[self.row[first + hit] != row]
                if not len(hit):
                    continue
                score = scores[hit].astype(np.int64)
                hit += first
                order = np.lexsort((self.row[hit], self.ids[hit], -score))
                found = list(zip((-score[order]).tolist(), self.ids[hit[order]].tolist(), self.row[hit[order]].tolist(), strict=True))
                for w in live:
                    least, most = max(w[0], w[2]), w[1]
                    fits = (f for f in found if least <= -f[0] <= most)
                    w[3] = sorted(w[3] + list(itertools.islice(fits, k)))[:k]
                    if len(w[3]) == k:
                        w[2] = max(w[2], -w[3][-1][0])
            for number, w in enumerate(windows):
                out += [(row, number, found, found_id, -score) for score, found_id, found in w[3]]
        return out


def bounds(low: np.ndarray, high: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each row of ``x`` with each box."""
    plus, minus = np.maximum(x, 0), np.minimum(x, 0)
    return plus @ low.T + minus @ high.T, plus @ high.T + minus @ low.T


def _streamed(begin, visit):
    """Runs over rows sorted by node, slice and role: ``begin(rows)`` of the node's own, ``visit(held, anchors)`` for
    each batch of anchors behind them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, held = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = pa.compute.binary_join_element_wise(batch["node"], batch["slice"].cast(pa.string()), "/").to_numpy(zero_copy_only=False)
            role = batch["role"].to_numpy()
            cut = np.flatnonzero((names[1:] != names[:-1]) | (role[1:] != role[:-1])) + 1
            for a, b in zip([0, *cut], [*cut, batch.num_rows], strict=True):
                part = batch.slice(a, b - a)
                if names[a] != key:
                    key, own, held = names[a], [], None
                if role[a] == 0:
                    own.append(part)
                    continue
                if held is None:
                    if not own:  # a node without rows of its own has nothing to find
                        continue
                    held = begin(pa.Table.from_batches(own).combine_chunks())
                    own = []
                for k in range(0, part.num_rows, 512):
                    out = visit(held, part.slice(k, 512))
                    if out is not None:
                        yield out

    return run


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table[name]
    return column.chunk(0) if column.num_chunks else pa.array([], column.type)


def _page_search(k: int, same: bool, tree: Tree):
    def begin(table: pa.Table) -> Page:
        row, ids, label = (_column(table, n).to_numpy() for n in ("row", "id", "label"))
        return Page(row, ids, label, _matrix(_column(table, "vector")), tree)

    def visit(page: Page, batch: pa.RecordBatch) -> pa.RecordBatch | None:
        page.x, x = _exact(page.x, _matrix(batch["vector"]))
        page.low, page.high = page.low.astype(x.dtype), page.high.astype(x.dtype)
        anchors = list(zip(*(batch[n].to_pylist() for n in ("row", "label", "asks")), strict=True))
        found = page.search(anchors, x, k, same)
        if not found:
            return None
        columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["row", "ask", "found_row", "found_id", "score"])

    return _streamed(begin, visit)


def _upper_search():
    """Anchors that reach a node over pages go on to the pages, but for their own, whose boxes meet one of their windows."""

    def begin(table: pa.Table):
        box = _matrix(_column(table, "vector"))
        half = box.shape[1] // 2
        return _column(table, "page"), box[:, :half], box[:, half:]

    def visit(held, batch: pa.RecordBatch) -> pa.RecordBatch | None:
        pages, low, high = held
        low, x = _exact(low, _matrix(batch["vector"]))
        high, x = _exact(high, x)
        low, x = low.astype(x.dtype), x.astype(high.dtype)
        below, above = bounds(low, high, x)
        asks = batch["asks"].to_pylist()
        home = batch["page"].to_pylist()
        names = pages.to_pylist()
        at, to = [], []
        for n, flat in enumerate(asks):
            ask = np.array(flat, np.int64).reshape(-1, 3)
            least = np.maximum(ask[:, 0], ask[:, 2])
            meets = ((above[n][:, None] >= least) & (below[n][:, None] <= ask[:, 1])).any(axis=1)
            for page in np.flatnonzero(meets):
                if names[page] != home[n]:
                    at.append(n)
                    to.append(names[page])
        if not at:
            return None
        taken = batch.take(pa.array(at, pa.int64()))
        columns = {**{n: taken[n] for n in ("row", "id", "label", "vector", "asks")}, "page": pa.array(to, pa.string())}
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return _streamed(begin, visit)


def _boxes():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Box of every page: the least values, then the greatest, of its rows' components."""
        key, low, high = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch["page"].to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(names[1:] != names[:-1]) + 1
            for a, b in zip([0, *cut], [*cut, batch.num_rows], strict=True):
                x = _matrix(batch["vector"].slice(a, b - a))
                if names[a] != key:
                    if key is not None:
                        yield _box_row(key, low, high)
                    key, low, high = names[a], x.min(axis=0), x.max(axis=0)
                low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        if key is not None:
            yield _box_row(key, low, high)

    return run


def _box_row(page: str, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    box = np.concatenate([low, high]).astype(np.int64).tolist()
    return pa.RecordBatch.from_arrays([pa.array([page]), pa.array([box], pa.list_(pa.int64()))], ["page", "vector"])


def _meeting(own: DataFrame, anchors: DataFrame, slices: int) -> DataFrame:
    """One stream of nodes' own rows and their anchors. Anchors are dealt over ``slices`` by hash, and own rows go to
    each slice, so an often visited node is many tasks' work."""
    cut = F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int")
    nothing = F.lit(None).cast("array<long>")
    every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    left = own.select("node", every.alias("slice"), F.lit(0).alias("role"), "row", "id", "label", "page", "vector", nothing.alias("asks"))
    right = anchors.select("node", cut.alias("slice"), F.lit(1).alias("role"), "row", "id", "label", "page", "vector", "asks")
    return left.union(right).repartition("node", "slice").sortWithinPartitions("node", "slice", "role").select(
        *[part.split()[0] for part in STREAM.split(", ")]
    )


@dataclass
class Index:
    """The stored tree: rows with their pages, and the boxes of the pages under their upper nodes."""

    rows: DataFrame
    boxes: DataFrame
    tree: Tree
    slices: int
    uppers: int


def build_index(rows: DataFrame, anchor: Column, tree: Tree, id_col: str, label_col: str, vector_col: str) -> Index:
    prepared = stored(_prepared(rows, anchor, id_col, label_col, vector_col, tree.scale), "negatives-rows")
    paged = stored(_paged(prepared, tree), "negatives-pages")
    sorted_pages = paged.select("page", "vector").repartition("page").sortWithinPartitions("page")
    boxes = stored(sorted_pages.mapInArrow(_boxes(), "page string, vector array<long>"), "negatives-boxes")
    uppers = max(1, math.ceil(boxes.count() / tree.upper))
    slices = max(1, math.ceil(paged.where("asks_for").count() / tree.anchors))
    # Vectors of one length meet boxes of that length only.
    upper = F.concat_ws("/", F.split_part("page", F.lit("-"), F.lit(1)), F.pmod(F.xxhash64("page"), F.lit(uppers)))
    return Index(paged, boxes.withColumn("node", upper), tree, slices, uppers)


def best(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of every window of every anchor: by score, ties by id, then by row. Spark keeps ``k`` rows of a
    window in each task before it shuffles."""
    order = Window.partitionBy("row", "ask").orderBy(F.desc("score"), "found_id", "found_row")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def search(index: Index, anchors: DataFrame, k: int, same: bool) -> DataFrame:
    """(row, ask, found_row, found_id, score, place) for ``anchors`` (row, id, label, page, vector, asks)."""
    own = index.rows.select(F.col("page").alias("node"), "row", "id", "label", "page", "vector")
    run = _page_search(k, same, index.tree)
    home = anchors.withColumn("node", F.col("page"))
    near = stored(best(_meeting(own, home, index.slices).mapInArrow(run, FOUND), k), "negatives-home")
    floors = near.where(F.col("place") == k).select("row", "ask", "score").groupBy("row").agg(
        F.map_from_entries(F.collect_list(F.struct("ask", "score"))).alias("floors")
    )
    asks = F.transform(
        "asks",
        lambda value, i: F.when(
            (i % 3 == 2) & F.col("floors").isNotNull(),
            F.coalesce(F.try_element_at("floors", F.floor(i / 3).cast("int")), value),
        ).otherwise(value),
    )
    raised = stored(anchors.join(floors, "row", "left").withColumn("asks", asks).drop("floors"), "negatives-floors")
    size = F.size("vector").cast("string")
    over = raised.withColumn("upper", F.explode(F.sequence(F.lit(0), F.lit(index.uppers - 1))))
    over = over.withColumn("node", F.concat_ws("/", size, F.col("upper"))).drop("upper")
    blank = F.lit(None).cast("long")
    boxes = index.boxes.select("node", blank.alias("row"), blank.alias("id"), blank.alias("label"), "page", "vector")
    shape = "row long, id long, label long, vector array<long>, asks array<long>, page string"
    visits = _meeting(boxes, over, index.slices).mapInArrow(_upper_search(), shape)
    away = visits.withColumn("node", F.col("page"))
    far = _meeting(own, away, index.slices).mapInArrow(run, FOUND)
    return best(near.drop("place").union(far), k)


def hard_negatives(
    rows: DataFrame,
    anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    window: tuple[int, int] = (50, 95),
    tree: Tree | None = None,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Scores are inner products of the integer vectors floor(``tree.scale`` * x); higher ones come first, ties by the
    smaller id. Anchors are the rows for which ``anchor`` is true. Their positives are the first other rows of the same
    label, and for each of them the first rows of other labels are returned whose score is between ``window`` percent
    of the positive's, both ends included. Fewer rows are returned where there are fewer.

    Rows without id, label or vector, with a missing or non-finite component, or with one of 2^27 and more once scaled,
    take no part. Vectors are compared with those of their own length only, however long; the empty vector scores zero
    with its like. Rows that share an id or are equal are rows of their own, and a repeated anchor gives its results
    again. Other columns are left out, whatever their names; an empty table gives an empty result.
    """
    tree = tree or Tree()
    index = build_index(rows, anchor, tree, id_col, label_col, vector_col)
    asking = index.rows.where("asks_for").select("row", "id", "label", "page", "vector")
    everything = F.array(*[F.lit(v).cast("long") for v in (NO_FLOOR, -NO_FLOOR, NO_FLOOR)])
    near = stored(search(index, asking.withColumn("asks", everything), positives, True), "negatives-positives")
    low, high = window
    # The least and greatest whole scores of the window, by exact division.
    share = F.col("score").cast("decimal(20,0)") / F.lit(100)
    ends = F.array(F.ceil(share * low).cast("long"), F.floor(share * high).cast("long"), F.lit(NO_FLOOR).cast("long"))
    asked = near.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", ends.alias("ends")))).alias("sorted"))
    asked = asked.select("row", F.flatten(F.transform("sorted", lambda s: s["ends"])).alias("asks"))
    found = search(index, asking.join(asked, "row"), negatives, False)
    named = near.select("row", (F.col("place") - 1).alias("ask"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (
        found.join(named, ["row", "ask"])
        .join(asking.select("row", F.col("id").alias("anchor_id")), "row")
        .select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("found_id").alias("negative_id"), "positive_score",
                F.col("score").alias("negative_score"))
    )
