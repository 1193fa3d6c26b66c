"""Connected components of links between long ids, on tables of any size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def merge_labels(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Join the sets of linked positions, in place; a label is a position, finally the smallest of its set."""
    while len(left):
        a, b = labels[left], labels[right]
        apart = a != b
        if not apart.any():
            return
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels[:] = up


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id in ``links`` (a, b): root is the smallest id that can be reached.

    Alternating large and small stars: every id is linked to its smallest neighbour until the links form stars. A
    star's centre may be in any share of all links: smallest neighbours are aggregates, which combine before the
    shuffle, and the joins on a centre are plain joins that Spark can split. Links with a missing end and links of
    an id to itself are left out. Each round is written to the shared folder; rounds grow with the logarithm of the
    longest path. No links give an empty result.
    """
    edges = stored(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct(),
        "links",
    )
    before = None
    while True:
        ends = edges.select(F.col("hi").alias("at"), F.col("lo").alias("other")).union(edges.select("lo", "hi"))
        least = ends.groupBy("at").agg(F.least(F.min("other"), F.first("at")).alias("least"))
        large = (
            edges.join(least, edges["lo"] == least["at"])
            .select("hi", F.col("least").alias("lo"))
            .where("hi <> lo")
            .distinct()
        )
        lowest = large.groupBy("hi").agg(F.min("lo").alias("least"))
        small = large.join(lowest, "hi").select(F.col("lo").alias("hi"), F.col("least").alias("lo")).where("hi <> lo")
        edges = stored(small.union(lowest.select("hi", "least")).distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    return edges.select(F.col("hi").alias("id"), F.col("lo").alias("root")).union(edges.select("lo", "lo").distinct())
