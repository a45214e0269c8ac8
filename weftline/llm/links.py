"""Connected components over a table of links, and the local reduction that keeps such tables small."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.frames import in_few_files
from weftline.session import cut_lineage


def local_labels(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the given links and, for each, the smallest node it reaches through them."""
    nodes, flat = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = flat[: len(left)], flat[len(left) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if np.array_equal(label, before):
            return nodes, nodes[label]


def spanning(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links as connect the same nodes: each node to the smallest one of its component."""
    if not len(left):
        return left, right
    nodes, label = local_labels(left, right)
    moved = nodes != label
    return nodes[moved], label[moved]


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.min("b")).first())


def _large_star(links: DataFrame, rows: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # Written first, so that both join sides are bare shuffles and a hub's rows can be split.
    joined = both.where("v > u").join(cut_lineage(in_few_files(least, 2 * rows)), "u")
    return joined.select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame, rows: int) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = cut_lineage(in_few_files(links.groupBy("a").agg(F.min("b").alias("m")), rows))
    moved = links.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node of its component.

    Alternating large and small stars: the number of rounds grows with the logarithm of the longest
    chain. Links of a node to itself and repeated links change nothing; a null end is ignored.
    """
    ordered = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = cut_lineage(ordered)
    state = _state(current)
    while rows := state[0]:
        larger = cut_lineage(in_few_files(_large_star(current, rows), rows))
        # At most one more link for each node that is an end.
        current = cut_lineage(in_few_files(_small_star(larger, 2 * rows), 2 * rows))
        after = _state(current)
        if after == state:
            break
        state = after
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        current.select("b", "b").distinct()
    )
