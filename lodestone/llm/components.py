"""Connected components of a graph given as a table of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.store import discard, stored


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    rest = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _signature(e: DataFrame):
    return e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root): each node that has a link, and the smallest node that it reaches.

    ``links`` holds two long columns, in either direction, repeats allowed;
    rows with a null end or equal ends are no links. Alternates large-star and
    small-star steps (Kiveris et al., 2014): every step keeps at most as many
    rows as there are links, the number of steps grows with the logarithm of
    the longest chain. Each round is written to the shared folder. A hub's rows
    meet its minimum in a plain join, which adaptive execution splits; minima
    and ``distinct`` are combined before the shuffle.
    """
    e = links.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).where(
        F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right))).distinct()
    e = stored(e, "links")
    seen = _signature(e)
    while seen[0]:
        nxt = stored(_small_star(_large_star(e)), "stars")
        now = _signature(nxt)
        discard(e)
        e = nxt
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links (x, y) and the smallest node of each one's component: at most one row a node, however many links."""
    nodes, inv = np.unique(np.concatenate([x, y]), return_inverse=True)
    i, j = inv[:len(x)], inv[len(x):]
    lab = np.arange(len(nodes))
    while True:
        m = np.minimum(lab[i], lab[j])
        new = lab.copy()
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        new = new[new]
        if (new == lab).all():
            return nodes, nodes[lab]
        lab = new
