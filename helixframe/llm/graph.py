"""Connected components of an undirected graph held as a DataFrame of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import BROADCAST_ROWS, few, look_up, settle


#: Edges, two numbers each, that one task finishes by itself.
TAIL_EDGES = 500_000


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _parents(edges: DataFrame, n: int, step: int) -> DataFrame:
    """(v, p, n): for each node of ``n`` edges a node of its component that stands for it, and its number of edges.

    Every node takes its edge of least random weight.  These edges are trees
    but for pairs that took the same edge, of which the smaller node becomes the
    root; then every node goes up to its parent's parent.
    """
    weight = F.xxhash64(F.lit(step), "a", "b")
    ends = F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("o")), F.struct(F.col("b").alias("v"), F.col("a").alias("o")))).alias("x")
    taken = edges.select(weight.alias("w"), ends).groupBy(F.col("x.v").alias("v"))
    chosen = settle(few(taken.agg(F.min_by("x.o", F.struct("w", "x.o")).alias("p"), F.count("*").alias("n")), 2 * n))
    up = lambda table: table.select(F.col("v").alias("p"), F.col("p").alias("q"))
    root = (F.col("q") == F.col("v")) & (F.col("v") < F.col("p"))
    rooted = look_up(chosen, up(chosen), ["p"], bound=2 * n).select("v", F.when(root, F.col("v")).otherwise(F.col("p")).alias("p"), "n")
    rooted = rooted if 2 * n <= BROADCAST_ROWS else settle(rooted)
    return settle(look_up(rooted, up(rooted), ["p"], bound=2 * n).select("v", F.col("q").alias("p"), "n"))


def joined_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges ``a[i]``-``b[i]``, sorted, and the smallest node that each one reaches."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    top = np.arange(len(nodes))
    while True:
        low, high = np.minimum(top[a], top[b]), np.maximum(top[a], top[b])
        apart = low != high
        if not apart.any():
            return nodes, nodes[top]
        a, b = a[apart], b[apart]
        np.minimum.at(top, high[apart], low[apart])
        while (top[top] != top).any():
            top = top[top]


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = [(x.column("a").to_numpy(), x.column("b").to_numpy()) for x in batches if x.num_rows]
    if ends:
        nodes, labels = joined_labels(*(np.concatenate(x) for x in zip(*ends, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(labels)], ["v", "p"])


def components(links: DataFrame, smallest: bool = True, tail: int = TAIL_EDGES) -> DataFrame:
    """(node, component) for every node of ``links(a long, b long)``.

    ``component`` is the smallest node reachable, or any one of them without ``smallest``.  Each step contracts the
    graph: nodes that took an edge to each other become one, and what is left
    are the edges between different ones, once each, so edges shrink from step
    to step, until a count shows at most ``tail`` of them: one task joins these.
    The steps' tables are then followed from the last to the first.
    A node with very many edges, or children, is joined by ``look_up``, so it
    fills no task.  Nulls and self-links are ignored; no links give no rows.
    """
    # Settled before anything reads it twice: a search that depends on the order of rows may give other links the next time.
    edges = settle(links.where("a is not null and b is not null and a <> b").select(*_ordered("a", "b")))
    left, steps = edges.count(), []
    if left > tail:
        edges = settle(few(edges.distinct(), left))
        left = edges.count()
    nodes = 2 * left
    while left > tail:
        edges = few(edges, left)
        steps.append(_parents(edges, left, len(steps)))
        counts = steps[-1].select("v", F.col("n").alias("_n"))
        for end in ("a", "b"):
            table = steps[-1].select(F.col("v").alias(end), F.col("p").alias("_p"))
            moved = look_up(edges, table, [end], counts=counts.withColumnRenamed("v", end), bound=2 * left)
            edges = moved.select(*[F.col("_p").alias(end) if c == end else c for c in ("a", "b")])
        edges = settle(few(edges.where("a <> b").select(*_ordered("a", "b")).distinct(), left))
        left = edges.count()
    found = settle(edges.coalesce(1).mapInArrow(_finish, "v long, p long"))
    if not steps:
        return found.select(F.col("v").alias("node"), F.col("p").alias("component"))
    for table in reversed(steps):
        up = found.select(F.col("v").alias("p"), F.col("p").alias("_top"))
        found = settle(look_up(table.select("v", "p"), up, ["p"], "left", bound=nodes).select("v", F.coalesce("_top", "p").alias("p")))
    if not smallest:
        return found.select(F.col("v").alias("node"), F.col("p").alias("component"))
    least = settle(few(found.groupBy("p").agg(F.min("v").alias("component"), F.count("*").alias("_n")), nodes))
    named = look_up(found, least.select("p", "component"), ["p"], counts=least.select("p", "_n"), bound=nodes)
    return settle(named.select(F.col("v").alias("node"), "component"))
