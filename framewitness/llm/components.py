"""Connected components of a table of links, by forests inside tasks and pointer jumping."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewitness.llm.shared import written


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node but the smallest of its component once, linked with that smallest one."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    while True:
        apart = root[a] != root[b]
        if not apart.any():
            break
        a, b = root[a[apart]], root[b[apart]]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    inner = root != np.arange(len(nodes))
    return nodes[inner], nodes[root[inner]]


def _forests(links: DataFrame) -> DataFrame:
    """The links of each task as its forest."""

    def run(batches):
        found = [[batch.column(c).to_numpy() for c in ("u", "v")] for batch in batches if batch.num_rows]
        if found:
            u, v = forest(*(np.concatenate(x) for x in zip(*found)))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return links.select("u", "v").mapInArrow(run, "u long, v long")


def linked(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it is linked with over any way, of every
    node that is not a root itself; a written table.

    ``links`` has two long columns u and v, not null. A round makes a forest of the links
    inside each task that reads them, so that a node meets at most one smaller node a task.
    Of those the smallest becomes its parent and the parent of the others; then a node
    whose parent has a parent itself goes on to that. The links never get more. The rounds
    end when nothing changes; they grow with the logarithm of the longest way. The join is
    a plain equi-join, whose hot keys adaptive execution splits, so that a node with a
    third of all links is no single task's work.
    """
    links = written(links.select("u", "v"), "links")
    while True:
        links = written(_forests(links), "forests")
        met = links.groupBy("u").agg(F.min("v").alias("v"), F.collect_set("v").alias("all"))
        lower = met.select(F.col("u").alias("v"), F.col("v").alias("lower"))
        others = F.filter("all", lambda x: x != F.col("v"))
        moved = F.struct("u", F.coalesce("lower", "v").alias("v"), (F.col("lower").isNotNull() | (F.size("all") > 1)).alias("again"))
        joined = F.transform(others, lambda x: F.struct(x.alias("u"), F.col("v").alias("v"), F.lit(True).alias("again")))
        jumped = met.join(lower, "v", "left").select(F.inline(F.concat(F.array(moved), joined)))
        links = written(jumped, "links")
        if not links.agg(F.max("again")).first()[0]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))


def components(links: DataFrame) -> DataFrame:
    """``linked``, and a row for each root. Nodes without a link are not in the result."""
    found = linked(links)
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
