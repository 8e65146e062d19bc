"""Connected components of an edge table: local forests first, then alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from foliant.runtime import Scratch

#: edges that a task gathers before it contracts them
GATHER = 1 << 18


def merged_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest-label components after adding edges a-b."""
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def _star(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components with one edge for each node but the smallest, to the smallest."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    label = merged_labels(np.arange(len(nodes)), at[: len(u)], at[len(u) :])
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[own], nodes[label[own]]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contracts a partition's edges (u, v); holds one edge for each node of the partition."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size, limit = 0, GATHER
    for batch in batches:
        if batch.num_rows:
            held.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
            size += batch.num_rows
        if size > limit:
            held = [_star(*(np.concatenate(x) for x in zip(*held)))]
            size = len(held[0][0])
            limit = max(GATHER, 2 * size)
    if held:
        u, v = _star(*(np.concatenate(x) for x in zip(*held)))
        for at in range(0, len(u), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)]) for x in (u, v)], ["u", "v"])


def connected_components(edges: DataFrame, a: str, b: str, scratch: Scratch | None = None) -> DataFrame:
    """``(node, component_id)`` for every node of an edge with two different ends.

    ``component_id`` is the smallest node of the component. Each partition first contracts its own edges
    to a star forest; then large-star and small-star steps alternate until the edge set stands still, the
    number of rounds growing with the logarithm of a component's diameter in forests. Three aggregate
    numbers a round, taken while the round's edges are written, reach the driver. A hub with many edges is
    one key of a plain join, which adaptive execution splits.
    Null ends and self loops are ignored; repeated edges count once; no edges give no rows. The result reads a table
    that ``scratch``, if given, drops.
    """
    scratch = scratch or Scratch(edges.sparkSession)

    def written(e: DataFrame) -> tuple[DataFrame, tuple]:
        o = Observation()
        mixed = F.xxhash64("u", "v").cast("decimal(38,0)")
        seen = e.observe(o, F.count(F.lit(1)).alias("n"), F.sum(mixed).alias("h"), F.sum("v").alias("v"))
        table = scratch.keep(seen, "cc")
        got = o.get  # nothing where the optimizer has found the edges to be none
        return table, tuple(got.get(k) for k in ("n", "h", "v"))

    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    e = e.where("u is not null and v is not null and u <> v and isnotnull(u + v)")
    e, before = written(e.mapInArrow(_forest, "u long, v long"))
    while before[0]:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(
                F.when(F.col("v") == F.col("m"), F.array(F.struct(F.col("u"), F.col("m").alias("v"))))
                .otherwise(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
            ).alias("e")
        ).select("e.u", "e.v").where("u <> v").distinct()
        old = e
        e, after = written(small)
        scratch.drop(old)
        if after == before:
            break
        before = after
    roots = e.select(F.col("v").alias("node")).distinct()
    return (
        e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component_id"))
        .unionByName(roots.withColumn("component_id", F.col("node")))
        .groupBy("node").agg(F.min("component_id").alias("component_id"))
    )
