"""Connected components: in one task up to a bounded number of edges, beyond that by alternating large-star and small-star
rounds, each one a pair of hash joins and aggregations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import checkpointed, written

#: Most edges that meet in one task (16 MB of them); a round over fewer costs more in tasks and shuffle files than in data.
ONE_TASK = 1 << 20


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member linked to each of n members over the links a-b."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _stars(pairs: DataFrame) -> DataFrame:
    """(u, v) with the least of u and its neighbours beside each; u's partial minimum is taken before the shuffle."""
    least = pairs.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    return pairs.join(least, F.col("u") == F.col("w")).select("u", "v", F.least("u", "m").alias("m"))


def _joined(batches):
    """node, root of all edges (u, v) at once, without the roots themselves."""
    ends = [tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(2)) for batch in batches]
    if ends:
        u, v = (np.concatenate([e[k] for e in ends]) for k in range(2))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        label = spanning(len(nodes), at[: len(u)], at[len(u) :])
        other = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(nodes[label[other]])], ["node", "root"])


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> node, root: the least node of each component, for all its other nodes.

    Up to ONE_TASK edges between longs are joined in one task. Beyond that, rounds go on until nothing changes (of the
    order of log n); each is checkpointed in the shared folder. Loops and repeated edges have no effect; nodes may be any
    orderable type; no edges: no rows.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    if all(f.dataType == LongType() for f in edges.schema) and edges.count() <= ONE_TASK:
        return written(edges.coalesce(1).mapInArrow(_joined, "node long, root long"))
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = _stars(large).select(F.explode(F.array(F.struct(F.col("v").alias("x"), "m"), F.struct(F.col("u").alias("x"), "m"))).alias("e")).select(F.col("e.x").alias("u"), F.col("e.m").alias("v"))
        edges = checkpointed(small.filter("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
