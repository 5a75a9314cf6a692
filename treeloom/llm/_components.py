"""Connected components by alternating large-star and small-star steps.

Every step is a join and an aggregation, the edge table never leaves the
executors, and the number of steps grows with the logarithm of the longest
path.  A local union-find inside each partition contracts the input first.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _contract(batches):
    """Replaces the edges of each bounded run of batches by a spanning star."""
    held, n = [], 0

    def flush():
        a = np.concatenate([x[0] for x in held])
        b = np.concatenate([x[1] for x in held])
        nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
        label, u, v = np.arange(len(nodes)), inverse[: len(a)], inverse[len(a) :]
        while True:
            low = np.minimum(label[u], label[v])
            new = label.copy()
            np.minimum.at(new, label[u], low)
            np.minimum.at(new, label[v], low)
            new = new[new]
            if np.array_equal(new, label):
                break
            label = new
        keep = label != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(nodes[label[keep]])], ["u", "v"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        n += batch.num_rows
        if n >= 2_000_000:
            yield flush()
            held, n = [], 0
    if n:
        yield flush()


def components(edges: DataFrame, scratch, max_steps: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: bigint): root is the
    smallest node of its component.  Nodes that only have an edge to
    themselves may be missing.  An empty table gives an empty table."""
    now = scratch.put(edges.select("u", "v").where("u <> v").mapInArrow(_contract, "u bigint, v bigint"))
    seen = None
    for _ in range(max_steps):
        # large star: each node's larger neighbours go to its smallest neighbour
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: smaller neighbours and the node itself go to the smallest
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        new = scratch.put(small)
        at = new.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if seen is not None:
            scratch.drop(now)
        now = new
        if seen == (at["n"], at["h"]):
            break
        seen = (at["n"], at["h"])
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
