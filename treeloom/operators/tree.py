"""Algebra of node tables: every function takes and gives rows keyed by
``keys`` and ``node_id``, ids in preorder, so the subtree of a node is the ids
from its own to its own plus ``subtree_size`` - 1."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("doc_id", "span_idx")


def with_sizes(nodes: DataFrame, keys=KEYS) -> DataFrame:
    """``subtree_size``, ``height``, ``num_children`` and ``is_leaf`` from
    paths: a node counts for every prefix of its own path, which are its
    ancestors and itself, so rows grow with nodes times depth."""
    base = nodes.drop("subtree_size", "height", "num_children", "is_leaf")
    steps = F.split("path", r"\.")
    above = base.select(*keys, "depth", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "."))).alias("at", "path"))
    sizes = above.groupBy(*keys, "path").agg(F.count("*").cast("int").alias("subtree_size"), (F.max("depth") - F.min("depth")).cast("int").alias("height"))
    kids = base.groupBy(*keys, F.col("parent_id").alias("node_id")).agg(F.count("*").cast("int").alias("num_children"))
    out = base.join(sizes, [*keys, "path"]).join(kids, [*keys, "node_id"], "left").withColumn("num_children", F.coalesce("num_children", F.lit(0)))
    return out.withColumn("is_leaf", F.col("num_children") == 0)


def with_paths(nodes: DataFrame, keys=KEYS) -> DataFrame:
    """``path``: the root is "0", a child its parent's path, a dot and its
    index.  A tree's steps are gathered once, in preorder, and folded: the
    indices of the nodes above one are those that the fold holds by depth."""
    step = F.struct("node_id", "depth", F.when(F.col("depth") == 0, F.lit("0")).otherwise(F.col("child_index").cast("string")).alias("index"))
    trees = nodes.groupBy(*keys).agg(F.array_sort(F.collect_list(step)).alias("steps"))
    empty = F.struct(F.array().cast("array<string>").alias("open"), F.array().cast("array<struct<node_id:int,path:string>>").alias("done"))

    def visit(state, s):
        own = F.concat(F.slice(state["open"], F.lit(1), s["depth"]), F.array(s["index"]))
        return F.struct(own.alias("open"), F.concat(state["done"], F.array(F.struct(s["node_id"].cast("int").alias("node_id"), F.array_join(own, ".").alias("path")))).alias("done"))

    paths = trees.select(*keys, F.inline(F.aggregate("steps", empty, visit, lambda s: s["done"])))
    return nodes.drop("path").join(paths, [*keys, "node_id"])


def truncate(nodes: DataFrame, max_depth: int, keys=KEYS) -> DataFrame:
    """Cuts each tree at ``max_depth``: nodes there become truncated leaves,
    deeper ones go, ids and sizes are counted anew."""
    kept = nodes.where(F.col("depth") <= max_depth)
    cut = F.col("depth") == max_depth
    kept = kept.withColumn("token", F.when(cut, F.lit("SUBTREE_TRUNCATED")).otherwise(F.col("token"))).withColumn("confidence", F.when(cut, F.lit(0.0)).otherwise(F.col("confidence")))
    order = Window.partitionBy(*keys).orderBy("node_id")
    ids = kept.select(*keys, F.col("node_id").alias("old"), (F.row_number().over(order) - 1).cast("int").alias("new"))
    out = kept.join(ids.withColumnRenamed("old", "node_id"), [*keys, "node_id"])
    up = ids.select(*keys, F.col("old").alias("parent_id"), F.col("new").alias("new_parent"))
    out = out.join(up, [*keys, "parent_id"], "left").withColumn("node_id", F.col("new")).withColumn("parent_id", F.coalesce("new_parent", F.lit(-1))).drop("new", "new_parent")
    return with_sizes(out, keys)


def hash_trees():
    """An Arrow UDF from a tree's rows (node_id, parent_id, child_index, token)
    to (node_id, subtree_hash); children have larger ids than parents."""

    @F.arrow_udf(returnType="array<struct<node_id:int,subtree_hash:string>>")
    def run(trees: pa.Array) -> pa.Array:
        out = []
        for rows in trees.to_pylist():
            kids: dict[int, list] = {}
            done = []
            for r in sorted(rows or [], key=lambda r: -r["node_id"]):
                own = "".join(h for _, h in sorted(kids.pop(r["node_id"], [])))
                digest = hashlib.md5((r["token"] + own).encode()).hexdigest()
                kids.setdefault(r["parent_id"], []).append((r["child_index"], digest))
                done.append({"node_id": r["node_id"], "subtree_hash": digest})
            out.append(done)
        return pa.array(out, pa.list_(pa.struct([("node_id", pa.int32()), ("subtree_hash", pa.string())])))

    return run


def subtree_hash(nodes: DataFrame, keys=KEYS) -> DataFrame:
    """``subtree_hash``: md5 of the token and the children's hashes in order.
    A tree is gathered once and hashed bottom up (trees are as small as their
    expressions)."""
    trees = nodes.groupBy(*keys).agg(F.collect_list(F.struct("node_id", "parent_id", "child_index", "token")).alias("t"))
    hashes = trees.select(*keys, F.explode(hash_trees()(F.col("t"))).alias("h")).select(*keys, "h.*")
    return nodes.join(hashes, [*keys, "node_id"])


def dedup(hashed: DataFrame, keys=KEYS) -> DataFrame:
    """Common subtrees: an inner node whose hash occurred before becomes a leaf
    ``SUBTREE_REF_<8 hex digits>``, and what was below it goes."""
    same = Window.partitionBy(*keys, "subtree_hash")
    ref = ~F.col("is_leaf") & (F.min("node_id").over(same) < F.col("node_id"))
    marked = hashed.withColumn("is_ref", ref)
    order = Window.partitionBy(*keys).orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(F.col("is_ref"), F.col("node_id") + F.col("subtree_size") - 1)).over(order)
    kept = marked.withColumn("hidden", F.coalesce(F.col("node_id") <= reach, F.lit(False))).where(~F.col("hidden"))
    token = F.when(F.col("is_ref"), F.concat(F.lit("SUBTREE_REF_"), F.substring("subtree_hash", 1, 8))).otherwise(F.col("token"))
    one = lambda c, v: F.when(F.col("is_ref"), F.lit(v)).otherwise(F.col(c))
    return kept.withColumns({"token": token, "num_children": one("num_children", 0), "is_leaf": one("is_leaf", True), "span_end": F.col("node_id") + F.col("subtree_size") - 1, "subtree_size": one("subtree_size", 1)}).drop("hidden")


def token_sets(nodes: DataFrame, keys=KEYS) -> DataFrame:
    """All tokens in preorder, and the distinct variables and operators."""
    every = F.transform(F.array_sort(F.collect_list(F.struct("node_id", "token"))), lambda x: x["token"])
    by = nodes.groupBy(*keys).agg(every.alias("tokens"))
    operator = lambda t: t.startswith("OP_") | t.startswith("FUNC_") | (t == "FRAC")
    pick = lambda test: F.array_sort(F.array_distinct(F.filter("tokens", test)))
    return by.select(*keys, "tokens", pick(lambda t: t.startswith("VAR_")).alias("variables"), pick(operator).alias("operators"))
