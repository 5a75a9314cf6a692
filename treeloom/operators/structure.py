"""Per-token metadata and attention-mask edges, as joins on node ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.functions.session import guard
from treeloom.operators.tree import KEYS

BOUNDARIES = ("[MATH_START]", "[MATH_END]", "[TEXT_START]", "[TEXT_END]", "[BOS]", "[EOS]", "[PAD]", "[UNK]", "[SCOPE_OPEN]", "[SCOPE_CLOSE]")


def token_category(token: Column) -> Column:
    starts = lambda *p: token.rlike("^(" + "|".join(p) + ")")
    return (
        F.when(token.isin(*BOUNDARIES), "boundary").when(starts("OP_") | (token == "FRAC"), "operator").when(starts("FUNC_"), "function")
        .when(starts("VAR_"), "variable").when(starts("CONST_", "NUM_", "FLOAT_"), "constant").when(starts("SUBTREE_REF_") | (token == "SUBTREE_TRUNCATED"), "structural").otherwise("text")
    )


def metadata(tokens: DataFrame, paths: DataFrame, vocabulary: DataFrame, keys=KEYS) -> DataFrame:
    """One row a token.  ``paths``: (keys, node_id, path).  Scope and boundary
    rows are nobody's children and have no siblings; unknown ids are -1."""
    inner = tokens.where("node_id >= 0")
    kids = inner.where("parent_id >= 0").groupBy(*keys, F.col("parent_id").alias("node_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "node_id"))), lambda x: x["node_id"]).alias("children_ids"))
    up = inner.select(*keys, F.col("node_id").alias("parent_id"), F.col("token").alias("parent_token"))
    known = vocabulary.select("token", F.col("id").alias("token_id"))
    if vocabulary.count() <= 1_000_000:  # fixed size, plus dynamic names
        known = F.broadcast(known)
    siblings = Window.partitionBy(*keys, "parent_id")
    real = (F.col("node_id") >= 0) & (F.col("parent_id") >= 0)
    out = tokens.withColumn("sibling_count", F.when(real, F.sum(real.cast("int")).over(siblings)).otherwise(0).cast("int"))
    out = out.join(kids, [*keys, "node_id"], "left").join(up, [*keys, "parent_id"], "left").join(paths.select(*keys, "node_id", "path"), [*keys, "node_id"], "left").join(known, "token", "left")
    return out.select(
        *keys, "position", "token", F.coalesce("token_id", F.lit(-1)).alias("token_id"), "node_id", "parent_id", F.coalesce("parent_token", F.lit("")).alias("parent_token"),
        F.coalesce("children_ids", F.array().cast("array<int>")).alias("children_ids"), F.greatest("depth", F.lit(0)).alias("depth"), "child_index", "subtree_size", "is_leaf", "num_children",
        token_category(F.col("token")).alias("token_category"), F.coalesce("path", F.lit("root")).alias("tree_position_key"), "sibling_count",
    )


def _ends(tokens: DataFrame, keys, side: str) -> DataFrame:
    return tokens.where("node_id >= 0").select(*keys, F.col("position").alias(side), F.col("node_id").alias(f"{side}_id"), F.col("parent_id").alias(f"{side}_parent"), F.col("subtree_size").alias(f"{side}_size"))


def parent_edges(tokens: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, row, col): each token and its parent."""
    a, b = _ends(tokens, keys, "row"), _ends(tokens, keys, "col")
    return a.join(b.withColumnRenamed("col_id", "row_parent"), [*keys, "row_parent"]).select(*keys, "row", "col")


def children_edges(tokens: DataFrame, keys=KEYS) -> DataFrame:
    return parent_edges(tokens, keys).select(*keys, F.col("col").alias("row"), F.col("row").alias("col"))


def sibling_edges(tokens: DataFrame, keys=KEYS) -> DataFrame:
    a, b = _ends(tokens, keys, "row").where("row_parent >= 0"), _ends(tokens, keys, "col")
    return a.join(b.withColumnRenamed("col_parent", "row_parent"), [*keys, "row_parent"]).where(F.col("row") != F.col("col")).select(*keys, "row", "col")


def subtree_edges(tokens: DataFrame, keys=KEYS) -> DataFrame:
    """Each node and all below it, itself included."""
    a, b = _ends(tokens, keys, "row"), _ends(tokens, keys, "col")
    inside = (F.col("col_id") >= F.col("row_id")) & (F.col("col_id") < F.col("row_id") + F.col("row_size"))
    return a.join(b, list(keys)).where(inside).select(*keys, "row", "col")


def mask_edges(tokens: DataFrame, keys=KEYS) -> DataFrame:
    guard(tokens.sparkSession)
    masks = (("parent", parent_edges), ("children", children_edges), ("sibling", sibling_edges), ("subtree", subtree_edges))
    out = None
    for name, edges in masks:
        part = edges(tokens, keys).select(*keys, F.lit(name).alias("mask"), "row", "col")
        out = part if out is None else out.unionAll(part)
    return out


def dense_rows(edges: DataFrame, tokens: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, row, mask): one row a token, with a zero or one for each token of
    its span.  A dense mask grows with the square of its span; by rows, no
    single value does."""
    sizes = tokens.groupBy(*keys).agg(F.count("*").cast("int").alias("n"))
    by = edges.groupBy(*keys, "row").agg(F.array_sort(F.collect_set("col")).alias("cols"))
    rows = tokens.select(*keys, F.col("position").alias("row")).join(sizes, list(keys)).join(by, [*keys, "row"], "left")
    # runs of zeros between the ones
    none = F.array().cast("array<int>")
    gaps = F.transform(F.coalesce("cols", none), lambda c, i: F.concat(F.array_repeat(F.lit(0), c - F.coalesce(F.get("cols", i - 1), F.lit(-1)) - 1), F.array(F.lit(1))))
    tail = F.array_repeat(F.lit(0), F.col("n") - 1 - F.coalesce(F.try_element_at("cols", F.lit(-1)), F.lit(-1)))
    return rows.select(*keys, "row", F.concat(F.flatten(gaps), tail).alias("mask"))


def dense_mask(edges: DataFrame, tokens: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, mask): n rows of n zeros and ones, of every span."""
    rows = F.array_sort(F.collect_list(F.struct("row", "mask")))
    return dense_rows(edges, tokens, keys).groupBy(*keys).agg(F.transform(rows, lambda r: r["mask"]).alias("mask"))
