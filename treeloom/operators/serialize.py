"""Node tables to token rows, S-expressions and indented text.

Each node gives up to three events, ordered by (k1, k2, k3): itself at
(id, 0, 0), an opening scope at (id, 1, 0) and a closing one at
(last id of its subtree, 2, -depth).  One sort of the events is the serial
order, so nothing recurses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeloom.operators.tree import KEYS


def _end() -> F.Column:
    return F.col("node_id") + F.col("subtree_size") - 1


def serialize(nodes: DataFrame, include_boundaries: bool = True, emit_scopes: bool = True, keys=KEYS, unknown: str | None = None) -> DataFrame:
    """Token rows: (keys, position, token, depth, node_id, parent_id,
    child_index, num_children, is_leaf, subtree_size, is_boundary).  A root
    whose token is ``unknown`` gets no boundaries."""
    last = F.col("span_end") if "span_end" in nodes.columns else _end()

    def row(k1, k2, k3, token, depth, node_id, parent, index, kids, leaf, size, boundary):
        values = (("k1", k1, "int"), ("k2", k2, "int"), ("k3", k3, "int"), ("token", token, "string"), ("depth", depth, "int"), ("node_id", node_id, "int"), ("parent_id", parent, "int"), ("child_index", index, "int"), ("num_children", kids, "int"), ("is_leaf", leaf, "boolean"), ("subtree_size", size, "int"), ("is_boundary", boundary, "boolean"))
        return F.struct(*[(v if isinstance(v, F.Column) else F.lit(v)).cast(t).alias(n) for n, v, t in values])

    col = F.col
    events = [row(col("node_id"), 0, 0, col("token"), col("depth"), col("node_id"), col("parent_id"), col("child_index"), col("num_children"), col("is_leaf"), col("subtree_size"), False)]
    none = F.lit(None)
    if emit_scopes:
        scope = col("token").startswith("FUNC_") & ~col("is_leaf")
        for token, k1, k2, k3 in (("[SCOPE_OPEN]", col("node_id"), 1, 0), ("[SCOPE_CLOSE]", last, 2, -col("depth"))):
            events.append(F.when(scope, row(k1, k2, k3, token, col("depth") + 1, -1, col("node_id"), 0, 0, True, 0, True)).otherwise(none))
    if include_boundaries:
        for token, k1 in (("[MATH_START]", -1), ("[MATH_END]", 2**31 - 1)):
            events.append(F.when((col("parent_id") == -1) & (F.lit(True) if unknown is None else col("token") != unknown), row(k1, 0, 0, token, -1, -1, -1, 0, 0, True, 0, True)).otherwise(none))
    flat = nodes.select(*keys, F.explode(F.array_compact(F.array(*events))).alias("e")).select(*keys, "e.*")
    order = Window.partitionBy(*keys).orderBy("k1", "k2", "k3")
    return flat.withColumn("position", (F.row_number().over(order) - 1).cast("int")).drop("k1", "k2", "k3")


def token_lists(tokens: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, tokens in order)."""
    rows = F.array_sort(F.collect_list(F.struct("position", "token")))
    return tokens.groupBy(*keys).agg(F.transform(rows, lambda x: x["token"]).alias("tokens"))


def depth_sequence(tokens: DataFrame, keys=KEYS) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("position", "depth")))
    return tokens.groupBy(*keys).agg(F.transform(rows, lambda x: F.greatest(x["depth"], F.lit(0))).alias("depths"))


def sexp(nodes: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, sexp): a leaf is its token, another node ``(TOKEN child ...)``."""
    opened = F.struct(F.col("node_id").alias("k1"), F.lit(0).alias("k2"), F.lit(0).alias("k3"), F.concat(F.when(F.col("node_id") > 0, F.lit(" ")).otherwise(F.lit("")), F.when(F.col("is_leaf"), F.lit("")).otherwise(F.lit("(")), F.col("token")).alias("piece"))
    closed = F.when(~F.col("is_leaf"), F.struct(_end().alias("k1"), F.lit(2).alias("k2"), (-F.col("depth")).alias("k3"), F.lit(")").alias("piece")))
    flat = nodes.select(*keys, F.explode(F.array_compact(F.array(opened, closed))).alias("e"))
    return flat.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["piece"]), "").alias("sexp"))


def indented(nodes: DataFrame, indent: int = 2, keys=KEYS) -> DataFrame:
    lines = F.array_sort(F.collect_list(F.struct("node_id", F.concat(F.repeat(F.lit(" " * indent), F.col("depth")), F.col("token")).alias("line"))))
    return nodes.groupBy(*keys).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("indented"))


def _folded(nodes: DataFrame, opening, closing, name: str, keys) -> DataFrame:
    """Text of each tree: a piece where a node begins and one where it ends."""
    opened = F.struct(F.col("node_id").alias("k1"), F.lit(0).alias("k2"), F.lit(0).alias("k3"), opening.alias("piece"))
    closed = F.struct(_end().alias("k1"), F.lit(2).alias("k2"), (-F.col("depth")).alias("k3"), closing.alias("piece"))
    flat = nodes.select(*keys, F.explode(F.array(opened, closed)).alias("e"))
    return flat.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["piece"]), "").alias(name))


def tree_repr(nodes: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, repr): a leaf is its token, another node ``TOKEN(child, ...)``."""
    comma = F.when(F.col("child_index") > 0, F.lit(", ")).otherwise(F.lit(""))
    return _folded(nodes, F.concat(comma, "token", F.when(F.col("is_leaf"), "").otherwise("(")), F.when(F.col("is_leaf"), "").otherwise(")"), "repr", keys)


def tree_json(nodes: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, json): each node an object of its fields and its ``children``."""
    own = F.to_json(F.struct("token", "node_id", "parent_id", "depth", "is_leaf", "subtree_size", "confidence"))
    comma = F.when(F.col("child_index") > 0, F.lit(",")).otherwise(F.lit(""))
    return _folded(nodes, F.concat(comma, F.expr("substring({0}, 1, length({0}) - 1)".format("__own")), F.lit(',"children":[')), F.lit("]}"), "json", keys) if "__own" in nodes.columns else tree_json(nodes.withColumn("__own", own), keys)
