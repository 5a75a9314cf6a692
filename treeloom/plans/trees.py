"""Queries over trees that are made from keys: each order is a root and its
line items are its children, a function of one leaf or a product of two.  The
same SQL makes the node table here and in the oracles; what is computed from
it is written down twice."""

from __future__ import annotations

from pyspark.sql import functions as F

from treeloom.functions import operators_table as T
from treeloom.operators import serialize, structure, tree

KEY = ("doc_id",)

#: Spark and DuckDB both run this.
NODES_SQL = """
WITH l AS (
  SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) - 1 AS INT) AS ci,
         CAST(l_quantity AS INT) % 3 AS q, CASE WHEN l_linenumber % 2 = 1 THEN 2 ELSE 3 END AS sz FROM lineitem),
c AS (
  SELECT doc_id, ci, q, sz, CAST(1 + sum(sz) OVER (PARTITION BY doc_id ORDER BY ci ROWS UNBOUNDED PRECEDING) - sz AS INT) AS id FROM l),
nodes AS (
  SELECT doc_id, 0 AS node_id, -1 AS parent_id, 0 AS child_index, 0 AS depth, 'OP_ADD' AS token, CAST(count(*) AS INT) AS num_children, false AS is_leaf, CAST(1 + sum(sz) AS INT) AS subtree_size, 2 AS height, '0' AS path FROM c GROUP BY doc_id
  UNION ALL SELECT doc_id, id, 0, ci, 1, CASE WHEN sz = 2 THEN 'FUNC_SIN' ELSE 'OP_MUL' END, sz - 1, false, sz, 1, concat('0.', ci) FROM c
  UNION ALL SELECT doc_id, id + 1, id, 0, 2, CASE WHEN sz = 2 THEN 'VAR_X' ELSE concat('CONST_', q) END, 0, true, 1, 0, concat('0.', ci, '.0') FROM c
  UNION ALL SELECT doc_id, id + 2, id, 1, 2, 'VAR_Y', 0, true, 1, 0, concat('0.', ci, '.1') FROM c WHERE sz = 3)
"""


def _nodes(spark, sf_dir):
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return spark.sql(NODES_SQL.replace("FROM lineitem", "FROM {lineitem}") + "SELECT * FROM nodes", lineitem=lineitem).withColumn("confidence", F.lit(1.0))


def _tokens(spark, sf_dir):
    return serialize.serialize(_nodes(spark, sf_dir), keys=KEY)


def serialize_flat(spark, sf_dir):
    return serialize.serialize(_nodes(spark, sf_dir), False, False, KEY).select("doc_id", "position", "token", "depth", "node_id", "parent_id")


def serialize_scopes(spark, sf_dir):
    return _tokens(spark, sf_dir).select("doc_id", "position", "token", "depth", "node_id", "parent_id", "is_boundary")


def sexp(spark, sf_dir):
    return serialize.sexp(_nodes(spark, sf_dir), KEY)


def indented(spark, sf_dir):
    return serialize.indented(_nodes(spark, sf_dir), 2, KEY)


def subtree_sizes(spark, sf_dir):
    return tree.with_sizes(_nodes(spark, sf_dir), KEY).select("doc_id", "node_id", "subtree_size", "height", "num_children", "is_leaf")


def subtree_hash(spark, sf_dir):
    return tree.subtree_hash(_nodes(spark, sf_dir), KEY).select("doc_id", "node_id", "subtree_hash")


def dedup_refs(spark, sf_dir):
    rows = tree.dedup(tree.subtree_hash(_nodes(spark, sf_dir), KEY), KEY)
    return serialize.serialize(rows, keys=KEY).select("doc_id", "position", "token")


def truncate_depth(spark, sf_dir):
    return tree.truncate(_nodes(spark, sf_dir), 1, KEY).select("doc_id", "node_id", "parent_id", "token", "subtree_size", "is_leaf")


def token_sets(spark, sf_dir):
    rows = tree.token_sets(_nodes(spark, sf_dir), KEY)
    return rows.select("doc_id", F.array_join("variables", " ").alias("variables"), F.array_join("operators", " ").alias("operators"), F.size("tokens").alias("n"))


def token_categories(spark, sf_dir):
    return _tokens(spark, sf_dir).groupBy(structure.token_category(F.col("token")).alias("category")).agg(F.count("*").alias("n"))


def _meta(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    return structure.metadata(serialize.serialize(nodes, keys=KEY), nodes, T.fixed_vocabulary(spark), KEY)


def children_ids(spark, sf_dir):
    return _meta(spark, sf_dir).where("node_id >= 0").select("doc_id", "node_id", F.array_join("children_ids", ",").alias("children"))


def parent_tokens(spark, sf_dir):
    return _meta(spark, sf_dir).select("doc_id", "position", "token", "token_id", "parent_token")


def sibling_counts(spark, sf_dir):
    return _meta(spark, sf_dir).select("doc_id", "position", "sibling_count")


def position_keys(spark, sf_dir):
    paths = tree.with_paths(_nodes(spark, sf_dir), KEY)
    return paths.select("doc_id", "node_id", F.col("path").alias("tree_position_key"))


def parent_edges(spark, sf_dir):
    return structure.parent_edges(_tokens(spark, sf_dir), KEY)


def children_edges(spark, sf_dir):
    return structure.children_edges(_tokens(spark, sf_dir), KEY)


def sibling_edges(spark, sf_dir):
    return structure.sibling_edges(_tokens(spark, sf_dir), KEY).groupBy("doc_id", "row").agg(F.count("*").alias("n"), F.sum("col").alias("cols"))


def subtree_edges(spark, sf_dir):
    return structure.subtree_edges(_tokens(spark, sf_dir), KEY)


def dense_parent_mask(spark, sf_dir):
    tokens = _tokens(spark, sf_dir)
    mask = structure.dense_mask(structure.parent_edges(tokens, KEY), tokens, KEY)
    flat = F.aggregate("mask", F.lit(0), lambda s, r: s + F.aggregate(r, F.lit(0), lambda t, x: t + x))
    return mask.select("doc_id", F.size("mask").alias("n"), flat.alias("ones"))


def depth_sequences(spark, sf_dir):
    return serialize.depth_sequence(_tokens(spark, sf_dir), KEY).select("doc_id", F.array_join("depths", ",").alias("depths"))


def token_depths(spark, sf_dir):
    return _meta(spark, sf_dir).select("doc_id", "position", "depth")


def tree_reprs(spark, sf_dir):
    return serialize.tree_repr(_nodes(spark, sf_dir), KEY)


def tree_objects(spark, sf_dir):
    """The nested objects of whole trees, read back: roots and their children."""
    kid = "struct<token:string,node_id:int,parent_id:int,subtree_size:int>"
    rows = serialize.tree_json(_nodes(spark, sf_dir), KEY).select("doc_id", F.from_json("json", f"token string, node_id int, parent_id int, subtree_size int, children array<{kid}>").alias("t"))
    root = F.struct("t.token", "t.node_id", "t.parent_id", "t.subtree_size")
    return rows.select("doc_id", F.inline(F.concat(F.array(root), "t.children"))).select("doc_id", "node_id", "parent_id", "token", "subtree_size")


def dense_mask_rows(spark, sf_dir):
    tokens = _tokens(spark, sf_dir)
    return structure.dense_rows(structure.parent_edges(tokens, KEY), tokens, KEY).select("doc_id", "row", F.array_join("mask", "").alias("mask"))


QUERIES = {f.__name__: f for f in (depth_sequences, token_depths, tree_reprs, tree_objects, dense_mask_rows, serialize_flat, serialize_scopes, sexp, indented, subtree_sizes, subtree_hash, dedup_refs, truncate_depth, token_sets, token_categories, children_ids, parent_tokens, sibling_counts, position_keys, parent_edges, children_edges, sibling_edges, subtree_edges, dense_parent_mask)}

# tokens of a serialized tree in closed form: a function takes four places, a product three
_SERIAL = (
    NODES_SQL
    + """,
w AS (SELECT *, CASE WHEN sz = 2 THEN 4 ELSE 3 END AS w FROM c),
p AS (SELECT *, CAST(2 + sum(w) OVER (PARTITION BY doc_id ORDER BY ci ROWS UNBOUNDED PRECEDING) - w AS INT) AS pos FROM w),
tk AS (
  SELECT doc_id, 0 AS position, '[MATH_START]' AS token, -1 AS depth, -1 AS node_id, -1 AS parent_id, true AS is_boundary FROM p GROUP BY doc_id
  UNION ALL SELECT doc_id, 1, 'OP_ADD', 0, 0, -1, false FROM p GROUP BY doc_id
  UNION ALL SELECT doc_id, pos, CASE WHEN sz = 2 THEN 'FUNC_SIN' ELSE 'OP_MUL' END, 1, id, 0, false FROM p
  UNION ALL SELECT doc_id, pos + 1, '[SCOPE_OPEN]', 2, -1, id, true FROM p WHERE sz = 2
  UNION ALL SELECT doc_id, pos + 2, 'VAR_X', 2, id + 1, id, false FROM p WHERE sz = 2
  UNION ALL SELECT doc_id, pos + 3, '[SCOPE_CLOSE]', 2, -1, id, true FROM p WHERE sz = 2
  UNION ALL SELECT doc_id, pos + 1, 'CONST_' || q, 2, id + 1, id, false FROM p WHERE sz = 3
  UNION ALL SELECT doc_id, pos + 2, 'VAR_Y', 2, id + 2, id, false FROM p WHERE sz = 3
  UNION ALL SELECT doc_id, CAST(2 + sum(w) AS INT), '[MATH_END]', -1, -1, -1, true FROM p GROUP BY doc_id)
"""
)
_PARENT = """SELECT doc_id, pos AS "row", 1 AS col FROM p
UNION ALL SELECT doc_id, pos + 2, pos FROM p
UNION ALL SELECT doc_id, pos + 1, pos FROM p WHERE sz = 3"""

ORACLES = {
    "serialize_flat": NODES_SQL + "SELECT doc_id, node_id AS position, token, depth, node_id, parent_id FROM nodes",
    "serialize_scopes": _SERIAL + "SELECT doc_id, position, token, depth, node_id, parent_id, is_boundary FROM tk",
    "sexp": NODES_SQL + "SELECT doc_id, '(OP_ADD ' || string_agg(CASE WHEN sz = 2 THEN '(FUNC_SIN VAR_X)' ELSE '(OP_MUL CONST_' || q || ' VAR_Y)' END, ' ' ORDER BY ci) || ')' AS sexp FROM c GROUP BY doc_id",
    "indented": NODES_SQL + "SELECT doc_id, string_agg(repeat(' ', 2 * depth) || token, chr(10) ORDER BY node_id) AS indented FROM nodes GROUP BY doc_id",
    "subtree_sizes": NODES_SQL + "SELECT doc_id, node_id, subtree_size, height, num_children, is_leaf FROM nodes",
    "subtree_hash": NODES_SQL + """,
h2 AS (SELECT *, md5(token) AS h FROM nodes WHERE depth = 2),
h1 AS (SELECT n.*, md5(n.token || k.s) AS h FROM nodes n JOIN (SELECT doc_id, parent_id, string_agg(h, '' ORDER BY child_index) AS s FROM h2 GROUP BY 1, 2) k ON n.doc_id = k.doc_id AND n.node_id = k.parent_id),
h0 AS (SELECT n.*, md5(n.token || k.s) AS h FROM nodes n JOIN (SELECT doc_id, string_agg(h, '' ORDER BY child_index) AS s FROM h1 GROUP BY 1) k ON n.doc_id = k.doc_id AND n.node_id = 0)
SELECT doc_id, node_id, h AS subtree_hash FROM h2 UNION ALL SELECT doc_id, node_id, h FROM h1 UNION ALL SELECT doc_id, node_id, h FROM h0""",
    "dedup_refs": NODES_SQL + """,
k AS (SELECT *, CASE WHEN sz = 2 THEN md5('FUNC_SIN' || md5('VAR_X')) ELSE md5('OP_MUL' || md5('CONST_' || q) || md5('VAR_Y')) END AS h FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, h ORDER BY ci) > 1 AS ref FROM k),
w AS (SELECT *, CASE WHEN ref THEN 1 WHEN sz = 2 THEN 4 ELSE 3 END AS w FROM r),
p AS (SELECT *, CAST(2 + sum(w) OVER (PARTITION BY doc_id ORDER BY ci ROWS UNBOUNDED PRECEDING) - w AS INT) AS pos FROM w)
SELECT doc_id, 0 AS position, '[MATH_START]' AS token FROM p GROUP BY doc_id
UNION ALL SELECT doc_id, 1, 'OP_ADD' FROM p GROUP BY doc_id
UNION ALL SELECT doc_id, pos, CASE WHEN ref THEN 'SUBTREE_REF_' || substr(h, 1, 8) WHEN sz = 2 THEN 'FUNC_SIN' ELSE 'OP_MUL' END FROM p
UNION ALL SELECT doc_id, pos + 1, CASE WHEN sz = 2 THEN '[SCOPE_OPEN]' ELSE 'CONST_' || q END FROM p WHERE NOT ref
UNION ALL SELECT doc_id, pos + 2, CASE WHEN sz = 2 THEN 'VAR_X' ELSE 'VAR_Y' END FROM p WHERE NOT ref
UNION ALL SELECT doc_id, pos + 3, '[SCOPE_CLOSE]' FROM p WHERE NOT ref AND sz = 2
UNION ALL SELECT doc_id, CAST(2 + sum(w) AS INT), '[MATH_END]' FROM p GROUP BY doc_id""",
    "truncate_depth": NODES_SQL + """SELECT doc_id, 0 AS node_id, -1 AS parent_id, 'OP_ADD' AS token, CAST(1 + count(*) AS INT) AS subtree_size, false AS is_leaf FROM c GROUP BY doc_id
UNION ALL SELECT doc_id, ci + 1, 0, 'SUBTREE_TRUNCATED', 1, true FROM c""",
    "token_sets": NODES_SQL + """SELECT doc_id, array_to_string(list_sort(list_distinct(list(token) FILTER (token LIKE 'VAR\\_%' ESCAPE '\\'))), ' ') AS variables,
 array_to_string(list_sort(list_distinct(list(token) FILTER (token LIKE 'OP\\_%' ESCAPE '\\' OR token LIKE 'FUNC\\_%' ESCAPE '\\'))), ' ') AS operators, count(*)::INT AS n FROM nodes GROUP BY doc_id""",
    "token_categories": _SERIAL + "SELECT CASE WHEN is_boundary THEN 'boundary' WHEN token LIKE 'OP%' THEN 'operator' WHEN token LIKE 'FUNC%' THEN 'function' WHEN token LIKE 'VAR%' THEN 'variable' ELSE 'constant' END AS category, count(*) AS n FROM tk GROUP BY 1",
    "children_ids": NODES_SQL + "SELECT n.doc_id, n.node_id, coalesce(string_agg(k.node_id::VARCHAR, ',' ORDER BY k.node_id), '') AS children FROM nodes n LEFT JOIN nodes k ON k.doc_id = n.doc_id AND k.parent_id = n.node_id GROUP BY n.doc_id, n.node_id",
    "parent_tokens": _SERIAL + """SELECT a.doc_id, a.position, a.token, (CASE WHEN a.token = '[MATH_START]' THEN 5 WHEN a.token = '[MATH_END]' THEN 6 WHEN a.token = '[SCOPE_OPEN]' THEN 11 WHEN a.token = '[SCOPE_CLOSE]' THEN 12
 WHEN a.token = 'OP_ADD' THEN 14 WHEN a.token = 'OP_MUL' THEN 15 WHEN a.token = 'FUNC_SIN' THEN 32 WHEN a.token = 'VAR_X' THEN 66 WHEN a.token = 'VAR_Y' THEN 67 ELSE 122 + substr(a.token, 7)::INT END)::INT AS token_id, CASE WHEN a.parent_id = -1 THEN '' WHEN a.parent_id = 0 THEN 'OP_ADD' WHEN a.token IN ('[SCOPE_OPEN]', '[SCOPE_CLOSE]', 'VAR_X') THEN 'FUNC_SIN' ELSE 'OP_MUL' END AS parent_token
 FROM tk a""",
    "sibling_counts": _SERIAL + "SELECT doc_id, position, (CASE WHEN node_id > 0 THEN sum(CASE WHEN node_id > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, parent_id) ELSE 0 END)::INT AS sibling_count FROM tk",
    "position_keys": NODES_SQL + "SELECT doc_id, node_id, path AS tree_position_key FROM nodes",
    "parent_edges": _SERIAL + _PARENT,
    "children_edges": _SERIAL + f'SELECT doc_id, col AS "row", "row" AS col FROM ({_PARENT})',
    "sibling_edges": _SERIAL + 'SELECT a.doc_id, a.position AS "row", count(*) AS n, sum(b.position)::BIGINT AS cols FROM tk a JOIN tk b ON a.doc_id = b.doc_id AND a.parent_id = b.parent_id AND a.position <> b.position WHERE a.node_id > 0 AND b.node_id > 0 GROUP BY 1, 2',
    "subtree_edges": _SERIAL + """SELECT doc_id, position AS "row", position AS col FROM tk WHERE node_id >= 0
UNION ALL SELECT a.doc_id, b.position, a.position FROM tk a JOIN tk b ON a.doc_id = b.doc_id AND b.node_id = a.parent_id WHERE a.node_id > 0
UNION ALL SELECT doc_id, 1, position FROM tk WHERE node_id > 0 AND parent_id > 0""",
    "depth_sequences": _SERIAL + "SELECT doc_id, string_agg(greatest(depth, 0)::VARCHAR, ',' ORDER BY position) AS depths FROM tk GROUP BY doc_id",
    "token_depths": _SERIAL + "SELECT doc_id, position, greatest(depth, 0)::INT AS depth FROM tk",
    "tree_reprs": NODES_SQL + "SELECT doc_id, 'OP_ADD(' || string_agg(CASE WHEN sz = 2 THEN 'FUNC_SIN(VAR_X)' ELSE 'OP_MUL(CONST_' || q || ', VAR_Y)' END, ', ' ORDER BY ci) || ')' AS repr FROM c GROUP BY doc_id",
    "tree_objects": NODES_SQL + """SELECT doc_id, node_id, parent_id, token, subtree_size FROM nodes WHERE depth < 2""",
    "dense_mask_rows": _SERIAL + """, e AS (SELECT doc_id, pos AS r, 1 AS c FROM p UNION ALL SELECT doc_id, pos + 2, pos FROM p UNION ALL SELECT doc_id, pos + 1, pos FROM p WHERE sz = 3), n AS (SELECT doc_id, count(*)::INT AS n FROM tk GROUP BY doc_id)
SELECT tk.doc_id, tk.position AS "row", CASE WHEN e.c IS NULL THEN repeat('0', n.n) ELSE repeat('0', e.c) || '1' || repeat('0', n.n - 1 - e.c) END AS mask FROM tk JOIN n ON tk.doc_id = n.doc_id LEFT JOIN e ON e.doc_id = tk.doc_id AND e.r = tk.position""",
    "dense_parent_mask": _SERIAL + "SELECT doc_id, count(*)::INT AS n, count(*) FILTER (node_id > 0)::INT AS ones FROM tk GROUP BY doc_id",
}
