"""Queries over the operator dimension and the vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from treeloom.functions import operators_table as T


def vocab_fixed(spark, sf_dir):
    return T.fixed_vocabulary(spark)


def operators_by_category(spark, sf_dir):
    return T.tokens_by(spark, "category").select("category", F.size("tokens").alias("n"), F.array_join("tokens", " ").alias("tokens"))


def backing_type_tokens(spark, sf_dir):
    return T.tokens_by(spark, "backing_type").where(F.size("tokens") > 1).select("backing_type", F.array_join("tokens", " ").alias("tokens"))


def inverse_pairs(spark, sf_dir):
    return T.inverse_pairs(spark)


def commutative_operators(spark, sf_dir):
    return T.operators(spark).where("is_commutative").select("op_id", "token", "arity", "precedence")


QUERIES = {f.__name__: f for f in (vocab_fixed, operators_by_category, backing_type_tokens, inverse_pairs, commutative_operators)}

_OPS = """(VALUES
 (14,'OP_ADD','arithmetic'),(15,'OP_MUL','arithmetic'),(16,'OP_POW','arithmetic'),(17,'OP_NEG','arithmetic'),(18,'OP_RECIP','arithmetic'),(19,'OP_ABS','arithmetic'),
 (20,'FRAC','structural'),(21,'OP_EQ','relational'),(22,'OP_NEQ','relational'),(23,'OP_LT','relational'),(24,'OP_GT','relational'),(25,'OP_LE','relational'),(26,'OP_GE','relational'),
 (27,'OP_DERIV','calculus'),(28,'OP_INT','calculus'),(29,'OP_LIMIT','calculus'),(30,'OP_SUM','calculus'),(31,'OP_PROD','calculus'),
 (32,'FUNC_SIN','function'),(33,'FUNC_COS','function'),(34,'FUNC_TAN','function'),(35,'FUNC_ASIN','function'),(36,'FUNC_ACOS','function'),(37,'FUNC_ATAN','function'),
 (38,'FUNC_SINH','function'),(39,'FUNC_COSH','function'),(40,'FUNC_TANH','function'),(41,'FUNC_EXP','function'),(42,'FUNC_LOG','function'),(43,'FUNC_LOG10','function'),
 (44,'FUNC_SQRT','function'),(45,'FUNC_CBRT','function'),(46,'FUNC_GAMMA','function'),(47,'FUNC_FACTORIAL','function'),(48,'FUNC_FLOOR','function'),(49,'FUNC_CEIL','function'),
 (50,'FUNC_RE','function'),(51,'FUNC_IM','function'),(52,'OP_AND','logic'),(53,'OP_OR','logic'),(54,'OP_NOT','logic'),(55,'OP_IMPLIES','logic'),
 (56,'OP_UNION','set'),(57,'OP_INTERSECT','set'),(58,'OP_IN','set'),(59,'OP_SUBSET','set'),(60,'OP_ANGLE','geometry'),(61,'OP_PARALLEL','geometry'),(62,'OP_PERP','geometry'),
 (63,'FUNC_MEAN','statistics'),(64,'FUNC_STDEV','statistics'),(65,'FUNC_VAR','statistics')) o(id, token, category)"""

ORACLES = {
    "vocab_fixed": f"""
SELECT token, (i - 1)::INT AS id, 'special' AS tier FROM (SELECT unnest(string_split('[PAD] [UNK] [UNK_MATH] [BOS] [EOS] [MATH_START] [MATH_END] [TEXT_START] [TEXT_END] [SEP] [MASK] [SCOPE_OPEN] [SCOPE_CLOSE] SUBTREE_TRUNCATED', ' ')) AS token, generate_subscripts(string_split('[PAD] [UNK] [UNK_MATH] [BOS] [EOS] [MATH_START] [MATH_END] [TEXT_START] [TEXT_END] [SEP] [MASK] [SCOPE_OPEN] [SCOPE_CLOSE] SUBTREE_TRUNCATED', ' '), 1) AS i)
UNION ALL SELECT token, id::INT, 'operator' FROM {_OPS}
UNION ALL SELECT 'VAR_' || v, (65 + i)::INT, 'variable' FROM (SELECT unnest(l) AS v, generate_subscripts(l, 1) AS i FROM (SELECT string_split('X Y Z T N K A B C M I J R S U V W P Q L F G H THETA ALPHA BETA GAMMA_ DELTA EPSILON ZETA ETA LAMBDA MU NU XI RHO SIGMA TAU PHI CHI PSI OMEGA IOTA KAPPA OMICRON UPSILON', ' ') AS l))
UNION ALL SELECT 'CONST_' || n, (122 + n)::INT, 'constant' FROM range(-10, 101) t(n)
UNION ALL SELECT 'CONST_' || c, id, 'constant' FROM (VALUES ('PI', 223), ('E', 224), ('I', 225), ('INF', 226), ('NEG_INF', 227), ('NAN', 228)) c(c, id)
UNION ALL SELECT 'NUM_' || n, (n + 128)::INT, 'number' FROM range(101, 1001) t(n)""",
    "operators_by_category": f"SELECT category, count(*)::INT AS n, string_agg(token, ' ' ORDER BY id) AS tokens FROM {_OPS} GROUP BY category",
    "backing_type_tokens": "SELECT * FROM (VALUES ('Mul', 'OP_MUL OP_NEG'), ('Pow', 'OP_POW OP_RECIP'), ('log', 'FUNC_LOG FUNC_LOG10')) t(backing_type, tokens)",
    "inverse_pairs": """WITH p(a, b) AS (VALUES ('FUNC_SIN', 'FUNC_ASIN'), ('FUNC_COS', 'FUNC_ACOS'), ('FUNC_TAN', 'FUNC_ATAN'), ('FUNC_EXP', 'FUNC_LOG'), ('OP_ADD', 'OP_NEG'))
SELECT a AS token, b AS inverse FROM p UNION ALL SELECT b, a FROM p""",
    "commutative_operators": "SELECT * FROM (VALUES (14, 'OP_ADD', -1, 1), (15, 'OP_MUL', -1, 2), (21, 'OP_EQ', 2, 0), (22, 'OP_NEQ', 2, 0), (52, 'OP_AND', -1, 1), (53, 'OP_OR', -1, 1), (56, 'OP_UNION', -1, 2), (57, 'OP_INTERSECT', -1, 2), (61, 'OP_PARALLEL', 2, 0), (62, 'OP_PERP', 2, 0)) t(op_id, token, arity, precedence)",
}
