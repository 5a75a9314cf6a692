"""The operator dimension and the fixed vocabulary, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Token, backing type, arity, precedence, associativity, semantic
#: role, LaTeX, plain, category, commutative.
OPERATORS = (
    ("OP_ADD", "Add", -1, 1, "left", "aggregation", "+", "+", "arithmetic", True),
    ("OP_MUL", "Mul", -1, 2, "left", "scaling", r"\cdot", "*", "arithmetic", True),
    ("OP_POW", "Pow", 2, 4, "right", "recursive_growth", "^", "**", "arithmetic", False),
    ("OP_NEG", "Mul", 1, 3, "none", "negation", "-", "-", "arithmetic", False),
    ("OP_RECIP", "Pow", 1, 3, "none", "reciprocal", "^{-1}", "**(-1)", "arithmetic", False),
    ("OP_ABS", "Abs", 1, 5, "none", "magnitude", r"|\cdot|", "abs", "arithmetic", False),
    ("FRAC", "Rational", 2, 3, "none", "ratio", r"\frac", "/", "structural", False),
    ("OP_EQ", "Eq", 2, 0, "none", "equality", "=", "==", "relational", True),
    ("OP_NEQ", "Ne", 2, 0, "none", "inequality", r"\neq", "!=", "relational", True),
    ("OP_LT", "StrictLessThan", 2, 0, "none", "strict_ordering", "<", "<", "relational", False),
    ("OP_GT", "StrictGreaterThan", 2, 0, "none", "strict_ordering", ">", ">", "relational", False),
    ("OP_LE", "LessThan", 2, 0, "none", "ordering", r"\leq", "<=", "relational", False),
    ("OP_GE", "GreaterThan", 2, 0, "none", "ordering", r"\geq", ">=", "relational", False),
    ("OP_DERIV", "Derivative", 2, 5, "none", "local_change", r"\frac{d}{dx}", "diff", "calculus", False),
    ("OP_INT", "Integral", 2, 0, "none", "accumulation", r"\int", "integrate", "calculus", False),
    ("OP_LIMIT", "Limit", 3, 0, "none", "asymptotic_behavior", r"\lim", "limit", "calculus", False),
    ("OP_SUM", "Sum", 2, 0, "none", "discrete_accumulation", r"\sum", "Sum", "calculus", False),
    ("OP_PROD", "Product", 2, 0, "none", "discrete_scaling", r"\prod", "Product", "calculus", False),
    ("FUNC_SIN", "sin", 1, 5, "none", "periodic_oscillation", r"\sin", "sin", "function", False),
    ("FUNC_COS", "cos", 1, 5, "none", "periodic_oscillation", r"\cos", "cos", "function", False),
    ("FUNC_TAN", "tan", 1, 5, "none", "periodic_ratio", r"\tan", "tan", "function", False),
    ("FUNC_ASIN", "asin", 1, 5, "none", "inverse_periodic", r"\arcsin", "asin", "function", False),
    ("FUNC_ACOS", "acos", 1, 5, "none", "inverse_periodic", r"\arccos", "acos", "function", False),
    ("FUNC_ATAN", "atan", 1, 5, "none", "inverse_periodic", r"\arctan", "atan", "function", False),
    ("FUNC_SINH", "sinh", 1, 5, "none", "hyperbolic_oscillation", r"\sinh", "sinh", "function", False),
    ("FUNC_COSH", "cosh", 1, 5, "none", "hyperbolic_oscillation", r"\cosh", "cosh", "function", False),
    ("FUNC_TANH", "tanh", 1, 5, "none", "hyperbolic_ratio", r"\tanh", "tanh", "function", False),
    ("FUNC_EXP", "exp", 1, 5, "none", "exponential_growth", "e^", "exp", "function", False),
    ("FUNC_LOG", "log", 1, 5, "none", "logarithmic_compression", r"\ln", "log", "function", False),
    ("FUNC_LOG10", "log", 1, 5, "none", "logarithmic_compression", r"\log_{10}", "log10", "function", False),
    ("FUNC_SQRT", "sqrt", 1, 5, "none", "root_extraction", r"\sqrt", "sqrt", "function", False),
    ("FUNC_CBRT", "cbrt", 1, 5, "none", "root_extraction", r"\sqrt[3]", "cbrt", "function", False),
    ("FUNC_GAMMA", "gamma", 1, 5, "none", "factorial_extension", r"\Gamma", "gamma", "function", False),
    ("FUNC_FACTORIAL", "factorial", 1, 6, "none", "combinatorial_growth", "!", "factorial", "function", False),
    ("FUNC_FLOOR", "floor", 1, 5, "none", "integer_rounding_down", r"\lfloor\rfloor", "floor", "function", False),
    ("FUNC_CEIL", "ceiling", 1, 5, "none", "integer_rounding_up", r"\lceil\rceil", "ceil", "function", False),
    ("FUNC_RE", "re", 1, 5, "none", "real_part", r"\Re", "re", "function", False),
    ("FUNC_IM", "im", 1, 5, "none", "imaginary_part", r"\Im", "im", "function", False),
    ("OP_AND", "And", -1, 1, "left", "logical_conjunction", r"\land", "and", "logic", True),
    ("OP_OR", "Or", -1, 1, "left", "logical_disjunction", r"\lor", "or", "logic", True),
    ("OP_NOT", "Not", 1, 5, "none", "logical_negation", r"\lnot", "not", "logic", False),
    ("OP_IMPLIES", "Implies", 2, 0, "none", "logical_implication", r"\implies", "=>", "logic", False),
    ("OP_UNION", "Union", -1, 2, "left", "set_union", r"\cup", "U", "set", True),
    ("OP_INTERSECT", "Intersection", -1, 2, "left", "set_intersection", r"\cap", "intersect", "set", True),
    ("OP_IN", "Contains", 2, 0, "none", "set_membership", r"\in", "in", "set", False),
    ("OP_SUBSET", "Subset", 2, 0, "none", "subset", r"\subset", "subset", "set", False),
    ("OP_ANGLE", "Angle", 1, 5, "none", "geometric_angle", r"\angle", "angle", "geometry", False),
    ("OP_PARALLEL", "Parallel", 2, 0, "none", "geometric_parallel", r"\parallel", "||", "geometry", True),
    ("OP_PERP", "Perpendicular", 2, 0, "none", "geometric_perpendicular", r"\perp", "perp", "geometry", True),
    ("FUNC_MEAN", "Mean", -1, 5, "none", "statistical_mean", r"\mu", "mean", "statistics", False),
    ("FUNC_STDEV", "StdDev", -1, 5, "none", "statistical_deviation", r"\sigma", "stdev", "statistics", False),
    ("FUNC_VAR", "Variance", -1, 5, "none", "statistical_variance", r"\sigma^2", "var", "statistics", False),
)
FIELDS = ("token", "backing_type", "arity", "precedence", "associativity", "semantic_role", "latex_repr", "ascii_repr", "category", "is_commutative")
#: Functions and operators that undo each other.
INVERSE_PAIRS = (("FUNC_SIN", "FUNC_ASIN"), ("FUNC_COS", "FUNC_ACOS"), ("FUNC_TAN", "FUNC_ATAN"), ("FUNC_EXP", "FUNC_LOG"), ("OP_ADD", "OP_NEG"))

#: The vocabulary's special tokens, variables and named constants.
SPECIALS = (
    "[PAD]", "[UNK]", "[UNK_MATH]", "[BOS]", "[EOS]", "[MATH_START]", "[MATH_END]", "[TEXT_START]", "[TEXT_END]", "[SEP]", "[MASK]", "[SCOPE_OPEN]",
    "[SCOPE_CLOSE]", "SUBTREE_TRUNCATED",
)
VARIABLES = (
    "X", "Y", "Z", "T", "N", "K", "A", "B", "C", "M", "I", "J", "R", "S", "U", "V", "W", "P", "Q", "L", "F", "G", "H", "THETA", "ALPHA", "BETA",
    "GAMMA_", "DELTA", "EPSILON", "ZETA", "ETA", "LAMBDA", "MU", "NU", "XI", "RHO", "SIGMA", "TAU", "PHI", "CHI", "PSI", "OMEGA", "IOTA", "KAPPA",
    "OMICRON", "UPSILON",
)
CONSTANTS = (
    "PI", "E", "I", "INF", "NEG_INF", "NAN",
)
PAD_ID, UNK_ID, BOS_ID, EOS_ID = 0, 1, 3, 4
UNK = "[UNK]"


def operator_rows() -> list[dict]:
    return [dict(zip(FIELDS, row, strict=True)) for row in OPERATORS]


def vocabulary_tokens() -> list[tuple[str, str]]:
    """(token, tier) in id order."""
    out = [(t, "special") for t in SPECIALS]
    out += [(r["token"], "operator") for r in operator_rows()]
    out += [(f"VAR_{v}", "variable") for v in VARIABLES]
    out += [(f"CONST_{n}", "constant") for n in range(-10, 101)] + [(f"CONST_{c}", "constant") for c in CONSTANTS]
    return out + [(f"NUM_{n}", "number") for n in range(101, 1001)]


def operators(spark: SparkSession) -> DataFrame:
    """One row an operator, in vocabulary order (``op_id``)."""
    rows = [(i + len(SPECIALS), *[r[f] for f in FIELDS]) for i, r in enumerate(operator_rows())]
    schema = "op_id int, token string, backing_type string, arity int, precedence int, associativity string, semantic_role string, latex_repr string, ascii_repr string, category string, is_commutative boolean"
    return spark.createDataFrame(rows, schema)


def get_operator(spark: SparkSession, token: str) -> DataFrame:
    return operators(spark).where(F.col("token") == token)


def by_category(spark: SparkSession, category: str) -> DataFrame:
    return operators(spark).where(F.col("category") == category)


def inverse_pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([p for a, b in INVERSE_PAIRS for p in ((a, b), (b, a))], "token string, inverse string")


def tokens_by(spark: SparkSession, field: str) -> DataFrame:
    """Tokens of each backing type or category, in vocabulary order."""
    ordered = F.array_sort(F.collect_list(F.struct("op_id", "token")))
    return operators(spark).groupBy(field).agg(F.transform(ordered, lambda x: x["token"]).alias("tokens"))


def fixed_vocabulary(spark: SparkSession) -> DataFrame:
    """(token, id, tier): 1129 rows; ids are positions."""
    return spark.createDataFrame([(t, i, tier) for i, (t, tier) in enumerate(vocabulary_tokens())], "token string, id int, tier string")
