"""Expression trees to rows of typed nodes, and back."""

from __future__ import annotations

import sys
from fractions import Fraction

from pyspark import cloudpickle

from treeloom.kernel.normal import Undefined, equivalent, expand, factor, settled, simplify
from treeloom.kernel.parse import MINUS, add, divide, mul, parse

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_DEPTH = 20

#: Function names with tokens of their own.
FUNCTION_TOKENS = {
    "sin": "FUNC_SIN", "cos": "FUNC_COS", "tan": "FUNC_TAN",
    "asin": "FUNC_ASIN", "acos": "FUNC_ACOS", "atan": "FUNC_ATAN",
    "sinh": "FUNC_SINH", "cosh": "FUNC_COSH", "tanh": "FUNC_TANH",
    "exp": "FUNC_EXP", "log": "FUNC_LOG", "sqrt": "FUNC_SQRT", "Abs": "OP_ABS",
    "gamma": "FUNC_GAMMA", "factorial": "FUNC_FACTORIAL",
    "floor": "FUNC_FLOOR", "ceiling": "FUNC_CEIL", "re": "FUNC_RE", "im": "FUNC_IM",
    "Derivative": "OP_DERIV", "Integral": "OP_INT", "Limit": "OP_LIMIT", "Sum": "OP_SUM", "Product": "OP_PROD",
}
#: Relations and their tokens.
RELATION_TOKENS = {"Eq": "OP_EQ", "Ne": "OP_NEQ", "Lt": "OP_LT", "Gt": "OP_GT", "Le": "OP_LE", "Ge": "OP_GE"}

#: (token, kids, confidence, own name): the own name keeps what a token folds.
Plan = tuple


def shape(tree) -> tuple[str, list, float, str]:
    """(token, children, confidence, name) of a tree's root."""
    kind = tree[0]
    if kind == "const":
        return f"CONST_{tree[1]}", [], 1.0, tree[1]
    if kind == "num":
        v = tree[1]
        if v.denominator != 1:
            return "FRAC", [("num", Fraction(v.numerator)), ("num", Fraction(v.denominator))], 1.0, str(v)
        if v < 0:
            return "OP_NEG", [("num", -v)], 1.0, str(v)
        return (f"CONST_{v}" if v <= 100 else f"NUM_{v}"), [], 1.0, str(v)
    if kind == "float":
        return "FLOAT_" + str(tree[1]).replace(".", "p").replace("-", "NEG"), [], 1.0, repr(tree[1])
    if kind == "sym":
        return ("VAR_GAMMA_" if tree[1] == "gamma" else f"VAR_{tree[1].upper()}"), [], 1.0, tree[1]
    if kind == "add":
        return "OP_ADD", list(tree[1:]), 1.0, ""
    if kind == "mul":
        if len(tree) == 3 and tree[1] == MINUS:
            return "OP_NEG", [tree[2]], 1.0, ""
        return "OP_MUL", list(tree[1:]), 1.0, ""
    if kind == "pow":
        if tree[2] == MINUS:
            return "OP_RECIP", [tree[1]], 1.0, ""
        return "OP_POW", [tree[1], tree[2]], 1.0, ""
    if kind == "rel":
        return RELATION_TOKENS[tree[1]], [tree[2], tree[3]], 1.0, tree[1]
    if kind == "tuple":
        return "FUNC_TUPLE", list(tree[1:]), 0.5, "tuple"
    known = FUNCTION_TOKENS.get(tree[1])
    return known or f"FUNC_{tree[1].upper()}", list(tree[2:]), 1.0 if known else 0.5, tree[1]


def rows_of(tree, max_depth: int = MAX_DEPTH) -> list[dict]:
    """Node rows in preorder: ids count from 0, the root's parent is -1.  At
    ``max_depth`` a subtree is one truncated leaf; the number inside a negative
    number is exempt."""
    rows: list[dict] = []
    stack = [(tree, -1, 0, 0, "0", False)]
    while stack:
        t, parent, index, depth, path, exempt = stack.pop()
        if depth >= max_depth and not exempt:
            token, kids, sure, name = "SUBTREE_TRUNCATED", [], 0.0, ""
        else:
            token, kids, sure, name = shape(t)
        own = len(rows)
        rows.append({"node_id": own, "parent_id": parent, "child_index": index, "depth": depth, "token": token, "num_children": len(kids), "is_leaf": not kids, "subtree_size": 1, "height": 0, "confidence": sure, "path": path, "name": name})
        inside = t[0] == "num" and token == "OP_NEG"
        stack += [(k, own, i, depth + 1, f"{path}.{i}", inside) for i, k in reversed(list(enumerate(kids)))]
    for r in reversed(rows):
        if r["parent_id"] >= 0:
            up = rows[r["parent_id"]]
            up["subtree_size"] += r["subtree_size"]
            up["height"] = max(up["height"], r["height"] + 1)
    return rows


def height(tree) -> int:
    """Depth of the tree before any mapping to tokens; a bare number has 0."""
    kids = [x for x in tree[1:] if isinstance(x, tuple)]
    return 1 + max(height(k) for k in kids) if kids else 0


def text_of(tree) -> str:
    """A readable form; equal trees have equal texts."""
    kind = tree[0]
    if kind in ("num", "float"):
        return str(tree[1])
    if kind == "const":
        return {"PI": "pi", "E": "E", "I": "I", "INF": "oo", "NEG_INF": "-oo", "NAN": "nan"}[tree[1]]
    if kind == "sym":
        return tree[1]
    if kind == "add":
        return " + ".join(text_of(x) for x in tree[1:]).replace("+ -", "- ")
    wrap = lambda x: f"({text_of(x)})" if x[0] in ("add", "mul", "rel", "pow") or x[0] == "num" and (x[1] < 0 or x[1].denominator != 1) else text_of(x)
    if kind == "mul":
        if tree[1] == MINUS:
            return "-" + "*".join(wrap(x) for x in tree[2:])
        return "*".join(f"({text_of(x)})" if x[0] in ("add", "rel") else text_of(x) for x in tree[1:])
    if kind == "pow":
        return f"{wrap(tree[1])}**{wrap(tree[2])}"
    if kind == "rel":
        return f"{tree[1]}({text_of(tree[2])}, {text_of(tree[3])})"
    if kind == "tuple":
        return "(" + ", ".join(text_of(x) for x in tree[1:]) + ")"
    return f"{tree[1]}({', '.join(text_of(x) for x in tree[2:])})"


def analyse(text: str | None, do_simplify: bool = True, do_expand: bool = True, do_factor: bool = False, max_depth: int = MAX_DEPTH) -> dict:
    """One expression's record: canonical text, format, trace, warnings and
    node rows.  Never raises; a failure has ``success`` false and no nodes."""
    source = text or ""
    form, tree, warnings = parse(source)
    if tree is None:
        return {"original": source, "canonical": "PARSE_ERROR", "input_format": None, "transformations": [], "warnings": warnings, "success": False, "raw_height": 0, "nodes": []}
    trace, raw = [f"parse_{form}"], tree
    tree = settled(tree)
    # the normal form is expanded, so where it is wanted it is the one step
    for name, wanted, step in (("expand", do_expand, simplify if do_simplify else expand), ("simplify", do_simplify, simplify), ("factor", do_factor, factor)):
        if wanted:
            try:
                tree = step(tree)
                trace.append(name)
            except (Undefined, OverflowError, RecursionError, ZeroDivisionError) as e:
                warnings.append(f"{name} left out: {e}")
    trace.append("normalize_sub_div")
    return {"original": source, "canonical": text_of(tree), "input_format": form, "transformations": trace, "warnings": warnings, "success": True, "raw_height": height(raw), "nodes": rows_of(tree, max_depth)}


def equal_texts(a: str | None, b: str | None) -> bool:
    """Whether both parse and their difference is zero."""
    x, y = parse(a or "")[1], parse(b or "")[1]
    if x is None or y is None:
        return False
    try:
        return equivalent(settled(x), settled(y))
    except (Undefined, OverflowError, RecursionError, ZeroDivisionError):
        return False


CONSTANT_NAMES = {"CONST_PI": "PI", "CONST_E": "E", "CONST_I": "I", "CONST_INF": "INF", "CONST_NEG_INF": "NEG_INF", "CONST_NAN": "NAN"}


def tree_from(rows: list) -> tuple:
    """The tree of node rows (node_id, parent_id, child_index, token, name)."""
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r["parent_id"], []).append(r)
    if len(by.get(-1, [])) != 1:
        raise ValueError("no root node")

    def build(r) -> tuple:
        kids = [build(k) for k in sorted(by.get(r["node_id"], []), key=lambda k: k["child_index"])]
        token, name = r["token"], r["name"]
        if token in CONSTANT_NAMES:
            return ("const", CONSTANT_NAMES[token])
        if token.startswith(("CONST_", "NUM_")):
            return ("num", Fraction(int(token.split("_", 1)[1])))
        if token.startswith("FLOAT_"):
            return ("float", float(token[6:].replace("p", ".").replace("NEG", "-")))
        if token.startswith("VAR_"):
            return ("sym", name or token[4:].lower().rstrip("_"))
        if token == "FRAC":
            return divide(*kids)
        if token == "OP_NEG":
            return ("mul", MINUS, kids[0])
        if token == "OP_RECIP":
            return ("pow", kids[0], MINUS)
        if token in ("OP_ADD", "OP_MUL"):
            return add(*kids) if token == "OP_ADD" else mul(*kids)
        if token == "OP_POW":
            return ("pow", *kids)
        if token in RELATION_TOKENS.values():
            return ("rel", next(k for k, v in RELATION_TOKENS.items() if v == token), *kids)
        if token == "FUNC_TUPLE":
            return ("tuple", *kids)
        if token == "SUBTREE_TRUNCATED":
            return ("sym", "TRUNCATED")
        known = {v: k for k, v in FUNCTION_TOKENS.items()}
        return ("fn", name or known.get(token) or token[5:].lower(), *kids)

    return build(by[-1][0])


def round_trip(text: str | None, rows: list | None) -> dict:
    """Rebuilds an expression from its rows and compares it with the text."""
    tree = parse(text or "")[1]
    if tree is None:
        return {"is_valid": False, "reconstructed": None, "error": "could not parse the original"}
    try:
        built = tree_from(rows or [])
        same = equivalent(settled(tree), built)
        return {"is_valid": same, "reconstructed": text_of(built), "error": None if same else "the difference is not zero"}
    except (Undefined, OverflowError, RecursionError, ZeroDivisionError, ValueError, IndexError, TypeError) as e:
        return {"is_valid": False, "reconstructed": None, "error": f"{type(e).__name__}: {e}"}
