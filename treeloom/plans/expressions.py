"""Queries that run the whole engine on expressions made from table columns,
so that SQL can say the expected tokens in closed form."""

from __future__ import annotations

from pyspark.sql import functions as F

from treeloom.functions import metrics as M
from treeloom.functions import operators_table as T
from treeloom.operators import bpe, encode, lexing, parsing
from treeloom.plans import suites


def _part(spark, sf_dir):
    k = (F.col("p_partkey") % 7 + 2).cast("int")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (F.col("p_size") + 1).alias("a"), k.alias("k"), (F.col("p_partkey") % 90 + 1).cast("int").alias("c"))


def _tokens(rows, expr, key="p_partkey", **options):
    """(key, tokens) of one expression a row, as a string."""
    run = encode.encode(rows.select(F.col(key).alias("doc_id"), expr.alias("text")), math_only=True, grow_vocabulary=False, **options)
    return run, run.documents().select(F.col("doc_id").alias(key), F.array_join("tokens", " ").alias("tokens"), "input_ids")


def _poly():
    return F.concat(F.col("a"), F.lit("*x^"), F.col("k"), F.lit(" + "), F.col("c"))


def poly_tokens(spark, sf_dir):
    return _tokens(_part(spark, sf_dir), _poly())[1].select("p_partkey", "tokens")


def poly_ids(spark, sf_dir):
    return _tokens(_part(spark, sf_dir), _poly())[1].select("p_partkey", F.array_join("input_ids", " ").alias("ids"))


def neg_recip_frac_tokens(spark, sf_dir):
    expr = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("-x^"), F.col("k"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("1/(x + "), F.col("c"), F.lit(")"))).otherwise(F.concat(2 * F.col("a") + 1, F.lit("/2")))
    return _tokens(_part(spark, sf_dir), expr)[1].select("p_partkey", "tokens")


_FUNCTIONS = ("sin", "cos", "tan", "log", "exp")


def function_scope_tokens(spark, sf_dir):
    name = F.get(F.array(*[F.lit(f) for f in _FUNCTIONS]), (F.col("p_partkey") % 5).cast("int"))
    return _tokens(_part(spark, sf_dir), F.concat(name, F.lit("(x^"), F.col("k"), F.lit(")")))[1].select("p_partkey", "tokens")


def _pairs(spark, sf_dir, left, right):
    rows = _part(spark, sf_dir)
    a, b = _tokens(rows, left)[1], _tokens(rows, right)[1]
    return a.select("p_partkey", F.split("tokens", " ").alias("tokens_a")).join(b.select("p_partkey", F.split("tokens", " ").alias("tokens_b")), "p_partkey")


def expand_square_pairs(spark, sf_dir):
    k = F.col("k").cast("string")
    pairs = _pairs(spark, sf_dir, F.concat(F.lit("(x+"), k, F.lit(")^2")), F.concat(F.lit("x^2 + "), 2 * F.col("k"), F.lit("*x + "), F.col("k") * F.col("k")))
    return M.pair_convergence(pairs).select("p_partkey", F.array_join("tokens_a", " ").alias("tokens"), "jaccard", "converged", "exact")


def latex_ascii_twins(spark, sf_dir):
    pairs = _pairs(spark, sf_dir, F.concat(F.lit("x/"), F.col("a")), F.concat(F.lit("\\frac{x}{"), F.col("a"), F.lit("}")))
    return pairs.select("p_partkey", F.array_join("tokens_a", " ").alias("ascii"), F.array_join("tokens_b", " ").alias("latex"))


def parse_failures(spark, sf_dir):
    rows = _part(spark, sf_dir)
    expr = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("@@"), F.col("a"))).otherwise(F.concat(F.lit("x + "), F.col("a")))
    run, out = _tokens(rows, expr)
    good = run.records.select(F.col("doc_id").alias("p_partkey"), F.col("record.success").alias("success"), F.col("record.canonical").alias("canonical"), F.array_join("record.transformations", " ").alias("trace"), (F.size("record.warnings") > 0).alias("warned"))
    return out.select("p_partkey", "tokens").join(good, "p_partkey")


_SUITE = (("poly", _poly), ("power", lambda: F.concat(F.lit("x^"), F.col("k"))), ("function", lambda: F.concat(F.lit("sin("), F.col("a"), F.lit("*x)"))), ("mixed", lambda: F.concat(F.lit("x + "), F.col("c"))))


def _suite(spark, sf_dir):
    """(doc_id, category, expr): every part gives one expression a category."""
    rows = _part(spark, sf_dir)
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(name).alias("category"), make().alias("expr")) for i, (name, make) in enumerate(_SUITE)])
    return rows.select("p_partkey", F.explode(cells).alias("s")).select((F.col("p_partkey") * 4 + F.col("s.i")).alias("doc_id"), "s.category", "s.expr")


def _stats(spark, sf_dir):
    """Long statistics: one row an expression and tokenizer."""
    suite = _suite(spark, sf_dir)
    run = encode.encode(suite.select("doc_id", F.col("expr").alias("text")), math_only=True, grow_vocabulary=False)
    bonus = run.records.select("doc_id", F.when(F.col("record.success"), 2).otherwise(0).alias("canonical_bonus"))
    columns = ("token_count", "operator_nodes", "function_scope", "tree_depth", "parent_child_relations", "canonical_bonus", "semantic_density", "structural_score", "raw_scr", "structural_efficiency")
    own = suite.join(M.score_structure(run.tokens, bonus), "doc_id").select("doc_id", "category", "expr", F.lit("structural").alias("tokenizer"), *columns)
    chars = M.score_characters(suite).select("doc_id", "category", "expr", F.lit("char").alias("tokenizer"), *columns)
    return own.unionByName(chars)


def struct_scores(spark, sf_dir):
    rows = _stats(spark, sf_dir).where("tokenizer = 'structural'")
    return rows.select("doc_id", "category", *[F.col(c).cast("int").alias(c) for c in ("token_count", "operator_nodes", "function_scope", "tree_depth", "parent_child_relations", "canonical_bonus")], "structural_score", F.round("raw_scr", 9).alias("raw_scr"), F.round("semantic_density", 9).alias("density"))


def category_mean_scr(spark, sf_dir):
    return M.category_means(_stats(spark, sf_dir)).select("category", "tokenizer", F.round("mean_scr", 7).alias("mean_scr"), "n")


def summary_means(spark, sf_dir):
    return M.summary_means(_stats(spark, sf_dir), with_mixed=False).select("tokenizer", *[F.round(c, 7).alias(c) for c in ("mean_scr", "mean_density", "mean_efficiency")], "n")


def improvement_ratios(spark, sf_dir):
    rows = _stats(spark, sf_dir)
    wide = rows.groupBy("doc_id", "category").pivot("tokenizer", ["structural", "char"]).agg(F.first("raw_scr"))
    return M.improvement(wide, "structural", "char", 0.0).select("doc_id", "category", F.round("structural_vs_char", 7).alias("improvement"))


def token_stability(spark, sf_dir):
    rows = _suite(spark, sf_dir).where("category in ('poly', 'power')")
    run = encode.encode(rows.select("doc_id", F.col("expr").alias("text")), math_only=True, grow_vocabulary=False)
    counts = run.tokens.groupBy("doc_id").agg(F.count("*").alias("token_count")).withColumn("grp", F.floor(F.col("doc_id") / 4))
    return M.token_stability(counts, "grp").select(F.round("ts", 7).alias("ts"), "n")


def operator_preservation(spark, sf_dir):
    suite = _suite(spark, sf_dir)
    run = encode.encode(suite.select("doc_id", F.col("expr").alias("text")), math_only=True, grow_vocabulary=False)
    return M.operator_preservation(suite.join(run.documents(), "doc_id"), "category").select("category", "preserved", "total", F.round("ops", 7).alias("ops"))


def canonical_consistency(spark, sf_dir):
    pairs = _pairs(spark, sf_dir, F.concat(F.lit("x + "), F.col("a")), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("a"), F.lit(" + x"))).otherwise(F.concat(F.lit("x*y + "), F.col("a"))))
    return M.canonical_consistency(pairs).select(F.round("ccs", 7).alias("ccs"), "n")


def tree_depth_fidelity(spark, sf_dir):
    suite = _suite(spark, sf_dir)
    run = encode.encode(suite.select("doc_id", F.col("expr").alias("text")), math_only=True, grow_vocabulary=False)
    depth = run.tokens.groupBy("doc_id").agg(F.max("depth").alias("depth"))
    truth = run.records.select("doc_id", F.col("record.raw_height").alias("truth"))
    return M.depth_fidelity(suite.join(depth, "doc_id").join(truth, "doc_id"), "category").select("category", F.round("tdf", 7).alias("tdf"), "n")


def roundtrip_valid(spark, sf_dir):
    suite = _suite(spark, sf_dir)
    return parsing.parsed(suite, "expr", check=True).groupBy("category").agg(F.count_if("is_valid").alias("valid"), F.count("*").alias("n"))


def equivalence(spark, sf_dir):
    rows = _part(spark, sf_dir)
    k = F.col("k").cast("string")
    right = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("x^2 + "), 2 * F.col("k"), F.lit("*x + "), F.col("k") * F.col("k"))).otherwise(F.concat(F.lit("x^2 + "), k))
    return rows.select("p_partkey", parsing.expr_equiv(F.concat(F.lit("(x+"), k, F.lit(")^2")), right).alias("equal"))


def dynamic_vocab(spark, sf_dir):
    rows = _part(spark, sf_dir).select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("x_"), F.col("c"), F.lit(" + "), F.col("p_partkey") + 2000).alias("text"))
    return encode.encode(rows, math_only=True).vocabulary.where("tier = 'dynamic'").select("token", "id")


def encode_bos_eos(spark, sf_dir):
    out = _tokens(_part(spark, sf_dir), _poly())[1]
    return out.select("p_partkey", F.array_join(encode.add_special(F.col("input_ids")), " ").alias("ids"))


def pad_and_mask(spark, sf_dir):
    rows = _suite(spark, sf_dir)
    out = encode.pad(encode.encode(rows.select("doc_id", F.col("expr").alias("text")), math_only=True, grow_vocabulary=False).documents())
    return out.select("doc_id", F.size("input_ids").alias("n"), F.aggregate("attention_mask", F.lit(0), lambda s, x: s + x).alias("real"))


def decode_skip_special(spark, sf_dir):
    out = _tokens(_part(spark, sf_dir), _poly())[1]
    return encode.decode(out.select("p_partkey", "input_ids"), T.fixed_vocabulary(spark), key="p_partkey")


def expression_sexps(spark, sf_dir):
    run, _ = _tokens(_part(spark, sf_dir), _poly())
    return run.sexps().select(F.col("doc_id").alias("p_partkey"), "sexp")


def mixed_text_documents(spark, sf_dir):
    """Delimited mathematics inside text, through lexer and parser."""
    rows = _part(spark, sf_dir)
    text = F.concat(F.lit("We take $"), _poly(), F.lit("$ again"))
    out = encode.encode(rows.select(F.col("p_partkey").alias("doc_id"), text.alias("text")), grow_vocabulary=False).documents()
    return out.select(F.col("doc_id").alias("p_partkey"), F.array_join("tokens", " ").alias("tokens"))


def _cases(spark, sf_dir, n, *exprs, **options):
    """(p_partkey, tokens): one of several expressions by the key's remainder."""
    rows = _part(spark, sf_dir)
    cell = lambda x: F.concat(*[F.col(p) if p in ("a", "c", "k") else F.lit(p) for p in x])
    expr = F.get(F.array(*[cell(x) for x in exprs]), (F.col("p_partkey") % n).cast("int"))
    return _tokens(rows, expr, **options)[1].select("p_partkey", "tokens")


def relation_tokens(spark, sf_dir):
    return _cases(spark, sf_dir, 5, ("a", "*x < ", "c"), ("a", "*x > ", "c"), ("a", "*x <= ", "c"), ("a", "*x >= ", "c"), ("\\alpha \\leq ", "c"))


def calculus_tokens(spark, sf_dir):
    return _cases(spark, sf_dir, 4, ("diff(x^", "k", " + ", "c", "*y, x)"), ("integrate(cos(x) + ", "c", "*x - ", "c", "*x, x)"), ("limit(x^", "k", " + ", "c", ", x, 1)"), ("\\int x^{", "k", "} dx"))


def constant_tokens(spark, sf_dir):
    return _cases(spark, sf_dir, 8, ("pi*x + ", "c"), ("E + ", "c"), ("oo - ", "c"), ("-", "a", "*oo"), ("oo - oo + ", "c"), ("0*oo*", "a"), ("-", "a"), ("sqrt(x + ", "c", ")"))


def float_tokens(spark, sf_dir):
    return _cases(spark, sf_dir, 3, ("c", ".5*x"), ("-", "c", ".25"), ("x + ", "c", ".5"))


def latex_tokens(spark, sf_dir):
    return _cases(spark, sf_dir, 7, ("\\alpha + ", "a"), ("\\beta^{", "k", "}"), ("\\sqrt{x + ", "a", "}"), ("\\frac{", "a", "}{x}"), ("\\sinh(x) \\cdot ", "a"), ("\\omega \\times ", "a"), ("\\theta - ", "a"))


def factor_tokens(spark, sf_dir):
    rows = _part(spark, sf_dir)
    expr = F.concat(F.lit("x^2 - "), F.col("a") * F.col("a"))
    return _tokens(rows, expr, do_factor=True)[1].select("p_partkey", "tokens")


def expand_only_tokens(spark, sf_dir):
    """Expanded but not simplified: the squares' identity is left alone."""
    return _cases(spark, sf_dir, 2, ("(x + ", "a", ")*(x - ", "a", ")"), ("sin(x)^2 + cos(x)^2 + ", "a"), do_simplify=False)


def lexed_delimiters(spark, sf_dir):
    """Spans of texts with all four delimiters."""
    text = F.concat(F.lit("Take $x + "), F.col("a"), F.lit("$ and \\(y\\) or \\[z^"), F.col("k"), F.lit("\\] so $$ w $$ end"))
    docs = _part(spark, sf_dir).select(F.col("p_partkey").alias("doc_id"), text.alias("text"))
    return lexing.spans(docs, ascii_math=False).select("doc_id", "span_idx", "span_type", "content", "start", "end")


def math_only_documents(spark, sf_dir):
    rows = _part(spark, sf_dir)
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" $x + "), F.col("a"), F.lit("$ "))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("so $x$ "), F.col("a"))).otherwise(F.lit("  "))
    docs = rows.select(F.col("p_partkey").alias("doc_id"), text.alias("text"))
    return lexing.is_math_only(lexing.spans(docs, ascii_math=False), docs)


def first_token_counts(spark, sf_dir):
    stats = _stats(spark, sf_dir)
    return suites.first_counts(stats).select("doc_id", "token_count")


def shown_densities(spark, sf_dir):
    return M.shown_means(_stats(spark, sf_dir), "semantic_density").select("tokenizer", F.round("mean", 7).alias("mean"))


def pieces_without_spaces(spark, sf_dir):
    rows = _part(spark, sf_dir).select("p_partkey", F.array(F.lit("sin"), F.lit("("), F.lit(" "), F.col("a").cast("string"), F.lit("*"), F.lit("x"), F.lit(" "), F.lit(")")).alias("tokens"))
    return M.score_pieces(rows, drop_spaces=True).select("p_partkey", F.col("token_count").cast("int").alias("token_count"), F.col("operator_nodes").cast("int").alias("operator_nodes"), F.col("function_scope").cast("int").alias("function_scope"))


def vocabulary_tiers(spark, sf_dir):
    return encode.vocabulary_sizes(T.fixed_vocabulary(spark)).select("tier", "n")


def text_piece_ids(spark, sf_dir):
    """A text tokenizer of single letters: its ids follow the fixed vocabulary."""
    letters = bpe.TextTokenizer(["[UNK]", *"abcdefghijklmnopqrstuvwxyz"], [])
    docs = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text"))
    run = encode.encode(docs, grow_vocabulary=False, lexer={"ascii_math": False}, stages=encode.Stages(text=letters))
    return run.documents().select(F.col("doc_id").alias("p_partkey"), F.array_join("input_ids", " ").alias("ids"))


def record_warnings(spark, sf_dir):
    """Whole records: lengths of their parts."""
    rows = _part(spark, sf_dir)
    text = F.concat(F.lit("$x + "), F.col("a"), F.lit("$ $@@"), F.col("a"), F.lit("$"))
    out = encode.full_records(encode.encode(rows.select(F.col("p_partkey").alias("doc_id"), text.alias("text")), grow_vocabulary=False))
    return out.select(F.col("doc_id").alias("p_partkey"), F.size("tokens").alias("n_tokens"), F.size("metadata").alias("n_metadata"), F.array_join("math_sexps", "|").alias("sexps"), F.size("warnings").alias("n_warnings"))


QUERIES = {f.__name__: f for f in (relation_tokens, calculus_tokens, constant_tokens, float_tokens, latex_tokens, factor_tokens, expand_only_tokens, lexed_delimiters, math_only_documents, first_token_counts, shown_densities, pieces_without_spaces, vocabulary_tiers, text_piece_ids, record_warnings, poly_tokens, poly_ids, neg_recip_frac_tokens, function_scope_tokens, expand_square_pairs, latex_ascii_twins, parse_failures, struct_scores, category_mean_scr, summary_means, improvement_ratios, token_stability, operator_preservation, canonical_consistency, tree_depth_fidelity, roundtrip_valid, equivalence, dynamic_vocab, encode_bos_eos, pad_and_mask, decode_skip_special, expression_sexps, mixed_text_documents)}

_P = "WITH p AS (SELECT p_partkey, p_size + 1 AS a, (p_partkey % 7 + 2)::INT AS k, (p_partkey % 90 + 1)::INT AS c FROM part)"
_POLY = "'[MATH_START] OP_ADD OP_MUL CONST_' || a || ' OP_POW VAR_X CONST_' || k || ' CONST_' || c || ' [MATH_END]'"
_IDS = "'5 14 15 ' || (122 + a) || ' 16 66 ' || (122 + k) || ' ' || (122 + c) || ' 6'"
# token_count, operators, functions, depth, relations, length of the text, its operators, bracket depth
_SUITE_SQL = f"""{_P},
s AS (
 SELECT p_partkey * 4 AS doc_id, 'poly' AS category, 9 AS n, 3 AS ops, 0 AS f, 3 AS d, 3 AS rel, 7 AS math, length(a || '*x^' || k || ' + ' || c) AS len, 3 AS cops, 0 AS cd FROM p
 UNION ALL SELECT p_partkey * 4 + 1, 'power', 5, 1, 0, 1, 1, 3, 3, 1, 0 FROM p
 UNION ALL SELECT p_partkey * 4 + 2, 'function', 8, 1, 1, 2, 2, 4, length('sin(' || a || '*x)'), 1, 1 FROM p
 UNION ALL SELECT p_partkey * 4 + 3, 'mixed', 5, 1, 0, 1, 1, 3, length('x + ' || c), 1, 0 FROM p),
st AS (SELECT *, (ops + d + rel + f + 2)::DOUBLE AS score, (ops + d + rel + f + 2)::DOUBLE / n AS scr, (2 * cops + cd)::DOUBLE / len AS cscr FROM s)"""

ORACLES = {
    "relation_tokens": f"""{_P} SELECT p_partkey, '[MATH_START] ' || CASE WHEN p_partkey % 5 = 4 THEN 'OP_LE VAR_ALPHA' ELSE (['OP_LT', 'OP_GT', 'OP_LE', 'OP_GE'])[p_partkey % 5 + 1] || ' OP_MUL CONST_' || a || ' VAR_X' END || ' CONST_' || c || ' [MATH_END]' AS tokens FROM p""",
    "calculus_tokens": f"""{_P} SELECT p_partkey, '[MATH_START] ' || CASE p_partkey % 4 WHEN 0 THEN 'OP_MUL CONST_' || k || CASE WHEN k = 2 THEN ' VAR_X' ELSE ' OP_POW VAR_X CONST_' || (k - 1) END
 WHEN 1 THEN 'FUNC_SIN [SCOPE_OPEN] VAR_X [SCOPE_CLOSE]' WHEN 2 THEN 'CONST_' || (c + 1) ELSE 'OP_INT OP_POW VAR_X CONST_' || k || ' FUNC_TUPLE [SCOPE_OPEN] VAR_X [SCOPE_CLOSE]' END || ' [MATH_END]' AS tokens FROM p""",
    "constant_tokens": f"""{_P} SELECT p_partkey, '[MATH_START] ' || CASE p_partkey % 8 WHEN 0 THEN 'OP_ADD OP_MUL CONST_PI VAR_X CONST_' || c WHEN 1 THEN 'OP_ADD CONST_E CONST_' || c WHEN 2 THEN 'CONST_INF' WHEN 3 THEN 'CONST_NEG_INF'
 WHEN 4 THEN 'CONST_NAN' WHEN 5 THEN 'CONST_NAN' WHEN 6 THEN 'OP_NEG CONST_' || a ELSE 'OP_POW OP_ADD VAR_X CONST_' || c || ' FRAC CONST_1 CONST_2' END || ' [MATH_END]' AS tokens FROM p""",
    "float_tokens": f"{_P} SELECT p_partkey, '[MATH_START] ' || CASE p_partkey % 3 WHEN 0 THEN 'OP_MUL FLOAT_' || c || 'p5 VAR_X' WHEN 1 THEN 'FLOAT_NEG' || c || 'p25' ELSE 'OP_ADD VAR_X FLOAT_' || c || 'p5' END || ' [MATH_END]' AS tokens FROM p",
    "latex_tokens": f"""{_P} SELECT p_partkey, '[MATH_START] ' || CASE p_partkey % 7 WHEN 0 THEN 'OP_ADD VAR_ALPHA CONST_' || a WHEN 1 THEN 'OP_POW VAR_BETA CONST_' || k WHEN 2 THEN 'OP_POW OP_ADD VAR_X CONST_' || a || ' FRAC CONST_1 CONST_2'
 WHEN 3 THEN 'OP_MUL CONST_' || a || ' OP_RECIP VAR_X' WHEN 4 THEN 'OP_MUL CONST_' || a || ' FUNC_SINH [SCOPE_OPEN] VAR_X [SCOPE_CLOSE]' WHEN 5 THEN 'OP_MUL CONST_' || a || ' VAR_OMEGA' ELSE 'OP_ADD VAR_THETA OP_NEG CONST_' || a END || ' [MATH_END]' AS tokens FROM p""",
    "factor_tokens": f"{_P} SELECT p_partkey, '[MATH_START] OP_MUL OP_ADD VAR_X OP_NEG CONST_' || a || ' OP_ADD VAR_X CONST_' || a || ' [MATH_END]' AS tokens FROM p",
    "expand_only_tokens": f"""{_P} SELECT p_partkey, '[MATH_START] ' || CASE p_partkey % 2 WHEN 0 THEN 'OP_ADD OP_POW VAR_X CONST_2 OP_NEG ' || CASE WHEN a * a <= 100 THEN 'CONST_' ELSE 'NUM_' END || (a * a)
 ELSE 'OP_ADD OP_POW FUNC_COS [SCOPE_OPEN] VAR_X [SCOPE_CLOSE] CONST_2 OP_POW FUNC_SIN [SCOPE_OPEN] VAR_X [SCOPE_CLOSE] CONST_2 CONST_' || a END || ' [MATH_END]' AS tokens FROM p""",
    "lexed_delimiters": rf"""{_P},
s AS (SELECT p_partkey, unnest([['TEXT', 'Take ', 'Take '], ['MATH', 'x + ' || a, '$x + ' || a || '$'], ['TEXT', ' and ', ' and '], ['MATH', 'y', '\(y\)'], ['TEXT', ' or ', ' or '], ['MATH', 'z^' || k, '\[z^' || k || '\]'], ['TEXT', ' so ', ' so '], ['MATH', 'w', '$$ w $$'], ['TEXT', ' end', ' end']]) AS x, unnest(range(9)) AS i FROM p),
e AS (SELECT *, sum(length(x[3])) OVER (PARTITION BY p_partkey ORDER BY i) AS stop FROM s)
SELECT p_partkey AS doc_id, i::INT AS span_idx, x[1] AS span_type, x[2] AS content, (stop - length(x[3]))::INT AS start, stop::INT AS "end" FROM e""",
    "math_only_documents": "SELECT p_partkey AS doc_id, p_partkey % 3 <> 1 AS math_only FROM part",
    "first_token_counts": f"{_SUITE_SQL} SELECT doc_id, n AS token_count FROM s ORDER BY doc_id LIMIT 15",
    "shown_densities": f"{_SUITE_SQL} SELECT 'structural' AS tokenizer, round(avg(math::DOUBLE / n), 7) AS mean FROM st UNION ALL SELECT 'char', round(avg(cops::DOUBLE / len), 7) FROM st",
    "pieces_without_spaces": "SELECT p_partkey, 8::INT AS token_count, 1::INT AS operator_nodes, 1::INT AS function_scope FROM part",
    "vocabulary_tiers": "SELECT * FROM (VALUES ('special', 14), ('operator', 52), ('variable', 46), ('constant', 117), ('number', 900)) t(tier, n)",
    "text_piece_ids": r"""WITH c AS (SELECT p_partkey, unnest(string_split(regexp_replace(p_name, '\s+', '', 'g'), '')) AS ch, unnest(range(length(regexp_replace(p_name, '\s+', '', 'g')))) AS i FROM part)
SELECT p_partkey, string_agg((CASE WHEN ch BETWEEN 'a' AND 'z' THEN 1129 + ascii(ch) - 96 ELSE 1129 END)::VARCHAR, ' ' ORDER BY i) AS ids FROM c GROUP BY p_partkey""",
    "record_warnings": f"{_P} SELECT p_partkey, 6::INT AS n_tokens, 6::INT AS n_metadata, '(OP_ADD VAR_X CONST_' || a || ')|[UNK]' AS sexps, 1::INT AS n_warnings FROM p",
    "poly_tokens": f"{_P} SELECT p_partkey, {_POLY} AS tokens FROM p",
    "poly_ids": f"{_P} SELECT p_partkey, {_IDS} AS ids FROM p",
    "neg_recip_frac_tokens": f"""{_P} SELECT p_partkey, '[MATH_START] ' || CASE p_partkey % 3 WHEN 0 THEN 'OP_NEG OP_POW VAR_X CONST_' || k WHEN 1 THEN 'OP_RECIP OP_ADD VAR_X CONST_' || c
 ELSE 'FRAC ' || CASE WHEN 2 * a + 1 > 100 THEN 'NUM_' ELSE 'CONST_' END || (2 * a + 1) || ' CONST_2' END || ' [MATH_END]' AS tokens FROM p""",
    "function_scope_tokens": f"{_P} SELECT p_partkey, '[MATH_START] ' || (['FUNC_SIN', 'FUNC_COS', 'FUNC_TAN', 'FUNC_LOG', 'FUNC_EXP'])[p_partkey % 5 + 1] || ' [SCOPE_OPEN] OP_POW VAR_X CONST_' || k || ' [SCOPE_CLOSE] [MATH_END]' AS tokens FROM p",
    "expand_square_pairs": f"{_P} SELECT p_partkey, '[MATH_START] OP_ADD OP_POW VAR_X CONST_2 OP_MUL CONST_' || (2 * k) || ' VAR_X CONST_' || (k * k) || ' [MATH_END]' AS tokens, 1.0::DOUBLE AS jaccard, true AS converged, true AS exact FROM p",
    "latex_ascii_twins": f"{_P} SELECT p_partkey, '[MATH_START] OP_MUL FRAC CONST_1 CONST_' || a || ' VAR_X [MATH_END]' AS ascii, '[MATH_START] OP_MUL FRAC CONST_1 CONST_' || a || ' VAR_X [MATH_END]' AS latex FROM p",
    "parse_failures": f"""{_P} SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '[UNK]' ELSE '[MATH_START] OP_ADD VAR_X CONST_' || a || ' [MATH_END]' END AS tokens, p_partkey % 4 <> 0 AS success,
 CASE WHEN p_partkey % 4 = 0 THEN 'PARSE_ERROR' ELSE 'x + ' || a END AS canonical, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'parse_ascii expand simplify normalize_sub_div' END AS trace, p_partkey % 4 = 0 AS warned FROM p""",
    "struct_scores": f"{_SUITE_SQL} SELECT doc_id, category, n AS token_count, ops AS operator_nodes, f AS function_scope, d AS tree_depth, rel AS parent_child_relations, 2 AS canonical_bonus, score AS structural_score, round(scr, 9) AS raw_scr, round(math::DOUBLE / n, 9) AS density FROM st",
    "category_mean_scr": f"""{_SUITE_SQL} SELECT category, 'structural' AS tokenizer, round(avg(scr), 7) AS mean_scr, count(*) AS n FROM st WHERE category <> 'mixed' GROUP BY category
 UNION ALL SELECT category, 'char', round(avg(cscr), 7), count(*) FROM st WHERE category <> 'mixed' GROUP BY category""",
    "summary_means": f"""{_SUITE_SQL} SELECT 'structural' AS tokenizer, round(avg(scr), 7) AS mean_scr, round(avg(math::DOUBLE / n), 7) AS mean_density, round(avg(rel::DOUBLE / n), 7) AS mean_efficiency, count(*) AS n FROM st WHERE category <> 'mixed'
 UNION ALL SELECT 'char', round(avg(cscr), 7), round(avg(cops::DOUBLE / len), 7), round(avg(cops::DOUBLE / len), 7), count(*) FROM st WHERE category <> 'mixed'""",
    "improvement_ratios": f"{_SUITE_SQL} SELECT doc_id, category, round(scr / cscr, 7) AS improvement FROM st",
    "token_stability": "SELECT round(1 - (sqrt(8.0) / 7)::DOUBLE, 7) AS ts, count(*) AS n FROM part",
    "operator_preservation": "SELECT category, CASE WHEN category IN ('poly', 'power', 'function', 'mixed') THEN n ELSE 0 END AS preserved, n AS total, 1.0::DOUBLE AS ops FROM (SELECT count(*) AS n FROM part), (VALUES ('poly'), ('power'), ('function'), ('mixed')) t(category)",
    "canonical_consistency": f"{_P} SELECT round(avg(CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 3.0 / 5 END)::DOUBLE, 7) AS ccs, count(*) AS n FROM p",
    "tree_depth_fidelity": "SELECT category, tdf::DOUBLE AS tdf, n FROM (SELECT count(*) AS n FROM part), (VALUES ('poly', 1.0), ('power', 1.0), ('function', 1.0), ('mixed', 1.0)) t(category, tdf)",
    "roundtrip_valid": "SELECT category, n AS valid, n FROM (SELECT count(*) AS n FROM part), (VALUES ('poly'), ('power'), ('function'), ('mixed')) t(category)",
    "equivalence": "SELECT p_partkey, p_partkey % 2 = 0 AS equal FROM part",
    "dynamic_vocab": """
WITH t AS (SELECT p_partkey, 2 AS pos, 'VAR_X_' || (p_partkey % 90 + 1) AS token FROM part UNION ALL SELECT p_partkey, 3, 'NUM_' || (p_partkey + 2000) FROM part),
f AS (SELECT token, min(p_partkey * 10 + pos) AS seen FROM t GROUP BY token)
SELECT token, (1128 + row_number() OVER (ORDER BY seen))::INT AS id FROM f""",
    "encode_bos_eos": f"{_P} SELECT p_partkey, '3 ' || {_IDS} || ' 4' AS ids FROM p",
    "pad_and_mask": f"{_SUITE_SQL} SELECT doc_id, 9 AS n, n::INT AS real FROM st",
    "decode_skip_special": f"{_P} SELECT p_partkey, 'OP_ADD OP_MUL CONST_' || a || ' OP_POW VAR_X CONST_' || k || ' CONST_' || c AS text FROM p",
    "expression_sexps": f"{_P} SELECT p_partkey, '(OP_ADD (OP_MUL CONST_' || a || ' (OP_POW VAR_X CONST_' || k || ')) CONST_' || c || ')' AS sexp FROM p",
    "mixed_text_documents": f"{_P} SELECT p_partkey, '[UNK] [UNK] [UNK] [UNK] [UNK] [UNK] [UNK] ' || {_POLY} || ' [UNK] [UNK] [UNK] [UNK] [UNK]' AS tokens FROM p",
}
