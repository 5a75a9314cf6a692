"""Evaluation suites, the comparison of tokenizers over them, and the
benchmark of five metrics over a dataset file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeloom.functions import metrics as M
from treeloom.functions.session import guard
from treeloom.operators import encode
from treeloom.sources import text as sources

#: The suites' inputs; published scores refer to them.
SUITES = {
    "standard": [
        "(x+1)^2", "sin(x^2) + 3*x", "x^2 + 2*x + 1", "exp(-x^2/2)", "1/(1 + exp(-x))",
        "log(x*y)", "sqrt(a^2 + b^2)", "n*(n+1)/2", "factorial(n)", "diff(sin(x), x)",
        "integrate(x^2, x)", "limit(sin(x)/x, x, 0)", "a^2 - b^2", "(-b + sqrt(b^2 - 4*a*c)) / (2*a)", "sum(k^2, k, 1, n)",
    ],
    "deep_nesting": [
        "sin(cos(x^2 + 1))", "sin(cos((x+1)^2 + y^3))", "exp(log(sin(x^2 + cos(y))))", "sqrt(1 + sqrt(1 + sqrt(x)))",
        "log(1 + log(1 + x))", "((x+1)^2 + (y-1)^2)^3", "((a + b)*(a - b)) / ((a + b)^2)",
    ],
    "ode_pde": ["Derivative(f(x), x, 2) + 2*Derivative(f(x), x) + f(x)", "Derivative(u(x, t), t) - alpha * Derivative(u(x, t), x, 2)"],
    "linear_algebra": ["A*x + b", "det(A - lambda*I)"],
    "probability": ["P(A|B) * P(B) / P(A)", "exp(-x^2 / 2) / sqrt(2*pi)"],
    "set_theory": ["Union(A, B)", "Intersection(A, B)"],
    "mixed_text_math": [
        "The derivative of sin(x^2) with respect to x.",
        "Solve for x when x^2 + 2*x + 1 = 0.",
        "The quadratic formula gives $x = \\frac{-b \\pm \\sqrt{b^2 - 4ac}}{2a}$.",
        "For $n \\geq 1$, the sum $\\sum_{k=1}^{n} k = \\frac{n(n+1)}{2}$.",
        "Integrate $\\int_0^1 x^2 dx$ to get $\\frac{1}{3}$.",
        "If $a > 0$ and $b > 0$ then $\\log(a) + \\log(b) = \\log(ab)$.",
        "The area of a circle of radius r is pi*r^2.",
        "Euler's identity: $e^{i\\pi} + 1 = 0$.",
    ],
}
#: The paired inputs.
PAIRS = {
    "canonical": [
        ("x + 2", "2 + x"), ("a*b + a*c", "a*(b+c)"), ("(x+1)^2", "x^2 + 2*x + 1"), ("x^2 - y^2", "(x+y)*(x-y)"),
        ("sin(x)^2 + cos(x)^2", "1"), ("2*x + 2*y", "2*(x+y)"), ("x*y + x*z", "x*(y+z)"), ("a^2 + 2*a*b + b^2", "(a+b)^2"),
    ],
    "latex_vs_ascii": [
        ("sin(x^2)", "\\sin(x^2)"), ("sqrt(x^2 + 1)", "\\sqrt{x^2 + 1}"), ("log(x)", "\\ln(x)"), ("exp(x)", "e^x"),
        ("x/y", "\\frac{x}{y}"), ("int(x^2, x)", "\\int x^2 dx"), ("diff(sin(x), x)", "\\frac{d}{dx}\\sin(x)"), ("factorial(n)", "n!"),
    ],
}


def suite(spark: SparkSession, *names: str) -> DataFrame:
    """(doc_id, category, expr, pair): records in order; the twin suite gives
    its two notations categories of their own."""
    rows = [(name, expr, None) for name, exprs in SUITES.items() if not names or name in names for expr in exprs]
    for name, pairs in PAIRS.items():
        if not names or name in names:
            for k, pair in enumerate(pairs):
                for side, expr in zip(("_ascii", "_latex"), pair, strict=True):
                    rows.append((name + side if name == "latex_vs_ascii" else name, expr, f"{name}:{k}"))
    unknown = set(names) - set(SUITES) - set(PAIRS)
    if unknown:
        raise ValueError(f"no suite {sorted(unknown)}")
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id bigint, category string, expr string, pair string")


COLUMNS = ("token_count", "operator_nodes", "function_scope", "tree_depth", "parent_child_relations", "canonical_bonus", "semantic_density", "structural_score", "raw_scr", "structural_efficiency")


def encode_suite(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tokens with doc_id, records) of suite rows: mixed text goes through the
    lexer, anything else is one expression."""
    mixed = F.col("category").contains("mixed")
    docs = lambda r: r.select("doc_id", F.col("expr").alias("text"))
    runs = [encode.encode(docs(rows.where(~mixed)), math_only=True), encode.encode(docs(rows.where(mixed)))]
    return runs[0].tokens.unionByName(runs[1].tokens), runs[0].records.unionByName(runs[1].records)


def compare(rows: DataFrame, tokenizers: dict | None = None) -> DataFrame:
    """Long statistics (doc_id, category, expr, pair, tokenizer, ...) of the
    structural tokens, characters, and any further tokenizer, given as a
    function from a text column to an array of pieces."""
    guard(rows.sparkSession)
    keep = ("doc_id", "category", "expr", "pair")
    tokens, records = encode_suite(rows)
    first = records.groupBy("doc_id").agg(F.min_by(F.col("record.success"), "span_idx").alias("ok"))
    bonus = first.select("doc_id", F.when(F.col("ok"), 2).otherwise(0).alias("canonical_bonus"))
    out = [rows.join(M.score_structure(tokens, bonus), "doc_id").select(*keep, F.lit("structural").alias("tokenizer"), *COLUMNS)]
    out.append(M.score_characters(rows).select(*keep, F.lit("char").alias("tokenizer"), *COLUMNS))
    for name, pieces in (tokenizers or {}).items():
        out.append(M.score_pieces(rows.withColumn("tokens", pieces(F.col("expr")))).select(*keep, F.lit(name).alias("tokenizer"), *COLUMNS))
    return reduce(DataFrame.unionByName, out)


def pair_report(rows: DataFrame) -> DataFrame:
    """(pair, expr_a, expr_b, jaccard, converged, exact) of the paired suites."""
    tokens, _ = encode_suite(rows.where("pair is not null"))
    sets = tokens.groupBy("doc_id").agg(F.collect_set("token").alias("tokens"))
    order = Window.partitionBy("pair").orderBy("doc_id")
    sides = rows.where("pair is not null").join(sets, "doc_id").withColumn("n", F.row_number().over(order))
    a = sides.where("n = 1").select("pair", F.col("expr").alias("expr_a"), F.col("tokens").alias("tokens_a"))
    b = sides.where("n = 2").select("pair", F.col("expr").alias("expr_b"), F.col("tokens").alias("tokens_b"))
    return M.pair_convergence(a.join(b, "pair")).select("pair", "expr_a", "expr_b", "jaccard", "converged", "exact")


def first_counts(stats: DataFrame, n: int = 15) -> DataFrame:
    """Token counts of the first records, in record order."""
    return stats.where("tokenizer = 'structural'").orderBy("doc_id").limit(n).select("doc_id", "expr", "token_count")


def sentencepiece_pieces(model_path: str):
    """A function from a text column to the pieces of a SentencePiece model;
    where the model or its library is missing, characters, with a warning."""
    import warnings

    import pyarrow as pa

    try:
        import sentencepiece

        with open(model_path, "rb") as f:
            model = f.read()
        sentencepiece.SentencePieceProcessor(model_proto=model)
    except (ImportError, OSError, RuntimeError) as e:
        warnings.warn(f"no SentencePiece model ({e}); characters instead", stacklevel=2)
        return M.characters

    @F.arrow_udf(returnType="array<string>")
    def run(text: pa.Array) -> pa.Array:
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_proto=model)
        return pa.array([own.encode(t.as_py() or "", out_type=str) for t in text], pa.list_(pa.string()))

    return run


def bpe_pieces(vocabulary_path: str, pattern: str = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"):
    """The same for a byte-level vocabulary file (base64 token and rank a line)."""
    import base64
    import warnings

    import pyarrow as pa

    try:
        import tiktoken  # noqa: F401

        with open(vocabulary_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    except (ImportError, OSError, ValueError) as e:
        warnings.warn(f"no byte-pair vocabulary ({e}); characters instead", stacklevel=2)
        return M.characters

    @F.arrow_udf(returnType="array<string>")
    def run(text: pa.Array) -> pa.Array:
        import tiktoken

        own = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return pa.array([[own.decode_single_token_bytes(i).decode(errors="replace") for i in own.encode_ordinary(t.as_py() or "")] for t in text], pa.list_(pa.string()))

    return run


def baseline_comparison(spark: SparkSession, path: str, baseline="char", quick: bool = False) -> DataFrame:
    """(name, structural, baseline) of the two metrics that any tokenizer has:
    tokens a character and canonical consistency."""
    own, other = benchmark(spark, path, quick), benchmark(spark, path, quick, baseline)
    return own.select("name", F.col("value").alias("structural")).join(other.select("name", F.col("value").alias("baseline")), "name").where(F.col("name").isin("scr_chars", "ccs"))


def benchmark(spark: SparkSession, path: str, quick: bool = False, tokenizer="structural") -> DataFrame:
    """(name, value, n) of the five metrics over a dataset file; ``quick``
    takes the first 20 of each section.  ``tokenizer`` is "structural", "char" or
    a function from a text column to an array of pieces."""
    if not callable(tokenizer) and tokenizer not in ("structural", "char"):
        raise ValueError(tokenizer)
    guard(spark)
    data, limit = sources.dataset(spark, path), 20 if quick else None
    single = sources.dataset_section(data, "expressions", limit).select(F.lit("e").alias("s"), "idx", F.lit(0).alias("m"), "expr")
    grouped = [sources.dataset_section(data, name, limit).select(F.lit(tag).alias("s"), "idx", F.posexplode("members").alias("m", "expr")) for name, tag in (("equivalent_pairs", "p"), ("rewriting_groups", "g"))]
    rows = reduce(DataFrame.unionAll, [single, *grouped]).withColumn("doc_id", F.row_number().over(Window.orderBy("s", "idx", "m")).cast("bigint"))
    if tokenizer != "structural":
        pieces = M.characters if tokenizer == "char" else tokenizer
        sets = rows.withColumn("tokens", pieces(F.col("expr"))).withColumns({"depth": F.lit(0), "truth": F.lit(0)})
    else:
        run = encode.encode(rows.select("doc_id", F.col("expr").alias("text")), math_only=True)
        depth = run.tokens.groupBy("doc_id").agg(F.greatest(F.max("depth"), F.lit(0)).alias("depth"))
        sets = rows.join(run.documents(), "doc_id").join(depth, "doc_id").join(run.records.select("doc_id", F.col("record.raw_height").alias("truth")), "doc_id")
    sets = sets.withColumn("token_count", F.size("tokens"))
    own = sets.where("s = 'e'")
    pairs = sets.where("s = 'p'").groupBy("idx").agg(F.max_by("tokens", -F.col("m")).alias("tokens_a"), F.max_by("tokens", "m").alias("tokens_b"))
    found = [M.scr_chars(own).select(F.lit("scr_chars").alias("name"), F.col("scr_chars").alias("value"), "n"), M.canonical_consistency(pairs).select(F.lit("ccs"), "ccs", "n"), M.operator_preservation(own).select(F.lit("ops"), "ops", F.col("total")), M.token_stability(sets.where("s = 'g'"), "idx").select(F.lit("ts"), "ts", "n"), M.depth_fidelity(own).select(F.lit("tdf"), "tdf", "n")]
    return reduce(DataFrame.unionAll, found)
