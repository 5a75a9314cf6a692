"""Quality metrics of tokenizers, as column expressions and aggregations.

Two published ratios share one short name; here they are ``scr_chars``
(tokens a character, lower is better) and ``scr_struct`` (structural score a
token, higher is better)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Substrings of a lower-cased expression and the token each leads to expect.
EXPECTED = (
    ("+", "OP_ADD"), ("*", "OP_MUL"), ("^", "OP_POW"), ("**", "OP_POW"),
    ("/", "FRAC"), ("sin", "FUNC_SIN"), ("cos", "FUNC_COS"), ("tan", "FUNC_TAN"),
    ("log", "FUNC_LOG"), ("exp", "FUNC_EXP"), ("sqrt", "FUNC_SQRT"), ("diff", "OP_DERIV"),
    ("integrate", "OP_INT"), ("lim", "OP_LIMIT"), ("sum", "OP_SUM"), ("factorial", "FUNC_FACTORIAL"),
)
#: What counts as an operator or a function in foreign tokens.
PLAIN_OPERATORS = ("+", "-", "*", "/", "^", "=", "<", ">", "**", "//")
PLAIN_FUNCTIONS = ("sin", "cos", "tan", "log", "ln", "exp", "sqrt", "lim", "sum", "prod", "diff", "integrate", "factorial")
CHAR_OPERATORS = ("+", "-", "*", "/", "^", "=")
#: Tokens left out of set comparisons (scopes stay in).
OUTSIDE = ("[MATH_START]", "[MATH_END]", "[TEXT_START]", "[TEXT_END]", "[BOS]", "[EOS]", "[PAD]", "[UNK]", "[SEP]", "[MASK]")


def characters(text: Column) -> Column:
    """Character tokens; none for an empty text."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def count_where(tokens: Column, test) -> Column:
    return F.size(F.filter(tokens, test))


def bracket_depth(tokens: Column) -> Column:
    """Deepest nesting of round, square and curly brackets; unmatched closing
    ones do not count."""
    state = F.struct(F.lit(0).alias("now"), F.lit(0).alias("top"))

    def step(s, t):
        now = F.when(t.isin("(", "[", "{"), s["now"] + 1).when(t.isin(")", "]", "}"), F.greatest(F.lit(0), s["now"] - 1)).otherwise(s["now"])
        return F.struct(now.alias("now"), F.greatest(s["top"], now).alias("top"))

    return F.aggregate(tokens, state, step, lambda s: s["top"])


def ratios(stats: DataFrame) -> DataFrame:
    """Adds structural_score, raw_scr and structural_efficiency."""
    score = (F.col("operator_nodes") + F.col("tree_depth") + F.col("parent_child_relations") + F.col("function_scope") + F.col("canonical_bonus")).cast("double")
    share = lambda c: F.when(F.col("token_count") > 0, c / F.col("token_count")).otherwise(0.0)
    return stats.withColumn("structural_score", score).withColumn("raw_scr", share(score)).withColumn("structural_efficiency", share(F.col("parent_child_relations").cast("double")))


def score_characters(exprs: DataFrame, expr: str = "expr") -> DataFrame:
    """Statistics of the character tokenizer, one row an expression."""
    tokens = exprs.withColumn("tokens", characters(F.col(expr)))
    ops = count_where(F.col("tokens"), lambda c: c.isin(*CHAR_OPERATORS))
    out = tokens.withColumns({"token_count": F.size("tokens"), "operator_nodes": ops, "function_scope": F.lit(0), "tree_depth": bracket_depth(F.col("tokens")), "parent_child_relations": ops, "canonical_bonus": F.lit(0)})
    out = out.withColumn("semantic_density", F.col("operator_nodes") / F.greatest("token_count", F.lit(1)))
    return ratios(out).drop("tokens")


def score_pieces(rows: DataFrame, tokens: str = "tokens", drop_spaces: bool = False) -> DataFrame:
    """Statistics of a foreign tokenizer's tokens.  ``drop_spaces`` takes the
    blanks out of tokens and drops empty ones first."""
    low = F.transform(tokens, lambda t: F.lower(F.regexp_replace(t, " ", "") if drop_spaces else t))
    low = F.transform(low, lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", ""))
    low = F.filter(low, lambda t: t != "") if drop_spaces else low
    out = rows.withColumn("__low", low)
    ops = count_where(F.col("__low"), lambda t: t.isin(*PLAIN_OPERATORS))
    out = out.withColumns({"token_count": F.size(tokens), "operator_nodes": ops, "function_scope": count_where(F.col("__low"), lambda t: t.isin(*PLAIN_FUNCTIONS)), "tree_depth": bracket_depth(F.col("__low")), "parent_child_relations": ops, "canonical_bonus": F.lit(0)})
    out = out.withColumn("semantic_density", (F.col("operator_nodes") + F.col("function_scope")) / F.greatest("token_count", F.lit(1)))
    return ratios(out).drop("__low")


def score_structure(tokens: DataFrame, bonus: DataFrame, key: str = "doc_id") -> DataFrame:
    """Statistics of the structural tokens, one row a document.  ``bonus``:
    (key, canonical_bonus), 2 where the first span parsed."""
    starts = lambda p: F.col("token").startswith(p)
    is_op = starts("OP_") | starts("FRAC")
    value = starts("VAR_") | starts("CONST_") | starts("NUM_")
    by = tokens.groupBy(key).agg(
        F.count("*").alias("token_count"), F.count_if(is_op).alias("operator_nodes"), F.count_if(starts("FUNC_")).alias("function_scope"),
        F.coalesce(F.max(F.greatest("depth", F.lit(0))), F.lit(0)).alias("tree_depth"), F.count_if(F.col("num_children") > 0).alias("parent_child_relations"),
        F.count_if(is_op | starts("FUNC_") | value).alias("math_tokens"),
    )
    by = by.join(bonus, key, "left").withColumn("canonical_bonus", F.coalesce("canonical_bonus", F.lit(0)))
    by = by.withColumn("semantic_density", F.col("math_tokens") / F.greatest("token_count", F.lit(1)))
    return ratios(by)


def jaccard(a: Column, b: Column, both_empty: float) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def inner_tokens(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.startswith("["))


def std(value: Column | str) -> Column:
    """Sample standard deviation, 0 for fewer than two values."""
    return F.coalesce(F.stddev_samp(value), F.lit(0.0))


def mean(value: Column | str) -> Column:
    return F.coalesce(F.avg(value), F.lit(0.0))


def scr_chars(rows: DataFrame, *by: str) -> DataFrame:
    """From (expr, token_count): mean, min, max, std and number of ratios."""
    ratio = F.col("token_count") / F.greatest(F.length("expr"), F.lit(1))
    return rows.withColumn("r", ratio).groupBy(*by).agg(mean("r").alias("scr_chars"), F.min("r").alias("min_scr"), F.max("r").alias("max_scr"), std("r").alias("std_scr"), F.count("*").alias("n"))


def canonical_consistency(pairs: DataFrame, *by: str) -> DataFrame:
    """From (tokens_a, tokens_b): mean Jaccard similarity of the token sets."""
    score = jaccard(inner_tokens(F.col("tokens_a")), inner_tokens(F.col("tokens_b")), 1.0)
    return pairs.withColumn("s", score).groupBy(*by).agg(mean("s").alias("ccs"), F.count("*").alias("n"))


def expected_tokens(expr: Column) -> Column:
    low = F.lower(expr)
    return F.array_distinct(F.array_compact(F.array(*[F.when(low.contains(key), F.lit(token)) for key, token in EXPECTED])))


def operator_preservation(rows: DataFrame, *by: str) -> DataFrame:
    """From (expr, tokens): share of rows whose expected tokens all occur; rows
    that expect none do not count."""
    found = rows.withColumn("want", expected_tokens(F.col("expr"))).where(F.size("want") > 0)
    found = found.withColumn("ok", F.size(F.array_except("want", "tokens")) == 0)
    return found.groupBy(*by).agg(F.count_if("ok").alias("preserved"), F.count("*").alias("total"), F.coalesce(F.count_if("ok") / F.nullif(F.count("*"), F.lit(0)), F.lit(1.0)).alias("ops"))


def token_stability(rows: DataFrame, group: str, *by: str) -> DataFrame:
    """From (group, token_count): 1 - mean std / mean over groups of two or
    more members and some tokens, at least 0."""
    own = rows.groupBy(group, *by).agg(F.count("*").alias("m"), F.avg("token_count").alias("mean"), std("token_count").alias("std")).where("m >= 2 and mean > 0")
    return own.groupBy(*by).agg(F.greatest(F.lit(0.0), F.lit(1.0) - F.coalesce(F.avg(F.col("std") / F.col("mean")), F.lit(0.0))).alias("ts"), F.count("*").alias("n"))


def depth_fidelity(rows: DataFrame, *by: str) -> DataFrame:
    """From (depth, truth): 1 - mean capped relative error."""
    error = F.when(F.col("truth") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.abs(F.col("depth") - F.col("truth")) / F.col("truth")))
    return rows.groupBy(*by).agg((F.lit(1.0) - F.coalesce(F.avg(error), F.lit(0.0))).alias("tdf"), F.count("*").alias("n"))


def pair_convergence(pairs: DataFrame) -> DataFrame:
    """Jaccard without boundary tokens, and whether it passes one half."""
    clean = lambda c: F.filter(c, lambda t: ~t.isin(*OUTSIDE))
    return pairs.withColumn("jaccard", jaccard(clean(F.col("tokens_a")), clean(F.col("tokens_b")), 0.0)).withColumn("converged", F.col("jaccard") > 0.5).withColumn("exact", F.col("jaccard") > 0.8)


def summary_means(stats: DataFrame, with_mixed: bool = True) -> DataFrame:
    """Means by tokenizer over rows with tokens; without the category of mixed
    text if asked."""
    rows = stats.where("token_count > 0")
    rows = rows if with_mixed else rows.where(~F.col("category").contains("mixed"))
    return rows.groupBy("tokenizer").agg(mean("raw_scr").alias("mean_scr"), mean("semantic_density").alias("mean_density"), mean("structural_efficiency").alias("mean_efficiency"), F.count("*").alias("n"))


def category_means(stats: DataFrame) -> DataFrame:
    """Mean ratio by category and tokenizer, without mixed and twin suites."""
    rows = stats.where(~F.col("category").contains("mixed") & ~F.col("category").contains("latex_vs_ascii"))
    return rows.groupBy("category", "tokenizer").agg(mean("raw_scr").alias("mean_scr"), F.count("*").alias("n"))


def improvement(wide: DataFrame, own: str, other: str, when_absent: float | None = None) -> DataFrame:
    """own / other; ``when_absent`` where other is null or zero."""
    ratio = F.try_divide(F.col(own), F.nullif(F.col(other), F.lit(0.0)))
    return wide.withColumn(f"{own}_vs_{other}", ratio if when_absent is None else F.coalesce(ratio, F.lit(when_absent)))


def shown_means(stats: DataFrame, column: str) -> DataFrame:
    """(tokenizer, mean): of the tokenizers whose mean is above zero, which
    are the ones that a chart shows."""
    return stats.groupBy("tokenizer").agg(mean(column).alias("mean")).where("mean > 0")
