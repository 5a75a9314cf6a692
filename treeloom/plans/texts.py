"""Queries over the text tables: character scores, formats, words, intervals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from treeloom.functions import metrics as M
from treeloom.operators import bpe, encode, lexing, parsing


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def char_token_stats(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    ops = F.length(text) - F.length(F.translate(text, "+-*/^=", ""))
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.length(text).alias("token_count"), ops.cast("int").alias("operator_nodes"))
    return rows.withColumn("density", F.round(F.col("operator_nodes") / F.greatest("token_count", F.lit(1)), 9))


def char_bracket_depth(spark, sf_dir):
    return M.score_characters(_t(spark, sf_dir, "benchmark").withColumn("expr", F.concat("text", F.lit(" (f(["), F.col("item_id"), F.lit("])) )((")))).select("item_id", "token_count", "operator_nodes", "tree_depth", F.round("raw_scr", 9).alias("raw_scr"))


def heuristic_token_scores(spark, sf_dir):
    rows = _t(spark, sf_dir, "part").select("p_partkey", F.split(F.concat_ws(" ", F.lit("sin ( x ) +"), F.col("p_size"), F.lit("* LOG ( ("), F.col("p_partkey"), F.lit(") ) = y")), " ").alias("tokens"))
    return M.score_pieces(rows).select("p_partkey", "token_count", "operator_nodes", "function_scope", "tree_depth", F.round("raw_scr", 9).alias("raw_scr"), F.round("semantic_density", 9).alias("density"))


def format_detect(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), parsing.detect_format(F.col("text")).alias("format"))
    return docs.unionAll(_t(spark, sf_dir, "pages").select(F.lit("page"), "page_id", parsing.detect_format(F.col("html"))))


def strip_delimiters(spark, sf_dir):
    wrap = F.array(F.lit("$$"), F.lit("$"), F.lit("\\["), F.lit("\\("), F.lit(""))
    close = F.array(F.lit("$$"), F.lit("$"), F.lit("\\]"), F.lit("\\)"), F.lit(""))
    kind = (F.col("p_partkey") % 5).cast("int")
    text = F.concat(F.get(wrap, kind), F.lit(" "), F.col("p_name"), F.lit(" "), F.get(close, kind))
    return _t(spark, sf_dir, "part").select("p_partkey", parsing.strip_delimiters(text).alias("inner"))


def seed_counts(spark, sf_dir):
    text = F.concat(F.lit("let sin ("), F.col("p_size"), F.lit(") be x"), F.col("p_partkey") % 9, F.lit("^2, 3 + "), F.col("p_size"), F.lit(" and f(x, y) = Alpha or beta well-known"))
    return lexing.seed_counts(_t(spark, sf_dir, "part").select("p_partkey", text.alias("text")), key="p_partkey")


def text_fallback_ids(spark, sf_dir):
    tokens = encode.text_tokens(F.col("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(tokens).alias("n_ids"))


def word_counts_bpe(spark, sf_dir):
    return bpe.word_counts(_t(spark, sf_dir, "documents"))


def pair_jaccard(spark, sf_dir):
    words = _t(spark, sf_dir, "conversations").select("conv_id", "turn", encode.split_tokens(F.lower("text")).alias("w"))
    order = Window.partitionBy("conv_id").orderBy("turn", F.array_join("w", " "))
    pairs = words.withColumn("before", F.lag("w").over(order)).where("before is not null")
    return pairs.select("conv_id", "turn", F.round(M.jaccard(F.col("before"), F.col("w"), 1.0), 9).alias("jaccard"))


def scr_chars_by_lang(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("lang", F.col("text").alias("expr"), F.size(encode.split_tokens(F.col("text"))).alias("token_count"))
    return M.scr_chars(rows, "lang").select("lang", F.round("scr_chars", 7).alias("scr_chars"), F.round("min_scr", 7).alias("min_scr"), F.round("max_scr", 7).alias("max_scr"), F.round("std_scr", 7).alias("std_scr"), "n")


def merge_ranges(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 50).alias("start"), (F.col("l_partkey") % 50 + F.col("l_suppkey") % 7 + 1).alias("end"))
    return lexing.merge_ranges(rows)


def merge_adjacent_spans(spark, sf_dir):
    order = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    rows = _t(spark, sf_dir, "lineitem").withColumn("i", F.row_number().over(order) - 1)
    kind = F.when(F.col("l_partkey") % 3 == 0, "MATH").otherwise("TEXT")
    rows = rows.select(F.col("l_orderkey").alias("doc_id"), F.col("i").alias("span_idx"), kind.alias("span_type"), F.concat(F.col("l_returnflag"), F.lit(".")).alias("content"), (F.col("i") * 2).alias("start"), (F.col("i") * 2 + 2).alias("end"), (F.col("l_linenumber") / 10.0).alias("confidence"))
    return lexing.merge_adjacent(rows).select("doc_id", F.col("span_idx").cast("bigint").alias("span_idx"), "span_type", "content", "start", "end", "confidence")


def span_confidence(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", F.round(lexing.span_confidence(F.length("p_name") - 10), 9).alias("confidence"))


def lexed_documents(spark, sf_dir):
    """Spans of whole documents, counted; no SQL has the lexer's state machine."""
    found = lexing.spans(_t(spark, sf_dir, "documents"))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_spans"), F.count_if(F.col("span_type") == "MATH").alias("n_math"), F.max("end").alias("length"))


QUERIES = {f.__name__: f for f in (char_token_stats, char_bracket_depth, heuristic_token_scores, format_detect, strip_delimiters, seed_counts, text_fallback_ids, word_counts_bpe, pair_jaccard, scr_chars_by_lang, merge_ranges, merge_adjacent_spans, span_confidence, lexed_documents)}

_LATEX = " OR ".join(f"contains(t, '{m}')" for m in (r"\frac", r"\sqrt", r"\int", r"\sum", r"\prod", r"\sin", r"\cos", r"\tan", r"\log", r"\ln", r"\exp", r"\lim", r"\cdot", r"\times", r"\infty", r"\alpha", r"\beta", r"\gamma", r"\delta", r"\theta", r"\pi", r"\sigma", r"\mu", r"\lambda", r"\phi", r"\psi", r"\leq", r"\geq", r"\neq", r"\in", r"\subset", "{"))
_STRIPPED = r"regexp_replace(regexp_replace(text, '^[\s\x0b]+', ''), '[\s\x0b]+$', '')"

ORACLES = {
    "char_token_stats": """SELECT doc_id, length(text)::INT AS token_count, (length(text) - length(translate(text, '+-*/^=', '')))::INT AS operator_nodes,
 round((length(text) - length(translate(text, '+-*/^=', '')))::DOUBLE / greatest(length(text), 1), 9) AS density FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)""",
    "char_bracket_depth": """
WITH e AS (SELECT item_id, text || ' (f([' || item_id || '])) )((' AS expr FROM benchmark),
c AS (SELECT item_id, unnest(string_split(expr, '')) AS ch, generate_subscripts(string_split(expr, ''), 1) AS i FROM e),
s AS (SELECT *, CASE WHEN ch IN ('(', '[', '{') THEN 1 WHEN ch IN (')', ']', '}') THEN -1 ELSE 0 END AS d FROM c),
p AS (SELECT *, sum(d) OVER (PARTITION BY item_id ORDER BY i) AS pre FROM s),
q AS (SELECT *, pre - least(0, min(pre) OVER (PARTITION BY item_id ORDER BY i)) AS depth FROM p),
a AS (SELECT item_id, count(*)::INT AS token_count, count(*) FILTER (ch IN ('+', '-', '*', '/', '^', '='))::INT AS operator_nodes, max(depth)::INT AS tree_depth FROM q GROUP BY item_id)
SELECT *, round((2 * operator_nodes + tree_depth)::DOUBLE / token_count, 9) AS raw_scr FROM a""",
    "heuristic_token_scores": "SELECT p_partkey, 15::INT AS token_count, 3::INT AS operator_nodes, 2::INT AS function_scope, 2::INT AS tree_depth, round(10.0::DOUBLE / 15, 9) AS raw_scr, round(5.0::DOUBLE / 15, 9) AS density FROM part",
    "format_detect": f"""WITH x AS (SELECT 'doc' AS kind, doc_id AS id, text AS t FROM documents UNION ALL SELECT 'page', page_id, html FROM pages)
SELECT kind, id, CASE WHEN starts_with(t, '$') OR starts_with(t, '\\(') OR starts_with(t, '\\[') OR {_LATEX} THEN 'latex' ELSE 'ascii' END AS format FROM x""",
    "strip_delimiters": "SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN ' ' || p_name || ' ' ELSE p_name END AS inner FROM part".replace("AS inner", 'AS "inner"'),
    "seed_counts": r"""
WITH t AS (SELECT p_partkey, 'let sin (' || p_size || ') be x' || (p_partkey % 9) || '^2, 3 + ' || p_size || ' and f(x, y) = Alpha or beta well-known' AS s FROM part)
SELECT p_partkey, len(regexp_extract_all(s, '(?i)\b(?:sin|cos|tan|exp|log|gamma)\s*\('))::INT AS n_function,
 len(regexp_extract_all(s, '[a-zA-Z_]\w*\s*(?:\^|\*\*)\s*[\w(]'))::INT AS n_exponent, len(regexp_extract_all(s, '(?:^|[^\w])[-+]?\d+(?:\.\d+)?\s*[+\-*/]\s*[-+]?\d'))::INT AS n_arithmetic,
 len(regexp_extract_all(s, '[a-zA-Z_]\w*\s*[+\-*/^=<>]\s*[a-zA-Z0-9_]'))::INT AS n_equation, len(regexp_extract_all(s, '\b[a-zA-Z_]\w*\([a-zA-Z0-9_,\s]*\)\s*='))::INT AS n_definition,
 len(regexp_extract_all(s, '(?i)\b(?:alpha|beta|gamma|pi)\b'))::INT AS n_greek FROM t""",
    "text_fallback_ids": f"SELECT doc_id, length({_STRIPPED})::INT AS n_ids FROM documents",
    "word_counts_bpe": r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+')) AS word FROM documents) GROUP BY word",
    "pair_jaccard": r"""
WITH w AS (SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN [] ELSE regexp_split_to_array(regexp_replace(lower(text), '^\s+|\s+$', '', 'g'), '\s+') END AS w FROM conversations),
p AS (SELECT *, lag(w) OVER (PARTITION BY conv_id ORDER BY turn, array_to_string(w, ' ')) AS b FROM w)
SELECT conv_id, turn, round(CASE WHEN len(list_distinct(list_concat(b, w))) = 0 THEN 1.0 ELSE len(list_intersect(list_distinct(b), list_distinct(w)))::DOUBLE / len(list_distinct(list_concat(b, w))) END, 9) AS jaccard FROM p WHERE b IS NOT NULL""",
    "scr_chars_by_lang": rf"""
WITH r AS (SELECT lang, CASE WHEN {_STRIPPED} = '' THEN 0 ELSE len(regexp_split_to_array({_STRIPPED}, '\s+')) END / greatest(length(text), 1)::DOUBLE AS r FROM documents)
SELECT lang, round(avg(r), 7) AS scr_chars, round(min(r), 7) AS min_scr, round(max(r), 7) AS max_scr, round(coalesce(stddev_samp(r), 0), 7) AS std_scr, count(*) AS n FROM r GROUP BY lang""",
    "merge_ranges": """
WITH r AS (SELECT l_orderkey AS doc_id, l_partkey % 50 AS s, l_partkey % 50 + l_suppkey % 7 + 1 AS e FROM lineitem),
m AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
i AS (SELECT *, sum(CASE WHEN s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT doc_id, min(s) AS start, max(e) AS "end" FROM i GROUP BY doc_id, island""",
    "merge_adjacent_spans": """
WITH r AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) - 1 AS i, CASE WHEN l_partkey % 3 = 0 THEN 'MATH' ELSE 'TEXT' END AS k, l_returnflag || '.' AS c, l_linenumber / 10.0 AS f FROM lineitem),
g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, k ORDER BY i) AS grp FROM r),
a AS (SELECT doc_id, k, min(i) AS lo, max(i) AS hi, string_agg(c, '' ORDER BY i) AS content, max(f)::DOUBLE AS confidence FROM g GROUP BY doc_id, k, grp)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY lo) - 1 AS span_idx, k AS span_type, content, (lo * 2)::INT AS start, (hi * 2 + 2)::INT AS "end", confidence FROM a""",
    "span_confidence": "SELECT p_partkey, round(least(0.95, greatest(0.5, 0.5 + 0.05 * (length(p_name) - 10)))::DOUBLE, 9) AS confidence FROM part",
}
