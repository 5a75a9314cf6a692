"""Documents to spans, and the relational pieces of lexing."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.functions.session import spread
from treeloom.kernel.lex import SEEDS, lex

SPAN = "array<struct<span_type:string,content:string,start:int,end:int,confidence:double>>"
_SPAN = pa.list_(pa.struct([("span_type", pa.string()), ("content", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64())]))


def lex_spans(ascii_math: bool = True, min_math_len: int = 3, strict_compat: bool = False):
    """An Arrow UDF from text to its spans."""

    @F.arrow_udf(returnType=SPAN)
    def run(text: pa.Array) -> pa.Array:
        return pa.array([lex(t.as_py(), ascii_math, min_math_len, strict_compat) for t in text], _SPAN)

    return run


def spans(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """(doc_id, span_idx, span_type, content, start, end, confidence)."""
    found = spread(docs.select(key, text)).select(key, F.posexplode(lex_spans(**options)(F.col(text))).alias("span_idx", "s"))
    return found.select(key, "span_idx", "s.*")


def is_math_only(found: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Whether every span that is not blank is mathematics; true for blanks."""
    blank = F.regexp_replace("content", r"(?U)\s+", "") == ""
    by = found.where(~blank).groupBy(key).agg(F.bool_and(F.col("span_type") == "MATH").alias("math_only"))
    return docs.select(key).join(by, key, "left").select(key, F.coalesce("math_only", F.lit(True)).alias("math_only"))


def seed_counts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Matches of each seed pattern, without leaving the JVM."""
    return docs.select(key, *[F.regexp_count(F.col(text), F.lit("(?U)" + p)).alias(f"n_{name}") for name, p in SEEDS.items()])


def span_confidence(length: Column) -> Column:
    return F.least(F.lit(0.95), F.greatest(F.lit(0.5), F.lit(0.5) + F.lit(0.05) * length))


def merge_ranges(ranges: DataFrame, key: str = "doc_id") -> DataFrame:
    """Merges overlapping and touching [start, end) ranges of each key.  A
    missing bound sorts last, as in SQL, so a range whose end is missing joins
    a known one of the same start.  Both windows read one sort, so equal ranges
    keep their places from one to the other."""
    order = Window.partitionBy(key).orderBy(F.col("start").asc_nulls_last(), F.col("end").asc_nulls_last())
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = ranges.withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(0)))
    island = island.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def merge_adjacent(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Joins neighbouring spans of one type: contents in order, outer bounds,
    highest confidence."""
    order = Window.partitionBy(key).orderBy("span_idx")
    change = F.coalesce((F.col("span_type") != F.lag("span_type").over(order)).cast("int"), F.lit(0))
    run = found.withColumn("change", change).withColumn("run", F.sum("change").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("span_idx", "content")))
    by = run.groupBy(key, "run").agg(F.first("span_type").alias("span_type"), F.array_join(F.transform(parts, lambda x: x["content"]), "").alias("content"), F.min("start").alias("start"), F.max("end").alias("end"), F.max("confidence").alias("confidence"))
    return by.withColumnRenamed("run", "span_idx")
