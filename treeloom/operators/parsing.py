"""Expressions to records and node tables.

Distinct expressions are parsed once: the Python side sees each text one time,
however many rows hold it, and the records are joined back."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.kernel.nodes import analyse, equal_texts, round_trip
from treeloom.kernel.parse import DELIMITERS, LATEX_MARKERS

NODE = "struct<node_id:int,parent_id:int,child_index:int,depth:int,token:string,num_children:int,is_leaf:boolean,subtree_size:int,height:int,confidence:double,path:string,name:string>"
RECORD = f"struct<original:string,canonical:string,input_format:string,transformations:array<string>,warnings:array<string>,success:boolean,raw_height:int,nodes:array<{NODE}>>"
NODE_COLUMNS = ("node_id", "parent_id", "child_index", "depth", "token", "num_children", "is_leaf", "subtree_size", "height", "confidence", "path", "name")
_NODE = pa.struct([("node_id", pa.int32()), ("parent_id", pa.int32()), ("child_index", pa.int32()), ("depth", pa.int32()), ("token", pa.string()), ("num_children", pa.int32()), ("is_leaf", pa.bool_()), ("subtree_size", pa.int32()), ("height", pa.int32()), ("confidence", pa.float64()), ("path", pa.string()), ("name", pa.string())])
_RECORD = pa.struct([("original", pa.string()), ("canonical", pa.string()), ("input_format", pa.string()), ("transformations", pa.list_(pa.string())), ("warnings", pa.list_(pa.string())), ("success", pa.bool_()), ("raw_height", pa.int32()), ("nodes", pa.list_(_NODE))])


def expr_record(do_simplify: bool = True, do_expand: bool = True, do_factor: bool = False, max_depth: int = 20):
    @F.arrow_udf(returnType=RECORD)
    def run(text: pa.Array) -> pa.Array:
        return pa.array([analyse(t.as_py(), do_simplify, do_expand, do_factor, max_depth) for t in text], _RECORD)

    return run


def expr_equiv(a: Column, b: Column) -> Column:
    """Whether two expressions parse and their difference is zero."""

    @F.arrow_udf(returnType="boolean")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([equal_texts(i.as_py(), j.as_py()) for i, j in zip(x, y, strict=True)], pa.bool_())

    return run(a, b)


def validate_nodes(text: Column, rows: Column) -> Column:
    @F.arrow_udf(returnType="struct<is_valid:boolean,reconstructed:string,error:string>")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        kind = pa.struct([("is_valid", pa.bool_()), ("reconstructed", pa.string()), ("error", pa.string())])
        return pa.array([round_trip(i.as_py(), j.as_py()) for i, j in zip(x, y, strict=True)], kind)

    return run(text, rows)


def register_sql(spark) -> None:
    """``lex_spans(text)``, ``expr_record(text)`` and ``expr_equiv(a, b)`` for
    SQL text; the node rows are ``inline(expr_record(text).nodes)``."""
    from treeloom.operators.lexing import lex_spans

    @F.arrow_udf(returnType="boolean")
    def equal(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([equal_texts(i.as_py(), j.as_py()) for i, j in zip(x, y, strict=True)], pa.bool_())

    spark.udf.register("lex_spans", lex_spans())
    spark.udf.register("expr_record", expr_record())
    spark.udf.register("expr_equiv", equal)


def parsed(exprs: DataFrame, expr: str = "expr", check: bool = False, **options) -> DataFrame:
    """``exprs`` with a ``record`` for each; equal texts are parsed once, in as
    many tasks as the session shuffles to.  They are dealt by a hash of the
    text: by the text itself the deal would be merged with that of ``distinct``,
    which puts short texts into one task, as their bytes are few and their
    parsing is not.  ``check`` adds the columns of ``validate``."""
    tasks = int(exprs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = exprs.select(F.col(expr).alias("__expr")).distinct().repartition(tasks, F.xxhash64("__expr"))
    records = distinct.withColumn("record", expr_record(**options)(F.col("__expr")))
    if check:
        records = validate(records, "__expr")
    return exprs.join(records, exprs[expr].eqNullSafe(records["__expr"])).drop("__expr")


def nodes(records: DataFrame, *keys: str) -> DataFrame:
    """The node table: one row a node, keyed by ``keys``."""
    return records.select(*keys, F.explode("record.nodes").alias("n")).select(*keys, *[F.col(f"n.{c}").alias(c) for c in NODE_COLUMNS])


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def detect_format(text: Column) -> Column:
    """'latex' by a marker anywhere or an opening delimiter, else 'ascii'."""
    latex = text.startswith("$") | text.startswith("\\(") | text.startswith("\\[")
    for m in LATEX_MARKERS:
        latex = latex | text.contains(m)
    return F.when(latex, F.lit("latex")).otherwise(F.lit("ascii"))


def strip_delimiters(text: Column) -> Column:
    """Takes off the first delimiter pair that fits, and the space inside."""
    out = None
    for left, right in DELIMITERS:
        size = len(left) + len(right)
        fits = text.startswith(left) & text.endswith(right) & (F.length(text) > size)
        inner = strip(F.substring(text, F.lit(len(left) + 1), F.length(text) - size))
        out = F.when(fits, inner) if out is None else out.when(fits, inner)
    return out.otherwise(text)


def validate(records: DataFrame, expr: str = "expr") -> DataFrame:
    """Adds ``is_valid``, ``reconstructed`` and ``error`` of the round trip."""
    rows = F.transform("record.nodes", lambda n: F.struct(*[n[c].alias(c) for c in ("node_id", "parent_id", "child_index", "token", "name")]))
    checked = records.withColumn("__v", validate_nodes(F.col(expr), rows))
    return checked.select("*", "__v.*").drop("__v")
