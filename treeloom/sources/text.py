"""Sources and sinks: line files, benchmark JSON, result JSONL, vocabularies."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.operators.parsing import strip

DATASET = "expressions array<string>, equivalent_pairs array<array<string>>, rewriting_groups array<array<string>>, mixed_text_math array<string>, latex_only array<string>, ascii_only array<string>, metadata map<string,string>"
STATS = "struct<name:string,token_count:int,operator_nodes:int,tree_depth:int,parent_child_relations:int,function_scope:int,canonical_bonus:int,structural_score:double,raw_scr:double,semantic_density:double,structural_efficiency:double>"
TOKENIZERS = ("structural", "gpt2", "sentencepiece", "char_level")


def result_schema(tokenizers=TOKENIZERS) -> str:
    """Result records: one struct of scores a tokenizer."""
    return f"expression string, category string, sexp string, {', '.join(f'{t} {STATS}' for t in tokenizers)}, scr_improvement_vs_gpt2 double, scr_improvement_vs_sp double, scr_improvement_vs_char double, notes array<string>"


def lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(line_no, text) of the lines that are not blank, stripped, in file order;
    numbers ascend with it, with gaps."""
    raw = spark.read.option("encoding", encoding).option("lineSep", "\n").csv(path, schema="value string", sep="\x00", quote="", escape="", comment="") if encoding.upper() != "UTF-8" else spark.read.text(path)
    return stripped(raw).withColumn("line_no", F.monotonically_increasing_id()).select("line_no", "text")


def stripped(raw: DataFrame) -> DataFrame:
    return raw.select(strip(F.col("value")).alias("text")).where(F.length("text") > 0)


def dataset(spark: SparkSession, path: str) -> DataFrame:
    """The one-row benchmark document."""
    return spark.read.schema(DATASET).json(path, multiLine=True)


def dataset_section(data: DataFrame, name: str, first: int | None = None) -> DataFrame:
    """(idx, expr) or (idx, members) of a section, its first rows if asked."""
    pairs = name in ("equivalent_pairs", "rewriting_groups")
    out = data.select(F.posexplode(name).alias("idx", "members" if pairs else "expr"))
    return out if first is None else out.where(F.col("idx") < first)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def jsonl_results(spark: SparkSession, path: str, tokenizers=TOKENIZERS) -> DataFrame:
    """Result records, with the tokenizers by the names that the file gives
    them; an empty table where there is no such file."""
    schema = result_schema(tokenizers)
    return spark.read.schema(schema).json(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def summary(spark: SparkSession, path: str) -> dict:
    """The summary document; a missing one is an error."""
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    return json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def save_results(records: DataFrame, stats: DataFrame, out_dir: str) -> None:
    """``records``: one row an expression, written as JSON lines.  ``stats``:
    the long table (expression, category, tokenizer, raw_scr, ...), of which
    ``per_record`` has the rounded scores of each expression, and the summary
    the means over rows with tokens (one row, stamped in UTC)."""
    from treeloom.functions.metrics import summary_means

    records.write.mode("overwrite").json(f"{out_dir}/results.jsonl")
    scores = F.array_sort(F.collect_list(F.struct("tokenizer", *[F.round(c, 4).alias(c) for c in ("raw_scr", "semantic_density", "structural_efficiency")])))
    by = stats.groupBy("expression", "category").agg(scores.alias("scores")).withColumn("expression", F.substring("expression", 1, 60))
    by.write.mode("overwrite").json(f"{out_dir}/per_record.jsonl")
    means = summary_means(stats).agg(F.array_sort(F.collect_list(F.struct("*"))).alias("means"))  # one row a tokenizer
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    means.withColumn("timestamp", now).coalesce(1).write.mode("overwrite").json(f"{out_dir}/summary.json")


__all__ = ["dataset", "dataset_section", "jsonl_results", "lines", "result_schema", "save_results", "stripped", "summary"]
