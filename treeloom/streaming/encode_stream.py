"""Line files as streams: the same stateless transforms as in batch, errors
kept in the row, and vocabulary growth by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from treeloom.functions.operators_table import fixed_vocabulary
from treeloom.functions.session import stored
from treeloom.operators.encode import dynamic_vocabulary, encode, full_records
from treeloom.operators.lexing import lex_spans
from treeloom.operators.parsing import expr_record
from treeloom.sources.text import stripped


def read_lines(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    return stripped(spark.readStream.option("maxFilesPerTrigger", per_trigger).text(path))


def records(stream: DataFrame) -> DataFrame:
    """(text, span_idx, span_type, content, record): one row a span; stateless,
    so it runs on a stream as it does on a table.  A failed parse is a record
    with a warning, and the stream goes on."""
    spans = stream.select("text", F.posexplode(lex_spans()(F.col("text"))).alias("span_idx", "s")).select("text", "span_idx", "s.span_type", "s.content")
    return spans.withColumn("record", F.when(F.col("span_type") == "MATH", expr_record()(F.col("content"))))


def encode_stream(spark: SparkSession, stream: DataFrame, out_dir: str, checkpoint: str, include_metadata: bool = True, trigger: dict | None = None, **options) -> StreamingQuery:
    """Writes the records of each micro-batch (and the metadata of its tokens)
    and appends new names to the vocabulary; ids stay stable, in the order of
    batches.  ``options`` are those of ``encode``.  Document ids go on after
    the largest of earlier batches.  A batch that is repeated sees what earlier
    batches wrote and overwrites what it wrote itself, so it gives the same."""

    def write(batch: DataFrame, number: int) -> None:
        docs = stored(batch.withColumn("doc_id", F.monotonically_increasing_id() + _next_id(spark, out_dir, number)), "batch")
        vocabulary = current_vocabulary(spark, out_dir, number)
        run = encode(docs, grow_vocabulary=False, vocabulary=vocabulary, include_metadata=include_metadata, **options)
        grown = stored(dynamic_vocabulary(run.tokens, vocabulary).where("tier = 'dynamic'").join(vocabulary.select("token"), "token", "left_anti"), "grown")
        grown.write.mode("overwrite").parquet(f"{out_dir}/vocabulary/batch={number}")
        run.vocabulary = vocabulary.unionAll(grown.select("token", "id", "tier"))
        rows = full_records(run)
        rows.drop("metadata").write.mode("overwrite").parquet(f"{out_dir}/tokens/batch={number}")
        if include_metadata:
            run.metadata().write.mode("overwrite").parquet(f"{out_dir}/metadata/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _batches(spark: SparkSession, path: str, schema: str, before: int | None) -> DataFrame | None:
    """What batches below ``before`` (all, if None) wrote."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    rows = spark.read.schema(f"{schema}, batch bigint").parquet(path)
    return rows if before is None else rows.where(F.col("batch") < before)


def _next_id(spark: SparkSession, out_dir: str, before: int) -> int:
    rows = _batches(spark, f"{out_dir}/tokens", "doc_id bigint", before)
    last = None if rows is None else rows.agg(F.max("doc_id")).first()[0]
    return 0 if last is None else last + 1


def current_vocabulary(spark: SparkSession, out_dir: str, before: int | None = None) -> DataFrame:
    """The fixed vocabulary and the names of all batches below ``before``."""
    fixed = fixed_vocabulary(spark)
    grown = _batches(spark, f"{out_dir}/vocabulary", "token string, id int, tier string", before)
    return fixed if grown is None else fixed.unionAll(grown.select("token", "id", "tier"))


def token_rate(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Windowed counts on an event stream or table."""
    watched = events.withWatermark("ts", late) if events.isStreaming else events
    return watched.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
