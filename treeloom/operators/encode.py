"""From documents to tokens, ids and records of one row a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeloom.functions.operators_table import BOS_ID, EOS_ID, PAD_ID, UNK, UNK_ID, fixed_vocabulary
from treeloom.functions.session import guard, stored
from treeloom.operators import lexing, parsing, serialize, structure
from treeloom.operators.parsing import strip

STRUCT = "array<struct<span_idx:int,position:int,token:string>>"


def text_tokens(text: Column) -> Column:
    """The default text mode: every character of a stripped text span is
    unknown, as no single character is in the vocabulary."""
    return F.transform(F.filter(F.split(strip(text), ""), lambda c: c != ""), lambda c: F.lit(UNK))


def math_tokens(records: DataFrame, include_boundaries: bool = True, emit_scopes: bool = True) -> DataFrame:
    """Token rows of parsed spans; a span that does not parse is one unknown
    token without boundaries."""
    node = "node_id 0, parent_id -1, child_index 0, depth -1, num_children 0, subtree_size 0".split(", ")
    values = {k: F.lit(int(v)) for k, v in (x.split() for x in node)} | {"token": F.lit(UNK), "is_leaf": F.lit(True)}
    names = ("node_id", "parent_id", "child_index", "depth", "token", "num_children", "is_leaf", "subtree_size")
    known = F.transform("record.nodes", lambda n: F.struct(*[n[c].alias(c) for c in names]))
    unknown = F.array(F.struct(*[values[c].alias(c) for c in names]))
    nodes = records.select("doc_id", "span_idx", F.inline(F.when(F.col("record.success"), known).otherwise(unknown)))
    rows = serialize.serialize(nodes, include_boundaries, emit_scopes, unknown=UNK)
    lost = F.col("token") == UNK
    return rows.withColumns({"node_id": F.when(lost, F.lit(-1)).otherwise(F.col("node_id")), "is_boundary": F.col("is_boundary") | lost})


VOCABULARY_BROADCAST = 1_000_000


def _small(vocabulary: DataFrame) -> DataFrame:
    return F.broadcast(vocabulary) if vocabulary.count() <= VOCABULARY_BROADCAST else vocabulary


def with_ids(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Adds ``id``; 1 for tokens that are not in the vocabulary."""
    return tokens.join(_small(vocabulary.select("token", "id")), "token", "left").withColumn("id", F.coalesce("id", F.lit(UNK_ID)))


def dynamic_vocabulary(tokens: DataFrame, fixed: DataFrame) -> DataFrame:
    """New ``VAR_`` and ``NUM_`` names after the fixed ids, by first occurrence
    (doc_id, span_idx, position).  The order is over distinct names only, dealt
    by ranges of it."""
    new = tokens.where(F.col("token").rlike("^(VAR_|NUM_)")).join(_small(fixed.select("token")), "token", "left_anti")
    first = new.groupBy("token").agg(F.min(F.struct("doc_id", "span_idx", "position")).alias("at"))
    ranges = stored(first.repartitionByRange("at").withColumn("part", F.spark_partition_id()), "names")
    sizes = ranges.groupBy("part").agg(F.count("*").alias("n"))  # one row a task
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    base = fixed.count()
    place = F.row_number().over(Window.partitionBy("part").orderBy("at")) - 1
    ids = ranges.withColumn("place", place).join(F.broadcast(starts), "part").select("token", (F.col("place") + F.col("before") + base).cast("int").alias("id"), F.lit("dynamic").alias("tier"))
    return fixed.select("token", "id", "tier").unionAll(ids)


class Stages:
    """What ``encode`` is made of; any of them can be replaced.

    lex(docs) -> (doc_id, span_idx, span_type, content, start, end, confidence);
    parse(spans with content) -> the same with ``record``; serialize(records)
    -> token rows; text, a tokenizer with ``pieces(column)`` and
    ``vocabulary()``, or None for characters; metadata(tokens, paths,
    vocabulary) -> metadata rows."""

    def __init__(self, lex=None, parse=None, serialize=None, text=None, metadata=None):
        self.lex, self.parse, self.serialize, self.text, self.metadata = lex or lexing.spans, parse or (lambda spans: parsing.parsed(spans, "content")), serialize or math_tokens, text, metadata or structure.metadata


class Encoded:
    """The tables of one encoding run: spans, records, tokens, vocabulary.
    With a text tokenizer its pieces are the text's tokens, and their ids come
    after all of ``vocabulary``."""

    def __init__(self, docs: DataFrame, spans: DataFrame, records: DataFrame, tokens: DataFrame, vocabulary: DataFrame, stages: Stages | None = None, with_metadata: bool = True):
        self.docs, self.spans, self.records, self.tokens, self.vocabulary = docs, spans, records, tokens, vocabulary
        self.stages, self.with_metadata = stages or Stages(), with_metadata

    def text_vocabulary(self) -> DataFrame:
        """(token, id, tier) of the text tokenizer's pieces."""
        spark, base = self.docs.sparkSession, self.vocabulary.count()
        return spark.createDataFrame([(t, base + i, "text") for i, t in enumerate(self.stages.text.vocabulary())], "token string, id int, tier string")

    def token_rows(self) -> DataFrame:
        """All tokens of a document in order, with ids: mathematics as parsed,
        text by the text mode."""
        columns = ["doc_id", "span_idx", "position", "token"]
        own = self.spans.where("span_type = 'TEXT'")
        if self.stages.text is None:
            text = own.select("doc_id", "span_idx", F.posexplode(text_tokens(F.col("content"))).alias("position", "token"))
            return with_ids(self.tokens.select(*columns).unionByName(text), self.vocabulary)
        text = own.select("doc_id", "span_idx", F.posexplode(self.stages.text.pieces(strip(F.col("content")))).alias("position", "token"))
        known = self.text_vocabulary()
        unknown = self.vocabulary.count() + self.stages.text.vocabulary().index(UNK)
        text = text.join(_small(known.select("token", "id")), "token", "left").withColumn("id", F.coalesce("id", F.lit(unknown)))
        return with_ids(self.tokens.select(*columns), self.vocabulary).unionByName(text)

    def documents(self) -> DataFrame:
        """(doc_id, tokens, input_ids) for every document."""
        rows = F.array_sort(F.collect_list(F.struct("span_idx", "position", "token", "id")))
        by = self.token_rows().groupBy("doc_id").agg(rows.alias("r"))
        by = by.select("doc_id", F.transform("r", lambda x: x["token"]).alias("tokens"), F.transform("r", lambda x: x["id"]).alias("input_ids"))
        out = self.docs.select("doc_id").join(by, "doc_id", "left")
        return out.select("doc_id", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"), F.coalesce("input_ids", F.array().cast("array<int>")).alias("input_ids"))

    def metadata(self) -> DataFrame:
        """Metadata of the mathematics; ``doc_position`` counts through a
        document's spans, ``position`` inside one."""
        paths = parsing.nodes(self.records.where("record.success"), "doc_id", "span_idx")
        rows = self.stages.metadata(self.tokens, paths, self.vocabulary)
        return rows.withColumn("doc_position", (F.row_number().over(Window.partitionBy("doc_id").orderBy("span_idx", "position")) - 1).cast("int"))

    def span_sexps(self) -> DataFrame:
        good = serialize.sexp(parsing.nodes(self.records.where("record.success"), "doc_id", "span_idx"))
        return good.unionAll(self.records.where("not record.success").select("doc_id", "span_idx", F.lit(UNK).alias("sexp")))

    def sexps(self) -> DataFrame:
        """(doc_id, sexp): the spans' S-expressions, two spaces between."""
        rows = F.array_sort(F.collect_list(F.struct("span_idx", "sexp")))
        return self.span_sexps().groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda x: x["sexp"]), "  ").alias("sexp"))


def encode(docs: DataFrame, math_only: bool = False, include_boundaries: bool = True, emit_scopes: bool = True, grow_vocabulary: bool = True, lexer: dict | None = None, stages: Stages | None = None, vocabulary: DataFrame | None = None, include_metadata: bool = True, **parser) -> Encoded:
    """``docs``: (doc_id, text).  ``math_only`` takes each text as one
    expression and skips the lexer.  ``stages`` replaces stages; options that
    a replaced stage would have taken are its own then.  Spans are lexed and
    parsed once, into tables of the shared folder that all results read."""
    spark = docs.sparkSession
    guard(spark)
    stages = stages or Stages()
    if math_only:
        n = F.length("text").cast("int")
        found = docs.select("doc_id", F.lit(0).alias("span_idx"), F.lit("MATH").alias("span_type"), F.col("text").alias("content"), F.lit(0).alias("start"), n.alias("end"), F.lit(1.0).alias("confidence"))
    else:
        found = stored(stages.lex(docs, **(lexer or {})), "spans")
    math = found.where("span_type = 'MATH'")
    records = stored(parsing.parsed(math, "content", **parser) if parser else stages.parse(math), "records")
    tokens = stages.serialize(records, include_boundaries, emit_scopes)
    fixed = vocabulary if vocabulary is not None else fixed_vocabulary(spark)
    return Encoded(docs, found, records, tokens, dynamic_vocabulary(tokens, fixed) if grow_vocabulary else fixed, stages, include_metadata)


def add_special(ids: Column) -> Column:
    return F.concat(F.array(F.lit(BOS_ID)), ids, F.array(F.lit(EOS_ID)))


def pad(encoded: DataFrame, ids: str = "input_ids", to: int | None = None) -> DataFrame:
    """Right-pads to ``to`` or to the longest row (for which the input is read
    one more time); ``attention_mask`` is 1 on real ids."""
    longest = to if to is not None else (encoded.agg(F.max(F.size(ids))).first()[0] or 0)
    out = encoded.withColumn(ids, F.concat(F.col(ids), F.array_repeat(F.lit(PAD_ID), F.greatest(F.lit(longest) - F.size(ids), F.lit(0)))))
    return out.withColumn("attention_mask", F.transform(ids, lambda i: (i != PAD_ID).cast("int")))


def decode(rows: DataFrame, vocabulary: DataFrame, ids: str = "input_ids", key: str = "doc_id", skip_special: bool = True) -> DataFrame:
    """(key, text): tokens joined by spaces, without bracketed ones if asked."""
    flat = rows.select(key, F.posexplode_outer(ids).alias("p", "id"))
    named = flat.join(F.broadcast(vocabulary.select("id", "token")), "id", "left").withColumn("token", F.when(F.col("p").isNotNull(), F.coalesce("token", F.lit(UNK))))
    kept = F.when(~F.col("token").startswith("[") if skip_special else F.lit(True), F.struct("p", "token"))
    return named.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["token"]), " ").alias("text"))


def split_tokens(text: Column) -> Column:
    """White-space tokens of a text, none for a blank one."""
    clean = strip(text)
    return F.when(F.length(clean) > 0, F.split(clean, r"(?U)\s+")).otherwise(F.array().cast("array<string>"))


def summary(encoded: Encoded) -> DataFrame:
    """(doc_id, n_tokens, first_ids, sexp_head)."""
    return encoded.documents().join(encoded.sexps(), "doc_id", "left").select("doc_id", F.size("tokens").alias("n_tokens"), F.slice("input_ids", 1, 10).alias("first_ids"), F.substring(F.coalesce("sexp", F.lit("")), 1, 120).alias("sexp_head"))


def full_records(encoded: Encoded) -> DataFrame:
    """(doc_id, tokens, input_ids, metadata, math_sexps, warnings): one row a
    document.  ``metadata`` has a struct for each token of the mathematics and
    is empty if the run was asked for none."""
    whole = lambda rows, *order: F.array_sort(F.collect_list(F.struct(*order, rows)))
    out = encoded.documents()
    if encoded.with_metadata:
        meta = encoded.metadata()
        names = [c for c in meta.columns if c not in ("doc_id", "doc_position")]
        by = meta.groupBy("doc_id").agg(whole(F.struct(*names).alias("m"), "doc_position").alias("r")).select("doc_id", F.transform("r", lambda x: x["m"]).alias("metadata"))
        out = out.join(by, "doc_id", "left")
    sexps = encoded.span_sexps().groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("span_idx", "sexp"))), lambda x: x["sexp"]).alias("math_sexps"))
    notes = encoded.records.where(F.size("record.warnings") > 0).groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("span_idx", F.col("record.warnings").alias("w")))), lambda x: x["w"])).alias("warnings"))
    out = out.join(sexps, "doc_id", "left").join(notes, "doc_id", "left")
    empty = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    meta = [F.coalesce("metadata", F.expr("array()").cast(out.schema["metadata"].dataType)).alias("metadata")] if encoded.with_metadata else [F.array().cast("array<string>").alias("metadata")]
    return out.select("doc_id", "tokens", "input_ids", *meta, empty("math_sexps"), empty("warnings"))


def to_json(encoded: Encoded) -> DataFrame:
    """(doc_id, json): the whole record of each document."""
    rows = full_records(encoded)
    return rows.select("doc_id", F.to_json(F.struct(*[c for c in rows.columns if c != "doc_id"])).alias("json"))


def vocabulary_sizes(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.groupBy("tier").agg(F.count("*").alias("n"))


def get_vocab(vocabulary: DataFrame, text: DataFrame | None = None) -> DataFrame:
    """(token, id): the whole vocabulary; a name of both parts is the first's."""
    own = vocabulary.select("token", "id")
    return own if text is None else own.unionAll(text.select("token", "id").join(own.select("token"), "token", "left_anti"))


def save_vocabulary(vocabulary: DataFrame, path: str, text=None) -> None:
    """The vocabulary, and a text tokenizer's pieces and merges, as JSON lines."""
    spark = vocabulary.sparkSession
    vocabulary.coalesce(1).write.mode("overwrite").json(f"{path}/vocabulary")
    if text is not None:
        spark.createDataFrame(list(enumerate(text.vocabulary())), "id int, piece string").coalesce(1).write.mode("overwrite").json(f"{path}/text_vocabulary")
        spark.createDataFrame([(i, *m) for i, m in enumerate(text.merges)], "rank int, a string, b string").coalesce(1).write.mode("overwrite").json(f"{path}/merges")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("token string, id int, tier string").json(f"{path}/vocabulary")


def load_text_tokenizer(spark: SparkSession, path: str):
    """The text tokenizer that was saved with a vocabulary, None without one."""
    from treeloom.operators.bpe import TextTokenizer

    if not _exists(spark, f"{path}/text_vocabulary"):
        return None
    pieces = [r["piece"] for r in spark.read.schema("id int, piece string").json(f"{path}/text_vocabulary").orderBy("id").collect()]
    merges = [(r["a"], r["b"]) for r in spark.read.schema("rank int, a string, b string").json(f"{path}/merges").orderBy("rank").collect()]
    return TextTokenizer(pieces, merges)


#: Fixed values of a saved tokenizer's configuration.
MODEL_MAX_LENGTH = 2048
SPECIAL_NAMES = {"pad_token": "[PAD]", "unk_token": "[UNK]", "bos_token": "[BOS]", "eos_token": "[EOS]", "mask_token": "[MASK]"}
CONFIG = "tokenizer_class string, model_max_length int, " + ", ".join(f"{k} string" for k in SPECIAL_NAMES)


def save_pretrained(vocabulary: DataFrame, path: str, text=None) -> None:
    """Vocabulary, text tokenizer and configuration in one folder."""
    save_vocabulary(vocabulary, path, text)
    vocabulary.sparkSession.createDataFrame([("TreeTokenizer", MODEL_MAX_LENGTH, *SPECIAL_NAMES.values())], CONFIG).coalesce(1).write.mode("overwrite").json(f"{path}/tokenizer_config")


def from_pretrained(spark: SparkSession, path: str) -> tuple[DataFrame, object, dict]:
    """(vocabulary, text tokenizer or None, configuration): what ``encode``
    takes as ``vocabulary`` and ``Stages(text=...)``."""
    config = spark.read.schema(CONFIG).json(f"{path}/tokenizer_config").first().asDict()
    return load_vocabulary(spark, path), load_text_tokenizer(spark, path), config
