"""Benchmark decontamination by size-partitioned MinHash containment search,
in DataFrame functions only.

Documents are partitioned by size: partition p holds those of 2^(p-1) + 1 to
2^p shingles.  Their MinHash signature has one permutation cut into 2^(p + r)
bins, so each partition's bins are loaded alike, however long its documents
are: a bin's minimum hides another shingle with a chance of at most 2^-(r+1).
A test item is signed for every partition that can contain it: bins of larger
partitions are finer, so a shingle that is its bin's minimum in one partition
is so in all later ones, and its row needs only the first.  An item becomes a
candidate of a document if they share a bin's minimum.  r is the least number
for which the shortest item, sharing as few shingles as may do, is missed with
a chance under ``MISS``.

An item of fewer than five words has its whole sequence as its one shingle;
documents are searched for runs of such an item's length as well.
Candidates are verified by exact containment of the shingles' words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.llm._store import Scratch

WORDS = 5
NUM, DEN = 75, 100
WHITE = " \t\n\x0b\f\r"
BROADCAST_ROWS = 2_000_000
MISS = 1e-6


def hold(array: Column) -> Column:
    """The same value, computed once: what is not deterministic is neither
    copied into a lambda, where it would run for each element, nor into a
    filter that is pushed down."""
    return F.when(F.monotonically_increasing_id() >= 0, array)


def words_of(text: Column) -> Column:
    """Lower-cased words between ASCII white space; none for null or empty."""
    clean = F.btrim(F.lower(text), F.lit(WHITE))
    return F.when(F.length(clean) > 0, F.split(clean, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _shingle_hashes(h: Column) -> Column:
    """Hashes of the runs of five; of a shorter sequence the whole."""
    n = F.size(h)
    runs = F.transform(F.sequence(F.lit(0), n - WORDS), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WORDS)]))
    return F.when(n >= WORDS, runs).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))


def _runs(words: Column, k: int) -> Column:
    """The runs of k words, joined by spaces."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))
    return F.when(n >= k, runs).otherwise(F.array().cast("array<string>"))


def shingles_of(words: Column, short: list[int] | None = None) -> Column:
    """Distinct runs of five words, of a shorter sequence the whole; and the
    runs of the lengths ``short``."""
    n = F.size(words)
    own = F.when(n >= WORDS, _runs(words, WORDS)).when(n > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(own, *[_runs(words, k) for k in short or []]))


def _partition(size: Column) -> Column:
    return F.ceil(F.log2(size.cast("double"))).cast("int")


def _minima(sorted_hashes: Column, shift: Column) -> Column:
    """The first hash of each bin; bins are runs of equal high bits."""
    right = lambda x: F.call_function("shiftright", x, shift)
    return F.filter(sorted_hashes, lambda x, i: (i == 0) | (right(x) != right(F.get(sorted_hashes, i - 1))))


def matches(docs: DataFrame, items: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of every document that
    holds at least num/den of an item's distinct shingles.

    An item of one to four words is one shingle and is held by the documents
    that hold its words in a row.  Items and documents without words match
    nothing.  Rows of one id are
    judged each and give one row with the highest count; a null id is kept as
    such, null item ids too.  Only ids and texts are read."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), words_of(F.col("text").cast("string")).alias("words"))
    items = items.select("item_id", hold(F.col("words")).alias("words"))
    items = items.select("item_id", F.size("words").alias("n_words"), hold(_hashed(F.col("words"))).alias("h"), hold(shingles_of(F.col("words"))).alias("shingles"))
    items = items.select("item_id", "n_words", "h", "shingles", F.size("shingles").alias("n_item"), hold(F.sort_array(_shingle_hashes(F.col("h")))).alias("s")).where("n_item > 0")
    items = scratch.put(items.withColumn("item_row", F.xxhash64("item_id", "shingles")).dropDuplicates(["item_row", "item_id"]))
    least = items.where(f"n_words >= {WORDS}").agg(F.min("n_item")).first()[0] or 1
    r = max(0, math.ceil(-math.log2(MISS) / math.ceil(least * num / den)) - 1)
    shift = lambda p: F.greatest(F.lit(64 - r) - p, F.lit(1))

    # the items' signatures: each shingle with the first partition in whose
    # bins it is a minimum, by the highest bit that sets it off from the one before
    need = F.ceil(F.col("n_item") * num / den)
    bit = lambda x, y: F.length(F.bin(x.bitwiseXOR(y))) - 1
    first = lambda x, i: F.when(i == 0, F.lit(0)).otherwise(F.lit(64 - r) - bit(x, F.get("s", i - 1)))
    marked = F.filter(F.transform("s", lambda x, i: F.struct(x.alias("minimum"), F.greatest(first(x, i), _partition(need)).alias("p_from"), ((i > 0) & (bit(x, F.get("s", i - 1)) < 1)).alias("same"))), lambda x: ~x["same"])
    long = items.where(f"n_words >= {WORDS}").select("item_row", F.inline(marked)).select("item_row", "minimum", "p_from")
    signed = scratch.put(long.distinct())
    small = signed.count() <= BROADCAST_ROWS

    hashed = docs.select("doc_id", words_of(F.col("text")).alias("w")).select("doc_id", hold(_hashed(F.col("w"))).alias("h"))
    sets = hashed.select("doc_id", hold(F.sort_array(_shingle_hashes(F.col("h")))).alias("s"))
    rows = sets.select("doc_id", _partition(F.greatest(F.size("s"), F.lit(1))).alias("p"), "s")
    rows = rows.select("doc_id", "p", F.explode(_minima(F.col("s"), shift(F.col("p")))).alias("minimum"))
    candidates = rows.join(F.broadcast(signed) if small else signed, "minimum").where("p >= p_from").select("doc_id", "item_row")
    short = sorted(x["n_words"] for x in items.where(f"n_words < {WORDS}").select("n_words").distinct().collect())  # at most four
    if short:
        own = items.where(f"n_words < {WORDS}").select("item_row", F.col("n_words").alias("k"), F.xxhash64("h").alias("run")).distinct()
        few_short = own.count() <= BROADCAST_ROWS
        runs = lambda k: F.when(F.size("h") >= k, F.transform(F.sequence(F.lit(0), F.size("h") - k), lambda i: F.struct(F.lit(k).alias("k"), F.xxhash64(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.get("h", i + j))).alias("run")))).otherwise(F.array())
        found = hashed.select("doc_id", F.inline(F.concat(*[runs(k) for k in short]))).join(F.broadcast(own) if few_short else own, ["k", "run"])
        candidates = candidates.unionAll(found.select("doc_id", "item_row"))
    candidates = candidates.distinct()
    candidates = scratch.put(candidates)

    few = candidates.count() <= BROADCAST_ROWS
    pairs = candidates.join(items.select("item_row", "item_id", "shingles", "n_item"), "item_row").select(F.col("doc_id").alias("__id"), "item_id", F.col("shingles").alias("item"), "n_item")
    texts = docs.join(F.broadcast(candidates.select(F.col("doc_id").alias("__id")).distinct()) if few else candidates.select(F.col("doc_id").alias("__id")).distinct(), F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    texts = texts.select("doc_id", hold(words_of(F.col("text"))).alias("w")).select("doc_id", hold(shingles_of(F.col("w"), short)).alias("own"))
    both = texts.join(pairs, F.col("doc_id").eqNullSafe(F.col("__id"))).select("doc_id", "item_id", "n_item", F.size(F.array_intersect("own", "item")).alias("n_shared"))
    both = both.where(F.col("n_shared") * den >= F.col("n_item") * num).groupBy("doc_id", "item_id", "n_item").agg(F.max("n_shared").alias("n_shared"))
    return both.select("doc_id", "item_id", F.col("n_shared").cast("bigint").alias("n_shared"), F.col("n_item").cast("bigint").alias("n_item"), (F.col("n_shared") / F.col("n_item")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows whose id has no match; all columns stay."""
    scratch = Scratch(docs.sparkSession, "leaks")
    found = scratch.put(matches(docs, items).select(F.col("doc_id").alias("__id")).distinct())
    few = found.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(found) if few else found, docs["doc_id"].eqNullSafe(found["__id"]), "left_anti")


#: DuckDB SQL for ``matches`` over the tables documents and benchmark.
MATCHES_SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
iw AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
isx AS (
  SELECT item_id, CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END AS s FROM iw WHERE len(w) > 0),
dsx AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END AS s FROM dw WHERE len(w) > 0),
i1 AS (SELECT DISTINCT item_id, unnest(s) AS x FROM isx),
short AS (SELECT DISTINCT len(w) AS k FROM iw WHERE len(w) BETWEEN 1 AND 4),
d1 AS (
  SELECT doc_id, unnest(s) AS x FROM dsx
  UNION SELECT doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS x FROM dw, short WHERE len(w) >= k),
n AS (SELECT item_id, count(*) AS n_item FROM i1 GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d1 JOIN i1 USING (x) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item::DOUBLE AS containment
FROM c JOIN n USING (item_id) WHERE n_shared * 100 >= n_item * 75
"""
