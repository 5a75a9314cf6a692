"""Quality classifier by importance resampling.

Two generative models over hashed words and word pairs, one of target text and
one of all raw text, give every document a log-likelihood ratio; the Gumbel
top-k of the ratios is a sample without replacement in proportion to the
importance weights.  The raw model counts every document.  The k-th largest
key is found by counting keys in ever finer ranges, so no rows are sorted in
one place, whatever k is.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm._bytes import SPACE, Words, ngrams, text_slices
from treeloom.llm._store import Scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 15
BUCKETS = 1 << BITS
SHARE = 0.5
SEED = 20
TARGETS = 50_000  # most target rows that are looked up by broadcast


def grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, owner) of every word and every pair of neighbours."""
    h, owner = words.hashes(), words.owner()
    pairs = ngrams(h, 2)
    inside = owner[1:] == owner[:-1] if len(pairs) else np.zeros(0, bool)
    shift = np.uint64(64 - BITS)
    return np.concatenate([h >> shift, pairs[inside] >> shift]).astype(np.int64), np.concatenate([owner, owner[:-1][inside] if len(pairs) else owner[:0]])


def _count(batches):
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, buf, offsets in text_slices(batch.column(0)):
            total += np.bincount(grams(Words(buf, offsets, SPACE, True))[0], minlength=BUCKETS)
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["bucket", "n"])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Counts of all n-grams; each task sends at most one row a bucket, which
    are summed by bucket."""
    total = np.zeros(BUCKETS, np.int64)
    for r in texts.mapInArrow(_count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS rows
        total[r["bucket"]] = r["n"]
    return total


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def _score(ratio: np.ndarray):
    def run(batches):
        for batch in batches:
            out, sizes = [], []
            for _, buf, offsets in text_slices(batch.column(1)):
                words = Words(buf, offsets, SPACE, True)
                bucket, owner = grams(words)
                out.append(np.bincount(owner, ratio[bucket], minlength=words.docs))
                sizes.append(np.bincount(owner, minlength=words.docs))
            empty = np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else empty), pa.array(np.concatenate(sizes).astype(np.int64) if out else empty.astype(np.int64))], ["doc_id", "log_ratio", "n_grams"])

    return run


def kth_largest(keys: DataFrame, k: int) -> float | None:
    """The exact k-th largest value of ``key`` (null and NaN do not count),
    by counts over 4096 ranges a round; None if there are fewer than k."""
    keys = keys.where("key is not null and not isnan(key)")
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("*")).first()
    if k < 1 or n < k:
        return None
    while low < high:
        width = (high - low) / 4096
        if width == 0 or low + width == low:
            break
        inside = keys.where((F.col("key") >= low) & (F.col("key") <= high))
        by = inside.groupBy(F.least(F.floor((F.col("key") - low) / width), F.lit(4095)).alias("cell")).agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b"))
        for r in sorted(by.collect(), key=lambda r: -r["cell"]):  # at most 4096 rows
            if k <= r["n"]:
                low, high = r["a"], r["b"]
                break
            k -= r["n"]
    return high


def resample(docs: DataFrame, target: DataFrame, share: float = SHARE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``n_grams``, ``log_ratio`` (of the
    whole text: the logarithm of its importance weight), ``mean_log_ratio`` (a
    gram; nothing is decided by it), ``gumbel_key`` and ``kept``.

    ``ceil(share * rows)`` rows have the largest keys; rows of equal keys at
    the border are all kept, so repeated rows go together.  Texts without
    words (null, empty) have no ratio and are never kept.  An empty target
    makes a flat model.  Reruns agree: the noise is a hash of id and seed."""
    scratch = Scratch(docs.sparkSession, "importance")
    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ratio = log_ratio(bucket_counts(target.select(F.col(text_col).cast("string").alias("text"))), bucket_counts(picked.select("text")))
    scored = picked.mapInArrow(_score(ratio), "doc_id bigint, log_ratio double, n_grams bigint")
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    keyed = scored.select("doc_id", "n_grams", F.when(F.col("n_grams") > 0, F.col("log_ratio")).alias("log_ratio"), F.when(F.col("n_grams") > 0, F.col("log_ratio") / F.col("n_grams")).alias("mean_log_ratio"))
    keyed = scratch.put(keyed.withColumn("gumbel_key", F.col("log_ratio") - F.log(-F.log(uniform))))
    rows = keyed.count()
    cut = kth_largest(keyed.select(F.col("gumbel_key").alias("key")), min(math.ceil(share * rows), keyed.where("log_ratio is not null").count()))
    return keyed.withColumn("kept", F.coalesce(F.col("gumbel_key") >= F.lit(cut), F.lit(False)) if cut is not None else F.lit(False))


def target_rows(docs: DataFrame, labels: DataFrame, most: int = TARGETS) -> DataFrame:
    """Documents labelled as good (a bounded sample, in the order of a hash)."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    good = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.join(F.broadcast(good), docs["doc_id"] == good["doc_id"], "left_semi")
