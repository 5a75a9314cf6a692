"""Mixing sources to target weights by a multivariate-hypergeometric splitting
tree, in DataFrame functions only.

Each source's target is a whole number of words.  Its documents are cut into
blocks of up to ``BLOCK`` words; full passes take every block, and the rest of
the target takes blocks in the order of a random permutation, the last one cut
to fit.  The drawn blocks of a source are its quota.  A binary tree over the
output shards splits the quotas: at each node the left half gets exactly its
share of all blocks, and what of it comes from which source follows the
multivariate hypergeometric distribution.  A shard then owns a run of each
source's permuted blocks, disjoint from all others', and is shuffled locally.

The tree is planned on the driver from one number a source, in exact
hypergeometric draws, and written as a table of at most ``PLAN`` rows; shards
grow in number with the data.  Where sources and shards together would pass
``PLAN``, the smaller sources share pools there, and a pool's blocks are
permuted together, which has the same distribution.  Permutations are dealt by
ranges of the random key, so a source that holds most rows is ordered in many
tasks.
"""

from __future__ import annotations

import itertools
import json
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeloom.llm._store import Scratch

WEIGHTS = (3, 1, 2)
SHARE_NUM, SHARE_DEN = 3, 2  # all targets together, as a share of all words
MOST = 2  # times its size, what a source or document gives at most
BLOCK = 256
CELL = 5_000  # blocks that one task orders
SHARD_BLOCKS = 20_000
LEAST_SHARDS = 8
PLAN = 1 << 22  # numbers in the tree's leaves
LEAST_POOLS = 8
BROADCAST_ROWS = 500_000
MOST_TASKS = 50_000  # of the shuffle into shards; beyond, a task holds several
SEED = 11
WHITE = " \t\n\x0b\f\r"


def size_of(text):
    """Words between ASCII white space; 0 for null."""
    clean = F.btrim(text, F.lit(WHITE))
    return F.when(F.length(clean) > 0, F.size(F.split(clean, r"[\x20\x09-\x0D]+"))).otherwise(0).cast("bigint")


def source_targets(sizes: DataFrame, weights=WEIGHTS) -> DataFrame:
    """(source_key, source_size, target) from (source_key, source, size).

    Weights repeat over the sources by code point, null last.  Targets fill up
    by weight until all words are given out; a source at ``MOST`` times its
    size stops there.  One row a source, which is what the global order is
    taken over."""
    by = sizes.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    by = by.withColumn("at", F.row_number().over(order) - 1)
    by = by.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("at") % len(weights)))
    by = by.withColumn("cap", F.col("source_size") * float(MOST)).withColumn("full_at", F.col("cap") / F.col("weight"))
    # sources reach their caps in the order of cap / weight
    rise = Window.orderBy("full_at", "at")
    total = F.sum("source_size").over(Window.partitionBy()) * (SHARE_NUM / SHARE_DEN)
    capped = F.coalesce(F.sum("cap").over(rise.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(rise.rowsBetween(0, Window.unboundedFollowing))
    by = by.withColumn("level", (total - capped) / open_weight)
    by = by.withColumn("level", F.when(F.col("level") <= F.col("full_at"), F.col("level"))).withColumn("rank", F.when(F.col("level").isNotNull(), F.struct("full_at", "at")))
    level = F.min_by("level", "rank").over(Window.partitionBy())
    return by.select("source_key", "source_size", F.least("cap", F.coalesce(level, F.lit(0.0)) * F.col("weight")).alias("target"))


def _hypergeometric(rng: np.random.Generator, good: int, all_: int, draws: int) -> int:
    """How many of ``draws`` out of ``all_`` are among ``good``: by inversion
    over the probabilities within 12 standard deviations of the mode, beyond
    which less than 1e-30 lies, at every size."""
    low, high = max(0, draws - (all_ - good)), min(good, draws)
    if low == high:
        return low
    mode = (draws + 1) * (good + 1) // (all_ + 2)
    spread = 12 * math.sqrt(draws * (good / all_) * (1 - good / all_) * (all_ - draws) / max(1, all_ - 1)) + 12
    a, b = max(low, int(mode - spread)), min(high, int(mode + spread))
    k = np.arange(a, b, dtype=np.float64)
    # p(k + 1) / p(k)
    steps = np.log((good - k) * (draws - k)) - np.log((k + 1) * (all_ - good - draws + k + 1))
    weights = np.concatenate([[0.0], np.cumsum(steps)])
    sums = np.cumsum(np.exp(weights - weights.max()))
    return a + int(np.searchsorted(sums, rng.random() * sums[-1], "right"))


def split_tree(quotas: list[int], shards: int, seed: int = SEED) -> list[list[int]]:
    """Blocks of each source (inner) in each shard (outer): columns sum to
    the quotas, and shards differ by at most one block."""
    total = sum(quotas)
    ends = [total * (k + 1) // shards for k in range(shards)]
    out: list[list[int]] = [[]] * shards

    def node(low: int, high: int, own: list[int]) -> None:
        if high - low == 1:
            out[low] = own
            return
        mid = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        draws = ends[mid - 1] - (ends[low - 1] if low else 0)
        rest, left = sum(own), []
        for q in own:
            left.append(_hypergeometric(rng, q, rest, draws))
            rest, draws = rest - q, draws - left[-1]
        node(low, mid, left)
        node(mid, high, [q - x for q, x in zip(own, left, strict=True)])

    node(0, shards, quotas)
    return out


def shard_cells(quota: int, ends: list[int]) -> list[tuple[int, int, list[int]]]:
    """(cell, first, ends): a pool's places 0..quota - 1 in cells of one width,
    with the shard of a cell's start and the shard ends inside the cell, so
    that a place's shard is ``first`` plus the number of ends up to it."""
    width, out, k = cell_width(quota, len(ends)), [], 0
    for cell in range(math.ceil(quota / width)):
        while k < len(ends) and ends[k] <= cell * width:
            k += 1
        j = k
        while j < len(ends) and ends[j] < (cell + 1) * width:
            j += 1
        out.append((cell, k, ends[k:j]))
    return out


def cell_width(quota: int, shards: int) -> int:
    return max(1, -(-quota // shards))


def _write_rows(spark, path: str, lines) -> None:
    """JSON lines of the driver's into a file that all can read."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    try:
        for some in iter(lambda: list(itertools.islice(lines, 50_000)), []):
            out.write(bytearray("".join(json.dumps(x) + "\n" for x in some).encode()))
    finally:
        out.close()


class Mix:
    """``docs``: (rid, doc_id, source, size, source_size, target);
    ``blocks``: one row a drawn block and pass (rid, doc_id, source, block,
    pass, first_word, n_words, shard, shard_order)."""

    def __init__(self, docs: DataFrame, blocks: DataFrame, shards: int):
        self.docs, self.blocks, self.shards = docs, blocks, shards

    def drawn(self) -> DataFrame:
        """(rid, drawn): the drawn blocks of each document that gives any, as
        an array in the order of shards and of places in them."""
        return self.blocks.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("shard", "shard_order", "block", "pass", "first_word", "n_words"))).alias("drawn"))

    def taken(self) -> DataFrame:
        """``docs`` with ``taken``, the words that the mix takes of each, and
        ``drawn``, the blocks that hold them and their shards."""
        out = self.docs.join(self.drawn(), "rid", "left").withColumn("drawn", F.coalesce("drawn", F.array()))
        return out.withColumn("taken", F.aggregate("drawn", F.lit(0).cast("bigint"), lambda n, b: n + b["n_words"]))


def mix(docs: DataFrame, weights=WEIGHTS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", rid_col: str | None = None) -> Mix:
    """Plans the mix of all rows of ``docs``, which are numbered here unless
    ``rid_col`` names a column that already does.

    Null and empty texts have size 0 and give nothing; a null source is a
    source; null ids and repeated rows count each for itself.  An empty table
    gives an empty mix.  Reruns agree: keys are hashes of id, source, size and
    block.  Only the named columns are read."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    number = F.monotonically_increasing_id() if rid_col is None else F.col(rid_col)
    rows = docs.select(number.alias("rid"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size_of(F.col(text_col).cast("string")).alias("size"))
    # the numbers are made once and kept in the table
    rows = scratch.put(rows.withColumn("source_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))))
    targets = scratch.put(source_targets(rows, weights))
    words = F.round("target").cast("bigint")
    full = F.when(F.col("source_size") > 0, F.floor(words / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("bigint")
    goals = targets.select("source_key", full.alias("full"), (words - full * F.col("source_size")).alias("rest"))

    count = F.ceil(F.col("size") / BLOCK).cast("int")
    cut = rows.where("size > 0").select("rid", "doc_id", "source_key", "source", "size", F.explode(F.sequence(F.lit(0), count - 1)).alias("block"))
    cut = cut.withColumn("n_words", F.least(F.lit(BLOCK), F.col("size") - F.col("block") * BLOCK).cast("bigint"))
    key = F.shiftrightunsigned(F.xxhash64("doc_id", "source", "size", "block", F.lit(seed)), 11)
    cut = scratch.put(cut.withColumn("key", key))
    # one row a source: joined where the blocks are while there are few
    few = targets.count() <= BROADCAST_ROWS
    small = lambda df: F.broadcast(df) if few else df
    # the permutation of each source: cells of its key range, then places inside a cell
    sizes = cut.groupBy("source_key").agg(F.ceil(F.count("*") / CELL).cast("bigint").alias("cells"))
    cut = cut.join(small(sizes), "source_key").withColumn("cell", F.floor(F.col("key") / F.ceil(F.lit(float(1 << 53)) / F.col("cells"))).cast("bigint"))
    cells = scratch.put(cut.groupBy("source_key", "cell").agg(F.sum("n_words").alias("w"), F.count("*").alias("n")))
    before = Window.partitionBy("source_key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("source_key", "cell", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    inside = Window.partitionBy("source_key", "cell").orderBy("key", "rid", "block")
    placed = cut.withColumn("w", F.sum("n_words").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_words")).withColumn("n", F.row_number().over(inside) - 1)
    cells = scratch.put(cells)
    placed = placed.join(F.broadcast(cells) if cells.count() <= BROADCAST_ROWS else cells, ["source_key", "cell"]).join(small(goals), "source_key")
    placed = placed.withColumn("part", F.greatest(F.lit(0), F.least(F.col("n_words"), F.col("rest") - F.col("w") - F.col("w0"))))
    placed = placed.select("rid", "doc_id", "source_key", "source", "block", "n_words", "full", "part", (F.col("n") + F.col("n0")).alias("place"))
    placed = scratch.put(placed)

    # quotas in blocks, then the tree over the shards
    quotas = placed.groupBy("source_key").agg(F.count("*").alias("n"), F.sum(F.col("full") + (F.col("part") > 0).cast("bigint")).alias("quota"))
    quotas = scratch.put(quotas.where("quota > 0"))
    all_, sources = quotas.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.count("*")).first()
    shards = min(PLAN // LEAST_POOLS, max(LEAST_SHARDS, math.ceil(all_ / SHARD_BLOCKS)))
    pools = PLAN // shards
    many = sources > pools
    if many:  # the largest sources stay on their own
        large = quotas.orderBy(F.desc("quota"), "source_key").limit(pools // 2).select("source_key", F.lit(True).alias("alone"))
        pool = F.concat(F.lit("pool"), F.pmod(F.xxhash64("source_key"), F.lit(pools - pools // 2)))
        quotas = scratch.put(quotas.join(large, "source_key", "left").withColumn("pool", F.when(F.col("alone"), F.col("source_key")).otherwise(pool)))
    else:
        quotas = quotas.withColumn("alone", F.lit(True)).withColumn("pool", F.col("source_key"))
    own = {r["pool"]: int(r["quota"]) for r in quotas.groupBy("pool").agg(F.sum("quota").alias("quota")).collect()}  # at most PLAN / shards rows
    names = sorted(own)
    tree = split_tree([own[n] for n in names], shards, seed)
    ends = {n: list(itertools.accumulate(t[i] for t in tree)) for i, n in enumerate(names)}
    path = f"{scratch.at}/tree.json"
    _write_rows(spark, path, ({"pool": n, "width": cell_width(own[n], shards), "shard_cell": c, "first": k, "ends": e} for n in names for c, k, e in shard_cells(own[n], ends[n])))
    bounds = spark.read.schema("pool string, width bigint, shard_cell bigint, first int, ends array<bigint>").json(path)
    drawn = placed.withColumn("passes", F.col("full") + (F.col("part") > 0).cast("bigint")).where("passes > 0")
    drawn = drawn.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("passes") - 1)).alias("pass"))
    wide = quotas.withColumn("all", F.sum("quota").over(Window.partitionBy("pool"))).withColumn("width", F.expr(f"greatest((all + {shards - 1}) div {shards}, 1L)"))
    drawn = drawn.join(small(wide.select("source_key", "pool", "alone", F.col("n").alias("source_blocks"), "width")), "source_key")
    kept = ["rid", "doc_id", "source", "block", "pass", "n_words", "full", "part", "pool", "width"]
    alone = drawn.where("alone").select(*kept, (F.col("pass") * F.col("source_blocks") + F.col("place")).alias("index"))
    if many:
        alone = alone.unionAll(_permuted(drawn.where("alone is null"), own, scratch, seed).select(*kept, "index"))
    drawn = alone.withColumn("shard_cell", F.floor(F.col("index") / F.col("width")).cast("bigint"))
    drawn = drawn.join(F.broadcast(bounds) if len(names) * shards <= BROADCAST_ROWS else bounds, ["pool", "width", "shard_cell"])
    shard = F.col("first") + F.size(F.filter("ends", lambda e: e <= F.col("index")))
    blocks = drawn.select("rid", "doc_id", "source", "block", F.col("pass").cast("int").alias("pass"), (F.col("block").cast("bigint") * BLOCK).alias("first_word"), F.when(F.col("pass") < F.col("full"), F.col("n_words")).otherwise(F.col("part")).alias("n_words"), shard.alias("shard"), F.xxhash64(F.lit(seed + 1), "doc_id", "block", "pass", "rid").alias("shard_order"))
    out = rows.join(small(targets), "source_key").select("rid", "doc_id", "source", "size", "source_size", "target")
    return Mix(out, blocks, shards)


def _permuted(drawn: DataFrame, own: dict[str, int], scratch: Scratch, seed: int) -> DataFrame:
    """``drawn`` with ``index``, a block's place in one random permutation of
    all blocks of its pool."""
    cells = max(1, math.ceil(max(own.values()) / CELL))
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 2), "doc_id", "block", "pass", "rid"), 11)
    drawn = scratch.put(drawn.withColumn("key", key).withColumn("cell", F.floor(F.col("key") / math.ceil((1 << 53) / cells)).cast("bigint")))
    before = Window.partitionBy("pool").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = drawn.groupBy("pool", "cell").agg(F.count("*").alias("n")).select("pool", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    inside = Window.partitionBy("pool", "cell").orderBy("key", "rid", "block", "pass")
    return drawn.withColumn("at", F.row_number().over(inside) - 1).join(starts, ["pool", "cell"]).withColumn("index", F.col("at") + F.col("n0"))


def into_shards(rows: DataFrame, shards: int, shard: str, order: str) -> DataFrame:
    """Each shard in one task, in its own random order; one task a shard up
    to ``MOST_TASKS`` shards."""
    tasks = min(shards, MOST_TASKS)
    return rows.repartitionById(tasks, F.pmod(F.col(shard), F.lit(tasks)).cast("int")).sortWithinPartitions(shard, order)


def shuffled_texts(docs: DataFrame, mixed: Mix) -> DataFrame:
    """The mixed words themselves: (shard, shard_order, doc_id, text), one
    task a shard, each in its own random order.  Needs unique ids."""
    words = docs.select("doc_id", F.split(F.btrim("text", F.lit(WHITE)), r"[\x20\x09-\x0D]+").alias("w"))
    cut = mixed.blocks.join(words, "doc_id").select("shard", "shard_order", "doc_id", F.array_join(F.slice("w", (F.col("first_word") + 1).cast("int"), F.col("n_words").cast("int")), " ").alias("text"))
    return into_shards(cut, mixed.shards, "shard", "shard_order")


def mixed_texts(docs: DataFrame, weights=WEIGHTS, seed: int = SEED) -> DataFrame:
    """The mix itself, one row a drawn block and pass: ``shard`` and
    ``shard_order``, the columns of ``docs`` with the block's words as
    ``text``, and ``block``, ``pass``, ``n_words``.  A document that the mix
    leaves out has no row, one that it takes twice has its blocks twice.  A
    shard lies in one task, in its own random order.  Ids may be null or repeat:
    every row is held to its own text.  Where ``docs`` has a column of one of
    the mix's names, the mix's is prefixed with ``mix_``."""
    taken_names = {c.lower() for c in docs.columns}
    name = {}
    for c in ("shard", "shard_order", "block", "pass", "n_words"):
        name[c] = c
        while name[c].lower() in taken_names:
            name[c] = "mix_" + name[c]
    rows = Scratch(docs.sparkSession, "mixed").put(docs.withColumn("__rid", F.monotonically_increasing_id()))
    mixed = mix(rows, weights, seed, rid_col="__rid")
    drawn = mixed.drawn().select(F.col("rid").alias("__rid"), F.col("drawn").alias("__drawn"))
    words = F.split(F.btrim(F.col("text").cast("string"), F.lit(WHITE)), r"[\x20\x09-\x0D]+")

    def cut(w):
        piece = lambda b: F.array_join(F.slice(w, (b["first_word"] + 1).cast("int"), b["n_words"].cast("int")), " ")
        return F.transform("__drawn", lambda b: F.struct(b["shard"].alias("shard"), b["shard_order"].alias("shard_order"), b["block"].alias("block"), b["pass"].alias("pass"), b["n_words"].alias("n_words"), piece(b).alias("text")))

    # a text is split once, in an array of one, and its blocks are cut in place
    cuts = rows.join(drawn, "__rid").withColumn("__cut", F.get(F.transform(F.array(words), cut), F.lit(0)))
    cuts = cuts.select(*[F.col(f"`{c}`") for c in docs.columns if c != "text"], F.explode("__cut").alias("__b"))
    own = [F.col("__b.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    made = {c: F.col(f"__b.{c}").alias(n) for c, n in name.items()}
    out = cuts.select(made["shard"], made["shard_order"], *own, made["block"], made["pass"], made["n_words"])
    return into_shards(out, mixed.shards, name["shard"], name["shard_order"])
