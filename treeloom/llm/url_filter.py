"""URL filters by a cascade of Bloom filters, in DataFrame functions only.

The key universe is every host of the corpus with all its parent domains.
Level 1 encodes the listed keys; level 2 the unlisted keys that level 1 lets
through; level 3 the listed ones that level 2 lets through; and so on until
none is left.  Membership of any key of the universe is then exact, and pages
are judged by bit tests on a constant, without a join.

A cascade that would pass ``max_words`` is cut into shards by a hash of the
key.  All shards are built together, and the distinct hosts' keys are tested in
one pass, each in the task that holds its shard; pages then look up their host
among the blocked ones.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.llm._store import Scratch, ascii_lower

HASHES = 4
BITS_FIRST, BITS_NEXT = 12, 6  # bits a key, on level 1 and on the others
MAX_WORDS = 1_000_000  # 64-bit words of a cascade that are held at once (8 MB)
MAX_LEVELS = 60

#: Fixed values of the rule set: (host, path, verdict).
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)

#: Stand in for a block list from outside, which the tables do not have: domains
#: whose own label has one of these words, and, so that no pattern tells the
#: list, the domains whose md5 starts with ``LISTED_DIGEST``.
LISTED_WORDS = ("spam", "pills", "casino", "malware", "phish")
LISTED_DIGEST = "00"
BROADCAST_HOSTS = 500_000


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty for null or without ``://``."""
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def domains(host: Column) -> Column:
    """The host and all its parent domains; none for an empty host."""
    parts = F.split(host, r"\.")
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.filter(every, lambda d: d != "")


def _places(key: Column, level: int, bits: int) -> list[Column]:
    a = F.pmod(F.xxhash64(key, F.lit(level)), F.lit(bits))
    b = F.pmod(F.xxhash64(F.lit(level), key, F.lit(1)), F.lit(bits))
    return [F.pmod(a + b * j, F.lit(bits)) for j in range(HASHES)]


def _held(words: Column, key: Column, level: int, bits: int) -> Column:
    tests = [F.get(words, F.floor(p / 64).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), (p % 64).cast("int"))) != 0 for p in _places(key, level, bits)]
    return reduce(lambda x, y: x & y, tests)


class Cascade:
    """One shard: the levels' sizes in bits, and a one-row table with the
    levels' words (array of arrays of bigint)."""

    def __init__(self, sizes: list[int], table: DataFrame | None):
        self.sizes, self.table = sizes, table

    def test(self, words: Column, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        out = None
        for i, bits in enumerate(self.sizes):
            miss = ~_held(F.get(words, F.lit(i)), key, i + 1, bits)
            out = F.when(miss, F.lit(i % 2 == 1)) if out is None else out.when(miss, F.lit(i % 2 == 1))
        return F.lit(False) if out is None else out.otherwise(F.lit(len(self.sizes) % 2 == 1))


def _words(keys: DataFrame, level: int, bits: int) -> DataFrame:
    """All words of one filter over ``keys`` (zero ones too): (level, word, bits)."""
    at = keys.select(F.explode(F.array(*_places(F.col("key"), level, bits))).alias("p"))
    made = at.groupBy(F.floor(F.col("p") / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("p") % 64).cast("int"))).alias("bits"))
    every = keys.sparkSession.range(math.ceil(bits / 64)).withColumnRenamed("id", "word")
    return every.join(made, "word", "left").select(F.lit(level).alias("level"), "word", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))


def _gather(words: DataFrame) -> DataFrame:
    """One row, one array of words a level; bounded by ``max_words``."""
    by = words.groupBy("level").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("w"))
    by = by.select("level", F.transform("w", lambda x: x["bits"]).alias("w"))
    return by.agg(F.transform(F.sort_array(F.collect_list(F.struct("level", "w"))), lambda x: x["w"]).alias("words"))


def build(universe: DataFrame, scratch: Scratch) -> Cascade:
    """``universe``: distinct (key, listed).  An empty list gives no level."""
    inside, outside, level, sizes, tables = universe.where("listed").select("key"), universe.where("not listed").select("key"), 0, [], []
    n = inside.count()
    while n:
        level += 1
        if level > MAX_LEVELS:
            raise RuntimeError("the cascade did not end")
        bits = 64 * math.ceil(max(64, n * (BITS_FIRST if level == 1 else BITS_NEXT)) / 64)
        words = scratch.put(_words(inside, level, bits))
        sizes.append(bits)
        tables.append(words)
        held = _held(F.get(_gather(words).scalar(), F.lit(0)), F.col("key"), level, bits)
        through = scratch.put(outside.where(held))
        inside, outside, n = through, inside, through.count()
    if not tables:
        return Cascade([], None)
    return Cascade(sizes, scratch.put(_gather(reduce(DataFrame.unionAll, tables))))


def build_shards(universe: DataFrame, shards: int, scratch: Scratch) -> Cascade:
    """``universe``: distinct (key, listed, shard).  The table has one row a
    shard (shard, words); all shards have the same sizes."""
    side = lambda p: universe.where(p).select("key", "shard")
    inside, outside, level, sizes, tables = side("listed"), side("not listed"), 0, [], []
    most = lambda df: df.groupBy("shard").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    n = most(inside)
    while n:
        level += 1
        if level > MAX_LEVELS:
            raise RuntimeError("the cascade did not end")
        words = math.ceil(max(64, n * (BITS_FIRST if level == 1 else BITS_NEXT)) / 64)
        bits = 64 * words
        at = inside.select("shard", F.explode(F.array(*_places(F.col("key"), level, bits))).alias("p"))
        made = at.groupBy("shard", F.floor(F.col("p") / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("p") % 64).cast("int"))).alias("bits"))
        every = universe.sparkSession.range(shards * words).select(F.expr(f"cast(id div {words} as int)").alias("shard"), (F.col("id") % words).alias("word"))
        whole = every.join(made, ["shard", "word"], "left").groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits")))).alias("w"))
        whole = scratch.put(whole.select("shard", F.transform("w", lambda x: x["bits"]).alias("w")))
        sizes.append(bits)
        tables.append(whole.select("shard", F.lit(level).alias("level"), "w"))
        through = scratch.put(outside.join(whole.hint("shuffle_hash"), "shard").where(_held(F.col("w"), F.col("key"), level, bits)).select("key", "shard"))
        inside, outside, n = through, inside, most(through)
    if not tables:
        return Cascade([], None)
    rows = reduce(DataFrame.unionAll, tables).groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("level", "w"))).alias("w"))
    return Cascade(sizes, scratch.put(rows.select("shard", F.transform("w", lambda x: x["w"]).alias("words"))))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)) if rule is None else rule.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(v)) if verdict is None else verdict.when(fits, F.lit(v))
    null = F.lit(None).cast("string")
    return (null, null) if rule is None else (rule, verdict)


def listed_domains(keys: DataFrame, words=LISTED_WORDS) -> DataFrame:
    return keys.select("key", (F.split("key", r"\.")[0].rlike("|".join(words)) | F.md5("key").startswith(LISTED_DIGEST)).alias("listed"))


def judge(pages: DataFrame, listed: DataFrame | None = None, rules=RULES, id_col: str = "page_id", url_col: str = "url", max_words: int = MAX_WORDS) -> DataFrame:
    """One row per page: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``.

    ``listed`` (column ``key``) is the block list; by default a stand-in made
    from the domains themselves.  A page whose host or a parent domain is listed is blocked
    unless a rule says otherwise.  Null and malformed urls have an empty host,
    no key, and are allowed.  Repeated pages and null ids are judged like any
    row; only the two named columns are read."""
    scratch = Scratch(pages.sparkSession, "url")
    host, path = split_url(F.col(url_col).cast("string"))
    urls = pages.select(F.col(id_col).cast("bigint").alias("page_id"), host.alias("host"), path.alias("path"))
    keys = urls.select("host").distinct().select(F.explode(domains(F.col("host"))).alias("key")).distinct()
    if listed is None:
        universe = listed_domains(keys)
    else:
        mark = listed.select(F.col("key").cast("string").alias("key"), F.lit(True).alias("listed")).distinct()
        universe = keys.join(mark, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed"))
    universe = scratch.put(universe)
    listed_keys = universe.where("listed").agg(F.count("*").alias("n"), F.max(F.size(F.split("key", r"\."))).alias("labels")).first()
    shards = max(1, math.ceil(listed_keys["n"] * (BITS_FIRST + 4) / 64 / max_words))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    labels, blocked = F.size(F.split("host", r"\.")), F.lit(False)
    if shards == 1:
        cascade = build(universe, scratch)
        # the host's last d labels, for every d that a listed key has; a
        # constant cannot be looked up inside a lambda, so they are spelt out
        for d in range(1, (listed_keys["labels"] or 0) + 1) if cascade.sizes else ():
            key = F.substring_index("host", ".", -d)
            blocked = blocked | ((labels >= d) & (key != "") & cascade.test(cascade.table.scalar(), key))
    else:
        shard = F.pmod(F.xxhash64("key", F.lit(99)), F.lit(shards)).cast("int").alias("shard")
        cascade = build_shards(universe.select("key", "listed", shard), shards, scratch)
        held = urls.select("host").distinct().select("host", F.explode(domains(F.col("host"))).alias("key")).select("host", "key", shard)
        found = held.join(cascade.table.hint("shuffle_hash"), "shard").where(cascade.test(F.col("words"), F.col("key"))).select(F.col("host").alias("__host")).distinct()
        found = scratch.put(found.withColumn("__in", F.lit(True)))
        urls = urls.join(F.broadcast(found) if found.count() <= BROADCAST_HOSTS else found, F.col("host") == F.col("__host"), "left")
        blocked = F.coalesce("__in", F.lit(False))
    return urls.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(blocked, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
