"""Operators against brute force on small tables with nulls, empty and long
texts, ties, repeated rows and clashing column names."""

import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from treeloom.llm import decontaminate, importance, jaccard_join, mixing, quality_rules, toxicity, url_filter
from treeloom.llm._components import components
from treeloom.llm._store import Scratch

RNG = random.Random(11)
VOCAB = [f"w{i}" for i in range(400)]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


def edited(t, k):
    words = t.split()
    for _ in range(k):
        words[RNG.randrange(len(words))] = RNG.choice(VOCAB)
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    out = [None, "", " \n", "one", "one", "One two", "a b c d", "A b C d", "a b c d e", "a  b\tc\x0bd e"]
    passage = text(60)
    for n in (12, 30, 80, 150, 400, 900):
        base = text(n)
        out += [base, base.upper(), base + " tail"] + [edited(base, max(1, n // d)) for d in (200, 120, 80, 60, 40, 30, 25)]
    hub = text(200)
    out += [hub] + [edited(hub, 3) for _ in range(25)]
    out += [text(RNG.randint(20, 120)) + " " + passage for _ in range(25)] + [text(6000)]
    RNG.shuffle(out)
    return [(i, t, f"s{i % 3}" if i % 7 else None, "x", "y") for i, t in enumerate(out)] + [(3, out[3], "s0", "x", "y"), (None, text(40), None, "x", "y")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, fp string, n string")


def shingles(t, lower=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER) if lower else (t or "").lower())
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute_components(sets, num=75, den=100):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_jaccard_components(spark, docs, rows):
    sets = {i: shingles(t) for i, t, *_ in rows if i is not None}
    want = brute_components(sets)
    got = jaccard_join.jaccard_components(docs).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == {i: (len(s), want[i]) for i, s in sets.items()}
    kept = [r["doc_id"] for r in jaccard_join.drop_near_copies(docs).collect()]
    assert {i for i in kept if i is not None} == set(want.values())
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0


def test_leftover_groups_seen_in_several_flushes(spark, monkeypatch):
    """Five groups {hub, b, c}, each seen twice: b and c link, the hub links to neither."""
    rng = random.Random(21)
    texts, sigs, links = [], {}, []
    for g in range(5):
        hub, other, b = (" ".join(rng.choice(VOCAB) for _ in range(60)) for _ in range(3))
        c = b + " tail"
        links.append((len(texts) + 2, len(texts) + 3))
        for t, own in ((hub, [g, 100 + g]), (other, [100 + g]), (b, [g]), (c, [g])):
            (_, made), = jaccard_join._sets(pa.array([t]))
            sigs[int(jaccard_join.fingerprints(made)[0])] = [int(x) for x in jaccard_join.mix(np.array(own, np.uint64))]
            texts.append(t)
    name = jaccard_join.fingerprints

    class Forced(jaccard_join.Scheme):
        def signatures(self, sets):
            own = [sigs[x] for x in name(sets).tolist()]
            return np.concatenate([np.array(x, np.uint64) for x in own]), np.array([len(x) for x in own])

    group = jaccard_join._group
    monkeypatch.setattr(jaccard_join, "Scheme", Forced)
    monkeypatch.setattr(jaccard_join, "_group", lambda limit: group(1))  # a flush a batch
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "1")
    try:
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
        twice = docs.unionAll(docs.select(F.col("doc_id") + 1000, "text"))
        got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(twice).collect()}
    finally:
        spark.conf.set(batch, before)
    want = {i: i for i in range(len(texts))} | {c: b for b, c in links}
    assert got == want | {i + 1000: k for i, k in want.items()}


def test_large_groups_are_refined(spark, monkeypatch):
    """A passage that all texts share: larger subsets find the same links as
    brute force, and the signatures stay linear in the number of texts."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "REFINE", 16)
    made, extended = [], jaccard_join.Scheme.extended
    rng = random.Random(5)
    passage = " ".join(rng.choice(VOCAB) + str(i) for i in range(25))
    texts = []
    for _ in range(60):
        own = [rng.choice(VOCAB) + str(rng.randrange(10**6)) for _ in range(20)]
        texts.append(" ".join([passage, *own]))
        if rng.random() < 0.3:
            own[rng.randrange(20)] = "changed"
            texts.append(" ".join([passage, *own]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = brute_components({i: shingles(t) for i, t in enumerate(texts)})
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs).collect()} == want
    scheme = jaccard_join.Scheme(75, 100)
    for (_, sets), in [list(jaccard_join._sets(pa.array([t]))) for t in texts[:3]]:
        sig = jaccard_join.mix(scheme.tokens(sets[0], *_spread(sets[0]), *scheme.plan(len(sets[0]))[0]))
        k = scheme.plan(len(sets[0]))[0][0]
        pairs = extended(scheme, sets[0], [(int(sig[0] & np.uint64(0xFFFFFFFF)), [])], 2)
        assert len(pairs) == min(k, len(jaccard_join.mix(scheme.tokens(sets[0], *_spread(sets[0]), k + 1, *scheme.plan(len(sets[0]))[0][1:]))) - 1)
        made.append(len(pairs))
    assert made


def _spread(own):
    return jaccard_join.mix(own ^ np.uint64(0x5851F42D4C957F2D)), own >> np.uint64(32)


def test_linking_pairs_share_subsets_of_every_size():
    scheme = jaccard_join.Scheme(75, 100)
    rng = np.random.default_rng(8)
    for n in (12, 40, 90, 400):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[n // 10 :], rng.integers(0, 1 << 63, n // 20).astype(np.uint64)]))
        shared = [np.intersect1d(x, y) for x, y in [(scheme.signatures([a])[0], scheme.signatures([b])[0])]][0]
        held = [(int(x & np.uint64(0xFFFFFFFF)), []) for x in shared[:1]]
        for level in (2, 3, 4):
            x, y = scheme.extended(a, held if level == 2 else hx, level), scheme.extended(b, held if level == 2 else hy, level)
            both = {g for g, _ in x} & {g for g, _ in y}
            assert both, (n, level)
            hx, hy = ([next(e for e in side if e[0] == min(both))] for side in (x, y))


def test_null_and_repeated_ids(spark):
    base = [f"w{i}" for i in range(40)]
    near, far = [*base[:-1], "other"], [f"v{i}" for i in range(30)]
    rows = [(None, base), (1, near), (2, far), (2, far), (2, base[:20]), (None, [f"u{i}" for i in range(9)]), (None, [f"u{i}" for i in range(9)]), (None, None), (None, None), (4, None)]
    docs = spark.createDataFrame([(i, " ".join(t) if t else t, "x") for i, t in rows], "doc_id bigint, text string, fp string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect()), key=str)
    assert got == sorted([(None, 36, 1), (1, 36, 1), (2, 26, 2), (2, 26, 2), (2, 16, 2), (None, 5, None), (None, 5, None), (None, 0, None), (None, 0, None), (4, 0, 4)], key=str)
    kept = jaccard_join.drop_near_copies(docs)
    assert kept.columns == docs.columns
    left = sorted(((r["doc_id"], len((r["text"] or "").split())) for r in kept.collect()), key=str)
    assert left == sorted([(1, 40), (2, 30), (2, 20), (None, 9), (None, 0), (None, 0), (4, 0)], key=str)


def test_every_linking_pair_shares_a_signature():
    scheme = jaccard_join.Scheme(75, 100)
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 5, 9, 20, 63, 64, 65, 90, 200, 401, 700, 3000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            k = len(a) // 7
            for drop, more in ((k, 0), (0, len(a) // 3), (k // 2, k // 2), (len(a) // 4, 0)):
                b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, more).astype(np.uint64)]))
                inter = len(np.intersect1d(a, b))
                if len(b) and 100 * inter >= 75 * (len(a) + len(b) - inter):
                    x, y = scheme.signatures([a])[0], scheme.signatures([b])[0]
                    assert len(np.intersect1d(x, y))


def test_bitmaps_never_hide_a_link():
    rng = np.random.default_rng(4)
    for n in (5, 100, 257, 1500):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[n // 8 :], rng.integers(0, 1 << 63, n // 2).astype(np.uint64)]))
        x, y = (np.frombuffer(m, np.uint64) for m in jaccard_join._bitmaps([a, b]))
        words = min(len(x), len(y))
        far = int(np.bitwise_count(jaccard_join.fold(x, words) ^ jaccard_join.fold(y, words)).sum())
        assert far <= len(np.setxor1d(a, b))


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (7, 7)]
    got = dict(components(spark.createDataFrame(edges, "u bigint, v bigint").repartition(7), Scratch(spark, "t")).collect())
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in (100, 101, 102))


def test_decontamination(spark, docs, rows):
    items = [(1, edited(" ".join((rows[20][1] or text(30)).split()[:30]), 1)), (2, text(25)), (3, None), (4, "one"), (5, ""), (6, "Word"), (7, " ".join((rows[20][1] or text(30)).split()[3:6])), (8, " ".join((rows[20][1] or text(30)).split()[7:11]))]
    items += [(10 + k, " ".join(t.split()[10:45])) for k, (_, t, *_) in enumerate(r for r in rows if r[1] and len(r[1].split()) > 100) if k % 9 == 0]
    table = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id bigint, text string, doc_id string")
    want = defaultdict(int)
    for i, t in items:
        s = shingles(t, False)
        k = len(next(iter(s), ()))
        for d, u, *_ in rows:
            w = re.findall(r"[^\x20\x09-\x0D]+", (u or "").lower())
            n = len(s & {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}) if k else 0
            if s and 100 * n >= 75 * len(s):
                want[d, i] = max(n, want[d, i])
    got = {(r["doc_id"], r["item_id"]): r["n_shared"] for r in decontaminate.matches(docs, table).collect()}
    assert got == dict(want)
    left = {r["doc_id"] for r in decontaminate.drop_contaminated(docs, table).collect()}
    assert left == {i for i, *_ in rows} - {d for d, _ in want}
    assert decontaminate.matches(docs, table.limit(0)).count() == 0


def test_mix(spark, docs, rows):
    got = mixing.mix(docs).taken().collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s, *_ in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight, total = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, 1.5 * sum(sizes.values())
    capped = set()
    while True:
        level = (total - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 2 * r["size"]
        assert abs(r["target"] - (2 * sizes[r["source"]] if r["source"] in capped else level * weight[r["source"]])) < 1e-6 * total
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[r["source"]] - r["target"]) <= 1 for r in got)
    again = mixing.mix(docs.repartition(3)).taken()
    assert sorted(map(str, ((r["doc_id"], r["taken"]) for r in again.collect()))) == sorted(map(str, ((r["doc_id"], r["taken"]) for r in got)))
    assert mixing.mix(docs.limit(0)).taken().count() == 0


def test_mix_shards(spark, docs):
    plan = mixing.mix(docs.where("doc_id is not null").dropDuplicates(["doc_id"]))
    blocks = plan.blocks.groupBy("shard").agg(F.count("*").alias("n")).collect()
    assert max(r["n"] for r in blocks) - min(r["n"] for r in blocks) <= 1
    assert plan.blocks.count() == plan.blocks.select("rid", "block", "pass").distinct().count()
    words = mixing.shuffled_texts(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), plan)
    assert words.agg(F.sum(F.size(F.split("text", " ")))).first()[0] == plan.blocks.agg(F.sum("n_words")).first()[0]


def test_mix_shards_follow_the_tree(spark, docs, monkeypatch):
    """Another seed gives other shards and the same quotas; pools of small
    sources keep every block and the even shards."""
    own = docs.where("doc_id is not null").dropDuplicates(["doc_id"])

    def of(seed):
        plan = mixing.mix(own, seed=seed)
        rows = plan.blocks.collect()
        per = defaultdict(int)
        for r in rows:
            per[r["source"]] += r["n_words"]
        counts = defaultdict(int)
        for r in rows:
            counts[r["source"], r["shard"]] += 1
        return {(r["rid"], r["block"], r["pass"]): r["shard"] for r in rows}, dict(per), counts, plan.shards

    a, quotas_a, counts_a, shards = of(1)
    b, quotas_b, counts_b, _ = of(2)
    assert quotas_a == quotas_b and counts_a != counts_b
    assert any(a[k] != b[k] for k in a.keys() & b.keys())
    sizes = defaultdict(int)
    for (s, _), n in counts_a.items():
        sizes[s] += n
    plan = mixing.split_tree([sizes[s] for s in sorted(sizes, key=lambda s: "-" if s is None else "=" + s)], shards, 1)
    for i, s in enumerate(sorted(sizes, key=lambda s: "-" if s is None else "=" + s)):
        assert [counts_a.get((s, k), 0) for k in range(shards)] == [t[i] for t in plan]
    monkeypatch.setattr(mixing, "PLAN", 16)
    monkeypatch.setattr(mixing, "LEAST_POOLS", 2)
    many = own.withColumn("source", F.concat(F.lit("s"), (F.col("doc_id") % 9).cast("string")))
    pooled = mixing.mix(many)
    shard_sizes = [r["n"] for r in pooled.blocks.groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert pooled.shards == 8 and max(shard_sizes) - min(shard_sizes) <= 1
    assert pooled.blocks.count() == pooled.blocks.select("rid", "block", "pass").distinct().count()


def test_hypergeometric_is_exact():
    class Grid:
        def __init__(self, u):
            self.u = u

        def random(self):
            return self.u

    for good, all_, draws in ((3, 10, 4), (20, 50, 25), (1, 9, 8), (400, 1000, 30)):
        n, counts = 20_000, defaultdict(int)
        for i in range(n):
            counts[mixing._hypergeometric(Grid((i + 0.5) / n), good, all_, draws)] += 1
        for k in range(max(0, draws - all_ + good), min(good, draws) + 1):
            want = math.comb(good, k) * math.comb(all_ - good, draws - k) / math.comb(all_, draws)
            assert abs(counts[k] / n - want) <= 1.5 / n
    rng = np.random.default_rng(1)
    for good, all_, draws in ((10**6, 3 * 10**6, 10**6), (10**9, 10**10, 5 * 10**9)):
        got = [mixing._hypergeometric(rng, good, all_, draws) for _ in range(40)]
        sd = math.sqrt(draws * good / all_ * (1 - good / all_) * (all_ - draws) / (all_ - 1))
        assert abs(np.mean(got) - draws * good / all_) < 4 * sd / math.sqrt(40) and 0.6 * sd < np.std(got) < 1.5 * sd


def test_shard_cells():
    rng = random.Random(3)
    for _ in range(50):
        shards, quota = rng.randint(1, 9), rng.randint(1, 60)
        ends = sorted(rng.randint(0, quota) for _ in range(shards - 1)) + [quota]
        cells, width = {c: (k, e) for c, k, e in mixing.shard_cells(quota, ends)}, mixing.cell_width(quota, shards)
        for i in range(quota):
            k, e = cells[i // width]
            assert k + sum(x <= i for x in e) == sum(x <= i for x in ends)


def test_mixed_texts(spark, docs, rows):
    """The drawn blocks hold every row's own words, null and repeated ids included."""
    odd = docs.select("doc_id", "text", "source", F.lit("en").alias("lang"))
    odd = odd.unionAll(spark.createDataFrame([(3, "other words under a used id " * 70, "s0", "de"), (None, "no id here " * 90, None, "fr")], odd.schema))
    got = mixing.mixed_texts(odd).collect()
    per = mixing.mix(odd).taken().collect()
    assert sum(r["n_words"] for r in got) == sum(r["taken"] for r in per)
    assert all(len(r["text"].split()) == r["n_words"] for r in got)
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    blocks, have = defaultdict(int), defaultdict(int)
    for r in odd.collect():
        w = words(r["text"])
        for k in range(0, len(w), mixing.BLOCK):
            have[r["doc_id"], r["source"], r["lang"], k // mixing.BLOCK, " ".join(w[k : k + mixing.BLOCK])] += 1
    for r in got:
        key = next(k for k in have if k[:4] == (r["doc_id"], r["source"], r["lang"], r["block"]) and (k[4] + " ").startswith(r["text"] + " "))
        blocks[key, r["pass"]] += 1
    assert all(n <= have[key] for (key, _), n in blocks.items())
    shards = defaultdict(int)
    for r in got:
        shards[r["shard"]] += 1
    assert max(shards.values()) - min(shards.values()) <= 1
    drawn = [b for r in per for b in r["drawn"]]
    assert sorted((b["shard"], b["n_words"]) for b in drawn) == sorted((r["shard"], r["n_words"]) for r in got)
    at = [(r["shard"], r["shard_order"]) for p in mixing.mixed_texts(odd).rdd.glom().collect() for r in p]
    assert all(x <= y for x, y in zip(at, at[1:]) if x[0] == y[0])
    assert mixing.mixed_texts(odd.limit(0)).count() == 0
    clash = mixing.mixed_texts(odd.withColumn("shard", F.lit(1)).withColumn("target", F.lit(2)).withColumn("Block", F.lit(3)))
    assert clash.columns == ["mix_shard", "shard_order", *odd.columns, "shard", "target", "Block", "mix_block", "pass", "n_words"]
    assert clash.count() == len(got)


def test_splitting_tree():
    for quotas in ([10, 0, 7], [5000, 3, 90000], [1], []):
        tree = mixing.split_tree(quotas, 8)
        assert [sum(t[i] for t in tree) for i in range(len(quotas))] == quotas
        assert max(map(sum, tree)) - min(map(sum, tree)) <= 1 and min([x for t in tree for x in t], default=0) >= 0
    means = np.mean([mixing.split_tree([300, 100], 4, seed)[0] for seed in range(200)], 0)
    assert abs(means[0] - 75) < 2 and abs(means[1] - 25) < 2


URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Spam-Farm.Example.COM/en/7?x", "http://example.com/en/71", "http://a.example.com/en/8", "http://x.net/de/1", "http://b.example.net/de/8#t", "http://q.org/es/", "http://org/es", "a://b://c/d", "http://good.example.org/x?y", "http://sub.cheap-pills.example.net/fr"]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(None, URLS[5], "h")], "page_id bigint, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages).collect()}
    for i, u in enumerate(URLS):
        at = (u or "").find("://")
        rest = u[at + 3 :] if at >= 0 and u else ""
        host = re.match(r"[^/?#]*", rest)[0].translate(LOWER)
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        every = [".".join(host.split(".")[k:]) for k in range(len(host.split(".")))] if host else []
        listed = any(w in d.split(".")[0] for d in every for w in url_filter.LISTED_WORDS) or any(hashlib.md5(d.encode()).hexdigest().startswith(url_filter.LISTED_DIGEST) for d in every)
        rule, verdict = (max(fits)[1], max(fits)[2]) if fits else (None, "block" if listed else "allow")
        assert got[i] == (host, path, rule, verdict), u


def test_cascade_is_exact(spark):
    keys = spark.createDataFrame([(f"k{i}.example", i % 3 == 0) for i in range(1500)], "key string, listed boolean")
    made = url_filter.build(keys, Scratch(spark, "t"))
    assert len(made.sizes) >= 2
    found = keys.withColumn("in", made.test(made.table.scalar(), F.col("key")))
    assert found.where(F.col("in") != F.col("listed")).count() == 0
    hosts = [(i, f"http://k{i}.example/") for i in range(300)]
    listed = keys.where("listed").select("key")
    whole = url_filter.judge(spark.createDataFrame(hosts, "page_id bigint, url string"), listed)
    cut = url_filter.judge(spark.createDataFrame(hosts, "page_id bigint, url string"), listed, max_words=10)
    assert url_filter.judge(spark.createDataFrame([], "page_id bigint, url string"), listed).count() == 0
    assert {r["page_id"] for r in cut.where("verdict = 'block'").collect()} == {r["page_id"] for r in whole.where("verdict = 'block'").collect()} == {i for i in range(300) if i % 3 == 0}


def test_importance(spark, docs, rows):
    target = spark.createDataFrame([("w1 w2 w3 " * 20,)], "text string")
    out = importance.resample(docs, target, share=0.3)
    got = out.collect()
    keys = sorted((r["gumbel_key"] for r in got if r["gumbel_key"] is not None), reverse=True)
    k = -(-len(rows) * 3 // 10)
    assert {r["doc_id"] for r in got if r["kept"]} == {r["doc_id"] for r in got if r["gumbel_key"] is not None and r["gumbel_key"] >= keys[k - 1]}
    assert not any(r["kept"] for r in got if not (next((t for i, t, *_ in rows if i == r["doc_id"]), "") or "").strip())
    values = [RNG.choice([0.5, 1.0, RNG.random(), -3e9]) for _ in range(200)]
    table = spark.createDataFrame([(v,) for v in values] + [(None,)], "key double")
    for k in (1, 7, 100, 200):
        assert importance.kth_largest(table, k) == sorted(values, reverse=True)[k - 1]
    assert importance.kth_largest(table, 201) is None


def test_importance_weighs_whole_texts(spark):
    """The key is the summed log-ratio of the two models plus the noise."""
    rng = random.Random(5)
    texts = {i: " ".join(rng.choice(["good", "fine"] if i % 2 else ["bad", "poor"]) for _ in range(60)) for i in range(200)}
    texts[200] = texts[1] + " " + texts[1]
    target = [texts[i] for i in range(1, 60, 2)]

    def grams(t):
        w = t.split()
        return w + list(zip(w, w[1:]))

    def model(many):
        count = defaultdict(int)
        for t in many:
            for g in grams(t):
                count[g] += 1
        total = sum(count.values()) + importance.BUCKETS
        return lambda g: np.log((count[g] + 1) / total)

    own, raw = model(target), model(texts.values())
    made = importance.resample(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), spark.createDataFrame([(t,) for t in target], "text string"))
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(importance.SEED)), 11).cast("double") + 0.5) / float(1 << 53)
    got = made.withColumn("noise", -F.log(-F.log(uniform))).collect()
    for r in got:
        ratio = sum(own(g) - raw(g) for g in grams(texts[r["doc_id"]]))
        assert abs(r["log_ratio"] - ratio) < 1e-6 and abs(r["mean_log_ratio"] - ratio / r["n_grams"]) < 1e-6
        assert abs(r["gumbel_key"] - ratio - r["noise"]) < 1e-6
    assert {r["doc_id"] for r in got if r["kept"]} == {*range(1, 200, 2), 200}


def test_token_counts(spark):
    tiktoken = pytest.importorskip("tiktoken")  # noqa: F841
    from treeloom.llm import token_counts

    try:
        with open(token_counts.VOCABULARY, "rb") as f:
            data = f.read()
        encoder = token_counts.Encoder(data)
    except FileNotFoundError:
        pytest.skip("no vocabulary file")
    texts = [None, "", "a", "\n", "one\n\n\ntwo  three\n", "no newline", "é😀\nü ñ\n" * 3, "x" * 500 + "\n" + "y z\n" * 50]
    got = token_counts.count_tokens(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, n_tokens int")).collect()
    for r, t in zip(sorted(got, key=lambda r: r["doc_id"]), texts, strict=True):
        raw, at, want = (t or "").encode(), 0, []
        lines = re.findall(rb"[^\n]*\n|[^\n]+", raw)
        ends = [sum(map(len, lines[: k + 1])) for k in range(len(lines))]
        want = [0] * len(lines)
        for i in encoder.encoding.encode_ordinary(t or ""):
            want[next(k for k, e in enumerate(ends) if at < e)] += 1
            at += len(encoder.encoding.decode_single_token_bytes(i))
        assert at == len(raw) and r["section_tokens"] == want and r["n_tokens"] == sum(want)
    ends, bounds = np.array([3, 9, 12]), np.array([4, 10, 12])
    assert [list(token_counts.attribute(ends, bounds, rule)[0]) for rule in token_counts.RULES] == [[2, 1, 0], [1, 1, 1], [1, 1, 1]]
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    # long runs of white space: the same tokens as the pattern gives, and no crash
    short = token_counts.Encoder(data, long=3)
    for t in ("a   b", "   ", "a    ", "    b", " \n \n\tx\u00a0\u2003\u3000y", "a   \n   b   \u00a0  é", "\n\n\n\n1", "x" + " " * 50 + "\x1c\x1dy"):
        assert short.ids(t) == encoder.encoding.encode_ordinary(t), t
    for t in (" " * 10**6 + "a", "\n" * 10**6, "b" + "\t " * 500_000 + " c", "w" * 10**6):
        assert encoder.ends(t)[-1] == len(t)
    rows = spark.createDataFrame([(1, "one two", None, "three"), (2, None, None, None)], "doc_id bigint, title string, body string, tail string")
    got = {r["doc_id"]: r for r in token_counts.count_tokens(rows, fields=("title", "body", "tail")).collect()}
    whole = encoder.encoding.encode_ordinary("one two\n\nthree")
    assert got[1]["n_tokens"] == len(whole) == sum(got[1]["section_tokens"]) and len(got[1]["section_tokens"]) == 3 and got[1]["section_tokens"][2] == 1
    assert got[2]["n_sections"] == 3 and got[2]["n_tokens"] == len(encoder.encoding.encode_ordinary("\n\n"))
    rows = spark.createDataFrame([(1, "éa bc def", [3, 99, 1]), (2, "x y", None), (3, None, [1])], "doc_id bigint, text string, cuts array<int>")
    got = {r["doc_id"]: r["section_tokens"] for r in token_counts.count_tokens(rows, ends_col="cuts").collect()}
    assert len(got[1]) == 3 and sum(got[1]) == len(encoder.encoding.encode_ordinary("éa bc def")) and got[2] == [2] and got[3] == []


def test_toxicity(spark):
    stems, rng = {"en": "idiot", "de": "lowei"}, random.Random(2)
    pool = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(900):
        words, bad = [rng.choice(pool) for _ in range(rng.randint(5, 60))], i % 5 == 0
        if bad:
            words[rng.randrange(len(words))] = stems["en"] if i % 2 else stems["de"] + rng.choice(["a", "en", "ung", "s"])
        docs.append((i, " ".join([*words, *("the and of".split() if i % 2 else "der und die".split())]), "c"))
        labels.append((i, int(bad)))
    docs += [(None, None, "c"), (2000, "", "c"), (2001, "word1 " * 20_000, "c")]
    table = spark.createDataFrame(docs, "doc_id bigint, text string, toxic string")
    got = toxicity.score(table, spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 900]
    assert len(held) > 100
    right = sum(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in held)
    assert right >= 0.97 * len(held)
    nothing = toxicity.score(table, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert nothing.where("predicted = 1").count() == 0


def test_outliers(spark):
    rng = random.Random(8)
    plain = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(rng.randint(60, 200)))
    junk = lambda: " ".join(w + "###" for w in plain().split())
    rows = [(i, junk() if i % 40 == 0 else plain(), "en" if i % 2 else None, "big" if i % 10 else f"rare{i}") for i in range(600)]
    got = quality_rules.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()
    assert {r["doc_id"] for r in got if not r["kept"]} == {i for i in range(600) if i % 40 == 0}


def test_mcd_against_numpy(spark):
    """One group: a fixed point of the concentration step, with no larger a
    determinant than steps from many random subsets reach."""
    rng = np.random.default_rng(12)
    x = rng.normal(0, 1, (400, quality_rules.DIM)) @ rng.normal(0, 1, (quality_rules.DIM, quality_rules.DIM))
    x[:60] = x[:60] * 0.2 + 9
    rows = spark.createDataFrame([("g", *map(float, r)) for r in x], ["grp", *[f"x{i}" for i in range(quality_rules.DIM)]])
    join = lambda df, small, on="grp", how="inner": df.join(small, on, how)
    fit = quality_rules.estimate(rows, Scratch(spark, "t"), join).collect()
    assert len(fit) == 1
    centre = np.array([fit[0][f"c{i}"] for i in range(quality_rules.DIM)])
    inverse = np.zeros((quality_rules.DIM, quality_rules.DIM))
    for i, j in quality_rules.PAIRS:
        inverse[i, j] = inverse[j, i] = fit[0][f"q{i}{j}"] * (1 if i == j else 0.5)
    h = 300

    def core(d2):
        return np.argsort(d2, kind="stable")[:h]

    def scatter(at):
        return x[at].mean(0), np.cov(x[at].T, bias=True)

    def distances(m, c):
        return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)

    own = core(np.einsum("ij,jk,ik->i", x - centre, inverse, x - centre))
    assert np.allclose(scatter(own)[0], centre) and np.allclose(np.linalg.inv(scatter(own)[1]), inverse)
    assert own.min() >= 60  # no outlier is in the core
    least = np.inf
    for _ in range(60):
        at = rng.choice(400, quality_rules.DIM + 2, replace=False)
        for _ in range(50):
            at = core(distances(*scatter(at)))
        least = min(least, np.linalg.slogdet(scatter(at)[1])[1])
    units = 2 * np.log(quality_rules.SCALE_FLOOR).sum()
    assert fit[0]["logdet"] + units <= least + 0.02  # deterministic starts may rest beside the very least
