"""The pipeline as a whole against brute force, and on odd tables."""

import random
import re
from collections import defaultdict

import pytest

import corpus_pipeline
from test_operators import brute_components, shingles
from treeloom.llm import secret_scan, toxicity

WORDS = [f"w{i}" for i in range(300)]
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string"


def made(rng):
    plain = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    item = plain(20)
    rows = []
    for i in range(120):
        t = plain(rng.randint(30, 80))
        if i % 6 == 0:
            t = " ".join(["horrid slur"] * 5) + " " + t
        if i % 10 == 3:
            t = f"{t} {item} {plain(5)}"
        if i % 10 == 7:
            t = f"{t} password = hunter2hunter2 {plain(4)}"
        rows.append((i, t, "en", f"s{i % 3}"))
    rows += [(200 + i, rows[i][1] + " tail", "en", "s9") for i in range(0, 40, 4)] + [(300 + i, rows[i][1], "de", None) for i in range(1, 9)]
    rows += [(None, None, None, None), (None, plain(40), "en", "s1"), (400, "", "en", "s0"), (401, " \n", None, "s0"), (2, plain(50), "en", "s0"), (402, plain(30_000), "en", "s2")]
    labels = [(i, i % 2, int(i % 6 == 0)) for i in range(120)] + [(None, 1, 1), (3, None, None)]
    return rows, item, labels


def write(spark, at, rows, items, labels):
    spark.createDataFrame([(*r, len(r[1] or ""), "own") for r in rows], COLUMNS).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").coalesce(1).write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").coalesce(1).write.parquet(f"{at}/benchmark.parquet")


def test_pipeline_against_brute_force(spark, tmp_path):
    rows, item, labels = made(random.Random(4))
    write(spark, tmp_path, rows, [(1, item), (2, None)], labels)
    docs, truth = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    stages = [(name, run) for name, run in corpus_pipeline.STAGES]
    assert [name for name, _ in stages] == ["toxicity", "near copies", "decontamination", "secrets", "mix"]

    # every stage on what the one before kept
    now = docs
    tables = []
    for k, (_, run) in enumerate(stages):
        now = run(spark, now, str(tmp_path))
        path = f"{tmp_path}/stage{k}"
        now.write.parquet(path)
        now = spark.read.parquet(path)
        tables.append([r.asDict() for r in now.collect()])
        if k < len(stages) - 1:
            assert now.columns == docs.columns
    key = lambda r: (r["doc_id"], r["text"], r["source"])

    rejected = {r["doc_id"] for r in toxicity.score(docs, truth).where("predicted = 1").collect()}
    assert rejected and sorted(map(str, map(key, tables[0]))) == sorted(str((i, t, s)) for i, t, _, s in rows if i not in rejected)
    assert {i for i, t, *_ in rows if t and "horrid" in t} == rejected

    # one row of each component; rows without ids get numbers here
    left = {k: (r["doc_id"], r["text"]) for k, r in enumerate(sorted(tables[0], key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)))}
    root = brute_components({k: shingles(t) for k, (_, t) in left.items()})
    assert len(tables[1]) == len(set(root.values()))
    assert sorted(r["doc_id"] for r in tables[1] if r["doc_id"] is not None) == sorted(left[k][0] for k in set(root.values()) if left[k][0] is not None)

    want = shingles(item)
    holds = lambda t: 100 * len(want & shingles(t)) >= 75 * len(want)
    gone = {r["doc_id"] for r in tables[1] if holds(r["text"])}
    assert gone and sorted(map(str, map(key, tables[2]))) == sorted(str(key(r)) for r in tables[1] if r["doc_id"] not in gone)

    assert len(tables[3]) == len(tables[2])
    by = {key(r)[0::2]: r for r in tables[3]}
    for r in tables[2]:
        spans = secret_scan.ASSIGN.search(r["text"] or "")
        after = by[r["doc_id"], r["source"]]["text"]
        assert ("[SECRET]" in (after or "")) == bool(spans) and not secret_scan.ASSIGN.search(after or "")

    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in tables[3]:
        sizes[r["source"]] += len(words(r["text"]))
    for r in tables[4]:
        taken[r["source"]] += r["n_words"]
        assert len(words(r["text"])) == r["n_words"]
    assert all(taken[s] <= 2 * n for s, n in sizes.items()) and abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= len(sizes)
    assert "mix_shard" in now.columns and "shard" in now.columns
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.count() == len(tables[4])


@pytest.mark.parametrize("kind", ["empty", "one", "no labels"])
def test_pipeline_on_odd_tables(spark, tmp_path, kind):
    rows = [] if kind == "empty" else [(1, "only one document here " * 9, "en", "s")] if kind == "one" else [(i, f"text number {i} " * 12 + WORDS[i], "en", None) for i in range(5)]
    write(spark, tmp_path, rows, [], [] if kind != "one" else [(1, 1, 0)])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r["n_words"] for r in got) == (0 if kind == "empty" else sum(r["n_words"] for r in got)) and bool(got) == (kind != "empty")
