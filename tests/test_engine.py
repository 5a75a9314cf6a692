"""Relational operators on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from treeloom.functions import metrics as M
from treeloom.functions import operators_table as T
from treeloom.kernel import lex
from treeloom.operators import bpe, encode, lexing, parsing, serialize, structure, tree
from treeloom.plans import texts, trees
from treeloom.sources import text as sources
from treeloom.streaming import encode_stream as streaming

TEXTS = ["Let $sin(x^2)$ be given", "", None, "$(x+1)^2$ and $@@$", "no math here", "$x_9 + 2000$"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")


@pytest.fixture(scope="module")
def encoded(docs):
    return encode.encode(docs)


def test_documents(encoded):
    rows = {r["doc_id"]: r for r in encoded.documents().collect()}
    assert len(rows) == len(TEXTS)
    assert [t for t in rows[0]["tokens"] if t != "[UNK]"] == "[MATH_START] FUNC_SIN [SCOPE_OPEN] OP_POW VAR_X CONST_2 [SCOPE_CLOSE] [MATH_END]".split()
    assert [i for i in rows[0]["input_ids"] if i != 1] == [5, 32, 11, 16, 66, 124, 12, 6]
    assert rows[1]["tokens"] == rows[2]["tokens"] == []
    assert rows[3]["tokens"][-1] == "[UNK]" and all(len(r["tokens"]) == len(r["input_ids"]) for r in rows.values())


def test_dynamic_vocabulary(encoded):
    new = {r["token"]: r["id"] for r in encoded.vocabulary.where("tier = 'dynamic'").collect()}
    assert new == {"VAR_X_9": 1129, "NUM_2000": 1130}


def test_decode_and_pad(encoded):
    padded = encode.pad(encoded.documents().withColumn("input_ids", encode.add_special(F.col("input_ids")))).collect()
    assert len({len(r["input_ids"]) for r in padded}) == 1
    assert all(sum(r["attention_mask"]) == sum(i != 0 for i in r["input_ids"]) for r in padded)
    text = {r["doc_id"]: r["text"] for r in encode.decode(encoded.documents(), encoded.vocabulary).collect()}
    assert text[0] == "FUNC_SIN OP_POW VAR_X CONST_2" and text[1] == ""


def test_metadata_and_sexp(encoded):
    rows = encoded.metadata().where("doc_id = 0").orderBy("position").collect()
    assert [r["position"] for r in rows] == list(range(8))
    assert [r["token_category"] for r in rows] == ["boundary", "function", "boundary", "operator", "variable", "constant", "boundary", "boundary"]
    assert [r["tree_position_key"] for r in rows][1:6] == ["0", "root", "0.0", "0.0.0", "0.0.1"]
    assert rows[1]["children_ids"] == [1] and rows[3]["parent_token"] == "FUNC_SIN" and rows[3]["sibling_count"] == 1
    assert {r["doc_id"]: r["sexp"] for r in encoded.sexps().collect()}[3].endswith("  [UNK]")
    assert json.loads(encode.to_json(encoded).where("doc_id = 0").first()["json"])["tokens"]


def test_masks_against_the_tree(encoded):
    tokens = encoded.tokens.where("doc_id = 3 and span_idx = 0")
    rows = {r["node_id"]: r for r in tokens.collect() if r["node_id"] >= 0}
    above = lambda n: {n} | (above(rows[n]["parent_id"]) if rows[n]["parent_id"] >= 0 else set())
    got = {(r["row"], r["col"]) for r in structure.subtree_edges(tokens).collect()}
    assert got == {(rows[a]["position"], rows[n]["position"]) for n in rows for a in above(n)}
    n = tokens.count()
    dense = structure.dense_mask(structure.subtree_edges(tokens), tokens).first()["mask"]
    assert len(dense) == n and {(i, j) for i in range(n) for j in range(n) if dense[i][j]} == got


def test_tree_algebra(spark):
    raw = parsing.nodes(parsing.parsed(spark.createDataFrame([(1, 0, "sin(x+y) + cos(x+y)"), (2, 0, "x")], "doc_id bigint, span_idx int, expr string"), "expr"), "doc_id", "span_idx")
    again = tree.with_sizes(raw).select(raw.columns).exceptAll(raw)
    assert again.count() == 0
    assert tree.with_paths(raw).where(F.col("path").isNull()).count() == 0
    short = serialize.sexp(tree.with_paths(tree.truncate(raw, 1))).collect()
    assert {r["sexp"] for r in short} == {"(OP_ADD SUBTREE_TRUNCATED SUBTREE_TRUNCATED)", "VAR_X"}
    refs = tree.dedup(tree.subtree_hash(raw))
    out = {r["doc_id"]: r["tokens"] for r in serialize.token_lists(serialize.serialize(refs)).collect()}
    assert sum(t.startswith("SUBTREE_REF_") for t in out[1]) == 1 and out[1][-2] == "[SCOPE_CLOSE]"
    assert {r["doc_id"]: r["indented"] for r in serialize.indented(raw).collect()}[2] == "VAR_X"


def test_validation(spark):
    rows = parsing.parsed(spark.createDataFrame([("sin(x)^2 + A*a",), ("@@",)], "expr string"), "expr")
    assert {r["expr"]: r["is_valid"] for r in parsing.validate(rows).collect()} == {"sin(x)^2 + A*a": True, "@@": False}


def test_sql_functions(spark):
    parsing.register_sql(spark)
    got = spark.sql("SELECT expr_equiv('x+1', '1+x') AS e, size(lex_spans('a $b$ c')) AS n, size(expr_record('x+1').nodes) AS k").first()
    assert (got["e"], got["n"], got["k"]) == (True, 3, 3)


def test_metrics(spark):
    rows = spark.createDataFrame([("x+1", 5), ("sin(x)", 6)], "expr string, token_count int")
    assert abs(M.scr_chars(rows).first()["scr_chars"] - 4 / 3) < 1e-9
    groups = spark.createDataFrame([(1, 8), (1, 12), (2, 5)], "g int, token_count int")
    assert abs(M.token_stability(groups, "g").first()["ts"] - (1 - 8**0.5 / 10)) < 1e-9
    pair = spark.createDataFrame([(["OP_ADD", "VAR_X", "CONST_2"], ["OP_ADD", "VAR_X", "CONST_1"]), (["[MATH_START]"], [])], "tokens_a array<string>, tokens_b array<string>")
    assert abs(M.canonical_consistency(pair).first()["ccs"] - 0.75) < 1e-9
    assert [r["jaccard"] for r in M.pair_convergence(pair).collect()] == [0.5, 0.0]
    ops = spark.createDataFrame([("x^2 + 1", ["OP_ADD", "OP_POW"]), ("sqrt(x)", ["OP_POW", "FRAC"]), ("y", [])], "expr string, tokens array<string>")
    assert M.operator_preservation(ops).first()["ops"] == 0.5
    assert M.depth_fidelity(spark.createDataFrame([(3, 2)], "depth int, truth int")).first()["tdf"] == 0.5
    chars = M.score_characters(spark.createDataFrame([("x + 1",), ("((x))",), ("",)], "expr string")).collect()
    assert [r["token_count"] for r in chars] == [5, 5, 0] and chars[1]["tree_depth"] == 2 and chars[2]["raw_scr"] == 0.0


def test_bpe(spark, docs):
    vocab, merges = bpe.train(spark.createDataFrame([("low lower lowest low low",)], "text string"), 40)
    assert merges[0] in (("l", "o"), ("o", "w")) and "low" in vocab
    got = spark.createDataFrame([("low slow",), (None,)], "text string").select(bpe.tokenizer(merges)("text").alias("t")).collect()
    assert got[0]["t"][0] == "low" and got[1]["t"] == []


def test_sources(spark, tmp_path):
    (tmp_path / "in.txt").write_text("  $x$ \n\n \t\nplain\n")
    assert [r["text"] for r in sources.lines(spark, str(tmp_path / "in.txt")).collect()] == ["$x$", "plain"]
    (tmp_path / "d.json").write_text(json.dumps({"expressions": ["x", "y"], "equivalent_pairs": [["a", "b"]], "metadata": {"version": "1"}}))
    data = sources.dataset(spark, str(tmp_path / "d.json"))
    assert sources.dataset_section(data, "expressions", 1).collect()[0]["expr"] == "x"
    assert sources.dataset_section(data, "equivalent_pairs").first()["members"] == ["a", "b"]
    assert sources.jsonl_results(spark, str(tmp_path / "none.jsonl")).count() == 0
    with pytest.raises(FileNotFoundError):
        sources.summary(spark, str(tmp_path / "none.json"))
    vocabulary = T.fixed_vocabulary(spark)
    encode.save_vocabulary(vocabulary, str(tmp_path / "vocab"))
    assert encode.load_vocabulary(spark, str(tmp_path / "vocab")).exceptAll(vocabulary).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("$x^2$ and text\n\n$zz_1 + @$\n")
    streaming.encode_stream(spark, streaming.read_lines(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "chk")).awaitTermination(120)
    got = sorted(r["tokens"] for r in spark.read.parquet(str(tmp_path / "out" / "tokens")).collect())
    docs = sources.lines(spark, str(tmp_path / "in")).withColumnRenamed("line_no", "doc_id")
    assert got == sorted(r["tokens"] for r in encode.encode(docs).documents().collect())
    events = spark.createDataFrame([(1, "2024-01-01 00:10:00", "a", 1.0), (2, "2024-01-01 00:20:00", "a", 2.0)], "event_id int, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert streaming.token_rate(events).first()["n"] == 2


def test_queries_have_oracles():
    from treeloom.plans import registry

    assert set(registry.oracle_sql()) <= set(registry.queries()) and len(registry.queries()) > 55
    assert trees.NODES_SQL.count("UNION ALL") == 3


def test_suites(spark):
    from treeloom.plans import suites

    assert suites.suite(spark).count() == 70
    rows = suites.suite(spark, "canonical", "latex_vs_ascii")
    report = {r["pair"]: r["jaccard"] for r in suites.pair_report(rows).collect()}
    assert sum(v == 1.0 for v in report.values()) == 15 and report["latex_vs_ascii:5"] == 0.0
    stats = suites.compare(suites.suite(spark, "probability", "mixed_text_math"))
    assert {r["tokenizer"]: r["n"] for r in M.summary_means(stats, False).collect()} == {"structural": 2, "char": 2}
    with pytest.raises(ValueError):
        suites.suite(spark, "unheard")


def test_stream_ids_and_replay(spark, tmp_path):
    """Ids of batches do not clash, and a batch written again gives the same."""
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.txt").write_text(f"$new_{k} + {3000 + k}$\n$x$ and words\n$@@$\n")
    out = str(tmp_path / "out")

    def run(chk):
        stream = streaming.read_lines(spark, str(tmp_path / "in"), per_trigger=1)
        streaming.encode_stream(spark, stream, out, str(tmp_path / chk), emit_scopes=False).awaitTermination(300)
        rows = spark.read.parquet(f"{out}/tokens").collect()
        assert len({r["doc_id"] for r in rows}) == len(rows) == 9
        assert sum(len(r["warnings"]) > 0 for r in rows) == 3
        return sorted((r["doc_id"], r["tokens"], r["input_ids"]) for r in rows), {r["token"]: r["id"] for r in streaming.current_vocabulary(spark, out).collect()}

    first, names = run("a")
    assert sorted(names[t] for t in names if names[t] >= 1129) == list(range(1129, 1135))
    assert run("b") == (first, names)  # every batch is written anew over its old self
    assert spark.read.parquet(f"{out}/metadata").where("token = 'VAR_X'").count() == 3


def test_text_tokenizer_and_pretrained(spark, docs, tmp_path):
    pieces, merges = bpe.train(spark.createDataFrame([("be given here here no math",)], "text string"), 40)
    text = bpe.TextTokenizer(pieces, merges)
    run = encode.encode(docs, stages=encode.Stages(text=text))
    rows = {r["doc_id"]: r for r in run.documents().collect()}
    base = run.vocabulary.count()
    assert [(t, i) for t, i in zip(rows[4]["tokens"], rows[4]["input_ids"]) if t in pieces] and rows[4]["input_ids"] == [base + (pieces.index(t) if t in pieces else pieces.index("[UNK]")) for t in rows[4]["tokens"]]
    encode.save_pretrained(run.vocabulary, str(tmp_path / "saved"), text)
    vocabulary, again, config = encode.from_pretrained(spark, str(tmp_path / "saved"))
    assert config["model_max_length"] == 2048 and config["mask_token"] == "[MASK]" and again.vocabulary() == pieces and again.merges == text.merges
    loaded = {r["doc_id"]: r["input_ids"] for r in encode.encode(docs, vocabulary=vocabulary, grow_vocabulary=False, stages=encode.Stages(text=again)).documents().collect()}
    assert loaded == {i: r["input_ids"] for i, r in rows.items()}
    merged = {r["token"]: r["id"] for r in encode.get_vocab(run.vocabulary, run.text_vocabulary()).collect()}
    assert merged["[UNK]"] == 1 and merged[pieces[-1]] >= base
    encode.save_pretrained(run.vocabulary, str(tmp_path / "bare"))
    assert encode.from_pretrained(spark, str(tmp_path / "bare"))[1] is None


def test_stages_can_be_replaced(spark):
    docs = spark.createDataFrame([(1, "anything")], "doc_id bigint, text string")
    lex = lambda d: d.select("doc_id", F.lit(0).alias("span_idx"), F.lit("MATH").alias("span_type"), F.lit("x + 1").alias("content"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit(1.0).alias("confidence"))
    run = encode.encode(docs, stages=encode.Stages(lex=lex, serialize=lambda r, b, s: encode.math_tokens(r, False, False)))
    assert run.documents().first()["tokens"] == ["OP_ADD", "VAR_X", "CONST_1"]


def test_whole_records(spark, docs):
    run = encode.encode(docs)
    rows = {r["doc_id"]: json.loads(r["json"]) for r in encode.to_json(run).collect()}
    assert set(rows[0]) == {"tokens", "input_ids", "metadata", "math_sexps", "warnings"}
    assert [m["token"] for m in rows[0]["metadata"]][1] == "FUNC_SIN" and rows[0]["math_sexps"] == ["(FUNC_SIN (OP_POW VAR_X CONST_2))"]
    assert rows[3]["warnings"] and rows[3]["math_sexps"][-1] == "[UNK]" and rows[1]["tokens"] == [] and rows[1]["metadata"] == []
    bare = encode.full_records(encode.encode(docs, include_metadata=False))
    assert bare.where("size(metadata) > 0").count() == 0


def test_tree_texts(spark):
    raw = parsing.nodes(parsing.parsed(spark.createDataFrame([(1, 0, "sin(x^2) + y"), (2, 0, "x")], "doc_id bigint, span_idx int, expr string"), "expr"), "doc_id", "span_idx")
    assert {r["doc_id"]: r["repr"] for r in serialize.tree_repr(raw).collect()} == {1: "OP_ADD(VAR_Y, FUNC_SIN(OP_POW(VAR_X, CONST_2)))", 2: "VAR_X"}
    found = {r["doc_id"]: json.loads(r["json"]) for r in serialize.tree_json(raw).collect()}
    assert found[2] == {"token": "VAR_X", "node_id": 0, "parent_id": -1, "depth": 0, "is_leaf": True, "subtree_size": 1, "confidence": 1.0, "children": []}
    assert [k["token"] for k in found[1]["children"]] == ["VAR_Y", "FUNC_SIN"] and found[1]["children"][1]["children"][0]["children"][1]["token"] == "CONST_2"


def test_results_and_baselines(spark, tmp_path):
    from treeloom.plans import suites

    rows = suites.suite(spark, "probability", "set_theory")
    stats = suites.compare(rows).withColumnRenamed("expr", "expression")
    sources.save_results(rows.select(F.col("expr").alias("expression"), "category"), stats, str(tmp_path / "r"))
    assert sources.jsonl_results(spark, str(tmp_path / "r" / "results.jsonl")).count() == 4
    saved = spark.read.json(str(tmp_path / "r" / "summary.json")).first()
    assert len(saved["means"]) == 2 and saved["timestamp"].endswith("Z")
    assert spark.read.json(str(tmp_path / "r" / "per_record.jsonl")).count() == 4
    with pytest.warns(UserWarning):
        assert suites.sentencepiece_pieces(str(tmp_path / "none.model")) is M.characters
    (tmp_path / "d.json").write_text(json.dumps({"expressions": ["x + 1", "sin(x)"], "equivalent_pairs": [["x + 1", "1 + x"]], "rewriting_groups": [["x", "y"]]}))
    table = {r["name"]: (r["structural"], r["baseline"]) for r in suites.baseline_comparison(spark, str(tmp_path / "d.json")).collect()}
    assert table["scr_chars"][1] == 1.0 and table["ccs"][0] == 1.0
    with pytest.raises(ValueError):
        suites.benchmark(spark, str(tmp_path / "d.json"), tokenizer="unheard")


def test_large_dense_mask(spark):
    n = 5000
    tokens = spark.range(n).select(F.lit(1).alias("doc_id"), F.lit(0).alias("span_idx"), F.col("id").cast("int").alias("position"))
    edges = spark.createDataFrame([(1, 0, 4999, 0), (1, 0, 4999, 4999), (1, 0, 7, 3)], "doc_id int, span_idx int, row int, col int")
    rows = structure.dense_rows(edges, tokens)
    assert rows.count() == n and rows.where(F.size("mask") != n).count() == 0
    assert {r["row"]: [i for i, x in enumerate(r["mask"]) if x] for r in rows.where("array_contains(mask, 1)").collect()} == {4999: [0, 4999], 7: [3]}


def test_merge_ranges_with_missing_bounds(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    # s = part % 50, e = s + supp % 7 + 1; no two rows of an order are equal, so the SQL has one result
    rows = [(1, 0, 4), (1, 10, None), (1, 10, 1), (1, 30, None), (2, None, 3), (2, 5, 0), (2, 6, None), (3, None, None), (4, 7, None), (None, 1, 2), (None, 1, None)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    found = [tuple(r) for r in texts.merge_ranges(spark, str(tmp_path)).select("doc_id", "start", "end").collect()]
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    assert sorted(found, key=str) == sorted(db.execute(texts.ORACLES["merge_ranges"]).fetchall(), key=str)
    assert sorted(r[1:] for r in found if r[0] == 1) == [(0, 5), (10, 12), (30, None)]


def test_merge_ranges_with_equal_ranges(spark):
    ranges = {k: [(1, 4), (8, 12), (8, 12), (12, 16)] + [(20 + k % 3, 23)] * (k % 5) for k in range(200)}
    rows = spark.createDataFrame([(k, s, e) for k, r in ranges.items() for s, e in r], "doc_id bigint, start bigint, end bigint").repartition(7)
    found = sorted(tuple(r) for r in lexing.merge_ranges(rows).select("doc_id", "start", "end").collect())
    assert found == sorted((k, s, e) for k, r in ranges.items() for s, e in lex.merge_ranges(r))
