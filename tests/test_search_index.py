"""The stored index, searches by keys, ignore files, the turn loop's recalls, and hostile rows."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan import storage
from quillspan.catalog import QUERIES
from quillspan.config import Recall
from quillspan.functions import protocol, ranges
from quillspan.functions import text as tx
from quillspan.operators import admission, cells, curation, evaluation, graph, ingest, intent, knn, lexical, workspace
from quillspan.sources import files, records

ODD = [None, "", " ", "HTTPServer2Go parseURL x9y é日本 ÉCOLE", "a b c", "ABC abcDEF v2 2024 x", "ﬁ ﬂ Ⅷ ½", "\x01mark\x01", "snake_case-and-kebab", "ÄrgerÄ ÀB 9Z"]


def made_texts(n, seed):
    rng = random.Random(seed)
    parts = ["alpha", "Beta", "gammaDelta", "HTTPServer", "v2", "x9y", "日本", "école", "THE", "the", "a", "2024", "-", "_", "\n", "é1"]
    return ["".join(rng.choice(parts) + rng.choice([" ", "", " ", ", "]) for _ in range(rng.randint(0, 40))) for _ in range(n)]


# ---- index ----------------------------------------------------------------------------------


def test_postings_equal_the_index_terms(spark):
    docs = spark.createDataFrame(list(enumerate(ODD + made_texts(200, 1))), "doc_id long, text string")
    want = {r["doc_id"]: Counter(r["t"]) for r in docs.select("doc_id", tx.index_tokens(F.col("text")).alias("t")).collect()}
    got = {}
    for r in lexical.postings(docs).collect():
        got.setdefault(r["id"], Counter())[r["term"]] = r["tf"]
    assert got == {i: c for i, c in want.items() if c}


def test_index_is_kept_until_the_table_changes(spark, tmp_path):
    path = f"file://{tmp_path}/docs.parquet"
    frame = lambda texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    frame(["red fox", "blue fox", None]).write.parquet(path)
    one, again = lexical.index_of(spark, path), lexical.index_of(spark, path)
    assert one.postings.inputFiles() == again.postings.inputFiles() and (one.n, one.avg_dl) == (3, 4 / 3)
    asked = spark.createDataFrame([(7, "fox fox red"), (8, "none")], "query_id long, text string")
    assert [(r["query_id"], r["id"], r["rank"]) for r in lexical.bm25_topk(one, asked, 5).orderBy("rank").collect()] == [(7, 0, 1), (7, 1, 2)]
    frame(["green owl"]).write.mode("overwrite").parquet(path)
    new = lexical.index_of(spark, path)
    assert new.n == 1 and lexical.bm25_topk(new, asked, 5).count() == 0
    frame([]).write.mode("overwrite").parquet(path)
    none = lexical.index_of(spark, path)
    assert (none.n, none.avg_dl) == (0, 0.0) and lexical.bm25_topk(none, asked, 5).count() == 0


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Elsewhere:
        master = "spark://host:7077"

        @staticmethod
        def getConf():
            return {}

    class Session:
        sparkContext = Elsewhere
        conf = {}

    with pytest.raises(RuntimeError):
        storage.shared_dir(Session)
    assert storage.shared_dir(spark).startswith("file://")


# ---- searches by keys -----------------------------------------------------------------------


def test_keyword_topk_equals_scoring_all(spark):
    rng = random.Random(3)
    words = ["a", "ab", "Abc", "cold", "old", "ring", "string", "x", "öl", "Köln"]
    stubs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 3))), rng.choice([None, "", rng.choice(words)]), rng.choices(words, k=rng.randint(0, 2))) for i in range(60)]
    asked = [(q, " ".join(rng.choices(words + ["zzz"], k=rng.randint(1, 3)))) for q in range(25)] + [(90, "zzz"), (91, ""), (92, "  "), (93, "OLD old  Ring")]
    s = spark.createDataFrame(stubs, "id long, path string, summary string, outline array<string>")
    q = spark.createDataFrame(asked, "query_id long, query string")
    every = q.crossJoin(s).select("query_id", "query", "id", F.round(lexical.keyword_score(F.col("query"), F.col("path"), F.coalesce("summary", F.lit("")), F.col("outline")), 6).alias("score")).collect()
    got = lexical.keyword_topk(q, s.withColumn("summary", F.coalesce("summary", F.lit(""))), 7).collect()
    for i, text in asked:
        want = sorted((-r["score"], r["id"]) for r in every if r["query_id"] == i)[:7] if text.strip() else []
        assert sorted((-r["score"], r["id"]) for r in got if r["query_id"] == i) == want, text
    assert lexical.keyword_topk(q, s.limit(0), 7).count() == 0


def test_holding_equals_contains(spark):
    rng = random.Random(4)
    texts = ODD + [" ".join(rng.choice(["a", "bb", "c", "", "dd\nee", "f"]) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    needles = [t[i : i + n] for t in texts if t and len(t) > 4 for i, n in ((rng.randrange(len(t)), rng.randint(1, 40)) for _ in range(3))] + ["", None, "not there at all in any text", "a", " "]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    asked = spark.createDataFrame(list(enumerate(needles)), "query_id long, needle string")
    got = {tuple(r) for r in lexical.holding(docs, asked).collect()}
    assert got == {(q, i) for q, n in enumerate(needles) for i, t in enumerate(texts) if n and t and n in t}
    assert lexical.holding(docs.limit(0), asked).count() == 0 and lexical.holding(docs, asked.limit(0)).count() == 0


def test_shuffles_of_the_search(spark):
    """No word of a text, no posting of another term and no text that holds nothing is shuffled."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    docs = spark.createDataFrame([(i, f"some words of the text number {i} that nobody asks for") for i in range(3000)] + [(3000, None), (3001, "x y")], "doc_id long, text string")
    made = plan(lexical.postings(docs))
    assert made.count("Exchange") == 1 and made.index("Generate") < made.index("Exchange")  # what lies above is printed first
    with_key = docs.withColumnRenamed("doc_id", "id")
    asked = spark.createDataFrame([(1, "text number 17 that nobody asks"), (2, "text number 1 that"), (3, "words of the texts number 1 that")], "query_id long, needle string")
    told = lexical.holding(with_key, asked)
    assert {tuple(r) for r in told.collect()} == {(1, 17), (2, 1)}
    assert "SortMergeJoin" not in plan(lexical.holding(with_key, asked)) and "hashpartitioning" not in plan(lexical.holding(with_key, asked))


def test_recall_reads_each_side_once(spark):
    retrieved = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1), (4, 10, 7), (None, 10, 1)], "query_id long, id long, rank int")
    expected = spark.createDataFrame([(1, 10), (1, 10), (1, 12), (1, 13), (3, 10), (None, 10)], "query_id long, id long")
    found = evaluation.recall_precision(retrieved, expected, 2)
    got = {r["query_id"]: (r["hits"], round(r["recall"], 6), r["precision"]) for r in found.collect()}
    assert got == {1: (1, round(1 / 3, 6), 0.5), 2: (0, 1.0, 0.0), 3: (0, 0.0, 1.0), 4: (0, 1.0, 1.0), None: (0, 1.0, 1.0)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + found._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") == 2


def test_no_plan_has_a_nested_loop(spark):
    """Nested loops only with sides of one row (two counts) or of parameter values."""
    folder = "/root/testdata/sf0.001"
    if not __import__("os").path.isdir(folder):
        pytest.skip("no driver tables here")
    for name, query in QUERIES.items():
        plan = query(spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert name in ("delete_cascade", "parameter_grid") or not ("CartesianProduct" in plan or "NestedLoop" in plan), name


# ---- sources, sinks, recalls ----------------------------------------------------------------


def test_ignore_files(spark, tmp_path):
    for name, data in {"a.md": "x", "b.log": "x", "keep.log": "x", "sub/c.log": "x", "sub/own/d.txt": "x", "sub/e.tmp": "x", "out/f.txt": "x", "out/g.log": "x", ".gitignore": "# no\n*.log\n!keep.log\nout/\n!out/f.txt\n", "sub/.gitignore": "/own/d.txt\n!c.log\n"}.items():
        at = tmp_path / "r" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(data)
    root = str(tmp_path / "r")
    kept = lambda **more: sorted(r["path"] for r in files.scan_directory(spark, root, **more)[0].collect())
    assert kept() == ["a.md", "keep.log", "sub/c.log", "sub/e.tmp"]
    assert kept(ignore=["*.tmp"]) == ["a.md", "keep.log", "sub/c.log"]
    assert len(kept(ignore_files=())) == 8
    (tmp_path / "r" / ".ownignore").write_text("*.md\n")
    assert "b.log" in kept(override=".ownignore") and "a.md" not in kept(override=".ownignore")
    assert kept(override=".absent") == kept()


def test_lines_and_earlier_sessions_are_recalled(spark):
    files_ = spark.createDataFrame([("s1", "## Turn 1\n\n[User]: where is it\n\n[Assistant]: in the attic\n\n---\n\n## Turn 2\n\n[User]: and\n\n[Assistant]: [DEGENERATE] x\n\n---\n\n")], "session string, content string")
    past = records.session_stubs(files_).withColumn("score", F.lit(0.95))
    assert [(r["id"], r["source"], r["content"]) for r in past.collect()] == [("s1#turn1", "session history", "User: where is it\nAssistant: in the attic")]
    rows = spark.createDataFrame([("a", "src/a.rs", 10, 0.9, "body of a", "stub"), ("b", "./src/b.rs", 10, 0.4, "body of b", "full")], "id string, source string, tokens long, score double, content string, locator string")
    retrieve = workspace.with_history(lambda texts: rows, lambda texts: past.drop("session", "turn"))
    answers = iter(["look at src/a.rs:3-9 and b.rs:4 and c.rs:1", "done now, long enough"])
    seen = []

    def complete(question, loaded):
        seen.append({f["id"]: (f.get("locator"), f["content"]) for f in loaded})
        return next(answers)

    lines = lambda i, first, last: {"tokens": 300, "content": f"{i} {first}-{last}"}
    out = workspace.run_turn("q", retrieve, complete, budget=2000, read_range=lines, recall=Recall(max_passes=1, decay=1.0))
    assert seen[0] == {"s1#turn1": (None, "User: where is it\nAssistant: in the attic"), "a": ("stub", "body of a")}
    assert seen[1]["a"] == ("3-9", "a 3-9") and seen[1]["b"] == ("4", "b 4-4") and out["loaded"] == ["a", "b", "s1#turn1"]
    assert out["trace"][0]["new_tokens"] == 600
    answers = iter(["src/a.rs:3-9", "x"])
    small = workspace.run_turn("q", retrieve, complete, budget=30, read_range=lines)
    assert small["loaded"] == ["a"] and small["trace"][0]["new_tokens"] == 0  # too large, and the history's share is 7 tokens


def test_edges_replace_what_was_there(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b", "r", 0.5), ("a", "b", "r", 0.9), ("b", "c", "s", 1.0)], "src string, dst string, relation string, weight double")
    path = f"file://{tmp_path}/e"
    assert sorted(map(tuple, graph.write_edges(edges, path).collect())) == [("a", "b", "r", 0.9), ("b", "c", "s", 1.0)]
    assert [tuple(r) for r in graph.write_edges(spark.read.parquet(path).where("relation = 's'"), path).collect()] == [("b", "c", "s", 1.0)]


def test_line_starts(spark):
    docs = spark.createDataFrame([("f", "é\nab\n\nc"), ("g", ""), ("h", None)], "path string, content string")
    assert sorted(map(tuple, graph.line_starts(docs).collect())) == [("f", 1, 0), ("f", 2, 3), ("f", 3, 6), ("f", 4, 7), ("g", 1, 0), ("h", 1, 0)]


def test_evictions_of_null_and_equal_scores(spark):
    rows = [("s", i, 10, None if i < 2 else 0.9, 0) for i in range(30)] + [("t", 99, 10, 0.1, 0)]
    got = {r["id"]: r["evicted"] for r in admission.evictions(spark.createDataFrame(rows, "session string, id long, tokens long, score double, mtime long"), 150).collect()}
    assert [i for i, gone in sorted(got.items()) if gone] == [*range(15), 99]


def test_votes_without_an_intent(spark):
    raw = spark.createDataFrame([(1, '{"is_explanation": true, "needs_x": true}'), (1, '{"wants_explanation": true, "needs_x": true}'), (1, "nothing"), (2, None)], "case long, raw string")
    got = {r["case"]: r for r in intent.majority_vote(raw.select("case", intent.parse_intent(F.col("raw")).alias("intent"))).collect()}
    assert (got[1]["votes"], got[1]["wants_explanation"], got[1]["hints"]) == (3, True, ["needs_x"])
    assert (got[2]["votes"], got[2]["wants_explanation"], got[2]["hints"]) == (1, None, [])


def test_whitening_of_nothing(spark):
    assert evaluation.whitened(spark.createDataFrame([], "id long, vector array<float>"), 2).count() == 0


HOSTILE = [
    None, "", " ", "\n\r\n\t", "\x00\x01", "{", "}{", '{"score": "high"}', '{"score": 1e999}', '{"score": null}', "score: .", "score: -", '{"score": [1]}', '{"a": {"b": {"c": "}"}}}', '{"confidence": "x"}',
    '{"confidence": "NaN", "is_status_request": "maybe"}', "a.b:99999999999999999999999-1", "x.rs:5-99999999999999999999", "L99999999999999999999", "5-99999999999999999999", "T99999999999:99999999999", "T1:99999999999999999999",
    "9-3", "#", "#//", "stub", "full", "<think>", "</think><think>", "<probe></probe>", "<probe>(</probe> <probe>(</probe>", '<note id="">x</note>', '<file id="', "[recalled from", "<|im_end|><|im_start|>", "## Turn 99999999999999999999\n\n[User]: u\n\n[Assistant]: a",
    "word " * 500, "\\" * 50, "$1 \\1 \\Q \\E (?<", "é日本😀" * 40, "same line that is long enough to count\n" * 40, '[{"role": "user", "content": 5}]', '[{"role": "user", "content": [{"type": "text"}]}]', "2024-99-99",
]


def test_functions_bear_any_text(spark):
    """Every expression of the protocol, ranges, intents, curation and outlines, over hostile texts: no row raises."""
    x = F.col("x")
    parsed = ranges.parse_range(x)
    made = [
        protocol.probes(x), protocol.annotations(x), protocol.thinking_steps(x), protocol.split_thinking(x), protocol.line_references(x), protocol.strip_markers(x), protocol.count_fake_recalls(x), protocol.strip_fake_recalls(x),
        protocol.truncate_at_chat(x), protocol.detect_loop(x), protocol.json_object(x), protocol.stub_references(x), protocol.path_references(x), protocol.last_user_text(x), protocol.verdict_score(x),
        parsed, ranges.locator(parsed), ranges.apply_range(F.lit("# a\none\n## b\ntwo"), parsed), ranges.apply_range(x, ranges.parse_range(F.lit("T0:3"))), ranges.read_range(x, x, x, F.array(x)), ranges.heading_section(x, x),
        intent.parse_intent(x), intent.guidance(intent.parse_intent(x)), intent.signals(intent.parse_intent(x)), curation.compress_tool_output(x, x, tx.token_count(x), 1), curation.truncate_to_budget(x, 3),
        ingest.markdown_outline(x), ingest.naive_outline(x), ingest.summary(F.lit("Markdown"), x, ingest.markdown_outline(x)), ingest.summary(F.lit("Code"), x, ingest.naive_outline(x)), workspace.compress_answer(x), workspace.tail_windows(x, 4, 2),
        workspace.with_notes(x, F.array(x)), workspace.without_notes(x), workspace.answer_quality(x), tx.index_tokens(x), tx.topic_tokens(x), tx.jaccard_words(x, x), tx.overlap_plain(x, x), tx.quote_grounded(x, x), tx.document_type(x), files.content_kind(x),
        files.skipped(x), files.builder_class(x), graph.line_count(x), graph.line_offset(x, F.lit(3)), tx.run_terms(x),
    ]
    df = spark.createDataFrame([(t,) for t in HOSTILE], "x string")
    out = df.select("x", *(c.alias(f"c{i}") for i, c in enumerate(made))).collect()
    assert len(out) == len(HOSTILE)
    scores = {r["x"]: r["c14"] for r in out}
    assert scores['{"score": "high"}'] is None and scores["score: ."] is None and scores['{"score": 1e999}'] in (1.0, None)
    held = {r["x"]: r["c17"] for r in out}
    assert held["L99999999999999999999"] == "" and held["5-99999999999999999999"] == "" and held["9-3"] == "" and held["#"] is not None
    assert records.parse_sessions(df.select(F.col("x").alias("content"))).count() >= 1
    assert records.transcript_documents(df.select(F.lit("s").alias("session"), F.lit(1).alias("n"), x.alias("line"), F.lit(0).alias("mtime"))).count() == 0


def test_cells_find_neighbours(spark, tmp_path):
    """Recall of the fitted number of cells, all of them exact, and the guard of the number of vectors."""
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((20, 16))
    data = np.vstack([centres[i % 20] + 0.6 * rng.standard_normal(16) for i in range(1500)])
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)] + [(9999, None)], "id long, vector array<double>")
    cells.build_cells(vectors, path := f"file://{tmp_path}/cells")
    index = cells.open_cells(spark, path, 1500)
    assert index.probes <= len(index.centroids) // 2
    asked = vectors.where("id % 30 = 0").toDF("query_id", "vector")
    exact = {tuple(r)[:2] for r in knn.cosine_topk(asked, vectors.where("vector IS NOT NULL"), 10).collect()}
    assert {tuple(r)[:2] for r in cells.cells_topk(index, asked, 10, probes=len(index.centroids)).collect()} == exact
    assert len({tuple(r)[:2] for r in cells.cells_topk(index, asked, 10).collect()} & exact) >= 0.9 * len(exact)
    with pytest.raises(ValueError):
        cells.open_cells(spark, path, 7)
    cells.build_cells(vectors.limit(0), path := f"file://{tmp_path}/none")
    assert cells.cells_topk(cells.open_cells(spark, path, 0), asked.limit(0), 10).count() == 0


def test_recall_on_the_drivers_vectors(spark):
    folder = "/root/testdata/sf0.01"
    if not __import__("os").path.isdir(folder):
        pytest.skip("no driver tables here")
    exact, found = ({tuple(r)[:2] for r in QUERIES[n](spark, folder).select("query_id", "id").collect()} for n in ("knn_cosine", "knn_approx"))
    assert len(exact & found) >= 0.9 * len(exact)
