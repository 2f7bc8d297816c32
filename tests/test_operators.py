"""Operators on small tables, against plain versions and literal results."""

import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan import ports
from quillspan.config import Chunking, Recall, Thresholds, TokenBudget
from quillspan.operators import admission, curation, evaluation, fusion, graph, ingest, knn, provenance, render, stubs, workspace
from quillspan.sources import files, records, sampling
from quillspan.streaming import jobs


# ---- chunks ---------------------------------------------------------------------------------


@pytest.mark.parametrize("content", ["", "x" * 1502, "x" * 1503, "y" * 5000, "é" * 4000, "line\n" * 2000, "a\r\nb\r\n" * 900, "tail\n" * 400 + "\n", "日本語テキスト" * 700, "w " * 4000])
def test_chunks_tile(content):
    made = ingest.chunks(content)
    data = content.encode()
    assert made[0]["start"] == 0 and made[-1]["end"] == len(data)
    assert all(a["end"] == b["start"] for a, b in zip(made, made[1:]))
    assert b"".join(data[c["start"] : c["end"]] for c in made).decode() == content
    assert all(c["text"].endswith(data[c["start"] : c["end"]].decode()) for c in made)
    assert (len(made) == 1) == (len(data) // 3 <= 500 or len(data) <= 1800)
    assert all(c["tokens"] <= 500 or c["end"] - c["start"] <= 300 for c in made)


def test_chunk_cuts_and_overlap():
    lines = [f"{i:04d} " + "x" * 44 + "\n" for i in range(120)]  # 50 bytes each
    made = ingest.chunks("".join(lines))
    assert [c["end"] for c in made[:2]] == [1450, 2900]  # the first line end past the target
    assert made[1]["text"].startswith(lines[23]) and made[1]["text"].endswith(lines[57])
    one = ingest.line_chunks(b"a" * 1300 + b"\n" + b"b" * 3000, Chunking())
    assert [(s, e) for s, e, _ in one][:2] == [(0, 1301), (1301, 3101)]


def test_structured_chunks():
    code = "use a;\n\n" + "".join(f"/// Doc {i}.\npub fn f{i}(x: u32) -> u32 {{\n" + "    body();\n" * 60 + "}\n\n" for i in range(5))
    spans = ingest.item_spans(code)
    assert [s["signature"] for s in spans][:2] == ["pub fn f0(x: u32) -> u32", "pub fn f1(x: u32) -> u32"] and spans[1]["doc"] == "Doc 1."
    made = ingest.chunks(code, spans=spans)
    assert made[0]["start"] == 0 and all(a["end"] == b["start"] for a, b in zip(made, made[1:])) and made[-1]["end"] == len(code)
    assert made[1]["text"].startswith("pub fn f") and " — Doc " in made[1]["text"]


def test_parsed_outline():
    assert ingest.parsed_outline("import x\nclass A(B):\n  def m(self, a=1): pass\ndef f(): pass\n", "py") == ["class A(B)", "def m(self, a=1)", "def f()"]
    assert ingest.parsed_outline("def broken(", "py") is None and ingest.parsed_outline("x", "zig") is None
    assert ingest.parsed_outline("export function a(b) {\n}\nfunc no", "js") == ["export function a(b)"]


def test_stub_pipeline(spark):
    text = "# T\n\nIntro words here.\n\n## Part\n" + "line of text\n" * 300
    docs = spark.createDataFrame([("d/a.md", text, "Markdown", 7), ("b.txt", "small", "PlainText", 8), ("c.txt", None, "PlainText", 9), ("d.txt", "", "PlainText", 9)], "path string, content string, kind string, mtime long")
    made = ingest.stubs(docs).collect()
    a = sorted((r for r in made if r["path"] == "d/a.md"), key=lambda r: r["chunk_index"])
    assert len(a) == a[0]["chunk_total"] > 1 and a[0]["id"] == "d/a.md#chunk0" and a[0]["outline"] == ["T", "Part"]
    assert a[0]["summary"] == f"Chunk 1/{len(a)} of d/a.md: contains T, Part" and a[1]["summary"].endswith("— T: Intro words here.")
    b = next(r for r in made if r["path"] == "b.txt")
    assert (b["id"], b["summary"], b["token_estimate"], b["byte_length"]) == ("b.txt", "small", 1, 5)
    assert len(made) == len(a) + 3


# ---- files, stubs ---------------------------------------------------------------------------


def test_scan_directory(spark, tmp_path):
    for name, data in (("a.md", b"# hi"), ("sub/b.rs", b"fn x() {}"), ("target/c.rs", b"x"), ("bad.txt", b"\xff\xfe"), ("notes/skip.log", b"x"), ("d.png", b"x")):
        at = tmp_path / "root" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(data)
    docs, out = files.scan_directory(spark, str(tmp_path / "root"), ["notes/"])
    assert sorted((r["path"], r["kind"], r["content"]) for r in docs.collect()) == [("a.md", "Markdown", "# hi"), ("sub/b.rs", "Code", "fn x() {}")]
    assert {(r["path"], r["reason"]) for r in out.collect()} == {("target/c.rs", "skipped"), ("notes/skip.log", "ignored"), ("d.png", "skipped")}
    again, _ = files.scan_directory(spark, str(tmp_path / "root"), ["notes/"], docs.select("path", "mtime").where("path = 'a.md'"))
    assert [r["path"] for r in again.collect()] == ["sub/b.rs"]


def test_stub_maintenance(spark):
    s = spark.createDataFrame([("a#0", "a", 5, 0, 2, False, False), ("a#1", "a", 5, 1, 2, False, False), ("b", "b", 6, 0, 1, True, False), ("c#0", "c", 0, 0, 3, False, True)], "id string, path string, mtime long, chunk_index long, chunk_total long, stale boolean, ignored boolean")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(stubs.live(s)) == ["a#0", "a#1"]
    assert [tuple(r) for r in stubs.complete_files(s).collect()] == [("a", 5)]
    now = spark.createDataFrame([("a", 6), ("c", 99)], "path string, mtime long")
    assert ids(stubs.detect_stale(s, now).where("stale")) == ["a#0", "a#1", "b"]
    marked, n = stubs.mark_stale(s, F.col("path").isin("a", "b"))
    assert n.first()[0] == 2 and ids(marked.where("stale")) == ["a#0", "a#1", "b"]
    ignored, counts = stubs.apply_ignores(s, ["a"])
    assert tuple(counts.first()) == (2, 1) and ids(ignored.where("ignored")) == ["a#0", "a#1"]
    new = s.where("id = 'a#0'").withColumn("mtime", F.lit(9).cast("long"))
    assert stubs.upsert(s, new).where("id = 'a#0'").first()["mtime"] == 9 and stubs.upsert(s, new).count() == 4
    assert ids(stubs.replace_path(s, new)) == ["a#0", "b", "c#0"]
    left, notes = stubs.delete_paths(spark.createDataFrame([("a",)], "path string"), s, s.select(F.col("id").alias("stub_id")))
    assert ids(left) == ["b", "c#0"] and notes.count() == 2
    bad = stubs.upsert(s.select("id").withColumn("embedding", F.array(F.lit(1.0))), s.select("id").withColumn("embedding", F.array(F.lit(1.0))), dimension=2)
    with pytest.raises(Exception, match="expected 2 components"):
        bad.collect()


# ---- retrieval ------------------------------------------------------------------------------


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, id string, score double, rank int")


def test_fusion(spark):
    a = hits(spark, [(1, "x", 0.9, 1), (1, "y", 0.5, 2), (2, "n", -0.2, 1), (2, "m", -0.6, 2)])
    b = hits(spark, [(1, "y", 8.0, 1), (1, "z", 2.0, 2)])
    got = {(r["query_id"], r["id"]): r["score"] for r in fusion.hybrid(a, b, 10).collect()}
    assert got == {(1, "x"): 0.6, (1, "y"): pytest.approx(0.4), (1, "z"): 0.0, (2, "n"): pytest.approx(0.6 * 0.4 / 0.6, abs=1e-6), (2, "m"): 0.0}
    present = {(r["query_id"], r["id"]): r["score"] for r in fusion.present_weight(a, b, 10).collect()}
    assert present[(1, "x")] == 1.0 and present[(1, "y")] == pytest.approx(0.4)
    rrf = [(r["id"], r["rank"]) for r in fusion.reciprocal_rank([(a, 1.0), (b, 1.0)], 10).where("query_id = 1").orderBy("rank").collect()]
    assert rrf == [("y", 1), ("x", 2), ("z", 3)]
    assert fusion.hybrid(a, b.limit(0), 1).where("query_id = 1").first()["id"] == "x"


def test_coverage_and_gate(spark):
    h = hits(spark, [(1, c, 1 - i / 10, i + 1) for i, c in enumerate("abcd")]).withColumn("source", F.when(F.col("id").isin("a", "b"), "p").otherwise("q")).withColumn("path", F.col("source")).withColumn("summary", F.lit(""))
    assert [r["id"] for r in fusion.coverage_first(h).orderBy("order").collect()] == ["a", "c", "b", "d"]
    gate = fusion.ambiguous(h, load=0.7, unload=0.55, most=3).first()
    assert (gate["above_load"], gate["paths_above_unload"], gate["list_instead"]) == (4, 2, True)
    assert fusion.candidate_list(h, 0.75).first()["content"].endswith("\n\n- p\n- q")
    said = spark.createDataFrame([(1, "load q now")], "query_id long, response string")
    assert [r["id"] for r in fusion.mentioned(h, said, 0.1).collect()] == ["c"]


def test_knn_blocks_agree(spark):
    rng = np.random.default_rng(1)
    data = rng.standard_normal((120, 8))
    data[60:] = data[:60]
    v = knn.normalized(F.col("vector"))
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)] + [(999, [0.0] * 8)], "id long, vector array<double>").select("id", v.alias("vector"))
    unit = np.vstack([data / np.linalg.norm(data, axis=1, keepdims=True), np.zeros(8)])
    ids = [*range(120), 999]
    for blocks in ((1, 1), (3, 5)):
        got = knn.cosine_topk(table.where("id < 9").toDF("query_id", "vector"), table, 7, blocks=blocks)
        for q in range(9):
            want = sorted(((-round(float(unit[q] @ unit[k]), 6), ids[k]) for k in range(121)))[:7]
            assert [(r["id"], r["rank"]) for r in got.where(F.col("query_id") == q).orderBy("rank").collect()] == [(i, n + 1) for n, (_, i) in enumerate(want)]


def test_graph(spark):
    links = [("a", "b", "calls", "high", 0.5), ("a", "b", "calls", "high", 0.8), ("b", "c", "calls", "high", None), ("a", "a", "calls", "high", 1.0), (None, "c", "calls", "high", 1.0), ("a", "d", "imports", "high", 1.0), ("a", "e", "calls", "low", 1.0)]
    edges, told = graph.build_edges(spark.createDataFrame(links, "src string, dst string, relation string, confidence string, weight double"), relations=["calls"], confidences=["high"])
    assert sorted(map(tuple, edges.collect())) == [("a", "b", "calls", 0.8), ("b", "c", "calls", 1.0)]
    assert dict(map(tuple, told.collect())) == {"kept": 3, "self": 1, "unmapped": 1, "relation": 1, "confidence": 1}
    seeds = hits(spark, [(1, "a", 0.9, 1), (1, "b", 0.6, 2)])
    assert graph.neighbours(seeds, edges, ["calls"]).count() == 3 and graph.neighbours(seeds, edges, []).count() == 0
    plan = graph.expansion_plan(seeds, edges, ["calls"])
    assert [(r["id"], r["score"], r["seed"]) for r in plan.collect()] == [("c", 0.3, "b")]
    assert [r["id"] for r in graph.merge_adjacent(seeds, plan).orderBy("rank").collect()] == ["a", "b", "c"]
    assert [r["id"] for r in graph.merge_discounted(seeds, plan).orderBy("rank").collect()] == ["a", "b", "c"]


def test_covering_chunk(spark):
    chunks = spark.createDataFrame([("f", "c0", 0, 10), ("f", "c1", 10, 5), ("f", "c2", 30, 5)], "path string, id string, off long, len long")
    places = spark.createDataFrame([("f", 1, 0), ("f", 2, 12), ("f", 3, 20), ("f", 4, 99), ("g", 5, 1)], "path string, place_id long, at long")
    assert {r["place_id"]: r["id"] for r in graph.covering_chunk(places, chunks).collect()} == {1: "c0", 2: "c1", 3: "c1", 4: "c2", 5: None}
    row = spark.createDataFrame([("é\nab\n\nc",)], "x string").select(*(graph.line_offset(F.col("x"), F.lit(k)).alias(f"l{k}") for k in range(7))).first()
    assert tuple(row) == (0, 0, 3, 6, 7, 7, 7)


# ---- admission and workspace ----------------------------------------------------------------


def test_clamp(spark):
    rows = [(1, "a", "s", 1, 500.0), (1, "b", "s", 2, 100.0), (2, "a", "s", 1, 40.0), (2, "b", "s", 2, None), (2, "c", "s", 3, 20.0), (2, "d", "s", 4, 20.0), (2, "e", "s", 5, 1.0), (2, "f", "t", 6, 20.0), (2, "g", "u", 7, 5.0), (2, "h", "v", 8, 0.0)]
    got = {(r["query_id"], r["id"]): r["disposition"] for r in admission.clamp(spark.createDataFrame(rows, "query_id long, id string, source string, rank int, tokens double"), 100).collect()}
    assert got == {(1, "a"): "admitted", (1, "b"): "clamped", (2, "a"): "admitted", (2, "b"): "content_miss", (2, "c"): "admitted", (2, "d"): "admitted", (2, "e"): "duplicate_source", (2, "f"): "admitted", (2, "g"): "clamped", (2, "h"): "budget_full"}


def test_scheduler_remembers(spark):
    rows = [(1, 1, "candidate", 1, "a", 60, 0.9), (1, 1, "candidate", 2, "b", 60, 0.8), (1, 1, "candidate", 3, "c", 30, 0.75), (1, 1, "candidate", 4, "d", 5, 0.6), (1, 2, "loaded", 1, "a", 60, None), (1, 2, "loaded", 2, "c", 30, None), (1, 2, "candidate", 3, "a", 60, 0.3), (1, 2, "candidate", 4, "b", 60, 0.8), (1, 3, "loaded", 1, "new", 10, None)]
    df = spark.createDataFrame(rows, "session long, call int, role string, pos int, id string, tokens long, score double")
    got = {(r["call"], r["id"]): r["decision"] for r in admission.schedule(df, 100, Thresholds()).collect()}
    assert got == {(1, "a"): "admitted", (1, "c"): "admitted", (2, "c"): "keep", (2, "b"): "admitted", (2, "a"): "evicted", (3, "new"): "keep"}


def test_load_fragments(spark):
    rows = [(1, 1, "a", "s", 40, 0.9, 0.5, False, False), (1, 2, "b", "s", 10, 0.6, None, False, False), (1, 3, "c", "h", 30, 0.9, None, True, False), (1, 4, "d", "s", 10, 0.9, None, False, False), (1, 5, "e", "s", 10, 0.9, None, False, False), (1, 6, "f", "s", 10, 0.9, None, False, False), (1, 7, "g", "s", 10, 0.9, None, False, True), (1, 8, "h", "t", 99, 0.9, None, False, False)]
    df = spark.createDataFrame(rows, "session long, pos int, id string, source string, tokens long, score double, resident double, history boolean, exempt boolean")
    got = {r["id"]: r["outcome"] for r in admission.load_fragments(df, 100).collect()}
    assert got == {"a": "raised", "b": "below_load", "c": "history_cap", "d": "loaded", "e": "loaded", "f": "source_cap", "g": "loaded", "h": "too_large"}


def test_evictions_are_the_loop(spark):
    rng = random.Random(2)
    rows = [(s, f"{s}-{i}", rng.randint(1, 50), rng.choice([0.1, 0.5, 0.6, 0.9]), rng.randint(0, 3)) for s in range(12) for i in range(rng.randint(1, 12))]
    df = spark.createDataFrame(rows, "session long, id string, tokens long, score double, mtime long")
    for latest in (False, True):
        got = {r["id"]: r["evicted"] for r in admission.evictions(df, 120, latest_only=latest).collect()}
        for s in range(12):
            own = sorted((r for r in rows if r[0] == s), key=lambda r: (r[3], r[4] if latest else 0, r[1]))
            total, going = sum(r[2] for r in own), True
            for r in own:
                going = going and (r[3] < 0.55 or total > 120)
                assert got[r[1]] == going
                total -= r[2] if going else 0


def test_probe_rate_boundaries(spark):
    rows = [(1, 0, 1), (1, 0, 2), (1, 60, 3), (1, 61, 4), (1, 61, 5)]
    got = workspace.probe_rate(spark.createDataFrame(rows, "user_id long, seconds long, event_id long"), limit=3).orderBy("event_id").collect()
    assert [(r["in_window"], r["throttled"]) for r in got] == [(1, False), (2, False), (3, True), (2, False), (3, True)]


def test_health():
    state = dict(workspace.START)
    said = []
    for ok, ms in [(True, 1), (True, 9999)] + [(True, 1)] * 5 + [(False, 1)] * 12 + [(True, 1)] * 10:
        state = workspace.health_step(state, ok, ms)
        said.append(state["health"])
    assert said[:7] == ["Healthy"] + ["Degraded"] * 5 + ["Healthy"]
    assert "Down" in said and said[-6:] == ["Degraded"] * 5 + ["Healthy"]


def test_turn_loop(spark):
    corpus = spark.createDataFrame([("a", "s1", 30, 0.9, "alpha"), ("b", "s2", 250, 0.8, "beta"), ("c", "s3", 900, 0.8, "gamma")], "id string, source string, tokens long, score double, content string")
    asked = []

    def retrieve(texts):
        asked.append(texts)
        return corpus.where(F.col("content").isin([w for x in texts for w in x.split()]))

    model = ports.Replay(["<probe>beta</probe> short", "a much longer answer from beta", "end"])
    out = workspace.run_turn("alpha", retrieve, model, budget=500, recall=Recall(decay=0.95))
    assert out["answer"] == "a much longer answer from beta" and out["loaded"] == ["a", "b"] and asked == [["alpha"], ["beta"]]
    assert model.calls[1][1] == ["a", "b"] and TokenBudget(100, 60, 70).workspace == 0


# ---- curation, provenance, rendering --------------------------------------------------------


def test_curation(spark):
    turns = [(1, i, "user" if i % 2 else "tool", ("First here. It was fixed! Nothing. Last one." if i < 4 else "line\n" * 700), "grep", i == 5) for i in range(6)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, content string, tool_name string, inline_required boolean")
    row = curation.curate(df, 100).first()
    assert row["summary"].split("\n")[:3] == ["[Tool: grep] First here", "  - It was fixed", "  ... Last one"] and (row["retained"], row["compressed"]) == (3, 1)
    assert row["tokens_saved"] == row["tokens_before"] - row["tokens_after"] > 0
    cut = spark.createDataFrame([("One two. Three four. Five",)], "x string").select(curation.truncate_to_budget(F.col("x"), 4).alias("a"), curation.truncate_to_budget(F.col("x"), 5).alias("b"), curation.truncate_to_budget(F.col("x"), 1).alias("c")).first()
    assert tuple(cut["a"]) == ("One two. Three four.", 1) and tuple(cut["b"]) == ("One two. Three four. Five", 0) and tuple(cut["c"]) == ("", 5)


def test_topic_overlaps_equal_all_pairs(spark):
    rng = random.Random(4)
    sets = {i: rng.sample([f"t{k}" for k in range(30)], rng.randint(1, 8)) for i in range(40)}
    terms = spark.createDataFrame([(i, t) for i, s in sets.items() for t in s], "id long, term string")
    sources = spark.createDataFrame([(i, f"s{i % 4}") for i in sets], "id long, source string")
    got = {(r["id_a"], r["id_b"]): (r["shared"], r["overlap"]) for r in provenance.topic_overlaps(terms, sources).collect()}
    want = {}
    for a in sets:
        for b in sets:
            shared = sorted(set(sets[a]) & set(sets[b]))
            if a < b and a % 4 != b % 4 and round(len(shared) / min(len(sets[a]), len(sets[b])), 6) > 0.3:
                want[(a, b)] = (shared, round(len(shared) / min(len(sets[a]), len(sets[b])), 6))
    assert got == want


def test_topic_overlaps_by_blocks_shuffle_no_pairs(spark):
    rng = random.Random(5)
    sets = {i: rng.sample([f"t{k}" for k in range(60)], rng.randint(1, 45 if i % 9 == 0 else 8)) for i in range(120)}
    of = [(i, f"s{i % 3}") for i in sets] + [(7, "s0"), (8, "s9")] + [(200, None), (201, "s1")]
    sets |= {200: sets[7], 201: sets[7]}
    terms = spark.createDataFrame([(i, t) for i, s in sets.items() for t in s], "id long, term string")
    sources = spark.createDataFrame(of, "id long, source string")
    names = ("id_a", "id_b", "source_a", "source_b", "copies_a", "copies_b", "shared", "overlap")
    rows = {}
    for i, s in of:
        rows.setdefault((s, tuple(sorted(sets[i]))), []).append(i)
    classes = [(min(ids), s, len(ids), set(t)) for (s, t), ids in rows.items()]
    met = {(a[0], b[0]) for a in classes for b in classes if a[0] < b[0] and a[1] and b[1] and a[1] != b[1]}
    want = set()
    for a in classes:
        for b in classes:
            shared = sorted(a[3] & b[3])
            if (a[0], b[0]) in met and round(len(shared) / min(len(a[3]), len(b[3])), 6) > 0.3 and a[1] and b[1]:
                want.add((a[0], b[0], a[1], b[1], a[2], b[2], tuple(shared), round(len(shared) / min(len(a[3]), len(b[3])), 6)))
    for blocks in (1, 3, 9):
        found = provenance.topic_overlaps(terms, sources, blocks=blocks)
        got = [tuple(tuple(r[c]) if c == "shared" else r[c] for c in names) for r in found.collect()]
        assert len(got) == len(set(got)) and {r for r in got if r[2] and r[3]} == want
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange") == 1  # the classes alone, no pairs


def test_topic_overlaps_tell_equal_texts_side_by_side(spark):
    rng = random.Random(6)
    sets = {i: rng.sample([f"t{k}" for k in range(45)], 40) for i in range(20)}  # more than 32 terms: two words of bits
    sets |= {i: rng.sample([f"t{k}" for k in range(12)], 8) for i in range(20, 420)}
    terms = spark.createDataFrame([(i, t) for i, s in sets.items() for t in s], "id long, term string")
    sources = spark.createDataFrame([(i, f"s{i % 4}") for i in sets], "id long, source string")
    found = provenance.topic_overlaps(terms, sources, joint=",", blocks=1)
    rows = [(r["id_a"], r["shared"]) for r in found.collect()]
    assert rows and 1 + sum(x != y for x, y in zip(rows, rows[1:])) == len(set(rows))


def test_rendering(spark):
    f = spark.createDataFrame([(1, 1, "a", "x.md", "full", "one"), (1, 2, "__candidates__", "search-candidates", "file-list", "two")], "session long, pos int, stub_id string, source string, locator string, content string")
    text = render.workspace_text(f, F.array(F.lit("Be brief."), F.lit("")), xml=False).first()["text"]
    assert text.endswith("- Be brief.\n\n[recalled from x.md]\none\n[end recall]\n\n[recalled from search-candidates:file-list]\ntwo\n[end recall]") and render.CANDIDATES in text
    prompts = spark.createDataFrame([(1, "see [doc](a/b.md) and @c.rs and @zzz")], "query_id long, text string")
    known = spark.createDataFrame([("a/b.md", "s1", "sum"), ("c.rs", "s2", "two")], "path string, id string, summary string")
    assert render.transformed_prompts(prompts, known).first()["text"] == 'see <file id="s1" path="a/b.md">sum</file> and <file id="s2" path="c.rs">two</file> and @zzz'


# ---- sources --------------------------------------------------------------------------------


def test_records(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"system_prompt": "a", "result": "b"}\nbroken\n{"result": "c"}\n\n')
    good, counts = records.read_trace(spark, str(tmp_path / "t.jsonl"))
    assert [tuple(r) for r in good.collect()] == [("a", "b")] and tuple(counts.first()) == (1, 2)
    (tmp_path / "q.json").write_text('[{"id": "1", "question": "x", "needle": "n", "expected_paths": ["a"]}, {"id": "2", "question": "y", "needle": "n", "reference_answer": "r"}]')
    got = {r["id"]: (r["valid"], [tuple(g) for g in r["gold"] or []]) for r in records.read_questions(spark, str(tmp_path / "q.json")).collect()}
    assert got == {"1": (True, [("a", None)]), "2": (False, [])}
    (tmp_path / "w.json").write_text('{"questions": [{"id": "3", "type": "t", "question": "x", "reference_answer": "r", "expected": [{"path": "p", "line": 4}]}]}')
    row = records.read_questions(spark, str(tmp_path / "w.json")).first()
    assert row["valid"] and [tuple(g) for g in row["gold"]] == [("p", 4)]
    (tmp_path / "g.json").write_text('{"nodes": [{"id": "n", "source_file": "a.rs", "source_location": "L20"}, {"id": "m", "source_file": "b.rs"}], "edges": [{"source": "n", "target": "m", "relation": "calls", "confidence": "high", "weight": 0.5}]}')
    nodes, edges = records.read_graph(spark, str(tmp_path / "g.json"))
    assert sorted(map(tuple, nodes.collect())) == [("m", "b.rs", 0), ("n", "a.rs", 20)] and edges.count() == 1
    e = spark.createDataFrame([("s", 5, "b"), ("s", 3, "a")], "session string, at_ms long, what string")
    records.write_trace(e, str(tmp_path / "trace"))
    assert sorted((r["t_ms"], r["seq"], r["what"]) for r in spark.read.json(str(tmp_path / "trace")).collect()) == [(0, 0, "a"), (2, 1, "b")]
    assert '"n": 1' in records.write_report(spark.createDataFrame([(1,)], "n long"), str(tmp_path / "r.json"))
    lines = spark.createDataFrame([("s", 0, '{"type":"user","message":{"role":"user","content":"hi"}}', 4), ("s", 1, '{"type":"assistant","message":{"role":"assistant","content":[{"type":"thinking","thinking":"hm"},{"type":"text","text":"yo"},{"type":"tool_use"}]}}', 4), ("s", 2, "bad", 9)], "session string, n long, line string, mtime long")
    doc = records.transcript_documents(lines).first()
    assert doc["content"] == "## User\n\nhi\n\n## Assistant\n\nhm\n\nyo" and doc["path"] == "sessions/s.md"


def test_sampling(spark):
    g = sampling.Generator(1)
    assert [g.next() for _ in range(2)] == [(6364136223846793005 + 1442695040888963407) % 2**64, ((6364136223846793005 + 1442695040888963407) * 6364136223846793005 + 1442695040888963407) % 2**64]
    hay = sampling.haystack(10, 3, "NEEDLE", 99)
    assert hay[-1] == "NEEDLE" and len(hay) == 11 and hay[:10] == sampling.haystack(10, 3, "X", 0)[1:]
    docs = sampling.haystack_documents(spark, [("i1", "n1", 1, 2), ("i2", "n2", 2, 0)], 5)
    assert docs.count() == 12 and docs.where("is_needle").count() == 2
    f = spark.createDataFrame([(f"d/{'README' if i % 10 == 0 else 'x'}{i}.md", i) for i in range(500)], "path string, mtime long")
    got = [r["path"] for r in sampling.weighted_sample(f, 60, "s", newer_than=100).collect()]
    assert len(set(got)) == 60 and sum("README" in x for x in got) > 6
    kept = sampling.curated(f, f.limit(5), 20, "s")
    assert kept.count() == 25


def test_ports(spark, tmp_path):
    embed = ports.hash_embedder(16)
    a = embed(["the cat", "the cat", ""])
    assert np.allclose(a[0], a[1]) and np.isclose(np.linalg.norm(a[0]), 1) and not a[2].any()
    rows = spark.createDataFrame([(i, "w " * (i % 7)) for i in range(30)], "id long, embed_text string")
    made = {r["id"]: r["embedding"] for r in ports.embedded(rows, lambda: ports.hash_embedder(16)).collect()}
    assert np.allclose(made[3], embed(["w w w "])[0])
    groups = list(ports.micro_batches(["x" * n for n in (5, 1, 3, 50)], most_chars=12))
    assert sorted(k for g in groups for k in g) == [0, 1, 2, 3] and groups[0] == [1, 2, 0][: len(groups[0])]

    def make():
        def model(p):
            if p == "bad":
                raise RuntimeError
            return p.upper()

        return model

    said = ports.completed(spark.createDataFrame([("a",), ("bad",)], "p string"), make, "p", "out", F.lit("fallback"))
    assert {r["p"]: r["out"] for r in said.collect()} == {"a": "A", "bad": "fallback"}
    log = tmp_path / "log"
    with pytest.raises(ZeroDivisionError):
        ports.traced(lambda p: 1 / 0, str(log))("x")
    assert ports.traced(lambda p: "y", str(log))("x") == "y" and [x.split('"')[3] for x in log.read_text().splitlines()] == ["llm_request", "llm_error", "llm_request", "llm_response"]
    assert ports.retried(ports.Replay(["bad", "bad", "ok"]), lambda a: a == "bad")("q") == ("ok", True)


# ---- evaluation -----------------------------------------------------------------------------


def test_metrics_edges(spark):
    retrieved = hits(spark, [(1, "a", 1.0, 1), (1, "b", 0.9, 2), (1, "a", 0.8, 3)])
    expected = spark.createDataFrame([(1, "a"), (1, "z"), (2, "q")], "query_id long, id string")
    got = {r["query_id"]: (r["hits"], r["recall"], r["precision"]) for r in evaluation.recall_precision(retrieved, expected, 3).collect()}
    assert got == {1: (2, 1.0, pytest.approx(2 / 3)), 2: (0, 0.0, 1.0)}
    assert evaluation.recall_precision(retrieved, expected.limit(0), 3).first()["recall"] == 1.0
    one = spark.createDataFrame([("i", "on", 2.0), ("i", "off", 1.0), ("j", "on", 5.0)], "item string, mode string, m double")
    row = evaluation.paired_deltas(one, ["m"], "on", "off").first()
    assert tuple(row) == ("m", 1, 1.0, 0.0, 0.0, 1, 0, 0)


def test_thrashing(spark):
    rows = [(1, "a", 1, "load"), (1, "a", 4, "evict"), (1, "a", 9, "load"), (1, "a", 10, "evict"), (1, "a", 16, "load"), (1, "b", 2, "evict")]
    each, sums = evaluation.thrashing(spark.createDataFrame(rows, "session long, id string, step long, kind string"))
    assert sorted((r["id"], r["step"], r["held"], r["thrashed"]) for r in each.collect()) == [("a", 4, 3, True), ("a", 10, 1, False), ("b", 2, None, False)]
    s = sums.first()
    assert (s["evictions"], s["thrashed"], s["avg_held"], round(s["suggest_load"], 2), round(s["suggest_unload"], 2)) == (3, 1, 2.0, 0.75, 0.5)


def test_whitening(spark):
    rng = np.random.default_rng(3)
    data = rng.standard_normal((200, 6)) @ rng.standard_normal((6, 6)) + 2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, vector array<double>")
    got = np.array([r["vector"] for r in evaluation.whitened(df, 2).orderBy("id").collect()])
    m = data - data.mean(axis=0)
    top = np.linalg.svd(m, full_matrices=False)[2][:2]
    want = m - m @ top.T @ top
    assert np.allclose(got, want / np.linalg.norm(want, axis=1, keepdims=True), atol=1e-6)


def test_model_choice(spark):
    runs = spark.createDataFrame([("a", 0.5, 1.0, None, 0.0), ("a", 1.0, 0.5, None, 0.2), ("b", None, None, 0.9, None), ("b", None, None, 0.5, None)], "model string, precision double, recall double, score double, parse_failure double")
    got = {r["model"]: r["quality"] for r in evaluation.model_selection(runs).collect()}
    f = lambda p, r: 1.25 * p * r / (0.25 * p + r)
    assert got == {"a": pytest.approx((f(0.5, 1) + f(1, 0.5)) / 2 * 0.9), "b": pytest.approx(0.6 * 0.7 + 0.4 * 0.5)}
    grid = evaluation.parameter_grid([("x", spark.createDataFrame([(1,)], "value long")), ("x", spark.createDataFrame([(2,), (3,)], "value long")), ("y", spark.createDataFrame([("p",)], "value string"))])
    assert grid.count() == 2 and evaluation.parameter_grid([("x", spark.createDataFrame([(2,)], "value long"))], grid).count() == 1


# ---- streaming ------------------------------------------------------------------------------


def test_streams(spark, tmp_path):
    calls = [("c", i, i % 3 > 0, 10.0) for i in range(30)]
    spark.createDataFrame(calls, "component string, seq long, ok boolean, latency_ms double").coalesce(1).write.parquet(str(tmp_path / "calls"))
    stream = spark.readStream.schema("component string, seq long, ok boolean, latency_ms double").parquet(str(tmp_path / "calls"))
    jobs.health_stream(stream).writeStream.outputMode("update").format("memory").queryName("health").trigger(availableNow=True).start().awaitTermination()
    want = workspace.health_history(spark.createDataFrame(calls, "component string, seq long, ok boolean, latency_ms double")).orderBy(F.desc("seq")).first()["health"]
    assert spark.table("health").first()["health"] == want
    reqs = [("a", datetime.fromisoformat("2024-01-01 00:00:00")), ("a", datetime.fromisoformat("2024-01-01 00:01:00")), ("b", datetime.fromisoformat("2024-01-01 00:02:00"))]
    spark.createDataFrame(reqs, "path string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "reqs"))
    seen = []
    queue = jobs.reindex_queue(spark.readStream.schema("path string, ts timestamp").parquet(str(tmp_path / "reqs")))
    jobs.drain(queue, lambda df, _: seen.extend(r["path"] for r in df.collect()), str(tmp_path / "ck")).awaitTermination()
    assert sorted(seen) == ["a", "b"]
