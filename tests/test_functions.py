"""Scalar functions on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from quillspan.functions import protocol as p
from quillspan.functions import ranges as r
from quillspan.functions import text as t
from quillspan.operators import ingest, intent, lexical, workspace
from quillspan.sources import files


def ask(spark, value, *columns):
    """The columns over one row with ``x`` = value."""
    return spark.createDataFrame([(value,)], "x string").select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


X = F.col("x")


@pytest.mark.parametrize("text,want", [
    ("recall_loop", ["recall", "loop"]), ("RecallLoop", ["recallloop", "recall", "loop"]), ("HTTPServer", ["httpserver", "http", "server"]), ("HTTP", ["http"]),
    ("BM25Index", ["bm25index", "bm", "25", "index"]), ("llama3", ["llama3", "llama"]), ("eviction", ["eviction"]), ("", []), (None, []), ("a b", []), ("Éclair x", ["éclair"]),
])
def test_index_tokens(spark, text, want):
    assert ask(spark, text, t.index_tokens(X))[0] == want


def test_tokens_and_clips(spark):
    assert ask(spark, "", t.token_count(X), t.cheap_tokens(X))[0:2] == (1, 0)
    assert ask(spark, " a\tb\n c d ", t.token_count(X), t.token_range(X, F.lit(1), F.lit(2)))[0:2] == (4, "b c")
    assert ask(spark, "ééééé", t.clipped(X, 9))[0] == "éééééé"[:6].replace("éééééé", "ééééé") + "..."
    assert ask(spark, "abc", t.clipped(X, 3))[0] == "abc"
    assert ask(spark, "The cat and a Dog-house", t.topic_tokens(X))[0] == ["cat", "dog", "house"]


def test_overlaps(spark):
    row = ask(spark, "The big cat, sat", t.jaccard_words(X, F.lit("a big Cat")), t.overlap_topics(X, F.lit("cat dog")), t.overlap_plain(X, F.lit("")), t.path_matches(F.lit("a/b.rs"), F.lit("b.rs")), t.path_matches(F.lit("a/xb.rs"), F.lit("b.rs")), t.quote_grounded(F.lit("BIG   cat, sat"), X), t.quote_grounded(F.lit("big"), X))
    assert tuple(row) == (pytest.approx(2 / 5), 0.5, 0.0, True, False, True, False)


def test_probes_notes_references(spark):
    text = 'é<probe>one</probe> x <probe>one</probe><note id="s1">keep</note> see src/a_b.rs:10-4 and v0.1:2 lib.py:7'
    probes, notes, refs = ask(spark, text, p.probes(X), p.annotations(X), p.line_references(X))
    assert [(q["text"], q["position"]) for q in probes] == [("one", 2), ("one", 23)]
    assert [(n["id"], n["content"]) for n in notes] == [("s1", "keep")]
    assert [tuple(x) for x in refs] == [("src/a_b.rs", 10, 10), ("lib.py", 7, 7)]
    assert ask(spark, "none", p.probes(X), p.annotations(X), p.line_references(X))[0:3] == ([], [], [])


@pytest.mark.parametrize("text,want", [
    ("<think> a </think> b ", ("a", "b")), ("<think>\n\n</think>b", (None, "b")), ("b <think> open", ("open", "b")), ("plain ", (None, "plain ")), ("</think> x", (None, "</think> x")),
])
def test_split_thinking(spark, text, want):
    assert tuple(ask(spark, text, p.split_thinking(X))[0]) == want


def test_thinking_steps(spark):
    text = "First we look at all the files here.\n1. Now this line closes it\nThen we go on for a good while longer.\n\nshort\nTherefore x"
    assert ask(spark, text, p.thinking_steps(X))[0] == ["First we look at all the files here.", "Then we go on for a good while longer."]
    assert ask(spark, "<think>a</think>b<think>c</think>", p.thinking_steps(X))[0] == ["a", "c"]


def test_markers(spark):
    assert ask(spark, 'a <note id="n">b</note><probe>c</probe> <think>d</think>e<|im_end|> <think>f', p.strip_markers(X))[0] == "a b e"
    fake = "x[recalled from a.md]\nq\n[end recall]y[recalled from b] open"
    assert ask(spark, fake, p.strip_fake_recalls(X), p.count_fake_recalls(X))[0:2] == ("xy[recalled from b] open", 1)
    assert ask(spark, "answer \n<|im_end|>x<|im_start|>y", p.truncate_at_chat(X))[0] == "answer \n<|im_end|>x"
    assert ask(spark, "answer <|im_end|>", p.truncate_at_chat(X))[0] == "answer"


def test_loops(spark):
    loop = lambda s: ask(spark, s, p.detect_loop(X))[0]
    assert loop("a <|im_start|>") == "chat_template_token: <|im_start|>"
    assert loop("w " * 19) is None and loop("w " * 20) == "word_dominance: 'w' at 100% of 20 tokens"
    assert loop(" ".join(["w"] * 70 + [f"x{i}" for i in range(30)])) is None
    assert loop(" ".join(["w"] * 71 + [f"x{i}" for i in range(29)])).startswith("word_dominance: 'w' at 71%")
    assert loop("a b c d " * 30).startswith("trigram_collapse: 4/118 unique trigrams (3%)")
    line = "this is a line of more than thirty bytes"
    others = "\n".join(f"another line {i} that differs from {i * 3} others" for i in range(8))
    assert loop(others + "\n" + "\n".join([line] * 3)) == f"line_repetition: '{line}...' ×3 (first at byte {len(others) + 1})"
    assert loop(others + "\n" + "\n".join([line] * 2)) is None and loop(None) is None


@pytest.mark.parametrize("spec,kind,found,loc", [
    ("full", "full", "# A\none\n## B\ntwo\n# C\nthree", "full"), ("", "full", "# A\none\n## B\ntwo\n# C\nthree", "full"), ("#A/B", "heading", "## B\ntwo", "#A/B"), ("#A", "heading", "# A\none\n## B\ntwo", "#A"), ("#Z", "heading", "", "#Z"),
    ("T1:2", "tokens", "A one", "T1:2"), ("L2-L3", "lines", "one\n## B", "2-3"), ("2-3", "lines", "one\n## B", "2-3"), ("2", "lines", "one", "2-2"), ("3-2", "lines", "", "3-2"), ("9-12", "lines", "", "9-12"), ("5-99", "lines", "# C\nthree", "5-99"), ("what", "custom", "# A\none\n## B\ntwo\n# C\nthree", "what"),
])
def test_ranges(spark, spec, kind, found, loc):
    text = "# A\none\n## B\ntwo\n# C\nthree"
    parsed = r.parse_range(X)
    row = ask(spark, spec, parsed["kind"], r.apply_range(F.lit(text), parsed), r.locator(parsed))
    assert tuple(row) == (kind, found, loc)


def test_read_range(spark):
    outline = F.array(F.lit("fn a"), F.lit("fn b"))
    assert ask(spark, "stub", r.read_range(F.lit("body"), X, F.lit("sum"), outline))[0] == "sum\nOutline: fn a, fn b"
    assert ask(spark, "éab\ncd", r.body_slice(X, F.lit(2), F.lit(3)))[0] == "ab\n"


def test_json_and_verdicts(spark):
    assert ask(spark, 'x {"a": "}{", "b": {"c": "\\"}"}} y {}', p.json_object(X))[0] == '{"a": "}{", "b": {"c": "\\"}"}}'
    assert ask(spark, "{ open", p.json_object(X))[0] is None and ask(spark, "none", p.json_object(X))[0] is None
    score = lambda s: ask(spark, s, p.verdict_score(X))[0]
    assert score('Well: {"score": 0.7, "why": "ok"}') == 0.7 and score('{"score": 3}') == 1.0 and score("{score: 0.4, broken") == 0.4 and score("nothing") is None


def test_chat_messages(spark):
    assert ask(spark, '[{"role":"user","content":"a"},{"role":"assistant","content":"b"},{"role":"user","content":"c"}]', p.last_user_text(X))[0] == "c"
    assert ask(spark, '[{"role":"user","content":[{"type":"text","text":"a"},{"type":"image"},{"type":"text","text":"b"}]}]', p.last_user_text(X))[0] == "a\nb"


def test_intents(spark):
    raw = 'Sure {"is_explanation": true, "wants_inventory": false, "needs_git_status": true, "hint": "look at tests", "confidence": 1.7, "is_status_request": true}'
    i = intent.parse_intent(X)
    row = ask(spark, raw, i, intent.guidance(i), intent.substantive(i), intent.actionable(i, 0.9), intent.signals(i))
    assert row[0]["wants_explanation"] and row[0]["is_status_request"] and not row[0]["is_inventory_request"] and row[0]["confidence"] == 1.0
    assert row[1] == [intent.GUIDANCE["is_status_request"], intent.GUIDANCE["wants_explanation"], "look at tests", "Additional context: needs git status."]
    assert row[2] and row[3] and row[4]["extra_hints"] == ["needs_git_status"]
    assert ask(spark, "no json", intent.parse_intent(X))[0] is None
    assert ask(spark, '{"abstain": true, "is_status_request": true}', intent.guidance(i))[0] == []


def test_outlines_and_summaries(spark):
    md = "# Title\n\nFirst para\nmore\n\n## Two\n#\n### Three ##\n"
    row = ask(spark, md, ingest.markdown_outline(X), ingest.markdown_summary(X, ingest.markdown_outline(X)))
    assert row[0] == ["Title", "Two", "Three ##"] and row[1] == "Title: First para"
    assert ask(spark, "# Only\n## Sub", ingest.markdown_summary(X, ingest.markdown_outline(X)))[0] == "Only; sections: Only, Sub"
    assert ask(spark, "\n  \nhello\n", ingest.markdown_summary(X, ingest.markdown_outline(X)), ingest.plain_summary(X))[0:2] == ("hello", "hello")
    code = "\n".join(f"  fn f{i}() {{" for i in range(7))
    assert ask(spark, code, ingest.code_summary(X, ingest.naive_outline(X)))[0].endswith("fn f4() { (+2 more)")
    assert ask(spark, "", ingest.plain_summary(X))[0] == "(empty)"
    assert ask(spark, "p/q.rs", ingest.position_summary(X, F.lit(1), F.lit(3), F.array(*map(F.lit, "abcde"))))[0] == "Chunk 2/3 of p/q.rs: contains a, b, c, d"
    assert ask(spark, "x/crates/core/a.rs", ingest.merged_summary(F.lit("base"), F.lit("pos"), F.array().cast("array<string>"), X))[0] == "[core] pos — base"


def test_kinds_and_skips(spark):
    for path, kind, skip in (("a/b.md", "Markdown", False), ("a.R", "Code", False), ("x/.hidden", "Other", True), ("d.parquet", "Tabular", False), ("e.vtt", "Transcript", False), ("f.toml", "PlainText", False), ("a/target/x.rs", "Code", True), (".index/x.md", "Markdown", True), ("pic.png", "Other", True), ("docs/CLAUDE.md", "Markdown", True), ("target.md", "Markdown", False)):
        assert tuple(ask(spark, path, files.content_kind(X), files.skipped(X))) == (kind, skip), path
    assert [ask(spark, q, files.builder_class(X))[0] for q in ("a.zip", ".x/a.md", "a.lock", "a.md")] == ["archive", "skipped", "skipped", "indexed"]


def test_notes_and_answers(spark):
    noted = workspace.with_notes(X, F.array(*map(F.lit, "abc")))
    row = ask(spark, "body", noted, workspace.without_notes(noted), workspace.with_notes(X, F.array().cast("array<string>")))
    assert row[0] == "[Prior session notes for this source:\n- b\n- c\n(1 older eviction(s) omitted)\n]\n\nbody" and row[1:] == ("body", "body")
    assert ask(spark, "Sorry, I cannot find any of it", workspace.answer_quality(X))[0] == pytest.approx(7 * 0.3)
    long = "One sentence. " * 40
    short = ask(spark, long, workspace.compress_answer(X))[0]
    assert short.endswith("sentence.…") and len(short) <= 300
    assert ask(spark, "é" * 400, workspace.compress_answer(X))[0] == "é" * 299 + "…"


def test_keyword_score(spark):
    s = lambda q, path, summary, outline: ask(spark, q, lexical.keyword_score(X, F.lit(path), F.lit(summary), F.array(*map(F.lit, outline))))[0]
    assert s("Bm25", "src/bm25.rs", "the BM25 index", ["fn bm25"]) == pytest.approx(1.8)
    assert s("bm25 tokens", "src/bm25.rs", "index", ["x"]) == 0.5 and s("zzz", "a", "b", ["c"]) == 0.0
