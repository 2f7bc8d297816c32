"""Near duplicates, components, nearest neighbours and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import ann, neardup
from quillspan.llm.components import connected_components


def union_find(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(300)] + [(7, 7)]
    want = union_find({n for e in edges for n in e}, edges)
    linked = {n for e in edges if e[0] != e[1] for n in e}
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: want[n] for n in linked}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


SPACE = " \t\n\r\x0b\x0c"


def plain_sets(text, size):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for s in SPACE:
        words = words.replace(s, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if len(words) >= size else frozenset([tuple(words)])


def brute(rows, size, num, den):
    sets = [plain_sets(t, size) for _, t in rows]
    edges = []
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
                both = len(sets[i] & sets[j])
                if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                    edges.append((rows[i][0], rows[j][0]))
    comp = union_find({i for i, _ in rows if i is not None}, edges)
    return sorted(((i, len(s), comp.get(i), i is None or comp[i] == i) for (i, _), s in zip(rows, sets)), key=str)


def family(rng, words, n, edits):
    base = [rng.choice(words) for _ in range(120)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("size,num", [(3, 85), (5, 80)])
def test_near_duplicates(spark, size, num):
    rng = random.Random(size)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 80))) for _ in range(150)]
    for edits in (2, 5, 9):
        texts += family(rng, words, 40, edits)
    texts += ["", None, "\n", "One Two", "one  TWO", "one", "ONE", "É a b", "é a b", "long " * 9000 + "x", "long " * 9000 + "x y"]
    rng.shuffle(texts)
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)] + [(4, texts[1]), (None, texts[2]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1))
    got = sorted((tuple(r) for r in neardup.near_duplicates(docs, size=size, num=num, den=100).collect()), key=str)
    assert got == brute(rows, size, num, 100)


def test_blocks_of_large_families(spark, monkeypatch):
    """Families of several blocks give what one block does."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    rows = list(enumerate(family(rng, words, 60, 12) + family(rng, words, 30, 7)))
    got = sorted((tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=3, num=85, den=100).collect()), key=str)
    assert got == brute(rows, 3, 85, 100)


def test_signatures_are_circulant():
    flat, counts = neardup.shingle_sets(["a b c d e f g", "", "x"], 3)
    sig = neardup.signatures(flat, counts, 16)
    ring = neardup._ring(1)[:, 0]
    at = (neardup._mixed(flat + np.uint64(neardup.SEED)) % np.uint64(neardup.RING)).astype(int)
    own = np.repeat(np.arange(3), counts)
    for k in range(16):
        for d in (0, 2):
            assert sig[d, k] == min(ring[(a + k) % neardup.RING] for a in at[own == d])
    assert (sig[1] == 2**32 - 1).all()


def test_signature_estimates_the_similarity():
    rng = random.Random(5)
    a = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    b = a[:300] + [f"v{rng.randrange(10**6)}" for _ in range(100)]
    x, y = set(zip(a, a[1:], a[2:])), set(zip(b, b[1:], b[2:]))
    flat, counts = neardup.shingle_sets([" ".join(a), " ".join(b)], 3)
    s = neardup.signatures(flat, counts, 4096)
    assert abs((s[0] == s[1]).mean() - len(x & y) / len(x | y)) < 0.03


def test_deduplicated(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(999)]
    base = family(rng, words, 1, 0)[0]
    rows = [(5, base, "a"), (2, base, "b"), (2, base, "b"), (9, base + " end", "c"), (1, "", "d"), (1, None, "e"), (None, base, "f"), (7, "all alone here with words", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    out = neardup.deduplicated(docs)
    assert out.columns == docs.columns
    assert sorted((tuple(r)[0::2] for r in out.collect()), key=str) == sorted([(2, "b"), (1, "d"), (1, "e"), (None, "f"), (7, "g")], key=str)
    assert neardup.near_duplicates(docs.limit(0)).count() == 0 and neardup.deduplicated(docs.limit(0)).count() == 0


# ---- nearest neighbours ---------------------------------------------------------------------


def plain_nearest(rows, k, ask):
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q, qv in good:
        if ask(q):
            scores = []
            for i, v in good:
                if i != q and len(v) == len(qv):
                    s = 0.0
                    for a, b in zip(v, qv):
                        s = s + a * b
                    scores.append((-s, i))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def vectors(n, size=16, seed=2):
    rng = np.random.Generator(np.random.PCG64(seed))
    data = rng.standard_normal((n, size)) + 0.3
    data[n // 2 :: 3] = data[0]  # a third of a half are one vector
    return [(i, [float(x) for x in v]) for i, v in enumerate(data)]


AWKWARD = [(1000, None), (1020, []), (1040, [0.0] * 16), (1060, [float("nan")] * 16), (1080, [float("inf")] + [1.0] * 15), (1100, [None] + [1.0] * 15), (None, [1.0] * 16), (1120, [1.0, 2.0]), (1140, [2.0, 1.0])]


def test_nearest(spark):
    rows = vectors(700) + AWKWARD
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(0))
    for blocks in ((1024, 16_384), (7, 60)):
        got = ann.nearest(table, F.col("vec_id") % 20 == 0, 20, query_block=blocks[0], vector_block=blocks[1])
        assert sorted(tuple(r) for r in got.collect()) == plain_nearest(rows, 20, lambda q: q % 20 == 0)
    assert ann.nearest(table.limit(0), F.lit(True)).count() == 0
    assert ann.nearest(table, F.lit(False)).count() == 0
    few = ann.nearest(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>"), F.col("vec_id") == 0)
    assert [(r["rank"], r["vec_id"]) for r in few.orderBy("rank").collect()] == [(r, i) for _, r, i, _ in plain_nearest(rows[:3], 20, lambda q: q == 0)]


def test_bounds_hold_and_prune():
    data = np.array([v for _, v in vectors(3000, 64, 9)])
    centre, turn = data.mean(axis=0), ann.rotation(64)
    assert np.allclose(turn.T @ turn, np.eye(64)) and turn.shape == (256, 64)
    codes, far, own = ann.encode(data, centre, turn)
    query = data[:50]
    estimate, error = ann.bounds(query, codes, far, own, centre, turn, query @ centre, 4.0)
    exact = query @ data.T
    assert (np.abs(estimate - exact) <= error).mean() > 0.999
    assert abs(((estimate - exact) / error).mean()) < 0.05
    level = np.sort(exact, axis=1)[:, -20]
    assert ((estimate + error) >= level[:, None]).mean() < 0.4


# ---- pipeline -------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from quillspan.llm import quality, secrets

    rng = random.Random(4)
    sentence = lambda i: " ".join(f"{rng.choice('abcdefgh')}{i}{k}" for k in range(70)) + "."
    clean = [sentence(i) for i in range(60)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(clean)]
    rows += [(100, clean[3], "en", "s0", len(clean[3])), (101, clean[4] + " more", "en", "s1", 9), (102, "a | b | c | d\n" * 40, "en", "s0", 1), (103, "short", "en", "s0", 5), (104, None, "en", None, None)]
    rows += [(105, sentence(200) + " token=abcdef0123456789 end.", "en", "s2", 7)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "secret_scan", "source_mix", "piece_ids"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(corpus_pipeline.stored(stage(spark, steps[-1], str(tmp_path)), "t"))
    for step in steps[1:-1]:
        assert step.columns == docs.columns
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    kept = {i for i, t in text.items() if quality.judged(t)["kept"]}
    assert {r["doc_id"] for r in steps[1].collect()} == kept and set(range(60)) <= kept and not kept & {102, 103, 104}
    left = {r["doc_id"] for r in steps[2].collect()}
    assert left == kept - {100, 101}
    after = {r["doc_id"]: r["text"] for r in steps[3].collect()}
    assert set(after) == left and "[SECRET]" in after[105] and all(after[i] == secrets.redact(text[i]) for i in left)
    mixed = [r["doc_id"] for r in steps[4].collect()]
    assert set(mixed) <= left and max(map(mixed.count, set(mixed))) <= 3
    assert sorted(r["doc_id"] for r in steps[5].collect()) == sorted(mixed)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(mixed)


def test_rows_that_share_an_id(spark):
    """Of an id that is kept: a row for each text, the same one in every run; other ids as ever."""
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long, "b"), (1, long, "a"), (1, "quite another text of a few words here", "c"), (2, long + " more", "d"), (3, "", "e"), (3, "", "e"), (None, long, "f"), (4, None, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    first, second = (sorted(map(str, neardup.deduplicated(d).collect())) for d in (docs, docs.repartition(5).orderBy(F.desc("fp"))))
    assert first == second and len(first) == 6
    kept = neardup.deduplicated(docs).where("doc_id = 1").collect()
    assert {r["text"] for r in kept} == {long, rows[2][1]}
    assert neardup.deduplicated(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        neardup.deduplicated(docs.withColumnRenamed("fp", "__nd_id"))


def test_hot_buckets_are_dealt_into_parts(spark, monkeypatch):
    """A bucket of many members, dealt into parts of two, gives what one part does; working tables go."""
    from quillspan.llm import common

    monkeypatch.setattr(neardup, "BLOCK", 2)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    rows = list(enumerate(family(rng, words, 40, 9) + family(rng, words, 20, 14)))
    got = sorted((tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=3, num=85, den=100).collect()), key=str)
    assert got == brute(rows, 3, 85, 100)
    folder = common.shared_dir(spark).removeprefix("file://")
    assert not [p for p in __import__("os").listdir(folder) if p.split("-")[0] in ("buckets", "links", "rest", "sets")]
