"""Operators over texts against plain versions, with the awkward rows each must bear."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from quillspan.llm import licenses, mixing, pieces, quality, secrets, token_binary

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
LONG = "the quick brown fox. " * 6000
AWKWARD = [None, "", " ", "\n\n", "a", LONG, "x" * 5000, " " * 3000 + "a", "é日本😀\x00\x1c", "the cat sat.\n" * 3, "MIT License mit\nlicense, MIT-License", "Ünïcödé ſ K token = 'abcdef'"]


def random_texts(n, seed=3):
    rng = random.Random(seed)
    alphabet = list("aabcdeeilnorst   \n\t.,'12#$|") + ["é", "ß", "日", "😀", "the ", "ing", "  ", "\n\n", "<s>", "<|endoftext|>", "▁", "　"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(n)]


def table(spark, texts, **more):
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    table(spark, AWKWARD + AWKWARD[4:6] + random_texts(60)).withColumn("w", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1)).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    table(spark, []).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def rows(df, key="doc_id"):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r[key] is not None, r[key]))


def texts_of(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


# ---- sentencepiece --------------------------------------------------------------------------


def test_pieces_equal_the_library():
    model = P.path("piece_bpe_32k.model")
    texts = [t for t in AWKWARD if t] + random_texts(3000) + ["a" * 500, "ab" * 400, "=-" * 300, " " * 400 + "a" + " " * 90, "aaab" * 99]
    sp = pieces._model(model)[0].sp
    for text, got, want in zip(texts, pieces.encode_texts(model, texts), sp.encode(texts)):
        assert got.tolist() == want, text[:50]
        assert pieces.decode_ids(model, want) == sp.decode(want)


def test_heap_path_agrees_with_rounds():
    model = pieces.PieceModel(P.path("piece_bpe_32k.model"))
    unit = "▁" * 200
    ids, counts = model.encode_units([" " * 200])
    assert ids.tolist() == model.sp.encode(unit)[: len(ids)] or counts.tolist() == [len(ids)]
    symbols = [model.symbols[c] for c in "▁" * 200]
    kept, merged = model._heap(symbols)
    assert model.piece_id[merged].tolist() == ids.tolist()


def test_op6(spark, sf, empty):
    sp = pieces._model(P.path("piece_bpe_32k.model"))[0].sp
    texts = texts_of(spark, sf)
    found = rows(pieces.op6_sentencepiece(spark, sf))
    assert len(found) == len(texts)
    for r in found:
        ids = sp.encode(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert pieces.op6_sentencepiece(spark, empty).count() == 0


def test_encode_pieces_keeps_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = pieces.encode_pieces(docs, P.path("piece_bpe_32k.model"))
    assert out.columns == [*docs.columns, "piece_ids"] and out.count() == docs.count()
    with pytest.raises(ValueError):
        pieces.encode_pieces(docs.withColumnRenamed("source", "piece_ids"), P.path("piece_bpe_32k.model"))


# ---- token files ----------------------------------------------------------------------------


def library(texts, **switches):
    """The untouched library, whole texts."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for name, value in switches.items():
        setattr(t, name, value)
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


SPECIAL = ["<|endoftext|>", "a <|endoftext|> b", "mid<|endoftext|>word", "<|endoftext|><|endoftext|>", "a  <|endoftext|>\n\nb", "\n<|endoftext|>\n", "<|endoftext|", "<<|endoftext|>>", " <|endoftext|>\t x<|endoftext|>"]


@pytest.mark.parametrize("as_text", [False, True])
def test_units_encode_like_whole_texts(as_text):
    texts = [t or "" for t in AWKWARD] + SPECIAL + random_texts(3000, 5) + ["it's  a   b", "a\t\tb \n c", "\n\n x", "don't do"]
    flat, counts = token_binary.encode_texts(P.path("byte_bpe_50k.json"), texts, as_text)
    assert len(counts) == len(texts)
    for text, got, want in zip(texts, np.split(flat, np.cumsum(counts)[:-1]), library(texts, encode_special_tokens=True) if as_text else library(texts)):
        assert got.tolist() == want, text[:50]
    assert (50256 in flat) is not as_text


def test_tokens_that_reach_beside_them_take_whole_texts(tmp_path):
    from tokenizers import AddedToken, Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.add_tokens([AddedToken("[cut]", lstrip=True, rstrip=True)])
    t.save(path := f"{tmp_path}/reaching.json")
    texts = ["a  [cut]  b", "x[cut]", "", "<|endoftext|> [cut]\n", *random_texts(100, 7)]
    flat, counts = token_binary.encode_texts(path, texts)
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_op2(spark, sf, empty):
    texts = texts_of(spark, sf)
    start, want = 0, []
    for i, ids in zip(sorted(texts), library([texts[i] for i in sorted(texts)])):
        ids = [*ids, 0]
        want.append({"doc_id": i, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(np.array(ids, "<u4").tobytes())})
        start += len(ids)
    assert rows(token_binary.op2_token_binary(spark, sf)) == want
    assert token_binary.op2_token_binary(spark, empty).count() == 0


def test_token_files_random_access(spark, tmp_path):
    texts = [f"word {i} " * (i % 50) for i in range(200)]
    manifest = token_binary.write_token_files(table(spark, texts), f"file://{tmp_path}/t", P.path("byte_bpe_50k.json"), vocabulary=50_257, sequence=64, batch_sequences=4, parts=3)
    files = sorted(r["path"] for r in manifest.collect())
    assert len(files) == 3 and not list(tmp_path.rglob("*.tmp"))
    flat = [i for ids in library(texts) for i in [*ids, 0]]
    seen = []
    for f in files:
        file = token_binary.TokenFile(f)
        n = sum(file.index.get_batch(i).column(2).to_numpy().sum() for i in range(file.index.num_record_batches))
        sequences = [file.sequence_at(i) for i in range(-(-n // 64))]
        assert all(len(ids) == 64 == len(mask) for ids, mask in sequences)
        assert sum(mask.sum() for _, mask in sequences) == n
        seen += np.concatenate([ids[mask] for ids, mask in sequences]).tolist()
    assert seen == flat


def test_token_files_null_and_repeated_ids(spark, tmp_path):
    docs = spark.createDataFrame([(None, "a"), (1, "b"), (1, "c"), (1, "b")], "doc_id long, text string")
    found = token_binary.read_token_files(token_binary.write_token_files(docs, f"file://{tmp_path}/n", P.path("byte_bpe_50k.json"), vocabulary=50_257)).collect()
    assert sorted((r["doc_id"] or 0, r["start"], r["n_tokens"]) for r in found) == [(0, 0, 2), (1, 2, 2), (1, 4, 2), (1, 6, 2)]


# ---- secrets --------------------------------------------------------------------------------


def plain_base(text):
    found = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, "assign", m.end()))
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))


SECRETS = [
    'password = "hunter22" and token:abcdefgh', "secret=token:abcdefgh", "API_KEY: 'abc'", "AKIA" + "Z" * 16, "AKIA" + "Z" * 15 + "AKIA" + "B" * 30, "éé 0123456789abcdef01234567",
    "tokeN=abcdef.gh api_key==abcdef", "passwd  :  deadbeefdeadbeefdeadbeef", "x" * 200_000 + " token=" + "ab12" * 10,
]


def test_base_spans_equal_the_patterns():
    for text in SECRETS + [t or "" for t in AWKWARD] + random_texts(500, 8):
        assert secrets._joined(secrets.base_spans(text)) == plain_base(text), text[:60]


def test_battery_tells_random_from_words():
    rng = random.Random(4)
    made = lambda name, n: "".join(rng.choice(secrets.ENCODINGS[name]) for _ in range(n))
    for name in ("base36", "base62", "base64"):
        assert sum(secrets.discoveries([made(name, 40)])[0] for _ in range(200)) >= 180
    words = ["internationalization2024", "checkpoint-2024-01-01-final", "A" * 40 + "1", "abc1" * 10, "http-response-code-404-not-found", "0123456789" * 4, "Donaudampfschifffahrtsgesellschaft1"]
    assert not any(secrets.discoveries(words))
    assert secrets.discoveries([]) == []


def test_longer_tokens_get_more_of_the_budget():
    rng = random.Random(9)
    hits = {n: sum(secrets.discoveries(["".join(rng.choice(secrets.ENCODINGS["base62"]) for _ in range(n))])[0] for _ in range(150)) for n in (20, 28, 44)}
    assert hits[20] < hits[28] < hits[44]


def test_a_secret_is_found_in_a_long_document():
    rng = random.Random(21)
    parts = ["Session", "manager", "config", "http", "response", "index", "docs", "release", "2024", "v2", "Buffer", "table"]
    rulers = ["-" * 60, "_" * 30, "internationalizations", "https/example/docs/release/notes"]
    name = lambda: "".join(rng.choice(parts) + rng.choice("_-/") for _ in range(5)) + "7"
    for others in (9, 49):
        hits = 0
        for _ in range(60):
            secret = "".join(rng.choice(secrets.ENCODINGS["base62"]) for _ in range(32))
            text = " prose ".join([*(rng.choice(rulers) for _ in range(50)), *(name() for _ in range(others)), secret])
            found = [text[s:e] for s, e, _ in secrets.scan(text)[1]]
            hits += secret in found
            assert set(found) <= {secret}
        assert hits >= 54, others


def test_a_value_after_an_equals_sign_is_a_candidate():
    value = "Zq3kP9xLw0Rt7VbN2mYc5HdJ8sGf1TaE4uQi6Xo"
    for text in (f"AWS_SECRET_ACCESS_KEY={value}", f"https://h.org/p?sig={value}&x=1", f"AccountKey={value}==", f"A=b={value}", f"{value}=on"):
        found = [text[s:e].rstrip("=") for s, e, _ in secrets.scan(text)[1]]
        assert found == [value] and value not in secrets.redact(text), text
    assert "wJalr" not in secrets.redact("AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI/K7MDENG/bPxRfiCY9XAMPLEKEY")
    padded = "q7Zk3Xw9Lp2Vt8Rb5M=="  # 20 with its padding
    assert [s[:2] for s in secrets.scan(f"a {padded} b")[1]] == [(2, 22)]


def test_tokens_of_letters_or_digits_alone_are_tested():
    rng = random.Random(13)
    for alphabet in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"):
        made = ["".join(rng.choice(alphabet) for _ in range(32)) for _ in range(100)]
        assert sum(secrets.discoveries([t])[0] for t in made) >= 95, alphabet
    words = ["donaudampfschifffahrtsgesellschaft", "pneumonoultramicroscopicsilicovolcanoconiosis", "UNCHARACTERISTICALLYLONG", "ACGTTGCAACGTGGCATCGATCGGATTACAGCTA", "01234567890123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "-" * 60]
    assert not any(secrets.discoveries([w])[0] for w in words)


def test_redaction_leaves_no_span_and_keeps_rows(spark, sf):
    text = "a token=abcdef0123456789abcdef0123456789 b " + "Zq3kP9xLw0Rt7VbN2mYc5HdJ8sGf1TaE4uQi6Xo"
    assert secrets.redact(text).startswith("a [SECRET] b") and "abcdef0123" not in secrets.redact(text)
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "length(text) AS n_chars")
    out = secrets.redacted(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("text IS NULL").count() == docs.where("text IS NULL").count()
    assert out.where("n_chars <> length(text)").count() == 0


def plain_battery(body, alphabet):
    """Uniformity by an exact chi-squared tail, runs and serial correlation, by their textbook forms."""
    n, size = len(body), len(alphabet)
    kind = lambda c: "d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else "o"
    cell = (lambda c: c) if n >= 4 * size else kind
    share, seen = Counter(map(cell, alphabet)), Counter(map(cell, body))
    chi, df = sum((seen[k] - n * v / size) ** 2 / (n * v / size) for k, v in share.items()), len(share) - 1
    x = np.linspace(1e-9, np.sqrt(chi) if chi else 1e-9, 20_001)  # of the chi density
    density = x ** (df - 1) * np.exp(-x * x / 2) / (2 ** (df / 2 - 1) * math.gamma(df / 2)) if df else x
    uniform = 1 - np.trapezoid(density, x) if df else 1.0
    v = np.array([alphabet.index(c) for c in body], float)
    high = v > (size - 1) / 2
    a, b = int(high.sum()), int((~high).sum())
    runs = 2.0 ** (1 - n)
    if a and b:
        mean = 1 + 2 * a * b / n
        z = abs(1 + int((high[1:] != high[:-1]).sum()) - mean) / np.sqrt((mean - 1) * (mean - 2) / (n - 1)) if mean > 2 else 0.0
        runs = math.erfc(z / math.sqrt(2))
    d = v - v.mean()
    r = (d[1:] * d[:-1]).sum() / (d * d).sum() if d.any() else None
    return uniform, runs, math.erfc(abs(r + 1 / n) * math.sqrt(n / 2)) if r is not None else 0.0


def tokens_and_names(rng, names, randoms, least=20, most=44):
    """Made names, paths and versions (False), and tokens of random symbols (True), at random lengths."""
    parts = ["Session", "manager", "config", "http", "response", "index", "docs", "release", "2024", "v2", "Buffer", "table", "user", "id", "Handler", "test", "cache", "11", "policy", "Error"]
    out = []
    while len(out) < names:
        name = "".join(rng.choice(parts) + rng.choice(["_", "-", "/", "", ""]) for _ in range(rng.randint(3, 9))) + str(rng.randint(0, 99))
        if len(name) >= least:
            out.append((name, False))
    kinds = ["base62", "base36", "base64", "base64url", "base32"]
    out += [("".join(rng.choice(secrets.ENCODINGS[kinds[k]]) for _ in range(rng.randint(least, most))), True) for k in (rng.randrange(5) for _ in range(randoms))]
    rng.shuffle(out)
    return out


def test_battery_equals_the_textbook_forms():
    rng = random.Random(31)
    tested = 0
    for token, _ in tokens_and_names(rng, 300, 300) + [("0123456789" * 12, True), ("ab" * 60, False), ("A" * 30, False)]:
        encoding = secrets.encoding_of(token)
        if encoding:
            got, want = secrets.battery(token, encoding), plain_battery(token, secrets.ENCODINGS[encoding])
            assert got["runs"] == pytest.approx(want[1], rel=1e-6, abs=1e-12) and got["serial"] == pytest.approx(want[2], rel=1e-6, abs=1e-12), token
            assert got["uniform"] == pytest.approx(want[0], rel=0.15, abs=0.02), token  # cube-root approximation
            tested += 1
    assert tested > 350


def plain_discoveries(tokens, rate):
    """Benjamini-Hochberg as it is written: sorted p-values against a line, weights by length."""
    graded = [(i, t, secrets.battery(t, e)) for i, t in enumerate(tokens) if (e := secrets.encoding_of(t))]
    mean = sum(len(t) for _, t, _ in graded) / len(graded)
    p = sorted(((b["language"] * mean / len(t) if min(b["uniform"], b["runs"], b["serial"]) >= secrets.DEPART else math.inf), i) for i, t, b in graded)
    k = max((k for k, (x, _) in enumerate(p, 1) if x <= rate * k / len(graded)), default=0)
    return {i for _, i in p[:k]}, {i for x, i in p if k and x <= p[k - 1][0] * math.exp(-2 / secrets.BINS)}


def test_the_family_is_the_whole_table(spark, tmp_path):
    """Spans of a table against the plain procedure over all of its candidates, and its false finds."""
    rng = random.Random(32)
    made = tokens_and_names(rng, 1500, 150)
    texts = [" and ".join(t for t, _ in made[i : i + 3]) for i in range(0, len(made), 3)] + [None, "", " "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spans = {(r["doc_id"], s["start"], s["end"]) for r in secrets.secret_spans(docs).collect() for s in r["secrets"] if s["kind"] == "random"}
    tokens = [(i, m) for i, t in enumerate(texts) for m in secrets.candidates(t or "", secrets.base_spans(t or ""))]
    most, surely = plain_discoveries([m[0] for _, m in tokens], secrets.RATE)
    where = lambda ks: {(tokens[k][0], tokens[k][1].start(), tokens[k][1].end()) for k in ks}
    assert where(surely) <= spans <= where(most)  # a bin's width apart at most
    real = {t for t, yes in made if yes}
    found = [texts[i][s:e] for i, s, e in spans]
    assert sum(t not in real for t in found) <= 0.03 * len(found) and sum(t in real for t in found) >= 120
    out = rows(secrets.op4_secret_scan(spark, str(tmp_path)))
    assert [r["doc_id"] for r in out] == list(range(len(texts)))
    assert {(r["doc_id"], *map(int, s.split(":")[1:])) for r in out for s in r["spans"].split(",") if s.startswith("random")} == spans


def test_op4(spark, sf, empty):
    texts = texts_of(spark, sf)
    found = rows(secrets.op4_secret_scan(spark, sf))
    assert [r["doc_id"] for r in found] == sorted(texts)
    for r in found:
        base = plain_base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) - {""} <= set(r["spans"].split(","))
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [base.count(k) for k in ("assign", "access", "hex")]
    assert secrets.op4_secret_scan(spark, empty).count() == 0
    assert secrets.secret_spans(spark.read.parquet(f"{sf}/documents.parquet")).where("size(secrets) > 0").count() > 0


# ---- licenses -------------------------------------------------------------------------------


def plain_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    found = []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), sorted(found)


LICENSES = ["Apache   License; apache\n\nlicense", "mit licenses", "xmit license", "the GNU General Public\tLicense mit license mit license", "MİT license", "mit license" * 3, "General Public General Public License"]


def test_phrases_equal_the_plain_search():
    texts = LICENSES + [t or "" for t in AWKWARD] + random_texts(300, 11)
    for text, got in zip(texts, licenses.scan(texts)):
        assert (got["n_words"], got["base"]) == plain_places(text), text[:60]


def test_edited_notices_are_found():
    notice = "permission is hereby granted free of charge to any person obtaining a copy"
    for edit, errors in ((notice, 0), (notice.replace("charge", "charg"), 1), (notice.replace("hereby", "herebyy").replace("person", "persom"), 2), (notice.replace("any ", "any, ").upper(), 0)):
        got = list(licenses.scan(["before it " + edit + " after"]))[0]["notices"]
        assert [(x[0], x[2], x[3]) for x in got] == [(2, "mit-notice", errors)], edit
    far = notice.replace("hereby", "xxxxxx").replace("person", "yyyyyy")
    assert not list(licenses.scan([far]))[0]["notices"]
    assert not list(licenses.scan(["all rights\x00", "reserved"]))[0]["notices"]


def test_an_edited_notice_before_a_better_one_is_found():
    exact, edited = "released under the mit license", "released undr the mit license"
    for text, errors in ((f"{edited} {exact}", [1, 0]), (f"{exact} {edited}", [0, 1]), (f"{edited} {edited} {exact} {edited}", [1, 1, 0, 1])):
        got = list(licenses.scan(["x " + text + " y"]))[0]["notices"]
        assert [(x[0], x[1], x[3]) for x in got] == [(1 + 5 * i, 6 + 5 * i, k) for i, k in enumerate(errors)], text


def test_every_bounded_edit_keeps_a_seed():
    rng = random.Random(2)
    for notice, _ in licenses.NOTICES:
        for _ in range(20):
            chars = list(notice)
            for _ in range(licenses.edits(notice)):
                at = rng.randrange(len(chars))
                chars[at : at + 1] = rng.choice([[], ["q"], [chars[at], "q"]])
            assert any(s in "".join(chars).encode() for _, s in licenses.seeds(notice))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_notices(text):
    """Label: fewest errors over all runs of words; no seeds, no windows, no regex library."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    out = {}
    for notice, label in licenses.NOTICES:
        n, k = len(notice.encode()), max(1, len(notice.encode()) // 20)
        for i in range(len(words)):
            run = b""
            for word in words[i:]:
                run += (b" " if run else b"") + word.encode()
                if len(run) > n + k:
                    break
                if len(run) >= n - k and (d := distance(run, notice.encode())) <= k:
                    out[label] = min(out.get(label, (9, 0.0)), (d, 1 - d / n))
    return out


def test_notices_equal_the_plain_search():
    rng = random.Random(14)
    made = []
    for notice, _ in licenses.NOTICES:
        k = licenses.edits(notice)
        for n in (0, 1, k, k + 1, k + 2):  # k + 1: one edit too many, mostly
            chars = list(notice)
            for _ in range(n):
                at = rng.randrange(len(chars))
                chars[at : at + 1] = rng.choice([[], ["q"], [chars[at], "q"], [" ", chars[at]]])
            body = "".join(chars)
            made += [body, "w " + body, body + " w", "w" + body, body + "ly", f"a {body}\n{body} b"]
    made += ["all rights reservedly", "all rights reserved", "all rights reserv", "all rights", "reserved", "released under the mit licens", "e x", "", " ", "all  RIGHTS, reserved!"]
    rng.shuffle(made)
    for text, got in zip(made, licenses.scan(made), strict=True):
        want = plain_notices(text)
        best = {}
        for _, _, label, errors, length in got["notices"]:
            best[label] = min(best.get(label, (9, 0.0)), (errors, 1 - errors / length))
        assert {x: e for x, (e, _) in best.items()} == {x: e for x, (e, _) in want.items()}, text
        assert got["base"] or licenses.score([], got["notices"]) == pytest.approx(max((s for _, s in want.values()), default=0.0), abs=0.02), text


def test_score_is_of_the_matched_notice():
    got = list(licenses.scan(["x released under the mit licens y"]))[0]
    assert got["base"] == [] and licenses.score([], got["notices"]) == pytest.approx(1 - 1 / 30)


def test_op7(spark, sf, empty):
    texts = texts_of(spark, sf)
    found = rows(licenses.op7_license_scan(spark, sf))
    assert [r["doc_id"] for r in found] == sorted(texts)
    for r in found:
        n, found = plain_places(texts[r["doc_id"]])
        at = [w for w, _ in found]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (n, len(found), min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in found})) and 0 <= r["score"] <= 1
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}
    assert licenses.op7_license_scan(spark, empty).count() == 0


# ---- quality --------------------------------------------------------------------------------


def plain_quality(text):
    words = [w for w in re.split(f"[{SPACE}]+", text) if w]
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        if windows[w] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return {"n_words": n, "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": dup, "n_repeat_words": len(hit), "base_failed": n < 50 or 100 * len(hit) > 50 * n}


def test_figures_equal_the_plain_ones():
    for text in [t or "" for t in AWKWARD] + random_texts(600, 12) + ["a a a a", "a b c a b c", "x\n x\nx \nx"]:
        got = quality.judged(text)
        assert {k: got[k] for k in plain_quality(text)} == plain_quality(text), text[:60]
        assert not (got["base_failed"] and got["kept"])


PROSE = " ".join(f"One{i} two{i} three{i}, four{i} five{i} six{i}." for i in range(12))


def test_line_rules():
    prose = PROSE
    assert quality.judged(prose)["kept"] and quality.judged(prose)["cleaned"] == prose
    menu = "\n".join(" | ".join(f"Item{i}{j}" for j in range(12)) for i in range(8))
    assert not quality.judged(menu)["kept"]
    mixed = prose + "\nHome | News | About | Contact"
    assert quality.judged(mixed)["kept"] and quality.judged(mixed)["cleaned"] == prose
    assert quality.failure("We use cookies.") == "boilerplate" and quality.failure("A plain sentence.") is None


def plain_verdict(text):
    """The verdict by patterns over each line and what follows it, as the module's docstring has it."""
    lines = text.split("\n")
    held = lost = 0
    for i, line in enumerate(lines):
        body = re.sub(f"^[{SPACE}]+|[{SPACE}]+$", "", line)
        if not body:
            continue
        words, follows = body.split(), re.match(f"[{SPACE}]*(.)", lines[i + 1]) if i + 1 < len(lines) else None
        ends = re.search("[" + re.escape(quality.CLOSING) + "]$", body) or (len(body) >= 200 and re.search("[.!?。] ", body)) or (len(body) >= 40 and follows and follows[1].islower())
        bad = line in lines[:i] or len(re.findall("[|›»•·]", body)) >= 3 or not ends or 20 * len(re.findall(r"[#*$%&|<>]", body)) > len(body)
        bad = bad or sum(w.endswith("!!") for w in words) * 3 >= len(words) and "!!" in body
        bad = bad or len(words) <= 12 and any(s in body.lower() for s in quality.STOCK)
        held, lost = held + len(body), lost + bad * len(body)
    return not plain_quality(text)["base_failed"] and 2 * lost <= held


def test_verdict_equals_the_plain_one():
    rng = random.Random(17)
    lines = ["A plain sentence stands here, and it ends as it should.", "Home | News | About | Us", "no end here", "We use cookies.", "Wow!! so!! good!!", "", "  ", "this line is long enough to be wrapped and goes on", "in lower case, as prose does that a mail program breaks.", "a # b # c #.", "यह एक वाक्य है।", "x" * 250 + ". y", "Same line again."]
    kept = 0
    for _ in range(1500):
        text = "\n".join(rng.choice(lines) + (f" {rng.randint(0, 99)}." if rng.random() < 0.5 else "") for _ in range(rng.randint(3, 25)))
        got = quality.judged(text)
        assert got["kept"] == plain_verdict(text), text
        kept += got["kept"]
    assert 150 < kept < 1350
    for text in [t or "" for t in AWKWARD] + random_texts(300, 18):
        assert quality.judged(text)["kept"] == plain_verdict(text), text[:60]


def test_wrapped_prose_is_kept():
    words = [f"word{i}" for i in range(300)]
    wrapped = "\n".join(" ".join(words[i : i + 9]) for i in range(0, 300, 9)) + "."
    assert quality.judged(wrapped)["kept"] and quality.judged(wrapped)["cleaned"] == wrapped


def test_op8(spark, sf, empty):
    texts = texts_of(spark, sf)
    found = rows(quality.op8_quality_rules(spark, sf))
    assert [r["doc_id"] for r in found] == sorted(texts)
    for r in found:
        want = plain_quality(texts[r["doc_id"]])
        assert {k: r[k] for k in want} == want
    assert quality.op8_quality_rules(spark, empty).count() == 0


def test_cleaned_keeps_columns(spark):
    prose = PROSE
    docs = spark.createDataFrame([(1, prose + "\nx | y | z | w", 5, "k"), (2, None, None, None), (3, "short.", 6, "k")], "doc_id long, text string, n_chars long, kept string")
    out = quality.cleaned(docs)
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [(1, prose, len(prose), "k")]


# ---- mixing ---------------------------------------------------------------------------------


def water(sizes, weights, limit=3.0):
    total, full = float(sum(sizes)), set()
    while True:
        open_ = [i for i in range(len(sizes)) if i not in full]
        left = total - sum(limit * sizes[i] for i in full)
        share = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_} if open_ else {}
        over = {i for i in open_ if share[i] > limit * sizes[i]}
        if not over:
            return [limit * sizes[i] if i in full else share[i] for i in range(len(sizes))]
        full |= over


def test_targets_by_water_filling(spark):
    rng = random.Random(6)
    for _ in range(4):
        sizes = [rng.choice([0, 1, 5, 80, 1000, 40_000]) for _ in range(8)]
        df = spark.createDataFrame([(0 if i < 7 else 1, f"s{i}" if i < 7 else "", n) for i, n in enumerate(sizes)], "nil int, source string, source_size long")
        got = [r["target"] for r in mixing.targets(df).orderBy("nil", "source").collect()]
        assert got == pytest.approx(water(sizes, [i % 3 + 1 for i in range(8)])), sizes


def test_mix(spark):
    rng = random.Random(1)
    data = [(i, "w " * rng.randint(0, 60), rng.choice(["a", "a", "a", "b", "B", None]), "x") for i in range(900)] + [(1, "w w", "a", "x")] * 2 + [(None, None, None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, key string")
    out = [r.asDict(True) for r in mixing.mix_sources(docs, key_buckets=16).collect()]
    again = [r.asDict(True) for r in mixing.mix_sources(docs.repartition(7), key_buckets=4096).collect()]
    order = lambda r: str(sorted(r.items(), key=str))
    assert sorted(out, key=order) == sorted(again, key=order) and len(out) == len(data)
    for source in ("a", "b", "B", None):
        part = [r for r in out if r["source"] == source]
        target, size = part[0]["mix"]["target"], sum(r["mix"]["size"] for r in part)
        assert part[0]["mix"]["source_size"] == size and target <= 3 * size + 1e-6
        assert abs(sum(r["mix"]["taken"] for r in part) - target) <= 30
        assert all(r["mix"]["taken"] <= 3 * r["mix"]["size"] for r in part)
        copies = {r["mix"]["copies"] for r in part if r["mix"]["size"]}
        assert max(copies) - min(copies) <= 1  # whole epochs first
    assert mixing.repeated(mixing.mix_sources(docs)).columns == docs.columns
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(docs.withColumnRenamed("key", "mix"))


def test_better_documents_come_first(spark):
    """Weights 1 and 5/8, half of the words taken: of keys below t, 1 - exp(-t) and 1 - exp(-5t/8) of each kind."""
    docs = spark.createDataFrame([(i, "w " * 10 + ("# " * 30 if i % 2 else "a " * 30), "ab"[i % 4 // 2]) for i in range(2000)], "doc_id long, text string, source string")
    taken = mixing.mix_sources(docs, weights=mixing.F.when(mixing.F.col("source") == "a", 1.0).otherwise(3.0)).where("source = 'a' AND mix.copies > 0").collect()
    low, high = 0.0, 5.0
    for _ in range(60):
        t = (low + high) / 2
        low, high = (t, high) if (1 - np.exp(-t)) + (1 - np.exp(-0.625 * t)) < 1 else (low, t)
    share = 1 - np.exp(-t)
    # either kind's count is binomial, and their sum is held: half the variance
    error = np.sqrt(500 * share * (1 - share) / 2)
    better = sum(r["doc_id"] % 2 == 0 for r in taken)
    assert len(taken) == 500 and abs(better - 500 * share) <= 3 * error and better > 250 + 3 * error


def test_mix_of_awkward_texts(spark, sf):
    """Null, empty, white-space and very long texts, and rows without ids, in op1's own path and the general one."""
    texts = [None, "", " \n\t", LONG, "#" * 50, "a b"] * 20
    docs = spark.createDataFrame([(i if i % 3 else None, t, None if i % 4 else "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    out = [r["mix"] for r in mixing.mix_sources(docs).collect()]
    assert len(out) == len(texts) and {m["size"] for m in out} == {0, len(LONG.split()), 1, 2}
    assert all(m["taken"] <= 3 * m["size"] for m in out)
    found = rows(mixing.op1_mix_sources(spark, sf))
    held = texts_of(spark, sf)
    assert {r["doc_id"]: r["size"] for r in found} == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in held.items()}
    assert len(found) == len(held)


def test_rows_without_ids_get_keys_of_their_own(spark):
    docs = spark.createDataFrame([(None, f"w{i} x", "s") for i in range(400)] + [(i, "w x", "t") for i in range(400)], "doc_id long, text string, source string")
    taken = mixing.mix_sources(docs).where("source = 's'").groupBy("mix.copies").count().collect()
    assert sum(r["count"] for r in taken) == 400 and len(taken) == 2
    with pytest.raises(ValueError):
        mixing.repeated(mixing.mix_sources(docs.withColumn("__copy", mixing.F.lit(1))))


def test_mix_runs_no_python(spark, sf):
    plan = mixing.op1_mix_sources(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_op1_empty(spark, empty):
    assert mixing.op1_mix_sources(spark, empty).count() == 0
