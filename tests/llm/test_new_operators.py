"""Hard negatives, the filter audit and byte-level BPE against plain versions and on odd rows."""

import base64
import hashlib
import itertools
import math
import random
import time

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken

from quillgraph.llm import byte_bpe, filter_audit, hard_negatives, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
VECTORS = "vec_id long, embedding array<float>, label int, id string, anchor int, part int, low int"


def plain_negatives(rows):
    """Rows of (id, vector, label), by the definition."""
    ok = [(i, [math.floor(256 * float(x)) for x in v], l) for i, v, l in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, va, la in dict.fromkeys((i, tuple(v), l) for i, v, l in ok if i % 50 == 0):
        scored = [(-sum(x * y for x, y in zip(va, v)), i, l) for i, v, l in ok if i != a and len(v) == len(va)]
        for s, p, _ in sorted(x for x in scored if x[2] == la)[:5]:
            good = sorted((t, n) for t, n, l in scored if l != la and 50 * -s <= 100 * -t <= 95 * -s)[:3]
            out += [(a, p, r + 1, n, -s, -t) for r, (t, n) in enumerate(good)]
    return sorted(out)


def columns(df):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def test_op11_against_definition(spark):
    rows = [(r["vec_id"], r["embedding"], None if r["label"] is None else (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in pq.read_table("/root/testdata/sf0.01/embeddings.parquet").to_pylist()]
    assert columns(queries.op11_hard_negatives(spark, "/root/testdata/sf0.01")) == plain_negatives(rows)


@pytest.mark.parametrize(("leaf", "block"), [(128, 256), (4, 3)])
def test_hard_negatives_odd_rows(spark, monkeypatch, leaf, block):
    """Small leaves and blocks, ties, repeated rows, rare labels, rows that take no part, several lengths, clashing columns; no rows."""
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in np.round(rng.normal(size=6) * 0.2, 1)], int(rng.integers(3)) if k % 40 else 7 + k) for k in range(600)]
    rows += [(1000, rows[50][1], 1), (100, rows[100][1], rows[100][2]), (7, rows[7][1], rows[7][2]), (8, rows[8][1], rows[8][2])]
    rows += [(None, rows[0][1], 1), (650, rows[1][1], None), (700, None, 1), (750, [None] * 6, 1), (800, [math.nan] * 6, 1), (850, [math.inf] + [0.0] * 5, 1), (900, [1e9] * 6, 1), (901, [], 1), (950, [], 1), (951, [0.5, 0.5], 1), (1050, [0.5, 0.25], 1), (952, [0.4, 0.3], 2), (953, [0.0] * 6, 2)]
    monkeypatch.setattr(hard_negatives, "LEAF", leaf)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", block)
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], VECTORS)
    assert columns(hard_negatives.mine(df)) == plain_negatives([(i, v if v is None or 1e9 not in v else None, l) for i, v, l in rows])
    assert hard_negatives.mine(df.limit(0)).collect() == []


def test_ball_bounds_hold():
    """No leaf that is skipped holds a row in the window; leaves far from it are skipped."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 100
    rows = np.floor(np.repeat(centres, 100, axis=0) + rng.normal(size=(4000, 16)) * 4)
    tree = hard_negatives.BallTree(np.arange(4000), np.zeros(4000, np.int64), rows)
    scored = []
    whole = tree.scores
    tree.scores = lambda leaf, a: scored.append(leaf) or whole(leaf, a)
    query, found, score = tree.best(rows[:1], np.array([0]), np.array([0]), np.array([0]), np.array([-(1 << 62)]), np.array([1 << 62]), True, 5)
    every = sorted(((-int(rows[0] @ r), k) for k, r in enumerate(rows) if k))[:5]
    assert [(-int(s), int(f)) for s, f in zip(score, found)] == every
    assert len(set(scored)) < 0.5 * (len(tree.starts) - 1)


def plain_audit(docs, labels):
    said = {}
    for i, quality, toxic in labels:
        g, t = said.get(i, (0, 0))
        said[i] = (max(g, int(quality == 1)), max(t, int(toxic == 1)))
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    parts = {}
    for i, text, lang in docs:
        t = text or ""
        for c in "\t\n\x0b\x0c\r":
            t = t.replace(c, " ")
        words, n = [w for w in t.split(" ") if w], len(t)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * n, "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > first[text or ""]}
        parts.setdefault(lang or "", []).append((fails, *said.get(i, (0, 0))))
    out = []
    for part, rows in parts.items():
        removed_at = {}
        for order in map("".join, itertools.permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                gone, left = [r for r in left if r[0][f]], [r for r in left if not r[0][f]]
                removed_at[order, f] = len(gone)
                failing = sum(r[0][f] for r in rows)
                out.append([part, order, step, len(left), len(gone), failing - len(gone), sum(r[0][f] and sum(r[0].values()) == 1 for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)])
        for row in out:
            if row[0] == part:
                row.append(sum(n for (_, f), n in removed_at.items() if f == row[1][row[2] - 1]))
    return sorted(map(tuple, out))


def test_op12_against_definition(spark):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()]
    labels = [(r["doc_id"], r["quality"], r["toxic"]) for r in pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pylist()]
    assert sorted(map(tuple, queries.op12_filter_audit(spark, "/root/testdata/sf0.01").collect())) == plain_audit(docs, labels)


def test_filter_audit_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "PIECE", 50)
    long = " ".join(f"w{k}" for k in range(300))
    odd = ["", None, "  \n", long, long, long + " A$", long.upper(), "é́ " * 120, "a b\x1cc\x85d " * 40, "ABCDEFGHIJ" + "x" * 90, "ABCDEFGHIJK" + "x" * 89, "x" * 500, "w " * 79 + " ".join(map(str, range(21)))]
    rows = [(k % 17, t, lang) for k, (t, lang) in enumerate(itertools.product(odd, ["en", None, "", "fr"]))] + [(None, long, "en"), (None, "only here", "xx"), (3, long, "en"), (3, long, "en"), (-1, long, "de")]
    labels = [(1, 1, 0), (1, 0, 1), (3, 1, 1), (5, None, None), (None, 1, 1), (99, 1, 1)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, part string, failed int")
    said = spark.createDataFrame([(*r, 2) for r in labels], "doc_id long, quality int, toxic int, good int")
    assert sorted(map(tuple, filter_audit.filter_audit(docs, said).collect())) == plain_audit(rows, [x for x in labels if x[0] is not None])
    assert filter_audit.filter_audit(docs.limit(0), said).collect() == []
    assert {r.good_lost for r in filter_audit.filter_audit(docs, said.limit(0)).collect()} == {0}


@pytest.fixture(scope="module")
def bpe():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_op13_against_the_library(spark, bpe):
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = []
    for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist():
        ids = bpe.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), sha(",".join(map(str, ids)).encode()), sha((r["text"] or "").encode())))
    assert sorted(map(tuple, queries.op13_byte_bpe(spark, "/root/testdata/sf0.001").collect())) == sorted(want)


def odd_texts():
    rng = random.Random(4)
    signs = ["a", "b", "é", "中", " ", "  ", "\n", "\t", "1", ".", "'s", "'", "\x1c", "\x85", "　", "​", "Ω̈", "th", "THE", "😀"]
    odd = ["", " ", " x ", "a\n b\t c ", "aaaa" * 500, "<|endoftext|> x", "it's IT'S we'll 'll", "ﬁ ² ½ ٣ a \x00 c", "中文字符 测试", "word " * 3000]
    return odd + ["".join(rng.choices(signs, k=rng.randint(1, 30))) for _ in range(3000)]


@pytest.mark.parametrize(("vectors", "known"), [(byte_bpe.VECTORS, 10**6), (2, 0), (1 << 60, 5)])
def test_merge_replay(monkeypatch, bpe, vectors, known):
    """Merges one by one and in steps, with and without words to remember, over two batches."""
    monkeypatch.setattr(byte_bpe, "KNOWN_STRETCHES", known)
    monkeypatch.setattr(byte_bpe, "KNOWN_WORDS", known)
    encoder = byte_bpe.Encoder(PATH, public_tokenizers.PATTERN)
    replay = encoder.vocabulary.replay
    encoder.vocabulary.replay = lambda words, steps=vectors: replay(words, steps)
    assert encoder.cuts
    texts = odd_texts()
    for batch in (texts, texts[::-1]):
        assert [np.frombuffer(x, "<i4").tolist() for x in encoder.encode(batch)] == [bpe.encode_ordinary(t) for t in batch]
    assert len(encoder.stretches) <= known and len(encoder.known) <= known


def test_pairs_of_lower_rank_than_the_merge_that_made_them(tmp_path):
    """A vocabulary that no training gives: abc comes before ab, and nothing joins b and c."""
    words = [bytes([b]) for b in range(256)] + [b"abc", b"ab", b"cab", b"aa", b"aab"]
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(w) + b" %d" % k for k, w in enumerate(words)))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={w: k for k, w in enumerate(words)}, special_tokens={})
    vocabulary = byte_bpe.Vocabulary(str(path))
    texts = ["".join(x) for n in range(1, 8) for x in itertools.product("abc", repeat=n)] + ["abcabcaab" * 30, "cababcc" * 40]
    todo = [t.encode() for t in texts]
    for vectors in (1, 24, 1 << 60):
        got = [np.frombuffer(x, "<i4").tolist() for x in vocabulary.replay(todo, vectors)]
        wrong = [(w, g) for w, g in zip(texts, got) if w.encode() not in vocabulary.ranks and g != plain.encode_ordinary(w)]  # tokens are not replayed
        assert not wrong


def test_long_words_take_time_that_grows_with_them(bpe):
    encoder = byte_bpe.Encoder(PATH, public_tokenizers.PATTERN)
    rng = random.Random(2)
    took = []
    for n in (100_000, 400_000):
        word = "".join(rng.choices("abcdefgh", k=n))
        began = time.perf_counter()
        (ids,) = encoder.encode([word])
        took.append(time.perf_counter() - began)
        assert bytes(byte_bpe.joined_tokens(encoder.vocabulary, np.frombuffer(ids, "<i4"))) == word.encode()
    assert took[1] < 12 * took[0] + 1


def test_encode_decode_odd_rows(spark):
    texts = [*odd_texts()[:200], None, None]
    rows = [(k, t, "x", 1) for k, t in enumerate(texts)] + [(5, texts[5], "y", 2), (None, "no id", "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, ids int")
    got = byte_bpe.decode(byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert sorted((r.id is None, r.id or 0, bytes(r.decoded).decode()) for r in got) == sorted((i is None, i or 0, t or "") for i, t, *_ in rows)
    together = byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN, back=True).collect()
    assert sorted(map(repr, together)) == sorted(map(repr, got))
    assert all((r.ids == []) == (bytes(r.decoded) == b"") for r in got)
    assert byte_bpe.encode(docs.limit(0), PATH, public_tokenizers.PATTERN).collect() == []
    with pytest.raises(Exception, match="vocabulary does not have"):
        byte_bpe.decode(spark.createDataFrame([(1, [60_000])], "id long, ids array<int>"), PATH).collect()
