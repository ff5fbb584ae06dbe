"""Each operator against a plain version, with nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import hashlib
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import brute
from quillgraph.llm import common, components, decontaminate, embedding_dedup, line_dedup, packing, quality, queries, secret_scan, simhash, suffix_dedup, token_counts, warc

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, id string, h int, __gone int"


@pytest.fixture(scope="module")
def texts():
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()[:120]]
    top = max(i for i, _ in rows) + 1
    long = " ".join(t for _, t in rows[:40])
    odd = [None, "", "   \n ", "one", long, long + " end", "x" * 5000, "é́ Σς " * 60, 'a = "Zx9-Kq2LmW81vT"\npassword = a\n', 'token: "AKIA' + "B" * 16 + '"', rows[3][1], rows[3][1] + " more words here"]
    return rows + [(top + k, t) for k, t in enumerate(odd)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Clashing column names beside the texts; one row twice and one null id."""
    rows = [(i, t, "x", 1, 2) for i, t in texts]
    return spark.createDataFrame([*rows, rows[5], (None, "a row without an id", "x", 1, 2)], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df, key="id"):
    return {r[key]: r for r in df.collect() if r[key] is not None}


def test_simhash(docs, texts, empty):
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == docs.count()
    want = brute.simhash(texts)
    got = {r.id: (f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in found if r.id is not None}
    assert got == want
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} - {None} == {c for _, c in want.values()}


def test_simhash_links_on_random_prints():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = base.copy()
    for k in range(len(near)):
        for b in rng.choice(64, k % 7, replace=False):
            near[k] ^= np.uint64(1) << np.uint64(b)
    fp = np.unique(np.concatenate([base, near]))
    found = []
    simhash._meet(fp, np.full(len(fp), 2), 64, 4, found)
    edges = {tuple(sorted(e)) for e in np.concatenate(found).tolist()}
    nodes = fp.tolist()
    want = brute.components(nodes, [(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= 4])
    assert brute.components(nodes, edges) == want


def test_simhash_splits_crowded_destinations(spark):
    """A cluster that agrees in its leading bits, another spread over all bits, and strangers; destinations split down to whole variants."""
    rng = np.random.default_rng(8)
    core = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    flips = [[int(b) for b in rng.choice(12 if k % 2 else 64, int(rng.integers(0, 6)), replace=False)] for k in range(300)]
    near = [int(core[k % 3]) ^ sum(1 << b for b in bits) for k, bits in enumerate(flips)]
    fp = sorted({*near, *rng.integers(0, 1 << 63, 200, dtype=np.uint64).tolist(), 0, (1 << 64) - 1})
    want = brute.components(fp, [(a, b) for a in fp for b in fp if a < b and (a ^ b).bit_count() <= 4])
    prints = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fp], "fp long")
    for most in (10, 150, simhash.PRINTS_AT_ONCE):
        edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(prints, len(fp), most=most).collect()]
        assert brute.components(fp, edges) == want


def test_pipeline_links_texts_of_similarity_08(spark, docs, empty):
    import corpus_pipeline

    rng = np.random.default_rng(21)
    rows = []
    for k in range(60):  # each text with 0 to 6 of its 200 words replaced, far apart
        words = [f"w{x}" for x in rng.integers(0, 100_000, 200)]
        rows.append((2 * k, " ".join(words)))
        for at in range(k % 7):
            words[10 + 28 * at] = "changed"
        rows.append((2 * k + 1, " ".join(words).upper()))
    rows += [(500, None), (501, " "), (502, "few words"), (503, "Few  words"), (504, "other words")]
    given = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.similar(rows)
    assert 70 < len(set(want.values())) < len(rows)
    assert {r.id: r.component_id for r in simhash.similar_documents(given).collect()} == want
    kept = dict(corpus_pipeline.STAGES)["simhash"](spark, given, "")
    assert {r.doc_id for r in kept.collect()} == set(want.values())
    assert simhash.keep_one_similar(docs).columns == docs.columns
    assert simhash.keep_one_similar(empty).count() == 0


def test_similar_documents_come_by_simhash_first(spark, monkeypatch):
    """Without any bands, texts within the radius are linked if their shingles agree, and only then."""
    words = [f"w{k}" for k in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "end"])), (3, " ".join(reversed(words)))]
    monkeypatch.setattr(simhash, "band_keys", lambda found: np.zeros(0, np.int64))
    given = spark.createDataFrame(rows, "doc_id long, text string")
    prints = {i: simhash.majority(simhash.shingles(t.encode())) for i, t in rows}
    assert (prints[1] ^ prints[2]).bit_count() <= simhash.RADIUS
    assert {r.id: r.component_id for r in simhash.similar_documents(given).collect()} == {1: 1, 2: 1, 3: 3}
    far = simhash.similar_documents(given, least=0.999)
    assert {r.id: r.component_id for r in far.collect()} == {1: 1, 2: 2, 3: 3}


def test_similar_documents_in_crowded_buckets(spark, monkeypatch):
    """A group of near copies, a chain, documents on one template that are no copies, repeated rows: whole buckets and parts of them give the same links."""
    rng = np.random.default_rng(12)
    base = [f"w{x}" for x in rng.integers(0, 100_000, 300)]
    texts = []
    for k in range(60):
        words = list(base)
        for at in rng.choice(40, k % 6, replace=False):
            words[7 * at] = f"x{k}"
        texts.append(" ".join(words))
    for k in range(25):  # each five words further than the one before
        texts.append(" ".join([*base[: 300 - 8 * k], *(f"c{x}" for x in range(8 * k))]))
    for k in range(40):  # three quarters are the template's
        texts.append(" ".join([*base[:225], *(f"own{k}_{x}" for x in range(75))]))
    texts += [texts[3], texts[-1]]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    given = spark.createDataFrame([*rows, rows[5]], "doc_id long, text string")
    want = brute.similar(rows)
    assert 5 < len(set(want.values())) < len(rows) - 60
    for members, shingle_count, turns in ((2000, 4_000_000, 2), (6, 4_000_000, 2), (2000, 1500, 1), (5, 4_000_000, 0)):
        monkeypatch.setattr(simhash, "ASKING_TURNS", turns)
        got = simhash.similar_documents(given, most_members=members, most_shingles=shingle_count)
        assert {r.id: r.component_id for r in got.collect()} == want


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(400 + k, 401 + k) for k in range(40)]
    found = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute.components({x for e in edges for x in e}, edges)
    assert {n: found.get(n, n) for n in want} == want


def test_secrets(docs, texts, empty):
    got = by_id(secret_scan.scan_documents(docs))
    for i, t in texts:
        spans = [(s.kind, s.start, s.stop) for s in got[i].spans]
        base = [s for s in spans if s[0] != "literal"]
        assert ([sum(k == kind for k, _, _ in base) for kind in secret_scan.KINDS[:3]], secret_scan.digest(base)) == brute.secrets(t or "")
        assert all(s.value == t[s.start : s.stop] for s in got[i].spans)
    assert secret_scan.scan_documents(empty).count() == 0


@pytest.mark.parametrize("text, want", [('k = "Zx9-Kq2LmW81vT"\npassword = k', ["Zx9-Kq2LmW81vT"]), ('db_secret: "ab12CD34-" + "ef56GH78+"', ["ab12CD34-", "ef56GH78+"]), ('password = "changeme"', []), ("colour = Zx9Kq2LmW81vT", []), ('{"apiKey": "q8W-e7R6t5Y4u3"}', ["q8W-e7R6t5Y4u3"])])
def test_assignments(text, want):
    assert [text[s:e] for s, e in secret_scan.literal_spans(text)] == want


V = "q8W-e7R6t5Y4u3"


@pytest.mark.parametrize(
    "text",
    [
        f'password = """{V}"""',
        f"secret = `{V}`",
        f'token = f"{V}"',
        f'TOKEN: string = "{V}"',
        f'const TOKEN: Optional[str] = "{V}";',
        f'char* db_password = "{V}";',
        f'config["password"] = "{V}"',
        f'os.environ.get("API_TOKEN", "{V}")',
        f'props.put("api.key", "{V}");',
        f'client.setPassword("{V}")',
        f"<password>{V}</password>",
        f'<add key="db-secret" value="{V}"/>',
        f'secret = base64.b64decode("{V}")',
        f'password = os.getenv("DB") or "{V}"',
        f'let token = process.env.X || "{V}"',
        f"password = KEY\nKEY = '{V}'",
        f"a = '{V}'\nb = a\nc = b\nself.token = conf.c",
        f'{{"a": 1, "access_token" : "{V}"}}',
        f"{{'secret' => '{V}'}}",
        f"export AUTH_TOKEN={V}",
        f"password: {V} # of the test machine",
        f'{"very_" * 60}long_password = "{V}"',
        f"secret := '{V[:6]}' + \"{V[6:]}\"",
        f"secret = '{V[:6]}' '{V[6:]}'",
        f"password: |\n  {V}\nuser: me",
        f"db:\n  secret: >-\n    {V[:6]}\n    {V[6:]}\n  user: me",
        f"config.yaml: |\n  password: {V}\n",
        f'token = \\\n    "{V}"',
        f'token = "{V[:6]}" \\\n    "{V[6:]}"',
        f'token = live ? "{V}" : "no"',
        f'token = isLive() ? other : "{V}"',
        f'token = "{V}" if live else None',
        f"url=https://host/?token={V}&user=me",
        f'token = decode(strip("{V}"))',
        f'head = "{V[:6]}"\ntoken = head + "{V[6:]}"',
    ],
)
def test_source_and_configuration(text):
    assert "".join(text[s:e] for s, e in secret_scan.literal_spans(text)) == V


@pytest.mark.parametrize("text", ['secret = base64.b64decode(data)', "token = settings.Token8Name9x", 'password = os.environ["Xy7-abcDEF12"]', 'key = get("Token8-Name9x")', "token == 'q8W-e7R6t5Y4u3'", f"note = '{V}'", "password = a\na = password", "token: https://Host8.example/Ab9", 'password = "', "(" * 5000, "a-" * 50_000, "token = " * 3000])
def test_what_is_no_literal(text):
    assert secret_scan.literal_spans(text) == []


@pytest.mark.parametrize(
    "text",
    [
        lambda n: 'f("a", (' * (n // 8),
        lambda n: "".join(f"token_{k} = token_{k + 1}\n" for k in range(n // 24)),
        lambda n: "".join(f'a{k + 1} = a{k} + "xY{k}"\n' for k in range(n // 20)) + f"token = a{n // 20}",
        lambda n: "a=b+" * (n // 4),
        lambda n: "a=b + " * (n // 6),
        lambda n: "token=" * (n // 6),
        lambda n: "x:y[" * (n // 4),
        lambda n: "token=f(" * (n // 8),
        lambda n: "token = a ? " * (n // 12),
        lambda n: "".join(" " * (k % 50) + "token: |\n" for k in range(n // 35)),
        lambda n: "f(`" * (n // 3),
        lambda n: 'password = "' + "<" * n + '"',
    ],
)
def test_secrets_take_time_that_grows_with_the_text(text):
    took = []
    for n in (100_000, 400_000):
        began = time.process_time()
        secret_scan.literal_spans(text(n))
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 1 and took[1] < 8


NAMES = ["x-api-key", "api.key", "api-key", "api_key", "apikey", "APIKEY", "signing_key", "signingkey", "signing-key", "pass_key", "passKey", *(n for n, w in secret_scan.NAME_WEIGHT.items() if w >= secret_scan.LEAST_SCORE), *secret_scan.KEY_NAMES]


@pytest.mark.parametrize("name", NAMES)
def test_each_sensitive_name_alone(name):
    for text in (f"{name}: q8W-e7R6t5Y4u3", f'{name} = "q8W-e7R6t5Y4u3"'):
        assert [text[s:e] for s, e in secret_scan.literal_spans(text)] == ["q8W-e7R6t5Y4u3"]


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    _, least, scores = quality.fit(docs, labels.where(half))
    kept = scores.where(F.col("__key") >= least).select(F.col("id").alias("doc_id"), F.lit(1).alias("kept"))
    rest = labels.where(~half).join(kept, "doc_id", "left").join(docs.select("doc_id", "lang"), "doc_id")
    share = {(r.quality, r.toxic): r.k for r in rest.where("lang = 'en'").groupBy("quality", "toxic").agg(F.avg(F.coalesce("kept", F.lit(0))).alias("k")).collect()}
    assert share[1, 0] > 0.97 and share[1, 1] < 0.1 and share[0, 0] < 0.4


def test_quality_edges(spark, docs, empty):
    labels = spark.createDataFrame([(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert quality.keep_good(empty, labels).count() == 0


def test_quality_copies_count_once(spark):
    """Words that many rejected texts share tell; those of one text with a vast number of copies do not, whether labelled or not."""
    rng = np.random.default_rng(31)
    text = lambda: " ".join(f"w{x}" for x in rng.integers(0, 5000, 40))
    bad = [f"{text()} dreadful {text()}" for _ in range(124)]
    rows = [(k, t) for k, t in enumerate([text() for _ in range(1500)] + bad + [text() + " peculiar"] * 900)]
    ratio = quality.log_ratios(quality.counts(spark.createDataFrame(rows, "doc_id long, text string"), np.arange(1500), "doc_id", "text"))
    for word, judged in (("dreadful", True), ("peculiar", False)):
        h, doc = quality.words(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word)]))
        assert (quality.weights(h, doc, 1, ratio)[0] < 0) == judged


def test_quality_against_plain_counts(spark, docs, texts):
    """Counts, weights and the sample against dictionaries of whole words, without buckets."""
    short = [(i, (t or "")[:200]) for i, t in texts]
    good = np.array(sorted(i for i, _ in short)[::2])
    ratio = quality.log_ratios(quality.counts(spark.createDataFrame(short, "doc_id long, text string"), good, "doc_id", "text"), dead_zone=0.1, deviations=0.5)
    want = brute.importance_weights(short, set(good.tolist()), 2.0, 0.1, 0.5)
    got = {}
    for i, t in short:
        data = t.encode()
        got[i] = quality.weights(*quality.words(np.frombuffer(data, np.uint8), np.array([0, len(data)])), 1, ratio)[0]
    assert np.std(list(want.values())) > 0.5
    assert np.corrcoef([got[i] for i in want], [want[i] for i in want])[0, 1] > 0.99  # some n-grams share buckets
    labels = spark.createDataFrame([(int(i), int(i in set(good.tolist())), 0) for i, _ in texts], "doc_id long, quality int, toxic int")
    _, least, scores = quality.fit(docs, labels, k=30)
    keys = sorted((r["__key"] for r in scores.collect()), reverse=True)
    assert least == keys[29]


def test_quality_clashing_columns(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    rows = [(1, "a good text", 5, 6, 7), (2, "bad bad ###", 5, 6, 7), (2, "bad bad ###", 5, 6, 7), (3, None, 5, 6, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __key int, __log_weight int, extra0 int")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r["__key"] for r in kept.collect()} == {5}


def test_kth_largest(spark):
    values = np.random.default_rng(0).normal(size=5000).round(2)
    df = spark.createDataFrame([(float(x),) for x in values], "x double")
    for k in (1, 2, 700, 5000):
        assert quality.kth_largest(df, "x", k) == np.sort(values)[-k]


def test_tiling_covers_reordered_passages(spark, empty):
    words = [f"w{k}" for k in range(40)]
    item = " ".join(words)
    moved = " ".join(["start", *words[20:], "middle of it", *words[:20], "end"])
    part = "so " + " ".join(words[:12])
    docs = spark.createDataFrame([(1, moved), (2, part), (3, item.upper()), (4, None), (5, ""), (None, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "too short")], "item_id long, text string")
    found = {r.id: r for r in decontaminate.contaminations(docs, bench).collect()}
    assert set(found) == {1, 3, None}
    assert sorted((t.item_start, t.doc_start, t.words) for t in found[1].tiles) == [(0, 24, 20), (20, 1, 20)]
    assert found[1].coverage == 1.0
    assert {r.doc_id for r in decontaminate.keep_uncontaminated(docs, bench).collect()} == {2, 4, 5, None}
    assert decontaminate.contaminations(empty, bench).count() == 0


def test_greedy_tiles_by_hand():
    assert decontaminate.greedy_tiles([1, 2, 3, 4, 5, 6], [9, 4, 5, 6, -1, 1, 2, 3], 3) == [(0, 5, 3), (3, 1, 3)]
    assert decontaminate.greedy_tiles([1, 2, 3], [1, 2, 8, 3], 3) == []


def test_greedy_tiles_against_brute_force():
    rng = np.random.default_rng(14)
    for _ in range(200):
        item, doc = (rng.integers(1, 5, rng.integers(3, 40)).tolist() for _ in range(2))
        assert decontaminate.greedy_tiles(item, doc, 3) == brute.tiles(item, doc, 3)


def test_contaminations_against_brute_force(spark, monkeypatch):
    """Every document against every item, without seeds; in one block and in several."""
    rng = np.random.default_rng(15)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 30, n)]
    items = [(k, word(rng.integers(4, 25))) for k in range(12)]
    docs = []
    for d in range(60):
        parts = [word(6)]
        for k in rng.integers(0, 12, 2):
            a = rng.integers(0, 12)
            parts += [items[k][1][a:], items[k][1][:a], word(3)]
        docs.append((d, [w for p in parts for w in p]))
    want = {}
    for d, text in docs:
        for k, item in items:
            covered = sum(n for _, _, n in brute.tiles(item, text, 5))
            if covered and covered >= 0.5 * len(item):
                want[d, k] = covered
    assert len(want) > 20
    given = spark.createDataFrame([(d, " ".join(t), 1, 2) for d, t in docs], "doc_id long, text string, item int, covered int")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in items], "item_id long, text string")
    for most in (decontaminate.BLOCK_BYTES, 400):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", most)
        found = decontaminate.contaminations(given, bench).collect()
        assert len(found) == len(want) and {(r.id, r.item): r.covered for r in found} == want
    kept = decontaminate.keep_uncontaminated(given, bench)
    assert kept.columns == given.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_characters_are_words_in_scripts_without_spaces(spark):
    item = "床前明月光疑是地上霜"
    docs = spark.createDataFrame([(1, "他念：" + item + "。"), (2, "床前明月"), (3, "疑是地上霜，床前明月光")], "doc_id long, text string")
    found = {r.id: (r.covered, r.item_words) for r in decontaminate.contaminations(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert found == {1: (10, 10), 3: (10, 10)}


def test_token_counts(docs, texts, empty):
    import sentencepiece

    path = queries.tokenizer_file("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = by_id(token_counts.token_counts(docs, path))
    extra = ["a  b", " lead", "▁a ▁", "<s> </s>", "a\tb \n c"]
    for i, t in texts:
        assert (got[i].n_bytes, got[i].n_tokens) == (len((t or "").encode()), len(model.encode(t or "")))
    assert token_counts.RunLengths(path).counts(extra) == [len(model.encode(t)) for t in extra]
    assert token_counts.token_counts(empty, path).count() == 0


def test_packing(docs, texts, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    ids = {i: brute.token_ids(tokenizer, t) for i, t in texts}
    once = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = [r.asDict() | {"doc_id": r.id} for r in packing.pack_documents(once, path, with_ids=True).collect()]
    assert brute.check_packing(rows, ids) < 0.2
    assert all(r["ids"] == ids[r["id"]][r["start"] : r["start"] + r["length"]] for r in rows)
    assert sum(r.length for r in packing.pack_documents(docs, path).collect()) > sum(map(len, ids.values()))
    assert packing.pack_documents(empty, path).count() == 0


@pytest.mark.parametrize("known", [300, packing.KNOWN_WORDS])
def test_word_ids_equal_the_tokenizers(monkeypatch, known):
    """Combining marks, special strings, odd white space and capitals; with a table too small for all words, too."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "KNOWN_WORDS", known)
    path = queries.tokenizer_file("word_bpe_49k.json")
    tokenizer, words = Tokenizer.from_file(path), packing.WordIds(path)
    letters = np.array(list("aBcJ TI'sS.,!<|>endoft\u030c\u0307\u0301\u0308ÀéßÖ\x0b\x1c\x85\xa0\u212aİ9-_日"))
    rng = np.random.default_rng(5)
    texts = ["", "J\u030c T\u0308", "<|endoftext|> <|EndOfText|> A<|STARTOFTEXT|>,", "Don'T it'S, WORD!!,word?! ÀÉ!", "x" * 5000 + " " + "Ab," * 3000]
    texts += ["".join(letters[rng.integers(0, len(letters), rng.integers(1, 25))]) for _ in range(3000)]
    assert all(words.ids(t.encode()).tolist() == tokenizer.encode(t, add_special_tokens=False).ids for t in texts)
    assert len(words.at) <= known


def test_first_fit_decreasing():
    sizes = np.sort(np.random.default_rng(2).integers(1, 100, 300))[::-1]
    bins, offsets, used = packing.first_fit_decreasing(sizes, 100)
    room = []
    for size, b, o in zip(sizes, bins, offsets, strict=True):
        k = next((k for k, r in enumerate(room) if r >= size), len(room))
        if k == len(room):
            room.append(100)
        assert (b, o) == (k, 100 - room[k])
        room[k] -= size
    assert used == len(room)


def test_warc(spark, empty, tmp_path):
    page = "<p>" + "é" * 800 + "</p>"
    rows = [(1, "http://a/\n1", page), (5, None, page), (3, "u", page), (4, "u", "short"), (6, "u", "short"), (7, "u", None), (8, "u", "a\r\n\r\nWARC/1.0\r\n\r\n" * 90), (None, "u", page + "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: tuple(r)[1:] for r in warc.archived_pages(pages).collect()}
    for i, _, html in rows:
        data = (html or "").encode()
        kind, refers = ("revisit", 5) if html == page and i != 5 else ("response", None)
        assert got[i] == (len(data), hashlib.sha1(data).hexdigest(), kind, refers)
    assert warc.archived_pages(pages.limit(0)).count() == 0


def test_warc_repeated_and_odd_rows(spark):
    """Repeated rows, ties of ids, clashing names and a very long payload."""
    long = "<b>" + "z\r\n" * 700_000
    rows = [(1, "u", long, 1, "x"), (1, "u", long, 1, "x"), (2, "u", long, 1, "x"), (2, "u", long, 1, "x"), (None, "u", long, 1, "x"), (3, "u", "x" * 1000, 1, "x")]
    got = warc.archived_pages(spark.createDataFrame(rows, "page_id long, url string, html string, size int, digest string")).collect()
    assert sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in got) == [(0, len(long), "revisit", 2)] + [(1, len(long), "revisit", 2)] * 2 + [(2, len(long), "response", None)] * 2 + [(3, 1000, "response", None)]


def test_embeddings_repeated_rows_and_clashing_names(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0, 9, "x"), (1, v, 0, 9, "x"), (2, [2.0, 4.0, 6.0], 0, 9, "x"), (None, v, 0, 9, "x"), (4, v, 1, 9, "x")]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n int, key string")).collect()
    assert sorted((r.id or 0, r.n_links, r.component_id) for r in got if r.id) == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (4, 0, 4)]


def test_normaliser_round_trip(tmp_path):
    import gzip
    import json

    one = lambda k: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:{k}>\r\nContent-Length: {k}\r\n\r\n".encode() + b"z" * k + b"\r\n\r\n"
    sizes = [0, 5, 3_000_000, 1]
    whole = b"".join(map(one, sizes))
    (tmp_path / "a.gz").write_bytes(gzip.compress(whole[:100]) + gzip.compress(whole[100:]))
    out, idx = f"file://{tmp_path}/o/a.warc.gz", f"file://{tmp_path}/i/a.jsonl"
    assert warc.normalise(f"file://{tmp_path}/a.gz", out, idx) == 4
    first = (tmp_path / "o/a.warc.gz").read_bytes()
    assert warc.normalise(f"file://{tmp_path}/a.gz", out, idx) == 4  # a second attempt
    data = (tmp_path / "o/a.warc.gz").read_bytes()
    assert data == first and sorted(x.name for x in (tmp_path / "o").iterdir()) == ["a.warc.gz"]
    index = [json.loads(x) for x in (tmp_path / "i/a.jsonl").read_text().splitlines()]
    assert [gzip.decompress(data[x["offset"] : x["offset"] + x["length"]]) for x in index] == [one(k) for k in sizes]
    with pytest.raises((EOFError, ValueError)):
        (tmp_path / "b.gz").write_bytes(gzip.compress(whole)[:-20])
        warc.normalise(f"file://{tmp_path}/b.gz", out, idx)


def test_suffix_dedup(docs, texts, empty):
    got = by_id(suffix_dedup.digests(suffix_dedup.removals(docs)))
    assert {i: tuple(got[i])[1:] for i, _ in texts} == brute.repeats(texts)
    assert suffix_dedup.removals(empty).count() == 0


def test_suffix_dedup_edge_rows(spark, empty):
    """Null ids, repeated rows, one id with two texts, clashing columns; copies of copies."""
    rng = np.random.default_rng(10)
    base = "".join(map(chr, rng.integers(97, 123, 1500)))
    rows = [(5, base), (5, base), (None, base[200:900]), (None, base[200:900]), (None, "other " + base[:150]), (7, base[100:800] + "#" + base[:400]), (9, base[100:800]), (11, None), (12, ""), (4, base[300:500])]
    docs = spark.createDataFrame([(i, t, 1, b"x", 2) for i, t in rows], "doc_id long, text string, kind int, t binary, dest int")
    got = suffix_dedup.digests(suffix_dedup.removals(docs)).collect()
    assert len(got) == len(rows)
    known = [(i, t) for i, t in rows if i is not None]
    want = brute.repeats([(-2, base[200:900]), (-1, "other " + base[:150]), *dict(known).items()])
    for r in got:
        if r.id is not None:
            assert tuple(r)[1:] == want[r.id]
    assert sorted(r.n_removed for r in got if r.id is None)[:2] == [0, 0]


def test_suffix_dedup_notices_colliding_hashes(spark, monkeypatch):
    real = suffix_dedup.intervals

    def colliding(*a):
        *rest, t, t2 = real(*a)
        return *rest, t * 0, t2 * 0

    monkeypatch.setattr(suffix_dedup, "intervals", colliding)
    rng = np.random.default_rng(11)
    one, two, three = ("".join(map(chr, rng.integers(97, 123, 400))) for _ in range(3))
    docs = spark.createDataFrame([(1, one + three), (2, two + three)], "doc_id long, text string")
    with pytest.raises(Exception, match="equal hashes of different bytes"):
        suffix_dedup.removals(docs).count()


def test_suffix_order():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    at = np.sort(rng.choice(2900, 700, replace=False))
    group = np.repeat([0, 1, 2], [1, 300, 399])
    order, lcp = suffix_dedup.suffix_order(data, at, group, np.arange(len(at)), 40)
    text = data.tobytes()
    want = sorted(range(len(at)), key=lambda k: (group[k], text[at[k] : at[k] + 40], k))
    assert order.tolist() == want
    for k in range(1, len(at)):
        a, b = text[at[order[k - 1]] : at[order[k - 1]] + 40], text[at[order[k]] : at[order[k]] + 40]
        n = next((i for i in range(40) if a[i] != b[i]), 40) if group[k] == group[k - 1] else 0
        assert lcp[k] == n


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LONG_BYTES", 700)
    rng = np.random.default_rng(9)
    base = "".join(map(chr, rng.integers(97, 123, 3000)))
    rows = [(1, base), (2, base[500:2600] + "!" + base[:300]), (3, "ab" * 900)]
    got = by_id(suffix_dedup.digests(suffix_dedup.removals(spark.createDataFrame(rows, "doc_id long, text string"))))
    assert {i: tuple(got[i])[1:] for i, _ in rows} == brute.repeats(rows)


def test_line_dedup(spark, empty):
    a = [f"line number {k} of the first text" for k in range(8)]
    rows = [
        (1, "\n".join(a)),
        (2, "\n".join(["its own start of it all", *a[2:6], "its own end of it all"])),
        (3, "\n".join(a)),
        (4, "short\nits own middle part here"),
        (5, "short\nanother own line of text"),
        (6, None),
        (7, ""),
        (8, "\n".join(["own first line of this one", a[5], a[1], "own last line of this one"])),
        (None, a[0]),
    ]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, n_chars long, h string")
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs, n_chars_col="n_chars").collect()}
    assert out[1].text == rows[0][1]
    assert out[2].text == "its own start of it all\nits own end of it all" and out[2].n_chars == len(out[2].text)
    assert 3 not in out
    assert (out[4].text, out[5].text, out[6].text, out[7].text) == (rows[3][1], rows[4][1], None, "")
    want = brute.line_deletions([(i, t) for i, t in rows if i is not None])  # 8 has its lines in another order: each pair aligns one of them
    assert out[8].text == "\n".join(x for k, x in enumerate(rows[7][1].split("\n")) if k not in want[8])
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_aligns_copies_whatever_holds_their_lines_first(spark):
    """Exact copies and passages with repeated and reordered lines, against patience diff of all pairs."""
    p, q, r, s = (f"the line {c} has quite some words" for c in "pqrs")
    rows = [(1, [p, q, p]), (2, [p, q, p]), (10, [s, r, q, p, q]), (11, [p, q, r, s]), (12, [p, q, r, s]), (20, ["own words stand here at first", p, q, r, s, "own words stand here at last"])]
    rng = np.random.default_rng(11)
    for k in range(40):  # originals and their copies, of few lines
        text = [f"line {x} of a small set of lines" for x in rng.integers(0, 25, rng.integers(1, 9))]
        rows += [(100 + 2 * k, text), (101 + 2 * k, list(text))]
    docs = spark.createDataFrame([(i, "\n".join(t)) for i, t in rows], "doc_id long, text string")
    out = {r.doc_id: r.text.split("\n") for r in line_dedup.dedup_lines(docs).collect()}
    want = brute.line_dedup(rows)
    assert all(i not in out for i, t in rows if any(j < i and t == u for j, u in rows))
    assert out[20] == want[20] == [rows[5][1][0], rows[5][1][-1]]
    assert all(set(want.get(i, [])) <= set(out.get(i, [])) for i, _ in rows)  # nothing goes that no pair aligns


def test_line_dedup_over_blank_lines(spark):
    poem = [f"verse {k} is short" for k in range(15)]
    gaps = "\n\n".join(poem)
    rows = [(1, gaps), (2, "own start of the second text\n\n" + "\n \n\n".join(poem) + "\n\nown end of the second text"), (3, gaps), (4, "\n".join(poem))]
    rows += [(5, "a first line of text\n\nverse 3 is short\n\na last line of text"), (6, "\n\n" + gaps + "\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert out == {1: gaps, 2: "own start of the second text\n\n\nown end of the second text", 5: rows[4][1]}


def test_line_dedup_against_all_pairs(spark):
    """Over a whole table: nothing goes that no pair aligns, and at least 0.98 of what the pairs align goes."""
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()]
    got = {r.id: set(r.gone) for r in line_dedup.deletions(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute.line_deletions(rows)
    found = sum(len(got.get(i, set()) & x) for i, x in want.items())
    assert sum(map(len, got.values())) == found
    assert found >= 0.98 * sum(map(len, want.values())) > 0


def test_line_dedup_clashing_columns_and_repeats(spark):
    line = "a line that both of the documents have"
    rows = [(1, line, 7, 8, 9), (2, line + "\nand one of its own as well", 7, 8, 9), (2, line + "\nand one of its own as well", 7, 8, 9), (None, line, 7, 8, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __n_gone int, extra0 int, partners int")
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text, r.extra0) for r in out.collect()) == [(0, line, 8), (1, line, 8), (2, "and one of its own as well", 8), (2, "and one of its own as well", 8)]


def test_patience_diff():
    rng = np.random.default_rng(12)
    for _ in range(300):
        a, b = (rng.integers(0, 8, rng.integers(0, 12)).tolist() for _ in range(2))
        both = set(a) & set(b)
        a, b = [x for x in a if x in both], [x for x in b if x in both]
        assert sorted(line_dedup.align(a, b)) == sorted(brute.patience(a, b))


def test_longest_increasing():
    assert [[3, 1, 2, 5, 4][i] for i in line_dedup.longest_increasing([3, 1, 2, 5, 4])] in ([1, 2, 4], [1, 2, 5])
    assert line_dedup.longest_increasing([]) == []


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(30, 64))
    v = np.concatenate([centre + s * rng.normal(size=(30, 64)) for s in (0, 0.1, 0.25, 0.33)])
    rows = [(k, [float(x) for x in r], int(k % 2)) for k, r in enumerate(v)]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 0), (202, rows[0][1], 1), (203, None, 0), (204, [0.0] * 64, 0), (205, [float("nan")] + [1.0] * 63, 0), (206, rows[0][1], None), (207, [None] + [1.0] * 63, 0), (208, [], 0), (209, [1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == brute.embeddings([r for r in rows if r[0] != 209]) | {209: (0, 209)}
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_recall_in_many_tables_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BUCKET", 8)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    rng = np.random.default_rng(6)
    one = rng.normal(size=64)
    v = np.concatenate([rng.normal(size=(200, 64)), one + 0.2 * rng.normal(size=(300, 64))])
    rows = [(k, [float(x) for x in r], 0) for k, r in enumerate(v)]
    got = {r.id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    want = brute.embeddings(rows)
    assert all(got[k][0] <= want[k][0] for k in want)
    assert sum(n for n, _ in got.values()) >= 0.95 * sum(n for n, _ in want.values())


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rotated, signs, factor = embedding_dedup.codes(x, embedding_dedup.rotation(64, 1))
    guess, bound = embedding_dedup.estimates(rotated, signs, factor)
    off = ~np.eye(400, dtype=bool)
    error = (guess - x @ x.T)[off]
    assert abs(error.mean()) < 0.002
    assert (np.abs(guess - x @ x.T) <= bound[:, None])[off].mean() > 0.9999


def test_arrow_batches_are_bounded(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    for given, want in (("64m", common.ARROW_BYTES), ("1048576", 1 << 20), ("3m", 3 << 20)):
        spark.conf.set(name, given)
        common.small_batches(spark)
        assert common.byte_count(spark.conf.get(name)) == want
    spark.conf.unset(name)


def test_long_hash_is_sparks(spark):
    values = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 50)
    rows = spark.createDataFrame([(int(v),) for v in [*values, 0, -1, -(1 << 63)]], "x long").select("x", F.xxhash64("x").alias("h")).collect()
    assert common.long_hash(np.array([r.x for r in rows])).view(np.int64).tolist() == [r.h for r in rows]


def test_suffix_order_of_large_groups():
    rng = np.random.default_rng(6)
    data = np.concatenate([rng.integers(97, 99, 2000).astype(np.uint8), np.full(3000, 97, np.uint8)])
    at = np.sort(rng.choice(4900, 3500, replace=False))
    order, _ = suffix_dedup.suffix_order(data, at, np.zeros(len(at), int), np.arange(len(at)), 60)
    text = data.tobytes()
    assert order.tolist() == sorted(range(len(at)), key=lambda k: (text[at[k] : at[k] + 60], k))
