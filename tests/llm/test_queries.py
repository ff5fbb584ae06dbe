"""Every query of the subpackage over whole small tables, against plain versions: rows, columns and types."""

import hashlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

import brute
from quillgraph.llm import quality, queries, secret_scan

SF = "/root/testdata/sf0.001"
TYPES = {
    "op1_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op2_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op3_quality": "doc_id bigint, log_weight double, sample_key double, kept boolean",
    "op4_decontamination": "doc_id bigint, item_id bigint, n_tiles bigint, covered_words bigint, item_words bigint, coverage double",
    "op5_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op6_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op7_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op8_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op9_line_dedup": "doc_id bigint, n_lines bigint, n_removed bigint, n_partners bigint, kept_sha256 string",
    "op10_embeddings": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op11_hard_negatives": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
    "op12_filter_audit": "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint",
    "op13_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
}


def table(name, sf=SF):
    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def texts():
    return [(r["doc_id"], r["text"]) for r in table("documents")]


def rows(spark, name, sf=SF):
    df = queries.QUERIES[name](spark, sf)
    assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) == TYPES[name]
    return [tuple(r) for r in df.collect()]


def test_all_queries_have_types():
    assert set(TYPES) == set(queries.QUERIES)


def test_op1(spark, texts):
    want = brute.simhash(texts)
    assert sorted(rows(spark, "op1_simhash")) == sorted((i, *want[i]) for i, _ in texts)


def test_op2(spark, texts):
    got = {r[0]: r for r in rows(spark, "op2_secrets")}
    assert len(got) == len(texts)
    for i, t in texts:
        counts, sha = brute.secrets(t or "")
        assert list(got[i][1:4]) == counts and got[i][4] == sha
        spans = [x.split(":") for x in got[i][5].split(",") if x]
        order = [(int(s), secret_scan.KINDS.index(k)) for k, s, _ in spans]
        assert order == sorted(order)
        base = ",".join(":".join(x) for x in spans if x[0] != "literal")
        assert hashlib.sha256(base.encode()).hexdigest() == sha


def test_op3(spark, texts):
    got = rows(spark, "op3_quality", "/root/testdata/sf0.01")
    ids = {r["doc_id"] for r in table("documents", "/root/testdata/sf0.01")}
    kept = {r[0] for r in got}
    labels = {r["doc_id"]: r["quality"] == 1 and r["toxic"] == 0 for r in table("labels", "/root/testdata/sf0.01")}
    assert kept < ids and len(kept) == len(got) and all(r[3] for r in got)
    assert sum(i in kept for i, g in labels.items() if g) >= 0.99 * sum(labels.values())
    assert sum(i in kept for i, g in labels.items() if not g) <= 0.6 * sum(not g for g in labels.values())
    assert min(r[2] for r in got) > float("-inf")


def test_op3_against_plain_models(spark):
    """Weights, keys and the chosen set from dictionaries of whole words, with hashes and a cut of our own; buckets shared by words may move a few."""
    sf = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in table("documents", sf)]
    labels = [(r["doc_id"], r["quality"], r["toxic"]) for r in table("labels", sf)]
    w, keys, chosen = brute.importance_sample(docs, labels, quality.SHRINK, quality.DEAD_ZONE, quality.DEVIATIONS, 2, 7)
    got = {r[0]: r[1:] for r in rows(spark, "op3_quality", sf)}
    same = [i for i in got if abs(got[i][0] - w[i]) < 1e-3]
    assert len(same) >= 0.97 * len(got) and np.std(list(w.values())) > 1
    assert all(abs(got[i][1] - got[i][0] - (keys[i] - w[i])) < 1e-9 for i in got)  # the same draw of noise
    assert len(set(got) ^ chosen) <= 0.02 * len(chosen)


def test_op4(spark, texts):
    got = rows(spark, "op4_decontamination")
    items = {r["item_id"]: " ".join((r["text"] or "").split()) for r in table("benchmark")}
    whole = {(d, i) for d, t in texts for i, x in items.items() if len(x.split()) >= 5 and x in " ".join((t or "").split())}
    assert whole and whole <= {r[:2] for r in got}
    assert all(r[3] <= r[4] and abs(r[5] - r[3] / r[4]) < 1e-12 and r[5] >= 0.5 for r in got)


def test_op5(spark, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_file("piece_bpe_32k.model"))
    want = [(i, len((t or "").encode()), len(model.encode(t or ""))) for i, t in texts]
    assert sorted(rows(spark, "op5_token_counts")) == sorted((*r, r[2] > 4096) for r in want)


def test_op7(spark, texts):
    want = brute.repeats(texts)
    assert sorted(rows(spark, "op7_suffix_dedup")) == sorted((i, *want[i]) for i, _ in texts)


def test_op8(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_file("word_bpe_49k.json"))
    names = [x.split()[0] for x in TYPES["op8_packing"].split(", ")]
    got = [dict(zip(names, r, strict=True)) for r in rows(spark, "op8_packing")]
    assert brute.check_packing(got, {i: brute.token_ids(tokenizer, t) for i, t in texts}) < 0.05


def test_op9(spark, texts):
    want = brute.line_deletions(texts)
    got = {r[0]: r for r in rows(spark, "op9_line_dedup")}
    same = 0
    for i, t in texts:
        lines = (t or "").split("\n")
        kept = "\n".join(x for k, x in enumerate(lines) if k not in want[i])
        assert got[i][1] == len(lines) and got[i][2] <= len(want[i])
        same += got[i][2] == len(want[i]) and got[i][4] == hashlib.sha256(kept.encode()).hexdigest()
    assert same >= 0.98 * len(texts)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, sf, name):
    db = duckdb.connect()
    for t in ("pages", "embeddings", "documents", "labels"):
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = db.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert [x.split()[0] for x in TYPES[name].split(", ")] == columns
    assert sorted(rows(spark, name, sf), key=repr) == sorted(want.fetchall(), key=repr)


def test_op10_against_brute_force(spark):
    got = {r[0]: r[1:] for r in rows(spark, "op10_embeddings")}
    want = brute.embeddings([(r["vec_id"], r["embedding"], r["label"]) for r in table("embeddings")])
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}
