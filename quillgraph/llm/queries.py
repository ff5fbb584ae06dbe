"""Queries of this subpackage: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, embedding_dedup, filter_audit, hard_negatives, line_dedup, packing, quality, secret_scan, simhash, suffix_dedup, token_counts, warc
from .common import small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_documents(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
    many = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"] != "literal")
    return found.select(F.col("id").alias("doc_id"), many("assign"), many("access"), many("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, least, scores = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    kept = scores.where(F.col("__key") >= least)
    return kept.select(F.col("id").alias("doc_id"), F.col("__log_weight").alias("log_weight"), F.col("__key").alias("sample_key"), F.lit(True).alias("kept"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.size("tiles").cast("long").alias("n_tiles"), F.col("covered").alias("covered_words"), "item_words", "coverage")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.removals(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.rewritten(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_gone").alias("n_removed"), F.col("__partners").alias("n_partners"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(moved)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    decoded = byte_bpe.encode(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, back=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_secrets": op2_secrets,
    "op3_quality": op3_quality,
    "op4_decontamination": op4_decontamination,
    "op5_token_counts": op5_token_counts,
    "op6_warc": op6_warc,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_packing": op8_packing,
    "op9_line_dedup": op9_line_dedup,
    "op10_embeddings": op10_embeddings,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_filter_audit": op12_filter_audit,
    "op13_byte_bpe": op13_byte_bpe,
}

#: The other operators hash, tokenise, lex or align in ways that SQL does not have; their queries are held against plain versions in the tests.
ORACLE_SQL: dict[str, str] = {
    "op6_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        q AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
        r AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS newest FROM q)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN newest <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN newest <> page_id THEN newest END AS refers_to
        FROM r
    """,
    "op10_embeddings": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ),
        link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
        reach AS (SELECT vec_id AS node, vec_id AS other FROM embeddings UNION SELECT r.node, l.b FROM reach r JOIN link l ON l.a = r.other),
        least AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node),
        n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
        SELECT node AS vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, node = component_id AS kept FROM least LEFT JOIN n ON n.a = node
    """,
    "op11_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        pair AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
        ),
        positive AS (SELECT anchor_id, other_id, score FROM pair WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
        negative AS (
            SELECT p.anchor_id, p.other_id AS positive_id, p.score AS positive_score, n.other_id AS negative_id, n.score AS negative_score,
                   row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) AS rank
            FROM positive p JOIN pair n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
        )
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negative WHERE rank <= 3
    """,
    "op12_filter_audit": r"""
        WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
        said AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
        flag AS (
            SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                   CAST(len(words) < 100 AS INTEGER) AS a,
                   CAST(100 * len(list_distinct(words)) < 80 * len(words) AS INTEGER) AS b,
                   CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS INTEGER) AS c,
                   CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER) AS d,
                   CAST(coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false) AS INTEGER) AS e
            FROM w LEFT JOIN said ON said.doc_id = w.doc_id
        ),
        counted AS (SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flag GROUP BY ALL),
        letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
        ord AS (
            SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
            FROM letter a JOIN letter b ON b.l <> a.l JOIN letter c ON c.l NOT IN (a.l, b.l) JOIN letter d ON d.l NOT IN (a.l, b.l, c.l) JOIN letter e ON e.l NOT IN (a.l, b.l, c.l, d.l)
        ),
        step AS (
            SELECT filter_order, k AS step, 1 << (ascii(filter_order[k]) - 65) AS mine, list_sum([CASE WHEN j < k THEN 1 << (ascii(filter_order[j]) - 65) ELSE 0 END FOR j IN [1, 2, 3, 4, 5]]) AS before
            FROM ord, (SELECT unnest([1, 2, 3, 4, 5]) AS k)
        ),
        result AS (
            SELECT part, filter_order, step, mine,
                   sum(CASE WHEN failed & (before::BIGINT | mine) = 0 THEN n ELSE 0 END) AS kept,
                   sum(CASE WHEN failed & mine > 0 AND failed & before::BIGINT = 0 THEN n ELSE 0 END) AS removed,
                   sum(CASE WHEN failed & mine > 0 AND failed & before::BIGINT > 0 THEN n ELSE 0 END) AS redundant,
                   sum(CASE WHEN failed = mine THEN n ELSE 0 END) AS unique_fails,
                   sum(CASE WHEN failed & mine > 0 AND failed & before::BIGINT = 0 THEN good ELSE 0 END) AS good_lost,
                   sum(CASE WHEN failed & mine > 0 AND failed & before::BIGINT = 0 THEN toxic ELSE 0 END) AS toxic_lost
            FROM counted, step GROUP BY ALL
        )
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
               CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, mine) AS BIGINT) AS shapley
        FROM result
    """,
}
