import pyarrow.parquet as pq

import brute
import corpus_pipeline
from quillgraph.llm import queries
from quillgraph.llm.common import staged

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from tokenizers import Tokenizer

    docs = queries.table(spark, SF, "documents")
    before = {r.doc_id: r.text for r in docs.collect()}
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        rows = {r.doc_id: r.text for r in docs.collect()}
        assert set(rows) <= set(before)
        seen[name] = (before, rows)
        before = rows
    given, kept = seen["simhash"]
    assert set(kept) == set(brute.similar(sorted(given.items())).values())
    given, kept = seen["line_dedup"]
    for i, text in kept.items():  # only whole lines go
        left = iter((given[i] or "").split("\n"))
        assert text == given[i] or all(x in left for x in text.split("\n"))
    items = [r["text"] for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    assert not any(t in (x or "") for t in items for x in seen["decontamination"][1].values())
    tokenizer = Tokenizer.from_file(queries.tokenizer_file("word_bpe_49k.json"))
    packed = [r.asDict() for r in corpus_pipeline.run(spark, SF).collect()]
    brute.check_packing(packed, {i: brute.token_ids(tokenizer, t) for i, t in before.items()})


def test_stages_on_odd_tables(spark):
    """Nulls in any column, repeated rows, empty and very long texts, ties, clashing names; an empty table."""
    long = " ".join(f"word{k}" for k in range(60_000))
    given = spark.createDataFrame(
        [(1, "a line of text that stands in two documents\nand one of its own here", None, "s", 3, 1, 2, 3), (2, "a line of text that stands in two documents\nas does another that is long", "en", None, None, 1, 2, 3), (2, "a line of text that stands in two documents\nas does another that is long", "en", None, None, 1, 2, 3), (None, "no id at all", "en", "s", 4, None, None, None), (3, None, None, None, None, 1, 2, 3), (4, "", "en", "s", 0, 1, 2, 3), (5, long, "en", "s", 9, 1, 2, 3), (6, long + " end", "en", "s", 9, 1, 2, 3)],
        "doc_id long, text string, lang string, source string, n_chars long, extra0 int, gone int, __key int",
    )
    for docs in (given, given.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = staged(stage(spark, docs, SF), f"odd-{name}")
            assert docs.columns == given.columns, name
        rows = docs.collect()
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
        assert {r.doc_id for r in packed} == {r.doc_id for r in rows}
        if rows:
            kept = {r.doc_id: r for r in rows}
            assert set(kept) == {None, 1, 2, 3, 5} and len(rows) == 6  # 6 is near 5, 4 is empty like 3; rows of one id stay together
            assert kept[2].text == "as does another that is long" and kept[2].n_chars == len(kept[2].text) and kept[3].text is None
            assert sum(r.length for r in packed if r.doc_id == 5) > 60_000
