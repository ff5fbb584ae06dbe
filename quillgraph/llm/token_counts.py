"""Token counts by a public sentencepiece model, lengths only.

No piece of the model has a word-start mark after another character, so the encoding of a text is that of its
runs of spaces and following non-spaces, each on its own: a safe boundary stands before each such run.
Texts are cut there, the distinct runs of a batch that are not yet known are encoded together in lists balanced by bytes, and a bounded
table of lengths is kept per worker. Models for which the property fails are detected on loading and whole texts are encoded.

Rows: null text counts as empty (0 tokens); null ids keep their rows; repeated rows get equal results; extra columns, whatever their names, are ignored. A very long text is counted whole, in runs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_column, tidy

#: Runs whose length a worker keeps: the first it meets, the frequent ones among them; others are encoded each time.
KNOWN_RUNS = 250_000
#: Bytes of text whose runs are encoded together.
BATCH_BYTES = 4 << 20
#: Runs longer than this are not kept.
KEPT_CHARS = 64
#: What stands for a space in pieces.
MARK = "▁"
_RUNS = re.compile(" +[^ ]*")
_models: dict[str, "RunLengths"] = {}


class RunLengths:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        plain = [MARK + x for x in self.model.encode(["a", " a"], out_type=str)[0]]
        self.splits = not any(MARK in p.lstrip(MARK) for p in pieces) and plain == [MARK + MARK + "a"]
        #: A lone space's run is its mark alone, which cannot be encoded as the text after it: there is none.
        self.known: dict[str, int] = {"": len(self.model.encode("a ")) - len(self.model.encode("a"))}

    def _learn(self, runs: list[str]) -> dict[str, int]:
        out = {}
        for s, e in slices(map(len, runs), 1 << 20):
            out.update(zip(runs[s:e], map(len, self.model.encode(runs[s:e], num_threads=1)), strict=True))
        return out

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; their distinct runs are looked up or encoded together."""
        out, split = [0] * len(texts), {}
        for i, text in enumerate(texts):
            if not self.splits or MARK in text:
                out[i] = len(self.model.encode(text, num_threads=1))
            elif text:
                split[i] = text.split(" ")
                if "" in split[i]:
                    split[i] = [x[1:] for x in _RUNS.findall(" " + text)]
        distinct, known = set().union(*split.values()), self.known
        learned = self._learn([x for x in distinct if x not in known])
        short = {x: n for x, n in learned.items() if len(x) <= KEPT_CHARS}
        known.update(islice(short.items(), max(0, KNOWN_RUNS - len(known))))
        table = known if all(x in known for x in learned) else {x: learned[x] if x in learned else known[x] for x in distinct}
        for i, runs in split.items():
            out[i] = sum(map(table.__getitem__, runs))
        return out


def _model(path: str) -> RunLengths:
    if path not in _models:
        _models[path] = RunLengths(path)
    return _models[path]


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes long, n_tokens long): one row per document."""

    @tidy
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(model_path)
        for b in it:
            texts = b.column(1)
            size = pa.compute.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            tokens: list[int] = []
            for s, e in slices(size, BATCH_BYTES):
                tokens += model.counts(texts[s : e].to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(tokens, pa.int64())], ["id", "n_bytes", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_column(docs, text_col).alias("t")).mapInArrow(run, "id long, n_bytes long, n_tokens long")
