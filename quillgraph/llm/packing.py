"""Packing of tokenised documents into sequences: first-fit decreasing with a tournament tree of bin capacities.

A document's ids (its tokens and an end id) are cut at multiples of the sequence length. Full pieces are sequences of their own; the
remainders of a random group of documents are placed, longest first, each into the first open sequence that has room.
The tournament tree holds the largest room of each subtree, so that sequence is found in logarithmic time.
Groups are drawn by a seeded hash and packed independently: the largest amount of work in a task is one group, of a
fixed expected size, and only piece lengths are shuffled, never ids or texts.

Tokenising: the tokenizer drops white space and no token spans it, so a text's ids are those of its
words, one by one. A worker keeps the ids of the words it meets first, the frequent ones among them, in a bounded table, and encodes others
each time; plain Latin words go to the tokenizer's merges without its other steps, their letters and closing signs as units of their own.

Rows: null text is empty text and yields the end id alone; repeated rows are packed each for itself; a null id is kept as null. Pieces of equal length are placed by checksum, id and start, so a group's packing does not depend on the order of its rows.
A very long text is encoded whole by one task and cut into as many pieces as it takes. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tasks_of, text_column, tidy

SEQUENCE_TOKENS, END_ID = 4096, 2
#: Expected documents in a group.
GROUP_DOCS = 16_384
KNOWN_WORDS = 400_000
KEPT_CHARS = 64
_WORDS = re.compile(b"[^ \t\n\r]+")
#: Latin letters in UTF-8, then closing signs.
_PLAIN = re.compile(b"((?:[a-zA-Z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])*)([!-&(-/:;=-@\\[-`{-~]*)\\Z")
#: Byte-level spelling: printable Latin-1 characters stand for their byte, the others follow from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SPELLING = {b: chr(b) for b in _PRINTED} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_tokenizers: dict[str, "WordIds"] = {}


class WordIds:
    """Ids of whole texts through a table of the ids of their words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()

        self.model = self.tokenizer.model
        spelled = json.loads(self.tokenizer.to_str())
        kinds = [x["type"] for x in spelled["pre_tokenizer"].get("pretokenizers", [])] if spelled["pre_tokenizer"] else []
        self.lowers = "Lowercase" in [x["type"] for x in (spelled["normalizer"] or {}).get("normalizers", [])]
        #: Whether the tokenizer drops all six of the white space that bytes.split() cuts at.
        self.splits = all(self._whole(f"a{c}b") == self._whole("a") + self._whole("b") for c in " \t\n\r\x0b\x0c")
        #: Whether plain words may go to the merges directly; checked against the whole tokenizer on words of every kind.
        self.direct = self.lowers and kinds == ["Split", "ByteLevel"] and all([i for u in _PLAIN.match(w.encode()).groups() for i in self._unit(u)] == self._whole(w) for w in ("Word", "word,", "Éàß...", "!!", "ÑÖø|", "a_-", "x#*$%&", "ÿ"))
        self.at: dict[bytes, int] = {}
        self.offsets, self.flat = np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32)

    def _whole(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _unit(self, unit: bytes) -> list[int]:
        """Ids of a run of Latin letters, which is lower-cased and spelled as bytes, or of a run of signs."""
        spelled = unit.decode().lower()
        if not unit.isascii():
            spelled = "".join(map(_SPELLING.__getitem__, spelled.encode()))
        return [t.id for t in self.model.tokenize(spelled)] if unit else []

    def words(self, text: bytes) -> list[bytes]:
        """The words of a text, in lower case where that changes no ids.

        It could, next to a combining mark (some compose with small letters only; their bytes start with CC or CD) and in special strings."""
        if self.lowers and b"<|" not in text and b"\xcc" not in text and b"\xcd" not in text:
            text = text.lower()
        return text.split() if self.splits else _WORDS.findall(text)

    def encode(self, words: set[bytes]) -> dict[bytes, list[int]]:
        """Ids of words that are not in the table, and of the parts of plain ones: letters and signs are units, each looked up or encoded once."""
        out: dict[bytes, list[int]] = {}
        at, both = self.at, []
        for w in words:
            m = _PLAIN.match(w) if self.direct else None
            if not m:
                out[w] = self._whole(w.decode())
            elif m[1] and m[2]:
                both.append((w, m[1], m[2]))
            else:
                out[w] = self._unit(w)
        for w, *parts in both:
            ids: list[int] = []
            for u in parts:
                if u in out:
                    ids += out[u]
                elif (k := at.get(u)) is not None:
                    ids += self.flat[self.offsets[k] : self.offsets[k + 1]].tolist()
                else:
                    out[u] = self._unit(u)
                    ids += out[u]
            out[w] = ids
        return out

    def _add(self, words: list[bytes], flat: np.ndarray, ends: np.ndarray) -> None:
        n, used = len(self.at), int(self.offsets[len(self.at)])
        while len(self.offsets) < n + len(words) + 1:
            self.offsets = np.concatenate([self.offsets, np.zeros_like(self.offsets)])
        while len(self.flat) < used + len(flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.offsets[n + 1 : n + 1 + len(words)] = used + ends
        self.flat[used : used + len(flat)] = flat
        self.at.update(zip(words, range(n, n + len(words)), strict=True))

    def ids(self, text: bytes) -> np.ndarray:
        words, at = self.words(text), self.at
        which = np.fromiter(map(at.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(which < 0)
        there, flat = missing[:0], self.flat
        if len(missing):
            unknown = [words[i] for i in missing.tolist()]
            fresh = self.encode(set(unknown))
            kept = [w for w in fresh if len(w) <= KEPT_CHARS][: KNOWN_WORDS - len(at)]
            self._add(kept, *_joined([fresh[w] for w in kept]))
            flat = self.flat
            which[missing] = np.fromiter(map(at.get, unknown, repeat(-1)), np.int64, len(unknown))
            there = np.flatnonzero(which < 0)  # not in the kept table, that is
        start, length = self.offsets[which], self.offsets[which + 1] - self.offsets[which]
        if len(there):
            rest = list(dict.fromkeys(words[i] for i in there.tolist()))
            more, ends = _joined([fresh[w] for w in rest])
            number = dict(zip(rest, range(len(rest)), strict=True))
            own = np.fromiter((number[words[i]] for i in there.tolist()), np.int64, len(there))
            bounds = np.append(0, ends)
            start[there], length[there] = bounds[own], bounds[own + 1] - bounds[own]
        at_ = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())
        if not len(there):
            return flat[at_]
        out, held = np.empty(len(at_), np.uint32), np.repeat(which >= 0, length)
        out[held], out[~held] = flat[at_[held]], more[at_[~held]]
        return out


def _joined(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The ids one after another, and where each list's end."""
    ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
    return np.fromiter(chain.from_iterable(ids), np.uint32, int(ends[-1]) if len(ends) else 0), ends


def _word_ids(path: str) -> WordIds:
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE_TOKENS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens[, ids]) of each piece."""
    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids

    @tidy
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _word_ids(tokenizer_path)
        for b in it:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.append(table.ids(text.as_py()), np.uint32(end_id)).astype("<u4")
                for s in range(0, len(ids), sequence):
                    part = ids[s : s + sequence]
                    rows.append((doc, s, len(part), zlib.crc32(part.tobytes()), len(ids), *([part.tolist()] if with_ids else [])))
                    if with_ids and len(rows) >= 500:
                        yield _table(rows, with_ids)
                        rows = []
            if rows:
                yield _table(rows, with_ids)

    return docs.select(F.col(id_col).cast("long").alias("id"), text_column(docs, text_col).cast("binary").alias("t")).mapInArrow(run, schema)


def _table(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: 5 + with_ids]
    kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each item, and the number of bins. Items are taken in the given order, which is decreasing."""
    n, leaves = len(lengths), 1
    while leaves < max(1, n):
        leaves *= 2
    room = [capacity] * (2 * leaves)  # node k's children are 2k and 2k + 1; bins are the leaves
    bins, offsets, used = [0] * n, [0] * n, 0
    for i, size in enumerate(lengths.tolist()):
        k = 1
        while k < leaves:
            k *= 2
            if room[k] < size:
                k += 1
        bins[i], offsets[i] = k - leaves, capacity - room[k]
        used = max(used, bins[i] + 1)
        left = room[k] = room[k] - size
        while k > 1:
            other = room[k ^ 1]
            k //= 2
            best = left if left > other else other
            if room[k] == best:
                break
            left = room[k] = best
    return np.array(bins, np.int64), np.array(offsets, np.int64), used


def pack(parts: DataFrame, n_docs: int, sequence: int = SEQUENCE_TOKENS, group_docs: int = GROUP_DOCS, seed: int = 0) -> DataFrame:
    """Adds sequence_id and offset to the rows of :func:`pieces`."""
    groups = max(1, round(n_docs / group_docs))
    cols = ["id", "start", "length", "ids_crc32", "doc_tokens"]
    dealt = parts.withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), "id", F.when(F.col("id").isNull(), F.col("ids_crc32"))), F.lit(groups)).cast("long"))

    def run(table: pa.Table) -> pa.Table:
        col = {c: table[c].to_numpy() for c in ("start", "length", "ids_crc32", "doc_tokens")}
        ids = np.array([-1 if x is None else x for x in table["id"].to_pylist()], np.int64)
        order = np.lexsort((col["start"], ids, col["ids_crc32"], -col["length"]))
        full = int(np.count_nonzero(col["length"] == sequence))
        bins, offsets, _ = first_fit_decreasing(col["length"][order[full:]], sequence)
        which, off = np.empty(len(order), np.int64), np.zeros(len(order), np.int64)
        which[order[:full]], which[order[full:]], off[order[full:]] = np.arange(full), full + bins, offsets
        base = table["grp"][0].as_py() << 32
        return table.append_column("sequence_id", pa.array(base + which)).append_column("offset", pa.array(off)).drop_columns("grp")

    ids = ", ids array<int>" if "ids" in parts.columns else ""
    names = [*cols, *(["ids"] if ids else [])]
    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long" + ids + ", sequence_id long, offset long"
    return dealt.select(*names, "grp").repartition(tasks_of(groups, 1), "grp").groupBy("grp").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, **kw) -> DataFrame:
    """Tokenises and packs ``docs``; see :func:`pieces` and :func:`pack`."""
    return pack(pieces(docs, tokenizer_path, id_col, text_col, with_ids=with_ids), docs.count(), **kw)
