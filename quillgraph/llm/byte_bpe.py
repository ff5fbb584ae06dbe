"""Byte-level BPE by merge replay over a corpus, and decoding.

Texts are cut into words by the vocabulary's pattern. A worker encodes the words that it has not met, a batch's at a time, together: all their bytes stand in one row of tokens with links to their
neighbours, and an index holds, for each merge, the places of the token pairs that it joins. Merges are applied in the order of their ranks, each to all its places in all words, from left to right; only
the two pairs that a merge touches enter the index again. The order of ranks over a corpus is that of each word alone: words share no pairs, and a pair that a merge makes waits for its rank, or, if its rank
is lower than the merge's own, is the next. Words that are tokens themselves are not replayed.

Texts are first cut at single spaces between characters that are no white space, where the pattern always cuts, and a bounded table of the stretches between, which mostly repeat, is kept per worker. That a
cut is safe depends on the pattern: it may join one space to what follows, and nothing else across the two. It is checked on loading, and whole texts are matched where it fails.

Rows: a null text is empty, without ids; null ids keep their rows; repeated rows get equal results; extra columns, whatever their names, are ignored. A text is encoded whole, however long, and so is a word: replay takes
time that grows with its length and the logarithm of the number of merges.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, slices, text_column, tidy

#: Stretches and words that a worker keeps: the first it meets, the frequent ones among them; others are encoded each time.
KNOWN_STRETCHES, KNOWN_WORDS = 250_000, 50_000
KEPT_CHARS = 64
#: Bytes of text whose unknown words are replayed together.
BATCH_BYTES = 4 << 20
#: What stands for the bounds of words and for tokens that merges have taken, in a row of tokens; beyond any id.
WIDE, WALL, GONE = 1 << 24, (1 << 24) - 1, -2
#: Places from which on a merge is applied to all in one step.
VECTORS = 24
_CUT = re.compile(r" (?<=\S )(?=\S)")


class Vocabulary:
    """Ranks by bytes, and the rank of every pair of tokens that a merge joins."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, filter(bytes.strip, file))}
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing:
            raise ValueError(f"bytes without a token: {missing}")
        #: Ranks by ``left * WIDE + right``.
        self.merges: dict[int, int] = {}
        for word, rank in self.ranks.items():
            for cut in range(1, len(word)):
                left, right = self.ranks.get(word[:cut]), self.ranks.get(word[cut:])
                if left is not None and right is not None:
                    self.merges[left * WIDE + right] = rank
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.first = np.array([[self.merges.get(int(x) * WIDE + int(y), -1) for y in self.single] for x in self.single], np.int64)
        # the same as a table with open addressing, for many pairs at once
        keys, ranks = (np.fromiter(x, np.int64, len(self.merges)) for x in (self.merges.keys(), self.merges.values()))
        self.slot_bits = max(4, int(8 * len(keys)).bit_length())
        self.slots, self.slot_ranks = np.full(1 << self.slot_bits, -1, np.int64), np.zeros(1 << self.slot_bits, np.int64)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = keys[todo[free]]  # of several the last
            self.slot_ranks[slot[free]] = ranks[todo[free]]
            on = self.slots[slot] != keys[todo]
            todo, slot = todo[on], (slot[on] + 1) & (len(self.slots) - 1)
        most = max(self.ranks.values()) + 1
        if most > WALL:
            raise ValueError(f"ids beyond {WALL}")
        self.lengths = np.full(most, -1, np.int64)  # -1: no such id
        for word, rank in self.ranks.items():
            self.lengths[rank] = len(word)
        self.offsets = np.zeros(most + 1, np.int64)
        np.cumsum(np.maximum(self.lengths, 0), out=self.offsets[1:])
        self.bytes = np.frombuffer(b"".join(w for w, _ in sorted(self.ranks.items(), key=lambda x: x[1])), np.uint8)

    def replay(self, words: list[bytes], vectors: int = VECTORS) -> list[bytes]:
        """The ids of each word, as 32-bit numbers, by all merges in rank order over all words at once; a merge with ``vectors`` places or more is applied to them in one step."""
        if not words:
            return []
        raw = np.frombuffer(b"\0" + b"\0".join(words) + b"\0", np.uint8)
        walls = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words], dtype=np.int64)])  # no pair has a wall, so no merge crosses words
        tokens, pairs = self.single[raw], np.full(len(raw), -1, np.int64)
        tokens[walls] = WALL
        pairs[:-1] = self.first[raw[:-1], raw[1:]]
        pairs[walls] = pairs[walls[1:] - 1] = -1
        afters, befores = np.arange(1, len(raw) + 1), np.arange(-1, len(raw) - 1)
        token, pair, after, before = map(memoryview, (tokens, pairs, afters, befores))
        heap: list[int] = []
        index: dict[int, list] = {}  # by rank: places, alone or in arrays

        def enter(ranks: np.ndarray, places: np.ndarray) -> None:
            by = np.argsort(ranks, kind="stable")
            ranks, places = ranks[by], places[by]
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            for rank, s, e in zip(ranks[cuts[:-1]].tolist(), cuts, cuts[1:], strict=False):
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(heap, rank)
                index[rank].append(places[s:e])

        there = np.flatnonzero(pairs >= 0)
        if len(there):
            enter(pairs[there], there)
        merge, again = self.merges.get, []
        while heap:
            rank = heapq.heappop(heap)
            parts = index.pop(rank)
            places = np.concatenate([np.atleast_1d(x) for x in parts]) if len(parts) < 4 or any(isinstance(x, np.ndarray) for x in parts) else np.array(parts)
            if len(places) >= vectors:
                at = np.sort(places[pairs[places] == rank])
                at = at[np.diff(at, prepend=-1) > 0]
                clash = np.concatenate([[False], afters[at[:-1]] == at[1:]])  # its left token may go with the place before
                if clash.any():
                    run = np.arange(len(at))
                    at = at[(run - np.maximum.accumulate(np.where(clash, 0, run))) % 2 == 0]
                right = afters[at]
                nxt = afters[right]
                tokens[at], tokens[right], pairs[right] = rank, GONE, -1
                afters[at], befores[nxt] = nxt, at
                places = np.concatenate([befores[at], at])
                made = self.lookup(tokens[places] * WIDE + tokens[afters[places]])
                pairs[places] = made
                on = made >= 0
                if on.any():
                    enter(made[on], places[on])
                    if (soon := made[on] < rank).any():  # would have come before later places of the word
                        again += np.unique(np.searchsorted(walls, places[on][soon], "right") - 1).tolist()
                continue
            todo = sorted(places.tolist())
            for k, at in enumerate(todo):
                if pair[at] != rank:
                    continue  # a neighbour's merge took one of the two
                right = after[at]
                nxt = after[at] = after[right]
                before[nxt] = at
                left = before[at]
                token[at], token[right], pair[right] = rank, GONE, -1
                soonest = rank
                for place, key in ((left, token[left] * WIDE + rank), (at, rank * WIDE + token[nxt])):
                    made = pair[place] = merge(key, -1)
                    if made >= 0:
                        if made in index:
                            index[made].append(place)
                        else:
                            index[made] = [place]
                            heapq.heappush(heap, made)
                        if made < soonest:
                            soonest = made
                if soonest < rank:  # its turn is before the other places of this merge
                    if rest := todo[k + 1 :]:
                        if rank not in index:
                            index[rank] = []
                            heapq.heappush(heap, rank)
                        index[rank] += rest
                    break
        tokens[walls] = GONE
        left = tokens >= 0
        ends = np.concatenate([[0], np.cumsum(left)])[walls] * 4
        ids = tokens[left].astype("<i4").tobytes()
        out = [ids[s:e] for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        again = sorted(set(again))
        for k, alone in zip(again, self.replay([words[k] for k in again], len(raw) + 1), strict=True):
            out[k] = alone
        return out

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Rank of each ``left * WIDE + right``, -1 where no merge joins the two."""
        out = np.full(len(keys), -1, np.int64)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            there = self.slots[slot]
            hit = there == keys[todo]
            out[todo[hit]] = self.slot_ranks[slot[hit]]
            on = ~hit & (there >= 0)
            todo, slot = todo[on], (slot[on] + 1) & (len(self.slots) - 1)
        return out

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(BASE)) >> np.uint64(64 - self.slot_bits)).astype(np.int64)


class Encoder:
    def __init__(self, path: str, pattern: str):
        self.vocabulary, self.words = Vocabulary(path), regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.stretches: dict[str, bytes] = {}
        probes = ("a b", "a 1", "a .", "1 's", ". x", "é ü", "a b\n", "a　b c", "1 2", "! !")
        self.cuts = all(self.words.findall(p) == [w for k, part in enumerate(_CUT.split(p)) for w in self.words.findall(" " * (k > 0) + part)] for p in probes)

    def _learn(self, words: list[str]) -> None:
        ranks, todo = self.vocabulary.ranks, []
        for word in words:
            data = word.encode()
            if (rank := ranks.get(data)) is not None:
                self.known[word] = rank.to_bytes(4, "little")
            else:
                todo.append((word, data))
        self.known.update(zip([w for w, _ in todo], self.vocabulary.replay([d for _, d in todo]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit numbers."""
        split = [_CUT.split(t) if self.cuts else [t] for t in texts]
        begins = [s.pop(0) for s in split]  # what a text begins with has no space before it
        known, stretches, words = self.known, self.stretches, self.words
        new = set().union(*split) - stretches.keys()
        cut = [words.findall(" " + s) for s in new]
        first = [words.findall(s) for s in begins]
        met = list(set().union(*cut, *first) - known.keys())
        self._learn(met)
        stretches.update((s, known[found[0]] if len(found) == 1 else b"".join([known[w] for w in found])) for s, found in zip(new, cut, strict=True))
        out = [b"".join([*(known[w] for w in found), *map(stretches.__getitem__, s)]) for found, s in zip(first, split, strict=True)]
        _forget(stretches, new, KNOWN_STRETCHES)
        _forget(known, met, KNOWN_WORDS)
        return out


def _forget(table: dict[str, bytes], new: Iterable[str], most: int) -> None:
    """Takes long and surplus entries out again."""
    surplus = len(table) - most
    for key in new:
        if len(key) > KEPT_CHARS or surplus > 0:
            del table[key]
            surplus -= 1


_loaded: dict[tuple, object] = {}


def _once(make, *key):
    if (make, *key) not in _loaded:
        _loaded[make, *key] = make(*key)
    return _loaded[make, *key]


def joined_tokens(vocabulary: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """The bytes of ids, one after the other."""
    if len(ids) and (ids.min() < 0 or ids.max() >= len(vocabulary.lengths) or (vocabulary.lengths[ids] < 0).any()):
        raise ValueError("an id that the vocabulary does not have")
    length = vocabulary.lengths[ids]
    ends = np.cumsum(length)
    at = np.repeat(vocabulary.offsets[ids] - (ends - length), length)
    at += np.arange(len(at))
    return vocabulary.bytes[at]


def _lists(ids: list[bytes]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(ids))]))


def _texts(vocabulary: Vocabulary, lists: pa.ListArray) -> pa.Array:
    """The bytes of each list of ids."""
    bounds = lists.offsets.to_numpy()
    ids = lists.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]]
    data = joined_tokens(vocabulary, ids)
    ends = np.concatenate([[0], np.cumsum(vocabulary.lengths[ids])])[bounds - bounds[0]]
    return pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", back: bool = False) -> DataFrame:
    """(id, ids array<int>): one row per document; ``path`` names a file of ranks that every worker has. With ``back`` also ``decoded``, what the ids decode to, in the same pass."""

    @tidy
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _once(Encoder, path, pattern)
        for b in it:
            size = pa.compute.binary_length(b.column(1)).to_numpy(zero_copy_only=False)
            for s, e in slices(size, BATCH_BYTES):
                ids = _lists(encoder.encode(b.column(1)[s:e].to_pylist()))
                more = [_texts(encoder.vocabulary, ids)] if back else []
                yield pa.RecordBatch.from_arrays([b.column(0)[s:e], ids, *more], ["id", "ids", "decoded"][: 2 + back])

    schema = "id long, ids array<int>" + ", decoded binary" * back
    return docs.select(F.col(id_col).cast("long").alias("id"), text_column(docs, text_col).alias("t")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded(id, ids)`` -> (id, ids, decoded binary); an id that the vocabulary does not have is an error. Null lists of ids decode to nothing."""

    @tidy
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _once(Vocabulary, path)
        for b in it:
            lists = b.column(1)
            for s, e in slices(np.diff(lists.offsets.to_numpy()) * 4, BATCH_BYTES):
                yield pa.RecordBatch.from_arrays([b.column(0)[s:e], lists[s:e], _texts(vocabulary, lists[s:e])], ["id", "ids", "decoded"])

    return encoded.select("id", F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids")).mapInArrow(run, "id long, ids array<int>, decoded binary")
