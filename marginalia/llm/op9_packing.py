"""Operator 9: pack tokenised documents into fixed-length sequences by the harmonic method.

Lengths fall into reciprocal-capacity classes: class j holds what is longer than capacity / (j + 1) and at most
capacity / j, and each bin of class j takes exactly j of them. Documents are cut so that pieces fill their class: full
sequences first, then the largest capacity // j that fits, again and again, until what is left fills its class but for
a small slack. Every task packs its own documents; class bins that stay short at its end are joined, in turn and cut at
sequence ends, so that a task leaves one short sequence, and no sequence spans tasks.

Sequences are padded to the capacity, but for those whose length is a power of two.

Defined cases: a null text is empty, and an empty document is its end token alone; a null id is passed on; rows that
share an id are documents of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import load, slices, tidy, utf8

CAPACITY = 2048
END = 1
#: Part of a class's size that a piece may fall short of it without being cut again.
SLACK = 1 / 64
#: Words whose ids a worker keeps; beyond that it forgets all and starts anew.
WORDS = 400_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PIECES = SCHEMA + ", ids array<int>"


#: Lower-case words of Latin letters with ASCII punctuation behind, no digits, quotes or angle brackets: each part is
#: one run of the tokenizer's, and so known apart.
PLAIN = re.compile(r"^(?:([a-zß-öø-ÿ]+)([!-&(-/:;=?@[-`{-~]*)|(.*))$", re.MULTILINE)


class Words:
    """Ids of texts by a tokenizer that never joins across white space, kept by word in one worker process.

    A plain word is the ids of its letters and those of its punctuation; new letters are encoded many at once, without
    the tokenizer's normalising and splitting, which change nothing of them. All else is encoded word by word.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.light = Tokenizer.from_file(path)
        self.light.normalizer = normalizers.Sequence([])
        self.light.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.full.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        #: A word that is met for the first time gets the next number; learn() follows.
        self.code: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.units: dict[str, int] = {"": 0}
        self.length, self.begin, self.ids = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)
        self.word_length, self.word_begin, self.word_ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _add(self, length: np.ndarray, ids: np.ndarray) -> None:
        self.begin = np.concatenate((self.begin, len(self.ids) + np.cumsum(length) - length))
        self.length = np.concatenate((self.length, length))
        self.ids = np.concatenate((self.ids, ids))

    def _add_each(self, texts: list[str]) -> None:
        found = [e.ids for e in self.full.encode_batch_fast(texts, add_special_tokens=False)]
        self._add(np.array([len(x) for x in found], np.int64), np.array([i for x in found for i in x], np.uint32))

    def learn(self) -> None:
        """Encode the words that code has got since the last time."""
        new = list(islice(reversed(self.code), len(self.code) - len(self.word_length)))[::-1]
        if not new:
            return
        text = b"\n".join(new).decode("utf-8", "replace")
        rows = PLAIN.findall(text.lower())
        stems = list({r[0] for r in rows}.difference(self.units))
        marks = list({r[1] for r in rows}.difference(self.units))
        if stems:
            ids = np.array(self.light.encode_batch_fast([" ".join(stems)], add_special_tokens=False)[0].ids, np.uint32)
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == len(stems):
                self._add(np.diff(last, prepend=0), ids)
            else:
                self._add_each(stems)
        self._add_each(marks)
        self.units.update(zip([*stems, *marks], range(len(self.units), len(self.units) + len(stems) + len(marks)), strict=True))
        plain = text.split("\n")
        others = [k for k, r in enumerate(rows) if r[2]]
        first = len(self.length)
        self._add_each([plain[k] for k in others])
        for k, place in zip(others, range(first, first + len(others)), strict=True):
            self.units["\n" + plain[k]] = place
        units = self.units
        pairs = np.array([(units[a], units[b]) if not c else (0, 0) for a, b, c in rows], np.int32).reshape(-1, 2)
        pairs[others, 0] = np.arange(first, first + len(others))
        both = pairs.ravel()
        length = self.length[both]
        ids = gathered(self.ids, self.begin[both], length)
        length = length.reshape(-1, 2).sum(1)
        self.word_begin = np.concatenate((self.word_begin, len(self.word_ids) + np.cumsum(length) - length))
        self.word_length = np.concatenate((self.word_length, length))
        self.word_ids = np.concatenate((self.word_ids, ids))

    def encode(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """The ids of texts that are given as words."""
        n = np.array([len(t) for t in texts], np.int64)
        codes = np.fromiter(map(self.code.__getitem__, chain.from_iterable(texts)), np.int64, int(n.sum()))
        self.learn()
        length = self.word_length[codes]
        ids = gathered(self.word_ids, self.word_begin[codes], length)
        ends = np.concatenate(([0], np.cumsum(length)))
        return np.split(ids, ends[np.cumsum(n)[:-1]]) if len(texts) else []


def gathered(ids: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """ids[begin : begin + length] of every pair, one behind the other."""
    at = np.repeat(begin - (np.cumsum(length) - length), length)
    at += np.arange(len(at))
    return ids[at]


@cache
def words_of(path: str) -> Words:
    """The tokenizer is kept from task to task of a worker process."""
    return Words(path)


def token_ids(words: Words, raw: np.ndarray, off: np.ndarray, keep: int = WORDS) -> list[np.ndarray]:
    """The ids of each text of a block of texts."""
    if len(words.code) > keep:
        words.clear()
    texts = [raw[a:b].tobytes().split() for a, b in zip(off[:-1], off[1:], strict=True)]
    return words.encode(texts)


def cuts(length: int, capacity: int) -> list[int]:
    """Sizes of a document's pieces."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        j = capacity // rest  # rest is in class j
        if rest >= (1 - SLACK) * (capacity // j) or rest * 64 <= capacity:
            out.append(rest)
            break
        size = capacity // (j + 1)
        out.append(size)
        rest -= size
    return out


class Bins:
    """Open bins of one task; put() gives the pieces of each bin that it fills, rest() those of what is left."""

    def __init__(self, capacity: int, first: int) -> None:
        self.capacity, self.sequence, self.open = capacity, first, defaultdict(list)

    def close(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.sequence, at, ids
            at += len(ids)
        self.sequence += 1

    def put(self, doc: int | None, ids: np.ndarray) -> Iterator[tuple]:
        start = 0
        for size in cuts(len(ids), self.capacity):
            j = self.capacity // size
            self.open[j].append((doc, start, ids[start : start + size].copy(), len(ids)))
            start += size
            if len(self.open[j]) == j:
                yield from self.close(self.open.pop(j))

    def rest(self) -> Iterator[tuple]:
        held, room = [], self.capacity
        for j in sorted(self.open):
            for doc, start, ids, total in self.open[j]:
                while len(ids):
                    part, ids = ids[:room], ids[room:]
                    held.append((doc, start, part, total))
                    start += len(part)
                    room -= len(part)
                    if not room:
                        yield from self.close(held)
                        held, room = [], self.capacity
        if held:
            yield from self.close(held)


def batch_of(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    names = [x.split()[0] for x in PIECES.split(", ")]
    arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
    if with_ids:
        arrays.append(pa.array([x.astype(np.int32) for x in columns[7]], pa.list_(pa.int32())))
    return pa.RecordBatch.from_arrays(arrays, names=names[: len(arrays)])


def packed(docs: DataFrame, tokenizer: str | Callable[[], str], id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int | None = END, with_ids: bool = True, keep: int = WORDS, lasting: bool = True) -> DataFrame:
    """A row for each piece: which ids of which document stand where in which sequence, and the ids themselves.

    tokenizer: the path of a tokenizers file at every executor, or a function that finds it there. keep: how many words'
    ids a worker process keeps, and lasting: whether from task to task; both trade memory for time alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(tokenizer() if callable(tokenizer) else tokenizer)
        bins = Bins(capacity, TaskContext.get().partitionId() << 33)
        rows: list[tuple] = []
        tail = np.array([] if end is None else [end], np.uint32)
        for part in slices(batches, "text", 1 << 20):
            raw, off = utf8(part.column("text"))
            for doc, ids in zip(part.column("doc").to_pylist(), token_ids(words, raw, off, keep), strict=True):
                rows += bins.put(doc, np.concatenate((ids, tail)))
            if len(rows) > 2000:
                yield batch_of(rows, with_ids)
                rows = []
        rows += bins.rest()
        if rows:
            yield batch_of(rows, with_ids)
        if not lasting:
            words.clear()  # the tokenizer stays for the worker's next task

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(tidy(run), PIECES if with_ids else SCHEMA)


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(load(spark, sf_dir, "documents"), word_bpe, with_ids=False)
