"""Operator 10: remove word windows that repeat in a corpus, found by fixed-block anchors.

Words are runs of bytes other than white space. Every word covered by a window of ``width`` words that also starts
earlier, in a document of a smaller id or earlier in the same one, is removed; all are judged on the input.

The blocks of ``block`` words at multiples of block in their document are the index; a window of 2 * block - 1 words or
more holds one whole. Every rolling window of block words, of every document, probes it: both travel as hashes of six
bytes, each once for a batch of texts, to the bucket of the index that they belong to. What comes back to a batch is
which of its rolling windows are blocks that stand elsewhere too. These hits are extended: around them lie the windows
of width words that may repeat, filed under the smallest hash of a hit in them, which is the same for equal windows.
Those that share an anchor are compared word by word (repeats.py), and runs of repeated windows are the maximal exact
repeats.

Defined cases: as in operator 8, with words for bytes; a null text has no words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats
from .op8_suffix_dedup import NO_ID, keyed
from .tables import load, slices, tidy, utf8, written

WIDTH = 20
#: Bytes of text in a batch, and probes in a bucket of the index, about.
BATCH, PROBES = 1 << 20, 1 << 21
BATCHES = "batch long, bytes long, docs array<long>, rows array<long>, texts array<string>"
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: The part of a hash that travels, but for its two lowest bits. On the way there they tell whether the batch has the
#: window twice, and whether it has it as a block; on the way back the level of crowded hits (repeats.CROWDED).
CARRIED = np.uint64((1 << 48) - 4)
TWICE, AS_BLOCK = np.uint64(1), np.uint64(2)


def in_batches(rows: DataFrame, size: int = BATCH) -> DataFrame:
    """BATCHES rows, written: (doc, row, text) rows that travel together, size bytes of text or a single one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for part in slices(batches, "text", size):
            _, off = utf8(part.column("text"))
            whole = [0, part.num_rows]
            lists = [pa.ListArray.from_arrays(pa.array(whole, pa.int32()), part.column(c)) for c in ("doc", "row", "text")]
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([int(off[-1] - off[0])]), *lists], names=["batch", "bytes", "docs", "rows", "texts"])
            number += 1

    return written(rows.mapInArrow(tidy(run), BATCHES), "batches")


class Words:
    """The words of a batch of texts, laid end to end, and the hashes of its rolling windows of block words."""

    def __init__(self, batch: pa.RecordBatch, block: int) -> None:
        raw, off = utf8(batch.column("texts").flatten())
        raw = np.insert(raw[off[0] : off[-1]], off[1:-1] - off[0], 32)  # no word goes from one text into the next
        self.raw = raw
        self.starts, self.ends = repeats.word_bounds(raw)
        self.tokens = repeats.word_tokens(raw)
        self.sums = repeats.prefix(self.tokens)
        #: The first word of each text, and the end of the last.
        self.first = np.searchsorted(self.starts, off - off[0] + np.arange(len(off)))
        self.first[-1] = len(self.starts)
        size = np.diff(self.first)
        #: Of each word its text and its place there.
        self.text = np.repeat(np.arange(len(size)), size)
        self.place = np.arange(len(self.starts)) - self.first[self.text]
        self.left = self.first[self.text + 1] - np.arange(len(self.starts))
        at = np.flatnonzero(self.left >= block)
        self.rolling = np.full(len(self.starts), NONE)
        self.rolling[at] = repeats.mix(repeats.span(self.sums, at, at + block), 5) & ~np.uint64(1)  # never NONE

    def spaced(self) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, where each word starts): the words with one space behind each."""
        size = self.ends - self.starts + 1
        begin = np.concatenate(([0], np.cumsum(size)))
        at = np.repeat(self.starts - begin[:-1], size) + np.arange(begin[-1])
        out = np.append(self.raw, np.uint8(32))[at]
        out[begin[1:] - 1] = 32
        return out, begin


def six_bytes(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).ravel()


def from_six_bytes(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = raw.reshape(-1, 6)
    return out.view("<u8").ravel().astype(np.uint64)


def blobs(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values of six bytes for each number, cut at ends."""
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate(([0], ends * 6)).astype(np.int32)), pa.py_buffer(six_bytes(values))])


def probes(batches: DataFrame, block: int, buckets: int) -> DataFrame:
    """(bucket, batch, probes): each rolling window of a batch once, blocks of the index among them."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in found:
            for k in range(part.num_rows):
                one = part.slice(k, 1)
                w = Words(one, block)
                at = np.flatnonzero(w.rolling != NONE)
                if not len(at):
                    continue
                at = at[np.argsort(w.rolling[at], kind="stable")]
                h = w.rolling[at]
                lead = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                as_block = np.logical_or.reduceat(w.place[at] % block == 0, lead)
                twice = np.diff(lead, append=len(h)) > 1
                h = h[lead]
                bucket = (h >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)
                value = h & CARRIED | np.where(twice, TWICE, np.uint64(0)) | np.where(as_block, AS_BLOCK, np.uint64(0))
                last = np.append(np.flatnonzero(bucket[1:] != bucket[:-1]), len(h) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(bucket[last].astype(np.int32)), pa.array(np.full(len(last), one.column("batch")[0].as_py())), blobs(value, last + 1)], names=["bucket", "batch", "probes"])

    return batches.select("batch", "texts").mapInArrow(tidy(run), "bucket int, batch long, probes binary")


def hits(found: DataFrame) -> DataFrame:
    """(batch, hits): of each batch the rolling windows that are a block somewhere and stand in two places at least."""

    crowded = repeats.CROWDED, repeats.VERY * repeats.CROWDED

    def of_bucket(held: list[tuple[int, bytes]]) -> pa.RecordBatch:
        value = from_six_bytes(np.frombuffer(b"".join(b for _, b in held), np.uint8))
        own = np.repeat(np.arange(len(held)), [len(b) // 6 for _, b in held])
        key = value & CARRIED
        order = np.argsort(key, kind="stable")
        lead = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        size = np.diff(lead, append=len(order))
        flags = np.bitwise_or.reduceat(value[order], lead)
        hit = (flags & AS_BLOCK > 0) & ((size > 1) | (flags & TWICE > 0))
        level = (size > crowded[0]).astype(np.uint64) + (size > crowded[1])
        back = np.empty_like(key)
        back[order] = key[order] | np.repeat(level, size)
        at = np.sort(order[np.repeat(hit, size)])
        last = np.append(np.flatnonzero(own[at][1:] != own[at][:-1]), len(at) - 1) if len(at) else at
        ids = np.array([b for b, _ in held], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids[own[at[last]]]), blobs(back[at], last + 1)], names=["batch", "hits"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        open_ = None
        for part in rows:
            for bucket, batch, blob in zip(*(part.column(c).to_pylist() for c in ("bucket", "batch", "probes")), strict=True):
                if bucket != open_ and held:
                    yield of_bucket(held)
                    held = []
                open_ = bucket
                held.append((batch, blob))
        if held:
            yield of_bucket(held)

    return found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(run), "batch long, hits binary")


def extended(batches: DataFrame, found: DataFrame, width: int, block: int) -> DataFrame:
    """PARTS rows: the stretches of windows around hits, by their anchor; those that are settled have no body."""
    grams = (3 * width + 3) // 4, width

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows:
            for k in range(part.num_rows):
                one = part.slice(k, 1)
                w = Words(one, block)
                known = np.sort(from_six_bytes(np.frombuffer(b"".join(one.column("hits")[0].as_py()), np.uint8)))
                place = np.minimum(np.searchsorted(known & CARRIED, w.rolling & CARRIED), len(known) - 1)
                anchors = np.where((known[place] & CARRIED == w.rolling & CARRIED) & (w.rolling != NONE), w.rolling, NONE)
                if len(anchors) < width:
                    continue
                least = repeats.sliding_min(anchors, width - block + 1)[: len(anchors) - width + 1]
                least[w.left[: len(least)] < width] = NONE
                new = np.append(True, least[1:] != least[:-1])
                new[1:] |= w.text[1 : len(least)] != w.text[: len(least) - 1]
                start = np.flatnonzero(new)
                n = np.diff(start, append=len(least))
                some = least[start] != NONE
                start, n = start[some], n[some]
                if not len(start):
                    continue
                key = least[start]
                content = repeats.mix(repeats.span(w.sums, start, start + n + width - 1) + n.astype(np.uint64), 3)
                level = known[np.searchsorted(known & CARRIED, key & CARRIED)] & ~CARRIED
                cuts = [(key[level == 0], content[level == 0], start[level == 0], n[level == 0])]
                for lv, gram in enumerate(grams, 1):
                    at = np.flatnonzero(level == lv)
                    for lo in range(0, len(at), 10_000):
                        a = at[lo : lo + 10_000]
                        tokens = np.concatenate([w.tokens[i:j] for i, j in zip(start[a], (start + n)[a] + width - 1, strict=True)])
                        which, k2, c2, inside, n2, _ = repeats.cut_again(tokens, n[a] + width - 1, key[a], width, gram)
                        cuts.append((k2, c2, start[a][which] + inside, n2))
                key, content, start, n = (np.concatenate(x) for x in zip(*cuts, strict=True))
                docs, ids = (one.column(c).flatten().to_numpy()[w.text[start]] for c in ("docs", "rows"))
                raw, begin = w.spaced()
                a, b = begin[start], begin[start + n + width - 1]
                order, copy = repeats.settled(key, content, docs, ids, w.place[start], lambda i: raw[a[i] : b[i]].tobytes())  # noqa: B023
                key, content, docs, ids, n, at, a, b = (x[order] for x in (key, content, docs, ids, n, w.place[start], a, b))
                key[copy] = repeats.own_keys(docs[copy], ids[copy], at[copy])
                bodies = repeats.binary(raw, a, np.where(copy, a, b))
                bodies = pc.if_else(pa.array(copy), pa.scalar(None, pa.binary()), bodies)
                for lo in range(0, len(order), 20_000):
                    yield repeats.parts_of(key.view(np.int64), content.view(np.int64), docs, ids, at, n, np.ones(len(n), bool), bodies).slice(lo, 20_000)

    gathered = found.groupBy("batch").agg(F.collect_list("hits").alias("hits"))  # no more than the batch's own probes
    return batches.drop("bytes").join(gathered, "batch").mapInArrow(tidy(run), repeats.PARTS)


def window_repeats(table: pa.Table, width: int) -> tuple[np.ndarray, ...]:
    """As shard_repeats of operator 8, for stretches of words that share an anchor: windows are compared word by word."""
    raw, off = utf8(table.column("body"))
    raw = raw[off[0] : off[-1]]
    data = raw.tobytes()
    tokens = repeats.word_tokens(raw)
    begin, end = repeats.word_bounds(raw)
    n = table.column("windows").to_numpy().astype(np.int64)
    starts = np.cumsum(n + width - 1) - (n + width - 1)
    which = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    at = starts[which] + inside
    window = repeats.span(repeats.prefix(tokens), at, at + width)
    doc, row = table.column("doc").to_numpy()[which], table.column("row").to_numpy()[which]
    pos = table.column("start").to_numpy()[which] + inside
    order = np.lexsort((pos, row, doc, window))
    lead = np.append(True, window[order][1:] != window[order][:-1])
    first = order[np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))]
    other = np.flatnonzero((doc[order] != doc[first]) | (row[order] != row[first]) | (pos[order] != pos[first]))
    again = np.zeros(len(order), bool)
    a, b = begin[at], end[at + width - 1]
    x, y = order[other], first[other]
    again[x] = [data[i:j] == data[k:m] for i, j, k, m in zip(a[x].tolist(), b[x].tolist(), a[y].tolist(), b[y].tolist(), strict=True)]
    return doc, row, pos, again


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc, row, spans): the word ranges [start, end) of each row that are to go, sorted; null ids as NO_ID."""
    block = (width + 1) // 2
    batches = in_batches(keyed(docs, id_col, text_col))
    size = batches.agg(F.sum("bytes")).first()[0] or 0
    buckets = min(1 << 24, max(1, -(-size // (6 * PROBES))))
    found = written(hits(probes(batches, block, buckets)), "hits")
    later = repeats.compared(extended(batches, found, width, block), lambda t: window_repeats(t, width))
    return repeats.repeated_spans(later, width)


def kept_words(raw: bytes, spans: list[tuple[int, int]]) -> tuple[list[bytes], int]:
    """The words of raw outside the spans, and how many words it has."""
    words = raw.split()
    if not spans:
        return words, len(words)
    out, at = [], 0
    for start, end in spans:
        out += words[at:start]
        at = end
    return out + words[at:], len(words)


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices([batch], "text"):
            raw, off = utf8(part.column("text"))
            out = []
            for i, (doc, spans) in enumerate(zip(part.column("doc").to_pylist(), part.column("spans").to_pylist(), strict=True)):
                ranges = repeats.merged(spans)
                words, n = kept_words(raw[off[i] : off[i + 1]].tobytes(), ranges)
                out.append((None if doc == NO_ID else doc, n, sum(b - a for a, b in ranges), hashlib.sha256(b" ".join(words)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 3 else pa.int64()) for k, c in enumerate(zip(*out, strict=True))], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    rows = keyed(docs, "doc_id", "text").join(repeated_words(docs), ["doc", "row"], "left").select("doc", "text", "spans")
    return rows.mapInArrow(tidy(digests), "doc_id long, n_words long, n_removed long, kept_sha256 string")
