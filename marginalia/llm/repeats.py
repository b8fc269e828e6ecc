"""Deal out stretches of texts that may repeat, and compare them: what op8 (bytes) and op10 (words) share.

A document is a sequence of tokens. Each operator cuts it into segments, runs of consecutive windows of ``width`` tokens
that have one key, such that equal windows have equal keys wherever they stand (op8: the smallest hash of the strings in
a window; op10: the smallest hash of the indexed blocks in it). Segments of one key are compared in one shard. Equal
segments are aggregated first: in each map task within its batch, then in the sorted rows of a key, where each copy is
compared item by item with the first and settled by it. So a passage that is copied ten thousand times costs a shard
one representative, and nothing rests on a hash alone. The segments of a crowded key, one with many different segments,
are cut and dealt by the smallest hash of longer strings, or of whole windows, of which all equal ones are copies.

A row is known by its document's id and a hash of its text (``row``): rows of one id and other texts are texts of their
own, in the order of their hashes; rows alike in both are one document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import slices, tidy, utf8, written

#: A document's texts are hashed in pieces of at most so many tokens, so that memory does not follow its length.
PIECE = 1 << 18
#: Different segments of one key beyond which it is crowded, and so many times as many for whole windows to be dealt.
CROWDED, VERY = 10_000, 5
PARTS = "key long, content long, doc long, row long, start int, windows int, inner boolean, body binary"
SPANS = "doc long, row long, start int, windows int"

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h + np.uint64(salt)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix(tokens: np.ndarray) -> np.ndarray:
    """Prefix sums from which span() gives the hash of any stretch of tokens."""
    out = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(tokens * powers(len(tokens))[0], out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (sums[end] - sums[start]) * powers(len(sums))[1][start]


BYTE_TOKENS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def byte_tokens(raw: np.ndarray) -> np.ndarray:
    return BYTE_TOKENS[raw]


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than white space."""
    edge = np.diff(np.concatenate(([1], SPACE[raw].view(np.int8), [1])))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_tokens(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, whole texts in pieces so that memory stays bounded."""
    starts, ends = word_bounds(raw)
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + PIECE, "right")))
        a, b = int(starts[lo]), int(ends[hi - 1])
        out[lo:hi] = mix(span(prefix(byte_tokens(raw[a:b])), starts[lo:hi] - a, ends[lo:hi] - a), 7)
        lo = hi
    return out


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values, by doubling."""
    n, have = len(h) - w + 1, 1
    while have * 2 <= w:
        h = np.minimum(h[: len(h) - have], h[have:])
        have *= 2
    return np.minimum(h[:n], h[w - have : w - have + n])


def pieces(lengths: np.ndarray, width: int) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (document, first token, end) of PIECE tokens together; pieces of one document overlap by width - 1."""
    group, size = [], 0
    for d, n in enumerate(lengths):
        start = 0
        while n - start >= width:
            end = min(n, start + PIECE)
            group.append((d, start, end))
            size += end - start
            if size >= PIECE:
                yield group
                group, size = [], 0
            if end == n:
                break
            start = end - width + 1
    if group:
        yield group


def segments(tokens: np.ndarray, bounds: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(key, content hash, start, number of windows, periodic) of the segments; bounds: pieces' ends, ascending."""
    sums = prefix(tokens)
    at = np.arange(len(tokens) - gram + 1)
    grams = mix(span(sums, at, at + gram))
    least = sliding_min(grams, width - gram + 1)
    valid = np.ones(len(least), bool)
    for e in bounds[:-1]:
        valid[max(0, e - width + 1) : e] = False
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    start = np.flatnonzero(new)
    seen = np.concatenate(([0], np.cumsum(valid)))
    n = seen[np.append(start[1:], len(valid))] - seen[start]
    content = mix(span(sums, start, start + n + width - 1) + n.astype(np.uint64), 3)
    return least[start], content, start, n, periodic(grams, least, start, n, width - gram + 1)


def periodic(grams: np.ndarray, least: np.ndarray, start: np.ndarray, n: np.ndarray, w: int) -> np.ndarray:
    """Whether a segment may repeat within itself: its least string then stands in it twice, close together."""
    none = np.zeros(w - 1, np.uint64)
    at = np.flatnonzero(~sliding_min(~np.concatenate((none, least, none)), w) == grams)
    order = np.lexsort((at, grams[at]))
    at = at[order]
    value = grams[at]
    twin = np.flatnonzero((value[1:] == value[:-1]) & (at[1:] - at[:-1] < 2 * w))
    out = np.zeros(len(start), bool)
    at, value = at[twin], value[twin]
    j = np.searchsorted(start, at, "right") - 1
    while len(at):
        near = (j >= 0) & (start[j] + 2 * w + n[j] > at)
        at, value, j = at[near], value[near], j[near]
        hit = least[start[j]] == value
        out[j[hit]] = True
        at, value, j = at[~hit], value[~hit], j[~hit] - 1
    return out


def settled(key: np.ndarray, content: np.ndarray, doc: np.ndarray, row: np.ndarray, start: np.ndarray, body: Callable[[int], bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(order, settled): segments of a batch in order of their content, without further mentions of one place, and which
    of them are copies of an earlier one: their bodies agree."""
    order = np.lexsort((start, row, doc, content, key))
    key, content, doc, row, start = (x[order] for x in (key, content, doc, row, start))
    lead = np.append(True, (key[1:] != key[:-1]) | (content[1:] != content[:-1]))
    place = np.append(True, (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (start[1:] != start[:-1]))
    first = np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))
    copy = np.zeros(len(order), bool)
    at, known = -1, b""
    for k in np.flatnonzero(place & ~lead).tolist():
        if first[k] != at:
            at, known = int(first[k]), body(int(order[first[k]]))
        copy[k] = body(int(order[k])) == known
    stay = lead | place
    return order[stay], copy[stay]


def own_keys(doc: np.ndarray, row: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Keys by which settled segments do not meet in one task."""
    return mix(doc.view(np.uint64) ^ mix(row.view(np.uint64) ^ mix(start.astype(np.uint64), 11), 13))


def rows_of(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return part.column("doc").to_numpy(zero_copy_only=False), part.column("row").to_numpy(zero_copy_only=False)


def segment_rows(width: int, gram: int) -> Callable:
    """For mapInArrow: a row (key, content, doc, row, start, windows, settled, inner) for each segment of the bytes of
    (doc, row, text) rows. Settled ones, copies within a batch, have keys of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = utf8(batch.column("text"))
            docs, rows = rows_of(batch)
            found: list[tuple[np.ndarray, ...]] = []
            for group in pieces(np.diff(off), width):
                tokens = np.concatenate([byte_tokens(raw[off[d] + a : off[d] + b]) for d, a, b in group])
                size = np.array([b - a for _, a, b in group])
                bounds = np.cumsum(size)
                key, content, start, n, inner = segments(tokens, bounds, width, gram)
                which = np.searchsorted(bounds, start, "right")
                first = np.array([a for _, a, _ in group]) - (bounds - size)
                own = np.array([d for d, _, _ in group])[which]
                found.append((key, content, own, start + first[which], n, inner))
            if not found:
                continue
            key, content, own, start, n, inner = (np.concatenate(x) for x in zip(*found, strict=True))
            begin, end = off[own] + start, off[own] + start + n + width - 1
            order, copy = settled(key, content, docs[own], rows[own], start, lambda k: raw[begin[k] : end[k]].tobytes())
            key, content, own, start, n, inner = (x[order] for x in (key, content, own, start, n, inner))
            key[copy] = own_keys(docs[own][copy], rows[own][copy], start[copy])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(content.view(np.int64)), pa.array(docs[own]), pa.array(rows[own]), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(copy), pa.array(inner)],
                names=["key", "content", "doc", "row", "start", "windows", "settled", "inner"],
            )

    return run


def candidates(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """The segments that may repeat, of docs (doc, row, text): (key, content, doc, row, start, windows, settled, inner, met), written.

    Others have a key that stands nowhere else, and do not repeat within themselves. inner: whether a segment may do so;
    met: how many segments share the key.
    """
    rows = docs.mapInArrow(tidy(segment_rows(width, gram)), "key long, content long, doc long, row long, start int, windows int, settled boolean, inner boolean")
    met = F.count(F.lit(1)).over(Window.partitionBy("key"))
    return written(rows.withColumn("met", met).where("settled or inner or met > 1"), "segments")


def with_levels(found: DataFrame) -> DataFrame:
    """found candidates and their level: 0, or for crowded keys 1 or 2."""
    kinds = found.where((F.col("met") > CROWDED) & ~F.col("settled")).groupBy("key").agg(F.approx_count_distinct("content").alias("kinds"))
    crowded = written(kinds.where(F.col("kinds") > CROWDED).select("key", F.when(F.col("kinds") > VERY * CROWDED, 2).otherwise(1).alias("level")), "crowded")
    return found.join(crowded, "key", "left").withColumn("level", F.coalesce("level", F.lit(0)))


def fetched(found: DataFrame, docs: DataFrame, width: int, grams: tuple[int, int]) -> DataFrame:
    """PARTS rows: found segments (key, content, doc, row, start, windows, level) with their bytes, those of crowded keys
    cut again by strings of grams[level - 1] bytes."""
    wanted = found.groupBy("doc", "row").agg(F.sort_array(F.collect_set(F.struct("start", "windows", "key", "content", "inner", "level"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([batch], "text", 1 << 20):
                raw, off = utf8(part.column("text"))
                docs, rows = rows_of(part)
                lists = part.column("parts")
                n = np.diff(lists.offsets.to_numpy())
                own = np.repeat(np.arange(len(n)), n)
                flat = lists.flatten()
                start, windows, key, content, inner, level = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "windows", "key", "content", "inner", "level"))
                begin = off[own] + start
                end = begin + windows + width - 1
                plain = np.flatnonzero(level == 0)
                for lo in range(0, len(plain), 20_000):
                    at = plain[lo : lo + 20_000]
                    yield parts_of(key[at], content[at], docs[own[at]], rows[own[at]], start[at], windows[at], inner[at], binary(raw, begin[at], end[at]))
                for lv, gram in enumerate(grams, 1):
                    some = np.flatnonzero(level == lv)
                    for lo in range(0, len(some), 1_000):
                        at = some[lo : lo + 1_000]
                        tokens = byte_tokens(np.concatenate([raw[a:b] for a, b in zip(begin[at], end[at], strict=True)]))
                        which, k, c, inside, w, again = cut_again(tokens, end[at] - begin[at], key[at].view(np.uint64), width, gram)
                        o = at[which]
                        yield parts_of(k.view(np.int64), c.view(np.int64), docs[own[o]], rows[own[o]], start[o] + inside, w, again, binary(raw, begin[o] + inside, begin[o] + inside + w + width - 1))

    texts = docs.join(wanted, ["doc", "row"]).select("doc", "row", "text", "parts")
    return texts.mapInArrow(tidy(run), PARTS)


def cut_again(tokens: np.ndarray, size: np.ndarray, key: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Segments laid end to end, cut by the smallest hash of gram tokens: (segment, key, content, start in it, windows,
    whether it may repeat within itself)."""
    bounds = np.cumsum(size)
    least, content, start, n, inner = segments(tokens, bounds, width, gram)
    which = np.searchsorted(bounds, start, "right")
    return which, key[which] ^ mix(least, gram), content, start - (bounds - size)[which], n, inner


def parts_of(key: np.ndarray, content: np.ndarray, doc: np.ndarray, row: np.ndarray, start: np.ndarray, windows: np.ndarray, inner: np.ndarray, body: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(key), pa.array(content), pa.array(doc), pa.array(row), pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(inner), body],
        names=["key", "content", "doc", "row", "start", "windows", "inner", "body"],
    )


def binary(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """An Arrow array of raw[begin:end]."""
    size = end - begin
    offsets = np.concatenate(([0], np.cumsum(size)))
    at = np.repeat(begin - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw[at]))])


def representatives(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.RecordBatch | None, pa.Table | None]]:
    """Of PARTS rows sorted by key, content and place: (copies, None) for rows that agree with the first of their content,
    or were settled before and so have no body, and (None, shard) for tables of the other rows, of whole keys and some limit bytes."""
    held: list[pa.RecordBatch] = []
    size, last, first, first_place = 0, None, b"", None
    for batch in batches:
        known = batch.column("body").is_null()
        if known.true_count:
            yield batch.filter(known), None
            batch = batch.filter(pc.invert(known))
            if not batch.num_rows:
                continue
        key, content = batch.column("key").to_numpy(), batch.column("content").to_numpy()
        raw, off = utf8(batch.column("body"))
        data = raw.tobytes()
        place = list(zip(*(batch.column(c).to_pylist() for c in ("doc", "row", "start")), strict=True))
        lead = np.append(last is None or (key[0], content[0]) != last, (key[1:] != key[:-1]) | (content[1:] != content[:-1]))
        kind = np.zeros(len(key), np.int8)  # 0 for a representative, 1 for a copy, 2 for another mention of the first place
        for k, is_lead in enumerate(lead.tolist()):
            body = data[off[k] : off[k + 1]]
            if is_lead:
                first, first_place = body, place[k]
            elif body == first:
                kind[k] = 2 if place[k] == first_place else 1
        last = (key[-1], content[-1])
        copies = pa.array(kind == 1)
        if (kind == 1).any():
            yield batch.filter(copies), None
        own = np.flatnonzero(kind == 0)
        # what is alone in its key, its copies apart, and does not repeat within itself has nothing to be compared with
        change = np.append(True, key[own[1:]] != key[own[:-1]])
        alone = change & np.append(change[1:], False) & ~batch.column("inner").to_numpy(zero_copy_only=False)[own]
        alone[:1] = False  # its key may go on from the last batch, or into the next
        own = own[~alone]
        lo = 0
        while lo < len(own):
            grown = size + np.cumsum((off[own + 1] - off[own])[lo:])
            hi = min(len(own), lo + 1 + int(np.searchsorted(grown, limit)))
            if hi < len(own):  # to the end of its key
                hi += int(np.argmax(np.append(key[own[hi:]] != key[own[hi - 1]], True)))
            if size >= limit and held and held[-1].column("key")[-1].as_py() != key[own[lo]]:
                yield None, pa.Table.from_batches(held)
                held, size = [], 0
                continue
            held.append(batch.take(pa.array(own[lo:hi])))
            size = int(grown[hi - lo - 1])
            if size >= limit and hi < len(own):
                yield None, pa.Table.from_batches(held)
                held, size = [], 0
            lo = hi
    if held:
        yield None, pa.Table.from_batches(held)


def compared(parts: DataFrame, within: Callable[[pa.Table], tuple[np.ndarray, ...]], limit: int = 1 << 20) -> DataFrame:
    """SPANS of repeated windows among PARTS rows.

    within: of a shard, for each window its document, row, position and whether an equal one stands earlier.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for copies, table in representatives(batches, limit):
            if table is None:
                yield copies.select(["doc", "row", "start", "windows"])
            else:
                doc, row, at, again = within(table)
                yield runs(doc[again], row[again], at[again])

    return parts.repartition("key").sortWithinPartitions("key", "content", "doc", "row", "start").mapInArrow(tidy(run), SPANS)


def runs(doc: np.ndarray, row: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Positions to runs of consecutive ones; a position may be given more than once."""
    order = np.lexsort((at, row, doc))
    doc, row, at = doc[order].astype(np.int64), row[order].astype(np.int64), at[order].astype(np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (at[1:] > at[:-1] + 1)
    start = np.flatnonzero(new)
    last = np.append(start[1:], len(doc))[: len(start)] - 1
    return pa.RecordBatch.from_arrays([pa.array(doc[start]), pa.array(row[start]), pa.array(at[start].astype(np.int32)), pa.array((at[last] - at[start] + 1).astype(np.int32))], names=["doc", "row", "start", "windows"])


def repeated_spans(found: DataFrame, width: int) -> DataFrame:
    """(doc, row, spans), written: for each row the token ranges [start, end) that SPANS cover, sorted, not merged."""
    span_ = F.struct("start", (F.col("start") + F.col("windows") + F.lit(width - 1)).alias("end"))
    return written(found.groupBy("doc", "row").agg(F.sort_array(F.collect_set(span_)).alias("spans")), "spans")


def merged(spans: Iterable[dict] | None) -> list[tuple[int, int]]:
    """Maximal ranges out of sorted ones."""
    out: list[tuple[int, int]] = []
    for s in () if spans is None else spans:
        if out and s["start"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s["end"]))
        else:
            out.append((s["start"], s["end"]))
    return out
