"""Operator 7: documents that hold benchmark items, found by latent semantic retrieval.

Texts are lower-cased words between spaces and ASCII punctuation; of scripts without spaces each two letters side by
side are a word, so that an item amid others of its script has the words that it has alone. One pass writes each document as hashes of its words;
all else follows from that table. Words fall into FEATURES places, the vocabulary of the whole corpus. How many passages
of PASSAGE words hold each is counted over all documents and gives the weights; a randomised singular value
decomposition of all of the corpus's TF-IDF passages, by two distributed products A'(A X), gives the latent space. Its
rank is at most half the number of the benchmark's passages. Windows and items are folded in, V and the singular values dividing
their sum of weighted words, and compared by cosine there: what words stand together in the corpus counts, not the words
alone. A word counts once for each STRIDE, so that repeated junk beside a passage does not swamp a window; windows have
a size for each class of passage; items longer than ITEM_PASSAGE words are cut, each passage is searched, and the item
is judged over the stretch where it would lie.

Every window over the cosine threshold is checked: the longest common subsequence of the item and the words around must
have ``sure`` of the item's words; or ``likely`` of them, as a paraphrase has, if half of the words that end the item,
its answer, are there too; or ``faint``, if the cosine is CLOSE besides.

A threshold on a cosine is not exact. Of an item of which ``likely`` stands somewhere, its rarest words must meet there,
all but those that may be missing: places where NEEDED of them do are checked too (``lookup``), so that no such copy
is lost. README gives the recall of the cosine alone.

Items are taken in blocks of some BLOCK_WORDS words, a pass over the written table for each, so that what goes to the
executors is bounded. Defined cases: null and wordless texts and items match nothing; items that share an id are items of
their own, repeated items give repeated rows but once for each id; a null id is given back as null; rows that share an
id are judged each by itself, told apart by a hash of their text (``row``); of equal places the first is given; empty
tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .repeats import word_bounds, word_tokens
from .tables import load, slices, tidy, utf8, written

FEATURES = 1 << 15
RANK, OVERSAMPLING = 64, 16
PASSAGE, STRIDE, ITEM_PASSAGE = 32, 8, 48
#: For passages of up to so many words the strides of a window, and those from one window to the next.
CLASSES = ((16, 2, 1), (32, 4, 2), (ITEM_PASSAGE, 7, 2))
#: Places without words after a document, more than a window has.
GAP = 64
COSINE, CLOSE = 0.45, 0.75
SURE, LIKELY, FAINT = 0.8, 0.6, 0.5
#: Words whose share of passages is higher carry no weight in vectors; they still count in subsequences.
COMMON = 0.05
#: Rare words of an item that must meet for a place to be checked, and the stretch of words that they meet in, in item lengths.
NEEDED, STRETCH = 3, 1.25
#: Part of an item's words that end it and hold its answer.
ANSWER = 0.25
BLOCK_WORDS = 150_000
#: Bytes of word hashes in a slice; the sums of its strides, 8 bytes for each of these, then stay in a core's cache.
SLICE = 1 << 16
#: The same where the latent space is fitted: a feature's passages are added to it at once, of which larger slices have more.
FIT_SLICE = 1 << 20
#: Tasks for each core that fit the latent space: each gives FEATURES rows at most, however large the corpus is.
FIT_TASKS = 2
CODES = "doc long, row long, words binary"
RESULT = "doc_id long, row long, item_id long, start int, words int, cosine double, lcs double, answer boolean"

_PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Bytes of which texts without characters from U+0800 on are made: no script without spaces is below.
_NARROW = bytes(range(0xE0))
#: Letters of scripts without spaces (Thai, Lao, Burmese, Khmer, kana, ideographs), and the marks between them.
_UNSPACED = re.compile("[\u0e01-\u0e4e\u0e81-\u0ecd\u1000-\u109f\u1780-\u17d3\u3005-\u3007\u3041-\u30fa\u30fc-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")
_MARKS = re.compile("[\u2010-\u2027\u3000-\u3004\u3008-\u3020\u30fb\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]+")


def _pairs(run: re.Match[str]) -> str:
    letters = run[0]
    return f" {' '.join(letters[i : i + 2] for i in range(max(1, len(letters) - 1)))} "


def plain(text: str | None) -> bytes:
    text = (text or "").lower()
    raw = text.encode("utf-8", "surrogatepass")
    if raw.translate(None, _NARROW) and _UNSPACED.search(text):
        raw = _UNSPACED.sub(_pairs, _MARKS.sub(" ", text)).encode("utf-8", "surrogatepass")
    return raw.translate(_PLAIN)


def coded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all texts, where each text begins and the last ends)."""
    parts = [plain(t) for t in texts]
    raw = np.frombuffer(b" ".join(parts), np.uint8)
    begin = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts])))
    first = np.searchsorted(word_bounds(raw)[0], begin)
    return (word_tokens(raw) >> np.uint64(32)).astype(np.uint32), first


def codes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """CODES rows, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            words, first = coded(part.column("text").to_pylist())
            out = pa.array([words[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("row"), out], names=["doc", "row", "words"])

    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.xxhash64(text).alias("row"), text.alias("text"))
    return written(rows.mapInArrow(tidy(run), CODES), "codes")


@dataclass
class Block:
    """A block of items: ids, their words' codes, and the passages that they are cut into."""

    ids: list[int | None]
    words: list[np.ndarray]
    #: Of each passage its item, where it begins there, and its length.
    item: np.ndarray
    begin: np.ndarray
    length: np.ndarray


def block_of(rows: list[tuple[int | None, str | None]]) -> Block:
    rows = sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    words, first = coded([t for _, t in rows])
    own = [(i, words[a:b]) for (i, _), a, b in zip(rows, first[:-1], first[1:], strict=True) if b > a]
    cut = []
    for k, (_, w) in enumerate(own):
        starts = [*range(0, max(1, len(w) - ITEM_PASSAGE), ITEM_PASSAGE)]
        if len(w) > ITEM_PASSAGE:
            starts.append(len(w) - ITEM_PASSAGE)
        cut += [(k, s, min(ITEM_PASSAGE, len(w) - s)) for s in dict.fromkeys(starts)]
    item, begin, length = np.array(cut, np.int64).reshape(-1, 3).T
    return Block([i for i, _ in own], [w for _, w in own], item, begin, length)


@dataclass
class Placed:
    """Documents laid end to end in places, with gaps that nothing spans; all begin at a stride."""

    ids: list[int | None]
    rows: list[int]
    #: The place where each document begins, and its words.
    begin: np.ndarray
    words: np.ndarray
    #: Of each word its place and code.
    at: np.ndarray
    code: np.ndarray


def placed(batches: Iterator[pa.RecordBatch], gap: int = PASSAGE, size: int = SLICE) -> Iterator[Placed]:
    for part in slices(batches, "words", size):
        raw, off = utf8(part.column("words"))
        code = np.frombuffer(raw[off[0] : off[-1]].tobytes(), np.uint32)
        words = np.diff(off) // 4
        room = (words // gap + 2) * gap
        begin = np.cumsum(room) - room
        at = np.arange(len(code)) + np.repeat(begin - (np.cumsum(words) - words), words)
        yield Placed(part.column("doc").to_pylist(), part.column("row").to_pylist(), begin, words, at, code)


def features(code: np.ndarray) -> np.ndarray:
    return (code & np.uint32(FEATURES - 1)).astype(np.int64)


def present(p: Placed, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, feature), in order of stretches: which features stand in which stretch of size places, each once."""
    pair = p.at // size * FEATURES + features(p.code)
    again = np.zeros(len(pair), bool)
    for back in range(1, min(size, len(pair))):
        again[back:] |= pair[back:] == pair[:-back]
    pair = pair[~again]
    return pair // FEATURES, pair % FEATURES


def frequencies(found: DataFrame) -> tuple[np.ndarray, int]:
    """(passages that have each feature, passages), over the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(FEATURES + 1, np.int64)
        for p in placed(batches):
            df[:FEATURES] += np.bincount(present(p, PASSAGE)[1], minlength=FEATURES)
            df[FEATURES] += int((-(-p.words // PASSAGE)).sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["code", "n"])

    df = np.zeros(FEATURES + 1, np.int64)
    for r in found.mapInArrow(tidy(run), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():  # FEATURES rows at most
        df[r["code"]] = r["n"]
    return df[:FEATURES], int(df[FEATURES])


def run_totals(rows: np.ndarray, at: np.ndarray, lead: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, sums): the sum of rows[at] over each run of count places from lead on, in an order of falling count. The first
    places of all runs are added at once, then the second ones, and so on: whole rows, where sums of short runs would go
    number by number."""
    most = count.max(initial=0)
    order = np.argsort((most - count).astype(np.min_scalar_type(most)), kind="stable")  # those that have a k-th place come first
    lead, having = lead[order], len(lead) - np.cumsum(np.bincount(count, minlength=most + 1))
    sums = np.zeros((len(lead), rows.shape[1]), rows.dtype)
    for k in range(most):
        own = lead[: having[k]] + k
        sums[: len(own)] += rows.take(at[own], 0)
    return order, sums


def product(found: DataFrame, weight: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A'(A x) for the TF-IDF matrix A of the passages of all documents; x: features by columns."""
    context = found.sparkSession.sparkContext
    shared = context.broadcast((weight, (x * weight[:, None]).astype(np.float32)))  # FEATURES rows
    columns = [f"c{k}" for k in range(x.shape[1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, x = shared.value
        carries = weight != 0  # common words have no weight
        out = np.zeros(x.shape, np.float32)
        for p in placed(batches, size=FIT_SLICE):
            passage, feature = present(p, PASSAGE)
            some = carries[feature]
            passage, feature = passage[some], feature[some].astype(np.uint16)
            if not len(passage):
                continue
            lead = np.flatnonzero(np.diff(passage, prepend=-1))
            count = np.diff(lead, append=len(passage))
            order, y = run_totals(x, feature, lead, count)  # A x, a row for each passage
            row = np.empty(len(lead), np.int64)
            row[order] = np.arange(len(lead))
            of = np.repeat(row, count)
            order = np.argsort(feature, kind="stable")
            feature, of = feature[order], of[order]
            lead = np.flatnonzero(np.append(True, feature[1:] != feature[:-1]))
            order, sums = run_totals(y, of, lead, np.diff(lead, append=len(feature)))
            out[feature[lead[order]]] += sums
        out *= weight[:, None].astype(np.float32)
        used = np.flatnonzero(out.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(out[used, k]) for k in range(out.shape[1]))], names=["code", *columns])

    rows = found.coalesce(FIT_TASKS * context.defaultParallelism).mapInArrow(tidy(run), "code long, " + ", ".join(f"{c} float" for c in columns)).groupBy("code").agg(*(F.sum(c).cast("float").alias(c) for c in columns)).toArrow()
    out = np.zeros(x.shape)
    if len(rows):
        out[rows.column("code").to_numpy()] = np.stack([rows.column(c).to_numpy() for c in columns], 1)
    shared.destroy()
    return out


def latent_space(found: DataFrame, weight: np.ndarray, rank: int) -> np.ndarray:
    """What folds weighted features in (features by rank): V over the singular values, weights included."""
    noise = np.random.default_rng(0).standard_normal((FEATURES, rank + OVERSAMPLING))
    basis, _ = np.linalg.qr(product(found, weight, noise))
    values, turn = np.linalg.eigh(basis.T @ product(found, weight, basis))
    lead = np.argsort(-values)[:rank]
    lead = lead[values[lead] > 1e-6 * max(values.max(), 1e-12)]
    return (basis @ (turn[:, lead] / np.sqrt(values[lead])) * weight[:, None]).astype(np.float32)


def folded(block: Block, space: np.ndarray) -> np.ndarray:
    """The unit vector of each passage in the latent space; zeros if it has no weight there."""
    out = np.zeros((len(block.item), space.shape[1]), np.float32)
    for k, (i, s, n) in enumerate(zip(block.item, block.begin, block.length, strict=True)):
        out[k] = space[np.unique(features(block.words[i][s : s + n]))].sum(0)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def common_subsequence(a: list[int], b: list[int]) -> int:
    """The length of the longest common subsequence, a's places being the bits of one number."""
    places: dict[int, int] = {}
    for k, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        met = row & places.get(w, 0)
        row = (row + met | row & ~met) & full
    return len(a) - row.bit_count()


def among(code: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in code, place in the vocabulary, which is sorted) of the codes that are in both; a table of features leaves few
    to be looked up."""
    mask = np.zeros(FEATURES, bool)
    mask[features(vocabulary)] = True
    some = np.flatnonzero(mask[features(code)])
    at = np.minimum(np.searchsorted(vocabulary, code[some]), len(vocabulary) - 1)
    same = vocabulary[at] == code[some]
    return some[same], at[same]


@dataclass
class Rare:
    """The rarest words of each item: for each place of vocabulary its items (items[begin[v]:begin[v + 1]]), and what each item needs."""

    vocabulary: np.ndarray
    begin: np.ndarray
    items: np.ndarray
    needed: np.ndarray
    stretch: np.ndarray

    def places(self, p: Placed) -> tuple[np.ndarray, np.ndarray]:
        """(start, item): strides of p around which as many rare words meet as the item needs."""
        some, word = among(p.code, self.vocabulary)
        n = np.diff(self.begin)[word]
        starts, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if not len(some):
            return starts[0], items[0]
        # so many events at once that memory stays bounded; the turns overlap by the longest stretch
        turns = np.flatnonzero(np.diff(np.cumsum(n) // 1_000_000, prepend=-1))
        for lo, hi in zip(turns, np.append(turns[1:], len(some)), strict=True):
            hi = int(np.searchsorted(p.at[some], p.at[some[hi - 1]] + self.stretch.max(), "right"))
            own, m = some[lo:hi], n[lo:hi]
            item = self.items[np.repeat(self.begin[word[lo:hi]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
            at = np.repeat(p.at[own], m)
            order = np.argsort(item, kind="stable")
            item, at = item[order], at[order]
            last = np.minimum(np.arange(len(item)) + self.needed[item] - 1, len(item) - 1)
            met = (item[last] == item) & (at[last] - at < self.stretch[item]) & (np.arange(len(item)) + self.needed[item] <= len(item))
            starts.append(at[met] // STRIDE * STRIDE)
            items.append(item[met])
        pair = np.unique(np.concatenate(starts) * len(self.needed) + np.concatenate(items))
        return pair // len(self.needed), pair % len(self.needed)


def rare_words(block: Block, df: np.ndarray, share: float) -> Rare:
    """What places() needs to miss no stretch that has a share of an item's words in their order."""
    pairs, needed, stretch = [], [], []
    for k, w in enumerate(block.words):
        least = max(1, int(np.ceil(share * len(w) - 1e-9)))
        m = min(NEEDED, least)
        rare = w[np.lexsort((w, df[features(w)]))][: len(w) - least + m]
        pairs += [(c, k) for c in rare.tolist()]
        needed.append(m)
        stretch.append(int(np.ceil(STRETCH * len(w))))
    # a word that an item has twice among its rarest counts twice where it stands: never less than is there
    code, item = np.array(sorted(pairs), np.int64).T
    vocabulary, begin = np.unique(code, return_index=True)
    return Rare(vocabulary.astype(np.uint32), np.append(begin, len(code)), item, np.array(needed), np.array(stretch))


@dataclass
class Limits:
    cosine: float = COSINE
    close: float = CLOSE
    sure: float = SURE
    likely: float = LIKELY
    faint: float = FAINT


def run_sums(rows: np.ndarray, n: int) -> np.ndarray:
    """The sums of n consecutive rows, from each row on; rows past the end count as zeros."""
    power = np.concatenate((rows, np.zeros((n, rows.shape[1]), rows.dtype)))
    out, done, width = np.zeros_like(rows), 0, 1
    while width <= n:  # power: sums of width rows
        if n & width:
            out += power[done : done + len(rows)]
            done += width
        power = power[:-width] + power[width:]
        width *= 2
    return out


def stride_sums(p: Placed, space: np.ndarray, carries: np.ndarray, strides: int) -> np.ndarray:
    """The sum of the vectors of the words in each stride, a word once."""
    stride, feature = present(p, STRIDE)
    some = carries[feature]  # common words have no weight
    stride, feature = stride[some], feature[some]
    lead = np.flatnonzero(np.diff(stride, prepend=-1))
    order, added = run_totals(space, feature, lead, np.diff(lead, append=len(stride)))
    sums = np.zeros((strides, space.shape[1]), np.float32)
    sums[stride[lead[order]]] = added
    return sums


def near_windows(p: Placed, block: Block, space: np.ndarray, carries: np.ndarray, vectors: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, passage, place, cosine) of windows near a passage in the latent space; p's gaps are as wide as windows."""
    count = -(-p.words // STRIDE)
    doc = np.repeat(np.arange(len(count)), count)
    inside = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    first = p.begin[doc] // STRIDE + inside
    if not len(first):
        return
    sums = stride_sums(p, space, carries, first[-1] + 1)
    size = np.searchsorted([n for n, _, _ in CLASSES], block.length)
    for c, (_, n, step) in enumerate(CLASSES):
        own = np.flatnonzero(size == c)
        if not len(own):
            continue
        at = np.flatnonzero(inside % step == 0)
        y = run_sums(sums, n)[first[at]]
        norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", y, y)), 1e-9)
        for lo in range(0, len(own), 512):
            near = y @ vectors[own[lo : lo + 512]].T
            some = np.flatnonzero(near >= cosine * norm[:, None])
            w, k = np.divmod(some, near.shape[1])
            yield doc[at[w]], own[lo + k], first[at[w]] * STRIDE, near.ravel()[some] / norm[w]


def stretches(p: Placed, block: Block, space: np.ndarray, carries: np.ndarray, vectors: np.ndarray, rare: Rare | None, cosine: float) -> tuple[np.ndarray, ...]:
    """(document, item, first place, end, cosine): where items are to be looked for; cosine -1 if only words met."""
    found = [tuple(np.concatenate(x) for x in zip(*near, strict=True)) for near in [list(near_windows(p, block, space, carries, vectors, cosine))] if near]
    size = np.array([len(w) for w in block.words])
    rows = [(*(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0))]
    for doc, k, at, near in found:
        item = block.item[k]
        wide = np.array([STRIDE * (n + step - 1) for _, n, step in CLASSES])[np.searchsorted([n for n, _, _ in CLASSES], block.length[k])]
        slack = np.maximum(16, size[item] // 4)
        rows.append((doc, item, at - block.begin[k] - slack, at + wide + size[item] - block.begin[k] - block.length[k] + slack, near.astype(np.float64)))
    if rare is not None:
        at, item = rare.places(p)
        rows.append((np.searchsorted(p.begin, at, "right") - 1, item, at - rare.stretch[item], at + STRIDE + rare.stretch[item], np.full(len(at), -1.0)))
    doc, item, lo, hi, near = (np.concatenate(x) for x in zip(*rows, strict=True))
    lo, hi = np.maximum(lo, p.begin[doc]), np.minimum(hi, p.begin[doc] + p.words[doc])
    order = np.lexsort((lo, doc * len(size) + item))
    return side_by_side(*(x[order] for x in (doc, item, lo, hi, near)), 2 * size + 96)


def side_by_side(doc: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, near: np.ndarray, longest: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows in order of document, item and lo, those that touch made one: up to the longest stretch of the item, beyond which
    the next begins."""
    if not len(doc):
        return doc, item, lo, hi, near
    other = np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]))
    apart = (np.cumsum(other) - 1) * (int(hi.max()) + 1)  # the ends of one document and item are all before those of the next
    end = np.maximum.accumulate(hi + apart) - apart
    lead = np.flatnonzero(other | np.append(True, lo[1:] > end[:-1]))
    last = np.append(lead[1:], len(doc)) - 1
    long = end[last] - lo[lead] > longest[item[lead]]
    cut = []
    for a, b in zip(lead[long].tolist(), last[long].tolist(), strict=True):
        most, rows = int(longest[item[a]]), zip(range(a, b + 1), lo[a : b + 1].tolist(), hi[a : b + 1].tolist(), strict=True)
        _, begin, until = next(rows)
        for k, x, y in rows:
            if x <= until and max(y, until) - begin <= most:
                until = max(y, until)
            else:
                cut.append(k)
                begin, until = x, y
    lead = np.union1d(lead, np.array(cut, np.int64))
    return doc[lead], item[lead], lo[lead], np.maximum.reduceat(hi, lead), np.maximum.reduceat(near, lead)


@dataclass
class Shares:
    """The words of all items, sorted, and how often each item has each: a table by a hash of both, in which those that share
    a place are added up, so that what it says is never too low."""

    vocabulary: np.ndarray
    of_word: np.ndarray
    of_item: np.ndarray
    table: np.ndarray

    def most(self, word: np.ndarray, item: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How many words of each item are among word[begin:end] (places in the vocabulary), at most."""
        out = np.zeros(len(item), np.int64)
        if not len(item):
            return out
        order = np.argsort(word, kind="stable")
        before = np.full(len(word), -1)  # where the same word was last
        before[order[1:]] = np.where(word[order[1:]] == word[order[:-1]], order[:-1], -1)
        mark, n = self.of_word[word], end - begin
        turns = np.flatnonzero(np.diff(np.cumsum(n) // 500_000, prepend=-1))  # memory stays bounded
        for lo, hi in zip(turns, np.append(turns[1:], len(n)), strict=True):
            m = n[lo:hi]
            upto = np.cumsum(m)
            at = np.arange(m.sum()) + np.repeat(begin[lo:hi] - (upto - m), m)
            has = self.table[mark[at] ^ np.repeat(self.of_item[item[lo:hi]], m)]
            has[before[at] >= np.repeat(begin[lo:hi], m)] = 0
            total = np.append(0, np.cumsum(has))
            out[lo:hi] = total[upto] - total[upto - m]
        return out


def shares(block: Block) -> Shares:
    vocabulary = np.unique(np.concatenate(block.words))
    words = np.searchsorted(vocabulary, np.concatenate(block.words))
    items = np.repeat(np.arange(len(block.words)), [len(w) for w in block.words])
    places = 1 << min(23, max(10, int(32 * len(words)).bit_length()))  # an item of very many words shares places, so that memory stays bounded
    rng = np.random.default_rng(1)
    of_word, of_item = (rng.integers(0, places, n, np.int32) for n in (len(vocabulary), len(block.words)))
    return Shares(vocabulary, of_word, of_item, np.bincount(of_word[words] ^ of_item[items], minlength=places).astype(np.int32))


def search(found: DataFrame, block: Block, space: np.ndarray, rare: Rare | None, limits: Limits) -> DataFrame:
    """RESULT rows: the best place of each item in each document that has it."""
    shared = found.sparkSession.sparkContext.broadcast((block, space, folded(block, space), rare, shares(block)))  # FEATURES x RANK and BLOCK_WORDS numbers
    least = min(limits.faint, limits.likely, limits.sure)
    names = [c.split()[0] for c in RESULT.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.bool_())

    def judged(p: Placed, d: int, k: int, lo: int, hi: int, near: float, own: list[int], block: Block, items: list[list[int]], space: np.ndarray) -> Iterator[tuple]:
        item, there = items[k], set(own)
        if sum(map(there.__contains__, item)) < least * len(item):
            return
        share = common_subsequence(item, own) / len(item)
        end = item[-max(1, round(ANSWER * len(item))) :]
        answer = 2 * sum(map(there.__contains__, end)) >= len(end)
        if share >= limits.sure or answer and (share >= limits.likely or share >= limits.faint and near >= limits.close):
            if near < 0:  # of the words looked at
                a, b = np.searchsorted(p.at, (lo, hi))
                x, y = (space[np.unique(features(w))].sum(0) for w in (block.words[k], p.code[a:b]))
                near = float(x @ y / max(np.linalg.norm(x) * np.linalg.norm(y), 1e-12))
            yield p.ids[d], p.rows[d], block.ids[k], int(lo - p.begin[d]), int(hi - lo), max(-1.0, min(1.0, near)), share, answer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, space, vectors, rare, known = shared.value
        carries = space.any(1)
        items = [w.tolist() for w in block.words]
        needed = least * np.array([len(w) for w in items])
        rows: list[tuple] = []
        for p in placed(batches, GAP):
            own, word = among(p.code, known.vocabulary)
            code, at = p.code[own], p.at[own]
            done: set[tuple[int, int]] = set()
            places = stretches(p, block, space, carries, vectors, rare, limits.cosine)
            begin, end = np.searchsorted(at, places[2]), np.searchsorted(at, places[3])
            item = places[1]
            some = known.most(word, item, begin, end) >= needed[item]
            for d, k, lo, hi, near, a, b in zip(*(x[some].tolist() for x in (*places, begin, end)), strict=True):
                if (d, k) in done:
                    continue
                for row in judged(p, d, k, lo, hi, near, code[a:b].tolist(), block, items, space):
                    rows.append(row)
                    if row[6] == 1:  # nothing is better
                        done.add((d, k))
            if len(rows) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    out = found.mapInArrow(tidy(run), RESULT)
    best = F.max(F.struct("lcs", "answer", "cosine", (-F.col("start")).alias("back"), "words")).alias("best")
    return out.groupBy("doc_id", "row", "item_id").agg(best).select("doc_id", "row", "item_id", (-F.col("best.back")).cast("int").alias("start"), "best.words", "best.cosine", "best.lcs", "best.answer")


def weights(df: np.ndarray, passages: int) -> np.ndarray:
    """Inverse document frequencies; 0 for common features, unless all are."""
    weight = np.where(df > COMMON * passages + 1, 0.0, np.log((1 + passages) / (1 + df)))
    return weight if (weight[df > 0] > 0).any() else np.ones(FEATURES)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", limits: Limits | None = None, lookup: bool = True, space: np.ndarray | None = None) -> DataFrame:
    """RESULT rows for all documents and items. space: a latent space other than that of the documents."""
    spark, limits = docs.sparkSession, limits or Limits()
    bench = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item"), F.col(f"`{item_text_col}`").alias("text")).where("text is not null")
    items, size = bench.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    blocks = max(1, -(-(size or 0) // (6 * BLOCK_WORDS)))
    out = spark.createDataFrame([], RESULT)
    if not items:
        return out
    found = codes(docs, id_col, text_col)
    df, passages = frequencies(found)
    if not passages:
        return out
    weight = weights(df, passages)
    if space is None:
        space = latent_space(found, weight, max(1, min(RANK, (items + size // (7 * ITEM_PASSAGE)) // 2)))
    for b in range(blocks):
        rows = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).distinct().collect()
        block = block_of([(r["item"], r["text"]) for r in rows])
        if block.ids:
            out = out.unionByName(search(found, block, space, rare_words(block, df, min(limits.sure, limits.likely)) if lookup else None, limits))
    return out


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).drop("row")
