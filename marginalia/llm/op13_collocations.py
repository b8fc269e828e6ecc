"""Operator 13: collocations, phrases whose words stand together more often than their parts would by chance.

Texts, A-Z lower-cased, are cut into pieces at marks and ends of lines, and those into words. Three scans find how often
each phrase of one to ``longest`` words stands in the pieces of a language, for all that do so ``least`` times:

1. Every task gives the hashes of its phrases, cut to ``bits`` bits, with their counts: sorted, as differences, in
   stretches by their first bits. Summed over all tasks the counter of a hash is an upper bound of its phrases' counts;
   the counters that reached ``least`` are kept by number, and travel to all tasks.
2. A phrase is a candidate if its bound, and those of all phrases inside it, reach ``least``. No phrase that does can
   miss; one that doesn't costs time alone.
3. Candidates, dealt to blocks of bounded bytes by language, are compiled into Aho-Corasick automata, one for each block and
   language. Words are guarded by a space on either side and pieces by a line end, so that only whole words of one piece
   match, overlapping matches too. A job for each block scans the texts of its languages; tasks give the matches of each
   candidate, which are summed, and only then held against ``least``.

Scores are integer quotients in decimal(38), exact up to 10**11 words. There are as many counters as the corpus has bytes,
about, so that rare phrases do not fill them however large it is; no task holds more of them than a stretch. Were there
fewer, candidates would grow in number, not results in error.

Defined cases: null texts are empty; a null language is `und`; ids are not read, repeated rows count each time; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .repeats import byte_tokens, mix, prefix, span
from .tables import load, new_path, slices, tidy, utf8, written

LEAST, LONGEST, TOP, SHARE = 100, 5, 2000, 100
NO_LANGUAGE = "und"
#: Bits of a counter's number at least and at most, of counters that a task sums at once, and of phrases' counts in a row.
LEAST_BITS, BITS, SUMMED, STRETCH = 16, 40, 24, 16
#: Bits of the number of stretches at least, hashes that a task holds back, and bytes of text handled at once.
SPREAD, HASHES, SLICE = 6, 8 << 20, 2 << 20
#: Tasks for each core in which candidates are looked up: each task gives each of its candidates once.
TASKS = 4
#: Bits of a bucket's number in which phrases are merged, and bytes of them that a task holds back.
BUCKETS, HELD = 8, 8 << 20
#: Bytes of the phrases in a block of automata, about.
BLOCK_BYTES = 6 << 20

#: Of each byte: 0 in words, 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Phrases:
    """The words of a slice of texts, laid end to end, and the hashes of the phrases that begin at each."""

    def __init__(self, part: pa.RecordBatch) -> None:
        raw, off = utf8(part.column("text"))
        raw = _LOWER[np.insert(raw[off[0] : off[-1]], off[1:-1] - off[0], 0x0A)]
        self.begin = off - off[0] + np.arange(len(off))
        kind = _KIND[raw]
        edge = np.diff(np.concatenate(([0], (kind == 0).view(np.int8), [0])))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.raw, self.starts, self.ends = raw, starts, ends
        #: Of each word its piece, and its text.
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
        self.first = np.searchsorted(starts, self.begin)
        self.text = np.repeat(np.arange(part.num_rows), np.diff(self.first))

    def hashes(self, langs: list[str], longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For phrases of 1 to longest words: the words at which one begins, and its hash, which the language enters."""
        known = {x: int.from_bytes(x.encode()[:64].rjust(8, b"\0"), "big") % (1 << 64) for x in set(langs)}
        of_text = mix(np.array([known[x] for x in langs], np.uint64), 17)
        words = mix(span(prefix(byte_tokens(self.raw)), self.starts, self.ends), 7)
        sums, n = prefix(words), len(words)
        for k in range(1, longest + 1):
            at = np.flatnonzero(self.piece[k - 1 :] == self.piece[: n - k + 1]) if n >= k else np.zeros(0, np.int64)
            yield at, mix(span(sums, at, at + k) + of_text[self.text[at]], k)

    def spaced(self) -> tuple[bytes, np.ndarray]:
        """(bytes, where each word starts): words with one space behind each."""
        size = self.ends - self.starts + 1
        begin = np.concatenate(([0], np.cumsum(size)))
        out = np.append(self.raw, np.uint8(32))[np.repeat(self.starts - begin[:-1], size) + np.arange(begin[-1])]
        out[begin[1:] - 1] = 32
        return out.tobytes(), begin

    def guarded(self) -> Iterator[str]:
        """Each text's pieces, ' word word ' and a line end behind each piece."""
        new = np.concatenate(([1], np.diff(self.piece) != 0)).astype(np.int64)[: len(self.starts)]
        size = self.ends - self.starts + 1 + 2 * new  # of a piece's first word: line end and space before it
        begin = np.concatenate(([0], np.cumsum(size)))
        lead = 2 * new
        out = np.full(begin[-1], 32, np.uint8)
        length = self.ends - self.starts
        inside = np.repeat(begin[:-1] + lead - np.concatenate(([0], np.cumsum(length)))[:-1], length) + np.arange(length.sum())
        out[inside] = self.raw[_KIND[self.raw] == 0]
        out[begin[:-1][new == 1]] = 0x0A
        whole = out.tobytes()
        for a, b in zip(begin[self.first[:-1]], begin[self.first[1:]], strict=True):
            yield whole[a:b].decode()


def _languages(part: pa.RecordBatch) -> list[str]:
    return [x if x is not None else NO_LANGUAGE for x in part.column("lang").to_pylist()]


def cells(h: np.ndarray, bits: int) -> np.ndarray:
    """The numbers of the counters of hashes."""
    return h & np.uint64((1 << bits) - 1)


def bits_for(size: int) -> int:
    """Bits of a counter's number for a corpus of so many bytes, of which a phrase begins at each, about: a word has five
    or six with its space, and begins five phrases."""
    return min(BITS, max(LEAST_BITS, size.bit_length()))


def stretch_bits(bits: int) -> int:
    """Bits of a counter's number within its stretch."""
    return max(0, min(bits - SPREAD, SUMMED))


def packed(numbers: np.ndarray) -> bytes:
    """Ascending whole numbers below 2**32 as differences, their bytes by significance, compressed."""
    return pa.compress(np.diff(numbers, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def unpacked(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.int64)


def heavy_cells(rows: DataFrame, least: int, longest: int, bits: int) -> DataFrame:
    """(stretch, size, heavy): the counters, by number within their stretch, that phrases of rows (lang, text) bring to least."""
    within = stretch_bits(bits)
    kind = np.dtype("<u1" if least <= 255 else "<u2" if least <= 65535 else "<i8")  # beyond least a count says no more

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def done() -> pa.RecordBatch:
            own = np.concatenate(held)
            held.clear()
            own.sort()
            at = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            times = np.minimum(np.diff(at, append=len(own)), least).astype(kind)
            own = own[at]
            ends = np.searchsorted(own, (np.arange(1, 1 << (bits - within), dtype=np.uint64) << np.uint64(within)).astype(own.dtype)).tolist()
            parts = [(a, b) for a, b in zip([0, *ends], [*ends, len(own)], strict=True) if a < b]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([int(own[a]) >> within for a, _ in parts], pa.int32()),
                    pa.array([b - a for a, b in parts], pa.int32()),
                    pa.array([packed(own[a:b] & own.dtype.type((1 << within) - 1)) for a, b in parts], pa.binary()),
                    pa.array([pa.compress(times[a:b].tobytes(), "zstd", asbytes=True) for a, b in parts], pa.binary()),
                ],
                names=["stretch", "size", "cells", "counts"],
            )

        for part in slices(batches, "text", SLICE):
            for _, h in Phrases(part).hashes(_languages(part), longest):
                if len(h):
                    held.append(cells(h, bits).astype(np.uint32 if bits <= 32 else np.uint64))
            if sum(map(len, held)) > HASHES:
                yield done()
        if held:
            yield done()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def done() -> pa.RecordBatch:
            heavy = np.flatnonzero(total >= least)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([len(heavy)], pa.int32()), pa.array([packed(heavy)], pa.binary())], names=["stretch", "size", "heavy"])

        for batch in batches:
            for k, n, numbers, counts in zip(batch.column("stretch").to_pylist(), batch.column("size").to_pylist(), batch.column("cells"), batch.column("counts"), strict=True):
                if k != now:
                    if now is not None:
                        yield done()
                    now, total = k, np.zeros(1 << within, np.int32 if least < 1 << 30 else np.int64)
                at = unpacked(numbers.as_py(), n)
                total[at] = np.minimum(total[at] + np.frombuffer(pa.decompress(counts.as_py(), n * kind.itemsize, "zstd", asbytes=True), kind), least)
        if now is not None:
            yield done()

    counted = rows.mapInArrow(tidy(count), "stretch int, size int, cells binary, counts binary")
    return counted.repartition("stretch").sortWithinPartitions("stretch").mapInArrow(tidy(add), "stretch int, size int, heavy binary")


class Heavy:
    """Numbers of counters, ascending, and a bit for each of sixteen times as many places, by which most others are told."""

    def __init__(self, numbers: np.ndarray) -> None:
        self.numbers = numbers
        self.mask = np.uint64((1 << max(3, (16 * len(numbers)).bit_length())) - 1)
        bit = np.zeros(int(self.mask) + 1, bool)
        bit[(numbers & self.mask).astype(np.int64)] = True
        self.bit = np.packbits(bit)

    def has(self, numbers: np.ndarray) -> np.ndarray:
        at = (numbers & self.mask).astype(np.int64)
        yes = (self.bit[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        some = numbers[yes]
        place = np.minimum(np.searchsorted(self.numbers, some), len(self.numbers) - 1)
        yes[yes] = self.numbers[place] == some if len(self.numbers) else False
        return yes


def candidates(rows: DataFrame, heavy: np.ndarray, bits: int, longest: int) -> DataFrame:
    """(lang, phrase, n): phrases whose bounds reach least, of n 0; and for each language the empty phrase, n its words.

    heavy: the counters that do, ascending. A task gives each of its phrases once, those of a bucket of hashes in one row;
    buckets are merged one at a time. What is sent follows the number of tasks, which so is bounded by that of cores.
    """
    context = rows.sparkSession.sparkContext
    sent = context.broadcast(heavy)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Heavy(sent.value)
        seen = np.zeros(0, np.uint64)
        words: Counter[str] = Counter()
        held: dict[int, list[tuple[str, str]]] = {}
        size = 0

        def rows_of(held: dict[int, list[tuple[str, str]]], counts: list[int] | None = None) -> pa.RecordBatch:
            keys = sorted(held)
            lists = [pa.array([[x[k] for x in held[b]] for b in keys], pa.list_(pa.string())) for k in (0, 1)]
            n = pa.array([[0] * len(held[b]) for b in keys] if counts is None else [[c] for c in counts], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *lists, n], names=["bucket", "langs", "phrases", "n"])

        for part in slices(batches, "text", SLICE):
            own, langs = Phrases(part), _languages(part)
            whole, begin = own.spaced()
            for lang, n in zip(langs, np.diff(own.first).tolist(), strict=True):
                words[lang] += n
            may = np.ones(len(own.starts) + 1, bool)
            for k, (at, h) in enumerate(own.hashes(langs, longest), 1):
                yes = may[at] & (may[at + 1] if k > 1 else True)
                yes[yes] = known.has(cells(h[yes], bits))
                may = np.zeros(len(own.starts) + 1, bool)
                may[at[yes]] = True
                h, first = np.unique(h[yes], return_index=True)
                place = np.searchsorted(seen, h)
                new = np.ones(len(h), bool)
                new[place < len(seen)] = seen[place[place < len(seen)]] != h[place < len(seen)]
                seen = np.insert(seen, place[new], h[new])
                for i, bucket in zip(at[yes][first[new]].tolist(), (h[new] >> np.uint64(64 - BUCKETS)).tolist(), strict=True):
                    phrase = whole[begin[i] : begin[i + k] - 1].decode()
                    held.setdefault(bucket, []).append((langs[own.text[i]], phrase))
                    size += len(phrase)
            if size > HELD:
                yield rows_of(held)
                held, size = {}, 0
        if held:
            yield rows_of(held)
        for lang, n in words.items():
            yield rows_of({zlib.crc32(lang.encode()) >> (32 - BUCKETS): [(lang, "")]}, [n])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, Counter()

        def done() -> pa.RecordBatch:
            lang, phrase = zip(*total, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(phrase, pa.string()), pa.array(total.values(), pa.int64())], names=["lang", "phrase", "n"])

        for batch in batches:
            for k, bucket in enumerate(batch.column("bucket").to_pylist()):
                if bucket != now:
                    if now is not None:
                        yield done()
                    now, total = bucket, Counter()
                for lang, phrase, n in zip(*(batch.column(c)[k].as_py() for c in ("langs", "phrases", "n")), strict=True):
                    total[lang, phrase] += n
        if now is not None:
            yield done()

    found = rows.coalesce(TASKS * context.defaultParallelism).mapInArrow(tidy(find), "bucket int, langs array<string>, phrases array<string>, n array<bigint>")
    return found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(merge), "lang string, phrase string, n long")


def in_blocks(phrases: DataFrame, block_bytes: int) -> tuple[str, DataFrame]:
    """(folder, table): (block, place, lang, phrase); in the folder block k is in block=k.

    Languages are laid end to end by the bytes of their phrases, and each phrase falls somewhere in its language's stretch
    by its hash: blocks of block_bytes, about, hold one language or neighbouring ones, whatever the number of partitions.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, 0
        for batch in batches:
            places = []
            for block in batch.column("block").to_pylist():
                at = at + 1 if block == now else 0
                now = block
                places.append(at)
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(places, pa.int32()), batch.column("lang"), batch.column("phrase")], names=["block", "place", "lang", "phrase"])

    spark, folder = phrases.sparkSession, new_path(phrases.sparkSession, "phrases")
    sizes = phrases.groupBy("lang").agg(F.sum(F.octet_length("phrase") + 2).alias("bytes"))
    ends = Window.orderBy("lang").rowsBetween(Window.unboundedPreceding, -1)  # a row for each language
    laid = sizes.withColumn("begin", F.coalesce(F.sum("bytes").over(ends), F.lit(0)))
    block = F.floor((F.col("begin") + F.pmod(F.xxhash64("phrase"), F.col("bytes"))) / block_bytes).cast("int")
    dealt = phrases.join(laid, "lang").select(block.alias("block"), "lang", "phrase").repartition("block").sortWithinPartitions("block", "lang", "phrase")
    schema = "block int, place int, lang string, phrase string"
    dealt.mapInArrow(number, schema).write.partitionBy("block").parquet(folder)
    return folder, spark.read.schema(schema).parquet(folder)


def block_of(folder: str, block: int) -> pa.Table:
    """The phrases of a block, in the order of their places."""
    place, at = fs.FileSystem.from_uri(f"{folder}/block={block}")
    return ds.dataset(at, filesystem=place, format="parquet").to_table(columns=["place", "lang", "phrase"]).sort_by("place")


_automata: dict[str, tuple[dict[str, ahocorasick.Automaton], int]] = {}


def automata(folder: str, block: int) -> tuple[dict[str, ahocorasick.Automaton], int]:
    """The automata of a block, by language, and its number of phrases; a worker keeps those of one block."""
    path = f"{folder}/block={block}"
    if path not in _automata:
        _automata.clear()
        table = block_of(folder, block)
        made: dict[str, ahocorasick.Automaton] = {}
        for k, lang, phrase in zip(*(table.column(c).to_pylist() for c in ("place", "lang", "phrase")), strict=True):
            made.setdefault(lang, ahocorasick.Automaton(ahocorasick.STORE_INTS)).add_word(f" {phrase} ", k)
        for a in made.values():
            a.make_automaton()
        _automata[path] = made, table.num_rows
    return _automata[path]


def matched(rows: DataFrame, folder: str, block: int) -> DataFrame:
    """(block, stretch, size, counts): how often each task of rows (lang, text) finds the phrases of a block, 2**STRETCH
    phrases to a row, so that what a task sends follows its automata's size in bytes, not in rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, size = automata(folder, block)
        counts = np.zeros(size, np.int64)
        for part in slices(batches, "text", SLICE):
            found: list[int] = []
            for lang, text in zip(_languages(part), Phrases(part).guarded(), strict=True):
                if lang in made and text:
                    found.extend(k for _, k in made[lang].iter(text))
            counts += np.bincount(found, minlength=size) if found else 0
        for k in range(0, size, 1 << STRETCH):
            own = counts[k : k + (1 << STRETCH)]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([k >> STRETCH], pa.int32()), pa.array([len(own)], pa.int32()), pa.array([pa.compress(own.tobytes(), "zstd", asbytes=True)])], names=["block", "stretch", "size", "counts"])

    return rows.mapInArrow(tidy(run), "block int, stretch int, size int, counts binary")


def summed(counts: DataFrame, folder: str, least: int) -> DataFrame:
    """(lang, phrase, f) of the phrases that all tasks together found least times."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(0, np.int64)

        def done() -> pa.RecordBatch:
            own = block_of(folder, now[0]).slice(now[1] << STRETCH, len(total)).select(["lang", "phrase"])
            return own.append_column("f", pa.array(total)).filter(pa.array(total >= least)).combine_chunks()

        for batch in batches:
            for block, stretch, blob, size in zip(*(batch.column(c).to_pylist() for c in ("block", "stretch", "counts", "size")), strict=True):
                if now != (block, stretch):
                    if now is not None:
                        yield from done().to_batches()
                    now, total = (block, stretch), np.zeros(size, np.int64)
                total += np.frombuffer(pa.decompress(blob, 8 * size, "zstd", asbytes=True), np.int64)
        if now is not None:
            yield from done().to_batches()

    return counts.repartition("block", "stretch").sortWithinPartitions("block", "stretch").mapInArrow(tidy(add), "lang string, phrase string, f long")


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, bits: int | None = None, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, f) of every phrase of at most longest words that stands least times; (lang, n) of every language)."""
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    if bits is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = bits_for(size)
    parts = [np.zeros(0, np.uint64)]
    for r in sorted(heavy_cells(rows, least, longest, bits).collect()):  # of the counters those that reach least alone
        parts.append((unpacked(r["heavy"], r["size"]) + (r["stretch"] << stretch_bits(bits))).astype(np.uint64))
    heavy = np.concatenate(parts)
    found = written(candidates(rows, heavy, bits, longest), "candidates")
    phrases = found.where("phrase <> ''")
    spark = docs.sparkSession
    folder, blocks = in_blocks(phrases, block_bytes)
    counts = None
    for r in sorted(blocks.groupBy("block").agg(F.min("lang").alias("low"), F.max("lang").alias("high")).collect()):
        own = matched(rows.where(F.col("lang").between(r["low"], r["high"])), folder, r["block"])
        counts = own if counts is None else counts.unionByName(own)
    totals = written(found.where("phrase = ''").select("lang", "n"), "words")
    if counts is None:
        return spark.createDataFrame([], "lang string, phrase string, f long"), totals
    return written(summed(counts, folder, least), "phrase-counts"), totals


def scored(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score) of the phrases of two words or more, by their lowest-scoring cut."""
    words = F.split("phrase", " ")
    whole = counts.withColumn("words", words).where(F.size("words") > 1)
    side = lambda k, first, part: F.struct(k.alias("k"), F.lit(first).alias("first"), F.array_join(part, " ").alias("part"))
    sides = F.flatten(F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda k: F.array(side(k, True, F.slice("words", F.lit(1), k)), side(k, False, F.slice("words", k + 1, F.size("words"))))))
    cut = whole.select("lang", "phrase", F.col("f").alias("a"), F.explode(sides).alias("x")).select("lang", "phrase", "a", "x.k", "x.first", F.col("x.part").alias("part"))
    known = counts.select("lang", F.col("phrase").alias("part"), "f")
    halves = cut.join(known, ["lang", "part"]).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.collect_list(F.struct("k", "first", "f")).alias("halves"))  # two for each of at most longest - 1 cuts
    of = lambda k, first: F.filter("halves", lambda h: (h["k"] == k) & (h["first"] == F.lit(first)))[0]["f"]
    both = halves.withColumn("words", words).select("lang", "phrase", "words", "a", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda k: F.struct(k.alias("k"), of(k, True).alias("l"), of(k, False).alias("r")))).alias("x"))
    exact = both.join(totals, "lang").select("lang", "phrase", "words", "a", "x.k", "x.l", "x.r", "n")
    exact = exact.withColumn("score", F.expr("(cast(a as decimal(16, 0)) * cast(n as decimal(16, 0)) * cast(1000 as decimal(4, 0))) div (cast(l as decimal(16, 0)) * cast(r as decimal(16, 0)))"))
    least = exact.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("words").alias("words"), F.first("a").alias("a"), F.first("n").alias("n"))
    return least.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "n", "cut.score")


def not_inside(found: DataFrame, share: int = SHARE) -> DataFrame:
    """found without phrases that stand inside a longer one, of which share hundredths of their occurrences are."""
    size = F.size("words")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.array_join(F.slice("words", i, k), " "))))
    inside = F.when(size > 2, F.transform(inner, lambda p: F.struct(p.alias("phrase"), F.lit(None).cast(found.select(F.struct("words", "a", "l", "r", "n", "score").alias("own")).schema["own"].dataType).alias("own"), F.col("a").alias("longer"))))
    self = F.array(F.struct("phrase", F.struct("words", "a", "l", "r", "n", "score").alias("own"), F.lit(None).cast("long").alias("longer")))
    rows = found.select("lang", F.explode(F.concat(self, F.coalesce(inside, F.slice(self, 1, 0)))).alias("x")).select("lang", "x.*")
    most = rows.groupBy("lang", "phrase").agg(F.max("own").alias("own"), F.max("longer").alias("longer"))
    kept = most.where(F.coalesce(100 * F.col("longer") < share * F.col("own.a"), F.lit(True)))
    return kept.select("lang", "phrase", "own.*")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, share: int = SHARE, **sizes: int) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all phrases that stand least times and not only inside longer ones."""
    counts, totals = phrase_counts(docs, text_col, lang_col, least, longest, **sizes)
    return not_inside(scored(counts, totals), share).drop("words")


def first_of_each(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first of each language by score, then occurrences, then the phrase's bytes; rank from 1."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("long"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = first_of_each(collocations(load(spark, sf_dir, "documents")))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces WHERE piece <> ''),
phrases AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase
  FROM words, range(1, 6) AS ks(k) WHERE len(w) >= k
), counts AS (SELECT lang, phrase, k, count(*) AS f FROM phrases GROUP BY ALL HAVING count(*) >= 100),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
cut AS (
  SELECT c.lang, c.phrase, string_split(c.phrase, ' ') AS w, c.k AS size, c.f AS a, cuts.k
  FROM counts c, range(1, 5) AS cuts(k) WHERE cuts.k < c.k
), scores AS (
  SELECT cut.*, x.f AS l, y.f AS r, n, 1000::HUGEINT * a * n // (x.f::HUGEINT * y.f) AS score
  FROM cut JOIN counts x ON x.lang = cut.lang AND x.phrase = array_to_string(w[1 : cut.k], ' ')
  JOIN counts y ON y.lang = cut.lang AND y.phrase = array_to_string(w[cut.k + 1 :], ' ') JOIN totals t ON t.lang = cut.lang
), least AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM least s WHERE NOT EXISTS (
    SELECT 1 FROM least b WHERE b.lang = s.lang AND b.size > s.size AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * b.a >= 100 * s.a)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""
