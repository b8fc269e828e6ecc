"""Operator 4: SimHash near-duplicates, linked by fuzzy hashing with the Golay code.

A document's fingerprint has bit i where more than half of its shingles' hashes have it. Fingerprints of at most three
differing bits are linked. Of three segments of 22, 21 and 21 bits, two at least then differ in one bit at most: if two
differed in two or more, that were four. Words of one differing bit share a codeword (golay.py), so for each pair of
segments one side files a fingerprint under the nearest codewords of both, the other looks it up under all codewords
within four bits, 28 on average. Keys have 24 bits, and their pair of segments; what shares one is compared.

Only distinct fingerprints are joined; documents get their component through their fingerprint. Defined cases: a null
or wordless text has fingerprint zero, linked like any other; fewer words than a shingle are one shingle; rows that
share an id keep their own fingerprints; a null id is given back as null and counts as the largest; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import golay
from .components import smallest_reachable
from .tables import load, slices, tidy, utf8, written

SHINGLE = 3
SEED = 42
DIFFERING = 3
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Shingles hashed at once; longer texts go in several turns.
TURN = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text, an unsigned 64-bit number."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, TURN):
        part = words[lo : lo + TURN + shingle - 1]
        joined = map(b" ".join, zip(*(part[k:] for k in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
        h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in joined], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc, row, print): every row's id, a hash of its text, and its fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            raw, off = utf8(part.column("text"))
            prints = np.array([fingerprint(raw[a:b].tobytes(), shingle) for a, b in zip(off[:-1], off[1:], strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("row"), pa.array(prints.view(np.int64))], names=["doc", "row", "print"])

    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.xxhash64(text).alias("row"), text.alias("text")).mapInArrow(tidy(run), "doc long, row long, print long")


def _segments(prints: np.ndarray) -> list[np.ndarray]:
    return [(prints >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column("print").to_numpy().view(np.uint64)
        codes = [golay.nearest(s) for s in _segments(prints)]
        for k, (a, b) in enumerate(PAIRS):
            yield pa.RecordBatch.from_arrays([pa.array((k << 24 | codes[a] << 12 | codes[b]).astype(np.int32)), pa.array(prints.view(np.int64))], names=["key", "filed"])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column("print").to_numpy().view(np.uint64)
        for lo in range(0, len(prints), 4096):
            own = prints[lo : lo + 4096]
            codes = [golay.within_four(s) for s in _segments(own)]
            for k, (a, b) in enumerate(PAIRS):
                (ca, na), (cb, nb) = codes[a], codes[b]
                keys = k << 24 | ca[:, :, None] << 12 | cb[:, None, :]
                there = (np.arange(ca.shape[1]) < na[:, None])[:, :, None] & (np.arange(cb.shape[1]) < nb[:, None])[:, None, :]
                row = np.broadcast_to(np.arange(len(own))[:, None, None], keys.shape)[there]
                yield pa.RecordBatch.from_arrays([pa.array(keys[there].astype(np.int32)), pa.array(own[row].view(np.int64))], names=["key", "print"])


def links(prints: DataFrame, differing: int = DIFFERING) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints (print) that differ in at most so many bits, three at most.

    A fingerprint has 43,744 others within three bits, whatever the size of the corpus: copies of a text are one
    fingerprint here, so that dense groups of near ones stay bounded for each of their members.
    """
    if not 0 <= differing <= DIFFERING:
        raise ValueError("the segments allow for three differing bits")
    filed = prints.mapInArrow(tidy(_filed), "key int, filed long")
    asked = prints.mapInArrow(tidy(_asked), "key int, print long")
    near = (F.col("print") < F.col("filed")) & (F.bit_count(F.col("print").bitwiseXOR(F.col("filed"))) <= differing)
    return asked.join(filed, (asked["key"] == filed["key"]) & near).select(F.col("print").alias("a"), F.col("filed").alias("b")).distinct()


def groups(docs: DataFrame, id_col: str, text_col: str, shingle: int, differing: int) -> DataFrame:
    """(doc, row, print, root, component): every row's fingerprint, the fingerprint that names its component, and the
    smallest id in that; row: a hash of the text, which tells rows of one id, or of none, apart."""
    found = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = written(found.groupBy("print").agg(F.min("doc").alias("least")), "distinct-prints")
    roots = smallest_reachable(links(distinct.select("print"), differing)).withColumnRenamed("node", "print")
    grouped = distinct.join(roots, "print", "left").select("print", F.coalesce("root", "print").alias("root"), "least")
    smallest = grouped.groupBy("root").agg(F.min("least").alias("component"))
    of_print = grouped.join(smallest, "root").select("print", "root", "component")
    return found.join(of_print, "print").select("doc", "row", "print", "root", "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, differing: int = DIFFERING) -> DataFrame:
    """(doc, print, component): every row's fingerprint and the smallest id among the documents that it reaches."""
    return groups(docs, id_col, text_col, shingle, differing).select("doc", "print", "component")


def unused(names: list[str], taken: list[str]) -> list[str]:
    """names, made longer until none is among the columns taken."""
    while {n.lower() for n in names} & {t.lower() for t in taken}:
        names = [n + "_" for n in names]
    return names


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, differing: int = DIFFERING) -> DataFrame:
    """docs with one row of each component, every column kept.

    It is the row with the smallest id; of rows that share that id the one whose text has the smallest hash, of repeated
    rows any one; a null id is the largest. Components are told apart by their fingerprint, never by an id, so that ids
    that several rows share, or no row has, lose nothing but copies. Null and wordless texts are one component.
    """
    key, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    marks = groups(docs, id_col, text_col, shingle, differing)
    stay = marks.groupBy("root").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "row")).alias("stays"))
    doc, row, place = unused(["_doc", "_row", "_place"], docs.columns)
    # a component's row is named by (id, hash): two components have no text, hence no such pair, in common
    stay = stay.select(F.col("stays.doc").alias(doc), F.col("stays.row").alias(row)).distinct()
    kept = docs.join(stay, key.eqNullSafe(F.col(doc)) & (F.xxhash64(text) == F.col(row)))
    copies = Window.partitionBy(doc, row).orderBy(row)
    return kept.withColumn(place, F.row_number().over(copies)).where(F.col(place) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(load(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
