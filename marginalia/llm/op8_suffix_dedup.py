"""Operator 8: remove byte strings that repeat in a corpus, found in suffix arrays of shards.

Texts are UTF-8 bytes. Every byte covered by a string of ``width`` bytes that also starts earlier, in a document of a
smaller id or earlier in the same one, is removed; all are judged on the input. Shards hold the stretches of the corpus
that share a content-defined key (repeats.py), so equal strings always meet in one shard; stretches that agree in all
their bytes with another are aggregated beforehand. A shard's suffix array is built by induced sorting: suffixes are
classified, the leftmost-smaller substrings sorted by recursion on their names, all others induced in linear time. It is
cut into groups where permuted common prefixes are under width; within a group all but the first position repeat.

Defined cases: a null text is empty; a null id comes before all others and is given back as null; rows of
one id and one text are one document given several times (each row is returned, a repeat found in one is removed from
all); rows of one id, or of none, and other texts are judged each by itself, in the order of a hash of the text; texts
shorter than width lose nothing; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats
from .suffix_array import common_prefixes, suffix_array
from .tables import load, release, slices, tidy, utf8

WIDTH = 100
#: Lengths of the strings whose hash is a stretch's key: the first as a rule, the others for crowded keys.
GRAMS = (32, 60)
#: Stands for a null id, before all others.
NO_ID = -(1 << 63)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, row, text): what tells rows of one id apart is a hash of their text."""
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(F.col(f"`{text_col}`")).alias("row"), F.col(f"`{text_col}`").alias("text"))


def shard_repeats(table: pa.Table, width: int) -> tuple[np.ndarray, ...]:
    """For each window of a shard's segments: its document and row, its start there, and whether an equal one is earlier."""
    raw, off = utf8(table.column("body"))
    raw, starts = raw[off[0] : off[-1]], off[:-1] - off[0]
    n = table.column("windows").to_numpy()
    used = np.flatnonzero(np.bincount(raw, minlength=256))
    kind = np.uint8 if len(used) < 256 else np.uint16
    letters = np.zeros(256, kind)
    letters[used] = np.arange(1, len(used) + 1)
    text = np.append(letters[raw], kind(0))
    sa = suffix_array(text, len(used) + 1)
    plcp = common_prefixes(text if kind is np.uint8 else np.append(raw, np.uint8(0)), sa)
    which = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    group = np.empty(len(text), np.int64)
    group[sa] = np.cumsum(plcp[sa] < width)
    group = group[starts[which] + inside]
    doc, row = table.column("doc").to_numpy()[which], table.column("row").to_numpy()[which]
    at = table.column("start").to_numpy()[which] + inside
    order = np.lexsort((at, row, doc, group))
    lead = np.append(True, group[order][1:] != group[order][:-1])
    first = order[np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))]
    again = np.empty(len(order), bool)
    again[order] = (doc[order] != doc[first]) | (row[order] != row[first]) | (at[order] != at[first])
    return doc, row, at, again


def repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc, row, spans): the byte ranges [start, end) of each row that are to go, sorted; null ids as NO_ID."""
    rows = keyed(docs, id_col, text_col)
    first, longer = (min(g, width) for g in GRAMS)
    found = repeats.candidates(rows, width, first)
    parts = repeats.fetched(repeats.with_levels(found.where("not settled")), rows, width, (longer, width))
    later = repeats.compared(parts, lambda t: shard_repeats(t, width))
    settled = found.where("settled").select("doc", "row", "start", "windows")
    return repeats.repeated_spans(settled.unionByName(later), width)


def cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """raw without the spans."""
    out, at = [], 0
    for start, end in spans:
        out.append(raw[at:start])
        at = end
    return b"".join([*out, raw[at:]])


def whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans shrunk so that no character loses only a part of its bytes."""
    out = []
    for start, end in spans:
        while start < end and raw[start] & 0xC0 == 0x80:
            start += 1
        while end > start and end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        if end > start:
            out.append((start, end))
    return out


def dedup_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """docs with repeated strings removed from text_col, whole characters only; all other columns stay."""
    spans = repeated_strings(docs, id_col, text_col, width)
    name, key, of_text = "_spans", "_doc", "_row"
    while {name, key, of_text} & set(docs.columns):
        name, key, of_text = name + "_", key + "_", of_text + "_"

    def without(text: str, spans: list[dict]) -> str:
        raw = text.encode("utf-8", "surrogatepass")
        return cut(raw, whole_characters(raw, repeats.merged(spans))).decode("utf-8", "ignore")

    @F.pandas_udf("string")
    def kept(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        texts = spans = None
        for texts, spans in batches:
            yield pd.Series([without(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)
        texts = spans = None  # what is still held can't be given back
        release()

    text = F.col(f"`{text_col}`")
    found = spans.select(F.col("doc").alias(key), F.col("row").alias(of_text), F.col("spans").alias(name))
    joined = docs.join(found, (F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)) == F.col(key)) & (F.xxhash64(text) == F.col(of_text)), "left")
    new = F.when(F.col(name).isNotNull() & text.isNotNull(), kept(F.coalesce(text, F.lit("")), F.coalesce(name, F.array()))).otherwise(text)
    return joined.withColumn(text_col, new).select(*[F.col(f"`{c}`") for c in docs.columns])


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices([batch], "text"):
            raw, off = utf8(part.column("text"))
            out = []
            for i, (doc, spans) in enumerate(zip(part.column("doc").to_pylist(), part.column("spans").to_pylist(), strict=True)):
                ranges = repeats.merged(spans)
                body = raw[off[i] : off[i + 1]]
                h, at = hashlib.sha256(), 0
                for a, b in ranges:
                    h.update(body[at:a])
                    at = b
                h.update(body[at:])
                out.append((None if doc == NO_ID else doc, len(body), sum(b - a for a, b in ranges), len(ranges), h.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 4 else pa.int64()) for k, c in enumerate(zip(*out, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    spans = repeated_strings(docs)
    rows = keyed(docs, "doc_id", "text").join(spans, ["doc", "row"], "left").select("doc", "text", "spans")
    return rows.mapInArrow(tidy(digests), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
