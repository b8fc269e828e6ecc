"""Operator 11: document fingerprints by consistent weighted sampling.

A document is a weighted set: its words (runs of bytes other than white space, A-Z lower-cased), each weighted by how
often it stands there. For each of ``samples`` independent samples a term draws r and c from Gamma(2, 1) and b from
[0, 1), all from a hash of the term and the sample's number alone; with weight w

    t = floor(ln w / r + b),   ln a = ln c - r * (t - b + 1),

and the term of the least a is the sample, with its t. Two documents draw the same (term, t) with a probability that
equals their generalised Jaccard similarity, the sum of their terms' lesser weights by that of the greater. A fingerprint
keeps 16 bits of a hash of each (term, t), so that different samples agree by chance once in 65,536 times.

Draws are made once for each different (term, weight) of a slice of texts; a document then takes the least of its terms'
values, found together with their hashes as one number. Long texts go through in blocks of terms, with a running least.

op11_fingerprints() compares each document with the next one, by descending id, and with its own text edited by it. One
shuffle sorts whole texts into ranges of ids; tasks stream them, holding one text back. The last text of each range meets
the first of the next in a join of as many rows as there are ranges.

Defined cases: a null text is empty; a wordless text has the fingerprint of all bits set, like any other such, and likeness
1 to it; rows that share an id follow each other by a hash of their text, repeated rows are documents of their own; null
ids come last; a single document is its own next; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .repeats import mix, word_bounds, word_tokens
from .tables import load, slices, tidy, utf8, written

SAMPLES = 128
#: Bytes of text that are fingerprinted together, and (term, weight) pairs whose draws are held at once.
SLICE, PAIRS = 2 << 20, 1 << 15
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def draws(terms: np.ndarray, weights: np.ndarray, samples: int) -> np.ndarray:
    """Of each (term, weight) and sample one number: the bits of a above, 16 bits of a hash of (term, t) below."""
    out = np.empty((len(terms), samples), np.uint64)
    numbers = (np.arange(samples, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    part, log_w = np.uint64(0xFFFFFF), np.log(weights).astype(np.float32)
    half, unit = np.float32(0.5), np.float32(2.0**-24)

    def uniform(bits: np.ndarray, at: int) -> np.ndarray:
        return ((bits >> np.uint64(at) & part).astype(np.float32) + half) * unit

    for lo in range(0, len(terms), 512):
        own = terms[lo : lo + 512, None]
        h = mix(own + numbers[None, :])
        g = mix(h, 1)
        r = -np.log(uniform(h, 40) * uniform(h, 16))
        c = -np.log(uniform(g, 40) * uniform(g, 16))
        b = ((h & np.uint64(0xFFFF)) << np.uint64(8) | g & np.uint64(0xFF)).astype(np.float32) * unit
        t = np.floor(log_w[lo : lo + 512, None] / r + b)
        a = c * np.exp(-r * (t - b + np.float32(1)))  # positive, so that its bits are ordered as it is
        code = mix(own + mix(t.astype(np.int64).view(np.uint64), 11)) >> np.uint64(48)
        out[lo : lo + 512] = a.view(np.uint32).astype(np.uint64) << np.uint64(32) | code
    return out


def weighted_terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's number, term, weight) of every different term of each text, by text."""
    raw = _LOWER[np.frombuffer(b" ".join(texts), np.uint8)]
    begin = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    first = np.searchsorted(word_bounds(raw)[0], begin)
    terms, text = word_tokens(raw), np.repeat(np.arange(len(texts)), np.diff(first))
    order = np.lexsort((terms, text))
    terms, text = terms[order], text[order]
    new = np.flatnonzero(np.concatenate(([True], (terms[1:] != terms[:-1]) | (text[1:] != text[:-1])))[: len(terms)])
    return text[new], terms[new], np.diff(np.append(new, len(terms)))


def signatures(texts: list[bytes], samples: int = SAMPLES) -> np.ndarray:
    """The fingerprints of texts in UTF-8, one row of 16-bit samples each."""
    text, terms, weights = weighted_terms(texts)
    best = np.full((len(texts), samples), EMPTY)
    _, first, pair = np.unique(mix(terms + mix(weights.astype(np.uint64), 3)), return_index=True, return_inverse=True)
    for lo in range(0, len(first), PAIRS):
        own = first[lo : lo + PAIRS]
        values = draws(terms[own], weights[own], samples)
        here = np.flatnonzero((pair >= lo) & (pair < lo + PAIRS)) if len(first) > PAIRS else np.arange(len(pair))
        ends = np.searchsorted(text[here], np.arange(len(texts) + 1))
        for k in np.flatnonzero(np.diff(ends)):
            for a in range(ends[k], ends[k + 1], 4096):
                rows = pair[here[a : min(a + 4096, ends[k + 1])]] - lo
                np.minimum(best[k], values[rows].min(0), out=best[k])
    return (best & np.uint64(0xFFFF)).astype(np.uint16)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(doc, fingerprint): every row's id and its fingerprint in hex digits, four for each sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            raw, off = utf8(part.column("text"))
            found = signatures([raw[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)], samples)
            yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array([s.astype(">u2").tobytes().hex() for s in found])], names=["doc", "fingerprint"])

    return docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text")).mapInArrow(tidy(run), f"doc {docs.schema[id_col].dataType.simpleString()}, fingerprint string")


def likeness(a: str | Column, b: str | Column, samples: int = SAMPLES) -> Column:
    """The share of samples that two fingerprints have in common: an estimate of their documents' similarity."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    same = F.filter(F.sequence(F.lit(0), F.lit(samples - 1)), lambda k: F.substr(a, k * 4 + 1, F.lit(4)) == F.substr(b, k * 4 + 1, F.lit(4)))
    return F.size(same) / F.lit(float(samples))


def edited(text: str, following: str) -> str:
    """text, its last third replaced by the beginning of another."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


_COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_NAMES = [c.split()[0] for c in _COLUMNS.split(", ")]


def _compared(ids: list, texts: list[str], changed: list[bytes], own: np.ndarray, other: np.ndarray, after: np.ndarray) -> list[pa.Array]:
    binary = lambda rows: pa.array([r.astype(">u2").tobytes() for r in rows], pa.binary())
    return [
        pa.array(ids, pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t).hexdigest() for t in changed]),
        binary(own),
        binary(other),
        pa.array((own == other).mean(1)),
        pa.array((own == after).mean(1)),
    ]


def _along(samples: int):
    """Rows (doc, text) in order: all but the last compared with the next, then the first and the last as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, names = TaskContext.get().partitionId(), ["part", *_NAMES, "first_text", "last_text"]
        held, begun = None, None
        for part in slices(batches, "text", SLICE // 2):
            ids, texts = part.column("doc").to_pylist(), [t or "" for t in part.column("text").to_pylist()]
            begun = begun or (ids[0], texts[0])
            new = [t.encode() for t in texts]
            if held is not None:
                ids, texts = [held[0], *ids], [held[1], *texts]
            changed = [edited(a, b).encode() for a, b in zip(texts[:-1], texts[1:], strict=True)]
            found = signatures(new + changed, samples)  # together, as they share most of their draws
            found, other = found[: len(new)], found[len(new) :]
            if held is not None:
                found = np.vstack((held[2], found))
            if changed:
                columns = _compared(ids[:-1], texts[:-1], changed, found[:-1], other, found[1:])
                none = pa.nulls(len(ids) - 1, pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([number] * (len(ids) - 1), pa.int32()), *columns, none, none], names=names)
            held = ids[-1], texts[-1], found[-1:]
        if held is not None:
            empty = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([held[0]], pa.int64()), *empty, pa.array([begun[1]]), pa.array([held[1]])], names=names)

    return run


def _pairs(samples: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                doc, text, following = (batch.column(c)[k].as_py() for c in ("doc_id", "last_text", "next_text"))
                changed = edited(text, following).encode()
                found = signatures([text.encode(), changed, following.encode()], samples)
                yield pa.RecordBatch.from_arrays(_compared([doc], [text], [changed], *found[:, None]), names=_NAMES)

    return run


def compared_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """_COLUMNS of every document, the next being that of the next smaller id, and of the smallest the largest."""
    spark, text = docs.sparkSession, F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.xxhash64(text).alias("row"), text.alias("text"), F.monotonically_increasing_id().alias("place"))
    order = [F.desc_nulls_last("doc"), F.asc("row"), F.asc("place")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc", "text")
    found = written(ranged.mapInArrow(tidy(_along(samples)), f"part int, {_COLUMNS}, first_text string, last_text string"), "fingerprinted")
    ends = found.where(F.col("last_text").isNotNull()).select("part", "doc_id", "first_text", "last_text")
    parts = sorted(r["part"] for r in ends.select("part").collect())  # as many as the sort has ranges
    inside = found.where(F.col("last_text").isNull()).select(*_NAMES)
    if not parts:
        return inside
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next int")
    heads = ends.select(F.col("part").alias("next"), F.col("first_text").alias("next_text"))
    across = ends.join(after, "part").join(heads, "next").select("doc_id", "last_text", "next_text")
    return inside.unionByName(across.mapInArrow(_pairs(samples), _COLUMNS))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compared_with_next(load(spark, sf_dir, "documents"))
    return found.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
