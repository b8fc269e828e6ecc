"""Operator 12: find the faults of conversations and mend them at the least cost, by dynamic programming along a trie.

A conversation is sound if its roles are nothing, or an optional system turn and then pairs of user and assistant. Rows
are kept at no cost, given another role (1), deleted (2), or user and assistant turns of no text are inserted (5 each).
Blank rows, and those whose role and text stood earlier, must go; a truncated row that stays costs 5. The cheapest edits,
written as initials in their order, are the conversation's audit; of equally cheap ones the least string is taken.

What edits cost follows from a row's role and fault alone. A conversation is thus a string of symbols, its signature.
Distinct signatures are sorted over the cluster; a task walks the prefix trie of its range depth first, which in sorted
order is a stack of layers: the layers of the prefix shared with the signature before stay, those behind it are computed
once, and the answer is read at the signature's end. A layer holds for each of four states (nothing yet, a system turn,
a user turn, an assistant turn last) its cost, where it comes from, and its rank: which of the strings that lead to the
states is smaller. Insertions are counted to the row behind them, so that no row's initials begin another's, and strings
of as many rows are compared by the rank of what they go on from, then by their last row.

Equal rows are counted before they are shuffled, and the first of a role and text is found by an aggregate and a join,
so that copies are nobody's group. Rows then stream through tasks sorted by conversation, twice: for signatures and for
repaired rows, where an audit precedes its rows. One conversation's rows go to one task, which holds none of them but
its signature or audit, a character for each row: its digest is of one sequence.

Defined cases: rows of one turn are sorted by role and text, null turns come first; a null role or text is one space; a
null conversation is one, with a null id; a role is known by its first character, any but s, u and a must change; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import load, tidy, written

RETYPE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLANKS = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
ROLES = {"u": "user", "a": "assistant"}
#: Which turn may follow: of each state ("" nothing yet, else the last initial) the initials that go on from it.
FOLLOWS = {"": "su", "s": "u", "u": "a", "a": "u"}
LEGAL = [a + b for a, after in FOLLOWS.items() if a for b in after]
#: Copies of a row that are dealt out at once.
COPIES = 10_000


def _same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    first, *rest = (a[n].eqNullSafe(b[n]) for n in names)
    for r in rest:
        first = first & r
    return first


def faulty(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, copy, fault) of rows (conv, turn, role, text, copies).

    fault: blank, duplicate, truncated or null, the first that holds. copies: how many of the row there are.
    """
    space = F.lit(" ")
    rows = rows.select("conv", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), "copies")
    own = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies")).where(F.col("copies") > 0)
    seen = own.groupBy("conv", "role", "text").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"))
    both = own.join(seen, _same(own, seen, "conv", "role", "text")).select(own["*"], F.col("turn").eqNullSafe(F.col("first.turn")).alias("is_first"))
    dealt = both.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))))
    dealt = dealt.withColumn("copy", F.explode(F.sequence(F.col("block") * COPIES, F.least(F.col("copies"), (F.col("block") + 1) * COPIES) - 1)))
    ended = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(ended == "", "blank").when(~F.col("is_first") | (F.col("copy") > 0), "duplicate").when(~F.right(ended, F.lit(1)).isin(*ENDS), "truncated")
    return dealt.select("conv", "turn", "role", "text", "copy", fault.alias("fault"))


def symbol() -> Column:
    """A row's letter in its conversation's signature: d must go, others are a role's initial, a capital if truncated."""
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)


def in_order(rows: DataFrame) -> DataFrame:
    order = [F.asc(c) for c in ("conv", "turn", "role", "text", "copy") if c in rows.columns]
    return rows.repartition("conv").sortWithinPartitions(*order)


def signatures(rows: DataFrame) -> DataFrame:
    """(conv, signature, illegal) of faulty() rows; illegal: neighbours whose roles may not follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, last, illegal, begun = None, [], "", 0, False
        for batch in batches:
            done = []
            for conv, letter, initial in zip(*(batch.column(c).to_pylist() for c in ("conv", "letter", "initial")), strict=True):
                if not begun or conv != now:
                    if begun:
                        done.append((now, "".join(parts), illegal))
                    now, parts, illegal, begun = conv, [], 0, True
                elif last + initial not in LEGAL:
                    illegal += 1
                parts.append(letter)
                last = initial
            if done:
                yield _table(done, batch.schema.field("conv").type)
            kind = batch.schema.field("conv").type
        if begun:
            yield _table([(now, "".join(parts), illegal)], kind)

    def _table(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        conv, signature, illegal = zip(*done, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(conv, kind), pa.array(signature), pa.array(illegal, pa.int64())], names=["conv", "signature", "illegal"])

    streamed = in_order(rows).select("conv", symbol().alias("letter"), F.substring("role", 1, 1).alias("initial"))
    return streamed.mapInArrow(tidy(run), f"conv {rows.schema['conv'].dataType.simpleString()}, signature string, illegal long")


#: A layer: of each reachable state (cost, rank, state before, initials since).
Layer = dict[str, tuple[int, int, str, str]]
ROOT: Layer = {"": (0, 0, "", "")}


def inserted(state: str) -> Iterator[tuple[str, str, int]]:
    """(state, initials, cost) after up to two insertions; more lead back to where two began."""
    yield state, "", 0
    initials, cost = "", 0
    for _ in range(2):
        state = FOLLOWS[state][-1]
        initials, cost = initials + "I", cost + INSERT
        yield state, initials, cost


def next_layer(layer: Layer, letter: str) -> Layer:
    """The states after one more row."""
    best: dict[str, tuple] = {}
    kept = TRUNCATED if letter.isupper() else 0
    for before, (cost, rank, _, _) in layer.items():
        for state, initials, more in inserted(before):
            ways = [(state, "D", DELETE)]
            if letter != "d":
                if letter.lower() in FOLLOWS[state]:
                    ways.append((letter.lower(), "K", kept))
                ways.append((FOLLOWS[state][-1], "R", RETYPE + kept))
            for after, edit, price in ways:
                way = cost + more + price, rank, initials + edit, before
                if after not in best or way < best[after]:
                    best[after] = way
    ranks = {s: k for k, s in enumerate(sorted(best, key=lambda s: best[s][1:3]))}
    return {s: (cost, ranks[s], before, edits) for s, (cost, _, edits, before) in best.items()}


def answer(layers: list[Layer]) -> tuple[int, str]:
    """(cost, audit) at the end of a signature whose prefixes have these layers."""
    ends = [(cost + more, rank, initials, before) for before, (cost, rank, _, _) in layers[-1].items() for state, initials, more in inserted(before) if state == "a" or not state]
    cost, _, edits, state = min(ends)
    audit = [edits]
    for layer in reversed(layers[1:]):
        _, _, state, edits = layer[state]
        audit.append(edits)
    return cost, "".join(reversed(audit))


def answers(distinct: DataFrame) -> DataFrame:
    """(signature, cost, audit) of distinct signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, before = [ROOT], ""
        for batch in batches:
            costs, audits = [], []
            for signature in batch.column("signature").to_pylist():
                del path[len(commonprefix((before, signature))) + 1 :]
                for letter in signature[len(path) - 1 :]:
                    path.append(next_layer(path[-1], letter))
                cost, audit = answer(path)
                costs.append(cost)
                audits.append(audit)
                before = signature
            yield pa.RecordBatch.from_arrays([batch.column("signature"), pa.array(costs, pa.int64()), pa.array(audits, pa.string())], names=["signature", "cost", "audit"])

    return distinct.repartitionByRange("signature").sortWithinPartitions("signature").mapInArrow(tidy(run), "signature string, cost long, audit string")


def mended(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv, edit, turn, role, text), in order within partitions: faulty() rows as their conversations' audits (conv,
    audit) have them; edit: K, R or I."""
    kind = {c: rows.schema[c].dataType.simpleString() for c in ("conv", "turn")}
    none = F.lit(None)
    first = audits.select("conv", none.cast(kind["turn"]).alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("text"), F.lit(-1).cast("long").alias("copy"), "audit")
    both = first.unionByName(rows.select("conv", "turn", "role", "text", "copy", none.cast("string").alias("audit")))
    # null turns come first, and among them the audit, whose role is null
    streamed = in_order(both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edits: Iterator[str] = iter(())
        state, now, schema = "", None, None

        def insert(out: list[tuple], initials: str) -> None:
            nonlocal state
            for _ in initials:
                state = FOLLOWS[state][-1]
                out.append((now, "I", None, ROLES[state], ""))

        for batch in batches:
            out: list[tuple] = []
            schema = [batch.schema.field(c).type for c in ("conv", "turn")]
            for conv, turn, role, text, audit in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "audit")), strict=True):
                if audit is not None:
                    insert(out, next(edits, ""))  # at the end of the conversation before
                    edits, state, now = (m[0] for m in re.finditer("I*[DKR]|I+$", audit)), "", conv
                    continue
                step = next(edits)
                insert(out, step[:-1])
                if step[-1] == "K":
                    state = role[0]
                elif step[-1] == "R":
                    state = FOLLOWS[state][-1]
                    role = ROLES[state]
                if step[-1] != "D":
                    out.append((conv, step[-1], turn, role, text))
            if out:
                yield _rows(out, schema)
        out = []
        insert(out, next(edits, ""))
        if out:
            yield _rows(out, schema)

    def _rows(out: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
        types = [kinds[0], pa.string(), kinds[1], pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["conv", "edit", "turn", "role", "text"])

    return streamed.mapInArrow(tidy(run), f"conv {kind['conv']}, edit string, turn {kind['turn']}, role string, text string")


def digests(rows: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of mended() rows, as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, kind = None, None, None
        for batch in batches:
            kind, done = batch.schema.field("conv").type, []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text")), strict=True):
                if digest is None or conv != now:
                    if digest is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = conv, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done])], names=["conv", "repaired_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([digest.hexdigest()])], names=["conv", "repaired_sha256"])

    return rows.mapInArrow(tidy(run), f"conv {rows.schema['conv'].dataType.simpleString()}, repaired_sha256 string")


def repaired(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (conv, turn, role, text, copies): ((conv, gaps, blank, duplicate, truncated, illegal, cost, audit), mended rows)."""
    found = written(faulty(rows), "faulty")
    counts = [F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")]
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    stats = found.groupBy("conv").agg(gaps.alias("gaps"), *counts)
    signed = written(signatures(found), "signatures")
    solved = signed.join(answers(signed.select("signature").distinct()), "signature").select("conv", "illegal", "cost", "audit")
    solved = written(solved, "audits")
    own = stats.join(solved, _same(stats, solved, "conv")).select(stats["*"], "illegal", "cost", "audit")
    return own, mended(found, solved.select("conv", "audit"))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, copies) of conversations, damaged by the checksum of each row's conversation and turn."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.withColumn("_fate", F.crc32(name.cast("binary")) % 20)
    fate, role, text = F.col("_fate"), F.coalesce("role", space), F.coalesce("text", space)
    return rows.select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.when(fate == 4, "user").otherwise(role).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    every = rows.select(F.col("conv_id").cast("long").alias("conv")).distinct()
    own, mended_rows = repaired(damaged(rows))
    digest = digests(mended_rows)
    whole = every.join(own, _same(every, own, "conv"), "left").select(every["conv"], *[c for c in own.columns if c != "conv"])
    whole = whole.join(digest, _same(whole, digest, "conv"), "left").select(whole["*"], "repaired_sha256")
    zeros = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return whole.withColumns(zeros | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest()))}).withColumnRenamed("conv", "conv_id")


ORACLE = r"""
WITH RECURSIVE crc_table AS MATERIALIZED (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
), fated AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 20 AS fate
  FROM conversations, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM fated
), numbered AS (
  SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
    left(role, 1) AS initial, left(lag(role) OVER w, 1) AS before, right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) AS ended
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
), faulty AS MATERIALIZED (
  SELECT *, CASE WHEN ended = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN ended NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM numbered
), inserts(p, q, said, price) AS (
  VALUES ('', '', '', 0), ('s', 's', '', 0), ('u', 'u', '', 0), ('a', 'a', '', 0), ('', 'u', 'I', 5), ('s', 'u', 'I', 5), ('a', 'u', 'I', 5), ('u', 'a', 'I', 5), ('', 'a', 'II', 10), ('s', 'a', 'II', 10)
), edits(e) AS (VALUES ('D'), ('K'), ('R')),
best AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, '' AS state, {'cost': 0, 'audit': ''} AS way FROM faulty
  UNION ALL
  SELECT conv_id, i, state, min(way) AS way FROM (
    SELECT f.conv_id, f.i, {'cost': b.way.cost + n.price + CASE e WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN e <> 'D' AND fault IS NOT NULL THEN 5 ELSE 0 END, 'audit': b.way.audit || said || e} AS way,
      CASE e WHEN 'D' THEN n.q WHEN 'K' THEN initial ELSE CASE n.q WHEN 'u' THEN 'a' ELSE 'u' END END AS state
    FROM best b JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i + 1 JOIN inserts n ON n.p = b.state CROSS JOIN edits
    WHERE e = 'D' OR (fault IS NULL OR fault = 'truncated') AND (e = 'R' OR n.q || initial IN ('s', 'u', 'su', 'ua', 'au'))
  ) GROUP BY ALL
), ended AS (
  SELECT b.conv_id, min({'cost': b.way.cost + price, 'audit': b.way.audit || said}) AS way
  FROM best b JOIN inserts n ON n.p = b.state AND n.q IN ('', 'a') JOIN (SELECT conv_id, max(i) AS i FROM faulty GROUP BY conv_id) m ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.i = b.i
  GROUP BY b.conv_id
), steps AS (
  SELECT conv_id, way.audit AS audit, unnest(range(1, length(way.audit) + 1)) AS k FROM ended
), placed AS (
  SELECT conv_id, k, audit[k] AS e, length(replace(audit[1 : k], 'I', '')) AS i,
    length(replace(audit[1 : k], 'D', '')) AS n FROM steps
), out_rows AS (
  SELECT p.conv_id, k, e, n, f.role, f.text,
    max(CASE WHEN e = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS led
  FROM placed p LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i AND e <> 'I' WHERE e <> 'D'
), digests AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (n - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY k)) AS digest
  FROM out_rows GROUP BY conv_id
), stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(e.way.cost, 0)::BIGINT AS cost, coalesce(e.way.audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN digests d ON d.conv_id IS NOT DISTINCT FROM c.conv_id
"""
