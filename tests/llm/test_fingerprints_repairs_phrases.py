"""Operators 11 to 13 against brute force and SQL, and their defined cases."""

import hashlib
import itertools
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.llm import op11_fingerprints as op11
from marginalia.llm import op12_conversation_repair as op12
from marginalia.llm import op13_collocations as op13

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    df = spark.createDataFrame([(d, t, g, None, None) for d, t, g in rows], DOCS)
    return df.withColumns({c: F.lit("x") for c in ("doc", "row", "place", "part", "phrase", "n", "f", "block", "next")})


def saved(df, tmp_path, name="documents"):
    df.write.parquet(f"file://{tmp_path}/{name}.parquet")
    return f"file://{tmp_path}"


ODD = [
    (None, "words of no id, words of no id", "en"),
    (3, None, None),
    (4, "", "en"),
    (5, " \t\n ", "en"),
    (6, "Ein Satz. Ein Satz, ein satz", "de"),
    (6, "Ein Satz. Ein Satz, ein satz", "de"),
    (6, "another of that id", "de"),
    (7, " ".join(f"w{i * i % 997}" for i in range(60_000)), "en"),
    (8, "日本語 日本語\x0b日本語 é É", "ja"),
    (9, "x" * 9000, "en"),
    (10, "a a a a a a b a a", "en"),
]


# operator 11


def jaccard(a, b):
    a, b = (Counter(re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower())) for t in (a, b))
    most = sum(max(a[k], b[k]) for k in a | b)
    return sum(min(a[k], b[k]) for k in a | b) / most if most else 1.0


def test_fingerprints_agree_as_often_as_their_documents_are_alike():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"t{k}" for k in rng.zipf(1.4, 400) % 300) for _ in range(6)]
    texts += [texts[0] + " " + texts[1], texts[0][:900] + texts[2][900:], texts[0]]
    found = op11.signatures([t.encode() for t in texts], 4096)
    for a, b in itertools.combinations(range(len(texts)), 2):
        assert abs((found[a] == found[b]).mean() - jaccard(texts[a], texts[b])) < 0.04
    assert (found[0] == found[-1]).all()


def test_long_texts_are_fingerprinted_in_blocks_as_in_one(monkeypatch):
    texts = [" ".join(f"w{i % n}" for i in range(9000)).encode() for n in (8000, 50, 7000)]
    whole = op11.signatures(texts)
    monkeypatch.setattr(op11, "PAIRS", 1000)
    assert (op11.signatures(texts) == whole).all()
    assert (op11.signatures(texts[1:2]) == whole[1:2]).all()


def test_op11_over_a_table_with_every_defined_case(spark, tmp_path):
    got = op11.op11_fingerprints(spark, saved(documents(spark, ODD), tmp_path)).collect()
    assert len(got) == len(ODD)
    rows = sorted(((d, t or "") for d, t, _ in ODD if d != 6), key=lambda r: (r[0] is None, -(r[0] or 0)))
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] != 6}
    place = {d: k for k, (d, _) in enumerate(rows)}
    for d, t in rows:
        own = by_id[d]
        assert own["n_chars"] == len(t)
        if d in (7, 5):  # 7 is followed by a row of id 6, 5 by 4
            continue
        following = rows[(place[d] + 1) % len(rows)][1]
        changed = t[: len(t) - len(t) // 3] + following[: len(t) // 3]
        assert own["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert abs(own["near_edited"] - jaccard(t, changed)) < 0.2
        assert abs(own["near_next"] - jaccard(t, following)) < 0.2
    assert {(r["fingerprint"]) for r in got if r["doc_id"] in (3, 4, 5)} == {"ffff" * op11.SAMPLES}
    assert by_id[4]["near_next"] == 1.0


def test_op11_over_many_ranges_equals_one(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    one = {tuple(r) for r in op11.compared_with_next(docs.coalesce(1)).collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        many = {tuple(r) for r in op11.compared_with_next(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert one == many and len(one) == 200


def test_op11_single_and_no_documents(spark):
    one = op11.compared_with_next(documents(spark, [(1, "a b c d", "en")])).collect()[0]
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"a b ca ").hexdigest()
    assert op11.compared_with_next(documents(spark, [])).collect() == []


def test_likeness_of_written_fingerprints(spark):
    docs = documents(spark, [(1, "a b c d e f", "en"), (2, "a b c d e g", "en")])
    prints = {r["doc"]: r["fingerprint"] for r in op11.fingerprints(docs).collect()}
    share = spark.createDataFrame([(prints[1], prints[2])], "a string, b string").select(op11.likeness("a", "b")).first()[0]
    a, b = (np.array([prints[k][i : i + 4] for i in range(0, 512, 4)]) for k in (1, 2))
    assert share == (a == b).mean() and 0.5 < share < 0.95


# operator 12

LEGAL = re.compile("(s?(ua)+)?")


def cheapest(signature):
    """All edits of a signature, with up to two insertions before each row and at the end."""
    best = None
    edits = [["D"] if c == "d" else ["D", "K", "R"] for c in signature]
    for choice in itertools.product(*edits):
        for gaps in itertools.product(("", "I", "II"), repeat=len(signature) + 1):
            cost, audit, free = 0, "", []
            for c, e, g in zip(signature, choice, gaps, strict=False):
                audit += g + e
                free += ["I"] * len(g)
                if e != "D":
                    free.append(c.lower() if e == "K" else "R")
                cost += 5 * len(g) + {"D": 2, "K": 0, "R": 1}[e] + (5 if e != "D" and c.isupper() else 0)
            audit += gaps[-1]
            free += ["I"] * len(gaps[-1])
            cost += 5 * len(gaps[-1])
            if best and (cost, audit) >= best:
                continue
            led = bool(free) and free[0] == "s"
            wanted = ("s" if led else "") + "ua" * (len(free[led:]) // 2)
            if len(wanted) == len(free) and LEGAL.fullmatch(wanted) and (not led or len(free) > 1) and all(f in ("I", "R") or f == w for f, w in zip(free, wanted, strict=True)):
                best = cost, audit
    return best


@pytest.mark.parametrize("n", [1, 2, 3])
def test_answers_are_the_cheapest_edits_of_every_short_signature(n):
    for signature in map("".join, itertools.product("dsuaoUA", repeat=n)):
        path = [op12.ROOT]
        for letter in signature:
            path.append(op12.next_layer(path[-1], letter))
        assert op12.answer(path) == cheapest(signature), signature


def test_answers_share_prefixes_and_come_in_any_range(spark):
    rng = np.random.default_rng(3)
    wanted = {"".join(rng.choice(list("dsuaoSUAO"), n)) for n in rng.integers(1, 40, 300)}
    found = op12.answers(spark.createDataFrame([(s,) for s in wanted], "signature string")).collect()
    assert len(found) == len(wanted)
    for r in found:
        path = [op12.ROOT]
        for letter in r["signature"]:
            path.append(op12.next_layer(path[-1], letter))
        assert op12.answer(path) == (r["cost"], r["audit"])


CHATS = [
    *[(1, t, "user" if t % 2 == 0 else "assistant", f"Text {t}.") for t in range(30)],
    *[(2, t, ["system", "user", "assistant", "tool"][t % 4], ["Same.", "open", "Well?", None][t % 4]) for t in range(25)],
    *[(3, None, r, x) for r, x in [("user", "a."), (None, "b"), ("", "c!"), ("assistant", "d. \n")]],
    *[(3, t, "system", " \t ") for t in (5, 9, 9)],
    *[(None, t, "assistant", "first?") for t in (-4, 0, 0, 0, 7)],
    *[(4, 1, "user", "tie " + x) for x in "cab"],
    *[(c, 0, "user", "alone") for c in range(100, 160)],
    *[(5, 2, "user", "again and again.") for _ in range(50)],
]


def test_op12_equals_its_sql_on_every_defined_case(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op12, "COPIES", 7)
    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string")
    df = df.withColumns({c: F.lit("x") for c in ("conv", "copies", "fault", "audit", "signature", "_fate", "first")})
    got = op12.op12_conversation_repair(spark, saved(df, tmp_path, "conversations"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    wanted = con.execute(op12.ORACLE)
    names = [d[0] for d in wanted.description]
    assert names == got.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(wanted.fetchall(), key=repr)


def test_mended_rows_are_sound_conversations(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own, mended = op12.repaired(op12.damaged(rows))
    chats = {}
    for r in mended.collect():
        chats.setdefault(r["conv"], []).append(r)
    assert chats and all(LEGAL.fullmatch("".join(r["role"][0] for r in c)) for c in chats.values())
    edits = {r["conv"]: r["audit"] for r in own.collect()}
    for conv, c in chats.items():
        assert "".join(r["edit"] for r in c) == edits[conv].replace("D", "")


def test_op12_of_an_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert op12.op12_conversation_repair(spark, saved(df, tmp_path, "conversations")).collect() == []


# operator 13


def brute_collocations(rows, least, longest, share):
    counts, totals = Counter(), Counter()
    for _, text, lang in rows:
        lang, text = lang or "und", "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    found = {}
    for (lang, p), a in counts.items():
        if len(p) > 1 and a >= least:
            score, _, left, right = min((1000 * a * totals[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
            found[lang, p] = a, left, right, totals[lang], score
    inside = {k for k, v in found.items() for b, w in found.items() if b[0] == k[0] and len(b[1]) > len(k[1]) and 100 * w[0] >= share * v[0] and f" {' '.join(k[1])} " in f" {' '.join(b[1])} "}
    return {(g, " ".join(p), *v) for (g, p), v in found.items() if (g, p) not in inside}


@pytest.mark.parametrize(("least", "share"), [(2, 100), (2, 60), (300, 100)])
def test_collocations_equal_brute_force(spark, least, share):
    rng = np.random.default_rng(11)
    rows = ODD + [(100 + k, " ".join(rng.choice(["ab", "ba", "a", "cd,", "E", "e.", "\t", "b\xa0c", "d"], 60)), rng.choice(["en", "de"])) for k in range(12)]
    got = op13.collocations(documents(spark, rows), least=least, share=share, bits=16, block_bytes=3000)
    assert {tuple(r) for r in got.select("lang", "phrase", "a", "l", "r", "n", "score").collect()} == brute_collocations(rows, least, 5, share)


def test_a_crowded_sketch_costs_no_results(spark):
    rows = [(k, f"a b c{k % 3} d", "en") for k in range(30)]
    got = op13.collocations(documents(spark, rows), least=5, bits=4)
    assert {tuple(r) for r in got.select("lang", "phrase", "a", "l", "r", "n", "score").collect()} == brute_collocations(rows, 5, 5, 100)


@pytest.mark.parametrize("gigabytes", [0.1, 1, 6, 100])
def test_counters_follow_the_corpus(gigabytes):
    size = int(gigabytes * (1 << 30))
    assert 5 * size / 6 / 2 ** op13.bits_for(size) < op13.LEAST / 20
    assert 2 ** op13.stretch_bits(op13.bits_for(size)) <= 1 << 24


@pytest.mark.parametrize("bits", [4, 12, 20, 36])
def test_counters_that_reach_least_are_those_of_a_count(spark, bits):
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(rng.choice(["ab", "ba", "c", "dd", f"x{k}"], 40)), "en") for k in range(20)]
    frame = documents(spark, rows).select("lang", "text")
    found = {(r["stretch"] << op13.stretch_bits(bits)) + int(x) for r in op13.heavy_cells(frame, 7, 3, bits).collect() for x in op13.unpacked(r["heavy"], r["size"])}
    part = pa.RecordBatch.from_pydict({"text": [t for _, t, _ in rows]})
    every = np.concatenate([op13.cells(h, bits) for _, h in op13.Phrases(part).hashes(["en"] * len(rows), 3)])
    numbers, times = np.unique(every, return_counts=True)
    assert found == set(numbers[times >= 7].tolist())
    assert op13.Heavy(numbers[times >= 7]).has(numbers).tolist() == (times >= 7).tolist()


def test_collocations_of_nothing(spark):
    assert op13.collocations(documents(spark, []), least=2).collect() == []
    assert op13.collocations(documents(spark, [(1, None, None), (2, " . ", "en")]), least=2).collect() == []


def test_scores_beyond_64_bits_are_exact(spark):
    counts = spark.createDataFrame([("en", "p q", 10**10 + 7), ("en", "p", 10**10 + 9), ("en", "q", 2 * 10**10 + 1)], "lang string, phrase string, f long")
    totals = spark.createDataFrame([("en", 3 * 10**11 + 1)], "lang string, n long")
    got = op13.scored(counts, totals).first()
    assert got["score"] == 1000 * (10**10 + 7) * (3 * 10**11 + 1) // ((10**10 + 9) * (2 * 10**10 + 1))


def test_op13_equals_its_sql(spark, tiny):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tiny}/documents.parquet'")
    assert sorted(map(tuple, op13.op13_collocations(spark, tiny).collect())) == sorted(con.execute(op13.ORACLE).fetchall())
