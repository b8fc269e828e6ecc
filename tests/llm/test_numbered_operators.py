"""The numbered operators against brute force, and their defined cases."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """Rows (doc_id, text) as a documents table with columns whose names clash with those that operators use inside."""
    df = spark.createDataFrame([(d, t, "en", None, None) for d, t in rows], DOCS)
    return df.withColumns({c: F.lit("x") for c in ("doc", "key", "spans", "start", "print", "component", "language", "code", "at", "block")})


def saved(df, tmp_path, name="documents"):
    df.write.parquet(f"file://{tmp_path}/{name}.parquet")
    return f"file://{tmp_path}"


LONG = " ".join(f"w{i * i % 9973}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(40))
ODD_ROWS = [
    (None, PASSAGE + " tail of the null"),
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, LONG),
    (5, "start " + PASSAGE + " é end"),
    (6, "other " + PASSAGE + " ü last"),
    (6, "other " + PASSAGE + " ü last"),
    (7, "ab " * 400),
    (8, "x" * 700),
    (9, LONG[500:9000]),
    (10, "ÀÉ日本語 " * 60),
    (11, "one two"),
    (12, "one two"),
]


def repeats(rows, width, tokens):
    """For each distinct id the tokens of its text and which go; a null id is the first."""
    by_id = {}
    for d, t in rows:
        by_id.setdefault(d, tokens((t or "").encode()))
    seen, out = set(), {}
    for d in sorted(by_id, key=lambda d: (d is not None, d or 0)):
        toks = by_id[d]
        gone = np.zeros(len(toks), bool)
        for i in range(len(toks) - width + 1):
            w = tuple(toks[i : i + width])
            if w in seen:
                gone[i : i + width] = True
            seen.add(w)
        out[d] = toks, gone
    return out


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, ODD_ROWS)


def test_op8_matches_brute_force(spark, tmp_path, odd):
    from marginalia.llm.op8_suffix_dedup import op8_suffix_dedup

    got = op8_suffix_dedup(spark, saved(odd, tmp_path)).collect()
    assert len(got) == len(ODD_ROWS)
    want = repeats(ODD_ROWS, 100, list)
    for r in got:
        toks, gone = want[r.doc_id]
        kept = bytes(b for b, g in zip(toks, gone, strict=True) if not g)
        runs = int(np.sum(gone[1:] & ~gone[:-1]) + gone[:1].sum())
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(toks), gone.sum(), runs, hashlib.sha256(kept).hexdigest())


def test_op10_matches_brute_force(spark, tmp_path, odd):
    from marginalia.llm.op10_substring_dedup import op10_substring_dedup

    got = op10_substring_dedup(spark, saved(odd, tmp_path)).collect()
    assert len(got) == len(ODD_ROWS)
    want = repeats(ODD_ROWS, 20, bytes.split)
    for r in got:
        toks, gone = want[r.doc_id]
        kept = b" ".join(w for w, g in zip(toks, gone, strict=True) if not g)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(toks), gone.sum(), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("name", ["op8", "op10"])
@pytest.mark.parametrize("limit", [1, 1 << 9])
def test_crowded_keys_are_dealt_by_longer_strings_and_shards_are_cut_at_keys(spark, odd, monkeypatch, name, limit):
    from functools import partial

    from marginalia.llm import repeats as shared
    from marginalia.llm.op8_suffix_dedup import repeated_strings
    from marginalia.llm.op10_substring_dedup import repeated_words

    find = repeated_strings if name == "op8" else repeated_words
    covered = lambda df: sorted((r.doc, t) for r in df.collect() for s in r.spans for t in range(s.start, s.end))
    plain = set(covered(find(odd)))
    monkeypatch.setattr(shared, "CROWDED", 0 if limit == 1 else 1)
    monkeypatch.setattr(shared, "VERY", 1 if limit == 1 else 1000)
    monkeypatch.setattr(shared, "compared", partial(shared.compared, limit=limit))
    assert set(covered(find(odd))) == plain


def test_op8_and_op10_match_brute_force_on_random_repeats(spark, tmp_path):
    """Few words, so that repeats overlap, are periodic and stand at every distance; ids repeat with other texts."""
    from marginalia.llm.op8_suffix_dedup import op8_suffix_dedup
    from marginalia.llm.op10_substring_dedup import op10_substring_dedup

    rng = np.random.default_rng(8)
    words = ["a", "bb", "c\u00e9c", "dddd"]
    stock = [" ".join(rng.choice(words, int(rng.integers(5, 90)))) for _ in range(12)]
    rows = [(int(k), "  ".join(stock[int(i)] for i in rng.integers(0, 12, int(rng.integers(1, 6))))) for k in range(60)]
    path = saved(documents(spark, rows), tmp_path)
    for query, width, tokens, digest in ((op8_suffix_dedup, 100, list, bytes), (op10_substring_dedup, 20, bytes.split, b" ".join)):
        want = repeats(rows, width, tokens)
        for r in query(spark, path).collect():
            toks, gone = want[r.doc_id]
            kept = digest([w for w, g in zip(toks, gone, strict=True) if not g])
            assert (r.n_removed, r.kept_sha256) == (gone.sum(), hashlib.sha256(kept).hexdigest())


def test_suffix_array_and_common_prefixes():
    from marginalia.llm.suffix_array import common_prefixes, suffix_array

    rng = np.random.default_rng(3)
    texts = [np.append(rng.integers(1, letters, n), 0).astype(np.uint8) for n, letters in [(1, 2), (9, 2), (60, 3), (300, 2), (900, 30), (9000, 30)]]
    texts += [np.array([1] * 700 + [2] + [1] * 700 + [2, 0], np.uint8), np.array([1, 2] * 500 + [0], np.uint8)]
    for text in texts:
        letters = int(text.max()) + 1
        sa, raw = suffix_array(text, letters), text.tobytes()
        assert list(sa) == sorted(range(len(raw)), key=lambda i: raw[i:])
        plcp = common_prefixes(text, sa)
        for a, b in zip(sa[:-1], sa[1:], strict=True):
            k = 0
            while raw[a + k : a + k + 1] == raw[b + k : b + k + 1] != b"":
                k += 1
            assert plcp[b] == k


def test_dedup_texts_keeps_columns_and_characters(spark, odd):
    from marginalia.llm.op8_suffix_dedup import dedup_texts

    out = dedup_texts(odd)
    assert out.columns == odd.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[1] is None and texts[2] == "" and texts[11] == "one two" and LONG.startswith(texts[4][:50_000])
    assert texts[9] == "" and "shared20" not in texts[6] and "�" not in "".join(t or "" for t in texts.values())


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op4_matches_brute_force(spark, tmp_path, odd):
    from marginalia.llm.op4_simhash_dedup import op4_simhash_dedup

    rows = ODD_ROWS + [(100 + k, LONG + f" tail{k}") for k in range(12)]
    got = op4_simhash_dedup(spark, saved(documents(spark, rows), tmp_path)).collect()
    prints = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
    least = {r: min((d for d in ds if d is not None), default=None) for r, ds in groups.items()}
    want = sorted(((d, f"{p:016x}", least[find(i)]) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True))), key=repr)
    assert sorted(map(tuple, got), key=repr) == want


def test_golay_keys_meet_and_links_lose_nothing(spark):
    from marginalia.llm import golay
    from marginalia.llm.op4_simhash_dedup import links

    rng = np.random.default_rng(5)
    words = rng.integers(0, 1 << 23, 500)
    codes, number = golay.within_four(words)
    assert set(number) == {1, 6}
    for bit in range(23):
        other = golay.nearest(words ^ (1 << bit))
        assert all(o in c[:n] for o, c, n in zip(other, codes, number, strict=True))
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 300, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, int(rng.integers(1, 6)), replace=False)) for b in base]
    prints = np.unique(np.concatenate((base, np.array(near, np.uint64))))
    got = {(r.a, r.b) for r in links(spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "print long")).collect()}
    signed = prints.view(np.int64)
    want = {(min(int(a), int(b)), max(int(a), int(b))) for i, a in enumerate(signed) for b in signed[:i] if (int(a) ^ int(b)) & (2**64 - 1) and ((int(a) ^ int(b)) & (2**64 - 1)).bit_count() <= 3}
    assert got == want and want


def test_first_of_groups(spark, odd):
    from marginalia.llm.op4_simhash_dedup import first_of_groups

    out = first_of_groups(odd)
    assert out.columns == odd.columns
    prints = [fingerprint(t) for _, t in ODD_ROWS]
    near = lambda i: {j for j in range(len(prints)) if (prints[i] ^ prints[j]).bit_count() <= 3}
    want = []
    for i, (d, _) in enumerate(ODD_ROWS):
        group = near(i)
        assert all(near(j) == group for j in group)  # no chains here
        first = min(group, key=lambda j: (ODD_ROWS[j][0] is None, ODD_ROWS[j][0] or 0, j))
        if i == first:
            want.append(d)
    assert sorted((r.doc_id for r in out.collect()), key=repr) == sorted(want, key=repr)


def test_first_of_groups_by_row_with_shared_ids(spark):
    from marginalia.llm.op4_simhash_dedup import first_of_groups

    a, b, c, d, e = (" ".join(f"{x}{i * i}" for i in range(80)) for x in "abcde")
    rows = [(5, a), (5, b), (6, a), (7, b), (9, c), (None, d), (None, e), (None, d), (8, e), (5, a)]
    df = documents(spark, rows).withColumns({n: F.lit("x") for n in ("_stays", "_place", "_doc", "_row", "root", "row")})
    out = first_of_groups(df)
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted([(5, a), (5, b), (9, c), (None, d), (8, e)], key=repr)


def test_components_of_a_chain_and_a_star(spark):
    from marginalia.llm.components import smallest_reachable

    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 40)] + [(-5, -9)]
    got = dict(smallest_reachable(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 100 for i in range(101, 161)) and all(got[i] == 7 for i in range(8, 40)) and got[-5] == -9
    assert smallest_reachable(spark.createDataFrame([], "a long, b long")).count() == 0


def test_op9_round_trip_and_padding(spark, tmp_path, odd):
    from tokenizers import Tokenizer

    from marginalia.llm.op9_packing import cuts, op9_packing, packed, word_bpe

    rows = [(i, t) for i, (_, t) in enumerate(ODD_ROWS)] + [(99, "<|endoftext|> It's 12 <|x|>\x85y")]
    path = saved(documents(spark, rows), tmp_path)
    got = op9_packing(spark, path).collect()
    tokenizer = Tokenizer.from_file(word_bpe())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for d, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert all(sum(cuts(n, 2048)) == n and all(c > 0 for c in cuts(n, 2048)) for n in range(1, 6000))
    ids = {(r.doc_id, r.start): r.ids for r in packed(spark.read.parquet(f"{path}/documents.parquet"), word_bpe).collect()}
    assert all(zlib.crc32(np.array(ids[r.doc_id, r.start], "<u4").tobytes()) == r.ids_crc32 for r in got)


def test_op6_learns_languages_and_defined_cases(spark, tiny, tmp_path):
    from marginalia.llm.op6_language_id import op6_language_id, trained, with_language

    got = op6_language_id(spark, tiny).collect()
    lang = dict(spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "lang").collect())
    held = [r for r in got if r.held_out]
    assert len(held) > 10 and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.9 * len(held)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held) and all(0 <= r.score <= 1 for r in got)
    model = trained(spark.read.parquet(f"{tiny}/documents.parquet"))
    odd = with_language(documents(spark, [(1, None), (2, "  12 .. "), (3, "The and of"), (None, LONG)]), model, out="found")
    marks = [(r.doc_id, r.found.lang_pred) for r in odd.collect()]
    assert dict(marks)[1] == dict(marks)[2] == "und" and dict(marks)[3] == "en"
    unlabelled = spark.createDataFrame([(1, "some words", None, None, None)], DOCS)
    assert [tuple(r) for r in op6_language_id(spark, saved(unlabelled, tmp_path)).collect()] == [(1, False, "und", 0.0)]


def test_op6_draws_rows_of_one_id_or_none_each_by_itself(spark):
    from marginalia.llm.op6_language_id import trained

    texts = [(f"the house number {k} of that street", "en") if k % 2 else (f"das haus nummer {k} jener stra\u00dfe", "de") for k in range(900)]
    for doc in (1, 2, 3, None):
        model = trained(spark.createDataFrame([(doc, t, g, None, None) for t, g in texts], DOCS), sample=50)
        assert model.languages == ["de", "en"]
    same = trained(spark.createDataFrame([(1, "the house", "en", None, None)] * 900, DOCS), sample=50)
    assert same.languages == ["en"]


def test_op7_finds_items_and_paraphrases(spark, tiny):
    from marginalia.llm.op7_decontamination import contaminated, plain

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    bench = spark.read.parquet(f"{tiny}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    words = items[0].split()
    changed = " ".join(w if k % 6 else "changed" for k, w in enumerate(words))
    extra = [(-1, LONG[:4000] + " " + items[0].upper() + " " + LONG[:300]), (-2, "before " + changed + " after"), (-3, None), (-4, " ".join(sorted(words))), (None, items[1]), (-5, "")]
    odd = spark.createDataFrame([(d, t, None, None, None) for d, t in extra], DOCS)
    got = {(r.doc_id, r.item_id) for r in contaminated(docs.unionByName(odd), bench.unionByName(spark.createDataFrame([(None, None), (9999, "")], "item_id long, text string"))).collect()}
    assert {(-1, 0), (-2, 0), (None, 1)} <= got and not {d for d, _ in got} & {-3, -4, -5}
    spaced = lambda t: b" " + b" ".join(plain(t).split()) + b" "
    exact = {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if spaced(t) in spaced(r.text)}
    assert exact and exact <= got
    unrelated = {p for p in got - exact if p[0] is not None and p[0] >= 0}
    assert not unrelated
    assert contaminated(docs.limit(0), bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0


def test_op2_reads_back_what_it_was_given(spark, tmp_path):
    from marginalia.llm.op2_chat_formatting import formatted, learnt_text, read_back

    rows = [(1, 0, "user", "a <|end|> & &1; [INST]<"), (1, 1, "user", None), (1, 2, "assistant", "|>x</s>"), (1, 3, "assistant", "&0;"), (1, 4, None, ">"), (2, None, "assistant", "only\n"), (2, 1, "us|>er", "<|"), (4, 0, "end", "a"), (4, 1, "next", "b"), (4, 2, "next", "c"), (4, 3, "role:", "d"), (4, 4, "<", "e"), (4, 5, "|", "f"), (4, 6, ">", "g"), (4, 7, "", "h"), (4, 8, "role:end", "<|end|>"), (None, 0, "user", "q"), (3, 0, "user", "same"), (3, 0, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("turns", "runs", "pieces")})
    got = {r.conv_id: r for r in read_back(formatted(df)).withColumn("learnt", learnt_text()).collect()}
    for conv in (1, 2, 3, 4, None):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [(t.role, t.text) for t in got[conv].turns] == [(r[2] or "", r[3] or "") for r in own]
        assert got[conv].learnt == "".join(r[3] or "" for r in own if r[2] == "assistant")
    assert got[1].formatted.count("<|role:user|>") == 1 and formatted(df.limit(0)).count() == 0


def test_op3_matches_brute_force(spark):
    from marginalia.llm import op3_topk_search as op3

    rng = np.random.default_rng(11)
    x = rng.normal(0, 0.12, (2500, 16))
    x[100:140] = x[0]
    rows = [(i, [float(v) for v in v_]) for i, v_ in enumerate(x)] + [(5000, None), (5001, [None] * 16), (5002, [float("nan")] * 16), (5003, []), (None, [0.1] * 16), (5004, [0.5] * 3), (0, [float(v) for v in x[0]]), (0, [2.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("x")).withColumn("vector", F.lit("y"))
    vectors = op3.scaled(df)
    got = sorted(map(tuple, op3.top_k(vectors, vectors.where("id % 100 = 0"), 10, 150_000).collect()))
    v = np.floor(1024 * x.astype(np.float32).astype(np.float64)).astype(np.int64)
    want = []
    for q in range(0, 2500, 100):
        s = v @ v[q]
        best = [i for i in np.lexsort((np.arange(2500), -s)) if i != q][:10]
        want += [(q, k + 1, int(i), int(s[i])) for k, i in enumerate(best)]
    assert got == sorted(want)
    assert op3.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 9, 10, 11, 200, 500, 6000])
def test_op3_stops_on_proof(n):
    from marginalia.llm.op3_topk_search import Index

    rng = np.random.default_rng(2)
    x = rng.integers(-300, 300, (n, 8))
    index = Index(x)
    for q in rng.integers(-300, 300, (20, 8)):
        left, score = index.best(q, 10, np.array([min(3, n - 1)]))
        every = x @ q
        every = np.delete(every, min(3, n - 1))
        assert min(3, n - 1) not in left and (score == x[left] @ q).all()
        assert sorted(score)[::-1][:10] == sorted(every)[::-1][:10]
        assert n < 500 or len(left) <= max(10, n // 8)
    if n >= 500:  # the index is used, and not all of it is looked at
        assert 0 < index.looked_at < 20 * n * 8
    wide = Index(x * (1 << 40))
    left, score = wide.best(np.full(8, 7), 10, np.zeros(0, np.int64))
    assert sorted(score)[::-1][:10] == sorted((x * (1 << 40)).sum(1) * 7)[::-1][:10]


def test_op5_round_trip(spark):
    from marginalia.llm.op5_warc import chunk_rows, read_archives, write_archives
    from marginalia.llm.tables import new_path

    big = "é" * 50_000
    rows = [(1, "http://a/ü\r\n", big), (2, None, big), (3, "http://a/x%20y?q=%", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (None, "u", big), (0, "u", "x" * 100), (7, "u", "x" * 100), (7, "u", "x" * 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(0) for c in ("first", "digest", "bytes", "payload", "n")})
    folder = new_path(spark, "warc")
    table = read_archives(write_archives(chunk_rows(pages, chunk=7001), folder), folder, 9000).collect()
    last = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in table if r.last), key=repr)
    first = {big: 1, "x" * 100: 0}
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        revisit = len(raw) >= 100 and page != first[html]
        want.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first[html] if revisit else None))
    assert last == sorted(want, key=repr)
    assert {(r.page_id, r.url) for r in table} == {(p, u) for p, u, _ in rows}
    body = b"".join(r.body for r in sorted((r for r in table if r.page_id == 1), key=lambda r: r.chunk))
    assert body == big.encode() and max(len(r.body) for r in table) <= 9000
    empty = new_path(spark, "warc")
    assert read_archives(write_archives(chunk_rows(pages.limit(0)), empty), empty).count() == 0


def test_op5_records_are_linked_and_damage_is_told(spark):
    import gzip
    import io

    from marginalia.llm.op5_warc import header, record_id, records_of

    row = {"page_id": 7, "url": "http://a/x%20y\u00fc\n", "refers_to": None, "digest": hashlib.sha256(b"abcdef").hexdigest(), "bytes": 6}
    first, again = header(row), header({**row, "page_id": 8, "refers_to": 7})
    assert first == header(row) and record_id(7, row["digest"]).encode() in first
    assert b"WARC-Refers-To: " + record_id(7, row["digest"]).encode() in again and b"WARC-Target-URI: http://a/x%20y%C3%BC%0A" in first
    raw = first + b"abcdef\r\n\r\n" + again + b"\r\n\r\n"
    read = lambda b: [(r[0], r[1], r[2], r[3]) for r in records_of(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(gzip.compress(b)))), 4) if r[-1]]
    assert read(raw) == [(7, row["url"], "response", None), (8, row["url"], "revisit", 7)]
    for bad in (raw.replace(b"abcdef", b"abcdeg"), first + b"abc", raw[:40]):
        with pytest.raises((ValueError, KeyError)):
            read(bad)


def test_op1_versions_and_conflicts(spark, odd):
    from marginalia.llm.op1_sharding import Conflict, ShardStore
    from marginalia.llm.tables import new_path

    store = ShardStore(spark, new_path(spark, "store"), target=1 << 16)
    for k in range(6):
        store.append(odd.where(F.coalesce("doc_id", F.lit(0)) % 6 == k))
    assert store.version() == 6
    before, schema = store.manifest()
    store.compact()
    after, _ = store.manifest()
    assert len(after) < len(before) and sum(s.rows for s in after) == len(ODD_ROWS)
    assert sorted(map(repr, store.read().collect())) == sorted(map(repr, odd.collect()))
    assert store.read(1).count() == len([d for d, _ in ODD_ROWS if (d or 0) % 6 == 0])
    with pytest.raises(Conflict):
        store.commit(store.version() - 1, after, schema)
    assert store.append(odd.limit(0)) == store.version()


def test_op1_merges_schemas_and_refuses_clashes(spark):
    from marginalia.llm.op1_sharding import SchemaClash, ShardStore
    from marginalia.llm.tables import new_path

    store = ShardStore(spark, new_path(spark, "store"))
    store.append(spark.createDataFrame([(1, "a")], "id long, x string"))
    store.append(spark.createDataFrame([(2, 0.5)], "ID long, y double"))
    want = [(1, "a", None), (2, None, 0.5)]
    assert sorted(map(tuple, store.read().collect())) == want
    with pytest.raises(SchemaClash):
        store.append(spark.createDataFrame([("3",)], "id string"))
    store.compact()
    assert store.read().columns == ["id", "x", "y"] and sorted(map(tuple, store.read().collect())) == want


@pytest.mark.parametrize("hadoop", [False, True])
def test_op1_one_of_two_live_writers_gets_a_conflict(spark, monkeypatch, hadoop):
    from concurrent.futures import ThreadPoolExecutor

    from marginalia.llm import op1_sharding as op1
    from marginalia.llm.tables import new_path

    store = op1.ShardStore(spark, new_path(spark, "store"))
    schema = spark.range(1).schema

    def write(k):
        try:
            return store.commit(base, [op1.Shard(f"w{k}", 1, 1)], schema), k
        except op1.Conflict:
            return None

    if hadoop:  # the way of other file systems, one writer after the other: local folders do not rename atomically
        monkeypatch.setattr(type(store._fs), "getScheme", lambda self: "other", raising=False)
        base = 0
        assert [write(0), write(1)] == [(1, 0), None]
        return
    with ThreadPoolExecutor(4) as pool:
        for base in range(20):
            won = [w for w in pool.map(write, range(4)) if w]
            assert len(won) == 1 and store.manifest(base + 1)[0][0].path == f"w{won[0][1]}"
    with ThreadPoolExecutor(3) as pool:
        live = op1.ShardStore(spark, new_path(spark, "store"))
        list(pool.map(lambda k: live.append(spark.range(k * 10, k * 10 + 10)), range(3)))
    assert live.version() == 3 and sorted(r.id for r in live.read().collect()) == list(range(30))


def test_empty_tables(spark, tmp_path):
    from marginalia.llm import queries

    empty = {
        "documents": DOCS,
        "embeddings": "vec_id long, embedding array<float>, label int",
        "pages": "page_id long, url string, html string",
        "benchmark": "item_id long, text string",
        "conversations": "conv_id long, turn long, role string, text string",
    }
    for name, schema in empty.items():
        path = saved(spark.createDataFrame([], schema), tmp_path, name)
    for name, query in queries.QUERIES.items():
        assert query(spark, path).count() == (1 if name.startswith("op2_") else 0), name


def test_pipeline_stages(spark, tiny, odd):
    import corpus_pipeline

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    rows = corpus_pipeline.run(spark, tiny).collect()
    assert {r.doc_id for r in rows} <= ids and len({r.doc_id for r in rows}) > 0.7 * len(ids)
    mixed = odd.select("doc_id", "text", "lang", "source", "n_chars", "language", "spans")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, mixed, tiny)
        assert out.columns == mixed.columns and out.count() <= len(ODD_ROWS), name
        assert stage(spark, mixed.limit(0), tiny).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, mixed, tiny).count() > 0


def test_op7_finds_copies_amid_repeated_words_and_longer_than_a_window(spark, tiny):
    from marginalia.llm.op7_decontamination import contaminated

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").orderBy("item_id").collect()]
    long = " ".join(t for _, t in items[:5])
    bench = spark.createDataFrame([*items, (9000, long)], "item_id long, text string")
    junk = [max(set(t.split()), key=len) for _, t in items]
    rows = []
    for k, (i, t) in enumerate(items):
        words = t.split()
        changed = " ".join(w if j % 6 else "changed" for j, w in enumerate(words))
        other = junk[(k + 7) % len(junk)]
        rows += [(-1 - i, f"{other} " * 40 + t + f" {other}" * 40), (-1001 - i, f"{other} " * 40 + changed + f" {other}" * 40)]
    rows.append((-5000, f"{junk[9]} " * 60 + long + f" {junk[9]}" * 60))
    planted = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOCS)
    got = {(r.doc_id, r.item_id) for r in contaminated(docs.unionByName(planted), bench).collect()}
    want = {(d - i, i) for i, _ in items for d in (-1, -1001)} | {(-5000, 9000)}
    assert want <= got


@pytest.mark.parametrize("name", ["op8", "op10", "dedup_texts"])
def test_rows_of_one_id_and_other_texts_keep_their_own_spans(spark, tmp_path, name):
    from marginalia.llm.op8_suffix_dedup import dedup_texts, op8_suffix_dedup
    from marginalia.llm.op10_substring_dedup import op10_substring_dedup

    other = " ".join(f"other{i}" for i in range(60))
    rows = [(None, "null head " + PASSAGE), (None, other + " tail"), (None, "x"), (5, "y"), (5, PASSAGE + " five and more of it"), (5, "short " + other), (6, LONG[:3000]), (6, PASSAGE + " " + other)]
    # nothing repeats but PASSAGE and other, first in the rows of no id: these stay whole, later ones lose them
    df = documents(spark, rows)
    if name == "dedup_texts":
        got = [(r.doc_id, r.text) for r in dedup_texts(df).collect()]
        assert {t for d, t in got if d is None} == {t for d, t in rows if d is None} and (5, "y") in got and (6, LONG[:3000]) in got
        assert len(got) == len(rows) and not any("shared20" in t or "other30" in t for d, t in got if d is not None)
        return
    path = saved(df, tmp_path)
    got = (op8_suffix_dedup if name == "op8" else op10_substring_dedup)(spark, path).collect()
    size = (lambda t: len(t.encode())) if name == "op8" else (lambda t: len(t.split()))
    removed = {(r.doc_id, r.n_bytes if name == "op8" else r.n_words): r.n_removed for r in got}
    assert len(got) == len(rows)
    for d, t in rows:
        if d is None or not ("shared20" in t or "other30" in t):
            assert removed[d, size(t)] == 0
        else:
            least = sum(size(p) for p in (PASSAGE, other) if p in t)
            assert least <= removed[d, size(t)] <= least + 4


def test_op7_looks_up_nothing_where_no_rare_word_is():
    from marginalia.llm.op7_decontamination import FEATURES, Placed, block_of, coded, rare_words

    rare = rare_words(block_of([(1, "a b c d e f g")]), np.zeros(FEATURES, np.int64), 0.6)
    some = coded(["x y z"])[0]
    for code in (some[:0], some):
        at = np.arange(len(code))
        assert [len(x) for x in rare.places(Placed([1], [0], np.array([0]), np.array([5]), at, code))] == [0, 0]


def test_op7_latent_space_alone_finds_what_brute_force_does(spark, tiny):
    """Recall of the cosine search, without the look-up by rare words, against the subsequences of all pairs; another
    space gives another result."""
    from marginalia.llm import op7_decontamination as op7

    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    rng = np.random.default_rng(4)
    pool = " ".join(t for _, t in items).split()
    items += [(9000 + n, " ".join(rng.choice(pool, n))) for n in (400, 800, 5000)]
    hosts = [r.text.split() for r in docs.where("length(text) > 400").limit(40).collect()]
    words = [w for h in hosts for w in h]
    rows = []
    for k, (i, t) in enumerate(items):
        own, host = t.split(), hosts[k % len(hosts)]
        other = [w if j % 5 or j > 0.7 * len(own) else str(rng.choice(words)) for j, w in enumerate(own)]
        for n, body in enumerate((own, other)):
            at = int(rng.integers(0, len(host)))
            rows.append((-1 - i - 100_000 * n, " ".join([*host[:at], *body, *host[at:]])))
    every = docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    block = op7.block_of(items)
    want = set()
    for r in every.collect():
        code = op7.coded([r.text])[0]
        for i, item in zip(block.ids, block.words, strict=True):
            if np.isin(item, code).sum() >= 0.8 * len(item) and op7.common_subsequence(item, code) >= 0.8 * len(item):
                want.add((r.doc_id, i))
    found = lambda **k: {(r.doc_id, r.item_id) for r in op7.contaminated(every, bench, **k).collect()}
    alone, whole = found(lookup=False), found()
    assert {(d, i) for d, i in want if d < 0} >= {(-1 - i, i) for i, _ in items}
    planted = {(d, i) for d, i in want if d in (-1 - i, -100_001 - i)}  # in other pairs the words are scattered over a long text
    assert len(want & alone) >= 0.9 * len(want) and planted <= whole and alone <= whole
    identity = np.eye(op7.FEATURES, 16, dtype=np.float32)
    assert len(found(lookup=False, space=identity) & want) < 0.5 * len(want)


def test_op7_latent_space_is_fitted_on_all_documents(spark, monkeypatch):
    import numpy as np

    from marginalia.llm import op7_decontamination as op7

    fitted = []
    monkeypatch.setattr(op7, "latent_space", lambda found, weight, rank: fitted.append(found.count()) or np.eye(op7.FEATURES, rank, dtype=np.float32))
    docs = spark.range(9_000).selectExpr("id AS doc_id", "concat_ws(' ', id, id + 1, id + 2, 'and') AS text")
    op7.contaminated(docs, spark.createDataFrame([(1, "some item of words that are nowhere")], "item_id long, text string"))
    assert fitted == [9_000]


def test_op7_finds_items_in_scripts_without_spaces(spark, tiny):
    import random

    from marginalia.llm.op7_decontamination import contaminated, plain

    rng = random.Random(7)
    said = lambda n, letters: "".join(rng.choices(letters, [1 / (k + 3) for k in range(len(letters))], k=n))
    han, kana, thai = ([chr(c) for c in range(a, b)] for a, b in ((0x4E00, 0x4E00 + 900), (0x3041, 0x3097), (0x0E01, 0x0E2F)))
    items = [(1, said(60, han)), (2, said(25, han) + "，" + said(40, han) + "。"), (3, said(80, kana)), (4, said(80, thai)), (5, "plain words before " + said(50, han))]
    docs, wanted = [], set()
    for i, text in items:
        letters = {3: kana, 4: thai}.get(i, han)
        copy = "".join(c for k, c in enumerate(text) if k % 12 != 5)  # with letters left out
        for k, t in enumerate([text, said(300, letters) + text + said(300, letters), said(2_000, letters) + copy + said(50, letters)]):
            docs.append((10 * i + k, t))
            wanted.add((10 * i + k, i))
        docs += [(100 * i + k, said(3_000, letters)) for k in range(4)]
    rows = spark.read.parquet(f"{tiny}/documents.parquet").where("doc_id < 100").selectExpr("doc_id + 10000 AS doc_id", "text")
    got = contaminated(rows.unionByName(spark.createDataFrame(docs, "doc_id long, text string")), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == wanted
    assert plain("Ab 甲乙，丙丁戊！é戊 c-d") == "ab  甲乙   丙丁 丁戊  é 戊  c d".encode()


def test_pipeline_removes_items_amid_letters_of_their_script(spark, tmp_path, monkeypatch):
    import corpus_pipeline
    from marginalia.llm import op7_decontamination as op7

    fitted, fit = [], op7.latent_space
    monkeypatch.setattr(op7, "latent_space", lambda found, weight, rank: fitted.append(found.count()) or fit(found, weight, rank))
    item = "".join(chr(0x4E00 + 37 * k % 2_000) for k in range(60))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    around = "".join(chr(0x5E00 + 41 * k % 3_000) for k in range(200))
    docs = spark.range(9_000).selectExpr("id AS doc_id", f"concat(concat_ws(' ', id, id + 1, 'and '), '{around}', if(id % 3000 = 7, '{item}', ''), '{around}') AS text")
    kept = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert {r.doc_id for r in docs.select("doc_id").subtract(kept.select("doc_id")).collect()} == {7, 3_007, 6_007} and kept.count() == 8_997
    assert fitted == [9_000]


def test_op7_product_is_that_of_the_dense_matrix(spark):
    import numpy as np

    from marginalia.llm import op7_decontamination as op7

    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{min(int(k), 40)}" for k in rng.geometric(0.08, n)) for n in rng.integers(0, 200, 60)] + [None, "", "w1 " * 3_000]
    found = op7.codes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), "doc_id", "text")
    weight = rng.uniform(0, 2, op7.FEATURES) * (np.arange(op7.FEATURES) % 5 > 0)
    rows = []
    for text in texts:
        code = op7.features(op7.coded([text])[0])
        rows += [np.unique(code[a : a + op7.PASSAGE]) for a in range(0, len(code), op7.PASSAGE)]
    used = np.unique(np.concatenate(rows))
    dense = np.array([np.isin(used, r) for r in rows]) * weight[used]
    x = rng.standard_normal((op7.FEATURES, 7))
    got = op7.product(found, weight, x)
    assert np.allclose(got[used], dense.T @ (dense @ x[used]), rtol=1e-4, atol=1e-2)
    assert not got[np.setdiff1d(np.arange(op7.FEATURES), used)].any()


def test_op7_sorts_out_stretches_in_bulk_as_one_by_one():
    """Sums of strides, stretches made one, and the bound on an item's words there: what is done for all at once, one by one."""
    from collections import Counter

    from marginalia.llm import op7_decontamination as op7

    rng = np.random.default_rng(8)
    words = [rng.integers(0, 90, n).astype(np.uint32) for n in (0, 300, 5, 64, 1)]
    raw = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(range(5)), pa.array([w.tobytes() for w in words], pa.binary())], names=["doc", "row", "words"])
    (p,) = op7.placed(iter([raw]), op7.GAP)
    space = rng.normal(0, 1, (op7.FEATURES, 4)).astype(np.float32)
    space[::3] = 0
    want = np.zeros((int(p.at[-1]) // op7.STRIDE + 1, 4))
    for stride, feature in {(a // op7.STRIDE, c) for a, c in zip(p.at.tolist(), p.code.tolist(), strict=True)}:
        want[stride] += space[feature]
    assert np.allclose(op7.stride_sums(p, space, space.any(1), len(want)), want, atol=1e-5)

    rows = sorted((int(d), int(i), int(a), int(a + n), float(c)) for d, i, a, n, c in zip(rng.integers(0, 4, 400), rng.integers(0, 3, 400), rng.integers(0, 900, 400), rng.integers(1, 60, 400), rng.random(400), strict=True))
    longest, one = np.array([20, 90, 2000]), []
    for d, i, a, b, c in rows:
        if one and one[-1][:2] == (d, i) and a <= one[-1][3] and max(b, one[-1][3]) - one[-1][2] <= longest[i]:
            one[-1] = (d, i, one[-1][2], max(b, one[-1][3]), max(c, one[-1][4]))
        else:
            one.append((d, i, a, b, c))
    got = op7.side_by_side(*(np.array(x) for x in zip(*rows, strict=True)), longest)
    assert list(zip(*(x.tolist() for x in got), strict=True)) == one and len(one) < 300
    assert [len(x) for x in op7.side_by_side(*(np.zeros(0, np.int64) for _ in range(5)), longest)] == [0] * 5

    block = op7.block_of([(1, "a b c a d"), (2, "c c c e f g"), (3, "h")])
    known = op7.shares(block)
    word = rng.integers(0, len(known.vocabulary), 200)
    begin = rng.integers(0, 190, 500)
    end, item = begin + rng.integers(0, 11, 500), rng.integers(0, 3, 500)
    most = known.most(word, item, begin, end)
    for n, k, a, b in zip(most.tolist(), item.tolist(), begin.tolist(), end.tolist(), strict=True):
        own = Counter(block.words[k].tolist())
        assert n == sum(own[w] for w in set(known.vocabulary[word[a:b]].tolist()))
    # where all share one place the bound is too high, never too low
    known.of_word[:], known.of_item[:] = 0, 0
    known.table[:] = 0
    known.table[0] = sum(map(len, block.words))
    assert (known.most(word, item, begin, end) >= most).all()
    assert len(known.most(word[:0], item[:0], begin[:0], end[:0])) == 0


def test_op7_takes_up_no_stretch_that_cannot_hold_its_item(spark, tiny):
    """Stretches near an item in the latent space, but with too few of its words, cost no Python of their own."""
    from marginalia.llm import op7_decontamination as op7

    docs, bench = spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/benchmark.parquet")
    block = op7.block_of([(r.item_id, r.text) for r in bench.collect()])
    found = op7.codes(docs, "doc_id", "text")
    df, passages = op7.frequencies(found)
    space = op7.latent_space(found, op7.weights(df, passages), 32)
    vectors, rare, known = op7.folded(block, space), op7.rare_words(block, df, 0.6), op7.shares(block)
    taken = near = right = 0
    for p in op7.placed(iter(found.toArrow().to_batches()), op7.GAP):
        own, word = op7.among(p.code, known.vocabulary)
        _, item, lo, hi, _ = op7.stretches(p, block, space, space.any(1), vectors, rare, op7.COSINE)
        a, b = np.searchsorted(p.at[own], lo), np.searchsorted(p.at[own], hi)
        size = np.array([len(block.words[k]) for k in item])
        held = np.array([np.isin(block.words[k], p.code[own[x:y]]).sum() for k, x, y in zip(item, a, b, strict=True)])
        kept = known.most(word, item, a, b) >= op7.FAINT * size
        assert kept[held >= op7.FAINT * size].all()
        near, taken, right = near + len(item), taken + int(kept.sum()), right + int((held >= op7.FAINT * size).sum())
    assert 0 < right <= taken < 0.2 * near


def test_pipeline_decontamination_and_near_duplicates_keep_clean_rows_of_shared_ids(spark, tiny):
    import corpus_pipeline

    item = spark.read.parquet(f"{tiny}/benchmark.parquet").first().text
    clean = [" ".join(f"{c}{k}" for k in range(60)) for c in "pqr"]
    rows = [(None, item), (None, clean[0]), (3, item + " more"), (3, clean[1]), (4, clean[2]), (5, None), (6, "")]
    df = documents(spark, rows).withColumns({c: F.lit(1) for c in ("row", "_leak_doc", "doc_id_")})
    out = corpus_pipeline.decontamination(spark, df, tiny)
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted([(None, clean[0]), (3, clean[1]), (4, clean[2]), (5, None), (6, "")], key=repr)
    near = corpus_pipeline.near_duplicates(spark, df, tiny)
    assert sorted((r.text or "" for r in near.collect())) == sorted([item, *clean, ""]) or item + " more" in {r.text for r in near.collect()}


def test_pipeline_is_its_stages_one_after_another(spark, tmp_path, tiny):
    """A small corpus whose result is known for every stage, by hand."""
    import shutil

    import corpus_pipeline

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    item = spark.read.parquet(f"{tiny}/benchmark.parquet").first().text
    base = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]
    long_text = next(t for _, t, *_ in base if t and 3000 < len(t) < 9000)
    copy = (900_001, long_text, "en", "x", len(long_text))
    leak = (900_002, long_text[::-1] + " " + item + " " + long_text[:40], "en", "x", 1)
    none = (900_003, "123 ... 456", None, "x", 11)
    spark.createDataFrame([*base, copy, leak, none], docs.schema).write.parquet(f"file://{tmp_path}/documents.parquet")
    shutil.copy(f"{tiny}/benchmark.parquet", tmp_path / "benchmark.parquet")
    path = f"file://{tmp_path}"
    at = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in at.select("doc_id").collect()}
        at = corpus_pipeline.written(stage(spark, at, path), name)
        left = {r.doc_id for r in at.select("doc_id").collect()}
        assert left <= before
        if name == "language_id":
            assert 900_003 not in left and 900_001 in left
        if name == "near_duplicates":
            assert 900_001 not in left
        if name == "decontamination":
            assert 900_002 not in left
    pieces = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in pieces} == left
    assert {r.doc_id: r.doc_tokens for r in pieces} == {r.doc_id: r.doc_tokens for r in corpus_pipeline.packing(spark, at, path).collect()}
