"""Defined cases of operators that the synthetic tables do not hold."""

from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.functions import typography as T2
from marginalia.operators import aggregates as A
from marginalia.operators import mutations as M
from marginalia.operators import ranking as W
from marginalia.operators import statistics as E
from marginalia.operators import verdicts as V


def test_outline_sections_hold_all_of_their_text(spark, tiny):
    from marginalia import registry
    from marginalia.sources import standins as S

    units, sections = {}, {}
    for r in S.edus(spark, tiny).select("doc_id", "k", "text").orderBy("doc_id", "k").collect():
        units.setdefault(r["doc_id"], []).append(r["text"])
    for r in registry.queries()["x38_outline_sections"](spark, tiny).orderBy("doc_id", "section").collect():
        sections.setdefault(r["doc_id"], []).append(r["text"])
    assert {d: "\n".join(t) for d, t in sections.items()} == {d: "\n".join(t) for d, t in units.items()}
    assert max(len(t) for texts in sections.values() for t in texts) > 500


def values(spark, schema, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_overall_counts_of_no_judgments(spark):
    none = spark.createDataFrame([], "rule_id string, verdict string")
    assert tuple(A.a02_judgments_overall(none).first()) == (0, None, None, None, None)


def test_severity_rank_puts_unknown_last(spark):
    got = values(spark, "s string", [("high",), ("low",), ("critical",), (None,)], A.severity_rank(F.col("s")))
    assert got == [(0,), (2,), (3,), (3,)]


def test_clamped_confidence(spark):
    got = values(spark, "c string", [("0.4",), ("-2",), ("7",), ("?",), (None,), ("NaN",)], V.clamped(F.col("c")))
    assert got == [(0.4,), (0.0,), (1.0,), (None,), (None,), (None,)]


def test_latest_keeps_the_first_creation(spark):
    log = spark.createDataFrame([("p", 1, "x", 10), ("p", 2, None, 20)], "k string, seq int, v string, created int")
    assert tuple(M.latest(log, ["k"], "seq", keep_first=("created",)).first()) == ("p", 2, None, 10)


def test_conditional_updates_reject_stale_patches(spark):
    patches = spark.createDataFrame([("d", 1, 0), ("d", 2, 0), ("d", 3, 1)], "doc string, seq int, expected long")
    assert tuple(M.fold_updates(patches, "doc", "seq", "expected").first()) == ("d", 2, 3)


def test_keep_newest_leaves_other_labels(spark):
    log = spark.createDataFrame([("d", i, "auto" if i < 5 else "manual") for i in range(8)], "doc string, id int, label string")
    left = M.keep_newest(log, "doc", "id", 2, F.col("label") == "auto")
    assert sorted(r["id"] for r in left.collect()) == [3, 4, 5, 6, 7]


def test_best_match_takes_the_first_of_ties(spark):
    pairs = spark.createDataFrame([("q", 2, 0.9), ("q", 1, 0.9), ("r", 1, 0.7999)], "query string, pos int, score double")
    assert [tuple(r) for r in W.w03_best_match(pairs).collect()] == [("q", 1, 0.9)]


def test_swap_verdicts(spark):
    winner, same = E.e05_swap_verdict(F.col("x"), F.col("y"))
    got = values(spark, "x string, y string", [("a", "b"), ("a", "a"), ("tie", "tie"), ("b", "a")], winner, same)
    assert got == [("a", True), ("tie", False), ("tie", True), ("b", True)]


def test_lenient_verdicts(spark):
    rows = [
        ('so {"a": {"b": 1}, "winner": " y "} it is', "Y"),
        ("I like X a bit more: Y wins", "tie"),
        ('winner: "Y", I think', "Y"),
        ('the "X" is better', "tie"),
        ('{"winner": "Y"} or {"winner": "X"}', "X"),
        ('{"winner": "Z", "of": "X"}', "X"),
        ('{"winner": "TIE"}', "tie"),
        ('{"winner": null}', "tie"),
        ("", "tie"),
        (None, "tie"),
    ]
    df = spark.createDataFrame(rows, "t string, wanted string")
    assert df.where(E.e06_lenient_verdict(F.col("t")) != F.col("wanted")).collect() == []


def test_repeated_sentences_of_any_script_go(spark):
    rows = [("甲是。乙是。甲是。丙", "甲是。乙是。丙"), ("A b. A  b. C", "A b. C"), ("x.\n\n\n\ny.\n\nx. x.", "x.\n\n\n\ny.\n\n x."), ("a. b. a. b. a.", "a. b. a."), ("one", "one"), ("", ""), (None, None)]
    df = spark.createDataFrame(rows, "t string, wanted string")
    assert [(r.g, r.wanted) for r in df.select(X.collapsed_repeats(F.col("t")).alias("g"), "wanted").collect() if r.g != r.wanted] == []


def test_alpha_without_pairs_and_without_disagreement(spark):
    schema = "paper_id string, arm1 string, arm2 string, model string, winner string, pos int"
    assert E.e03_alpha(spark.createDataFrame([("p", "A", "B", "m", "a", 1)], schema)).first()[0] is None
    assert E.e03_alpha(spark.createDataFrame([("p", "A", "B", m, "a", 1) for m in "mn"], schema)).first()[0] == 1.0


def test_text_functions(spark):
    rows = [("See 10.1000/ab.c). [EDU:2][EDU:1][EDU:2] A b. A b. C",)]
    got = values(spark, "t string", rows, X.doi(F.col("t")), X.markers(F.col("t"), "EDU"), X.collapsed_repeats(F.lit("A b. A b. C")), X.latex_escaped(F.lit("a_{\\}")))[0]
    assert got[0] == "10.1000/ab.c"
    assert got[1] == ["1", "2"]
    assert got[2] == "A b. C"
    assert got[3] == r"a\_\{\textbackslash{}\}"


def test_rules_that_never_fire_and_lost_labels(spark):
    stats = A.a09_rule_stats(A.rule_catalog(spark), spark.createDataFrame([], "rule_id string, verdict string"), spark.createDataFrame([("p", "REL-01")], "paper_id string, rule_id string"), spark.createDataFrame([("p",), ("q",)], "paper_id string"))
    rows = {r.rule_id: r for r in stats.collect()}
    assert len(rows) == 13 and all(r.papers_analyzed == 2 for r in rows.values()) and rows["REL-02"].papers_fired == 0
    assert {r.rule_id: r.status for r in A.a27_rule_status(stats).collect()}["REL-02"] == "never fired"
    log = spark.createDataFrame([("d", 1, None), ("d", 2, "autosave"), ("d", 3, "autosave")], "doc string, v int, label string")
    assert {r.v for r in M.keep_newest(log, "doc", "v", 1, F.col("label") == "autosave").collect()} == {1, 3}


def test_events_keep_their_messages(spark):
    events = spark.createDataFrame([(1, "pending", None), (2, "error", "disk full"), (3, None, "x")], "id int, status string, error_message string")
    assert [tuple(r) for r in M.interrupt(events).orderBy("id").collect()] == [(1, "error", "Interrupted"), (2, "error", "disk full"), (3, None, "x")]
    done = M.finished(events, spark.createDataFrame([(1,)], "id int"), spark.createDataFrame([(3, "late")], "id int, message string"))
    assert [tuple(r) for r in done.orderBy("id").collect()] == [(1, "done", None), (2, "error", "disk full"), (3, "error", "late")]


def test_patches_of_some_columns(spark):
    patches = spark.createDataFrame([("d", 1, 0, "t", None), ("d", 2, 1, None, "b"), ("d", 3, 2, None, None), ("d", 4, 1, "stale", None)], "doc string, seq int, expected long, title string, body string")
    assert tuple(M.applied_patches(patches, "doc", "seq", "expected", ["title", "body"]).first()) == ("d", 2, "t", "b")


def test_sizes_are_rounded(spark):
    got = values(spark, "n long", [(0,), (1023,), (1996,), (1_600_000,), (None,)], A.size_label(F.col("n")))
    assert got == [("",), ("1023 B",), ("2 KB",), ("1.5 MB",), ("",)]


def test_memo_keys_tell_bars_and_nulls_apart(spark):
    got = values(spark, "a string, b string", [("a|b", "c"), ("a", "b|c"), (None, "c"), ("", "c"), ("\\0", "c")], V.memo_key(F.col("a"), F.col("b"), "1"))
    assert len(set(got)) == 5


def test_lint_marks_and_overlaps(spark):
    from marginalia.functions import typography as T

    df = spark.createDataFrame([(1, "中,a中A中 ，x"), (2, "plain, text"), (3, None), (4, "")], "id int, text string")
    rows = T.lint(df, "id", "text")
    got = sorted((r.id, r.at, r.end, r.type, r.replacement) for r in rows.collect())
    assert got == [(1, 1, 2, "half", "，"), (1, 2, 4, "spacing", "a 中"), (1, 3, 5, "spacing", "中 A"), (1, 4, 6, "spacing", "A 中"), (1, 6, 7, "space", "")]
    assert sorted(r.at for r in T.without_overlaps(rows, "id").collect()) == [1, 2, 4, 6]


def test_text_joins_gaps_and_claims(spark):
    from marginalia.functions import typography as T

    assert values(spark, "l array<string>", [(["net-", "work", "Zwei", "中", "文", ""],)], T.joined_lines(F.col("l"))) == [("net-work Zwei中文",)]
    assert values(spark, "t string", [("網路成 癮（ 2000 ）x y",)], T.without_gaps(F.col("t"))) == [("網路成癮（2000）x y",)]
    assert values(spark, "t string", [("First one. Second, with a claim ",), ("none",)], T.claim(F.col("t"))) == [("Second, with a claim",), ("none",)]
    assert values(spark, "t string", [("a \\% b % c\nd",)], T.latex_uncommented(F.col("t"))) == [("a \\% b \nd",)]
    assert values(spark, "t string", [("3.1",), ("1. Intro",)], T.without_number(F.col("t"))) == [("3.1",), ("Intro",)]


def test_sections_of_lines(spark):
    from marginalia.operators import sections as N

    df = spark.createDataFrame([(1, "Title\n\n1. Introduction\nwords\nMethods\nmore\n2 introduction again\nlast"), (2, "no heading\nhere"), (3, "Abstract\nx")], "id int, text string")
    got = {(r.id, r.line): (r.section, r.section_place) for r in N.sections(N.lines(df, "id", "text"), "id").collect()}
    assert got[1, 0] == ("Abstract", 0) and got[1, 3] == ("Introduction", 1) and got[1, 5] == ("Method", 2) and got[1, 7] == ("Introduction", 1)
    assert got[2, 1] == ("Other", 0) and got[3, 1] == ("Abstract", 0)


def test_chunks_leave_long_spans_alone(spark):
    from marginalia.operators import sections as N

    spans = spark.createDataFrame([("p", k, "x" * n) for k, n in enumerate([3, 3, 3, 20, 1, 9])], "p string, k int, text string")
    assert [r.chunk for r in N.chunks(spans, ["p"], "k", "text", 10).orderBy("k").collect()] == [0, 0, 0, 1, 2, 2]
    assert [r.part for r in N.halves(spans, ["p"], "k", "text", 10).orderBy("k").collect()] == [0, 0, 0, 3, 4, 4]


def test_heading_numbers_pass_over_unnumbered_chapters(spark):
    from marginalia.operators import sections as N

    rows = [("d", 0, 1, "Preface"), ("d", 1, 1, "One"), ("d", 2, 2, "a"), ("d", 3, 3, "x"), ("d", 4, 3, "y"), ("d", 5, 2, "b"), ("d", 6, 1, "Two"), ("d", 7, 2, "c")]
    got = [r.number for r in N.heading_numbers(spark.createDataFrame(rows, "d string, place int, level int, text string"), "d", ("Preface",)).orderBy("place").collect()]
    assert got == [None, "1", "1.1", "1.1.1", "1.1.2", "1.2", "2", "2.1"]
    rows = [("d", 0, 2, "before"), ("d", 1, 1, "One"), ("d", 2, 2, "a"), ("d", 3, 1, "References"), ("d", 4, 2, "b"), ("d", 5, 3, "x"), ("d", 6, 1, "Two"), ("d", 7, 3, "y")]
    got = [r.number for r in N.heading_numbers(spark.createDataFrame(rows, "d string, place int, level int, text string"), "d", ("References",)).orderBy("place").collect()]
    assert got == ["0.1", "1", "1.1", None, "1.2", "1.2.1", "2", "2.0.1"]


def test_citations_in_brackets_and_sentences(spark):
    from marginalia.operators import citations as C

    df = spark.createDataFrame([(1, "(boyd & Ellison, 2007) and （王小明，2010） but (see Eq. 3), (n=2009). Guo 與 Li (2018) and Table (2001)")], "id int, text string")
    got = [(r.surname, r.year, r.authors) for r in C.bracketed(df, "id", "text").orderBy("place").collect()]
    assert got[:2] == [("boyd", 2007, "boyd, Ellison"), ("王小明", 2010, "王小明")] and len(got) == 2
    assert [(r.surname, r.year) for r in C.narrative(df, "id", "text").collect()] == [("guo", 2018)]
    said = "去年 (2020), May (2019), Eq. (2004), January (2011) and Vol (1999); Smith (2001a), Sheldon et al. (2017), The Smiths (1980), O'Neil, Lee、王小明（1999b）"
    found = C.narrative(spark.createDataFrame([(1, said)], "id int, text string"), "id", "text").orderBy("place").collect()
    assert [(r.surname, r.year) for r in found] == [("smith", 2001), ("sheldon", 2017), ("smiths", 1980), ("o'neil", 1999)]
    spans = spark.createDataFrame([(1, 0, 20, "narrative"), (1, 15, 20, "bracket"), (1, 18, 30, "bracket"), (1, 30, 35, "bracket")], "id int, at int, end int, kind string")
    assert sorted((r.at, r.kind) for r in C.without_contained(spans, "id").collect()) == [(0, "narrative"), (30, "bracket")]


def test_entities_without_evidence_take_the_unit_that_names_them(spark):
    entities = spark.createDataFrame([("p", "e1", "Corpus"), ("p", "e2", "ab"), ("p", "e3", "absent")], "paper_id string, entity_id string, name string")
    units = spark.createDataFrame([("p", "u1", 2, 0, "Method", "the CORPUS is"), ("p", "u2", 1, 0, "Introduction", "a corpus")], "paper_id string, edu_id string, section_rank int, ord int, section string, text string")
    none = spark.createDataFrame([], "paper_id string, entity_id string, edu_id string")
    assert {r.entity_id: r.section for r in W.w08_entity_sections(entities, none, units).collect()} == {"e1": "Introduction", "e2": "__unsectioned__", "e3": "__unsectioned__"}


def test_denied_requests_take_no_slot(spark):
    from marginalia.streaming import limits as T

    kept, got = T.admit([], [0.0, 1.0, 2.0, 59.0, 60.0, 61.5], 2)
    assert got == [(True, 0), (True, 0), (False, 58), (False, 1), (True, 0), (True, 0)] and kept == [60.0, 61.5]


def test_stream_answers_as_the_batch_does(spark, tmp_path):
    from marginalia.streaming import limits as T

    rows = [(k % 3, 1_700_000_000 + 7 * k) for k in range(120)]
    df = spark.createDataFrame(rows, "who long, at long").withColumn("time", F.timestamp_seconds("at"))
    for part in range(3):  # three batches, in order
        df.where(f"at >= {1_700_000_000 + 280 * part} and at < {1_700_000_000 + 280 * (part + 1)}").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("who long, at long, time timestamp").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    query = T.limited_stream(stream, "who", 2, "1 hour").writeStream.format("memory").queryName("limited").option("checkpointLocation", f"file://{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.who, r.time): (r.admitted, r.wait) for r in spark.table("limited").collect()}
    want = {(r.who, r.time): (r.admitted, r.wait) for r in T.limited(df, "who", 2).collect()}
    assert got == want and len(got) == 120 and not all(a for a, _ in got.values())


def test_upload_streams_deduplicate_and_count(spark, tmp_path):
    from marginalia.streaming import limits as T

    rows = [(k, 1_700_000_000 + 60 * k, k % 4, "done") for k in range(40)]
    spark.createDataFrame(rows, "id long, at long, content long, status string").withColumn("time", F.timestamp_seconds("at")).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = lambda: spark.readStream.schema("id long, at long, content long, status string, time timestamp").parquet(f"file://{tmp_path}/in")
    for name, frame, mode in (("first", T.deduplicated(stream(), "content", "1 day"), "append"), ("days", T.by_day(stream(), "1 hour"), "complete")):
        frame.writeStream.format("memory").queryName(name).option("checkpointLocation", f"file://{tmp_path}/{name}").outputMode(mode).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table("first").count() == 4
    assert sum(r.n for r in spark.table("days").collect()) == 40


def test_graph_rules_on_a_small_graph_by_hand(spark):
    """A claim that support follows at once is not asked about; one without any is."""
    from marginalia.plans import rules as R

    units = [("p", f"p:Results:edu:{k}", k, "Results", 4, f"unit number {k} of the paper") for k in range(8)]
    edus = spark.createDataFrame([(p, 1, k, 8, s, r, k, e, t) for p, e, k, s, r, t in units], "paper_id string, doc_id long, k int, n int, section string, section_rank int, ord int, edu_id string, text string")
    frus = spark.createDataFrame([("p", "f0", "Claim", ""), ("p", "f1", "Evidence", ""), ("p", "f7", "Claim", ""), ("p", "f3", "MethodStep", ""), ("p", "f4", "Motivation", ""), ("q", "f3", "MethodStep", "")], "paper_id string, fru_id string, function string, summary string")
    covers = spark.createDataFrame([("p", "f0", 0, "p:Results:edu:0"), ("p", "f1", 0, "p:Results:edu:0"), ("p", "f7", 0, "p:Results:edu:7"), ("p", "f3", 0, "p:Results:edu:3"), ("p", "f4", 0, "p:Results:edu:6"), ("q", "f3", 0, "p:Results:edu:3")], "paper_id string, fru_id string, pos int, edu_id string")
    edus = edus.unionByName(edus.where("k = 3").withColumn("paper_id", F.lit("q")))
    empty = lambda schema: spark.createDataFrame([], schema)
    g = R.Graph(empty("paper_id string, title string"), edus, frus, covers, empty("paper_id string, rst_id string, rst_type string"), empty("paper_id string, rst_id string, edu_id string, role string"), empty("paper_id string, entity_id string, name string, type string"), empty("paper_id string, entity_id string, edu_id string"))
    assert [(r.fru_id, r.edu_texts) for r in R.r01_claim_evidence(g).collect()] == [("f7", "unit number 7 of the paper")]
    assert [r.paper_id for r in R.r03_action_justification(g).collect()] == ["q"]  # in p the motivation is three units on
    assert R.r18_unit(g, "q", "p:Results:edu:3").count() == 1 and R.r17_graph_nodes(g).count() == 9 + 6


def test_places_of_matches(spark):
    df = spark.createDataFrame([(1, "aXa.Xaaa x", "xa"), (2, "aaaa", "aa"), (3, "a.b", "."), (4, "x", ""), (5, None, "x"), (6, "\\Ee", "e")], "id int, t string, n string")
    got = sorted(map(tuple, T2.matches(df, "id", "t", F.col("n"), True).collect()))
    assert got == [(1, 1, 3), (1, 4, 6), (2, 0, 2), (2, 2, 4), (3, 1, 2), (6, 1, 2), (6, 2, 3)]


def test_scanned_lines_join_by_script_and_height(spark):
    from marginalia.operators import sections as N

    rows = [(1, 0, 0, 10, "一行"), (1, 0, 12, 10, " 接著"), (1, 0, 24, 10, "latin"), (1, 0, 43, 0, "近"), (1, 0, 44, 0, ""), (1, 1, 0, 10, "page")]
    got = N.scanned_paragraphs(spark.createDataFrame(rows, "id int, page int, y int, height int, text string"), "id").orderBy("paragraph").collect()
    assert [r["text"] for r in got] == ["一行接著 latin", "近", "page"]


def test_a_narrative_citation_does_not_begin_inside_a_word(spark):
    from marginalia.operators import citations as C

    df = spark.createDataFrame([(1, "ÉAI et al.（1951a） and ÉSmith (2001), 根據Smith (2002), (Lee (2003)"), (2, "E\u0301AI (1951)")], "id int, text string")
    assert sorted((r.surname, r.year) for r in C.narrative(df, "id", "text").collect()) == [("lee", 2003), ("smith", 2002)]


def test_an_edit_at_the_end_of_the_gap_begins_a_new_run(spark):
    from marginalia.streaming import limits as T

    df = spark.sql("SELECT k, timestamp(t) AS time FROM VALUES (1, '2024-01-01 00:00:00'), (1, '2024-01-01 08:00:00'), (1, '2024-01-01 15:59:59.999999'), (1, '2024-01-01 15:59:59.999999'), (2, '2024-01-01 00:00:00') x(k, t)")
    got = sorted((r.k, str(r.began), str(r.saved), r.edits) for r in T.debounced(df, "k", "8 hours").collect())
    assert got == [(1, "2024-01-01 00:00:00", "2024-01-01 08:00:00", 1), (1, "2024-01-01 08:00:00", "2024-01-01 23:59:59.999999", 3), (2, "2024-01-01 00:00:00", "2024-01-01 08:00:00", 1)]


def test_mean_similarity_of_many_equal_runs_is_counted_not_paired(spark):
    from itertools import combinations
    from time import monotonic

    sets = {"a": [], "b": [], "c": ["x", "y"], "d": ["X ", "y"], "e": ["y", "z"], "f": ["w"], "g": ["x", "y", "z"]}
    rows = [("g", r, i) for r, issues in sets.items() for i in issues or [None, " "]] + [("one", "a", "x")]
    got = {r["group"]: r["jaccard"] for r in E.e04_jaccard(spark.createDataFrame(rows, "group string, run string, issue string")).collect()}
    plain = [{i.lower().strip() for i in s} for s in sets.values()]
    alike = [len(a & b) / len(a | b) if a | b else 1.0 for a, b in combinations(plain, 2)]
    assert got == {"g": round(sum(alike) / len(alike), 3), "one": None}
    # half of 60,000 runs have each of two sets, whose pairs, two thousand million, are not to be made
    many = spark.range(120000).selectExpr("'g' AS `group`", "id div 2 AS run", "if(id % 2 = 0, 'x', concat('y', id div 2 % 2)) AS issue")
    begun = monotonic()
    assert [r["jaccard"] for r in E.e04_jaccard(many).collect()] == [0.667]
    assert monotonic() - begun < 60


def test_many_lines_are_joined_in_time_that_follows_their_length(spark):
    from time import monotonic

    got = values(spark, "t array<string>", [(["", "a-", "", "b", "C", "王", "d", ""],), ([],), (["", ""],), (["a", None],), (None,)], T2.joined_lines(F.col("t")))
    assert got == [("a-b C王d",), ("",), ("",), (None,), (None,)]
    begun = monotonic()
    assert spark.range(1).select(F.length(T2.joined_lines(F.expr("transform(sequence(1, 100000), k -> concat('line ', k, ' of a long text'))")))).first()[0] > 10**6
    assert monotonic() - begun < 20


def test_spaces_alone_look_at_no_characters(spark):
    df = spark.createDataFrame([(1, "字 ，a字, b  。"), (2, None), (3, "plain")], "id int, text string")
    rows = lambda kinds: sorted(map(tuple, T2.lint(df, "id", "text", kinds).select("id", "at", "end", "type", "original", "replacement").collect()))
    whole = rows(T2.KINDS)
    assert {r[3] for r in whole} == set(T2.KINDS)
    for kinds in [("half",), ("spacing",), ("space",), ("half", "space"), ("half", "spacing")]:
        assert rows(kinds) == [r for r in whole if r[3] in kinds]
    assert "_chars" not in T2.lint(df, "id", "text", ("space",))._jdf.queryExecution().optimizedPlan().toString()


def test_claims_meet_chunks_in_tiles_not_in_rows(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    odd = [None, [0.0, 0.0], [None, 1.0], [nan, 1.0], [inf, 1.0], [1.0], [], [1e200, 1e200], [1e-200, 0.0], [1.0, 2.0]]
    rows = [("a", i, [float(i % 5), float(i % 3 - 1)]) for i in range(40)] + [("a", 50 + i, v) for i, v in enumerate(odd)] + [("b", 90, [1.0, 1.0]), ("b", 91, [2.0]), (None, 92, [1.0]), ("a", None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "topic string, id long, v array<double>")
    claims, chunks = df.selectExpr("topic", "id AS claim_id", "v AS claim"), df.selectExpr("topic", "id AS chunk_id", "v AS chunk")
    pairs = claims.join(chunks, "topic").where("claim_id <> chunk_id").withColumn("score", W.cosine(F.col("claim"), F.col("chunk")))
    place = F.expr("row_number() OVER (PARTITION BY topic, claim_id ORDER BY score DESC, chunk_id)")
    plain = pairs.withColumn("rank", place).where("rank <= 3").select("topic", "claim_id", "chunk_id", F.round("score", 4).alias("score"), "rank")
    wanted = sorted(map(str, plain.collect()))
    assert sorted(map(str, W.w01_top_chunks(claims, chunks).collect())) == wanted
    for name, size in {"BLOCK": 7, "ASKED": 9, "TILE": 20}.items():
        monkeypatch.setattr(W, name, size)
    found = W.w01_top_chunks(claims, chunks)
    assert sorted(map(str, found.collect())) == wanted
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_halves_are_cut_within_a_row(spark):
    from marginalia.operators import sections as N

    def cut(sizes, lo, hi):
        if hi - lo > 1 and sum(s or 0 for s in sizes[lo:hi]) > 10:
            return cut(sizes, lo, (lo + hi) // 2) + cut(sizes, (lo + hi) // 2, hi)
        return [lo] * (hi - lo)

    groups = {1: [3], 2: [30], 3: [4, 7], 4: [5, 5], 5: [1] * 37, 6: [20, 0, 0, None, 11, 3, 3, 3, 3, 12], 7: [0] * 5, None: [9, 9, 9], 8: [k * 7 % 5 for k in range(1000)]}
    rows = [(g, "s", k * 2, None if n is None else "x" * n) for g, sizes in groups.items() for k, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "doc int, section string, k int, text string").repartition(3)
    found = N.halves(df, ["doc", "section"], "k", "text", 10)
    wanted = [(g, "s", k * 2, lo) for g, sizes in groups.items() for k, lo in enumerate(cut(sizes, 0, len(sizes)))]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(wanted, key=repr)
    assert [(f.name, f.dataType.simpleString()) for f in found.schema] == [("doc", "int"), ("section", "string"), ("k", "int"), ("part", "bigint")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort " not in plan


def test_sentences_of_a_text_are_made_once(spark, tmp_path):
    from marginalia.sources import standins as S

    texts = ["A sentence of enough letters.\nshort. Another one that is long enough! ", None, "", "short", "one  more\tsentence without an end"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    units = S._edus(spark, str(tmp_path))
    assert [tuple(r) for r in units.orderBy("doc_id", "k").select("doc_id", "k", "n", "text").collect()] == [(0, 0, 2, "A sentence of enough letters."), (0, 1, 2, "Another one that is long enough!"), (4, 0, 1, "one more sentence without an end")]
    assert units._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_graph_rows_are_sorted_once_behind_the_shuffle(spark):
    from marginalia.sources import exports as O

    stored = spark.createDataFrame([("a", 1, "x"), ("b", 1, None), ("c", 2, "z"), (None, 3, "n")], "k string, j int, v string")
    new = spark.createDataFrame([("a", 1, None), ("d", 4, "w"), (None, 3, "m"), ("c", 3, "y")], "k string, j int, v string")
    found = O.graph_upsert(stored, new, ["k", "j"])
    wanted = [("a", 1, None), ("b", 1, None), ("c", 2, "z"), ("c", 3, "y"), ("d", 4, "w"), (None, 3, "m")]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(wanted, key=repr)
    assert sorted(map(tuple, O.graph_upsert(found, new, ["k", "j"]).collect()), key=repr) == sorted(wanted, key=repr)
    plan = O.graph_upsert(stored, new, ["k", "j"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1 and plan.index("Sort [") < plan.index("Exchange")
