"""Imported documents: cases that the dressed texts of the tables do not hold."""

import random
import re

import pytest
from pyspark.sql import functions as F


from marginalia.functions import typography as T
from marginalia.sources import latex as TEX
from marginalia.sources import markdown as MD


def blocks(spark, text, *columns):
    df = spark.createDataFrame([(1, text)], "id long, text string")
    rows = MD.markdown_blocks(df, "id", "text").orderBy("place", "part").collect()
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in rows]


def test_first_heading_is_the_title_and_others_move_up(spark):
    text = "\n# Main *one*\n\n## A\n### B\n#### C\n\ntext\n"
    assert blocks(spark, text, "kind", "level", "text") == [("title", None, "Main one"), ("heading", 1, "A"), ("heading", 2, "B"), ("heading", 3, "C"), ("paragraph", None, "text")]
    assert blocks(spark, "text\n# A\n## B\n", "kind", "level") == [("paragraph", None), ("heading", 1), ("heading", 2)]
    assert blocks(spark, "A\n===\nB\n---\n\n---\n", "kind", "level") == [("title", None), ("heading", 1), ("rule", None)]


def test_lists_nest_to_any_depth(spark):
    text = "1. one\n   - two\n     * three\n       more\n\n       again\n   - two b\n2. next\n+ other\n\nend"
    assert blocks(spark, text, "kind", "depth", "ordered", "text", "top") == [
        ("item", 1, True, "one", 0),
        ("item", 2, False, "two", 0),
        ("item", 3, False, "three more", 0),
        ("more", 3, False, "again", 0),
        ("item", 2, False, "two b", 0),
        ("item", 1, True, "next", 0),
        ("item", 1, False, "other", 1),
        ("paragraph", 0, None, "end", 2),
    ]


def test_lists_end_or_go_on(spark):
    assert blocks(spark, "- a\nlazy\n\nnot in it\n2. two\n1. one", "kind", "text") == [("item", "a lazy"), ("paragraph", "not in it 2. two"), ("item", "one")]
    assert blocks(spark, "- a\n  ```\n  - code\n  ```\n  b\n- c", "kind", "text") == [("item", "a"), ("more", "b"), ("item", "c")]
    assert blocks(spark, "-\n- x", "kind", "text") == [("item", ""), ("item", "x")]


def test_fences_hold_whatever_they_hold(spark):
    text = "````md\n```\n# no\n\n~~~\n````\nafter\n~~~\n```\nopen to the end\n"
    assert blocks(spark, text, "kind", "text") == [("code", "```\n# no\n\n~~~"), ("paragraph", "after"), ("code", "```\nopen to the end")]
    assert blocks(spark, "a\n    not code\n\n    code\n\n      more\n\nb", "kind", "text") == [("paragraph", "a not code"), ("code", "code\n\n  more"), ("paragraph", "b")]


def test_tables_need_a_delimiter_of_as_many_cells(spark):
    assert blocks(spark, "a | b\n--|--\n*c* | d\\|e\n\nf | g", "kind", "cells") == [("row", ["a", "b"]), ("row", ["c", "d|e"]), ("paragraph", None)]
    assert blocks(spark, "| a | b |\n| --- |\n", "kind") == ["paragraph"]
    assert blocks(spark, "| a |\n| --- |\n| b | c |\n", "kind") == ["paragraph"]


def test_quotes_keep_their_paragraphs(spark):
    assert blocks(spark, "> a\nlazy\n> b\n>\n> # no\n> c\n\n> d", "kind", "text", "top") == [("quote", "a lazy b", 0), ("quote", "c", 0), ("quote", "d", 1)]


def test_marks_nest_and_code_is_left_alone(spark):
    runs = blocks(spark, "x **b *i* b** `*c*` ~~s~~ $a_1$ [l **k**](u) * not *", "runs")[0]
    assert [(r["text"], r["marks"]) for r in runs] == [("x ", []), ("b ", ["bold"]), ("i", ["bold", "italic"]), (" b", ["bold"]), (" ", []), ("*c*", ["code"]), (" ", []), ("s", ["strike"]), (" ", []), ("a_1", ["math"]), (" ", []), ("l ", []), ("k", ["bold"]), (" * not *", [])]


def test_images_part_their_paragraph(spark):
    text = "before ![one](a.png) ![](b.png 'T')\nafter  \nlast\\\nline"
    assert blocks(spark, text, "kind", "text", "src", "place", "part") == [("paragraph", "before", None, 0, 0), ("figure", "one", "a.png", 0, 1), ("figure", "", "b.png", 0, 2), ("paragraph", "after\nlast\nline", None, 0, 3)]


def test_math_blocks(spark):
    assert blocks(spark, "$$\n x + y \n\n z\n$$\n$$\nopen", "kind", "text") == [("math", "x + y \n\n z"), ("paragraph", "$$ open")]


@pytest.mark.parametrize("text", [None, "", "\n \n"])
def test_nothing_gives_no_blocks(spark, text):
    assert blocks(spark, text, "kind") == []


# LaTeX


def brute_close(s, at):
    """Where the brace at at closes, by counting."""
    depth = 0
    while at < len(s):
        if s[at] == "\\":
            at += 1
        else:
            depth += {"{": 1, "}": -1}.get(s[at], 0)
            if depth == 0:
                return at
        at += 1
    return len(s)


def brute_inline(s, marks=()):
    """Runs by recursion into arguments."""
    tokens = re.compile(r"\$(?P<math>(?:\\(?s:.)|[^$\\]|\\(?=\Z))*)\$?|(?P<line>\\\\)|\\(?P<escaped>[&%$#_{} ])|\\(?P<name>[a-zA-Z]+)\*?|(?P<other>(?s:.))")
    out, at = [], 0

    def say(text):
        if out and out[-1][2]:
            out[-1] = (out[-1][0] + text, out[-1][1], True)
        else:
            out.append((text, marks, True))

    while at < len(s):
        m = tokens.match(s, at)
        at = m.end()
        if m["math"] is not None:
            out.append((m["math"].strip(), ("math",), False))
        elif m["line"]:
            out.append(("\n", (), False))
        elif m["name"]:
            if m["name"] in TEX.NAMED:
                say(TEX.NAMED[m["name"]])
                continue
            brace = re.compile(" *").match(s, at).end()
            if s[brace : brace + 1] == "{":
                end = brute_close(s, brace)
                at = end + 1
                if m["name"] not in TEX.DROPPED:
                    mark = TEX.MARKS.get(m["name"])
                    inner = brute_inline(s[brace + 1 : end], marks + ((mark,) if mark and mark not in marks else ()))
                    out += [(t, k, False) for t, k in inner]
                    if inner == [] and out:  # what follows is a run of its own
                        out[-1] = (*out[-1][:2], False)
        else:
            say(m["escaped"] or (" " if m["other"] == "~" else m["other"]))
    return [(t, k) for t, k, _ in out]


def brute_segments(body):
    """(kind, environment, text) by recursion into wrappers."""
    out, at, begun = [], 0, 0
    while at <= len(body):
        rest = body[at:]
        stop = re.match(r"\n+", rest) if re.match(r"\n(\n|\Z)", rest) else None
        env = re.match(r"\\begin\{(\w+\*?)\}", rest)
        head = re.match(r"\\((?:sub){0,2}section)\*?\s*\{", rest)
        if at == len(body) or stop or env or head:
            out.append(("paragraph", "", body[begun:at]))
            if at == len(body):
                break
            if stop:
                at += stop.end()
            elif env:
                tag = "\\end{" + env[1] + "}"
                inner, found, behind = rest[env.end() :].partition(tag)
                own = env[1].rstrip("*")
                out += [("environment", own, inner)] if own in TEX._OWN else brute_segments(inner)
                at = len(body) - len(behind) if found else len(body)
            else:
                end = brute_close(body, at + head.end() - 1)
                out.append(("heading", head[1], body[at + head.end() : end]))
                at = min(end + 1, len(body))
            begun = at
        else:
            at += 1
    return [s for s in out if s[0] != "paragraph" or s[2].strip()]


PIECES = ["a", "b ", " ", "\n", "\n\n", "{", "}", "$", "\\", "\\\\", "\\%", "\\{", "\\}", "~", "\\textbf{", "\\emph {", "\\cite{", "\\unknown{", "\\bare ", "\\textbackslash", "\\item ", "\\section{", "\\subsection* {", "\\begin{itemize}", "\\end{itemize}", "\\begin{center}", "\\end{center}", "\\begin{box*}", "\\end{box*}", "\\begin{verbatim}", "\\end{verbatim}"]


@pytest.mark.parametrize("seed", range(20))
def test_latex_scans_equal_recursive_ones(seed):
    rng = random.Random(seed)
    for _ in range(300):
        s = "".join(rng.choices(PIECES, k=rng.randint(0, 25)))
        assert [x for x in TEX._segments(s) if x[0] != "paragraph" or x[2].strip()] == brute_segments(s), s
        merged = [(t, tuple(m)) for t, m in TEX._inline(s)]
        assert "".join(t for t, _ in merged) == "".join(t for t, _ in brute_inline(s)), s
        letters = lambda runs: [(c, m) for t, m in runs for c in t]
        assert letters(merged) == letters(brute_inline(s)), s


def test_latex_documents(spark):
    text = r"""\title{A \textbf{study}} % of
\begin{document}
\maketitle
\section*{One {nested} \emph{head}}
Text 100\% sure.\footnote{gone} % comment \begin{quote}
more \textit{\textbf{both}

\begin{unknown}\begin{enumerate}\item x \item y\end{enumerate}\end{unknown}
\begin{table}\caption{C}\begin{tabular}{lp{2cm}}a & \emph{b} \\ \hline c & d \\ \end{tabular}\end{table}
\begin{align*} x \end{align*}
\end{document} after"""
    df = spark.createDataFrame([(1, text), (2, None), (3, "plain \\ & x")], "id long, text string")
    rows = TEX.latex_blocks(df, "id", "text").orderBy("id", "top", "part").collect()
    assert [(r["id"], r["kind"], r["text"], r["cells"]) for r in rows] == [
        (1, "title", "A study", None),
        (1, "heading", "One {nested} head", None),
        (1, "paragraph", "Text 100% sure. \nmore both", None),
        (1, "item", "x", None),
        (1, "item", "y", None),
        (1, "caption", "C", None),
        (1, "row", "", ["a", "b"]),
        (1, "row", "", ["c", "d"]),
        (1, "math", "x", None),
        (3, "paragraph", "plain  & x", None),
    ]


def test_comments_end_where_an_even_number_of_escapes_stands_before(spark):
    df = spark.createDataFrame([("a % b\n\\% c \\\\% d\n%e", "x" * 50_000 + "\\%" * 20_000 + "%y")], "a string, b string")
    row = df.select(T.latex_uncommented(F.col("a")).alias("a"), F.length(T.latex_uncommented(F.col("b"))).alias("b")).first()
    assert tuple(row) == ("a \n\\% c \\\\\n", 90_000)


def test_values_are_objects_slice_by_slice():
    import pyarrow as pa

    from marginalia.sources import arrow

    alive, most = 0, 0

    class Held(str):
        def __new__(cls, value):
            nonlocal alive, most
            alive += 1
            most = max(most, alive)
            return super().__new__(cls, value)

        def __del__(self):
            nonlocal alive
            alive -= 1

    texts = pa.array([None if k % 7 == 0 else "x" * 20_000 for k in range(1000)])
    got = arrow.sliced(texts, lambda t: Held(t[:3]), pa.string())
    assert got.to_pylist() == [None if k % 7 == 0 else "xxx" for k in range(1000)]
    assert most * 20_000 <= 2 * arrow.SLICE_BYTES + 20_000
    assert arrow.sliced(texts.slice(0, 0), len, pa.int64()).to_pylist() == []


def test_latex_is_read_by_two_workers(spark):
    rows = spark.createDataFrame([(1, "\\begin{table}\\caption{a}\\begin{tabular}{l}b\\\\ \\end{tabular}\\end{table}")], "doc long, text string")
    plan = TEX.latex_blocks(rows, "doc", "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2


@pytest.mark.parametrize("name", ["f09_markdown", "f11_text", "f12_html"])
def test_a_render_reads_its_documents_once(spark, tiny, name):
    from marginalia.queries_imports import QUERIES

    plan = QUERIES[name](spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert len([x for x in plan.splitlines() if x.strip(" +-:").startswith("ArrowEvalPython")]) == 1
