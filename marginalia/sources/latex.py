"""LaTeX texts to block rows, of the form that markdown.markdown_blocks gives.

Braces and environments nest, so that two small scans with a stack, of time in proportion to the text, do what column
expressions can't: _read() cuts a body into paragraphs, headings and environments, going into environments that only
wrap others, and inline() resolves commands with braced arguments into runs. Around them, comments, list items,
quotations and rows of tables are expressions. A text stays in its row until its segments are rows.

An environment ends at the first end of its name, or with the text around it. An unclosed brace goes to the end of what
it stands in. Commands that name no mark keep their argument; bare commands go; unknown environments are read through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.typography import latex_uncommented
from .arrow import each
from .markdown import RUN

#: What commands, escapes and environments mean.
MARKS = {"textbf": "bold", "bfseries": "bold", "textit": "italic", "emph": "italic", "itshape": "italic", "texttt": "code", "sout": "strike", "st": "strike"}
DROPPED = ("cite", "citep", "citet", "citeauthor", "label", "ref", "eqref", "footnote", "index", "nocite", "vspace", "hspace")
NAMED = {"textbackslash": "\\", "textasciitilde": "~", "textasciicircum": "^"}
ESCAPED = "&%$#_{} "
LISTS = {"itemize": False, "enumerate": True}
QUOTES = ("quote", "quotation")
CODE = ("verbatim", "lstlisting")
MATH = ("equation", "displaymath", "align", "math", "eqnarray", "gather", "multline")
TABLES = ("table", "tabular")
RULES = r"\\(?:hline|toprule|midrule|bottomrule)"
LEVELS = {"section": 1, "subsection": 2, "subsubsection": 3}

_STOP = re.compile(r"\n\n+|\n\Z|\\begin\{(\w+\*?)\}|\\(section|subsection|subsubsection)\*?\s*\{")
_BRACE = re.compile(r"\\(?s:.)|[{}]")
_PLAIN = re.compile(r"[^$\\~]+")
_COMMAND = re.compile(r"\\([a-zA-Z]+)\*?( *)")
_OWN = {*LISTS, *QUOTES, *CODE, *MATH, *TABLES, "figure"}
READ = "struct<title:string,segments:array<struct<kind:string,env:string,text:string,caption:string>>>"
_BEGIN, _END = "\\begin{document}", "\\end{document}"


def closes(s: str) -> dict[int, int]:
    """Of every brace that opens, where its other closes, or the end of s; escaped ones are none."""
    found: dict[int, int] = {}
    opened: list[int] = []
    for brace in _BRACE.finditer(s):
        if brace[0] == "{":
            opened.append(brace.start())
        elif brace[0] == "}" and opened:
            found[opened.pop()] = brace.start()
    return found | dict.fromkeys(opened, len(s))


def argument(s: str, command: str) -> str:
    """What stands in the first braces behind a command, "" without any."""
    at = s.find(command)
    at = s.find("{", at) if at >= 0 else at
    return s[at + 1 : closes(s[at:])[0] + at].strip() if at >= 0 else ""


def _segments(body: str) -> Iterator[tuple[str, str, str]]:
    """(kind, environment, text) of a body's paragraphs, headings (of the level in kind's place) and environments."""
    braces: dict[int, int] | None = None
    ends, at, begun = [len(body)], 0, 0  # of the open environments that only wrap others, where each ends
    after = [len(body)]
    while ends:
        stop = _STOP.search(body, at, ends[-1])
        if stop is None:
            yield "paragraph", "", body[begun : ends.pop()]
            at = begun = after.pop()
            continue
        yield "paragraph", "", body[begun : stop.start()]
        at = stop.end()
        if stop[1]:
            tag = f"\\end{{{stop[1]}}}"
            end = body.find(tag, at, ends[-1])
            inner, behind = (end, end + len(tag)) if end >= 0 else (ends[-1], ends[-1])
            if stop[1].rstrip("*") in _OWN:
                yield "environment", stop[1].rstrip("*"), body[at:inner]
                at = behind
            else:
                ends.append(inner)
                after.append(behind)
        elif stop[2]:
            braces = closes(body) if braces is None else braces
            end = min(braces.get(stop.end() - 1, ends[-1]), ends[-1])
            yield "heading", stop[2], body[at:end]
            at = min(end + 1, ends[-1])
        begun = at


def _inline(s: str) -> list[tuple[str, list[str]]]:
    out: list[tuple[str, list[str]]] = []
    buffer: list[str] = []
    braces = closes(s) if "{" in s else {}
    frames: list[tuple[int, list[str]]] = [(len(s), [])]  # of each open argument its end and marks
    at = 0

    def flush() -> None:
        if buffer:
            out.append(("".join(buffer), frames[-1][1]))
            buffer.clear()

    while True:
        end, marks = frames[-1]
        if at >= end:
            flush()
            frames.pop()
            if not frames:
                return out
            at = end + 1
            continue
        c = s[at]
        if c == "$":
            close = at + 1
            while close < end and s[close] != "$":
                close += 2 if s[close] == "\\" and close + 1 < end else 1
            flush()
            out.append((s[at + 1 : min(close, end)].strip(), ["math"]))
            at = close + 1 if close < end else end
        elif c == "\\":
            following = s[at + 1 : min(at + 2, end)]
            command = _COMMAND.match(s, at, end)
            if following == "\\":
                flush()
                out.append(("\n", []))
                at += 2
            elif following and following in ESCAPED:
                buffer.append(following)
                at += 2
            elif command is None:
                buffer.append("\\")
                at += 1
            elif command[1] in NAMED:
                buffer.append(NAMED[command[1]])
                at = command.start(2)
            elif command.end() < end and s[command.end()] == "{":
                close = min(braces[command.end()], end)
                if command[1] in DROPPED:
                    at = close + 1
                else:
                    flush()
                    mark = MARKS.get(command[1])
                    frames.append((close, marks if mark is None or mark in marks else [*marks, mark]))
                    at = command.end() + 1
            else:
                at = command.start(2)
        elif c == "~":
            buffer.append(" ")
            at += 1
        else:
            plain = _PLAIN.match(s, at, end)
            buffer.append(plain[0])
            at = plain.end()


def _title(t: str) -> str:
    """The text of a title, formulas and line breaks left out."""
    return "".join(x for x, marks in _inline(argument(t, "\\title")) if "math" not in marks and x != "\n")


def _read(t: str) -> dict:
    """The title of a text without comments, and the segments of its body, tables and figures with their caption."""
    begin, end = t.find(_BEGIN), t.rfind(_END)
    body = t[begin + len(_BEGIN) : end] if 0 <= begin <= end - len(_BEGIN) else t
    found = [(*s, argument(s[2], "\\caption") if s[1] in ("table", "figure") else None) for s in _segments(body) if s[0] != "paragraph" or s[2].strip()]
    return {"title": _title(t), "segments": [dict(zip(("kind", "env", "text", "caption"), s, strict=True)) for s in found]}


def inline(texts: Column) -> Column:
    """an array of texts as arrays of runs; formulas bear the mark math, line breaks are a run of their own."""
    return each(lambda ts: [[{"text": t, "marks": m} for t, m in _inline(x)] for x in ts], f"array<array<{RUN}>>")(texts)


def argument_of(text: Column, command: str) -> Column:
    """the balanced argument of a command's first occurrence."""
    return each(lambda t: argument(t, command), "string")(text)


def plain(runs: Column) -> Column:
    """The text of runs, formulas left out."""
    return F.array_join(F.transform(F.filter(runs, lambda r: ~F.array_contains(r["marks"], "math")), lambda r: r["text"]), "")


def cleaned(text: Column) -> Column:
    return latex_uncommented(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"))


def parts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, title, body) of LaTeX texts without their comments."""
    clean = cleaned(F.col(f"`{text}`"))
    # exploded, so that what the text is made of is made once, not for each use of it
    rows = texts.select(F.col(f"`{key}`").alias("key"), F.explode(F.array(clean)).alias("_clean"))
    inner = F.regexp_extract("_clean", r"(?s)\\begin\{document\}(.*)\\end\{document\}", 1)
    held = F.col("_clean").rlike(r"(?s)\\begin\{document\}.*\\end\{document\}")
    return rows.select("key", F.trim(each(_title, "string")(F.col("_clean"))).alias("title"), F.when(held, inner).otherwise(F.col("_clean")).alias("body"))


def table_rows(inner: Column) -> Column:
    """the cells of a tabular's lines, its column specification and rules left out."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(inner, r"^\s+", "")), r"^\{(?:[^{}]|\{[^{}]*\})*\}", ""), RULES, "")
    return F.transform(F.filter(F.split(clean, r"\\\\"), lambda r: r.rlike(r"\S")), lambda r: F.transform(F.split(r, "&"), lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")))


def latex_blocks(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Block rows of LaTeX texts: a row of kind title, of top -1, where there is one, and those of the body."""
    own = texts.select(F.col(f"`{key}`").alias("key"), each(_read, READ)(cleaned(F.col(f"`{text}`"))).alias("r"))
    found = own.select("key", F.trim("r.title").alias("title"), F.posexplode_outer("r.segments").alias("at", "s")).select("key", "title", "at", "s.*")
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    env, body = F.col("env"), F.col("text")
    tabular = F.regexp_extract("text", r"(?s)\\begin\{tabular\}(.*?)\\end\{tabular\}", 1)
    image = F.regexp_extract("text", r"\\includegraphics(?:\[[^\]]*\])?\{([^}]*)\}", 1)
    none = F.array().cast("array<string>")
    kind_of = F.col("kind")
    listed = F.transform(F.filter(F.slice(F.split(body, r"\\item"), 2, F.length(body) + 1), lambda t: t.isNotNull()), strip)
    quoted = F.filter(F.split(strip(body), r"\n[ \t]*\n"), lambda p: p.rlike(r"\S"))
    block = lambda kind, texts, level=None, ordered=None, cells=none: F.struct(F.lit(kind).alias("kind"), (F.lit(None) if level is None else level).cast("int").alias("level"), (F.lit(None) if ordered is None else ordered).cast("boolean").alias("ordered"), texts.alias("text"), cells.alias("cells"))
    level = F.when(env == "section", 1).when(env == "subsection", 2).otherwise(3)
    rows_of = table_rows(F.when(env == "table", tabular).otherwise(body))
    captions = F.when(F.coalesce("caption", F.lit("")) != "", F.array(block("caption", F.col("caption"))))
    cut = (
        F.when(kind_of == "paragraph", F.array(block("paragraph", strip(body))))
        .when(kind_of == "heading", F.array(block("heading", body, level)))
        .when(env.isin(*LISTS), F.transform(listed, lambda t: block("item", t, None, env == "enumerate")))
        .when(env.isin(*QUOTES), F.transform(quoted, lambda t: block("quote", t)))
        .when(env.isin(*CODE), F.array(block("code", F.regexp_replace(body, "^\n+|\n+$", ""))))
        .when(env.isin(*MATH), F.array(block("math", strip(body))))
        .when(env == "figure", F.array(block("figure", F.coalesce(F.nullif("caption", F.lit("")), F.when(image != "", F.concat(F.lit("["), image, F.lit("]"))), F.lit("")))))
        .otherwise(F.concat(F.coalesce(captions, F.array().cast("array<struct<kind:string,level:int,ordered:boolean,text:string,cells:array<string>>>")), F.transform(rows_of, lambda r, k: block("row", F.lit(""), (k == 0).cast("int"), None, r))))
    )
    no_blocks = F.array().cast("array<struct<top:int,part:int,b:struct<kind:string,level:int,ordered:boolean,text:string,cells:array<string>>>>")
    titled = F.when((F.coalesce("at", F.lit(0)) == 0) & (F.col("title") != ""), F.array(F.struct(F.lit(-1).alias("top"), F.lit(0).alias("part"), block("title", F.col("title")).alias("b"))))
    numbered = F.when(F.col("at").isNotNull(), F.transform(cut, lambda b, k: F.struct(F.col("at").alias("top"), k.alias("part"), b.alias("b"))))
    rows = found.select("key", F.explode(F.concat(F.coalesce(titled, no_blocks), F.coalesce(numbered, no_blocks))).alias("x")).select("key", "x.top", "x.part", "x.b.*")
    spoken = F.col("kind").isin("paragraph", "heading", "item", "quote", "caption")
    # exploded, so that the filter behind it does not have the runs made again
    rows = rows.select("*", F.explode(F.array(inline(F.when(spoken, F.array("text")).otherwise(F.col("cells"))))).alias("_runs"))
    first = F.get("_runs", F.lit(0))
    # a paragraph of commands alone is none
    rows = rows.where((F.col("kind") != "paragraph") | (F.size(first) > 0))
    flat = lambda r: F.array_join(F.transform(r, lambda x: x["text"]), "")
    body_rows = rows.select(
        "key",
        "top",
        "part",
        F.col("kind").isin("item", "quote").cast("int").alias("depth"),
        "kind",
        "level",
        "ordered",
        F.when(spoken, flat(first)).otherwise(F.col("text")).alias("text"),
        F.when(spoken, first).alias("runs"),
        F.when(F.col("kind") == "row", F.transform("_runs", flat)).alias("cells"),
        F.when(F.col("kind") == "figure", "").alias("src"),
    )
    return body_rows.withColumnRenamed("key", key)
