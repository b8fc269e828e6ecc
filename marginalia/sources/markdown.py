"""Markdown texts to block rows.

Lines are classified, stripped of their marks and taken apart into runs by column expressions. Only what depends on all
lines before, the fence, the list items and the table that are open, is left to a scan with a stack (ranges), which
sees classes and indents, no text, and gives the range of lines of each block. A text stays in its row all the while, so
that nothing is shuffled, and costs time in proportion to its lines.

Blocks: (key, place, part, top, depth, kind, level, ordered, text, runs, cells, src), in the order of place and part. top
numbers the blocks of the document's first level, so that rows of one list, quote or table share it. Kinds: title,
heading (level 1 to 3), paragraph,
item and more (the first and further paragraphs of a list item, depth from 1), quote (a paragraph of a quotation), code,
math, rule, figure (text: its caption), row (of a table; level 1: its head). Images in paragraphs are figures of their
own and part the text around them. Blocks inside list items and quotations other than these are left out.

Inline marks, nested two deep: code, bold, italic, strike, math; links keep their text. A first block that is a heading
of level 1 is the title, and other headings move up one level. Not covered: reference links, HTML, entities, emphasis
inside words; such text stays as it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import each

DELIMITER = r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$"
ITEM = r"^( *)([-*+]|[0-9]{1,9}[.)])( +|$)"
#: Inline tokens, in the order in which they are tried, with their mark.
TOKENS = {
    "code": r"`[^`]+`",
    "math": r"\$[^$\s](?:[^$]*[^$\s])?\$",
    "link": r"\[[^\[\]]*\]\([^()]*\)",
    "bold": r"\*\*[^*]+(?:\*[^*]+\*[^*]*)*\*\*",
    "strike": r"~~[^~]+~~",
    "italic": r"\*[^*\s](?:[^*]*[^*\s])?\*",
}
IMAGE = r"!\[[^\[\]]*\]\([^()]*\)"
RUN = "struct<text:string,marks:array<string>>"


def lines(text: Column) -> Column:
    return F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n")


def cells(line: Column) -> Column:
    """The cells of a table's line, between bars that are not escaped."""
    inner = F.regexp_replace(F.trim(line), r"^\||\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|")))


def classified(line: Column) -> Column:
    """A line as (kind, indent, content, mark, n): content is where a list item's text begins; mark tells fences, items and
    underlines apart, n is the length of a fence, the number of cells, or 1 for what may interrupt a paragraph."""
    indent = F.length(F.regexp_extract(line, r"^([ \t]*)", 1))
    flat = F.regexp_replace(line, "\t", "    ")
    body = F.trim(line)
    marker = F.regexp_extract(flat, ITEM, 2)
    gap = F.length(F.regexp_extract(flat, ITEM, 3))
    content = indent + F.length(marker) + F.when((gap >= 1) & (gap <= 4), gap).otherwise(1)
    near = flat.rlike(r"^ {0,3}\S")
    rule = flat.rlike(r"^ {0,3}(?:(?:- *){3,}|(?:\* *){3,}|(?:_ *){3,})$")

    def one(kind: str, mark: Column | str = "", n: Column | int = 0) -> Column:
        mark = F.lit(mark) if isinstance(mark, str) else mark
        n = F.lit(n) if isinstance(n, int) else n
        return F.struct(F.lit(kind).alias("kind"), indent.alias("indent"), content.alias("content"), mark.alias("mark"), n.cast("int").alias("n"))

    return (
        F.when(~line.rlike(r"^[ \t]*(?:$|[`~$#=*_>+0-9-])|\|"), one("text"))
        .when(body == "", one("blank"))
        .when(flat.rlike(r"^ {0,3}(?:`{3,}[^`]*|~{3,}.*)$"), one("fence", F.concat(F.substring(body, 1, 1), F.when(body.rlike("^(?:`+|~+)$"), "").otherwise("info")), F.length(F.regexp_extract(body, "^(`+|~+)", 1))))
        .when(near & body.rlike(r"^\$\$$"), one("math"))
        .when(flat.rlike(r"^ {0,3}#{1,6}(?:[ ]|$)"), one("heading"))
        .when(rule & ~body.rlike("^-+$"), one("rule"))
        .when(near & body.rlike("^(?:=+|-{2,})$"), one("under", F.substring(body, 1, 1), F.when(rule, 1).otherwise(0)))
        .when(near & body.rlike("^>"), one("quote", F.when(F.regexp_replace(body, "^>[ ]?", "").rlike(r"^\s*$"), "blank").when(F.regexp_replace(body, "^>[ ]?", "").rlike(r"^ {0,3}(?:#{1,6}(?: |$)|`{3}|~{3}|>|[-*+] |[0-9]{1,9}[.)] )|^ {4}"), "other").otherwise("text")))
        .when(flat.rlike(ITEM), one("item", F.when(marker.rlike("[0-9]"), F.right(marker, F.lit(1))).otherwise(marker), F.when(marker.isin("-", "*", "+", "1.", "1)") & flat.rlike(ITEM + r".*\S"), 1).otherwise(0)))
        .when(near & flat.rlike(DELIMITER) & body.contains("|"), one("delimiter", "", F.size(cells(line))))
        .when(body.contains("|"), one("bars", "", F.size(cells(line))))
        .otherwise(one("text"))
    )


RANGES = "array<struct<kind:string,top:int,depth:int,ordered:boolean,level:int,first:int,n:int>>"


def _table_end(found: list, at: int) -> int:
    """The line behind a table whose head is at this line, or the line itself if there is none."""
    if at + 1 >= len(found) or found[at]["kind"] != "bars" or found[at + 1]["kind"] != "delimiter" or found[at]["n"] != found[at + 1]["n"]:
        return at
    end = at + 2
    while end < len(found) and found[end]["kind"] in ("bars", "delimiter"):
        if found[end]["n"] != found[at]["n"]:
            return at
        end += 1
    return end


def _ranges(found: list) -> Iterator[list]:
    """The blocks of a document's classified lines: [kind, top, depth, ordered, level, first line, number of lines]."""
    top, at, last_math = -1, 0, max((k for k, x in enumerate(found) if x["kind"] == "math"), default=-1)
    items: list[tuple[int, str, int]] = []  # of each open item: where its text begins, its mark, its list
    block = None  # the paragraph that goes on, if any

    while at < len(found):
        line, kind = found[at], found[at]["kind"]
        start, at = at, at + 1
        if kind == "blank":
            if block:
                yield block
            block = None
            continue
        if kind == "item" and (items or line["indent"] < 4) and (items or not block or block[0] == "quote" or line["n"]):
            if block:
                yield block
            closed = None
            while items and line["indent"] < items[-1][0]:
                closed = items.pop()
            if not items and (closed is None or closed[1] != line["mark"]):
                top += 1
            items.append((line["content"], line["mark"], top))
            block = ["item", top, len(items), line["mark"] in ".)", None, start, 1]
            continue
        if items:
            inside = line["indent"] >= items[0][0]
            if block and not inside and kind in ("text", "bars", "item"):  # a lazy line
                block[6] += 1
                continue
            if inside:
                while line["indent"] < items[-1][0]:
                    items.pop()
                if kind == "fence":
                    if block:
                        yield block
                    block = None
                    while at < len(found) and not (found[at]["kind"] == "fence" and found[at]["mark"] == line["mark"][:1] and found[at]["n"] >= line["n"]):
                        at += 1
                    at += 1
                elif block and kind in ("text", "bars", "delimiter", "under"):
                    block[6] += 1
                elif kind == "text":
                    block = ["more", items[-1][2], len(items), items[-1][1] in ".)", None, start, 1]
                else:
                    if block:
                        yield block
                    block = None
                continue
            if block:
                yield block
            items, block = [], None
        if kind == "quote":
            if not block or block[0] != "quote":
                if block:
                    yield block
                block = None
                if start == 0 or found[start - 1]["kind"] != "quote":
                    top += 1
            if line["mark"] == "text":
                if block:
                    block[6] += 1
                else:
                    block = ["quote", top, 1, None, None, start, 1]
            else:
                if block:
                    yield block
                block = None
            continue
        if kind == "under" and block and block[0] == "paragraph":
            block[0], block[4] = "heading", 1 if line["mark"] == "=" else 2
            yield block
            block = None
            continue
        end = _table_end(found, start)
        if kind == "math" and start >= last_math or kind == "under" and not line["n"] or kind in ("bars", "delimiter") and end == start or kind == "item":
            kind = "text"
        if kind == "text":
            if block:
                block[6] += 1
                continue
            top += 1
            if line["indent"] >= 4:
                last = start
                while at < len(found) and (found[at]["indent"] >= 4 or found[at]["kind"] == "blank"):
                    last = at if found[at]["kind"] != "blank" else last
                    at += 1
                at = last + 1
                yield ["code", top, 0, None, 4, start, at - start]
            else:
                block = ["paragraph", top, 0, None, None, start, 1]
            continue
        if block:
            yield block
        block, top = None, top + 1
        if kind == "fence":
            while at < len(found) and not (found[at]["kind"] == "fence" and found[at]["mark"] == line["mark"][:1] and found[at]["n"] >= line["n"]):
                at += 1
            yield ["code", top, 0, None, 0, start + 1, at - start - 1]
            at += 1
        elif kind == "math":
            while found[at]["kind"] != "math":
                at += 1
            yield ["math", top, 0, None, None, start + 1, at - start - 1]
            at += 1
        elif kind == "bars":
            yield ["row", top, 0, None, 1, start, 1]
            for k in range(start + 2, end):
                yield ["row", top, 0, None, 0, k, 1]
            at = end
        else:
            yield ["rule" if kind == "under" else kind, top, 0, None, None, start, 1]
    if block:
        yield block


def _ranges_of(found: list) -> list[dict]:
    names = ("kind", "top", "depth", "ordered", "level", "first", "n")
    return [dict(zip(names, b, strict=True)) for b in _ranges(found)]


def ranges(found: Column) -> Column:
    """The line ranges of each document's blocks."""
    return each(_ranges_of, RANGES)(found)


def _tokens(text: Column, marks: dict[str, str], deeper: dict[str, str]) -> Column:
    pattern = "|".join(marks.values())
    plain, found = F.split(text, pattern), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    none = F.array().cast("array<string>")

    def run(t: Column, own: Column) -> Column:
        return F.array(F.struct(t.alias("text"), own.alias("marks")))

    def under(own: Column) -> Callable[[Column], Column]:
        return lambda r: F.struct(r["text"].alias("text"), F.array_union(own, r["marks"]).alias("marks"))

    def marked(token: Column) -> Column:
        out = run(token, none)
        for mark, p in reversed(marks.items()):
            width = 2 if mark in ("bold", "strike") else 1
            inner = F.substring(token, F.lit(width + 1), F.length(token) - 2 * width)
            own = F.array(F.lit(mark))
            if mark == "link":
                inner, own = F.regexp_extract(token, r"^\[([^\[\]]*)\]", 1), none
            if mark in ("code", "math") or not deeper:
                got = run(F.trim(inner) if mark == "math" else inner, own)
            else:
                got = F.transform(_tokens(inner, deeper, {}), under(own))
            out = F.when(token.rlike(f"^(?:{p})$"), got).otherwise(out)
        return out

    # splits at matches: one more part between them than there are tokens
    pairs = F.transform(plain, lambda t, k: F.concat(run(t, none), F.when(k < F.size(found), marked(F.get(found, k))).otherwise(F.array().cast(f"array<{RUN}>"))))
    return F.filter(F.flatten(pairs), lambda r: r["text"] != "")


def runs(text: Column) -> Column:
    """Inline text as (text, marks) runs."""
    whole = F.filter(F.array(F.struct(text.alias("text"), F.array().cast("array<string>").alias("marks"))), lambda r: r["text"] != "")
    return F.when(text.rlike(r"[`*~$\[]"), _tokens(text, TOKENS, TOKENS)).otherwise(whole)


def joined(content: Column) -> Column:
    """The lines of a paragraph: a space between them, or a line end behind two spaces or a backslash."""
    hard = F.transform(content, lambda t: F.when(t.rlike(r"(?: {2,}|\\)$"), F.concat(F.trim(F.regexp_replace(t, r"\\$", "")), F.lit("\n"))).otherwise(F.concat(F.trim(t), F.lit(" "))))
    return F.regexp_replace(F.array_join(hard, ""), r"\\?\s+$", "")


def content_of(kind: Column, text: Column, number: Column) -> Column:
    """A line without the marks of its block; number: its place in the block."""
    first = number == 0
    head = F.regexp_replace(F.regexp_replace(text, r"^ {0,3}#{1,6}(?: +|$)", ""), r"(?:^| +)#+ *$", "")
    return (
        F.when(kind == "quote", F.regexp_replace(text, r"^ {0,3}> ?", ""))
        .when((kind == "item") & first, F.regexp_replace(text, ITEM, ""))
        .when((kind == "heading") & text.rlike(r"^ {0,3}#"), head)
        .when(kind == "code", text)
        .otherwise(text)
    )


def markdown_blocks(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Block rows of Markdown texts; a null or blank text has none, key may be shared or null."""
    # exploded, so that what the text is made of is made once, not for each use of its lines
    found = texts.select(F.col(f"`{key}`").alias("key"), F.explode(F.array(lines(F.col(f"`{text}`")))).alias("lines"))
    found = found.withColumn("ranges", ranges(F.transform("lines", classified)))
    at = lambda b: F.slice("lines", b["first"] + 1, b["n"])
    whole = F.transform("ranges", lambda b: F.struct(b.alias("b"), at(b).alias("own")))
    marks = lambda line: F.length(F.regexp_extract(line, r"^ {0,3}(#{1,6})", 1))
    led = F.coalesce((F.get("ranges", F.lit(0))["kind"] == "heading") & (F.coalesce(F.get("ranges", F.lit(0))["level"], marks(F.get("lines", F.get("ranges", F.lit(0))["first"]))) == 1), F.lit(False))
    rows = found.select("key", led.alias("led"), F.posexplode(whole).alias("place", "x")).select("key", "place", "x.b", "x.own", (F.col("led") & (F.col("place") == 0)).alias("title"), F.col("led").cast("int").alias("up"))
    level = F.least(F.lit(3), F.greatest(F.lit(1), F.coalesce("b.level", marks(F.element_at("own", 1))) - F.col("up")))
    rows = rows.select("key", "place", "title", "b.kind", "b.top", "b.depth", "b.ordered", F.when(F.col("title"), None).when(F.col("b.kind") == "heading", level).when(F.col("b.kind") == "row", F.col("b.level")).alias("level"), F.col("b.level").alias("cut"), "own")
    stripped = F.transform("own", lambda t, k: content_of(F.col("kind"), t, k))
    code = F.array_join(F.transform("own", lambda t: F.when(F.col("cut") == 4, F.regexp_replace(t, r"^(?: {4}|\t)", "")).otherwise(t)), "\n")
    body = F.when(F.col("kind") == "code", F.regexp_replace(code, "\n+$", "")).when(F.col("kind") == "math", F.trim(F.array_join("own", "\n"))).when(F.col("kind").isin("rule", "row"), F.lit("")).otherwise(joined(stripped))
    rows = rows.withColumn("body", body)
    # a paragraph's images are blocks of their own, text around them others
    images = F.regexp_extract_all("body", F.lit(f"({IMAGE})"), F.lit(1))
    around = F.split("body", IMAGE)
    part = lambda kind, t, src: F.struct(F.lit(kind).alias("kind"), t.alias("text"), src.alias("src"))
    none = F.lit(None).cast("string")
    figure = lambda m: part("figure", F.regexp_extract(m, r"^!\[([^\[\]]*)\]", 1), F.regexp_extract(m, r"\(\s*([^()\s]*)", 1))
    cut = F.flatten(F.transform(around, lambda t, k: F.concat(F.array(part("paragraph", F.trim(t), none)), F.when(k < F.size(images), F.array(figure(F.get(images, k)))).otherwise(F.array().cast("array<struct<kind:string,text:string,src:string>>")))))
    split = F.when((F.col("kind") == "paragraph") & F.col("body").rlike(IMAGE), F.filter(cut, lambda p: (p["kind"] == "figure") | (p["text"] != ""))).otherwise(F.array(F.struct("kind", F.col("body").alias("text"), none.alias("src"))))
    spoken = lambda p: p["kind"].isin("heading", "paragraph", "item", "more", "quote")
    parsed = F.transform(split, lambda p: F.struct(p["kind"].alias("kind"), p["text"].alias("text"), p["src"].alias("src"), F.when(spoken(p), runs(p["text"])).alias("runs")))
    rows = rows.select("key", "place", "title", "top", "depth", "level", "ordered", F.element_at("own", 1).alias("line"), F.posexplode(parsed).alias("part", "p")).withColumn("runs", F.col("p.runs"))
    plain = F.array_join(F.transform("runs", lambda r: r["text"]), "")
    row_cells = F.transform(cells(F.col("line")), lambda c: F.array_join(F.transform(runs(c), lambda r: r["text"]), ""))
    return rows.select(
        F.col("key").alias(key),
        "place",
        "part",
        "top",
        "depth",
        F.when(F.col("title"), "title").otherwise(F.col("p.kind")).alias("kind"),
        "level",
        "ordered",
        F.coalesce(plain, F.col("p.text")).alias("text"),
        "runs",
        F.when(F.col("p.kind") == "row", row_cells).alias("cells"),
        F.col("p.src").alias("src"),
    )
