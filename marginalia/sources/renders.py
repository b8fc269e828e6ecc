"""block rows, as the readers give them, to one text for each document.

Each row becomes a line by column expressions; what it takes from its neighbours, a list's numbers, a table's width,
where a block begins and ends, comes from windows over its document; one aggregate then puts the lines in order. Runs that
bear the mark cite hold a reference's key: references are numbered as they are first cited, and those that are known are
listed at the end.

As in the editor that these forms come from, further levels of lists are left out, so are quotations and rules in plain
text, and forced line ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import html_escaped

UNTITLED = "(untitled)"
#: Rows of these kinds share a block with their neighbours of one top.
SHARED = ("item", "more", "quote", "row", "caption")
FORMS = ("markdown", "text", "html")


def _has(run: Column, mark: str) -> Column:
    return F.array_contains(run["marks"], mark)


def _run(run: Column, form: str, labels: Column) -> Column:
    text = F.replace(run["text"], F.lit("\n"), F.lit(""))
    escaped = html_escaped(text) if form == "html" else text
    said = F.when(_has(run, "cite"), F.coalesce(F.try_element_at(labels, run["text"]), F.lit("")))
    said = html_escaped(said) if form == "html" else said
    marked = escaped
    wraps = {"markdown": {"code": ("`", "`"), "strike": ("~~", "~~"), "italic": ("*", "*"), "bold": ("**", "**")}, "text": {}, "html": {"code": ("<code>", "</code>"), "strike": ("<s>", "</s>"), "italic": ("<em>", "</em>"), "bold": ("<strong>", "</strong>")}}
    for mark, (before, after) in wraps[form].items():
        marked = F.when(_has(run, mark), F.concat(F.lit(before), marked, F.lit(after))).otherwise(marked)
    math = F.concat(F.lit("\\("), escaped, F.lit("\\)")) if form == "html" else F.concat(F.lit("$"), text, F.lit("$"))
    return F.when(_has(run, "cite"), said).when(_has(run, "math"), math).otherwise(marked)


def _lines(form: str, inline: Column) -> Column:
    """A row's line; n: an item's number, wide: a table's columns, first and last: in its block."""
    kind, text, first, last = F.col("kind"), F.coalesce("text", F.lit("")), F.col("first"), F.col("last")
    cat = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    cells = F.slice(F.concat(F.coalesce("cells", F.array().cast("array<string>")), F.array_repeat(F.lit(""), F.coalesce("wide", F.lit(1)))), F.lit(1), F.greatest(F.coalesce("wide", F.lit(1)), F.lit(1)))
    src = F.coalesce("src", F.lit(""))
    if form == "markdown":
        row = cat("| ", F.array_join(cells, " | "), " |")
        rule = cat("\n| ", F.array_join(F.array_repeat(F.lit("---"), F.coalesce("wide", F.lit(1))), " | "), " |")
        return (
            F.when(kind == "heading", cat(F.repeat(F.lit("#"), F.least(F.col("level") + 1, F.lit(6))), " ", inline))
            .when(kind == "item", cat(F.when(F.col("ordered"), cat(F.col("n").cast("string"), ". ")).otherwise("- "), inline))
            .when(kind == "quote", cat("> ", inline))
            .when(kind == "code", cat("```\n", text, "\n```"))
            .when(kind == "rule", "---")
            .when(kind == "figure", cat("![", text, "](", src, ")", F.when(text != "", cat("\n*", text, "*")).otherwise("")))
            .when(kind == "math", cat("$$\n", text, "\n$$"))
            .when(kind == "caption", cat("**", text, "**"))
            .when(kind == "row", F.when(F.col("level") == 1, cat(row, rule)).otherwise(row))
            .otherwise(inline)
        )
    if form == "text":
        return (
            F.when(kind == "item", cat(F.when(F.col("ordered"), cat(F.col("n").cast("string"), ". ")).otherwise("- "), inline))
            .when(kind == "code", text)
            .when(kind.isin("rule", "quote"), "")
            .when(kind == "figure", F.when(text != "", cat("[圖: ", text, "]")).otherwise("[image]"))
            .when(kind == "math", cat("$", text, "$"))
            .when(kind == "caption", text)
            .when(kind == "row", F.array_join(F.coalesce("cells", F.array().cast("array<string>")), "\t"))
            .otherwise(inline)
        )
    e = html_escaped(text)
    level = F.least(F.col("level") + 1, F.lit(4)).cast("string")
    cell = F.transform(F.coalesce("cells", F.array().cast("array<string>")), lambda c: cat("<td>", html_escaped(c), "</td>"))
    when = lambda condition, said: F.when(condition, said).otherwise("")
    return (
        F.when(kind == "heading", cat("<h", level, ">", inline, "</h", level, ">"))
        .when(kind.isin("item", "more"), cat(when(first, cat("<", F.col("tag"), ">")), when(kind == "item", "<li>"), inline, when(F.col("closes"), "</li>"), when(last, cat("</", F.col("tag"), ">"))))
        .when(kind == "quote", cat(when(first, "<blockquote>"), "<p>", inline, "</p>", when(last, "</blockquote>")))
        .when(kind == "code", cat("<pre><code>", e, "</code></pre>"))
        .when(kind == "rule", "<hr>")
        .when(kind == "figure", cat('<figure><img src="', html_escaped(src), '" alt="', e, '">', when(text != "", cat("<figcaption>", e, "</figcaption>")), "</figure>"))
        .when(kind == "math", cat("<p>\\[", e, "\\]</p>"))
        .when(kind == "caption", cat("<table><caption>", e, "</caption>", when(last, "</table>")))
        .when(kind == "row", cat(when(first, "<table>"), "<tr>", F.array_join(cell, ""), "</tr>", when(last, "</table>")))
        .otherwise(cat("<p>", inline, "</p>"))
    )


def rendered(blocks: DataFrame, titles: DataFrame, key: str, form: str, references: DataFrame | None = None, heading: str = "References") -> DataFrame:
    """(key, text) of titles (key, title) with their blocks; a null or empty title is UNTITLED. Where titles have keys alone,
    a document's title is that of its blocks, which are then read once for both.

    references: (key, cited, label, full) of the works that a document knows, label as its text has it, full as its list
    does, with {n} in place of the work's number. Keys that none is known for are left out of the text and the list.
    """
    if form not in FORMS:
        raise ValueError(f"unknown form: {form}")
    own = Window.partitionBy(key).orderBy("place", "part")
    entitled = "title" not in titles.columns
    shown = "not (kind in ('item', 'more') and depth > 1)"
    rows = blocks.where(shown if entitled else f"kind <> 'title' and {shown}")
    none = F.array().cast("array<struct<text:string,marks:array<string>>>")
    labels = F.lit(None).cast("map<string,string>")
    if references is not None:
        cited = rows.select(key, "place", "part", F.posexplode(F.coalesce("runs", none)).alias("_at", "r")).where(F.array_contains("r.marks", "cite"))
        firsts = cited.groupBy(key, F.col("r.text").alias("cited")).agg(F.min(F.struct("place", "part", "_at")).alias("first"))
        numbered = firsts.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("first")))
        known = numbered.join(references, [key, "cited"]).withColumns({c: F.replace(c, F.lit("{n}"), F.col("n").cast("string")) for c in ("label", "full")})
        lists = known.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("cited", "label"))).alias("_labels"), F.sort_array(F.collect_list(F.struct("n", "full"))).alias("_list"))
        rows, labels = rows.join(lists.select(key, "_labels"), key, "left"), F.col("_labels")
    top, kind = F.col("top"), F.col("kind")
    again = F.coalesce((F.lag("top").over(own) == top) & F.lag("kind").over(own).isin(*SHARED) & kind.isin(*SHARED), F.lit(False))
    goes_on = F.coalesce((F.lead("top").over(own) == top) & F.lead("kind").over(own).isin(*SHARED) & kind.isin(*SHARED), F.lit(False))
    group = Window.partitionBy(key, "top")
    rows = rows.withColumns(
        {
            "first": ~again,
            "last": ~goes_on,
            "closes": ~(goes_on & (F.lead("kind").over(own) == "more")),
            "n": F.sum((kind == "item").cast("int")).over(group.orderBy("place", "part")),
            "wide": F.max(F.size("cells")).over(group),
            "tag": F.first(F.when(F.col("ordered"), "ol").otherwise("ul")).over(group.orderBy("place", "part")),
        }
    )
    inline = F.array_join(F.transform(F.coalesce("runs", none), lambda r: _run(r, form, labels)), "")
    gap = F.lit("") if form == "html" else F.when(F.col("first"), "\n\n").when(kind == "more", "").otherwise("\n")
    line = F.struct("place", "part", gap.alias("gap"), _lines(form, inline).alias("line"))
    lines = rows.select(key, F.when(kind != "title", line).alias("l"), F.when(kind == "title", F.col("text")).alias("title"))
    body = lines.groupBy(key).agg(F.sort_array(F.collect_list("l")).alias("l"), *([F.max("title").alias("title")] if entitled else []))
    whole = titles.join(body, key, "left")
    title = F.coalesce(F.nullif("title", F.lit("")), F.lit(UNTITLED))
    text = F.coalesce(F.array_join(F.transform("l", lambda x: F.concat(x["gap"], x["line"])), ""), F.lit(""))
    if references is not None:
        whole = whole.join(lists.select(key, "_list"), key, "left")
        listed = lambda line, sep: F.array_join(F.transform("_list", line), sep)
        if form == "markdown":
            tail = F.concat(F.lit(f"\n\n## {heading}\n\n"), listed(lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c["full"]), "\n"))
        elif form == "text":
            tail = F.concat(F.lit(f"\n\n{heading}\n"), listed(lambda c: F.concat(F.lit("["), c["n"].cast("string"), F.lit("] "), c["full"]), "\n"))
        else:
            tail = F.concat(F.lit("<h2>"), html_escaped(F.lit(heading)), F.lit('</h2><ol class="refs">'), listed(lambda c: F.concat(F.lit('<li value="'), c["n"].cast("string"), F.lit('">'), html_escaped(c["full"]), F.lit("</li>")), ""), F.lit("</ol>"))
        text = F.concat(text, F.coalesce(tail, F.lit("")))
    if form == "html":
        return whole.select(key, F.concat(F.lit("<h1>"), html_escaped(title), F.lit("</h1>"), text).alias("text"))
    head = F.concat(F.lit("# "), title) if form == "markdown" else title
    return whole.select(key, F.concat(F.regexp_replace(F.concat(head, text), r"^\s+|\s+$", ""), F.lit("\n")).alias("text"))


def outline(blocks: DataFrame, key: str) -> DataFrame:
    """(key, place, level, text) of headings that have text, but for those of directories."""
    from ..operators.repairs import directory_of

    return blocks.where("kind = 'heading' and trim(text) <> ''").where(directory_of(F.col("text")).isNull()).select(key, "place", "level", "text")


def previews(blocks: DataFrame, key: str) -> DataFrame:
    """(key, text): the text of all blocks of any depth, a line end behind headings, paragraphs and list items."""
    flat = F.coalesce(F.array_join("cells", ""), "text", F.lit(""))
    ends = F.when(F.col("kind").isin("heading", "paragraph", "item", "more", "quote"), "\n").otherwise("")
    lines = blocks.where("kind <> 'title'").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("place", "part", F.concat(flat, ends).alias("t")))).alias("l"))
    return lines.select(key, F.array_join(F.transform("l", lambda x: x["t"]), "").alias("text"))
