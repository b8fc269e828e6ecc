"""Lines, sections and chunks of texts (S02, S06, S12, S13, X01, X02, X05, X15, X38), and numbers of headings and captions.

Texts are known by a key; what follows from a text's own order is windowed or folded within that key, so that one
shuffle by key, or none, serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a heading line begins with, a number before it, by section in order.
NUMBER = r"(?:[（(]?\s*(?:\d+(?:\.\d+)*\.?|[一二三四五六七八九十百]+)\s*[)）、.．]?\s*)?"
HEADINGS = {
    "Abstract": "摘要|abstract",
    "Introduction": "introduction|引言|緒論|前言",
    "Method": "method(?:s|ology)?|方法|研究方法",
    "Experiment": "experiments?|實驗",
    "Results": "results?|結果",
    "Discussion": "discussion|討論|分析",
    "Conclusion": "conclusions?|結論|總結",
}
FIRST, NONE = "Abstract", "Other"
#: Characters between which lines are joined without a space.
IDEOGRAPHS = "㐀-鿿豈-﫿"


def lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, at, text): lines that are not blank, with their end mark, and where they begin in the text."""
    every = texts.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit("[^\n]*\n|[^\n]+"), F.lit(0))).alias("line", "text"))
    own = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.char_length("text")).over(own), F.lit(0)).cast("long")
    return every.withColumn("at", at).where(F.col("text").rlike(r"\S")).select(key, "line", "at", "text")


def heading(line: Column) -> Column:
    """The section that a line is the heading of; null for other lines."""
    found = F.lit(None).cast("string")
    for name, words in reversed(HEADINGS.items()):
        number = "" if name == "Abstract" else NUMBER
        found = F.when(line.rlike(rf"(?i)^\s*{number}(?:{words})(?![\p{{L}}\p{{N}}_])"), name).otherwise(found)
    return found


def sections(spans: DataFrame, key: str) -> DataFrame:
    """Spans (key, line, text, ...) with their section and its place among the sections as they first appear.

    What stands before the first heading is the abstract; a text without a heading is one section. Sections of one name
    are one. By lines, not by places in joined text.
    """
    own = Window.partitionBy(key).orderBy("line")
    whole = Window.partitionBy(key)
    marked = spans.withColumn("_heading", heading(F.col("text")))
    some = F.max(F.col("_heading").isNotNull()).over(whole)
    section = F.when(~some, NONE).otherwise(F.coalesce(F.last("_heading", ignorenulls=True).over(own), F.lit(FIRST)))
    named = marked.withColumn("section", section).drop("_heading")
    first = F.min("line").over(Window.partitionBy(key, "section"))
    return named.withColumn("_first", first).withColumn("section_place", (F.dense_rank().over(whole.orderBy("_first")) - 1).cast("long")).drop("_first")


def chunks(spans: DataFrame, keys: list[str], order: str, text: str, most: int) -> DataFrame:
    """Spans with the number of their chunk: consecutive ones up to ``most`` characters; a longer one is alone.

    Where a chunk ends depends on where it began: the lengths of a group are folded, which keeps a place for each chunk.
    """
    rows = spans.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, F.char_length(text).alias("_n")))).alias("_spans"))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("cuts"))

    def step(acc: Column, span: Column) -> Column:
        cut = (acc["n"] > 0) & (acc["n"] + span["_n"] > most)
        return F.struct((acc["at"] + 1).alias("at"), F.when(cut, span["_n"]).otherwise(acc["n"] + span["_n"]).alias("n"), F.when(cut, F.concat(acc["cuts"], F.array(acc["at"]))).otherwise(acc["cuts"]).alias("cuts"))

    cuts = rows.withColumn("_cuts", F.aggregate("_spans", start, step, lambda a: a["cuts"]))
    numbered = cuts.select(*keys, "_cuts", F.posexplode("_spans").alias("_at", "_span"))
    return numbered.select(*keys, F.col("_span")[order].alias(order), F.size(F.filter("_cuts", lambda c: c <= F.col("_at"))).alias("chunk"))


def halves(spans: DataFrame, keys: list[str], order: str, text: str, most: int) -> DataFrame:
    """Spans with the part they fall into when a group over ``most`` characters is cut in two by number of spans, and
    its parts again, until each fits or is one span. Lengths of a group are one row, whose bounds are cut in as many rounds
    as their number has bits: no window and no sort for each round."""
    rows = spans.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, F.coalesce(F.char_length(text), F.lit(0)).alias("_n")))).alias("_spans"))
    bounds = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))

    def cut(part: Column) -> Column:
        lo, hi = part["lo"], part["hi"]
        total = F.aggregate(F.slice("_spans", lo + 1, hi - lo), F.lit(0).cast("long"), lambda s, v: s + v["_n"])
        middle = F.floor((lo + hi) / 2)
        return F.when((hi - lo > 1) & (total > most), F.array(bounds(lo, middle), bounds(middle, hi))).otherwise(F.array(part))

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size("_spans"))).cast("int"))
    parts = F.aggregate(rounds, F.array(bounds(F.lit(0), F.size("_spans"))), lambda acc, _: F.flatten(F.transform(acc, cut)))
    placed = lambda p: F.transform(F.slice("_spans", p["lo"] + 1, p["hi"] - p["lo"]), lambda v: F.struct(v[order].alias("at"), p["lo"].cast("long").alias("part")))
    own = rows.select(*keys, F.explode_outer(F.flatten(F.transform(parts, placed))).alias("_span"))
    return own.select(*keys, F.col("_span.at").alias(order), F.col("_span.part").alias("part"))


def indexed(units: DataFrame, key: str, section: str, order: str) -> DataFrame:
    """Units with their number within the section, from 0, and the id made of it."""
    number = (F.row_number().over(Window.partitionBy(key, section).orderBy(order)) - 1).cast("long")
    return units.withColumn("ord", number).withColumn("edu_id", F.concat_ws(":", key, section, F.lit("edu"), "ord"))


def paragraphs(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place, text): what blank lines part, blocks without a letter or mark left out."""
    parts = F.filter(F.transform(F.split(text, r"\n[ \t]*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    return texts.select(key, F.posexplode(parts).alias("place", "text"))


def scanned_paragraphs(boxes: DataFrame, key: str) -> DataFrame:
    """Boxes (key, page, y, height, text) of lines to (key, paragraph, text): a new one on a new page, and where the
    gap to the line before is over 0.8 of its height, 1 at least; no space goes between ideographs, and
    blank paragraphs are left out."""
    own = Window.partitionBy(key).orderBy("page", "y")
    height = F.greatest(F.lag("height").over(own), F.lit(1))
    gap = F.col("y") - F.lag("y").over(own) - F.lag("height").over(own)
    new = F.coalesce((F.col("page") != F.lag("page").over(own)) | (gap > 0.8 * height), F.lit(False))
    numbered = boxes.withColumn("_new", new.cast("int")).withColumn("paragraph", F.sum("_new").over(own))
    lines = F.filter(F.transform(F.sort_array(F.collect_list(F.struct("page", "y", "text"))), lambda b: F.trim(b["text"])), lambda t: t != "")
    rows = numbered.groupBy(key, "paragraph").agg(lines.alias("_lines"))
    tight = lambda a, b: a.rlike(f"[{IDEOGRAPHS}]$") & b.rlike(f"^[{IDEOGRAPHS}]")
    spaced = F.transform("_lines", lambda t, k: F.when((k == 0) | tight(F.get("_lines", k - 1), t), t).otherwise(F.concat(F.lit(" "), t)))
    return rows.select(key, "paragraph", F.array_join(spaced, "").alias("text")).where("text <> ''")


def needs_scan(text: Column, garbled: Column) -> Column:
    """Whether a text has under 100 characters or is garbled."""
    return (F.char_length(F.trim(F.coalesce(text, F.lit("")))) < 100) | F.coalesce(garbled, F.lit(False))


def outline_sections(blocks: DataFrame, key: str) -> DataFrame:
    """Blocks (key, place, level, text), level null but for headings, to (key, section, text): each heading of level 1
    or 2 opens one; blank blocks are left out, so are empty sections. Texts are whole: a limit of what reads them is its own."""
    own = Window.partitionBy(key).orderBy("place")
    numbered = blocks.withColumn("section", F.sum(F.coalesce((F.col("level") <= 2).cast("int"), F.lit(0))).over(own)).where(F.coalesce("text", F.lit("")).rlike(r"\S"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda b: b["text"])
    joined = numbered.groupBy(key, "section").agg(F.array_join(parts, "\n").alias("text"))
    return joined.select(key, "section", F.trim("text").alias("text")).where("text <> ''")


def chapter_counts(blocks: DataFrame, key: str) -> DataFrame:
    """(key, chapter, title, chars): characters but white space by chapter, which a heading of level 1 opens and is
    counted in; chapter 0, before the first, only where it has some."""
    own = Window.partitionBy(key).orderBy("place")
    opens = F.coalesce(F.col("level") == 1, F.lit(False))
    numbered = blocks.withColumn("chapter", F.sum(opens.cast("int")).over(own))
    title = F.max(F.when(opens, F.col("text")))
    counts = numbered.groupBy(key, "chapter").agg(title.alias("title"), F.sum(F.char_length(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", ""))).alias("chars"))
    return counts.where("chapter > 0 or chars > 0")


def heading_numbers(blocks: DataFrame, key: str, unnumbered: tuple[str, ...] = ()) -> DataFrame:
    """Headings (key, place, level, text, number): chapters are counted but for titles that have no number; the
    counts of levels 2 and 3 begin anew below each counted heading above them."""
    own = Window.partitionBy(key).orderBy("place")
    heads = blocks.where("level between 1 and 3")
    counted = (F.col("level") == 1) & ~F.trim("text").isin(*unnumbered) if unnumbered else F.col("level") == 1
    heads = heads.withColumn("_one", F.sum(F.coalesce(counted, F.lit(False)).cast("int")).over(own))
    heads = heads.withColumn("_two", F.sum((F.col("level") == 2).cast("int")).over(Window.partitionBy(key, "_one").orderBy("place")))
    heads = heads.withColumn("_three", F.sum((F.col("level") == 3).cast("int")).over(Window.partitionBy(key, "_one", "_two").orderBy("place")))
    number = F.when(F.col("level") == 1, F.when(F.coalesce(counted, F.lit(False)), F.col("_one").cast("string"))).when(F.col("level") == 2, F.concat_ws(".", "_one", "_two")).otherwise(F.concat_ws(".", "_one", "_two", "_three"))
    return heads.select(key, "place", "level", "text", number.alias("number"))


def caption_numbers(blocks: DataFrame, key: str) -> DataFrame:
    """Captioned blocks (key, place, kind, number): counted by kind within their chapter as chapter-number where
    the text has chapters, else within the text; those without a caption count for nothing."""
    own = Window.partitionBy(key).orderBy("place")
    placed = blocks.withColumn("_chapter", F.sum(F.coalesce(F.col("level") == 1, F.lit(False)).cast("int")).over(own)).withColumn("_chapters", F.max(F.coalesce(F.col("level") == 1, F.lit(False))).over(Window.partitionBy(key)))
    captioned = placed.where("kind is not null and trim(coalesce(caption, '')) <> ''")
    n = F.row_number().over(Window.partitionBy(key, "_chapter", "kind").orderBy("place"))
    return captioned.withColumn("_n", n).select(key, "place", "kind", F.when(F.col("_chapters"), F.concat_ws("-", "_chapter", "_n")).otherwise(F.col("_n").cast("string")).alias("number"))
