"""Text functions (X) on characters, headings, chats and outlines, as column expressions and frames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Half-width marks and what stands for them in full width, and the marks that no space goes before.
FULL_WIDTH = {",": "，", ";": "；", ":": "：", "!": "！", "?": "？", "(": "（", ")": "）"}
CLOSING = "，。、；：！？）」』】"
#: Ideographs with extension A; number in front of a heading; marks that no space is put beside.
IDEOGRAPH = "[\u3400-\u4dbf\u4e00-\u9fff]"
HEADING_NUMBER = r"^\s*[（(]?\s*(?:\d+(?:\.\d+)*\.?|[一二三四五六七八九十百]+)\s*[)）、.．]?\s*"
NO_SPACE = "\u3400-\u4dbf\u4e00-\u9fff，。、；：！？（）「」『』《》〈〉【】"
CJK_DIGITS = ("〇", "一", "二", "三", "四", "五", "六", "七", "八", "九")
#: What a message says that means to change the rules it is answered by.
INJECTIONS = (
    r"ignore (all |the )?(previous|above|prior) (instructions?|prompts?|rules?)",
    r"forget (all |the )?(previous|above|prior)",
    r"you are (now |actually )?(a|an) ",
    r"new (instructions?|system prompt|rules?)",
    r"system\s*[:：]",
    r"act as (a|an) ",
    r"pretend (to be|you are)",
    r"<\s*system\s*>",
    r"</?\s*(instructions?|system|prompt)\s*>",
)
MESSAGE_LIMIT = 2000

ISSUE = "at long, end long, type string, original string, replacement string"


KINDS = ("half", "spacing", "space")


def lint(texts: DataFrame, key: str, text: str, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(key, at, end, type, original, replacement), places from 0: half-width marks beside an ideograph, ideographs
    beside Latin letters, and spaces before closing full-width marks.

    Characters are looked at in one array for each text, of which only those at fault become rows. kinds: the types asked
    for; nothing is done for others, and spaces alone need no characters.
    """
    full = F.create_map(*(F.lit(x) for pair in FULL_WIDTH.items() for x in pair))
    ideograph = lambda c: F.coalesce(c.rlike(IDEOGRAPH), F.lit(False))
    latin = lambda c: F.coalesce(c.rlike("[A-Za-z]"), F.lit(False))
    issue = lambda i, n, kind, original, new: F.struct(i.cast("long").alias("at"), (i + n).cast("long").alias("end"), F.lit(kind).alias("type"), original.alias("original"), new.alias("replacement"))

    def at(c: Column, i: Column) -> Column:
        before, after = F.when(i > 0, F.get("_chars", i - 1)), F.get("_chars", i + 1)
        half = F.when(F.try_element_at(full, c).isNotNull() & (ideograph(before) | ideograph(after)), issue(i, 1, "half", c, F.try_element_at(full, c)))
        pair = F.when((ideograph(c) & latin(after)) | (latin(c) & ideograph(after)), issue(i, 2, "spacing", F.concat(c, after), F.concat(c, F.lit(" "), after)))
        return F.coalesce(*(x for kind, x in (("half", half), ("spacing", pair)) if kind in kinds))  # a mark is neither letter nor ideograph: never both

    run = f" +(?=[{CLOSING}])"
    pieces = F.arrays_zip(F.split(text, run).alias("piece"), F.regexp_extract_all(F.col(text), F.lit(run), F.lit(0)).alias("run"))
    runs = texts.where(F.col(text).rlike(f" [{CLOSING}]")).select(key, F.posexplode(pieces).alias("place", "p")).where("p.run is not null")
    size = F.char_length("p.run")
    end = F.sum(F.char_length("p.piece") + size).over(Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    spaces = runs.select(key, (end - size).alias("at"), end.alias("end"), F.lit("space").alias("type"), F.col("p.run").alias("original"), F.lit("").alias("replacement"))
    if set(kinds) == {"space"}:
        return spaces
    some = texts.where(F.col(text).rlike(IDEOGRAPH)).withColumn("_chars", F.split(text, ""))
    pairs = some.select(key, F.explode(F.filter(F.transform("_chars", at), lambda x: x.isNotNull())).alias("i")).select(key, "i.*")
    return pairs.unionByName(spaces) if "space" in kinds else pairs


def without_overlaps(issues: DataFrame, key: str) -> DataFrame:
    """Of each key's issues, by place and end, those that begin where the last kept one has ended.

    Which are kept depends on those before, so a key's issues are folded in one group; a key is one text.
    """

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at", "end", "type"])
        end, kept = -1, []
        for a, b in zip(rows["at"], rows["end"], strict=True):
            kept.append(a >= end)
            end = b if kept[-1] else end
        return rows[kept]

    return issues.groupBy(key).applyInPandas(keep, issues.schema)


def joined_lines(lines: Column) -> Column:
    """Lines as one text: nothing between ideographs or full-width marks, nor behind a hyphen before a small letter.

    What goes before a line follows from it and the one before that is not empty, so that a text is put together once.
    """

    def led(a: Column, b: Column) -> Column:
        tight = (a == "") | (a.endswith("-") & b.rlike("^[a-z]")) | a.rlike(f"[{NO_SPACE}]$") | b.rlike(f"^[{NO_SPACE}]")
        return F.when(tight, b).otherwise(F.concat(F.lit(" "), b))

    some = F.filter(lines, lambda t: t != "")
    pieces = F.zip_with(F.concat(F.array(F.lit("")), some), some, led)  # the last has no line, and is null
    return F.when(~F.exists(lines, lambda t: t.isNull()), F.array_join(pieces, ""))


def without_gaps(text: Column) -> Column:
    """No spaces between ideographs or full-width marks, nor inside full-width brackets."""
    text = F.regexp_replace(text, rf"(?<=[{NO_SPACE}])[ \t]+(?=[{NO_SPACE}])", "")
    return F.regexp_replace(text, r"(?<=[（「『《〈【])[ \t]+|[ \t]+(?=[）」』》〉】])", "")


def without_number(heading: Column) -> Column:
    """A heading without the number in front, unless it has nothing else."""
    bare = F.regexp_replace(heading, HEADING_NUMBER, "")
    return F.when(bare == "", heading).otherwise(bare)


def injects(text: Column) -> Column:
    """X21."""
    return F.coalesce(text, F.lit("")).rlike("(?i)" + "|".join(INJECTIONS))


def message_error(messages: Column, limit: int = MESSAGE_LIMIT) -> Column:
    """The first that is wrong with an array of (role, content); null if nothing is."""
    last = F.try_element_at(messages, F.lit(-1))
    content = last["content"]
    stranger = F.filter(messages, lambda m: ~F.coalesce(m["role"].isin("user", "assistant"), F.lit(False)))
    return (
        F.when(F.size(messages) < 1, "messages cannot be empty")
        .when(~last["role"].eqNullSafe("user"), "last message must be from user")
        .when(content.isNull() | ~content.rlike(r"\S"), "user message is empty")
        .when(F.char_length(content) > limit, f"user message too long (max {limit} chars)")
        .when(F.size(stranger) > 0, F.concat(F.lit("invalid role: '"), F.coalesce(F.get(stranger, 0)["role"], F.lit("")), F.lit("'")))
        .when(F.exists(messages, lambda m: m["content"].isNull()), "all messages must have string content")
    )


def cjk_numeral(n: Column) -> Column:
    """1 to 99; other numbers as they are."""
    digit = lambda d: F.element_at(F.array(*map(F.lit, CJK_DIGITS)), (d + 1).cast("int"))
    tens, ones = F.floor(n / 10), n % 10
    rest = F.when(ones > 0, digit(ones)).otherwise("")
    return F.when((n < 1) | (n > 99), n.cast("string")).when(n < 10, digit(n)).when(n < 20, F.concat(F.lit("十"), rest)).otherwise(F.concat(digit(tens), F.lit("十"), rest))


def clean_outline(headings: Column, most: int = 30) -> Column:
    """Of an array of (level, text) the first that are not blank, trimmed, at level 1 to 3."""
    some = F.filter(headings, lambda h: F.coalesce(h["text"], F.lit("")).rlike(r"\S"))
    level = lambda h: F.least(F.lit(3), F.greatest(F.lit(1), F.coalesce(h["level"].try_cast("int"), F.lit(1))))
    return F.slice(F.transform(some, lambda h: F.struct(level(h).alias("level"), F.trim(h["text"]).alias("text"))), 1, most)


def preset(instruction: Column, presets: dict[str, str]) -> Column:
    """What a preset's name stands for, or the instruction itself."""
    key = F.trim(instruction)
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in presets.items() for x in pair)), key), key)


def occurrences(text: Column, needle: Column, fold: bool = False) -> Column:
    """How often needle stands in text, without overlap; 0 for an empty one."""
    text, needle = (F.lower(text), F.lower(needle)) if fold else (text, needle)
    n = (F.char_length(text) - F.char_length(F.replace(text, needle, F.lit("")))) / F.char_length(needle)
    return F.when(F.char_length(needle) > 0, n.cast("long")).otherwise(F.lit(0).cast("long"))


def matches(texts: DataFrame, key: str, text: str, needle: Column, fold: bool = False) -> DataFrame:
    """(key, from, to) of every place where needle stands in a text, from its beginning on without overlap; places
    from 0. Texts are split at the needle, and lengths added up, so that a text is read once. An empty needle stands
    nowhere; a null text or needle has no places."""
    text_, needle = (F.lower(F.col(text)), F.lower(needle)) if fold else (F.col(text), needle)
    own = texts.select(key, text_.alias("_text"), needle.alias("_needle")).where(F.col("_needle") != "")
    pieces = F.split("_text", F.concat(F.lit("\\Q"), "_needle", F.lit("\\E")))
    rows = own.select(key, F.char_length("_needle").alias("n"), F.posexplode(F.slice(pieces, F.lit(1), F.size(pieces) - 1)).alias("_k", "_piece"))
    to = F.sum(F.char_length("_piece") + F.col("n")).over(Window.partitionBy(key).orderBy("_k").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(key, (to - F.col("n")).alias("from"), to.alias("to"))


def claim(before: Column) -> Column:
    """The last sentence of what stands before a citation, else all of it."""
    parts = F.filter(F.split(before, r"(?<=[。．.!?！？])\s*"), lambda s: F.trim(s) != "")
    return F.trim(F.coalesce(F.try_element_at(parts, F.lit(-1)), before))


def latex_uncommented(text: Column) -> Column:
    """every line up to its first % that no escape stands before."""
    return F.regexp_replace(text, r"(?<!\\)((?:\\\\)*)%[^\n]*", "$1")


def tabular_rows(body: Column) -> Column:
    """array<array<string>>: rows between double backslashes, cells between ampersands, rules dropped."""
    bare = F.regexp_replace(body, r"\\(hline|toprule|midrule|bottomrule|cline\{[^}]*\})", "")
    rows = F.filter(F.split(bare, r"\\\\"), lambda r: F.trim(r) != "")
    return F.transform(rows, lambda r: F.transform(F.split(r, "&"), lambda c: F.trim(c)))


def marked(text: Column, code: Column, strike: Column, italic: Column, bold: Column) -> Column:
    """marks of Markdown from the inside out: code, strike, italic, bold."""
    for on, mark in ((code, "`"), (strike, "~~"), (italic, "*"), (bold, "**")):
        text = F.when(on, F.concat(F.lit(mark), text, F.lit(mark))).otherwise(text)
    return text
