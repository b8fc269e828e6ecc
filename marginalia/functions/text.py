"""Text functions (X) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ideographs that a search for references tells languages by.
CJK = "[\u4e00-\u9fff]"
#: A DOI, and what may end a sentence with closing marks behind it.
DOI = r"10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+"
ENDS = "[。．.！？!?；;：:…][」』〉》）)\\]｝}＞>\"'\\s]*$"


def sentences(text: Column, least: int = 20, most: int = 400) -> Column:
    """Sentences of at least so many characters, at most so many of them, white space collapsed."""
    parts = F.regexp_extract_all(text, F.lit("(?s).+?[。．.!?！？\n]+|.+"), F.lit(0))
    clean = F.transform(parts, lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    return F.slice(F.filter(clean, lambda s: F.char_length(s) >= least), 1, most)


def char_count(text: Column) -> Column:
    """Characters that are not white space."""
    return F.char_length(F.regexp_replace(text, r"\s", ""))


def word_count(text: Column) -> Column:
    """Words between white space; 0 for a blank text."""
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))


def ends_sentence(text: Column) -> Column:
    """X18."""
    return text.rlike(ENDS)


def collapsed_repeats(text: Column) -> Column:
    """Sentences without those that stand earlier, white space aside; the last piece always stays, blank ones do.

    Repeats are neighbours among the sorted keys, so that a text takes time by its sentences' sort.
    """
    parts = F.regexp_extract_all(text, F.lit(r"((?s).*?[。．.！？!?\n]+|.+\z)"), F.lit(1))
    keys = F.array_sort(F.transform(parts, lambda s, i: F.struct(F.regexp_replace(s, r"\s", "").alias("key"), i.alias("at"))))
    # one struct holds both arrays, so that they are made once and not for each piece
    both = F.struct(parts.alias("parts"), keys.alias("keys"))

    def kept(z: Column) -> Column:
        repeats = F.transform(z["keys"], lambda x, j: F.when((j > 0) & (x["key"] != "") & (F.get(z["keys"], j - 1)["key"] == x["key"]) & (x["at"] < F.size(z["parts"]) - 1), x["at"]).otherwise(F.lit(-1)))
        return F.transform(F.array_except(F.sequence(F.lit(0), F.size(z["parts"]) - 1), repeats), lambda i: F.get(z["parts"], i))

    joined = F.get(F.transform(F.array(both), lambda z: F.array_join(F.when(F.size(z["parts"]) > 0, kept(z)).otherwise(z["parts"]), "")), 0)
    return joined


def markers(text: Column, kind: str) -> Column:
    """The ids that a text names as [KIND:id], sorted, once each."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(rf"\[{kind}:([^\]]+)\]"), F.lit(1))))


def doi(text: Column) -> Column:
    """The first DOI, without punctuation behind it; empty without one."""
    return F.regexp_replace(F.regexp_extract(text, DOI, 0), r"[.,);]+$", "")


def stripped_tags(text: Column) -> Column:
    """X25."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", " "), r"\s+", " "))


def host(url: Column) -> Column:
    """Lower-case, without www."""
    return F.regexp_replace(F.lower(F.parse_url(url, F.lit("HOST"))), r"^www\.", "")


def trusted(url: Column, hosts: tuple[str, ...]) -> Column:
    """Whether the host is one of hosts or below one."""
    own = host(url)
    return F.exists(F.array(*map(F.lit, hosts)), lambda h: (own == h) | F.endswith(own, F.concat(F.lit("."), h)))


def has_cjk(text: Column) -> Column:
    """X33."""
    return text.rlike(CJK)


#: The ranges that exports and imports tell by; the three are not one.
CJK_EXPORT = "[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]"
CJK_IMPORT = "[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]"


def has_cjk_export(text: Column) -> Column:
    """With kana and extension A."""
    return text.rlike(CJK_EXPORT)


def has_cjk_import(text: Column) -> Column:
    """With extension A and compatibility ideographs."""
    return text.rlike(CJK_IMPORT)


def garbled(text: Column) -> Column:
    """More than 3 % of the first 4000 characters are marks that a broken font leaves; never below 200 characters."""
    head = F.substring(text, 1, 4000)
    marks = F.char_length(F.regexp_replace(head, "[^`*~^|]", ""))
    return F.when(F.char_length(head) < 200, False).otherwise(marks * 100 > F.char_length(head) * 3)


def latex_escaped(text: Column) -> Column:
    """each character by itself, so that no escape is escaped again."""
    fixed = {"\\": r"\textbackslash{}", "{": r"\{", "}": r"\}", "$": r"\$", "&": r"\&", "#": r"\#", "_": r"\_", "%": r"\%", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}
    known = F.create_map(*(F.lit(x) for pair in fixed.items() for x in pair))
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(known, c), c)), "")


def html_escaped(text: Column) -> Column:
    """F12."""
    for raw, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot")):
        text = F.replace(text, F.lit(raw), F.lit(f"&{name};"))
    return text
