"""Citations (C): found in running text, linked to references, labelled and listed.

A citation is a row (authors, year, title, venue, doi, url, source_id, kind); authors are one text, parted by commas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What references stand under; a citation in brackets; a year; an author; hints of a page on the web.
REFERENCES = "(?i)參考文獻|參考書目|引用文獻|References|Bibliography"
BRACKETS = r"[（(]([^（()）]{2,90}?)[）)]"
YEAR = r"(?:19|20)\d{2}"
AUTHOR = r"[A-Z][A-Za-z.'\-]+|[一-鿿]{2,}"
WEB = r"(?i)wiki|https?://|維基|\bn\.?\s?d\.?\b|無日期|retrieved|取自"
BETWEEN = r"\s*(?:&|et al\.?|,|，|and|與|；|;)\s*"
CJK = "[぀-ヿ㐀-䶿一-鿿]"
NUMBERED = ("ieee", "numeric")
#: An author run with its year in brackets, led by a Latin name, which begins no later than its word (an
#: ideograph may stand right before it, a Latin letter not); leads that are no author's name alone.
NARRATIVE = r"(?<![\p{IsLatin}\p{M}])([A-Z][A-Za-z.'\-]+(?:\s*(?:,|，|、|&|and|與|et\s+al\.?)\s*(?:[A-Z][A-Za-z.'\-]+|[一-鿿]{2,}))*(?:\s+et\s+al\.?)?)\s*[（(]((?:19|20)\d{2})[a-z]?[）)]"
LEADS = ("table", "figure", "fig", "chapter", "section", "appendix", "equation", "eq", "vol", "no", "the", "this", "that", "in", "since", "around", "circa", "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def reference_lines(blocks: DataFrame, key: str) -> DataFrame:
    """Blocks (key, place, kind, text) over 12 characters long that stand behind the heading of the references."""
    own = Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    behind = F.coalesce(F.max((F.col("kind") == "heading") & F.col("text").rlike(REFERENCES)).over(own), F.lit(False))
    return blocks.withColumn("_behind", behind).where("_behind and char_length(trim(text)) > 12").where(F.col("kind").isin("paragraph", "heading", "quote")).drop("_behind")


def surname(authors: Column) -> Column:
    """The first author's, in small letters, of what stands before the year."""
    return F.lower(F.regexp_replace(F.trim(F.get(F.split(F.trim(authors), BETWEEN), 0)), "^[,，.]+|[,，.]+$", ""))


def authors_of(before: Column) -> Column:
    """Author text with its names parted by commas."""
    return F.regexp_replace(F.regexp_replace(before, r"\s*(?:&|et al\.?|and|與)\s*", ", "), "^[\\s,，、.]+|[\\s,，、.]+$", "")


def parsed(segment: Column) -> Column:
    """struct<surname, year, authors, web, raw> of one citation; null for other text in brackets."""
    year = F.regexp_extract(segment, YEAR, 0)
    web = segment.rlike(WEB)
    before = F.when(year == "", segment).otherwise(F.split_part(segment, year, F.lit(1)))
    name = surname(before)
    authors = F.regexp_replace(authors_of(before), r"(?i),?\s*n\.?\s?d\.?\s*$", "")
    authors = F.regexp_replace(authors, "^[, ]+|[, ]+$", "")
    whole = F.struct(name.alias("surname"), F.when(year != "", year.cast("int")).alias("year"), F.when(authors == "", F.trim(before)).otherwise(authors).alias("authors"), web.alias("web"), F.trim(segment).alias("raw"))
    return F.when(((year != "") | web) & before.rlike(AUTHOR) & (name != ""), whole)


def bracketed(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place, part, surname, year, authors, web, raw): the citations in brackets, parted at semicolons."""
    groups = texts.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(BRACKETS), F.lit(1))).alias("place", "inside"))
    parts = groups.select(key, "place", F.posexplode(F.split("inside", r"\s*[;；]\s*")).alias("part", "segment"))
    return parts.select(key, "place", "part", parsed(F.col("segment")).alias("c")).where("c is not null").select(key, "place", "part", "c.*")


def narrative(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place, surname, year, authors): authors named in the sentence with the year alone in brackets."""
    found = F.arrays_zip(F.regexp_extract_all(F.col(text), F.lit(NARRATIVE), F.lit(1)).alias("a"), F.regexp_extract_all(F.col(text), F.lit(NARRATIVE), F.lit(2)).alias("y"))
    rows = texts.select(key, F.posexplode(found).alias("place", "f")).select(key, "place", F.col("f.a").alias("a"), F.col("f.y").cast("int").alias("year"))
    rows = rows.withColumn("surname", surname(F.col("a")))
    led = (F.size(F.regexp_extract_all("a", F.lit(f"({AUTHOR})"), F.lit(1))) <= 1) & F.col("surname").isin(*LEADS)
    return rows.where(~led & (F.col("surname") != "")).select(key, "place", "surname", "year", authors_of(F.col("a")).alias("authors"))


def without_contained(spans: DataFrame, key: str) -> DataFrame:
    """Spans (key, at, end, kind) in order: a narrative one wins over the brackets in it, of others that overlap the
    first stays. Whether one stays depends on the one kept before it alone, the kept ends being ascending: a key's spans
    are folded as an array."""
    rows = spans.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", (F.col("kind") != "narrative").alias("second"), "end", "kind"))).alias("s"))
    wins = F.filter("s", lambda x: ~x["second"])
    rest = F.filter("s", lambda x: ~(x["second"] & F.exists(wins, lambda w: (w["at"] <= x["at"]) & (x["end"] <= w["end"]))))
    start = F.struct(F.lit(-1).cast("long").alias("end"), F.array().cast("array<struct<at:bigint,end:bigint,kind:string>>").alias("kept"))
    step = lambda acc, x: F.when(x["at"] >= acc["end"], F.struct(x["end"].cast("long").alias("end"), F.concat(acc["kept"], F.array(F.struct(x["at"].cast("long").alias("at"), x["end"].cast("long").alias("end"), x["kind"].alias("kind")))).alias("kept"))).otherwise(acc)
    return rows.select(key, F.inline(F.aggregate(rest, start, step, lambda acc: acc["kept"])))


def index(references: DataFrame, order: str) -> DataFrame:
    """References by (surname, year), the last of each."""
    some = references.where("coalesce(trim(surname), '') <> '' and year is not null").withColumn("surname", F.lower(F.trim("surname")))
    rest = [c for c in some.columns if c not in ("surname", "year")]
    return some.groupBy("surname", "year").agg(F.max_by(F.struct(*rest), order).alias("r")).select("surname", "year", "r.*")


def linked(citations: DataFrame, references: DataFrame, order: str) -> DataFrame:
    """Citations with the reference that they name, and whether there is one."""
    found = index(references, order).withColumn("linked", F.lit(True))
    return citations.join(found, ["surname", "year"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))


def link_counts(chips: DataFrame, key: str) -> DataFrame:
    """By text the citations that are linked and those that are not."""
    return chips.groupBy(key).agg(F.count_if("linked").alias("linked"), F.count_if(~F.col("linked")).alias("unlinked"))


def identity(source_id: Column, authors: Column, year: Column) -> Column:
    """What tells citations apart: the source's id, or authors and year."""
    names = F.trim(F.regexp_replace(F.lower(F.coalesce(authors, F.lit(""))), r"\s+", " "))
    return F.coalesce(F.nullif(source_id, F.lit("")), F.concat(names, F.lit("|"), F.coalesce(year.cast("string"), F.lit(""))))


def short_authors(authors: Column) -> Column:
    """Last names of one or two authors; of more the first's."""
    names = F.filter(F.transform(F.split(F.coalesce(authors, F.lit("")), r"[,、;]"), F.trim), lambda a: a != "")
    last = lambda a: F.element_at(F.split(a, r"\s+"), -1)
    return F.when(F.size(names) == 0, "Anon.").when(F.size(names) == 1, last(F.get(names, 0))).when(F.size(names) == 2, F.concat(last(F.get(names, 0)), F.lit(" & "), last(F.get(names, 1)))).otherwise(F.concat(last(F.get(names, 0)), F.lit(" et al.")))


def label(authors: Column, year: Column, style: str, number: Column, in_sentence: bool = False) -> Column:
    """What stands in the text."""
    short, y = short_authors(authors), F.coalesce(year.cast("string"), F.lit("n.d."))
    around = lambda a, *x: F.concat(F.lit(a[0]), *x, F.lit(a[1]))
    bracket = around("[]", number.cast("string"))
    if in_sentence:
        return F.concat(short, F.lit(" "), bracket) if style in NUMBERED else short if style == "mla" else F.concat(short, F.lit(" "), around("()", y))
    if style in NUMBERED:
        return bracket
    return around("()", short) if style == "mla" else around("()", short, F.lit(" " if style == "chicago" else ", "), y)


def reference(authors: Column, year: Column, title: Column, venue: Column, style: str, number: Column, link: Column | None = None) -> Column:
    """What stands in the list. link: an address behind it, where the style's reader wants one."""
    some = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), F.lit(other))
    a, y, t = some(authors, "Anon."), F.coalesce(year.cast("string"), F.lit("n.d.")), some(title, "(untitled)")
    v = lambda before, after: F.when(F.coalesce(venue, F.lit("")) != "", F.concat(F.lit(before), venue, F.lit(after))).otherwise("")
    text = F.lit
    forms = {
        "mla": F.concat(a, text(". “"), t, text(".”"), v(" ", ","), text(" "), y, text(".")),
        "chicago": F.concat(a, text(". “"), t, text(".”"), v(" ", ""), text(" ("), y, text(").")),
        "harvard": F.concat(a, text(" ("), y, text(") ‘"), t, text("’"), v(", ", ""), text(".")),
        "ieee": F.concat(text("["), number.cast("string"), text("] "), a, text(", “"), t, text(",”"), v(" ", ","), text(" "), y, text(".")),
    }
    out = forms.get("ieee" if style in NUMBERED else style, F.concat(a, text(" ("), y, text("). "), t, v(". ", ""), text(".")))
    return out if link is None else F.concat(out, F.when(F.coalesce(link, F.lit("")) != "", F.concat(text(" "), link)).otherwise(""))


def regional_reference(authors: Column, year: Column, title: Column, venue: Column, doi: Column, url: Column) -> Column:
    """C11: with full-width marks where a record has ideographs, else as usual; a DOI or address behind it."""
    some = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), F.lit(other))
    a, y, t, v, d, u = some(authors, "Anon."), F.coalesce(year.cast("string"), F.lit("n.d.")), some(title, "(untitled)"), some(venue, ""), some(doi, ""), some(url, "")
    tail = lambda before_doi, before_url: F.when(d != "", F.concat(F.lit(before_doi), d)).when(u != "", F.concat(F.lit(before_url), u)).otherwise("")
    wide = F.concat(F.replace(a, F.lit(", "), F.lit("、")), F.lit("（"), y, F.lit("）。"), t, F.when(v != "", F.concat(F.lit("。"), v)).otherwise(""), F.lit("。"), tail("doi: ", "擷取自 "))
    plain = F.concat(a, F.lit(" ("), y, F.lit("). "), t, F.when(v != "", F.concat(F.lit(". "), v)).otherwise(""), F.lit("."), tail(" doi: ", " Retrieved from "))
    return F.when(F.concat(a, t, v).rlike(CJK), wide).otherwise(plain)


def group_of(kind: Column, authors: Column, title: Column, venue: Column, doi: Column, url: Column) -> Column:
    """Web for pages on the web, else zh or en by whether a record has ideographs."""
    none = lambda c: F.coalesce(c, F.lit("")) == ""
    blob = F.concat_ws("", title, authors, venue)
    return F.when(F.coalesce(kind == "web", F.lit(False)) | (~none(url) & none(doi) & none(venue)), "web").when(blob.rlike(CJK), "zh").otherwise("en")


def grouped_references(references: DataFrame, key: str, order: str) -> DataFrame:
    """References with their group and place in it: by authors in small letters, ties as they stand."""
    rows = references.withColumn("group", group_of(*(F.col(c) for c in ("kind", "authors", "title", "venue", "doi", "url"))))
    own = Window.partitionBy(key, "group").orderBy(F.lower(F.trim(F.coalesce("authors", F.lit("")))), order)
    return rows.withColumn("place", F.row_number().over(own))


def refreshed(ids: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """The catalog's records of the ids asked for; unknown ones are absent."""
    return ids.select(key).distinct().join(catalog, key)


def resolved_list(chips: DataFrame, key: str, order: str) -> DataFrame:
    """C14: a text's linked citations, each once, numbered as they first appear."""
    own = identity(F.col("source_id"), F.col("authors"), F.col("year"))
    first = chips.where("linked").groupBy(key, own.alias("citation")).agg(F.min(order).alias("first"))
    return first.withColumn("number", F.row_number().over(Window.partitionBy(key).orderBy("first")))


def relinked(chips: DataFrame, changes: DataFrame, fields: list[str]) -> DataFrame:
    """Chips (citation, ...) with the fields of changes (citation, gone, ...) for the same citation; those gone go."""
    new = changes.select("citation", "gone", *(F.col(f).alias(f"_{f}") for f in fields))
    rows = chips.join(new, "citation", "left").where(~F.coalesce("gone", F.lit(False)))
    changed = F.col("gone").isNotNull()
    return rows.select(*(F.when(changed, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in chips.columns))


def support(claims: DataFrame, catalog: DataFrame, judged: DataFrame) -> DataFrame:
    """(claim_id, verdict, confidence): what a judge says of a claim and its source's abstract; unknown with 0 where
    either is blank or no judgment is one of those known."""
    rows = claims.join(catalog.select("source_id", F.col("abstract").alias("_abstract")), "source_id", "left").join(judged, "claim_id", "left")
    blank = lambda c: ~F.coalesce(c, F.lit("")).rlike(r"\S")
    known = ~blank(F.col("claim")) & ~blank(F.coalesce("_abstract", "abstract")) & F.coalesce(F.col("verdict").isin("supports", "partial", "unsupported"), F.lit(False))
    return rows.select("claim_id", F.when(known, F.col("verdict")).otherwise("unknown").alias("verdict"), F.when(known, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0))))).otherwise(0.0).alias("confidence"))
