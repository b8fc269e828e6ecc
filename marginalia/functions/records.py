"""Bibliographic records (X27-X32): nested JSON of a work to one flat row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import host, trusted

WORK = """id string, doi string, title string, display_name string, publication_year int, cited_by_count long, type string, relevance_score double,
  authorships array<struct<author: struct<display_name: string>>>, abstract_inverted_index map<string, array<int>>,
  primary_location struct<landing_page_url: string, source: struct<display_name: string>>,
  locations array<struct<is_oa: boolean, landing_page_url: string, pdf_url: string>>"""
#: Hosts whose full texts are there to stay.
HOSTS = (
    "arxiv.org",
    "ncbi.nlm.nih.gov",
    "europepmc.org",
    "aclanthology.org",
    "openreview.net",
    "proceedings.mlr.press",
    "proceedings.neurips.cc",
    "papers.nips.cc",
    "openaccess.thecvf.com",
    "dl.acm.org",
    "biorxiv.org",
    "medrxiv.org",
)


def _some(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def full_text(locations: Column, hosts: tuple[str, ...] = HOSTS) -> Column:
    """Of the open locations' landing pages, then of their files, the first on a trusted host; empty without one."""
    good = lambda url: url.isNotNull() & ~F.coalesce(host(url).endswith("doi.org"), F.lit(False)) & F.coalesce(trusted(url, hosts), F.lit(False))
    first = lambda field: F.get(F.transform(F.filter(locations, lambda x: F.coalesce(x["is_oa"], F.lit(False)) & good(x[field])), lambda x: x[field]), 0)
    return F.coalesce(first("landing_page_url"), first("pdf_url"), F.lit(""))


def source_link(full: Column, doi: Column, primary: Column, record: Column) -> Column:
    """The first link that is there."""
    return F.coalesce(_some(full), _some(doi), _some(primary), _some(record), F.lit(""))


def restored_abstract(index: Column) -> Column:
    """The text whose words stand at the places that an inverted index names."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda i: F.struct(i.alias("at"), e["key"].alias("word")))))
    return F.coalesce(F.array_join(F.transform(F.array_sort(places), lambda p: p["word"]), " "), F.lit(""))


def file_link(url: Column) -> Column:
    """An arXiv abstract's file; other links as they are."""
    own = F.regexp_extract(url, r"arxiv\.org/abs/([\w.\-/]+)", 1)
    return F.when(own != "", F.concat(F.lit("https://arxiv.org/pdf/"), own)).otherwise(url)


def doi_link(doi: Column) -> Column:
    """An absolute link to a DOI; empty for none."""
    bare = F.trim(F.coalesce(doi, F.lit("")))
    return F.when(bare == "", "").when(bare.rlike("(?i)^https?://"), bare).otherwise(F.concat(F.lit("https://doi.org/"), F.regexp_replace(bare, "(?i)^doi:\\s*", "")))


def reference_links(full: Column, doi: Column, url: Column) -> Column:
    """array<struct<kind, link>> of the links that are there, the full text first."""
    link = lambda kind, x: F.when(F.coalesce(x, F.lit("")) != "", F.struct(F.lit(kind).alias("kind"), x.alias("link")))
    return F.filter(F.array(link("fulltext", full), link("doi", doi_link(doi)), link("source", url)), lambda x: x.isNotNull())


def normalized(works: DataFrame, column: str, hosts: tuple[str, ...] = HOSTS) -> DataFrame:
    """The columns of works but the JSON, and twelve flat ones; texts that cannot be parsed give empty records."""
    rest = [F.col(f"`{c}`") for c in works.columns if c != column]
    w = works.select(*rest, F.from_json(column, WORK).alias("w"))
    full = full_text(F.col("w.locations"), hosts)
    empty = lambda c: F.coalesce(c, F.lit(""))
    names = F.filter(F.transform("w.authorships", lambda a: a["author"]["display_name"]), lambda n: F.coalesce(n, F.lit("")) != "")
    return w.select(
        *rest,
        F.element_at(F.split(empty(F.col("w.id")), "/"), -1).alias("work_id"),
        F.coalesce(_some(F.col("w.title")), _some(F.col("w.display_name")), F.lit("(untitled)")).alias("title"),
        F.coalesce(names, F.array().cast("array<string>")).alias("authors"),
        F.col("w.publication_year").alias("year"),
        empty(F.col("w.primary_location.source.display_name")).alias("venue"),
        empty(F.col("w.doi")).alias("doi"),
        full.alias("oa_url"),
        source_link(full, F.col("w.doi"), F.col("w.primary_location.landing_page_url"), F.col("w.id")).alias("url"),
        F.coalesce("w.cited_by_count", F.lit(0).cast("long")).alias("cited_by_count"),
        empty(F.col("w.type")).alias("type"),
        restored_abstract(F.col("w.abstract_inverted_index")).alias("abstract"),
        F.col("w.relevance_score").alias("relevance_score"),
    )
