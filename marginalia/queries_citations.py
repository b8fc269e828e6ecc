"""Registered queries of citations (C) and of limits and job states (T), with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import citations as C
from .sources import standins as S
from .sources.standins_sql import with_tables
from .streaming import jobs as J
from .streaming import limits as T

Query = Callable[[SparkSession, str], DataFrame]
NAMES = ("Smith", "Garcia", "Chen", "Okafor")
AUTHORS = ("Ann Smith", "Ann Smith, Bo Lee", "Ann Smith, Bo Lee, Cy Ng", "王小明")
STYLES = ("apa", "mla", "chicago", "harvard", "ieee", "numeric")
NOW = "2024-01-20 00:00:00"


def _pick(values: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with two works in one bracket, one in the sentence, and brackets that cite nothing."""
    d = S.table(spark, sf_dir, "documents")
    name, year = _pick(NAMES, F.col("doc_id")), (1990 + F.col("doc_id") % 30).cast("string")
    return d.select("doc_id", F.concat(F.lit("As shown ("), name, F.lit(" & Lee, "), year, F.lit("; Wikipedia, n.d.) with (n=2009) and ("), F.lit("see Eq. 3) "), name, F.lit(" and Moss ("), year, F.lit(") agree. The (2001) one.")).alias("text"))


def narrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units whose first word is cited with a year, alone or with others; in some a month or a word of time has the year."""
    first, rest = F.regexp_extract("text", "^([^ ]+)", 1), F.regexp_extract("text", "^[^ ]+ (.*)$", 1)
    year, k = (1950 + F.col("k") % 70).cast("string"), F.col("k") % 4
    said = F.when(k == 0, F.concat(first, F.lit(" ("), year, F.lit(") "), rest)).when(k == 1, F.concat(F.lit("去年 (2020) "), first, F.lit(" et al.（"), year, F.lit("a） "), rest)).when(k == 2, F.concat(F.lit("and "), first, F.lit(" & Lee 與 王小明 ("), year, F.lit("b), "), rest)).otherwise(F.concat(F.lit("May (2019), Eq. (2004) and 王小明 ("), year, F.lit(") "), rest))
    return S.edus(spark, sf_dir).select("edu_id", said.alias("text"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = S.table(spark, sf_dir, "documents"), F.col("doc_id")
    return d.select(
        "source",
        "doc_id",
        _pick(AUTHORS, i).alias("authors"),
        F.when(i % 7 != 0, (1990 + i % 30).cast("int")).alias("year"),
        F.when(i % 6 != 0, F.concat(F.lit("Title "), i)).alias("title"),
        F.when(i % 3 == 0, "Journal").otherwise("").alias("venue"),
        F.when(i % 5 == 0, F.concat(F.lit("10.1/"), i)).alias("doi"),
        F.when(i % 2 == 0, F.concat(F.lit("http://a/"), i)).alias("url"),
        F.when(i % 4 == 0, F.concat(F.lit("W"), i)).alias("source_id"),
        F.when(i % 11 == 0, "web").alias("kind"),
    )


_LIST = lambda values, n: "[" + ", ".join(f"'{v}'" for v in values) + f"][{n} % {len(values)} + 1]"
_REFERENCES = f"""refs AS (SELECT source, doc_id, {_LIST(AUTHORS, "doc_id")} AS authors, CASE WHEN doc_id % 7 <> 0 THEN (1990 + doc_id % 30)::INTEGER END AS year, CASE WHEN doc_id % 6 <> 0 THEN 'Title ' || doc_id END AS title,
  CASE WHEN doc_id % 3 = 0 THEN 'Journal' ELSE '' END AS venue, CASE WHEN doc_id % 5 = 0 THEN '10.1/' || doc_id END AS doi, CASE WHEN doc_id % 2 = 0 THEN 'http://a/' || doc_id END AS url, CASE WHEN doc_id % 4 = 0 THEN 'W' || doc_id END AS source_id, CASE WHEN doc_id % 11 = 0 THEN 'web' END AS kind FROM documents),
  r AS (SELECT *, coalesce(year::VARCHAR, 'n.d.') AS y, coalesce(title, '(untitled)') AS t, ['Smith', 'Smith & Lee', 'Smith et al.', '王小明'][doc_id % 4 + 1] AS short FROM refs)"""
_IDENTITY = "coalesce(source_id, lower(authors) || '|' || coalesce(year::VARCHAR, ''))"


def blocks(units: DataFrame) -> DataFrame:
    """Units as blocks, with the heading of the references in place of each paper's last heading."""
    kind = F.when(F.col("ord") == 0, "heading").when(F.col("k") % 4 == 3, "list").otherwise("paragraph")
    text = F.when((F.col("section") == "Conclusion") & (F.col("ord") == 0), "References").otherwise(F.col("text"))
    return units.select("doc_id", F.col("k").alias("place"), kind.alias("kind"), text.alias("text"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests: times in hours stand for seconds."""
    e = S.table(spark, sf_dir, "events")
    return e.select("user_id", "event_id", (F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600.0).alias("at"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.table(spark, sf_dir, "events")
    state = F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "extracting").when(F.col("event_type") == "signup", "checking").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "error")
    return e.select(F.col("user_id").alias("job"), F.col("ts").cast("timestamp").alias("time"), state.alias("state"))


def job_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of updates, a job for each user and day."""
    e = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").parquet(f"{sf_dir}/events.parquet*")  # as a pattern it may be a file or a folder
    state = F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "extracting").when(F.col("event_type") == "signup", "checking").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "error")
    return e.select(F.concat_ws(":", "user_id", F.to_date("ts").cast("string")).alias("job"), F.col("ts").cast("timestamp").alias("time"), state.alias("state"))


def _job_stream(late: str, stalled: int, keep: int) -> Query:
    """What is left of a stream of all updates, run through at once: then its watermark passes the last but late."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        changes = J.job_changes(job_stream(J.with_store(spark), sf_dir), late, stalled, keep)
        return J.latest(J.run_through(changes, J.shared_folder(spark, "jobs")))

    return query


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("time"), (F.col("user_id") % 20).alias("content"))


def _labels(s: SparkSession, d: str) -> DataFrame:
    r, n = references(s, d), F.col("doc_id") % 9
    a, y = F.col("authors"), F.col("year")
    return r.select("doc_id", *(C.label(a, y, x, n).alias(x) for x in STYLES), *(C.label(a, y, x, n, True).alias(f"{x}_said") for x in STYLES))


def _entries(s: SparkSession, d: str) -> DataFrame:
    r, n = references(s, d), F.col("doc_id") % 9
    return r.select("doc_id", *(C.reference(*(F.col(c) for c in ("authors", "year", "title", "venue")), x, n, F.col("url") if x == "mla" else None).alias(x) for x in STYLES))


def _chips(s: SparkSession, d: str) -> DataFrame:
    return references(s, d).withColumn("linked", F.col("doc_id") % 3 != 1)


def _support(s: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    claims = references(s, d).select(i.alias("claim_id"), F.when(i % 10 != 0, "it holds").otherwise(" ").alias("claim"), "source_id", F.when(i % 3 == 0, "own abstract").alias("abstract"))
    catalog = references(s, d).where("source_id is not null").select("source_id", F.lit("known").alias("abstract"))
    judged = references(s, d).select(i.alias("claim_id"), _pick(("supports", "partial", "perhaps", "unsupported"), i).alias("verdict"), ((i % 15) / 10.0).alias("confidence"))
    return C.support(claims, catalog, judged)


QUERIES: dict[str, Query] = {
    "c01_reference_lines": lambda s, d: C.reference_lines(blocks(S.edus(s, d)), "doc_id"),
    "c02_bracketed": lambda s, d: C.bracketed(cited(s, d), "doc_id", "text"),
    "c03_narrative": lambda s, d: C.narrative(narrated(s, d), "edu_id", "text"),
    "c04_spans": lambda s, d: C.without_contained(S.table(s, d, "events").select("user_id", F.pmod("event_id", F.lit(977)).alias("at"), (F.pmod("event_id", F.lit(977)) + 2).alias("end"), F.when(F.lit(False), "narrative").otherwise("bracket").alias("kind")).distinct(), "user_id"),
    "c06_index": lambda s, d: C.index(references(s, d).select(F.lower("authors").alias("surname"), "year", "doc_id", "title"), "doc_id"),
    "c07_link_counts": lambda s, d: C.link_counts(C.linked(C.bracketed(cited(s, d), "doc_id", "text"), references(s, d).where("doc_id % 2 = 0").select(_pick(NAMES, F.col("doc_id")).alias("surname"), "year", F.col("doc_id").alias("pos")), "pos"), "doc_id"),
    "c08_identities": lambda s, d: references(s, d).select("doc_id", C.identity(F.col("source_id"), F.col("authors"), F.col("year")).alias("citation")),
    "c09_labels": _labels,
    "c10_entries": _entries,
    "c11_regional": lambda s, d: references(s, d).select("doc_id", C.regional_reference(*(F.col(c) for c in ("authors", "year", "title", "venue", "doi", "url"))).alias("entry")),
    "c12_grouped": lambda s, d: C.grouped_references(references(s, d), "source", "doc_id").select("source", "doc_id", "group", "place"),
    "c13_refreshed": lambda s, d: C.refreshed(references(s, d).where("doc_id % 8 = 0").select("source_id"), references(s, d).where("doc_id % 16 = 0").select("source_id", "title"), "source_id"),
    "c14_resolved": lambda s, d: C.resolved_list(_chips(s, d), "source", "doc_id"),
    "c15_relinked": lambda s, d: C.relinked(references(s, d).select(F.col("doc_id").alias("citation"), "title", "year"), references(s, d).where("doc_id % 4 = 0").select(F.col("doc_id").alias("citation"), (F.col("doc_id") % 8 == 0).alias("gone"), F.lit("new").alias("title")), ["title"]),
    "c16_support": _support,
    "t01_limited": lambda s, d: T.limited(requests(s, d), "user_id", 3, ("at", "event_id")).select("event_id", "admitted", "wait"),
    "t02_limits": lambda s, d: T.limits(S.table(s, d, "events").select("event_id", F.when(F.col("event_type") == "view", "chat").otherwise(F.col("event_type")).alias("feature"))),
    "t03_idle_keys": lambda s, d: T.idle_keys(requests(s, d).withColumn("admitted", F.col("event_id") % 2 == 0), "user_id", F.unix_timestamp(F.lit(NOW).cast("timestamp")) / 3600.0 + 300),
    "t04_same_jobs": lambda s, d: T.same_jobs(uploads(s, d), "content", 7200).select("id", "job"),
    "t05_answered": lambda s, d: T.answered(S.papers(s, d).select("paper_id", "content_hash"), S.papers(s, d).join(S.results(s, d), "paper_id").groupBy("content_hash").agg(F.min("paper_id").alias("paper_id")), "content_hash").select("paper_id", "known_as"),
    "t06_stream_states": _job_stream("1000 days", 10**8, 10**8),
    "t11_stream_expiry": _job_stream("1 hour", 5 * 86400, 10 * 86400),
    "t06_job_states": lambda s, d: T.job_states(jobs(s, d), F.lit("2024-01-31 00:00:00").cast("timestamp"), 36000).select("job", "state"),
    "t07_days": lambda s, d: T.by_day(S.upload_events(s, d).withColumnRenamed("created_at", "time")),
    "t08_swept": lambda s, d: T.swept(S.upload_events(s, d).withColumnRenamed("created_at", "time"), F.lit(NOW).cast("timestamp"), 86400).select("id", "status", "error_message"),
    "t09_debounced": lambda s, d: T.debounced(S.upload_events(s, d).select("paper_id", F.date_trunc("second", "created_at").alias("time")), "paper_id", "8 hours").select("paper_id", "began", "edits"),
    "t09_throttled": lambda s, d: T.throttled(requests(s, d), "user_id", 48.0),
}

_EVENTS = "e AS (SELECT user_id, event_id, floor(epoch(ts)) / 3600.0::DOUBLE AS at_, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS r FROM events)"
_STATE = "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 WHEN 'error' THEN 5 END"


#: Jobs that ended are gone, and others interrupted, where the watermark, the last time less what may be late, has passed the time to do so.
_JOB_STREAM = f"""WITH e AS (SELECT user_id || ':' || ts::DATE AS job, {_STATE} AS rank, date_trunc('millisecond', ts) AS ts FROM events), w AS (SELECT date_trunc('millisecond', max(ts)) - {{late}} AS mark FROM events),
  s AS (SELECT job, max(rank) AS rank, max(ts) AS t FROM e WHERE rank IS NOT NULL GROUP BY 1)
  SELECT job, CASE WHEN rank < 4 AND t + INTERVAL {{stalled}} <= mark THEN 'error' ELSE ['queued', 'extracting', 'checking', 'done', 'error'][rank] END AS state, CASE WHEN rank < 4 AND t + INTERVAL {{stalled}} <= mark THEN 'Interrupted' ELSE '' END AS message
  FROM s, w WHERE NOT (rank >= 4 AND t + INTERVAL {{keep}} <= mark)"""


def _label_sql(style: str, said: bool) -> str:
    n = "'[' || doc_id % 9 || ']'"
    if said:
        return f"short || ' ' || {n}" if style in C.NUMBERED else "short" if style == "mla" else "short || ' (' || y || ')'"
    return n if style in C.NUMBERED else "'(' || short || ')'" if style == "mla" else f"'(' || short || '{' ' if style == 'chicago' else ', '}' || y || ')'"


_VENUE = lambda before, after: f"CASE WHEN venue <> '' THEN '{before}' || venue || '{after}' ELSE '' END"
_NUMBERED = f"'[' || doc_id % 9 || '] ' || authors || ', “' || t || ',”' || {_VENUE(' ', ',')} || ' ' || y || '.'"
_ENTRIES = {
    "apa": f"authors || ' (' || y || '). ' || t || {_VENUE('. ', '')} || '.'",
    "mla": f"authors || '. “' || t || '.”' || {_VENUE(' ', ',')} || ' ' || y || '.' || CASE WHEN url IS NOT NULL THEN ' ' || url ELSE '' END",
    "chicago": f"authors || '. “' || t || '.”' || {_VENUE(' ', '')} || ' (' || y || ').'",
    "harvard": f"authors || ' (' || y || ') ‘' || t || '’' || {_VENUE(', ', '')} || '.'",
    "ieee": _NUMBERED,
    "numeric": _NUMBERED,
}
_GROUP = "CASE WHEN kind = 'web' OR (url IS NOT NULL AND doi IS NULL AND venue = '') THEN 'web' WHEN regexp_matches(authors, '[一-鿿]') THEN 'zh' ELSE 'en' END"
_NAME = _LIST(NAMES, "doc_id")

ORACLES: dict[str, str] = {
    "c01_reference_lines": with_tables("edus", "WITH b AS (SELECT doc_id, k AS place, CASE WHEN ord = 0 THEN 'heading' WHEN k % 4 = 3 THEN 'list' ELSE 'paragraph' END AS kind, CASE WHEN section = 'Conclusion' AND ord = 0 THEN 'References' ELSE text END AS text FROM edus), h AS (SELECT doc_id, min(place) AS first FROM b WHERE kind = 'heading' AND regexp_matches(text, '(?i)References|Bibliography') GROUP BY 1) SELECT b.doc_id, place, kind, text FROM b JOIN h ON h.doc_id = b.doc_id AND place > first WHERE kind <> 'list' AND length(trim(text)) > 12"),
    "c02_bracketed": f"SELECT doc_id, 0 AS place, 0 AS part, lower({_NAME}) AS surname, (1990 + doc_id % 30)::INTEGER AS year, {_NAME} || ', Lee' AS authors, false AS web, {_NAME} || ' & Lee, ' || (1990 + doc_id % 30) AS raw FROM documents UNION ALL SELECT doc_id, 0, 1, 'wikipedia', NULL, 'Wikipedia', true, 'Wikipedia, n.d.' FROM documents",
    "c03_narrative": with_tables("edus", rf"WITH w AS (SELECT edu_id, k % 4 AS kind, 1950 + k % 70 AS y, string_split(text, ' ')[1] AS w FROM edus), m AS (SELECT *, regexp_full_match(w, '[A-Z][A-Za-z.''\-]+') AS latin FROM w), r AS (SELECT *, CASE WHEN kind < 2 AND latin THEN w WHEN kind = 2 THEN CASE WHEN latin THEN w || ' & ' ELSE '' END || 'Lee 與 王小明' END AS a FROM m), f AS (SELECT *, lower(regexp_replace(trim(regexp_split_to_array(a, '\s*(&|et al\.?|,|，|and|與|；|;)\s*')[1]), '^[,，.]+|[,，.]+$', '', 'g')) AS surname, regexp_replace(regexp_replace(a, '\s*(&|et al\.?|and|與)\s*', ', ', 'g'), '^[\s,，、.]+|[\s,，、.]+$', '', 'g') AS authors FROM r WHERE a IS NOT NULL) SELECT edu_id, 0 AS place, surname, y::INTEGER AS year, authors FROM f WHERE surname <> '' AND (kind = 2 OR surname NOT IN {C.LEADS})"),
    "c04_spans": """WITH RECURSIVE e AS (SELECT user_id, a, row_number() OVER (PARTITION BY user_id ORDER BY a) AS r FROM (SELECT DISTINCT user_id, event_id % 977 AS a FROM events)), f AS (SELECT user_id, a, r, a + 2 AS last, true AS kept FROM e WHERE r = 1 UNION ALL SELECT e.user_id, e.a, e.r, CASE WHEN e.a >= f.last THEN e.a + 2 ELSE f.last END, e.a >= f.last FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1) SELECT user_id, a AS "at", a + 2 AS "end", 'bracket' AS kind FROM f WHERE kept""",
    "c06_index": f"WITH {_REFERENCES} SELECT lower(authors) AS surname, year, max(doc_id) AS doc_id, arg_max(coalesce(title, '?'), doc_id) AS t_ FROM refs WHERE year IS NOT NULL GROUP BY 1, 2".replace("SELECT lower(authors)", "SELECT surname, year, doc_id, nullif(t_, '?') AS title FROM (SELECT lower(authors)") + ")",
    "c07_link_counts": f"WITH i AS (SELECT DISTINCT {_NAME} AS name, 1990 + doc_id % 30 AS year FROM documents WHERE doc_id % 2 = 0 AND doc_id % 7 <> 0) SELECT doc_id, CASE WHEN ({_NAME}, 1990 + doc_id % 30) IN (SELECT (name, year) FROM i) THEN 1 ELSE 0 END AS linked, CASE WHEN ({_NAME}, 1990 + doc_id % 30) IN (SELECT (name, year) FROM i) THEN 1 ELSE 2 END AS unlinked FROM documents",
    "c08_identities": f"WITH {_REFERENCES} SELECT doc_id, {_IDENTITY} AS citation FROM refs",
    "c09_labels": f"WITH {_REFERENCES} SELECT doc_id, " + ", ".join(f"{_label_sql(x, said)} AS {x}{'_said' if said else ''}" for x in STYLES for said in (False, True)) + " FROM r",
    "c10_entries": f"WITH {_REFERENCES} SELECT doc_id, " + ", ".join(f"{sql} AS {x}" for x, sql in _ENTRIES.items()) + " FROM r",
    "c11_regional": f"WITH {_REFERENCES} SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN authors || '（' || y || '）。' || t || {_VENUE('。', '')} || '。' || CASE WHEN doi IS NOT NULL THEN 'doi: ' || doi WHEN url IS NOT NULL THEN '擷取自 ' || url ELSE '' END ELSE authors || ' (' || y || '). ' || t || {_VENUE('. ', '')} || '.' || CASE WHEN doi IS NOT NULL THEN ' doi: ' || doi WHEN url IS NOT NULL THEN ' Retrieved from ' || url ELSE '' END END AS entry FROM r",
    "c12_grouped": f"WITH {_REFERENCES}, g AS (SELECT *, {_GROUP} AS \"group\" FROM refs) SELECT source, doc_id, \"group\", row_number() OVER (PARTITION BY source, \"group\" ORDER BY lower(authors), doc_id) AS place FROM g",
    "c13_refreshed": f"WITH {_REFERENCES} SELECT source_id, title FROM refs WHERE doc_id % 16 = 0",
    "c14_resolved": f"WITH {_REFERENCES}, f AS (SELECT source, {_IDENTITY} AS citation, min(doc_id) AS first FROM refs WHERE doc_id % 3 <> 1 GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY source ORDER BY first) AS number FROM f",
    "c15_relinked": f"WITH {_REFERENCES} SELECT doc_id AS citation, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE title END AS title, year FROM refs WHERE doc_id % 8 <> 0",
    "c16_support": "WITH j AS (SELECT doc_id, doc_id % 10 <> 0 AND (doc_id % 4 = 0 OR doc_id % 3 = 0) AND doc_id % 4 <> 2 AS known FROM documents) SELECT doc_id AS claim_id, CASE WHEN known THEN ['supports', 'partial', 'perhaps', 'unsupported'][doc_id % 4 + 1] ELSE 'unknown' END AS verdict, CASE WHEN known THEN least(1.0::DOUBLE, (doc_id % 15) / 10.0::DOUBLE) ELSE 0.0::DOUBLE END AS confidence FROM j",
    "t01_limited": f"WITH RECURSIVE {_EVENTS}, f AS (SELECT user_id, event_id, at_, r, [at_] AS kept, true AS admitted, 0::BIGINT AS wait FROM e WHERE r = 1 UNION ALL SELECT user_id, event_id, at_, r, CASE WHEN len(live) >= 3 THEN live ELSE list_append(live, at_) END, len(live) < 3, CASE WHEN len(live) >= 3 THEN greatest(1, trunc(60 - (at_ - list_min(live))))::BIGINT ELSE 0 END FROM (SELECT e.user_id, e.event_id, e.at_, e.r, list_filter(f.kept, lambda x: e.at_ - x < 60) AS live FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1)) SELECT event_id, admitted, wait FROM f",
    "t02_limits": "WITH x AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'chat' ELSE event_type END AS feature FROM events) SELECT *, CASE feature " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in T.PER_MINUTE.items()) + " END AS per_minute FROM x",
    "t03_idle_keys": f"SELECT user_id, max(floor(epoch(ts)) / 3600.0::DOUBLE) AS last FROM events WHERE event_id % 2 = 0 GROUP BY 1 HAVING epoch(TIMESTAMP '{NOW}') / 3600.0::DOUBLE + 300 - max(floor(epoch(ts)) / 3600.0::DOUBLE) >= 60",
    "t04_same_jobs": "WITH u AS (SELECT event_id AS id, ts, user_id % 20 AS content FROM events), n AS (SELECT *, CASE WHEN floor(epoch(ts)) - floor(epoch(lag(ts) OVER w)) < 7200 THEN 0 ELSE 1 END AS new FROM u WINDOW w AS (PARTITION BY content ORDER BY ts, id)), g AS (SELECT *, sum(new) OVER (PARTITION BY content ORDER BY ts, id) AS run FROM n) SELECT id, first_value(id) OVER (PARTITION BY content, run ORDER BY ts, id) AS job FROM g",
    "t05_answered": with_tables("papers results", "SELECT p.paper_id, k.paper_id AS known_as FROM papers p LEFT JOIN (SELECT content_hash, min(paper_id) AS paper_id FROM papers JOIN results USING (paper_id) GROUP BY 1) k ON k.content_hash = p.content_hash"),
    "t06_stream_states": _JOB_STREAM.format(late="INTERVAL 1000 DAY", stalled="1000000 HOUR", keep="1000000 HOUR"),
    "t11_stream_expiry": _JOB_STREAM.format(late="INTERVAL 1 HOUR", stalled="5 DAY", keep="10 DAY"),
    "t06_job_states": f"WITH s AS (SELECT user_id AS job, max({_STATE}) AS rank, max(ts) FILTER ({_STATE} IS NOT NULL) AS t FROM events GROUP BY 1) SELECT job, ['queued', 'extracting', 'checking', 'done', 'error'][rank] AS state FROM s WHERE rank IS NOT NULL AND NOT (rank >= 4 AND epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(t)) > 36000)",
    "t07_days": with_tables("upload_events", "SELECT date_trunc('day', created_at)::TIMESTAMP AS day, status, count(*) AS n FROM upload_events GROUP BY 1, 2"),
    "t08_swept": with_tables("upload_events", f"WITH g AS (SELECT *, status = 'pending' AND epoch(TIMESTAMP '{NOW}') - floor(epoch(created_at)) > 86400 AS gone FROM upload_events) SELECT id, CASE WHEN gone THEN 'error' ELSE status END AS status, CASE WHEN gone THEN 'Interrupted' ELSE error_message END AS error_message FROM g"),
    "t09_debounced": with_tables("upload_events", "WITH t AS (SELECT paper_id, date_trunc('second', created_at)::TIMESTAMP AS t FROM upload_events), n AS (SELECT *, CASE WHEN epoch(t) - epoch(lag(t) OVER (PARTITION BY paper_id ORDER BY t)) < 28800 THEN 0 ELSE 1 END AS new FROM t), g AS (SELECT *, sum(new) OVER (PARTITION BY paper_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM n) SELECT paper_id, min(t) AS began, count(*) AS edits FROM g GROUP BY paper_id, run"),
    "t09_throttled": f"WITH RECURSIVE {_EVENTS}, f AS (SELECT user_id, at_, r, at_ AS last, true AS kept FROM e WHERE r = 1 UNION ALL SELECT e.user_id, e.at_, e.r, CASE WHEN e.at_ - f.last >= 48 THEN e.at_ ELSE f.last END, e.at_ - f.last >= 48 FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1) SELECT user_id, at_ AS \"at\" FROM f WHERE kept",
}
