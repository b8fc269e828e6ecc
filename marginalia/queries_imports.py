"""Registered queries of imported documents: blocks of Markdown and other formats, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources import imports as IN
from .sources import latex as TEX
from .sources import markdown as MD
from .sources import renders as RE
from .sources import standins as S

Query = Callable[[SparkSession, str], DataFrame]

#: Marks that Markdown reads; lines of documents are dressed without their own.
_MARKS = "#*_`~|$[]()<>!\\-=+&"
_SQL_MARKS = _MARKS.replace("'", "''")


def dressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): every line of every document as a Markdown block, of a kind that follows from its id and number."""
    docs = S.table(spark, sf_dir, "documents").select("doc_id", "text")
    clean = lambda t: F.trim(F.regexp_replace(F.regexp_replace(F.translate(t, _MARKS, ""), "[ \t\r\x0b\x0c]+", " "), r"^[^\p{L}]+", ""))
    lines = F.filter(F.transform(F.split("text", "\n"), clean), lambda t: t != "")

    def block(line: Column, k: Column) -> Column:
        w = F.split(line, " ")
        word = lambda i: F.coalesce(F.get(w, F.lit(i)), F.lit("x"))
        rest = F.coalesce(F.nullif(F.array_join(F.slice(w, 4, F.size(w)), " "), F.lit("")), F.lit("x"))
        half = F.ceil(F.size(w) / 2).cast("int")
        kind = (F.col("doc_id") + 3 * k + F.floor(k / 12)) % 12
        cases = [
            F.concat(F.repeat(F.lit("#"), k % 4 + 1), F.lit(" "), line),
            F.concat(F.lit("**"), word(0), F.lit("** "), rest, F.lit(" [*"), word(1), F.lit("*](http://a.example)")),
            F.concat(F.array_join(F.slice(w, F.lit(1), half), " "), F.when(k % 2 == 1, "  \n").otherwise("\n"), F.coalesce(F.nullif(F.array_join(F.slice(w, half + 1, F.size(w)), " "), F.lit("")), F.lit("x"))),
            F.concat(F.lit("- "), word(0), F.lit("\n  - *"), word(1), F.lit("*\n    1. "), word(2), F.lit("\n  - "), rest, F.lit("\n- "), word(0)),
            F.concat(F.lit("```py\n"), line, F.lit("\n# "), word(0), F.lit("\n```")),
            F.concat(F.lit("| "), word(0), F.lit(" | `"), word(1), F.lit("` |\n| --- | :-: |\n| "), rest, F.lit(" | a \\| b |")),
            F.concat(F.lit("> "), line, F.lit("\n>\n> ~~"), word(0), F.lit("~~\nlazy "), word(1)),
            F.lit("---"),
            F.concat(F.lit("$$\n "), line, F.lit(" \n$$")),
            F.concat(F.lit("![**"), word(0), F.lit("**](img/"), word(1), F.lit(".png) "), line),
            F.concat(line, F.lit("\n===")),
            F.concat(F.lit("    "), line, F.lit("\n    "), word(0)),
        ]
        out = F.lit(None).cast("string")
        for i, c in enumerate(cases):
            out = F.when(kind == i, c).otherwise(out)
        return out

    led = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# Title "), F.col("doc_id"), F.lit("\n\n"))).otherwise("")
    return docs.select("doc_id", F.concat(led, F.array_join(F.transform(lines, block), "\n\n")).alias("text"))


_DRESSED = rf"""
cleaned AS (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda t: trim(regexp_replace(regexp_replace(translate(t, '{_SQL_MARKS}', ''), '[ \t\r\x0b\x0c]+', ' ', 'g'), '^[^\p{{L}}]+', ''))), lambda t: t <> '') AS ls
  FROM documents
), ls AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS k FROM cleaned
), ws AS (
  SELECT *, string_split(line, ' ') AS w, (doc_id + 3 * k + k // 12) % 12 AS kind FROM ls
), parts AS (
  SELECT *, w[1] AS w0, coalesce(w[2], 'x') AS w1, coalesce(w[3], 'x') AS w2, coalesce(nullif(array_to_string(w[4:], ' '), ''), 'x') AS rest,
    array_to_string(w[1 : (len(w) + 1) // 2], ' ') AS a, coalesce(nullif(array_to_string(w[(len(w) + 1) // 2 + 1 :], ' '), ''), 'x') AS b
  FROM ws
), snippets AS (
  SELECT doc_id, k, CASE kind
    WHEN 0 THEN repeat('#', (k % 4 + 1)::INT) || ' ' || line
    WHEN 1 THEN '**' || w0 || '** ' || rest || ' [*' || w1 || '*](http://a.example)'
    WHEN 2 THEN a || CASE WHEN k % 2 = 1 THEN '  ' ELSE '' END || chr(10) || b
    WHEN 3 THEN '- ' || w0 || chr(10) || '  - *' || w1 || '*' || chr(10) || '    1. ' || w2 || chr(10) || '  - ' || rest || chr(10) || '- ' || w0
    WHEN 4 THEN '```py' || chr(10) || line || chr(10) || '# ' || w0 || chr(10) || '```'
    WHEN 5 THEN '| ' || w0 || ' | `' || w1 || '` |' || chr(10) || '| --- | :-: |' || chr(10) || '| ' || rest || ' | a \| b |'
    WHEN 6 THEN '> ' || line || chr(10) || '>' || chr(10) || '> ~~' || w0 || '~~' || chr(10) || 'lazy ' || w1
    WHEN 7 THEN '---' WHEN 8 THEN '$$' || chr(10) || ' ' || line || ' ' || chr(10) || '$$'
    WHEN 9 THEN '![**' || w0 || '**](img/' || w1 || '.png) ' || line
    WHEN 10 THEN line || chr(10) || '===' ELSE '    ' || line || chr(10) || '    ' || w0 END AS t
  FROM parts
), dressed AS (
  SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '# Title ' || doc_id || chr(10) || chr(10) ELSE '' END || coalesce(string_agg(t, chr(10) || chr(10) ORDER BY k), '') AS text
  FROM (SELECT doc_id FROM documents) d LEFT JOIN snippets USING (doc_id) GROUP BY doc_id
)"""


def shown(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Blocks with their runs and cells as text: marks and texts of marked runs, cells between bars."""
    marked = F.filter(F.coalesce("runs", F.array().cast(f"array<{MD.RUN}>")), lambda r: F.size(r["marks"]) > 0)
    said = F.array_join(F.transform(marked, lambda r: F.concat(F.array_join(r["marks"], "+"), F.lit(":"), r["text"])), ";")
    return rows.select(key, "place", "part", "top", "depth", "kind", "level", "ordered", "text", said.alias("marks"), F.array_join("cells", "|").alias("cells"), "src")


def s07_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(MD.markdown_blocks(dressed(spark, sf_dir), "doc_id", "text"))


#: Chunks between blank lines, each known by how it begins.
_S07 = rf"""
WITH {_DRESSED}, chunks AS (
  SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS c, unnest(range(len(string_split(text, chr(10) || chr(10))))) AS n FROM dressed WHERE text <> ''
), lines AS (
  SELECT doc_id, n, c, unnest(string_split(c, chr(10))) AS line, unnest(range(len(string_split(c, chr(10))))) AS i FROM chunks
), found AS (
  SELECT doc_id, n, 0 AS i, 0 AS part, CASE WHEN n = 0 AND c LIKE '# %' THEN 'title' ELSE 'heading' END AS kind, length(regexp_extract(c, '^#+')) AS level, 0 AS depth, NULL::BOOLEAN AS ordered, regexp_replace(c, '^#+ ', '') AS text, '' AS marks, NULL AS cells, NULL AS src FROM chunks WHERE c LIKE '#%'
  UNION ALL SELECT doc_id, n, 0, 0, 'heading', 1, 0, NULL, c[: -5], '', NULL, NULL FROM chunks WHERE c LIKE '%' || chr(10) || '==='
  UNION ALL SELECT doc_id, n, 0, 0, 'rule', NULL, 0, NULL, '', '', NULL, NULL FROM chunks WHERE c = '---'
  UNION ALL SELECT doc_id, n, 0, 0, 'math', NULL, 0, NULL, c[5 : -5], '', NULL, NULL FROM chunks WHERE c LIKE '$$%'
  UNION ALL SELECT doc_id, n, 0, 0, 'code', NULL, 0, NULL, c[7 : -5], '', NULL, NULL FROM chunks WHERE c LIKE '```%'
  UNION ALL SELECT doc_id, n, 0, 0, 'code', NULL, 0, NULL, replace(c[5 :], chr(10) || '    ', chr(10)), '', NULL, NULL FROM chunks WHERE c LIKE '    %'
  UNION ALL SELECT doc_id, n, i, 0, 'row', (i = 0)::INT, 0, NULL, '', '', replace(replace(replace(line[3 : -3], ' | ', '|'), '`', ''), '\|', '|'), NULL FROM lines WHERE c LIKE '| %' AND i <> 1
  UNION ALL SELECT doc_id, n, i, 0, 'item', NULL, length(regexp_extract(line, '^ *')) // 2 + 1, line LIKE '%1. %', replace(regexp_replace(line, '^ *(-|1\.) ', ''), '*', ''),
    CASE WHEN line LIKE '%*%' THEN 'italic:' || regexp_extract(line, '\*(.*)\*', 1) ELSE '' END, NULL, NULL FROM lines WHERE c LIKE '- %'
  UNION ALL SELECT doc_id, n, 0, 0, 'quote', NULL, 1, NULL, line[3 :], '', NULL, NULL FROM lines WHERE c LIKE '> %' AND i = 0
  UNION ALL SELECT doc_id, n, 1, 0, 'quote', NULL, 1, NULL, regexp_replace(regexp_extract(c, '~~[^~]*~~(?s:.*)$'), '[~]|' || chr(10), '', 'g'), 'strike:' || regexp_extract(c, '~~([^~]*)~~', 1), NULL, NULL FROM chunks WHERE c LIKE '> %'
  UNION ALL SELECT doc_id, n, 0, p, CASE p WHEN 0 THEN 'figure' ELSE 'paragraph' END, NULL, 0, NULL, CASE p WHEN 0 THEN regexp_extract(c, '^!\[([^\]]*)\]', 1) ELSE regexp_extract(c, '\) (.*)$', 1) END, '', NULL, CASE p WHEN 0 THEN regexp_extract(c, '\(([^)]*)\)', 1) END FROM chunks, range(2) r(p) WHERE c LIKE '![%'
  UNION ALL SELECT doc_id, n, 0, 0, 'paragraph', NULL, 0, NULL, regexp_replace(regexp_replace(c, '\(.*\)$', ''), '[\[\]*]', '', 'g'), 'bold:' || regexp_extract(c, '^\*\*([^*]*)', 1) || ';italic:' || regexp_extract(c, '\[\*([^*]*)', 1), NULL, NULL FROM chunks WHERE c LIKE '**%'
  UNION ALL SELECT doc_id, n, 0, 0, 'paragraph', NULL, 0, NULL, replace(replace(replace(c, '  ' || chr(10), chr(11)), chr(10), ' '), chr(11), chr(10)), '', NULL, NULL FROM chunks WHERE regexp_matches(c, '^\p{{L}}') AND c NOT LIKE '%' || chr(10) || '==='
), led AS (SELECT doc_id, 1 AS up FROM found WHERE n = 0 AND kind IN ('title', 'heading') AND level = 1)
SELECT doc_id, (dense_rank() OVER (PARTITION BY doc_id ORDER BY n, i) - 1)::INT AS place, part::INT AS part,
  (dense_rank() OVER (PARTITION BY doc_id ORDER BY n) - 1)::INT AS top, depth::INT AS depth, CASE WHEN n = 0 AND kind = 'heading' AND level = 1 THEN 'title' ELSE kind END AS kind,
  CASE WHEN kind = 'row' THEN level WHEN kind = 'heading' AND NOT (n = 0 AND level = 1) THEN least(3, greatest(1, level - coalesce(up, 0))) END::INT AS level,
  ordered, CASE WHEN kind = 'quote' AND i = 1 THEN replace(text, 'lazy', ' lazy') ELSE text END AS text, marks, cells, src
FROM found LEFT JOIN led USING (doc_id)
"""


def typeset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): every line of every document as LaTeX, of a kind that follows from its id and number."""
    docs = S.table(spark, sf_dir, "documents").select("doc_id", "text")
    clean = lambda t: F.trim(F.regexp_replace(F.regexp_replace(F.translate(t, _MARKS + "%{}^", ""), "[ \t\r\x0b\x0c]+", " "), r"^[^\p{L}]+", ""))
    lines = F.filter(F.transform(F.split("text", "\n"), clean), lambda t: t != "")

    def block(line: Column, k: Column) -> Column:
        w = F.split(line, " ")
        word = lambda i: F.coalesce(F.get(w, F.lit(i)), F.lit("x"))
        kind = (F.col("doc_id") + 3 * k + F.floor(k / 10)) % 10
        sub = F.repeat(F.lit("sub"), k % 3)
        cases = [
            F.concat(F.lit("\\"), sub, F.lit("section*{"), line, F.lit(" \\textbf{"), word(0), F.lit("}}")),
            F.concat(word(0), F.lit(" \\textbf{"), word(1), F.lit(" \\emph{"), word(2), F.lit("} "), line, F.lit("} 50\\% ~\\cite{a}$x_1$ % gone {\n\\noindent \\textsf{"), word(1), F.lit("}\\\\"), word(2)),
            F.concat(F.lit("\\begin{itemize}\n\\item "), line, F.lit("\n\\item \\texttt{"), word(0), F.lit("}\n\\end{itemize}")),
            F.concat(F.lit("\\begin{enumerate}\\item "), word(0), F.lit("\\item "), word(1), F.lit("\\end{enumerate}")),
            F.concat(F.lit("\\begin{quote}\n"), line, F.lit("\n \n"), word(0), F.lit("\n\\end{quote}")),
            F.concat(F.lit("\\begin{equation*}\n "), word(0), F.lit(" = \\frac{1}{2}\n\\end{equation*}")),
            F.concat(F.lit("\\begin{verbatim}\n"), line, F.lit("\n  \\item {\n\\end{verbatim}")),
            F.concat(F.lit("\\begin{table}[h]\n\\caption{\\emph{"), word(0), F.lit("} "), word(1), F.lit("}\n\\begin{tabular}{|l|p{2cm}|}\n\\hline\n"), word(0), F.lit(" & "), word(1), F.lit(" \\\\ \\hline\n"), line, F.lit(" & \\textbf{"), word(2), F.lit("} \\\\\n\\end{tabular}\n\\end{table}")),
            F.concat(F.lit("\\begin{figure}\\includegraphics[width=1cm]{"), word(0), F.when(k % 2 == 0, F.concat(F.lit("}\\caption{"), line, F.lit("}"))).otherwise("}"), F.lit("\\end{figure}")),
            F.concat(F.lit("\\begin{center}\n"), line, F.lit("\n\\begin{mybox}\n\\textit{"), word(0), F.lit("}\n\\end{mybox}\n\\end{center}")),
        ]
        out = F.lit(None).cast("string")
        for i, c in enumerate(cases):
            out = F.when(kind == i, c).otherwise(out)
        return out

    body = F.array_join(F.transform(lines, block), "\n\n")
    whole = F.concat(F.lit("\\documentclass{article}\n\\title{On \\emph{document} "), F.col("doc_id"), F.lit("}\n\\begin{document}\n\\maketitle\n\n"), body, F.lit("\n\\end{document}\n"))
    return docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, whole).otherwise(body).alias("text"))


def s10_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = TEX.latex_blocks(typeset(spark, sf_dir), "doc_id", "text")
    return shown(rows.withColumn("place", F.lit(0))).drop("place", "top")


#: What each line of typeset() is to give, from its words: the text is made by concatenation, so no parser is needed.
_S10 = rf"""
WITH cleaned AS (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda t: trim(regexp_replace(regexp_replace(translate(t, '{_SQL_MARKS}%{{}}^', ''), '[ \t\r\x0b\x0c]+', ' ', 'g'), '^[^\p{{L}}]+', ''))), lambda t: t <> '') AS ls
  FROM documents
), ls AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS k FROM cleaned),
p AS (
  SELECT doc_id, k, line, (doc_id + 3 * k + k // 10) % 10 AS kind, string_split(line, ' ')[1] AS w0, coalesce(string_split(line, ' ')[2], 'x') AS w1, coalesce(string_split(line, ' ')[3], 'x') AS w2 FROM ls
), found AS (
  SELECT doc_id, 0 AS part, 'title' AS kind, NULL AS level, 0 AS depth, NULL::BOOLEAN AS ordered, 'On document ' || doc_id AS text, '' AS marks, NULL AS cells, NULL AS src FROM documents WHERE doc_id % 2 = 0
  UNION ALL SELECT doc_id, 0, 'heading', k % 3 + 1, 0, NULL, line || ' ' || w0, 'bold:' || w0, NULL, NULL FROM p WHERE kind = 0
  UNION ALL SELECT doc_id, 0, 'paragraph', NULL, 0, NULL, w0 || ' ' || w1 || ' ' || w2 || ' ' || line || ' 50%  x_1 ' || chr(10) || ' ' || w1 || chr(10) || w2, 'bold:' || w1 || ' ;bold+italic:' || w2 || ';bold: ' || line || ';math:x_1', NULL, NULL FROM p WHERE kind = 1
  UNION ALL SELECT doc_id, 0, 'item', NULL, 1, false, line, '', NULL, NULL FROM p WHERE kind = 2
  UNION ALL SELECT doc_id, 1, 'item', NULL, 1, false, w0, 'code:' || w0, NULL, NULL FROM p WHERE kind = 2
  UNION ALL SELECT doc_id, i, 'item', NULL, 1, true, CASE i WHEN 0 THEN w0 ELSE w1 END, '', NULL, NULL FROM p, range(2) r(i) WHERE kind = 3
  UNION ALL SELECT doc_id, i, 'quote', NULL, 1, NULL, CASE i WHEN 0 THEN line ELSE w0 END, '', NULL, NULL FROM p, range(2) r(i) WHERE kind = 4
  UNION ALL SELECT doc_id, 0, 'math', NULL, 0, NULL, w0 || ' = \frac{{1}}{{2}}', '', NULL, NULL FROM p WHERE kind = 5
  UNION ALL SELECT doc_id, 0, 'code', NULL, 0, NULL, line || chr(10) || '  \item {{', '', NULL, NULL FROM p WHERE kind = 6
  UNION ALL SELECT doc_id, 0, 'caption', NULL, 0, NULL, w0 || ' ' || w1, 'italic:' || w0, NULL, NULL FROM p WHERE kind = 7
  UNION ALL SELECT doc_id, i + 1, 'row', 1 - i, 0, NULL, '', '', CASE i WHEN 0 THEN w0 || '|' || w1 ELSE line || '|' || w2 END, NULL FROM p, range(2) r(i) WHERE kind = 7
  UNION ALL SELECT doc_id, 0, 'figure', NULL, 0, NULL, CASE WHEN k % 2 = 0 THEN line ELSE '[' || w0 || ']' END, '', NULL, '' FROM p WHERE kind = 8
  UNION ALL SELECT doc_id, 0, 'paragraph', NULL, 0, NULL, CASE i WHEN 0 THEN line ELSE w0 END, CASE i WHEN 0 THEN '' ELSE 'italic:' || w0 END, NULL, NULL FROM p, range(2) r(i) WHERE kind = 9
)
SELECT doc_id, part::INT AS part, depth::INT AS depth, kind, level::INT AS level, ordered, text, marks, cells, src FROM found
"""


def f02_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first caption of each document, braces balanced."""
    return typeset(spark, sf_dir).select("doc_id", TEX.argument_of(F.col("text"), "\\caption").alias("caption"))


_TYPESET_LINES = _S10[: _S10.index("), found AS")] + ")"
_F02 = (
    _TYPESET_LINES
    + r""", c AS (SELECT doc_id, k, CASE kind WHEN 7 THEN '\emph{' || w0 || '} ' || w1 ELSE line END AS caption FROM p WHERE kind = 7 OR kind = 8 AND k % 2 = 0)
SELECT d.doc_id, coalesce((SELECT first(caption ORDER BY k) FROM c WHERE c.doc_id = d.doc_id), '') AS caption FROM documents d"""
)


def f07_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and whether the body was found between the bounds of a document."""
    rows = TEX.parts(typeset(spark, sf_dir), "doc_id", "text")
    return rows.select(F.col("key").alias("doc_id"), "title", F.col("body").contains("maketitle").alias("bounded"), F.col("body").contains("documentclass").alias("preamble"))


_F07 = r"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'On document ' || doc_id ELSE '' END AS title, doc_id % 2 = 0 AS bounded, false AS preamble FROM documents"


def filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, filename, text): documents as files of five kinds, one of which has no reader."""
    kind = F.col("doc_id") % 5
    name = F.concat(F.lit("in/Doc."), F.col("doc_id"), F.when(kind == 0, ".md").when(kind == 1, ".TEX").when(kind == 2, ".txt").when(kind == 3, ".odt").otherwise(""))
    docs = S.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("plain"))
    both = docs.join(dressed(spark, sf_dir).withColumnRenamed("text", "md"), "doc_id").join(typeset(spark, sf_dir).withColumnRenamed("text", "tex"), "doc_id")
    return both.select("doc_id", name.alias("filename"), F.when(kind == 0, F.col("md")).when(kind == 1, F.col("tex")).otherwise(F.col("plain")).alias("text"))


def s05_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles, blocks = IN.imported(filed(spark, sf_dir), "doc_id", "filename", "text")
    counts = blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.char_length("text")).alias("chars"))
    return titles.join(counts, "doc_id", "left").select("doc_id", "title", "kind", F.coalesce("blocks", F.lit(0).cast("long")).alias("blocks"), F.coalesce("chars", F.lit(0).cast("long")).alias("chars"))


_S05 = rf"""
WITH md AS ({_S07}), tex AS ({_S10}),
plain AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\n[ \t]*\n')) AS t FROM documents),
blocks AS (
  SELECT doc_id, kind, text FROM md WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, kind, text FROM tex WHERE doc_id % 5 = 1
  UNION ALL SELECT doc_id, 'paragraph', regexp_replace(t, '^[\s\x0b]+|[\s\x0b]+$', '', 'g') FROM plain WHERE doc_id % 5 = 2 AND regexp_matches(t, '[^\s\x0b]')
), titles AS (SELECT doc_id, any_value(text) FILTER (WHERE kind = 'title') AS title, count(*) FILTER (WHERE kind <> 'title') AS n, sum(length(text)) FILTER (WHERE kind <> 'title') AS chars FROM blocks GROUP BY doc_id)
SELECT d.doc_id, coalesce(nullif(trim(title), ''), CASE WHEN d.doc_id % 5 = 4 THEN 'Doc' ELSE 'Doc.' || d.doc_id END)[1 : 300] AS title,
  CASE d.doc_id % 5 WHEN 0 THEN 'markdown' WHEN 1 THEN 'latex' WHEN 2 THEN 'text' END AS kind, coalesce(n, 0) AS blocks, coalesce(chars, 0)::BIGINT AS chars
FROM documents d LEFT JOIN titles t ON t.doc_id = d.doc_id
"""


def _rendered(form: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        blocks = MD.markdown_blocks(dressed(spark, sf_dir), "doc_id", "text")
        return RE.rendered(blocks, S.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", form)

    return query


def _render_sql(title: str, sep: str, cases: dict[int, str], end: str) -> str:
    """The text of each document from the words that dressed() made its lines of."""
    kinds = " ".join(f"WHEN {k} THEN {c}" for k, c in cases.items())
    return rf"""WITH {_DRESSED}, d AS (SELECT doc_id, doc_id % 3 = 0 OR doc_id % 12 = 10 AND EXISTS (SELECT 1 FROM parts p WHERE p.doc_id = documents.doc_id) AS led FROM documents),
      t AS (SELECT doc_id, led, CASE WHEN doc_id % 3 = 0 THEN 'Title ' || doc_id WHEN led THEN (SELECT line FROM parts p WHERE p.doc_id = d.doc_id AND k = 0) ELSE '(untitled)' END AS title FROM d),
      h AS (SELECT p.*, least(3, greatest(1, CASE WHEN kind = 10 THEN 1 ELSE k % 4 + 1 END - led::INT)) AS lv FROM parts p JOIN d USING (doc_id) WHERE NOT (k = 0 AND doc_id % 12 = 10)),
      b AS (SELECT doc_id, string_agg({sep} || CASE kind {kinds} END, '' ORDER BY k) AS body FROM h GROUP BY doc_id)
      SELECT t.doc_id, {title} || coalesce(body, '') || {end} AS text FROM t LEFT JOIN b ON b.doc_id = t.doc_id"""


_N = "chr(10)"
_BREAK = f"CASE WHEN k % 2 = 1 THEN a || b ELSE a || ' ' || b END"
_F09 = _render_sql(
    "'# ' || title",
    f"{_N} || {_N}",
    {
        0: "repeat('#', (lv + 1)::INT) || ' ' || line",
        1: "'**' || w0 || '** ' || rest || ' *' || w1 || '*'",
        2: _BREAK,
        3: f"'- ' || w0 || {_N} || '- ' || w0",
        4: f"'```' || {_N} || line || {_N} || '# ' || w0 || {_N} || '```'",
        5: f"'| ' || w0 || ' | ' || w1 || ' |' || {_N} || '| --- | --- |' || {_N} || '| ' || rest || ' | a | b |'",
        6: f"'> ' || line || {_N} || '> ~~' || w0 || '~~ lazy ' || w1",
        7: "'---'",
        8: f"'$$' || {_N} || line || {_N} || '$$'",
        9: f"'![**' || w0 || '**](img/' || w1 || '.png)' || {_N} || '***' || w0 || '***' || {_N} || {_N} || line",
        10: "repeat('#', (lv + 1)::INT) || ' ' || line",
        11: f"'```' || {_N} || line || {_N} || w0 || {_N} || '```'",
    },
    _N,
)
_F11 = _render_sql(
    "title",
    f"{_N} || {_N}",
    {
        0: "line",
        1: "w0 || ' ' || rest || ' ' || w1",
        2: _BREAK,
        3: f"'- ' || w0 || {_N} || '- ' || w0",
        4: f"line || {_N} || '# ' || w0",
        5: f"w0 || chr(9) || w1 || {_N} || rest || chr(9) || 'a | b'",
        6: _N,
        7: "''",
        8: "'$' || line || '$'",
        9: f"'[圖: **' || w0 || '**]' || {_N} || {_N} || line",
        10: "line",
        11: f"line || {_N} || w0",
    },
    _N,
)
_F11 = f"SELECT doc_id, regexp_replace(text, '\\s+$', '') || chr(10) AS text FROM ({_F11}) x"
_E = lambda x: f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_F12 = _render_sql(
    f"'<h1>' || {_E('title')} || '</h1>'",
    "''",
    {
        0: f"'<h' || least(lv + 1, 4) || '>' || {_E('line')} || '</h' || least(lv + 1, 4) || '>'",
        1: f"'<p><strong>' || {_E('w0')} || '</strong> ' || {_E('rest')} || ' <em>' || {_E('w1')} || '</em></p>'",
        2: f"'<p>' || {_E(_BREAK)} || '</p>'",
        3: f"'<ul><li>' || {_E('w0')} || '</li><li>' || {_E('w0')} || '</li></ul>'",
        4: f"'<pre><code>' || {_E('line')} || {_N} || '# ' || {_E('w0')} || '</code></pre>'",
        5: f"'<table><tr><td>' || {_E('w0')} || '</td><td>' || {_E('w1')} || '</td></tr><tr><td>' || {_E('rest')} || '</td><td>a | b</td></tr></table>'",
        6: f"'<blockquote><p>' || {_E('line')} || '</p><p><s>' || {_E('w0')} || '</s> lazy ' || {_E('w1')} || '</p></blockquote>'",
        7: "'<hr>'",
        8: f"'<p>\\[' || {_E('line')} || '\\]</p>'",
        9: f"'<figure><img src=\"img/' || {_E('w1')} || '.png\" alt=\"**' || {_E('w0')} || '**\"><figcaption>**' || {_E('w0')} || '**</figcaption></figure><p>' || {_E('line')} || '</p>'",
        10: f"'<h' || least(lv + 1, 4) || '>' || {_E('line')} || '</h' || least(lv + 1, 4) || '>'",
        11: f"'<pre><code>' || {_E('line')} || {_N} || {_E('w0')} || '</code></pre>'",
    },
    "''",
)


def b17_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RE.outline(MD.markdown_blocks(dressed(spark, sf_dir), "doc_id", "text"), "doc_id")


_B17 = f"SELECT doc_id, place, level, text FROM ({_S07}) x WHERE kind = 'heading' AND trim(text) <> ''"


def b24_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RE.previews(MD.markdown_blocks(dressed(spark, sf_dir), "doc_id", "text"), "doc_id")


_B24 = f"SELECT doc_id, string_agg(coalesce(replace(replace(cells, 'a | b', 'a ¦ b'), '|', ''), text) || CASE WHEN kind IN ('heading', 'paragraph', 'item', 'more', 'quote') THEN chr(10) ELSE '' END, '' ORDER BY place, part) AS text FROM ({_S07}) x WHERE kind <> 'title' GROUP BY doc_id"
_B24 = f"SELECT doc_id, replace(text, '¦', '|') AS text FROM ({_B24}) y"


def b18_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables with their caption and rows, of the LaTeX blocks."""
    rows = TEX.latex_blocks(typeset(spark, sf_dir), "doc_id", "text").where("kind in ('row', 'caption')")
    own = rows.groupBy("doc_id", "top").agg(F.max(F.when(F.col("kind") == "caption", F.col("text"))).alias("caption"), F.sort_array(F.collect_list(F.when(F.col("kind") == "row", F.struct("part", F.array_join("cells", "|").alias("c"))))).alias("r"))
    return own.select("doc_id", "caption", F.array_join(F.transform("r", lambda x: x["c"]), "/").alias("rows"))


_B18 = _TYPESET_LINES + " SELECT doc_id, w0 || ' ' || w1 AS caption, w0 || '|' || w1 || '/' || line || '|' || w2 AS rows FROM p WHERE kind = 7"

QUERIES: dict[str, Query] = {"s07_blocks": s07_blocks, "s10_blocks": s10_blocks, "f02_captions": f02_captions, "f09_markdown": _rendered("markdown"), "f11_text": _rendered("text"), "f12_html": _rendered("html"), "b17_outline": b17_outline, "b18_tables": b18_tables, "b24_previews": b24_previews, "s05_imports": s05_imports, "f07_titles": f07_titles}
ORACLES: dict[str, str] = {"s07_blocks": _S07, "s10_blocks": _S10, "f02_captions": _F02, "f09_markdown": _F09, "f11_text": _F11, "f12_html": _F12, "b17_outline": _B17, "b18_tables": _B18, "b24_previews": _B24, "s05_imports": _S05, "f07_titles": _F07}
