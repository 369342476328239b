"""Queries of the evidence operators over the driver's tables, each with the same in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmine.functions import lexicon as lx
from quillmine.functions import scores, segments, text
from quillmine.operators import chunking, graph, layout, ner, retrieve, synth
from quillmine.plans import corpus as co
from quillmine.plans.corpus import ASCII, PRELUDE
from quillmine.sources import sinks
from quillmine.streaming.ingest import status_funnel

QUERY = "rewh orre thatin ononst inoran"
TERMS = QUERY.split()
NAME = "The"
TOPIC = "thatin"
Q, S = dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]
QUERIES: Q = {}
ORACLE: S = {}

#: Python's \w and \s as classes that both engines know.
_W = r"[\p{L}\p{N}_]"
_LIST = ", ".join(f"'{t}'" for t in TERMS)


def query(name: str, sql: str | None = None, prelude: bool = True):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = (PRELUDE + ", " + sql[5:].lstrip() if sql.startswith("WITH ") else PRELUDE + sql) if prelude else sql
        return f

    return add


def _fmt(template: str, x: str) -> str:
    return template.replace("{}", x)


def _docs(spark, d):
    return co.table(spark, d, "documents")


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _words(x: str) -> str:
    return rf"regexp_extract_all({x}, '[^\x09-\x0D\x20]+')"


# Text.

#: Put after each text: characters that NFKC and the ligatures change, with what they become. The tables hold none themselves.
_ODD = {"ﬁ": "fi", "ﬀ": "ff", "ﬃ": "ffi", "ﬆ": "st", "①": "1", "Ａ": "A", "½": "1⁄2", "㎏": "kg", "²": "2", "…": "...", "ℌ": "H", "ｶ": "カ"}
_TAIL = " " + " ".join(f"x{c}y" for c in _ODD)


def _normal_sql(x: str) -> str:
    for a, b in _ODD.items():
        x = f"replace({x}, '{a}', '{b}')"
    return x


def _odd(spark, d):
    return _docs(spark, d).select("doc_id", F.concat("text", F.lit(_TAIL)).alias("text"))

_CITES = rf"regexp_replace(regexp_replace({{}}, '\[\d+(?:[,\s]+\d+)*\]', '[CITE]', 'g'), '\({_W}[\p{{L}}\p{{N}}_\s]+et\s+al\.,?\s+\d{{4}}\)', '[CITE]', 'g')"
_LINES = "replace(replace(replace(replace({}, chr(10) || chr(10), chr(1) || chr(1)), chr(1) || chr(10), chr(1) || chr(1)), chr(10), ' '), chr(1), chr(10))"


@query("clean_citations", f"SELECT doc_id, {_fmt(_CITES, 'text')} AS cleaned FROM documents", False)
def _(spark, d):
    return _docs(spark, d).select("doc_id", text.mark_citations(F.col("text")).alias("cleaned"))


@query("clean_newlines", f"SELECT doc_id, {_LINES.format('text')} AS cleaned FROM documents", False)
def _(spark, d):
    return _docs(spark, d).select("doc_id", text.join_lines(F.col("text")).alias("cleaned"))


def _cleaned(text: str, aggressive: bool = False) -> str:
    x = rf"regexp_replace({text}, '({_W})-\n({_W})', '\1\2', 'g')"
    x = rf"regexp_replace({x}, '(?m)^[A-Z][A-Z\s\-]+:\s+[A-Z].{{5,60}}$', '', 'g')"
    x = rf"regexp_replace({x}, '(?m)^\s*\d{{1,4}}\s*$', '', 'g')"
    x = rf"regexp_replace({x}, '(\d)\s+\.\s+(\d)', '\1.\2', 'g')"
    x = rf"regexp_replace({_LINES.format(_fmt(_CITES, x))}, '[ \t]{{2,}}', ' ', 'g')"
    if aggressive:
        x = rf"replace(regexp_replace({x}, '(?m)^[\d\s.,%±\-–—]+$', '', 'g'), '[CITE]', '')"
        x = rf"regexp_replace(regexp_replace({x}, '\([^)]{{0,25}}\)', '', 'g'), '[ \t]{{2,}}', ' ', 'g')"
    return _strip(x)


_ODD_TEXT = _normal_sql(f"(text || '{_TAIL}')")


@query("clean_standard", f"SELECT doc_id, {_cleaned(_ODD_TEXT)} AS cleaned FROM documents", False)
def _(spark, d):
    return _odd(spark, d).select("doc_id", text.clean(F.col("text")).alias("cleaned"))


@query("clean_aggressive", f"SELECT doc_id, {_cleaned(_ODD_TEXT, True)} AS cleaned FROM documents", False)
def _(spark, d):
    return _odd(spark, d).select("doc_id", text.clean(F.col("text"), aggressive=True).alias("cleaned"))


@query("nfkc", f"SELECT doc_id, {_ODD_TEXT} AS normal FROM documents", False)
def _(spark, d):
    return _odd(spark, d).select("doc_id", text.nfkc(F.col("text")).alias("normal"))


@query("ws_collapse", f"SELECT doc_id, array_to_string({_words('text')}, ' ') AS collapsed FROM documents", False)
def _(spark, d):
    return _docs(spark, d).select("doc_id", text.collapse(F.col("text")).alias("collapsed"))


@query("canonical_key", r"SELECT DISTINCT workspace_id, name, regexp_replace(lower(name), '[\s\-_]', '', 'g') AS key FROM concepts")
def _(spark, d):
    c = co.concepts(spark, d).select("workspace_id", "name").distinct()
    return c.select("workspace_id", "name", text.canonical_key(F.col("name")).alias("key"))


@query("labels_normalised", """SELECT DISTINCT event_type, CASE WHEN lower(event_type) IN ('treats', 'inhibits', 'activates', 'correlates_with', 'causes', 'similar_to',
 'contradicts', 'part_of') THEN lower(event_type) ELSE 'correlates_with' END AS relation, CASE WHEN upper(event_type) IN ('DRUG', 'CHEMICAL_ENTITY') THEN 'CHEMICAL' ELSE 'CONCEPT' END AS label FROM events""", False)  # fmt: skip
def _(spark, d):
    e = co.table(spark, d, "events").select("event_type").distinct()
    return e.select("event_type", text.relation_label(F.col("event_type")).alias("relation"), text.entity_label(F.col("event_type")).alias("label"))


@query("json_recovered", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events", False)
def _(spark, d):
    e = co.table(spark, d, "events")
    v = text.recovered_json(F.concat(F.lit("reply:\n```json\n"), F.col("props"), F.lit("\n```")))
    return e.select("event_id", F.try_variant_get(v, "$.k", "string").alias("k"))


@query("author_display", """SELECT p_brand AS grp, CASE WHEN count(*) > 4 THEN array_to_string((list(p_name ORDER BY p_partkey))[1:4], ', ') || ' +' || (count(*) - 4)
 ELSE array_to_string(list(p_name ORDER BY p_partkey), ', ') END AS shown FROM part GROUP BY 1""", False)  # fmt: skip
def _(spark, d):
    p = co.table(spark, d, "part").groupBy(F.col("p_brand").alias("grp")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))).alias("n"))
    return p.select("grp", text.author_line(F.transform("n", lambda x: x["p_name"])).alias("shown"))


# Document structure. Layout lines: a document's lines, each seventh replaced by a header.

_HEADERS = ("1. Introduction", "METHODS", "Results.", "References", "II. Discussion", "Appendix", "Abstract", "Conclusion and Future Work")
_LINES_CTE = f"""lines AS (
  SELECT doc_id AS paper_id, 0 AS page, CAST(ord AS INT) AS ord,
         CASE WHEN (doc_id + ord) % 7 = 3 THEN ([{", ".join(f"'{h}'" for h in _HEADERS)}])[1 + CAST((doc_id + ord) % 8 AS INT)] ELSE line END AS text,
         CAST(9 + (doc_id + ord * 3) % 8 AS DOUBLE) AS size, ord % 2 = 0 AS bold, CAST(ord * 20 AS DOUBLE) AS y
  FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS ord, unnest(string_split(text, chr(10))) AS line FROM documents))"""


def _lines(spark, d):
    x = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ord", "line"))
    key = F.col("doc_id") + F.col("ord")
    h = F.get(F.array(*[F.lit(h) for h in _HEADERS]), (key % 8).cast("int"))
    return x.select(
        F.col("doc_id").alias("paper_id"), F.lit(0).alias("page"), "ord", F.when(key % 7 == 3, h).otherwise(F.col("line")).alias("text"),
        (9 + (F.col("doc_id") + F.col("ord") * 3) % 8).cast("double").alias("size"), (F.col("ord") % 2 == 0).alias("bold"), (F.col("ord") * 20).cast("double").alias("y"),
    )


_NORMAL = r"""trim(regexp_replace(regexp_replace(trim(lower({})), '^[!-/:-@\[-`{{-~]+|[!-/:-@\[-`{{-~]+$', '', 'g'), '^(?:\d+(?:\.\d+)*\.?\s+|[ivx]+\.\s+)', ''))"""
_HEADER_SQL = (
    f"CASE WHEN length(text) < 80 AND {_NORMAL.format('text')} IN ({', '.join(repr(x) for x in lx.SKIP_HEADERS)}) AND (bold OR size >= 10.5) THEN 'SKIP' "
    f"WHEN length(text) < 80 AND (bold OR size >= 11) THEN CASE {_NORMAL.format('text')} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in lx.HEADERS.items())} END END"
)
_HEADED = f"headed AS (SELECT *, {_HEADER_SQL} AS header FROM lines WHERE trim(text) <> '')"
_SECTIONED = f"""{_LINES_CTE}, {_HEADED}, assigned AS (
  SELECT *, coalesce(last_value(header IGNORE NULLS) OVER (PARTITION BY paper_id ORDER BY page, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'other') AS section FROM headed)"""


@query("header_classify", f"WITH {_LINES_CTE}, {_HEADED} SELECT paper_id, ord, header FROM headed WHERE header IS NOT NULL")
def _(spark, d):
    x = _lines(spark, d).where(text.strip(F.col("text")) != "").withColumn("header", layout.header(F.col("text"), F.col("size"), F.col("bold")))
    return x.where("header is not null").select("paper_id", "ord", "header")


@query("section_assign", f"WITH {_SECTIONED} SELECT paper_id, section, string_agg(text, chr(10) ORDER BY page, ord) AS text FROM assigned WHERE header IS NULL AND section <> 'SKIP' GROUP BY 1, 2")
def _(spark, d):
    return layout.sections(_lines(spark, d)).select("paper_id", "section", "text")


_TITLE_OK = (
    "y <= top AND length(t) BETWEEN 15 AND 280 AND NOT regexp_matches(t, '^\\d+$') AND NOT regexp_matches(t, '^[A-Z][A-Z\\s\\-]{10,}$') AND NOT contains(t, '@') "
    "AND NOT regexp_matches(t, '(?i)doi|arxiv|preprint') AND t <> upper(t) AND "
    f"{_NORMAL.format('t')} NOT IN ({', '.join(repr(x) for x in (*lx.HEADERS, *lx.SKIP_HEADERS))})"
)


@query("title_detect", f"""WITH {_LINES_CTE}, z AS (SELECT *, {_strip('text')} AS t, max(y) OVER (PARTITION BY paper_id) * 0.45e0 AS top FROM lines),
 best AS (SELECT paper_id, t, row_number() OVER (PARTITION BY paper_id ORDER BY size DESC, y DESC, ord) AS k FROM z WHERE {_TITLE_OK})
 SELECT p.doc_id AS paper_id, coalesce(b.t, 'Unknown Title') AS title FROM documents p LEFT JOIN best b ON b.paper_id = p.doc_id AND b.k = 1""")  # fmt: skip
def _(spark, d):
    return layout.titles(_lines(spark, d))


_BEST_TITLE = f"""z AS (SELECT *, {_strip('text')} AS t, max(y) OVER (PARTITION BY paper_id) * 0.45e0 AS top, max(y) OVER (PARTITION BY paper_id) AS bottom FROM lines),
 best AS (SELECT paper_id, t AS title, row_number() OVER (PARTITION BY paper_id ORDER BY size DESC, y DESC, ord) AS k FROM z WHERE {_TITLE_OK})"""
_NOT_OF = " AND ".join(f"NOT contains(lower(t), '{a}')" for a in lx.AFFILIATIONS)
_PARTS = f"regexp_split_to_array(t, '{lx.AUTHOR_SPLIT}')"


@query("author_detect", rf"""WITH {_LINES_CTE}, {_BEST_TITLE}, near AS (SELECT z.*, coalesce(b.title, '{lx.UNKNOWN_TITLE}') AS title FROM z LEFT JOIN best b ON b.paper_id = z.paper_id AND b.k = 1),
 ok AS (SELECT * FROM near WHERE y > bottom * 0.08e0 AND y < bottom * 0.52e0 AND size > 8.5e0 AND size < 13.5e0 AND length(t) <= 180
 AND NOT (title <> '' AND contains(lower(t), lower(substr(title, 1, 30)))) AND NOT regexp_matches(t, '\d{{3,}}') AND {_NOT_OF}),
 pieces AS (SELECT paper_id, ord, unnest(range(len({_PARTS}))) AS place, unnest({_PARTS}) AS part FROM ok),
 names AS (SELECT paper_id, ord, place, {_strip("regexp_replace(" + _strip('part') + ", '" + lx.AUTHOR_MARKS + "', '')")} AS name FROM pieces),
 fit AS (SELECT paper_id, lower(name) AS key, min((ord, place, name)) AS f FROM names WHERE length(name) > 4 AND length(name) < 60 AND regexp_matches(name, '{lx.AUTHOR_NAME}') GROUP BY 1, 2)
 SELECT paper_id, list_transform(list_sort(list(f)), lambda x: x[3])[1:12] AS authors FROM fit GROUP BY 1""")  # fmt: skip
def _(spark, d):
    x = _lines(spark, d)
    return layout.authors(x, layout.titles(x))


_YEAR = r"TRY_CAST(nullif(regexp_extract({0}, '\b(19|20)\d{{2}}\b', 0), '') AS INT)"


@query("metadata_year_doi", rf"""SELECT doc_id AS id, {_YEAR.format("(text || ' 10.1234/abc' || doc_id % 50)")} AS publication_year,
 CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY regexp_extract(text || ' 10.1234/abc' || doc_id % 50, '(?i)10\.\d{{4,9}}/[-._;()/:A-Z0-9]+', 0))
 THEN regexp_extract(text || ' 10.1234/abc' || doc_id % 50, '(?i)10\.\d{{4,9}}/[-._;()/:A-Z0-9]+', 0) END AS doi FROM documents""", False)  # fmt: skip
def _(spark, d):
    p = _docs(spark, d).select(
        F.col("doc_id").alias("id"), F.col("text").alias("title"), F.lit(None).cast("string").alias("abstract"),
        F.concat(F.lit("10.1234/abc"), (F.col("doc_id") % 50).cast("string")).alias("metadata"),
    )
    return layout.metadata(p).select("id", "publication_year", "doi")


_PAGE_TEXT = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g'), '(?i)<(h[1-6]|title)\b[^>]*>', chr(10) || chr(2), 'g'), '(?i)</?(p|div|li|ul|ol|br|h[1-6]|article|nav|footer|title|body|head)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g')"


@query("page_lines", rf"""WITH l AS (SELECT page_id, unnest(range(len(string_split({_PAGE_TEXT}, chr(10))))) AS ord, unnest(string_split({_PAGE_TEXT}, chr(10))) AS raw FROM pages)
 SELECT page_id AS paper_id, CAST(ord AS INT) AS ord, array_to_string({_words("replace(raw, chr(2), '')")}, ' ') AS text, contains(raw, chr(2)) AS bold FROM l
 WHERE len({_words("replace(raw, chr(2), '')")}) > 0""", False)  # fmt: skip
def _(spark, d):
    return layout.page_lines(co.table(spark, d, "pages")).select("paper_id", "ord", "text", "bold")


@query("reference_split", r"""SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*(?:\[\d+\]|\d+\.)\s*'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')),
 lambda x: length(x) > 10) AS refs FROM documents""", False)  # fmt: skip
def _(spark, d):
    return _docs(spark, d).select("doc_id", layout.references(F.col("text")).alias("refs"))


# Segmentation.

_NAIVE = "regexp_split_to_array(regexp_replace({}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"


@query("sentence_naive", f"""WITH s AS (SELECT doc_id, unnest(range(len({_NAIVE.format('text')}))) AS place, unnest({_NAIVE.format('text')}) AS raw FROM documents)
 SELECT doc_id, CAST(place AS INT) AS place, array_to_string({_words('raw')}, ' ') AS sentence FROM s""", False)  # fmt: skip
def _(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(segments.naive_sentences(F.col("text"))).alias("place", "sentence"))


_NB = ", ".join(f"'{x}'" for x in lx.NO_BREAK)


def _sentences(of: str, keys: str, source: str, x: str) -> str:
    """CTEs that end in of (keys, place, sentence): the sentences of the text x of each row of source, which keys tell apart."""
    return rf"""{of}_m AS (SELECT {keys}, string_split(regexp_replace(array_to_string({_words(x)}, ' '), '([.!?])( [A-Z\d])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS p FROM {source}),
 {of}_u AS (SELECT {keys}, unnest(range(len(p))) AS i, unnest(p) AS piece, len(p) AS n FROM {of}_m),
 {of}_t AS (SELECT *, lower(regexp_replace(regexp_extract(trim(regexp_replace(piece, '[.!?]$', '')), '(\S+)$', 1), '^[.!?;:,()\[\]{{}}]+|[.!?;:,()\[\]{{}}]+$', '', 'g')) AS tok FROM {of}_u),
 {of}_b AS (SELECT *, CASE WHEN i = n - 1 THEN 0 WHEN tok IN ({_NB}) OR regexp_matches(piece, '\d.$') OR regexp_matches(tok, '^\p{{L}}$') THEN 0 ELSE 1 END AS cut FROM {of}_t),
 {of}_g AS (SELECT *, coalesce(sum(cut) OVER (PARTITION BY {keys} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM {of}_b),
 {of}_j AS (SELECT {keys}, grp, trim(string_agg(piece, '' ORDER BY i)) AS sentence FROM {of}_g GROUP BY ALL),
 {of} AS (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY grp) AS place, sentence FROM {of}_j WHERE length(sentence) > {lx.MIN_SENTENCE})"""


def _packs(of: str, sentences: str) -> str:
    """CTEs that end in of (doc_id, pack, text): sentences of each doc_id, put together up to the words of a pack."""
    return f"""{of}_w AS (SELECT *, len({_words('sentence')}) AS w FROM {sentences}),
 {of}_p AS (SELECT doc_id, place, w AS used, 0 AS pack FROM {of}_w WHERE place = 1
 UNION ALL SELECT s.doc_id, s.place, CASE WHEN p.used + s.w > {lx.PACK_WORDS} THEN s.w ELSE p.used + s.w END, CASE WHEN p.used + s.w > {lx.PACK_WORDS} THEN p.pack + 1 ELSE p.pack END
 FROM {of}_p p JOIN {of}_w s ON s.doc_id = p.doc_id AND s.place = p.place + 1),
 {of} AS (SELECT doc_id, pack, string_agg(sentence, ' ' ORDER BY place) AS text FROM {of}_p JOIN {of}_w USING (doc_id, place) GROUP BY 1, 2)"""


@query("sentence_scientific", f"WITH {_sentences('s', 'doc_id', 'documents', 'text')} SELECT doc_id, list(sentence ORDER BY place) AS sentences FROM s GROUP BY 1")
def _(spark, d):
    x = _docs(spark, d).select("doc_id", segments.flat_sentences(F.col("text")).alias("sentences"))
    return x.where(F.size("sentences") > 0)


_WEIGH = "CASE section " + " ".join(f"WHEN '{k}' THEN {w}e0" for k, w in lx.SECTION_WEIGHT.items()) + f" ELSE {lx.DEFAULT_WEIGHT}e0 END"
_BONUS = rf"""(CASE WHEN {co._any(lx.CLAIM_TERMS).replace('text', 'content')} THEN 0.07e0 ELSE 0e0 END + CASE WHEN regexp_matches(content, '{lx.PERCENT}') THEN 0.05e0 ELSE 0e0 END
 + CASE WHEN {co._any(lx.CONTRAST_TERMS).replace('text', 'content')} THEN 0.03e0 ELSE 0e0 END)"""
_HALVES = f"CASE WHEN len(w) * {lx.TOKENS_PER_WORD} > {lx.MAX_TOKENS} THEN [array_to_string(w[1:len(w) // 2], ' '), array_to_string(w[len(w) // 2 + 1:], ' ')] ELSE [text] END"


@query("chunk_sections", f"""WITH cl AS (SELECT doc_id, section, {_cleaned('text')} AS c FROM parts), {_sentences('s', 'doc_id', 'cl', 'c')}, {_packs('pk', 's')},
 kind AS (SELECT doc_id, section, c, section IN ({', '.join(repr(x) for x in lx.WHOLE_SECTIONS)}) OR len({_words('c')}) < {lx.SPLIT_WORDS} OR coalesce(n, 0) <= 6 AS whole
 FROM cl LEFT JOIN (SELECT doc_id, count(*) AS n FROM s GROUP BY 1) USING (doc_id) WHERE {_strip('c')} <> '' AND section NOT IN ({', '.join(repr(x) for x in lx.DROPPED_SECTIONS)})),
 hv AS (SELECT doc_id, pack, {_HALVES} AS h FROM (SELECT *, {_words('text')} AS w FROM pk JOIN kind USING (doc_id) WHERE NOT whole)),
 pc AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pack, half) AS k, piece FROM (SELECT doc_id, pack, unnest(range(len(h))) AS half, unnest(h) AS piece FROM hv)),
 gr AS (SELECT *, sum(CASE WHEN k = 1 OR len({_words('piece')}) >= {lx.MIN_WORDS} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS part FROM pc),
 pt AS (SELECT doc_id, part - 1 AS part, string_agg(piece, ' ' ORDER BY k) AS text FROM gr GROUP BY 1, 2 UNION ALL SELECT doc_id, 0, c FROM kind WHERE whole),
 {_sentences('ps', 'doc_id, part', 'pt', 'text')},
 tl AS (SELECT doc_id, part + 1 AS part, string_agg(sentence, ' ' ORDER BY place) AS lead FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, part ORDER BY place DESC) AS back FROM ps) WHERE back <= {lx.OVERLAP_SENTENCES} GROUP BY 1, 2),
 out AS (SELECT doc_id, part, CASE WHEN coalesce(lead, '') = '' THEN text ELSE {_strip("lead || ' ' || text")} END AS content FROM pt LEFT JOIN tl USING (doc_id, part))
 SELECT doc_id AS paper_id, section, CAST(part AS INT) AS sub_index, content, least(1e0, {_WEIGH} + {_BONUS}) AS importance_score, CAST(len({_words('content')}) AS INT) AS word_count,
 'p' || doc_id || '_' || section || '_' || CAST(part AS INT) AS embedding_id FROM out JOIN kind USING (doc_id)""")  # fmt: skip
def _(spark, d):
    s = _docs(spark, d).select(F.col("doc_id").alias("paper_id"), co.section_of(F.col("doc_id")).alias("section"), "text")
    return chunking.chunked(s)


@query("sentence_pack", f"WITH {_sentences('s', 'doc_id', 'documents', 'text')}, {_packs('pk', 's')} SELECT doc_id, CAST(pack AS INT) AS place, text AS pack FROM pk")
def _(spark, d):
    s = _docs(spark, d).select("doc_id", segments.flat_sentences(F.col("text")).alias("s")).select("doc_id", segments.packed(F.col("s")).alias("p"))
    return s.select("doc_id", F.posexplode("p").alias("place", "pack"))


@query("importance", "SELECT id, section, round(importance_score, 4) AS importance_score, word_count, embedding_id FROM chunks")
def _(spark, d):
    return co.chunks(spark, d).select("id", "section", F.round("importance_score", 4).alias("importance_score"), "word_count", "embedding_id")


@query("semantic_cut", """WITH s AS (SELECT *, CAST(embedding AS DOUBLE[]) AS e, vec_id // 10 AS grp FROM embeddings),
 l AS (SELECT vec_id, grp, list_dot_product(e, lag(e) OVER (PARTITION BY grp ORDER BY vec_id)) AS sim FROM s)
 SELECT vec_id, round(sim, 4) AS similarity, CAST(sum(CASE WHEN sim < 0.6 THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY vec_id) AS BIGINT) AS part FROM l""", False)  # fmt: skip
def _(spark, d):
    e = co.table(spark, d, "embeddings")
    s = e.select(F.floor(F.col("vec_id") / 10).alias("paper_id"), F.lit("s").alias("section"), F.col("vec_id").alias("place"), "embedding")
    return chunking.semantic_cuts(s).select(F.col("place").alias("vec_id"), F.round("similarity", 4).alias("similarity"), "part")


# Entities.

_NER_SQL = " UNION ALL ".join(
    f"SELECT doc_id AS paper_id, '{kind}' AS type, unnest(regexp_extract_all({ASCII.format('text')}, '{p.replace('(?=' + chr(92) + 's+patients)', '').replace(chr(39), chr(39) * 2)}', 1)) AS name FROM documents"
    for kind, ps in lx.NER_PATTERNS.items()
    for p in ps
)


_VALID = f"length(name) BETWEEN 2 AND 80 AND regexp_matches(name, '[A-Za-z]') AND len(list_filter(string_split(lower(name), ' '), lambda x: x NOT IN ({', '.join(repr(w) for w in lx.ENTITY_BLACKLIST)}))) > 0"


@query("ner_pattern", f"""WITH hits AS ({_NER_SQL}), n AS (SELECT paper_id, type, array_to_string({_words('name')}, ' ') AS name FROM hits)
 SELECT paper_id, type, name, count(*) AS n FROM n WHERE {_VALID} GROUP BY ALL""")  # fmt: skip
def _(spark, d):
    # The operator reads the texts as they are. In its names non-ASCII letters become _, which has DuckDB's word boundaries.
    found = ner.pattern_names(_docs(spark, d).select(F.col("doc_id").alias("paper_id"), "text"))
    return found.groupBy("paper_id", "type", F.regexp_replace("name", r"[^\x00-\x7F]", "_").alias("name")).agg(F.sum("n").alias("n"))


@query("ner_concept", "SELECT paper_id, name, n FROM concepts")
def _(spark, d):
    return ner.concept_names(_docs(spark, d).select(F.col("doc_id").alias("paper_id"), "text")).select("paper_id", "name", "n")


_PHRASES = tuple(lx.PHRASES)
#: Each text with two of the phrases after it, as the tables hold none.
_SAID = f"(text || ' Deep ' || ([{', '.join(f"'{p}'" for p in _PHRASES)}])[1 + doc_id % {len(_PHRASES)}] || ', ' || ([{', '.join(f"'{p}'" for p in _PHRASES)}])[1 + doc_id * 7 % {len(_PHRASES)}] || '.')"


@query("ner_phrases", " UNION ALL ".join(
    f"SELECT doc_id AS paper_id, '{k}' AS type, '{lx.ACRONYM_PHRASES.get(p, ' '.join(w.capitalize() for w in p.split()))}' AS name, CAST((length(lower({_SAID})) - length(replace(lower({_SAID}), '{p}', ''))) // {len(p)} AS BIGINT) AS n FROM documents WHERE contains(lower({_SAID}), '{p}')"
    for p, k in lx.PHRASES.items()), False)
def _(spark, d):
    phrases = F.array(*[F.lit(p) for p in _PHRASES])
    at = lambda k: F.get(phrases, (k % len(_PHRASES)).cast("int"))
    said = F.concat("text", F.lit(" Deep "), at(F.col("doc_id")), F.lit(", "), at(F.col("doc_id") * 7), F.lit("."))
    return ner.phrase_names(_docs(spark, d).select(F.col("doc_id").alias("paper_id"), said.alias("text")))


@query("ner_canonical", r"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY paper_id, regexp_replace(lower(name), '[\s\-_]', '', 'g') ORDER BY n DESC, length(name), name) AS k FROM concepts),
 r AS (SELECT paper_id, name, n, row_number() OVER (PARTITION BY paper_id ORDER BY n DESC, lower(name), name) AS rank FROM c WHERE k = 1)
 SELECT paper_id, name, n FROM r WHERE rank <= 20""")  # fmt: skip
def _(spark, d):
    c = co.concepts(spark, d).select("paper_id", F.lit("CONCEPT").alias("type"), "name", "n", F.lit(0).alias("first"))
    return ner.canonical(c).select("paper_id", "name", "n")


@query("entity_top10", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY n DESC, lower(name), name) AS rank FROM concepts)
 SELECT paper_id, name, n, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10""")  # fmt: skip
def _(spark, d):
    c = co.concepts(spark, d).select("paper_id", F.lit("CONCEPT").alias("type"), "name", "n")
    return ner.top_names([c]).select("paper_id", "name", "n", "rank")


def _ner_hits() -> str:
    out = []
    for kind, patterns in lx.NER_PATTERNS.items():
        for i, x in enumerate(patterns):
            found = f"regexp_extract_all(t, '{x.replace('(?=' + chr(92) + 's+patients)', '').replace(chr(39), chr(39) * 2)}', 1)"
            out.append(f"SELECT paper_id, '{kind}' AS type, unnest({found}) AS raw, {i * 1_000_000} + unnest(range(len({found}))) AS first FROM tx")
    return " UNION ALL ".join(out)


#: Names of the tables' texts hold ASCII letters alone, so it is enough that other letters count for word boundaries.
@query("entity_extract", f"""WITH cl AS (SELECT doc_id AS paper_id, {_cleaned('text', True)} AS c FROM documents), tx AS (SELECT paper_id, {ASCII.format('c')} AS t, lower(c) AS low FROM cl),
 hits AS ({_ner_hits()}), pat AS (SELECT paper_id, type, array_to_string({_words('raw')}, ' ') AS name, count(*) AS n, min(first) AS first FROM hits GROUP BY ALL),
 keyed AS (SELECT *, row_number() OVER (PARTITION BY paper_id, type, regexp_replace(lower(name), '[\\s\\-_]', '', 'g') ORDER BY n DESC, length(name), first, name) AS k FROM pat WHERE {_VALID}),
 canon AS (SELECT * FROM (SELECT paper_id, type, name, n, row_number() OVER (PARTITION BY paper_id, type ORDER BY n DESC, lower(name), name) AS k FROM keyed WHERE k = 1) WHERE k <= {lx.NER_TOP}),
 phr AS ({" UNION ALL ".join(f"SELECT paper_id, '{k}' AS type, '{lx.ACRONYM_PHRASES.get(x, ' '.join(w.capitalize() for w in x.split()))}' AS name, (length(low) - length(replace(low, '{x}', ''))) // {len(x)} AS n FROM tx WHERE contains(low, '{x}')" for x, k in lx.PHRASES.items())}),
 con AS (SELECT paper_id, 'CONCEPT' AS type, name, count(*) AS n FROM (SELECT paper_id, unnest(regexp_extract_all(t, '{lx.CONCEPT}')) AS name FROM tx) WHERE name NOT IN ({co._STOP}) AND {_VALID} GROUP BY ALL),
 every AS (SELECT paper_id, type, name, n FROM canon UNION ALL SELECT * FROM phr UNION ALL SELECT * FROM con),
 own AS (SELECT paper_id, type, name, sum(n) AS own FROM every GROUP BY ALL), tot AS (SELECT paper_id, type, name, CAST(sum(own) OVER (PARTITION BY paper_id, name) AS BIGINT) AS n FROM own),
 rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY paper_id, type ORDER BY n DESC, lower(name), name) AS INT) AS rank FROM tot) SELECT * FROM rk WHERE rank <= {lx.TYPE_TOP}""", False)
def _(spark, d):
    return ner.extracted(co.chunks(spark, d))


_TOP = "WITH r AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY n DESC, lower(name), name) AS rank FROM concepts), t AS (SELECT * FROM r WHERE rank <= 10)"


def _top(spark, d):
    c = co.concepts(spark, d)
    names = ner.top_names([c.select("paper_id", F.lit("CONCEPT").alias("type"), "name", "n")])
    return names.join(_docs(spark, d).select(F.col("doc_id").alias("paper_id"), F.col("lang").alias("workspace_id")), "paper_id")


@query("entity_upsert", _TOP + r""" SELECT workspace_id, workspace_id || ':' || regexp_replace(lower(name), '[\s\-_]', '', 'g') AS normalized_name,
 arg_min(name, (paper_id, rank, name)) AS name, count(*) AS paper_count FROM t GROUP BY 1, 2""")  # fmt: skip
def _(spark, d):
    return ner.upserted(None, _top(spark, d)).drop("entity_type")


@query("link_frequency", _TOP + " SELECT paper_id, name, CAST(count(*) OVER (PARTITION BY paper_id, lower(name)) AS INT) AS slot_frequency, n AS mention_count FROM t")
def _(spark, d):
    return ner.link_frequency(_top(spark, d)).drop("type")


# Retrieval.


@query("query_terms", rf"""SELECT item_id, array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda t: length(t) >= 4 AND t NOT IN ({', '.join(repr(w) for w in lx.QUERY_STOP)}))[1:8], ' ') AS terms FROM benchmark""", False)
def _(spark, d):
    return co.table(spark, d, "benchmark").select("item_id", F.array_join(scores.query_terms(F.col("text")), " ").alias("terms"))


_TOK = rf"regexp_extract_all({ASCII.format('lower(content)')}, '\b[a-z0-9-]+\b')"
_POOL = f"""pool AS (SELECT *, {_TOK} AS toks FROM (SELECT * FROM chunks WHERE importance_score >= 0.4e0 ORDER BY importance_score DESC, id LIMIT 200)),
 mean AS (SELECT avg(CAST(word_count AS DOUBLE)) AS mean FROM pool),
 tf AS (SELECT *, {{terms}} AS tfs FROM pool, mean),
 bm AS (SELECT *, {{sum}} AS bm25 FROM tf)"""
_POOL = _POOL.format(
    terms="[" + ", ".join(f"CAST(len(list_filter(toks, lambda w: w = '{t}')) AS DOUBLE)" for t in TERMS) + "]",
    sum="0e0 + " + " + ".join(f"tfs[{i}] * 2.5e0 / (tfs[{i}] + 1.5e0 * (0.25e0 + 0.75e0 * (CAST(greatest(len(toks), 1) AS DOUBLE) / greatest(mean, 1e0))))" for i in range(1, len(TERMS) + 1)),
)
_LEX = (
    "least(1e0, 0.25e0 + (" + " + ".join(f"CAST(contains(lower({{0}}), '{t}') AS INT)" for t in TERMS) + f") / {len(TERMS)}e0 * 0.55e0 + least("
    + " + ".join(f"(length(lower({{0}})) - length(replace(lower({{0}}), '{t}', ''))) // {len(t)}" for t in TERMS) + ", 10) * 0.03e0)"
)
_HYBRID = _POOL + f""", hyb AS (SELECT *, round(0.45e0 * least(bm25 / {len(TERMS)}e0, 1e0) + 0.4e0 * importance_score + 0.15e0 * {_LEX.format('content')}, 4) AS score FROM bm WHERE bm25 > 0)"""
_RANKED = _HYBRID + ", top AS (SELECT *, row_number() OVER (ORDER BY score DESC, importance_score DESC, id) AS rank FROM hyb ORDER BY rank LIMIT 8)"


@query("bm25", f"WITH {_POOL} SELECT id, round(bm25, 4) AS bm25 FROM bm")
def _(spark, d):
    rows = retrieve.candidates(co.chunks(spark, d))
    mean = rows.agg(F.avg(F.col("word_count").cast("double")).alias("mean"))
    s = scores.bm25(scores.query_terms(F.lit(QUERY)), F.col("toks"), F.col("mean"))
    return rows.join(F.broadcast(mean)).withColumn("toks", scores.tokens(F.col("content"))).select("id", F.round(s, 4).alias("bm25"))


@query("lexical", f"SELECT id, round({_LEX.format('content')}, 4) AS lexical FROM chunks")
def _(spark, d):
    return co.chunks(spark, d).select("id", F.round(scores.lexical(scores.query_terms(F.lit(QUERY)), F.col("content")), 4).alias("lexical"))


@query("hybrid_top", f"WITH {_RANKED} SELECT id, section, score, CAST(rank AS INT) AS rank FROM top")
def _(spark, d):
    return retrieve.lexical_search(co.chunks(spark, d), QUERY, 8).select("id", "section", "score", "rank")


@query("fallback_retrieve", "WITH p AS (SELECT * FROM chunks ORDER BY importance_score DESC, id LIMIT 40) SELECT id, round(least(1e0, 0.35e0 + ("
       + " + ".join(f"CAST(contains(lower(content), '{t}') AS INT)" for t in TERMS) + f") / {len(TERMS)}e0 * 0.45e0 + importance_score * 0.2e0), 4) AS score FROM p ORDER BY score DESC, importance_score DESC, id LIMIT 20")
def _(spark, d):
    return retrieve.fallback_search(co.chunks(spark, d), QUERY).select("id", "score")


_BOOST = ("blen", "inth", "rethe", "anti")


@query("entity_boost", f"WITH {_RANKED} SELECT id, round(score + least(0.08e0, " + " + ".join(["0e0", *(f"CASE WHEN contains(lower(content), '{t}') THEN 0.015e0 ELSE 0e0 END" for t in sorted(_BOOST))]) + "), 4) AS score FROM top ORDER BY score DESC, rank LIMIT 5")
def _(spark, d):
    return retrieve.boosted(retrieve.lexical_search(co.chunks(spark, d), QUERY, 8), list(_BOOST), 5).select("id", F.round("score", 4).alias("score"))


@query("best_sentences", f"""WITH {_RANKED}, s AS (SELECT rank, unnest(range(len({_NAIVE.format('content')}))) AS place, unnest({_NAIVE.format('content')}) AS raw FROM top WHERE rank <= 6),
 c AS (SELECT rank, place, array_to_string({_words('raw')}, ' ') AS sentence FROM s)
 SELECT sentence, round({_LEX.format('sentence')}, 4) AS sentence_score FROM c WHERE length(sentence) BETWEEN 45 AND 320 ORDER BY {_LEX.format('sentence')} DESC, rank, place LIMIT 5""")  # fmt: skip
def _(spark, d):
    r = retrieve.best_sentences(retrieve.lexical_search(co.chunks(spark, d), QUERY, 8), QUERY)
    return r.select("sentence", F.round("sentence_score", 4).alias("sentence_score"))


def _vector(spark, d):
    return [float(x) for x in co.table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]]


_DOT = "list_dot_product(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0))"


@query("knn", f"SELECT paper_id, round({_DOT}, 4) AS score FROM vectors ORDER BY {_DOT} DESC, paper_id LIMIT 15")
def _(spark, d):
    return retrieve.vector_search(co.vectors(spark, d), _vector(spark, d)).select("paper_id", F.round("score", 4).alias("score"))


@query("knn_section", f"SELECT paper_id, round({_DOT}, 4) AS score FROM vectors WHERE section = 'results' AND workspace_id = 'en' ORDER BY {_DOT} DESC, paper_id LIMIT 15")
def _(spark, d):
    return retrieve.vector_search(retrieve.scoped(co.vectors(spark, d), "en"), _vector(spark, d), section="results").select("paper_id", F.round("score", 4).alias("score"))


@query("knn_per_paper", f"SELECT paper_id, round({_DOT}, 4) AS score FROM vectors WHERE paper_id IN (1, 2, 3, 5, 8) ORDER BY {_DOT} DESC, paper_id LIMIT 15")
def _(spark, d):
    return retrieve.vector_search(retrieve.scoped(co.vectors(spark, d), None, [1, 2, 3, 5, 8]), _vector(spark, d)).select("paper_id", F.round("score", 4).alias("score"))


#: The tables' vectors are further apart than the operator's own least score.
_LEAST = 0.3
_SIM = f"""WITH src AS (SELECT * FROM vectors WHERE paper_id % 50 = 0), pr AS (SELECT s.paper_id AS source_id, v.paper_id, list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(s.embedding AS DOUBLE[])) AS score
 FROM src s JOIN vectors v ON v.workspace_id = s.workspace_id AND v.paper_id <> s.paper_id),
 rk AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, paper_id) AS rank FROM pr), near AS (SELECT * FROM rk WHERE rank <= 10 AND score >= {_LEAST}e0)"""


@query("cross_similar", _SIM + " SELECT source_id, paper_id, round(score, 4) AS score FROM near")
def _(spark, d):
    v = co.vectors(spark, d)
    return retrieve.similar_pairs(v.where("paper_id % 50 = 0"), v, least=_LEAST).select("source_id", "paper_id", F.round("score", 4).alias("score"))


@query("connections", _SIM + " SELECT paper_id, arg_max(source_id, (score, -source_id)) AS source_id, round(max(score), 4) AS score FROM near GROUP BY 1 ORDER BY max(score) DESC, paper_id LIMIT 10")
def _(spark, d):
    v = co.vectors(spark, d)
    return retrieve.connections(v.where("paper_id % 50 = 0"), v, least=_LEAST).select("paper_id", "source_id", F.round("score", 4).alias("score"))


@query("result_merge", f"""WITH {_RANKED}, a AS (SELECT id, score, 0 AS src FROM top), b AS (SELECT paper_id AS id, round({_DOT}, 4) AS score, 1 AS src FROM vectors ORDER BY {_DOT} DESC, paper_id LIMIT 15),
 u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT id, max(score) AS score, arg_max(src, (score, -src)) AS src FROM u GROUP BY 1 ORDER BY score DESC, src, id LIMIT 12""")  # fmt: skip
def _(spark, d):
    a = retrieve.lexical_search(co.chunks(spark, d), QUERY, 8).select("id", "score")
    b = retrieve.vector_search(co.vectors(spark, d), _vector(spark, d)).select(F.col("paper_id").alias("id"), F.round("score", 4).alias("score"))
    return retrieve.merged_results(a, b, 12)


@query("paper_list", "SELECT id, title, publication_year FROM papers WHERE workspace_id = 'en' AND processing_status = 'completed' ORDER BY id DESC LIMIT 20 OFFSET 10")
def _(spark, d):
    p = co.papers(spark, d, text=False).where("workspace_id = 'en' and processing_status = 'completed'")
    return p.orderBy(F.desc("id")).offset(10).limit(20).select("id", "title", "publication_year")


@query("paper_detail", """SELECT p.id, title, processing_status, coalesce(e.n, 0) AS n_entities, coalesce(c.n, 0) AS n_chunks, processing_status = 'completed' AND coalesce(e.n, 0) > 0 AS graph_built FROM papers p
 LEFT JOIN (SELECT paper_id, count(*) AS n FROM paper_entities GROUP BY 1) e ON e.paper_id = p.id LEFT JOIN (SELECT paper_id, count(*) AS n FROM chunks GROUP BY 1) c ON c.paper_id = p.id""")  # fmt: skip
def _(spark, d):
    e = co.paper_entities(spark, d).groupBy("paper_id").agg(F.count("*").alias("ne"))
    c = co.chunks(spark, d).groupBy("paper_id").agg(F.count("*").alias("nc"))
    p = co.papers(spark, d, text=False).withColumnRenamed("id", "paper_id").join(e, "paper_id", "left").join(c, "paper_id", "left")
    n = F.coalesce("ne", F.lit(0))
    return p.select(F.col("paper_id").alias("id"), "title", "processing_status", n.alias("n_entities"), F.coalesce("nc", F.lit(0)).alias("n_chunks"), ((F.col("processing_status") == "completed") & (n > 0)).alias("graph_built"))


@query("status_counts", "SELECT workspace_id, processing_status, count(*) AS n FROM papers GROUP BY ALL")
def _(spark, d):
    return co.papers(spark, d, text=False).groupBy("workspace_id", "processing_status").agg(F.count("*").alias("n"))


@query("landscape", f"WITH h AS (SELECT * FROM papers WHERE contains(lower(raw_text), '{TOPIC}') ORDER BY id LIMIT 100) SELECT count(*) AS paper_count, min(publication_year) AS first_year, max(publication_year) AS last_year FROM h")
def _(spark, d):
    return retrieve.landscape(co.papers(spark, d), TOPIC)


@query("hypothesis_list", "SELECT id, confidence_score FROM hypotheses WHERE workspace_id = 'en' AND confidence_score >= 0.4e0 AND list_contains(supporting_paper_ids, 77) ORDER BY id LIMIT 20")
def _(spark, d):
    h = co.hypotheses(spark, d).where((F.col("workspace_id") == "en") & (F.col("confidence_score") >= 0.4) & F.array_contains("supporting_paper_ids", F.lit(77).cast("long")))
    return h.orderBy("id").limit(20).select("id", "confidence_score")


@query("hypothesis_rank", "SELECT id, round(confidence_score * novelty_score, 4) AS score FROM hypotheses WHERE confidence_score > 0.3e0")
def _(spark, d):
    h = co.hypotheses(spark, d).select("id", F.col("confidence_score").alias("confidence"), F.col("novelty_score").alias("novelty"), F.col("id").alias("ord"))
    return synth.ranked(h).select("id", "score")


@query("hypothesis_upvote", "SELECT id, CAST(CASE WHEN id = 7 THEN upvotes + 1 ELSE upvotes END AS INT) AS upvotes FROM hypotheses")
def _(spark, d):
    return sinks.upvoted(co.hypotheses(spark, d), 7).select("id", F.col("upvotes").cast("int").alias("upvotes"))


@query("workspace_reset", """WITH g AS (SELECT id FROM papers WHERE workspace_id = 'fr')
 SELECT 'papers' AS name, (SELECT count(*) FROM g) AS deleted UNION ALL SELECT 'entities', (SELECT count(*) FROM entities WHERE workspace_id = 'fr')
 UNION ALL SELECT 'links', (SELECT count(*) FROM paper_entities WHERE paper_id IN (SELECT id FROM g))""")  # fmt: skip
def _(spark, d):
    tables = {"papers": co.papers(spark, d, text=False), "entities": co.entities(spark, d), "links": co.paper_entities(spark, d)}
    return sinks.without_workspace(tables, "fr")[1]


@query("gaps", "WITH t AS (SELECT lower(string_agg(content, ' ' ORDER BY content)) AS t FROM (SELECT content FROM chunks ORDER BY importance_score DESC, id LIMIT 5)), g AS (SELECT list_filter(["
       + ", ".join(f"CASE WHEN {' OR '.join(f'contains(t, {k!r})' for k in keys)} THEN '{gap}' END" for keys, gap in lx.GAP_RULES)
       + f"], lambda x: x IS NOT NULL) AS g FROM t) SELECT array_to_string(CASE WHEN len(g) > 0 THEN g ELSE ['{lx.DEFAULT_GAP}'] END, '|') AS gaps FROM g")
def _(spark, d):
    top = co.chunks(spark, d).orderBy(F.desc("importance_score"), "id").limit(5)
    return retrieve.gaps(top).select(F.array_join("gaps", "|").alias("gaps"))


# Graph.

_STRENGTH = r"""CASE WHEN @valid THEN 1e0 + CASE WHEN len(regexp_extract_all({0}, '[A-Za-z][A-Za-z0-9-]*')) >= 2 THEN 1e0 ELSE 0e0 END
 + CASE WHEN len(list_filter(regexp_extract_all({0}, '[A-Za-z][A-Za-z0-9-]*'), lambda w: w = upper(w) AND length(w) >= 2)) > 0 THEN 0.7e0 ELSE 0e0 END ELSE 0e0 END"""
_ONE = "regexp_extract({0}, '[A-Za-z][A-Za-z0-9-]*', 0)"
_GS = ", ".join(f"'{w}'" for w in lx.GRAPH_STOP)
_GRAPH_VALID = rf"""(lower({{0}}) NOT IN ({_GS}) AND length({{0}}) BETWEEN 3 AND 90 AND len(regexp_extract_all({{0}}, '[A-Za-z][A-Za-z0-9-]*')) > 0
 AND (len(regexp_extract_all({{0}}, '[A-Za-z][A-Za-z0-9-]*')) > 1 OR (lower({_ONE}) NOT IN ({_GS}) AND (length({_ONE}) >= 4 OR {_ONE} = upper({_ONE}))
 AND NOT (regexp_matches({_ONE}, '^[A-Z][a-z]*$') AND lower({_ONE}) IN ({", ".join(f"'{w}'" for w in lx.GENERIC_TITLE_WORDS)})))))"""
_STRENGTH = _STRENGTH.replace("@valid", _GRAPH_VALID)
_STRONG = _STRENGTH + f" + CASE WHEN {{1}} IN ({', '.join(f"'{t}'" for t in lx.STRONG_TYPES)}) AND {_GRAPH_VALID} THEN 0.8e0 ELSE 0e0 END"


@query("entity_strength", f"SELECT id, name, round({_STRONG.format('name', 'entity_type')}, 4) AS strength FROM entities")
def _(spark, d):
    return co.entities(spark, d).select("id", "name", F.round(scores.strength(F.col("name"), F.col("entity_type")), 4).alias("strength"))


def _context(spark, d):
    return co.evidence(spark, d)[:2]


@query("entity_candidates", """WITH e AS (SELECT *, split_part(normalized_name, ':', 2) AS key FROM entities),
 k AS (SELECT id, row_number() OVER (ORDER BY paper_count DESC, id) AS place FROM e WHERE contains(key, 'thatin') OR contains(key, 'inor') ORDER BY place LIMIT 16),
 n AS (SELECT id, 100 + row_number() OVER (ORDER BY paper_count DESC, id) AS place FROM e WHERE contains(lower(name), 'thatin') OR contains(lower(name), 'inor') ORDER BY place LIMIT 16),
 p AS (SELECT entity_id AS id, 200 + row_number() OVER (ORDER BY frequency DESC, paper_count DESC, entity_id, paper_id) AS place FROM paper_entities JOIN e ON e.id = entity_id WHERE paper_id IN (1, 2, 3) ORDER BY place LIMIT 24),
 u AS (SELECT * FROM k UNION ALL SELECT * FROM n UNION ALL SELECT * FROM p) SELECT id, CAST(min(place) AS INT) AS place FROM u GROUP BY 1 ORDER BY 2 LIMIT 32""")  # fmt: skip
def _(spark, d):
    e, links = _context(spark, d)
    return graph.candidate_entities(e, links, ["thatin", "inor"], [1, 2, 3]).select("id", F.col("place").cast("int").alias("place"))


_CO = f"""WITH l AS (SELECT pe.paper_id, pe.entity_id, e.name, pe.frequency, {_STRONG.format('e.name', 'e.entity_type')} AS s FROM paper_entities pe JOIN entities e ON e.id = pe.entity_id WHERE {_GRAPH_VALID.format('e.name')}),
 t AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY s DESC, frequency DESC, entity_id) AS k FROM l),
 pr AS (SELECT a.name AS source, b.name AS target, a.paper_id, least(0.92e0, 0.35e0 + (a.frequency + b.frequency) * 0.035e0 + a.s * 0.04e0 + b.s * 0.04e0) AS confidence
 FROM t a JOIN t b ON a.paper_id = b.paper_id AND b.k > a.k AND b.k <= a.k + 3 WHERE a.k <= 8 AND b.k <= 8 AND lower(a.name) <> lower(b.name)
 AND NOT (length(a.name) >= 4 AND length(b.name) >= 4 AND (contains(lower(a.name), lower(b.name)) OR contains(lower(b.name), lower(a.name)))))"""


@query("comention", _CO + " SELECT source, target, paper_id, round(confidence, 4) AS confidence FROM pr")
def _(spark, d):
    e, links = _context(spark, d)
    named = links.join(e.select(F.col("id").alias("entity_id"), "name", "entity_type"), "entity_id")
    return graph.co_mentions(named).select("source", "target", "paper_id", F.round("confidence", 4).alias("confidence"))


@query("fact_filter", _CO + f""" SELECT source, target, paper_id, round(confidence, 4) AS confidence FROM pr
 ORDER BY round(confidence, 4) DESC, {_STRENGTH.format('source')} + {_STRENGTH.format('target')} DESC, source, target, paper_id LIMIT 32""")  # fmt: skip
def _(spark, d):
    e, links = _context(spark, d)
    named = links.join(e.select(F.col("id").alias("entity_id"), "name", "entity_type"), "entity_id")
    f = graph.filtered_facts(graph.co_mentions(named).withColumn("confidence", F.round("confidence", 4)))
    return f.select("source", "target", "paper_id", "confidence")


@query("explicit_facts", f"""WITH ids AS (SELECT id FROM entities ORDER BY paper_count DESC, id LIMIT 24),
 hit AS (SELECT r.*, a.name AS source FROM relationships r JOIN entities a ON a.id = r.source_entity_id WHERE r.source_entity_id IN (SELECT id FROM ids) OR r.target_entity_id IN (SELECT id FROM ids)
 ORDER BY confidence DESC, r.id LIMIT 32)
 SELECT source, relationship_type AS relationship, b.name AS target, round(confidence, 4) AS confidence, paper_id FROM hit JOIN entities b ON b.id = target_entity_id
 WHERE {_GRAPH_VALID.format('source')} AND {_GRAPH_VALID.format('b.name')}""")  # fmt: skip
def _(spark, d):
    e, _, relations = co.evidence(spark, d)
    ids = e.orderBy(F.desc("paper_count"), "id").limit(24).select("id")
    f = graph.explicit_facts(relations, e, ids)
    return f.select("source", "relationship", "target", F.round("confidence", 4).alias("confidence"), "paper_id")


_PG = """WITH near AS (SELECT entity_id, name, entity_type, frequency, paper_count FROM paper_entities JOIN entities ON id = entity_id WHERE paper_id = 7 ORDER BY frequency DESC, name, entity_id LIMIT 80)"""


@query("paper_graph_nodes", _PG + """ SELECT 'paper-7' AS id, title AS label, 'Paper' AS type, CAST(NULL AS INT) AS mention_count, 1 AS paper_count FROM papers WHERE id = 7
 UNION ALL SELECT 'entity-' || entity_id, name, entity_type, frequency, paper_count FROM near""")  # fmt: skip
def _(spark, d):
    e, links, relations = co.evidence(spark, d)
    return graph.paper_graph(co.papers(spark, d, text=False).where("id = 7"), e, links, relations)[0]


@query("paper_graph_edges", _PG + """, ins AS (SELECT * FROM relationships WHERE source_entity_id IN (SELECT entity_id FROM near) AND target_entity_id IN (SELECT entity_id FROM near) ORDER BY confidence DESC, id LIMIT 100)
 SELECT 'paper-7' AS source, 'entity-' || entity_id AS target, 'MENTIONS' AS type, CAST(NULL AS DOUBLE) AS confidence, CAST(7 AS BIGINT) AS paper_id FROM near
 UNION ALL SELECT 'entity-' || source_entity_id, 'entity-' || target_entity_id, relationship_type, round(confidence, 4), paper_id FROM ins""")  # fmt: skip
def _(spark, d):
    e, links, relations = co.evidence(spark, d)
    g = graph.paper_graph(co.papers(spark, d, text=False).where("id = 7"), e, links, relations)[1]
    return g.withColumn("confidence", F.round("confidence", 4))


_EG = f"""WITH seeds AS (SELECT * FROM entities WHERE lower(name) = '{NAME.lower()}' OR contains(lower(name), '{NAME.lower()}') ORDER BY paper_count DESC, name, id LIMIT 8),
 said AS (SELECT l.entity_id, l.paper_id, l.frequency, p.title FROM paper_entities l JOIN papers p ON p.id = l.paper_id WHERE l.entity_id IN (SELECT id FROM seeds)
 ORDER BY frequency DESC, title, l.paper_id, l.entity_id LIMIT 24),
 ends AS (SELECT *, target_entity_id AS entity_id FROM relationships WHERE source_entity_id IN (SELECT id FROM seeds) UNION SELECT *, source_entity_id FROM relationships WHERE target_entity_id IN (SELECT id FROM seeds)),
 rel AS (SELECT r.*, e.name, e.entity_type, e.paper_count FROM ends r JOIN entities e ON e.id = r.entity_id WHERE r.entity_id NOT IN (SELECT id FROM seeds) ORDER BY confidence DESC, r.id, r.entity_id LIMIT 40),
 co AS (SELECT l.*, e.name, e.entity_type, e.paper_count FROM paper_entities l JOIN entities e ON e.id = l.entity_id WHERE l.paper_id IN (SELECT paper_id FROM said) AND l.entity_id NOT IN (SELECT id FROM seeds)
 ORDER BY frequency DESC, paper_count DESC, l.entity_id, l.paper_id LIMIT 48)"""


@query("entity_graph_nodes", _EG + """, found AS (SELECT id AS entity_id, name, entity_type, 0 AS mention_count, paper_count, 0 AS wave FROM seeds
 UNION ALL SELECT entity_id, name, entity_type, 0, paper_count, 1 FROM rel UNION ALL SELECT entity_id, name, entity_type, frequency, paper_count, 2 FROM co)
 SELECT 'entity-' || entity_id AS id, name AS label, entity_type AS type, paper_count, CAST(arg_max(mention_count, (wave, -mention_count)) AS INT) AS mention_count FROM found GROUP BY ALL
 UNION ALL SELECT DISTINCT 'paper-' || paper_id, title, 'Paper', 1, CAST(NULL AS INT) FROM said""")  # fmt: skip
def _(spark, d):
    e, links, relations = co.evidence(spark, d)
    return graph.entity_graph(NAME, co.papers(spark, d, text=False), e, links, relations)[0]


@query("entity_graph_edges", _EG + """ SELECT 'paper-' || paper_id AS source, 'entity-' || entity_id AS target, 'MENTIONS' AS type, CAST(NULL AS DOUBLE) AS confidence, paper_id FROM said
 UNION ALL SELECT 'entity-' || source_entity_id, 'entity-' || target_entity_id, relationship_type, round(confidence, 4), paper_id FROM rel
 UNION ALL SELECT 'paper-' || paper_id, 'entity-' || entity_id, 'MENTIONS', NULL, paper_id FROM co""")  # fmt: skip
def _(spark, d):
    e, links, relations = co.evidence(spark, d)
    g = graph.entity_graph(NAME, co.papers(spark, d, text=False), e, links, relations)[1]
    return g.withColumn("confidence", F.round("confidence", 4))


#: Of the entities of twenty papers or more the least known: it has neighbours on all sides, and some of them are hubs.
_START = "(SELECT id FROM entities WHERE paper_count >= 20 ORDER BY paper_count, id LIMIT 1)"
_UND = """und AS (SELECT id AS edge_id, source_entity_id AS u, target_entity_id AS v, paper_id FROM relationships UNION ALL SELECT id, target_entity_id, source_entity_id, paper_id FROM relationships WHERE source_entity_id <> target_entity_id)"""
_TRAILS = f"""{_UND}, tr AS (SELECT [edge_id] AS edges, v AS tip, 1 AS hops FROM und WHERE u IN {_START}
 UNION ALL SELECT list_append(t.edges, e.edge_id), e.v, t.hops + 1 FROM tr t JOIN und e ON e.u = t.tip AND NOT list_contains(t.edges, e.edge_id) WHERE t.hops < @)"""


def _start(entities):
    found = entities.where("paper_count >= 20").orderBy("paper_count", "id").select("id").take(1)
    return [r["id"] for r in found] or [-1]


@query("khop", f"WITH {_TRAILS.replace('@', '2')}, f AS (SELECT edges, hops FROM tr ORDER BY hops, edges LIMIT 100), x AS (SELECT DISTINCT unnest(edges) AS id FROM f) SELECT r.id, source_entity_id, target_entity_id, relationship_type FROM x JOIN relationships r ON r.id = x.id")
def _(spark, d):
    e, _, r = co.evidence(spark, d)
    return graph.neighbourhood(r, _start(e)).select("id", "source_entity_id", "target_entity_id", "relationship_type")


@query("paths", f"WITH {_TRAILS.replace('@', '4')} SELECT array_to_string(edges, ',') AS edges, hops FROM tr WHERE tip IN (SELECT target_entity_id FROM relationships WHERE source_entity_id IN {_START}) ORDER BY hops, tr.edges LIMIT 20")
def _(spark, d):
    e, _, r = co.evidence(spark, d)
    a = _start(e)
    b = [x["target_entity_id"] for x in r.where(F.col("source_entity_id").isin(*a)).select("target_entity_id").distinct().collect()]  # of one entity
    return graph.paths_between(r, a, b, 4).select(F.array_join(F.transform("edges", lambda e: e.cast("string")), ",").alias("edges"), "hops")


@query("topic_papers", "SELECT p.id AS paper_id, title, publication_year AS year, e.id AS entity_id FROM entities e JOIN paper_entities pe ON pe.entity_id = e.id JOIN papers p ON p.id = pe.paper_id WHERE contains(lower(e.name), 'thatin')")
def _(spark, d):
    e, links = _context(spark, d)
    return graph.topic_papers(co.papers(spark, d, text=False), e, links, TOPIC)


@query("graph_export", f"WITH {_UND} SELECT e.id AS entity_id, name, v AS other_id, edge_id FROM entities e LEFT JOIN und ON u = e.id ORDER BY e.id, edge_id NULLS FIRST, v NULLS FIRST LIMIT 500")
def _(spark, d):
    return graph.graph_export(co.entities(spark, d), co.relationships(spark, d)).select("entity_id", "name", "other_id", "edge_id")


@query("degree", "SELECT node, count(*) AS degree FROM (SELECT source_entity_id AS node FROM relationships UNION ALL SELECT target_entity_id FROM relationships) GROUP BY 1")
def _(spark, d):
    return graph.degrees(co.relationships(spark, d).select(F.col("source_entity_id").alias("source"), F.col("target_entity_id").alias("target")))


_PALETTE = "CASE " + " ".join(f"WHEN contains(lower(type), '{k}') THEN '{k}'" for k in lx.PALETTE) + " ELSE 'entity' END"


@query("node_palette", f"WITH n AS (SELECT 'entity-' || id AS id, entity_type AS type FROM entities UNION ALL SELECT 'paper-' || id, 'Paper' FROM papers) SELECT id, type, {_PALETTE} AS category FROM n")
def _(spark, d):
    nodes = co.entities(spark, d).select(F.concat(F.lit("entity-"), "id").alias("id"), F.col("entity_type").alias("type"))
    nodes = nodes.unionByName(co.papers(spark, d, text=False).select(F.concat(F.lit("paper-"), "id").alias("id"), F.lit("Paper").alias("type")))
    return nodes.select("id", "type", graph.palette(F.col("type")).alias("category"))


# Synthesis.


_TYPES = """top AS (SELECT name, entity_type, frequency, entity_id, paper_id FROM paper_entities JOIN entities ON id = entity_id WHERE paper_id IN (1, 2, 3, 5) ORDER BY frequency DESC, paper_count DESC, entity_id, paper_id LIMIT 80),
 typed AS (SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY frequency DESC, lower(name), name, entity_id, paper_id) AS k FROM top)"""


@query("entities_by_type", f"WITH {_TYPES} SELECT entity_type, string_agg(name, '|' ORDER BY k) AS names FROM typed WHERE k <= 8 GROUP BY 1")
def _(spark, d):
    e, links = _context(spark, d)
    named = links.where("paper_id in (1, 2, 3, 5)").join(e.withColumnRenamed("id", "entity_id"), "entity_id")
    return synth.by_type(named).select("entity_type", F.array_join("names", "|").alias("names"))


@query("contradiction_pairs", """WITH p AS (SELECT * FROM (VALUES (1, 0), (2, 1), (3, 2), (999999999, 3)) v(paper_id, ord)), t AS (SELECT p.*, c.content FROM p LEFT JOIN chunks c ON c.paper_id = p.paper_id)
 SELECT CAST(a.paper_id AS BIGINT) AS paper_a_id, CAST(b.paper_id AS BIGINT) AS paper_b_id, CASE WHEN a.content IS NULL OR b.content IS NULL THEN 'insufficient_data' ELSE 'model_error' END AS contradiction_type FROM t a JOIN t b ON a.ord < b.ord""")  # fmt: skip
def _(spark, d):
    asked = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (999999999, 3)], "paper_id long, ord int")
    texts = co.chunks(spark, d).where("paper_id in (1, 2, 3, 999999999)").select("paper_id", F.col("content").alias("text"))
    return synth.contradiction_pairs(asked, TOPIC, texts).select("paper_a_id", "paper_b_id", "contradiction_type")


def _template(x: str) -> str:
    """A template with {column} places, as an expression."""
    parts = x.replace("}", "{").split("{")
    return " || ".join(f"coalesce({p}, '')" if i % 2 else "'" + p.replace("'", "''") + "'" for i, p in enumerate(parts) if p)


_FOUND = "found AS (SELECT *, row_number() OVER (ORDER BY score DESC, importance_score DESC, id) AS rank FROM (SELECT *, round(least(1e0, 0.35e0 + (" + " + ".join(
    f"CAST(contains(lower(content), '{t}') AS INT)" for t in TERMS) + f") / {len(TERMS)}e0 * 0.45e0 + importance_score * 0.2e0), 4) AS score FROM (SELECT * FROM chunks ORDER BY importance_score DESC, id LIMIT 40)) ORDER BY rank LIMIT 20)"
_SENTENCE = f"(list_filter(string_split(content, '. '), lambda x: length(x) > 60 AND ({' OR '.join(f'contains(lower(x), {w!r})' for w in lx.EVIDENCE_WORDS)})))[1]"
_RULES = {"disease_method": "disease IS NOT NULL AND method IS NOT NULL", "protein_chemical": "protein IS NOT NULL AND chemical IS NOT NULL", "method_dataset": "method IS NOT NULL AND dataset IS NOT NULL"}
_RULES |= {"sentence": "sentence IS NOT NULL AND NOT (" + " OR ".join(f"({r})" for r in _RULES.values()) + ")", "fill": "true"}
_D = lx.HYPOTHESIS_DETAILS
_MADE = ", ".join(
    f"CASE WHEN {_RULES[rule]} THEN {{{{'ord': {100 * i + k}, 'rule': '{rule}', 'confidence': {conf}e0, 'novelty': {new}e0, 'testability': '{test}', 'hypothesis': {_template(text_)}, 'reasoning': {_template(_D[rule][0])}, "
    f"'experiments': {' || chr(10) || '.join(_template(x) for x in _D[rule][1])}, 'weakened': {_template(_D[rule][2])}, 'insight': {_template(_D[rule][3])}}}}} END"
    for i, (rule, conf, new, test, text_) in enumerate(lx.HYPOTHESES) for k in range(5 if rule == "fill" else 1)
).replace("{{", "{").replace("}}", "}")


@query("hypotheses", f"WITH {_TYPES}, {_FOUND}, names AS (SELECT " + ", ".join(f"max(CASE WHEN entity_type = '{t}' THEN name END) AS {t.lower()}" for t in ("DISEASE", "METHOD", "GENE", "CHEMICAL", "DATASET"))
       + ", coalesce(max(CASE WHEN entity_type = 'PROTEIN' THEN name END), max(CASE WHEN entity_type = 'GENE' THEN name END)) AS protein FROM typed WHERE k = 1),"
       + f" said AS (SELECT substr(arg_min(sentence, rank), 1, 140) AS sentence FROM (SELECT rank, trim({_SENTENCE}) AS sentence FROM found WHERE rank <= 4) WHERE sentence IS NOT NULL),"
       + f" one AS (SELECT *, '{QUERY}' AS query, coalesce(nullif(concat_ws(', ', method, disease, protein, dataset), ''), '{QUERY}') AS anchor FROM names, said),"
       + f" made AS (SELECT unnest(list_filter([{_MADE}], lambda x: x IS NOT NULL)[1:5], recursive := true) FROM one)"
       + " SELECT *, round(confidence * novelty, 4) AS score FROM made WHERE confidence > 0.3e0")
def _(spark, d):
    found = retrieve.fallback_search(co.chunks(spark, d), QUERY).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("importance_score"), "id")))
    e, links = _context(spark, d)
    types = synth.by_type(links.where("paper_id in (1, 2, 3, 5)").join(e.withColumnRenamed("id", "entity_id"), "entity_id"))
    h = synth.hypotheses(types, synth.evidence_sentences(found), QUERY, 5, found.withColumn("title", F.lit("")), retrieve.gaps(found.where("rank <= 5")))
    one = lambda c: F.array_join(c, "\n")
    return h.select("ord", "rule", "confidence", "novelty", "testability", "hypothesis", "score", "reasoning", one("suggested_experiments").alias("experiments"),
                    F.col("falsifiable_conditions").alias("weakened"), F.col("cross_domain_insight").alias("insight"))


@query("discovery_metrics", """SELECT lang AS grp, round(least(1e1, 5 + count(*) % 7 * 0.45e0), 1) AS novelty, round(least(1e1, 4 + count(*) % 9 * 0.8e0), 1) AS evidence,
 round(least(1e1, 5 + count(*) % 31 * 0.18e0), 1) AS impact, round(greatest(1e0, 8 - count(*) % 9 * 0.35e0), 1) AS risk FROM documents GROUP BY 1""", False)  # fmt: skip
def _(spark, d):
    n = _docs(spark, d).groupBy(F.col("lang").alias("grp")).agg(F.count("*").alias("n"))
    return n.select("grp", *synth.discovery_metrics(F.col("n") % 9, F.col("n") % 31, F.col("n") % 7))


_piped = lambda xs: "|".join(x.replace("'", "''") for x in xs)


@query("debate", "SELECT id, least(confidence_score, 0.7e0) AS final_confidence, '" + _piped(f"{a} {r}: {t}" for a, r, t in lx.DEBATE_TURNS) + "' AS transcript, 'MODERATE_SUPPORT' AS consensus, 'h' || id AS revised_hypothesis, '"
       + _piped(lx.DEBATE_STRENGTHS) + "' AS strengths, '" + _piped(lx.DEBATE_CONCERNS) + "' AS concerns, '" + _piped(lx.DEBATE_EXPERIMENTS) + "' AS experiments FROM hypotheses")
def _(spark, d):
    h = co.hypotheses(spark, d).select("id", F.concat(F.lit("h"), F.col("id").cast("string")).alias("hypothesis"), F.col("confidence_score").alias("confidence"))
    turns = F.transform("transcript", lambda x: F.concat(x["agent"], F.lit(" "), x["round"], F.lit(": "), x["content"]))
    one = lambda c: F.array_join(c, "|")
    return synth.debate(h).select("id", "final_confidence", one(turns).alias("transcript"), "consensus", "revised_hypothesis", one("key_strengths").alias("strengths"),
                                  one("key_concerns").alias("concerns"), one("recommended_experiments").alias("experiments"))


def _any_term(x: str) -> str:
    return "(" + " OR ".join(f"contains({x}, '{t}')" for t in TERMS) + ")"


_VALID_2 = f"{_GRAPH_VALID.format('source')} AND {_GRAPH_VALID.format('target')} AND trim(lower(source)) <> trim(lower(target)) AND NOT (length(source) >= 4 AND length(target) >= 4 AND (contains(lower(source), lower(target)) OR contains(lower(target), lower(source))))"
_WEIGHED = f"{_STRENGTH.format('source')} + {_STRENGTH.format('target')}"
_KINDS_OF = lambda kinds: ", ".join(f"'{k}'" for k in kinds)
_CONTEXT = f"""asked AS (SELECT paper_id FROM top), named AS (SELECT *, split_part(normalized_name, ':', 2) AS key FROM entities),
 by_key AS (SELECT id, row_number() OVER (ORDER BY paper_count DESC, id) AS place FROM named WHERE {_any_term('key')} ORDER BY place LIMIT 16),
 by_name AS (SELECT id, 100 + row_number() OVER (ORDER BY paper_count DESC, id) AS place FROM named WHERE {_any_term('lower(name)')} ORDER BY place LIMIT 16),
 by_paper AS (SELECT entity_id AS id, 200 + row_number() OVER (ORDER BY frequency DESC, paper_count DESC, entity_id, paper_id) AS place FROM paper_entities JOIN named e ON e.id = entity_id WHERE paper_id IN (SELECT paper_id FROM asked) ORDER BY place LIMIT 24),
 cand AS (SELECT id, min(place) AS place FROM (SELECT * FROM by_key UNION ALL SELECT * FROM by_name UNION ALL SELECT * FROM by_paper) GROUP BY 1 ORDER BY 2 LIMIT 32),
 strong AS (SELECT e.*, c.place, {_STRONG.format('name', 'entity_type')} AS strength FROM cand c JOIN named e USING (id) WHERE {_GRAPH_VALID.format('name')}),
 ents AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY strength DESC, place) AS nth FROM strong) WHERE nth = 1 ORDER BY strength DESC, paper_count DESC, place LIMIT 24),
 hit AS (SELECT r.*, a.name AS source FROM relationships r JOIN entities a ON a.id = r.source_entity_id WHERE r.paper_id IN (SELECT paper_id FROM asked)
 AND (r.source_entity_id IN (SELECT id FROM ents) OR r.target_entity_id IN (SELECT id FROM ents)) ORDER BY confidence DESC, r.id LIMIT 32),
 explicit AS (SELECT source, relationship_type AS relationship, coalesce(b.name, CAST(target_entity_id AS VARCHAR)) AS target, confidence, paper_id, 0 AS src FROM hit LEFT JOIN entities b ON b.id = target_entity_id),
 facts1 AS (SELECT * FROM explicit WHERE {_GRAPH_VALID.format('source')} AND {_GRAPH_VALID.format('target')}),
 near AS (SELECT l.*, name, {_STRONG.format('name', 'entity_type')} AS s FROM paper_entities l JOIN ents ON ents.id = l.entity_id WHERE l.paper_id IN (SELECT paper_id FROM asked) ORDER BY frequency DESC, entity_id, l.paper_id LIMIT 240),
 placed AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY s DESC, frequency DESC, entity_id) AS k FROM near),
 pairs AS (SELECT a.name AS source, 'co_mentioned_with' AS relationship, b.name AS target, least(0.92e0, 0.35e0 + (a.frequency + b.frequency) * 0.035e0 + a.s * 0.04e0 + b.s * 0.04e0) AS confidence, a.paper_id
 FROM placed a JOIN placed b ON a.paper_id = b.paper_id AND b.k > a.k AND b.k <= a.k + 3 WHERE a.k <= 8 AND b.k <= 8),
 facts2 AS (SELECT *, 1 AS src FROM pairs WHERE {_VALID_2} ORDER BY confidence DESC, {_WEIGHED} DESC, source, target, relationship, paper_id LIMIT 32),
 every AS (SELECT * FROM facts1 UNION ALL SELECT * FROM facts2 WHERE (SELECT count(*) FROM facts1) < 4),
 best_fact AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, relationship, target, paper_id ORDER BY confidence DESC, src) AS nth FROM every) WHERE nth = 1 OR (SELECT count(*) FROM facts1) >= 4),
 few AS (SELECT * FROM best_fact ORDER BY confidence DESC, src, source, target, relationship, paper_id LIMIT 32),
 facts AS (SELECT *, row_number() OVER (ORDER BY confidence DESC, {_WEIGHED} DESC, source, target, relationship, paper_id) AS k FROM few WHERE {_VALID_2}),
 first10 AS (SELECT * FROM ents ORDER BY strength DESC, paper_count DESC, place LIMIT 10),
 bonus AS (SELECT DISTINCT lower(w) AS w FROM (SELECT unnest({_words('name')}) AS w FROM first10) WHERE length(w) >= {lx.TERM_LETTERS} AND lower(w) NOT IN ({_GS})),
 plus AS (SELECT t.id, t.section, t.content, t.paper_id, t.rank AS old, t.score + least(0.08e0, coalesce((SELECT count(*) FROM bonus WHERE contains(lower(t.content), w)), 0) * 0.015e0) AS score FROM top t),
 best AS (SELECT plus.*, title, row_number() OVER (ORDER BY score DESC, old) AS rank FROM plus JOIN papers p ON p.id = plus.paper_id),
 sent AS (SELECT rank, unnest(range(len({_NAIVE.format('content')}))) AS place, unnest({_NAIVE.format('content')}) AS raw FROM best WHERE rank <= 6),
 said AS (SELECT rank, place, array_to_string({_words('raw')}, ' ') AS sentence FROM sent),
 chosen AS (SELECT sentence, row_number() OVER (ORDER BY {_LEX.format('sentence')} DESC, rank, place) AS nth FROM said WHERE length(sentence) BETWEEN 45 AND 320),
 head AS (SELECT (SELECT count(*) FROM best) AS n_results, (SELECT count(*) FROM facts WHERE k <= 6) AS n_relations,
 (SELECT string_agg(sentence, ' ' ORDER BY nth) FROM chosen WHERE nth <= 3) AS finding,
 (SELECT string_agg(name, ', ' ORDER BY nth) FROM (SELECT name, row_number() OVER (ORDER BY strength DESC, paper_count DESC, place) AS nth FROM (SELECT * FROM ents ORDER BY strength DESC, paper_count DESC, place LIMIT 8) WHERE entity_type IN ({_KINDS_OF(lx.METHOD_TYPES)})) WHERE nth <= 4) AS methods,
 (SELECT string_agg(name, ', ' ORDER BY nth) FROM (SELECT name, row_number() OVER (ORDER BY strength DESC, paper_count DESC, place) AS nth FROM (SELECT * FROM ents ORDER BY strength DESC, paper_count DESC, place LIMIT 8) WHERE entity_type IN ({_KINDS_OF(lx.TARGET_TYPES)})) WHERE nth <= 4) AS targets,
 (SELECT string_agg(rank || '. ' || title || ' (' || section || ', paper_id=' || paper_id || ', score=' || printf('%.2f', score) || '): ' || array_to_string(({_words('content')})[1:42], ' '), chr(10) ORDER BY rank) FROM best WHERE rank <= 5) AS evidence,
 (SELECT string_agg('- ' || source || ' --' || relationship || '--> ' || target || ' (confidence ' || printf('%.2f', confidence) || ', paper_id=' || paper_id || ')', chr(10) ORDER BY k) FROM facts WHERE k <= 6) AS relations),
 graded AS (SELECT *, CASE WHEN n_results >= 5 AND n_relations > 0 THEN 'high' WHEN n_results >= 3 THEN 'moderate' ELSE 'low' END AS confidence FROM head)"""
_EMPTY = lx.EMPTY_ANSWER.format(QUERY).replace("'", "''")


#: An answer takes its chunks from all, not from the most important 200.
_RANKED_ALL = _RANKED.replace(" ORDER BY importance_score DESC, id LIMIT 200)", ")")


@query("answer", f"""WITH {_RANKED_ALL}, {_CONTEXT} SELECT n_results, n_relations, confidence, CASE WHEN n_results = 0 THEN '{_EMPTY}' ELSE concat_ws(chr(10), '{lx.KEY_FINDING}', finding, '',
 '{lx.STRENGTH}', upper(confidence[1]) || confidence[2:] || '{lx.SUPPORT}' || n_results || '{lx.CHUNKS_AND}' || n_relations || '{lx.RELATIONSHIPS}', '',
 '{lx.CONCEPTS}', '{lx.METHODS_LABEL}' || coalesce(methods, '{lx.NO_METHODS}'), '{lx.TARGETS_LABEL}' || coalesce(targets, '{lx.NO_TARGETS}'), '',
 '{lx.BEST}', evidence, '', '{lx.GROUNDING}', coalesce(relations, '{lx.NO_FACTS}')) END AS answer FROM graded""")  # fmt: skip
def _(spark, d):
    from quillmine.plans.engine import Engine

    e, links, relations = co.evidence(spark, d)
    engine = Engine(co.papers(spark, d), co.chunks(spark, d), e, links, relations)
    return engine.answer(QUERY).select("n_results", "n_relations", "confidence", "answer")


@query("status_funnel", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL", False)
def _(spark, d):
    return status_funnel(co.table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("last_status", "SELECT user_id AS id, arg_max(event_type, (ts, event_type)) AS processing_status FROM events GROUP BY 1", False)
def _(spark, d):
    e = co.table(spark, d, "events")
    changes = e.select(F.col("user_id").alias("id"), "ts", F.col("event_type").alias("status"))
    users = changes.select("id").distinct().withColumn("processing_status", F.lit("pending"))
    return sinks.with_status(users, changes)
