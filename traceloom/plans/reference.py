"""Queries of the analytics operators over the test tables, each with its SQL where SQL can say it.

Stated query sets: searches take the rows whose id is divisible by 20 as queries, against all rows.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.config import SOURCE_TYPES, STATUS_COLOURS
from traceloom.functions import text as T
from traceloom.functions.providers import embedding, extract_answers
from traceloom.functions.timestamps import normalise, union_all
from traceloom.operators import chunking, correlate, extraction, graph, matrix, metrics, retrieval, store, trace
from traceloom.operators.sessions import sessionise
from traceloom.plans.lineage import checkpoint, scratch
from traceloom.plans.tables import table
from traceloom.sources import files, parsers
from traceloom.sources.ingestion import ingest_files

QUERIES: dict = {}
LATER: dict = {}  # SQL, or a function that gives it once all parts of this module are there


def query(sql: str | Callable[[], str] | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            LATER[f.__name__] = sql
        return f

    return add


# ---- sources ---------------------------------------------------------------------------------------------

# white space as Java and Python see it in a pattern without Unicode classes
_SPACE = r"[ \t\n\x0B\f\r]"
_ANY_SPACE = r"[\s\x0B\x1C-\x1F\x85\pZ]"  # as in any script
_STRIP = "regexp_replace({0}, '^" + _ANY_SPACE + "+|" + _ANY_SPACE + "+$', '', 'g')"


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL")
def s04_content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", files.content_hash(F.col("text")).alias("content_hash"))


@query("""
SELECT min(doc_id) AS doc_id, sha256(text) AS file_hash FROM documents WHERE text IS NOT NULL
GROUP BY 2 HAVING sha256(text) NOT IN (SELECT file_hash FROM ingestion_log WHERE status = 'success' AND file_hash IS NOT NULL)""")
def s05_first_copies(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", files.content_hash(F.col("text")).alias("file_hash"))
    return files.first_copies(docs, table(spark, d, "ingestion_log"), order="doc_id").select("doc_id", "file_hash")


@query("SELECT filename, file_size, CASE WHEN file_size = 0 THEN 'empty file' WHEN file_size > 52428800 THEN 'file too large' END AS error_message FROM ingestion_log")
def s03_size_gate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ingestion_log").select("filename", "file_size", files.validation_error(F.col("file_size")).alias("error_message"))


@query(r"SELECT filename, regexp_extract(lower(filename), '\.([^./]+)$', 1) AS extension FROM ingestion_log")
def s06_extension(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ingestion_log").select("filename", files.extension(F.col("filename")).alias("extension"))


_TYPE = """CASE WHEN ext IN ('pdf') THEN 'PDF' WHEN ext IN ('docx', 'doc') THEN 'DOCX' WHEN ext IN ('eml', 'mbox') THEN 'EMAIL'
  WHEN ext IN ('md', 'markdown', 'mdx') THEN 'MARKDOWN' WHEN ext IN ('py', 'pyw') THEN 'PYTHON'"""
_LOOKS = r"""
 len(list_filter(list_slice(regexp_split_to_array(substring(text, 1, 2000), '\r\n|\r|\n'), 1, 10), lambda x: regexp_matches(x, '^\[?\d{1,2}/\d{1,2}/\d{2,4},\s*\d{1,2}:\d{2}'))) >= 2 AS chat,
 regexp_matches(regexp_replace(substring(text, 1, 1000), '^\s+', ''), '^From[: ]') AS email,
 regexp_matches(substring(text, 1, 1000), '(?m)^commit [0-9a-f]{40}') OR contains(substring(text, 1, 1000), '<<<COMMIT_START>>>') AS git"""


@query(f"""
WITH x AS (SELECT doc_id, regexp_extract(lower(source_document), '\\.([^./]+)$', 1) AS ext, {_LOOKS} FROM documents WHERE text IS NOT NULL AND source_document IS NOT NULL)
SELECT doc_id, {_TYPE} WHEN ext IN ('txt', 'log') THEN CASE WHEN chat THEN 'WHATSAPP' WHEN email THEN 'EMAIL' WHEN git THEN 'GIT' WHEN ext = 'txt' THEN 'MARKDOWN' END END AS source_type FROM x""")
def s07_source_type(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text is not null and source_document is not null")
    return docs.select("doc_id", files.source_type(F.col("source_document"), F.col("text")).alias("source_type"))


@query(f"""
WITH t AS (SELECT doc_id, doc_id || '-' || source_document AS filename, text, sha256(text) AS file_hash FROM documents WHERE text IS NOT NULL AND source_document IS NOT NULL), g AS (SELECT * FROM t WHERE strlen(text) > 0),
f AS (SELECT file_hash, min(filename) AS filename FROM g WHERE file_hash NOT IN (SELECT file_hash FROM ingestion_log WHERE status = 'success' AND file_hash IS NOT NULL) GROUP BY 1),
x AS (SELECT g.filename, g.file_hash, strlen(text) AS file_size, regexp_extract(lower(g.filename), '\\.([^./]+)$', 1) AS ext, {_LOOKS} FROM g JOIN f USING (filename)),
y AS (SELECT *, {_TYPE} WHEN ext IN ('txt', 'log') OR ext NOT IN ('pdf') THEN CASE WHEN chat THEN 'WHATSAPP' WHEN email THEN 'EMAIL' WHEN git THEN 'GIT' WHEN ext = 'txt' THEN 'MARKDOWN' END END AS source_type FROM x)
SELECT filename, file_hash, file_size, source_type, 'success' AS status FROM y WHERE source_type IS NOT NULL""")
def s01_ingestion_log(spark: SparkSession, d: str) -> DataFrame:
    """The documents as files (their source document's name, their text's bytes) through the whole chain: what is logged."""
    docs = table(spark, d, "documents").filter("text is not null and source_document is not null")
    read = docs.select(F.concat(F.col("doc_id").cast("string"), F.lit("-"), "source_document").alias("filename"), F.encode("text", "UTF-8").alias("content")).withColumn("length", F.length("content").cast("bigint"))
    return ingest_files(read, table(spark, d, "ingestion_log"))[1].select("filename", "file_hash", "file_size", "source_type", "status")


@query(f"SELECT chunk_uid, chat, email, git FROM (SELECT DISTINCT chunk_uid, chunk_text AS text FROM raw_chunks WHERE chunk_text IS NOT NULL), LATERAL (SELECT {_LOOKS})")
def s08_sniff(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("chunk_text")
    rows = table(spark, d, "raw_chunks").filter("chunk_text is not null")
    return rows.select("chunk_uid", files.looks_like_chat(t).alias("chat"), files.looks_like_email(t).alias("email"), files.looks_like_git_log(t).alias("git")).distinct()


_SECTION_START = "regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g'), '(?s)\\A---\\n.*?\\n---\\n', ''), '(?m)^(#{1,6}[ \\t\\n\\x0B\\f\\r]+\\S)', chr(1) || '\\1', 'g'), chr(1))"
_MARKDOWN = """k0 AS (SELECT doc_id, list_filter(""" + _SECTION_START + """, lambda s: """ + _STRIP.format("s") + """ <> '') AS p FROM documents WHERE lower(trim(source)) = 'markdown' AND text IS NOT NULL),
k1 AS (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) - 1 AS position FROM k0),
k2 AS (SELECT *, length(regexp_extract(s, '^(#{1,6})[ \\t\\n\\x0B\\f\\r]', 1)) AS lv, trim(regexp_extract(s, '^#{1,6}[ \\t\\n\\x0B\\f\\r]+(.+)', 1)) AS title FROM k1),
k3 AS (SELECT a.doc_id, a.position, string_agg(b.title, ' > ' ORDER BY b.position) AS path FROM k2 a JOIN k2 b ON b.doc_id = a.doc_id AND b.position <= a.position AND b.lv > 0
  AND NOT EXISTS (SELECT 1 FROM k2 c WHERE c.doc_id = a.doc_id AND c.position > b.position AND c.position <= a.position AND c.lv > 0 AND c.lv <= b.lv) GROUP BY 1, 2)"""


def _sections(spark: SparkSession, d: str) -> DataFrame:
    return parsers.parse_markdown(table(spark, d, "documents").filter(F.lower(F.trim("source")) == "markdown"), "doc_id", "text")


_SECTION_HEAD = r"regexp_extract(s, '^(#{1,6}[ \t\n\x0B\f\r]+[^\n]*)', 1)"
_SECTION_BODY = _STRIP.format(r"regexp_replace(s, '^#{1,6}[ \t\n\x0B\f\r]+[^\n]*\n?', '')")


@query("WITH " + _MARKDOWN + " SELECT doc_id, position, lv AS heading_level, title AS heading_text, coalesce(path, '') AS section_path, sha256(CASE WHEN lv > 0 THEN " + _STRIP.format(f"{_SECTION_HEAD} || chr(10) || chr(10) || {_SECTION_BODY}") + " ELSE " + _STRIP.format("s") + " END) AS text_hash FROM k2 LEFT JOIN k3 USING (doc_id, position)")
def s14_markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    return _sections(spark, d).withColumn("text_hash", F.sha2("section_text", 256)).drop("section_text")


@query()
def s15_python_elements(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "python_elements").dropDuplicates(["element_row"])
    return parsers.parse_python(rows, "element_row", "body", "source_document")


@query(lambda: f"WITH {_MAIL} SELECT chunk_uid, position, sender, timestamp, subject, sha256(body) AS body_hash, is_forwarded FROM mail")
def s16_email_messages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "raw_chunks").filter("source_type = 'EMAIL'").dropDuplicates(["chunk_uid"])
    return parsers.parse_email(rows, "chunk_uid", "chunk_text").withColumn("body_hash", F.sha2("body", 256)).drop("body")


@query(r"""
WITH l AS (SELECT DISTINCT chunk_uid, regexp_split_to_array(chunk_text, '\r\n|\r|\n') AS a FROM raw_chunks WHERE source_type = 'WHATSAPP' AND chunk_text IS NOT NULL),
n AS (SELECT chunk_uid, len(list_filter(a, lambda x: regexp_matches(x, '^\s*(?:\[\d{1,2}/\d{1,2}/\d{2,4},\s*\d{1,2}:\d{2}(?::\d{2})?(?:\s*[AP]M)?\]|\d{1,2}/\d{1,2}/\d{2,4},\s*\d{1,2}:\d{2}(?::\d{2})?(?:\s*[AP]M)?\s+-)\s+.+?:\s+'))) AS n_messages FROM l)
SELECT chunk_uid, n_messages FROM n WHERE n_messages > 0""")
def s17_chat_message_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "raw_chunks").filter("source_type = 'WHATSAPP'").dropDuplicates(["chunk_uid"])
    return parsers.parse_chat(rows, "chunk_uid", "chunk_text").groupBy("chunk_uid").agg(F.count(F.lit(1)).alias("n_messages"))


_CHAT_AT = r"\d{1,2}/\d{1,2}/\d{2,4},[ \t\n\x0B\f\r]*\d{1,2}:\d{2}(?::\d{2})?(?:[ \t\n\x0B\f\r]*[AP]M)?"
_CHAT_HEAD = rf"[ \t\n\x0B\f\r]*(?:\[{_CHAT_AT}\]|{_CHAT_AT}[ \t\n\x0B\f\r]+-)[ \t\n\x0B\f\r]+.+?:[ \t\n\x0B\f\r]"
_CHAT_FIRST = rf"^[ \t\n\x0B\f\r]*(?:\[({_CHAT_AT})\]|({_CHAT_AT})[ \t\n\x0B\f\r]+-)[ \t\n\x0B\f\r]+(.+?):[ \t\n\x0B\f\r]+(.*)$"


@query(f"""WITH g0 AS (SELECT DISTINCT chunk_uid, chunk_text FROM raw_chunks WHERE source_type = 'WHATSAPP' AND chunk_text IS NOT NULL),
g1 AS (SELECT chunk_uid, regexp_split_to_array(regexp_replace(chr(10) || regexp_replace(chunk_text, '\\r\\n|\\r', chr(10), 'g'), '\\n({_CHAT_HEAD})', chr(1) || '\\1', 'g'), chr(1)) AS p FROM g0),
g2 AS (SELECT chunk_uid, unnest(p) AS s, generate_subscripts(p, 1) - 1 AS position FROM g1), g3 AS (SELECT chunk_uid, position, regexp_split_to_array(s, '\\n') AS l FROM g2),
g4 AS (SELECT chunk_uid, position, list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], '{_CHAT_FIRST}')) AS hit, l FROM g3), g5 AS (SELECT chunk_uid, position, l[hit[1]] AS h, array_to_string(list_prepend(trim(regexp_extract(l[hit[1]], '{_CHAT_FIRST}', 4)), l[hit[1] + 1:]), chr(10)) AS body FROM g4 WHERE len(hit) > 0)
SELECT chunk_uid, position, trim(regexp_extract(h, '{_CHAT_FIRST}', 3)) AS sender, trim(regexp_extract(h, '{_CHAT_FIRST}', 1) || regexp_extract(h, '{_CHAT_FIRST}', 2)) AS timestamp, sha256(body) AS text_hash, contains(body, '<Media omitted>') AS is_media,
 regexp_matches(body, '(?i)added|removed|left|joined|created|changed|Messages and calls|<Media omitted>|This message was deleted|You deleted this message|Security code changed') AS is_system FROM g5""")
def s17_chat_messages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "raw_chunks").filter("source_type = 'WHATSAPP'").dropDuplicates(["chunk_uid"])
    return parsers.parse_chat(rows, "chunk_uid", "chunk_text").withColumn("text_hash", F.sha2("message_text", 256)).drop("message_text")


@query(r"""WITH c AS (SELECT DISTINCT ON (commit_row) * FROM git_commits WHERE regexp_full_match(commit_sha, '[0-9a-f]{40}')), m AS (SELECT source_document, commit_row, commit_sha, trim(coalesce(author, '')) AS author, trim(coalesce(date, '')) AS date,
 regexp_split_to_array(regexp_replace(coalesce(message, ''), '\r\n|\r', chr(10), 'g'), chr(10)) AS l FROM c)
SELECT source_document, row_number() OVER (PARTITION BY source_document ORDER BY commit_row) - 1 AS position, commit_sha, author, date, sha256(STRIPPED) AS message_hash, len(list_filter(l, lambda x: starts_with(lower(x), 'merge'))) > 0 AS is_merge FROM m""".replace("STRIPPED", r"regexp_replace(array_to_string(l, chr(10)), '^[\s\x0B\x1C-\x1F\x85\p{Z}]+|[\s\x0B\x1C-\x1F\x85\p{Z}]+$', '', 'g')").replace("\\\\", "\\"))
def s18_git_commits(spark: SparkSession, d: str) -> DataFrame:
    """A log per source document put together from the commit table in ``git log`` form, parsed again."""
    rows = table(spark, d, "git_commits").dropDuplicates(["commit_row"]).filter(F.col("commit_sha").rlike(r"^[0-9a-f]{40}$"))
    entry = F.concat(F.lit("commit "), F.col("commit_sha"), F.lit("\nAuthor: "), F.coalesce("author", F.lit("")), F.lit("\nDate:   "), F.coalesce("date", F.lit("")), F.lit("\n\n    "), F.regexp_replace(F.coalesce("message", F.lit("")), r"\r\n|\r|\n", "\n    "), F.lit("\n"))
    logs = rows.groupBy("source_document").agg(F.array_sort(F.collect_list(F.struct("commit_row", entry.alias("e")))).alias("_e"))
    return parsers.parse_git_log(logs.select("source_document", F.array_join(F.transform("_e", lambda e: e["e"]), "\n").alias("log")), "source_document", "log").withColumn("message_hash", F.sha2("message", 256)).drop("message", "changed_files")


@query("SELECT CASE WHEN source_type IN ('PDF', 'DOCX', 'EMAIL', 'WHATSAPP', 'GIT', 'MARKDOWN', 'PYTHON') THEN source_type ELSE 'MARKDOWN' END AS source_type, count(*) AS n FROM (SELECT DISTINCT chunk_uid, source_type FROM raw_chunks) GROUP BY 1")
def s20_known_types(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by type; a type outside the domain counts as Markdown."""
    kind = F.when(F.col("source_type").isin(*SOURCE_TYPES), F.col("source_type")).otherwise("MARKDOWN")
    return table(spark, d, "raw_chunks").select("chunk_uid", "source_type").distinct().groupBy(kind.alias("source_type")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT seq, entity_type, entity_id, source_document, created_at FROM evidence WHERE entity_type = 'REQUIREMENT'")
def s21_scan_by_type(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "evidence").filter("entity_type = 'REQUIREMENT'").select("seq", "entity_type", "entity_id", "source_document", "created_at").distinct().orderBy(F.desc("created_at"))


_SOME = {"entity_id": "REQUIREMENT", "linked_requirement": "IMPLEMENTATION", "chunk_id": "IMPLEMENTATION", "source_document": "EVALUATION"}
_SCANS = " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS by, seq FROM evidence WHERE {c} = (SELECT min({c}) FROM evidence WHERE entity_type = '{kind}')" for c, kind in _SOME.items())


@query(_SCANS)
def s21_scans(spark: SparkSession, d: str) -> DataFrame:
    """Evidence by entity, link, chunk and document, for one value of each."""
    rows = table(spark, d, "evidence")
    first = rows.agg(*[F.min(F.when(F.col("entity_type") == kind, F.col(c))).alias(c) for c, kind in _SOME.items()]).first()
    return union_all([store.scan(rows, **{c: first[c]}).select(F.lit(c).alias("by"), "seq").distinct() for c in _SOME])


@query("SELECT DISTINCT seq, correlation_id, status FROM correlation WHERE requirement_entity_id = (SELECT min(requirement_entity_id) FROM correlation WHERE requirement_entity_id <> '(unlinked)')")
def s23_scan_by_requirement(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "correlation")
    first = rows.filter("requirement_entity_id <> '(unlinked)'").agg(F.min("requirement_entity_id")).first()[0]
    return store.scan(rows, requirement_entity_id=first).select("seq", "correlation_id", "status").distinct()


@query("SELECT filename, status, ingested_at FROM ingestion_log ORDER BY ingested_at DESC")
def s22_ingestion_log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ingestion_log").select("filename", "status", "ingested_at").orderBy(F.desc("ingested_at"))


@query("SELECT DISTINCT seq, correlation_id, requirement_entity_id, status FROM correlation WHERE status = 'PARTIALLY_IMPLEMENTED'")
def s23_scan_by_status(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "correlation").filter("status = 'PARTIALLY_IMPLEMENTED'").select("seq", "correlation_id", "requirement_entity_id", "status").distinct()


@query("SELECT DISTINCT chunk_uid, sha256(source_hash || '::' || chunk_index::VARCHAR) AS chunk_id FROM raw_chunks WHERE sha256(source_hash || '::' || chunk_index::VARCHAR) IN (SELECT chunk_id FROM evidence)")
def s24_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "raw_chunks").select("chunk_uid", T.chunk_id(F.col("source_hash"), F.col("chunk_index")).alias("chunk_id"))
    return chunks.join(table(spark, d, "evidence").select("chunk_id").distinct(), "chunk_id", "left_semi").distinct()


# ---- sinks -----------------------------------------------------------------------------------------------

_HALF = "DATE '2024-07-01'"


def _halves(spark: SparkSession, d: str, name: str, time: str) -> tuple[DataFrame, DataFrame]:
    rows, cut = table(spark, d, name), F.lit("2024-07-01").cast("timestamp")
    return rows.filter(F.col(time) < cut), rows.filter(F.col(time) >= cut)


@query(f"""
WITH old AS (SELECT * FROM evidence WHERE created_at < {_HALF}), new AS (SELECT * FROM evidence WHERE created_at >= {_HALF}),
r AS (SELECT *, row_number() OVER (PARTITION BY entity_id, chunk_id, entity_type ORDER BY seq) AS n FROM new)
SELECT seq, entity_id, chunk_id, entity_type FROM r WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM old WHERE old.entity_id = r.entity_id AND old.chunk_id = r.chunk_id AND old.entity_type = r.entity_type)""")
def k01_insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    old, new = _halves(spark, d, "evidence", "created_at")
    return store.insert_if_absent(old, new, ["entity_id", "chunk_id", "entity_type"], "seq").select("seq", "entity_id", "chunk_id", "entity_type")


@query(f"""
WITH a AS (SELECT file_hash, filename, status, ingested_at, CASE WHEN ingested_at < {_HALF} THEN 0 ELSE 1 END AS w FROM ingestion_log)
SELECT file_hash, filename, status, ingested_at FROM (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY w DESC, ingested_at DESC, filename DESC, status DESC) AS n FROM a) WHERE n = 1""")
def k02_replace_by_hash(spark: SparkSession, d: str) -> DataFrame:
    old, new = (x.select("file_hash", "filename", "status", "ingested_at") for x in _halves(spark, d, "ingestion_log", "ingested_at"))
    return store.replace_by_key(old, new, "file_hash", ["ingested_at", "filename", "status"])


@query("SELECT seq, correlation_id, to_json(coalesce(supporting_chunk_ids, []))::VARCHAR AS ids_json, count(*) AS n FROM correlation WHERE confidence BETWEEN 0 AND 1 GROUP BY ALL")
def k03_append_rows(spark: SparkSession, d: str) -> DataFrame:
    """Older, then newer correlations appended to a stored table, which is read again whole."""
    path = scratch(spark, "k03")
    for half in _halves(spark, d, "correlation", "created_at"):
        store.append_correlations(half, path)
    return spark.read.parquet(path).groupBy("seq", "correlation_id", F.col("supporting_chunk_ids").alias("ids_json")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'evidence' AS name, count(*) AS n FROM evidence WHERE entity_type IN ('REQUIREMENT', 'IMPLEMENTATION', 'EVALUATION') AND trim(source_document) <> '' AND trim(chunk_id) <> '' UNION ALL SELECT 'ingestion_log', count(*) FROM ingestion_log UNION ALL SELECT x, 0 FROM (SELECT unnest(['chunks', 'embeddings', 'correlation']) AS x)")
def k07_tables(spark: SparkSession, d: str) -> DataFrame:
    """The store's tables made twice, rows of two of them appended, and counted."""
    path = scratch(spark, "k07")
    store.create_tables(spark, path)
    store.append(store.split_valid_evidence(table(spark, d, "evidence"))[0].select("seq", "entity_type", "entity_id", "text", "linked_requirement", "source_document", "chunk_id", "author", "timestamp", "metadata", "created_at"), f"{path}/evidence")
    store.append(table(spark, d, "ingestion_log").drop("zone_name"), f"{path}/ingestion_log")
    store.create_tables(spark, path)
    counts = [spark.read.parquet(f"{path}/{name}").agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name in store.TABLES]
    return union_all(counts)


@query(f"""
WITH old AS (SELECT DISTINCT chunk_uid, char_count FROM raw_chunks WHERE loaded_at < {_HALF} AND chunk_uid % 2 = 0), new AS (SELECT DISTINCT chunk_uid, length(chunk_text) AS char_count FROM raw_chunks)
SELECT * FROM old WHERE chunk_uid NOT IN (SELECT chunk_uid FROM new) UNION ALL SELECT * FROM new""")
def k04_upsert(spark: SparkSession, d: str) -> DataFrame:
    """All chunks with their true length over a store that holds older rows under even numbers."""
    rows = table(spark, d, "raw_chunks")
    old = rows.filter((F.col("loaded_at") < F.lit("2024-07-01").cast("timestamp")) & (F.col("chunk_uid") % 2 == 0)).select("chunk_uid", F.col("char_count").cast("bigint").alias("char_count")).distinct()
    new = rows.select("chunk_uid", F.length("chunk_text").cast("bigint").alias("char_count")).distinct()
    return store.upsert(old, new, "chunk_uid")


@query("SELECT source_document, count(*) AS n FROM evidence WHERE source_document <> (SELECT min(source_document) FROM evidence) OR source_document IS NULL GROUP BY 1")
def k05_delete_by_source(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "evidence")
    first = rows.agg(F.min("source_document")).first()[0]
    return store.delete_where(rows, "source_document", first).groupBy("source_document").agg(F.count(F.lit(1)).alias("n"))


# ---- chunking --------------------------------------------------------------------------------------------


_SENTENCES = "list_filter(list_transform(regexp_split_to_array(regexp_replace({0}, '([.!?])" + _SPACE + "+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: " + _STRIP.format("s") + "), lambda s: s <> '')"
_PARAGRAPHS = "list_filter(list_transform(regexp_split_to_array({0}, '\\n" + _SPACE + "*\\n'), lambda s: " + _STRIP.format("s") + "), lambda s: s <> '')"


@query(f"SELECT doc_id, len(p) AS n_sentences, list_aggregate(list_transform(p, lambda s: length(s)), 'sum')::BIGINT AS n_chars FROM (SELECT doc_id, {_SENTENCES.format('text')} AS p FROM documents WHERE text IS NOT NULL)")
def c01_sentences(spark: SparkSession, d: str) -> DataFrame:
    return _piece_counts(spark, d, T.sentences, "n_sentences")


@query(f"SELECT doc_id, len(p) AS n_paragraphs, list_aggregate(list_transform(p, lambda s: length(s)), 'sum')::BIGINT AS n_chars FROM (SELECT doc_id, {_PARAGRAPHS.format('text')} AS p FROM documents WHERE text IS NOT NULL)")
def c02_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return _piece_counts(spark, d, T.paragraphs, "n_paragraphs")


def _piece_counts(spark: SparkSession, d: str, cut, name: str) -> DataFrame:
    """How many pieces a document has and how many characters they hold together (NULL: none)."""
    rows = table(spark, d, "documents").filter("text is not null").select("doc_id", cut(F.col("text")).alias("p"))
    total = F.aggregate("p", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x))
    return rows.select("doc_id", F.size("p").alias(name), F.when(F.size("p") > 0, total).alias("n_chars"))


# greedy packing, joining of short pieces and cascading overlap as folds over lists; d: done, o: open
_PACK = "list_reduce(list_prepend({{'d': []::VARCHAR[], 'o': ''}}, list_transform({0}, lambda p: {{'d': []::VARCHAR[], 'o': p}})), lambda a, b: CASE WHEN a.o = '' THEN {{'d': a.d, 'o': b.o}} WHEN length(a.o) + length(b.o) + 2 > 1500 THEN {{'d': list_append(a.d, a.o), 'o': b.o}} ELSE {{'d': a.d, 'o': a.o || chr(10) || chr(10) || b.o}} END)"
_JOIN = "list_reduce(list_prepend({{'d': []::VARCHAR[], 'o': ''}}, list_transform({0}, lambda p: {{'d': []::VARCHAR[], 'o': p}})), lambda a, b: CASE WHEN length(CASE WHEN a.o = '' THEN b.o ELSE a.o || chr(10) || chr(10) || b.o END) < 50 THEN {{'d': a.d, 'o': CASE WHEN a.o = '' THEN b.o ELSE a.o || chr(10) || chr(10) || b.o END}} ELSE {{'d': list_append(a.d, CASE WHEN a.o = '' THEN b.o ELSE a.o || chr(10) || chr(10) || b.o END), 'o': ''}} END)"
_OVERLAP = "list_reduce(list_transform({0}, lambda p: [p]), lambda a, b: list_append(a, " + _STRIP.format("right(a[-1], 150) || chr(10) || chr(10) || b[1]") + "))"


# Markdown: empty lines outside fenced code
_FENCED = "list_filter(list_transform(string_split(array_to_string(list_transform(regexp_extract_all({0}, '(?s)```.*?```|~~~.*?~~~|[^`~]+|[`~]'), lambda x: CASE WHEN length(x) > 5 AND left(x, 3) IN ('```', '~~~') THEN replace(x, chr(10), chr(2)) ELSE x END), ''), chr(10) || chr(10)), lambda x: " + _STRIP.format("replace(x, chr(2), chr(10))") + "), lambda x: x <> '')"


def _fold_sql(source: str, key: str, overlap: bool, twice: bool, paragraphs: str = _PARAGRAPHS) -> str:
    """Chunks of documents from their elements (key, ord, t): each cut on its own, once or twice, joined if short, overlapped."""
    cut = lambda t: f"CASE WHEN length({t}) <= 1500 THEN [{t}] WHEN len({paragraphs.format(t)}) > 1 THEN list_append(({_PACK.format(paragraphs.format(t))}).d, ({_PACK.format(paragraphs.format(t))}).o) WHEN len({_SENTENCES.format(t)}) > 1 THEN list_append(({_PACK.format(_SENTENCES.format(t))}).d, ({_PACK.format(_SENTENCES.format(t))}).o) ELSE [{t}] END"
    return f"""p1 AS (SELECT {key}, ord, {_STRIP.format('t')} AS t FROM ({source})), p2 AS (SELECT {key}, ord, {cut('t')} AS l FROM p1 WHERE t <> ''),
p3 AS (SELECT {key}, ord, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM p2), p4 AS (SELECT {key}, ord, i, {cut('t') if twice else '[t]'} AS l FROM p3),
p5 AS (SELECT {key}, flatten(list(l ORDER BY ord, i)) AS l FROM p4 GROUP BY 1), p6 AS (SELECT {key}, {_JOIN.format('l')} AS r FROM p5), p7 AS (SELECT {key}, CASE WHEN r.o = '' THEN r.d ELSE list_append(r.d, r.o) END AS l FROM p6),
p8 AS (SELECT {key}, {_OVERLAP.format('l') if overlap else 'l'} AS l FROM p7) SELECT {key}, generate_subscripts(l, 1) - 1 AS chunk_index, sha256(unnest(l)) AS text_hash FROM p8"""


def _hashed(chunks: DataFrame, key: str) -> DataFrame:
    return chunks.select(key, "chunk_index", F.sha2("chunk_text", 256).alias("text_hash"))


def _chunk_sql(source: str, key: str, text: str) -> str:
    """CTEs up to ``ch`` (key, l: the chunks in order without overlap) for one text per row."""
    return f"""x0 AS ({source}), x1 AS (SELECT {key}, {text} AS t, {_PARAGRAPHS.format(text)} AS ps, {_SENTENCES.format(text)} AS ss FROM x0 WHERE {_STRIP.format(text)} <> ''),
x2 AS (SELECT {key}, t, CASE WHEN length(t) <= 1500 THEN NULL WHEN len(ps) > 1 THEN ps WHEN len(ss) > 1 THEN ss END AS parts FROM x1),
x3 AS (SELECT {key}, CASE WHEN parts IS NULL THEN {{'d': []::VARCHAR[], 'o': t}} ELSE {_PACK.format('parts')} END AS r FROM x2),
x4 AS (SELECT {key}, {_JOIN.format('list_append(r.d, r.o)')} AS r FROM x3), ch AS (SELECT {key}, CASE WHEN r.o = '' THEN r.d ELSE list_append(r.d, r.o) END AS l FROM x4)"""


_DOCUMENT_CHUNKS = _chunk_sql("SELECT doc_id, text FROM documents WHERE text IS NOT NULL", "doc_id", "text")


@query(f"WITH {_DOCUMENT_CHUNKS}, u AS (SELECT doc_id, unnest(l) AS chunk_text, generate_subscripts(l, 1) - 1 AS chunk_index FROM ch) SELECT doc_id, chunk_index, chunk_text, length(chunk_text) AS char_count FROM u")
def c04_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_documents(table(spark, d, "documents"), "doc_id", "text", overlap=False)


@query(f"WITH {_DOCUMENT_CHUNKS}, ov AS (SELECT doc_id, {_OVERLAP.format('l')} AS l FROM ch), u AS (SELECT doc_id, unnest(l) AS chunk_text, generate_subscripts(l, 1) - 1 AS chunk_index FROM ov) SELECT doc_id, chunk_index, chunk_text, length(chunk_text) AS char_count FROM u")
def c06_chunks_with_overlap(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_documents(table(spark, d, "documents"), "doc_id", "text")


@query(r"""
WITH x AS (SELECT DISTINCT chunk_uid, source_document, chunk_index, chunk_text FROM raw_chunks WHERE source_type = 'EMAIL' AND chunk_text IS NOT NULL AND source_document IS NOT NULL),
w AS (SELECT chunk_uid, row_number() OVER o AS n, lag(chunk_text, 2) OVER o AS a, lag(chunk_text, 1) OVER o AS b FROM x WINDOW o AS (PARTITION BY source_document ORDER BY chunk_uid))
SELECT chunk_uid, CASE WHEN n > 1 THEN sha256(CASE WHEN a IS NULL THEN b ELSE a || chr(10) || '---' || chr(10) || b END) END AS context_hash FROM w""")
def c12_trailing_context(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "raw_chunks").filter("source_type = 'EMAIL' and chunk_text is not null and source_document is not null").dropDuplicates(["chunk_uid"])
    return chunking.trailing_context(rows, "source_document", "chunk_uid", "chunk_text").select("chunk_uid", F.sha2("context", 256).alias("context_hash"))


_MAIL_SPLIT = "regexp_split_to_array(regexp_replace(" + _STRIP.format(r"regexp_replace(chunk_text, '\r\n|\r', chr(10), 'g')") + ", '\\nFrom:(" + _SPACE + ")', chr(1) || 'From:\\1', 'g'), chr(1))"
_FIELDS = r"From|To|Date|Subject|Cc|Bcc|Reply-To|Message-ID|Content-Type|Content-Transfer-Encoding|MIME-Version|Received|Return-Path|X-[A-Za-z0-9_]+"
_HEADER_LINE = "'(?im)^(?:" + _FIELDS + r"):[^\S\n]*.*$'"
_MAIL = f"""m0 AS (SELECT DISTINCT chunk_uid, source_document, chunk_text FROM raw_chunks WHERE source_type = 'EMAIL' AND chunk_text IS NOT NULL),
m1 AS (SELECT chunk_uid, source_document, unnest({_MAIL_SPLIT}) AS s, generate_subscripts({_MAIL_SPLIT}, 1) - 1 AS position FROM m0),
m2 AS (SELECT chunk_uid, source_document, position, trim(regexp_extract(s, '(?im)^From:[^\\S\\n]*(.+)$', 1)) AS f, trim(regexp_extract(s, '(?im)^Date:[^\\S\\n]*(.+)$', 1)) AS t, trim(regexp_extract(s, '(?im)^Subject:[^\\S\\n]*(.+)$', 1)) AS j,
  {_STRIP.format("regexp_replace(" + _STRIP.format("regexp_replace(s, " + _HEADER_LINE + ", '', 'g')") + ", '(?m)^" + _SPACE + "*[-_=]{3,}" + _SPACE + "*$', '', 'g')")} AS body FROM m1),
mail AS (SELECT chunk_uid, source_document, position, CASE WHEN f = '' THEN 'Unknown' ELSE f END AS sender, CASE WHEN t = '' THEN 'Unknown' ELSE t END AS timestamp, CASE WHEN j = '' THEN '(no subject)' ELSE j END AS subject, body,
  regexp_matches(body, '(?i)-{{5,}}\\s*Forwarded message\\s*-{{5,}}') AS is_forwarded FROM m2 WHERE f <> '' OR t <> '')"""


_MAIL_TEXTS = f"""{_MAIL}, h AS (SELECT *, 'From: ' || sender || ' | Date: ' || timestamp || ' | Subject: ' || subject || chr(10) || chr(10) || body AS raw FROM mail WHERE body <> '' AND source_document IS NOT NULL),
w AS (SELECT *, row_number() OVER o AS n, lag(raw, 2) OVER o AS a, lag(raw, 1) OVER o AS b FROM h WINDOW o AS (PARTITION BY source_document ORDER BY chunk_uid, position)),
z AS (SELECT source_document, chunk_uid, position, 'Message ' || n || ' from ' || sender AS locator, CASE WHEN n = 1 THEN raw ELSE '[Previous context:]' || chr(10) || CASE WHEN a IS NULL THEN b ELSE a || chr(10) || '---' || chr(10) || b END || chr(10) || '[End context]' || chr(10) || chr(10) || raw END AS text FROM w)"""


@query(f"""WITH {_MAIL_TEXTS} SELECT source_document, chunk_uid, position, locator, sha256({_STRIP.format('text')}) AS text_hash FROM z""")
def c12_email_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every message of the mail texts with its header, after the two messages before it in its document."""
    rows = chunking.email_texts(_mail(spark, d), "source_document", "message_no", chunking.SLICE << 20)
    return rows.select("source_document", "chunk_uid", "position", "locator", F.sha2("text", 256).alias("text_hash"))


def _mail(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "raw_chunks").filter("source_type = 'EMAIL' and chunk_text is not null and source_document is not null").dropDuplicates(["chunk_uid"])
    mail = parsers.parse_email(rows, "chunk_uid", "chunk_text").join(rows.select("chunk_uid", "source_document"), "chunk_uid")
    return mail.withColumn("message_no", F.col("chunk_uid") * (1 << 20) + F.col("position"))  # a chunk holds fewer messages than characters, far below 2^20


@query(f"WITH {_MAIL_TEXTS}, " + _fold_sql("SELECT source_document, chunk_uid * 1048576 + position AS ord, text AS t FROM z", "source_document", False, False))
def c12_email_chunks(spark: SparkSession, d: str) -> DataFrame:
    """``c12_email_texts`` within the limits of size."""
    return _hashed(chunking.email_chunks(_mail(spark, d), "source_document", "message_no", width=chunking.SLICE << 20), "source_document")


_CHAT_TIME = "coalesce(" + ", ".join(f"CASE WHEN {'y4' if '%Y' in f else 'NOT y4'} AND {'ap' if '%p' in f else 'NOT ap'} THEN try_strptime(z, '{f}') END" for f in ("%d/%m/%Y, %H:%M:%S", "%d/%m/%Y, %H:%M", "%m/%d/%Y, %H:%M:%S", "%m/%d/%Y, %I:%M %p", "%d/%m/%y, %H:%M:%S", "%d/%m/%y, %H:%M", "%m/%d/%y, %I:%M %p", "%d/%m/%y, %I:%M %p")) + ")"
_CHAT = f"""h0 AS (SELECT DISTINCT ON (msg_id) * FROM chat_messages WHERE NOT is_media AND NOT is_system AND source_document IS NOT NULL AND trim(message_text) <> ''),
h1 AS (SELECT *, upper(regexp_replace({_STRIP.format('timestamp')}, '{_SPACE}+', ' ', 'g')) AS z FROM h0),
h2 AS (SELECT *, regexp_matches(z, '^\\d+/\\d+/\\d{{4}},') AS y4, regexp_matches(z, ' [AP]M$') AS ap FROM h1),
h3 AS (SELECT *, CASE WHEN regexp_matches(z, '^\\d{{1,2}}/\\d{{1,2}}/(\\d{{4}}|\\d{{2}}), \\d{{1,2}}:\\d{{1,2}}') THEN {_CHAT_TIME} END AS ts FROM h2),
h4 AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(last_value(ts IGNORE NULLS) OVER (PARTITION BY source_document ORDER BY msg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) > 1800000000 THEN 1 ELSE 0 END AS jump FROM h3),
win AS (SELECT *, sum(jump) OVER (PARTITION BY source_document ORDER BY msg_id) AS window_no, '[' || coalesce(timestamp, '') || '] ' || coalesce(sender, 'Unknown') || ': ' || coalesce(message_text, '') AS line FROM h4),
wt AS (SELECT source_document, window_no, min(msg_id) AS first_id, string_agg(line, chr(10) ORDER BY msg_id) AS text, coalesce(arg_min(coalesce(timestamp, ''), msg_id), '') || ' to ' || coalesce(arg_max(coalesce(timestamp, ''), msg_id), '') AS locator,
  array_to_string(list_sort(list(DISTINCT coalesce(sender, 'Unknown'))), ', ') AS participants, count(*) AS message_count FROM win GROUP BY 1, 2)"""


@query(f"WITH {_CHAT} SELECT msg_id, epoch_us(ts) AS micros FROM h3")
def c15_chat_times(spark: SparkSession, d: str) -> DataFrame:
    """The times of chat lines by the eight forms of chat exports, tried in order."""
    return _chat(spark, d).select("msg_id", F.col("us").alias("micros"))


def _chat(spark: SparkSession, d: str) -> DataFrame:
    chat = table(spark, d, "chat_messages").dropDuplicates(["msg_id"]).filter("not is_media and not is_system and source_document is not null and trim(message_text) <> ''")
    return chat.withColumn("us", F.unix_micros(chunking.chat_time(F.col("timestamp"))))


def _chat_windows(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chat_windows(_chat(spark, d), "source_document", "msg_id", "us")


@query(f"WITH {_CHAT} SELECT source_document, window_no, sha256(text) AS text_hash, locator, participants, message_count FROM wt")
def c13_chat_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of chat by the pauses in the order of the file."""
    rows = chunking.chat_chunks(_chat_windows(spark, d), "source_document", "msg_id")
    return rows.select("source_document", "window_no", F.sha2("text", 256).alias("text_hash"), "locator", F.array_join("participants", ", ").alias("participants"), "message_count")


_CHAT_TEXTS = f"""{_CHAT}, lg AS (SELECT source_document, msg_id, lag(line, 2) OVER o AS a, lag(line, 1) OVER o AS b FROM win WINDOW o AS (PARTITION BY source_document ORDER BY msg_id)),
ctx AS (SELECT wt.source_document, window_no, CASE WHEN b IS NULL THEN text ELSE '[Context:]' || chr(10) || CASE WHEN a IS NULL THEN b ELSE a || chr(10) || b END || chr(10) || chr(10) || '[Current window:]' || chr(10) || text END AS text
 FROM wt JOIN lg ON lg.source_document = wt.source_document AND msg_id = first_id)"""


@query(f"WITH {_CHAT_TEXTS} SELECT source_document, window_no, sha256(text) AS text_hash FROM ctx")
def c14_chat_texts(spark: SparkSession, d: str) -> DataFrame:
    """Each window after the last two messages before it."""
    rows = chunking.chat_context_texts(checkpoint(_chat_windows(spark, d)), "source_document", "msg_id")
    return rows.select("source_document", "window_no", F.sha2("text", 256).alias("text_hash"))


@query(f"WITH {_CHAT_TEXTS}, " + _fold_sql("SELECT source_document, window_no AS ord, text AS t FROM ctx", "source_document", False, False))
def c14_chat_chunks(spark: SparkSession, d: str) -> DataFrame:
    """``c14_chat_texts`` within the limits of size."""
    return _hashed(chunking.chat_context_chunks(checkpoint(_chat_windows(spark, d)), "source_document", "msg_id"), "source_document")


@query()
def c13_chat_windows_by_instant(spark: SparkSession, d: str) -> DataFrame:
    """Windows by the instants of all written forms (problem 6) instead of the eight of chat exports."""
    chat = table(spark, d, "chat_messages").dropDuplicates(["msg_id"]).filter("not is_media and not is_system and source_document is not null and trim(message_text) <> ''")
    timed = normalise(chat, "timestamp", "source_document", table(spark, d, "ingestion_log"), near="loaded_at")
    return chunking.chat_chunks(chunking.chat_windows(timed, "source_document", "msg_id", "utc_micros"), "source_document", "msg_id")


_PAGES = "SELECT DISTINCT source_document, chunk_uid, chunk_text FROM raw_chunks WHERE source_type = '{0}' AND source_document IS NOT NULL AND chunk_text IS NOT NULL"


@query("WITH " + _fold_sql("SELECT source_document, chunk_uid AS ord, chunk_text AS t FROM (" + _PAGES.format("PDF") + ")", "source_document", True, True))
def c08_page_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The PDF texts of each document as its pages."""
    rows = table(spark, d, "raw_chunks").filter("source_type = 'PDF' and source_document is not null").dropDuplicates(["chunk_uid"])
    pages = parsers.pages(rows.select("source_document", "chunk_uid", "chunk_text"), "source_document", "chunk_uid", "chunk_text")
    return _hashed(chunking.page_chunks(pages, "source_document"), "source_document")


_DOCX = f"""p0 AS ({_PAGES.format('DOCX')}), e AS (SELECT source_document, chunk_uid, {_STRIP.format('chunk_text')} AS t FROM p0 WHERE {_STRIP.format('chunk_text')} <> ''),
s AS (SELECT *, sum(CASE WHEN chunk_uid % 5 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source_document ORDER BY chunk_uid) AS n FROM e),
g AS (SELECT source_document, n, string_agg(t, chr(10) || chr(10) ORDER BY chunk_uid) AS section, any_value(CASE WHEN n > 0 THEN first END) AS path FROM s LEFT JOIN (SELECT source_document, n, arg_min(t, chunk_uid) AS first FROM s GROUP BY 1, 2) USING (source_document, n) GROUP BY 1, 2)"""


@query(f"""WITH {_DOCX} SELECT source_document, row_number() OVER (PARTITION BY source_document ORDER BY n) - 1 AS position, sha256(section) AS text_hash, coalesce(path, '') AS section_path FROM g""")
def c09_document_sections(spark: SparkSession, d: str) -> DataFrame:
    """The DOCX texts of each document as its elements, those whose number is divisible by 5 as headings: the body joined under them."""
    sections = chunking.document_sections(_docx(spark, d), "source_document")
    return sections.select("source_document", "position", F.sha2("section_text", 256).alias("text_hash"), "section_path")


def _docx(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "raw_chunks").filter("source_type = 'DOCX' and source_document is not null").dropDuplicates(["chunk_uid"])
    style = F.when(F.col("chunk_uid") % 5 == 0, "Heading 1").otherwise("Normal")
    return parsers.paragraphs(rows.select("source_document", F.col("chunk_uid").alias("position"), style.alias("style"), F.col("chunk_text").alias("text")), "source_document", "position")


@query(f"WITH {_DOCX}, " + _fold_sql("SELECT source_document, n AS ord, section AS t FROM g", "source_document", True, False))
def c09_document_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _hashed(chunking.document_chunks(_docx(spark, d), "source_document"), "source_document")


_PYTHON_PIECES = f"""e0 AS (SELECT DISTINCT ON (element_row) * FROM python_elements WHERE source_document IS NOT NULL AND body IS NOT NULL), e1 AS (SELECT source_document, element_row, element_type IN ('module', 'import_block') AS head, {_STRIP.format('body')} AS body FROM e0),
e2 AS (SELECT source_document, -1 AS ord, '# File: ' || source_document || chr(10) || chr(10) || string_agg(body, chr(10) || chr(10) ORDER BY element_row) AS t FROM e1 WHERE head AND body <> '' GROUP BY 1
  UNION ALL SELECT source_document, element_row, body FROM e1 WHERE NOT head AND body <> '')"""


@query(f"WITH {_PYTHON_PIECES}, " + _fold_sql("SELECT * FROM e2", "source_document", False, True))
def c11_python_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "python_elements").dropDuplicates(["element_row"]).filter("source_document is not null and body is not null")
    return _hashed(chunking.python_chunks(rows, "source_document", "element_row"), "source_document")


@query("WITH " + _MARKDOWN + ", k4 AS (SELECT doc_id, position AS ord, CASE WHEN lv > 0 THEN " + _STRIP.format(f"{_SECTION_HEAD} || chr(10) || chr(10) || {_SECTION_BODY}") + " ELSE s END AS t FROM k2), " + _fold_sql("SELECT * FROM k4", "doc_id", True, False, _FENCED))
def c10_markdown_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The Markdown documents, section by section; fenced code is never cut at its empty lines."""
    return _hashed(chunking.section_chunks(_sections(spark, d), "doc_id"), "doc_id")


@query("""
WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 1800000000 THEN 0 ELSE 1 END AS s FROM (SELECT DISTINCT user_id, event_id, ts FROM events)),
n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_id, arg_max(event_id, (ts, event_id)) AS last_id, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000.0::DOUBLE AS duration_seconds, count(*) AS n_events FROM n GROUP BY user_id, k""")
def c13_event_sessions(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return sessionise(events, ["user_id"], "us", "event_id").select("user_id", "first_id", "last_id", "duration_seconds", "n_events")


@query("""
WITH c AS (SELECT DISTINCT ON (commit_row) *, list_slice(coalesce(changed_files, []), 1, 20) AS f FROM git_commits),
t AS (SELECT commit_row, 'Commit: ' || coalesce(commit_sha, '') || chr(10) || 'Author: ' || coalesce(author, '') || chr(10) || 'Date: ' || coalesce(date, '') || chr(10) || chr(10) || coalesce(message, '')
  || CASE WHEN len(f) > 0 THEN chr(10) || chr(10) || 'Changed files:' || chr(10) || array_to_string(list_transform(f, lambda x: '- ' || x), chr(10)) ELSE '' END AS text, 'commit ' || substring(commit_sha, 1, 8) || ' (' || coalesce(date, '') || ')' AS locator FROM c)
SELECT commit_row, sha256(text) AS text_hash, locator, length(text) AS char_count FROM t""")
def c16_commit_texts(spark: SparkSession, d: str) -> DataFrame:
    commits = table(spark, d, "git_commits").dropDuplicates(["commit_row"])
    return chunking.commit_chunks(commits).select("commit_row", F.sha2("text", 256).alias("text_hash"), "locator", F.length("text").alias("char_count"))


@query("""SELECT DISTINCT ON (commit_row) commit_row, 'Commit: ' || coalesce(commit_sha, '') || chr(10) || 'Author: ' || coalesce(author, '') || chr(10) || 'Date: ' || coalesce(date, '') || chr(10) || chr(10) || coalesce(message, '')
 || CASE WHEN len(changed_files) > 0 THEN chr(10) || chr(10) || 'Changed files:' || chr(10) || array_to_string(list_transform(changed_files[1:20], lambda x: '- ' || x), chr(10)) ELSE '' END AS text, 'commit ' || substring(commit_sha, 1, 8) || ' (' || coalesce(date, '') || ')' AS locator FROM git_commits""")
def c16_commit_chunks(spark: SparkSession, d: str) -> DataFrame:
    commits = table(spark, d, "git_commits").dropDuplicates(["commit_row"])
    return chunking.commit_chunks(commits).select("commit_row", "text", "locator")


# ---- normal forms and identity ---------------------------------------------------------------------------


# full-width forms and wide blanks as a rule, composition by the engine; the texts hold no other compatibility characters
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3000\u00a0"
_PLAIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''") + "  "
_NORMAL = _STRIP.format(f"regexp_replace(regexp_replace(nfc_normalize(translate(chunk_text, '{_WIDE}', '{_PLAIN}')), '\\n{{{{3,}}}}', chr(10) || chr(10), 'g'), '[ \\t]{{{{2,}}}}', ' ', 'g')".replace("{{", "{").replace("}}", "}"))


@query(f"SELECT DISTINCT chunk_uid, sha256({_NORMAL}) AS text_hash FROM raw_chunks WHERE {_NORMAL} <> ''")
def n01_normalise(spark: SparkSession, d: str) -> DataFrame:
    return _normalised_hashes(table(spark, d, "raw_chunks"))


def _normalised_hashes(rows: DataFrame) -> DataFrame:
    return rows.select("chunk_uid", T.normalise(F.col("chunk_text")).alias("t")).filter("t <> ''").select("chunk_uid", F.sha2("t", 256).alias("text_hash")).distinct()


@query(f"SELECT DISTINCT ON (chunk_uid) chunk_uid, chunk_index, {_NORMAL} AS normalized_text, length({_NORMAL}) AS char_count FROM raw_chunks WHERE {_NORMAL} <> ''")
def n02_normalised_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "raw_chunks").dropDuplicates(["chunk_uid"]).withColumn("normalized_text", T.normalise(F.col("chunk_text")))
    return rows.filter("normalized_text <> ''").select("chunk_uid", "chunk_index", "normalized_text", F.length("normalized_text").alias("char_count"))


@query("SELECT DISTINCT chunk_uid, sha256(source_hash || '::' || chunk_index::VARCHAR) AS chunk_id FROM raw_chunks")
def n05_chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_chunks").select("chunk_uid", F.when(F.col("source_hash").isNotNull() & F.col("chunk_index").isNotNull(), T.chunk_id(F.col("source_hash"), F.col("chunk_index"))).alias("chunk_id")).distinct()


@query("SELECT DISTINCT chunk_uid, 'meta_' || k AS name, metadata[k] AS value FROM (SELECT chunk_uid, metadata, unnest(map_keys(metadata)) AS k FROM raw_chunks) WHERE metadata[k] IS NOT NULL")
def n06_flat_metadata(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_chunks").select("chunk_uid", F.explode(store.flat_metadata()).alias("name", "value")).distinct()


# ---- retrieval -------------------------------------------------------------------------------------------


@query("SELECT DISTINCT chunk_uid FROM raw_chunks WHERE source_type IN ('PYTHON', 'GIT') AND loaded_at >= TIMESTAMPTZ '2024-01-01 00:00:00+00' AND loaded_at <= TIMESTAMPTZ '2024-12-31 00:00:00+00'")
def q03_metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    utc = datetime.timezone.utc
    where = retrieval.metadata_filter(list(retrieval.PRESETS["implementation"]), since=datetime.datetime(2024, 1, 1, tzinfo=utc), until=datetime.datetime(2024, 12, 31, tzinfo=utc))
    return table(spark, d, "raw_chunks").withColumnRenamed("loaded_at", "created_at").filter(where).select("chunk_uid").distinct()


_COSINE = "greatest(list_inner_product(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) / (sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_inner_product(r.embedding::DOUBLE[], r.embedding::DOUBLE[]))), 0)"


@query(f"""
WITH s AS (SELECT q.vec_id AS query_id, r.vec_id AS row_id, round({_COSINE}, 9) AS score FROM embeddings q, embeddings r WHERE q.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM s) SELECT query_id, row_id, round(score, 6) AS score, rank FROM k WHERE rank <= 10""")
def q05_vector_top_k(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"))
    queries = rows.filter(F.col("row_id") % 20 == 0).withColumnRenamed("row_id", "query_id")
    return retrieval.vector_top_k(queries, rows).withColumn("score", F.round("score", 6))


@query(f"""
WITH s AS (SELECT q.vec_id AS query_id, r.vec_id AS row_id, round({_COSINE}, 9) AS score FROM embeddings q, embeddings r WHERE q.vec_id % 20 = 0 AND r.label = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM s) SELECT query_id, row_id, rank FROM k WHERE rank <= 5""")
def q05_vector_top_k_filtered(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"), "label")
    queries = rows.filter(F.col("row_id") % 20 == 0).select(F.col("row_id").alias("query_id"), "vector")
    return retrieval.vector_top_k(queries, rows, 5, F.col("label") == 1).drop("score")


_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_](?:[\p{L}\p{N}_-]*[\p{L}\p{N}_])?')"


@query(f"SELECT doc_id, len({_TOKENS}) AS n_tokens, len(list_distinct({_TOKENS})) AS n_terms FROM documents WHERE text IS NOT NULL")
def q07_tokens(spark: SparkSession, d: str) -> DataFrame:
    words = T.tokens(F.col("text"))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.size(words).alias("n_tokens"), F.size(F.array_distinct(words)).alias("n_terms"))


_TERMS = f"""
toks AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents WHERE text IS NOT NULL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM toks GROUP BY 1, 2),
lens AS (SELECT doc_id, len({_TOKENS}) AS dl FROM documents WHERE text IS NOT NULL),
tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, tot GROUP BY 1),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.term_counts(table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").alias("row_id"), "text"))


@query(f"WITH {_TERMS} SELECT term, df, round(idf, 6) AS idf FROM idf")
def q08_term_statistics(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.term_statistics(_corpus(spark, d)).withColumn("idf", F.round("idf", 6))


def _requirement_queries(spark: SparkSession, d: str) -> DataFrame:
    rows = correlate.requirements(table(spark, d, "evidence"))
    return rows.filter(F.col("seq") % 20 == 0).select(F.col("requirement_id").alias("query_id"), "text")


_BM25 = f"""
{_TERMS}, first AS (SELECT entity_id, arg_min(text, seq) AS text, min(seq) AS seq FROM evidence WHERE entity_type = 'REQUIREMENT' GROUP BY 1),
q AS (SELECT entity_id AS query_id, term, count(*) AS n FROM (SELECT entity_id, unnest({_TOKENS}) AS term FROM first WHERE seq % 20 = 0) GROUP BY 1, 2),
s AS (SELECT query_id, doc_id AS row_id, round(sum(q.n * idf.idf * (tf.tf * 2.5 / (tf.tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)))), 9) AS score
  FROM q JOIN idf USING (term) JOIN tf USING (term) JOIN lens USING (doc_id), tot GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM s WHERE score > 0)"""


@query(f"WITH {_BM25} SELECT query_id, row_id, round(score, 5) AS score, rank FROM k WHERE rank <= 10")
def q09_bm25_top_k(spark: SparkSession, d: str) -> DataFrame:
    counted = checkpoint(_corpus(spark, d))
    return retrieval.bm25_top_k(_requirement_queries(spark, d), counted, retrieval.term_statistics(counted)).withColumn("score", F.round("score", 5))


@query("""
WITH v AS (SELECT req_id, chunk_id, max(bm25_score) AS s FROM candidates WHERE bm25_score IS NOT NULL AND NOT isnan(bm25_score) GROUP BY 1, 2)
SELECT req_id, chunk_id, round(CASE WHEN max(s) OVER w = min(s) OVER w THEN 1.0 ELSE (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) END, 6) AS scaled FROM v WINDOW w AS (PARTITION BY req_id)""")
def q10_min_max(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "candidates").filter("bm25_score is not null and not isnan(bm25_score)").groupBy("req_id", "chunk_id").agg(F.max("bm25_score").alias("s"))
    return retrieval.min_max(pairs, "req_id", "s", "scaled").select("req_id", "chunk_id", F.round("scaled", 6).alias("scaled"))


@query("""
WITH ids AS (SELECT DISTINCT split_part(entity_id, '-', 1) AS query_id FROM evidence WHERE entity_type = 'REQUIREMENT' AND seq % 20 = 0), c AS (SELECT DISTINCT chunk_uid, chunk_text FROM raw_chunks)
SELECT query_id, chunk_uid AS row_id FROM ids JOIN c ON contains(lower(chunk_text), lower(query_id)) WHERE trim(query_id) <> ''""")
def q12_id_matches(spark: SparkSession, d: str) -> DataFrame:
    """The numbers of requirements (``R12``, what texts name them by) in chunk texts, as substrings; ``q16`` and ``q15`` look for whole ids."""
    ids = table(spark, d, "evidence").filter("entity_type = 'REQUIREMENT' and seq % 20 = 0").select(F.split("entity_id", "-")[0].alias("query_id"))
    docs = table(spark, d, "raw_chunks").select(F.col("chunk_uid").alias("row_id"), F.col("chunk_text").alias("text")).dropDuplicates(["row_id"])
    return retrieval.id_matches(ids, docs)


_COMBINE = """round(least(CASE WHEN i THEN greatest(b0, 0.95) ELSE b0 END, 1.0) + 1e-9, 4)"""


@query(f"""
WITH p AS (SELECT req_id AS query_id, chunk_id AS row_id, max(CASE WHEN isnan(vector_score) THEN NULL ELSE vector_score END) AS v, max(CASE WHEN bm25_score IS NULL OR isnan(bm25_score) THEN NULL ELSE bm25_score / (1 + bm25_score) END) AS b, bool_or(coalesce(id_match, false)) AS i FROM candidates GROUP BY 1, 2),
c AS (SELECT *, CASE WHEN v > 0 AND b IS NOT NULL THEN 0.7 * v + 0.3 * b WHEN v > 0 THEN v ELSE coalesce(b, 0) END AS b0 FROM p),
m AS (SELECT query_id, row_id, {_COMBINE} AS combined_score, i FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY combined_score DESC, row_id) AS rank, bool_or(i) OVER (PARTITION BY query_id) AS a FROM m)
SELECT query_id, row_id, combined_score, rank FROM r WHERE rank <= 10 + CASE WHEN a THEN 5 ELSE 0 END""")
def q13_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "candidates")
    good = lambda c: F.when(~F.isnan(c), F.col(c))
    b = good("bm25_score")
    scored = rows.select(F.col("req_id").alias("query_id"), F.col("chunk_id").alias("row_id"), good("vector_score").alias("vector_score"), (b / (1 + b)).alias("bm25_score"), F.coalesce("id_match", F.lit(False)).alias("id_match"), F.lit("stored").alias("method"))
    return retrieval.merge(scored).select("query_id", "row_id", "combined_score", "rank")


@query(f"WITH {_TERMS} SELECT true AS is_built, count(*) AS n_documents, count(*) FILTER (dl > 0) AS n_with_terms FROM lens")
def q11_index_size(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.index_size(_corpus(spark, d))


@query()
def q15_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Requirements whose number is divisible by 20 against all documents: vectors, BM25 and identifiers merged."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "text")
    return retrieval.retrieve(_requirement_queries(spark, d), docs, embedding, stored=checkpoint)


_STORED = f"""{_BM25},
qe AS (SELECT f.entity_id AS query_id, e.embedding FROM first f JOIN embeddings e ON e.vec_id = f.seq WHERE f.seq % 20 = 0), re AS (SELECT e.vec_id AS doc_id, e.embedding FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id AND d.text IS NOT NULL),
vs AS (SELECT query_id, r.doc_id AS row_id, round({_COSINE}, 9) AS score FROM qe q, re r), vk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS n FROM vs),
bk AS (SELECT query_id, row_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS b FROM k WHERE rank <= 10 WINDOW w AS (PARTITION BY query_id)),
ik AS (SELECT entity_id AS query_id, doc_id AS row_id FROM first JOIN documents d ON contains(lower(d.text), lower(entity_id)) WHERE seq % 20 = 0 AND trim(entity_id) <> ''),
al AS (SELECT query_id, row_id, score AS v, NULL::DOUBLE AS b, false AS i, 'vector' AS w FROM vk WHERE n <= 10 UNION ALL SELECT query_id, row_id, NULL, b, false, 'bm25' FROM bk UNION ALL SELECT query_id, row_id, NULL, NULL, true, 'id_match' FROM ik),
p AS (SELECT query_id, row_id, max(v) AS v, max(b) AS b, bool_or(i) AS i, list_sort(list(DISTINCT w)) AS ways FROM al GROUP BY 1, 2),
c AS (SELECT *, CASE WHEN v > 0 AND b IS NOT NULL THEN 0.7 * v + 0.3 * b WHEN v > 0 THEN v ELSE coalesce(b, 0) END AS b0 FROM p),
mm AS (SELECT *, {_COMBINE} AS combined_score FROM c),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY combined_score DESC, row_id) AS place, bool_or(i) OVER (PARTITION BY query_id) AS a FROM mm)
SELECT query_id, row_id, combined_score, array_to_string(ways, ',') AS retrieval_method, place AS rank FROM rr WHERE place <= 10 + CASE WHEN a THEN 5 ELSE 0 END"""


@query(f"WITH {_STORED}")
def q16_hybrid_stored_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Every requirement of the query set in one table, with the stored vectors of the same numbers instead of embedded texts."""
    first = correlate.requirements(table(spark, d, "evidence")).filter(F.col("seq") % 20 == 0).select(F.col("requirement_id").alias("query_id"), "text", "seq")
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    docs = table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").alias("row_id"), "text")
    vector = retrieval.vector_top_k(first.join(vectors, F.col("seq") == F.col("vec_id")).select("query_id", "vector"), docs.join(vectors, F.col("row_id") == F.col("vec_id")).select("row_id", "vector"))
    counted = checkpoint(_corpus(spark, d))
    bm25 = retrieval.bm25_top_k(first, counted, retrieval.term_statistics(counted))
    return retrieval.hybrid(vector, bm25, retrieval.id_matches(first, docs)).select("query_id", "row_id", "combined_score", "retrieval_method", "rank")


_EXPLORE = "session timeout of the export module"


@query(f"""WITH {_TERMS}, q AS (SELECT term, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS term FROM (SELECT '{_EXPLORE}' AS text)) GROUP BY 1),
s AS (SELECT doc_id AS row_id, round(sum(q.n * idf.idf * (tf.tf * 2.5 / (tf.tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)))), 9) AS score FROM q JOIN idf USING (term) JOIN tf USING (term) JOIN lens USING (doc_id), tot GROUP BY 1),
k AS (SELECT s.*, row_number() OVER (ORDER BY score DESC, row_id) AS rank FROM s JOIN documents d ON d.doc_id = row_id WHERE score > 0 AND lower(trim(d.source)) IN ('email', 'markdown'))
SELECT row_id, round(score, 5) AS score, rank FROM k WHERE rank <= 20""")
def q18_explore(spark: SparkSession, d: str) -> DataFrame:
    """A free text as a query table of one row, over the documents of two sources, by keywords."""
    counted, docs = checkpoint(_corpus(spark, d)), table(spark, d, "documents")
    kept = docs.filter(F.lower(F.trim("source")).isin("email", "markdown")).select(F.col("doc_id").alias("row_id"))
    one = spark.createDataFrame([("explore", _EXPLORE)], "query_id string, text string")
    return retrieval.bm25_top_k(one, counted, retrieval.term_statistics(counted), 20, rows=counted.join(kept, "row_id", "left_semi")).select("row_id", F.round("score", 5).alias("score"), "rank")


# ---- extraction ------------------------------------------------------------------------------------------


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Model answers put together from the evidence rows: bare, fenced, with a preamble, or broken."""
    rows = table(spark, d, "evidence").dropDuplicates(["seq"])
    json = F.to_json(F.array(F.struct("entity_type", "entity_id", "text", F.coalesce("linked_requirement", F.lit("")).alias("linked_requirement"))))
    kind = F.col("seq") % 4
    answer = F.when(kind == 0, json).when(kind == 1, F.concat(F.lit("```json\n"), json, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("Here it is: "), json)).otherwise(F.lit("No entities, sorry."))
    return rows.select("seq", answer.alias("raw_response"), "source_document", "chunk_id", F.col("text").alias("source_text"))


_FIRST_PART = r"regexp_extract({0}, '(?s)(\[.*?\]|\{{.*?\}})', 1)"
_ANSWERS = f"""a0 AS (SELECT DISTINCT ON (seq) seq, entity_type, entity_id, text, linked_requirement FROM evidence),
a1 AS (SELECT *, '[{{' || array_to_string(list_filter(['"entity_type":' || to_json(entity_type)::VARCHAR, '"entity_id":' || to_json(entity_id)::VARCHAR, '"text":' || to_json(text)::VARCHAR, '"linked_requirement":' || to_json(coalesce(linked_requirement, ''))::VARCHAR], lambda x: x IS NOT NULL), ',') || '}}]' AS j FROM a0),
a2 AS (SELECT *, CASE seq % 4 WHEN 0 THEN true WHEN 1 THEN json_valid(regexp_extract('```json' || chr(10) || j || chr(10) || '```', '(?s)```(?:json)?\\s*(\\[.*?\\]|\\{{.*?\\}})\\s*```', 1)) WHEN 2 THEN json_valid({_FIRST_PART.format("'Here it is: ' || j")}) ELSE false END AS readable FROM a1)"""


@query(f"WITH {_ANSWERS} SELECT seq, readable FROM a2")
def x05_json_recovery(spark: SparkSession, d: str) -> DataFrame:
    return _readable(_answers(spark, d))


def _readable(rows: DataFrame) -> DataFrame:
    return rows.select("seq", extraction.recover_json(F.col("raw_response")).isNotNull().alias("readable"))


@query(f"WITH {_ANSWERS} SELECT seq, entity_type, trim(entity_id) AS entity_id, sha256({_STRIP.format('text')}) AS text_hash, CASE WHEN {_STRIP.format('linked_requirement')} <> '' THEN linked_requirement END AS linked_requirement FROM a2 WHERE readable AND trim(entity_id) <> '' AND {_STRIP.format('text')} <> ''")
def x06_validate(spark: SparkSession, d: str) -> DataFrame:
    """Every valid item of every answer, with its fields brought to the rules (X07)."""
    rows = _answers(spark, d).withColumn("chunk_id", F.col("seq").cast("string"))  # the place an item comes from, given back with it
    good, _ = extraction.validate(rows)
    return good.select(F.col("chunk_id").cast("bigint").alias("seq"), "entity_type", "entity_id", F.sha2("text", 256).alias("text_hash"), "linked_requirement")


@query(f"WITH {_ANSWERS} SELECT seq, '- ' || CASE WHEN NOT readable THEN 'no JSON found' WHEN trim(entity_id) = '' OR entity_id IS NULL THEN 'empty entity_id' ELSE 'empty text' END AS errors FROM a2 WHERE NOT readable OR coalesce(trim(entity_id), '') = '' OR coalesce({_STRIP.format('text')}, '') = ''")
def x10_error_lists(spark: SparkSession, d: str) -> DataFrame:
    """What the next attempt is told about each answer that gave no item."""
    _, bad = extraction.validate(_answers(spark, d).withColumn("chunk_id", F.col("seq").cast("string")))
    told = bad.groupBy("chunk_id").agg(extraction.error_list(F.array_sort(F.collect_list("error"))).alias("errors"))  # a chunk's answer bounds them
    return told.select(F.col("chunk_id").cast("bigint").alias("seq"), "errors")


_X03_ID = r"(?:^|[^\pL\pN_])((?:R|REQ-|NFR-)[0-9]+)(?:$|[^\pL\pN_])"


@query(f"""WITH r0 AS (SELECT DISTINCT chunk_uid, chunk_text FROM raw_chunks WHERE chunk_text IS NOT NULL), r1 AS (SELECT chunk_uid, unnest(regexp_split_to_array(regexp_replace(chunk_text, '([.!?]){_ANY_SPACE}+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM r0),
r2 AS (SELECT chunk_uid, {_STRIP.format('s')} AS text, regexp_extract(s, '{_X03_ID}', 1) AS id, CASE WHEN regexp_matches(lower(s), 'rated|score|review') THEN 'EVALUATION' WHEN regexp_matches(lower(s), 'implement|built|closed|merged') THEN 'IMPLEMENTATION' ELSE 'REQUIREMENT' END AS entity_type FROM r1)
SELECT chunk_uid::VARCHAR AS chunk_id, entity_type, id AS entity_id, sha256(text) AS text_hash, CASE WHEN entity_type <> 'REQUIREMENT' THEN id END AS linked_requirement, false AS hallucination_risk FROM r2 WHERE id <> ''""")
def x03_extraction(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk text through the extractor with its retries, validated: the rows it gives."""
    rows = table(spark, d, "raw_chunks").filter("chunk_text is not null").dropDuplicates(["chunk_uid"])
    asked = rows.select(F.col("chunk_uid").cast("string").alias("chunk_id"), "source_document", F.col("chunk_text").alias("source_text"), extract_answers(F.col("chunk_text"), F.col("source_document"), F.col("source_locator"))["answer"].alias("raw_response"))
    return extraction.validate(asked)[0].select("chunk_id", "entity_type", "entity_id", F.sha2("text", 256).alias("text_hash"), "linked_requirement", "hallucination_risk")


_WORDS = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'))"


@query(f"""
WITH c AS (SELECT sha256(source_hash || '::' || chunk_index::VARCHAR) AS chunk_id, min(chunk_uid) AS u FROM raw_chunks WHERE chunk_text IS NOT NULL GROUP BY 1), t AS (SELECT DISTINCT chunk_uid AS u, chunk_text FROM raw_chunks),
p AS (SELECT DISTINCT seq, {_WORDS.format('text')} AS a, {_WORDS.format('chunk_text')} AS b FROM evidence JOIN c USING (chunk_id) JOIN t USING (u) WHERE text IS NOT NULL),
o AS (SELECT seq, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 1.0 ELSE len(list_intersect(a, b))::DOUBLE / len(a) END AS o FROM p) SELECT seq, round(o, 3) AS word_overlap_ratio, round(o, 3) < 0.3 AS hallucination_risk FROM o""")
def x08_word_overlap(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "raw_chunks").filter("chunk_text is not null").select(T.chunk_id(F.col("source_hash"), F.col("chunk_index")).alias("chunk_id"), "chunk_uid", "chunk_text")
    one = chunks.groupBy("chunk_id").agg(F.min(F.struct("chunk_uid", "chunk_text"))["chunk_text"].alias("chunk_text"))
    rows = table(spark, d, "evidence").filter("text is not null").dropDuplicates(["seq"]).join(one, "chunk_id")
    share = F.round(T.word_overlap(F.col("text"), F.col("chunk_text")), 3)
    return rows.select("seq", share.alias("word_overlap_ratio")).withColumn("hallucination_risk", F.col("word_overlap_ratio") < 0.3)


@query("SELECT entity_type, count(*) AS n FROM (SELECT DISTINCT seq, entity_type FROM evidence) GROUP BY 1")
def x11_counts_by_type(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "evidence").dropDuplicates(["seq"]).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


# ---- correlation -----------------------------------------------------------------------------------------

_LIST = lambda words: "(" + " OR ".join("contains(lower(text), '" + w.replace("'", "''") + "')" for w in words) + ")"
_SCORES = r"list_transform(regexp_extract_all(text, '(?i)\d+(?:\.\d+)?\s*/\s*10|Score:\s*\d+(?:\.\d+)?'), lambda x: regexp_extract(x, '\d+(?:\.\d+)?')::DOUBLE)"
_GOOD = f"({_LIST(T.POSITIVE)} OR len(list_filter({_SCORES}, lambda s: s >= 5)) > 0)"
_BAD = f"({_LIST(T.NEGATIVE)} OR len(list_filter({_SCORES}, lambda s: s < 5)) > 0)"


@query(f"SELECT DISTINCT seq, {_GOOD} AS good, {_BAD} AS bad FROM evidence WHERE entity_type = 'EVALUATION' AND text IS NOT NULL")
def l01_sentiment(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "evidence").filter("entity_type = 'EVALUATION' and text is not null")
    return rows.select("seq", T.is_positive(F.col("text")).alias("good"), T.is_negative(F.col("text")).alias("bad")).distinct()


@query(f"SELECT seq, list_aggregate({_SCORES}, 'sum') AS total, len({_SCORES}) AS n_scores FROM (SELECT DISTINCT seq, text FROM evidence WHERE text IS NOT NULL) WHERE len({_SCORES}) > 0")
def l03_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "evidence").filter("text is not null").dropDuplicates(["seq"]).select("seq", T.scores(F.col("text")).alias("s")).filter("size(s) > 0")
    return rows.select("seq", F.aggregate("s", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size("s").alias("n_scores"))


_RULES = f"""
ev AS (SELECT DISTINCT seq, entity_type, entity_id, text, linked_requirement FROM evidence),
req AS (SELECT DISTINCT entity_id AS requirement_id FROM ev WHERE entity_type = 'REQUIREMENT'),
lk AS (SELECT linked_requirement AS requirement_id, count(*) FILTER (entity_type = 'IMPLEMENTATION') AS ni, count(*) FILTER (entity_type = 'EVALUATION') AS ne,
  arg_min(entity_id, seq) FILTER (entity_type = 'IMPLEMENTATION') AS fi, coalesce(bool_or({_GOOD}) FILTER (entity_type = 'EVALUATION'), false) AS good, coalesce(bool_or({_BAD}) FILTER (entity_type = 'EVALUATION'), false) AS bad
  FROM ev WHERE linked_requirement IS NOT NULL AND trim(linked_requirement) <> '' GROUP BY 1),
pr AS (SELECT req_id AS requirement_id, chunk_id, max(combined_score) AS s FROM candidates WHERE combined_score IS NOT NULL AND NOT isnan(combined_score) GROUP BY 1, 2),
bs AS (SELECT requirement_id, max(s) AS best, arg_min(chunk_id, (-s, chunk_id)) AS bc, count(*) FILTER (s >= 0.75) AS ns, count(*) FILTER (s >= 0.30) AS nn FROM pr GROUP BY 1),
j AS (SELECT requirement_id, coalesce(ni, 0) AS ni, coalesce(ne, 0) AS ne, fi, good, bad, coalesce(best, 0) AS best, bc, coalesce(ns, 0) AS ns, coalesce(nn, 0) AS nn FROM req LEFT JOIN lk USING (requirement_id) LEFT JOIN bs USING (requirement_id)),
k AS (SELECT *, CASE WHEN ni > 0 THEN 'exact_requirement_id_match' WHEN best >= 0.75 THEN 'strong_semantic_match' WHEN best < 0.30 THEN 'requirement_with_no_evidence' ELSE 'ambiguous_with_retrieval_evidence' END AS rule_name,
  CASE WHEN ne > 0 AND bad THEN 'IMPLEMENTED_BUT_NEGATIVELY_EVALUATED' WHEN ne > 0 AND good THEN 'IMPLEMENTED_AND_VALIDATED' ELSE 'IMPLEMENTED_WITHOUT_EVALUATION' END AS verdict FROM j)"""


@query(f"""WITH {_RULES}
SELECT requirement_id, rule_name, CASE WHEN rule_name IN ('exact_requirement_id_match', 'strong_semantic_match') THEN verdict WHEN rule_name = 'requirement_with_no_evidence' THEN 'REQUIREMENT_NOT_IMPLEMENTED' END AS status,
 CASE rule_name WHEN 'exact_requirement_id_match' THEN fi WHEN 'strong_semantic_match' THEN bc ELSE '(none)' END AS evidence_entity_id, round(best, 6) AS best_score,
 CASE rule_name WHEN 'exact_requirement_id_match' THEN ni + ne WHEN 'strong_semantic_match' THEN ns + ne WHEN 'requirement_with_no_evidence' THEN 0 ELSE least(nn, 5) END AS n_supporting FROM k""")
def l05_decide(spark: SparkSession, d: str) -> DataFrame:
    return correlate.decide(table(spark, d, "evidence"), table(spark, d, "candidates"))


@query(f"WITH {_RULES} SELECT rule_name, count(*) AS n, round(sum(best), 4) AS total_score FROM k GROUP BY 1")
def l11_rule_counts(spark: SparkSession, d: str) -> DataFrame:
    decided = correlate.decide(table(spark, d, "evidence"), table(spark, d, "candidates"))
    return decided.groupBy("rule_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("best_score"), 4).alias("total_score"))


_ORPHANS = f"""q AS (SELECT seq, entity_id, {_WORDS.format('text')} AS a FROM ev WHERE entity_type = 'EVALUATION' AND (linked_requirement IS NULL OR trim(linked_requirement) = '')),
fr AS (SELECT entity_id AS requirement_id, arg_min(text, seq) AS text, min(seq) AS rseq FROM ev WHERE entity_type = 'REQUIREMENT' GROUP BY 1), r AS (SELECT requirement_id, rseq, {_WORDS.format('text')} AS b FROM fr),
ov AS (SELECT seq, requirement_id, rseq, round(len(list_intersect(a, b))::DOUBLE / len(a), 9) AS o FROM q, r WHERE len(a) > 0 AND len(b) > 0),
ok AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY o DESC, rseq) AS n FROM ov),
orph AS (SELECT q.seq, q.entity_id, ok.requirement_id, round(ok.o, 6) AS overlap FROM q LEFT JOIN ok ON ok.seq = q.seq AND ok.n = 1 AND ok.o >= 0.3)"""


@query(f"WITH ev AS (SELECT DISTINCT seq, entity_type, entity_id, text, linked_requirement FROM evidence), {_ORPHANS} SELECT * FROM orph")
def l09_orphan_evaluations(spark: SparkSession, d: str) -> DataFrame:
    return correlate.orphan_evaluations(table(spark, d, "evidence"))


_CLAIM = f"""{_LIST(T.CLAIMS)}
AND (contains(lower(source_document), '.txt') OR contains(lower(source_document), 'whatsapp') OR contains(lower(source_document), 'chat') OR contains(lower(source_document), 'email') OR contains(lower(source_document), '.eml'))"""


@query(f"SELECT DISTINCT seq, entity_id, linked_requirement, source_document FROM evidence WHERE entity_type = 'IMPLEMENTATION' AND {_CLAIM}")
def l10_verbal_claims(spark: SparkSession, d: str) -> DataFrame:
    return correlate.verbal_claims(table(spark, d, "evidence"))


@query(f"SELECT DISTINCT chunk_uid, {_CLAIM.replace('text', 'chunk_text')} AS is_claim FROM raw_chunks WHERE chunk_text IS NOT NULL AND source_document IS NOT NULL")
def l14_claims(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk: whether it claims work done and comes from a conversation."""
    rows = table(spark, d, "raw_chunks").filter("chunk_text is not null and source_document is not null")
    return rows.select("chunk_uid", T.is_claim(F.col("chunk_text"), F.col("source_document")).alias("is_claim")).distinct()


_CONFIDENCE = """round(least((0.35 * least(greatest(best, 0), 1) + 0.30 * CASE resolution_method WHEN 'deterministic_rule' THEN 1.0 WHEN 'llm_stage2' THEN 0.7 ELSE 0.5 END
 + 0.20 * CASE WHEN n = 0 THEN 0.0 WHEN n = 1 THEN 0.5 ELSE least(1.0, ln(n + 1) / ln(6)) END + 0.15 * least(1.0, d / 3.0)::DOUBLE)
 * CASE status WHEN 'IMPLEMENTED_AND_VALIDATED' THEN 1.0 WHEN 'IMPLEMENTED_WITHOUT_EVALUATION' THEN 0.9 WHEN 'PARTIALLY_IMPLEMENTED' THEN 0.85 WHEN 'IMPLEMENTED_BUT_NEGATIVELY_EVALUATED' THEN 0.85
   WHEN 'REQUIREMENT_NOT_IMPLEMENTED' THEN 0.8 WHEN 'CLAIMED_BUT_NO_EVIDENCE' THEN 0.7 WHEN 'EVALUATION_WITHOUT_REQUIREMENT' THEN 0.75 ELSE 0.8 END, 1.0)::DOUBLE + 1e-9, 4)"""
_OWNER = "own AS (SELECT chunk_id, arg_max(source_document, seq) AS source_document FROM evidence WHERE chunk_id IS NOT NULL GROUP BY 1)"


@query(f"""
WITH {_OWNER}, c AS (SELECT DISTINCT ON (correlation_id) * FROM correlation),
e AS (SELECT DISTINCT correlation_id, unnest(supporting_chunk_ids) AS chunk_id FROM c), sup AS (SELECT correlation_id, count(*) AS n_rows, count(DISTINCT source_document) AS n_sources FROM e JOIN own USING (chunk_id) GROUP BY 1),
cp AS (SELECT DISTINCT req_id, chunk_id FROM candidates WHERE req_id IS NOT NULL), cw AS (SELECT req_id, count(*) AS nc, count(DISTINCT source_document) AS cs FROM cp LEFT JOIN own USING (chunk_id) GROUP BY 1),
b AS (SELECT req_id, max(combined_score) AS best FROM candidates WHERE combined_score IS NOT NULL AND NOT isnan(combined_score) GROUP BY 1),
j AS (SELECT correlation_id, status, resolution_method, coalesce(best, 0) AS best, coalesce(nc, n_rows, len(supporting_chunk_ids), 0) AS n, coalesce(cs, n_sources, 0) AS d
  FROM c LEFT JOIN sup USING (correlation_id) LEFT JOIN b ON b.req_id = requirement_entity_id LEFT JOIN cw ON cw.req_id = requirement_entity_id)
SELECT correlation_id, {_CONFIDENCE} AS confidence FROM j""")
def l19_confidence(spark: SparkSession, d: str) -> DataFrame:
    return correlate.rescore(table(spark, d, "correlation"), table(spark, d, "evidence"), table(spark, d, "candidates"))


# ---- matrix ----------------------------------------------------------------------------------------------

_BEST = """best AS (SELECT requirement_entity_id, arg_min(correlation_id, (-confidence, seq)) AS correlation_id FROM correlation WHERE requirement_entity_id IS NOT NULL GROUP BY 1),
c1 AS (SELECT DISTINCT ON (correlation_id) * FROM correlation), b AS (SELECT c1.* FROM best JOIN c1 USING (correlation_id))"""
# every stored correlation of a requirement's latest second, and the best of them
_LATEST = """lt AS (SELECT c.* FROM correlation c JOIN (SELECT requirement_entity_id, max(date_trunc('second', created_at)) AS last FROM correlation GROUP BY 1) x
  ON x.requirement_entity_id = c.requirement_entity_id AND date_trunc('second', c.created_at) = x.last)"""
_CHUNKS = """ck AS (SELECT sha256(source_hash || '::' || chunk_index::VARCHAR) AS chunk_id, arg_min(source_document, chunk_uid) AS source_document, arg_min(chunk_text, chunk_uid) AS chunk_text FROM raw_chunks WHERE chunk_text IS NOT NULL GROUP BY 1)"""
_TOP = """cs AS (SELECT req_id, chunk_id, max(combined_score) AS s FROM candidates WHERE combined_score IS NOT NULL AND NOT isnan(combined_score) GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY s DESC, chunk_id) AS n FROM cs)"""
_MATRIX = f"""{_BEST}, {_OWNER}, {_CHUNKS}, {_TOP},
dr AS (SELECT requirement_entity_id AS id, source_document FROM (SELECT requirement_entity_id, unnest(supporting_chunk_ids) AS chunk_id FROM b) JOIN own USING (chunk_id)
  UNION SELECT req_id, coalesce(ck.source_document, own.source_document) FROM top LEFT JOIN ck USING (chunk_id) LEFT JOIN own USING (chunk_id) WHERE n <= 3),
docs AS (SELECT id, list_sort(list(source_document)) AS source_documents FROM dr WHERE source_document IS NOT NULL GROUP BY 1),
nc AS (SELECT req_id, count(DISTINCT chunk_id) AS n FROM candidates GROUP BY 1),
m AS (SELECT r.entity_id AS requirement_id, r.seq, coalesce(b.status, 'REQUIREMENT_NOT_IMPLEMENTED') AS status, coalesce(b.confidence, 0.0) AS confidence, greatest(coalesce(len(b.supporting_chunk_ids), 0), coalesce(nc.n, 0)) AS evidence_count,
  coalesce(source_documents, []) AS source_documents, coalesce(b.resolution_method, 'none') AS resolution_method
  FROM (SELECT DISTINCT seq, entity_id FROM evidence WHERE entity_type = 'REQUIREMENT') r LEFT JOIN b ON b.requirement_entity_id = r.entity_id LEFT JOIN docs ON docs.id = r.entity_id LEFT JOIN nc ON nc.req_id = r.entity_id)"""


def _chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "raw_chunks").filter("chunk_text is not null")
    return rows.select(T.chunk_id(F.col("source_hash"), F.col("chunk_index")).alias("chunk_id"), "source_document")


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    return matrix.build(table(spark, d, "evidence"), table(spark, d, "correlation"), table(spark, d, "candidates"), _chunk_documents(spark, d))


@query(f"WITH {_BEST} SELECT requirement_entity_id, correlation_id, status, confidence FROM b")
def m03_best_correlation(spark: SparkSession, d: str) -> DataFrame:
    return matrix.best_correlations(table(spark, d, "correlation")).select("requirement_entity_id", "correlation_id", "status", "confidence")


def _matrix_rows(rows: DataFrame) -> DataFrame:
    return rows.select("requirement_id", "seq", "status", "confidence", "evidence_count", F.array_join("source_documents", "; ").alias("source_documents"), "resolution_method")


_MATRIX_ROWS = "requirement_id, seq, status, confidence, evidence_count, array_to_string(source_documents, '; ') AS source_documents, resolution_method"


@query(f"WITH {_MATRIX} SELECT {_MATRIX_ROWS} FROM m")
def m04_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Documents are those of the supporting chunks and of the three best candidates (M05)."""
    return _matrix_rows(_matrix(spark, d))


@query(f"WITH {_MATRIX} SELECT requirement_id, seq, unnest(source_documents) AS source_document FROM m")
def m05_matrix_documents(spark: SparkSession, d: str) -> DataFrame:
    return _matrix(spark, d).select("requirement_id", "seq", F.explode("source_documents").alias("source_document"))


@query(f"WITH {_MATRIX} SELECT source_document, count(*) AS n_requirements FROM (SELECT unnest(source_documents) AS source_document FROM m) GROUP BY 1")
def m07_coverage(spark: SparkSession, d: str) -> DataFrame:
    return matrix.coverage_by_source(_matrix(spark, d))


@query(f"WITH {_MATRIX} SELECT status, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS percent FROM m GROUP BY 1")
def m08_status_distribution(spark: SparkSession, d: str) -> DataFrame:
    return matrix.status_distribution(_matrix(spark, d))


@query(f"""WITH {_MATRIX} SELECT count(*) AS total_requirements, count(*) FILTER (status IN ('IMPLEMENTED_AND_VALIDATED', 'IMPLEMENTED_WITHOUT_EVALUATION', 'IMPLEMENTED_BUT_NEGATIVELY_EVALUATED')) AS implemented,
 round(avg(confidence), 3) AS average_confidence, count(*) FILTER (resolution_method = 'deterministic_rule') AS deterministic, count(*) FILTER (resolution_method = 'llm_stage2') AS classified,
 round(count(*) FILTER (status IN ('IMPLEMENTED_AND_VALIDATED', 'IMPLEMENTED_WITHOUT_EVALUATION', 'IMPLEMENTED_BUT_NEGATIVELY_EVALUATED')) * 100.0::DOUBLE / count(*), 1) AS coverage_percent FROM m""")
def m10_summary(spark: SparkSession, d: str) -> DataFrame:
    return matrix.summary(_matrix(spark, d))


_COLOURS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in STATUS_COLOURS.items()) + "}"


@query(f"WITH {_MATRIX} SELECT requirement_id, seq, {_COLOURS}[status] AS colour FROM m ORDER BY requirement_id, seq")
def m11_colours(spark: SparkSession, d: str) -> DataFrame:
    """Sorted by requirement, as the matrix is shown (M09)."""
    return _matrix(spark, d).select("requirement_id", "seq", "colour").orderBy("requirement_id", "seq")


@query(f"WITH {_MATRIX} SELECT requirement_id, seq, status, confidence FROM m WHERE status IN ('PARTIALLY_IMPLEMENTED', 'CLAIMED_BUT_NO_EVIDENCE') AND confidence >= 0.5")
def m12_filtered(spark: SparkSession, d: str) -> DataFrame:
    return matrix.filtered(_matrix(spark, d), ["PARTIALLY_IMPLEMENTED", "CLAIMED_BUT_NO_EVIDENCE"], 0.5).select("requirement_id", "seq", "status", "confidence")


@query(f"WITH {_LATEST} SELECT DISTINCT seq, correlation_id, requirement_entity_id, status FROM lt")
def m13_latest(spark: SparkSession, d: str) -> DataFrame:
    return matrix.latest(table(spark, d, "correlation")).select("seq", "correlation_id", "requirement_entity_id", "status").distinct()


@query(f"""WITH {_LATEST}, lb AS (SELECT requirement_entity_id, arg_min(correlation_id, (-confidence, seq)) AS correlation_id FROM lt GROUP BY 1), l1 AS (SELECT DISTINCT ON (correlation_id) lt.* FROM lt JOIN lb USING (correlation_id)), {_OWNER},
ld AS (SELECT requirement_entity_id AS id, list_sort(list(DISTINCT source_document)) AS docs FROM (SELECT requirement_entity_id, unnest(supporting_chunk_ids) AS chunk_id FROM l1) JOIN own USING (chunk_id) WHERE source_document IS NOT NULL GROUP BY 1)
SELECT r.entity_id AS requirement_id, r.seq, coalesce(status, 'REQUIREMENT_NOT_IMPLEMENTED') AS status, coalesce(confidence, 0.0) AS confidence, coalesce(len(supporting_chunk_ids), 0) AS evidence_count, coalesce(array_to_string(docs, '; '), '') AS source_documents,
 coalesce(resolution_method, 'none') AS resolution_method FROM (SELECT DISTINCT seq, entity_id FROM evidence WHERE entity_type = 'REQUIREMENT') r LEFT JOIN l1 ON l1.requirement_entity_id = r.entity_id LEFT JOIN ld ON ld.id = r.entity_id""")
def m02_load_latest(spark: SparkSession, d: str) -> DataFrame:
    """The matrix from each requirement's latest stored correlations alone."""
    return _matrix_rows(matrix.load_latest(table(spark, d, "evidence"), table(spark, d, "correlation")))


@query("SELECT requirement_entity_id, arg_max(correlation_id, (created_at, seq)) AS correlation_id, max(created_at) AS created_at FROM correlation WHERE requirement_entity_id IS NOT NULL GROUP BY 1")
def m14_latest_one(spark: SparkSession, d: str) -> DataFrame:
    last = F.max(F.struct("created_at", "seq", "correlation_id"))
    rows = table(spark, d, "correlation").filter("requirement_entity_id is not null").groupBy("requirement_entity_id").agg(last.alias("_l"))
    return rows.select("requirement_entity_id", "_l.correlation_id", "_l.created_at")


@query(f"WITH {_MATRIX} SELECT {_MATRIX_ROWS} FROM m")
def k06_export(spark: SparkSession, d: str) -> DataFrame:
    """The matrix written as CSV and read again."""
    path = scratch(spark, "k06")
    matrix.export(_matrix(spark, d).drop("requirement_text", "reasoning", "colour"), path, "csv")
    schema = "requirement_id string, seq bigint, status string, confidence double, evidence_count bigint, source_documents string, resolution_method string"
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).schema(schema).csv(path).na.fill("", ["source_documents"])


# ---- the whole run ----------------------------------------------------------------------------------------

_ITEM_TEXT = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"
_RUN = f"""{_RULES}, {_ORPHANS}, {_OWNER}, {_CHUNKS}, {_TOP},
er AS (SELECT DISTINCT ON (seq) seq, entity_type, entity_id, text, linked_requirement, source_document, chunk_id FROM evidence),
ft AS (SELECT entity_id AS requirement_id, arg_min(text, seq) AS rtext FROM er WHERE entity_type = 'REQUIREMENT' GROUP BY 1),
pairs AS (
 SELECT 'ambiguous:' || requirement_id AS correlation_id, 1 AS step, NULL::BIGINT AS eseq, requirement_id, rtext, 5 AS most, 0.30 AS least FROM k JOIN ft USING (requirement_id) WHERE rule_name = 'ambiguous_with_retrieval_evidence'
 UNION ALL SELECT 'orphan:' || seq, 2, seq, requirement_id, rtext, 0, 0 FROM orph JOIN ft USING (requirement_id)
 UNION ALL SELECT 'claim:' || seq, 3, seq, linked_requirement, rtext, 3, -1 FROM er JOIN ft ON ft.requirement_id = linked_requirement WHERE entity_type = 'IMPLEMENTATION' AND {_CLAIM}),
op AS (SELECT * FROM pairs WHERE rtext <> ''),
items AS (SELECT correlation_id, n AS position, chunk_id, chunk_text AS text FROM op JOIN top ON top.req_id = requirement_id AND n <= most AND s >= least LEFT JOIN ck USING (chunk_id)
 UNION ALL SELECT correlation_id, 6, chunk_id, text FROM op JOIN er ON er.seq = eseq),
tw AS (SELECT correlation_id, list_distinct(flatten(list({_ITEM_TEXT.format('text')}))) AS w FROM items WHERE text IS NOT NULL GROUP BY 1),
sh AS (SELECT op.*, w IS NULL AS none, list_distinct({_ITEM_TEXT.format('rtext')}) AS rw, w FROM op LEFT JOIN tw USING (correlation_id)),
lab AS (SELECT *, CASE WHEN none THEN 'REQUIREMENT_NOT_IMPLEMENTED' WHEN len(rw) > 0 AND len(list_intersect(rw, w))::DOUBLE / len(rw) >= 0.7 THEN 'IMPLEMENTED_WITHOUT_EVALUATION' WHEN len(rw) > 0 AND len(list_intersect(rw, w))::DOUBLE / len(rw) >= 0.4 THEN 'PARTIALLY_IMPLEMENTED' ELSE 'CLAIMED_BUT_NO_EVIDENCE' END AS status FROM sh),
co AS (
 SELECT 'rule:' || requirement_id AS correlation_id, 0::BIGINT AS seq, requirement_id, CASE rule_name WHEN 'exact_requirement_id_match' THEN fi WHEN 'strong_semantic_match' THEN bc ELSE '(none)' END AS evidence_entity_id,
  CASE WHEN rule_name = 'requirement_with_no_evidence' THEN 'REQUIREMENT_NOT_IMPLEMENTED' ELSE verdict END AS status, 'deterministic_rule' AS resolution_method, rule_name,
  CASE rule_name WHEN 'exact_requirement_id_match' THEN CASE WHEN ne > 0 THEN 0.95 ELSE 0.85 END WHEN 'strong_semantic_match' THEN round(least(best, 1.0) + 1e-9, 4) ELSE 0.80 END::DOUBLE AS rule_confidence FROM k WHERE rule_name <> 'ambiguous_with_retrieval_evidence'
 UNION ALL SELECT 'orphan:' || seq, 2 * (1::BIGINT << 48) + seq, '(unlinked)', entity_id, 'EVALUATION_WITHOUT_REQUIREMENT', 'deterministic_rule', 'orphan_evaluation', 0.80 FROM orph WHERE requirement_id IS NULL
 UNION ALL SELECT l.correlation_id, step * (1::BIGINT << 48) + coalesce(eseq, 0), requirement_id, CASE WHEN none THEN '(none)' ELSE coalesce((SELECT min(i.chunk_id) FROM items i WHERE i.correlation_id = l.correlation_id AND position = 1), er.entity_id) END, status, 'llm_stage2', NULL, 0.0 FROM lab l LEFT JOIN er ON er.seq = eseq),
su AS (
 SELECT 'rule:' || requirement_id AS correlation_id, er.chunk_id FROM k JOIN er ON er.linked_requirement = requirement_id WHERE (rule_name = 'exact_requirement_id_match' AND entity_type IN ('IMPLEMENTATION', 'EVALUATION')) OR (rule_name = 'strong_semantic_match' AND entity_type = 'EVALUATION')
 UNION ALL SELECT 'rule:' || requirement_id, chunk_id FROM k JOIN cs ON req_id = requirement_id AND s >= 0.75 WHERE rule_name = 'strong_semantic_match'
 UNION ALL SELECT 'orphan:' || seq, chunk_id FROM orph JOIN er USING (seq) WHERE requirement_id IS NULL
 UNION ALL SELECT correlation_id, chunk_id FROM items JOIN lab USING (correlation_id) WHERE NOT none),
sup AS (SELECT * FROM su WHERE chunk_id IS NOT NULL), ns AS (SELECT correlation_id, count(*) AS n_supporting FROM sup GROUP BY 1),
sr AS (SELECT correlation_id, count(*) AS n_rows, count(DISTINCT source_document) AS n_sources FROM (SELECT DISTINCT correlation_id, chunk_id FROM sup) JOIN own USING (chunk_id) GROUP BY 1),
cw AS (SELECT req_id, count(*) AS nc, count(DISTINCT source_document) AS csrc FROM (SELECT DISTINCT req_id, chunk_id FROM candidates WHERE req_id IS NOT NULL) LEFT JOIN own USING (chunk_id) GROUP BY 1),
sj AS (SELECT co.*, coalesce(n_supporting, 0) AS n_supporting, coalesce(nc, n_rows, n_supporting, 0) AS n, coalesce(csrc, n_sources, 0) AS d, coalesce((SELECT max(s) FROM cs WHERE cs.req_id = co.requirement_id), 0) AS best
 FROM co LEFT JOIN ns USING (correlation_id) LEFT JOIN sr USING (correlation_id) LEFT JOIN cw ON cw.req_id = co.requirement_id),
sc AS (SELECT *, {_CONFIDENCE} AS confidence FROM sj)"""


def _run(spark: SparkSession, d: str, with_matrix: bool = False) -> trace.Run:
    return trace.run(table(spark, d, "evidence"), table(spark, d, "candidates"), trace.chunk_texts(table(spark, d, "raw_chunks")), with_matrix=with_matrix)


@query(f"""WITH {_RUN}, rb AS (SELECT requirement_id, arg_min(correlation_id, (-confidence, seq)) AS correlation_id FROM sc GROUP BY 1), rc AS (SELECT sc.* FROM sc JOIN rb USING (correlation_id)),
rd AS (SELECT requirement_id AS id, source_document FROM rc JOIN sup USING (correlation_id) JOIN own USING (chunk_id) UNION SELECT req_id, coalesce(ck.source_document, own.source_document) FROM top LEFT JOIN ck USING (chunk_id) LEFT JOIN own USING (chunk_id) WHERE n <= 3),
rl AS (SELECT id, list_sort(list(source_document)) AS docs FROM rd WHERE source_document IS NOT NULL GROUP BY 1), rn AS (SELECT req_id, count(DISTINCT chunk_id) AS cn FROM candidates GROUP BY 1)
SELECT r.entity_id AS requirement_id, r.seq, coalesce(rc.status, 'REQUIREMENT_NOT_IMPLEMENTED') AS status, coalesce(rc.confidence, 0.0) AS confidence, greatest(coalesce(rc.n_supporting, 0), coalesce(cn, 0)) AS evidence_count,
 coalesce(array_to_string(docs, '; '), '') AS source_documents, coalesce(rc.resolution_method, 'none') AS resolution_method
 FROM (SELECT seq, entity_id FROM er WHERE entity_type = 'REQUIREMENT') r LEFT JOIN rc ON rc.requirement_id = r.entity_id LEFT JOIN rl ON rl.id = r.entity_id LEFT JOIN rn ON rn.req_id = r.entity_id""")
def m01_run(spark: SparkSession, d: str) -> DataFrame:
    """Rules, classifier, confidence and matrix in one run over all requirements."""
    return _matrix_rows(_run(spark, d, True).matrix)


@query(f"WITH {_RUN} SELECT correlation_id, requirement_id AS requirement_entity_id, evidence_entity_id, status, resolution_method, rule_name, rule_confidence, confidence, n_supporting FROM sc")
def m01_correlations(spark: SparkSession, d: str) -> DataFrame:
    """All correlations of a run: rules, orphan evaluations, and what the classifier settled."""
    return _run(spark, d).correlations.drop("seq", "reasoning")


@query(f"WITH {_RUN} SELECT correlation_id, chunk_id, count(*) AS n FROM sup GROUP BY ALL")
def l05_support(spark: SparkSession, d: str) -> DataFrame:
    """The chunks behind each correlation of a run, as rows (repeats counted)."""
    return _run(spark, d).support.groupBy("correlation_id", "chunk_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_RUN} SELECT correlation_id, requirement_id AS requirement_entity_id, status FROM lab")
def l15_classified(spark: SparkSession, d: str) -> DataFrame:
    """What the classifier makes of open requirements, loosely matching evaluations and verbal claims."""
    return _run(spark, d).correlations.filter("resolution_method = 'llm_stage2'").select("correlation_id", "requirement_entity_id", "status")


@query(f"WITH {_RUN} SELECT correlation_id, position, chunk_id, length(text) AS n_chars FROM items")
def l16_classifier_items(spark: SparkSession, d: str) -> DataFrame:
    """The texts that the classifier reads of each pair, in their order."""
    evidence, candidates = table(spark, d, "evidence"), table(spark, d, "candidates")
    items = trace.open_pairs(evidence, candidates, trace.chunk_texts(table(spark, d, "raw_chunks")), correlate.decided(evidence, candidates), correlate.orphan_evaluations(evidence))[1]
    return items.select("correlation_id", "position", "chunk_id", F.length("text").alias("n_chars"))


# ---- graph -----------------------------------------------------------------------------------------------

_EDGES = f"""{_LATEST},
ev AS (SELECT DISTINCT seq, entity_type, entity_id, linked_requirement, source_document, chunk_id FROM evidence),
ownr AS (SELECT chunk_id, arg_max(entity_id, (CASE entity_type WHEN 'EVALUATION' THEN 3 WHEN 'IMPLEMENTATION' THEN 2 ELSE 1 END, seq)) AS owner FROM ev WHERE chunk_id IS NOT NULL GROUP BY 1),
rq AS (SELECT DISTINCT entity_id AS id FROM ev WHERE entity_type = 'REQUIREMENT'),
cc AS (SELECT DISTINCT ON (correlation_id) correlation_id, requirement_entity_id AS src, evidence_entity_id FROM lt WHERE evidence_entity_id NOT IN ('', '(none)', '(unlinked)', '(unknown)') AND requirement_entity_id NOT IN ('', '(none)', '(unlinked)', '(unknown)')),
cr AS (SELECT correlation_id, src, CASE WHEN regexp_matches(evidence_entity_id, '^[0-9a-f]{{64}}$') THEN owner ELSE evidence_entity_id END AS dst FROM cc LEFT JOIN ownr ON ownr.chunk_id = cc.evidence_entity_id),
edges AS (
 SELECT DISTINCT 'EXTRACTED_FROM' AS rel_type, entity_id AS src, source_document AS dst, NULL::VARCHAR AS correlation_id FROM ev WHERE entity_id IS NOT NULL AND source_document IS NOT NULL
 UNION ALL SELECT DISTINCT 'EXPLICITLY_LINKS', entity_id, linked_requirement, NULL FROM ev WHERE entity_type = 'IMPLEMENTATION' AND linked_requirement IN (SELECT id FROM rq)
 UNION ALL SELECT DISTINCT 'EVALUATES', entity_id, linked_requirement, NULL FROM ev WHERE entity_type = 'EVALUATION' AND linked_requirement IN (SELECT id FROM rq)
 UNION ALL SELECT 'CORRELATES_TO', src, dst, correlation_id FROM cr WHERE dst IN (SELECT entity_id FROM ev WHERE entity_id IS NOT NULL) AND src IN (SELECT id FROM rq)),
nodes AS (
 SELECT CASE entity_type WHEN 'REQUIREMENT' THEN 'Requirement' WHEN 'IMPLEMENTATION' THEN 'Implementation' ELSE 'Evaluation' END AS label, entity_id AS key, arg_max(source_document, seq) AS source_document FROM ev WHERE entity_id IS NOT NULL GROUP BY 1, 2
 UNION ALL SELECT DISTINCT 'SourceDocument', source_document, NULL FROM ev WHERE source_document IS NOT NULL)"""


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    evidence, correlation = table(spark, d, "evidence"), table(spark, d, "correlation")
    return graph.nodes(evidence), graph.edges(evidence, correlation)


@query(r"""SELECT DISTINCT source_document, CASE WHEN regexp_matches(lower(source_document), 'whatsapp|chat') THEN 'WHATSAPP' WHEN regexp_matches(lower(source_document), 'git|commit') THEN 'GIT'
 ELSE coalesce(MAP {'pdf': 'PDF', 'docx': 'DOCX', 'doc': 'DOCX', 'py': 'PYTHON', 'md': 'MARKDOWN', 'txt': 'TEXT', 'eml': 'EMAIL', 'msg': 'EMAIL'}[regexp_extract(lower(source_document), '\.([^.]*)$', 1)], 'UNKNOWN') END AS source_type FROM evidence WHERE source_document IS NOT NULL""")
def g02_source_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "evidence").filter("source_document is not null").select("source_document", graph.source_type_of(F.col("source_document")).alias("source_type")).distinct()


@query("SELECT regexp_matches(evidence_entity_id, '^[0-9a-f]{64}$') AS is_chunk, count(*) AS n FROM (SELECT DISTINCT seq, evidence_entity_id FROM correlation WHERE evidence_entity_id IS NOT NULL) GROUP BY 1")
def g01_chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "correlation").filter("evidence_entity_id is not null").select("seq", "evidence_entity_id").distinct()
    return rows.groupBy(graph.is_chunk_id(F.col("evidence_entity_id")).alias("is_chunk")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT entity_id AS src, source_document AS dst FROM evidence WHERE entity_id IS NOT NULL AND source_document IS NOT NULL")
def g05_extracted_from(spark: SparkSession, d: str) -> DataFrame:
    return graph.extracted_from(table(spark, d, "evidence")).select("src", "dst")


@query("SELECT DISTINCT entity_id AS src, linked_requirement AS dst FROM evidence WHERE entity_type = 'IMPLEMENTATION' AND linked_requirement IN (SELECT entity_id FROM evidence WHERE entity_type = 'REQUIREMENT')")
def g07_explicit_links(spark: SparkSession, d: str) -> DataFrame:
    return graph.links(table(spark, d, "evidence"), "IMPLEMENTATION", "EXPLICITLY_LINKS").select("src", "dst")


@query("SELECT DISTINCT entity_id AS src, linked_requirement AS dst FROM evidence WHERE entity_type = 'EVALUATION' AND linked_requirement IN (SELECT entity_id FROM evidence WHERE entity_type = 'REQUIREMENT')")
def g08_evaluates(spark: SparkSession, d: str) -> DataFrame:
    return graph.links(table(spark, d, "evidence"), "EVALUATION", "EVALUATES").select("src", "dst")


@query(f"WITH {_EDGES} SELECT label, key, source_document FROM nodes")
def g03_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d)[0].select("label", "key", "source_document")


_SOURCE_TYPE = r"""CASE WHEN regexp_matches(lower({0}), 'whatsapp|chat') THEN 'WHATSAPP' WHEN regexp_matches(lower({0}), 'git|commit') THEN 'GIT'
 ELSE coalesce(MAP {{'pdf': 'PDF', 'docx': 'DOCX', 'doc': 'DOCX', 'py': 'PYTHON', 'md': 'MARKDOWN', 'txt': 'TEXT', 'eml': 'EMAIL', 'msg': 'EMAIL'}}[regexp_extract(lower({0}), '\.([^.]*)$', 1)], 'UNKNOWN') END"""


@query(f"WITH {_EDGES} SELECT key, {_SOURCE_TYPE.format('key')} AS source_type FROM nodes WHERE label = 'SourceDocument'")
def g04_document_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d)[0].filter("label = 'SourceDocument'").select("key", "source_type")


@query(f"WITH {_EDGES} SELECT rel_type, src, dst, correlation_id FROM edges")
def g06_edges(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d)[1]


@query(f"""WITH {_EDGES}, e1 AS (SELECT src AS r, count(DISTINCT dst) AS n FROM edges WHERE rel_type = 'CORRELATES_TO' GROUP BY 1), e2 AS (SELECT dst AS r, count(DISTINCT src) AS n FROM edges WHERE rel_type = 'EVALUATES' GROUP BY 1),
t AS (SELECT src AS r, arg_min(status, (-confidence, x.correlation_id)) AS status, max(confidence) AS confidence FROM edges x JOIN (SELECT DISTINCT ON (correlation_id) correlation_id, status, confidence FROM correlation) USING (correlation_id) WHERE rel_type = 'CORRELATES_TO' GROUP BY 1)
SELECT key AS requirement_id, coalesce(e1.n, 0) AS n_evidence, coalesce(e2.n, 0) AS n_evaluations, status, confidence FROM nodes LEFT JOIN e1 ON e1.r = key LEFT JOIN e2 ON e2.r = key LEFT JOIN t ON t.r = key WHERE label = 'Requirement'""")
def g11_overview(spark: SparkSession, d: str) -> DataFrame:
    node, edge = _graph(spark, d)
    return graph.overview(node, edge, table(spark, d, "correlation"))


_HOT = "(SELECT requirement_entity_id FROM correlation WHERE requirement_entity_id <> '(unlinked)' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


def _hottest(spark: SparkSession, d: str) -> str:
    rows = table(spark, d, "correlation").filter("requirement_entity_id <> '(unlinked)'").groupBy("requirement_entity_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.orderBy(F.desc("n"), "requirement_entity_id").first()[0]


@query(f"""WITH {_EDGES}, h AS (SELECT DISTINCT 1 AS hop, rel_type, src, dst FROM edges WHERE src = {_HOT} OR dst = {_HOT}), nb AS (SELECT DISTINCT CASE WHEN src = {_HOT} THEN dst ELSE src END AS id FROM h)
SELECT * FROM h UNION ALL SELECT DISTINCT 2, rel_type, src, dst FROM edges WHERE rel_type = 'EXTRACTED_FROM' AND src <> {_HOT} AND src IN (SELECT id FROM nb)""")
def g12_ego_network(spark: SparkSession, d: str) -> DataFrame:
    return graph.ego_network(_graph(spark, d)[1], _hottest(spark, d))


@query(f"""WITH {_EDGES}, mb AS (SELECT DISTINCT dst AS artifact, src AS requirement_id FROM edges WHERE rel_type = 'CORRELATES_TO')
SELECT artifact, requirement_id, n_requirements FROM (SELECT *, count(*) OVER (PARTITION BY artifact) AS n_requirements FROM mb) WHERE n_requirements > 1""")
def g13_shared_artifacts(spark: SparkSession, d: str) -> DataFrame:
    return graph.shared_artifacts(_graph(spark, d)[1])


@query(f"WITH {_EDGES} SELECT label, key FROM nodes WHERE label <> 'SourceDocument' AND key NOT IN (SELECT src FROM edges WHERE rel_type <> 'EXTRACTED_FROM') AND key NOT IN (SELECT dst FROM edges WHERE rel_type <> 'EXTRACTED_FROM')")
def g14_orphans(spark: SparkSession, d: str) -> DataFrame:
    node, edge = _graph(spark, d)
    return graph.orphans(node, edge, ("EXTRACTED_FROM",))


@query(f"""WITH {_EDGES}, o AS (SELECT src AS entity, dst AS source_document FROM edges WHERE rel_type = 'EXTRACTED_FROM'), t AS (SELECT DISTINCT src AS entity, dst AS requirement_id FROM edges WHERE rel_type IN ('EXPLICITLY_LINKS', 'EVALUATES'))
SELECT source_document, count(DISTINCT entity) AS n_entities, count(DISTINCT requirement_id) AS n_requirements FROM o LEFT JOIN t USING (entity) GROUP BY 1""")
def g15_document_coverage(spark: SparkSession, d: str) -> DataFrame:
    return graph.document_coverage(_graph(spark, d)[1])


_MEMBERS = "o AS (SELECT src AS entity, dst AS source_document FROM edges WHERE rel_type = 'EXTRACTED_FROM'), t AS (SELECT DISTINCT src AS entity, dst AS requirement_id FROM edges WHERE rel_type IN ('EXPLICITLY_LINKS', 'EVALUATES'))"


@query(f"WITH {_EDGES}, {_MEMBERS} SELECT source_document, entity, requirement_id FROM o LEFT JOIN t USING (entity)")
def g15_document_members(spark: SparkSession, d: str) -> DataFrame:
    """Each entity of a document with each requirement it links to."""
    return graph.document_members(_graph(spark, d)[1])


@query(f"WITH {_EDGES} SELECT rel_type, src, dst, correlation_id FROM edges WHERE rel_type <> 'EXTRACTED_FROM'")
def g16_graph_without_documents(spark: SparkSession, d: str) -> DataFrame:
    return graph.full_graph(*_graph(spark, d), documents=False)[1]


@query(f"WITH {_EDGES} SELECT 'node' AS kind, label AS name, count(*) AS n FROM nodes GROUP BY 1, 2 UNION ALL SELECT 'edge', rel_type, count(*) FROM edges GROUP BY 1, 2")
def g17_statistics(spark: SparkSession, d: str) -> DataFrame:
    return graph.statistics(*_graph(spark, d))


@query(f"""WITH {_EDGES}, gone AS (SELECT DISTINCT ON (correlation_id) correlation_id, coalesce(evidence_entity_id IN ('', '(none)', '(unlinked)', '(unknown)') OR requirement_entity_id IN ('', '(none)', '(unlinked)', '(unknown)'), true) AS g FROM lt)
SELECT 'node' AS kind, label AS name, count(*) AS n FROM nodes GROUP BY 1, 2 UNION ALL SELECT 'edge', rel_type, count(*) FROM edges GROUP BY 1, 2
UNION ALL SELECT 'skipped', 'placeholder', count(*) FROM gone WHERE g UNION ALL SELECT 'skipped', 'chunk without entity', count(*) FROM cr WHERE dst IS NULL""")
def g09_build_statistics(spark: SparkSession, d: str) -> DataFrame:
    return graph.build_statistics(table(spark, d, "evidence"), table(spark, d, "correlation"), *_graph(spark, d))


@query(f"WITH {_EDGES} SELECT 'node' AS kind, label AS name, count(*) AS n FROM nodes GROUP BY 1, 2 UNION ALL SELECT 'edge', rel_type, count(*) FROM edges GROUP BY 1, 2")
def g10_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """The stored graph after two whole rebuilds."""
    path, tables = scratch(spark, "g10"), (table(spark, d, "evidence"), table(spark, d, "correlation"))
    graph.sync(*tables, path)
    return graph.statistics(*graph.sync(*tables, path))


@query(f"""WITH {_EDGES}, h AS (SELECT DISTINCT 1 AS hop, rel_type, src, dst FROM edges WHERE src = {_HOT} OR dst = {_HOT}), nb AS (SELECT DISTINCT CASE WHEN src = {_HOT} THEN dst ELSE src END AS id FROM h),
ego AS (SELECT * FROM h UNION ALL SELECT DISTINCT 2, rel_type, src, dst FROM edges WHERE rel_type = 'EXTRACTED_FROM' AND src <> {_HOT} AND src IN (SELECT id FROM nb)),
lb AS (SELECT key, arg_min(label, CASE label WHEN 'Requirement' THEN 0 WHEN 'Implementation' THEN 1 WHEN 'Evaluation' THEN 2 ELSE 3 END) AS label FROM nodes GROUP BY 1),
w AS (SELECT rel_type, src, dst, arg_min(status, (-confidence, x.correlation_id)) AS status, max(confidence) AS confidence FROM edges x JOIN (SELECT DISTINCT ON (correlation_id) correlation_id, status, confidence FROM correlation) USING (correlation_id) WHERE rel_type = 'CORRELATES_TO' GROUP BY ALL)
SELECT hop, ego.rel_type, ego.src, a.label AS src_label, ego.dst, z.label AS dst_label, status, greatest(1.0, 4 * coalesce(confidence, 0.0)) AS width FROM ego LEFT JOIN w ON w.rel_type = ego.rel_type AND w.src = ego.src AND w.dst = ego.dst AND ego.src = {_HOT} LEFT JOIN lb a ON a.key = ego.src LEFT JOIN lb z ON z.key = ego.dst""")
def g19_layout(spark: SparkSession, d: str) -> DataFrame:
    return graph.layout(*_graph(spark, d), table(spark, d, "correlation"), _hottest(spark, d))


@query(f"""WITH {_EDGES}, s AS (SELECT DISTINCT key FROM nodes WHERE label IN ('Requirement', 'Implementation'))
SELECT rel_type, src, dst, correlation_id FROM edges WHERE src IN (SELECT key FROM s) AND dst IN (SELECT key FROM s)""")
def g18_visible_edges(spark: SparkSession, d: str) -> DataFrame:
    node, edge = _graph(spark, d)
    return graph.visible(node, edge, ["Requirement", "Implementation"])


@query(f"""WITH {_EDGES}, mb AS (SELECT DISTINCT dst AS artifact, src AS other_id FROM edges WHERE rel_type = 'CORRELATES_TO')
SELECT artifact, other_id FROM mb WHERE other_id <> {_HOT} AND artifact IN (SELECT artifact FROM mb WHERE other_id = {_HOT})""")
def g20_shared_with(spark: SparkSession, d: str) -> DataFrame:
    return graph.shared_with(_graph(spark, d)[1], _hottest(spark, d))


# ---- metrics ---------------------------------------------------------------------------------------------


@query("""
WITH p AS (SELECT req_id AS q, chunk_id AS r, max(CASE WHEN isnan(combined_score) THEN NULL ELSE combined_score END) AS s FROM candidates GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, r) AS rank FROM p WHERE s IS NOT NULL),
w AS (SELECT DISTINCT requirement_entity_id AS q, evidence_entity_id AS r FROM correlation WHERE regexp_matches(evidence_entity_id, '^[0-9a-f]{64}$') AND status LIKE 'IMPLEMENTED%'),
z AS (SELECT q, count(*) AS m FROM w GROUP BY 1), h AS (SELECT k.q, count(DISTINCT k.r) AS h, min(rank) AS f FROM k JOIN w ON w.q = k.q AND w.r = k.r WHERE rank <= 10 GROUP BY 1)
SELECT count(*) AS n_queries, round(avg(coalesce(h, 0)::DOUBLE / m), 6) AS recall, round(avg(coalesce(h, 0)::DOUBLE / 10.0), 6) AS precision, round(avg(coalesce(1.0::DOUBLE / f, 0)), 6) AS mrr FROM z LEFT JOIN h USING (q)""")
def ev01_ranking_metrics(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "candidates").groupBy(F.col("req_id").alias("query_id"), F.col("chunk_id").alias("row_id")).agg(F.max(F.when(~F.isnan("combined_score"), F.col("combined_score"))).alias("s")).filter("s is not null")
    from pyspark.sql import Window

    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "row_id")))
    good = table(spark, d, "correlation").filter(graph.is_chunk_id(F.col("evidence_entity_id")) & F.col("status").startswith("IMPLEMENTED"))
    return metrics.ranking_metrics(ranked, good.select(F.col("requirement_entity_id").alias("query_id"), F.col("evidence_entity_id").alias("row_id")))


@query(f"""WITH {_RULES}, dec AS (SELECT requirement_id, CASE WHEN rule_name IN ('exact_requirement_id_match', 'strong_semantic_match') THEN verdict WHEN rule_name = 'requirement_with_no_evidence' THEN 'REQUIREMENT_NOT_IMPLEMENTED' END AS p FROM k),
{_BEST}, a AS (SELECT requirement_entity_id AS requirement_id, status FROM b) SELECT a.status AS actual, p AS predicted, count(*) AS n FROM a FULL OUTER JOIN dec USING (requirement_id) GROUP BY 1, 2""")
def ev04_confusion(spark: SparkSession, d: str) -> DataFrame:
    decided = correlate.decide(table(spark, d, "evidence"), table(spark, d, "candidates")).select("requirement_id", F.col("status").alias("label"))
    stored = matrix.best_correlations(table(spark, d, "correlation")).select(F.col("requirement_entity_id").alias("requirement_id"), F.col("status").alias("label"))
    return metrics.confusion(decided, stored, "requirement_id")


SQL: dict[str, str] = {name: sql() if callable(sql) else sql for name, sql in LATER.items()}
