"""From files to logged chunks: validate, tell copies, resolve the type, parse, chunk, normalise, identify.

All files of a batch go through each step together.  Defined results: files that fail validation or have no supported type
are returned with their error and not logged; a file whose text gives no chunk is logged with none; a file of a
content logged as a success, and all but the first of equal files, are skipped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.functions.text import chunk_id, normalise
from traceloom.operators import chunking
from traceloom.plans.lineage import checkpoint
from traceloom.sources import files, parsers

STEP = 1 << 20  # a file holds fewer messages


def normalised_chunks(chunks: DataFrame) -> DataFrame:
    """``chunks`` (source_document, chunk_index, chunk_text, source_locator, source_hash, source_type, metadata) in normal form, with their ids; empty ones are left out, indexes keep their gaps."""
    rows = chunks.withColumn("normalized_text", normalise(F.col("chunk_text"))).filter("normalized_text <> ''")
    return rows.select(
        chunk_id(F.col("source_hash"), F.col("chunk_index")).alias("chunk_id"), "source_document", "source_hash", "source_type", F.col("chunk_index").cast("int").alias("chunk_index"), "source_locator", "normalized_text", F.length("normalized_text").alias("char_count"), "metadata",
    )


def _numbered(elements: DataFrame, key: str, name: str) -> DataFrame:
    return elements.withColumn(name, F.col("position").cast("bigint"))


def chunks_of(typed: DataFrame) -> DataFrame:
    """Typed files (filename, content, text, source_type) to chunks, each type by its parser and its chunker."""
    key = "filename"
    of = lambda kind: typed.filter(F.col("source_type") == kind)
    chat = parsers.parse_chat(of("WHATSAPP"), key, "text").filter("not is_media and not is_system and trim(message_text) <> ''")
    chat = chunking.chat_windows(_numbered(chat.withColumn("_us", F.unix_micros(chunking.chat_time(F.col("timestamp")))), key, "message_no"), key, "message_no", "_us")
    commits = chunking.commit_chunks(parsers.parse_git_log(of("GIT"), key, "text"))
    parts = {
        "PDF": chunking.page_chunks(parsers.read_pages(of("PDF"), key), key),
        "DOCX": chunking.document_chunks(parsers.read_docx(of("DOCX"), key), key),
        "MARKDOWN": chunking.section_chunks(parsers.parse_markdown(of("MARKDOWN"), key, "text"), key),
        "PYTHON": chunking.python_chunks(parsers.parse_python(of("PYTHON"), key, "text", key), key, "position"),
        "EMAIL": chunking.email_chunks(_numbered(parsers.parse_email(of("EMAIL"), key, "text"), key, "message_no"), key, "message_no"),
        "WHATSAPP": chunking.chat_context_chunks(chat, key, "message_no"),
        "GIT": chunking.chunk_elements(commits.select(key, "position", "text", "locator", chunking.commit_metadata(key).alias("metadata")), key, ["position"], overlap=False, kind="GIT"),
    }
    columns = [key, "chunk_index", "chunk_text", "source_locator", "metadata"]
    made = [df.select(*columns, F.lit(kind).alias("source_type")) for kind, df in parts.items()]
    return reduce(DataFrame.unionByName, made)


def ingest_files(read: DataFrame, log: DataFrame, mime: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``read``: filename (unique), content, length.  (chunks, rows for the log, rejected files)."""
    good, bad = files.ingest(read, log, mime)
    typed = checkpoint(good.select("filename", "content", "text", "file_hash", "source_type", "length"))
    about = typed.select("filename", F.col("file_hash").alias("source_hash"))
    chunks = checkpoint(normalised_chunks(chunks_of(typed).join(about, "filename").withColumnRenamed("filename", "source_document")))
    counts = chunks.groupBy(F.col("source_document").alias("filename")).agg(F.count(F.lit(1)).cast("int").alias("chunk_count"))
    rows = typed.join(counts, "filename", "left").select("filename", "file_hash", F.col("length").alias("file_size"), "source_type", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.lit("success").alias("status"), F.lit(None).cast("string").alias("error_message"), F.current_timestamp().alias("ingested_at"))
    return chunks, rows, bad
