"""Files as rows: reading, validation, identity, type resolution, decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.config import SETTINGS

# What a media type or a file name's ending says about the source.
BY_MIME = {
    "application/pdf": "PDF",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "DOCX",
    "application/msword": "DOCX",
    "message/rfc822": "EMAIL",
    "text/markdown": "MARKDOWN",
    "text/x-markdown": "MARKDOWN",
    "text/x-python": "PYTHON",
    "application/x-python-code": "PYTHON",
}
BY_EXTENSION = {"pdf": "PDF", "docx": "DOCX", "doc": "DOCX", "eml": "EMAIL", "mbox": "EMAIL", "md": "MARKDOWN", "markdown": "MARKDOWN", "mdx": "MARKDOWN", "py": "PYTHON", "pyw": "PYTHON"}
CHAT_LINE = r"^\[?\d{1,2}/\d{1,2}/\d{2,4},\s*\d{1,2}:\d{2}"
COMMIT_MARK = "<<<COMMIT_START>>>"


def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """filename, content, length, modified; sub-folders included.  Spark's file reader itself passes over files without a byte."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), "content", "length", F.col("modificationTime").alias("modified"))


def validation_error(length: Column, most: int = SETTINGS.max_file_bytes) -> Column:
    """NULL for a file that may be read; a file of exactly the limit may."""
    return F.when(length == 0, "empty file").when(length > most, "file too large")


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def first_copies(files: DataFrame, log: DataFrame, hash_column: str = "file_hash", order: str = "filename") -> DataFrame:
    """Files whose content was not ingested before: no success in the log, and the first of equal ones here.

    The first is found by a partial aggregate, so any number of copies of one content is harmless.
    """
    done = log.filter(F.col("status") == "success").select(F.col("file_hash").alias(hash_column)).distinct()
    firsts = files.groupBy(hash_column).agg(F.min(order).alias(order))
    return files.join(firsts, [hash_column, order], "left_semi").join(done, hash_column, "left_anti").dropDuplicates([hash_column])


def extension(filename: Column) -> Column:
    return F.regexp_extract(F.lower(filename), r"\.([^./]+)$", 1)


def decode(content: Column) -> Column:
    """UTF-8 where it is valid, else Latin-1; a byte-order mark stays."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def looks_like_chat(text: Column) -> Column:
    """Two of the first ten lines begin as chat lines."""
    lines = F.slice(F.split(F.substring(text, 1, 2000), r"\r\n|\r|\n"), 1, 10)
    return F.size(F.filter(lines, lambda x: x.rlike(CHAT_LINE))) >= 2


def looks_like_email(text: Column) -> Column:
    return F.regexp_replace(F.substring(text, 1, 1000), r"^\s+", "").rlike(r"^From[: ]")


def looks_like_git_log(text: Column) -> Column:
    start = F.substring(text, 1, 1000)
    return start.rlike(r"(?m)^commit [0-9a-f]{40}") | start.contains(COMMIT_MARK)


# The media type that an ending stands for, and how files of known kinds begin.
MIME_OF_EXTENSION = {
    "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "doc": "application/msword", "eml": "message/rfc822",
    "md": "text/markdown", "markdown": "text/markdown", "py": "text/x-python", "txt": "text/plain", "log": "text/plain",
}
BEGINNINGS = {"25504446": "application/pdf", "504B0304": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "D0CF11E0": "application/msword"}


def mime_type(filename: Column, content: Column | None = None) -> Column:
    """The media type by how the bytes begin, else by the ending; ``application/octet-stream`` if neither says."""
    table = lambda d: F.create_map(*[F.lit(x) for pair in d.items() for x in pair])
    begins = F.try_element_at(table(BEGINNINGS), F.substring(F.hex(F.substring(content, 1, 4)), 1, 8)) if content is not None else F.lit(None).cast("string")
    return F.coalesce(begins, F.try_element_at(table(MIME_OF_EXTENSION), extension(filename)), F.lit("application/octet-stream"))


def source_type(filename: Column, text: Column, mime: Column | None = None) -> Column:
    """Media type, then ending, then the look of the text; a plain .txt is Markdown; NULL: not supported."""
    table = lambda d: F.create_map(*[F.lit(x) for pair in d.items() for x in pair])
    end = extension(filename)
    plain = end.isin("txt", "log")
    by_mime = F.lit(None).cast("string")
    if mime is not None:
        by_mime = F.try_element_at(table(BY_MIME), F.lower(mime))
        plain = plain | F.coalesce(F.lower(mime).isin("text/plain", "application/octet-stream"), F.lit(False))
    look = F.when(looks_like_chat(text), "WHATSAPP").when(looks_like_email(text), "EMAIL").when(looks_like_git_log(text), "GIT").when(end == "txt", "MARKDOWN")
    return F.coalesce(by_mime, F.try_element_at(table(BY_EXTENSION), end), F.when(plain, look))


def ingest(files: DataFrame, log: DataFrame, mime: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(files to parse with file_hash, content, text and source_type; rejected files with an error).  ``mime``: a column, else the bytes and the ending tell."""
    checked = files.withColumn("file_hash", content_hash(F.col("content"))).withColumn("error_message", validation_error(F.col("length")))
    bad = checked.filter("error_message is not null").select("filename", "file_hash", "error_message")
    fresh = first_copies(checked.filter("error_message is null").drop("error_message"), log)
    typed = fresh.withColumn("text", decode(F.col("content"))).withColumn("source_type", source_type(F.col("filename"), F.col("text"), F.col(mime) if mime else mime_type(F.col("filename"), F.col("content"))))
    unsupported = typed.filter("source_type is null").select("filename", "file_hash", F.lit("unsupported type").alias("error_message"))
    return typed.filter("source_type is not null"), bad.unionByName(unsupported)
