"""Lengths of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame

# Where the vocabulary lies unless the caller says otherwise, and its word pattern.
VOCABULARY = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=2)
def encoding(path: str = VOCABULARY):
    """The tokenizer, loaded once per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_LONG_GAP = re.compile(r"\s{10000}")


def token_ids(text: str, path: str = VOCABULARY) -> list[int]:
    """The tokens of a whole text.

    The tokenizer's own pattern engine has no stack for white space of 10,000 characters and more; texts that hold some are cut into
    words by the same pattern in another engine, and each word is encoded whole, so the tokens are the tokenizer's.
    """
    own = encoding(path)
    if len(text) >= 10_000 and _LONG_GAP.search(text):
        import regex

        return [t for word in regex.findall(PATTERN, text) for t in own._encode_single_piece(word)]
    return own.encode_ordinary(text)


def n_tokens(text: str, path: str = VOCABULARY) -> int:
    return len(token_ids(text, path))


def count_tokens(df: DataFrame, columns: list[Column | str], text: str, path: str = VOCABULARY) -> DataFrame:
    """``columns`` and ``n_tokens`` (0 for an empty text, NULL for a null one); whole texts, one narrow stage."""
    rows = df.select(*columns, text)
    names = rows.columns[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = [None if t is None else n_tokens(t, path) for t in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lengths, pa.int64())], [*names, "n_tokens"])

    return rows.mapInArrow(count, f"{schema}, n_tokens bigint")
