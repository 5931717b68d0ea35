"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Long texts are cut at safe boundaries first: before a space or newline that
follows a character which is no white space, and, for the pattern of ``LETTERS``,
between letters, digits and other marks but the apostrophe.  Every match of the
pattern ends there, so cutting cannot change a token, and no call sees more than
about ``SPLIT_CHARS`` characters unless a single run of letters, digits, marks or
white space is longer.  Decoding joins raw token bytes, so any id sequence has
bytes even where they are no UTF-8.

Defined results: a null text counts as empty and has no token; special-token
strings are ordinary text; very long texts are encoded whole, piece by piece;
repeated rows are encoded separately and alike; extra columns are not read; an
empty table gives an empty table.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from strandline.llm.common import slices

SPLIT_CHARS = 100_000
_BLANK = r"(?<=[\w!-~])(?=[ \n])"
_MARK = r"[!-&(-/:-@\[-`{-~]"
_CLASS = rf"(?<=[A-Za-z])(?=[0-9]|{_MARK})|(?<=[0-9])(?=[A-Za-z]|{_MARK})|(?<={_MARK})(?=[A-Za-z0-9])"
#: Fixed value: the pattern whose matches hold letters, digits or other marks, and only an apostrophe joins two kinds.
LETTERS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BOUNDARIES = {LETTERS: re.compile(f"{_BLANK}|{_CLASS}")}
_BOUNDARY = re.compile(_BLANK)


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def split_safely(text: str, chars: int = SPLIT_CHARS, pattern: str = "") -> list[str]:
    """``text`` in pieces of about ``chars`` characters whose tokens, split by ``pattern``, are the whole text's."""
    out, start, boundary = [], 0, _BOUNDARIES.get(pattern, _BOUNDARY)
    while len(text) - start > chars:
        found = boundary.search(text, start + chars)
        if not found:
            break
        out.append(text[start : found.start()])
        start = found.start()
    out.append(text[start:])
    return out


def encode(text: str | None, enc: tiktoken.Encoding) -> np.ndarray:
    """Token ids as unsigned 32-bit integers."""
    if not text:
        return np.zeros(0, np.uint32)
    if len(text) <= SPLIT_CHARS:
        return np.array(enc.encode_ordinary(text), np.uint32)
    return np.concatenate([np.array(enc.encode_ordinary(x), np.uint32) for x in split_safely(text, pattern=enc._pat_str)])


def decode(ids: np.ndarray, enc: tiktoken.Encoding) -> bytes:
    """The raw bytes of the tokens."""
    return enc.decode_bytes(ids.tolist())


def with_tokens(
    docs: DataFrame,
    rank_file: str,
    pattern: str,
    finish: Callable[[str, np.ndarray, tiktoken.Encoding], tuple],
    columns: str,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``finish(text, ids, encoding)`` of every row beside its key, inside the encoding task.

    ``columns`` names and types what ``finish`` returns, as a DDL string.
    """
    names = [c.split()[0] for c in columns.split(",")]
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, {columns}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            for part in slices(batch, 1, 200):
                rows = [finish(t or "", encode(t, enc), enc) for t in part.column(1).to_pylist()]
                cols = [pa.array(x) for x in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], [key, *names])

    return docs.select(key, text).mapInArrow(run, schema)


def encoded(docs: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every row."""
    return with_tokens(docs, rank_file, pattern, lambda _, ids, __: (ids.astype(np.int32),), "ids array<int>", key, text)


def decoded(tokens: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, bytes) of every row of token ids; a null list has no bytes."""
    schema = f"{key} {tokens.schema[key].dataType.simpleString()}, bytes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            out = [enc.decode_bytes(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], [key, "bytes"])

    return tokens.select(key, ids).mapInArrow(run, schema)
