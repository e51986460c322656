"""Encoding texts with a public byte-level BPE (problem 8).

Defined results: a null or an empty text gives the empty list; strings of special tokens are
ordinary text; every row of the input gives one row, repeated ids included.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

DEFAULT_RANKS = os.path.join(os.environ.get("FOLIOFLOW_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")

#: The public GPT-2 pre-token pattern; fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Texts above this length are encoded in pieces.
LONG_TEXT = 65_536


@functools.lru_cache(maxsize=4)
def _encoding(ranks_path: str):
    """The tokenizer of a rank file, once for each Python worker."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = LONG_TEXT) -> list[str]:
    """Cut a text before single blanks between two non-blanks.

    A pre-token never runs over such a place: it ends before white space, and the blank
    starts the next one. So the pieces' ids are the text's ids. Where there is no such
    place within a piece, the piece grows.
    """
    if len(text) <= size:
        return [text]
    out, start, n = [], 0, len(text)
    while n - start > size:
        at = start + size
        while at < n - 1 and not (text[at] == " " and not text[at - 1].isspace() and not text[at + 1].isspace()):
            at = text.find(" ", at + 1)
            if at < 0:
                at = n
        if at >= n - 1:
            break
        out.append(text[start:at])
        start = at
    out.append(text[start:])
    return out


def encode_text(text: str | None, ranks_path: str = DEFAULT_RANKS) -> list[int]:
    if not text:
        return []
    encoding = _encoding(ranks_path)
    if len(text) <= LONG_TEXT:
        return encoding.encode_ordinary(text)
    return [i for piece in safe_pieces(text) for i in encoding.encode_ordinary(piece)]


def decode_ids(ids: list[int], ranks_path: str = DEFAULT_RANKS) -> str:
    """Join the ids' raw bytes first: a character may lie in several tokens."""
    encoding = _encoding(ranks_path)
    return b"".join(encoding.decode_single_token_bytes(i) for i in ids).decode("utf-8", errors="replace")


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """(id, ids array<int>) of each row. Only the two columns leave the scan; no shuffle."""
    id_type = df.schema[id_col].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids = pa.array([encode_text(t, ranks_path) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [id_col, "ids"])

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(batches, f"`{id_col}` {id_type}, ids array<int>")


def decode(df: DataFrame, ids_col: str = "ids", out_col: str = "text", ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """Adds the text of the ids. A null list gives a null text."""

    @pandas_udf("string")
    def to_text(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: None if x is None else decode_ids([int(i) for i in x], ranks_path))

    return df.withColumn(out_col, to_text(F.col(ids_col)))


def token_counts(ranks_path: str = DEFAULT_RANKS):
    """Expression function: number of tokens of a text column, 0 for null."""

    @pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(encode_text(t, ranks_path)) for t in texts], dtype="int32")

    return count
