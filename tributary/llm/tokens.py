"""Sizes of texts in tokens of a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the splitting pattern the vocabulary was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECE = 100_000
_encoders: dict[int, object] = {}


def encoder(vocabulary: bytes):
    """The tokenizer of a vocabulary file's content, made once a process."""
    key = hash(vocabulary)
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _encoders[key] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def _parts(text: str) -> Iterator[str]:
    """A very long text in pieces that end before a blank between letters, where no token spans the cut."""
    while len(text) > PIECE:
        cut = PIECE
        while cut < len(text) and not (text[cut] == " " and text[cut - 1].isalnum() and text[cut + 1 : cut + 2].isalnum()):
            cut += 1
        yield text[:cut]
        text = text[cut:]
    yield text


def count(encode, text: str | None) -> int:
    if not text:
        return 0
    if len(text) <= PIECE:
        return len(encode(text))
    return sum(len(encode(part)) for part in _parts(text))


def with_token_counts(df: DataFrame, text: str = "text", name: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` without its text and with its size in tokens; null and empty texts have 0.

    The vocabulary file (of fixed size, under 2 MB) is read on the driver and broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())
    keep = [c for c in df.columns if c not in (text, name)]
    schema = T.StructType(df.select(*keep).schema.fields).add(name, T.IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value).encode_ordinary
        for batch in batches:
            sizes = [count(encode, t) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sizes, pa.int32())], names=[*keep, name])

    return df.select(*keep, F.col(text)).mapInArrow(run, schema)
