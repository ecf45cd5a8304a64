"""Packing by power-of-two decomposition.

The tokens of a document, followed by an end token, are cut from the left into as many full sequences as fit and then
into pieces of strictly falling powers of two: 5,000 tokens become 2048 + 2048 + 512 + 256 + 128 + 8. A piece is a
sequence of its own, so no sequence crosses documents and none is padded; batches are formed from the bucket of one
length. Documents are independent, so nothing is shuffled.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LENGTH = 2048
END_ID = 1
VOCABULARY = "byte_bpe_50k.tiktoken"
# The added token of that vocabulary, which is recognised inside texts too, and its id.
ADDED_TOKENS = {"<|endoftext|>": 50256}


def piece_lengths(tokens: int, max_length: int = MAX_LENGTH) -> list[int]:
    """Full sequences, then the binary digits of the rest from the highest. ``max_length`` must be a power of two."""
    rest = tokens % max_length
    return [max_length] * (tokens // max_length) + [
        1 << bit for bit in range(max_length.bit_length() - 2, -1, -1) if rest >> bit & 1
    ]


_encodings: dict[str, tiktoken.Encoding] = {}


def encoding(path: str) -> tiktoken.Encoding:
    """Byte-level BPE from a file of base64 byte strings and ranks; added tokens inside a text have ids of their own.

    The ids equal those of the same vocabulary in JSON form under the ``tokenizers`` library with its defaults, at a
    quarter of its time.
    """
    if path not in _encodings:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        pattern = public_tokenizers.PATTERN
        _encodings[path] = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=ADDED_TOKENS)
    return _encodings[path]


_SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint"
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
    ]
)
_BATCH_BYTES = 8 * 1024 * 1024


def pack(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    path: str | None = None,
    max_length: int = MAX_LENGTH,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``,
    ``sequence_id``, ``offset`` (always 0) and ``bucket`` (the binary logarithm of the length).

    A NULL text counts as empty; an empty text is the end token alone, one piece of length 1. Rows with a NULL or
    repeated id are packed like any other. ``sequence_id`` is unique, not gapless. Other columns play no part.
    """
    if max_length & (max_length - 1) or max_length < 1:
        raise ValueError("max_length must be a power of two")
    source = path or public_tokenizers.path(VOCABULARY)
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(source).encode
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows: list[tuple] = []
            held = 0
            for name, body in zip(names, texts, strict=True):
                tokens = array("I", encode(body, allowed_special="all")).tobytes() + end
                total, at = len(tokens) // 4, 0
                for length in piece_lengths(total, max_length):
                    rows.append((name, at, length, tokens[4 * at : 4 * (at + length)], total))
                    at += length
                held += len(tokens)
                if held > _BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    pieces = texts.mapInArrow(run, _SCHEMA)
    return pieces.select(
        "*",
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"),
        F.log2("length").cast("int").alias("bucket"),
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW
    )
