"""Byte-level BPE by a sentencepiece model written directly from a rank file (op9).

A model in sentencepiece's protobuf format gets one piece per rank, its bytes mapped to
printable characters, with the negative rank as score and identity normalisation. A text's
pre-tokens are encoded separately; ids are the file's ranks. Decoding maps ids back to bytes.

Edge cases: a null or empty text gives no ids and decodes to no bytes; repeated rows, further
columns and empty tables pass through; a text that holds a special token's name is ordinary
text. Any text decodes to its own UTF-8 bytes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches
from .pieces import Encoder, each, encode_batches, list_array, pre_tokens


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is visible Latin-1, else the next one from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in set(visible))}
    return [chr(hidden.get(b, b)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model; piece 0 is the unknown one, piece i + 1 the i-th token by rank."""
    chars = byte_characters()
    unknown = "⁇"
    pieces = [_field(1, unknown.encode()) + _field(2, 0.0) + _field(3, 2)]
    pieces += [_field(1, "".join(chars[b] for b in token).encode()) + _field(2, -float(rank)) + _field(3, 1) for token, rank in sorted(ranks.items(), key=lambda x: x[1])]
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(45, unknown.encode())
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


@cache
def encoder(path: str, pattern: str) -> Encoder:
    """One per Python worker."""
    import sentencepiece

    ranks = read_ranks(path)
    model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
    by_piece = [0, *sorted(ranks.values())]
    chars, split, to_ids = byte_characters(), regex.compile(pattern).findall, model.EncodeAsIds

    def encode(segment: str) -> list[int]:
        out: list[int] = []
        for token in pre_tokens(segment, split):
            raw = token.encode()
            rank = ranks.get(raw)
            if rank is None:
                out += [by_piece[i] for i in to_ids("".join([chars[b] for b in raw]))]
            else:
                out.append(rank)
        return out

    def word(letters: str) -> list[int]:
        raw = b" " + letters.encode()
        rank = ranks.get(raw)
        return [rank] if rank is not None else [by_piece[i] for i in to_ids("".join([chars[b] for b in raw]))]

    return Encoder(encode, pattern, words=each(word))


@cache
def token_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes in one array, with start and length by rank."""
    tokens = {rank: token for token, rank in read_ranks(path).items()}
    parts = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
    lengths = np.array([len(p) for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(lengths) - lengths, lengths


def decode_flat(ids: np.ndarray, counts: np.ndarray, path: str) -> pa.Array:
    """Bytes of each run of counts[i] ids."""
    raw, starts, lengths = token_table(path)
    n = lengths[ids]
    ends = np.cumsum(n)
    out = raw[np.repeat(starts[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
    at = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs without its text column and with the ids of the whole texts."""
    rest = [c for c in docs.columns if c not in (text, ids)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values, counts in encode_batches(batches, encoder(path, pattern), 0):
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], list_array(values, counts)], names=[*rest, ids])

    schema = T.StructType([*[docs.schema[c] for c in rest], T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return small_batches(docs).select(F.col(text).cast("string").alias(text), *rest).mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """docs without the ids column and with the bytes that the ids stand for."""
    rest = [c for c in docs.columns if c not in (ids, into)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            counts = np.diff(lists.offsets.to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], decode_flat(lists.flatten().to_numpy(), counts, path)], names=[*rest, into])

    schema = T.StructType([*[docs.schema[c] for c in rest], T.StructField(into, T.BinaryType())])
    return docs.select(ids, *rest).mapInArrow(run, schema)


def with_digest(encoded: DataFrame, ids: str = "ids") -> DataFrame:
    """encoded with n_tokens and ids_sha256, the digest of the decimal ids joined by commas."""
    return encoded.withColumn("n_tokens", F.size(ids).cast("long")).withColumn("ids_sha256", F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256))
