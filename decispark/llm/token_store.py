"""Token ids in a content-addressed store with Merkle manifests (op8).

Tables under one folder: ``objects``, each distinct one once under its key: chunks (kind chunk;
key: their digest, data: the ids as little-endian unsigned integers of ``WIDTH`` bytes) and the
documents' lists of chunks (kind recipe); ``recipes``, in ascending doc_id order (doc_id, start,
n_tokens, digests, lengths, root); ``manifest``, the Merkle tree over the recipes (level, node,
start, n_docs, n_tokens, root). A rolling hash over the last 16 ids ends a chunk, so equal passages
give equal chunks wherever they stand. A document of at most INLINE ids, which take less room than a
digest, has these themselves in its recipe in the digest's place, so the many null and empty texts of a
table meet in no chunk. A document's root is the SHA-256 of its chunk digests; a
range's comes from its documents' roots, FANOUT at a time and level by level, and the store's
likewise from those of the ranges.

Reading back checks every chunk against its digest and every recipe against its root. CRCs of
chunks are shifted and combined, so no document's ids are gathered anew.

Edge cases: a null or empty text gives the end id alone; equal rows are recipes of their own
with shared chunks; a null doc_id comes first; an empty table gives an empty store; further
columns are ignored. A text that names an added token of the vocabulary gets its id, as from the
library.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWEST, range_of, range_starts, small_batches
from .bpe import byte_characters
from .pieces import Encoder, each, encode_batches, pre_tokens
from .shingles import mix

U = np.uint64
#: A chunk ends where the top MASK_BITS of the rolling hash are zero, after LEAST ids, or after MOST.
WINDOW_STEPS, MASK_BITS, LEAST, MOST = 4, 7, 32, 1024
#: Segments that a Python worker remembers, at about 200 bytes each.
SEGMENTS = 800_000
#: A byte that no word holds; where it is a token of its own and in no other, it parts words that are encoded TOGETHER, CALL such texts at a time.
DIVIDER, TOGETHER, CALL = "\0", 64, 64
#: Id that ends each document; bytes of a stored id.
END_ID, WIDTH = 2, 2
#: Bytes of a digest; documents of at most so many ids are kept in their recipes.
DIGEST = 16
INLINE = (DIGEST - 1) // WIDTH


@cache
def encoder(path: str, pattern: str, segments: int) -> Encoder:
    """One per Python worker; threads of its own would compete with Spark's tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    # What is met again is remembered here; the model's own memory would hold it twice.
    tokenizer.model._resize_cache(0)
    tokenize, split = tokenizer.model.tokenize, regex.compile(pattern).findall
    printable = dict(enumerate(byte_characters()))
    space = printable[32]
    # The model alone, for words that are pre-tokens already; lines part the texts of a call.
    plain, after = Tokenizer(tokenizer.model), DIVIDER + " "
    by_byte = np.array([10 if b == 10 else ord(c) for b, c in printable.items()], "<u4")
    divider, single = tokenizer.token_to_id(printable[ord(DIVIDER)]), sum(printable[ord(DIVIDER)] in t for t in tokenizer.get_vocab()) == 1

    def encode(segment: str) -> list[int]:
        """The library's merges for each pre-token, its bytes written as the library's pre-tokenizer writes them."""
        return [t.id for piece in pre_tokens(segment, split) for t in tokenize(piece.encode().decode("latin-1").translate(printable))]

    def word(letters: str) -> list[int]:
        return [t.id for t in tokenize(space + (letters if letters.isascii() else letters.encode().decode("latin-1").translate(printable)))]

    def words(letters: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many words by one call; DIVIDER follows each, joins with no neighbour and gets one id."""
        found = []
        for i in range(0, len(letters), CALL * TOGETHER):
            groups = [after.join(letters[k : k + TOGETHER]) for k in range(i, min(i + CALL * TOGETHER, len(letters)), TOGETHER)]
            raw = (" " + f"{DIVIDER}\n ".join(groups) + DIVIDER).encode()
            found += [e.ids for e in plain.encode_batch_fast(by_byte[np.frombuffer(raw, np.uint8)].tobytes().decode("utf-32-le").split("\n"), add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(found), np.uint32, sum(map(len, found)))
        ends = np.flatnonzero(ids == divider)
        return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1

    def whole(text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    return Encoder(encode, pattern, segments, words if single else each(word), tuple(t.content for t in tokenizer.get_added_tokens_decoder().values()), whole)


@cache
def _id_values() -> np.ndarray:
    """A random 32-bit value for each id that WIDTH bytes can hold."""
    with np.errstate(over="ignore"):
        return (mix(np.arange(1, 256**WIDTH + 1, dtype=U) * U(0x9E3779B97F4A7C15)) >> U(32)).astype(np.uint32)


def cut_points(ids: np.ndarray, counts: np.ndarray) -> Iterator[list[int]]:
    """For each document the ends of its chunks, as places in ids."""
    with np.errstate(over="ignore"):
        h = _id_values()[ids]
        factor = np.uint32(0x9E3779B1)
        for step in range(WINDOW_STEPS):
            shifted = h[: -(1 << step)] * factor
            h = h.copy()
            h[1 << step :] += shifted
            factor = factor * factor
        at = np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1
    ends = np.cumsum(counts)
    bounds = np.searchsorted(at, np.concatenate([[0], ends]), "right").tolist()
    places = at.tolist()
    for i, (end, count) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
        last, out = end - count, []
        for p in places[bounds[i] : bounds[i + 1]]:
            while p - last > MOST:
                last += MOST
                out.append(last)
            if p - last >= LEAST and p < end:
                out.append(p)
                last = p
        while end - last > MOST:
            last += MOST
            out.append(last)
        out.append(end)
        yield out


OBJECTS = "key binary, kind string, data binary, doc_id bigint, digests array<binary>, lengths array<int>, copies bigint"
RECIPES = "doc_id bigint, start bigint, n_tokens bigint, digests array<binary>, lengths array<int>, root string, r int"
#: Children of a node of the Merkle tree at most.
FANOUT = 256
#: Digests of chunks that a task remembers having sent.
SENT = 200_000


def digest_of(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def parts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows of two kinds: chunk (key: digest, data) and recipe (key: id and root, doc_id, digests, lengths).

    A task sends a chunk once, or again after SENT others, so copies within it are not shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch, ids, counts in encode_batches(batches, encoder(path, pattern, SEGMENTS), 1):
            ids, counts = np.insert(ids, np.cumsum(counts), END_ID), counts + 1
            raw = ids.astype(f"<u{WIDTH}").tobytes()
            chunks: dict[bytes, bytes] = {}
            digests, lengths = [], []
            last = 0
            for ends in cut_points(ids, counts):
                own, sizes = [], []
                for p in ends:
                    d = data = raw[last * WIDTH : p * WIDTH]
                    if len(ends) > 1 or p - last > INLINE:
                        d = digest_of(data)
                        if d not in sent:
                            chunks[d] = data
                    own.append(d)
                    sizes.append(p - last)
                    last = p
                digests.append(own)
                lengths.append(sizes)
            sent = sent if len(sent) < SENT else set()
            sent.update(chunks)
            names = batch.column(0).to_pylist()
            keys = [repr(i).encode() + b":" + hashlib.sha256(b"".join(d)).digest() for i, d in zip(names, digests, strict=True)]
            n, m = len(chunks), len(names)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*chunks, *keys], pa.binary()),
                    pa.array(["chunk"] * n + ["recipe"] * m),
                    pa.array([*chunks.values(), *[None] * m], pa.binary()),
                    pa.array([None] * n + names, pa.int64()),
                    pa.array([None] * n + digests, pa.list_(pa.binary())),
                    pa.array([None] * n + lengths, pa.list_(pa.int32())),
                ],
                names=["key", "kind", "data", "doc_id", "digests", "lengths"],
            )

    return small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "key binary, kind string, data binary, doc_id bigint, digests array<binary>, lengths array<int>")


def root_of(digests: Column) -> Column:
    return F.sha2(F.array_join(F.transform(digests, lambda d: F.hex(d)), ""), 256)


def write(docs: DataFrame, folder: str, path: str, pattern: str) -> None:
    """Encode docs and write the store to folder, in any file system that Spark reaches."""
    spark = docs.sparkSession
    # One sort by key, after the exchange; the tasks before it have dropped their own copies.
    found = parts(docs, path, pattern).repartition("key").groupBy("key").agg(*[F.first(c).alias(c) for c in ("kind", "data", "doc_id", "digests", "lengths")], F.count(F.lit(1)).alias("copies"))
    found.write.option("compression", "zstd").parquet(f"{folder}/objects")
    rows = spark.read.schema(OBJECTS).parquet(f"{folder}/objects").where("kind = 'recipe'").select(F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"), "doc_id", "digests", "lengths")
    n = F.aggregate("lengths", F.lit(0).cast("bigint"), lambda s, x: s + x)
    k = F.coalesce(F.col("doc_id"), F.lit(LOWEST))
    starts, _ = range_starts(rows, "doc_id")
    rows = rows.withColumns({"n_tokens": n, "root": root_of(F.col("digests")), "r": range_of(k, starts)})
    sums = rows.groupBy("r").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("r", (F.sum("n").over(W.orderBy("r")) - F.col("n")).alias("before"))
    inside = W.partitionBy("r").orderBy(F.col("doc_id").asc_nulls_first(), "root", "copy").rowsBetween(W.unboundedPreceding, 0)
    placed = rows.withColumn("own", F.sum("n_tokens").over(inside) - F.col("n_tokens")).join(before, "r").select("doc_id", (F.col("before") + F.col("own")).alias("start"), "n_tokens", "digests", "lengths", "root", "r")
    placed.repartitionByRange("r", "start").sortWithinPartitions("start").write.parquet(f"{folder}/recipes")
    write_manifest(spark, folder)


def write_manifest(spark: SparkSession, folder: str) -> None:
    """The Merkle tree over the recipes: each node is the digest of the roots of at most FANOUT nodes that follow each other.

    Level 0 groups documents by their place within their range; the last level has one node, node 0.
    """
    recipes = spark.read.schema(RECIPES).parquet(f"{folder}/recipes")
    place = F.row_number().over(W.partitionBy("r").orderBy("start")) - 1
    per_range = recipes.groupBy("r").agg(F.count(F.lit(1)).alias("n"))
    first = per_range.select("r", (F.sum(F.ceil(F.col("n") / FANOUT)).over(W.orderBy("r")) - F.ceil(F.col("n") / FANOUT)).alias("first"))
    nodes = recipes.select("r", "start", "n_tokens", "root", place.alias("place")).join(first, "r")
    nodes = nodes.select((F.col("first") + F.floor(F.col("place") / FANOUT)).cast("bigint").alias("node"), "start", F.lit(1).cast("bigint").alias("n_docs"), "n_tokens", "root")
    level = 0
    while True:
        roots = F.transform(F.array_sort(F.collect_list(F.struct("start", "root"))), lambda x: x["root"])
        nodes = nodes.groupBy("node").agg(F.min("start").alias("start"), F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sha2(F.array_join(roots, ""), 256).alias("root"))
        path = f"{folder}/manifest/level={level}"
        nodes.write.parquet(path)
        nodes = spark.read.schema(nodes.schema).parquet(path)
        if nodes.count() <= 1:
            break
        nodes = nodes.withColumn("node", F.floor(F.col("node") / FANOUT).cast("bigint"))
        level += 1


@cache
def _zero_bytes() -> list[np.ndarray]:
    """Tables [k][j][byte] of the CRC-32 after 2**k zero bytes, by byte j of the CRC."""
    table = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    own = np.zeros((4, 256), np.uint32)
    for j in range(4):
        v = np.arange(256, dtype=np.uint32) << np.uint32(8 * j)
        own[j] = (v >> np.uint32(8)) ^ table[v & np.uint32(255)]
    out = [own]
    for _ in range(47):
        out.append(np.stack([_apply(out[-1], out[-1][j]) for j in range(4)]))
    return out


def _apply(table: np.ndarray, v: np.ndarray) -> np.ndarray:
    return table[0][v & np.uint32(255)] ^ table[1][v >> np.uint32(8) & np.uint32(255)] ^ table[2][v >> np.uint32(16) & np.uint32(255)] ^ table[3][v >> np.uint32(24)]


def shift_crc(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Each CRC-32 moved past so many bytes; the XOR of moved chunk CRCs is the CRC of the whole."""
    out, rest, k = crc.astype(np.uint32), zeros.astype(np.int64), 0
    while rest.any():
        on = (rest & 1).astype(bool)
        out[on] = _apply(_zero_bytes()[k], out[on])
        rest, k = rest >> 1, k + 1
    return out


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian 32-bit integers) from the files.

    Fails where a chunk does not match its digest, a chunk is missing, or a recipe does not match its root.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, chunks = (c.to_numpy(zero_copy_only=False).tolist() for c in batch.columns)
            for d, data in zip(digests, chunks, strict=True):
                if digest_of(data) != d:
                    raise ValueError(f"chunk {d.hex()} does not match its digest")
            sizes = np.fromiter(map(len, chunks), np.int32, len(chunks)) // WIDTH
            wide = memoryview(np.frombuffer(b"".join(chunks), f"<u{WIDTH}").astype("<u4").tobytes())
            ends = (4 * np.cumsum(sizes)).tolist()
            crcs = [zlib.crc32(wide[a:b]) for a, b in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crcs, pa.int64()), pa.array(sizes, pa.int32())], names=["digest", "crc", "length"])

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moved = shift_crc(batch.column(1).to_numpy(), batch.column(2).to_numpy() * 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(moved.astype(np.int64)), batch.column(3)], names=["start", "moved", "length"])

    chunks = spark.read.schema(OBJECTS).parquet(f"{folder}/objects").where("kind = 'chunk'").select(F.col("key").alias("digest"), "data").mapInArrow(check, "digest binary, crc bigint, length int")
    recipes = spark.read.schema(RECIPES).parquet(f"{folder}/recipes")
    wrong = F.raise_error(F.concat(F.lit("recipe does not match its root: "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    right = F.when(root_of(F.col("digests")) == F.col("root"), F.col("n_tokens")).otherwise(wrong.cast("bigint"))
    chunked, recipes = recipes.where(F.col("n_tokens") > INLINE).withColumn("n_tokens", right), recipes.withColumn("n_tokens", right)

    def after(state: Column, x: Column) -> Column:
        rest = state["rest"] - x["length"]
        return F.struct(rest.alias("rest"), F.concat(state["out"], F.array(rest)).alias("out"))

    none = F.array().cast("array<bigint>")
    steps = F.aggregate(F.transform("lengths", lambda x: F.struct(x.alias("length"))), F.struct(F.col("n_tokens").alias("rest"), none.alias("out")), after, lambda s: s["out"])
    used = chunked.withColumn("after", steps).select("start", F.explode(F.arrays_zip("digests", "after")).alias("x")).select("start", F.col("x.digests").alias("digest"), F.col("x.after").alias("after"))
    moved = used.join(chunks, "digest").select("start", "crc", "after", "length").mapInArrow(shift, "start bigint, moved bigint, length int")
    sums = moved.groupBy("start").agg(F.bit_xor("moved").alias("ids_crc32"), F.sum("length").alias("found"))
    lost = F.raise_error(F.concat(F.lit("chunks are missing of document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    own, inline = F.get("digests", F.lit(0)), F.col("n_tokens") <= INLINE
    wide = F.unhex(F.regexp_replace(F.hex(own), f"(?<id>.{{{2 * WIDTH}}})", "${id}" + "00" * (4 - WIDTH)))
    whole = recipes.join(sums, "start", "left").withColumn("found", F.when(inline, (F.octet_length(own) / WIDTH).cast("bigint")).otherwise(F.col("found")))
    n = F.when(F.col("found") == F.col("n_tokens"), F.col("n_tokens")).otherwise(lost.cast("bigint"))
    return whole.select("doc_id", "start", n.alias("n_tokens"), F.when(inline, F.crc32(wide)).otherwise(F.col("ids_crc32")).alias("ids_crc32"))
