"""Benchmark decontamination: a broadcast hash set of normalised n-grams, verified hits, spans or documents removed (op11).

Texts and items are lower-cased (A-Z) and cut into words of letters, digits and all characters
beyond ASCII. An item gives every run of n words; one of fewer words gives one shorter window.
Windows are hashed over word numbers, so a document is only looked at where n words in a row
are known to the set; a hit is confirmed word by word. Rows are kept one for one and nothing is
shuffled.

The set is broadcast in blocks of at most ``block_words`` words. Up to that size there is one
block; a larger benchmark is scanned block by block and the hits of equal texts are merged by
the text's digest, so that no broadcast grows with the benchmark. Items longer than a piece are
cut into overlapping pieces, which together hold all their windows.

Edge cases: a null or empty text has no words and no hits; an item without words has no
window; windows of an item without id are hit and count for no item; repeated items and ids count
once; an empty benchmark hits nothing; an empty table gives an empty result; columns named
like the operator's own are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tables, plain_words, small_batches

#: Words in a window; words that one broadcast block holds; words by which long items are cut.
WINDOW, BLOCK_WORDS, PIECE_WORDS = 10, 2_000_000, 10_000
#: The same words in a text that is not lower-cased, so their places are the text's own.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SPACING = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FACTOR = np.uint64(0x9E3779B97F4A7C15)
RUN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
OWN = ("n_words", "n_hit", "items", "spans")


def item_pieces(items: DataFrame, item: str, text: str, n: int, piece: int) -> DataFrame:
    """item (as text) and words: runs of at most piece + n - 1 words that hold all windows of the items, each once."""
    lower = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER)
    d = items.select(F.col(item).cast("string").alias("item"), F.array_remove(F.split(lower, SPACING, -1), "").alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0)), F.lit(piece))
    return d.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at") + 1, F.lit(piece + n - 1)).alias("words")).distinct()


class Windows:
    """The windows of some pieces: sorted hashes per length, each with the word numbers and the items that it stands for."""

    def __init__(self, pieces: list[tuple[str | None, list[str]]], n: int) -> None:
        self.n = n
        self.vocabulary: dict[bytes, int] = {}
        number = lambda w: self.vocabulary.setdefault(w.encode(), len(self.vocabulary) + 1)
        self.words = np.array([number(w) for _, ws in pieces for w in ws], np.int64)
        self.names = sorted({i for i, _ in pieces if i is not None})
        place = {name: k for k, name in enumerate(self.names)}
        owner = np.array([place.get(i, -1) for i, _ in pieces], np.int64)
        size = np.array([len(ws) for _, ws in pieces], np.int64)
        first = np.cumsum(size) - size
        length = np.minimum(size, n)
        many = size - length + 1
        starts = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
        lengths, owners = np.repeat(length, many), np.repeat(owner, many)
        self.by_length = {int(k): self._grouped(starts[lengths == k], owners[lengths == k], int(k)) for k in np.unique(lengths)}

    def _grouped(self, starts: np.ndarray, owners: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Sorted hashes, a start for each, and its items; windows of equal hash and different words stay apart."""
        rows = self.words[starts[:, None] + np.arange(length)]
        rows, inverse = np.unique(rows, axis=0, return_inverse=True)
        inverse = inverse.reshape(-1)
        one = np.zeros(len(rows), np.int64)
        one[inverse] = starts
        order = np.argsort(inverse, kind="stable")
        own = np.split(owners[order], np.cumsum(np.bincount(inverse, minlength=len(rows)))[:-1])
        hashes = self.hashes(self.words, one, length)
        by_hash = np.argsort(hashes, kind="stable")
        return hashes[by_hash], one[by_hash], [np.unique(own[k][own[k] >= 0]) for k in by_hash]

    @staticmethod
    def hashes(words: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        h = np.zeros(len(starts), np.uint64)
        for k in range(length):
            h = (h ^ words[starts + k].astype(np.uint64)) * FACTOR
            h ^= h >> np.uint64(29)
        return h

    def hits(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, list[np.ndarray]]]:
        """Per length: starts of confirmed windows in ids (0: unknown), which window each is, the length, and the windows' items."""
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        for length, (hashes, ones, owners) in self.by_length.items():
            at = np.flatnonzero(known[length:] - known[:-length] == length) if len(ids) >= length else np.zeros(0, np.int64)
            if not len(at):
                continue
            h = self.hashes(ids, at, length)
            low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            starts, which = np.repeat(at, high - low), np.repeat(low - (np.cumsum(high - low) - (high - low)), high - low) + np.arange((high - low).sum())
            same = (ids[starts[:, None] + np.arange(length)] == self.words[ones[which][:, None] + np.arange(length)]).all(axis=1)
            yield starts[same], which[same], length, owners


_index: dict[int, Windows] = {}


def _windows(pieces: Broadcast, n: int) -> Windows:
    """One per Python worker and block."""
    key = pieces._jbroadcast.id() if getattr(pieces, "_jbroadcast", None) else id(pieces.value)
    if key not in _index:
        _index.clear()
        _index[key] = Windows(pieces.value, n)
    return _index[key]


def _numbered(raw: list[bytes | None], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts, a 0 after each text, and the places where texts start; len(raw) + 1 of them."""
    words = [plain_words(t) if t else [] for t in raw]
    get = vocabulary.get
    ids = np.fromiter((get(w, 0) for w in chain.from_iterable([*w, b""] for w in words)), np.int64)
    return ids, np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])]).astype(np.int64)


def _found(raw: list[bytes | None], windows: Windows) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """Which words are hit, the places where texts start, and the items of each text."""
    ids, first = _numbered(raw, windows.vocabulary)
    change = np.zeros(len(ids) + 1, np.int64)
    items: list[set[int]] = [set() for _ in raw]
    for starts, which, length, owners in windows.hits(ids):
        np.add.at(change, starts, 1)
        np.add.at(change, starts + length, -1)
        pairs = np.unique(np.stack([np.searchsorted(first, starts, "right") - 1, which]), axis=1)
        for text, w in pairs.T:
            items[text].update(owners[w].tolist())
    return np.cumsum(change)[:-1] > 0, first, [sorted(windows.names[i] for i in s) for s in items]


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _spans(text: str, hit: np.ndarray) -> list[dict[str, int]]:
    """Code points from the first to the end of the last word of each run of hit words."""
    words = [m.span() for m in WORD.finditer(text)]
    return [{"start": words[a][0], "end": words[b - 1][1]} for a, b in zip(*_runs(hit), strict=True)]


def _run_type() -> pa.DataType:
    return pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _scan_block(docs: DataFrame, text: str, pieces: Broadcast, n: int) -> DataFrame:
    """docs without text, with n_words, n_hit, items and spans."""
    rest = [c for c in docs.columns if c != text and c not in OWN]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            hit, first, items = _found(texts.cast(pa.binary()).to_pylist(), _windows(pieces, n))
            n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[first])
            spans = [_spans(texts[i].as_py(), hit[first[i] : first[i + 1] - 1]) if n_hit[i] else [] for i in range(len(texts))]
            own = [pa.array(np.diff(first) - 1), pa.array(n_hit), pa.array(items, pa.list_(pa.string())), pa.array(spans, _run_type())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *own], names=[*rest, *OWN])

    kinds = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", RUN)]
    return small_batches(docs).select(F.col(text).cast("string").alias(text), *rest).mapInArrow(run, T.StructType([*[docs.schema[c] for c in rest], *kinds]))


def _merged(docs: DataFrame, text: str, blocks: list[Broadcast], n: int, tables: Tables) -> DataFrame:
    """As _scan_block, for several blocks: the hits of each block by the text's digest, merged, then joined to docs."""
    rest = [c for c in docs.columns if c != text and c not in OWN]
    keyed = docs.select(F.col(text).cast("string").alias("text"), F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256).alias("key"))
    found = None
    for k, block in enumerate(blocks):
        one = tables.cut(_scan_block(keyed, "text", block, n).where("n_hit > 0").select("key", "items", "spans").dropDuplicates(["key"]), f"hits{k}")
        found = one if found is None else found.unionByName(one)
    merged = tables.cut(found.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans")), "hits")
    few = F.broadcast(merged) if merged.count() <= 100_000 else merged
    d = docs.select(F.col(text).cast("string").alias(text), *rest).withColumn("__key", F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256))
    d = d.join(few.withColumnRenamed("items", "__items").withColumnRenamed("spans", "__spans"), F.col("__key") == F.col("key"), "left").drop("__key", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, parts = batch.column(0), batch.column(batch.num_columns - 1).to_pylist()
            counts, hits, spans = [], [], []
            for t, own in zip(texts, parts, strict=True):
                value = t.as_py() or ""
                words = [m.span() for m in WORD.finditer(value)] if own else []
                hit = np.zeros(len(words), bool)
                starts = np.array([a for a, _ in words], np.int64)
                for s in own or []:
                    hit[np.searchsorted(starts, s["start"]) : np.searchsorted(starts, s["end"])] = True
                counts.append(len(words) if own else len(plain_words(value.encode())))
                hits.append(int(hit.sum()))
                spans.append(_spans(value, hit) if own else [])
            columns = [*batch.columns[1:-1], pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array(spans, _run_type())]
            yield pa.RecordBatch.from_arrays(columns, names=[*rest, "__items", "n_words", "n_hit", "spans"])

    kinds = [T.StructField("__items", T.ArrayType(T.StringType())), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("spans", RUN)]
    out = small_batches(d).select(text, *rest, "__items", "__spans").mapInArrow(run, T.StructType([*[docs.schema[c] for c in rest], *kinds]))
    return out.select(*rest, "n_words", "n_hit", F.coalesce("__items", F.array().cast("array<string>")).alias("items"), "spans")


def scan(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", n: int = WINDOW, block_words: int = BLOCK_WORDS, piece_words: int = PIECE_WORDS) -> DataFrame:
    """docs without its text column, with n_words, n_hit (words in a window of an item), items (ids as text, sorted) and spans.

    spans: array of (start, end) in code points, end exclusive, one for each run of hit words.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "decontamination")
    pieces = tables.cut(item_pieces(items, item, item_text, n, piece_words), "pieces")
    total = pieces.agg(F.sum(F.size("words"))).first()[0] or 0
    many = max(1, math.ceil(total / block_words))
    if many > 1:
        pieces = tables.cut(pieces.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(many))), "pieces")
    of_block = lambda k: pieces.where(F.col("block") == k) if many > 1 else pieces
    blocks = [spark.sparkContext.broadcast([(r["item"], list(r["words"])) for r in of_block(k).select("item", "words").collect()]) for k in range(many)]
    return _scan_block(docs, text, blocks[0], n) if many == 1 else _merged(docs, text, blocks, n, tables)


def without_spans(text: Column, spans: Column) -> Column:
    """text less its spans, which are sorted and apart; null stays null."""
    ends = F.transform(spans, lambda s: s["end"])
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text)))
    begins = F.concat(F.array(F.lit(0)), ends)
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(F.transform(F.arrays_zip(begins.alias("a"), starts.alias("b")), lambda x: F.substr(text, x["a"] + 1, x["b"] - x["a"])), ""))


def decontaminated(docs: DataFrame, items: DataFrame, remove: str = "documents", most_share: float = 0.0, **options: object) -> DataFrame:
    """docs without benchmark text, all columns as they were.

    remove="documents": rows go where more than most_share of their words are hit. remove="spans": rows
    stay, and the runs of hit words go from their texts.
    """
    text = str(options.get("text", "text"))
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("__text"))
    found = scan(whole, items, **{**options, "text": "__text"})
    if remove == "documents":
        return found.where(F.col("n_hit") <= most_share * F.col("n_words")).select("row.*")
    clean = without_spans(F.col(f"row.{text}"), F.col("spans"))
    return found.select(*[clean.alias(c) if c == text else F.col(f"row.{c}").alias(c) for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
