"""MinHash near-duplicates by SetSketch registers (op4).

Each text's distinct five-word shingles give a sketch of exponentially spaced minima. Texts
with equal sets are one class. Bands of registers gather classes into buckets; in every bucket
each class meets the least class, estimates by joint likelihood choose its best partner, and
full sets confirm. What is then linked counts as one. Only buckets that still hold more than
one group are looked at again: there all pairs between different groups are estimated on their
sketches, and the full sets of those members that have a pair near the threshold confirm. So no
link between candidates is lost, and no bucket emits more links than it has members. A link is
missed only where no band agrees: at most 5 in a million at the threshold.

Sets below 1 / (1 - threshold) shingles link with nothing but equal sets and are not banded.
Large buckets of the second step are split into blocks that meet two by two.

Edge cases: a null or empty text and one without words have no shingles and link with nothing;
texts of one to four words have one; repeated rows are one class; rows of one id with different
texts are documents of their own, of which `representative` marks one in each group; a null id is
never linked and is kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shingles
from .common import Tables, small_batches

#: At most so many rows are broadcast; beyond, the join shuffles both sides.
BROADCAST_ROWS = 100_000
#: Members of a bucket that are compared in one block, and the shingles that they may have together.
BLOCK, BLOCK_SHINGLES = 2_000, 2_000_000
#: Members of buckets, more or less, that a task compares.
MEMBERS_PER_TASK = 4_000
#: A class of more documents is joined to them by a broadcast of its own, for a third of all rows may be copies of one text.
HOT_COPIES = 100_000


def rows_per_band(threshold: float, missed: float = 5e-6) -> int:
    return max(r for r in range(1, 33) if (1 - threshold**r) ** (shingles.REGISTERS // r) <= missed or r == 1)


def text_key() -> Column:
    """Tells texts of one id apart."""
    return F.xxhash64(F.col("text").cast("string"))


def features(docs: DataFrame, least: int = 6, carry: tuple[str, ...] = ()) -> DataFrame:
    """The carried columns, doc_id, text_key, n_shingles, signature, and sketch where there are at least `least` shingles."""
    own = ["doc_id", "text_key", *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sets = list(shingles.sets_of(batch.column(0)))
                large = [i for i, s in enumerate(sets) if len(s) >= least]
                sketch: list[bytes | None] = [None] * len(sets)
                for i, row in zip(large, shingles.sketches([sets[i] for i in large]), strict=True):
                    sketch[i] = row.tobytes()
                found = [pa.array([len(s) for s in sets], pa.int64()), pa.array([shingles.signature(s) for s in sets], pa.binary()), pa.array(sketch, pa.binary())]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], *found], names=[*own, "n_shingles", "signature", "sketch"])

    d = small_batches(docs).select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("text_key"), *carry)
    schema = T.StructType([*[d.schema[c] for c in own], T.StructField("n_shingles", T.LongType()), T.StructField("signature", T.BinaryType()), T.StructField("sketch", T.BinaryType())])
    return d.mapInArrow(run, schema)


def bands(classes: DataFrame, rows: int) -> DataFrame:
    """key and id of each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            registers = _registers(batch.column(1).to_pylist())
            keys = shingles.band_keys(registers, rows)
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(ids)], names=["key", "id"])

    return classes.where("sketch is not null").select("id", "sketch").mapInArrow(run, "key bigint, id bigint")


def _registers(sketches: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint16).reshape(len(sketches), shingles.REGISTERS)


def _if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it has few rows. df is read from a written table, so the count is cheap."""
    return F.broadcast(df) if df.count() <= rows else df


def estimated(pairs: DataFrame, classes: DataFrame, tables: Tables) -> DataFrame:
    """pairs a, b with estimate, the similarity by joint likelihood."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x, y = _registers(f["x"].tolist()), _registers(f["y"].tolist())
                near = shingles.likelihood_estimate((x > y).sum(1), (x < y).sum(1), f["nx"].to_numpy(float), f["ny"].to_numpy(float))
                yield pd.DataFrame({"a": f["a"], "b": f["b"], "estimate": near})

    own = classes.join(_if_small(pairs), F.col("id") == F.col("b")).select("a", "b", F.col("n_shingles").alias("ny"), F.col("sketch").alias("y"))
    centres = tables.cut(pairs.select("a").distinct(), "centres")
    other = classes.join(_if_small(centres), F.col("id") == F.col("a"), "left_semi").select("id", F.col("n_shingles").alias("nx"), F.col("sketch").alias("x"))
    return own.join(other, F.col("a") == F.col("id")).drop("id").mapInPandas(run, "a bigint, b bigint, estimate double")


def confirmed(docs: DataFrame, pairs: DataFrame, known: DataFrame, percent: int, tables: Tables) -> DataFrame:
    """The pairs a, b whose full shingle sets have 100 * intersection >= percent * union."""

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keep = [alike(x, y, percent) for x, y in zip(f["x"], f["y"], strict=True)]
            yield f.loc[np.array(keep, bool), ["a", "b"]]

    found = shingle_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")), known, tables)
    left = pairs.join(found.withColumnRenamed("items", "y"), F.col("b") == F.col("id")).drop("id")
    return left.join(found.withColumnRenamed("items", "x"), F.col("a") == F.col("id")).drop("id").mapInPandas(check, "a bigint, b bigint")


def components(links: DataFrame, tables: Tables) -> DataFrame:
    """id and component, the least id reachable, of every id with a link.

    Each round hangs every id's larger neighbours, then all its smaller ones, under the least;
    both keep the components, and the number of rounds grows with the logarithm of their size.
    """
    edges = tables.cut(links.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        hung = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        low = hung.groupBy("v").agg(F.min("u").alias("m"))
        step = hung.join(low, "v")
        edges = tables.cut(step.where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v")).unionByName(low.select(F.col("m").alias("u"), "v")).distinct(), "links")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct()
    return edges.select(F.col("v").alias("id"), F.col("u").alias("component")).unionByName(roots)


def shingle_sets(docs: DataFrame, ids: DataFrame, known: DataFrame, tables: Tables) -> DataFrame:
    """id and items, the sorted shingle hashes, of the classes in ids; known has a document (doc_id, text_key) of each class."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s.tobytes() for s in shingles.sets_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["id", "items"])

    wanted = tables.cut(known.join(_if_small(tables.cut(ids.distinct(), "ids")), "id", "left_semi").select("id", "doc_id", "text_key"), "wanted")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key().alias("text_key"))
    texts = texts.join(_if_small(wanted), ["doc_id", "text_key"]).select("id", "text")
    return texts.mapInArrow(sets, "id bigint, items binary").groupBy("id").agg(F.first("items").alias("items"))


def alike(x: bytes, y: bytes, percent: int) -> bool:
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _close_pairs(f: pd.DataFrame, rows: int, threshold: float, slack: float, label: np.ndarray, seen: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """For each member of a bucket (or of two of its blocks) the later ones of other labels whose estimate is near the threshold, likeliest first.

    Members are in order of n_shingles. Every pair of classes is looked at in its first common
    band only, so in one bucket. The caller may change labels between two members,
    and mark members as seen, of which no two are compared.
    """
    registers, n, own = _registers(f["sketch"].tolist()), f["n_shingles"].to_numpy(float), f["own"].to_numpy()
    inner = f["lo"].iloc[0] == f["hi"].iloc[0]
    band = int(np.flatnonzero(shingles.band_keys(registers[:1], rows)[0] == f["key"].iloc[0])[0])
    for i in range(len(f) - 1):
        j = np.arange(i + 1, int(np.searchsorted(n, n[i] / threshold, "right")))
        j = j[label[j] != label[i]]
        if seen is not None and seen[i]:
            j = j[~seen[j]]
        if not inner:
            j = j[own[j] != own[i]]
        if not len(j):
            continue
        same = registers[j] == registers[i]
        near = same.sum(1) >= (threshold - 1.5 * slack) * shingles.REGISTERS
        if band:
            near &= ~same[:, : band * rows].reshape(len(j), band, rows).all(2).any(1)
        j = j[near]
        if not len(j):
            continue
        estimate = shingles.likelihood_estimate((registers[j] > registers[i]).sum(1), (registers[j] < registers[i]).sum(1), n[j], np.full(len(j), n[i]))
        j = j[np.argsort(-estimate, kind="stable")][: int((estimate >= threshold - slack).sum())]
        if len(j):
            yield i, j


def _hopeful(f: pd.DataFrame, rows: int, threshold: float, slack: float) -> list[int]:
    """Ids of the members that have a close pair."""
    f = f.sort_values(["n_shingles", "id"])
    seen = np.zeros(len(f), bool)
    for i, j in _close_pairs(f, rows, threshold, slack, pd.factorize(f["grp"])[0], seen):
        seen[i] = True
        seen[j] = True
    return f["id"].to_numpy()[seen].tolist()


def _bucket_links(f: pd.DataFrame, rows: int, percent: int, slack: float) -> list[tuple[int, int]]:
    """Links between different groups that full sets confirm, at most one less than the members."""
    f = f.sort_values(["n_shingles", "id"])
    ids, items, label = f["id"].tolist(), f["items"].tolist(), pd.factorize(f["grp"])[0]
    out = []
    for i, close in _close_pairs(f, rows, percent / 100, slack, label):
        for k in close.tolist():
            if label[k] != label[i] and alike(items[i], items[k], percent):
                label[label == label[k]] = label[i]
                out.append((min(ids[i], ids[k]), max(ids[i], ids[k])))
    return out


def _by_bucket(frames: Iterator[pd.DataFrame], bucket: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of each bucket of a sorted partition."""
    held: list[pd.DataFrame] = []
    last: tuple | None = None
    for f in frames:
        names = f[bucket].to_numpy()
        starts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(1)) + 1).tolist(), len(f)]
        for a, b in zip(starts, starts[1:], strict=False):
            if a == b:
                continue
            if held and tuple(names[a]) != last:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(f.iloc[a:b])
            last = tuple(names[a])
    if held:
        yield pd.concat(held, ignore_index=True)


def cross_links(docs: DataFrame, members: DataFrame, classes: DataFrame, known: DataFrame, rows: int, percent: int, slack: float, tables: Tables) -> DataFrame:
    """Links a, b between different groups that share a bucket, confirmed on full sets.

    members: key, id and grp. A bucket above BLOCK members or BLOCK_SHINGLES shingles is cut into
    blocks by id; every two blocks meet in a task of their own, so all its pairs are looked at.
    Blocks meet by sketches alone first; full sets go only where one of their pairs is close.
    """
    bucket, threshold = ["key", "lo", "hi"], percent / 100
    d = members.join(classes.select("id", "n_shingles"), "id")
    size = d.groupBy("key").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    d = d.join(_if_small(tables.cut(size, "sizes")), "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    d = d.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "grp")
    d = tables.cut(d.join(classes.select("id", "n_shingles", "sketch"), "id"), "blocks")

    def hopeful(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _by_bucket(frames, bucket):
            yield f[[*bucket, "id"]][f["id"].isin(_hopeful(f, rows, threshold, slack))]

    def links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _by_bucket(frames, bucket):
            yield pd.DataFrame(_bucket_links(f, rows, percent, slack), columns=["a", "b"]).astype("int64")

    # by the number of members, not by their bytes: sketches are small and their comparisons many
    tasks = max(2 * d.sparkSession.sparkContext.defaultParallelism, -(-d.count() // MEMBERS_PER_TASK))
    dealt = lambda x: x.repartition(tasks, *bucket).sortWithinPartitions(*bucket)
    close = tables.cut(dealt(d).mapInPandas(hopeful, "key bigint, lo int, hi int, id bigint"), "close")
    sets = shingle_sets(docs, close.select("id"), known, tables)
    full = d.join(_if_small(close), [*bucket, "id"], "left_semi").join(sets, "id")
    return dealt(full).mapInPandas(links, "a bigint, b bigint")


def _with_class(feats: DataFrame, classes: DataFrame) -> DataFrame:
    """feats with the columns of their class (signature, copies, ...), if any; copies of one text need not meet in a task."""
    if classes.count() <= BROADCAST_ROWS:
        return feats.join(F.broadcast(classes.drop("copies")), "signature", "left")
    hot = F.broadcast(classes.where(F.col("copies") > HOT_COPIES).drop("copies"))
    rest = feats.join(hot.select("signature"), "signature", "left_anti").join(classes.where(F.col("copies") <= HOT_COPIES).drop("copies"), "signature", "left")
    return feats.join(hot, "signature").unionByName(rest)


def near_duplicates(docs: DataFrame, percent: int = 80, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, representative and the carried columns of every document.

    representative marks what is kept but for other texts of the same id in its group.
    slack: a pair at the threshold has an estimate this far below it once in ten million times.
    """
    threshold = percent / 100
    least = int(np.floor(1 / (1 - threshold) - 1e-9)) if percent < 100 else 2**31 - 1
    slack = 5.2 * float(np.sqrt(threshold * (1 - threshold) / shingles.REGISTERS))
    tables = Tables(docs.sparkSession, "neardup")
    feats = tables.cut(features(docs, least, carry), "features")
    of_text = feats.where("n_shingles > 0 and doc_id is not null").groupBy("signature").agg(
        F.min(F.struct("doc_id", "text_key")).alias("one"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")
    )
    known = tables.cut(of_text.select(F.monotonically_increasing_id().alias("id"), "signature", "one.doc_id", "one.text_key", "copies", "n_shingles", "sketch"), "classes")
    classes = known.where("sketch is not null").select("id", "n_shingles", "sketch")
    keyed = tables.cut(bands(classes, rows_per_band(threshold)), "bands")
    centres = keyed.groupBy("key").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    shared = tables.cut(keyed.join(centres, "key"), "buckets")
    tables.drop("bands")
    pairs = tables.cut(shared.where("a <> id").select("a", F.col("id").alias("b")).distinct(), "pairs")
    near = estimated(pairs, classes, tables).where(F.col("estimate") >= threshold - slack)
    best = tables.cut(near.groupBy("b").agg(F.max(F.struct("estimate", "a")).alias("x")).select(F.col("x.a").alias("a"), "b"), "best")
    links = tables.cut(confirmed(docs, best, known, percent, tables), "linked")
    first = tables.cut(components(links, tables), "groups")

    grouped = tables.cut(shared.join(first, "id", "left").select("key", "id", F.coalesce("component", "id").alias("grp")), "grouped")
    tables.drop("buckets", "pairs", "best")
    mixed = grouped.groupBy("key").agg(F.min("grp").alias("g0"), F.max("grp").alias("g1")).where("g0 <> g1").select("key")
    members = tables.cut(grouped.join(mixed, "key", "left_semi"), "members")
    more = tables.cut(cross_links(docs, members, classes, known, rows_per_band(threshold), percent, slack, tables), "more")
    final = components(links.unionByName(more), tables)

    named = known.join(final, "id", "left").select("id", "signature", "copies", "doc_id", F.coalesce("component", "id").alias("component"))
    heads = named.groupBy("component").agg(F.min(F.struct("doc_id", "id")).alias("head"))
    verdicts = tables.cut(named.join(heads, "component").select("signature", "copies", F.col("head.doc_id").alias("component_id"), (F.col("id") == F.col("head.id")).alias("representative")), "verdicts")
    tables.drop("blocks", "close", "members", "grouped", "classes")
    out = _with_class(feats.select("doc_id", "n_shingles", "signature", *carry), verdicts)
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    out = out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(alone, True).otherwise(F.col("representative")).alias("head"), *carry)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), (kept & F.col("head")).alias("representative"), *carry)
