"""Document fingerprints: one-permutation MinHash with optimal densification and packed bits (op1).

Every five-word shingle is hashed once. The hash's top byte names one of 256 bins; a bin keeps
its least hash. An empty bin borrows from the first filled bin in a random order of its own
(twelve independent probes, then the filled bin of least joint hash), so equal bins stay as
likely as the similarity. The low four bits of each bin are packed, sixteen bins to a bigint.
Two fingerprints agree by chance in 1/16 of their bins, which likeness() corrects for.

Edge cases: a null text counts as empty; without words the fingerprint is null, written as an
empty string, and likeness is 1 for two such texts and 0 for one; texts of one to four words
have one shingle. Equal texts have equal fingerprints. Rows of one id follow in text order; a
null id comes first; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWEST, range_of, range_starts, shingle_hashes, text_of, words_of

BINS, BITS, PROBES = 256, 4, 12
#: Sorts last in its bin and marks it as empty.
LOW = (1 << 56) - 1
EMPTY = [((b << 56) | LOW) - (1 << 64 if b >= 128 else 0) for b in range(BINS)]


def with_fingerprint(df: DataFrame, text: str, into: str) -> DataFrame:
    """df with the packed fingerprint of a text column, an array of 16 bigints; null without words.

    The steps are columns of their own, each used more than once by the next, so that none is
    computed anew for every element.
    """
    keep = [*df.columns, into]
    filled = lambda x: x.bitwiseAND(LOW) != LOW
    d = df.withColumn("__w", words_of(F.col(text)))
    d = d.withColumn("__wh", F.transform("__w", lambda x: F.xxhash64(x)))
    d = d.withColumn("__h", shingle_hashes(F.col("__wh")))
    d = d.withColumn("__s", F.when(F.size("__h") > 0, F.sort_array(F.concat(F.col("__h"), F.array(*[F.lit(x) for x in EMPTY])))))
    d = d.withColumn("__b", F.filter("__s", lambda x, i: (i == 0) | (F.shiftrightunsigned(x, 56) != F.shiftrightunsigned(F.get("__s", i - 1), 56))))
    d = d.withColumn("__f", F.filter(F.transform("__b", lambda x, i: F.when(filled(x), i)), lambda i: i.isNotNull()))
    probes = F.array(*[F.lit(t) for t in range(PROBES)])

    def borrowed(j: Column) -> Column:
        by_probe = F.get(F.filter(F.transform(probes, lambda t: F.get("__b", F.xxhash64(j, t).bitwiseAND(BINS - 1).cast("int"))), filled), F.lit(0))
        by_hash = F.array_min(F.transform("__f", lambda p: F.xxhash64(p, j).bitwiseAND(-BINS).bitwiseOR(p.cast("bigint")))).bitwiseAND(BINS - 1)
        return F.coalesce(by_probe, F.get("__b", by_hash.cast("int")))

    d = d.withColumn("__v", F.when(F.size("__f") == BINS, F.col("__b")).otherwise(F.transform("__b", lambda x, j: F.when(filled(x), x).otherwise(borrowed(j)))))
    per = 64 // BITS
    pack = lambda c: F.aggregate(F.slice("__v", c * per + 1, per), F.lit(0).cast("bigint"), lambda s, x: F.shiftleft(s, BITS).bitwiseOR(x.bitwiseAND((1 << BITS) - 1)))
    packed = F.transform(F.array(*[F.lit(c) for c in range(BINS // per)]), pack)
    return d.withColumn(into, F.when(F.col("__v").isNotNull(), packed)).select(keep)


def hex_of(fingerprint: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity of two fingerprints, from 0 to 1."""

    def unequal(x: Column) -> Column:
        for shift in (2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        return F.bit_count(x.bitwiseAND(0x1111111111111111))

    differ = F.aggregate(F.zip_with(a, b, lambda x, y: unequal(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    chance = 1 / (1 << BITS)
    near = F.greatest(F.lit(0.0), (1 - differ / BINS - chance) / (1 - chance))
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(near)


def with_next(df: DataFrame, key: str, names: list[str], tie: str) -> DataFrame:
    """df with next_<name>, the values of the next row by ascending key; the first row follows the last.

    Rows are dealt out by ranges of the key. A row that starts a range is also sent, as a mark, to
    the end of the range before, so no range needs another one and none holds all rows.
    """
    starts, low = range_starts(df, key)
    if low is None:
        return df.withColumns({f"next_{c}": F.col(c) for c in names})
    k = F.coalesce(F.col(key), F.lit(LOWEST))
    d = df.withColumn("__k", k).withColumn("__r", range_of(k, starts))
    first = F.get(F.from_json(F.lit(str(starts)), "array<bigint>"), F.col("__r")) == F.col("__k")
    before = F.pmod(F.col("__r") - 1, F.lit(len(starts)))
    place = lambda r, end: F.struct(r.cast("int").alias("r"), F.lit(end).alias("end"))
    d = d.withColumn("__p", F.explode(F.when(first, F.array(place(F.col("__r"), False), place(before, True))).otherwise(F.array(place(F.col("__r"), False)))))
    w = W.partitionBy("__p.r").orderBy("__p.end", "__k", tie)
    d = d.withColumns({f"next_{c}": F.lead(c).over(w) for c in names})
    return d.where("not __p.end").select(*df.columns, *[f"next_{c}" for c in names])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text and the packed fingerprint of every whole text."""
    return with_fingerprint(docs.select("doc_id", text_of().alias("text")), "text", "fingerprint")


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half comes from the next document."""
    d = with_next(fingerprints(docs), "doc_id", ["text", "fingerprint"], "text")
    half = F.floor(F.length("text") / 2).cast("int")
    d = d.withColumn("edited", F.concat(F.left("text", F.length("text") - half), F.left("next_text", half)))
    d = d.select("doc_id", F.length("text").cast("long").alias("n_chars"), "edited", "fingerprint", "next_fingerprint")
    return with_fingerprint(d, "edited", "edited_fingerprint")
