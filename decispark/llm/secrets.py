"""Secret scan: fixed patterns, and long tokens that look random to two Markov models (op7).

Two first-order character models, of random strings and of ordinary identifiers, are trained
from labelled samples; a long token with letters, and digits or both cases, is a secret where the
mean log-likelihood ratio per character exceeds a threshold. Of a longer run, such as a path that
ends in a key, the sub-runs are where the summed ratio rises far enough, widened to the parts between
"/", "=", "_" and "-" that they mostly cover. Pattern spans always stay; a token that overlaps one
is not reported again.

Edge cases: a null text counts as empty; empty texts and tables give no spans; repeated rows
are scanned alike; further columns pass through. Letters match in ASCII only.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: Every match of ASSIGN holds one of these in lower case.
HINTS = ("passw", "secret", "token", "apikey", "api_key")
LONG = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Parts of the ordinary sample identifiers.
PARTS = """account action active address alpha amount array async audio batch block buffer button bytes cache callback
channel check client cluster column commit config content context control count create current cursor data database date
default delete device document domain driver element encode engine entity error event export factory feature field file
filter format frame function global group handler header image import index input instance iterator kernel label layer
length level library limit listener local machine manager memory merge message method model module name network node
number object offset option order output package page parser partition path pattern payload pixel player policy prefix
process product project property query queue random range reader record region render request resource response result
route schema scope screen search sequence server service session shader signal socket source stack state static status
storage stream string system table target task template text thread time tracker transfer type update user utility value
vector version video view widget window worker writer""".split()
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def labelled_samples(n: int = 4000, seed: int = 7) -> list[tuple[str, int]]:
    """n random strings (1) and n ordinary identifiers (0): the bounded training sample."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        letters = ("0123456789abcdef", ALPHABET[:62], ALPHABET[:64], ALPHABET[26:62])[i % 4]
        out.append(("".join(r.choice(letters) for _ in range(r.randint(20, 44))), 1))
        words = [r.choice(PARTS) for _ in range(r.randint(2, 5))]
        number = str(r.choice((1, 2, 3, 10, 64, 128, 256, 2019, 2024))) if r.random() < 0.6 else ""
        style = i % 5
        if style == 0:
            name = "".join(w.title() for w in words) + number
        elif style == 1:
            name = words[0] + "".join(w.title() for w in words[1:]) + number
        else:
            name = ("_", "-", "/")[style - 2].join([*words, *([number] if number else [])])
        out.append((name.upper() if style == 2 and i % 3 == 0 else name, 0))
    return out


def train(samples: list[tuple[str, int]], smoothing: float = 0.5) -> dict[str, float]:
    """Log-likelihood ratio of each pair of neighbouring characters, random against ordinary."""
    counts = [{}, {}]
    totals = [{}, {}]
    for text, label in samples:
        for a, b in zip("^" + text, text, strict=False):
            counts[label][a + b] = counts[label].get(a + b, 0) + 1
            totals[label][a] = totals[label].get(a, 0) + 1
    p = lambda k, a, b: (counts[k].get(a + b, 0) + smoothing) / (totals[k].get(a, 0) + smoothing * len(ALPHABET))
    return {a + b: math.log(p(1, a, b) / p(0, a, b)) for a in "^" + ALPHABET for b in ALPHABET}


@cache
def model(n: int = 4000, seed: int = 7) -> dict[str, float]:
    return train(labelled_samples(n, seed))


def score(token: str, ratios: dict[str, float]) -> float:
    """Mean log-likelihood ratio per character."""
    return sum(ratios[a + b] for a, b in zip("^" + token, token, strict=False)) / len(token)


#: Characters of a random string at least, and of the core by which one in a longer run is found; the fall of the summed ratio that ends a core; the sum that it needs.
LEAST, CORE, FALL, EVIDENCE = 20, 12, 12.0, 6.0
PART = re.compile(r"[^/=_-]+")


def mixed(token: str) -> bool:
    """Letters, and digits or both cases: a long word of one case is a word."""
    return any(c.isalpha() for c in token) and (any(c.isdigit() for c in token) or token.lower() != token != token.upper())


def random_runs(token: str, ratios: dict[str, float], threshold: float) -> list[tuple[int, int]]:
    """(start, end) of the whole token where it looks random, else of its random sub-runs, each widened to the parts it mostly covers."""
    if len(token) < LEAST or not mixed(token):
        return []
    if score(token, ratios) > threshold:
        return [(0, len(token))]
    over = [ratios[a + b] - threshold for a, b in zip("^" + token, token, strict=False)]
    out, i, n = [], 0, len(token)
    while i < n:
        total, best, end, j = 0.0, 0.0, i, i
        while j < n:
            total += over[j]
            j += 1
            if total > best:
                best, end = total, j
            elif total <= 0 or total < best - FALL:
                break
        if end - i >= CORE and best > EVIDENCE and mixed(token[i:end]):
            out.append((i, end))
        i = max(end, i + 1)
    parts = [m.span() for m in PART.finditer(token)] if out else []
    wide: list[tuple[int, int]] = []
    for a, b in out:
        own = [(x, y) for x, y in parts if 2 * (min(b, y) - max(a, x)) >= y - x]
        a, b = min([a, *[x for x, _ in own]]), max([b, *[y for _, y in own]])
        if wide and a <= wide[-1][1]:
            a, b = wide[-1][0], max(b, wide.pop()[1])
        wide.append((a, b))
    return [(a, b) for a, b in wide if b - a >= LEAST]


def find(text: str, ratios: dict[str, float], threshold: float) -> list[tuple[int, int, str]]:
    """(start, index of kind, end), sorted."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    more = []
    for m in LONG.finditer(text):
        token, at = m[0], m.start()
        own = [(at + x.start(), k, at + x.end()) for k, p in ((1, ACCESS), (2, HEX)) for x in p.finditer(token)]
        out += own
        # What lies beside a pattern's match is judged by itself.
        last = 0
        for a, b in [*sorted((a - at, b - at) for a, _, b in own), (len(token), len(token))]:
            more += [(at + last + x, 3, at + last + y) for x, y in random_runs(token[last:a], ratios, threshold)]
            last = max(last, b)
    taken = sorted(out)
    out += [x for x in more if not any(a < x[2] and x[0] < b for a, _, b in taken)]
    return sorted(out)


def scan(docs: DataFrame, text: str = "text", threshold: float = 0.5, sample: int = 4000, seed: int = 7) -> DataFrame:
    """docs without its text column and with spans, an array of (kind, start, end) in code points, end exclusive."""
    return _run(docs, text, threshold, sample, seed, redacted=False)


def redact(docs: DataFrame, text: str = "text", threshold: float = 0.5, mark: str = "[SECRET]", sample: int = 4000, seed: int = 7) -> DataFrame:
    """docs with every secret in its text replaced by mark; of overlapping spans the union is replaced once."""
    return _run(docs, text, threshold, sample, seed, redacted=True, mark=mark).select(docs.columns)


def _run(docs: DataFrame, text: str, threshold: float, sample: int, seed: int, redacted: bool, mark: str = "") -> DataFrame:
    rest = [c for c in docs.columns if c not in (text, "spans")] if not redacted else [c for c in docs.columns if c != text]
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def clean(value: str | None, spans: list[tuple[int, int, str]]) -> str | None:
        if not spans:
            return value
        out, at = [], 0
        for start, _, end in spans:
            if start >= at:
                out += [value[at:start], mark]
            at = max(at, end)
        return "".join([*out, value[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = model(sample, seed)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            found = [find(t, ratios, threshold) if t else [] for t in texts]
            if redacted:
                last = pa.array([clean(t, s) for t, s in zip(texts, found, strict=True)], pa.string())
            else:
                last = pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in s] for s in found], spans_type)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], last], names=[*rest, text if redacted else "spans"])

    last = T.StructField(text, T.StringType()) if redacted else T.StructField("spans", T.ArrayType(SPAN))
    return small_batches(docs).select(F.col(text).cast("string").alias(text), *rest).mapInArrow(run, T.StructType([*[docs.schema[c] for c in rest], last]))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame, base: tuple[str, ...] = KINDS[:3]) -> DataFrame:
    """doc_id, the number of spans of each base kind, base_sha256 and spans as text."""
    own = F.filter("spans", lambda s: s["kind"].isin(*base))
    of_kind = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    return scanned.select(
        "doc_id",
        *[F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(joined(own), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
