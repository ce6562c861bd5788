"""Decontamination, importance resampling and whitening against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from decispark.llm import decontamination, importance, whitening
from decispark.llm.common import Tables

from .conftest import SF

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# decontamination


def plain_hits(text, items, n=10):
    """Words hit and items found, by comparing every run with every window."""
    w, hit, found = words(text), set(), set()
    for item, other in items:
        o = words(other)
        k = min(n, len(o))
        for a in range(len(o) - k + 1) if k else ():
            for i in range(len(w) - k + 1):
                if w[i : i + k] == o[a : a + k]:
                    hit |= set(range(i, i + k))
                    found |= {str(item)} if item is not None else set()
    return len(w), len(hit), sorted(found)


def passages():
    draw = random.Random(3)
    word = lambda: draw.choice("alpha beta gamma delta ünder 7 x9 漢字 omega".split())
    run = lambda n: [word() for _ in range(n)]
    texts = [run(n) for n in (25, 12, 10, 9, 3, 1, 40)]
    items = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(20, None), (21, ""), (22, " ,;!"), (23, " ".join(texts[0])), (None, " ".join(texts[6])), (4, "another Text"), (0, " ".join(texts[0]))]
    docs = [None, "", " .. ", "Another,TEXT", *[" ".join(run(n)) for n in (5, 30, 200)]]
    for t in texts:
        docs += [" ".join(run(8) + t + run(8)), " ".join(t).upper() + "!", "-".join(run(4) + t[:11] + run(2) + t[3:] + t)]
    docs += docs[-3:]
    return [(i, t, "s") for i, t in enumerate(docs)], items


@pytest.mark.parametrize("block_words, piece_words", [(10**6, 10_000), (40, 4)])
def test_every_window_is_found_and_nothing_else(spark, block_words, piece_words):
    docs, items = passages()
    d = spark.createDataFrame(docs, "doc_id long, text string, items string")
    b = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.scan(d, b, block_words=block_words, piece_words=piece_words)
    got = {r["doc_id"]: r for r in found.collect()}
    assert len(got) == len(docs)
    for i, text, _ in docs:
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == plain_hits(text, items), text
    r = {x["doc_id"]: x for x in decontamination.digest(found).collect()}[9]
    assert r["items_sha256"] == hashlib.sha256(",".join(got[9]["items"]).encode()).hexdigest() and r["contaminated"] == (r["n_hit"] > 0)


def test_windows_of_the_table(spark, documents, texts):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r["doc_id"]: r for r in decontamination.scan(documents, spark.createDataFrame(items, "item_id long, text string")).collect()}
    by_window = {tuple(w[i : i + 10]): name for name, t in items for w in [words(t)] for i in range(len(w) - 9)}
    hits = 0
    for i, text in texts.items():
        w = words(text)
        at = [k for k in range(len(w) - 9) if tuple(w[k : k + 10]) in by_window]
        assert got[i]["n_hit"] == len({k + j for k in at for j in range(10)}) and got[i]["n_words"] == len(w)
        hits += bool(at)
    assert hits and got[10_001]["n_words"] == 0


def test_spans_and_documents_are_removed(spark):
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"Début: A {item.upper()}, b. {item} end", 5), (2, "one two three four five six seven eight nine", 6), (3, None, 7), (4, item, 8)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_hit long")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontamination.decontaminated(d, b).collect()) == [2, 3]
    assert sorted(r["doc_id"] for r in decontamination.decontaminated(d, b, most_share=0.9).collect()) == [1, 2, 3]
    clean = {r["doc_id"]: r for r in decontamination.decontaminated(d, b, remove="spans").collect()}
    assert {i: (r["text"], r["n_hit"]) for i, r in clean.items()} == {1: ("Début: A , b.  end", 5), 2: (rows[1][1], 6), 3: (None, 7), 4: ("", 8)}
    assert decontamination.decontaminated(d.limit(0), b).count() == 0
    assert decontamination.decontaminated(d, b.limit(0)).count() == 4


def test_windows_of_equal_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(decontamination.Windows, "hashes", staticmethod(lambda words, starts, length: np.zeros(len(starts), np.uint64)))
    pieces = [("a", [f"w{i}" for i in range(10)]), ("b", [f"w{i}" for i in range(3, 13)]), ("c", [f"w{i}" for i in range(10)])]
    w = decontamination.Windows(pieces, 10)
    hit, first, items = decontamination._found([b"x w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 y", b"w0 w1 w2 w3 w4 w5 w6 w7 w8 w9"], w)
    assert items == [["b"], ["a", "c"]] and hit[first[0] : first[1] - 1].tolist() == [False] + [True] * 10 + [False]


# importance resampling


def plain_draw(docs, target, share=(10, 100), least=20, longest=1, buckets=10_000):
    def runs(text):
        w = words(text)
        return w, [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in docs for f in runs(x)[1]), Counter(bucket(f) for x in target for f in runs(x)[1])
    ss, tt = sum(s.values()), sum(t.values())
    out = {}
    for i, text in docs:
        w, fs = runs(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b in map(bucket, fs))
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        out[i] = [len(w), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    enters = sorted((i for i, r in out.items() if r[0] >= least), key=lambda i: (-out[i][3], i))
    for k, i in enumerate(enters[: share[0] * len(enters) // share[1]]):
        out[i][4] = k + 1
    return out


@pytest.mark.parametrize("longest, share", [(1, (10, 100)), (2, (1, 2)), (1, (1, 1)), (1, (0, 1))])
def test_draw_matches_a_plain_one(spark, documents, texts, longest, share):
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = importance.resample(documents, target, share, longest=longest, carry=("size",)).collect()
    expected = plain_draw(sorted(texts.items()), [r["text"] for r in target.collect()], share, longest=longest)
    assert {r["doc_id"]: [r["n_words"], r["n_features"], r["weight"], r["score"], r["rank"]] for r in got} == expected
    assert {r["size"] for r in got} == {"x"} and len(got) == len(texts)


def test_ranks_by_histogram(spark, monkeypatch):
    monkeypatch.setattr(importance, "RANGE_SCORES", 3)
    draw = random.Random(5)
    rows = [(i, draw.choice([0, 1, 2, 5, -7, 10**9, -(10**12)]) + (draw.randrange(40) if i % 2 else 0), i % 3 > 0) for i in range(900)]
    tables = Tables(spark, "test")
    scored = tables.cut(spark.createDataFrame(rows, "id long, score long, enters boolean"), "scored")
    for share in ((1, 3), (1, 600), (599, 600), (1, 1), (1, 601)):
        got = {r["id"]: r["rank"] for r in importance.ranked(scored, "score", "id", F.col("enters"), *share, tables).collect()}
        order = sorted((r for r in rows if r[2]), key=lambda r: (-r[1], r[0]))[: share[0] * 600 // share[1]]
        assert {i: k for i, k in got.items() if k} == {r[0]: k + 1 for k, r in enumerate(order)} and len(got) == len(rows)


def test_draw_of_awkward_rows(spark):
    text = "word " * 25
    rows = [(None, text), (None, text), (1, text), (1, text), (2, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([(1, None)], "item_id long, text string")
    got = importance.resample(docs, target, (1, 1)).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4] and len(got) == 6
    assert importance.resample(docs.limit(0), target).count() == 0


# whitening


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string")


def test_whitening_matches_an_eigen_decomposition(spark):
    draw = np.random.default_rng(2)
    base = draw.normal(size=(300, 12)) @ np.diag(np.geomspace(30, 0.05, 12)) @ draw.normal(size=(12, 12))
    rows = [(i, v.tolist(), "c") for i, v in enumerate(base)] + [(1000 + i, base[7].tolist(), "c") for i in range(150)]
    rows += [(5000, None, "c"), (5001, [], "c"), (5002, [None] * 12, "c"), (5003, [float("nan")] + [0.0] * 11, "c"), (5004, [float("-inf")] + [0.0] * 11, "c"), (5005, [1.0, 2.0], "c"), (None, base[3].tolist(), "c")]
    got = whitening.whiten(vectors(spark, rows).repartition(7)).collect()
    x = {i: np.floor(256 * np.array(v)) for i, v, _ in rows if v and len(v) == 12 and None not in v and np.isfinite(v).all()}
    fit = np.unique(np.stack(list(x.values())), axis=0)
    n, mean = len(fit), fit.mean(0)
    e, v = np.linalg.eigh((fit - mean).T @ (fit - mean) / n)
    e, v = e[::-1], v[:, ::-1]
    sums = fit.sum(0)
    assert len(got) == 4 * len(x) and {r["n"] for r in got} == {n}
    for k in range(4):
        own = {r["vec_id"]: r for r in got if r["component"] == k + 1}
        exact = {i: float((y - mean) @ v[:, k] / np.sqrt(e[k])) for i, y in x.items()}
        sign = math.copysign(1, sum(own[i]["whitened"] * exact[i] for i in exact))
        assert max(abs(sign * own[i]["whitened"] - exact[i]) for i in exact) < 1e-8
        assert own[0]["explained"] == pytest.approx(e[k] / e.sum(), rel=1e-9)
        assert all(own[i]["deviation"] == Decimal(int(((n * y - sums) ** 2).sum())) for i, y in x.items())
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_jacobi_keeps_small_deviations():
    draw = np.random.default_rng(4)
    for dims, rows in ((1, 1), (2, 5), (5, 3), (8, 8), (33, 40)):
        a = draw.normal(size=(rows, dims)) * np.geomspace(1, 1e-7, dims)
        norms, v = whitening.jacobi(a)
        assert np.allclose(v.T @ v, np.eye(dims), atol=1e-13)
        assert np.allclose(norms[: min(rows, dims)], np.linalg.svd(a, compute_uv=False), rtol=1e-8, atol=1e-17)
        assert np.allclose(np.linalg.norm(a @ v, axis=0), norms, atol=1e-13)


def test_vectors_without_spread_and_large_ones(spark):
    one = whitening.whiten(vectors(spark, [(1, [1.0, 2.0], "c"), (2, [1.0, 2.0], "c")])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, None, None)] * 4
    flat = whitening.whiten(vectors(spark, [(i, [float(i), 1.0, -0.0], "c") for i in range(5)])).collect()
    assert {r["component"]: r["whitened"] is None for r in flat} == {1: False, 2: True, 3: True}
    wide = [(1, [1e15, 0.0], "c"), (2, [-1e15, 3.0], "c"), (3, [5.0, 1e14], "c")]
    fit = [[math.floor(256 * c) for c in v] for _, v, _ in wide]
    sums = [sum(c) for c in zip(*fit, strict=True)]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(vectors(spark, wide)).collect()}
    exact = {i + 1: sum((3 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for i, v in enumerate(fit)}
    assert got == {i: Decimal(e) if e < 2**95 else None for i, e in exact.items()}
    assert whitening.whiten(vectors(spark, [(1, None, "c")])).count() == 0
