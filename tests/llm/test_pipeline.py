"""The pipeline's stages against plain versions of what each must do to its own input."""

import hashlib
import re

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from decispark.llm import bpe, mixing, quality, secrets

from .test_operators import WORD, components_of


def test_stages_take_effect(spark, documents, tmp_path):
    docs = documents.withColumns({"target": F.lit("own"), "copies": F.lit(-1), "copy": F.lit("c"), "kept": F.lit(2)})
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, seen[-1], "").write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
    assert [d.columns for d in seen[1:5]] == [docs.columns] * 4
    texts = [{r["doc_id"]: r["text"] for r in d.collect()} for d in seen[:5]]

    kept = {r["doc_id"] for r in quality.quality_rules(docs, least_words=3).where("kept").collect()}
    assert set(texts[1]) == kept and seen[1].count() == len(kept)

    groups = components_of({i: t or "" for i, t in texts[1].items()}, 80)
    assert set(texts[2]) == {i for i, (_, g) in groups.items() if g == i}

    spans = {r["doc_id"]: r["spans"] for r in secrets.scan(seen[2]).collect()}
    assert set(texts[3]) == set(texts[2])
    for i, t in texts[3].items():
        assert t == texts[2][i] if not spans[i] else len(re.findall(r"\[SECRET\]", t)) >= 1
    assert seen[3].where(F.col("n_chars") != F.length("text")).count() == 0

    copies = {r["doc_id"]: r["n"] for r in seen[4].groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert seen[4].select("size", "ids", "target", "copies", "copy", "kept").distinct().collect() == [("x", 1, "own", -1, "c", 2)]
    assert max(copies.values()) <= 3 and all(texts[4][i] == texts[3][i] for i in copies)
    assert copies == {r["doc_id"]: r["copies"] for r in mixing.mix(seen[3].select("doc_id", "text", "source")).where("copies > 0").collect()}
    words = lambda d: sum(len(WORD.findall(r["text"] or "")) for r in d.collect())
    assert abs(words(seen[4]) / words(seen[3]) - 1) < 0.1

    path = public_tokenizers.path(corpus_pipeline.RANKS)
    decoded = {r["doc_id"]: bytes(r["decoded"]).decode() for r in bpe.decode(seen[5].select("doc_id", "ids"), path).collect()}
    assert decoded == {i: texts[4][i] or "" for i in copies}
    assert seen[5].count() == seen[4].count()


def plain_copies(docs):
    """How often the mix takes each document: targets filled level by level, then hashes up to each of three nested thresholds, row by row."""
    size = {i: len(WORD.findall(t or "")) for i, t, _ in docs}
    h = {i: int(hashlib.sha256(str("null" if i is None else i).encode()).hexdigest()[:12], 16) for i, _, _ in docs}
    sources = sorted({s for _, _, s in docs}, key=lambda s: (s is None, s))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(sources)}
    own = {s: [i for i, _, x in docs if x == s] for s in sources}
    total = {s: sum(size[i] for i in own[s]) for s in sources}
    target, open_, left = {}, set(sources), float(sum(size.values()))
    while full := [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 3 * total[s]]:
        target |= {s: 3.0 * total[s] for s in full}
        open_ -= set(full)
        left -= sum(target[s] for s in full)
        if not open_:
            break
    target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    copies = {}
    for s in sources:
        whole = int(target[s] // total[s]) if total[s] else 0
        rest = int(target[s] - whole * total[s])
        copies |= {i: whole for i in own[s]}
        passed = set()
        for _ in range(3):
            fits = sorted((i for i in own[s] if i not in passed and size[i] <= rest), key=h.get)
            for i in fits:
                if size[i] > rest:
                    break
                rest -= size[i]
                passed.add(i)
        for i in passed:
            copies[i] = min(whole + 1, 3)
    return {i: n for i, n in copies.items() if n}


def test_mixing_stage_against_a_plain_mix(spark, documents):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in documents.collect()]
    got = corpus_pipeline.mixing_stage(spark, documents, "").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == plain_copies(docs)


def test_rows_without_id_and_rows_of_one_id(spark):
    words = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    rows = [(None, "too short"), (None, words("n", 80)), (1, words("a", 80)), (1, "short too"), (1, words("b", 80)), (2, words("a", 80) + " end"), (3, words("c", 80)), (3, words("c", 80)), (None, words("c", 80))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    key = lambda d: sorted((str(r["doc_id"]), r["text"]) for r in d.collect())
    first = corpus_pipeline.quality_stage(spark, docs, "")
    assert key(first) == sorted((str(i), t) for i, t in rows if "short" not in t)
    assert key(corpus_pipeline.near_dedup_stage(spark, first, "")) == sorted([("None", words("n", 80)), ("1", words("a", 80)), ("1", words("b", 80)), ("3", words("c", 80)), ("None", words("c", 80))])


def test_pipeline_on_nothing(spark, empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
