"""Each operator against a plain brute-force version, with awkward rows and empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import combinations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from decispark.llm import bpe, fingerprints, html, licences, mixing, neardup, pii, quality, secrets, token_store
from decispark.llm.common import Tables

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return {r[0]: r for r in df.collect()}


def shingles(text, n=5, lower=True):
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    w = WORD.findall(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


# fingerprints


def test_edited_texts_and_fingerprints(documents, texts):
    d = fingerprints.edited(documents)
    got = rows(d.select("doc_id", "n_chars", "edited", fingerprints.hex_of(F.col("fingerprint")).alias("f"), fingerprints.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near"), fingerprints.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("next")))
    ids = sorted(texts)
    assert sorted(got) == ids
    errors = []
    for i, name in enumerate(ids):
        text, after = texts[name], texts[ids[(i + 1) % len(ids)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (got[name]["n_chars"], got[name]["edited"]) == (len(text), edited)
        own, other = shingles(text, lower=False), shingles(edited, lower=False)
        errors.append(abs(got[name]["near"] - jaccard(own, other)))
        errors.append(abs(got[name]["next"] - jaccard(own, shingles(after, lower=False))))
    assert max(errors) < 0.2 and sum(errors) / len(errors) < 0.03
    assert got[10_004]["f"] == got[10_005]["f"] != "" and got[10_001]["f"] == got[10_003]["f"] == ""
    by_text = {}
    for name in ids:
        assert by_text.setdefault(texts[name], got[name]["f"]) == got[name]["f"]


def test_next_follows_every_order_of_ids(spark):
    d = spark.createDataFrame([(i * i % 1009, f"t{i * i % 1009}") for i in range(900)], "doc_id long, text string").distinct()
    ids = sorted(r[0] for r in d.collect())
    got = rows(fingerprints.with_next(d.repartition(7), "doc_id", ["text"], "text"))
    assert {i: r["next_text"] for i, r in got.items()} == {i: f"t{ids[(k + 1) % len(ids)]}" for k, i in enumerate(ids)}


# mixing


def test_mix_comes_near_its_targets(documents, texts):
    got = rows(mixing.mix(documents))
    size = {i: len(WORD.findall(t)) for i, t in texts.items()}
    assert {i: r["size"] for i, r in got.items()} == size
    sources = {r["doc_id"]: r["source"] for r in documents.collect()}
    order = sorted({s for s in sources.values() if s is not None}) + [None]
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    total = Counter()
    for i, n in size.items():
        total[sources[i]] += n
    open_, left, target = set(order), sum(total.values()), {}
    while True:
        level = left / (sum(weight[s] for s in open_) or 1)
        full = {s for s in open_ if weight[s] * level > 3 * total[s]}
        if not full:
            break
        for s in full:
            target[s] = 3 * total[s]
            left -= target[s]
        open_ -= full
    target |= {s: weight[s] * level for s in open_}
    taken = Counter()
    for i, r in got.items():
        assert r["target"] == pytest.approx(target[sources[i]]) and r["copies"] <= 3
        taken[sources[i]] += r["copies"] * r["size"]
    for s in order:
        most = max(size[i] for i in size if sources[i] == s)
        assert abs(taken[s] - target[s]) <= max(1, most if 10 * most > total[s] else 0.05 * target[s])


# personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        total = sum(sum(map(int, str(int(c) * (1 + i % 2)))) for i, c in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, text) if passes(kind, m[0])]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]


def test_strict_personal_data_is_kept(spark, documents, texts):
    noisy = "x+1 (2) 3-44.55 a@b.c@d.e._@f.g 1.2.3 256.1.1.1.1 12-34--56 4 4 4 " * 3
    more = {20_000 + k: noisy[k : k + 60 + k] for k in range(40)} | {20_100: "0 " * 5000 + "1" * 30_000 + "a" * 30_000 + "@x" + ".y" * 5000}
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(list(more.items()), "doc_id long, text string"))
    got = rows(pii.digest(pii.find(docs)))
    for name, text in (texts | more).items():
        expected = base_spans(text)
        assert got[name]["base_sha256"] == hashlib.sha256(",".join(expected).encode()).hexdigest(), name
        assert set(expected) <= set(got[name]["spans"].split(","))
        assert [got[name][f"n_{k}"] for k in BASE] == [sum(e.startswith(k + ":") for e in expected) for k in BASE]


def test_em_tells_good_labelers_from_bad():
    counts = {"phone|for,none,for,for,for,for|4,3,3": 60, "phone|none,none,none,for,none,for|3,3,2": 30, "card|against,against,against,none,against,none|4,4,0": 80, "card|against,against,for,against,none,none|4,4,0": 20}
    posterior, odds = pii.expectation_maximisation(counts)
    assert odds["0=for"] > 1 > -1 > odds["0=against"]
    assert posterior["phone|for,none,for,for,for,for|4,3,3"] > 0.99 > 0.01 > posterior["card|against,against,against,none,against,none|4,4,0"]
    probability = pii.classifier(counts, posterior)
    assert probability("phone|none,none,none,for,none,for|3,3,2") > 0.9 > 0.1 > probability("card|against,against,for,against,none,none|4,4,0")


def test_added_spans_and_numbers_that_are_none(spark, documents, texts):
    planted = ["(017) 555-7713", "(415) 555-2671", "415-555-2672", "212.555.0188", "ann.lee (at) mail.example (dot) org", "219-09-9999"]
    plain = ["4736962573099581", "12-34-5678", "1234567", "3.1.4", "2024-11-28", "555-77", "v017-555-7713x", "10 000 000", "0.5-0.75", "978-3-16-148410-0", "order no 123-45-6789"]
    own = {30_000 + k: f"ordinary words here {x} and more of them" for k, x in enumerate(planted)}
    none = {31_000 + k: f"ordinary words here {x} and more of them" for k, x in enumerate(plain)}
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(list((own | none).items()), "doc_id long, text string"))
    got = rows(pii.digest(pii.find(docs)))
    for i, x in zip(own, planted, strict=True):
        assert got[i]["spans"].split(":")[1:] == ["20", str(20 + len(x))] and (got[i]["n_added"], got[i]["n_spans"]) == (1, 1), x
    assert {x: got[i]["n_added"] for i, x in zip(none, plain, strict=True)} == dict.fromkeys(plain, 0)
    assert all(got[i]["n_added"] == 0 for i in texts if i < 10_000)
    assert got[10_015]["spans"].split(",") == ["phone:11:25", "phone:36:48", "ssn:79:90"]


# near-duplicates


def components_of(texts, percent):
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("percent", [85, 80])
def test_components_equal_brute_force(spark, documents, texts, percent):
    base = [f"w{i * 7 % 101}x{i}" for i in range(120)]
    chain = {30_000 + k: " ".join(base[k : k + 80]) for k in range(25)}  # neighbours are alike, the ends are not
    many = {31_000 + k: " ".join(base[:100] + [f"end{k}"]) for k in range(150)}
    far = {32_000 + k: " ".join(base[:60] + [f"o{k}p{j}" for j in range(40)]) for k in range(40)}
    more = chain | many | far
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(list(more.items()), "doc_id long, text string"))
    got = rows(neardup.near_duplicates(docs, percent))
    expected = components_of(texts | more, percent)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == expected
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (700, 700)], "a long, b long")
    got = {r["id"]: r["component"] for r in neardup.components(links.repartition(5), Tables(spark, "test")).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_large_buckets_meet_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 7)
    base = [f"v{i}" for i in range(90)]
    texts = {k: " ".join(base[k % 5 :] + [f"own{k}"]) for k in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = rows(neardup.near_duplicates(docs, 85))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == components_of(texts, 85)


def test_rows_of_one_id_with_different_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows_ = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (3, b + " end"), (4, a), (None, a), (5, None), (5, "")]
    docs = spark.createDataFrame(rows_, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"], r["representative"]) for r in neardup.near_duplicates(docs, 85).collect()), key=str)
    assert got == sorted([(1, 56, 1, True, True), (1, 56, 1, True, True), (2, 57, 1, False, False), (3, 57, 1, False, False), (3, 57, 1, False, False), (4, 56, 1, False, False), (None, 56, None, True, True), (5, 0, 5, True, True), (5, 0, 5, True, True)], key=str)


def test_hot_classes_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(neardup, "HOT_COPIES", 20)
    texts = {k: "same words in each of these texts here" if k % 3 else f"own {k} " + "words of it " * 5 for k in range(100)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = rows(neardup.near_duplicates(docs, 85))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == components_of(texts, 85)


# quality rules


def test_counts_of_quality_rules(documents, texts):
    got = rows(quality.quality_rules(documents))
    for name, text in texts.items():
        w = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + k for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for k in range(5)}
        r = got[name]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r["kept"] and r["base_failed"])


def test_outliers_are_rejected_and_the_rest_is_kept(spark):
    good = [(i, " ".join(f"word{(i * 37 + j) % 997}" for j in range(50 + i % 200)), "en", "a") for i in range(300)]
    bad = [(1000 + i, " ".join(f"w{j}$$$" for j in range(80 + i)), "en", "a") for i in range(20)]
    got = rows(quality.quality_rules(spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string")))
    assert all(got[i]["kept"] for i, *_ in good) and not any(got[i]["kept"] for i, *_ in bad)


def test_groups_of_nearly_half_junk_lose_all_of_it(spark):
    rows_ = []
    for share in (5, 30, 40, 45):
        for i in range(600):
            bad = i % 100 < share
            words = [f"word{(i * 37 + j * 7) % 997}" + ("$#%" if bad and (i + j) % 5 else "") for j in range(50 + i % 200)]
            rows_.append((share * 1000 + i, " ".join(words), "en", f"symbols {share}", bad))
    for share in (5, 40):
        for i in range(600):
            bad = i % 100 < share
            lines = ["a few words"] * 20 if bad else [" ".join(f"w{(i * 31 + j * 7 + k) % 991}" for k in range(3)) for j in range(0, 20 * 3, 3)]
            rows_.append((100_000 + share * 1000 + i, "\n".join(lines), "en", f"lines {share}", bad))
    docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, bad boolean")
    got = rows(quality.quality_rules(docs))
    assert {i: r["kept"] for i, r in got.items()} == {r[0]: not r[4] for r in rows_}


@pytest.mark.parametrize("share", [0.05, 0.3, 0.4, 0.45])
@pytest.mark.parametrize("name, value", [("symbol_share", 0.9), ("log_word_length", 4.5)])
def test_a_statistic_alone_reaches_the_cut(spark, name, value, share):
    n = 1000
    plain = {"log_words": F.lit(5.0) + F.randn(1) * 0.8, "log_word_length": F.lit(1.6) + F.randn(2) * 0.08, "symbol_share": F.abs(F.randn(3)) * 0.02, "dup_line_share": F.lit(0.0), "repeat_share": F.lit(0.0)}
    bad = F.col("id") < int(n * share)
    stats = spark.range(n).select("id", F.lit("g").alias("g"), *[(F.when(bad, F.lit(value)).otherwise(c) if k == name else c).alias(k) for k, c in plain.items()])
    got = {r["id"]: r["d2"] > quality.CHI2_CUT for r in quality.robust_outliers(stats, Tables(spark, "test")).collect()}
    assert got == {i: i < int(n * share) for i in range(n)}


def plain_rank(v, p):
    import numpy as np

    return np.sort(v)[max(math.ceil(p * len(v)), 1) - 1]


def plain_d2(x, m, c):
    import numpy as np

    return ((x - m) * np.linalg.solve(c, (x - m).T).T).sum(1)


def plain_estimate(x):
    """Centre and covariance of one group by numpy: three starts, three concentration steps, least determinant."""
    import numpy as np

    floors = np.array(list(quality.FEATURES.values()))
    moments = lambda y: (y.mean(0), np.cov(y.T, bias=True) + np.diag(floors))
    centre = np.array([plain_rank(c, 0.5) for c in x.T])
    spread = np.sqrt((1.4826 * np.array([plain_rank(c, 0.5) for c in abs(x - centre).T])) ** 2 + floors)
    found = []
    for m, c in [(centre, np.diag(spread**2)), moments(x), moments(centre + spread * np.tanh((x - centre) / spread))]:
        for _ in range(3):
            d2 = plain_d2(x, m, c)
            m, c = moments(x[d2 <= plain_rank(d2, 0.5) * (1 + 1e-12)])
        found.append((m, c))
    return min(found, key=lambda f: np.linalg.slogdet(f[1])[1])


def plain_scale(ratio):
    return max(1.0, min(quality.CONSISTENCY, ratio))


def plain_distances(x):
    """Distances from the estimate of the rows' one group, rescaled."""
    d2 = plain_d2(x, *plain_estimate(x))
    return d2 / plain_scale(plain_rank(d2, 0.5) / quality.CHI2_MEDIAN)


@pytest.mark.parametrize("bound", [10_000, 3])
def test_groups_lean_on_their_language_and_the_table(spark, monkeypatch, bound):
    """By numpy, for groups of 1 to 400 rows; also where groups are too many for one broadcast."""
    import numpy as np

    monkeypatch.setattr(quality, "BROADCAST_GROUPS", bound)
    r, sizes = np.random.default_rng(5), {("en", "a"): 400, ("en", "b"): 60, ("en", "c"): 1, ("de", "a"): 90, ("de", "b"): 110, ("fr", "c"): 2}
    keys = [k for k, n in sizes.items() for _ in range(n)]
    x = r.normal(0, 1, (len(keys), 5)) * [0.8, 0.1, 0.05, 0.1, 0.1] + [[len(s) + ord(s) % 3, 1.6, 0, 0, 0] for _, s in keys]
    x[::17] += 1.0
    data = [(i, lang, lang + s, "", *map(float, v)) for i, ((lang, s), v) in enumerate(zip(keys, x, strict=True))]
    stats = spark.createDataFrame(data, "id long, lang string, own string, every string, " + ", ".join(f"{k} double" for k in quality.FEATURES))
    got = {v["id"]: v["d2"] for v in quality.robust_outliers(stats, Tables(spark, "test"), levels=("own", "lang", "every"), prior=40).collect()}

    names = np.array([lang + s for lang, s in keys])
    langs = np.array([lang for lang, _ in keys])
    every = np.ones(len(keys), bool)
    mixed = lambda n, own, above: [(n * a + 40 * b) / (n + 40) for a, b in zip(own, above, strict=True)]
    d2 = np.zeros(len(keys))
    for name in sorted(set(names)):
        own, lang = names == name, langs == name[:2]
        of_lang = mixed(lang.sum(), plain_estimate(x[lang]), plain_estimate(x[every]))
        d2[own] = plain_d2(x[own], *mixed(own.sum(), plain_estimate(x[own]), of_lang))
    ratio = lambda at: [plain_rank(d2[at], 0.5) / quality.CHI2_MEDIAN]
    for name in sorted(set(names)):
        own, lang = names == name, langs == name[:2]
        scale = plain_scale(mixed(own.sum(), ratio(own), mixed(lang.sum(), ratio(lang), ratio(every)))[0])
        assert [got[i] for i in np.flatnonzero(own).tolist()] == pytest.approx((d2[own] / scale).tolist(), rel=1e-6, abs=1e-6)
    assert len(got) == len(keys)


def test_distances_equal_plain_estimates(spark):
    import random

    import numpy as np

    r, docs = random.Random(12), {}
    for k in range(400):
        words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(r.randint(12, 120))]
        if k % 9 == 0:
            words = [w + "%%%$$$" for w in words]
        lines = [" ".join(words[i : i + 10]) for i in range(0, len(words), 10)]
        docs[k] = "\n".join(lines + lines[:1] * (k % 5 == 0))
    rows_ = [(k, t, "en", f"s{k % 2}") for k, t in docs.items()]
    got = rows(quality.quality_rules(spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string"), prior=0))
    for group in (0, 1):
        own = [k for k in docs if k % 2 == group and not got[k]["base_failed"]]
        n = lambda k: max(got[k]["n_words"], 1)
        lines = {k: sum(bool(WORD.search(x)) for x in docs[k].split("\n")) for k in own}
        x = np.array([[math.log1p(n(k)), math.log(got[k]["word_chars"] / n(k)), math.log1p(got[k]["n_symbols"] / n(k)), math.sqrt(got[k]["n_dup_lines"] / lines[k]), math.sqrt(got[k]["n_repeat_words"] / n(k))] for k in own])
        expected = plain_distances(x)
        assert [got[k]["distance"] for k in own] == pytest.approx(expected.tolist(), rel=1e-6, abs=1e-6)
        assert [got[k]["kept"] for k in own] == (expected <= quality.CHI2_CUT).tolist()
        assert not all(got[k]["kept"] for k in own)


# licences


def test_every_licence_sentence_holds_a_hint():
    assert all(any(h in s for h in licences.HINTS) for s in licences.SENTENCES)
    assert all(re.fullmatch("[a-z0-9]+( [a-z0-9]+)*", s) for s in licences.SENTENCES)


def test_licences(spark):
    mit = "The MIT License (MIT)\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n"
    cases = {
        1: ("some prose here\nReleased under the MIT License.", "MIT"),
        2: ("a | b |\nLicensed under the Apache License, Version 2.0.", "Apache-2.0"),
        3: ("Text. This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
        4: ("Preamble.\n" + mit, "MIT"),
        5: ("the license of this product is described elsewhere", ""),
        6: (None, ""),
        7: ("", ""),
        8: ("SPDX-License-Identifier: GPL-3.0-or-later\nSPDX-License-Identifier: MIT", "MIT,GPL-3.0-or-later"),
    }
    got = rows(licences.scan(spark.createDataFrame([(k, t) for k, (t, _) in cases.items()], "doc_id long, text string")))
    assert {k: ",".join(r["licences"]) for k, r in got.items()} == {k: v for k, (_, v) in cases.items()}


def test_licence_lines_of_the_table(documents, texts):
    names = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    got = rows(licences.scan(documents))
    for name, text in texts.items():
        expected = {v for line in text.split("\n") for k, v in names.items() if line == k}
        assert expected <= set(got[name]["licences"])
        assert bool(got[name]["licences"]) <= ("icense" in text)


def test_every_licence_line_of_documents_has_its_licence(documents, texts):
    names = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0"}
    lines = {(i, x) for i, t in texts.items() for x in t.split("\n") if "license" in x.lower() and len(x) < 100}
    assert {x for _, x in lines} <= set(names)
    got = rows(licences.scan(documents))
    assert all(names[x] in got[i]["licences"] for i, x in lines)
    assert all(set(got[i]["licences"]) == {names[x] for j, x in lines if i == j} for i in texts)


def plain_identifiers(text):
    """Sentences and lines as lists of words; from each, the longest run of them that is a known sentence."""
    pieces = []
    for line in re.sub(r"[^\S\n]+", " ", text.lower()).split("\n"):
        for part in re.split(r"[.!?:;](?=\s|$)", line):
            part = re.sub(r"^\x20?[#*/;>-]*\x20?[(]?[a-z0-9][)]\x20", " ", part)
            words = re.findall("[a-z0-9]+", part)
            if words:
                pieces.append(words)
    known = {tuple(k.split()): v for k, v in licences.SENTENCES.items()}
    longest = max(map(len, known))
    out, i = [], 0
    while i < len(pieces):
        run, best = (), None
        for j in range(i, len(pieces)):
            run += tuple(pieces[j])
            if len(run) > longest:
                break
            if run in known:
                best = j, known[run]
        if best:
            out.append(best[1])
            i = best[0] + 1
        else:
            i += 1
    return out


def test_identifiers_equal_a_plain_search(spark, documents, texts):
    import random
    import textwrap

    r, all_sentences = random.Random(8), list(licences.SENTENCES)
    more = {}
    for k in range(300):
        lines = []
        for x in r.choices(all_sentences + ["some other words", "license of it", "version 2", "a b c"], k=6):
            lines += textwrap.wrap(x + r.choice([".", ":", ";", "", "!"]), r.choice([30, 60, 500]))
        mark = r.choice(["", "# ", " * ", "// ", "> "])
        more[40_000 + k] = "\n".join(mark + x + " " * r.choice([0, 0, 900]) for x in lines)
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(list(more.items()), "doc_id long, text string"))
    got = rows(licences.scan(docs))
    for i, t in (texts | more).items():
        hint = any(h in t.lower() for h in licences.HINTS)
        assert got[i]["sentence_ids"] == (plain_identifiers(t) if hint else []), t


def test_heads_of_licence_texts(spark):
    cases = {
        1: ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n", "Apache-2.0"),
        2: ("                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.", "LGPL-3.0"),
        3: ("                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999\n", "LGPL-2.1"),
        4: ("                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n", "AGPL-3.0"),
        5: ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n", "GPL-2.0"),
        6: (" * This library is free software; you can redistribute it and/or\n * modify it under the terms of the GNU Lesser General Public\n * License as published by the Free Software Foundation; either\n * version 2.1 of the License, or (at your option) any later version.", "LGPL-2.1-or-later"),
    }
    got = rows(licences.scan(spark.createDataFrame([(k, t) for k, (t, _) in cases.items()], "doc_id long, text string")))
    assert {k: ",".join(r["licences"]) for k, r in got.items()} == {k: v for k, (_, v) in cases.items()}


def test_every_known_sentence_wrapped_in_a_comment(spark):
    import textwrap

    wrapped = {k: "Some file.\n" + "\n".join(" * " + x for x in textwrap.wrap(s, 60)) + ".\n * More text" for k, s in enumerate(licences.SENTENCES)}
    got = rows(licences.scan(spark.createDataFrame(list(wrapped.items()), "doc_id long, text string")))
    assert {k: r["sentence_ids"] for k, r in got.items()} == {k: [i] for k, i in enumerate(licences.SENTENCES.values())}


BSD_TERMS = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:
1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer in the
   documentation and/or other materials provided with the distribution.
"""
GPL_NOTICE = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version {0}\nof the License, or (at your option) any later version.\n"


def test_holders_and_full_texts(spark):
    named = "3. Neither the name of {0} nor the names of its contributors\n   may be used to endorse or promote products derived from this software\n   without specific prior written permission.\n"
    head = "                GNU GENERAL PUBLIC LICENSE\n                  Version {0}\n\nSome terms follow here.\n"
    appendix = "END OF TERMS AND CONDITIONS\n\n     How to Apply These Terms to Your New Programs\n\n<one line to give its name>\n"
    cases = {
        1: (BSD_TERMS + named.format("the University"), "BSD-3-Clause"), 2: (BSD_TERMS + named.format("Some Long Company Name, Inc."), "BSD-3-Clause"), 3: (BSD_TERMS, "BSD-2-Clause"),
        4: (BSD_TERMS + "3. The name of the author may not be used to endorse or promote products\n derived from this software without specific prior written permission.", "BSD-3-Clause"),
        5: (BSD_TERMS + "3. All advertising materials mentioning features or use of this software\n must display the following acknowledgement:\n This product includes software developed by the University.\n" + named.format("it"), "BSD-4-Clause"),
        6: (BSD_TERMS + named.format(" ".join(f"w{i}" for i in range(40))), "BSD-2-Clause"),
        10: (head.format("3, 29 June 2007") + appendix + GPL_NOTICE.format(3), "GPL-3.0"), 11: (head.format("2, June 1991") + appendix + GPL_NOTICE.format(2), "GPL-2.0"),
        12: (GPL_NOTICE.format(2), "GPL-2.0-or-later"), 13: (GPL_NOTICE.format(3) + "\n" + head.format("3, 29 June 2007") + appendix + GPL_NOTICE.format(3), "GPL-3.0-or-later"),
        20: ("Mozilla Public License Version 2.0\n=======\n\n1. Definitions", "MPL-2.0"), 21: ("   MOZILLA PUBLIC LICENSE\n      Version 1.1\n  -----\n", "MPL-1.1"), 22: ("Creative Commons Legal Code\n\nCC0 1.0 Universal\n", "CC0-1.0"),
        23: ("  GNU LIBRARY GENERAL PUBLIC LICENSE\n  Version 2, June 1991\n", "LGPL-2.0"), 24: ('The "Artistic License"\n\n Preamble', "Artistic-1.0"), 25: ("GNU Free Documentation License\n  Version 1.3, 3 November 2008\n", "GFDL-1.3"),
        30: ("Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:", "Zlib"), 31: ("Version 1.1\nUniversal terms of the name", ""),
    }
    got = rows(licences.scan(spark.createDataFrame([(k, t) for k, (t, _) in cases.items()], "doc_id long, text string")))
    assert {k: ",".join(r["licences"]) for k, r in got.items()} == {k: v for k, (_, v) in cases.items()}


def test_licence_texts_of_the_system(spark):
    from pathlib import Path

    names = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
    texts = [(k, p.read_text(errors="replace")) for k, n in enumerate(names) if (p := Path("/usr/share/common-licenses", n)).exists()]
    if not texts:
        pytest.skip("no licence texts here")
    got = rows(licences.scan(spark.createDataFrame(texts, "doc_id long, text string")))
    assert {list(names)[k]: ",".join(r["licences"]) for k, r in got.items()} == {list(names)[k]: list(names.values())[k] for k, _ in texts}


def test_licence_notices_in_their_original_text(spark):
    gpl = "{c}This program is free software{p} you can redistribute it and/or modify\n{c}it under the terms of the GNU General Public License as published by\n{c}the Free Software Foundation{q} either version {v} of the License, or\n{c}(at your option) any later version.\n{c}\n{c}This program is distributed in the hope that it will be useful."
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n{0} Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n{1} Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution."
    cases = {
        1: (gpl.format(c="", p=":", q=",", v=3), "GPL-3.0-or-later"),
        2: ("Title\n#\n" + gpl.format(c="# ", p=";", q=";", v=2), "GPL-2.0-or-later"),
        3: ("/* " + mpl, "MPL-2.0"),
        4: ("Text\n" + mpl.replace("\n * ", " "), "MPL-2.0"),
        5: (bsd.format("1.", "2."), "BSD-2-Clause"),
        6: (bsd.format("(a)", "(b)"), "BSD-2-Clause"),
        7: ("Appendix V. Released under the MIT License.", "MIT"),
        8: ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0\nInternational License.", "CC-BY-NC-SA-4.0"),
        9: ("Nothing is released under the MIT License here", ""),
    }
    got = rows(licences.scan(spark.createDataFrame([(k, t) for k, (t, _) in cases.items()], "doc_id long, text string")))
    assert {k: ",".join(r["licences"]) for k, r in got.items()} == {k: v for k, (_, v) in cases.items()}


# secrets


def test_secrets_equal_plain_patterns(documents, texts):
    scanned = secrets.scan(documents)
    got = rows(secrets.digest(scanned))
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    for name, text in texts.items():
        found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        expected = [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found)]
        assert got[name]["base_sha256"] == hashlib.sha256(",".join(expected).encode()).hexdigest()
        assert set(expected) <= set(got[name]["spans"].split(","))
    assert got[10_013]["spans"].startswith("random:4:") and "," not in got[10_013]["spans"]


def test_markov_models_on_held_out_samples():
    ratios = secrets.model()
    held_out = secrets.labelled_samples(1000, seed=99)
    right = sum((secrets.score(t, ratios) > 0.5) == bool(y) for t, y in held_out)
    assert right / len(held_out) > 0.97


def test_keys_are_found_in_paths_and_without_digits():
    import random

    r, ratios = random.Random(5), secrets.model()
    letters, ordinary, found = secrets.ALPHABET[:62], [t for t, y in secrets.labelled_samples(1000, seed=98) if not y], 0
    for k in range(400):
        key = "".join(r.choice(letters) for _ in range(24))
        before, after = ["static/content/storage/document/export/", "https-cdn/user_profile/image=", "configuration-file-server_"][k % 3], ["", "/original/document", "_backup"][k % 3]
        text = f"see {before}{key}{after} here"
        at = 4 + len(before)
        found += any(a <= at and at + 24 <= b for a, _, b in secrets.find(text, ratios, 0.5))
    assert found >= 380
    assert secrets.find("x QwZkLvBnXcRtYpHsJgFdMqWzKx y", ratios, 0.5) == [(2, 3, 28)]
    paths = ["/".join(ordinary[k : k + 3]) for k in range(0, 999, 3)]
    assert sum(bool(secrets.find(p, ratios, 0.5)) for p in paths) <= 0.01 * len(paths)


def test_redaction(documents, texts):
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(documents).collect()}
    assert secrets.redact(documents).columns == documents.columns
    spans = {r["doc_id"]: r["spans"] for r in secrets.scan(documents).collect()}
    for name, text in texts.items():
        assert (clean[name] or "") == text if not spans[name] else "[SECRET]" in clean[name] and all(text[s["start"] : s["end"]] not in clean[name] for s in spans[name])


# tokens


def test_token_store_equals_the_library(spark, documents, texts, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = documents.unionByName(documents.where("doc_id in (10004, 10001)"))
    token_store.write(docs, str(tmp_path / "store"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_store.read(spark, str(tmp_path / "store")).collect())
    start, expected = 0, []
    for name in sorted([*texts, 10_004, 10_001]):
        ids = [*tokenizer.encode(texts[name], add_special_tokens=False).ids, 2]
        expected.append((start, name, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    assert got == expected
    chunks = spark.read.parquet(str(tmp_path / "store/objects")).where("kind = 'chunk'")
    assert chunks.count() == chunks.select("key").distinct().count()
    levels = spark.read.parquet(str(tmp_path / "store/manifest"))
    top = levels.orderBy(F.desc("level")).first()
    assert levels.where(F.col("level") == top["level"]).count() == 1
    assert (top["n_docs"], top["n_tokens"], top["node"]) == (len(expected), start, 0)


def test_manifest_is_a_tree_of_fixed_width(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "FANOUT", 3)
    folder = str(tmp_path / "m")
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(25)], "doc_id long, text string")
    token_store.write(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    nodes = [(r["root"],) for r in spark.read.parquet(f"{folder}/recipes").orderBy("start").collect()]
    found = spark.read.parquet(f"{folder}/manifest")
    level = 0
    while len(nodes) > 1:
        nodes = [(hashlib.sha256("".join(x[0] for x in nodes[k : k + 3]).encode()).hexdigest(),) for k in range(0, len(nodes), 3)]
        assert [(r["root"],) for r in found.where(F.col("level") == level).orderBy("node").collect()] == nodes
        level += 1
    assert found.select("level").distinct().count() == level == 3


def test_shared_passages_share_chunks(spark, tmp_path):
    passage = " ".join(f"thing{i * 31 % 997}" for i in range(3000))
    docs = spark.createDataFrame([(i, f"start {i} here " + passage) for i in range(20)], "doc_id long, text string")
    token_store.write(docs, str(tmp_path / "s"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    stored = spark.read.parquet(str(tmp_path / "s/objects")).where("kind = 'chunk'").agg(F.sum(F.length("data"))).first()[0]
    n = spark.read.parquet(str(tmp_path / "s/recipes")).agg(F.sum("n_tokens")).first()[0]
    assert stored < 2 * n / 8


def test_short_documents_share_no_chunk(spark, tmp_path):
    """Half of the texts empty: no chunk has more than one reader; ids up to and beyond the bound, equal to the library's."""
    from tokenizers import Tokenizer

    tokenizer, folder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), str(tmp_path / "s")
    texts = [None, "", *["" for _ in range(40)], *[" ".join(["word"] * n) for n in range(1, 20)], *[" ".join(f"{k}x{n}" for k in range(n)) for n in range(1, 20)]]
    docs = spark.createDataFrame([(None, ""), (None, "a"), *enumerate(texts)], "doc_id long, text string")
    token_store.write(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    ids = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
    crc = lambda t: zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids(t)))
    got = token_store.read(spark, folder).collect()
    assert {(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got if r["doc_id"] is not None} == {(i, len(ids(t)), crc(t)) for i, t in enumerate(texts)}
    assert sorted(r["ids_crc32"] for r in got if r["doc_id"] is None) == sorted([crc(""), crc("a")])
    assert {len(ids(t)) > token_store.INLINE for t in texts} == {True, False}
    chunks = spark.read.parquet(f"{folder}/objects").where("kind = 'chunk'")
    assert chunks.where(F.length("data") <= token_store.INLINE * token_store.WIDTH).count() == 0
    recipes = spark.read.parquet(f"{folder}/recipes")
    assert recipes.where("n_tokens = 1").count() == 43 and recipes.where("n_tokens = 1 and octet_length(digests[0]) <> 2").count() == 0
    damaged = str(tmp_path / "d")
    recipes.withColumn("digests", F.when(F.col("n_tokens") == 1, F.array(F.lit(b"\x03\x00"))).otherwise(F.col("digests"))).write.parquet(f"{damaged}/recipes")
    spark.read.parquet(f"{folder}/objects").write.parquet(f"{damaged}/objects")
    with pytest.raises(Exception, match="does not match its root"):
        token_store.read(spark, damaged).collect()


def test_damage_is_found(spark, documents, tmp_path):
    folder = str(tmp_path / "d")
    token_store.write(documents.where("doc_id > 10000"), folder, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    bad = spark.read.parquet(f"{folder}/objects").where("kind = 'chunk'").limit(3)
    bad.withColumn("data", F.concat("data", F.lit(b"xx"))).write.mode("append").parquet(f"{folder}/objects")
    with pytest.raises(Exception, match="does not match its digest"):
        token_store.read(spark, folder).collect()


def test_bpe_equals_the_rank_library_and_decodes(spark, documents, texts):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    ids = bpe.encode(documents, path, public_tokenizers.PATTERN)
    assert {r["doc_id"]: r["ids"] for r in ids.collect()} == {i: library.encode_ordinary(t) for i, t in texts.items()}
    assert {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(ids, path).collect()} == {i: t.encode() for i, t in texts.items()}


def test_bpe_at_every_kind_of_white_space():
    import random

    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    own, r = bpe.encoder(path, public_tokenizers.PATTERN), random.Random(3)
    letters = [*" \n\t\r\x0b\x0c\xa0 abzAB19.,'!?éßñ漢字😀\x1c\x85_-$%", "  ", "\n\n", "'s", "<|endoftext|>", "½"]
    for _ in range(3000):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 25)))
        assert own.encode(text) == library.encode_ordinary(text)


def test_store_encoder_equals_the_library_at_every_kind_of_text():
    import random

    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    own, r = token_store.encoder(path, public_tokenizers.PATTERN, 1000), random.Random(4)
    letters = [*" \n\t\r\xa0 abzAB19.,'!?éßñ漢字😀_-$%*&#|()[]<>/\\\"", "  ", "\n\n", "'s", "<|endoftext|>", "½", " word", "word, ", "***", " über"]
    for _ in range(3000):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 25)))
        assert own.encode(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_new_words_are_encoded_together_and_those_met_again_stay():
    import numpy as np
    import pyarrow as pa

    from decispark.llm.pieces import Encoder

    calls = []

    def words(letters):
        calls.append(letters)
        return np.array([len(w) for w in letters], np.uint32), np.ones(len(letters), np.int32)

    own = Encoder(lambda piece: [0], public_tokenizers.PATTERN, 100, words)
    name = lambda *at: "w" + "".join(chr(97 + i) for i in at)
    often, texts = [name(i) for i in range(20)], []
    for k in range(12):
        rare = [name(k, i, i, i) for i in range(24)]
        texts = ["x " + " ".join([*often, *rare]) for _ in range(3)] if k % 2 == 0 else ["x " + " ".join(rare) + ", " + rare[0]]
        ids, counts = own.encode_column(pa.array(texts))
        expected = [[0, *[2] * 20, *[5] * 24]] * 3 if k % 2 == 0 else [[0, *[5] * 24, 0, 5]]
        assert ids.tolist() == sum(expected, []) and counts.tolist() == [len(x) for x in expected]
    assert len(calls) == 12 and sum(calls, []).count(often[0]) == 1


def test_store_encoder_of_columns_beyond_its_memory():
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, r = Tokenizer.from_file(path), random.Random(5)
    own = token_store.encoder(path, public_tokenizers.PATTERN, 300)
    word = lambda: "".join(r.choice("aeinorst" if r.random() < 0.8 else "éßжд漢字") for _ in range(r.randint(1, 9))) + r.choice(["", "", ",", "...", "'s", "7", "\0"])
    common = [word() for _ in range(50)]
    for _ in range(60):
        texts = [None, "", *["".join(r.choice([" ", " ", " ", "\n", "  "]) + (r.choice(common) if r.random() < 0.5 else word()) for _ in range(r.randint(0, 40))) for _ in range(8)], "a <|endoftext|> b"]
        ids, counts = own.encode_column(pa.array(texts))
        expected = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == sum(expected, []) and counts.tolist() == [len(x) for x in expected]


def test_store_encoder_of_a_vocabulary_that_joins_the_divider(tmp_path):
    """The byte that parts words of a call is in a merge here: words are encoded one by one."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    letters = bpe.byte_characters()
    zero, space = letters[0], letters[32]
    tokens = [*letters, "a" + zero, zero + space]
    made = Tokenizer(models.BPE({t: i for i, t in enumerate(tokens)}, [("a", zero), (zero, space)]))
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    path = str(tmp_path / "made.json")
    made.save(path)
    own = token_store.encoder(path, public_tokenizers.PATTERN, 1000)
    for text in ("b a a", "ba ca da ea", "a\0 b \0\0 c"):
        assert own.encode(text) == made.encode(text, add_special_tokens=False).ids


# pages


def test_pages(spark):
    page = '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy, now. Really.</div><article><h1>The  title &amp; more</h1><p><b>First bold.<br><p>Second &copy;\n para,  with <i>inline</i> text.</p><p>Yes.</p><div class="comments"><p>Reader says, hello.</p></div></article><aside>Side.</aside><footer>&copy; site</footer></body></html>'
    plain = "<html><body><div id='main-menu'><a>Home</a> <a>About</a></div><div><p>Long text, with stops. And more of it, here.</p><p>Short one.</p></div><form><p>Name, please.</p></form><div class='cookie-notice'>We use cookies, ok.</div>"
    listed = "<article><p>" + "A long paragraph, with many stops. " * 40 + "</p><ul><li>One</li><li>Two</li></ul><h2>End</h2><table><tr><td>a</td><td>b</td></tr></table></article>"
    cases = {7: (listed, " ".join(["A long paragraph, with many stops."] * 40) + "\nOne\nTwo\nEnd\na\nb"), 8: ("<div class='side-bar'><p>Not, this.</p></div><p>But, this.</p>", "But, this."), 1: (page, "The title & more\nFirst bold.\nSecond © para, with inline text.\nYes."), 2: (plain, "Long text, with stops. And more of it, here.\nShort one."), 3: (None, ""), 4: ("", ""), 5: ("<nav>only</nav>", ""), 6: ("<article><p>cut off <b>here</article", "cut off here")}
    got = rows(html.extract(spark.createDataFrame([(k, h) for k, (h, _) in cases.items()], "page_id long, html string")))
    assert {k: r["text"] for k, r in got.items()} == {k: t for k, (_, t) in cases.items()}


PROSE = ["A paragraph, with many stops. " * 8, "Another one; it says more, and more. " * 6]
BODY = "".join(f"<p>{x}</p>" for x in PROSE)


def test_links_go_from_an_article_and_its_short_blocks_stay():
    kept = "<h1><a href='/'>Title</a></h1>" + BODY + "<h2>Facts</h2><ul><li>One</li><li>See <a>it</a> there</li></ul><table><tr><td>a</td></tr></table><h2>End</h2><p>By <a href='/x'>Ann Other</a> in the year 2020.</p>"
    links = "".join(f"<li><a href='/{k}'>Some other story {k}</a></li>" for k in range(5))
    more = f"<p><a href='/more'>Read more</a></p><div class='more-stories'><h3>More</h3><ul class='plain'>{links}<li>|</li></ul></div><div class='cloud'><a>x</a> <a>yy</a> <a>zzz</a></div>"
    expected = html.main_text(f"<article>{kept}</article>")
    assert expected.split("\n") == ["Title", *(x.strip() for x in PROSE), "Facts", "One", "See it there", "a", "End", "By Ann Other in the year 2020."]
    assert html.main_text(f"<article>{kept}{more}</article>") == expected
    long_link = f"<p><a href='/y'>{PROSE[0]}</a></p>"
    assert html.main_text(f"<article>{BODY}{long_link}</article>").count(PROSE[0].strip()) == 2
    assert html.main_text(f"<article><ul>{links}</ul></article>").count("story") == 5


@pytest.mark.parametrize("start", ["<div class='has-sidebar'>", "<div class='no-comments'>", "<div class='page-header-layout'>", "<section id='social-science'>", "<form action='/'>", "<head><title>T</title><body>", "<head><meta charset=x><div>", "<head><title>T</title>"])
@pytest.mark.parametrize("around", [("<article>", "</article>"), ("<main>", "</main>"), ("<div>", "</div>"), ("", "")])
def test_no_wrapper_hides_the_article(start, around):
    page = f"<html>{start}<nav><a>Menu</a></nav>{around[0]}{BODY}<div class='comments'><p>Reader says, hello.</p></div>{around[1]}<footer>End.</footer>"
    assert html.main_text(page).split("\n") == [x.strip() for x in PROSE]


def test_ratios_choose_where_no_name_tells():
    lines = "".join(f"<div>{x}</div>" for x in ("Home", "World news today", "All rights kept"))
    page = f"<html><body><div>{lines}</div><div><h2>Title here</h2>{BODY}<p>Yes.</p><ul><li>One</li><li>Two</li></ul></div><div><div>Get our letter</div><div>Your mail</div></div>"
    wanted = ["Title here", *(x.strip() for x in PROSE), "Yes.", "One", "Two"]
    assert html.main_text(page).split("\n") == wanted
    assert html.main_text(page, share=0).split("\n") == ["Home", "World news today", "All rights kept", *wanted, "Get our letter", "Your mail"]
    with_article = page.replace("<div><h2>", "<article><h2>").replace("</ul></div>", "</ul></article>").replace("Get our letter", "Get our letter, every week, with all the news.")
    assert html.main_text(with_article).split("\n") == wanted
    teaser = f"<body><article><p>More.</p></article><div>{BODY * 3}</div>"
    assert PROSE[0].strip() in html.main_text(teaser)


def test_short_parts_stay_beside_long_ones():
    parts = [f"<div class='{name}'><p>{PROSE[k % 2]}</p></div>" for k, name in enumerate(("lead", "intro", "end"))]
    page = f"<body><div><a href='/'>Home</a></div>{parts[0]}{parts[1]}<div class='text'>{BODY * 12}</div>{parts[2]}<div>Buy now.</div></body>"
    assert len(html.main_text(page).split("\n")) == 3 + 24


def test_nine_in_ten_pages_come_right_without_names(spark):
    """Class names gone and furniture as plain containers; then the article as well."""
    from .conftest import SF

    pages = [r["html"] for r in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/pages.parquet").collect()]
    expected = [html.main_text(p) for p in pages]
    plain = [re.sub(r"<(/?)(?:nav|footer|aside|header)\b", r"<\1div", re.sub(r" (?:class|id|role)=\"[^\"]*\"", "", p)) for p in pages]
    bare = [re.sub(r"<(/?)(?:article|main|section)\b", r"<\1div", p) for p in plain]
    right = lambda ps: sum(html.main_text(p) == e for p, e in zip(ps, expected, strict=True)) / len(pages)
    assert right(plain) > 0.97 and right(bare) >= 0.9


def test_time_is_linear_in_the_page():
    import time

    def seconds(page):
        best = 9.0
        for _ in range(3):
            start = time.process_time()
            html.main_text(page)
            best = min(best, time.process_time() - start)
        return best

    for piece in ("<a ", "<div>x ", "<a \"", "<script ", "<b>", "<p>x", "</i>", "<i><div><b><b></i>", "<li>", "<!-", "&lt", "<div class='a' id=b>y", "</section>"):
        small, large = seconds(piece * 4_000), seconds(piece * 32_000)
        assert large < 24 * small + 0.05, piece


def test_articles_of_the_table(spark):
    from html import unescape

    from .conftest import SF

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = rows(html.extract(pages))
    for p in pages.collect():
        article = re.search(r"<article>(.*)</article>", p["html"], re.S)
        blocks = [" ".join(unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|article)>", article[1])]
        assert got[p["page_id"]]["text"] == "\n".join(b for b in blocks if b)


# all of them on nothing


def test_empty_tables(spark, empty, tmp_path):
    path, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    assert fingerprints.edited(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert pii.find(empty).count() == 0
    assert neardup.near_duplicates(empty).count() == 0
    assert quality.quality_rules(empty).count() == 0
    assert licences.scan(empty).count() == 0
    assert secrets.scan(empty).count() == 0
    token_store.write(empty, str(tmp_path / "e"), path, public_tokenizers.PATTERN)
    assert token_store.read(spark, str(tmp_path / "e")).count() == 0
    assert bpe.decode(bpe.encode(empty, ranks, public_tokenizers.PATTERN), ranks).count() == 0
    assert html.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0
