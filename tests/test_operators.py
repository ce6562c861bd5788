"""Operators on small cases with known answers, and those that SQL cannot express."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from decispark.functions import scalar
from decispark.operators import episodes, joins, preferences, rewards, sampling, text, trials, validation
from decispark.sources import files

TRIALS = "sample string, action string, trial int, outcome string, hp double, resources string"


def trial_rows(wins, hp, n, sample="s"):
    return [(sample, a, t, "victory" if t < w else "defeat", float(h), "r") for a, w, h in zip("ABC", wins, hp, strict=True) for t in range(n)]


def accepted_of(spark, rows, rate, n, tolerance, floor=True):
    t = spark.createDataFrame(rows, TRIALS)
    d = trials.accepted(trials.win_gate(trials.action_stats(t), rate, n, floor), trials.complete_samples(t, n), tolerance)
    return sorted(r["action"] for r in d.where("accepted").collect())


def test_floor_gate_and_exact_gate(spark):
    rows = [("s", a, t, "victory" if t < w else "defeat", h * 32 / w, "r") for a, w, h in (("A", 32, 40.0), ("B", 31, 42.0), ("C", 30, 80.0)) for t in range(32)]
    rows = [(s, a, t, o, (h if o == "victory" else 0.0), r) for s, a, t, o, h, r in rows]
    assert accepted_of(spark, rows, "0.989", 32, 5.0) == ["A", "B"]
    assert accepted_of(spark, rows, "0.989", 32, 5.0, floor=False) == ["A"]
    assert accepted_of(spark, rows[:-1], "0.989", 32, 5.0) == []


def test_carried_hp_and_aborted_trials(spark):
    rows = trial_rows((10, 9, 7), (40, 45, 70), 10)
    stats = {r["action"]: r["expected_hp"] for r in trials.action_stats(spark.createDataFrame(rows, TRIALS)).collect()}
    assert stats == pytest.approx({"A": 40, "B": 40.5, "C": 49})
    assert accepted_of(spark, rows, "0.8", 10, 3.0) == ["A", "B"]
    aborted = [(s, a, t, "aborted" if (a, t) == ("C", 9) else o, h, r) for s, a, t, o, h, r in rows]
    assert accepted_of(spark, aborted, "0.8", 10, 3.0) == []


def test_records_become_trials(spark):
    from decispark.sources import schemas

    rows = [("s", t, a, "victory", 40 + t, 80, [("r", 1 if a == "A" else t)], 5, 9, 0.1) for t in range(3) for a in "AB"]
    t = trials.from_records(spark.createDataFrame(rows, schemas.schema("trials")))
    r = trials.paired(t).first()
    assert (r["paired_trials"], r["mean_difference"], r["conflicts"]) == (3, 0.0, 2)


def test_required_wins_are_decimal(spark):
    got = spark.range(1).select(trials.required_wins("0.29", 100).alias("a"), trials.required_wins("0.989", 32).alias("b")).first()
    assert (got["a"], got["b"]) == (29, 31)


def test_lower_bound(spark):
    cases = [(w, n, a) for n in (1, 5, 32, 64) for w in (0, 1, n // 2, n - 1, n) for a in (0.05, 0.01) if 0 <= w <= n]
    d = spark.createDataFrame(cases, "w int, n int, a double").withColumn("p", trials.lower_bound(F.col("w"), F.col("n"), F.col("a")))
    for w, n, a, p in d.collect():
        if w == 0:
            assert p == 0
        else:
            assert sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(w, n + 1)) == pytest.approx(a, abs=1e-9)


def test_paired_differences(spark):
    rows = [("s", "a", t, "victory", float(10 + t), "x") for t in range(3)] + [("s", "b", t, o, 4.0, r) for t, (o, r) in enumerate((("victory", "y"), ("defeat", "x"), ("victory", "x")))]
    r = trials.paired(spark.createDataFrame(rows, TRIALS)).first()
    d = [6.0, 11.0, 8.0]
    se = math.sqrt(sum((x - sum(d) / 3) ** 2 for x in d) / 2 / 3)
    assert (r["paired_trials"], r["conflicts"]) == (3, 1) and (r["mean_difference"], r["standard_error"]) == pytest.approx((sum(d) / 3, se))


def test_preference_arms_keep_their_mass(spark):
    hp = {0: (50, 47, 44), 1: (50, 48, 46), 2: (50, 49, 48), 3: (50, 46)}
    rows = [(str(s), "ABC"[i], t, "victory", float(h), "r") for s, hs in hp.items() for i, h in enumerate(hs) for t in range(64)]
    t = spark.createDataFrame(rows, TRIALS)
    acc = trials.accepted(trials.win_gate(trials.action_stats(t), "0.9", 64), trials.complete_samples(t, 64), 1.0)
    kept = preferences.screened(trials.paired(t), acc, 64, 2.0, 1.0)
    arms = preferences.arms(kept.where("reason is null"), 3.0, 5.0).collect()
    assert {r["sample"] for r in arms} == {"0", "1", "3"}
    gaps = lambda arm, s: sorted(r["gap"] for r in arms if r["arm"] == arm and r["sample"] == s)
    assert gaps("a", "0") == [3, 6] and gaps("b", "0") == [6]
    for arm in "abc":
        states = {r["sample"]: r["loss_weight"] for r in arms if r["arm"] == arm}
        assert sum(states.values()) == pytest.approx(3)
        assert all(sum(r["weight"] for r in arms if (r["arm"], r["sample"]) == (arm, s)) == pytest.approx(1) for s in states)


def test_stage_labels(spark):
    rows = [("s", a, t, "victory", h, "r") for a, h in (("A", 50.0), ("B", 49.5), ("C", 20.0)) for t in range(3)]
    staged = trials.stages(spark.createDataFrame(rows, TRIALS), [1, 2, 3], "0.5", 5.0)
    d = {r["stage"]: r for r in trials.stage_decisions(staged, [1, 2, 3], 5.0, 1.0, 0.0, 1).collect()}
    assert d[1]["candidates"] == ["A", "B"] and d[1]["kind"] == "proper" and "confirm_proper_set" in d[1]["reasons"]
    assert d[1]["would_expand"] and not d[3]["would_expand"]
    assert d[3]["stability"] == ["A:stable_pass", "B:stable_pass", "C:stable_fail"]


def test_uncertain_distances_are_boundaries_at_their_stage(spark):
    rows = [("s", a, t, "victory", h, "r") for a, hs in (("A", (50.0, 50.0, 50.0)), ("B", (40.0, 46.0, 43.0))) for t, h in enumerate(hs)]
    rows += [("t", "A", t, "victory", 50.0, "r") for t in range(3)] + [("t", "D", t, "victory" if t == 0 else "defeat", 120.0, "r") for t in range(3)]
    t = spark.createDataFrame(rows, TRIALS)
    staged = trials.stages(t, [1, 2, 3], "0.9", 5.0)
    plain = {(r["sample"], r["stage"]): r for r in trials.stage_decisions(staged, [1, 2, 3], 5.0, 1.0, 0.0, 1).collect()}
    wide = {(r["sample"], r["stage"]): r for r in trials.stage_decisions(staged, [1, 2, 3], 5.0, 1.0, 0.0, 1, trials.stage_errors(t, 2), 1.0).collect()}
    assert plain["s", 2]["hp_boundary"] == [] and "hp_boundary" not in plain["s", 2]["reasons"]
    assert wide["s", 2]["hp_boundary"] == wide["s", 2]["variance_boundary"] == ["B"] and "hp_boundary" in wide["s", 2]["reasons"]
    assert wide["s", 1]["variance_boundary"] == wide["s", 3]["variance_boundary"] == []
    assert wide["t", 2]["reference_sensitive"] and not wide["s", 2]["reference_sensitive"]
    assert wide["s", 2]["stability"][1] == "B:borderline"


def test_scalars(spark):
    words = ["abc", "", "é漢", "a" * 100]
    d = spark.createDataFrame([(w,) for w in words], "w string").select("w", scalar.fnv1a64(F.col("w")).alias("h"), scalar.seed_for(F.col("w")).alias("s"), scalar.hash_uniform(F.col("w")).alias("u"))
    for w, h, s, u in d.collect():
        x = 0xCBF29CE484222325
        for b in w.encode():
            x = (x ^ b) * 0x100000001B3 % 2**64
        digest = hashlib.sha256(w.encode()).digest()
        assert int(h) == x and s == int.from_bytes(digest[:4], "big") and u == int.from_bytes(digest[:8], "big") / 2**64
    p = spark.createDataFrame([("12.34%",), ("",), ("--",), ("--%",), ("101%",), ("x",), (None,), ("100%",)], "x string").select(scalar.parse_percentage(F.col("x"))).collect()
    assert [r[0] for r in p] == [pytest.approx(0.1234), None, None, None, None, None, None, 1.0]
    ids = spark.createDataFrame([(" Strike+1 ",), ("__",), ("a--b",)], "x string").select(scalar.normalize_id(F.col("x"))).collect()
    assert [r[0] for r in ids] == ["STRIKE_1", None, "A_B"]
    test = spark.createDataFrame([(3, 10), (0, 0), (5, 10)], "k int, n int").select(scalar.exact_two_sided(F.col("k"), F.col("n"))).collect()
    assert [r[0] for r in test] == pytest.approx([2 * sum(math.comb(10, i) for i in range(4)) / 1024, 1.0, 1.0])


def test_carry_over_clamps_and_stops(spark):
    changes = {1: [-10, 30, -5], 2: [-50, -60, 10], 3: []}
    d = spark.createDataFrame([(k, i, float(c)) for k, cs in changes.items() for i, c in enumerate(cs)], "k int, i int, c double")
    got = {r["k"]: (r["ending_hp"], r["steps_done"], r["status"]) for r in episodes.carry_over(d, "k", "i", "c", 80, 80).collect()}
    assert got == {1: (75.0, 3, "completed"), 2: (0.0, 2, "defeated")}


def pile(events):
    known = []
    for kind, item in events:
        known = [item, *known] if kind == "push" else known[1:] if kind == "draw" else [] if kind == "shuffle" else known
    return known


def test_known_prefix(spark):
    r = random.Random(1)
    events = {k: [(r.choice(["push", "push", "draw", "shuffle", "look"]), f"c{i}") for i in range(30)] for k in range(20)}
    d = spark.createDataFrame([(k, i, kind, item) for k, es in events.items() for i, (kind, item) in enumerate(es)], "k int, i int, kind string, item string")
    assert {x["k"]: x["known"] for x in episodes.known_prefix(d, "k", "i", "kind", "item").collect()} == {k: pile(es) for k, es in events.items()}


def test_adjacent_difference(spark):
    rows = [(1, i, items) for i, items in enumerate((["a", "a", "b"], ["a", "c"], ["a", "c"], []))]
    got = joins.adjacent_difference(spark.createDataFrame(rows, "k int, i int, items array<string>"), "k", ["i"], "items").orderBy("i").collect()
    before: list = []
    for row, (_, _, items) in zip(got, rows, strict=True):
        assert row["gained"] == ",".join(sorted((Counter(items) - Counter(before)).elements())) and row["lost"] == ",".join(sorted((Counter(before) - Counter(items)).elements()))
        before = items


def test_edge_rules(spark):
    e = lambda *xs: [tuple(x) for x in xs]
    rows = [(1, e(("a", "b", 1.0)), ["a", "b"]), (2, e(("a", "a", 0.5), ("a", "z", 0.5)), ["a"]), (3, e(("a", "b", 0.5), ("a", "b", 0.4)), ["a", "b"]), (4, e(("a", "b", 2.0), ("b", "a", -1.0)), ["a", "b"])]
    d = spark.createDataFrame(rows, "k int, edges array<struct<chosen:string,rejected:string,weight:double>>, legal array<string>")
    got = defaultdict(set)
    for r in validation.broken(d, ["k"], validation.edge_rules("edges", "legal")).collect():
        got[r["k"]].add(r["rule"])
    assert got == {2: {"known", "distinct_sides"}, 3: {"unique", "sum_one"}, 4: {"positive"}}


def test_mixture_sample_follows_its_channels(spark):
    rows = [(g, f"{g}-{i:02d}", i % 4 == 0, "e1" if i % 3 == 0 else "e2" if i == 5 else None) for g in range(300) for i in range(12)]
    d = spark.createDataFrame(rows, "g int, key string, turn_start boolean, bucket string")
    got = sampling.mixture_sample(d, "g", "key", 3, 5).collect()
    assert len(got) == 900 and len({(r["g"], r["key"]) for r in got}) == 900
    share = Counter(r["channel"] for r in got if r["draw_index"] == 0)
    assert all(abs(share[c] / 300 - w) < 0.1 for c, w in sampling.CHANNELS.items())
    flags = {(g, k): (t, b) for g, k, t, b in rows}
    for g in range(300):
        left = {k: flags[g, k] for _, k, _, _ in [r for r in rows if r[0] == g]}
        for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["draw_index"]):
            starts = [k for k, (t, _) in left.items() if t]
            buckets = Counter(b for _, b in left.values() if b)
            turn, bucket = left[r["key"]]
            a, e = 0.4 * bool(starts), 0.3 * bool(buckets)
            assert r["channel"] == "random" or (turn if r["channel"] == "turn_start" else bucket)
            chance = (1 - a - e) / len(left) + (a / len(starts) if turn else 0) + (e / len(buckets) / buckets[bucket] if bucket else 0)
            assert r["probability"] == pytest.approx(chance)
            del left[r["key"]]


def test_mixture_sample_draws_each_row_as_often_as_it_says(spark):
    rows = [(g, f"{i}", i == 0, "e" if i < 3 else None) for g in range(4000) for i in range(5)]
    got = sampling.mixture_sample(spark.createDataFrame(rows, "g int, key string, turn_start boolean, bucket string"), "g", "key", 2, 9).collect()
    first = Counter(r["key"] for r in got if r["draw_index"] == 0)
    expected = {"0": 0.4 + 0.1 + 0.06, "1": 0.16, "2": 0.16, "3": 0.06, "4": 0.06}
    assert all(abs(first[k] / 4000 - p) < 0.03 for k, p in expected.items())
    assert len(got) == 8000
    short = spark.createDataFrame([(1, "a", None, None), (1, "b", False, None), (2, "c", True, "x")], "g int, key string, turn_start boolean, bucket string")
    assert Counter(r["g"] for r in sampling.mixture_sample(short, "g", "key", 4, 1).collect()) == {1: 2, 2: 1}


def test_places_over_many_partitions(spark):
    d = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"), (F.col("id") % 3).alias("g")).repartition(7)
    got = {(r["g"], r["k"]): r["place"] for r in sampling.ordered_places(d, ["g", F.desc("k")]).collect()}
    assert got == {x: i for i, x in enumerate(sorted(got, key=lambda x: (x[0], -x[1])))}
    assert sampling.ordered_places(d.where("k < 0"), ["k"]).count() == 0


def test_sign_test_of_any_size(spark):
    exact = lambda k, n: min(1.0, 2 * sum(math.comb(n, i) for i in range(min(k, n - k) + 1)) / 2**n)
    cases = [(0, 1), (1, 1), (4, 9), (20, 41), (0, 60), (230, 500), (500, 1000), (4800, 10_000), (10_000, 4000 + 10_000)]
    d = spark.createDataFrame([*cases, (499_000, 1_000_000)], "k long, n long")
    got = {(r["k"], r["n"]): r["p"] for r in d.select("k", "n", scalar.exact_two_sided(F.col("k"), F.col("n")).alias("p")).collect()}
    assert got.pop((499_000, 1_000_000)) == pytest.approx(math.erfc((1000 - 0.5) / math.sqrt(250_000) / math.sqrt(2)), rel=1e-3)
    assert got == {c: pytest.approx(exact(*c), rel=1e-9, abs=1e-300) for c in cases}


def test_bootstrap_means_scatter_around_the_mean(spark):
    rows = [(c, float(c % 10 + j)) for c in range(500) for j in range(c % 4 + 1)]
    got = [r["mean"] for r in sampling.bootstrap(spark.createDataFrame(rows, "c int, v double"), "c", "v", 200, 3).collect()]
    total, n = sum(v for _, v in rows), len(rows)
    sums, sizes = Counter(), Counter()
    for c, v in rows:
        sums[c] += v
        sizes[c] += 1
    error = math.sqrt(sum((sums[c] - sizes[c] * total / n) ** 2 for c in sums)) / n
    mean = sum(got) / len(got)
    assert len(got) == 200 and abs(mean - total / n) < 0.3 * error
    assert 0.8 < math.sqrt(sum((x - mean) ** 2 for x in got) / len(got)) / error < 1.2


def test_manifest_and_file_digests(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, x string")
    one = {r["split"]: r for r in files.manifest({"train": d.where("id < 3"), "dev": d.where("id = 3")}, ["id"], "set", "v1").collect()}
    two = {r["split"]: r for r in files.manifest({"train": d.where("id < 3").repartition(3).orderBy(F.desc("id")), "dev": d.where("id = 3")}, ["id"], "set", "v1").collect()}
    assert one == two and (one["train"]["records"], one["dev"]["records"]) == (2, 1)
    other = files.manifest({"train": d.where("id < 3").withColumn("x", F.upper("x"))}, ["id"], "set", "v1").first()
    assert other["digest"] != one["train"]["digest"] != one["dev"]["digest"]
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.bin").write_bytes(b"content")
    got = files.file_digests(spark, str(tmp_path / "f")).first()
    assert (got["length"], got["sha256"]) == (7, hashlib.sha256(b"content").hexdigest())


def test_documents_must_be_objects(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n "x": 1}')
    assert [r["x"] for r in files.read_json_document(spark, str(tmp_path), "x int").collect()] == [1]
    (tmp_path / "b.json").write_text('[{"x": 1}]')
    with pytest.raises(Exception, match="no JSON object"):
        files.read_json_document(spark, str(tmp_path), "x int").collect()


def test_fixture_problems(spark, tmp_path):
    good = '{"schema_version":"parity_fixture_v1","fixture_id":"f","step_index":%d,"real_raw_snapshot":{"b":[1,2],"a":{"d":null,"c":"x"}},"real_raw_snapshot_sha256":"%s"}'
    h = hashlib.sha256(b'{"a":{"c":"x","d":null},"b":[1,2]}').hexdigest()
    lines = [good % (0, h), good % (1, "0"), good % (2, h), good % (2, h), "", "[1]", "{x", good.replace("%d", "true") % h, good.replace('"f"', '""') % (3, h), good.replace("v1", "v2") % (4, h), '{"schema_version":"parity_fixture_v1","fixture_id":"g","step_index":1}']
    (tmp_path / "f.jsonl").write_text("\n".join(lines))
    got = Counter(r["problem"] for r in files.scan_fixtures(spark, str(tmp_path)).collect())
    assert got == {None: 1, "hash mismatch": 1, "duplicate": 2, "not an object": 2, "step_index": 1, "fixture_id": 1, "schema_version": 1, "raw evidence": 1}


def test_pairs_without_common_trials(spark):
    rows = [("s", "A", 0, "victory", 5.0, "r"), ("s", "B", 1, "victory", 5.0, "r"), ("s", "C", 0, "defeat", 5.0, "r"), ("s", "C", 1, "aborted", 5.0, "r")]
    got = {(r["a"], r["b"]): (r["paired_trials"], r["mean_difference"], r["standard_error"]) for r in trials.paired(spark.createDataFrame(rows, TRIALS)).collect()}
    assert got == {("A", "B"): (0, None, None), ("A", "C"): (1, 5.0, None), ("B", "C"): (0, None, None)}


def test_demonstrations(spark):
    schema = "k int, classes array<struct<class_id:string,action_type:string,representative:string>>, executed string, selected string, fallback boolean"
    end, play = ("ACTION_0", "end_turn", "e"), ("ACTION_1", "play_card", "p")
    rows = [(1, [end], "e", "ACTION_0", False), (2, [end, play], "e", "ACTION_0", False), (3, [end, play], "p", "ACTION_0", False), (4, [play], "p", "ACTION_1", True), (5, [play], "x", "ACTION_1", False)]
    got = {r["k"]: (r["problem"], r["supervision_source"]) for r in text.demonstrations(spark.createDataFrame(rows, schema), "classes", "executed", "selected", "fallback").collect()}
    assert got == {1: (None, "forced_end"), 2: (None, "teacher_strategy"), 3: ("action differs", None), 4: ("fallback", None), 5: ("action differs", None)}


def test_retry_needs_actions(spark):
    d = spark.createDataFrame([("obs", ["ACTION_0", "ACTION_1"])], "o string, a array<string>")
    assert d.select(text.request_text("sys", F.col("o"), F.col("a"))["user_prompt"]).first()[0] == "obs\n\nYour previous response was invalid.\n\nReturn exactly one of:\nACTION_0\nACTION_1\n\nReturn only the action ID."
    with pytest.raises(Exception, match="needs allowed actions"):
        d.select(text.request_text("sys", F.col("o"), F.array().cast("array<string>"))).collect()


def test_legal_actions(spark):
    schema = "k int, hand array<struct<name:string,playable:boolean,has_target:boolean>>, monsters array<struct<is_gone:boolean,half_dead:boolean,hp:int>>"
    hand = [("strike", True, True), ("curse", False, False), ("block", True, False)]
    monsters = [(False, False, 5), (True, False, 5), (False, True, 5), (False, False, 0), (False, False, 1)]
    got = [(r["action_id"], r["card"], r["target"]) for r in text.legal_actions(spark.createDataFrame([(1, hand, monsters)], schema), "k").orderBy("place").collect()]
    assert got == [("ACTION_0", "strike", 0), ("ACTION_1", "strike", 4), ("ACTION_2", "block", None), ("ACTION_3", None, None)]


def test_choice_distribution_keeps_mass_one(spark):
    d = spark.createDataFrame([(1, "a", 0.2), (1, "b", 0.3), (2, "a", 0.9), (2, "b", 0.6)], "g int, c string, p double")
    got = {(r["g"], r["choice"]): r["probability"] for r in rewards.choice_distribution(d, "g", "c", "p", 0.02).collect()}
    assert got == pytest.approx({(1, "a"): 0.2, (1, "b"): 0.3, (1, "SKIP"): 0.5, (2, "a"): 0.588, (2, "b"): 0.392, (2, "SKIP"): 0.02})


def test_glossary_closure_stops_at_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "term string, leads_to string")
    got = text.glossary_closure(spark.createDataFrame([(1, "a"), (2, "x")], "k int, term string"), "k", edges)
    assert {(r["k"], r["term"]) for r in got.collect()} == {(1, "a"), (1, "b"), (1, "c"), (2, "x"), (2, "y")}


# files


def test_write_once_refuses_other_rows(spark, tmp_path):
    a, b = spark.range(5), spark.range(6)
    files.write_once({str(tmp_path / "t"): a}, ["id"])
    with pytest.raises(ValueError, match="other rows"):
        files.write_once({str(tmp_path / "new"): a, str(tmp_path / "t"): b}, ["id"])
    assert not (tmp_path / "new").exists()
    assert files.write_once({str(tmp_path / "t"): spark.range(5).repartition(3)}, ["id"]) == []


def test_strict_json_lines(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"a": 1}\n\nnot json\n')
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        files.read_json_lines(spark, str(tmp_path / "bad.json"), "a int").collect()
    schema = T.StructType().add("schema_version", "string").add("record_type", "string").add("a", "integer")
    (tmp_path / "t.jsonl").write_text('{"schema_version":"v1","record_type":"t","a":1}\n\n{"schema_version":"v2","record_type":"t"}\n{"schema_version":"v1","record_type":"u"}\n[1]\n')
    good, bad = files.scan_trajectories(spark, str(tmp_path / "t.jsonl"), schema, "v1", "t")
    assert [r["a"] for r in good.collect()] == [1]
    assert {r["line"]: r["problem"] for r in bad.collect()} == {2: "blank line", 3: "schema_version", 4: "record_type", 5: "not an object of the schema"}
