"""Nested differences, replays, bags, log-probabilities, expanding draws, walks, line numbers and look-up tables."""

import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from decispark.functions import scalar, walks
from decispark.operators import diffs, sampling
from decispark.sources import files

# recursive differences


def differences(spark, pairs):
    """(key, path, expected, observed) of pairs (expected, observed) of JSON text; a missing side is left out."""
    side = lambda n: spark.createDataFrame([(i, p[n]) for i, p in enumerate(pairs) if p[n] is not ...], "k long, j string")
    d = diffs.nested_differences(side(0), side(1), ["k"], "j")
    return sorted(tuple(r) for r in d.collect())


def plain_differences(e, a, path="$"):
    text = lambda v: json.dumps(v, sort_keys=True, separators=(",", ":"))
    if isinstance(e, dict) and isinstance(a, dict):
        for k in {**e, **a}:
            if k in e and k in a:
                yield from plain_differences(e[k], a[k], f"{path}.{k}")
            else:
                yield f"{path}.{k}", text(e[k]) if k in e else "<absent>", text(a[k]) if k in a else "<absent>"
    elif isinstance(e, list) and isinstance(a, list):
        if len(e) != len(a):
            yield f"{path}.length", str(len(e)), str(len(a))
        for i, (x, y) in enumerate(zip(e, a, strict=False)):
            yield from plain_differences(x, y, f"{path}[{i}]")
    elif type(e) is not type(a) or e != a:
        yield path, text(e), text(a)


def test_paths_of_nested_differences(spark):
    base = {"a": 1, "b": {"c": [1, {"d": "x"}, [2, 3]], "e": None}, "f": "t"}
    assert differences(spark, [(json.dumps(base), json.dumps({**base, "a": 1.0}))]) == []
    others = [
        base, {**base, "a": 2}, {**base, "a": "1"}, {**base, "b": {"c": [1, {"d": "y"}, [2, 3, 4]], "e": None}}, {**base, "b": {"c": [1], "e": None}}, {**base, "b": {"c": [1, {"d": "x"}, [2, 3]]}},
        {**base, "f": {"g": []}}, {"f": "t"}, [base], {**base, "new": {"z": [True, False]}}, {**base, "b": []}, {**base, "b": {"c": {"0": 1}, "e": False}},
    ]
    got = differences(spark, [(json.dumps(base), json.dumps(o)) for o in others])
    assert got == sorted((i, *d) for i, o in enumerate(others) for d in plain_differences(base, o))
    assert (3, "$.b.c[1].d", '"x"', '"y"') in got and (3, "$.b.c[2].length", "2", "3") in got


def test_differences_of_missing_and_broken_documents(spark):
    got = differences(spark, [("{}", ...), (..., "[1]"), ("{broken", "null"), (None, "1"), ("", ""), ("[]", "{}")])
    assert got == [(0, "$", "{}", "<absent>"), (1, "$", "<absent>", "[1]"), (3, "$", "null", "1"), (5, "$", "[]", "{}")]


@pytest.mark.parametrize("seed", [1, 2])
def test_differences_of_random_documents(spark, seed):
    draw = random.Random(seed)

    def value(depth):
        kind = draw.random()
        if depth == 0 or kind < 0.4:
            return draw.choice([0, 1, 2, "a", "b", True, None])
        return {draw.choice("klmn"): value(depth - 1) for _ in range(draw.randrange(4))} if kind < 0.7 else [value(depth - 1) for _ in range(draw.randrange(4))]

    pairs = [(value(4), value(4)) for _ in range(150)]
    got = differences(spark, [(json.dumps(e), json.dumps(a)) for e, a in pairs])
    assert got == sorted((i, *d) for i, (e, a) in enumerate(pairs) for d in plain_differences(e, a))


# replays


def followed(spark, recorded, replayed, block):
    schema = "e string, i long, x string"
    d = diffs.first_divergence(spark.createDataFrame(recorded, schema), spark.createDataFrame(replayed, schema), "e", "i", ["x"], block)
    return {r["e"]: (r["verified"], r["status"], r["i"], r["recorded"] and json.loads(r["recorded"])["x"], r["replayed"] and json.loads(r["replayed"])["x"]) for r in d.collect()}


@pytest.mark.parametrize("block", [1, 3, 256])
def test_first_divergence(spark, block):
    steps = lambda e, xs: [(e, i, x) for i, x in enumerate(xs)]
    recorded = steps("same", "abcdefgh") + steps("swap", "abcdefgh") + steps("short", "abcde") + steps("long", "abc") + steps("gone", "ab") + steps(None, "abc") + steps("twice", "abcd") + [("twice", 2, "c"), ("nulls", None, "q"), ("nulls", 0, None)]
    replayed = steps("same", "abcdefgh") + steps("swap", "abcdfegh") + steps("short", "abc") + steps("long", "abcd") + steps("new", "a") + steps(None, "abx") + steps("twice", "abcd") + [("nulls", None, "q"), ("nulls", 0, None)]
    random.Random(1).shuffle(replayed)
    assert followed(spark, recorded, replayed, block) == {
        "same": (8, "verified", None, None, None), "swap": (4, "diverges", 4, "e", "f"), "short": (3, "not replayed", 3, "d", None), "long": (3, "not recorded", 3, None, "d"),
        "gone": (0, "not replayed", 0, "a", None), "new": (0, "not recorded", 0, None, "a"), None: (2, "diverges", 2, "c", "x"), "twice": (2, "repeated", 2, "c", "c"), "nulls": (2, "verified", None, None, None),
    }


# bags


def test_bags_keep_multiplicity_and_drop_order(spark):
    card = "struct<id:string,cost:int,uuid:string>"
    schema = f"k int, hand array<{card}>, powers array<struct<name:string,amount:int,card:{card}>>"
    c = lambda i, u: (i, 1, u)
    rows = [
        (0, [c("a", "1"), c("b", "2")], [("p", 1, None), ("q", None, c("a", "3"))]), (1, [c("a", "9"), c("b", "8")], [("q", 0, c("a", "7")), None, ("p", 1, None)]),
        (2, [c("b", "2"), c("a", "1")], [("p", 1, None), ("q", None, c("a", "3"))]), (3, [c("a", "1"), c("b", "2")], [("p", 1, None), ("p", 1, None), ("q", None, c("a", "3"))]), (4, None, None), (5, [], []),
    ]
    public = {"id": None, "cost": None}
    spec = {"hand": diffs.Ordered(public), "powers": diffs.Bag({"name": None, "amount": diffs.Default(0), "card": public})}
    d = spark.createDataFrame(rows, schema)
    got = {r["k"]: r["d"] for r in d.select("k", diffs.projection_digest(F.struct("hand", "powers"), spec).alias("d")).collect()}
    assert got[0] == got[1] and len(set(got.values())) == 5


# log-probabilities


def test_response_log_probabilities(spark):
    rows = [
        (0, [[1.0, 2.0], [1000.0, -1000.0], [5.0, 5.0]], [-100, 1, 0]), (1, [[1e308, 1e308], [0.0, 0.0]], [0, 1]), (2, [[-1e4, -1e4 + 1], [0.0, 0.0]], [0, 1]),
        (3, [[1.0, 2.0]], [1]), (4, [[1.0], [1.0]], [-100, -100]), (5, [[1.0], [1.0]], [0, 3]), (6, [[1.0]], [0, 0]), (7, None, None), (8, [[1.0], [1.0]], [0, -1]),
    ]
    d = spark.createDataFrame(rows, "k int, s array<array<double>>, y array<int>")
    got = {r["k"]: r["r"] and tuple(r["r"]) for r in d.select("k", scalar.response_log_prob(F.col("s"), F.col("y")).alias("r")).collect()}
    two = math.log(1 / (1 + math.exp(-1)))
    assert got[0] == pytest.approx((two + 0.0, 2)) and got[1] == pytest.approx((-math.log(2), 1)) and got[2] == pytest.approx((two, 1))
    assert [got[k] for k in range(3, 9)] == [None] * 6


# expanding draws


def plain_draw(items, g, count, roles, seed):
    """Items in the order of their hashes, one by one."""
    own = {}
    for group, item, role, anchor, need in items:
        if group == g and item is not None:
            own.setdefault(item, (not anchor, role, need))
    rank = lambda i: hashlib.sha256(f"{seed}|{g}|{i}".encode()).hexdigest()
    done = sorted(i for i, x in own.items() if not x[0])
    while len(done) < count:
        there = {own[i][1] for i in done}
        free = [i for i in own if i not in done and (own[i][2] is None or own[i][2] in there)]
        new = [i for i in free if own[i][1] not in there]
        free = new if len(there) < roles and new else free
        if not free:
            break
        done.append(min(free, key=rank))
    return [(k, i, own[i][1]) for k, i in enumerate(done)]


def test_draws_expand_roles_and_meet_requirements(spark):
    draw = random.Random(8)
    items = [(g, f"i{g}-{n}", draw.choice("ABCDE"), n < 2, draw.choice([None, None, None, "A", "E"])) for g in range(12) for n in range(draw.choice([1, 4, 60]))]
    items += items[5:9] + [(3, None, "A", False, None), (50, "only", None, False, None)]
    d = spark.createDataFrame(items, "g int, item string, role string, first boolean, need string")
    got: dict = {}
    for r in sampling.expanding_draw(d.repartition(5), "g", "item", "role", 7, 4, 5, "first", "need").collect():
        got.setdefault(r["g"], []).append((r["draw_index"], r["item"], r["role"]))
    assert {g: sorted(x) for g, x in got.items()} == {g: plain_draw(items, g, 7, 4, 5) for g in {i[0] for i in items}}
    with pytest.raises(Exception, match="more anchors"):
        sampling.expanding_draw(d, "g", "item", "role", 1, 4, 5, "first", "need").collect()


# walks


def test_walks_go_in_order_and_hold_one_row(spark):
    rows = [(g, i, (g * 7 + i) % 5) for g in range(6) for i in range(40)]
    random.Random(2).shuffle(rows)
    step = lambda s, r: (s + [r["i"]], [(r["g"], r["i"], len(s))] if r["v"] == 0 else [])
    d = walks.walked(spark.createDataFrame(rows, "g int, i int, v int"), "g", "i", list, step, lambda s: [(-1, len(s), int(s == sorted(s)))], "g int, i int, n int")
    assert sorted(tuple(r) for r in d.collect()) == sorted([(g, i, i) for g, i, v in rows if v == 0] + [(-1, 40, 1)] * 6)


# line numbers


def test_line_numbers_of_files_read_by_many_tasks(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    draw = random.Random(6)
    lines = {f"f{n}.txt": ["" if draw.random() < 0.1 else f"{n}-{i} " + "ü" * draw.randrange(60) for i in range(size)] for n, size in enumerate((700, 1, 0, 350))}
    for name, own in lines.items():
        (folder / name).write_text("".join(x + "\n" for x in own))
    (folder / "open.txt").write_text("a\r\n\nb")
    lines["open.txt"] = ["a", "", "b"]
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for size, cost in (("1k", "0"), ("3k", "2k")):
            spark.conf.set(names[0], size)
            spark.conf.set(names[1], cost)
            d = files.numbered_text(spark, str(folder))
            assert d.rdd.getNumPartitions() > 8
            got = sorted((r["file"].rsplit("/", 1)[-1], r["line"], r["value"]) for r in d.collect())
            assert got == sorted((n, i + 1, x) for n, own in lines.items() for i, x in enumerate(own))
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


# look-up tables


def rows_read(d):
    d.collect()
    plan = d._jdf.queryExecution().executedPlan()
    leaves = (plan.finalPhysicalPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan).collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_look_ups_skip_row_groups(spark, tmp_path):
    path = str(tmp_path / "table")
    d = spark.range(40_000).select((F.col("id") * 3).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    about = files.publish_indexed(d.repartition(5), path, ["k"], {"source": "s"}, group_bytes=64_000)
    assert about == files.index_metadata(spark, path) and about["records"] == "40000"
    assert [(r["k"], r["v"]) for r in files.look_up(spark, path, k=3000).collect()] == [(3000, hashlib.sha256(b"1000").hexdigest())]
    assert 0 < rows_read(files.look_up(spark, path, k=3000)) < 10_000
    # Within the range of keys, but in no Bloom filter.
    assert rows_read(files.look_up(spark, path, k=3001)) == 0
    assert sorted(r["k"] for r in files.look_up(spark, path, k=[3, 4, 6]).collect()) == [3, 6]
    keys = spark.createDataFrame([(3,), (4,), (None,), (3,)], "k long")
    for most in (1, 1000):
        assert [r["k"] for r in files.look_up_all(spark, path, keys, most).collect()] == [3]
    with pytest.raises(FileExistsError):
        files.publish_indexed(d, path, ["k"])


def test_failed_builds_leave_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    broken = spark.range(100).select("id", F.when(F.col("id") == 70, F.raise_error(F.lit("broken row")).cast("string")).alias("v"))
    for d, key in ((broken, "id"), (spark.range(5).union(spark.range(5)), "id"), (spark.range(5).select(F.when(F.col("id") > 0, F.col("id")).alias("id")), "id")):
        with pytest.raises(Exception, match="broken row|null or repeated"):
            files.publish_indexed(d, path, [key])
        assert list(tmp_path.iterdir()) == []
    files.publish_indexed(spark.createDataFrame([], T.StructType().add("id", "long")), path, ["id"])
    assert files.index_metadata(spark, path)["records"] == "0"
