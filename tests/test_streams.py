"""Streams with bounded state, and the sink that survives replays."""

from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException

from decispark.streaming import logs

START = datetime(2024, 1, 1)


def at(hours):
    return START + timedelta(hours=hours)


def feed(spark, tmp_path, schema, batches, build, **options):
    """Each batch arrives and is processed before the next; all rows that come out."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = build(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        logs.run_once(stream, str(tmp_path / "state"), str(tmp_path / "out"), **options)
    return spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()


def state_rows(spark, tmp_path):
    """What the stateful operator's own state holds, timers not counted."""
    return spark.read.format("statestore").option("stateVarName", "state").load(str(tmp_path / "state")).count()


def test_steps_wait_for_those_before_them(spark, tmp_path):
    batches = [[("e", 1), ("e", 0), ("f", 0), ("e", 3)], [("e", 1), ("e", 2), ("f", 2), ("e", 3)], [("f", 2), ("f", 1)]]
    got = feed(spark, tmp_path, "e string, i long", batches, lambda s: logs.next_steps(s, "e", "i"))
    accepted = [("e", i, "accepted") for i in range(4)] + [("f", i, "accepted") for i in range(3)]
    assert Counter(tuple(r) for r in got) == Counter([*accepted, ("e", 1, "duplicate"), ("e", 3, "duplicate"), ("f", 2, "duplicate")])


def test_state_goes_when_the_delay_has_passed(spark, tmp_path):
    batches = [[("a", 0, at(1)), ("a", 2, at(1)), ("b", 0, at(2))], [("z", 0, at(30))], [("z", 1, at(31)), ("a", 1, at(1))]]
    got = feed(spark, tmp_path, "e string, i long, t timestamp", batches[:1], lambda s: logs.next_steps(s, "e", "i", "t", "2 hours"))
    assert state_rows(spark, tmp_path) == 2 and {tuple(r) for r in got} == {("a", 0, "accepted"), ("b", 0, "accepted")}
    got = feed(spark, tmp_path, "e string, i long, t timestamp", batches[1:], lambda s: logs.next_steps(s, "e", "i", "t", "2 hours"))
    assert state_rows(spark, tmp_path) == 1
    assert Counter(tuple(r) for r in got) == Counter([("a", 0, "accepted"), ("b", 0, "accepted"), ("a", 2, "gap"), ("z", 0, "accepted"), ("z", 1, "accepted")])


def test_snapshots_advance_in_their_own_order(spark, tmp_path):
    batches = [[("a", 2, 3.0), ("a", 1, 1.0), ("a", 3, 2.0), ("a", 0, None)], [("a", 5, 4.0), ("a", 4, 3.0)]]
    got = feed(spark, tmp_path, "k string, n long, v double", batches, lambda s: logs.advancing(s, "k", "n", "v"))
    assert sorted(tuple(r) for r in got) == [("a", 1, 1.0), ("a", 2, 3.0), ("a", 5, 4.0)]


def test_snapshots_follow_commands(spark, tmp_path):
    schema = "k string, n long, kind string, item string, turn long, hand array<string>"
    shot = lambda n, turn, *hand: ("k", n, "snapshot", None, turn, list(hand))
    batches = [
        [shot(2, 1, "x", "y"), ("k", 1, "play_card", "x", 1, None), shot(0, 1, "x", "y"), shot(3, 1, "y")],
        [shot(4, 1, "y"), ("k", 5, "end_turn", None, 1, None), shot(6, 1, "y"), shot(7, None, "y")],
        [shot(8, 2), shot(9, 2)],
    ]
    got = feed(spark, tmp_path, schema, batches, lambda s: logs.correlated(s, "k", "n"))
    assert {r["n"]: r["status"] for r in got} == {0: "unasked", 2: "stale", 3: "advanced", 4: "unasked", 6: "stale", 7: "stale", 8: "advanced", 9: "unasked"}


def test_known_tops_go_on(spark, tmp_path):
    batches = [[("p", 1, "push", "b"), ("p", 0, "push", "a"), ("p", 2, "push", "c")], [("p", 3, "draw", None)], [("p", 5, "push", "z"), ("p", 4, "shuffle", None), ("p", 6, "draw", None), ("p", 7, "draw", None)]]
    got = feed(spark, tmp_path, "p string, n long, kind string, item string", batches, lambda s: logs.known_prefix(s, "p", "n", "kind", "item"))
    assert {r["n"]: r["known"] for r in got} == {2: "c,b,a", 3: "b,a", 7: ""}


def test_stream_stops_early(spark, tmp_path):
    batches = [[("a", 0, 1), ("a", 1, 1), ("b", 0, 1)], [("b", 2, 1), ("b", 1, 0), ("b", 3, 0), ("a", 2, 0)]]
    got = feed(spark, tmp_path, "s string, n long, w int", batches, lambda s: logs.sequential_test(s, "s", "n", "w", [2, 4], 0.9, 0.1))
    assert {(r["s"], r["stage"], r["wins"], r["decision"]) for r in got} == {("a", 2, 2, "accept"), ("b", 4, 2, "undecided")}


def test_counts_end_with_their_time_to_live(spark, tmp_path):
    batches = [[("a", 0, 1)], [("a", 1, 1)], [("a", 2, 1)]]
    got = feed(spark, tmp_path, "s string, n long, w int", batches, lambda s: logs.sequential_test(s, "s", "n", "w", [2], 0.9, 0.1, ttl_hours=1e-6), empty_batches=False)
    assert got == []


@pytest.mark.parametrize("entered", [False, True])
def test_replayed_batches_change_nothing(spark, tmp_path, entered):
    """The run stops between writing and commit, or after the commit before the stream itself has noted it."""
    path, schema = str(tmp_path / "out"), "k long, v string"
    spark.createDataFrame([(i % 8, f"v{i % 8}") for i in range(16)], schema).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))

    def stop(*_):
        raise InterruptedError("stopped")

    with pytest.raises(StreamingQueryException):
        logs.append_sink(stream, path, ["k"], str(tmp_path / "state"), None if entered else stop, stop if entered else None)
    assert (logs.committed(spark, path) is None) != entered
    for _ in range(2):
        logs.append_sink(stream, path, ["k"], str(tmp_path / "state"))
        assert sorted(tuple(r) for r in logs.committed(spark, path).collect()) == [(i, f"v{i}") for i in range(8)]
    spark.createDataFrame([(3, "again"), (9, "v9"), (9, "v9")], schema).write.mode("append").parquet(str(tmp_path / "in"))
    logs.append_sink(stream, path, ["k"], str(tmp_path / "state"))
    logs.append_sink(stream, path, ["k"], str(tmp_path / "anew"))
    assert sorted(tuple(r) for r in logs.committed(spark, path).collect()) == [(i, f"v{i}") for i in (*range(8), 9)]
