"""Logs as streams: append in step order, dropped repeats, stale snapshots, piles, early stopping, a sink.

Stateful operators keep a key's state until its delay has passed in event time (timers), or until
its time to live ends; then the state is gone. A key's rows of one batch are taken in the order of
their own column, not of their arrival; they are held together, so a batch should be bounded
by the source (maxFilesPerTrigger or maxBytesPerTrigger). Rows later than the watermark are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from decispark.sources.files import exists
from decispark.sources.shared import remove

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Keyed(StatefulProcessor):
    """State of a key in one row (schema `state`), dropped by a timer `delay_ms` after the key's last event, or `ttl_ms` after its last change."""

    state = ""
    delay_ms: int | None = None
    ttl_ms: int | None = None
    time: str | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("state", self.state, self.ttl_ms)

    def rows(self, frames: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
        return pd.concat(list(frames)).sort_values(order, kind="stable")

    def wait(self, rows: pd.DataFrame) -> None:
        """Keep the key until its delay has passed since its last event, whichever batch brought it."""
        if self.delay_ms is None:
            return
        due = int(rows[self.time].max().timestamp() * 1000) + self.delay_ms
        old = [int(t[0] if isinstance(t, tuple) else t) for t in self.handle.listTimers()]
        if not old or due > max(old):
            for t in old:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        rest = self.rest(key)
        self.value.clear()
        if rest is not None:
            yield rest

    def rest(self, key: tuple) -> pd.DataFrame | None:
        """What a key still has to say when its state goes."""

    def close(self) -> None:
        pass


def _stateful(rows: DataFrame, by: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    rows.sparkSession.conf.set(*PROVIDER)
    mode = "EventTime" if processor.delay_ms is not None else "ProcessingTime" if processor.ttl_ms is not None else "None"
    return rows.groupBy(by).transformWithStateInPandas(processor, schema, "Append", mode)


def _timed(rows: DataFrame, columns: list[str], time: str | None, delay: str | None) -> tuple[DataFrame, int | None]:
    """The columns that are needed, with a watermark, and the delay in milliseconds."""
    if time is None:
        return rows.select(*columns), None
    ms = rows.sparkSession.range(1).select((F.unix_millis(F.expr(f"timestamp'1970-01-01 00:00:00Z' + interval '{delay}'"))).alias("ms")).first()["ms"]
    return rows.select(*dict.fromkeys([*columns, time])).withWatermark(time, delay), ms


class _NextSteps(Keyed):
    state = "due long"

    def __init__(self, episode: str, step: str, time: str | None, delay_ms: int | None) -> None:
        self.episode, self.step, self.time, self.delay_ms = episode, step, time, delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.early = handle.getMapState("early", "step long", "seen boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        (due,) = self.value.get() if self.value.exists() else (0,)
        batch = self.rows(rows, [self.step])
        out, waiting = [], self.early.exists()
        for s in map(int, batch[self.step]):
            if s < due or (s > due and self.early.containsKey((s,))):
                out.append((s, "duplicate"))
            elif s > due:
                self.early.updateValue((s,), (True,))
                waiting = True
            else:
                out.append((s, "accepted"))
                due += 1
                while waiting and self.early.containsKey((due,)):
                    self.early.removeKey((due,))
                    out.append((due, "accepted"))
                    due += 1
        self.value.update((due,))
        self.wait(batch)
        if out:
            yield pd.DataFrame({self.episode: key[0], self.step: [s for s, _ in out], "status": [x for _, x in out]})

    def rest(self, key: tuple) -> pd.DataFrame | None:
        left = sorted(int(k[0]) for k in self.early.keys()) if self.early.exists() else []
        self.early.clear()
        return pd.DataFrame({self.episode: key[0], self.step: left, "status": "gap"}) if left else None


def next_steps(steps: DataFrame, episode: str, step: str, time: str | None = None, delay: str | None = None) -> DataFrame:
    """A stream's steps with status: accepted (all steps before it came), duplicate, or gap.

    A step that comes early waits for those before it; one whose predecessor has not come when the
    episode's delay ends is a gap. The state of an episode is the index that it waits for and the
    early steps; without a time column it is kept for good and gaps are never told.
    """
    d, ms = _timed(steps, [episode, step], time, delay)
    kind = steps.schema[episode].dataType.simpleString()
    return _stateful(d, episode, _NextSteps(episode, step, time, ms), f"{episode} {kind}, {step} long, status string")


def deduplicated(events: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """A stream's events, each key once; keys older than the delay are forgotten."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


class _Advancing(Keyed):
    state = "best double"

    def __init__(self, key: str, order: str, value: str, time: str | None, delay_ms: int | None) -> None:
        self.key, self.order, self.number, self.time, self.delay_ms = key, order, value, time, delay_ms

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best = self.value.get()[0] if self.value.exists() else None
        batch, out = self.rows(rows, [self.order]), []
        for place, v in zip(batch[self.order], batch[self.number], strict=True):
            if pd.notna(v) and (best is None or v > best):
                best = float(v)
                out.append((place, best))
        if best is not None:
            self.value.update((best,))
        self.wait(batch)
        if out:
            yield pd.DataFrame({self.key: key[0], self.order: [p for p, _ in out], self.number: [v for _, v in out]})


def advancing(snapshots: DataFrame, key: str, order: str, value: str, time: str | None = None, delay: str | None = None) -> DataFrame:
    """A stream's snapshots whose value exceeds all of its key before; the state is that value. A null value never advances."""
    d, ms = _timed(snapshots, [key, order, value], time, delay)
    kind = lambda c: snapshots.schema[c].dataType.simpleString()
    return _stateful(d, key, _Advancing(key, order, value, time, ms), f"{key} {kind(key)}, {order} {kind(order)}, {value} double")


class _Correlated(Keyed):
    state = "kind string, item string, turn long"

    def __init__(self, key: str, order: str, time: str | None, delay_ms: int | None) -> None:
        self.key, self.order, self.time, self.delay_ms = key, order, time, delay_ms

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pending = tuple(self.value.get()) if self.value.exists() else None
        batch, out = self.rows(rows, [self.order]), []
        for r in batch.itertuples(index=False):
            place, kind = getattr(r, self.order), r.kind
            turn = None if pd.isna(r.turn) else int(r.turn)
            if kind != "snapshot":
                pending = (kind, r.item, turn)
                continue
            if pending is None:
                status = "unasked"
            elif pending[0] == "play_card":
                status = "stale" if r.hand is None or pending[1] in list(r.hand) else "advanced"
            else:
                status = "advanced" if None not in (turn, pending[2]) and turn > pending[2] else "stale"
            if status == "advanced":
                pending = None
            out.append((place, status))
        if pending is None:
            self.value.clear()
        else:
            self.value.update(pending)
        self.wait(batch)
        if out:
            yield pd.DataFrame({self.key: key[0], self.order: [p for p, _ in out], "status": [s for _, s in out]})


def correlated(events: DataFrame, key: str, order: str, time: str | None = None, delay: str | None = None) -> DataFrame:
    """A stream's snapshots with status: advanced (the first that shows the last command's effect), stale, or unasked (no command waits).

    events: key, order, kind (play_card, end_turn or snapshot), item (the card that is played), turn
    and hand (array of cards, of a snapshot). A played card must have left the hand; the turn must have grown.
    """
    d, ms = _timed(events, [key, order, "kind", "item", "turn", "hand"], time, delay)
    kind = lambda c: events.schema[c].dataType.simpleString()
    return _stateful(d, key, _Correlated(key, order, time, ms), f"{key} {kind(key)}, {order} {kind(order)}, status string")


class _KnownPrefix(Keyed):
    state = "known array<string>"

    def __init__(self, key: str, order: str, kind: str, item: str, time: str | None, delay_ms: int | None) -> None:
        self.key, self.order, self.kind, self.item, self.time, self.delay_ms = key, order, kind, item, time, delay_ms

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # The top of the pile is the end of the list.
        known = list(self.value.get()[0])[::-1] if self.value.exists() else []
        batch = self.rows(rows, [self.order])
        for event, item in zip(batch[self.kind], batch[self.item], strict=True):
            if event == "push":
                known.append(str(item))
            elif event == "draw":
                known[-1:] = []
            elif event == "shuffle":
                known.clear()
        self.value.update((known[::-1],))
        self.wait(batch)
        yield pd.DataFrame({self.key: [key[0]], self.order: [batch[self.order].iloc[-1]], "known": [",".join(known[::-1])]})


def known_prefix(events: DataFrame, key: str, order: str, kind: str, item: str, time: str | None = None, delay: str | None = None) -> DataFrame:
    """The known top of each key's pile after every batch, with the order of its last event: push, draw and shuffle events in order."""
    d, ms = _timed(events, [key, order, kind, item], time, delay)
    of = lambda c: events.schema[c].dataType.simpleString()
    return _stateful(d, key, _KnownPrefix(key, order, kind, item, time, ms), f"{key} {of(key)}, {order} {of(order)}, known string")


class _SequentialTest(Keyed):
    state = "n long, wins long, done boolean"

    def __init__(self, sample: str, order: str, win: str, counts: list[int], accept: float, reject: float, time: str | None, delay_ms: int | None, ttl_ms: int | None) -> None:
        self.sample, self.order, self.win, self.counts, self.accept, self.reject = sample, order, win, counts, accept, reject
        self.time, self.delay_ms, self.ttl_ms = time, delay_ms, ttl_ms

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, wins, done = self.value.get() if self.value.exists() else (0, 0, False)
        batch, out = self.rows(rows, [self.order]), []
        if not done:
            for v in batch[self.win]:
                n, wins = n + 1, wins + int(v)
                rate = wins / n
                if n in self.counts and (rate >= self.accept or rate <= self.reject or n == self.counts[-1]):
                    done = True
                    out.append((n, wins, "accept" if rate >= self.accept else "reject" if rate <= self.reject else "undecided"))
                    break
            self.value.update((n, wins, done))
        self.wait(batch)
        if out:
            yield pd.DataFrame({self.sample: key[0], "stage": [x[0] for x in out], "wins": [x[1] for x in out], "decision": [x[2] for x in out]})


def sequential_test(trials: DataFrame, sample: str, order: str, win: str, counts: list[int], accept: float, reject: float, time: str | None = None, delay: str | None = None, ttl_hours: float | None = None) -> DataFrame:
    """Per sample the stage at which its rate of wins is decided: at one of the counts, at or above accept or at or below reject, else the last.

    A sample is forgotten when its delay has passed since its last trial; without event time, ttl_hours
    after its counts last changed (such a stream runs empty batches, see run_once).
    """
    d, ms = _timed(trials, [sample, order, win], time, delay)
    kind = trials.schema[sample].dataType.simpleString()
    processor = _SequentialTest(sample, order, win, counts, accept, reject, time, ms, None if ms is not None or ttl_hours is None else int(ttl_hours * 3_600_000))
    return _stateful(d, sample, processor, f"{sample} {kind}, stage long, wins long, decision string")


def windowed_counts(events: DataFrame, time: str, by: list[str], length: str, delay: str) -> DataFrame:
    """Events per window and group, complete up to the delay."""
    return events.withWatermark(time, delay).groupBy(F.window(time, length), *by).agg(F.count(F.lit(1)).alias("n"))


def run_once(stream: DataFrame, checkpoint: str, path: str, mode: str = "append", empty_batches: bool = True) -> None:
    """Process all that is there and stop; a later call with the same checkpoint goes on from there.

    empty_batches=False leaves out batches without data, which a stream with a time to live in processing
    time would otherwise run for ever; timers in event time need them.
    """
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, str(empty_batches).lower())
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).option("path", path).format("parquet").trigger(availableNow=True).start()
    finally:
        conf.set(name, before)
    query.awaitTermination()


def append_sink(stream: DataFrame, path: str, keys: list[str], checkpoint: str, before_commit: Callable[[str], None] | None = None, after_commit: Callable[[str], None] | None = None) -> None:
    """Append all that is there to a table at path, each key once, whatever batches are replayed.

    A batch is written to a folder of its own, then entered into the ledger; committed() reads only
    what the ledger names. A batch that was written and not entered is written again over itself; one that
    was entered is not written again. A key that an earlier batch brought is left out. The name of a batch
    holds the checkpoint's, so a stream begun anew is another one. before_commit is called between both writes,
    after_commit after them.
    """
    stream_name = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def write(batch: DataFrame, n: int) -> None:
        spark, name = batch.sparkSession, f"{stream_name}-{n}"
        if exists(spark, f"{path}/ledger/batch={name}"):
            return
        remove(spark, f"{path}/rows/batch={name}")
        known = committed(spark, path)
        fresh = batch.dropDuplicates(keys)
        if known is not None:
            fresh = fresh.join(known.select(*keys), keys, "left_anti")
        fresh.write.parquet(f"{path}/rows/batch={name}")
        if before_commit:
            before_commit(name)
        records = spark.read.schema(batch.schema).parquet(f"{path}/rows/batch={name}").count()
        spark.createDataFrame([(records,)], "records long").coalesce(1).write.mode("overwrite").json(f"{path}/ledger/batch={name}")
        if after_commit:
            after_commit(name)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def committed(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of all batches that the ledger names; None before the first."""
    if not exists(spark, f"{path}/ledger"):
        return None
    ledger = spark.read.schema("records long, batch string").json(f"{path}/ledger").where("records > 0").select("batch")
    if ledger.isEmpty():
        return None
    few = F.broadcast(ledger) if ledger.count() <= 100_000 else ledger
    rows = spark.read.parquet(f"{path}/rows")
    return rows.withColumn("batch", F.col("batch").cast("string")).join(few, "batch", "left_semi").drop("batch")
