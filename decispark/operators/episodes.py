"""Episodes and routes: summaries, reports, survival, ordered checks, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def episode_summary(steps: DataFrame, episode: str, step: str, last: list[str], counts: dict[str, Column], sums: dict[str, str]) -> DataFrame:
    """Per episode: decisions, last step, the last row's columns, conditional counts and sums. One pass, one exchange."""
    final = F.max_by(F.struct(*last), step)
    d = steps.groupBy(episode).agg(F.count(F.lit(1)).alias("decisions"), F.max(step).alias("last_step"), final.alias("final"), *[F.count(F.when(c, 1)).alias(n) for n, c in counts.items()], *[F.sum(c).alias(n) for n, c in sums.items()])
    return d.select(episode, "decisions", "last_step", *[F.col("final")[c].alias(f"last_{c}") for c in last], *counts, *sums)


def outcome_report(episodes: DataFrame, scenario: str, outcome: str, victory: str, loss: str) -> DataFrame:
    """Overall (null scenario) and by scenario: episodes, wins, rate, mean, median, least and most loss, mean loss of wins."""
    won = F.col(outcome) == victory
    d = episodes.withColumn("view", F.explode(F.array(F.lit("all"), F.lit("scenario"))))
    key = F.when(F.col("view") == "scenario", F.col(scenario))
    return d.groupBy("view", key.alias("scenario")).agg(
        F.count(F.lit(1)).alias("episodes"), F.count(F.when(won, 1)).alias("wins"), F.avg(won.cast("double")).alias("win_rate"),
        F.avg(loss).alias("mean_loss"), F.median(loss).alias("median_loss"), F.min(loss).alias("least_loss"), F.max(loss).alias("most_loss"), F.avg(F.when(won, F.col(loss))).alias("win_loss"),
    )


def outcome_histogram(episodes: DataFrame, scenario: str, outcome: str) -> DataFrame:
    return episodes.groupBy(scenario, outcome).agg(F.count(F.lit(1)).alias("episodes"))


def contiguous(steps: DataFrame, episode: str, step: str) -> DataFrame:
    """Episodes whose steps are not 0, 1, 2, ... each once: their rows, distinct steps and range."""
    d = steps.groupBy(episode).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(step).alias("distinct_steps"), F.min(step).alias("first"), F.max(step).alias("last"))
    return d.where("first <> 0 or last <> n - 1 or distinct_steps <> n")


def turn_starts(steps: DataFrame, episode: str, order: list[str], turn: str) -> DataFrame:
    """steps with turn_start: the first of its episode, or of another turn than the row before."""
    before = F.lag(turn).over(W.partitionBy(episode).orderBy(*order))
    return steps.withColumn("turn_start", before.isNull() | (before != F.col(turn)))


def route_deaths(steps: DataFrame, route: str, order: list[str], lost: Column) -> DataFrame:
    """Per route: steps, the position of its first loss (null: completed), and steps won before it."""
    w = W.partitionBy(route).orderBy(*order)
    d = steps.withColumn("position", F.row_number().over(w)).withColumn("lost", lost)
    per = d.groupBy(route).agg(F.count(F.lit(1)).alias("planned"), F.min(F.when(F.col("lost"), F.col("position"))).alias("death"))
    return per.withColumn("won", F.coalesce(F.col("death") - 1, F.col("planned")))


def arm_summary(routes: DataFrame, boss: int) -> DataFrame:
    """Routes, completed ones, arrivals at and wins of the boss position, mean position of death."""
    arrived = (F.col("planned") >= boss) & (F.col("won") >= boss - 1)
    return routes.agg(
        F.count(F.lit(1)).alias("routes"), F.count(F.when(F.col("death").isNull(), 1)).alias("completed"), F.count(F.when(arrived, 1)).alias("boss_arrivals"),
        F.count(F.when(arrived & (F.col("won") >= boss), 1)).alias("boss_wins"), F.avg("death").alias("mean_death"), F.countDistinct("death").alias("death_positions"),
    )


def survival(routes: DataFrame, last: int) -> DataFrame:
    """Per position: arrivals, deaths, wins, win rate. Arrivals are the routes less all deaths before."""
    total = routes.count()
    deaths = routes.where(F.col("death").isNotNull()).groupBy(F.col("death").alias("position")).agg(F.count(F.lit(1)).alias("deaths"))
    grid = routes.sparkSession.range(1, last + 1).select(F.col("id").cast("int").alias("position"))
    d = grid.join(deaths, "position", "left").withColumn("deaths", F.coalesce("deaths", F.lit(0)))
    before = F.coalesce(F.sum("deaths").over(W.orderBy("position").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    d = d.withColumn("arrivals", F.lit(total) - before).withColumn("wins", F.col("arrivals") - F.col("deaths"))
    return d.withColumn("win_rate", F.expr("try_divide(wins, arrivals)"))


def floors(by_position: DataFrame, family: Column, margin: float) -> DataFrame:
    """Per family: wins, battles, rate, and the rate less a margin."""
    d = by_position.withColumn("family", family).groupBy("family").agg(F.sum("wins").alias("wins"), F.sum("arrivals").alias("battles"))
    return d.withColumn("win_rate", F.expr("try_divide(wins, battles)")).withColumn("floor", F.col("win_rate") - margin)


def remaining(steps: DataFrame, group: str, order: list[str]) -> DataFrame:
    """steps with the number of rows after each, and the share of them."""
    w = W.partitionBy(group)
    n = F.count(F.lit(1)).over(w)
    return steps.withColumn("left", n - F.row_number().over(w.orderBy(*order))).withColumn("horizon", F.col("left") / n)


def truncated(steps: DataFrame, episode: str, order: list[str], most: int) -> DataFrame:
    """The first `most` steps of each episode, with status truncated where there are more."""
    w = W.partitionBy(episode)
    d = steps.withColumn("place", F.row_number().over(w.orderBy(*order))).withColumn("status", F.when(F.count(F.lit(1)).over(w) > most, "truncated").otherwise("completed"))
    return d.where(F.col("place") <= most)


def carry_over(steps: DataFrame, route: str, order: str, change: str, start: float, most: float) -> DataFrame:
    """HP carried through each route's ordered changes, clamped to most, stopping at the first that leaves none.

    A fold over the ordered steps: clamping does not commute, so no running sum will do.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(change).cast("double").alias("c"))))

    def step(s: Column, x: Column) -> Column:
        hp = F.least(F.lit(most), s["hp"] + x["c"])
        alive = s["hp"] > 0
        return F.struct(F.when(alive, F.greatest(F.lit(0.0), hp)).otherwise(s["hp"]).alias("hp"), (s["steps"] + alive.cast("int")).alias("steps"))

    fold = F.aggregate("rows", F.struct(F.lit(float(start)).alias("hp"), F.lit(0).alias("steps")), step)
    d = steps.groupBy(route).agg(rows.alias("rows")).select(route, fold.alias("s"))
    return d.select(route, F.col("s.hp").alias("ending_hp"), F.col("s.steps").alias("steps_done"), F.when(F.col("s.hp") > 0, "completed").otherwise("defeated").alias("status"))


def known_prefix(events: DataFrame, key: str, order: str, kind: str, item: str) -> DataFrame:
    """What is known of the top of a pile after its events: put on top (push), taken (draw), forgotten (shuffle)."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(kind).alias("k"), F.col(item).alias("i"))))
    step = lambda s, x: F.when(x["k"] == "shuffle", F.array().cast("array<string>")).when(x["k"] == "draw", F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0)))).when(x["k"] == "push", F.concat(F.array(x["i"]), s)).otherwise(s)
    return events.groupBy(key).agg(rows.alias("rows")).select(key, F.aggregate("rows", F.array().cast("array<string>"), step).alias("known"))


def advancing(snapshots: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Snapshots whose value exceeds all before: stale and repeated ones go."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    before = F.max(value).over(w)
    return snapshots.withColumn("before", before).where(F.col("before").isNull() | (F.col(value) > F.col("before"))).drop("before")


def correlated(events: DataFrame, key: str, order: str) -> DataFrame:
    """Snapshots with status: advanced (the first that shows the last command's effect), stale, or unasked (no command waits).

    events: key, order (total), kind (play_card, end_turn or snapshot), item (the card that is played),
    turn and hand (array of cards, of a snapshot). A played card must have left the hand; the turn must have grown.
    """
    w = W.partitionBy(key).orderBy(order)
    asks = F.col("kind") != "snapshot"
    last = F.last(F.when(asks, F.struct(F.col(order).alias("at"), "kind", "item", "turn")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    d = events.withColumn("__asked", last).where(~asks)
    shows = F.when(F.col("__asked.kind") == "play_card", ~F.array_contains("hand", F.col("__asked.item"))).otherwise(F.col("turn") > F.col("__asked.turn"))
    first = F.min(F.when(F.coalesce(shows, F.lit(False)), F.col(order))).over(W.partitionBy(key, "__asked.at"))
    status = F.when(F.col("__asked").isNull() | (F.col(order) > first), "unasked").when(F.col(order) == first, "advanced").otherwise("stale")
    return d.withColumn("status", status).drop("__asked")


def range_summary(rows: DataFrame, stream: str, value: str) -> DataFrame:
    return rows.groupBy(stream).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.countDistinct(value).alias("distinct_values"))
