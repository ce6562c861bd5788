"""Deterministic sampling: every draw is a hash of the row's key and a seed, so reruns agree anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from decispark.functions.scalar import bound, hash_uniform
from decispark.sources.shared import cut

# Channel weights of the mixture sampler.
CHANNELS = {"turn_start": 0.4, "event": 0.3, "random": 0.3}


def keyed(seed: int, *parts: Column) -> Column:
    """seed|part|part... as text."""
    return F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])


def hash_bernoulli(rows: DataFrame, key: Column, seed: int, p: float) -> DataFrame:
    """rows with draw in [0, 1) and selected: draw below p."""
    return rows.withColumn("draw", hash_uniform(keyed(seed, key))).withColumn("selected", F.col("draw") < p)


def hash_sample(rows: DataFrame, group: list[str], key: str, seed: int, n: int) -> DataFrame:
    """n rows of each group without replacement, by hash order; with the chance of inclusion.

    The rank alone decides, so every task keeps n rows of a group before the shuffle.
    """
    first = rows.withColumn("place", F.row_number().over(W.partitionBy(*group).orderBy(F.sha2(keyed(seed, F.col(key)), 256), key))).where(F.col("place") <= n)
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("group_rows"))
    same = [F.col(f"f.{g}").eqNullSafe(F.col(f"s.{g}")) for g in group]
    d = first.alias("f").join(sizes.alias("s"), same).select("f.*", "s.group_rows")
    return d.withColumn("inclusion", F.least(F.lit(1.0), F.lit(n) / F.col("group_rows"))).drop("group_rows")


def ordered_places(rows: DataFrame, order: list[Column | str], into: str = "place") -> DataFrame:
    """rows with their place, from 0, in one order over all of them.

    Spark deals rows out by ranges of the order and sorts each range; a place is one's number within
    its range and the rows of the ranges before. So no task sees all rows. order should be total.
    """
    d = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "places")
    part, inside = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = d.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__part", (F.sum("n").over(W.orderBy("__part")) - F.col("n")).alias("__before"))
    return d.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn(into, F.col("__before") + inside).select(*rows.columns, into)


def smoke_rows(rows: DataFrame, key: str, length: str, seed: int, n: int) -> DataFrame:
    """The longest row and the first n by hash, each once."""
    h = F.sha2(keyed(seed, F.col(key)), 256)
    longest = rows.orderBy(F.desc(length), key).limit(1).withColumn("why", F.lit("longest"))
    first = rows.orderBy(h, key).limit(n).withColumn("why", F.lit("hash"))
    return first.join(longest.select(key), key, "left_anti").select(*rows.columns, "why").unionByName(longest)


def epoch_order(rows: DataFrame, key: str, epochs: int, seed: int) -> DataFrame:
    """rows once per epoch with their place in it, in a new hash order each time."""
    d = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("__h", F.sha2(keyed(seed, F.col("epoch"), F.col(key)), 256))
    placed = ordered_places(d, ["epoch", "__h", key]).drop("__h")
    first = placed.groupBy("epoch").agg(F.min("place").alias("__first"))
    return placed.join(F.broadcast(first), "epoch").withColumn("place", F.col("place") - F.col("__first")).select(*rows.columns, "epoch", "place")


def bag_draws(items: DataFrame, group: str, item: str, draws: int, seed: int) -> DataFrame:
    """draws rows of each group from a shuffled bag that is refilled when empty: place, bag and item."""
    n = F.count(F.lit(1)).over(W.partitionBy(group))
    d = items.withColumn("n", n).withColumn("bag", F.explode(F.sequence(F.lit(0), F.floor(F.lit(draws - 1) / F.col("n")).cast("int"))))
    order = W.partitionBy(group, "bag").orderBy(F.sha2(keyed(seed, F.col("bag"), F.col(item)), 256), item)
    d = d.withColumn("place", F.col("bag") * F.col("n") + F.row_number().over(order) - 1)
    return d.where(F.col("place") < draws).select(group, "place", "bag", item)


def tier_pick(rows: DataFrame, group: str, tier: str, key: str, seed: int) -> DataFrame:
    """One row of the lowest tier of each group, by hash among equals."""
    w = W.partitionBy(group).orderBy(tier, F.sha2(keyed(seed, F.col(key)), 256), key)
    return rows.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def rarest_tag(rows: DataFrame, group: str, key: list[str], tags: str) -> DataFrame:
    """Each row's rarest tag within its group, the first by name among equals."""
    long = rows.select(group, *key, F.explode(tags).alias("tag"))
    n = long.groupBy(group, "tag").agg(F.count(F.lit(1)).alias("n"))
    return long.join(n, [group, "tag"]).groupBy(group, *key).agg(F.min(F.struct("n", "tag")).alias("x")).select(group, *key, F.col("x.tag").alias("bucket"), F.col("x.n").alias("frequency"))


def derived_seeds(keys: DataFrame, key: str, worlds: int, base: int) -> DataFrame:
    """world and seed for every key and world: 32 bits of the hash of base, key and world."""
    from decispark.functions.scalar import seed_for

    d = keys.withColumn("world", F.explode(F.sequence(F.lit(0), F.lit(worlds - 1))))
    return d.withColumn("seed", seed_for(keyed(base, F.col(key), F.col("world"))))


def _channel_orders(rows: DataFrame, group: str, count: int, seed: int) -> DataFrame:
    """The first `count` rows of each group, channel and bucket in a hash order of their own.

    A channel's next draw is the first row in its order that no channel has taken, which is as good
    as a uniform draw; count - 1 rows are taken before the last one, so no more rows are needed.
    """
    channel = F.explode(F.array_compact(F.array(F.lit("random"), F.when(F.col("turn_start"), F.lit("turn_start")), F.when(F.col("bucket").isNotNull(), F.lit("event")))))
    d = rows.withColumn("channel", channel).withColumn("of", F.when(F.col("channel") == "event", F.col("bucket")).otherwise(F.lit("")))
    d = d.withColumn("order", F.xxhash64(F.lit(seed), F.col("channel"), F.col(group), F.col("key")))
    return d.withColumn("rank", F.row_number().over(W.partitionBy(group, "channel", "of").orderBy("order", "key"))).where(F.col("rank") <= count)


def mixture_sample(rows: DataFrame, group: str, key: str, count: int, seed: int, weights: dict[str, float] | None = None) -> DataFrame:
    """count rows of each group without replacement: draw_index, channel and the draw's conditional probability.

    rows need group, key (unique in its group), turn_start (boolean) and bucket (text or null). A
    draw takes a turn start, a row of one of the group's buckets, or any row; a channel that is
    empty leaves its weight to the last. Counts are aggregated and orders cut to `count` rows before
    anything of a group meets; the draws are a fold over these few rows.
    """
    w = {**CHANNELS, **(weights or {})}
    if abs(sum(w.values()) - 1) > 1e-9 or w["random"] <= 0:
        raise ValueError("weights must sum to one with a positive random part")
    d = rows.select(group, F.col(key).cast("string").alias("key"), F.coalesce("turn_start", F.lit(False)).alias("turn_start"), "bucket").where("key is not null")
    by_bucket = d.groupBy(group, "bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if("turn_start").alias("starts"))
    sizes = by_bucket.groupBy(group).agg(
        F.sum("n").alias("n"), F.sum("starts").alias("starts"), F.array_sort(F.collect_list(F.when(F.col("bucket").isNotNull(), F.struct("bucket", "n")))).alias("buckets")
    )
    firsts = _channel_orders(d, group, count, seed).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("channel", "of", "rank", "key", "turn_start", "bucket"))).alias("firsts"))
    state = "array<struct<key:string,turn_start:boolean,bucket:string,channel:string,probability:double>>"

    def draw(taken: Column, i: Column) -> Column:
        left = lambda n, cond: n - F.size(F.filter(taken, cond))
        rest = left(F.col("n"), lambda t: F.lit(True))
        starts = left(F.col("starts"), lambda t: t["turn_start"])
        open_buckets = F.filter(F.transform("buckets", lambda b: F.struct(b["bucket"].alias("bucket"), left(b["n"], lambda t: F.coalesce(t["bucket"] == b["bucket"], F.lit(False))).alias("n"))), lambda b: b["n"] > 0)
        fields = F.struct(rest.alias("rest"), starts.alias("starts"), open_buckets.alias("buckets"))
        return bound(fields, lambda s: _one_draw(taken, i, s))

    def _one_draw(taken: Column, i: Column, s: Column) -> Column:
        p_start = F.when(s["starts"] > 0, w["turn_start"]).otherwise(0.0)
        p_event = F.when(F.size(s["buckets"]) > 0, w["event"]).otherwise(0.0)
        at = lambda what: hash_uniform(keyed(seed, F.col(group), i, F.lit(what)))
        name = lambda u: F.when(u < p_start, "turn_start").when(u < p_start + p_event, "event").otherwise("random")
        named = F.get(s["buckets"], F.floor(at("bucket") * F.size(s["buckets"])).cast("int"))["bucket"]

        def first(c: Column) -> Column:
            fits = lambda f: (f["channel"] == c["channel"]) & ((c["channel"] != "event") | (f["of"] == c["of"])) & ~F.exists(taken, lambda t: t["key"] == f["key"])
            return F.get(F.filter("firsts", fits), F.lit(0))

        def appended(c: Column, chosen: Column) -> Column:
            of_bucket = F.get(F.filter(s["buckets"], lambda b: b["bucket"] == chosen["bucket"]), F.lit(0))["n"]
            chance = (1 - p_start - p_event) / s["rest"] + F.when(chosen["turn_start"], F.try_divide(p_start, s["starts"])).otherwise(0.0) + F.coalesce(F.try_divide(F.try_divide(p_event, F.size(s["buckets"])), of_bucket), F.lit(0.0))
            return F.array_append(taken, F.struct(chosen["key"].alias("key"), chosen["turn_start"].alias("turn_start"), chosen["bucket"].alias("bucket"), c["channel"].alias("channel"), chance.alias("probability")))

        choice = F.struct(bound(at("channel"), name).alias("channel"), named.alias("of"))
        return bound(choice, lambda c: bound(first(c), lambda chosen: appended(c, chosen)))

    steps = F.sequence(F.lit(0), (F.least(F.col("n"), F.lit(count)) - 1).cast("int"))
    drawn = sizes.join(firsts, group).withColumn("drawn", F.aggregate(steps, F.array().cast(state), draw))
    return drawn.select(group, F.posexplode("drawn").alias("draw_index", "x")).select(group, F.col("x.key").alias(key), "draw_index", "x.channel", "x.probability")


def staged_steps(spark, stages: list[tuple[str, dict[str, int]]]) -> DataFrame:
    """Ordered step rows of checkpoint quotas: stage, checkpoint, kind and place."""
    rows = [(i, name, j, kind, n) for i, (name, quota) in enumerate(stages) for j, (kind, n) in enumerate(quota.items())]
    d = spark.createDataFrame(rows, "stage int, checkpoint string, part int, kind string, n int").where("n > 0")
    d = d.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return d.select("stage", "checkpoint", "kind", (F.row_number().over(W.orderBy("stage", "part", "copy")) - 1).alias("place"))


def bootstrap(rows: DataFrame, cluster: str, value: str, replicates: int, seed: int) -> DataFrame:
    """replicate and mean: the mean over as many clusters as there are, drawn with replacement.

    Clusters are placed in one order by ranges; each draw is a hash of its replicate and number and names
    a place. The draws of a replicate are spread over all tasks, counted by place and joined to the clusters' sums.
    """
    per = rows.groupBy(F.col(cluster).alias("cluster")).agg(F.sum(value).alias("total"), F.count(value).alias("n"))
    placed = cut(ordered_places(per, ["cluster"]), "clusters")
    n = placed.count()
    draws = rows.sparkSession.range(replicates * n).select(F.floor(F.col("id") / n).cast("int").alias("replicate"), (F.col("id") % n).alias("i"))
    draws = draws.select("replicate", F.floor(hash_uniform(keyed(seed, F.col("replicate"), F.col("i"))) * n).alias("place"))
    counts = draws.groupBy("replicate", "place").agg(F.count(F.lit(1)).alias("k"))
    return counts.join(placed, "place").groupBy("replicate").agg(F.expr("try_divide(sum(k * total), sum(k * n))").alias("mean"))


def expanding_draw(pool: DataFrame, group: str, item: str, role: str, count: int, roles: int, seed: int, anchor: str | None = None, requires: str | None = None) -> DataFrame:
    """count items of each group without replacement, drawn so that their roles spread: group, draw_index, item, role.

    Anchors (a boolean column) come first, in the order of their names. Then, as long as fewer than `roles`
    roles are there, only items of a new role are drawn, if there are any. An item that requires a role
    (a column, null for none) joins the pool once an item of that role is drawn. Every draw takes the first
    open item in the group's hash order, which is as good as a uniform draw. Repeated and null items count once
    and never; groups of fewer open items give fewer draws; more anchors than count are an error.

    Of items of one role and requirement only the first `count` in hash order can be drawn, so the
    others go before a group meets.
    """
    need = F.col(requires).cast("string") if requires else F.lit(None).cast("string")
    d = pool.where(F.col(item).isNotNull()).select(F.col(group).alias("g"), F.col(item).cast("string").alias("item"), F.col(role).cast("string").alias("role"), need.alias("need"), F.coalesce(F.col(anchor), F.lit(False)).alias("anchor") if anchor else F.lit(False).alias("anchor"))
    d = d.groupBy("g", "item").agg(F.min(F.struct((~F.col("anchor")).alias("late"), "role", "need")).alias("x")).select("g", "item", "x.role", "x.need", (~F.col("x.late")).alias("anchor"))
    d = d.withColumn("order", F.when(F.col("anchor"), F.col("item")).otherwise(F.sha2(keyed(seed, F.col("g"), F.col("item")), 256)))
    near = d.withColumn("rank", F.row_number().over(W.partitionBy("g", "anchor", "role", "need").orderBy("order", "item"))).where((F.col("rank") <= count) | F.col("anchor"))
    items = near.groupBy("g").agg(F.array_sort(F.collect_list(F.struct((~F.col("anchor")).alias("late"), "order", "item", "role", "need"))).alias("items"))
    many = F.raise_error(F.concat(F.lit("more anchors than draws in "), F.coalesce(F.col("g").cast("string"), F.lit("null")))).cast("int")
    fixed = F.filter("items", lambda x: ~x["late"])
    taken = F.transform(fixed, lambda x: F.struct(x["item"].alias("item"), x["role"].alias("role")))

    def draw(done: Column, _: Column) -> Column:
        open_items = lambda there: F.filter("items", lambda x: ~F.exists(done, lambda t: t["item"] == x["item"]) & (x["need"].isNull() | F.array_contains(there, x["need"])))
        new = lambda there, free: F.get(F.filter(free, lambda x: (F.size(there) < roles) & ~F.exists(there, lambda t: t.eqNullSafe(x["role"]))), F.lit(0))
        first = lambda there: bound(open_items(there), lambda free: F.coalesce(new(there, free), F.get(free, F.lit(0))))
        append = lambda x: F.when(x.isNull(), done).otherwise(F.array_append(done, F.struct(x["item"].alias("item"), x["role"].alias("role"))))
        return bound(bound(F.array_distinct(F.transform(done, lambda t: t["role"])), first), append)

    left = F.when(F.size("taken") > count, many).otherwise(F.lit(count) - F.size("taken"))
    d = items.withColumn("taken", taken).withColumn("steps", F.when(left > 0, F.sequence(F.lit(1), left)).otherwise(F.slice(F.array(F.lit(1)), 1, 0)))
    drawn = d.select("g", F.aggregate("steps", F.col("taken"), draw).alias("drawn"))
    return drawn.select(F.col("g").alias(group), F.posexplode("drawn").alias("draw_index", "x")).select(group, "draw_index", F.col("x.item").alias(item), F.col("x.role").alias(role))
