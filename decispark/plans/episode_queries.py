"""Episodes, routes, streams of events and sampling, bound to conversations, orders, events and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from decispark.functions import scalar, walks
from decispark.operators import episodes, sampling
from decispark.sources import shared
from decispark.streaming import logs

from .registry import load, query
from .trial_queries import r


PILES = """WITH RECURSIVE s AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, CASE event_type WHEN 'purchase' THEN 'shuffle' WHEN 'click' THEN 'draw' WHEN 'error' THEN 'draw' ELSE 'push' END AS kind FROM events),
f(user_id, i, known) AS (SELECT DISTINCT user_id, 0::BIGINT, []::VARCHAR[] FROM s UNION ALL SELECT f.user_id, f.i + 1, CASE kind WHEN 'shuffle' THEN []::VARCHAR[] WHEN 'draw' THEN known[2:] ELSE list_prepend(event_id::VARCHAR, known) END FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1)
"""


@query("a17_w04_episode_summary", """SELECT conv_id, count(*) AS decisions, max(turn) AS last_step, arg_max(role, turn) AS last_role, count(*) FILTER (WHERE role = 'user') AS user_turns, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1""")
def a17(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").withColumn("n", F.length("text").cast("long"))
    return episodes.episode_summary(c, "conv_id", "turn", ["role"], {"user_turns": F.col("role") == "user"}, {"chars": "n"})


@query("a18_outcome_report", """SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN 'all' ELSE 'scenario' END AS view, o_orderpriority AS scenario, count(*) AS episodes, count(*) FILTER (WHERE o_orderstatus = 'O') AS wins,
round(avg((o_orderstatus = 'O')::INT), 6) AS win_rate, round(avg(o_totalprice), 3) AS mean_loss, round(median(o_totalprice), 3) AS median_loss, min(o_totalprice) AS least_loss, max(o_totalprice) AS most_loss, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 3) AS win_loss
FROM orders GROUP BY GROUPING SETS ((), (o_orderpriority))""")
def a18(spark, sf_dir):
    d = episodes.outcome_report(load(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", "O", "o_totalprice")
    return d.select("view", "scenario", "episodes", "wins", r("win_rate"), r("mean_loss", 3), r("median_loss", 3), "least_loss", "most_loss", r("win_loss", 3))


@query("a18_outcome_histogram", "SELECT o_orderpriority, o_orderstatus, count(*) AS episodes FROM orders GROUP BY ALL")
def a18_hist(spark, sf_dir):
    return episodes.outcome_histogram(load(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus")


@query("a19_route_combat_summary", "SELECT o_custkey, count(*) AS decisions, max(o_orderdate) AS last_step, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS last_o_orderstatus, count(*) FILTER (WHERE o_orderstatus = 'F') AS lost, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def a19(spark, sf_dir):
    o = load(spark, sf_dir, "orders").withColumn("step", F.struct("o_orderdate", "o_orderkey"))
    d = episodes.episode_summary(o, "o_custkey", "step", ["o_orderstatus"], {"lost": F.col("o_orderstatus") == "F"}, {"total": "o_totalprice"})
    return d.withColumn("last_step", F.col("last_step.o_orderdate")).withColumn("total", F.round("total", 2))


@query("w01_s03_contiguity", "SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber - 1) AS distinct_steps, min(l_linenumber - 1) AS first, max(l_linenumber - 1) AS last FROM lineitem GROUP BY 1 HAVING min(l_linenumber - 1) <> 0 OR max(l_linenumber - 1) <> count(*) - 1 OR count(DISTINCT l_linenumber) <> count(*)")
def w01(spark, sf_dir):
    return episodes.contiguous(load(spark, sf_dir, "lineitem").withColumn("step", F.col("l_linenumber") - 1), "l_orderkey", "step")


@query("w01_contiguous_conversations", "SELECT conv_id, count(*) AS n, count(DISTINCT turn) AS distinct_steps, min(turn) AS first, max(turn) AS last FROM conversations WHERE NOT (turn = 1 AND conv_id % 7 = 0) GROUP BY 1 HAVING min(turn) <> 0 OR max(turn) <> count(*) - 1 OR count(DISTINCT turn) <> count(*)")
def w01c(spark, sf_dir):
    """Conversations without one of their turns, in one of seven."""
    return episodes.contiguous(load(spark, sf_dir, "conversations").where("not (turn = 1 and conv_id % 7 = 0)"), "conv_id", "turn")


@query("w02_j12_turn_starts", "SELECT event_id, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) <> event_type, true) AS turn_start FROM events")
def w02(spark, sf_dir):
    return episodes.turn_starts(load(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "turn_start")


R = """WITH s AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS position, o_orderstatus = 'F' AS lost FROM orders),
routes AS (SELECT o_custkey, count(*) AS planned, min(position) FILTER (WHERE lost) AS death, coalesce(min(position) FILTER (WHERE lost) - 1, count(*)) AS won FROM s GROUP BY 1)
"""


def _routes(spark, sf_dir):
    return episodes.route_deaths(load(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], F.col("o_orderstatus") == "F")


@query("a20_route_deaths", R + "SELECT * FROM routes")
def a20(spark, sf_dir):
    return _routes(spark, sf_dir)


@query("a20_a38_arm_summary", R + "SELECT count(*) AS routes, count(*) FILTER (WHERE death IS NULL) AS completed, count(*) FILTER (WHERE planned >= 3 AND won >= 2) AS boss_arrivals, count(*) FILTER (WHERE planned >= 3 AND won >= 3) AS boss_wins, round(avg(death), 6) AS mean_death, count(DISTINCT death) AS death_positions FROM routes")
def a20s(spark, sf_dir):
    return episodes.arm_summary(_routes(spark, sf_dir), 3).withColumn("mean_death", F.round("mean_death", 6))


V = R + """, d AS (SELECT death AS position, count(*) AS deaths FROM routes WHERE death IS NOT NULL GROUP BY 1),
g AS (SELECT p::INT AS position, coalesce(deaths, 0) AS deaths FROM range(1, 9) v(p) LEFT JOIN d ON d.position = p),
a AS (SELECT *, (SELECT count(*) FROM routes) - coalesce(sum(deaths) OVER (ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS arrivals FROM g)
"""


@query("a23_w08_survival", V + "SELECT position, deaths, arrivals, arrivals - deaths AS wins, round((arrivals - deaths) / nullif(arrivals, 0), 6) AS win_rate FROM a")
def a23(spark, sf_dir):
    return episodes.survival(_routes(spark, sf_dir), 8).withColumn("win_rate", F.round("win_rate", 6))


@query("a23_floors", V + ", f AS (SELECT CASE WHEN position <= 2 THEN 'normal' ELSE 'late' END AS family, sum(arrivals - deaths)::BIGINT AS wins, sum(arrivals)::BIGINT AS battles FROM a GROUP BY 1) SELECT family, wins, battles, round(wins / battles, 6) AS win_rate, round(wins / battles - 0.05, 6) AS floor FROM f")
def a23f(spark, sf_dir):
    d = episodes.floors(episodes.survival(_routes(spark, sf_dir), 8), F.when(F.col("position") <= 2, "normal").otherwise("late"), 0.05)
    return d.select("family", "wins", "battles", r("win_rate"), r("floor"))


@query("w12_remaining", "SELECT o_orderkey, count(*) OVER w0 - row_number() OVER w1 AS \"left\", round((count(*) OVER w0 - row_number() OVER w1) / count(*) OVER w0, 6) AS horizon FROM orders WINDOW w0 AS (PARTITION BY o_custkey), w1 AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def w12(spark, sf_dir):
    return episodes.remaining(load(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "left", r("horizon"))


@query("q07_truncated", "SELECT event_id, CASE WHEN count(*) OVER (PARTITION BY user_id) > 20 THEN 'truncated' ELSE 'completed' END AS status FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 20")
def q07(spark, sf_dir):
    return episodes.truncated(load(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 20).select("event_id", "status")


@query("q06_carry_over", """WITH RECURSIVE s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, value - 60 AS c FROM events),
f(user_id, i, hp, steps) AS (SELECT DISTINCT user_id, 0::BIGINT, 80.0::DOUBLE, 0 FROM s UNION ALL SELECT f.user_id, f.i + 1, CASE WHEN f.hp > 0 THEN greatest(0.0, least(80.0, f.hp + s.c)) ELSE f.hp END, f.steps + (f.hp > 0)::INT FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1)
SELECT user_id, round(hp, 6) AS ending_hp, steps AS steps_done, CASE WHEN hp > 0 THEN 'completed' ELSE 'defeated' END AS status FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1""")
def q06(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("change", F.col("value") - 60)
    return episodes.carry_over(e, "user_id", "event_id", "change", 80.0, 80.0).withColumn("ending_hp", F.round("ending_hp", 6))


def _piles(e):
    kind = F.when(F.col("event_type") == "purchase", "shuffle").when(F.col("event_type").isin("click", "error"), "draw").otherwise("push")
    return e.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), F.col("event_id").cast("string").alias("item"))


@query("q04_known_prefix", PILES + "SELECT user_id, array_to_string(known, ',') AS known FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1")
def q04(spark, sf_dir):
    e = _piles(load(spark, sf_dir, "events"))
    return episodes.known_prefix(e, "user_id", "event_id", "kind", "item").select("user_id", F.array_join("known", ",").alias("known"))


@query("q02_advancing", "SELECT event_id, value FROM events QUALIFY coalesce(value > max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)")
def q02(spark, sf_dir):
    return episodes.advancing(load(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", "value")


CORRELATED = """WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'play_card' WHEN 'signup' THEN 'end_turn' ELSE 'snapshot' END AS kind, 'c' || event_id % 4 AS item, event_id // 40 AS turn, ['c' || event_id % 3, 'c' || event_id % 7] AS hand FROM events),
l AS (SELECT *, max(event_id) FILTER (WHERE kind <> 'snapshot') OVER (PARTITION BY user_id ORDER BY event_id) AS asked FROM e),
s AS (SELECT l.*, CASE WHEN a.kind = 'play_card' THEN NOT list_contains(l.hand, a.item) ELSE l.turn > a.turn END AS shows FROM l LEFT JOIN e a ON a.user_id = l.user_id AND a.event_id = l.asked WHERE l.kind = 'snapshot'),
g AS (SELECT *, min(event_id) FILTER (WHERE shows) OVER (PARTITION BY user_id, asked) AS first FROM s)
SELECT user_id, event_id, CASE WHEN asked IS NULL OR event_id > first THEN 'unasked' WHEN event_id = first THEN 'advanced' ELSE 'stale' END AS status FROM g"""


def _commands(e):
    """Events as commands and snapshots of a game."""
    i, name = F.col("event_id"), lambda n: F.concat(F.lit("c"), (F.col("event_id") % n).cast("string"))
    kind = F.when(F.col("event_type") == "click", "play_card").when(F.col("event_type") == "signup", "end_turn").otherwise("snapshot")
    return e.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), name(4).alias("item"), F.floor(i / 40).alias("turn"), F.array(name(3), name(7)).alias("hand"))


@query("q02_correlated", CORRELATED)
def q02c(spark, sf_dir):
    return episodes.correlated(_commands(load(spark, sf_dir, "events")), "user_id", "event_id").select("user_id", "event_id", "status")


@query("a33_range_summary", "SELECT event_type, min(value) AS least, max(value) AS most, count(DISTINCT value) AS distinct_values FROM events GROUP BY 1")
def a33(spark, sf_dir):
    return episodes.range_summary(load(spark, sf_dir, "events"), "event_type", "value")


@query("a32_token_summary", "SELECT role, min(length(text)) AS least, max(length(text)) AS most, count(DISTINCT length(text)) AS distinct_values FROM conversations GROUP BY 1")
def a32(spark, sf_dir):
    return episodes.range_summary(load(spark, sf_dir, "conversations").withColumn("n", F.length("text").cast("long")), "role", "n")


# sampling

U = "('0x' || substr(sha256({}), 1, 16))::UBIGINT::DOUBLE / pow(2.0, 64)"


@query("x07_seed_for", "SELECT doc_id, ('0x' || substr(sha256('[7,' || doc_id || ']'), 1, 8))::BIGINT AS seed FROM documents")
def x07(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", scalar.seed_for(F.concat(F.lit("[7,"), F.col("doc_id").cast("string"), F.lit("]"))).alias("seed"))


@query("x08_r03_hash_bernoulli", f"SELECT doc_id, round({U.format(chr(39) + '3|' + chr(39) + ' || doc_id')}, 9) AS draw, {U.format(chr(39) + '3|' + chr(39) + ' || doc_id')} < 0.25 AS selected FROM documents")
def x08(spark, sf_dir):
    return sampling.hash_bernoulli(load(spark, sf_dir, "documents"), F.col("doc_id"), 3, 0.25).select("doc_id", r("draw", 9), "selected")


@query("r04_r08_hash_sample", "SELECT lang, doc_id, round(least(1.0, 5 / count(*) OVER (PARTITION BY lang)), 6) AS inclusion FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sha256('4|' || doc_id), doc_id) <= 5")
def r04(spark, sf_dir):
    return sampling.hash_sample(load(spark, sf_dir, "documents"), ["lang"], "doc_id", 4, 5).select("lang", "doc_id", r("inclusion"))


@query("k04_k05_smoke_rows", """WITH l AS (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 1), h AS (SELECT doc_id FROM documents ORDER BY sha256('9|' || doc_id), doc_id LIMIT 20)
SELECT doc_id, 'longest' AS why FROM l UNION ALL SELECT doc_id, 'hash' FROM h WHERE doc_id NOT IN (SELECT doc_id FROM l)""")
def k04(spark, sf_dir):
    return sampling.smoke_rows(load(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 9, 20).select("doc_id", "why")


@query("r06_epoch_order", "SELECT epoch, p_partkey, row_number() OVER (PARTITION BY epoch ORDER BY sha256('2|' || epoch || '|' || p_partkey), p_partkey) - 1 AS place FROM part CROSS JOIN (VALUES (0), (1), (2)) v(epoch)")
def r06(spark, sf_dir):
    return sampling.epoch_order(load(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 3, 2).select("epoch", "p_partkey", "place")


@query("r05_bag_draws", """WITH n AS (SELECT n_regionkey, n_nationkey, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation), b AS (SELECT n.*, bag FROM n, range(0, 12) v(bag) WHERE bag <= 11 // n),
p AS (SELECT *, bag * n + row_number() OVER (PARTITION BY n_regionkey, bag ORDER BY sha256('6|' || bag || '|' || n_nationkey), n_nationkey) - 1 AS place FROM b)
SELECT n_regionkey, place, bag, n_nationkey FROM p WHERE place < 12""")
def r05(spark, sf_dir):
    return sampling.bag_draws(load(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey"), "n_regionkey", "n_nationkey", 12, 6)


@query("k06_r09_tier_pick", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, sha256('8|' || o_orderkey), o_orderkey) = 1")
def k06(spark, sf_dir):
    return sampling.tier_pick(load(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "o_orderkey", 8).select("o_custkey", "o_orderkey")


@query("r13_r10_derived_seeds", "SELECT n_nationkey, world, ('0x' || substr(sha256('100|' || n_nationkey || '|' || world), 1, 8))::BIGINT AS seed FROM nation CROSS JOIN (VALUES (0), (1), (2), (3)) v(world)")
def r13(spark, sf_dir):
    return sampling.derived_seeds(load(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey", 4, 100)


@query("r02_rarest_tag", """WITH l AS (SELECT o_custkey, o_orderkey, unnest([o_orderstatus, o_orderpriority]) AS tag FROM orders), n AS (SELECT o_custkey, tag, count(*) AS n FROM l GROUP BY ALL)
SELECT o_custkey, o_orderkey, tag AS bucket, n AS frequency FROM l JOIN n USING (o_custkey, tag) QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderkey ORDER BY n, tag) = 1""")
def r02(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.array("o_orderstatus", "o_orderpriority").alias("tags"))
    return sampling.rarest_tag(o, "o_custkey", ["o_orderkey"], "tags")


@query("r01_mixture_sample")
def r01(spark, sf_dir):
    """Each draw depends on the ones before; tests hold it against its own probabilities."""
    e = episodes.turn_starts(load(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")
    e = e.withColumn("bucket", F.when(F.col("value") > 50, F.col("event_type"))).withColumn("key", F.col("event_id").cast("string"))
    return sampling.mixture_sample(e, "user_id", "key", 4, 5)


@query("r11_staged_steps", "SELECT * FROM (VALUES (0, 'start', 'combat', 0), (0, 'start', 'combat', 1), (0, 'start', 'reward', 2), (1, 'end', 'combat', 3)) v(stage, checkpoint, kind, place)")
def r11(spark, sf_dir):
    return sampling.staged_steps(spark, [("start", {"combat": 2, "reward": 1}), ("end", {"combat": 1, "reward": 0})])


@query("t18_expanding_draw", """WITH RECURSIVE p AS (SELECT o_custkey AS g, o_orderkey AS item, o_orderpriority AS role, CASE WHEN o_orderstatus = 'P' THEN '1-URGENT' END AS need, o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey) AS anchor, sha256('12|' || o_custkey || '|' || o_orderkey) AS h FROM orders),
f(g, i, items, roles, item, role) AS (
  SELECT g, 0, [item], [role], item, role FROM p WHERE anchor
  UNION ALL
  SELECT g, i, items, roles, item, role FROM (
    SELECT f.g, f.i + 1 AS i, list_append(f.items, p.item) AS items, list_distinct(list_append(f.roles, p.role)) AS roles, p.item, p.role,
           row_number() OVER (PARTITION BY f.g ORDER BY CASE WHEN len(f.roles) < 3 AND NOT list_contains(f.roles, p.role) THEN 0 ELSE 1 END, p.h) AS place
    FROM f JOIN p ON p.g = f.g WHERE f.i < 4 AND NOT list_contains(f.items, p.item) AND (p.need IS NULL OR list_contains(f.roles, p.need))) WHERE place = 1)
SELECT g AS o_custkey, i AS draw_index, item::VARCHAR AS o_orderkey, role AS o_orderpriority FROM f""")
def t18(spark, sf_dir):
    """Five orders of each customer, the first of them fixed, of three priorities if there are; orders in process wait for an urgent one."""
    from pyspark.sql import Window as W

    o = load(spark, sf_dir, "orders").withColumn("anchor", F.col("o_orderkey") == F.min("o_orderkey").over(W.partitionBy("o_custkey"))).withColumn("need", F.when(F.col("o_orderstatus") == "P", "1-URGENT"))
    return sampling.expanding_draw(o, "o_custkey", "o_orderkey", "o_orderpriority", 5, 3, 12, "anchor", "need")


@query("udtf_walked_turns", """WITH w AS (SELECT conv_id, turn, role, length(text) AS n, count(*) FILTER (WHERE role = 'user') OVER o AS asked, sum(length(text)) OVER o AS chars, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))
SELECT conv_id, turn, asked, chars::BIGINT AS chars, 'answer' AS kind FROM w WHERE role = 'assistant' AND before = 'user' UNION ALL SELECT conv_id, max(turn) + 1, max(asked), sum(n)::BIGINT, 'end' FROM w GROUP BY 1""")
def udtf_walk(spark, sf_dir):
    """What a consumer sees that walks each conversation: every answer with what came before it, and the end."""

    def step(s, row):
        s = {"conv": row["conv_id"], "turn": row["turn"], "asked": s["asked"] + (row["role"] == "user"), "chars": s["chars"] + len(row["text"] or ""), "last": row["role"], "before": s["last"]}
        seen = [(s["conv"], s["turn"], s["asked"], s["chars"], "answer")] if s["last"] == "assistant" and s["before"] == "user" else []
        return s, seen

    start = lambda: {"asked": 0, "chars": 0, "last": None}
    finish = lambda s: [(s["conv"], s["turn"] + 1, s["asked"], s["chars"], "end")] if "conv" in s else []
    return walks.walked(load(spark, sf_dir, "conversations"), "conv_id", "turn", start, step, finish, "conv_id long, turn long, asked long, chars long, kind string")


# streams


def _stream(spark, sf_dir, name):
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet*")


def _finish(spark, stream, mode="append"):
    """Run a stream over what is there, into the session's shared folder."""
    folder = shared.shared_path(spark, "stream")
    logs.run_once(stream, f"{folder}/state", f"{folder}/out", mode)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query("q01_stream_append", "SELECT conv_id, turn, 'accepted' AS status FROM conversations UNION ALL SELECT conv_id, turn, 'duplicate' FROM conversations")
def q01(spark, sf_dir):
    """A stream that delivers every turn twice; an episode is forgotten an hour after its last turn."""
    c = _stream(spark, sf_dir, "conversations").select("conv_id", "turn", F.timestamp_seconds(F.lit(946_684_800) + F.col("turn") * 60).alias("at"))
    return _finish(spark, logs.next_steps(c.unionByName(c), "conv_id", "turn", "at", "1 hour"))


@query("q02_stream_advancing", "SELECT user_id, event_id, value FROM events QUALIFY coalesce(value > max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)")
def q02a(spark, sf_dir):
    e = _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _finish(spark, logs.advancing(e, "user_id", "event_id", "value", "ts", "1 day"))


@query("q02_stream_correlated", CORRELATED)
def q02sc(spark, sf_dir):
    return _finish(spark, logs.correlated(_commands(_stream(spark, sf_dir, "events")), "user_id", "event_id", "ts", "1 day"))


@query("q04_stream_known_prefix", PILES + "SELECT user_id, max(event_id) AS event_id, array_to_string(known, ',') AS known FROM f JOIN events USING (user_id) GROUP BY user_id, i, known QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1")
def q04s(spark, sf_dir):
    """What the last batch says of each user."""
    d = _finish(spark, logs.known_prefix(_piles(_stream(spark, sf_dir, "events")), "user_id", "event_id", "kind", "item", "ts", "1 day"))
    return d.groupBy("user_id").agg(F.max_by(F.struct("event_id", "known"), "event_id").alias("x")).select("user_id", "x.*")


@query("q05_stream_sequential_test", """WITH t AS (SELECT user_id, row_number() OVER w AS n, (count(*) FILTER (WHERE value > 20) OVER w) AS wins FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, n AS stage, wins, CASE WHEN wins / n >= 0.7 THEN 'accept' WHEN wins / n <= 0.5 THEN 'reject' ELSE 'undecided' END AS decision FROM t WHERE n IN (8, 16, 32) AND (wins / n >= 0.7 OR wins / n <= 0.5 OR n = 32) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n) = 1""")
def q05(spark, sf_dir):
    e = _stream(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") > 20).cast("int").alias("win"), F.col("ts").cast("timestamp").alias("ts"))
    return _finish(spark, logs.sequential_test(e, "user_id", "event_id", "win", [8, 16, 32], 0.7, 0.5, "ts", "1 day"))


@query("q03_stream_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL")
def q03(spark, sf_dir):
    d = _finish(spark, logs.windowed_counts(_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "1 hour", "1 hour"))
    return d.select(F.col("window.start").alias("start"), "event_type", "n")


@query("q02_stream_deduplicated", "SELECT event_id, event_type FROM events")
def q02s(spark, sf_dir):
    """A stream that delivers every event twice."""
    e = _stream(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return _finish(spark, logs.deduplicated(e.unionByName(e), ["event_id"], "ts", "1 hour").select("event_id", "event_type"))
