"""Text, arrays and scalar functions, bound to documents, part, lineitem and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from decispark.functions import scalar
from decispark.operators import sampling, text, validation

from .registry import load, query
from .trial_queries import r


@query("x01_normalize_id", "SELECT p_partkey, nullif(trim(regexp_replace(upper(trim(p_name)), '[^A-Z0-9]+', '_', 'g'), '_'), '') AS id FROM part")
def x01(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", scalar.normalize_id(F.col("p_name")).alias("id"))


@query("x02_parse_percentage", "WITH s AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '--' WHEN 1 THEN '' WHEN 2 THEN '--%' ELSE p_size || '.5%' END AS x FROM part) SELECT p_partkey, CASE WHEN x IN ('--', '', '--%') THEN NULL ELSE round(rtrim(x, '%')::DOUBLE / 100, 9) END AS p FROM s")
def x02(spark, sf_dir):
    k = F.col("p_partkey") % 5
    x = F.when(k == 0, "--").when(k == 1, "").when(k == 2, "--%").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".5%")))
    return load(spark, sf_dir, "part").select("p_partkey", F.round(scalar.parse_percentage(x), 9).alias("p"))


@query("x03_odds", "SELECT p_partkey, CASE WHEN p_size = 50 THEN NULL ELSE round((p_size / 50.0) / (1 - p_size / 50.0), 6) END AS odds, p_size = 50 AS infinite FROM part")
def x03(spark, sf_dir):
    d = load(spark, sf_dir, "part").withColumn("o", scalar.odds(F.col("p_size") / 50.0))
    inf = F.col("o") == float("inf")
    return d.select("p_partkey", F.when(~inf, F.round("o", 6)).alias("odds"), inf.alias("infinite"))


@query("x04_rate_metric", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'duplicate' ELSE 'first' END || '_pick_rate_f' || (p_partkey % 3 + 1) AS metric FROM part")
def x04(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", scalar.act_rate_metric(F.col("p_partkey") % 3 + 1, F.col("p_size") > 25).alias("metric"))


@query("x05_x06_canonical_hash", """SELECT p_partkey, sha256('{"p_brand":"' || p_brand || '","p_partkey":' || p_partkey || ',"p_type":"' || p_type || '"}') AS h FROM part""")
def x05(spark, sf_dir):
    from decispark.sources.files import row_digest

    return load(spark, sf_dir, "part").select("p_partkey", row_digest(["p_type", "p_partkey", "p_brand"]).alias("h"))


@query("p08_semantic_hash", """SELECT p_partkey, sha256('{"p_brand":"' || p_brand || '","p_size":' || p_size || '}') AS h, count(*) OVER (PARTITION BY p_brand, p_size) AS same FROM part""")
def p08(spark, sf_dir):
    """Parts that differ in dropped columns alone share a hash."""
    from decispark.sources.files import semantic_digest
    from pyspark.sql import Window as W

    d = load(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_name").withColumn("h", semantic_digest(["p_partkey", "p_brand", "p_size", "p_name"], ["p_partkey", "p_name"]))
    return d.select("p_partkey", "h", F.count(F.lit(1)).over(W.partitionBy("h")).alias("same"))


@query("x09_fnv1a", """WITH b AS (SELECT p_partkey, hex(encode(p_name)) AS x FROM part)
SELECT p_partkey, list_reduce([14695981039346656037::HUGEINT] || list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::INT, 2))::HUGEINT), lambda a, b: (xor(a, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)::VARCHAR AS h FROM b""")
def x09(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", scalar.fnv1a64(F.col("p_name")).cast("string").alias("h"))


@query("x10_uint64", "SELECT p_partkey, (CASE WHEN p_partkey % 2 = 0 AND p_partkey > 0 THEN 18446744073709551616::HUGEINT - p_partkey ELSE p_partkey::HUGEINT END)::VARCHAR AS u FROM part")
def x10(spark, sf_dir):
    signed = F.when(F.col("p_partkey") % 2 == 0, -F.col("p_partkey")).otherwise(F.col("p_partkey"))
    return load(spark, sf_dir, "part").select("p_partkey", scalar.uint64(signed).cast("string").alias("u"))


@query("x11_v02_action_lines", "SELECT l_orderkey, count(*) AS n, bool_and(l_linenumber - 1 = i) AS fine FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS i FROM lineitem) GROUP BY 1")
def x11(spark, sf_dir):
    line = F.concat(F.lit("ACTION_"), (F.col("l_linenumber") - 1).cast("string"), F.lit(": part "), F.col("l_partkey").cast("string"))
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    d = text.numbered_lines(li, "l_orderkey", ["l_linenumber", "l_partkey"], line)
    n = F.size(F.split("text", "\n"))
    return d.select("l_orderkey", n.cast("long").alias("n"), validation.action_lines(F.col("text"), n).alias("fine"))


@query("x12_record_id", "SELECT conv_id, turn, printf('episode-%06d-decision-%04d', conv_id, turn) AS id FROM conversations")
def x12(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", scalar.record_id(F.col("conv_id"), F.col("turn")).alias("id"))


@query("x13_plain_key", "SELECT p_partkey, lower(regexp_replace(p_type, '[^A-Za-z0-9]', '', 'g')) AS key FROM part")
def x13(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", scalar.plain_key(F.col("p_type")).alias("key"))


@query("x14_x28_terminal", """WITH s AS (SELECT event_id, ((props::JSON ->> 'k')::INT) AS k FROM events) SELECT event_id, CASE WHEN k % 7 = 0 THEN 'aborted' WHEN k - 20 <= 0 THEN 'defeat' WHEN k % 3 = 0 THEN 'victory' END AS outcome FROM s""")
def x14(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    state = F.to_json(F.struct(F.when(k % 7 == 0, "x").alias("error"), (k - 20).alias("hp"), (k % 3).alias("monsters_alive"), F.lit("COMBAT").alias("screen")))
    return load(spark, sf_dir, "events").select("event_id", scalar.terminal_outcome(state).alias("outcome"))


@query("x15_x16_x21_tags", "SELECT p_partkey, concat_ws(',', CASE WHEN p_size > 30 THEN 'large' END, CASE WHEN p_type LIKE '%BRASS%' THEN 'brass' END, CASE WHEN p_retailprice > 1000 THEN 'dear' END) AS tags, CASE WHEN p_type LIKE 'STANDARD%' THEN 'power' WHEN p_size % 2 = 0 THEN 'one_shot' WHEN p_size % 3 = 0 THEN 'fleeting' ELSE 'lasting' END AS persistence FROM part")
def x15(spark, sf_dir):
    tags = scalar.pick_tags({"large": F.col("p_size") > 30, "brass": F.col("p_type").like("%BRASS%"), "dear": F.col("p_retailprice") > 1000})
    kind = F.when(F.col("p_type").startswith("STANDARD"), "POWER").otherwise("CARD")
    lasting = scalar.persistence(kind, F.col("p_size") % 2 == 0, F.col("p_size") % 3 == 0)
    return load(spark, sf_dir, "part").select("p_partkey", F.array_join(tags, ",").alias("tags"), lasting.alias("persistence"))


@query("x22_rounding", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice / 7, 3) AS x FROM lineitem")
def x22(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("l_extendedprice") / 7, 3).alias("x"))


@query("x25_p01_p04_snapshot_edit", """SELECT p_partkey, '{"name":"' || p_name || '","size":' || (p_size + 2) || ',"tags":["' || p_brand || '","new"]}' AS state FROM part""")
def x25(spark, sf_dir):
    s = F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.array("p_brand").alias("tags"), F.col("p_partkey").alias("decision_id"))
    edited = s.withField("size", s["size"] + 2).withField("tags", F.array_append(s["tags"], F.lit("new"))).dropFields("decision_id")
    return load(spark, sf_dir, "part").select("p_partkey", F.to_json(edited).alias("state"))


@query("t01_f04_legal_actions", """WITH m AS (SELECT o_orderkey, list(l_quantity > 20 ORDER BY l_linenumber, l_partkey, l_suppkey) AS alive FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1) SELECT o_orderkey, len(list_filter(alive, lambda x: x)) AS targets, 2 + len(list_filter(alive, lambda x: x)) AS actions FROM m""")
def t01(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    monster = F.struct((F.col("l_quantity") <= 0).alias("is_gone"), F.lit(False).alias("half_dead"), F.when(F.col("l_quantity") > 20, 1).otherwise(0).alias("hp"))
    states = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(monster).alias("monsters"))
    card = lambda name, aim: F.struct(F.lit(name).alias("name"), F.lit(True).alias("playable"), F.lit(aim).alias("has_target"))
    states = states.withColumn("hand", F.array(card("strike", True), card("block", False)))
    acts = text.legal_actions(states, "o_orderkey")
    return acts.groupBy("o_orderkey").agg(F.count("target").alias("targets"), F.count(F.lit(1)).alias("actions"))


C = """WITH c AS (SELECT l_orderkey, l_returnflag, l_linestatus, count(*) AS copies, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey::VARCHAR) AS members, arg_min(l_partkey::VARCHAR, (l_linenumber, l_partkey::VARCHAR)) AS representative FROM lineitem GROUP BY 1, 2, 3),
k AS (SELECT *, 'ACTION_' || (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag, l_linestatus) - 1) AS class_id FROM c)
"""


def _classes(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber", "l_partkey")
    return text.equivalence_classes(li, "l_orderkey", ["l_returnflag", "l_linestatus"], ["l_linenumber"], "l_partkey")


@query("t02_equivalence_classes", C + "SELECT * FROM k")
def t02(spark, sf_dir):
    return _classes(spark, sf_dir)


@query("t03_audit_rows", C + "SELECT l_orderkey, class_id, representative, unnest(range(0, copies))::INT AS place, unnest(string_split(members, ',')) AS member FROM k")
def t03(spark, sf_dir):
    return text.audit_rows(_classes(spark, sf_dir), "l_orderkey")


@query("p03_root_records", C + """SELECT l_orderkey, class_id AS id, CASE WHEN l_returnflag = 'A' THEN 'end_turn' ELSE l_returnflag END AS card, l_linestatus AS target, CASE WHEN l_returnflag = 'A' THEN 'end_turn' ELSE 'play_card' END AS action_type,
CASE WHEN l_returnflag <> 'A' THEN '{"l_returnflag":"' || l_returnflag || '","copies":' || copies || '}' END AS card_semantics FROM k""")
def p03(spark, sf_dir):
    ends = F.col("l_returnflag") == "A"
    d = _classes(spark, sf_dir).withColumn("kind", F.when(ends, "end_turn").otherwise("play_card")).withColumn("name", F.when(~ends, F.col("l_returnflag")))
    return text.root_records(d, "l_orderkey", "kind", "name", "l_linestatus", ["l_returnflag", "copies"]).withColumn("card_semantics", F.to_json("card_semantics"))


RULES = """WITH s AS (SELECT l_orderkey, list({'uuid': l_suppkey::VARCHAR, 'name': l_returnflag, 'playable': l_discount < 0.09, 'aims': l_linestatus = 'O'} ORDER BY l_linenumber, l_partkey, l_suppkey) AS hand, list(l_quantity > 5 ORDER BY l_linenumber, l_partkey, l_suppkey) AS alive FROM lineitem GROUP BY 1),
a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber - 1 AS i, CASE WHEN l_partkey % 11 = 0 THEN 'end_turn' ELSE 'play_card' END AS type, l_suppkey::VARCHAR AS uuid, CASE WHEN l_partkey % 7 = 0 THEN 'X' ELSE l_returnflag END AS name, CASE WHEN l_linestatus = 'O' OR l_partkey % 5 = 0 THEN (l_linenumber - 1 + l_partkey % 2)::INT END AS target FROM lineitem),
j AS (SELECT a.*, hand[i + 1] AS card, len(hand) AS n, i < len(hand) AS fits, alive[target + 1] AS alive, type = 'play_card' AS plays FROM a JOIN s USING (l_orderkey)),
r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, unnest(['hand_index', 'card_uuid', 'card_name', 'playable', 'no_target', 'target_index', 'target', 'end_turn']) AS rule,
  unnest([NOT plays OR fits, NOT plays OR NOT fits OR uuid = card.uuid, NOT plays OR NOT fits OR name = card.name, NOT plays OR NOT fits OR card.playable, NOT plays OR NOT fits OR card.aims OR target IS NULL,
          NOT plays OR NOT fits OR NOT card.aims OR coalesce(target < n, false), NOT plays OR NOT fits OR NOT card.aims OR alive IS NULL OR alive, plays]) AS ok FROM j)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, rule FROM r WHERE NOT coalesce(ok, false)"""


@query("p11_action_rules", RULES)
def p11(spark, sf_dir):
    """Line items as a hand and as monsters of their order; actions name cards and targets, some wrongly."""
    li = load(spark, sf_dir, "lineitem")
    order = ["l_linenumber", "l_partkey", "l_suppkey"]
    card = F.struct(F.col("l_suppkey").cast("string").alias("uuid"), F.col("l_returnflag").alias("name"), (F.col("l_discount") < 0.09).alias("playable"), (F.col("l_linestatus") == "O").alias("has_target"))
    monster = F.struct((F.col("l_quantity") <= 5).alias("is_gone"), F.lit(False).alias("half_dead"), F.lit(1).alias("hp"))
    items = F.array_sort(F.collect_list(F.struct(*order, card.alias("card"), monster.alias("monster"))))
    states = li.groupBy("l_orderkey").agg(items.alias("x")).select("l_orderkey", F.transform("x", lambda x: x["card"]).alias("hand"), F.transform("x", lambda x: x["monster"]).alias("monsters"))
    k = F.col("l_partkey")
    action = F.struct(
        F.when(k % 11 == 0, "end_turn").otherwise("play_card").alias("type"), (F.col("l_linenumber") - 1).cast("int").alias("hand_index"), F.col("l_suppkey").cast("string").alias("card_uuid"),
        F.when(k % 7 == 0, "X").otherwise(F.col("l_returnflag")).alias("card_name"), F.when((F.col("l_linestatus") == "O") | (k % 5 == 0), F.col("l_linenumber") - 1 + k % 2).cast("int").alias("target_index"),
    )
    d = li.select("l_orderkey", *order, action.alias("action")).join(states, "l_orderkey")
    return validation.broken(d, ["l_orderkey", *order], text.action_rules(F.col("action"), F.col("hand"), F.col("monsters")))


@query("t04_t05_observation_text", """SELECT n_regionkey, 'REGION:' || chr(10) || n_regionkey || chr(10) || chr(10) || 'NATIONS:' || chr(10) || string_agg('ACTION_' || n_nationkey || ': ' || n_name, chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY 1""")
def t04(spark, sf_dir):
    n = load(spark, sf_dir, "nation")
    d = text.numbered_lines(n, "n_regionkey", ["n_nationkey"], F.concat(F.lit("ACTION_"), F.col("n_nationkey").cast("string"), F.lit(": "), F.col("n_name")), "body")
    return d.select("n_regionkey", text.observation({"REGION": F.col("n_regionkey").cast("string"), "EMPTY": F.lit(""), "NATIONS": F.col("body")}).alias("text"))


EDGES = [("the", "license"), ("license", "version"), ("version", "apache"), ("apache", "license"), ("token", "secret")]


@query("t06_t07_glossary_closure", """WITH RECURSIVE e(term, leads_to) AS (VALUES ('the', 'license'), ('license', 'version'), ('version', 'apache'), ('apache', 'license'), ('token', 'secret')),
s AS (SELECT doc_id, term FROM documents, (SELECT DISTINCT term FROM e) WHERE regexp_matches(lower(text), '\\b' || term || '(?:es|s)?\\b')),
c AS (SELECT doc_id, term FROM s UNION SELECT c.doc_id, e.leads_to FROM c JOIN e ON e.term = c.term) SELECT DISTINCT doc_id, term FROM c""")
def t07(spark, sf_dir):
    edges = spark.createDataFrame(EDGES, "term string, leads_to string")
    terms = [t for t, _ in EDGES]
    named = F.array_compact(F.array(*[F.when(text.mentions(F.col("text"), F.lit(t)), F.lit(t)) for t in terms]))
    seeds = load(spark, sf_dir, "documents").select("doc_id", F.explode(named).alias("term"))
    return text.glossary_closure(seeds, "doc_id", edges)


UPGRADED = """WITH s AS (SELECT p_partkey, 'A: ' || p_name || chr(10) || chr(10) || 'KEYWORDS:' || chr(10) || 'old' || chr(10) || 'CHARACTER: ' || p_brand AS x FROM part),
u AS (SELECT p_partkey, x, 'A: ' || replace(p_name, 'red', 'RED') || chr(10) || chr(10) || 'KEYWORDS:' || chr(10) || 'new' || chr(10) || 'CHARACTER: ' || replace(p_brand, 'red', 'RED') AS text FROM s JOIN part USING (p_partkey))
"""


def _old_text():
    return F.concat(F.lit("A: "), F.col("p_name"), F.lit("\n\nKEYWORDS:\nold\nCHARACTER: "), F.col("p_brand"))


def _new_text(x):
    return text.upgraded_text(x, {"red": "RED"}, r"(?s)\n\nKEYWORDS:\n.*?(?=\nCHARACTER: )", "\nCHARACTER: ", F.lit("new"))


@query("t08_upgraded_text", UPGRADED + "SELECT p_partkey, text FROM u")
def t08(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", _new_text(_old_text()).alias("text"))


@query("p07_upgraded_records", UPGRADED + "SELECT p_partkey, 'new_set' AS dataset_id, 'observation_v5' AS observation_version, text AS observation, sha256(text) AS observation_sha256, sha256(x) AS source_observation_sha256 FROM u")
def p07(spark, sf_dir):
    x = _old_text()
    d = load(spark, sf_dir, "part").select("p_partkey", F.lit("old_set").alias("dataset_id"), F.lit("observation_v4").alias("observation_version"), x.alias("observation"), F.sha2(x, 256).alias("observation_sha256"))
    return text.upgraded_records(d, "new_set", "observation_v4", "observation_v5", _new_text(F.col("observation")))


@query("t09_t22_catalog_text", "SELECT p_partkey, CASE WHEN p_size < 20 THEN 'size ' || p_size ELSE p_name END AS effect, CASE WHEN p_size < 20 THEN 'catalog' ELSE 'source' END AS effect_source FROM part")
def t09(spark, sf_dir):
    catalog = spark.range(1, 20).select(F.col("id").cast("int").alias("p_size"), F.concat(F.lit("size "), F.col("id").cast("string")).alias("effect"))
    return text.catalog_text(load(spark, sf_dir, "part"), "p_size", catalog, "p_name").select("p_partkey", "effect", "effect_source")


@query("t13_chat_messages", "SELECT conv_id, 'system: be brief' || chr(10) || string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS chat FROM conversations GROUP BY 1")
def t13(spark, sf_dir):
    d = text.chat_messages(load(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text", "be brief")
    return d.select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("chat"))


@query("t23_retry_request", """WITH c AS (SELECT conv_id, count(*) AS n, string_agg(role, ',' ORDER BY turn) AS observed FROM conversations GROUP BY 1)
SELECT conv_id, 'be brief' AS system_prompt, CASE WHEN conv_id % 2 = 0 THEN observed ELSE observed || chr(10) || chr(10) || 'Your previous response was invalid.' || chr(10) || chr(10) || 'Return exactly one of:' || chr(10) || array_to_string(list_transform(range(0, n), lambda i: 'ACTION_' || i), chr(10)) || chr(10) || chr(10) || 'Return only the action ID.' END AS user_prompt FROM c""")
def t23(spark, sf_dir):
    """The first request of even conversations, the retry of the others."""
    roles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ",")
    d = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), roles.alias("observed"))
    allowed = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.concat(F.lit("ACTION_"), i.cast("string")))
    request = F.when(F.col("conv_id") % 2 == 0, text.request_text("be brief", F.col("observed"))).otherwise(text.request_text("be brief", F.col("observed"), allowed))
    return d.select("conv_id", request.alias("r")).select("conv_id", "r.*")


@query("t14_training_layout", "SELECT p_partkey, p_size % 5 + 1 AS prompt_tokens, p_size % 3 + 1 AS loss_tokens, (p_size % 5 + p_size % 3 + 2) > 6 AS too_long, -100 * (p_size % 5 + 1) + 7 * (p_size % 3 + 1) AS label_sum FROM part")
def t14(spark, sf_dir):
    d = load(spark, sf_dir, "part").select("p_partkey", F.array_repeat(F.lit(3), F.col("p_size") % 5 + 1).alias("p"), F.array_repeat(F.lit(7), F.col("p_size") % 3 + 1).alias("a"))
    return text.training_layout(d, "p", "a", 6).select("p_partkey", "prompt_tokens", "loss_tokens", "too_long", F.aggregate("labels", F.lit(0), lambda s, x: s + x).alias("label_sum"))


@query("x24_response_log_prob", """WITH s AS (SELECT p_partkey, p_size % 9 + 2 AS n, p_size % 3 AS prompt FROM part),
p AS (SELECT p_partkey, n, prompt, i, list_transform(range(0, 6), lambda j: ((p_partkey * (i + 1) * 7 + j * 13) % 2001 - 1000) / CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 250.0 END) AS x, (p_partkey + i + 1) % 6 AS y FROM s, range(0, 10) v(i) WHERE i < n - 1 AND i + 1 > prompt),
t AS (SELECT p_partkey, x[y + 1] - (list_max(x) + ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x)))))) AS lp FROM p)
SELECT p_partkey, round(sum(lp), 6) AS log_prob, count(lp) AS tokens FROM s LEFT JOIN t USING (p_partkey) GROUP BY 1""")
def x24(spark, sf_dir):
    """Scores of up to 1000 and small ones at 2 to 10 positions; the first labels are the prompt's and masked."""
    k, n = F.col("p_partkey"), F.col("p_size") % 9 + 2
    scale = F.when(k % 2 == 0, 1.0).otherwise(250.0)
    scores = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.sequence(F.lit(0), F.lit(5)), lambda j: ((k * (i + 1) * 7 + j * 13) % 2001 - 1000) / scale))
    labels = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i <= F.col("p_size") % 3, -100).otherwise((k + i) % 6).cast("int"))
    d = load(spark, sf_dir, "part").select("p_partkey", scalar.response_log_prob(scores, labels).alias("r"))
    return d.select("p_partkey", r("r.log_prob").alias("log_prob"), F.coalesce("r.tokens", F.lit(0)).alias("tokens"))


@query("t15_padded", "WITH s AS (SELECT p_partkey, p_brand, p_size % 6 + 1 AS n FROM part) SELECT p_partkey, max(n) OVER (PARTITION BY p_brand) AS width, n AS real FROM s")
def t15(spark, sf_dir):
    d = load(spark, sf_dir, "part").select("p_partkey", "p_brand", F.array_repeat(F.lit(1), F.col("p_size") % 6 + 1).alias("ids"))
    return text.padded(d, ["p_brand"], "ids", 0).select("p_partkey", F.size("ids").alias("width"), F.aggregate("mask", F.lit(0), lambda s, x: s + x).alias("real"))


@query("t11_j14_route_view", "WITH s AS (SELECT o_custkey, list(o_orderstatus ORDER BY o_orderkey) AS steps FROM orders GROUP BY 1) SELECT o_custkey, array_to_string(steps[3:], ' > ') AS text FROM s")
def t11(spark, sf_dir):
    d = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), lambda x: x["o_orderstatus"]).alias("steps")).withColumn("at", F.lit(2))
    return text.route_view(d, "o_custkey", "steps", "at").select("o_custkey", "text")


@query("p10_decision_cascade", """WITH s AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'ACTION_' || (event_id % 5) ELSE 'what' END AS a, CASE WHEN event_id % 3 = 0 THEN ' ACTION_1 ' ELSE 'ACTION_9' END AS b FROM events)
SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_id % 5 < 3 THEN a WHEN event_id % 3 = 0 THEN 'ACTION_1' ELSE 'ACTION_0' END AS action, CASE WHEN event_id % 2 = 0 AND event_id % 5 < 3 THEN 'first' WHEN event_id % 3 = 0 THEN 'retry' ELSE 'fallback' END AS decision_source FROM s""")
def p10(spark, sf_dir):
    i = F.col("event_id")
    e = load(spark, sf_dir, "events").select("event_id", F.when(i % 2 == 0, F.concat(F.lit("ACTION_"), (i % 5).cast("string"))).otherwise("what").alias("a"), F.when(i % 3 == 0, " ACTION_1 ").otherwise("ACTION_9").alias("b"), F.lit("ACTION_0").alias("c"), F.array(F.lit("ACTION_0"), F.lit("ACTION_1"), F.lit("ACTION_2")).alias("legal"))
    return text.decision_cascade(e, "a", "b", "c", "legal").select("event_id", "action", "decision_source")


@query("p12_command", "SELECT event_id, CASE event_type WHEN 'view' THEN 'END' WHEN 'click' THEN 'PLAY ' || (user_id % 10 + 1) || ' ' || (event_id % 3) ELSE 'CHOOSE ' || (user_id % 10) END AS command FROM events")
def p12(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", "end_turn").when(F.col("event_type") == "click", "play_card").otherwise("select_card")
    return load(spark, sf_dir, "events").select("event_id", text.command(kind, F.col("user_id") % 10, F.col("event_id") % 3).alias("command"))


@query("t20_selection_actions", "SELECT o_custkey, 'ACTION_' || i AS action_id, i + 1 AS index, steps[i + 2] AS card FROM (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS steps FROM orders GROUP BY 1), range(0, 2) v(i) WHERE len(steps) > 2")
def t20(spark, sf_dir):
    d = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("pile")).where(F.size("pile") > 2).withColumn("picks", F.array(F.lit(1), F.lit(2)))
    return text.selection_actions(d, "o_custkey", "pile", "picks")


@query("p09_demonstrations", """WITH p AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS c, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS executed, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS first, bool_or(o_orderstatus = 'P') AS fallback FROM orders GROUP BY 1),
x AS (SELECT o_custkey, c, fallback, 'ACTION_' || (list_position(c, executed) - 1) AS own, 'ACTION_' || (list_position(c, CASE WHEN o_custkey % 4 = 0 THEN first ELSE executed END) - 1) AS selected, executed FROM p)
SELECT o_custkey, CASE WHEN own <> selected THEN 'action differs' WHEN fallback THEN 'fallback' END AS problem, CASE WHEN own = selected AND NOT fallback THEN own || ':1.0' END AS candidates,
CASE WHEN own = selected AND NOT fallback THEN CASE WHEN len(c) = 1 AND executed LIKE '5%' THEN 'forced_end' ELSE 'teacher_strategy' END END AS supervision_source FROM x""")
def p09(spark, sf_dir):
    """Priorities of a customer's orders as classes, the last order's as the executed action, for some customers the first one's as the selected class."""
    when = F.struct("o_orderdate", "o_orderkey")
    d = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("c"), F.max_by("o_orderpriority", when).alias("executed"), F.min_by("o_orderpriority", when).alias("first"), F.some(F.col("o_orderstatus") == "P").alias("fallback"))
    name = lambda i: F.concat(F.lit("ACTION_"), i.cast("string"))
    d = d.withColumn("classes", F.transform("c", lambda x, i: F.struct(name(i).alias("class_id"), F.when(x.startswith("5"), "end_turn").otherwise("play_card").alias("action_type"), x.alias("representative"))))
    d = d.withColumn("selected", name(F.array_position("c", F.when(F.col("o_custkey") % 4 == 0, F.col("first")).otherwise(F.col("executed"))) - 1))
    out = text.demonstrations(d, "classes", "executed", "selected", "fallback")
    return out.select("o_custkey", "problem", F.get(F.transform("candidates", lambda x: F.concat(x["action_id"], F.lit(":"), x["weight"].cast("string"))), F.lit(0)).alias("candidates"), "supervision_source")


@query("t16_branches", "SELECT o_custkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS branch, o_orderkey AS action, 1.0 AS weight FROM orders")
def t16(spark, sf_dir):
    from decispark.operators import preferences

    g = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("action"), F.lit(1.0).alias("weight")))).alias("candidates"))
    return preferences.branches(g)


@query("p02_decision_fields", """SELECT 'd1' AS dataset_id, conv_id AS record_id, 'train' AS split, 'v7' AS observation_version, string_agg(text, chr(10) ORDER BY turn) AS observation, sha256(string_agg(text, chr(10) ORDER BY turn)) AS observation_sha256,
'[' || string_agg('{"model_action_id":"' || turn || '","action_type":"say","card_name":"' || role || '","target":' || turn % 2 || '}', ',' ORDER BY turn) || ']' AS model_actions FROM conversations GROUP BY conv_id""")
def p02(spark, sf_dir):
    action = F.struct(F.col("turn").cast("string").alias("id"), F.lit("say").alias("action_type"), F.col("role").alias("card"), (F.col("turn") % 2).cast("int").alias("target"))
    items = F.array_sort(F.collect_list(F.struct("turn", "text", action.alias("action"))))
    d = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(items.alias("x")).select("conv_id", F.array_join(F.transform("x", lambda x: x["text"]), "\n").alias("observation"), F.transform("x", lambda x: x["action"]).alias("actions"))
    return text.decision_fields(d, "d1", "v7", "conv_id", "observation", "actions").withColumn("model_actions", F.to_json("model_actions"))


@query("f01_accepted_rows", "SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 0 AND lang IN ('en', 'de')")
def f01(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", "lang").where(F.col("lang").isin("en", "de")).join(load(spark, sf_dir, "labels").where("quality = 1 and toxic = 0"), "doc_id").select("doc_id")


@query("k01_stable_order", "SELECT s_suppkey, row_number() OVER (ORDER BY s_nationkey, s_acctbal DESC NULLS LAST, s_suppkey) AS place FROM supplier")
def k01(spark, sf_dir):
    d = sampling.ordered_places(load(spark, sf_dir, "supplier"), ["s_nationkey", F.col("s_acctbal").desc_nulls_last(), "s_suppkey"])
    return d.select("s_suppkey", (F.col("place") + 1).alias("place"))


@query("x26_iso_time", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad((extract('millisecond' FROM ts)::INT % 1000)::VARCHAR, 3, '0') || 'Z' AS at FROM events")
def x26(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("at"))


@query("x30_k08_suggested_scores", """WITH s AS (SELECT user_id, event_type, avg((value > 20)::INT) AS win, avg(value) AS hp, count(*) AS visits FROM events GROUP BY ALL)
SELECT user_id, event_type, round(win, 6) AS win, round(hp, 6) AS hp, visits FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY visits DESC, win DESC, hp DESC, event_type) = 1""")
def x30(spark, sf_dir):
    from decispark.sources.files import first_per_key

    s = load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg((F.col("value") > 20).cast("int")).alias("win"), F.avg("value").alias("hp"), F.count(F.lit(1)).alias("visits"))
    d = first_per_key(s, ["user_id"], [F.desc("visits"), F.desc("win"), F.desc("hp"), "event_type"])
    return d.select("user_id", "event_type", r("win"), r("hp"), "visits")


@query("t19_parsed_states", "SELECT event_id, (props::JSON ->> 'k')::INT AS k, (props::JSON ->> 'missing') IS NULL AS no_extra FROM events")
def t12(spark, sf_dir):
    parsed = F.from_json("props", "k int, missing string")
    return load(spark, sf_dir, "events").select("event_id", parsed.alias("p")).select("event_id", "p.k", F.col("p.missing").isNull().alias("no_extra"))


@query("w01_event_rows", "SELECT o_custkey, position, kind, CASE WHEN kind = 'reward' THEN o_totalprice END AS amount FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS position, CASE WHEN o_orderstatus = 'F' THEN 'reward' ELSE 'combat' END AS kind, o_totalprice FROM orders)")
def r12(spark, sf_dir):
    from pyspark.sql import Window as W

    kind = F.when(F.col("o_orderstatus") == "F", "reward").otherwise("combat")
    d = load(spark, sf_dir, "orders").select("o_custkey", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("position"), kind.alias("kind"), "o_totalprice")
    return d.select("o_custkey", "position", "kind", F.when(F.col("kind") == "reward", F.col("o_totalprice")).alias("amount"))
