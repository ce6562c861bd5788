"""States and actions as text and arrays: action spaces, observations, glossaries, chats, token layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from decispark.sources.shared import cut


def valid_targets(monsters: Column) -> Column:
    """Places of the monsters that can be aimed at: there, not half dead, with HP left."""
    flagged = F.transform(monsters, lambda m, i: F.when(~m["is_gone"] & ~m["half_dead"] & (m["hp"] > 0), i))
    return F.array_compact(flagged)


def legal_actions(states: DataFrame, key: str) -> DataFrame:
    """One row per legal action: playable cards of the hand times their targets, then ending the turn; ids in that order.

    states: key, hand (array of name, playable, has_target) and monsters (array of is_gone, half_dead, hp).
    """
    targets = valid_targets(F.col("monsters"))
    cards = F.flatten(F.transform("hand", lambda c, i: F.when(
        c["playable"], F.when(c["has_target"], F.transform(targets, lambda t: F.struct(F.lit("play_card").alias("type"), i.alias("hand_index"), c["name"].alias("card"), t.alias("target"))))
        .otherwise(F.array(F.struct(F.lit("play_card").alias("type"), i.alias("hand_index"), c["name"].alias("card"), F.lit(None).cast("int").alias("target"))))
    ).otherwise(F.array().cast("array<struct<type:string,hand_index:int,card:string,target:int>>"))))
    end = F.array(F.struct(F.lit("end_turn").alias("type"), F.lit(None).cast("int").alias("hand_index"), F.lit(None).cast("string").alias("card"), F.lit(None).cast("int").alias("target")))
    d = states.select(key, F.posexplode(F.concat(cards, end)).alias("place", "a"))
    return d.select(key, "place", F.concat(F.lit("ACTION_"), F.col("place").cast("string")).alias("action_id"), "a.*")


def equivalence_classes(actions: DataFrame, state: str, keys: list[str], order: list[str], member: str) -> DataFrame:
    """Actions of one state with equal keys as one class: id by key order, copies, members in order, the first of them."""
    members = F.array_sort(F.collect_list(F.struct(*order, F.col(member).cast("string").alias("id"))))
    d = actions.groupBy(state, *keys).agg(F.count(F.lit(1)).alias("copies"), members.alias("m"))
    place = F.row_number().over(W.partitionBy(state).orderBy(*keys)) - 1
    return d.select(state, *keys, F.concat(F.lit("ACTION_"), place.cast("string")).alias("class_id"), "copies", F.array_join(F.transform("m", lambda x: x["id"]), ",").alias("members"), F.get("m", F.lit(0))["id"].alias("representative"))


def audit_rows(classes: DataFrame, state: str) -> DataFrame:
    """One row per member of each class."""
    return classes.select(state, "class_id", "representative", F.posexplode(F.split("members", ",")).alias("place", "member"))


def root_records(classes: DataFrame, state: str, kind: str, card: str, target: str, semantics: list[str] | None = None) -> DataFrame:
    """One record per class: id, card (the action's type where it plays none) and target; with semantics also the type and the card's public fields."""
    d = classes.select(state, F.col("class_id").alias("id"), F.coalesce(F.col(card), F.col(kind)).alias("card"), F.col(target).alias("target"), F.col(kind).alias("action_type"), *([F.when(F.col(card).isNotNull(), F.struct(*semantics)).alias("card_semantics")] if semantics else []))
    return d if semantics else d.drop("action_type")


def decision_fields(states: DataFrame, dataset: str, version: str, state: str, observation: str, actions: str) -> DataFrame:
    """What supervised and preference records share: identity, observation with its hash, and the actions (id, type, card, target) under public names."""
    public = F.transform(actions, lambda a: F.struct(a["id"].alias("model_action_id"), a["action_type"], a["card"].alias("card_name"), a["target"]))
    return states.select(
        F.lit(dataset).alias("dataset_id"), F.col(state).alias("record_id"), F.lit("train").alias("split"), F.lit(version).alias("observation_version"),
        F.col(observation).alias("observation"), F.sha2(observation, 256).alias("observation_sha256"), public.alias("model_actions"),
    )


#: Public fields of a card.
CARD_FIELDS = ("card_id", "name", "card_type", "cost", "upgrades", "effect", "exhausts", "ethereal", "has_target")


def card_semantics(card: Column) -> Column:
    """A card's public fields alone: cards that a model cannot tell apart are equal."""
    return F.struct(*[card[f].alias(f) for f in CARD_FIELDS])


def action_rules(action: Column, hand: Column, monsters: Column) -> dict[str, Column]:
    """Rules of an action (type, hand_index, card_uuid, card_name, target_index) against its state, for validation.broken."""
    plays, ends = action["type"] == "play_card", action["type"] == "end_turn"
    fits = action["hand_index"].between(0, F.size(hand) - 1)
    card = F.get(hand, F.when(fits, action["hand_index"]))
    aimed = F.get(monsters, F.when(action["target_index"] >= 0, action["target_index"]))
    of_card = lambda rule: ~plays | ~F.coalesce(fits, F.lit(False)) | rule
    alive = ~aimed["is_gone"] & ~aimed["half_dead"] & (aimed["hp"] > 0)
    return {
        "hand_index": ~plays | fits,
        "card_uuid": of_card(action["card_uuid"].eqNullSafe(card["uuid"])),
        "card_name": of_card(action["card_name"].eqNullSafe(card["name"])),
        "playable": of_card(card["playable"]),
        "no_target": of_card(card["has_target"] | action["target_index"].isNull()),
        "target_index": of_card(~card["has_target"] | F.coalesce(action["target_index"].between(0, F.size(monsters) - 1), F.lit(False))),
        "target": of_card(~card["has_target"] | aimed.isNull() | alive),
        "end_turn": ~ends | F.forall(F.array(action["hand_index"].isNull(), action["card_uuid"].isNull(), action["card_name"].isNull(), action["target_index"].isNull()), lambda x: x),
    }


def demonstrations(decisions: DataFrame, classes: str, executed: str, selected: str, fallback: str) -> DataFrame:
    """decisions with the record of one candidate that an executed action gives, and problem where it is no demonstration.

    classes: array of (class_id, action_type, representative). The label is forced_end where ending the
    turn was the only class. A problem: the executed action is no class's representative or not the
    selected class, or a fallback chose it.
    """
    own = F.get(F.filter(classes, lambda c: c["representative"] == F.col(executed)), F.lit(0))
    forced = (F.size(classes) == 1) & (own["action_type"] == "end_turn")
    problem = F.when(own.isNull() | ~own["class_id"].eqNullSafe(F.col(selected)), "action differs").when(F.col(fallback), "fallback")
    d = decisions.withColumn("problem", problem)
    good = F.col("problem").isNull()
    return d.withColumn("candidates", F.when(good, F.array(F.struct(own["class_id"].alias("action_id"), F.lit(1.0).alias("weight"))))).withColumn("supervision_source", F.when(good, F.when(forced, "forced_end").otherwise("teacher_strategy")))


def numbered_lines(rows: DataFrame, group: str, order: list[str], line: Column, name: str = "text") -> DataFrame:
    """Per group its lines in order, joined by newlines."""
    items = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    return rows.groupBy(group).agg(F.array_join(F.transform(items, lambda x: x["line"]), "\n").alias(name))


def observation(sections: dict[str, Column]) -> Column:
    """Sections with a heading each, null or empty ones left out, a blank line between."""
    parts = [F.when(F.length(body) > 0, F.concat(F.lit(f"{name}:\n"), body)) for name, body in sections.items()]
    return F.concat_ws("\n\n", *parts)


def mentions(text: Column, term: Column) -> Column:
    """Whether a text names a term as a word of its own, also in the plural; underscores count as spaces."""
    plain = lambda x: F.lower(F.regexp_replace(x, "_", " "))
    return F.regexp(plain(text), F.concat(F.lit(r"\b\Q"), plain(term), F.lit(r"\E(?:es|s)?\b")))


def closed(edges: DataFrame) -> DataFrame:
    """term and leads_to: all that a term leads to over any number of edges, itself included.

    Every round joins the relation with itself, until nothing new appears; the rounds grow with the
    logarithm of the longest chain. A glossary is small beside the texts.
    """
    found = cut(edges.select("term", "leads_to").unionByName(edges.select("term", F.col("term").alias("leads_to"))).unionByName(edges.select(F.col("leads_to").alias("term"), "leads_to")).distinct(), "closure")
    n = -1
    while (now := found.count()) != n:
        n = now
        step = found.join(found.select(F.col("term").alias("leads_to"), F.col("leads_to").alias("end")), "leads_to").select("term", F.col("end").alias("leads_to"))
        found = cut(found.unionByName(step).distinct(), "closure")
    return found


#: Rows of a counted table up to which it is broadcast.
BROADCAST_ROWS = 100_000


def small_side(rows: DataFrame) -> DataFrame:
    """rows, to be broadcast if they are few; counted first, and joined by shuffle otherwise."""
    few = rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(rows) if few else rows


def glossary_closure(seeds: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """key and term: the seeds' terms and all that their definitions lead to (edges: term, leads_to), to the fixed point."""
    reached = seeds.select(key, "term").distinct().join(small_side(closed(edges)), "term", "left")
    return reached.select(key, F.coalesce("leads_to", "term").alias("term")).distinct()


def upgraded_text(text: Column, replacements: dict[str, str], drop_block: str, marker: str, insert: Column) -> Column:
    """A text with replacements made, one block dropped and a new one put before the marker."""
    out = text
    for old, new in replacements.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.regexp_replace(out, drop_block, "")
    at = F.instr(out, marker)
    with_new = F.concat(F.substr(out, F.lit(1), at - 1), F.lit("\n\nKEYWORDS:\n"), insert, F.substr(out, at))
    return F.when((at > 0) & (F.length(insert) > 0), with_new).otherwise(out)


def upgraded_records(records: DataFrame, dataset: str, source_version: str, version: str, upgraded: Column) -> DataFrame:
    """Records under a new dataset, version and observation text; the old hash stays beside the new one. Fails on another source version."""
    wrong = F.raise_error(F.concat(F.lit("unexpected version "), F.coalesce("observation_version", F.lit("null")))).cast("string")
    d = records.withColumn("__old", F.col("observation_sha256")).withColumn("observation_version", F.when(F.col("observation_version") == source_version, F.lit(version)).otherwise(wrong))
    d = d.withColumn("observation", upgraded).withColumns({"dataset_id": F.lit(dataset), "observation_sha256": F.sha2("observation", 256)})
    return d.withColumnRenamed("__old", "source_observation_sha256")


def catalog_text(rows: DataFrame, key: str, catalog: DataFrame, fallback: str | None = None) -> DataFrame:
    """rows with effect and effect_source: the catalog's text, else the row's own, else null (a violation)."""
    d = rows.join(small_side(catalog.select(key, F.col("effect").alias("__effect"))), key, "left")
    own = F.col(fallback) if fallback else F.lit(None).cast("string")
    source = F.when(F.col("__effect").isNotNull(), "catalog").when(own.isNotNull(), "source").otherwise("missing")
    return d.withColumn("effect", F.coalesce("__effect", own)).withColumn("effect_source", source).drop("__effect")


def chat_messages(turns: DataFrame, conversation: str, order: str, role: str, content: str, system: str) -> DataFrame:
    """Per conversation its messages in order behind a system message, as an array of role and content."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(role).alias("role"), F.col(content).alias("content"))))
    first = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
    return turns.groupBy(conversation).agg(F.concat(first, F.transform(items, lambda x: F.struct(x["role"], x["content"]))).alias("messages"))


def training_layout(rows: DataFrame, prompt: str, response: str, most: int, ignore: int = -100) -> DataFrame:
    """rows (arrays of ids) with input_ids, attention_mask, labels (the prompt masked) and counts; too_long instead of truncation."""
    p, r = F.size(prompt), F.size(response)
    d = rows.withColumn("input_ids", F.concat(prompt, response)).withColumn("labels", F.concat(F.array_repeat(F.lit(ignore), p), response))
    return d.withColumn("attention_mask", F.array_repeat(F.lit(1), p + r)).withColumn("prompt_tokens", p).withColumn("loss_tokens", r).withColumn("too_long", p + r > most)


def padded(rows: DataFrame, batch: list[str], ids: str, pad: int) -> DataFrame:
    """rows with their ids padded on the right to the longest of their batch, and the mask of real ones."""
    most = F.max(F.size(ids)).over(W.partitionBy(*batch))
    d = rows.withColumn("__gap", most - F.size(ids))
    return d.withColumn("mask", F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), F.col("__gap")))).withColumn(ids, F.concat(ids, F.array_repeat(F.lit(pad), F.col("__gap")))).drop("__gap")


def route_view(routes: DataFrame, key: str, steps: str, position: str) -> DataFrame:
    """key, the steps that are left after a position, as an array and as text."""
    rest = F.slice(F.col(steps), F.col(position) + 1, F.greatest(F.size(steps) - F.col(position), F.lit(0)))
    return routes.select(key, rest.alias("remaining"), F.array_join(rest, " > ").alias("text"))


# The correction that a retry adds to the observation.
RETRY = ("Your previous response was invalid.\n\nReturn exactly one of:\n", "\n\nReturn only the action ID.")


def request_text(system: str, observed: Column, allowed: Column | None = None) -> Column:
    """A request's system and user prompt; with allowed (an array of ids, not empty) the retry after an invalid answer."""
    if allowed is None:
        return F.struct(F.lit(system).alias("system_prompt"), observed.alias("user_prompt"))
    none = F.raise_error(F.lit("a retry needs allowed actions"))
    ids = F.when(F.size(allowed) > 0, F.array_join(allowed, "\n")).otherwise(none.cast("string"))
    return F.struct(F.lit(system).alias("system_prompt"), F.concat(observed, F.lit("\n\n" + RETRY[0]), ids, F.lit(RETRY[1])).alias("user_prompt"))


def decision_cascade(rows: DataFrame, first: str, retry: str, fallback: str, legal: str) -> DataFrame:
    """rows with action and decision_source: the first legal parse, else the retry's, else the fallback."""
    parsed = lambda c: F.regexp_extract(F.col(c), r"^\s*(ACTION_[0-9]+)\s*$", 1)
    ok = lambda c: F.array_contains(F.col(legal), parsed(c))
    one, two = F.coalesce(ok(first), F.lit(False)), F.coalesce(ok(retry), F.lit(False))
    return rows.withColumn("action", F.when(one, parsed(first)).when(two, parsed(retry)).otherwise(F.col(fallback))).withColumn("decision_source", F.when(one, "first").when(two, "retry").otherwise("fallback"))


def command(kind: Column, hand_index: Column, target: Column) -> Column:
    """The command of an action: END, or PLAY with the hand place from 1 and the target."""
    play = F.concat_ws(" ", F.lit("PLAY"), (hand_index + 1).cast("string"), target.cast("string"))
    return F.when(kind == "end_turn", "END").when(kind == "play_card", play).when(kind == "select_card", F.concat(F.lit("CHOOSE "), hand_index.cast("string")))


def selection_actions(states: DataFrame, key: str, pile: str, candidates: str) -> DataFrame:
    """One row per candidate of a secondary selection, with the card at that place of the pile."""
    d = states.select(key, F.col(pile).alias("__pile"), F.posexplode(candidates).alias("place", "index"))
    return d.select(key, F.concat(F.lit("ACTION_"), F.col("place").cast("string")).alias("action_id"), "index", F.get("__pile", F.col("index")).alias("card"))
