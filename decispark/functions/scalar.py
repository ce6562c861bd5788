"""Scalar expressions: identifiers, percentages, hashes and draws, rates, outcomes."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_id(x: Column) -> Column:
    """Upper case, runs of other characters as one underscore, none at the ends; null where nothing is left."""
    y = F.regexp_replace(F.regexp_replace(F.upper(F.trim(x)), "[^A-Z0-9]+", "_"), "^_+|_+$", "")
    return F.when(y != "", y)


def parse_percentage(x: Column) -> Column:
    """A share in [0, 1] from '12.34%'; null for empty, '--' and '--%', and where it is no such number."""
    t = F.trim(x)
    value = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)%$", 1)
    number = F.when(value != "", value.cast("double") / 100)
    return F.when(t.isin("", "--", "--%"), None).otherwise(F.when(number.between(0, 1), number))


def odds(p: Column) -> Column:
    """p / (1 - p); infinite at one."""
    return F.when(p == 1, F.lit(float("inf"))).when((p >= 0) & (p < 1), F.try_divide(p, 1 - p))


def act_rate_metric(act: Column, owned: Column) -> Column:
    """Name of the rate to read: first or duplicate pick, by act."""
    return F.concat(F.when(owned, "duplicate").otherwise("first"), F.lit("_pick_rate_f"), act.cast("string"))


def sha256_text(x: Column) -> Column:
    return F.sha2(x, 256)


def seed_for(key: Column) -> Column:
    """The first 32 bits of a key's SHA-256 as an integer."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint")


def hash_uniform(key: Column) -> Column:
    """The first 64 bits of a key's SHA-256 as a number in [0, 1)."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("double") / F.lit(2.0**64)


def fnv1a64(x: Column) -> Column:
    """FNV-1a over the UTF-8 bytes, as decimal(20,0)."""
    wide = lambda v: F.lit(str(v)).cast("decimal(38,0)")
    digits = F.hex(F.encode(x, "UTF-8"))
    codes = F.transform(F.sequence(F.lit(0), F.floor(F.length(digits) / 2).cast("int") - 1), lambda i: F.conv(F.substr(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint"))
    codes = F.when(F.length(digits) == 0, F.array().cast("array<bigint>")).otherwise(codes)

    def step(h: Column, b: Column) -> Column:
        low = F.pmod(h, wide(256)).cast("bigint")
        mixed = (h - low + low.bitwiseXOR(b)).cast("decimal(38,0)")
        # times 2^40 + 435, the 2^40 part from the low 24 bits alone, so that nothing exceeds 38 digits
        high = F.pmod(mixed, wide(2**24)).cast("decimal(38,0)") * wide(2**40).cast("decimal(14,0)")
        return F.pmod((high + mixed.cast("decimal(21,0)") * F.lit(435).cast("decimal(3,0)")).cast("decimal(38,0)"), wide(2**64)).cast("decimal(38,0)")

    return F.aggregate(codes, wide(0xCBF29CE484222325), step).cast("decimal(20,0)")


def uint64(x: Column) -> Column:
    """The unsigned reading of a signed 64-bit pattern, as decimal(20,0)."""
    return F.pmod(x.cast("decimal(38,0)"), F.lit(str(2**64)).cast("decimal(38,0)")).cast("decimal(20,0)")


def record_id(episode: Column, decision: Column) -> Column:
    return F.format_string("episode-%06d-decision-%04d", episode, decision)


def plain_key(x: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.lower(F.regexp_replace(x, "[^A-Za-z0-9]", ""))


def terminal_outcome(state: Column) -> Column:
    """victory, defeat, aborted or null (not over) from a JSON state with screen, hp and monsters_alive."""
    get = lambda k: F.get_json_object(state, f"$.{k}")
    hp = get("hp").try_cast("int")
    return F.when(get("error").isNotNull(), "aborted").when(hp <= 0, "defeat").when(get("monsters_alive").try_cast("int") == 0, "victory").when(get("screen") == "GAME_OVER", "defeat")


def terminal_score(state: Column) -> Column:
    """A finite score from nested JSON, else null."""
    x = F.get_json_object(state, "$.game_over.score").try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def wilson(wins: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """Wilson interval of a rate, as a struct low, high; null without trials."""
    p, z2 = F.try_divide(wins, n), z * z
    middle = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.when(n > 0, F.struct((middle - half).alias("low"), (middle + half).alias("high")))


def exact_two_sided(k: Column, n: Column) -> Column:
    """Two-sided p-value of k against n - k at even odds (McNemar and sign tests), summed term by term.

    From the term at k downwards each is the one above times a ratio; after 8 root n of them nothing counts any more.
    """
    least = F.least(k, n - k).cast("bigint")
    steps = F.sequence(F.lit(0).cast("bigint"), F.least(least, F.ceil(8 * F.sqrt(n)) + 50) - 1)
    first = F.exp(log_factorial(n) - log_factorial(least) - log_factorial(n - least) - n * F.log(F.lit(2.0)))

    def add(s: Column, j: Column) -> Column:
        term = s["term"] * (least - j) / (n - (least - j) + 1)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    one = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    total = F.when(least > 0, F.aggregate(steps, one, add, lambda s: s["sum"])).otherwise(1.0)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * first * total))


def log_factorial(n: Column) -> Column:
    """Logarithm of n!, by the product up to 20 and Stirling's series beyond."""
    x = F.greatest(n, F.lit(1)).cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5))
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def persistence(kind: Column, exhausts: Column, ethereal: Column) -> Column:
    """How long a card lasts: power, one_shot, fleeting or lasting."""
    return F.when(kind == "POWER", "power").when(exhausts, "one_shot").when(ethereal, "fleeting").otherwise("lasting")


def strategic_prior(first: Column, duplicate: Column, overall: Column, copies: Column, exhausts: Column) -> Column:
    """A card's own score: its first pick rate, or from the second copy its duplicate rate, decaying by 0.7; cards that exhaust count 0.6 of it and 0.4 of the overall rate."""
    own = F.when(copies == 0, first).otherwise(duplicate * F.pow(F.lit(0.7), F.greatest(copies - 1, F.lit(0))))
    return F.when(exhausts, 0.6 * own + 0.4 * overall).otherwise(own)


def prior_tier(score: Column, top_fraction: Column) -> Column:
    """Fixed thresholds of score and rank; the first that holds."""
    level = lambda least, most: (score >= least) & (top_fraction <= most)
    return F.when(level(0.65, 0.10), "premium").when(level(0.40, 0.25), "strong").when(level(0.25, 0.40), "reserve").otherwise("unprotected")


def optionality(raw: Column, horizon: Column) -> Column:
    return F.least(F.lit(1.0), 2.5 * raw * horizon)


def utility(components: dict[str, float], penalty: Column) -> Column:
    """Weighted sum of columns less a penalty."""
    total = -penalty
    for name, weight in components.items():
        total = total + weight * F.col(name)
    return total


def pick_tags(rules: dict[str, Column]) -> Column:
    """The names whose rule holds, in the order given: overlapping category tags of a row."""
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value being computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def log_softmax(scores: Column, index: Column) -> Column:
    """Log of the share of one score's exponential in their sum; the largest is taken out first, so scores of any size do."""
    total = lambda most: F.aggregate(F.transform(scores, lambda x: F.exp(x - most)), F.lit(0.0), lambda s, x: s + x)
    return bound(F.array_max(scores), lambda most: (F.get(scores, index) - most) - F.log(total(most)))


def response_log_prob(scores: Column, labels: Column, ignore: int = -100) -> Column:
    """Struct of log_prob and tokens of a response: scores (an array per position, one score a token) predict the next position's label.

    Positions whose label is `ignore` do not count. Null where nothing counts, where positions and labels
    differ in number, or where a label lies outside its scores.
    """

    def of(x: Column) -> Column:
        placed = F.transform(F.slice(x["y"], F.lit(2), F.greatest(F.size(x["y"]) - 1, F.lit(0))), lambda y, i: F.struct(y.alias("y"), i.alias("i")))
        terms = F.transform(F.filter(placed, lambda p: p["y"] != ignore), lambda p: bound(F.get(x["s"], p["i"]), lambda own: log_softmax(own, p["y"])))
        whole = lambda t: F.struct(F.aggregate(t, F.lit(0.0), lambda s, v: s + v).alias("log_prob"), F.size(t).cast("long").alias("tokens"))
        return bound(terms, lambda t: F.when((F.size(x["s"]) == F.size(x["y"])) & (F.size(t) > 0) & ~F.exists(t, lambda v: v.isNull()), whole(t)))

    return bound(F.struct(scores.alias("s"), labels.alias("y")), of)
