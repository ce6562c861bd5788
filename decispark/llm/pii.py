"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides (op3).

Patterns find candidate spans: emails, IP addresses, card and phone numbers, and looser forms
of these. Six labelers vote for, against or not at all on each: the strict pattern, its
checksum or ranges, a gazetteer of prefixes and domains, the words before it, its neighbouring
characters, and the grouping of its digits. Expectation-maximisation over the counts of vote patterns estimates
how reliable each labeler is; the posteriors train a naive Bayes classifier on votes and shape.
Candidates that pass it and touch no strict span are added to the strict spans, which stay.

Only the counts of distinct patterns reach the driver; their number is bounded by the number
of votes and shapes, whatever the input. Everything else is DataFrame functions. A pattern goes
over a run of characters at most twice, so a long one costs linear time and no stack; texts
without a character that all matches of a pattern hold are not searched for it.

Edge cases: a null text counts as empty; empty texts and tables give no spans; repeated rows
are treated alike; further columns are ignored. Positions are code points, end exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
#: Each finds what the plain pattern of its kind finds from left to right; a match can start where the last one ended.
STRICT = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9.-]{1,63}+\x20?[\[(](?:dot|DOT)[\])]\x20?[A-Za-z]{2,12}",
    "phone": r"(?<![0-9+.(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
# Words that come before personal data, and words that come before other numbers.
CUES = r"(?i)(?:phone|tel|call|mobile|cell|fax|dial|contact|e-?mail|mail|write|reach|address|card|visa|mastercard|amex|credit|debit|ssn|social security|ip|host|server|login)[^A-Za-z0-9]{0,6}(?:(?:is|at|number|no|me|us|to)[^A-Za-z0-9]{1,4}){0,2}$"
COUNTER_CUES = r"(?i)(?:order|invoice|isbn|issn|version|ver|figure|fig|table|chapter|section|page|ref|item|part|serial|build|release|year|vol|doi)[^A-Za-z0-9]{0,6}(?:(?:is|number|no)[^A-Za-z0-9]{1,4})?$"
DOMAINS = r"(?i)\.(?:com|org|net|edu|gov|mil|int|info|io|co|uk|de|fr|es|it|nl|ch|at|be|eu|us|ca|au|jp|cn|in|br|mx|ru|pl|se|no|dk|fi)$"
VOTES, SHAPES, CONTEXT, EDGE = 6, 3, 3, 4
#: A telephone number in groups of three, three and four digits that go together.
GROUPED = r"(?:\([0-9]{3}\)[\x20-]?[0-9]{3}-|(?<![0-9])[0-9]{3}([\x20.-])[0-9]{3}\1)[0-9]{4}$"
PER_LABELER = ("for", "against", "none")


#: What every match of a pattern holds.
NEEDS = {("email", True): "@", ("phone", True): "+"}


def _found(text: Column, pattern: str, kind: str, strict: bool, has_digit: Column) -> Column:
    """All matches with code-point positions: lengths of the pieces between and of the matches before."""
    empty = F.from_json(F.lit("[]"), "array<struct<kind:string,strict:boolean,start:int,end:int,match:string,before:string,after:string>>")

    def walk(pieces: Column) -> Column:
        matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        zipped = F.transform(matches, lambda m, i: F.struct(m.alias("m"), F.get(pieces, i).alias("p"), F.left(F.get(pieces, i + 1), F.lit(1)).alias("a")))

        def step(s: Column, x: Column) -> Column:
            start = s["at"] + F.length(x["p"])
            end = start + F.length(x["m"])
            own = F.struct(F.lit(kind).alias("kind"), F.lit(strict).alias("strict"), start.alias("start"), end.alias("end"), x["m"].alias("match"), F.right(x["p"], F.lit(40)).alias("before"), x["a"].alias("after"))
            return F.struct(end.alias("at"), F.concat(s["out"], F.array(own)).alias("out"))

        return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda s: s["out"])

    needed = F.contains(text, F.lit(NEEDS[kind, strict])) if (kind, strict) in NEEDS else text.rlike(r"[\[(](?:at|AT)[\])]") if kind == "email" else has_digit
    found = F.get(F.transform(F.array(F.split(text, pattern, -1)), lambda p: F.when(F.size(p) > 1, walk(p)).otherwise(empty)), F.lit(0))
    return F.when(needed, found).otherwise(empty)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(s: Column, i: Column) -> Column:
        x = F.substr(digits, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return s + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    """What a strict match must pass."""
    digits = _digits(match)
    if kind == "ip":
        part = "0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return match.rlike(rf"^(?:{part}|0++)(?:\.(?:{part}|0++)){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _votes(c: Column) -> Column:
    """The span's vote pattern and shape as one string, e.g. phone|for,none,none,against,none|2,1,0."""
    kind, match = c["kind"], c["match"]
    digits = _digits(match)
    strict = F.when(c["strict"] & c["ok"], "for").when(c["strict"], "against").otherwise("none")
    plain = match.rlike(GROUPED)
    check = F.when(kind == "ssn", F.when(match.rlike("^(?:000|666|9)|-00-|-0000$"), "against").otherwise("for")).when(c["strict"] & ~c["ok"], "against").when(kind.isin("card", "ip") & c["ok"], "for").when((kind == "phone") & ~c["strict"] & digits.rlike("^[2-9][0-9]{2}[2-9]"), "for").otherwise("none")
    prefix = (
        F.when(kind == "card", F.when(digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6[045])"), "for").otherwise("against"))
        .when((kind == "phone") & c["strict"], F.when(match.rlike(r"^\+0"), "against").otherwise("for"))
        .when(kind == "phone", F.when(digits.rlike("^[2-9]"), "for").otherwise("none"))
        .when((kind == "email") & c["strict"], F.when(match.rlike(DOMAINS), "for").otherwise("none"))
        .when(kind == "ip", F.when(match.rlike("^0"), "against").otherwise("none"))
        .otherwise("none")
    )
    context = F.when(c["before"].rlike(CUES), "for").when(c["before"].rlike(COUNTER_CUES), "against").otherwise("none")
    glued = c["before"].rlike(r"[A-Za-z0-9_/=.-]$") | c["after"].rlike(r"[A-Za-z0-9_/=-]")
    apart = c["before"].rlike(r"(?:^|[\s:,;(\[])$") & c["after"].rlike(r"^(?:$|[\s.,;:!?)\]])")
    edge = F.when(glued, "against").when(apart, "for").otherwise("none")
    shape = F.when((kind == "phone") & plain | kind.isin("ssn") | (kind == "email") & ~c["strict"], "for").when((kind == "card") & match.rlike(r"^(?:[0-9]{4}[\x20-]){3}[0-9]{4}$"), "for").otherwise("none")
    size = F.least(F.floor(F.length(match) / 4), F.lit(9)).cast("string")
    share = F.floor(4 * F.length(digits) / F.greatest(F.length(match), F.lit(1))).cast("string")
    breaks = F.least(F.length(F.regexp_replace(match, "[A-Za-z0-9]", "")), F.lit(5)).cast("string")
    return F.concat_ws("|", kind, F.concat_ws(",", strict, check, prefix, context, edge, shape), F.concat_ws(",", size, share, breaks))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base (the strict spans) and more (the other candidates, with their vote pattern).

    base also carries its patterns, for they take part in the estimate.
    """
    order = {k: i for i, k in enumerate((*KINDS, "ssn"))}
    d = docs.select("doc_id", text_of().alias("text")).withColumn("digit", F.col("text").rlike("[0-9]"))
    text, digit = F.col("text"), F.col("digit")
    all_found = [_checked(_found(text, p, k, strict, digit), k, order[k]) for strict, patterns in ((True, STRICT), (False, LOOSE)) for k, p in patterns.items()]
    d = d.select("doc_id", F.array_sort(F.concat(*all_found)).alias("found"))
    return d.select("doc_id", F.filter("found", lambda c: c["base"]).alias("base"), F.filter("found", lambda c: ~c["base"]).alias("more"))


def _checked(found: Column, kind: str, order: int) -> Column:
    def own(c: Column) -> Column:
        ok = F.struct(c["kind"].alias("kind"), c["strict"].alias("strict"), c["match"].alias("match"), c["before"].alias("before"), c["after"].alias("after"), valid(kind, c["match"]).alias("ok"))
        return F.get(F.transform(F.array(ok), lambda x: F.struct(c["start"].alias("start"), F.lit(order).alias("place"), c["end"].alias("end"), c["kind"].alias("kind"), (x["strict"] & x["ok"]).alias("base"), _votes(x).alias("votes"))), F.lit(0))

    return F.transform(found, own)


def expectation_maximisation(counts: dict[str, int], rounds: int = 50) -> tuple[dict[str, float], dict[str, float]]:
    """Posterior of each pattern, and each labeler's log odds by vote. counts: patterns as _votes writes them."""
    rows = [(p, p.split("|")[1].split(","), n) for p, n in sorted(counts.items())]
    score = lambda votes: sum((v == "for") - (v == "against") for v in votes)
    y = {p: 1 / (1 + math.exp(-2.0 * score(votes))) for p, votes, _ in rows}
    odds: dict[str, float] = {}
    for _ in range(rounds):
        total = [1.0, 1.0]
        seen = {(i, v, k): 1.0 for i in range(VOTES) for v in PER_LABELER for k in (0, 1)}
        for p, votes, n in rows:
            for k, w in ((1, n * y[p]), (0, n * (1 - y[p]))):
                total[k] += w
                for i, v in enumerate(votes):
                    seen[i, v, k] += w
        odds = {f"{i}={v}": math.log(seen[i, v, 1] / (total[1] + 2) * (total[0] + 2) / seen[i, v, 0]) for i in range(VOTES) for v in PER_LABELER}
        prior = math.log(total[1] / total[0])
        z = {p: prior + sum(odds[f"{i}={v}"] for i, v in enumerate(votes)) for p, votes, _ in rows}
        y = {p: 1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) for p, x in z.items()}
    return y, odds


def classifier(counts: dict[str, int], posterior: dict[str, float]) -> Callable[[str], float]:
    """Probability of a pattern by naive Bayes on kind, votes and shape, trained on the posteriors."""

    def parts(pattern: str) -> list[str]:
        kind, votes, shape = pattern.split("|")
        return [f"kind={kind}", *[f"{i}={v}" for i, v in enumerate(votes.split(","))], *[f"{kind}:{i}:{v}" for i, v in enumerate(shape.split(","))]]

    total, seen = [1.0, 1.0], {}
    for p, n in counts.items():
        for k, w in ((1, n * posterior[p]), (0, n * (1 - posterior[p]))):
            total[k] += w
            for x in parts(p):
                seen.setdefault(x, [0.5, 0.5])[k] += w
    prior = math.log(total[1] / total[0])

    def probability(pattern: str) -> float:
        z = prior + sum(math.log(seen.get(x, (1, 1))[1] / total[1] * total[0] / seen.get(x, (1, 1))[0]) for x in parts(pattern))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    return probability


def find(docs: DataFrame, least: float = 0.9) -> DataFrame:
    """doc_id, base and added: arrays of spans (start, place, end, kind, ...), sorted by start and kind."""
    found = cut(candidates(docs), "pii")
    votes = found.select(F.explode(F.concat(F.col("base")["votes"], F.col("more")["votes"])).alias("votes"))
    counts = {r["votes"]: r["n"] for r in votes.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    posterior, _ = expectation_maximisation(counts)
    probability = classifier(counts, posterior)
    # without a vote for it there is no evidence of personal data, only of an unusual shape; nothing is added that its surroundings speak against
    fits = lambda votes: "for" in votes and "against" not in votes[CONTEXT:EDGE + 1]
    good = sorted(p for p in counts if probability(p) >= least and posterior[p] >= least and fits(p.split("|")[1].split(",")))
    passed = lambda c: F.array_contains(F.array(*[F.lit(p) for p in good]), c["votes"]) if good else F.lit(False)
    apart = lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    return found.select("doc_id", "base", F.filter("more", lambda c: passed(c) & apart(c)).alias("added"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, the number of base spans by kind, base_sha256, all spans as text, their number and that of the added ones."""
    of_kind = lambda k: F.filter("base", lambda s: s["kind"] == k)
    return found.select(
        "doc_id",
        *[F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
        (F.size("base") + F.size("added")).cast("long").alias("n_spans"),
        F.size("added").cast("long").alias("n_added"),
    )
