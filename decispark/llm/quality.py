"""Quality rules: hard rules on text statistics, then robust multivariate outliers (op5).

Every (lang, source) group gets a minimum-covariance-determinant estimate of the centre and
scatter of transformed statistics, and so do every language and the whole table. A group of n
documents takes n / (n + prior) of its own estimate and the rest of its language's, which leans
on that of the whole table alike, so no size of a group is a switch. A document goes where its
squared Mahalanobis distance exceeds a chi-square quantile.

Edge cases: a null text counts as empty; a null language or source is a value of its own;
equal rows get equal verdicts; an empty table gives an empty result; further columns are
ignored. Every variance has a floor added to it, so a group in which a statistic is constant
rejects nothing for a small deviation.

Only DataFrame functions; per document there is one row of ten numbers after the first pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, bind, shingle_hashes, text_of, words_of

#: Transformed statistics, each with the least variance assumed for it.
FEATURES = {"log_words": 0.49, "log_word_length": 0.04, "symbol_share": 0.0025, "dup_line_share": 0.04, "repeat_share": 0.02}
#: Median and 1 - 1e-9 quantile of the chi-square distribution with 5 degrees of freedom.
CHI2_MEDIAN, CHI2_CUT = 4.351, 50.0
#: Consistency factor of a core of one half: 0.5 over the share of a chi-square distribution with 7 degrees of freedom below CHI2_MEDIAN.
CONSISTENCY = 1.913


#: Groups up to which a table of one row per group is broadcast whole; beyond, only groups of more than this part of all rows are, at most as many.
BROADCAST_GROUPS = 10_000
#: Documents that a language's estimate counts as beside a group's own, and that of the whole table beside a language's.
PRIOR = 100


def repeated_words(hashes: Column, n: int = 5) -> Column:
    """Words that lie in an n-word window whose hash occurs at least twice."""

    def covered(pairs: Column) -> Column:
        twin = lambda e, i: (e["h"] == F.get(pairs, i - 1)["h"]) | (e["h"] == F.get(pairs, i + 1)["h"])
        at = F.sort_array(F.transform(F.filter(pairs, lambda e, i: F.coalesce(twin(e, i), F.lit(False))), lambda e: e["p"]))
        return bind(at, lambda a: F.aggregate(F.transform(a, lambda p, i: F.least(F.lit(n), F.coalesce(F.get(a, i + 1) - p, F.lit(n)))), F.lit(0), lambda s, x: s + x))

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(bind(pairs, covered))


def text_statistics(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, source, the carried columns and the counts of every whole text."""
    no_window = F.slice(F.array(F.lit(0).cast("long")), 1, 0)
    d = docs.select("doc_id", "lang", "source", *carry, text_of().alias("text"))
    d = d.withColumn("w", words_of(F.col("text")))
    d = d.withColumn("wh", F.transform("w", lambda x: F.xxhash64(x)))
    d = d.withColumn("h", F.when(F.size("wh") >= 5, shingle_hashes(F.col("wh"))).otherwise(no_window))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("lines", lines)
    return d.select(
        "doc_id", "lang", "source", *carry,
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("h")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def base_failed(least_words: int = 10, repeated_percent: int = 20) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeated_percent * F.col("n_words"))


def transformed() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)).cast("double"))
    return {
        "log_words": F.log1p(F.col("n_words").cast("double")),
        "log_word_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        "symbol_share": F.log1p(F.col("n_symbols") / n),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
    }


def _lower() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(FEATURES)) for j in range(i + 1)]


def _factor(group: DataFrame) -> DataFrame:
    """group with columns l_i_j of the Cholesky factor of the covariance c_i_j, and log_det, the logarithm of its determinant."""
    names, floors = list(FEATURES), list(FEATURES.values())
    out = group
    for i, j in _lower():
        rest = F.col(f"c_{i}_{j}")
        for k in range(j):
            rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
        out = out.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(floors[i] / 10))) if i == j else rest / F.col(f"l_{j}_{j}"))
    log_det = F.log(F.col("l_0_0"))
    for i in range(1, len(names)):
        log_det = log_det + F.log(F.col(f"l_{i}_{i}"))
    return out.withColumn("log_det", log_det)


def _looked_up(rows: DataFrame, per: DataFrame, on: list[str], few: bool) -> DataFrame:
    """rows (with g and hot) joined with a table of one row per group (and run), which has hot as well.

    A large group's rows need not meet: where groups are few all of per is broadcast, and else
    its hot rows, of which there are BROADCAST_GROUPS a level at most.
    """
    if few:
        return rows.join(F.broadcast(per.drop("hot")), on)
    hot = rows.where("hot").join(F.broadcast(per.where("hot").drop("hot")), on)
    return hot.unionByName(rows.where("not hot").join(per.where("not hot").drop("hot"), on))


def _distance(stats: DataFrame, group: DataFrame, few: bool) -> DataFrame:
    """stats with d2, the squared Mahalanobis distance from its group."""
    names = list(FEATURES)
    on = [c for c in ("g", "run") if c in group.columns]
    d = _looked_up(stats, group.select(*on, "hot", *[f"m_{i}" for i in range(len(names))], *[f"l_{i}_{j}" for i, j in _lower()]), on, few)
    for i, x in enumerate(names):
        rest = F.col(x) - F.col(f"m_{i}")
        for j in range(i):
            rest = rest - F.col(f"l_{i}_{j}") * F.col(f"z_{j}")
        d = d.withColumn(f"z_{i}", rest / F.col(f"l_{i}_{i}"))
    d2 = F.col("z_0") * F.col("z_0")
    for i in range(1, len(names)):
        d2 = d2 + F.col(f"z_{i}") * F.col(f"z_{i}")
    return d.select(*stats.columns, d2.alias("d2"))


def _widened(variance: Column, i: int) -> Column:
    """A variance with its floor added, so that no statistic counts more than the floor lets it."""
    return variance + list(FEATURES.values())[i]


def _moments(core: DataFrame) -> DataFrame:
    """Mean and widened covariance of each group's core."""
    names = list(FEATURES)
    cov = lambda i, j: _widened(F.var_pop(names[i]), i) if i == j else F.covar_pop(names[i], names[j])
    return core.groupBy("g", "run", "hot").agg(*[F.avg(x).alias(f"m_{i}") for i, x in enumerate(names)], *[cov(i, j).alias(f"c_{i}_{j}") for i, j in _lower()])


def _starts(stats: DataFrame, tables: Tables, few: bool) -> DataFrame:
    """Three estimates of each group to start from (run): median and median deviation; mean and covariance of all; the same of values bent by tanh."""
    names = list(FEATURES)
    all_m = [f"m_{i}" for i in range(len(names))]
    centre = tables.cut(stats.groupBy("g", "hot").agg(*[F.percentile_approx(x, 0.5, 1000).alias(m) for x, m in zip(names, all_m, strict=True)]), "groups")
    spread = _looked_up(stats, centre, ["g"], few).groupBy("g", "hot").agg(*[F.first(m).alias(m) for m in all_m], *[F.percentile_approx(F.abs(F.col(x) - F.col(f"m_{i}")), 0.5, 1000).alias(f"q_{i}") for i, x in enumerate(names)])
    spread = tables.cut(spread.select("g", "hot", *all_m, *[F.sqrt(_widened((F.col(f"q_{i}") * 1.4826) ** 2, i)).alias(f"s_{i}") for i in range(len(names))]), "groups")
    plain = spread.select("g", F.lit(0).alias("run"), "hot", *all_m, *[(F.col(f"s_{i}") * F.col(f"s_{i}") if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i, j in _lower()])
    bent = {x: F.col(f"m_{i}") + F.col(f"s_{i}") * F.tanh((F.col(x) - F.col(f"m_{i}")) / F.col(f"s_{i}")) for i, x in enumerate(names)}
    both = _looked_up(stats, spread, ["g"], few).select("g", "hot", F.explode(F.array(F.struct(F.lit(1).alias("run"), *names), F.struct(F.lit(2).alias("run"), *[v.alias(x) for x, v in bent.items()]))).alias("x")).select("g", "hot", "x.*")
    return tables.cut(_factor(plain.unionByName(_moments(both))), "groups")


def _tree(sizes: DataFrame, levels: tuple[str, ...]) -> list[DataFrame]:
    """For each level of keys, the finest first: g, up (its key one level higher), n and hot (of so many rows that few groups can be)."""
    key = lambda i: F.concat(F.lit(f"{i}:"), F.col(levels[i]))
    up = lambda i: key(i + 1) if i + 1 < len(levels) else F.lit(None).cast("string")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    return [sizes.groupBy(key(i).alias("g"), up(i).alias("up")).agg(F.sum("n").alias("n")).withColumn("hot", F.col("n") > total / BROADCAST_GROUPS) for i in range(len(levels))]


def _leaning(tree: list[DataFrame], values: DataFrame, names: list[str], prior: float, few: bool) -> DataFrame:
    """g of the finest level, hot, and the names of values, each group's mixed with those of the level above by n and prior."""
    small = F.broadcast if few else lambda d: d
    out = tree[-1].join(small(values.select("g", *names)), "g")
    for level in reversed(tree[:-1]):
        above = out.select(F.col("g").alias("up"), *[F.col(x).alias(f"__{x}") for x in names])
        own = F.col("n") / (F.col("n") + F.lit(float(prior)))
        out = level.join(small(values.select("g", *names)), "g").join(small(above), "up").select("g", "n", "hot", *[(own * F.col(x) + (1 - own) * F.col(f"__{x}")).alias(x) for x in names])
    return out.select("g", "hot", *names)


def robust_outliers(stats: DataFrame, tables: Tables, core_share: float = 0.5, steps: int = 3, levels: tuple[str, ...] = ("g",), prior: float = PRIOR) -> DataFrame:
    """stats (with the FEATURES and the keys of levels, no null ones) with d2 by minimum-covariance-determinant estimates.

    Each key of each level, from the groups up to the whole table, is estimated: from each of
    three starts, concentration steps re-estimate from the core_share of documents nearest to the
    last estimate, which never raises the determinant; the estimate of least determinant counts.
    It bears just under one half of outliers. A group's centre and covariance are the means of its
    own, weighing as many as it has documents, and of the level above, weighing prior. Distances
    are rescaled to the median of their distribution, by no more than the consistency factor, as
    outliers raise that median; medians are mixed as the estimates are.
    """
    sizes = tables.cut(stats.groupBy(*levels).agg(F.count(F.lit(1)).alias("n")), "sizes")
    few = sizes.count() <= BROADCAST_GROUPS
    tree = _tree(sizes, levels)
    all_hot = None if few else F.broadcast(reduce(DataFrame.unionByName, [t.where("hot").select("g", "hot") for t in tree]))

    def keyed(rows: DataFrame, depth: int) -> DataFrame:
        """rows once for each of the first levels, under g."""
        d = rows.withColumn("g", F.explode(F.array(*[F.concat(F.lit(f"{i}:"), F.col(k)) for i, k in enumerate(levels[:depth])])))
        return d.withColumn("hot", F.lit(True)) if few else d.join(all_hot, "g", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))

    names = list(FEATURES)
    plain = stats.select(*[F.col(k).alias(f"__level_{i}") for i, k in enumerate(levels)], *names, F.struct(*stats.columns).alias("__row"))
    levels = tuple(f"__level_{i}" for i in range(len(levels)))
    of_levels = keyed(plain.drop("__row"), len(levels)).select("g", "hot", *names)
    group = _starts(of_levels, tables, few)
    runs = of_levels.withColumn("run", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    for _ in range(steps):
        seen = _distance(runs, group, few)
        edge = seen.groupBy("g", "run", "hot").agg(F.percentile_approx("d2", core_share, 1000).alias("edge"))
        edge = edge if few else tables.cut(edge, "groups")
        group = tables.cut(_factor(_moments(_looked_up(seen, edge, ["g", "run"], few).where("d2 <= edge"))), "groups")
    estimate = [f"m_{i}" for i in range(len(names))] + [f"c_{i}_{j}" for i, j in _lower()]
    best = group.groupBy("g").agg(F.min_by(F.struct(*estimate), F.struct("log_det", "run")).alias("x")).select("g", "x.*")
    best = tables.cut(_factor(_leaning(tree, best, estimate, prior, few)), "groups")
    seen = _distance(keyed(plain, 1), best, few)
    medians = keyed(seen.drop("g", "hot"), len(levels)).groupBy("g").agg((F.percentile_approx("d2", 0.5, 1000) / CHI2_MEDIAN).alias("scale"))
    scale = tables.cut(_leaning(tree, tables.cut(medians, "groups"), ["scale"], prior, few).withColumn("scale", F.greatest(F.lit(1.0), F.least(F.lit(CONSISTENCY), F.col("scale")))), "groups")
    return _looked_up(seen, scale, ["g"], few).select("__row.*", (F.col("d2") / F.col("scale")).alias("d2"))


def quality_rules(docs: DataFrame, prior: float = PRIOR, chi2_cut: float = CHI2_CUT, carry: tuple[str, ...] = (), least_words: int = 10, repeated_percent: int = 20) -> DataFrame:
    """doc_id, the counts, base_failed, distance (squared, null if base_failed), kept and the carried columns.

    docs needs doc_id, text, lang and source. Rows are kept one for one, so repeated ids are too.
    """
    tables = Tables(docs.sparkSession, "quality")
    stats = tables.cut(text_statistics(docs, carry).withColumn("base_failed", base_failed(least_words, repeated_percent)), "stats")
    value = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    good = stats.where("not base_failed").select("*", *[v.alias(k) for k, v in transformed().items()], F.concat(F.length(value("lang")).cast("string"), value("lang"), value("source")).alias("g"), value("lang").alias("lang_key"), F.lit("").alias("every"))
    judged = robust_outliers(good, tables, levels=("g", "lang_key", "every"), prior=prior)
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    kept = judged.select(*base, F.col("d2").alias("distance"), (F.col("d2") <= chi2_cut).alias("kept"), *carry)
    return stats.where("base_failed").select(*base, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"), *carry).unionByName(kept)
