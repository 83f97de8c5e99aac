"""Quality rules: base statistics and robust multivariate outliers, in DataFrame functions only (operator 9)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, key_of_id, saved, whole_row

SPACE = "[\\x20\\x09-\\x0D]+"
WINDOW = 8
#: Least standard deviation of each transformed statistic; keeps estimates of statistics that are mostly zero regular.
FLOORS = {"f_length": 0.08, "f_symbols": 0.12, "f_lines": 0.15, "f_repeats": 0.15}
FEATURES = tuple(FLOORS)
PARAMETERS = (*[f"m_{i}" for i in range(len(FEATURES))], *[f"l_{i}_{j}" for i in range(len(FEATURES)) for j in range(i + 1)])
GROUP_FILES = 4
#: Statistics lie on a grid of 2^-26 within +-31, so that their sums are whole numbers, exact in any order of rows.
GRID, BOUND = 2**26, 31.0
#: Squared distances are ranked to 2^-40, in bins of 2^-6 first; beyond 2^10 bins are one.
FINE, COARSE, BINS = 40, 34, 2**16
#: Concentration ends where half the determinant's logarithm falls by less than this, or after so many steps.
SETTLED, STEPS = 1e-6, 50


def statistics(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) to each row, as built-in expressions.

    Each array that a lambda reads stands in a projection of its own and is referred to twice, so that it isn't computed
    again for each element.
    """
    out = docs.withColumn("_text", F.coalesce(F.col("text"), F.lit("")))
    out = out.withColumn("_words", F.filter(F.split("_text", SPACE), lambda w: w != ""))
    out = out.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    out = out.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    out = out.select(
        *docs.columns,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_hashes") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("_hashes") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_hashes", i, WINDOW)))).otherwise(F.array().cast("array<bigint>")).alias("_grams"),
    )
    # Only texts with a repeated window sort theirs.
    out = out.withColumn("_sorted", F.when(F.size(F.array_distinct("_grams")) < F.size("_grams"), F.array_sort(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    out = out.withColumn("_starts", F.array_sort(F.transform(F.filter("_sorted", lambda x, i: (F.get(F.col("_sorted"), i - 1)["h"] == x["h"]) | F.coalesce(F.get(F.col("_sorted"), i + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"])))
    covered = F.aggregate("_starts", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")))["n"]
    return out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_grams", "_sorted", "_starts")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def features(stats: DataFrame) -> DataFrame:
    """Adds the transformed vector: log mean word length; square roots of the shares of symbols, lines and words; on the grid."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return stats.withColumns({
        "f_length": _on_grid(F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n)),
        "f_symbols": _on_grid(F.sqrt(F.col("n_symbols") / n)),
        "f_lines": _on_grid(F.sqrt(F.least(F.lit(1.0), 8 * F.col("n_dup_lines") / n))),
        "f_repeats": _on_grid(F.sqrt(F.col("n_repeat_words") / n)),
    })


def _on_grid(c: Column) -> Column:
    return F.round(F.greatest(F.least(c, F.lit(BOUND)), F.lit(-BOUND)) * GRID) / GRID


def chi2_cdf(x: float, dof: int) -> float:
    """For an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))


def chi2_quantile(p: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, dof) < p else (low, mid)
    return high


def _cholesky(moments: DataFrame, scale: float, keys: tuple[str, ...]) -> DataFrame:
    """(keys, m_i, l_i_j, log_det): means and the Cholesky factor of the scaled covariance plus floors, from grouped moments, and half
    the logarithm of its determinant."""
    p = len(FEATURES)
    for i in range(p):
        for j in range(i + 1):
            v = scale * F.greatest(F.col(f"s_{i}_{j}") - F.col(f"m_{i}") * F.col(f"m_{j}"), F.lit(0.0) if i == j else F.lit(-1e9))
            if i == j:
                v = v + FLOORS[FEATURES[i]] ** 2
            for k in range(j):
                v = v - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            moments = moments.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(v, F.lit(1e-9))) if i == j else v / F.col(f"l_{j}_{j}"))
    log_det = sum((F.log(f"l_{i}_{i}") for i in range(1, p)), F.log("l_0_0"))
    return moments.select(*keys, *PARAMETERS, log_det.alias("log_det"))


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    z: list[Column] = []
    for i, f in enumerate(FEATURES):
        v = F.col(f) - F.col(f"m_{i}")
        for k in range(i):
            v = v - F.col(f"l_{i}_{k}") * z[k]
        z.append(v / F.col(f"l_{i}_{i}"))
    return sum((x * x for x in z[1:]), z[0] * z[0])


def _by_group(table: DataFrame, tag: str) -> DataFrame:
    """Writes a table of a row for each group to few files: many would each add some kilobytes to what Spark takes for its
    size when it checks whether it may broadcast it."""
    return saved(table.repartition(GROUP_FILES), tag)


def group_names(stats: DataFrame, min_group: int) -> DataFrame:
    """(_lang, _source, grp, feeds) of ``stats``: grp, whose estimates judge the rows, is language and source; the language alone
    where they have under ``min_group`` rows that pass the base; or one for all. feeds: the groups whose estimates the rows
    enter, so that those of a language, or of all, come from all of its rows, whatever group judges them."""
    both = _by_group(stats.groupBy("_lang", "_source").agg(F.count_if(~F.col("base_failed")).alias("_n")), "sizes")
    sizes = both.join(both.groupBy("_lang").agg(F.sum("_n").alias("_m")), "_lang")
    by_lang = F.concat_ws("\x1f", F.lit("1"), "_lang")
    name = F.when(F.col("_n") >= min_group, F.concat_ws("\x1f", F.lit("2"), "_lang", "_source")).when(F.col("_m") >= min_group, by_lang).otherwise(F.lit("0"))
    names = _by_group(sizes.select("_lang", "_source", name.alias("grp")), "names")
    used = names.join(names.groupBy("_lang").agg(F.max(F.col("grp") == by_lang).alias("_by_lang")), "_lang").crossJoin(F.broadcast(names.agg(F.max(F.col("grp") == "0").alias("_by_all"))))
    feeds = F.array_distinct(F.array_compact(F.array("grp", F.when(F.col("_by_lang"), by_lang), F.when(F.col("_by_all"), F.lit("0")))))
    return _by_group(used.select("_lang", "_source", "grp", feeds.alias("feeds")), "feeds")


def _totals(values: list[Column]) -> list[Column]:
    """Number of rows and exact sums of values on the grid and of their products."""
    whole = [(v * GRID).cast("long") for v in values]
    return [F.count("*").alias("n"), *[F.sum(k.cast("decimal(20,0)")).alias(f"t_{i}") for i, k in enumerate(whole)], *[F.sum((whole[i] * whole[j]).cast("decimal(20,0)")).alias(f"t_{i}_{j}") for i in range(len(whole)) for j in range(i + 1)]]


def _moments(table: DataFrame, *others: str) -> DataFrame:
    """Means m_i and mean products s_i_j from totals."""
    p = len(FEATURES)
    means = [(F.col(f"t_{i}").cast("double") / F.col("n") / GRID).alias(f"m_{i}") for i in range(p)]
    return table.select(*others, *means, *[(F.col(f"t_{i}_{j}").cast("double") / F.col("n") / GRID / GRID).alias(f"s_{i}_{j}") for i in range(p) for j in range(i + 1)])


#: Columns of ``_totals``.
TOTALS = ("n", *[f"t_{i}" for i in range(len(FEATURES))], *[f"t_{i}_{j}" for i in range(len(FEATURES)) for j in range(i + 1)])


def _quartiles(rows: DataFrame) -> DataFrame:
    """(grp, feature, q25, q50, q75): exact order statistics, from counts of values in bins, then of the values in the bins that hold them."""
    long = rows.select("grp", F.posexplode(F.array(*[(F.col(f) * GRID).cast("long") for f in FEATURES])).alias("feature", "v")).withColumn("bin", F.shiftright("v", 16))
    by = ("grp", "feature")
    counted = long.groupBy(*by, "bin").agg(F.count("*").alias("n"))
    so_far = Window.partitionBy(*by).orderBy("bin")
    counted = counted.select(*by, "bin", "n", F.sum("n").over(so_far).alias("c"), F.sum("n").over(Window.partitionBy(*by)).alias("all"))
    wanted = counted.withColumn("q", F.explode(F.array(F.lit(25), F.lit(50), F.lit(75)))).withColumn("rank", F.floor((F.col("q") * F.col("all") + 99) / 100)).where((F.col("c") - F.col("n") < F.col("rank")) & (F.col("rank") <= F.col("c")))
    wanted = _by_group(wanted.select(*by, "bin", "q", (F.col("rank") - F.col("c") + F.col("n")).alias("rest")), "quartiles")
    inner = long.join(wanted, [*by, "bin"]).groupBy(*by, "q", "rest", "v").agg(F.count("*").alias("n"))
    inner = inner.withColumn("c", F.sum("n").over(Window.partitionBy(*by, "q").orderBy("v"))).where("c >= rest")
    return inner.groupBy(*by).agg(*[(F.min(F.when(F.col("q") == q, F.col("v"))) / GRID).alias(f"q{q}") for q in (25, 50, 75)])


def _starts(rows: DataFrame, scale: float) -> DataFrame:
    """Three first estimates of each group: medians and quartile ranges; means and covariances of all rows; medians and
    covariances of the hyperbolic tangents of standardised values, which bound what a far row adds."""
    p = len(FEATURES)
    quartiles = _quartiles(rows).groupBy("grp").agg(*[F.max(F.when(F.col("feature") == i, F.col(f"q{q}"))).alias(f"q{q}_{i}") for i in range(p) for q in (25, 50, 75)])
    centre = _by_group(quartiles.select("grp", *[F.col(f"q50_{i}").alias(f"c_{i}") for i in range(p)], *[F.greatest((F.col(f"q75_{i}") - F.col(f"q25_{i}")) / 1.349, F.lit(FLOORS[f])).alias(f"w_{i}") for i, f in enumerate(FEATURES)]), "centres")

    def around(table: DataFrame, start: int, covariance) -> DataFrame:
        # Moments that give this covariance about the medians once scaled.
        means = [F.col(f"c_{i}").alias(f"m_{i}") for i in range(p)]
        return table.select("grp", F.lit(start).alias("start"), *means, *[(covariance(i, j) / scale + F.col(f"c_{i}") * F.col(f"c_{j}")).alias(f"s_{i}_{j}") for i in range(p) for j in range(i + 1)])

    tangents = [_on_grid(F.tanh((F.col(f) - F.col(f"c_{i}")) / F.col(f"w_{i}"))) for i, f in enumerate(FEATURES)]
    bounded = _moments(rows.join(centre, "grp").groupBy("grp").agg(*_totals(tangents)), "grp").join(centre, "grp")
    spread = around(centre, 0, lambda i, j: F.col(f"w_{i}") * F.col(f"w_{i}") if i == j else F.lit(0.0))
    whole = _moments(rows.groupBy("grp").agg(*_totals([F.col(f) for f in FEATURES])), "grp").withColumn("start", F.lit(1))
    outer = around(bounded, 2, lambda i, j: (F.col(f"s_{i}_{j}") - F.col(f"m_{i}") * F.col(f"m_{j}")) * F.col(f"w_{i}") * F.col(f"w_{j}"))
    return spread.unionByName(whole).unionByName(outer)


def _concentrated(rows: DataFrame, now: DataFrame, share: float, keys: tuple[str, ...]) -> DataFrame:
    """Totals of the ``share`` of rows (rounded up) that are nearest to each estimate of ``now``, with all that are as near as the last.

    Rows are counted and summed by bins of their squared distance; bins below the one that holds the last row are taken whole, and only
    the rows of that bin are ranked by their own distances. Both passes combine in the tasks before the shuffle.
    """
    values = [F.col(f) for f in FEATURES]
    place = F.floor(F.least(_distance(), F.lit(2.0**20)) * 2.0**FINE)
    far = rows.join(now.drop("log_det"), "grp").select(*keys, *FEATURES, place.alias("v")).withColumn("bin", F.least(F.shiftright("v", COARSE), F.lit(BINS)))
    bins = far.groupBy(*keys, "bin").agg(*_totals(values))
    bins = bins.select(*keys, "bin", *TOTALS, F.sum("n").over(Window.partitionBy(*keys).orderBy("bin")).alias("c"), F.sum("n").over(Window.partitionBy(*keys)).alias("all"))
    rank = F.ceil(F.col("all") * share)
    below, edge = F.col("c") < rank, (F.col("c") >= rank) & (F.col("c") - F.col("n") < rank)
    taken = bins.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(below, F.col(t))), F.lit(0)).alias(f"whole_{t}") for t in TOTALS], F.max(F.when(edge, F.col("bin"))).alias("edge"), F.max(F.when(edge, rank - F.col("c") + F.col("n"))).alias("rest"))
    taken = _by_group(taken, "taken")
    inner = far.join(taken.select(*keys, "edge", "rest"), list(keys)).where("bin = edge").groupBy(*keys, "rest", "v").agg(*_totals(values))
    inner = inner.withColumn("c", F.sum("n").over(Window.partitionBy(*keys).orderBy("v"))).where(F.col("c") - F.col("n") < F.col("rest"))
    inner = inner.groupBy(*keys).agg(*[F.sum(t).alias(t) for t in TOTALS])
    return inner.join(taken, list(keys)).select(*keys, *[(F.col(t) + F.col(f"whole_{t}")).alias(t) for t in TOTALS])


def minimum_covariance(rows: DataFrame, share: float = 0.75) -> DataFrame:
    """Minimum-covariance-determinant estimates of each ``grp``, by concentration from three starts.

    Each step takes the ``share`` of rows nearest by distance and estimates mean and covariance from them, the
    covariance scaled to be consistent for normal data and with ``FLOORS`` on its diagonal. A start is left once its
    determinant no longer falls; of all estimates on the way, a group takes that of least determinant. Ranks are exact and sums are
    of whole numbers, so the result doesn't depend on how rows are parted.
    Tables with a row for each group and start are written first, so that Spark knows their size: while they are under its
    broadcast threshold no row of ``rows`` is shuffled. Above it, from thousands of groups, rows meet them by sort-merge
    joins, whose skewed keys Spark splits.
    """
    keys = ("grp", "start")
    rows = saved(rows.select("grp", *[_on_grid(F.col(f)).alias(f) for f in FEATURES]), "features")
    scale = share / chi2_cdf(chi2_quantile(share, len(FEATURES)), len(FEATURES) + 2)
    # The first determinant isn't of a subset, so it is never the least.
    now = _by_group(_cholesky(_starts(rows, scale), scale, keys).withColumn("log_det", F.lit(float("inf"))), "mcd")
    tried = None
    for _ in range(STEPS):
        found = _cholesky(_moments(_concentrated(rows, now, share, keys), *keys), scale, keys)
        falls, seen = F.col("log_det") < F.col("_before") - SETTLED, Observation()
        step = found.join(now.select(*keys, F.col("log_det").alias("_before")), list(keys))
        step = _by_group(step.observe(seen, F.count_if(falls).alias("n")), "mcd")
        tried = step.drop("_before") if tried is None else tried.unionByName(step.drop("_before"))
        if not seen.get["n"]:
            break
        now = step.where(falls).drop("_before")
    # Equal determinants of two starts: the first.
    best = tried.groupBy("grp").agg(F.min_by(F.struct(*PARAMETERS), F.struct(F.round("log_det", 9), "start")).alias("best"))
    return _by_group(best.select("grp", "best.*"), "best")


def judged(docs: DataFrame, level: float = 0.9999, min_group: int = 100, share: float = 0.75) -> DataFrame:
    """Per row: key, doc_id, text hash, the five statistics, ``base_failed``, ``distance`` and ``kept``.

    A row that passes the base is rejected if its squared Mahalanobis distance from its group's robust centre passes the
    chi-squared quantile of ``level``. Null texts are empty and fail the base; null lang and source are the empty string;
    a group that is too small uses the estimates of all its language's rows, or of all rows; repeated rows each get a row; an empty table
    gives no rows. Texts are read once; what follows works on a table of numbers in the shared folder.
    """
    rows = docs.select(key_of_id().alias("_key"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_hash"), F.coalesce("lang", F.lit("")).alias("_lang"), F.coalesce("source", F.lit("")).alias("_source"), "text")
    stats = saved(features(statistics(rows).drop("text").withColumn("base_failed", base_failed())), "quality")
    named = stats.join(group_names(stats, min_group), ["_lang", "_source"])
    estimates = minimum_covariance(named.where("not base_failed").select(F.explode("feeds").alias("grp"), *FEATURES), share)
    out = named.join(estimates, "grp", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= chi2_quantile(level, len(FEATURES)))
    return out.select("_key", "_hash", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance", "_lang", "_source")


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The documents that are kept, all columns.

    Rows of equal id, text, language and source share a verdict. Null and empty texts fail the base and go; null lang and
    source are the empty string; repeated rows stay or go together; an empty table gives no rows.
    """
    same = ["_key", "_hash", "_lang", "_source"]
    good = judged(docs, **options).where("kept").select(*same).distinct()
    rows = docs.select(whole_row(docs), key_of_id().alias("_key"), F.xxhash64("text").alias("_hash"), F.coalesce("lang", F.lit("")).alias("_lang"), F.coalesce("source", F.lit("")).alias("_source"))
    return rows.join(good, same, "left_semi").select("row.*")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir)).drop("_key", "_hash", "_lang", "_source")
