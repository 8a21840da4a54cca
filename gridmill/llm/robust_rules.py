"""Quality rules with robust multivariate outliers, in DataFrame functions only.

Base rules look at one document. The method then fits, for each language and source, the mean and the
covariance of transformed statistics on the most central half of the documents (minimum covariance
determinant by concentration steps) and rejects those whose Mahalanobis distance is too large. Copies of a
text count once in the fit, so that one group of them cannot take the place of the others. Means and
covariances are sums that combine before the shuffle. Quantiles are read from counts of fixed-width
buckets, which combine, too, so a source with a third of all rows costs no task more than another.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.llm.grouping import join_group_facts
from gridmill.llm.scratch import Scratch

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 8
VECTOR = ["word_length", "symbols", "dup_lines", "repeats", "capitals", "same_words"]
#: Standard deviations that every statistic is granted, as many clean texts have none of a kind.
FLOORS = [0.15, 0.25, 0.25, 0.25, 0.25, 0.15]
#: Pseudo-words that pull the statistics of short texts to the middle: as many as the shortest text that passes has words.
PRIOR = 20
BUCKETS = 32


def chi_square(x: float, p: int) -> float:
    """The chi-square distribution function with ``p`` degrees of freedom."""
    k = 2 - p % 2
    below = math.erf(math.sqrt(x / 2)) if k == 1 else -math.expm1(-x / 2)
    for df in range(k, p, 2):
        below -= (x / 2) ** (df / 2) * math.exp(-x / 2) / math.gamma(df / 2 + 1)
    return below


def chi_square_quantile(share: float, p: int) -> float:
    low, high = 0.0, 1.0
    while chi_square(high, p) < share:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, p) < share else (low, middle)
    return high


def consistency(central: float, p: int) -> float:
    """What makes up for the covariance of the ``central`` part of normal data of ``p`` statistics being too small."""
    return central / chi_square(chi_square_quantile(central, p), p + 2) if central < 1 else 1.0


def base_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of the base rules; besides ``n_capitals``, ``n_lines``,
    ``n_word_pairs`` (pairs of places with one word) and the text's hash ``raw``."""
    text = F.coalesce("text", F.lit(""))
    split = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.xxhash64(text).alias("raw"),
        F.regexp_count(text, F.lit(SYMBOL)).cast("bigint").alias("n_symbols"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("bigint").alias("n_capitals"),
        F.array_remove(F.split(text, SPACE), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD)).alias("lines"),
    )
    counted = split.select(
        "doc_id", "lang", "source", "raw", "n_symbols", "n_capitals",
        F.size("words").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    # Each step reads arrays that are columns: inside a lambda an expression would be worked out per element.
    n = F.size("hashes") - (WINDOW - 1)
    none = F.array().cast("array<bigint>")
    counted = counted.withColumn("sorted", F.sort_array("hashes"))
    start = F.struct(F.lit(None).cast("bigint").alias("word"), F.lit(0).cast("bigint").alias("run"), F.lit(0).cast("bigint").alias("pairs"))

    def next_word(a: Column, word: Column) -> Column:
        run = F.when(a["word"] == word, a["run"] + 1).otherwise(F.lit(0).cast("bigint"))
        return F.struct(word.alias("word"), run.alias("run"), (a["pairs"] + run).alias("pairs"))

    counted = counted.withColumn("n_word_pairs", F.aggregate("sorted", start, next_word)["pairs"]).drop("sorted")
    windows = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice("hashes", i, WINDOW)))
    counted = counted.withColumn("windows", F.when(n > 0, windows).otherwise(none)).drop("hashes")
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("hash"), i.alias("place"))))
    once = F.size(F.array_distinct("windows")) == F.size("windows")
    counted = counted.withColumn("placed", F.when(~once, placed)).drop("windows")
    same = lambda x, k: F.get("placed", k)["hash"] == x["hash"]
    repeated = F.filter("placed", lambda x, k: F.coalesce(same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False)))
    counted = counted.withColumn("starts", F.sort_array(F.transform(repeated, lambda x: x["place"]))).drop("placed")
    covers = F.transform("starts", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", k + 1) - x, F.lit(WINDOW))))
    total = F.aggregate(covers, F.lit(0), lambda a, x: a + x)
    return counted.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("bigint")).drop("starts")


def statistic_vector(stats: DataFrame) -> DataFrame:
    """Adds the transformed statistics named in ``VECTOR``."""
    words, chars = F.col("n_words") + PRIOR, F.col("word_chars") + 5 * PRIOR
    share = lambda part, whole: F.log1p(10 * F.col(part) / whole)
    return stats.withColumns(
        {
            "word_length": chars / words,
            "symbols": share("n_symbols", words),
            "dup_lines": share("n_dup_lines", F.col("n_lines") + 5),
            "repeats": share("n_repeat_words", words),
            "capitals": share("n_capitals", chars),
            # The chance that two words are one; its root is near the share of a word that stands out.
            "same_words": F.log1p(10 * F.sqrt(2 * F.col("n_word_pairs") / (words * (words - 1)))),
        }
    )


def _quantile(buckets: DataFrame, key: list[str], share: float) -> DataFrame:
    """The bucket in which the rows of each key, ordered by bucket, reach ``share`` of their number."""
    counts = buckets.groupBy(*key, "bucket").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy(*key)
    so_far = F.sum("n").over(own.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    reached = counts.withColumn("reached", so_far >= share * F.sum("n").over(own)).where("reached")
    return reached.groupBy(*key).agg(F.min("bucket").alias("bucket"))


def _middle(values: DataFrame) -> DataFrame:
    """The median of every statistic of every cell, from (cell, values)."""
    long = values.select("cell", F.posexplode("values").alias("name", "value"))
    buckets = long.select("cell", "name", F.floor(F.col("value") * BUCKETS).alias("bucket"))
    at = _quantile(buckets, ["cell", "name"], 0.5)
    pairs = F.sort_array(F.collect_list(F.struct("name", ((F.col("bucket") + 0.5) / BUCKETS).alias("value"))))
    return at.groupBy("cell").agg(pairs["value"].alias("middle"))


def _cells(stats: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """Adds ``cell``: language and source, or where those have few rows to fit on, the language, or all."""
    fits = F.count_distinct(F.when(~F.col("base_failed"), F.col("raw")))
    groups = scratch.store(stats.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("size"), fits.alias("fits")), "groups")
    rest = groups.where(F.col("fits") < least).groupBy("lang").agg(F.sum("fits").alias("rest_fits"))
    cell = (
        F.when(F.col("fits") >= least, F.to_json(F.struct("lang", "source")))
        .when(F.col("rest_fits") >= least, F.to_json(F.struct("lang")))
        .otherwise("{}")
    )
    named = scratch.store(groups.join(rest, "lang", "left").select("lang", "source", "size", cell.alias("cell")), "cells")
    joined = join_group_facts(stats, stats.count(), named, ["lang", "source"], "size")
    return joined.withColumn("cell", F.col("facts.cell")).drop("facts")


def _distance(values: Column, center: Column, whiten: Column) -> Column:
    """Squared distance: the length of the centered values times the lower triangular ``whiten`` (rows of rows)."""
    z = [sum(((values[j] - center[j]) * whiten[i][j] for j in range(1, i + 1)), (values[0] - center[0]) * whiten[i][0]) for i in range(len(VECTOR))]
    return sum((F.pow(x, F.lit(2.0)) for x in z[1:]), F.pow(z[0], F.lit(2.0)))


def _estimate(rows: DataFrame, scale: float) -> DataFrame:
    """Center and inverse Cholesky factor of the covariance of every cell, over (cell, values)."""
    p = len(VECTOR)
    sums = {f"m{i}": F.avg(F.col("values")[i]) for i in range(p)}
    sums |= {f"c{i}{j}": F.avg(F.col("values")[i] * F.col("values")[j]) for i in range(p) for j in range(i + 1)}
    found = rows.groupBy("cell").agg(*[c.alias(name) for name, c in sums.items()])
    for i in range(p):
        for j in range(i + 1):
            rest = scale * (F.col(f"c{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}"))
            if i == j:
                rest = rest + FLOORS[i] ** 2
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            value = F.sqrt(F.greatest(rest, F.lit(1e-6))) if i == j else rest / F.col(f"l{j}{j}")
            found = found.withColumn(f"l{i}{j}", value)
    for i in range(p):
        for j in range(i + 1):
            rest = sum((-F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)), F.lit(float(i == j)))
            found = found.withColumn(f"w{i}{j}", rest / F.col(f"l{i}{i}"))
    zero = F.lit(0.0)
    whiten = F.array(*[F.array(*[F.col(f"w{i}{j}") if j <= i else zero for j in range(p)]) for i in range(p)])
    return found.select("cell", F.array(*[F.col(f"m{i}") for i in range(p)]).alias("center"), whiten.alias("whiten"))


def robust_rules(
    docs: DataFrame,
    min_words: int = 20,
    max_repeat_percent: int = 30,
    central: float = 0.5,
    steps: int = 3,
    quantile: float = 0.999,
    least: int = 100,
) -> DataFrame:
    """The base counts of every document, whether it fails a base rule, its distance and whether it is kept.

    Base rules: fewer than ``min_words`` words, or more than ``max_repeat_percent`` of the words in 8-word
    windows that occur twice or more. ``central`` is the part of each cell the covariance is fitted on (with a
    half, nearly as many may be junk), ``steps`` the number of concentration steps, ``quantile`` sets the largest squared
    distance that is kept: that of the chi-square distribution with one degree of freedom for each of the six
    statistics (22.46 for 0.999), as squared distances of normal data follow it. The covariance is multiplied by what makes up for the part left out in normal data. A
    language and source with fewer than ``least`` different texts to fit on is taken together with the other such sources of the language. Null text, language or source count as
    empty; an empty text fails the base rules; equal rows are judged alike; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "robust-rules")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    stats = statistic_vector(base_statistics(docs).withColumn("base_failed", failed))
    stats = scratch.store(stats.withColumn("values", F.array(*VECTOR)).drop(*VECTOR), "stats")
    stats = scratch.store(_cells(stats, least, scratch), "in_cells")
    fit = scratch.store(stats.where("not base_failed").select("cell", "raw", "values").distinct().drop("raw"), "fit")
    n_rows, scale = stats.count(), consistency(central, len(VECTOR))
    cutoff = chi_square_quantile(quantile, len(VECTOR))
    sizes = stats.groupBy("cell").agg(F.count(F.lit(1)).alias("size"))

    def with_facts(rows: DataFrame, facts: DataFrame, name: str) -> DataFrame:
        stored = scratch.store(facts.join(sizes, "cell"), name)
        return join_group_facts(rows, n_rows, stored, ["cell"], "size")

    # Start: distances from the medians, in units of the median deviations.
    centered = with_facts(fit, _middle(fit), "medians")
    spread = F.transform(F.arrays_zip("values", "facts.middle"), lambda x: F.abs(x["values"] - x["middle"]))
    spreads = _middle(centered.select("cell", spread.alias("values"))).withColumnRenamed("middle", "spread")
    start = with_facts(centered.select("cell", "values", F.col("facts.middle").alias("middle")), spreads, "spreads")
    unit = lambda i: F.greatest(1.4826 * F.col("facts.spread")[i], F.lit(FLOORS[i]))
    parts = [F.pow((F.col("values")[i] - F.col("middle")[i]) / unit(i), 2) for i in range(len(VECTOR))]
    ranked = start.select("cell", "values", sum(parts[1:], parts[0]).alias("distance"))
    for step in range(steps):
        # Concentration: estimate anew on the most central documents.
        bucket = F.floor(F.log(F.col("distance") + 1e-6) * BUCKETS)
        bounds = _quantile(ranked.select("cell", bucket.alias("bucket")), ["cell"], central)
        bound = with_facts(ranked.withColumn("bucket", bucket), bounds, f"bounds{step}")
        inner = bound.where(F.col("bucket") <= F.col("facts.bucket"))
        estimate = with_facts(stats if step == steps - 1 else fit, _estimate(inner, scale), f"estimate{step}")
        ranked = estimate.withColumn(
            "distance", _distance(F.col("values"), F.col("facts.center"), F.col("facts.whiten"))
        ).drop("facts")
    near = F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    return ranked.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & near).alias("kept"), F.round("distance", 6).alias("distance"),
    )
