"""Metrics of retrieval, verification and detection, and a search over fusion weights."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import running


#: Cumulative chances of Poisson(1), to six.
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(7)]


def recall_at(ranked: DataFrame, judged: DataFrame, query: str, item: str, rank: str, k: int = 10) -> DataFrame:
    """Mean over queries with a relevant item of the share of these in the first k."""
    hits = judged.join(ranked.filter(F.col(rank) <= k).select(query, item, F.lit(1).alias("hit")), [query, item], "left")
    per = hits.groupBy(query).agg((F.count("hit") / F.count(F.lit(1))).alias("r"))
    return per.agg(F.avg("r").alias("recall"))


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two raters; 1 if both always give the same single label."""
    cells = pairs.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    rows, columns = cells.groupBy(F.col(a).alias("label")).agg(F.sum("n").alias("ra")), cells.groupBy(F.col(b).alias("label")).agg(F.sum("n").alias("rb"))
    chance = rows.join(columns, "label").agg(F.sum(F.col("ra") * F.col("rb")).alias("c"))
    t, c = total.first(), chance.first()
    n = t.n or 1
    observed, expected = (t.same or 0) / n, (c.c or 0) / (n * n)
    value = 1.0 if expected == 1 else (observed - expected) / (1 - expected)
    return pairs.sparkSession.createDataFrame([(float(value),)], "kappa double")


def roc(scores: DataFrame, score: str, truth: str) -> DataFrame:
    """(score, tpr, fpr, dt, df) at each distinct score as a threshold, and the score's own shares; ties
    go together."""
    at = scores.groupBy(score).agg(F.sum(F.col(truth).cast("long")).alias("p"), F.sum((~F.col(truth)).cast("long")).alias("q"))
    p, q = at.agg(F.sum("p"), F.sum("q")).first()
    sums = running(at, [F.desc(score)], {"tp": F.col("p"), "fp": F.col("q")})
    rate = lambda c, n: c / F.lit(float(n or 1))
    return sums.select(score, rate(F.col("tp"), p).alias("tpr"), rate(F.col("fp"), q).alias("fpr"), rate(F.col("p"), p).alias("dt"), rate(F.col("q"), q).alias("df"))


def auc(scores: DataFrame, score: str, truth: str) -> DataFrame:
    """Area under the curve, and the threshold with the largest tpr - fpr (the highest of them)."""
    step = roc(scores, score, truth).withColumn("w", F.col("df")).withColumn("h", F.col("tpr") - F.col("dt") / 2)
    best = F.max(F.struct(F.round(F.col("tpr") - F.col("fpr"), 12).alias("j"), F.col(score).alias("t")))
    return step.agg(F.sum(F.col("w") * F.col("h")).alias("auc"), best.alias("b")).select("auc", F.col("b.t").alias("threshold"))


def tar_at_far(scores: DataFrame, score: str, truth: str, far: float) -> DataFrame:
    """The largest share of true pairs accepted while at most ``far`` of the false ones are."""
    return roc(scores, score, truth).filter(F.col("fpr") <= far).agg(F.coalesce(F.max("tpr"), F.lit(0.0)).alias("tar"))


def identification(probes: DataFrame, score: str, mated: str, right: str, threshold: float) -> DataFrame:
    """rank_1, fnir and fpir of the best candidates of probes (one row a probe): the share of mated
    probes whose best is right; of mated ones that is not right or below the threshold; of unmated
    ones whose best reaches it."""
    hit, over = F.col(mated) & F.col(right), F.col(score) >= threshold
    m, u = F.greatest(F.count_if(F.col(mated)), F.lit(1)), F.greatest(F.count_if(~F.col(mated)), F.lit(1))
    return probes.agg((F.count_if(hit) / m).alias("rank_1"), (F.count_if(F.col(mated) & ~(F.col(right) & over)) / m).alias("fnir"), (F.count_if(~F.col(mated) & over) / u).alias("fpir"))


def detection(pairs: DataFrame, found: str, truth: str) -> DataFrame:
    """precision, recall and f1 of boolean verdicts; 0 where a denominator is."""
    tp, p, t = F.count_if(F.col(found) & F.col(truth)), F.count_if(found), F.count_if(truth)
    part = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    return pairs.agg(part(tp, p).alias("precision"), part(tp, t).alias("recall"), part(2 * tp, p + t).alias("f1"))


def interval_iou(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Overlap of two intervals (begin, end) as a share of their union; 0 if they do not meet."""
    inner = F.greatest(F.lit(0.0), F.least(a[1], b[1]) - F.greatest(a[0], b[0]))
    union = (a[1] - a[0]) + (b[1] - b[0]) - inner
    return F.when(union > 0, inner / union).otherwise(0.0)


def catalogue_use(recommended: DataFrame, catalogue: DataFrame, sold: DataFrame, item: str, times: str) -> DataFrame:
    """coverage (share of the catalogue that is recommended to someone) and popularity (mean times
    sold of what is recommended, by recommendation; an item never sold counts 0)."""
    n = recommended.select(item).distinct().join(catalogue.select(item).distinct(), item, "left_semi").agg(F.count(F.lit(1)).alias("n"))
    of = catalogue.agg(F.count_distinct(item).alias("of"))
    mean = recommended.join(sold.select(item, times), item, "left").agg(F.avg(F.coalesce(times, F.lit(0)).cast("double")).alias("popularity"))
    row_n, row_of = n.first()[0], of.first()[0]
    return mean.select(F.lit(row_n / max(1, row_of)).alias("coverage"), "popularity")


def bootstrap_means(per: DataFrame, key: str, value: str, rounds: int = 100, seed: int = 7) -> DataFrame:
    """(round, mean) of resamples of the rows: in each, a row counts a Poisson(1) number of times, drawn
    by MD5 from its key, the round and the seed. Percentiles of the means are an interval."""
    each = per.select(key, value, F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("round").cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    times = sum(((u >= edge).cast("int") for edge in POISSON), F.lit(0))
    return each.withColumn("w", times).groupBy("round").agg((F.sum(F.col("w") * F.col(value)) / F.greatest(F.sum("w"), F.lit(1))).alias("mean"))


def simplex(names: list[str], steps: int) -> list[dict[str, float]]:
    """All weights of whole steps that sum to 1."""
    cuts = itertools.combinations(range(steps + len(names) - 1), len(names) - 1)
    return [{n: (b - a - 1) / steps for n, a, b in zip(names, (-1, *c), (*c, steps + len(names) - 1))} for c in cuts]


def best_weights(candidates: DataFrame, user: str, item: str, hit: str, signals: list[str], steps: int = 10, k: int = 10) -> DataFrame:
    """(weights..., ndcg, hit_rate) of every point of the simplex, the best first.

    ``candidates`` has a value of each signal; the grid has a bounded number of points, so each row
    is scored against it, and users are ranked apart.
    """
    grid = simplex(signals, steps)
    points = F.array(*[F.struct(F.lit(i).alias("g"), sum((F.lit(w[s]) * F.col(s) for s in signals), F.lit(0.0)).alias("score")) for i, w in enumerate(grid)])
    scored = candidates.select(user, item, hit, F.explode(points).alias("p")).select(user, item, hit, F.col("p.g").alias("g"), F.round("p.score", 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy("g", user).orderBy(F.desc("score"), item))
    inside = scored.withColumn("rank", rank).filter(F.col("rank") <= k)
    per = inside.groupBy("g", user).agg(F.max(F.when(F.col(hit), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("n"), F.max(F.col(hit).cast("double")).alias("h"))
    means = per.groupBy("g").agg(F.avg("n").alias("ndcg"), F.avg("h").alias("hit_rate"))
    named = [F.element_at(F.array(*[F.lit(w[s]) for w in grid]), F.col("g") + 1).alias(s) for s in signals]
    return means.select(*named, "ndcg", "hit_rate").orderBy(F.desc("ndcg"), F.desc("hit_rate"), *signals)
