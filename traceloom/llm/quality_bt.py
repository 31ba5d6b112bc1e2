"""Bradley-Terry pairwise ranking of quality.

Each document has a strength, linear in measured features; of a pair of labelled documents the better one wins with
probability sigmoid(strength difference). Pairs of a good and a bad document give a logistic loss on feature differences.
The cut is a quantile of the labelled strengths, the one with the best balanced accuracy there, and a score is the
sigmoid of the distance to it, so that the cut scores CUT_SCORE, and a tie with the cut counts as good. Features come from the text
alone: rows with equal or null ids, repeated rows and extra columns of any name are scored each for itself, and a labelled id counts
once, with one of its texts. Null, empty and very long texts are scored like any other, whole; without labels of both kinds every
document has score 0.5; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import crc_of_id, scratch, written
from .textstats import with_stats

#: Labelled documents of each kind that the fit takes at most, and pairs drawn from them.
MAX_LABELLED, PAIRS, STEPS, RIDGE, CUT_SCORE = 10_000, 100_000, 300, 1e-4, 0.3


def features() -> list[Column]:
    """Measures of a text as ratios within fixed bounds."""

    def ratio(a: str, b: str, most: float) -> Column:
        return F.least(F.lit(most), F.col(a) / F.greatest(F.lit(1), F.col(b)))

    plain = [
        F.log1p("n_words"), ratio("n_symbols", "n_words", 2.0), ratio("n_dup_lines", "n_lines", 1.0), ratio("n_repeat_words", "n_words", 1.0),
        ratio("n_upper", "n_letters", 1.0), ratio("n_digits", "word_chars", 1.0), ratio("n_shouts", "n_words", 2.0), ratio("n_bars", "n_words", 2.0),
        ratio("n_stops", "n_words", 1.0), ratio("word_chars", "n_words", 20.0), ratio("n_marks", "n_words", 3.0), ratio("n_distinct", "n_words", 1.0),
        F.log1p(F.col("n_words") / F.greatest(F.lit(1), F.col("n_lines"))),
    ]
    flags = [(F.col(a) * k > F.col(b)).cast("double") for a, b, k in (("n_symbols", "n_words", 5), ("n_shouts", "n_words", 5), ("n_bars", "n_words", 5), ("n_repeat_words", "n_words", 2), ("n_repeat_words", "n_words", 5), ("n_dup_lines", "n_lines", 3), ("n_upper", "n_letters", 2))]
    return [F.coalesce(c.cast("double"), F.lit(0.0)) for c in [*plain, *flags]]


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float, float]:
    """weights, cut and slope of strengths x @ weights, from labels y."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = (x - mean) / scale
    diff = z[rng.choice(good, PAIRS)] - z[rng.choice(bad, PAIRS)]
    w = np.zeros(x.shape[1])
    speed, grad2 = 0.3, np.full(x.shape[1], 1e-8)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        g = -(diff * p[:, None]).mean(0) + RIDGE * w
        grad2 += g * g
        w -= speed * g / np.sqrt(grad2)
    strength = z @ w
    cuts = np.quantile(strength, np.linspace(0.01, 0.99, 99))
    accuracy = [((strength[good] >= c).mean() + (strength[bad] < c).mean()) / 2 for c in cuts]
    best = np.flatnonzero(np.array(accuracy) >= max(accuracy) - 1e-3)
    cut = float(cuts[best[len(best) // 2]])
    slope = 2.0 / max(1e-6, float(np.std(strength)))
    return w / scale, cut + float(mean @ (w / scale)), slope


def score(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "quality") -> DataFrame:
    """doc_id, held_out, strength and score of every document; only labels of rows that aren't held out are learned from."""
    spark = docs.sparkSession
    own = written(with_stats(docs).withColumn("x", F.array(*features())).select("doc_id", "x"), scratch(spark, "quality"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(~held_out & F.col("y").isin(0, 1)).distinct()
    # A bounded sample of each kind, chosen by a hash of the id.
    some = [known.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED) for k in (0, 1)]
    # At most 2 * MAX_LABELLED rows of fixed size.
    rows = own.join(F.broadcast(some[0].unionByName(some[1])), "doc_id").groupBy("doc_id", "y").agg(F.min("x").alias("x")).orderBy("doc_id", "y").select("x", "y").collect()
    y = np.array([r.y for r in rows])
    base = own.withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    if not ((y == 0).any() and (y == 1).any()):
        return base.select("doc_id", "held_out", F.lit(0.0).alias("strength"), F.lit(0.5).alias("score"))
    w, cut, slope = fit(np.array([r.x for r in rows]), y)
    strength = sum((F.col("x")[i] * float(v) for i, v in enumerate(w[1:], 1)), F.col("x")[0] * float(w[0]))
    offset = float(np.log(CUT_SCORE / (1 - CUT_SCORE)))
    return base.select("doc_id", "held_out", strength.alias("strength")).withColumn("score", 1 / (1 + F.exp(-(slope * (F.col("strength") - cut) + offset))))


def op8(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, labels, crc_of_id(F.col("doc_id")) % 5 == 0)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= CUT_SCORE).cast("int").alias("predicted"))
