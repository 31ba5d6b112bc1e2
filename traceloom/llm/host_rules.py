"""Quality rules with host verdicts.

Each document is measured and held against rules; failures are counted by host, a host's failure rate is shrunk towards
the mean by a beta prior fitted to all hosts (method of moments), and the verdict is joined back. A document that fails
the base rule goes. Of the others a document goes if it fails two rules, or one rule on a host of bad verdict; a document
that fails no rule always stays. Counts by host are summed before any shuffle, so a host with a third of all rows is no
burden. Null texts have no words and fail the base rule; a null host is a host of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import scratch, written
from .textstats import with_stats

MIN_WORDS, MAX_REPEAT, MAX_SYMBOLS, MAX_DUP_LINES, MIN_CHARS, MAX_CHARS, HOST_LIMIT = 50, 50, 10, 30, 2, 15, 0.3


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def failures() -> Column:
    """How many rules a document fails."""
    rules = [
        base_failed(),
        100 * F.col("n_symbols") > MAX_SYMBOLS * F.col("n_words"),
        100 * F.col("n_dup_lines") > MAX_DUP_LINES * F.col("n_lines"),
        (F.col("word_chars") < MIN_CHARS * F.col("n_words")) | (F.col("word_chars") > MAX_CHARS * F.col("n_words")),
    ]
    return sum((r.cast("int") for r in rules[1:]), rules[0].cast("int"))


def host_verdicts(measured: DataFrame, host: str) -> DataFrame:
    """host, n, failed, rate (shrunk) and bad for each host of rows with n_failed."""
    hosts = measured.groupBy(host).agg(F.count("*").alias("n"), F.sum((F.col("n_failed") > 0).cast("long")).alias("failed"))
    raw = hosts.agg((F.sum("failed") / F.sum("n")).alias("m"), F.var_pop(F.col("failed") / F.col("n")).alias("v"), F.avg(1 / F.col("n")).alias("w"))
    # Rates of small hosts vary by chance alone: that part of the variance says nothing about how hosts differ.
    moments = raw.select("m", (F.col("v") - F.col("m") * (1 - F.col("m")) * F.col("w")).alias("v"))
    # Strength of the prior from mean and variance of the hosts' rates, kept within 2 and 1000 observations.
    s = F.when((F.col("v") > 0) & (F.col("m") > 0) & (F.col("m") < 1), F.least(F.lit(1000.0), F.greatest(F.lit(2.0), F.col("m") * (1 - F.col("m")) / F.col("v") - 1))).otherwise(F.lit(1000.0))
    prior = moments.select((F.col("m") * s).alias("alpha"), s.alias("strength"))
    # The prior is one row.
    rated = hosts.join(F.broadcast(prior))
    rate = (F.col("failed") + F.col("alpha")) / (F.col("n") + F.col("strength"))
    return rated.select(F.col(host), "n", "failed", rate.alias("rate"), (rate > HOST_LIMIT).alias("bad"))


def measured(docs: DataFrame, host: str, *more: str) -> DataFrame:
    """doc_id, host_, the columns named in more, counts, base_failed and n_failed of every row; written, so measured once."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(host).cast("string").alias("host_"), *[F.col(c).alias(f"of_{i}") for i, c in enumerate(more)])
    own = with_stats(given, "host_", *[f"of_{i}" for i in range(len(more))]).withColumns({"base_failed": base_failed(), "n_failed": failures()})
    return written(own, scratch(docs.sparkSession, "rules"))


def judged(rows: DataFrame) -> DataFrame:
    """rows with host_bad and kept."""
    verdicts = host_verdicts(rows, "host_").select(F.col("host_").alias("of_host"), F.col("bad").alias("host_bad"))
    out = rows.join(verdicts, F.col("host_").eqNullSafe(F.col("of_host"))).drop("of_host")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_failed") < F.when(F.col("host_bad"), 1).otherwise(2)))


def apply_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, counts, base_failed, n_failed, host_bad and kept of every document."""
    return judged(measured(docs, host)).withColumnRenamed("host_", "host")


def without_failed(docs: DataFrame, host: str = "source") -> DataFrame:
    """Rows of docs, unchanged, that the rules keep. Rows travel with their counts, so no text is shuffled and equal ids don't matter."""
    rows = judged(measured(docs, host, *docs.columns)).where("kept")
    return rows.select(*[F.col(f"of_{i}").alias(c) for i, c in enumerate(docs.columns)])


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
t AS (SELECT doc_id, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM t) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id),
m AS (SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, list_sum(list_transform(ws, lambda x: length(x)))::BIGINT AS chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines,
        coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
f AS (SELECT *, coalesce(chars, 0) AS word_chars, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
g AS (SELECT *, base_failed::INT + (100 * n_symbols > 10 * n_words)::INT + (100 * n_dup_lines > 30 * n_lines)::INT + (word_chars < 2 * n_words OR word_chars > 15 * n_words)::INT AS n_failed FROM f),
h AS (SELECT source AS host, count(*) AS n, sum((n_failed > 0)::BIGINT) AS failed FROM g GROUP BY source),
o AS (SELECT sum(failed) / sum(n) AS m, var_pop(failed / n) AS v, avg(1 / n) AS w FROM h),
p AS (SELECT m, v - m * (1 - m) * w AS v FROM o),
q AS (SELECT m, CASE WHEN v > 0 AND m > 0 AND m < 1 THEN least(1000.0, greatest(2.0, m * (1 - m) / v - 1)) ELSE 1000.0 END AS s FROM p),
b AS (SELECT host, (failed + m * s) / (n + s) > 0.3 AS bad FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_failed < CASE WHEN bad THEN 1 ELSE 2 END AS kept
FROM g JOIN b ON g.source IS NOT DISTINCT FROM b.host
"""
