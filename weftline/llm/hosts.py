"""Quality rules for documents and for the hosts they come from, in Spark columns only.

A host's rate of failing documents is shrunk towards the corpus with an empirical beta prior, so that a
host with few documents is judged mostly by the others.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.frames import keyed
from weftline.session import cut_lineage

BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
HOST_LIMIT = 0.75
#: Below that a host is refused if most of its documents fail and its rate is so many prior deviations above the corpus.
LEAST_LIMIT = 0.5
SPREADS = 3
#: Bounds of the between-host correlation; its inverse is the prior's weight in documents.
LEAST_SPREAD, MOST_SPREAD = 1e-6, 1 - 1e-6


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once for each row, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    """Runs of other characters than blanks; none for null."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(bare) > 0, F.split(bare, BLANK_RUN)).otherwise(F.array().cast("array<string>"))


def repeated_words(words: Column) -> Column:
    """Words within three-word windows that a text holds twice or more.

    Windows are compared by hash first, since most short texts repeat none; texts with equal hashes
    are compared by the words themselves.
    """
    none = F.lit(0).cast("long")

    def windows(w: Column, of: Callable[[Column, Column, Column], Column]) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - 3)
        return F.transform(at, lambda i: of(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(w: Column) -> Column:
        placed = F.sort_array(
            F.transform(windows(w, lambda a, b, c: F.concat_ws(" ", a, b, c)), lambda t, i: F.struct(t.alias("t"), i.alias("i")))
        )
        return let(placed, lambda s: F.size(F.array_distinct(F.flatten(F.transform(
            F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["t"] == x["t"], F.lit(False))
                     | F.coalesce(F.get(s, k + 1)["t"] == x["t"], F.lit(False))),
            lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2),
        )))).cast("long"))

    def checked(w: Column) -> Column:
        twice = let(windows(w, F.xxhash64), lambda h: F.size(F.array_distinct(h)) < F.size(h))
        return F.when(F.size(w) < 4, none).when(twice, covered(w)).otherwise(none)

    return let(words, checked)


def measures(text: Column) -> dict[str, Column]:
    """What the rules look at, each a long; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    return {
        "n_words": let(words_of(text), F.size).cast("long"),
        "word_chars": F.length(F.translate(text, BLANKS, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(words_of(text)),
    }


def rule_failure(n_words: Column, n_repeat_words: Column) -> Column:
    """A document fails if it is short or if more than half of its words repeat."""
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEATED_PERCENT * n_words)


def beta_prior(docs: float, failures: float, hosts: int, squares: float, sizes: float) -> tuple[float, float]:
    """Mean and weight (in documents) of the beta prior behind hosts' failure rates, by moments.

    ``squares`` is the sum of failures² / docs over the hosts, ``sizes`` that of docs². The weight is the
    inverse of the between-host correlation, which is kept within its bounds; without variation among the
    documents, or with one host, the correlation takes the lower bound.
    """
    mean = failures / docs
    noise = mean * (1 - mean)
    room = noise * (docs - sizes / docs - (hosts - 1))
    found = (squares - docs * mean * mean - noise * (hosts - 1)) / room if room > 0 else LEAST_SPREAD
    return mean, 1 / min(max(found, LEAST_SPREAD), MOST_SPREAD) - 1


def host_verdicts(judged: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """(host, docs, failures, host_rate, host_ok) from rows (host, base_failed), one for each host, null too.

    The prior's mean is the corpus' rate, its weight comes from the moments of the hosts' rates around
    it. A host is refused above ``limit`` and half the way from the corpus' rate to one, so that a
    poor corpus does not refuse its ordinary hosts; or above ``LEAST_LIMIT`` if the rate is also ``SPREADS``
    standard deviations of the prior above the corpus' rate. A hot host is summed before the shuffle. Gathered at
    the driver: one row of five sums.
    """
    hosts = cut_lineage(judged.groupBy("host").agg(
        F.count("*").alias("docs"), F.sum(F.col("base_failed").cast("long")).alias("failures")
    ))
    docs, failures = F.col("docs").cast("double"), F.col("failures").cast("double")
    sums = hosts.agg(
        F.sum(docs), F.sum(failures), F.count("*"), F.sum(failures * failures / docs), F.sum(docs * docs)
    ).first()
    mean, weight = beta_prior(*sums) if sums[2] else (0.0, 0.0)
    rate = (failures + mean * weight) / (docs + weight)
    apart = max(LEAST_LIMIT, mean + SPREADS * math.sqrt(mean * (1 - mean) / (weight + 1)))
    most = min(max(limit, (1 + mean) / 2), apart)
    return hosts.withColumn("host_rate", rate).withColumn("host_ok", F.col("host_rate") <= most)


def kept(docs: DataFrame, text: str = "text", host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of ``docs`` that pass the rules and whose host does, with their columns as they are.

    Rows with null keys or repeated rows are judged each; null and empty texts go; rows without a host
    are a host of their own. Texts are measured once, and move once, to the row keys that stay: an even
    shuffle, whatever the hosts.
    """
    rows, keys = keyed(docs)
    failed = let(
        words_of(F.coalesce(F.col(text), F.lit(""))),
        lambda w: rule_failure(F.size(w), F.when(F.size(w) < LEAST_WORDS, F.lit(0).cast("long")).otherwise(repeated_words(w))),
    )
    one, two = keys
    judged = cut_lineage(rows.select(
        F.col(one).alias("one"), F.col(two).alias("two"), F.col(host).alias("host"), failed.alias("base_failed")
    ))
    bad = cut_lineage(host_verdicts(judged, limit).where(~F.col("host_ok")).select(F.col("host").alias("named")))
    good = judged.where(~F.col("base_failed")).join(bad, F.col("host").eqNullSafe(F.col("named")), "left_anti")
    return rows.join(good.select(F.col("one").alias(one), F.col("two").alias(two)), list(keys), "left_semi").select(*docs.columns)


def judge(
    docs: DataFrame, text: str = "text", host: str = "source", keys: tuple[str, ...] = ("doc_id",),
    limit: float = HOST_LIMIT,
) -> DataFrame:
    """``keys``, the measures, base_failed, host_rate and kept for each row of ``docs``.

    Rows without a host share the verdict of the null host. Texts are read once: measures are written
    first, then counted by host and joined with the verdicts. Null and empty texts fail (no words).
    Repeated rows are judged and counted each; an empty table gives no row; other columns are ignored.
    """
    measured = docs.select(*keys, F.col(host).alias("host"), *(c.alias(n) for n, c in measures(F.col(text)).items()))
    judged = cut_lineage(measured.withColumn("base_failed", rule_failure(F.col("n_words"), F.col("n_repeat_words"))))
    # Written first, so that both join sides are bare shuffles and a hot host's rows can be split.
    verdicts = cut_lineage(host_verdicts(judged, limit).select(F.col("host").alias("named"), "host_rate", "host_ok"))
    return (
        judged.join(verdicts, judged["host"].eqNullSafe(verdicts["named"]), "left")
        .withColumn("kept", ~F.col("base_failed") & F.col("host_ok"))
        .drop("host", "named", "host_ok")
    )
