"""Quality rules of documents and of their hosts (DataFrame functions only).

Each document is judged by fixed rules over its words and lines. The failures are counted by host, the rates of small hosts
are shrunk towards the rate of all hosts with a beta prior fitted to the hosts themselves, and the verdict on a host is
joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landlens.llm.common import WORD, words_of
from landlens.session import cut_lineage

WINDOW = 8
#: Fewest words; largest share of words in repeated windows, in percent.
MIN_WORDS = 20
MAX_REPEAT = 30
#: Rules whose failures are counted by host, with the shrunk failure rate above which the host is rejected.
HOST_RULES = {"short": 0.5, "repeats": 0.5, "symbols": 0.5, "dup_lines": 0.5}
#: Prior weight (documents) when the hosts do not differ by more than chance.
MAX_PRIOR = 10_000.0


def repeated_words(words: Column, n_words: Column) -> tuple[Column, Column]:
    """(hashes of all windows, function of them): words that lie in a window which the same text holds twice or more.

    Windows are told apart by 64-bit hashes within one text. Texts without a repeated window, most of them, stop after
    one pass through a hash set; only the others order (hash, position) pairs.
    """
    hashes = F.when(
        n_words >= WINDOW,
        F.transform(F.sequence(F.lit(1), (n_words - (WINDOW - 1)).cast("int")), lambda i: F.xxhash64(F.slice(words, i, WINDOW))),
    ).otherwise(F.array().cast("array<bigint>"))
    pairs = F.array_sort(F.transform(F.col("_hashes"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    both = F.col("_pairs")
    same = lambda a, b: F.coalesce(F.get(both, a)["h"] == F.get(both, b)["h"], F.lit(False))
    hit = F.filter(
        F.transform(both, lambda p, k: F.when(same(k, k - 1) | same(k, k + 1), p["i"])), lambda i: i.isNotNull()
    )
    at = F.col("_at")
    covered = F.transform(at, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - i, F.lit(WINDOW))))
    total = F.aggregate(covered, F.lit(0), lambda a, b: a + b)
    return hashes, (pairs, F.array_sort(hit), total)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, host and the counts the rules use; one row per input row, null text as the empty text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(F.col("_text"), "\n", -1), lambda x: x.rlike(WORD))
    rows = (
        docs.select("doc_id", F.col("source").alias("host"), text.alias("_text"))
        .withColumn("_words", words_of(F.col("_text")))
        .withColumn("n_words", F.size("_words").cast("long"))
    )
    hashes, (pairs, at, total) = repeated_words(F.col("_words"), F.col("n_words"))
    rows = (
        rows.withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(F.col("_text"), F.lit(r"[#*$%&|<>]")).cast("long"))
        .withColumn("_lines", lines)
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("_hashes", hashes)
        .drop("_text", "_words", "_lines")
        .withColumn("_hashes", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.col("_hashes")))
        .withColumn("_pairs", F.when(F.col("_hashes").isNotNull(), pairs))
        .withColumn("_at", F.when(F.col("_pairs").isNotNull(), at))
        .withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("long"))
    )
    return rows.drop("_hashes", "_pairs", "_at")


def rule_failures() -> dict[str, Column]:
    return {
        "short": F.col("n_words") < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"),
        "symbols": 2 * F.col("n_symbols") > F.col("n_words"),
        "dup_lines": 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"),
    }


def host_verdicts(judged: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """host, n_docs, host_failed and the shrunk failure rate of each rule; a null host is a host of its own.

    ``judged``: host and one boolean column ``fails_<rule>`` per rule. The prior of a rule is the beta distribution with
    the mean and the between-host variance (beyond binomial noise) of the observed rates.
    """
    limits = HOST_RULES if limits is None else limits
    counts = cut_lineage(
        judged.groupBy("host").agg(
            F.count(F.lit(1)).alias("n_docs"), *[F.sum(F.col(f"fails_{r}").cast("long")).alias(r) for r in limits]
        )
    )
    long = counts.select(
        "host", "n_docs", F.explode(F.create_map(*[x for r in limits for x in (F.lit(r), F.col(r))])).alias("rule", "failed")
    )
    rate = F.col("failed") / F.col("n_docs")
    moments = long.groupBy("rule").agg(
        (F.sum("failed") / F.sum("n_docs")).alias("mean"),
        F.count(F.lit(1)).alias("hosts"),
        F.sum(F.col("n_docs") * rate * rate).alias("squares"),
        F.sum("n_docs").alias("docs"),
        F.sum(F.col("n_docs") * F.col("n_docs")).alias("docs2"),
    )
    m = F.col("mean")
    spread = m * (1 - m)
    # E[sum n (rate - mean)^2] = (hosts - 1) (spread - v) + v (docs - docs2 / docs)
    between = (F.col("squares") - F.col("docs") * m * m - (F.col("hosts") - 1) * spread) / F.greatest(
        F.col("docs") - F.col("docs2") / F.col("docs") - (F.col("hosts") - 1), F.lit(1.0)
    )
    weight = F.when(between > 0, F.least(F.greatest(spread / between - 1, F.lit(1.0)), F.lit(MAX_PRIOR))).otherwise(MAX_PRIOR)
    prior = cut_lineage(moments.select("rule", (m * weight).alias("alpha"), ((1 - m) * weight).alias("beta")))
    shrunk = (F.col("failed") + F.col("alpha")) / (F.col("n_docs") + F.col("alpha") + F.col("beta"))
    limit = F.create_map(*[x for r, v in limits.items() for x in (F.lit(r), F.lit(float(v)))])
    return (
        long.join(prior, "rule")
        .withColumn("rate", shrunk)
        .groupBy("host")
        .agg(
            F.first("n_docs").alias("n_docs"),
            F.bool_or(F.col("rate") > F.element_at(limit, F.col("rule"))).alias("host_failed"),
            *[F.max(F.when(F.col("rule") == r, F.col("rate"))).alias(f"rate_{r}") for r in limits],
        )
    )


def quality_rules(docs: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """Features and verdicts of each document; one row per input row.

    Columns used: doc_id, text, source (the host); others are ignored. Null text counts as the empty text and fails,
    repeated rows are judged one by one, a null host is a host like any other, empty input gives no rows.
    Returns doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_failed, kept.
    """
    limits = HOST_RULES if limits is None else limits
    rules = rule_failures()
    judged = cut_lineage(features(docs)).withColumns({f"fails_{r}": c for r, c in rules.items()})
    verdicts = cut_lineage(host_verdicts(judged, limits).select(F.col("host").alias("_host"), "host_failed"))
    base = F.col("fails_short") | F.col("fails_repeats")
    return (
        judged.withColumn("base_failed", base)
        .join(verdicts, F.col("host").eqNullSafe(F.col("_host")), "left")
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))
        .select(
            "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
            "host_failed", "kept",
        )
    )


QUERY_COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
