"""Quality rules as weak supervision: votes, expectation-maximisation, posterior quality.

Each rule looks at one statistic of a text and votes good (+1), bad (-1) or abstains (0). A two-class model with
one accuracy table per rule and class is fitted by expectation-maximisation to the counts of the vote patterns over
all documents; a document's posterior probability of being good replaces "all rules must pass". Only the pattern
counts reach the driver: at most 3^rules rows, whatever the size of the corpus.

All statistics come from whole texts by SQL array functions within a row: no shuffle, no Python on executors.
A word counts as repeated if a 3-word window that it is part of occurs twice or more in the text; windows are
compared by 64-bit hashes.

Defined cases: a null or empty text has no words and fails; repeated rows each get their row; empty tables give
empty results; columns other than id and text are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import WS, documents, let, stored, words

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(own: Column) -> Column:
    """Number of words of the array ``own`` that are in a 3-word window found twice or more."""

    def covered(at: Column) -> Column:
        # positions of repeated windows in order: each adds the words that the one before hasn't covered
        return F.aggregate(
            at,
            F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("sum")),
            lambda acc, i: F.struct(i.alias("last"), (acc["sum"] + F.least(F.lit(3), i - acc["last"])).cast("long").alias("sum")),
            lambda acc: acc["sum"],
        )

    def among(ordered: Column) -> Column:
        same = lambda i, j: F.get(ordered, i)["h"] == F.get(ordered, j)["h"]
        twice = F.filter(ordered, lambda _, k: F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)))
        return covered(F.array_sort(F.transform(twice, lambda x: x["i"])))

    def windows(w: Column) -> Column:
        last = F.size(w) - 3
        hashed = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

        def counted(h: Column) -> Column:
            some = F.size(F.array_distinct(h)) < F.size(h)
            pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("int").alias("i")))
            return F.when(some, let(F.sort_array(pairs), among)).otherwise(F.lit(0).cast("long"))

        return F.when(last < 0, F.lit(0).cast("long")).otherwise(let(hashed, counted))

    return windows(own)


def text_stats(text: Column) -> Column:
    """Struct of STATS and of what the rules need besides, for one text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{WS}]"))
    long = lambda c: c.cast("long")

    def of(w: Column) -> Column:
        upper = F.size(F.filter(w, lambda x: x.rlike("^[^a-z]*[A-Z]{2}[^a-z]*$")))
        return F.struct(
            long(F.size(w)).alias("n_words"),
            long(F.length(F.regexp_replace(text, f"[{WS}]+", ""))).alias("word_chars"),
            long(F.regexp_count(text, F.lit("[#*$%&|<>]"))).alias("n_symbols"),
            long(let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))).alias("n_dup_lines"),
            repeat_words(w).alias("n_repeat_words"),
            long(F.size(F.array_distinct(w))).alias("n_distinct"),
            long(upper).alias("n_upper"),
            long(F.size(lines)).alias("n_lines"),
            long(F.regexp_count(text, F.lit("[.!?](?=[\\x20\\x09-\\x0D]|\\z)"))).alias("n_stops"),
        )

    return let(words(text), of)


def votes() -> dict[str, Column]:
    """Rule name to its vote; a rule abstains where its statistic says little."""
    n, per = F.col("n_words"), lambda x: F.col(x) / F.greatest(F.col("n_words"), F.lit(1))
    rule = lambda bad, good: F.when(bad, -1).when(good, 1).otherwise(0)
    return {
        "length": rule(n < 50, n >= 80),
        "symbols": rule(per("n_symbols") > 0.3, per("n_symbols") < 0.05),
        "dup_lines": rule((F.col("n_lines") > 3) & (F.col("n_dup_lines") > 0.3 * F.col("n_lines")), F.col("n_dup_lines") <= 0.1 * F.col("n_lines")),
        "repeats": rule(per("n_repeat_words") > 0.4, per("n_repeat_words") < 0.15),
        "capitals": rule(per("n_upper") > 0.4, per("n_upper") < 0.1),
        "word_length": rule((F.col("word_chars") < 2.5 * n) | (F.col("word_chars") > 15 * n), (F.col("word_chars") > 3 * n) & (F.col("word_chars") < 12 * n)),
        "stops": rule((n >= 50) & (per("n_stops") < 0.01), (per("n_stops") > 0.02) & (per("n_stops") < 0.4)),
        "variety": rule((n >= 50) & (n < 5000) & (per("n_distinct") < 0.1), (n < 5000) & (per("n_distinct") > 0.25)),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """EM on vote patterns and their counts: P(good), and for each rule vote -> (P(vote | bad), P(vote | good)).

    Starts from rules that are right three times in four where they vote; a Beta-like prior of a hundredth of the
    documents on that start keeps a class that no rule sees from drifting, and the classes from changing places.
    """
    total = sum(n for _, n in patterns)
    if not total:
        return 0.5, []
    size = len(patterns[0][0])
    start = {-1: (0.6, 0.1), 0: (0.2, 0.2), 1: (0.2, 0.7)}
    good, table, weight = 0.8, [dict(start) for _ in range(size)], max(1.0, 0.01 * total)
    for _ in range(rounds):
        sums = [{v: [weight * p for p in start[v]] for v in start} for _ in range(size)]
        mass = [0.2 * weight, 0.8 * weight]
        for votes_of, n in patterns:
            p = posterior(votes_of, good, table)
            for c, share in ((0, 1 - p), (1, p)):
                mass[c] += n * share
                for r, v in enumerate(votes_of):
                    sums[r][v][c] += n * share
        good = mass[1] / sum(mass)
        table = [{v: tuple(s[v][c] / sum(s[u][c] for u in s) for c in (0, 1)) for v in s} for s in sums]
    return good, table


def posterior(votes_of: tuple[int, ...], good: float, table: list[dict[int, tuple[float, float]]]) -> float:
    odds = math.log(good / (1 - good)) + sum(math.log(table[r][v][1] / table[r][v][0]) for r, v in enumerate(votes_of))
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))


def quality(docs: DataFrame, threshold: float = 0.5, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, STATS, base_failed, kept, p_quality and the votes of each row of ``docs``."""
    stats = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_stats(F.col(f"`{text_col}`")).alias("s")).select("doc_id", "s.*")
    rules = votes()
    stats, _ = stored(stats.select("*", *(v.cast("int").alias(f"vote_{r}") for r, v in rules.items())), "quality")
    names = [f"vote_{r}" for r in rules]
    patterns = [(tuple(r[:-1]), r[-1]) for r in stats.groupBy(*names).agg(F.count("*")).collect()]  # at most 3^rules
    good, table = fit(sorted(patterns))
    odds = F.lit(math.log(good / (1 - good)))
    for name, by_vote in zip(names, table, strict=False):
        weight = {v: math.log(p[1] / p[0]) for v, p in by_vote.items()}
        odds = odds + F.when(F.col(name) == 1, weight[1]).when(F.col(name) == -1, weight[-1]).otherwise(weight[0])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    p = 1 / (1 + F.exp(-odds))
    return stats.select("doc_id", *STATS, failed.alias("base_failed"), (~failed & (p >= threshold)).alias("kept"), p.alias("p_quality"), *names)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir)).select("doc_id", *STATS, "base_failed", "kept")
