"""Mixing to target weights with soft domain membership.

1. A naive Bayes classifier over hashed words, fitted by counting on the labelled table (rows of known domain, a bounded sample
   ``bound``), gives each document posterior probabilities of the domains, on its whole text.
2. Nonnegative document rates are fitted so that the expected domain token totals, A rate = sum over documents of rate * tokens *
   posterior, match the target shares: least squares with residuals weighted by M^-1, M = sum of tokens * posterior posterior', by projected
   gradients. Lengths are measured in the metric of the tokens, which is diagonal, so that projecting is cutting off at ``least``; there the
   gradient's Lipschitz constant is 1, as A' M^-1 A is then a projection, and the step of length 1 is rate <- max(least, rate - posterior . M^-1
   residual). An iteration is one aggregate over the (small) table of posteriors; its residuals, one number a domain, are all that
   reaches the driver.
3. A document is drawn floor(rate) times and once more with the fraction's probability, decided by a hash of its id and text.

With ``total`` unset the mixture is the smallest in which no document's rate falls under ``least`` = 1: every document stays and
those of domains in demand are repeated. Main path: DataFrame and SQL functions only.

Defined cases: a null or empty text has no tokens, gets the domains' shares as posterior and rate ``least``, whatever the targets; unknown domains are
ignored in training; without labelled rows the posteriors are the targets; empty tables give empty results; repeated rows
each get their row and the same draw; other columns pass through ``mixed``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import documents, let, stored, words

TARGETS = {"en": 0.5, "fr": 0.18, "de": 0.18, "es": 0.14}
BUCKETS, BOUND, ROUNDS = 2048, 5000, 20


def bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def classifier(labelled: DataFrame, domains: list[str], buckets: int, bound: int) -> tuple[list[float], list[list[float]]]:
    """Log prior by domain, and log P(bucket | domain) by domain and bucket; rows are (id, text, domain)."""
    # ids first: only a bounded list of them meets in one task, and is broadcast; no texts do
    chosen = labelled.where(F.col("domain").isin(domains) & F.col("id").isNotNull()).select("id").orderBy(F.xxhash64("id"), "id").limit(bound)
    sample, _ = stored(labelled.where(F.col("domain").isin(domains)).join(F.broadcast(chosen.distinct()), "id").select("domain", "text"), "mix-sample")
    by_domain = {r.domain: r.n for r in sample.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    seen = sample.select("domain", F.explode(F.array_distinct(words(F.lower("text")))).alias("word")).groupBy("domain", bucket(F.col("word"), buckets).alias("b")).agg(F.count("*").alias("n")).collect()  # domains x buckets
    count = {d: [0.5] * buckets for d in domains}
    for r in seen:
        count[r.domain][r.b] += r.n
    n = sum(by_domain.values())
    prior = [math.log((by_domain.get(d, 0) + 1) / (n + len(domains))) for d in domains]
    table = []
    for d in domains:
        total = sum(count[d])
        table.append([math.log(x / total) for x in count[d]])
    return prior, table


def posteriors(text: Column, domains: list[str], prior: list[float], table: list[list[float]], buckets: int, spread: float = 0.2) -> Column:
    """Array of the domains' probabilities for one text; ``spread`` flattens the odds, as words come in clumps."""
    k = len(domains)
    # relative to the bucket's mean, one constant array a domain
    mean = [sum(t[b] for t in table) / k for b in range(buckets)]
    weights = [F.expr("array(" + ",".join(f"{spread * (t[b] - mean[b]):.4f}D" for b in range(buckets)) + ")") for t in table]

    def odds(own: Column) -> Column:
        return F.array(*(summed(own, p, w) for p, w in zip(prior, weights, strict=True)))

    def summed(own: Column, first: float, weight: Column) -> Column:
        return F.aggregate(own, F.lit(float(first)), lambda acc, b: acc + F.get(weight, b))

    def soft(found: Column) -> Column:
        e = F.transform(found, lambda o: F.exp(o - F.array_max(found)))
        return let(e, lambda v: F.transform(v, lambda x: x / F.aggregate(v, F.lit(0.0), lambda acc, y: acc + y)))

    own = F.transform(F.array_distinct(words(F.lower(F.coalesce(text, F.lit(""))))), lambda w: bucket(w, buckets))
    return let(let(own, odds), soft)


def solve(m: list[list[float]], v: list[float]) -> list[float]:
    """m x = v for a small matrix, with a small ridge."""
    import numpy as np

    a = np.array(m)
    return [float(x) for x in np.linalg.solve(a + 1e-9 * max(np.trace(a), 1e-12) * np.eye(len(a)), np.array(v))]


def rates(shares: DataFrame, targets: list[float], total: float | None, least: float, rounds: int) -> tuple[DataFrame, list[float]]:
    """``shares`` (tokens, p: array by domain, ...) with ``rate``; and the target token totals.

    Rows without tokens have no gradient and keep ``least``.
    """
    k = len(targets)
    p = [F.get("p", F.lit(d)) for d in range(k)]
    first = shares.agg(*(F.sum(F.col("tokens") * p[d]).alias(f"n{d}") for d in range(k)), *(F.sum(F.col("tokens") * p[d] * p[e]).alias(f"m{d}_{e}") for d in range(k) for e in range(k))).first()
    natural = [first[d] or 0.0 for d in range(k)]
    if total is None:
        total = max((least * n / t for n, t in zip(natural, targets, strict=True) if t > 0), default=0.0)
    goal = [total * t for t in targets]
    out = shares.withColumn("rate", F.lit(float(least)))
    if not sum(natural):
        return out, goal
    m = [[first[k + d * k + e] or 0.0 for e in range(k)] for d in range(k)]
    have = [least * n for n in natural]
    for i in range(rounds):
        gap = [h - g for h, g in zip(have, goal, strict=True)]
        if max(map(abs, gap)) <= 1e-4 * total:
            break
        step = solve(m, gap)
        moved = F.greatest(F.lit(float(least)), F.col("rate") - sum((p[d] * step[d] for d in range(1, k)), p[0] * step[0]))
        out = out.withColumn("rate", F.when(F.col("tokens") > 0, moved).otherwise(F.col("rate")))
        if i % 5 == 4:
            out, _ = stored(out, "rates")
        row = out.agg(*(F.sum(F.col("rate") * F.col("tokens") * p[d]) for d in range(k))).first()
        have = list(row)
    return out, goal


def mixture(docs: DataFrame, targets: dict[str, float] | None = None, domain_col: str = "lang", total: float | None = None, least: float = 1.0, rounds: int = ROUNDS, buckets: int = BUCKETS, bound: int = BOUND, text_col: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, list[str]]:
    """id, th (hash of the text), tokens, p, rate and copies of each row of ``docs``; and the domains in order of p."""
    targets = targets or TARGETS
    domains = sorted(targets)
    whole = sum(targets.values())
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    labelled = docs.select(ident.alias("id"), text.alias("text"), F.col(f"`{domain_col}`").alias("domain"))
    prior, table = classifier(labelled, domains, buckets, bound)
    shares = docs.select(ident.alias("id"), F.xxhash64(text).alias("th"), F.size(words(text)).cast("double").alias("tokens"), posteriors(text, domains, prior, table, buckets).alias("p"))
    shares, _ = stored(shares, "shares")
    out, _ = rates(shares, [targets[d] / whole for d in domains], total, least, rounds)
    chance = F.pmod(F.xxhash64(F.lit(11), "id", "th"), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")
    return out.withColumn("copies", copies.cast("int")), domains


def mixed(docs: DataFrame, targets: dict[str, float] | None = None, **options) -> DataFrame:
    """``docs`` with each row as often as it is drawn."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    drawn, _ = mixture(docs, targets, **options)
    # rows of one id and text have the same draw
    drawn = drawn.groupBy("id", "th").agg(F.first("copies").alias("copies")).withColumnsRenamed({"id": "m_id", "th": "m_th"}).hint("shuffle_hash")
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("th"))
    joined = rows.join(drawn, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("th") == F.col("m_th")), "left")
    return joined.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("n")).select("row.*")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, domains = mixture(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), F.col("tokens").cast("long").alias("n_tokens"), *(F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(domains)), "rate", "copies")
