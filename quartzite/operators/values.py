"""Value clustering, masking and semantic validation of columns."""

from __future__ import annotations

import re
import secrets
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartzite.functions import text as X
from quartzite.plans.stats import is_text, q

# --- clustering -----------------------------------------------------------------------------------------------------------


def clusters(df: DataFrame, column: str, method: str = "fingerprint", n: int = 2, policy: str = "most_frequent", least: int = 2) -> DataFrame:
    """cluster_key, value, count, canonical: variants of one value, for keys with several variants and ``least`` rows or more.

    Works on distinct values: the rows are counted first, and only the counts are grouped by key.
    """
    counts = df.where(q(column).isNotNull()).groupBy(q(column).alias("value")).agg(F.count(F.lit(1)).alias("count")).withColumn("cluster_key", X.fingerprint(F.col("value")) if method == "fingerprint" else X.ngram_key(F.col("value"), n))
    w = Window.partitionBy("cluster_key")
    order = {
        "most_frequent": [F.desc("count"), F.desc(F.length("value")), F.asc("value")],
        "longest": [F.desc(F.length("value")), F.asc("value")],
        "shortest": [F.asc(F.length("value")), F.asc("value")],
        "first": [F.asc("value")],
    }[policy]
    full = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = counts.where("cluster_key <> ''").withColumns({"_variants": F.count(F.lit(1)).over(w), "_rows": F.sum("count").over(w), "canonical": F.first("value").over(full)})
    return out.where((F.col("_variants") >= 2) & (F.col("_rows") >= least)).select("cluster_key", "value", "count", "canonical")


def merge_clusters(df: DataFrame, columns: list[str], methods: tuple[str, ...] = ("fingerprint", "ngram"), **options) -> DataFrame:
    """Replace variants by their canonical value, one method after the other."""
    out = df
    for c in columns:
        for m in methods:
            mapping = clusters(out, c, m, **options).select(F.col("value").alias("_v"), F.col("canonical").alias("_to")).where("_v <> _to")
            out = out.join(mapping, q(c) == F.col("_v"), "left").select(*(F.coalesce("_to", q(x)).alias(x) if x == c else q(x) for x in df.columns))
    return out


# --- masking ----------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class MaskRule:
    """What to do with the columns that are named or whose names match ``pattern``."""

    strategy: str
    columns: tuple[str, ...] = ()
    pattern: str | None = None
    placeholder: str = "[REDACTED]"
    keep_last: int = 4
    salt: str = ""
    length: int = 64
    regex: str | None = None

    def __post_init__(self) -> None:
        if self.strategy not in ("hash", "redact", "partial", "regex_scrub", "drop", "tokenize", "surrogate"):
            raise ValueError(f"unknown strategy {self.strategy!r}")

    def chosen(self, names: list[str]) -> list[str]:
        return [n for n in names if n in self.columns or (self.pattern and re.search(self.pattern, n, re.I))]


def masked(c: Column, rule: MaskRule) -> Column:
    text = c.cast("string")
    if rule.strategy in ("hash", "tokenize"):
        h = X.hmac_sha256(text, (rule.salt or secrets.token_hex(16)).encode())
        return F.concat(F.lit("tok_"), F.substring(h, 1, 16)) if rule.strategy == "tokenize" else F.substring(h, 1, rule.length)
    if rule.strategy == "redact":
        return F.when(c.isNotNull(), F.lit(rule.placeholder))
    if rule.strategy == "partial":
        return F.when(F.length(text) <= rule.keep_last, F.lit(rule.placeholder)).otherwise(F.concat(F.lit(rule.placeholder), F.right(text, F.lit(rule.keep_last)))) if rule.keep_last else F.when(c.isNotNull(), F.lit(rule.placeholder))
    if rule.strategy == "surrogate":
        return surrogate(text, (rule.salt or secrets.token_hex(16)).encode(), rule.keep_last)
    return F.regexp_replace(text, rule.regex or "[0-9]", rule.placeholder)


def surrogate(c: Column, key: bytes, keep_last: int = 0) -> Column:
    """Letters and digits replaced by others of their kind, chosen by an HMAC of the value; separators and the last characters stay."""
    h = X.hmac_sha256(c, key)

    def one(ch: Column, i: Column) -> Column:
        byte = F.conv(F.substring(h, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int") + i.cast("int")
        pick = lambda alphabet: F.substring(F.lit(alphabet), byte % len(alphabet) + 1, F.lit(1))
        swapped = F.when(ch.rlike("[0-9]"), pick("0123456789")).when(ch.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz")).when(ch.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(ch)
        return F.when(i >= F.length(c) - keep_last, ch).otherwise(swapped)

    return F.array_join(F.transform(F.filter(F.split(c, ""), lambda x: x != ""), one), "")


def mask(df: DataFrame, rules: list[MaskRule]) -> DataFrame:
    """One projection for all rules; a later rule on a column wins."""
    chosen = {c: r for r in rules for c in r.chosen(df.columns)}
    return df.select(*(masked(q(c), chosen[c]).alias(c) if c in chosen else q(c) for c in df.columns if c not in chosen or chosen[c].strategy != "drop"))


def vault(df: DataFrame, column: str, rule: MaskRule) -> DataFrame:
    """token and value: what undoes a tokenisation, kept as a table of its own."""
    return df.where(q(column).isNotNull()).select(masked(q(column), rule).alias("token"), q(column).cast("string").alias("value")).dropDuplicates()


def detokenize(df: DataFrame, column: str, vault_table: DataFrame) -> DataFrame:
    known = vault_table.select(F.col("token").alias("_t"), F.col("value").alias("_v"))
    return df.join(known, q(column) == F.col("_t"), "left").select(*(F.coalesce("_v", q(c)).alias(c) if c == column else q(c) for c in df.columns))


# --- semantic validation ------------------------------------------------------------------------------------------------


def in_reference(c: Column, values: list[str], casefold: bool = True) -> Column:
    """NULL is valid."""
    return F.coalesce(F.lower(c).isin([v.lower() for v in values]) if casefold else c.isin(values), F.lit(True))


def matches(c: Column, pattern: str) -> Column:
    """The whole value matches; NULL is valid."""
    return F.coalesce(c.rlike(f"^(?:{pattern})\\z"), F.lit(True))


def validate(df: DataFrame, checks: dict[str, object]) -> DataFrame:
    """column, n_values, n_invalid, invalid_ratio, samples for each checked column; ``checks`` maps a column to a Column -> Column rule.

    The predicate runs on distinct values only; a Python function given as a rule should be a pandas_udf.
    """
    out = None
    for c, rule in checks.items():
        counts = df.where(q(c).isNotNull()).groupBy(q(c).alias("v")).agg(F.count(F.lit(1)).alias("n")).withColumn("ok", rule(F.col("v")))
        bad = ~F.col("ok")
        row = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_values"), F.coalesce(F.sum(F.when(bad, F.col("n"))), F.lit(0)).alias("n_invalid"), F.array_join(F.slice(F.array_sort(F.collect_list(F.when(bad, F.col("v").cast("string")))), 1, 5), ", ").alias("samples"))
        row = row.select(F.lit(c).alias("column"), "n_values", "n_invalid", F.when(F.col("n_values") > 0, F.col("n_invalid") / F.col("n_values")).otherwise(0.0).alias("invalid_ratio"), "samples")
        out = row if out is None else out.unionByName(row)
    return out


def k_anonymity(df: DataFrame, quasi: list[str], k: int = 5) -> dict:
    """Smallest group, groups and rows below k; NULL is a value of its own. An empty frame is fine."""
    groups = df.groupBy(*(q(c) for c in quasi)).agg(F.count(F.lit(1)).alias("n"))
    r = groups.agg(F.min("n").alias("least"), F.count_if(F.col("n") < k).alias("groups"), F.coalesce(F.sum(F.when(F.col("n") < k, F.col("n"))), F.lit(0)).alias("rows")).first()
    return {"k": k, "smallest": r.least, "risky_groups": r.groups, "risky_rows": r.rows, "ok": r.least is None or r.least >= k}


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_text(f.dataType)]
