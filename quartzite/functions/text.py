"""Column builders and name rules for text; nothing here runs a job."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as str.strip has it. Java's \s is ASCII only and trim() knows the space alone.
SPACE = "[\\u0009-\\u000D\\u001C-\\u0020\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"
#: Its characters.
SPACES = [chr(x) for x in range(0x3001) if re.fullmatch(SPACE, chr(x))]

# Cell values that mean "missing", compared trimmed and lower-cased.
SENTINELS = (
    "", "-", "--", "---", "?", "??",
    "na", "n/a", "n\\a", "\\n", "n.a", "n.a.", "nan", "null", "none", "nil", "missing",
    "(null)", "(none)", "(blank)", "(empty)", "(missing)",
    "#n/a", "#n/a n/a", "#na", "#null!", "#div/0!", "#ref!", "#value!", "#name?", "#num!",
)


def snake_case(name: object) -> str:
    """``CustomerID (new)`` -> ``customer_id_new``; letters of any script stay."""
    text = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", str(name).strip())
    return re.sub(r"_+", "_", re.sub(r"\W+", "_", text)).strip("_").lower()


def clean_names(names: Iterable[object]) -> list[str]:
    """Snake-cased names, nameless ones as ``column_<i>``, repeats with ``_2``, ``_3``; unequal without regard to case."""
    wanted = [snake_case(n) or f"column_{i}" for i, n in enumerate(names)]
    taken, out = {w.casefold() for w in wanted}, []
    used: set[str] = set()
    for w in wanted:
        name, k = w, 2
        while name.casefold() in used or (name != w and name.casefold() in taken):
            name, k = f"{w}_{k}", k + 1
        used.add(name.casefold())
        out.append(name)
    return out


def strip(c: Column) -> Column:
    """The pattern is run only on texts that have white space at an end."""
    edge = F.substring(c, 1, 1).isin(*SPACES) | F.substring(c, -1, 1).isin(*SPACES)
    return F.when(edge, F.regexp_replace(c, f"^{SPACE}+|{SPACE}+\\z", "")).otherwise(c)


def is_sentinel(c: Column, extra: Iterable[str] = ()) -> Column:
    """Whether a trimmed text means "missing"."""
    return F.lower(c).isin(*SENTINELS, *(x.strip().casefold() for x in extra))


def repaired(c: Column, trim: bool = True, sentinels: bool = True, extra: Iterable[str] = ()) -> Column:
    out = strip(c) if trim else c
    return F.when(is_sentinel(strip(c), extra), None).otherwise(out) if sentinels else out


def fingerprint(c: Column) -> Column:
    """Trimmed, lower-cased, without punctuation, its distinct words in order."""
    plain = F.regexp_replace(F.lower(strip(c)), "[^\\p{L}\\p{N}_\\s]", "")
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(plain, "\\s+"), lambda w: w != ""))), " ")


def ngram_key(c: Column, n: int = 2) -> Column:
    """Distinct character n-grams of the letters and digits in order, joined."""
    plain = F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}]", "")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(plain) - (n - 1), F.lit(1))), lambda i: F.substring(plain, i, F.lit(n)))
    return F.array_join(F.array_sort(F.array_distinct(grams)), "")


def soundex(c: Column) -> Column:
    letters = F.regexp_replace(c, "[^A-Za-z]", "")
    return F.when(c.isNull(), None).when(letters == "", "0000").otherwise(F.soundex(letters))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def _jaro_winkler(s: str, t: str) -> float:
    """Jaro-Winkler with prefix 4 and weight 0.1; the prefix counts whatever the similarity."""
    if s == t:
        return 1.0
    if not s or not t:
        return 0.0
    reach = max(max(len(s), len(t)) // 2 - 1, 0)
    free = [True] * len(t)
    mine: list[str] = []
    for i, c in enumerate(s):
        for j in range(max(0, i - reach), min(len(t), i + reach + 1)):
            if free[j] and t[j] == c:
                free[j] = False
                mine.append(c)
                break
    if not mine:
        return 0.0
    theirs = [c for c, unused in zip(t, free, strict=True) if not unused]
    m = len(mine)
    swaps = sum(a != b for a, b in zip(mine, theirs, strict=True)) // 2
    jaro = (m / len(s) + m / len(t) + (m - swaps) / m) / 3
    prefix = 0
    for a, b in zip(s[:4], t[:4], strict=False):
        if a != b:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def jaro_winkler(a: Column, b: Column) -> Column:
    """No built-in has it: an Arrow-batched function; callers apply it to distinct pairs."""

    @F.pandas_udf("double")
    def similarity(x, y):
        import pandas as pd

        return pd.Series([None if p is None or q is None else _jaro_winkler(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return similarity(a, b)


def hmac_sha256(c: Column, key: bytes) -> Column:
    """Hex HMAC-SHA256 of a text with built-ins: the pads, never the key, are in the plan."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.lit(bytearray(k ^ x for k in key))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(c, "UTF-8")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def luhn(c: Column, least: int = 13) -> Column:
    digits = F.regexp_replace(c, "[^0-9]", "")
    return (F.length(digits) >= least) & F.call_function("luhn_check", digits)


def mod10(c: Column, lengths: tuple[int, ...]) -> Column:
    """Check digit of GTIN and GLN codes: weights 3 and 1 from the right."""
    digits = F.split(F.reverse(c), "")
    total = F.aggregate(F.transform(F.filter(digits, lambda d: d != ""), lambda d, i: F.expr("0") + d.cast("int") * F.when(i % 2 == 1, 3).otherwise(1)), F.lit(0), lambda s, v: s + v)
    return F.when(c.rlike(f"^(?:{'|'.join(f'[0-9]{{{n}}}' for n in lengths)})\\z"), total % 10 == 0).otherwise(False)
