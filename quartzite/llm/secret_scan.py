"""Secret scans: three base patterns, and multipart credentials by interval joins.

Positions without Python: ``split`` by a pattern gives the pieces between its matches, ``regexp_extract_all``
the matches; running sums of their lengths, in steps, are the matches' code point positions. Patterns and sums take time in
proportion to the text, however long its runs and however many its matches.

Weak candidates (an access identifier, a random-looking secret, an endpoint) are common and harmless alone.
They are reported only where complementary parts co-occur within ``scope`` characters of one text: a
secret with an identifier or an endpoint nearby. A part is filed under each block of ``scope`` characters that it reaches, and the
parts are reduced to the first start and last end of each role in each block. A candidate meets its own blocks, the one before and
the one after them: the interval join makes at most 3 rows of a candidate for each of these, however many parts a text has. Parts
of one block are less than ``scope`` apart, so that the first start and last end decide as all of them would.

Defined cases: a null text is empty; repeated rows each get their row; rows without doc_id are scanned too; empty
tables give empty results; columns other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import documents, let, stored

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Maximal runs: with the least length in the pattern, the same matches are left as with a filter after matching.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Weak parts: identifiers and secrets have letters and digits mixed, endpoints are addresses with a host.
IDENTIFIER = r"\b[A-Z][A-Z0-9]{15,31}\b"
SECRET = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/_=-])"
#: A run of host characters is taken whole, once, from its first character, and then has to end in a known suffix: no search goes back
#: over a run, however long. Dots and hyphens after the suffix are cut off.
ENDPOINT = r"\bhttps?://[A-Za-z0-9.-]++(?::[0-9]++)?|(?<![A-Za-z0-9._-])[A-Za-z0-9][A-Za-z0-9.-]*+(?<=\.(?:internal|amazonaws\.com|cloud|api)[.-]{0,3})"
#: What any endpoint holds: found faster than endpoints are.
HOST_HINT = r"https?://|\.(?:internal|amazonaws\.com|cloud|api)"
#: Matches whose positions are summed at a time.
STEP = 256
SCOPE = 400


def spans(text: Column, pattern: str, hint: Column) -> Column:
    """Array of (start, end, text) of the matches of ``pattern``; only rows where ``hint`` holds are searched.

    Running sums are taken in steps of ``STEP`` matches: appending to one array for the whole text would copy it at every match.
    """
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    lengths = lambda x: F.transform(F.sequence(F.lit(0), F.size(x["m"]) - 1), lambda i: F.struct(F.length(F.get(x["p"], i)).alias("gap"), F.length(F.get(x["m"], i)).alias("own"), F.get(x["m"], i).alias("m")))
    part = lambda all_, b: F.slice(all_, b * STEP + 1, F.lit(STEP))

    def running(items: Column, first: Column, width, out_type: str, entry) -> Column:
        """``entry(sum before, item)`` of each item, in order."""
        return F.aggregate(
            items,
            F.struct(first.alias("at"), F.array().cast(out_type).alias("out")),
            lambda acc, x: F.struct((acc["at"] + width(x)).alias("at"), F.concat(acc["out"], F.array(entry(acc["at"], x))).alias("out")),
            lambda acc: acc["out"],
        )

    def within(all_: Column, first: Column, b: Column) -> Column:
        span = lambda at, x: F.struct((at + x["gap"]).alias("s"), (at + x["gap"] + x["own"]).alias("e"), x["m"].alias("m"))
        return running(part(all_, b), first, lambda x: x["gap"] + x["own"], "array<struct<s:int,e:int,m:string>>", span)

    def placed(all_: Column) -> Column:
        steps = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / STEP).cast("int"))
        sums = F.transform(steps, lambda b: F.aggregate(part(all_, b), F.lit(0), lambda acc, x: acc + x["gap"] + x["own"]))
        firsts = running(sums, F.lit(0), lambda x: x, "array<int>", lambda at, x: at)
        return let(firsts, lambda f: F.flatten(F.transform(steps, lambda b: within(all_, F.get(f, b), b))))

    got = let(F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m")), lambda x: F.when(F.size(x["m"]) > 0, let(lengths(x), placed)).otherwise(none))
    return F.when(hint, got).otherwise(none)


KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")


def found_parts(text: Column) -> dict[str, Column]:
    """Kind to the array of its spans in one text; the last three are weak candidates."""
    text = F.coalesce(text, F.lit(""))
    mixed = lambda x: x["m"].rlike("[0-9]") & x["m"].rlike("[A-Za-z]")
    strong = lambda x: mixed(x) & x["m"].rlike("[A-Z]") & x["m"].rlike("[a-z]")
    search = lambda pattern, hint=None: spans(text, pattern, text.rlike(hint or pattern))
    return {
        "assign": F.filter(search(ASSIGN), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 8),
        "access": search(ACCESS),
        "hex": search(HEX),
        "identifier": F.filter(search(IDENTIFIER), mixed),
        "secret": F.filter(search(SECRET), strong),
        "endpoint": F.transform(search(ENDPOINT, HOST_HINT), lambda x: F.struct(x["s"].alias("s"), (x["s"] + F.length(F.rtrim(x["m"], F.lit(".-")))).alias("e"), x["m"].alias("m"))),
    }


def linked(parts: DataFrame, scope: int) -> DataFrame:
    """The weak ones among ``parts`` (row, kind, s, e, weak) that have their complement within ``scope`` characters.

    A secret needs an identifier or an endpoint; identifiers and endpoints need a secret. Base matches count as parts:
    access keys as identifiers, assigned and hex values as secrets.
    """
    role = F.when(F.col("kind").isin("access", "identifier"), "id").when(F.col("kind") == "endpoint", "at").otherwise("key")
    parts = parts.withColumn("role", role)
    reached = lambda d: F.explode(F.sequence(F.floor(F.col("s") / scope) - d, F.floor(F.col("e") / scope) + d)).alias("block")
    # what a block holds, by role: one row however many parts
    blocks = parts.select("row", reached(0), F.col("role").alias("other"), "s", "e").groupBy("row", "block", "other").agg(F.min("s").alias("lo"), F.max("e").alias("hi"))
    weak = parts.where("weak").select("row", "kind", "role", "s", "e", reached(1))
    within = (F.col("lo") - F.col("e") <= scope) & (F.col("s") - F.col("hi") <= scope)
    fits = F.when(F.col("role") == "key", F.col("other") != "key").otherwise(F.col("other") == "key")
    met = weak.join(blocks, ["row", "block"]).where(fits & within)
    return met.groupBy("row", "kind", "s", "e").agg(F.first("role").alias("role")).select("row", "kind", "s", "e")


def secrets(docs: DataFrame, scope: int = SCOPE, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """row, doc_id, base and extra of each row of ``docs``: arrays of (s, k, e, kind) in order, start and end as code points."""
    text = F.col(f"`{text_col}`")
    found = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.struct(*(c.alias(k) for k, c in found_parts(text).items())).alias("p"))

    def of_kind(n: int, kind: str) -> Column:
        return F.transform(F.col(f"p.{kind}"), lambda x: F.struct(x["s"].alias("s"), F.lit(n).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind")))

    tagged = [of_kind(n, kind) for n, kind in enumerate(KINDS)]
    base, weak = F.concat(*tagged[:3]), F.concat(*tagged[3:])
    table, _ = stored(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.sort_array(base).alias("base"), weak.alias("weak")), "secrets")
    # a weak span over a base span is no new one
    clear = F.filter("weak", lambda w: ~F.exists("base", lambda b: (b["s"] < w["e"]) & (w["s"] < b["e"])))
    parts = table.select("row", F.explode(F.concat(F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["s"].alias("s"), b["e"].alias("e"), F.lit(False).alias("weak"))), F.transform(clear, lambda b: F.struct(b["kind"].alias("kind"), b["s"].alias("s"), b["e"].alias("e"), F.lit(True).alias("weak"))))).alias("x")).select("row", "x.*")
    order = F.create_map(*(F.lit(x) for n, k in enumerate(KINDS) for x in (k, n)))
    extra = linked(parts, scope).groupBy("row").agg(F.collect_list(F.struct("s", order[F.col("kind")].alias("k"), "e", "kind")).alias("extra"))
    return table.join(extra, "row", "left").select("row", "doc_id", "base", F.coalesce("extra", F.array().cast("array<struct<s:int,k:int,e:int,kind:string>>")).alias("extra"))


def listed(array: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(array), lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return secrets(documents(spark, sf_dir)).select("doc_id", *map(count, KINDS[:3]), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "extra")).alias("spans"))
