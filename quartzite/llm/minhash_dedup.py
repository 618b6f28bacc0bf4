"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

Sketch (Dahlgaard, Knudsen and Thorup 2017): in round i every element is hashed to a bin and a value in
[0, 1); a bin keeps the least of i + value. The first ``t`` rounds choose the bin by hash, the next ``t``
give all elements to bin i - t, so every coordinate is filled; filling ends with the first round after which
no bin is empty. Coordinates agree with probability J, with concentration as for independent trials.

``t`` = bands * rows coordinates are cut into bands; documents that agree on a band share a bucket. A bucket is
never expanded into pairs: its first member is the leader and each other member is verified against it on
the full shingle sets. Verified links make components. In buckets that still hold several components, the members outside the leader's
component (outsiders) meet all others, in blocks of bounded size, in the first bucket that two of them share: first their sketches, and where
those agree well enough their full shingle sets. No pairs are made but links, at most one for an outsider and another component in a block.
A pair at similarity 0.8 misses all bands with probability (1 - 0.8^rows)^bands, 5e-7 as set; sketches are turned away at six standard deviations
(1e-9).

Defined cases: null or wordless texts have an empty set and are linked with nothing; one word makes a set of
one; documents with the same set are one class (links of a class are links of its first document); a doc_id that
occurs in several rows is one node, linked if any of its texts is; rows without doc_id are linked with nothing and
are kept; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._components import components
from ._shared import discard, documents, few, stored

BANDS, ROWS = 48, 6
#: Rows of a block on either side.
BLOCK = 512
#: Ids that may be broadcast, to pick texts or for the blocks of large buckets: 16 MB. Beyond, such a join shuffles.
IDS = 1_000_000
#: Bytes of text that are hashed at once.
CHUNK = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, a bijection."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class WordHasher:
    """64-bit hashes of the lower-cased words of many texts at once, by prefix sums of a polynomial."""

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, dtype=np.uint64)

    def powers(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * CHUNK)
            inverse = pow(self.BASE, -1, 1 << 64)
            ones = np.full(n, self.BASE, dtype=np.uint64)
            ones[0] = 1
            self.up = np.cumprod(ones, dtype=np.uint64)
            ones[1:] = inverse
            self.down = np.cumprod(ones, dtype=np.uint64)

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each word of ``data`` and the number of its text; ``offsets`` has the texts' bounds in data."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.powers(n)
        inner = ~_SPACE[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        starts = inner.copy()
        starts[1:] &= ~inner[:-1] | edge[1:n]
        ends = inner.copy()
        ends[:-1] &= ~inner[1:] | edge[1:n]
        a, b = np.flatnonzero(starts), np.flatnonzero(ends)
        total = np.cumsum((_LOWER[data].astype(np.uint64) + _U(1)) * self.up[:n], dtype=np.uint64)
        before = np.where(a > 0, total[np.maximum(a - 1, 0)], _U(0))
        return mix((total[b] - before) * self.down[a] ^ (b - a + 1).astype(np.uint64)), np.searchsorted(offsets, a, side="right") - 1


def shingles_of(word: np.ndarray, text: np.ndarray, n_texts: int, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    bounds = np.searchsorted(text, np.arange(n_texts + 1))
    joined = word.copy()
    for k in range(1, width):
        joined[: len(word) - k] = mix(joined[: len(word) - k] * _U(0x9FB21C651E98DF25) + word[k:])
    for i in range(n_texts):
        lo, hi = bounds[i], bounds[i + 1]
        if hi - lo >= width:
            yield np.unique(joined[lo : hi - width + 1])
        elif hi > lo:
            whole = word[lo : lo + 1]
            for k in range(lo + 1, hi):
                whole = mix(whole * _U(0x9FB21C651E98DF25) + word[k : k + 1])
            yield mix(whole ^ _U(0x5851F42D4C957F2D))
        else:
            yield np.zeros(0, dtype=np.uint64)


def sketch(elements: np.ndarray, t: int) -> np.ndarray:
    """The ``t`` coordinates of a set of 64-bit hashes."""
    out = np.full(t, np.iinfo(np.uint64).max, dtype=np.uint64)
    step = max(1, min(t, 3 * t // len(elements)))
    for first in range(0, 2 * t, step):
        rounds = np.arange(first, min(first + step, 2 * t), dtype=np.uint64)
        h = mix(elements[None, :] ^ mix(rounds + _U(0x2545F4914F6CDD1D))[:, None])
        value = (rounds[:, None] << _U(48)) | (h & _U((1 << 48) - 1))
        bins = np.where(rounds[:, None] < _U(t), ((h >> _U(32)) * _U(t)) >> _U(32), rounds[:, None] - _U(t))
        np.minimum.at(out, bins.ravel().astype(np.int64), value.ravel())
        if out.max() < _U((first + step) << 48):
            # the rounds of a step come in order, so values of a later round never displace earlier ones
            break
    return out


def bands_of(coordinates: np.ndarray, bands: int) -> np.ndarray:
    cut = coordinates.reshape(bands, -1)
    key = mix(np.arange(1, bands + 1, dtype=np.uint64))
    for k in range(cut.shape[1]):
        key = mix(key * _U(0x9FB21C651E98DF25) + cut[:, k])
    return key.view(np.int64)


def chunks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets) of a string column, about CHUNK bytes at a time; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1)
        yield data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def sketcher(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            if not batch.num_rows:
                continue
            count, h1, h2, keys, digests = [], [], [], [], []
            for data, offsets in chunks(batch.column(1)):
                for s in shingles_of(*hasher.words(data, offsets), len(offsets) - 1, width):
                    count.append(len(s))
                    h1.append(mix(s).sum(dtype=np.uint64))
                    h2.append(mix(s ^ _U(0xD1B54A32D192ED03)).sum(dtype=np.uint64))
                    coordinates = sketch(s, bands * rows) if len(s) else None
                    keys.append(None if coordinates is None else bands_of(coordinates, bands))
                    digests.append(None if coordinates is None else coordinates.astype(np.uint8).tobytes())
            full = [k for k in keys if k is not None]
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum([0 if k is None else bands for k in keys])]), pa.int32()), pa.array(np.concatenate(full) if full else np.zeros(0, np.int64), pa.int64())
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), pa.array(np.array(h1, dtype=np.uint64).view(np.int64)), pa.array(np.array(h2, dtype=np.uint64).view(np.int64)), lists, pa.array(digests, pa.binary())],
                ["doc_id", "n_shingles", "h1", "h2", "bands", "digest"],
            )

    return run


def verifier(width: int, percent: int):
    def shingles(text: str | None) -> set:
        w = (text or "").encode().translate(bytes(_LOWER)).split()
        return set(zip(*(w[k:] for k in range(width)), strict=False)) if len(w) >= width else {tuple(w)} if w else set()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple | None = None
        own: set = set()
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            linked = []
            for i, (ta, tb) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                # one doc_id may have several texts
                if (key := (a[i], ta.as_py())) != seen:
                    seen, own = key, shingles(key[1])
                other = shingles(tb.as_py())
                both = len(own & other)
                linked.append(bool(own) and 100 * both >= percent * (len(own) + len(other) - both))
            mask = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    left = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    both = left.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(verifier(width, percent), "a long, b long").distinct()


def outsiders(inside: DataFrame, found: DataFrame) -> DataFrame:
    """Members of buckets of more than two, with their component (comp) and whether it is another one than the leader's (out)."""
    comp = found.select(F.col("node").alias("rep"), "component")
    named = inside.where("size > 2").join(comp, "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    named = named.join(comp.withColumnRenamed("rep", "lead"), "lead", "left").withColumn("out", F.col("comp") != F.coalesce("component", "lead"))
    return named.select("band", "rep", "n", "comp", "out")


def set_reader(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            sets = [s.tobytes() for data, offsets in chunks(batch.column(1)) for s in shingles_of(*hasher.words(data, offsets), len(offsets) - 1, width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["rep", "elements"])

    return run


KEYS = ["band", "x", "y"]


def blocked(rows: DataFrame) -> DataFrame:
    """The members of mixed buckets (band, rep, comp, out, ...) by block: outsiders are the left side of the blocks (x, y) of their x, all members
    the right side of those of their y. A bucket of up to BLOCK members is one block."""
    parts = rows.groupBy("band").agg(F.ceil(F.count_if("out") / BLOCK).cast("int").alias("xs"), F.ceil(F.count("*") / BLOCK).cast("int").alias("ys")).where("ys > 1")
    parts, _ = stored(parts, "blocks")
    one = F.lit(1)
    rows = rows.join(few(parts, IDS), "band", "left").withColumns({"xs": F.coalesce("xs", one), "ys": F.coalesce("ys", one)})
    block = lambda n: F.pmod(F.xxhash64(F.lit(5), "rep"), F.col(n)).cast("int")
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    left = F.when(F.col("out"), F.transform(each("ys"), lambda y: F.struct(block("xs").alias("x"), y.alias("y"), F.lit(True).alias("side")))).otherwise(F.array().cast("array<struct<x:int,y:int,side:boolean>>"))
    right = F.transform(each("xs"), lambda x: F.struct(x.alias("x"), block("ys").alias("y"), F.lit(False).alias("side")))
    return rows.withColumn("to", F.explode(F.concat(left, right))).select("*", "to.*").drop("to", "xs", "ys", "out")


def by_block(rows: DataFrame, solve, schema: str) -> DataFrame:
    """``solve`` on the rows of each block, as one table after the other in a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = [batch.column(i).to_numpy() for i in range(3)]
            cuts = np.flatnonzero((np.diff(key[0]) != 0) | (np.diff(key[1]) != 0) | (np.diff(key[2]) != 0)) + 1
            edges = [0, *cuts.tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:], strict=False):
                own = tuple(int(k[lo]) for k in key)
                if own != last and held:
                    yield from solve(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(lo, hi - lo))
                last = own
        if held:
            yield from solve(pa.Table.from_batches(held))

    others = [c for c in rows.columns if c not in KEYS]
    return rows.select(*KEYS, *others).repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(run, schema)


def stacked(column: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.array([np.frombuffer(x.as_py(), dtype=dtype) for x in column])


def sketch_solver(percent: int, t: int):
    """The rows of a block that may have a link in it: this is the first bucket that the two share, they are of different components and of
    sizes that allow a link, and their sketches agree in enough places."""
    j = percent / 100
    agree_least = j - 6 * np.sqrt(j * (1 - j) / t)

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        side = table.column("side").to_numpy()
        left, right = np.flatnonzero(side), np.flatnonzero(~side)
        if not len(left) or not len(right):
            return
        band, rep, comp, n = (table.column(c).to_numpy() for c in ("band", "rep", "comp", "n"))
        digest, keys = stacked(table.column("digest"), np.uint8), stacked(table.column("keys"), np.int64)
        used = np.zeros(len(side), dtype=bool)
        for i in left:
            at = right[comp[right] != comp[i]]
            at = at[np.minimum(n[at], n[i]) * 100 >= np.maximum(n[at], n[i]) * percent]
            same = keys[at] == keys[i]
            at = at[same.any(1) & (keys[i][same.argmax(1)] == band[i])]
            at = at[(digest[at] == digest[i]).mean(1) >= agree_least]
            used[at] = True
            used[i] = len(at) > 0
        if used.any():
            yield from table.select([*KEYS, "rep", "comp", "side"]).filter(pa.array(used)).to_batches()

    return solve


def set_solver(percent: int):
    """Links between the left and the right side of one block: one for each outsider and other component at most, as
    components need no more. Intersections are counted for the whole right side at once, by marking an outsider's elements."""

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        side, rep, comp = (table.column(c).to_numpy() for c in ("side", "rep", "comp"))
        sets = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in table.column("elements")]
        left, right = np.flatnonzero(side), np.flatnonzero(~side)
        a, b = [], []
        if len(left) and len(right):
            values, code = np.unique(np.concatenate([sets[i] for i in right]), return_inverse=True)
            size = np.array([len(sets[i]) for i in right])
            begin = np.concatenate([[0], np.cumsum(size)[:-1]])
            mark = np.zeros(len(values), dtype=np.int32)
            for i in left:
                at = np.searchsorted(values, sets[i])
                at = at[(at < len(values)) & (values[np.minimum(at, len(values) - 1)] == sets[i])]
                mark[at] = 1
                both = np.add.reduceat(mark[code], begin)
                mark[at] = 0
                hits = np.flatnonzero((100 * both >= percent * (len(sets[i]) + size - both)) & (comp[right] != comp[i]))
                for j in hits[np.unique(comp[right][hits], return_index=True)[1]]:
                    a.append(rep[i])
                    b.append(rep[right[j]])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return solve


def remaining_links(inside: DataFrame, classes: DataFrame, first: DataFrame, involved, width: int, percent: int, t: int) -> tuple[DataFrame, list[str]]:
    """Links of the outsiders of all buckets with members of other components."""
    named, at_named = stored(outsiders(inside, first), "named")
    mixed = named.join(named.where("out").select("band").distinct(), "band", "left_semi")
    packed = classes.select("rep", "digest", F.col("bands"))
    rows = blocked(mixed).join(packed, "rep")

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bands as bytes, which are cheaper to sort along than an array."""
        for b in batches:
            lists = b.column("bands")
            flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            keys = pa.array([flat[i:j].tobytes() for i, j in zip(ends, ends[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([keys if c == "bands" else b.column(c) for c in b.schema.names], ["keys" if c == "bands" else c for c in b.schema.names])

    rows = rows.mapInArrow(unpacked, ", ".join(f"{'keys' if c == 'bands' else c} {'binary' if c == 'bands' else t}" for c, t in rows.dtypes))
    near, at_near = stored(by_block(rows, sketch_solver(percent, t), "band long, x int, y int, rep long, comp long, side boolean"), "near")
    sets, at_sets = stored(involved(near.select(F.col("rep").alias("a"), F.col("rep").alias("b"))).mapInArrow(set_reader(width), "rep long, elements binary"), "sets")
    found, at_found = stored(by_block(near.join(sets, "rep"), set_solver(percent), "a long, b long").distinct(), "more")
    return found, [at_named, at_near, at_sets, at_found]


def near_duplicates(docs: DataFrame, width: int = 2, percent: int = 80, bands: int = BANDS, rows: int = ROWS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, kept and set class (h1, h2) of each row of ``docs``."""
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    sketches, _ = stored(source.mapInArrow(sketcher(width, bands, rows), "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, digest binary"), "sketch")
    filled = sketches.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    # rows of one set are one class; its bands are the same in each row
    classes, at_classes = stored(filled.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("digest").alias("digest")), "class")
    member = classes.select(F.explode("bands").alias("band"), "rep", "n")
    # tables of their own: a join with a written table is one that Spark can split where a key is hot
    lead, at_lead = stored(member.groupBy("band").agg(F.min(F.struct("rep", "n")).alias("lead"), F.count("*").alias("size")).where("size > 1"), "lead")
    inside = member.join(lead, "band")
    inside, at_inside = stored(inside.select("band", "rep", "n", F.col("lead.rep").alias("lead"), F.col("lead.n").alias("lead_n"), "size"), "bucket")

    fits = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    star = inside.where((F.col("rep") != F.col("lead")) & fits(F.col("n"), F.col("lead_n"))).select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    star, at_star = stored(star, "star")

    def involved(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
        return source.join(few(ids, IDS), "doc_id", "left_semi")

    links, at_links = stored(verified(star, involved(star), width, percent), "links")
    same = filled.groupBy("doc_id").agg(F.count_distinct("h1", "h2").alias("k")).where("k > 1").select("doc_id")
    # a doc_id with several sets ties their classes together
    ties = filled.join(same, "doc_id", "left_semi").join(classes.select("h1", "h2", "rep"), ["h1", "h2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct()
    links = links.unionByName(ties)
    first = components(links)

    # a bucket whose members all are in the leader's component is done
    more, scratch = remaining_links(inside, classes, first, involved, width, percent, bands * rows)
    final = components(links.unionByName(more))

    found = classes.select("h1", "h2", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("component"))
    found, _ = stored(found, "component")
    out = sketches.select("doc_id", "n_shingles", "h1", "h2").join(found, ["h1", "h2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "h1", "h2")
    discard(spark, at_lead, at_inside, at_star, at_links, at_classes, *scratch)
    return out


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")
