"""SentencePiece encoding and decoding as the shortest path through a weighted transducer.

Three machines are compiled from a model file. The *normaliser* writes the space symbol before the text and for each
space. The *pieces* machine has one arc for each vocabulary piece. *Byte fallback* spells a character that no piece
covers as its UTF-8 bytes. Composed with an input they make a lattice over its positions, and the shortest path in the
tropical semiring (min, +) is the encoding:

* unigram model: state = position, weight of an arc = minus the piece's score;
* BPE model: state = position and last piece, weight 0 if merging could have left the two pieces side by side
  (merging the pair alone gives the same two pieces) and infinite otherwise. Exactly one path is finite and it is what the
  merges give, so a prefix has one live state and the search is linear in the text.

Pieces never hold a space symbol after another character, so the lattice falls apart into words, whose paths are kept in
a bounded cache. Runs of spaces merge last and by equal scores; their paths come from doing the merges by run length.

Decoding is exact but for U+2581 in a text, which is the space symbol itself and comes back as a space.

Defined cases: a null text is empty, an empty text has no tokens; repeated rows each get their row; empty tables give
empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import documents

SPACE = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NORMAL, UNKNOWN, BYTE = 1, 2, 6
#: Words and pairs of pieces that are remembered at most.
CACHE = 250_000


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            n = 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + n]
            at += n


class Transducer:
    """The compiled machines of one model; ``encode`` and ``decode`` are inverse to each other."""

    def __init__(self, model: bytes) -> None:
        self.pieces: list[str] = []
        self.score: list[float] = []
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        self.unknown, self.bpe, fallback, prefix, squeeze = 0, False, False, True, True
        outputs: list[bytes] = []
        for number, value in fields(model):
            if number == 1:
                piece = dict(fields(value))
                text, kind, i = piece.get(1, b"").decode(), piece.get(3, NORMAL), len(self.pieces)
                out = text.replace(SPACE, " ").encode()
                if kind == BYTE:
                    self.byte_ids[int(text[3:5], 16)] = i
                    out = bytes([int(text[3:5], 16)])
                elif kind == UNKNOWN:
                    self.unknown, out = i, " ⁇ ".encode()
                elif kind == NORMAL:
                    self.ids[text] = i
                else:
                    out = b""
                self.pieces.append(text)
                self.score.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                outputs.append(out)
            elif number == 2:
                spec = dict(fields(value))
                self.bpe, fallback = spec.get(3, 1) == 2, bool(spec.get(35, 0))
            elif number == 3:
                spec = dict(fields(value))
                prefix, squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
                if spec.get(2):
                    raise ValueError("only the identity normaliser is supported")
        if not prefix or squeeze or not fallback:
            raise ValueError("only models with a leading space, kept white space and byte fallback are supported")
        self.outputs = outputs
        self.longest = max(map(len, self.ids))
        # the trie: each beginning of a piece leads to the longest piece that it holds, and each piece to the next shorter one
        self.trie: dict[str, int] = {}
        self.size = [len(x) for x in self.pieces]
        self.shorter = [-1] * len(self.pieces)
        for text in sorted(self.ids, key=len):
            best = -1
            for j in range(1, len(text)):
                best = self.ids.get(text[:j], best)
                self.trie.setdefault(text[:j], best)
            self.shorter[self.ids[text]] = best
            self.trie[text] = self.ids[text]
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.runs: dict[int, tuple[int, ...]] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces that merging leaves of a text: best score first, then leftmost."""
        parts: list[str | None] = list(text)
        right, left = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(parts):
                both = parts[i] + parts[j]
                if (k := self.ids.get(both)) is not None:
                    heapq.heappush(heap, (-self.score[k], i, j, both))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or right[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j], right[i] = both, None, right[j]
            if right[j] < len(parts):
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in parts if p is not None]

    def adjoin(self, a: int, b: int) -> bool:
        """Whether the weight of piece b after piece a is 0: merging leaves both as they are. -1 is the start."""
        if len(self.pairs) > CACHE:
            self.pairs.clear()
        left, right = self.pieces[a] if a >= 0 else "", self.pieces[b]
        found = self.pairs[a, b] = self.merged(left + right) == ([left, right] if left else [right])
        return found

    def path(self, text: str) -> tuple[int, ...]:
        """Token ids of the shortest path over one space symbol and the word after it."""
        ends = self.finite_path(text) if self.bpe else self.least_path(text)
        out: list[int] = []
        i = 0
        for j in ends:
            k = self.ids.get(text[i:j])
            if k is not None:
                out.append(k)
            else:
                out += [self.byte_ids[b] for b in text[i:j].encode()]
            i = j
        return tuple(out)

    def finite_path(self, text: str) -> list[int]:
        """Where the pieces of the only path of weight 0 end: depth first, longest arc first. A position from which
        all arcs failed is dead for good, as each position has one live state."""
        n, trie, pairs, size, shorter = len(text), self.trie.get, self.pairs.get, self.size, self.shorter
        dead = bytearray(n + 1)
        ends: list[int] = []
        taken: list[int] = []
        at, last, k = 0, -1, self.first(text, 0)
        while at < n:
            while k >= 0:
                if not dead[at + size[k]]:
                    fits = pairs((last, k))
                    if self.adjoin(last, k) if fits is None else fits:
                        break
                k = shorter[k]
            if k != -1:
                # a character without piece (-2) never merges: what follows starts afresh
                at += size[k] if k >= 0 else 1
                ends.append(at)
                taken.append(k)
                last = k if k >= 0 else -1
                k, j = -2, at + 1
                while j <= n and (found := trie(text[at:j])) is not None:
                    k, j = found, j + 1
                if k == -1:
                    k = -2
            else:
                dead[at] = 1
                at -= size[k] if (k := taken.pop()) >= 0 else 1
                ends.pop()
                last = max(taken[-1], -1) if taken else -1
                k = shorter[k] if k >= 0 else -1
        return ends

    def first(self, text: str, at: int) -> int:
        """The longest piece at a position, or -2."""
        k, j = -1, at + 1
        while j <= len(text) and (found := self.trie.get(text[at:j])) is not None:
            k, j = found, j + 1
        return k if k >= 0 else -2

    def least_path(self, text: str) -> list[int]:
        """Where the pieces of the path of least total weight end."""
        n = len(text)
        cost, back = [0.0] + [float("inf")] * n, [0] * (n + 1)
        for j in range(1, n + 1):
            for i in range(max(0, j - self.longest), j):
                k = self.ids.get(text[i:j])
                if k is None and i < j - 1:
                    continue
                weight = 1e6 if k is None else -self.score[k]
                if cost[i] + weight < cost[j]:
                    cost[j], back[j] = cost[i] + weight, i
        ends = [n]
        while back[ends[-1]]:
            ends.append(back[ends[-1]])
        return ends[::-1]

    def run(self, n: int) -> tuple[int, ...]:
        """Token ids of n space symbols in a row."""
        if n not in self.runs:
            if len(self.runs) > CACHE:
                self.runs.clear()
            self.runs[n] = tuple(self.ids[p] for p in self.merged(SPACE * n)) if self.bpe else self.path(SPACE * n)
        return self.runs[n]

    def word(self, text: str) -> tuple[int, ...]:
        """The path of a word that is not among the recent ones; those before them are kept one generation longer."""
        found = self.older.get(text)
        if found is None:
            found = self.path(SPACE + text)
        if len(text) <= 64:
            if len(self.words) >= CACHE:
                self.older, self.words = self.words, {}
            self.words[text] = found
        return found

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if SPACE in text:
            text = text.replace(SPACE, " ")
        out: list[int] = []
        lone, spaces = self.ids[SPACE], 0
        for w in text.split(" "):
            if not w:
                spaces += 1
                continue
            ids = self.words.get(w) or self.word(w)
            if spaces:
                if ids[0] == lone:
                    out += self.run(spaces + 1)
                    ids = ids[1:]
                else:
                    out += self.run(spaces)
                spaces = 0
            out += ids
        if spaces:
            out += self.run(spaces)
        return out

    def decode(self, ids: list[int]) -> str:
        outputs = self.outputs
        text = b"".join([outputs[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_compiled: dict[str, Transducer] = {}


def compiled(model: bytes) -> Transducer:
    """One transducer a worker, however many batches it gets."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _compiled:
        _compiled[key] = Transducer(model)
    return _compiled[key]


def read_model(path: str) -> bytes:
    """Read on the driver and sent along with the tasks: a few hundred kB, and executors need no such file."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model_path: str = MODEL, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, ids (array of int) and round_trip (whether they decode to the text again) of each row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(model.value)
        for batch in batches:
            for part in slices(batch):
                texts = [t.as_py() or "" for t in part.column(1)]
                ids = [machine.encode(t) for t in texts]
                same = [machine.decode(i) == t.replace(SPACE, " ") for i, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())], ["doc_id", "ids", "round_trip"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, round_trip boolean")


def decode(tokens: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id and text of each row of ``tokens`` (doc_id, ids)."""
    model = tokens.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(model.value)
        for batch in batches:
            text = pa.array([machine.decode(ids.as_py() or []) for ids in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), text], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def slices(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """A batch in pieces, so that the token lists of few texts are held at once."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def digest(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers) and round_trip of each row."""
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(model.value)
        for batch in batches:
            count, sha, same = [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                ids = machine.encode(text)
                count.append(len(ids))
                sha.append(hashlib.sha256(array("i", ids).tobytes()).hexdigest())
                same.append(machine.decode(ids) == text.replace(SPACE, " "))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids_sha256", "round_trip"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir))
