"""Personal data: four base patterns, and a character-level BiLSTM-CRF that adds spans written in other ways.

The tagger is trained in numpy on labelled spans: invented contexts around personal data in many notations, around numbers that
are none, and around nothing at all. It reads every character of every text. Texts are laid end to end, blanks between them, and cut into
overlapping windows; emissions are averaged where windows overlap, the middle of a window counting more than its ends. Tag marginals of the
windows tell where a span may be, and one CRF path is decoded over each such stretch of the reconciled emissions, whatever windows it
crosses. A span is added if the mean posterior of its tags is ``sure`` or more, it has the number of digits that its kind has (and a card's check digit; mail addresses: an at and a dot, spelled out or not), and no
base span touches it. Base spans always stay; their patterns take time in proportion to the text.

Defined cases: a null text is empty; repeated rows each get their row; empty tables give empty results; very long texts are read whole,
in pieces of bounded size that overlap; other columns are not read.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bilstm_crf import Emitter, Tagger
from ._shared import documents

KINDS = ("email", "ip", "card", "phone")
LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: A match of four numbers begins with the first digit of a run, or not at all.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Characters of a window, the overlap of two, characters that go through the network at once, and blanks between texts.
WINDOW, OVERLAP, AT_ONCE, GAP = 256, 24, 1 << 19, 16
#: A stretch is decoded where "outside" is less likely than this (in a span it has to be so on the mean), and so many characters around.
DOUBT, AROUND = 0.5, 24
SURE = 0.7
TRAIN_WINDOW = 64


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' matches, in order."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        # what goes before the sign back to the last match or sign, and of that the run that touches the sign
        before = text[done:at]
        lo = done + len(before.rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if lo < at else None
        if found:
            out.append((lo, 0, found.end()))
        done = found.end() if found else at + 1
        at = text.find("@", done)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        d = digits_of(m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(digits_of(m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- training data ---------------------------------------------------------------------------------------------------

_SYLLABLES = ("th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve al ei au ch un ge la el qu ur ir so").split()


def invented(r: random.Random) -> list[tuple[str, int]]:
    """One sentence as (piece, kind or -1)."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) if r.random() < 0.7 else "".join(r.choice(letters) for _ in range(r.randint(2, 8)))
    ds = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    octet = lambda: str(r.randint(0, 255))

    def email() -> str:
        at, dot = r.choice([("@", "."), (" @ ", "."), ("[at]", "."), ("(at)", "."), (" [at] ", "."), (" (at) ", "."), ("[at]", "[dot]"), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("{at}", "{dot}"), (" {at} ", " {dot} "), ("[At]", "[Dot]"), ("<at>", "<dot>"), (" [AT] ", " [DOT] ")])
        name = r.choice([word(), word() + "." + word(), word() + ds(2), word() + "_" + word()])
        name = name.upper() if r.random() < 0.1 else name.capitalize() if r.random() < 0.1 else name
        return name + at + dot.join([word() + r.choice(["", "", ds(1), "-" + word()]), r.choice(["com", "org", "net", "de", "fr", "es", "io", "edu", "example" + dot + "com", "co" + dot + "uk"])])

    def card() -> str:
        d = r.choice("3456") + ds(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        return r.choice(["", " ", "-", ".", "/", "  "]).join(d[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = ds(3), ds(3), ds(4)
        return r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}){b}-{c}", f"+{r.randint(20, 99)} {a} {b} {c}", f"{a} {b} {c}"])

    def ip() -> str:
        return r.choice([".", "[.]", "(.)", " . ", "[dot]", " dot ", " [.] "]).join(octet() for _ in range(4))

    def prose() -> str:
        """Words as they are written: capitals, accents, quotes, lists, code and mark-up, with no personal data."""
        w = lambda: r.choice([word(), word(), word(), word().capitalize(), word().upper(), word() + r.choice("äöüßéèáñçô") + word(), "at", "dot", "a", "I", "the"])
        joints = [" "] * 12 + [", ", ". ", "\n", "; ", " - ", "/", "'", " (", ") ", ": ", "!\n", "<", ">", "&", "=", "_", "#", "* ", " | ", "$", "%", '"', "? ", "...", "\n\n"]
        return "".join(w() + r.choice(joints) for _ in range(r.randint(4, 10)))

    if r.random() < 0.25:
        return [(prose(), -1)]

    def other() -> str:
        return r.choice(
            [
                f"{ds(r.randint(1, 6))}", f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{ds(2)}:{ds(2)}:{ds(2)}", f"${ds(3)}.{ds(2)}", f"v{ds(1)}.{ds(1)}.{ds(1)}", f"{ds(2)}%", ds(r.randint(7, 24)),
                'token = "' + "".join(r.choice("0123456789abcdef") for _ in range(40)) + '"', "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOP234567") for _ in range(16)), f"https://{word()}.com/{ds(3)}", f"@{word()}", f"{ds(1)}.{ds(3)}", f"{ds(3)}-{ds(2)}", f"Version {ds(1)}.0",
                f"{word()} at {word()}. {word()}", f"{word()} dot {word()}", f"{word()}.{word()}()", f"{word()}[{r.choice(letters)}] @ {word()}", f"({ds(2)}, {ds(3)}, {ds(3)})", f"{ds(1)}.{ds(1)}.{ds(1)}", f"{ds(2)}/{ds(2)}/{ds(4)}", f"{ds(3)} {word()} {ds(3)}", f"#{ds(6)}", " ".join(ds(r.randint(1, 3)) for _ in range(5)), f"ISO {ds(4)}-{ds(1)}:{ds(4)}", f"pp. {ds(3)}-{ds(3)}", f"{ds(1)},{ds(3)},{ds(3)}",
                f"isbn {ds(3)}-{ds(1)}-{ds(4)}-{ds(4)}-{ds(1)}", f"{word()} (at) {word()}", f"{ds(3)}.{ds(3)}.{ds(3)},{ds(2)}",
            ]
        )

    out: list[tuple[str, int]] = []
    for _ in range(r.randint(2, 4)):
        out.append((" ".join(word() for _ in range(r.randint(1, 5))) + r.choice([" ", " ", ": ", " (", ", ", "\n"]), -1))
        kind = r.choice([0, 0, 1, 2, 3, 3, -1, -1])
        out.append(((email, ip, card, phone, other)[kind](), kind))
        out.append((r.choice([" ", ". ", ", ", ") ", "\n", "!! ", "### ", " | "]), -1))
    out.append((word(), -1))
    return out


_CLASS = np.arange(129, dtype=np.int64)
_CLASS[48:58], _CLASS[65:91] = 48, 65


def symbols(text: str) -> np.ndarray:
    """Character classes: punctuation and lower-case ASCII letters as themselves; digits, capitals and the rest one each."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return _CLASS[np.minimum(a, 128)]


def tags_of(pieces: list[tuple[str, int]]) -> np.ndarray:
    """0 outside; 1 + 2k begins kind k, 2 + 2k goes on with it."""
    out: list[int] = []
    for text, kind in pieces:
        out += [0] * len(text) if kind < 0 else [1 + 2 * kind] + [2 + 2 * kind] * (len(text) - 1)
    return np.array(out)


@lru_cache(maxsize=2)
def trained(examples: int = 4000, epochs: int = 10, seed: int = 17, rate: float = 0.05, batch: int = 32, hidden: int = 16) -> Tagger:
    """The tagger, trained on ``examples`` windows; the same for the same arguments."""
    r = random.Random(seed)
    xs, ys = [], []
    while len(xs) < examples:
        pieces = invented(r)
        x, y = symbols("".join(t for t, _ in pieces)), tags_of(pieces)
        # windows as in use: they may begin and end within a span
        at = r.randrange(max(1, len(x) - TRAIN_WINDOW + 1))
        x, y = x[at : at + TRAIN_WINDOW], y[at : at + TRAIN_WINDOW]
        xs.append(np.pad(x, (0, TRAIN_WINDOW - len(x)), constant_values=32))
        ys.append(np.pad(y, (0, TRAIN_WINDOW - len(y))))
    tagger = Tagger(129, 1 + 2 * len(KINDS), hidden=hidden)
    tagger.train(np.array(xs), np.array(ys), epochs, batch=batch, rate=rate)
    return tagger


# --- tagging ---------------------------------------------------------------------------------------------------------


def sound(kind: int, text: str) -> bool:
    """Whether a span has the digits or the signs, spelled out or not, that its kind has; how it is written is the tagger's to judge."""
    d = digits_of(text)
    if kind == 1:
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 12 <= len(d) <= 19 and luhn(d)
    if kind == 3:
        return 9 <= len(d) <= 15
    low = text.lower()
    return ("@" in low or "at" in low) and ("." in low or "dot" in low) and 6 <= len(text) <= 254


class Reconciled:
    """Emissions of a long row of symbols from overlapping windows, and where a span may be."""

    def __init__(self, codes: np.ndarray, network: Emitter) -> None:
        self.stride, n = WINDOW - OVERLAP, len(codes)
        self.windows = max(1, -(-(n - OVERLAP) // self.stride))
        padded = np.full(self.windows * self.stride + OVERLAP, 32, dtype=codes.dtype)
        padded[:n] = codes
        cut = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[:: self.stride]
        self.m = m = network.emissions(np.ascontiguousarray(cut.T))
        # in an overlap the weight of the window before falls as that of the next one rises; both go on with the mean
        rise = ((np.arange(OVERLAP, dtype=np.float32) + 0.5) / OVERLAP)[:, None, None]
        m[:OVERLAP, :, 1:] = m[-OVERLAP:, :, :-1] = m[:OVERLAP, :, 1:] * rise + m[-OVERLAP:, :, :-1] * (1 - rise)
        inside = (network.outside(m) < DOUBT).T
        doubt = np.concatenate([inside[:, : self.stride].ravel(), inside[-1, self.stride :]])
        if self.windows > 1:
            doubt[:-OVERLAP].reshape(self.windows, self.stride)[1:, :OVERLAP] |= inside[:-1, self.stride :]
        self.doubt = doubt[:n]

    def emissions(self, lo: int, hi: int) -> np.ndarray:
        """(places, tags) of a stretch, each place from the window that begins last at or before it."""
        at = np.arange(lo, hi)
        window = np.minimum(at // self.stride, self.windows - 1)
        return self.m[at - window * self.stride, :, window].astype(float)


def stretches(doubt: np.ndarray) -> list[tuple[int, int]]:
    """Where a path has to be decoded: ``AROUND`` characters either side of every doubtful place, merged."""
    at = np.flatnonzero(doubt)
    if not len(at):
        return []
    cuts = np.flatnonzero(np.diff(at) > 2 * AROUND)
    return [(max(0, int(a) - AROUND), min(len(doubt), int(b) + AROUND + 1)) for a, b in zip(at[[0, *(cuts + 1)]], at[[*cuts, -1]], strict=True)]


def tagged(codes: np.ndarray, taken: np.ndarray, tagger: Tagger, network: Emitter, sure: float) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the spans in a long row of symbols. A span as sure as that has doubtful places, and must not have ``taken`` ones."""
    row = Reconciled(codes, network)
    doubt = row.doubt & ~taken
    out = []
    for lo, hi in stretches(doubt):
        tags, p = tagger.best(row.emissions(lo, hi))
        k = 0
        while k < len(tags):
            if tags[k] % 2 == 1:
                end = k + 1
                while end < len(tags) and tags[end] == tags[k] + 1:
                    end += 1
                if p[k:end].mean() >= sure:
                    out.append((lo + k, int(tags[k] - 1) // 2, lo + end))
                k = end
            else:
                k += 1
    return out


def added_spans(texts: list[str], bases: list[list[tuple[int, int, int]]], tagger: Tagger, sure: float = SURE, network: Emitter | None = None) -> list[list[tuple[int, int, int]]]:
    """The tagger's spans of each text that no base span touches. Texts go through the network end to end, about ``AT_ONCE`` characters at
    a time; longer ones in pieces that overlap by a window, of which each gives the spans that begin before the middle of the overlap."""
    network = network or tagger.fast()
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    held: list[tuple[int, int, int, int, np.ndarray]] = []

    def flush() -> None:
        row, starts, at = [], [], 0
        taken = np.zeros(sum(len(codes) + GAP for *_, codes in held), dtype=bool)
        for i, lo, *_, codes in held:
            starts.append(at)
            row += [codes, np.full(GAP, 32, dtype=np.int64)]
            for p, _, q in bases[i]:
                if lo < q and p < lo + len(codes):
                    taken[at + max(0, p - lo) : at + min(len(codes), q - lo)] = True
            at += len(codes) + GAP
        found = tagged(np.concatenate(row), taken, tagger, network, sure) if row else []
        j = 0
        for a, kind, b in found:
            while j + 1 < len(starts) and starts[j + 1] <= a:
                j += 1
            i, lo, first, last, codes = held[j]
            x, y = a - starts[j] + lo, min(b - starts[j], len(codes)) + lo
            if first <= x < last and x < y and sound(kind, texts[i][x:y]) and not any(p < y and x < q for p, _, q in bases[i]):
                out[i].append((x, kind, y))
        held.clear()

    size = 0
    for i, text in enumerate(texts):
        codes = symbols(text)
        for lo in range(0, max(1, len(codes)), AT_ONCE):
            left, right = max(0, lo - WINDOW), min(len(codes), lo + AT_ONCE + WINDOW)
            held.append((i, left, lo, lo + AT_ONCE, codes[left:right]))
            size += right - left + GAP
            if size >= AT_ONCE:
                flush()
                size = 0
    flush()
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def find(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **training) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_spans of each row of ``docs``."""
    tagger = docs.sparkSession.sparkContext.broadcast(trained(**training))  # a few thousand weights
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = tagger.value.fast()
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                texts = [t.as_py() or "" for t in part.column(1)]
                bases = [base_spans(t) for t in texts]
                more = added_spans(texts, bases, tagger.value, network=network)
                counts = [pa.array([sum(x[1] == k for x in b) for b in bases], pa.int64()) for k in range(len(KINDS))]
                sha = pa.array([hashlib.sha256(listed(b).encode()).hexdigest() for b in bases], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, sha, pa.array([listed(b + m) for b, m in zip(bases, more, strict=True)], pa.string()), pa.array([len(b) + len(m) for b, m in zip(bases, more, strict=True)], pa.int64())], names)

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_spans long"
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(documents(spark, sf_dir))
