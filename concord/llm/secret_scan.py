"""Secret scans: token patterns, and values that would be hard to guess where credentials stand.

Base patterns (leftmost, non-overlapping, each kind by itself): ``assign`` (a
credential word, ``:`` or ``=``, a value of 6 characters or more), ``access``
(``AKIA`` ids of 20 or more) and ``hex`` (runs of 24 or more).  They miss values with
other characters, phrases like "passphrase is ...", URL logins and bearer headers.
There the scan takes the value that a credential context points at and finds by
dynamic programming the cheapest way to guess it: a segmentation into words of a
ranked vocabulary (in any capitals, with the usual digits for letters), dates,
repeats, keyboard walks and alphabet runs, and brute-force spans.  Costs are powers of
ten of guesses, every segment adds ``SEGMENT``.  A value of ``HARD`` or more is a
``guess`` span; an everyday word, a date or ``********`` is not.  Values inside a base
span are left to it.

The table grows with the value's length: a position looks back at words of
``LONGEST_WORD`` characters at most, and repeats and walks are followed as runs.  The
search ends as soon as no segment can bring the cost under ``HARD`` again,
so a long key costs what its first dozen characters do.  Texts are scanned row
by row, whole, with no shuffle; only the vocabulary is read by the tasks.

Edge cases: a null or empty text has no spans; null ids and repeated rows are kept;
offsets are code points; an empty table gives no rows; extra columns never clash.
"""

from __future__ import annotations

import functools
import json
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: kinds in order, their patterns and least lengths.
KINDS = ["assign", "access", "hex", "guess"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs [0-9a-f]+ of 24 or more
MIN_VALUE, MIN_ACCESS = 6, 20

#: Where a value of any characters is a credential: after these words, in a URL, an option or a header.
_WORD = (r"pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|api[_\x20-]?key"
         r"|(?:access|private|client|auth|signing|encryption)[_\x20-]?(?:key|secret|token)")
_VALUE = r"""(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"'<>,;]+))"""
CONTEXTS = [
    re.compile(rf"""(?:{_WORD})["']?\x20*(?:=>|:=|[:=]|\x20is\x20)\x20*{_VALUE}""", re.I | re.A),
    re.compile(rf"""--(?:password|passwd|pwd|secret|token|api-key)(?:=|\x20+){_VALUE}""", re.I | re.A),
    re.compile(r"://[^\s/:@]*:([^\s/@]+)@"),
    re.compile(r"authorization:\x20*(?:bearer|basic)\x20+(\S+)", re.I | re.A),
]

HARD = 8.0  # powers of ten of guesses
SEGMENT = math.log10(2)
LONGEST_WORD = 20
LEAST_WORD = 3
YEARS = range(1900, 2060)
DATE = math.log10(365 * len(YEARS))
LEET = str.maketrans("@430$571!", "aaeossti" + "i")
KEYS = ["`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./"]
UNSHIFTED = str.maketrans('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./")
PLACE = {c: (x, y) for y, row in enumerate(KEYS) for x, c in enumerate(row)}


@functools.lru_cache(maxsize=2)
def word_ranks(path: str) -> dict[str, int]:
    """Whole words of a vocabulary file (word ends marked ``</w>``), ranked by id."""
    vocab = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
    whole = sorted((i, w[:-4]) for w, i in vocab.items() if w.endswith("</w>") and len(w) - 4 >= LEAST_WORD and w[:-4].isascii() and w[:-4].isalpha())
    return {w: n + 1 for n, (_, w) in enumerate(whole)}


def letter_cost(c: str) -> float:
    """A character by brute force: the size of its class."""
    if not c.isascii():
        return 3.0
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() else 33)


def word_cost(piece: str, ranks: dict[str, int]) -> float | None:
    """Rank of the word, times two for each capital or leading capital and each digit for a letter."""
    low = piece.lower()
    plain = low.translate(LEET)
    rank = ranks.get(low) or ranks.get(plain)
    if not rank:
        return None
    capitals = sum("A" <= c <= "Z" for c in piece)
    ways = 0 if not capitals else 1 if piece[0].isupper() and capitals == 1 or capitals == len(piece) else capitals
    return math.log10(rank) + SEGMENT * (ways + (0 if low in ranks else sum(a != b for a, b in zip(low, plain))))


_DATES = [(re.compile(p), f) for p, f in (
    (r"(\d{4})([-/._]?)(\d{1,2})\2(\d{1,2})", (1, 3, 4)), (r"(\d{1,2})([-/._]?)(\d{1,2})\2(\d{4})", (4, 1, 3)),
    (r"(\d{2})([-/._]?)(\d{2})\2(\d{2})", (4, 1, 3)))]


def date_cost(piece: str) -> float | None:
    """A year, or a day in one of the usual orders, with or without separators."""
    if len(piece) == 4:
        return math.log10(len(YEARS)) if piece.isdigit() and piece.isascii() and int(piece) in YEARS else None
    for pattern, (y, a, b) in _DATES:
        m = pattern.fullmatch(piece)
        if m and piece.isascii():
            year, p, q = (int(m[k]) for k in (y, a, b))
            if (year < 100 or year in YEARS) and 1 <= min(p, q) and min(p, q) <= 12 and max(p, q) <= 31:
                return DATE + (SEGMENT * 2 if m[2] else 0)
    return None


def key_step(a: str, b: str) -> tuple[int, int] | None:
    """The step from one key to a neighbouring one."""
    p, q = PLACE.get(a.lower().translate(UNSHIFTED)), PLACE.get(b.lower().translate(UNSHIFTED))
    if p and q and p != q and max(abs(p[0] - q[0]), abs(p[1] - q[1])) == 1:
        return q[0] - p[0], q[1] - p[1]
    return None


def alphabet_step(a: str, b: str) -> int | None:
    """+1 or -1 from a letter or digit to the next of its class."""
    alike = a.isascii() and b.isascii() and (a.isdigit() and b.isdigit() or a.islower() and b.islower() or a.isupper() and b.isupper())
    return ord(b) - ord(a) if alike and abs(ord(b) - ord(a)) == 1 else None


UNITS = range(1, 5)


class _Runs:
    """The runs that end at the current character, each followed to the left as far as it goes."""

    def __init__(self, s: str):
        self.s = s
        self.repeat = {u: 0 for u in UNITS}  # start of the run of period u
        self.walk, self.turns, self.step = 0, 0, None
        self.order, self.sense = 0, None

    def to(self, i: int) -> list[tuple[int, float]]:
        """(start, cost) of the runs whose last character is s[i]."""
        s, out = self.s, []
        for u in UNITS:
            if i >= u and s[i] != s[i - u]:
                self.repeat[u] = i - u + 1
            start, n = self.repeat[u], i + 1 - self.repeat[u]
            if n >= max(3, 2 * u):
                out.append((start, sum(map(letter_cost, s[start: start + u])) + math.log10(n / u)))
        if i:
            step = key_step(s[i - 1], s[i])
            if step is None:
                self.walk, self.turns, self.step = i, 0, None
            else:
                self.turns += self.step is not None and step != self.step
                self.step = step
            sense = alphabet_step(s[i - 1], s[i])
            if sense is None:
                self.order, self.sense = i, None
            elif sense != self.sense:
                self.order, self.sense = i - 1, sense
        if i - self.walk >= 2:
            out.append((self.walk, math.log10(47 * (i + 1 - self.walk)) + self.turns * math.log10(4)))
        if i - self.order >= 2:
            out.append((self.order, math.log10(2 * 26 * (i + 1 - self.order))))
        return out


def guess_cost(value: str, ranks: dict[str, int], enough: float = math.inf) -> float:
    """log10 of the guesses of the cheapest segmentation; from ``enough`` on, some number of
    ``enough`` or more."""
    best, brute, runs = [0.0], math.inf, _Runs(value)
    for i, c in enumerate(value):
        brute = min(brute, best[i] + SEGMENT) + letter_cost(c)  # a brute-force span that goes on or starts
        now = brute
        for start, cost in runs.to(i):
            now = min(now, best[start] + SEGMENT + cost)
        for start in range(max(0, i + 1 - LONGEST_WORD), i + 2 - LEAST_WORD):
            cost = word_cost(value[start: i + 1], ranks)
            if cost is None and 4 <= i + 1 - start <= 10:
                cost = date_cost(value[start: i + 1])
            if cost is not None:
                now = min(now, best[start] + SEGMENT + cost)
        best.append(now)
        # A later segment starts at one of these places, or goes on with a run or span
        # that costs ``now`` or more already and gets no cheaper.
        if now >= enough and min(best[max(0, i + 1 - LONGEST_WORD):]) >= enough:
            return now
    return best[-1]


def spans(text: str, ranks: dict[str, int], hard: float = HARD) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, cost) by start, then kind; the cost of guess spans only."""
    out = [("assign", m.start(), m.end(), None) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    out += [("access", m.start(), m.end(), None) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    out += [("hex", m.start(), m.end(), None) for m in HEX.finditer(text)]
    base = sorted((a, b) for _, a, b, _ in out)
    values = set()
    for pattern in CONTEXTS:
        for m in pattern.finditer(text):
            values.add(m.span(m.lastindex))
    done, k, reach = -1, 0, -1
    for a, b in sorted(values, key=lambda v: (v[0], -v[1])):
        while k < len(base) and base[k][0] <= a:
            reach = max(reach, base[k][1])
            k += 1
        if b > max(reach, done):  # neither in a base span nor in a value found before
            cost = guess_cost(text[a:b], ranks, hard)
            if cost >= hard:
                out.append(("guess", a, b, cost))
                done = b
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def find_secrets(docs: DataFrame, vocabulary: str, hard: float = HARD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: doc_id, ``spans`` (kind, start, end, cost) and ``masked``, the text with every
    span's characters as ``*`` (null if it has none)."""

    def run(batches):
        ranks = word_ranks(vocabulary)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cost", pa.float64())]))
        for batch in batches:
            found, masked = [], []
            for cell in batch.column(1):
                s = cell.as_py() or ""
                got = spans(s, ranks, hard)
                found.append([dict(zip(("kind", "start", "end", "cost"), x)) for x in got])
                parts, at = [], 0
                for _, a, b, _ in got:
                    parts += [s[at:a], "*" * (b - max(a, at))]
                    at = max(at, b)
                masked.append("".join([*parts, s[at:]]) if got else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind), pa.array(masked, pa.string())], names=["doc_id", "spans", "masked"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, spans array<struct<kind: string, start: long, end: long, cost: double>>, masked string")


def _line(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """The report of ``find_secrets`` rows: counts and a hash of the base spans, all spans as text."""
    of = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda x: x["kind"] != "guess")
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(_line(base).cast("binary"), 256).alias("base_sha256"),
                        _line(F.col("spans")).alias("spans"), of("guess"))
