"""Secret scan: fixed patterns, and a randomness test battery for strings without one.

Patterns (base spans): assignments to password-like names, access key ids, long hex runs.
Battery: every other run of 20 and more characters of [A-Za-z0-9+/_-] with letters and
digits is taken in the smallest encoding that holds it, and three tests ask whether its
symbols look drawn at random: chi-squared uniformity over the alphabet, runs above and
below its middle, serial correlation. The least of the three probabilities, corrected for
three tries, is uniform for random strings and near 0 for words, paths and numbers.

False-discovery control is by encoding and length: short strings leave more ordinary ones
undetected. Strings above the middle of the probabilities are taken as random; as random
ones spread evenly, their count tells how many of the strings above any cut are random. The
cut of a stratum is the lowest that leaves a share of at most FDR others, counting one more
than estimated. That takes 1 / FDR random strings; a stratum without such a cut has that of
its encoding's strata together, an encoding without one that of all strata, or the lowest
one above it that the own counts do not speak against (two standard errors). Strings are
counted once, however often they are copied. The counts cover all rows and are a few
thousand numbers however many those are.

Rows are scanned twice in their scan tasks; nothing is shuffled but the candidates' hashes
and the counts.

Edge cases: null is an empty text; spans count code points and may overlap between kinds;
rows are judged one by one, so repeated rows repeat; other columns are not touched.
"""
from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, Chunk, RollingHash, text_chunks

# The patterns and least lengths of the base spans, kinds in listed order.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

RANDOM = "random"
LEAST_RUN = 20
FDR = 0.05
#: Lengths at which a new stratum begins.
BANDS = np.array([20, 28, 40, 64])
BINS = 50
MASK = "[SECRET]"

_RUN = np.zeros(256, dtype=bool)
_RUN[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", np.uint8)] = True
_HEX = np.zeros(256, dtype=bool)
_HEX[np.frombuffer(b"0123456789abcdef", np.uint8)] = True
_DIGITS, _LETTERS = b"0123456789", b"abcdefghijklmnopqrstuvwxyz"
#: Encodings, smaller alphabets first.
ALPHABETS = (
    _DIGITS + _LETTERS[:6],
    _DIGITS + _LETTERS[:6].upper(),
    _LETTERS.upper() + b"234567",
    _DIGITS + _LETTERS,
    _DIGITS + _LETTERS.upper(),
    _LETTERS.upper() + _LETTERS + _DIGITS,
    _LETTERS.upper() + _LETTERS + _DIGITS + b"+/",
    _LETTERS.upper() + _LETTERS + _DIGITS + b"-_",
)
_OUTSIDE = np.ones((len(ALPHABETS), 256), dtype=np.uint8)
_SYMBOL = np.zeros((len(ALPHABETS), 256), dtype=np.int64)
for _i, _a in enumerate(ALPHABETS):
    _OUTSIDE[_i, np.frombuffer(_a, np.uint8)] = 0
    _SYMBOL[_i, np.frombuffer(_a, np.uint8)] = np.arange(len(_a))
_IS_DIGIT = np.isin(np.arange(256), np.frombuffer(_DIGITS, np.uint8)).astype(np.uint8)
_IS_LETTER = np.isin(np.arange(256), np.frombuffer(_LETTERS + _LETTERS.upper(), np.uint8)).astype(np.uint8)


# ------------------------------------------------------------------ tests
def _erfc(x: np.ndarray) -> np.ndarray:
    """Complementary error function of x >= 0 (Abramowitz and Stegun 7.1.26, to 1.5e-7)."""
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * np.exp(-x * x)


def two_sided(z: np.ndarray) -> np.ndarray:
    return _erfc(np.abs(z) / np.sqrt(2))


def battery(symbols: np.ndarray, offsets: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Probability, for each string ``symbols[offsets[i]:offsets[i + 1]]`` over an alphabet of
    ``size[i]``, that symbols drawn at random look as odd in the oddest of three tests."""
    n = np.diff(offsets).astype(float)
    m = len(n)
    if not m:
        return np.empty(0)
    own = np.repeat(np.arange(m), np.diff(offsets))
    top = int(size.max())
    counts = np.bincount(own * top + symbols, minlength=m * top).reshape(m, top)
    # chi-squared: exact mean and variance, cube-root normal of the gamma with those
    df = size - 1.0
    chi = (counts.astype(float) ** 2).sum(axis=1) * size / n - n
    shape = df ** 2 / (2 * df * (n - 1) / n)
    cube = np.cbrt(chi / df)
    p_chi = two_sided((cube - (1 - 1 / (9 * shape))) / np.sqrt(1 / (9 * shape)))
    # runs above and below the middle of the alphabet
    high = symbols * 2 >= size[own]
    ones = np.bincount(own, weights=high, minlength=m)
    zeros = n - ones
    inner = own[1:] == own[:-1]
    runs = 1 + np.bincount(own[1:], weights=inner & (high[1:] != high[:-1]), minlength=m)
    mean = 2 * ones * zeros / n + 1
    var = np.maximum((mean - 1) * (mean - 2) / (n - 1), 1e-9)
    p_runs = np.where(ones * zeros > 0, two_sided((runs - mean) / np.sqrt(var)), 0.0)
    # serial correlation of neighbours
    x = symbols - np.bincount(own, weights=symbols, minlength=m)[own] / n[own]
    square = np.maximum(np.bincount(own, weights=x * x, minlength=m), 1e-9)
    serial = np.bincount(own[1:], weights=np.where(inner, x[1:] * x[:-1], 0.0), minlength=m) / square
    p_serial = two_sided((serial + 1 / n) * np.sqrt(n))
    least = np.minimum(np.minimum(p_chi, p_runs), p_serial)
    return 1 - (1 - least) ** 3


# ------------------------------------------------------------------ scan
def _runs(mask: np.ndarray, chunk: Chunk, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of ``mask`` within rows."""
    n = len(mask)
    edge = np.zeros(n + 1, dtype=bool)
    edge[chunk.offsets] = True
    before = np.concatenate(([False], mask[:-1])) if n else mask
    after = np.concatenate((mask[1:], [False])) if n else mask
    s = np.flatnonzero(mask & (~before | edge[:n]))
    e = np.flatnonzero(mask & (~after | edge[1:])) + 1
    keep = e - s >= least
    return s[keep], e[keep]


def _rows_with(data: bytes, needles: tuple[bytes, ...], offsets: np.ndarray) -> list[int]:
    rows: set[int] = set()
    for needle in needles:
        at = data.find(needle)
        while at >= 0:
            row = int(np.searchsorted(offsets, at, side="right")) - 1
            rows.add(row)
            at = data.find(needle, max(at + 1, int(offsets[row + 1])))
    return sorted(rows)


def base_spans(chunk: Chunk) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of the chunk."""
    spans = []
    for row in _rows_with(_LOWER[chunk.data].tobytes(), ASSIGN_NAMES, chunk.offsets):
        at = int(chunk.offsets[row])
        spans += [(at + m.start(), 0, at + m.end()) for m in ASSIGN.finditer(chunk.text(row)) if m.end() - m.start(2) >= LEAST_VALUE]
    for row in _rows_with(chunk.data.tobytes(), (b"AKIA",), chunk.offsets):
        at = int(chunk.offsets[row])
        spans += [(at + m.start(), 1, at + m.end()) for m in ACCESS.finditer(chunk.text(row)) if m.end() - m.start() >= LEAST_ACCESS]
    spans += [(s, 2, e) for s, e in zip(*(x.tolist() for x in _runs(_HEX[chunk.data], chunk, LEAST_HEX)))]
    return sorted(spans)


def candidates(chunk: Chunk, base: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, stratum, probability) of the runs that the battery judges."""
    s, e = _runs(_RUN[chunk.data], chunk, LEAST_RUN)
    if base and len(s):
        cover = np.zeros(len(chunk.data) + 1, dtype=np.int32)
        np.add.at(cover, [b[0] for b in base], 1)
        np.add.at(cover, [b[2] for b in base], -1)
        inside = np.concatenate(([0], np.cumsum(np.cumsum(cover[:-1]) > 0)))
        free = inside[e] == inside[s]
        s, e = s[free], e[free]
    none = np.empty(0, np.int64)
    if len(s):
        n = e - s
        off = np.concatenate(([0], np.cumsum(n)))
        flat = chunk.data[np.arange(off[-1]) - np.repeat(off[:-1], n) + np.repeat(s, n)]
        has = lambda lut: np.maximum.reduceat(lut[flat], off[:-1]).astype(bool)
        fits = np.stack([~has(lut) for lut in _OUTSIDE])
        ok = has(_IS_DIGIT) & has(_IS_LETTER) & fits.any(axis=0)
        encoding = np.argmax(fits, axis=0)
        keep = np.repeat(ok, n)
        s, e, n, encoding, flat = s[ok], e[ok], n[ok], encoding[ok], flat[keep]
    if not len(s):
        return none, none, none, none.astype(float)
    off = np.concatenate(([0], np.cumsum(n)))
    size = np.array([len(a) for a in ALPHABETS])[encoding]
    p = battery(_SYMBOL[np.repeat(encoding, n), flat], off, size)
    return s, e, encoding * len(BANDS) + np.searchsorted(BANDS, n, side="right") - 1, p


def _strings(batches):
    """Rows (h, stratum, bin): the distinct candidates of each chunk."""
    for chunk in text_chunks(batches):
        s, e, stratum, p = candidates(chunk, base_spans(chunk))
        code, at = np.unique(RollingHash(chunk.data).ranges(s, e), return_index=True)
        bucket = np.minimum((p[at] * BINS).astype(np.int64), BINS - 1)
        yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(stratum[at].astype(np.int64)), pa.array(bucket)], names=["h", "stratum", "bin"])


def _cut(row: np.ndarray, fdr: float, parent: float = 2.0) -> float:
    """Least accepted probability of strings with these counts, above 1 where nothing is accepted."""
    half = BINS // 2
    above = np.cumsum(row[::-1])[::-1]
    others = lambda b: max(0.0, above[b] - above[half] * 2 * (1 - b / BINS))
    for b in range(1, half + 1):
        if above[b] and others(b) + 1 <= fdr * above[b]:
            return b / BINS
    for b in range(round(parent * BINS), half + 1):
        if others(b) <= fdr * above[b] + 2 * np.sqrt(above[b]):
            return b / BINS
    return 2.0


def cuts_of(counts: np.ndarray, fdr: float = FDR) -> np.ndarray:
    """Least accepted probability of each stratum, above 1 where nothing is accepted."""
    everything = _cut(counts.sum(axis=0), fdr)
    encodings = [_cut(rows.sum(axis=0), fdr, everything) for rows in counts.reshape(-1, len(BANDS), BINS)]
    return np.array([_cut(row, fdr, encodings[k // len(BANDS)]) for k, row in enumerate(counts)])


def learn_cuts(docs: DataFrame, fdr: float = FDR) -> np.ndarray:
    """Cuts of all strata, from the distinct candidates of all rows of ``docs``."""
    strings = docs.select("text").mapInArrow(_strings, "h long, stratum long, bin long").distinct()
    rows = strings.groupBy("stratum", "bin").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = np.zeros((len(ALPHABETS) * len(BANDS), BINS), dtype=np.int64)
    for r in rows:
        counts[r["stratum"], r["bin"]] = r["n"]
    return cuts_of(counts, fdr)


def all_spans(chunk: Chunk, cuts: np.ndarray) -> list[tuple[int, int, int]]:
    """Base and random spans of a chunk, by start, then kind."""
    base = base_spans(chunk)
    s, e, stratum, p = candidates(chunk, base)
    good = p >= cuts[stratum]
    return sorted(base + [(a, len(KINDS), b) for a, b in zip(s[good].tolist(), e[good].tolist())])


def find_secrets(docs: DataFrame, cuts: np.ndarray, id_col: str = "doc_id") -> DataFrame:
    """Row of ``docs`` by row: ``id_col``, n_assign, n_access, n_hex, n_random, base_sha256 and
    spans (kind:start:end, comma-joined)."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"]
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches):
        labels = (*KINDS, RANDOM)
        for chunk in text_chunks(batches):
            n = len(chunk)
            counts = np.zeros((n, len(labels)), dtype=np.int64)
            texts: list[list[str]] = [[] for _ in range(n)]
            base: list[list[str]] = [[] for _ in range(n)]
            points = np.concatenate(([0], np.cumsum((chunk.data & 0xC0) != 0x80)))
            for s, k, e in all_spans(chunk, cuts):
                row = int(np.searchsorted(chunk.offsets, s, side="right")) - 1
                zero = points[chunk.offsets[row]]
                counts[row, k] += 1
                texts[row].append(f"{labels[k]}:{points[s] - zero}:{points[e] - zero}")
                if k < len(KINDS):
                    base[row].append(texts[row][-1])
            yield pa.RecordBatch.from_arrays([
                chunk.column("id"), *[pa.array(counts[:, k]) for k in range(len(labels))],
                pa.array([hashlib.sha256(",".join(b).encode()).hexdigest() if b else empty for b in base], pa.string()),
                pa.array([",".join(t) for t in texts], pa.string())], names=names)

    schema = f"id {kind}, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"
    return docs.select(F.col(id_col).alias("id"), "text").mapInArrow(run, schema).withColumnRenamed("id", id_col)


def mask_secrets(docs: DataFrame, cuts: np.ndarray, length_col: str | None = None) -> DataFrame:
    """``docs`` with every span replaced by a mark, and ``length_col`` by the new length in code
    points where the text changed; the same columns."""
    def run(batches):
        for chunk in text_chunks(batches):
            out = chunk.batch.slice(chunk.first, len(chunk))
            pieces: dict[int, list[bytes]] = {}
            reach: dict[int, int] = {}
            for s, _, e in all_spans(chunk, cuts):
                row = int(np.searchsorted(chunk.offsets, s, side="right")) - 1
                if s >= reach.get(row, -1):
                    pieces.setdefault(row, []).append(chunk.data[max(reach.get(row, 0), int(chunk.offsets[row])):s].tobytes() + MASK.encode())
                reach[row] = max(reach.get(row, 0), e)
            if pieces:
                new = {row: (b"".join(p) + chunk.data[reach[row]:chunk.offsets[row + 1]].tobytes()).decode() for row, p in pieces.items()}
                old = chunk.column("text").to_pylist()
                for name, values in (("text", [new.get(i, t) for i, t in enumerate(old)]), (length_col, None)):
                    if name is None:
                        continue
                    at = out.schema.names.index(name)
                    if values is None:
                        values = [len(new[i]) if i in new else v for i, v in enumerate(out.column(at).to_pylist())]
                    out = out.set_column(at, out.schema.field(at), pa.array(values, out.schema.field(at).type))
            yield out

    return docs.mapInArrow(run, docs.schema)
