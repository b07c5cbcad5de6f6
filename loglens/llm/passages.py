"""Fuzzy shared passages by collinear chaining of k-mer seeds.

1. Scan: of every WINDOW consecutive word K-mers of a text the least-hashed is a seed.
2. Every seed, at all its places, joins its first place in the first document (smallest id)
   that holds it: one anchor a place, however many documents share a passage; grouped
   minima, pre-aggregated.
   That holder may have less of a passage than a later one has. So every MIN_WORDS words in
   a row whose seeds are all held elsewhere, unless the seeds' links (hashes of the words up
   to the next seed) show that one first holder has them all, are keyed as a whole and
   anchored to their own first holder: exact passages are found whoever holds their seeds.
   Seeds that lie in MIN_WORDS words but in different first holders, or apart in one, are
   keyed by twos as well and anchored to the first holder of both, edits between them or not:
   so fuzzy passages are found whoever holds their seeds. A document has one row for each two,
   with the places of either seed.
   What such windows and twos alone give counts as the passage of an earlier holder, with a few
   words alike beside it by chance, if fewer than K of its words are in no other passage.
3. Anchors of a pair of documents on one diagonal are merged; the fragments are chained
   in order in both documents, a gap costing GAP_COST a word on either side. The best
   predecessor is a prefix maximum in a Fenwick tree over the ends in the other document.
4. The words of each chain's stretches, EDGE words more on both sides, are joined to the
   chain and aligned: gaps between fragments by longest common subsequence, ends outwards
   until mismatches outweigh matches. Passages of MIN_WORDS words with MIN_IDENTITY of
   them matched are returned. A chain that falls short is cut into its runs of K and more
   equal words; every range of them that is a passage and lies in no longer one is returned.

A passage that many documents share is found in each as shared with the first one; the
documents meet there, so no pairs within the group are made. A passage without MIN_WORDS
unchanged words in a row can be missed if every two of its seeds, too, have other first holders.

Edge cases: null and wordless texts have no seeds; texts shorter than a window have one seed
if they have K words; a passage that a text repeats is found at each place, and of the places
in the earlier document at the first; repeated rows are documents of their own; ids that
repeat or are null are numbered apart; other columns are not touched.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (ALNUM_WORDS, _MULT, Chunk, RollingHash, find_words, give_back, gram_hashes, list_array, list_parts, mix, numbers,
                     segment_sums, text_chunks, with_row_ids, written)

K = 6
WINDOW = 12
GAP_COST = 0.05
EDGE = 48
MIN_WORDS = 50
MIN_IDENTITY = 0.8
#: Stretch bounds are rounded outwards to this many words, so that documents that share a
#: passage ask its first document for the same stretch; stretches that begin within BLOCK
#: roundings are asked for together.
ROUND, BLOCK = 32, 512
#: Seeds of whole documents that a task pairs at a time.
PLACES = 1 << 14

_U = np.uint64
_NEVER = _U(0xFFFFFFFFFFFFFFFF)


def seeds(chunk: Chunk, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, word position) of the seeds of each row, by row, hash and position."""
    return linked_seeds(chunk, k, window)[:3]


def linked_seeds(chunk: Chunk, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``seeds``, with the words up to the row's next seed (0: none) and their hash."""
    w = find_words(chunk, ALNUM_WORDS)
    grams = gram_hashes(w.hashes, k)
    at = np.arange(len(grams))
    last = w.offsets[1:][w.doc[:len(grams)]]
    whole = at + k <= last
    low = np.where(whole, (grams & _U(0xFFFFFFFF00000000)) | at.astype(_U), _NEVER)
    n_grams = np.maximum(np.diff(w.offsets) - k + 1, 0)
    picked = []
    least, width = low, 1
    while width < window:
        step = min(width, window - width)
        least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
        width += step
    inside = np.arange(len(least)) + window + k - 1 <= last[:len(least)]
    picked.append(least[inside])
    short = np.flatnonzero((n_grams > 0) & (n_grams < window))
    if len(short):
        bounds = np.stack([w.offsets[short], w.offsets[short] + n_grams[short]], axis=1).reshape(-1)
        padded = np.append(low, _NEVER)
        picked.append(np.minimum.reduceat(padded, bounds)[::2])
    position = np.unique(np.concatenate(picked) & _U(0xFFFFFFFF)).astype(np.int64)
    row = w.doc[position] if len(position) else position
    step = np.zeros(len(position), np.int64)
    step[:-1] = np.where(row[1:] == row[:-1], np.diff(position), 0)
    link = RollingHash(np.arange(len(w.hashes)), w.hashes).ranges(position, position + step)
    order = np.lexsort((position, grams[position], row))
    row, code, position = row[order], grams[position][order], position[order]
    return row, code, position - w.offsets[:-1][row], step[order], link[order]


def _keyed(rid: np.ndarray, row: np.ndarray, code: np.ndarray, position: np.ndarray) -> pa.RecordBatch:
    """Rows (h, rid, pos, first), given by row, hash and position; ``first`` marks a hash's first place in its row."""
    first = np.ones(len(row), dtype=bool)
    first[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
    return pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(rid[row]), pa.array(position), pa.array(first)],
                                      names=["h", "rid", "pos", "first"])


def _seed_rows(batches):
    for chunk in text_chunks(batches):
        row, code, position, step, link = linked_seeds(chunk)
        out = _keyed(numbers(chunk.column("rid")), row, code, position)
        yield out.append_column("step", pa.array(step)).append_column("link", pa.array(link.astype(np.int64)))


def _first_places(rows: DataFrame, *more: str) -> DataFrame:
    """(h, rep, rep_pos and ``more`` of that row): the first place of each hash that several documents hold;
    ``rows`` have one place a document."""
    return rows.groupBy("h").agg(F.min("rid").alias("rep"), F.max("rid").alias("last"), *[F.min_by(c, "rid").alias("rep_" + c) for c in ("pos", *more)]) \
        .filter("rep <> last").drop("last")


# ------------------------------------------------------------------ whole windows
def open_windows(doc: np.ndarray, pos: np.ndarray, rep: np.ndarray, rep_pos: np.ndarray, joined: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, first, end) of the starts of windows of ``length`` words whose seeds are all shared
    but not known to lie, as a whole, at one place of a first holder. Seeds are given by doc and
    position; ``joined``: the words to the next seed if they are as in the first holder, else 0."""
    if not len(pos):
        return doc, pos, pos
    near = (doc[1:] == doc[:-1]) & (np.diff(pos) <= WINDOW)
    heads = np.flatnonzero(np.concatenate(([True], ~near)))
    tails = np.append(heads[1:], len(pos)) - 1
    low, high = np.maximum(pos[heads] - WINDOW + 1, 0), pos[tails] + K + WINDOW - length
    run = np.cumsum(np.concatenate(([True], ~near))) - 1
    same = near & (joined[:-1] == np.diff(pos)) & (rep[1:] == rep[:-1]) & (np.diff(rep_pos) == np.diff(pos))
    at = np.flatnonzero(np.concatenate(([True], ~same)))
    to = np.append(at[1:], len(pos)) - 1
    known = pos[to] + K - length >= pos[at]
    at, to = at[known], to[known]
    # what is left of each run between the known windows: both sides sort alike
    first, own = np.concatenate((low, pos[to] + K - length + 1)), np.concatenate((np.arange(len(heads)), run[at]))
    end = np.concatenate((high, pos[at]))
    o, c = np.lexsort((first, own)), np.lexsort((end, own))
    first, end, own = first[o], end[c], own[o]
    keep = first < end
    return doc[heads[own[keep]]], first[keep], end[keep]


_SPANS = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))


def _open_rows(length: int):
    """Rows (rid, places) to rows (rid, wanted): the starts of open windows."""
    def run(batches):
        for batch in batches:
            rid, (off, places) = numbers(batch.column(0)), list_parts(batch.column(1))
            pos, rep, rep_pos, joined = (numbers(places.field(i)) for i in range(4))
            doc = np.repeat(np.arange(len(rid)), np.diff(off))
            o = np.lexsort((pos, doc))
            doc, first, end = open_windows(doc, pos[o], rep[o], rep_pos[o], joined[o], length)
            rows = np.unique(doc)
            bounds = np.append(np.searchsorted(doc, rows), len(doc))
            spans = pa.StructArray.from_arrays([pa.array(first), pa.array(end)], fields=list(_SPANS.value_type))
            yield pa.RecordBatch.from_arrays([pa.array(rid[rows]), list_array(bounds, spans)], names=["rid", "wanted"])

    return run


def _window_rows(length: int):
    """Rows (rid, text, wanted): the hashes of the windows that start at wanted places."""
    def run(batches):
        for chunk in text_chunks(batches):
            w = find_words(chunk, ALNUM_WORDS)
            codes = RollingHash(np.arange(len(w.hashes)), w.hashes).windows(length)
            off, wanted = list_parts(chunk.column("wanted"))
            row = np.repeat(np.arange(len(chunk)), np.diff(off))
            s, e = numbers(wanted.field(0)), numbers(wanted.field(1))
            n = np.maximum(np.minimum(e, np.diff(w.offsets)[row] - length + 1) - s, 0)
            row, position = np.repeat(row, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(s, n)
            code = codes[w.offsets[row] + position]
            o = np.lexsort((position, code, row))
            yield _keyed(numbers(chunk.column("rid")), row[o], code[o], position[o])

    return run


# ------------------------------------------------------------------ seeds by twos
def apart_seeds(doc: np.ndarray, pos: np.ndarray, rep: np.ndarray, rep_pos: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Every two seeds (first, second) of a document within ``length`` words that have different
    first holders or lie there more than WINDOW words farther apart or nearer. Seeds are given by
    doc and position."""
    found, i, d = [np.empty((2, 0), np.int64)], np.arange(len(pos) - 1), 1
    while len(i):
        j = i + d
        i = i[(doc[j] == doc[i]) & (pos[j] - pos[i] + K <= length)]
        j = i + d
        apart = (rep[j] != rep[i]) | (np.abs(rep_pos[j] - rep_pos[i] - pos[j] + pos[i]) > WINDOW)
        found.append(np.stack((i[apart], j[apart])))
        d += 1
        i = i[i + d < len(pos)]
    first, second = np.concatenate(found, axis=1)
    return first, second


def _places_of(group: np.ndarray, pos: np.ndarray, n: int) -> pa.Array:
    """The distinct places of each of ``n`` groups."""
    both = np.unique((group << 32) | pos)
    return list_array(np.searchsorted(both >> 32, np.arange(n + 1)), pa.array((both & 0xFFFFFFFF).astype(np.int32)))


def _pair_rows(length: int, once: bool):
    """Rows (rid, places) to seeds by twos, one row for each two of a document: (h, rid, firsts, seconds), the
    places of either seed; with ``once``, (h, rid, pos, gap) of one place, ``gap`` words apart. A text that
    repeats its lines has most of its twos many times."""
    def run(batches):
        for batch in batches:
            rid, (off, places) = numbers(batch.column(0)), list_parts(batch.column(1))
            at = 0
            while at < len(rid):    # whole documents, about PLACES of their seeds at a time
                to = max(at + 1, int(np.searchsorted(off, off[at] + PLACES, side="right")) - 1)
                part = places.slice(off[at], off[to] - off[at])
                pos, rep, rep_pos = (numbers(part.field(i)) for i in range(3))
                doc = np.repeat(np.arange(at, to), np.diff(off[at:to + 1]))
                o = np.lexsort((pos, doc))
                doc, pos, rep, rep_pos = doc[o], pos[o], rep[o], rep_pos[o]
                seed = gram_hashes(np.stack((rep, rep_pos), axis=1).reshape(-1).astype(_U), 2)[::2]
                i, j = apart_seeds(doc, pos, rep, rep_pos, length)
                code = mix(seed[i] * _U(3) + seed[j])
                two = mix(code + doc[i].astype(_U) * _U(_MULT))
                if once:
                    o = np.unique(two, return_index=True)[1]
                    row, more = i[o], {"pos": pa.array(pos[i[o]]), "gap": pa.array(pos[j[o]] - pos[i[o]])}
                    code = code[o]
                else:
                    found, group = np.unique(two, return_inverse=True)
                    row, each = np.empty((2, len(found)), np.int64)
                    row[group], each[group] = i, np.arange(len(i))
                    code = code[each]
                    more = {"firsts": _places_of(group, pos[i], len(found)), "seconds": _places_of(group, pos[j], len(found))}
                yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(rid[doc[row]]), *more.values()], names=["h", "rid", *more])
                at = to
            give_back()

    return run


# ------------------------------------------------------------------ chaining
class PrefixMaximum:
    """Fenwick tree: the best (value, item) among places up to a given one."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(-np.inf, -1)] * (n + 1)

    def put(self, place: int, value: float, item: int) -> None:
        i = place + 1
        while i < len(self.best):
            if value > self.best[i][0]:
                self.best[i] = (value, item)
            i += i & -i

    def get(self, place: int) -> tuple[float, int]:
        """Best of the places 0 to ``place`` - 1."""
        out, i = (-np.inf, -1), place
        while i > 0:
            if self.best[i][0] > out[0]:
                out = self.best[i]
            i -= i & -i
        return out


def fragments(a: np.ndarray, b: np.ndarray, n: np.ndarray | int = K, reach: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """Anchors of ``n`` words on one diagonal at most ``reach`` words apart as fragments (a start, a end, b start, words covered)."""
    order = np.lexsort((a, b - a))
    n = np.broadcast_to(n, a.shape)[order]
    a, d = a[order], (b - a)[order]
    turn = np.concatenate(([True], d[1:] != d[:-1]))
    lift = np.cumsum(turn) * (int((a + n).max()) + 1)      # keeps the diagonals' ends apart
    until = np.maximum.accumulate(a + n + lift) - lift
    new = turn.copy()
    new[1:] |= a[1:] - until[:-1] > reach
    heads = np.flatnonzero(new)
    covered = n.copy()
    covered[1:] = np.where(new[1:], n[1:], np.maximum(a[1:] + n[1:] - np.maximum(a[1:], until[:-1]), 0))
    return sorted(zip(a[heads].tolist(), until[np.append(heads[1:], len(a)) - 1].tolist(), (a[heads] + d[heads]).tolist(), np.add.reduceat(covered, heads).tolist()))


def chain(parts: list[tuple[int, int, int, int]], cost: float = GAP_COST) -> list[list[tuple[int, int, int, int]]]:
    """Best chains first; each fragment (a start, a end, b start, weight) is in one chain at most."""
    ends = [s + e - a for a, e, s, _ in parts]
    places = {v: i for i, v in enumerate(sorted(set(ends)))}
    keys = np.array(sorted(places))
    tree = PrefixMaximum(len(places))
    waiting = sorted(range(len(parts)), key=lambda i: parts[i][1])
    score, back, w = [0.0] * len(parts), [-1] * len(parts), 0
    for i in sorted(range(len(parts)), key=lambda i: parts[i]):
        a, _, b, weight = parts[i]
        while w < len(waiting) and parts[waiting[w]][1] <= a:
            j = waiting[w]
            tree.put(places[ends[j]], score[j] + cost * (parts[j][1] + ends[j]), j)
            w += 1
        value, j = tree.get(int(np.searchsorted(keys, b, side="right")))
        value -= cost * (a + b)
        score[i], back[i] = (weight + value, j) if value > 0 else (weight, -1)
    used, out = [False] * len(parts), []
    for i in sorted(range(len(parts)), key=lambda i: (-score[i], parts[i])):
        found = []
        while i >= 0 and not used[i]:
            used[i] = True
            found.append(parts[i])
            i = back[i]
        if found:
            out.append(found[::-1])
    return out


_PIECES = pa.list_(pa.int64())
_CHAINS = pa.schema([("rid", pa.int64()), ("rep", pa.int64()), ("a0", pa.int64()), ("a1", pa.int64()), ("b0", pa.int64()), ("b1", pa.int64()), ("pieces", _PIECES), ("late", pa.bool_())])


def _chains(min_words: int, length: int):
    """Rows (rid, places of seeds, places of windows of ``length`` words, places of seeds by twos): chains of
    each pair that may grow to a passage; pieces are (a start, a end, b start), ``late`` those without two first places."""
    slack = 2 * (WINDOW + K)

    def run(batches):
        for batch in batches:
            rid = numbers(batch.column(0))
            sides = [(size, *list_parts(batch.column(c))) for c, size in ((1, K), (2, length), (3, K))]
            doc = np.concatenate([np.repeat(np.arange(len(rid)), np.diff(off)) for _, off, _ in sides])
            a, rep, b = (np.concatenate([numbers(places.field(i)) for _, _, places in sides]) for i in range(3))
            n = np.concatenate([np.full(len(places), size) for size, _, places in sides])
            own = np.arange(len(n)) < len(sides[0][2])
            # a seed is not anchored again in its own first holder
            at, last = np.flatnonzero(own), np.arange(len(n)) >= len(n) - len(sides[2][2])
            place = (doc << 40) | a
            by_place = at[np.argsort(place[at])]
            held = rep[by_place[np.searchsorted(place[by_place], place[last])]]
            again = np.zeros(len(n), dtype=bool)
            again[last] = rep[last] == held
            o = np.lexsort((rep, doc))
            o = o[(rep[o] != rid[doc[o]]) & ~again[o]]
            doc, a, rep, b, n, own = doc[o], a[o], rep[o], b[o], n[o], own[o]
            out: list[list] = [[] for _ in _CHAINS]
            if len(doc):
                heads = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (rep[1:] != rep[:-1]))))
                ends = np.append(heads[1:], len(doc))
                span = np.maximum.reduceat(a + n, heads) - np.minimum.reduceat(a, heads)
                good = ((ends - heads > 1) & (span - K + slack >= min_words)) | (np.maximum.reduceat(n, heads) > K)
                for i, j in zip(heads[good].tolist(), ends[good].tolist()):
                    for parts in chain(fragments(a[i:j], b[i:j], n[i:j])):
                        a0, a1, b0, b1 = parts[0][0], parts[-1][1], parts[0][2], parts[-1][2] + parts[-1][1] - parts[-1][0]
                        late = int((own[i:j] & (a[i:j] >= a0) & (a[i:j] < a1)).sum()) < 2
                        if min(a1 - a0, b1 - b0) + slack >= min_words and sum(p[3] for p in parts) > K:
                            for values, v in zip(out, (rid[doc[i]], rep[i], a0, a1, b0, b1, [x for p in parts for x in p[:3]], late)):
                                values.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, _CHAINS)], schema=_CHAINS)

    return run


# ------------------------------------------------------------------ alignment
def common_words(x: list[int], y: list[int]) -> int:
    """Length of the longest common subsequence, a bit a word of ``x``."""
    if not x or not y:
        return 0
    masks: dict[int, int] = {}
    for i, v in enumerate(x):
        masks[v] = masks.get(v, 0) | 1 << i
    full = (1 << len(x)) - 1
    row = full
    for v in y:
        u = row & masks.get(v, 0)
        row = ((row + u) | (row - u)) & full
    return len(x) - row.bit_count()


def grow(x: np.ndarray, y: np.ndarray, drop: float = 8.0) -> tuple[int, int]:
    """Words to take on, and those of them that match, walking both sequences from their start
    until the score (match 1, mismatch -2) falls ``drop`` below its best."""
    whole = min(len(x), len(y))
    n = min(whole, 256)
    if not n:
        return 0, 0
    while True:
        same = x[:n] == y[:n]
        score = np.cumsum(np.where(same, 1, -2))
        top = np.maximum(np.maximum.accumulate(score), 0)
        end = np.flatnonzero(top - score > drop)
        if len(end) or n == whole:
            break
        n = min(whole, 4 * n)
    stop = int(end[0]) if len(end) else n
    if not stop or score[:stop].max() <= 0:
        return 0, 0
    take = int(np.argmax(score[:stop])) + 1
    return take, int(same[:take].sum())


def grow_all(x: np.ndarray, y: np.ndarray, at: np.ndarray, to: np.ndarray, n: np.ndarray, step: int, drop: float = 8.0) -> tuple[np.ndarray, np.ndarray]:
    """As ``grow``, for many walks at once: walk i goes over ``n[i]`` words of ``x`` from ``at[i]`` and of ``y`` from
    ``to[i]`` on, forwards or (``step`` -1) backwards."""
    take, same = np.zeros((2, len(n)), np.int64)
    for i in np.flatnonzero(n > 256).tolist():
        take[i], same[i] = grow(*(v[p + step * np.arange(n[i])] for v, p in ((x, at[i]), (y, to[i]))), drop)
    walks = np.flatnonzero((n > 0) & (n <= 256))
    for k in range(0, len(walks), 1000):
        w = walks[k:k + 1000]
        m = n[w][:, None]
        place = np.arange(m.max() + 1)[None, :]
        inside = step * np.minimum(place, m - 1)        # one column more, at which every walk ends
        score = np.cumsum(np.where(place < m, np.where(x[at[w][:, None] + inside] == y[to[w][:, None] + inside], 1, -2), -1000), axis=1, dtype=np.int32)
        top = np.maximum(np.maximum.accumulate(score, axis=1), 0)
        stop = np.argmax(top - score > drop, axis=1)
        score[place >= stop[:, None]] = -1000
        last = np.argmax(score, axis=1)
        best = score[np.arange(len(w)), last]
        good = best > 0
        take[w[good]], same[w[good]] = last[good] + 1, (best + 2 * (last + 1))[good] // 3
    return take, same


def align(x: np.ndarray, x_off: np.ndarray, y: np.ndarray, y_off: np.ndarray, xs: np.ndarray, ys: np.ndarray, pieces: np.ndarray, p_off: np.ndarray) -> np.ndarray:
    """Ends of each chain's passage in both documents and the words matched (five rows). Chain i has the words
    ``x[x_off[i]:x_off[i + 1]]`` and ``y[y_off[i]:y_off[i + 1]]``, from positions ``xs[i]`` and ``ys[i]`` on; its
    pieces ``pieces[p_off[i]:p_off[i + 1]]`` are (a start, a end, b start)."""
    x0, y0 = x_off[:-1] - xs, y_off[:-1] - ys       # where position 0 would be
    own = np.repeat(np.arange(len(xs)), np.diff(p_off))
    s, e, t = pieces.T
    u = t + e - s
    first, last = p_off[:-1], p_off[1:] - 1
    a0, a1, b0, b1 = s[first], e[last], t[first], u[last]
    left, matched = grow_all(x, y, x0 + a0 - 1, y0 + b0 - 1, np.minimum(a0 - xs, b0 - ys), -1)
    right, same = grow_all(x, y, x0 + a1, y0 + b1, np.minimum(x_off[1:] - x0 - a1, y_off[1:] - y0 - b1), 1)
    matched += same
    off = np.concatenate(([0], np.cumsum(e - s)))
    place = np.arange(off[-1]) - np.repeat(off[:-1], e - s)
    equal = x[np.repeat(x0[own] + s, e - s) + place] == y[np.repeat(y0[own] + t, e - s) + place]
    matched += segment_sums(equal, off[p_off])
    gap = np.flatnonzero((own[1:] == own[:-1]) & (s[1:] > e[:-1]) & (t[1:] > u[:-1]))
    for k in gap.tolist():
        i = own[k]
        matched[i] += common_words(x[x0[i] + e[k]:x0[i] + s[k + 1]].tolist(), y[y0[i] + u[k]:y0[i] + t[k + 1]].tolist())
    return np.stack((a0 - left, a1 + right, b0 - left, b1 + right, matched))


def equal_runs(x: np.ndarray, y: np.ndarray, x0: int, y0: int, pieces: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs of K and more equal words on the pieces' diagonals, as pieces."""
    out = []
    for s, e, t in pieces:
        same = np.concatenate(([False], x[s - x0:e - x0] == y[t - y0:t - y0 + e - s], [False]))
        edges = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
        out += [(s + i, s + j, t + i) for i, j in edges.tolist() if j - i >= K]
    return out


def split(x: np.ndarray, y: np.ndarray, x0: int, y0: int, pieces: list[tuple[int, int, int]], min_words: int, min_identity: float) -> list[tuple[int, int, int, int, int]]:
    """As ``align``, for every range of the chain's equal runs that is a passage and lies in no longer one."""
    runs = equal_runs(x, y, x0, y0, pieces)
    if not runs:
        return []
    s, e, t = np.array(runs).T
    u = t + e - s
    gaps = [common_words(x[a - x0:b - x0].tolist(), y[c - y0:d - y0].tolist()) for a, b, c, d in zip(e, s[1:], u, t[1:])]
    until = np.cumsum(e - s) + np.concatenate(([0], np.cumsum(gaps))).astype(np.int64)
    before = until - (e - s)
    left, same_left = np.array([grow(x[:a - x0][::-1], y[:b - y0][::-1]) for a, b in zip(s, t)]).T
    right, same_right = np.array([grow(x[a - x0:], y[b - y0:]) for a, b in zip(e, u)]).T
    a0, a1, b0, b1 = s - left, e + right, t - left, u + right
    out: list[tuple[int, int, int, int, int]] = []
    last = -1
    for i in range(len(runs)):
        c = slice(max(last + 1, i), None)
        n, m = a1[c] - a0[i], b1[c] - b0[i]
        matched = until[c] + same_right[c] - before[i] + same_left[i]
        good = np.flatnonzero((np.minimum(n, m) >= min_words) & (matched / np.maximum(n, m) >= min_identity))
        if not len(good):
            continue
        j = int(good[-1])
        last = c.start + j
        found = (int(a0[i]), int(a1[last]), int(b0[i]), int(b1[last]), int(matched[j]))
        inside = lambda p, q: q[0] <= p[0] and p[1] <= q[1] and q[2] <= p[2] and p[3] <= q[3]
        while out and inside(out[-1], found):   # ends grown over the next run
            out.pop()
        if not (out and inside(found, out[-1])):
            out.append(found)
    return out


_PASSAGES = pa.schema([("rid", pa.int64()), ("rep", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("rep_start", pa.int64()),
                       ("rep_end", pa.int64()), ("n_words", pa.int64()), ("n_matched", pa.int64()), ("identity", pa.float64()), ("late", pa.bool_())])


def _align(min_words: int, min_identity: float):
    """Rows (rid, rep, xs, ys, pieces, x, y, late): passages."""
    def run(batches):
        for batch in batches:
            rid, rep, xs, ys = (numbers(batch.column(c)) for c in range(4))
            (p_off, p), (x_off, x), (y_off, y) = (list_parts(batch.column(c)) for c in (4, 5, 6))
            p, x, y = (numbers(v) for v in (p, x, y))
            p, p_off = p.reshape(-1, 3), p_off // 3
            late = numbers(batch.column(7), bool)
            spans = align(x, x_off, y, y_off, xs, ys, p, p_off)
            a0, a1, b0, b1, matched = spans
            good = (np.minimum(a1 - a0, b1 - b0) >= min_words) & (matched / np.maximum(a1 - a0, b1 - b0) >= min_identity)
            row, found = np.flatnonzero(good), [spans[:, good]]
            for i in np.flatnonzero(~good).tolist():
                more = split(x[x_off[i]:x_off[i + 1]], y[y_off[i]:y_off[i + 1]], int(xs[i]), int(ys[i]), p[p_off[i]:p_off[i + 1]].tolist(), min_words, min_identity)
                if more:
                    row = np.concatenate((row, np.full(len(more), i)))
                    found.append(np.array(more, np.int64).T)
            o = np.argsort(row, kind="stable")
            row, (a0, a1, b0, b1, matched) = row[o], np.concatenate(found, axis=1)[:, o]
            out = (rid[row], rep[row], a0, a1, b0, b1, a1 - a0, matched, matched / np.maximum(a1 - a0, b1 - b0), late[row])
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, _PASSAGES)], schema=_PASSAGES)

    return run


def _own_passages(batches):
    """Rows (rid, found): passages without the late ones that have fewer than K words outside the others'."""
    for batch in batches:
        rid, (off, found) = numbers(batch.column(0)), list_parts(batch.column(1))
        rep, start, end, late = (numbers(found.field(i)) for i in (0, 1, 2, 8))
        keep = late == 0
        for i in np.flatnonzero(np.add.reduceat(late, off[:-1]) if len(rid) else []).tolist():
            here = np.arange(off[i], off[i + 1])
            inside = np.zeros(int(end[here].max()), dtype=bool)
            for j in here[keep[here]]:
                inside[start[j]:end[j]] = True
            for j in sorted(here[~keep[here]].tolist(), key=lambda j: (rep[j], start[j], end[j])):
                if np.count_nonzero(~inside[start[j]:end[j]]) >= K:
                    keep[j] = inside[start[j]:end[j]] = True
        rows = pa.array(np.flatnonzero(keep))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rid, np.diff(off))[keep]), *[found.field(i).take(rows) for i in range(8)]], names=_PASSAGES.names[:-1])


def _stretches(batches):
    """Rows (rid, text, wanted): the word hashes of each wanted stretch (s, e)."""
    schema = pa.schema([("doc", pa.int64()), ("s", pa.int64()), ("e", pa.int64()), ("words", pa.list_(pa.int64()))])
    for chunk in text_chunks(batches):
        w = find_words(chunk, ALNUM_WORDS)
        off, wanted = list_parts(chunk.column("wanted"))
        row = np.repeat(np.arange(len(chunk)), np.diff(off))
        s, e = numbers(wanted.field(0)), numbers(wanted.field(1))
        rid = numbers(chunk.column("rid"))[row]
        begin, end = w.offsets[row] + np.maximum(s, 0), np.minimum(w.offsets[row] + e, w.offsets[row + 1])
        n = np.maximum(end - begin, 0)
        for i in range(0, len(row), 2000):
            c = slice(i, i + 2000)
            o = np.concatenate(([0], np.cumsum(n[c])))
            flat = w.hashes[np.arange(o[-1]) - np.repeat(o[:-1], n[c]) + np.repeat(begin[c], n[c])]
            yield pa.RecordBatch.from_arrays([pa.array(rid[c]), pa.array(s[c]), pa.array(e[c]), list_array(o, pa.array(flat.astype(np.int64)))], schema=schema)


def shared_passages(docs: DataFrame, id_col: str = "doc_id", min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY) -> DataFrame:
    """Passages (word ranges, end exclusive) that a document shares with an earlier one: ``id_col``, start,
    end, other (the earlier document's id), other_start, other_end, n_words, n_matched, identity."""
    named = with_row_ids(docs.select(F.col(id_col).alias("id"), "text"), "id", "rid")
    texts = named.select("rid", "text")
    rows = texts.mapInArrow(_seed_rows, "h long, rid long, pos long, first boolean, step long, link long")
    shared = rows.drop("first").join(_first_places(rows.filter("first"), "link"), "h") \
        .select("rid", F.struct("pos", "rep", "rep_pos", F.when(F.col("link") == F.col("rep_link"), F.col("step")).otherwise(0).alias("joined")).alias("place"))
    by_doc = written(shared.groupBy("rid").agg(F.collect_list("place").alias("places")), "places")
    length = max(min_words, K + WINDOW - 1)
    wanted = by_doc.mapInArrow(_open_rows(length), "rid long, wanted array<struct<s: long, e: long>>")
    windows = written(texts.join(wanted.hint("shuffle_hash"), "rid").select("rid", "text", "wanted")
                      .mapInArrow(_window_rows(length), "h long, rid long, pos long, first boolean"), "windows")
    whole = windows.drop("first").join(_first_places(windows.filter("first")), "h").filter("rid <> rep") \
        .groupBy("rid").agg(F.collect_list(F.struct("pos", "rep", "rep_pos")).alias("whole"))
    pairs = by_doc.mapInArrow(_pair_rows(min_words, False), "h long, rid long, firsts array<int>, seconds array<int>")
    once = by_doc.mapInArrow(_pair_rows(min_words, True), "h long, rid long, pos long, gap long")
    ends = [F.struct(F.col(c).alias("at"), at.alias("rep_pos")) for c, at in (("firsts", F.col("rep_pos")), ("seconds", F.col("rep_pos") + F.col("rep_gap")))]
    paired = pairs.join(_first_places(once, "gap"), "h").filter("rid <> rep") \
        .select("rid", "rep", F.inline(F.array(*ends))).select("rid", "rep", "rep_pos", F.explode("at").alias("pos")) \
        .groupBy("rid").agg(F.collect_set(F.struct(F.col("pos").cast("long").alias("pos"), "rep", "rep_pos")).alias("paired"))
    none = F.array().cast("array<struct<pos: long, rep: long, rep_pos: long>>")
    anchors = by_doc.join(whole, "rid", "left").join(paired, "rid", "left").select("rid", "places", F.coalesce("whole", none), F.coalesce("paired", none))
    chains = written(anchors.mapInArrow(_chains(min_words, length), "rid long, rep long, a0 long, a1 long, b0 long, b1 long, pieces array<long>, late boolean"), "chains")
    down = lambda c: (F.greatest(F.floor((F.col(c) - EDGE) / ROUND), F.lit(0)) * ROUND).cast("long")
    up = lambda c: (F.ceil((F.col(c) + EDGE) / ROUND) * ROUND).cast("long")
    chains = chains.select("rid", "rep", "pieces", "late", down("a0").alias("xs"), up("a1").alias("xe"), down("b0").alias("ys"), up("b1").alias("ye"))
    wanted = chains.select("rid", F.col("xs").alias("s"), F.col("xe").alias("e")).unionByName(
        chains.select(F.col("rep").alias("rid"), F.col("ys").alias("s"), F.col("ye").alias("e"))).distinct()
    # a document that many others share passages with is asked for few stretches, as their
    # bounds are rounded; they are its own length over ROUND, squared, at most
    grouped = wanted.groupBy("rid", F.floor(F.col("s") / (BLOCK * ROUND)).alias("block")).agg(F.collect_list(F.struct("s", "e")).alias("wanted"))
    words = written(texts.join(grouped.hint("shuffle_hash"), "rid").select("rid", "text", "wanted").mapInArrow(_stretches, "doc long, s long, e long, words array<long>"), "stretches")
    side = lambda doc, s, e, name: words.select(F.col("doc").alias(doc), F.col("s").alias(s), F.col("e").alias(e), F.col("words").alias(name))
    both = chains.join(side("rid", "xs", "xe", "x"), ["rid", "xs", "xe"]).join(side("rep", "ys", "ye", "y"), ["rep", "ys", "ye"])
    columns = "rep long, start long, end long, rep_start long, rep_end long, n_words long, n_matched long, identity double"
    found = both.select("rid", "rep", "xs", "ys", "pieces", "x", "y", "late").mapInArrow(_align(min_words, min_identity), f"rid long, {columns}, late boolean")
    found = found.groupBy("rid").agg(F.collect_list(F.struct(*_PASSAGES.names[1:-1], F.col("late").cast("long").alias("late"))).alias("found")) \
        .mapInArrow(_own_passages, f"rid long, {columns}")
    ids = named.select("rid", "id")
    out = found.join(ids, "rid").join(ids.select(F.col("rid").alias("rep"), F.col("id").alias("other")), "rep")
    return out.select(F.col("id").alias(id_col), "start", "end", "other", F.col("rep_start").alias("other_start"), F.col("rep_end").alias("other_end"),
                      "n_words", "n_matched", "identity")
