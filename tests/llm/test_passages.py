import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loglens.llm import passages as ps
from loglens.llm.common import text_chunks

VOCAB = [a + b + c for a in "bcdfglmnprst" for b in "aeiou" for c in ("", "n", "st", "rim", "lok")]


def prose(rng, n):
    return [rng.choice(VOCAB) for _ in range(n)]


def test_planted_passages_are_found(spark, schema):
    rng = random.Random(1)
    passage, fuzzy, short = prose(rng, 60), prose(rng, 120), prose(rng, 30)
    rows, want = [], set()
    for i in range(80):
        w = prose(rng, rng.randint(20, 300))
        if i % 4 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = passage
            want.add(i)
        if i % 8 == 1:
            p = list(fuzzy)
            for j in range(5, 120, 17):
                p[j] = "edit" + str(rng.randint(0, 10**6))
            del p[60 + i % 5]
            at = rng.randint(0, len(w))
            w[at:at] = p
            want.add(i)
        if i % 8 == 3:
            w += short
        rows.append((i, " ".join(w).capitalize() + ".", "en", "s", 1))
    rows += [(200 + i, rows[i][1].upper(), "en", "s", 1) for i in range(5, 8)] + [(300, None, None, None, None), (301, "", "", "", 0), (302, "a b", "", "", 3)]
    want |= {r[0] for r in rows if 200 <= r[0] < 300 and len(r[1].split()) >= 50} | {r[0] - 200 for r in rows if 200 <= r[0] < 300 and len(r[1].split()) >= 50}
    docs = spark.createDataFrame(rows, schema).withColumn("rid", F.lit("x")).withColumn("start", F.lit(1)).repartition(3)
    out = ps.shared_passages(docs).collect()
    assert {r.doc_id for r in out} | {r.other for r in out} == want
    texts = {r[0]: ["".join(c for c in x if c.isalnum()) for x in (r[1] or "").lower().split()] for r in rows}
    for r in out:
        assert r.other < r.doc_id and r.end - r.start == r.n_words >= 50 and r.identity >= 0.8
        x, y = texts[r.doc_id][r.start:r.end], texts[r.other][r.other_start:r.other_end]
        assert x[0] == y[0] and x[-1] == y[-1]
        if r.identity == 1:
            assert x == y
    exact = [r for r in out if r.doc_id % 4 == 0 and r.doc_id < 80]
    assert len(exact) == 19 and all(texts[r.doc_id][r.start:r.end][-60:] == passage or " ".join(passage) in " ".join(texts[r.doc_id][r.start:r.end]) for r in exact)


def test_chains_are_the_best(spark):
    rng = random.Random(6)
    for _ in range(60):
        parts = sorted({(a := rng.randint(0, 60), a + (n := rng.randint(3, 9)), rng.randint(0, 60), n) for _ in range(rng.randint(1, 14))})
        best = {}
        for i in sorted(range(len(parts)), key=lambda i: parts[i]):
            a, _, b, w = parts[i]
            best[i] = w + max([0.0] + [best[j] - 0.05 * (a - e + b - t) for j in best for (_, e, s, _) in [parts[j]] for t in [s + e - parts[j][0]] if e <= a and t <= b])
        got = ps.chain(parts)
        assert sorted(p for c in got for p in c) == parts
        c = got[0]
        score = sum(p[3] for p in c) - 0.05 * sum(q[0] - p[1] + q[2] - (p[2] + p[1] - p[0]) for p, q in zip(c, c[1:]))
        assert abs(score - max(best.values())) < 1e-9
        assert all(p[1] <= q[0] and p[2] + p[1] - p[0] <= q[2] for p, q in zip(c, c[1:]))


def test_common_words():
    rng = random.Random(2)
    for _ in range(100):
        x, y = ([rng.randint(0, 4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        d = np.zeros((len(x) + 1, len(y) + 1), int)
        for i in range(len(x)):
            for j in range(len(y)):
                d[i + 1, j + 1] = d[i, j] + 1 if x[i] == y[j] else max(d[i, j + 1], d[i + 1, j])
        assert ps.common_words(x, y) == d[-1, -1]


def test_every_window_has_a_seed():
    rng = random.Random(7)
    texts = [" ".join(rng.choice("ab") for _ in range(n)) for n in (0, 3, 6, 10, 17, 18, 80)] + [" ".join(prose(rng, 200))]
    chunk = next(text_chunks(iter([pa.record_batch({"text": pa.array(texts)})])))
    row, code, position = ps.seeds(chunk)
    mine = sorted(position[row == 7])
    assert mine[0] < ps.WINDOW and all(b - a <= ps.WINDOW for a, b in zip(mine, mine[1:])) and mine[-1] >= 200 - ps.K - ps.WINDOW
    assert set(row) == {2, 3, 4, 5, 6, 7}


def test_edges(spark, edge_docs, schema):
    assert ps.shared_passages(spark.createDataFrame([], schema)).count() == 0
    docs = spark.createDataFrame(edge_docs + edge_docs[:2] + [(None, edge_docs[0][1], None, None, 1)], schema)
    out = ps.shared_passages(docs).collect()
    assert all(r.n_words >= 50 and r.identity >= 0.8 for r in out) and any(r.doc_id is None for r in out) == (len(edge_docs[0][1].split()) >= 50)


def lost_words(rows, out, n=50):
    """Windows of ``n`` words that a text shares with an earlier one, by brute force, with a seed's words and more in no passage."""
    lost, seen = [], set()
    for i, text in sorted(rows):
        w = text.split()
        inside = {q for r in out if r.doc_id == i for q in range(r.start, r.end)}
        windows = [tuple(w[p:p + n]) for p in range(len(w) - n + 1)]
        lost += [(i, p) for p, g in enumerate(windows) if g in seen and len(set(range(p, p + n)) - inside) >= ps.K]
        seen.update(windows)
    return lost


def test_chains_over_unshared_words_are_cut(spark):
    rng = random.Random(11)
    header, footer, long = prose(rng, 60), prose(rng, 60), prose(rng, 300)
    rows = []
    for i, gap in enumerate((45, 100, 250, 430)):
        rows += [(10 * i, " ".join([f"h{i}" + w for w in header] + prose(rng, gap) + [f"f{i}" + w for w in footer])),
                 (10 * i + 1, " ".join([f"h{i}" + w for w in header] + prose(rng, gap) + [f"f{i}" + w for w in footer]))]
    rows += [(50, " ".join(long)), (51, " ".join(long[:140] + prose(rng, 150) + long[140:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = ps.shared_passages(docs).collect()
    assert not lost_words(rows, out)
    assert all(r.n_words >= 50 and r.identity >= 0.8 for r in out)


def test_cut_chains_against_all_ranges():
    rng = random.Random(12)
    for _ in range(40):
        x, y, pieces = [], [], []
        for _ in range(rng.randint(1, 9)):
            n, a, b = rng.randint(6, 60), rng.randint(0, 40), rng.randint(0, 40)
            x += [rng.randint(10**6, 10**9) for _ in range(a)]
            y += [-rng.randint(10**6, 10**9) for _ in range(b)]
            pieces.append((len(x), len(x) + n, len(y)))
            same = [rng.randint(0, 10**5) for _ in range(n)]
            x, y = x + same, y + same
        x, y = np.array(x), np.array(y)
        ok = {}
        for i in range(len(pieces)):
            for j in range(i, len(pieces)):
                a0, a1, b0, b1 = pieces[i][0], pieces[j][1], pieces[i][2], pieces[j][2] + pieces[j][1] - pieces[j][0]
                m = sum(e - s for s, e, _ in pieces[i:j + 1])
                if min(a1 - a0, b1 - b0) >= 50 and m / max(a1 - a0, b1 - b0) >= 0.8:
                    ok[i, j] = (a0, a1, b0, b1, m)
        want = [v for (i, j), v in sorted(ok.items()) if not any(k <= i and j <= h and (k, h) != (i, j) for k, h in ok)]
        if all(p[1] < q[0] and p[2] + p[1] - p[0] < q[2] for p, q in zip(pieces, pieces[1:])):
            assert ps.split(x, y, 0, 0, pieces, 50, 0.8) == want


def test_every_place_of_a_repeated_passage(spark):
    rng = random.Random(13)
    passage = prose(rng, 60)
    once = prose(rng, 80) + passage + prose(rng, 40)
    often = sum((prose(rng, 30) + passage for _ in range(4)), []) + prose(rng, 20)
    rows = [(1, " ".join(once)), (2, " ".join(often)), (3, " ".join(often[100:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = ps.shared_passages(docs).collect()
    assert not lost_words(rows, out)
    assert [r.other for r in out if r.doc_id == 2] == [1] * 4


def test_passages_whose_seeds_have_other_first_holders(spark):
    rng = random.Random(14)
    passages = [prose(rng, n) for n in (60, 50, 55, 75, 50, 50, 60, 200)]
    texts = []
    for i, p in enumerate(passages):      # parts of each passage first, then the whole of it twice
        half = len(p) // 2
        texts += [prose(rng, 10) + p[:half] + prose(rng, 10), prose(rng, 15) + p[half:] + prose(rng, 5)] if i % 2 else [prose(rng, 9) + p[6:-6] + prose(rng, 30)]
    for _ in range(2):
        texts += [prose(rng, 20) + p + prose(rng, 20) for p in passages]
    lines = [prose(rng, 14) for _ in range(6)]
    texts += [sum((rng.choice(lines) for _ in range(12)), []) for _ in range(25)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = ps.shared_passages(docs).collect()
    assert not lost_words(rows, out)
    assert all(r.other < r.doc_id and r.n_words >= 50 and r.identity >= 0.8 for r in out)


def test_fragments_of_unequal_anchors():
    assert ps.fragments(np.array([0, 10, 80, 5]), np.array([3, 13, 83, 50]), np.array([50, 6, 6, 6])) == [(0, 50, 3, 50), (5, 11, 50, 6), (80, 86, 83, 6)]
    assert ps.fragments(np.array([0, 4, 22]), np.array([0, 4, 22])) == [(0, 28, 0, 16)]


def test_fuzzy_passages_whose_seeds_have_other_first_holders(spark):
    """Parts of each passage come first, each in a document of its own, then the passage twice,
    with other words changed each time, none of them with 50 unchanged words in a row."""
    rng = random.Random(23)
    passages = [prose(rng, n) for n in (60, 64, 72, 80, 96, 120)]
    texts = []
    for i, p in enumerate(passages):
        step = len(p) // (2 + i % 2)
        texts += [prose(rng, 12) + p[s:s + step] + prose(rng, 9) for s in range(0, len(p), step)]
    whole = len(texts)
    for turn in (18, 36):
        for p in passages:
            w = list(p)
            for j in range(turn, len(w) - 6, 36):
                w[j] = f"edit{rng.randint(0, 10**6)}"
            texts.append(prose(rng, 20) + w + prose(rng, 20))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    out = ps.shared_passages(docs).collect()
    assert all(r.other < r.doc_id and r.n_words >= 50 and r.identity >= 0.8 for r in out)
    found = {(r.doc_id, r.other) for r in out}
    n = len(passages)
    assert {(whole + n + i, whole + i) for i in range(n)} <= found


def test_seeds_apart_against_all_twos():
    rng = np.random.default_rng(3)
    for _ in range(40):
        n = int(rng.integers(0, 60))
        doc, pos = np.sort(rng.integers(0, 3, n)), np.zeros(n, np.int64)
        for d in range(3):
            pos[doc == d] = np.sort(rng.choice(400, int((doc == d).sum()), replace=False))
        rep, rep_pos = rng.integers(0, 3, n), rng.integers(0, 80, n)
        want = {(i, j) for i in range(n) for j in range(i + 1, n) if doc[i] == doc[j] and pos[j] + ps.K - pos[i] <= 50
                and (rep[i] != rep[j] or abs((rep_pos[j] - rep_pos[i]) - (pos[j] - pos[i])) > ps.WINDOW)}
        i, j = ps.apart_seeds(doc, pos, rep, rep_pos, 50)
        assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)


def test_chains_are_aligned_many_at_a_time():
    rng = np.random.default_rng(11)
    words, pieces, starts = ([], []), [], []
    for _ in range(120):
        x, y, found = [rng.integers(0, 3, rng.choice([0, 5, 40, 300])) for _ in "xy"], None, []
        x, y = x
        for k in range(int(rng.integers(1, 4))):
            same = rng.integers(0, 3, int(rng.integers(6, 60)))
            found.append((len(x), len(x) + len(same), len(y)))
            noisy = np.where(rng.random(len(same)) < 0.1, 9, same)
            gap = [rng.integers(0, 3, int(rng.integers(0, 9))) for _ in "xy"]
            x, y = np.concatenate((x, same, gap[0])), np.concatenate((y, noisy, gap[1]))
        tail = rng.integers(0, 3, 280)
        words[0].append(np.concatenate((x, tail[:int(rng.integers(0, 280))])))
        words[1].append(np.concatenate((y, tail)))
        at = rng.integers(0, 100, 2)
        starts.append(at)
        pieces.append([(s + at[0], e + at[0], t + at[1]) for s, e, t in found])
    want = []
    for x, y, (xs, ys), p in zip(*words, starts, pieces):
        (a0, _, b0), (s, a1, t) = p[0], p[-1]
        b1 = t + a1 - s
        left, m = ps.grow(x[:a0 - xs][::-1], y[:b0 - ys][::-1])
        right, n = ps.grow(x[a1 - xs:], y[b1 - ys:])
        n += m + sum(int((x[s - xs:e - xs] == y[t - ys:t - ys + e - s]).sum()) for s, e, t in p)
        n += sum(ps.common_words(x[e - xs:u - xs].tolist(), y[t + e - s - ys:v - ys].tolist()) for (s, e, t), (u, _, v) in zip(p, p[1:]))
        want.append((a0 - left, a1 + right, b0 - left, b1 + right, n))
    off = lambda parts: np.cumsum([0, *map(len, parts)])
    xs, ys = np.array(starts).T
    got = ps.align(np.concatenate(words[0]), off(words[0]), np.concatenate(words[1]), off(words[1]), xs, ys, np.array(sum(pieces, [])), off(pieces))
    assert list(map(tuple, got.T.tolist())) == want


def test_a_document_has_one_row_for_each_two():
    """Lines that a text repeats do not give a row for each of their places."""
    places = [{"pos": 10 * i, "rep": i % 3, "rep_pos": 7 * (i % 3), "joined": 0} for i in range(300)]
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in places[0]]))
    batch = pa.RecordBatch.from_pylist([{"rid": 5, "places": places}, {"rid": 6, "places": places[:4]}], pa.schema([("rid", pa.int64()), ("places", kind)]))
    pos, rep, rep_pos = (np.array([p[c] for p in places]) for c in ("pos", "rep", "rep_pos"))
    i, j = ps.apart_seeds(np.zeros(300, np.int64), pos, rep, rep_pos, 50)
    twos = {(rep[a], rep[b]): [set(), set()] for a, b in zip(i, j)}
    for a, b in zip(i, j):
        for k, x in enumerate((a, b)):
            twos[rep[a], rep[b]][k].add(int(pos[x]))
    rows = [r for b in ps._pair_rows(50, False)(iter([batch])) for r in b.to_pylist() if r["rid"] == 5]
    assert len(i) > 900 and len(rows) == len(twos) == len({r["h"] for r in rows})
    key = lambda r: (sorted(r[0]), sorted(r[1]))
    assert sorted(map(key, twos.values())) == sorted(key((r["firsts"], r["seconds"])) for r in rows)
    first = {(r["h"], r["pos"]) for b in ps._pair_rows(50, True)(iter([batch])) for r in b.to_pylist() if r["rid"] == 5}
    assert {h for h, _ in first} == {r["h"] for r in rows} and all(any(r["h"] == h and p in r["firsts"] for r in rows) for h, p in first)
