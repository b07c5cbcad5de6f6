"""Similarity join of documents on word shingles (Jaccard), by T-occurrence search.

1. Scan: each text's set of distinct 5-word shingles. Sets that are equal are one class.
2. Two sets that reach the similarity share one of their first n - T + 1 shingles in any
   fixed order (T: the overlap that is needed at least). The order is by levels of how many
   documents hold a shingle, rare ones first, else by hash. Only these prefixes are shuffled.
3. Star round: every set is compared with the first set that shares a prefix shingle,
   which links groups of near copies in proportion to their size, not its square.
4. Cross round: prefix shingles that still join different components give the remaining
   candidate pairs, cut by size, position and frequency bounds; pairs inside a component are
   not made, they change no component.
5. Comparing is a T-occurrence search: one set queries an inverted index of its
   candidates; short lists are merged, the longest ones only probed (DivideSkip).
   It runs on the prefixes first, whose overlap bounds that of the sets, and on whole
   sets for the pairs that are left. Candidates of one set are split into blocks, so no
   group grows with the data.

6. Every set's links are counted once the components are known, as all of them lie inside
   one: its sets are dealt into blocks, and every two blocks are compared as in 5. Only the
   counts leave a task, not the pairs.

Links of every round are exact overlaps of whole sets. A link between sets of different
components is never lost.

Edge cases: null or wordless texts have no shingles and link with nothing; texts of fewer
than five words have one shingle, the whole sequence; repeated rows are one class; ids that
repeat or are null are numbered apart. Other columns are not touched.
"""
from __future__ import annotations

import hashlib
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import (SPACED_WORDS, Chunk, components, find_words, fresh_name, gram_hashes, list_array, list_parts,
                     numbers, read_all, segment_sums, shuffle_partitions, small_batches, text_chunks, with_row_ids, written)

SHINGLE = 5
#: Jaccard similarity NUM / DEN and more.
NUM, DEN = 75, 100
#: Shingles that at least so many documents of one scan task hold are ordered by their counts, at
#: most MAX_FREQUENT of them (16 MB): this only chooses the order, any order gives the same links.
FREQUENT = 2
MAX_FREQUENT = 1 << 20
#: Candidates of one set that are indexed together.
BLOCK = 256
#: 64-bit words of the bit map that tells most shingles of one set only before they are
#: shuffled again (16 MB); a fuller map lets more of them pass, the join drops these.
MAP_WORDS = 1 << 21
#: Cost ratio of DivideSkip's rule for the number of long lists.
MU = 0.0085

_U = np.uint64
_CODE_BITS = 52
_ROWS = (1 << (64 - _CODE_BITS)) - 1


def shingle_sets(chunk: Chunk, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 52-bit shingle codes of each row, flattened, and their offsets."""
    w = find_words(chunk, SPACED_WORDS)
    n_words = np.diff(w.offsets)
    grams = gram_hashes(w.hashes, k)
    at = np.arange(len(grams))
    whole = at + k <= w.offsets[1:][w.doc[:len(grams)]] if len(grams) else np.empty(0, bool)
    doc, code = w.doc[:len(grams)][whole], grams[whole]
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    for m in range(1, k):
        rows = short[n_words[short] == m]
        if len(rows):
            first = w.offsets[rows]
            seq = gram_hashes(np.stack([w.hashes[first + j] for j in range(m)], axis=1).reshape(-1), m)[::m] ^ _U(m)
            doc, code = np.concatenate((doc, rows)), np.concatenate((code, seq))
    packed = (doc.astype(_U) << _U(_CODE_BITS)) | (code >> _U(64 - _CODE_BITS))
    packed.sort()
    packed = packed[np.concatenate(([True], packed[1:] != packed[:-1]))] if len(packed) else packed
    doc = (packed >> _U(_CODE_BITS)).astype(np.int64)
    return packed & _U((1 << _CODE_BITS) - 1), np.searchsorted(doc, np.arange(len(chunk) + 1))


def _frequent(batches):
    """Shingles held by at least FREQUENT documents of this task, with their counts."""
    keys, counts = [np.empty(0, _U)], [np.empty(0, np.int64)]
    for chunk in text_chunks(batches, max_rows=_ROWS):
        codes, _ = shingle_sets(chunk)
        codes.sort()
        heads = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.empty(0, np.int64)
        n = np.diff(np.append(heads, len(codes)))
        keys.append(codes[heads[n > 1]])
        counts.append(n[n > 1])
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)
    keep = n >= FREQUENT
    yield pa.RecordBatch.from_arrays([pa.array(key[keep].astype(np.int64)), pa.array(n[keep])], names=["s", "n"])


def prefix_length(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Shingles of which a set of ``n`` shares one at least with any set that reaches num / den."""
    return n - -(-num * n // den) + 1


def _prefixes(frequent, num: int, den: int):
    """Rows (rid, n, digest, prefix); a shingle's sort key is its code, with its level of ``frequent`` above."""
    schema = pa.schema([("rid", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("prefix", pa.list_(pa.int64()))])

    def run(batches):
        known, levels = frequent.value
        for chunk in text_chunks(batches, max_rows=_ROWS):
            codes, off = shingle_sets(chunk)
            n = np.diff(off)
            digests = [hashlib.blake2b(codes[off[i]:off[i + 1]].tobytes(), digest_size=16).digest() for i in range(len(chunk))]
            doc = np.repeat(np.arange(len(chunk)), n)
            level = np.zeros(len(codes), dtype=np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
                level = np.where(known[at] == codes, levels[at], 0)
            order = np.argsort((doc << 8) | level, kind="stable")     # codes are in order within a document
            ordered = codes[order] | (level[order].astype(_U) << _U(_CODE_BITS))
            keep = np.arange(len(codes)) - off[:-1][doc] < prefix_length(n, num, den)[doc]
            yield pa.RecordBatch.from_arrays([
                chunk.column("rid"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()),
                list_array(np.concatenate(([0], np.cumsum(segment_sums(keep, off)))), pa.array(ordered[keep].astype(np.int64)))], schema=schema)

    return run


def _bit_map(shared: DataFrame) -> np.ndarray:
    """Bit map of the shingles or row ids ``s``: a bit of MAP_WORDS words each, chosen by their low bits."""
    bit = F.shiftright("s", MAP_WORDS.bit_length() - 1).bitwiseAND(F.lit(63)).cast("int")
    words = shared.groupBy(F.col("s").bitwiseAND(F.lit(MAP_WORDS - 1)).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("b")).toArrow()
    bits = np.zeros(MAP_WORDS, dtype=_U)
    bits[numbers(words.column("w"))] = numbers(words.column("b")).view(_U)
    return bits


def _sent(spark: SparkSession, value, until: ExitStack | None = None) -> Broadcast:
    """``value`` on all executors; in no memory once ``until`` is left, so what needs it is written before."""
    sent = spark.sparkContext.broadcast(value)
    if until is not None:
        until.callback(sent.destroy)
    return sent


def _is_set(bits: np.ndarray, s: np.ndarray) -> np.ndarray:
    at = (s.astype(_U) >> _U(MAP_WORDS.bit_length() - 1)) & _U(63)
    return (bits[s & (MAP_WORDS - 1)] >> at) & _U(1) == 1


def _in_map(bits):
    """The rows whose row id, the first column, has its bit set: all rows wanted and few others."""
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_is_set(bits.value, numbers(batch.column(0)))))

    return run


def _only(rows: DataFrame, ids: DataFrame, until: ExitStack | None = None) -> DataFrame:
    """``rows`` (rid first) with those of ``ids`` (s) and few others, without a shuffle of ``rows``."""
    return rows.mapInArrow(_in_map(_sent(rows.sparkSession, _bit_map(ids), until)), rows.schema)


def _mapped(bits, wanted=None):
    """Rows (rid, n, prefix) to rows (rid, n, pos, s) of the prefix shingles whose bit is set, of the
    rows whose row id has its bit set in ``wanted``. One function does both: each that follows another
    in a stage has Python workers of its own."""
    def run(batches):
        for batch in batches:
            if wanted is not None:
                batch = batch.filter(pa.array(_is_set(wanted.value, numbers(batch.column(0)))))
            off, values = list_parts(batch.column(2))
            s = numbers(values)
            set_ = _is_set(bits.value, s)
            row = np.repeat(np.arange(batch.num_rows), np.diff(off))
            pos = np.arange(len(s)) - off[:-1][row]
            at = pa.array(row[set_])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(pos[set_]), pa.array(s[set_])], names=["rid", "n", "pos", "s"])

    return run


# ------------------------------------------------------------------ comparing
def divide_skip(query: np.ndarray, keys: np.ndarray, starts: np.ndarray, postings: np.ndarray, m: int, t: int) -> np.ndarray:
    """How many of the query's shingles each of ``m`` indexed sets holds; right for every set
    that holds ``t`` or more (smaller counts may be too low).

    ``postings`` are sorted ``key number * m + set``; list ``i`` begins at ``starts[i]``."""
    at = np.searchsorted(keys, query)
    at = at[keys[np.minimum(at, len(keys) - 1)] == query] if len(keys) else at[:0]
    size = starts[at + 1] - starts[at]
    if not len(at):
        return np.zeros(m, dtype=np.int64)
    n_long = min(len(at), max(0, t - 1), int(t / (MU * np.log2(size.max() + 1) + 1)))
    n_long = min(n_long, int(np.count_nonzero(size > 4)))     # probing lists this short saves nothing
    order = np.argsort(-size, kind="stable")
    long, short = at[order[:n_long]], at[order[n_long:]]
    n = starts[short + 1] - starts[short]
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[short], n)
    counts = np.bincount(postings[place] % m, minlength=m)
    live = np.flatnonzero(counts >= t - n_long)
    if n_long and len(live):
        probe = (long[:, None] * m + live[None, :]).reshape(-1)
        got = np.searchsorted(postings, probe)
        hit = postings[np.minimum(got, len(postings) - 1)] == probe
        counts[live] += hit.reshape(n_long, len(live)).sum(axis=0)
    return counts


def _groups(batches):
    """Partition of rows (center, block, rid, n, codes): per group the center's row, the
    other rows, all rows' ids and sizes, and the flat codes with their offsets."""
    table = read_all(batches)
    if table is None:
        return
    center, block, rid, n = (numbers(table.column(c)) for c in ("center", "block", "rid", "n"))
    off, values = list_parts(table.column("codes"))
    codes = numbers(values)
    order = np.lexsort((rid, block, center))
    cut = np.flatnonzero(np.concatenate(([True], (np.diff(center[order]) != 0) | (np.diff(block[order]) != 0), [True])))
    for g in range(len(cut) - 1):
        rows = order[cut[g]:cut[g + 1]]
        own = rid[rows] == center[rows]
        if own.any() and not own.all():
            yield rows[own][0], rows[~own], rid, n, codes, off


def _links(num: int, den: int, prefixes: bool):
    """The pairs of each group whose sets reach num / den; with ``prefixes``, whose sets may
    reach it as far as their prefixes tell."""
    def run(batches):
        us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for q, members, rid, size, codes, off in _groups(batches):
            query, sizes, m = codes[off[q]:off[q + 1]], off[members + 1] - off[members], len(members)
            flat = np.concatenate([codes[off[r]:off[r + 1]] for r in members])
            need = -(-num * (size[q] + size[members]) // (num + den))
            if prefixes:
                # up to the lesser of the last prefix shingles, both sets are known whole
                last = np.minimum(query[-1], codes[off[members + 1] - 1])
                known = np.array([np.searchsorted(codes[off[r]:off[r + 1]], x, side="right") for r, x in zip(members, last)])
                need = need - np.minimum(size[q] - np.searchsorted(query, last, side="right"), size[members] - known)
            keys, inverse = np.unique(flat, return_inverse=True)
            postings = np.sort(inverse.reshape(-1) * m + np.repeat(np.arange(m), sizes))
            starts = np.searchsorted(postings, np.arange(len(keys) + 1) * m)
            counts = divide_skip(query, keys, starts, postings, m, max(1, int(need.min())))
            good = members[counts >= need]
            us.append(np.full(len(good), rid[q]))
            vs.append(rid[good])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    return run


def _link_counts(num: int, den: int):
    """Rows (center, block, rid, n, codes) of pairs of blocks (``block``: the pair's number
    doubled, plus 1 for its second block): how many sets of the pair each set reaches num / den with."""
    def run(batches):
        found = [np.empty((2, 0), np.int64)]
        table = read_all(batches)
        if table is not None:
            center, block, rid = (numbers(table.column(c)) for c in ("center", "block", "rid"))
            off, values = list_parts(table.column("codes"))
            codes = numbers(values)
            order = np.lexsort((rid, block, center))
            cut = np.flatnonzero(np.concatenate(([True], (np.diff(center[order]) != 0) | (np.diff(block[order] >> 1) != 0), [True])))
            size = np.diff(off)
            links = np.zeros(len(rid), np.int64)
            for g in range(len(cut) - 1):
                rows = order[cut[g]:cut[g + 1]]
                second = (block[rows] & 1) == 1
                queries, members = (rows[~second], rows[second]) if second.any() else (rows, rows)
                if not len(queries):
                    continue
                m = len(members)
                keys, inverse = np.unique(np.concatenate([codes[off[r]:off[r + 1]] for r in members]), return_inverse=True)
                postings = np.sort(inverse.reshape(-1) * m + np.repeat(np.arange(m), size[members]))
                starts = np.searchsorted(postings, np.arange(len(keys) + 1) * m)
                for q in queries:
                    need = -(-num * (size[q] + size[members]) // (num + den))
                    near = members[divide_skip(codes[off[q]:off[q + 1]], keys, starts, postings, m, max(1, int(need.min()))) >= need]
                    near = near[near != q]
                    links[q] += len(near)
                    if second.any():
                        links[near] += 1
            found.append(np.stack((rid, links)))
        rid, links = np.concatenate(found, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(links)], names=["first", "n"])

    return run


def count_links(texts: DataFrame, found: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (first, n_links): the links of each set with all others of its component ((node, component) of ``found``)."""
    n = shuffle_partitions(texts.sparkSession)
    blocks = found.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    pair = lambda i: (F.least(own, i) * F.col("blocks") + F.greatest(own, i)) * 2 + F.when(own > i, 1).otherwise(0)
    groups = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda i: F.struct(F.col("component").alias("center"), pair(i).cast("long").alias("block")))
    wanted = found.join(blocks, "component").select(F.col("node").alias("rid"), groups.alias("groups"))
    whole = texts.join(wanted.hint("shuffle_hash"), "rid").select("rid", "text", "groups") \
        .mapInArrow(_sets_of_groups, "center long, block long, rid long, n long, codes array<long>")
    counts = whole.repartition(n, "center", F.shiftright("block", 1)).mapInArrow(_link_counts(num, den), "first long, n long")
    return written(counts.groupBy("first").agg(F.sum("n").alias("n_links")), "link-counts")


def _sets_of_groups(batches):
    """Rows (rid, text, groups): one row with the text's codes for each group."""
    schema = pa.schema([("center", pa.int64()), ("block", pa.int64()), ("rid", pa.int64()), ("n", pa.int64()), ("codes", pa.list_(pa.int64()))])
    for chunk in text_chunks(batches, max_rows=_ROWS):
        codes, off = shingle_sets(chunk)
        n_groups, groups = list_parts(chunk.column("groups"))
        row = np.repeat(np.arange(len(chunk)), np.diff(n_groups))
        center, block = numbers(groups.field(0)), numbers(groups.field(1))
        rid = numbers(chunk.column("rid"))[row]
        size = np.diff(off)[row]
        step = max(1, int((8 << 20) // max(8, 8 * size.max()))) if len(row) else 1
        for i in range(0, len(row), step):
            part = slice(i, i + step)
            flat = np.concatenate([codes[off[r]:off[r + 1]] for r in row[part]]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(center[part]), pa.array(block[part]), pa.array(rid[part]), pa.array(size[part]),
                list_array(np.concatenate(([0], np.cumsum(size[part]))), pa.array(flat, pa.int64()))], schema=schema)


def _by_document(pairs: DataFrame) -> DataFrame:
    """Rows (rid, groups): the groups (center, block) that need a document of ``pairs`` (center, rid)."""
    blocks = pairs.groupBy("center").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    grouped = pairs.join(blocks, "center").select("center", F.pmod(F.xxhash64("rid"), F.col("blocks")).alias("block"), "rid")
    owners = blocks.select("center", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("center").alias("rid"))
    return grouped.unionByName(owners).groupBy("rid").agg(F.collect_list(F.struct("center", "block")).alias("groups"))


def compare(texts: DataFrame, sets: DataFrame, pairs: DataFrame, num: int, den: int, name: str) -> DataFrame:
    """Those of ``pairs`` (center, rid) whose sets reach num / den, as (u, v)."""
    n = shuffle_partitions(texts.sparkSession)
    ids = lambda pairs, *c: pairs.select(F.explode(F.array(*c)).alias("s"))
    with ExitStack() as until:
        grouped = _only(sets.select("rid", "n", "prefix"), ids(pairs, "center", "rid"), until).join(_by_document(pairs).hint("shuffle_hash"), "rid") \
            .select(F.inline("groups"), "rid", "n", F.col("prefix").alias("codes"))
        near = written(grouped.repartition(n, "center", "block").mapInArrow(_links(num, den, True), "u long, v long"), f"{name}-near")
    with ExitStack() as until:
        held = _only(texts, ids(near, "u", "v"), until).join(_by_document(near.select(F.col("u").alias("center"), F.col("v").alias("rid"))).hint("shuffle_hash"), "rid").select("rid", "text", "groups")
        whole = held.mapInArrow(_sets_of_groups, "center long, block long, rid long, n long, codes array<long>")
        return written(whole.repartition(n, "center", "block").mapInArrow(_links(num, den, False), "u long, v long"), f"{name}-links")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", num: int = NUM, den: int = DEN, links: bool = True) -> DataFrame:
    """Row of ``docs`` by row: ``id_col``, n_shingles, class_size (rows with the same set),
    n_links (all other sets that it links with; only with ``links``) and component_id."""
    with small_batches(docs.sparkSession):
        return _similar_documents(docs, id_col, num, den, links)


def _similar_documents(docs: DataFrame, id_col: str, num: int, den: int, links: bool) -> DataFrame:
    spark = docs.sparkSession
    rid = "rid"
    named = with_row_ids(docs.select(F.col(id_col).alias("id"), "text"), "id", rid)
    texts = named.select(rid, "text")
    common = (texts.mapInArrow(_frequent, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
              .orderBy(F.desc("n"), "s").limit(MAX_FREQUENT).select("s", F.floor(2 * F.log2("n")).alias("level")).toArrow())
    known, level = numbers(common.column("s")).astype(_U), numbers(common.column("level"))
    by_code = np.argsort(known)
    with ExitStack() as until:
        frequent = _sent(spark, (known[by_code], level[by_code]), until)
        sets = written(texts.mapInArrow(_prefixes(frequent, num, den), "rid long, n long, digest binary, prefix array<long>"), "shingle-prefixes")
    classes = sets.filter("n > 0").groupBy("digest").agg(F.min("rid").alias("first"), F.count(F.lit(1)).alias("class_size"))
    members = written(sets.select("rid", "n", "digest").join(classes, "digest", "left")
                      .select("rid", "n", F.coalesce("first", "rid").alias("first"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size")), "shingle-classes")
    lead = members.filter("rid = first and n > 0").select("rid")
    with ExitStack() as until:
        # nearly all other rows go here, the last ones from the pairs
        wanted = _sent(spark, _bit_map(lead.select(F.col("rid").alias("s"))), until)
        prefixes = sets.select("rid", "n", "prefix")
        rows = prefixes.mapInArrow(_in_map(wanted), prefixes.schema).select("rid", F.posexplode("prefix").alias("pos", "s"), "n")
        # written before it is joined, so that only one shuffle of all prefixes is on disk at a time
        shared = written(rows.groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("rid").alias("center"), F.min_by("n", "rid").alias("center_n"))
                         .filter("c > 1"), "shared-shingles")
        bits = _sent(spark, _bit_map(shared), until)
        rows = prefixes.mapInArrow(_mapped(bits, wanted), "rid long, n long, pos long, s long")
        lists = written(rows.join(shared, "s").select("s", "rid", "n", "pos", "c", "center", "center_n"), "shared-prefixes")

    near = lambda a, b: (F.least(a, b) * den >= F.greatest(a, b) * num)
    stars = written(lists.filter((F.col("rid") != F.col("center")) & near(F.col("n"), F.col("center_n")))
                    .select("center", "rid").distinct().join(lead, "rid", "left_semi"), "star-pairs")
    edges = compare(texts, sets, stars, num, den, "star")
    so_far = components(edges)

    placed = lists.filter("c > 2").join(so_far.withColumnRenamed("node", "rid"), "rid", "left") \
        .select("s", "rid", "n", "pos", "c", "center", F.coalesce("component", "rid").alias("comp"))
    # a set's shared prefix shingles, those that most sets share first
    placed = placed.withColumn("heavy", F.row_number().over(Window.partitionBy("rid").orderBy(F.desc("c"), "s")) - 1)
    split = placed.groupBy("s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("s")
    # a pair with a list's first set is a star pair
    open_lists = placed.filter("rid <> center").join(split, "s")
    a, b = (open_lists.select("s", *[F.col(c).alias(f"{x}_{c}") for c in ("rid", "n", "pos", "comp", "heavy")]) for x in "ab")
    need = F.ceil((F.col("a_n") + F.col("b_n")) * num / (num + den))
    # Two sets that belong together share more than ``spare`` prefix shingles (all but the
    # needed overlap less one of a set follows its prefix). Of the first spare + 1 of these one
    # is lighter than ``spare`` others, so not among the ``spare`` heaviest of either set, and at
    # most ``spare`` come before it. Sets of unlike size have little to spare: there the first
    # shared one itself is asked for.
    like = F.col("a_n") * 10 >= F.col("b_n") * 9
    spare = F.when(like, need - F.greatest(*[F.ceil(F.col(f"{x}_n") * num / den) for x in "ab"])).otherwise(0)
    early = (F.col("a_pos") <= F.col("a_n") - need + spare) & (F.col("b_pos") <= F.col("b_n") - need + spare)
    cross = a.join(b, "s").filter(
        (F.struct("a_n", "a_rid") < F.struct("b_n", "b_rid")) & (F.col("a_comp") != F.col("b_comp")) & near(F.col("a_n"), F.col("b_n"))
        & (F.col("a_heavy") >= spare) & (F.col("b_heavy") >= spare) & early)
    pairs = cross.select(F.least("a_rid", "b_rid").alias("center"), F.greatest("a_rid", "b_rid").alias("rid")).distinct()
    pairs = pairs.join(stars, ["center", "rid"], "left_anti").join(lead, "rid", "left_semi").join(lead.select(F.col("rid").alias("center")), "center", "left_semi")
    pairs = written(pairs, "cross-pairs")
    more = compare(texts, sets, pairs, num, den, "cross")
    edges = edges.unionByName(more)
    found = components(edges)
    out = members.join(found.select(F.col("node").alias("first"), "component"), "first", "left")
    if links:
        counts = count_links(texts, written(found, "components"), num, den)
        out = out.join(counts, "first", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))
    columns = ["n_shingles", "class_size", *(["n_links"] if links else [])]
    out = out.withColumnRenamed("n", "n_shingles").select("rid", *columns, F.coalesce("component", "first").alias("component"))
    ids = named.select("rid", "id")
    out = out.join(ids, "rid").join(ids.select(F.col("rid").alias("component"), F.col("id").alias("component_id")), "component")
    return out.select(F.col("id").alias(id_col), *columns, "component_id", "rid", "component")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component, that with the smallest id."""
    row = fresh_name(docs, "row_id")
    named = with_row_ids(docs, id_col, row)
    gone = similar_documents(named.select(row, "text"), row, links=False).filter("rid <> component").select(F.col(row))
    return named.join(gone, row, "left_anti").select(*docs.columns)
