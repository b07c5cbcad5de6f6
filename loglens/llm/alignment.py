r"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Tokenizer A is byte-level BPE (a ``tokenizers`` file), tokenizer B a ``sentencepiece`` model; neither is
trained here, both files are read by the driver and sent to the tasks whole (a few MB, whatever the
table). A space stands before every text, as B puts one there. Where A's file is plain byte-level BPE
whose ids follow its merges (checked when it is loaded), ``tiktoken`` merges its vocabulary by id,
which gives the same tokens in a third of the time (tested); other files go through ``tokenizers``.

* A task takes whole texts, about a MB of them at a time. Their tokens are two frames keyed by the
  document's base plus the byte offset, so one ``pandas.merge_asof`` a direction joins a whole batch
  document by document: each token start finds the other side's token that covers it. The union of
  both directions is every overlapping pair; ends that both sides have cut the tokens into groups.
* A pair of ids counts the documents that hold it linked. Every document's distinct pairs are written
  once; counting is partial in each task. Counts come back to the documents by a broadcast for the
  most frequent pairs (``HOT_PAIRS`` at most, by count of entries) and by a shuffle join for all others,
  so the pairs that nearly every document has are never shuffled, and no pair is left out.

Results: texts that are null or empty, or whose joined tokens of either side differ from the text (B
does not tell U+2581 from a space), have no tokens: zeros, and '' for the groups' digest. Every row is
a document of its own, equal ones too. Other columns of the table are not read.
"""
from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import give_back, most_frequent, written

#: What byte-level tokenizers split texts by (fixed value).
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Text that is aligned at a time.
PIECE_BYTES = 1 << 20
#: Most id pairs whose counts are broadcast (about 20 bytes each).
HOT_PAIRS = 1 << 18


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 characters
    stand for themselves, the other bytes are numbered from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def by_merges(a_json: str, tokens: list[bytes]) -> tiktoken.Encoding | None:
    """The same vocabulary merged by id, if that is what the file describes."""
    described = json.loads(a_json)
    split, model = described.get("pre_tokenizer") or {}, described["model"]
    plain = (model.get("type") == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True)
             and not any((split.get("add_prefix_space"), described.get("normalizer"), model.get("ignore_merges"),
                          model.get("continuing_subword_prefix"), model.get("end_of_word_suffix"), model.get("dropout"))))
    made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model.get("merges", [])]
    if not plain or any(x >= y for x, y in zip(made, made[1:])):
        return None
    added = {t["id"] for t in described.get("added_tokens", [])}
    ranks = {tokens[i]: i for i in model["vocab"].values() if i not in added}
    return tiktoken.Encoding("by-merges", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})


@dataclass
class Pair:
    """Both tokenizers and the bytes of their tokens."""
    a: Tokenizer | tiktoken.Encoding
    b: sentencepiece.SentencePieceProcessor
    bytes_a: list[bytes]
    bytes_b: list[bytes]
    words: np.ndarray          # ids as text, followed by a comma, a bar, a semicolon

    @staticmethod
    def load(a_json: str, b_model: bytes) -> Pair:
        a = Tokenizer.from_str(a_json)
        a.encode_special_tokens = True                  # their strings in a text are ordinary text
        b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        letters = byte_letters()
        vocabulary = a.get_vocab(with_added_tokens=True)
        bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        bytes_b = [bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()
                   for i, piece in ((i, b.id_to_piece(i)) for i in range(b.get_piece_size()))]
        n = max(len(bytes_a), len(bytes_b))
        return Pair(by_merges(a_json, bytes_a) or a, b, bytes_a, bytes_b, np.array([[f"{i}{sign}" for i in range(n)] for sign in ",|;"], dtype=object))

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Token ids of both sides; none where the joined tokens are not the text."""
        spaced = [" " + t for t in texts]
        if isinstance(self.a, Tokenizer):
            ids_a = [e.ids for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)]
        else:
            ids_a = [self.a.encode_ordinary(t) for t in spaced]
        ids_b = self.b.encode(texts, num_threads=1)
        found = []
        for text, x, y in zip(texts, ids_a, ids_b):
            whole = (" " + text).encode()
            same = text and b"".join([self.bytes_a[i] for i in x]) == whole and b"".join([self.bytes_b[i] for i in y]) == whole
            found.append((x, y) if same else ([], []))
        return found


def _side(ids: list[list[int]], size: np.ndarray) -> pd.DataFrame:
    """The tokens of a batch of documents: id and byte range, offsets counted on from document to document."""
    flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in ids])
    end = np.cumsum(size[flat])
    return pd.DataFrame({"at": end - size[flat], "end": end, "id": flat, "row": np.arange(len(flat))})


def links(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all overlapping tokens: every token start finds the other side's covering token."""
    into_b = pd.merge_asof(a[["at", "row"]], b[["at", "row"]], on="at", suffixes=("_a", "_b"))
    into_a = pd.merge_asof(b[["at", "row"]].assign(start=b["at"]), a[["at", "row"]].assign(start=a["at"]), on="at", suffixes=("_b", "_a"))
    into_a = into_a[into_a["start_a"] != into_a["start_b"]]             # those the first direction has
    return (np.concatenate((into_b["row_a"], into_a["row_a"])).astype(np.int64),
            np.concatenate((into_b["row_b"], into_a["row_b"])).astype(np.int64))


def _group_texts(a: pd.DataFrame, b: pd.DataFrame, docs: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Number of groups and their text by document; ``docs`` holds the first row of each document on
    both sides."""
    _, last_a, last_b = np.intersect1d(a["end"], b["end"], assume_unique=True, return_indices=True)
    # a token's place: its row, and the other side's tokens of the groups before it (A) or up to its own (B)
    group_a = np.searchsorted(last_a, np.arange(len(a)))
    group_b = np.searchsorted(last_b, np.arange(len(b)))
    text = np.empty(len(a) + len(b), dtype=object)
    sign = np.zeros(len(a), dtype=np.int64)
    sign[last_a] = 1
    text[np.arange(len(a)) + np.concatenate(([0], last_b + 1))[group_a]] = words[sign, a["id"]]
    sign = np.zeros(len(b), dtype=np.int64)
    sign[last_b] = 2
    text[np.arange(len(b)) + last_a[group_b] + 1] = words[sign, b["id"]]
    cut = docs[0] + docs[1]
    n_groups = np.searchsorted(last_a, docs[0][1:]) - np.searchsorted(last_a, docs[0][:-1])
    return n_groups, ["".join(text[i:j])[:-1] for i, j in zip(cut[:-1], cut[1:])]


_ROWS = pa.schema([("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
                   ("groups", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])


def align_texts(pair: Pair, texts: list[str], digest: bool) -> pa.RecordBatch:
    """``_ROWS`` of some whole texts."""
    encoded = pair.encode(texts)
    size_a, size_b = (np.array([len(t) for t in side], dtype=np.int64) for side in (pair.bytes_a, pair.bytes_b))
    a, b = _side([x for x, _ in encoded], size_a), _side([y for _, y in encoded], size_b)
    n_a, n_b = (np.array([len(e[k]) for e in encoded], dtype=np.int64) for k in (0, 1))
    docs = np.stack([np.concatenate(([0], np.cumsum(n))) for n in (n_a, n_b)])
    row_a, row_b = links(a, b) if len(a) else (np.empty(0, np.int64), np.empty(0, np.int64))
    doc = np.searchsorted(docs[0], row_a, side="right") - 1
    ids = len(size_a) * len(size_b)
    keys, times = np.unique(doc * ids + a["id"].to_numpy()[row_a] * len(size_b) + b["id"].to_numpy()[row_b], return_counts=True)
    n_groups, groups = _group_texts(a, b, docs, pair.words) if len(a) else (np.zeros(len(texts), np.int64), [""] * len(texts))
    if digest:
        groups = [hashlib.sha256(g.encode()).hexdigest() if n else "" for g, n in zip(groups, n_a.tolist())]
    offsets = pa.array(np.searchsorted(keys, np.arange(len(texts) + 1) * ids).astype(np.int32))
    return pa.RecordBatch.from_arrays([
        pa.array(n_a), pa.array(n_b), pa.array(n_groups, pa.int64()),
        pa.array(np.bincount(doc, minlength=len(texts)), pa.int64()), pa.array(groups, pa.string()),
        pa.ListArray.from_arrays(offsets, pa.array(keys % ids, pa.int64())),
        pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))], schema=_ROWS)


def _align(files, digest: bool, piece_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # a task has one core
        pair = Pair.load(*files.value)
        for batch in batches:
            ids, text = (batch.column(batch.schema.names.index(c)) for c in ("id", "text"))
            texts, held = [], 0
            for i in range(batch.num_rows):
                texts.append(text[i].as_py() or "")
                held += len(texts[-1])
                if held >= piece_bytes or i == batch.num_rows - 1:
                    out = align_texts(pair, texts, digest)
                    yield pa.RecordBatch.from_arrays([ids.slice(i + 1 - len(texts), len(texts)), *out.columns], names=["id", *out.schema.names])
                    texts, held = [], 0
            give_back()
    return run


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = True,
          piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Row of ``docs`` by row: ``id_col``, n_a, n_b, n_groups, n_links, groups (their digest, or
    their text), n_best (links whose pair is its A id's most common) and count_sum."""
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        files = (a.read(), b.read())
    spark = docs.sparkSession
    size_b = sentencepiece.SentencePieceProcessor(model_proto=files[1]).get_piece_size()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {slim.schema['id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"
    aligned = written(slim.mapInArrow(_align(spark.sparkContext.broadcast(files), digest, piece_bytes), schema)
                      .withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs"))
    by_a = Window.partitionBy(F.floor(F.col("pair") / size_b))          # as many as B has ids at most
    counts = written(counts.withColumn("best", F.col("docs") == F.max("docs").over(by_a)), "pair-counts")
    hot = F.broadcast(written(most_frequent(counts, "docs", HOT_PAIRS), "hot-pairs"))
    linked = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    priced = linked.join(hot, "pair").unionByName(linked.join(hot, "pair", "left_anti").join(counts, "pair").select("pair", "row", "times", "docs", "best"))
    sums = priced.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                                     F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    return aligned.drop("pairs", "times").join(sums, "row", "left").fillna(0, ["n_best", "count_sum"]).drop("row").withColumnRenamed("id", id_col)
