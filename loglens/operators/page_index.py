"""Index for page search (A23, F8): letter triples point to pages, pages to their clients' figures.

Two tables, both made by an import from its own rows alone:
- ``postings``: which distinct texts (page, or destination and page) hold a triple of letters of their
  lower-cased form; range-partitioned and sorted by triple, so row-group statistics leave a search
  few row groups, and a triple that most texts hold is spread over several tasks and files.
- ``visits``: per text, source and client the rows, first and last time and bytes, in folders by hash
  of the text, so that a join with the texts found reads the folders of those alone (dynamic
  partition pruning). A text with a third of all rows is one row a client here.

A search takes the triples of its word, keeps texts that have all of those looked up (a few more than those
that hold the word), and tests the word itself on their visits: rows equal those of a scan of all facts.
Words without a triple (under three letters, or wildcards with short pieces) test every distinct visit.

Texts are numbered by a 64-bit hash; texts that share one only become candidates together, since the
word is tested on each. Texts found are written to the shared folder before the visits are read: their
size is then known, so few are broadcast and prune folders (the planner prunes by a side that has a
filter, here one that all rows pass), and many are joined by a shuffle. Imports of the same text
repeat its postings; figures of all imports add up.
"""
from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.counts import add_bytes, byte_sum
from ..plans import claims
from ..session import scratch_path
from .explore import holds_word, listing_of_hits

GRAM = 3
#: Triples of a word that are looked up, spread over it. The word itself is tested on what they leave,
#: so this changes no result; the Parquet reader compares up to 10 values with a row group's statistics.
LOOKED_UP = 10
POSTINGS_SCHEMA = "gram string, text_id bigint"
VISITS_SCHEMA = ("text_id bigint, page string, destip string, clientip string, times bigint, pages bigint, "
                 "first_time bigint, last_time bigint, bytes bigint, datasource_id int, part int")


def grams_of_word(word: str, wildcards: bool = False) -> list[str]:
    """Distinct triples that every text holding the word must have, in order. With wildcards those of
    the pieces between them; none where a backslash or a letter beyond ASCII leaves that open."""
    if wildcards and ("\\" in word or not word.isascii()):
        return []
    pieces = re.split("[%_]", word) if wildcards else [word]
    low = [piece.lower() for piece in pieces]
    return sorted({p[i:i + GRAM] for p in low for i in range(len(p) - GRAM + 1)})


def postings_of_texts(texts: DataFrame) -> DataFrame:
    """(gram, text_id) of texts (text_id, page, destip). Triples never span page and destination."""
    def grams(column):
        low = F.lower(F.coalesce(column, F.lit("")))
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - (GRAM - 1), F.lit(1))), lambda i: F.substring(low, i, F.lit(GRAM)))
    each = F.explode(F.array_distinct(F.concat(grams(F.col("page")), grams(F.col("destip")))))
    return texts.select(each.alias("gram"), "text_id").filter(F.length("gram") == GRAM)


def visits_of_rows(facts: DataFrame, kind: str, parts: int) -> DataFrame:
    """Figures per text, source and client; the text of a web row is its page."""
    destip = F.col("destip") if kind == "proxy" else F.lit(None).cast("string")
    rows = facts.select("datasource_id", "clientip", "page", destip.alias("destip"), "time", add_bytes("bytesIn", "bytesOut").alias("b"))
    visits = rows.groupBy("datasource_id", "clientip", "page", "destip").agg(
        F.count("time").alias("times"), F.count("page").alias("pages"), F.min("time").alias("first_time"),
        F.max("time").alias("last_time"), byte_sum("b").alias("bytes"))
    visits = visits.withColumn("text_id", F.xxhash64("page", "destip"))
    return visits.withColumn("part", F.pmod("text_id", F.lit(parts)).cast("int"))


class PageIndex:
    """The index below ``root`` of one kind of facts. ``parts`` is fixed when the index is first made:
    folders of visits an import and source, about the bytes of an import's visits over 128 MB."""

    def __init__(self, spark: SparkSession, root: str, kind: str = "proxy", parts: int = 64):
        self.spark, self.root, self.kind, self.parts = spark, root.rstrip("/"), kind, parts

    def add(self, rows: DataFrame) -> str:
        """Index an import's rows; only these are read. They are found once this returns, whole: a
        folder that no log entry names (of an import that failed) is never read."""
        name = uuid.uuid4().hex
        visits_path = f"{self.root}/visits/{name}"
        visits_of_rows(rows, self.kind, self.parts).repartitionByRange("part", "text_id", "clientip") \
            .sortWithinPartitions("part", "datasource_id", "text_id").write.partitionBy("datasource_id", "part").parquet(visits_path)
        texts = self._read(VISITS_SCHEMA, [visits_path]).select("text_id", "page", "destip").distinct()
        postings_of_texts(texts).repartitionByRange("gram", "text_id").sortWithinPartitions("gram", "text_id") \
            .write.parquet(f"{self.root}/postings/{name}")
        claims.create_once(self.spark, f"{self.root}/log/{name}")
        return name

    def _read(self, schema: str, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.range(0).select(F.from_json(F.lit("{}"), schema).alias("r")).select("r.*")
        tables = [self.spark.read.schema(schema).parquet(path) for path in paths]
        out = tables[0]
        for table in tables[1:]:
            out = out.unionByName(table)
        return out

    def _table(self, table: str, schema: str) -> DataFrame:
        return self._read(schema, [f"{self.root}/{table}/{name}" for name in claims.names(self.spark, f"{self.root}/log")])

    def candidates(self, grams: list[str]) -> DataFrame:
        """Texts (text_id, part) that have every one of some distinct triples."""
        found = self._table("postings", POSTINGS_SCHEMA).filter(F.col("gram").isin(grams)).distinct()
        found = found.groupBy("text_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(grams))
        return found.select("text_id", F.pmod("text_id", F.lit(self.parts)).cast("int").alias("part"))

    def search(self, word: str, wildcards: bool = False) -> DataFrame:
        """A23 from the index: the rows of ``explore.page_search`` over all indexed facts."""
        visits = self._table("visits", VISITS_SCHEMA)
        grams = grams_of_word(word, wildcards)
        if len(grams) > LOOKED_UP:
            grams = [grams[i * len(grams) // LOOKED_UP] for i in range(LOOKED_UP)]
        if grams:
            path = scratch_path(self.spark, "texts-found")
            self.candidates(grams).write.parquet(path)
            found = self._read("text_id bigint, part int", [path]).filter(F.col("part") < self.parts)
            visits = visits.join(found, ["part", "text_id"], "left_semi")
        hits = visits.filter(holds_word(word, self.kind, wildcards))
        return listing_of_hits(hits.groupBy("datasource_id", "clientip").agg(
            F.sum("times" if self.kind == "proxy" else "pages").cast("bigint").alias("pageCount"),
            F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time"), byte_sum("bytes").alias("bytes")))
