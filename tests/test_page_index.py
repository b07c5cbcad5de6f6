"""Page search from the index gives the rows of a scan, and reads few rows."""
import hashlib

import pytest
from pyspark.sql import functions as F

from loglens.operators.explore import page_search
from loglens.operators.page_index import LOOKED_UP, PageIndex, grams_of_word

FACTS = ("id bigint, datasource_id int, clientip string, destip string, time bigint, bytesIn bigint, bytesOut bigint, page string")
ROWS = [(1, 1, "c1", "shop.example", 10, 1, 2, "/Purchase/Order"), (2, 1, "c1", "shop.example", 70, 1, 2, "/purchase/order"),
        (3, 1, "c2", None, 20, None, 2, "/a%b_c/100%"), (4, 2, "c2", "PURCHASE.example", None, 5, 5, None), (5, 2, None, "x", 30, 5, 5, ""),
        (6, 2, "c3", "pur", 40, 5, 5, "chase"), (7, 2, "c3", "münchen.example", 50, 9, 9, "/STRASSE/Ä"), (8, 1, "c4", "d", 60, 1 << 62, 1 << 62, "/purchases"),
        (9, 1, "c4", "d", 61, 1 << 62, 1 << 62, "/purchases"), (10, 3, "c5", "yes", 80, 1, 1, "/purpurchasechase\\n/aaaa/aab")]


def _scanned(df):
    """Result rows of a query, and the rows its scans of each folder gave, also below shuffles."""
    rows = len(df.collect())
    total, todo = {}, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        elif node.nodeName().startswith("Scan parquet"):
            folder = node.relation().location().rootPaths().head().getParent().getName()
            total[folder] = total.get(folder, 0) + node.metrics().apply("numOutputRows").value()
        else:
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
    return rows, total


def _indexed(spark, facts, root, kind):
    index = PageIndex(spark, root, kind, parts=4)
    for k in range(3):
        index.add(facts.filter(F.col("id") % 3 == k))
    return index


@pytest.mark.parametrize("kind", ["proxy", "web"])
def test_same_rows_as_a_scan(spark, tmp_path, kind):
    facts = spark.createDataFrame(ROWS, FACTS)
    index = _indexed(spark, facts, str(tmp_path / kind), kind)
    for word in ("purchase", "PURCHASE", "chase", "urc", "aaa", "pu", "/", "", "100%", "a%b", "%b_", "ünch", "straße", "/ä", "absent", "d", "\\n/a", "rchasec"):
        assert index.search(word).collect() == page_search(facts, word, kind).collect(), word
    for word in ("pur%ase", "p_rchase", "%", "a\\%b", "ü%en", "ord_r", "chase%order", "zzz%"):
        assert index.search(word, wildcards=True).collect() == page_search(facts, word, kind, wildcards=True).collect(), word


def test_empty_index_and_unfinished_imports(spark, tmp_path):
    facts = spark.createDataFrame(ROWS, FACTS)
    index = PageIndex(spark, str(tmp_path / "p"))
    assert index.search("purchase").collect() == [] and index.search("p").collect() == []
    index.add(facts.limit(0))
    assert index.search("purchase").collect() == []
    name = index.add(facts)
    (tmp_path / "p" / "log" / name).rename(tmp_path / "p" / "hidden")        # as if the import had failed before its last step
    assert index.search("purchase").collect() == []


def test_triples():
    assert grams_of_word("Purch") == ["pur", "rch", "urc"] and grams_of_word("ab") == []
    assert grams_of_word("abc%de_fgh", wildcards=True) == ["abc", "fgh"] and grams_of_word("abc%de") == ["%de", "abc", "bc%", "c%d"]
    assert grams_of_word("abc\\%d", wildcards=True) == [] and grams_of_word("äbc", wildcards=True) == []


def test_few_rows_are_read(spark, tmp_path):
    e = spark.range(120_000)
    facts = e.select("id", F.lit(1).alias("datasource_id"), F.concat(F.lit("c"), F.col("id") % 50).alias("clientip"), F.lit("host.example").alias("destip"),
                     F.col("id").alias("time"), F.lit(1).cast("bigint").alias("bytesIn"), F.lit(1).cast("bigint").alias("bytesOut"),
                     F.concat(F.lit("/"), F.sha2(F.col("id").cast("string"), 256), F.when(F.col("id") == 77, "/needle").otherwise("")).alias("page"))
    facts.write.parquet(str(tmp_path / "facts" / "rows"))
    index = PageIndex(spark, str(tmp_path / "i"), parts=16)
    index.add(spark.read.parquet(str(tmp_path / "facts" / "rows")))
    postings = spark.read.parquet(f"{index.root}/postings/*").count()
    for word in ("needle", hashlib.sha256(b"77").hexdigest()):
        found, looked_at = _scanned(index.candidates(grams_of_word(word)[:LOOKED_UP]))
        assert 1 <= found < 100 and 0 < looked_at["postings"] < postings / 4, (found, looked_at, postings)
        rows, scanned = _scanned(index.search(word))
        assert rows == 1 and 0 < scanned["visits"] < 60_000, scanned
    assert _scanned(page_search(spark.read.parquet(str(tmp_path / "facts" / "rows")), "needle")) == (1, {"facts": 120_000})
    plan = index.search("needle")._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan
