"""Sections by the table function, against the same by columns; one lookup of categories against joins."""

import random

from pyspark.sql import functions as F

from noticeflow.functions import category, sections
from noticeflow.plans import normalize


def test_lateral_rows_are_those_by_columns(spark):
    rnd = random.Random(7)
    parts = ["#", "##", "#######", " ", "   ", "\n", "\n", "\r\n", "\r", "x", "标题", " ", "\u0085", " ", "　", "\t", "a # b", "\x1c"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(600)]
    texts += [None, "", " \n ", "# a", "#", "# a\n", "a\n# b\n# c", "# h\n\n\n# i", "    # no", "\n\n# a "]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, t string").withColumn("pos", F.lit("clash"))
    want = sorted(map(str, sections.rows(docs, "k", "t").collect()))
    assert sorted(map(str, sections.lateral_rows(docs, "k", "t").collect())) == want


def test_a_long_document_by_the_table_function(spark):
    docs = spark.range(1).select(F.lit(1).alias("k"), F.repeat(F.lit("# h\nline one\nline two\n"), F.lit(100_000)).alias("t"))
    got = sections.lateral_rows(docs, "k", "t").agg(F.count("*"), F.max("pos"), F.max("content"), F.min("raw")).first()
    assert tuple(got) == (100_000, 99_999, "line one\nline two", "# h\nline one\nline two")


def test_categories_by_lookup_and_by_join(spark):
    terms = category.product_terms(spark, "挖 机、推土机\n挖机，叉车")
    row = lambda s, given="": ("l", "", s, given, "", None, "", "")
    rows = [(1, [row("挖机"), row("推土 机"), row("x"), row("y"), row(None, "own")], [(2, "a"), (2, "b"), (3, " "), (9, "no")]), (2, [], [(0, "a")]), (3, [row("z"), row("z", "own")], [])]
    said = {"a": '{"productCategory": "叉车"}', "b": '{"productCategory": "一、二"}', " ": '{"productCategory": " "}', "no": "none"}
    rows = [(k, own, [(i, said[p]) for i, p in at]) for k, own, at in rows]
    items = spark.createDataFrame(rows, f"doc_id int, lotProducts array<{normalize.lots.PRODUCT}>, _said_product_category array<struct<pos:int,payload:string>>")
    items = items.withColumn("_said_product_category", F.array_sort("_said_product_category"))
    shown = lambda df: {r.doc_id: [p.productCategory for p in r.lotProducts] for r in df.collect()}
    got = shown(normalize.with_categories(items, terms))
    assert got == shown(normalize.with_categories(items, terms, lookup_bytes=1))
    assert got[2] == [] and got[1] == ["挖 机", "推土机", "一", "", ""] and got[3] == ["", ""]


def test_one_scan_of_answers(spark):
    """The plan reads answers once and shuffles them once."""
    answers = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", F.lit("meta").alias("stage"), F.lit(1).alias("attempt"), F.lit("{}").alias("payload"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.col("text").alias("source_text"))
    out = normalize.normalize(docs, answers, category.product_terms(spark, "x"))
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan parquet") == 2 and plan.count("Join") == 1
