"""Inputs: documents in any of several encodings, wrapped sources, price lists, search hits, prompts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.functions.text import shortened, strip

# Encodings in the order in which they are tried; where hits stand in an answer.
ENCODINGS = ["utf-8", "gb18030"]
HIT_PATHS = ["data.webPages.value", "webPages.value", "data.results", "results"]
MAX_HITS = 8
TASKS_A_CORE = 8


def decode(raw: bytes) -> str:
    """SRC21: by byte order mark, else the first encoding that fits, else with replacements."""
    if raw.startswith((b"\xff\xfe", b"\xfe\xff")):
        return raw.decode("utf-16", errors="replace")
    if raw.startswith(b"\xef\xbb\xbf"):
        return raw[3:].decode("utf-8", errors="replace")
    for name in ENCODINGS:
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", errors="replace")


@F.pandas_udf(T.StringType())
def decode_udf(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: None if x is None else decode(bytes(x)))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC12, SRC21: path, source_text of each file, of any depth of folders. Spark deals small files 32 a
    task, so many of them are read by a fixed number of tasks a core."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.coalesce(TASKS_A_CORE * spark.sparkContext.defaultParallelism).select("path", decode_udf("content").alias("source_text"))


def unwrapped(c: Column) -> Column:
    """SRC23: the text of a source: the field of a wrapped one, a JSON string decoded once more,
    else the text itself; wrapping again changes nothing."""
    s = strip(c)
    inner = F.get_json_object(s, "$.sourceJson")
    quoted = F.when(s.startswith('"') & s.endswith('"'), F.get(F.from_json(F.concat(F.lit("["), s, F.lit("]")), "array<string>"), F.lit(0)))
    return F.coalesce(inner, quoted, s)


def wrapped(c: Column) -> Column:
    return F.to_json(F.struct(unwrapped(c).alias("sourceJson")))


def prices(spark: SparkSession, path: str) -> DataFrame:
    """SRC20: model, input_cost, cached_cost, output_cost from a JSON file, whether the models stand
    at its top or under `data`."""
    whole = spark.read.text(path, wholetext=True).select(F.coalesce(F.get_json_object("value", "$.data"), F.col("value")).alias("j"))
    rows = whole.select(F.explode(F.from_json("j", "map<string,string>")).alias("model", "p"))
    at = lambda name: F.get_json_object("p", f"$.{name}").cast("double")
    return rows.select("model", at("input_cost_per_token").alias("input_cost"), at("cache_read_input_token_cost").alias("cached_cost"), at("output_cost_per_token").alias("output_cost"))


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """SRC19: category, template of each text file of a folder; a file's name is its category."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt")
    return files.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1).alias("category"), F.col("value").alias("template"))


def prompt(templates: DataFrame, category: str) -> str:
    """The template of a category; an unknown one is an error."""
    found = templates.filter(F.col("category") == category).first()
    if found is None:
        raise KeyError(f"no template for {category}")
    return found["template"]


def search_hits(answers: DataFrame, key: str = "org", payload: str = "payload") -> DataFrame:
    """SRC22, SET1: the hits of a search answer from wherever they stand, each url once, the first
    MAX_HITS."""
    kind = "array<struct<title:string,name:string,url:string,link:string,snippet:string,summary:string,siteName:string>>"
    lists = [F.coalesce(F.from_json(F.get_json_object(payload, f"$.{p}"), kind), F.array().cast(kind)) for p in HIT_PATHS]
    rows = answers.select(key, F.posexplode(F.concat(*lists)).alias("pos", "h"))
    url = strip(F.coalesce("h.url", "h.link"))
    rows = rows.select(key, "pos", strip(F.coalesce("h.title", "h.name")).alias("title"), url.alias("url"), shortened(strip(F.col("h.snippet"))).alias("snippet"), shortened(strip(F.col("h.summary"))).alias("summary"), strip(F.col("h.siteName")).alias("siteName")).filter("url != ''")
    first = rows.withColumn("n", F.row_number().over(W.partitionBy(key, "url").orderBy("pos"))).filter("n = 1")
    return first.withColumn("pos", F.row_number().over(W.partitionBy(key).orderBy("pos"))).filter(F.col("pos") <= MAX_HITS).drop("n")


def cited_sources(cited: DataFrame, hits: DataFrame, key: str = "org") -> DataFrame:
    """JON5: the hits that an answer cites (key, pos, url), in its order, each once; a placeholder row
    where none is real."""
    first = cited.groupBy(key, "url").agg(F.min("pos").alias("at"))
    real = first.join(hits.drop("pos"), [key, "url"])
    none = cited.select(key).distinct().join(real.select(key).distinct(), key, "left_anti")
    return real.unionByName(none.select(key, F.lit("").alias("url"), F.lit(0).alias("at")), allowMissingColumns=True)


def confident(c: Column) -> Column:
    """NUM11"""
    return F.coalesce(c.try_cast("double").between(0, 1), F.lit(False)) & ~F.lower(c.cast("string")).isin("true", "false")
