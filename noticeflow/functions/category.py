"""Product categories: the table of terms, lookups and the validation of answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noticeflow.functions.text import strip

# What separates terms of a row, and several values of an answer.
TERM_SEPARATORS = "[、,，]+"
VALUE_SEPARATORS = "[、,，;；/|\n]+"
#: Bytes of terms up to which an automaton of them is sent along with the subjects.
AUTOMATON_BYTES = 32 << 20
TRUE_ANSWERS = ["true", "yes", "1", "是", "匹配", "符合"]


def product_terms(spark: SparkSession, text: str, fallback: str = "") -> DataFrame:
    r"""CAT1: row_no, term_pos, term from a table with a row of peer terms per line; a literal \n
    counts as a line end. A term counts once, where it first stands. An empty table gives the
    fallback's."""
    lines = spark.createDataFrame([(text,)], "t string").select(F.posexplode(F.split(F.regexp_replace("t", r"\\n", "\n"), "\n")).alias("row_no", "line"))
    parts = lines.select("row_no", F.posexplode(F.split("line", TERM_SEPARATORS)).alias("term_pos", "term")).withColumn("term", strip(F.col("term"))).filter("term != ''")
    first = parts.withColumn("n", F.row_number().over(W.partitionBy("term").orderBy("row_no", "term_pos"))).filter("n = 1").drop("n")
    if fallback and first.isEmpty():
        return product_terms(spark, fallback)
    return first


def folded(c: Column) -> Column:
    """Without white space of any kind."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")


def exact_term(subjects: DataFrame, terms: DataFrame, subject: str = "subject") -> DataFrame:
    """CAT2, JON3: subjects and the term equal to each but for white space (the first in the table)."""
    first = terms.groupBy(folded(F.col("term")).alias("_key")).agg(F.min_by("term", F.struct("row_no", "term_pos")).alias("matched_term"))
    return subjects.join(first, folded(F.col(subject)) == F.col("_key"), "left").drop("_key")


def lookup(terms: DataFrame, most_bytes: int = AUTOMATON_BYTES) -> Callable[[Column, Column, Column], Column] | None:
    """CAT2-4 for a notice's rows at once: a function of their folded subjects, and of the places and
    payloads of recorded answers, that gives arrays: term (equal but for white space, the first in the
    table), answer (of the row's place, the first of several), known (whether the answer is a term).
    None if the table has more than most_bytes."""
    known = terms.filter("term is not null")
    if known.agg(F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("n")).first().n > most_bytes:
        return None
    rows = known.select("term", folded(F.col("term")).alias("key")).orderBy("row_no", "term_pos").collect()
    exact = {r.key: r.term for r in reversed(rows)}
    names = {r.term for r in rows}

    @F.pandas_udf("term array<string>, answer array<string>, known array<boolean>")
    def look(subjects: pd.Series, places: pd.Series, payloads: pd.Series) -> pd.DataFrame:
        out = {"term": [], "answer": [], "known": []}
        for own, at, said in zip(subjects, places, payloads, strict=True):
            answers = dict(zip(reversed(at), reversed(said), strict=True))
            got = [answers.get(i) for i in range(len(own))]
            out["term"].append([exact.get(x) for x in own])
            out["answer"].append(got)
            out["known"].append([a in names for a in got])
        return pd.DataFrame(out)

    return lambda subjects, places, payloads: look(F.coalesce(subjects, F.array()), places, F.transform(payloads, lambda p: F.get_json_object(p, "$.productCategory")))


def contained_term(subjects: DataFrame, terms: DataFrame, key: str, subject: str = "subject", automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """JON4: the longest term that a subject contains, the first in the table of these; null where
    there is none. One pass over each subject with an automaton of all terms; a table of more than
    automaton_bytes is joined with the subjects' pieces instead."""
    known = terms.filter("term is not null and term != ''")
    size = known.agg(F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("n")).first().n
    if size == 0:
        return subjects.withColumn("matched_term", F.lit(None).cast("string"))
    if size > automaton_bytes:
        return _joined_term(subjects, known, key, subject)
    ranked = [r.term for r in known.groupBy("term").agg(F.min(F.struct("row_no", "term_pos")).alias("at")).orderBy(F.length("term").desc(), "at").select("term").collect()]
    return subjects.withColumn("matched_term", F.pandas_udf(first_contained(ranked), "string")(F.col(subject)))


def first_contained(ranked: list[str]) -> Callable[[Iterator[pd.Series]], Iterator[pd.Series]]:
    """The function that finds, for each text, the first of the terms, in their order, that it holds."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for i, term in enumerate(ranked):
            automaton.add_word(term, i)
        automaton.make_automaton()
        for texts in batches:
            found = (None if t is None else min((i for _, i in automaton.iter(t)), default=None) for t in texts)
            yield pd.Series([None if i is None else ranked[i] for i in found], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return run


def _joined_term(subjects: DataFrame, terms: DataFrame, key: str, subject: str) -> DataFrame:
    """Each subject is cut into its pieces of the lengths that terms have, so this is an equi-join."""
    sizes = [r.n for r in terms.select(F.length("term").alias("n")).distinct().collect()]  # a term's lengths: few

    def of_size(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(subject) - n + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.substring(F.col(subject), i, F.lit(n)))

    found = subjects.select(key, F.explode(F.array_distinct(F.concat(*(of_size(n) for n in sorted(sizes))))).alias("term")).join(terms, "term")
    best = found.groupBy(key).agg(F.min_by("term", F.struct(-F.length("term"), "row_no", "term_pos")).alias("matched_term"))
    return subjects.join(best, key, "left")


def answer_kind(answer: Column, in_table: Column) -> Column:
    """CAT3: what an answer is."""
    s = strip(answer)
    return F.when(s == "", "no_match").when(in_table, "exact").when(F.size(F.split(s, VALUE_SEPARATORS)) > 1, "multi_value").otherwise("not_in_table")


def selected(prompt: Column, answer: Column) -> Column:
    """PRJ23: whether a notice is of the prompt's category: with ALL any is; else the recorded answer
    must say so, and one that doesn't decide leaves it out."""
    return F.when(F.upper(strip(prompt)) == "ALL", True).otherwise(F.lower(strip(answer)).isin(TRUE_ANSWERS))


def settled(term: Column, answer: Column, known: Column) -> Column:
    """The exact term, else the answer's value; '' without either, whatever the row said itself."""
    return F.coalesce(term, answer_value(answer, answer_kind(answer, known)), F.lit(""))


def answer_value(answer: Column, kind: Column) -> Column:
    """CAT4: the first value of several; any other answer as it is."""
    s = strip(answer)
    parts = F.filter(F.transform(F.split(s, VALUE_SEPARATORS), strip), lambda x: x != "")
    return F.when(kind == "no_match", "").when(kind == "multi_value", F.coalesce(F.get(parts, F.lit(0)), F.lit(""))).otherwise(s)
