"""Plans over recorded answers: content to Markdown, and the organisation above another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.functions import jsonx, text
from noticeflow.sources import inputs

# Fixed value: what stands for sources where an answer cites none that the search has found.
NO_SOURCE = "匹配失败"
# Rounds with a search that are allowed, and how a search can end.
MAX_ROUNDS = 10
ANSWERED, NO_SEARCH, NO_ANSWER, OTHER_TOOL, NO_QUERY = "answered", "no_search", "no_answer", "unsupported_tool", "empty_query"


def content_to_markdown(contents: DataFrame, responses: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """EXT9: key, markdown: the first recorded answer without fences and with its escapes undone; ''
    for empty contents, null where nothing was recorded."""
    said = responses.filter("stage = 'markdown'").groupBy(key).agg(F.min_by("payload", "attempt").alias("_said"))
    out = text.unescape_markdown(text.strip_fences(F.col("_said")))
    return contents.join(said, key, "left").select(key, F.when(text.strip(F.col(content)) == "", "").when(F.col("_said").isNotNull(), out).alias("markdown"))


def affiliates(orgs: DataFrame, responses: DataFrame, key: str = "org") -> DataFrame:
    """EXT11: key, affiliate: the company that a name belongs to; the name itself where no answer says."""
    said = responses.filter("stage = 'affiliate'").groupBy(key).agg(F.min_by("payload", "attempt").alias("_said"))
    named = F.nullif(text.strip(F.get_json_object(jsonx.lenient_object(F.col("_said")), "$.affiliateOrgName")), F.lit(""))
    return orgs.join(said, key, "left").select(key, F.coalesce(named, text.strip(F.col(key))).alias("affiliate"))


def search_rounds(rounds: DataFrame, key: str = "org", tool: str = "web_search", most: int = MAX_ROUNDS) -> DataFrame:
    """EXT11: how each key's search ended: key, outcome, round and payload. rounds: key, round (from 0),
    tools array<struct<name, query>> and payload, one recorded round a row. Rounds with calls go on,
    unless one asks for another tool or for nothing; the first without calls is the answer, if there
    was a search before. After `most` rounds of calls the one recorded next is the answer whatever it
    calls, as no tools are offered then. One aggregation by key, from rows that are each judged alone."""
    searching = F.coalesce(F.size("tools"), F.lit(0)) > 0
    first_bad = F.filter("tools", lambda t: (F.coalesce(t["name"], F.lit("")) != tool) | (F.coalesce(text.strip(t["query"]), F.lit("")) == ""))
    other = F.coalesce(F.element_at(first_bad, 1)["name"], F.lit("")) != tool
    how = F.when(F.col("round") == most, ANSWERED).when(~searching, ANSWERED).when(F.size(first_bad) > 0, F.when(other, OTHER_TOOL).otherwise(NO_QUERY))
    judged = rounds.filter((F.col("round") >= 0) & (F.col("round") <= most)).select(key, "round", "payload", how.alias("_how"), (searching & (F.col("round") < most)).alias("_call"))
    ends = F.when(F.col("_how").isNotNull(), F.struct("round", F.col("_how").alias("how"), "payload"))
    found = judged.groupBy(key).agg(F.min_by(ends, F.when(F.col("_how").isNotNull(), F.col("round"))).alias("e"), F.min(F.when(F.col("_call"), F.col("round"))).alias("_first"))
    searched = F.col("_first") < F.col("e.round")
    outcome = F.when(F.col("e").isNull(), NO_ANSWER).when((F.col("e.how") == ANSWERED) & ~F.coalesce(searched, F.lit(False)), NO_SEARCH).otherwise(F.col("e.how"))
    return found.select(key, outcome.alias("outcome"), F.col("e.round").alias("round"), F.when(outcome == ANSWERED, F.col("e.payload")).alias("payload"))


def searched_parents(orgs: DataFrame, rounds: DataFrame, responses: DataFrame, hits: DataFrame, key: str = "org", tool: str = "web_search") -> DataFrame:
    """EXT11 with rounds: what `parents` gives for the answers of search_rounds, which can cite the
    hits (key, round, pos, url, title) of the rounds before them; of a url the first hit counts."""
    ended = search_rounds(rounds, key, tool)
    asked = F.col("stage") == "parent"
    said = ended.filter(F.col("outcome") == ANSWERED).select(key, F.lit("parent").alias("stage"), F.lit(1).alias("attempt"), "payload")
    known = hits.withColumnRenamed("round", "_round").join(ended.select(key, "round"), key).filter(F.col("_round") < F.col("round"))
    first = known.groupBy(key, "url").agg(F.min_by("title", F.struct("_round", "pos")).alias("title"), F.min(F.struct("_round", "pos")).alias("_at"))
    first = first.select(key, (F.col("_at._round") * 1000 + F.col("_at.pos")).cast("int").alias("pos"), "url", "title")
    return parents(orgs, responses.filter(~asked).select(key, "stage", "attempt", "payload").unionByName(said), first, key)


def parents(orgs: DataFrame, responses: DataFrame, hits: DataFrame, key: str = "org") -> DataFrame:
    """EXT11, JON5: key, affiliate, parent, confidence and sources (title and url of the hits that the
    answer cites, in its order, each once; a placeholder if none is real). parent is null where no
    answer is valid: a name, a confidence from 0 to 1 and a list of urls."""
    said = responses.filter("stage = 'parent'").groupBy(key).agg(F.min_by("payload", "attempt").alias("_said"))
    said = said.select(key, F.from_json(jsonx.lenient_object(F.col("_said")), "parentOrgName string, confidence string, sourceUrls array<string>").alias("p"))
    valid = said.filter(F.col("p.parentOrgName").isNotNull() & inputs.confident(F.col("p.confidence")) & F.col("p.sourceUrls").isNotNull()).select(key, "p.*")
    cited = valid.select(key, F.posexplode_outer("sourceUrls").alias("pos", "url")).withColumn("url", text.strip(F.col("url"))).withColumn("pos", F.coalesce("pos", F.lit(0)))
    real = inputs.cited_sources(cited, hits, key)
    shown = lambda c: F.when(F.col("url") == "", NO_SOURCE).otherwise(F.col(c))
    sources = real.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", shown("title").alias("title"), shown("url").alias("url")))).alias("_s"))
    plain = F.transform("_s", lambda s: F.struct(s["title"].alias("title"), s["url"].alias("url")))
    found = valid.join(sources, key).select(key, F.col("parentOrgName").alias("parent"), F.col("confidence").cast("double").alias("confidence"), plain.alias("sources"))
    return affiliates(orgs, responses, key).join(found, key, "left")
