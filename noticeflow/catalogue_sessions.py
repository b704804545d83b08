"""Queries over sessions, first sightings and search rounds, on the event table's own rows, and
records of a second field catalog."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.catalogue import query, table
from noticeflow import catalog
from noticeflow.plans import answers, normalize
from noticeflow.streaming import sessions as ss

UNTIL = datetime(2024, 1, 20)


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session for each user: errors and purchases end it."""
    kind = F.when(F.col("event_type") == "purchase", "done").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").withColumn("kind", kind)


# Events up to the first end, before the deadline of two days; a heartbeat after each six silent hours.
@query("""with e as (select user_id, event_id, ts, case event_type when 'purchase' then 'done' else event_type end as kind from events where user_id is not null and ts < timestamp '2024-01-20'),
a as (select *, coalesce(max(cast(kind in ('done', 'error') as int)) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as ended, min(ts) over (partition by user_id) + interval 2 day as deadline from e),
k as (select * from a where ended = 0 and ts < deadline),
n as (select *, lead(ts) over (partition by user_id order by ts, event_id) as following from k),
q as (select *, following is null and kind not in ('done', 'error') as is_last, case when following is not null then following when kind in ('done', 'error') then ts else least(deadline, timestamp '2024-01-20') end as quiet from n),
b as (select user_id, ts + to_hours(cast(6 * i as integer)) as "at" from q, unnest(range(1, 10)) as u(i) where ts + to_hours(cast(6 * i as integer)) < quiet)
select user_id, ts as "at", kind, cast(null as varchar) as message from k
union all select user_id, "at", 'heartbeat', null from b
union all select user_id, deadline, 'error', 'timeout' from q where is_last and deadline < timestamp '2024-01-20'""")
def q_live_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.session_events(_sessions(spark, sf_dir), "user_id", "ts", ["event_id"], UNTIL, "kind", 6 * 3600, 2 * 86400)


# A user's key is settled by the first event worth over 50.
@query("""select event_id, user_id, case when coalesce(max(cast(value > 50 as int)) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) = 1 then 'skipped_duplicate' else 'process' end as decision from events""")
def q_settled_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.settled_first(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("value") > 50).select("event_id", "user_id", "decision")


# A user's events are a search's rounds: views and clicks call the tool (clicks worth under 20 a second
# time, for nothing), errors another tool, the others answer.
@query("""with e as (select user_id, event_id, event_type, value, row_number() over (partition by user_id order by ts, event_id) - 1 as round from events),
r as (select user_id, event_id, round, event_type in ('view', 'click', 'error') as calls, event_type = 'error' as other, event_type = 'click' and value < 20 as blank from e where round <= 10),
t as (select *, case when round = 10 or not calls then 'answered' when other then 'unsupported_tool' when blank then 'empty_query' end as how from r),
x as (select user_id, min(round) filter (how is not null) as round, min(round) filter (calls and round < 10) as first_call from t group by user_id)
select x.user_id, case when x.round is null then 'no_answer' when t.how = 'answered' and not coalesce(first_call < x.round, false) then 'no_search' else t.how end as outcome, cast(x.round as int) as round,
  case when t.how = 'answered' and first_call < x.round then t.event_id end as answer
from x left join t on t.user_id = x.user_id and t.round = x.round""")
def q_search_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    place = (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("round")
    call = lambda name, q: F.struct(F.lit(name).alias("name"), q.alias("query"))
    named = F.col("event_type")
    tools = F.when(named == "view", F.array(call("web_search", named))).when((named == "click") & (F.col("value") < 20), F.array(call("web_search", named), call("web_search", F.lit(" "))))
    tools = tools.when(named == "click", F.array(call("web_search", named))).when(named == "error", F.array(call("browse", named)))
    rounds = table(spark, sf_dir, "events").select("user_id", place, tools.alias("tools"), F.col("event_id").cast("string").alias("payload"))
    ended = answers.search_rounds(rounds, "user_id")
    return ended.select("user_id", "outcome", "round", F.col("payload").cast("bigint").alias("answer"))


SECOND_CATALOG = """
fields:
  - {key: lotCount, name: lots, type: number, stage: size}
  - {key: tongue, name: language, stage: flat, required: true}
  - {key: isToxic, name: toxic, type: boolean, stage: flags}
  - {key: marks, name: marks, type: array, stage: flags}
  - {key: announcementType, name: type}
"""


# Other fields, stages and types than the module's own; labels are the recorded answers.
@query("""select d.doc_id, 't' || d.doc_id as "announcementName", coalesce(d.source, '-') as "announcementContent", cast(l.quality as double) * 10000 as "lotCount", case when l.doc_id is null then '' else coalesce(d.lang, '') end as tongue,
coalesce(l.toxic = 1, false) as "isToxic", case when l.doc_id is null then '' when d.doc_id % 3 = 0 then '中标' else '招标' end as "announcementType",
case when l.doc_id is null then '' when l.quality = 1 then 'a,q1' else 'a,q0' end as marks, false as "inputTruncated" from documents d left join labels l on d.doc_id = l.doc_id""")
def q_second_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = catalog.fields_from_yaml(SECOND_CATALOG)
    docs, k = table(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    sources = docs.select("doc_id", F.concat(F.lit("# 标题\n"), F.lit("t"), k, F.lit("\n# 正文\n"), F.coalesce("source", F.lit("-"))).alias("source_text"))
    known = table(spark, sf_dir, "labels").join(docs.select("doc_id", "lang"), "doc_id")
    said = lambda stage, attempt, **values: F.struct(F.lit(stage).alias("stage"), F.lit(attempt).alias("attempt"), F.to_json(F.struct(*(v.alias(n) for n, v in values.items()))).alias("payload"))
    q, t = F.col("quality").cast("string"), F.col("toxic").cast("string")
    kind = F.when(F.col("doc_id") % 3 == 0, "不明").otherwise("招标公告")
    rows = F.array(
        said("size", 1, lotCount=F.concat(q, F.lit("万元"))), said("size", 2, lotCount=F.lit("7")), said("flags", 1, isToxic=t, marks=F.array(F.lit(" a "), F.lit("无"), F.concat(F.lit("q"), q))),
        said("meta", 1, tongue=F.coalesce("lang", F.lit("无")), announcementType=kind), said("type_repair", 1, announcementType=F.lit("中标公告")), said("contacts", 1, buyerName=F.lit("not asked")),
    )
    responses = known.select("doc_id", F.explode(rows).alias("a")).select("doc_id", "a.*")
    out = normalize.extracted(sources, responses, own)
    return out.select("doc_id", "announcementName", "announcementContent", "lotCount", "tongue", "isToxic", "announcementType", F.array_join("marks", ",").alias("marks"), "inputTruncated")
