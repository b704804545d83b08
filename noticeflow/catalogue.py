"""The query catalogue: each query re-targets an operator at the driver's tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noticeflow.functions import address, category, dates, hashing, html, jsonx, lots, money, text, types
from noticeflow.operators import attempts
from noticeflow.operators.dedupe import first_seen, unique_names, unseen
from noticeflow.plans import budget
from noticeflow.streaming import events as ev

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
LIMIT = 4000.0


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _all() -> None:
    """The other modules register their queries when they are first imported."""
    from noticeflow import catalogue_inputs, catalogue_records, catalogue_sessions, catalogue_texts  # noqa: F401


def queries() -> dict[str, Query]:
    _all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col_of(c) -> F.Column:
    return F.col(c) if isinstance(c, str) else c


# ------------------------------------------------------------------ budget and events


# Days are those of the budget's zone, eight hours ahead of the table's times.
@query("""select cast(ts + interval 8 hour as date) as day, round(sum(value), 2) as spent_usd, sum(value) >= 4000 as stopped
from events where event_type = 'purchase' group by 1""")
def q_daily_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").filter(F.col("event_type") == "purchase")
    return budget.daily_budget(events, F.col("ts"), F.col("value"), LIMIT)


_RUNNING = """select event_id, cast(ts + interval 8 hour as date) as day, sum(value) over (partition by cast(ts + interval 8 hour as date) order by ts, event_id rows unbounded preceding) as running
from events where event_type = 'purchase'"""


@query(f"""with r as ({_RUNNING}) select event_id, day, round(running, 2) as running,
max(case when running >= 4000 then 1 else 0 end) over (partition by day order by event_id rows unbounded preceding) = 1 as stopped from r""")
def q_budget_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").filter("event_type = 'purchase'")
    return budget.running_spend(events, "ts", "value", "event_id", LIMIT).select("event_id", "day", F.round("running", 2).alias("running"), "stopped")


@query(f"""with r as ({_RUNNING}) select day, min(event_id) as event_id from r where running >= 4000 group by day""")
def q_budget_alert_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").filter("event_type = 'purchase'")
    return budget.alerts(events, "ts", "value", "event_id", LIMIT).select("day", "event_id")


@query("""select event_id, round(coalesce(greatest(p - c, 0) * 6e-7 + c * 6e-8 + o * 3.5e-6, 0), 10) as cost_usd from (
select event_id, case when event_type <> 'error' then event_id % 5000 end as p, event_id % 700 as c, user_id % 300 as o from events)""")
def q_call_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = table(spark, sf_dir, "events").select("event_id", F.lit("m").alias("model"), F.when(F.col("event_type") != "error", F.col("event_id") % 5000).alias("prompt_tokens"), (F.col("event_id") % 700).alias("cached_tokens"), (F.col("user_id") % 300).alias("completion_tokens"))
    prices = spark.createDataFrame([("m", 6e-7, 6e-8, 3.5e-6)], "model string, input_cost double, cached_cost double, output_cost double")
    return budget.call_cost(usage, prices).select("event_id", F.round("cost_usd", 10).alias("cost_usd"))


@query("""select event_id, user_id, event_type from events qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1""")
def q_first_seen_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_seen(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query("""select o_orderkey, o_custkey from orders o where not exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey and l.l_returnflag = 'R')""")
def q_ledger_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return unseen(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ledger, ["o_orderkey"], ["o_custkey"])


@query("""with g as (select event_id, user_id, ts, lag(ts) over (partition by user_id order by ts, event_id) as p from events),
s as (select event_id, user_id, date_diff('second', p, ts) as gap_s from g where p is not null)
select event_id, user_id, cast(gap_s as bigint) as gap_s, cast(floor(gap_s / 1800) as bigint) as heartbeats from s where gap_s >= 1800""")
def q_idle_heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.silences(table(spark, sf_dir, "events"), ["user_id"], "ts", ["event_id"], 1800).select("event_id", "user_id", "gap_s", "heartbeats")


@query("""select event_id, user_id, event_type from (select *, coalesce(sum(case when event_type in ('purchase', 'error') then 1 else 0 end)
over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as ended from events) where ended = 0""")
def q_until_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.until_terminal(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], terminal=["purchase", "error"]).select("event_id", "user_id", "event_type")


@query("""select event_id, event_type = 'click' and row_number() over (partition by cast(ts as date), event_type = 'click' order by ts, event_id) > 50 as dropped from events""")
def q_bounded_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("batch", F.to_date("ts")).withColumn("kind", F.when(F.col("event_type") == "click", "item").otherwise("control"))
    return ev.delivered(events, ["ts", "event_id"], "kind", 50).select("event_id", "dropped")


@query("""select event_id, 'data: {"event":"' || case when event_type = 'purchase' then 'done' else 'error' end || '","request_id":' || event_id || '}' || chr(10) || chr(10) as frame from events""")
def q_sse_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "success").otherwise(F.col("event_type"))
    body = F.to_json(F.struct(ev.event_of_status(status).alias("event"), F.col("event_id").alias("request_id")))
    return table(spark, sf_dir, "events").select("event_id", ev.frame(body).alias("frame"))


@query("""with a as (select user_id, event_id, event_type, row_number() over (partition by user_id order by ts, event_id) as attempt from events)
select user_id, coalesce(min(v) filter (ok and m), min(v) filter (attempt = 1)) as value from (
select *, 'e' || event_id as v, event_type = 'click' as ok, attempt = min(case when event_type = 'click' and attempt <= 5 then attempt end) over (partition by user_id) as m from a) group by user_id""")
def q_retry_first_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    tries = table(spark, sf_dir, "events").withColumn("attempt", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    return attempts.first_valid(tries, "user_id", F.concat(F.lit("e"), F.col("event_id").cast("string")), F.col("event_type") == "click", 5)


# ------------------------------------------------------------------ names, money, dates


@query("""with t as (select p_partkey, regexp_replace(p_name, '[\\\\/:*?"<>|]', '_', 'g') as title, cast(p_size as varchar) as d from part),
n as (select *, row_number() over (partition by title, d order by p_partkey) as n from t)
select p_partkey, title || '_' || d || case when n = 1 then '' else '_' || n end || '.json' as file_name from n""")
def q_unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    return unique_names(part, text.file_name(F.col("p_name")), F.col("p_size").cast("string"), ["p_partkey"]).select("p_partkey", "file_name")


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_orderkey % 3 = 2 and l_linenumber > 1 then null
else cast(l_orderkey as double) * case l_orderkey % 3 when 0 then 10000 when 1 then 100000000 else 1 end end as yuan from lineitem""")
def q_money_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, kind = F.col("l_orderkey").cast("string"), F.col("l_orderkey") % 3
    said = F.when(kind == 0, F.concat(n, F.lit("万元"))).when(kind == 1, F.concat(F.lit("￥"), n, F.lit("亿"))).when(F.col("l_linenumber") > 1, F.concat(n, F.lit("~"), n, F.lit("元"))).otherwise(F.concat(F.lit(" 人民币"), n, F.lit("元 ")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", money.to_yuan(said).alias("yuan"))


_MONEY = [("100万", 1000000.0), ("1.5万元", 15000.0), ("3.5亿", 350000000.0), ("￥1,234.56元", 1234.56), ("1，234", 1234.0), ("97.00,98.50", None), ("1~2万", None), ("100-200", None), ("-5", None), ("1,23", None), ("50台", 50.0), ("1万2千", None), ("人民币壹佰万元", None), ("", None)]


def _literals(rows: list[tuple], names: str) -> str:
    said = lambda x: "null" if x is None else str(x) if isinstance(x, float) else "'" + x + "'"
    return f"(values {', '.join('(' + ', '.join(map(said, r)) + ')' for r in rows)}) as v({names})"


@query(f"select n_nationkey, said, cast(yuan as double) as yuan from nation, {_literals(_MONEY, 'said, yuan')}")
def q_money_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.explode(F.array(*(F.lit(x) for x, _ in _MONEY)))
    return table(spark, sf_dir, "nation").select("n_nationkey", said.alias("said")).withColumn("yuan", money.to_yuan(F.col("said")))


@query("""select p_partkey, p_size % 4 < 2 as valid, p_size > 0 as non_zero, p_size % 4 = 3 as empty from part""")
def q_range_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, kind = F.col("p_size").cast("string"), F.col("p_size") % 4
    said = F.when(kind == 0, F.concat(n, F.lit(" ~ "), n)).when(kind == 1, F.concat(n, F.lit(".5~"), n)).when(kind == 2, F.concat(n, F.lit("~"))).otherwise(F.lit("0"))
    return table(spark, sf_dir, "part").select("p_partkey", money.is_range(said).alias("valid"), money.non_zero(n).alias("non_zero"), money.empty_quantity(said).alias("empty"))


@query("""select s_suppkey, coalesce(try_cast(t as double) <> 0, true) and t <> '' as non_zero, t in ('', '0') as empty
from (select s_suppkey, case s_suppkey % 4 when 0 then '0' when 1 then '' when 2 then 'n/a' else cast(s_suppkey as varchar) end as t from supplier)""")
def q_nonzero(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 4
    t = F.when(k == 0, "0").when(k == 1, "").when(k == 2, "n/a").otherwise(F.col("s_suppkey").cast("string"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", money.non_zero(t).alias("non_zero"), money.empty_quantity(t).alias("empty"))


@query("""select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day, case when o_orderkey % 2 = 0 then strftime(o_orderdate, '%Y-%m-%d') end as open_day from orders""")
def q_date_ymd(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    said = F.concat(F.lit("on "), F.year(d).cast("string"), F.lit("年"), F.month(d).cast("string"), F.lit("月"), F.dayofmonth(d).cast("string"), F.lit("日 10:00"))
    day = F.date_format(d, "yyyy-MM-dd")
    strict = F.when(F.col("o_orderkey") % 2 == 0, day).otherwise(F.date_format(d, "yyyy/MM/dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.normalize_date(said).alias("day"), dates.bid_open_date(strict).alias("open_day"))


@query("""select o_orderkey, case when try_strptime(t, '%Y-%m-%d') is not null then t end as open_day
from (select o_orderkey, printf('%04d-%02d-%02d', 1990 + o_orderkey % 10, 1 + o_orderkey % 12, 1 + o_orderkey % 31) as t from orders)""")
def q_bid_open_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    t = F.format_string("%04d-%02d-%02d", 1990 + k % 10, 1 + k % 12, 1 + k % 31)
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.bid_open_date(t).alias("open_day"))


@query("""select o_orderkey from orders where strftime(o_orderdate, '%Y-%m-%d') between '1995-01-01' and '1996-06-30'""")
def q_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").filter(dates.in_range(day, F.lit("1995-01-01"), F.lit("1996-06-30"))).select("o_orderkey")


@query("""select o_orderkey, coalesce(case when p is null then d > '1996-01-01' when d is null then p between '1995-01-01' and '1996-06-30'
else d > '1996-01-01' and p between '1995-01-01' and '1996-06-30' end, false) as kept from (select o_orderkey,
case when o_orderkey % 3 > 0 then strftime(o_orderdate, '%Y-%m-%d') end as p, case when o_orderkey % 5 > 0 then strftime(o_orderdate, '%Y-%m-%d') end as d from orders)""")
def q_deadline_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    published, deadline = F.when(F.col("o_orderkey") % 3 > 0, day), F.when(F.col("o_orderkey") % 5 > 0, day)
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.deadline_rule(published, deadline, F.lit("1996-01-01"), F.lit("1995-01-01"), F.lit("1996-06-30")).alias("kept"))


# ------------------------------------------------------------------ types, lots, categories, addresses

_TYPES = [("公开招标", None), ("中标候选人公示", "候选"), ("澄清变更公告", "答疑"), ("单一来源采购公告", "招标"), ("竞争性谈判采购公告", "竞谈"), ("竞争性磋商", None), ("流标公告", "终止"), ("合同", "合同"), ("  ", None)]
_KINDS = [("第一中标候选人", "中标候选人"), ("未中标候选人", "非中标候选人"), ("成交供应商", "中标"), ("其他", ""), ("否决投标", "非中标候选人")]
_LOTS = [("标段二", "标段二"), ("第3包", "标段三"), ("包件12", "标段十二"), ("标1包2", "标段一"), ("二十一标段", "标段二十一"), ("10", "标段十"), ("A包", None), ("招标2026", "标段二千零二十六")]
_SUBJECTS = [("标1包2:推土机", "推土机"), ("三山岛金矿", "三山岛金矿"), ("A：B：C", "C"), ("第二标段 - 挖掘机\n二期", "挖掘机")]
_PLACES = [("中国", "浙江", "", "", "province_missing_suffix"), ("中国", "京", "", "", "province_abbrev"), ("中国", "北京市", "天津市", "", "municipality_city_mismatch"), ("菲律宾", "Laguna", "Binan", "", "ok_non_cn"), ("中国", "台湾省", "", "", "taiwan_must_be_cn_taiwan"), ("", "", "", "", "ok"), ("中国", "浙江省", "宁波", "", "city_missing_suffix"), ("中国", "浙江省", "杭州", "", "ok"), ("中国", "浙江省", "杭州市", "西湖", "district_missing_suffix"), ("中国", "北京", "", "", "province_missing_suffix_municipality"), ("中国", "浙江省", "上海", "", "city_missing_suffix_municipality"), ("中国", "北京市", "北京市", "海淀区", "ok")]


def _over(spark: SparkSession, sf_dir: str, rows: list[tuple], names: list[str]) -> DataFrame:
    """Each row of literals for each nation."""
    items = F.explode(F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(r, names, strict=False))) for r in rows)))
    return table(spark, sf_dir, "nation").select("n_nationkey", items.alias("i")).select("n_nationkey", "i.*")


def _pairs_sql(rows: list[tuple], out: str) -> str:
    return f"select n_nationkey, said, cast({out} as varchar) as {out} from nation, {_literals(rows, f'said, {out}')}"


@query(_pairs_sql(_TYPES, "notice_type"))
def q_type_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, _TYPES, ["said"]).withColumn("notice_type", types.announcement_type(F.col("said")))


@query(_pairs_sql(_KINDS, "kind"))
def q_candidate_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, _KINDS, ["said"]).withColumn("kind", types.candidate_type(F.col("said")))


@query(_pairs_sql(_LOTS, "lot"))
def q_lot_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, _LOTS, ["said"]).withColumn("lot", lots.lot_number(F.col("said")))


@query(_pairs_sql([(a.replace("\n", "' || chr(10) || '"), b) for a, b in _SUBJECTS], "subject"))
def q_lot_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, _SUBJECTS, ["said"]).withColumn("subject", lots.lot_subject(F.col("said")))


@query("""with d as (select p_partkey, p_partkey % 10000 as n from part), x as (select p_partkey, n, n // 1000 as a, n // 100 % 10 as b, n // 10 % 10 as c, n % 10 as e from d),
w as (select p_partkey, n, case when a > 0 then substr('零一二三四五六七八九', cast(a + 1 as bigint), 1) || '千' else '零' end || case when b > 0 then substr('零一二三四五六七八九', cast(b + 1 as bigint), 1) || '百' else '零' end
|| case when c > 0 then substr('零一二三四五六七八九', cast(c + 1 as bigint), 1) || '十' else '零' end || case when e > 0 then substr('零一二三四五六七八九', cast(e + 1 as bigint), 1) else '零' end as t from x)
select p_partkey, case when n > 0 then '标段' || regexp_replace(regexp_replace(regexp_replace(t, '零+', '零', 'g'), '^零|零$', '', 'g'), '^一十', '十') end as lot from w""")
def q_lot_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("p_partkey") % 10000).cast("string")
    return table(spark, sf_dir, "part").select("p_partkey", lots.lot_number(F.concat(F.lit("第"), n, F.lit("包"))).alias("lot"))


@query("""select conv_id, turn, i as pos, 'c' || conv_id || '-' || i as candidate, cast(case when turn % 3 = 0 or n = 2 then turn when i < n - 1 then turn + i end as double) as price
from (select *, unnest(range(n)) as i from (select conv_id, turn, 1 + turn % 4 as n from conversations))""")
def q_lot_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (1 + F.col("turn") % 4).cast("int")
    part = lambda f, k: F.array_join(F.transform(F.sequence(F.lit(0), k - 1), f), ",")
    names = part(lambda i: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), i.cast("string")), n)
    prices = F.when(F.col("turn") % 3 == 0, F.col("turn").cast("string")).when(n > 1, F.concat(part(lambda i: (F.col("turn") + i).cast("string"), n - 1), F.when(n == 2, F.lit(",x,y")).otherwise(F.lit(",x")))).otherwise(F.lit("x,y"))
    empty = F.lit("")
    raw = F.array(F.struct(F.lit("1").alias("lotNumber"), empty.alias("lotName"), F.lit("中标").alias("type"), names.alias("candidates"), prices.alias("candidatePrices"), empty.alias("winner"), empty.alias("winningAmount")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", n.alias("n"), lots.candidates(raw).alias("rows")).select("conv_id", "turn", "n", F.posexplode("rows").alias("pos", "r"))
    return rows.select("conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), F.col("r.candidates").alias("candidate"), F.col("r.candidatePrices").alias("price"))  # one valid price holds for all candidates


@query("""with l as (select l_orderkey, l_linenumber, min(l_partkey) as part from lineitem group by all), p as (select * from l where l_linenumber <= 2), c as (select * from l where l_linenumber > 2)
select l_orderkey, l_linenumber, part, 'product' as origin from p union all
select l_orderkey, min(l_linenumber), part, 'candidate' from c where not exists (select 1 from p where p.l_orderkey = c.l_orderkey and p.part = c.part) group by l_orderkey, part""")
def q_supplement(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"))
    none = F.lit("")
    lot = F.lit("标段一").alias("lotNumber")
    said = lambda c: c.cast("string")
    product = lambda x: F.struct(lot, none.alias("lotName"), said(x["part"]).alias("subjects"), none.alias("productCategory"), none.alias("models"), F.lit(None).cast("double").alias("unitPrices"), said(x["l_linenumber"]).alias("quantities"), none.alias("quantityUnit"))
    candidate = lambda x: F.struct(lot, F.concat(F.lit("标1:"), said(x["part"])).alias("lotName"), none.alias("type"), said(x["l_linenumber"]).alias("candidates"), F.lit(None).cast("double").alias("candidatePrices"))
    own = lines.filter("l_linenumber is not null").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "part"))).alias("l"))
    own = own.select("l_orderkey", F.transform(F.filter("l", lambda x: x["l_linenumber"] <= 2), product).alias("p"), F.transform(F.filter("l", lambda x: x["l_linenumber"] > 2), candidate).alias("c"))
    done = own.select("l_orderkey", F.size("p").alias("n"), "c", F.posexplode(lots.supplemented(F.col("p"), F.col("c"))).alias("i", "r"))
    line = F.when(F.col("i") < F.col("n"), F.col("r.quantities")).otherwise(F.get(F.filter("c", lambda x: x["lotName"] == F.col("r.lotName")), F.lit(0))["candidates"])
    return done.select("l_orderkey", line.cast("int").alias("l_linenumber"), F.col("r.subjects").cast("bigint").alias("part"), F.when(F.col("i") < F.col("n"), "product").otherwise("candidate").alias("origin"))


@query("""select l_orderkey, count(*) as n from lineitem where not (l_linenumber % 2 = 0 and (cast(l_quantity as bigint) % 5 = 0 or l_returnflag = 'N')) group by l_orderkey""")
def q_effective_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.struct(F.when(F.col("l_linenumber") % 2 == 0, "x").otherwise("-").alias("subjects"), F.when(F.col("l_quantity").cast("bigint") % 5 == 0, "0").otherwise("3").alias("quantities"), F.when(F.col("l_returnflag") == "N", "无").otherwise("m").alias("models"))
    kept = table(spark, sf_dir, "lineitem").filter(F.size(lots.effective(F.array(row))) == 1)
    return kept.groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("""select l_orderkey, coalesce(min(p) filter (k = 'A' and r = ra), min(p) filter (k = 'R' and r = rr), min(p) filter (r = r0)) as clue from (
select *, min(case when k = 'A' and p > 0 then r end) over w as ra, min(case when k = 'R' and p > 0 then r end) over w as rr, min(case when p > 0 then r end) over w as r0 from (
select l_orderkey, l_returnflag as k, cast(case when l_partkey % 3 = 0 then 0 else l_partkey end as double) as p, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as r from lineitem) window w as (partition by l_orderkey)) group by l_orderkey""")
def q_price_clue(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "中标").when(F.col("l_returnflag") == "R", "中标候选人").otherwise("")
    price = F.when(F.col("l_partkey") % 3 == 0, 0).otherwise(F.col("l_partkey")).cast("double")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", kind.alias("type"), price.alias("candidatePrices")))).alias("c"))
    return rows.select("l_orderkey", attempts.price_clue(F.lit(None).cast("double"), F.col("c")).alias("clue"))


_TERM_TEXT = "挖机、液压挖掘机\n装载机,ECONOMY\\nSTANDARD，BRASS、 BRASS,ANODIZED BRASS\nTIN"


@query("""select p_partkey, case when regexp_replace(p_type, '\\s', '', 'g') in ('ECONOMY', 'STANDARD', 'TIN', 'BRASS') then regexp_replace(p_type, '\\s', '', 'g')
when regexp_replace(p_type, '\\s', '', 'g') = 'ANODIZEDBRASS' then 'ANODIZED BRASS' end as matched_term from part""")
def q_category_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("subject"))
    return category.exact_term(part, category.product_terms(spark, _TERM_TEXT)).select("p_partkey", "matched_term")


@query("""select p_partkey, case when contains(p_type, 'ANODIZED BRASS') then 'ANODIZED BRASS' when contains(p_type, 'STANDARD') then 'STANDARD' when contains(p_type, 'ECONOMY') then 'ECONOMY'
when contains(p_type, 'BRASS') then 'BRASS' when contains(p_type, 'TIN') then 'TIN' end as matched_term from part""")
def q_category_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("subject"))
    return category.contained_term(part, category.product_terms(spark, _TERM_TEXT), "p_partkey").select("p_partkey", "matched_term")


@query("""select p_partkey, case p_size % 4 when 0 then 'no_match' when 1 then 'exact' when 2 then 'multi_value' else 'not_in_table' end as kind,
case p_size % 4 when 0 then '' when 1 then 'TIN' when 2 then 'a' || p_size else 'x' || p_size end as value from part""")
def q_category_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("p_size") % 4, F.col("p_size").cast("string")
    answer = F.when(k == 0, " ").when(k == 1, "TIN").when(k == 2, F.concat(F.lit("、a"), n, F.lit("、b"))).otherwise(F.concat(F.lit("x"), n))
    kind = category.answer_kind(answer, answer == "TIN")
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"), category.answer_value(answer, kind).alias("value"))


@query(f"select n_nationkey, country, province, city, district, reason from nation, {_literals(_PLACES, 'country, province, city, district, reason')}")
def q_addr_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _over(spark, sf_dir, _PLACES, list(address.FIELDS))
    return rows.withColumn("reason", address.reason(*(F.col(f) for f in address.FIELDS)))


@query("""select n_nationkey, case when n_nationkey % 5 = 4 then '中国' when n_nationkey % 5 = 3 then n_name else '中国' end as country,
case n_nationkey % 5 when 0 then '浙江省' when 1 then '北京市' when 2 then '江苏省' when 3 then 'X' else '' end as province,
case n_nationkey % 5 when 0 then '宁波市' when 1 then '北京市' when 2 then '南京市' when 3 then 'Y' else '' end as city from nation""")
def q_addr_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey") % 5
    pick = lambda *xs: F.element_at(F.array(*map(col_of, xs)), k.cast("int") + 1)
    lit = F.lit
    old = {"country": lit("中国"), "province": pick(lit("浙江省"), lit(""), lit(""), lit(""), lit("")), "city": pick(lit("宁波市"), lit(""), lit("南京市"), lit(""), lit("")), "district": lit("")}
    new = {"country": pick(lit("中国"), lit("中国"), lit("中国"), "n_name", lit("Z")), "province": pick(lit("浙江"), lit("北京市"), lit("江苏省"), lit("X"), lit("Q")), "city": pick(lit("宁波"), lit("天津市"), lit("南京"), lit("Y"), lit("R")), "district": lit("")}
    out = address.or_default(F.when(k == 4, " ").otherwise("here"), address.fallback(old, new))
    return table(spark, sf_dir, "nation").select("n_nationkey", *(out[f].alias(f) for f in ("country", "province", "city")))


# ------------------------------------------------------------------ records


@query("""select doc_id, '' as "dataId", 2026041001 as version, false as "inputTruncated", source as "announcementName", lang as "projectName", true as "isEquipment", false as "isOverseasProject", cast(null as double) as "budgetAmount", 0 as lots from documents""")
def q_template_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    from noticeflow import catalog

    items = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("announcementName"), F.col("lang").alias("projectName"), "text")
    return catalog.conform(items).select("doc_id", "dataId", "version", "inputTruncated", "announcementName", "projectName", "isEquipment", "isOverseasProject", "budgetAmount", F.size("lotProducts").alias("lots"))


@query("""with u as (select page_id, url, regexp_extract(url, '^(https?)://', 1) as s, regexp_extract(url, '^https?://([^/?#]*)', 1) as h, regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '') as p, regexp_extract(url, '#(.*)$', 1) as f from pages)
select page_id, h as host, p as path, f as fragment, h = 'm.ththan.example.net' and s = 'https' and p = '/en/1' and f = '' as on_list, url as detail_key, s in ('http', 'https') and h <> '' as valid from u""")
def q_url_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", jsonx.url_part(u, "HOST").alias("host"), F.regexp_replace(jsonx.url_part(u, "PATH"), "/+$", "").alias("path"), jsonx.url_part(u, "REF").alias("fragment"), jsonx.on_list_page(u, F.lit("https://m.ththan.example.net/en/1/")).alias("on_list"), jsonx.detail_key(u, F.lit("t"), F.lit("d")).alias("detail_key"), jsonx.valid_url(u).alias("valid"))


@query("""select doc_id, length(text) > 2000 as truncated, substr(text, 1, 2000) as head, case when length(text) > 600 then substr(text, 1, 600) || '...' else text end as excerpt from documents""")
def q_truncate_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    head, cut = text.capped(F.col("text"), 2000)
    return table(spark, sf_dir, "documents").select("doc_id", cut.alias("truncated"), head.alias("head"), text.shortened(F.col("text")).alias("excerpt"))


@query("""select vec_id, len(list_resize(embedding, 100, 0)) as longer, len(embedding[1:10]) as shorter, cast(embedding[10] as double) as tenth from embeddings""")
def q_embedding_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(jsonx.shaped_vector(v, 100)).cast("bigint").alias("longer"), F.size(jsonx.shaped_vector(v, 10)).cast("bigint").alias("shorter"), F.element_at(jsonx.shaped_vector(v, 10), 10).cast("double").alias("tenth"))


@query("""with h as (select page_id % 10 as org, page_id, regexp_extract(url, '^https?://([^/]*)', 1) as url from pages), f as (select org, url, min(page_id) as page_id from h group by org, url),
r as (select *, row_number() over (partition by org order by page_id) as pos from f) select org, cast(pos as integer) as pos, url from r where pos <= 8""")
def q_hits_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    from noticeflow.sources.inputs import search_hits

    hits = table(spark, sf_dir, "pages").select((F.col("page_id") % 10).alias("org"), "page_id", F.regexp_extract("url", "^https?://([^/]*)", 1).alias("url"), "page_id")
    half = lambda even: F.transform(F.array_sort(F.collect_list(F.when((F.col("pos") <= F.col("n") / 2) == F.lit(even), F.struct("p", "url")))), lambda x: F.struct(x["url"].alias("url")))
    ranked = hits.toDF("org", "p", "url", "_").withColumn("pos", F.row_number().over(W.partitionBy("org").orderBy("p"))).withColumn("n", F.count("*").over(W.partitionBy("org")))
    answers = ranked.groupBy("org").agg(F.to_json(F.struct(F.struct(F.struct(half(True).alias("value")).alias("webPages")).alias("data"), half(False).alias("results"))).alias("payload"))
    return search_hits(answers).select("org", "pos", "url")


@query("""select o_orderkey, sha256('{"announcementName":"' || o_orderpriority || '","customer":' || o_custkey || ',"order":' || o_orderkey || '}') as data_id from orders""")
def q_data_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"order": F.col("o_orderkey"), "announcementName": F.col("o_orderpriority"), "customer": F.col("o_custkey"), "version": F.lit(1)}
    return table(spark, sf_dir, "orders").select("o_orderkey", hashing.native_data_id(fields).alias("data_id"))


@query("""select o_orderkey, sha256('{"announcementName":"' || o_orderpriority || '","customer":' || o_custkey || ',"order":' || o_orderkey || '}') as "dataId" from orders""")
def q_data_id_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order"), F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("announcementName"))
    return hashing.with_data_id(items).select(F.col("order").alias("o_orderkey"), "dataId")


@query()
def q_html_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("html")
    cut = html.clean_for_extraction_udf(page)
    return table(spark, sf_dir, "pages").select("page_id", html.clean_content_udf(page).alias("content"), cut["text"].alias("extract"), cut["truncated"].alias("truncated"), html.plain_text_udf(page).alias("plain"))


@query()
def q_html_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html.markdown_udf(html.main_container_udf(F.col("html"))).alias("markdown"))
