"""Queries over what stages read, page scans, typed records and timings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.catalogue import query, table
from noticeflow.functions import jsonx, money, scan, sections
from noticeflow.plans import inputs
from noticeflow.sources import inputs as sources
from noticeflow.sources import sinks
from noticeflow.streaming import events as ev


def _case(c: F.Column, *values: F.Column) -> F.Column:
    """One of several values, by a number's remainder."""
    out = F.when(c % len(values) == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(c % len(values) == i, v)
    return out


# No title or body at all; both, with others around; a body alone, empty; a title in the body's heading.
@query("""select doc_id, case doc_id % 4 when 0 then 'intro' || chr(10) || '# 其他' || chr(10) || 'x' when 1 then '【标题】' || chr(10) || 't' || doc_id || chr(10) || chr(10) || '【正文】' || chr(10) || coalesce(source, '-') when 2 then '# 正文' else '【正文】' || chr(10) || coalesce(source, '-') end as "primary",
case doc_id % 4 when 1 then 'intro' || chr(10) || chr(10) || '# 其他' || chr(10) || 'x' || chr(10) || chr(10) || '# 公告标题' || chr(10) || 'again' else '' end as secondary, false as input_truncated from documents""")
def q_stage_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, t = F.coalesce("source", F.lit("-")), F.concat(F.lit("t"), F.col("doc_id").cast("string"))
    said = _case(F.col("doc_id"), F.lit("intro\r\n# 其他\nx"), F.concat(F.lit("intro\n## 标题\n"), t, F.lit("\n\n# 其他\nx\n# 公告标题\nagain\n### 公告正文\n"), source), F.lit("# 正文\n \n"), F.concat(F.lit("# 标题和正文\n"), source))
    return inputs.from_sources(table(spark, sf_dir, "documents").select("doc_id", said.alias("source_text")))


@query("""with l as (select doc_id, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) as lines from documents where text is not null)
select doc_id, cast(pos - 1 as int) as pos, 'h' as heading, lines[pos] as content from l, unnest(range(1, len(lines) + 1)) as u(pos)""")
def q_section_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lined = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("# h\n"), x)), "\n")
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", lined.alias("t"))
    return sections.rows(docs, "doc_id", "t").select("doc_id", "pos", "heading", "content")


# A detail box and a header before it; a header inside it; a box named like a shell against a plain one;
# a frame that carries the page.
@query("""select page_id, case page_id % 4 when 0 then '<div class="detail">' || repeat('d', 90) || '</div>' when 1 then '<div class="detail"><h1 class="title">' || repeat('t', 30) || '</h1>' || repeat('d', 90) || '</div>' when 2 then '<section>公告内容 ' || repeat('d', 90) || '</section>' else '<p>' || repeat(cast(page_id % 10 as varchar), 600) || '</p>' end as main,
case page_id % 4 when 0 then '<p>发布日期：2026-01-01 项目编号：' || page_id || ' 联系人：x</p>' when 1 then '<h1 class="title">' || repeat('t', 30) || '</h1>' else '' end as header,
case page_id % 4 when 0 then 'disjoint' when 1 then 'descendant' else '' end as relation from pages""")
def q_page_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id").cast("string")
    d, t = "d" * 90, "t" * 30
    said = _case(
        F.col("page_id"),
        F.concat(F.lit("<p>发布日期：2026-01-01 项目编号："), key, F.lit(f" 联系人：x</p><div class='nav'>{d}{d}</div><div class='detail'>{d}</div>")),
        F.lit(f"<div class='detail'><h1 class='title'>{t}</h1>{d}<script>x</script></div>"),
        F.lit(f"<div class='menu'>{d}{d}{d}</div><section>公告内容 {d}</section>"),
        F.concat(F.lit("<div class='detail'>x</div><iframe srcdoc='&lt;p&gt;"), F.repeat((F.col("page_id") % 10).cast("string"), F.lit(600)), F.lit("&lt;/p&gt;'></iframe>")),
    )
    return table(spark, sf_dir, "pages").select("page_id", scan.scan_udf(said).alias("s")).select("page_id", "s.main", "s.header", "s.relation")


@query("""select page_id, '<p>' || page_id || '</p>' || case when page_id % 3 = 0 then repeat('x', 50000 - 7 - length(cast(page_id as varchar))) else '' end as input, page_id % 3 = 0 as input_truncated from pages""")
def q_page_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id").cast("string")
    said = F.concat(F.lit("<script>s</script><p class='c'>"), key, F.lit("</p>"), F.when(F.col("page_id") % 3 == 0, F.repeat(F.lit("x"), F.lit(60_000))).otherwise(""))
    return inputs.from_pages(table(spark, sf_dir, "pages").select("page_id", said.alias("html")))


@query("""select p_partkey, case p_partkey % 5 when 0 then cast(p_partkey as varchar) when 1 then cast(p_size as varchar) || '.5' when 2 then '1234' || p_size end as number from part""")
def q_script_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    said = _case(F.col("p_partkey"), F.concat(F.lit(" +00"), F.col("p_partkey").cast("string")), F.concat(size, F.lit(".50")), F.concat(F.lit("1,234"), size), F.lit("1e5"), F.lit(" None "))
    return table(spark, sf_dir, "part").select("p_partkey", money.script_number(said).alias("number"))


@query("""select s_suppkey, case s_suppkey % 4 when 0 then '' when 1 then 'https://h/' || s_suppkey || '/api/v1' when 2 then 'https://h/' || s_suppkey || '/api/v1' else 'https://h/' || s_suppkey || '/v2' end as base from supplier""")
def q_service_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.concat(F.lit("https://h/"), F.col("s_suppkey").cast("string"))
    said = _case(F.col("s_suppkey"), F.lit(None).cast("string"), F.concat(host, F.lit("/api//")), F.concat(host, F.lit("/api/v1/embeddings")), F.concat(host, F.lit("/v2/")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", jsonx.service_base(said, "/api", "/v1", "/embeddings").alias("base"))


@query("""select event_id, case when event_id % 4 = 0 then '{"k": ' || event_id || '}' when event_id % 4 = 1 then '[1]' end as json, event_id % 4 < 3 as sound, case when event_id % 4 = 0 then '{"k":' || event_id || '}' when event_id % 4 = 3 then '{"k":' || event_id || '}' end as object from events""")
def q_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, n = F.col("event_id").cast("string"), F.col("event_id") % 4
    body = _case(F.col("event_id"), F.concat(F.lit('{"k": '), key, F.lit("}")), F.lit("[1]"), F.lit("<html>"), F.concat(F.lit('"data": {"k":'), key, F.lit('}, "code": 0')))
    whole = F.regexp_replace(jsonx.braced(body), " ", "")
    return table(spark, sf_dir, "events").select("event_id", jsonx.json_or_absent(body).alias("json"), jsonx.one_body(F.when(n > 1, "a"), F.when(n == 3, "b")).alias("sound"), whole.alias("object"))


@query("""select p_partkey, 'name: "' || p_brand || '"' || chr(10) || 'price: ' || case when p_size % 2 = 0 then p_size || '000' else 'null' end || chr(10) || 'new: ' || case when p_size % 3 = 0 then 'true' else 'false' end || chr(10) || 'rows:' || chr(10) || '- id: "' || p_size || '"' || chr(10) || '  n: 1.5' || chr(10) as yaml from part""")
def q_typed_yaml(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    price = F.when(F.col("p_size") % 2 == 0, F.concat(size, F.lit(",000"))).otherwise("none")
    row = F.array(F.struct(F.col("p_size").alias("id"), F.lit("1.50").alias("n"), F.lit("x").alias("other")))
    data = F.to_json(F.struct(row.alias("rows"), F.col("p_brand").alias("name"), price.alias("price"), F.when(F.col("p_size") % 3 == 0, "是").otherwise("no").alias("new")))
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('{"code":0,"data":'), data, F.lit("}"))).otherwise(F.substr(data, F.lit(2), F.length(data) - 2))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size").repartition(sources.TASKS_A_CORE * spark.sparkContext.defaultParallelism, "p_partkey")  # a small file is one task's otherwise
    return parts.select("p_partkey", sinks.typed_yaml(raw, {"name": "string", "price": "number", "new": "boolean", "rows": {"id": "string", "n": "number"}}).alias("yaml"))


@query("""with m as (select user_id, event_type, ts, lead(ts) over (partition by user_id order by ts, event_id) as after from events)
select user_id, event_type as stage, round((epoch_us(after) - epoch_us(ts)) / 1e6, 3) as seconds from m where after is not null
union all select user_id, 'total', round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) from events group by user_id""")
def q_stage_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.stage_seconds(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", ["event_id"])


# Texts of the table under a heading, line by line: lines that are headings themselves start sections.
@query("""with t as (select doc_id, regexp_replace('# 标题' || chr(10) || coalesce(source, '') || chr(10) || '## 正文' || chr(10) || coalesce(text, ''), '\\r\\n?', chr(10), 'g') as t from documents),
s as (select doc_id, string_split(regexp_replace(t, '^[\\s\\x0b\\x85\\pZ]+|[\\s\\x0b\\x85\\pZ]+$', '', 'g'), chr(10)) as lines from t),
l as (select doc_id, n, lines[n] as line, regexp_matches(lines[n], '^[\\s\\x0b]{0,3}#{1,6}[\\s\\x0b]*[^\\r\\x85\\x{2028}\\x{2029}\\s\\x0b]') as head from s, unnest(range(1, len(lines) + 1)) as u(n)),
g as (select *, sum(case when head then 1 else 0 end) over (partition by doc_id order by n) as k from l)
select doc_id, cast(k - 1 as int) as pos, max(regexp_replace(regexp_replace(line, '^[\\s\\x0b]{0,3}#{1,6}', ''), '^[\\s\\x0b\\x85\\pZ]+|[\\s\\x0b\\x85\\pZ]+$', '', 'g')) filter (head) as heading,
coalesce(regexp_replace(string_agg(line, chr(10) order by n) filter (not head), '^[\\s\\x0b\\x85\\pZ]+|[\\s\\x0b\\x85\\pZ]+$', '', 'g'), '') as content from g group by doc_id, k""")
def q_section_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("# 标题\n"), F.coalesce("source", F.lit("")), F.lit("\n## 正文\n"), F.coalesce("text", F.lit("")))
    docs = table(spark, sf_dir, "documents").select("doc_id", said.alias("t"))
    return sections.lateral_rows(docs, "doc_id", "t").select("doc_id", "pos", "heading", "content")


# Every encoding that is tried: UTF-16 by its mark, UTF-8 with a mark and without, GB18030, and neither.
@query("""select doc_id, coalesce(text, '') || case doc_id % 5 when 3 then '' else '标段' end || case when doc_id % 5 = 4 then chr(65533) else '' end as source_text from documents where doc_id % 5 <> 3
union all select doc_id, coalesce(source, '') || '标段' from documents where doc_id % 5 = 3""")
def q_source_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    bytes_of = lambda c: F.encode(c, "UTF-8")
    said = F.concat(F.coalesce("text", F.lit("")), F.lit("标段"))
    mark, gb, broken = F.unhex(F.lit("EFBBBF")), F.unhex(F.lit("B1EAB6CE")), F.unhex(F.lit("FF"))
    raw = _case(F.col("doc_id"), F.encode(said, "UTF-16"), F.concat(mark, bytes_of(said)), bytes_of(said), F.concat(bytes_of(F.coalesce("source", F.lit(""))), gb), F.concat(bytes_of(said), broken))
    return table(spark, sf_dir, "documents").select("doc_id", sources.decode_udf(raw).alias("source_text"))


# Each supplier's source as a file, wrapped or not, read back from its folder; folders
# are of a thousand files, which all tasks write side by side.
@query("""select s_suppkey, '# 标题' || chr(10) || s_name || chr(10) || '# 正文' || chr(10) || s_nationkey as source_text from supplier""")
def q_source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("# 标题\n"), "s_name", F.lit("\n# 正文\n"), F.col("s_nationkey").cast("string"))
    files = table(spark, sf_dir, "supplier").select(F.concat_ws("/", F.floor(F.col("s_suppkey") / 1000).cast("string"), F.concat(F.col("s_suppkey").cast("string"), F.lit(".txt"))).alias("path"), F.when(F.col("s_suppkey") % 2 == 0, sources.wrapped(said)).otherwise(said).alias("content"))
    folder = sinks.shared_folder(spark, "sources")
    sinks.write_files(files.repartition(sources.TASKS_A_CORE * spark.sparkContext.defaultParallelism, "path"), folder)
    read = sources.text_files(spark, folder)
    return read.select(F.regexp_extract("path", r"/(\d+)\.txt$", 1).cast("bigint").alias("s_suppkey"), sources.unwrapped(F.col("source_text")).alias("source_text"))


# A price list with a model a brand, as a file, read and exported again.
@query("""select p_brand as model, cast(min(p_size) as double) as input_cost, cast(max(p_size) as double) as output_cost from part where p_brand is not null group by p_brand""")
def q_price_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = table(spark, sf_dir, "part").filter("p_brand is not null").groupBy("p_brand").agg(F.to_json(F.struct(F.min("p_size").alias("input_cost_per_token"), F.max("p_size").alias("output_cost_per_token"))).alias("c"))
    listed = costs.agg(F.concat(F.lit('{"data": {'), F.array_join(F.collect_list(F.concat(F.lit('"'), "p_brand", F.lit('": '), "c")), ", "), F.lit("}}")).alias("value"))
    folder = sinks.shared_folder(spark, "prices")
    listed.write.text(folder)
    rows = sources.prices(spark, folder)
    exported = sinks.export_prices(rows, rows.agg(F.min("model")).first()[0])
    out = spark.createDataFrame([(exported,)], "j string").select(F.explode(F.from_json("j", "map<string,struct<input_cost:double,output_cost:double>>")).alias("model", "p"))
    return out.select("model", "p.input_cost", "p.output_cost")
