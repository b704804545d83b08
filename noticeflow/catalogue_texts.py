"""Queries over column functions of texts, numbers, JSON, addresses, lots and sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.catalogue import query, table
from noticeflow.functions import address, answers, jsonx, lots, money, sections, status, text
from noticeflow.sources import inputs


def _case(key: str, n: int, *values) -> F.Column:
    """One of several values, by the key's remainder."""
    out = None
    for i, v in enumerate(values):
        v = v if isinstance(v, F.Column) else F.lit(v)
        out = F.when(F.col(key) % n == i, v) if out is None else out.when(F.col(key) % n == i, v)
    return out


@query("""select p_partkey, case p_partkey % 4 when 0 then p_name when 1 then 'NULL' when 2 then '暂无' else '' end as stripped, case p_partkey % 4 when 0 then p_name else '' end as folded from part""")
def q_text_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _case("p_partkey", 4, F.concat(F.lit(" 　\t"), F.col("p_name"), F.lit(" \n")), " NULL", "暂无 ", None)
    return table(spark, sf_dir, "part").select("p_partkey", text.strip(said).alias("stripped"), text.fold_empty(said).alias("folded"))


@query("""select p_partkey, p_brand || ',' || p_size as listed, 2 as n from part""")
def q_text_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    said = _case("p_partkey", 3, F.concat(F.col("p_brand"), F.lit("；none, "), size, F.lit(" ,,-")), F.to_json(F.array(F.lit("无"), F.col("p_brand"), size, F.lit(""))), F.concat(F.lit(" "), F.col("p_brand"), F.lit("\n、"), size))
    values = text.split_list(said)
    return table(spark, sf_dir, "part").select("p_partkey", text.join_list(values).alias("listed"), F.size(values).alias("n"))


@query("""select p_partkey, p_name || chr(10) || chr(10) || p_type || chr(10) || p_brand as tidy from part""")
def q_tidy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.col("p_name"), F.lit(" \t\r\n\r\n \n\n"), F.col("p_type"), F.lit("　\r"), F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", text.tidy_lines(said).alias("tidy"))


@query("""select p_partkey, repeat('标', cast(least(p_size, 6) as bigint)) || case when p_size < 6 then substr('abcdefghijklmnopq', 1, 20 - 3 * p_size) when p_size = 6 then 'ab' else '' end as head from part""")
def q_byte_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.expr("repeat('标', p_size)"), F.lit("abcdefghijklmnopq"))
    return table(spark, sf_dir, "part").select("p_partkey", text.byte_prefix(said, 20).alias("head"))


@query("""select page_id, regexp_matches(html, '</?[A-Za-z][^>]*>') as page, regexp_matches(url, '</?[A-Za-z][^>]*>') as address from pages""")
def q_looks_like_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.looks_like_html(F.col("html")).alias("page"), text.looks_like_html(F.col("url")).alias("address"))


@query("""select p_partkey, 'p' || lower(regexp_replace('p' || p_brand || 'Name', '([A-Z])', '_\\1', 'g'))[2:] as snake,
case when length(p_name || p_type || p_name) > 64 then substr(regexp_replace(p_name || p_type || p_name, '[^A-Za-z0-9_-]', '_', 'g'), 1, 55) || '_' || substr(sha1(p_name || p_type || p_name), 1, 8)
else regexp_replace(p_name || p_type || p_name, '[^A-Za-z0-9_-]', '_', 'g') end as schema_name, rtrim(regexp_replace(p_brand || ': ' || p_name || ' !', '[^\\p{L}\\p{N} _-]', '', 'g')) as directory from part""")
def q_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = F.concat("p_name", "p_type", "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", text.snake_case(F.concat(F.lit("p"), F.col("p_brand"), F.lit("Name"))).alias("snake"), text.schema_name(long).alias("schema_name"), text.site_directory(F.concat(F.col("p_brand"), F.lit(": "), F.col("p_name"), F.lit(" !"))).alias("directory"))


@query("""select n_nationkey, 'Site ' || n_name || ' {' || n_regionkey || '} ' as prompt from nation""")
def q_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", text.render("Site {name} {{{region}}} {none}", {"name": F.col("n_name"), "region": F.col("n_regionkey"), "none": F.lit(None)}).alias("prompt"))


@query("""select doc_id, a, substr(text, 1, case a when 1 then 80000 when 2 then 30000 else 8000 end) as excerpt from documents, (values (1), (2), (3), (4)) as v(a)""")
def q_retry_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    tries = table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("a"))
    return tries.select("doc_id", "a", text.retry_excerpt(F.col("text"), F.col("a")).alias("excerpt"))


@query("""select conv_id, turn, '{"turn": ' || turn || ', "by": {"role": "' || role || '"}}' as object, '[' || turn || ', "' || role || '"]' as list from conversations""")
def q_answers_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, role = F.col("turn").cast("string"), F.col("role")
    body = F.concat(F.lit('{"turn":'), t, F.lit(',"by":{"role":"'), role, F.lit('"},}'))
    escaped = F.concat(F.lit(r"{\"turn\": "), t, F.lit(r",\n \"by\": {\"role\": \""), role, F.lit(r"\"}}"))
    said = _case("turn", 3, F.concat(F.lit("done: ```json\n"), body, F.lit("\n``` [x]")), escaped, F.concat(F.lit(r"{not} \n"), body))
    listed = F.concat(F.lit("so [1,"), F.lit(" or ["), t, F.lit(',"'), role, F.lit('",] end'))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", answers.object_udf(said).alias("object"), answers.list_udf(listed).alias("list"))


@query("""select conv_id, turn, case when turn % 3 < 2 then '{"a":' || turn || ',"b":null,"c":{"d":1},"e":true}' end as inner, case when turn % 3 < 2 then cast(turn as varchar) end as first,
case when turn % 3 < 2 then turn || ',,true' end as flat from conversations""")
def q_lenient_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit('{"a":'), F.col("turn").cast("string"), F.lit(',"b":null,"c":{"d":1},"e":true}'))
    said = _case("turn", 3, F.concat(F.lit("```json\n"), body, F.lit("\n```")), F.concat(F.lit("it is "), body, F.lit(".")), F.concat(F.lit("{broken "), body))
    inner = jsonx.lenient_object(said)
    flat = jsonx.flat_scalars(inner)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", inner.alias("inner"), jsonx.first_key(inner, "z", "a", "e").alias("first"), F.when(flat.isNotNull(), F.concat_ws(",", flat["a"], flat["b"], flat["e"])).alias("flat"))


@query("""select p_partkey, case p_partkey % 6 when 0 then p_size || '0000~' || (p_size + 1) || '0000' when 1 then p_size || '.50~' || p_size || '.50' when 2 then '面议' when 3 then '' when 4 then p_size || '5000.0~' || p_size || '6000.0'
else p_size || '~' || (p_size + 1) end as estimated, case p_partkey % 6 when 1 then p_size || '.50' end as yuan, cast(p_size * 1000 as double) as number from part""")
def q_estimated_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, m = F.col("p_size").cast("string"), (F.col("p_size") + 1).cast("string")
    said = _case("p_partkey", 6, F.concat(n, F.lit(" 至 "), m, F.lit("万元")), F.concat(n, F.lit(".50元")), "面议", "无", F.concat(n, F.lit(".5万～"), n, F.lit(".6")), F.concat(n, F.lit("-"), m, F.lit("元")))
    return table(spark, sf_dir, "part").select("p_partkey", money.estimated_range(said).alias("estimated"), money.yuan_text(said).alias("yuan"), money.plain_number(F.concat(F.lit(" "), n, F.lit(",000 "))).alias("number"))


@query("""select p_partkey, cast(p_size * 10000 as double) as first, case when p_partkey % 2 = 0 then p_size * 10000 || '.0,' || p_partkey || '.0' else p_size * 10000 || '.0' end as listed from part""")
def q_price_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size").cast("string")
    said = _case("p_partkey", 2, F.concat(F.lit("x；"), n, F.lit("万、无,"), F.col("p_partkey").cast("string")), F.concat(F.lit("￥"), n, F.lit("万元")))
    return table(spark, sf_dir, "part").select("p_partkey", money.first_price(said).alias("first"), F.array_join(F.transform(money.price_list(said), lambda x: F.format_string("%.1f", x)), ",").alias("listed"))


@query("""select p_partkey, p_size <= 10 and p_partkey % 3 = 0 as sure from part""")
def q_confident(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _case("p_partkey", 3, (F.col("p_size") / 10).cast("string"), "true", "high")
    return table(spark, sf_dir, "part").select("p_partkey", inputs.confident(said).alias("sure"))


@query("""select page_id, url as frame, page_id % 2 = 0 as safe, case page_id % 4 when 0 then 'ok' when 1 then 'need_login' when 2 then 'ok' else 'unknown' end as state,
case when page_id % 3 = 0 then case when page_id % 2 = 0 then 'login' else 'skip' end when page_id % 4 in (0, 2) then 'open' else 'skip' end as action,
greatest(page_id % 5, page_id % 3) as saved, page_id % 5 <> page_id % 3 as differs, case when page_id % 6 = 0 then 'url must be http or https' when page_id % 6 = 1 then 'login needs username and password' when page_id % 6 = 2 then 'date_start is after date_end' end as error,
case when page_id % 2 = 0 then 'more than one body' end as body from pages""")
def q_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    state = status.page_state(_case("page_id", 4, " OK then", "please LOGIN", "it is 'ok'", None))
    saved, differs = status.saved_count(n % 5, n % 3)
    url = F.when(n % 6 == 0, "ftp://x/y").otherwise(F.col("url"))
    error = status.request_error(url, n % 6 == 1, F.lit(" "), F.lit("p"), F.when(n % 6 == 2, "2026-02-01").otherwise("2026-01-01"), F.lit("2026-01-31"))
    return table(spark, sf_dir, "pages").select(
        "page_id", status.frame_url(F.concat(F.lit("见 "), F.col("url"), F.lit(" 页面 http://other"))).alias("frame"), status.is_safe(F.when(n % 2 == 1, "UnSafe")).alias("safe"), state.alias("state"),
        status.login_action(n % 3 == 0, n % 2 == 0, state).alias("action"), saved.alias("saved"), differs.alias("differs"), error.alias("error"), status.body_error(F.lit("a"), F.when(n % 2 == 0, "b"), F.lit(None)).alias("body"),
    )


_LINE = r"'^\s+|\s+$', '', 'g'"


@query(f"""with l as (select doc_id, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, {_LINE})) as lines from documents)
select doc_id, len(lines) as n_lines, lines[1] as first_line, lines[-1] as last_line, md5(array_to_string(lines, '|')) as contents from l""")
def q_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a text as a section of its own."""
    lined = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("### h\n"), x)), "\n")
    parts = table(spark, sf_dir, "documents").select("doc_id", sections.sections(lined).alias("p"))
    content = F.transform("p", lambda s: s["content"])
    return parts.select("doc_id", F.size("p").cast("bigint").alias("n_lines"), F.element_at(content, 1).alias("first_line"), F.element_at(content, -1).alias("last_line"), F.md5(F.array_join(content, "|")).alias("contents"))


@query("""select n_nationkey, n_name as title, 'text of ' || n_name as body, 'intro' || chr(10) || chr(10) || '### 公告标题 ' || chr(10) || n_name || chr(10) || chr(10) || '## 正文' || chr(10) || chr(10) || 'new' || chr(10) || chr(10) || '# 其他' || chr(10) || 'x' as rebuilt,
'### 公告标题 ' || chr(10) || n_name || chr(10) || chr(10) || '## 正文' || chr(10) || '  text of ' || n_name as main, 'intro' || chr(10) || chr(10) || '# 其他' || chr(10) || 'x' as rest from nation""")
def q_section_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("intro\r\n### 公告标题 \n"), F.col("n_name"), F.lit("\n\n## 正文\n  text of "), F.col("n_name"), F.lit("\n# 其他\nx\n"))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", said.alias("t"), sections.sections(said).alias("p"))
    p = F.col("p")
    main, rest = sections.primary_secondary(p)
    return rows.select("n_nationkey", sections.title(p).alias("title"), sections.cleaned_body(sections.body(p)).alias("body"), sections.rebuilt(F.col("t"), p, F.lit("new")).alias("rebuilt"), main.alias("main"), rest.alias("rest"))


@query("""select p_partkey, '标段' || case p_size % 3 when 0 then '一' when 1 then '二' else '一' end as lot, case when p_partkey % 2 = 0 then p_type else p_brand end as subject, cast(p_size as varchar) as quantity, '台' as unit, cast(p_size * 10000 as double) as price, 'm1,m2' as models, 1 as n from part""")
def q_lot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size").cast("string")
    none = F.lit("")
    raw = F.struct(
        _case("p_size", 3, "第1包", none, "none").alias("lotNumber"), _case("p_size", 3, none, F.concat(F.lit("2包:"), F.col("p_brand")), F.concat(F.lit("a:"), F.col("p_brand"))).alias("lotName"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise("无").alias("subjects"),
        F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).otherwise("").alias("description"), none.alias("productCategory"), F.lit("m1、m2").alias("models"), F.concat(n, F.lit("万元")).alias("unitPrices"), F.concat(n, F.lit("台")).alias("quantities"), none.alias("quantityUnit"),
    )
    empty = F.struct(*(F.lit(x).alias(f) for f, x in (("lotNumber", "无"), ("lotName", ""), ("subjects", "-"), ("description", None), ("productCategory", ""), ("models", "null"), ("unitPrices", ""), ("quantities", ""), ("quantityUnit", ""))))
    rows = table(spark, sf_dir, "part").select("p_partkey", lots.products(F.array(empty, raw).cast(lots.RAW_PRODUCTS)).alias("rows"))
    r = F.get("rows", F.lit(0))
    return rows.select("p_partkey", r["lotNumber"].alias("lot"), r["subjects"].alias("subject"), r["quantities"].alias("quantity"), r["quantityUnit"].alias("unit"), r["unitPrices"].alias("price"), r["models"].alias("models"), F.size("rows").alias("n"))


@query("""select n_nationkey, case n_nationkey % 4 when 1 then '日本' when 3 then '' else '中国' end as country, case n_nationkey % 4 when 0 then '浙江省' when 2 then '北京市' else '' end as province,
case n_nationkey % 4 when 0 then '杭州市' when 2 then '北京市' else '' end as city, case n_nationkey % 4 when 0 then '西湖区' when 2 then '海淀区' else '' end as district, case when n_nationkey % 3 = 0 then '菲律宾' else '' end as hint, 'cafe ' || lower(n_name) as folded from nation""")
def q_addr_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    detail = _case("n_nationkey", 4, F.concat(F.lit("浙江省杭州市西湖区"), F.col("n_name")), F.concat(F.lit("日本东京 "), F.col("n_name")), " 北京市海淀区1号", "  ")
    found = address.parse_detail(detail)
    place = F.when(F.col("n_nationkey") % 3 == 0, "Brgy. X, Laguna, Biñan").otherwise("Biñan")
    return table(spark, sf_dir, "nation").select("n_nationkey", *(c.alias(f) for f, c in found.items()), address.inferred_country(address.fold_place(place)).alias("hint"), address.fold_place(F.concat(F.lit(" Café "), F.col("n_name"))).alias("folded"))
